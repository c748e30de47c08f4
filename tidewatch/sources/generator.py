"""Deterministic synthetic units and readings of any size.

The id of a reading and its draws come from its unit and its hour, counted from
1970: a reading is the same in every run, whatever the partitioning and whichever
span of hours is asked for, and readings of different hours never share an id.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import moment_literal, naive_utc

# Ranges in hundredths, except light, which is whole.
SALINITY = (2400, 2750)
PH = (760, 840)
TEMPERATURE = (2650, 2950)
TURBIDITY = (800, 1400)
LIGHT = (12000, 45000)
OXYGEN = (520, 750)
# Fixed values of the declining scenario: oxygen from 6.80 down by 3.20 with
# noise of 0.15 either way, and turbid water in the last six hours.
OXYGEN_START, OXYGEN_DROP, OXYGEN_NOISE = 680, 320, 15
TURBID = (1800, 3200)
TURBID_HOURS = 6
DEFAULT_TOTAL_HOURS = 168

DECLINING_NAMES = ("U-03",)

_DRAW_DIGITS = 5  # hexadecimal digits of a digest per draw
_DRAW_BITS = 4 * _DRAW_DIGITS
_DRAWS_PER_WORD = 3  # as many draws as fit one bigint, read from the digest at once
_BLOCK_HOURS = 24
#: Hours from 1970 on that fit an id beside the unit: up to the year 2926.
ID_HOURS = 1 << 23
_ROWS_PER_TASK = 2_000_000


def generate_units(spark: SparkSession, n: int) -> DataFrame:
    """``n`` units with ids from 1, alternating species; the third one carries a warning."""
    return units_of(spark.range(1, n + 1))


def units_of(ids: DataFrame) -> DataFrame:
    """A unit for each row of a table with column ``id``."""
    named = ids.selectExpr("CAST(id AS INT) AS id", "format_string('U-%02d', id) AS name")
    declining = " OR ".join(f"name = '{name}'" for name in DECLINING_NAMES)
    return named.selectExpr(
        "id",
        "name",
        "if(id % 2 = 1, 'grouper', 'snapper') AS species",
        f"if({declining}, 'warning', 'active') AS status",
        "format_string('Farmer %02d', id) AS farmer_name",
    )


def _word(position: int) -> str:
    digits = _DRAW_DIGITS * _DRAWS_PER_WORD
    return f"CAST(conv(substring(_digest, {position * digits + 1}, {digits}), 16, 10) AS BIGINT) AS _word{position}"


def _draw(position: int) -> str:
    word, place = divmod(position, _DRAWS_PER_WORD)
    shift = _DRAW_BITS * (_DRAWS_PER_WORD - 1 - place)
    return f"(shiftright(_word{word}, {shift}) & {(1 << _DRAW_BITS) - 1})"


def _uniform(draw: str, bounds: tuple[int, int]) -> str:
    """A draw scaled to whole steps between the bounds, rounded half-up."""
    low, high = bounds
    return f"({low} + shiftright({draw} * {2 * (high - low)} + {1 << _DRAW_BITS}, {_DRAW_BITS + 1}))"


def _falling_oxygen(draw: str, hours: int) -> str:
    """Start, drop so far and noise over one common denominator, rounded half-up."""
    steps = max(hours - 1, 1)
    scale = steps << _DRAW_BITS
    exact = (
        f"{(OXYGEN_START - OXYGEN_NOISE) * scale}L"
        f" - _hour * {OXYGEN_DROP << _DRAW_BITS} + {draw} * {2 * OXYGEN_NOISE * steps}"
    )
    return f"((2 * ({exact}) + {scale}L) DIV {2 * scale}L)"


def generate_readings(
    units: DataFrame,
    as_of: datetime | str,
    hours: int = DEFAULT_TOTAL_HOURS,
    declining: Column | None = None,
) -> DataFrame:
    """Hourly readings of every unit, the last one at the full hour of ``as_of``.

    Only the declining scenario depends on where an hour lies within the span.

    ``declining`` is a condition on the columns of ``units``; by default it is
    the third generated unit. Work is spread by day of a unit, so one unit with
    a long history and many units with a short one are both parallel.
    """
    if declining is None:
        declining = F.col("name").isin(*DECLINING_NAMES)
    end = naive_utc(as_of).replace(minute=0, second=0, microsecond=0)
    start = end - timedelta(hours=hours - 1)
    first_hour = (start - datetime(1970, 1, 1)) // timedelta(hours=1)
    session = units.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, -(-units.count() * hours // _ROWS_PER_TASK))

    blocks = units.select("id", "name", declining.alias("_declining")).selectExpr(
        "id", "name", "_declining", f"explode(sequence(0L, {(hours - 1) // _BLOCK_HOURS}L)) AS _block"
    )
    first = f"_block * {_BLOCK_HOURS}"
    drawn = (
        blocks.repartition(tasks, "id", "_block")
        .selectExpr(
            "id",
            "name",
            "_declining",
            f"explode(sequence({first}, least({first} + {_BLOCK_HOURS - 1}, {hours - 1}L))) AS _hour",
        )
        .selectExpr("id", "_declining", "_hour", f"md5(concat(name, '-', CAST({first_hour} + _hour AS STRING))) AS _digest")
        .selectExpr("id", "_declining", "_hour", _word(0), _word(1))
    )
    turbidity = (
        f"if(_declining AND _hour >= {hours - TURBID_HOURS},"
        f" {_uniform(_draw(3), TURBID)}, {_uniform(_draw(3), TURBIDITY)})"
    )
    oxygen = f"if(_declining, {_falling_oxygen(_draw(5), hours)}, {_uniform(_draw(5), OXYGEN)})"
    return drawn.selectExpr(
        f"CAST(id AS BIGINT) * {ID_HOURS} + {first_hour} + _hour AS id",
        "id AS unit_id",
        f"{moment_literal(start)} + make_dt_interval(0, CAST(_hour AS INT)) AS timestamp",
        f"{_uniform(_draw(1), PH)} / 100D AS ph",
        f"{_uniform(_draw(2), TEMPERATURE)} / 100D AS temperature",
        f"{_uniform(_draw(0), SALINITY)} / 100D AS salinity",
        f"{turbidity} / 100D AS turbidity",
        f"CAST({_uniform(_draw(4), LIGHT)} AS DOUBLE) AS light_intensity",
        f"{oxygen} / 100D AS do_predicted",
        "'tft' AS do_source",
    )
