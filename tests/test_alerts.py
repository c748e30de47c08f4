from tests.tables import NOW, ago, alert, alerts, ids, reading, readings, receipts, units
from tidewatch.operators.alerts import (
    alert_feed,
    alerts_of_all,
    apply_receipts,
    critical_alert,
    generate_alerts,
    new_dangers,
    unknown_receipts,
)

from tidewatch.sources.tables import read_table, write_table


def test_alerts_of_the_newest_reading_only(spark):
    fleet = units(spark, 1, 2, 3)
    rows = readings(
        spark,
        reading(1, 1, ago(2), ph=5.0),
        reading(2, 1, ago(1), ph=7.1, do_predicted=3.5),
        reading(3, 2, ago(1)),
        reading(4, 9, ago(1), ph=5.0),
    )
    raised = {r.id: r for r in generate_alerts(fleet, rows).collect()}
    assert set(raised) == {10, 14}
    assert raised[10].message == "[Perhatian] U-01: pH = 7.1" and raised[10].severity == "warn"
    assert raised[14].message == "[Kritis] U-01: DO (prediksi) = 3.5" and raised[14].parameter == "do_predicted"
    assert raised[10].timestamp == ago(1) and raised[10].is_read is False
    assert sorted(ids(alerts_of_all(fleet, rows))) == [5, 10, 14]


def test_feed_joins_before_it_limits(spark):
    rows = [alert(i, unit_id=9) for i in range(100, 160)] + [alert(i, timestamp=ago(i)) for i in range(1, 56)]
    feed = alert_feed(alerts(spark, *rows), units(spark, 1))
    assert ids(feed) == list(range(1, 51))


def test_feed_of_a_stored_table(spark, tmp_path):
    """Counting by day prunes days, also when most new alerts belong to unknown units."""
    rows = [alert(i, unit_id=1 if i % 9 == 0 else 9, timestamp=ago(i * 5)) for i in range(1, 400)]
    rows += [alert(1000 + i, unit_id=1, timestamp=ago(3000)) for i in range(60)]
    fleet, plain = units(spark, 1), alerts(spark, *rows)
    write_table(plain, str(tmp_path / "alerts"), "alerts")
    stored = read_table(spark, str(tmp_path / "alerts"), "alerts")
    for n in (1, 7, 44, 45, 50, 500):
        assert ids(alert_feed(stored, fleet, n)) == ids(alert_feed(plain, fleet, n))


def test_feed_breaks_ties_by_id(spark):
    feed = alert_feed(alerts(spark, alert(1), alert(3), alert(2)), units(spark, 1), n=2)
    assert ids(feed) == [3, 2]


def test_critical_alert_branches(spark):
    fleet = units(spark, 1)

    def critical(*rows):
        return ids(critical_alert(alert_feed(alerts(spark, *rows), fleet)))

    assert critical() == []
    assert critical(alert(1, severity="danger", is_read=True)) == []
    assert critical(alert(1, severity="info"), alert(2, severity="info", timestamp=ago(1))) == [1]
    assert critical(alert(1, severity="info"), alert(2, severity="warn", timestamp=ago(5))) == [2]
    assert critical(alert(1), alert(2, severity="danger", timestamp=ago(5)), alert(3, severity="danger", timestamp=ago(6))) == [2]
    # a danger that has left the list does not count
    newer = [alert(i, severity="info", timestamp=ago(1)) for i in range(10, 60)]
    assert critical(alert(1, severity="danger", timestamp=ago(9)), *newer) == [59]


def test_receipts(spark):
    stored = alerts(spark, alert(1), alert(2), alert(3, is_read=True))
    sent = receipts(spark, 2, 2, 3, 77, 77)
    once = apply_receipts(stored, sent)
    assert {r.id: r.is_read for r in once.collect()} == {1: False, 2: True, 3: True}
    assert once.columns == stored.columns
    assert sorted(map(tuple, apply_receipts(once, sent).collect())) == sorted(map(tuple, once.collect()))
    assert [tuple(r) for r in unknown_receipts(stored, sent).collect()] == [(77, 2)]


def test_new_dangers(spark):
    fleet = units(spark, 1)
    before = alert_feed(alerts(spark, alert(1, severity="danger"), alert(2, severity="danger", is_read=True)), fleet)
    after = alert_feed(
        alerts(spark, alert(1, severity="danger"), alert(2, severity="danger"), alert(3, severity="danger"), alert(4)), fleet
    )
    assert sorted(ids(new_dangers(after, before))) == [2, 3]
    assert sorted(ids(new_dangers(after))) == [1, 2, 3]
    assert new_dangers(after, before).columns == after.columns
    # one that left the list and came back is reported again
    empty = alert_feed(alerts(spark, alert(9, timestamp=NOW)), fleet)
    assert sorted(ids(new_dangers(after, empty))) == [1, 2, 3]


def test_null_is_read_counts_as_unread_and_null_time_is_in_no_feed(spark):
    table = alerts(spark, alert(1, severity="danger"), alert(2, severity="danger")).selectExpr(
        "id", "unit_id", "parameter", "severity", "message", "if(id = 2, NULL, timestamp) AS timestamp", "if(id = 1, NULL, is_read) AS is_read"
    )
    from tidewatch.operators.alerts import unread_dangers

    assert sorted(ids(unread_dangers(table))) == [1, 2]
    for feed in (table, table.selectExpr("*", "to_date(timestamp) AS date")):
        assert ids(alert_feed(feed, units(spark, 1))) == [1]
    assert ids(critical_alert(alert_feed(table, units(spark, 1)))) == [1]
