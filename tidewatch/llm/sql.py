"""SQL twins of the queries that SQL can express."""

from tidewatch.llm.licenses import CONTAINED, SHINGLE, TEMPLATES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SHINGLES = f"list_distinct(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')))"

#: Every shingle of every document against those of every notice, without bands.
LICENSE_SQL = f"""
WITH given(template, license, text) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
templates AS (SELECT template, license, {_SHINGLES} AS s FROM (SELECT *, {_WORDS} AS words FROM given)),
known AS (SELECT template, unnest(s) AS shingle FROM templates),
docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
held AS (SELECT n, doc_id, unnest({_SHINGLES}) AS shingle FROM docs),
hits AS (SELECT n, doc_id, template, count(*) AS matched FROM held JOIN known USING (shingle) GROUP BY ALL)
SELECT doc_id, CAST(template AS INTEGER) AS template, license, matched, CAST(len(s) AS BIGINT) AS shingles, matched / len(s)::DOUBLE AS containment
FROM hits JOIN templates USING (template) WHERE matched / len(s)::DOUBLE >= {CONTAINED}
"""

MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS part
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(source_size) OVER w, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM per
  WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
line AS (
  SELECT *, max(CASE WHEN (total - 2.0::DOUBLE * filled) / rest * weight <= 2.0::DOUBLE * source_size THEN (total - 2.0::DOUBLE * filled) / rest END) OVER () AS level
  FROM levels),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level * weight, 2.0::DOUBLE * source_size)) AS target FROM line),
ranked AS (
  SELECT rows.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), size >> greatest(length(bin(size)) - 4, 0), part, size, doc_id) AS r
  FROM rows)
SELECT doc_id, size, source_size, target,
       size * (floor(r * step + shift) - floor((r - 1) * step + shift))::BIGINT AS taken
FROM (
  SELECT ranked.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
         ('0x' || substr(md5('mix:' || coalesce(ranked.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source)
"""
