"""op7: byte strings of 200 that start at more than one place."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.suffix_dedup import remove_repeats

NAME = "op7_suffix_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), s AS (
  SELECT doc_id, i, b[i + 1:i + 200] AS g FROM d, unnest(range(0, octet_length(b) - 199)) AS r(i)
), p AS (
  SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)
), m AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS first FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
), gone AS (
  SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi, 1 AS own FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL
  SELECT d.doc_id, coalesce(max(g.hi), 0), any_value(octet_length(d.b)), 0 FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(any_value(octet_length(d.b)) AS BIGINT) AS n_bytes, CAST(any_value(octet_length(d.b)) - sum(kept.hi - kept.lo) AS BIGINT) AS n_removed,
  CAST(sum(kept.own) AS BIGINT) AS n_spans, sha256(unhex(string_agg(hex(CASE WHEN kept.hi > kept.lo THEN d.b[kept.lo + 1:kept.hi] ELSE ''::BLOB END), '' ORDER BY kept.lo))) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id GROUP BY d.doc_id
"""
