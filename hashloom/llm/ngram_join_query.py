"""op10: near duplicates among all documents."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.ngram_join import near_links

NAME = "op10_ngram_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT text, min(doc_id) AS tid, any_value(w) AS w FROM d GROUP BY text
), s AS (
  SELECT DISTINCT tid, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0
), n AS (SELECT tid, count(*) AS n FROM s GROUP BY tid),
p AS (
  SELECT a.tid AS a, b.tid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.tid <> b.tid GROUP BY ALL
), links AS (
  SELECT p.a, p.b, x.n = p.c AND y.n = p.c AS same FROM p JOIN n x ON x.tid = p.a JOIN n y ON y.tid = p.b WHERE 9 * p.c >= 4 * (x.n + y.n)
), reach(a, b) AS (
  SELECT tid, tid FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), root AS (SELECT a AS tid, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS tid, count(*) AS n_links, min(b) FILTER (WHERE same) AS same FROM links GROUP BY a)
SELECT d.doc_id, root.class_id, least(t.tid, coalesce(deg.same, t.tid)) AS set_id, CAST(coalesce(deg.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN t ON d.text = t.text JOIN root ON root.tid = t.tid LEFT JOIN deg ON deg.tid = t.tid
"""
