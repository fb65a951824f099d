"""Queries over ``conversations`` as section sequences: turn is the position, role the type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, sequences
from ..registry import query, table

ROLES = ["system", "user", "assistant", "tool"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("double").alias("size"))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(event_id) AS first, count(*) AS spans FROM r GROUP BY user_id, run"""
)
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.collapsed_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT turn, role, count(*) AS n, floor(count(*) * 1000 / sum(count(*)) OVER (PARTITION BY turn) + 0.5) / 10 AS share FROM conversations WHERE turn < 8 GROUP BY turn, role")
def position_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.position_profile(_turns(spark, sf_dir), "turn", "role")


@query("SELECT role, count(DISTINCT conv_id) AS n, (SELECT count(DISTINCT conv_id) FROM conversations) AS pages FROM (VALUES ('system'), ('user'), ('assistant'), ('tool')) v(r) LEFT JOIN conversations ON role = r GROUP BY r, role".replace("SELECT role,", "SELECT r AS role,"))
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.prevalence(_turns(spark, sf_dir), "conv_id", "role", ROLES)


@query(
    """WITH c AS (SELECT length(text)::DOUBLE AS s FROM conversations), l AS (SELECT list_sort(list(s)) AS v, count(*) AS n FROM c)
SELECT n, v[1] AS least, v[least(n, floor(0.25 * n) + 1)::BIGINT] AS p25, v[least(n, floor(0.5 * n) + 1)::BIGINT] AS median, v[least(n, floor(0.75 * n) + 1)::BIGINT] AS p75, v[n] AS greatest FROM l"""
)
def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.scale(_turns(spark, sf_dir), "size")


@query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS turn, arg_min(length(text), turn) AS size FROM conversations GROUP BY ALL), t AS (SELECT count(DISTINCT conv_id) AS n FROM conversations)
SELECT role, count(*) AS carriers, floor(count(*) * 1000 / (SELECT n FROM t) + 0.5) / 1000 AS share, median(turn)::DOUBLE AS turn, median(size)::DOUBLE AS size FROM f GROUP BY role HAVING floor(count(*) * 1000 / (SELECT n FROM t) + 0.5) / 1000 >= 0.15"""
)
def archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.archetype(_turns(spark, sf_dir), "conv_id", "turn", "role", "size").withColumnRenamed("position", "turn")


@query("SELECT role, avg(turn) AS typical FROM conversations GROUP BY role")
def typical_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.typical_positions(_turns(spark, sf_dir), "turn", "role")


_SEQ_SQL = "seq AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'a' WHEN 'user' THEN 'b' WHEN 'assistant' THEN 'c' ELSE 'd' END, '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)"
_KNN_SQL = f"""WITH RECURSIVE {_SEQ_SQL}, pairs AS (
  SELECT a.conv_id AS src, b.conv_id AS dst, floor(levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) * 1000 + 0.5) / 1000 AS distance FROM seq a JOIN seq b ON a.conv_id <> b.conv_id
), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place FROM pairs) WHERE place <= 6)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.encoded(_turns(spark, sf_dir), "conv_id", "turn", "role", ROLES)


@query(f"{_KNN_SQL} SELECT src, dst, distance, place FROM knn")
def sequence_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.neighbours(_sequences(spark, sf_dir), "conv_id")


@query(
    f"""{_KNN_SQL}, edges AS (SELECT src, dst FROM knn WHERE distance < 0.30 UNION SELECT dst, src FROM knn WHERE distance < 0.30),
reach(node, seen) AS (SELECT conv_id, conv_id FROM seq UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON r.seen = e.src),
label AS (SELECT node, min(seen) AS label FROM reach GROUP BY node), sizes AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS shape FROM label GROUP BY label HAVING count(*) >= 4)
SELECT node AS conv_id, coalesce(shape, -1) AS shape FROM label LEFT JOIN sizes ON label.label = sizes.label"""
)
def sequence_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sequences(spark, sf_dir)
    return sequences.shapes(sequences.neighbours(found, "conv_id"), found, "conv_id")


@query(
    """SELECT count(*) AS matched, count(*) FILTER (WHERE p = t) AS correct, count(*) FILTER (WHERE t <> 'good') AS rest_matched, count(*) FILTER (WHERE t <> 'good' AND p = t) AS rest_correct
FROM (SELECT CASE WHEN regexp_matches(text, '[#$%&|]') THEN 'bad' ELSE 'good' END AS p, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"""
)
def classifier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike("[#$%&|]"), "bad").otherwise("good").alias("label"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return sequences.scored(predicted, truth, ["doc_id"], "label", "good")


@query()
def shape_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct role sequences, of which there are few, as one drawing."""
    found = _sequences(spark, sf_dir).select(F.col("sequence").alias("name"), "sequence").distinct()
    near = sequences.neighbours(found, "name")
    return layout.layout(sequences.shapes(near, found, "name"), near, "name")
