"""Queries of page structure: conversations are pages, turns their sections, roles the types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments, sequences, structure
from ..registry import query, table
from .models import _ANSWER_SQL, _answers
from .sequences import ROLES, _KNN_SQL, _sequences, _turns

_TYPED_SQL = "typed AS (SELECT conv_id, turn, role, length(text)::DOUBLE AS size, CASE WHEN length(text) < 40 THEN 'other' ELSE role END AS type FROM conversations)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short turn has no type."""
    return _turns(spark, sf_dir).withColumn("type", F.when(F.col("size") < 40, "other").otherwise(F.col("role")))


@query(f"WITH {_TYPED_SQL} SELECT count(*) AS sections, count(*) FILTER (WHERE type = 'other') AS other, floor(count(*) FILTER (WHERE type = 'other') / count(*) * 1000 + 0.5) / 1000 AS share FROM typed")
def classifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.classifier_quality(_typed(spark, sf_dir), "conv_id", "type", "other")[0]


@query(
    f"""WITH {_TYPED_SQL}, p AS (SELECT conv_id, count(*) AS sections, count(*) FILTER (WHERE type = 'other') AS other FROM typed GROUP BY conv_id)
SELECT conv_id, sections, other, floor(other / sections * 1000 + 0.5) / 1000 AS share FROM p WHERE other > 0 ORDER BY share DESC, sections DESC, conv_id LIMIT 20"""
)
def worst_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.classifier_quality(_typed(spark, sf_dir), "conv_id", "type", "other")[1]


@query(
    """WITH p AS (SELECT conv_id, sum(length(text))::DOUBLE AS words FROM conversations GROUP BY conv_id)
SELECT * FROM (SELECT 'lowest' AS "end", row_number() OVER (ORDER BY words, conv_id) AS place, conv_id, words FROM p UNION ALL SELECT 'highest', row_number() OVER (ORDER BY words DESC, conv_id), conv_id, words FROM p) WHERE place <= 5"""
)
def scale_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sum("size").alias("words"))
    return structure.scale_ends(pages, "conv_id", "words")


@query("SELECT conv_id, string_agg(role, ' > ' ORDER BY turn, role) AS sequence, count(*) AS sections, sum(length(text))::DOUBLE AS words FROM conversations GROUP BY conv_id")
def company_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.company_strips(_turns(spark, sf_dir), "conv_id", "turn", "role", "size")


@query(
    """WITH p AS (SELECT conv_id, count(*) AS sections, sum(length(text))::DOUBLE AS words, count(DISTINCT role) AS kinds FROM conversations GROUP BY conv_id), m AS (
  SELECT 'sections' AS measure, sections::DOUBLE AS v FROM p UNION ALL SELECT 'words', words FROM p UNION ALL SELECT 'words_a_section', floor(words / sections * 10 + 0.5) / 10 FROM p UNION ALL SELECT 'kinds', kinds FROM p),
l AS (SELECT measure, list_sort(list(v)) AS v, count(*) AS n FROM m GROUP BY measure)
SELECT measure, n, v[1] AS least, v[least(n, floor(0.25 * n) + 1)::BIGINT] AS p25, v[least(n, floor(0.5 * n) + 1)::BIGINT] AS median, v[least(n, floor(0.75 * n) + 1)::BIGINT] AS p75, v[n] AS greatest FROM l"""
)
def page_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.page_scales(structure.company_strips(_turns(spark, sf_dir), "conv_id", "turn", "role", "size"))


@query(
    """WITH s AS (SELECT count(*) AS matched, count(*) FILTER (WHERE p = t) AS correct, count(*) FILTER (WHERE t <> 'good') AS rest_matched, count(*) FILTER (WHERE t <> 'good' AND p = t) AS rest_correct
FROM (SELECT CASE WHEN regexp_matches(text, '[#$%&|]') THEN 'bad' ELSE 'good' END AS p, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t FROM documents JOIN labels ON documents.doc_id = labels.doc_id))
SELECT *, floor(correct / matched * 100 + 0.5) / 100 AS accuracy, CASE WHEN rest_matched > 0 THEN floor(rest_correct / rest_matched * 100 + 0.5) / 100 END AS rest_accuracy FROM s"""
)
def accuracy_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sequences import classifier_score

    return structure.accuracy_block(classifier_score(spark, sf_dir))


@query(
    """WITH p AS (SELECT turn, role, count(*) AS n FROM conversations WHERE turn < 8 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY n DESC, role) AS place, sum(n) OVER (PARTITION BY turn) AS total FROM p),
k AS (SELECT turn, sum(n) AS shown FROM r WHERE place <= 1 GROUP BY turn) SELECT r.turn, place, role, n, (total - shown)::BIGINT AS rest FROM r JOIN k ON r.turn = k.turn WHERE place <= 1"""
)
def slot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = sequences.position_profile(_turns(spark, sf_dir), "turn", "role")
    return structure.slots(profile, "turn", "role", 1)


_FAMILIES = {"system": "frame", "tool": "frame", "user": "talk", "assistant": "talk"}


@query(
    """WITH f AS (SELECT DISTINCT conv_id, CASE WHEN role IN ('system', 'tool') THEN 'frame' ELSE 'talk' END AS family FROM conversations WHERE role IN ('system', 'tool', 'user', 'assistant')), t AS (SELECT count(DISTINCT conv_id) AS total FROM conversations)
SELECT family, count(*) AS pages, floor(count(*) / any_value(total) * 1000 + 0.5) / 1000 AS share FROM f, t GROUP BY family"""
)
def type_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.families(_turns(spark, sf_dir), "conv_id", "role", _FAMILIES)


@query("WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS q FROM conversations GROUP BY conv_id) SELECT conv_id, count(*) OVER (PARTITION BY q) - 1 AS others FROM s")
def same_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.same_sequence(_sequences(spark, sf_dir), "conv_id")


@query(
    """WITH p AS (SELECT conv_id, sum(length(text))::DOUBLE AS words FROM conversations GROUP BY conv_id), l AS (SELECT list_sort(list(words)) AS v, count(*) AS n FROM p),
s AS (SELECT v[1] AS least, v[least(n, floor(0.25 * n) + 1)::BIGINT] AS p25, v[least(n, floor(0.5 * n) + 1)::BIGINT] AS mid, v[least(n, floor(0.75 * n) + 1)::BIGINT] AS p75, v[n] AS greatest, n FROM l)
SELECT conv_id, words, rank() OVER (ORDER BY words DESC) AS place, count(*) OVER (PARTITION BY words) - 1 AS ties, n AS "of",
  CASE WHEN s.least = s.greatest THEN 'flat' WHEN words <= p25 THEN 'low' WHEN words < mid THEN 'below' WHEN words = mid THEN 'middle' WHEN words <= p75 THEN 'above' ELSE 'high' END AS band FROM p, s"""
)
def page_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sum("size").alias("words"))
    return structure.page_insights(pages, "conv_id", "words")


@query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS p, arg_min(length(text), turn)::DOUBLE AS s FROM conversations GROUP BY ALL), t AS (SELECT count(DISTINCT conv_id) AS total FROM conversations),
c AS (SELECT role, count(*) AS pages, median(p)::DOUBLE AS "position", median(s) AS words, any_value(total) AS total FROM f, t GROUP BY role)
SELECT role, pages, floor(pages / total * 1000 + 0.5) / 1000 AS share, "position", words, CASE WHEN pages / total >= 0.9 THEN 'nearly every page' WHEN pages / total >= 0.66 THEN 'most pages' WHEN pages / total >= 0.45 THEN 'about half of pages'
  WHEN pages / total >= 0.3 THEN 'about a third of pages' ELSE 'a minority of pages' END AS how_common, floor(pages * 100 / total + 0.5)::BIGINT || '% (' || format('{:,}', pages) || ' of ' || format('{:,}', total) || ')' AS text FROM c"""
)
def section_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_insights(_turns(spark, sf_dir), "conv_id", "turn", "role", "size")


@query(
    f"""{_KNN_SQL}, edges AS (SELECT src, dst FROM knn WHERE distance < 0.30 UNION SELECT dst, src FROM knn WHERE distance < 0.30),
reach(node, seen) AS (SELECT conv_id, conv_id FROM seq UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON r.seen = e.src),
label AS (SELECT node, min(seen) AS label FROM reach GROUP BY node), sizes AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS shape, count(*) AS n FROM label GROUP BY label HAVING count(*) >= 4),
has AS (SELECT DISTINCT conv_id, role FROM conversations WHERE role NOT IN ('hero', 'other')), m AS (SELECT shape, any_value(n) AS n, role, count(*) AS m FROM label JOIN sizes ON label.label = sizes.label JOIN has ON has.conv_id = node GROUP BY shape, role),
k AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY m DESC, role) AS place FROM m WHERE 2 * m >= n)
SELECT s.shape, s.n, coalesce(string_agg(role, ' + ' ORDER BY place) FILTER (WHERE place <= 2), '') AS name FROM sizes s LEFT JOIN k ON k.shape = s.shape GROUP BY s.shape, s.n"""
)
def shape_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sequences(spark, sf_dir)
    shapes = sequences.shapes(sequences.neighbours(found, "conv_id"), found, "conv_id")
    return structure.shape_names(shapes, _turns(spark, sf_dir), "conv_id", "role")


@query(f"{_KNN_SQL} SELECT (SELECT count(*) FROM seq WHERE s <> '') AS compared, (SELECT count(*) FROM seq) AS \"of\", (SELECT count(*) FROM knn) AS edges")
def neighbour_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sequences(spark, sf_dir)
    scope = found.agg(F.count(F.when(F.length("sequence") > 0, 1)).alias("compared"), F.count("*").alias("of"))
    return scope.crossJoin(F.broadcast(sequences.neighbours(found, "conv_id").agg(F.count("*").alias("edges"))))


@query("WITH r AS (SELECT role, conv_id, row_number() OVER (PARTITION BY role ORDER BY conv_id) AS k FROM (SELECT DISTINCT role, conv_id FROM conversations)) SELECT role, string_agg(conv_id::VARCHAR, ',' ORDER BY k) AS examples FROM r WHERE k <= 12 GROUP BY role")
def archetype_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.examples(_turns(spark, sf_dir), "conv_id", "role")


@query(
    f"""WITH {_TYPED_SQL}, pages AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT conv_id, type, min(turn) AS turn, arg_min(size, turn) AS size FROM typed WHERE type <> 'other' GROUP BY ALL),
c AS (SELECT type, count(*) AS carriers, (SELECT count(*) FROM pages) AS total, median(turn)::DOUBLE AS position, median(size)::DOUBLE AS size FROM f GROUP BY type),
s AS (SELECT *, floor(carriers * 1000 / total + 0.5) / 1000 AS share, carriers / total >= 0.15 OR type = 'system' AS shown FROM c),
b AS (SELECT s.type, p.conv_id, row_number() OVER (PARTITION BY s.type ORDER BY p.conv_id) AS k FROM s, pages p WHERE (s.share >= 0.5) <> EXISTS (SELECT 1 FROM f WHERE f.type = s.type AND f.conv_id = p.conv_id)),
l AS (SELECT type, count(*) AS n, string_agg(printf('c%08d', conv_id), ', ' ORDER BY k) FILTER (WHERE k <= 10) AS breakers FROM b GROUP BY type)
SELECT s.type, carriers, total - carriers AS absent, share, position, size, CASE WHEN shown THEN row_number() OVER (PARTITION BY shown ORDER BY s.type <> 'system', position, share DESC, s.type) END AS place,
  coalesce(breakers, '') AS breakers, greatest(coalesce(n, 0) - 10, 0)::BIGINT AS omitted FROM s LEFT JOIN l ON s.type = l.type"""
)
def archetype_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir).withColumn("name", F.format_string("c%08d", "conv_id"))
    return structure.archetype_bands(typed, "conv_id", "name", "turn", "type", "size", [*ROLES, "other"], pinned="system")


@query(
    """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, source, n, floor(n * 100 / sum(n) OVER (PARTITION BY lang) * 100 + 0.5) / 100 AS width, floor(coalesce(sum(n) OVER (PARTITION BY lang ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100 / sum(n) OVER (PARTITION BY lang) * 100 + 0.5) / 100 AS "offset" FROM n"""
)
def stacked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return structure.stacked(parts, "lang", "source", "n")


@query(
    f"""WITH {_ANSWER_SQL}, c AS (SELECT source AS grp, count(good) AS n, count(*) FILTER (WHERE good) AS yes FROM answers GROUP BY source HAVING count(good) >= 6),
r AS (SELECT *, yes / n AS rate, row_number() OVER (ORDER BY yes / n DESC, grp) AS place FROM c)
SELECT arg_min(grp, place) AS top, arg_max(grp, place) AS bottom, floor((max(rate) - min(rate)) * 100 * 10 + 0.5) / 10 AS points, count(*) AS groups FROM r"""
)
def lead_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lead_and_spread(segments.cross_cut(_answers(spark, sf_dir), "source", F.col("good")), "group")


@query(
    """WITH t AS (SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1), n AS (SELECT type, n, row_number() OVER (ORDER BY n DESC, type) AS place FROM t),
b AS (SELECT list_sort(list(p_size)) AS v, count(*) AS m FROM part)
SELECT (SELECT type FROM n WHERE place = 1) AS top_noun, (SELECT n FROM n WHERE place = 1) AS top_count, v[least(m, floor(0.25 * m) + 1)::BIGINT] ::BIGINT AS low, v[least(m, floor(0.75 * m) + 1)::BIGINT]::BIGINT AS high FROM b"""
)
def playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest noun beside the band that half of the rows are in."""
    from ..operators import comparison, insights

    parts = table(spark, sf_dir, "part")
    top = insights.most_first(parts.groupBy(F.col("p_type").alias("top_noun")).agg(F.count("*").alias("top_count")), "top_count", "top_noun", 1)
    return top.crossJoin(comparison.quartiles(parts, "p_size").select(F.col("p25").cast("long").alias("low"), F.col("p75").cast("long").alias("high")))
