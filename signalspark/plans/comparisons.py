"""Queries that hold a page, a section or a group against the others, in numbers and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparisons, segments, sequences, structure
from ..registry import query, table
from .insights import page_signals_of, SIGNALS_SQL
from .structure import _turns


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.company_strips(_turns(spark, sf_dir), "conv_id", "turn", "role", "size")


def _share(n: str, of: str) -> str:
    return f"floor({n} * 100 / {of} + 0.5)::BIGINT || '% (' || format('{{:,}}', {n}::BIGINT) || ' of ' || format('{{:,}}', {of}::BIGINT) || ')'"


def _num(n: str) -> str:
    return f"format('{{:,}}', ({n})::BIGINT)"


def _ordinal(n: str) -> str:
    return f"({n}) || CASE WHEN ({n}) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN ({n}) % 10 = 1 THEN 'st' WHEN ({n}) % 10 = 2 THEN 'nd' WHEN ({n}) % 10 = 3 THEN 'rd' ELSE 'th' END"


_MID = "list_sort(list({v}))[least(count({v}), floor(0.5 * count({v})) + 1)::BIGINT]"


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations), own AS (SELECT conv_id, count(*) AS sections, {_MID.format(v='size')} AS mid FROM t GROUP BY conv_id),
a AS (SELECT count(*) AS n, {_MID.format(v='size')} AS mid FROM t), l AS (SELECT count(*) AS pages, {_MID.format(v='sections')} AS usual FROM own),
s0 AS (SELECT turn, role, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY turn)::BIGINT AS tot, row_number() OVER (PARTITION BY turn ORDER BY n DESC, role) AS rank, count(*) OVER (PARTITION BY turn) AS types, max(n) OVER (PARTITION BY turn) AS lead FROM s0),
b AS (SELECT turn, any_value(lead) AS lead, count(*) FILTER (WHERE n = lead) AS leaders, min_by(role, rank) AS top FROM s GROUP BY turn), c AS (SELECT role, count(DISTINCT conv_id) AS carry FROM t GROUP BY role),
j AS (SELECT t.*, sections, own.mid, a.n AS every, a.mid AS middle, pages, usual, s.n, s.tot, s.rank, s.types, b.lead, leaders, top, carry FROM t JOIN own ON t.conv_id = own.conv_id JOIN s ON s.turn = t.turn AND s.role = t.role JOIN b ON b.turn = t.turn JOIN c ON c.role = t.role, a, l)
SELECT conv_id, turn, 'words' AS key, 'measured' AS kind, size::DOUBLE AS n, sections AS "of", {_num('size')} || ' words; the middle one of this page''s ' || {_num('sections')} || ' sections has ' || {_num('mid')} || ', of all ' || {_num('every')} || ' ' || {_num('middle')} AS text FROM j
UNION ALL SELECT conv_id, turn, 'place', 'measured', turn + 1, sections, 'section ' || {_num('turn + 1')} || ' of ' || {_num('sections')} || '; the middle one of ' || {_num('pages')} || ' pages has ' || {_num('usual')} FROM j
UNION ALL SELECT conv_id, turn, 'slot', 'judged', lead, tot, CASE WHEN leaders = 1 THEN {_share('lead', 'tot')} || ' have ' || top || ' here' ELSE {_num('leaders')} || ' types lead here, on ' || {_share('lead', 'tot')} || ' each' END FROM j
UNION ALL SELECT conv_id, turn, 'same', 'judged', n, tot, {_share('n', 'tot')} || ' have ' || role || ' here' || CASE WHEN types > 1 THEN ', the ' || {_ordinal('rank')} || ' of ' || {_num('types')} || ' types' ELSE '' END FROM j
UNION ALL SELECT conv_id, turn, 'anywhere', 'judged', carry, pages, {_share('carry', 'pages')} || ' carry ' || role || ' somewhere' FROM j"""
)
def section_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn against all others: facts as rows."""
    found = comparisons.section_comparisons(_turns(spark, sf_dir), "conv_id", "turn", "role", "size")
    return found.select("conv_id", "turn", F.explode("facts").alias("f")).select("conv_id", "turn", "f.*")


_STRIPS_SQL = "s AS (SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS q, count(*) AS sections, sum(length(text))::DOUBLE AS words, count(DISTINCT role) AS kinds FROM conversations GROUP BY conv_id)"


@query(
    f"""WITH {_STRIPS_SQL}, m AS (SELECT conv_id, 'sections' AS key, sections::DOUBLE AS value FROM s UNION ALL SELECT conv_id, 'words', words FROM s UNION ALL SELECT conv_id, 'words_a_section', floor(words / sections * 10 + 0.5) / 10 FROM s UNION ALL SELECT conv_id, 'kinds', kinds FROM s),
l AS (SELECT key, list_sort(list(value)) AS v, count(*) AS n FROM m GROUP BY key), b AS (SELECT key, n, v[1] AS least, v[least(n, floor(0.25 * n) + 1)::BIGINT] AS p25, v[least(n, floor(0.5 * n) + 1)::BIGINT] AS mid, v[least(n, floor(0.75 * n) + 1)::BIGINT] AS p75, v[n] AS greatest FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY value DESC) AS place, count(*) OVER (PARTITION BY key, value) - 1 AS ties FROM m)
SELECT conv_id, r.key, value, place, ties, n AS "of", CASE WHEN b.least = b.greatest THEN 'flat' WHEN value <= p25 THEN 'low' WHEN value < mid THEN 'below' WHEN value = mid THEN 'middle' WHEN value <= p75 THEN 'above' ELSE 'high' END AS band,
  regexp_replace(value::VARCHAR, '\\.0$', '') || ', the ' || {_ordinal('place')} || ' of ' || {_num('n')} || CASE WHEN ties > 0 THEN ', with ' || {_num('ties')} || ' others' ELSE '' END AS text FROM r JOIN b ON r.key = b.key"""
)
def page_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against all others by each measure of a page."""
    return comparisons.page_comparisons(_strips(spark, sf_dir), "conv_id")


@query(
    f"""WITH {_STRIPS_SQL}, n AS (SELECT q, count(*) AS same FROM s GROUP BY q), t AS (SELECT count(*) AS total FROM s)
SELECT conv_id, s.q AS sequence, same, total AS "of", CASE WHEN same > 1 THEN {_share('same', 'total')} || ' run this sequence' ELSE 'no other page runs this sequence' END AS text FROM s JOIN n ON s.q = n.q, t"""
)
def sequence_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparisons.sequence_comparisons(_strips(spark, sf_dir), "conv_id")


@query(
    """WITH r(role) AS (VALUES ('system'), ('user'), ('assistant'), ('tool')), p AS (SELECT DISTINCT conv_id FROM conversations), h AS (SELECT DISTINCT conv_id, role FROM conversations)
SELECT p.conv_id, r.role, h.role IS NOT NULL AS carried, (SELECT count(*) FROM h x WHERE x.role = r.role) AS n, (SELECT count(*) FROM p) AS "of" FROM p CROSS JOIN r LEFT JOIN h ON h.conv_id = p.conv_id AND h.role = r.role"""
)
def carried_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparisons.carried_and_missing(_turns(spark, sf_dir), "conv_id", "role", ["system", "user", "assistant", "tool"])


@query(
    f"""WITH x AS (SELECT count(*) AS m, count(*) FILTER (WHERE p = t) AS c, count(*) FILTER (WHERE t <> 'good') AS rm, count(*) FILTER (WHERE t <> 'good' AND p = t) AS rc
FROM (SELECT CASE WHEN regexp_matches(text, '[#$%&|]') THEN 'bad' ELSE 'good' END AS p, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t FROM documents JOIN labels ON documents.doc_id = labels.doc_id))
SELECT 'Types of sections are judged, not read. Held against labels, ' || {_share('rc', 'rm')} || ' were right where the answer isn''t plain, and ' || {_share('c', 'm')} || ' in all. Counts are measured and need no such word.' AS caveat FROM x"""
)
def classifier_caveat(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike("[#$%&|]"), "bad").otherwise("good").alias("label"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return comparisons.classifier_caveat(structure.accuracy_block(sequences.scored(predicted, truth, ["doc_id"], "label", "good"))).select("caveat")


_ANSWERS_SQL = f"{SIGNALS_SQL}, a AS (SELECT segment, name, headline IS NOT NULL AS headed, CASE WHEN headline IS NOT NULL THEN subhead IS NOT NULL END AS seconded, CASE WHEN subhead IS NOT NULL THEN suspect > 0 END AS doubted FROM signals)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, sub = F.col("headline").isNotNull(), F.col("subhead").isNotNull()
    return page_signals_of(spark, sf_dir).select("segment", "name", head.alias("headed"), F.when(head, sub).alias("seconded"), F.when(sub, F.col("suspect") > 0).alias("doubted"))


@query(
    f"""WITH {_ANSWERS_SQL}, long AS (SELECT segment, 'headed' AS cut, headed AS x FROM a UNION ALL SELECT segment, 'seconded', seconded FROM a UNION ALL SELECT segment, 'doubted', doubted FROM a),
cell AS (SELECT segment AS g, cut, count(*) FILTER (WHERE x) AS yes, count(x) AS n FROM long WHERE segment IS NOT NULL GROUP BY ALL), d AS (SELECT *, yes::DECIMAL(18,0) / n AS rate FROM cell WHERE n >= 6),
e AS (SELECT cut, count(*) AS drawable, arg_min(struct_pack(g, yes, n), struct_pack(r := -rate, g := g)) AS top, arg_max(struct_pack(g, yes, n), struct_pack(r := -rate, g := g)) AS bottom FROM d GROUP BY cut),
f AS (SELECT cut, drawable, top.g AS top, bottom.g AS bottom, CASE WHEN top.yes * bottom.n - bottom.yes * top.n <= 0 THEN 0 ELSE ceil((top.yes * bottom.n - bottom.yes * top.n) / top.n)::BIGINT END AS flips FROM e),
w AS (SELECT *, CASE WHEN drawable < 4 THEN 'coverage' WHEN flips <= 2 THEN 'flat' END AS withheld FROM f), o AS (SELECT cut, sum(yes)::BIGINT AS yes, sum(n)::BIGINT AS readable, count(*) AS groups FROM cell GROUP BY cut)
SELECT w.cut, CASE WHEN withheld IS NOT NULL THEN 'withheld' WHEN row_number() OVER z = 1 THEN 'lead' ELSE 'rest' END AS role, row_number() OVER z AS place,
  CASE WHEN withheld IS NULL THEN top || ' and ' || bottom || ' are ' || flips || ' answers apart' WHEN withheld = 'flat' THEN 'the best and the worst group are ' || flips || ' answers apart'
  ELSE 'only ' || drawable || ' of ' || groups || ' groups have enough answers' || CASE WHEN readable > 0 AND (yes * 10 >= readable * 9 OR yes * 10 <= readable) THEN '; of all ' || readable || ' answers ' || yes || ' are yes' ELSE '' END END AS text
FROM w JOIN o ON w.cut = o.cut WINDOW z AS (ORDER BY (withheld IS NULL) DESC, (w.cut = 'seconded') DESC, w.cut)"""
)
def segment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cuts of the documents' sources hold, which leads, and why the others are withheld."""
    cells = segments.cells(_answers(spark, sf_dir), "segment", {c: F.col(c) for c in ("headed", "seconded", "doubted")})
    return comparisons.segment_view(cells, segments.fragility(cells, least_groups=4), "seconded")


@query(f"WITH {_ANSWERS_SQL}, y AS (SELECT segment, name, row_number() OVER (PARTITION BY segment ORDER BY name) AS k FROM a WHERE seconded AND segment IS NOT NULL) SELECT segment AS \"group\", count(*) AS yes, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 8) AS names FROM y GROUP BY segment")
def yes_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparisons.yes_names(_answers(spark, sf_dir), "segment", F.col("seconded"), "name")


@query(
    f"""WITH g AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source), x AS (SELECT count(*) AS groups, sum(n)::BIGINT AS total, max(n) AS members FROM g), y AS (SELECT s AS largest FROM g ORDER BY n DESC, s LIMIT 1)
SELECT groups, total, largest, members, {_num('groups')} || ' groups of ' || {_num('total')} || ' companies; the largest is ' || largest || ' with ' || {_num('members')} AS text FROM x, y"""
)
def composition_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return comparisons.composition_headline(groups, "source", "n")


@query(
    f"""WITH r AS (SELECT value, event_type <> 'error' AS ok, user_id FROM events), g AS (SELECT list_sort(list(value)) AS v, count(*) AS n, sum(user_id % 5)::BIGINT AS found, sum(5)::BIGINT AS expected, max(user_id) AS largest FROM r WHERE ok)
SELECT n, v[least(n, floor(0.5 * n) + 1)::BIGINT] AS p50, v[least(n, floor(0.95 * n) + 1)::BIGINT] AS p95, v[n] AS most, found, expected, largest, (SELECT count(*) FROM r) AS pages,
  {_num('n')} || ' of ' || {_num('(SELECT count(*) FROM r)')} || ' pages read; signals ' || {_share('found', 'expected')} AS text FROM g"""
)
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trial run: their value is the time it took."""
    rows = table(spark, sf_dir, "events").select("value", "event_type", "user_id", (F.col("user_id") % 5).alias("found"), F.lit(5).alias("expected"))
    return comparisons.probe_summary(rows, F.col("event_type") != "error", "value", "user_id", "found", "expected")
