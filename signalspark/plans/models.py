"""Cross-sectional queries: positioning, prices, segments, medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..operators import insights, positioning, segments
from ..registry import query, table


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in p) + ")" for p in pairs)


_NOUNS = _values(T.forms(T.CATEGORY_NOUNS).items())
_WORDS = "list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda w: regexp_matches(w, '^[a-z]'))"
# The invented texts hold no category nouns; part names, types and segments of the star schema hold few.
# Every third row is given a label with one so that the query has something to find.
_LABEL_SQL = "labels_ AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'The agentic ' || lower(c_mktsegment) || ' platform and apps' WHEN 2 THEN c_mktsegment || ' TOOLS' ELSE c_name END AS label FROM customer)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    label = F.when(k == 1, F.concat(F.lit("The agentic "), F.lower("c_mktsegment"), F.lit(" platform and apps"))).when(k == 2, F.concat("c_mktsegment", F.lit(" TOOLS"))).when(k == 3, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), label.alias("label"))


@query(
    f"""WITH {_LABEL_SQL}, nouns(form, noun) AS (VALUES {_NOUNS}), placed AS (
  SELECT id, w, generate_subscripts(w, 1) AS i FROM (SELECT id, {_WORDS.format(t='label')} AS w FROM labels_ WHERE label IS NOT NULL)
), first AS (SELECT id, arg_min(noun, i) AS noun FROM placed JOIN nouns ON form = w[i] GROUP BY id)
SELECT noun, count(*) AS n FROM labels_ LEFT JOIN first ON labels_.id = first.id WHERE label IS NOT NULL GROUP BY noun"""
)
def category_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.category_groups(_labels(spark, sf_dir), "label")


@query(
    f"""WITH {_LABEL_SQL}, terms(form, family) AS (VALUES {_values((f, n) for n, fs in T.AI_TERMS.items() for f in fs)})
SELECT family, count(DISTINCT id) AS n FROM (SELECT id, unnest({_WORDS.format(t='label')}) AS w FROM labels_) JOIN terms ON form = w GROUP BY family"""
)
def ai_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.ai_mentions(_labels(spark, sf_dir), "label")


_PROOF_SQL = "proofs AS (SELECT c_custkey AS id, 'Trusted by ' || (c_custkey % 90 + 10) || ',000+ teams. ' || CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 50 + 10) || '% faster in under ' || (c_custkey % 9 + 1) || ' minutes. We cut cost by ' || (c_custkey % 40 + 5) || '%' WHEN 1 THEN 'G2 Leader, $' || (c_custkey % 7 + 1) || 'M saved' ELSE '10x faster. 10x faster' END AS proof FROM customer)"
def _claim_sql(i: int, kind: str, pattern: str, parts: tuple[str, str] | None) -> str:
    claim = "claim"
    if parts:
        claim = f"regexp_extract(claim, '(?i)({parts[1]})$', 1) || ' ' || regexp_replace(claim, '(?i)\\s+by\\s+(?:{parts[1]})$', '')"
    return f"SELECT id, {i} AS family, '{kind}' AS kind, {claim} AS claim FROM (SELECT id, unnest(regexp_extract_all(proof, '(?i){pattern}')) AS claim FROM proofs)"


_CLAIM_SQL = " UNION ALL ".join(_claim_sql(i, *c) for i, c in enumerate(positioning.CLAIMS))
_ONCE_SQL = f"""{_PROOF_SQL}, found AS ({_CLAIM_SQL}), once AS (
  SELECT id, rtrim(lower(trim(regexp_replace(claim, '\\s+', ' ', 'g'))), '.,;:!?') AS claim, arg_min(kind, family) AS kind FROM found GROUP BY ALL
)"""


@query(f"WITH {_ONCE_SQL} SELECT kind, count(DISTINCT id) AS n, count(*) AS claims FROM once WHERE length(claim) BETWEEN 4 AND 60 GROUP BY kind")
def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.claim_kinds(_proofs(spark, sf_dir), "proof")


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    tail = (
        F.when(k % 3 == 0, F.concat(text(k % 50 + 10), F.lit("% faster in under "), text(k % 9 + 1), F.lit(" minutes. We cut cost by "), text(k % 40 + 5), F.lit("%")))
        .when(k % 3 == 1, F.concat(F.lit("G2 Leader, $"), text(k % 7 + 1), F.lit("M saved")))
        .otherwise("10x faster. 10x faster")
    )
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("Trusted by "), text(k % 90 + 10), F.lit(",000+ teams. "), tail).alias("proof"))


@query(
    f"""WITH {_ONCE_SQL}, kept AS (SELECT * FROM once WHERE length(claim) BETWEEN 4 AND 60)
SELECT CASE kind WHEN 'percent-trailing' THEN 'percent' ELSE kind END AS kind, count(DISTINCT id) AS n, count(*) AS claims, (SELECT count(*) FROM kept) AS total_claims FROM kept GROUP BY 1"""
)
def proof_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.proof_claims(_proofs(spark, sf_dir), "proof")


@query(
    "WITH dim(bucket, low, high) AS (VALUES "
    + ", ".join(f"('{k}', {a}, {'1e300' if b is None else b})" for k, a, b in M.PRICE_BUCKETS)
    + ") SELECT bucket, count(l_orderkey) AS n FROM dim LEFT JOIN lineitem ON l_extendedprice / 1000 >= low AND l_extendedprice / 1000 < high GROUP BY bucket"
)
def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in thousands, so that all buckets are met; buckets without a price stay."""
    counted = table(spark, sf_dir, "lineitem").groupBy(M.bucket(F.col("l_extendedprice") / 1000).alias("bucket")).agg(F.count("*").alias("n"))
    dim = spark.createDataFrame([(k,) for k, _, _ in M.PRICE_BUCKETS], "bucket string")
    return dim.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS lower_median, list_sort(list(l_quantity))[least(count(*), floor(0.25 * count(*)) + 1)::BIGINT] AS p25, list_sort(list(l_quantity))[least(count(*), floor(0.5 * count(*)) + 1)::BIGINT] AS upper_median,
  median(l_quantity) AS true_median FROM lineitem GROUP BY l_returnflag"""
)
def three_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        M.lower_median("l_quantity").alias("lower_median"), M.upper_quantile("l_quantity", 0.25).alias("p25"), M.upper_quantile("l_quantity", 0.5).alias("upper_median"), M.true_median("l_quantity").alias("true_median")
    )


_ANSWER_SQL = "answers AS (SELECT d.source, d.lang, quality = 1 AS good, toxic = 1 AS toxic, CASE WHEN quality IS NOT NULL THEN d.n_chars > 1500 END AS long FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a label is unreadable: its answers are null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("source", "lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), F.when(F.col("quality").isNotNull(), F.col("n_chars") > 1500).alias("long"))


_CELL = "count(*) FILTER (WHERE {c}) AS yes, count(*) FILTER (WHERE NOT {c}) AS no, count(*) FILTER (WHERE {c} IS NULL) AS unreadable"
_CELLS_SQL = f"""WITH {_ANSWER_SQL}, counted AS (
  {' UNION ALL '.join(f"SELECT source AS grp, '{c}' AS cut, {_CELL.format(c=c)} FROM answers GROUP BY source" for c in ('good', 'toxic', 'long'))}
), cells AS (SELECT *, yes + no AS readable, CASE WHEN yes + no >= 6 THEN floor(yes * 1000 / (yes + no) + 0.5) / 10 END AS share FROM counted)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return segments.cells(rows, "source", {c: F.col(c) for c in ("good", "toxic", "long")}, rows)


@query(f'{_CELLS_SQL} SELECT grp AS "group", cut, yes, no, unreadable, readable, share FROM cells')
def segment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(
    f"""{_CELLS_SQL}, drawn AS (SELECT * FROM cells WHERE readable >= 6), ends AS (
  SELECT a.cut, a.grp AS top, b.grp AS bottom, a.yes AS ya, a.readable AS na, b.yes AS yb, b.readable AS nb,
    row_number() OVER (PARTITION BY a.cut ORDER BY a.yes::DECIMAL(18,9) / a.readable DESC, a.grp, b.yes::DECIMAL(18,9) / b.readable, b.grp DESC) AS k, (SELECT count(*) FROM drawn d WHERE d.cut = a.cut) AS drawable
  FROM drawn a JOIN drawn b ON a.cut = b.cut
), flips AS (SELECT *, CASE WHEN ya * nb <= yb * na THEN 0 ELSE (ya * nb - yb * na + na - 1) // na END AS flips FROM ends WHERE k = 1)
SELECT cut, drawable, top, bottom, CAST(flips AS BIGINT) AS flips, CASE WHEN drawable < 8 THEN 'coverage' WHEN flips <= 2 THEN 'flat' END AS withheld FROM flips"""
)
def segment_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fragility(_cells(spark, sf_dir))


@query(
    f"""WITH {_ANSWER_SQL}, counted AS (SELECT source AS grp, count(good) AS n, count(*) FILTER (WHERE good) AS yes FROM answers GROUP BY source)
SELECT grp AS "group", n, yes, n < 6 AS suppressed, CASE WHEN n > 0 THEN yes / n END AS rate, row_number() OVER (ORDER BY n < 6, CASE WHEN n > 0 THEN yes / n END DESC NULLS LAST, grp) AS place FROM counted"""
)
def three_valued_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.cross_cut(_answers(spark, sf_dir), "source", F.col("good"))


@query(
    """WITH g AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 10 GROUP BY p_brand), k AS (SELECT p_brand FROM g WHERE n >= 4 ORDER BY n DESC, p_brand LIMIT 12)
SELECT g.p_brand, n, k.p_brand IS NOT NULL AS kept FROM g LEFT JOIN k ON g.p_brand = k.p_brand"""
)
def dense_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.dense(table(spark, sf_dir, "part").where("p_size < 10").groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")


@query(
    """WITH c AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN ' ' ELSE c_mktsegment END AS s FROM customer)
SELECT coalesce(nullif(trim(s), ''), '__none') AS "group", count(*) AS n, floor(count(*) * 1000 / (SELECT count(*) FROM c) + 0.5) / 10 AS share FROM c GROUP BY 1"""
)
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    return segments.composition(table(spark, sf_dir, "customer").select(F.when(k == 1, " ").when(k > 1, F.col("c_mktsegment")).alias("s")), "s")


@query(
    """WITH s AS (SELECT DISTINCT c_nationkey AS o, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS spelling FROM customer),
v AS (SELECT lower(spelling) AS key, spelling, count(*) AS votes FROM s GROUP BY ALL)
SELECT v.key, (SELECT count(DISTINCT o) FROM s WHERE lower(s.spelling) = v.key) AS n, arg_min(spelling, (-votes, spelling)) AS spelling FROM v GROUP BY v.key"""
)
def modal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return positioning.modal_spelling(table(spark, sf_dir, "customer").select("c_nationkey", name.alias("name")), "c_nationkey", "name")


@query("SELECT a.p_partkey, least(1.0, levenshtein(a.p_name, b.p_name) / least(greatest(length(a.p_name), length(b.p_name), 1), 200)) AS magnitude FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def text_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("after"))
    return part.join(after, "p_partkey").select("p_partkey", T.text_magnitude(F.col("p_name"), F.col("after")).alias("magnitude"))
