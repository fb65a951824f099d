"""What is published and what is kept: JSON documents, slim projections, and the ledger of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streaming.detect import read_log, write_batch

#: A document is for people to read; a table of more rows is written as lines of JSON instead.
MOST_ROWS = 20_000


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file through the session's file system, replacing any of that name whole."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    part = jvm.org.apache.hadoop.fs.Path(str(target.toString()) + ".writing")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    # one step that replaces: a crash leaves the old document or the new one
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(part, target, how)


def document(rows: DataFrame, order: list[str]) -> list[dict]:
    """Rows as plain dicts in a fixed order; at most ``MOST_ROWS``, which are counted by the same job."""
    got = rows.orderBy(*order).limit(MOST_ROWS + 1).toJSON().collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a document has at most {MOST_ROWS} rows; write lines instead")
    return [json.loads(r) for r in got]


def pretty(value) -> str:
    """JSON that is the same byte by byte for the same value: keys sorted, two spaces, one line end."""
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def write_documents(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> list[str]:
    """One JSON document for each named table, rows in the given order; the paths written."""
    paths = []
    for name, (rows, order) in sorted(tables.items()):
        path = f"{folder}/{name}.json"
        _write_text(spark, path, pretty(document(rows, order)))
        paths.append(path)
    return paths


def write_lines(rows: DataFrame, folder: str, by: str) -> None:
    """Lines of JSON, a folder for each value of ``by``, whatever the size; rows are dealt by it first."""
    rows.repartition(by).sortWithinPartitions(by).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(by).json(folder)


def slim(rows: DataFrame, drop: list[str]) -> DataFrame:
    """Rows without the columns that repeat on every page, dotted names being fields of structs."""
    for name in drop:
        outer, _, inner = name.partition(".")
        if not inner:
            rows = rows.drop(outer)
        elif outer in rows.columns:
            rows = rows.withColumn(outer, F.col(outer).dropFields(inner))
    return rows


def append_run(run: DataFrame, log_path: str) -> int:
    """Append one run's receipt, also of a run that read nothing; a run whose id is there is an error."""
    known = read_log(run.sparkSession, log_path)
    if known is not None and not known.join(run.select("run"), "run", "left_semi").isEmpty():
        raise ValueError("this run is in the ledger already")
    return write_batch(run, log_path)


def append_observations(observed: DataFrame, log_path: str, keys: list[str], order: str, ignored: tuple[str, ...] = ()) -> int:
    """Append those observations whose content differs from the last one of the same page; how many.

    The content is all but the keys, the order and ``ignored`` columns (times), and signals that
    never had a value count as not there, however often they were looked for.
    """
    rest = [c for c in observed.columns if c not in (*keys, order, *ignored)]
    known = read_log(observed.sparkSession, log_path)

    def content(frame: DataFrame):
        parts = [F.map_filter(c, lambda _, v: v.isNotNull()) if frame.schema[c].dataType.typeName() == "map" else F.col(c) for c in rest]
        entries = [F.array_sort(F.map_entries(p)) if frame.schema[c].dataType.typeName() == "map" else p for c, p in zip(rest, parts, strict=True)]
        return F.sha2(F.to_json(F.struct(*(e.alias(c) for e, c in zip(entries, rest, strict=True))), {"ignoreNullFields": "false"}), 256)

    new = observed.withColumn("__f", content(observed))
    if known is None:
        before = new.select(*keys, F.lit(None).cast("string").alias("__before")).limit(0)
    else:
        before = known.select(*keys, order, content(known).alias("f")).groupBy(*keys).agg(F.max_by("f", order).alias("__before"))
    # within the batch each row is held against the one before it, the first against the log
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    held = new.join(before, keys, "left").withColumn("__last", F.coalesce(F.lag("__f").over(w), "__before"))
    return write_batch(held.where(~F.col("__f").eqNullSafe(F.col("__last"))).select(observed.columns), log_path)
