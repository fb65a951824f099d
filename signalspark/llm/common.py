"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Texts that are Python objects at once.
TEXTS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a table, dealt by ``key`` to all cores where fewer tasks than cores would have rows.

    A small table is often one file of one row group, which one task reads whole. A table of as
    many files as there are cores is taken as it is; of any other the tasks with rows are counted,
    which reads no column.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows.repartition(cores, key) if used < cores else rows


def text_column(text: Column, sql: str, work: Callable[[list[str | None]], pa.Array]) -> Column:
    """A column that ``work`` makes from ``text``, some hundred texts at a time.

    Spark sends texts in batches of thousands; only so many of them are Python objects at once.
    """

    @F.arrow_udf(sql)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [work(batch.slice(at, TEXTS).to_pylist()) for at in range(0, max(len(batch), 1), TEXTS)]
            yield pa.concat_arrays(parts)

    return run(text)


def read_spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name), key)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A session without that setting gets a temporary folder in local mode only; on a cluster
    executors could not see it, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that are written once and read again, so that no plan, and nothing
    that the optimiser knows of it, grows with the rounds. All of them go when the work is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, 0
        self.folder = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, *by: str) -> DataFrame:
        """``rows`` as a table; with columns ``by``, rows of a value of these are read without the others."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        rows.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that nothing refers to any more. It does so when
    the driver's references are collected, which by itself may be long after a step is over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys that more than one row in so many has are joined by a broadcast; there are fewer of them than this.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """Inner (or ``how="left"``) join of ``rows`` with ``keyed``, whose keys are unique and whose column ``n``, which is
    dropped, says how many of ``rows`` have each.

    A key of over a thousandth of all rows would be one long task; there are under a thousand
    such keys whatever the size, so these are broadcast, and the others are joined by a shuffle
    that the rows of hot keys don't take part in. Both inputs are read twice: they should be
    checkpointed or cheap.
    """
    total, most = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(1000, total // HOT_SHARE)
    rest = keyed.drop(n)
    if most <= least:
        return rows.join(rest, key, how)
    hot = F.broadcast(keyed.where(F.col(n) > least).drop(n))
    cold = keyed.where(F.col(n) <= least).drop(n)
    common = rows.join(hot, key)
    return common.unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key, how))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
