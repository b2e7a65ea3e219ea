"""Where to cut lineage, and connected components in rounds."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, an own one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/drawlake-{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Deletes what ``stored`` has written in this application; for when its results are written or no longer wanted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: short lineage, small statistics. It stays there until ``clear_stored``."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (id, comp), comp the smallest id reachable, for every id that an edge names.

    Rounds of hooking to the smallest neighbour, two pointer jumps and contraction of the edges: each
    round shrinks the edge list, so hubs and long chains need few rounds. No key's rows meet in one task
    but through a combinable minimum or a join that adaptive execution may split.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    live = checkpointed(live)
    labels = None
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        for _ in range(2):
            up = hook.select(F.col("id").alias("to"), F.col("to").alias("up"))
            hook = checkpointed(hook.join(up, "to").select("id", F.col("up").alias("to")))
        if labels is None:
            labels = hook.withColumnRenamed("to", "comp")
        else:
            labels = labels.join(hook, labels["comp"] == hook["id"], "left").select(labels["id"], F.coalesce("to", "comp").alias("comp"))
        labels = checkpointed(labels)
        ha, hb = (hook.select(F.col("id").alias(k), F.col("to").alias(f"to_{k}")) for k in ("a", "b"))
        live = checkpointed(live.join(ha, "a").join(hb, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct())
    if labels is None:
        labels = live.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return labels


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in the order of all, from 1. Ranges deal the rows, and each range's count sets
    off the next, so that no task sees them all; null values come first."""
    part, place, before = "_part", "_place", "_before"
    rows = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))  # a row a range
    offsets = sizes.withColumn(before, F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).select(part, F.coalesce(before, F.lit(0)).alias(before))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(offsets), part)
    return rows.withColumn(name, F.col(place) + F.col(before)).drop(part, place, before)


#: Rows of a part that one task groups or sorts: some 50 MB in each of its steps.
PART = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows dealt by keys in parts that don't grow with it: their number does."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / PART)), *keys)


#: Distinct texts, and their characters in all, up to which a table of them goes to every task.
FEW, SHORT = 100_000, 8_000_000
#: Parts that a text's rows are dealt to where there are more.
SALTS = 8


def once(df: DataFrame, text: str, nulls: bool = False, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out of one text column, for each distinct text once; rows without a text fall away, unless ``nulls``.

    The distinct texts are written and counted first. Few ones go to the rows, so that no row is dealt by its text, of which
    a few may have most rows; of many ones each is dealt in SALTS parts.
    """
    texts = df.select(text).distinct() if nulls else df.where(F.col(text).isNotNull()).select(text).distinct()
    parsed = stored(texts.select(F.col(text).alias("_once"), *(c.alias(k) for k, c in columns.items())), "once")
    n, size = parsed.agg(F.count("*"), F.coalesce(F.sum(F.length("_once")), F.lit(0))).first()
    same = F.col(text).eqNullSafe(F.col("_once")) if nulls else F.col(text) == F.col("_once")
    if n <= FEW and size <= SHORT:
        return df.join(F.broadcast(parsed), same).drop("_once")
    rest = [F.col(c) for c in df.columns if c != text]
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int") if rest else F.lit(0))
    each = parsed.withColumn("_part", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return dealt.join(each.hint("merge"), same & (F.col("_salt") == F.col("_part"))).drop("_once", "_salt", "_part")
