"""Session defaults, table access and the few helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than 1/HOT_SHARE of the rows (and HOT_FLOOR rows), or more than TASK_ROWS, count as hot. So no task
#: gets more than TASK_ROWS rows of a key, and a table of n rows has at most HOT_SHARE + n/TASK_ROWS hot keys.
HOT_SHARE = 2000
HOT_FLOOR = 20_000
TASK_ROWS = 5_000_000
#: Tasks that a hot key is spread over at least.
SALTS = 32


def build_session(master: str = "local[*]", app: str = "lodeseam", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.unionOutputPartitioning": "false",
    }
    if master.startswith("local["):
        defaults["spark.sql.shuffle.partitions"] = "8"  # a cluster sets its own
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def guard_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of two readings of one plan as still partitioned like them, and together with
    reused exchanges gives wrong rows (a window over a split group; measured, see README). Switched off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    guard_unions(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only where it is unset and all runs in one process (tests) set one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodeseam-checkpoint-"))


def cut_lineage(df: DataFrame, looped: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives lost executors.

    A checkpoint keeps Spark's estimate of its size, which joins multiply: in a loop its digits double per round, and
    planning soon takes all the time (measured). ``looped`` forgets the estimate, and what is inferred of the columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    if not looped:
        return kept
    j = kept._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(j.queryExecution().toRdd(), j.schema(), False), spark)


class HotKeys(list):
    """The hot keys, and over how many tasks each is to be spread."""

    salts: dict


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> list:
    """The keys that hold an unusual share of ``df``, or more rows than a task should; only these reach the driver."""
    hot = HotKeys()
    hot.salts = {}
    if rows is not None and rows < HOT_FLOOR:
        return hot
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    if rows is None:
        rows = df.count()
    limit = max(HOT_FLOOR, min(rows // HOT_SHARE, TASK_ROWS))
    for r in counts.where(F.col("n") > limit).collect():
        hot.append(r[0])
        # powers of two, so that there are few kinds
        hot.salts[r[0]] = max(SALTS, 1 << (r["n"] // TASK_ROWS).bit_length())
    return hot


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: str, hot: list, how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` (unique per ``key``); rows of the hot keys are spread over several tasks.

    ``spread`` is a column of ``left`` whose hash chooses the salt, so that a retried task repeats it.
    """
    if not hot:
        return left.join(right, key, how)
    kinds: dict[int, list] = {}
    for k in hot:
        kinds.setdefault(getattr(hot, "salts", {}).get(k, SALTS), []).append(k)
    salts = F.lit(1)
    for n, keys in kinds.items():
        salts = F.when(F.col(key).isin(keys), F.lit(n)).otherwise(salts)
    l = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), salts).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return l.join(r, [key, "_salt"], how).drop("_salt")
