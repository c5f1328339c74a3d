"""Tables that a job writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where that is unset, as in tests on one machine, a new local folder is
    taken once for each session and set, so that ``checkpoint()`` uses it too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tiegrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: what follows reads files that outlive any executor, and
    an expensive step before several consumers runs once.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that ``join_on_hot_keys`` may send to every executor, and the rows from which a key is hot.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_on_hot_keys(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each key and says in ``count`` how many rows the key has.

    The HOT_KEYS most frequent keys, of those with over HOT_ROWS rows, are
    looked up first and broadcast, so their rows stay where they are; no other
    key can hold more than one part in HOT_KEYS of all rows, and these are
    shuffled. Without hot keys it is a plain join.
    """
    hot = keyed.filter(F.col(count) > HOT_ROWS).orderBy(F.desc(count), key).limit(HOT_KEYS).collect()
    if not hot:
        return rows.join(keyed, key)
    table = rows.sparkSession.createDataFrame(hot, keyed.schema)
    is_hot = F.col(key).isin([r[key] for r in hot])
    here = rows.filter(is_hot).join(F.broadcast(table), key)
    there = rows.filter(~is_hot).join(keyed.filter(~is_hot), key)
    return here.unionByName(there)


def running_sums(df: DataFrame, value: str, sums: list[str], descending: bool = False, pieces: int = 256) -> DataFrame:
    """Adds ``upto_<c>`` for each c of ``sums``: its sum over all rows up to and with the same ``value``, from the least or the largest one on.

    Rows are cut at quantiles of the value into ``pieces`` that are summed each
    for itself; only the pieces' totals are ordered in one place.
    """
    cuts = df.agg(F.percentile_approx(value, F.array(*(F.lit(k / pieces) for k in range(1, pieces))), F.lit(10_000)).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    way = -1 if descending else 1
    order = F.desc(value) if descending else F.asc(value)
    totals = placed.groupBy("_piece").agg(*(F.sum(c).alias("_t_" + c) for c in sums))
    before = Window.orderBy(F.col("_piece") * way).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as pieces
    starts = totals.select("_piece", *(F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_b_" + c) for c in sums))
    inside = Window.partitionBy("_piece").orderBy(order)
    found = placed.select("*", *(F.sum(c).over(inside).alias("_s_" + c) for c in sums)).join(F.broadcast(starts), "_piece")
    return found.select(*df.columns, *((F.col("_b_" + c) + F.col("_s_" + c)).alias("upto_" + c) for c in sums))


def exact_percentiles(rows: DataFrame, group: str, value: str, shares: list[float], pieces: int = 256) -> DataFrame:
    """(group, n, p0, p1, ...): the interpolated percentiles of each group's values, as ``percentile`` gives them, for few groups of very many values.

    Each group is cut at approximate quantiles into ``pieces``. Their counts
    tell which ones hold the ranks that are asked for, and only the distinct
    values of those are ordered, so no task holds a group's values. Missing
    values don't count; ``rows`` are read three times.
    """
    rows = rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    cuts = rows.groupBy(group).agg(F.percentile_approx(value, F.array(*(F.lit(k / pieces) for k in range(1, pieces))), F.lit(10_000)).alias("_cuts"))
    placed = rows.join(F.broadcast(materialize(cuts, "percentile-cuts")), group).select(group, value, F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_piece"))
    counts = materialize(placed.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_c")), "percentile-counts")
    whole = Window.partitionBy(group)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as pieces
    at = lambda n: [F.lit(s) * (n - 1) for s in shares]
    sized = counts.withColumns({"n": F.sum("_c").over(whole), "_before": F.coalesce(F.sum("_c").over(before), F.lit(0))})
    ranks = F.array(*(f(p).cast("bigint") for p in at(F.col("n")) for f in (F.floor, F.ceil)))
    sized = sized.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).filter(F.size("_ranks") > 0)
    asked = placed.join(F.broadcast(sized), [group, "_piece"]).groupBy(group, "_piece", value).agg(F.count(F.lit(1)).alias("_m"), F.first("n").alias("n"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    upto = F.sum("_m").over(Window.partitionBy(group, "_piece").orderBy(value)) + F.col("_before")
    hit = asked.withColumn("_upto", upto).withColumn("_r", F.explode(F.array_distinct("_ranks"))).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_m")))
    found = hit.groupBy(group).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_v"))  # two for each share

    def between(p):
        low, high = F.floor(p).cast("bigint"), F.ceil(p).cast("bigint")
        v = lambda r: F.element_at("_v", r)
        return F.when(low == high, v(low)).otherwise((high - p) * v(low) + (p - low) * v(high))

    return found.select(group, "n", *(between(p).alias(f"p{k}") for k, p in enumerate(at(F.col("n")))))


def drop_work_tables(spark: SparkSession) -> None:
    """Delete every table that this application's jobs have written to the shared folder.

    Results that were read from them can't be computed again afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tiegrid-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
