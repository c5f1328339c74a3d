"""Job and event streams, each with a batch twin that gives the same rows.

Twins take a whole table of events (job_id, event_id, ts, line, is_failure,
is_success); streaming versions keep state for each job in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegrid.operators.catalog import BOUNDS
from tiegrid.plans.work import materialize

#: Stage markers in log lines, their names and percentages: fixed values.
STAGES = (
    ("Stage 1/7", "discover", 8.0), ("Stage 2/7", "parse", 20.0), ("Stage 3/7", "match", 33.0), ("Stage 4/7", "crop", 55.0), ("Stage 5/7", "register", 72.0),
    ("Stage 6/7", "manifest", 86.0), ("Stage 7/7", "summary", 95.0), ("Stage 1/6", "discover", 10.0), ("Stage 2/6", "parse", 25.0), ("Stage 3/6", "match", 40.0),
    ("Stage 4/6", "crop", 65.0), ("Stage 5/6", "manifest", 85.0), ("Stage 6/6", "summary", 95.0), ("cross-sensor matching", "matching", 68.0), ("registration QA", "qa", 76.0),
)


def stage_of(line: Column) -> Column:
    """struct<stage, percent> of the first marker that a line holds; NULL without one."""
    found = F.lit(None).cast("struct<stage:string,percent:double>")
    for marker, stage, percent in reversed(STAGES):
        found = F.when(line.contains(marker), F.struct(F.lit(stage).alias("stage"), F.lit(percent).alias("percent"))).otherwise(found)
    return found


def job_progress(events: DataFrame) -> DataFrame:
    """(job_id, stage, percent): the latest marked stage of each job. Runs on a stream as well, in update mode."""
    marked = events.select("job_id", F.struct("ts", "event_id").alias("at"), stage_of(F.col("line")).alias("s")).filter(F.col("s").isNotNull())
    return marked.groupBy("job_id").agg(F.max_by("s", "at").alias("s")).select("job_id", "s.stage", "s.percent")


def log_ring(events: DataFrame, cap: int = 200) -> DataFrame:
    """(job_id, n, event_id, line): the last ``cap`` lines of each job with their numbers from 1; the batch twin."""
    order = [F.col("ts"), F.col("event_id")]
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy("job_id"))
    return events.select("job_id", n.alias("n"), "event_id", "line", total.alias("total")).filter(F.col("n") > F.col("total") - cap).drop("total")


def logs_after(ring: DataFrame, job_id: int, n: int) -> DataFrame:
    """Lines of one job after its n-th."""
    return ring.filter((F.col("job_id") == job_id) & (F.col("n") > n)).orderBy("n")


def log_ring_stream(events: DataFrame, cap: int = 200) -> DataFrame:
    """Streaming rings: after each batch the ring of every job that got lines, as (job_id, n, event_id, line)."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Ring(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.lines = handle.getListState("lines", "event_id bigint, line string")
            self.total = handle.getValueState("total", "n bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            kept = list(self.lines.get()) if self.lines.exists() else []
            total = self.total.get()[0] if self.total.exists() else 0
            new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            kept = (kept + list(zip(new["event_id"].tolist(), new["line"].tolist(), strict=True)))[-cap:]
            total += len(new)
            self.lines.put(kept)
            self.total.update((total,))
            yield pd.DataFrame({"job_id": key[0], "n": range(total - len(kept) + 1, total + 1), "event_id": [k[0] for k in kept], "line": [k[1] for k in kept]})

        def close(self) -> None:
            pass

    return events.select("job_id", "event_id", "ts", "line").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Ring(), outputStructType="job_id bigint, n bigint, event_id bigint, line string", outputMode="Update", timeMode="None"
    )


def job_state(events: DataFrame, fields: list[str], ttl: str, now: Column) -> DataFrame:
    """(job_id, updated, fields): the last known value of each field; jobs not updated within ``ttl`` before ``now`` are gone."""
    at = F.struct("ts", "event_id")
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return events.groupBy("job_id").agg(F.max("ts").alias("updated"), *latest).filter(F.col("updated") >= now - F.expr(f"INTERVAL {ttl}"))


def job_state_stream(events: DataFrame, fields: list[str], ttl_ms: int) -> DataFrame:
    """Streaming job state: after each batch (job_id, updated, fields) of every job that got events; fields are strings.

    A job's state expires ``ttl_ms`` of processing time after its last event.
    Events older than the job's latest don't take back what is known.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    schema = ", ".join(f"{f} string, {f}_at timestamp, {f}_event bigint" for f in fields)

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("known", f"updated timestamp, {schema}", ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            old = self.known.get() if self.known.exists() else None
            updated = old[0] if old else None
            values = {f: tuple(old[1 + 3 * k : 4 + 3 * k]) if old else (None, None, None) for k, f in enumerate(fields)}
            for row in pd.concat(list(rows)).itertuples():
                at = row.ts.to_pydatetime()
                updated = at if updated is None or at > updated else updated
                for f in fields:
                    value = getattr(row, f)
                    if isinstance(value, str) and (values[f][1] is None or (at, row.event_id) >= values[f][1:]):
                        values[f] = (value, at, row.event_id)
            self.known.update((updated, *(v for f in fields for v in values[f])))
            yield pd.DataFrame({"job_id": [key[0]], "updated": [updated], **{f: [values[f][0]] for f in fields}})

        def close(self) -> None:
            pass

    return events.select("job_id", "event_id", "ts", *(F.col(f).cast("string").alias(f) for f in fields)).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Latest(), outputStructType="job_id bigint, updated timestamp, " + ", ".join(f"{f} string" for f in fields), outputMode="Update", timeMode="ProcessingTime"
    )


def failure_lockout(events: DataFrame, most: int = 5, window_s: int = 900) -> DataFrame:
    """(job_id, event_id, failures, locked, retry_after_s) at each failure: failures within the window since the last success.

    A key is locked from ``most`` failures on, until the oldest that counts leaves the window. The batch twin.
    """
    by_job = Window.partitionBy("job_id").orderBy("ts", "event_id")
    runs = events.withColumn("run", F.sum(F.col("is_success").cast("int")).over(by_job))
    seconds = F.unix_timestamp("ts")
    recent = Window.partitionBy("job_id", "run").orderBy(seconds).rangeBetween(-window_s, 0)
    failures = runs.filter("is_failure").withColumns({"failures": F.count(F.lit(1)).over(recent), "oldest": F.min(seconds).over(recent), "now": seconds})
    locked = F.col("failures") >= most
    return failures.select("job_id", "event_id", "failures", locked.alias("locked"), F.when(locked, F.col("oldest") + window_s - F.col("now")).otherwise(0).alias("retry_after_s"))


def failure_lockout_stream(events: DataFrame, most: int = 5, window_s: int = 900) -> DataFrame:
    """Streaming lockout with the same columns, one row for each failure; events must come in order within a job and batch by batch."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Lockout(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.times = handle.getListState("times", "at bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            times = [t[0] for t in self.times.get()] if self.times.exists() else []
            out = []
            new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            seconds = (new["ts"].astype("int64") // 10 ** {"ns": 9, "us": 6, "ms": 3}[new["ts"].dt.unit]).tolist()
            fails = list(zip(seconds, new["event_id"].tolist(), new["is_failure"].tolist(), new["is_success"].tolist(), strict=True))
            for k, (at, event, failed, succeeded) in enumerate(fails):
                if succeeded:
                    times = []
                if failed:
                    # Failures of the same second count together, as in the twin's range.
                    times = [t for t in times if t >= at - window_s] + [at]
                    same = 0
                    for later in fails[k + 1 :]:
                        if later[0] != at or later[3]:
                            break
                        same += later[2]
                    n = len(times) + same
                    out.append((key[0], event, n, n >= most, times[0] + window_s - at if n >= most else 0))
            if times:
                self.times.put([(t,) for t in times])
            else:
                self.times.clear()
            yield pd.DataFrame(out, columns=["job_id", "event_id", "failures", "locked", "retry_after_s"])

        def close(self) -> None:
            pass

    return events.select("job_id", "event_id", "ts", "is_failure", "is_success").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Lockout(), outputStructType="job_id bigint, event_id bigint, failures bigint, locked boolean, retry_after_s bigint", outputMode="Update", timeMode="None"
    )


#: Sizes of tiles that a catalog is stored by: CELL_DEG degrees and each twice the one before. The largest holds any footprint.
LEVELS = 8
#: Partitions of the index of known products.
BUCKETS = 256


def _size(level: Column) -> Column:
    from tiegrid.operators.catalog import CELL_DEG

    return CELL_DEG * F.pow(F.lit(2.0), level)


def home_tile(west: Column, east: Column, south: Column, north: Column) -> Column:
    """The tile a footprint is stored in: that of its south-western corner, among tiles no smaller than itself; "none" without bounds."""
    levels = F.array(*(F.lit(k) for k in range(LEVELS)))
    fits = F.filter(levels, lambda k: F.greatest(east - west, north - south) <= _size(k))
    level = F.coalesce(F.get(fits, F.lit(0)), F.lit(LEVELS - 1))
    name = F.concat_ws("_", level, F.floor(west / _size(level)), F.floor(south / _size(level)))
    return F.when(west.isNotNull() & east.isNotNull() & south.isNotNull() & north.isNotNull(), name).otherwise("none")


def tiles_near(boxes: DataFrame) -> list[str]:
    """The tiles whose footprints can touch one of the boxes; as many at most as there are tiles in all."""
    west, east, south, north = (F.col(c) for c in BOUNDS)
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    spread = boxes.dropna(subset=list(BOUNDS)).select(*BOUNDS, level.alias("level"))
    span = lambda low, high: F.sequence(F.floor(low / _size(F.col("level"))) - 1, F.floor(high / _size(F.col("level"))))
    at = spread.select("level", F.explode(span(west, east)).alias("x"), "south_lat", "north_lat").select("level", "x", F.explode(span(south, north)).alias("y"))
    return [r[0] for r in at.select(F.concat_ws("_", "level", "x", "y")).distinct().collect()]


def incremental_ingest(labels: DataFrame, catalog_dir: str, manifest_dir: str, checkpoint: str, containment: float = 0.5):
    """A streaming query that takes parsed label rows in, batch by batch.

    Each batch's products are added to the catalog once (repeats of a product
    within a batch, of which the first in the order of all columns counts, or
    from an earlier one are left out), triplets that hold a new product are
    built, and those not yet in the manifest are appended with the batch as
    their run. The catalog and the manifest are partitioned by tile and run: a
    batch reads only tiles whose products can touch its own, or touch the
    anchors that these touch, so what it reads doesn't grow with the catalog
    elsewhere. Which products are known is looked up in an index beside the
    catalog (``catalog_dir`` with "_ids" behind it) by the buckets of the batch's
    ids. A run's partitions are overwritten, so a batch that is tried again after
    a failure leaves no repeats; an empty batch writes nothing.
    """
    from tiegrid.operators.catalog import build_triplets
    from tiegrid.operators.selection import keep_first

    def table(spark, path: str, like: DataFrame) -> DataFrame:
        try:
            return spark.read.schema(like.schema).parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], like.schema)

    def put(df: DataFrame, path: str, by: str) -> None:
        df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "run").parquet(path)

    def take(batch: DataFrame, run: int) -> None:
        if batch.isEmpty():
            return
        spark, ids = batch.sparkSession, ["product_id", "sensor"]
        mark = {"run": F.lit(run).cast("bigint"), "tile": home_tile(*(F.col(c) for c in BOUNDS)), "bucket": F.pmod(F.xxhash64("product_id"), F.lit(BUCKETS)).cast("int")}
        tagged = materialize(keep_first(batch, ids, batch.columns).withColumns(mark), "ingest")
        buckets = [r[0] for r in tagged.select("bucket").distinct().collect()]
        index = tagged.select(*ids, "bucket", "run")
        known = table(spark, catalog_dir + "_ids", index).filter(F.col("bucket").isin(buckets) & (F.col("run") != run))
        fresh = materialize(tagged.join(known.select(ids), ids, "left_anti").select(*batch.columns, "tile", "run", "bucket"), "ingest")
        stored = fresh.drop("bucket")
        put(stored, catalog_dir, "tile")
        put(fresh.select(index.columns), catalog_dir + "_ids", "bucket")
        near = table(spark, catalog_dir, stored).filter(F.col("tile").isin(tiles_near(fresh)))
        anchors = near.filter("sensor = 'OHRC'")
        anchors = materialize(anchors.join(_touched(anchors, fresh), "product_id", "left_semi"), "ingest-anchors")
        others = table(spark, catalog_dir, stored).filter(F.col("tile").isin(tiles_near(anchors)) & (F.col("sensor") != "OHRC"))
        others = others.join(_touched(others, anchors), "product_id", "left_semi")
        found = build_triplets(anchors.unionByName(others).drop("tile", "run"), containment)
        homes = anchors.select(F.col("product_id").alias("ohrc_id"), "tile")
        new = materialize(_touching(found, fresh.select("product_id")).join(homes, "ohrc_id").withColumn("run", F.lit(run).cast("bigint")), "ingest-triplets")
        triple = ["ohrc_id", "tmc_id", "iirs_id"]
        tiles = [r[0] for r in new.select("tile").distinct().collect()]
        old = table(spark, manifest_dir, new).filter(F.col("tile").isin(tiles) & (F.col("run") != run))
        put(new.join(old.select(triple), triple, "left_anti").select(new.columns), manifest_dir, "tile")

    return labels.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _touched(a: DataFrame, b: DataFrame) -> DataFrame:
    """(product_id) of the products of ``a`` whose boxes touch one of ``b``."""
    from tiegrid.operators.catalog import overlapping

    box = ["product_id", *BOUNDS]
    return overlapping(a.select(box), b.select(box), "product_id", "product_id").select("product_id").distinct()


def _touching(triplets: DataFrame, ids: DataFrame) -> DataFrame:
    """Triplets that hold one of the ids."""
    parts = [triplets.join(ids.withColumnRenamed("product_id", c), c, "left_semi").select(triplets.columns) for c in ("ohrc_id", "tmc_id", "iirs_id")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()
