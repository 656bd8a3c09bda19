"""What changes between the runs of queries: papers that are new, changed or dropped.

A hit is (query_name, key, run, run_at, digest): ``run`` counts the runs from any number without gaps, ``run_at`` is
the run's time, the same for all queries of a run, and ``digest`` stands for what the source says of the paper. A key is
*new* in a run if the run before lacks it, *changed* if that has it with another digest, and *dropped* in the first run
without it. Hits without a key or run do not count; of a key's hits in one run the greatest digest does.

``between`` takes a table and ``followed`` a stream, whose state is one small row a key, in buckets of keys; both give the same rows,
whatever batches the stream comes in, as long as runs come in order and a run's hits no later than ``late`` after
the next run's first. A stream learns that a key is dropped from a timer, once the watermark passes the run that had it last.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..shared import new_path

#: Keys are dealt to so many buckets, each of which has a state record and a timer.
BUCKETS = 1024
SEEN = {"query_name": "object", "key": "object", "run": "int64", "at": "int64", "digest": "object"}
TOLD = ["query_name", "key", "run", "change", "digest"]
CHANGES = "query_name string, key string, run int, change string, digest string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def between(hits: DataFrame) -> DataFrame:
    """The changes of a table of hits."""
    hits = hits.where("key is not null and run is not null")
    once = hits.groupBy("query_name", "key", "run").agg(F.max("digest").alias("digest"))
    order = Window.partitionBy("query_name", "key").orderBy("run")
    seen = once.select("*", F.lag("run").over(order).alias("before"), F.lag("digest").over(order).alias("was"), F.lead("run").over(order).alias("after"))
    last = hits.agg(F.max("run").alias("last"))
    event = lambda at, change, digest: F.struct(at.cast("int").alias("run"), F.lit(change).alias("change"), digest.cast("string").alias("digest"))
    run, follows = F.col("run"), F.col("before") == F.col("run") - 1
    came = F.when(follows, F.when(~F.col("digest").eqNullSafe(F.col("was")), event(run, "changed", F.col("digest")))).otherwise(event(run, "new", F.col("digest")))
    went = F.when(F.coalesce(F.col("after"), F.col("last") + 1) > run + 1, event(run + 1, "dropped", F.col("digest")))
    told = seen.crossJoin(F.broadcast(last)).select("query_name", "key", F.explode(F.array_compact(F.array(came, went))).alias("e"))
    return told.select("query_name", "key", "e.run", "e.change", "e.digest")


class Following(StatefulProcessor):
    """The run, time and digest in which each key of a bucket was last seen, and a timer just after the first of them.

    A call to the state costs as much as hundreds of rows, so keys are dealt to buckets whose state is one Arrow table."""

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("bucket", "seen binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        told, last = advanced(self._seen(), pd.concat(rows))
        self._keep(last)
        yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        last = self._seen()
        due = last["at"] < max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        gone = last[due]
        self._keep(last[~due])
        yield gone.assign(run=gone["run"] + 1, change="dropped")[TOLD].astype({"run": "int32"})

    def close(self) -> None:
        pass

    def _seen(self):
        import pandas as pd
        import pyarrow as pa

        if not self.seen.exists():
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in SEEN.items()})
        return pa.ipc.open_stream(self.seen.get()[0]).read_pandas()

    def _keep(self, last) -> None:
        import pyarrow as pa

        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if not len(last):
            self.seen.clear()
            return
        held = pa.table({c: pa.array(last[c], t, from_pandas=True) for c, t in zip(SEEN, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held.schema) as stream:
            stream.write_table(held)
        self.seen.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(last["at"].min()) + 1)


def advanced(last, hits):
    """What hits tell of the keys last seen, and the keys as seen now; both of all keys at once."""
    import pandas as pd

    by = ["query_name", "key"]
    hits = hits[list(SEEN)].sort_values([*by, "run", "digest"], na_position="first")
    hits["at"] = hits.groupby([*by, "run"], dropna=False, sort=False)["at"].transform("max")
    hits = hits.drop_duplicates([*by, "run"], keep="last")
    rows = pd.concat([last.assign(old=True), hits.assign(old=False)], ignore_index=True) if len(last) else hits.assign(old=False)
    known = rows["run"].where(rows["old"]).groupby([rows[c] for c in by], dropna=False).transform("max")
    rows = rows[rows["old"] | known.isna() | (rows["run"] > known)].sort_values([*by, "run"], ignore_index=True)
    group, digest = rows.groupby(by, dropna=False, sort=False).ngroup(), pd.Series(pd.factorize(rows["digest"])[0])
    again = group == group.shift()
    follows = again & (rows["run"] == rows["run"].shift() + 1)
    back = again & ~follows
    came = rows.assign(change="new")[~rows["old"] & ~follows]
    changed = rows.assign(change="changed")[follows & (digest != digest.shift())]
    before = rows.shift()
    gone = rows.assign(run=before["run"] + 1, digest=before["digest"], change="dropped")[back]
    told = pd.concat([came, changed, gone])[TOLD].astype({"run": "int32"})
    return told, rows.drop_duplicates(by, keep="last")[list(SEEN)]


def followed(hits: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """The changes of a stream of hits; it needs the RocksDB state store (``follow`` sets it).

    ``buckets``: what a task holds at once is one bucket's keys; a checkpoint keeps the number that it began with."""
    rows = hits.where("key is not null and run is not null and run_at is not null").withWatermark("run_at", late)
    bucket = F.pmod(F.xxhash64("query_name", "key"), F.lit(buckets)).cast("int")
    rows = rows.select(bucket.alias("bucket"), "query_name", "key", F.col("run").cast("int").alias("run"), "run_at", F.unix_millis("run_at").alias("at"), F.col("digest").cast("string").alias("digest"))
    return rows.groupBy("bucket").transformWithStateInPandas(Following(), CHANGES, "append", "EventTime")


def follow(hits: DataFrame, out: str, checkpoint: str, late: str = "0 seconds") -> None:
    """Add the changes of all hits there are to the Parquet table ``out``; the next call goes on from ``checkpoint``."""
    spark = hits.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = followed(hits, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def followed_table(spark: SparkSession, hits: DataFrame) -> DataFrame:
    """``between`` by way of a stream over the written hits."""
    source, out, checkpoint = (new_path(spark, f"changes-{n}") for n in ("hits", "out", "state"))
    hits.write.parquet(source)
    follow(spark.readStream.schema(hits.schema).parquet(source), out, checkpoint)
    return spark.read.schema(CHANGES).parquet(out)
