import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from scholium.operators import runs
from scholium.plans import catalog
from scholium.streaming import changes

SCHEMA = "query_name string, key string, run int, run_at timestamp, digest string"
BEGAN = datetime(2024, 1, 1)


def made(many, keys, seed=1):
    rng = random.Random(seed)
    rows = [(q, f"p{k}", run, BEGAN + timedelta(days=7 * run), rng.choice("ab")) for run in range(many) for q in "xy" for k in range(keys) if rng.random() < 0.6]
    return rows + [("x", "p0", run, BEGAN + timedelta(days=7 * run), None) for run in range(many)] + [("x", None, 2, BEGAN, "a")] + rows[:5]


def plainly(rows):
    found, last = {}, max(r[2] for r in rows if r[1] is not None)
    for q, key, run, _, digest in rows:
        if key is not None:
            own = found.setdefault((q, key), {})
            own[run] = max(filter(None, (own.get(run), digest)), default=None)
    out = set()
    for (q, key), own in found.items():
        for run, digest in own.items():
            if run - 1 not in own:
                out.add((q, key, run, "new", digest))
            elif own[run - 1] != digest:
                out.add((q, key, run, "changed", digest))
            if run < last and run + 1 not in own:
                out.add((q, key, run + 1, "dropped", digest))
    return out


def told(frame):
    rows = [tuple(r) for r in frame.select("query_name", "key", "run", "change", "digest").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_table_equals_definition(spark):
    rows = made(6, 30)
    assert told(changes.between(spark.createDataFrame(rows, SCHEMA))) == plainly(rows)
    assert told(changes.between(spark.createDataFrame([], SCHEMA))) == set()


def test_stream_goes_on_after_restarts(spark, tmp_path):
    rows = made(5, 12)
    source, out, state = (str(tmp_path / n) for n in ("hits", "out", "state"))
    for part in ([0, 1], [2], [3, 4]):
        spark.createDataFrame([r for r in rows if r[2] in part], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        changes.follow(spark.readStream.schema(SCHEMA).parquet(source), out, state)
        seen = [r for r in rows if r[2] <= part[-1]]
        assert told(spark.read.parquet(out)) == plainly(seen)
    assert spark.conf.get(changes.PROVIDER, None) != changes.ROCKSDB


def test_counts_equal_run_comparison(spark):
    rows = [r for r in made(2, 40) if r[0] == "x"]
    hits = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("").alias("pmcid"), F.lit("").alias("pmid"), F.col("key").alias("paper_id"))
    compared = runs.compare(hits.where("run = 0"), hits.where("run = 1")).first()
    second = [c for _, _, run, c, _ in told(changes.between(hits)) if run == 1]
    assert (compared.new_count, compared.dropped_count) == (second.count("new"), second.count("dropped"))


def test_queries_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view events as select * from '{folder}/events.parquet'")
    want = set(duckdb.sql(f"select query_name, key, run, change, digest from ({catalog.ORACLE['run_changes']})").fetchall())
    for name in ("run_changes", "run_changes_stream"):
        assert told(catalog.QUERIES[name](spark, folder)) == want


class Handle:
    """A state of one value and its timers, as a processor sees it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, due):
        self.timers.remove(due)

    def registerTimer(self, due):
        self.timers.add(due)


class Times:
    def __init__(self, watermark, due):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = (lambda: watermark), (lambda: due)


def test_one_call_takes_many_keys_with_few_calls_to_the_state():
    import pandas as pd

    rows = [r for r in made(6, 400) if r[1] is not None]
    handle, found = Handle(), []
    following = changes.Following()
    following.init(handle)
    for part in ([0], [1], [2, 3, 4], [5]):
        hits = pd.DataFrame([r for r in rows if r[2] in part], columns=["query_name", "key", "run", "run_at", "digest"])
        hits["at"] = hits["run_at"].astype("datetime64[ms]").astype("int64")
        found += following.handleInputRows((7,), iter([hits[:500], hits[500:]]), None)
        watermark = int(hits["at"].max())
        while due := [t for t in handle.timers if t < watermark]:
            found += following.handleExpiredTimer((7,), Times(watermark, due[0]), Times(watermark, due[0]))
    got = [(q, k, int(run), c, None if pd.isna(d) else d) for f in found for q, k, run, c, d in f.itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == plainly(rows)
    assert handle.calls < 40
