"""Query runs: records, revisions, comparison."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.text import first_filled
from ..schema import QUERY_RUNS
from ..shared import remove, written


def record(query_name: str, query_string: str, repository: str, limit: int, formats: list[str], output_dir: str, result_count: int, downloaded_count: int = 0, notes: str = "", revision_of: str | None = None) -> dict:
    return dict(zip([f.name for f in QUERY_RUNS], (query_name, query_string, repository, limit, formats, output_dir, result_count, downloaded_count, datetime.now(UTC), notes, revision_of), strict=True))


def save(spark: SparkSession, run: dict, folder: str) -> str:
    """query_run.json in a folder, its time as ISO text."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "query_run.json")
    with open(path, "w", encoding="utf-8") as out:
        json.dump(run | {"run_timestamp": run["run_timestamp"].isoformat()}, out, indent=2, ensure_ascii=False)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_RUNS).option("multiLine", True).json(path)


def context(spark: SparkSession, path: str | None) -> tuple[str, str]:
    """Name and text of a run's query; two empty texts if there is no record."""
    row = load(spark, path).first() if path and os.path.exists(path) else None
    return (row.query_name or "", row.query_string or "") if row else ("", "")


def config(path: str) -> dict:
    """A mapping of keys to values from a small YAML file: texts, numbers, and lists and mappings one level deep."""
    try:
        import yaml
    except ImportError:
        yaml = None
    with open(path, encoding="utf-8") as text:
        found = yaml.safe_load(text) if yaml else _plain_yaml(text.read())
    if not isinstance(found, dict):
        raise CorpusError(f"{path} holds no mapping")
    return found


def _plain_yaml(text: str) -> dict | None:
    def value(x: str):
        x = x.strip()
        if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"":
            return x[1:-1]
        return int(x) if x.lstrip("-").isdigit() else {"true": True, "false": False, "": None}.get(x, x)

    out: dict = {}
    last = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " -" and last is not None:
            item = line.strip()
            if item.startswith("- "):
                out[last] = [*(out[last] or []), value(item[2:])]
            elif ":" in item:
                out[last] = (out[last] or {}) | {item.split(":", 1)[0]: value(item.split(":", 1)[1])}
        elif ":" in line:
            last, _, rest = line.partition(":")
            out[last] = value(rest)
        else:
            return None
    return out


def key() -> Column:
    """What two runs are compared by."""
    return first_filled(F.col("pmcid"), F.col("pmid"), F.col("paper_id"))


def compare(prior: DataFrame, current: DataFrame) -> DataFrame:
    """One row of set sizes over distinct keys; rows without a key do not count."""
    a = prior.select(key().alias("k")).where("k is not null").distinct().withColumn("old", F.lit(1))
    b = current.select(key().alias("k")).where("k is not null").distinct().withColumn("new", F.lit(1))
    counts = {"prior_count": F.count("old"), "current_count": F.count("new"), "overlap": F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()), "new_count": F.count_if(F.col("old").isNull()), "dropped_count": F.count_if(F.col("new").isNull())}
    return a.join(b, "k", "full").agg(*(v.alias(k) for k, v in counts.items()))


def revisions(runs: DataFrame) -> DataFrame:
    """(query_name, root, depth) of each name: the first ancestor by revision_of, and the steps to it.

    A run that revises an unknown one is a root; runs in a circle, and those that lead to one, have no
    root and no depth. Every round doubles the steps taken, so chains of any length end in few.
    """
    named = runs.groupBy("query_name").agg(F.min("revision_of").alias("parent"))
    known = named.select(F.col("query_name").alias("parent")).withColumn("known", F.lit(True))
    first = named.join(known, "parent", "left")
    root = F.col("known").isNull()
    state, path = written(first.select("query_name", F.when(root, F.col("query_name")).otherwise(F.col("parent")).alias("at"), F.when(root, 0).otherwise(1).cast("long").alias("depth")), "run-chain")
    spark, roots = runs.sparkSession, first.where(root).select(F.col("query_name").alias("at")).withColumn("ended", F.lit(True))
    for _ in range(max(1, state.count()).bit_length()):
        further = state.select(F.col("query_name").alias("at"), F.col("at").alias("beyond"), F.col("depth").alias("more"))
        following, next_path = written(state.join(further, "at").select("query_name", F.col("beyond").alias("at"), (F.col("depth") + F.col("more")).alias("depth")), "run-chain")
        remove(spark, path)
        state, path = following, next_path
    out = state.join(roots, "at", "left")
    return out.select("query_name", F.when(F.col("ended"), F.col("at")).alias("root"), F.when(F.col("ended"), F.col("depth").cast("int")).alias("depth"))
