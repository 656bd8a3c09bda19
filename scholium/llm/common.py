"""Helpers shared by the operators: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import CHECKPOINT_DIR, cleanup, new_path, remove, shared_dir, written

__all__ = ["CHECKPOINT_DIR", "ascii_lower", "cleanup", "fresh", "new_path", "release", "remove", "shared_dir", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def release(spark: SparkSession) -> None:
    """Lets the driver's cleaner drop the shuffle files of steps whose results are written and whose frames are gone.

    Frames hold plans, and plans hold shuffles; what the first collection lets go of, the second finds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)  # the cleaner works in the background
