"""Pluggable scorers and resumable tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[Sequence[str]], Sequence[float]]


def score_with(df: DataFrame, id: str, text: str, make: Callable[[], Scorer], model: str, batch: int = 64) -> DataFrame:
    """(model, id, score): ``make`` builds the scorer once per task; texts of a batch are
    ordered by length so that batches are even.  Null texts get a null score."""
    kind = df.schema[id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for f in frames:
            scorer = scorer or make()
            known = f[f["text"].notna()]
            order = known["text"].str.len().sort_values(kind="stable").index
            scores = pd.Series(dtype=float)
            parts = [pd.Series(list(scorer(known.loc[order[i : i + batch], "text"].tolist())), order[i : i + batch], dtype=float) for i in range(0, len(order), batch)]
            scores = pd.concat(parts) if parts else scores
            yield pd.DataFrame({"model": model, "id": f["id"], "score": scores.reindex(f.index)})

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"model string, id {kind}, score double")


def score_all(df: DataFrame, id: str, text: str, makers: dict[str, Callable[[], Scorer]]) -> tuple[DataFrame, DataFrame]:
    """Scores of every scorer that can be built, and (model, reason) of the others: what
    is unavailable is recorded, never replaced."""
    spark, scores, failed = df.sparkSession, None, []
    for name, make in makers.items():
        try:
            make()
        except Exception as e:  # any reason counts
            failed.append((name, f"{type(e).__name__}: {e}"))
            continue
        part = score_with(df, id, text, make, name)
        scores = part if scores is None else scores.unionByName(part)
    if scores is None:
        scores = spark.createDataFrame([], f"model string, id {df.schema[id].dataType.simpleString()}, score double")
    return scores, spark.createDataFrame(failed, "model string, reason string")


def run_open_tasks(tasks: DataFrame, done: DataFrame | None, key: str, run: Callable[[str], float], retries: int = 1) -> list[tuple[str, str, float | None]]:
    """Runs the tasks without a finished entry (key, status) one by one, each tried again
    ``retries`` times, and returns (key, status, value) to be appended to the table.

    ``tasks`` is a plan of a bounded number of model fits, so it is driven from here.
    """
    left = tasks if done is None else tasks.join(done.where("status = 'done'").select(key), key, "left_anti")
    out: list[tuple[str, str, float | None]] = []
    for row in left.select(key).distinct().orderBy(key).toLocalIterator():
        for attempt in range(retries + 1):
            try:
                out.append((row[key], "done", float(run(row[key]))))
                break
            except Exception:
                if attempt == retries:
                    out.append((row[key], "failed", None))
    return out
