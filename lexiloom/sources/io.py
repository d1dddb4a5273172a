"""Scans and sinks with the checks that go with them."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "text")] + [T.StructField("label", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("source", "split", "group_id", "family")] + [T.StructField("_corrupt", T.StringType())])
SPLITS = ("train", "validation", "test")


class InvalidRows(ValueError):
    """Rows that break the schema's rules."""


def violations(df: DataFrame) -> DataFrame:
    """(id, problem) of every rule a labelled text row breaks, repeated ids included."""
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules: list[tuple[Column, str]] = [(empty(c), f"{c} is empty") for c in ("id", "text", "source")]
    rules += [(F.col("label").isNull() | ~F.col("label").isin(0, 1), "label is not 0 or 1"), (F.col("split").isNull() | ~F.col("split").isin(*SPLITS), "unknown split")]
    rules += [(F.col(c).isNotNull() & (F.trim(c) == ""), f"{c} is empty") for c in ("group_id", "family") if c in df.columns]
    if "_corrupt" in df.columns:
        rules.append((F.col("_corrupt").isNotNull(), "row cannot be read"))
    each = df.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))).alias("problem"))
    twice = df.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    return each.unionByName(twice)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Validated JSONL scan.  Lines end at line feeds only; the schema is given, so
    nothing is inferred; a wrong type, a broken rule or a repeated id raises, and so
    does a file without rows."""
    df = read_json_rows(spark, path, ROW_SCHEMA)
    for row in violations(df).limit(1).collect():
        raise InvalidRows(f"{row.problem}: {row.id}")
    if not df.take(1):
        raise InvalidRows(f"no rows in {path}")
    return df.drop("_corrupt")


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSONL scan without validation.  Booleans are not taken for integers."""
    reader = spark.read.option("lineSep", "\n").option("columnNameOfCorruptRecord", "_corrupt")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_arrays(spark: SparkSession, paths: dict[str, str], schema: str, allowed: DataFrame | None = None) -> DataFrame:
    """JSON-array files as rows with positional ids ``<name>:<index>``; with an allow-list
    (source) others are left out (counted by ``rejected``)."""
    element = T._parse_datatype_string(f"array<struct<{schema}>>")
    out = None
    for name, path in paths.items():
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.posexplode(F.from_json("value", element)).alias("at", "r")).select(F.concat(F.lit(f"{name}:"), F.col("at").cast("string")).alias("id"), "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out if allowed is None else out.join(F.broadcast(allowed), "source", "left_semi")


def rejected(df: DataFrame, allowed: DataFrame, source: str = "source") -> DataFrame:
    return df.join(F.broadcast(allowed), source, "left_anti").groupBy(source).agg(F.count("*").alias("n"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted fields over several lines and doubled quotes; gzip by
    file name."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def rejoin_manifest(manifest: DataFrame, raw: DataFrame, sha: str = "text_sha256") -> DataFrame:
    """Manifest rows with the text of raw rows of the same id; a missing id or another
    hash raises."""
    joined = manifest.join(raw.select("id", "text"), "id", "left")
    bad = joined.where(F.col("text").isNull() | (F.sha2("text", 256) != F.col(sha)))
    for row in bad.select("id").limit(1).collect():
        raise InvalidRows(f"text of {row.id} is missing or has changed")
    return joined


def _local(path: str) -> str:
    return path.removeprefix("file://")


def assert_outside(path: str, root: str) -> None:
    """Refuses a sink under a root, links followed."""
    a, b = os.path.realpath(_local(path)), os.path.realpath(_local(root))
    if os.path.commonpath([a, b]) == b:
        raise ValueError(f"{path} lies under {root}")


def write_rows(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSONL, Parquet, ORC or CSV with a header; an existing path raises."""
    w = df.write.mode("errorifexists")
    (w.option("header", True).option("escape", '"') if kind == "csv" else w).format(kind).save(path)


def write_manifest(df: DataFrame, path: str, columns: Sequence[str], order: str) -> None:
    """Gzipped CSV with a fixed column and row order (a single file is the feature)."""
    df.select(*columns).coalesce(1).sortWithinPartitions(order).write.mode("errorifexists").option("header", True).option("escape", '"').option("compression", "gzip").csv(path)


def json_safe(value):
    """Nested values with NaN and infinities as null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return value


def write_report(report: dict, path: str) -> None:
    """A small JSON report, NaN forbidden."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, allow_nan=False)
        f.write("\n")


def null_not_finite(df: DataFrame) -> DataFrame:
    """Doubles and floats with NaN and infinities as null."""
    odd = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in odd})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_lock(spark: SparkSession, path: str, lock: DataFrame) -> None:
    """Every locked file (name, sha256) must be there unchanged."""
    have = file_hashes(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("now"))
    for row in lock.join(have, "name", "left").where("now is null or now <> sha256").limit(1).collect():
        raise InvalidRows(f"{row['name']} is missing or has changed")


def write_scores(df: DataFrame, path: str) -> None:
    """Long score table (model, row_id, score), one folder a model."""
    df.write.mode("errorifexists").partitionBy("model").parquet(path)


def with_cache(requests: DataFrame, cache: DataFrame | None, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(answered, open): requests that a cache table answers, and the others."""
    if cache is None:
        return requests.limit(0), requests
    return requests.join(cache.dropDuplicates(list(keys)), list(keys)), requests.join(cache, list(keys), "left_anti")


def flatten_runs(df: DataFrame, *structs: str) -> DataFrame:
    """Nested report structs as columns ``<struct>_<field>``."""
    flat = []
    for f in df.schema.fields:
        if f.name in structs and isinstance(f.dataType, T.StructType):
            flat += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            flat.append(F.col(f.name))
    return df.select(*flat)
