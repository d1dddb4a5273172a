"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import hash_to_min, matches
from .editdup import NearCopies
from .formatdup import LayoutCopies
from .groupsplit import GroupSplit, plain_group
from .packing import fill, pack
from .proportions import TargetSample
from .splitoverlap import SplitOverlap, source_name
from .stuffing import stuffed_pages
from .tokenize import encode


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hash_to_min(matches(_t(spark, d, "candidates_0")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return LayoutCopies(_t(spark, d, "injection_lab"), "id", "text").copies()


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return LayoutCopies(_t(spark, d, "injection_lab"), "id", "text").records()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return NearCopies(_t(spark, d, "injection_lab"), "id", "text").pairs()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearCopies(_t(spark, d, "injection_lab"), "id", "text").groups()


def _sources(spark: SparkSession, d: str) -> TargetSample:
    targets = _t(spark, d, "target_shares").where("target_set = 'source_mix'")
    records = _t(spark, d, "injection_lab").select("id", source_name(F.col("source")).alias("source"))
    return TargetSample(records, "id", "source", targets)


def _bands(spark: SparkSession, d: str) -> TargetSample:
    targets = _t(spark, d, "target_shares").where("target_set = 'benign_band'")
    n = F.coalesce(F.col("labels.`0`"), F.lit(0))
    band = F.when(n <= 0, "none").when(n == 1, "1").when(n < 10, "2-9").when(n < 100, "10-99").otherwise("100+")
    # nulls are left out of the JSON by name, so different lines have different keys
    line = F.to_json(F.struct(plain_group(F.col("`group`")).alias("g"), F.lower(F.trim("`partition`")).alias("p"), F.col("`rows`").alias("n"), "labels", F.array_sort(F.map_entries("sources")).alias("s"), F.col("recorded_at").alias("at")))
    return TargetSample(_t(spark, d, "pool_ledger").select(line.alias("line"), band.alias("band")), "line", "band", targets)


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).sample().select(F.col("key").alias("id"), "category", "rank", "priority")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).report()


def p3_ledger_sample(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).sample().select(F.col("key").alias("line"), "category", "rank", "priority")


def p3_ledger_report(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).report()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return GroupSplit(_t(spark, d, "pool_ledger")).torn()


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    targets = _t(spark, d, "target_shares").where("target_set = 'split'")
    return GroupSplit(_t(spark, d, "pool_ledger")).assign(targets)


def p6_components(spark: SparkSession, d: str) -> DataFrame:
    return GroupSplit(_t(spark, d, "pool_ledger")).linked()


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    """Groups assigned, groups in several splits, and the largest deviations from the
    target shares of rows and from the overall share of positives, within a point."""
    split = GroupSplit(_t(spark, d, "pool_ledger"))
    b = split.balance(_t(spark, d, "target_shares").where("target_set = 'split'"))
    known = split.records.select("group_key").distinct().agg(F.count("*").alias("known"))
    overall = F.sum(F.col("positive_share") * F.col("rows")) / F.sum("rows")
    spread = F.greatest(F.max("positive_share") - overall, overall - F.min("positive_share"))
    s = b.agg(F.sum("groups").alias("groups"), (F.max(F.abs(F.col("row_share") - F.col("target"))) < 0.01).alias("rows_met"), (spread < 0.01).alias("labels_met"))
    return s.join(F.broadcast(known)).select("groups", (F.col("groups") - F.col("known")).alias("divided"), "rows_met", "labels_met")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return SplitOverlap(_t(spark, d, "injection_lab"), "id", "text", "split").ids()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return SplitOverlap(_t(spark, d, "injection_lab"), "id", "text", "split", ["source"]).report("source")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(_t(spark, d, "documents"), "text", ["doc_id"])


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "pack_capacity")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    kinds = _t(spark, d, "pack_capacity")
    return fill(pack(_t(spark, d, "documents"), "doc_id", "text", kinds), kinds)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(_t(spark, d, "documents"), "doc_id", "text", "lang").select(F.col("id").alias("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_sample": p3_sample,
    "p3_report": p3_report,
    "p3_ledger_sample": p3_ledger_sample,
    "p3_ledger_report": p3_ledger_report,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_components": p6_components,
    "p6_balance": p6_balance,
    "p7_ids": p7_ids,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
}

# Only what SQL can express on whole tables; the others are tested against brute force.
_PART = "replace(lower(trim(\"partition\", ' ' || chr(9) || chr(10) || chr(13))), '_', '-')"
_LINES = f"""(SELECT 'g:' || regexp_extract(lower("group"), '([0-9a-f]{{20}})', 1) AS group_key, CASE WHEN starts_with({_PART}, 't-bank') THEN 't-bank' ELSE {_PART} END AS part
        FROM pool_ledger WHERE "rows" > 0 AND "group" IS NOT NULL AND {_PART} <> '')"""
_SOURCE = "nullif(replace(lower(regexp_replace(source, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')), '_', '-'), '')"
_DRAWN = f"""t AS (SELECT category, max(share) AS share, max(coalesce(min_rows, 0)) AS min_rows FROM target_shares WHERE target_set = 'source_mix' AND category IS NOT NULL AND share IS NOT NULL GROUP BY 1),
    e AS (SELECT id, min({_SOURCE}) AS category FROM injection_lab WHERE id IS NOT NULL GROUP BY id),
    r AS (SELECT id, category, share, min_rows, row_number() OVER (PARTITION BY category ORDER BY sha256('sample:' || id), id) AS rank FROM e JOIN t USING (category)),
    p AS (SELECT *, CASE WHEN rank <= min_rows THEN 0.0::DOUBLE ELSE (rank - 0.5) / share END AS priority FROM r),
    drawn AS (SELECT id, category, rank::BIGINT AS rank, priority FROM p QUALIFY row_number() OVER (ORDER BY rank > min_rows, priority, category) <= (SELECT floor(count(*) * 0.1::DOUBLE) FROM p))"""
SQL: dict[str, str] = {
    "p1_found": """WITH RECURSIVE m AS (SELECT left_id AS a, right_id AS b FROM candidates_0 WHERE left_id <> right_id AND cosine >= 0.85 AND NOT isnan(cosine)),
    e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT a AS id, a AS other FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a)
    SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
    "p3_sample": f"WITH {_DRAWN} SELECT * FROM drawn",
    "p3_report": f"""WITH {_DRAWN}, n AS (SELECT count(*) AS n FROM drawn), c AS (SELECT category, count(*) AS sampled FROM drawn GROUP BY 1), a AS (SELECT category, count(*) AS available FROM r GROUP BY 1)
    SELECT category, share, min_rows, coalesce(available, 0) AS available, coalesce(sampled, 0) AS sampled, coalesce(sampled, 0)::DOUBLE / n AS sampled_share, coalesce(sampled, 0) >= min_rows AS min_met,
    greatest(0, floor(share * n + 1e-9)::BIGINT - coalesce(sampled, 0)) AS short_by FROM t LEFT JOIN c USING (category) LEFT JOIN a USING (category), n""",
    "p6_found": f"SELECT group_key FROM {_LINES} GROUP BY group_key HAVING count(DISTINCT part) > 1",
    "p6_components": f"SELECT DISTINCT group_key, group_key AS component FROM {_LINES}",
    "p6_balance": f"SELECT count(DISTINCT group_key) AS groups, 0::BIGINT AS divided, true AS rows_met, true AS labels_met FROM {_LINES}",
}
