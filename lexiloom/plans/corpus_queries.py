"""Queries over corpora: similarity joins, de-duplication, groups, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D, graph as G, sampling as S, similarity as X
from ..scratch import Scratch
from .registry import docs, lab, query, table
from .text_queries import COLLAPSE, H, LOWERED

DOCS_LABELLED = "(SELECT * FROM documents WHERE label IS NOT NULL AND text IS NOT NULL)"


def labelled(s, d) -> DataFrame:
    return docs(s, d).where("label is not null and text is not null")


def records(s, d) -> DataFrame:
    """injection_lab with one row per id: the text (it never changes), the smallest
    split and label, and the group."""
    split = F.lower(F.regexp_replace("split", r"^[\s]+|[\s]+$", ""))
    split = F.when(split.isin("val", "dev"), "validation").when(split.isin("train", "test", "validation"), split)
    return lab(s, d).where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"), F.min(split).alias("split"), F.min("label").alias("label"), F.min("group_id").alias("group_id"), F.min("source").alias("source"))


RECORDS = "(SELECT id, min(text) AS text, min(CASE WHEN sp IN ('val', 'dev') THEN 'validation' WHEN sp IN ('train', 'test', 'validation') THEN sp END) AS split, min(label) AS label, min(group_id) AS group_id, min(source) AS source FROM (SELECT *, lower(regexp_replace(split, '^[\\s]+|[\\s]+$', '', 'g')) AS sp FROM injection_lab) WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)"


def _shingle_sql(name: str, source: str, id: str) -> str:
    return f"{name}_t AS (SELECT {id} AS id, {LOWERED} AS t, regexp_extract_all({LOWERED}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source} WHERE text IS NOT NULL), {name} AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [t] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM {name}_t)"


def _edges_sql(a: str, b: str, order: str) -> str:
    return f"(SELECT i, j, shared, na.n AS n_i, nb.n AS n_j FROM (SELECT x.id AS i, y.id AS j, count(*) AS shared FROM {a} x JOIN {b} y ON x.shingle = y.shingle {order} GROUP BY ALL) JOIN (SELECT id, count(*) AS n FROM {a} GROUP BY id) na ON na.id = i JOIN (SELECT id, count(*) AS n FROM {b} GROUP BY id) nb ON nb.id = j WHERE shared >= least(3, least(na.n, nb.n)) AND shared >= 0.5 * least(na.n, nb.n))"


DOC_SH = _shingle_sql("sh", "documents", "doc_id")
DOC_EDGES = _edges_sql("sh", "sh", "AND x.id < y.id")


def doc_shingles(s, d) -> DataFrame:
    return X.shingles(docs(s, d), "doc_id", T.lowered(F.col("text")))


def doc_sets(s, d) -> DataFrame:
    return X.shingle_sets(docs(s, d), "doc_id", T.lowered(F.col("text")))


def doc_edges(s, d) -> DataFrame:
    return X.containment_edges(doc_sets(s, d))


query("shingle_stats", lambda s, d: doc_shingles(s, d).groupBy("id").agg(F.count("*").alias("n"), F.min("shingle").alias("first_shingle")),
      f"WITH {DOC_SH} SELECT id, count(*) AS n, min(shingle) AS first_shingle FROM sh GROUP BY id")
query("containment_edges", doc_edges, f"WITH {DOC_SH} SELECT * FROM {DOC_EDGES}")


def side(s, d, split: str) -> DataFrame:
    return X.shingle_sets(records(s, d).where(F.col("split") == split), "id", T.lowered(F.col("text")))


_SIDES = _shingle_sql("te", "(SELECT * FROM " + RECORDS + " WHERE split = 'test')", "id") + ", " + _shingle_sql("tr", "(SELECT * FROM " + RECORDS + " WHERE split = 'train')", "id")
_CROSS = _edges_sql("te", "tr", "")
query("cross_containment_semi", lambda s, d: records(s, d).where("split = 'test'").join(X.cross_edges(side(s, d, "test"), side(s, d, "train")).select(F.col("i").alias("id")), "id", "left_semi").select("id"),
      f"WITH {_SIDES} SELECT DISTINCT i AS id FROM {_CROSS}")
query("cross_containment_anti", lambda s, d: records(s, d).where("split = 'test'").join(X.cross_edges(side(s, d, "test"), side(s, d, "train")).select(F.col("i").alias("id")), "id", "left_anti").select("id"),
      f"WITH {_SIDES} SELECT id FROM {RECORDS} WHERE split = 'test' AND id NOT IN (SELECT i FROM {_CROSS})")


def sides(s, d) -> DataFrame:
    """Records of the test and train splits, written once: their texts are read several times."""
    return Scratch(s).keep(records(s, d).where("split in ('test', 'train')").select("id", "split", "text"))


def best(both: DataFrame) -> DataFrame:
    sets = lambda split: X.shingle_sets(both.where(F.col("split") == split), "id", T.lowered(F.col("text")))
    return X.best_containment(sets("test"), sets("train"))


_BEST = "SELECT n.id, coalesce(m.c, 0) / n.n AS containment FROM (SELECT id, count(*) AS n FROM te GROUP BY id) n LEFT JOIN (SELECT i, max(c) AS c FROM (SELECT x.id AS i, y.id AS j, count(*) AS c FROM te x JOIN tr y ON x.shingle = y.shingle GROUP BY ALL) GROUP BY i) m ON m.i = n.id"
query("best_containment", lambda s, d: best(sides(s, d)).select("id", F.round("containment", 9).alias("containment")),
      f"WITH {_SIDES} SELECT id, round(containment, 9)::DOUBLE AS containment FROM ({_BEST})")


def histogram(s, d):
    """Evaluation records by their best containment, and exact copies of training texts."""
    both = sides(s, d)
    fp = both.select("id", "split", T.fp_lower(F.col("text")).alias("fp"))
    exact = fp.where("split = 'test'").join(fp.where("split = 'train'").select("fp").distinct(), "fp", "left_semi").select("id").withColumn("exact", F.lit(True))
    c = F.col("containment")
    return best(both).join(exact, "id", "left").agg(F.count("*").alias("items"), F.count_if("exact").alias("exact"), *[F.count_if(c >= t - 1e-12).alias(f"at_{int(t * 100)}") for t in (0.5, 0.8, 1.0)])


query("containment_histogram", histogram,
      f"WITH {_SIDES}, b AS ({_BEST}), e AS (SELECT id FROM {RECORDS} WHERE split = 'test' AND sha256({LOWERED}) IN (SELECT sha256({LOWERED}) FROM {RECORDS} WHERE split = 'train')) SELECT count(*) AS items, count(*) FILTER (id IN (SELECT id FROM e)) AS exact, count(*) FILTER (containment >= 0.5 - 1e-12) AS at_50, count(*) FILTER (containment >= 0.8 - 1e-12) AS at_80, count(*) FILTER (containment >= 1 - 1e-12) AS at_100 FROM b")

# ---- components and groups ----

_REACH = f"edges AS (SELECT i, j FROM {DOC_EDGES}), both_ways AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges), reach AS (SELECT i AS id, i AS other FROM both_ways UNION SELECT r.id, b.j FROM reach r JOIN both_ways b ON r.other = b.i), roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"
WITH_ROOTS = f"WITH RECURSIVE {DOC_SH}, {_REACH}"


def doc_groups(s, d) -> DataFrame:
    """(doc_id, root): every labelled or unlabelled text document and its component."""
    c = G.containment_components(doc_sets(s, d)).withColumnRenamed("id", "doc_id")
    return docs(s, d).where("text is not null").join(c, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


GROUPED = f"(SELECT d.*, coalesce(root, doc_id) AS root FROM documents d LEFT JOIN roots ON id = doc_id WHERE text IS NOT NULL)"
query("near_dup_components", lambda s, d: doc_groups(s, d).groupBy("root").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id")),
      f"{WITH_ROOTS} SELECT root, count(*) AS n, max(doc_id) AS last_id FROM {GROUPED} GROUP BY root")


def ledger(s, d):
    g = D.ledger(doc_groups(s, d).withColumn("fp", T.fp_lower(F.col("text"))), "doc_id", "root", "fp", "label")
    return g.select("root", "group_id", F.array_join("member_ids", ",").alias("members"), "size", "label_conflict", "representative_id")


query("component_ledger", ledger,
      f"{WITH_ROOTS} SELECT root, 'g:' || substr(sha256(array_to_string(list_sort(list(fp)), chr(10))), 1, 20) AS group_id, array_to_string(list_sort(list(doc_id::VARCHAR)), ',') AS members, count(*) AS size, count(DISTINCT label) > 1 AS label_conflict, CASE WHEN count(DISTINCT label) <= 1 THEN arg_min(doc_id, (fp, doc_id)) END AS representative_id FROM (SELECT *, sha256({LOWERED}) AS fp FROM {GROUPED}) GROUP BY root")
query("template_concentration", lambda s, d: D.template_concentration(doc_groups(s, d), "lang", "label", "root").withColumn("largest_share", F.round("largest_share", 9)),
      f"{WITH_ROOTS} SELECT lang, label, sum(m)::BIGINT AS rows, count(*) AS groups, max(m) AS largest, round(max(m) / sum(m), 9)::DOUBLE AS largest_share FROM (SELECT lang, label, root, count(*) AS m FROM {GROUPED} GROUP BY ALL) GROUP BY lang, label")
query("template_cap", lambda s, d: D.template_cap(doc_groups(s, d).select("doc_id", "root"), "root", "doc_id", 2).select("doc_id", "root", "pos", "largest_before"),
      f"{WITH_ROOTS} SELECT doc_id, root, pos::INT AS pos, largest_before FROM (SELECT doc_id, root, row_number() OVER (PARTITION BY root ORDER BY doc_id) AS pos, max(n) OVER () AS largest_before FROM (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM {GROUPED})) WHERE pos <= 2")


def domains(s, d) -> DataFrame:
    a = table(s, d, "admitted_components").select("source", "domain")
    return doc_groups(s, d).select(F.col("doc_id").alias("id"), "root", "source", "label").join(F.broadcast(a), "source", "inner")


_DOMAINS = f"(SELECT doc_id AS id, root, g.source, label, domain FROM {GROUPED} g JOIN admitted_components a ON g.source = a.source)"
query("cross_domain_removal", lambda s, d: D.cross_domain_removal(domains(s, d), "root", "domain").select("id", "root", "domain"),
      f"{WITH_ROOTS}, x AS {_DOMAINS} SELECT id, root, domain FROM x WHERE domain = 'S' OR root IN (SELECT root FROM x GROUP BY root HAVING count(DISTINCT domain) = 1)")
query("exact_dedup_conflict", lambda s, d: D.dedup_conflict(records(s, d).withColumn("fp", T.fp_lower(F.col("text"))), "fp", "id", "label"),
      f"SELECT fp, CASE WHEN count(DISTINCT label) <= 1 THEN min(id) END AS kept_id, count(*) AS n, count(DISTINCT label) > 1 AS conflict FROM (SELECT *, sha256({LOWERED}) AS fp FROM {RECORDS}) GROUP BY fp")
query("dedup_prefer_test", lambda s, d: D.dedup_prefer(records(s, d).select("id", "split", T.fp_lower(F.col("text")).alias("fp")), "fp", F.coalesce(F.col("split") == "test", F.lit(False)), "id"),
      f"SELECT fp, id, split FROM (SELECT id, split, sha256({LOWERED}) AS fp FROM {RECORDS}) QUALIFY row_number() OVER (PARTITION BY fp ORDER BY coalesce(split <> 'test', true), id) = 1")
query("split_leakage", lambda s, d: D.leaks(records(s, d).select("split", T.fp_lower(F.col("text")).alias("fp")).where("split is not null"), "fp", "split"),
      f"WITH x AS (SELECT DISTINCT split, sha256({LOWERED}) AS fp FROM {RECORDS} WHERE split IS NOT NULL) SELECT split, count(*) AS shared FROM x WHERE split <> 'train' AND fp IN (SELECT fp FROM x WHERE split = 'train') GROUP BY split")
query("group_spans_splits", lambda s, d: D.spanning_groups(records(s, d).where("group_id is not null"), "group_id", "split"),
      f"SELECT group_id, count(DISTINCT split) AS splits FROM {RECORDS} WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
query("partition_violations", lambda s, d: D.partition_violations(records(s, d).where("split is not null").withColumn("fp", T.fp_lower(F.col("text"))), "id", "fp", "label", "split"),
      f"WITH x AS (SELECT split, label, sha256({LOWERED}) AS fp FROM {RECORDS} WHERE split IS NOT NULL) SELECT split, 'one label' AS problem FROM x GROUP BY split HAVING count(DISTINCT label) < 2 UNION ALL SELECT DISTINCT split, 'repeated text' FROM (SELECT split, fp FROM x GROUP BY ALL HAVING count(*) > 1)")

# ---- embeddings ----

EMB_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


def embedding_counts(s, d):
    p = X.embedding_pairs(table(s, d, "embeddings"), "vec_id", "embedding", 0.25)
    return p.select("i", "j", F.round("cosine", 6).alias("cosine"))


query("embedding_pairs", embedding_counts, f"SELECT i, j, round(cosine, 6) AS cosine FROM ({EMB_PAIRS}) WHERE cosine >= 0.25")
query("embedding_components", lambda s, d: G.components(X.embedding_pairs(table(s, d, "embeddings"), "vec_id", "embedding", 0.45)),
      f"WITH RECURSIVE e AS (SELECT i, j FROM ({EMB_PAIRS}) WHERE cosine >= 0.45), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), reach AS (SELECT i AS id, i AS other FROM b UNION SELECT r.id, b.j FROM reach r JOIN b ON r.other = b.i) SELECT id, min(other) AS root FROM reach GROUP BY id")

# ---- lookup joins ----

query("overlap_audit", lambda s, d: records(s, d).select(T.fp_lower(F.col("text")).alias("fp"), "label", "source").join(lab(s, d).where("id is null or text is not null").select(T.fp_lower(F.col("text")).alias("fp"), F.col("label").alias("other"), F.col("source").alias("other_source")), "fp").groupBy("source").agg(F.count("*").alias("matches"), F.count_if(F.col("label") != F.col("other")).alias("conflicts"), F.countDistinct("other_source").alias("sources")),
      f"WITH a AS (SELECT sha256({LOWERED}) AS fp, label, source FROM {RECORDS}), b AS (SELECT sha256({LOWERED}) AS fp, label AS other, source AS other_source FROM injection_lab WHERE id IS NULL OR text IS NOT NULL) SELECT source, count(*) AS matches, count(*) FILTER (label <> other) AS conflicts, count(DISTINCT other_source) AS sources FROM a JOIN b USING (fp) GROUP BY source")
query("source_intersection", lambda s, d: docs(s, d).select("source").where("source is not null").intersect(records(s, d).where("split = 'test'").select("source")),
      f"SELECT source FROM documents WHERE source IS NOT NULL INTERSECT SELECT source FROM {RECORDS} WHERE split = 'test'")
query("source_difference", lambda s, d: docs(s, d).select("source").where("source is not null").exceptAll(table(s, d, "admitted_components").select("source")).groupBy("source").agg(F.count("*").alias("n")),
      "SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE source IS NOT NULL EXCEPT ALL SELECT source FROM admitted_components) GROUP BY source")
query("key_union", lambda s, d: docs(s, d).select("source").union(lab(s, d).select("source")).distinct(), "SELECT source FROM documents UNION SELECT source FROM injection_lab")


def allowlist(s, d):
    known = F.broadcast(table(s, d, "admitted_components").select("source"))
    admitted = docs(s, d).join(known, "source", "left_semi").groupBy(F.lit("admitted").alias("source")).agg(F.count("*").alias("n"))
    return admitted.unionByName(docs(s, d).join(known, "source", "left_anti").groupBy("source").agg(F.count("*").alias("n")))


query("allowlist_admit", allowlist,
      "SELECT 'admitted' AS source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM admitted_components) UNION ALL SELECT source, count(*) FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM admitted_components) GROUP BY source")
query("aligned_zip", lambda s, d: _zip(s, d), "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS left_missing FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) a FULL JOIN (SELECT doc_id FROM documents WHERE label IS NOT NULL) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")


def _zip(s: SparkSession, d: str) -> DataFrame:
    """Keys that two cells do not share; aligned cells give no rows."""
    a = docs(s, d).where("text is not null").select(F.col("doc_id").alias("a"))
    b = docs(s, d).where("label is not null").select(F.col("doc_id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").where("a is null or b is null").select(F.coalesce("a", "b").alias("doc_id"), F.col("a").isNull().alias("left_missing"))


# ---- splits and samples ----

_D = lambda seed, key: f"sha256('{seed}:' || CAST({key} AS VARCHAR))"
query("stratified_split", lambda s, d: S.stratified_split(labelled(s, d), "doc_id", "label", "s3"),
      f"SELECT doc_id, label, CASE WHEN r <= t THEN 'test' WHEN r <= t + round_even((n - t) * (110 / 546.0::DOUBLE), 0) THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, round_even(n * (116 / 662.0::DOUBLE), 0) AS t FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_D('s3', 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM {DOCS_LABELLED}))")
query("row_split", lambda s, d: S.row_split(labelled(s, d), "doc_id", "label", "rs"),
      f"SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_D('rs', 'doc_id')}, doc_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.3, 0) AS in_test FROM {DOCS_LABELLED}")
_GS = "(SELECT group_id, count(*) AS size, max((label = 1)::INT) AS has_positive, count(*) FILTER (label = 0) AS benign FROM " + RECORDS + " WHERE group_id IS NOT NULL GROUP BY group_id)"


def groups(s, d) -> DataFrame:
    return S.group_sizes(records(s, d).where("group_id is not null"), "group_id", "label")


query("random_group_split", lambda s, d: S.random_group_split(groups(s, d), "group_id", "rg"),
      f"SELECT group_id, has_positive, size, coalesce(sum(size) OVER (PARTITION BY has_positive ORDER BY {_D('rg', 'group_id')}, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.3 * sum(size) OVER (PARTITION BY has_positive) AS in_test FROM {_GS}")
query("target_bank_fill", lambda s, d: S.bank_fill(groups(s, d), "group_id", "bank", 1000),
      f"SELECT group_id, benign, coalesce(sum(benign) OVER (ORDER BY {_D('bank', 'group_id')}, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1000 AS in_bank FROM {_GS} WHERE benign > 0")
query("nested_subsets", lambda s, d: S.nested_subsets(labelled(s, d), "doc_id", [1, 2], [10, 50]).select("seed", "budget", F.col("key").alias("doc_id")),
      f"SELECT seed, budget, doc_id FROM (SELECT seed, doc_id, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || doc_id), doc_id) AS r FROM {DOCS_LABELLED}, (VALUES (1), (2)) s(seed)) JOIN (VALUES (10), (50)) b(budget) ON r <= budget")
query("uniform_draw", lambda s, d: S.uniform_draw(labelled(s, d).select("doc_id", "label"), "doc_id", "ud", 100, strict=False),
      f"SELECT doc_id, label FROM {DOCS_LABELLED} ORDER BY {_D('ud', 'doc_id')}, doc_id LIMIT 100")
query("mix_pools", lambda s, d: S.mix(labelled(s, d).where("label = 0").select("doc_id"), labelled(s, d).where("label = 1").select("doc_id"), "doc_id", "mx", 75, strict=False),
      f"(SELECT doc_id, 'first' AS part FROM {DOCS_LABELLED} WHERE label = 0 ORDER BY {_D('mx:a', 'doc_id')}, doc_id LIMIT 38) UNION ALL (SELECT doc_id, 'second' FROM {DOCS_LABELLED} WHERE label = 1 ORDER BY {_D('mx:b', 'doc_id')}, doc_id LIMIT 37)")
query("largest_remainder_alloc", lambda s, d: S.largest_remainder(records(s, d).groupBy("source").agg(F.count("*").alias("w")).where("source is not null"), "source", "w", 500),
      f"WITH w AS (SELECT source, count(*) AS w FROM {RECORDS} WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT source, round(w / sum(w) OVER () * 500, 12) AS raw FROM w), b AS (SELECT source, raw, floor(raw) AS base FROM r) SELECT source, (base + (row_number() OVER (ORDER BY raw - base DESC, source) <= 500 - sum(base) OVER ())::INT)::BIGINT AS n FROM b")
_CELLS = {"en": 6.0, "de": 2.0, "fr": 1.0, "es": 1.0}


def cell_pool(s, d):
    rows = docs(s, d).where("text is not null").withColumn("fp", T.fp_lower(F.col("text")))
    return S.cell_pool(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang")), "doc_id", "lang", "fp", _CELLS, 60, 20, "cp", strict=False).select(F.col("key").alias("doc_id"), F.col("cell").alias("lang"), "split")


query("cell_sample_pool", cell_pool,
      f"WITH x AS (SELECT fp, min(doc_id) AS doc_id, min(lang) AS lang FROM (SELECT *, sha256({LOWERED}) AS fp FROM documents WHERE text IS NOT NULL) GROUP BY fp) SELECT doc_id, lang, CASE WHEN r <= k THEN 'train' ELSE 'validation' END AS split FROM (SELECT x.*, row_number() OVER (PARTITION BY lang ORDER BY sha256('cp:' || fp), fp) AS r FROM x) JOIN (VALUES ('en', 48, 36), ('de', 16, 12), ('fr', 8, 6), ('es', 8, 6)) c(lang, n, k) USING (lang) WHERE r <= n")
query("candidate_cap_per_cell", lambda s, d: S.cap_per_cell(docs(s, d).select("doc_id", "lang"), "lang", "doc_id", 25),
      "SELECT doc_id, lang, pos::INT AS pos FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents) WHERE pos <= 25")


def loto(s, d):
    rows = S.row_split(labelled(s, d), "doc_id", "label", "lo").join(docs(s, d).select("doc_id", "family"), "doc_id")
    return S.leave_one_out(rows, "family", "label", F.coalesce(F.col("family") == "roleplay", F.lit(False)), "in_test").select("doc_id", "label", "family")


query("loto_mask", loto,
      f"SELECT doc_id, label, family FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_D('lo', 'doc_id')}, doc_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.3, 0) AS in_test FROM {DOCS_LABELLED}) WHERE coalesce(family = 'roleplay', false) OR (label = 0 AND in_test)")
query("index_blocks", lambda s, d: S.index_blocks(docs(s, d).select("doc_id"), "doc_id", 100, 150, 900),
      "SELECT doc_id, ((doc_id - 100) // 150)::BIGINT AS block, 100 + ((doc_id - 100) // 150) * 150 AS lo, least(100 + ((doc_id - 100) // 150 + 1) * 150, 900) AS hi FROM documents WHERE doc_id >= 100 AND doc_id < 900")
_SHARES = {"S-train": 0.55, "S-cal": 0.25, "S-generic-bank": 0.05, "S-test": 0.15}
query("largest_first_allocation", lambda s, d: S.allocate_groups(groups(s, d), "group_id", _SHARES, "alloc"))


def allocation(s, d):
    """Groups and rows that are allocated in each stratum, and whether every partition is
    off its share by no more than the largest group."""
    placed = groups(s, d).join(S.allocate_groups(groups(s, d), "group_id", _SHARES, "alloc"), "group_id")
    placed = placed.withColumn("has_positive", F.coalesce("has_positive", F.lit(-1)))  # no label known
    per = placed.groupBy("has_positive", "partition").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"), F.max("size").alias("largest"))
    want = F.element_at(F.create_map(*[F.lit(x) for p in _SHARES for x in (p, _SHARES[p])]), F.col("partition"))
    whole = per.groupBy("has_positive").agg(F.sum("groups").alias("groups"), F.sum("rows").alias("rows"), F.max("largest").alias("largest"))
    off = per.join(whole.select("has_positive", F.col("rows").alias("all")), "has_positive").groupBy("has_positive").agg(F.max(F.abs(F.col("rows") - want * F.col("all"))).alias("off"))
    return whole.join(off, "has_positive").select("has_positive", "groups", "rows", (F.col("off") <= F.col("largest")).alias("met"))


query("allocation_balance", allocation, f"SELECT coalesce(has_positive, -1) AS has_positive, count(*) AS groups, sum(size)::BIGINT AS rows, true AS met FROM {_GS} GROUP BY 1")


def churn(s, d):
    """How group ids move records between two row splits: removed, changed, shared."""
    a = S.row_split(labelled(s, d), "doc_id", "label", "c1").select("doc_id", F.col("in_test").alias("a"))
    b = S.row_split(labelled(s, d).where("label = 1 or n_chars > 200"), "doc_id", "label", "c2").select("doc_id", F.col("in_test").alias("b"))
    return a.join(b, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") & F.col("b")).alias("shared"))


def _rs(seed: str, where: str = "") -> str:
    return f"(SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY {_D(seed, 'doc_id')}, doc_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.3, 0) AS t FROM {DOCS_LABELLED} {where})"


query("split_churn", churn, f"SELECT count(*) AS n, count(*) FILTER (b.t IS NULL) AS removed, count(*) FILTER (a.t <> b.t) AS changed, count(*) FILTER (a.t AND b.t) AS shared FROM {_rs('c1')} a LEFT JOIN {_rs('c2', 'WHERE label = 1 OR n_chars > 200')} b USING (doc_id)")


def ledger_counts(s, d):
    from ..operators.metrics import partition_ledger

    return partition_ledger(records(s, d), "split", "source", "label", "group_id")


query("partition_ledger", ledger_counts,
      f"SELECT split, source, grouping(source) = 1 AS whole, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS positive, count(DISTINCT group_id) AS groups FROM {RECORDS} GROUP BY GROUPING SETS ((split), (split, source))")


def top_groups(s, d):
    from ..operators.metrics import largest_groups

    return largest_groups(records(s, d).where("group_id is not null"), "group_id", "label", "source")


query("largest_groups", top_groups,
      f"WITH t AS (SELECT group_id, count(*) AS n FROM {RECORDS} WHERE group_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, group_id LIMIT 10), r AS (SELECT t.n, x.* FROM {RECORDS} x JOIN t USING (group_id)), l AS (SELECT group_id, n, array_to_string(list_sort(list(v)), ';') AS labels FROM (SELECT group_id, n, concat_ws('=', label::VARCHAR, count(*)::VARCHAR) AS v FROM r GROUP BY group_id, n, label) GROUP BY ALL), q AS (SELECT group_id, array_to_string(list_sort(list(v)), ';') AS sources FROM (SELECT group_id, concat_ws('=', source, count(*)::VARCHAR) AS v FROM r GROUP BY group_id, source) GROUP BY ALL) SELECT group_id, n, labels, sources FROM l JOIN q USING (group_id)")
