"""Queries of fitted models, character similarity, pools and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng, text as T
from ..operators import charcosine as C, pools as P, sampling as S, similarity as X
from ..streaming.windows import windowed
from .corpus_queries import labelled, records
from .registry import docs, query, table
from .text_queries import H


def tfidf_lr(s, d):
    """Detector fitted on a row split of the labelled documents; scores of its test side."""
    from ..operators.features import Detector

    rows = labelled(s, d).select("doc_id", "text", "label").join(S.row_split(labelled(s, d), "doc_id", "label", "lr").select("doc_id", "in_test"), "doc_id")
    model = Detector("word").fit(rows.where("not in_test"), "doc_id", "text", "label")
    return model.score(rows.where("in_test"), "doc_id", "text").select("doc_id", "label", "score")


query("tfidf_lr_scores", tfidf_lr)


def char_pairs(s, d):
    """Benign and positive labelled documents with character TF-IDF cosine >= 0.9."""
    texts = C.texts_of(labelled(s, d), "doc_id", T.lowered(F.col("text")))
    return C.cosine_pairs(texts, None, 0.9, 3, 5, 50_000, sublinear=False).select("i", "j", F.round("cosine", 6).alias("cosine"))


query("char_tfidf_pairs", char_pairs)
query("char_tfidf_keep_mask", lambda s, d: P.semantic_far(labelled(s, d).where("label = 1").select(F.col("doc_id").alias("id"), "text"), labelled(s, d).where("label = 0").select(F.col("doc_id").alias("id"), "text"), "id", "text"))
query("edit_similarity_pairs", lambda s, d: X.edit_pairs(table(s, d, "admitted_components"), "source", F.col("source"), 0.75).withColumn("ratio", F.round("ratio", 6)))


def pools(s, d):
    domains = table(s, d, "admitted_components").select("source", "domain")
    rows = records(s, d).where("label is not null").join(F.broadcast(domains), "source").select("id", "text", "label", "source", "domain")
    return P.build_pools(rows).groupBy("partition", "domain").agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups"))


query("pool_build", pools)
query("event_windows", lambda s, d: windowed(table(s, d, "events"), "ts", "value", "event_type").withColumns({"mean": F.round("mean", 8), "flagged": F.round("flagged", 9)}),
      "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type AS kind, count(*) AS n, round(avg(value), 8) AS mean, round(avg((value >= 50)::INT::DOUBLE), 9) AS flagged FROM events GROUP BY ALL")


def drift(s, d):
    """Largest change of a score between two runs of the same rows."""
    a = docs(s, d).select("doc_id", rng.uniform("run1", "doc_id").alias("a"))
    b = docs(s, d).select("doc_id", rng.uniform("run2", "doc_id").alias("b"))
    return a.join(b, "doc_id").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 9).alias("largest"))


query("replication_drift", drift, f"SELECT round(max(abs({H(chr(39) + 'run1' + chr(39), 'doc_id')} - {H(chr(39) + 'run2' + chr(39), 'doc_id')}) / 4294967296.0), 9)::DOUBLE AS largest FROM documents")
