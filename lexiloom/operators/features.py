"""Word and character TF-IDF features and a balanced logistic detector on MLlib."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fp_lower
from ..scratch import Scratch
from .metrics import average_precision, roc_auc, slice_metrics
from .similarity import char_wb

WORD_TERMS, CHAR_TERMS = 30_000, 50_000


def word_terms(df: DataFrame, id: str, normal: Column) -> DataFrame:
    """(id, term, tf) of words of two or more characters and their pairs."""
    w = df.select(F.col(id).alias("id"), F.filter(F.regexp_extract_all(normal, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) >= 2).alias("w"))
    pairs = F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("w", i), F.try_element_at(F.col("w"), i + 1)))).otherwise(F.array().cast("array<string>"))
    return w.select("id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


class Detector:
    """TF-IDF blocks (words, characters or both), each L2-normalised, and a logistic
    regression with balanced class weights.  Fitted on training rows only."""

    def __init__(self, blocks: str = "combined", c: float = 1.0) -> None:
        self.blocks, self.c = ("word", "char") if blocks == "combined" else (blocks,), c

    def _terms(self, df: DataFrame, id: str, text: str) -> DataFrame:
        parts = []
        normal = F.lower(text)
        if "word" in self.blocks:
            parts.append(word_terms(df, id, normal).withColumn("block", F.lit("word")))
        if "char" in self.blocks:
            parts.append(char_wb(df, id, normal, 3, 5).withColumn("block", F.lit("char")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _features(self, df: DataFrame, id: str, text: str) -> DataFrame:
        known = self._terms(df, id, text).join(F.broadcast(self.vocabulary), ["block", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", "block")))
        size = self.size
        vector = F.udf(lambda cells: SparseVector(size, sorted((c[0], c[1]) for c in cells or [])), VectorUDT())
        rows = known.withColumn("w", F.col("w") / norm).groupBy("id").agg(F.collect_list(F.struct("at", "w")).alias("cells"))
        return df.join(rows.withColumnRenamed("id", id), id, "left").withColumn("features", vector("cells")).drop("cells")

    def fit(self, df: DataFrame, id: str, text: str, label: str, weight: str | None = None) -> "Detector":
        n = df.count()
        terms = self._terms(df, id, text).groupBy("block", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        terms = Scratch(df.sparkSession).keep(terms)
        best = [terms.where(F.col("block") == b).orderBy(F.desc("total"), "term").limit(WORD_TERMS if b == "word" else CHAR_TERMS) for b in self.blocks]
        # ranks of at most WORD_TERMS and CHAR_TERMS rows
        top = best[0] if len(best) == 1 else best[0].unionByName(best[1])
        top = top.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("total"), "term")))
        # vocabulary: at most WORD_TERMS + CHAR_TERMS rows
        offset = F.when(F.col("block") == "word", 0).otherwise(WORD_TERMS if "word" in self.blocks else 0)
        self.vocabulary = top.select("block", "term", (F.col("r") - 1 + offset).cast("int").alias("at"), (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
        self.vocabulary = Scratch(df.sparkSession).keep(self.vocabulary)
        self.size = (WORD_TERMS if "word" in self.blocks else 0) + (CHAR_TERMS if "char" in self.blocks else 0)
        own = F.col(weight) if weight else F.lit(1.0)
        classes = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
        if not classes.p or not classes.q:
            raise ValueError("training needs both labels")
        balance = F.when(F.col(label) == 1, n / (2 * classes.p)).otherwise(n / (2 * classes.q))
        train = self._features(df, id, text).select("features", F.col(label).cast("double").alias("label"), (own * balance).alias("w")).cache()
        total = train.agg(F.sum("w")).first()[0]
        self.model = LogisticRegression(weightCol="w", regParam=1 / (self.c * total), standardization=False, maxIter=200, tol=1e-6).fit(train)
        train.unpersist()
        return self

    def score(self, df: DataFrame, id: str, text: str) -> DataFrame:
        """The rows with ``score``, the probability of label 1."""
        out = self.model.transform(self._features(df, id, text))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def evaluate(self, df: DataFrame, id: str, text: str, label: str, split: str, source: str, family: str, threshold: float, development: DataFrame, new_sources: bool = False, new_families: bool = False) -> tuple[DataFrame, DataFrame, dict]:
        """Scores of external test rows, their metrics by slice, and the report's head:
        kind, shared sources, area under the curve, average precision.

        Rows of another split, a text that development rows have too, and with
        ``new_sources`` or ``new_families`` a source or a positives' family that these
        have (or a positive without family) are errors.
        """
        def refuse(bad: DataFrame, why: str) -> None:
            for row in bad.limit(1).collect():
                raise ValueError(f"{why}: {row[0]}")

        refuse(df.where(~F.col(split).eqNullSafe("test")).select(id), "no test row")
        fp = lambda x: x.select(fp_lower(F.col(text)).alias("fp"))
        refuse(fp(df).join(fp(development).distinct(), "fp", "left_semi"), "text of a development row")
        shared = sorted(r[0] for r in df.select(source).intersect(development.select(source)).where(F.col(source).isNotNull()).limit(1000).collect())  # names for a report
        if new_sources and shared:
            raise ValueError(f"sources of development rows: {shared}")
        if new_families:
            positive = lambda x: x.where(F.col(label) == 1).select(F.coalesce(family, F.lit("unknown")).alias("f"))
            refuse(positive(df).unionByName(positive(development)).where("f = 'unknown'"), "positive without family")
            refuse(positive(df).intersect(positive(development)), "family of development rows")
        scored = Scratch(df.sparkSession).keep(self.score(df, id, text))
        head = {"kind": "same-source external" if shared else "source-held-out", "shared_sources": shared, "families_checked": new_families, "threshold": threshold}
        head |= {"auc": roc_auc(scored, "score", label).first()[0], "average_precision": average_precision(scored, "score", label).first()[0]}
        return scored, slice_metrics(scored, "score", label, threshold, source, family), head

    def save(self, path: str, threshold: float) -> None:
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        self.model.save(f"{path}/model")
        spark.createDataFrame([(threshold, self.size, ",".join(self.blocks))], "threshold double, size int, blocks string").write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple["Detector", float]:
        meta = spark.read.parquet(f"{path}/meta").first()
        d = cls()
        d.blocks, d.size = tuple(meta.blocks.split(",")), meta.size
        d.vocabulary, d.model = spark.read.parquet(f"{path}/vocabulary"), LogisticRegressionModel.load(f"{path}/model")
        return d, meta.threshold
