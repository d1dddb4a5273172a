"""Duplicates hidden by formatting (problem 4).

1. Each text gets its canonical hashes (canon.py); only those are kept.
2. Bloom filters of once- and repeatedly-seen hashes are built in partitions and
   merged (bloom.py).
3. Only rows whose hash may be repeated are shuffled and grouped exactly on
   128-bit hashes; all others are singletons.

Texts are copies if they have the same words in the same order or, both being
made of named fields, the same fields with the same words.  The first relation
links by ``words``, the second by ``fields``; where one word sequence is read as
two different field sets, their classes are joined by Hash-to-Min.

Defined results: a null id is no record and is left out; a repeated id is one
record; null, empty and wordless texts are copies of nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import join_unique
from . import bloom
from .canon import canonical
from .components import hash_to_min

#: Rows a filter is built for; beyond it the hash space is done range by range, each
#: reading its own slice of the hashes.
RANGE_HASHES = 25_000_000


class LayoutCopies:
    """Copies among the records of a table.

    ``rows``: (id, words, fields, w, f, n_words) of every delivered row with an id.
    ``classes``: (words, fields, w, n, kept_id, n_copies), one row for each form of a
    text that occurs in two or more records; n counts its records, n_copies those
    of the whole class.
    """

    def __init__(self, df: DataFrame, id: str, text: str, scratch: Scratch | None = None, extra: list[str] | None = None) -> None:
        self.scratch = scratch = scratch or Scratch(df.sparkSession)
        source = df.select(F.col(id).alias("id"), *[F.col(c) for c in extra or []], F.col(text).alias("text")).where("id is not null")
        self.rows = scratch.keep(canonical(source, "text", ["id", *(extra or [])]))
        self.repeats = scratch.keep(self._possible_repeats())
        self._n = self.repeats.count()
        self.classes = scratch.keep(self._classes())

    def _possible_repeats(self) -> DataFrame:
        """Distinct (id, words, fields, w) of rows whose hash may occur twice."""
        kind = self.rows.schema["id"].dataType.simpleString()
        each = self.rows.where("n_words > 0").select("id", "words", "fields", "w", F.explode(F.array_compact(F.array("w", "f"))).alias("h"))
        n = self.rows.count()
        ranges = max(1, -(-n // RANGE_HASHES))
        if ranges > 1:
            # sorted files let each range read no more than its own pages
            each = self.scratch.keep(each.sortWithinPartitions("h"))
        step, out = -(-(1 << 64) // ranges), None
        for r in range(ranges):
            low, high = r * step - (1 << 63), min((r + 1) * step, 1 << 64) - (1 << 63) - 1
            part = each.where(F.col("h").between(low, high))
            seen = bloom.build(part.select("h"), "h", max(1, n // ranges))
            part = part.mapInArrow(_keep_possible(seen), f"id {kind}, words binary, fields binary, w bigint")
            out = part if out is None else out.unionByName(part)
        return out.distinct()

    def _classes(self) -> DataFrame:
        forms = self.scratch.keep(self.repeats.groupBy("words", "fields", "w").agg(F.min("id").alias("least"), F.count("*").alias("n")))
        # the class of a word sequence: the field set it is read as, if it is
        read = forms.where("fields is not null").groupBy("words").agg(F.min("fields").alias("as_fields"), F.max("fields").alias("other"))
        keyed = forms.join(read, "words", "left").select("words", "fields", "w", "least", "n", F.coalesce("fields", "as_fields", "words").alias("key"))
        torn = read.where("other <> as_fields").select(F.hex("as_fields").alias("a"), F.hex("other").alias("b"))
        if torn.take(1):
            every = forms.where("fields is not null").join(read.where("other <> as_fields"), "words").select(F.hex("as_fields").alias("a"), F.hex("fields").alias("b"))
            joined = hash_to_min(every, scratch=self.scratch)
            keyed = keyed.join(joined.select(F.unhex("id").alias("key"), F.unhex("group_id").alias("root")), "key", "left").withColumn("key", F.coalesce("root", "key")).drop("root")
        whole = keyed.groupBy("key").agg(F.min("least").alias("kept_id"), F.sum("n").alias("n_copies")).where("n_copies > 1")
        return keyed.join(whole, "key").select("words", "fields", "w", "n", "kept_id", "n_copies")

    def copies(self) -> DataFrame:
        """(kept_id, copy_id) of every record that is a copy of a smaller id."""
        known = self.classes.drop("w").withColumn("fields", F.coalesce("fields", F.lit(b"")))
        rows = self.repeats.withColumn("fields", F.coalesce("fields", F.lit(b"")))
        return join_unique(rows, known, ["words", "fields"], "n", self._n).where("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))

    def records(self) -> DataFrame:
        """(kept_id, n_copies): one row per class of copies, singletons and texts
        without words included, with the number of records it stands for."""
        ids = self.rows.select("id").distinct()
        single = ids.join(self.copies().select(F.col("copy_id").alias("id")), "id", "left_anti")
        many = self.classes.select("kept_id", "n_copies").distinct()
        return single.join(many, single.id == many.kept_id, "left").select(F.col("id").alias("kept_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _keep_possible(seen: bloom.Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = seen.holds(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            if hit.any():
                yield batch.select(["id", "words", "fields", "w"]).filter(pa.array(hit))

    return run
