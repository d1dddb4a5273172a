"""Canonical hashes of texts: word sequence, and named fields.

``words`` is a 128-bit hash of the folded word sequence.  A text made of named
fields also gets ``fields``, a 128-bit hash of its sorted (field name, word
sequence) pairs, which does not depend on the fields' order or notation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import binary16, texts_of, with_nulls
from ..functions.wordkernel import Words, mix64, sequence_hash, split_words

#: The field names of the corpus.
FIELD_NAMES = ("instruction", "input", "context", "tone", "audience")

SCHEMA = "words binary, fields binary, w bigint, f bigint, n_words int"


def field_marks(text: str, mark: re.Pattern) -> list[tuple[str, int, int]]:
    """(name, begin of value, end of value) of each field of a text made of named
    fields, else []: it must begin with a field and hold two or more."""
    found = list(mark.finditer(text))
    if len(found) < 2 or text[: found[0].start()].strip(" \t\r\n{[(*#<-"):
        return []
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m["name"], m.end(), e) for m, e in zip(found, ends)]


def mark_pattern(names: tuple[str, ...]) -> re.Pattern:
    """Begin of a field in a folded text: at the start, on a new line or after a
    separator; the name may be quoted or decorated and ends in ``:`` or ``=``."""
    return re.compile(r"(?:^|[\n\r|;,{\[>])[ \t\r\n]*[\"'*_<\[#(-]*[ \t]*(?P<name>" + "|".join(names) + r")[ \t]*[\"'*_>\])]*[ \t]*[:=]")


class Canon:
    """Canonical hashes of batches of texts."""

    def __init__(self, names: tuple[str, ...] = FIELD_NAMES) -> None:
        self.names, self.mark = names, mark_pattern(names)

    def run(self, texts: list[str | None], w: Words, lanes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Two 64-bit word hashes, two 64-bit field hashes and whether there are
        fields, for the run of texts in w."""
        seq = [w.sequence_hashes(h, k) for k, h in enumerate(lanes)]
        named = [np.zeros(w.n_texts, np.uint64) for _ in lanes]
        has = np.zeros(w.n_texts, bool)
        for j in range(w.n_texts):
            text = texts[w.first + j]
            if not text or not any(c in text for c in ":="):
                continue
            folded = text.casefold()
            if sum(n in folded for n in self.names) < 2:
                continue
            marks = field_marks(folded, self.mark)
            if not marks:
                continue
            has[j] = True
            base, words = int(w.text_start[j]), slice(int(w.word_from[j]), int(w.word_from[j + 1]))
            starts = w.start[words] - base
            cut = np.array([(np.searchsorted(starts, b), np.searchsorted(starts, e)) for _, b, e in marks]) + words.start
            label = np.array([self.names.index(n) for n, _, _ in marks], np.uint64)
            for k, h in enumerate(lanes):
                each = np.array([sequence_hash(h, np.array(c), k)[0] for c in cut])
                with np.errstate(over="ignore"):
                    pairs = np.sort(mix64(each + label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)))
                named[k][j] = sequence_hash(pairs, np.array([0, len(pairs)]), 2 + k)[0]
        return seq, named, has


def canonical(df: DataFrame, text: str, keep: list[str], names: tuple[str, ...] = FIELD_NAMES) -> DataFrame:
    """The kept columns with ``words``, ``fields`` (null if the text is not made of
    named fields), their lower halves ``w`` and ``f``, and ``n_words`` of each text.  Null, empty and wordless texts get
    n_words 0."""
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column("_text"))
            parts = []
            for w in split_words(texts):
                lanes = [w.hashes(0), w.hashes(1)]
                parts.append((*canon.run(texts, w, lanes), w.counts))
            seq = [np.concatenate([p[0][k] for p in parts]) for k in (0, 1)]
            named = [np.concatenate([p[1][k] for p in parts]) for k in (0, 1)]
            has, counts = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [binary16(*seq), with_nulls(binary16(*named), ~has), pa.array(seq[1].view(np.int64)), with_nulls(pa.array(named[1].view(np.int64)), ~has), pa.array(counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "words", "fields", "w", "f", "n_words"])

    return source.mapInArrow(run, schema)
