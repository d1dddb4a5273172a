"""Keyword-stuffed and link-list pages (problem 9).

A text is cut into units at line ends and sentence ends, and units into blocks of
about BLOCK_CHARS.  Of each block are measured

* redundancy: its compressed size, links and tags standing for one character each
  and digits for one digit, per byte of the block, divided by the usual ratio: the
  median over all blocks of sentences of this length and language in the corpus,
  drawn towards the median of all languages, and that towards the ratio of plain
  prose (PROSE), as if OVERALL blocks had it: few blocks of a language, or a corpus
  with hardly any sentences, move the ratio little and never in a step;
* sentence density: the share of its characters in units that end like sentences
  and have a sentence's number of words;
* the mean number of words between list separators outside sentences.

The part of a block that is neither sentences nor code is stuffed if the block is
extremely redundant or a list of short items, and its sentence density is low.
Compression alone does not show lists of ever different tags, names or numbers;
the third measure is an addition for these.  A page is found if more than
``share`` of its characters is stuffed, and its stuffed blocks hold at least
LEAST_ITEMS list items or repetitions of words: a word or two ("buy", "Ok, thanks")
are no list, however short or long they are.

Defined results: null and blank texts are not found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import texts_of
from ..scratch import Scratch

BLOCK_CHARS = 1024
SENTENCE_WORDS = (8, 80)
#: Relative compression ratio below which a block is redundant, and the sentence
#: density that confirms it.
REDUNDANT, DENSE = 0.75, 0.75
#: Blocks of sentences that the median of all languages counts for.
OVERALL = 100
#: Items or repeated words that make a list, at least.
LEAST_ITEMS = 5
#: Usual compressed share of plain prose by the binary logarithm of the
#: block's bytes, as measured on public licence texts.
PROSE = {3: 2.0, 4: 1.5, 5: 1.25, 6: 1.03, 7: 0.81, 8: 0.67, 9: 0.57, 10: 0.51, 11: 0.45, 12: 0.40}
#: Mean words of an item up to which a block is a list of short items.
ITEM_WORDS = 5

#: Top-level domains by which a bare host name is known as a link.
DOMAINS = ("com", "org", "net", "info", "io", "de", "fr", "es", "eu", "co", "shop", "online", "site", "example", "test", "invalid")

_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w@.-])[\w-]+(?:\.[\w-]+)*\.(?:" + "|".join(DOMAINS) + r")\b(?:[/?#:][^\s<>\"')\]]*)?", re.I)
_TAG = re.compile(r"#\w+")
_SEPARATOR = re.compile(r"[,;|/•·★☆►»🔥✔➤\n\t!?.<>~*]+|\s-\s")
_DIGITS = re.compile(r"\d+")
_CODE = frozenset("(){}[]=_")
_MAY_LINK = re.compile(r"://|www\.|\.(?:" + "|".join(DOMAINS) + r")\b", re.I)
_UNIT_END = re.compile(r"[.!?…。]+[\"'”»)\]]*(?=[\s,}]|$)|\n|$")
_STOP = re.compile(r"[.!?…。]")
_WORD = re.compile(r"[^\W_]+")
_LINK_SIGN, _TAG_SIGN = "", ""


def _signs(text: str) -> tuple[str, list[int]]:
    """The text with links and tags as single signs, and the lengths these had."""
    sizes: list[int] = []

    def put(sign: str):
        def f(m: re.Match) -> str:
            sizes.append(m.end() - m.start())
            return sign

        return f

    if _MAY_LINK.search(text):
        text = _LINK.sub(put(_LINK_SIGN), text)
    links = sizes
    if "#" in text:
        # signs come in text order, so sizes of both kinds are put in one order
        order: list[int] = []
        left = iter(list(links))

        def both(m: re.Match) -> str:
            if m[0] == _LINK_SIGN:
                order.append(next(left))
                return _LINK_SIGN
            order.append(m.end() - m.start())
            return _TAG_SIGN

        text = re.sub(_LINK_SIGN + "|" + _TAG.pattern, both, text)
        return text, order
    return text, links


def blocks(text: str) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(bytes, characters, characters in sentences, characters in other units that
    are no code, words and list items of these, compressed bytes, words of these that
    occurred before) of each block."""
    text = text.replace(_LINK_SIGN, " ").replace(_TAG_SIGN, " ")
    shaped, sizes = _signs(text)
    at = 0
    out: list[tuple[int, int, int, int, int, int, int, int]] = []
    held: list[str] = []
    distinct: set[str] = set()
    chars = good = loose = words_of = items = extra = 0

    def close() -> None:
        nonlocal held, chars, good, loose, words_of, items, extra
        whole = "".join(held)
        raw = _DIGITS.sub("0", whole).encode("utf-8", "surrogatepass")
        out.append((len(whole.encode("utf-8", "surrogatepass")) + extra, chars, good, loose, words_of, items, len(zlib.compress(raw, 6)), words_of - len(distinct)))
        distinct.clear()
        held, chars, good, loose, words_of, items, extra = [], 0, 0, 0, 0, 0, 0

    last = 0
    for m in _UNIT_END.finditer(shaped):
        first, last = last, m.end()
        for begin in range(first, last, BLOCK_CHARS):
            unit = shaped[begin : min(last, begin + BLOCK_CHARS)]
            held.append(unit)
            body = unit.strip()
            if not body:
                continue
            signs = body.count(_LINK_SIGN) + body.count(_TAG_SIGN) if sizes else 0
            linked = sum(sizes[at : at + signs])
            at += signs
            size = len(body) - signs + linked
            extra += linked - signs
            chars += size
            found = _WORD.findall(body)
            words = len(found)
            if _STOP.search(body, len(body) - 3 if len(body) > 3 else 0) and SENTENCE_WORDS[0] <= words <= SENTENCE_WORDS[1] and signs * 4 <= words:
                good += size - linked
            elif signs or sum(map(_CODE.__contains__, body)) < max(2, 0.15 * words):
                loose += size
                words_of += words
                distinct.update(map(str.casefold, found))
                items += max(signs, sum(1 for x in _SEPARATOR.split(body) if x.strip()))
            if chars >= BLOCK_CHARS:
                close()
    if chars:
        close()
    return out


def language(column: Column) -> Column:
    """Two lower-case letters of a language code, else ``und``."""
    code = F.lower(F.regexp_extract(F.trim(F.coalesce(column, F.lit(""))), r"^([A-Za-z]{2})(?:[-_]\w+)?$", 1))
    return F.when(code == "", F.lit("und")).otherwise(code)


def measured(df: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """(id, lang, size, chars, good, loose, item, entries, ratio) of every block of every
    text; entries are its list items or repeated words, whichever are more."""
    source = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), language(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, row = [], []
            for i, t in enumerate(texts_of(batch.column("text"))):
                each = blocks(t)
                found += each
                row += [i] * len(each)
            if not found:
                continue
            f = np.array(found, np.int64)
            at = pa.array(np.array(row, np.int64))
            size = np.log2(np.maximum(f[:, 0], 1)).round(0).astype(np.int32)
            columns = [batch.column("id").take(at), batch.column("lang").take(at), pa.array(size), pa.array(f[:, 1]), pa.array(f[:, 2]), pa.array(f[:, 3])]
            columns += [pa.array(f[:, 4] / np.maximum(f[:, 5], 1)), pa.array(np.maximum(f[:, 5], f[:, 7])), pa.array(f[:, 6] / np.maximum(f[:, 0], 1))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "size", "chars", "good", "loose", "item", "entries", "ratio"])

    return source.mapInArrow(run, f"id {kind}, lang string, size int, chars bigint, good bigint, loose bigint, item double, entries bigint, ratio double")


def usual_ratio(own: Column, n: Column, overall: Column) -> Column:
    """Median of n blocks of a language, drawn towards the overall one: no step at any n."""
    overall = F.coalesce(overall, F.lit(1.0))
    return F.when(n > 0, (own * n + overall * OVERALL) / (n + OVERALL)).otherwise(overall)


def stuffed_pages(df: DataFrame, id: str, text: str, lang: str, share: float = 2 / 3) -> DataFrame:
    """(id, stuffed, redundant): the pages of whose characters more than ``share`` are
    stuffed; redundant is the share in blocks that are so by compression alone."""
    scratch = Scratch(df.sparkSession)
    parts = scratch.keep(measured(df, id, text, lang))
    # the usual ratio comes from blocks that are sentences; at most 677 languages times 64 sizes
    prose = parts.where(F.col("good") >= F.lit(DENSE) * F.col("chars"))
    median = lambda *by: prose.groupBy(*by).agg(F.percentile_approx("ratio", 0.5, 1000).alias("own"), F.count("*").alias("n"))
    plain = F.element_at(F.create_map(*[F.lit(x) for k in PROSE for x in (k, PROSE[k])]), F.least(F.greatest("size", F.lit(min(PROSE))), F.lit(max(PROSE))))
    known = parts.join(F.broadcast(median("size").toDF("size", "any", "n_any")), "size", "left").withColumn("overall", usual_ratio(F.col("any"), F.col("n_any"), plain))
    known = known.join(F.broadcast(median("lang", "size")), ["lang", "size"], "left")
    redundant = F.col("ratio") / usual_ratio(F.col("own"), F.col("n"), F.col("overall")) < REDUNDANT
    flagged = redundant | (F.col("item") <= ITEM_WORDS)
    sparse = F.col("good") < F.lit(DENSE) * F.col("chars")
    part = lambda condition, of: F.sum(F.when(condition & sparse, F.col(of)).otherwise(0))
    whole = known.groupBy("id").agg((part(flagged, "loose") / F.sum("chars")).alias("stuffed"), (part(redundant, "loose") / F.sum("chars")).alias("redundant"), part(flagged, "entries").alias("entries"))
    return whole.where((F.col("stuffed") > F.lit(share)) & (F.col("entries") >= LEAST_ITEMS)).select("id", "stuffed", "redundant")
