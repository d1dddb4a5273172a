"""Text rewriting: trigger substitution, framing prefixes and attack variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.framing import CELLS, SHORT
from ..functions.text import fp_lower

#: Trigger phrases in the order they are replaced: the alternatives of
#: the first word, the rest of the pattern, and the replacement.  The first word stands
#: apart because a match that begins in upper case is replaced in upper case.
SUBSTITUTIONS = (
    (("ignore", "disregard", "forget"), r"\s+(all\s+)?(of\s+)?(the\s+|your\s+|any\s+|my\s+)?(previous|prior|above|earlier|preceding|initial|original)\s+(instructions?|directions?|rules|prompts?|guidelines|commands?)", "set aside the earlier guidance"),
    (("system",), r"\s+prompts?\b", "setup text"),
    (("prompt",), r"\s+injections?\b", "message trick"),
    (("jailbreak",), r"(s|ed|ing)?\b", "unlock"),
    (("developer",), r"\s+mode\b", "builder setting"),
    (("do",), r"\s+anything\s+now\b", "do whatever is asked"),
    (("unrestricted", "unfiltered", "uncensored"), r"\b", "unlimited"),
    (("restrictions",), r"\b", "limits"),
    (("restriction",), r"\b", "limit"),
    (("bypass",), r"(es|ed|ing)?\b", "get around"),
    (("overrid",), r"(e|es|ing)\b", "replace"),
    (("disregard",), r"(s|ed|ing)?\b", "set aside"),
    (("ignor",), r"(e|es|ed|ing)\b", "skip"),
    (("instructions",), r"\b", "guidance"),
    (("instruction",), r"\b", "direction"),
    (("guidelines",), r"\b", "conventions"),
    (("polic",), r"(y|ies)\b", "conventions"),
    (("filter",), r"s?\b", "screens"),
    (("reveal",), r"(s|ed|ing)?\b", "show"),
    (("confidential",), r"\b", "private"),
    (("secret",), r"\b", "private"),
    (("pretend",), r"\s+(to\s+be|you\s+are)\b", "imagine being"),
    (("prompt",), r"s?\b", "message"),
)

ATTACK_CELLS = ("academic", "neutral", "security")


def _passes(words: tuple[str, ...], rest: str, replacement: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """A pattern for matches that begin in upper case and one for the others."""
    upper = "|".join(f"{w[0].upper()}(?i:{w[1:]})" for w in words)
    lower = "|".join(words)
    return (rf"\b(?:{upper})(?i:{rest})", replacement[0].upper() + replacement[1:]), (rf"(?i)\b(?:{lower}){rest}", replacement)


def has_trigger(text: Column, table=SUBSTITUTIONS) -> Column:
    """Some pattern matches; one scan that stops at the first hit."""
    return text.rlike("(?i)" + "|".join(rf"\b(?:{'|'.join(words)}){rest}" for words, rest, _ in table))


def substitute(text: Column, table=SUBSTITUTIONS) -> Column:
    """All trigger phrases replaced, table order; a replacement begins in upper case
    where its match does.  No replacement matches its own pattern, so two passes a
    pattern do."""
    out = text
    for row in table:
        for pattern, replacement in _passes(*row):
            out = F.regexp_replace(out, pattern, replacement)
    return F.when(has_trigger(text, table), out).otherwise(text)


def substituted(df: DataFrame, text: str, out: str = "sub_text", count: str = "n_subs", table=SUBSTITUTIONS) -> DataFrame:
    """Adds the substituted text and the number of replacements (null for null).

    Text and count are carried from pattern to pattern as columns of single
    projections, so each pattern runs once for the text and once for the count.  A text
    that no pattern matches goes through the chain as null and costs one scan.
    """
    hit = f"{out}_hit"
    df = df.withColumn(hit, has_trigger(F.col(text), table)).withColumns({out: F.when(F.col(hit), F.col(text)), count: F.when(F.col(text).isNotNull(), F.lit(0))})
    for row in table:
        (_, _), (pattern, _) = _passes(*row)
        step = F.col(out)
        for p, r in _passes(*row):
            step = F.regexp_replace(step, p, r)
        df = df.withColumns({count: F.col(count) + F.coalesce(F.regexp_count(F.col(out), F.lit(pattern)), F.lit(0)), out: step})
    return df.withColumn(out, F.coalesce(out, text)).drop(hit)


def prefixes(spark, cells: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(cell, k, prefix) of each cell."""
    rows = [(c, k, p) for c, ps in (cells or CELLS).items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, "cell string, k bigint, prefix string")


def framed(df: DataFrame, key: str, text: str, seed: str, cells: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One framed text per row and cell, the prefix drawn by the row's key.  The
    prefixes are constants of the plan, so nothing is joined."""
    cells = cells or CELLS
    lists = F.array(*[F.struct(F.lit(c).alias("cell"), F.array(*[F.lit(p) for p in ps]).alias("list")) for c, ps in cells.items()])
    each = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(lists).alias("c"))
    k = rng.bucket(F.size("c.list").cast("bigint"), F.lit(seed), F.col("c.cell"), "key")
    return each.withColumn("k", k).select("key", F.col("c.cell").alias("cell"), "k", F.concat(F.element_at("c.list", (F.col("k") + 1).cast("int")), F.col("text")).alias("framed"))


def framed_short(df: DataFrame, key: str, text: str, seed: str) -> DataFrame:
    """(key, k, framed): each text behind one of the five short prefixes, drawn by key."""
    return framed(df, key, text, seed, {"short": SHORT}).select("key", "k", "framed")


def length_matched(df: DataFrame, text: str, reference: str, slack: float = 0.2) -> DataFrame:
    """Rows whose text's length differs from the reference text's by at most ``slack``
    of the latter; rows with a null text are left out."""
    return df.where(F.abs(F.length(text) - F.length(reference)) <= F.lit(slack) * F.length(reference))


def benign_index(labels: Column, names: tuple[str, ...]) -> Column:
    """Key of the only entry of map<int, string> whose label, without blanks around it and
    in lower case, is one of the names; null if none or several are."""
    hits = F.map_keys(F.map_filter(labels, lambda _, v: F.lower(F.trim(v)).isin(*names)))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def attack_variants(df: DataFrame, key: str, text: str, sub_text: str) -> DataFrame:
    """(key, kind, k, variant): plain, substituted, every prefix of the attack cells,
    and the academic prefixes on the substituted text: 98 texts a row, made by one
    explode over constants."""
    kinds = [("plain", 0, "", False), ("sub", 0, "", True)]
    kinds += [(c, k, p, False) for c in ATTACK_CELLS for k, p in enumerate(CELLS[c])]
    kinds += [("sub_academic", k, p, True) for k, p in enumerate(CELLS["academic"])]
    table = F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).cast("bigint").alias("k"), F.lit(p).alias("prefix"), F.lit(s).alias("sub")) for a, b, p, s in kinds])
    each = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(sub_text).alias("sub_text"), F.explode(table).alias("v"))
    return each.select("key", F.col("v.kind").alias("kind"), F.col("v.k").alias("k"), F.concat("v.prefix", F.when(F.col("v.sub"), F.col("sub_text")).otherwise(F.col("text"))).alias("variant"))


def to_hard_negatives(df: DataFrame, text: str, cell: str, source: str, arm: str, split: str) -> DataFrame:
    """The ten-column frame of benign hard negatives and its label; columns that have
    one value for all rows are literals."""
    fp = fp_lower(F.col(text))
    return df.select(F.col(text).alias("text"), F.lit(0).alias("label"), F.lit(f"pool_{arm}").alias("source_type"), F.concat(F.lit("hn_"), F.substring(fp, 1, 16)).alias("parent_seed_id"), F.lit(split).alias("split"), F.col(cell).alias("hardneg_category"), F.col(source).alias("source"), F.lit("none").alias("attack_type"), F.lit("en").alias("language"), F.lit("none").alias("obfuscation"))
