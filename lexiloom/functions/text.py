"""Text expressions: normal forms, fingerprints, filters and tokens."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space as a regular expression class that Java and RE2 both read.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Phrases by which a text is taken for an attack, as patterns.
ATTACK_MARKERS = (
    r"\bignore (all )?(the )?(previous|prior|above) (instructions|prompts?)\b",
    r"\bdisregard (all )?(the )?(previous|prior|above)\b",
    r"\bforget (all )?(your )?(previous|prior) instructions\b",
    r"\bdeveloper mode\b",
    r"\bdo anything now\b",
    r"\bDAN\b",
    r"\bjailbreak(ed)? mode\b",
    r"\bwithout (any )?(restrictions|filters?|limitations)\b",
    r"\bno (restrictions|filters?|limitations|rules)\b",
    r"\buncensored\b",
    r"\bunfiltered\b",
    r"\bstay in character\b",
    r"\breveal (your|the) system prompt\b",
)
#: German function words that mark a text as not English.
GERMAN_WORDS = (" der ", " die ", " und ", " ist ", " nicht ", " ich ", " sie ", " das ")
#: Beginnings of refusals.
REFUSAL = r"^\s*(i'?m sorry|i am sorry|i cannot|i can'?t|as an ai|sorry, but)"
LEAST_CHARS, MOST_CHARS = 20, 1000
SANITISED_CHARS = 8000


def collapse(text: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def lowered(text: Column) -> Column:
    """collapse and lower case: the cheap normal form."""
    return F.lower(collapse(text))


@F.pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """NFKC, full case folding, white space collapsed: the exact normal form.  Spark
    has no NFKC, so this is an Arrow-batched UDF; null stays null."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fp_nfkc(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def fp_lower(text: Column) -> Column:
    return F.sha2(lowered(text), 256)


def fp_exact(text: Column) -> Column:
    """SHA-256 of the text as it is; '' for null and blank texts."""
    return F.when(F.length(collapse(F.coalesce(text, F.lit("")))) == 0, "").otherwise(F.sha2(text, 256))


def markers_any(text: Column, markers: tuple[str, ...] = ATTACK_MARKERS) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{m})" for m in markers))


def length_ok(text: Column) -> Column:
    return F.length(collapse(text)).between(LEAST_CHARS, MOST_CHARS)


def any_category(moderation: Column) -> Column:
    """True if any category of any entry of array<struct<categories: map<string, boolean>>>
    is set; null and empty arrays are not flagged."""
    return F.coalesce(F.exists(moderation, lambda e: F.coalesce(F.exists(F.map_values(e["categories"]), lambda v: F.coalesce(v, F.lit(False))), F.lit(False))), F.lit(False))


def hygienic(text: Column, flagged: Column) -> Column:
    """Length in the window, not moderated, no attack marker."""
    t = collapse(text)
    return F.length(t).between(LEAST_CHARS, MOST_CHARS) & ~flagged & ~markers_any(t)


def has_term(text: Column, term: str) -> Column:
    """The term in any case with no letter or digit of a-z0-9 beside it."""
    return F.lower(text).rlike(r"(^|[^a-z0-9])" + re.escape(term.lower()) + r"([^a-z0-9]|$)")


def is_english(text: Column) -> Column:
    """At least 95 % of the letters are ASCII and fewer than two German function words
    occur; false without letters."""
    ascii_letters = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    german = sum((F.instr(padded, w) > 0).cast("int") for w in GERMAN_WORDS)
    return F.coalesce((letters > 0) & (ascii_letters / letters >= 0.95) & (german < 2), F.lit(False))


def paraphrase_valid(source: Column, para: Column, terms: tuple[str, ...]) -> Column:
    """Not empty, length in the window, no refusal, and every listed term of the source kept."""
    kept = F.lit(True)
    for t in terms:
        kept = kept & (~has_term(source, t) | has_term(para, t))
    return F.coalesce(length_ok(para) & ~collapse(para).rlike("(?i)" + REFUSAL) & kept, F.lit(False))


def sanitise(text: Column, compose: bool = True) -> Column:
    """Control characters but line feed, return and tab dropped, NFKC, first 8000
    characters (that limit is the feature)."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(nfkc(clean) if compose else clean, 1, SANITISED_CHARS)


def prompt_key(text: Column) -> Column:
    """First 80 characters of the cheap normal form."""
    return F.substring(lowered(text), 1, 80)


def seed_source(seed_id: Column) -> Column:
    """The source of ``<source>_seed_<n>``, '' where there is none."""
    return F.regexp_extract(seed_id, r"^(.+)_seed_(\d+)", 1)


def seed_number(seed_id: Column) -> Column:
    n = F.regexp_extract(seed_id, r"^(.+)_seed_(\d+)", 2)
    return F.when(n != "", n.cast("int"))


def first_turn(conversation: Column, role: str = "user") -> Column:
    """Content of the first turn of a role in array<struct<role, content>>; '' if none."""
    turns = F.filter(conversation, lambda t: t["role"] == role)
    return F.coalesce(F.try_element_at(turns, F.lit(1))["content"], F.lit(""))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
