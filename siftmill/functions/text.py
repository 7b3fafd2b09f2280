"""Columns over text: normalised forms, keywords, similarity, fingerprints."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .fixed import STOPWORDS

KEYWORD_LIMIT = 50
#: White space as text is split by it: all of Unicode and the separators of the first block.
WHITE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def lines_mode(pattern: str) -> str:
    """A pattern for the JVM in which only a line feed ends a line."""
    return f"(?d){pattern}"


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text; null is no text."""
    return F.coalesce(c.rlike(lines_mode(pattern)), F.lit(False))


def has_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether one of some literal words occurs in a text."""
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return F.coalesce(found, F.lit(False))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(lines_mode(pattern)), F.lit(group))


def normalize_text(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces as a space, spaces folded and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalized_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def words(c: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(c, WHITE), lambda w: F.length(w) > 0)


def keyword_set(c: Column, least: int = 3) -> Column:
    """The distinct lower-case words of letters only with at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), WHITE), lambda w: (F.length(w) >= least) & w.rlike(r"^\p{L}+$")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def tokens(c: Column) -> Column:
    """Identifiers in a lower-cased text: maximal runs of letters, digits and underscores that are an ASCII identifier."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[a-z_][a-z0-9_]*$"))


_RUNS, _IDENTIFIER, _STOPPED = re.compile(r"\w+").findall, re.compile("[a-z_][a-z0-9_]*").fullmatch, frozenset(STOPWORDS)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _keywords(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        seen = Counter(w for w in _RUNS(text or "") if len(w) >= 3 and w not in _STOPPED and _IDENTIFIER(w))
        out.append([w for w, _ in seen.most_common(KEYWORD_LIMIT)])
    return pa.array(out, pa.list_(pa.string()))


def keywords(c: Column) -> Column:
    """The fifty most frequent identifiers of a text (as ``tokens`` has them) without stop words and short ones, ties by first occurrence.

    They are counted within the row, in Arrow batches: nothing is shuffled, and a text needs no more than itself.
    """
    return _keywords(F.lower(c))


def top_keywords(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, keywords) of each row; a text without any, or a null one, has an empty list."""
    return spread(df.select(id, text), id).select(id, keywords(F.col(text)).alias("keywords"))


def code_keywords(c: Column, general: Column) -> Column:
    """Imports, function names, class names, keywords of the language and twenty general keywords, fifty in all."""
    return F.slice(
        F.concat(
            all_matches(c, r"(?m)^\s*(?:from|import)\s+([\w.]+)"),
            all_matches(c, r"(?m)^\s*(?:def|function|func|fn)\s+(\w+)"),
            all_matches(c, r"(?m)^\s*class\s+(\w+)"),
            all_matches(c, r"\b(async|await|return|yield|const|let|var|struct|interface|type|enum)\b"),
            F.slice(general, 1, 20),
        ),
        1,
        KEYWORD_LIMIT,
    )


def mask_secret(c: Column) -> Column:
    """The ends of a secret and its length; of four characters or fewer nothing."""
    return F.when(F.length(c) <= 4, "****").otherwise(F.concat(F.substring(c, 1, 2), F.lit("…"), F.right(c, F.lit(2)), F.lit(" (len="), F.length(c).cast("string"), F.lit(")")))


def error_fingerprint(kind: Column, message: Column) -> Column:
    """Type and message with numbers, quotations and paths folded."""
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(message, "[0-9]+", "N"), r"['\"].*?['\"]", "STR"), r"/[\w/.-]+", "PATH")
    return F.concat(kind, F.lit("::"), F.substring(folded, 1, 100))


def body_hash(c: Column) -> Column:
    """Sixteen hex digits over a body with its white space folded."""
    return F.substring(F.md5(F.trim(F.regexp_replace(c, r"\s+", " "))), 1, 16)
