"""Columns over paths, names and file facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import has, has_any

ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
NEVER = 9999


def lookup(c: Column, table: dict, otherwise: object = None) -> Column:
    """The value of a key in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    found = F.try_element_at(pairs, c)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def ladder(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step whose bound lies above ``c``."""
    case = None
    for bound, value in steps:
        case = F.when(c < bound, F.lit(value)) if case is None else case.when(c < bound, F.lit(value))
    return case.otherwise(F.lit(otherwise))


def instant(c: Column) -> Column:
    """ISO-8601 text as an instant, UTC unless an offset is given; null where it can't be read."""
    return F.when(c.rlike(ISO_INSTANT), c.try_cast("timestamp"))


def days_since(c: Column, as_of: Column) -> Column:
    """Whole days from an instant's text to ``as_of``, none before it; unreadable and missing ones count as long ago."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(instant(c))) / F.lit(86_400_000_000))
    return F.when(age.isNull(), NEVER).otherwise(F.greatest(F.lit(0), age)).cast("int")


def digest(c: Column) -> Column:
    """A SHA-256 in its usual spelling; null where it is missing or unusable."""
    d = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^sha256:\s*", "")
    return F.when(d.rlike("^[0-9a-f]{64}$") & (d != "0" * 64), d)


def mime(signature: Column, extension: Column) -> Column:
    case = None
    for start, kind in X.SIGNATURES.items():
        hit = signature.startswith(start)
        case = F.when(hit, kind) if case is None else case.when(hit, kind)
    return F.coalesce(case, lookup(extension, X.MIME_BY_EXTENSION), F.lit(X.UNKNOWN_MIME))


def is_binary(extension: Column, kind: Column) -> Column:
    return F.coalesce(extension.isin(*X.BINARY), F.lit(False)) | ~(kind.startswith("text/") | kind.isin(*X.TEXT_MIME))


def _first_answer(c: Column, rules, confidence: float) -> Column:
    case = None
    for pattern, name in rules:
        answer = F.struct(F.lit(name).alias("domain"), F.lit(confidence).alias("confidence"))
        case = F.when(has(c, pattern), answer) if case is None else case.when(has(c, pattern), answer)
    return case


def domain(extension: Column, path: Column, content: Column) -> Column:
    """(domain, confidence) by extension, else by path, else by content."""
    by_extension = lookup(extension, X.DOMAIN_BY_EXTENSION)

    def found(name: Column, confidence: float) -> Column:
        return F.struct(name.alias("domain"), F.lit(confidence).alias("confidence"))

    sure = X.DOMAIN_CONFIDENCE
    # each rule yields the whole answer, so no pattern is tried twice
    answers = [F.when(by_extension.isNotNull(), found(by_extension, sure["extension"])), _first_answer(F.lower(path), X.DOMAIN_BY_PATH, sure["path"]), _first_answer(F.lower(content), X.DOMAIN_BY_CONTENT, sure["content"])]
    return F.coalesce(*answers, found(F.lit("UNKNOWN"), 0.0))


def any_of(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (has(c, p) for p in patterns))


def in_shared_place(path: Column) -> Column:
    return any_of(F.lower(path), X.SHARED_PLACES)


def in_encrypted_place(path: Column) -> Column:
    return any_of(F.lower(path), X.ENCRYPTED_PLACES)


def leaf_stem(name: Column) -> Column:
    """A name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def version_stem(name: Column) -> Column:
    """What a file name has before its version mark, else its stem, in lower case."""
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in X.VERSIONS]
    marked = F.regexp_replace(F.lower(F.coalesce(*found)), "^[-_ ]+|[-_ ]+$", "")
    return F.coalesce(marked, F.lower(leaf_stem(name)))


def version_pattern(name: Column) -> Column:
    """The number of the first version mark that fits, from 0; null if none does."""
    case = None
    for i, p in enumerate(X.VERSIONS):
        case = F.when(name.rlike(p), i) if case is None else case.when(name.rlike(p), i)
    return case


UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(c: Column, whole: bool = False) -> Column:
    """A size in the unit in which it is below 1024; ``whole`` drops fractions at each step."""
    case = None
    for i, unit in enumerate(UNITS):
        value = F.floor(c / F.lit(float(1024**i))).cast("double") if whole else c / F.lit(float(1024**i))
        text = F.format_string(f"%.1f {unit}", F.bround(value, 1))
        below = F.abs(value) < 1024
        case = F.when(below, text) if case is None else (case.otherwise(text) if unit == UNITS[-1] else case.when(below, text))
    return case


def priority(extension: Column, path: Column, size: Column) -> Column:
    """Order of classification: extension, first word found in the path, large size."""
    word = None
    low = F.lower(path)
    for w, score in X.PRIORITY_BY_PATH.items():
        word = F.when(low.contains(w), score) if word is None else word.when(low.contains(w), score)
    return lookup(F.lower(extension), X.PRIORITY_BY_EXTENSION, 0) + F.coalesce(word.otherwise(0), F.lit(0)) + F.when(size > X.LARGE_BYTES, 20).otherwise(0)


def tier(extension: Column, domain: Column, confidence: Column, size: Column, binary: Column, content: Column) -> Column:
    """Effort of classification, 1 to 3."""
    ext = F.coalesce(F.lower(extension), F.lit(""))
    large_text = F.coalesce((size > X.LARGE_BYTES) & ~binary, F.lit(False))
    sure = F.coalesce((domain != "UNKNOWN") & (confidence >= X.SURE_DOMAIN), F.lit(False))
    return (
        F.when(ext.isin(*X.BINARY) & ~ext.isin(*X.EXECUTABLE), 1)
        .when(ext.isin(*X.EXECUTABLE) | ext.isin(*X.DEEP_FILES), 3)
        .when(sure & large_text & has_any(F.lower(content), X.DELICATE_WORDS), 3)
        .when(sure, 1)
        .when(large_text, 3)
        .otherwise(2)
    )


def query_text(content: Column, keywords: Column, name: Column, extension: Column) -> Column:
    """What a file is asked for: start of its text and its first keywords, else its name."""
    text = F.when(F.length(content) > 0, F.substring(content, 1, 500))
    keys = F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 20), " "))
    return F.substring(F.coalesce(F.nullif(F.concat_ws(" ", text, keys), F.lit("")), F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(extension, F.lit("")), F.lit(" file analysis"))), 1, 1000)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]+"), lambda p: F.length(p) > 0)


def path_id(path: Column) -> Column:
    """An opaque identity of a path: separators unified, letter case ignored."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(path, r"[/\\]+", "/")), 256), 1, 20)


def redacted_path(path: Column) -> Column:
    """(path_id, display_path, protected) of a path without its protected parts."""
    parts = path_parts(F.coalesce(path, F.lit("")))
    leaf = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))
    protected = F.exists(parts, lambda p: F.lower(p).isin(*X.PROTECTED_NAMES))
    shown = F.when(protected, F.concat(F.lit("[protected]/"), leaf)).when(F.size(parts) > 1, F.concat(F.lit("…/"), F.try_element_at(parts, F.lit(-2)), F.lit("/"), leaf)).otherwise(leaf)
    return F.struct(path_id(F.coalesce(path, F.lit(""))).alias("path_id"), shown.alias("display_path"), protected.alias("protected"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(path, r"[/\\]+", "/")), "(?<=.)/$", "")


def allowed_path(path: Column, protected: list[str], allowed: list[str]) -> Column:
    """(ok, reason): outside protected subtrees and, where any are given, inside an allowed one. Bare protected entries match anywhere."""
    at = normal_path(path)

    def within(entry: str) -> Column:
        prefix = "/".join(p for p in entry.replace("\\", "/").lower().split("/"))
        prefix = prefix.rstrip("/")
        return (at == prefix) | at.startswith(prefix + "/")

    case = F.when(path.isNull(), "no path")
    for entry in (e.strip() for e in protected):
        if entry:
            rooted = entry.startswith(("/", "\\")) or entry[1:2] == ":"
            hit = within(entry) if rooted else at.contains(entry.lower())
            case = case.when(hit, f"path is inside protected location '{entry}'" if rooted else f"path matches protected pattern '{entry}'")
    if allowed:
        case = case.when(~reduce(lambda a, b: a | b, (within(e) for e in allowed)), "path is outside the configured scan allowlist")
    reason = case.otherwise("ok")
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


ABSOLUTE_PATH = r"\b[A-Za-z]:\\(?:[^\\\s]+\\)*[^\\\s,;:)]+"


def without_paths(text: Column) -> Column:
    """A text with each absolute path of a drive replaced by its opaque identity."""
    between, found = F.split(text, ABSOLUTE_PATH), F.regexp_extract_all(text, F.lit(ABSOLUTE_PATH), F.lit(0))
    marks = F.concat(F.transform(found, lambda p: F.concat(F.lit("[path:"), path_id(p), F.lit("]"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
