"""The pN_ queries over the tables of TESTDATA.md, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from .bpe import count_tokens, encode_corpus, tokenizer_file
from .codedocs import documented
from .consolidate import Field, consolidate, decayed
from .mixing import listed_sources, mix
from .mojibake import repair
from .neardup import near_duplicates
from .secrets import find_secrets
from .topn import latest, top_n


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# --- p1: top N of every group -------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best valid scores of every domain, over the latest delivery of each (file, scan)."""
    raw = table(spark, sf_dir, "intelligence_scores").select("id", "file_id", "scan_id", "scored_at", "primary_domain", "overall_score")
    now = latest(raw, ["file_id", "scan_id"], ["scored_at", "id"], ["id", "primary_domain", "overall_score"])
    name = F.upper(stripped(F.col("primary_domain")))
    rows = now.where(F.col("overall_score").between(0, 100) & ~F.isnan("overall_score")).select(
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(name).alias("primary_domain"), "overall_score", "file_id", "scan_id", "id"
    )
    return top_n(rows, "primary_domain", "overall_score", ["file_id", "scan_id"], 5, "domain_rank", edges_of=raw.select("overall_score").where("overall_score between 0 and 100")).select("primary_domain", "domain_rank", "id")


P1_SQL = r"""
WITH latest AS (
  SELECT * FROM intelligence_scores
  QUALIFY row_number() OVER (PARTITION BY file_id, scan_id ORDER BY scored_at DESC NULLS LAST, id DESC NULLS LAST) = 1
), named AS (
  SELECT coalesce(nullif(upper(regexp_replace(primary_domain, '^\s+|\s+$', '', 'g')), ''), 'UNKNOWN') AS primary_domain,
         overall_score, file_id, scan_id, id
  FROM latest
  WHERE overall_score IS NOT NULL AND NOT isnan(overall_score) AND overall_score BETWEEN 0 AND 100
)
SELECT primary_domain, CAST(domain_rank AS INT) AS domain_rank, id FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_domain ORDER BY overall_score DESC, file_id NULLS FIRST, scan_id NULLS FIRST) AS domain_rank FROM named
) WHERE domain_rank <= 5
"""


# --- p2: near-duplicate records ---------------------------------------------------------------------------------------


def _near_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, sf_dir, "files").select("id", "content_sample"), "id", "content_sample", 0.6, words=3, min_words=20, unique_ids=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files whose samples share 0.6 of their word triples though their xxhash differs or is missing.

    The pairs of classes are expanded to pairs of files. Within a class, files with the same xxhash are one variant and
    only different variants are paired, so copies with one hash cost nothing however many they are.
    """
    members, links = _near_samples(spark, sf_dir)
    hashes = table(spark, sf_dir, "files").select("id", "xxhash")
    # a missing hash differs from all others: such a file is a variant of its own
    own = F.coalesce(F.concat(F.lit("="), "xxhash"), F.concat(F.lit("?"), F.col("id").cast("string")))
    files = stored(members.join(hashes, "id").select("class_id", "id", own.alias("variant")), "p2-files")

    a, b = (files.select(F.col("class_id").alias(f"class_{x}"), F.col("id").alias(f"id_{x}"), F.col("variant").alias(f"variant_{x}")) for x in "ab")
    across = links.join(a, "class_a").join(b, "class_b").where("variant_a <> variant_b").select("id_a", "id_b")

    several = files.groupBy("class_id").agg(F.min("variant").alias("low"), F.max("variant").alias("high")).where("low < high").select("class_id")
    variants = files.join(several, "class_id", "left_semi").select("class_id", "variant").distinct()
    of = lambda x: variants.select("class_id", F.col("variant").alias(f"variant_{x}"))
    couples = of("a").join(of("b"), "class_id").where("variant_a < variant_b")
    within = couples.join(a.withColumnRenamed("class_a", "class_id"), ["class_id", "variant_a"]).join(b.withColumnRenamed("class_b", "class_id"), ["class_id", "variant_b"]).select("id_a", "id_b")
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file: its class of equal samples and how many other classes are linked to it."""
    members, links = _near_samples(spark, sf_dir)
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of classes of equal samples that are linked, and how similar they are."""
    return _near_samples(spark, sf_dir)[1]


def p2_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: every file whose id is divisible by 50 against all files; the classes that its sample is in or linked to."""
    members, links = _near_samples(spark, sf_dir)
    asked = members.where("id % 50 = 0")
    either = links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("found_class"), "similarity").unionByName(links.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("found_class"), "similarity"))
    near = asked.join(either, "class_id").select("id", "found_class", "similarity")
    return near.unionByName(asked.select("id", F.col("class_id").alias("found_class"), F.lit(1.0).alias("similarity")))


# --- p3: functions paired with their documentation -----------------------------------------------------------------


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-description pairs of all source files."""
    return documented(table(spark, sf_dir, "code_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented functions and where their names stand."""
    return p3_pairs(spark, sf_dir).select("file_id", "name", "line_number")


# --- p4: best representative of each duplicate group ----------------------------------------------------------------

ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def instant(c: Column) -> Column:
    """ISO-8601 text as an instant; without an offset UTC; null where it can't be read."""
    text = stripped(c)
    return F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp"))


def filled(c: str) -> Column:
    return F.coalesce(stripped(F.col(c)) != "", F.lit(False))


def digest(c: Column) -> Column:
    """A sha256 in its usual spelling, or null if it is unusable."""
    d = stripped(F.regexp_replace(F.lower(stripped(c)), "^sha256:", ""))
    return F.when(d.rlike("^[0-9a-f]{64}$") & (d != "0" * 64), d)


def _copies(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    columns = ["id", "path", "created_at", "accessed_at", "modified_at", "mime_type", "file_signature", "xxhash"]
    files = table(spark, sf_dir, "files").select("sha256", *dict.fromkeys([*columns, *extra]))
    complete = sum((filled(c).cast("int") for c in ("created_at", "accessed_at", "mime_type", "file_signature", "xxhash")), F.lit(0))
    return files.select(digest(F.col("sha256")).alias("digest"), *files.columns[1:], instant(F.col("modified_at")).alias("modified"), instant(F.col("created_at")).alias("created"), complete.alias("complete")).where(F.col("digest").isNotNull())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row gives each part of the surviving record of every digest in two or more rows."""
    files = _copies(spark, sf_dir)
    row, first_id = F.col("id"), -F.col("id")
    # an unreadable instant sorts below every readable one
    newest = F.coalesce(F.unix_micros("modified"), F.lit(-(2**63) + 1))
    best = [newest, F.col("complete"), first_id]
    fields = [
        Field("keeper_id", row, best, type="long", default=0),
        Field("path_id", row, [-F.length("path"), first_id], where=F.col("path").isNotNull(), type="long", default=0),
        Field("mime_id", row, best, where=filled("mime_type"), type="long", default=0),
        Field("created_id", row, [-F.unix_micros("created"), first_id], where=F.col("created").isNotNull(), type="long", default=0),
    ]
    return consolidate(files, "digest", fields).select(F.col("digest").alias("sha256"), "keeper_id", "path_id", "mime_id", "created_id")


_INSTANT_SQL = r"CASE WHEN regexp_matches(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,9}})?)?\s*(Z|[+-]\d{{2}}:?\d{{2}})?)?$') THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches({c}, '(Z|[+-]\d{{2}}:?\d{{2}})\s*$') THEN {c} ELSE {c} || '+00' END AS TIMESTAMPTZ)) END"
_FILLED_SQL = r"(coalesce(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '') <> '')"
_DIGEST_CTE = (
    r"""
WITH f AS (
  SELECT regexp_replace(regexp_replace(lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')), '^sha256:', ''), '^\s+|\s+$', '', 'g') AS d, *,
  """
    + _INSTANT_SQL.format(c="modified_at")
    + " AS m, "
    + _INSTANT_SQL.format(c="created_at")
    + " AS c, "
    + " + ".join(f"CAST({_FILLED_SQL.format(c=c)} AS INT)" for c in ("created_at", "accessed_at", "mime_type", "file_signature", "xxhash"))
    + """ AS n FROM files
), g AS (SELECT * FROM f WHERE regexp_matches(d, '^[0-9a-f]{64}$') AND d <> repeat('0', 64))
"""
)
P4_SQL = (
    _DIGEST_CTE
    + f"""
SELECT d AS sha256,
  first(id ORDER BY m DESC NULLS LAST, n DESC, id) AS keeper_id,
  coalesce(first(id ORDER BY length(path), id) FILTER (WHERE path IS NOT NULL), 0) AS path_id,
  coalesce(first(id ORDER BY m DESC NULLS LAST, n DESC, id) FILTER (WHERE {_FILLED_SQL.format(c="mime_type")}), 0) AS mime_id,
  coalesce(first(id ORDER BY c, id) FILTER (WHERE c IS NOT NULL), 0) AS created_id
FROM g GROUP BY d HAVING count(*) >= 2
"""
)


TRUSTED_PLACE = r"(?i)\\(vault|shared|final)\\"
DOUBTFUL_PLACE = r"(?i)\\(temp|tmp|inbox|downloads|backup[^\\]*|old)\\|copy of |\(\d+\)"


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record itself: every field by votes of trust times recency per normalised value."""
    files = _copies(spark, sf_dir, "filename", "extension", "size_bytes", "detected_domain", "domain_confidence", "drive")
    trust = F.when(F.col("path").rlike(DOUBTFUL_PLACE), 0.5).when(F.col("path").rlike(TRUSTED_PLACE), 2.0).otherwise(1.0)
    weight = decayed(trust, F.col("modified"), F.lit("2026-09-01").cast("timestamp"), 365.0)
    last = [F.coalesce(F.unix_micros("modified"), F.lit(-(2**63) + 1)), F.col("complete"), -F.col("id")]

    def text(name: str, norm: Column | None = None, vote: Column = weight) -> Field:
        return Field(name, stripped(F.col(name)), last, norm if norm is not None else F.lower(stripped(F.col(name))), vote, filled(name))

    fields = [
        Field("keeper_id", F.col("id"), last, type="long"),
        text("filename"),
        Field("extension", F.lower(stripped(F.col("extension"))), last, vote=weight, where=filled("extension")),
        Field("size_bytes", F.col("size_bytes"), last, vote=weight, type="long"),
        text("mime_type"),
        text("file_signature"),
        text("xxhash"),
        text("detected_domain", F.upper(stripped(F.col("detected_domain"))), weight * F.coalesce(F.col("domain_confidence"), F.lit(0.0))),
        Field("created_at", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), [-F.unix_micros("created"), -F.col("id")], where=F.col("created").isNotNull()),
        Field("modified_at", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), [F.unix_micros("modified"), -F.col("id")], where=F.col("modified").isNotNull()),
    ]
    return consolidate(files, "digest", fields).withColumnRenamed("digest", "sha256")


# --- p5: credentials embedded in source code -------------------------------------------------------------------------


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that hold credentials, with these hidden and all else unchanged."""
    return find_secrets(table(spark, sf_dir, "files").select("id", "content_sample"), "id", "content_sample").select("id", F.size("found").alias("n_found"), "redacted")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on which a credential begins."""
    found = find_secrets(table(spark, sf_dir, "files").select("id", "content_sample"), "id", "content_sample")
    lines = F.array_distinct(F.transform("found", lambda f: f["line_number"]))
    return found.select("id", F.explode(lines).alias("line_number"))


# --- p6: encoding of the whole corpus -------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    path, pattern = tokenizer_file()
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, pattern)


# --- p7: mixing sources to target weights ---------------------------------------------------------------------------


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of equal texts one document stands for all, that with the smallest doc_id among the listed sources, so no text is used beyond its cap."""
    path, pattern = tokenizer_file()
    weights = table(spark, sf_dir, "source_weights")
    docs = table(spark, sf_dir, "documents").where("text <> ''").join(listed_sources(weights.select("source")), "source", "left_semi")
    sized = count_tokens(docs.select("doc_id", "source", F.sha2("text", 256).alias("same"), "text"), "text", path, pattern)
    texts = sized.groupBy("same").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("first")).select("first.*")
    return mix(texts, weights)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return _mixture(spark, sf_dir)[1]


# --- p8: garbled text from wrong character encoding ------------------------------------------------------------------


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged documents with their text as far as it could be restored."""
    return repair(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged documents."""
    return p8_restored(spark, sf_dir).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_classes": p2_classes, "p2_links": p2_links, "p2_searched": p2_searched, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p4_found": P4_SQL}
