"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import fixed as X
from ..functions import text as T
from ..functions.text import WHITE
from ..session import spread, table
from .catalog import AS_OF, query, s, s_any, s_contains, s_days, s_first, s_in, s_lookup, s_matches, s_normal

C = F.col

S_MIME = f"coalesce({s_first('file_signature', X.SIGNATURES.items(), lambda c, p: f'starts_with({c}, {s(p)})')}, {s_lookup('extension', X.MIME_BY_EXTENSION)}, {s(X.UNKNOWN_MIME)})"


@query(
    "f1_mime",
    f"""SELECT id, mime, {s_in('extension', X.BINARY)} OR NOT (starts_with(mime, 'text/') OR mime IN ({', '.join(map(s, X.TEXT_MIME))})) AS is_binary
FROM (SELECT id, extension, {S_MIME} AS mime FROM files)""",
)
def f1_mime(spark, d):
    return table(spark, d, "files").select("id", "extension", P.mime(C("file_signature"), C("extension")).alias("mime")).select("id", "mime", P.is_binary(C("extension"), C("mime")).alias("is_binary"))


def s_keywords(source: str, key: str, text: str) -> str:
    """(key, keywords) of every row of a table."""
    stop = ", ".join(map(s, X.STOPWORDS))
    return f"""(
WITH runs AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]+)', 1)) AS w, generate_subscripts(regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]+)', 1), 1) AS pos FROM {source}),
counted AS (SELECT k, w, count(*) AS n, min(pos) AS f FROM runs WHERE regexp_matches(w, '^[a-z_][a-z0-9_]*$') AND length(w) >= 3 AND w NOT IN ({stop}) GROUP BY k, w),
ranked AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS r FROM counted)
SELECT t.{key}, coalesce(x.keywords, CAST([] AS VARCHAR[])) AS keywords FROM {source} t LEFT JOIN (SELECT k, list(w ORDER BY r) AS keywords FROM ranked WHERE r <= 50 GROUP BY k) x ON x.k = t.{key})"""


@query("f3_text_keywords", f"SELECT doc_id, array_to_string(keywords, ' ') AS keywords FROM {s_keywords('documents', 'doc_id', 'text')}")
def f3_text_keywords(spark, d):
    return T.top_keywords(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.array_join("keywords", " ").alias("keywords"))


_CODE_PARTS = (r"(?m)^\s*(?:from|import)\s+([\w.]+)", r"(?m)^\s*(?:def|function|func|fn)\s+(\w+)", r"(?m)^\s*class\s+(\w+)", r"\b(async|await|return|yield|const|let|var|struct|interface|type|enum)\b")


@query(
    "f4_code_keywords",
    f"""SELECT c.file_id, array_to_string(list_slice(list_concat({', '.join(s_matches('content', p) for p in _CODE_PARTS)}, list_slice(k.keywords, 1, 20)), 1, 50), ' ') AS keywords
FROM code_files c JOIN {s_keywords('code_files', 'file_id', 'content')} k ON k.file_id = c.file_id WHERE content IS NOT NULL""",
)
def f4_code_keywords(spark, d):
    code = table(spark, d, "code_files").select("file_id", "content").where("content is not null")
    return spread(code, "file_id").withColumn("keywords", T.keywords(C("content"))).select("file_id", F.array_join(T.code_keywords(C("content"), C("keywords")), " ").alias("keywords"))


_BY_PATH, _BY_CONTENT = s_first("lower(path)", X.DOMAIN_BY_PATH), s_first("lower(content_sample)", X.DOMAIN_BY_CONTENT)


@query(
    "f6_domain",
    f"""SELECT id, coalesce(e, p, c, 'UNKNOWN') AS domain, CASE WHEN e IS NOT NULL THEN 0.95 WHEN p IS NOT NULL THEN 0.85 WHEN c IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence
FROM (SELECT id, {s_lookup('extension', X.DOMAIN_BY_EXTENSION)} AS e, {_BY_PATH} AS p, {_BY_CONTENT} AS c FROM files)""",
)
def f6_domain(spark, d):
    return spread(table(spark, d, "files").select("id", "extension", "path", "content_sample"), "id").select("id", P.domain(C("extension"), C("path"), C("content_sample")).alias("x")).select("id", "x.*")


@query("f8_normalized_hash", f"SELECT doc_id, {s_normal('text')} AS normal, sha256({s_normal('text')}) AS hash FROM documents")
def f8_normalized_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(C("text")).alias("normal"), T.normalized_hash(C("text")).alias("hash"))


_S_SET = f"list_distinct(list_filter(regexp_split_to_array(lower(text), {s(WHITE)}), lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$')))"


@query("f10_keyword_set", f"SELECT doc_id, CAST(length({_S_SET}) AS INT) AS n_keywords, array_to_string(list_sort({_S_SET}), ' ') AS keywords FROM documents WHERE text IS NOT NULL")
def f10_keyword_set(spark, d):
    keys = T.keyword_set(C("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(keys).alias("n_keywords"), F.array_join(F.array_sort(keys), " ").alias("keywords"))


@query(
    "f11_keyword_overlap",
    f"""WITH t AS (SELECT doc_id, {_S_SET} AS k FROM documents)
SELECT a.doc_id, b.doc_id AS next_id, CASE WHEN coalesce(length(a.k), 0) = 0 OR coalesce(length(b.k), 0) = 0 THEN 0.0 ELSE length(list_intersect(a.k, b.k)) / CAST(length(a.k) + length(b.k) - length(list_intersect(a.k, b.k)) AS DOUBLE) END AS overlap
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""",
)
def f11_keyword_overlap(spark, d):
    keys = table(spark, d, "documents").select("doc_id", F.coalesce(T.keyword_set(C("text")), F.array().cast("array<string>")).alias("k"))
    after = keys.select(C("doc_id").alias("next_id"), C("k").alias("n"), (C("doc_id") - 1).alias("doc_id"))
    return keys.join(after, "doc_id").select("doc_id", "next_id", T.jaccard(C("k"), C("n")).alias("overlap"))


@query("f12_days_since", f"SELECT id, {s_days('modified_at')} AS days_modified, {s_days('accessed_at')} AS days_accessed FROM files")
def f12_days_since(spark, d):
    now = F.lit(AS_OF).cast("timestamp")
    return table(spark, d, "files").select("id", P.days_since(C("modified_at"), now).alias("days_modified"), P.days_since(C("accessed_at"), now).alias("days_accessed"))


@query("f13_places", f"SELECT id, {s_any('lower(path)', X.SHARED_PLACES)} AS shared, {s_any('lower(path)', X.ENCRYPTED_PLACES)} AS encrypted FROM files")
def f13_places(spark, d):
    return table(spark, d, "files").select("id", P.in_shared_place(C("path")).alias("shared"), P.in_encrypted_place(C("path")).alias("encrypted"))


def _s_size(whole: bool) -> str:
    case = "CASE"
    for i, unit in enumerate(P.UNITS):
        value = f"floor(size_bytes / {float(1024**i)})" if whole else f"(size_bytes / {float(1024**i)})"
        text = f"printf('%.1f {unit}', CAST({value} AS DOUBLE))"
        case += f" ELSE {text} END" if unit == "PB" else f" WHEN abs({value}) < 1024 THEN {text}"
    return f"CASE WHEN size_bytes IS NOT NULL THEN {case} END"


@query("f14_human_size", f"SELECT id, {_s_size(False)} AS exact, {_s_size(True)} AS whole FROM files")
def f14_human_size(spark, d):
    size = C("size_bytes")
    return table(spark, d, "files").select("id", F.when(size.isNotNull(), P.human_size(size)).alias("exact"), F.when(size.isNotNull(), P.human_size(size, True)).alias("whole"))


S_LEAF_STEM = r"regexp_replace({c}, '([^.])\.[^.]*$', '\1')"


def s_stem(c: str) -> str:
    marked = ", ".join(f"nullif(regexp_extract({c}, {s(p)}, 1), '')" for p in X.VERSIONS)
    return f"coalesce(regexp_replace(lower(coalesce({marked})), '^[-_ ]+|[-_ ]+$', '', 'g'), lower({S_LEAF_STEM.format(c=c)}))"


def s_version(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {s(p)}) THEN {i}" for i, p in enumerate(X.VERSIONS)) + " END"


@query("f15_version_stem", f"SELECT id, {s_stem('filename')} AS stem, {s_version('filename')} AS mark FROM files")
def f15_version_stem(spark, d):
    return table(spark, d, "files").select("id", P.version_stem(C("filename")).alias("stem"), P.version_pattern(C("filename")).alias("mark"))


def s_imports(text: str, extension: str) -> str:
    return f"CASE lower({extension}) " + " ".join(f"WHEN {s(e)} THEN " + (f"list_concat({', '.join(s_matches(text, p) for p in patterns)})" if len(patterns) > 1 else s_matches(text, patterns[0])) for e, patterns in X.IMPORTS.items()) + " END"


def imports(text, extension):
    """All imports of a source text by the patterns of its extension, in the order of the patterns."""
    case = None
    for e, patterns in X.IMPORTS.items():
        found = F.concat(*[T.all_matches(text, p) for p in patterns]) if len(patterns) > 1 else T.all_matches(text, patterns[0])
        case = F.when(F.lower(extension) == e, found) if case is None else case.when(F.lower(extension) == e, found)
    return case


@query("f16_imports", f"SELECT file_id, unnest({s_imports('content', 'extension')}) AS import FROM code_files WHERE content IS NOT NULL")
def f16_imports(spark, d):
    return table(spark, d, "code_files").where("content is not null").select("file_id", F.explode(imports(C("content"), C("extension"))).alias("import"))


S_FILE_KEYWORDS = s_keywords("files", "id", "content_sample")


@query(
    "f17_query_text",
    f"""SELECT f.id, substring(coalesce(nullif(concat_ws(' ', CASE WHEN length(content_sample) > 0 THEN substring(content_sample, 1, 500) END, CASE WHEN length(keywords) > 0 THEN array_to_string(list_slice(keywords, 1, 20), ' ') END), ''), coalesce(filename, '') || ' ' || coalesce(extension, '') || ' file analysis'), 1, 1000) AS query
FROM files f JOIN {S_FILE_KEYWORDS} k ON k.id = f.id""",
)
def f17_query_text(spark, d):
    files = table(spark, d, "files").select("id", "content_sample", "filename", "extension")
    return spread(files, "id").withColumn("keywords", T.keywords(C("content_sample"))).select("id", P.query_text(C("content_sample"), C("keywords"), C("filename"), C("extension")).alias("query"))


_S_WORD = s_first("lower(path)", X.PRIORITY_BY_PATH.items(), lambda c, p: f"contains({c}, {s(p)})")


@query("f18_priority", f"SELECT id, CAST({s_lookup('lower(extension)', X.PRIORITY_BY_EXTENSION, '0')} + coalesce({_S_WORD}, 0) + CASE WHEN size_bytes > {X.LARGE_BYTES} THEN 20 ELSE 0 END AS INT) AS priority FROM files")
def f18_priority(spark, d):
    return table(spark, d, "files").select("id", P.priority(C("extension"), C("path"), C("size_bytes")).cast("int").alias("priority"))


_EXT = "coalesce(lower(extension), '')"
_LARGE = f"coalesce(size_bytes > {X.LARGE_BYTES} AND is_binary <> 1, false)"
_SURE = f"coalesce(detected_domain <> 'UNKNOWN' AND domain_confidence >= {X.SURE_DOMAIN}, false)"
S_TIER = f"""CASE WHEN {s_in(_EXT, X.BINARY)} AND NOT {s_in(_EXT, X.EXECUTABLE)} THEN 1 WHEN {s_in(_EXT, X.EXECUTABLE)} OR {s_in(_EXT, X.DEEP_FILES)} THEN 3
WHEN {_SURE} AND {_LARGE} AND {s_contains('lower(content_sample)', X.DELICATE_WORDS)} THEN 3 WHEN {_SURE} THEN 1 WHEN {_LARGE} THEN 3 ELSE 2 END"""


def _tier():
    return P.tier(C("extension"), C("detected_domain"), C("domain_confidence"), C("size_bytes"), C("is_binary") == 1, C("content_sample"))


@query("f19_tier", f"SELECT id, {S_TIER} AS tier FROM files")
def f19_tier(spark, d):
    return table(spark, d, "files").select("id", _tier().alias("tier"))


@query("k4_classification_queue", f"SELECT tier, count(*) AS files, sum(size_bytes) AS bytes, max(priority) AS first_priority FROM (SELECT {S_TIER} AS tier, size_bytes, {s_lookup('lower(extension)', X.PRIORITY_BY_EXTENSION, '0')} + coalesce({_S_WORD}, 0) + CASE WHEN size_bytes > {X.LARGE_BYTES} THEN 20 ELSE 0 END AS priority FROM files) GROUP BY tier")
def k4_classification_queue(spark, d):
    rows = table(spark, d, "files").select(_tier().alias("tier"), "size_bytes", P.priority(C("extension"), C("path"), C("size_bytes")).alias("priority"))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.max("priority").alias("first_priority"))


@query(
    "f29_redacted_path",
    rf"""WITH p AS (SELECT id, coalesce(path, '') AS path, list_filter(regexp_split_to_array(coalesce(path, ''), '[/\\]+'), lambda x: length(x) > 0) AS parts FROM files)
SELECT id, substring(sha256(lower(regexp_replace(path, '[/\\]+', '/', 'g'))), 1, 20) AS path_id, coalesce(parts[-1], 'unknown') AS leaf,
CASE WHEN len(list_filter(parts, lambda x: lower(x) IN ({', '.join(map(s, X.PROTECTED_NAMES))}))) > 0 THEN '[protected]/' || coalesce(parts[-1], 'unknown') WHEN len(parts) > 1 THEN '…/' || parts[-2] || '/' || parts[-1] ELSE coalesce(parts[-1], 'unknown') END AS display_path,
len(list_filter(parts, lambda x: lower(x) IN ({', '.join(map(s, X.PROTECTED_NAMES))}))) > 0 AS protected FROM p""",
)
def f29_redacted_path(spark, d):
    parts = P.path_parts(F.coalesce(C("path"), F.lit("")))
    return table(spark, d, "files").select("id", P.redacted_path(C("path")).alias("x"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown")).alias("leaf")).select("id", "x.*", "leaf")


_PUBLIC = ["id", "scan_id", "filename", "extension", "size_bytes", "created_at", "modified_at", "accessed_at", "mime_type"]


@query("f30_public_record", rf"SELECT {', '.join(_PUBLIC)}, drive, coalesce(is_binary, 0) = 1 AS is_binary, substring(sha256(lower(regexp_replace(coalesce(path, ''), '[/\\]+', '/', 'g'))), 1, 20) AS path_id FROM files")
def f30_public_record(spark, d):
    return table(spark, d, "files").select(*_PUBLIC, "drive", (F.coalesce(C("is_binary"), F.lit(0)) == 1).alias("is_binary"), P.path_id(F.coalesce(C("path"), F.lit(""))).alias("path_id"))


@query(
    "s4_path_policy",
    r"""WITH p AS (SELECT id, path, regexp_replace(lower(regexp_replace(path, '[/\\]+', '/', 'g')), '(.)/$', '\1') AS n FROM files)
SELECT id, n IS NOT NULL AND NOT (n = 'c:/vol00' OR starts_with(n, 'c:/vol00/')) AND NOT contains(n, 'backup 2025') AND (n = 'd:/vol00' OR starts_with(n, 'd:/vol00/') OR n = 'e:/vol00' OR starts_with(n, 'e:/vol00/')) AS ok,
CASE WHEN n IS NULL THEN 'no path' WHEN n = 'c:/vol00' OR starts_with(n, 'c:/vol00/') THEN 'path is inside protected location ''C:\vol00''' WHEN contains(n, 'backup 2025') THEN 'path matches protected pattern ''Backup 2025'''
WHEN NOT (n = 'd:/vol00' OR starts_with(n, 'd:/vol00/') OR n = 'e:/vol00' OR starts_with(n, 'e:/vol00/')) THEN 'path is outside the configured scan allowlist' ELSE 'ok' END AS reason FROM p""",
)
def s4_path_policy(spark, d):
    return table(spark, d, "files").select("id", P.allowed_path(C("path"), ["C:\\vol00", "Backup 2025"], ["D:\\vol00", "E:\\vol00"]).alias("x")).select("id", "x.*")


@query("s5_signature", "SELECT file_id, lower(substring(hex(encode(content)), 1, 32)) AS signature FROM code_files WHERE content IS NOT NULL")
def s5_signature(spark, d):
    return table(spark, d, "code_files").where("content is not null").select("file_id", F.lower(F.hex(F.substring(F.encode("content", "UTF-8"), 1, 16))).alias("signature"))


@query("f7_hashes", "SELECT file_id, sha256(content) AS sha256, md5(content) AS md5 FROM code_files WHERE content IS NOT NULL")
def f7_hashes(spark, d):
    return table(spark, d, "code_files").where("content is not null").select("file_id", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


_S_CONFIDENCE = "greatest(0.0, least(1.0, coalesce(domain_confidence, 0.0)))"


@query(
    "kl_local_classification",
    f"""SELECT f.id AS file_id, coalesce(detected_domain, 'UNKNOWN') AS domain, CASE WHEN {_S_CONFIDENCE} >= 0.8 THEN 'DEFENSIBLE' WHEN {_S_CONFIDENCE} >= 0.5 THEN 'AGGRESSIVE' ELSE 'UNKNOWN' END AS confidence,
{_S_CONFIDENCE} AS score, coalesce(nullif(extension, ''), mime_type) AS topic, 25 AS authority_weight, 'LOCAL_RULES_V1' AS engine_id, {S_TIER} AS tier,
sha256(concat_ws('|', coalesce(path, ''), coalesce(extension, ''), coalesce(mime_type, ''), coalesce(detected_domain, 'UNKNOWN'), printf('%.6f', {_S_CONFIDENCE}), array_to_string(list_sort(list_slice(keywords, 1, 20)), ','))) AS determinism_hash
FROM files f JOIN {S_FILE_KEYWORDS} k ON k.id = f.id""",
)
def kl_local_classification(spark, d):
    """One row for each file from what the sampler has found out."""
    from ..operators.classify import local_classification

    return local_classification(spread(table(spark, d, "files"), "id").withColumn("keywords", T.keywords(C("content_sample"))))


_RAW = s(P.ABSOLUTE_PATH)
_IDS = rf"list_transform(regexp_extract_all(text, {_RAW}, 0), lambda p: '[path:' || substring(sha256(lower(regexp_replace(p, '[/\\]+', '/', 'g'))), 1, 20) || ']')"


@query(
    "f31_text_without_paths",
    rf"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_transform(list_zip(regexp_split_to_array(text, {_RAW}), list_concat({_IDS}, [''])), lambda z: z[1] || coalesce(z[2], '')), '') END AS text FROM documents""",
)
def f31_text_without_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", P.without_paths(C("text")).alias("text"))
