"""Queries of what source files, settings, documents and logs hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import history
from ..operators import library as L
from ..session import spread, table
from .catalog import query, s, s_has, s_in, s_lookup, s_matches, s_words

C = F.col

S_LANG = s_lookup("lower(extension)", X.LANGUAGES, "'unknown'")


def code(spark, d):
    return spread(table(spark, d, "code_files").where("content is not null").select("file_id", "path", "extension", "content", "size_bytes"), "file_id")


def texts(spark, d):
    """Samples as contents: logs, settings and notes have no other text."""
    return spread(table(spark, d, "files").where("content_sample is not null").select(C("id").alias("file_id"), "path", "extension", C("content_sample").alias("content"), "size_bytes"), "file_id")


S_CODE = "(SELECT file_id, path, extension, content, size_bytes FROM code_files WHERE content IS NOT NULL)"
S_TEXTS = "(SELECT id AS file_id, path, extension, content_sample AS content, size_bytes FROM files WHERE content_sample IS NOT NULL)"


def s_pairs(source: str, pattern: str, groups: int = 2, where: str = "true") -> str:
    cols = ", ".join(f"unnest({s_matches('content', pattern, g + 1)}) AS g{g + 1}" for g in range(groups))
    return f"SELECT file_id AS id, {cols} FROM {source} WHERE {where}"


@query("l1_python_functions")
def l1_python_functions(spark, d):
    """Functions of Python files that compile, by their syntax tree."""
    return L.python_functions(code(spark, d), "file_id")


@query("l2_copy_counts")
def l2_copy_counts(spark, d):
    return L.copy_counts(L.python_functions(code(spark, d), "file_id"))


_FORMS = " ".join(f"WHEN regexp_matches(text, {s(n)}) AND regexp_extract(text, {s(n)}, 1) NOT IN ({', '.join(map(s, X.NO_FUNCTIONS))}) THEN {i}" for i, (n, _) in enumerate(X.JS_FUNCTIONS))
_ARGS = "CASE form " + " ".join(f"WHEN {i} THEN trim(regexp_extract(text, {s(a)}, 1))" for i, (_, a) in enumerate(X.JS_FUNCTIONS)) + " END"
_NAMES = "CASE form " + " ".join(f"WHEN {i} THEN regexp_extract(text, {s(n)}, 1)" for i, (n, _) in enumerate(X.JS_FUNCTIONS)) + " END"


@query(
    "l3_script_functions",
    rf"""WITH a AS (SELECT file_id AS id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM {S_CODE} WHERE {S_LANG} IN ('javascript', 'typescript')),
b AS (SELECT id, lines, unnest(lines) AS text, generate_subscripts(lines, 1) AS n FROM a), c AS (SELECT *, CASE {_FORMS} END AS form FROM b)
SELECT id, {_NAMES} AS name, CAST(n AS INT) AS line_number, {_ARGS} AS args, CAST(len(list_filter(string_split({_ARGS}, ','), lambda x: length(trim(x)) > 0)) AS INT) AS arg_count,
substring(md5(trim(regexp_replace(array_to_string(list_slice(lines, n, n + 20), chr(10)), '\s+', ' ', 'g'))), 1, 16) AS body_hash FROM c WHERE form IS NOT NULL""",
)
def l3_script_functions(spark, d):
    return L.script_functions(code(spark, d), "file_id")


S_SECRETS = "WITH l AS (SELECT file_id AS id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {source}), m AS (" + " UNION ALL ".join(
    "SELECT id, n, %s AS secret_type, unnest(regexp_extract_all(text, %s, 0)) AS secret FROM l" % (s(kind), s(p).replace("{", "{{").replace("}", "}}")) for kind, p in X.SECRETS.items()
) + ") SELECT id, secret_type, CAST(n AS INT) AS line_number, CASE WHEN length(secret) <= 4 THEN '****' ELSE left(secret, 2) || '…' || right(secret, 2) || ' (len=' || length(secret) || ')' END AS preview FROM m"


@query("l4_masked_secrets", S_SECRETS.format(source=S_CODE))
def l4_masked_secrets(spark, d):
    """Secrets in whole source files."""
    return L.secrets(code(spark, d), "file_id")


@query("l4_masked_secrets_in_samples", S_SECRETS.format(source=S_TEXTS))
def l4_masked_secrets_in_samples(spark, d):
    """Secrets in the samples of all files: of settings and notes there is no other text."""
    return L.secrets(texts(spark, d), "file_id")


@query("l5_design_patterns", " UNION ALL ".join(f"SELECT file_id AS id, {s(name)} AS pattern FROM {S_CODE} WHERE {s_has('content', '(?i)' + '|'.join(f'(?:{p})' for p in patterns))}" for name, patterns in X.DESIGN.items()))
def l5_design_patterns(spark, d):
    return L.design_patterns(code(spark, d), "file_id")


@query(
    "l6_schemas",
    f"""SELECT id, CASE WHEN base = 'BaseModel' THEN 'pydantic' ELSE 'typed_dict' END AS schema_type, name FROM (SELECT file_id AS id, unnest({s_matches('content', X.MODEL_CLASS)}) AS name, unnest({s_matches('content', X.MODEL_BASE)}) AS base FROM {S_CODE} WHERE {S_LANG} = 'python')
UNION ALL SELECT id, 'sqlite_table', g1 FROM ({s_pairs(S_CODE, X.CREATE_TABLE, 1, f"{S_LANG} = 'python'")}) UNION ALL SELECT id, 'ts_interface', g1 FROM ({s_pairs(S_CODE, X.TS_INTERFACE, 1, f"{S_LANG} IN ('javascript', 'typescript')")})""",
)
def l6_schemas(spark, d):
    return L.schemas(code(spark, d), "file_id")


_unknown = f"{S_LANG} <> 'unknown'"


@query("l7_endpoints", f"SELECT DISTINCT id, upper(g1) AS method, g2 AS path FROM ({s_pairs(S_CODE, X.ENDPOINT, 2, _unknown)})")
def l7_endpoints(spark, d):
    return L.endpoints(code(spark, d), "file_id")


@query(
    "l8_prompts",
    rf"""SELECT id, 'system_prompt' AS prompt_type, substring(b, 1, 1000) AS content, CAST(length(b) AS INT) AS length FROM (SELECT id, regexp_replace(g1, '^\s+|\s+$', '', 'g') AS b FROM ({s_pairs(S_CODE, X.PROMPT, 1)})) WHERE length(b) > 50
UNION ALL SELECT id, 'chat_system', substring(g1, 1, 1000), CAST(length(g1) AS INT) FROM ({s_pairs(S_CODE, X.CHAT_PROMPT, 1)})""",
)
def l8_prompts(spark, d):
    return L.prompts(code(spark, d), "file_id")


@query(
    "l9_settings",
    rf"""SELECT id, g1 AS key, substring(regexp_replace(g2, '^\s+|\s+$', '', 'g'), 1, 80) AS value_preview FROM ({s_pairs(S_CODE, X.CONSTANT, 2, f"{S_LANG} = 'python'")})
UNION ALL SELECT id, g1, 'env_var' FROM ({s_pairs(S_CODE, X.ENVIRONMENT, 1, _unknown)})""",
)
def l9_settings(spark, d):
    return L.settings(code(spark, d), "file_id")


@query(
    "l10_error_handlers",
    rf"""SELECT id, regexp_replace(g1, '^\s+|\s+$', '', 'g') AS exception_type, substring(regexp_replace(g2, '^\s+|\s+$', '', 'g'), 1, 300) AS handler_body FROM (
{s_pairs(S_CODE, X.PY_HANDLER, 2, f"{S_LANG} = 'python'")} UNION ALL {s_pairs(S_CODE, X.JS_HANDLER, 2, f"{S_LANG} IN ('javascript', 'typescript')")})""",
)
def l10_error_handlers(spark, d):
    return L.error_handlers(code(spark, d), "file_id")


_USES = f"list_concat({', '.join(s_matches('content', p) for p in X.CREDENTIAL_USES)})"


@query("l11_credential_uses", f"SELECT DISTINCT file_id AS id, unnest({_USES}) AS credential_key FROM {S_CODE}")
def l11_credential_uses(spark, d):
    return L.credential_uses(code(spark, d), "file_id")


_BARED = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_SCRIPTS, _PYTHON = f"{S_LANG} IN ('javascript', 'typescript')", f"{S_LANG} = 'python'"
S_LIBRARY = " UNION ALL ".join(
    [
        *[f"SELECT file_id AS id, 'pattern' AS library, {s(name)} AS name, '' AS detail FROM {S_CODE} WHERE {_unknown} AND {s_has('content', '(?i)' + '|'.join(f'(?:{p})' for p in patterns))}" for name, patterns in X.DESIGN.items()],
        f"SELECT id, 'schema', name, CASE WHEN base = 'BaseModel' THEN 'pydantic' ELSE 'typed_dict' END FROM (SELECT file_id AS id, unnest({s_matches('content', X.MODEL_CLASS)}) AS name, unnest({s_matches('content', X.MODEL_BASE)}) AS base FROM {S_CODE} WHERE {_PYTHON})",
        f"SELECT id, 'schema', g1, 'sqlite_table' FROM ({s_pairs(S_CODE, X.CREATE_TABLE, 1, _PYTHON)})",
        f"SELECT id, 'schema', g1, 'ts_interface' FROM ({s_pairs(S_CODE, X.TS_INTERFACE, 1, _SCRIPTS)})",
        f"SELECT DISTINCT id, 'endpoint', g2, upper(g1) FROM ({s_pairs(S_CODE, X.ENDPOINT, 2, _unknown)})",
        f"SELECT id, 'prompt', 'system_prompt', substring(b, 1, 1000) FROM (SELECT id, {_BARED.format(c='g1')} AS b FROM ({s_pairs(S_CODE, X.PROMPT, 1)})) WHERE length(b) > 50",
        f"SELECT id, 'prompt', 'chat_system', substring(g1, 1, 1000) FROM ({s_pairs(S_CODE, X.CHAT_PROMPT, 1)})",
        f"SELECT id, 'config', g1, substring({_BARED.format(c='g2')}, 1, 80) FROM ({s_pairs(S_CODE, X.CONSTANT, 2, _PYTHON)})",
        f"SELECT id, 'config', g1, 'env_var' FROM ({s_pairs(S_CODE, X.ENVIRONMENT, 1, _unknown)})",
        f"SELECT id, 'error', {_BARED.format(c='g1')}, substring({_BARED.format(c='g2')}, 1, 300) FROM ({s_pairs(S_CODE, X.PY_HANDLER, 2, _PYTHON)} UNION ALL {s_pairs(S_CODE, X.JS_HANDLER, 2, _SCRIPTS)})",
        f"SELECT id, 'credential', credential_key, '' FROM (SELECT DISTINCT file_id AS id, unnest({_USES}) AS credential_key FROM {S_CODE})",
        f"SELECT id, 'secret', secret_type, preview FROM ({S_SECRETS.format(source=S_CODE)})",
    ]
)


@query("l12_all_but_functions", S_LIBRARY)
def l12_all_but_functions(spark, d):
    """Entries of all libraries over one read of the source files; functions need a syntax tree and have queries of their own."""
    return L.extract_all(code(spark, d), "file_id")


@query("k10_new_library_rows", f"SELECT DISTINCT id, library, name FROM ({S_LIBRARY}) n WHERE NOT EXISTS (SELECT 1 FROM ({S_LIBRARY}) o WHERE o.id = n.id AND o.library = n.library AND o.name = n.name AND o.id % 3 = 0)")
def k10_new_library_rows(spark, d):
    """What an append to the library may add: entries that aren't there, once each; those of every third file are there already."""
    rows = L.extract_all(code(spark, d), "file_id").select("id", "library", "name")
    return history.new_rows(rows, rows.where("id % 3 = 0"), ["id", "library", "name"])


@query("l12_library_sizes", f"SELECT library, count(*) AS entries, count(DISTINCT id) AS files FROM ({S_LIBRARY}) GROUP BY library")
def l12_library_sizes(spark, d):
    return L.extract_all(code(spark, d), "file_id").groupBy("library").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("id").alias("files"))


@query(
    "l13_library_counts",
    f"""SELECT 'patterns' AS library, count(*) AS entries FROM ({' UNION ALL '.join(f"SELECT 1 FROM {S_CODE} WHERE {s_has('content', '(?i)' + '|'.join(f'(?:{p})' for p in patterns))}" for patterns in X.DESIGN.values())})
UNION ALL SELECT 'secrets', count(*) FROM ({S_SECRETS.format(source=S_CODE)}) UNION ALL SELECT 'endpoints', count(*) FROM (SELECT DISTINCT id, upper(g1), g2 FROM ({s_pairs(S_CODE, X.ENDPOINT, 2, _unknown)}))
UNION ALL SELECT 'credentials', count(*) FROM (SELECT DISTINCT file_id, unnest({_USES}) FROM {S_CODE})""",
)
def l13_library_counts(spark, d):
    rows = code(spark, d)
    parts = {"patterns": L.design_patterns(rows, "file_id"), "secrets": L.secrets(rows, "file_id"), "endpoints": L.endpoints(rows, "file_id"), "credentials": L.credential_uses(rows, "file_id")}
    out = None
    for name, part in parts.items():
        n = part.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("library"), "entries")
        out = n if out is None else out.unionByName(n)
    return out


@query("l13_most_copied_functions")
def l13_most_copied_functions(spark, d):
    """The ten bodies in most files."""
    return L.copy_counts(L.python_functions(code(spark, d), "file_id")).orderBy(F.desc("copies"), "body_hash").limit(10)


# --- errors ---------------------------------------------------------------------------------------------------------------

_SEVERITY = f"CASE WHEN {{c}} IN ({', '.join(map(s, X.CRITICAL_ERRORS))}) THEN 'critical' WHEN {{c}} IN ({', '.join(map(s, X.HIGH_ERRORS))}) THEN 'high' WHEN {{c}} IN ({', '.join(map(s, X.LOW_ERRORS))}) THEN 'low' ELSE 'medium' END"
_SCANNED = f"size_bytes > 0 AND size_bytes < {X.LARGEST_SCANNED}"


def s_strip(c: str, marks: str = "") -> str:
    out = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"regexp_replace({out}, {s(f'^[{marks}]+|[{marks}]+$')}, '', 'g')" if marks else out


def _s_named(pattern: str, category: str, exts, marks: str = "'\"") -> str:
    return f"SELECT id, g1 AS error_type, substring({s_strip('g2', marks)}, 1, 500) AS message, {_SEVERITY.format(c='g1')} AS severity, {s(category)} AS category FROM ({s_pairs('{source}', pattern, 2, f'{_SCANNED} AND ' + s_in('lower(extension)', exts)).replace('{', '{{').replace('}', '}}').replace('{{source}}', '{source}')})"


_SCRIPT = (".js", ".ts", ".tsx", ".jsx")


def s_errors(source: str) -> str:
    handled = f"SELECT id, unnest(regexp_split_to_array(g1, '\\s*,\\s*')) AS error_type FROM ({s_pairs(source, X.HANDLED, 1, f'{_SCANNED} AND ' + s_in('lower(extension)', ('.py',)))})"
    logged = f"SELECT id, substring({s_strip('g1')}, 1, 500) AS m FROM ({s_pairs(source, X.LOGGED, 1, f'{_SCANNED} AND ' + s_in('lower(extension)', X.LOG_FILES))})"
    kind = f"nullif(regexp_extract(m, {s(X.LOGGED_TYPE)}, 1), '')"
    return " UNION ALL ".join(
        [
            _s_named(X.TRACEBACK, "traceback", (".py",), "").format(source=source),
            _s_named(X.RAISED, "raised", (".py",)).format(source=source),
            f"SELECT id, error_type, 'Caught', 'low', 'handled' FROM ({handled}) WHERE error_type NOT IN ('', 'Exception')",
            _s_named(X.THROWN, "thrown", _SCRIPT).format(source=source),
            f"SELECT id, 'ConsoleError', substring(g1, 1, 500), 'low', 'logged' FROM ({s_pairs(source, X.CONSOLE, 1, f'{_SCANNED} AND ' + s_in('lower(extension)', _SCRIPT))})",
            f"SELECT id, coalesce({kind}, 'LogError'), CASE WHEN {kind} IS NULL THEN m ELSE {s_strip(f'regexp_extract(m, {s(X.LOGGED_TYPE)}, 2)')} END, CASE WHEN {kind} IS NULL THEN 'medium' ELSE {_SEVERITY.format(c=kind)} END, 'log' FROM ({logged})",
            f"SELECT id, 'HTTP' || g1, substring({s_strip('g2')}, 1, 500), CASE WHEN g1 >= '500' THEN 'high' ELSE 'medium' END, 'http' FROM ({s_pairs(source, X.HTTP_STATUS, 2, f'{_SCANNED} AND ' + s_in('lower(extension)', X.LOG_FILES))})",
        ]
    )


S_FINGERPRINT = r"""error_type || '::' || substring(regexp_replace(regexp_replace(regexp_replace(message, '[0-9]+', 'N', 'g'), '[''"].*?[''"]', 'STR', 'g'), '/[\w/.-]+', 'PATH', 'g'), 1, 100)"""
_S_PATTERNS = f"SELECT fingerprint, count(*) AS frequency, first(severity ORDER BY id, severity) AS severity, min(id) AS id FROM (SELECT id, severity, {S_FINGERPRINT} AS fingerprint FROM ({s_errors(S_TEXTS)})) GROUP BY fingerprint"


@query("e2_errors", s_errors(S_TEXTS))
def e2_errors(spark, d):
    """Errors in samples of code and logs."""
    return L.errors(texts(spark, d), "file_id")


@query("e3_errors_in_code", s_errors(S_CODE))
def e3_errors_in_code(spark, d):
    """Errors in whole source files."""
    return L.errors(code(spark, d), "file_id")


@query("e5_error_patterns", _S_PATTERNS)
def e5_error_patterns(spark, d):
    return L.error_patterns(L.errors(texts(spark, d), "file_id"))


@query("e5_top_patterns", f"SELECT * FROM ({_S_PATTERNS}) ORDER BY frequency DESC, fingerprint LIMIT 20")
def e5_top_patterns(spark, d):
    """The twenty most frequent patterns."""
    return L.error_patterns(L.errors(texts(spark, d), "file_id")).orderBy(F.desc("frequency"), "fingerprint").limit(20)


@query("e5_new_error_patterns", f"WITH p AS ({_S_PATTERNS}) SELECT * FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE frequency >= 100)")
def e5_new_error_patterns(spark, d):
    """Patterns that are in no template; the frequent ones are the templates here."""
    patterns = L.error_patterns(L.errors(texts(spark, d), "file_id"))
    return L.unknown_patterns(patterns, patterns.where("frequency >= 100"))


# --- structure --------------------------------------------------------------------------------------------------------------

_FRAGMENTS = f"list_concat({', '.join(f'list_slice({s_matches("content", p, 0)}, 1, 3)' for p in X.FRAGMENTS)})"
S_SIGNATURES = f"""SELECT file_id AS id, list_slice({s_matches('content', X.FUNCTION_NAME)}, 1, 20) AS functions, list_slice({s_matches('content', X.CLASS_NAME)}, 1, 10) AS classes, list_slice({s_matches('content', X.IMPORT_NAME)}, 1, 20) AS imports,
list_distinct({s_matches('content', X.API_CALL)}) AS api_calls, {', '.join(f'{s_has("content", p)} AS {name}' for name, p in X.CAPABILITIES.items())}, {_FRAGMENTS} AS fragments, CAST(len(string_split(content, chr(10))) - 1 AS INT) AS lines FROM {{source}}"""


def s_signatures(source: str) -> str:
    return S_SIGNATURES.replace("{source}", source)


@query("f24_logic_signatures", f"SELECT id, array_to_string(functions, ' ') AS functions, array_to_string(classes, ' ') AS classes, array_to_string(imports, ' ') AS imports, array_to_string(list_sort(api_calls), ' ') AS api_calls, {', '.join(X.CAPABILITIES)}, array_to_string(fragments, ' ') AS fragments, lines FROM ({s_signatures(S_CODE)})")
def f24_logic_signatures(spark, d):
    found = L.signatures(code(spark, d), "file_id")
    joined = lambda c: F.array_join(c, " ").alias(c if isinstance(c, str) else "api_calls")
    return found.select("id", joined("functions"), joined("classes"), joined("imports"), joined(F.array_sort("api_calls")), *X.CAPABILITIES, joined("fragments"), "lines")


_BARE = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


@query("m1_line_counts", f"SELECT file_id AS id, CAST(len(l) AS INT) AS total_lines, CAST(len(list_filter(l, lambda x: {_BARE} = '')) AS INT) AS blank_lines, CAST(len(list_filter(l, lambda x: starts_with({_BARE}, '#') OR starts_with({_BARE}, '//'))) AS INT) AS comment_lines FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM {S_CODE})")
def m1_line_counts(spark, d):
    return L.line_counts(code(spark, d), "file_id")


@query("m1_code_structure")
def m1_code_structure(spark, d):
    """Functions, classes and imports of source files, Python files by their syntax tree."""
    return L.code_structure(code(spark, d), "file_id").select("id", F.array_join("functions", " ").alias("functions"), F.array_join("classes", " ").alias("classes"), F.array_join("imports", " ").alias("imports"), "has_async", "has_types", "has_docs")


@query("a11_framework_counts")
def a11_framework_counts(spark, d):
    return L.framework_counts(L.code_structure(code(spark, d), "file_id"))


@query("m2_json_settings")
def m2_json_settings(spark, d):
    """Dotted keys and depth of samples that are whole JSON."""
    return L.json_settings(texts(spark, d), "file_id").select("id", F.array_join("keys", " ").alias("keys"), "depth", "has_env")


@query("m4_assimilated")
def m4_assimilated(spark, d):
    """What is found in source files, settings and documents of fitting size, as many by kind."""
    rows = texts(spark, d).unionByName(code(spark, d))
    return L.assimilate(rows, "file_id").groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("keys")).alias("keys"))


_S_KEYS = "CASE " + " ".join(f"WHEN {s_in('lower(extension)', e)} THEN " + (f"list_concat({', '.join(s_matches('content', p) for p in ps)})" if len(ps) > 1 else s_matches("content", ps[0])) for e, ps in L.CONFIG_KEYS.items()) + " END"
S_CONFIG = f"SELECT file_id AS id, list_slice({_S_KEYS}, 1, 50) AS keys, {s_has('content', L.USES_ENVIRONMENT)} OR {s_in('lower(extension)', ('.env', '.conf'))} AS has_env FROM {S_TEXTS} WHERE {_S_KEYS} IS NOT NULL"


@query("m2_config_keys", f"SELECT id, array_to_string(keys, ' ') AS keys, has_env FROM ({S_CONFIG})")
def m2_config_keys(spark, d):
    return L.config_keys(texts(spark, d), "file_id").select("id", F.array_join("keys", " ").alias("keys"), "has_env")


@query("a11_common_config_keys", f"SELECT key, count(*) AS files FROM (SELECT id, unnest(list_distinct(keys)) AS key FROM ({S_CONFIG})) GROUP BY key HAVING count(*) >= 2")
def a11_common_config_keys(spark, d):
    keys = L.config_keys(texts(spark, d), "file_id").select("id", F.explode(F.array_distinct("keys")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("files")).where("files >= 2")


_HEAD = r"list_transform(list_filter(l, lambda x: starts_with(x, '#')), lambda x: regexp_replace(regexp_replace(x, '^#+', ''), '^\s+|\s+$', '', 'g'))"
_BULLET = f"(starts_with({_BARE}, '- **') OR starts_with({_BARE}, '* **'))"
_FACT = rf"list_transform(list_filter(l, lambda x: {_BULLET} OR regexp_matches({_BARE}, '^\d+\.\s+\*\*')), lambda x: substring(regexp_replace(CASE WHEN {_BULLET} THEN regexp_replace({_BARE}, '^[- *]+', '') ELSE {_BARE} END, '\*\*([^*]+)\*\*', '\1', 'g'), 1, 200))"
S_DOCS = rf"""SELECT id, substring({_HEAD}[1], 1, 200) AS title, array_to_string(list_slice({_HEAD}, 1, 20), '|') AS headings, array_to_string(list_slice({_FACT}, 1, 20), '|') AS key_facts,
array_to_string(list_slice(regexp_extract_all(text, '(https?://[^\s)"''>]+)', 1), 1, 20), ' ') AS links, CAST(len({s_words('text')}) AS INT) AS words FROM (SELECT {{key}} AS id, {{text}} AS text, string_split({{text}}, chr(10)) AS l FROM {{source}} WHERE {{text}} IS NOT NULL)"""


def _s_docs(key: str, text: str, source: str) -> str:
    return S_DOCS.replace("{key}", key).replace("{text}", text).replace("{source}", source)


def _docs(rows, key: str, text: str):
    found = L.document_summaries(rows, key, text)
    return found.select("id", "title", F.array_join("headings", "|").alias("headings"), F.array_join("key_facts", "|").alias("key_facts"), F.array_join("links", " ").alias("links"), "words")


@query("m3_document_summaries", _s_docs("doc_id", "text", "documents"))
def m3_document_summaries(spark, d):
    return _docs(table(spark, d, "documents"), "doc_id", "text")


@query("m3_note_summaries", _s_docs("id", "content_sample", "files"))
def m3_note_summaries(spark, d):
    return _docs(table(spark, d, "files"), "id", "content_sample")


@query("a11_document_totals", f"SELECT lang, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CAST(sum(length(links) > 0) AS BIGINT) AS with_links FROM ({_s_docs('doc_id', 'text', 'documents')}) s JOIN documents t ON t.doc_id = s.id GROUP BY lang")
def a11_document_totals(spark, d):
    docs = table(spark, d, "documents")
    found = _docs(docs, "doc_id", "text").join(docs.select(C("doc_id").alias("id"), "lang"), "id")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.count_if(F.length("links") > 0).alias("with_links"))


@query(
    "f32_template_grades",
    f"""WITH k AS (SELECT key, count(*) AS n, avg(len(keys)) AS m FROM (SELECT keys, unnest(list_distinct(keys)) AS key FROM ({S_CONFIG})) GROUP BY key),
g AS (SELECT key, n, round(least(least(n / 20.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + (least(m / 30.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + 0.0::DOUBLE) + 0.0::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - n / 50.0::DOUBLE) * 0.25::DOUBLE, 1.0::DOUBLE) + 1e-9::DOUBLE, 3) AS score FROM k)
SELECT key, score, CASE WHEN score >= 0.80 THEN 'A' WHEN score >= 0.65 THEN 'B' WHEN score >= 0.45 THEN 'C' WHEN score >= 0.25 THEN 'D' ELSE 'F' END AS grade, CASE WHEN n >= 10 THEN 'mature' WHEN n >= 5 THEN 'established' ELSE 'emerging' END AS maturity FROM g""",
)
def f32_template_grades(spark, d):
    """Grades of configuration keys as templates: how often they occur and how complete the files with them are."""
    keys = L.config_keys(texts(spark, d), "file_id").select("keys", F.explode(F.array_distinct("keys")).alias("key"))
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("keys")).alias("m"))
    no = F.lit(False)
    return counted.select("key", L.template_grade(C("n"), C("m"), F.lit(0), no, no, no, F.lit(0)).alias("g")).select("key", "g.*")
