"""What source files hold: functions, secrets (masked), patterns, schemas, endpoints, prompts, settings, handlers, errors."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import fixed as X
from ..functions import text as T
from ..sources.samples import json_paths

C = F.col


def language(extension: Column) -> Column:
    return F.coalesce(P.lookup(F.lower(extension), X.LANGUAGES), F.lit("unknown"))


def zipped(content: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern as structs of its groups g1, g2, …"""
    found = [T.all_matches(content, pattern, g + 1) for g in range(groups)]
    return F.transform(F.arrays_zip(*[f.alias(f"g{i + 1}") for i, f in enumerate(found)]), lambda x: F.struct(*[x[f"g{i + 1}"].alias(f"g{i + 1}") for i in range(groups)]))


def matches(code: DataFrame, id: str, pattern: str, groups: int = 1) -> DataFrame:
    """(id, g1, g2, …) for each match of a pattern."""
    if groups == 1:
        return code.select(C(id).alias("id"), F.explode(T.all_matches(C("content"), pattern)).alias("g1"))
    return code.select(C(id).alias("id"), F.inline(zipped(C("content"), pattern, groups)))


def secrets(code: DataFrame, id: str) -> DataFrame:
    """(id, secret_type, line_number, preview): secrets by the patterns of their formats, never in clear."""
    lines = code.select(C(id).alias("id"), F.posexplode(F.split("content", "\n")).alias("line", "text"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("secret_type"), F.regexp_extract_all(C("text"), F.lit(p), F.lit(0)).alias("found")) for kind, p in X.SECRETS.items()])
    hit = lines.where(C("text").rlike("|".join(X.SECRETS.values()))).select("id", "line", F.inline(kinds)).select("id", "secret_type", (C("line") + 1).alias("line_number"), F.explode("found").alias("secret"))
    return hit.select("id", "secret_type", "line_number", T.mask_secret(C("secret")).alias("preview"))


def borne(text: Column) -> Column:
    """The design patterns of which a text bears a mark."""
    return F.array_compact(F.array(*[F.when(T.has(text, "(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in X.DESIGN.items()]))


def design_patterns(code: DataFrame, id: str) -> DataFrame:
    """(id, pattern): each design pattern of which a text bears a mark, once."""
    return code.select(C(id).alias("id"), F.explode(borne(C("content"))).alias("pattern"))


def schemas(code: DataFrame, id: str) -> DataFrame:
    """(id, schema_type, name): models, tables and interfaces."""
    lang = language(C("extension"))
    python, script = code.where(lang == "python"), code.where(lang.isin("javascript", "typescript"))
    models = zipped(C("content"), X.MODEL_CLASS, 1)
    bases = T.all_matches(C("content"), X.MODEL_BASE)
    named = python.select(C(id).alias("id"), F.inline(F.arrays_zip(F.transform(models, lambda m: m["g1"]).alias("name"), bases.alias("base"))))
    return (
        named.select("id", F.when(C("base") == "BaseModel", "pydantic").otherwise("typed_dict").alias("schema_type"), "name")
        .unionByName(matches(python, id, X.CREATE_TABLE).select("id", F.lit("sqlite_table").alias("schema_type"), C("g1").alias("name")))
        .unionByName(matches(script, id, X.TS_INTERFACE).select("id", F.lit("ts_interface").alias("schema_type"), C("g1").alias("name")))
    )


def endpoints(code: DataFrame, id: str) -> DataFrame:
    """(id, method, path) of routes, each once: a decorator is a route call with a sign before it."""
    return matches(code.where(language(C("extension")) != "unknown"), id, X.ENDPOINT, 2).select("id", F.upper("g1").alias("method"), C("g2").alias("path")).distinct()


def prompts(code: DataFrame, id: str) -> DataFrame:
    """(id, prompt_type, content, length) of prompts of more than fifty characters."""
    blocks = matches(code, id, X.PROMPT).select("id", F.lit("system_prompt").alias("prompt_type"), F.regexp_replace("g1", r"^\s+|\s+$", "").alias("body")).where(F.length("body") > 50)
    chats = matches(code, id, X.CHAT_PROMPT).select("id", F.lit("chat_system").alias("prompt_type"), C("g1").alias("body"))
    return blocks.unionByName(chats).select("id", "prompt_type", F.substring("body", 1, 1000).alias("content"), F.length("body").alias("length"))


def settings(code: DataFrame, id: str) -> DataFrame:
    """(id, key, value_preview): constants of Python files and references to the environment."""
    lang = language(C("extension"))
    constants = matches(code.where(lang == "python"), id, X.CONSTANT, 2).select("id", C("g1").alias("key"), F.substring(F.regexp_replace("g2", r"^\s+|\s+$", ""), 1, 80).alias("value_preview"))
    variables = matches(code.where(lang != "unknown"), id, X.ENVIRONMENT).select("id", C("g1").alias("key"), F.lit("env_var").alias("value_preview"))
    return constants.unionByName(variables)


def error_handlers(code: DataFrame, id: str) -> DataFrame:
    """(id, exception_type, handler_body) of what is caught."""
    lang = language(C("extension"))
    python = matches(code.where(lang == "python"), id, X.PY_HANDLER, 2)
    script = matches(code.where(lang.isin("javascript", "typescript")), id, X.JS_HANDLER, 2)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return python.unionByName(script).select("id", strip("g1").alias("exception_type"), F.substring(strip("g2"), 1, 300).alias("handler_body"))


def credential_uses(code: DataFrame, id: str) -> DataFrame:
    """(id, credential_key): names under which credentials are fetched, each once."""
    found = F.concat(*[T.all_matches(C("content"), p) for p in X.CREDENTIAL_USES])
    return code.select(C(id).alias("id"), F.explode(F.array_distinct(found)).alias("credential_key"))


def script_functions(code: DataFrame, id: str) -> DataFrame:
    """(id, name, line_number, args, body_hash) of functions in scripts, one per line, by the first form that fits.

    The body is the line and the twenty after it.
    """
    script = code.where(language(C("extension")).isin("javascript", "typescript"))
    lines = script.select(C(id).alias("id"), F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("lines"))

    def form(text: Column) -> Column:
        named = [(F.regexp_extract(text, n, 1), text.rlike(n), F.trim(F.regexp_extract(text, a, 1))) for n, a in X.JS_FUNCTIONS]
        return F.coalesce(*[F.when(fits & ~name.isin(*X.NO_FUNCTIONS), F.struct(name.alias("name"), args.alias("args"))) for name, fits, args in named])

    # only the lines that open a function leave the array, each with the hash of its body
    opened = F.filter(F.transform("lines", lambda text, at: F.struct(at.alias("at"), form(text).alias("f"))), lambda x: x["f"].isNotNull())
    hits = F.transform(opened, lambda x: F.struct(x["f"]["name"].alias("name"), (x["at"] + 1).alias("line_number"), x["f"]["args"].alias("args"), T.body_hash(F.array_join(F.slice("lines", x["at"] + 1, F.lit(21)), "\n")).alias("body_hash")))
    counted = F.size(F.filter(F.split("args", ","), lambda a: F.length(F.trim(a)) > 0)).alias("arg_count")
    return lines.select("id", F.inline(hits)).select("id", "name", "line_number", "args", counted, "body_hash")


def _annotated(arg: ast.arg) -> str:
    return arg.arg + (f": {ast.unparse(arg.annotation)}" if arg.annotation else "")


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[str, int]:
    """The signature as written and the number of parameters, each with all kinds of them."""
    a = node.args
    shown = [_annotated(p) for p in a.posonlyargs] + (["/"] if a.posonlyargs else []) + [_annotated(p) for p in a.args]
    if a.vararg or a.kwonlyargs:
        shown.append("*" + (_annotated(a.vararg) if a.vararg else ""))
    shown += [_annotated(p) for p in a.kwonlyargs]
    if a.kwarg:
        shown.append("**" + _annotated(a.kwarg))
    start = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{start} {node.name}({', '.join(shown)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""), len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)


def _grade(node: ast.FunctionDef | ast.AsyncFunctionDef) -> int:
    """Points for documentation, types, length, error handling and asynchrony."""
    plain = node.args.args
    length = (node.end_lineno or 0) - node.lineno
    points = 25 * bool(ast.get_docstring(node)) + 15 * (node.returns is not None) + (20 if 5 <= length <= 50 else 5 if length < 5 else 0)
    if plain:
        points += int(sum(p.annotation is not None for p in plain) / len(plain) * 20)
    points += 10 * any(isinstance(n, ast.Try) for n in ast.walk(node)) + 10 * isinstance(node, ast.AsyncFunctionDef)
    return min(100, points)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                continue
            lines = text.splitlines()
            for node in ast.walk(tree):
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                    signature, arguments = _signature(node)
                    body = textwrap.dedent("\n".join(lines[node.lineno - 1 : node.end_lineno]))
                    rows.append((i, node.name, node.lineno, signature, (ast.get_docstring(node) or "")[:500], body[:4000], body, arguments, isinstance(node, ast.AsyncFunctionDef), _grade(node)))
        c = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0], pa.int64())), *[pa.array(v, k) for v, k in zip(c[1:], kinds)]], names=["id", "name", "line_number", "signature", "docstring", "body", "whole", "arg_count", "is_async", "quality"])


def python_functions(code: DataFrame, id: str) -> DataFrame:
    """Functions of Python files that compile: name, line, signature, docstring, body, hash of the body, arguments, grade, design patterns."""
    source = code.where(F.lower("extension") == ".py").select(C(id).cast("long").alias("id"), "content")
    found = source.mapInArrow(_parsed, "id long, name string, line_number int, signature string, docstring string, body string, whole string, arg_count int, is_async boolean, quality int")
    return found.select("id", "name", "line_number", "signature", "docstring", "body", T.body_hash(C("whole")).alias("body_hash"), "arg_count", "is_async", "quality", borne(C("whole")).alias("patterns"))


def copy_counts(functions: DataFrame) -> DataFrame:
    """(body_hash, name, copies): in how many files a body occurs; the name is the smallest."""
    return functions.groupBy("body_hash").agg(F.min("name").alias("name"), F.count_distinct("id").alias("copies"))


LIBRARY = ("pattern", "schema", "endpoint", "prompt", "config", "error", "credential", "secret")


def extract_all(code: DataFrame, id: str) -> DataFrame:
    """(id, library, name, detail): what all extractors but those of functions find, over one read of the contents.

    Files of no known language give prompts, credentials and secrets only. A row is an entry of its library; entries of one
    file are gathered as arrays, which hold no more than its text does.
    """
    text, lang = C("content"), language(C("extension"))
    python, script, known = lang == "python", lang.isin("javascript", "typescript"), lang != "unknown"
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    none = F.array().cast("array<struct<library:string,name:string,detail:string>>")

    def entries(kind: str, found: Column, name, detail=None, when: Column | None = None) -> Column:
        out = F.transform(found, lambda x: F.struct(F.lit(kind).alias("library"), name(x).cast("string").alias("name"), (F.lit("") if detail is None else detail(x)).cast("string").alias("detail")))
        return out if when is None else F.when(when, out).otherwise(none)

    one = lambda pattern: T.all_matches(text, pattern)
    model = F.arrays_zip(one(X.MODEL_CLASS).alias("name"), one(X.MODEL_BASE).alias("base"))
    itself = lambda x: x
    g1, g2 = (lambda x: x["g1"]), (lambda x: x["g2"])
    long_prompts = F.filter(F.transform(one(X.PROMPT), bare), lambda x: F.length(x) > 50)

    def masked(kind: str, pattern: str) -> Column:
        found = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.regexp_extract_all(line, F.lit(pattern), F.lit(0))))
        return entries("secret", found, lambda x: F.lit(kind), T.mask_secret)

    parts = [
        entries("pattern", borne(text), itself, when=known),
        entries("schema", model, lambda x: x["name"], lambda x: F.when(x["base"] == "BaseModel", "pydantic").otherwise("typed_dict"), python),
        entries("schema", one(X.CREATE_TABLE), itself, lambda x: F.lit("sqlite_table"), python),
        entries("schema", one(X.TS_INTERFACE), itself, lambda x: F.lit("ts_interface"), script),
        entries("endpoint", F.array_distinct(F.transform(zipped(text, X.ENDPOINT, 2), lambda x: F.struct(F.upper(x["g1"]).alias("g1"), x["g2"].alias("g2")))), g2, g1, known),
        entries("prompt", long_prompts, lambda x: F.lit("system_prompt"), lambda x: F.substring(x, 1, 1000)),
        entries("prompt", one(X.CHAT_PROMPT), lambda x: F.lit("chat_system"), lambda x: F.substring(x, 1, 1000)),
        entries("config", zipped(text, X.CONSTANT, 2), g1, lambda x: F.substring(bare(x["g2"]), 1, 80), python),
        entries("config", one(X.ENVIRONMENT), itself, lambda x: F.lit("env_var"), known),
        entries("error", zipped(text, X.PY_HANDLER, 2), lambda x: bare(x["g1"]), lambda x: F.substring(bare(x["g2"]), 1, 300), python),
        entries("error", zipped(text, X.JS_HANDLER, 2), lambda x: bare(x["g1"]), lambda x: F.substring(bare(x["g2"]), 1, 300), script),
        entries("credential", F.array_distinct(F.concat(*[one(p) for p in X.CREDENTIAL_USES])), itself),
        *[masked(kind, pattern) for kind, pattern in X.SECRETS.items()],
    ]
    return code.where(text.isNotNull()).select(C(id).alias("id"), F.inline(F.concat(*parts)))


# --- errors ---------------------------------------------------------------------------------------------------------------


def severity(kind: Column) -> Column:
    return F.when(kind.isin(*X.CRITICAL_ERRORS), "critical").when(kind.isin(*X.HIGH_ERRORS), "high").when(kind.isin(*X.LOW_ERRORS), "low").otherwise("medium")


def strip(c: Column, marks: str = "") -> Column:
    out = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(out, f"^[{marks}]+|[{marks}]+$", "") if marks else out


def errors(texts: DataFrame, id: str) -> DataFrame:
    """(id, error_type, message, severity, category) of the errors raised, handled, thrown and logged in ``content`` by extension."""
    ext = F.lower("extension")
    scanned = texts.where((C("size_bytes") > 0) & (C("size_bytes") < X.LARGEST_SCANNED))
    python, script, logs = scanned.where(ext == ".py"), scanned.where(ext.isin(".js", ".ts", ".tsx", ".jsx")), scanned.where(ext.isin(*X.LOG_FILES))

    def named(rows: DataFrame, pattern: str, category: str, marks: str = "'\"") -> DataFrame:
        return matches(rows, id, pattern, 2).select("id", C("g1").alias("error_type"), F.substring(strip(C("g2"), marks), 1, 500).alias("message"), severity(C("g1")).alias("severity"), F.lit(category).alias("category"))

    handled = matches(python, id, X.HANDLED).select("id", F.explode(F.split("g1", r"\s*,\s*")).alias("error_type")).where("error_type not in ('', 'Exception')")
    handled = handled.select("id", "error_type", F.lit("Caught").alias("message"), F.lit("low").alias("severity"), F.lit("handled").alias("category"))
    console = matches(script, id, X.CONSOLE).select("id", F.lit("ConsoleError").alias("error_type"), F.substring("g1", 1, 500).alias("message"), F.lit("low").alias("severity"), F.lit("logged").alias("category"))
    line = matches(logs, id, X.LOGGED).select("id", F.substring(strip(C("g1")), 1, 500).alias("m"))
    kind = F.nullif(F.regexp_extract("m", f"(?d){X.LOGGED_TYPE}", 1), F.lit(""))
    logged = line.select("id", F.coalesce(kind, F.lit("LogError")).alias("error_type"), F.when(kind.isNull(), C("m")).otherwise(strip(F.regexp_extract("m", f"(?d){X.LOGGED_TYPE}", 2))).alias("message"), F.when(kind.isNull(), "medium").otherwise(severity(kind)).alias("severity"), F.lit("log").alias("category"))
    http = matches(logs, id, X.HTTP_STATUS, 2).select("id", F.concat(F.lit("HTTP"), "g1").alias("error_type"), F.substring(strip(C("g2")), 1, 500).alias("message"), F.when(C("g1") >= "500", "high").otherwise("medium").alias("severity"), F.lit("http").alias("category"))
    out = named(python, X.TRACEBACK, "traceback", "").unionByName(named(python, X.RAISED, "raised"))
    for part in (handled, named(script, X.THROWN, "thrown"), console, logged, http):
        out = out.unionByName(part)
    return out


def error_patterns(found: DataFrame) -> DataFrame:
    """(fingerprint, frequency, severity, id): errors folded by fingerprint; the first file stands for them."""
    keyed = found.withColumn("fingerprint", T.error_fingerprint(C("error_type"), C("message")))
    return keyed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct("id", "severity")).alias("f")).select("fingerprint", "frequency", "f.severity", "f.id")


def unknown_patterns(patterns: DataFrame, templates: DataFrame) -> DataFrame:
    """Patterns whose fingerprint is in no template."""
    return patterns.join(templates.select("fingerprint").distinct(), "fingerprint", "left_anti")


# --- structure of code, settings and documents ---------------------------------------------------------------------------


def signatures(code: DataFrame, id: str) -> DataFrame:
    """What a source text can do: functions, classes, imports, calls of other systems, capabilities, signs of fragments, lines."""
    text = C("content")
    flags = [T.has(text, p).alias(name) for name, p in X.CAPABILITIES.items()]
    fragments = F.concat(*[F.slice(F.regexp_extract_all(text, F.lit(T.lines_mode(p)), F.lit(0)), 1, 3) for p in X.FRAGMENTS])
    return code.select(
        C(id).alias("id"), F.slice(T.all_matches(text, X.FUNCTION_NAME), 1, 20).alias("functions"), F.slice(T.all_matches(text, X.CLASS_NAME), 1, 10).alias("classes"),
        F.slice(T.all_matches(text, X.IMPORT_NAME), 1, 20).alias("imports"), F.array_distinct(T.all_matches(text, X.API_CALL)).alias("api_calls"), *flags,
        fragments.alias("fragments"), (F.size(F.split(text, "\n")) - 1).alias("lines"),
    )


def line_counts(code: DataFrame, id: str) -> DataFrame:
    lines = F.split("content", "\n")
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return code.select(C(id).alias("id"), F.size(lines).alias("total_lines"), F.size(F.filter(lines, lambda x: bare(x) == "")).alias("blank_lines"), F.size(F.filter(lines, lambda x: bare(x).startswith("#") | bare(x).startswith("//"))).alias("comment_lines"))


# Functions and classes in files of other languages than Python, by extension; the first group that isn't empty is the name.
_SCRIPT_FUNCTION = r"(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w]+)\s*=>)"
FUNCTIONS_OF = {
    ".js": _SCRIPT_FUNCTION, ".ts": _SCRIPT_FUNCTION, ".tsx": _SCRIPT_FUNCTION, ".go": r"func\s+(?:\([^)]+\)\s+)?(\w+)", ".rs": r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", ".java": r"(?:public|private|protected)?\s+(?:static\s+)?[\w<>]+\s+(\w+)\s*\(",
}
CLASSES_OF = {e: r"class\s+(\w+)(?:\s+extends\s+(\w+))?" for e in (".js", ".ts", ".tsx", ".java")}
FRAMEWORKS = ("fastapi", "flask", "django", "express", "hono", "nextjs", "react", "vue", "svelte", "pydantic", "sqlalchemy", "torch")
CODE_FILES = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".cpp", ".c", ".cs")
CONFIG_FILES = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".conf")
DOCUMENT_FILES = (".md", ".txt", ".rst", ".adoc")
LARGEST_ASSIMILATED = 5 * 1024 * 1024


def _python_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, functions, classes, imports, has_async, has_types, has_docs) of Python texts; those that don't compile have none."""
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            functions, classes, imports, is_async, typed, told = [], [], [], False, False, False
            try:
                nodes = list(ast.walk(ast.parse(text)))
            except (SyntaxError, ValueError, RecursionError):
                nodes = []
            for n in nodes:
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                    functions.append(n.name)
                    is_async |= isinstance(n, ast.AsyncFunctionDef)
                    typed |= n.returns is not None
                    told |= bool(ast.get_docstring(n))
                elif isinstance(n, ast.ClassDef):
                    classes.append(n.name)
                elif isinstance(n, ast.Import):
                    imports += [a.name for a in n.names]
                elif isinstance(n, ast.ImportFrom) and n.module:
                    imports.append(n.module)
            rows.append((functions, classes, imports, is_async, typed, told))
        c = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.list_(pa.string())) for v in c[:3]], *[pa.array(v, pa.bool_()) for v in c[3:]]], names=["id", "functions", "classes", "imports", "has_async", "has_types", "has_docs"])


def code_structure(code: DataFrame, id: str) -> DataFrame:
    """(id, functions, classes, imports, has_async, has_types, has_docs): names that source files define and import.

    Python files by their syntax tree, others by patterns; imports are known of Python files only.
    """
    ext, text = F.lower("extension"), C("content")
    python = code.where((ext == ".py") & text.isNotNull()).select(C(id).cast("long").alias("id"), "content")
    parts = "id long, functions array<string>, classes array<string>, imports array<string>, has_async boolean, has_types boolean, has_docs boolean"
    nothing = F.array().cast("array<string>")

    def named(patterns: dict[str, str]) -> Column:
        case = None
        for e, p in patterns.items():
            two = F.transform(zipped(text, p, 2), lambda m: F.coalesce(F.nullif(m["g1"], F.lit("")), F.nullif(m["g2"], F.lit("")))) if p == _SCRIPT_FUNCTION else T.all_matches(text, p)
            case = F.when(ext == e, two) if case is None else case.when(ext == e, two)
        return F.array_compact(F.coalesce(case, nothing))

    no = F.lit(False)
    other = code.where(ext.isin(*CODE_FILES) & (ext != ".py") & text.isNotNull()).select(C(id).cast("long").alias("id"), named(FUNCTIONS_OF).alias("functions"), named(CLASSES_OF).alias("classes"), nothing.alias("imports"), no.alias("has_async"), no.alias("has_types"), no.alias("has_docs"))
    return python.mapInArrow(_python_parts, parts).unionByName(other)


def framework_counts(structure: DataFrame, least: int = 2) -> DataFrame:
    """(framework, occurrences): imports of frameworks in ``least`` places or more."""
    used = structure.select(F.explode("imports").alias("framework")).where(C("framework").isin(*FRAMEWORKS))
    return used.groupBy("framework").agg(F.count(F.lit(1)).alias("occurrences")).where(C("occurrences") >= least)


def assimilated(files: DataFrame, id: str) -> DataFrame:
    """(id, kind): which files are analysed as code, settings or documents, by extension; empty and very large ones aren't."""
    ext = F.lower("extension")
    kind = F.when(ext.isin(*CODE_FILES), "code").when(ext.isin(*CONFIG_FILES), "config").when(ext.isin(*DOCUMENT_FILES), "document")
    return files.where((C("size_bytes") > 0) & (C("size_bytes") <= LARGEST_ASSIMILATED) & kind.isNotNull()).select("*", kind.alias("kind"))


def assimilate(files: DataFrame, id: str) -> DataFrame:
    """(id, kind, keys): code with its functions and classes, settings with their keys, documents of more than twenty words with their headings.

    Files in which nothing of that is found are left out.
    """
    rows = assimilated(files, id)
    code, config, docs = (rows.where(C("kind") == k) for k in ("code", "config", "document"))
    structure = code_structure(code, id).where((F.size("functions") > 0) | (F.size("classes") > 0)).select("id", F.lit("code").alias("kind"), F.concat("functions", "classes").alias("keys"))
    settings_ = config_keys(config, id).select("id", "keys").unionByName(json_settings(config, id).select("id", "keys")).where(F.size("keys") > 0).select(C("id").cast("long").alias("id"), F.lit("config").alias("kind"), "keys")
    told = document_summaries(docs, id, "content").where("words > 20").select(C("id").cast("long").alias("id"), F.lit("document").alias("kind"), C("headings").alias("keys"))
    return structure.unionByName(settings_).unionByName(told)


def json_settings(files: DataFrame, id: str) -> DataFrame:
    """(id, keys, depth, has_env) of JSON files: at most fifty dotted keys, of lists those of the first item."""
    rows = files.where((F.lower("extension") == ".json") & C("content").isNotNull())
    facts = json_paths(rows, id, "content")
    env = rows.select(C(id).cast("long").alias("id"), T.has(C("content"), USES_ENVIRONMENT).alias("has_env"))
    return facts.join(env, "id").select("id", F.slice("keys", 1, 50).alias("keys"), "depth", "has_env")


CONFIG_KEYS = {
    (".yaml", ".yml"): (r"(?m)^(\w[\w.-]*):",), (".toml",): (r"(?m)^\[([^\]]+)\]", r"(?m)^(\w+)\s*="), (".ini", ".cfg"): (r"(?m)^\[([^\]]+)\]", r"(?m)^(\w+)\s*="), (".env", ".conf"): (r"(?m)^(\w+)=",),
}
USES_ENVIRONMENT = r"\$\{?\w+\}?|process\.env\.\w+|os\.environ"


def config_keys(files: DataFrame, id: str) -> DataFrame:
    """(id, keys, has_env) of configuration files, at most fifty keys each, by their format."""
    ext, text = F.lower("extension"), C("content")
    case = None
    for extensions, patterns in CONFIG_KEYS.items():
        keys = F.concat(*[T.all_matches(text, p) for p in patterns]) if len(patterns) > 1 else T.all_matches(text, patterns[0])
        case = F.when(ext.isin(*extensions), keys) if case is None else case.when(ext.isin(*extensions), keys)
    return files.where(text.isNotNull()).select(C(id).alias("id"), F.slice(case, 1, 50).alias("keys"), (T.has(text, USES_ENVIRONMENT) | ext.isin(".env", ".conf")).alias("has_env")).where("keys is not null")


def document_summaries(docs: DataFrame, id: str, content: str) -> DataFrame:
    """(id, title, headings, key_facts, links, words) of documents in light markup."""
    text = C(content)
    lines = F.split(text, "\n")
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    plain = lambda x: F.substring(F.regexp_replace(x, r"\*\*([^*]+)\*\*", "$1"), 1, 200)
    headings = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: bare(F.regexp_replace(x, "^#+", "")))
    bullet = lambda x: bare(x).startswith("- **") | bare(x).startswith("* **")
    facts = F.transform(F.filter(lines, lambda x: bullet(x) | bare(x).rlike(r"^\d+\.\s+\*\*")), lambda x: plain(F.when(bullet(x), F.regexp_replace(bare(x), r"^[- *]+", "")).otherwise(bare(x))))
    return docs.where(text.isNotNull()).select(
        C(id).alias("id"), F.substring(F.try_element_at(headings, F.lit(1)), 1, 200).alias("title"), F.slice(headings, 1, 20).alias("headings"), F.slice(facts, 1, 20).alias("key_facts"),
        F.slice(F.regexp_extract_all(text, F.lit(r"(https?://[^\s)\"'>]+)"), F.lit(1)), 1, 20).alias("links"), F.size(T.words(text)).alias("words"),
    )


def template_grade(occurrences: Column, keys: Column, depth: Column, has_types: Column, has_async: Column, has_docs: Column, lines: Column) -> Column:
    """(score, grade, maturity) of a template from its frequency, completeness, quality and rarity."""
    one = F.lit(1.0)
    frequency = F.least(occurrences / 20.0, one) * 0.25
    complete = F.least(keys / 30.0, one) * 0.15 + F.least(depth / 5.0, one) * 0.10
    quality = F.when(has_types, 0.08).otherwise(0.0) + F.when(has_async, 0.05).otherwise(0.0) + F.when(has_docs, 0.07).otherwise(0.0) + F.when(lines > 100, F.least(lines / 2000.0, one) * 0.05).otherwise(0.0)
    rare = F.greatest(F.lit(0.0), one - occurrences / 50.0) * 0.25
    score = F.round(F.least(frequency + complete + quality + rare, one) + 1e-9, 3)
    return F.struct(score.alias("score"), F.when(score >= 0.80, "A").when(score >= 0.65, "B").when(score >= 0.45, "C").when(score >= 0.25, "D").otherwise("F").alias("grade"), F.when(occurrences >= 10, "mature").when(occurrences >= 5, "established").otherwise("emerging").alias("maturity"))
