"""Functions paired with their documentation, by an island grammar for each language.

The islands are comments, string literals, annotations, signatures and balanced bodies. Everything else is water and
skipped, so files that don't compile are read as well. A lexer finds the comments and literals of a language and blanks
them out, position by position; signatures are then matched on what is left and the documentation is looked up in the
comments (or, in Python, the literals) that the lexer has kept.

A file is worked off in a time that grows with its length: what each bracket closes and opens, where lines begin and what
ends a type are tables made once per file, and what stands before a name is read backwards from it.
"""

from __future__ import annotations

import inspect
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Languages by extension, words that look like a call but aren't, marks of empty documentation.
EXTENSIONS = {"py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust"}
CONTROL = {"if", "for", "while", "switch", "catch", "with", "return", "function", "super", "this", "new", "throw", "else", "do", "try", "finally", "synchronized", "await", "yield", "typeof", "delete", "void", "in", "of", "case", "import", "assert", "record", "class", "enum", "interface"}
UNWRITTEN = re.compile(r"\W*(?:TODO|FIXME|TBD|XXX)\b", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
LEAST_WORDS = 4


# How comments and literals are written.
_LINE, _BLOCK = r"//[^\n]*", r"/\*[^*]*(?:\*(?!/)[^*]*)*(?:\*/|\Z)"
_DOUBLE = r"\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*(?:\"|(?=\n)|\Z)"
_SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*(?:'|(?=\n)|\Z)"
_TRIPLE = r"\"\"\"[^\"\\]*(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*)*(?:\"\"\"|\Z)"
_TRIPLE_SINGLE = r"'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*(?:'''|\Z)"
_REGEX = r"(?:(?<=[=(,:!&|?;{}\[\n])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase))[ \t]*/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
ISLANDS = {
    "python": re.compile(rf"(?P<comment>#[^\n]*)|(?P<string>(?i:\b[rbuft]{{1,2}})?(?:{_TRIPLE}|{_TRIPLE_SINGLE}|{_DOUBLE}|{_SINGLE}))"),
    "javascript": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DOUBLE}|{_SINGLE}|{_REGEX})|(?P<template>`)"),
    "java": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_TRIPLE}|{_DOUBLE}|'(?:[^'\\\n]|\\.)+')"),
    "go": re.compile(rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>{_DOUBLE}|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)+')"),
    "rust": re.compile(r"(?P<comment>//[^\n]*)|(?P<nested>/\*)|(?P<string>\b[bc]?r(?P<hashes>#*)\"[\s\S]*?(?:\"(?P=hashes)|\Z)|b?\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*(?:\"|\Z)|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')"),
}
ISLANDS["typescript"] = ISLANDS["javascript"]
#: The same inside the ${ } of a template, where braces are counted.
SUBSTITUTED = re.compile(ISLANDS["javascript"].pattern + r"|(?P<brace>[{}])")
TEMPLATE_MARK = re.compile(r"\\|`|\$\{")
NESTED_MARK = re.compile(r"/\*|\*/")


class Code:
    """A text whose comments and literals are blanked, with tables of its brackets and lines, each made when it is first asked for."""

    def __init__(self, code: str, text: str | None = None, comments: list[tuple[int, int]] = [], strings: list[tuple[int, int]] = []):
        self.code, self.text = code, code if text is None else text
        self.comment_at, self.string_at = dict(comments), dict(strings)
        self.comment_before = {end: start for start, end in comments}
        self._closed: dict[str, dict[int, int]] = {}
        self._opened: dict[str, dict[int, int]] = {}

    def closed(self, at: int, pairs: str = "([{") -> int:
        """The position behind the bracket that closes the one at ``at``; -1 if it is never closed."""
        if pairs not in self._closed:
            found, open_ = {}, []
            for i in self._brackets(pairs):
                if self.code[i] in pairs:
                    open_.append(i)
                elif open_:
                    found[open_.pop()] = i + 1
            self._closed[pairs] = found
        return self._closed[pairs].get(at, -1)

    def opened(self, at: int, pairs: str = "([{") -> int:
        """The position of the bracket that the one at ``at`` closes; -1 if there is none."""
        if pairs not in self._opened:
            found, close = {}, []
            for i in reversed(self._brackets(pairs)):
                if self.code[i] not in pairs:
                    close.append(i)
                elif close:
                    found[close.pop()] = i
            self._opened[pairs] = found
        return self._opened[pairs].get(at, -1)

    def _brackets(self, pairs: str) -> list[int]:
        code = self.code
        if pairs == "<":  # arrows are no brackets
            return [m.start() for m in re.finditer(r"<|(?<![=\-])>", code)]
        return [m.start() for m in re.finditer("[" + "".join(re.escape(c + CLOSING[c]) for c in pairs) + "]", code)]

    @cached_property
    def line_ends(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line(self, at: int) -> int:
        return bisect_left(self.line_ends, at) + 1

    @cached_property
    def marks(self) -> list[int]:
        """Where a type may end or hold something in brackets."""
        return [m.start() for m in re.finditer(r"[=;{}()\[\]<,\n]", self.code)]

    def mark(self, at: int) -> int:
        i = bisect_left(self.marks, at)
        return self.marks[i] if i < len(self.marks) else -1

    @cached_property
    def python_lines(self) -> list[tuple[int, bool]]:
        """(width of the indentation, -1 without code; whether there is any text) of each line."""
        out = []
        for code, text in zip(self.code.split("\n"), self.text.split("\n")):
            rest = code.lstrip(" \t\f")
            out.append((width(code[: len(code) - len(rest)]) if rest.strip() else -1, bool(text.strip())))
        return out


@dataclass
class Function:
    """A function in its file: where its name, its head, its parameters, its body and its end are; stop is -1 for a body that is never closed."""

    lexed: Code
    name: str
    at: int
    start: int
    parameters: tuple[int, int]
    body: int
    stop: int
    doc: str | None

    @property
    def line(self) -> int:
        return self.lexed.line(self.at)

    @property
    def args(self) -> list[str]:
        return arguments(self.lexed.text[slice(*self.parameters)])

    @property
    def signature(self) -> str:
        return " ".join(self.lexed.text[self.start : self.body].split())

    @property
    def code(self) -> str:
        return self.lexed.text[self.start : self.stop].rstrip()


CLOSING = {"(": ")", "[": "]", "{": "}"}


def blanked(part: str) -> str:
    return "\n".join(" " * len(line) for line in part.split("\n")) if "\n" in part else " " * len(part)


def nested_end(text: str, at: int) -> int:
    """The position behind a comment that may hold comments, opened before ``at``."""
    depth = 1
    for m in NESTED_MARK.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def template_part(text: str, at: int) -> tuple[int, bool]:
    """The end of the literal part of a template that goes on at ``at``, and whether the template ends there rather than a ``${`` begins."""
    while (m := TEMPLATE_MARK.search(text, at)) is not None:
        if m.group() == "`":
            return m.end(), True
        if m.group() != "\\":
            return m.end(), False
        at = m.end() + 1
    return len(text), True


def lex(text: str, language: str) -> Code:
    """The text with its comments and literals blanked; ``${ }`` in a template becomes ``%( )`` around the code inside."""
    out, at, comments, strings = [], 0, [], []
    search, depths = ISLANDS[language].search, []  # of braces, in each open ${
    inside = SUBSTITUTED.search
    while (m := (inside if depths else search)(text, at)) is not None:
        start, end = m.span()
        kind = m.lastgroup
        out.append(text[at:start])
        if kind == "brace":
            if text[start] == "{" or depths[-1]:
                depths[-1] += 1 if text[start] == "{" else -1
                out.append(text[start])
                at = end
                continue
            depths.pop()
            out.append(")")
            start = end
        if kind in ("template", "brace"):
            end, ended = template_part(text, end)
            out.append(blanked(text[start:end]) if ended else blanked(text[start : end - 2]) + "%(")
            if not ended:
                depths.append(0)
        else:
            if kind == "nested":
                end = nested_end(text, end)
            (strings if kind == "string" else comments).append((start, end))
            out.append(blanked(text[start:end]))
        at = max(end, start)
    out.append(text[at:])
    return Code("".join(out), text, comments, strings)


def spaces(code: str, at: int) -> int:
    while at < len(code) and code[at].isspace():
        at += 1
    return at


def spaces_back(code: str, at: int) -> int:
    while at > 0 and code[at - 1].isspace():
        at -= 1
    return at


def word_back(code: str, at: int) -> int:
    """Where the word that ends at ``at`` begins; ``at`` if none ends there."""
    while at > 0 and (code[at - 1].isalnum() or code[at - 1] in "_$"):
        at -= 1
    return at


def head_start(lexed: Code, at: int, words: frozenset[str], owners: bool = False) -> int:
    """Where the head of a declaration begins whose name is at ``at``: before it stand some of ``words``, and ``a.b.`` if ``owners``."""
    code = lexed.code
    while True:
        end = spaces_back(code, at)
        if owners and code[end - 1 : end] == ".":
            end = spaces_back(code, end - 1)
            start = word_back(code, end)
            if start == end:
                return at
            at = start
            continue
        stop = lexed.opened(end - 1) if code[end - 1 : end] == ")" and "pub" in words else -1
        end = end if stop < 0 else spaces_back(code, stop)
        start = word_back(code, end)
        if code[start:end] not in words or start == end or stop >= 0 and code[start:end] != "pub":
            return at
        at, owners = start, False


def arguments(text: str) -> list[str]:
    """The parts of a parameter list between commas outside of brackets."""
    parts, depth, last = [], 0, 0
    for m in ARGUMENT_MARK.finditer(text):
        c, i = m.group(), m.start()
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("=", "-"):
            depth -= 1
        elif c == "," and depth <= 0:
            parts.append(text[last:i])
            last = i + 1
    parts.append(text[last:])
    return [" ".join(p.split()) for p in parts if p.strip()]


ARGUMENT_MARK = re.compile(r"[()\[\]{}<>,]")


# --- what documentation says ------------------------------------------------------------------------------------------


def without_marks(comment: str) -> str:
    lines = []
    for line in re.sub(r"^/\*+|\*+/$", "", comment).split("\n"):
        lines.append(re.sub(r"^\s*(?:///?|\*+)? ?", "", line).rstrip())
    return "\n".join(lines).strip()


def says_something(doc: str | None, name: str) -> bool:
    """Whether documentation is neither missing nor trivial."""
    if not doc:
        return False
    told = "\n".join(line for line in doc.split("\n") if line.strip()[:1] not in ("@", ":"))
    words = LETTERS.findall(told)
    if len(words) < LEAST_WORDS or UNWRITTEN.match(told.strip()):
        return False
    return "".join(words).lower() != "".join(LETTERS.findall(name)).lower()


# --- Python -----------------------------------------------------------------------------------------------------------

PY_DEF = re.compile(r"^(?=[^\n]*\bdef\b)(?P<indent>[ \t\f]*)(?:[^\n:]*?:[ \t]*)??(?P<head>(?:async[ \t]+)?def[ \t]+(?P<name>\w+))[ \t]*(?P<generic>\[)?", re.M)
PY_PREFIX = re.compile(r"(?i)^[a-z]*")
PY_OWNER = re.compile(r"(?:class|if|else|try|elif|for|while|with|finally|except)\b")
PY_LAST_COLON = re.compile(r":[ \t]*(?=\n|\Z)")
PY_COLON_AT_END = re.compile(r":[ \t]*(?=\n)")
PY_HEAD_MARK = re.compile(r"[:\n(\[{]")


def width(indent: str) -> int:
    return len(indent.expandtabs(8))


def python_docstring(lexed: Code, at: int, indent: int) -> str | None:
    """The docstring of a body that begins at ``at``, behind the colon."""
    code, text, string_at, comment_at = lexed.code, lexed.text, lexed.string_at, lexed.comment_at
    depth, inline = 0, True
    while at < len(text) and at not in string_at:
        if at in comment_at:
            at = comment_at[at]
            continue
        c = text[at]
        if c == "\n":
            inline = False
        elif c == "(":
            depth += 1
        elif not (c.isspace() or c == "\\"):
            return None
        at += 1
    if at >= len(text):
        return None
    begin = lexed.line_ends[i - 1] + 1 if (i := bisect_left(lexed.line_ends, at)) else 0
    if not inline and not depth and width(text[begin:at]) <= indent:
        return None
    pieces = []
    while at in string_at:
        literal = text[at : string_at[at]]
        prefix = PY_PREFIX.match(literal).group().lower()
        if set(prefix) & set("bft"):
            return None
        body = literal[len(prefix) :]
        quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        if not (body.endswith(quote) and len(body) >= 2 * len(quote)):
            return None
        pieces.append(body[len(quote) : -len(quote)])
        at = string_at[at]
        while at < len(text) and (text[at] in " \t\f" or text[at : at + 2] == "\\\n" or depth and text[at] in "\n)"):
            depth -= text[at] == ")"
            at += 2 if text[at] == "\\" else 1
    if depth > 0 or code[at : at + 1] not in ("", "\n", ";") and at not in comment_at:
        return None
    return inspect.cleandoc("".join(pieces))


def python_head_end(lexed: Code, at: int) -> int:
    """The position behind the colon that ends a head whose parameters end at ``at``; -1 if the line has none."""
    while (m := PY_HEAD_MARK.search(lexed.code, at)) is not None:
        c = m.group()
        if c == ":":
            return m.end()
        if c == "\n" and lexed.code[m.start() - 1] != "\\":
            return -1
        at = m.end() if c == "\n" else max(m.end(), lexed.closed(m.start()))
    return -1


def python_functions(lexed: Code) -> Iterator[Function]:
    code, text, lines = lexed.code, lexed.text, lexed.python_lines
    found = list(PY_DEF.finditer(code))
    for m, following in zip(found, [*found[1:], None]):
        before = code[m.end("indent") : m.start("head")]
        if before and not PY_OWNER.match(before):
            continue
        at = spaces(code, m.end("name"))
        if code[at : at + 1] == "[" and (end := lexed.closed(at)) > 0:
            at = spaces(code, end)
        if code[at : at + 1] != "(":
            continue
        close = lexed.closed(at)
        if close < 0 or following and close > following.start("head"):  # a bracket is missing: the line with the colon ends the head
            colon = PY_COLON_AT_END.search(code, at, following.start("head")) if following else PY_LAST_COLON.search(code, at)
            if not colon:
                continue
            close, end = colon.start(), colon.end()
        elif (end := python_head_end(lexed, close)) < 0:
            continue
        indent = width(m["indent"])
        number = lexed.line(end)
        last = number
        for i in range(number, len(lines)):
            if 0 <= lines[i][0] <= indent:
                break
            if lines[i][1]:
                last = i + 1
        stop = lexed.line_ends[last - 1] if last <= len(lexed.line_ends) else len(text)
        yield Function(lexed, m["name"], m.start("name"), m.start("head"), (at + 1, close - 1), end, stop, python_docstring(lexed, end, indent))


# --- languages with braces ----------------------------------------------------------------------------------------------

NAME = r"[A-Za-z_$][\w$]*"
JS_HEAD = frozenset("export default const let var public private protected static readonly".split())
JS_FUNCTION = re.compile(rf"\bfunction\b\s*\*?\s*(?P<name>{NAME})\s*(?=[(<])")
JS_FUNCTION_HEAD = frozenset("export default declare async".split())
JS_METHOD = re.compile(rf"(?:^|(?<=[{{}};,]))(?P<head>[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract|accessor)\s+)*\*?[ \t]*)(?P<name>#?{NAME})\s*\??(?=[(<])", re.M)
JS_GIVEN = re.compile(rf"(?<![\w$])(?P<name>#?{NAME})\s*(?:=(?![=>])|(?P<colon>:)(?!:))")
JS_VALUE = re.compile(rf"\s*(?:async\b\s*)?(?:(?P<kind>function\b)\s*\*?\s*(?:{NAME}\s*)?(?=[(<])|(?=[(<])|(?P<one>{NAME})\s*(?==>))")
JAVA_CALLABLE = re.compile(rf"(?<![\w$.@])(?P<name>{NAME})\s*\(")
JAVA_HEAD = frozenset("public protected private static final abstract synchronized native default strictfp".split())
JAVA_PARAMETER = re.compile(rf"(?:(?:final|@[\w.]+(?:\([^()]*\))?)\s+)*{NAME}[\w$.<>\[\]?,&\s]*(?:\s|\.\.\.|[>\]])\s*{NAME}(?:\s*\[\s*\])*$")
JAVA_GIVEN = re.compile(rf"(?<![\w$])(?P<head>(?:(?:public|protected|private|static|final)\s+)*(?P<type>{NAME}(?:\.{NAME})*(?:\s*<[^;{{}}()=]*>)?)\s+)(?P<name>{NAME})\s*=\s*(?P<kind>(?=\()|(?P<one>{NAME})\s*(?=->))")
GO_FUNCTION = re.compile(r"\bfunc\s*(?:\([^()]*\)\s*)?(?P<name>[^\W\d]\w*)\s*(?=[(\[])")
GO_VALUE = re.compile(r"=\s*func\s*(?=\()")
RUST_FUNCTION = re.compile(r"\bfn\s+(?P<name>(?:r#)?[^\W\d]\w*)\s*(?=[(<])")
RUST_HEAD = frozenset("pub default const async unsafe safe extern".split())
RUST_GIVEN = re.compile(r"(?P<head>\blet\s+(?:mut\s+)?)(?P<name>[^\W\d]\w*)\s*(?::[^=;]*)?=\s*(?:async\s+)?(?:move\s+)?(?=\|)")
WORD = re.compile(r"[\w$.?*!'+]+")
#: Words of a type that more of the type follows.
UNFINISHED = frozenset("extends keyof typeof throws is dyn impl interface struct".split())
EXPRESSION_MARK = re.compile(r"[()\[\]{};,\n]")


def doc_before(lexed: Code, at: int, language: str) -> str | None:
    """The documentation directly above the declaration at ``at``: nothing but annotations or attributes between."""
    code, text = lexed.code, lexed.text
    found: list[str] = []
    while True:
        gap_end = at
        at = spaces_back(text, at)
        start = lexed.comment_before.get(at)
        if start is not None:
            comment = text[start:at]
            if language in ("javascript", "typescript", "java"):
                return without_marks(comment) if re.match(r"/\*\*(?!/)", comment) else None
            if language == "rust":
                if not re.match(r"///(?!/)", comment):
                    break
                found.append(without_marks(comment))
                at = start
                continue
            # Go: comments on lines of their own that touch each other and the function
            if text.count("\n", at, gap_end) > 1 or spaces_back(text, start) > (lexed.line_ends[i - 1] if (i := bisect_left(lexed.line_ends, start)) else -1) + 1:
                break
            if not re.match(r"//(?:go:|line |nolint)", comment):
                found.append(without_marks(comment))
            at = start
            continue
        if language in ("java", "javascript", "typescript") and at > 0:
            start = annotation_start(lexed, at)
            if start >= 0:
                at = start
                continue
        if language == "rust" and code[at - 1 : at] == "]":
            start = lexed.opened(at - 1)
            mark = spaces_back(code, start)
            if start >= 1 and code[mark - 1 : mark] == "#":
                at = mark - 1
                continue
        break
    return "\n".join(reversed(found)).strip() or None


def annotation_start(lexed: Code, at: int) -> int:
    """Where an annotation that ends at ``at`` begins; -1 if none ends there."""
    code = lexed.code
    if code[at - 1] == ")":
        at = lexed.opened(at - 1)
        if at < 0:
            return -1
        at = spaces_back(code, at)
    start = at
    while start > 0 and (code[start - 1].isalnum() or code[start - 1] in "_$."):
        start -= 1
    return start - 1 if start < at and code[start - 1 : start] == "@" else -1


def typed_end(lexed: Code, at: int, language: str) -> int:
    """The position of the brace that opens a body behind a parameter list (return type, throws, where); -1 if there is none."""
    code, needs_type, first = lexed.code, False, True
    while at < len(code):
        before, at = at, spaces(code, at)
        c = code[at : at + 1]
        if not c or c in ";)]}":
            return -1
        if c == "{" and not needs_type:
            return at
        if first:
            if language in ("javascript", "typescript") and c != ":" or language == "java" and c not in "[@" and not code.startswith("throws", at) or language == "rust" and not code.startswith(("->", "where"), at):
                return -1
            first = False
        if not needs_type and language in ("go", "javascript", "typescript") and (language == "go" or c.isalnum() or c in "_$([#@*\"'") and "\n" in code[before:at]:
            return -1  # the declaration has ended with its line
        if c in "([{":
            at = lexed.closed(at)
            if at < 0:
                return -1
            needs_type = False
        elif c == "<":
            at = max(at + 1, lexed.closed(at, "<"))
            needs_type = False
        elif code.startswith(("=>", "->"), at):
            at, needs_type = at + 2, True
        elif c in ":|&,":
            at, needs_type = at + 1, True
        elif c == "=":
            return -1
        elif m := WORD.match(code, at):
            needs_type = m.group() in UNFINISHED
            at = m.end()
        else:
            at += 1
    return -1


def arrow_body(lexed: Code, at: int) -> int:
    """The position behind the arrow of an arrow function whose parameters end at ``at``; -1 if there is none."""
    code = lexed.code
    at = spaces(code, at)
    if code[at : at + 1] != ":":
        return spaces(code, at + 2) if code.startswith(("=>", "->"), at) else -1
    while True:  # return type
        at = lexed.mark(at)
        c = code[at] if at >= 0 else ""
        if not c or c in ";)]}":  # what holds it ends
            return -1
        if code.startswith("=>", at):
            return spaces(code, at + 2)
        if c in "([{":
            at = lexed.closed(at)
            if at < 0:
                return -1
        else:
            at = max(at + 1, lexed.closed(at, "<") if c == "<" else -1)


def expression_end(lexed: Code, at: int) -> int:
    code, begin = lexed.code, at
    while (m := EXPRESSION_MARK.search(code, at)) is not None:
        c, i = m.group(), m.start()
        if c in "([{":
            at = lexed.closed(i)
            if at < 0:
                return len(code)
        elif c in ")]};," or i > spaces(code, begin):
            return i
        else:
            at = m.end()
    return len(code)


def typed_value(lexed: Code, at: int) -> int:
    """The position behind the ``=`` that follows a type beginning at ``at``; -1 if none does."""
    code, brackets = lexed.code, False
    while (p := lexed.mark(at)) >= 0:
        c = code[p]
        if c == "=":
            if code.startswith("=>", p):
                if not brackets:
                    return -1
                at, brackets = p + 2, False
                continue
            return -1 if code.startswith("==", p) else p + 1
        if c in "([{":
            at = lexed.closed(p)
            if at < 0:
                return -1
            brackets = c == "("
        elif c == "<":
            at = max(p + 1, lexed.closed(p, "<"))
        else:
            return -1
    return -1


def declared(lexed: Code, name: str, named: int, start: int, at: int, language: str, given: bool = False) -> Function | None:
    """The function called ``name`` whose type or parameter list begins at ``at``, if it has a body."""
    code = lexed.code
    if code[at : at + 1] in ("<", "["):
        at = lexed.closed(at, code[at])
        if at < 0:
            return None
        at = spaces(code, at)
    if code[at : at + 1] != "(":
        return None
    close = lexed.closed(at)
    if close < 0:
        return None
    body = arrow_body(lexed, close) if given else typed_end(lexed, close, language)
    if body < 0:
        return None
    if code[body : body + 1] == "{":
        stop = lexed.closed(body, "{")
    elif given:
        stop = expression_end(lexed, body)
    else:
        return None
    return Function(lexed, name.lstrip("#").removeprefix("r#"), named, start, (at + 1, close - 1), body, stop, doc_before(lexed, start, language))


def short_arrow(lexed: Code, name: str, named: int, start: int, one: tuple[int, int], language: str) -> Function | None:
    """The arrow function of one parameter without brackets that is given to ``name``."""
    body = arrow_body(lexed, one[1])
    if body < 0:
        return None
    stop = lexed.closed(body, "{") if lexed.code[body : body + 1] == "{" else expression_end(lexed, body)
    return Function(lexed, name.lstrip("#"), named, start, one, body, stop, doc_before(lexed, start, language))


def script_functions(lexed: Code, language: str) -> Iterator[Function | None]:
    code, given = lexed.code, set()
    for m in JS_GIVEN.finditer(code):
        if m["name"] in CONTROL or m["name"] in ("case", "default"):
            continue
        typed = typed_value(lexed, m.end()) if m["colon"] else -1
        value = (JS_VALUE.match(code, typed) if typed >= 0 else None) or JS_VALUE.match(code, m.end())
        if value is None:
            continue
        start = head_start(lexed, m.start("name"), JS_HEAD, owners=True)
        if value["one"]:
            yield short_arrow(lexed, m["name"], m.start("name"), start, value.span("one"), language)
            continue
        if value["kind"]:
            given.add(value.start("kind"))
        yield declared(lexed, m["name"], m.start("name"), start, spaces(code, value.end()), language, given=not value["kind"])
    for m in JS_FUNCTION.finditer(code):
        if m.start() not in given:
            yield declared(lexed, m["name"], m.start("name"), head_start(lexed, m.start(), JS_FUNCTION_HEAD), spaces(code, m.end()), language)
    for m in JS_METHOD.finditer(code):
        if m["name"] not in CONTROL:
            start = m.start("head") + len(m["head"]) - len(m["head"].lstrip()) if m["head"].strip() else m.start("name")
            yield declared(lexed, m["name"], m.start("name"), start, spaces(code, m.end()), language)


def java_start(lexed: Code, at: int, parameters: str) -> int:
    """Where the head of the method or constructor begins whose name is at ``at``; -1 if what stands there declares none."""
    code = lexed.code
    end = spaces_back(code, at)
    while code[end - 1 : end] == "]" and (start := lexed.opened(end - 1)) >= 0:
        end = spaces_back(code, start)
    generic = end
    if code[end - 1 : end] == ">" and (start := lexed.opened(end - 1, "<")) >= 0:
        generic = spaces_back(code, start)
    start = word_back(code, generic)
    word = code[start:generic]
    if not word or word in JAVA_HEAD:  # a constructor; enum constants with a body look like it but for their parameters
        if code[end - 1 : end] in (".", "@") or not word and parameters.strip() and not all(JAVA_PARAMETER.match(p) for p in arguments(parameters)):
            return -1
        at = at if generic == end else start + len(word) if word else generic
        at = spaces(code, at)
    elif word in CONTROL and word != "void" or word[0].isdigit():
        return -1
    else:
        while code[(stop := spaces_back(code, start)) - 1 : stop] == ".":
            stop = spaces_back(code, stop - 1)
            start = word_back(code, stop)
        if code[stop - 1 : stop] == "@" or code[word_back(code, stop) : stop] == "new":
            return -1
        at = start
    while True:  # modifiers, types of the method and annotations among them
        stop = spaces_back(code, at)
        if code[stop - 1 : stop] == ">" and (start := lexed.opened(stop - 1, "<")) >= 0:
            at = start
            continue
        start = word_back(code, stop)
        if code[start - 1 : start] == "@" and code[word_back(code, spaces_back(code, start - 1)) : spaces_back(code, start - 1)] in JAVA_HEAD:
            at = start - 1
        elif code[start:stop] in JAVA_HEAD and start < stop:
            at = start
        else:
            return at


def java_functions(lexed: Code) -> Iterator[Function | None]:
    code = lexed.code
    for m in JAVA_CALLABLE.finditer(code):
        at = m.end() - 1
        close = lexed.closed(at)
        if m["name"] in CONTROL or close < 0 or typed_end(lexed, close, "java") < 0:
            continue
        start = java_start(lexed, m.start("name"), code[at + 1 : close - 1])
        if start >= 0:
            yield declared(lexed, m["name"], m.start("name"), start, at, "java")
    for m in JAVA_GIVEN.finditer(code):
        if m["type"] in CONTROL:
            continue
        if m["one"]:
            yield short_arrow(lexed, m["name"], m.start("name"), m.start("head"), m.span("one"), "java")
        else:
            yield declared(lexed, m["name"], m.start("name"), m.start("head"), spaces(code, m.end()), "java", given=True)


def go_functions(lexed: Code) -> Iterator[Function | None]:
    code = lexed.code
    for m in GO_FUNCTION.finditer(code):
        yield declared(lexed, m["name"], m.start("name"), m.start(), spaces(code, m.end()), "go")
    for m in GO_VALUE.finditer(code):  # the name is before it, with a type between at most
        end = m.start() - (code[m.start() - 1 : m.start()] == ":")
        start = end
        while start > 0 and (code[start - 1].isalnum() or code[start - 1] in "_.[]* "):
            start -= 1
        if (name := re.compile(r"[ .\[\]*\d]*(?P<head>(?:var +)?)(?P<name>[^\W\d]\w*)").match(code, start, end)) is not None:
            yield declared(lexed, name["name"], name.start("name"), name.start("head"), spaces(code, m.end()), "go")


def rust_functions(lexed: Code) -> Iterator[Function | None]:
    code = lexed.code
    for m in RUST_FUNCTION.finditer(code):
        yield declared(lexed, m["name"], m.start("name"), head_start(lexed, m.start(), RUST_HEAD), spaces(code, m.end()), "rust")
    for m in RUST_GIVEN.finditer(code):
        open_ = code.index("|", m.end())
        close = code.find("|", open_ + 1)
        if close > 0:
            yield Function(lexed, m["name"], m.start("name"), m.start("head"), (open_ + 1, close), close + 1, expression_end(lexed, close + 1), doc_before(lexed, m.start("head"), "rust"))


def brace_functions(lexed: Code, language: str) -> Iterator[Function]:
    found = {"java": java_functions, "go": go_functions, "rust": rust_functions}.get(language)
    seen: set[int] = set()
    for f in found(lexed) if found else script_functions(lexed, language):
        if f is not None and f.at not in seen:
            seen.add(f.at)
            yield f


def language_of(language: str | None, extension: str | None, path: str | None) -> str | None:
    """The language as given, else by the extension, else by the path; null if none of them is known."""
    named = (language or "").strip().lower()
    if named in ISLANDS:
        return named
    for hint in (extension, (path or "").rpartition(".")[2]):
        if (found := EXTENSIONS.get((hint or "").strip().lower().lstrip("."))) is not None:
            return found
    return EXTENSIONS.get(named)


def functions(content: str, language: str) -> list[Function]:
    """All functions of a source file in the order of their names' positions, documented or not.

    A body that is never closed reaches to the next function.
    """
    text = content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lexed = lex(text, language)
    found = python_functions(lexed) if language == "python" else brace_functions(lexed, language)
    out = sorted(found, key=lambda f: f.at)
    for f, following in zip(out, [*out[1:], None]):
        if f.stop < 0:
            f.stop = max(f.body, following.start) if following else len(text)
    return out


def documented(df: DataFrame, id: str = "file_id", content: str = "content", language: str = "language", extension: str = "extension", path: str = "path") -> DataFrame:
    """Code-description pairs: id, name, line_number, args, docstring, signature, code.

    Defined cases: null and empty contents and unknown languages give no rows; contents are read whole, of any length,
    with any line ends; what is in comments or literals is no code; an unclosed body reaches to the next function;
    functions without documentation or with a trivial one are dropped; repeated rows give repeated pairs; other columns
    don't matter.
    """
    kind = dict(df.dtypes)[id]
    schema = f"id {kind}, name string, line_number int, args array<string>, docstring string, signature string, code string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (text, *hints) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if (known := language_of(*hints)) is not None:
                    rows += [(i, f.name, f.line, f.args, f.doc, f.signature, f.code) for f in functions(text, known) if says_something(f.doc, f.name)]
            c = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.string())), pa.array(c[4], pa.string()), pa.array(c[5], pa.string()), pa.array(c[6], pa.string())],
                names=["id", "name", "line_number", "args", "docstring", "signature", "code"],
            )

    source = df.select(F.col(id).alias("id"), F.col(content).alias("content"), F.col(language).alias("language"), F.col(extension).alias("extension"), F.col(path).alias("path")).where("content <> ''")
    return spread(source, "id").mapInArrow(run, schema).withColumnRenamed("id", id)
