"""Credentials in source code and configuration: found line by line and redacted in place.

A literal is segmented by Viterbi into words of a dictionary and unexplained characters. The dictionary is what the
corpus itself says: the words of all texts by the number of distinct texts they occur in, the ``DICTIONARY`` most frequent. Long
unexplained residuals become secrets; how long they must be depends on the context (``NEEDED``). Under the name of a
password, which people make up of words, little suffices; under that of a token or secret, which machines make, a part of
the value must be unexplained; where a name only speaks of a credential, or without a name, a long residual of mixed
characters is needed. The same holds in known formats, in addresses and behind the first line of a private key: they are
contexts, the residual decides. Known formats of digests, identifiers, public keys and embedded data are excluded, as are
placeholders and references to variables, files and stores.

A text is scanned in a time that grows with its length, whatever the length of its lines.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, spread

#: Words that the dictionary may have; texts, and share of all texts, in which a word must occur.
DICTIONARY, LEAST_TEXTS, LEAST_SHARE = 100_000, 3, 5e-5
LONGEST_WORD = 24
#: Unexplained characters that make a secret, by context.
NEEDED = {"password": 1, "secret": 6, "address": 1, "format": 8, "key": 16, "maybe": 14, "about": 14, "": 16}
#: The same for values of letters alone under the name of a password or in an address, and the least length of a value, there and elsewhere.
LETTERS_NEEDED, SHORTEST_PASSWORD, SHORTEST = 6, 4, 6
#: Longest value whose residual is kept.
KEPT_LENGTH = 200
MASK = "[REDACTED]"

# Names of credentials, by the parts of an identifier; marks of names that hold none; placeholders.
PASSWORDS = {"password", "passwd", "passwort", "passphrase", "pwd", "pass", "passcode", "pgpassword", "dbpass", "dbpassword", "dbpasswd", "userpass"}
SECRETS = {"secret", "secrets", "token", "apikey", "authtoken", "accesskey", "secretkey", "accountkey", "apitoken", "credential", "credentials"}
KEY_KINDS = {"api", "access", "secret", "private", "account", "auth", "signing", "encryption", "master", "shared", "license", "service", "client", "storage", "admin", "app"}
MAYBE = {"key", "auth", "authorization", "sig", "signature", "cookie", "pin", "bearer"}
QUALIFIERS = {"value", "prod", "production", "dev", "test", "staging", "live", "old", "new", "default", "b64", "base64", "plain", "raw", "str", "string", "base", "main", "backup", "primary", "secondary", "id"}
NOT_HELD = {"name", "names", "ref", "file", "path", "dir", "length", "len", "min", "max", "size", "count", "url", "uri", "type", "field", "label", "policy", "expiry", "expires", "ttl", "prefix", "suffix", "pattern", "regex", "hash", "digest", "checksum", "sha", "sha1", "sha256", "sha512", "md5", "etag", "integrity", "commit", "uuid", "fingerprint", "public", "pub", "cert", "certificate", "tokens", "limit", "env", "var", "store", "required", "version", "rotation", "age", "hint"}
DIGEST_NAMES = re.compile(r"(?i)(sha-?\d*|md5|etag|integrity|commit|revision|checksum|digest|hash|fingerprint|uuid|guid|request.?id|trace.?id|session.?id|build.?id|logo|image|icon|public.?key|nonce|version)$")
#: Characters that the longest of these names may have.
LONGEST_NAME = 32
PLACEHOLDER = re.compile(r"(?i)change.?me|your[_\-. ]|[_\-. ]here\b|example|placeholder|dummy|sample|redacted|replace.?me|insert|todo|fixme|\bnone\b|\bnull\b|\btrue\b|\bfalse\b|\bundefined\b|not.?set|<[^>]*>|\$\{|\{\{|%\(|\$\(|^\$|^%\w+%$|^@|(.)\1{5,}|^[*.xX#\-_?]+$")
REFERENCE = re.compile(r"(?i)^[\w.]*(getenv|environ|env\.|process\.env|getpass|vault|secrets?\.|config\.|settings\.|os\.)|^(file:|env:|vault:|arn:|ssm:)")
PATH = re.compile(r"(?i)^(/|\./|\.\./|~/|[a-z]:\\)")
TOKEN_FORMATS = re.compile(r"(?<![A-Za-z0-9])(?:(?:sk|rk|pk)[-_](?:ant-|live_|test_|proj-)?[A-Za-z0-9_\-]{16,}|xai-[A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|(?:AKIA|ASIA)[A-Z0-9]{12,20}(?![A-Za-z0-9])|AIza[A-Za-z0-9_\-]{20,}|r[0-9]_[A-Za-z0-9]{20,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|glpat-[A-Za-z0-9_\-]{16,}|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{20,}|SG\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})")

#: What a lower-case line has if any rule below may find something in it: names, commands, first letters of formats, the shortest bare run.
TRIGGER = re.compile(
    r"pass|pwd|secret|token|key|auth|cred|bearer|basic\s|log[io]n|sign_?in|(?:sig|signature|cookie|pin)(?![a-z0-9])|-----begin|connect|[a-z0-9+/_\-]{19,}|curl|wget|\s-u|\s--user|mysql|psql|mongo|redis|:(?:\d{2,5}|\*):"
    r"|xox[abeoprs]-|(?:akia|asia)[a-z0-9]{12}|sg\.[a-z0-9_\-]{10}|eyj[a-z0-9_\-]{8}"
)
QUOTED = r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.)*'''|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`"
ASSIGNED = re.compile(
    r"(?<!\w)(?<!\w[.\-])(?P<key>[A-Za-z_][\w.\-]*)(?:[\"'`]?\]?)\s*(?::\s*[A-Za-z_][\w.<>\[\], ]*?\s*=(?!=)|:=|=>|(?<![=!<>])=(?![=~])|:(?!:|//))\s*(?:[\w.\[\]'\"()]+?\s*(?:\|\||\?\?|\bor\b)\s*)?(?:[rbfuRBFU]{1,2}(?=[\"']))?"
    rf"(?P<value>{QUOTED}|<!\[CDATA\[.*?\]\]>|[^\s,;'\"`<>(){{}}\[\]]+)"
)
PAIRED = re.compile(rf"[\"'](?P<key>[A-Za-z_][\w.\-]*)[\"']\s*,\s*(?P<value>{QUOTED})|(?:key|name)\s*=\s*[\"'](?P<key2>[A-Za-z_][\w.\-]*)[\"']\s+value\s*=\s*(?P<value2>\"[^\"]*\"|'[^']*')|<(?P<key3>[A-Za-z_][\w.\-]*)>(?P<value3><!\[CDATA\[.*?\]\]>|[^<]+)</|\b(?:set|with|use|add)_?(?P<key4>[A-Z]?\w*)\(\s*(?P<value4>{QUOTED})\s*\)")
SCHEME = re.compile(r"(?i)\b(?:bearer|basic|token)\s+(?P<value>[A-Za-z0-9+/_\-.=~]{8,})")
USERINFO = re.compile(r"(?<=[A-Za-z0-9])://[^\s:/@\"'<>]*:(?P<value>[^\s@\"'<>]+)@")
FLAG = re.compile(rf"(?<![\w\-])(?:--?(?P<key>[A-Za-z][\w\-]*)\s+(?P<value>{QUOTED}|[^\s\"'`\-][^\s\"'`]*)|sshpass\s+-p\s*(?P<value2>{QUOTED}|\S+))")
#: Options that give a password, and the commands before them.
USER_OPTION = re.compile(r"(?<=\s)(?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<value>[^\s\"']+)")
FETCHES = re.compile(r"\b(?:curl|wget|http)\b")
STORE_OPTION = re.compile(rf"(?<=\s)(?:-p|-a\s)(?P<value>{QUOTED}|[^\s\"'\-]\S*)")
STORES = re.compile(r"\b(?:mysql\w*|psql|mongo\w*|redis-cli)\b")
STATED = re.compile(rf"(?i)\b(?P<key>passwor[dt]|passphrase|pass|token|secret|api key|access key|key)\s+(?:(?:is|was|ist)\s+|for\s+[\w.\-]+\s*(?:is\s+|:\s*))(?P<value>{QUOTED}|[^\s,;'\"`<>()]+)")
NETRC = re.compile(r"(?i)\blogin\s+\S+\s+password\s+(?P<value>\S+)|^\s*[\w.\-*]+:(?:\d{2,5}|\*):[\w.\-*]+:[\w.\-]+:(?P<value2>[^\s:]+)\s*$")
CALL = re.compile(rf"(?i)\b\w*(?:auth\w*|login|logon|sign_?in|credentials?|connect|userpass\w*)\s*\(\s*(?:{QUOTED})\s*,\s*(?P<value>{QUOTED})")
WEAK = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_\-]{18,}={0,2}")
OPENED = re.compile(r"(?<!\w)(?<!\w[.\-])(?P<key>[A-Za-z_][\w.\-]*)[\"'`]?\]?\s*(?::\s*\w+\s*)?(?:=|:|=>|:=)\s*(?:\(|\\|\||\||>|[|>][+\-]?|\[)?\s*$")
PIECE = re.compile(rf"^\s*\+?\s*[rbfuRBFU]?(?P<value>{QUOTED}|[^\s\"'`(){{}}\[\],;]+)\s*[+\\]?\s*[),;\]]*\s*$")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ARMOR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
ARMOR_END = re.compile(r"-----END [A-Z0-9 ]+-----")
BODY = re.compile(r"^\s*[A-Za-z0-9+/]{16,}={0,2}\s*$")
KNOWN_DATA = re.compile(r"(?:sha(?:1|224|256|384|512)-|data:[\w/+.\-]+;base64,|ssh-(?:rsa|dss|ed25519)\s+|ecdsa-sha2-\S+\s+|sk-ssh-\S+\s+)[A-Za-z0-9+/=]+")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass(frozen=True)
class Found:
    line: int
    start: int
    end: int
    kind: str


class Lexicon:
    """Viterbi segmentation into dictionary words and unexplained characters."""

    def __init__(self, words: dict[str, int]):
        total = sum(words.values()) + 1.0
        self.cost = {w: -math.log(n / total) for w, n in words.items() if 3 <= len(w) <= LONGEST_WORD}
        self._kept = lru_cache(maxsize=200_000)(self._residual)

    def residual(self, text: str) -> int:
        return self._kept(text) if len(text) <= KEPT_LENGTH else self._residual(text)

    def _residual(self, text: str) -> int:
        """Unexplained letters and digits of the likeliest segmentation; one unexplained character costs log 40."""
        low, n, cost, per = text.lower(), len(text), self.cost, math.log(40.0)
        best, left = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            here, unexplained = best[i], left[i]
            c = low[i]
            step = here + (per if c.isalnum() else 0.5)
            if step < best[i + 1]:
                best[i + 1], left[i + 1] = step, unexplained + c.isalnum()
            if c.isalpha():
                for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                    word = low[i:j]
                    if (w := cost.get(word)) is not None and here + w < best[j]:
                        best[j], left[j] = here + w, unexplained
                    if not low[j - 1].isalpha():
                        break
        return left[n]


@lru_cache(maxsize=100_000)
def named(key: str) -> str:
    """The context that a name makes: 'password', 'secret', 'about' (it speaks of a credential), 'maybe' or ''."""
    parts = [p.lower() for p in PARTS.findall(key)]
    if not parts or parts[0] in {"max", "min", "num", "public"}:
        return ""
    if parts[-1] == "id" and len(parts) > 2 and parts[-2] == "key" and parts[-3] in KEY_KINDS:
        return "secret"
    if parts[-1] in NOT_HELD or any(p in {"sha256", "md5", "sha1", "hash"} for p in parts):
        return ""
    while len(parts) > 1 and (parts[-1] in QUALIFIERS or parts[-1].isdigit()):
        parts.pop()
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in PASSWORDS or before + last in PASSWORDS or len(last) > 6 and last.endswith(("password", "passwd")):
        return "password"
    if last in SECRETS or before + last in SECRETS or len(last) > 6 and last.endswith(("secret", "token", "apikey")) or last == "key" and before in KEY_KINDS:
        return "secret"
    if last in MAYBE:
        return "maybe"
    return "about" if any(p in PASSWORDS or p in SECRETS for p in parts[-3:]) else ""


def mixed_kinds(value: str) -> int:
    return any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value)


def basic_pair(value: str) -> bool:
    """Whether a value is the base64 of user:password."""
    try:
        text = base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return False
    return b":" in text and all(32 <= b < 127 for b in text)


def credential(value: str, context: str, quoted: bool, lexicon: Lexicon) -> bool:
    """Whether the residual of a literal is long enough for its context, and it is neither a placeholder nor a reference."""
    v = value.strip()
    password = context == "password"
    if len(v) < (SHORTEST_PASSWORD if password and quoted else SHORTEST) or PLACEHOLDER.search(v) or REFERENCE.search(v) or UUID.match(v):
        return False
    letters, digits = any(c.isalpha() for c in v), any(c.isdigit() for c in v)
    if any(c.isspace() for c in v) and not (password and quoted and digits):
        return False
    residual = lexicon.residual(v)
    if residual < NEEDED[context] or PATH.match(v) and residual < NEEDED[""]:
        return False
    if password or context == "secret":
        if not quoted and re.match(r"^[A-Za-z_][\w.]*[.(\[]", v) and not digits:
            return False
        # letters alone may be a rare word
        return digits or residual >= LETTERS_NEEDED and (mixed_kinds(v) >= 2 or password and quoted)
    if context == "maybe":
        return digits and letters and not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v)
    return mixed_kinds(v) >= 2 and digits and not re.fullmatch(r"[0-9a-fA-F\-]+", v)


def bare(value: str) -> tuple[str, int, bool]:
    """A matched value without its quotes: text, offset of the text, whether it was quoted."""
    for q in ('"""', "'''", '"', "'", "`"):
        if value.startswith(q) and value.endswith(q) and len(value) >= 2 * len(q):
            return value[len(q) : -len(q)], len(q), True
    if value.startswith("<![CDATA["):
        return value[9:-3], 9, True
    return value, 0, False


class Line:
    """What the rules ask of a line more than once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def blanks(self) -> list[int]:
        return [m.start() for m in re.finditer(r"\s", self.text)]

    @cached_property
    def schemes(self) -> list[int]:
        return [m.start() for m in re.finditer("://", self.text)]

    @cached_property
    def known(self) -> list[tuple[int, int]]:
        return [m.span() for m in KNOWN_DATA.finditer(self.text)]

    def in_address(self, at: int) -> bool:
        """Whether what stands at ``at`` goes on an address."""
        i = bisect_left(self.schemes, at - 2)
        if not i:
            return False
        j = bisect_left(self.blanks, at)
        return not j or self.blanks[j - 1] < self.schemes[i - 1]

    def is_known(self, start: int, end: int) -> bool:
        i = bisect_left(self.known, (end, 0))
        return i > 0 and self.known[i - 1][1] > start

    def names_digest(self, at: int) -> bool:
        """Whether the word before ``at`` names a digest or an identifier."""
        while at > 0 and not (self.text[at - 1].isalnum() or self.text[at - 1] == "_"):
            at -= 1
        return DIGEST_NAMES.search(self.text[max(0, at - LONGEST_NAME) : at]) is not None


def key_residual(line: str, start: int, following: Iterator[str], lexicon: Lexicon) -> int:
    """Unexplained characters of the body of a private key whose first line ends at ``start``; a body that is cut off counts as long."""
    rest = re.sub(r"\\[nr]", " ", line[start:])
    for part in chain([rest.strip("\"'` \t\r,;+\\")], following):
        if part is None:
            return NEEDED["key"]
        if ARMOR_END.match(part.strip()) or ":" in part and not BODY.match(part):
            if ARMOR_END.match(part.strip()):
                return 0
            continue
        if (residual := lexicon.residual(part.strip()[:KEPT_LENGTH])) >= NEEDED["key"]:
            return residual
        if part.strip() and part is not rest:
            return residual
    return NEEDED["key"]


def scan(text: str, lexicon: Lexicon) -> list[Found]:
    """All credentials of a text; lines count from 1, start and end are positions in the text."""
    out: list[Found] = []
    at, armor, opened, running = 0, None, "", False
    lines = text.split("\n")
    for number, line in enumerate(lines, 1):
        begin, at = at, at + len(line) + 1
        if armor is not None:  # inside a key or certificate
            if (end := ARMOR_END.search(line)) or not (BODY.match(line) or ":" in line or not line.strip()):
                if armor:
                    last = begin + (end.end() if end else 0)
                    out[-1] = Found(out[-1].line, out[-1].start, last, out[-1].kind)
                armor = None
                if end:
                    continue
            else:
                if armor:
                    out[-1] = Found(out[-1].line, out[-1].start, begin + len(line.rstrip("\r")), out[-1].kind)
                continue
        low = line.lower()
        if not (opened or running or "://" in low and "@" in low or TRIGGER.search(low)):
            continue
        if (m := ARMOR.search(line)) is not None:
            private = PRIVATE.search(line)
            end = ARMOR_END.search(line, m.end())
            if private and key_residual(line, private.end(), islice(chain(lines, [None]), number, None), lexicon) < NEEDED["key"]:
                private = None
            if private:
                stop = end.end() if end else len(line.rstrip("\r"))
                escaped = re.match(r"[^\"'`]*", line[private.start() : stop]) if not end else None
                out.append(Found(number, begin + private.start(), begin + (private.start() + escaped.end() if escaped else stop), "private key"))
            if not end and ("\\n" not in line[m.end() :]):
                armor = bool(private)
            opened, running = "", False
            continue
        if at > len(text):  # the last line may be cut off inside a literal
            line += next((q for q in "\"'`" if line.count(q) % 2), "")
        spans: list[tuple[int, int, str]] = []

        def take(start: int, value: str, context: str, kind: str) -> bool:
            inner, skip, quoted = bare(value)
            if not quoted:
                trimmed = inner.rstrip(".,;:!") if kind == "stated" else inner.rstrip(",;")
                inner = trimmed
            if credential(inner, context, quoted and kind in ("assigned", "paired", "flag"), lexicon):
                spans.append((start + skip, start + skip + len(inner), kind))
                return True
            return False

        piece = PIECE.match(line) if opened or running else None
        if running and piece and bare(piece["value"])[2]:  # goes on what began on a line before
            out[-1] = Found(out[-1].line, out[-1].start, begin + piece.end("value"), out[-1].kind)
            running = not re.search(r"[);,\]]\s*$", line)
            continue
        running = False
        if opened and piece and (take(piece.start("value"), piece["value"], opened, "assigned")):
            running = not re.search(r"[);,\]]\s*$", line)
        if line.strip():
            opened = ""
        if line.rstrip()[-1:] in tuple("=:>(\\|[+-") and (m := OPENED.search(line)) is not None and (context := named(m["key"])):
            opened = context
        for m in TOKEN_FORMATS.finditer(line):
            v = m.group()
            code = v[:4] in ("AKIA", "ASIA") or mixed_kinds(v) >= 2 and any(c.isdigit() or c in "-_" for c in v[4:])
            if code and not PLACEHOLDER.search(v) and lexicon.residual(v) >= NEEDED["format"]:
                spans.append((m.start(), m.end(), "format"))
        if "=" in line or ":" in line:
            position = 0
            while (m := ASSIGNED.search(line, position)) is not None:
                context, value, position = named(m["key"]), m["value"], m.end()
                if not context:
                    if bare(value)[2]:  # settings may be inside the text
                        position = m.start("value") + 1
                    continue
                if context == "maybe" and basic_pair(bare(value)[0]):
                    context = "secret"
                if take(m.start("value"), value, context, "assigned") and re.search(r"[+\\]\s*$", line[position:]):
                    running = True
        for m in PAIRED.finditer(line):
            for k, v in (("key", "value"), ("key2", "value2"), ("key3", "value3"), ("key4", "value4")):
                if m[k] and (context := named(m[k])):
                    take(m.start(v), m[v], context, "paired")
        for m in SCHEME.finditer(line):
            v = m["value"]
            if (pair := basic_pair(v)) or "uthorization" in line:
                take(m.start("value"), v, "secret" if pair or "uthorization" in line else "maybe", "header")
        for m in USERINFO.finditer(line):
            v = m["value"]
            residual = lexicon.residual(v)
            if not PLACEHOLDER.search(v) and len(v) >= SHORTEST_PASSWORD and residual >= (NEEDED["address"] if any(c.isdigit() for c in v) else SHORTEST_PASSWORD):
                spans.append((m.start("value"), m.end("value"), "address"))
        if "-" in line:
            for m in FLAG.finditer(line):
                if m["value2"]:
                    take(m.start("value2"), m["value2"], "password", "flag")
                elif (context := named(m["key"])) in ("password", "secret"):
                    take(m.start("value"), m["value"], context, "flag")
            for command, option in ((FETCHES, USER_OPTION), (STORES, STORE_OPTION)):
                if (first := command.search(line)) is not None:
                    for m in option.finditer(line, first.end()):
                        take(m.start("value"), m["value"], "password", "flag")
        for m in STATED.finditer(line):
            take(m.start("value"), m["value"], "password" if m["key"].lower().startswith("pass") else "secret", "stated")
        for m in NETRC.finditer(line):
            group = "value" if m["value"] else "value2"
            take(m.start(group), m[group], "password", "netrc")
        for m in CALL.finditer(line):
            take(m.start("value"), m["value"], "password", "call")
        if not BODY.match(line):
            facts = Line(line)
            for m in WEAK.finditer(line):
                v = m.group()
                if facts.is_known(*m.span()) or facts.names_digest(m.start()) or not (credential(v, "", False, lexicon) and longest_mixed(v, lexicon)):
                    continue
                # of an address only its last part gives access
                start = m.start() + v.rindex("/") + 1 if "/" in v and facts.in_address(m.start()) else m.start()
                if m.end() - start >= NEEDED[""]:
                    spans.append((start, m.end(), "residual"))
        stop = -1
        for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            if start >= stop:
                out.append(Found(number, begin + start, begin + end, kind))
                stop = end
            elif end > stop and out:
                out[-1] = Found(out[-1].line, out[-1].start, begin + end, out[-1].kind)
                stop = end
    return out


def longest_mixed(value: str, lexicon: Lexicon) -> bool:
    """Whether some part between separators, or the whole, is a long residual: paths and names of words and numbers are not."""
    return any(len(p) >= NEEDED[""] and mixed_kinds(p) >= 2 and lexicon.residual(p) >= NEEDED["about"] and any(c.isdigit() for c in p) for p in re.split(r"[/_\-]", value)) or (mixed_kinds(value) == 3 and lexicon.residual(value) >= 0.8 * len(value) and not re.search(r"[0-9]{2,}[-/][0-9]{2}", value))


def redacted(text: str, found: list[Found]) -> str:
    """The text with each credential replaced by ``MASK``; line ends inside a credential stay, so that line numbers hold."""
    out, at = [], 0
    for f in found:
        hidden = text[f.start : f.end]
        out += [text[at : f.start], MASK, "".join(c for c in hidden if c in "\r\n")]
        at = f.end
    return "".join([*out, text[at:]])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts with it); the word "" counts the texts. Letters next to digits are no words but parts of codes."""
    seen: Counter[str] = Counter()
    runs, parts = re.compile(r"[A-Za-z0-9]+").findall, re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
    known: dict[str, list[str]] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = {""}
            for run in set(runs(text)):
                if run.isalpha():
                    if (own := known.get(run)) is None:
                        own = [p.lower() for p in parts(run) if 3 <= len(p) <= LONGEST_WORD]
                        if len(known) < 200_000:
                            known[run] = own
                    words.update(own)
            seen.update(words)
        if len(seen) > 2_000_000:
            yield _words(seen)
            seen.clear()
    yield _words(seen)


def _words(seen: Counter[str]) -> pa.RecordBatch:
    items = list(seen.items())
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["word", "n"])


def dictionary(df: DataFrame, text: str) -> dict[str, int]:
    """The ``DICTIONARY`` words in most distinct texts, so that copies of a secret are no words; a bounded model, ties by the alphabet."""
    words = df.select(F.col(text).alias("t")).where("t is not null").distinct().mapInArrow(_count, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "word").limit(DICTIONARY + 1)
    found = {r["word"]: r["n"] for r in top.collect()}
    texts = found.pop("", 0)
    return {w: n for w, n in found.items() if n >= LEAST_SHARE * texts}


@lru_cache(maxsize=2)
def _lexicon(words: tuple[tuple[str, int], ...]) -> Lexicon:
    return Lexicon(dict(words))


def find_secrets(df: DataFrame, id: str, text: str) -> DataFrame:
    """One row for each text with credentials: id, ``found`` (array of line_number, kind) and ``redacted`` text.

    Defined cases: null and empty texts have none; a text of any length is scanned whole; lines end at a line feed;
    repeated rows come out repeatedly; an empty table gives no rows; other columns don't matter. Credentials themselves
    are in no column of the result.
    """
    spark = df.sparkSession
    shared_dir(spark)
    words = spark.sparkContext.broadcast(tuple(sorted(dictionary(df, text).items())))
    kind = dict(df.dtypes)[id]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(words.value)
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if found := scan(t, lexicon):
                    rows.append((i, [{"line_number": f.line, "kind": f.kind} for f in found], redacted(t, found)))
            where, found_, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array(found_, pa.list_(pa.struct([("line_number", pa.int32()), ("kind", pa.string())]))), pa.array(texts, pa.string())],
                names=["id", "found", "redacted"],
            )

    source = spread(df.select(F.col(id).alias("id"), F.col(text).alias("t")).where("t <> ''"), "id")
    return source.mapInArrow(run, f"id {kind}, found array<struct<line_number:int,kind:string>>, redacted string").withColumnRenamed("id", id)
