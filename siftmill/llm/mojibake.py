"""Text read in a wrong character encoding: found and restored by the likeliest encode-decode chain.

A chain takes characters back to bytes by a wrong encoding and reads these in the right one, once or twice. Evidence is
gathered in cores: the stretches of a word around its characters beyond ASCII. Character n-gram models score a core as it
stands and after every chain that applies; the likeliest is accepted if it gains more than a margin. The margin is
validated by both errors: the frequent cores must stay as they are, and every core, damaged and scored by a model of the
other half of the cores, must be restored. All cores take part in that, in the cluster; only sums reach the driver.

The model learns from sound cores only, each distinct text counted once: records with control characters of the second
block or replacement characters are left out, a first model also leaves out all cores whose bytes are UTF-8, and the final
one those that the first would restore.

Every distinct core of the corpus is scored once in the whole cluster; only the changed ones meet their texts again, by a
broadcast of checked size or, beyond it, by a join on the hash of the text.

Counts of n-grams are kept in tables of fixed size (``SLOTS``), summed over all records in Spark, so the model's size
doesn't depend on the corpus. Smoothing weighs as much as a fixed share of all counts: what is rare in the corpus, like the
damage itself, gets no confidence from its own context.
"""

from __future__ import annotations

import codecs
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, spread, stored

# Encodings that texts are wrongly read in, and encodings that they really have.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-2")
REALLY = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "iso8859-2", "iso8859-5", "mac_cyrillic", "cp932", "euc_jp", "gbk")

#: Slots of the tables for three, two and one characters.
SLOTS = (1 << 22, 1 << 19, 1 << 17)
#: Share of all counts that the smoothing of a context weighs.
SMOOTHING = 1e-4
#: Established cores must stay as they are: all with at least this share of all cores.
ESTABLISHED = 2e-4
#: What is done to every core, which a model of the other half of the cores then scores: read as, really, times.
DAMAGES = (("cp1252", "utf-8", 1), ("latin-1", "utf-8", 1), ("cp1251", "utf-8", 1), ("mac_roman", "utf-8", 1), ("cp1252", "utf-8", 2), ("cp1252", "cp1251", 1))
MARGINS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
TRIALS = pa.schema([("established", pa.bool_()), ("reached", pa.int32()), ("n", pa.int64())])
#: Share of the established cores that may change.
ALLOWED = 0.01
KNOWN_CORES = 500_000
#: Changed cores that are broadcast, by their characters; more are joined to the texts.
BROADCAST_CHARACTERS = 20_000_000

#: A core, and a core from its first character beyond ASCII on.
CORE = re.compile(r"[\x21-\x7e]{0,2}[^\x00-\x7f](?:[\x21-\x7e]{0,2}[^\x00-\x7f])*[\x21-\x7e]{0,2}")
BEYOND = re.compile(r"[^\x00-\x7f](?:[\x21-\x7e]{0,2}[^\x00-\x7f])*[\x21-\x7e]{0,2}")
SEQUENCE = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
SEQUENCES = re.compile(SEQUENCE.pattern.encode("latin-1"))
#: One odd space or invisible sign alone, which says nothing about an encoding.
ODD_SPACE = re.compile("[\x00-\x7f]*[\xa0\xad\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff][\x00-\x7f]*")
BROKEN = re.compile("[\x80-\x9f�]")
#: Stands for a character without a byte: a byte that is in no UTF-8.
UNMAPPED = "\xff"


@lru_cache(maxsize=None)
def characters(encoding: str) -> list[str]:
    """What each byte is read as; bytes without a meaning become the control character of their number, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class ToBytes(dict):
    """A translation table from the characters of an encoding to those with the numbers of their bytes."""

    def __init__(self, encoding: str):
        super().__init__((ord(c), b) for b, c in enumerate(characters(encoding)))

    def __missing__(self, c: int) -> int:
        self[c] = ord(UNMAPPED)
        return self[c]


READ = {e: "".join(characters(e)) for e in READ_AS}
TO_BYTES = {e: ToBytes(e) for e in READ_AS}
#: The same for texts that are written in an encoding wholly.
ENCODED = {e: codecs.charmap_build(READ[e]) for e in READ_AS}
FROM_BYTES = {e: "".join(characters(e)) for e in REALLY if e not in ("cp932", "euc_jp", "gbk")}
#: The characters of two bytes with which UTF-8 beyond ASCII begins; where there are none, no part is UTF-8.
BEGINS = {e: re.compile("[{}][{}]".format(*(re.escape(READ[e][a:b]) for a, b in ((0xC2, 0xF5), (0x80, 0xC0))))) for e in READ_AS}
#: All characters beyond ASCII that some encoding is wrongly read as.
READABLE = frozenset(c for e in READ_AS for c in characters(e) if c > "\x7f")


def by_utf8(text: str, raw: str | bytes) -> str | None:
    """``text`` with its parts whose bytes are UTF-8 read as such; the other parts stay. Null if there are none."""
    data = raw.encode("latin-1") if isinstance(raw, str) else raw
    try:
        return None if data.isascii() else data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    for m in SEQUENCES.finditer(data):
        start, stop = m.span()
        out += [text[at:start], m.group().decode("utf-8")]
        at = stop
    return "".join([*out, text[at:]]) if at else None


def chains(text: str, deep: bool = True, room: float = math.inf) -> Iterator[tuple[str, str]]:
    """(restored, chain) for every chain that applies to ``text``; those whose handicap is above ``room`` may be left out."""
    if READABLE.isdisjoint(text):
        return
    seen = {text}
    for wrong in READ_AS:
        begun = BEGINS[wrong].search(text)
        if not begun and room < BY_LETTERS:
            continue
        try:
            raw = codecs.charmap_encode(text, "strict", ENCODED[wrong])[0]
        except UnicodeEncodeError:
            raw = None
        out = by_utf8(text, text.translate(TO_BYTES[wrong]) if raw is None else raw) if begun else None
        if out is not None and out not in seen:
            seen.add(out)
            yield out, f"{wrong}>utf-8"
            if deep and not out.isascii():
                for again, chain in chains(out, False):
                    if again not in seen:
                        seen.add(again)
                        yield again, f"{wrong}>utf-8, {chain}"
        if raw is None or room < BY_LETTERS:
            continue
        for right in REALLY:
            if right == wrong:
                continue
            if right in FROM_BYTES:
                out = codecs.charmap_decode(raw, "strict", FROM_BYTES[right])[0]
            else:
                try:
                    out = raw.decode(right)
                except UnicodeDecodeError:
                    continue
            if out not in seen and not BROKEN.search(out):
                seen.add(out)
                yield out, f"{wrong}>{right}"


def handicap(chain: str) -> float:
    """What a chain must gain first, as so many others were tried: a chain by UTF-8 is one of few, as its bytes must fit."""
    tried = 1
    for step in chain.split(", "):
        tried *= len(READ_AS) * (1 if step.endswith(">utf-8") else len(REALLY))
    return math.log(tried)


HANDICAPS = lru_cache(maxsize=None)(handicap)
BY_LETTERS = math.log(len(READ_AS) * len(REALLY))


def damage(text: str, wrong: str, right: str, times: int = 1) -> str | None:
    """``text`` as it looks when its bytes in ``right`` are read as ``wrong``; null if it can't be written in ``right``."""
    for _ in range(times):
        try:
            text = codecs.charmap_decode(text.encode(right), "strict", READ[wrong])[0]
        except UnicodeEncodeError:
            return None
    return text


@lru_cache(maxsize=1_000_000)
def slot(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * 0x9E3779B1 + ord(c) + 1) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 7


def grams(core: str) -> Iterator[tuple[int, str]]:
    """(length, characters) of all n-grams of a core, with its outer ends marked."""
    padded = f"\x02\x02{core}\x03"
    for i in range(2, len(padded)):
        yield 3, padded[i - 2 : i + 1]
        yield 2, padded[i - 1 : i + 1]
        yield 1, padded[i]


def offset(length: int) -> int:
    return sum(SLOTS[: 3 - length])


class Model:
    """Log-likelihoods of cores from the counts of their n-grams."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        ones = counts[offset(1) :]
        self.total = float(ones.sum())
        self.weight = max(2.0, self.total * SMOOTHING)
        self.one = lru_cache(maxsize=200_000)(self._one)
        self.two = lru_cache(maxsize=200_000)(self._two)
        self.three = lru_cache(maxsize=400_000)(self._three)

    def n(self, gram: str) -> float:
        size = SLOTS[3 - len(gram)]
        return float(self.counts[offset(len(gram)) + slot(gram) % size])

    def _one(self, c: str) -> float:
        return (self.n(c) + 0.05) / (self.total + 5000.0)

    def _two(self, gram: str) -> float:
        return (self.n(gram) + self.weight * self.one(gram[1])) / (self.n(gram[0]) + self.weight)

    def _three(self, gram: str) -> float:
        return math.log((self.n(gram) + self.weight * self.two(gram[1:])) / (self.n(gram[:2]) + self.weight))

    def score(self, core: str, least: float = -math.inf) -> float:
        """Log-likelihood of a core, or something below ``least`` as soon as it can't reach that."""
        padded, three, total = f"\x02\x02{core}\x03", self.three, 0.0
        for i in range(2, len(padded)):
            total += three(padded[i - 2 : i + 1])
            if total < least:
                break
        return total

    def best(self, core: str, margin: float) -> tuple[float, str, str] | None:
        """(gain, restored, chain) of the likeliest chain if it gains at least ``margin`` beyond its handicap."""
        own = self.score(core)
        if own > -margin or ODD_SPACE.fullmatch(core):  # no text is likelier than certain
            return None
        top, least = None, margin
        for out, chain in chains(core, room=-own - margin):
            needed = own + HANDICAPS(chain)
            gain = self.score(out, needed + least) - needed
            if gain >= least and (top is None or gain > top[0]):
                top, least = (gain, out, chain), gain
        return top


def core_spans(text: str) -> Iterator[tuple[int, int]]:
    """Where the cores of a text are: from up to two characters before the first one beyond ASCII."""
    stop = 0
    for m in BEYOND.finditer(text):
        start, low = m.start(), max(stop, m.start() - 2)
        while start > low and "\x21" <= text[start - 1] <= "\x7e":
            start -= 1
        stop = m.end()
        yield start, stop


def cores(text: str) -> Iterator[str]:
    for start, stop in core_spans(text):
        yield text[start:stop]


#: Encodings whose letters often stand where the bytes of UTF-8 do: there a whole core must be such bytes, of characters that occur.
LETTERS_LIKE_UTF8 = ("cp1251", "koi8-r", "cp866")


def doubtful(core: str) -> bool:
    """Whether a core's bytes are UTF-8 in an encoding that it may have been read in: damage, or a rare sound word."""
    if READABLE.isdisjoint(core):
        return False
    for wrong in READ_AS:
        covered = sum(len(m) for m in SEQUENCE.findall(core.translate(TO_BYTES[wrong])))
        if covered and (wrong not in LETTERS_LIKE_UTF8 or covered == sum(c > "\x7f" for c in core)):
            return True
    return False


def _cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, n) of all records; those with broken characters count nothing."""
    seen: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["core", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            one = 0 if BROKEN.search(text) else 1
            for core in cores(text):
                seen[core] = seen.get(core, 0) + one
            if len(seen) > KNOWN_CORES:
                yield rows()
                seen.clear()
    yield rows()


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cores with whether they are ``doubtful``."""
    for batch in batches:
        odd = [doubtful(c) for c in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.bool_())], names=["core", "n", "odd"])


def tally(table: np.ndarray, items: Iterable[tuple[str, int]]) -> np.ndarray:
    """``table`` with the n-grams of (core, n) added."""
    for core, n in items:
        for length, gram in grams(core):
            table[offset(length) + slot(gram) % SLOTS[3 - length]] += n
    return table


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of (core, n, half), sorted by the half, as (half, slot, n), summed per task and half."""

    def rows(half: bool, table: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(table)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["half", "slot", "n"])

    table, of = np.zeros(sum(SLOTS), np.int64), False
    for half, items in _by_half(batches):
        if half != of:
            yield rows(of, table)
            table, of = np.zeros(sum(SLOTS), np.int64), half
        tally(table, items)
    yield rows(of, table)


def _by_half(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, list[tuple[str, int]]]]:
    for batch in batches:
        for half in (False, True):
            own = batch.filter(pa.compute.equal(batch.column(2), half))
            if len(own):
                yield half, list(zip(own.column(0).to_pylist(), own.column(1).to_pylist()))


def trials(model: Model, unseen: Model, items: Iterable[tuple[str, int]], least: float) -> Counter[tuple[bool, int]]:
    """How many established cores are changed (true) and damages restored (false), by the number of ``MARGINS`` that the gains reach, 0 included.

    items: (core, n). Those of at least ``least`` are tried as they are, and all of them in every damage; unseen: a model
    that has none of them.
    """
    found: Counter[tuple[bool, int]] = Counter()

    def reached(top: tuple[float, str, str] | None) -> int:
        return bisect_right(MARGINS, top[0]) if top else 0

    for core, n in items:
        if n >= least:
            found[True, reached(model.best(core, MARGINS[0]))] += 1
        for text, times in Counter(damage(core, *d) for d in DAMAGES).items():
            if text not in (None, core) and CORE.fullmatch(text) and not BROKEN.search(text):
                top = unseen.best(text, MARGINS[0])
                found[False, reached(top) if top and top[1] == core else 0] += times
    return found


def validated_margin(found: Mapping[tuple[bool, int], int]) -> float:
    """The margin of the fewest errors by ``trials``: established cores changed and damage not restored; of equal ones the smallest.

    At most ``ALLOWED`` of the established cores may change; where no margin keeps to that it is the largest.
    """
    established, damaged = (sum(n for (kind, _), n in found.items() if kind == k) for k in (True, False))
    changed = [sum(n for (kind, reached), n in found.items() if kind and reached > i) for i in range(len(MARGINS))]
    missed = [sum(n for (kind, reached), n in found.items() if not kind and reached <= i) for i in range(len(MARGINS))]
    errors = {m: c / max(1, established) + d / max(1, damaged) for m, c, d in zip(MARGINS, changed, missed) if c <= ALLOWED * established}
    return min(errors, key=lambda m: (errors[m], m), default=MARGINS[-1])


def learned(table: DataFrame) -> tuple[np.ndarray, float]:
    """Counts of n-grams over a table of (core, n), and the margin validated on all of its cores, each half by the other."""
    halves = table.select("core", "n", (F.pmod(F.xxhash64("core"), F.lit(2)) == 1).alias("half"))
    halves = spread(halves, "core").sortWithinPartitions("half")
    summed = halves.mapInArrow(_count, "half boolean, slot int, n long").groupBy("half", "slot").agg(F.sum("n").alias("n")).toArrow()
    half, slots, n = (summed[c].to_numpy() for c in ("half", "slot", "n"))
    counts = [np.zeros(sum(SLOTS), np.int64) for _ in range(2)]
    for k in range(2):
        counts[k][slots[half == k]] = n[half == k]
    whole = counts[0] + counts[1]
    # every core ends once, in the mark of its end
    least = ESTABLISHED * Model(whole).n("\x03")
    shared = table.sparkSession.sparkContext.broadcast(tuple(map(packed, counts)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[bool, int]] = Counter()
        for half, items in _by_half(batches):
            found += trials(_model(*shared.value), _model(shared.value[not half]), items, least)
        yield pa.RecordBatch.from_pylist([{"established": kind, "reached": reached, "n": n} for (kind, reached), n in found.items()], TRIALS)

    sums = halves.mapInArrow(run, "established boolean, reached int, n long").groupBy("established", "reached").agg(F.sum("n").alias("n"))
    margin = validated_margin({(r["established"], r["reached"]): r["n"] for r in sums.collect()})
    shared.destroy()
    return whole, margin


def packed(counts: np.ndarray) -> bytes:
    # enough digits for shares, half the size; most slots are empty
    return zlib.compress(counts.astype(np.float32).tobytes(), 1)


def shared_model(spark: SparkSession, counts: np.ndarray, margin: float):
    return spark.sparkContext.broadcast((packed(counts), margin))


def corpus_cores(texts: DataFrame, text: str) -> DataFrame:
    """(core, n, odd) of all distinct texts, stored: n of those without broken characters, odd if ``doubtful``."""
    shared_dir(texts.sparkSession)
    source = texts.select(F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]")).distinct()
    seen = source.mapInArrow(_cores, "core string, n long").groupBy("core").agg(F.sum("n").alias("n"))
    return stored(seen.mapInArrow(_marked, "core string, n long, odd boolean"), "mojibake-cores")


def train(table: DataFrame) -> tuple[np.ndarray, float]:
    """Counts of the model over the sound ones of ``corpus_cores``, and the validated margin."""
    counts, margin = learned(table.where("n > 0 and not odd"))
    first = shared_model(table.sparkSession, counts, margin)

    def damaged(model: Model, core: str, limit: float) -> bool:
        top = model.best(core, limit)
        return top is not None and (not top[2].startswith(LETTERS_LIKE_UTF8) or all(model.n(c) > 0 for c in top[1]))

    def sound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, limit = first.value
        model = _model(data)
        for batch in batches:
            yield batch.filter(pa.array([not damaged(model, c, limit) for c in batch.column(0).to_pylist()], pa.bool_()))

    return learned(stored(spread(table.where("n > 0").select("core", "n"), "core").mapInArrow(sound, "core string, n long"), "mojibake-sound"))


def changed_cores(table: DataFrame, counts: np.ndarray, margin: float) -> DataFrame:
    """(core, gain, restored, chain) of the cores that a chain makes likelier by the margin, each scored once."""
    shared = shared_model(table.sparkSession, counts, margin)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, limit = shared.value
        model = _model(data)
        for batch in batches:
            rows = [(c, *top) for c in batch.column(0).to_pylist() if (top := model.best(c, limit)) is not None]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["core", "gain", "restored", "chain"])

    return stored(spread(table.select("core"), "core").mapInArrow(run, "core string, gain double, restored string, chain string"), "mojibake-changed")


def repair_text(text: str, known: Mapping[str, tuple[float, str, str]]) -> tuple[str, list[str], float, bool] | None:
    """(restored, chains, gain, whole) of a damaged text, or null for a sound one. whole: nothing broken is left.

    known: (gain, restored, chain) of the changed cores.
    """
    used: Counter[str] = Counter()
    parts, at, gain = [], 0, 0.0
    for start, stop in core_spans(text):
        if (top := known.get(text[start:stop])) is not None:
            gain += top[0]
            used[top[2]] += 1
            parts += [text[at:start], top[1]]
            at = stop
    if not used and not BROKEN.search(text):
        return None
    out = "".join([*parts, text[at:]]) if used else text
    return out, [c for c, _ in used.most_common()], gain, not BROKEN.search(out)


@lru_cache(maxsize=3)
def _model(*counts: bytes) -> Model:
    """The model of the sum of ``packed`` counts."""
    return Model(sum(np.frombuffer(zlib.decompress(c), np.float32) for c in counts))


def _repaired(known_of: Callable[[dict], Mapping[str, tuple[float, str, str]]]):
    """A step over (id, t, …) that yields the damaged rows; ``known_of`` gives the changed cores of a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, extra = [], [c.to_pylist() for c in batch.columns[2:]]
            for i, t in enumerate(batch.column(1).to_pylist()):
                if (found := repair_text(t, known_of(extra[0][i] if extra else None))) is not None:
                    rows.append((i, *found))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.bool_())],
                names=["id", "restored", "chains", "gain", "whole"],
            )

    return run


def _cores_by_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, core): the distinct cores of each text."""
    for batch in batches:
        rows = [(h, c) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in dict.fromkeys(cores(t))]
        columns = list(zip(*rows)) if rows else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string())], names=["same", "core"])


def repair(df: DataFrame, id: str, text: str, broadcast_characters: int = BROADCAST_CHARACTERS) -> DataFrame:
    """The damaged records: id, ``restored`` text, ``chains`` (array, the most used first), ``gain`` in log-likelihood and ``whole``.

    ``whole`` is false where something broken is left; what could be had again is restored anyway. Defined cases: null,
    empty and ASCII texts are sound; decomposed letters, rare scripts, drawings and symbols are sound unless a chain turns
    them into something likelier by the margin; replacement characters and control characters 80 to 9F are always damage;
    repeated rows come out repeatedly; an empty table gives no rows and trains an empty model; other columns don't matter.
    """
    spark = df.sparkSession
    table = corpus_cores(df, text)
    changed = changed_cores(table, *train(table))
    kind = dict(df.dtypes)[id]
    schema = f"id {kind}, restored string, chains array<string>, gain double, whole boolean"
    source = df.select(F.col(id).alias("id"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    size = changed.agg(F.sum(F.length("core") + F.length("restored") + 100)).first()[0] or 0
    if size <= broadcast_characters:
        shared = spark.sparkContext.broadcast({r["core"]: (r["gain"], r["restored"], r["chain"]) for r in changed.collect()})
        return spread(source, "id").mapInArrow(_repaired(lambda _: shared.value), schema).withColumnRenamed("id", id)
    source = source.withColumn("same", F.sha2("t", 256))
    pairs = source.select("same", "t").dropDuplicates(["same"]).mapInArrow(_cores_by_text, "same string, core string")
    own = pairs.join(changed, "core").groupBy("same").agg(F.collect_list(F.struct("core", "gain", "restored", "chain")).alias("changes"))
    joined = source.join(own, "same", "left").select("id", "t", "changes")
    by_row = _repaired(lambda changes: {c["core"]: (c["gain"], c["restored"], c["chain"]) for c in changes or ()})
    return joined.mapInArrow(by_row, schema).withColumnRenamed("id", id)
