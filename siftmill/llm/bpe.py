"""Byte-pair encoding by prefix dynamic programming, and the encoding of a whole corpus.

The encoding of a byte string is determined by its prefixes: each prefix has exactly one token that may end its encoding.
``PrefixEncoder`` stores that last token for every prefix. The token at position i is the one token t that ends there
and may follow the last token of the prefix before it; two tokens may be neighbours if no merge of a lower rank crosses
their border, which is read off the merges that build them. The table can be read back from its end, grows by
appending without any work on what is there, and after an edit is rebuilt from the edited byte only, until it has come
back to the same state.

Time is linear in the text: unlike a merge queue there is no rescanning, so a word of a megabyte costs its bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Words kept per Python worker: the table of a worker is emptied when it holds that many.
CACHED_WORDS = 400_000
#: Longer words aren't kept.
CACHED_LENGTH = 64
#: Rows encoded before their ids are packed into a batch.
ROWS_AT_ONCE = 1000


class Vocabulary:
    """Token bytes by rank, with what decides whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        tokens = {r: b for b, r in ranks.items()}
        self.tokens = tokens
        #: bytes that end some token: the search backwards from a position stops where there is none
        self.tails = {b[i:] for b in ranks for i in range(1, len(b))} | set(ranks)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank in sorted(tokens):
            piece = tokens[rank]
            if len(piece) > 1:
                two = self._merged_below(piece, rank)
                if len(two) == 2:
                    self.parts[rank] = (two[0], two[1])
                    self.pairs[two[0], two[1]] = rank
            if rank not in self.parts:
                self.parts[rank] = (rank, rank)

    def _merged_below(self, piece: bytes, limit: int) -> list[int]:
        """The tokens of ``piece`` using merges below ``limit`` only; two of them are the parts of the token of that rank."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 2:
            at, best = -1, limit
            for i in range(len(ids) - 1):
                rank = self.pairs.get((ids[i], ids[i + 1]), limit)
                if rank < best:
                    at, best = i, rank
            if at < 0:
                break
            ids[at : at + 2] = [best]
        return ids

    def neighbours(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is how their joined bytes are encoded at that border."""
        pairs, parts = self.pairs, self.parts
        limit = 1 << 62  # merges of this rank and above come too late to cross the border
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            # undo the later of the two merges; its outer part can't be reached from the border any more
            if left > right:
                inner = parts[left][1]
                if inner != left:
                    limit, left = left, inner
                    continue
                left_done = True
            else:
                left_done = False
            inner = parts[right][0]
            if inner != right:
                limit, right = right + 1, inner
                continue
            if left_done:
                return True
            inner = parts[left][1]
            if inner == left:
                return True
            limit, left = left, inner


@lru_cache(maxsize=4)
def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary that a file holds, with a base64 token and its rank on each line."""
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())})


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PrefixEncoder:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab = vocab
        self.data = bytearray()
        #: at i: the last token of the first i + 1 bytes
        self.last: list[int] = []
        self.append(data)

    def _token_at(self, data: bytes, end: int) -> int:
        ranks, tails, last, neighbours = self.vocab.ranks, self.vocab.tails, self.last, self.vocab.neighbours
        found = []
        for start in range(end - 1, max(-1, end - 1 - self.vocab.longest), -1):
            piece = data[start:end]
            if piece not in tails:
                break
            if piece in ranks:
                found.append((start, ranks[piece]))
        for start, token in reversed(found):
            if start == 0 or neighbours(last[start - 1], token):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def append(self, data: bytes) -> None:
        """Add bytes at the end: what is there keeps its tokens by prefix."""
        begin = len(self.data)
        self.data += data
        whole = bytes(self.data) if len(self.data) < 4096 else memoryview(self.data)
        for end in range(begin + 1, len(self.data) + 1):
            if isinstance(whole, bytes):
                self.last.append(self._token_at(whole, end))
            else:  # a window suffices, so that slices stay short
                low = max(0, end - self.vocab.longest)
                self.last.append(self._token_in_window(bytes(whole[low:end]), low, end))
        if isinstance(whole, memoryview):
            whole.release()

    def _token_in_window(self, window: bytes, low: int, end: int) -> int:
        ranks, tails, last, neighbours = self.vocab.ranks, self.vocab.tails, self.last, self.vocab.neighbours
        found = []
        for start in range(end - 1, low - 1, -1):
            piece = window[start - low :]
            if piece not in tails:
                break
            if piece in ranks:
                found.append((start, ranks[piece]))
        for start, token in reversed(found):
            if start == 0 or neighbours(last[start - 1], token):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Replace the bytes from ``start`` to ``end``; returns how many prefixes had to be worked out anew.

        Behind the edit the old last tokens are taken over as soon as as many of them in a row agree with the new ones
        as a token is long: from there on the table depends on nothing that has changed.
        """
        old_tail, old_last = bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(data)
        agree, done = 0, 0
        step = 64
        while done < len(old_tail) and agree < self.vocab.longest:
            piece = old_tail[done : done + step]
            self.append(piece)
            new = self.last[-len(piece) :]
            for i, token in enumerate(new):
                agree = agree + 1 if token == old_last[done + i] else 0
            done += len(piece)
        self.data += old_tail[done:]
        self.last += old_last[done:]
        return len(data) + done

    def ids(self) -> list[int]:
        """The encoding, read backwards from the end."""
        out, at, tokens = [], len(self.last), self.vocab.tokens
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out


class TextEncoder:
    """Texts to ids: a text is split into words by ``pattern``, each word is encoded by its prefix table."""

    def __init__(self, data: bytes, pattern: str):
        self.vocab = vocabulary(data)
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = tuple(PrefixEncoder(self.vocab, word.encode("utf-8", "replace")).ids())
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty or null text has none."""
        if not text:
            return []
        return list(chain.from_iterable(self._pieces(text)))

    def _pieces(self, text: str) -> list[tuple[int, ...]]:
        words, known = self.words(text), self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            own = self._word
            get = known.get
            return [get(w) or own(w) for w in words]

    def count(self, text: str | None) -> int:
        return sum(map(len, self._pieces(text))) if text else 0


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and word pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> TextEncoder:
    return TextEncoder(data, pattern)


def _batches(shared, pattern: str, count_only: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            texts = batch.column(0).to_pylist()
            rest, names = batch.columns[1:], batch.schema.names[1:]
            if count_only:
                sizes = np.fromiter((encoder.count(t) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes)], names=[*names, "n_tokens"])
                continue
            ids = [encoder.encode(t) for t in texts]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*names, "ids"])

    return run


def encode_corpus(df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` without ``text``, with the ids of its text as ``ids`` (array of int). ``path`` is a file that the driver can read.

    Defined cases: empty and null texts give an empty list; text that looks like a special token is ordinary text;
    lone surrogates can't occur in Spark's strings; a column called ``ids`` in the input is replaced; rows are neither
    dropped nor merged, repeated rows come out repeatedly; an empty table gives no rows.
    """
    return _mapped(df, text, path, pattern, ids, False)


def count_tokens(df: DataFrame, text: str, path: str, pattern: str, n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the number of its tokens as ``n_tokens`` (long); empty and null texts have 0."""
    return _mapped(df, text, path, pattern, n_tokens, True)


def _mapped(df: DataFrame, text: str, path: str, pattern: str, out: str, count_only: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in (text, out)]
    # positional names inside the Python step, so that no column name can clash
    inner = df.select(F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    kind = T.LongType() if count_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*inner.schema.fields[1:], T.StructField("n_tokens" if count_only else "ids", kind)])
    # the driver reads the vocabulary, a file of bounded size; executors needn't have it
    shared = df.sparkSession.sparkContext.broadcast(file_bytes(path))
    done = spread(inner, "c0" if rest else "t").mapInArrow(_batches(shared, pattern, count_only), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col(schema.fields[-1].name).alias(out))
