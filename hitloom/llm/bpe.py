"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary answers, for all new pre-tokens of a
batch at once, which of them are a token already.  Tier two: the others are merged with a
heap over linked bytes, in O(n log n) for a pre-token of n bytes.  Both answers are kept in
a memo of bounded size, so a pre-token is looked up about once per worker.

Results: a null or empty text has no ids and decodes to no bytes; very long texts are cut
into pieces at places that no pre-token spans, so memory follows the piece; repeated rows
are encoded alike; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.store import on_workers

PIECE_CHARS = 1_000_000
MEMO_ENTRIES = 250_000

# The letters up to U+02C1.  Texts within _PLAIN are split by the standard library's engine,
# which is twice as fast; over these characters both patterns have the same matches.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ˁ"
_PLAIN_SPLIT = re.compile(
    rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
)
_NOT_PLAIN = re.compile("[^\t-\r -~ -±´-¸º»¿-ˁ]")
_SAFE_CUT = re.compile("(?<=[a-z]) (?=[a-z])")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids (0, 1, 2, ...)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("the ranks of a vocabulary are 0 to n - 1, each once")
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one key per slot."""

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.width = -(-max(map(len, keys)) // 8) * 8
        self.buckets = max(1, self.size // 2)
        rows, lengths = self._rows(keys)
        for seed in range(1, 100):
            if self._place(rows, lengths, seed):
                return
        raise ValueError("no displacement found; are the keys distinct?")

    def _rows(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        padded = b"".join([key.ljust(self.width, b"\0") for key in keys])
        rows = np.frombuffer(padded, dtype=np.uint64).reshape(len(keys), self.width // 8)
        return rows, np.fromiter(map(len, keys), np.int64, len(keys))

    def _hashes(self, rows, lengths, seed):
        with np.errstate(over="ignore"):
            h = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
            for column in rows.T:
                h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            g = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
            g ^= g >> np.uint64(32)
        return h, g | np.uint64(1), (g % np.uint64(self.buckets)).astype(np.int64)

    def _slots(self, start, step, shift):
        with np.errstate(over="ignore"):
            return ((start + shift.astype(np.uint64) * step >> np.uint64(20)) % np.uint64(self.size)).astype(np.int64)

    def _place(self, rows, lengths, seed) -> bool:
        start, step, bucket = self._hashes(rows, lengths, seed)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(bucket.tolist()):
            members[b].append(i)
        starts, steps, n = start.tolist(), step.tolist(), self.size
        slots, shift, busy = [-1] * n, np.zeros(self.buckets, np.int64), bytearray(n)
        members.sort(key=len, reverse=True)
        for own in members:
            if len(own) < 2:
                break
            for d in range(20 * n):
                at = [((starts[i] + d * steps[i] & 0xFFFFFFFFFFFFFFFF) >> 20) % n for i in own]
                if len(set(at)) == len(at) and not any([busy[s] for s in at]):
                    break
            else:
                return False
            for i, s in zip(own, at):
                slots[i], busy[s] = s, 1
            shift[bucket[own[0]]] = d
        free = (s for s in range(n) if not busy[s])
        for own in members:
            if len(own) == 1:  # any free slot will do: its number is stored as it is
                slots[own[0]] = next(free)
                shift[bucket[own[0]]] = -1 - slots[own[0]]
        self.seed, self.shift = seed, shift
        self.keys, self.lengths, self.ids = np.empty_like(rows), np.empty(n, np.int64), np.empty(n, np.int64)
        self.keys[slots], self.lengths[slots], self.ids[slots] = rows, lengths, np.arange(n)
        return True

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The id of each key, -1 for those outside the vocabulary."""
        found = np.full(len(keys), -1, np.int64)
        short = [i for i, key in enumerate(keys) if len(key) <= self.width]
        if short:
            rows, lengths = self._rows([keys[i] for i in short])
            start, step, bucket = self._hashes(rows, lengths, self.seed)
            shift = self.shift[bucket]
            slot = np.where(shift < 0, -1 - shift, self._slots(start, step, shift))
            same = (self.lengths[slot] == lengths) & (self.keys[slot] == rows).all(1)
            found[short] = np.where(same, self.ids[slot], -1)
        return found


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the pair of lowest rank merges first, the leftmost among equals."""
    n, get = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    bits = n.bit_length()  # a heap entry holds rank, start and stop in one number
    low = (1 << bits) - 1
    heap = []
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            heap.append((r << bits | i) << bits | i + 2)
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        stop, i = entry & low, entry >> bits & low
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:
            continue  # one of the two parts has been merged meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r << bits | i) << bits | end[stop])
        if (k := before[i]) >= 0 and (r := get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r << bits | k) << bits | stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(ids)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters; no pre-token spans two of them."""
    at = 0
    while len(text) - at > size and (cut := _SAFE_CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Codec:
    """Encoder and decoder of one vocabulary; ``pattern`` splits a text into pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.tokens, self.table = tokens, table or PerfectHash(tokens)
        self.ranks = {token: i for i, token in enumerate(tokens)}
        self.names = [str(i) for i in range(len(tokens))]
        self.pattern = regex.compile(pattern)
        # The quick pattern and the cuts stand for this one pattern; by another, texts stay whole.
        self.quick = pattern == public_tokenizers.PATTERN
        self.memo: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        plain = self.quick and not _NOT_PLAIN.search(text)
        return (_PLAIN_SPLIT if plain else self.pattern).findall(text)

    def learn(self, new: list[str]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        raw = [word.encode() for word in new]
        for word, key, i in zip(new, raw, self.table.lookup(raw).tolist()):
            self.memo[word] = (i,) if i >= 0 else merge_bytes(key, self.ranks)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids of its next piece); texts without characters give nothing.

        Pieces are taken in blocks of about ``PIECE_CHARS``, so the perfect hash answers many
        new pre-tokens at once and memory stays bounded.
        """
        block, chars = [], 0
        for number, text in enumerate(texts):
            for piece in (pieces(text) if self.quick else (text,)) if text else ():
                block.append((number, self.split(piece)))
                chars += len(piece)
                if chars >= PIECE_CHARS:
                    yield from self._ids(block)
                    block, chars = [], 0
        yield from self._ids(block)

    def _ids(self, block):
        words = set().union(*[words for _, words in block])
        new = [word for word in words if word not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = list(words)
        self.learn(new)
        for number, words in block:
            yield number, list(chain.from_iterable(map(self.memo.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        return [i for _, ids in self.encode_all([text]) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec_on_workers(df: DataFrame, path: str, pattern: str):
    """A function that gives the worker's codec; what is sent is the vocabulary of fixed size."""
    tokens = read_ranks(path)
    return on_workers(df.sparkSession, (tokens, pattern, PerfectHash(tokens)), _codec)


def _codec(sent) -> Codec:
    return Codec(*sent)


def encode(df: DataFrame, text: Column, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text as ``array<int>`` (empty for null)."""
    codec = codec_on_workers(df, path, pattern)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _listed(_encoded(codec(), texts))

    return df.withColumn(into, ids(text))


def _encoded(own: Codec, texts: pa.Array) -> list[array]:
    rows = [array("i") for _ in texts]
    for number, found in own.encode_all(t.as_py() for t in texts):
        rows[number].extend(found)
    return rows


def _listed(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.frombuffer(row, np.int32) for row in rows]) if ends[-1] else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_checked(df: DataFrame, text: Column, path: str, pattern: str, into: str = "encoded") -> DataFrame:
    """``df`` with the ids of each text, and whether they decode to its bytes, from one pass."""
    codec = codec_on_workers(df, path, pattern)

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def checked(texts: pa.Array) -> pa.Array:
        own = codec()
        rows = _encoded(own, texts)
        same = [own.decode(ids) == (t.as_py() or "").encode() for ids, t in zip(rows, texts)]
        return pa.StructArray.from_arrays([_listed(rows), pa.array(same, pa.bool_())], ["ids", "lossless"])

    return df.withColumn(into, checked(text))


def decode(df: DataFrame, ids: Column, path: str, pattern: str, into: str = "bytes") -> DataFrame:
    """``df`` with the bytes that each array of token ids stands for (none for null)."""
    codec = codec_on_workers(df, path, pattern)

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        own = codec()
        return pa.array([own.decode(row.as_py() or ()) for row in lists], pa.binary())

    return df.withColumn(into, raw(ids))


DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def round_trip(df: DataFrame, text: Column, path: str, pattern: str, into: str = "trip") -> DataFrame:
    """``df`` with the digests of the ids and of the bytes they decode to.

    Encoding and decoding meet in one task, so neither ids nor bytes travel.
    """
    codec = codec_on_workers(df, path, pattern)

    @F.arrow_udf(DIGESTS)
    def digests(texts: pa.Array) -> pa.Array:
        own = codec()
        n = len(texts)
        counts, of_ids, of_bytes = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        for i, ids in own.encode_all(t.as_py() for t in texts):
            of_ids[i].update(("," * (counts[i] > 0) + ",".join(map(own.names.__getitem__, ids))).encode())
            of_bytes[i].update(own.decode(ids))
            counts[i] += len(ids)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), *(pa.array([d.hexdigest() for d in ds]) for ds in (of_ids, of_bytes))],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return df.withColumn(into, digests(text))
