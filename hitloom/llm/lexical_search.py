"""Ranked lexical search over bit-sliced Bloom signatures, exact.

A signature holds the terms of a document, and each of them again, under another code, at twice,
four times, ... its occurrences.  Documents of like size stand side by side in a block, whose
slices are bitmaps over its documents: the documents that may hold a term are the AND of a few
slices, never too few of them.  The deepest code found gives the most occurrences the term can
have in a document, and so the most it can add to the score; sums of these over an item's terms
bound the score of every document of the block at once.

The documents with the highest bounds are scored exactly first; the last of the wanted places
among them is a score that every answer must reach.  All documents whose bound reaches it are
then scored exactly from their whole text: only documents provably below it are left out.

A document's value for a term is floor(1e9 tf / (1000 tf + 12 m)), with m from its length (in
``length_norm``), its weight floor(1000 ln((2 N + 2) / (2 df + 1))).

Results: null and empty texts have no terms; a document without terms is no answer and does not
count in N.  Every row is a document of its own, repeated rows too; a null doc_id comes last among
equal scores.  Rows of ``items`` that are equal in id and text are one item; an item without a
term in any document has no answers.  Very long texts get blocks of few documents.  Other columns
are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitloom.llm.store import beside, on_workers, saved
from hitloom.llm.words import alnum_words

BITS, HASHES = 16, 8
BLOCK_BITS, BLOCK_DOCS = 1 << 22, 1024
ITEM_BYTES = 1 << 20
#: Documents per item that are scored first.
FIRST = 50
_MEMO, _ROWS = 500_000, 4096
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def term_code(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def at_level(codes: np.ndarray, level: int) -> np.ndarray:
    """Codes for 2 ** level occurrences or more."""
    with np.errstate(over="ignore"):
        x = codes + _LEVEL * np.uint64(level)
        x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def places(codes: np.ndarray, width: int) -> np.ndarray:
    """Bits of each code in a signature of ``width`` bits: (codes, HASHES)."""
    with np.errstate(over="ignore"):
        step = (codes >> np.uint64(17)) | np.uint64(1)
        spots = codes[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (spots % np.uint64(width)).astype(np.int64)


def width_of(entries: int) -> int:
    """Bits of a signature: the least of 2^k and 3 * 2^k that gives each entry ``BITS``."""
    need = max(64, entries * BITS)
    power = 1 << (need - 1).bit_length()
    return power * 3 // 4 if power * 3 // 4 >= need else power


def length_norm(n, documents: int, terms: int):
    """m of a document of n terms."""
    return 75 + (25 * n * documents) // terms


def value(tf, m):
    """What one occurrence of a term in an item adds to the score, per unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Block:
    """Documents of one signature width, until they fill a block."""

    def __init__(self, width: int):
        self.width, self.keys, self.lengths, self.codes = width, [], [], []
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // width // 8 * 8))

    def record(self) -> dict:
        bits = np.zeros((self.width, -(-len(self.keys) // 8) * 8), bool)
        for doc, codes in enumerate(self.codes):
            bits[places(codes, self.width).ravel(), doc] = True
        slices = np.packbits(bits, axis=1).tobytes()
        return {"keys": self.keys, "lengths": self.lengths, "width": self.width, "slices": slices}


_INDEX = "keys array<long>, lengths array<long>, width int, slices binary, n_docs long, n_terms long, df array<long>"
_INDEX_PA = pa.schema(
    [
        ("keys", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("width", pa.int32()),
        ("slices", pa.binary()),
        ("n_docs", pa.int64()),
        ("n_terms", pa.int64()),
        ("df", pa.list_(pa.int64())),
    ]
)


def _signature(counts: Counter, memo: dict) -> np.ndarray:
    codes = []
    for term in counts:
        code = memo.get(term)
        if code is None:
            if len(memo) >= _MEMO:
                memo.clear()
            code = memo[term] = term_code(term)
        codes.append(code)
    codes, times = np.array(codes, np.uint64), np.fromiter(counts.values(), np.int64, len(counts))
    found, level = [], 0
    while len(codes):
        found.append(at_level(codes, level))
        level += 1
        more = times >= 1 << level
        codes, times = codes[more], times[more]
    return np.concatenate(found)


def _indexed(vocabulary, with_blocks: bool):
    """Blocks of a task's documents, and one last row with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_, memo = vocabulary(), {}, {}
        df, n_docs, n_terms = [0] * len(known), 0, 0
        for batch in batches:
            for key, text in zip(*(batch.column(c) for c in ("key", "text"))):
                words = alnum_words(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                for term in known.keys() & counts.keys():
                    df[known[term]] += 1
                if with_blocks:
                    codes = _signature(counts, memo)
                    width = width_of(len(codes))
                    block = open_.setdefault(width, _Block(width))
                    block.keys.append(key.as_py())
                    block.lengths.append(len(words))
                    block.codes.append(codes)
                    if len(block.keys) == block.room:
                        yield pa.RecordBatch.from_pylist([open_.pop(width).record()], _INDEX_PA)
        for block in open_.values():
            yield pa.RecordBatch.from_pylist([block.record()], _INDEX_PA)
        yield pa.RecordBatch.from_pylist([{"n_docs": n_docs, "n_terms": n_terms, "df": df}], _INDEX_PA)

    return run


class Queries:
    """The items of one part: terms with their weights, and each item's terms."""

    def __init__(self, sent: tuple):
        terms, weights, items, self.documents, self.terms = sent
        self.number = {term: i for i, term in enumerate(terms)}
        self.weights = weights
        self.items = items  # per item {term number: times in the item}
        self.codes = np.array([term_code(t) for t in terms], np.uint64)
        owner = [i for i, own in enumerate(items) for _ in own]
        self.owner = np.array(owner, np.int64)
        self.term = np.array([t for own in items for t in own], np.int64)
        self.times = np.array([times * weights[t] for own in items for t, times in own.items()], float)

    def bounds(self, width: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """(items, documents): scores that no document of the block exceeds."""
        docs = len(lengths)
        m = length_norm(lengths, self.documents, self.terms)
        total = np.zeros((len(self.items), docs))
        term, owner, times = self.term, self.owner, self.times
        there = np.full((len(self.codes), slices.shape[1]), 255, np.uint8)
        live, level, before = np.arange(len(self.codes)), 0, np.zeros(docs)
        while len(live):
            own = at_level(self.codes[live], level)
            now = there[live]
            spots = places(own, width)
            for k in range(HASHES):
                now &= slices[spots[:, k]]
            there[live] = now
            live = live[now.any(axis=1)]
            kept = np.isin(term, live)
            term, owner, times = term[kept], owner[kept], times[kept]
            if not len(term):
                break
            level += 1
            # From 2 ** (level - 1) occurrences on there can be up to 2 ** level - 1.
            most = value(np.minimum((1 << level) - 1, lengths), m).astype(float)
            for at in range(0, len(term), _ROWS):
                part, owners = slice(at, at + _ROWS), owner[at : at + _ROWS]
                bits = np.unpackbits(there[term[part]], axis=1, count=docs) * times[part, None]
                starts = np.flatnonzero(np.diff(owners, prepend=-1))
                total[owners[starts]] += np.add.reduceat(bits, starts, axis=0) * (most - before)
            before = most
        return total

    def score(self, item: int, counts: Counter, m: int) -> int:
        """Exact score; ``counts`` by term number."""
        return sum(
            times * self.weights[t] * value(counts[t], m) for t, times in self.items[item].items() if t in counts
        )

    def counted(self, words: list[bytes]) -> Counter:
        number = self.number
        return Counter(number[w] for w in words if w in number)


def _block_rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for keys, lengths, width, slices in zip(*(batch.column(c) for c in ("keys", "lengths", "width", "slices"))):
            width = width.as_py()
            bits = np.frombuffer(slices.as_buffer(), np.uint8).reshape(width, -1)
            yield keys.values.to_numpy(), lengths.values.to_numpy(), width, bits


def _highest(queries, count: int):
    """Per task the documents of the highest bounds of each item: (item, key, bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries()
        keys = np.zeros((len(own.items), 0), np.int64)
        best = np.zeros((len(own.items), 0))
        for block_keys, lengths, width, slices in _block_rows(batches):
            best = np.hstack([best, own.bounds(width, lengths, slices)])
            keys = np.hstack([keys, np.broadcast_to(block_keys, (len(own.items), len(block_keys)))])
            if best.shape[1] > count:
                at = np.argpartition(-best, count, axis=1)[:, :count]
                best, keys = np.take_along_axis(best, at, 1), np.take_along_axis(keys, at, 1)
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(keys[item, at]), pa.array(best[item, at])], ["item", "key", "bound"]
        )

    return run


def _reaching(queries, least: np.ndarray):
    """Documents whose bound reaches an item's least score: (key, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries()
        for keys, lengths, width, slices in _block_rows(batches):
            item, doc = np.nonzero(own.bounds(width, lengths, slices) >= least[:, None])
            order = np.argsort(doc, kind="stable")
            docs, starts = np.unique(doc[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(item[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[docs]), lists], ["key", "items"])

    return run


def _scored(queries, count: int):
    """Exact scores above 0 of documents for the items listed; per task the best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = queries(), {}
        order = lambda x: (-x[0], x[1] is None, x[1] or 0)
        for batch in batches:
            for doc_id, text, items in zip(*(batch.column(c) for c in ("doc_id", "text", "items"))):
                words = alnum_words(text.as_py())
                counts, doc_id = own.counted(words), doc_id.as_py()
                m = length_norm(len(words), own.documents, own.terms)
                for item in items.as_py():
                    if (score := own.score(item, counts, m)) > 0:
                        best = found.setdefault(item, [])
                        best.append((score, doc_id))
                        if len(best) >= 8 * count:
                            best.sort(key=order)
                            del best[count:]
        rows = [(item, doc_id, score) for item, best in found.items() for score, doc_id in sorted(best, key=order)[:count]]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["item", "doc_id", "score"],
        )

    return run


def _exact(docs: DataFrame, wanted: DataFrame, queries, count: int) -> DataFrame:
    """(item, doc_id, score) of the documents with a key of ``wanted`` (key, items)."""
    rows = beside(docs, wanted, ["key"], "inner").select("doc_id", "text", "items")
    return rows.mapInArrow(_scored(queries, count), "item int, doc_id long, score long")


def _ranked(scores: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _vocabulary(sent: list[bytes]) -> dict[bytes, int]:
    return {term: i for i, term in enumerate(sent)}


def _part(docs: DataFrame, index: DataFrame | None, items: list[str | None], count: int):
    """Answers (item, rank, doc_id, score) to a part of the items, and the index, built in the first part."""
    spark = docs.sparkSession
    words = [Counter(alnum_words(text)) for text in items]
    terms = sorted({term for own in words for term in own})
    number = {term: i for i, term in enumerate(terms)}
    scan = docs.select("key", "text").mapInArrow(_indexed(on_workers(spark, terms, _vocabulary), index is None), _INDEX)
    scan = saved(scan, "signatures")
    counts = scan.where("n_docs is not null")
    documents, total = (int(x or 0) for x in counts.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = dict(counts.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col")).collect())
    if index is None:
        index = scan.where("width is not null").select("keys", "lengths", "width", "slices")
    weights = [weight(documents, df.get(i, 0)) for i in range(len(terms))]
    own = [{number[term]: times for term, times in c.items()} for c in words]
    queries = on_workers(spark, (terms, weights, own, documents, max(total, 1)), Queries)

    best = index.mapInArrow(_highest(queries, FIRST), "item int, key long, bound double")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST)
    first = saved(best.groupBy("key").agg(F.collect_set("item").alias("items")), "first")
    last = _ranked(_exact(docs, first, queries, count), count).where(F.col("rank") == count)
    least = np.ones(len(items))
    for row in last.select("item", "score").collect():
        least[row.item] = row.score

    reaching = index.mapInArrow(_reaching(queries, least), "key long, items array<int>")
    named = F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    reaching = saved(reaching.groupBy("key").agg(named), "reaching")
    return _ranked(_exact(docs, reaching, queries, count), count).select("item", "rank", "doc_id", "score"), index


def search(
    df: DataFrame,
    items: DataFrame,
    count: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``count`` documents of the highest scores above 0 for each item.

    Items are taken ``item_bytes`` of text at a time; the signatures are made once for all of them.
    """
    body: Column = F.col(text)
    docs = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body, F.octet_length(body)).alias("key")
    )
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("body")).dropDuplicates()
    size = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts, index, answers = size // item_bytes + 1, None, None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(parts)) == part)
        rows = sorted((tuple(row) for row in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        found, index = _part(docs, index, [body for _, body in rows], count)
        schema = f"item int, item_id {items.schema[item_id].dataType.simpleString()}"
        names = docs.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(rows)], schema)
        found = beside(found, names, ["item"], "inner").select("item_id", "rank", "doc_id", "score")
        found = saved(found, "answers") if parts > 1 else found
        answers = found if answers is None else answers.unionByName(found)
    return answers
