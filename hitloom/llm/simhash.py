"""SimHash near-duplicates: fingerprints, and a self-join of binary tries over them.

A pair of fingerprints at distance 2 or less agrees on at least two of its four 16-bit
blocks, one at distance 4 or less on two of six.  So each distinct fingerprint goes to one
table per pair of blocks (six or fifteen); rows that agree on the bits of a table, 32 of four
blocks, 20 to 22 of six, form the trie of the other bits.  Node pairs of a trie
are traversed together, a level at a time: their differing bits add up and a pair goes as
soon as they exceed the budget.  A trie with very many rows is dealt out by node pair at a
fixed depth, so no task holds it whole.  Each task passes on only the links that its rows
need to hang together, at most one per row.

Results: null and empty texts have fingerprint zero, linked like any other; equal
fingerprints meet before any join; repeated rows get the same result each; a null doc_id
takes part but never names a component (null where a component has no other); very long
texts are read in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.components import components
from hitloom.llm.store import beside, saved
from hitloom.llm.words import space_words

SEED, SHINGLE, BUDGET = 42, 3, 2
BLOCK_CHARS = 1_000_000
TRIE_ROWS = 200_000
DEAL_BITS = 8
FRONTIER = 100_000  # node pairs that are expanded at once

_SPACE = re.compile("[ \t-\r]")
MAX_BUDGET = 4


def _word_blocks(text: str, size: int) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield space_words(text[at:end])
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = BLOCK_CHARS) -> int:
    """SimHash over the word shingles of a text, as an unsigned number."""
    ones, total, carry, hashed = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for words in _word_blocks(text or "", block):
        words = carry + words
        carry = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
        for at in range(0, len(digests), 8 << 13):
            rows = np.frombuffer(digests[at : at + (8 << 13)], np.uint8).reshape(-1, 8)
            ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
        total += len(starts)
    if not total:
        return int.from_bytes(hashed(b" ".join(carry), SEED), "big") if carry else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: Column, into: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of each text as a long of the same 64 bits."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
        return pa.array(values.astype(np.int64))

    return df.withColumn(into, prints(text))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes that are given, as an unsigned number; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        rows = hashes[at : at + (1 << 13)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _widths(budget: int) -> list[int]:
    """Bits of each block: so many blocks that ``budget`` bits leave two of them equal."""
    count = max(4, budget + 2)
    return [64 // count + (i < 64 % count) for i in range(count)]


def _rest_bits(budget: int) -> int:
    return 64 - 2 * min(_widths(budget))


def _split(fp: np.ndarray, blocks: tuple[int, int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of two blocks, and those of the others, which are aligned at the top of ``_rest_bits``."""
    key, rest = np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.uint64)
    at, spare = 0, _rest_bits(budget) - 64
    for block, width in enumerate(_widths(budget)):
        part = fp >> np.uint64(at) & np.uint64((1 << width) - 1)
        at += width
        if block in blocks:
            key, spare = key << np.uint64(width) | part, spare + width
        else:
            rest = rest << np.uint64(width) | part
    return key, rest << np.uint64(spare)


def _tabled(budget: int):
    """Each fingerprint once per table: (tab, key, rest, fp)."""
    tables = list(combinations(range(len(_widths(budget))), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            for tab, blocks in enumerate(tables):
                key, rest = _split(signed.astype(np.uint64), blocks, budget)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(signed), tab, np.int32)),
                        pa.array(key.astype(np.int64)),
                        pa.array(rest.astype(np.int64)),
                        pa.array(signed),
                    ],
                    ["tab", "key", "rest", "fp"],
                )

    return run


class _Links:
    """Union of rows by number; every row ends at the least row of its set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def join_tries(rest: np.ndarray, pairs: list[tuple[int, int, int, int, int]], bits: int, budget: int) -> np.ndarray:
    """Least linked row for each row of sorted tries.

    ``pairs``: node pairs to start from as (low, high, low, high, differing bits) over rows of
    ``rest``, all at the level of ``bits`` remaining bits; a node paired with itself has the
    same bounds twice.
    """
    links = _Links(len(rest))
    stack = [(bits, np.array(pairs, np.int32).reshape(-1, 5))]
    counted, count = 0, np.zeros(len(rest) + 1, np.int32)  # of one level: those of all would outgrow the rows
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(level, nodes[:half]), (level, nodes[half:])]
            continue
        if not level:
            links.add(nodes[:, 0], nodes[:, 2])
            continue
        if level != counted:
            counted = level
            np.cumsum(rest >> (level - 1) & 1, dtype=np.int32, out=count[1:])
        a, b, c, d, differ = nodes.T
        mid, mid2 = b - (count[b] - count[a]), d - (count[d] - count[c])
        own = a == c
        low = np.stack([a, mid, c, mid2, differ], 1)
        high = np.stack([mid, b, mid2, d, differ], 1)
        up = np.stack([a, mid, mid2, d, differ + 1], 1)
        down = np.stack([mid, b, c, mid2, differ + 1], 1)[~own]
        after = np.concatenate([low, high, up, down])
        after = after[(after[:, 0] < after[:, 1]) & (after[:, 2] < after[:, 3]) & (after[:, 4] <= budget)]
        after = after[(after[:, 0] != after[:, 2]) | (after[:, 1] - after[:, 0] > 1)]
        if len(after):
            stack.append((level - 1, after))
    return links.label


def _traverse(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TRIE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = _group_starts(table)[-1]  # the last trie may go on in the next batch
            if last:
                yield from _links_of(table.slice(0, last), budget)
                held = table.slice(last).to_batches()
        if held:
            yield from _links_of(pa.Table.from_batches(held), budget)

    return run


def _group_starts(table: pa.Table) -> np.ndarray:
    cols = [table[c].to_numpy() for c in ("tab", "key", "node")]
    new = np.ones(len(table), bool)
    if len(table):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new) if len(table) else np.zeros(1, np.int64)


def _links_of(table: pa.Table, budget: int) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    starts = _group_starts(table)
    ends = np.append(starts[1:], len(table))
    rest, fp, node = (table[c].to_numpy() for c in ("rest", "fp", "node"))
    whole, dealt = [], []
    rest_bits = _rest_bits(budget)
    prefix = rest >> (rest_bits - DEAL_BITS)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        if node[a] < 0:
            whole.append((a, b, a, b, 0))
            continue
        left, right = node[a] >> DEAL_BITS, node[a] & ((1 << DEAL_BITS) - 1)
        if left == right:
            dealt.append((a, b, a, b, 0))
        else:
            mid = a + int(np.searchsorted(prefix[a:b], right))
            if a < mid < b:
                dealt.append((a, mid, mid, b, int(left ^ right).bit_count()))
    for pairs, bits in ((whole, rest_bits), (dealt, rest_bits - DEAL_BITS)):
        if pairs:
            label = join_tries(rest, pairs, bits, budget)
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[label[at]])], ["u", "v"])


def _near(prefix: Column, budget: int) -> Column:
    """The node pairs (smaller << DEAL_BITS | larger) that a prefix takes part in."""
    others = F.filter(
        F.sequence(F.lit(0), F.lit((1 << DEAL_BITS) - 1)), lambda y: F.bit_count(prefix.bitwiseXOR(y)) <= budget
    )
    return F.transform(others, lambda y: F.shiftleft(F.least(prefix, y), DEAL_BITS).bitwiseOR(F.greatest(prefix, y)))


def links(prints: DataFrame, budget: int = BUDGET, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links (u, v) that join all fingerprints at distance ``budget`` or less, of distinct ``fp``.

    Each is a pair of fingerprints of one component; pairs that follow from others are left out.
    """
    if budget > MAX_BUDGET:
        raise ValueError(f"a distance above {MAX_BUDGET} leaves too few equal bits for tables")
    rows = prints.select("fp").mapInArrow(_tabled(budget), "tab int, key long, rest long, fp long")
    crowded = rows.groupBy("tab", "key").count().where(F.col("count") > trie_rows).select("tab", "key", F.lit(True).alias("hot"))
    rows = beside(rows, saved(crowded, "crowded"), ["tab", "key"], "left")
    prefix = F.shiftrightunsigned("rest", _rest_bits(budget) - DEAL_BITS).cast("int")
    cold = rows.where("hot is null").withColumn("node", F.lit(-1))
    hot = rows.where("hot").withColumn("node", F.explode(_near(prefix, budget)))
    dealt = cold.unionByName(hot).select("tab", "key", "node", "rest", "fp")
    return (
        dealt.repartition("tab", "key", "node")
        .sortWithinPartitions("tab", "key", "node", "rest")
        .mapInArrow(_traverse(budget), "u long, v long")
    )


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the least doc_id reachable."""
    rows = saved(
        with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), F.col("_t")).drop("_t"),
        "prints",
    )
    return with_components(rows, links(rows.select("fp").distinct()))


def with_components(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of ``rows`` (doc_id, fp), whose ``fp`` are joined by the links (u, v)."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked)
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = saved(named, "named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = named.join(names, "root").select("fp", "component_id")
    return rows.join(owners, "fp").select("doc_id", "fp", "component_id")


def one_per_component(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: Callable[..., DataFrame] = near_duplicates
) -> DataFrame:
    """``df`` with the least doc_id of each component only; a document without doc_id stays.

    Where several rows carry that doc_id, one of them stays.  ``classes`` gives the components.
    """
    found = saved(classes(df, doc_id, text), "classes").where("doc_id is not null")
    first = F.max(F.col("doc_id") == F.col("component_id"))
    rows = found.groupBy("doc_id").agg(F.count("*").alias("_copies_"), first.alias("_first_"))
    marks = rows.where("not _first_ or _copies_ > 1").withColumnRenamed("doc_id", doc_id)
    marked = beside(df, saved(marks, "marks"), [doc_id], "left")
    once = marked.where("_copies_ is null").select(df.columns)
    repeated = marked.where("_first_ and _copies_ > 1").select(df.columns).dropDuplicates([doc_id])
    return once.unionByName(repeated)
