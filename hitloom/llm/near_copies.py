"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Two ways propose.  The SimHash of each set goes through the binary tries of ``simhash``,
which find all pairs of fingerprints at distance ``BUDGET`` or less.  Similarity 0.8 means
some ten differing bits, where tries can't prune, so MinHash bands propose pairs that differ
more: a set goes to 40 buckets, each keyed by five minima.  Sets joined by either way belong
to one clump, and within a clump the shingle sets themselves are compared, so every link is
exact.  A pair at similarity 0.8 shares no bucket with a chance of (1 - 0.8 ** 5) ** 40, about
one in eight million, and less above it.

A clump is dealt out by pairs of blocks of its sets, so no task holds a large one whole, and
each task passes on only the links that its sets need to hang together.  Equal sets meet
before that, as do null and empty texts; a text below five words is one shingle.  Repeated
rows get the same result each; a null doc_id takes part but never names a component.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm import simhash
from hitloom.llm.components import components
from hitloom.llm.store import beside, saved

SHINGLE = 5
BUDGET = 4
BANDS, MINIMA = 40, 5
BLOCK_SETS, BLOCK_SHINGLES = 128, 1_000_000
_STEP = 1024

_rng = np.random.default_rng(simhash.SEED)
_TIMES = _rng.integers(0, 1 << 63, BANDS * MINIMA, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * MINIMA, np.uint64)[:, None]


def shingles(text: str | None, size: int = SHINGLE, block: int = simhash.BLOCK_CHARS) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, in ascending order."""
    found, carry, any_yet, hashed = [np.zeros(0, np.uint64)], [], False, xxhash.xxh64_intdigest
    for words in simhash._word_blocks(text or "", block):
        words = carry + words
        if len(words) < size:
            carry = words
            continue
        carry, any_yet = words[len(words) - size + 1 :], True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
        hashes = [hashed(joined[a:b], simhash.SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
        found.append(np.unique(np.array(hashes, np.uint64)))
    if carry and not any_yet:
        found.append(np.array([hashed(b" ".join(carry), simhash.SEED)], np.uint64))
    return np.unique(np.concatenate(found))


def _name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED)


def _bands(own: np.ndarray) -> np.ndarray:
    """One key per band, none for an empty set; no two bands share a key."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _STEP):
        np.minimum(least, (own[None, at : at + _STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(keys, np.uint64).astype(np.int64)


def with_prints(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``fp`` (a name for the shingle set), its size ``n``, its SimHash ``sim`` and its ``bands``."""

    @F.arrow_udf("struct<fp:bigint,n:int,sim:bigint,bands:array<bigint>>")
    def prints(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py()) for t in texts]
        columns = [
            pa.array(np.array([_name(own) for own in sets], np.uint64).astype(np.int64)),
            pa.array([len(own) for own in sets], pa.int32()),
            pa.array(np.array([simhash.set_fingerprint(own) for own in sets], np.uint64).astype(np.int64)),
            pa.array([_bands(own) for own in sets], pa.list_(pa.int64())),
        ]
        return pa.StructArray.from_arrays(columns, ["fp", "n", "sim", "bands"])

    return df.withColumn("_print_", prints.asNondeterministic()(text)).select("*", "_print_.*").drop("_print_")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(0)]
        names = np.array([_name(own) for own in sets], np.uint64).astype(np.int64)
        columns = [pa.array(names), pa.array([own.tobytes() for own in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])


def join_sets(sets: list[np.ndarray], part: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join all pairs of similarity 0.8 or more; where there are two parts, pairs across them."""
    across = len(set(part.tolist())) > 1
    sizes = np.array([len(own) for own in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes, part = [sets[i] for i in order], sizes[order], part[order]
    label, found = np.arange(len(sets)), []
    for i, own in enumerate(sets):
        others = np.arange(i + 1, np.searchsorted(sizes, sizes[i] * 5 // 4, "right"))
        others = others[label[others] != label[i]]
        if across:
            others = others[part[others] != part[i]]
        if not len(others):
            continue
        flat = np.concatenate([sets[j] for j in others])
        starts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(same, starts, dtype=np.int64)
        near = others[9 * common >= 4 * (sizes[i] + sizes[others])]
        if len(near):
            found += [(int(order[i]), int(order[j])) for j in near]
            label[np.isin(label, label[near])] = label[i]
    return found


def _compared(table: pa.Table) -> pa.Table:
    sets = [np.frombuffer(own.as_buffer(), np.uint64) for own in table["shingles"]]
    node = table["node"].to_numpy()
    pairs = np.array(join_sets(sets, table["part"].to_numpy()), np.int64).reshape(-1, 2)
    return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})


def near_prints(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) by ``fp`` that join all sets of ``rows`` whose SimHash differs by ``BUDGET`` bits or fewer."""
    prints = rows.where("n > 0").select("fp", "sim").distinct()
    owners = saved(prints.groupBy("sim").agg(F.min("fp").alias("least"), F.max("fp").alias("most")), "owners")
    same = owners.where("least < most").select("sim", "least")
    equal = beside(prints, same, ["sim"], "inner").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    linked = saved(simhash.links(owners.select(F.col("sim").alias("fp")), BUDGET), "linked")
    half = beside(owners.select(F.col("sim").alias("u"), F.col("least").alias("a")), linked, ["u"], "inner")
    whole = beside(owners.select(F.col("sim").alias("v"), F.col("least").alias("b")), saved(half, "half"), ["v"], "inner")
    return equal.unionByName(whole.select(F.col("a").alias("u"), F.col("b").alias("v")))


def links(docs: DataFrame, rows: DataFrame, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Links (u, v) by ``fp`` that join all near copies of ``docs`` (doc_id, _t), whose prints are ``rows``."""
    bands = rows.select("fp", F.explode("bands").alias("band")).distinct()
    buckets = bands.groupBy("band").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    buckets = saved(buckets.where("least < most").select("band", "least"), "buckets")
    stars = beside(bands, buckets, ["band"], "inner").where("fp <> least")
    stars = stars.select(F.col("fp").alias("u"), F.col("least").alias("v"))
    found = saved(components(near_prints(rows).unionByName(stars)), "clumps")
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())

    sizes = rows.groupBy(F.col("fp").alias("node")).agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    members = saved(members.join(sizes, "node"), "members")
    parts = F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts")
    clumps = saved(members.groupBy("root").agg(parts), "parts")

    # The texts of the members are read a second time, so sets of other documents are never stored.
    wanted = members.where("doc_id is not null").select("doc_id").distinct().withColumn("_wanted_", F.lit(True))
    texts = beside(docs, saved(wanted, "wanted"), ["doc_id"], "left").where("_wanted_ or doc_id is null").select("_t")
    sets = texts.mapInArrow(_sets, "node long, shingles binary")
    sets = beside(sets, members.select("node", "root"), ["node"], "inner").dropDuplicates(["node"])
    sets = beside(sets, clumps, ["root"], "inner").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = sets.select("root", "node", "part", "shingles", other)
    dealt = dealt.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("other")
    return dealt.groupBy("root", "a", "b").applyInArrow(_compared, "u long, v long")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the least doc_id reachable."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    rows = saved(with_prints(docs, F.col("_t")).drop("_t"), "prints")
    return simhash.with_components(rows.drop("bands", "sim"), links(docs, rows))
