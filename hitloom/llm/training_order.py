"""Token sequences in training order, as fixed-stride binary shards.

Texts become sequences of ``SEQ_TOKENS`` token ids (the last of a text is shorter).  A keyed
Feistel permutation over the next even number of bits, walked until it stays inside, gives
the sequence with number i its global slot; all slots from 0 to n - 1 are taken once.  Slots
go by range into shards of ``SHARD_SLOTS`` records; each shard is one file, its records
stand in the order of their slots and all have the same size, so a reader finds slot s at
byte (s mod SHARD_SLOTS) * stride of file s div SHARD_SLOTS and can resume anywhere.

A record: slot, whether it has a doc_id, doc_id, sequence number in its text, tokens (five
little-endian int64), then the ids as uint32 (``id_bytes`` 4) or uint16 (2) with zeros to the end, then a
line feed, which is what lets Spark's text writer write the files: any store will do, and a
task that is run again leaves no second file.

Results: null and empty texts have no tokens and no sequences; repeated rows are sequences of
their own; an empty table gives an empty folder; ids that do not fit in ``id_bytes`` are an
error; other columns are not written.  The order depends on the key and on the layout of the
input table (part and row), so reading the same files again gives the same slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.bpe import Codec, pieces, read_ranks
from hitloom.llm.store import dropped, on_workers, saved

SEQ_TOKENS = 512
SHARD_SLOTS = 16_384
ROUNDS = 6
HEAD = 5
WAVES = 4
# Shuffle files go when the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below ``n`` under the permutation that ``key`` names."""
    half = np.uint64(max(1, -(-(max(n, 2) - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            own = (key + r * 0x9E3779B97F4A7C15) % (1 << 64)
            left, right = right, left ^ (_mixed(right, own) & mask)
        return left << half | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= n).any():  # a walk ends, as its start lies below n
        out[far] = once(out[far])
    return out.astype(np.int64)


class LibraryCodec(Codec):
    """A codec that hands whole pieces of texts to the tokenizer library."""

    def __init__(self, sent: tuple[list[bytes], str]):
        super().__init__(*sent, table=object())
        self.library = tiktoken.Encoding("own", pat_str=sent[1], mergeable_ranks=self.ranks, special_tokens={})

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        for number, text in enumerate(texts):
            for piece in (pieces(text) if self.quick else (text,)) if text else ():
                yield number, self.library.encode_ordinary(piece)


_SEQUENCES = "part int, number long, doc_id long, seq long, n_tokens int, ids binary"
_NAMES = [field.split()[0] for field in _SEQUENCES.split(",")]


def _cut(own: Codec, texts: pa.Array, seq_tokens: int) -> Iterator[tuple[int, int, list[int]]]:
    """(row, number of the sequence in its text, ids) for the texts of a batch."""
    at, seq, rest = -1, 0, []
    for row, ids in own.encode_all(t.as_py() for t in texts):
        if row != at:
            if rest:
                yield at, seq, rest
            at, seq, rest = row, 0, []
        rest = rest + ids
        while len(rest) > seq_tokens:
            stop = (len(rest) - 1) // seq_tokens * seq_tokens
            for start in range(0, stop, seq_tokens):
                yield at, seq, rest[start : start + seq_tokens]
                seq += 1
            rest = rest[stop:]
    if rest:
        yield at, seq, rest


def sequences(
    df: DataFrame, text: Column, path: str, pattern: str, doc_id: str = "doc_id", seq_tokens: int = SEQ_TOKENS, id_bytes: int = 2
) -> DataFrame:
    """Sequences of token ids, numbered 0, 1, ... within each part (task) of the input.

    ``ids`` are compressed, for the stored table and for the shuffle into shards.
    """
    tokens, kind = read_ranks(path), {2: "<u2", 4: "<u4"}[id_bytes]
    if len(tokens) > 1 << 8 * id_bytes:
        raise OverflowError(f"ids of this vocabulary do not fit in {id_bytes} bytes")
    codec = on_workers(df.sparkSession, (tokens, pattern), LibraryCodec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number, held = codec(), TaskContext.get().partitionId(), 0, []
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for row, seq, ids in _cut(own, batch.column(1), seq_tokens):
                held.append((part, number, docs[row], seq, len(ids), zlib.compress(np.array(ids, kind).tobytes(), 1)))
                number += 1
                if len(held) >= 4096:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text.alias("_t_")).mapInArrow(cut, _SEQUENCES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)


def slotted(rows: DataFrame, key: int) -> DataFrame:
    """Stored ``sequences`` with their global slot.

    The number of a sequence is its number in its part plus the sizes of the parts before;
    there is one size per part, that is per task.
    """
    spark = rows.sparkSession
    sizes = sorted(tuple(r) for r in rows.groupBy("part").count().collect())
    n, starts = 0, []
    for part, size in sizes:
        starts.append((part, n))
        n += size
    first = spark.createDataFrame(starts or [(0, 0)], "part int, first long")

    @F.arrow_udf("bigint")
    def slot(numbers: pa.Array) -> pa.Array:
        return pa.array(permuted(numbers.to_numpy(), n, key))

    return rows.join(F.broadcast(first), "part").withColumn("slot", slot(F.col("number") + F.col("first")))


def stride(seq_tokens: int = SEQ_TOKENS, id_bytes: int = 2) -> int:
    """Bytes of a record."""
    return 8 * HEAD + seq_tokens * id_bytes + 1


def write_shards(
    rows: DataFrame, path: str, key: int, seq_tokens: int = SEQ_TOKENS, id_bytes: int = 2,
    shard_slots: int = SHARD_SLOTS, waves: int = WAVES,
) -> int:
    """Write stored ``sequences`` to one file per shard; returns the number of sequences.

    File number i (part-i) holds slots i * shard_slots and on.  The shards are written in
    ``waves`` of neighbouring ones; the shuffle of a wave is removed when its files are
    written, so only a part of the sequences is on disk in shuffled form at a time.
    """
    spark = rows.sparkSession
    n = rows.count()
    shards = max(1, -(-n // shard_slots))
    width = seq_tokens * id_bytes

    @F.arrow_udf("binary")
    def record(slots: pa.Array, docs: pa.Array, seqs: pa.Array, counts: pa.Array, ids: pa.Array) -> pa.Array:
        columns = (slots, docs.is_valid(), docs.fill_null(0), seqs, counts)
        heads = np.stack([x.to_numpy(zero_copy_only=False).astype("<i8") for x in columns], 1)
        bodies = [zlib.decompress(i.as_buffer()).ljust(width, b"\0") for i in ids]
        return pa.array([h.tobytes() + i for h, i in zip(heads, bodies)], pa.binary())

    body = record("slot", "doc_id", "seq", "n_tokens", "ids").cast("string").alias("value")
    placed = slotted(rows, key).withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("int"))
    each = -(-shards // waves)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        for first in range(0, shards, each):
            count = min(each, shards - first)
            own = placed.where(F.col("shard").between(first, first + count - 1))
            ordered = own.repartitionById(first + count, F.col("shard")).sortWithinPartitions("slot")
            ordered.select(body).write.mode("append").option("lineSep", "\n").text(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _drop_empty(spark, f"{path}/part-*")
    return n


def _drop_empty(spark: SparkSession, pattern: str) -> None:
    """Remove empty files: the writer leaves one where the first task of a wave had no rows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(target) or []:
        if not status.getLen():
            system.delete(status.getPath(), False)


_READ = "slot long, shard int, offset long, doc_id long, seq long, n_tokens int, ids_crc32 long, ids array<int>"


def read_shards(
    spark: SparkSession,
    path: str,
    seq_tokens: int = SEQ_TOKENS,
    id_bytes: int = 2,
    shard_slots: int = SHARD_SLOTS,
    with_ids: bool = True,
) -> DataFrame:
    """The records of all shards, each read in one sequential pass; ids are null unless asked for.

    ``ids_crc32`` is the checksum of the ids as stored, without the zeros after them.
    """
    size, kind = stride(seq_tokens, id_bytes), {2: "<u2", 4: "<u4"}[id_bytes]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % size:
                    raise ValueError("a shard is not a whole number of records")
                for at in range(0, len(raw), size << 11):
                    part = raw[at : at + (size << 11)].reshape(-1, size)
                    yield _records(part, at, kind, shard_slots, with_ids)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, _READ)


def _records(raw: np.ndarray, at: int, kind: str, shard_slots: int, with_ids: bool) -> pa.RecordBatch:
    n, size = raw.shape
    head = np.ascontiguousarray(raw[:, : 8 * HEAD]).view("<i8")
    slots, named, docs, seqs, counts = head.T
    body = np.ascontiguousarray(raw[:, 8 * HEAD : -1])
    lengths = counts * np.dtype(kind).itemsize
    checks = [zlib.crc32(row[:length]) for row, length in zip(body, lengths.tolist())]
    ids = pa.nulls(n, pa.list_(pa.int32()))
    if with_ids:
        wide = body.view(kind)
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        flat = wide[np.arange(wide.shape[1]) < counts[:, None]].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    columns = [
        pa.array(slots),
        pa.array((slots // shard_slots).astype(np.int32)),
        pa.array(at + size * np.arange(n, dtype=np.int64)),
        pa.array(docs, mask=named == 0),
        pa.array(seqs),
        pa.array(counts.astype(np.int32)),
        pa.array(checks, pa.int64()),
        ids,
    ]
    return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _READ.split(",")])


def materialise(
    df: DataFrame,
    text: Column,
    path: str,
    tokenizer: str,
    pattern: str,
    key: int,
    doc_id: str = "doc_id",
    seq_tokens: int = SEQ_TOKENS,
    id_bytes: int = 2,
    shard_slots: int = SHARD_SLOTS,
) -> int:
    """Tokenise once and write the shards to ``path``; returns the number of sequences."""
    rows = saved(sequences(df, text, tokenizer, pattern, doc_id, seq_tokens, id_bytes), "sequences")
    n = write_shards(rows, path, key, seq_tokens, id_bytes, shard_slots)
    dropped(df.sparkSession, rows)
    return n
