"""Language identification by words first, character n-grams for words never seen.

The model holds, per language, log frequencies of words and of character n-grams.  A text is
scored word by word: a known word by its own frequencies, an unseen word by its known n-grams
of the longest length that has any.  The model is fitted on a bounded sample of labelled
texts (``per_language`` of each language, whole texts); the numbers of words and n-grams kept
are bounded too, so it can be broadcast.

Results: ``und`` with score 0 for a null text or one without a letter, or when no language
was learned; equal scores go to the language first in the alphabet; repeated rows get the
same result each; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitloom.llm.store import beside, dropped, on_workers, saved

PER_LANGUAGE = 3000
MAX_WORDS = 40_000
MAX_GRAMS = 20_000
GRAMS = (4, 3, 2, 1)
UNKNOWN = "und"
FLOOR = 1e-7  # the frequency of what a language never showed, the same for all of them
MEMO_CELLS = 800_000
PIECE_CHARS = 1_000_000

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ˁ"
_PLAIN_WORD = re.compile(f"[{_LETTERS}]+")
_NOT_PLAIN = re.compile("[^\t-\r -~ -±´-¸º»¿-ˁ]")
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-cased runs of letters, in blocks of bounded size for very long texts."""
    text = text or ""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        while end < len(text) and text[end - 1].isalpha() and end - at < 2 * PIECE_CHARS:
            end += 1
        part = text[at:end]
        yield (_WORD if _NOT_PLAIN.search(part) else _PLAIN_WORD).findall(part.lower())
        at = end


def grams_of(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n = 0, part = word, k), added up within each batch."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for words in words_of(text.as_py()):
                counts.update((lang, 0, word) for word in words)
        yield from _rows(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, k) to (lang, n, part = n-gram, k), added up within each batch."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for n in GRAMS:
                for gram in grams_of(word, n):
                    counts[lang, n, gram] += k
        yield from _rows(counts)


def _rows(counts: Counter) -> Iterator[pa.RecordBatch]:
    keys, names = list(counts), ["lang", "n", "part", "k"]
    columns = [pa.array([key[i] for key in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names)


_PARTS = "lang string, n int, part string, k long"


def sampled(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` distinct texts of each language, spread by a hash of the text."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count()
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    # Twice the share that is wanted first, so few texts meet for the exact cut.
    near = beside(rows, sizes, ["lang"], "inner").where(part * F.col("count") <= 2 * per_language).drop("count")
    near = near.dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language).drop("_rank")


class Fitted(dict):
    """A fitted model, packed: "langs", "sizes" and "packs" of parts with their counts.

    "parts" ({n: {part: row}}; n = 0 for words) and "logs" are made where they are asked for,
    so the driver holds and sends only the packs.
    """

    def __missing__(self, key: str):
        if key not in ("parts", "logs"):
            raise KeyError(key)
        parts: dict[int, dict[str, int]] = {n: {} for n in (0, *GRAMS)}
        logs, filled = [], 0
        for n, names, counts in self.pop("packs"):
            names = names.split("\n")
            parts[n].update(zip(names, range(filled, filled + len(names))))
            filled += len(names)
            own = np.frombuffer(counts, np.int64).reshape(-1, len(self["langs"]))
            logs.append(np.log(own / np.maximum(self["sizes"][n], 1) + FLOOR).astype(np.float32))
        self.update(parts=parts, logs=np.concatenate(logs or [np.zeros((0, len(self["langs"])), np.float32)]))
        return self[key]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, part, counts) of a task as one row per n: the parts as lines, the counts as numbers."""
    names: dict[int, list[str]] = {}
    counts: dict[int, list[bytes]] = {}
    for batch in batches:
        of = batch.column(0).to_numpy()
        for n in np.unique(of).tolist():
            own = batch.filter(pa.array(of == n))
            names.setdefault(n, []).append("\n".join(own.column(1).to_pylist()))
            counts.setdefault(n, []).append(own.column(2).flatten().to_numpy().tobytes())
    for n, own in names.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.array(["\n".join(own)]), pa.array([b"".join(counts[n])])],
            ["n", "parts", "counts"],
        )


def fit(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS
) -> Fitted:
    """Frequencies of the words and n-grams of (text, lang) rows."""
    texts = sampled(labelled.select("lang", "text"), per_language).select("lang", "text")
    total = F.sum("k").alias("k")
    words = saved(texts.mapInArrow(_count, _PARTS).groupBy("lang", "n", "part").agg(total), "words")
    grams = words.select("lang", "part", "k").mapInArrow(_count_grams, _PARTS).groupBy("lang", "n", "part").agg(total)
    parts = saved(words.unionByName(grams), "parts")
    totals = {(r.lang, r.n): r.k for r in parts.groupBy("lang", "n").agg(total).collect()}
    langs = sorted({lang for lang, _ in totals})
    best = Window.partitionBy("lang", "n").orderBy(F.desc("k"), "part")
    limit = F.when(F.col("n") == 0, max_words).otherwise(max_grams)
    known = (
        parts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(max_words, max_grams)).where(F.col("r") <= limit)
    ).select("n", "part").distinct()
    counts = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("k"))), F.lit(0)) for lang in langs]
    rows = parts.join(known, ["n", "part"]).groupBy("n", "part").agg(F.array(*counts).cast("array<long>").alias("counts"))
    packs = rows.mapInArrow(_pack, "n int, parts string, counts binary").collect() if langs else []
    for df in (words, parts):
        dropped(df.sparkSession, df)
    sizes = {n: np.array([totals.get((lang, n), 0) for lang in langs], float) for n in (0, *GRAMS)}
    return Fitted(langs=langs, sizes=sizes, packs=[(r.n, r.parts, bytes(r.counts)) for r in packs])


class Model:
    """A fitted model; words that were met before are looked up in a memo of bounded size."""

    def __init__(self, fitted: dict):
        self.langs, self.parts, logs = fitted["langs"], fitted["parts"], fitted["logs"]
        self.known, self.filled = self.parts[0], len(logs)
        self.memo: dict[str, int] = {}
        room = np.zeros((MEMO_CELLS // max(1, len(self.langs)), len(self.langs)), logs.dtype)
        self.table = np.concatenate([logs, room])
        self.logs = self.table[: len(logs)]

    def word(self, word: str) -> np.ndarray:
        """Scores of an unseen word: mean over its known n-grams of the longest length."""
        for n in GRAMS:
            get = self.parts[n].get
            rows = [i for gram in grams_of(word, n) if (i := get(gram)) is not None]
            if rows:
                return self.logs[rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def _places(self, words: list[str]) -> np.ndarray:
        known, memo = self.known.get, self.memo.get
        place = dict.fromkeys(words)
        for word in place:
            row = known(word)
            place[word] = memo(word) if row is None else row
        new = [word for word, row in place.items() if row is None]
        if self.filled + len(new) > len(self.table):
            new = [word for word in place if word not in self.known]
            self.memo, self.filled = {}, len(self.logs)
            if len(new) > len(self.table) - self.filled:  # more new words than the memo is meant for
                self.table = np.concatenate([self.logs, np.zeros((len(new), len(self.langs)), self.logs.dtype)])
                self.logs = self.table[: self.filled]
        for word in new:
            self.table[self.filled] = self.word(word)
            self.memo[word] = place[word] = self.filled
            self.filled += 1
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, has letters) per text."""
        found = []
        for text in texts:
            total, n = np.zeros(len(self.langs)), 0
            for words in words_of(text):
                if not words or not self.langs:
                    n += len(words)
                    continue
                at = self._places(words)
                total += self.table[at].sum(axis=0, dtype=np.float64)
                n += len(words)
            if not n or not self.langs:
                found.append((UNKNOWN, 0.0, n > 0))
                continue
            share = np.exp(total - total.max())
            best = int(total.argmax())
            found.append((self.langs[best], float(share[best] / share.sum()), True))
        return found


_RESULT = "struct<lang:string,score:double,letters:boolean>"


def identify(df: DataFrame, text: Column, fitted: dict, into: str = "language") -> DataFrame:
    """``df`` with the language of each text, its share of the scores (0 to 1), and whether it has letters."""
    model = on_workers(df.sparkSession, fitted, Model)

    @F.arrow_udf(_RESULT)
    def language(texts: pa.Array) -> pa.Array:
        rows = model().scores(texts.to_pylist())
        langs, scores, letters = zip(*rows) if rows else ((), (), ())
        columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "letters"])

    # Filters on the result are not to run it a second time.
    return df.withColumn(into, language.asNondeterministic()(text))


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from: a fifth, by the checksum of the doc_id (never for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
