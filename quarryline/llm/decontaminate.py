"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. The SEED-grams of all test items are counted over the whole corpus. Of every WINDOW consecutive ones of an item those are seeds that aren't much
   more frequent (SPREAD times and FEW) than the rarest, so that any stretch of an item that long has some, however common the item is in
   the corpus, and an edited copy isn't missed for what it left out.
2. Documents are scanned for seeds; each hit opens a region of the document around the place that the item would have there. Overlapping regions of
   a (document, item) pair are one.
3. Region and item are aligned word by word (MATCH, MISS, GAP). The score is the best local alignment's, as a share of a perfect copy's. Pairs
   of at least LEAST count as contamination, so edited and paraphrased copies do too.

Only the test items are broadcast, in blocks of at most BLOCK_WORDS words; more items mean more passes over the documents. Nothing else is shuffled than
seed counts (one number per gram and task). Words are lower case, cut at white space and ASCII signs.

Defined cases: null or empty texts of either table match nothing; a null id is kept as null; items of fewer than SEED words match
nothing; equal items each give a row; repeated rows each give theirs; empty tables give no rows, and leave documents as they are;
other columns are not read (`kept` passes them on).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SEED = 2
WINDOW = 6
SPREAD, FEW = 4, 64
MATCH, MISS, GAP = 2, -1, -1
LEAST = 0.5
BLOCK_WORDS = 2_000_000
#: Alignments that are made at once: cells of a row.
BATCH_CELLS = 200_000
GROUP_WORDS = 500_000
SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_spaces = bytes.maketrans(SIGNS, b" " * len(SIGNS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_spaces).split()


class Items:
    """Test items of a block: their words as numbers from 1, and their grams."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        kept = [(i, [number(w, len(self.vocabulary) + 1) for w in words_of(t)]) for i, t in rows]
        self.ids = [i for i, w in kept if len(w) >= SEED]
        self.words = [np.array(w, np.int32) for _, w in kept if len(w) >= SEED]
        grams = [self.grams(w) for w in self.words]
        self.keys = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.places = [np.searchsorted(self.keys, g) for g in grams]
        self.use(np.ones(len(self.keys), bool))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        # the items of each word, one word after the other
        pairs = np.unique(np.concatenate([np.stack([w, np.full(len(w), i)], 1) for i, w in enumerate(self.words)]), axis=0) if self.words else np.zeros((0, 2), np.int64)
        self.of_word = pairs[:, 1]
        self.word_starts, self.word_ends = (np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1), side) for side in ("left", "right"))

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Key of each run of SEED words; 0 where one of them is in no item."""
        key, good = np.zeros(max(0, len(numbers) - SEED + 1), np.int64), np.ones(max(0, len(numbers) - SEED + 1), bool)
        for k in range(SEED):
            part = numbers[k : len(numbers) - SEED + 1 + k]
            key = key * (len(self.vocabulary) + 1) + part
            good &= part > 0
        return np.where(good, key, 0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))

    def use(self, chosen: np.ndarray) -> None:
        """Marks the grams that are looked for."""
        self.wanted = np.zeros(1 << 22, bool)
        self.wanted[self.slot(self.keys[chosen])] = True
        self.chosen = chosen

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.intp)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of wanted grams, and which they are."""
        keys = self.grams(numbers)
        at = np.flatnonzero(keys)
        at = at[self.wanted[self.slot(keys[at])]]
        which = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        good = (self.keys[which] == keys[at]) & self.chosen[which]
        return at[good], which[good]

    def choose(self, counts: np.ndarray) -> None:
        """Keeps as seeds the rare grams of each WINDOW consecutive ones of an item."""
        seeds = np.zeros(len(self.keys), bool)
        self.at: dict[int, list[tuple[int, int]]] = {}
        for item, own in enumerate(self.places):
            view = np.lib.stride_tricks.sliding_window_view(counts[own], min(WINDOW, len(own)))
            most = SPREAD * view.min(1) + FEW
            # a gram is a seed if it is rare enough in any window that it is in
            for place in np.unique(np.add(*np.nonzero(view <= most[:, None]))).tolist():
                seeds[own[place]] = True
                self.at.setdefault(int(own[place]), []).append((item, place))
        self.use(seeds)


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and where in the first it ends. Pairs go side by side, padded by signs that match nothing."""
    best, end = np.zeros(len(docs), np.int32), np.zeros(len(docs), np.int32)
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    while order:
        width = len(docs[order[-1]])
        now, order = order[-max(1, BATCH_CELLS // max(1, width)) :], order[: -max(1, BATCH_CELLS // max(1, width))]
        a, b = np.zeros((len(now), width), np.int32), np.full((len(now), max(len(items[i]) for i in now)), -1, np.int32)
        for r, i in enumerate(now):
            a[r, : len(docs[i])] = docs[i]
            b[r, : len(items[i])] = items[i]
        score, slope = np.zeros((len(now), width + 1), np.int32), np.arange(width + 1, dtype=np.int32) * -GAP
        top, where = np.zeros(len(now), np.int32), np.zeros(len(now), np.int32)
        for k in range(b.shape[1]):
            step = np.where(a == b[:, k : k + 1], MATCH, MISS)
            new = np.zeros_like(score)
            np.maximum(score[:, :-1] + step, score[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new + slope, 1) - slope
            score = np.where(b[:, k : k + 1] >= 0, new, 0)
            at = score.argmax(1)
            value = score[np.arange(len(now)), at]
            better = value > top
            top[better], where[better] = value[better], at[better]
        best[now], end[now] = top, where
    return best, end


def regions(items: Items, numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, from, to) of the document's regions that seeds point at."""
    found: dict[int, list[int]] = {}
    for at, gram in zip(*(x.tolist() for x in items.hits(numbers)), strict=True):
        for item, place in items.at[gram]:
            found.setdefault(item, []).append(at - place)
    out = []
    for item, starts in found.items():
        n = len(items.words[item])
        pad, a, b = max(4, n // 4), None, 0
        for s in sorted(starts):
            low, high = max(0, s - pad), min(len(numbers), s + n + pad)
            if a is not None and low <= b and high - a <= 8 * (n + 2 * pad):
                b = max(b, high)
            else:
                if a is not None:
                    out.append((item, a, b))
                a, b = low, high
        if a is not None:
            out.append((item, a, b))
    return out


def whole(items: Items, numbers: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(item, 0, number of words) of items whose alignment with the document can score `least`: each match scores MATCH, so at least that share of the item's length has to be words of the item."""
    known = numbers[numbers > 0]
    lengths = items.word_ends[known] - items.word_starts[known]
    at = np.repeat(items.word_starts[known] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    n = np.bincount(items.of_word[at], minlength=len(items.ids))
    return [(i, 0, len(numbers)) for i in np.flatnonzero(n >= least * items.lengths).tolist()]


def matched(items: Items, texts: list[str | None], least: float, exact: bool = False) -> list[list[tuple[int, float, int, int]]]:
    """For each text its (item, score, first word, word after the last), best region of each item; exact: of the whole text, without seeds."""
    numbers = [items.numbers(words_of(t)) for t in texts]
    tasks = [(d, *r) for d, n in enumerate(numbers) for r in (whole(items, n, least) if exact else regions(items, n))]
    best, end = align([numbers[d][a:b] for d, _, a, b in tasks], [items.words[i] for _, i, _, _ in tasks])
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    good = [(t, e) for t, s, e in zip(range(len(tasks)), best.tolist(), end.tolist(), strict=True) if s >= least * MATCH * len(items.words[tasks[t][1]])]
    _, back = align([numbers[tasks[t][0]][tasks[t][2] : tasks[t][2] + e][::-1] for t, e in good], [items.words[tasks[t][1]][::-1] for t, e in good])
    for (t, e), length in zip(good, back.tolist(), strict=True):
        d, item, a, _ = tasks[t]
        score = float(best[t]) / (MATCH * len(items.words[item]))
        found[d, item] = max(found.get((d, item), (0.0, 0, 0)), (round(score, 6), a + e - length, a + e))
    out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
    for (d, item), (score, a, b) in sorted(found.items()):
        out[d].append((item, score, a, b))
    return out


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about GROUP_WORDS words."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            size += n
            if size >= 6 * GROUP_WORDS:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def blocks(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> Iterator[Items]:
    """Blocks of test items with their seeds chosen (exact: without). A block is collected; its size is bounded by BLOCK_WORDS."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (4 * BLOCK_WORDS))

    def count(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        sums = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for text in batch.column(0):
                sums += np.bincount(items.hits(items.numbers(words_of(text.as_py())))[1], minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["gram", "n"])

    for block in range(n):
        items = Items(sorted(map(tuple, benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block).collect()), key=str))
        if items.ids and exact:
            yield items
        elif items.ids:
            rows = docs.where("text IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(functools.partial(count, items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
            counts = np.zeros(len(items.keys), np.int64)
            for r in rows:  # one per gram of the block
                counts[r.gram] = r.n
            items.choose(counts)
            yield items


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, exact: bool = False) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every contaminated pair. exact: each document is aligned whole with every item that it has enough words of, whatever its seeds; that costs much more."""
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"

    def run(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in grouped(batches, "text"):
            rows = [(doc_id, items.ids[i], s, a, b) for doc_id, own in zip(batch.column(0).to_pylist(), matched(items, batch.column(1).to_pylist(), least, exact), strict=True) for i, s, a, b in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = [own.mapInArrow(functools.partial(run, items), schema) for items in blocks(docs, benchmark, exact)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def kept(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, exact: bool = False) -> DataFrame:
    """The rows of docs, all columns, without the contaminated ones."""

    def run(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in grouped(batches, "text"):
            yield batch.filter(pa.array([not own for own in matched(items, batch.column("text").to_pylist(), least, exact)], pa.bool_()))

    for items in blocks(docs, benchmark, exact):
        docs = docs.mapInArrow(functools.partial(run, items), docs.schema)
    return docs


def op2_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
