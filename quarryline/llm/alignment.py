"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids overlap in a corpus.

Both tokenizers read a space and the text; A is byte-level BPE, B a piece model (its spaces U+2581, its byte pieces single bytes). The byte offsets at which tokens of A and of B both end cut them into
groups. They are found by galloping intersection: the shorter of the two lists of ends drives, each of its ends is sought in the longer one by steps of doubling size from the last place on and then by
binary search within the last step. Here many pairs of lists go through it in lockstep, the k-th ends of all at a time. Common indices slice the groups; the ranks of a token's two ends among
the other tokenizer's ends give the range of tokens that it overlaps.

1. A text is cut before spaces and line feeds where both tokenizers end a token whatever stands around (`pieces.units`); such a unit is encoded, intersected and linked once by a worker and looked up afterwards.
   Documents' groups are those of their units, one after the other. A block of documents (BLOCK_CHARS characters) is written as one row: its documents' digests and units, the units' links, the
   different id pairs and how often each is linked in the block.
2. Pairs are added up over the corpus, from one row per block and pair: a pair that occurs in every document has no more rows than there are blocks. Each B id has a highest count.
3. A block's pairs meet their corpus-wide counts by a join, come back to their block (never more than its different pairs), and are summed by unit and by document, one block at a time.

Nothing is broadcast or collected; blocks are written before their pairs are counted, so that a lost task is made anew with the same numbers.

Defined cases: a null or empty text has no tokens, nor has one that holds U+2581 (B's bytes then differ): its numbers are 0 and its groups the empty string. Special tokens' strings are plain text.
A very long text makes a block of its own. Ties for a B id's highest count all count as best; repeated rows and rows that share a doc_id, also a null one, keep a row each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_path, written
from .pieces import GROUP_CHARS, PIECES, SPACE, KeptUnits, grouped, piece_encoder, rows, units, whole_unit, whole_units
from .tokens import byte_letters, gathered

BYTES = "byte_bpe_50k.json"
#: Links of units that a worker keeps.
KEPT_UNITS = 600_000
#: Units that A encodes as one text.
JOINED = 20_000
#: Characters of a block: those of a group of texts.
BLOCK_CHARS = GROUP_CHARS
#: Blocks of a file: a block is some megabytes, and Spark's reader holds up to 4,096 rows of a file at once.
BLOCKS_A_FILE = 4
BLOCK_SCHEMA = "block long, doc_ids array<long>, sums binary, shas binary, doc_units binary, unit_of binary, unit_links binary, link_of binary, pairs array<long>, counts array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def common_ends(x: np.ndarray, x_counts: np.ndarray, y: np.ndarray, y_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y of the ends that both have, list by list. x, y: rising ends of many lists, one list after the other."""
    swap = x_counts > y_counts  # the shorter list drives
    x_starts, y_starts = np.cumsum(x_counts) - x_counts, np.cumsum(y_counts) - y_counts
    ends = np.concatenate([x, y])
    drive = np.where(swap, len(x) + y_starts, x_starts)
    n = np.where(swap, y_counts, x_counts)
    at = np.where(swap, x_starts, len(x) + y_starts)  # where the longer list is searched from
    stop = at + np.where(swap, x_counts, y_counts)
    order = np.argsort(-n, kind="stable")  # lists that are done lie behind
    drive, n, at, stop, swap = drive[order], n[order], at[order], stop[order], swap[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -k, "left"))
        want, own, end = ends[drive[:live] + k], at[:live], stop[:live]
        low, high, step = own.copy(), own.copy(), np.ones(live, np.int64)
        go = np.flatnonzero((high < end) & (ends[np.minimum(high, end - 1)] < want))
        while len(go):  # exponential: low is always before the sought place
            low[go] = high[go] + 1
            high[go] = np.minimum(high[go] + step[go], end[go])
            step[go] *= 2
            go = go[(high[go] < end[go]) & (ends[np.minimum(high[go], end[go] - 1)] < want[go])]
        go = np.flatnonzero(low < high)
        while len(go):  # binary, between the last two steps
            middle = (low[go] + high[go]) // 2
            less = ends[middle] < want[go]
            low[go] = np.where(less, middle + 1, low[go])
            high[go] = np.where(less, high[go], middle)
            go = go[low[go] < high[go]]
        at[:live] = low
        hit = np.flatnonzero((low < end) & (ends[np.minimum(low, end - 1)] == want))
        one, other = drive[hit] + k, low[hit]
        found.append((np.where(swap[hit], other, one), np.where(swap[hit], one, other) - len(x)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(f) for f in zip(*found, strict=True))
    by_place = np.argsort(i)
    return i[by_place], j[by_place]


class Aligned:
    """Of many strings, one after the other: numbers of A and B tokens, their ids, and common places (the last token of each group, in A and in B). bad: strings whose bytes A or B don't give back."""

    def __init__(self, aligner: Aligner, own: list[str]):
        self.a_counts, self.a = aligner.of_a(own)
        self.b_counts, self.b = aligner.of_b(own)
        sizes = np.fromiter((len(u.encode()) for u in own), np.int64, len(own))
        totals = [np.diff(np.r_[0, np.cumsum(length[ids])][np.r_[0, np.cumsum(counts)]]) for length, ids, counts in ((aligner.a_bytes, self.a, self.a_counts), (aligner.b_bytes, self.b, self.b_counts))]
        self.bad = (totals[0] != sizes) | (totals[1] != sizes) | np.fromiter((SPACE in u for u in own), bool, len(own))
        self.a, self.b = self.a[np.repeat(~self.bad, self.a_counts)], self.b[np.repeat(~self.bad, self.b_counts)]
        self.a_counts, self.b_counts = np.where(self.bad, 0, self.a_counts), np.where(self.bad, 0, self.b_counts)
        self.a_ends, self.b_ends = np.cumsum(aligner.a_bytes[self.a]), np.cumsum(aligner.b_bytes[self.b])
        self.a_last, self.b_last = common_ends(self.a_ends, self.a_counts, self.b_ends, self.b_counts)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens of every link: an A token overlaps those from the rank of its start to that of its last byte."""
        starts = np.r_[0, self.a_ends[:-1]] if len(self.a_ends) else self.a_ends
        first, last = np.searchsorted(self.b_ends, starts, "right"), np.searchsorted(self.b_ends, self.a_ends, "left")
        n = last - first + 1
        return np.repeat(np.arange(len(n)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def strings(self, words: TokenWords) -> list[str]:
        """`a1,a2|b1;a3|b2` of each string: the tokens' words, in the order of groups, those of A first, joined at once."""
        n, m = len(self.a), len(self.b)
        a_ends, b_ends = np.zeros(n, bool), np.zeros(m, np.int64)
        a_ends[self.a_last], b_ends[self.b_last] = True, 1
        b_ends[(np.cumsum(self.b_counts) - 1)[self.b_counts > 0]] = 2
        group = np.concatenate([np.cumsum(a_ends) - a_ends, np.cumsum(b_ends > 0) - (b_ends > 0)])
        which = np.concatenate([words.a + self.a * 2 + a_ends, words.b + self.b * 3 + b_ends])[np.argsort(group, kind="stable")]
        got = iter("".join(map(words.texts.__getitem__, which.tolist())).split("\n"))
        return [next(got) if k else "" for k in self.b_counts.tolist()]


class TokenWords:
    """Ids as decimal text with what follows them: a comma within a group, a bar after its last A token, a semicolon after its last B token, a line feed after a string's last one."""

    def __init__(self, n_a: int, n_b: int):
        self.texts = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;\n"]
        self.a, self.b = 0, 2 * n_a


class Aligner:
    """Both tokenizers, and units whose alignment is known."""

    def __init__(self, a: str, b: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.encoder = Tokenizer.from_file(a), piece_encoder(b)
        self.tokenizer.encode_special_tokens = True
        tokens, letters = self.tokenizer.get_vocab(), set(byte_letters().values())
        self.a_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in tokens.items():
            self.a_bytes[i] = len(token) if letters.issuperset(token) else len(token.encode())
        table = self.encoder.table
        self.b_bytes = np.array([len(p.replace(SPACE, " ").encode()) for p in table.pieces])
        self.b_bytes[list(table.bytes.values())] = 1
        #: An id pair is one number of 4 bytes.
        self.shift = int(table.size - 1).bit_length()
        if (self.tokenizer.get_vocab_size() - 1).bit_length() + self.shift > 32:
            raise ValueError("the two vocabularies are too large for pairs of 4 bytes")
        self.words = TokenWords(self.tokenizer.get_vocab_size(), table.size)
        self.kept = AlignedUnits(self)

    def of_a(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of strings. Those that are cut openly are encoded as one text: a token ends wherever one of them does."""
        plain = np.fromiter(map(bool, map(whole_unit(), own)), bool, len(own))
        joined = [u for u, good in zip(own, plain.tolist(), strict=True) if good]
        ids = [np.array(self.tokenizer.encode_batch_fast(["".join(joined[k : k + JOINED])], add_special_tokens=False)[0].ids, np.int64) for k in range(0, len(joined), JOINED)]
        ids = np.concatenate([np.zeros(0, np.int64), *ids])
        ends = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in joined), np.int64, len(joined)))
        last = np.searchsorted(np.cumsum(self.a_bytes[ids]), ends) + 1
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([u for u, good in zip(own, plain.tolist(), strict=True) if not good], add_special_tokens=False)]
        counts, starts = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        counts[plain], counts[~plain] = np.diff(last, prepend=0), list(map(len, rest))
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return counts, gathered(np.concatenate([ids, *[np.array(x, np.int64) for x in rest]]), starts, counts)

    def of_b(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = self.encoder.of_whole(own)
        return counts, ids.astype(np.int64)


class AlignedUnits(KeptUnits):
    """Of each unit the id pairs that it links (as the runs of the flat array), numbers of A and B tokens and groups, whether its bytes differ, and its groups as text."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        super().__init__(KEPT_UNITS)

    def clear(self) -> None:
        super().clear()
        self.sums, self.strings = np.zeros((0, 4), np.int64), []

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = Aligned(self.aligner, whole_units(new.to_pylist()))
        owner = np.repeat(np.arange(len(new)), own.a_counts)
        i, j = own.links()
        groups = np.bincount(owner[own.a_last], minlength=len(new))
        self.strings += own.strings(self.aligner.words)
        self.sums = np.concatenate([self.sums, np.stack([own.a_counts, own.b_counts, groups, own.bad], 1)])
        return np.bincount(owner[i], minlength=len(new)), (own.a[i] << self.aligner.shift | own.b[j]).astype(np.uint32)


@functools.cache
def aligner(a: str, b: str) -> Aligner:
    """One for each worker and pair of files."""
    return Aligner(a, b)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of values (rows of them)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def planes(values: np.ndarray) -> bytes:
    """Byte planes of u4 numbers: small numbers leave planes of zeros, which compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per block of documents: BLOCK_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, k = aligner(a, b), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []

        def texts() -> Iterator[str]:
            for batch in batches:
                ids.extend(batch.column(0).to_pylist())
                for text in batch.column(1):
                    yield text.as_py()

        for group in grouped(texts()):
            doc_ids, ids[:] = ids[: len(group)], ids[len(group) :]
            yield block(own, part << 32 | k, doc_ids, group)
            k += 1

    return rows(docs).mapInArrow(run, BLOCK_SCHEMA)


def block(own: Aligner, number: int, doc_ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    cut, offsets = units(texts)
    kept, numbers, counts = own.kept, own.kept.numbers(cut, own.kept.learn), np.diff(offsets)
    sums = sums_of(kept.sums[numbers], counts)
    links = sums_of(kept.lengths[numbers], counts)
    ok = (sums[:, 3] == 0) & np.fromiter(map(bool, texts), bool, len(texts))
    sums = np.where(ok[:, None], np.stack([sums[:, 0], sums[:, 1], sums[:, 2], links], 1), 0)
    strings = kept.strings
    shas = [hashlib.sha256(";".join(map(strings.__getitem__, numbers[x:y].tolist())).encode()).digest() if good else bytes(32) for good, x, y in zip(ok.tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False)]
    # only documents with tokens count
    counts, numbers = np.where(ok, counts, 0), numbers[np.repeat(ok, counts)]
    different, unit_of, times = np.unique(numbers, return_inverse=True, return_counts=True)
    sizes = kept.lengths[different]
    pairs, link_of = np.unique(gathered(kept.flat, kept.starts[different], sizes), return_inverse=True)
    linked = np.bincount(link_of, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
    row = [number, doc_ids, sums.astype("<i8").tobytes(), b"".join(shas), planes(counts), planes(unit_of), planes(sizes), planes(link_of), pairs.astype(np.int64), linked]
    types = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, *[pa.list_(pa.int64())] * 2)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def pair_counts(made: DataFrame, shift: int) -> DataFrame:
    """pair, count (links in all blocks), best (whether its B id has no higher count)."""
    each = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << shift) - 1))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def scored(docs: DataFrame, a: str, b: str) -> DataFrame:
    """DIGEST of every row."""
    made = written(blocks(docs, a, b), "alignments", BLOCKS_A_FILE)
    counts = pair_counts(made, aligner(a, b).shift)
    answers = made.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(counts, "pair").select("of", "place", "count", "best")

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        """Of a block and its pairs' answers."""
        row = {c: own.column(c)[0] for c in ("doc_ids", "sums", "shas", "doc_units", "unit_of", "unit_links", "link_of")}
        place, count, is_best = (answers.column(c).to_numpy() for c in ("place", "count", "best"))
        counted, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        counted[place], best[place] = count, is_best
        link = from_planes(row["link_of"].as_py())
        by_unit = sums_of(np.stack([best[link], counted[link]], 1), from_planes(row["unit_links"].as_py()))
        by_doc = sums_of(by_unit[from_planes(row["unit_of"].as_py())], from_planes(row["doc_units"].as_py()))
        sums, shas = np.frombuffer(row["sums"].as_py(), "<i8").reshape(-1, 4), row["shas"].as_py().hex()
        texts = ["" if s == "0" * 64 else s for s in (shas[k : k + 64] for k in range(0, len(shas), 64))]
        return pa.Table.from_arrays([pa.array(row["doc_ids"].as_py(), pa.int64()), *[pa.array(x) for x in (*sums.T, *by_doc.T)], pa.array(texts, pa.string())], [c.split()[0] for c in DIGEST.split(", ")])

    # a group at a time goes to Python, where batches of a join's rows would hold all blocks of a task
    return made.drop("pairs", "counts").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, DIGEST)


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, ids of A and of B, and how many of either lie in or before each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64)
                texts = some.column(1).to_pylist()
                got = Aligned(own, [" " + t for t in texts])
                empty = np.fromiter((not t for t in texts), bool, len(texts))
                first = [np.cumsum(n) - n for n in (got.a_counts, got.b_counts)]
                owner = np.repeat(np.arange(len(texts)), got.a_counts)[got.a_last]
                n_groups = np.bincount(owner, minlength=len(texts))
                columns = []
                for values, n in ((got.a, got.a_counts), (got.b, got.b_counts), (got.a_last + 1 - first[0][owner], n_groups), (got.b_last + 1 - first[1][owner], n_groups)):
                    ends = np.cumsum(n)
                    columns.append(pa.array([[] if e else values[y - m : y] for e, y, m in zip(empty, ends, n, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "a", "b", "a_cuts", "b_cuts"])

    return rows(docs).mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>")


def op12_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), tokenizer_path(BYTES), tokenizer_path(PIECES))
