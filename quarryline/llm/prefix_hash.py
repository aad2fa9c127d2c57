"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo a prime, the polynomial of its first n code points for every n. Two entries give the
hash of any span, wherever it stands, so spans compare in a step and the longest common extension of two texts is found
by binary search. A document's fingerprint is its length, its whole hash modulo two primes, the SKETCH smallest hashes of its
spans of SPAN code points, and the hashes of its prefixes at lengths that grow by a quarter. Likeness of two fingerprints is the
share of spans (Jaccard) that the sample shows or, if larger, the share of the longer text that the longest common prefix covers,
found by binary search over those lengths.

Each document meets its next one, in ascending doc_id: documents are range-partitioned and sorted, a task carries a row to
the next, and only the first and last rows of each partition (two a task) are paired in a second, small step.

Defined cases: a null text is empty; null doc_ids come first, rows with one doc_id are ordered by text and keep a row each;
texts shorter than SPAN have their whole as their one span; two empty texts have likeness 1, an empty and another 0; a
single document is its own next one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Primes of the two hashes and their bases (fixed values: stored fingerprints depend on them).
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_337, 911_382_323)
SPAN = 16
SKETCH = 64
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"

_powers: list[np.ndarray] = [np.ones(1, np.int64), np.ones(1, np.int64)]


def powers(n: int, k: int) -> np.ndarray:
    """Base k's powers 0 to n - 1 at least, kept and doubled as needed."""
    while len(_powers[k]) < n:
        own = _powers[k]
        step = int(own[-1]) * BASES[k] % PRIMES[k]
        _powers[k] = np.concatenate([own, own * step % PRIMES[k]])
    return _powers[k]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Prefixes:
    """Prefix arrays of a text. Entry n of array k: sum of (c[i] + 1) * base**i for i < n, modulo prime k."""

    def __init__(self, codes: np.ndarray, arrays: tuple[int, ...] = (0, 1)):
        self.n = len(codes)
        self.sums = {k: np.concatenate([np.zeros(1, np.int64), np.cumsum((codes + 1) * powers(self.n, k)[: self.n] % PRIMES[k])]) for k in arrays}

    def spans(self, starts: np.ndarray, length: int, k: int = 0, top: int | None = None) -> np.ndarray:
        """Hashes of the spans, shifted to a common power (top), so that equal spans have equal hashes."""
        top = self.n if top is None else top
        part = (self.sums[k][starts + length] - self.sums[k][starts]) % PRIMES[k]
        return part * powers(top + 1, k)[top - starts] % PRIMES[k]

    def same(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        top = max(self.n, other.n)
        return all(self.spans(np.array([start]), length, k, top)[0] == other.spans(np.array([at]), length, k, top)[0] for k in self.sums)

    def common(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension of the two texts from these places on."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(start, other, at, mid) else (low, mid - 1)
        return low

    def sketch(self) -> np.ndarray:
        """The smallest mixed hashes of the spans, in order, each once."""
        if not self.n:
            return np.zeros(0, np.uint64)
        length = min(SPAN, self.n)
        starts = self.n - length + 1
        part = self.sums[0][length:] - self.sums[0][:starts]
        # times base**-start would need inverses: base**(TOP - start) with one TOP for all texts serves as well
        got = ((part % PRIMES[0]) * inverse_powers(starts)[:starts]) % PRIMES[0]
        mixed = got.astype(np.uint64) + np.uint64(length << 32)
        mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        few, k = mixed, SKETCH
        while len(few) > 4 * k:  # repeated spans count once
            some = np.unique(np.partition(mixed, 4 * k)[: 4 * k])
            if len(some) >= SKETCH or 4 * k >= len(mixed):
                return some[:SKETCH]
            k *= 4
        return np.unique(few)[:SKETCH]


_inverse: list[np.ndarray] = [np.ones(1, np.int64)]


def inverse_powers(n: int) -> np.ndarray:
    step = pow(BASES[0], -1, PRIMES[0])
    while len(_inverse[0]) < n:
        own = _inverse[0]
        _inverse[0] = np.concatenate([own, own * (int(own[-1]) * step % PRIMES[0]) % PRIMES[0]])
    return _inverse[0]


@functools.cache
def marks() -> np.ndarray:
    """Prefix lengths whose hashes are kept: 4, 5, 6, 7, 8, 10, 12, 15, ..."""
    out = [4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


def fingerprint(p: Prefixes, sketch: np.ndarray) -> str:
    """Hexadecimal digits of: length (8 bytes), whole hashes (4 each), size of the sketch (1), its hashes (4 each), prefix hashes (4 each)."""
    kept = marks()[: np.searchsorted(marks(), p.n, "right")]
    whole = np.array([p.sums[k][-1] % PRIMES[k] for k in (0, 1)])
    return (p.n.to_bytes(8) + b"".join((whole.astype(">u4").tobytes(), bytes([len(sketch)]), (sketch >> np.uint64(32)).astype(">u4").tobytes(), (p.sums[0][kept] % PRIMES[0]).astype(">u4").tobytes()))).hex()


def parts(print_: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, sketch and prefix hashes of a fingerprint."""
    data = bytes.fromhex(print_)
    stop = 17 + 4 * data[16]
    return int.from_bytes(data[:8]), np.frombuffer(data[17:stop], ">u4").astype(np.uint32), np.frombuffer(data[stop:], ">u4").astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    (m, x, p), (n, y, q) = parts(a), parts(b)
    both = np.unique(np.concatenate([x, y]))[:SKETCH]
    shared = float((np.isin(both, x) & np.isin(both, y)).sum() / len(both)) if len(both) else 0.0
    low, high = 0, min(len(p), len(q))
    while low < high:  # equal at one length means equal at all shorter ones
        mid = (low + high + 1) // 2
        low, high = (mid, high) if p[mid - 1] == q[mid - 1] else (low, mid - 1)
    return max(shared, int(marks()[low - 1]) / max(m, n) if low else 0.0)


class Item:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.codes = doc_id, text, code_points(text)
        self.prefixes = Prefixes(self.codes)
        self.print = fingerprint(self.prefixes, self.prefixes.sketch())

    def row(self, after: Item) -> tuple:
        n = len(self.codes)
        own, put = n - n // 4, after.text[: n // 4]
        edited = self.text[:own] + put
        p = Prefixes(np.concatenate([self.codes[:own], after.codes[: n // 4]]))
        edited_print = fingerprint(p, p.sketch())
        return self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), self.print, edited_print, likeness(self.print, edited_print), likeness(self.print, after.print), self.prefixes.common(0, p, 0), self.prefixes.common(0, after.prefixes, 0)


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """ROWS for each row of docs (doc_id, text) and its next one."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, edge = TaskContext.get().partitionId(), None, pa.array
        names = [*NAMES, "part", "edge", "edge_id", "edge_text"]

        def edges(item: Item, kind: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in TYPES), edge([part], pa.int32()), edge([kind]), edge([item.doc_id], pa.int64()), edge([item.text])], names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                item = Item(doc_id, text.as_py())
                if last is None:
                    yield edges(item, "first")
                else:
                    rows.append(last.row(item))
                last = item
            yield pa.RecordBatch.from_arrays([*table(rows), edge([part] * len(rows), pa.int32()), *(pa.nulls(len(rows), t) for t in (pa.string(), pa.int64(), pa.string()))], names)
        if last is not None:
            yield edges(last, "last")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, j, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays(table([Item(i, text).row(Item(j, after))]), NAMES)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(within, f"{ROWS}, part int, edge string, edge_id long, edge_text string")
    prints = ("fingerprint", "edited_fingerprint")
    found = written(found.withColumns({c: F.unhex(c) for c in prints}), "fingerprints").withColumns({c: F.lower(F.hex(c)) for c in prints})
    # parts that have rows, in order; the last one's next is the first one. A row per task.
    parts = found.where("edge = 'first'").select("part")
    order = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    last = found.where("edge = 'last'").select("part", F.col("edge_id").alias("i"), F.col("edge_text").alias("t"))
    first = found.where("edge = 'first'").select(F.col("part").alias("next"), F.col("edge_id").alias("j"), F.col("edge_text").alias("u"))
    pairs = last.join(following, "part").join(first, "next").select("i", "t", "j", "u")
    return found.where("edge IS NULL").select(*NAMES).unionByName(pairs.mapInArrow(across, ROWS))


def op9_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).select(*NAMES)
