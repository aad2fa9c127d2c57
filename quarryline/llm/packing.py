"""Hierarchical multi-length packing of token ids.

Every document is routed to the context-size tier of its length; whole long windows come first. Each
tier's windows are then filled: a document opens a window of its tier, the gap is closed by the longest
documents of the shorter tiers that fit, and what still is open is cut off a short document. Every window
is a power of two, so that full ones need no padding. Windows of like total size make up a step group.

Work is done per partition of the input, in groups of at most GROUP_TOKENS ids (plus one document): nothing
is shuffled, and no text or id list leaves its task. What is open at a group's end waits for the next one;
at a partition's end it is cut at powers of two.

Defined cases: a null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed once
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_path

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
#: Ids that are packed together, and ids of a step group.
GROUP_TOKENS = 2_000_000
STEP_TOKENS = 65_536

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows (size, [(document, start, length)]) of documents given by length; then the pieces left over, none if last."""
    return pack_pieces([(d, 0, n) for d, n in enumerate(lengths)], tiers, last)


def pack_pieces(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool) -> tuple[list, list]:
    top, windows = tiers[0], []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start), sorted

    def put(d: int, s: int, n: int) -> None:
        insort(pools[max(k for k, w in enumerate(tiers) if w >= n)], (n, d, s))

    for d, s, n in pieces:
        for k in range(n // top):
            windows.append((top, [(d, s + k * top, top)]))
        if n % top:
            put(d, s + n // top * top, n % top)
    left: list[tuple[int, int, int]] = []
    for k, window in enumerate(tiers):
        below = pools[k + 1 :] or pools[k:]  # the shortest tier fills its own windows
        while pools[k]:
            n, d, s = pools[k].pop()
            own, gap = [(d, s, n)], window - n
            while gap:
                fit = next((p for p in below if p and p[0][0] <= gap), None)
                if fit:
                    n, d, s = fit.pop(bisect_left(fit, (gap + 1,)) - 1)
                elif short := next((p for p in reversed(pools[k:]) if p), None):
                    n, d, s = short.pop(0)
                else:
                    break
                own.append((d, s, min(n, gap)))
                if n > gap:
                    put(d, s + gap, n - gap)
                gap -= min(n, gap)
            if gap:
                left += own
            else:
                windows.append((window, own))
    if last:
        total = sum(n for *_, n in left)
        for window in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
            own, gap = [], window
            while gap:
                d, s, n = left.pop(0)
                own.append((d, s, min(n, gap)))
                if n > gap:
                    left.insert(0, (d, s + gap, n - gap))
                gap -= min(n, gap)
            windows.append((window, own))
    return windows, left


def step_groups(sizes: list[int], step: int = STEP_TOKENS) -> list[int]:
    """The group of each window: the largest windows first, each to the group with the fewest tokens so far."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        groups[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return groups


def packed(docs: DataFrame, path: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces of all documents, with their ids: SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, base = encoder(path), TaskContext.get().partitionId() << 32
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        todo: list[tuple[int, int, int]] = []
        size = sequences = groups = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal doc_ids, ids, todo, size, sequences, groups
            windows, left = pack_pieces(todo, tiers, last)
            step, rows = step_groups([w for w, _ in windows]), []
            for (window, own), g in zip(windows, step, strict=True):
                at = 0
                for d, s, n in own:
                    rows.append((doc_ids[d], s, n, ids[d][s : s + n].tobytes(), len(ids[d]), base + sequences, at, window, base + groups + g))
                    at += n
                sequences += 1
            groups += max(step, default=-1) + 1
            keep = {d: i for i, d in enumerate(dict.fromkeys(d for d, *_ in left))}
            doc_ids, ids, todo, size = [doc_ids[d] for d in keep], [ids[d] for d in keep], [(keep[d], s, n) for d, s, n in left], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"])

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), encode.each(t.as_py() for t in batch.column(1)), strict=True):
                own = np.append(got, np.uint32(end_id)).astype("<u4")
                todo.append((len(ids), 0, len(own)))
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
                if size >= group_tokens:
                    yield flush(False)
        yield flush(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(documents(spark, sf_dir), tokenizer_path()))
