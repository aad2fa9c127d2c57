"""Exact repeats of word windows, found from fixed-block anchors, and their removal.

A window is WINDOW consecutive words; a word goes if some window over it also starts earlier (smaller doc_id, or earlier in the
same document). Every window holds a whole block of ANCHOR = WINDOW / 2 words that starts at a multiple of ANCHOR.

1. Index and probes: the non-overlapping blocks of every document are the index, every rolling run of ANCHOR words is a probe. They are
   dealt by hash; a hash that is a block's and occurs at two places is a hit, and its places go back to their documents.
2. Extension: only windows over a hit can have a copy. Their full hashes (96 bits of two independent polynomials) are dealt by hash; all places but the
   first of each hash repeat an earlier one, and runs of such places are the maximal exact repeats.
3. Removal: documents drop the words under repeats.

A task of steps 1 and 2 settles what it sees itself: of a hash that occurs often in its chunk of documents only one place is sent,
so a passage in a third of all rows is no larger a group than one entry per chunk. Entries travel packed, a row per (chunk, bucket). The
number of buckets grows with the text (BUCKET_CHARS characters each), so that a bucket fits a task; answers go to
documents by both keys, so that copies of one text are spread over the buckets. No pairs are made.

Defined cases: a null or empty text has no words; a null doc_id is smaller than all others; rows that share a doc_id are told apart by a hash of their
text and ordered by it; exactly repeated rows are one document, each with its result; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .words import mixed, windows, word_hashes

WINDOW = 20
#: Words of a document chunk that a task settles itself, and characters per bucket.
CHUNK_WORDS = 1_000_000
BUCKET_CHARS = 20_000_000
LEAST_LONG = -(2**63)
PACKED = "bucket int, kind int, k1 binary, k2 binary, n binary, places binary, hashes binary"
FOUND = "k1 long, k2 long, places binary"
KEYS = ("k1", "k2")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def planes(values: np.ndarray) -> bytes:
    """Byte planes of u4 numbers: small numbers leave planes of zeros, which compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunks(batches: Iterator[pa.RecordBatch], words_at: int, window: int) -> Iterator[list[tuple]]:
    """Lists of (other columns ..., word hashes) of documents with a window at least."""
    rows, size, hashes = [], 0, word_hashes()
    for batch in batches:
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != words_at]
        for i, text in enumerate(batch.column(words_at)):
            words = text.as_py().encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
            if len(words) >= window:
                rows.append((*(c[i] for c in others), hashes.array(words)))
                size += len(words)
            if size >= CHUNK_WORDS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def packed(kind: int, buckets: np.ndarray, owner: np.ndarray, place: np.ndarray, hashes: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> Iterator[tuple]:
    """A row per bucket: the documents that have entries there, their numbers of entries, places (differences) and hashes."""
    order = np.lexsort((place, owner, buckets))
    buckets, owner, place, hashes = buckets[order], owner[order], place[order], hashes[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(buckets)], strict=True):
        if a < b:
            docs, n = np.unique(owner[a:b], return_counts=True)
            yield int(buckets[a]), kind, k1[docs].astype("<i8").tobytes(), k2[docs].astype("<i8").tobytes(), planes(n), planes(np.diff(place[a:b], prepend=0) & 0xFFFFFFFF), hashes[a:b].tobytes()


def sent(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in PACKED.split(", ")])


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    n = from_planes(row["n"])
    k1, k2 = (np.repeat(np.frombuffer(row[k], "<i8"), n) for k in KEYS)
    return k1, k2, np.cumsum(from_planes(row["places"]), dtype=np.uint32).astype(np.int64), np.frombuffer(row["hashes"], np.uint8)


def dealt_by(k1: np.ndarray, k2: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document: by both keys, so that copies of one text are spread."""
    return (mixed(mixed(k1.view(np.uint64)) + k2.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def to_documents(k1: np.ndarray, k2: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Packed rows of places, dealt by document."""
    order = np.lexsort((place, k2, k1))
    k1, k2, place = k1[order], k2[order], place[order]
    new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] if len(k1) else np.zeros(0, bool)
    owner = np.cumsum(new) - 1
    k1, k2 = k1[new], k2[new]
    return packed(DONE, dealt_by(k1, k2, buckets)[owner], owner, place, np.zeros((len(place), 0), np.uint8), k1, k2)


#: Kinds of packed rows: entries that want an answer, entries that are only to be known, answers that a chunk found itself.
ASK, KNOW, DONE = 0, 1, 2


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of a bucket at a time; they come sorted by it."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["bucket"] != row["bucket"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def judged(batches: Iterator[pa.RecordBatch], judge, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places that have an answer, packed by document. judge(hashes, kinds, k1, k2, places): which entries of a bucket do."""
    for rows in by_bucket(batches):
        parts = [(np.full(len(u[0]), r["kind"], np.int8), *u) for r in rows for u in (unpacked(r),)]
        kinds, k1, k2, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
        yes = kinds == DONE
        if not yes.all():
            yes[~yes] = judge(np.concatenate([p[4] for p in parts]), kinds[~yes], k1[~yes], k2[~yes], place[~yes])
        yield sent([*to_documents(k1[yes], k2[yes], place[yes], buckets)])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, with all its places."""
    for rows in by_bucket(batches):
        k1, k2, place = (np.concatenate(x) for x in zip(*(unpacked(r)[:3] for r in rows), strict=True))
        order = np.lexsort((place, k2, k1))
        k1, k2, place = k1[order], k2[order], place[order].astype("<u4")
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        ends = np.r_[starts[1:], len(k1)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array([place[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["k1", "k2", "places"])


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")


def anchors(keyed_docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """PACKED by document: places of runs of window / 2 words that are a block somewhere and occur at two places."""
    anchor = window // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, 2, window):
            k1, k2 = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            per = [windows(r[2], anchor) for r in rows]
            h, n = np.concatenate(per), [len(p) for p in per]
            owner, place = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(x) for x in n])
            is_block = place % anchor == 0
            order = np.argsort(h, kind="stable")
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(new) - 1
            hit = ((np.bincount(group) > 1) & (np.bincount(group, is_block) > 0))[group]
            one = np.zeros(len(h), bool)
            one[order[new]] = True
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            # an entry: 31 bits of the hash, and whether it is a block; a chance meeting only makes more windows to compare
            entry = ((h & np.uint64(0x7FFFFFFF)) << np.uint64(1)).astype("<u4")
            out = [*packed(ASK, bucket[~hit], owner[~hit], place[~hit], entry[~hit] | is_block[~hit], k1, k2)]
            out += packed(KNOW, bucket[hit & one], owner[hit & one], place[hit & one], entry[hit & one] | np.uint32(1), k1, k2)
            out += packed(DONE, dealt_by(k1, k2, buckets)[owner[hit]], owner[hit], place[hit], np.zeros((int(hit.sum()), 0), np.uint8), k1, k2)
            yield sent(out)

    def judge(raw: np.ndarray, kinds: np.ndarray, *_) -> np.ndarray:
        entry = raw.view("<u4")
        h, block = entry >> 1, entry & 1
        order = np.argsort(h, kind="stable")
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(np.r_[True, h[order][1:] != h[order][:-1]]) - 1
        # a chunk that only makes known has hits of its own: its entry counts as two
        return ((np.bincount(group, 1 + (kinds == KNOW)) > 1) & (np.bincount(group, block) > 0))[group] & (kinds == ASK)

    return dealt(keyed_docs.select("k1", "k2", "text").mapInArrow(send, PACKED), buckets).mapInArrow(lambda b: judged(b, judge, buckets), PACKED)


def places_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def repeats(hit_docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """PACKED by document: starts of windows that also start earlier. hit_docs: k1, k2, text, hits (u4 places)."""
    anchor = window // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, 2, window):
            k1, k2 = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            owners, places, firsts, seconds = [], [], [], []
            for d, (_, _, hits, words) in enumerate(rows):
                n = len(words) - window + 1
                # windows that start at most window - anchor words before a hit
                marks = np.zeros(n + window + 1, np.int64)
                at = np.unique(places_of(hits))
                np.add.at(marks, np.maximum(0, at - (window - anchor)), 1)
                np.add.at(marks, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks)[:n] > 0)
                owners.append(np.full(len(starts), d))
                places.append(starts)
                firsts.append(windows(words, window)[starts])
                seconds.append(windows(mixed(words ^ np.uint64(0xA5A5A5A55A5A5A5A)), window)[starts])
            owner, place, h, g = (np.concatenate(x) for x in (owners, places, firsts, seconds))
            order = np.lexsort((place, k2[owner], k1[owner], g, h))
            owner, place, h, g = owner[order], place[order], h[order], g[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = ~new & ((k1[owner] != k1[owner[first]]) | (k2[owner] != k2[owner[first]]) | (place != place[first]))
            entry = np.empty((int(new.sum()), 3), "<u4")
            entry[:, 0], entry[:, 1], entry[:, 2] = h[new] & np.uint64(0xFFFFFFFF), h[new] >> np.uint64(32), g[new] & np.uint64(0xFFFFFFFF)
            bucket = ((g[new] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            out = [*packed(ASK, bucket, owner[new], place[new], entry, k1, k2)]
            out += packed(DONE, dealt_by(k1, k2, buckets)[owner[again]], owner[again], place[again], np.zeros((int(again.sum()), 0), np.uint8), k1, k2)
            yield sent(out)

    def judge(raw: np.ndarray, _, k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> np.ndarray:
        entry = raw.view("<u4").reshape(-1, 3)
        order = np.lexsort((place, k2, k1, entry[:, 2], entry[:, 1], entry[:, 0]))
        e, a, b, p = entry[order], k1[order], k2[order], place[order]
        new = np.r_[True, (e[1:] != e[:-1]).any(1)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
        yes = np.empty(len(e), bool)
        yes[order] = (a != a[first]) | (b != b[first]) | (p != p[first])
        return yes

    return dealt(hit_docs.select("k1", "k2", "text", "hits").mapInArrow(send, PACKED), buckets).mapInArrow(lambda b: judged(b, judge, buckets), PACKED)


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word spans under the windows at these starts."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(s[0]), int(s[-1]) + window) for s in np.split(starts, cuts)]


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text's kept words, joined by a space), spans (removed words from, to)."""
    own = keyed(docs)
    spark = own.sparkSession
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))

    def by_document(places: DataFrame, name: str) -> DataFrame:
        return dealt(places, buckets).mapInArrow(merged, FOUND).withColumnRenamed("places", name)

    hits = written(anchors(own, buckets, window), "anchors")
    hit_docs = own.select("k1", "k2", "text").join(by_document(hits, "hits"), [*KEYS])
    again = written(repeats(hit_docs, buckets, window), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, starts in zip(*batch.columns, strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                gone = spans(places_of(starts.as_py()), window) if starts.is_valid else []
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((doc_id.as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), [x for s in gone for x in s]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return own.join(by_document(again, "starts"), [*KEYS], "left").select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, spans array<long>")


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
