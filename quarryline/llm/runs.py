"""Periodic runs of words, found in a grammar of the text, and texts without them.

A run is a stretch of words with smallest period q (words q apart are the same) and a length of at least max(LEAST_WORDS, LEAST_EXPONENT x q) that no neighbouring word extends keeping that period.

Documents are taken in shards of SHARD_WORDS words (a longer document is one by itself), in the order in which Spark reads them and without a shuffle; words are numbered, and documents end in numbers of their own.

1. Re-Pair replaces pairs of neighbouring symbols by nonterminals until no pair occurs twice. Passages that repeat, in a document or between copies, become one nonterminal.
2. A run that lies in a nonterminal's expansion and in none of its two sides crosses its boundary. Each nonterminal X -> AB that is long enough is looked at once, at one of its places. The symbols left
   over by Re-Pair are joined by a balanced tree per document, whose nodes have a boundary each as well. A run across a boundary reaches one and a half periods and half of the least length to one side of it, so the
   window of WINDOW words over the boundary occurs again one period away: candidates are the window's other places in the expansion, nearest first. A candidate is
   extended word by word in both directions, in growing steps. Where a run with period q has been found, candidates of 2q and more whose windows both lie in it, q words from its end at least, have a period that divides them and are passed over.
3. Runs are carried to all places where their nonterminal is derived, from the top down through nonterminals that hold runs.
4. What is found at a place may be the part of a longer run that a higher boundary shows: of intervals with one period only those that lie in no other remain.

Windows are compared by hash and candidates word by word, so nothing rests on hashes being different.

Defined cases: a null text has no words, and no runs; texts of any length count whole (about 120 bytes of memory a word while its shard is looked at); rows that share a doc_id and repeated rows keep a row
each; ties for the strongest run go to the smallest start, then period; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .repair_codec import compress
from .words import mixed, windows

LEAST_WORDS = 24
LEAST_EXPONENT = 3
#: The window at a boundary: the longest that occurs again within half of a run, for every period (WINDOW - 1 + q <= ceil(max(LEAST_WORDS, LEAST_EXPONENT x q) / 2)).
WINDOW = 5
SHARD_WORDS = 500_000
#: Pairs of words that are compared at once.
COMPARED = 2_000_000
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def matching(text: np.ndarray, x: np.ndarray, q: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many k from 0 on, below limit, have the same word at x + k * step and q further on."""
    out, width = np.zeros(len(x), np.int64), 16
    live = np.flatnonzero(limit > 0)
    while len(live):
        parts = []
        for k in range(0, len(live), max(1, COMPARED // width)):
            own = live[k : k + max(1, COMPARED // width)]
            place = out[own][:, None] + np.arange(width)
            inside = place < limit[own][:, None]
            at = np.where(inside, x[own][:, None] + place * step, 0)
            same = inside & (text[at] == text[np.where(inside, at + q[own][:, None], 0)])
            run = np.where(same.all(1), width, same.argmin(1))
            out[own] += run
            parts.append(own[(run == width) & (out[own] < limit[own])])
        live, width = np.concatenate(parts), min(2 * width, 65_536)
    return out


class Windows:
    """Places of equal windows: keys in the order of (window, place)."""

    def __init__(self, text: np.ndarray):
        hashes = windows(mixed(text.astype(np.uint64) + np.uint64(1)), WINDOW)
        order = np.argsort(hashes, kind="stable")
        new = np.r_[True, hashes[order][1:] != hashes[order][:-1]] if len(order) else np.zeros(0, bool)
        self.kind = np.zeros(len(hashes), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.span = len(text) + 1
        self.order, self.keys = order, self.kind[order] * self.span + order

    def nearest(self, kind: np.ndarray, place: np.ndarray, before: bool) -> np.ndarray:
        """The nearest place of a window of this kind at or beyond a place; -1 where there is none."""
        at = np.searchsorted(self.keys, kind * self.span + place, "right" if before else "left") - before
        inside = (at >= 0) & (at < len(self.keys))
        at = np.where(inside, at, 0)
        found = self.order[at] if len(self.order) else at
        return np.where(inside & (self.keys[at] // self.span == kind), found, -1) if len(self.keys) else np.full(len(kind), -1)


def crossing(text: np.ndarray, known: Windows, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number, start, end, period) of the runs of text[low:high] that cross middle, for many such stretches."""
    found: list[tuple[np.ndarray, ...]] = []
    for before in (False, True):
        own = middle - WINDOW + 1 if before else middle - 1
        number = np.flatnonzero((own >= low) & (own + WINDOW <= high) & (middle < high))
        own = own[number]
        kind = known.kind[own]
        beyond = own - 1 if before else own + 1
        start, end, period = (np.zeros(len(own), np.int64) for _ in range(3))  # the last run found
        while len(number):
            place = known.nearest(kind, beyond, before)
            q = own - place if before else place - own
            lo, hi, m = low[number], high[number], middle[number]
            go = (place >= 0) & (place >= lo) & (place + WINDOW <= hi) & (LEAST_EXPONENT * q <= hi - lo)
            number, own, kind, place, q, start, end, period, lo, hi, m = (v[go] for v in (number, own, kind, place, q, start, end, period, lo, hi, m))
            # within a run of period p, q >= 2p is passed over if the two periods overlap by p + q words on this side
            room = own + WINDOW - start if before else end - own
            skip = (period > 0) & (q >= 2 * period) & (room >= q + period)
            test = np.flatnonzero(~skip)
            x, period_here = np.minimum(own, place)[test], q[test]
            forward = matching(text, x, period_here, (hi[test] - period_here) - x, 1)
            back = matching(text, x - 1, period_here, x - lo[test], -1)
            first, last = x - back, x + forward + period_here
            good = (last - first >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period_here)) & (first < m[test]) & (last > m[test])
            hit = test[good]
            found.append((number[hit], first[good], last[good], period_here[good]))
            start[hit], end[hit], period[hit] = first[good], last[good], period_here[good]
            # what is passed over as a whole: places up to a period from the run's end
            jump = start + period - WINDOW - 1 if before else end - period + 1
            beyond = np.where(skip, np.minimum(place - 1, jump) if before else np.maximum(place + 1, jump), place - 1 if before else place + 1)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    number, start, end, period = (np.concatenate(f) for f in zip(*found, strict=True))
    # of one stretch found with several periods the smallest counts
    order = np.lexsort((period, end, start, number))
    number, start, end, period = number[order], start[order], end[order], period[order]
    new = np.r_[True, (np.diff(number) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)] if len(number) else np.zeros(0, bool)
    return number[new], start[new], end[new], period[new]


def tree_stretches(ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(low, middle, high) of the boundaries between symbols first .. last - 1 of each document, as nodes of a balanced tree. ends: where each symbol's words end."""
    n = last - first
    each = np.maximum(n - 1, 0)
    owner = np.repeat(np.arange(len(n)), each)
    k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + 1
    half = k & -k  # a boundary's node spans as many symbols on either side
    starts = np.r_[0, ends]
    return starts[first[owner] + k - half], starts[first[owner] + k], starts[first[owner] + np.minimum(k + half, n[owner])]


def grammar_runs(text: np.ndarray, base: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs. text: numbers below base of documents of the given lengths, each followed by a number that occurs once."""
    rules, sizes, symbols = compress(text, base, 1 << 32)
    rules = rules.astype(np.int64)
    size = np.r_[np.ones(base, np.int64), sizes]
    ends = np.cumsum(size[symbols])
    symbols = symbols.astype(np.int64)
    # the documents' symbols: up to their last number, which no rule takes in
    closing = np.searchsorted(ends, np.cumsum(lengths + 1))
    opening = np.r_[0, closing[:-1] + 1]
    low, middle, high = tree_stretches(ends, opening, closing)
    # rules that are long enough, each with one place of its expansion
    long = np.flatnonzero(sizes >= LEAST_WORDS)
    place = np.full(len(size), -1, np.int64)
    place[symbols] = ends - size[symbols]
    where, sized = place.tolist(), size.tolist()
    pairs = dict(zip(long.tolist(), rules[long].tolist(), strict=True))
    for k in reversed(pairs):
        a, b = pairs[k]
        where[a], where[b] = where[base + k], where[base + k] + sized[a]
    at = np.array([where[base + k] for k in pairs], np.int64)
    low = np.r_[at, low]
    middle = np.r_[at + size[rules[long, 0]], middle]
    high = np.r_[at + sizes[long], high]
    wide = np.flatnonzero(high - low >= LEAST_WORDS)
    number, start, end, period = crossing(text, Windows(text), low[wide], middle[wide], high[wide])
    number = wide[number]
    of_rule = number < len(long)
    found = [(start[~of_rule], end[~of_rule], period[~of_rule])]
    if of_rule.any():
        # runs of each symbol, relative to its first word, and symbols in whose derivation there are any
        owner = long[number[of_rule]] + base
        start, end, period = start[of_rule] - at[number[of_rule]], end[of_rule] - at[number[of_rule]], period[of_rule]
        count = np.bincount(owner, minlength=len(size))
        offset = np.cumsum(count) - count
        some = (count > 0).tolist()
        for k, (a, b) in pairs.items():
            some[base + k] = some[base + k] or some[a] or some[b]
        some = np.array(some)
        node, begin = symbols, ends - size[symbols]
        while True:
            node, begin = node[some[node]], begin[some[node]]
            if not len(node):
                break
            n = count[node]
            which = np.repeat(offset[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shift = np.repeat(begin, n)
            found.append((start[which] + shift, end[which] + shift, period[which]))
            left, right = rules[node - base].T
            node, begin = np.r_[left, right], np.r_[begin, begin + size[left]]
            inner = node >= base
            node, begin = node[inner], begin[inner]
    return whole_runs(*(np.concatenate(f) for f in zip(*found, strict=True)))


def whole_runs(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those that lie in no other of the same period, by start, then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    place = end + np.cumsum(np.r_[0, np.diff(period) != 0]) * (int(end.max()) + 1)
    new = np.r_[True, place[1:] > np.maximum.accumulate(place)[:-1]]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def shards(batches: Iterator[pa.RecordBatch], rearranged) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    ids: list[int | None] = []
    words: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = rearranged(doc_id, text.as_py().encode("utf-8", "surrogatepass").split())  # bytes split at ASCII white space alone
            ids.append(doc_id)
            words.append(own)
            size += len(own)
            if size >= SHARD_WORDS:
                yield ids, words
                ids, words, size = [], [], 0
    if ids:
        yield ids, words


def shard_runs(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, period) of all runs, by document, start and period, and where each document begins."""
    numbers, lengths = Numbers(), np.fromiter(map(len, words), np.int64, len(words))
    parts = [np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w)) for w in words]
    text = np.concatenate([x for k, own in enumerate(parts) for x in (own, np.array([len(numbers) + k], np.uint32))])
    begin = np.cumsum(lengths + 1) - lengths - 1
    start, end, period = grammar_runs(text, len(numbers) + len(words), lengths)
    document = np.searchsorted(begin, start, "right") - 1
    return document, start - begin[document], end - begin[document], period, lengths


def no_change(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten by its id gets a periodic tail, as the query's contract says; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:n] > 0


def each_shard(docs: DataFrame, schema: str, rearranged, made) -> DataFrame:
    """made(doc_ids, words, runs of each document as (start, end, period)) gives a shard's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in shards(batches, rearranged):
            document, start, end, period, lengths = shard_runs(words)
            cuts = np.searchsorted(document, np.arange(len(words) + 1))
            own = [(start[a:b], end[a:b], period[a:b]) for a, b in itertools.pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays(made(ids, words, own), [c.split()[0] for c in schema.split(", ")])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start (word number), length and period of every run."""

    def made(ids: list, words: list, own: list) -> list[pa.Array]:
        n = [len(s) for s, _, _ in own]
        start, end, period = (np.concatenate([x[i] for x in own]) for i in range(3))
        return [pa.array(list(itertools.chain.from_iterable(itertools.repeat(d, k) for d, k in zip(ids, n, strict=True))), pa.int64()), pa.array(start), pa.array(end - start), pa.array(period)]

    return each_shard(docs, "doc_id long, start long, length long, period long", no_change, made)


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id and its text with of each run only the first period kept, words joined by one space, and the number of words left out."""

    def made(ids: list, words: list, own: list) -> list[pa.Array]:
        gone = [dropped(len(w), *r) for w, r in zip(words, own, strict=True)]
        texts = [b" ".join(itertools.compress(w, (~g).tolist())).decode("utf-8", "surrogatepass") for w, g in zip(words, gone, strict=True)]
        return [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([int(g.sum()) for g in gone], pa.int64())]

    return each_shard(docs, "doc_id long, text string, n_dropped long", no_change, made)


def strongest(start: list[int], length: list[int], period: list[int]) -> int:
    """Place of the run with the greatest length / period, compared exactly; runs come by start, then period."""
    best = 0
    for k in range(1, len(start)):
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def digests(docs: DataFrame, rearranged=no_change) -> DataFrame:
    """DIGEST of every row."""

    def made(ids: list, words: list, own: list) -> list[pa.Array]:
        rows = []
        for doc_id, w, (start, end, period) in zip(ids, words, own, strict=True):
            s, n, q = start.tolist(), (end - start).tolist(), period.tolist()
            best: tuple = (None,) * 4
            if s:
                k = strongest(s, n, q)
                best = (s[k], n[k], q[k], 1000 * n[k] // q[k])
                w = list(itertools.compress(w, (~dropped(len(w), start, end, period)).tolist()))
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, q, strict=True))
            rows.append((doc_id, len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w)).hexdigest()))
        types = [pa.int64()] * 6 + [pa.string()] * 2
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]

    return each_shard(docs, DIGEST, rearranged, made)


def op11_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), periodic_tail)
