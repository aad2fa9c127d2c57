"""Token ids in files of Re-Pair grammars, with random access.

Documents are range-partitioned by doc_id; a partition is cut into shards of at least SHARD_IDS ids (its last
may be smaller), and each shard's ids are compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by new symbols
(nonterminals), again and again, until no pair occurs twice or all symbols of the alphabet are used. A round counts all pairs
exactly and takes those that come near the most frequent one (SHARE), the more frequent first where they overlap; a pair that
loses all but one of its places to others waits for a later round.

File format: Parquet, a row per shard in ascending order of (part, shard):
  part, shard, part_start (ids before the shard in its part), n_ids, base (first nonterminal),
  doc_ids, doc_lengths (arrays), rules (little-endian pairs of symbols), lengths (u4: ids that each rule expands to),
  symbols (the compressed sequence; symbols are u2 where base + rules fit, else u4: symbol_bytes).
`decode_span` expands only the symbols that overlap a span, found by the running sum of expansion lengths.

Defined cases: a null or empty text is its end id alone; null doc_ids come first, rows with one doc_id are ordered by
text and keep a row each; an empty table gives no shard and no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_table_path, tokenizer_path

END_ID = 1
SHARD_IDS = 1_000_000
#: Symbols are two bytes wide, so terminals and rules make up at most so many; a vocabulary that leaves fewer than LEAST_RULES takes four.
ALPHABET = 65_536
LEAST_RULES = 4_096
#: Slots in which a round looks up its pairs; of two that fall in one, the less frequent waits for the next round.
SLOT_BITS = 20
#: A round takes the pairs that are at least one in SHARE as frequent as the most frequent one.
SHARE = 4
SHARD_SCHEMA = "part int, shard int, part_start long, n_ids long, base int, doc_ids array<long>, doc_lengths array<long>, rules binary, lengths binary, symbols binary, symbol_bytes int"


def slots(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def every_other(places: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring places (same: a place's pair is also that of the one before) the first, third, ... one."""
    fresh, at = np.r_[True, ~(same & (np.diff(places) == 1))], np.arange(len(places))
    return (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0


def pair_counts(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, in order, and how often each can be replaced: of a run of one symbol's pairs every other counts."""
    same = keys[1:] == keys[:-1]
    if same.any():
        keys = keys[every_other(places, same)]
    own = np.sort(keys)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[first], np.diff(first, append=len(own))


def replaced_places(places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose pair is replaced, and its rank (0 the first): of overlapping ones the better rank, of a run of one rank every other."""
    while True:
        near = np.diff(places) == 1
        loses, wins = near & (rank[1:] > rank[:-1]), near & (rank[:-1] > rank[1:])  # to the one before; to the one after
        beaten = np.r_[False, loses] | np.r_[wins, False]
        if not beaten.any():
            break
        # those that nothing beats stay for sure, and what they beat goes
        stays = ~(np.r_[False, loses & ~beaten[:-1]] | np.r_[wins & ~beaten[1:], False])
        places, rank = places[stays], rank[stays]
    stays = every_other(places, np.ones(len(places) - 1, bool)) if len(places) else np.zeros(0, bool)
    return places[stays], rank[stays]


def compress(ids: np.ndarray, base: int, alphabet: int = ALPHABET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols): rules[k] is the pair of symbol base + k, lengths[k] the ids it expands to."""
    room = max(alphabet - base, LEAST_RULES)
    # a pair of symbols is one number, of 4 bytes where symbols have 2
    kind, bits = (np.uint32, 16) if base + room <= 65_536 else (np.uint64, 32)
    seq = ids.astype(kind)
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)
    most = len(ids)  # no pair occurs more often
    while len(lengths) < room and len(seq) > 1:
        keys = seq[:-1] << kind(bits) | seq[1:]
        at = slots(keys).astype(np.intp)
        bound = np.bincount(at, minlength=1 << SLOT_BITS).astype(np.int32)  # pairs of a slot together: at least a pair's count
        most = min(most, int(bound.max()))
        if most < 2:
            break
        least = max(2, most // SHARE)
        places = np.flatnonzero(bound.take(at) >= least)
        pairs, counts = pair_counts(keys[places], places)
        best = np.flatnonzero(counts >= least)
        if not len(best):
            most = least - 1
            continue
        best = best[np.argsort(-counts[best], kind="stable")][: room - len(lengths)]
        most, pairs = int(counts[best[0]]), pairs[best]
        # slots are written from the last to the first: the more frequent pair holds a slot
        rank, held, own = np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1 << SLOT_BITS, kind), slots(pairs)[::-1]
        rank[own], held[own] = np.arange(len(pairs))[::-1], pairs[::-1]
        at = at[places]
        found = np.where(held.take(at) == keys[places], rank.take(at), -1)
        places, found = places[found >= 0], found[found >= 0]
        hits, number = replaced_places(places, found)
        uses = np.bincount(number, minlength=len(pairs))
        if uses.max() < 2:  # all get in each other's way: the first alone
            hits, number = replaced_places(places[found == 0], found[found == 0])
            uses = np.bincount(number, minlength=len(pairs))
        hits, number = hits[uses[number] > 1], number[uses[number] > 1]
        seq[hits] = (np.cumsum(uses > 1) - 1 + base + len(lengths))[number].astype(kind)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        pairs = pairs[uses > 1]
        pairs = np.stack([pairs >> kind(bits), pairs & kind((1 << bits) - 1)], 1).astype(np.uint32)
        all_lengths = np.r_[np.ones(base, np.int64), lengths]
        rules.append(pairs)
        lengths = np.r_[lengths, all_lengths[pairs].sum(1)]
    return np.concatenate(rules), lengths, seq.astype(np.uint32)


class Grammar:
    """Decoder of one shard."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.base, self.symbols = base, symbols
        sizes = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)]
        self.offsets = np.cumsum(sizes) - sizes
        self.sizes, self.flat = sizes, np.empty(int(sizes.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        for k, (a, b) in enumerate(rules.tolist(), base):
            o, n, m = self.offsets[k], sizes[a], sizes[b]
            self.flat[o : o + n] = self.flat[self.offsets[a] : self.offsets[a] + n]
            self.flat[o + n : o + n + m] = self.flat[self.offsets[b] : self.offsets[b] + m]
        self.ends = np.cumsum(sizes[symbols])

    def decode_span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, [start, stop - 1], "right")
        own = self.symbols[i : j + 1]
        sizes = self.sizes[own]
        before = np.cumsum(sizes) - sizes
        out = self.flat[np.repeat(self.offsets[own] - before, sizes) + np.arange(int(sizes.sum()))]
        skip = start - (int(self.ends[i]) - int(self.sizes[own[0]]))
        return out[skip : skip + stop - start]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """A row per shard: SHARD_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        base = max(encode.tokenizer.get_vocab_size(), end_id + 1)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = shard = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, size, shard, before
            rules, lengths, symbols = compress(np.concatenate(ids), base)
            kind = "<u2" if base + len(rules) <= 65_536 else "<u4"
            row = [part, shard, before, size, base, doc_ids, [len(x) for x in ids], rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes(), int(kind[2])]
            shard, before = shard + 1, before + size
            doc_ids, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), encode.each(t.as_py() for t in batch.column(1)), strict=True):
                ids.append(np.append(got, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(ids[-1])
                if size >= shard_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    encoded(docs, tokenizer, end_id, shard_ids).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (u4 binary) of every document in the files at path.

    A part's start needs one number per part: as many rows as tasks wrote, so they may be broadcast.
    """
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                kind = f"<u{row['symbol_bytes']}"
                grammar = Grammar(row["base"], np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["symbols"], kind))
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                ids = [grammar.decode_span(a, b).astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"] + row["part_start"]), pa.array(row["doc_lengths"], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return shards.join(F.broadcast(starts), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "token-shards")
    write(documents(spark, sf_dir), path, tokenizer_path())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
