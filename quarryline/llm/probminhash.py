"""Near-duplicate classes by ProbMinHash, banding and verification.

A document's shingles are its runs of SHINGLE words (lower case, split at white space), weighted in two ways: by how often they occur, and by 1. The
similarity of two documents is the larger of the two probability Jaccard similarities, that of their counts and that of their sets (with weights of 1 it is
the sets' Jaccard similarity). Sketch, digest and verification all take these two.

Sketch: each shingle is a Poisson process whose rate is its weight; every arrival falls on one of the REGISTERS, and a register keeps its earliest
shingle. Arrivals are made in rounds, and a shingle whose last arrival is later than all registers' makes no more (early termination).
Two documents agree in a register with the probability Jaccard similarity of their weights. Without a repeated shingle both sketches are one, and are made once.

1. Documents with the same shingles and counts are one node (its smallest doc_id): copies are collapsed before anything is paired.
2. Nodes with too few shingles that any other candidate has are out, exactly. Bands of registers give bucket keys, those of sets with the size class of the
   set: sets of which one is at least LEAST of the other meet in one of two size classes, so that documents that only share a passage seldom meet. A bucket's
   members are paired with its most central node (that with the smallest share of shingles of its own), not with each other: one pair per member, by a partial
   aggregation and a join, so that a hot bucket is split over tasks.
3. Pairs are verified on the whole shingle sets and counts (similarity of at least LEAST), and verified pairs are joined to components.
4. Only buckets whose members are still in different components go on: 64, 4096, ... members, those of a bucket's largest component first, meet its members of
   other components, and are done with. Most of the others join at once; the rest goes on until every pair of different components has been verified, so no link
   between them is missed for want of a pair. Pairs that cannot be alike, for their shares of own shingles or for the parities of their sets (odd sketches:
   sets differ in at least as many shingles as their sketches in bits), are never made.

Loops end when nothing is open; their state is written to the shared folder each time, and what is done with is removed.

Defined cases: rows with a null doc_id or a text without words are in no class but their own (class_id is the doc_id); a text of 1 to 4 words
is one shingle; a very long text counts whole; of rows that share a doc_id one text (that with the smallest
hash) is compared with others, and all are in its class; ties in nothing, as classes don't depend on order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, written
from .words import mixed, windows, word_hashes

SHINGLE = 5
LEAST = 0.8
BANDS = 26
ROWS = 5
REGISTERS = BANDS * ROWS
#: In place of a size class: bands of counts.
COUNTS = -1
#: Arrivals of a document, as a multiple of its rate, by which all registers are filled but for one case in e**6.
ENOUGH = REGISTERS * (np.log(REGISTERS) + 6)


def shingles(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    return windows(word_hashes().array(words), min(SHINGLE, len(words))) if words else np.zeros(0, np.uint64)


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit ones."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(items: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shingle in each register. items: different 64-bit hashes, at least one."""
    first = np.full(REGISTERS, np.inf)
    held = np.zeros(REGISTERS, np.uint64)
    bound = ENOUGH / weights.sum()
    own, rate, last, done = items, weights.astype(np.float64), np.zeros(len(items)), 0
    while len(own):
        rounds = int(min(256, max(1, np.ceil(ENOUGH / len(own)))))
        seeds = mixed(own[:, None] + np.arange(done + 1, done + rounds + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        times = last[:, None] + np.cumsum(-np.log(unit(seeds)) / rate[:, None], 1)
        open_until = first.max()
        near = times <= min(open_until, bound)
        if not near.any() and open_until == np.inf:
            near = times <= np.inf
        when = times[near]
        order = np.argsort(-when, kind="stable")
        slot = (mixed(seeds[near] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(REGISTERS)).astype(np.intp)[order]
        who = np.broadcast_to(own[:, None], times.shape)[near][order]
        earliest, by = np.full(REGISTERS, np.inf), np.zeros(REGISTERS, np.uint64)
        earliest[slot] = when[order]  # the last written is the earliest
        by[slot] = who
        better = earliest < first
        first[better], held[better] = earliest[better], by[better]
        if first.max() == np.inf and bound < np.inf:  # a register is empty within the bound: take all arrivals from here on
            bound, first, held = np.inf, np.full(REGISTERS, np.inf), np.zeros(REGISTERS, np.uint64)
            own, rate, last, done = items, weights.astype(np.float64), np.zeros(len(items)), 0
            continue
        go = times[:, -1] < first.max()
        own, rate, last, done = own[go], rate[go], times[go, -1], done + rounds
    return held


def band_keys(held: np.ndarray) -> np.ndarray:
    rows = held.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of its text, digest of shingles and counts (null without words), n different shingles, bands of the set, bands of the counts (null if all are 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, counts, bands, heavy = [], [], [], []
            for text in batch.column(1):
                items, weights = np.unique(shingles(text.as_py()), return_counts=True)
                counts.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes() + weights.tobytes()) if len(items) else None)
                bands.append(band_keys(signature(items, np.ones_like(weights))) if len(items) else None)
                heavy.append(band_keys(signature(items, weights)) if (weights > 1).any() else None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, heavy)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), *lists], ["doc_id", "hash", "digest", "n", "bands", "heavy_bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, hash long, digest binary, n long, bands array<long>, heavy_bands array<long>")


def odd_sketch(items: np.ndarray) -> np.ndarray:
    """Parity of the number of items in each of 4 to 8 times as many bits: two sets differ in at least as many items as their sketches do in bits."""
    bits = max(64, 1 << int(4 * len(items) - 1).bit_length()) if len(items) else 64
    odd = np.bincount((mixed(items) >> np.uint64(1)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """node, its shingle set in order (8-byte hashes), the counts (null where all are 1) and their sum, the set's odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.unique(shingles(t.as_py()).view(np.int64), return_counts=True) for t in batch.column(1)]
            counts = [w.astype(np.int32) if (w > 1).any() else None for _, w in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array([int(w.sum()) for _, w in got], pa.int64()), pa.array([odd_sketch(x.view(np.uint64)) for x, _ in got], pa.list_(pa.int64()))], ["node", "set", "counts", "total", "odd"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, set array<long>, counts array<int>, total long, odd array<long>")


def reachable(node_sets: DataFrame, least: float) -> DataFrame:
    """node, n, shared, total, heavy of nodes that can have a partner: n shingles, of which `shared` occur in another node's set too; their counts add up to total and heavy.

    A partner has at most the shared ones in common, so nodes with less than `least` of their own, by number and by count, are out: those that only share a passage
    with others, and copies edited beyond the similarity. Shingles are counted with partial aggregation; one of a single node brings that node along.
    """
    each = node_sets.select("node", F.explode(F.transform("set", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.col("counts")[i], F.lit(1)).alias("w")))).alias("s")).select("node", "s.h", "s.w")
    lone = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "w")).alias("one")).where("c = 1").groupBy("one.node").agg(F.count(F.lit(1)).alias("lone"), F.sum("one.w").alias("alone"))
    own = node_sets.select("node", F.size("set").cast("long").alias("n"), "total").join(lone, "node", "left")
    own = own.select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"), "total", (F.col("total") - F.coalesce("alone", F.lit(0))).alias("heavy"))
    return own.where((F.col("shared") >= least * F.col("n")) | (F.col("heavy") >= least * F.col("total")))


def probability_jaccard(x: np.ndarray, y: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Of two ordered arrays of different items x and y with weights v and w: the sum over common items i of 1 / sum_j max(v_j / v_i, w_j / w_i)."""
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    v, w = v.astype(np.float64), w.astype(np.float64)
    p, q = v[i], w[j]
    # j's term is v_j / v_i where the ratio w_j / v_j is at most w_i / v_i, else w_j / w_i: sums of v up to a ratio, of w beyond it
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    end = np.searchsorted(ratio, ratio, "right")
    up, down = np.concatenate([[0.0], np.cumsum(p)])[end], np.concatenate([[0.0], np.cumsum(q)])[end]
    lone_v, lone_w = v.sum() - p.sum(), w.sum() - q.sum()
    return float((1 / ((up + lone_v) / p + (q.sum() - down + lone_w) / q)).sum())


def alike(x: np.ndarray, y: np.ndarray, v: np.ndarray | None, w: np.ndarray | None, least: float) -> bool:
    """Whether the similarity of two ordered shingle sets with counts (None: all 1) is at least `least`."""
    both = np.intersect1d(x, y, assume_unique=True).size
    if both >= least * (len(x) + len(y) - both):
        return True
    if v is None and w is None:
        return False
    v, w = np.ones(len(x)) if v is None else v, np.ones(len(y)) if w is None else w
    return probability_jaccard(x, y, v, w) >= least - 1e-9


def verified(pairs: DataFrame, node_sets: DataFrame, least: float) -> DataFrame:
    """Those (a, b) whose similarity is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def array(cell: pa.Scalar) -> np.ndarray | None:
            return cell.values.to_numpy() if cell.is_valid else None

        for batch in batches:
            mask = pa.array([alike(*map(array, cells), least) for cells in zip(*batch.columns[2:], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    x, y = (node_sets.select(F.col("node").alias(k), F.col("set").alias(s), F.col("counts").alias(c)) for k, s, c in (("a", "x", "v"), ("b", "y", "w")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "v", "w").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Stars (node, label) of the graph's components, label its smallest node: alternating large and small stars until none changes.

    Minima come from partial aggregations and are joined to the edges, so that a hub's edges stay spread out.
    """

    def star(own: DataFrame, small: bool) -> DataFrame:
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("b < a" if small else "a <> b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if small:
            return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        return joined.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def kept(own: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        table = written(own.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return table, (seen.get["n"], seen.get["sum"])

    edges, before = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while before[0]:
        last, (edges, now) = edges, kept(star(star(edges, False), True))
        forget(last)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and class_id (the class's smallest doc_id) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = written(signed(docs), "signatures")
    usable = marked.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # of rows that share a doc_id the text with the smallest hash is compared with others
    nodes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "hash")).alias("first"), *[F.first(c).alias(c) for c in ("n", "bands", "heavy_bands")])
    nodes = written(nodes.select("digest", F.col("first.doc_id").alias("node"), F.col("first.hash").alias("hash"), "n", "bands", F.coalesce("heavy_bands", "bands").alias("heavy_bands")), "nodes")
    size = F.floor(F.log("n") / float(np.log(1 / least + 1e-9)))
    banded = nodes.withColumn("own_class", size).groupBy("node").agg(F.min_by(F.struct("n", "bands", "heavy_bands", "own_class"), "hash").alias("own")).select("node", "own.*")
    banded = written(banded, "banded")
    # bands of sets: sizes whose ratio is at least `least` are in one class or in neighbouring ones; each node is in its class and in the next.
    # Bands of counts: shares are compared, whatever the size
    spread = banded.select(F.posexplode(F.concat("bands", "heavy_bands")).alias("i", "band"), "node", "own_class")
    spread = spread.select(F.explode(F.when(F.col("i") < BANDS, F.array("own_class", F.col("own_class") + 1)).otherwise(F.array(F.lit(COUNTS).cast("long")))).alias("class"), (F.col("i") % BANDS).alias("i"), "band", "node")
    spread = spread.select(F.xxhash64("band", "class").alias("bucket"), "i", "class", "node")
    crowded = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    wanted = spread.join(crowded, "bucket", "left_semi").select(F.col("node").alias("doc_id")).distinct()
    texts = docs.join(wanted.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    node_sets = written(sets(texts), "shingle-sets")
    # what can't have a partner leaves the buckets before leaders are chosen
    measures = ("n", "shared", "total", "heavy")
    alive = written(reachable(node_sets, least), "reachable")
    spread = written(spread.join(alive, "node"), "spread")
    central = F.struct((F.col("shared") / F.col("n")).alias("share"), (-F.col("node")).alias("node"))
    leaders = spread.groupBy("bucket").agg(F.max_by(F.struct("node", *measures), central).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(spread.join(leaders, "bucket"), "buckets")
    # the most that two nodes can have in common is what each shares with any other; where P and Q are the parts of either's weight that it shares with
    # others, the probability Jaccard similarity is at most 1 / (1 / P + 1 / Q - 1), as 1 / (1 / p + (1 - Q) / q) is concave in a common shingle's parts p and q
    sets_can = f"least(a_shared, b_shared) >= {least} * (a_n + b_n - least(a_shared, b_shared))"
    counts_can = f"((a_total > a_n OR b_total > b_n) AND 1 / (a_total / a_heavy + b_total / b_heavy - 1) >= {least} - 1e-9)"
    # sets of that similarity differ in at most this many shingles, so their odd sketches in at most as many bits
    bits = "aggregate(zip_with(odd, b_odd, (p, q) -> bit_count(p ^ q)), 0, (sum, n) -> sum + n)"
    close = f"(size(odd) <> size(b_odd) OR {bits} <= {(1 - least) / (1 + least)} * (a_n + b_n) + 1e-6)"

    def named(prefix: str, source: str = "") -> list:
        return [F.col(f"{source}{m}").alias(f"{prefix}_{m}") for m in measures]

    pairs = members.where("node <> lead.node").select(F.col("node").alias("a"), F.col("lead.node").alias("b"), *named("a"), *named("b", "lead.")).where(f"({sets_can}) OR {counts_can}")
    stars = components(verified(pairs.select("a", "b").distinct(), node_sets, least))

    def torn(own: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the size of their component there."""
        labelled = own.join(stars, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
        several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("bucket")
        return labelled.join(sizes.join(several, "bucket", "left_semi"), ["bucket", "label"])

    # leaders so far are done with: they have met every member of another component
    left = written(torn(members.where("node <> lead.node AND size > 2").select("bucket", "i", "class", "node", *measures).join(banded.select("node", "bands", "heavy_bands", "own_class"), "node").join(node_sets.select("node", "odd"), "node")), "open")
    forget(spread)
    block = 64
    while not left.isEmpty():
        order = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("size"), "label", "node"))
        chosen = written(left.withColumn("rank", order).where(F.col("rank") <= block).select("bucket", F.col("node").alias("b"), *named("b"), F.col("label").alias("b_label"), F.col("size").alias("b_size"), F.col("bands").alias("b_bands"), F.col("heavy_bands").alias("b_heavy_bands"), F.col("own_class").alias("b_class"), F.col("odd").alias("b_odd")), "leaders")
        own = left.select("bucket", "i", "class", F.col("node").alias("a"), *named("a"), "label", "size", "bands", "heavy_bands", "own_class", "odd")
        # each pair once: the leader is the earlier one in the bucket's order
        later = (F.col("label") != F.col("b_label")) & (F.struct(-F.col("size"), "label", "a") > F.struct(-F.col("b_size"), "b_label", "b"))
        # and only in the first bucket that the two share, those of sets before those of counts
        def shared(x: str, end: Column) -> Column:
            return F.exists(F.zip_with(F.slice(x, F.lit(1), end), F.slice(f"b_{x}", F.lit(1), end), lambda p, q: p == q), lambda same: same)

        near = F.abs(F.col("own_class") - F.col("b_class")) <= 1
        of_sets = (F.col("class") == F.greatest("own_class", "b_class")) & ~shared("bands", F.col("i"))
        first = F.when(F.col("class") == COUNTS, ~shared("heavy_bands", F.col("i")) & ~(near & shared("bands", F.lit(BANDS)))).otherwise(of_sets)
        pairs = own.join(chosen, "bucket").where(later & first).where(f"({sets_can} AND {close}) OR {counts_can}")
        new = verified(pairs.select("a", "b").distinct(), node_sets, least)
        stars = components(stars.select(F.col("node").alias("a"), F.col("label").alias("b")).union(new))
        rest = left.drop("label", "size").join(chosen.select("bucket", F.col("b").alias("node")), ["bucket", "node"], "left_anti")
        done, left, block = left, written(torn(rest), "open"), min(64 * block, 1 << 30)
        forget(done, chosen)
    forget(node_sets, alive, members, left, banded)
    return (
        marked.select("doc_id", "digest")
        .join(nodes.select("digest", "node"), "digest", "left")
        .join(stars, "node", "left")
        .select("doc_id", F.coalesce("label", F.when(F.col("doc_id").isNotNull(), F.col("node")), "doc_id").alias("class_id"))
    )


def one_per_class(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that are their class's smallest doc_id; of rows that share a doc_id that with the smallest text, and all with a null doc_id."""
    classes = near_duplicates(docs.select("doc_id", "text"), least)
    kept_ids = classes.where("doc_id = class_id").select("doc_id").distinct()
    row = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    others = [F.col("row").getField(c) for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "variant", "void"))]
    # which of several rows with one doc_id stays doesn't depend on their order
    stay = row.join(kept_ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.struct(F.col("row").getField("text"), F.xxhash64(*others))).alias("row"))
    return stay.unionByName(row.where("doc_id IS NULL")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
