import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import probminhash, substrings

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    words = t.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    bases = [text(rng, rng.randrange(8, 200)) for _ in range(40)]
    rows = []
    for b in bases:
        rows += [b] * rng.choice([1, 1, 3]) + [edited(rng, b, k) for k in range(rng.randrange(4))]
    hub = text(rng, 300)
    rows += [edited(rng, hub, rng.randrange(1, 14)) for _ in range(60)]
    chain = text(rng, 200)
    for _ in range(20):
        chain = edited(rng, chain, 2)
        rows.append(chain)
    rows += ["", None, "one", "one", "one two three", "one two three", "a b c d e", "A  b c\nd e"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def probability_jaccard(x, y):
    """Of two counters, term by term."""
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x.keys() & y.keys())


def brute_classes(rows, least=0.8):
    sets = {i: Counter(probminhash.shingles(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = sets[i], sets[j]
            both = len(x.keys() & y.keys())
            # by number or, where shingles are repeated, by count
            if both >= least * len(x | y) or (max([*x.values(), *y.values()]) > 1 and both and probability_jaccard(x, y) >= least):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_classes_equal_brute_force(spark, corpus):
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_classes(corpus)


def repeating(rng, t, n, times):
    """t with a line of n words after it, several times: the set of shingles hardly changes, their counts do."""
    return t + f"\n{text(rng, n)}" * times


def test_classes_with_repeated_lines_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(30):
        base = text(rng, 300)
        rows += [base, repeating(rng, base, 12, 60), repeating(rng, edited(rng, base, 2), 8, 40), edited(rng, base, 3)]
    # the same set with other counts; a repeated line that makes up most of two texts with little else in common, and of one without repeats
    rows += ["a b c d e f a b c d e f a b c d e", "a b c d e f a b c d e f a b c d e f a b c d e"]
    line = text(rng, 40)
    rows += [(line + "\n") * 30 + text(rng, 30), (line + "\n") * 25 + text(rng, 30), line * 1 + " " + text(rng, 3)]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 100))
    want = brute_classes(rows)
    assert len(set(want.values())) < 40
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_recall_of_pairs_at_the_threshold():
    """Pairs whose similarity lies between 0.8 and 0.85, half of them with repeated lines: at least nine in ten share a band of the measure that links them."""
    rng = random.Random(13)
    met = total = 0
    while total < 120:
        base = text(rng, 240)
        other = edited(rng, base, rng.randrange(3, 7))
        if total % 2:
            line = "\n" + text(rng, 9)
            base, other = base + line * 20, other + line * rng.randrange(15, 25)
        (x, v), (y, w) = (np.unique(probminhash.shingles(t), return_counts=True) for t in (base, other))
        sims = [probminhash.probability_jaccard(x, y, np.ones(len(x)), np.ones(len(y))), probminhash.probability_jaccard(x, y, v, w)]
        if not 0.8 <= max(sims) <= 0.85:
            continue
        total += 1
        weights = [(np.ones_like(v), np.ones_like(w)), (v, w)][int(sims[1] > sims[0])]
        met += bool((probminhash.band_keys(probminhash.signature(x, weights[0])) == probminhash.band_keys(probminhash.signature(y, weights[1]))).any())
    assert met >= 0.9 * total


def test_probability_jaccard_against_its_definition():
    rng = np.random.default_rng(6)
    for _ in range(30):
        x, y = (np.unique(rng.integers(0, 60, 40)) for _ in range(2))
        v, w = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
        plain = probability_jaccard(Counter(dict(zip(x.tolist(), v.tolist(), strict=True))), Counter(dict(zip(y.tolist(), w.tolist(), strict=True))))
        assert abs(probminhash.probability_jaccard(x, y, v, w) - plain) < 1e-9


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        items = rng.integers(1, 1 << 62, 120).astype(np.uint64)
        a, b = items[:90], items[30:]
        wa, wb = rng.integers(1, 6, 90), rng.integers(1, 6, 90)
        x, y = dict(zip(a.tolist(), wa.tolist(), strict=True)), dict(zip(b.tolist(), wb.tolist(), strict=True))
        true = sum(1 / sum(max(x.get(k, 0) / x[d], y.get(k, 0) / y[d]) for k in x | y) for d in x.keys() & y.keys())
        errors.append((probminhash.signature(a, wa) == probminhash.signature(b, wb)).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_signature_does_not_depend_on_order_or_early_stop(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 700, 5000):
        items, weights = rng.integers(1, 1 << 62, n).astype(np.uint64), rng.integers(1, 9, n)
        got = probminhash.signature(items, weights)
        order = rng.permutation(n)
        assert (got == probminhash.signature(items[order], weights[order])).all()
        with monkeypatch.context() as m:
            m.setattr(probminhash, "ENOUGH", 4 * probminhash.ENOUGH)
            assert (got == probminhash.signature(items, weights)).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.label for r in probminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {k: v for k, v in got.items() if k != v} == {k: find(k) for k in parent if find(k) != k}


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f", 1), (None, "a b c d e f", 2), (3, None, 3), (4, "", 4), (5, "", 5), (6, "a b c d e f", 6), (6, "a b c d e f", 7), (7, "x", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = Counter((r.doc_id, r.class_id) for r in probminhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 1), (None, None), (3, 3), (4, 4), (5, 5), (6, 1), (6, 1), (7, 7)])
    assert probminhash.near_duplicates(docs.limit(0)).count() == 0
    stay = probminhash.one_per_class(docs.withColumns({"__first": F.lit(1), "row": F.lit("x"), "kept": F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1)))}))
    assert stay.columns == [*docs.columns, "__first", "row", "kept"]
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["1", "3", "4", "5", "7", "None"]


def brute_repeats(rows, window=20):
    seen, out, done = set(), Counter(), {}
    for doc_id, t in sorted(rows, key=lambda r: r[0]):
        words, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        done[doc_id] = (doc_id, len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    for doc_id, _ in rows:
        out[done[doc_id]] += 1
    return out


def digests(docs, window=20):
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.deduplicated(docs, window).collect())


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    passages = [text(rng, n) for n in (20, 21, 25, 40, 19, 60)]
    rows = []
    for i in range(120):
        parts = [rng.choice([text(rng, rng.randrange(0, 30)), rng.choice(passages), "\t\x0b", "x y\u0085z"]) for _ in range(rng.randrange(0, 6))]
        rows.append((i * 3 - 50, "\n ".join(parts)))
    rows += [(1000, "same " * 70), (1001, "same " * 21), (1002, "tic tac " * 30), (1003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_repeats(rows)
    assert digests(docs) == want
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 200)  # in the driver's closures only: chunk sizes never change results
    assert digests(docs.coalesce(1)) == want


def test_repeats_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op4_block_anchors(spark, sf_dir).collect())
    assert got == brute_repeats(rows)


def test_repeats_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(5, t, 1), (5, t, 1), (None, t, 2), (9, None, 3), (9, "", 4)], "doc_id long, text string, k1 int")
    rows = substrings.deduplicated(docs).collect()
    # the null id comes first; the repeated row is one document
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == [("5", 30, 30), ("5", 30, 30), ("9", 0, 0), ("9", 0, 0), ("None", 30, 0)]
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_copies_of_one_text_are_spread_over_buckets(spark):
    k1 = np.arange(1000, dtype=np.int64)
    k2 = np.full(1000, -5, np.int64)
    sizes = Counter(r[0] for r in substrings.to_documents(k1, k2, np.zeros(1000, np.int64), 8) for _ in range(len(r[2]) // 8))
    assert len(sizes) == 8 and max(sizes.values()) < 200
    t = " ".join(f"v{i}" for i in range(30))
    own = substrings.keyed(spark.createDataFrame([(i, t) for i in range(200)], "doc_id long, text string").coalesce(1))
    places = substrings.anchors(own, 8).collect()
    assert len({r.bucket for r in places}) == 8


def test_spans():
    assert substrings.spans(np.array([], np.int64), 20) == []
    assert substrings.spans(np.array([3, 4, 24, 50]), 20) == [(3, 44), (50, 70)]


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert substrings.from_planes(substrings.planes(x)).tolist() == x.tolist()


def test_brute_force_is_a_partition(corpus):
    classes = defaultdict(set)
    for i, c in brute_classes(corpus).items():
        classes[c].add(i)
    assert all(min(m) == c for c, m in classes.items())
