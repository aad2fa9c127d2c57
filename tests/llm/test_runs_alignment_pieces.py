import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.llm import alignment, pieces, runs
from quarryline.llm.common import tokenizer_path
from quarryline.llm.tokens import byte_letters

A, B = tokenizer_path(alignment.BYTES), tokenizer_path(pieces.PIECES)
ODD = [
    None, "", " ", "a", "\n", "\n\n a", "a\n", "a \nb", "a▁b", " a▁ b", "a▁▁ b c", "<s> </s> <0x41> <unk>", "<|endoftext|> x", "日本語 テスト 漢字", "🙂🙂 a🙂b", "ab" * 2000, " " * 300,
    "\t  a　b", "é é İ", " a b", "\0a\0 b", " a" * 50, "hello  world", "a\r\nb c", "naïve ² ½ ª º × ÷ ß Ü", "don't_stop__ ''s '' 're", "x\u0085y ​z", "a\n\nb\n c", "trail ", " lead",
]


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# SentencePiece by a prefix table


def test_pieces_equal_the_library(table):
    own = pieces.piece_encoder(B)
    texts = [*ODD, *[r.text for r in table]]
    for text, ids in zip(texts, own.each(texts), strict=True):
        assert ids.tolist() == own.table.library.encode(text or ""), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("theonig aiou,.▁\n 0é漢🙂"), max_size=60))
def test_pieces_of_any_text(text):
    own = pieces.piece_encoder(B)
    want = own.table.library.encode(text)
    assert next(own.each([text])).tolist() == want
    if text:
        assert own.table.encode(pieces.SPACE + text.replace(" ", pieces.SPACE)) == want


def test_compatibility_is_that_of_merging(table):
    t = pieces.piece_encoder(B).table
    rng = random.Random(3)
    ids = list(t.edges)
    for _ in range(3000):
        u, v = rng.choice(ids), rng.choice(ids)
        assert t.compatible(u, v) == (t.merged(t.pieces[u] + t.pieces[v])[0] == [t.pieces[u], t.pieces[v]])


def test_op13_against_library(spark, sf_dir, table):
    lib = pieces.piece_encoder(B).table.library
    docs = spark.createDataFrame([(r.doc_id, r.text, "x") for r in table] + [(None, "no id", "x"), (1, "again", None), (1, "again", None)] + [(10**6 + i, t, "") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    got = Counter(map(tuple, pieces.digests(docs, B).collect()))
    want = Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    whole = pieces.encoded(docs, B).where("doc_id = 1000013").first()
    assert whole.ids == lib.encode(ODD[13]) and whole.decoded == ODD[13]
    assert pieces.op13_prefix_table(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert pieces.digests(docs.limit(0), B).count() == 0


def test_a_very_long_text_without_spaces():
    own = pieces.piece_encoder(B)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdetheringon") for _ in range(120_000))
    assert next(own.each([text])).tolist() == own.table.library.encode(text)


# two tokenizers


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {v: k for k, v in byte_letters().items()}
    found, counts = [], Counter()
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.encode(text or "")
        x_bytes = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
        y_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x_bytes) != whole or b"".join(y_bytes) != whole:
            found.append(None)
            continue
        x_ends, y_ends = np.cumsum(list(map(len, x_bytes))).tolist(), np.cumsum(list(map(len, y_bytes))).tolist()
        groups, i, j = [], 0, 0
        for end in sorted({*x_ends} & {*y_ends}):
            p, q = x_ends.index(end) + 1, y_ends.index(end) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(x_ends[i] - len(x_bytes[i]), y_ends[j] - len(y_bytes[j])) < min(x_ends[i], y_ends[j])]
        counts.update(links)
        found.append((x, y, groups, links))
    highest = {}
    for (_, q), n in counts.items():
        highest[q] = max(n, highest.get(q, 0))
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            x, y, groups, links = f
            digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest()
            rows.append((len(x), len(y), len(groups), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links), digest))
    return rows, found


def test_op12_against_brute_force(spark, table, monkeypatch):
    texts = [*ODD, *[r.text for r in table if r.text is None or len(r.text) < 1500], "again and again", "again and again"]
    docs = frame(spark, texts).withColumn("pairs", F.lit(1)).withColumn("block", F.lit("x")).repartition(3)
    want, found = plain_alignment(texts)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.scored(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == want
    for r in alignment.groups(docs, A, B).collect():
        if found[r.doc_id] is None:
            assert not r.a and not r.b_cuts
        else:
            x, y, groups, _ = found[r.doc_id]
            assert (r.a, r.b) == (x, y)
            assert [(x[i:p], y[j:q]) for i, j, p, q in zip([0, *r.a_cuts], [0, *r.b_cuts], r.a_cuts, r.b_cuts)] == groups
    assert alignment.scored(docs.limit(0), A, B).count() == 0


def test_op12_counts_over_all_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, alignment.scored(docs.coalesce(1), A, B).collect()))
    many = sorted(map(tuple, alignment.scored(docs.repartition(7), A, B).collect()))
    assert one == many and len(one) == docs.count()


def test_op12_holds_few_blocks_at_once(spark):
    n = 2 * alignment.BLOCKS_A_FILE + 1
    texts = ["again and again " * 260_000, *["so be it " * 450_000] * (n - 1)]  # a block each
    got = alignment.scored(frame(spark, texts).coalesce(1), A, B)
    assert len(got.inputFiles()) >= 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan  # blocks go to Python one by one
    rows = sorted(got.collect())
    assert len(rows) == n and len({r[1:] for r in rows}) == 2 and all(r.n_links > 0 and r.count_sum > 0 for r in rows)


def test_rows_without_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (5, "a b"), (5, "a b"), (5, "c")], "doc_id long, text string")
    got = Counter(r.doc_id for r in alignment.scored(docs, A, B).collect())
    assert got == {None: 2, 5: 3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40)), min_size=1, max_size=8))
def test_galloping_finds_common_ends(lists):
    x, y = (np.array([v for pair in lists for v in sorted(pair[k])], np.int64) for k in (0, 1))
    n, m = (np.array([len(pair[k]) for pair in lists]) for k in (0, 1))
    i, j = alignment.common_ends(x, n, y, m)
    want = [(a + p, b + q) for (s, t), a, b in zip(lists, np.cumsum(n) - n, np.cumsum(m) - m, strict=True) for p, v in enumerate(sorted(s)) for q, w in enumerate(sorted(t)) if v == w]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


# runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                own = words[i : j + q]
                if all(any(own[k] != own[k + p] for k in range(len(own) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(documents):
    document, start, end, period, _ = runs.shard_runs(documents)
    out = [[] for _ in documents]
    for d, s, e, q in zip(document.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        out[d].append((s, e - s, q))
    return out


word = st.sampled_from([b"a", b"b", b"c"])
block = st.builds(lambda p, n, tail: (p * n)[: max(0, len(p) * n - tail)], st.lists(word, min_size=1, max_size=12), st.integers(1, 12), st.integers(0, 5))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.builds(lambda xs: [w for x in xs for w in x], st.lists(st.one_of(block, st.lists(word, max_size=8)), max_size=5)), min_size=1, max_size=5))
def test_runs_of_any_documents(documents):
    documents += documents[:2]  # copies share nonterminals
    assert found_runs(documents) == [plain_runs(d) for d in documents]


def test_runs_of_special_words():
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    nested = ([b"x", b"x", b"y"] * 9 + [b"z"]) * 4
    for d in ([], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 500, fibonacci[-1], nested, nested * 3, [b"a", b"b"] * 12 + [b"a"], [b"p", b"q"] * 40 + [b"q"] + [b"p", b"q"] * 40):
        assert found_runs([d, d]) == [plain_runs(d)] * 2


def test_a_very_long_text_is_one_run():
    assert found_runs([[b"a", b"b", b"c"] * 100_000]) == [[(0, 300_000, 3)]]


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = plain_runs(words)
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in own)
    return (doc_id, len(own), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op11_against_brute_force(spark, sf_dir, table):
    own = [(r.doc_id, r.text) for r in table if len(r.text or "") < 4000]
    odd = [(None, "a " * 40), (None, None), (7, ""), (7, "\x1c a\x0bb c " * 30), (7, "\x1c a\x0bb c " * 30), (30, "spam eggs " * 50)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in own + odd], "doc_id long, text string, start string, period int").repartition(3)
    assert Counter(map(tuple, runs.digests(docs, runs.periodic_tail).collect())) == Counter(plain_digest(*r) for r in own + odd)
    assert runs.digests(docs.limit(0)).count() == 0
    assert runs.op11_grammar_runs(spark, sf_dir).count() == len(table)


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 20 + "y"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in runs.runs(docs).collect()] == [(1, 1, 60, 3)]
    assert {r.doc_id: (r.text, r.n_dropped) for r in runs.collapsed(docs).collect()} == {1: ("x a b c y", 57), 2: ("nothing here", 0), 3: ("", 0)}
