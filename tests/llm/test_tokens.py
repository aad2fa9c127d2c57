import zlib

import numpy as np
import pytest

from quarryline.llm import packing, repair_codec
from quarryline.llm.common import tokenizer_path
from quarryline.llm.tokens import encoder

ODD = ["", "  ", "a\tb", "It's DON'T we'll x's", "<|endoftext|>abc <|startoftext|>", "naïve ² ½ ª º × ÷ ß Ü", "é é", "İstanbul ΣΑΣ", "日本語 テスト", "a b\u0085c\x1cd", "x\r\ny", "don't_stop__ ''s '' 're", "🙂🙂 a🙂b", "1234 12a3", "­soft­hyphen", "word%%% THEN!! a,b.c"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def whole(text, end):
    return [*encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library(texts):
    e = encoder(tokenizer_path())
    sample = [*ODD, *list(texts.values())[:60], None]
    for text, ids in zip(sample, e.each(sample), strict=True):
        assert ids.tolist() == whole(text, 0)[:-1]


def test_grammar_round_trip_and_spans():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), np.full(500, 3, np.uint32), np.tile(rng.integers(0, 50, 40), 60).astype(np.uint32), rng.integers(0, 60_000, 5_000).astype(np.uint32)):
        rules, lengths, symbols = repair_codec.compress(ids, 60_000)
        g = repair_codec.Grammar(60_000, rules, lengths, symbols)
        assert g.decode_span(0, len(ids)).tolist() == ids.tolist()
        assert len(symbols) <= len(ids)
        for a, b in ((0, 1), (3, 40), (len(ids) // 2, len(ids))):
            if b <= len(ids):
                assert g.decode_span(a, b).tolist() == ids[a:b].tolist()


def most_frequent(symbols):
    """Count of the most frequent pair whose places don't overlap, one by one."""
    last, counts = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if last.get(pair, -2) < i - 1:
            last[pair], counts[pair] = i, counts.get(pair, 0) + 1
    return max(counts.values(), default=0)


def test_no_pair_is_left_while_symbols_are_free(texts):
    ids = np.concatenate(list(encoder(tokenizer_path()).each(texts.values())))
    rng = np.random.default_rng(2)
    for own, base, alphabet in ((ids[:30_000], 49_408, 65_536), (rng.integers(0, 9, 4_000).astype(np.uint32), 9, 65_536), (np.tile(np.array([1, 1, 2], np.uint32), 500), 3, 65_536), (ids[:60_000], 49_408, 49_508)):
        rules, lengths, symbols = repair_codec.compress(own, base, alphabet)
        assert len(rules) == max(alphabet - base, repair_codec.LEAST_RULES) or most_frequent(symbols.tolist()) < 2
        assert repair_codec.Grammar(base, rules, lengths, symbols).decode_span(0, len(own)).tolist() == own.tolist()


def test_op3_against_library(spark, sf_dir, texts):
    got = {r.doc_id: r for r in repair_codec.op3_repair_tokens(spark, sf_dir).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = np.array(whole(texts[doc_id], 1), "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def odd_rows(spark):
    return spark.createDataFrame([(2, "b c", 1), (1, None, 2), (None, "x y", 3), (2, "a", 4), (2, "a", 5), (3, "", 6)], "doc_id long, text string, ids int")


def test_op3_odd_rows(spark, tmp_path):
    for shard_ids, name in ((1, "a"), (1_000, "b")):
        repair_codec.write(odd_rows(spark), f"file://{tmp_path}/{name}", tokenizer_path(), shard_ids=shard_ids)
        rows = repair_codec.read(spark, f"file://{tmp_path}/{name}").orderBy("start").collect()
        assert [r.doc_id for r in rows] == [None, 1, 2, 2, 2, 3]
        assert [list(np.frombuffer(r.ids, "<u4")) for r in rows] == [whole(t, 1) for t in ("x y", "", "a", "a", "b c", "")]
        assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(6)]
    repair_codec.write(odd_rows(spark).limit(0), f"file://{tmp_path}/c", tokenizer_path())
    assert repair_codec.read(spark, f"file://{tmp_path}/c").count() == 0


def check_pieces(rows, texts_by_id, tiers=packing.TIERS):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, own in by_doc.items():
        ids = np.array(whole(texts_by_id[doc_id], 2), "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tiers[0] and (at == tiers[0] or at & (at - 1) == 0)
    return by_doc, by_sequence


def test_op6_pieces(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for group in (20_000, packing.GROUP_TOKENS):
        by_doc, _ = check_pieces(packing.packed(docs, tokenizer_path(), group_tokens=group).collect(), texts)
        assert set(by_doc) == set(texts)


def test_op6_odd_rows(spark):
    rows = packing.packed(spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 5_000)], "doc_id long, text string"), tokenizer_path()).collect()
    check_pieces(rows, {1: None, 2: "", 3: "a b " * 5_000})
    assert packing.packed(odd_rows(spark).limit(0), tokenizer_path()).count() == 0
    assert sum(r.length for r in packing.packed(odd_rows(spark), tokenizer_path()).collect()) == sum(len(whole(t, 2)) for t in ("b c", None, "x y", "a", "a", ""))


def test_pack_and_step_groups():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 9_000, rng.integers(1, 60)).tolist()
        windows, left = packing.pack(lengths)
        assert not left
        seen = {}
        for size, own in windows:
            assert sum(n for *_, n in own) == size
            for d, s, n in own:
                seen.setdefault(d, []).append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, m in sorted(seen[d]):
                assert s == at
                at += m
            assert at == n
        groups = packing.step_groups([w for w, _ in windows], 16_384)
        loads = [sum(w for (w, _), g in zip(windows, groups, strict=True) if g == k) for k in set(groups)]
        assert max(loads) - min(loads) <= 4_096
