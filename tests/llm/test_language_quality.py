import zlib

import numpy as np

from quarryline.llm import language, quality


def test_trigram_vectors_are_bound_permuted_letters():
    v = language.letters()
    a, b, c = 3, 7, 20
    got = language.trigram_vectors(np.array([(a << 14) + (b << 7) + c]))[0]
    assert (got == np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]).all()


def test_trigrams_equal_plain_ones():
    texts = ["Abc abc, d", None, "", "é1x", "  "]
    keys, owner = language.trigrams(texts)
    table = language.symbols()
    for k, text in enumerate(texts):
        codes = [int(table[ord(ch)]) for ch in f" {(text or '').lower()} "]
        assert keys[owner == k].tolist() == [(x << 14) + (y << 7) + z for x, y, z in zip(codes, codes[1:], codes[2:], strict=False) if y]


def test_op5_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = language.op5_hyperdimensional_language(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_op5_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (None, "the dog", None), (4, None, "en"), (5, "123 !!", "de"), (5, "123 !!", "de"), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prototypes = language.learn(docs)
    got = language.predicted(docs, langs, prototypes).collect()
    assert langs == ["de", "en"] and len(got) == 7
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "en"), (2, "de"), (None, "en"), (4, "und"), (5, "und"), (6, "und")}
    assert language.kept(docs.withColumn("score", docs.lang), langs, prototypes).count() == 3
    none = language.learn(docs.limit(0))
    assert none[0] == [] and language.predicted(docs, *none).where("lang_pred <> 'und'").count() == 0
    assert language.kept(docs, *none).count() == 3 and language.predicted(docs.limit(0), langs, prototypes).count() == 0


def test_unlike_texts_go_and_short_clean_ones_stay(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    rng = np.random.default_rng(9)
    noise = [" ".join("".join(map(chr, rng.integers(33, 127, 6))) for _ in range(80)) for _ in range(20)]
    script = [" ".join("".join(map(chr, rng.integers(0x3B1, 0x3C9, 7))) for _ in range(60)) for _ in range(20)]
    held = [r for r in docs.where(language.held_out()).collect() if len((r.text or "").split()) >= 6]
    short = [" ".join(r.text.split()[:6]) for r in held]
    texts = [*noise, *script, *short]
    more = spark.createDataFrame([(top + 1 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # without a language: nothing is learned from them
    both = docs.unionByName(more, allowMissingColumns=True)
    stay = {r.doc_id for r in corpus_pipeline.language_id(spark, both, sf_dir).select("doc_id").collect()}
    went = [i not in stay for i in range(top + 1, top + 1 + len(texts))]
    assert all(went[:40])
    assert sum(went[40:]) <= 0.01 * len(short)
    own = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert sum(i in stay for i in own) >= 0.995 * len(own)


def test_op7_ordinal_probabilities(spark, sf_dir):
    rows = quality.op7_ordinal_quality(spark, sf_dir).collect()
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert len(rows) == docs.count()
    assert all(1 >= r.p_grade_1 >= r.p_grade_2 >= 0 and abs(r.expected_grade - r.p_grade_1 - r.p_grade_2) < 1e-5 for r in rows)
    chosen = {r.doc_id for r in rows if r.selected}
    clean = [r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0]
    assert sum(d in chosen for d in clean) >= 0.9 * len(clean)


def test_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = [(np.array([2, 3 + k]), np.ones(2, np.float32)) for k in rng.integers(0, 3, 900)]
    grades = np.array([i[1] - 3 for i, _ in x])
    model = quality.fit(x, grades, 3)
    tails = model.tails(np.array([float(model.weights[i] @ v) for i, v in x]))
    assert ((tails >= 0.5).sum(1) == grades).mean() > 0.95 and model.thresholds[0] < model.thresholds[1]


def test_op7_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (None, None, 2), (2, "", 3), (2, "", 3)], "doc_id long, text string, grade int")
    none = quality.learn(docs, spark.createDataFrame([(None, 1), (1, None), (9, 2), (1, 7)], "doc_id long, grade int"), 3)
    got = quality.graded(docs, none, 2).collect()
    assert len(got) == 4 and not any(r.selected for r in got) and all(r.expected_grade == 0 for r in got)
    some = quality.learn(docs, spark.createDataFrame([(1, 2), (1, 2), (2, 0)], "doc_id long, grade int"), 3)
    assert quality.graded(docs.limit(0), some, 2).count() == 0
    # the sample is bounded
    assert len(quality.learn(docs, spark.createDataFrame([(1, 2)], "doc_id long, grade int"), 3, sample_rows=1).thresholds) == 2


def test_short_rows_stay_within_bounds():
    """100,000 short and empty rows: as many at a time as GROUP_ROWS says, and few counts at once."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    letters_ = np.array(list("abcdefghijklmnopqrstuvwxyzéßñ  "))
    texts = ["".join(rng.choice(letters_, 40)) if i % 3 else ("" if i % 2 else None) for i in range(100_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 10_000])], ["text"]) for i in range(0, len(texts), 10_000)]
    tracemalloc.start()
    seen = 0
    for rows in language.grouped(iter(batches)):
        assert len(rows) <= language.GROUP_ROWS
        vectors, n = language.bundled([r[0] for r in rows])
        seen += len(n)
    assert seen == len(texts) and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_vectors_and_predictions_against_a_plain_version(spark):
    """Vectors trigram by trigram, prototypes text by text, cosines one by one."""
    table, v = language.symbols(), language.letters().astype(int)

    def vector(text):
        codes = [int(table[ord(c)]) for c in f" {text.lower()} "]
        own = [np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False) if b]
        return sum(own) if own else np.zeros(language.DIMENSIONS, int), len(own)

    rows = [("en", "the cat sat on the mat and the dog"), ("en", "this is the house that jack built"), ("fr", "le chat est dans la maison avec le chien"), ("fr", "où est la bibliothèque s'il vous plaît"), ("de", "der Hund und die Katze schlafen über Nacht")]
    whole, n = language.bundled([t for _, t in rows])
    assert [(a.astype(int) == vector(t)[0]).all() and m == vector(t)[1] for a, m, (_, t) in zip(whole, n, rows, strict=True)] == [True] * 5
    langs, prototypes = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    plain = {k: sum(vector(t)[0] / vector(t)[1] for x, t in rows if x == k) for k in langs}
    for k, p in zip(langs, prototypes, strict=True):
        assert np.allclose(p, plain[k] / np.linalg.norm(plain[k]), atol=1e-5)
    tests = ["the house and the cat", "la maison avec le chat", "die Nacht und der Hund", "123", "", None]
    got = {r.doc_id: r for r in language.predicted(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), langs, prototypes).collect()}
    for i, t in enumerate(tests):
        x, m = vector(t or "")
        if not m:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cosines = {k: float(x @ p / np.linalg.norm(x) / np.linalg.norm(p)) for k, p in plain.items()}
        assert got[i].lang_pred == max(cosines, key=cosines.get) and abs(got[i].score - max(cosines.values())) < 2e-4


def test_without_learned_languages_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", "a"), (2, "123", "b"), (3, None, "c")], "doc_id long, text string, n string")
    assert [r.doc_id for r in language.kept(docs, [], np.zeros((0, language.DIMENSIONS), np.float32)).collect()] == [1]


def test_gradient_and_loss_against_plain_versions():
    rng = np.random.default_rng(5)
    rows, levels = 40, 4
    index = np.concatenate([np.sort(rng.choice(30, 6, replace=False)) for _ in range(rows)])
    value, owner, y = rng.random(len(index)), np.repeat(np.arange(rows), 6), rng.integers(0, levels, rows)
    theta = np.zeros(quality.FEATURES + levels - 1)
    theta[:30], theta[quality.FEATURES :] = rng.normal(0, 0.3, 30), [-0.5, 0.1, -0.2]

    def plain(theta):
        t = [theta[quality.FEATURES]]
        for d in theta[quality.FEATURES + 1 :]:
            t.append(t[-1] + np.exp(d))
        total = 0.0
        for r in range(rows):
            f = sum(theta[i] * x for i, x, o in zip(index, value, owner, strict=True) if o == r)
            tails = [1.0, *(1 / (1 + np.exp(-(f - x))) for x in t), 0.0]
            total -= np.log(tails[y[r]] - tails[y[r] + 1])
        return total / rows + quality.RIDGE / 2 * (theta[: quality.FEATURES] ** 2).sum()

    loss, gradient = quality.loss_and_gradient(theta, index, value, owner, y, levels)
    assert abs(loss - plain(theta)) < 1e-9
    for k in (0, 7, 29, quality.FEATURES, quality.FEATURES + 1, quality.FEATURES + 2):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((plain(up) - plain(down)) / 2e-5 - gradient[k]) < 1e-6


def test_small_blocks_give_the_same_vectors(monkeypatch):
    texts = ["the quick brown fox", None, "", "7 8 9", "naïve café straße", "".join(chr(0x4E00 + 37 * i % 20_000) for i in range(3_000)), "a b c " * 50]
    whole, total = language.bundled(texts)
    monkeypatch.setattr(language, "KEYS", 7)
    monkeypatch.setattr(language, "CELLS", 20)
    blocked, again = language.bundled(texts)
    assert (whole == blocked).all() and (total == again).all()
    plain = np.zeros(language.DIMENSIONS)
    keys, owner = language.trigrams(texts)
    for key in keys[owner == 4]:
        plain += language.trigram_vectors(np.array([key]))[0]
    assert (plain == blocked[4]).all()


def test_repeated_rows_neither_weigh_more_nor_grow_the_sample(spark):
    texts = {1: "bad words here", 2: "good words there", 3: "fine words all over"}
    docs = spark.createDataFrame([*texts.items(), *[(1, texts[1])] * 300], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 0), (2, 1), (3, 1), *[(1, 0)] * 50], "doc_id long, grade int")
    once = quality.learn(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ratings.distinct(), 2)
    again = quality.learn(docs, ratings, 2)
    assert (once.weights == again.weights).all() and (once.thresholds == again.thresholds).all()
    two = quality.learn(docs, ratings, 2, sample_rows=2)
    assert (two.weights == quality.learn(docs.distinct(), ratings.distinct(), 2, sample_rows=2).weights).all()
