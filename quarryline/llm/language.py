"""Language ID by hyperdimensional profiles.

Each letter has a random +1/-1 vector. A trigram's vector binds (multiplies) the vectors of its letters, permuted
(rolled) by their place; a text's vector bundles (adds) those of its trigrams. A language's prototype bundles the
texts of that language, each divided by its trigram count. A text gets the language with the largest cosine.

Vectors are linear in trigram counts: counts are gathered per group of texts (bounded in characters and in rows) and
multiplied with the trigram vectors in blocks of at most KEYS trigrams and CELLS counts. Training adds up integers per (language, dimension), so
that the order of tasks doesn't matter; only languages x DIMENSIONS numbers reach the driver.

Defined cases: `und` with score 0 for a null text or one without a letter; a very long text is a group of its own and counts whole; ties go to
the first language in alphabetical order; rows with null lang or text are not learned from; without any learned language every text is
`und`, and `kept` keeps every text with a letter; a null doc_id counts as not held out; repeated rows each get their row; an empty table
gives no rows; other columns are not read (`kept` passes them on).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

DIMENSIONS = 1024
SYMBOLS = 128
SEED = 20
UNKNOWN = "und"
#: Characters and rows whose trigrams are counted at once, different trigrams and counts that are multiplied at once.
GROUP_CHARS = 1_000_000
GROUP_ROWS = 4_096
KEYS = 1 << 12
CELLS = 1 << 21
#: Trigram shares are added up in units of one in so many.
UNIT = 1 << 24
#: Cosine that `kept` asks for where it is given no scores of learned documents.
LEAST_SCORE = 0.0
#: Lengths in characters of the excerpts of learned documents whose cosines show what a text of so many letters reaches.
EXCERPTS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: A text is rejected below this share of the cosine that all but one in LOW of the learned excerpts with as many letters reach.
SHARE = 0.5
LOW = 100


@functools.cache
def symbols() -> np.ndarray:
    """Symbol of each code point: 0 for other than letters, 1 to 26 for a to z, further letters spread over the rest."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = 27 + letters % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


@functools.cache
def letters() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    v, (a, b, c) = letters(), (keys >> 14, keys >> 7 & 127, keys & 127)
    return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Key and text of each trigram. A trigram's middle is a letter."""
    table = symbols()
    codes = [table[np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
    flat = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    good = (flat[1:-1] > 0) & (owner[:-2] == owner[2:])
    return ((flat[:-2] << 14) + (flat[1:-1] << 7) + flat[2:])[good], owner[1:-1][good]


def key_blocks(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of at most KEYS different keys: their vectors, where they stand in keys, and which of the block stands there."""
    active = np.flatnonzero(np.bincount(keys, minlength=1))
    place = np.zeros(int(keys.max(initial=0)) + 1, np.int32)
    place[active] = np.arange(len(active))
    place = place[keys]
    for start in range(0, len(active), KEYS):
        own = active[start : start + KEYS]
        at = np.flatnonzero((place >= start) & (place < start + KEYS)) if len(active) > KEYS else np.arange(len(keys))
        yield trigram_vectors(own), at, place[at] - start


def bundled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of texts, and how many trigrams each has. No more than CELLS counts and KEYS trigram vectors are held at once."""
    keys, owner = trigrams(texts)
    total = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for vectors, at, place in key_blocks(keys):
        m, own = len(vectors), owner[at]
        rows = max(1, CELLS // m)
        cuts = np.searchsorted(own, np.arange(0, len(texts) + rows, rows))  # owners are in order
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            n = min(rows, len(texts) - k * rows)
            counts = np.bincount((own[i:j] - k * rows) * m + place[i:j], minlength=n * m)
            out[k * rows : k * rows + n] += counts.reshape(n, m).astype(np.float32) @ vectors
    return out, total


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (their last column is a text), GROUP_CHARS characters, GROUP_ROWS rows or one row at a time."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[-1] or "")
            if size >= GROUP_CHARS or len(rows) >= GROUP_ROWS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from the rows (lang, text) of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows in grouped(batches):
            keys, owner = trigrams([r[1] for r in rows])
            share = 1 / np.bincount(owner, minlength=len(rows)).clip(1)[owner]
            names, number = np.unique([r[0] for r in rows], return_inverse=True)
            for vectors, at, place in key_blocks(keys):
                cell, m = number[owner[at]] * len(vectors) + place, len(vectors)
                add = np.bincount(cell, share[at], len(names) * m).reshape(len(names), m).astype(np.float32) @ vectors
                for lang, v in zip(names.tolist(), np.rint(add.astype(np.float64) * UNIT).astype(np.int64), strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], ["lang", "dim", "part"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, dim int, part long").groupBy("lang", "dim").agg(F.sum("part").alias("v")).collect()
    langs = sorted({r.lang for r in rows})
    found = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        found[langs.index(r.lang), r.dim] = r.v
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return langs, (found / np.where(norm > 0, norm, 1)).astype(np.float32)


def letter_class(letters_: np.ndarray) -> np.ndarray:
    """Powers of two up to the number of letters, and up to the longest excerpt."""
    return np.floor(np.log2(np.clip(letters_, 1, EXCERPTS[-1]))).astype(np.int64)


def least_scores(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> np.ndarray:
    """The least cosine to be kept with, by letter_class: from excerpts of all learned documents (lang, text) against their own language.

    Every document that is long enough gives one excerpt of each length, from a place that its checksum draws from the whole text. A class without
    excerpts takes the next shorter one's, 0 if there is none. Only counts of cosines (four digits) reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for rows in grouped(batches):
            vectors, n = bundled([text for _, text in rows])
            cosines = (vectors * prototypes[[langs.index(lang) for lang, _ in rows]]).sum(1) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
            keys = np.stack([letter_class(n), np.rint(cosines.astype(np.float64) * 1e4).astype(np.int64)], 1)[n > 0]
            for (k, c), m in zip(*(x.tolist() for x in np.unique(keys, axis=0, return_counts=True)), strict=True):
                seen[k, c] = seen.get((k, c), 0) + m
        k, c = ([x[i] for x in seen] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["k", "cosine", "m"])

    learned = docs.where(F.col("lang").cast("string").isin(langs) & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.length(F.col("text").cast("string")).alias("n"), F.crc32("text").alias("sum"))
    cut = F.array(*[F.when(F.col("n") >= size, F.substring("text", (1 + F.pmod(F.col("sum") + size, F.col("n") - size + 1)).cast("int"), F.lit(size))) for size in EXCERPTS])
    cut = learned.select("lang", F.explode(F.array_compact(cut)).alias("text"))
    rows = cut.mapInArrow(run, "k int, cosine int, m long").groupBy("k", "cosine").agg(F.sum("m").alias("m")).collect() if langs else []
    least = np.zeros(int(letter_class(np.array([EXCERPTS[-1]]))[0]) + 1)
    for k in range(len(least)):
        own = sorted((r.cosine, r.m) for r in rows if r.k == k)
        if own:
            total = np.cumsum([m for _, m in own])
            least[k] = max(0.0, SHARE * own[int(np.searchsorted(total, total[-1] / LOW))][0] / 1e4)
        elif k:
            least[k] = least[k - 1]
    return least


def predicted(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches):
            vectors, n = bundled([r[1] for r in rows])
            norm = np.linalg.norm(vectors, axis=1)
            cosines = np.round((vectors @ prototypes.T).astype(np.float64) / np.maximum(norm, 1e-9)[:, None], 4)
            known = (n > 0) & (len(langs) > 0)
            best = cosines.argmax(1) if langs else np.zeros(len(rows), int)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]), pa.array([float(min(1, max(0, cosines[i, b]))) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))])],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def kept(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float | np.ndarray = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and a cosine of at least `least` (by letter_class, if an array) with some learned language, if there is any."""
    by_class = np.zeros(int(letter_class(np.array([EXCERPTS[-1]]))[0]) + 1) + least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for rows in grouped(iter([pa.RecordBatch.from_arrays([batch.column("text")], ["text"])])):
                vectors, n = bundled([r[0] for r in rows])
                cosines = (vectors @ prototypes.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                like = (np.round(cosines.astype(np.float64), 4) >= by_class[letter_class(n)][:, None]).any(1)
                good = (n > 0) & (like if langs else True)
                yield batch.slice(start, len(rows)).filter(pa.array(good))
                start += len(rows)

    return docs.mapInArrow(run, docs.schema)


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, prototypes = learn(docs.where(~held_out()))
    return predicted(docs, langs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
