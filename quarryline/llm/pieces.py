"""SentencePiece BPE by a prefix table: each prefix's one last token, then the ids backwards.

Merges are of a type: two neighbouring symbols merge whenever their concatenation is a piece, the best-scored piece first and of equal ones the leftmost. So a sequence
of pieces is a text's encoding just when each piece encodes to itself and each neighbouring pair (u, t) is compatible, that is when u + t encodes to [u, t]: as long as nothing
merges across an edge both sides do what they would do alone, and the first merge across an edge would also happen in the pair alone. Hence the encoding of every prefix
ends in exactly one piece. The table is filled from left to right: of the pieces that end at a place (matches of an Aho-Corasick automaton) the last one is that
whose predecessor, the last token of the prefix before it, is compatible with it. Ids are then read from the end backwards. Time is linear in the text.

A pair is tested on the edges' histories: the symbols that stand at u's right edge and at t's left edge while they are merged, each until the merge that takes it in.
Pieces whose own merges don't come in falling order of score, or share a score, are tested by merging the pair step by step. Tested pairs are kept.

A space becomes U+2581, one is put in front of a text, and characters that no piece has become a byte piece per byte. No piece goes on from another character to
U+2581, so a text is cut before spaces into units whose ids are found once (and, as no piece holds a line feed, at line feeds).

Defined cases: a null text is the empty one and has no ids; a very long text without a space is one unit, in time and memory that grow with its length; rows that share a doc_id, null
doc_ids and repeated rows keep a row each; no ties, as a text has one encoding; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_path
from .tokens import GROUP_CHARS, Kept, gathered

PIECES = "piece_bpe_32k.model"
SPACE = "\u2581"
#: Pairs with a known answer, and units, that a worker keeps; beyond it they start anew.
KEPT_PAIRS = 1_000_000
KEPT_UNITS = 1_000_000
KEPT_BYTES = 100_000_000
#: Units of at most SHORT characters, of the LETTERS most frequent ones, go through the table together; the last pair to fall in one of 2**PAIR_BITS slots is known there.
SHORT = 24
LETTERS = 255
PAIR_BITS = 21
#: Characters that some tokenizer may take for white space, beside U+2581: next to them nothing is cut.
BLANK = r"[\x00-\x20\x7f-\xa0\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{2581}\x{3000}\x{feff}]"
CUT_OPENLY = rf"(?:^|[ ]){BLANK}|{BLANK}(?:[ ]|$)|(?:^|\n){BLANK}|{BLANK}(?:\n|$)"
#: Texts on which the table is compared with the library when a model is read.
PROBES = ["", " ", "a", "It's 12.5 <s> x", "naïve  déjà\n\nvu\t", "日本語🙂\u2581x", "    def f(x):\n        return x", "aaaaaaaaaaaaaaaaaaaaa"]


class PieceTable:
    """ids of strings whose spaces are U+2581, by the prefix table."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.lengths = [len(p) for p in self.pieces]
        scores = [s for p, s in self.scores.items() if len(p) > 1]
        alone = set(np.array(scores)[np.unique(scores, return_inverse=True, return_counts=True)[2][np.unique(scores, return_inverse=True)[1]] == 1].tolist())
        #: Of each piece that encodes to itself: symbols at its right and left edge with the score of the merge that takes them in, or None to merge step by step.
        self.edges: dict[int, tuple[list, list] | None] = {}
        automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            symbols, steps = self.merged(piece)
            if symbols == [piece]:
                automaton.add_word(piece, i)
                done = [self.scores[a + b] for _, a, b in steps]
                orderly = all(x > y for x, y in zip(done, done[1:], strict=False)) and alone.issuperset(done)
                self.edges[i] = self.edge_histories(piece, steps) if orderly else None
        automaton.make_automaton()
        self.matches = automaton.iter
        self.known: dict[int, bool] = {}
        if any(self.encode(SPACE + p.replace(" ", SPACE) if p else "") != model.encode(p) for p in PROBES):
            raise ValueError(f"{path} has a normaliser or rules other than those of a plain BPE model with byte pieces")

    def merged(self, text: str) -> tuple[list[str], list[tuple[int, str, str]]]:
        """Symbols that are left when nothing merges any more, and the merges in order: place, left and right symbol."""
        symbols, steps, score = list(text), [], self.scores.get
        while True:
            best, at = -inf, -1
            for i in range(len(symbols) - 1):
                s = score(symbols[i] + symbols[i + 1], -inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                return symbols, steps
            steps.append((at, symbols[at], symbols[at + 1]))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def edge_histories(self, piece: str, steps: list[tuple[int, str, str]]) -> tuple[list, list]:
        right, left, size = [], [], len(piece)
        for at, a, b in steps:
            score = self.scores[a + b]
            if at == 0:
                left.append((a, score))
            if at + 2 == size:
                right.append((b, score))
            size -= 1
        return [*right, (piece, -inf)], [*left, (piece, -inf)]

    def compatible(self, u: int, t: int) -> bool:
        """Whether u + t encodes to [u, t]."""
        x, y = self.edges[u], self.edges[t]
        if x is None or y is None:
            return self.merged(self.pieces[u] + self.pieces[t])[0] == [self.pieces[u], self.pieces[t]]
        right, left, score = x[0], y[1], self.scores.get
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = right[i], left[j]
            across = score(a + b)
            # u's own merge of a like score lies further left and comes first, t's further right and comes later
            if across is not None and across > until_a and across >= until_b:
                return False
            if until_a == until_b == -inf:
                return True
            if until_a >= until_b:
                i += 1
            else:
                j += 1

    def encode(self, text: str) -> list[int]:
        last, lengths, known = [0] * (len(text) + 1), self.lengths, self.known
        for end, t in self.matches(text):
            i = end + 1
            if last[i]:
                continue
            j = i - lengths[t]
            u = last[j]  # 0 at the start and after a character without a piece, which merges with nothing
            if u:
                pair = u << 32 | t
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= KEPT_PAIRS:
                        known.clear()
                    fits = known[pair] = self.compatible(u, t)
                if not fits:
                    continue
            last[i] = t
        out, i = [], len(text)
        while i:
            t = last[i]
            if t:
                out.append(t)
                i -= lengths[t]
            else:
                i -= 1
                out.extend(self.bytes[b] for b in reversed(text[i].encode()))
        out.reverse()
        return out


class Batches:
    """The same table for many short units at once, a place of all of them after the other, where all characters are among the pieces' most frequent ones."""

    def __init__(self, table: PieceTable):
        self.table, self.lengths = table, np.array(table.lengths)
        often = Counter(c for i in table.edges for c in table.pieces[i]).most_common(LETTERS)
        self.codes = np.zeros(0x110000, np.uint8)
        self.codes[[ord(c) for c, _ in often]] = np.arange(1, len(often) + 1)
        self.grow()
        self.slots = np.zeros(1 << PAIR_BITS, np.uint64)  # a pair in its slot, and whether it is compatible
        self.fit = np.zeros(1 << PAIR_BITS, bool)

    def coded(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def grow(self) -> None:
        """The automaton: next state by state and character, each state's longest piece (0: none) and each piece's next shorter one at the same end."""
        children: list[dict[int, int]] = [{}]
        own = [0]
        for i in self.table.edges:
            codes = self.coded(self.table.pieces[i]).tolist()
            if 0 in codes:
                continue
            node = 0
            for c in codes:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    own.append(0)
            own[node] = i
        self.next = np.zeros((len(children), LETTERS + 1), np.uint16 if len(children) <= 65_536 else np.int32)
        self.longest, self.shorter = np.zeros(len(children), np.int64), np.zeros(self.table.size, np.int64)
        behind, queue = [0] * len(children), [0]
        for node in queue:  # the queue grows: breadth first
            if node:
                self.next[node] = self.next[behind[node]]
                self.longest[node] = own[node] or self.longest[behind[node]]
                if own[node]:
                    self.shorter[own[node]] = self.longest[behind[node]]
            for c, child in children[node].items():
                behind[child] = int(self.next[behind[node], c]) if node else 0
                self.next[node, c] = child
                queue.append(child)

    def fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        pairs = (u << 32 | t).astype(np.uint64)
        slot = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, new = self.fit[slot], np.flatnonzero(self.slots[slot] != pairs)
        if len(new):
            different, which = np.unique(pairs[new], return_inverse=True)
            answers = np.array([self.table.compatible(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in different])
            out[new] = answers[which]
            self.slots[slot[new]], self.fit[slot[new]] = pairs[new], out[new]
            held = self.slots[slot[new]] == pairs[new]  # of two that fall in one slot the last one has it
            self.fit[slot[new][held]] = out[new][held]
        return out

    def encode(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of units given as codes, none 0, one unit after the other."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        longest = int(size[0]) if len(size) else 0
        last = np.zeros((longest + 1, len(size)), np.int64)
        state = np.zeros(len(size), np.int32)
        for i in range(1, longest + 1):
            n = int(np.searchsorted(-size, -i, "right"))
            state = self.next[state[:n], codes[starts[:n] + i - 1]]
            rows, t = np.arange(n), self.longest[state]
            while len(rows):
                j = i - self.lengths[t]
                u = last[j, rows]
                good = u == 0  # only at a unit's start: its characters are all pieces
                rest = np.flatnonzero(~good)
                good[rest] = self.fits(u[rest], t[rest])
                last[i, rows[good]] = t[good]
                rows, t = rows[~good], self.shorter[t[~good]]
        out, at, steps = np.zeros((longest, len(size)), np.uint32), size.copy(), 0
        rows = np.flatnonzero(at > 0)
        while len(rows):
            t = last[at[rows], rows]
            out[steps, rows] = t
            at[rows] -= self.lengths[t]
            rows, steps = rows[at[rows] > 0], steps + 1
        count = np.zeros(len(size), np.int64)
        count[order] = n_ids = (out > 0).sum(0)
        # back to the order given; within a unit the ids were found from the end
        place = np.repeat((np.cumsum(count) - count)[order] + n_ids - 1, n_ids)
        step = np.arange(int(n_ids.sum())) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
        ids = np.zeros(len(place), np.uint32)
        ids[place - step] = out.T[out.T > 0]
        return count, ids


@functools.cache
def piece_table(path: str) -> PieceTable:
    """One for each worker and file."""
    return PieceTable(path)


def blank() -> str:
    """BLANK, without its brackets, for the regex library."""
    import regex

    return regex.sub(r"\\x\{(\w+)\}", lambda m: rf"\u{int(m[1], 16):04x}", BLANK)[1:-1]


@functools.cache
def openly() -> Callable[[str], list[str]]:
    """Cuts a text before every space or line feed between two characters that are no blanks."""
    import regex

    return regex.compile(rf"(?<=[^{blank()}])(?=[ \n][^{blank()}])").split


@functools.cache
def whole_unit() -> Callable[[str], object]:
    """Whether a string is such a unit at both ends."""
    import regex

    return regex.compile(rf"[ \n][^{blank()}](?:.*[^{blank()}])?", regex.S).fullmatch


def units(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The texts' units, one after the other, and where each text's begin and end: of units that start with a space it is left out, and those that start with another blank after it are whole behind a zero.

    A unit ends before a space or line feed between two characters that no tokenizer takes for white space. Most texts have no other spaces, and Arrow cuts those.
    """
    column = pa.array(texts, pa.string())
    hard = pc.match_substring_regex(column, CUT_OPENLY).to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
    offsets = cut.offsets.to_numpy()
    if not hard.any():
        return cut.values, offsets
    parts: list[pa.Array] = []
    sizes = np.diff(offsets)
    begin = 0
    for i in np.flatnonzero(hard).tolist():
        own = openly()(" " + texts[i])
        parts += [cut.values.slice(offsets[begin], offsets[i] - offsets[begin]), pa.array(["\0" + u for u in own], pa.string())]
        sizes[i], begin = len(own), i + 1
    parts.append(cut.values.slice(offsets[begin], offsets[-1] - offsets[begin]))
    return pa.concat_arrays(parts), np.r_[0, np.cumsum(sizes)]


def whole_units(cut: Iterable[str]) -> list[str]:
    """Units as they stand in the text."""
    return [u if u[:1] == "\n" else u[1:] if u[:1] == "\0" else " " + u for u in cut]


def grouped(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Lists of texts of GROUP_CHARS characters or a single longer one; nulls are empty."""
    own: list[str] = []
    size = 0
    for text in texts:
        own.append(text or "")
        size += len(own[-1])
        if size >= GROUP_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


class KeptUnits(Kept):
    """Kept strings, bounded by their bytes too: a unit can be a whole text."""

    def numbers(self, keys: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.keys.nbytes > KEPT_BYTES:
            self.clear()
        return super().numbers(keys, learn)


class PieceEncoder:
    """ids of texts: uint32 arrays, equal to the library's encode(text)."""

    def __init__(self, path: str):
        self.table, self.units = piece_table(path), KeptUnits(KEPT_UNITS)
        self.batches = Batches(self.table)

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.of_whole(whole_units(new.to_pylist()))

    def of_whole(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of strings in which nothing is put in front."""
        if "\n" in self.table.ids:
            return self.encode(own)
        # a line feed in front is its byte piece and merges with nothing
        led = np.fromiter((u[0] == "\n" for u in own), bool, len(own))
        counts, ids = self.encode([u[1:] if u[0] == "\n" else u for u in own])
        counts += led
        out = np.full(int(counts.sum()), self.table.bytes[10], np.uint32)
        rest = np.ones(len(out), bool)
        rest[(np.cumsum(counts) - counts)[led]] = False
        out[rest] = ids
        return counts, out

    def encode(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of strings."""
        joined = "".join(own).replace(" ", SPACE)
        codes, sizes = self.batches.coded(joined), np.fromiter(map(len, own), np.int64, len(own))
        bad = np.r_[0, np.cumsum(codes == 0)]
        ends = np.cumsum(sizes)
        short = (bad[ends] == bad[ends - sizes]) & (sizes <= SHORT)
        counts, parts = np.zeros(len(own), np.int64), []
        counts[short], ids = self.batches.encode(codes[np.repeat(short, sizes)], sizes[short])
        for i in np.flatnonzero(~short).tolist():
            parts.append(np.array(self.table.encode(joined[ends[i] - sizes[i] : ends[i]]), np.uint32))
            counts[i] = len(parts[-1])
        if not parts:
            return counts, ids
        own_order = np.r_[np.flatnonzero(short), np.flatnonzero(~short)]
        starts = np.zeros(len(own), np.int64)
        starts[own_order] = np.cumsum(counts[own_order]) - counts[own_order]
        return counts, gathered(np.concatenate([ids, *parts]), starts, counts)

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for own in grouped(texts):
            cut, offsets = units(own)
            numbers = self.units.numbers(cut, self.learn)
            lengths = self.units.lengths[numbers]
            ids = gathered(self.units.flat, self.units.starts[numbers], lengths)
            ends = np.r_[0, np.cumsum(lengths)][offsets]
            for text, a, b in zip(own, ends.tolist(), ends[1:].tolist(), strict=False):
                yield ids[a:b] if text else ids[:0]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the library's decoding of them) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(model)
        for batch in batches:
            ids = list(encode.each(t.as_py() for t in batch.column(1)))
            texts = [encode.table.library.decode(x.tolist()) if len(x) else "" for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text of every row; ids themselves stay in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(model)
        decimal, decode = list(map(str, range(encode.table.size))), encode.table.library.decode
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for x in encode.each(t.as_py() for t in batch.column(1)):
                own = x.tolist()
                sizes.append(len(own))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                text_sha.append(hashlib.sha256((decode(own) if own else "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path(PIECES))
