"""Token ids of whole texts, by the tokenizers library.

The tokenizer's normalizer and pre-tokenizer never join text across a space or a line feed, so a text's ids are the ids
of its pieces between them, one after the other. Pieces repeat: Arrow finds the different ones of a group of texts, the ids
of each are looked up or made once, and the texts' ids are gathered from one flat array.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept in a worker, and words; beyond it a table starts anew (about 200 MB for both at most).
KEPT_PIECES = 1_000_000
KEPT_WORDS = 500_000
#: Characters that are encoded at once.
GROUP_CHARS = 4_000_000
#: The pre-tokenizer's split, as given in the tokenizer file, and a piece of Latin-1 letters and then ASCII signs (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_AND_SIGNS = r"^(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-/:-@\[-`{-~]*)$"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


class Kept:
    """Ids of different strings: for the n-th string the n-th run of one flat array."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.keys = pa.concat_arrays([self.keys, keys])
        self.flat, self.starts, self.lengths = (np.concatenate(x) for x in ((self.flat, ids), (self.starts, starts), (self.lengths, lengths)))

    def numbers(self, keys: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each key; learn gives (lengths, ids) of those that are new."""
        if len(self.keys) > self.most:
            self.clear()
        found = pc.index_in(keys, value_set=self.keys)
        unknown = found.is_null().to_numpy(zero_copy_only=False)
        numbers = found.fill_null(0).to_numpy().astype(np.int64)
        if unknown.any():
            new = pc.dictionary_encode(keys.filter(pa.array(unknown)))
            numbers[unknown] = len(self.keys) + new.indices.to_numpy()
            self.add(new.dictionary, *learn(new.dictionary))
        return numbers


class Encoder:
    """ids of texts: uint32 arrays, equal to the library's encode(text, add_special_tokens=False).ids.

    New plain pieces go to the library in one call: the file's BPE model behind a split at white space, over the words
    that the pre-tokenizer would make of them; a word's last id is one with the end-of-word suffix.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # only for files of this very shape are plain pieces given to the model itself
        text = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.shaped = all(x in text for x in ("NFC", "Lowercase", "ByteLevel", r"\\p{L}]+|[\\p{N}]|[^\\s")) and spec["model"].get("end_of_word_suffix") == "</w>"
        self.plain = regex.compile(r"[!-~¡-¬®-ÿ]+").fullmatch
        self.split = regex.compile(SPLIT).findall
        self.letters = byte_letters()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.pieces = Kept(KEPT_WORDS), Kept(KEPT_PIECES)

    def pretokens(self, piece: str) -> list[str] | None:
        """Words that the pre-tokenizer makes of a plain piece; None for other pieces."""
        if not self.shaped or not self.plain(piece) or "<|" in piece:
            return None
        return self.split(piece.lower())

    def learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words.to_pylist())
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids

    def learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a word and signs are cut by Arrow, others one by one."""
        cut = pc.extract_regex(pieces, WORD_AND_SIGNS)
        simple = pc.and_(cut.is_valid(), pc.invert(pc.match_substring(pieces, "<|"))).to_numpy(zero_copy_only=False) & self.shaped
        word, signs = (cut.field(c).filter(pa.array(simple)) for c in ("word", "signs"))
        other = pieces.filter(pa.array(~simple)).to_pylist()
        split = [self.pretokens(p) for p in other]
        n, parts = len(word), [len(x or ()) for x in split]
        # all words at once: those of simple pieces, their signs (where there are any), the words of the other plain pieces
        has = pc.not_equal(signs, "").to_numpy(zero_copy_only=False)
        words = pa.concat_arrays([pc.utf8_lower(word), signs.filter(pa.array(has)), pa.array([w for x in split for w in x or ()], pa.string())])
        own = self.words
        numbers = own.numbers(words, self.learn_words)
        starts, lengths = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        for k, rows, at in ((0, slice(None), numbers[:n]), (1, has, numbers[n : n + has.sum()])):
            starts[rows, k], lengths[rows, k] = own.starts[at], own.lengths[at]
        ids, size = [gathered(own.flat, starts.ravel(), lengths.ravel())], np.zeros(len(pieces), np.int64)
        size[simple] = lengths.sum(1)
        rest, ends = [], np.cumsum(parts) + n + has.sum()
        for piece, words_, end, m in zip(other, split, ends.tolist(), parts, strict=True):
            at = numbers[end - m : end]
            rest.append(gathered(own.flat, own.starts[at], own.lengths[at]) if words_ is not None else np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint32))
        size[~simple] = [len(x) for x in rest]
        # back into the order of the pieces
        ids = np.concatenate([*ids, *rest])
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        starts_ = np.zeros(len(pieces), np.int64)
        starts_[order] = np.cumsum(size[order]) - size[order]
        return size, gathered(ids, starts_, size)

    def group(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        cut = pc.split_pattern(pc.replace_substring(pa.array([t or "" for t in texts], pa.string()), "\n", " "), " ")
        numbers = self.pieces.numbers(cut.values, self.learn)
        lengths = self.pieces.lengths[numbers]
        ids = gathered(self.pieces.flat, self.pieces.starts[numbers], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[cut.offsets.to_numpy()]
        return np.split(ids, ends[1:-1])

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """ids of each text, encoded GROUP_CHARS characters at a time."""
        own: list[str | None] = []
        size = 0
        for text in texts:
            own.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self.group(own)
                own, size = [], 0
        yield from self.group(own)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker and file; reused tasks find their pieces again."""
    return Encoder(path)
