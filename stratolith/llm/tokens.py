"""Encoding of Arrow texts with a public tokenizer, one distinct piece at a time."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a task remembers.
REMEMBERED = 1_000_000
#: Texts that are encoded together, and bytes of them; a longer text is alone.
TOGETHER = 4000
TOGETHER_BYTES = 12 << 20
#: Marks before a piece: it follows a line end, or it begins its text. Any other follows a blank.
_LINE, _FIRST = "\x01", "\x02"
#: A Latin word with plain punctuation behind it: two pre-tokens at most, whatever the tokenizer.
_PLAIN = "^(?P<head>[\x01\x02]?)(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<marks>[.,!&*$%#|]*)$"


def _byte_letters() -> list[str]:
    """Letters that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts that are encoded together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = max(1, min(TOGETHER, int(np.searchsorted(ends, before + TOGETHER_BYTES, side="right")) - at))
        yield batch.slice(at, n)
        at += n


class Ragged:
    """Many short runs of ids in a row."""

    def __init__(self, runs: list[bytes]) -> None:
        self.ids = np.frombuffer(b"".join(runs), "<u2")
        self.sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 2
        self.begins = np.cumsum(self.sizes) - self.sizes

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the runs in that order, where each ends)."""
        each = self.sizes[codes]
        ends = np.cumsum(each)
        return self.ids[np.repeat(self.begins[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode`` gives them, by words that each get encoded once.

    Texts are parted before single blanks and at single line ends. Between two
    characters that aren't white space, these always part pre-tokens
    (byte-level) or are dropped (word-level), so the pieces' ids in a row are
    the text's. Texts with blanks or line ends next to other white space, and
    texts that hold one of the tokenizer's added tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.lowers = self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        self.line = self.whole("\n")
        self.known: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with any of these are encoded whole: our own marks, and added tokens, which part a text wherever they stand.
        self.apart = "|".join(["[\x01\x02]", *map(re.escape, added)])

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens of Latin letters or punctuation, with the blank before them if there is one."""
        known, tokenize, out = self.known, self.tokenize, []
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            ids = known.get(word)
            if ids is None:
                text = word if word.isascii() and word[:1] != " " else "".join([self.letters[b] for b in word.encode()])
                ids = known[word] = array("H", [t.id for t in tokenize(text)]).tobytes()
            out.append(ids)
        return out

    def _odd(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces that aren't plain; None if their text must be encoded whole."""
        texts = []
        for piece in pieces:
            head, rest = (piece[0], piece[1:]) if piece[:1] in (_LINE, _FIRST) else (" ", piece)
            bad = not self.lowers and (not rest or rest[0].isspace() or rest[-1].isspace())
            texts.append(None if bad or head == _LINE and self.lowers else {" ": " ", _LINE: "\n", _FIRST: ""}[head] + rest)
        got = iter(self.tokenizer.encode_batch_fast([t for t in texts if t is not None], add_special_tokens=False))
        return [None if t is None else array("H", next(got).ids).tobytes() for t in texts]

    def _pieces(self, pieces: pa.Array) -> tuple[Ragged, np.ndarray]:
        """(ids of distinct pieces, which of them need their texts encoded whole)."""
        parts = pc.extract_regex(pieces, _PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        head, word, marks = (pc.fill_null(pc.struct_field(parts, i), "") for i in range(3))
        empty = pc.equal(word, "")
        if self.lowers:
            word, marks_word = pc.utf8_lower(word), marks
        else:
            # A blank belongs to what stands behind it: the word, or else the punctuation.
            blank = pc.if_else(pc.equal(head, ""), " ", "")
            word, marks_word = pc.binary_join_element_wise(blank, word, ""), pc.if_else(empty, pc.binary_join_element_wise(blank, marks, ""), marks)
        words = pc.if_else(empty, "", word).dictionary_encode()
        tails = pc.if_else(pc.equal(marks, ""), "", marks_word).dictionary_encode()
        odd = np.flatnonzero(~plain)
        odd_ids = self._odd(pieces.take(pa.array(odd)).to_pylist())
        runs = [b"", self.line, *self._words(words.dictionary.to_pylist()), *self._words(tails.dictionary.to_pylist()), *[x or b"" for x in odd_ids]]
        bad = np.zeros(len(pieces), dtype=bool)
        bad[odd] = [x is None for x in odd_ids]
        if not self.lowers:
            # Nothing between two blanks, or between a line end and the next white space.
            nothing = pc.and_(pc.and_(empty, pc.equal(marks, "")), pc.not_equal(head, _FIRST)).to_numpy(zero_copy_only=False)
            bad |= nothing & plain
        codes = np.zeros((len(pieces), 3), np.int64)
        codes[:, 0] = np.where(pc.equal(head, _LINE).to_numpy(zero_copy_only=False), 1, 0)
        codes[:, 1] = 2 + words.indices.to_numpy()
        codes[:, 2] = 2 + len(words.dictionary) + tails.indices.to_numpy()
        codes[odd] = 0
        codes[odd, 1] = len(runs) - len(odd) + np.arange(len(odd))
        made = Ragged(runs)
        ids, ends = made.take(codes.ravel())
        whole = Ragged([])
        whole.ids, whole.sizes = ids, np.diff(ends[2::3], prepend=0)
        whole.begins = ends[2::3] - whole.sizes
        return whole, bad

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, where each text's begin and the last's end); null texts are empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint16), np.zeros(1, np.int64)
        marked = pc.replace_substring(texts, "\n", " " if self.lowers else f" {_LINE}")
        lists = pc.split_pattern(pc.binary_join_element_wise(_FIRST, marked, ""), " ")
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        pieces, bad = self._pieces(coded.dictionary)
        out, ends = pieces.take(codes)
        bounds = np.concatenate([[0], ends])[at]
        redo = pc.match_substring_regex(texts, self.apart, ignore_case=self.lowers).to_numpy(zero_copy_only=False)
        if bad.any():
            redo = redo | (np.add.reduceat(bad[codes], at[:-1]) > 0)
        if redo.any():
            parts = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for row in np.flatnonzero(redo).tolist():
                parts[row] = np.frombuffer(self.whole(texts[row].as_py()), "<u2")
            out, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, bounds


def ended(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one ``end`` id behind each text."""
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
