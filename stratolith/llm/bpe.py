"""Operator 11: byte-level BPE by replaying a vocabulary's merges over all words at once, and decoding."""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Distinct words that a task remembers.
REMEMBERED = 250_000
#: Texts whose words are encoded together.
TOGETHER = 1000
#: A rank beyond all others: the pair doesn't merge.
_NEVER = np.int64(1) << 40
_LOW = (np.int64(1) << 32) - 1


class Vocabulary:
    """A rank file: a token's id is its rank, and two neighbours merge at the rank of the bytes that they form together."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        #: No token has these ids: ``wall`` stands between words.
        self.wall = max(self.bytes_of, default=0) + 1
        self.width = self.wall + 1
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.singles = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks at which these pairs merge."""
        if not len(self.keys):
            return np.full(len(left), _NEVER)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NEVER)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers.

        All words lie in one sequence with walls between them. An inverted
        index leads from each rank to the positions whose pair has it. Ranks
        are taken in order, all positions of one at a time, and only the pairs
        on both sides of what merged are looked up and filed anew. Should such
        a pair have a rank that has passed (its word would have taken it
        before the next merge), the word is encoded once more on its own.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        token = self.singles[raw]
        walls = ends - 1
        token[walls] = self.wall
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        now = np.full(n, _NEVER)  # the rank of the pair that begins here
        now[:-1] = self.rank(token[:-1], token[1:])
        postings: dict[int, list[np.ndarray]] = {}

        def file(ranks: np.ndarray, at: np.ndarray) -> None:
            both = np.sort(ranks << 32 | at)
            ranks, at = both >> 32, both & _LOW
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                rank = int(ranks[a])
                if rank in postings:
                    postings[rank].append(at[a:b])
                else:
                    postings[rank] = [at[a:b]]
                    heappush(heap, rank)

        heap: list[int] = []
        first = np.flatnonzero(now < _NEVER)
        if len(first):
            file(now[first], first)
        heapify(heap)
        late: set[int] = set()
        while heap:
            rank = heappop(heap)
            lists = postings.pop(rank)
            left = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left = left[now[left] == rank]
            right = after[left]
            if len(left) > 1 and (linked := left[1:] == right[:-1]).any():
                # Pairs that overlap: the leftmost merges, the next doesn't, and so on.
                place = np.arange(len(left))
                begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~linked]), place, 0))
                left = left[(place - begins) % 2 == 0]
                right = after[left]
            if not len(left):
                continue
            beyond = after[right]
            if (side := np.flatnonzero(beyond[:-1] == left[1:])).size:
                # For a moment the first of two that merge side by side has the second's left token behind it.
                passed = self.rank(np.full(len(side), rank), token[left[1:][side]]) < rank
                late.update(np.searchsorted(ends, left[side[passed]], side="right").tolist())
            token[left] = rank
            now[right] = _NEVER
            after[left], before[beyond] = beyond, left
            now[left] = -1
            behind = before[left]
            behind = behind[(token[behind] != self.wall) & (now[behind] != -1)]
            touched = np.concatenate([left, behind])
            ranks = self.rank(token[touched], token[after[touched]])
            now[touched] = ranks
            passed = ranks < rank
            if passed.any():
                late.update(np.searchsorted(ends, touched[passed], side="right").tolist())
            filed = (ranks < _NEVER) & ~passed
            if filed.any():
                file(ranks[filed], touched[filed])
        # What lives is what walking from each word's first byte meets: every position but those merged into their left.
        alive = np.ones(n, bool)
        alive[walls] = False
        alive[1:] &= after[before[1:]] == np.arange(1, n)
        ids = token[alive].astype("<u4")
        counts = np.cumsum(alive)[walls].tolist()
        out = [ids[a:b].tobytes() for a, b in zip([0, *counts[:-1]], counts, strict=True)]
        for word in late:
            out[word] = self.strict(words[word])
        return out

    def strict(self, word: bytes) -> bytes:
        """One word by always merging its lowest pair, the leftmost of equal ones."""
        token = [self.ranks[bytes([b])] for b in word]
        n = len(token)
        after, before, get, width = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get, self.width
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := get(token[i] * width + token[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i, left, right = heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((i, after[i]), (before[i], i)):
                if a >= 0 and b < n and (r := get(token[a] * width + token[b])) is not None:
                    heappush(heap, (r, a, token[a], token[b]))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of whole texts; each distinct word is encoded once.

    A text is parted before its single blanks, where a match of the pattern
    always begins if no white space stands before the blank. Texts where it
    does, or where two blanks meet, are matched whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary, self.find = vocabulary(path), regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}

    def learn(self, found: list[list[str]]) -> None:
        """Encode the words that aren't known yet, all in one replay."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = list({w: None for words in found for w in words if w not in self.words})
        ranks, missing = self.vocabulary.ranks, []
        for word in new:
            data = word.encode()
            rank = ranks.get(data)
            if rank is None:
                missing.append((word, data))
            else:
                self.words[word] = rank.to_bytes(4, "little")
        self.words.update(zip([w for w, _ in missing], self.vocabulary.replay([d for _, d in missing]), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        self.learn(found)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in found]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, where each text's begin and the last's end); null texts are empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, at = lists.flatten(), at - at[0]
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        blank = pa.array(["", " "]).take(pa.array(np.where(first, 0, 1)))
        coded = pc.binary_join_element_wise(blank, flat, "").dictionary_encode()
        parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        runs = self._ids(parts)
        open_ = np.fromiter((p[-1:].isspace() for p in parts), bool, len(parts))[codes]
        open_[at[1:] - 1] = False  # nothing follows a text's last part
        whole = np.flatnonzero(np.add.reduceat(open_, at[:-1]))
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        each = sizes[codes]
        ends = np.cumsum(each)
        begins = (np.cumsum(sizes) - sizes)[codes] - (ends - each)
        ids = np.frombuffer(b"".join(runs), "<u4")[np.repeat(begins, each) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[at]
        if len(whole):
            rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for row, data in zip(whole.tolist(), self._ids([texts[r].as_py() for r in whole.tolist()]), strict=True):
                rows[row] = np.frombuffer(data, "<u4")
            ids, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, bounds


def others(df: DataFrame, name: str, *dropped: str) -> tuple[DataFrame, str]:
    """(column ``name`` first, then the others but ``dropped``, whatever they are called; the others' DDL)."""
    kept = [c for c in df.columns if c not in (name, *dropped)]
    quoted = {c: f"`{c.replace('`', '``')}`" for c in [name, *kept]}
    ddl = "".join(f"{quoted[c]} {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(F.col(quoted[name]).alias("_0"), *[F.col(quoted[c]).alias(f"_{i}") for i, c in enumerate(kept, 1)]), ddl


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``TOGETHER`` texts, or fewer longer ones."""
    for batch in batches:
        for part in slices(batch, 0):
            for i in range(0, part.num_rows, TOGETHER):
                yield part.slice(i, TOGETHER)


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each text as binary."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])


def _decoded(packed: pa.Array, path: str) -> pa.Array:
    token = vocabulary(path).bytes_of.__getitem__
    return pa.array([b"".join(map(token, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else b"" for x in packed], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` but its text, and the ids of each whole text as the tiktoken library gives them.

    ``ids`` is binary: little-endian unsigned 32-bit integers in a row. With a
    name for it, ``decoded`` has the bytes that those ids stand for once more
    (see ``decode``). Every match of ``pattern`` is encoded separately; strings
    of special tokens are ordinary text. The distinct words of a part of a
    task's texts (``TOGETHER``, or one long text) are encoded together.
    Null and empty texts have no ids. Repeated rows stay repeated, an empty
    table gives an empty result, and columns called like results give way.
    The pattern's classes are those of the ``regex`` library.
    """
    results = [ids] if decoded is None else [ids, decoded]
    rows, ddl = others(docs, text, *results)
    names = [c for c in docs.columns if c not in (text, *results)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for part in _parts(batches):
            packed = _packed(*encoder.encode(part.column(0)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], packed, *([] if decoded is None else [_decoded(packed, path)])], [*names, *results])

    return rows.mapInArrow(each, ddl + ", ".join(f"`{r}` binary" for r in results))


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``rows``, and the bytes that the ids of each stand for (binary).

    Null or no ids give no bytes; an id that the vocabulary lacks is an error.
    A column called like ``decoded`` gives way.
    """
    inner, ddl = others(rows, ids, decoded)
    names = [c for c in rows.columns if c not in (ids, decoded)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], part.column(0), _decoded(part.column(0), path)], [*names, ids, decoded])

    return inner.mapInArrow(each, f"{ddl}`{ids}` binary, `{decoded}` binary")
