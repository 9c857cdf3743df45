"""Operator 4: secret scans with a trigram inverted index per shard."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolith.storage import unused

try:
    from re import _parser as sre
except ImportError:  # pragma: no cover - older Python
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where it stands (the group ``span``), and how long its value (a group) must be."""

    kind: str
    pattern: str
    group: int
    least: int
    flags: int = 0
    base: bool = False
    span: int = 0


#: The base kinds in their order, then the kinds of our own.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.IGNORECASE, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, 0, True),
    Rule("private_key", r"-----BEGIN ([A-Z ]*PRIVATE KEY(?: BLOCK)?)-----", 0, 1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    # A token may follow any character; only the first eyJ of a run is tried, as a later one can't match where it doesn't.
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ[A-Za-z0-9_-]))(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)", 1, 30, span=1),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("live_key", r"sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_login", r"://([^/\s:@]++:[^/\s:@]{3,}+)@", 0, 1, span=1),
)
_KEY_END = re.compile(r"-----END ([A-Z ]*PRIVATE KEY(?: BLOCK)?)-----")
#: What may stand between the lines of a key: white space, its escapes in source code, quotes and marks of quoted lines.
_GAP = r"""(?:\s|\\+[nrt]|["'`,>|#*])"""
#: A key without its END line: armour headers, then long base64 words, and short ones unless they are plain words with more prose behind them.
_KEY_BODY = re.compile(
    rf"""(?:{_GAP}*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID|X-[A-Za-z-]+):[^\r\n\\]*+)*+
    (?:{_GAP}*+(?:[A-Za-z0-9+/=]{{16,}}+|(?!(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[ \t]*[^\sA-Za-z0-9+/="'`\\]|(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[ \t]+[^\s"'`\\])(?<!\n\n)(?<!\n\r\n)[A-Za-z0-9+/=]{{1,15}}+))*+""",
    re.VERBOSE,
)
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A choice with more strings than this isn't spelt out; the query then gets weaker, never wrong.
_SPELT = 32

Query = frozenset[frozenset[int]]  #: any of these sets of trigrams, each needed in full; {{}} says nothing


def _codes(word: str) -> frozenset[int]:
    data = word.encode().translate(_FOLD)
    return frozenset(data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2))


def _spell(items) -> set[str]:
    """All strings that a part of a regex can stand for, with "\\0" for what isn't known."""
    texts = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg)} if 0 < arg < 128 else {"\0"}
        elif name == "SUBPATTERN":
            more = _spell(arg[3])
        elif name == "BRANCH":
            more = set().union(*map(_spell, arg[1]))
        elif name == "IN" and all(str(o) == "LITERAL" and 0 < a < 128 for o, a in arg) and len(arg) <= 8:
            more = {chr(a) for _, a in arg}
        elif name == "MAX_REPEAT" and arg[1] == 1 and arg[0] == 0:
            more = {"", *_spell(arg[2])}
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            # The first repeat is sure; what follows isn't known.
            more = {x + "\0" for x in _spell(arg[2])}
        else:
            more = {"\0"}
        if len(texts) * len(more) > _SPELT:
            more = {"\0"}
        texts = {a + b for a in texts for b in more}
    return texts


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """A Boolean query over trigrams that every text with a match fulfils.

    The regex is spelt out into alternatives; of each, the known stretches'
    trigrams are all needed. An alternative without a trigram makes the query
    say nothing (the empty set in it), and the rule scans fully.
    """
    found = {frozenset().union(*(_codes(x) for x in text.split("\0"))) for text in _spell(sre.parse(pattern, flags | re.ASCII))}
    return frozenset(x for x in found if not any(y < x for y in found))


class Shard:
    """Postings of a batch of texts: for each trigram that the rules ask for, the texts that hold it."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray) -> None:
        self.size = len(texts)
        self.postings: dict[int, np.ndarray] = defaultdict(lambda: np.empty(0, np.int64))
        data = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for i in range(0, max(len(data) - 2, 0), 1 << 20):
            part = data[i : i + (1 << 20) + 2].astype(np.uint32)
            codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(wanted[codes])
            pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at + i, side="right"))
            if not len(pairs):
                continue
            keys, starts = np.unique(pairs >> 32, return_index=True)
            for k, rows in zip(keys.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:]), strict=True):
                found[k].append(rows)
        for k, rows in found.items():
            self.postings[k] = np.unique(np.concatenate(rows))

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that may match: postings intersected within an alternative, united over all."""
        if frozenset() in query:
            return np.arange(self.size)
        rows = [np.empty(0, np.int64)]
        for needed in query:
            lists = sorted((self.postings[c] for c in needed), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = np.intersect1d(both, other, assume_unique=True)
            rows.append(both)
        return np.unique(np.concatenate(rows))


def _key_spans(begins: list[re.Match], text: str) -> list[tuple[int, int]]:
    """Each private key from its header to its END line, which comes before the next header; without one, to the end of its base64 block."""
    ends = list(_KEY_END.finditer(text)) if begins else []
    places, spans = [e.start() for e in ends], []
    for begin, limit in zip(begins, [*[b.start() for b in begins[1:]], len(text)], strict=True):
        mine = ends[bisect_left(places, begin.end()) : bisect_left(places, limit)]
        # The first with the header's own label, or else the first of any private key.
        end = next((e for e in mine if e[1] == begin[1]), mine[0] if mine else None)
        spans.append((begin.start(), end.end() if end else _KEY_BODY.match(text, begin.end()).end()))
    return spans


def _spans(pattern: re.Pattern, rule: Rule, text: str) -> list[tuple[int, int]]:
    if rule.kind == "private_key":
        return _key_spans(list(pattern.finditer(text)), text)
    return [m.span(rule.span) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _batches(rules: tuple[Rule, ...], names: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rule, re.compile(rule.pattern, rule.flags | re.ASCII), trigram_query(rule.pattern, rule.flags)) for rule in rules]
        wanted = np.zeros(1 << 24, dtype=bool)
        wanted[[c for _, _, q in compiled for needed in q for c in needed]] = True
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = [t or "" for t in batch.column(0).to_pylist()]
                shard = Shard([t.encode("utf-8", "surrogatepass") for t in texts], wanted)
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k, (rule, pattern, query) in enumerate(compiled):
                    for row in shard.candidates(query).tolist():
                        found[row] += [(start, k, end) for start, end in _spans(pattern, rule, texts[row])]
                spans = [sorted(x) for x in found]
                out = [pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in spans], _SPANS)]
                if len(names) > 1:
                    out.append(pa.array([_redacted(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
                rest = [batch.column(j) for j in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*out, *rest], [*names, *batch.schema.names[1:]])

    return task


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "[REDACTED]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, redact: bool = False, spans: str = "spans", redacted: str = "redacted") -> DataFrame:
    """``docs`` without text, with a column ``spans`` (kind, start, end by start, then kind as listed), and ``redacted`` on request.

    Offsets count code points; the end is exclusive. For each kind the
    leftmost matches that don't overlap are taken, then those with too short a
    value dropped. A private key runs from its header to its END line, or to
    the end of its base64 block where there is none. Each shard of 1,000 texts
    gets its own inverted index, so memory is bounded and no row moves. Null
    and empty texts have no span. Repeated rows stay repeated; an empty table
    gives an empty result; the other columns pass unchanged, but for those
    with the names of the results, which give way to them.
    """
    made = [spans, *[redacted] * redact]
    names = [c for c in docs.columns if c not in (*made, "text")]
    inner = docs.select(docs["text"].alias(unused(docs, "body")), *[docs[c] for c in names])
    kinds = ["array<struct<kind:string,start:bigint,end:bigint>>", *["string"] * redact, *[docs.schema[c].dataType.simpleString() for c in names]]
    return inner.mapInArrow(_batches(rules, made), ", ".join(f"`{c}` {kind}" for c, kind in zip([*made, *names], kinds, strict=True)))


def joined(spans) -> F.Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
