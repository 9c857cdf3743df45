"""Operator 8: licence scans with Aho-Corasick and a shunting-yard expression parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratolith.storage import unused

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Our own notice phrases (words as in a text's word list), with their labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx-license-identifier:"
#: Chance that a text with this evidence is licensed so: a tag says it outright, a notice nearly so, a bare name less.
_WEIGHT = {"tag": 0.95, "notice": 0.8, "base": 0.6}
_PERMISSIVE = re.compile(r"(?i)^(mit|isc|zlib|unlicense|cc0|0bsd|bsl|boost|apache|bsd|cc-by(-\d|$)|public-domain)")
_WORDS = bytes(c if chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)) + bytes(range(128, 256))
_ID = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """A licence expression that can't be read."""


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: WITH binds closest, then AND, then OR; operators in either case."""
    out, stack, operand = [], [], True
    for token in _ID.findall(expression):
        word = token.lower()
        if word in _RANK:
            if operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ExpressionError(expression)
            stack.append(token)
        elif token == ")":
            if operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(expression)
            stack.pop()
        else:
            if not operand:
                raise ExpressionError(expression)
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ExpressionError(expression)
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], bool]:
    """(identifiers in lower case, whether one may use the text under permissive terms alone).

    OR offers a choice, AND demands both, WITH keeps the licence and adds an exception.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in to_postfix(expression):
        if token in _RANK:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{x}-with-{y}" for x in a for y in b}, free_a))
            else:
                # The smaller into the larger, so that long expressions take little more than linear time.
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
                stack.append((a, free_a or free_b if token == "or" else free_a and free_b))
        else:
            stack.append(({token.lower()}, bool(_PERMISSIVE.match(token))))
    return frozenset(stack[0][0]), stack[0][1]


def _expression_at(text: str, start: int) -> str:
    """The longest readable expression behind a tag, on its line."""
    end = text.find("\n", start)
    kept, depth, operand = [], 0, True
    for found in _ID.finditer(text, start, len(text) if end < 0 else end):
        token = found[0]
        word = token.lower()
        if word in _RANK:
            if operand:
                break
            operand = True
        elif token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        else:
            if not operand:
                break
            operand = False
        kept.append(token)
    while kept and kept[-1].lower() in (*_RANK, "("):
        depth -= kept[-1] == "("
        kept.pop()
    return " ".join([*kept, *[")"] * depth])


def words_of(text: str) -> str:
    """The words, with a blank before, between and after them; A-Z lower-cased."""
    return (b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORDS).split()) + b" ").decode("utf-8", "surrogatepass")


class Scanner:
    """One automaton for the word phrases and one for the identifier tag."""

    def __init__(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for kind, table in (("base", BASE), ("notice", NOTICES)):
            for phrase, label in table.items():
                key = f" {phrase} "
                found = self.phrases.get(key, [])
                self.phrases.add_word(key, [*found, (kind, label, len(key))])
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        self.tags.add_word(TAG, len(TAG))
        self.tags.make_automaton()

    def scan(self, text: str) -> dict:
        line = words_of(text)
        n_words = line.count(" ") - 1 if line != "  " else 0
        base: list[tuple[int, str]] = []
        chances: dict[str, float] = {}
        for end, found in self.phrases.iter(line):
            for kind, label, size in found:
                chances[label] = max(chances.get(label, 0.0), _WEIGHT[kind])
                if kind == "base":
                    base.append((end - size + 1, label))
        starts = [line.count(" ", 0, at) for at in ({min(base)[0], max(base)[0]} if base else ())]
        permissive = None
        # Only A-Z may change, or the places would shift.
        low = text.lower()
        if len(low) != len(text):
            low = text.translate(_LOWER)
        for end, _ in self.tags.iter(low):
            try:
                names, free = evaluate(_expression_at(text, end + 1))
            except ExpressionError:
                continue
            permissive = free if permissive is None else permissive and free
            for name in names:
                chances[name] = _WEIGHT["tag"]
        base_labels = {label for _, label in base}
        return {
            "n_words": n_words,
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | set(chances))),
            "score": 1.0 - float(np.prod([1.0 - p for p in chances.values()])) if chances else 0.0,
            "permissive": permissive,
        }


_LOWER = {c: c + 32 for c in range(65, 91)}
_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permissive": pa.bool_()}
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of ``docs`` with what the scan of each whole text finds.

    n_base counts every place where a base phrase's words stand in a row,
    overlapping ones too; first_word and last_word are the least and greatest
    start of them. labels adds those of notice phrases and of the identifiers
    in tagged licence expressions; expressions that can't be read add none.
    score is the chance that the text is licensed by any of them; permissive
    says whether all its expressions can be met with permissive terms (null
    without one). Null and empty texts have no words. Repeated rows stay
    repeated; an empty table gives an empty result; input columns with the
    names of results give way to them.
    """
    names = [c for c in docs.columns if c not in (*_FIELDS, text)]
    inner = docs.select(docs[text].alias(unused(docs, "body")), *[docs[c] for c in names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t or "") for t in batch.column(0).to_pylist()]
            found = [pa.array([r[f] for r in rows], kind) for f, kind in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], *found], [*batch.schema.names[1:], *_FIELDS])

    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], _DDL])
    return inner.mapInArrow(each, fields)
