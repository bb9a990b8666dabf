"""Operator 10: licence scan.

Words are runs of letters, digits and characters beyond ASCII; A-Z count as
a-z. An Aho-Corasick automaton over the space-joined words finds notice phrases
and identifier tags in one pass; behind each tag, a shunting-yard parser evaluates
the and/or/with expression on its line or, if nothing follows there, the next.
One map over the documents, no shuffle; time is linear in a text, whatever it repeats.

Defined results: a null or empty text has no words and no labels and scores 0;
overlapping and repeated places all count; repeated rows are scanned one by one;
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: Tags that a licence expression follows.
TAGS = ("spdx license identifier", "license expression")

#: Licences that an expression may grant for the text to count as free to use.
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})

_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BLANKS = re.compile(rb" +")
_AFTER_TAG = re.compile(rb"[^0-9A-Za-z(\n]*(?:\n[^0-9A-Za-z(\n]*)?([^\n]*)")  # the rest of the line or, if that is blank, the next line
_TOKEN = re.compile(r"\(|\)|[0-9A-Za-z][0-9A-Za-z.+\-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}
_KNOWN_ID = re.compile(r"(?:licenseref-[0-9a-z.\-]+|[0-9a-z]+(?:[.\-][0-9a-z]+)*\+?)$")


def read_expression(text: str) -> list[str]:
    """The longest start of ``text`` that is an expression, as tokens; operators are lower case."""
    out: list[str] = []
    depth, want, whole = 0, True, 0
    for match in _TOKEN.finditer(text):
        token = match[0].lower()
        if want and token == "(":
            depth += 1
        elif want and token not in _BINDS and token != ")" and _KNOWN_ID.match(token):
            want = False
        elif not want and token in _BINDS:
            want = True
        elif not want and token == ")" and depth:
            depth -= 1
        else:
            break
        out.append(token)
        if not want and not depth:
            whole = len(out)
    return out[:whole]


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: with binds before and, and before or; all to the left."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def _joined(a: set[str], b: set[str]) -> set[str]:
    """The union, made by adding to the larger set: long expressions would copy it again and again."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a |= b
    return a


def evaluate(text: str, allowed: frozenset[str] = ALLOWED) -> tuple[list[str], bool] | None:
    """Licences that an expression names and whether it can be met by allowed ones; None if there is none."""
    stack: list[tuple[set[str], bool]] = []
    for token in to_postfix(read_expression(text)):
        if token not in _BINDS:
            stack.append(({token}, token in allowed))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # an exception names no licence and takes nothing away
            stack.append(left)
        elif token == "and":
            stack.append((_joined(left[0], right[0]), left[1] and right[1]))
        else:
            stack.append((_joined(left[0], right[0]), left[1] or right[1]))
    return (sorted(stack[0][0]), stack[0][1]) if stack else None


@lru_cache(4)
def _automaton(notices: tuple[tuple[str, str, bool], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label, base in notices:
        key = f" {phrase} "
        found.add_word(key, (phrase.count(" ") + 1, label, base))
    for tag in TAGS:
        found.add_word(f" {tag} ", (tag.count(" ") + 1, None, False))
    found.make_automaton()
    return found


def scan_text(data: bytes, notices: tuple[tuple[str, str, bool], ...]) -> dict:
    line = b" " + _BLANKS.sub(b" ", data.translate(_WORD_TABLE)).strip() + b" "
    line = line.decode("latin-1") if line != b"  " else " "
    n_words = line.count(" ") - 1
    found, firsts, sizes, base, tags = [], [], [], set(), []
    n_base, first_base, last_base = 0, None, None
    seen = n_spaces = 0
    for end, (size, label, is_base) in _automaton(notices).iter(line):
        n_spaces += line.count(" ", seen, end + 1)
        seen = end + 1
        first = n_spaces - size - 1  # a word's number is that of the space before it
        if label is None:
            tags.append((first, first + size - 1))
            continue
        found.append(label)
        firsts.append(first)
        sizes.append(size)
        if is_base:
            base.add(label)
            n_base += 1
            first_base = first if first_base is None else min(first, first_base)
            last_base = first if last_base is None else max(first, last_base)
    labels, granted, expressions = set(found), None, []
    if tags:
        starts, ends = _word_places(data.translate(_WORD_TABLE))
        limits = [int(starts[first]) for first, _ in tags[1:]] + [len(data)]
        for (_, last), limit in zip(tags, limits, strict=True):
            at = int(ends[last])
            text = _AFTER_TAG.match(data, at, max(limit, at))[1].decode("utf-8", "replace")
            value = evaluate(text)
            if value:
                labels.update(value[0])
                granted = value[1] if granted is None else granted and value[1]
                expressions.append(" ".join(read_expression(text)))
    return {
        "n_words": n_words, "n_base": n_base, "first_word": first_base, "last_word": last_base, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
        "score": 1.0 if expressions else 1.0 - 0.5 ** len(found), "spans": (found, firsts, sizes), "expressions": expressions, "allowed": granted,
    }


def _word_places(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it."""
    inside = np.frombuffer(plain, dtype=np.uint8) != 32
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long>>, expressions array<string>, allowed boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS), ("expressions", pa.list_(pa.string())), ("allowed", pa.bool_())])


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Scan ``docs`` (doc_id, text) for the ``base`` phrases and further ``notices``; phrases are lower-case words joined by a space."""
    base = BASE_PHRASES if base is None else base
    notices = NOTICE_PHRASES if notices is None else notices
    table = tuple([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items() if p not in base])

    def run(batches):
        for batch in common.sliced(batches, 1):
            rows = [scan_text((text.as_py() or "").encode(), table) for text in batch.column(1)]
            counts = np.cumsum([0, *(len(r["spans"][0]) for r in rows)])
            parts = [pa.array([x for r in rows for x in r["spans"][i]], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            spans = pa.ListArray.from_arrays(pa.array(counts, type=pa.int32()), pa.StructArray.from_arrays(parts, names=["label", "first", "words"]))
            columns = [spans if f.name == "spans" else pa.array([r[f.name] for r in rows], type=f.type) for f in list(_ARROW)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
