"""Operator 8: quality rules over a suffix array of each text's words.

All documents of a batch share one suffix array: a word's first rank is made of
its document and itself, so suffixes of different documents never match. Prefix
doubling refines only the groups not yet told apart, and neighbours' longest common
prefixes follow in text order. The deepest LCP interval that holds a suffix is
max(left, right) words deep, and these intervals are the maximal repeated substrings. Their spans are united for each document, and the verdict
limits the covered fraction and the longest repeat.

Scale: one map over the documents, no shuffle; memory is that of ``BATCH_BYTES`` of
text or one document, some dozens of bytes a word.

Defined results: null and empty texts have no words, lines or symbols and fail
(fewer than 10 words); repeated rows are judged one by one; null doc_id is kept;
an empty table gives an empty result; other columns are ignored by ``analyse``
and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WINDOW = 5
#: Bytes of the texts that share a suffix array.
BATCH_BYTES = 1_250_000
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """Of the method's verdict; the base rules are those of the contract."""

    repeat_words: int = 10  # shorter repeats don't count
    covered_percent: int = 20  # of a document's words, in such repeats
    longest_words: int = 60  # a repeat this long fails if it is ...
    longest_percent: int = 10  # ... this part of the document


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """By prefix doubling: only places in groups that are not told apart yet are sorted again."""
    n = len(tokens)
    rank = np.zeros(n, dtype=np.int64)  # the first place of the group
    active, key, step = np.arange(n), tokens, 0
    while len(active):
        if step:
            key = rank[active] * (n + 1)
            inside = active < n - step
            key[inside] += rank[active[inside] + step] + 1
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(fresh)
        size = np.diff(start, append=len(key))
        old = rank[active[start]]
        first = np.ones(len(start), dtype=bool)
        first[1:] = old[1:] != old[:-1]
        new = old + start - np.maximum.accumulate(np.where(first, start, 0))
        rank[active] = np.repeat(new, size)
        active = active[np.repeat(size > 1, size)]
        step = max(1, 2 * step)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


def _shared(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens agree from each place of a and of b on."""
    n, out = len(tokens), np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    for _ in range(32):
        at, to = a[left] + out[left], b[left] + out[left]
        ok = np.maximum(at, to) < n
        ok[ok] = tokens[at[ok]] == tokens[to[ok]]
        left = left[ok]
        if not len(left):
            return out
        out[left] += 1
    for i in left.tolist():
        x, y, block = int(a[i] + out[i]), int(b[i] + out[i]), 64
        while max(x, y) < n:
            size = min(block, n - max(x, y))
            apart = np.flatnonzero(tokens[x : x + size] != tokens[y : y + size])
            if len(apart):
                x += int(apart[0])
                break
            x, y, block = x + size, y + size, 2 * block
        out[i] = x - a[i]
    return out


def suffix_lcp(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``tokens`` and the longest common prefix of each neighbouring pair.

    In the order of the text a prefix is one shorter than the one before it wherever the
    tokens before both places agree. Only the others are compared; their lengths add up to
    n log n at most, so memory is a few arrays of n whatever repeats.
    """
    n = len(tokens)
    before, suffixes = np.full(n, -1, dtype=np.int64), suffix_array(tokens)
    before[suffixes[1:]] = suffixes[:-1]
    follows = np.zeros(n, dtype=bool)
    at = np.flatnonzero(before > 0)
    at = at[at > 0]
    follows[at] = tokens[at - 1] == tokens[before[at] - 1]
    anew = np.flatnonzero(~follows & (before >= 0))
    lcp = np.zeros(n, dtype=np.int64)
    lcp[anew] = _shared(tokens, anew, before[anew])
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return suffixes, (lcp[last] - (np.arange(n) - last))[suffixes[1:]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def analyse_batch(texts: list[bytes], limits: Limits) -> list[dict]:
    known: dict[bytes, int] = defaultdict(count().__next__)
    rows, ids = [], []
    for data in texts:
        ids.append(np.concatenate([np.empty(0, np.int64), *(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)) for words in common.word_blocks(data))]))
        seen, repeated = set(), 0
        for line in data.split(b"\n"):
            if line.strip(SPACE):
                repeated += line in seen
                seen.add(line)
        rows.append({"n_words": len(ids[-1]), "word_chars": len(data.translate(None, SPACE + _CONTINUED)), "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": repeated})
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = len(doc)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    longest = np.zeros(n, dtype=np.int64)
    if n:
        suffixes, lcp = suffix_lcp(doc * len(known) + np.concatenate(ids))
        around = np.concatenate([[0], lcp, [0]])
        longest[suffixes] = np.maximum(around[:-1], around[1:])
    windows, repeats = np.flatnonzero(longest >= WINDOW), np.flatnonzero(longest >= limits.repeat_words)
    in_window = np.concatenate([[0], np.cumsum(covered(windows, windows + WINDOW, n))])
    spans = covered(repeats, repeats + longest[repeats], n)
    in_span = np.concatenate([[0], np.cumsum(spans)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], spans, [False]]).astype(np.int8)))
    # a span may go on into the next document's: cut there
    edge_docs = defaultdict(list)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        while a < b:
            d = int(doc[a])
            e = min(int(b), int(bounds[d + 1]))
            edge_docs[d].append({"first": int(a - bounds[d]), "words": int(e - a)})
            a = e
    for d, row in enumerate(rows):
        a, b, words = bounds[d], bounds[d + 1], row["n_words"]
        row["n_repeat_words"] = int(in_window[b] - in_window[a])
        row["covered_words"] = int(in_span[b] - in_span[a])
        row["longest_repeat"] = int(longest[a:b].max(initial=0))
        row["spans"] = edge_docs.get(d, [])
        row["base_failed"] = words < 10 or 100 * row["n_repeat_words"] > 20 * words
        long_repeat = row["longest_repeat"] >= limits.longest_words and 100 * row["longest_repeat"] > limits.longest_percent * words
        row["kept"] = not (row["base_failed"] or 100 * row["covered_words"] > limits.covered_percent * words or long_repeat)
    return rows


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
_VERDICT = [(c, pa.int64()) for c in _COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, spans array<struct<first:long,words:long>>"
_ARROW = pa.schema([("doc_id", pa.int64()), *_VERDICT])


def _texts(column: pa.Array) -> list[bytes]:
    return [(text.as_py() or "").encode() for text in column]


def analyse(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts, spans and verdict of each document (doc_id, text)."""

    def run(batches):
        for batch in common.sliced(batches, 1, BATCH_BYTES):
            rows = analyse_batch(_texts(batch.column(1)), limits)
            yield pa.RecordBatch.from_pylist([{"doc_id": i} | r for i, r in zip(batch.column(0).to_pylist(), rows, strict=True)], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns; text is column ``text``."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in common.sliced(batches, at, BATCH_BYTES):
            yield batch.filter(pa.array([r["kept"] for r in analyse_batch(_texts(batch.column(at)), limits)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
