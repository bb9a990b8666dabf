"""Operator 1: packing documents into token sequences.

Documents become token ids and an end id. Longer ones than ``capacity`` are cut
from the end, so that only the first piece may be shorter. Packing follows the
linear grouping scheme: long pieces, sorted by length, fall into groups of equal
cardinality and are rounded up to their group's longest; the few sizes left are
packed by optimal configurations (column generation over a knapsack); the pieces
themselves take the rounded ones' places; the rest goes by best fit.

Scale: lengths are whole numbers up to ``capacity``, so the plan needs only the
histogram of lengths, at most ``capacity`` rows for any corpus, and is itself
run-length coded: a row says that pieces of one length with ranks r to r+n fill
sequences b onward at one offset. The driver never sees a piece. Ranks within a
length come from buckets of row numbers, so a length that a third of all pieces
share, or a doc_id that all do, is dealt over many tasks. Tokens are made once, texts are never shuffled, and the
small rows that remain are checkpointed.

Defined results: null and empty texts are the end id alone; repeated rows are
packed one by one; null doc_id is kept; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# --- tokens ---------------------------------------------------------------

#: A space that a word doesn't follow, and the spaces that one does.
_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
#: A space between two words.
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Entries of a worker's cache of words; it starts anew beyond.
CACHE_WORDS = 600_000
#: Parts (a word with the white space behind it) of more characters aren't cached; runs of more white space are split here, not in tiktoken.
LONG_PART = 512
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANK = regex.compile(_BLANK + "{512}")
# Fixed value: the public split pattern of byte-level BPE; {0} is white space, {1} anything else, {2} white space within a class.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\p{{L}}\p{{N}}{2}]+|{0}+(?!{1})|{0}+"
_PIECE = regex.compile(_SPLIT.format(_BLANK, "[^" + _BLANK[1:], _BLANK[1:-1]))
#: Characters of a text that are split at a time.
BLOCK_CHARS = 1 << 20


class _Words(dict):
    """' word' -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= LONG_PART:
            self[word] = ids
        return ids


def _blocks(text: str, size: int = BLOCK_CHARS):
    """Pieces of a text of about ``size`` characters, each beginning before a space that stands between two words."""
    at = 0
    while at < len(text):
        found = _PLAIN_SPACE.search(text, at + size) if len(text) - at > size else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class TextEncoder:
    """Ids of a byte-level BPE vocabulary in a ``tokenizers`` JSON file.

    No token of such a vocabulary spans the place before a space that a
    non-space follows, so the ids of a text are those of its parts between such
    places, and each distinct part is encoded once a worker. Parts are encoded with
    the file's own merges as ranks, texts that hold a special token's string by the
    ``tokenizers`` library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        of_char = {chr(b): b for b in shown}
        of_char |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in of_char.values())}
        ranks = {bytes(of_char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("words", pat_str=_SPLIT.format(r"\s", r"\S", r"\s"), mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.part)

    def part(self, text: str) -> bytes:
        if len(text) > LONG_PART and _LONG_BLANK.search(text):
            return b"".join(np.array(self.bpe._encode_single_piece(p[0]), dtype="<u4").tobytes() for p in _PIECE.finditer(text))
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self._block, _blocks(text)))

    def _block(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        first, *rest = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return self.part(first) + b"".join(map(self.words.__getitem__, rest))


@lru_cache(2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    names += [("ids", pa.list_(pa.int32()))] if with_ids else []
    arrow = pa.schema(names)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in common.sliced(batches, 1):
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(encode(text.as_py() or "") + end)
                n = len(data) // 4
                at = 0
                for piece in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    part = data[4 * at : 4 * (at + size)]
                    row = [doc_id, piece, at, size, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, dtype="<u4").astype("i4"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(out, names, strict=True)], schema=arrow)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the plan, from the histogram -----------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int, gap: float = 1e-4) -> list[tuple[list[int], float]]:
    """Gilmore-Gomory: (items of each size, how often) that cover the demand with the fewest sequences, fractionally.

    Ends at the optimum, or once the prices prove that under half a sequence or a part ``gap`` of all can
    be gained (no solution takes fewer than their total over the best column's value). The demand that
    chooses what leaves is raised a little, by another amount for each size, so each exchange is a gain.
    """
    m = len(sizes)
    s, b = np.array(sizes), np.array(demand, dtype=float)
    raised = b + 1e-6 * (1 + np.arange(m)) / m
    basis = np.diag((capacity // s).astype(float))
    at = np.arange(capacity + 1)[:, None] - s[None, :]
    fits, at = at >= 0, np.maximum(at, 0)
    while True:
        dual = np.linalg.solve(basis.T, np.ones(m))
        best, picks = np.zeros(capacity + 1), []
        while True:
            value = np.where(fits, best[at] + np.maximum(dual, 0), -1.0)
            pick = value.argmax(1)
            new = value[np.arange(capacity + 1), pick]
            better = new > best + 1e-12
            if not better.any():
                break
            picks.append(np.where(better, pick, -1))
            best = np.where(better, new, best)
        total = float(raised @ dual)
        if best[capacity] <= 1 + 1e-7 or total - total / best[capacity] < max(0.5, gap * total):
            break
        column, c = np.zeros(m), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= s[pick[c]]
        x, d = np.linalg.solve(basis, raised), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, b)
    return [([int(v) for v in basis[:, j]], float(x[j])) for j in range(m) if x[j] > 1e-9]


class _Plan:
    """Rows (length, rank, count, per sequence, sequence, offset, step): run-length coded places."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
        self.rooms: list[int] = []

    def leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self.open.get(room):
                insort(self.rooms, room)
            self.open.setdefault(room, []).append((first, count))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Put ``count`` pieces one after the other into the fullest sequence that has room; whole runs at once."""
        while count:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = self.capacity // length
                new = -(-count // each)
                room, first, have = self.capacity, self.sequences, new
                self.sequences += new
            else:
                room = self.rooms[k]
                first, have = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(k)
            each = room // length
            full = min(have, count // each)
            part = 1 if full < have and count - full * each else 0
            rest = count - full * each if part else 0
            used = full * each + rest
            self.rows.append((length, rank, used, each, first, self.capacity - room, length))
            self.leave(room - each * length, first, full)
            if part:
                self.leave(room - rest * length, first + full, 1)
            self.leave(room, first + full + part, have - full - part)
            rank += used
            count -= used


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> _Plan:
    plan = _Plan(capacity)
    used = dict.fromkeys(counts, 0)
    large = [(n, c) for n, c in sorted(counts.items(), reverse=True) if small < n < capacity]
    total = sum(c for _, c in large)
    if counts.get(capacity):
        plan.rows.append((capacity, 0, counts[capacity], 1, 0, 0, capacity))
        plan.sequences += counts[capacity]
        used[capacity] = counts[capacity]
    if total:
        each = -(-total // groups)
        queues: dict[int, list[list[int]]] = {}  # rounded size -> runs [length, count] of the pieces that it stands for
        seen, size = 0, 0
        for n, c in large:
            while c:
                if seen % each == 0:
                    size = n
                take = min(c, each - seen % each)
                runs = queues.setdefault(size, [])
                if runs and runs[-1][0] == n:
                    runs[-1][1] += take
                else:
                    runs.append([n, take])
                seen += take
                c -= take
        sizes = list(queues)
        found = configurations(sizes, [sum(r[1] for r in queues[s]) for s in sizes], capacity)
        for items, times in sorted(found, key=lambda f: -f[1]):
            slots = [s for s, k in zip(sizes, items, strict=True) for _ in range(k)]
            left = int(times + 1e-6)
            while left and slots:
                # of one size, several slots share a queue: a run serves all of them in turn
                need: dict[int, int] = {}
                for s in slots:
                    need[s] = need.get(s, 0) + 1
                if any(not queues[s] or queues[s][0][1] < k and sum(r[1] for r in queues[s]) < k for s, k in need.items()):
                    break
                run = min([left, *(queues[s][0][1] // k for s, k in need.items())])
                if run:
                    layout = [(queues[s][0][0], s) for s in slots]
                else:  # the last pieces of a run share one sequence with the next run's
                    run, layout, ahead = 1, [], {s: [list(r) for r in queues[s]] for s in need}
                    for s in slots:
                        layout.append((ahead[s][0][0], s))
                        ahead[s][0][1] -= 1
                        if not ahead[s][0][1]:
                            ahead[s].pop(0)
                at = 0
                for n, s in layout:
                    plan.rows.append((n, used[n], run, 1, plan.sequences, at, n))
                    used[n] += run
                    queue = queues[s]
                    queue[0][1] -= run
                    if not queue[0][1]:
                        queue.pop(0)
                    at += n
                plan.leave(capacity - at, plan.sequences, run)
                plan.sequences += run
                left -= run
    for n in sorted(counts, reverse=True):
        if counts[n] > used[n]:
            plan.best_fit(n, used[n], counts[n] - used[n])
    return plan


def plan_rows(counts: dict[int, int], capacity: int, groups: int = 192) -> tuple[list[tuple], int]:
    """The plan with the fewest sequences over some bounds below which pieces count as small."""
    plans = [_plan(counts, capacity, groups, capacity // k) for k in (2, 3, 4)]
    best = min(plans, key=lambda p: p.sequences)
    return best.rows, best.sequences


# --- the operator ----------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, groups: int = 192, with_ids: bool = False, bucket_rows: int = 100_000) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    # rows may share everything, so what spreads them is a number of their own, fixed by the checkpoint
    cut = common.checkpointed(pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    buckets = -(-max(1, sum(counts.values())) // bucket_rows) * 16
    rows, _ = plan_rows(counts, capacity, groups)
    plan = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0, 0)], "_length long, _rank long, _count long, _each long, _sequence long, _offset long, _step long")
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = cut.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_r", F.col("_ahead") + F.col("_in"))
    # a plan has some rows for each length, and no more for a larger corpus
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_count")))
    nth = F.col("_r") - F.col("_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("_step")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
