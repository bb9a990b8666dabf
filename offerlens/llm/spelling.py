"""Operator 11: grouping of spelling variants with Aho-Corasick halves.

Words are runs of letters of whole texts with how often they occur; two are near if one
inserted, deleted or replaced letter makes one the other. Cut a word in two: one edit
leaves at least one half as it is, at the start or at the end of the near word. So automaton
shards hold every word's two halves (the head with a mark in front, the tail with a mark
behind, which fixes the place of a hit), all words are scanned, hits of compatible length are
expanded to the words that have the half, and the edit is verified letter by letter. A pair
that both halves find counts once: the tail's hit yields if the head matches as well.

Scale: occurrences are counted in the scan and combine before the shuffle. A head has at least
three letters, so a word needs only the shard of its first three and that of its last three;
a beginning or end that very many words share is split by the whole half, and a word
visits only the parts that its possible halves fall into. No pair leaves its shard: each word takes
its number of near words and the best of them along. Roots follow forms by pointer doubling;
counts grow tenfold a step, so the largest count bounds the rounds.

Defined results: null and empty texts have no words; a null doc_id is written as nothing in
the hash of ``<doc_id>:<run>``; repeated rows count again; other columns aren't read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Least letters and occurrences of a word; a form has at least RATIO times its word's.
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) loses a letter.
DAMAGE = 31
#: Letters of a border (a head of a word of MIN_CHARS), words in a shard, pairs verified at a time, words that the scan counts before it hands them on.
BORDER, SHARD_WORDS, PAIRS, HELD_WORDS = 3, 40_000, 1 << 20, 400_000
#: Characters of a text whose words are listed at a time.
PIECE_CHARS = 4 << 20
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_CHARS},}}")
_NOT_LETTER = re.compile("[^a-zÀ-ÿ]")


# --- words ----------------------------------------------------------------------


def runs(text: str) -> Counter:
    """The runs of at least MIN_CHARS letters in a text whose A-Z are lower case."""
    if len(text) <= PIECE_CHARS:
        return Counter(_RUN.findall(text))
    out, at = Counter(), 0
    while at < len(text):
        cut = _NOT_LETTER.search(text, min(len(text), at + PIECE_CHARS))
        end = cut.start() if cut else len(text)
        out.update(_RUN.findall(text[at:end]))
        at = max(end, at + 1)
    return out


def damaged(doc_id, run: str) -> str:
    """The run, without a letter where its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame) -> DataFrame:
    """word, n of all documents."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for part in common.sliced([batch], 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if not text.is_valid:
                        continue
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in runs(text.as_buffer().to_pybytes().lower().decode()).items():
                        if zlib.crc32(word.encode(), start) % DAMAGE == 0:
                            word = damaged(doc_id, word)
                            if len(word) < MIN_CHARS:
                                continue
                        held[word] = held.get(word, 0) + n
                    if len(held) > HELD_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
                        held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- automaton shards -------------------------------------------------------------


def _half(side: int, length: Column, word: Column) -> Column:
    """The half that a word of ``length`` has, taken from ``word``."""
    return F.substring(word, F.lit(1), F.floor(length / 2).cast("int")) if side == 0 else F.right(word, F.ceil(length / 2).cast("int"))


def dealt(words: DataFrame, shards: int) -> DataFrame:
    """shard, side, held, word, n: each word where it is scanned for heads (side 0) and tails (1); ``held``: the automaton there has its half."""
    word, length = F.col("word"), F.char_length("word")
    sides = words.select(
        "word",
        "n",
        F.explode(F.array(*[
            F.struct(F.lit(side).alias("side"), (F.substring(word, 1, BORDER) if side == 0 else F.right(word, F.lit(BORDER))).alias("border"),
                     F.xxhash64(_half(side, length, word)).alias("own"),
                     F.array_distinct(F.array(*[F.xxhash64(_half(side, length + d, word)) for d in (-1, 0, 1)])).alias("halves"))
            for side in (0, 1)
        ])).alias("x"),
    ).select("word", "n", "x.*")
    most = SHARD_WORDS // 4
    hot = sides.groupBy("side", "border").count().where(F.col("count") > most).select("side", "border", F.ceil(F.col("count") / most).alias("parts"))
    placed = sides.join(F.broadcast(hot), ["side", "border"], "left")  # borders are triples of some 90 letters, however many words there are
    placed = placed.withColumn("parts", F.coalesce("parts", F.lit(1)))
    shard = lambda half: F.pmod(F.xxhash64("side", "border", F.pmod(half, F.col("parts"))), F.lit(shards)).cast("int")
    # parts of a border may fall into one shard: a word stands there once all the same, or its pairs would count twice
    placed = placed.withColumn("shard", F.explode(F.array_distinct(F.transform("halves", shard))))
    return placed.select("shard", "side", (F.col("shard") == shard(F.col("own"))).alias("held"), "word", "n")


def _near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether exactly one edit makes the row of u (pairs x letters) that of v; lengths differ by one at most."""
    if u.shape[1] == v.shape[1]:
        return (u != v).sum(1) == 1
    if u.shape[1] < v.shape[1]:
        u, v = v, u
    front = np.logical_and.accumulate(u[:, :-1] == v, axis=1).sum(1)
    back = np.logical_and.accumulate(u[:, :0:-1] == v[:, ::-1], axis=1).sum(1)
    return front + back >= v.shape[1]


def near_words(side: int, held: list[str], ranks: np.ndarray, scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each scanned word: how many held words near it this side's halves find, and the least rank of them."""
    found, best = np.zeros(len(scanned), np.int64), np.full(len(scanned), np.iinfo(np.int64).max)
    if not held or not scanned:
        return found, best
    halves = ["\n" + w[: len(w) // 2] if side == 0 else w[len(w) // 2 :] + "\n" for w in held]
    number: dict[str, int] = {}
    segment = np.array([number.setdefault(h, len(number)) for h in halves], np.int64)
    automaton = ahocorasick.Automaton()
    for half, i in number.items():
        automaton.add_word(half, i)
    automaton.make_automaton()
    # Held words by segment and length: where each list starts and ends.
    lengths = np.array([len(w) for w in held], np.int64)
    lists = segment * 2 + (lengths & 1)  # a half of k letters belongs to two lengths, one of them odd
    order = np.argsort(lists, kind="stable")
    lists = lists[order]
    begins, ends = np.searchsorted(lists, np.arange(2 * len(number))), np.searchsorted(lists, np.arange(2 * len(number)), side="right")
    of_list = np.zeros(2 * len(number), np.int64)
    of_list[lists] = lengths[order]
    by_length = np.array([len(w) for w in scanned], np.int64)
    letters_held = {n: _matrix(held, np.flatnonzero(lengths == n), n) for n in np.unique(lengths).tolist()}
    row_held = _row_numbers(lengths)
    letters, row = {n: _matrix(scanned, np.flatnonzero(by_length == n), n) for n in np.unique(by_length).tolist()}, _row_numbers(by_length)
    starts = np.concatenate([[0], np.cumsum(by_length + 1)])
    hits = np.array([x for pair in automaton.iter("\n" + "\n".join(scanned) + "\n") for x in pair], np.int64).reshape(-1, 2)
    words = np.searchsorted(starts, hits[:, 0] - 1 if side == 1 else hits[:, 0], side="right") - 1
    for odd in (0, 1):
        chosen = hits[:, 1] * 2 + odd
        size = ends[chosen] - begins[chosen]
        fits = np.flatnonzero((size > 0) & (np.abs(of_list[chosen] - by_length[words]) <= 1))
        code = of_list[chosen[fits]] * (int(by_length.max()) + 2) + by_length[words[fits]]
        for pair in np.unique(code).tolist():
            n_held, n_scanned = divmod(pair, int(by_length.max()) + 2)
            own = fits[code == pair]
            for block in _blocks(size[own], max(1, PAIRS * 8 // n_held)):
                hit = own[block]
                times = size[hit]
                v = np.repeat(words[hit], times)
                u = order[np.repeat(begins[chosen[hit]], times) + _counted(times)]
                a, b = letters_held[n_held][row_held[u]], letters[n_scanned][row[v]]
                good = _near(a, b)
                if side == 1:  # the head found it too
                    good &= (a[:, : n_held // 2] != b[:, : n_held // 2]).any(1)
                found += np.bincount(v[good], minlength=len(scanned))
                np.minimum.at(best, v[good], ranks[u[good]])
    return found, best


def _matrix(words: list[str], which: np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer("".join(words[i] for i in which.tolist()).encode("latin-1"), np.uint8).reshape(-1, n)


def _row_numbers(lengths: np.ndarray) -> np.ndarray:
    """Of each word among those of its length."""
    out = np.zeros(len(lengths), np.int64)
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        out[own] = np.arange(len(own))
    return out


def _counted(times: np.ndarray) -> np.ndarray:
    """0 .. t-1 for each t."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _blocks(sizes: np.ndarray, most: int):
    """Slices whose sizes sum to ``most`` at most, or one element."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield slice(at, end)
        at = end


def near(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n) of the words that have near ones; several rows a word, to be summed."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    total = words.count()
    rows = dealt(words, max(1, -(-2 * total // SHARD_WORDS)))

    def run(key, table):
        out = []
        for side in (0, 1):
            part = table.filter(pc.equal(table.column("side"), side))
            scanned, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            own = np.flatnonzero(part.column("held").to_numpy())
            held = [scanned[i] for i in own.tolist()]
            by_rank = sorted(range(len(held)), key=lambda i: (-n[own[i]], held[i]))
            ranks = np.zeros(len(held), np.int64)
            ranks[by_rank] = np.arange(len(held))
            found, best = near_words(side, held, ranks, scanned)
            for i in np.flatnonzero(found).tolist():
                top = by_rank[best[i]]
                out.append((scanned[i], int(found[i]), int(n[own[top]]), held[top]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.groupBy("shard").applyInArrow(run, "word string, n_near long, form_n long, form string")


# --- the operator -----------------------------------------------------------------


def roots(links: DataFrame, largest: int) -> DataFrame:
    """word, root of words that have a form (word, form); ``largest``: no word occurs more often."""
    steps = 1 + int(math.log(max(largest, MIN_COUNT) / MIN_COUNT, RATIO) + 1e-9)  # each form occurs RATIO times as often as its word
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, (steps - 1).bit_length())):
        now = common.checkpointed(now)
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = common.salted_lookup(now, ahead, ["root"], F.col("word")).select("word", F.coalesce("further", "root").alias("root"))
    return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = common.checkpointed(counts(docs))
    found = near(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("less"), "form").alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    whole = alone.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= RATIO * F.col("n")
    whole = common.checkpointed(whole.select("word", "n", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    largest = whole.agg(F.max("n")).first()[0] or 0
    ends = roots(whole.where(F.col("form").isNotNull()), largest)
    return whole.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
