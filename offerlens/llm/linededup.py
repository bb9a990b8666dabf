"""Operator 9: reversible line dedup.

State, all sharded by key hash: postings (key, doc_id), the exact table that a
line's reference count and its keeper come from; and a cuckoo filter a shard over
the keys that are to be dropped. Documents are inserted by adding postings and
deleted by taking theirs away (``Index.insert``, ``Index.delete``); the reference
counts before and after say which keys filters gain and lose, so no insertion is
final, no key is taken out that isn't in, and a shard that is full is built anew from
its exact keys. Applying sends each line's key to its shard's filter; what passes is
looked up in the exact table, so false positives change nothing.

Scale: keys are two 64-bit hashes, 24 bytes a line are shuffled instead of lines;
counts combine before the shuffle; lines of a hot key are salted in the probe and
in the lookup, and so are the documents of a hot doc_id. A filter holds at most about
SHARD_KEYS keys, whatever the corpus. Texts are shuffled once, to meet their drops.

Defined results: a row is a document, also for deletion; null and empty texts are one
empty line; the keeper is the largest doc_id (null is the smallest, and rows that share
the keeper's doc_id all keep the line); other columns are kept by ``apply``
(those named as its own are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARD_KEYS = 50_000
PROBE_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\v\f\r"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def key_hashes(data: bytes) -> tuple[int, int]:
    """The two hashes of a line as signed longs, as ``postings`` makes them."""
    key = data.strip(_SPACE.encode()).lower()
    a, b = xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(b"\x01" + key, 42)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def postings(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """doc_id, k1, k2: one row for each document and distinct key of at least ``min_chars`` code points."""
    long_lines = F.regexp_extract_all("text", F.lit(f"[^\n]{{{max(1, min_chars)},}}"), F.lit(0))  # others can't have the characters; millions of line breaks make no array
    keys = F.array_distinct(F.transform(long_lines, key_of))
    rows = docs.select("doc_id", F.explode(keys).alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select("doc_id", F.xxhash64("key").alias("k1"), F.xxhash64(F.concat(F.lit("\x01"), "key")).alias("k2"))


def insert(state: DataFrame, docs: DataFrame, min_chars: int = 40) -> DataFrame:
    return state.unionByName(postings(docs, min_chars))


def delete(state: DataFrame, docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """Postings without those of the given documents (doc_id, text): of rows that share a doc_id, as many go as are given."""
    return state.exceptAll(postings(docs, min_chars).select(*state.columns))


def delete_ids(state: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Postings without those of any row of the given ids (column doc_id)."""
    return state.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def reference_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


# --- cuckoo filters ---------------------------------------------------------


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a key may sit in two buckets; keys can be deleted."""

    SLOTS = 4

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    LOAD = 0.85

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 64
        while buckets * cls.SLOTS * cls.LOAD < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys.tolist()):
                return made
            buckets *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # a shard's keys agree in low bits
        k ^= k >> np.uint64(29)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
        marks = ((k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (k & np.uint64(self.mask)).astype(np.int64)
        return marks, first, self._other(first, marks)

    def _other(self, at, mark):
        return at ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 3) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, a, b = self.places(keys)
        return ((self.table[a] == marks[:, None]) | (self.table[b] == marks[:, None])).any(1)

    def insert(self, key: int) -> bool:
        marks, a, b = self.places(np.array([key], dtype=np.int64))
        mark, spots = marks[0], (int(a[0]), int(b[0]))
        for at in spots:
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at, undo = spots[0], []
        for turn in range(500):
            slot = turn % self.SLOTS
            undo.append((at, slot, self.table[at, slot]))
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int(self._other(np.int64(at), mark))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot, mark in reversed(undo):
            self.table[at, slot] = mark
        return False

    def delete(self, key: int) -> bool:
        marks, a, b = self.places(np.array([key], dtype=np.int64))
        for at in (int(a[0]), int(b[0])):
            hit = np.flatnonzero(self.table[at] == marks[0])
            if len(hit):
                self.table[at, hit[0]] = 0
                return True
        return False

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, dtype="<u2").reshape(-1, cls.SLOTS).copy())


def filters(dropped: DataFrame, shards: int) -> DataFrame:
    """shard, filter: one cuckoo filter over the k1 of each shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [CuckooFilter.of(pdf["k1"].to_numpy()).dump()]})

    keyed = dropped.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1")
    return keyed.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(current: DataFrame, added: DataFrame, removed: DataFrame, shards: int, dropped: DataFrame | None = None) -> DataFrame:
    """Filters after keys (k1) have come and gone; shards with neither stay as they are.

    A shard whose filter has no room left is built anew from its keys in ``dropped``,
    the table after the change (without it, that is an error).
    """
    change = added.select("k1", F.lit(True).alias("add")).unionByName(removed.select("k1", F.lit(False).alias("add")))
    change = change.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "add")
    may_rebuild = dropped is not None

    def merge(now: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        shard = int((now if len(now) else changes)["shard"].iloc[0])
        cuckoo = CuckooFilter.load(now["filter"].iloc[0]) if len(now) else CuckooFilter()
        for key in changes.loc[~changes["add"], "k1"].tolist():
            cuckoo.delete(key)
        room = cuckoo.table.size * CuckooFilter.LOAD - np.count_nonzero(cuckoo.table)
        new = changes.loc[changes["add"], "k1"].tolist()
        if len(new) > room or not all(map(cuckoo.insert, new)):
            if not may_rebuild:
                raise ValueError(f"the filter of shard {shard} is full; give the table of dropped keys")
            return pd.DataFrame({"shard": [shard], "filter": [None]})
        return pd.DataFrame({"shard": [shard], "filter": [cuckoo.dump()]})

    out = current.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(merge, "shard int, filter binary")
    if not may_rebuild:
        return out
    out = common.checkpointed(out)
    full = out.where(F.col("filter").isNull()).select("shard")
    keys = dropped.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).join(full, "shard", "left_semi")
    return out.where(F.col("filter").isNotNull()).unionByName(filters(keys, shards))


def probe(state: DataFrame, made: DataFrame, shards: int, salts: int) -> DataFrame:
    """Postings whose shard's filter holds their key."""
    lines = state.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))  # rows that share id and line are dealt as well
    dealt = made.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def ask(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["doc_id", "k1", "k2"]]
        return rows[CuckooFilter.load(held["filter"].iloc[0]).contains(rows["k1"].to_numpy())] if len(held) and len(rows) else rows.iloc[:0]

    return lines.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInPandas(ask, T.StructType([state.schema["doc_id"], *[T.StructField(k, T.LongType()) for k in ("k1", "k2")]]))


# --- the operator -------------------------------------------------------------


@dataclass
class Index:
    """The state of line dedup: tables to be written or checkpointed between changes (each change checkpoints its own)."""

    postings: DataFrame  # doc_id, k1, k2
    dropped: DataFrame  # k1, k2, n_docs, keeper of the keys that ``min_docs`` documents hold
    filters: DataFrame  # shard, filter
    shards: int
    min_docs: int = 5
    min_chars: int = 40

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> Index:
        return cls.of_postings(common.checkpointed(postings(docs, min_chars)), min_docs, min_chars)

    @classmethod
    def of_postings(cls, state: DataFrame, min_docs: int = 5, min_chars: int = 40) -> Index:
        dropped = common.checkpointed(reference_counts(state).where(F.col("n_docs") >= min_docs))
        shards = -(-max(1, dropped.count()) // SHARD_KEYS)
        return cls(state, dropped, filters(dropped, shards), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> Index:
        new = common.checkpointed(postings(docs, self.min_chars))
        return self._after(self.postings.unionByName(new), new)

    def delete(self, docs: DataFrame) -> Index:
        """Without the given rows (doc_id, text)."""
        old = common.checkpointed(postings(docs, self.min_chars))
        return self._after(self.postings.exceptAll(old.select(*self.postings.columns)), old)

    def _after(self, state: DataFrame, changed: DataFrame) -> Index:
        """Counts anew only the keys that the change touches; their old and new places in ``dropped`` say what filters gain and lose."""
        state = common.checkpointed(state)
        touched = changed.select("k1", "k2").distinct()
        now = reference_counts(state.join(touched, ["k1", "k2"], "left_semi")).where(F.col("n_docs") >= self.min_docs)
        now = common.checkpointed(now)
        before = self.dropped.join(touched, ["k1", "k2"], "left_semi")
        dropped = common.checkpointed(self.dropped.join(touched, ["k1", "k2"], "left_anti").unionByName(now))
        added = now.join(before, ["k1", "k2"], "left_anti")
        removed = before.join(now, ["k1", "k2"], "left_anti")
        if dropped.count() > 2 * SHARD_KEYS * self.shards:  # more shards
            return Index.of_postings(state, self.min_docs, self.min_chars)
        made = update_filters(self.filters, added, removed, self.shards, dropped)
        return Index(state, dropped, common.checkpointed(made), self.shards, self.min_docs, self.min_chars)

    def drops(self) -> DataFrame:
        """doc_id, k1, k2 of the lines to drop."""
        salts = -(-max(1, self.postings.count()) // (PROBE_ROWS * self.shards))
        candidates = probe(self.postings, self.filters, self.shards, salts)
        found = common.salted_lookup(candidates, self.dropped.select("k1", "k2", "keeper"), ["k1", "k2"], F.monotonically_increasing_id(), how="inner")
        return found.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "k1", "k2")


def apply(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the kept text, plus n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped", "_drop", "_doc")  # an older result's columns give way
    sets = dropped.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_drop"))
    names = docs.columns
    joined = common.heated_lookup(docs, sets, "doc_id")
    at = names.index("text")

    def run(batches):
        for batch in common.sliced(batches, at):
            texts, lines, gone = [], [], []
            for text, drop in zip(batch.column(at), batch.column(len(names)), strict=True):
                data = (text.as_py() or "").encode()
                keys = {(x["k1"], x["k2"]) for x in drop.as_py() or ()}
                parts = data.split(b"\n")
                lines.append(len(parts))
                kept = [p for p in parts if key_hashes(p) not in keys] if keys else parts
                gone.append(len(parts) - len(kept))
                texts.append(b"\n".join(kept).decode() if gone[-1] else text.as_py())
            columns = [pa.array(texts, type=pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, type=pa.int64()), pa.array(gone, type=pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.select(*names, "_drop").mapInArrow(run, schema)


def dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """From an empty state: insert all documents, then apply."""
    return apply(docs, Index.of(docs, min_chars, min_docs).drops())
