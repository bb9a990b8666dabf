"""Operator 2: approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``hashes`` Gaussian projections, shifted and cut into
slots of one width. A query visits its own bucket and, in each table, the
``probes`` - 1 perturbed buckets with the best estimated success: the squared
distances of its projections to the slots' borders, summed over what is
perturbed, are enumerated in ascending order by a heap. Candidates of all tables
are merged and ranked by their exact distance in double precision. Queries with
too few candidates search all blocks of the index instead.

Scale: few tables with many probes, since each table shuffles every vector once (in
its own precision), unless there are more than ``MOST_HOT`` hot buckets; equal vectors are one entry with their k+1 smallest ids (no query
needs more), combined before any shuffle. Buckets are packed into tiles of ``TILE``
vectors and hot buckets are dealt over many, so are probes; a task keeps the best
k+1 ids of each query, not its candidates. The slot width is fitted: the true neighbours
of at most ``SAMPLE`` queries are found by a scan of all vectors, and the least width at
which the probes visit the share ``RECALL`` of them is taken, whatever clusters there are (the
sample's commonest length sets it for all lengths); every vector is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, as query or candidate, and vectors of different lengths
never meet; rows that share a vec_id are one item, as near as its nearest row, with
one list for all its query rows, and no neighbour of itself; a null vec_id takes no
part; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TABLES, HASHES, PROBES = 4, 6, 60
#: The share of a sample's true neighbours that its probes must visit; it sets the slot width.
RECALL = 0.94
SAMPLE = 256
TILE = 2048
#: Hot buckets that are broadcast; with more, rows are shuffled to meet them.
MOST_HOT = 100_000
#: Vectors hashed at a time: each query becomes as many rows as it has probes.
PART = 256


class Hash:
    """One table's projections for vectors of one length."""

    def __init__(self, dim: int, table: int, hashes: int, width: float, seed: int = 0):
        rng = np.random.default_rng([seed, table, dim])
        self.axes = rng.normal(size=(dim, hashes))
        self.shift = rng.uniform(0, width, hashes)
        self.width = width
        self.mix = rng.integers(-(2**62), 2**62, hashes, dtype=np.int64) | 1

    def slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each projection, and how far the projection lies above the slot's lower border."""
        p = x @ self.axes + self.shift
        slot = np.floor(p / self.width)
        return slot.astype(np.int64), p - slot * self.width

    def keys(self, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (slots * self.mix).sum(1)

    def probe_keys(self, x: np.ndarray, probes: int) -> list[np.ndarray]:
        slots, above = self.slots(x)
        out = []
        for slot, low in zip(slots, above, strict=True):
            steps = sorted([(d * d, j, -1) for j, d in enumerate(low)] + [((self.width - d) ** 2, j, 1) for j, d in enumerate(low)])
            chosen = [()]
            heap = [(steps[0][0], (0,))]
            while heap and len(chosen) < probes:
                score, picked = heapq.heappop(heap)
                if len({steps[i][1] for i in picked}) == len(picked):
                    chosen.append(picked)
                last = picked[-1] + 1
                if last < len(steps):
                    heapq.heappush(heap, (score - steps[last - 1][0] + steps[last][0], (*picked[:-1], last)))
                    heapq.heappush(heap, (score + steps[last][0], (*picked, last)))
            rows = np.repeat(slot[None], len(chosen), axis=0)
            for r, picked in enumerate(chosen):
                for i in picked:
                    rows[r, steps[i][1]] += steps[i][2]
            out.append(np.unique(self.keys(rows)))
        return out


def _vectors(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=kind).astype("f8") for v in column]


def stored_as(table: DataFrame) -> str:
    """How components are kept: as floats where the table has floats, else as doubles."""
    return "<f4" if table.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def clean(table: DataFrame) -> DataFrame:
    """vec_id, vk (digest of the vector), v (little-endian components) of the rows that take part."""
    kind = stored_as(table)

    def run(batches):
        for batch in batches:
            ids, digests, vectors = [], [], []
            for vec_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = value.values.to_numpy(zero_copy_only=False).astype(kind) if value.is_valid and vec_id is not None else np.empty(0)
                if len(v) and np.isfinite(v).all() and v.any():
                    v = v + v.dtype.type(0)  # -0 is 0
                    ids.append(vec_id)
                    vectors.append(v.tobytes())
                    digests.append(hashlib.blake2b(vectors[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array(vectors, type=pa.binary())], names=["vec_id", "vk", "v"])

    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(run, "vec_id long, vk binary, v binary")


def entries(rows: DataFrame, k: int, is_query: Column) -> DataFrame:
    """One row a distinct vector: rid, vk, v, ids (the k+1 smallest, ascending), is_query."""
    of_vector = rows.groupBy("vk").agg(F.first("v").alias("v"), F.max(is_query).alias("is_query"))
    pairs = rows.select("vk", "vec_id").distinct()
    least = pairs.withColumn("n", F.row_number().over(Window.partitionBy("vk").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = least.groupBy("vk").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return of_vector.join(ids, "vk").withColumn("rid", F.monotonically_increasing_id())


def sample_neighbours(found: DataFrame, kind: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, of): at most SAMPLE queries, of the length that most of them have, the k nearest other vectors of each among all, and whose they are.

    A task scans its vectors and keeps the k+1 nearest of each sampled query.
    """
    rows = found.where("is_query").select("v").orderBy(F.xxhash64("vk"), "vk").limit(SAMPLE).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in rows:
        by_size.setdefault(len(r["v"]), []).append(bytes(r["v"]))
    if not by_size:
        return np.empty((0, 1)), np.empty((0, 1)), np.empty(0, np.int64)
    asked = max(by_size.values(), key=len)
    x = np.stack([np.frombuffer(v, dtype=kind).astype("f8") for v in asked])

    def run(batches):
        near, who = np.empty((len(x), 0)), np.empty((len(x), 0, x.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                y = np.stack(_vectors(batch.column(0).slice(at, TILE), kind))
                d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
                first = np.argpartition(d, min(k, len(y) - 1), axis=1)[:, : k + 1]
                near, who = np.hstack([near, np.take_along_axis(d, first, 1)]), np.hstack([who, y[first]])
                best = np.argsort(near, axis=1)[:, : k + 1]
                near, who = np.take_along_axis(near, best, 1), np.take_along_axis(who, best[:, :, None], 1)
        vectors = [v.tobytes() for v in who.reshape(-1, x.shape[1]).astype(kind)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x), dtype=np.int32), near.shape[1])), pa.array(near.ravel()), pa.array(vectors, type=pa.binary())], names=["s", "d", "v"])

    near = found.where(F.octet_length("v") == len(asked[0])).select("v").mapInArrow(run, "s int, d double, v binary")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("d", "v"))).where(F.col("n") <= k + 1)
    others = [(r["s"], bytes(r["v"])) for r in near.select("s", "v").collect()]  # SAMPLE times k+1 rows at most
    others = [(s, v) for s, v in others if v != asked[s]]
    y = np.stack([np.frombuffer(v, dtype=kind).astype("f8") for _, v in others]) if others else np.empty((0, x.shape[1]))
    return x, y, np.array([s for s, _ in others], dtype=np.int64)


def slot_width(x: np.ndarray, y: np.ndarray, of: np.ndarray, probes: int, tables: int, hashes: int, recall: float) -> float:
    """The least width (within 2 %) at which queries x visit the share ``recall`` of their neighbours y."""
    far = np.sqrt(((y - x[of]) ** 2).sum(1))
    far = far[np.isfinite(far) & (far > 0)]
    if not len(far):
        return 1.0

    def visited(width: float) -> float:
        hit = np.zeros(len(y), dtype=bool)
        for t in range(tables):
            h = Hash(x.shape[1], t, hashes, width)
            buckets = [set(keys.tolist()) for keys in h.probe_keys(x, probes)]
            hit |= np.array([key in buckets[s] for key, s in zip(h.keys(h.slots(y)[0]).tolist(), of.tolist(), strict=True)])
        return hit.mean()

    low, high = 0.0, 4 * float(far.max())
    while visited(high) < recall:
        low, high = high, 2 * high
    while high - low > 0.02 * high and high > far.min() / 100:
        middle = (low + high) / 2
        low, high = (low, middle) if visited(middle) >= recall else (middle, high)
    return high


def _hashed(found: DataFrame, kind: str, probes: int, tables: int, hashes: int, width: float, columns: list[str], types: list) -> DataFrame:
    """Rows (t, key, columns...): the buckets of entries (probes 1) or those that queries visit."""
    at = columns.index("v")

    def run(batches):
        made: dict[tuple[int, int], Hash] = {}
        for batch in batches:
            vectors = _vectors(batch.column(at), kind)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims).tolist():
                same = np.flatnonzero(dims == dim)
                parts = np.split(same, range(PART, len(same), PART))
                for rows, t in ((r, t) for r in parts for t in range(tables)):
                    x = np.stack([vectors[i] for i in rows])
                    h = made.setdefault((dim, t), Hash(dim, t, hashes, width))
                    keys = h.probe_keys(x, probes) if probes > 1 else h.keys(h.slots(x)[0])[:, None]
                    take = pa.array(np.repeat(rows, [len(y) for y in keys]))
                    flat = np.concatenate(list(keys)) if len(keys) else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), t * 100_000 + dim, np.int32)), pa.array(flat), *(batch.column(i).take(take) for i in range(len(columns)))], names=["t", "key", *columns])

    schema = "t int, key long, " + ", ".join(f"{c} {x}" for c, x in zip(columns, types, strict=True))
    return found.select(*columns).mapInArrow(run, schema)


def _tiled(rows: DataFrame, spread: str, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Buckets packed into arrays of about TILE rows, and how many tiles each hot bucket has."""
    hot = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    hot = common.checkpointed(hot.select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    dealt = _with_tiles(rows, hot, F.col(spread))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(F.col(spread), F.lit(7)), F.coalesce("tiles", F.lit(1))).cast("int"))
    return dealt.groupBy("t", "key", "tile").agg(F.collect_list(F.struct(*columns)).alias(name)), hot


def _with_tiles(rows: DataFrame, hot: DataFrame, spread: Column) -> DataFrame:
    """``rows`` with the number of tiles of their bucket, null but for hot ones; up to MOST_HOT of them, rows stay where they are."""
    if hot.count() <= MOST_HOT:
        return rows.join(F.broadcast(hot), ["t", "key"], "left")
    return common.salted_lookup(rows, hot, ["t", "key"], spread)


def _best(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k+1 nearest ids of each query, ties to the smaller; an id is as near as its nearest row."""
    for most in (1, k + 1):  # of each id, then of each query
        order = np.lexsort((d, ids, q) if most == 1 else (ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.ones(len(q), dtype=bool)
        first[1:] = q[1:] != q[:-1]
        if most == 1:
            first[1:] |= ids[1:] != ids[:-1]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = place < most
        q, d, ids = q[keep], d[keep], ids[keep]
    return q, d, ids


def _search(index: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """(qid, vec_id, distance): for each query the k+1 nearest ids in the buckets that it shares."""
    tiles, hot = _tiled(index, "rid", ["v", "ids"], "entries")
    probes, _ = _tiled(asked, "qid", ["qid", "v"], "queries")
    probes = _with_tiles(probes.select("t", "key", "queries"), hot, F.col("key")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))).drop("tiles")
    pairs = probes.join(tiles, ["t", "key", "tile"]).select("queries", "entries")

    def batch_of(held):
        q, d, ids = held
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(d)], names=["qid", "vec_id", "distance"])

    def run(batches):
        held, parts, size = None, [], 0
        for batch in batches:
            for asked_now, there in zip(batch.column(0), batch.column(1), strict=True):
                a, b = asked_now.values, there.values
                qs, xs = np.stack(_vectors(a.field("v"), kind)), np.stack(_vectors(b.field("v"), kind))
                qid, lists = a.field("qid").to_numpy(), b.field("ids")
                ends = lists.offsets.to_numpy().astype(np.int64)
                flat, count = lists.values.to_numpy(), np.diff(ends)
                rough = (xs * xs).sum(1)[None] + (qs * qs).sum(1)[:, None] - 2 * qs @ xs.T
                here = flat[ends[0] : ends[-1]]
                if len(xs) > k + 1 and len(np.unique(here)) == len(here):  # then k+1 vectors hold k+1 ids
                    edge = np.partition(rough, k, axis=1)[:, k]
                    i, j = np.nonzero(rough <= (edge + 1e-9 * (1 + np.abs(edge) + (qs * qs).sum(1)))[:, None])
                else:
                    i, j = (x.ravel() for x in np.indices(rough.shape))
                exact = np.sqrt(((xs[j] - qs[i]) ** 2).sum(1))
                times = count[j]
                at = np.repeat(ends[j], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                parts.append((np.repeat(qid[i], times), np.repeat(exact, times), flat[at]))  # one row an id
                size += len(at)
                if size > 200_000:
                    held = _best(*(np.concatenate(c) for c in zip(*([held] if held else []), *parts, strict=True)), k)
                    parts, size = [], 0
                    if len(held[0]) > 1_000_000:  # many queries: pass on what there is
                        yield batch_of(held)
                        held = None
        if parts or held:
            yield batch_of(_best(*(np.concatenate(c) for c in zip(*([held] if held else []), *parts, strict=True)), k))

    return _nearest_ids(pairs.mapInArrow(run, "qid long, vec_id long, distance double"), "qid", k + 1)


def _nearest_ids(found: DataFrame, query: str, most: int) -> DataFrame:
    found = found.groupBy(query, "vec_id").agg(F.min("distance").alias("distance"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("distance", "vec_id"))).where(F.col("rank") <= most)


def nearest(table: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each id with a query row in ``table`` (vec_id, embedding)."""
    is_query, kind = F.coalesce(is_query, F.lit(False)), stored_as(table)
    rows = common.checkpointed(clean(table))
    found = common.checkpointed(entries(rows, k, is_query))
    slot = slot_width(*sample_neighbours(found, kind, k), probes, tables, hashes, recall)
    kinds = {"rid": "long", "qid": "long", "v": "binary", "ids": "array<long>"}
    hashed = lambda df, n, names: _hashed(df, kind, n, tables, hashes, slot, names, [kinds[c] for c in names])
    asked = found.where("is_query").select(F.col("rid").alias("qid"), "v", "vk")
    got = common.checkpointed(_search(hashed(found, 1, ["rid", "v", "ids"]), hashed(asked, probes, ["qid", "v"]), kind, k))
    enough = got.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("qid")
    few = common.checkpointed(asked.join(enough, "qid", "left_anti"))
    if few.take(1):
        one = [F.lit(0).alias("t"), F.octet_length("v").cast("long").alias("key")]  # one bucket for all vectors of a length
        got = got.join(few.select("qid"), "qid", "left_anti").unionByName(_search(found.select(*one, "rid", "v", "ids"), few.select(*one, "qid", "v"), kind, k))
    near = got.groupBy("qid").agg(F.collect_list(F.struct("distance", "vec_id")).alias("near"))  # k+1 at most
    near = asked.select("qid", "vk").join(near, "qid").select("vk", "near")
    out = common.salted_lookup(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vk").distinct(), near, ["vk"], F.col("query_id"), how="inner")
    out = out.select("query_id", F.explode("near").alias("x")).select("query_id", "x.*").where(F.col("vec_id") != F.col("query_id"))
    return _nearest_ids(out, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score"))
