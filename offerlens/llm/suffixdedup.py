"""Operator 13: removal of long repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
smaller doc_id (null is the smallest; rows that share one stand in the order they are
stored), or further left in the same text.

The arrays are sparse. Each window of LENGTH bytes chooses one *anchor*, the place in it
whose next GRAM bytes have the smallest hash (the leftmost, if equal), so equal windows
have equal anchors at equal places, and one suffix in 35 is enough to find every repeat.

* Documents are stored in compressed blocks. A new block's suffix array holds its anchors'
  keys (the hash of GRAM bytes), sorted, and is cut by key ranges into shards.
* Each shard keeps a logarithmic family: arrays of geometrically growing sizes. A new
  array is merge-scanned against every level, and while the last two levels are of
  like size they are merged. Keys found twice tell which suffixes of which blocks may
  match; that is all that is shipped between blocks for the others.
* Those suffixes come with their context (the windows that chose them) into shards of
  keys, where they are sorted as suffixes to the right and, reversed, to the left of their
  anchor. Windows are equal if both common prefixes are long enough (intervals of the two LCP
  arrays), so nothing rests on hashes alone. All but the first of equal windows go.

Scale: eight bytes for each anchor are shuffled for the index, the context of repeated
suffixes, and the compressed blocks to meet their hits and their spans. Equal contexts
within a block are settled there, so a passage that a third of all documents share costs
one row a block. A key with more than HOT contexts doesn't go to one task: its windows
are compared by a native aggregate, combined before the shuffle. Levels are tables in the shared
folder; those that are replaced are deleted.

Defined results: null and empty texts have no bytes; repeated rows are documents of their own,
the first stored keeps its text; columns other than doc_id and text aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeat, bytes that an anchor's key looks at, and places a window can choose from.
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
#: Bytes of text in a block (or one document), keys in a shard of the index, contexts in a shard of the comparison.
BLOCK_BYTES, SHARD_KEYS, SHARD_CONTEXTS = 4 << 20, 1 << 17, 50_000
#: A key with more contexts is hot.
HOT = 200_000
_CHUNK = 1 << 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

BLOCKS = "block long, size long, ids binary, ends binary, text binary, keys binary, counts binary, n_keys long, n_multi long"
LEVELS = "shard int, level int, keys binary, blocks binary, counts binary"
SPANS = "block long, doc int, start long, end long"


# --- sparse suffix arrays ------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Of the GRAM bytes at each of the first n places."""
    words = np.ndarray((n + GRAM - 8,), dtype="<u8", buffer=data, strides=(1,)) * _M1
    words ^= words >> np.uint64(29)
    out = words[:n] * _M2
    for i in range(1, GRAM // 8):
        out += words[8 * i : 8 * i + n] * np.uint64(int(_M3) * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF)
    return _mixed(out)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other (``ends``: where each ends): key, place, first and last window of each anchor that a window within a text chooses."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    out, low = [], np.uint64((1 << 24) - 1)
    starts = np.concatenate([[0], ends[:-1]])
    bad_from, bad_to = np.maximum(starts, ends - LENGTH + 1), ends  # windows that begin here leave their text
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        places = m + REACH - 1
        keys = _gram_hashes(data[at : at + places + GRAM - 1], places)
        least = keys & ~low | np.arange(places, dtype=np.uint64)
        span = 1
        while span * 2 <= REACH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:m], least[REACH - span : REACH - span + m])
        chosen = (least & low).astype(np.int32)
        good = np.ones(m, bool)
        for k in range(int(np.searchsorted(bad_to, at, side="right")), int(np.searchsorted(bad_from, at + m))):
            good[max(0, bad_from[k] - at) : max(0, bad_to[k] - at)] = False
        windows = np.flatnonzero(good)
        if len(windows):
            picks = chosen[windows]
            first = np.flatnonzero(np.concatenate([[True], picks[1:] != picks[:-1]]))
            last = np.concatenate([first[1:], [len(windows)]]) - 1
            out.append((keys[picks[first]], picks[first].astype(np.int64) + at, windows[first] + at, windows[last] + at))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    key, place, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.concatenate([[True], place[1:] != place[:-1]])  # a chunk's edge may cut an anchor's windows
    return key[new], place[new], begin[new], end[np.concatenate([new[1:], [True]])]


def _packed(ids: list, texts: list[bytes], block: int) -> list:
    """A row of BLOCKS; a null id has the smallest long there is, below a flag byte an id."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    whole = b"".join(texts)
    key, *_ = anchors(np.frombuffer(whole, np.uint8), ends)
    keys, counts = np.unique(key, return_counts=True)
    flagged = np.array([i is not None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], np.int64).tobytes()
    return [block, len(whole), flagged, ends.tobytes(), pa.Codec("zstd").compress(whole, asbytes=True), keys.tobytes(), counts.astype(np.uint32).tobytes(), len(keys), int(counts[counts > 1].sum())]


def _unpacked(size: int, ids: bytes, ends: bytes, text: bytes):
    bounds = np.frombuffer(ends, np.int64)
    known = np.frombuffer(ids, np.uint8, len(bounds)).astype(bool)
    whole = pa.Codec("zstd").decompress(text, size, asbytes=True) if size else b""
    return known, np.frombuffer(ids, np.int64, offset=len(bounds)), bounds, whole


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BLOCKS = pa.schema([("block", pa.int64()), ("size", pa.int64()), *[(n, pa.binary()) for n in ("ids", "ends", "text", "keys", "counts")], ("n_keys", pa.int64()), ("n_multi", pa.int64())])


def _blocks(docs: DataFrame, insert: int) -> DataFrame:
    """Rows of BLOCKS; each block has a number of its own among all inserts."""

    def run(batches):
        number = (insert << 48) | (TaskContext.get().partitionId() << 24)
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                if texts and held + len(data) > BLOCK_BYTES:
                    yield _batch([_packed(ids, texts, number)], _BLOCKS)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i.as_py())
                texts.append(data)
                held += len(data)
        if texts:
            yield _batch([_packed(ids, texts, number)], _BLOCKS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


# --- the logarithmic family ----------------------------------------------------


class Levels:
    """Suffix arrays of geometric sizes within one shard: sorted keys, each with its block and how often it stands there."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels
        self.found: list[np.ndarray] = []

    def insert(self, keys: np.ndarray, block: int, counts: np.ndarray) -> None:
        """Merge-scan a block's array against every level, then merge levels of like size."""
        for held, _, _ in self.levels:
            at = np.searchsorted(held, keys)
            there = held[np.minimum(at, len(held) - 1)] == keys
            if there.any():
                self.found.append(keys[there])
        self.levels.append((keys, np.full(len(keys), block, np.int64), counts))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")  # two sorted runs: the sort merges them
            self.levels.append(tuple(x[order] for x in both))

    def hits(self, hot: int):
        """block, keys, whether more than ``hot`` suffixes have each, for each block with a key that an insertion met again."""
        if not self.found:
            return
        wanted = np.unique(np.concatenate(self.found))
        parts = []
        for held, blocks, counts in self.levels:
            at = np.minimum(np.searchsorted(wanted, held), len(wanted) - 1)
            there = np.flatnonzero(wanted[at] == held)
            parts.append((at[there], blocks[there], counts[there]))
        which, blocks, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        total = np.bincount(which, weights=counts, minlength=len(wanted))
        order = np.lexsort((which, blocks))
        which, blocks, counts = which[order], blocks[order], counts[order]
        cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(blocks[i]), wanted[which[i:j]], total[which[i:j]] > hot, int(counts[i:j].sum())


def _shard_rows(arrays: DataFrame, bits: int) -> DataFrame:
    """A block's suffix array cut by key ranges: shard, block, keys, counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for block, keys, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)
                shards = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(k) else [0]
                rows += [(int(shards[i]), block, k[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield _batch(rows, pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return arrays.select("block", "keys", "counts").mapInArrow(run, "shard int, block long, keys binary, counts binary")


_INDEX = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("keys", "blocks", "counts", "hot")], ("n", pa.int64())])


def _indexed(new: DataFrame, levels: DataFrame, hot: int) -> DataFrame:
    """kind 0: the levels after the new arrays; kind 1: hits."""

    def run(key, arrays, held):
        of = lambda r, name, kind: np.frombuffer(r[name], kind)
        family = Levels([(of(r, "keys", np.uint64), of(r, "blocks", np.int64), of(r, "counts", np.uint32)) for r in sorted(held.to_pylist(), key=lambda r: r["level"])])
        for r in sorted(arrays.to_pylist(), key=lambda r: r["block"]):
            family.insert(of(r, "keys", np.uint64), r["block"], of(r, "counts", np.uint32))
        shard = key[0].as_py()
        rows = [(0, shard, i, None, k.tobytes(), b.tobytes(), c.tobytes(), None, len(k)) for i, (k, b, c) in enumerate(family.levels)]
        rows += [(1, shard, None, block, k.tobytes(), None, None, h.astype(np.uint8).tobytes(), n) for block, k, h, n in family.hits(hot)]
        return pa.Table.from_batches([_batch(rows, _INDEX)])

    schema = "kind int, shard int, level int, block long, keys binary, blocks binary, counts binary, hot binary, n long"
    return new.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(run, schema)


# --- the exact comparison -------------------------------------------------------

_FOUND = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("doc", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), *[(n, pa.binary()) for n in ("places", "text")], ("known", pa.bool_()), ("id", pa.int64())])
_PLACE = np.dtype([("known", "u1"), ("id", "<i8"), ("doc", "<i4"), ("begin", "<i8"), ("left", "u1"), ("length", "<u2")])


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents as maximal runs, sorted."""
    if not len(doc):
        return doc, start, end
    apart = doc.astype(np.int64) * (int(end.max()) + 1)
    order = np.argsort(apart + start, kind="stable")
    a, b = (apart + start)[order], np.maximum.accumulate((apart + end)[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    apart = apart[order]
    return doc[order][new], (a - apart)[new], (b - apart)[np.concatenate([new[1:], [True]])]


def _in_block(row: dict, shards: int) -> list[tuple]:
    """Rows of _FOUND for a block. kind 0: spans of equal contexts that also stand earlier in the block; 1: contexts of a shard; 2: single windows of hot keys."""
    known, ids, ends, whole = _unpacked(row["size"], row["ids"], row["ends"], row["text"])
    key, place, begin, end = anchors(np.frombuffer(whole, np.uint8), ends)
    if not len(key):
        return []
    hits = row["hits"] or []
    wanted = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(h["keys"], np.uint64) for h in hits]])
    warm = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(h["hot"], np.uint8) for h in hits]]).astype(bool)
    pick = np.isin(key, wanted)
    if row["new"]:
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        pick |= times[which] > 1
    key, place, begin, end = (x[pick] for x in (key, place, begin, end))
    doc = np.searchsorted(ends, begin, side="right").astype(np.int32)
    base, block, first, later = np.concatenate([[0], ends[:-1]]), row["block"], {}, []
    for i in np.lexsort((begin, doc, ids[doc], known[doc])).tolist():
        context = (int(place[i] - begin[i]), whole[begin[i] : end[i] + LENGTH])
        if first.setdefault(context, i) != i:
            later.append(i)
    gone = np.array(later, np.int64)
    runs = _union(doc[gone], begin[gone] - base[doc[gone]], end[gone] + LENGTH - base[doc[gone]])
    out = [(0, None, block, *run, None, None, None, None) for run in zip(*[x.tolist() for x in runs], strict=True)]
    kept = np.sort(np.fromiter(first.values(), np.int64, len(first)))
    hot = np.isin(key[kept], wanted[warm])
    for i in kept[hot].tolist():
        d = int(doc[i])
        for p in range(int(begin[i]), int(end[i]) + 1):
            out.append((2, None, block, d, p - int(base[d]), p - int(base[d]) + LENGTH, None, whole[p : p + LENGTH], bool(known[d]), int(ids[d])))
    kept = kept[~hot]
    if len(kept):
        shard = (_mixed(key[kept] * _M1) % np.uint64(shards)).astype(np.int64)
        by = kept[np.argsort(shard, kind="stable")]
        shard.sort()
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = by[i:j]
            own = own[np.argsort(key[own], kind="stable")]  # like contexts side by side
            at = np.zeros(len(own), _PLACE)
            d = doc[own]
            at["known"], at["id"], at["doc"], at["begin"] = known[d], ids[d], d, begin[own] - base[d]
            at["left"], at["length"] = place[own] - begin[own], end[own] + LENGTH - begin[own]
            text = b"".join(whole[begin[k] : end[k] + LENGTH] for k in own.tolist())
            out.append((1, int(shard[i]), block, None, None, len(text), at.tobytes(), pa.Codec("zstd").compress(text, asbytes=True), None, None))
    return out


def _sorted_lcp(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and each one's common prefix with the one before it."""
    width = rows.shape[1]
    wide = -(-width // 8) * 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([words[:, i] for i in range(words.shape[1] - 1, -1, -1)])
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    common_part = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate([[0], common_part])


def repeated_windows(at: np.ndarray, blocks: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """Contexts (places, their blocks, all texts in one and where each starts): (context, first, last window) of runs of windows that stand earlier too."""
    n = len(at)
    order = np.lexsort((at["begin"], at["doc"], blocks, at["id"], at["known"]))
    at, starts = at[order], starts[order]
    left, length = at["left"].astype(np.int64), at["length"].astype(np.int64)
    right = length - left
    # Suffixes from the anchor on, and what stands before it, reversed; zeros fill up, lengths tell.
    padded = np.concatenate([texts, np.zeros(LENGTH, np.uint8)])
    steps = np.arange(LENGTH)
    ahead = padded[np.minimum(starts[:, None] + left[:, None] + steps, len(texts))]
    ahead[steps >= right[:, None]] = 0
    back = np.arange(REACH - 1)
    behind = padded[np.maximum(starts[:, None] + left[:, None] - 1 - back, 0)]
    behind[back >= left[:, None]] = 0
    to_right, lcp_right = _sorted_lcp(ahead)
    to_left, lcp_left = _sorted_lcp(behind)
    last = length - LENGTH  # the last window's distance from the first
    gone = np.zeros((n, REACH), bool)  # by a window's distance from the anchor
    for back_by in range(REACH):
        mine = np.flatnonzero((left >= back_by) & (left - back_by <= last))
        if len(mine) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[to_right] = np.cumsum(lcp_right < LENGTH - back_by)  # the LCP interval that each suffix is in
        b[to_left] = np.cumsum(lcp_left < back_by)
        _, first = np.unique(a[mine] * (n + 1) + b[mine], return_index=True)
        later = np.ones(len(mine), bool)
        later[first] = False
        gone[mine[later], back_by] = True
    by_window = gone[:, ::-1]  # the window furthest ahead of the anchor comes first
    edge = np.diff(np.pad(by_window.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    first, final = left[i] - (REACH - 1 - a), left[i] - (REACH - b)
    return list(zip(order[i].tolist(), first.tolist(), final.tolist(), strict=True))


def _compared(contexts: DataFrame) -> DataFrame:
    """SPANS of contexts, by shard."""

    def run(key, table):
        at, blocks, texts = [], [], []
        for r in table.to_pylist():
            at.append(np.frombuffer(r["places"], _PLACE))
            blocks.append(np.full(len(at[-1]), r["block"], np.int64))
            texts.append(np.frombuffer(pa.Codec("zstd").decompress(r["text"], r["end"], asbytes=True), np.uint8))
        places, block = np.concatenate(at), np.concatenate(blocks)
        starts = np.concatenate([[0], np.cumsum(places["length"], dtype=np.int64)[:-1]])
        found = repeated_windows(places, block, np.concatenate(texts), starts)
        i = np.array([x[0] for x in found], np.int64)
        begin = places["begin"][i]
        spans = [pa.array(block[i]), pa.array(places["doc"][i]), pa.array(begin + np.array([x[1] for x in found], np.int64)), pa.array(begin + np.array([x[2] + LENGTH for x in found], np.int64))]
        return pa.Table.from_arrays(spans, names=["block", "doc", "start", "end"])

    return contexts.select("shard", "block", "places", "text", "end").groupBy("shard").applyInArrow(run, SPANS)


def _hot_spans(windows: DataFrame) -> DataFrame:
    """SPANS of single windows that stand earlier too; natively, so equal ones combine before the shuffle."""
    place = F.struct("known", "id", "block", "doc", "start")
    first = windows.groupBy("text").agg(F.min(place).alias("first"))
    joined = common.salted_lookup(windows.withColumn("place", place), first, ["text"], F.struct("block", "doc", "start"))
    return joined.where(F.col("place") != F.col("first")).select("block", "doc", "start", "end")


# --- the operator ---------------------------------------------------------------


@dataclass
class Family:
    """Documents, their suffix arrays and what goes; tables in the shared folder."""

    spark: SparkSession
    root: str
    blocks: list[str] = field(default_factory=list)
    spans: list[str] = field(default_factory=list)
    levels: str | None = None
    bits: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Family:
        return cls(spark, common.shared_path(spark, "suffixes"))

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _split(self, levels: DataFrame, bits: int) -> DataFrame:
        """Levels cut into more shards, as they have grown."""
        more = bits - self.bits

        def run(batches):
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    k, b, c = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["blocks"], np.int64), np.frombuffer(r["counts"], np.uint32)
                    shards = (k >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.searchsorted(shards, np.arange(r["shard"] << more, (r["shard"] + 1 << more) + 1))
                    rows += [(int(shards[i]), r["level"], k[i:j].tobytes(), b[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j]
                if rows:
                    yield _batch(rows, pa.schema([("shard", pa.int32()), ("level", pa.int32()), *[(n, pa.binary()) for n in ("keys", "blocks", "counts")]]))

        return levels.mapInArrow(run, LEVELS)

    def insert(self, docs: DataFrame) -> Family:
        """With a new batch of documents (doc_id, text); earlier documents may lose strings too, to smaller ids of the batch."""
        at, turn = f"{self.root}/{len(self.blocks)}", len(self.blocks)
        _blocks(docs, turn).write.option("compression", "zstd").parquet(f"{at}/blocks")
        new = self._read([f"{at}/blocks"], BLOCKS)
        old_keys = self._read([self.levels], _LEVEL_ROWS).where("kind = 0").agg(F.sum("n")).first()[0] if self.levels else 0
        n_keys, n_multi = new.agg(F.sum("n_keys"), F.sum("n_multi")).first()
        bits = max(self.bits, (max(0, (n_keys or 0) + (old_keys or 0) - 1) // SHARD_KEYS).bit_length())
        held = self._read([self.levels] if self.levels else [], _LEVEL_ROWS).where("kind = 0").select("shard", "level", "keys", "blocks", "counts")
        if bits != self.bits and self.levels:
            held = self._split(held, bits)
        _indexed(_shard_rows(new, bits), held, HOT).write.option("compression", "zstd").parquet(f"{at}/index")
        hits = self._read([f"{at}/index"], _LEVEL_ROWS).where("kind = 1")
        n_hits = hits.agg(F.sum("n")).first()[0] or 0
        shards = max(1, -(-(n_hits + (n_multi or 0)) // SHARD_CONTEXTS))
        _found(self._read([*self.blocks, f"{at}/blocks"], BLOCKS), hits, turn, shards).write.option("compression", "zstd").partitionBy("kind").parquet(f"{at}/found")
        found = self._read([f"{at}/found"], _FOUND_ROWS)
        spans = found.where("kind = 0").select("block", "doc", "start", "end").unionByName(_compared(found.where("kind = 1")))
        windows = found.where("kind = 2")
        if windows.take(1):
            spans = spans.unionByName(_hot_spans(windows))
        spans.write.parquet(f"{at}/spans")
        self._drop(f"{at}/found")
        if self.levels:
            self._drop(self.levels)
        return Family(self.spark, self.root, [*self.blocks, f"{at}/blocks"], [*self.spans, f"{at}/spans"], f"{at}/index", bits)

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def kept(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay (they may no longer be UTF-8), of every document so far."""
        spans = self._read(self.spans, SPANS).groupBy("block").agg(F.collect_list(F.struct("doc", "start", "end")).alias("spans"))
        whole = self._read(self.blocks, BLOCKS).select("block", "size", "ids", "ends", "text").hint("merge").join(spans, "block", "left")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    known, ids, ends, text = _unpacked(*[batch.column(k)[i].as_py() for k in range(1, 5)])
                    base, n = np.concatenate([[0], ends[:-1]]).tolist(), len(ends)
                    removed, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    kept: list = [None] * n
                    if batch.column(5)[i].is_valid:
                        held = batch.column(5)[i].values
                        doc, start, end = _union(*[held.field(k).to_numpy(zero_copy_only=False) for k in range(3)])
                        np.add.at(removed, doc, end - start)
                        np.add.at(count, doc, 1)
                        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
                        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                            d = int(doc[x])
                            edges = zip([0, *end[x:y].tolist()], [*start[x:y].tolist(), int(ends[d]) - base[d]], strict=True)
                            kept[d] = b"".join(text[base[d] + a : base[d] + b] for a, b in edges)
                    rows = [(int(ids[d]) if known[d] else None, int(ends[d]) - base[d], int(removed[d]), int(count[d]), text[base[d] : ends[d]] if kept[d] is None else kept[d]) for d in range(n)]
                    yield _batch(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

        return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


_LEVEL_ROWS = "kind int, shard int, level int, block long, keys binary, blocks binary, counts binary, hot binary, n long"
_FOUND_ROWS = "kind int, shard int, block long, doc int, start long, end long, places binary, text binary, known boolean, id long"


def _found(blocks: DataFrame, hits: DataFrame, turn: int, shards: int) -> DataFrame:
    """Rows of _FOUND of all blocks that are new or have hits."""
    per_block = hits.groupBy("block").agg(F.collect_list(F.struct("keys", "hot")).alias("hits"))
    new = F.shiftright("block", 48) == turn
    rows = blocks.select("block", "size", "ids", "ends", "text", "n_multi").hint("merge").join(per_block, "block", "left").withColumn("new", new)
    rows = rows.where(F.col("hits").isNotNull() | (F.col("new") & (F.col("n_multi") > 0)))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = _in_block(batch.slice(i, 1).to_pylist()[0], shards)
                for at in range(0, len(out), 10_000):
                    yield _batch(out[at : at + 10_000], _FOUND)

    return rows.mapInArrow(run, _FOUND_ROWS)


def remove(docs: DataFrame) -> DataFrame:
    """From an empty family: one batch of all documents; its blocks pass through the levels one by one."""
    return Family.empty(docs.sparkSession).insert(docs).kept()

