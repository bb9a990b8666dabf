"""Operator 6: SimHash near-duplicates by tiled exact comparison.

A text's fingerprint is the bitwise majority over the XXH64 hashes of its word
shingles (further 64-bit lanes come from the same hashes by a mixing step).
Distinct fingerprints are dealt into tiles of cells: a cell fixes the population
counts of a fingerprint's parts, and since these differ by no more than the
fingerprints do, tile pairs of cells whose counts differ beyond the radius are
never formed. Within a pair, numpy's exclusive-or and bit counts compare all
against all, again skipping rows beyond the radius in their whole count. A pair
of tiles returns a spanning forest of its links, never the links themselves, so
groups of thousands of near copies stay linear; stars of minima then connect the
forests.

With ``size_ratio`` fingerprints only propose: they are of sets of shingles, and
a link needs a Jaccard similarity of the sets of ``size_ratio`` or more (counts
of shingles then cannot differ by more than that). Candidates that the forests
connect meet again, in tiles of bounded size, with their sets; there a proposed
pair is checked exactly unless checked pairs connect it already.

Scale: fingerprints, not texts, are shuffled, each to a fixed number of cells;
copies collapse to one fingerprint before that and come back through a salted
join. Comparison itself grows with the square of distinct fingerprints, divided
by what the cells skip; the README has figures.

Defined results: texts with fewer words than a shingle hash their whole sequence;
null, empty and blank texts have fingerprint 0 and link like any other; each row is
a document, whatever doc_id it shares; a null doc_id takes part and is never the
smallest (a group of nothing else has a null component); other columns are ignored,
or kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
TILE = 4096
CHECK_TILE = 16_384
CHECK_SHINGLES = 2_000_000
_CHUNK = 65_536
_BLOCK = 1_000_000
_PAIRS = 20_000


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included."""
    found, tail = [], []
    h = xxhash.xxh64_intdigest
    for parts in common.word_blocks(data.lower()):
        parts = tail + parts
        if len(parts) >= words:
            if words == 3:
                shingles = [b"%b %b %b" % t for t in zip(parts, parts[1:], parts[2:], strict=False)]
            else:
                shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
            found.append(np.array([h(s, SEED) for s in shingles], dtype=np.uint64))
        tail = parts[1 - words :] if words > 1 else []
    if not found and tail:
        found.append(np.array([h(b" ".join(tail), SEED)], dtype=np.uint64))
    return found[0] if len(found) == 1 else np.concatenate([np.empty(0, dtype=np.uint64), *found])


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash of each shingle; the 0th is XXH64 itself."""
    if not k:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of runs of ``sizes`` hashes: the bits set in over half of each."""
    sums = np.zeros((len(sizes), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), _CHUNK):
        part, who = hashes[at : at + _CHUNK], owner[at : at + _CHUNK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        sums[who[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, shingle: int = 5, lanes: int = 1, distinct: bool = False, sets: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (shingles) and f0, f1, ... (64 bits each, as signed longs).

    ``distinct`` counts a repeated shingle once and adds a digest of the set, ``sets``
    the set itself (sorted, 8 bytes each); ``carry`` names long columns to keep.
    """
    names = [f"f{k}" for k in range(lanes)]
    longs = ["doc_id", "size", *names, *(["digest"] if distinct else []), *carry]
    arrow = pa.schema([*[(n, pa.int64()) for n in longs], *([("shingles", pa.binary())] if sets else [])])

    def run(batches):
        for batch in common.sliced(batches, 1):
            hashes = [shingle_hashes((t.as_py() or "").encode(), shingle) for t in batch.column(1)]
            hashes = [np.unique(h) for h in hashes] if distinct else hashes
            sizes = np.array([len(h) for h in hashes], dtype=np.int64)
            flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
            columns = [pa.array(majority(lane(flat, k), sizes).view(np.int64)) for k in range(lanes)]
            if distinct:
                columns.append(pa.array(np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in hashes], dtype=np.uint64).view(np.int64)))
            columns += [batch.column(2 + i) for i in range(len(carry))]
            if sets:
                columns.append(pa.array([h.tobytes() for h in hashes], type=pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *columns], schema=arrow)

    kept = [F.col(c).cast("long") for c in carry]
    return docs.select(F.col("doc_id").cast("long"), "text", *kept).mapInArrow(run, ", ".join(f"{n} long" for n in longs) + (", shingles binary" if sets else ""))


# --- comparing tiles ----------------------------------------------------------


def _offsets(parts: int, radius: int, bands: bool) -> list[int]:
    """Differences between the cells of a pair, each pair of cells once; 0 is a cell with itself."""
    out = []
    for band in (0, 1) if bands else (0,):
        for d in product(range(-radius, radius + 1), repeat=parts):
            if sum(map(abs, d)) <= radius and (band or not any(d) or next(x for x in d if x) > 0):
                out.append(sum(x * 128**i for i, x in enumerate(d)) + band * 128**parts)
    return out


def _cell(parts: int, ratio: float | None) -> Column:
    cell = F.lit(0).cast("long")
    for i in range(parts):
        low, high = 64 * i // parts, 64 * (i + 1) // parts
        mask = (1 << high) - (1 << low)
        cell = cell + F.bit_count(F.col("f0").bitwiseAND(F.lit(mask - (mask >> 63 << 64)))).cast("long") * 128**i
    if ratio:
        band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / math.log(1 / ratio) + 1e-9)
        cell = cell + band * 128**parts
    return cell


def _near(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, radius: int, ratio: float | None):
    """Yields (rows of a, rows of b) of pairs within the radius; columns of a and b are lanes."""
    order = np.argsort(np.bitwise_count(b).sum(1), kind="stable")
    b, b_size, b_ones = b[order], b_size[order], np.sort(np.bitwise_count(b).sum(1))
    rows = np.argsort(np.bitwise_count(a).sum(1), kind="stable")
    ones = np.bitwise_count(a).sum(1)[rows].astype(np.int64)
    step = max(1, _BLOCK // max(1, len(b)))
    for at in range(0, len(rows), step):
        mine = rows[at : at + step]
        low, high = np.searchsorted(b_ones, [ones[at] - radius, ones[min(at + step, len(rows)) - 1] + radius + 1])
        if low == high:
            continue
        lanes = a.shape[1]
        far = np.bitwise_count(a[mine, 0][:, None] ^ b[None, low:high, 0])
        for k in range(1, min(lanes, 3)):
            far = far + np.bitwise_count(a[mine, k][:, None] ^ b[None, low:high, k])
        i, j = np.nonzero(far <= radius)  # three lanes leave one in a hundred pairs of unlike texts, and any within the radius
        i, j = mine[i], j + low
        if lanes > 3 and len(i):
            ok = np.bitwise_count(a[i] ^ b[j]).sum(1) <= radius
            i, j = i[ok], j[ok]
        if ratio and len(i):
            small, large = np.minimum(a_size[i], b_size[j]), np.maximum(a_size[i], b_size[j])
            ok = np.maximum(small, 1) >= ratio * np.maximum(large, 1) - 1e-9
            i, j = i[ok], j[ok]
        yield i, order[j]


def similar(a: np.ndarray, b: np.ndarray, ratio: float) -> bool:
    """Whether two sets (distinct values) have that Jaccard similarity or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= ratio * (len(a) + len(b) - shared) - 1e-9


class _Union:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def find(self, x: int) -> int:
        while self.label[x] != x:
            self.label[x] = self.label[self.label[x]]
            x = self.label[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while not np.array_equal(up := self.label[self.label], self.label):
            self.label = up
        pairs = np.unique(self.label[i] * len(self.label) + self.label[j])
        for a, b in zip((pairs // len(self.label)).tolist(), (pairs % len(self.label)).tolist(), strict=True):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.label[max(a, b)] = min(a, b)

    def add_checked(self, i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], ratio: float) -> None:
        """Adds those pairs whose sets are similar; pairs that are connected already need no check."""
        for at in range(0, len(i), _PAIRS):
            root = self.roots()
            a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
            apart = root[a] != root[b]
            for a, b in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                x, y = self.find(a), self.find(b)
                if x != y and similar(sets[a], sets[b], ratio):
                    self.label[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.label[self.label], self.label):
            self.label = up
        return self.label


def tile_forest(a: dict, b: dict | None, radius: int, ratio: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) that connect what the tiles a and b link; b None: a with itself. With sets, each pair is checked."""
    other = b or a
    nodes = np.concatenate([a["node"], b["node"]]) if b else a["node"]
    union = _Union(len(nodes))
    for i, j in _near(a["lanes"], other["lanes"], a["size"], other["size"], radius, ratio):
        if len(i):
            j = j + len(a["node"]) if b else j
            if "sets" in a:
                union.add_checked(i, j, a["sets"] + b["sets"] if b else a["sets"], ratio)
            else:
                union.add(i, j)
    root = union.roots()
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    least = least[root]
    linked = nodes != least
    return nodes[linked], least[linked]


def links(nodes: DataFrame, radius: int, lanes: int = 1, parts: int = 3, size_ratio: float | None = None, tile: int = TILE) -> DataFrame:
    """(u, v) with u > v: forests over nodes (node, size, f0, ...) that connect all pairs within the radius."""
    names = [f"f{k}" for k in range(lanes)]
    nodes = nodes.withColumn("cell", _cell(parts, size_ratio))
    # a cell is a choice of part counts and a size band: some thousands at most, whatever the corpus
    cells = common.checkpointed(nodes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))
    home = nodes.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64(*names, "size"), F.col("tiles")).cast("int"))
    home = home.groupBy("cell", "tile").agg(F.collect_list(F.struct("node", "size", *names)).alias("rows"))
    home = common.checkpointed(home)
    shifts = F.array(*[F.lit(x).cast("long") for x in _offsets(parts, radius, bool(size_ratio))])
    visit = home.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("rows").alias("rows_a"), F.explode(shifts).alias("shift"))
    there = cells.select(F.col("cell").alias("to"), "tiles")
    visit = visit.withColumn("to", F.col("cell_a") + F.col("shift")).join(F.broadcast(there), "to")
    visit = visit.withColumn("to_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where((F.col("shift") != 0) | (F.col("to_tile") >= F.col("tile_a")))
    pairs = visit.join(home, (F.col("to") == F.col("cell")) & (F.col("to_tile") == F.col("tile")))
    pairs = pairs.select(((F.col("shift") == 0) & (F.col("tile") == F.col("tile_a"))).alias("itself"), "rows_a", F.when((F.col("shift") != 0) | (F.col("tile") != F.col("tile_a")), F.col("rows")).alias("rows_b"))

    return _forests(pairs, names, radius, size_ratio)


def _forests(pairs: DataFrame, names: list[str], radius: int, size_ratio: float | None) -> DataFrame:
    """The links of pairs of tiles: itself, rows_a, rows_b (null where a tile meets itself)."""

    def tile_of(cell) -> dict:
        rows = cell.values
        tile = {"node": rows.field("node").to_numpy(), "size": rows.field("size").to_numpy(), "lanes": np.stack([rows.field(n).to_numpy().view(np.uint64) for n in names], axis=1)}
        if rows.type.get_field_index("shingles") >= 0:
            tile["sets"] = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in rows.field("shingles")]
        return tile

    def run(batches):
        for batch in batches:
            us, vs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for itself, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
                u, v = tile_forest(tile_of(a), None if itself.as_py() else tile_of(b), radius, size_ratio)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long").distinct()


def checked_links(docs: DataFrame, nodes: DataFrame, found: DataFrame, shingle: int, radius: int, lanes: int, ratio: float, tile: int = CHECK_TILE, most: int = CHECK_SHINGLES) -> DataFrame:
    """(u, v) with u > v: forests that connect all candidates whose sets of shingles have similarity ``ratio``.

    ``found`` (node, component), as from ``components``, says which candidates meet. A tile holds ``tile`` sets
    or ``most`` shingles on average, so memory doesn't grow with a component; a component's sets are shipped once
    for each of its tiles, so tiles are as large as a task can well hold.
    """
    names = [f"f{k}" for k in range(lanes)]
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())  # the smallest of each, too
    sized = nodes.groupBy("node").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    of_group = sized.join(found, "node").groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / tile), F.ceil(F.sum(F.col("n") * F.col("size")) / most), F.lit(1)).alias("tiles"))
    asked = common.salted_lookup(found, of_group, ["component"], F.col("node"), how="inner").select("node", "component", "tiles")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, F.col("doc_id") == F.col("node"))
    rows = fingerprints(texts, shingle, lanes, distinct=True, sets=True, carry=("component", "tiles")).withColumnRenamed("doc_id", "node")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles"))).repartition("component", "tile")
    rows = rows.groupBy("component", "tile", "tiles", "node", "digest").agg(F.first(F.struct("node", "size", *names, "shingles")).alias("row"))
    home = common.checkpointed(rows.groupBy("component", "tile", "tiles").agg(F.collect_list("row").alias("rows")))
    alone = home.where("size(rows) > 1").select(F.lit(True).alias("itself"), F.col("rows").alias("rows_a"), F.when(F.lit(False), F.col("rows")).alias("rows_b"))
    many = home.where("tiles > 1")
    visit = many.where("tile < tiles - 1").select(F.col("component").alias("component_a"), F.col("rows").alias("rows_a"), F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("to"))
    across = visit.join(many, (F.col("component_a") == F.col("component")) & (F.col("to") == F.col("tile")))
    across = across.select(F.lit(False).alias("itself"), "rows_a", F.col("rows").alias("rows_b"))
    return _forests(alone.unionByName(across), names, radius, ratio)


# --- components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (u > v) reaches, by alternating stars."""
    edges = common.of_unknown_size(common.checkpointed(edges))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = common.salted_lookup(both, least, ["u"], F.col("v"), how="inner").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.salted_lookup(large, lowest, ["u"], F.col("v"), how="inner").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.of_unknown_size(common.checkpointed(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(now)


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number of its own for each row, written to the shared folder so that all who read it see the same."""
    path = common.shared_path(docs.sparkSession, "rows")
    docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _groups(docs: DataFrame, shingle: int, radius: int, lanes: int, parts: int, size_ratio: float | None) -> DataFrame:
    """doc_id, size, f0, ..., _row, _least: of each row's group the smallest (whether doc_id is null, doc_id, _row). ``docs`` has _row if ``size_ratio`` is given."""
    names = [f"f{k}" for k in range(lanes)]
    prints = fingerprints(docs, shingle, lanes, distinct=bool(size_ratio), carry=("_row",) if size_ratio else ())
    prints = common.checkpointed(prints if size_ratio else prints.withColumn("_row", F.monotonically_increasing_id()))
    kept = ["size", *names, "digest"] if size_ratio else names
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    nodes = prints.groupBy(*kept).agg(F.min(mine).alias("best"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.col("best.row"))
    nodes = common.checkpointed(nodes if size_ratio else nodes.withColumn("size", F.lit(0).cast("long")))
    found = components(links(nodes.select("node", "size", *names), radius, lanes, parts, size_ratio))
    if size_ratio:
        texts = docs.select(F.col("_row").alias("doc_id"), "text")
        found = components(checked_links(texts, nodes, found, shingle, radius, lanes, size_ratio))
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    least = nodes.join(members, "node").groupBy("component").agg(F.min("best").alias("_least"))
    of_node = common.salted_lookup(members, least, ["component"], F.col("node"), how="inner").select(F.col("node").alias("linked"), "_least")
    named = nodes.join(of_node, F.col("node") == F.col("linked"), "left").where((F.col("copies") > 1) | F.col("_least").isNotNull())
    named = named.select(*kept, F.coalesce("_least", "best").alias("_least"))
    return common.salted_lookup(prints, named, kept, F.col("_row")).withColumn("_least", F.coalesce("_least", mine)).drop("digest")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 80, lanes: int = 4, parts: int = 0, size_ratio: float | None = 0.8) -> DataFrame:
    """One row a document: doc_id, size, f0, ..., component_id (the smallest doc_id that it reaches, itself included).

    Two documents link if the Jaccard similarity of their sets of shingles is
    ``size_ratio`` or more, checked exactly. At radius 80 of 256 bits the
    fingerprints of such a pair at 0.8 differ in 38 bits on average (48 for the
    smallest sets, 4 and 5 shingles), those of unrelated texts in 128. Without
    ``size_ratio`` the fingerprints alone decide.
    """
    rows = docs.select("doc_id", "text")
    found = _groups(numbered(rows) if size_ratio else rows, shingle, radius, lanes, parts, size_ratio)
    return found.withColumn("component_id", F.col("_least.doc_id")).drop("_row", "_least")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 80, lanes: int = 4, parts: int = 0, size_ratio: float = 0.8) -> DataFrame:
    """One row of each group, that with the smallest doc_id (null is the largest), the first of the input among these; all columns stay."""
    taken = {c.lower() for c in docs.columns}
    name = next(x for k in range(len(taken) + 1) if (x := f"_row{k}") not in taken)
    rows = numbered(docs, name)
    found = _groups(rows.select("doc_id", "text", F.col(name).alias("_row")), shingle, radius, lanes, parts, size_ratio)
    gone = found.where(F.col("_least.row") != F.col("_row")).select(F.col("_row").alias(name))
    return rows.join(gone, name, "left_anti").select(*docs.columns)
