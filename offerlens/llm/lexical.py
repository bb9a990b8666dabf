"""Operator 12: ranked lexical search over a clustered index of documents reordered by recursive graph bisection.

Bisection halves the graph of documents and terms again and again, swapping documents
between the halves while that lowers the estimated bits of the terms' gaps, so documents with like terms
come to stand side by side. The first halvings are fitted on a bounded sample; every document
then goes down that tree by the terms it holds. What a leaf receives is bisected exactly, on the
documents' own graph, and cut into clusters of CLUSTER_DOCS. The index holds all terms of all
documents: for each cluster and term the places, the frequencies, and of each frequency the
shortest document, which is all that a bound needs whatever N and L become.

A search sums each item's bounds by cluster and visits clusters in falling order of bound, a few
first, then more at a time. A cluster is scored exactly, mapped back to doc_id (ties go to the smaller)
and merged into the item's best. The search of an item stops when no cluster's bound reaches
the last of its best scores; equal bounds are still visited, since a smaller doc_id might tie.

Scale: texts are read once and never shuffled; a document's distinct terms are, once, to its
cluster. Leaves that receive many documents are dealt over parts of bounded size. A visit
reads only the postings of the items' terms. Terms of the items are broadcast up to
BROADCAST_TERMS, else joined by a shuffle. Nothing but the sample and totals comes to the driver.

Defined results: null texts and texts without a term aren't ranked, nor counted in N; a null doc_id
stands before others in ties; repeated rows are ranked each; items that share an id are searched each and
ranked by themselves; null items have no rows; other columns aren't read; empty tables give
an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The fit's sample: documents, characters of the longest, terms (the commonest that two hold), and halvings at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TERMS, DEPTH = 4096, 1 << 16, 20_000, 6
#: Documents and distinct terms of documents that are bisected in one task, and documents of a cluster.
GROUP_DOCS, GROUP_PAIRS, CLUSTER_DOCS = 8192, 4_000_000, 1024
#: Clusters that an item visits first, and how many times more in each further turn.
FIRST, MORE = 4, 8
BROADCAST_TERMS = 100_000
#: Swaps are tried so often a halving.
ROUNDS = 8
_UPPER = range(ord("A"), ord("Z") + 1)
_TERM_BYTES = bytes(b + 32 if b in _UPPER else b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256))

FORWARD = "row long, doc_id long, n long, k long, leaf int, terms binary, tfs binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of anything beyond ASCII; A-Z in lower case."""
    return (text or b"").translate(_TERM_BYTES).split()


# --- recursive graph bisection --------------------------------------------------


def _bits(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    return degree * np.log2(size / (degree + 1))


def bisected(doc: np.ndarray, term: np.ndarray, n: int, least: int) -> np.ndarray:
    """Order of n documents (edges: document, term) after halving until parts have at most ``least``."""
    order, cuts = np.arange(n), [0, n]
    width = int(term.max()) + 1 if len(term) else 1
    while max(b - a for a, b in zip(cuts, cuts[1:])) > least:
        middles = [(a + b) // 2 if b - a > least else b for a, b in zip(cuts, cuts[1:])]
        sizes = np.diff(cuts)
        part, left = np.empty(n, np.int64), np.empty(n, bool)
        part[order] = np.repeat(np.arange(len(sizes)), sizes)
        left[order] = np.concatenate([np.arange(a, b) < m for a, b, m in zip(cuts, cuts[1:], middles)])
        lefts = np.array(middles) - np.array(cuts[:-1])
        rights = sizes - lefts
        active = np.flatnonzero((rights > 0)[part[doc]])
        _, group, degree = np.unique(part[doc[active]] * width + term[active], return_inverse=True, return_counts=True)
        matter = degree[group] > 1  # a term of one document costs the same on both sides
        edges, group = active[matter], group[matter]
        _, group, degree = np.unique(group, return_inverse=True, return_counts=True)
        of_edge = doc[edges]
        of_group = np.zeros(len(degree), np.int64)
        of_group[group] = part[of_edge]
        n_left, n_right = np.maximum(lefts, 1)[of_group], np.maximum(rights, 1)[of_group]
        for _ in range(ROUNDS if len(edges) else 0):
            here = left[of_edge]
            a = np.bincount(group, weights=here, minlength=len(degree))
            b = degree - a
            now = _bits(a, n_left) + _bits(b, n_right)
            to_right = now - _bits(np.maximum(a - 1, 0), n_left) - _bits(b + 1, n_right)
            to_left = now - _bits(a + 1, n_left) - _bits(np.maximum(b - 1, 0), n_right)
            gain = np.bincount(of_edge, weights=np.where(here, to_right[group], to_left[group]), minlength=n)
            by_gain = np.lexsort((-gain, part))
            one, other = by_gain[left[by_gain]], by_gain[~left[by_gain]]
            rank_one, rank_other = _ranks(part[one]), _ranks(part[other])
            pairs = np.minimum(lefts, rights)
            one, other = one[rank_one < pairs[part[one]]], other[rank_other < pairs[part[other]]]
            swap = gain[one] + gain[other] > 1e-9
            if not swap.any():
                break
            left[one[swap]], left[other[swap]] = False, True
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        order = np.lexsort((place, ~left, part))
        cuts = sorted({*cuts, *middles})
    return order


def _ranks(sorted_parts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of equal parts."""
    if not len(sorted_parts):
        return sorted_parts
    new = np.flatnonzero(np.concatenate([[True], sorted_parts[1:] != sorted_parts[:-1]]))
    return np.arange(len(sorted_parts)) - np.repeat(new, np.diff(np.concatenate([new, [len(sorted_parts)]])))


@dataclass
class Tree:
    """Halvings fitted on a sample: for each inner node (children of i: 2i+1, 2i+2) what each term says for the left, and from which sum on a document goes there."""

    terms: dict[bytes, int]
    weights: np.ndarray
    least: np.ndarray
    depth: int

    @classmethod
    def fit(cls, texts: list[bytes], depth: int) -> Tree:
        held = [set(terms_of(t)) for t in texts]
        common_terms = sorted(((-n, t) for t, n in Counter(t for h in held for t in h).items() if n > 1))[:SAMPLE_TERMS]
        terms = {t: i for i, (_, t) in enumerate(common_terms)}
        doc = np.array([d for d, h in enumerate(held) for t in h if t in terms], np.int64)
        term = np.array([terms[t] for h in held for t in h if t in terms], np.int64)
        inner = (1 << depth) - 1
        weights, least = np.zeros((inner, max(1, len(terms))), np.float32), np.zeros(inner)
        members = {0: np.arange(len(held))}
        for node in range(inner):
            own = members.pop(node)
            number = np.full(len(held), -1)
            number[own] = np.arange(len(own))
            mine = number[doc] >= 0 if len(doc) else np.zeros(0, bool)
            d, t = number[doc[mine]], term[mine]
            order = bisected(d, t, len(own), max(1, -(-len(own) // 2)))
            half = len(own) // 2
            is_left = np.zeros(len(own), bool)
            is_left[order[:half]] = True
            a, b = (np.bincount(t[is_left[d] == side], minlength=weights.shape[1]) for side in (True, False))
            weights[node] = np.log((a + 0.5) / (half + 1)) - np.log((b + 0.5) / (len(own) - half + 1))
            sums = np.bincount(d, weights=weights[node][t], minlength=len(own))
            least[node] = np.median(sums) if len(own) else 0
            members[2 * node + 1], members[2 * node + 2] = own[order[:half]], own[order[half:]]
        return cls(terms, weights, least, depth)

    def leaves(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n documents (edges: document, number of a known term)."""
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            sums = np.bincount(doc, weights=self.weights[node[doc], term], minlength=n)
            node = 2 * node + np.where(sums >= self.least[node], 1, 2)
        return node - ((1 << self.depth) - 1)


# --- the clustered index ----------------------------------------------------------


def _forward(docs: DataFrame, tree: Tree) -> DataFrame:
    """Rows of FORWARD: each document's distinct terms, their frequencies and its leaf."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("leaf", pa.int32()), ("terms", pa.binary()), ("tfs", pa.binary())])

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.sliced([batch], 1, 2 << 20):
                ids, joined, tfs, totals, sizes, edges = [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    held = Counter(terms_of(text.as_buffer().to_pybytes() if text.is_valid else None))
                    if not held:
                        continue
                    known = [tree.terms[t] for t in held if t in tree.terms]
                    edges.append(np.array(known, np.int64))
                    counts = np.fromiter(held.values(), np.uint32, len(held))
                    ids.append(doc_id)
                    joined.append(b" ".join(held))
                    tfs.append(counts.tobytes())
                    totals.append(int(counts.sum(dtype=np.int64)))
                    sizes.append(len(held))
                if not ids:
                    continue
                doc = np.repeat(np.arange(len(ids)), [len(e) for e in edges])
                leaf = tree.leaves(doc, np.concatenate(edges), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), pa.array(sizes, pa.int64()), pa.array(leaf.astype(np.int32)), pa.array(joined, pa.binary()), pa.array(tfs, pa.binary())], schema=schema)
                row += len(ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FORWARD)


_ROWS = pa.schema([("cluster", pa.int64()), ("term", pa.string()), ("n_docs", pa.int32()), ("places", pa.binary()), ("tfs", pa.binary()), ("tops", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
INDEX = "cluster long, term string, n_docs int, places binary, tfs binary, tops binary, ids array<long>, sizes array<long>"


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values of the parts of an array between edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _clusters(group: int, table: pa.Table):
    """Index rows of a group of documents: one with ids and sizes (term null) a cluster, then one a term."""
    table = table.take(np.argsort(table.column("row").to_numpy(), kind="stable"))
    k = table.column("k").to_numpy()
    n, sizes, ids = len(k), table.column("n").to_numpy(), table.column("doc_id").to_pylist()
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for row in table.column("terms") for t in row.as_py().split(b" ")), np.int64, int(k.sum()))
    tf = np.frombuffer(b"".join(table.column("tfs").to_pylist()), np.uint32)
    doc = np.repeat(np.arange(n), k)
    order = bisected(doc, term, n, CLUSTER_DOCS)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    names = pa.array(list(number), pa.binary()).cast(pa.string())
    clusters = -(-n // CLUSTER_DOCS)
    bounds = [n * c // clusters for c in range(clusters + 1)]
    of_edge = place[doc]
    for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
        cluster = group << 16 | c
        own = order[a:b]
        yield pa.RecordBatch.from_arrays([pa.array([cluster], pa.int64()), *[pa.array([None], f.type) for f in list(_ROWS)[1:6]], pa.array([[ids[i] for i in own.tolist()]], pa.list_(pa.int64())), pa.array([sizes[own].tolist()], pa.list_(pa.int64()))], schema=_ROWS)
        mine = np.flatnonzero((of_edge >= a) & (of_edge < b))
        mine = mine[np.lexsort((of_edge[mine], term[mine]))]
        t, p, f = term[mine], (of_edge[mine] - a).astype(np.uint16), tf[mine]
        edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        size = sizes[doc[mine]]
        by = np.lexsort((size, f, t))
        new = np.concatenate([[True], (t[by][1:] != t[by][:-1]) | (f[by][1:] != f[by][:-1])])
        tops = by[new]  # of each term and frequency the shortest document
        pairs = np.stack([f[tops].astype(np.int64), size[tops]], axis=1)
        top_edges = np.concatenate([np.searchsorted(t[tops], t[edges[:-1]]), [len(tops)]])
        for x in range(0, len(edges) - 1, 10_000):
            e, g = edges[x : x + 10_001], top_edges[x : x + 10_001]
            m = len(e) - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, cluster)), names.take(pa.array(t[e[:-1]])), pa.array(np.diff(e).astype(np.int32)),
                _cut(p[e[0] : e[-1]], e - e[0]), _cut(f[e[0] : e[-1]], e - e[0]), _cut(pairs[g[0] : g[-1]].ravel(), 2 * (g - g[0])), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64())),
            ], schema=_ROWS)


@dataclass
class Index:
    """All terms of all documents by cluster, as a table in the shared folder, with the corpus' totals."""

    rows: DataFrame  # INDEX
    n_docs: int
    n_terms: int

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        spark = docs.sparkSession
        path, total = common.shared_path(spark, "lexical"), docs.count()
        depth = min(DEPTH, max(0, (total // GROUP_DOCS).bit_length()))
        tree = Tree.fit(_sample(docs, total) if depth else [], depth)
        _forward(docs, tree).write.option("compression", "zstd").parquet(f"{path}/forward")
        forward = spark.read.schema(FORWARD).parquet(f"{path}/forward")
        leaves = forward.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("k").alias("pairs"), F.sum("n").alias("terms")).collect()  # 2 ** DEPTH rows at most
        parts = {r["leaf"]: max(-(-r["docs"] // GROUP_DOCS), -(-r["pairs"] // GROUP_PAIRS)) for r in leaves}
        first = {leaf: sum(parts[x] for x in parts if x < leaf) for leaf in parts}
        by_leaf = lambda of: F.array(*[F.lit(of.get(i, 1)) for i in range(1 << depth)])[F.col("leaf")]
        group = by_leaf(first) + F.pmod(F.xxhash64("row"), by_leaf(parts))

        def run(key, table):
            return pa.Table.from_batches(_clusters(key[0].as_py(), table), schema=_ROWS)

        made = forward.withColumn("group", group.cast("long")).groupBy("group").applyInArrow(run, INDEX)
        made.write.option("compression", "zstd").parquet(f"{path}/index")
        return cls(spark.read.schema(INDEX).parquet(f"{path}/index"), sum(r["docs"] for r in leaves), sum(r["terms"] for r in leaves))

    # --- search ---

    def search(self, items: DataFrame, k: int = 10) -> DataFrame:
        """item_id, rank, doc_id, score of the k best documents of each row of ``items`` (item_id, text)."""
        return self.visit(items, k)[0]

    def visit(self, items: DataFrame, k: int = 10) -> tuple[DataFrame, list[int]]:
        """The result, and how many pairs of item and cluster each turn visited."""
        spark = items.sparkSession
        numbered = common.checkpointed(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
        asked = common.checkpointed(_item_terms(numbered))
        terms = common.checkpointed(asked.select("term").distinct())
        few = terms.count() <= BROADCAST_TERMS
        held = self.rows.where(F.col("term").isNotNull()).join(F.broadcast(terms) if few else terms, "term")
        path = common.shared_path(spark, "postings")
        _with_bounds(held, self.n_docs, self.n_terms).write.option("compression", "zstd").parquet(path)
        held = spark.read.parquet(path)
        weights = held.groupBy("term").agg(F.sum("n_docs").alias("df"))
        weights = weights.select("term", F.floor(1000 * F.log((2 * F.lit(self.n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
        asked = common.checkpointed(asked.join(weights, "term"))
        bounds = held.select("term", "cluster", "best").join(asked, "term").groupBy("item", "cluster").agg(F.sum(F.col("w") * F.col("best")).alias("bound")).where(F.col("bound") > 0)
        bounds = common.checkpointed(bounds)
        wanted = asked.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
        docs = self.rows.where(F.col("term").isNull()).select("cluster", "ids", "sizes")
        best, state, turns, take = None, None, [], FIRST
        while True:
            ahead = bounds
            if state is not None:  # clusters behind the last one visited, in falling order of bound, that may still matter
                after = (F.col("bound") < F.col("last.bound")) | ((F.col("bound") == F.col("last.bound")) & (F.col("cluster") > F.col("last.cluster")))
                ahead = bounds.join(state, "item").where(after & (F.col("bound") >= F.col("least"))).select(*bounds.columns)
            rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "cluster"))
            visits = common.checkpointed(ahead.withColumn("turn", rank).where(F.col("turn") <= take).drop("turn"))
            turns.append(visits.count())
            if not turns[-1]:
                break
            found = _scored(held, docs, visits.join(wanted, "item"), self.n_docs, self.n_terms, k)
            if best is not None:
                found = found.unionByName(best.select(*found.columns))
            placed = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
            best = common.checkpointed(found.withColumn("rank", placed).where(F.col("rank") <= k))
            last = visits.groupBy("item").agg(F.max(F.struct("bound", (-F.col("cluster")).alias("turned"))).alias("x"), F.min(F.struct("bound", (-F.col("cluster")).alias("turned"))).alias("y"))
            last = last.select("item", F.struct(F.col("y.bound").alias("bound"), (-F.col("y.turned")).alias("cluster")).alias("last"))
            least = best.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
            now = last.join(least, "item", "left").select("item", "last", F.coalesce("least", F.lit(1)).alias("least"))
            state = common.checkpointed(now)
            take *= MORE
        if best is None:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"), turns
        out = best.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        return out, turns


def _sample(docs: DataFrame, total: int) -> list[bytes]:
    some = docs.where(F.char_length("text").between(1, SAMPLE_CHARS) & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // (2 * SAMPLE_DOCS)))) == 0))
    return [r["text"].encode() for r in some.select("text").limit(SAMPLE_DOCS).collect()]


def _item_terms(items: DataFrame) -> DataFrame:
    """item, term: each once."""

    def run(batches):
        for batch in batches:
            found = [(i, t.decode()) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in dict.fromkeys(terms_of((text or "").encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["item", "term"])

    return items.select("item", "text").mapInArrow(run, "item long, term string")


def _impact(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    m = 100 - 90 + 90 * size * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _with_bounds(held: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Postings with ``best``, the largest impact of a document in the cluster."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tops = batch.column(5).to_pylist()
            pairs = np.frombuffer(b"".join(tops), np.int64).reshape(-1, 2)
            starts = np.concatenate([[0], np.cumsum([len(x) // 16 for x in tops])[:-1]])
            best = np.maximum.reduceat(_impact(pairs[:, 0], pairs[:, 1], n_docs, n_terms), starts)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(best)], names=["cluster", "term", "n_docs", "places", "tfs", "best"])

    return held.select("cluster", "term", "n_docs", "places", "tfs", "tops").mapInArrow(run, "cluster long, term string, n_docs int, places binary, tfs binary, best long")


def _scored(held: DataFrame, docs: DataFrame, visits: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score of each visit's k best."""
    seen = visits.select("cluster").distinct()
    left = held.select("cluster", "term", "places", "tfs", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes")).join(seen, "cluster", "left_semi")
    own = docs.join(seen, "cluster", "left_semi").select("cluster", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("tfs"), "ids", "sizes")
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(key, index, asks):
        if not index.num_rows or not asks.num_rows:
            return schema.empty_table()
        postings, ids, sizes = {}, None, None
        for r in index.to_pylist():
            if r["term"] is None:
                ids, sizes = r["ids"], np.array(r["sizes"], np.int64)
            else:
                postings[r["term"]] = (np.frombuffer(r["places"], np.uint16), np.frombuffer(r["tfs"], np.uint32))
        impacts = {t: _impact(tf, sizes[p], n_docs, n_terms) for t, (p, tf) in postings.items()}
        order = np.array([(i is not None, i or 0) for i in ids], dtype=[("known", "?"), ("id", "i8")])
        place = np.empty(len(ids), np.int64)
        place[np.argsort(order, kind="stable")] = np.arange(len(ids))
        out: list[tuple] = []
        for ask in asks.to_pylist():
            score = np.zeros(len(ids), np.int64)
            for t in ask["terms"]:
                if t["term"] in postings:
                    score[postings[t["term"]][0]] += t["w"] * impacts[t["term"]]
            top = np.flatnonzero(score > 0)
            if len(top) > k:
                top = top[score[top] >= np.partition(score[top], -k)[-k]]
            top = top[np.lexsort((place[top], -score[top]))][:k]
            out += [(ask["item"], ids[i], int(score[i])) for i in top.tolist()]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=schema)

    asked = visits.select(F.col("cluster").alias("at"), F.col("item").alias("item"), F.col("terms").alias("terms"))
    return left.unionByName(own).groupBy("cluster").cogroup(asked.groupBy("at")).applyInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: index all documents, then search."""
    return Index.of(docs).search(items, k)
