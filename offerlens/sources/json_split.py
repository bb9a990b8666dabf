"""JSON lists of any size, split over tasks by their own structure.

A snapshot is one JSON value: a list, or an object whose fields hold lists. Spark's text source cuts a large file
into blocks, and each block into pieces that end with a brace. Where a block begins, nobody knows
whether it stands inside a string, so each block says what it does to either case (quotes and
brackets, one row a block); put one behind the other these rows give each block's true start. Then
blocks are read again, each by itself, and yield the elements of the lists; elements that a block's edge cuts
are put together from the parts. No task and no row holds more than a block or an element.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|["\[\]{},]', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)
_EFFECTS = "path string, block long, size long, whole long, quoted_out boolean, depth_out int, quoted_in boolean, depth_in int, first string"
_PARTS = "path string, block long, kind string, idx long, container long, text string"


def _after(piece: str, quoted: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and by how much it changes the depth."""
    depth = 0
    for token in _TOKEN.findall(piece):
        if token == '"':
            quoted = not quoted
        elif not quoted and token in "[{":
            depth += 1
        elif not quoted and token in "]}":
            depth -= 1
    return quoted, depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    return rows.select(meta.file_path.alias("path"), meta.file_block_start.alias("block"), F.concat("value", F.lit("}")).alias("piece"), meta.file_size.alias("whole"))


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[str]]]:
    """(path, block, the file's bytes, pieces) of each block, whose pieces stand one behind the other."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    for (path, block, whole), group in groupby(rows(), key=lambda r: (r[0], r[1], r[3])):
        yield path, block, whole, (r[2] for r in group)


def _effects(pieces: DataFrame) -> DataFrame:
    def run(batches):
        for path, block, whole, group in _by_block(batches):
            ends, depths, first, size = [False, True], [0, 0], None, 0
            for piece in group:
                size += len(piece.encode())
                if first is None and piece.strip():
                    first = piece.strip()[0]
                for i in (0, 1):
                    ends[i], change = _after(piece, ends[i])
                    depths[i] += change
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "size": [size], "whole": [whole], "quoted_out": [ends[0]], "depth_out": pa.array([depths[0]], pa.int32()), "quoted_in": [ends[1]], "depth_in": pa.array([depths[1]], pa.int32()), "first": pa.array([first], pa.string())})

    return pieces.mapInArrow(run, _EFFECTS)


def _starts(effects: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(path, block) -> whether it begins inside a string, at which depth, and the depth of elements (0: none, as in files that break off); ``effects``: a row a block."""
    out: dict[tuple[str, int], tuple[bool, int, int]] = {}
    for path, rows in groupby(sorted(effects, key=lambda r: (r["path"], r["block"])), key=lambda r: r["path"]):
        quoted, depth, level, size, own = False, 0, 0, 0, {}
        for r in rows:
            level = level or {"[": 1, "{": 2}.get(r["first"], 0)
            own[path, r["block"]] = (quoted, depth, level)
            quoted, change = (r["quoted_in"], r["depth_in"]) if quoted else (r["quoted_out"], r["depth_out"])
            depth, size, whole = depth + change, size + r["size"], r["whole"]
        complete = not quoted and depth + (size - whole) == 0  # a brace was put behind a file that doesn't end with one
        out |= own if complete else {k: (q, d, 0) for k, (q, d, _) in own.items()}
    return out


class _Splitter:
    """One block's elements: parts between commas at ``level``, within containers that open there."""

    def __init__(self, quoted: bool, depth: int, level: int):
        self.quoted, self.depth, self.level = quoted, depth, level
        self.held: list[str] = []  # of the part that isn't ended
        self.whole = False  # whether that part began in this block
        self.container, self.n = 0, 0  # of this block; 0: opened before it
        self.shallow: list[str] = []  # text outside elements, where a container's key stands
        self.inside = depth >= level > 0

    def feed(self, piece: str) -> Iterator[tuple[str, int, int, str]]:
        """(kind, number, container, text): element, head (the end of one from before), open (a container: bracket and key)."""
        at = 0
        for found in _TOKEN.finditer(piece):
            token = found[0]
            if token == '"':
                self.quoted = not self.quoted
                continue
            if self.quoted or token[0] == "\\":
                continue
            if token in "[{":
                self.depth += 1
                if self.depth == self.level:
                    self.shallow.append(piece[at : found.start()])
                    key = _KEY.search("".join(self.shallow))
                    self.container += 1
                    yield "open", self.container, self.container, token + (key[1] if key else "")
                    self.shallow, self.held, self.whole, self.inside, at = [], [], True, True, found.end()
            elif token in "]}":
                if self.depth == self.level and self.inside:
                    self.held.append(piece[at : found.start()])
                    yield from self._part()
                    self.inside, at = False, found.end()
                self.depth = max(0, self.depth - 1)
            elif self.depth == self.level and self.inside:
                self.held.append(piece[at : found.start()])
                yield from self._part(True)
                at = found.end()
            elif self.depth == self.level - 1:
                self.shallow, at = [], found.end()
        (self.held if self.inside else self.shallow).append(piece[at:])

    def _part(self, more: bool = False) -> Iterator[tuple[str, int, int, str]]:
        text, whole = "".join(self.held), self.whole
        self.held, self.whole = [], True
        if whole and not text.strip() and not more:
            return  # an empty list, or a comma behind the last element
        self.n += 1
        yield ("element" if whole else "head"), self.n, self.container, text

    def rest(self) -> Iterator[tuple[str, int, int, str]]:
        if self.inside:
            yield ("tail" if self.whole else "through"), self.n + 1, self.container, "".join(self.held)


def elements(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(path, pos, item): the elements, as JSON text in the file's order, of each file's list: the file itself, the first of ``keys`` that holds one, or the first list of the object. A file that breaks off has none."""
    pieces = _pieces(spark, path)  # both passes read the same blocks
    starts = _starts(_effects(pieces).collect())  # a row a block, and a block is as large as Spark reads at once

    def run(batches):
        for name, block, _, group in _by_block(batches):
            splitter = _Splitter(*starts[name, block])
            out: list[tuple] = []
            for piece in group:
                out += [(name, block, *part) for part in splitter.feed(piece)] if splitter.level else []
                if len(out) > 10_000:
                    yield _frame(out)
                    out = []
            yield _frame([*out, *[(name, block, *part) for part in splitter.rest()]])

    def _frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["path", "block", "kind", "idx", "container", "text"])

    parts = pieces.mapInArrow(run, _PARTS)
    # Elements that edges cut: a tail, what goes through, and a head. A few rows a block.
    order = Window.partitionBy("path").orderBy("block", "idx")
    edges = parts.where("kind IN ('tail', 'through', 'head')").withColumn("n", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    joined = edges.groupBy("path", "n").agg(F.min(F.struct("block", "idx", "container")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "idx", "text"))), lambda s: s["text"]), "").alias("text"))
    whole = parts.where("kind = 'element'").select("path", "block", "idx", "container", "text").unionByName(joined.where("n > 0").select("path", "at.block", "at.idx", "at.container", "text"))
    # Containers, and which of them each block begins in.
    opened = parts.where("kind = 'open'").select("path", "block", "container", F.substring("text", 1, 1).alias("bracket"), F.expr("substring(text, 2)").alias("key"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = spark.createDataFrame([(p, b) for p, b in starts], "path string, block long")
    last = blocks.join(opened.groupBy("path", "block").agg(F.max("container").alias("most")), ["path", "block"], "left")
    before = last.select("path", "block", F.last(F.when(F.col("most").isNotNull(), F.struct("block", F.col("most").alias("container"))), True).over(ahead).alias("held"))
    placed = whole.join(before, ["path", "block"]).select("path", "block", "idx", "text", F.when(F.col("container") > 0, F.struct("block", "container")).otherwise(F.col("held")).alias("of"))
    rank = F.coalesce(*[F.when(F.col("key") == k, i) for i, k in enumerate(keys)], F.lit(len(keys)))
    used = opened.where("bracket = '['").groupBy("path").agg(F.min(F.struct(rank.alias("rank"), "block", "container")).alias("best")).select("path", F.struct("best.block", "best.container").alias("of"))
    kept = placed.join(used, ["path", "of"], "left_semi")
    counted = kept.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    base = counted.select("path", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    numbered = kept.join(base, ["path", "block"])
    return numbered.select("path", (F.col("base") + F.col("idx") - F.col("first")).alias("pos"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("item"))
