"""Operator 5: language identification with a byte convolutional network.

Filters of several widths run over bytes, the largest response of each over a
window is kept, and a softmax layer turns these into languages; all of it is
numpy. A filter over one-hot bytes is a table of byte responses for each of its
places, so inference adds table rows (two bytes at once) and training touches
only the bytes under each maximum. A text is cut into fixed-length windows that
overlap by the widest filter less one, every window is scored, and a text's
score is the softmax of its windows' mean log-probability by length.

Training: at most ``per_language`` documents of each language and ``MOST_ROWS`` of all
(fewer of each where there are many languages), in the order of a hash of a row and its place in the input,
and at most ``windows_each`` windows from anywhere in them reach the driver; that bounds
the sample, whatever the corpus. Statistics and predictions cover everything.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any labelled row every text is; rows that share a doc_id are learned from
and predicted one by one; null doc_id is not held out; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
PER_LANGUAGE = 400
WINDOWS_EACH = 4
#: Labelled documents of all languages that are learned from at most.
MOST_ROWS = 100_000
_STRIDE = WINDOW - max(WIDTHS) + 1
_WORDLIKE = re.compile(r"[^\W\d_]")
#: ASCII other than letters counts as a space; A-Z as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """A letter of any script; figures such as ² or ½ are none."""
    return any(found[0].isalpha() for found in _WORDLIKE.finditer(text))


def fold(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.encode().translate(_FOLD) + b" ", dtype=np.uint8)


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last filled up with spaces, and how many bytes of each are the text's."""
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // _STRIDE))
    whole = np.full((n - 1) * _STRIDE + WINDOW, 32, dtype=np.uint8)
    whole[: len(data)] = data[: len(whole)]
    cut = np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::_STRIDE]
    return cut, np.minimum(WINDOW, np.maximum(1, len(data) - _STRIDE * np.arange(n)))


class Model:
    """tables[w][place, byte, filter], bias[w], and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {f"t{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS}
        self.weights |= {f"b{w}": np.zeros(FILTERS, "f4") for w in WIDTHS}
        self.weights |= {"out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype("f4"), "bias": np.zeros(len(languages), "f4")}
        self.pairs: dict = {}

    def _response(self, x: np.ndarray, w: int) -> np.ndarray:
        t = self.weights[f"t{w}"]
        places = x.shape[1] - w + 1
        return sum(t[k][x[:, k : k + places]] for k in range(w))

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of windows, by tables of byte pairs."""
        if not self.pairs:
            for w in WIDTHS:
                t = self.weights[f"t{w}"]
                self.pairs[w] = [(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        found = []
        for w in WIDTHS:
            places = x.shape[1] - w + 1
            tables = self.pairs[w]
            r = tables[0].take(pair[:, :places], axis=0)
            for k, table in enumerate(tables[1:], 1):
                r += table.take(pair[:, 2 * k : 2 * k + places], axis=0)
            if w % 2:
                r += self.weights[f"t{w}"][w - 1].take(x[:, w - 1 :], axis=0)
            found.append(np.maximum(r.max(1) + self.weights[f"b{w}"], 0))
        return np.concatenate(found, axis=1) @ self.weights["out"] + self.weights["bias"]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            part = x[rows].copy()
            ends = np.where(rng.random(batch) < 0.5, rng.integers(8, WINDOW, batch), WINDOW)  # short texts occur too
            part[np.arange(WINDOW)[None] >= ends[:, None]] = 32
            peaks, best = [], []
            for w in WIDTHS:
                r = self._response(part, w)
                at = r.argmax(1)
                best.append(at)
                peaks.append(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.weights[f"b{w}"])
            hidden = np.maximum(np.concatenate(peaks, axis=1), 0)
            p = _softmax(hidden @ self.weights["out"] + self.weights["bias"])
            p[np.arange(batch), y[rows]] -= 1
            p /= batch
            grads = {"out": hidden.T @ p, "bias": p.sum(0)}
            back = (p @ self.weights["out"].T) * (hidden > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[f"b{w}"] = g.sum(0)
                grads[f"t{w}"] = np.zeros_like(self.weights[f"t{w}"])
                for k in range(w):
                    byte = np.take_along_axis(part, best[i] + k, 1)
                    np.add.at(grads[f"t{w}"][k], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), g)
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                self.weights[name] = (self.weights[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        self.pairs = {}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut, sizes, owner = [], [], []
        for i, text in enumerate(texts):
            if text and has_letter(text):
                w, n = windows(fold(text))
                cut.append(w)
                sizes.append(n)
                owner.append(np.full(len(w), i))
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if cut and self.languages:
            cut, sizes, owner = np.concatenate(cut), np.concatenate(sizes), np.concatenate(owner)
            logits = np.concatenate([self.logits(cut[a : a + 512]) for a in range(0, len(cut), 512)]).astype("f8")
            logits -= np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1, keepdims=True)) + logits.max(1, keepdims=True)
            total = np.zeros((len(texts), len(self.languages)))
            np.add.at(total, owner, logits * sizes[:, None])
            weight = np.bincount(owner, weights=sizes, minlength=len(texts))
            p = _softmax(total / np.maximum(weight, 1)[:, None])
            for i in np.unique(owner).tolist():
                names[i], scores[i] = self.languages[int(p[i].argmax())], float(p[i].max())
        return names, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


# --- Spark -------------------------------------------------------------------


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH, most_rows: int = MOST_ROWS, seed: int = 0) -> Model:
    """Train on a bounded sample of rows (doc_id, text, lang); rows are chosen one by one, whatever ids they share."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("_hash"))
    counts = common.checkpointed(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    languages = counts.count()
    each = max(1, min(per_language, most_rows // max(1, languages)))
    counts = F.broadcast(counts) if languages <= most_rows else counts  # else both sides are shuffled
    # a share of each language by hash leaves some times ``each`` rows of it, whatever its size; the smallest hashes of these are taken
    share = F.least(F.lit(1.0), 4 * each / F.col("_n"))
    few = rows.join(counts.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).where(F.pmod("_hash", F.lit(1 << 31)) < share * (1 << 31))

    def cut(batches):
        for batch in common.sliced(batches, 2):
            langs, hashes, data = [], [], []
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    w, _ = windows(fold(text))
                    langs.append(lang)
                    hashes.append(h)
                    data.append(w[np.linspace(0, len(w) - 1, min(windows_each, len(w))).astype(int)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(hashes, type=pa.int64()), pa.array(data, type=pa.binary())], names=["lang", "h", "data"])

    pieces = few.select("lang", "_hash", "text").mapInArrow(cut, "lang string, h long, data binary")
    order = Window.partitionBy("lang").orderBy("h", "data")
    sample = pieces.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).orderBy("h", "lang", "data").limit(most_rows)
    got = [(lang, part) for lang, data in sorted((r["lang"], bytes(r["data"])) for r in sample.collect()) for part in np.frombuffer(data, dtype=np.uint8).reshape(-1, WINDOW)]
    languages = sorted({g[0] for g in got})
    model = Model(languages, seed)
    if len(languages) > 1:
        place = {name: i for i, name in enumerate(languages)}
        x = np.stack([g[1] for g in got])
        y = np.array([place[g[0]] for g in got])
        sizes = np.bincount(y)
        even = np.concatenate([np.resize(np.flatnonzero(y == k), sizes.max()) for k in range(len(languages))])  # each language as often
        model.train(x[even], y[even], steps=max(400, 2 * len(languages)), seed=seed)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in common.sliced(batches, 1):
            names, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
