"""The stages one after the other against a brute-force version that shares no code with them."""

import math
import random
import re

import corpus_pipeline
from test_mixing import brute as brute_mix
from test_quality import brute as brute_quality


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    shared = "A shared footer line of more than forty characters"
    rows = []
    for i in range(40):
        base = [word() for _ in range(rng.randint(40, 200))]
        body = " ".join(base)
        rows.append((i, body + ("\n" + shared if i < 8 else ""), "en", f"s{i % 3}"))
        if i % 5 == 0:
            near = list(base)
            near[len(near) // 2] = word()
            rows += [(100 + i, body, "en", "copy"), (200 + i, " ".join(near), "en", "copy")]
    rows += [(900, "too short", "en", "s0"), (901, "again and again we say this " * 20, "en", "s1"), (902, None, "en", None), (903, "", "en", None)]
    return rows


def shingles(text):
    words = text.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))}))
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def key(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def brute(rows):
    rows = [r for r in rows if brute_quality(r[1])[-1]]
    held = {}
    for r in rows:
        for k in {key(x) for x in r[1].split("\n")}:
            held.setdefault(k, []).append(r[0])
    gone = lambda d, line: len(key(line)) >= 40 and len(held[key(line)]) >= 5 and max(held[key(line)]) != d
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if not gone(r[0], x)), *r[2:]) for r in rows]
    sets = {r[0]: shingles(r[1]) for r in rows}
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    label = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if label[b] < label[a] and near(a, b):
                    label[a], changed = label[b], True
    rows = [r for r in rows if label[r[0]] == r[0]]
    taken = brute_mix(rows)
    out = []
    for r in rows:
        size, _, _, words = taken[r[0]]
        out += [r] * (words // size if size else 0)
    return out


def test_stages_against_brute_force(spark, docs_of, tmp_path):
    rows = texts()
    docs = docs_of(rows)
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, "unused")
        if i < 4:
            assert docs.columns == names, name
            docs.write.parquet(str(tmp_path / str(i)))
            docs = spark.read.parquet(str(tmp_path / str(i)))
    want = brute(rows)
    mixed = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in before.collect())
    assert mixed == sorted((r[0], r[1], len(r[1])) for r in want)
    packed = docs.collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(r[0] for r in want)
    fill = {}
    for r in packed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 1024 for v in fill.values())
    assert len(fill) <= math.ceil(sum(r["length"] for r in packed) / 1024) * 1.15 + 1


def test_run_and_empty_documents(spark, sf, docs_of):
    assert corpus_pipeline.run(spark, sf).count() > 0
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "unused").count() == 0


def test_columns_with_any_names_come_through(spark, docs_of):
    """Names that operators use themselves keep their values through all filtering stages."""
    from pyspark.sql import functions as F

    docs = docs_of([r for r in texts() if r[0] < 20 or r[0] >= 100])
    own = ("_row", "_row0", "_drop", "_doc", "n_lines", "n_dropped", "_least", "kept", "node", "component", "digest", "_salt", "base_failed", "taken", "a b")
    for c in own:
        docs = docs.drop(c).withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "unused")
        assert docs.columns == names
        assert all(r[c] == f"{c}{r['doc_id']}" for r in docs.collect() for c in own)
