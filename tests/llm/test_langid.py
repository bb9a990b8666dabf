import zlib

import numpy as np

from offerlens.llm import langid
from offerlens.llm.queries import op5_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == truth[r["doc_id"]][0])
    assert np.mean(right) >= 0.97


def test_predictions_use_the_text_alone_and_agree(docs_of):
    rows = [(i, ("der und das ist nicht " if i % 2 else "the and that is not ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(120)]
    swapped = [(r[0] if zlib.crc32(str(r[0]).encode()) % 3 != 1 else r[0], r[1], r[2] if zlib.crc32(str(r[0]).encode()) % 3 != 1 else "xx", "other") for r in rows]
    first = sorted(map(tuple, langid.identify(docs_of(rows)).collect()))
    second = sorted(map(tuple, langid.identify(docs_of(swapped)).collect()))
    assert first == second
    assert np.mean([r[2] == rows[r[0]][2] for r in first]) > 0.95


def test_edges(docs_of):
    rows = [(i, "some words of one language", "en") for i in range(20)] + [(100, None, "en"), (101, "", "en"), (102, "12 34 !! ² ½ _ ①", "en"), (None, "words", None), (104, "日本語", None), (105, "é" * 200_000, "en"), (105, "again", "en")]
    got = {}
    for r in langid.identify(docs_of(rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["held_out"]))
    assert [got[k][0][:2] for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[104][0][0] == "en" and got[None][0][2] is False and len(got[105]) == 2
    assert langid.identify(docs_of([])).collect() == []
    unlabelled = langid.identify(docs_of([(1, "text", None), (2, "more", None)])).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_inference_tables_equal_the_filters():
    model = langid.Model(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    peaks = np.concatenate([np.maximum(model._response(x, w).max(1) + model.weights[f"b{w}"], 0) for w in langid.WIDTHS], axis=1)
    assert np.allclose(model.logits(x), peaks @ model.weights["out"] + model.weights["bias"], atol=1e-4)


def test_windows_cover_every_byte():
    for n in (1, 4, 255, 256, 257, 509, 510, 5000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8)
        cut, sizes = langid.windows(data)
        for w in langid.WIDTHS:
            for at in range(max(0, n - w + 1)):
                assert any(0 <= at - k * langid._STRIDE <= langid.WINDOW - w for k in range(len(cut)))
        assert (sizes >= 1).all() and sizes[0] == min(n, langid.WINDOW)


def naive(model, text):
    """The network byte by byte: cut, one-hot filters, maximum, softmax, mean log-probability by length."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = [32]
    for b in text.encode():
        data.append(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32)
    data.append(32)
    step = langid.WINDOW - max(langid.WIDTHS) + 1
    total, weight, at = np.zeros(len(model.languages)), 0, 0
    while at == 0 or at + max(langid.WIDTHS) - 1 < len(data):
        part = data[at : at + langid.WINDOW]
        own = len(part)
        part += [32] * (langid.WINDOW - own)
        hidden = []
        for w in langid.WIDTHS:
            table, bias = model.weights[f"t{w}"], model.weights[f"b{w}"]
            for f in range(langid.FILTERS):
                best = max(sum(float(table[k, part[i + k], f]) for k in range(w)) for i in range(langid.WINDOW - w + 1))
                hidden.append(max(best + float(bias[f]), 0.0))
        logits = [sum(h * float(model.weights["out"][i, c]) for i, h in enumerate(hidden)) + float(model.weights["bias"][c]) for c in range(len(model.languages))]
        top = max(logits)
        norm = top + np.log(sum(np.exp(x - top) for x in logits))
        total += own * (np.array(logits) - norm)
        weight += own
        at += step
    p = np.exp(total / weight - (total / weight).max())
    p /= p.sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_predictions_against_brute_force(spark, docs_of):
    rows = [(3 * i, ("der und das ist nicht so " if i % 2 else "The cat, and the dog; is not 1 ") * (1 + i % 40), "de" if i % 2 else "en") for i in range(60)]
    model = langid.fit(docs_of(rows))
    texts = [r[1] for r in rows[:12]] + [None, "", "12 ²", "x", "é" * 300, "DER Und\nDAS", "日本語 the " * 120, "a" * 251, "a" * 252, "a" * 253, "a" * 254]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_of(list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        name, score = naive(model, text)
        assert got[i][0] == name and abs(got[i][1] - score) < 1e-4


def test_every_language_and_a_bounded_sample(docs_of, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid.Model, "train", lambda self, x, y, **how: seen.update(x=x, y=y))
    many = [(i, f"text of kind {i % 1100} ", f"l{i % 1100:04}") for i in range(2200)]
    assert len(langid.fit(docs_of(many)).languages) == 1100
    same = docs_of([(7, "one text that all rows share", "en")] * 5000 + [(8, "noch ein Text", "de")])
    langid.fit(same, per_language=50)
    assert len(seen["x"]) == 2 * 50 and set(seen["y"].tolist()) == {0, 1}  # 50 of the 5000 rows, and as many of the other
    langid.fit(docs_of(many), most_rows=300)
    assert len(seen["x"]) == 300
