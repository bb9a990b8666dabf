import random

import numpy as np

from offerlens.llm import quality
from offerlens.llm.quality import Limits


def brute(text):
    data = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", data) if w]
    n = len(words)
    seen, lines, dup = set(), data.split("\n"), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    longest = [0] * n  # the longest other occurrence of what starts at each word
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    in_window, in_span = set(), set()
    for i, k in enumerate(longest):
        if k >= 5:
            in_window.update(range(i, i + 5))
        if k >= Limits().repeat_words:
            in_span.update(range(i, i + k))
    failed = n < 10 or 100 * len(in_window) > 20 * n
    top = max(longest, default=0)
    bad = 100 * len(in_span) > 20 * n or top >= 60 and 100 * top > 10 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in data), dup, len(in_window), len(in_span), top, failed, not (failed or bad))


def texts():
    rng = random.Random(3)
    out = [None, "", "\n \n", "one", "a b c d e f g h i j", "é日 " * 12, "x\x0by\x0cz\x1fq", "* | <b> & $ %"]
    for _ in range(60):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))]
        if words and rng.random() < 0.6:
            at = rng.randrange(len(words))
            words[rng.randrange(len(words)) :][:0] = words[at : at + rng.randint(3, 70)]
            words += words[at : at + rng.randint(3, 30)]
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_batch_against_brute_force():
    given = texts()
    rows = quality.analyse_batch([(t or "").encode() for t in given], Limits())
    for t, r in zip(given, rows, strict=True):
        got = tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"))
        assert got == brute(t), repr(t)
        assert sum(s["words"] for s in r["spans"]) == r["covered_words"]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 60):
        x = rng.integers(0, 3, n)
        suffixes, lcp = quality.suffix_lcp(x)
        want = sorted(range(n), key=lambda i: x[i:].tolist())
        assert suffixes.tolist() == want
        for k in range(n - 1):
            a, b = x[want[k] :].tolist(), x[want[k + 1] :].tolist()
            same = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
            assert lcp[k] == same


def test_spark_keeps_clean_documents_and_all_columns(docs_of):
    clean = " ".join(f"word{i}" for i in range(200))
    rows = [(1, clean), (2, "spam spam eggs and ham " * 30), (3, None), (None, clean), (5, clean + "\n" + clean), (6, "x" * 50_000 + " " + clean), (1, clean)]
    df = docs_of(rows)
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 6]
    verdicts = quality.analyse(df).collect()
    assert len(verdicts) == 7 and sum(r["kept"] for r in verdicts) == 4
    assert quality.analyse(docs_of([])).collect() == [] and quality.kept_documents(docs_of([])).collect() == []
