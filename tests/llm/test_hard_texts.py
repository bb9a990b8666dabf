"""Texts of some megabytes without structure, and markup that is deep or broken: right results in bounded time and memory."""

import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from offerlens.llm import common, html_text, langid, licenses, packing, quality, simhash
from offerlens.llm.queries import tokenizer_path

SIZE = 5_000_000
NOTICES = tuple([(p, x, True) for p, x in licenses.BASE_PHRASES.items()] + [(p, x, False) for p, x in licenses.NOTICE_PHRASES.items()])


@pytest.fixture(scope="module")
def encode():
    return packing.TextEncoder(tokenizer_path())


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_tokens_of_runs(encode):
    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    parts = [" " * 700, "\n" * 900, "\t \n" * 400, " ", "  ", "\n", "word", "é", "日本", "\xa0" * 600, "\x1c", "'s", "12", "!?", "a" * 2000, "<|endoftext|>"]
    texts = [" " * 100_000, "\n" * 100_000, "x" + " " * 50_000 + "y", "\r\n" * 30_000 + "z"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for text in texts:
        assert ids(encode(text)) == whole.encode(text, add_special_tokens=False).ids
        assert ids(b"".join(map(encode._block, packing._blocks(text, 50)))) == ids(encode(text))
    for text in (" " * SIZE, "\n" * SIZE, "word " * (SIZE // 5), " \n" * (SIZE // 2)):
        assert len(ids(encode(text))) > 0


def test_packing_of_a_run(spark, docs_of):
    rows = packing.pack(docs_of([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "short")]), tokenizer_path()).collect()
    lengths = {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in (1, 2, 3)}
    whole = Tokenizer.from_file(tokenizer_path())
    assert lengths[2] == len(whole.encode("\n" * 1_000_000, add_special_tokens=False).ids) + 1 and all(r["length"] <= 1024 for r in rows)


def test_quality_of_one_word_and_a_period():
    for text, period, n in (("a " * 1_000_000, 1, 1_000_000), ("one two three four five six seven " * 100_000, 7, 700_000)):
        tracemalloc.start()
        row = quality.analyse_batch([text.encode()], quality.Limits())[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (row["n_words"], row["n_repeat_words"], row["covered_words"], row["longest_repeat"], row["kept"]) == (n, n, n, n - period, False)
        assert peak < 200 * n  # bytes a word, whatever repeats
    blank = quality.analyse_batch([b" " * SIZE, b"\n" * SIZE], quality.Limits())
    assert [(r["n_words"], r["n_dup_lines"], r["base_failed"]) for r in blank] == [(0, 0, True)] * 2


def test_licences_of_one_phrase():
    n = SIZE // 9
    got = licenses.scan_text(b"cc by nc " * n, NOTICES)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (3 * n, n, 0, 3 * (n - 1), "cc-by-nc")
    assert got["spans"][1][:3] == [0, 3, 6]
    assert licenses.scan_text(b" " * SIZE, NOTICES)["n_words"] == 0
    many = licenses.scan_text(b"SPDX : License Identifier MIT " * 100_000, NOTICES)
    assert many["labels"] == "mit" and len(many["expressions"]) == 100_000
    wide = licenses.scan_text(b"SPDX-License-Identifier: " + b" OR ".join(b"x%d" % i for i in range(200_000)), NOTICES)
    assert wide["labels"].count(",") == 199_999


def test_language_of_long_texts():
    model = langid.Model(["a", "b"])
    names, scores = model.predict([" " * SIZE, "word " * (SIZE // 20), None, "1" * SIZE])
    assert names[0] == names[2] == names[3] == "und" and names[1] in "ab" and 0.5 <= scores[1] <= 1


def test_shingles_over_blocks():
    rng = random.Random(4)
    words = [str(rng.randint(0, 99)) for _ in range(900_000)]
    data = " ".join(words).encode()
    assert len(data) > 2 << 20
    for k in (3, 5):
        got = simhash.shingle_hashes(data, k)
        want = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in (0, 1, 350_000, len(words) - k)]
        assert len(got) == len(words) - k + 1 and [int(got[i]) for i in (0, 1, 350_000, -1)] == want
    assert [len(b) for b in common.word_blocks(b"a b c d", 3)] == [2, 2] and list(common.word_blocks(b"")) == []


@pytest.mark.parametrize("page", ["<div>" * 5000 + "deep", "<p>x " * 100_000 + "deep", "<" * SIZE + " deep", "deep" + '<p a="' * 500_000, "deep" + "<!--" * 500_000, "<b>" * 200_000 + "deep", "<table>" + "<tr><td colspan=1000 rowspan=99999>x" * 300 + "<tr><td>deep", " " * SIZE + "deep", "<ul><li>" * 3000 + "deep"])
def test_pages(page):
    assert "deep" in html_text.render(page)


def _styled(n):
    return "<style>" + "".join(f".a{i} .b{{display:none}}" for i in range(n)) + "</style>" + "<p class=b>x" * n


GROWING = {  # pages of n parts, and how many characters of text a part may give
    "rules": (_styled, 10), "nav": (lambda n: "<style>nav div{display:block}</style><nav>" + "<div>" * n + "x" * n, 10), "child": (lambda n: "<style>div>div>div{display:block}</style>" + "<div>" * n + "x", 10),
    "svg": (lambda n: "<svg>" + "<g>" * n + "<text>" + "x" * n, 10), "lists": (lambda n: "<ul><li>x" * n, 80), "marks": (lambda n: "<ol><li>" * n + "x", 10),
    "long cell": (lambda n: "<table><tr><td>" + "y" * 20 * n + "<td>b" + "<tr><td>a<td>b" * n, 200), "stairs": (lambda n: "<table>" + "".join(f"<tr><td rowspan={n - i}>x<td colspan=1000>y" for i in range(n)), 40), "nested tables": (lambda n: "<table><tr><td>xxxxxx<td>" * min(n, 400), 200),
}


@pytest.mark.parametrize("name", sorted(GROWING))
def test_pages_grow_in_proportion(name):
    """Eight times the page takes less than 25 times the time (64 where it is quadratic), and gives text in proportion."""
    import time

    page, most = GROWING[name]
    html_text.render(page(500))
    took = []
    for n in (2_000, 16_000):
        start = time.process_time()
        assert len(html_text.render(page(n))) <= most * n
        took.append(time.process_time() - start)
    assert took[1] < 25 * took[0] + 0.5


def test_a_styled_page_of_megabytes():
    page = _styled(120_000)
    assert len(page) > 4_000_000 and html_text.render(page).count("x") == 120_000


def test_batches_are_cut_by_bytes(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["x" * 40, None, "y" * 90, "", "z" * 20])], names=["i", "t"])
    assert [b.column(0).to_pylist() for b in common.sliced([batch, batch.slice(0, 0)], 1, 100)] == [[1, 2], [3, 4], [5]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    html_text.extract(spark.createDataFrame([(1, "<p>a")], "page_id long, html string")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == before


def test_lines_of_megabytes_and_identical_rows(spark, docs_of):
    """Op 9: millions of line breaks, one line of megabytes, and very many rows that share id and lines."""
    from offerlens.llm import linededup

    from test_linededup import brute, run

    foot = "a footer of more than forty characters, the same in each"
    rows = [(1, "\n" * SIZE), (2, "x" * SIZE), (3, "x" * SIZE + "\n" + foot), (4, ("x" * 60 + "\n") * (SIZE // 61))]
    assert run(docs_of(rows)) == brute(rows)
    same = [(None, f"{foot}\nmore")] * 20_000 + [(i, foot) for i in range(6)]
    assert run(docs_of(same)) == brute(same)
    assert linededup.postings(docs_of([(1, "é" * 40 + "\n" + "é" * 39 + "\n  " + "y" * 39)])).count() == 1


def test_pages_and_sizes_of_megabytes(spark, docs_of):
    """Ops 3 and 7."""
    from offerlens.llm import mixing, warc

    pages = spark.createDataFrame([(1, "u", "<p>" + "x" * SIZE), (2, "u", "<p>" + "x" * SIZE), (3, None, "\n" * SIZE)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (SIZE + 3, "revisit", 2), 2: (SIZE + 3, "response", None), 3: (SIZE, "response", None)}
    docs = docs_of([(1, "word " * (SIZE // 5)), (2, " " * SIZE), (3, "one", "en", "t")])
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes == {1: SIZE // 5, 2: 0, 3: 1}
