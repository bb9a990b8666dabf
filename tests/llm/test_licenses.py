import re

import pytest

from offerlens.llm import licenses
from offerlens.llm.queries import op10_license_scan


def brute(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "under the MIT License", "Under_the-mit...LICENSE! under the mit license", "xunder the mit license", "éunder the mit license", "Apache License, Version 2.0", "Apache License, Version 2", "cc-by-nc cc by nc 4.0", "CC BY NCé", "a " * 50_000 + "cc by nc", "under the mit licenses", "under the apache license version 2 under the mit license cc by nc", "ÀB under\x7fthe\x00mit license", "日本 under the mit license"]


def test_base_against_brute_force(docs_of):
    rows = licenses.scan(docs_of(list(enumerate(TEXTS)))).collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.scan(docs_of([])).collect() == []
    assert len(licenses.scan(docs_of([(None, "cc by nc"), (1, "x"), (1, "x")])).collect()) == 3


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_license_scan(spark, sf).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", (["mit"], True)),
        ("MIT OR GPL-2.0-only", (["gpl-2.0-only", "mit"], True)),
        ("MIT AND GPL-2.0-only", (["gpl-2.0-only", "mit"], False)),
        ("GPL-2.0 WITH Classpath-exception-2.0", (["gpl-2.0"], False)),
        ("GPL-2.0 OR MIT AND Apache-2.0", (["apache-2.0", "gpl-2.0", "mit"], True)),
        ("(GPL-2.0 OR MIT) AND Apache-2.0", (["apache-2.0", "gpl-2.0", "mit"], True)),
        ("(MIT OR GPL-2.0) AND GPL-3.0+", (["gpl-2.0", "gpl-3.0+", "mit"], False)),
        ("((MIT))", (["mit"], True)),
        ("MIT OR", (["mit"], True)),
        ("(MIT OR GPL-2.0", None),
        (") MIT", None),
        ("", None),
        ("AND MIT", None),
    ],
)
def test_expressions(text, want):
    assert licenses.evaluate(text) == want


def test_precedence_in_postfix():
    assert licenses.to_postfix(licenses.read_expression("a or b and c with d or e")) == ["a", "b", "c", "d", "with", "and", "or", "e", "or"]


def test_tags_and_notices(docs_of):
    rows = {r["doc_id"]: r for r in licenses.scan(docs_of([(1, "// SPDX-License-Identifier: Apache-2.0 OR MIT\nx"), (2, "GNU General Public License, version 3"), (3, "SPDX License Identifier is a tag"), (4, "SPDX-License-Identifier: (")])).collect()}
    assert rows[1]["labels"] == "apache-2.0,mit" and rows[1]["allowed"] and rows[1]["score"] == 1.0 and rows[1]["expressions"] == ["apache-2.0 or mit"]
    assert rows[2]["labels"] == "gpl,gpl-3.0" and rows[2]["base_labels"] == "" and {s["first"] for s in rows[2]["spans"]} == {0}
    assert rows[4]["expressions"] == [] and rows[4]["labels"] == ""


def test_every_tag_is_evaluated():
    table = tuple((p, x, True) for p, x in licenses.BASE_PHRASES.items())
    found = licenses.scan_text(b"SPDX-License-Identifier: MIT ... SPDX-License-Identifier: GPL-3.0 OR Apache-2.0; License Expression (GPL-2.0)", table)
    assert found["expressions"] == ["mit", "gpl-3.0 or apache-2.0", "( gpl-2.0 )"]
    assert found["labels"] == "apache-2.0,gpl-2.0,gpl-3.0,mit" and found["allowed"] is False
    for text in ("é SPDX  License  Identifier: MIT", "spdx-license-\nidentifier MIT", "# SPDX-License-Identifier:\n#   MIT\nGPL-2.0", "license_expression =\r\n MIT"):
        found = licenses.scan_text(text.encode(), table)
        assert (found["expressions"], found["allowed"]) == (["mit"], True), text
    assert licenses.scan_text(b"SPDX-License-Identifier:\n\nMIT, SPDX-License-Identifier", table)["expressions"] == []
    many = licenses.scan_text(b"SPDX-License-Identifier: MIT; " * 20_000, table)
    assert many["expressions"] == ["mit"] * 20_000
