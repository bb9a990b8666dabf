import pytest

from offerlens.llm import html_text
from offerlens.llm.queries import op4_html_text

CASES = {
    "": "",
    "plain &amp; simple &lt;b&gt;": "plain & simple <b>",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br/>c": "a\nb\nc",
    "<p>in <b>line</b> <i> text </i>  here</p>": "in line text here",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>x<li value=20>y<li>z</ol>": "9. x\n20. y\n21. z",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><tr><th colspan=2>wide head<tr><td>a<td>b</table>": "wide head\na  b",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><caption>cap</caption><tbody><tr><td>x</table>after": "cap\nx\n\nafter",
    "<table><td>no row<td>2</table>": "no row  2",
    "<pre> a\n   b </pre>": " a\n   b",
    "<p>seen<p hidden>not<p style='display: none'>not<p style=visibility:hidden>not": "seen",
    "<style>.x{display:none} #y{visibility:hidden}</style><i class='z x'>a</i><i id=y>b</i>c": "c",
    "<script>var a='<p>no</p>'</script><noscript>no</noscript><template>no</template>yes": "yes",
    "<head><title>no</title></head><body>yes</body>": "yes",
    "<!-- <p>no</p> -->yes<![CDATA[no]]>": "yes",
    "<h1>T</h1>text<h2>U</h2>": "T\n\ntext\n\nU",
    "<select><option>a<option>b</select>": "a\nb",
    "<input value=v><input type=hidden value=w><img alt=pic src=x>": "vpic",
    "<blockquote>q</blockquote>": "  q",
    "a < b and c > d": "a < b and c > d",
    "<p": "",
    "</p></div></table>x": "x",
    "x&nbsp;y": "x y",
    "<nav><ul><li>n</ul></nav><div>d</div>": "- n\n\nd",
    "<a href='>'>q</a>": "q",
    "<textarea> a <b> </textarea>": " a <b>",
    "<details><summary>s</summary>no</details><dialog>no</dialog><dialog open>yes</dialog>": "s\nyes",
    "<details open>t<summary>s</summary>u</details><details>no</details>": "t\ns\nu",
    "<div style='/*c*/display:none'>no</div><div style='x:\"a;display:none\";y:url(b;display:none)'>yes</div>": "yes",
    "<style>.a{content:\"{\"} .b{display:none}</style><p class=b>no<p class=a>yes": "yes",
    "<style>.a{background:url(x;display:none)} .c{content:'}'; display:none}</style><p class=a>yes<p class=c>no": "yes",
    "<style>.a{display:none!important;display:block} .b{display:none;display:block}</style><p class=a>no<p class=b>yes": "yes",
    "<style>.a{display:none block} .b[title='x]y']{display:none}</style><p class=a>yes<p class=b title='x]y'>no": "yes",
    "<style>ul>li>b{display:none} .o i .p{display:none}</style><ul><li><b>no</b><i><b>yes</b></i></ul><div class=o><i><u><s class=p>no</s></u></i><s class=p>yes</s></div>": "- yes\n\nyes",
    "<style>.o .p{display:none}</style><div class=o><div class=o><p class=p>no</div><p class=p>no</div><p class=p>yes": "yes",
    "<style>@media print{.a{display:none}} @media screen{.b{display:none}}</style><p class=a>yes<p class=b>no": "yes",
    "<svg><title>no</title>no<g><text>yes</text></g></svg><math><mi>x</mi></math><svg><math>m</math>no</svg>": "yesxm",
    "<pre>\n\n a\n</pre><textarea>\n b</textarea>": "\n a\n\n b",
}


@pytest.mark.parametrize(("page", "want"), list(CASES.items()))
def test_rendering(page, want):
    assert html_text.render(page) == want


@pytest.mark.parametrize("page", ["<div>" * 5000 + "deep", "<ul><li>" * 3000 + "deep", "<table><tr><td>" * 2000 + "deep", "<b><p>x</b>y", "<p a='", "<table><tr><td colspan=99999999 rowspan=x>deep", "<" * 2000 + " deep"])
def test_broken_markup_never_fails(page):
    text = html_text.render(page)
    assert "deep" in text or "deep" not in page


def test_spark(spark, sf):
    df = spark.createDataFrame([(1, "<p>a", 5), (2, None, 5), (None, "", 5), (1, "<p>a", 5)], "page_id long, html string, text int")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, "a", 1), (1, "a", 1), (2, "", 0), (None, "", 0)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_html_text(spark, sf).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        assert r["text"] == html_text.render(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "<p>" not in r["text"]


VISIBILITY = {
    '<p title="a"b">hello</p><p class="x">world</p>': "hello\n\nworld",
    "<table><tr><td class=x/>a<td>b</table>": "a  b",
    '<div style="visibility:hidden">x<p style="visibility:visible">y</p></div>z': "y\n\nz",
    "<div hidden>x<p style=visibility:visible>y</div>": "",
    "<html hidden>q": "",
    '<body style="display:none">q': "",
    "<style>@media print{.a{display:none}}</style><p class=a>a": "a",
    "<style>@media (max-width:600px){.a{display:none}.b{display:none}} .c{display:none}</style><i class=a>a</i><i class=b>b</i><i class=c>c</i>": "ab",
    "<style>@media screen{.a{display:none}} @layer x{.b{display:none}}</style><i class=a>a</i><i class=b>b</i>c": "c",
    "<style media=print>i{display:none}</style><i>a</i>": "a",
    "<style>.a .b{display:none} div.e{display:none} .f>i{display:none}</style><div class=a><b><i class=b>1</i></b></div><i class=b>2</i><div class=e>3</div><i class=e>4</i><div class=f><i>5</i><b><i>6</i></b></div>": "24\n6",
    "<style>.a{display:none} .a{display:block} #b{visibility:hidden!important}</style><i class=a>a</i><i id=b style='visibility:visible'>b</i>": "a",
    "<style>i:hover{display:none} i+i{display:none}</style><i>a</i><i>b</i>": "ab",
    "<svg><title>no</title><text>drawn</text>no</svg> <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "drawn x=1",
    "<svg><text><![CDATA[a<b]]></text></svg>": "a<b",
    "</>a<!>b<!-->c<!--x--!>d<?php e ?>f": "abcdf",
    "<a name='x'/>text</a>": "text",
    "<ul><li><blockquote>q</blockquote><li><p>a</p><p>b</p></ul>": "-   q\n\n- a\n\n  b",
    "<p a=1 a=2 hidden=hidden>x<p>y": "y",
    "<td>a<table><tr><td>b</table>": "a\n\nb",
}


@pytest.mark.parametrize(("page", "want"), list(VISIBILITY.items()))
def test_visibility(page, want):
    assert html_text.render(page) == want


def test_hidden_below_any_depth():
    for depth in (10, 199, 210, 5000):
        assert html_text.render("<div>" * depth + "<div hidden>SECRET</div>open") == "open"
        assert html_text.render("<div>" * depth + "<table><tr><td>a<td>b<tr><td>cc<td>d</table>") == "a   b\ncc  d"


def test_spans_beyond_old_limits():
    wide = "<table><tr><td colspan=150>x<td>end<tr>" + "".join(f"<td>{i % 10}" for i in range(150)) + "<td>last</table>"
    first, second = html_text.render(wide).split("\n")
    assert first.index("end") == second.index("last")
    tall = "<table><tr><td rowspan=20000>r<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 12_000)) + "</table>"
    lines = html_text.render(tall).split("\n")
    assert lines[0] == "r  0" and lines[11_999] == "   11999"


class _Page:
    """Random pages with the text that they must give, made side by side: the brute-force version."""

    def __init__(self, seed):
        import random

        self.rng = random.Random(seed)

    def words(self):
        return " ".join(self.rng.choice(["alpha", "be", "cé", "d1", "日本", "x"]) for _ in range(self.rng.randint(1, 5)))

    def inline(self):
        w, kind = self.words(), self.rng.randrange(6)
        gap = self.rng.choice([" ", "\n  ", "\t"])
        hidden = self.rng.choice(["<span hidden>no</span>", "<script>no</script>", "<!-- no -->", '<i style="display:none">no</i>', "<i class=gone>no</i>"])
        return [(w.replace(" ", gap), w), (f"<b>{w}</b>", w), (f"<a href='?a>b' title=\"q>\">{w}</a>", w), (w + hidden, w), (f"{w} &amp; {w}", f"{w} & {w}"), (f"<em>{w}</em>{gap}<i>{w}</i>", f"{w} {w}")][kind]

    def block(self, depth=0):
        """(html, lines, whether empty lines surround it)"""
        kind = self.rng.randrange(7 if depth < 3 else 2)
        if kind == 0:
            h, t = self.inline()
            return f"<div>{h}</div>", [t], False
        if kind == 1:
            h, t = self.inline()
            tag = self.rng.choice(["p", "h1", "h3"])
            return f"<{tag}>{h}" + ("" if tag == "p" and self.rng.random() < 0.5 else f"</{tag}>"), [t], True
        if kind == 2:
            rows = [[self.inline() for _ in range(3)] for _ in range(self.rng.randint(1, 4))]
            wide = [max(len(r[c][1]) for r in rows) for c in range(3)]
            close = self.rng.random() < 0.5
            html = "<table>" + "".join("<tr>" + "".join(f"<td>{h}" + "</td>" * close for h, _ in r) + "</tr>" * close for r in rows) + "</table>"
            return html, ["  ".join(t.ljust(n) for (_, t), n in zip(r, wide, strict=True)).rstrip() for r in rows], True
        if kind == 3:
            return "<pre>a  b\n   c</pre>", ["a  b", "   c"], True
        if kind == 4:
            tag = self.rng.choice(["ul", "ol"])
            html, lines = f"<{tag}>", []
            for i in range(self.rng.randint(1, 4)):
                h, t = self.inline()
                mark = "- " if tag == "ul" else f"{i + 1}. "
                html += f"<li>{h}" + self.rng.choice(["", "</li>"])
                lines.append(mark + t)
            return html + f"</{tag}>", lines, True
        parts = [self.block(depth + 1) for _ in range(self.rng.randint(1, 3))]
        html, lines = "".join(p[0] for p in parts), join(parts)
        if kind == 5:
            return f"<section>{html}</section>", lines, "edges" if parts[0][2] or parts[-1][2] else False, parts[0][2], parts[-1][2]
        return f"<blockquote>{html}</blockquote>", [f"  {x}" if x else x for x in lines], True


def join(parts):
    """Lines of blocks one below the other: an empty line where either side asks for one."""
    out, below = [], False
    for p in parts:
        above, after = (p[3], p[4]) if len(p) > 3 else (p[2], p[2])
        if out and (above or below):
            out.append("")
        out += p[1]
        below = after
    return out


@pytest.mark.parametrize("seed", range(150))
def test_against_pages_made_with_their_text(seed):
    page = _Page(seed)
    parts = [page.block() for _ in range(page.rng.randint(1, 6))]
    flat = [(p[0], p[1], p[2], bool(p[3]), bool(p[4])) if len(p) > 3 else p for p in parts]
    html = "<!doctype html><html><head><title>no</title><style>.gone{display:none}</style></head><body>" + "".join(p[0] for p in flat)
    assert html_text.render(html) == "\n".join(join(flat))
