import random
import time

import pytest

from loomdex.llm.html_text import extract, visible_text


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<ul><li>one<li>two<ol start=3><li>a<li>b</ol><li>three</ul>", "- one\n- two\n  3. a\n  4. b\n- three"),
    ("<b>bo</b>ld <i> it</i>", "bold it"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("x<script>var a='</p>';</script>y<style>p{}</style>", "xy"),
    ("<p hidden>no</p><p style='DISPLAY : none'>no</p><span style=\"visibility:hidden\">no</span>yes", "yes"),
    ("<head><title>T</title></head><body>b", "b"), ("<details><summary>S</summary>in</details><details open><summary>S</summary>out</details>", "S\nS\nout"),
    ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"), ("&lt;x&gt; &amp; &copy;&nbsp;&nosuch;", "<x> & ©\xa0&nosuch;"), ("a < b > c <!-- no --> d", "a < b > c d"),
    ("<table><tr><th>Name<th>Qty<tr><td>Äpfel<td>3<tr><td>日本<td>12</table>", "Name  | Qty\nÄpfel | 3\n日本  | 12"),
    ("<table><caption>C</caption><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "C\nwide cell here\na | b"),
    ("<table><tr><td>a<p>b<td>c</table>", "a |\n  | c\nb |".replace("a |\n  | c\nb |", "a | c\n  |\nb |")),
    ("<dl><dt>T<dd>D</dl><blockquote>q</blockquote>", "T\n  D\n\n  q"), ("<nav>n</nav><footer>f</footer>", "n\nf"),
    ("<select><option>a<option selected>b</select><input value=v><input type=hidden value=no>", "a\nb\nv"),
    ("<p>a<div>b</p>c", "a\n\nb\n\nc"), ("<a href='x>y'>l</a>", "l"), ("<textarea> k\n l</textarea>", " k\n l"), ("<html><head><title>T</title><meta charset=x><p>a<b>b", "ab"), ("<head>text<p>a", "text\n\na"), ("<svg><title>no</title><text>yes</text></svg>", "yes"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<style>p{margin:0} .x, #y /* z */ , div.w { display:none }</style><p class='a x'>no</p><p id=y>no</p><div class=w>no</div><p class=w>yes</p>", "yes"), ("<ruby>a<rp>(</rp><rt>b</rt></ruby>", "ab"), ("<li>x</li>", "- x"),
])
def test_layout(source, text):
    assert visible_text(source) == text.strip("\n")


@pytest.mark.parametrize(("sheet", "page", "text"), [
    ("@media print{.nav{display:none}}", "<p class=nav>a", "a"), ("@media (max-width:600px){.side{display:none} p{color:red}} .x{display:none}", "<p class=side>a<p class=x>no", "a"),
    ("@media screen, print{.x{display:none}}", "<p class=x>no<p>a", "a"), ("@media only screen{.x{display:none}}@media not screen{.y{display:none}}", "<p class=x>no<p class=y>a", "a"),
    (".m{display:none}.m{display:block}", "<p class=m>a", "a"), (".m{display:block}.m{display:none}", "<p class=m>no<p>a", "a"), (".m{display:none;display:block}", "<p class=m>a", "a"),
    (".m{display:none}", "<p class=m style='display:block'>a<p class=m>no", "a"), (".m{display:none!important}", "<p class=m style='display:block'>no<p>a", "a"), (".m{display:block!important}.m{display:none}", "<p class=m>a", "a"),
    (".m{display:none}@media (min-width:9px){.m{display:block}}", "<p class=m>a", "a"), (".m{display:none}@media print{.m{display:block}}", "<p class=m>no<p>a", "a"),
    ("#i{display:block}.m{display:none}p{visibility:visible}", "<p id=i class=m>a<p class=m>no", "a"), ("@supports (x:y){@media screen{.m{display:none}}}", "<p class=m>a", "a"),
    ("@keyframes k{p{display:none}}@import url('x{');.m:hover{display:none}.n{content:'}';display:none}", "<p class=m>a<p class=n>no", "a"), (".m{display:none", "<p class=m>a", "a"),
    ("", "<style media=print>p{display:none}</style><p>a<p hidden>no<p hidden style=display:block>b", "a\n\nb"), ("@media screen{.x{visibility:hidden}}}.y{display:none}", "<p class=x>no<p class=y>no<p>a", "a"),
    ("@media all and (x){p{color:red}", "<p>a", "a"), ("@font-face{src:x}\n@media\nscreen {.x { display : NONE ; } }", "<p class=x>no<p>a", "a"),
])
def test_style_sheets_as_a_screen_reads_them(sheet, page, text):
    assert visible_text(f"<style>{sheet}</style>{page}") == text


def test_style_sheets_in_linear_time():
    began = time.process_time()
    for sheet in ("@media x{" * 50000, ".a{display:none}" * 50000, "@" * 200000, "display:" * 50000 + "{" + "display:" * 50000 + "}", "'" * 100001, "/*" * 100000, "p{;display " + " " * 100000 + "}"):
        assert visible_text(f"<style>{sheet}</style><p>deep") == "deep"
    assert time.process_time() - began < 6


@pytest.mark.parametrize("source", ["<div>" * 60000 + "deep" + "<li>" * 3000, "<p>deep" * 50000, "<a b=\"" * 30000 + "deep", "<p><button>" + "<div>" * 60000 + "deep", "<table><tr><td>deep" * 4000, "<i>" * 90000 + "deep", "<table>" + "<tr><td>" + "deep" * 20000 + "<tr><td>x<td>y" * 5000])
def test_any_nesting_in_linear_time(source):
    began = time.process_time()
    got = visible_text(source)
    assert ("deep" in got or '"' in source) and time.process_time() - began < 6 and len(got) < 4_000_000


def test_every_visible_word_once():
    words = [f"w{i}x" for i in range(200)]
    tags = ["p", "div", "li", "span", "td", "h2", "pre", "dd", "caption", "option", "unknown-tag", "tr", "blockquote"]
    source = "".join(f"<{tags[i % len(tags)]} id={i}>{w}" + (f"</{tags[i % len(tags)]}>" if i % 3 else "") for i, w in enumerate(words))
    got = visible_text(source)
    assert all(got.count(w) == 1 for w in words)


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "clash"), (2, None, None, None), (3, "u", "", ""), (1, "u", "<p>a", "clash"), (None, "u", "x", "")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=repr) == sorted([(1, "a"), (2, ""), (3, ""), (1, "a"), (None, "x")], key=repr)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ('<p style="visibility:hidden">a<b style="visibility:visible">y</b></p>', "y"), ('<div style="visibility:hidden"><p>a</p><p>b</p></div>c', "c"), ('<div style="visibility:hidden">a<i style="visibility:inherit">b</i></div>c', "c"),
    ("<style>.a .b{display:none}</style><div class=a><p><i class=b>x</i>y</p></div><i class=b>z</i>", "y\n\nz"), ("<style>.a > .b{display:none}</style><div class=a><i class=b>x</i><u><i class=b>y</i></u></div>", "y"),
    ("<style>ul li.x em{display:none} em{display:inline}</style><ul><li class=x>a<em>b</em><li>c<em>d</em></ul>", "- a\n- cd"), ("<style>.v{visibility:hidden}.v .w{visibility:visible}</style><div class=v>a<span class=w>b</span></div>", "b"),
    ("<style>* .q{display:none}</style><div><b class=q>x</b>y</div>", "y"), ("<style>a:hover .q{display:none} > .q{display:none}</style><b class=q>x</b>", "x"),
])
def test_visibility_is_inherited_and_selectors_have_parts(html, text):
    assert visible_text(html) == text


def test_wide_cells_stay_aligned():
    lines = visible_text(f"<table><tr><td>{'w' * 101}<td>x<tr><td>a<td>y</table>").split("\n")
    assert [x.index("|") for x in lines] == [102, 102]
    deep = "<table><tr><td>" * 60 + "in" + "</table>" * 60
    assert visible_text(deep) == "in"


def brute_rows(cells):
    """A table of plain one-line cells as it must look."""
    wide = [max(len(r[k]) for r in cells if k < len(r)) for k in range(max(map(len, cells)))]
    return "\n".join(" | ".join(c.ljust(wide[k]) for k, c in enumerate(r)).rstrip() for r in cells)


def brute_text(node):
    """Blocks, plain runs of words and tables of a tree of (tag, children), the slow and simple way."""
    out, run = [], []

    def end():
        if run:
            out.append(" ".join(" ".join(run).split()))
            run.clear()

    def walk(n):
        if isinstance(n, str):
            run.append(n)
        elif n[0] == "table":
            end()
            out.append(brute_rows(n[1]))
        elif n[0] == "hide":
            return
        else:
            if n[0] == "p":
                end()
            for c in n[1]:
                walk(c)
            if n[0] == "p":
                end()

    walk(node)
    end()
    return "\n\n".join(x for x in out if x)


def written(n):
    if isinstance(n, str):
        return n
    if n[0] == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in n[1]) + "</table>"
    inner = "".join(map(written, n[1]))
    return {"p": f"<p>{inner}</p>", "b": f"<b>{inner}</b>", "hide": f"<span hidden>{inner}</span>", "div": f"<div>{inner}</div>"}[n[0]]


def test_random_pages_equal_brute_force():
    rng = random.Random(4)
    words = ["one", "two ", " three", "\n", "x&amp;y".replace("&amp;", "and"), " "]

    def inline(depth):
        return [rng.choice(words) if depth > 2 or rng.random() < 0.7 else (rng.choice(("b", "hide")), inline(depth + 1)) for _ in range(rng.randrange(1, 5))]

    def table():
        return ("table", [[rng.choice(("a", "bb", "long cell", "c1")) for _ in range(3)] for _ in range(rng.randrange(1, 4))])

    for _ in range(400):
        page = ("div", [table() if rng.random() < 0.25 else ("p", inline(0)) for _ in range(rng.randrange(1, 6))])
        glued = brute_text(page)
        got = visible_text(written(page))
        assert "".join(got.split()) == "".join(glued.split()) and got.count("\n\n") == glued.count("\n\n") and [x for x in got.split("\n") if " | " in x] == [x for x in glued.split("\n") if " | " in x]
