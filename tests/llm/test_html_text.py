from __future__ import annotations

import itertools
import random
import time

from html.parser import HTMLParser

from pyspark.sql import functions as F

from tallyguard.llm.html_text import extract_text, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body><div id="cookie-notice"><p>We use cookies. Accept them all, please.</p></div>
<header><div class="logo">The site</div><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav></header>
<div class="wrap"><div class="post"><h2>Head &amp; line</h2><p>First  para with a <a href=x>link</a>&nbsp;in it.
More of it.</p><!-- <p>gone</p> --><ul><li>point one is here.</li><li>point &#50;.</ul>
<div class="share-buttons"><a>Tweet</a></div><p>Second <b>bold</b> one.</p><p hidden>secret</p></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a>One</a><li><a>Two</a></ul></div>
<div id="comments"><h3>Comments</h3><p>Great article, thanks for writing it. I liked it.</p></div>
<form><label>Mail</label><input><button>Go</button></form></div><footer><p>&copy; us</p></footer></body></html>"""


def test_parts_of_a_page():
    assert main_text(PAGE).split("\n") == [
        "Head & line",
        "First para with a link in it. More of it.",
        "point one is here.",
        "point 2.",
        "Second bold one.",
    ]


def test_page_without_any_hint():
    page = (
        "<div><a href=/>Home</a> | <a href=/x>About</a></div><div><p>This is a paragraph that has a sentence."
        " And another one, which goes on for longer.</p><p>More text. Yes it is.</p></div><div>Copyright 2020</div>"
    )
    assert main_text(page).split("\n")[0].startswith("This is a paragraph")
    assert "Home" not in main_text(page) and "Copyright" not in main_text(page)


def test_broken_pages():
    pages = ["<", "<p", "a<b", "<script>x", "<p>a<p>b", "<div hidden>x<div>y</div></div>z", "<a" * 5000, "<div>" * 3000 + "x",
             "<a title='x>y' class=\"q\">t</a>", "<![CDATA[x]]>", "</p></div>", "&#x110000; &bogus;", "<p" + " a='" * 500]
    for page in pages:
        assert isinstance(main_text(page), str)


SAID = "This sentence belongs to the article, and it is long enough. So does this one."


def test_nothing_is_lost_after_special_elements():
    before, after = "<article><p>" + SAID + " One.</p>", "<p>" + SAID + " Two.</p></article>"
    for between in (
        '<svg class="i"/>',
        '<svg class="i"><svg/><g/></svg>',
        "<p hidden>secret",
        '<ul><li style="display:none">secret<li>item of the list.</ul>',
        '<div hidden>secret<div>secret</div>secret</div>',
        "<div><span hidden>secret</div>",
        "<span hidden>secret<span>secret</span>secret</span>",
        "<SCRIPT>secret</p>secret</Script >",
        "<button>",
        "<select><option>secret<option>secret</select>",
        "<dl><dt hidden>secret<dd>said of it.</dl>",
        "<video controls>",
        "<table><tr hidden><td>secret<tr><td>cell</table>",
    ):
        text = main_text(before + between + after)
        assert text.startswith(SAID + " One.") and text.endswith(SAID + " Two."), between
        assert "secret" not in text, between


def test_letters_that_change_their_length():
    # lower-casing this letter makes two characters of one
    page = "<title>" + "\u0130" * 60 + "</title><script>x</script><article><p>" + SAID + "</p><p>" + SAID + "</p></article>"
    assert main_text(page) == SAID + "\n" + SAID
    # and this one folds to an s, but makes no name of an element
    assert main_text("<article><script>x</\u017fcript>secret</script>" + SAID + "</article>") == SAID


def test_hidden_roots_are_read():
    assert main_text('<html><body style="visibility:hidden"><article><p>' + SAID + "</p></article></body></html>") == SAID


def test_long_pages():
    piece = "<article><p>" + SAID + "</p></article><nav><a>Home</a></nav>"
    started = time.perf_counter()
    assert main_text(piece * 4000) == "\n".join([SAID] * 4000)
    assert time.perf_counter() - started < 5
    rnd = random.Random(2)
    scores = [rnd.choice([-1, 1]) * rnd.random() * 3 for _ in range(4000)]
    edges = [(i, j, 0.1 + rnd.random() / 2) for i in range(4000) for j in range(i + 1, min(4000, i + 6))]
    started = time.perf_counter()
    minimum_cut(scores, edges)
    assert time.perf_counter() - started < 5


def test_cut_is_the_cheapest_labelling():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 7)
        scores = [float(rnd.randint(-9, 9)) for _ in range(n)]
        edges = [(i, j, float(rnd.randint(1, 6))) for i in range(n) for j in range(i) if rnd.random() < 0.5]

        def cost(content):
            own = sum(abs(s) for s, kept in zip(scores, content) if (s > 0) != kept and s)
            return own + sum(price for i, j, price in edges if content[i] != content[j])

        best = min(cost(labels) for labels in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(scores, edges)) - best) < 1e-6


class Article(HTMLParser):
    """The text of the blocks directly below <article>, read without any of the operator's code."""

    LEFT_OUT = {"script", "style", "form", "aside", "nav", "figure", "button"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in {"br", "img", "input", "hr", "meta", "link"}:
            return
        self.open.append((tag, dict(attrs)))
        if tag in {"p", "li", "h1", "h2", "h3", "pre", "blockquote", "td"}:
            self.now = []
            self.blocks.append(self.now)

    def handle_endtag(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        names = [tag for tag, _ in self.open]
        if "article" in names and not self.LEFT_OUT & set(names) and self.now is not None:
            self.now.append(data)

    def text(self):
        lines = (" ".join("".join(parts).split()) for parts in self.blocks)
        return "\n".join(line for line in lines if line)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_text(pages).collect()
    same = 0
    for row in rows:
        reader = Article()
        reader.feed(row.html)
        same += row.main_text == reader.text() != ""
        assert row.html.split("<footer>")[1][:10] not in row.main_text
    assert same == len(rows)


def test_edge_cases(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, "<p>" + "word and word. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("x"))
    found = extract_text(pages, name="text")
    assert found.columns == ["page_id", "html", "text"]
    texts = {r.page_id: r.text for r in found.collect()}
    assert found.count() == 5
    assert texts[2] == texts[3] == "" and texts[1] == main_text(PAGE)
    assert len(texts[None]) == len("word and word. " * 20_000) - 1
    assert extract_text(pages.limit(0)).count() == 0
