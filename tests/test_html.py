"""Pages against the standard library's parser, and references against its table."""

import html as standard
import random
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from deskgrain.operators import html

PIECES = """<nav>|</nav>|<footer class='a>b'>|</footer>|<script>|</script>|<script>if(a<b){'</p>'}</script>|<style>|</STYLE >|<title>|</title>|<h1>|</h1>
<P class="x>y">|</p>|<li/>|<br/>|<nav/>|<b>|</b>|text|two words|  spaced out |&amp;|caf&eacute;|&#8217;|&#x41;|&notit;|&#0;|&#150;|&#xD800;|&bogus;|&copy
<!-- c <p> -->|<!--x|<!DOCTYPE html>|<?php x ?>|a < b|<|1 <2|&nbsp;|<a href=x>|</ p>|<title/>|</>|</3 x>|<![CDATA[ x ]]>|&Aacute x|&ampx|R&D|x&""".replace("\n", "|").split("|")


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.named, self.depth, self.lines, self.titles = False, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.named |= tag == "title"
        self.depth += tag in html.HIDDEN
        self.handle_break(tag)

    def handle_endtag(self, tag):
        self.named &= tag != "title"
        self.depth -= tag in html.HIDDEN and self.depth > 0
        self.handle_break(tag)

    def handle_break(self, tag):
        if tag in html.BREAKS and not self.depth:
            self.lines.append("\n")

    def handle_data(self, data):
        text = " ".join(data.split())
        if self.cdata_elem or not text:
            return
        if self.named:
            self.titles.append(text)
        elif not self.depth:
            self.lines.append(text)


def parsed(page):
    p = Plain()
    p.feed(page or "")
    body = "\n".join(x.strip() for x in "".join(p.lines).splitlines() if x.strip())
    return " ".join(p.titles), body, len(body.split()) < 5


def differing(pages):
    rows = pages.select("h", html.html_page(F.col("h")).alias("p")).collect()
    return [(r["h"], tuple(r["p"]), parsed(r["h"])) for r in rows if tuple(r["p"]) != parsed(r["h"])]


def test_nested_unclosed_and_commented_tags(spark):
    rng = random.Random(4)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(3000)] + [None, ""]
    pages += ["<nav><script>x</script>Menu words here</nav><p>body", "<nav><nav>a</nav>b</nav>c", "</nav></nav><p>seen<nav>not", "<b>" * 5000 + "x"]
    assert differing(spark.createDataFrame([(p,) for p in pages], "h string")) == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_all_pages(spark, size):
    assert differing(spark.read.parquet(f"/root/testdata/{size}/pages.parquet").selectExpr("html AS h")) == []


def test_what_stands_between_runs_of_text(spark):
    d = spark.createDataFrame([("<title>T</title><p>Sign <b>in</b> now &amp; here <i>or</i> there",)], "h string")
    r = d.select(html.html_page(F.col("h")).alias("a"), html.html_page(F.col("h"), between=" ").alias("b")).first()
    assert (r["a"]["body"], r["b"]["body"]) == ("Signinnow & hereorthere", "Sign in now & here or there")


def test_every_reference_of_the_standard_table(spark):
    names = list(html5)
    texts = ["&" + n for n in names] + ["&" + n.rstrip(";") + "zz" for n in names] + ["x &" + n + ".&" for n in names]
    numbers = [*range(400), *range(0x2000, 0x2100), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**30]
    texts += [f"&#{n};" for n in numbers] + [f"&#x{n:x}a;&#X000{n:X} " for n in numbers] + ["", "&", "&;", "&#;", "&#x;", "&&amp;;", "a&b&c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.unescaped(F.col("t")).alias("u")).collect()
    assert [r for r in rows if r["u"] != standard.unescape(r["t"])] == []


def test_plain_text(spark):
    page = "<title>A</title><style>p{}</style><p>It&rsquo;s &ldquo;x&#8221; &mdash; caf&eacute;<!-- no -->s&nbsp;&rarr;<script>if(a<b)</script> &zwj;end &#x1F600;"
    d = spark.createDataFrame([(page,), (None,), ("no markup",)], "h string")
    assert [r[0] for r in d.select(html.html_plain(F.col("h"))).collect()] == ["A It's \"x\" - caf s -> end", "", "no markup"]
