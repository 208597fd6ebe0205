"""The tag scans give the rows of the plain patterns, in time that grows with the page."""
import random
import re
import time

import pytest
from helpers import one_col
from pyspark.sql import functions as F

from gazette.operators.links import ANCHOR_RX, extract_links
from gazette.operators.pages import html_to_text, strip_sections, without_blocks

I, S = re.IGNORECASE, re.DOTALL
PARTS = ["<script>", "</script>", "<SCRIPT x", "<script", "<style a='>'>", "</style>", "<noscript>", "</noscript>", "<nav>", "</nav>", "<header ", "</header>",
         "<footer>", "</Footer>", "<aside", "</aside>", "<iframe>", "</iframe>", "<!--", "-->", "<!-->", ">", ">", "text ", "\n", "<p", "<p>", "</p>", "<br/>",
         "<h3>", "<h3 x", "</h3>", "Important links", " important \n LINKS", "frequently asked", "﷐", "﷑$1\\", "<a ", "<a href='x'>", "<a href=\"/y\">", "</a>",
         "<a href='#'>", "href=", "\"", "'", "<b>", "é"]


def plain_text(h):
    for tag in ("script", "style", "noscript"):
        h = re.sub(rf"<{tag}[^>]*>.*?</{tag}>", " ", h, flags=I | S)
    h = re.sub(r"<(nav|header|footer|aside|iframe)[^>]*>.*?</\1>", " ", h, flags=I | S)
    return re.sub(r"<!--.*?-->", " ", h, flags=I | S)


def plain_sections(c):
    c = re.sub(r"<h3[^>]*>[ \t\n\x0b\f\r]*important[ \t\n\x0b\f\r]+links.*?</h3>.*?(?=<h3|\n?\Z)", "", c, flags=I | S)
    c = re.sub(r"<h3[^>]*>[ \t\n\x0b\f\r]*frequently[ \t\n\x0b\f\r]+asked.*?</h3>.*?(?=<h3|\n?\Z)", "", c, flags=I | S)
    return re.sub(r"<script\b[^>]*>.*?</script>", "", c, flags=I | S | re.ASCII)


def soup(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(1, 24))) for _ in range(n)] + ["", "﷐﷑﷒﷓<script><script></script><nav>"]


def test_text_equals_the_plain_patterns(spark):
    pages = soup(1500, 1)
    assert one_col(spark, pages, without_blocks) == [plain_text(p) for p in pages]


def test_sections_equal_the_plain_patterns(spark):
    texts = soup(1500, 2)
    assert one_col(spark, texts, strip_sections) == [plain_sections(t) for t in texts]


def test_anchors_equal_the_plain_pattern(spark):
    pages = soup(1500, 3)
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {r["page_id"]: [(x["raw_href"], x["raw_title"]) for x in r["links"]] for r in extract_links(df).collect()}
    assert got == {k: re.findall(ANCHOR_RX, p, flags=I | S) for k, p in enumerate(pages)}


@pytest.mark.parametrize("piece", ["<a href='x'>y ", "<a <b ", "<script>x ", "<script ", "<nav><style>", "<!-- ", "<h3>important links ", "<h3 ", "<p "])
def test_time_grows_with_the_page(spark, piece):
    def seconds(n):
        df = spark.createDataFrame([(1, piece * n + "</a></h3>" + piece * n)], "page_id int, html string")
        df = extract_links(df).select(F.size("links").alias("a"), F.length(html_to_text("html")).alias("t"), F.length(strip_sections("html")).alias("s"))
        df.collect()
        start = time.perf_counter()
        df.collect()
        return time.perf_counter() - start
    small, large = seconds(10_000), seconds(40_000)
    assert large < 8 * max(small, 0.25), (small, large)
