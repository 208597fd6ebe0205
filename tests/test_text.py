"""Number, date and text helpers."""
from pyspark.sql import functions as F

from gazette.functions.text import byte_cut, leading_int
from gazette.operators import normalize as N
from gazette.operators.pages import cap_text, html_to_text

from helpers import one_col


def test_leading_int(spark):
    cases = {"12abc": 12, " 42": 42, "-5 posts": -5, "12.7": 12, "1e3": 1000, "abc": 0, "": 0, "+7": 7}
    assert one_col(spark, list(cases), leading_int) == list(cases.values())


def test_sanitize_total_posts(spark):
    cases = {"120": 120, "1,234": 1, "-5": 0, "-5 posts": 5, "12.7": 12, "1e3": 1000, "As per rules": 0,
             "": 0, "0": 0}
    assert one_col(spark, list(cases), N.sanitize_total_posts) == list(cases.values())


def test_safe_date(spark):
    cases = {"2026-06-30": "30-06-2026", "1999-12-31": "Check Notification", "": "Check Notification",
             "As per notice": "Check Notification", "15-08-2026": "15-08-2026", " 2026-01-02 ": "02-01-2026"}
    assert one_col(spark, list(cases), N.safe_date) == list(cases.values())


def test_byte_cut_drops_split_character(spark):
    vals = ["abcdef", "abécd", "\U0001F525abc", "short"]
    assert one_col(spark, vals, lambda c: byte_cut(c, 3)) == ["abc", "ab", "", "sho"]
    assert one_col(spark, vals, lambda c: byte_cut(c, 4)) == ["abcd", "abé", "\U0001F525", "shor"]


def test_html_to_text(spark):
    html = ("<html><head><script>var a='<p>';</script><style>p{}</style></head><body>"
            "<nav>menu</nav><p>Hello&nbsp;&amp;   world</p><!-- c --><aside>side</aside>"
            "<ul><li>one</li><li>two</li></ul>\n\n\n\n<footer>f</footer></body></html>")
    got = one_col(spark, [html], lambda c: html_to_text(c))[0]
    assert got == "Hello\xa0& world\n \none\ntwo"  # nbsp decodes to U+00A0; removals leave a blank line


def test_text_cap(spark):
    got = one_col(spark, ["x" * 9001, "y" * 9000], lambda c: cap_text(c, 9000))
    assert got[0] == "x" * 9000 + " [truncated]" and got[1] == "y" * 9000


def test_salary_range_and_text(spark):
    df = spark.createDataFrame([("0", "0", "Pay Level 7 (Rs. 44,900 - 1,42,400)"), ("25000", "0", "Rs. 35,400"),
                                ("0", "0", "")], "mn string, mx string, s string")
    lo, hi = N.salary_range("mn", "mx", "s")
    got = df.select(lo, hi, N.salary_text("s", "mn")).collect()
    assert [tuple(r) for r in got] == [(7, 142400, "Pay Level 7 (Rs. 44,900 - 1,42,400)"),
                                       (25000, 25000, "Rs. 35,400 (₹25,000/month)"),
                                       (0, 0, "Check Notification")]


def test_indian_grouping(spark):
    assert one_col(spark, [5, 1234, 123456, 12345678], N.indian_grouping, "v long") == \
        ["5", "1,234", "1,23,456", "1,23,45,678"]
