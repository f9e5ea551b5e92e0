import datetime
import hashlib
import html
import re

import pytest
from hypothesis import given, settings, strategies as st

from talkloom.functions import text, times


def test_whitespace_class_is_pythons():
    assert set(text.WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_clean_text(apply):
    cases = {
        "RT @bob: see https://x.y/z #tag  hi": "RT : see hi",
        "x This tweet was edited at 10:00": "x",
        "x this tweet was edited at 10\nmore": "x this tweet was edited at 10 more",
        "x this tweet was edited at 10\n": "x",
        "a‏‎b\r\nc\rd\xa0e": "ab c d e",
        "&lt;b&gt; &amp;amp;": "<b> &amp;",
        "": "",
    }
    assert apply(text.clean_text, [*cases, None]) == [*cases.values(), ""]


def test_norm_text_strips_tags_before_decoding(apply):
    assert apply(text.norm_text, ["a &lt;b&gt; c", "<p>x</p>\n y", "a <b> c", None]) == ["a <b> c", "x y", "a c", ""]


def test_unescape_is_single_pass_and_knows_all_entities(apply):
    values = ["&amp;lt;", "&copy 1 &eacute; &#1488; &#x5d0;", "&notit; &bogus; a&b", "&", "x&&amp;&", "&#0;&#128;&#xD800;"]
    assert apply(text.unescape, values) == [html.unescape(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="&#;xampltgt1 23<né\n", max_size=30), min_size=50, max_size=100))
def test_unescape_agrees_with_the_standard_library(spark, values):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(3)
    got = {r.i: r.out for r in rows.select("i", text.unescape(F.col("v")).alias("out")).collect()}
    assert got == {i: html.unescape(v) for i, v in enumerate(values)}


def test_each_forms_equal_scalar_forms(spark, apply):
    from pyspark.sql import functions as F

    values = ["a &lt;b&gt;", None, "<i>x</i> &amp;amp; y", "", "plain"]
    rows = spark.createDataFrame([(values,), ([],), (values[:2],)], "v array<string>")
    got = [r.out for r in rows.select(text.norm_text_each(F.col("v")).alias("out")).collect()]
    want = apply(text.norm_text, values)
    assert got == [want, [], want[:2]]


def test_norm_ws_and_paragraphs(apply):
    assert apply(text.norm_ws, ["a\r\n\r\n\r\n\rb \t c\x0b\x0cd\xa0"]) == ["a\n\nb c d"]
    assert apply(text.paragraphs, ["a\n \n\nb\n\nc", "", "x\ny"]) == [["a", "b", "c"], [], ["x\ny"]]
    lines = lambda c: text.paragraphs(c, "\n")
    assert apply(lines, ["x\n\n y "]) == [["x", "y"]]


def test_hashes(apply):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert apply(text.chunk_hash, ["  A &amp;\n <b>É "]) == [sha("a & <b>é")]
    assert apply(text.post_dedup_key, ["Hi  @you THERE"]) == [sha("hi there")]


def test_topic_words(apply):
    words = "One two TWO three four five six seven eight nine https://skip.me/now"
    got = apply(text.topic_words, [words, "a bc", "don't אבג"])
    assert got == [["one", "two", "three", "four", "five", "six", "seven", "eight"], ["general"], ["don't", "אבג"]]


def test_source_app(apply):
    cases = ['<a href="http://x">App &amp; Co</a>', "plain <b>", "", None, "<a></a>"]
    assert apply(text.source_app, cases) == ["App & Co", "plain", "", "", ""]


def test_forum_html_to_text(apply):
    assert apply(text.forum_html_to_text, ["<p>a</p> <p>b<br/>c  d</p>\\/x &amp; y", None]) == ["a\n\nb\nc d/x & y", ""]


def test_html_to_text(apply):
    cases = {
        "<p>a</p><p>b<!-- x > y -->c</p>": "\na\nb\nc\n",
        "a<script>x<b>y</script>b": "a\nb",
        "a<STYLE>x</STYLE ><noscript>n</noscript>b &lt; c": "a\nb < c",
        "1 < 2": "1 < 2",
        "<p>" * 50_000 + "z": "\nz",
    }
    assert apply(text.html_to_text, list(cases)) == list(cases.values())


def test_titled_text(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("t", "b"), (None, "b"), ("t", None), (" ", "")], "t string, b string")
    got = [r[0] for r in rows.select(text.titled_text(F.col("t"), F.col("b"))).collect()]
    assert got == ["t\n\nb", "b", "t", ""]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_ts(spark, apply, zone):
    from pyspark.sql import functions as F

    at = lambda *a: datetime.datetime(*a, tzinfo=datetime.timezone.utc).timestamp()
    cases = {
        "Wed Oct 10 20:19:24 +0000 2018": at(2018, 10, 10, 20, 19, 24),
        "Wed Oct 10 20:19:24 -0130 2018": at(2018, 10, 10, 21, 49, 24),
        "2018-10-10 20:19:24+0200": at(2018, 10, 10, 18, 19, 24),
        "2018-10-10 20:19:24": at(2018, 10, 10, 20, 19, 24),
        "2018-10-10T20:19:24Z": at(2018, 10, 10, 20, 19, 24),
        "2018-10-10T20:19:24.5Z": at(2018, 10, 10, 20, 19, 24, 500_000),
        " 2018-10-10 ": at(2018, 10, 10),
        "junk": None, "": None, "2018": None, "10:00": None, "2018-13-10": None, "2018-10-10 20:19:24 x": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = apply(lambda c: F.unix_micros(times.parse_ts(c)) / 1e6, [*cases, None])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [*cases.values(), None]


def test_next_start(apply):
    cases = {
        "2024-01-01T00:00:59Z": "2024-01-01T00:01:00Z",
        "2024-01-01T00:00:00.500Z": "2024-01-01T00:00:01.500000Z",
        "2024-12-31T23:59:59+02:00": "2025-01-01T00:00:00+02:00",
        "2024-01-01T00:00:00": "2024-01-01T00:00:01",
        "junk": "junk",
    }
    assert apply(times.next_start, list(cases)) == list(cases.values())


def test_tags_with_quotes_and_unclosed_elements(apply):
    from html.parser import HTMLParser

    from talkloom.functions.text import html_to_text

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.dropped = [], 0

        def handle_starttag(self, tag, attrs):
            self.dropped += tag in ("script", "style", "noscript")

        def handle_endtag(self, tag):
            self.dropped -= tag in ("script", "style", "noscript")

        def handle_data(self, data):
            if not self.dropped:
                self.parts.append(data)

    pages = [
        '<p title="a > b">text</p>', "<p title='a > \"b\"'>text</p>one<br/>two", "a<script>if (1 < 2) x</script >b",
        "a<script>never closed <p>b</p>", "x<style a='>'>p{}</style>y", "it's 5 o'clock <b>don't</b>", "<p><b>a</b></p>",
        "a<noscript>no <i>script</i></noscript>b", "<p><b></b></p>",
    ]
    expected = []
    for page in pages:
        parser = Text()
        parser.feed(page)
        expected.append("".join("".join(parser.parts).split()))
    found = apply(html_to_text, pages)
    assert ["".join(t.split()) for t in found] == expected
    assert found[-1] == ""


def test_iso_and_weekday_forms(apply):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from talkloom.functions.times import parse_ts

    at = lambda *parts: int(datetime(*parts, tzinfo=timezone.utc).timestamp())
    forms = {
        "20240101": at(2024, 1, 1), "20240101T101010": at(2024, 1, 1, 10, 10, 10), "2024-01-01T10": at(2024, 1, 1, 10),
        "2024-01-01T10:11:12,5": at(2024, 1, 1, 10, 11, 12), "Wed Oct 10 20:19:24 +00:00 2018": at(2018, 10, 10, 20, 19, 24),
        "Wed Oct 10 20:19:24 +0200 2018": at(2018, 10, 10, 18, 19, 24), "Xyz Oct 10 20:19:24 +0000 2018": None,
        "20240101T1010": at(2024, 1, 1, 10, 10), "2024-01-01T10+01:00": at(2024, 1, 1, 9), "2018": None, "10:00": None,
    }
    assert dict(zip(forms, apply(lambda c: F.unix_seconds(parse_ts(c)), list(forms)))) == forms


def test_week_dates_and_hour_offsets(spark, apply):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from talkloom.functions.times import parse_ts

    forms = ["2024-01-01 10:10:10+02", "2024-W01-1", "2024W011", "2024-W01", "2024W01T10", "2020-W53-7 23:59:59+0530", "2021-W53-1", "2021-W00-1",
             "2024-W01-8", "2024-W01-0", "2026-W53-7T01:02:03.5-08", "2024-01-01T10:10-03", "20240101T101010+02", "2024-W1-1",
             "1:2:3+02", "2024-01-01 1:02:03+02", "2024-01-01 10:10:10+2", "2009-W01-1", "2024-W52-7T10:10:10,25+02"]

    def plain(text):
        try:
            at = datetime.fromisoformat(text)
        except ValueError:
            return None
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()

    found = apply(lambda c: F.unix_micros(parse_ts(c)) / 1e6, forms)
    assert dict(zip(forms, found)) == {f: plain(f) for f in forms}


def test_texts_are_untagged_once_for_their_key(spark):
    from talkloom.operators.examples import dedup_examples

    rows = spark.createDataFrame([([("user", "a"), ("assistant", "b <i>C</i>")], 1)], "messages array<struct<role:string,content:string>>, ord long")
    plan = dedup_examples(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2  # tags, and blanks


def test_topic_words_found_in_the_head_of_a_text(apply):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [" ".join(w[: n % 5 + 3] for w in words[: n % 40]) + "x" * (n % 7) + " https://a.b/" * (n % 3) + " Kind Kind end" for n in range(0, 120, 7)]
    texts += ["a" * 126 + " bcdef", "same " * 60 + "other words here", ""]
    found = apply(text.topic_words, texts)
    for whole, got in zip(texts, found):
        every = re.findall(text.TOPIC_WORD.replace("\\p{L}\\p{N}_", "\\w"), re.sub(r"https?://\S+", "", whole))
        assert got == (list(dict.fromkeys(w.lower() for w in every))[:8] or ["general"])


def test_only_untidy_white_space_is_replaced(apply):
    texts = ["a b", "a  b", " a\tb \n c ", "a　b", "a  ", "\x85a\x1c \x1fb", "a b  c d\n", ""]
    assert apply(text.collapse_ws, texts) == [" ".join(re.split(f"[{text.WS_CHARS}]+", t)).strip(" ") for t in texts]
