"""Text cleaning as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Whitespace and word classes (the Unicode classes of Python's
# re module, spelled so that Java and RE2 agree), patterns and prompts.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
# White space other than single blanks: only that has to be replaced.
UNTIDY = rf"{WS}(?:{WS}++|(?<! ))"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]"
URL = rf"https?://{NOT_WS}+"
TAG = r"<[^>]+>"
HANDLE_OR_HASHTAG = rf"[#@]{WORD}+"
EDIT_NOTICE = rf"(?i)this tweet was edited at{WS}[^\n]*\n?\z"
DIRECTION_MARKS = ("\u200e", "\u200f")
ANCHOR_TEXT = r">([^<]+)<"
TOPIC_WORD = "[A-Za-z\u0590-\u05FF][\\p{L}\\p{N}_\u2019\u05f3\u05f4'-]{2,}"
CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


#: Characters of a text in which its first topic words are looked for before the whole of it.
TOPIC_HEAD = 128


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` refers to it; ``use`` holds no UDF."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _where_any(c: Column, marks: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change`` for the texts that hold one of the marks, as a pattern costs more than a look for them."""

    def changed(text: Column) -> Column:
        return F.when(reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks]), change(text)).otherwise(text)

    return bound(c, changed)


def _charref_decoder():
    # A closure travels to the executors by value, so they need not have this package.
    def offsets(lists):
        starts = lists.offsets.to_numpy()
        return pa.array(starts - starts[0], pa.int32())

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def decode(refs: pa.Array) -> pa.Array:
        texts = refs.flatten()
        coded = texts.flatten().dictionary_encode()
        chars = pa.array([html.unescape(ref) for ref in coded.dictionary.to_pylist()], pa.string())
        inner = pa.ListArray.from_arrays(offsets(texts), chars.take(coded.indices))
        return pa.ListArray.from_arrays(offsets(refs), inner)

    return decode


_decode_charrefs = _charref_decoder()


def _charrefs(c: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.contains(c, F.lit("&")), F.regexp_extract_all(c, F.lit(CHARREF), F.lit(0))).otherwise(none)


def _with_charrefs(c: Column, decoded: Column) -> Column:
    """Put the decoded references back between the pieces of ``c``."""
    pieces = F.split(c, CHARREF, -1)
    fill = F.concat(decoded, F.array(F.lit("")))
    filled = F.array_join(F.zip_with(pieces, fill, lambda piece, char: F.concat(piece, char)), "")
    return F.when(F.contains(c, F.lit("&")), filled).otherwise(c)


def unescape(c: Column) -> Column:
    """Decode HTML character references (single pass, full HTML5 table).

    Spark has no such function. The text stays in the JVM; Python receives only
    the list of references found, which is empty for most rows.
    """
    text = F.coalesce(c, F.lit(""))
    return _with_charrefs(text, F.get(_decode_charrefs(F.array(_charrefs(text))), F.lit(0)))


def unescape_each(texts: Column) -> Column:
    """``unescape`` for every element of an array without nulls."""
    decoded = _decode_charrefs(F.transform(texts, _charrefs))
    return F.zip_with(texts, decoded, _with_charrefs)


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, UNTIDY, " "))


def clean_text(c: Column) -> Column:
    """Post text: decode, drop links, handles, hashtags and the edit notice, tidy spaces."""
    text = _where_any(unescape(c), ("://",), lambda t: F.regexp_replace(t, URL, ""))
    text = _where_any(text, ("#", "@"), lambda t: F.regexp_replace(t, HANDLE_OR_HASHTAG, ""))
    text = F.regexp_replace(text, EDIT_NOTICE, "")
    for mark in DIRECTION_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return collapse_ws(text)


def post_dedup_key(c: Column) -> Column:
    """SHA-256 of the lower-cased, cleaned post text."""
    return F.sha2(F.lower(clean_text(c)), 256)


def untag(c: Column) -> Column:
    return _where_any(F.coalesce(c, F.lit("")), ("<",), lambda text: F.regexp_replace(text, TAG, " "))


def norm_text(c: Column) -> Column:
    """Message text: tags to spaces, then decode, then tidy spaces (not idempotent)."""
    return tidy_untagged(untag(c))


def tidy_untagged(untagged: Column) -> Column:
    """The rest of ``norm_text`` for an untagged text."""
    return collapse_ws(unescape(untagged))


def decode_each(untagged: Column) -> Column:
    """The rest of ``norm_text`` for every element of an array of untagged texts."""
    return F.transform(unescape_each(untagged), collapse_ws)


def norm_text_each(texts: Column) -> Column:
    """``norm_text`` for every element of an array."""
    return decode_each(F.transform(texts, untag))


def unix_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def norm_ws(c: Column) -> Column:
    """Document text: one kind of newline, single blanks, at most one blank line in a row."""
    text = _where_any(c, ("\r",), unix_newlines)
    blanks = r"[\t\f\x0b][ \t\f\x0b]*+| [ \t\f\x0b]++"  # but for single blanks
    text = _where_any(text, ("  ", "\t", "\f", "\x0b"), lambda t: F.regexp_replace(t, blanks, " "))
    return strip(_where_any(text, ("\n\n\n",), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")))


def chunk_hash(c: Column) -> Column:
    """SHA-256 of the decoded, space-tidied, lower-cased paragraph."""
    return F.sha2(F.lower(collapse_ws(unescape(c))), 256)


def paragraphs(c: Column, separator: str = rf"\n{WS}*\n") -> Column:
    """Non-empty trimmed paragraphs in order."""
    return F.filter(F.transform(F.split(c, separator, -1), strip), lambda p: p != "")


def topic_words(c: Column, limit: int = 8) -> Column:
    """First ``limit`` distinct lower-cased words, or ``general``."""

    def words(text: Column) -> Column:
        plain = _where_any(text, ("://",), lambda t: F.regexp_replace(t, URL, ""))
        return F.regexp_extract_all(plain, F.lit(TOPIC_WORD), F.lit(0))

    def first(found: Column) -> Column:
        return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, limit)

    def topics(text: Column) -> Column:
        # The last word of a text's head may be cut off. With enough words before it, the rest is not looked at.
        whole = F.length(text) <= TOPIC_HEAD
        head = bound(words(F.substring(text, 1, TOPIC_HEAD)), lambda found: first(
            F.when(whole, found).otherwise(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))))
        return bound(head, lambda early: F.when(whole | (F.size(early) == limit), early).otherwise(first(words(text))))

    return bound(bound(c, topics), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general"))))


def source_app(c: Column) -> Column:
    """Name of the posting app from its HTML anchor."""
    raw = F.coalesce(c, F.lit(""))
    named = F.regexp_extract(raw, ANCHOR_TEXT, 1)
    return clean_text(F.when(named != "", named).otherwise(F.regexp_replace(raw, TAG, "")))


def forum_html_to_text(c: Column) -> Column:
    """Forum markup to text with line breaks kept."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"<br(?: ?/)?>", "\n")
    text = F.regexp_replace(text, rf"(?i)</p>{WS}*<p>", "\n\n")
    text = F.regexp_replace(text, r"(?i)</?p[^>]*>", "")
    text = unescape(F.replace(F.regexp_replace(text, TAG, ""), F.lit("\\/"), F.lit("/")))
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def titled_text(title: Column, body: Column) -> Column:
    """Title, blank line, body; a missing part counts as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))))


# Comments, dropped elements and tags. A quoted attribute value may hold any
# character; a quote without an end is an ordinary character. A dropped element
# without an end reaches to the end of the page. The possessive form keeps Java
# from recursing over long runs of adjacent tags.
_REST_OF_TAG = r"(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)"
HTML_MARKUP = (
    r"(?is)(?:<!--.*?-->"
    + "".join(rf"|<{name}\b{_REST_OF_TAG}.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "noscript"))
    + rf"|<[a-z/!?]{_REST_OF_TAG})++"
)


def html_to_text(c: Column) -> Column:
    """Visible text of an HTML page, one newline between neighbouring text nodes; empty without any."""
    text = F.regexp_replace(c, HTML_MARKUP, "\n")
    only_markup = (text == "\n") & F.startswith(c, F.lit("<")) & F.endswith(c, F.lit(">"))
    return unescape(F.when(only_markup, F.lit("")).otherwise(text))
