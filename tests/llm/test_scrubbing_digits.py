"""Private data in digits of any script is found without an ASCII digit beside it."""

import sys

import regex

from talkloom.llm import token_counts as T


def test_numbers_in_other_scripts(spark):
    zeros = (0x660, 0x966, 0xFF10)
    number = lambda zero: "call " + "".join(chr(zero + d) for d in (5, 5, 1, 2, 3, 4, 5, 6, 7)) + " now"
    rows = [(i, number(zero)) for i, zero in enumerate(zeros)] + [(9, "no number here")]
    found = T.scrubbing(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, [e.replacement for e in r.edits]) for r in found) == [(i, ["[phone]"]) for i in range(len(zeros))]


def test_every_digit_of_the_patterns_comes_through(spark):
    digits = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and regex.match(r"\d", c)]
    rows = [(i, "call " + digit * 9) for i, digit in enumerate(digits)]
    found = T.scrubbing(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert len(digits) > 600 and {r.doc_id for r in found} == set(range(len(digits)))
