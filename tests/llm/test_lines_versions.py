"""Rows of one id lose their own lines only."""

from talkloom.llm import lines as L


def test_a_version_keeps_its_own_lines(spark):
    rows = [(0, "a line seen in doc 0 and again"), (1, "a line seen in doc 0 and again"), (1, "a unique line, nowhere else")]
    assert sorted((str(r.doc_id), r.text) for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [("0", rows[0][1]), ("1", ""), ("1", rows[2][1])]
