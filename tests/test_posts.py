import re

import pytest
from pyspark.sql import functions as F

from talkloom.operators import posts as P, ranks as R
from talkloom.plans import jobs
from talkloom.session import materialise

RAW = "id_str string, full_text string, created_at string, in_reply_to_status_id_str string, is_quote_status boolean, ord int"


def raw(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW)


def test_unify_fills_the_fixed_columns(spark):
    rows = spark.createDataFrame(
        [("", "7", None, "short & text", "0", None, "x", '<a href="u">App</a>'), (None, None, "", None, "5", "q", None, None)],
        "id_str string, id string, full_text string, text string, in_reply_to_status_id string, "
        "quoted_status_id_str string, created_at string, source string",
    )
    a, b = P.unify_posts(rows).collect()
    assert (a.id_str, a.text, a.in_reply_to_id, a.is_quote, a.source_app, a.ts, a.lang) == ("7", "short & text", "", False, "App", None, "")
    assert (b.id_str, b.text, b.in_reply_to_id, b.is_quote, b.source_app) == ("", "", "5", True, "")


def test_repost_mark_survives_cleaning_only_before_a_non_word(spark):
    rows = raw(spark, [("1", "RT @bob: hi", None, None, False), ("2", "RT @ hi", None, None, False)])
    flags = lambda df: [r.is_retweet for r in df.orderBy("ord").collect()]
    assert flags(P.unify_posts(rows)) == [False, True]
    assert flags(P.unify_posts(rows, on_raw=True)) == [True, True]


def test_dedup_keeps_the_first_in_input_order_and_one_empty_post(spark):
    rows = raw(spark, [
        ("1", "Same &amp; text", "2020-01-02", None, False), ("2", "same & TEXT @x", "2020-01-01", None, False),
        ("3", "https://a.b/c", None, None, False), ("4", "@only #tags", None, None, False),
    ])
    kept = P.dedup_posts(P.unify_posts(rows))
    assert sorted(r.id_str for r in kept.collect()) == ["1", "3"]


def test_dialogs(spark):
    rows = raw(spark, [
        ("1", "RT @ parent", "2020-01-01", None, False),  # filtered, still a parent
        ("2", "answer", "2020-01-02", "1", False),
        ("3", "orphan", None, "99", False),
        ("4", "plain", "2020-01-03", None, False),
        ("5", "twice, first", None, None, False),
        ("5", "twice, last", None, None, False),
        ("6", "to the double", None, "5", False),
        ("", "no id", None, None, False),
    ])
    train, held_out = jobs.import_posts(rows, role="assistant")
    got = {(r.tweet_id, r.messages[-1].content): [tuple(m) for m in r.messages] for r in train.collect()}
    prompt = ("user", "Write a tweet in my style.")
    assert got[("2", "answer")] == [("user", "RT @ parent"), ("assistant", "answer")]
    assert got[("3", "orphan")] == [("assistant", "orphan")]
    assert got[("4", "plain")] == [prompt, ("assistant", "plain")]
    assert got[("6", "to the double")] == [("user", "twice, last"), ("assistant", "to the double")]
    assert len(got) == 7 and held_out.count() == 0


def test_longer_chains_alternate_backwards(spark):
    rows = raw(spark, [(str(i), f"t{i}", None, str(i - 1) if i else None, False) for i in range(5)])
    posts = P.unify_posts(rows)
    chains = {r.id_str: [tuple(m) for m in r.messages] for r in P.reply_dialogs(posts, posts, 3, "a").collect()}
    assert chains["4"] == [("user", "t1"), ("a", "t2"), ("user", "t3"), ("a", "t4")]
    assert chains["0"] == [("a", "t0")]


@pytest.mark.parametrize("parts", [1, 5])
def test_holdout_is_the_latest_posts(spark, parts):
    rows = raw(spark, [(str(i), f"t{i}", f"2020-01-{1 + i * 7 % 28:02d}" if i % 4 else None, None, False) for i in range(30)])
    train, held_out = jobs.import_posts(rows.repartition(parts), eval_pct=0.15)
    order = sorted(range(30), key=lambda i: (1 + i * 7 % 28 if i % 4 else 0, i))
    assert sorted(int(r.tweet_id) for r in held_out.collect()) == sorted(order[-4:])  # 4.5 rounds to even
    assert train.count() == 26


def test_positions(spark):
    rows = spark.range(500).withColumn("k", F.col("id") * 37 % 10).repartition(7)
    got = {r.id: r.position for r in R.positions(rows, [F.col("k"), F.col("id")], [F.col("id")]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (i * 37 % 10, i)))}


@pytest.mark.parametrize("rows, size", [(0, 0), (1, 0), (2, 1), (10, 1), (50, 2), (9000, 450)])
def test_split_sizes(spark, rows, size):
    data = spark.range(rows).withColumn("same", F.lit(1))
    train, held_out = R.split(data, "id", 0.05)
    ids = [r.id for r in held_out.collect()]
    assert len(ids) == size and sorted(ids + [r.id for r in train.collect()]) == list(range(rows))
    assert sorted(r.id for r in R.split(data.repartition(3), "id", 0.05)[1].collect()) == sorted(ids)


def test_split_of_copies_needs_a_tie(spark):
    data = spark.range(20000).withColumn("same", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")))
    train, held_out = R.split(data, "same", 0.5, tie="id")
    assert held_out.count() == 10000 and train.count() == 10000
    everything = spark.range(20000).withColumn("same", F.lit(1))
    with pytest.raises(ValueError):
        R.split(everything, "same", 0.5)
    assert R.split(everything, "same", 0.5, tie="id")[1].count() == 10000


def test_texts_of_reply_dialogs_pass_two_exchanges(spark):
    rows = [(str(i), f"text {i}", str(i - 1), i, [i]) for i in range(6)]
    posts = materialise(spark.createDataFrame(rows, "id_str string, text string, in_reply_to_id string, ord long, more array<long>"), "posts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.reply_dialogs(posts, posts, 3, "a")._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # What each exchange is given: the text of posts or of ancestors, to two of them.
    given = [part.split("Input", 1)[1].split("\n", 1)[0] for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip())]
    assert given and sum("text" in columns for columns in given) == 2
    dialogs = P.reply_dialogs(posts, posts, 3, "a")
    assert dialogs.columns == [*posts.columns, "messages"]
    found = {r.id_str: (r.text, r.more, [m.content for m in r.messages]) for r in dialogs.collect()}
    assert found == {str(i): (f"text {i}", [i], [f"text {j}" for j in range(max(0, i - 3), i + 1)]) for i in range(6)}
