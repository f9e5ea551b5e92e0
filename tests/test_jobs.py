import json

import pytest
from pyspark.sql import functions as F

from talkloom.functions.messages import MESSAGES
from talkloom.operators import posts as P, sync as S
from talkloom.operators.lookup import free_name, keep_first, lookup, unseen
from talkloom.plans import jobs
from talkloom.sources import state as ledgers
from talkloom.sources.state import load_state, open_state
from talkloom.streaming.sync import start_post_sync

FEED = "id string, text string, created_at string, source string, referenced_tweets array<struct<type:string,id:string>>, ord int"


def lines(path):
    return [json.loads(line) for part in sorted(path.rglob("part-*")) for line in part.read_text().splitlines()]


def example(answer, prompt="q", **more):
    return json.dumps({"messages": [{"role": "user", "content": prompt}, {"role": "model", "content": answer}], **more})


# --- sync ---


def feed(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FEED)


def test_sync_checks(spark):
    rows = feed(spark, [
        ("1", "known already, long enough", "2024-01-09T00:00:00Z", "web", None),
        ("2", "short", "2024-01-08T00:00:00Z", "web", None),
        ("2", "long enough now", "2024-01-03T00:00:00Z", "web", None),
        ("2", "long enough again", "2024-01-07T00:00:00Z", "web", None),
        ("3", "from a bot, long enough", "2024-01-06T00:00:00Z", "bot", None),
        ("4", "a quote, long enough", "2024-01-05T00:00:00Z", None, [("quoted", "1")]),
        ("5", "no source, long enough", None, None, [("replied_to", "1")]),
    ])
    known = spark.createDataFrame([("1",), ("1",)], "tweet_id string")
    options = dict(exclude_sources={"bot"}, no_quotes=True)
    examples, mark = jobs.sync_posts(rows, known, "2024-01-01T00:00:00Z", **options)
    assert {r.tweet_id: r.messages[1].content for r in examples.collect()} == {"2": "long enough now", "5": "no source, long enough"}
    assert mark.first().start_time == "2024-01-03T00:00:01Z"
    examples, mark = jobs.sync_posts(rows.where("id = '1'"), known, "2024-01-01T00:00:00Z", **options)
    assert examples.isEmpty() and mark.first().start_time == "2024-01-01T00:00:00Z"
    assert S.next_mark(rows.withColumn("created_at", F.lit("2020")), "2024-01-01T00:00:00Z").first()[0] == "2024-01-01T00:00:01Z"


def page(path, *posts):
    path.parent.mkdir(exist_ok=True)
    path.write_text(json.dumps({"data": [{"id": i, "text": f"post number {i} text", "created_at": at} for i, at in posts]}))


def test_sync_runs(spark, tmp_path):
    pages, out, state = tmp_path / "pages", tmp_path / "posts.jsonl", tmp_path / "state"
    run = lambda: jobs.run_post_sync(spark, str(pages), str(out), str(state))["appended"]
    page(pages / "a.json", ("1", "2024-01-01T00:00:00.000Z"), ("2", "2024-01-02T00:00:00.000Z"))
    assert [run(), run()] == [2, 0]
    page(pages / "b.json", ("2", "2024-01-05T00:00:00.000Z"), ("3", "2024-01-03T00:00:00.000Z"), ("4", "2024-01-01T00:00:00.000Z"))
    assert run() == 1  # 2 is known, 4 is older than the mark
    assert sorted(r["tweet_id"] for r in lines(out)) == ["1", "2", "3"]
    saved = load_state(spark, open_state(spark, str(state)), jobs.SYNC_STATE)
    assert saved.first().start_time == "2024-01-03T00:00:01Z"


def test_a_page_file_is_opened_once(spark, tmp_path, monkeypatch):
    pages, out, state = tmp_path / "pages", tmp_path / "posts.jsonl", tmp_path / "state"
    opened = []
    landed = jobs.landed_pages
    monkeypatch.setattr(jobs, "landed_pages", lambda s, paths, **k: opened.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or landed(s, paths, **k))
    run = lambda: jobs.run_post_sync(spark, str(pages), str(out), str(state))["appended"]
    page(pages / "a [1].json", ("1", "2024-01-01T00:00:00.000Z"))
    page(pages / "b.json", ("1", "2024-01-01T00:00:00.000Z"))
    assert [run(), run()] == [1, 0]
    page(pages / "c.json", ("1", "2024-01-09T00:00:00.000Z"))
    assert [run(), run()] == [0, 0]
    page(pages / "b.json", ("5", "2024-01-05T00:00:00.000Z"), ("6", "2024-01-05T00:00:00.000Z"))
    (pages / "c.json").unlink()
    assert [run(), run()] == [2, 0]
    assert opened == [["a \\[1\\].json", "b.json"], ["c.json"], ["b.json"]]
    log = load_state(spark, open_state(spark, str(state / "pages")), jobs.PAGE_LOG)
    assert sorted(r.path.rsplit("/", 1)[1] for r in log.collect()) == ["a [1].json", "b.json"]


def test_the_ledger_reads_the_buckets_that_are_hit(spark, tmp_path):
    ledger, out = str(tmp_path / "ids"), str(tmp_path / "out.jsonl")
    ledgers.seed_ledger(spark, ledger, out, "g")
    ids = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("tweet_id"))
    for n in range(3):
        ledgers.append_posts(ids.where(F.expr(f"hash(tweet_id) % 3 IN ({n}, {-n})")), out, ledger, f"g-{n}")
    asked = ids.where("tweet_id IN ('t5', 't77')")
    known = ledgers.ledger_ids(spark, ledger, "g-9", among=asked)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert known.where("tweet_id IN ('t5', 't77')").distinct().count() == 2 and known.count() < 300
    assert ledgers.ledger_ids(spark, ledger, "g-0").count() < 3000 == ledgers.ledger_ids(spark, ledger, "g-9").distinct().count()
    ledgers.merge_ledger(spark, ledger, "g-2", merge_after=2)
    names = {p.name for p in (tmp_path / "ids").glob("batch_id=*")}
    assert len(names) == 3 and {"batch_id=g-seed", "batch_id=g-2"} < names
    assert ledgers.ledger_ids(spark, ledger, "g-9").count() == 3000
    ledgers.merge_ledger(spark, ledger, "g-2", merge_after=2)
    assert {p.name for p in (tmp_path / "ids").glob("batch_id=*")} == names


def test_sync_survives_a_crash_and_a_lost_state(spark, tmp_path, monkeypatch):
    pages, out = tmp_path / "pages", tmp_path / "posts.jsonl"
    page(pages / "a.json", ("1", "2024-01-01T00:00:00.000Z"))
    monkeypatch.setattr(jobs, "publish_state", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        jobs.run_post_sync(spark, str(pages), str(out), str(tmp_path / "state"))
    monkeypatch.undo()
    assert jobs.run_post_sync(spark, str(pages), str(out), str(tmp_path / "state"))["appended"] == 1
    page(pages / "b.json", ("2", "2024-01-02T00:00:00.000Z"))
    assert jobs.run_post_sync(spark, str(pages), str(out), str(tmp_path / "other"))["appended"] == 1
    assert sorted(r["tweet_id"] for r in lines(out)) == ["1", "2"]


def test_stream(spark, tmp_path):
    pages, out, state = tmp_path / "pages", tmp_path / "posts.jsonl", tmp_path / "state"
    def run(checkpoint):
        start_post_sync(spark, str(pages), str(out), str(state), str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r["tweet_id"] for r in lines(out))

    page(pages / "a.json", ("1", "2024-01-01T00:00:00.000Z"), ("1", "2024-01-01T00:00:00.000Z"))
    assert run("c") == ["1"]
    page(pages / "b.json", ("1", "2024-01-03T00:00:00.000Z"), ("2", "2024-01-02T00:00:00.000Z"))
    assert run("c") == ["1", "2"]
    assert run("c") == ["1", "2"]
    assert run("fresh") == ["1", "2"]  # a lost checkpoint reads all pages again


# --- unify, split, render ---


def test_unify_job(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join([example("Same", created_at="b"), example("rt no"), "bad", example("b only")]))
    (tmp_path / "a.jsonl").write_text("\n".join([example("<b>same</b>", created_at="a"), example("a only", prompt="...")]))
    report, shares = jobs.run_unify(
        spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")], str(tmp_path / "unified.jsonl"), shuffle=False
    )
    rows = lines(tmp_path / "unified.jsonl")
    assert [r["messages"][1] for r in rows] == [
        {"role": "assistant", "content": c} for c in ("Same", "b only", "a only")
    ]
    assert rows[0]["created_at"] == "b" and set(rows[1]) == {"messages"}
    assert report.first().total_examples == 3
    assert {r.source_file: r.examples for r in shares.collect()} == {"b.jsonl": 2, "a.jsonl": 1}

    report, _ = jobs.run_unify(spark, [], str(tmp_path / "all.jsonl"), folder=str(tmp_path), drop_generic_prompts=True)
    assert report.first().total_examples == 2


def test_shuffle_depends_on_seed_alone(spark):
    rows = spark.createDataFrame(
        [([("user", "q"), ("assistant", f"answer {i}")], "f", i) for i in range(300)], f"messages {MESSAGES}, source_file string, ord int"
    )
    order = lambda df, seed: [r.ord for r in jobs.unify(df, seed=seed).collect()]
    first = order(rows, 1)
    assert first != sorted(first) and sorted(first) == list(range(300))
    assert order(rows.repartition(5), 1) == first and order(rows, 2) != first


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_unify_does_not_depend_on_partitions(spark, partitions):
    rows = spark.range(600).select(
        F.array(
            F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")),
            F.struct(F.lit("model").alias("role"), F.concat(F.lit("a"), F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id"))).alias("content")),
        ).alias("messages"), F.lit("f").alias("source_file"), F.col("id").alias("ord"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        kept = sorted(r.ord for r in jobs.unified_rows(rows.repartition(8)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert kept == sorted({0} | {i for i in range(600) if i % 3 == 0})


def test_split_job_passes_lines_through(spark, tmp_path):
    made = [example(i, extra={"n": [i]}) for i in range(30)] + [example("copy")] * 20
    (tmp_path / "in.jsonl").write_text("\n".join([*made, "", "bad"]))
    sizes = jobs.run_split(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "train.jsonl"), str(tmp_path / "eval.jsonl"), 0.05)
    assert sizes == {"train": 48, "eval": 2}
    back = [json.dumps(r) for name in ("train.jsonl", "eval.jsonl") for r in lines(tmp_path / name)]
    assert sorted(back) == sorted(made)


def test_post_import_job(spark, tmp_path):
    posts = [{"tweet": {"id_str": str(i), "full_text": f"post {i}", "created_at": f"2020-01-{28 - i:02d}"}} for i in range(10)]
    (tmp_path / "data").mkdir()
    (tmp_path / "data/tweets.js").write_text(f"window.x = {json.dumps(posts)}")
    written = jobs.run_post_import(spark, str(tmp_path), str(tmp_path / "posts.jsonl"), eval_pct=0.2)
    assert written == {"train": 8, "eval": 2}
    assert [r["tweet_id"] for r in lines(tmp_path / "posts.jsonl")] == [str(i) for i in range(9, 1, -1)]
    assert [r["tweet_id"] for r in lines(tmp_path / "posts_eval.jsonl")] == ["1", "0"]
    assert set(lines(tmp_path / "posts.jsonl")[0]) == {"tweet_id", "messages"}


def test_thread_import_job(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, "x", "a", "2020"), (2, 1, "me", "b", "2021-01-01")], "i int, p int, n string, b string, d string")
    mapping = {"id": "i", "parent_id": "p", "root_id": "p", "author_nick": "n", "content_body": "b", "created_at": "d"}
    assert jobs.run_thread_import(table, mapping, str(tmp_path / "t.jsonl"), "me") == {"written": 1}
    assert lines(tmp_path / "t.jsonl") == [{
        "thread_id": 1, "post_id": 2, "created_at": "2021-01-01",
        "messages": [{"role": "user", "content": "a"}, {"role": "model", "content": "b"}],
    }]


def test_render_job(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(example("x"))
    assert jobs.run_render(spark, str(tmp_path / "in.jsonl")).first().text == "user: q\nmodel: x"


# --- hot keys ---


@pytest.fixture
def small_skew(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_parent_is_split(spark, small_skew):
    posts = spark.range(60000, numPartitions=8).select(
        F.col("id").cast("string").alias("id_str"), F.concat(F.lit("text "), "id").alias("text"), F.col("id").alias("ord"),
        F.when(F.col("id") % 3 > 0, F.lit("0")).otherwise((F.col("id") - 1).cast("string")).alias("in_reply_to_id"),
    )
    joined = P.reply_dialogs(posts, posts).select("id_str", "messages")
    assert "skew=true" in executed(joined)
    answers = joined.where((F.get("messages", F.lit(0))["content"] == "text 0") & (F.size("messages") == 2))
    assert answers.count() == 40000


def test_hot_keys_in_lookups(spark, small_skew):
    probe = spark.range(60000, numPartitions=8).withColumn("k", F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")))
    build = probe.groupBy("k").agg(F.max("id").alias("top"))
    assert "skew=true" in executed(lookup(probe, build, "k"))
    known = spark.range(10).withColumnRenamed("id", "k")
    assert unseen(probe, known, "k").count() == probe.where("k >= 10").count()


def test_keep_first_cuts_hot_keys_before_the_shuffle(spark):
    rows = spark.range(1000, numPartitions=4).withColumn("k", F.floor(F.col("id") / 1000))
    kept = keep_first(rows, "k", "id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in kept.collect()] == [0]
    assert plan.index("Partial") > plan.index("Exchange")  # below the exchange in the tree


def test_rows_without_a_key_are_spread_and_kept(spark, small_skew):
    probe = spark.range(40000, numPartitions=8).withColumn("k", F.when(F.col("id") < 100, F.col("id")))
    build = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("hit"))
    joined = lookup(probe, build, "k")
    assert joined.count() == 40000 and joined.where("hit = 1").count() == 50
    sizes = [r[0] for r in joined.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").collect()]
    assert max(sizes) < 20000, sizes


def test_columns_named_as_inner_ones_stay(spark):
    probe = spark.createDataFrame([(1, "a", "n", 3), (2, "b", "m", 4)], "k int, _key_hash string, _nth string, _NTH_ int")
    build = spark.createDataFrame([(1, "hit")], "k int, found string")
    joined = lookup(probe, build, "k").orderBy("k").collect()
    assert [(r["_key_hash"], r.found) for r in joined] == [("a", "hit"), ("b", None)]
    assert [r["_nth"] for r in keep_first(probe.unionByName(probe), "k", "_key_hash").orderBy("k").collect()] == ["n", "m"]
    assert free_name("_nth", probe) == "_nth__" and free_name("other", probe, build) == "other"
