import json
import sqlite3

import pytest

from talkloom.operators.posts import unify_posts
from talkloom.plans import jobs
from talkloom.sources import jsonl
from talkloom.sources.api_pages import read_api_pages
from talkloom.sources.archive import read_post_archive
from talkloom.sources.sqlite import read_sqlite


def example(n, **more):
    return json.dumps({"messages": [{"role": "user", "content": f"q{n}"}, {"role": "model", "content": f"a{n} é"}], **more}, ensure_ascii=False)


def test_malformed_lines_are_left_out(spark, tmp_path):
    lines = [
        example(1, created_at="t", extra={"a": 1}), "", "   ", "not json", "[1]", '"text"', "7", example(2)[:-1],
        "{'messages': []}", '{"messages": "text"}', '{"created_at": "x"}', example(3, created_at=5),
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows = jsonl.read_examples(spark, str(tmp_path / "in.jsonl")).orderBy("ord").collect()
    assert [(r.created_at, r.messages and r.messages[1].content) for r in rows] == [("t", "a1 é"), ("x", None), ("5", "a3 é")]
    assert {r.source_file for r in rows} == {"in.jsonl"}


def test_order_is_input_order_however_files_are_split(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(example(f"{name}{i}") for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = jsonl.read_examples(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")])
        got = [r.messages[0].content for r in rows.repartition(3).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"q{n}{i}" for n in "ba" for i in range(200)]


def test_default_inputs(spark, tmp_path):
    for name in ("posts", "posts_eval", "train", "my_training", "eval", "unified"):
        (tmp_path / f"{name}.jsonl").write_text(example(name))
    (tmp_path / "other.txt").write_text(example(0))
    jsonl.write_examples(jsonl.read_examples(spark, str(tmp_path / "posts.jsonl")), str(tmp_path / "folder.jsonl"))
    rows = jsonl.read_dataset_folder(spark, str(tmp_path), str(tmp_path / "unified.jsonl"))
    assert sorted(r.source_file for r in rows.collect()) == ["eval.jsonl", "folder.jsonl", "posts.jsonl"]
    assert {p.rsplit("/", 2)[-2] for p in rows.inputFiles()} == {tmp_path.name, "folder.jsonl"}


def test_existing_ids(spark, tmp_path):
    (tmp_path / "out.jsonl").write_text('{"tweet_id": "1"}\n{"tweet_id": 2}\nbad\n{"x": 1}\n[3]\n{"tweet_id": "1"}\n')
    assert sorted(r[0] for r in jsonl.existing_ids(spark, str(tmp_path / "out.jsonl")).collect()) == ["1", "2"]


def archive_file(path, items):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"window.x.part0 = {json.dumps(items, ensure_ascii=False, indent=1)};\n")


def test_archive(spark, tmp_path):
    archive_file(tmp_path / "data/tweets.js", [{"tweet": {"id_str": "1", "full_text": "a ] [ b", "is_quote_status": True}}, {"id": 2, "text": "é"}])
    archive_file(tmp_path / "data/tweets/part1.js", [{"tweet": {"id": "3", "full_text": "c", "in_reply_to_status_id": 1}}])
    archive_file(tmp_path / "data/other.js", [{"id": 9}])
    posts = unify_posts(read_post_archive(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(p.id_str, p.text, p.is_quote, p.in_reply_to_id) for p in posts] == [
        ("3", "c", False, "1"), ("1", "a ] [ b", True, ""), ("2", "é", False, ""),
    ]
    assert read_post_archive(spark, str(tmp_path / "data/other.js")).count() == 1


def test_archive_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_post_archive(spark, str(tmp_path))
    (tmp_path / "bad.js").write_text("x = [ {]")
    with pytest.raises(Exception, match="MALFORMED"):
        read_post_archive(spark, str(tmp_path / "bad.js")).collect()


def test_api_pages(spark, tmp_path):
    post = lambda i, at, kind=None: {
        "id": str(i), "text": f"t{i}", "created_at": at, "referenced_tweets": [{"type": kind, "id": "0"}] if kind else None,
    }
    pages = [
        {"data": [post(1, "2024-01-01T00:00:00.000Z"), post(2, "2024-01-02T00:00:00.000Z")], "meta": {"next_token": "x"}},
        {"data": [post(3, "2024-01-03T00:00:00Z", "replied_to"), post(4, "2024-01-03T00:00:00Z", "retweeted"), post(5, None, "quoted")]},
        {"meta": {}},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in pages))
    ids = lambda **o: [r.id for r in read_api_pages(spark, str(tmp_path), **o).orderBy("ord").collect()]
    assert ids() == ["1", "2", "3", "5"]
    assert ids(start_time="2024-01-02T00:00:00Z", include_replies=False) == ["2", "5"]


def test_sqlite_ranges(spark, tmp_path):
    path = str(tmp_path / "forum.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE msgs (id INTEGER PRIMARY KEY, parent INTEGER, body TEXT, score REAL)")
        con.executemany("INSERT INTO msgs VALUES (?, ?, ?, ?)", [(i * 3, i if i % 2 else None, f"b{i}", i / 2) for i in range(100)])
        con.execute("CREATE TABLE empty (x TEXT)")
    con.close()
    rows = read_sqlite(spark, path, "msgs", numPartitions="7")
    assert rows.dtypes == [("id", "bigint"), ("parent", "bigint"), ("body", "string"), ("score", "double")]
    assert rows.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, rows.collect())) == [(i * 3, i if i % 2 else None, f"b{i}", i / 2) for i in range(100)]
    assert read_sqlite(spark, path, "msgs", partitionColumn="parent", numPartitions="3").count() == 100
    assert read_sqlite(spark, path, "empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        read_sqlite(spark, path, "nope")


def test_written_lines_are_unescaped_json_without_internals(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(example(1))
    jsonl.write_examples(jsonl.read_examples(spark, str(tmp_path / "in.jsonl")), str(tmp_path / "out.jsonl"))
    text = spark.read.text(str(tmp_path / "out.jsonl")).first()[0]
    assert "a1 é" in text and set(json.loads(text)) == {"messages"}


@pytest.mark.parametrize("line", [
    '{"a": {"x": 1, "x": 2.50}, "b":NaN , "c": "q\\u00e9\\"", "a": [1,2 ], "n":null}', "{}", " { } behind", '{"a":1234567890123456789012345678901234567890}',
    '{"a": -0.0, "b": 1e400, "c": "", "d": {"}": "]"}, "\\u0061b": true}',
])
def test_raw_members(line):
    names = ["a", "b", "c", "n", "ab", "absent"]
    found = dict(zip(names, jsonl.raw_members(line, names)))
    plain = json.JSONDecoder().raw_decode(line.strip())[0]
    for name in names:
        assert (found[name] is None) == (name not in plain)
        if found[name] is not None:
            assert found[name] in line and repr(json.loads(found[name])) == repr(plain[name])


def test_kept_values_pass_as_they_stand(spark, tmp_path):
    values = ['{"a":1,"a":2}', "NaN", "1" * 5000, "-0.0", "1.50", '"5"', '"2024-01-01"', '"{\\"x\\"}"', "null", "true", '"true"', '"tab\\tquote\\""', "[1, 2]",
              "[" * 300 + "]" * 300]
    lines = [json.dumps({"messages": [{"role": "user", "content": f"q{i}"}, {"role": "model", "content": f"a{i}"}]})[:-1] + f', "k": {v}}}' for i, v in enumerate(values)]
    lines.append(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "model", "content": "no key"}]}))
    lines += ["cut {", "[1]"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    jobs.run_unify(spark, [str(tmp_path / "in.jsonl")], str(tmp_path / "out.jsonl"), keep=["messages", "k"], shuffle=False, rejects=str(tmp_path / "rejects"))
    out = [line for part in sorted((tmp_path / "out.jsonl").glob("part-*")) for line in part.read_text().splitlines()]
    kept = [line.split('],"k":')[1][:-1] if '],"k":' in line else None for line in out]
    assert kept == [*values, None]
    rejects = [json.loads(line) for part in (tmp_path / "rejects").glob("part-*") for line in part.read_text().splitlines()]
    assert sorted((r["reason"], r["value"], r["source_file"]) for r in rejects) == [("malformed", "cut {", "in.jsonl"), ("no object", "[1]", "in.jsonl")]


def test_malformed_pages_are_put_aside_before_the_mark_moves(spark, tmp_path):
    post = {"id": "1", "text": "long enough to be kept", "created_at": "2024-01-01T00:00:00.000Z"}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/a.json").write_text(json.dumps({"data": [post]}) + '\n{"data": [{"id": "2", "text": "cut off but long enough"}, {\n')
    at = lambda name: str(tmp_path / name)
    with pytest.raises(Exception, match="MALFORMED"):
        jobs.run_post_sync(spark, at("pages"), at("posts.jsonl"), at("state0"))
    for _ in range(2):
        jobs.run_post_sync(spark, at("pages"), at("posts.jsonl"), at("state"), rejects=at("rejects"))
    rows = spark.read.json(at("rejects"), recursiveFileLookup=True).distinct().collect()
    assert [(r.reason, r.value) for r in rows] == [("malformed", '{"data": [{"id": "2", "text": "cut off but long enough"}, {')]
    assert [r.tweet_id for r in spark.read.json(at("posts.jsonl"), recursiveFileLookup=True).collect()] == ["1"]
