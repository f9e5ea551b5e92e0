import json
import sqlite3

import pytest

from talkloom.__main__ import run
from talkloom.sources import jsonl


def test_from_sources_to_training_text(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    posts = [{"tweet": {"id_str": str(i), "full_text": f"post number {i}", "created_at": f"2020-01-{i + 1:02d}"}} for i in range(8)]
    (tmp_path / "archive.js").write_text(f"x = {json.dumps(posts)}")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("A paragraph about cats.\n\nAnother one about dogs.")
    with sqlite3.connect(at("forum.db")) as con:
        con.execute("CREATE TABLE m (id INTEGER, up INTEGER, root INTEGER, nick TEXT, body TEXT, day TEXT)")
        con.executemany("INSERT INTO m VALUES (?, ?, 1, ?, ?, '2020-01-01')", [(1, 0, "x", "question"), (2, 1, "me", "answer")])
    con.close()
    columns = {"id": "id", "parent_id": "up", "root_id": "root", "author_nick": "nick", "content_body": "body", "created_at": "day"}
    (tmp_path / "map.json").write_text(json.dumps({"schema_mapping": {"table_name": "m", "column_names": columns}}))

    run(spark, ["posts-import", at("archive.js"), at("dataset/posts.jsonl"), "--eval-pct", "0.25"])
    run(spark, ["docs-import", at("docs"), at("dataset/docs.jsonl"), at("state/docs"), "--min-chars", "5", "--lang", "en"])
    run(spark, ["sql-import", at("forum.db"), at("dataset/threads.jsonl"), "--mapping", at("map.json"), "--nick", "me"])
    run(spark, ["unify", at("dataset/unified.jsonl"), "--folder", at("dataset"), "--keep", "messages,created_at,lang"])
    run(spark, ["split-eval", at("dataset/unified.jsonl"), at("train.jsonl"), at("eval.jsonl"), "--eval-pct", "0.2"])
    run(spark, ["render", at("train.jsonl"), at("texts")])

    told = capsys.readouterr().out
    assert "{'train': 6, 'eval': 2}" in told and "{'appended': 2}" in told and "{'written': 1}" in told
    assert "{'train': 7, 'eval': 2}" in told
    assert jsonl.read_examples(spark, at("dataset/unified.jsonl")).count() == 9
    assert spark.read.json(at("texts")).where("text like 'user: %'").count() == 7


def test_landed_pages_as_batch_and_stream(spark, tmp_path, capsys):
    (tmp_path / "pages").mkdir()
    post = {"id": "1", "text": "long enough text", "created_at": "2024-01-01T00:00:00Z", "source": "web"}
    (tmp_path / "pages/a.json").write_text(json.dumps({"data": [post, {**post, "id": "2", "source": "bot"}]}))
    paths = [str(tmp_path / name) for name in ("pages", "out.jsonl", "state")]
    run(spark, ["posts-sync", *paths, "--exclude-sources", "bot, x"])
    assert "{'appended': 1}" in capsys.readouterr().out
    run(spark, ["posts-sync", *paths, "--checkpoint", str(tmp_path / "c")])
    assert jsonl.existing_ids(spark, paths[1]).count() == 2


def test_incomplete_mapping(spark, tmp_path):
    (tmp_path / "map.json").write_text("{}")
    with pytest.raises(SystemExit):
        run(spark, ["sql-import", "x.db", "out", "--mapping", str(tmp_path / "map.json"), "--nick", "me"])
