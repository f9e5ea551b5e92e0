"""Archive files of any size: cut into blocks of a few bytes, against the files read whole."""

import json
import random

import numpy as np
import pytest

from talkloom.sources import archive as A


@pytest.fixture
def blocks(spark):
    """Sets the size of the blocks files are read in."""

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size))

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def nasty(rng):
    parts = ["a", "}", "{", "]", "[", "\"", "\\", ", ", "é", "日", "\n", "}}}", '\\"', "\\\\", "x" * 30]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))


def post(rng, i):
    item = {"id_str": str(i), "full_text": nasty(rng), "lang": rng.choice(["en", None]), "more": {"deep": [{"x": nasty(rng)}, []]}}
    return {"tweet": item} if rng.random() < 0.5 else item


def plain_advance(data, mode, depth):
    ends, closed = [], -1
    for i, c in enumerate(data):
        c = chr(c)
        if mode == A.BEFORE:
            if c == "[":
                mode, depth = A.OUTSIDE, depth + 1
        elif mode == A.ESCAPED:
            mode = A.STRING
        elif mode == A.STRING:
            mode = A.ESCAPED if c == "\\" else A.OUTSIDE if c == '"' else A.STRING
        elif c == '"':
            mode = A.STRING
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if c == "}" and depth == 1:
                ends.append(i + 1)
            if depth == 0 and closed < 0:
                closed = i + 1
    return A.State(mode, depth), ends, closed


@pytest.mark.parametrize("seed", range(20))
def test_states_of_pieces(seed):
    rng = random.Random(seed)
    data = ("x = " + json.dumps([post(rng, i) for i in range(8)], indent=rng.choice([None, 1])) + ";\n").encode()
    at, walked = 0, A.State()
    while at < len(data):
        # On from here in one go, and in a piece of a few bytes.
        for piece in (data[at:], data[at:at + rng.randrange(1, 9)]):
            after, ends, closed = A.advance(piece, walked)
            assert (after, ends.tolist(), closed) == plain_advance(piece, *walked)
        at, walked = at + len(piece), after
    assert walked == A.State(A.OUTSIDE, 0) and A.advance(b"", walked)[0] == walked


@pytest.mark.parametrize("size", [150, 1500, 1 << 20])
def test_items_across_block_borders(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    expected = []
    for name, indent, count in (("data/tweets.js", 1, 6), ("data/tweets/b.js", None, 5), ("data/tweets/a.js", 3, 1), ("data/tweets/none.js", None, 0)):
        items = [post(rng, 100 * len(name) + i) for i in range(count)]
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        text = json.dumps(items, indent=indent, ensure_ascii=rng.random() < 0.5)
        path.write_text(f"window.x{{part0}} = {text}" + rng.choice(["", ";\n", "\n\n"]))
        expected.append((name.split("/"), [i.get("tweet", i) for i in items]))
    blocks(size)
    found = A.read_post_archive(spark, str(tmp_path)).orderBy("ord").collect()
    in_order = [i for _, items in sorted(expected) for i in items]
    assert [(r.id_str, r.full_text, r.lang) for r in found] == [(i["id_str"], i["full_text"], i["lang"]) for i in in_order]


def test_a_post_longer_than_many_blocks_and_bytes_that_are_no_utf8(spark, tmp_path, blocks):
    text = '{"id_str": "1", "full_text": "' + "long } " * 50 + '"}'
    (tmp_path / "a.js").write_bytes(b"\xff = [" + text.encode() + b',{"id_str": "2", "full_text": "a\xffb"}]')
    blocks(60)
    found = A.read_post_archive(spark, str(tmp_path / "a.js")).orderBy("ord").collect()
    assert [(r.id_str, r.full_text) for r in found] == [("1", "long } " * 50), ("2", "ab")]


@pytest.mark.parametrize("size", [5, 1 << 20])
@pytest.mark.parametrize("text", [
    "x = [ {]", "x = 1", "[{}", "[{} {}]", "[{},]", "[,{}]", "[1]", "[{}, 1]", '[{"a": "]', "[{}] ]", '[{"a": tru}]', "[[{}]", '[{"a": 1},,{}]', "[1, {}]"])
def test_malformed_files(spark, tmp_path, blocks, text, size):
    (tmp_path / "bad.js").write_text(text)
    blocks(size)
    with pytest.raises(Exception, match="MALFORMED"):
        A.read_post_archive(spark, str(tmp_path / "bad.js")).collect()


def test_no_item_text_is_shuffled(spark, tmp_path):
    (tmp_path / "a.js").write_text(json.dumps([{"id_str": str(i)} for i in range(50)]))
    plan = A.read_post_archive(spark, str(tmp_path / "a.js"))._jdf.queryExecution().executedPlan().toString()
    # Only fragments, which are read by their kind, go through exchanges.
    for part in plan.split("Exchange")[1:]:
        assert "whole" in part.split("Scan", 1)[1]


def test_advance_takes_numpy_ends():
    state, ends, closed = A.advance(b'[{"a": "}"}, {}] ', A.State())
    assert (state, ends.tolist(), closed) == (A.State(A.OUTSIDE, 0), [11, 15], 16) and ends.dtype == np.int64
