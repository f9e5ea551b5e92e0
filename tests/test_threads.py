import random

import pytest

from talkloom.operators import threads as T

MAPPING = {
    "id": "id", "parent_id": "parent", "root_id": "root", "author_nick": "nick", "content_body": "body",
    "content_title": "title", "created_at": "at",
}


def forum(spark, rows):
    """Rows (id, parent, nick, title, body)."""
    data = [(i, p, 1, n, t, b, f"2020-01-01 00:00:{i % 60:02d}") for i, p, n, t, b in rows]
    table = spark.createDataFrame(data, "id long, parent long, root long, nick string, title string, body string, at string")
    return T.map_threads(table, MAPPING)


def chain_of(parents, node):
    """Brute force: node and its ancestors, nearest first."""
    seen = [node]
    while (up := parents.get(seen[-1])) and up in parents and up not in seen:
        seen.append(up)
    return seen


def context_of(rows, node, nick, limit, strip):
    parents = {i: p for i, p, *_ in rows}
    by_id = {r[0]: r for r in rows}
    up = [by_id[i] for i in chain_of(parents, node)[1:]]
    if strip:
        up = [r for r in up if (r[2] or "") != nick]
    if limit > 0:
        up = up[:limit]
    texts = [f"{r[3] or ''}\n\n{r[4] or ''}".strip() for r in reversed(up)]
    return [t for t in texts if t]


def expected(rows, nick, limit, strip):
    out = {}
    for i, _, who, title, body in rows:
        answer = f"{title or ''}\n\n{body or ''}".strip()
        context = context_of(rows, i, nick, limit, strip)
        if (who or "") == nick and answer and context:
            out[i] = [("user", t) for t in context] + [("model", answer)]
    return out


FIXED = [
    (1, 0, "x", "T", "one"), (2, 1, "me", None, "two"), (3, 2, "y", "", " "), (4, 3, "me", None, "four"),
    (5, 5, "me", None, "self"), (6, 7, "me", None, "six"), (7, 6, "z", None, "seven"), (8, 99, "me", None, "lost"),
    (9, 4, "me", None, None), (10, 9, None, None, "ten"), (11, 10, "me", None, "eleven"), (12, None, "me", None, "root"),
]


@pytest.mark.parametrize("hops", [None, 2, 40])
def test_chains(spark, hops):
    parents = {i: p for i, p, *_ in FIXED}
    got = {r.id: r.chain for r in T.ancestor_chains(forum(spark, FIXED), hops).collect()}
    cut = None if hops is None else hops + 1
    assert got == {i: chain_of(parents, i)[:cut][::-1] for i in parents}


@pytest.mark.parametrize("limit", [0, 1, 2, 8, 20])
@pytest.mark.parametrize("strip", [False, True])
def test_examples(spark, limit, strip):
    got = T.thread_examples(forum(spark, FIXED), "me", limit, strip).collect()
    assert {r.post_id: [tuple(m) for m in r.messages] for r in got} == expected(FIXED, "me", limit, strip)
    assert {r.thread_id for r in got} == {1}


@pytest.mark.parametrize("seed", range(3))
def test_random_reply_graphs(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice([0, i, rng.randint(1, 60), rng.randint(1, 60), max(i - 1, 0)]), rng.choice(["me", "me", "x"]), None, f"t{i}")
        for i in range(1, 51)
    ]
    table = forum(spark, rows)
    parents = {i: p for i, p, *_ in rows}
    assert {r.id: r.chain for r in T.ancestor_chains(table).collect()} == {i: chain_of(parents, i)[::-1] for i in parents}
    got = T.thread_examples(table, "me", 2, True).collect()
    assert {r.post_id: [tuple(m) for m in r.messages] for r in got} == expected(rows, "me", 2, True)


def test_deep_chain(spark):
    rows = [(i, i - 1, "me" if i == 300 else "x", None, f"t{i}") for i in range(1, 301)]
    table = forum(spark, rows)
    full = T.thread_examples(table, "me", 0).first()
    assert [m.content for m in full.messages] == [f"t{i}" for i in range(1, 301)]
    capped = T.thread_examples(table, "me", 20).first()
    assert [m.content for m in capped.messages] == [f"t{i}" for i in range(280, 301)]


def test_mapping_is_checked(spark):
    table = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        T.map_threads(table, {"id": "id"})
    with pytest.raises(ValueError):
        T.thread_examples(forum(spark, FIXED), "")


def test_unmapped_texts_and_unreadable_dates(spark):
    table = spark.createDataFrame(
        [("b", "a", "r", "me", "x", "2020-01-01"), ("a", "", "r", "y", "w", "junk")],
        "id string, parent string, root string, nick string, body string, at string",
    )
    threads = T.map_threads(table, {k: v for k, v in MAPPING.items() if k != "content_title"})
    assert [r.id for r in threads.orderBy("ord").collect()] == ["a", "b"]
    row = T.thread_examples(threads, "me").first()
    assert [tuple(m) for m in row.messages] == [("user", "w"), ("model", "x")]
