import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from talkloom.functions import messages as M
from talkloom.operators.examples import dedup_examples, drop_generic, normalize_examples, repair_roles
from talkloom.operators.quality import quality_report, source_composition, turn_histogram, example_measures, turn_measures, report
from talkloom.operators.turns import clean_turns, merge_turns, repair_turns, turn_keys

ROLES = {"s": "system", "u": "user", "a": "assistant"}


def examples(spark, dialogs):
    rows = [(i, [(ROLES.get(r, r), t) for r, t in d], f"f{i % 2}.jsonl") for i, d in enumerate(dialogs)]
    return spark.createDataFrame(rows, f"ord int, messages {M.MESSAGES}, source_file string")


def turns(spark, dialogs):
    rows = [(i, n, ROLES.get(r, r), t) for i, d in enumerate(dialogs) for n, (r, t) in enumerate(d)]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")


def dialogs_of(df):
    return {r.ord: [(m.role, m.content) for m in r.messages] for r in df.select("ord", "messages").collect()}


def dialogs_of_turns(df):
    out = {}
    for r in df.orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.content))
    return out


def expected_repair(dialog):
    """Brute force on one dialog, straight from the rules."""
    runs = [(role, [t for _, t in run]) for role, run in itertools.groupby(dialog, key=lambda m: m[0])]
    chat = [(ROLES[r], "\n\n".join(t for t in texts if t) if len(texts) > 1 else texts[0]) for r, texts in runs]
    if chat and chat[0][0] == "assistant":
        chat = [("user", "..."), *chat]
    if chat and chat[-1][0] != "assistant":
        chat = chat[:-1]
    system, rest = (chat[:1], chat[1:]) if chat and chat[0][0] == "system" else ([], chat)
    wanted = ["user", "assistant"] * (len(rest) // 2)
    return system + rest if rest and [r for r, _ in rest] == wanted else None


TABLE = {
    "": None, "a": "ua", "u": None, "ua": "ua", "uau": "ua", "aua": "uaua", "sua": "sua", "su": None, "sa": None,
    "usa": None, "us": None, "uasa": None, "uaus": None,
}


@pytest.mark.parametrize("form", ["array", "turns"])
def test_role_repair_truth_table(spark, form):
    dialogs = [[(r, f"{r}{n}") for n, r in enumerate(shape)] for shape in TABLE]
    if form == "array":
        got = dialogs_of(repair_roles(examples(spark, dialogs)))
    else:
        got = dialogs_of_turns(repair_turns(turns(spark, dialogs)))
    shapes = {i: "".join(r[0] for r, _ in d) for i, d in got.items()}
    assert shapes == {i: want for i, want in enumerate(TABLE.values()) if want}


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_both_forms_equal_brute_force(spark, block):
    shapes = ["".join(p) for n in range(6) for p in itertools.product("sua", repeat=n)]
    dialogs = [[(r, "" if (n + i) % 5 == 0 else f"{r}{n}") for n, r in enumerate(s)] for i, s in enumerate(shapes)]
    want = {i: e for i, d in enumerate(dialogs) if (e := expected_repair(d))}
    assert dialogs_of_turns(repair_turns(turns(spark, dialogs), block=block)) == want
    if block == 1:
        assert dialogs_of(repair_roles(examples(spark, dialogs))) == want


def test_merge_joins_with_a_blank_line(spark):
    rows = examples(spark, [[("u", "a"), ("u", "b"), ("a", "c")]])
    merged = rows.select(M.merge_runs(F.col("messages"))).first()[0]
    assert [(m.role, m.content) for m in merged] == [("user", "a\n\nb"), ("assistant", "c")]
    runs = merge_turns(turns(spark, [[("u", "a"), ("u", "b"), ("a", "c")]])).orderBy("turn").collect()
    assert [(r.turn, r.role, r.content) for r in runs] == [(0, "user", "a\n\nb"), (2, "assistant", "c")]


def test_clean_messages(spark):
    dialog = [(" Model ", "<b>x</b> &amp;"), ("bot", " "), (None, "q"), ("u", ""), ("SYSTEM", None), ("assistant", "z")]
    rows = spark.createDataFrame([(dialog,)], f"messages {M.MESSAGES}")
    got = rows.select(M.clean_messages(F.col("messages"))).first()[0]
    assert [tuple(m) for m in got] == [("assistant", "x &"), ("user", ""), ("user", "q"), ("assistant", "z")]


@pytest.mark.parametrize("form", ["array", "turns"])
def test_repost_filter_looks_at_the_last_message_only(spark, form):
    dialogs = [
        [("u", "q"), ("a", "RTX cards")],
        [("u", "q"), ("a", "rt x"), ("u", "more")],
        [("u", "q"), ("a", "one"), ("a", "Rt two")],
        [("u", "q"), ("a", "rt one"), ("a", "two")],
    ]
    if form == "array":
        got = dialogs_of(normalize_examples(examples(spark, dialogs)))
    else:
        got = dialogs_of_turns(repair_turns(clean_turns(turns(spark, dialogs))))
    assert sorted(got) == [1, 3]
    assert got[1] == [("user", "q"), ("assistant", "rt x")]


def test_generic_prompts(spark):
    rows = spark.createDataFrame([("Write a tweet in my style.",), ("...",), ("Please write a",)], "p string")
    assert [r[0] for r in rows.select(M.is_generic_prompt(F.col("p"))).collect()] == [True, True, False]


def test_dropped_generic_row_does_not_claim_its_answer(spark):
    rows = examples(spark, [[("u", "..."), ("a", "same")], [("u", "real question"), ("a", "same")]])
    clean = normalize_examples(rows)
    assert sorted(dialogs_of(dedup_examples(clean))) == [0]
    assert sorted(dialogs_of(dedup_examples(drop_generic(clean)))) == [1]


def test_dialog_key(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = examples(spark, [
        [("u", "q"), ("a", "a <b> C")], [("u", "q"), ("a", "a c")], [("u", "x"), ("model", "a\n\nC"), ("u", "z")],
        [("u", "P <i>"), ("s", "q")],
    ])
    keys = [r[0] for r in rows.orderBy("ord").select(M.dialog_key(F.col("messages"))).collect()]
    assert keys == [sha("a c"), sha("a c"), sha("a c"), sha("p q")]


def test_keep_keys(spark):
    rows = examples(spark, [[("u", "q"), ("a", "x")]]).withColumn("lang", F.lit("en")).withColumn("created_at", F.lit("t"))
    assert sorted(normalize_examples(rows).columns) == ["created_at", "messages", "ord", "source_file"]
    assert "lang" in normalize_examples(rows, ["messages", "lang", "absent"]).columns


def test_quality_report(spark):
    dialogs = [
        [("u", "..."), ("a", "12345")],
        [("u", "ab"), ("a", "1"), ("u", "Write a x"), ("a", "2")],
        [("u", "abc"), ("a", "1"), ("u", "d"), ("a", "")],
    ]
    rows = examples(spark, dialogs)
    got = quality_report(rows).first()
    assert got.total_examples == 3
    assert [got.single_turn_pct, got.multi_turn_pct, got.generic_prompt_pct] == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert [got.avg_prompt_len, got.avg_response_len] == pytest.approx([18 / 3, 8 / 3])
    assert got.generic_warning is True
    assert report(turn_measures(turns(spark, dialogs))).first() == got
    assert {r.source_file: r.share for r in source_composition(rows).collect()} == pytest.approx({"f0.jsonl": 2 / 3, "f1.jsonl": 1 / 3})
    assert {r.user_turns: r.examples for r in turn_histogram(example_measures(rows)).collect()} == {1: 1, 2: 2}
    assert quality_report(rows.where("false")).count() == 0


def test_turn_keys_equal_dialog_keys(spark):
    dialogs = [[("u", "q"), ("a", "X <b>"), ("u", "r"), ("a", "y &amp; Z")], [("u", "q"), ("a", "only")]]
    arrays = examples(spark, dialogs).select("ord", M.dialog_key(F.col("messages"), repaired=True).alias("k"))
    assert {r.conv_id: r.dedup_key for r in turn_keys(turns(spark, dialogs)).collect()} == {r.ord: r.k for r in arrays.collect()}


def test_render_chat(spark):
    rows = spark.createDataFrame([([("user", "q"), (None, None)],), (None,)], f"messages {M.MESSAGES}")
    assert [r[0] for r in rows.select(M.render_chat(F.col("messages"))).collect()] == ["user: q\nuser: ", ""]
    tagged = M.render_chat(F.col("messages"), "<{role}>{content}</>", "")
    assert rows.select(tagged).first()[0] == "<user>q</><user></>"
