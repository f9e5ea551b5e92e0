"""Quality rules by weak supervision.

Each rule looks at a few figures of a document and votes good, bad, or abstains. No
rule is trusted beforehand: expectation-maximisation estimates from the votes alone
how often each is right on good and on bad documents, and the posterior probability
of good takes the place of a filter that all rules must pass.

Everything is built-in expressions. The votes of all documents are counted by pattern
(at most three votes to the power of the rules), and each EM step is one aggregation
over that small table.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.operators.once import compute_once
from talkloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters, apostrophes and hyphens, with at most one mark behind it.
PLAIN = r"(?<![^\x20\x09-\x0D])[\p{L}'\u2019-]+[.,;:!?]?(?![^\x20\x09-\x0D])"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
STEPS = 25
#: Before any vote is seen: the share of good documents, and how often a rule is right.
PRIOR, ACCURACY = 0.8, 0.8
#: Each accuracy starts with the weight of so much of all documents.
PSEUDO = 0.02


class Rule(NamedTuple):
    name: str
    good: str
    bad: str


NEVER = "false"
#: Conditions on the figures of a document; a rule of which neither holds abstains. Most
#: rules know one kind of bad text only and have nothing to say about the others.
RULES = (
    Rule("length", "n_words >= 40", "n_words < 25"),
    Rule("plain", "20 * n_plain >= 17 * n_words", "20 * n_plain < 13 * n_words"),
    Rule("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("stops", "2 * n_stops >= n_lines", "10 * n_stops < n_lines"),
    Rule("lines", NEVER, "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", NEVER, "5 * n_repeat_words > n_words"),
    Rule("word_length", NEVER, "word_chars NOT BETWEEN 2 * n_words AND 14 * n_words"),
    Rule("capitals", NEVER, "2 * n_capitals > word_chars"),
    Rule("digits", NEVER, "4 * n_digits > word_chars"),
)


def _paired(hashes: Column, step: int) -> Column:
    """Each hash together with the one ``step`` places behind it."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def _repeat_words(windows: Column) -> Column:
    """Words within windows that occur twice or more, from the windows' hashes sorted as (hash, position)."""
    def repeated(window: Column, at: Column) -> Column:
        same = lambda other: F.get(windows, other)["hash"] == window["hash"]
        return F.coalesce(same(at - 1), F.lit(False)) | F.coalesce(same(at + 1), F.lit(False))

    positions = F.sort_array(F.transform(F.filter(windows, repeated), lambda w: w["at"]))
    # A window adds the words that the window before it has not reached.
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        positions, start,
        lambda seen, at: F.struct((seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n"), at.alias("last")),
        lambda seen: seen["n"])


def figures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the figures the rules look at, all of the whole text; a null text counts as empty.

    Windows of eight words are compared by 64-bit hashes built from their words' hashes.
    """
    df = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = compute_once(df, "_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    df = compute_once(df, "_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    without = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    df = df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - without(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (F.length("_text") - without("[A-Z]")).cast("long").alias("n_capitals"),
        (F.length("_text") - without("[0-9]")).cast("long").alias("n_digits"),
        F.size(F.filter("_lines", lambda line: F.right(F.rtrim(line), F.lit(1)).isin(".", "!", "?", ":")))
        .cast("long").alias("n_stops"),
        F.regexp_count("_text", F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_hashes"),
    )
    df = compute_once(df, "_hashes", F.col("_hashes"))
    # Hashes of pairs, then of pairs of pairs, then of windows of eight words.
    reach = 1
    while reach < WINDOW:
        df = compute_once(df, "_hashes", _paired(F.col("_hashes"), reach))
        reach *= 2
    df = compute_once(df, "_hashes", F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))))
    # Most texts repeat nothing; only the others' windows are sorted.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    in_order = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    df = compute_once(df, "_hashes", F.when(repeats, in_order))
    return df.withColumn(
        "n_repeat_words", F.coalesce(_repeat_words(F.col("_hashes")), F.lit(0)).cast("long")).drop("_hashes")


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One column per rule: 1 good, 0 bad, null abstained."""
    return [F.when(F.expr(r.good), 1).when(F.expr(r.bad), 0).alias(f"vote_{r.name}") for r in rules]


class Accuracies(NamedTuple):
    prior: float
    on_good: list[float]
    on_bad: list[float]


def _posterior(names: list[str], model: Accuracies) -> Column:
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, good, bad in zip(names, model.on_good, model.on_bad):
        odds = odds + F.coalesce(
            F.when(F.col(name) == 1, math.log(good / (1 - bad))).when(F.col(name) == 0, math.log((1 - good) / bad)), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _em_step(patterns: str, rules: int, model: Column) -> Column:
    """One EM step on the column ``patterns`` (votes, n): model (prior, on_good, on_bad) to the next one."""
    each = range(rules)

    def share_good(model: Column) -> Column:
        def of_pattern(p: Column) -> Column:
            odds = F.log(model["prior"] / (1 - model["prior"]))
            for j in each:
                good, bad, vote = model["on_good"][j], model["on_bad"][j], p["votes"][j]
                odds = odds + F.coalesce(
                    F.when(vote == 1, F.log(good / (1 - bad))).when(vote == 0, F.log((1 - good) / bad)), F.lit(0.0))
            return F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] / (1 + F.exp(-odds))).alias("good"))

        return F.transform(patterns, of_pattern)

    def following(shares: Column) -> Column:
        pseudo = PSEUDO * _sum(F.transform(shares, lambda p: p["n"]))

        def right(j: int, vote: int, mass) -> Column:
            cast = _sum(F.transform(shares, lambda p: F.when(p["votes"][j].isNotNull(), mass(p)).otherwise(0.0)))
            hits = _sum(F.transform(shares, lambda p: F.when(p["votes"][j] == vote, mass(p)).otherwise(0.0)))
            return (hits + ACCURACY * pseudo) / (cast + pseudo)

        total = pseudo / PSEUDO
        return F.struct(
            ((_sum(F.transform(shares, lambda p: p["good"])) + PRIOR * pseudo) / (total + pseudo)).alias("prior"),
            F.array(*[right(j, 1, lambda p: p["good"]) for j in each]).alias("on_good"),
            F.array(*[right(j, 0, lambda p: p["n"] - p["good"]) for j in each]).alias("on_bad"))

    return _let(share_good(model), following)


def accuracies(voted: DataFrame, names: list[str], steps: int = STEPS) -> Accuracies:
    """What expectation-maximisation makes of the votes in ``voted``; the given start without any rows.

    The counted patterns are one array, and all steps one expression over it.
    """
    counted = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    gathered = counted.select(F.struct(F.array(*names).alias("votes"), "n").alias("p")).agg(
        F.sort_array(F.collect_list("p")).alias("patterns"))
    level = F.array(*[F.lit(ACCURACY)] * len(names))
    start = F.struct(F.lit(PRIOR).alias("prior"), level.alias("on_good"), level.alias("on_bad"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda m, _: _em_step("patterns", len(names), m))
    row = gathered.where(F.size("patterns") > 0).select(model.alias("model")).first()
    return Accuracies(*row["model"]) if row else Accuracies(PRIOR, [ACCURACY] * len(names), [ACCURACY] * len(names))


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
          threshold: float = 0.5) -> DataFrame:
    """doc_id, the figures, base_failed, quality and kept for every row.

    base_failed: under 20 words, or more than 30 % of them in repeated windows. quality is
    the posterior probability of good; kept needs at least ``threshold`` of it. Rows with
    the same id are judged each by its own text.
    """
    found = materialise(figures(documents, doc_id, text), "quality_figures")
    names = [f"vote_{r.name}" for r in rules]
    model = accuracies(found.where("n_words > 0").select(*votes(rules)), names)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    judged = found.select("*", *votes(rules), failed.alias("base_failed")).withColumn(
        "quality", F.round(_posterior(names, model), 9))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names)
