"""Line dedup by a deletion-neighbourhood join.

Two lines are the same when they are equal but for white space at their ends, or within
one edit: a character inserted, removed or exchanged. Of all such lines the earliest
stays, in the order of doc_id and line number.

Equal lines are counted first, and only distinct lines go on. Lines within one edit of
each other have one half in common, so that lines without such a partner are out. The
others emit their deletion neighbourhood as hashed keys: the line itself, and the line
without one character, for each of its characters. Lines meet at equal keys; each is
compared with the earliest line there, never with all.

Only built-in expressions; lines move as hashes, but for those with a possible partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkloom.llm.bitmaps import may_be_in
from talkloom.operators.lookup import free_name, lookup
from talkloom.operators.once import compute_once
from talkloom.session import materialise

#: Shorter lines are not matched within one edit: they are headings, list marks, or one word. They
#: take part by equality from ``exact_chars`` on, which is this too unless another is given.
MIN_CHARS = 20
BLANKS = " \t\r\f\x0b"
_ID = ["ha", "hb"]


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _identity(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that together stand for the line."""
    return F.xxhash64(line).alias("ha"), F.xxhash64(F.lit(1), line).alias("hb")


def _halves(line: Column) -> list[Column]:
    """Keys of the line's halves, cut as lines of its length are, and as those one shorter are."""
    found = []
    for length in (F.length(line), F.length(line) - 1):
        front, back = F.floor(length / 2).cast("int"), F.ceil(length / 2).cast("int")
        found.append(F.xxhash64(length, F.lit(0), F.left(line, front)))
        found.append(F.xxhash64(length, F.lit(1), F.right(line, back)))
    return found


def _versions(documents: DataFrame, doc_id: str, text: str, doc: str, version: str) -> DataFrame:
    """``documents`` with doc and version under these names: a hash of the text, or 0 where no other row can have the id."""
    named = documents.withColumn(doc, F.col(doc_id).cast("long"))
    ids = named.select(F.col(doc).alias("doc"))
    twice = materialise(ids.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeated_ids")
    several = F.coalesce(may_be_in(F.col(doc), twice, "doc"), F.lit(False))
    return named.withColumn(version, F.when(several, F.coalesce(F.xxhash64(text), F.lit(0))).otherwise(F.lit(0)).cast("long"))


def _numbered(documents: DataFrame, least: int) -> DataFrame:
    """doc, version, line_no, line: the lines of so many characters, without white space at their ends."""
    lines = documents.where("doc IS NOT NULL AND text IS NOT NULL").select(
        "doc", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return compute_once(lines, "line", _bare(F.col("raw"))).drop("raw").where(F.length("line") >= least)


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total.bitwiseXOR(h))


def _variants(texts: DataFrame) -> DataFrame:
    """ha, position, variant: the deletion neighbourhood of each line.

    Position 0 is the line itself, position i the line without its i-th character. A
    variant is the exclusive or of a hash for each of its characters with its place, so
    that all of a line's variants come out of one running sum, however long it is.
    """
    hashed = lambda moved: _xor(F.transform("characters", lambda c, i: F.xxhash64(i - moved, c)))
    # All characters of a line are made and summed in the task that has the line.
    dealt = compute_once(texts.repartition(*_ID).select(*_ID, "place", "line"), "characters", F.split("line", "")).drop("line")
    summed = compute_once(dealt, "sums", F.struct(
        F.size("characters").alias("size"), hashed(0).alias("whole"), hashed(1).alias("moved")))
    dealt = summed.select(*_ID, "place", "sums", F.posexplode("characters").alias("i", "c")).select(*_ID, "place", "sums.*", "i", "c")
    upto = Window.partitionBy(*_ID, "place").orderBy("i")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.bit_xor(F.xxhash64("i", "c")).over(before), F.lit(0))
    gone = F.bit_xor(F.xxhash64(F.col("i") - 1, "c")).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    without = dealt.select(
        "ha", (F.col("i") + 1).alias("position"),
        F.xxhash64(F.col("size") - 1, kept.bitwiseXOR(F.col("moved")).bitwiseXOR(gone)).alias("variant"), "i", "size", "whole")
    itself = F.struct(F.lit(0).alias("position"), F.xxhash64("size", "whole").alias("variant"))
    shorter = F.struct("position", "variant")
    # The first character's row also gives the line itself.
    return without.select("ha", F.explode(F.when(F.col("i") == 0, F.array(itself, shorter)).otherwise(
        F.array(shorter))).alias("v")).select("ha", "v.position", "v.variant")


def _earlier(one: str, other: str) -> Column:
    """Whether a place comes before another; versions of a document have the same places."""
    return F.struct(f"{one}.doc", f"{one}.line_no") < F.struct(f"{other}.doc", f"{other}.line_no")


def _near(documents: DataFrame, lines: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """ha, hb of the distinct lines that have an earlier line within one edit."""
    halves = lines.select(*_ID, F.explode("halves").alias("half"))
    shared = materialise(halves.groupBy("half").agg(F.min("ha").alias("least"), F.max("ha").alias("most")).where(
        "least < most").select("half"), "shared_halves")
    alive = materialise(
        lookup(halves.where(may_be_in(F.col("half"), shared, "half")), shared, "half", "inner").select(*_ID).distinct(), "alive_ids")
    firsts = distinct.select(*_ID, "first.doc", "first.line_no", "first.version")
    alive = materialise(lookup(firsts.where(may_be_in(F.col("ha"), alive, "ha")), alive, _ID, "inner"), "alive_lines")
    # The text of a line is fetched where it stands first.
    near_by = _numbered(documents.where(may_be_in(F.col("doc"), alive, "doc")), min_chars)
    at_first = ["doc", "line_no", "version"]
    texts = near_by.join(alive.select(at_first).distinct(), at_first).select(
        *_identity(F.col("line")), F.struct(at_first).alias("place"), "line")
    texts = materialise(texts.dropDuplicates([*_ID, "place"]), "alive_texts")

    variants = materialise(_variants(texts), "line_variants")
    # Most variants belong to one line; the others' few rows go on.
    met = materialise(variants.groupBy("variant").agg(F.min("ha").alias("least"), F.max("ha").alias("most")).where(
        "least < most").select("variant"), "met_variants")
    variants = lookup(variants.where(may_be_in(F.col("variant"), met, "variant")), met, "variant", "inner")
    variants = materialise(lookup(variants, texts.select("ha", "hb", "place"), "ha", "inner"), "met_lines")

    # Exchanged: the same without the same character. Inserted: one whole, the other without a character.
    exchanged = variants.where("position > 0").groupBy("variant", "position").agg(
        F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    by_exchange = lookup(variants.where("position > 0"), exchanged, ["variant", "position"], "inner").withColumn(
        "without", F.col("position"))
    whole, shorter = F.col("position") == 0, F.col("position") > 0
    inserted = variants.groupBy("variant").agg(
        F.min(F.when(whole, F.struct("place", "position"))).alias("itself"),
        F.min(F.when(shorter, F.struct("place", "position"))).alias("shorter")).where(
        "itself IS NOT NULL AND shorter IS NOT NULL")
    by_insertion = lookup(variants, inserted, "variant", "inner").withColumn(
        "other", F.when(whole, F.col("shorter")).otherwise(F.col("itself"))).select(
        "*", F.col("other.place").alias("earliest"), F.col("other.position").alias("without"))
    columns = [*_ID, "place", "position", "earliest", "without"]
    candidates = by_exchange.select(columns).unionByName(by_insertion.select(columns)).where(_earlier("earliest", "place")).distinct()

    at = texts.select("place", "line").dropDuplicates(["place"])
    pairs = lookup(candidates, at, "place", "inner")
    pairs = lookup(pairs, at.select(F.col("place").alias("earliest"), F.col("line").alias("earlier")), "earliest", "inner")
    # One edit apart: equal without the character at the same place, or one equal to the other without one.
    return pairs.where(_less("line", "position") == _less("earlier", "without")).select(*_ID).distinct()


def _less(line: str, position: str) -> Column:
    """The line without its character at ``position``; the whole line for position 0."""
    at = F.col(position)
    return F.when(at == 0, F.col(line)).otherwise(F.concat(F.left(line, at - 1), F.substr(line, at + 1)))


def repeated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
             exact_chars: int | None = None) -> DataFrame:
    """doc, version, dropped: the line numbers (from 0) of each version of a document that repeat an earlier line.

    A line repeats an earlier one if an equal line, or one within one edit, comes before it
    in doc_id and line number; that one may be dropped itself. Lines are parted by ``\\n``.
    Lines of ``min_chars`` take part in both ways, others of ``exact_chars`` (as many, if not
    given) or more by equality.
    Rows with the same id count as one document in two versions: a line that stands first
    in one stays at the same place of the other. Each version, told by a hash of its text,
    has its own line numbers. Rows without id or text have no lines.
    """
    doc, version = free_name("_doc", documents), free_name("_version", documents)
    return _repeated(_versions(documents, doc_id, text, doc, version), doc, version, text, min_chars, exact_chars)


def _repeated(versions: DataFrame, doc: str, version: str, text: str, min_chars: int, exact_chars: int | None) -> DataFrame:
    named = versions.select(F.col(doc).alias("doc"), F.col(version).alias("version"), F.col(text).alias("text"))
    line = F.col("line")
    least = min_chars if exact_chars is None else min(min_chars, max(1, exact_chars))
    halves = F.when(F.length(line) >= min_chars, F.array_distinct(F.array(*_halves(line))))
    lines = materialise(_numbered(named, least).select("doc", "version", "line_no", *_identity(line), halves.alias("halves")), "lines")
    distinct = materialise(lines.groupBy(*_ID).agg(
        F.min(F.struct("doc", "line_no", "version")).alias("first"), F.count("*").alias("n")), "distinct_lines")
    near = materialise(_near(named, lines, distinct, min_chars).withColumn("near", F.lit(True)), "near_lines")
    judged = lookup(distinct, near, _ID).where("n > 1 OR near")
    later = lookup(lines.select("doc", "version", "line_no", *_ID), judged, _ID, "inner").where(
        F.coalesce("near", F.lit(False)) | (F.struct("doc", "line_no") != F.struct("first.doc", "first.line_no")))
    return later.groupBy("doc", "version").agg(F.collect_set("line_no").alias("dropped"))


def dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", dropped: str = "n_dropped",
          min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``documents`` with the remaining lines as ``text`` and the number of lines left out as ``dropped``.

    Null texts stay null; a text of which no line remains is empty. :func:`repeated` tells which lines go.
    A column of that name in ``documents`` is replaced by ``dropped``; all others come back as they are.
    """
    doc, version, gone, lines = (free_name(name, documents) for name in ("_doc", "_version", "_gone", "_lines"))
    keyed = _versions(documents, doc_id, text, doc, version)
    found = materialise(_repeated(keyed, doc, version, text, min_chars, exact_chars).select(
        F.col("doc").alias(doc), F.col("version").alias(version), F.col("dropped").alias(gone)), "dropped_lines")
    # Only texts that may lose a line are shuffled.
    touched = F.coalesce(may_be_in(F.col(doc), found, doc), F.lit(False))
    joined = lookup(keyed.where(touched), found.hint("shuffle_hash"), [doc, version])
    others = [c for c in documents.columns if c != dropped]
    untouched = keyed.where(~touched).select(*others, F.lit(0).cast("long").alias(dropped))
    pieces = F.split(F.col(text), "\n")
    places = F.sequence(F.lit(0), F.size(pieces) - 1)
    stays = F.array_except(places, F.col(gone))
    rest = F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n")
    marked = compute_once(joined, lines, F.when(F.col(gone).isNotNull(), pieces))
    count = F.coalesce(F.size(pieces) - F.size(stays), F.lit(0)).cast("long")
    same = F.col(gone).isNull() | F.col(text).isNull()
    changed = marked.select(
        *[F.when(same, F.col(text)).otherwise(rest).alias(c) if c == text else F.col(c) for c in others],
        F.when(same, F.lit(0).cast("long")).otherwise(count).alias(dropped))
    return changed.unionByName(untouched)
