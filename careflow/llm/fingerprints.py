"""Document fingerprints: hashes of the terms of middling document frequency, over several random parts of the lexicon."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.session import cut_lineage

SLOTS = 1 << 14
#: Parts of the lexicon: a term belongs to a part if the hexadecimal digits of its MD5 from a place on are below a bound. The first
#: part is the whole lexicon; then three parts hold a 32nd of it, four a 64th, four a 128th and four a 256th, each by digits of its own.
#: Of two documents that share much, the small parts agree often, the large ones seldom.
PARTS = ((1, 2, "g"), *[(1 + 2 * i, 2, bound) for i, bound in enumerate(["08"] * 3 + ["04"] * 4 + ["02"] * 4 + ["01"] * 4)])


@dataclass(frozen=True)
class Lexicon:
    """The lexicon's terms by hash slot, as JSON; a constant of the plan that is parsed once."""

    slots: str

    def holds(self, term: Column) -> Column:
        return F.array_contains(F.element_at(F.from_json(F.lit(self.slots), "array<array<string>>"), slot_of(term)), term)


def slot_of(term: Column) -> Column:
    return (F.pmod(F.xxhash64(term), F.lit(SLOTS)) + 1).cast("int")


def terms_of(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, text_col: str, low: float, high: float, most_terms: int) -> Lexicon | DataFrame:
    """Terms that occur in a share of at least `low` and at most `high` of all documents, and in two at least.

    Every document is counted and every such term is used. Up to `most_terms` terms are a constant of the plan; more are a
    table (term), which no task or driver holds as a whole.
    """
    counted = docs.select(F.explode(terms_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).where("term <> ''").groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).where("df > 1")
    n = docs.count()
    band = counted.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select(slot_of(F.col("term")).alias("slot"), "term")
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    found = band.limit(most_terms + 1).collect()
    if len(found) > most_terms:
        return cut_lineage(band.select("term"), "lexicon")
    for row in found:
        slots[row["slot"] - 1].append(row["term"])
    return Lexicon(json.dumps(slots, ensure_ascii=False, separators=(",", ":")))


def _in_part(place: int, width: int, bound: str) -> Callable[[Column], Column]:
    return lambda digest: F.substring(digest, place, width) < bound


def part_hashes(kept: Column) -> Column:
    """Array of a hash for each part of the lexicon: MD5 over a text's sorted distinct terms in that part, 16 digits of it; `-` where it has none."""
    digests = F.transform(kept, lambda t: F.md5(t.cast("binary")))

    def parts_of(found: Column) -> Column:
        hashes = []
        for place, width, bound in PARTS:
            own = F.filter(found, _in_part(place, width, bound))
            hashes.append(F.when(F.size(own) > 0, F.substring(F.md5(F.array_join(own, "").cast("binary")), 1, 16)).otherwise("-"))
        return F.array(*hashes)

    return F.element_at(F.transform(F.array(digests), parts_of), 1)


def with_parts(rows: DataFrame, lexicon: Lexicon | DataFrame, text_col: str, name: str) -> DataFrame:
    """Rows (id, tie, ...) and the part hashes of a text; rows that share id and tie have one text."""
    if isinstance(lexicon, Lexicon):
        return rows.withColumn(name, part_hashes(F.array_sort(F.filter(terms_of(F.col(text_col)), lambda t: lexicon.holds(t)))))
    terms = rows.select("id", "tie", F.explode(terms_of(F.col(text_col))).alias("term")).join(lexicon, "term")
    kept = terms.groupBy("id", "tie").agg(F.array_sort(F.collect_set("term")).alias("kept"))
    hashed = part_hashes(F.coalesce("kept", F.array().cast("array<string>")))
    return rows.join(kept, ["id", "tie"], "left").withColumn(name, hashed).drop("kept")


def fingerprint(hashes: Column, digest: Column) -> Column:
    """The part hashes joined by a dot, or, where no part has a term, the MD5 of the text."""
    return F.when(F.exists(hashes, lambda h: h != "-"), F.array_join(hashes, ".")).otherwise(F.concat(F.lit("text:"), digest))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of the parts in which either document has a term the share with equal hashes; without such parts, whether the fingerprints are the same."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != "-") | (p["b"] != "-")))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] != "-") & (p["a"] == p["b"])))
    return F.when(used > 0, equal / used).otherwise(same.cast("double"))


def next_documents(keys: DataFrame, parts: int) -> DataFrame:
    """For distinct keys (id, tie) in descending order the key after each (next_id, next_tie); the first follows the last.

    Keys are dealt in order over `parts` parts and written, each part is walked on its own, and the last key of a part gets
    the first of the next part that has any, of which there are at most `parts`.
    """
    dealt = cut_lineage(keys.repartitionByRange(parts, F.col("id").desc(), F.col("tie").desc()).withColumn("part", F.spark_partition_id()), "order")
    order = (F.col("id").desc(), F.col("tie").desc())
    key = F.struct("id", "tie")
    firsts = dealt.groupBy("part").agg(F.max(key).alias("first"))
    around = Window.partitionBy(F.lit(0))
    following = firsts.select("part", F.coalesce(F.lead("first").over(around.orderBy("part")), F.max("first").over(around)).alias("following"))
    walked = dealt.withColumn("after", F.lead(key).over(Window.partitionBy("part").orderBy(*order))).join(following, "part")
    after = F.coalesce("after", "following")
    return walked.select("id", "tie", after["id"].alias("next_id"), after["tie"].alias("next_tie"))


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.002, high: float = 0.2, most_terms: int = 65_536, parts: int | None = None,
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in
    descending order of ids; the first follows the last. Returns a row for each input row: `id_col`, `n_chars`,
    `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited` and `near_next` (likeness to the edited text and to the
    next document).

    The lexicon is counted once over all documents; with more than `most_terms` terms it is a table that the terms of the texts
    are joined to, with the same rows as result. A text's part hashes are made once, before it is shuffled by id, and go with it;
    beside the texts only the needed heads of the next documents, with those hashes, move.

    A null text is empty. Null ids come last. Rows that share an id come in descending order of a hash of the text, and
    rows that share both are one document with one answer. Other columns are ignored. An empty table gives no rows.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    lex = lexicon(docs, text_col, low, high, most_terms)

    keys = whole.select("id", "tie", F.length("text").cast("long").alias("n_chars")).distinct()
    after = next_documents(keys.select("id", "tie"), parts).join(keys, ["id", "tie"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = cut_lineage(after.select(F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), third.alias("k")), "wanted")

    if isinstance(lex, Lexicon):
        dealt = with_parts(whole, lex, "text", "own").repartition("id", "tie")
    else:
        dealt = with_parts(whole.repartition("id", "tie"), lex, "text", "own")
    followers = dealt.dropDuplicates(["id", "tie"]).join(wanted, ["id", "tie"])
    heads = followers.select(
        F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.col("k"), F.substring("text", F.lit(1), F.col("k")).alias("head"), F.col("own").alias("next_parts"),
        F.md5(F.col("text").cast("binary")).alias("next_md5"))
    joined = dealt.join(heads, ["id", "tie"]).withColumn("n_chars", F.length("text").cast("long"))
    edited = joined.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("k")).cast("int")), "head"))
    hashed = with_parts(edited, lex, "edited", "other").select(
        "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "other", "next_parts", "next_md5",
        F.md5(F.col("text").cast("binary")).alias("m"), F.md5(F.col("edited").cast("binary")).alias("e"))

    return hashed.select(
        F.when(F.col("id") != -(2**63), F.col("id")).alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("own"), F.col("m")).alias("fingerprint"), fingerprint(F.col("other"), F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), F.col("m") == F.col("e")).alias("near_edited"), likeness(F.col("own"), F.col("next_parts"), F.col("m") == F.col("next_md5")).alias("near_next"))
