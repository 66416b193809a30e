"""Audit of filters that are applied in some order: who removes what, and what would have gone anyway."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_groups
from .common import UPPER, cut_lineage

FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """Bits of the conditions that need one text only: A 1, B 2, C 4, D 8. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    marks = F.lit(False)
    for c in "#$%&*|":
        marks = marks | F.contains(text, F.lit(c))
    conditions = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), marks]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))


def earlier_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """The rows of ``docs`` for which a row with a smaller identifier and an identical text exists, null texts as empty.

    An existential self-join: rows meet on a hash of the text, and a row stays if one is there with the same text and a
    smaller identifier. Of the right side the smallest identifier of each text answers for all. Only rows whose hash
    occurs twice carry their text to the join; a group above ``block`` rows is dealt into as many salts as it has blocks,
    and its right row is repeated for each, so no task holds a whole group. A null identifier is neither smaller nor larger
    than any. Repeated rows with one identifier aren't copies of each other. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("hash"))
    identifier, text = F.col("row")[id_col], F.coalesce(F.col("row")[text_col], F.lit(""))
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(identifier).alias("lo"), F.max(identifier).alias("hi"))
    groups = cut_lineage(groups.filter("lo < hi").select("hash", "n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    twice = join_groups(rows, groups, ["hash"], "n", total)
    salts = F.ceil(F.col("n") / block).cast("int")
    left = twice.select("row", F.col("hash").alias("h"), F.pmod(F.xxhash64("row", F.lit(7)), salts).alias("s"))
    right = twice.groupBy("hash", text.alias("text"), "n").agg(F.min(identifier).alias("smallest")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    exists = (F.col("h") == F.col("hash")) & (F.col("s") == F.col("salt")) & (text == F.col("text")) & (F.col("smallest") < identifier)
    return left.join(right, exists, "left_semi").select("row.*")


def failure_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, part, bits, n)``: each document's set of failed filters, and how many rows are alike in all of these.

    The identifiers that fail E, with the bit 16, are united with the bits of the others; rows meet on identifier, part and a
    hash of the text, so repeated identifiers with different texts stay apart. A null part is the empty string. Into the self-join
    goes, for each text, its SHA-256 with byte length and a second 64-bit hash, so texts are not shuffled.
    """
    key = [F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("part"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tx"), F.col(f"`{text_col}`").alias("text")]
    narrow = docs.select(*key)
    each = narrow.select("doc_id", "part", "tx", failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    whole = F.coalesce("text", F.lit(""))
    digest = F.concat_ws(":", F.sha2(whole, 256), F.octet_length(whole), F.xxhash64(whole))
    copies = earlier_copies(narrow.withColumn("text", digest)).select("doc_id", "part", "tx", F.lit(16).alias("bits"), F.lit(0).alias("n"))
    return each.unionByName(copies).groupBy("doc_id", "part", "tx").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).drop("tx")


def combinations(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, n, good, toxic)``: documents, and those labelled quality 1 or toxic 1, by part and set of failures.

    Of several labels of one document any 1 counts; a null identifier has no label.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return sets.join(marks, "doc_id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``kept`` (left after the step), ``removed`` (by it), ``redundant`` (fails its filter but went earlier), ``unique_fails``
    (fails its filter only), ``good_lost`` and ``toxic_lost`` (removed by it, and labelled so), and ``shapley``, the removals
    of its filter over all 120 orders. Everything after the combinations of bits works on at most 32 rows a part.

    Null texts are empty ones, null parts the empty string, and a null identifier is never a copy; repeated rows count each
    time; labels of absent documents don't count; an empty table has no part and gives no rows. Very long texts count whole.
    """
    found = cut_lineage(combinations(failure_sets(docs), labels))
    sets_of = [(before, 1 << k) for k in range(5) for before in range(32) if not before >> k & 1]
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("own")) for b, f in sets_of]))
    cases = found.withColumn("c", case).select("part", "bits", "n", "good", "toxic", "c.*")
    fails, gone = F.col("bits").bitwiseAND(F.col("own")) > 0, F.col("bits").bitwiseAND(F.col("before")) > 0
    total = lambda cond, n="n": F.sum(F.when(cond, F.col(n)).otherwise(0)).cast("long")
    counts = cases.groupBy("part", "before", "own").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("bits") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [("".join(p), k + 1, sum(bit[x] for x in p[:k]), bit[f]) for p in permutations(FILTERS) for k, f in enumerate(p)]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    out = counts.join(F.broadcast(orders), ["before", "own"])
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
