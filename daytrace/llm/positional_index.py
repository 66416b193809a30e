"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

A text's words are the maximal runs of 0-9, a-z and everything beyond ASCII after lower-casing A-Z. A posting is one word
of one document: a 64-bit hash of identifier and text (``doc``), the word's place (``pos``) and a 64-bit hash of the word
(``term``). Hashes only choose candidates: what is returned was compared word by word, so a collision costs time and never
a wrong or lost row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded, join_groups
from .common import ascii_lower, cut_lineage, new_folder

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters without A-Z, for counts that need no lower case.
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def parts(text: Column) -> Column:
    """The words of ``text``, with an empty string before or after them where the text starts or ends with a separator."""
    return F.split(ascii_lower(text), SEPARATORS)


def n_words(text: Column) -> Column:
    """How many words ``text`` has; null has none."""
    pieces = F.split(text, SEPARATORS_ANY_CASE)
    ends = (F.element_at(pieces, 1) == "").cast("long") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("long")
    return F.coalesce(F.size(pieces).cast("long") - ends, F.lit(0).cast("long"))


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, pos, term)`` of every word; null texts have none."""
    # The outer form keeps Catalyst from adding a filter that would split each text again.
    split = docs.select(document_key(id_col, text_col).alias("doc"), parts(F.col(f"`{text_col}`")).alias("words"))
    return split.select("doc", F.posexplode_outer("words").alias("pos", "word")).filter("word <> ''").select("doc", "pos", F.xxhash64("word").alias("term"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, most_terms: int = 1_000_000) -> DataFrame:
    """Write the postings of ``docs`` to a new folder in the shared one, and read them from there.

    Each task writes the postings of its own documents, in their order, so nothing is shuffled; a lost executor costs its
    unfinished files only. ``terms``, one column ``term``, leaves out words that nobody will ask for; above ``most_terms``
    of them every word is stored, which changes no result.
    """
    found = postings(docs, id_col, text_col)
    if terms is not None and terms.limit(most_terms + 1).count() <= most_terms:
        found = found.join(F.broadcast(terms), "term", "left_semi")
    folder = new_folder(docs.sparkSession, "positional-index")
    found.select("term", "doc", "pos").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, words)``: each different item with words, once; ``item`` is a hash of identifier and text."""
    words = F.array_remove(parts(F.col(f"`{text_col}`")), "")
    return items.select(document_key(id_col, text_col).alias("item"), F.col(f"`{id_col}`").cast("string").alias("item_id"), words.alias("words")).filter(F.size("words") > 0).dropDuplicates(["item", "item_id"])


def item_terms(items: DataFrame) -> DataFrame:
    return items.select("item", F.posexplode("words").alias("at", "word")).select("item", "at", F.xxhash64("word").alias("term"))


def ranked_windows(items: DataFrame, index: DataFrame, window: int, depth: int) -> DataFrame:
    """``(item, start, rare)``: each run of ``window`` words, or the whole of a shorter item, with its ``depth`` rarest places.

    ``rare`` has ``n`` (postings of the term), ``at`` and ``term``, rarest first and then by place. Windows with a word that
    no document has are left out.
    """
    sizes = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = item_terms(items).join(sizes, "term", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("terms"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("terms") - window, F.lit(0)))
    windows = counted.select("item", "terms", F.explode(starts).alias("start")).select("item", "start", F.slice("terms", F.col("start") + 1, window).alias("terms"))
    rare = F.slice(F.array_sort(F.transform("terms", lambda t: F.struct(t["n"].alias("n"), t["at"].alias("at"), t["term"].alias("term")))), 1, depth)
    return windows.select("item", "start", rare.alias("rare")).filter(F.col("rare")[0]["n"] > 0)


def alignments(index: DataFrame, windows: DataFrame, depth: int) -> DataFrame:
    """``(doc, item, delta)``: where a word ``delta`` places further in the document matches the item at the ``depth`` rarest
    places of some window; negative where a document starts within an item.

    The list of the rarest term of each window is read first, each posting less the term's place in the item; then the
    lists of the next terms are intersected with what is left, one after the other. Windows that share their rarest places
    share the search. The joins after the first are on document and place, which no word and no copied passage makes hot.
    """
    chains = windows.select("item", F.transform("rare", lambda r: F.struct(r["at"].alias("at"), r["term"].alias("term"))).alias("chain")).distinct()
    first = chains.groupBy("item", F.col("chain")[0]["at"].alias("at"), F.col("chain")[0]["term"].alias("term")).agg(F.collect_set("chain").alias("chains"))
    rows = index.join(bounded(first, 20_000), "term").select("doc", "item", (F.col("pos") - F.col("at")).alias("delta"), F.explode("chains").alias("chain"))
    for k in range(1, depth):
        terms = chains.select(F.get("chain", F.lit(k))["term"].alias("term")).dropna().distinct()
        listed = index.join(bounded(terms, 1_000_000), "term", "left_semi")
        place = F.get("chain", F.lit(k))
        short = rows.filter(F.size("chain") <= k)
        wanted = rows.filter(F.size("chain") > k).withColumns({"pos": F.col("delta") + place["at"], "term": place["term"]})
        rows = wanted.join(listed, ["doc", "pos", "term"], "left_semi").select(*short.columns).unionByName(short)
    return rows.select("doc", "item", "delta").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, depth: int = 3) -> DataFrame:
    """Where runs of ``window`` words of ``items`` occur in ``docs``; an item with fewer words, but not none, is one run.

    The index has the postings of all words of the items. For each run, the list of its rarest word gives alignments of
    document and item, which are intersected with the lists of the next rarest words, ``depth`` in all, and each alignment
    that is left is compared with the text word by word.

    Returns ``doc_id, n_words``, and ``matches``: an array of ``item_id``, ``start`` (place of the run's first word in the
    document, from 0) and ``n`` (words), one per run and place, sorted by none. One row per row of ``docs``. A null text has
    no words and no matches, and neither has an empty one; null identifiers of documents are kept, and repeated rows each
    get their matches; of repeated items one counts; an item with a null identifier matches, under a null identifier. Very
    long texts count whole, and with empty tables the result is empty or has no matches. Other columns aren't looked at.

    Memory is bounded by the longest text and its matches. Texts are shuffled once, to meet their alignments.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    wanted = cut_lineage(item_words(items, item_col, item_text))
    index = build_index(narrow, terms=item_terms(wanted).select("term").distinct())
    windows = cut_lineage(ranked_windows(wanted, index, window, depth))
    found = cut_lineage(alignments(index, windows, depth))
    held = bounded(wanted, 10_000)
    if held is wanted:
        per_item = cut_lineage(found.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(wanted, "item"))
        named = join_groups(found, per_item, ["item"], "n", found.count()).drop("n")
    else:
        named = found.join(held, "item")
    by_doc = named.groupBy("doc").agg(F.collect_list(F.struct("item_id", "delta", "words")).alias("aligned"))

    text = narrow.select("doc_id", "text", document_key("doc_id", "text").alias("doc"))
    met = text.join(by_doc, "doc", "left").select("doc_id", n_words(F.col("text")).alias("n_words"), "aligned", F.when(F.col("aligned").isNotNull(), parts(F.col("text"))).alias("words"))
    # An empty string before the first word shifts all places by one.
    shift = (F.element_at("words", 1) == "").cast("int")
    size = lambda a: F.least(F.size(a["words"]), F.lit(window))
    runs = lambda a: F.filter(F.sequence(F.lit(0), F.size(a["words"]) - size(a)), lambda s: F.when(a["delta"] + s >= 0, F.slice(F.col("words"), a["delta"] + s + 1, size(a)) == F.slice(a["words"], s + 1, size(a))).otherwise(False))
    matches = F.flatten(F.transform("aligned", lambda a: F.transform(runs(a), lambda s: F.struct(a["item_id"].alias("item_id"), (a["delta"] + s - shift).alias("start"), size(a).alias("n")))))
    return met.select("doc_id", "n_words", F.coalesce(matches, F.array().cast("array<struct<item_id:string,start:int,n:int>>")).alias("matches"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, depth: int = 3) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any match; ``items_sha256`` is the digest of the matching items' identifiers, sorted
    as strings and joined by commas, and null identifiers are neither counted nor joined. Nulls, empty and long texts,
    repeated rows, clashing columns and empty tables are as ``phrase_matches`` states.
    """
    found = phrase_matches(docs, items, window=window, depth=depth)
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["n"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    out = found.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), ids.alias("ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n_terms: int = 4, within: int = 12) -> DataFrame:
    """Where the ``n_terms`` rarest different words of an item stand together, in any order, within ``within`` words.

    Ranks are by postings in ``docs`` and then by the word's hash; items with fewer different words use all they have, and
    an item with a word among them that no document has matches nowhere. Starting with the rarest term's list, each
    further list meets what is left on document and block of ``within`` places (its own and both neighbours), and only
    spans that still fit go on.

    Returns ``doc_id, item_id, start, stop``: the first and last place of each such group of postings, each once per
    document row. Nulls, repeated rows, clashing columns and empty tables are as in ``phrase_matches``. A posting of the
    rarest term starts at most ``within`` to the power of ``n_terms - 1`` spans, whatever the table's size.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    wanted = cut_lineage(item_words(items, item_col, item_text))
    terms = item_terms(wanted).select("item", "term").distinct()
    index = build_index(narrow, terms=terms.select("term").distinct())
    sizes = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = terms.join(sizes, "term", "left").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, n_terms).alias("rare"))
    chains = cut_lineage(ranked.filter(F.col("rare")[0]["n"] > 0).select("item", F.col("rare.term").alias("chain")))
    lists = index.distinct()
    first = bounded(chains.select("item", "chain", F.col("chain")[0].alias("term")), 20_000)
    rows = lists.join(first, "term").select("doc", "item", "chain", F.col("pos").alias("lo"), F.col("pos").alias("hi"))
    for k in range(1, n_terms):
        short = rows.filter(F.size("chain") <= k)
        blocks = F.array(*[F.floor(F.col("lo") / within) + d for d in (-1, 0, 1)])
        asked = rows.filter(F.size("chain") > k).withColumns({"term": F.get("chain", F.lit(k)), "block": F.explode(blocks)})
        listed = lists.join(bounded(chains.select(F.get("chain", F.lit(k)).alias("term")).dropna().distinct(), 1_000_000), "term", "left_semi").withColumn("block", F.floor(F.col("pos") / within))
        met = asked.join(listed, ["doc", "term", "block"]).select("doc", "item", "chain", F.least("lo", "pos").alias("lo"), F.greatest("hi", "pos").alias("hi"))
        rows = met.filter(F.col("hi") - F.col("lo") < within).distinct().unionByName(short)
    shift = (F.element_at(parts(F.col("text")), 1) == "").cast("int")
    keys = narrow.select("doc_id", document_key("doc_id", "text").alias("doc"), shift.alias("shift"))
    return keys.join(rows, "doc").join(wanted.select("item", "item_id"), "item").select("doc_id", "item_id", (F.col("lo") - F.col("shift")).alias("start"), (F.col("hi") - F.col("shift")).alias("stop")).distinct()
