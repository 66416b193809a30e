"""Mentions of one person, organisation or tool across applications: the best match of each, and clusters in order.

Mentions are ``id, user_id, label, text, platform, ts``. The text without white space at its ends, together with user and
label, is a mention's class; names are compared between classes, and mentions only where time counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import join_groups, written
from .duplicates import set_pairs

# What is cut from the end of an organisation's name, and the scores of each way to match.
SUFFIXES = (" inc.", " inc", " corp.", " corp", " ltd.", " ltd", " llc", " llp", " co.", " co")
EXACT, ALIASES, ALIAS, IN_WINDOW, FUZZY_IN_WINDOW, FUZZY, CLUSTER = 1.0, 0.90, 0.85, 0.75, 0.7, 0.85, 0.80


def aliases(text: Column, label: Column) -> Column:
    """Other forms of a name: initials, parts and turned order of persons, organisations without their legal form and as an
    acronym, tools without dots, hyphens or blanks. The name itself, in lower case, is always one."""
    low, none = F.lower(text), F.array().cast("array<string>")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    person = F.when(F.size(words) >= 2, F.array(*[F.lower(x) for x in (
        F.concat(F.left(first, F.lit(1)), F.lit(". "), last), F.concat(first, F.lit(" "), F.left(last, F.lit(1)), F.lit(".")), first, last, F.concat(last, F.lit(", "), first),
    )])).otherwise(none)
    cut = F.filter(F.array(*[F.when(F.endswith(low, F.lit(s)), F.trim(F.replace(low, F.lit(s), F.lit("")))) for s in SUFFIXES]), lambda x: x.isNotNull())
    initials = F.array_join(F.filter(F.transform(words, lambda w: F.left(w, F.lit(1))), lambda c: F.rlike(c, F.lit(r"^\p{Lu}"))), "")
    company = F.concat(cut, F.when((F.size(words) >= 2) & (F.length(initials) >= 2), F.array(F.lower(initials))).otherwise(none))
    tool = F.array(*[F.replace(low, F.lit(c), F.lit("")) for c in ".- "])
    more = F.when(label == "PERSON", person).when(label == "ORG", company).when(label == "TOOL", tool).otherwise(none)
    return F.array_distinct(F.concat(F.array(low), more))


def fuzzy(a: Column, b: Column, chars_a: Column, chars_b: Column) -> Column:
    """Half the share of common characters and half the ratio of lengths, plus .15 if one begins with the other; 1 at most."""
    long, short = F.when(F.length(a) <= F.length(b), b).otherwise(a), F.when(F.length(a) <= F.length(b), a).otherwise(b)
    met = F.size(F.array_intersect(chars_a, chars_b))
    common = met / (F.size(chars_a) + F.size(chars_b) - met)
    lengths = F.length(short) / F.length(long)
    value = F.least(F.lit(1.0), common * 0.5 + lengths * 0.5 + F.when(F.startswith(long, short), 0.15).otherwise(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(value)


def mention_classes(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mentions with their class, and the classes: ``class, label, rep`` (smallest identifier), ``n, low, chars, aliases``.

    What follows from the name alone is worked out once for all users that have it; ``chars`` are code points."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = mentions.select("id", "user_id", F.coalesce("label", F.lit("")).alias("label"), text.alias("name"), F.coalesce("platform", F.lit("unknown")).alias("platform"), "ts")
    rows = written(rows.withColumn("class", F.xxhash64("user_id", "label", "name")), "mentions")
    classes = written(rows.groupBy("class", "user_id", "label", "name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    low = F.lower("name")
    chars = F.transform(F.filter(F.array_distinct(F.split(low, "")), lambda c: c != ""), F.ascii)
    names = written(classes.groupBy("label", "name").agg(F.count(F.lit(1)).alias("users")).withColumns({"low": low, "chars": chars, "aliases": aliases(F.col("name"), F.col("label"))}), "names")
    return rows.drop("name"), written(join_groups(classes, names, ["label", "name"], "users", classes.count()).drop("users").withColumn("grp", F.xxhash64("user_id", "label")), "classes")


def class_matches(classes: DataFrame) -> DataFrame:
    """``a, b, method, score, fuzzy`` of every pair of classes, ``a < b``, of which a mention can match the other by name.

    Equal names and common aliases are found by joins; for fuzzy matches above .7 the characters in common are at least .4
    of the larger set's, or one name begins with the other and its characters are all in the other: a prefix filter finds
    all of these. ``method`` is null where only a common time makes a match.
    """
    keyed = classes.select("grp", "rep", F.explode("aliases").alias("x"))
    met = keyed.withColumnRenamed("rep", "a").join(keyed.withColumnRenamed("rep", "b"), ["grp", "x"]).filter("a < b").select("a", "b")
    pairs = met.union(set_pairs(classes.select("grp", "rep", F.col("chars").alias("s")), 0.4, True)).distinct()
    side = lambda k: classes.select(F.col("rep").alias(k), *[F.col(c).alias(c + k) for c in ("label", "low", "chars", "aliases")])
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    x = x.withColumns({"shared": F.size(F.array_intersect("aliasesa", "aliasesb")), "fuzzy": fuzzy(F.col("lowa"), F.col("lowb"), F.col("charsa"), F.col("charsb"))})
    near = F.col("labela").isin("PERSON", "ORG") & (F.col("fuzzy") >= FUZZY)
    same = F.col("lowa") == F.col("lowb")
    method = F.when(same, "exact").when(F.col("shared") > 0, "alias").when(near, "fuzzy")
    score = F.when(same, EXACT).when(F.col("shared") > 1, ALIASES).when(F.col("shared") > 0, ALIAS).when(near, F.round("fuzzy", 3))
    return written(x.select("a", "b", method.alias("method"), score.alias("score"), "fuzzy").filter(F.col("method").isNotNull() | (F.col("fuzzy") > FUZZY_IN_WINDOW)), "matches")


def resolve_mentions(mentions: DataFrame, window_seconds: int = 3600, k: int = 5) -> DataFrame:
    """M4: each mention against all others of its user: ``id, resolved, canonical_id, method, cross_platform, n_matches`` and
    ``matches``, the ``k`` best as "identifier method score".

    Same name 1.0; a common alias .85, several .90; else, of one label, a fuzzy match above .7 within ``window_seconds`` .75,
    and one of .85 or more between persons or organisations its own value. Equal scores are in order of the identifiers.
    Names are matched by classes: each class has one list of its first ``k + 1`` matches. What time decides is an interval
    join: times are dealt into buckets of the window, and a mention looks into its own and both neighbours.
    """
    rows, classes = mention_classes(mentions)
    both = lambda x: x.union(x.select("b", "a", *x.columns[2:]))
    found = class_matches(classes)
    named = both(found.filter("method is not null").select("a", "b", "method", "score"))
    own = classes.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit("exact").alias("method"), F.lit(EXACT).alias("score"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    first = rows.select("id", "class", "platform").withColumn("p", place).filter(F.col("p") <= k + 1).join(classes.select("class", "rep"), "class").select(F.col("rep").alias("b"), F.col("id").alias("other"), F.col("platform").alias("there"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "other"))
    lists = named.union(own).join(first, "b").withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    lists = lists.groupBy("a").agg(F.collect_list(F.struct("other", "there", "method", "score")).alias("list"))
    keyed = written(classes.select("class", "n", F.col("rep").alias("a")).join(lists, "a", "left"), "lists")
    each = written(join_groups(rows, keyed, ["class"], "n", rows.count()), "mentions")
    by_name = each.select("id", "platform", F.explode("list").alias("e")).filter("e.other <> id").select("id", "platform", "e.*")

    t = F.unix_micros("ts")
    timed = both(found.filter((F.col("fuzzy") > FUZZY_IN_WINDOW) & (F.col("method").isNull() | (F.col("method") == "fuzzy"))).select("a", "b"))
    slot = F.floor(t / (window_seconds * 1_000_000))
    here = each.filter("ts is not null").select("id", "platform", "a", t.alias("t"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot")).join(timed, "a")
    there = each.filter("ts is not null").select(F.col("id").alias("other"), F.col("platform").alias("there"), F.col("a").alias("b"), t.alias("u"), slot.alias("slot"))
    by_time = here.join(there, ["b", "slot"]).filter(F.abs(F.col("t") - F.col("u")) <= window_seconds * 1_000_000).select("id", "platform", "other", "there", F.lit("time_window").alias("method"), F.lit(IN_WINDOW).alias("score"))

    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other", F.desc("method")))
    top = by_name.union(by_time).withColumn("rank", best).filter(F.col("rank") <= k)
    at = lambda c: F.max(F.when(F.col("rank") == 1, c))
    says = F.concat_ws(" ", F.col("other").cast("string"), "method", F.format_string("%.3f", "score"))
    top = top.groupBy("id").agg(at(F.col("other")).alias("canonical_id"), at(F.col("method")).alias("method"), at(F.col("platform") != F.col("there")).alias("cross_platform"), F.count(F.lit(1)).alias("n_matches"), F.sort_array(F.collect_list(F.struct("rank", says.alias("says")))).alias("m"))
    out = rows.select("id").join(top, "id", "left")
    return out.select("id", F.col("canonical_id").isNotNull().alias("resolved"), F.coalesce("canonical_id", "id").alias("canonical_id"), F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("cross_platform", F.lit(False)).alias("cross_platform"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce(F.array_join("m.says", "; "), F.lit("")).alias("matches"))


def greedy_leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, leader``: what a loop over ``nodes(id)`` in order gives that makes each node without a leader one, and hands it all
    later linked nodes (``links(a, b)``, ``a < b``) that have none yet.

    In each round a node looks at the smallest of its earlier neighbours that isn't handed out: if that is a leader, it is
    handed to it, and without any it becomes a leader. The rest waits; the smallest node that waits is always decided.
    """
    state = written(nodes.select("id", F.lit(None).cast("long").alias("leader")), "leaders")
    while True:
        open_ = links.join(state.filter("leader is null or leader = id").select(F.col("id").alias("a"), F.col("leader").isNotNull().alias("leads")), "a")
        nearest = open_.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "leads")).alias("e"))
        leader = F.coalesce("leader", F.when(F.col("e").isNull(), F.col("id")).when(F.col("e.leads"), F.col("e.a")))
        waits = Observation()
        new = state.join(nearest, "id", "left").select("id", leader.alias("leader")).observe(waits, F.count(F.when(F.col("leader").isNull(), 1)).alias("n"))
        state = written(new, "leaders")
        if not waits.get["n"]:
            return state


def cluster_mentions(mentions: DataFrame) -> DataFrame:
    """M4: ``id, cluster_id, size, platforms, cross_platform``: clusters as a loop over each user's mentions in order makes
    them: the first one that is in none opens one, and all later ones that are in none and match it at .80 or more join.

    Mentions of one class always end up together, so the loop runs over classes in order of their first members.
    """
    rows, classes = mention_classes(mentions)
    links = class_matches(classes).filter(F.col("score") >= CLUSTER).select("a", "b")
    leaders = greedy_leaders(classes.select(F.col("rep").alias("id")), links)
    keyed = written(classes.select("class", "n", F.col("rep").alias("id")).join(leaders, "id").select("class", "n", F.col("leader").alias("cluster_id")), "clusters")
    x = written(join_groups(rows.select("id", "class", "platform"), keyed, ["class"], "n", rows.count()).select("id", "cluster_id", "platform"), "mentions")
    platforms = F.array_sort(F.collect_set("platform"))
    per = written(x.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.array_join(platforms, ",").alias("platforms"), (F.size(platforms) > 1).alias("cross_platform")), "clusters")
    return join_groups(x.select("id", "cluster_id"), per, ["cluster_id"], "size", x.count())
