"""Duplicate entities: a similarity search that loses no pair, clusters, candidates, and merging.

Entities are ``id, user_id, entity_type, name, occurrence_count, first_seen, last_seen`` and, where they are known,
``external_ids`` (map of strings) and ``aliases`` (array of strings). Entities of one user and type that are alike in name,
aliases and external identifiers are one class; the search runs over classes, and pairs are between classes' first members.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut_lineage, join_groups, written
from .components import connected_components, spanning
from .resolve import sequence_ratio

# Weight and least value of each signal, bonus for one type, and what to do from which score on.
WEIGHTS = {"external_id": 5.0, "fuzzy_name": 2.0, "token_set": 1.5, "alias_match": 2.0}
EXTERNAL_SCORE, LEAST_SIGNAL, SUBSET_SCORE, TYPE_BONUS = 0.99, 0.60, 0.90, 0.05
MIN_PAIR_SCORE, SUGGEST, AUTO_MERGE = 0.75, 0.80, 0.97
LONG = 1024  # names with more characters are compared by themselves, without a look at common subsequences first


def normalized(name: Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscores as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def entity_classes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities with their class, ``(id, class, occurrence_count)``, and the classes: ``class, user_id, entity_type, norm,
    tokens, aliases, external, rep`` (smallest identifier) and ``n``.

    A class is a hash of what its members share. Null types are "unknown"; null and empty aliases, and external
    identifiers without a value, don't count.
    """
    alias = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != ""), normalized)))
    external = F.array_sort(F.filter(F.map_entries(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()))
    rows = entities.select("id", "user_id", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), normalized(F.col("name")).alias("norm"), alias.alias("aliases"), external.alias("external"), "occurrence_count")
    tokens = F.filter(F.array_distinct(F.split("norm", " ")), lambda t: t != "")
    rows = cut_lineage(rows.withColumns({"tokens": tokens, "class": F.xxhash64("user_id", "entity_type", "norm", "aliases", "external")}))
    alike = ["class", "user_id", "entity_type", "norm", "tokens", "aliases", "external"]
    return rows.select("id", "class", "occurrence_count"), cut_lineage(rows.groupBy(*alike).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))


def set_pairs(rows: DataFrame, share: float, subset: bool, block: int = 1024, small: int = 64) -> DataFrame:
    """``a, b``: the pairs among ``rows(grp, rep, s)`` of a group whose sets share at least ``share`` of the larger one's elements
    or, with ``subset``, of which one holds the other; each once, none is lost. Elements of a set are distinct.

    Equal sets are searched for once and then stand for all their rows. In groups of up to ``small`` different sets each two
    are compared, as they would meet at several elements otherwise. In the others, prefix filter: the elements of the smaller set are
    put in order of rarity, and as many of the rarest are looked up in the larger one as must leave one hit (for a subset,
    the rarest). Both sides bring their set along, so that what doesn't share enough is left out where it's met, and a pair
    counts at the first element in common. Elements that more than a thousandth of all entries have meet their counts by a
    broadcast of the few such; those of more than ``block`` sets are looked up block by block.
    """
    rows = written(rows.filter(F.size("s") > 0).select("grp", "rep", F.array_sort("s").alias("s")).withColumn("set", F.min("rep").over(Window.partitionBy("grp", "s"))), "sets")
    sets = rows.filter(F.col("rep") == F.col("set")).select("grp", "set", "s")
    sizes = written(sets.groupBy("grp").agg(F.count(F.lit(1)).alias("sets")), "groups")
    sets = written(join_groups(sets, sizes, ["grp"], "sets", sets.count()), "sets")
    few = sets.filter(F.col("sets") <= small).drop("sets")
    entries = sets.filter(F.col("sets") > small).select("grp", "set", "s", F.explode("s").alias("x"))
    counts = written(entries.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    ranked = written(join_groups(entries, counts, ["grp", "x"], "n", entries.count(), "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")), "entries")
    # an element that is alone can't hit, but takes its place among the rarest
    ordered = ranked.groupBy("grp", "set").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "x", "blocks"))).alias("o"))
    size, sp = F.size("s"), F.size("sp")
    prefix = F.size("o") - F.ceil(F.size("o") * share - 1e-9).cast("int") + 1
    probes = ordered.select("grp", F.col("set").alias("p"), F.col("o.x").alias("sp"), F.explode(F.slice("o", 1, prefix)).alias("e")).filter("e.n > 1")
    probes = probes.select("grp", "p", "sp", F.col("e.x").alias("x"), F.explode(F.sequence(F.lit(0), F.col("e.blocks") - 1)).alias("at"))
    held = ranked.filter("n > 1").select("grp", "set", "s", "x", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("at"))
    later = (sp < size) | ((sp == size) & (F.col("p") < F.col("set")))
    common = F.array_intersect("sp", "s")
    enough = (size * share <= sp + 1e-9) & (F.size(common) >= size * share - 1e-9)
    enough = enough | (F.size(common) == sp) if subset else enough
    met = probes.join(held, ["grp", "x", "at"]).filter(later & (F.get(common, F.lit(0)) == F.col("x")) & enough).select("p", "set")
    each = few.select("grp", F.col("set").alias("p"), F.col("s").alias("sp")).join(few, "grp").filter(later & enough).select("p", "set")
    first, second = rows.select(F.col("set").alias("p"), F.col("rep").alias("ra")), rows.select("set", F.col("rep").alias("rb"))
    alike = first.join(second, F.col("p") == F.col("set")).filter("ra < rb").select("ra", "rb")
    pairs = met.union(each).join(first, "p").join(second, "set").select("ra", "rb").union(alike)
    return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def coded(names: list[str]) -> np.ndarray:
    """Names as rows of small numbers for their characters, filled up with -1."""
    lengths = np.array([len(t) for t in names])
    seen = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True)[1]
    codes = np.full((len(names), lengths.max(initial=0)), -1, np.int32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = seen
    return codes


def common_subsequences(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a coded name and each row of others, by bits: a bit of the first name
    falls to 0 where the length grows by one. A name of more than 64 characters takes several words, with a carry."""
    words = -(-len(one) // 64)
    masks = np.zeros((words, max(one.max(initial=0), others.max(initial=0)) + 2), np.uint64)
    for place, code in enumerate(one):
        masks[place // 64, code] |= np.uint64(1 << place % 64)
    state = np.full((words, len(others)), ~np.uint64(0))
    for column in np.ascontiguousarray(others.T):
        carry = None
        for w in range(words):
            v = state[w]
            u = v & masks[w, column]
            total = v + u
            over = total < v
            if carry is not None:
                total += carry
                over |= total < carry
            state[w] = total | (v - u)
            carry = over.astype(np.uint64)
    if words:
        state[-1] |= ~np.uint64(0) << np.uint64((len(one) - 1) % 64 + 1) if len(one) % 64 else np.uint64(0)
    return np.bitwise_count(~state).sum(axis=0).astype(np.int64)


@lru_cache(maxsize=1 << 18)
def name_ratio(x: str, y: str) -> float:
    """Sequence ratio; a worker remembers some, as entities of one name differ in aliases or identifiers."""
    return SequenceMatcher(None, x, y).ratio()


def compare_names(least: float, each_way: bool = False):
    """Task over ``grp, lo, hi, own, rep, norm``, sorted by the first three: the pairs of each pair of blocks. The ratio depends
    on the order of two names; with ``each_way`` a pair counts if one of its ratios does, and the other way's follows."""

    def compare(held):
        table = pa.Table.from_batches(held)
        same = table.column("lo")[0] == table.column("hi")[0]
        own, ids, names = table.column("own").to_numpy(), table.column("rep").to_numpy(), table.column("norm").to_pylist()
        counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64) for t in names]).astype(np.int32)
        lengths = np.array([len(t) for t in names])
        short = lengths <= LONG
        codes = coded([t if s else "" for t, s in zip(names, short)])
        a, b, ratios, backs = [], [], [], []
        for i in range(len(names) - 1):
            others = np.arange(i + 1, len(names))
            if not same:
                others = others[own[others] != own[i]]
            both = least * (lengths[i] + lengths[others]) - 1e-9
            fits = 2 * np.minimum(lengths[i], lengths[others]) >= both
            others, both = others[fits], both[fits]
            fits = 2 * np.minimum(counts[i], counts[others]).sum(axis=1) >= both
            others, both = others[fits], both[fits]
            if short[i]:
                fits = ~short[others]
                at = np.flatnonzero(short[others])
                fits[at] = 2 * common_subsequences(codes[i, : lengths[i]], codes[others[at], : lengths[others[at]].max(initial=0)]) >= both[at]
                others = others[fits]
            for j in others:
                x, y = (i, j) if ids[i] < ids[j] else (j, i)
                ratio = name_ratio(names[x], names[y])
                back = name_ratio(names[y], names[x]) if each_way else 0.0
                if max(ratio, back) >= least:
                    a.append(ids[x])
                    b.append(ids[y])
                    ratios.append(ratio)
                    backs.append(back)
        out = {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ratio": pa.array(ratios, pa.float64())}
        return pa.RecordBatch.from_pydict(out | ({"back": pa.array(backs, pa.float64())} if each_way else {}))

    def task(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if held and tuple(keys[s]) != key:
                        yield compare(held)
                        held = []
                    key = tuple(keys[s])
                    held.append(batch.slice(s, e - s))
        if held:
            yield compare(held)

    return task


def ratio_pairs(rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """``a, b, ratio, back``: the pairs ``a < b`` among ``rows(grp, rep, norm)`` of a group with a sequence ratio of at least
    ``least`` one way or the other; none is lost.

    A group is dealt into blocks by a hash, and each pair of blocks is compared by one task, which holds no more than two
    blocks. The ratio is at most twice the characters in common over both lengths, and the blocks that it sums are a common
    subsequence, so counts of characters and then the lengths of the longest common subsequences, one name against all
    at once, leave out nearly all pairs before two strings are compared by themselves.
    """
    sizes = written(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    dealt = join_groups(rows, sizes, ["grp"], "n", rows.count())
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    block = min(block, 256) if pairs < 64_000_000 else block  # few names, too, are spread over the tasks
    dealt = dealt.withColumn("k", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "norm")

    # comparing takes long for its bytes, so the parts are counted by the pairs to compare
    parts, where = int(min(4096, pairs // 50_000 + 1)), ["grp", "lo", "hi"]
    return dealt.repartition(parts, *where).sortWithinPartitions(*where).mapInArrow(compare_names(least, True), "a long, b long, ratio double, back double")


def _shared(x: str, y: str) -> Column:
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def _overlap(x: str, y: str) -> Column:
    """Share of common words, .9 at least if one has all of the other's."""
    inside = (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) == F.least(F.size(x), F.size(y)))
    return F.when(inside, F.greatest(_shared(x, y), F.lit(SUBSET_SCORE))).otherwise(_shared(x, y))


def _signals(ratio: Column, named: Column, overlap: Column, alias: Column, external: Column) -> dict[str, Column]:
    return {
        "external_id": F.when(external, EXTERNAL_SCORE), "fuzzy_name": F.when((ratio >= LEAST_SIGNAL) & named, ratio),
        "token_set": F.when(overlap >= LEAST_SIGNAL, overlap), "alias_match": F.when(alias > 0, alias),
    }


def _score(signals: dict[str, Column], bonus: Column) -> Column:
    """The largest signal plus the bonus, as their weighted mean is never larger; 1 at most, 0 without a signal."""
    best = F.greatest(*signals.values())
    return F.when(best.isNotNull(), F.least(F.lit(1.0), best + bonus)).otherwise(0.0)


def _reasons(signals: dict[str, Column]) -> Column:
    """The names of the signals that aren't null, in order: one of the constant arrays of their subsets."""
    names = sorted(signals)
    sets = [F.array(*[F.lit(k) for n, k in enumerate(names) if at >> n & 1]).cast("array<string>") for at in range(1 << len(names))]
    return F.get(F.array(*sets), sum((F.when(signals[k].isNotNull(), 1 << n).otherwise(0) for n, k in enumerate(names)), F.lit(0)))


def _once(x: DataFrame, **columns: Column) -> DataFrame:
    """``x`` with costly columns, each worked out once a row: what uses them isn't merged with what makes them."""
    return x.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def recommendation(score: Column) -> Column:
    return F.when(score >= AUTO_MERGE, "auto_merge").when(score >= SUGGEST, "suggest").otherwise("review")


# up to how many narrow rows, and how many with sets, are sent to every executor, which leaves the pairs where they are
SENT, SENT_SETS = 1_000_000, 200_000


class Looks:
    """The classes of ``keys``' groups by what is seen of them: classes that differ in external identifiers only are one look.

    Names and words are compared once for each two different names: of a group or, where that is less work, of all groups,
    as groups have names in common. ``classes`` gets ``grp``, ``look`` (its smallest ``rep``) and ``name`` (a number; null for
    an empty one); ``looks`` are ``look, grp, name, norm, tokens, aliases, members, kinds``. The score is the largest signal plus the bonus (a weighted mean is never
    above its largest part), so one signal alone must reach ``least`` less the bonus; each signal has a search that finds all
    pairs which do.
    """

    def __init__(self, classes: DataFrame, keys: list[str], least: float, ratio: bool = True, block: int = 1024):
        self.least, self.ratio, self.need = least, ratio, least - TYPE_BONUS
        alike = Window.partitionBy("grp", "norm", "aliases")
        grouped = classes.withColumn("grp", F.xxhash64(*keys))
        grouped = written(grouped.withColumns({"look": F.min("rep").over(alike), "members": F.sum("n").over(alike), "kinds": F.count(F.lit(1)).over(alike)}), "classes")
        names = written(grouped.filter("norm <> ''").select("grp", "norm", "tokens").dropDuplicates(["grp", "norm"]), "names")
        by_group = names.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        self.at_once = names.select("norm").distinct().count() ** 2 <= by_group
        if self.at_once:
            names = names.withColumn("grp", F.lit(0).cast("long")).dropDuplicates(["norm"])
        names = written(names.withColumn("name", F.monotonically_increasing_id()), "names")
        self.classes = written(grouped.join(names.select("norm", "name") if self.at_once else names.select("grp", "norm", "name"), ["norm"] if self.at_once else ["grp", "norm"], "left"), "classes")
        self.looks = self.classes.filter("rep = look")
        self.names = written(self._names(names, block), "near-names")

    def _names(self, names: DataFrame, block: int) -> DataFrame:
        """``x, y, xy, yx, overlap``: names ``x < y`` that are near by characters or words, with the ratio each way."""
        least = max(LEAST_SIGNAL, self.need)
        found = set_pairs(names.select("grp", F.col("name").alias("rep"), F.col("tokens").alias("s")), least, self.need <= SUBSET_SCORE)
        side = lambda k: names.select(F.col("name").alias(k), F.col("norm").alias(f"norm{k}"), F.col("tokens").alias(f"tokens{k}"))
        out = ["a", "b", "ratio", "back", _overlap("tokensa", "tokensb").alias("overlap")]
        sides = lambda x: x.join(side("a"), "a").join(side("b"), "b")
        if self.ratio:
            near = written(ratio_pairs(names.select("grp", F.col("name").alias("rep"), "norm"), least, block), "near")
            more = sides(found.join(near, ["a", "b"], "left_anti")).withColumns({"ratio": sequence_ratio("norma", "normb"), "back": sequence_ratio("normb", "norma")})
            both = sides(near).select(*out).union(more.select(*out))
        else:
            both = sides(found).withColumns({"ratio": F.lit(0.0), "back": F.lit(0.0)}).select(*out)
        return both.toDF("x", "y", "xy", "yx", "overlap")

    def _ratios(self, x: DataFrame, norma: str, normb: str, back: bool) -> DataFrame:
        """``x(name_a, name_b, ...)`` with ``known`` (the names are near), ``xy`` and, with ``back``, ``yx``."""
        forth = F.col("namea") < F.col("nameb")
        near = self.names.drop("overlap").withColumnsRenamed({"xy": "ratio", "yx": "other"})
        x = x.withColumns({"x": F.least("namea", "nameb"), "y": F.greatest("namea", "nameb")}).withColumns({"x": F.when(F.col("namea").isNotNull() & F.col("nameb").isNotNull(), F.col("x")), "one": F.coalesce(F.col("namea") == F.col("nameb"), F.lit(False))})
        x = x.join(near, ["x", "y"], "left").withColumn("known", F.col("ratio").isNotNull() | F.col("one"))
        same, none = F.lit(1.0 if self.ratio else 0.0), F.lit(0.0)
        given = lambda a, b: F.when(F.col("one"), same).when(forth, F.col(a)).otherwise(F.col(b))
        compared = lambda a, b: sequence_ratio(F.when(~F.col("known"), F.col(a)), F.col(b)) if self.ratio else none
        x = x.withColumn("xy", F.coalesce(given("ratio", "other"), compared(norma, normb)))
        return (x.withColumn("yx", F.coalesce(given("other", "ratio"), compared(normb, norma))) if back else x).drop("x", "y", "ratio", "other", "one")

    def pairs(self) -> DataFrame:
        """``p, q, xy, yx, overlap``: looks ``p < q`` of a group that are near by name, words or aliases; ``xy`` is the names'
        ratio as seen from ``p``, ``yx`` the other way's."""
        one = self.looks.filter("name is not null").select("grp", "look", "name")
        p, q = one.withColumnsRenamed({"look": "p", "name": "x"}), one.withColumnsRenamed({"look": "q", "name": "y"})
        met = p.join(bounded(self.names, SENT), "x").join(bounded(q, SENT), ["grp", "y"]).select("p", "q", "xy", "yx", "overlap")
        turned = F.col("p") > F.col("q")
        met = met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.when(turned, F.col("yx")).otherwise(F.col("xy")).alias("xy"), F.when(turned, F.col("xy")).otherwise(F.col("yx")).alias("yx"), "overlap")
        same = F.lit(1.0 if self.ratio else 0.0)
        alike = p.join(q.withColumnRenamed("y", "x"), ["grp", "x"]).filter("p < q").select("p", "q", same.alias("xy"), same.alias("yx"), F.lit(1.0).alias("overlap"))
        side = lambda k: self.looks.select(F.col("look").alias(k), *[F.col(c).alias(c + k) for c in ("name", "norm", "tokens")])
        aliases = set_pairs(self.looks.select("grp", F.col("look").alias("rep"), F.col("aliases").alias("s")), self.need, False)
        aliases = self._ratios(aliases.join(side("a"), "a").join(side("b"), "b"), "norma", "normb", True).filter("not known")
        return met.union(alike).union(aliases.select(F.col("a").alias("p"), F.col("b").alias("q"), "xy", "yx", _overlap("tokensa", "tokensb").alias("overlap")))

    def shown(self) -> DataFrame:
        """The looks whose own members are alike by name or aliases."""
        return self.looks.filter(F.col("name").isNotNull() | (F.size("aliases") > 0))

    def external(self) -> DataFrame:
        """``a, b``: classes of a group, ``a <> b`` both ways, that have an external identifier in common."""
        ids = self.classes.select("grp", "rep", F.explode("external").alias("x"))
        return ids.withColumnRenamed("rep", "a").join(ids.withColumnRenamed("rep", "b"), ["grp", "x"]).filter("a <> b").select("a", "b").distinct()

    def external_pairs(self) -> DataFrame:
        """``a, b`` with ``a < b``, their columns, ``xy``, ``overlap``, ``alias``, and ``found``: whether ``pairs`` or one look has them, too."""
        side = lambda k: self.classes.select(F.col("rep").alias(k), *[F.col(c).alias(c + k) for c in ("look", "user_id", "entity_type", "name", "norm", "tokens", "aliases", "n")])
        x = self.external().filter("a < b").join(side("a"), "a").join(side("b"), "b")
        x = self._ratios(x, "norma", "normb", False)
        met = (F.size("aliasesa") > 0) & (F.size("aliasesb") > 0) & (F.size(F.array_intersect("aliasesa", "aliasesb")) >= F.greatest(F.size("aliasesa"), F.size("aliasesb")) * self.need - 1e-9)
        return x.withColumns({"found": F.col("known") | met, "overlap": _overlap("tokensa", "tokensb"), "alias": _shared("aliasesa", "aliasesb")})


def class_pairs(classes: DataFrame, least: float = MIN_PAIR_SCORE, ratio: bool = True, block: int = 1024) -> DataFrame:
    """Pairs of classes of a user and type with a score of at least ``least``: those of two looks that are near, those of one
    look, and those that only an external identifier links."""
    seen = Looks(classes, ["user_id", "entity_type"], least, ratio, block)
    one = seen.shown().filter("kinds > 1").select(F.col("look").alias("p"), F.col("look").alias("q"), F.lit(1.0 if ratio else 0.0).alias("xy"), F.lit(1.0 if ratio else 0.0).alias("yx"), F.when(F.size("tokens") > 0, 1.0).otherwise(0.0).alias("overlap"))
    side = lambda k: seen.classes.select(F.col("look").alias(k), *[F.col(c).alias(c + k) for c in ("rep", "user_id", "entity_type", "aliases", "external", "n")], (F.col("norm") != "").alias(f"named{k}"))
    few = seen.classes.limit(SENT_SETS + 1).count() <= SENT_SETS
    met = lambda x, k: x.join(F.broadcast(side(k)) if few else side(k).hint("shuffle_hash"), k)
    x = met(met(seen.pairs().union(one), "p"), "q").filter(F.col("user_idp").eqNullSafe(F.col("user_idq")) & ((F.col("p") < F.col("q")) | (F.col("repp") < F.col("repq"))))
    x = _once(x, alias=_shared("aliasesp", "aliasesq"), external=F.arrays_overlap("externalp", "externalq"))
    shared = x.select(
        F.col("user_idp").alias("user_id"), F.col("entity_typep").alias("entity_type"), F.least("repp", "repq").alias("a"), F.greatest("repp", "repq").alias("b"), (F.col("np") * F.col("nq")).cast("double").alias("n_pairs"),
        F.when(F.col("repp") < F.col("repq"), F.col("xy")).otherwise(F.col("yx")).alias("ratio"), "overlap", "alias", "external", (F.col("namedp") & F.col("namedq")).alias("named"),
    )
    linked = seen.external_pairs().filter("not found").select(
        F.col("user_ida").alias("user_id"), F.col("entity_typea").alias("entity_type"), "a", "b", (F.col("na") * F.col("nb")).cast("double").alias("n_pairs"), F.col("xy").alias("ratio"), "overlap", "alias", F.lit(True).alias("external"),
        ((F.col("norma") != "") & (F.col("normb") != "")).alias("named"),
    )
    x = shared.unionByName(linked)
    signals = _signals(F.col("ratio"), F.col("named"), F.col("overlap"), F.col("alias"), F.col("external"))
    x = x.withColumn("score", _score(signals, F.lit(TYPE_BONUS))).filter(F.col("score") >= least).withColumn("reasons", _reasons(signals))
    return x.select("user_id", "entity_type", "a", "b", "n_pairs", "ratio", "overlap", "alias", "external", "score", "reasons")


def copies(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Each further member of a class with the first one; ``n_pairs`` adds up to all pairs of the class."""
    several = classes.filter((F.col("n") > 1) & ((F.col("norm") != "") | (F.size("aliases") > 0) | (F.size("external") > 0)))
    rows = join_groups(members, several, ["class"], "n", members.count()).filter("id <> rep")
    named, other = F.col("norm") != "", lambda c: F.size(c) > 0
    reasons = F.array_sort(F.filter(F.array(F.when(other("external"), "external_id"), F.when(named, "fuzzy_name"), F.when(other("tokens"), "token_set"), F.when(other("aliases"), "alias_match")), lambda r: r.isNotNull()))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return rows.select("user_id", "entity_type", F.col("rep").alias("a"), F.col("id").alias("b"), (F.col("n") / 2).alias("n_pairs"), one(named).alias("ratio"), one(other("tokens")).alias("overlap"), one(other("aliases")).alias("alias"), other("external").alias("external"), F.lit(1.0).alias("score"), reasons.alias("reasons"))


def entity_pairs(entities: DataFrame, least: float = MIN_PAIR_SCORE, ratio: bool = True, block: int = 1024) -> DataFrame:
    """M1, C14: pairs ``a < b`` of entities of a user and type with a score of at least ``least``, with their signals.

    External identifier .99 (weight 5), sequence ratio of the names from .6 (2), share of common words from .6, .9 at least
    if one has all of the other's (1.5), share of common aliases (2): the largest of them or their weighted mean, plus .05,
    1 at most. No pair of different classes is lost; copies are given once each, with their class's first member, and
    ``n_pairs`` tells for how many pairs a row stands.
    """
    members, classes = entity_classes(entities)
    out = class_pairs(classes, least, ratio, block).unionByName(copies(members, classes))
    rounded = {c: F.round(c, 6) for c in ("ratio", "overlap", "alias", "score")}
    return out.withColumn("recommendation", recommendation(F.col("score"))).withColumns(rounded)


def pair_sums(entities: DataFrame, least: float = MIN_PAIR_SCORE, ratio: bool = True, block: int = 1024) -> DataFrame:
    """The pairs of ``entity_pairs`` summed up for clusters: ``a, b, n_pairs, score, reasons``.

    A row stands for all pairs of two looks that have one score, and for its part of the pairs inside a look. Pairs that
    share an external identifier are rows of their own; those inside a look with no pairs to count again.
    """
    members, classes = entity_classes(entities)
    seen = Looks(classes, ["user_id", "entity_type"], least, ratio, block)
    none, out = F.lit(None).cast("boolean"), ["a", "b", "n_pairs", "score", "reasons"]
    full = lambda named, alias, external: _reasons(_signals(F.lit(1.0), named, F.when(named, 1.0).otherwise(0.0), F.when(alias, 1.0).otherwise(0.0), external))
    named, alias = F.col("name").isNotNull(), F.size("aliases") > 0
    of = join_groups(members.select("id", "class"), written(seen.classes.select("class", "rep", "look", "name", "aliases", "external", "n", "members"), "classes"), ["class"], "n", members.count())
    star = of.filter((named | alias) & (F.col("id") != F.col("look"))).select(F.col("look").alias("a"), F.col("id").alias("b"), (F.col("members") / 2).alias("n_pairs"), F.lit(1.0).alias("score"), full(named, alias, none).alias("reasons"))
    again = of.filter((F.size("external") > 0) & (F.col("id") != F.col("rep")))
    again = again.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.when(named | alias, 0.0).otherwise(F.col("n") / 2).alias("n_pairs"), F.lit(1.0).alias("score"), full(named, alias, F.lit(True)).alias("reasons"))

    linked = written(seen.external_pairs().filter(F.col("user_ida").eqNullSafe(F.col("user_idb"))).select(
        "a", "b", F.least("looka", "lookb").alias("p"), F.greatest("looka", "lookb").alias("q"), (F.col("looka") < F.col("lookb")).alias("forth"), (F.col("looka") == F.col("lookb")).alias("inside"), (F.col("na") * F.col("nb")).cast("double").alias("n"),
        F.col("xy").alias("ratio"), "overlap", "alias", ((F.col("norma") != "") & (F.col("normb") != "")).alias("named"), (F.col("namea").isNotNull() | (F.size("aliasesa") > 0)).alias("shown"),
    ), "linked")
    signals = _signals(F.col("ratio"), F.col("named"), F.col("overlap"), F.col("alias"), F.lit(True))
    links = linked.select("a", "b", F.when(F.col("inside") & F.col("shown"), 0.0).otherwise(F.col("n")).alias("n_pairs"), _score(signals, F.lit(TYPE_BONUS)).alias("score"), _reasons(signals).alias("reasons"))
    less = linked.filter("not inside").groupBy("p", "q").agg(F.sum(F.when(F.col("forth"), F.col("n")).otherwise(0.0)).alias("forths"), F.sum("n").alias("linked"))

    parts = seen.classes.groupBy("look").agg(F.array_sort(F.collect_list(F.struct("rep", "n"))).alias("parts"))
    looks = written(seen.looks.join(parts, "look").select("look", "user_id", "aliases", (F.col("norm") != "").alias("named"), F.col("members").cast("double").alias("members"), "parts"), "looks")
    few = looks.limit(SENT_SETS + 1).count() <= SENT_SETS
    side = lambda k: looks.select(F.col("look").alias(k), *[F.col(c).alias(c + k) for c in looks.columns[1:]])
    met = lambda x, k: x.join(F.broadcast(side(k)) if few else side(k).hint("shuffle_hash"), k)
    x = met(met(seen.pairs(), "p"), "q").filter(F.col("user_idp").eqNullSafe(F.col("user_idq"))).join(bounded(written(less, "less"), SENT), ["p", "q"], "left").fillna(0.0, ["forths", "linked"])
    after = lambda e: F.aggregate("partsq", F.lit(0.0), lambda n, f: n + F.when(f["rep"] > e["rep"], f["n"]).otherwise(0))
    ordered = F.aggregate("partsp", F.lit(0.0), lambda n, e: n + e["n"] * after(e))
    # where the ratio doesn't depend on the order, all pairs of two looks have one score
    turns, every = F.col("xy") != F.col("yx"), F.col("membersp") * F.col("membersq")
    x = _once(x, alias=_shared("aliasesp", "aliasesq"), first=F.when(turns, ordered).otherwise(every)).withColumn("named", F.col("namedp") & F.col("namedq"))
    ways = F.array(F.struct(F.col("xy").alias("ratio"), (F.col("first") - F.when(turns, F.col("forths")).otherwise(F.col("linked"))).alias("n_pairs")), F.struct(F.col("yx").alias("ratio"), F.when(turns, every - F.col("first") - F.col("linked") + F.col("forths")).otherwise(0.0).alias("n_pairs")))
    signals = _signals(F.col("ratio"), F.col("named"), F.col("overlap"), F.col("alias"), none)
    x = x.select(F.col("p").alias("a"), F.col("q").alias("b"), "overlap", "alias", "named", F.inline(ways)).filter("n_pairs > 0")
    x = x.withColumn("score", _score(signals, F.lit(TYPE_BONUS))).filter(F.col("score") >= least).withColumn("reasons", _reasons(signals))
    return x.select(*out).union(star).union(again).union(links)


def entity_clusters(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """M1: ``id, cluster_id, canonical_id, size, max_confidence, avg_confidence, match_reasons, recommendation``: clusters of
    chained pairs, from ``entity_pairs`` or their ``pair_sums``. The canonical entity is the most frequent one, the smallest
    identifier of equal ones; confidences are over all pairs of the cluster, copies included."""
    pairs = written(pairs.select("a", "b", "n_pairs", "score", "reasons"), "pairs")
    roots = written(connected_components(spanning(pairs.select("a", "b"))).withColumnsRenamed({"v": "id", "root": "cluster_id"}), "roots")
    members = roots.join(entities.select("id", "occurrence_count"), "id")
    top = members.groupBy("cluster_id").agg(F.min(F.struct((-F.coalesce("occurrence_count", F.lit(0))).alias("n"), "id"))["id"].alias("canonical_id"), F.count(F.lit(1)).alias("size"))
    by_first = pairs.groupBy(F.col("a").alias("id")).agg(F.max("score").alias("score"), F.sum(F.col("score") * F.col("n_pairs")).alias("sum"), F.sum("n_pairs").alias("n_pairs"), F.collect_set("reasons").alias("reasons"))
    links = by_first.withColumn("reasons", F.array_distinct(F.flatten("reasons"))).join(roots, "id").groupBy("cluster_id").agg(
        F.round(F.max("score"), 4).alias("max_confidence"), F.round(F.sum("sum") / F.sum("n_pairs"), 4).alias("avg_confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("match_reasons"), recommendation(F.max("score")).alias("recommendation"),
    )
    found = cut_lineage(top.join(links, "cluster_id"))
    return join_groups(members.select("id", "cluster_id"), found, ["cluster_id"], "size", roots.count())


def candidates(entities: DataFrame, least: float = MIN_PAIR_SCORE, k: int = 20, block: int = 1024) -> DataFrame:
    """M3: ``a, b, confidence, rank``: for each entity the ``k`` best others of its user, of any type, with at least ``least``;
    of equal scores the smaller identifiers.

    Pairs of looks are ranked before their members are: a look keeps those that may be among the first ``k + 1`` members,
    once of any type, and once of each type with the bonus. The order of two first members decides their ratio, so what
    scores surely counts, and what may score better is kept until classes have their own lists. An entity's list is its
    class's one without itself.
    """
    members, classes = entity_classes(entities)
    seen = Looks(classes, ["user_id"], least, True, block)
    looks = written(seen.looks.select("look", "user_id", "aliases", (F.col("norm") != "").alias("named"), "members"), "looks")
    side = lambda s: bounded(looks, SENT_SETS).select(F.col("look").alias(s), *[F.col(c).alias(c + s) for c in looks.columns[1:]])
    x = seen.pairs().join(side("p"), "p").join(side("q"), "q").filter(F.col("user_idp").eqNullSafe(F.col("user_idq")))
    x = _once(x, alias=_shared("aliasesp", "aliasesq")).withColumn("named", F.col("namedp") & F.col("namedq"))
    value = lambda ratio: _score(_signals(F.col(ratio), F.col("named"), F.col("overlap"), F.col("alias"), F.lit(None).cast("boolean")), F.lit(0.0))
    x = written(x.select("p", "q", "membersp", "membersq", value("xy").alias("forth"), value("yx").alias("back")), "near")
    one = seen.shown().select(F.col("look").alias("p"), F.col("look").alias("q"), "members", F.lit(1.0).alias("forth"), F.lit(1.0).alias("back"))
    near = x.select("p", "q", "membersq", "forth", "back").union(x.select("q", "p", "membersp", "back", "forth")).union(one)

    # as of which score k + 1 members are sure, of any type; scores are as the lists show them, 0 is no pair
    shown = lambda c, bonus: F.when(F.least(F.lit(1.0), F.col(c) + bonus) >= least, F.round(F.least(F.lit(1.0), F.col(c) + bonus), 4)).otherwise(0.0)
    levels = near.groupBy("p", F.least(shown("forth", 0.0), shown("back", 0.0)).alias("level")).agg(F.sum("membersq").alias("n")).filter("level > 0")
    sure = levels.withColumn("n", F.sum("n").over(Window.partitionBy("p").orderBy(F.desc("level")))).filter(F.col("n") > k).groupBy("p").agg(F.max("level").alias("sure"))
    sure = written(sure, "sure")
    kept = near.join(bounded(sure, SENT), "p", "left").fillna(0.0, ["sure"]).filter(F.greatest(shown("forth", TYPE_BONUS), shown("back", TYPE_BONUS)) >= F.col("sure"))
    kept = written(kept.select("p", F.col("q").alias("look"), "forth", "back", "sure"), "kept")

    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    of = join_groups(members.select("id", "class"), written(seen.classes.select("class", "rep", "look", "entity_type", "n"), "classes"), ["class"], "n", members.count()).drop("n")
    of = written(of.withColumns({"at_look": place("look"), "at_type": place("look", "entity_type"), "at_class": place("class")}).filter(F.col("at_class") <= k + 1), "members")

    def lists(by: list[str], bonus: float, at: str) -> DataFrame:
        rows = kept.filter(F.greatest(shown("forth", bonus), shown("back", bonus)) >= F.greatest("sure", F.lit(1e-4))) if not bonus else kept
        rows = rows.join(of.select("look", "id", "rep", "entity_type", at), "look").filter((F.col(at) <= k + 1) | (F.col("forth") != F.col("back")))
        rows = rows.select("p", "id", "rep", "entity_type", shown("forth", bonus).alias("forth"), shown("back", bonus).alias("back"))
        low, high = F.least("forth", "back"), F.greatest("forth", "back")
        rows = rows.select("*", F.explode(F.array_distinct(F.array(low, high))).alias("score")).filter("score > 0")
        surely = F.coalesce(F.sum((F.col("score") == low).cast("int")).over(Window.partitionBy(*by).orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("before", surely).filter((F.col("score") == high) & (F.col("before") <= k)).drop("score", "before")

    own = seen.classes.select(F.col("rep").alias("a"), F.col("look").alias("p"), F.col("entity_type").alias("type"))
    valued = ["a", "id", F.when(F.col("a") < F.col("rep"), F.col("forth")).otherwise(F.col("back")).alias("score")]
    any_type = lists(["p"], 0.0, "at_look").join(own, "p").filter("type <> entity_type").select(*valued)
    one_type = lists(["p", "entity_type"], TYPE_BONUS, "at_type").join(own.withColumnRenamed("type", "entity_type"), ["p", "entity_type"]).select(*valued)
    # identifiers in common, also of a class with itself
    alike = seen.external().union(seen.classes.filter(F.size("external") > 0).select("rep", "rep"))
    linked = alike.join(own.join(bounded(sure, SENT), "p", "left"), "a").join(of.select(F.col("rep").alias("b"), "id", "entity_type"), "b")
    linked = linked.withColumn("score", F.when(F.col("type") == F.col("entity_type"), F.least(F.lit(1.0), F.lit(EXTERNAL_SCORE) + TYPE_BONUS)).otherwise(EXTERNAL_SCORE))
    linked = linked.filter((F.col("score") >= least) & (F.col("score") >= F.coalesce("sure", F.lit(0.0)))).select("a", "id", F.round("score", 4).alias("score"))
    best = any_type.union(one_type).filter("score > 0").union(linked).groupBy("a", F.col("id").alias("other")).agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= k + 1)
    best = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("list"))
    keyed = written(seen.classes.select("class", "n", F.col("rep").alias("a")).join(best, "a"), "lists")
    each = join_groups(members, keyed, ["class"], "n", members.count())
    mine = F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("a"), F.posexplode(mine).alias("p", "e")).select("a", F.col("e.other").alias("b"), F.col("e.score").alias("confidence"), (F.col("p") + 1).cast("long").alias("rank"))


def scan_stats(entities: DataFrame, auto: float = 0.95, k: int = 10) -> DataFrame:
    """For each entity, of its ``k`` best candidates, how many were found, would be merged, and would be suggested."""
    c = F.col("confidence")
    counts = candidates(entities, k=k).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("duplicates_found"), F.count(F.when(c >= auto, 1)).alias("auto_merged"), F.count(F.when((c < auto) & (c >= SUGGEST), 1)).alias("suggested"))
    return entities.select("id").join(counts, "id", "left").fillna(0)


def should_merge(entities: DataFrame) -> DataFrame:
    """M5: ``a, b``: pairs of a user and type with the same name but for case, one's name among the other's aliases, or an
    external identifier in common. Entities alike in all three are given once each with their first member, which stands
    for them in the other pairs."""
    alike = ["user_id", "kind", "x", "named", "external"]
    rows = entities.select("id", "user_id", F.coalesce("entity_type", F.lit("unknown")).alias("kind"), F.lower(F.coalesce("name", F.lit(""))).alias("x"),
                           F.array_sort(F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))).alias("named"),
                           F.array_sort(F.filter(F.map_entries(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())).alias("external"))
    rows = cut_lineage(rows.withColumns({"grp": F.xxhash64("user_id", "kind"), "class": F.xxhash64(*alike)}))
    classes = cut_lineage(rows.groupBy("class", "grp", *alike[2:]).agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("n")))
    names = classes.select("grp", "p", "x")
    known = names.union(classes.select("grp", "p", F.explode("named"))).withColumnRenamed("p", "q")
    met = names.join(known, ["grp", "x"]).filter("p <> q").select("p", "q")
    ids = classes.select("grp", "p", F.explode("external").alias("x"))
    shared = ids.join(ids.withColumnRenamed("p", "q"), ["grp", "x"]).filter("p < q").select("p", "q")
    star = join_groups(rows.select("id", "class"), classes.filter("n > 1").select("class", "p", "n"), ["class"], "n", rows.count()).filter("id <> p").select("p", F.col("id").alias("q"))
    return met.union(shared).union(star).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def merge_entities(entities: DataFrame, links: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: entities and links after each cluster's members (``id, canonical_id``) were merged into the canonical one.

    Counts are added (a missing one is 1), the first and last dates span all, external identifiers are united (of one key
    the canonical entity's goes, as later ones overwrite it; the largest identifier's value stays), and the aliases are all
    members' aliases and the others' names, sorted. Links go to the canonical entity, once per activity, with the largest
    relevance.
    """
    to = clusters.select("id", "canonical_id")
    moved = entities.join(to, "id", "left").withColumn("new_id", F.coalesce("canonical_id", "id")).withColumn("kept", F.col("id") == F.col("new_id"))
    alias = F.filter(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(~F.col("kept"), F.array("name")).otherwise(F.array().cast("array<string>"))), lambda a: a.isNotNull() & (a != ""))
    per_key = moved.select("new_id", "kept", "id", F.explode(F.map_entries("external_ids")).alias("e")).groupBy("new_id", F.col("e.key").alias("key")).agg(F.max(F.struct((~F.col("kept")).alias("other"), "id", F.col("e.value").alias("value")))["value"].alias("value"))
    ids = per_key.groupBy("new_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("external_ids"))
    merged = moved.withColumn("alias", alias).groupBy("new_id").agg(
        F.sum(F.when(F.col("canonical_id").isNull(), F.col("occurrence_count")).otherwise(F.coalesce(F.nullif("occurrence_count", F.lit(0)), F.lit(1)))).alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("alias")))).alias("aliases"), F.max(F.when(F.col("kept"), F.col("name"))).alias("name"),
    )
    out = links.join(to, links.entity_id == to.id, "left").select("activity_id", F.coalesce("canonical_id", "entity_id").alias("entity_id"), "relevance_score")
    return merged.join(ids, "new_id", "left").withColumnRenamed("new_id", "id"), out.groupBy("activity_id", "entity_id").agg(F.max("relevance_score").alias("relevance_score"))
