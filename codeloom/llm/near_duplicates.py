"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch holds the smallest
values of its set. Inverted lists of the retained values give the candidates
and their overlaps, the sketch of a pair's union estimates its similarity, and
the full sets decide. Documents with equal sets are one class throughout.

A list of at most ``SHORT`` classes gives all its pairs. Longer lists come from
content that very many classes share. With more rare values than a similar class
can lack, a class shares some with it and is found in the short lists; all others
go on in long lists: each is compared with two classes of each list. Those whose lists
are still of several components after that meet by the rarest values of their whole
sets, so that texts which share a template, but not enough, never meet at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import bind
from codeloom.llm.common import SPACE, stage, whole_texts
from codeloom.llm.components import components

SKETCH = 64  # values of a sketch
RETAINED = 48  # of these, values that lead inverted lists
SHORT = 32
MISS = 1e-7  # chance that a pair at the similarity wanted lacks more than lacked
WIDE = 256  # values of a sketch that leaves out pairs of the longest lists, 32 bits each
BLOCK = 128  # members of a list that one task compares with all others
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingles(text: Column, size: int) -> Column:
    """Sorted distinct hashes of ``size``-word shingles; see :func:`near_duplicates`."""
    plain = F.translate(text, _UPPER + SPACE, _UPPER.lower() + " " * len(SPACE))
    words = F.array_remove(F.split(plain, " "), "")

    def hashed(words: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]),
        )
        return (
            F.when(F.size(words) >= size, F.sort_array(F.array_distinct(runs)))
            .when(F.size(words) > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return bind(words, hashed)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, key_a, key_b, sketch``; equal keys mean equal sets."""
    described = bind(
        shingles(F.col("text"), size),
        lambda s: F.struct(
            F.size(s).alias("n"),
            F.xxhash64(s).alias("key_a"),
            F.xxhash64(F.lit(size), s).alias("key_b"),
            F.slice(s, 1, SKETCH).alias("sketch"),
        ),
    )
    return docs.select("doc_id", described.alias("s")).select("doc_id", "s.*")


def _sizes_allow(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def lacked(percent: int, values: int) -> int:
    """Most of a union's lowest ``values`` that similar sets do not share, but for ``MISS``.

    Each is shared with a chance of ``percent`` at least.
    """
    unlike, tail = 1 - percent / 100, 0.0
    for m in range(values, 0, -1):
        tail += math.comb(values, m) * unlike**m * (1 - unlike) ** (values - m)
        if tail > MISS:
            return m
    return 0


def _lacking(percent: int) -> Column:
    """Most retained values of a class of ``n`` that a similar class does not retain.

    The values that both retain include the shared ones of the union's lowest
    ``RETAINED``. Which of a class's values are rare plays no part: all that is
    lacked may be.
    """
    exact = F.col("n") - F.ceil(F.col("n") * percent / 100)  # both sets are retained whole
    whole = 100 * F.col("n") <= RETAINED * percent
    return F.when(whole, exact).otherwise(lacked(percent, RETAINED)).cast("int")


def _lists(classes: DataFrame) -> DataFrame:
    """``rep, n, values, rare`` of each class in a list of two or more classes.

    ``values`` are the class's retained values that lead such lists, with the
    list's length ``c``, the rarest first (at most ``RETAINED``); ``rare`` is the
    number of its retained values that lead no long list.
    """
    entries = classes.select("rep", "n", F.explode(F.slice("sketch", 1, RETAINED)).alias("v"))
    lengths = entries.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    values = F.sort_array(F.collect_list(F.struct("c", "v"))).alias("values")
    lists = entries.join(lengths, "v").groupBy("rep", "n").agg(values)
    common = F.size(F.filter("values", lambda x: x["c"] > SHORT))
    return stage(lists.withColumn("rare", F.least("n", F.lit(RETAINED)) - common), "lists")


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b, least``: a row for each short list that a pair shares.

    A similar pair shares ``least`` of them, as both lack few of their rare values.
    """
    short = F.explode(F.filter("values", lambda x: x["c"] <= SHORT)).alias("value")
    least = F.col("rare") - _lacking(percent)
    members = lists.select("rep", "n", least.alias("least"), short).groupBy("value.v").agg(
        F.collect_list(F.struct("rep", "n", "least")).alias("all")  # at most SHORT
    )
    one = members.select("all", F.explode("all").alias("x"))
    pairs = one.select("x", F.explode(F.filter("all", lambda y: y["rep"] > F.col("x.rep"))).alias("y"))
    sized = pairs.withColumns({"na": F.col("x.n"), "nb": F.col("y.n")}).filter(_sizes_allow(percent))
    return sized.select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.greatest("x.least", "y.least").alias("least")
    )


def _common_entries(lists: DataFrame, percent: int) -> DataFrame:
    """``v, rep, n, mass``: long lists, of classes whose rare values may all be lacked.

    Of such a class the rarest values lead, one more than can be lacked, so a
    similar class has one of these among its own rarest. Values that no other
    class has are the rarest of all and lead nothing.
    """
    own = F.least("n", F.lit(RETAINED)) - F.size("values")
    wanted = F.greatest(_lacking(percent) + 1 - own, F.lit(0))
    mass = F.aggregate("values", F.lit(0).cast("long"), lambda sum, x: sum + x["c"]) / F.size("values")
    return (
        lists.filter(F.col("rare") <= _lacking(percent))
        .select("rep", "n", mass.alias("mass"), F.inline(F.slice("values", F.lit(1), wanted)))
        .filter(F.col("c") > SHORT)
        .select("v", "rep", "n", "mass")
    )


def _spokes(common: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the members of each long list with two of them.

    These are the one whose values are the most common of all, as copies differ
    least from their original, and one by chance.
    """
    end = [F.col("rep").alias("b"), F.col("n").alias("nb")]
    typical = F.max(F.struct("mass", (-F.col("rep")).alias("order"), *end))
    drawn = F.min(F.struct(F.xxhash64("rep", "v").alias("draw"), *end))
    heads = common.groupBy("v").agg(typical.alias("typical"), drawn.alias("drawn"))
    ends = F.array(*[F.struct(f"{head}.b", f"{head}.nb") for head in ("typical", "drawn")])
    met = common.join(heads, "v").select(F.col("rep").alias("a"), F.col("n").alias("na"), F.inline(ends))
    return met.filter((F.col("a") != F.col("b")) & _sizes_allow(percent)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )


def _alike(one: str, other: str, values: int, percent: int, slack: int = 0) -> Column:
    """Whether the sketch of the union, of ``values``, does not rule the similarity out.

    ``slack`` of the shared values may have been lost, as values got too short.
    """
    union = F.slice(F.sort_array(F.array_union(one, other)), 1, values)
    both = F.array_intersect(one, other)

    def close(union: Column) -> Column:
        size, shared = F.size(union), F.size(F.array_intersect(union, both)) + slack
        whole = 100 * shared >= percent * size  # a smaller union is in the sketches as a whole
        return F.when(size < values, whole).otherwise(size - shared <= lacked(percent, values))

    return bind(union, close)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union's sketch does not rule the similarity out."""
    sketches = classes.select("rep", "sketch")
    joined = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
    return joined.filter(_alike("sa", "sb", SKETCH, percent)).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    joined = pairs.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return joined.filter(100 * common >= percent * union).select("a", "b")


def _leading(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``v, rep, n, g, at, first``: the rarest values of each whole set, as many as decide.

    Of two sets similar enough the larger lacks few of its values in the smaller,
    so both have a common value among these few rarest ones of each. ``first``
    marks those that decide against partners which are as large or larger: such
    a partner shares more, so fewer values do. Values of one set only are the
    rarest of all and lead nothing.
    """
    full = rest.select("rep", "g").distinct().join(sets, "rep")
    values = full.select("rep", "g", F.size("s").alias("n"), F.explode("s").alias("v"))
    lengths = values.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    shared = (
        values.join(lengths, "v").groupBy("rep", "g", "n")
        .agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("values"))
    )
    n, own = F.col("n"), F.col("n") - F.size("values")
    decide = n - F.ceil(n * percent / 100) + 1 - own
    decide_first = n - F.ceil(n * (2 * percent) / (100 + percent)) + 1 - own
    slack = 1  # a value more than needed, whatever the divisions round to
    kept = F.slice("values", F.lit(1), F.greatest(decide + slack, F.lit(0)).cast("int"))
    placed = shared.withColumns({"limit": decide_first + slack, "own": own}).select(
        "rep", "g", "n", "own", "limit", F.posexplode(kept).alias("rank", "value")
    )
    at, first = F.col("own") + F.col("rank"), F.col("rank") < F.col("limit")
    return placed.select("value.v", "rep", "n", "g", at.alias("at"), first.alias("first"))


def _open_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components, of sets that share a leading value.

    In each list the members of its largest component meet only the others.
    These are dealt in blocks of ``BLOCK``, each of which meets all members. The
    sketches travel with the members and leave out, in the join, the pairs that
    cannot be similar; whole sets, far wider, decide the others.
    """
    leading = stage(_leading(rest, sets, percent), "leading")
    per_group = leading.groupBy("v", "g").agg(F.count("*").alias("members"))
    lists = per_group.groupBy("v").agg(
        F.max(F.struct("members", "g")).alias("largest"), F.sum("members").alias("c"), F.count("*").alias("groups")
    )
    strays = F.col("c") - F.col("largest.members")
    blocks = F.ceil(strays / BLOCK).cast("int")
    split = lists.filter("groups > 1").select("v", F.col("largest.g").alias("main"), blocks.alias("blocks"))
    high = F.transform(F.slice("s", 1, WIDE), lambda v: F.shiftright(v, 32).cast("int"))  # in the same order
    sketches = sets.select("rep", high.alias("sketch"))
    members = leading.join(split, "v").join(sketches.hint("merge"), "rep")
    member = F.struct("rep", "n", "g", "at", "first", "sketch")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    left = members.filter("g <> main").select("v", block, member.alias("x"))
    right = members.select(
        F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), member.alias("y")
    )
    smaller = F.struct("x.n", "x.rep") < F.struct("y.n", "y.rep")
    decided = F.when(smaller, F.col("x.first")).otherwise(F.col("y.first"))
    # If this is the first value both have, they share no more than what is left of either.
    left_over = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = (100 + percent) * left_over >= percent * (F.col("x.n") + F.col("y.n"))
    met = (F.col("v") == F.col("w")) & (F.col("block") == F.col("part")) & (F.col("x.g") != F.col("y.g"))
    alike = _alike("x.sketch", "y.sketch", WIDE, percent, slack=2)
    pairs = left.join(right.hint("merge"), met & decided & enough & alike)
    named = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return _linked(stage(named.distinct(), "open"), sets, percent)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are runs without white space, A-Z lower-cased. A set holds the
    distinct ``size``-word shingles; a text of fewer words is one shingle, a
    text without words (or null) has the empty set and is linked with nothing.
    Rows are linked if ``100 * |intersection| >= percent * |union|``;
    ``component_id`` is the smallest ``doc_id`` reachable. A row without
    ``doc_id`` is linked with nothing, has no ``component_id`` and is kept.
    Repeated rows of one ``doc_id`` share their component, so all or none of
    them is kept. An empty table gives no rows.
    """
    texts = whole_texts(docs)
    signed = stage(signatures(texts, size), "signatures")
    named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    keys = ["n", "key_a", "key_b"]
    classes = stage(
        named.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")),
        "classes",
    )
    lists = _lists(classes)
    common = stage(_common_entries(lists, percent), "common")
    met = (
        _short_pairs(lists, percent).withColumn("spoke", F.lit(False))
        .unionByName(_spokes(common, percent).withColumns({"least": F.lit(None), "spoke": F.lit(True)}))
        .groupBy("a", "b").agg(F.count("least").alias("overlap"), F.max("least").alias("least"), F.max("spoke").alias("spoke"))
        .filter("spoke or overlap >= least").select("a", "b")
    )
    pairs = stage(_plausible(met, classes, percent), "pairs")

    # Full sets of the classes any comparison needs, read from their texts once.
    needed = pairs.select("a").union(pairs.select("b")).union(common.select("rep")).toDF("doc_id")
    needed = stage(needed.distinct(), "needed")  # sent to every task only if Spark finds it small
    sets = stage(
        texts.join(needed, "doc_id")
        .select(F.col("doc_id").alias("rep"), shingles(F.col("text"), size).alias("s")),
        "sets",
    )
    groups = components(stage(_linked(pairs, sets, percent), "found"))

    # Long lists of several components: their members go on by their whole sets.
    placed = common.join(groups.toDF("rep", "g"), "rep", "left").select("v", "rep", F.coalesce("g", "rep").alias("g"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("v").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high")
    rest = placed.join(mixed.select("v"), "v", "left_semi")
    late = stage(_open_links(rest, sets, percent), "late")
    stars = groups.filter("node <> component").toDF("a", "b")
    final = groups if late.isEmpty() else components(stars.unionByName(late))

    members = (
        classes.join(final.toDF("rep", "component"), "rep", "left")
        .select(*keys, F.coalesce("component", "rep").alias("component"))
    )
    joined = signed.join(members, keys, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
