"""All links of 0.75 similarity between sets of different components, without meeting all pairs.

Sets that share much without being alike (texts of one template, of one hot passage) crowd together,
and testing their pairs grows with the square of a crowd. Here a pair is looked at only if it
shares an element that can decide it:

* An element is common if more than `often` of the sets hold it, alone if all its holders
  are of one component already, else rare. What two sets share is core (common elements) and
  residual. A link of sets of n and m elements needs an overlap of 3 / 7 (n + m), at least 3 / 4 n, so a
  set with c common elements needs a residual overlap of at least 3 / 4 n - c with any partner.
* If that is above nought, partners meet in one of the set's first r - need + 1 of r residual
  elements (alone ones first, then by rising frequency: the prefix filter); else in any rare one. An
  element brings at most often / 2 pairs for each set that posts it.
* Pairs that share no rare element are decided by their cores. Sets of equal core form a class,
  led by the smallest: whoever is linked to a member by its core is linked to the leader. The members that
  the core links to the leader are linked and done; the classes, as sets of their cores, are the
  sets of the next level, where fewer elements are common. The others of a class follow it and are
  linked to the best leader their class meets.

Every pair of linked sets is found at the first level where it shares a rare element, or
its ends are joined through leaders. Links are certain: the overlap of parts is already enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

#: Holders from which an element is common at the first level; later levels take four times as many.
OFTEN = 64
#: Elements of the sets that one partition of the small tables here holds, about.
ELEMENTS = 1_000_000
#: An element that this share of all places holds is looked up by broadcast: so many at most.
HEAVY = 2048


def _enough(overlap: Column, sizes: Column) -> Column:
    """overlap / (sizes - overlap) >= 3 / 4, in integers."""
    return 7 * overlap >= 3 * sizes


def _marked(classes: DataFrame, often: int, parts: int) -> DataFrame:
    """The classes with _rare (sorted (holders, element) structs) and _core (sorted common elements)."""
    places = classes.select("_key", "_low", "_high", F.explode("_t").alias("_e"))
    held = places.groupBy("_e").agg(F.count(F.lit(1)).alias("_df"), F.min("_low").alias("_a"), F.max("_high").alias("_b"))
    held = cut_lineage(held.filter("_df > 1 AND _a <> _b").select("_e", "_df").coalesce(parts))
    total = held.agg(F.coalesce(F.sum("_df"), F.lit(0))).first()[0]
    hot = F.broadcast(held.filter(F.col("_df") * HEAVY > total))
    rest = held.filter(F.col("_df") * HEAVY <= total)
    places = places.select("_key", "_e")
    others = places.join(hot.select("_e"), "_e", "left_anti").join(rest, "_e").coalesce(parts)
    known = places.join(hot, "_e").unionByName(others)
    per = known.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("_df") <= often, F.struct("_df", "_e")))).alias("_rare"),
        F.array_sort(F.collect_list(F.when(F.col("_df") > often, F.col("_e")))).alias("_core"))
    return classes.join(per.coalesce(parts), "_key").coalesce(parts)


def _level(items: DataFrame, often: int, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), items of the next level) of items (_id, _n, _comp, _t).

    A level has many small stages: all of them run in as many partitions as the sets need.
    """
    keyed = items.withColumn("_key", F.struct(F.xxhash64("_t").alias("h"), F.xxhash64(F.lit(1), "_t").alias("g")))
    classes = cut_lineage(keyed.groupBy("_key").agg(
        F.min(F.struct("_n", "_id")).alias("_lead"), F.min("_comp").alias("_low"), F.max("_comp").alias("_high"),
        F.first("_t").alias("_t")).coalesce(parts))
    members = keyed.drop("_t").join(classes.select("_key", "_lead", F.size("_t").alias("_size")), "_key").coalesce(parts)
    members = members.filter(F.struct("_n", "_id") != F.col("_lead"))
    near = _enough(F.col("_size"), F.col("_n") + F.col("_lead._n"))
    links = members.filter(near).select(F.col("_id").alias("a"), F.col("_lead._id").alias("b"))
    followers = cut_lineage(members.filter(~near).select("_key", "_id", "_n", "_comp"))

    marked = cut_lineage(_marked(classes, often, parts))
    size, core, rare = F.size("_t"), F.size("_core"), F.size("_rare")
    residual = size - core
    need = F.ceil(F.col("_lead._n") * 3 / 4) - core
    posted = F.least(rare, F.when(need > 0, residual - need + 1).otherwise(residual) - (residual - rare))
    posts = (marked.withColumn("_posted", posted.cast("int")).filter("_posted > 0")
             .select("_key", F.col("_lead._n").alias("_n"), "_low", "_high", F.size("_t").alias("_s"),
                     F.explode(F.slice("_rare", F.lit(1), F.col("_posted"))["_e"]).alias("_e")))
    one, two = posts.alias("x"), posts.alias("y")
    differ = (F.col("x._low") != F.col("y._low")) | (F.col("x._high") != F.col("y._high")) | (F.col("x._low") != F.col("x._high"))
    fit = _enough(F.least("x._s", "y._s"), F.col("x._n") + F.col("y._n"))
    pairs = (one.join(two, (F.col("x._e") == F.col("y._e")) & (F.col("x._key") < F.col("y._key")) & differ & fit)
             .select(F.col("x._key").alias("_x"), F.col("y._key").alias("_y")).coalesce(parts).distinct().coalesce(parts))
    sets = classes.select("_key", "_lead", "_t")
    both = (pairs.join(sets.select(F.col("_key").alias("_x"), F.col("_lead").alias("_p"), F.col("_t").alias("_tx")), "_x")
            .coalesce(parts).join(sets.select(F.col("_key").alias("_y"), F.col("_lead").alias("_q"), F.col("_t").alias("_ty")), "_y"))
    both = both.withColumn("_both", F.size(F.array_intersect("_tx", "_ty"))).drop("_tx", "_ty")
    active = cut_lineage(both.filter(_enough(F.col("_both"), F.col("_p._n") + F.col("_q._n"))).coalesce(parts))
    links = links.unionByName(active.select(F.col("_p._id").alias("a"), F.col("_q._id").alias("b")))

    room = active.select(F.inline(F.array(
        F.struct(F.col("_x").alias("_key"), (7 * F.col("_both") - 3 * F.col("_q._n")).alias("_room"), F.col("_q._id").alias("_to")),
        F.struct(F.col("_y").alias("_key"), (7 * F.col("_both") - 3 * F.col("_p._n")).alias("_room"), F.col("_p._id").alias("_to")))))
    best = room.groupBy("_key").agg(F.max(F.struct("_room", "_to")).alias("_best")).coalesce(parts)
    links = links.unionByName(followers.join(best, "_key").filter(3 * F.col("_n") <= F.col("_best._room"))
                              .select(F.col("_id").alias("a"), F.col("_best._to").alias("b")))

    cores = marked.filter((core > 0) & (4 * core >= 3 * F.col("_lead._n"))).select(
        "_key", "_core", "_lead")
    leaders = keyed.drop("_t").join(cores, "_key").coalesce(parts).filter(F.struct("_n", "_id") == F.col("_lead"))
    nexts = leaders.select("_id", "_n", "_comp", "_core").unionByName(
        followers.join(cores.select("_key", "_core"), "_key").select("_id", "_n", "_comp", "_core"))
    nexts = nexts.filter(4 * F.size("_core") >= 3 * F.col("_n")).select("_id", "_n", "_comp", F.col("_core").alias("_t"))
    return cut_lineage(links.coalesce(parts)), nexts.coalesce(parts)


def rare_links(items: DataFrame, often: int = OFTEN) -> DataFrame:
    """Links (a, b) between items (_id, _n, _comp, _t: the sorted distinct elements, _n of them) of different
    components that join all components which any two linked items join.

    Items that repeat an id count as linked. Works level by level until no crowd is left; as `often` grows, every element is rare at last.
    """
    links = None
    while True:
        items = cut_lineage(items)
        ends = items.agg(F.min("_comp").alias("low"), F.max("_comp").alias("high"), F.sum(F.size("_t")).alias("places")).first()
        if ends["low"] == ends["high"]:
            break
        parts = -(-ends["places"] // ELEMENTS)
        found, items = _level(items.coalesce(parts), often, parts)
        links = found if links is None else links.unionByName(found)
        often *= 4
    none = items.select(F.col("_id").alias("a"), F.col("_id").alias("b")).limit(0)
    return none if links is None else links.distinct()
