"""Joins with a check or a twist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def validated_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that fails if a key is twice on the right."""
    twice = right.groupBy(*on).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the right side holds {twice[0].asDict()} more than once")
    return left.join(right, list(on), "left")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and isn't in parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def join_cardinality(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows and distinct keys of both sides, the exact size of their inner join, the fan-out and its risk.

    Only the counts per key are joined, so no row is multiplied.
    """
    a = left.groupBy(*on).agg(F.count("*").alias("l"))
    b = right.groupBy(*on).agg(F.count("*").alias("r"))
    both = a.join(b, list(on), "full_outer").agg(
        F.sum("l").alias("left_rows"), F.count("l").alias("left_keys"), F.sum("r").alias("right_rows"), F.count("r").alias("right_keys"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("joined_rows"),
    )
    fan = F.col("joined_rows") / F.greatest("left_rows", F.lit(1))
    return both.withColumn("fan_out", F.round(fan, 6)).withColumn("risk", F.when(fan > 10, "HIGH").when(fan > 1.5, "MEDIUM").otherwise("LOW"))


#: Items of a basket up to which its pairs are looked up; baskets an item is in from which its sets are salted.
WIDE, HOT = 32, 1 << 20


def containing(sets: DataFrame, baskets: DataFrame, *, set_id: str = "set_id", items: str = "items", basket_id: str = "basket_id", item: str = "item") -> DataFrame:
    """(set_id, basket_id) of every basket that holds all items of the set; set ids are distinct, and an empty set is in no basket.

    sets has arrays, baskets one row per basket and item. Items are ordered from the rarest on. A set is looked up by its
    two rarest items only (a single item by itself) among the pairs of a basket, and what else it has is then looked for in
    that basket. A basket of more than WIDE wanted items has too many pairs; it meets sets by their rarest item and
    is checked for the rest. A set whose rarest item is in many baskets is repeated for each HOT of them, and a basket meets
    one of the copies, so no task gets all baskets of an item. Sets and wanted items are written, as they are read several times.
    """
    asked = written(sets.select(F.col(set_id).alias("_s"), F.array_distinct(F.array_compact(items)).alias("_asked")), "sets")
    each = asked.select("_s", F.size("_asked").alias("_size"), F.explode("_asked").alias("_item"))
    rows = baskets.select(F.col(basket_id).alias("_b"), F.col(item).alias("_item")).join(each.select("_item").distinct(), "_item", "left_semi")
    often = written(rows.groupBy("_item").agg(F.count("*").alias("_often")), "items")
    by_rarity = lambda x: F.array_sort(x(F.struct("_often", "_item")))
    salts = lambda n: F.ceil(n / HOT).cast("int")
    wanted = each.join(often, "_item").groupBy("_s", "_size").agg(by_rarity(F.collect_list).alias("_w")).filter(F.size("_w") == F.col("_size"))
    salted = F.explode(F.sequence(F.lit(0), salts(F.col("_w")[0]["_often"]) - 1))
    keyed = wanted.select("_s", F.col("_w")[0]["_item"].alias("_x"), F.get("_w", F.lit(1))["_item"].alias("_y"), F.col("_w._item").alias("_w"), salted.alias("_salt"))
    held = rows.join(often, "_item").groupBy("_b").agg(by_rarity(F.collect_set).alias("_h"))
    one = held.select("_b", F.col("_h._item").alias("_held"), "_h", F.posexplode("_h").alias("_at", "_e"))
    one = one.select("_b", "_held", F.col("_e._item").alias("_x"), "_at", F.pmod(F.xxhash64("_b"), salts(F.col("_e._often"))).cast("int").alias("_salt"))
    rest = F.size(F.array_except("_w", "_held")) == 0
    # a set of one item is met by no second item
    none = F.array(F.lit(None).cast(dict(rows.dtypes)["_item"]))
    second = F.concat(none, F.slice("_held", F.col("_at") + 2, F.size("_held")))
    pairs = one.filter(F.size("_held") <= WIDE).select("_b", "_held", "_x", "_salt", F.explode(second).alias("_2"))
    met = (pairs["_x"] == keyed["_x"]) & (pairs["_salt"] == keyed["_salt"]) & pairs["_2"].eqNullSafe(keyed["_y"])
    narrow = pairs.join(keyed, met).filter((F.size("_w") <= 2) | rest)
    wide = one.filter(F.size("_held") > WIDE).join(keyed, ["_x", "_salt"]).filter(rest)
    out = narrow.select("_s", "_b").unionByName(wide.select("_s", "_b"))
    return out.select(F.col("_s").alias(set_id), F.col("_b").alias(basket_id))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, *, key: str, vector: str = "vector", label: str = "label") -> DataFrame:
    """key, label of the nearest centroid, its distance and the margin to the second. The centroids (one row per label) are collected."""
    held = [(r[label], [float(x) for x in r[vector]]) for r in centroids.select(label, vector).orderBy(label).collect()]
    def to(v):
        return F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, v)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = F.array_sort(F.array(*[F.struct(to(v).alias("d"), F.lit(k).alias("k")) for k, v in held]))
    return rows.select(key, near.alias("_n")).select(key, F.col("_n")[0]["k"].alias(label), F.col("_n")[0]["d"].alias("distance"), (F.col("_n")[1]["d"] - F.col("_n")[0]["d"]).alias("margin"))
