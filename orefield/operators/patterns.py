"""Frequent itemsets, rules and their evaluation. Baskets are rows (basket_id, item); itemsets are sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import MEASURES, Table, measured
from ..functions.special import fisher_right
from ..sources.shared import written
from .aggregates import average_rank
from .joins import containing
from .ordering import running_by_range
from .quantiles import quantiles
from .stats import corrected


def least_count(baskets: DataFrame, support: float) -> int:
    return max(1, math.ceil(support * baskets.select("basket_id").distinct().count()))


def frequent_items(baskets: DataFrame, least: int) -> DataFrame:
    """item, count of items in least baskets or more."""
    return baskets.distinct().groupBy("item").agg(F.count("*").alias("count")).filter(F.col("count") >= least)


def item_codes(baskets: DataFrame) -> DataFrame:
    """item, count and code: 0 for the most frequent, ties by item."""
    counts = baskets.distinct().groupBy("item").agg(F.count("*").alias("count"))
    return running_by_range(counts, [F.desc("count"), F.asc("item")], {"code": F.lit(1)}).withColumn("code", (F.col("code") - 1).cast("int"))


def build_baskets(lines: DataFrame, least: int, smallest: int, largest: int) -> DataFrame:
    """basket_id, ts, items of frequent items only, where their number is in the band. lines: basket_id, item, ts."""
    frequent = frequent_items(lines.select("basket_id", "item"), least).select("item")
    return (
        lines.join(frequent, "item", "left_semi").groupBy("basket_id")
        .agg(F.min("ts").alias("ts"), F.array_sort(F.collect_set("item")).alias("items"))
        .filter(F.size("items").between(smallest, largest))
    )


def fpgrowth(baskets: DataFrame, support: float, longest: int) -> DataFrame:
    """items, count by MLlib's FP-growth."""
    arrays = baskets.groupBy("basket_id").agg(F.collect_set("item").alias("items")).persist()  # read several times by the fit
    found = FPGrowth(itemsCol="items", minSupport=support).fit(arrays).freqItemsets
    return found.filter(F.size("items") <= longest).select(F.array_sort("items").alias("items"), F.col("freq").alias("count"))


def apriori(baskets: DataFrame, support: float, longest: int) -> DataFrame:
    """items, count, level by level: candidates by a prefix self-join, pruned by their subsets, counted in the baskets. Each level is kept.

    A basket meets the candidates whose first two items it has as a pair, and is checked for the others.
    """
    baskets = baskets.distinct().persist()
    least = least_count(baskets, support)
    single = frequent_items(baskets, least).persist()
    levels = [single.select(F.array("item").alias("items"), "count")]
    arrays = baskets.join(single.select("item"), "item", "left_semi").groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("held"))
    pairs = arrays.select("held", F.posexplode("held").alias("at", "x")).select("held", "x", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("y")).persist()
    for k in range(2, longest + 1):
        old = levels[-1].select("items")
        a = old.select(F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("p"))
        candidates = a.join(a.withColumnRenamed("p", "q"), "prefix").filter("p < q").select(F.concat("prefix", F.array("p", "q")).alias("items"))
        for drop in range(k - 2):  # the other two subsets were joined
            subset = F.concat(F.slice("items", 1, drop), F.slice("items", drop + 2, k)) if drop else F.slice("items", 2, k)
            candidates = candidates.withColumn("s", subset).join(old.withColumnRenamed("items", "s"), "s", "left_semi").drop("s")
        keyed = candidates.select("items", F.col("items")[0].alias("x"), F.col("items")[1].alias("y"))
        hits = pairs.join(keyed, ["x", "y"])
        if k > 2:
            hits = hits.filter(F.size(F.array_except(F.slice("items", 3, k), "held")) == 0)
        levels.append(hits.groupBy("items").agg(F.count("*").alias("count")).filter(F.col("count") >= least).persist())
    return reduce(DataFrame.unionByName, levels)


#: Rows that a task gets of what is dealt out in numbers of its own, as each makes several.
DEALT = 1 << 18


def tid_intersections(rows: DataFrame, item: str, tid: str) -> DataFrame:
    """a, b, both: for each two items (a < b) that share one, how many different tids they share.

    Rows of a tid make pairs within a row of the table. Tasks get rows by their number, before pairs are made and after,
    as a small shuffle makes many of them.
    """
    rows = rows.select(F.col(item).alias("a"), F.col(tid).alias("k")).filter(F.col(item).isNotNull() & F.col(tid).isNotNull())
    tasks = max(1, -(-rows.count() // DEALT))
    sets = written(rows.repartition(tasks, "k").groupBy("k").agg(F.array_sort(F.collect_set("a")).alias("s")).select("s").filter(F.size("s") > 1), "sets")
    n = sets.agg(F.sum(F.size("s").cast("long") * (F.size("s") - 1) / 2)).first()[0] or 0
    pairs = sets.select("s", F.posexplode("s").alias("i", "a")).select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.repartition(max(1, -(-int(n) // (4 * DEALT))), "a", "b").groupBy("a", "b").agg(F.count("*").alias("both"))


def contents(baskets: DataFrame) -> DataFrame:
    """Each different set of items that baskets (basket_id, item) hold, sorted, and how many do: held, w; loose are items without a basket_id."""
    sets = baskets.groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("held"))
    return sets.groupBy("held", F.col("basket_id").isNull().alias("loose")).agg(F.count("*").alias("w"))


def eclat(baskets: DataFrame, support: float, longest: int) -> DataFrame:
    """items, count by joining (itemset, basket) rows with the frequent items of the same basket that come later.

    Baskets with the same items are one with a weight, so the joins grow with the different baskets. Each level is written, as
    the next one and its counts are both made from it.
    """
    sets = written(contents(baskets).withColumn("b", F.monotonically_increasing_id()), "contents")
    return _eclat(sets, max(1, math.ceil(support * (sets.agg(F.sum("w")).first()[0] or 0))), longest)


def _eclat(sets: DataFrame, least: int, longest: int) -> DataFrame:
    """eclat's sets of contents (b, held, w) in at least so many baskets."""
    rows = sets.select("b", "w", "loose", F.explode("held").alias("item"))
    often = rows.groupBy("item").agg(F.sum("w").alias("count")).filter(F.col("count") >= least)
    single = written(rows.join(often.select("item"), "item", "left_semi"), "single")
    held = single.select("b", "w", "loose", F.array("item").alias("items"))
    levels = []
    for k in range(longest):
        counts = written(held.groupBy("items").agg(F.sum("w").alias("count")).filter(F.col("count") >= least), "level")
        levels.append(counts)
        if k + 1 == longest:
            break
        kept = held.filter("NOT loose").join(counts.select("items"), "items", "left_semi")
        held = written(kept.join(single.select("b", "item"), "b").filter(F.col("item") > F.element_at("items", -1)).select("b", "w", "loose", F.concat("items", F.array("item")).alias("items")), "held")
    return reduce(DataFrame.unionByName, levels)


#: Baskets that a chunk of the bitmaps has on average: a bitmap is a kilobyte.
CHUNK = 8192


def bitmaps(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the baskets of one chunk: a row for each item with a bit for each basket, set where it holds the item."""
    place, held = pd.factorize(rows["basket_id"])
    code, item = pd.factorize(rows["item"], sort=True)
    cells = np.zeros((len(item), len(held)), dtype=bool)
    cells[code, place] = True
    return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "items": [[x] for x in item], "n": cells.sum(axis=1), "bits": [r.tobytes() for r in np.packbits(cells, axis=1)]})


def intersected(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The sets of one chunk with one prefix, each extended by the last items of those after it, where a basket is left. The last level carries no bits."""
        rows = rows.assign(end=[x[-1] for x in rows["items"]]).sort_values("end")
        sets, ends, cells = [list(x) for x in rows["items"]], list(rows["end"]), np.array([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        items, n, bits = [], [], []
        for i in range(len(sets) - 1):
            both = cells[i] & cells[i + 1 :]
            counts = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero(counts):
                items.append(sets[i] + [ends[i + 1 + j]])
                n.append(counts[j])
                bits.append(None if last else both[j].tobytes())
        # with types given, as there may be no row
        return pd.DataFrame({"chunk": pd.Series(rows["chunk"].iloc[0], range(len(n)), "int32"), "items": pd.Series(items, dtype=object), "n": pd.Series(n, dtype="int64"), "bits": pd.Series(bits, dtype=object)})

    return run


def vertical(baskets: DataFrame, support: float, longest: int, chunk: int = CHUNK) -> DataFrame:
    """items, count as eclat's, from bitmaps: baskets are dealt into chunks, and each item has a bitmap in each chunk.

    A level's sets of one chunk and prefix come together, their bitmaps are intersected and their bits counted; counts are added
    up over chunks. A task holds a kilobyte for each set of a prefix in one chunk.
    """
    rows = written(baskets.distinct(), "baskets")
    n = rows.select("basket_id").distinct().count()
    least, chunks = max(1, math.ceil(support * n)), max(1, -(-n // chunk))
    single = rows.join(frequent_items(rows, least).select("item"), "item", "left_semi")
    kind = f"chunk int, items array<{baskets.schema['item'].dataType.simpleString()}>, n long, bits binary"
    level = single.withColumn("chunk", F.pmod(F.xxhash64("basket_id"), F.lit(chunks)).cast("int")).groupBy("chunk").applyInPandas(bitmaps, kind)
    levels = []
    for k in range(1, longest + 1):
        level = written(level, "bitmaps")
        counts = written(level.groupBy("items").agg(F.sum("n").alias("count")).filter(F.col("count") >= least), "counts")
        levels.append(counts)
        if k < longest:
            kept = level.join(counts.select("items"), "items", "left_semi")
            level = kept.withColumn("prefix", F.slice("items", 1, k - 1)).groupBy("chunk", "prefix").applyInPandas(intersected(k + 1 == longest), kind)
    return reduce(DataFrame.unionByName, levels)


def subsets(items: Column, longest: int) -> Column:
    """All proper non-empty subsets of at most that many items, in order; for sets of up to about ten items."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size(items)) - 2).cast("int"))
    picked = F.transform(masks, lambda m: F.filter(items, lambda x, i: F.getbit(m, i) == 1))
    return F.filter(picked, lambda s: F.size(s) <= longest)


def rules(itemsets: DataFrame, n: int, longest: int = 2) -> DataFrame:
    """antecedent, consequent, n11, n1, m1, n of every rule from the itemsets; consequents may have several items."""
    split = itemsets.filter(F.size("items") >= 2).select("items", F.col("count").alias("n11"), F.explode(subsets(F.col("items"), longest)).alias("antecedent"))
    split = split.withColumn("consequent", F.array_except("items", "antecedent"))
    left = itemsets.select(F.col("items").alias("antecedent"), F.col("count").alias("n1"))
    right = itemsets.select(F.col("items").alias("consequent"), F.col("count").alias("m1"))
    return split.join(left, "antecedent").join(right, "consequent").select("antecedent", "consequent", "n11", "n1", "m1", F.lit(n).cast("long").alias("n"))


def ranked(table: DataFrame, k: int, confidence: float = 0.0, lift: float = 0.0, leverage: float = -1.0) -> DataFrame:
    """The k best rules by leverage, then lift, with ids R00000 on; table must have the measures."""
    kept = table.filter((F.col("confidence") >= confidence) & (F.col("lift") >= lift) & (F.col("leverage") >= leverage))
    order = [F.desc("leverage"), F.desc("lift"), "antecedent", "consequent"]
    best = kept.orderBy(*order).limit(k)
    return best.withColumn("rule_id", F.format_string("R%05d", F.row_number().over(Window.orderBy(*order)) - 1))


def rule_label(antecedent: str = "antecedent", consequent: str = "consequent") -> Column:
    return F.concat(F.lit("{"), F.array_join(antecedent, ", "), F.lit("} => {"), F.array_join(consequent, ", "), F.lit("}"))


def recounted(sets: DataFrame, baskets: DataFrame, name: str) -> DataFrame:
    """items and how many of the baskets hold them all, under that name; 0 where none does."""
    distinct = sets.select("items").distinct().withColumn("set_id", F.array_join("items", "\x1f"))
    counts = containing(distinct, baskets).groupBy("set_id").agg(F.count("*").alias(name))
    return distinct.join(counts, "set_id", "left").select("items", F.coalesce(name, F.lit(0)).alias(name))


def holdout(table: DataFrame, baskets: DataFrame) -> DataFrame:
    """Rules with their counts, confidence, lift and leverage on baskets that they weren't mined from: h11, h1, hm1, hn, h_confidence ..."""
    n = baskets.select("basket_id").distinct().agg(F.count("*").alias("hn"))
    whole = written(table.withColumn("items", F.array_sort(F.concat("antecedent", "consequent"))), "rules")
    sets = whole.select(F.explode(F.array("items", "antecedent", "consequent")).alias("items"))
    counts = written(recounted(sets, baskets, "h").select(F.col("items").alias("s"), "h"), "counts")
    out = whole
    for column, name in (("items", "h11"), ("antecedent", "h1"), ("consequent", "hm1")):
        out = out.join(counts.select(F.col("s").alias(column), F.col("h").alias(name)), column, "left")
    out = out.drop("items").crossJoin(F.broadcast(n))
    t = Table("h11", "h1", "hm1", "hn")
    return out.select("*", *[MEASURES[m](t).alias(f"h_{m}") for m in ("confidence", "lift", "leverage")])


def replicated(report: DataFrame, confidence: float, lift: float, least: int = 5, alpha: float = 0.05, method: str = "bh") -> DataFrame:
    """holdout's rows with h_p and h_q (Fisher's right tail there, corrected), replicated (least baskets there, confidence and lift reached) and validated (and h_q at most alpha)."""
    p = written(report.withColumn("h_p", fisher_right(*map(F.col, ("h11", "h1", "hm1", "hn")))), "holdout")
    q = corrected(p, "h_p", method).withColumnRenamed("q", "h_q")
    held = (F.col("h11") >= least) & (F.col("h_confidence") >= confidence) & (F.col("h_lift") >= lift)
    return q.withColumn("replicated", held).withColumn("validated", held & (F.col("h_q") <= alpha))


def holdout_report(judged: DataFrame, baskets: DataFrame, least: int = 5) -> DataFrame:
    """One row about replicated's rules, which also have confidence and lift of the baskets they were mined from.

    coverage: share of baskets in which a rule fires at all (its antecedent is there); firing_precision: share of firings
    whose consequent is there too; drift is holdout less mining; lifts are ranked with ties at their average, and the correlation
    of ranks that are all equal is 0.
    """
    rules = written(judged, "judged").withColumns({c: F.round(c, 12) for c in ("lift", "h_lift")}).withColumn("id", F.concat_ws("\x1f", F.concat_ws("\x1e", "antecedent"), F.concat_ws("\x1e", "consequent")))
    fires = containing(rules.select("antecedent").distinct().select(F.concat_ws("\x1e", "antecedent").alias("set_id"), F.col("antecedent").alias("items")), baskets)
    covered = fires.select("basket_id").distinct().agg(F.count("*").alias("fired"))
    ranks = average_rank(rules.select("id", "lift"), "lift", "r").join(average_rank(rules.select("id", "h_lift"), "h_lift", "hr"), "id")
    middle = quantiles(rules, "h_p", [0.5]).select(F.col("quantiles")[0].alias("median_h_p"))
    total, share = F.count("*"), lambda c: F.count_if(c) / F.count("*")
    drift = F.col("h_confidence") - F.col("confidence")
    same = F.coalesce(F.try_divide(F.covar_pop("r", "hr"), F.stddev_pop("r") * F.stddev_pop("hr")), F.lit(0.0))
    one = rules.agg(
        total.alias("n_rules"), F.max("hn").alias("n_baskets"), F.count_if(F.col("h11") >= least).alias("n_with_least"),
        F.count_if("replicated").alias("n_replicated"), share(F.col("replicated")).alias("replication_rate"), F.count_if("validated").alias("n_validated"), share(F.col("validated")).alias("validated_rate"),
        F.try_divide(F.sum("h11"), F.sum("h1")).alias("firing_precision"), F.avg(drift).alias("confidence_drift_mean"), F.avg(F.abs(drift)).alias("confidence_drift_mae"),
        F.avg(F.col("h_lift") - F.col("lift")).alias("lift_drift_mean"),
    )
    out = one.crossJoin(covered).crossJoin(ranks.agg(same.alias("lift_rank_spearman"))).crossJoin(middle)  # one row each
    return out.withColumn("coverage", F.try_divide("fired", "n_baskets")).drop("fired")


def recommend(table: DataFrame, baskets: DataFrame, k: int) -> DataFrame:
    """Per basket the k items not in it that rules whose antecedent it holds point to, by the best rule's confidence."""
    # what is offered depends on a basket's items alone, so each different set of them is worked off once
    own = written(baskets.groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("held")), "baskets")
    each = written(own.select("held").distinct().withColumn("b", F.monotonically_increasing_id()), "contents")
    rows = each.select(F.col("b").alias("basket_id"), F.explode("held").alias("item"))
    keyed = written(table.select(rule_label().alias("set_id"), F.col("antecedent").alias("items"), "consequent", "confidence"), "rules")
    fired = containing(keyed, rows).join(keyed.select("set_id", "consequent", "confidence"), "set_id")
    offered = fired.select("basket_id", F.explode("consequent").alias("item"), "confidence", F.col("set_id").alias("rule"))
    new = offered.join(rows, ["basket_id", "item"], "left_anti")
    best = new.groupBy("basket_id", "item").agg(F.max(F.struct("confidence", "rule")).alias("b")).select("basket_id", "item", "b.confidence", "b.rule")
    place = F.row_number().over(Window.partitionBy("basket_id").orderBy(F.desc("confidence"), "item"))
    first = best.withColumn("place", place).filter(F.col("place") <= k)
    listed = first.groupBy(F.col("basket_id").alias("b")).agg(F.collect_list(F.struct("item", "confidence", "rule", "place")).alias("x"))
    return own.join(written(each.join(listed, "b").select("held", "x"), "offers"), "held").select("basket_id", F.inline("x"))


def sensitivity(table: DataFrame, confidences: list[float], lifts: list[float]) -> DataFrame:
    """How many rules pass each pair of thresholds: one aggregate of conditional counts."""
    grid = [(c, x) for c in confidences for x in lifts]
    one = table.agg(*[F.count_if((F.col("confidence") >= c) & (F.col("lift") >= x)).alias(f"n{i}") for i, (c, x) in enumerate(grid)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(x).alias("lift"), F.col(f"n{i}").alias("rules")) for i, (c, x) in enumerate(grid)])))


def network(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the items of rules: edges from antecedent to consequent items with the number of rules and the best lift, at most 25."""
    edges = table.select(F.explode("antecedent").alias("source"), "consequent", "lift").select("source", F.explode("consequent").alias("target"), "lift")
    edges = edges.groupBy("source", "target").agg(F.count("*").alias("rules"), F.least(F.max("lift"), F.lit(25.0)).alias("lift"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("item")).groupBy("item").agg(F.count("*").alias("degree"))
    return nodes, edges


#: Baskets that a slot of the swaps has on average; the number of slots grows with the baskets.
SLOT = 1024


def swap_null(baskets: DataFrame, rounds: int, seed: int = 7, slot: int = SLOT) -> DataFrame:
    """Baskets (basket_id, items) after rounds of swaps that keep every basket's size and every item's count.

    Each round deals the baskets into slots by a hash of its own, and pairs those of a slot in the order of another; a pair
    exchanges one item that only one of them has for one that only the other has. Each round is written: it is neither
    repeated nor planned again by the next one.
    """
    now = written(baskets.select("basket_id", "items"), "swaps")
    slots = max(1, -(-now.count() // slot))
    for r in range(rounds):
        dealt = now.withColumn("b", F.pmod(F.xxhash64(F.lit(seed + r), "basket_id"), F.lit(slots)))
        dealt = dealt.withColumn("p", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64(F.lit(seed - r - 1), "basket_id"), "basket_id")) - 1)
        # both of a pair have one place, so they come together by an aggregate on the window's own partitioning
        pair = dealt.groupBy("b", F.floor(F.col("p") / 2).alias("h")).agg(F.array_sort(F.collect_list(F.struct("p", "basket_id", "items"))).alias("x"))
        pair = pair.select(F.col("x")[0].alias("l"), F.get("x", F.lit(1)).alias("r"))
        only_l, only_r = F.array_except("l.items", "r.items"), F.array_except("r.items", "l.items")
        pick = lambda x: F.element_at(x, (F.pmod(F.xxhash64(F.lit(seed + r), "l.basket_id", "r.basket_id"), F.size(x)) + 1).cast("int"))
        swap = F.col("r").isNotNull() & (F.size(only_l) > 0) & (F.size(only_r) > 0)
        out = pair.withColumn("x", F.when(swap, pick(only_l))).withColumn("y", F.when(swap, pick(only_r)))
        change = lambda items, gone, new: F.when(F.col("x").isNotNull(), F.array_sort(F.concat(F.array_remove(items, gone), F.array(new)))).otherwise(items)
        both = F.array(F.struct(F.col("l.basket_id").alias("basket_id"), change(F.col("l.items"), F.col("x"), F.col("y")).alias("items")), F.struct(F.col("r.basket_id").alias("basket_id"), change(F.col("r.items"), F.col("y"), F.col("x")).alias("items")))
        now = written(out.select(F.inline(both)).filter("basket_id IS NOT NULL"), "swaps")
    return now


def with_measures(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    return measured(table, names)


def productive(table: DataFrame, itemsets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rules whose every antecedent item matters: within the baskets that hold the rest of the antecedent, the item and the
    consequent go together with a right-tailed Fisher p of at most alpha. A single item is tested against all baskets.

    table: antecedent, consequent, n11, n1, m1, n. itemsets: items, count of all frequent sets.
    """
    counts = itemsets.select("items", "count")
    row = table.select("antecedent", "consequent", "n11", "n1", "m1", "n", F.explode("antecedent").alias("x"))
    row = row.withColumn("rest", F.array_remove("antecedent", F.col("x"))).withColumn("with_rest", F.array_sort(F.concat(F.array_remove("antecedent", F.col("x")), "consequent")))
    row = row.join(counts.select(F.col("items").alias("rest"), F.col("count").alias("of_rest")), "rest", "left")
    row = row.join(counts.select(F.col("items").alias("with_rest"), F.col("count").alias("of_both")), "with_rest", "left")
    alone = F.size("rest") == 0
    tested = row.select("antecedent", "consequent", "n11", "n1", F.when(alone, F.col("m1")).otherwise(F.col("of_both")).alias("m1"), F.when(alone, F.col("n")).otherwise(F.col("of_rest")).alias("n"))
    worst = tested.withColumn("p", fisher_right(*map(F.col, ("n11", "n1", "m1", "n")))).groupBy("antecedent", "consequent").agg(F.max("p").alias("worst_p"))
    return table.join(worst.filter(F.col("worst_p") <= alpha), ["antecedent", "consequent"])


def empirical_fdr(baskets: DataFrame, lifts: list[float], least: int, rounds: int = 3, swaps: int = 5, seed: int = 7) -> DataFrame:
    """For each lift: pairs of items (in least baskets or more) that reach it, how many do on average in swapped baskets, and the ratio.

    baskets: basket_id, items. Swapping keeps basket sizes and item counts, so what reaches the lift there does so by chance.
    """
    baskets = written(baskets.select("basket_id", F.array_sort("items").alias("items")), "baskets")  # read once for each round
    n = baskets.count()

    def reached(df: DataFrame) -> DataFrame:
        of = df.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
        each = df.select("items", F.posexplode("items").alias("i", "item"))  # sorted: what comes later is larger
        pairs = each.select("item", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("other")).groupBy("item", "other").agg(F.count("*").alias("both")).filter(F.col("both") >= least)
        lift = pairs.join(of, "item").join(of.select(F.col("item").alias("other"), F.col("c").alias("d")), "other").select((F.col("both") * n / (F.col("c") * F.col("d"))).alias("lift"))
        return lift.agg(*[F.count_if(F.col("lift") >= x).alias(f"n{i}") for i, x in enumerate(lifts)])

    real = reached(baskets)
    null = reduce(DataFrame.unionByName, [reached(swap_null(baskets, swaps, seed + 1000 * r)) for r in range(rounds)])
    both = real.crossJoin(null.agg(*[F.avg(f"n{i}").alias(f"m{i}") for i in range(len(lifts))]))  # one row each
    rows = F.inline(F.array(*[F.struct(F.lit(float(x)).alias("lift"), F.col(f"n{i}").alias("pairs"), F.col(f"m{i}").alias("by_chance")) for i, x in enumerate(lifts)]))
    return both.select(rows).withColumn("fdr", F.when(F.col("pairs") > 0, F.least(F.lit(1.0), F.col("by_chance") / F.col("pairs"))))


class Itemsets:
    """Itemsets mined once at the lowest support; higher supports and shorter sets are filters of what is kept."""

    def __init__(self, baskets: DataFrame, support: float, longest: int):
        self.support, self.longest = support, longest
        sets = written(contents(baskets).withColumn("b", F.monotonically_increasing_id()), "contents")
        self.n = sets.agg(F.sum("w")).first()[0] or 0
        self.kept = _eclat(sets, self.least(support), longest)

    def least(self, support: float) -> int:
        return max(1, math.ceil(support * self.n))

    def at(self, support: float, longest: int) -> DataFrame:
        if support < self.support or longest > self.longest:
            raise ValueError("asked for more than was mined")
        return self.kept.filter((F.col("count") >= self.least(support)) & (F.size("items") <= longest))


def attached(table: DataFrame, report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rules with columns of a report on them; null where the report doesn't have the rule."""
    return table.join(report.select("antecedent", "consequent", *columns), ["antecedent", "consequent"], "left")
