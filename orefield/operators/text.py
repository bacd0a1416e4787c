"""Text-corpus operators: dedup, leakage, profiles, vocabularies, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import bound, hash_form, shingles
from ..sources.shared import written
from .sketches import sketches
from .ordering import running_by_range


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, keep_id: the smallest key with the same normal form. The smallest is found by an aggregate that combines first."""
    hashed = docs.select(key, F.sha1(hash_form(F.col(text)).cast("binary")).alias("_h")).persist()  # read twice
    return hashed.join(hashed.groupBy("_h").agg(F.min(key).alias("keep_id")), "_h").select(key, "keep_id")


def minhash(shingle_set: Column, perms: int) -> Column:
    def least(i: int) -> Column:
        return F.array_min(F.transform(shingle_set, lambda s: F.xxhash64(F.lit(i), s)))

    return F.array(*map(least, range(perms)))


#: Rows of a band bucket's side that meet in one group; fuller buckets are dealt into blocks of about so many.
BLOCK = 512


def sketched(df: DataFrame, k: int, bands: int = 0, rows: int = 0) -> DataFrame:
    """row (a number of its own), id, h, n, s, keys, form of each row (id, text), in one pass over the texts; written.

    s: hashed shingles of the normal form, n their number, h their hash; keys: one for each band of the min-hash signature of
    s; form: a hash of the normal form.
    """
    kind = df.schema["id"].dataType.simpleString()
    made = df.select("id", hash_form(F.col("text")).alias("text")).mapInArrow(sketches(k, bands, rows), f"id {kind}, form binary, s array<long>, keys array<long>")
    return written(made.withColumn("h", F.xxhash64("s")).withColumn("n", F.size("s")).withColumn("row", F.monotonically_increasing_id()), "sketched")


def classes(made: DataFrame) -> DataFrame:
    """h, id (the smallest), row of sketched() rows with the same shingles; written."""
    return written(made.groupBy("h").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select("h", "x.id", "x.row"), "classes")


def in_bands(made: DataFrame, reps: DataFrame) -> DataFrame:
    """id, n, band, key of classes(): a row for each band of its signature; written."""
    own = made.select("row", "id", "n", "keys").join(reps.select("row"), "row", "left_semi")
    return written(own.select("id", "n", F.posexplode("keys").alias("band", "key")), "bands")


def shared_bands(keys: DataFrame) -> DataFrame:
    """in_bands() and m, the rows of the bucket, where it has more than one; written."""
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    return written(keys.join(sizes, ["band", "key"]), "shared")


def in_blocks(left: DataFrame, right: DataFrame, block: int = BLOCK, bucket: tuple[str, ...] = ("band", "key")) -> DataFrame:
    """left (a, ...) with right (b, ...) of the same bucket; each block of a bucket's one side meets each of its other side in a group of their own.

    So a full bucket is many groups of at most about block x block pairs, whose rows are sent as often as the other side has blocks.
    """
    of = lambda df, name: df.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = of(left, "of_a").join(of(right, "of_b"), [*bucket])
    dealt = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = left.join(sizes, [*bucket]).withColumn("i", dealt("a", "of_a")).withColumn("j", every("of_b")).drop("of_a", "of_b")
    y = right.join(sizes, [*bucket]).withColumn("j", dealt("b", "of_b")).withColumn("i", every("of_a")).drop("of_a", "of_b")
    return x.join(y, [*bucket, "i", "j"])


#: Rows of which only some are looked up are found by a broadcast of those numbers as long as there are no more than so many.
LOOKED_UP = 1_000_000


def sets_of(pairs: DataFrame, side: str, made: DataFrame, reps: DataFrame) -> DataFrame:
    """<side>, s_<side>: the shingles of the classes in that column of pairs. The sets of others aren't sent where those asked for are few."""
    asked = written(pairs.select(side).distinct().join(reps.select(F.col("id").alias(side), "row"), side), "asked")
    few = asked.count() <= LOOKED_UP
    return made.select("row", F.col("s").alias(f"s_{side}")).join(F.broadcast(asked) if few else asked, "row").drop("row")


def verified(pairs: DataFrame, left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], similarity: float) -> DataFrame:
    """a, b, similarity of pairs (a, n_a, b, n_b) whose sets' Jaccard is at least so high. left, right: sketched() and classes().

    Sets are looked up only where their sizes allow it.
    """
    may = written(pairs.filter(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")).select("a", "b").distinct(), "pairs")
    both = may.join(sets_of(may, "a", *left), "a").join(sets_of(may, "b", *right), "b")
    shared = bound(F.size(F.array_intersect("s_a", "s_b")), lambda i: i / (F.size("s_a") + F.size("s_b") - i))
    return both.select("a", "b", shared.alias("similarity")).filter(F.col("similarity") >= similarity)


def of_classes(made: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of sketched() that stand for their class. The sets aren't sent where the other rows are few."""
    others = written(made.select("row").join(reps.select("row"), "row", "left_anti"), "others")
    if others.count() <= LOOKED_UP:
        return made.join(F.broadcast(others), "row", "left_anti")
    return made.join(reps.select("row"), "row", "left_semi")


def rare_first(sides: list[tuple[DataFrame, DataFrame]], similarity: float) -> list[DataFrame]:
    """row, n, key, at of the classes of one table or of two (sketched() and classes() each). A row for each shingle among a
    set's first n - ceil(similarity n) + 1, and its place there, where another class (of the other table) has it too.

    All sets are in one order, rarest shingle first. Two sets that are so similar share one of these, whatever the order: what
    a set has after its first shared shingle must do for the overlap. Those that no other set has come before all others, so
    a set with too many of them has no row. Shingles go by the first bits of their hash, over a hundred times as many values as
    there are shingles: two that fall together only look less rare.
    """
    total = sum(made.agg(F.sum("n")).first()[0] or 0 for made, _ in sides)
    bits = min(total.bit_length() + 7, 50)
    own = [of_classes(*both).select(F.lit(i).alias("side"), "row", "n", F.explode("s").alias("key")) for i, both in enumerate(sides)]
    own = [df.withColumn("key", F.shiftrightunsigned("key", 64 - bits)) for df in own]
    # counted beside the rows, which are sent once: of one shingle there is at most a row for each set
    every = Window.partitionBy("key")
    counted = (own[0] if len(own) == 1 else own[0].unionByName(own[1])).withColumn("m", F.count("*").over(every))
    counted = counted.filter("m > 1") if len(own) == 1 else counted.withColumn("m_b", F.sum("side").over(every)).filter("m_b > 0 and m_b < m")
    # number and shingle in one long, which orders by both
    x = F.shiftleft(F.least("m", F.lit(2 ** (62 - bits))), bits) + F.col("key")
    sets = counted.groupBy("side", "row", "n").agg(F.sort_array(F.collect_list(x)).alias("x"))
    first = F.col("n") - F.ceil(F.col("n") * (similarity * (1 - 1e-12))) + 1
    sets = sets.withColumn("alone", F.col("n") - F.size("x")).withColumn("left", (first - F.col("alone")).cast("int")).filter("left > 0")
    rows = sets.select("side", "row", "n", "alone", F.posexplode(F.slice("x", F.lit(1), F.col("left"))).alias("at", "key"))
    rows = written(rows.select("side", "row", "n", "key", (F.col("alone") + F.col("at")).alias("at")), "rare")
    return [rows.filter(F.col("side") == i).drop("side") for i in range(len(sides))]


def alike(sides: list[tuple[DataFrame, DataFrame]], similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b (rows of classes), similarity of all pairs of classes whose sets' Jaccard is at least so high (above 0); written.

    sides: sketched() and classes() of one table, whose pairs come once, or of two.
    """
    found = rare_first(sides, similarity)
    x, y = (found[i].select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), "key", F.col("at").alias(f"at_{c}")) for i, c in ((0, "a"), (-1, "b")))
    met = in_blocks(x, y, block, ("key",))
    if len(sides) == 1:
        met = met.filter("a < b")
    # the most that they can share, by how much of each lies before and after this shingle
    most = 1 + F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    met = met.filter(most / (F.col("n_a") + F.col("n_b") - most) >= similarity)
    by_row = [(made, reps.select(F.col("row").alias("id"), "row")) for made, reps in sides]
    return written(verified(met.select("a", "n_a", "b", "n_b"), by_row[0], by_row[-1], similarity), "alike")


def near_pairs(left: DataFrame, right: DataFrame, *, similarity: float = 0.8, k: int = 5, block: int = BLOCK) -> DataFrame:
    """a, b, similarity of all pairs (a from left, b from right; key id, text) with Jaccard of (hashed) shingles at least so high.

    Rows with the same shingles are one class, which goes by its smallest id. Pairs of a table with itself are compared once and turned round.
    """
    made = [sketched(df, k) for df in ((left,) if right is left else (left, right))]
    sides = [(m, classes(m)) for m in made]
    named = lambda i, c: sides[i][1].select(F.col("row").alias(c), F.col("id").alias(f"id_{c}"))
    found = alike(sides, similarity, block).join(named(0, "a"), "a").join(named(-1, "b"), "b")
    found = found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity").filter("a <> b")
    return found if len(sides) == 2 else found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


#: Ids of a class that meet those of another in one row; larger classes are dealt into blocks of about so many.
MEMBERS = 128


def near_documents(docs: DataFrame, *, similarity: float = 0.8, k: int = 5, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """a, b, similarity of all pairs of documents (id, text; a < b) with Jaccard of (hashed) shingles at least so high.

    near_pairs() for each member of a class with each of the other, and the members of a class with one another. A pair of ids
    comes once for each two classes.
    """
    made = sketched(docs, k)
    reps = classes(made)
    named = lambda c: reps.select(F.col("row").alias(c), F.col("h").alias(f"h_{c}"))
    near = alike([(made, reps)], similarity, block).join(named("a"), "a").join(named("b"), "b").select("h_a", "h_b", "similarity")
    own = made.filter("s is not null and id is not null").select("h", "id").distinct()
    sizes = own.groupBy("h").agg(F.ceil(F.count("*") / members).cast("int").alias("of"), F.count("*").alias("m"))
    sizes, own = written(sizes, "sizes"), written(own.join(sizes, "h"), "members")
    blocks = own.withColumn("i", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("of")).cast("int")).groupBy("h", "i").agg(F.collect_list("id").alias("ids"))
    blocks = written(blocks, "blocks")
    links = near.unionByName(sizes.filter("m > 1").select(F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(1.0).alias("similarity")))
    for c in "ab":
        links = links.join(sizes.select(F.col("h").alias(f"h_{c}"), F.col("of").alias(f"of_{c}")), f"h_{c}")
    # first numbers of blocks, so that a large class's pairs are dealt over tasks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = links.withColumn("i_a", every("of_a")).withColumn("i_b", every("of_b")).filter("h_a <> h_b or i_a <= i_b").repartition("h_a", "i_a", "h_b", "i_b")
    for c in "ab":
        met = met.join(blocks.select(F.col("h").alias(f"h_{c}"), F.col("i").alias(f"i_{c}"), F.col("ids").alias(f"ids_{c}")), [f"h_{c}", f"i_{c}"])
    pairs = met.withColumn("x", F.explode("ids_a")).withColumn("y", F.explode("ids_b")).filter("x < y or (x > y and (h_a <> h_b or i_a < i_b))")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def near_links(docs: DataFrame, *, bands: int = 16, rows: int = 4, similarity: float = 0.8, k: int = 5, block: int = BLOCK, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """node, root: the components of those near_pairs(docs, docs) that agree on a band of their signatures, without making all pairs of groups that hang together.

    found: sketched() and classes() of docs, if there are.

    In buckets of more than block classes, each class is first compared with the bucket's smallest class; then, as long as
    that joins something, with one drawn anew. After that only pairs of different components are left to compare, and in a
    bucket only those with a class outside its largest component. What is compared is each bucket once a round and those
    pairs; none that could join two components is left out.
    """
    from .graph import components

    sets = found or (made := sketched(docs, k, bands, rows), classes(made))
    keys = shared_bands(in_bands(*sets))
    bucket, roots = ["band", "key"], None

    def placed(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("id"))
        return df.join(roots, F.col("id") == F.col("node"), "left").select("id", "n", *bucket, F.coalesce("root", "id").alias("root"))

    def joined(found: DataFrame) -> bool:
        """Whether there are such links; components so far count as links from each member to its root."""
        nonlocal roots
        links = written(found.select("a", "b"), "links")
        if links.isEmpty():
            return False
        known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = written(components(known), "roots")
        return True

    full = written(keys.filter(F.col("m") > block).select(*bucket, "id", "n"), "full")
    draw, more = 0, not full.isEmpty()
    while more:
        own = placed(full)
        one = F.struct(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("hub_root"))
        first = F.min_by(one, F.struct(F.xxhash64(F.lit(draw), "id") if draw else F.lit(0).cast("long"), F.col("id")))
        hubs = own.groupBy(bucket).agg(first.alias("hub")).select(*bucket, "hub.*")
        star = own.join(hubs, bucket).filter("root <> hub_root").select("a", "n_a", F.col("id").alias("b"), F.col("n").alias("n_b"))
        more = joined(verified(star, sets, sets, similarity))
        draw += 1
    own = written(placed(keys), "placed")
    sizes = own.groupBy(*bucket, "root").agg(F.count("*").alias("m"))
    top = sizes.groupBy(bucket).agg(F.max(F.struct("m", "root"))["root"].alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    open_ = own.join(top, bucket)
    small = open_.filter("root <> top").select(*bucket, F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    rest = in_blocks(small, open_.select(*bucket, F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), "top"), block)
    rest = rest.filter((F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("top")) | (F.col("a") < F.col("b"))))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    joined(verified(rest, sets, sets, similarity))
    return sets[1].select(F.col("id").alias("node"), F.col("id").alias("root")).limit(0) if roots is None else roots


def leaks(train: DataFrame, held: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """held_id, train_id, share of held's shingles that the train document has, where it is at least so high."""
    h = held.select(F.col("id").alias("held_id"), shingles(hash_form(F.col("text")), k).alias("s"))
    long = h.select("held_id", F.size("s").alias("n"), F.explode("s").alias("g"))
    # the held-out side is the small one: its shingles are found in the train side by a semi join before pairs are made
    t = train.select(F.col("id").alias("train_id"), F.explode(shingles(hash_form(F.col("text")), k)).alias("g"))
    return t.join(long, "g").groupBy("held_id", "train_id").agg((F.count("*") / F.first("n")).alias("share")).filter(F.col("share") >= share)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, n."""
    return docs.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def coverage(counts: DataFrame, tops: list[int]) -> DataFrame:
    """top, share of all tokens that the most frequent top types are. Only types, not tokens, are ordered."""
    most = max(tops)
    best = counts.orderBy(F.desc("n"), "token").limit(most).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "token")))
    total = counts.agg(F.sum("n").alias("total"))
    one = best.crossJoin(F.broadcast(total)).agg(F.array(*[F.struct(F.lit(k).alias("top"), (F.sum(F.when(F.col("r") <= k, F.col("n"))) / F.first("total")).alias("share")) for k in tops]).alias("x"))
    return one.select(F.inline("x"))


def zipf(counts: DataFrame, ranks: list[int]) -> DataFrame:
    placed = running_by_range(counts, [F.desc("n"), F.asc("token")], {"rank": F.lit(1)})
    return placed.filter(F.col("rank").isin(ranks)).select(F.col("rank").cast("int").alias("rank"), "token", "n")


def pair_counts(counts: DataFrame) -> DataFrame:
    """left, right, n: adjacent symbols of words, weighted by the words' counts."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(F.substring("token", i, F.lit(1)).alias("left"), F.substring("token", i + 1, F.lit(1)).alias("right")))
    return counts.filter(F.length("token") > 1).select("n", F.inline(pairs)).groupBy("left", "right").agg(F.sum("n").alias("n"))


def distinctness(docs: DataFrame, text: str = "text", sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """k, grams, distinct, ratio of the k-grams of words of all texts together."""
    w = docs.select(words(F.col(text)).alias("w"))
    out = None
    for k in sizes:
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
        counts = w.filter(F.size("w") >= k).select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        one = counts.agg(F.lit(k).alias("k"), F.sum("n").alias("grams"), F.count("*").alias("distinct"), (F.count("*") / F.sum("n")).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out


def cross_entropy(train: DataFrame, test: DataFrame) -> DataFrame:
    """Unigram cross-entropy of test tokens under add-one smoothed train counts, in nats. Both: token, n."""
    size = train.agg(F.sum("n").alias("total"), (F.count("*") + 1).alias("types"))
    p = (F.coalesce(F.col("m"), F.lit(0)) + 1) / (F.col("total") + F.col("types"))
    joined = test.join(train.select("token", F.col("n").alias("m")), "token", "left").crossJoin(F.broadcast(size))
    return joined.agg((-F.sum(F.col("n") * F.ln(p)) / F.sum("n")).alias("nats"), F.sum("n").alias("tokens"))


def rendered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, prompt: turns in order, each as <|role|> and its text."""
    part = F.struct(turn, F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n")).alias("p"))
    return turns.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]), "").alias("prompt"))


def packed(turns: DataFrame, limit: int, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """conv, tokens, supervised (assistant's), kept: whether it fits."""
    n = F.size(words(F.col(text)))
    return turns.groupBy(conv).agg(F.sum(n).alias("tokens"), F.sum(F.when(F.col(role) == "assistant", n).otherwise(0)).alias("supervised")).withColumn("kept", F.col("tokens") <= limit)


def near_clusters(docs: DataFrame, similarity: float = 0.8, k: int = 5, block: int = BLOCK, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, cluster (the smallest id in it) and its size of every document (id, text): texts that are alike, or alike to one alike.

    found: sketched() in 16 bands of 4 and classes() of docs, if there are.
    """
    made, reps = found or (one := sketched(docs, k, 16, 4), classes(one))
    roots = near_links(docs, similarity=similarity, k=k, block=block, found=(made, reps))
    named = reps.join(roots, F.col("id") == F.col("node"), "left").select("h", F.coalesce("root", "id").alias("cluster"))
    out = written(made.select("id", "h").join(named, "h").select("id", "cluster"), "members")
    return out.join(out.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("id", "cluster", "size")


def planted_recall(docs: DataFrame, every: int, similarity: float = 0.8) -> DataFrame:
    """Positive control of the duplicate detector: kind, planted, found, recall.

    Of every so-many-th document by hash of its id (id, text; of 20 words at least) an exact copy and one with words more
    at its end are added under new ids; they are found if they come into their document's cluster.
    """
    some = docs.filter((F.pmod(F.xxhash64("id"), F.lit(every)) == 0) & (F.size(words(F.col("text"))) >= 20)).select("id", "text")
    made = some.select("id", "text", F.explode(F.array(F.lit("exact"), F.lit("near"))).alias("kind"))
    copies = made.select(
        F.concat_ws("#", F.col("id").cast("string"), "kind").alias("id"), F.when(F.col("kind") == "near", F.concat("text", F.lit(" the end"))).otherwise(F.col("text")).alias("text"), "kind", F.col("id").cast("string").alias("of")
    )
    pool = docs.select(F.col("id").cast("string").alias("id"), "text").unionByName(copies.select("id", "text"))
    cluster = written(near_clusters(pool, similarity).select("id", "cluster"), "clusters")
    hit = copies.select("id", "kind", "of").join(cluster, "id").join(cluster.select(F.col("id").alias("of"), F.col("cluster").alias("home")), "of")
    out = hit.groupBy("kind").agg(F.count("*").alias("planted"), F.count_if(F.col("cluster") == F.col("home")).alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("planted"))


def prepared(docs: DataFrame, held: DataFrame, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """(documents that stay, audit): short ones, exact copies, near copies and those that leak held-out texts (id, text) go in turn.

    The audit has stage, documents and characters after each stage, in order of the column place. Texts are read for their
    sketches and for their lengths; stages are tables of ids. An exact copy is in its document's class, so clusters are the
    same with it, and a document leaks or not by itself.
    """
    long = docs.filter(F.length("text") >= least_chars)
    made = sketched(long, 5, 16, 4)
    found = made, classes(made)
    now = written(long.select("id", F.length("text").alias("size")), "long")
    stages = [("read", docs.select(F.length("text").alias("size"))), ("long enough", now)]
    now = written(now.join(made.groupBy("form").agg(F.min("id").alias("id")), "id", "left_semi"), "no-copies")
    stages.append(("no exact copies", now))
    now = written(now.join(near_clusters(long, found=found).filter("id = cluster").select("id"), "id", "left_semi"), "no-near")
    stages.append(("no near copies", now))
    asked = sketched(held, 5).select(F.col("id").alias("held_id"), "n", F.explode("s").alias("g"))
    shared = made.select("id", F.explode("s").alias("g")).join(asked, "g").join(now, "id", "left_semi").groupBy("held_id", "id").agg((F.count("*") / F.first("n")).alias("share"))
    now = written(now.join(shared.filter("share >= 0.8").select("id"), "id", "left_anti"), "no-leaks")
    stages.append(("no leaks", now))
    rows = [df.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("characters")).select(F.lit(i).alias("place"), F.lit(name).alias("stage"), "documents", "characters") for i, (name, df) in enumerate(stages)]
    audit = rows[0]
    for row in rows[1:]:
        audit = audit.unionByName(row)
    return docs.join(now.select("id"), "id", "left_semi"), audit


def as_conversations(records: DataFrame, templates: list[str]) -> DataFrame:
    """id, turn, role, text of records (id, asked, reply): the user's turn by one of the templates (its {} is what is asked), dealt by id."""
    picked = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod(F.col("id"), F.lit(len(templates))) + 1).cast("int"))
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.replace(picked, F.lit("{}"), F.col("asked")).alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")))
    return records.select("id", F.inline(turns))


def compliance(keywords: Column, reply: Column) -> Column:
    """Share of the keywords that the reply has, in whatever case; null where none is asked for."""
    held = F.filter(keywords, lambda w: F.contains(F.lower(reply), F.lower(w)))
    return F.when(F.size(keywords) > 0, F.size(held) / F.size(keywords))


def bigram_entropy(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Cross-entropy in nats of the test bigrams under add-one smoothed conditional bigram counts of the train texts, and their number.

    Both sides' bigrams are counted in one pass, into a table with n and m. A text's last word comes with no second one, so
    each word of the train texts is the first of some row.
    """
    own = lambda df, trains: df.select(words(F.col(text)).alias("w")).withColumn("trains", F.lit(trains))
    # a column of its own, so that a text is split once, not for each use of its words
    w = own(train, True).unionByName(own(test, False)).filter(F.size("w") > 0)
    pairs = F.inline(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.size("w") - 1).alias("y")))
    counts = w.select("trains", pairs).groupBy("x", "y").agg(F.count_if("trains").alias("n"), F.count_if(~F.col("trains")).alias("m"))
    counts = written(counts, "bigrams")
    firsts = counts.filter("n > 0").groupBy("x").agg(F.sum(F.when(F.col("y").isNotNull(), F.col("n")).otherwise(0)).alias("of_x"))
    types = firsts.agg((F.count("*") + 1).alias("types"))
    asked = counts.filter("m > 0 and y is not null").join(firsts, "x", "left").crossJoin(F.broadcast(types))  # one row
    nats = -F.ln((F.col("n") + 1) / (F.coalesce("of_x", F.lit(0)) + F.col("types")))
    return asked.agg((F.sum(F.col("m") * nats) / F.sum("m")).alias("nats"), F.sum("m").alias("bigrams"))


def repetition(docs: DataFrame, text: str = "text", k: int = 4) -> DataFrame:
    """One row: k-grams of words, share of those that repeat an earlier one of their text, mean words of a text, types over tokens."""
    w = docs.select(words(F.col(text)).alias("w"))
    grams = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))
    by = w.select(F.size("w").alias("n"), bound(grams, lambda g: F.struct(F.size(g).alias("all"), F.size(F.array_distinct(g)).alias("own"))).alias("g"))
    one = by.agg(F.sum("g.all").alias("grams"), (F.sum(F.col("g.all") - F.col("g.own")) / F.greatest(F.sum("g.all"), F.lit(1))).alias("repeated"), F.avg("n").alias("mean_words"))
    types = w.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("n")).agg((F.count("*") / F.greatest(F.sum("n"), F.lit(1))).alias("type_token_ratio"))
    return one.crossJoin(types)
