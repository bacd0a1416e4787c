"""Scalar functions, text corpus and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import retrieval as R
from ..operators import text as K
from ..operators.quantiles import quantiles
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


def places(t: Tables) -> DataFrame:
    """Two points per customer, made of its numbers."""
    return t.customer.select("c_custkey", (40.5 + F.col("c_nationkey") / 100).alias("a"), (-74.2 + F.col("c_custkey") % 97 / 200).alias("b"), (40.6 + F.col("c_custkey") % 41 / 150).alias("c"), (-74.0 + F.col("c_nationkey") / 90).alias("d"))


_PLACES = "p AS (SELECT c_custkey, 40.5::DOUBLE + c_nationkey / 100 AS a, -74.2::DOUBLE + c_custkey % 97 / 200 AS b, 40.6::DOUBLE + c_custkey % 41 / 150 AS c, -74.0::DOUBLE + c_nationkey / 90 AS d FROM customer)"


@query(f"WITH {_PLACES} SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2)), 8) AS km FROM p")
def x1_haversine(t: Tables) -> DataFrame:
    return places(t).select("c_custkey", F.round(X.haversine_km(*map(F.col, "abcd")), 8).alias("km"))


@query(f"WITH {_PLACES} SELECT c_custkey, round((degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360) % 360, 6) AS deg FROM p")
def x2_bearing(t: Tables) -> DataFrame:
    return places(t).select("c_custkey", F.round(X.bearing_deg(*map(F.col, "abcd")), 6).alias("deg"))


@query(f"WITH {_PLACES}, l AS (SELECT c_custkey, radians(c - a) * 6371.0088 AS n, radians(d - b) * cos(radians((a + c) / 2)) * 6371.0088 AS e FROM p) SELECT c_custkey, round(abs(e * cos(radians(29)) + n * sin(radians(29))) + abs(n * cos(radians(29)) - e * sin(radians(29))), 8) AS km FROM l")
def x3_grid(t: Tables) -> DataFrame:
    return places(t).select("c_custkey", F.round(X.grid_km(*map(F.col, "abcd")), 8).alias("km"))


@query(f"WITH {_PLACES} SELECT c_custkey, round((a + c) / 2, 8) AS lat, round((b + d) / 2, 8) AS lon FROM p")
def x5_midpoint(t: Tables) -> DataFrame:
    return places(t).select("c_custkey", F.round((F.col("a") + F.col("c")) / 2, 8).alias("lat"), F.round((F.col("b") + F.col("d")) / 2, 8).alias("lon"))


@query("""WITH e AS (SELECT event_id, hour(ts) AS h, isodow(ts) - 1 AS w, hour(ts) * 60 + minute(ts) AS m, ts FROM events) SELECT event_id, h AS hour, w AS dow, month(ts) AS month, dayofyear(ts) AS day_of_year, m AS minute_of_day, (w >= 5)::INT AS weekend, (w < 5 AND h BETWEEN 7 AND 9)::INT AS am_rush,
    (w < 5 AND h BETWEEN 16 AND 19)::INT AS pm_rush, (h >= 22 OR h <= 5)::INT AS night, round(sin(2 * pi() * m / 1440), 8) AS sin_day, round(cos(2 * pi() * m / 1440), 8) AS cos_day, round(sin(2 * pi() * w / 7), 8) AS sin_week, round(cos(2 * pi() * w / 7), 8) AS cos_week FROM e""")
def x7_to_x9_time_parts(t: Tables) -> DataFrame:
    parts = X.time_parts(F.col("ts"))
    return t.events.select("event_id", *[(F.round(c, 8) if n[:3] in ("sin", "cos") else c).alias(n) for n, c in parts.items()])


@query("SELECT o_orderkey, (date_trunc('week', o_orderdate::DATE - 1)::DATE + 1)::DATE AS week, date_trunc('month', o_orderdate)::DATE AS month FROM orders")
def x10_periods(t: Tables) -> DataFrame:
    from ..operators.business import period

    return t.orders.select("o_orderkey", period(F.col("o_orderdate"), "week").alias("week"), period(F.col("o_orderdate"), "month").alias("month"))


@query("SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS l, round(exp(ln(1 + greatest(c_acctbal, 0))) - 1, 4) AS e FROM customer")
def x13_log1p(t: Tables) -> DataFrame:
    held = F.log1p(F.greatest("c_acctbal", F.lit(0.0)))
    return t.customer.select("c_custkey", F.round(held, 9).alias("l"), F.round(F.expm1(held), 4).alias("e"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax / (l_discount + 1e-9), 4) AS r, round(CASE WHEN abs(l_discount) > 1e-12 THEN l_tax / l_discount ELSE 0 END, 8) AS s FROM lineitem")
def x14_x15_safe_ratios(t: Tables) -> DataFrame:
    from ..functions.measures import safe

    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_tax") / (F.col("l_discount") + 1e-9), 4).alias("r"), F.round(safe(F.col("l_tax"), F.col("l_discount")), 8).alias("s"))


@query("SELECT p_partkey, regexp_extract(p_brand, '#(\\d+)', 1)::INTEGER AS brand, split_part(p_name, ' ', 1) AS first_word, coalesce(left(p_type, 1), 'U') AS kind FROM part")
def x16_x17_extract(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("brand"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.coalesce(F.substring("p_type", 1, 1), F.lit("U")).alias("kind"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, sha1({_NORM}) AS digest FROM documents")
def x18_x19_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(X.hash_form(F.col("text")).cast("binary")).alias("digest"))


@query(rf"""WITH w AS (SELECT doc_id, string_split({_NORM}, ' ') AS w FROM documents), g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w) SELECT doc_id, count(*) AS shingles FROM g GROUP BY 1""")
def x20_shingles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.shingles(X.hash_form(F.col("text")), 5)).cast("long").alias("shingles"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_.%-]+')) AS tokens FROM documents")
def x21_search_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(R.TOKEN), F.lit(0))).cast("long").alias("tokens"))


@query(r"SELECT doc_id, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '\p{Nd}', '', 'g')) AS digits, length(text) - length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) AS spaces, length(text) AS chars, strlen(text) AS bytes FROM documents")
def x23_x24_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *[c.cast("long").alias(n) for n, c in X.class_counts(F.col("text")).items()], F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def x27_chat_template(t: Tables) -> DataFrame:
    return K.rendered(t.conversations)


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def x28_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'view,Click' ELSE 'view,Click,error' END AS tags FROM (SELECT DISTINCT user_id FROM events)")
def x29_tags(t: Tables) -> DataFrame:
    raw = F.array(F.lit(" #view "), F.lit("Click"), F.lit("click"), F.lit("##VIEW"), F.lit("  "), F.when(F.col("user_id") % 3 == 0, "#").otherwise("error"))
    return t.events.select("user_id").distinct().select("user_id", F.array_join(X.normalised_tags(raw), ",").alias("tags"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN NOT (l_quantity <= 45) THEN 'quantity' END, CASE WHEN NOT (l_returnflag IN ('A', 'N')) THEN 'flag' END], lambda x: x IS NOT NULL), ',') AS problems FROM lineitem WHERE NOT (l_quantity <= 45 AND l_returnflag IN ('A', 'N'))")
def x30_validation(t: Tables) -> DataFrame:
    judged = t.lineitem.withColumn("problems", X.problems({"quantity": F.col("l_quantity") <= 45, "flag": F.col("l_returnflag").isin("A", "N")}))
    return judged.filter(F.size("problems") > 0).select("l_orderkey", "l_linenumber", F.array_join("problems", ",").alias("problems"))


@query("WITH h AS (SELECT c_custkey, h.h AS hour, c_acctbal * (1 + ((h.h * 7 + c_custkey) % 24) / 10.0) AS score FROM customer, range(24) h(h)) SELECT c_custkey, arg_max(hour, (score, hour))::INTEGER AS best, arg_min(hour, (score, hour))::INTEGER AS worst FROM h GROUP BY 1")
def x33_scenarios(t: Tables) -> DataFrame:
    score = lambda hour: F.col("c_acctbal") * (1 + ((hour * 7 + F.col("c_custkey")) % 24) / 10.0)
    all_ = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda hour: F.struct(score(hour).alias("score"), hour.alias("hour")))
    # the best and the worst of a row's 24 are found within the row
    own = t.customer.select("c_custkey", all_.alias("x")).select("c_custkey", F.array_max("x").alias("best"), F.array_min("x").alias("worst"))
    return own.groupBy("c_custkey").agg(F.max("best")["hour"].alias("best"), F.min("worst")["hour"].alias("worst"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 136)) AS pos FROM w) SELECT doc_id, pos AS "at", len(w[pos + 1:pos + 160]) AS words FROM s WHERE len(w[pos + 1:pos + 160]) >= 20""")
def x34_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.inline(X.chunks(F.col("text"), 160, 24, 20))).select("doc_id", F.col("at").cast("long").alias("at"), F.size("words").cast("long").alias("words"))


@query(r"SELECT doc_id, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentences, len(regexp_extract_all(text, '\p{L}+')) AS words FROM documents")
def x35_readability(t: Tables) -> DataFrame:
    parts = X.readability(F.col("text"))
    return t.documents.select("doc_id", parts["sentences"].cast("long").alias("sentences"), parts["words"].cast("long").alias("words"))


@query("SELECT doc_id, 'license' AS term, len(regexp_extract_all(text, 'Licensed')) AS n, instr(text, 'Licensed') AS at FROM documents WHERE contains(text, 'Licensed') UNION ALL SELECT doc_id, 'tion', len(regexp_extract_all(text, 'tiontion')), instr(text, 'tiontion') FROM documents WHERE contains(text, 'tiontion')")
def x36_pattern_hits(t: Tables) -> DataFrame:
    hits = X.pattern_hits(F.col("text"), {"license": "Licensed", "tion": "tiontion"})
    return t.documents.select("doc_id", F.inline(hits)).select("doc_id", "term", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"))


@query("SELECT doc_id, ceil(length(text) / CASE WHEN (length(text) - length(translate(text, '{};=()', ''))) * 20 > length(text) THEN 3.0 ELSE 4.0 END)::BIGINT AS tokens FROM documents")
def x37_token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


# corpus


@query(rf"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORM}) AS keep_id FROM documents")
def k1_exact_groups(t: Tables) -> DataFrame:
    return K.exact_groups(t.documents)


@query()
def k3_near_pairs(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return K.near_documents(docs).withColumn("similarity", F.round("similarity", 8))


@query(rf"""WITH n AS (SELECT doc_id AS id, string_split({_NORM}, ' ') AS w FROM documents), d AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM n),
    m AS (SELECT item_id AS id, string_split({_NORM}, ' ') AS w FROM benchmark), b AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM m), c AS (SELECT id, count(*) AS n FROM b GROUP BY 1)
    SELECT b.id AS held_id, d.id AS train_id, round(count(*) / any_value(c.n), 8) AS share FROM b JOIN d USING (g) JOIN c ON c.id = b.id GROUP BY 1, 2 HAVING count(*) / any_value(c.n) >= 0.8""")
def k6_leaks(t: Tables) -> DataFrame:
    found = K.leaks(t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("id"), "text"))
    return found.withColumn("share", F.round("share", 8))


@query("SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.95) AS p95 FROM documents GROUP BY 1")
def k8_profile(t: Tables) -> DataFrame:
    n = F.length("text")
    sums = t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    found = quantiles(t.documents.select("lang", n.alias("n")), "n", [0.5, 0.95], ["lang"]).withColumnRenamed("lang", "_lang")
    return sums.join(found, F.col("lang").eqNullSafe(F.col("_lang")), "left").select("lang", "docs", "chars", "bytes", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p95"))


_FREQ = r"f AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY 1)"


@query(f"WITH {_FREQ} SELECT token, n FROM f")
def k9_frequencies(t: Tables) -> DataFrame:
    return K.frequencies(t.documents)


@query(f"WITH {_FREQ}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, token) AS r FROM f) SELECT k.k::INTEGER AS top, round(sum(n) FILTER (WHERE r <= k.k) / (SELECT sum(n) FROM f), 8) AS share FROM r, (VALUES (10), (100), (1000)) k(k) GROUP BY 1")
def k9_coverage(t: Tables) -> DataFrame:
    return K.coverage(K.frequencies(t.documents), [10, 100, 1000]).withColumn("share", F.round("share", 8))


@query(f"WITH {_FREQ}, r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS r FROM f) SELECT r::INTEGER AS rank, token, n FROM r WHERE r IN (1, 2, 5, 10, 20, 50, 100, 200, 500)")
def w12_zipf(t: Tables) -> DataFrame:
    return K.zipf(K.frequencies(t.documents), [1, 2, 5, 10, 20, 50, 100, 200, 500])


@query(f"WITH {_FREQ}, p AS (SELECT token, n, unnest(range(1, length(token))) AS i FROM f) SELECT substr(token, i, 1) AS \"left\", substr(token, i + 1, 1) AS \"right\", sum(n)::BIGINT AS n FROM p GROUP BY 1, 2")
def k11_pair_counts(t: Tables) -> DataFrame:
    return K.pair_counts(K.frequencies(t.documents))


@query(r"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT k.k AS k, unnest(list_transform(range(1, len(w) - k.k + 2), lambda i: array_to_string(w[i:i + k.k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3)) k(k) WHERE len(w) >= k.k) SELECT k::INTEGER AS k, count(*) AS grams, count(DISTINCT g) AS "distinct", round(count(DISTINCT g) / count(*), 8) AS ratio FROM g GROUP BY 1""")
def a28_distinctness(t: Tables) -> DataFrame:
    return K.distinctness(t.benchmark).withColumn("ratio", F.round("ratio", 8))


@query(r"""WITH a AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents WHERE doc_id % 10 <> 0) WHERE token <> '' GROUP BY 1), b AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents WHERE doc_id % 10 = 0) WHERE token <> '' GROUP BY 1),
    s AS (SELECT sum(n) AS total, count(*) + 1 AS types FROM a) SELECT round(-sum(b.n * ln((coalesce(a.n, 0) + 1) / (total + types))) / sum(b.n), 6) AS nats, sum(b.n)::BIGINT AS tokens FROM b LEFT JOIN a USING (token), s""")
def k17_cross_entropy(t: Tables) -> DataFrame:
    train, test = t.documents.filter("doc_id % 10 <> 0"), t.documents.filter("doc_id % 10 = 0")
    return K.cross_entropy(K.frequencies(train), K.frequencies(test)).select(F.round("nats", 6).alias("nats"), "tokens")


@query(r"WITH c AS (SELECT conv_id, role, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS supervised, sum(n) <= 400 AS kept FROM c GROUP BY 1")
def k14_packing(t: Tables) -> DataFrame:
    return K.packed(t.conversations, 400)


# retrieval


_BM25 = """i AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_.%-]+')) AS term FROM documents) GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM i GROUP BY 1), z AS (SELECT avg(len) AS mean, count(*) AS n FROM l),
    r AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM i, z GROUP BY term, n), d AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM r) ELSE idf END AS idf FROM r),
    q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_.%-]+')) AS term FROM benchmark) GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 9) AS score FROM q JOIN i USING (term) JOIN d USING (term) JOIN l USING (doc_id), z GROUP BY 1, 2),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def lexical(t: Tables, k: int) -> DataFrame:
    return R.bm25(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"), k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm WHERE rank <= 10")
def r1_bm25(t: Tables) -> DataFrame:
    return lexical(t, 10).withColumn("score", F.round("score", 6))


_COS = "v AS (SELECT vec_id, embedding AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0), cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)"


def dense(t: Tables, k: int) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return R.dense(rows, rows.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), k)


@query(f"WITH {_COS} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM cr WHERE rank <= 10")
def r2_dense(t: Tables) -> DataFrame:
    return dense(t, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS}, o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM cr WHERE rank <= 20), u AS (SELECT query_id, doc_id, rank FROM cr WHERE rank <= 20 UNION ALL SELECT * FROM o), f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 12) AS score FROM u GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM g WHERE rank <= 10")
def r3_fusion(t: Tables) -> DataFrame:
    best = dense(t, 20)
    turned = best.withColumn("rank", 21 - F.col("rank"))
    return R.fused([best, turned], 10).withColumn("score", F.round("score", 9))


@query(f"WITH {_BM25}, g AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), h AS (SELECT g.query_id, min(rank) FILTER (WHERE rank <= 20) AS r FROM g LEFT JOIN bm ON bm.query_id = g.query_id AND bm.doc_id = g.doc_id GROUP BY 1) SELECT round(avg(coalesce(1 / r, 0)), 8) AS mrr, round(avg(coalesce((r <= 1)::INT, 0)), 8) AS recall_1, round(avg(coalesce((r <= 10)::INT, 0)), 8) AS recall_10 FROM h")
def r4_retrieval_scores(t: Tables) -> DataFrame:
    gold = R.holders(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")))
    return R.scored(lexical(t, 20), gold, (1, 10)).select(*[F.round(c, 8).alias(c) for c in ("mrr", "recall_1", "recall_10")])
