"""The queries opN_<name>, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Host, path and whether the rule allows.
URL_RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False)]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id")).select("doc_id", "toxic")
    model = fit(docs, labels)
    return toxicity_scores(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import as_text, edited_fingerprints, likeness

    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import by_component, whitened

    out = by_component(whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_mix, op3_simhash, op4_exact_dedup, op5_warc, op6_url_filter, op7_token_count, op8_html_text, op9_toxicity, op10_line_dedup, op11_fingerprints, op12_whitening, op13_phrases)
}

_BLANK = r"[\x20\x09-\x0D]"
_STRIPPED = rf"regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', '')"
_KEY = f"translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM q""",
    "op4_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_BLANK}+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h)""",
    "op13_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece,
                   regexp_extract_all(p, '[^\x20\x09]+') AS w
            FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        grams AS (
            SELECT lang, s AS size, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase
            FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s)),
        counted AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
        cuts AS (SELECT c.*, unnest(range(1, size)) AS k FROM counted c WHERE size > 1),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
            FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
                        JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        held AS (
            SELECT lang, array_to_string(list_slice(w, f, f + m - 1), ' ') AS phrase, max(a) AS most
            FROM (SELECT *, unnest(range(1, size - m + 2)) AS f FROM (SELECT *, unnest(range(2, size)) AS m FROM counted WHERE size > 2))
            GROUP BY 1, 2),
        kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE most IS NULL OR 100 * most::HUGEINT < 80 * b.a::HUGEINT)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
    "op10_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
        frequent AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT a.doc_id, pos, line, f.k IS NOT NULL AND a.doc_id <> holder AS gone FROM keyed a LEFT JOIN frequent f ON a.k = f.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}
