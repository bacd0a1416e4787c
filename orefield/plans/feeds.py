"""Sources and sinks, each written to the shared folder from a table and read back; a stream scored by a saved model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as S
from ..sources.shared import new_folder
from ..streaming import events as T
from ..streaming.monitor import scored
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s1_typed_csv(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 's1')}/supplier.csv"
    t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.csv(path, header=True)
    return S.read_table(t.spark, path, schema="s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def s2_partitioned_parquet(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 's2')}/orders.parquet"
    S.save_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path, partition_by=["o_orderpriority"])
    return S.read_table(t.spark, path)


@query(r"SELECT doc_id, regexp_replace(source, '^\s+|\s+$', '', 'g') AS words, regexp_replace(lang, '^\s+|\s+$', '', 'g') AS summary, regexp_replace(text, '^\s+|\s+$', '', 'g') AS story FROM documents")
def s6_labelled_fields(t: Tables) -> DataFrame:
    record = F.concat(F.lit("Words: "), "source", F.lit("\nSummary: "), "lang", F.lit("\nStory: "), "text")
    return t.documents.select("doc_id", S.labelled_fields(record, ["Words", "Summary", "Story"]).alias("f")).select("doc_id", "f.*")


@query("SELECT o_orderpriority, 2 * count(*) AS rows FROM orders GROUP BY 1")
def s8_table_sink(t: Tables) -> DataFrame:
    """Written, replaced and added to: the rows are there twice."""
    path = f"{new_folder(t.spark, 's8')}/orders.parquet"
    for mode in ("overwrite", "overwrite", "append"):
        S.save_table(t.orders.select("o_orderkey", "o_orderpriority"), path, mode)
    return S.read_table(t.spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("rows"))


@query("SELECT run, l_returnflag, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem, (VALUES (1::BIGINT), (2)) v(run) GROUP BY 1, 2")
def s9_ledger(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 's9')}/ledger.jsonl"
    by = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    for run in (1, 2):
        S.append_ledger(by.withColumn("run", F.lit(run)), path)
    return S.read_table(t.spark, path, schema="run BIGINT, l_returnflag STRING, lines BIGINT, quantity DOUBLE")


@query("SELECT event_id AS seq, event_type AS type, user_id AS origin, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s12_feed(t: Tables) -> DataFrame:
    """Events as a feed of JSON lines, read as a stream; the payload is parsed as it comes."""
    base = new_folder(t.spark, "s12")
    t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("user_id").alias("origin"), F.col("props").alias("data")).write.json(f"{base}/feed")
    feed = t.spark.readStream.schema("seq BIGINT, type STRING, origin BIGINT, data STRING").json(f"{base}/feed")
    T.run_once(feed.select("seq", "type", "origin", F.from_json("data", "k BIGINT")["k"].alias("k")), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity, 4) AS prediction, 'v1' AS model_version FROM lineitem")
def t9_scored_stream(t: Tables) -> DataFrame:
    """A fitted pipeline is saved, loaded and scores the rows as a stream."""
    base = new_folder(t.spark, "t9")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    stages = [VectorAssembler(inputCols=["l_quantity"], outputCol="features"), LinearRegression(labelCol="l_extendedprice", solver="normal")]
    Pipeline(stages=stages).fit(rows).write().overwrite().save(f"{base}/model")
    S.save_table(rows, f"{base}/rows")
    stream = scored(T.read_events(t.spark, f"{base}/rows", rows.schema, 4), PipelineModel.load(f"{base}/model"), "v1")
    T.run_once(stream.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 4).alias("prediction"), "model_version"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out")
