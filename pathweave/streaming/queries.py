"""Structured Streaming: query streams against the static graph, resume by completed ids, idempotent sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths as P
from ..sources import graph as G
from .store import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def answer_stream(queries: DataFrame, edges: DataFrame, out: str, checkpoint: str, k: int):
    """Each micro-batch of queries (query_id, source, relation_1, relation_2) is one batch plan against the static edges. Returns the started query."""
    return _answering(queries, edges, out, checkpoint, k).trigger(availableNow=True).start()


def _answering(queries: DataFrame, edges: DataFrame, out: str, checkpoint: str, k: int):
    """Ids that the sink already holds are left out, and a batch writes to a folder of its own number, so that a batch
    that is run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{out}/batch={number}"
        fresh = batch.dropDuplicates(["query_id"])
        # all batches before this one (as read, so that listing works on any file system)
        if number > 0:
            done = spark.read.schema(RESULT).parquet(f"{out}/batch=*").where(F.col("batch_number") < number).select("query_id").distinct()
            fresh = fresh.join(done, "query_id", "left_anti")
        P.ranked(P.two_hop(edges, fresh), k).select("query_id", "rank", "mid", "target", "score", F.lit(number).cast("long").alias("batch_number")).write.mode("overwrite").parquet(target)

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


RESULT = "query_id string, rank int, mid string, target string, score long, batch_number long"


def deduplicated(events: DataFrame, watermark: str = "10 minutes"):
    """First appearance of each event id within the watermark; state is bounded by it."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def _event_stream(spark, sf_dir: str) -> DataFrame:
    static = G.table(spark, sf_dir, "events")
    return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def x1_stream_two_hop(spark, sf_dir: str) -> DataFrame:
    """Customers as a stream of queries: each answered with its best order-part path."""
    e = G.edges(spark, sf_dir)
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    static = G.table(spark, sf_dir, "customer")
    source = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/customer.parquet*")
    label = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    queries = source.select(label.alias("query_id"), label.alias("source"), F.lit("in_nation").alias("relation_1"), F.lit("in_region").alias("relation_2"))
    run = answer_stream(queries, e, f"{folder}/out", f"{folder}/state", 1)
    run.awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{folder}/out/batch=*").select("query_id", "mid", "target", "score")


def x2_stream_dedup(spark, sf_dir: str) -> DataFrame:
    """The event stream without repeated ids, written by a streaming query and read back."""
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    out = deduplicated(_event_stream(spark, sf_dir)).select("event_id", "event_type")
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


REQUEST = "query_id string, source string, relation_1 string, relation_2 string"


def serve(spark, requests: str, edges: DataFrame, out: str, checkpoint: str, k: int):
    """A query that stays: each file of requests (JSON lines) that is moved into the folder is answered as one batch. Returns the started query."""
    lines = spark.readStream.schema(REQUEST).json(requests)
    return _answering(lines, edges, out, checkpoint, k).trigger(processingTime="200 milliseconds").start()


def x4_request_loop(spark, sf_dir: str) -> DataFrame:
    """Two lots of requests, of nations with even and odd numbers, to a running loop: each nation's region and the nations in it."""
    folder = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    n = G.table(spark, sf_dir, "nation")
    label = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    asked = n.select("n_nationkey", label.alias("query_id"), label.alias("source"), F.lit("in_region").alias("relation_1"), F.lit("in_region_inverse").alias("relation_2"))
    spark.createDataFrame([], REQUEST).write.mode("append").json(f"{folder}/in")
    run = serve(spark, f"{folder}/in", G.edges(spark, sf_dir), f"{folder}/out", f"{folder}/state", 3)
    try:
        for odd in (0, 1):
            asked.where(F.col("n_nationkey") % 2 == odd).drop("n_nationkey").write.mode("append").json(f"{folder}/in")
            run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(RESULT).parquet(f"{folder}/out/batch=*").select("query_id", "rank", "mid", "target", "score")


QUERIES["X4_request_loop"] = x4_request_loop
QUERIES["X1_stream_two_hop"] = x1_stream_two_hop
QUERIES["X2_stream_dedup"] = x2_stream_dedup
ORACLE["X2_stream_dedup"] = "SELECT DISTINCT event_id, event_type FROM events"


def _oracle() -> str:
    from ..plans.oracle import GRAPH

    return GRAPH + "SELECT a.source AS query_id, a.target AS mid, b.target, CAST(a.score + b.score AS BIGINT) AS score FROM edges a JOIN edges b ON a.target = b.source WHERE a.relation = 'in_nation' AND b.relation = 'in_region'"


ORACLE["X1_stream_two_hop"] = _oracle()


def _loop_oracle() -> str:
    from ..plans.oracle import GRAPH, RANK, REGION_PATHS

    paths = REGION_PATHS.replace("in_nation_inverse", "in_region_inverse").replace("a.relation = 'in_region_inverse'", "a.relation = 'in_region'")
    return GRAPH + paths + f"SELECT query_id, CAST(rank AS INTEGER) AS rank, mid, target, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {RANK}) AS rank FROM paths) WHERE rank <= 3"


ORACLE["X4_request_loop"] = _loop_oracle()
