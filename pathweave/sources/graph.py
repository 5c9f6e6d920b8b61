"""The knowledge graph as one edge table: owner, source, relation, target, evidence, score.

Edges are a union of branches, one for each relation and direction, and each branch names its relation as a literal. So a
filter on ``relation`` folds to true or false in every branch, and what is left reads the one table that holds that relation.
``prepare`` stores the finished edges once, by relation and in order of source; ``edges`` then reads that layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(n, t) for n, t in (("owner", T.StringType()), ("source", T.StringType()), ("relation", T.StringType()), ("target", T.StringType()), ("evidence", T.LongType()), ("score", T.IntegerType()))])
QUERY = T.StructType([T.StructField(n, T.StringType()) for n in ("query_id", "source", "relation_1", "relation_2")])
INVERSE = "_inverse"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bucket(text: Column, n: int) -> Column:
    """First 8 bytes of SHA-256 as a big-endian number, modulo n."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def inverse_of(relation: Column) -> Column:
    """An involution: the suffix goes on, or comes off."""
    return F.when(relation.endswith(INVERSE), F.substring(relation, F.lit(1), F.length(relation) - len(INVERSE))).otherwise(F.concat(relation, F.lit(INVERSE)))


def with_inverses(triples: DataFrame) -> DataFrame:
    """Every triple and its inverse, as two branches that filters reach. Other columns ride along."""
    back = {"source": F.col("target"), "relation": inverse_of(F.col("relation")), "target": F.col("source")}
    return triples.unionByName(triples.select(*(back[c].alias(c) if c in back else F.col(c) for c in triples.columns)))


def owner_by(strategy: str, n: int) -> Column:
    """Subject, edge or relation-domain hash. An inverse edge follows its forward edge."""
    back = F.col("relation").endswith(INVERSE)
    forward = F.when(back, inverse_of(F.col("relation"))).otherwise(F.col("relation"))
    head, tail = F.when(back, F.col("target")).otherwise(F.col("source")), F.when(back, F.col("source")).otherwise(F.col("target"))
    keys = {"subject": head, "edge": F.concat_ws("\x1f", head, forward, tail), "relation_domain": F.substring_index(forward, "_", 1)}
    return F.concat(F.lit("o"), hash_bucket(keys[strategy], n))


def evidence_handle() -> Column:
    """A deterministic handle in [1, 2^48]."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", "source", "relation", "target"), 256), 1, 12), 16, 10).cast("long") + 1


#: Table, kind and key of the source, relation, kind and key of the target, and whether a pair may stand in several rows.
FACTS = [
    ("customer", "customer", "c_custkey", "in_nation", "nation", "c_nationkey", False),
    ("supplier", "supplier", "s_suppkey", "supplier_in_nation", "nation", "s_nationkey", False),
    ("nation", "nation", "n_nationkey", "in_region", "region", "n_regionkey", False),
    ("orders", "order", "o_orderkey", "placed_by", "customer", "o_custkey", False),
    ("lineitem", "order", "l_orderkey", "has_part", "part", "l_partkey", True),
    ("lineitem", "order", "l_orderkey", "supplied_by", "supplier", "l_suppkey", True),
    ("events", "user", "user_id", "performed", "event", "event_type", True),
]


def triples(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Forward triples of the star schema, distinct: primary keys stand once, other pairs are made distinct as plain keys, unless not ``once``."""
    label = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    rows = []
    for name, kind_1, key_1, relation, kind_2, key_2, repeats in FACTS:
        pairs = table(spark, sf_dir, name).select(F.col(key_1).alias("_1"), F.col(key_2).alias("_2"))
        pairs = pairs.distinct() if repeats and once else pairs
        rows.append(pairs.select(label(kind_1, "_1").alias("source"), F.lit(relation).alias("relation"), label(kind_2, "_2").alias("target")))
    return reduce(DataFrame.unionByName, rows)


def finish(rows: DataFrame, owners: int = 3, strategy: str = "subject") -> DataFrame:
    """Owner, evidence and score for (source, relation, target)."""
    return rows.withColumn("owner", owner_by(strategy, owners)).withColumn("evidence", evidence_handle()).withColumn("score", (1 + F.col("evidence") % 9).cast("int")).select([f.name for f in EDGE])


def _conf(sf_dir: str) -> str:
    return f"pathweave.graph.{sf_dir}"


def prepare(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """Stores the whole graph by relation, in order of source, and lets ``edges`` of this session read it. Returns the folder.

    Ranges over (relation, source) split large relations over many files and keep small ones in one; a file's statistics
    then skip all but the row groups of a wanted source.
    """
    if path is None:
        import uuid

        from ..streaming.store import shared_dir

        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    rows = finish(with_inverses(triples(spark, sf_dir)))
    rows.repartitionByRange("relation", "source").sortWithinPartitions("relation", "source").write.partitionBy("relation").parquet(path)
    spark.conf.set(_conf(sf_dir), path)
    return path


def forget(spark: SparkSession, sf_dir: str) -> None:
    """``edges`` computes from the tables again."""
    spark.conf.unset(_conf(sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph with inverse edges: the prepared layout where this session has one, else computed from the tables."""
    path = spark.conf.get(_conf(sf_dir), None)
    if path:
        return spark.read.schema(EDGE).parquet(path).select([f.name for f in EDGE])
    return finish(with_inverses(triples(spark, sf_dir)))


#: 2^21 words of 64 bits, whatever the number of handles.
_HANDLE_WORDS = 21


def edges_by_handle(spark: SparkSession, sf_dir: str, handles: DataFrame) -> DataFrame:
    """(source, relation, target, evidence) of every edge, of any relation, whose handle may be in handles(evidence): all that are, and some others.

    48 bits do not keep millions of edges apart, so a handle of one relation can name an edge of another. All edges are asked,
    against a bitmap of a fixed size by the handle's low bits; only what it lets through is exchanged, by handle, and made distinct.
    """
    word, bit = F.expr(f"evidence & {(1 << _HANDLE_WORDS) - 1}"), F.expr(f"shiftleft(1L, cast(shiftright(evidence, {_HANDLE_WORDS}) & 63 as int))")
    words = handles.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = edges(spark, sf_dir) if spark.conf.get(_conf(sf_dir), None) else finish(with_inverses(triples(spark, sf_dir, once=False)))
    # never null, so that no filter hashes every edge a second time
    rows = rows.select("source", "relation", "target", F.coalesce("evidence", F.lit(0)).alias("evidence")).withColumn("_word", word)
    near = rows.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return near.select("source", "relation", "target", "evidence").repartition("evidence").distinct()


def kind_of(c: str) -> Column:
    """The type of an entity: what stands before the colon."""
    return F.substring_index(F.col(c), ":", 1)
