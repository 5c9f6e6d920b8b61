"""Readers and sinks: owner edge lists, triples, questions, nested knowledge bases, logs, SPARQL results, synthetic graphs."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import EDGE, INVERSE, with_inverses


def owner_edges(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One JSON array of edges for each owner. Rows with missing, extra or ill-typed fields fail (V2)."""
    fields = [f for f in EDGE if f.name != "owner"]
    schema = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    out = None
    for owner, path in paths.items():
        rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
        rows = rows.select(F.lit(owner).alias("owner"), *(f.name for f in fields), "_bad")
        out = rows if out is None else out.unionByName(rows)
    ok = F.col("_bad").isNull()
    for f in fields:
        ok = ok & F.col(f.name).isNotNull()
    return out.where(F.when(ok, True).otherwise(F.raise_error(F.lit("an edge is malformed")).isNull())).drop("_bad")


def delimited_triples(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """S3: head|relation|tail with inverses, distinct."""
    rows = spark.read.schema("source string, relation string, target string").option("sep", sep).option("quote", "").csv(path)
    return with_inverses(rows.distinct())


def questions_with_answers(spark: SparkSession, path: str) -> DataFrame:
    """question<TAB>a1|a2 with the topic in brackets."""
    rows = spark.read.schema("question string, answers string").option("sep", "\t").option("quote", "").csv(path)
    return rows.select("question", F.regexp_extract("question", r"\[([^\]]*)\]", 1).alias("topic"), F.split("answers", r"\|").alias("answers"))


QUESTION = "id string, split string, question string, groundtruths array<string>, query_graph array<array<string>>"


def question_rows(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """JSON lines of the wanted splits; repeated ids fail."""
    rows = spark.read.schema(QUESTION).json(path).where(F.col("split").isin(splits))
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated question ids: {[r['id'] for r in twice]}")
    return rows


def union_graph(subgraphs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, graph array<array<string>>) of the wanted ids as one distinct edge set with inverses; a missing id fails."""
    missing = ids.join(subgraphs.select("id"), "id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no subgraph for {[r['id'] for r in missing]}")
    rows = subgraphs.join(ids, "id", "left_semi").select(F.explode("graph").alias("t")).select(F.col("t")[0].alias("source"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("target")).distinct()
    return with_inverses(rows).distinct()


KB_ENTITY = T.MapType(T.StringType(), T.StructType([T.StructField("name", T.StringType()), T.StructField("instanceOf", T.ArrayType(T.StringType())), T.StructField("relations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("predicate", "object", "direction")])))]))


def nested_kb(text: DataFrame) -> DataFrame:
    """A column ``value`` with {entities: {id: {name, instanceOf, relations}}} as directed triples; backward ones get the suffix."""
    kb = text.select(F.from_json("value", T.StructType([T.StructField("entities", KB_ENTITY)])).alias("kb"))
    e = kb.select(F.explode("kb.entities").alias("id", "e")).select("id", F.explode("e.relations").alias("r"))
    name = F.when(F.col("r.direction") == "backward", F.concat("r.predicate", F.lit(INVERSE))).otherwise(F.col("r.predicate"))
    return e.select(F.col("id").alias("source"), name.alias("relation"), F.col("r.object").alias("target")).distinct()


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON, JSON lines, CSV or Parquet by suffix, always under a declared schema."""
    suffix = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema)
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    if suffix == "jsonl":
        return reader.json(path)
    if suffix in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "," if suffix == "csv" else "\t").csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format: {suffix}")


def party_graph(edges: DataFrame) -> DataFrame:
    """Sorted distinct targets of each key."""
    return edges.groupBy("source", "relation").agg(F.array_sort(F.collect_set("target")).alias("targets"))


@dataclass(frozen=True)
class PublicConfig:
    """The public dimensions of a graph. Unknown and missing keys fail, as do repeated owners and ids and bounds below one."""

    owners: tuple[str, ...]
    entities: dict[str, int]
    relations: dict[str, int]
    fanout_per_owner: int
    top_k: int
    relation_fanout_per_owner: int | None = None
    deduplicate_terminal_answers: bool = False
    score_bits: int = 20
    evidence_bits: int = 50
    field_prime: int = field(default=(1 << 61) - 1)

    @classmethod
    def of(cls, raw) -> PublicConfig:
        if not isinstance(raw, dict):
            raise ValueError("a configuration is a JSON object")
        names = cls.__dataclass_fields__
        needed = {"owners", "entities", "relations", "fanout_per_owner", "top_k"}
        if set(raw) - set(names) or needed - set(raw):
            raise ValueError(f"configuration keys: missing {sorted(needed - set(raw))}, unknown {sorted(set(raw) - set(names))}")
        out = cls(**(raw | {"owners": tuple(raw["owners"])}))
        for table in (out.entities, out.relations):
            if len(set(table.values())) < len(table) or any(isinstance(v, bool) or not isinstance(v, int) for v in table.values()):
                raise ValueError("ids must be whole numbers and stand once")
        bounds = [out.fanout_per_owner, out.top_k, out.score_bits, out.evidence_bits, *([out.relation_fanout_per_owner] if out.relation_fanout_per_owner is not None else [])]
        if len(set(out.owners)) < len(out.owners) or not out.owners or any(isinstance(b, bool) or not isinstance(b, int) or b < 1 for b in bounds):
            raise ValueError("owners must stand once and bounds be whole numbers from one on")
        return out

    def dimension(self, spark: SparkSession, name: str) -> DataFrame:
        """(name, id) of ``entities`` or ``relations``."""
        return spark.createDataFrame(sorted(getattr(self, name).items()), "name string, id long")


def load_config(spark: SparkSession, path: str) -> PublicConfig:
    """From any file system that Spark reads."""
    return PublicConfig.of(json.loads(spark.read.text(path, wholetext=True).collect()[0][0]))


def owners_once(edges: DataFrame, expected: list[str]) -> DataFrame:
    """V6: (owner, state) of owners that are missing, unexpected or named twice; empty where all is well."""
    want = edges.sparkSession.createDataFrame([(o,) for o in expected], "owner string").groupBy("owner").agg(F.count("*").alias("named"))
    held = edges.select("owner").distinct().withColumn("held", F.lit(True))
    state = F.when(F.col("named").isNull(), "unexpected").when(F.col("held").isNull(), "missing").when(F.col("named") > 1, "repeated")
    return want.join(held, "owner", "full").select("owner", state.alias("state")).where("state IS NOT NULL")


def topology_errors(roles: DataFrame, local: bool = False, least: dict[str, int] | None = None) -> DataFrame:
    """(error, id) of roles(kind, id, authority, endpoint): ids that repeat within or across kinds, kinds with fewer members or,
    unless ``local``, fewer independent authorities than ``least`` asks, and local endpoints."""
    least = least or {"data_party": 1, "evaluator": 2, "aggregator": 2}
    each = roles.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds")).where("n > 1")
    out = each.select(F.when(F.col("kinds") > 1, "id_in_two_kinds").otherwise("repeated_id").alias("error"), "id")
    asked = roles.sparkSession.createDataFrame(sorted(least.items()), "kind string, least int")
    counts = asked.join(roles.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("authority").alias("authorities")), "kind", "left").fillna(0)
    out = out.union(counts.where("n < least").select(F.lit("too_few_members"), "kind"))
    if not local:
        out = out.union(counts.where((F.col("kind") != "data_party") & (F.col("authorities") < F.col("least"))).select(F.lit("too_few_authorities"), "kind"))
        out = out.union(roles.where(F.col("endpoint").startswith("local://")).select(F.lit("local_endpoint"), "id"))
    return out


def sparql_bindings(text: str) -> list[tuple[str, str]]:
    """Distinct (mid, answer) pairs of a SPARQL JSON result, in order."""
    seen: dict[tuple[str, str], None] = {}
    for b in json.loads(text)["results"]["bindings"]:
        if "mid" in b and "answer" in b:
            seen[b["mid"]["value"], b["answer"]["value"]] = None
    return list(seen)


def canonical_digest(rows: DataFrame) -> DataFrame:
    """One SHA-256 over all rows as canonical JSON, whatever their order: the sum of the rows' digests, in four parts."""
    cols = sorted(rows.columns)
    h = rows.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = h.agg(*(F.sum(p).alias(f"p{i}") for i, p in enumerate(parts)), F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws(",", "n", *(F.col(f"p{i}").cast("string") for i in range(4))), 256).alias("digest"))


def replicate(rows: DataFrame, root: str, replicas: list[str]) -> dict[str, str]:
    """Writes the rows once for each replica, reads each back, and fails unless all digests are that of the rows. Returns the paths."""
    if len(set(replicas)) < len(replicas) or not replicas:
        raise ValueError("replicas need different names")
    want, paths = canonical_digest(rows).collect()[0]["digest"], {}
    for name in replicas:
        paths[name] = f"{root.rstrip('/')}/{name}"
        rows.write.parquet(paths[name])
    bad = [n for n, p in paths.items() if canonical_digest(rows.sparkSession.read.schema(rows.schema).parquet(p)).collect()[0]["digest"] != want]
    if bad:
        raise ValueError(f"replicas differ: {bad}")
    return paths


def write_private(rows: DataFrame, path: str) -> None:
    """JSON lines that only their owner may read (0600, folder 0700). They are written beside the target and moved when whole; an existing target fails."""
    hadoop = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} exists")
    beside = hadoop.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    mode = lambda bits: hadoop.permission.FsPermission(bits)
    try:
        fs.mkdirs(beside, mode("700"))
        inner = hadoop.Path(beside, "rows")
        rows.write.json(inner.toString())
        for f in fs.listStatus(inner):
            fs.setPermission(f.getPath(), mode("600"))
        fs.setPermission(inner, mode("700"))
        if not fs.rename(inner, target):
            raise OSError(f"could not move to {path}")
    finally:
        fs.delete(beside, True)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the sink does not hold yet; returns how many."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    rows = rows.dropDuplicates([key])
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def ring(spark: SparkSession, entities: int, edges: int, owners: int) -> DataFrame:
    """Edge i leads from entity i to the next on a ring, under relation i div entities."""
    i = F.col("id")
    e = lambda x: F.concat(F.lit("e"), (x % entities + 1).cast("string"))
    return spark.range(edges).select((i + 1).alias("evidence"), e(i).alias("source"), F.concat(F.lit("r"), (F.floor(i / entities) + 1).cast("string")).alias("relation"), e(i + 1).alias("target"), F.lit(2).alias("score"), F.concat(F.lit("o"), (i % owners).cast("string")).alias("owner"))


def skewed(spark: SparkSession, entities: int, hubs: int, degree: int, owners: int) -> DataFrame:
    """Hub sources with ``degree`` edges each, all others with one."""
    n = hubs * degree
    i = F.col("id")
    hub = F.when(i < n, F.floor(i / degree)).otherwise(i - n + hubs)
    return spark.range(n + max(0, entities - hubs)).select(F.concat(F.lit("e"), hub.cast("string")).alias("source"), F.lit("r1").alias("relation"), F.concat(F.lit("e"), F.pmod(F.xxhash64("id"), F.lit(entities)).cast("string")).alias("target"), (i + 1).alias("evidence"), (1 + i % 9).cast("int").alias("score"), F.concat(F.lit("o"), (i % owners).cast("string")).alias("owner"))


def log_metrics(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Seconds, megabytes and rounds of each run log (column ``value``; ``by``: what tells logs apart)."""
    pick = lambda p: F.max(F.regexp_extract("value", p, 1).try_cast("double"))
    return lines.groupBy(*(by or [])).agg(pick(r"Time = ([0-9.]+) seconds").alias("seconds"), pick(r"Data sent = ([0-9.]+) MB").alias("megabytes"), pick(r"in ~?([0-9]+) rounds").alias("rounds"))


def combined_shares(shares: DataFrame, parties: int, modulus: int = (1 << 61) - 1) -> DataFrame:
    """(query_id, rank, field, party, value) summed modulo a prime; a group without every party fails."""
    m = F.lit(str(modulus)).cast("decimal(20,0)")
    g = shares.groupBy("query_id", "rank", "field").agg(F.countDistinct("party").alias("n"), F.count("*").alias("rows"), (F.sum(F.col("value").cast("decimal(25,0)")) % m).cast("long").alias("value"))
    whole = (F.col("n") == parties) & (F.col("rows") == parties)
    return g.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a share is missing or repeated")).isNull())).drop("n", "rows")
