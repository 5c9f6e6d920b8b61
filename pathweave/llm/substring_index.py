"""Substring dedup over a log-structured fingerprint index.

Documents arrive in batches by rising doc_id. The index keeps immutable runs, each sorted by fingerprint: one row for each
distinct run of windows (see ``windows``) with the smallest document that holds it. A batch is fingerprinted, merge-joined
with the runs, verified window by window where contents differ under one anchor, appended as a new run; full levels are
compacted into one run of the next level. A window of 50 words is removed where its word sequence also starts in a document
with a smaller id.

Nothing is decided by the anchor alone: whole runs count as repeated by a second hash of their content, and where
one anchor has several contents, every window in it is compared by its own second hash.

Edge cases: null and empty texts have no words; texts under 50 words keep all; rows with a null id neither lose words nor
take any from others; rows that share an id do not remove each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, id_and_text, materialise, read_table, record
from .windows import anchor_runs, cover, expand, runs_of, symbols, text_tag, window_hashes

WINDOW, GRAM = 50, 16


class FingerprintIndex:
    """Sorted immutable runs in a shared folder: anchor, content, doc_id (the smallest), occurrences. A manifest names the runs of each
    level, so that a later session opens the index and goes on with new documents."""

    schema = "anchor long, content long, doc_id long, occurrences long"

    def __init__(self, spark: SparkSession, fanout: int = 2, root: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.root = root.rstrip("/") if root else f"{checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.levels: dict[int, list[str]] = {}
        self._next = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, fanout: int = 2) -> FingerprintIndex:
        """The index that ``root`` holds, or an empty one."""
        out = cls(spark, fanout, root)
        fs, path = out._file()
        if fs.exists(path):
            held = json.loads(spark.read.text(path.toString(), wholetext=True).collect()[0][0])
            out.levels, out._next = {int(k): v for k, v in held["levels"].items()}, held["next"]
        return out

    def _file(self, name: str = "manifest.json"):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _save(self) -> None:
        """Written beside the old manifest and moved over it: a run counts once it is named there."""
        fs, new = self._file(f"manifest-{uuid.uuid4().hex}")
        stream = fs.create(new)
        stream.write(bytearray(json.dumps({"levels": self.levels, "next": self._next}).encode()))
        stream.close()
        _, path = self._file()
        fs.delete(path, False)
        fs.rename(new, path)

    def runs(self) -> list[DataFrame]:
        return [self._read(p) for level in self.levels.values() for p in level]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}")

    def _write(self, rows: DataFrame, level: int) -> str:
        name, self._next = f"{level}-{self._next}-{uuid.uuid4().hex[:8]}", self._next + 1
        rows.sortWithinPartitions("anchor", "content").write.parquet(f"{self.root}/{name}")
        self.levels.setdefault(level, []).append(name)
        return name

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("anchor", "content").agg(F.min("doc_id").alias("doc_id"), F.sum("occurrences").alias("occurrences"))

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds a batch's distinct fingerprints as a run. Returns the run as written; ``compact`` follows once nothing reads it."""
        name = self._write(rows, 0)
        self._save()
        return self._read(name)

    def compact(self) -> None:
        """Merges levels that are full into one run of the next level, and then drops their runs."""
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            names = self.levels.pop(level)
            self._write(self.merged([self._read(n) for n in names]), level + 1)
            self._save()
            for n in names:
                fs, path = self._file(n)
                fs.delete(path, True)
            level += 1


def classes_of(index: FingerprintIndex, fresh: DataFrame) -> DataFrame:
    """anchor, content, first (smallest document), contents (how many under the anchor) for the batch's anchors, from all runs.
    Anchors that occur once in all are left out."""
    runs = index.runs()
    rows = index.merged(runs) if len(runs) > 1 else runs[0]
    known = rows.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum("occurrences").alias("total")).where("total > 1")
    if len(runs) > 1:
        rows = rows.join(fresh.select("anchor").distinct(), "anchor", "left_semi")
    return rows.join(known, "anchor").select("anchor", "content", F.col("doc_id").alias("first"), "contents")


def window_rows(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """anchor, hash, doc_id of all windows under the anchors listed for each document."""
    schema = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64())])
    wanted = owners.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def find(batches):
        for batch in batches:
            for doc, text, anchors in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "anchors")), strict=True):
                values = symbols(text.encode(), "words")
                a, lo, n = anchor_runs(values, GRAM, WINDOW)
                use = np.isin(a.view(np.int64), np.array(anchors, np.int64))
                at = expand(lo[use], n[use])
                if len(at):
                    h = window_hashes(values, WINDOW)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a[use].view(np.int64), n[use])), pa.array(h), pa.array(np.full(len(h), doc))], schema=schema)

    return id_and_text(docs).join(wanted, "doc_id").mapInArrow(find, "anchor long, hash long, doc_id long")


def repeats(docs: DataFrame, batches: int = 3) -> tuple[DataFrame, DataFrame]:
    """What earlier documents hold of each document: runs (doc_id, tag, lo, n, mixed) and, for mixed ones, the hashes of the
    windows that the document itself holds first (doc_id, hash)."""
    spark = docs.sparkSession
    docs = id_and_text(docs).where(F.col("doc_id").isNotNull())
    found = materialise(runs_of(docs, "words", GRAM, WINDOW), "substring-runs")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).collect()[0]["q"] or []
    bounds = [None, *sorted(set(cuts)), None]
    index = FingerprintIndex(spark)
    ranges, firsts = [], []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("doc_id") > low)
        if high is not None:
            inside = inside & (F.col("doc_id") <= high)
        batch = found.where(inside)
        fresh = index.append(batch.groupBy("anchor", "content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("occurrences")))
        classes = materialise(classes_of(index, fresh), "substring-classes")
        hit = batch.join(classes, ["anchor", "content"]).where((F.col("first") < F.col("doc_id")) | (F.col("contents") > 1))
        ranges.append(materialise(hit.select("doc_id", "tag", "lo", "n", (F.col("first") >= F.col("doc_id")).alias("mixed")), "substring-ranges"))
        mixed = classes.where("contents > 1").select(F.col("first").alias("doc_id"), "anchor").distinct()
        hashed = window_rows(docs, mixed).groupBy("anchor", "hash").agg(F.min("doc_id").alias("doc_id"))
        firsts.append(materialise(hashed.where(inside).select("doc_id", "hash"), "substring-firsts"))
        index.compact()
    both = []
    for parts in (ranges, firsts):
        rows = parts[0]
        for r in parts[1:]:
            rows = rows.unionByName(r)
        both.append(rows)
    return both[0], both[1]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def remove_repeats(docs: DataFrame, batches: int = 3, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space."""
    ranges, firsts = repeats(docs, batches)
    marks = ranges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "n", "mixed")).alias("runs"))
    own = firsts.groupBy("doc_id").agg(F.collect_list("hash").alias("own"))
    marks = marks.join(own, "doc_id", "left").groupBy("doc_id").agg(F.collect_list(F.struct("tag", "runs", "own")).alias("marks"))

    def apply(batches):
        for batch in batches:
            out = {f.name: [] for f in _OUT}
            for doc, text, marked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
                raw = text.encode()
                words = raw.split()
                removed = np.zeros(len(words), bool)
                tag = text_tag(raw) if marked else 0
                for m in marked or []:
                    if m["tag"] == tag:
                        lo, n, mixed = (np.array([r[c] for r in m["runs"]]) for c in ("lo", "n", "mixed"))
                        at = expand(lo[~mixed], n[~mixed])
                        unsure = expand(lo[mixed], n[mixed])
                        if len(unsure):
                            h = window_hashes(symbols(raw, "words"), WINDOW)[unsure].view(np.int64)
                            at = np.concatenate([at, unsure[~np.isin(h, np.array(m["own"] or [], np.int64))]])
                        removed |= cover(at, WINDOW, len(words))
                kept = b" ".join([w for w, r in zip(words, removed.tolist(), strict=True) if not r]) if removed.any() else b" ".join(words)
                for name, v in (("doc_id", doc), ("n_words", len(words)), ("n_removed", int(removed.sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept.decode() if keep_text else None)):
                    out[name].append(v)
            yield record(out, _OUT)

    return id_and_text(docs).join(marks, "doc_id", "left").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_substring_index(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages removed from ``documents``."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


