"""Suffix-array dedup of byte strings of 100 bytes, by a distributed merge sort that knows common prefixes.

Only suffixes that can matter are sorted: those at anchors (see ``windows``) that occur more than once, which an exact count
and a semi-join find. A suffix stands for all 100-byte windows of its run; its sort key is the anchor's hash followed by
the text from the anchor on, so ranges of keys are of equal size without sampling and equal windows meet in one range.
Each task sorts its suffixes into runs, cuts them by range, front-codes them (length of the prefix shared with the suffix
before, and the rest) and exchanges them. Each range is merged by a loser tree whose nodes keep how far a suffix
agrees with the last winner: the longer agreement wins unseen, and only at a tie are bytes compared, from there on. In the
merged order the windows of one anchor are neighbours; those whose string stands earlier are marked on the exact bytes.

An anchor with over ``HOT`` suffixes is no matter for one range: its windows are grouped by a 128-bit digest instead, with
partial aggregation. Edge cases: null and empty texts and texts under 100 bytes keep all; rows with a null id neither lose
bytes nor take any from others; rows that share an id are one document in order of start, and a row repeated exactly does
not remove itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, gram_hashes, id_and_text, materialise, pieces, read_table, record, release
from .windows import anchor_runs, cover, expand, maximal, periodic_runs, text_tag

WINDOW, GRAM = 100, 24
HOT = 60_000
#: Suffixes that a task holds before it sorts and sends them, and that a range is sized for.
RUN_ITEMS, RANGE_ITEMS = 150_000, 20_000

_ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])


def anchors(docs: DataFrame) -> DataFrame:
    def find(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in pieces([len(t) for t in texts], 1 << 21):
                cols: list[list[np.ndarray]] = [[] for _ in _ANCHORS]
                for doc, text in zip(ids[part], texts[part], strict=True):
                    raw = text.encode()
                    a, lo, n = anchor_runs(byte_values(raw), GRAM, WINDOW)
                    for col, v in zip(cols, (a.view(np.int64), np.full(len(a), doc), np.full(len(a), text_tag(raw), np.int32), lo.astype(np.int32), n.astype(np.int32)), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(cols, _ANCHORS, strict=True)], schema=_ANCHORS)

    return id_and_text(docs).where(F.col("doc_id").isNotNull()).mapInArrow(find, "anchor long, doc_id long, tag int, lo int, n int")


def anchor_counts(docs: DataFrame) -> DataFrame:
    """anchor, total of all anchors, summed within each piece of a task first."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int32())])

    def find(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in pieces([len(t) for t in texts], 1 << 22):
                values = [byte_values(t.encode()) for t in texts[part]]
                a, counts = np.unique(np.concatenate([anchor_runs(v, GRAM, WINDOW)[0] for v in values]), return_counts=True)
                # runs that hold their anchor twice may repeat themselves
                counts[np.isin(a, np.concatenate([periodic_runs(v, GRAM, WINDOW) for v in values]))] += 1
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(counts.astype(np.int32))], schema=schema)

    return id_and_text(docs).where(F.col("doc_id").isNotNull()).select("text").mapInArrow(find, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("total"))


def common_prefix(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, known to be h at least."""
    n = min(len(a), len(b))
    if a[h:n] == b[h:n]:
        return n
    low, high = h, n
    while high - low > 1:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted streams of (key, rest), each given with the prefix lengths between neighbours.

    A node keeps the loser of its match and how far that key agrees with the key that beat it; on the way up from a stream
    that has moved on, every key met was beaten by the last winner, so all agreements refer to one and the same string.
    """

    def __init__(self, keys: list[list[bytes]], shared: list[list[int]]) -> None:
        self.keys, self.shared = keys, shared
        self.at = [0] * len(keys)
        self.size = 1
        while self.size < max(1, len(keys)):
            self.size *= 2
        self.losers = [(-1, 0)] * self.size
        self.winner, self.agreed = self._build(1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            s = node - self.size
            return (s if s < len(self.keys) and self.keys[s] else -1), 0
        left, right = self._build(2 * node), self._build(2 * node + 1)
        return self._match(node, *left, *right)

    def _match(self, node: int, a: int, ha: int, b: int, hb: int) -> tuple[int, int]:
        """Keeps the loser at the node and returns the winner with its agreement."""
        if b < 0 or (a >= 0 and ha > hb):
            self.losers[node] = (b, hb)
            return a, ha
        if a < 0 or hb > ha:
            self.losers[node] = (a, ha)
            return b, hb
        x, y = self.keys[a][self.at[a]], self.keys[b][self.at[b]]
        h = common_prefix(x, y, ha)
        if x[h : h + 1] <= y[h : h + 1]:
            self.losers[node] = (b, h)
            return a, ha
        self.losers[node] = (a, h)
        return b, ha

    def __iter__(self):
        """(stream, index in it, prefix shared with the key before) in sorted order."""
        while self.winner >= 0:
            s = self.winner
            i = self.at[s]
            yield s, i, self.agreed
            self.at[s] = i + 1
            if i + 1 < len(self.keys[s]):
                cand, h = s, self.shared[s][i + 1]
            else:
                cand, h = -1, 0
            node = (s + self.size) >> 1
            while node:
                other, ho = self.losers[node]
                if other >= 0:
                    if cand < 0 or ho > h:
                        self.losers[node] = (cand, h)
                        cand, h = other, ho
                    elif ho == h:
                        cand, h = self._match(node, cand, h, other, ho)
                node >>= 1
            self.winner, self.agreed = cand, h


_BLOB = pa.schema([("range", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("shared", "rest_size", "rest", "left_size", "left", "docs", "tags", "los", "ns"))])
_BLOB_DDL = "range int, digest binary, doc_id long, tag int, lo int, n int, shared binary, rest_size binary, rest binary, left_size binary, left binary, docs binary, tags binary, los binary, ns binary"


def coded_runs(items: list[tuple], ranges: int) -> list[dict]:
    """Sorts (key, left, doc, tag, lo, n), cuts by range of the key and front-codes each cut."""
    items.sort(key=lambda x: (x[0], x[2], x[4]))
    out, i = [], 0
    while i < len(items):
        r = int.from_bytes(items[i][0][:8], "big") * ranges >> 64
        j = i
        shared, rest, previous = [], [], b""
        while j < len(items):
            key = items[j][0]
            if int.from_bytes(key[:8], "big") * ranges >> 64 != r:
                break
            h = common_prefix(previous, key, 0)
            shared.append(h)
            rest.append(key[h:])
            previous = key
            j += 1
        cut = items[i:j]
        out.append({"range": r, "shared": np.array(shared, "<u4").tobytes(), "rest_size": np.array([len(x) for x in rest], "<u4").tobytes(), "rest": b"".join(rest), "left_size": np.array([len(x[1]) for x in cut], "<u4").tobytes(), "left": b"".join([x[1] for x in cut]), "docs": np.array([x[2] for x in cut], "<i8").tobytes(), "tags": np.array([x[3] for x in cut], "<i4").tobytes(), "los": np.array([x[4] for x in cut], "<i4").tobytes(), "ns": np.array([x[5] for x in cut], "<i4").tobytes()})
        i = j
    return out


def _known(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_BLOB)


def suffix_runs(docs: DataFrame, wanted: DataFrame, ranges: int) -> DataFrame:
    """Front-coded runs by range; rows with a range of -1 are windows of hot anchors, with -2 runs that an equal run in the same
    task precedes."""
    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "lo", "n", "hot")).alias("runs")).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "runs")).alias("by_tag"))

    def sort(batches):
        items: list[tuple] = []

        def flush():
            rows, first = [], {}
            keep = []
            for x in sorted(items, key=lambda x: (x[2], x[4])):
                was = first.setdefault((x[0], x[1]), (x[2], x[4]))
                if was == (x[2], x[4]):
                    keep.append(x)
                else:
                    rows.append({"range": -2, "doc_id": x[2], "tag": x[3], "lo": x[4], "n": x[5]})
            rows += coded_runs(keep, ranges)
            items.clear()
            for i in range(0, len(rows), 5000):
                yield _known(rows[i : i + 5000])

        for batch in batches:
            for doc, text, by_tag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "by_tag")), strict=True):
                raw = text.encode()
                tag = text_tag(raw)
                runs = next((b["runs"] for b in by_tag if b["tag"] == tag), [])
                if not runs:
                    continue
                grams = gram_hashes(byte_values(raw), GRAM).view(np.int64)
                direct = []
                for r in runs:
                    lo, n = r["lo"], r["n"]
                    if r["hot"]:
                        direct += [{"range": -1, "digest": hashlib.blake2b(raw[p : p + WINDOW], digest_size=16).digest(), "doc_id": doc, "tag": tag, "lo": p, "n": 1} for p in range(lo, lo + n)]
                        continue
                    m = lo + int(np.argmax(grams[lo : lo + n - 1 + WINDOW - GRAM + 1] == r["anchor"]))
                    items.append(((r["anchor"] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + raw[m : lo + n - 1 + WINDOW], raw[lo:m], doc, tag, lo, n))
                if direct:
                    yield _known(direct)
                if len(items) >= RUN_ITEMS:
                    yield from flush()
        if items:
            yield from flush()

    return id_and_text(docs).join(lists, "doc_id").mapInArrow(sort, _BLOB_DDL)


def _decoded(row: dict) -> tuple[list[bytes], list[int], list[tuple]]:
    shared = np.frombuffer(row["shared"], "<u4").tolist()
    keys, at, previous, rest = [], 0, b"", row["rest"]
    for h, size in zip(shared, np.frombuffer(row["rest_size"], "<u4").tolist(), strict=True):
        previous = previous[:h] + rest[at : at + size]
        keys.append(previous)
        at += size
    lefts, at = [], 0
    for size in np.frombuffer(row["left_size"], "<u4").tolist():
        lefts.append(row["left"][at : at + size])
        at += size
    own = zip(lefts, *(np.frombuffer(row[c], t).tolist() for c, t in (("docs", "<i8"), ("tags", "<i4"), ("los", "<i4"), ("ns", "<i4"))), strict=True)
    return keys, shared, list(own)


def repeated_in_class(members: list[tuple]) -> list[tuple]:
    """(doc, tag, lo, n) of windows whose string stands earlier. Members: (key, left, doc, tag, lo, n) under one anchor."""
    members.sort(key=lambda x: (x[2], x[4]))
    out, first, distinct = [], {}, []
    for x in members:
        was = first.setdefault((x[0], x[1]), (x[2], x[4]))
        if was == (x[2], x[4]):
            distinct.append(x)
        else:
            out.append(x[2:])
    periodic = any(x[0].find(x[0][8 : 8 + GRAM], 9) >= 0 for x in distinct)
    if len(first) == 1 and not periodic:
        return out
    seen: dict[bytes, tuple] = {}
    for key, left, doc, tag, lo, n in distinct:
        whole = left + key[8:]
        begin = -1
        for p in range(n):
            at = (doc, lo + p)
            if seen.setdefault(whole[p : p + WINDOW], at) != at:
                if begin < 0:
                    begin = p
            elif begin >= 0:
                out.append((doc, tag, lo + begin, p - begin))
                begin = -1
        if begin >= 0:
            out.append((doc, tag, lo + begin, n - begin))
    return out


_DUP = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])


def merge_range(table: pa.Table) -> pa.Table:
    """All runs of one range, merged; the repeated windows in it."""
    streams = [_decoded(r) for r in table.to_pylist()]
    out: list[tuple] = []
    members: list[tuple] = []
    for s, i, agreed in LoserTree([k for k, _, _ in streams], [h for _, h, _ in streams]):
        if agreed < 8 and members:
            out += repeated_in_class(members)
            members = []
        members.append((streams[s][0][i], *streams[s][2][i]))
    if members:
        out += repeated_in_class(members)
    cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _DUP, strict=True)], schema=_DUP)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, tag, lo, n: windows lo .. lo + n - 1 of the document start earlier elsewhere."""
    repeated = materialise(anchor_counts(docs).where("total > 1"), "suffix-anchors")
    wanted = materialise(anchors(docs).join(repeated.select("anchor", (F.col("total") > HOT).alias("hot")), "anchor"), "suffix-wanted")
    ranges = max(256, wanted.count() // RANGE_ITEMS)
    release(repeated)
    sent = materialise(suffix_runs(docs, wanted, ranges), "suffix-runs")
    release(wanted)
    merged = sent.where("range >= 0").select("range", *[f.name for f in _BLOB][6:]).groupBy("range").applyInArrow(merge_range, "doc_id long, tag int, lo int, n int")
    hot = sent.where("range = -1").select("digest", "doc_id", "tag", "lo", "n")
    first = hot.groupBy("digest").agg(F.min(F.struct("doc_id", "lo")).alias("first"))
    later = hot.join(first, "digest").where(F.struct("doc_id", "lo") > F.col("first")).select("doc_id", "tag", "lo", "n")
    found = materialise(merged.unionByName(later).unionByName(sent.where("range = -2").select("doc_id", "tag", "lo", "n")), "suffix-repeats")
    release(sent)
    return found


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that stay."""
    marks = repeated_windows(docs).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("runs")).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "runs")).alias("by_tag"))

    def apply(batches):
        for batch in batches:
            out = {f.name: [] for f in _OUT}
            for doc, text, by_tag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "by_tag")), strict=True):
                raw = text.encode()
                tag = text_tag(raw) if by_tag else 0
                runs = next((b["runs"] for b in by_tag or [] if b["tag"] == tag), None)
                kept, removed, spans = raw, 0, 0
                if runs:
                    mask = cover(expand(np.array([r["lo"] for r in runs]), np.array([r["n"] for r in runs])), WINDOW, len(raw))
                    removed, spans = int(mask.sum()), len(maximal(mask)[0])
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                for name, v in (("doc_id", doc), ("n_bytes", len(raw)), ("n_removed", removed), ("n_spans", spans), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if keep_bytes else None)):
                    out[name].append(v)
            yield record(out, _OUT)

    return id_and_text(docs).join(marks, "doc_id", "left").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from ``documents``."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
