"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Equal shingle sets become one node. Shingles have one global order: by hash, but those that many documents hold come last,
so that prefixes avoid them (an order decides cost, never results). Nodes with the same prefix and size form a group. Groups
that share a prefix shingle and have compatible sizes are candidate pairs; they expand to members, a parity bitmap bounds
the symmetric difference from below, and the exact sets verify what is left.

Work on crowded shingles is saved by components, not by dropping: in a first round the members of a group, and the
groups under a crowded shingle, meet only one representative; in a second round every candidate pair that lies in different
components so far is tested, in blocks of bounded size: bitmaps say which nodes of two blocks have a partner at all, those
nodes come with their exact sets, and a block returns no more links than join its components. So pairs never become rows
there. Crowds with the same largest component, as the many shingles of one cluster of copies have, are tested together, each node once
with the list of its crowds; and a largest component is not held against itself. Two documents in one component need no further
test, so no link is lost. Joins of tables that grow with the corpus are merge joins at every size, so that plans do not change with it.

Edge cases: null and empty texts have no shingles and link with nothing; a text of fewer words than a shingle is one shingle;
a row with a null id has a null component and links with nothing; rows that share an id count with their own texts; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, U, gram_hashes, id_and_text, materialise, pieces, read_table, record, release, word_hashes

#: A shingle counts as common from so many repeats on, and the most common so many are known to the tasks (16 bytes each).
COMMON_FROM, COMMON_KEPT = 48, 200_000
#: Groups under one shingle that meet pair by pair in the first round.
CROWD = 24
#: Nodes in a block of a crowd, and shingles of them.
BLOCK, BLOCK_SHINGLES = 1500, 2_000_000


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    h = word_hashes(text.lower())
    return np.unique(gram_hashes(h, min(words, len(h)))) if len(h) else np.zeros(0, U)


def prefix_length(n: int, percent: int) -> int:
    """How many of n ordered shingles must meet: sets with overlap of at least ceil(percent * n / 100) share one of them."""
    return n - -(-percent * n // 100) + 1


def parity_bits(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles fall in slot i of some 2n slots (a power of two)."""
    size = 1 << max(6, int(2 * len(s) - 1).bit_length())
    slots = (s >> U(64 - size.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=size) & 1).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Packed parity bits at half their number of slots. Slots are leading bits of the hash, so neighbours meet."""
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(bits).reshape(-1, 2), axis=1))


def difference_bound(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of two sets, from their parity bits; the longer is folded."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)
    return int((x != y).sum())


def may_link(n: int, m: int, difference: int, percent: int) -> bool:
    """100 * common >= percent * union, with common = (n + m - difference) / 2."""
    return 100 * (n + m - difference) >= percent * (n + m + difference)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur within pieces of the input, with the sum of those counts; a bounded list of the most frequent."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int32())])

    def count(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in pieces([len(t) for t in texts], 1 << 22):
                token, n = np.unique(np.concatenate([shingle_set(t.encode(), words) for t in texts[part]]), return_counts=True)
                again = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(token[again].view(np.int64)), pa.array(n[again].astype(np.int32))], schema=schema)

    counted = id_and_text(docs).select("text").mapInArrow(count, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    got = counted.orderBy(F.desc("n"), "token").limit(COMMON_KEPT).toArrow()
    token, n = (got[c].to_numpy() for c in ("token", "n"))
    token = token.view(U)
    order = np.argsort(token)
    return token[order], n[order]


_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("prefix", pa.binary()), ("bits", pa.binary())])


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, prefix (hashes in order), parity bits."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def sign(batches):
        token, count = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in pieces([len(t) for t in texts], 1 << 21):
                out = {f.name: [] for f in _SET}
                for doc, text in zip(ids[part], texts[part], strict=True):
                    s = shingle_set(text.encode(), words)
                    ordered = s
                    if len(s) and len(token):
                        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        weight = np.where(token[at] == s, count[at], 0)
                        ordered = s[np.lexsort((s, weight))]
                    for name, v in (("doc_id", doc), ("n", len(s)), ("digest", hashlib.blake2b(s.tobytes(), digest_size=16).digest()), ("prefix", ordered[: prefix_length(len(s), percent)].tobytes() if len(s) else b""), ("bits", parity_bits(s) if len(s) else b"")):
                        out[name].append(v)
                yield record(out, _SET)

    return id_and_text(docs).mapInArrow(sign, "doc_id long, n int, digest binary, prefix binary, bits binary")


_TOKENS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "groups", "sizes"))])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def dealt(groups: DataFrame, buckets: int) -> DataFrame:
    """The prefix shingles of groups (gid, n, prefix) by bucket of the shingle, packed."""

    def deal(batches):
        held: list[tuple] = []

        def flush():
            token, gid, size = (np.concatenate([h[i] for h in held]) for i in range(3))
            bucket = (token >> U(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
            held.clear()
            yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[p[0]]), "tokens": token[p].tobytes(), "groups": gid[p].tobytes(), "sizes": size[p].tobytes()} for p in parts], schema=_TOKENS)

        rows = 0
        for batch in batches:
            for gid, n, prefix in zip(*(batch.column(c).to_pylist() for c in ("gid", "n", "prefix")), strict=True):
                t = np.frombuffer(prefix, U)
                held.append((t, np.full(len(t), gid), np.full(len(t), n, np.int32)))
                rows += len(t)
            if rows > 1_000_000:
                yield from flush()
                rows = 0
        if held:
            yield from flush()

    return groups.select("gid", "n", "prefix").mapInArrow(deal, "bucket int, tokens binary, groups binary, sizes binary")


def _sorted_tokens(table: pa.Table) -> tuple[np.ndarray, ...]:
    """token, group, size in order of token and size; where each token starts and how many groups hold it."""
    token, gid, size = (np.concatenate([np.frombuffer(b, t) for b in table[c].to_pylist()]) for c, t in (("tokens", U), ("groups", np.int64), ("sizes", np.int32)))
    order = np.lexsort((gid, size, token))
    token, gid, size = token[order], gid[order], size[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return token, gid, size.astype(np.int64), start, np.diff(np.append(start, len(token)))


def meetings(tokens: DataFrame, percent: int) -> DataFrame:
    """(crowd, a, b): without a crowd, pairs a < b of groups that share a prefix shingle and have compatible sizes, where under a
    crowded shingle each meets the smallest only; with one, the groups a under a crowded shingle."""
    schema = pa.schema([(c, pa.int64()) for c in ("crowd", "a", "b")])

    def meet(table: pa.Table) -> pa.Table:
        token, gid, size, start, length = _sorted_tokens(table)
        where, first, held_by = np.arange(len(token)), np.repeat(start, length), np.repeat(length, length)
        left, right = [], []
        for step in range(1, CROWD):
            # the pairs at one distance in all uncrowded shingles at once
            i = where[(where - first >= step) & (held_by <= CROWD)]
            if not len(i):
                break
            left.append(i - step)
            right.append(i)
        for c in np.flatnonzero(length > CROWD).tolist():
            b, e = int(start[c]), int(start[c] + length[c])
            lowest, i = b + np.searchsorted(size[b:e], -(-size[b:e] * percent // 100)), np.arange(b, e)
            left.append(lowest[lowest < i])
            right.append(i[lowest < i])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        fits = (gid[i] != gid[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        pairs = np.unique(np.stack([np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j])], axis=1)[fits], axis=0)
        on = held_by > CROWD
        none = pa.nulls(len(pairs), pa.int64())
        return pa.concat_tables([pa.Table.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema), pa.Table.from_arrays([pa.array(token[on].view(np.int64)), pa.array(gid[on]), pa.nulls(int(on.sum()), pa.int64())], schema=schema)])

    return tokens.groupBy("bucket").applyInArrow(meet, "crowd long, a long, b long")


class Block:
    """Nodes of two blocks that meet, in order of size: which may link, by size, component, crowds and bitmaps."""

    def __init__(self, table: pa.Table, bits: list[bytes], percent: int) -> None:
        column = lambda c: table[c].to_numpy()
        self.order = np.lexsort((column("node"), column("n")))
        self.node, self.component, self.n, self.own, self.core = (column(c)[self.order] for c in ("node", "component", "n", "own", "core"))
        self.n, self.percent = self.n.astype(np.int64), percent
        self.one = table["low"][0].as_py() == table["high"][0].as_py()
        lists = table["crowds"].to_pylist()
        #: Hashes of the crowds of each node, one at least; two that are equal by chance cost a test.
        self.crowds = [np.array(lists[i], np.int32) for i in self.order]
        raw = [np.frombuffer(bits[i], np.uint8) for i in self.order]
        self.size = np.array([len(r) for r in raw])
        # each node's bitmap at its own size and folded once: sizes that may link differ by one doubling at most
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for z in np.unique(self.size).tolist():
            same, twice = np.flatnonzero(self.size == z), np.flatnonzero(self.size == 2 * z)
            place = np.full(len(raw), -1)
            place[np.concatenate([same, twice])] = np.arange(len(same) + len(twice))
            self.at[z] = (place, np.stack([raw[i] for i in same] + [folded(raw[i]) for i in twice]))

    def in_one_crowd(self, i: int, j: np.ndarray) -> np.ndarray:
        lists = [self.crowds[k] for k in j.tolist()]
        start = np.cumsum([0, *(len(x) for x in lists[:-1])])
        return j[np.logical_or.reduceat(np.isin(np.concatenate(lists), self.crowds[i]), start)]

    def pairs(self):
        """i and the later nodes that may link with it."""
        n, far = self.n, np.searchsorted(self.n, self.n * 100 // self.percent, side="right")
        for i in range(len(n)):
            j = np.arange(i + 1, far[i])
            j = j[(self.component[j] != self.component[i]) & ((self.own[j] != self.own[i]) | self.one) & (self.core[j] | self.core[i])]
            small, out = np.minimum(self.size[j], self.size[i]), []
            for z in np.unique(small).tolist():
                k = j[small == z]
                place, matrix = self.at[z]
                apart = np.bitwise_count(matrix[place[k]] ^ matrix[place[i]]).sum(axis=1, dtype=np.int64)
                out.append(k[100 * (n[i] + n[k] - apart) >= self.percent * (n[i] + n[k] + apart)])
            j = np.sort(np.concatenate(out)) if out else j
            j = self.in_one_crowd(i, j) if len(j) else j
            if len(j):
                yield i, j


def crowd_rows(met: DataFrame, pairs: DataFrame, grown: DataFrame, labelled: DataFrame) -> DataFrame:
    """Nodes (crowd, around, core, node, component, n) that meet: those under a crowded shingle, and around each group of several members
    these (core) and the members of the groups that it met."""
    under = met.where("crowd IS NOT NULL").select("crowd", F.lit(False).alias("around"), F.lit(True).alias("core"), F.col("a").alias("gid"))
    both = pairs.union(pairs.select("b", "a")).join(grown.withColumnRenamed("gid", "a"), "a", "left_semi")
    around = both.select(F.col("a").alias("crowd"), F.lit(True).alias("around"), F.lit(False).alias("core"), F.col("b").alias("gid"))
    own = grown.select(F.col("gid").alias("crowd"), F.lit(True).alias("around"), F.lit(True).alias("core"), "gid")
    return under.union(around).union(own).join(labelled.hint("merge"), "gid").select("crowd", "around", "core", "node", "component", "n")


def placed_in_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of crowds of several components, once for each two blocks that meet, and the table that they come from. Crowded shingles with the same largest component
    (``home``) come together, each node once with its crowds. The largest component has blocks of its own, which do not meet each other."""
    sums = rows.groupBy("crowd", "around", "component").agg(F.count("*").alias("c"))
    crowds = sums.groupBy("crowd", "around").agg(F.max(F.struct("c", "component")).alias("x"), F.count("*").alias("components")).where("components > 1")
    crowds = crowds.select("crowd", "around", F.col("x.component").alias("main"), F.when(F.col("around"), F.col("crowd")).otherwise(F.col("x.component")).alias("home"))
    kept = rows.join(crowds.hint("merge"), ["crowd", "around"]).groupBy("home", "around", "main", "node", "component", "n").agg(F.max("core").alias("core"), F.collect_list(F.hash("crowd")).alias("crowds"))
    kept = materialise(kept, "jaccard-crowds")
    is_main = F.col("component") == F.col("main")
    count = lambda when, what: F.sum(F.when(when, what).otherwise(F.lit(0)))
    blocks = lambda when: F.greatest(F.lit(1), F.ceil(count(when, F.lit(1)) / BLOCK), F.ceil(count(when, F.col("n")) / BLOCK_SHINGLES)).cast("int")
    homes = kept.groupBy("home", "around").agg(blocks(is_main).alias("mains"), blocks(~is_main).alias("rests"))
    own = F.when(is_main, F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("rests"))).cast("int")
    first = F.when(is_main, F.col("mains")).otherwise(F.lit(0))
    other = F.explode(F.sequence(first, F.col("mains") + F.col("rests") - 1))
    met = kept.join(homes, ["home", "around"]).withColumn("own", own).withColumn("other", other)
    return met.select("home", "around", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "core", "node", "component", "n", "crowds"), kept


_TWO = ["home", "around", "low", "high"]


def late_links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of every two blocks that meet: at most one less than their components."""
    placed, kept = placed_in_blocks(rows)
    columns = placed.columns
    schema = pa.schema([("home", pa.int64()), ("around", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("own", pa.int32()), ("core", pa.bool_()), ("node", pa.int64()), ("component", pa.int64()), ("n", pa.int32()), ("crowds", pa.list_(pa.int32()))])
    ddl = "home long, around boolean, low int, high int, own int, core boolean, node long, component long, n int, crowds array<int>"

    def sift(table: pa.Table) -> pa.Table:
        block = Block(table, table["bits"].to_pylist(), percent)
        some = np.zeros(len(block.node), bool)
        for i, j in block.pairs():
            some[i] = True
            some[j] = True
        return table.select(columns).take(pa.array(np.sort(block.order[some]))).cast(schema)

    sifted = materialise(placed.join(nodes.select("node", "bits").hint("merge"), "node").select(*columns, "bits").groupBy(*_TWO).applyInArrow(sift, ddl), "jaccard-sifted")
    release(kept)
    sets = shingle_sets(sifted.select("node").distinct(), nodes, docs, words)

    def join_up(table: pa.Table) -> pa.Table:
        members = [np.frombuffer(b, U) for b in table["members"].to_pylist()]
        block = Block(table, [parity_bits(m) for m in members], percent)
        members = [members[i] for i in block.order]
        found = list(block.pairs())
        i, j = np.repeat([x for x, _ in found], [len(y) for _, y in found]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(y for _, y in found)])
        left, right = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.argsort(left, kind="stable")
        right, degree = right[order], np.bincount(left, minlength=len(members))
        first, label, links = np.cumsum(degree) - degree, block.component.copy(), []
        # those with the most partners first: what is near to many joins most components with the fewest tests
        for h in np.argsort(-degree, kind="stable").tolist():
            k = right[first[h] : first[h] + degree[h]]
            k = k[label[k] != label[h]]
            if not len(k):
                continue
            own, theirs = members[h], np.concatenate([members[x] for x in k])
            n = block.n[k]
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[at] == theirs).astype(np.int64), np.cumsum(n) - n)
            for x in k[100 * common >= percent * (len(own) + n - common)].tolist():
                if label[x] != label[h]:
                    links.append((min(block.node[h], block.node[x]), max(block.node[h], block.node[x])))
                    label[label == label[x]] = label[h]
        return pa.Table.from_arrays([pa.array([int(x[s]) for x in links], pa.int64()) for s in (0, 1)], schema=_PAIR)

    late = materialise(sifted.join(sets.hint("merge"), "node").select(*columns, "members").groupBy(*_TWO).applyInArrow(join_up, "a long, b long"), "jaccard-late")
    release(sifted, sets)
    return late


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, members (sorted hashes) of the wanted nodes, from the texts of their documents; other texts are not exchanged."""
    used = materialise(wanted.join(nodes.select("node", "doc_id", "digest").hint("merge"), "node"), "jaccard-used")
    built = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def build(batches):
        for batch in batches:
            out = {"node": [], "members": []}
            for node, text, digest in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "digest")), strict=True):
                s = shingle_set(text.encode(), words)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                    out["node"].append(node)
                    out["members"].append(s.tobytes())
            yield record(out, built)

    texts = IdFilter(used.select("doc_id")).rows(id_and_text(docs), "doc_id")
    sets = materialise(texts.join(used.hint("merge"), "doc_id").select("node", "text", "digest").mapInArrow(build, "node long, members binary").dropDuplicates(["node"]), "jaccard-sets")
    release(used)
    return sets


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) whose sets link: bitmaps first, then exact sets of the texts concerned."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bound(batches):
        for batch in batches:
            rows = [(a, b) for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")), strict=True) if may_link(n, m, difference_bound(x, y), percent)]
            yield record({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}, schema)

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    left = materialise(pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").mapInArrow(bound, "a long, b long"), "jaccard-candidates")
    sets = shingle_sets(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), nodes, docs, words)

    def compare(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    rows.append((a, b))
            yield record({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}, schema)

    links = materialise(left.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")).hint("merge"), "b").mapInArrow(compare, "a long, b long"), "jaccard-links")
    release(left, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes that have links, by alternating large and small stars."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        minimum = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(minimum, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(minimum.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, materialise(small, "components")
        release(last)
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).collect()[0]
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        before = mark


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that a document reaches by links."""
    signed = materialise(signatures(docs, words, percent), "jaccard-signatures")
    distinct = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("digest").agg(F.min(F.struct("doc_id", "n", "prefix", "bits")).alias("x"))
    nodes = materialise(distinct.select(F.monotonically_increasing_id().alias("node"), "digest", "x.*", F.md5("x.prefix").alias("key")), "jaccard-nodes")
    sizes = materialise(signed.select("doc_id", "n", "digest"), "jaccard-sizes")
    release(signed)
    grouped = nodes.groupBy("n", "key").agg(F.min("node").alias("gid"), F.count("*").alias("members"))
    crowded = materialise(grouped.where("members > 1"), "jaccard-groups")
    members = materialise(nodes.select("node", "n", "key").join(crowded.select("n", "key", "gid"), ["n", "key"], "left").select("node", "n", F.coalesce("gid", "node").alias("gid")), "jaccard-members")
    heads = nodes.join(members.where("gid = node").select("node").hint("merge"), "node", "left_semi").select(F.col("node").alias("gid"), "n", "prefix")
    size = heads.agg(F.sum(F.octet_length("prefix")).alias("b")).collect()[0]["b"] or 0
    met = materialise(meetings(dealt(heads, max(64, size // 8 // 250_000)), percent), "jaccard-met")
    # first round: representatives
    pairs = met.where("crowd IS NULL").select("a", "b").distinct()
    inside = members.where("gid <> node").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    links = verified(pairs.union(inside), nodes, docs, words, percent)
    found = materialise(components(links), "jaccard-found")
    # second round: what is still in different components, under crowded shingles, within groups, and between members of groups that met
    labelled = materialise(members.join(found.hint("merge"), "node", "left").select("node", "gid", F.coalesce("component", "node").alias("component"), "n"), "jaccard-labelled")
    late = late_links(crowd_rows(met, pairs, crowded.select("gid"), labelled), nodes, docs, words, percent)
    release(met, members, crowded, labelled, found)
    final = materialise(components(links.union(late)), "jaccard-final")
    release(links, late)
    known = nodes.select("node", "digest", F.col("doc_id").alias("first")).join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = known.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(known.join(ids.hint("merge"), "component").select("digest", "component_id"), "jaccard-named")
    release(nodes, final)
    out = sizes.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).join(named.hint("merge"), "digest", "left").select("doc_id", "n", "component_id")
    alone = sizes.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``: 4-word shingles, Jaccard of at least 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=85)
