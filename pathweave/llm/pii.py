"""Personal data, with information-theoretic sanitisation of what surrounds it.

Base detectors find e-mail addresses, IP addresses, payment cards and phone numbers. Their values are the protected
entities, and so are the parts that several values share: mail domains, /24 networks, the first six digits of cards and the first five of
phone numbers, as few values stand in several texts. Terms of the documents that hold an entity disclose it where corpus co-occurrence says so: with p estimated over all documents,
PMI(term; entity) = log p(t, e) / (p(t) p(e)) reaches ``alpha`` times the entity's own information -log p(e), and both
occur together in at least ``min_support`` distinct texts, so that copies of one text prove nothing. Every occurrence of such a
term in a document that holds the entity becomes a ``term`` span, unless a base span touches it; base spans always stay.
``sanitise`` replaces every span by a placeholder of its kind.

Counts cover the whole corpus: words are counted where a fixed-size Bloom filter says that they may be candidates, and a
join makes that exact. Terms that are too common among the documents with entities to disclose any of them are no candidates, so that the
partial counts of tasks do not grow with the whole vocabulary. Edge cases: a null or empty text has no spans; a null id is kept; repeated rows get equal
results; an empty table gives an empty result; very long texts and runs of digits take linear time; equal spans count once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, U, byte_values, id_and_text, materialise, mix, pieces, prefix_sums, read_table, record, run_hashes, word_bounds

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACES = " \t\n\x0b\x0c\r"
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_INNER = np.array([chr(i) not in _EDGE and chr(i) not in _SPACES for i in range(256)])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def dotted_quads(text: str):
    """Start and end of four numbers joined by dots, from the left, each at most 255. Whole runs of digits and dots are read at once, so
    that long ones take linear time; of more than four numbers in a run every four are a match."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".") if m.end() - m.start() > 6 else ()
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def shared_part(kind: str, value: str) -> str:
    """What several values of a kind have in common: the domain of an address, the network, the beginning of a number."""
    if kind == "email":
        return "@" + value.rsplit("@", 1)[1].lower()
    if kind == "ip":
        return value.rsplit(".", 1)[0] + "."
    return f"{kind}:{_NOT_DIGIT.sub('', value)[: 6 if kind == 'card' else 5]}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start. Each kind is matched from the left without overlaps; a match that
    fails its check is dropped without another try inside it."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in dotted_quads(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in characters) of every term whose word no base span touches."""
    raw = text.encode("utf-8", "surrogatepass")
    char = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    word_start, word_end = word_bounds(raw)
    starts, ends = term_places(raw)
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends
    at = np.searchsorted(word_start, starts, side="right") - 1
    free = np.ones(len(word_start), bool)
    begin, stop = char[word_start], char[word_end]
    for _, a, b in spans:
        free[np.searchsorted(stop, a, side="right") : np.searchsorted(begin, b)] = False
    hashes = quick_hashes(raw)
    keep = free[at]
    return hashes[keep], char[starts[keep]], char[ends[keep]]


_SCAN = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", pa.string()), ("counts", pa.list_(pa.int64())), ("entities", pa.list_(pa.int64())), ("terms", pa.binary()), ("places", pa.binary())])
_SCAN_DDL = "doc_id long, text_key long, base string, counts array<long>, entities array<long>, terms binary, places binary"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every text; where there are any, its distinct entities, and hashes and places of all its terms."""

    def find(batches):
        for batch in batches:
            ids, texts, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text", "text_key"))
            for part in pieces([len(t) for t in texts], 1 << 22):
                out = {f.name: [] for f in _SCAN}
                for doc, text, key in zip(ids[part], texts[part], keys[part], strict=True):
                    spans = base_spans(text)
                    entities = {_hash(_NOT_DIGIT.sub("", text[a:b]) if kind in ("card", "phone") else text[a:b].lower()) for kind, a, b in spans}
                    entities |= {_hash(shared_part(kind, text[a:b])) for kind, a, b in spans}
                    terms, start, end = terms_outside(text, spans) if spans else (np.zeros(0, np.int64),) * 3
                    out["doc_id"].append(doc)
                    out["text_key"].append(key if spans else 0)
                    out["base"].append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                    out["counts"].append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
                    out["entities"].append(sorted(entities))
                    out["terms"].append(terms.tobytes())
                    out["places"].append(np.concatenate([start, end]).astype(np.int32).tobytes())
                yield record(out, _SCAN)

    return id_and_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(find, _SCAN_DDL)


BLOOM_BITS = 23


def _bloom_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.int64).view(U))
    return (h >> U(64 - BLOOM_BITS)).astype(np.int64), (h & U((1 << BLOOM_BITS) - 1)).astype(np.int64)


def term_frequencies(docs: DataFrame, candidates: DataFrame, column: str = "text") -> DataFrame:
    """term, n_term: in how many documents each candidate term occurs as a word; ``column`` holds texts, or hashes of terms as bytes.

    The hash of the term is tested first, against a filter of 2^23 bits whatever the number of candidates.
    """

    def build(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for s in _bloom_slots(batch.column("term").to_numpy(zero_copy_only=False)):
                bits[s] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    # a megabyte from each of at most 8 tasks
    parts = candidates.select("term").repartition(8).mapInArrow(build, "bits binary").toArrow()["bits"].to_pylist()
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for p in parts:
        bits |= np.frombuffer(p, np.uint8)
    if not bits.any():
        return candidates.select("term").limit(0).withColumn("n_term", F.lit(0).cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches):
        table = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        total: Counter[int] = Counter()

        def sums():
            keys = np.fromiter(total.keys(), np.int64, len(total))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(total.values(), np.int64, len(total)))], schema=schema)
            total.clear()

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for part in pieces([len(t) for t in rows], 1 << 20):
                h = np.concatenate([np.unique(quick_hashes(t.encode()) if isinstance(t, str) else np.frombuffer(t, np.int64)) for t in rows[part]])
                a, b = _bloom_slots(h)
                keys, n = np.unique(h[table[a] & table[b]], return_counts=True)
                total.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                if len(total) > 500_000:
                    yield from sums()
        yield from sums()

    seen = docs.select(column).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return candidates.join(seen, "term").select("term", "n_term")


def possible_terms(pairs: DataFrame, entities: DataFrame, rows: DataFrame, total: int, alpha: float) -> DataFrame:
    """term: those of the pairs that may disclose an entity, as far as the scanned documents tell.

    The test on PMI holds only if n_term <= n_pair (total / n_entity)^(1 - alpha). A term stands in no fewer of all documents than of those that
    hold an entity, so one that stands in more of these than its largest bound passes the test with no entity, and all texts need not be read for it.
    """
    bound = F.col("n_pair") * F.pow(F.lit(float(max(total, 1))) / F.col("n_entity"), F.lit(1.0 - alpha))
    bounds = materialise(pairs.join(entities, "entity").groupBy("term").agg(F.max(bound).alias("most")), "pii-bounds")
    # a little above the bound, as both tests are rounded
    return bounds.join(term_frequencies(rows, bounds.select("term"), "terms"), "term").where(F.col("n_term") <= F.col("most") * (1 + 1e-6)).select("term")


def term_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end without ASCII punctuation at their ends; words of punctuation only are left out."""
    starts, ends = word_bounds(raw)
    inner = np.flatnonzero(_INNER[np.frombuffer(raw, np.uint8)])
    first, last = np.searchsorted(inner, starts), np.searchsorted(inner, ends) - 1
    some = first <= last
    return inner[first[some]], inner[last[some]] + 1


def quick_hashes(raw: bytes) -> np.ndarray:
    """Hashes of whole terms: words without ASCII punctuation at their ends, lower-cased."""
    raw = raw.lower()
    starts, ends = term_places(raw)
    return run_hashes(prefix_sums(byte_values(raw)), starts, ends).view(np.int64) if len(starts) else np.zeros(0, np.int64)


def disclosures(docs: DataFrame, scanned: DataFrame, alpha: float = 0.8, min_support: int = 3) -> DataFrame:
    """entity, term pairs whose co-occurrence in documents discloses the entity."""
    rows = scanned.where(F.size("entities") > 0)
    each = rows.select("text_key", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity", "text_key").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    # a pair has no more distinct texts than its entity
    entities = materialise(entities.where(F.col("texts") >= min_support).drop("texts"), "pii-entities")

    def unpack(batches):
        schema = pa.schema([("entity", pa.int64()), ("text_key", pa.int64()), ("term", pa.int64())])
        for batch in batches:
            entity, key, held = batch.column("entity").to_pylist(), batch.column("text_key").to_pylist(), batch.column("terms").to_pylist()
            for part in pieces([len(b) for b in held], 1 << 22):
                terms = [np.unique(np.frombuffer(b, np.int64)) for b in held[part]]
                n = [len(t) for t in terms]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(x, np.int64), n)) for x in (entity[part], key[part])] + [pa.array(np.concatenate(terms))], schema=schema)

    held = rows.select("text_key", F.explode("entities").alias("entity"), "terms").join(entities.select("entity"), "entity", "left_semi").select("entity", "text_key", "terms")
    by_text = held.mapInArrow(unpack, "entity long, text_key long, term long").groupBy("entity", "term", "text_key").agg(F.count("*").alias("n"))
    pairs = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("support")).where(F.col("support") >= min_support).drop("support")
    pairs = materialise(pairs, "pii-pairs")
    total = id_and_text(docs).agg(F.count("*").alias("n")).collect()[0]["n"]
    terms = materialise(possible_terms(pairs, entities, rows, total, alpha), "pii-terms")
    frequencies = term_frequencies(id_and_text(docs), terms)
    log = F.log
    p = lambda c: F.col(c) / F.lit(float(max(total, 1)))
    pmi = log(p("n_pair")) - log(p("n_term")) - log(p("n_entity"))
    return pairs.join(entities, "entity").join(frequencies, "term").where(pmi >= -alpha * log(p("n_entity"))).where(-log(p("n_entity")) > 0).select("entity", "term")


def detect(docs: DataFrame, alpha: float = 0.8, min_support: int = 3) -> DataFrame:
    """doc_id, text_key, base, counts, terms (array of start, end) of every document; term spans merge what several entities flag."""
    scanned = materialise(scan(docs), "pii-scan")
    pairs = disclosures(docs, scanned, alpha, min_support).groupBy("entity").agg(F.collect_set("term").alias("disclosing"))
    some = scanned.where(F.size("entities") > 0)
    flagged = (
        some.select("doc_id", "text_key", F.explode("entities").alias("entity")).distinct()
        .join(pairs, "entity")
        .groupBy("doc_id", "text_key")
        .agg(F.array_distinct(F.flatten(F.collect_list("disclosing"))).alias("disclosing"))
    )
    spans = "array<struct<start: long, end: long>>"

    @F.pandas_udf(spans)
    def marked(disclosing, terms, places):
        import pandas as pd

        out = []
        for d, t, p in zip(disclosing, terms, places, strict=True):
            if d is None:
                out.append(None)
                continue
            hit = np.isin(np.frombuffer(t, np.int64), np.asarray(d, np.int64))
            start, end = np.frombuffer(p, np.int32).reshape(2, -1)
            found = [{"start": a, "end": b} for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
            out.append(found or None)
        return pd.Series(out, dtype=object)

    joined = some.alias("s").join(flagged.alias("f"), (F.col("s.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("s.text_key") == F.col("f.text_key")), "left")
    kept = joined.select("s.doc_id", "s.text_key", "s.base", "s.counts", marked("f.disclosing", "s.terms", "s.places").alias("terms"))
    none = scanned.where(F.size("entities") == 0).select("doc_id", "text_key", "base", "counts", F.lit(None).cast(spans).alias("terms"))
    return kept.unionByName(none)


def sanitise(docs: DataFrame, alpha: float = 0.8, min_support: int = 3) -> DataFrame:
    """The documents, all columns, with base values and disclosing terms replaced by ``<KIND>``. Null texts stay null."""
    found = detect(docs, alpha, min_support).where((F.col("base") != "") | (F.size("terms") > 0))
    spans = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))).alias("_spans")).dropDuplicates(["_id", "_key"])

    @F.pandas_udf("string")
    def replaced(text, span_lists):
        import pandas as pd

        out = []
        for t, s in zip(text, span_lists, strict=True):
            if t is not None and s:
                t = replace_spans(t, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(","))])
            out.append(t)
        return pd.Series(out, dtype=object)

    # one document may have several rows under one id: the text's own key decides
    spans = materialise(spans, "pii-spans")
    # texts of documents without spans are not exchanged
    some = IdFilter(spans.select("_id"))
    none = some.rows(docs, "doc_id", among=False)
    mine = some.rows(docs, "doc_id").unionByName(none.where(F.col("doc_id").isNull()))
    # a merge join at every size: the filter's and the replacing workers never stand in one task
    joined = mine.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    done = joined.withColumn("text", F.when(F.col("_spans").isNotNull(), replaced("text", "_spans")).otherwise(F.col("text"))).select(*docs.columns)
    return done.unionByName(none.where(F.col("doc_id").isNotNull()))


def replace_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans from the left, the longer first where two start together; one that begins inside an earlier one goes into it."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    d = detect(read_table(spark, sf_dir, "documents"))
    term = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select(
        "doc_id", *(F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, term)).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )
