"""Language ID by error-correcting output codes.

Each language has a codeword of bits. One linear classifier over hashed byte n-grams predicts each bit; decoding takes the
codeword of least loss, where a bit counts by how well its classifier did on the rows it learned from, and flags a text as
ambiguous when the two nearest codewords are close.

The classifiers are fitted on a bounded sample: ``per_language`` rows of each language, or fewer where ``total`` rows would be
passed, chosen by a hash of id and text; of over ``max_keys`` label values the most frequent are learned. Every text is
predicted whole, at most 64 texts at a time, so that memory does not depend on how short texts are. Edge cases: a null, empty
or letterless text is ``und`` with score 0; null languages teach nothing; with no labelled row at all every text is ``und``;
with one language every text with a letter gets it with score 1; of equally near codewords the first language by name wins;
repeated rows and ids get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fold, id_and_text, pieces, read_table, record

D1, D2, D3 = 256, 2048, 4096
DIMS = D1 + D2 + D3
HAS_LETTER = r"\p{L}"


def few(texts: list[bytes]) -> Iterator[slice]:
    """Slices of at most 64 texts and about half a megabyte: what one call of ``gram_features`` takes."""
    return pieces([len(t) + (1 << 13) for t in texts], 1 << 19)


def gram_features(texts: list[bytes]) -> np.ndarray:
    """Unit vectors of the square roots of hashed byte 1-, 2- and 3-gram counts, one row for each text."""
    joined = b"\0\0".join(t.lower() for t in texts) + b"\0\0"
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMS, [len(t) + 2 for t in texts])[:-2]
    x, y, z = b[:-2], b[1:-1], b[2:]
    two = ((x * np.uint32(2654435761) ^ y * np.uint32(2246822519)) >> np.uint32(16)) % np.uint32(D2)
    three = ((x * np.uint32(2654435761) ^ y * np.uint32(2246822519) ^ z * np.uint32(3266489917)) >> np.uint32(15)) % np.uint32(D3)
    n = len(texts) * DIMS
    counts = np.bincount(rows + x, minlength=n) + np.bincount(rows + two + D1, minlength=n) + np.bincount(rows + three + (D1 + D2), minlength=n)
    out = np.sqrt(counts.reshape(len(texts), DIMS).astype(np.float32))
    out[:, 0] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1 bits: every way of splitting few classes in two; else random splits, the best spread of several draws."""
    if k <= 5:
        n = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if i == 0 or (j + 1) >> (i - 1) & 1 == 0 else -1 for j in range(n)] for i in range(k)], np.float32)
    rng, best, spread = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        d = (bits - (m @ m.T)) / 2 + np.eye(k) * bits
        if d.min() > spread and np.all(np.abs(m.sum(axis=0)) < k):
            best, spread = m, d.min()
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray, sharpness: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the softmax of losses, and that of the second."""
        margins = sharpness * (x @ self.weights + self.intercepts)
        loss = (self.trust[None, None, :] * np.logaddexp(0, -margins[:, None, :] * self.codes[None, :, :])).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return p.argmax(axis=1), order[:, -1], order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def fit_bits(x: np.ndarray, y: np.ndarray, languages: list[str], ridge: float = 0.3) -> Model:
    """Ridge classifiers of all bits in one dual solve; classes weigh the same whatever their number of rows."""
    codes = codewords(len(languages))
    target = codes[y]
    share = np.sqrt(len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    kernel = (x @ x.T + 1) * np.outer(share, share)
    kernel[np.diag_indices(len(x))] += ridge
    alpha = np.linalg.solve(kernel, target * share[:, None]).astype(np.float32) * share[:, None]
    weights, intercepts = x.T @ alpha, alpha.sum(axis=0)
    right = (np.sign(x @ weights + intercepts) == target).mean(axis=0)
    trust = np.maximum(0.05, 2 * right - 1)
    return Model(languages, codes, weights, intercepts, (trust / trust.mean()).astype(np.float32))


def sample_by_hash(rows: DataFrame, key: str, per_key: int, salt: str, by: tuple[str, ...] = ("doc_id",), total: int = 4000, max_keys: int = 1000) -> DataFrame:
    """At most ``per_key`` rows of each key and about ``total`` in all (one of each key at least), by a hash of the columns ``by``.

    The same rows whatever the layout: ties are equal rows. One count by key first; of over ``max_keys`` keys the most frequent.
    """
    counts = rows.groupBy(key).count().orderBy(F.desc("count"), key).limit(max_keys).collect()
    if not counts:
        return rows.limit(0)
    most = max(1, min(per_key, total // len(counts)))
    # twice the share that is needed reaches the exact cut, which takes the least draws
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, (2 * most + 20) / r[1])))])
    draw = F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    near = rows.withColumn("_draw", draw).where(F.col("_draw") < share[F.col(key)])
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_draw", *by))
    return near.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_draw", "_nth")


def train(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Learns from rows with a language and a letter whose fold is not 0."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER) & (fold("doc_id", 5) != 0)).select("doc_id", "lang", "text")
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def features(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for part in few(texts):
                x = gram_features(texts[part]).astype(np.float16)
                yield record({"lang": batch.column("lang").to_pylist()[part], "x": [r.tobytes() for r in x]}, schema)

    got = sample_by_hash(rows, "lang", per_language, "ecoc", ("doc_id", "text")).mapInArrow(features, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    langs, blobs = got["lang"].to_pylist(), got["x"].to_pylist()
    del got
    names = sorted(set(langs))
    # in an order of their own, so that the fit does not depend on partitions
    order = sorted(range(len(langs)), key=lambda i: (langs[i], blobs[i]))
    x = np.empty((len(order), DIMS), np.float32)
    for row, i in enumerate(order):
        x[row] = np.frombuffer(blobs[i], np.float16)
    del blobs
    return fit_bits(x, np.array([names.index(langs[i]) for i in order]), names)


def identify(docs: DataFrame, model: Model | None, ambiguous_within: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, second_score, ambiguous for every text. The model is a few megabytes at most and goes with the tasks."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("second_score", pa.float64())])

    def predict(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            letter = batch.column("letter").to_pylist()
            for part in few(texts):
                n = len(texts[part])
                if model is None:
                    name, first, second = ["und"] * n, np.zeros(n), np.zeros(n)
                else:
                    best, first, second = model.decode(gram_features(texts[part]))
                    ok = np.array(letter[part], bool)
                    name = [model.languages[b] if k else "und" for b, k in zip(best, ok, strict=True)]
                    first, second = np.where(ok, first, 0.0), np.where(ok, second, 0.0)
                yield record({"doc_id": batch.column("doc_id").to_pylist()[part], "lang_pred": name, "score": first, "second_score": second}, schema)

    rows = id_and_text(docs).withColumn("letter", F.col("text").rlike(HAS_LETTER))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, second_score double").withColumn(
        "ambiguous", (F.col("lang_pred") != "und") & (F.col("score") - F.col("second_score") < ambiguous_within)
    )


def predicted(model: Model | None, text) -> Column:
    """The predicted language as a column over a text column; without a model every text with a letter is ``unknown``."""

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            raw, out = [t.encode() for t in texts], []
            for part in few(raw):
                out += [model.languages[b] for b in model.decode(gram_features(raw[part]))[0]] if model else ["unknown"] * len(raw[part])
            yield pd.Series(out, dtype=object)

    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(HAS_LETTER), label(text)).otherwise("und")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "second_score", "ambiguous")
