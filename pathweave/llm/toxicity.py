"""Toxicity by weak supervision.

Many voters look at a text: a given lexicon of insults, and lexicon voters (one word each) and pattern voters (a word beginning, or one
that many words of the text share) found by their odds among labelled rows. A generative label model estimates each voter's rates
of firing on toxic and on clean texts without looking at labels again (EM over a latent class), damps voters that fire
together more than the class explains (so that correlated voters count together, but never less than the strongest of them alone), and
yields a posterior for each sampled text. A linear classifier over hashed features is then trained on those posteriors and
scores every whole text.

Only rows whose fold is not 0 teach. The training sample is bounded (``per_class`` rows of each label, chosen by a hash of
the id) and weighs as the labelled rows do, so that scores do not move with the size of the input; voters are bounded by
``max_voters``. Edge cases: null and empty texts get the score of a text without features; null labels and labels without a
document teach nothing; of repeated labels the largest counts; of rows that share an id one feature set, the least, teaches; without both
classes in the labelled rows every score is 0; repeated rows and ids get equal results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, byte_values, fold, id_and_text, mix, prefix_sums, read_table, record, run_hashes, word_bounds
from .language import sample_by_hash

BEGINNINGS = (4, 5, 6, 7)
#: A beginning that two words share, and one in so many words, is a pattern too.
OFTEN = 50
_TWICE, _OFTEN = U(0x7477696365), U(0x6F6674656E)
#: Insults in the languages at hand, as voters that need no labels.
LEXICON = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool dumb jerk imbecile filth "
    "dumm trottel abschaum widerlich erbärmlich versager stupide débile ordure minable dégoûtant "
    "idiota estúpido imbécil basura patético asqueroso"
).split()


def features(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the lower-case words, of their first 4 to 7 bytes, and of such beginnings that two words or a fiftieth of
    all words have; punctuation at the ends goes."""
    text = text.lower().translate(_EDGES)
    starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, U)
    sums = prefix_sums(byte_values(text))
    parts = [run_hashes(sums, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts > n
        h, count = np.unique(mix(run_hashes(sums, starts[long], starts[long] + n) ^ U(n)), return_counts=True)
        parts += [h, mix(h[count > 1] ^ _TWICE), mix(h[(count > 1) & (count * OFTEN >= len(starts))] ^ _OFTEN)]
    return np.unique(np.concatenate(parts))


def word_feature(word: str) -> np.uint64:
    raw = word.lower().encode()
    return run_hashes(prefix_sums(byte_values(raw)), np.array([0]), np.array([len(raw)]))[0]


#: ASCII punctuation separates words here.
_EDGES = bytes(32 if chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


@dataclass
class LabelModel:
    """P(fires | toxic), P(fires | clean) of each voter, its damping for correlation, the log odds that toxic texts leave
    all voters silent, and the share of toxic texts."""

    on_toxic: np.ndarray
    on_clean: np.ndarray
    damping: np.ndarray
    none_fires: float
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A silent voter abstains; that none fires at all is one more vote."""
        fire = np.log(self.on_toxic) - np.log(self.on_clean)
        none = votes.sum(axis=1) == 0
        strongest = (votes * fire).max(axis=1, initial=0.0)
        z = np.log(self.prior / (1 - self.prior)) + np.maximum(strongest, votes @ (self.damping * fire)) + none * self.none_fires
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """EM over the latent class, started from the share of voters that fire. Voters are oriented towards toxic.

    After each round the correlation of two voters within the classes is estimated from residuals; a voter's evidence is
    divided by one plus the sum of its positive residual correlations above noise, so that a group of copies counts once.
    """
    n, m = votes.shape
    order = np.argsort(-votes.sum(axis=1), kind="stable")
    p = np.full(n, 0.02)
    p[order[: max(1, int(n * prior))]] = 0.98
    p[votes.sum(axis=1) == 0] = 0.02
    damping = np.ones(m)
    noise = 3 / np.sqrt(max(n, 1))
    for _ in range(rounds):
        a = np.clip((p @ votes + 0.5) / (p.sum() + 1), 1e-5, 1 - 1e-5)
        b = np.clip(((1 - p) @ votes + 0.05) / ((1 - p).sum() + 1), 1e-6, 1 - 1e-5)
        a = np.maximum(a, b)
        rest = votes - np.outer(p, a) - np.outer(1 - p, b)
        c = rest.T @ rest
        s = np.sqrt(np.maximum(np.diag(c), 1e-9))
        c = c / np.outer(s, s)
        np.fill_diagonal(c, 0)
        damping = 1 / (1 + np.where(c > max(noise, 0.1), c, 0).sum(axis=1))
        none = votes.sum(axis=1) == 0
        silence = np.log((p @ none + 0.5) / (p.sum() + 1)) - np.log(((1 - p) @ none + 0.5) / ((1 - p).sum() + 1))
        model = LabelModel(a, b, damping, min(0.0, float(silence)), float(np.clip(p.mean(), 1e-3, 1 - 1e-3)))
        p = model.posterior(votes)
    return model


def fit_linear(rows: list[np.ndarray], dims: int, target: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over sparse 0/1 features (Adagrad on the whole sample)."""
    index = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(dims), 0.0
    gw, gb = np.full(dims, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[index], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.bincount(index, weights=g[row], minlength=dims) + l2 * w
        gw += grad * grad
        gb += g.sum() ** 2
        w -= rate * grad / np.sqrt(gw)
        b -= rate * g.sum() / np.sqrt(gb)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Scale and shift of a score so that its sigmoid is a probability among the rows that the sample stands for (Platt's targets, weighted
    Newton steps with a small ridge)."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x, beta = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - target)) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def distinct_voters(votes: np.ndarray, contained: float = 0.9) -> list[int]:
    """Voters, most frequent first, without those that fire almost only where one already taken does: a word and its beginnings."""
    both, own, taken = votes.T @ votes, votes.sum(axis=0), []
    for j in np.argsort(-own, kind="stable"):
        if not taken or both[j, taken].max() < contained * own[j]:
            taken.append(int(j))
    return taken


@dataclass
class Classifier:
    """Weights of chosen features (sorted hashes) and an intercept."""

    names: np.ndarray
    weights: np.ndarray
    intercept: float
    voters: int = 0
    label_model: LabelModel | None = None

    def score(self, text: bytes) -> float:
        h = features(text)
        z = self.intercept
        if len(self.names) and len(h):
            at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
            z += float(self.weights[at[self.names[at] == h]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


NOTHING = Classifier(np.zeros(0, U), np.zeros(0), -30.0)


def fit(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, max_voters: int = 600, min_rows: int = 6, min_odds: float = 3.0, lexicon: list[str] = LEXICON) -> Classifier:
    """The classifier for rows of feature hashes with labels; ``weight``: how many labelled rows each stands for."""
    every = np.concatenate(x)
    names, inverse = np.unique(every, return_inverse=True)
    label = np.repeat(y, [len(r) for r in x])
    pos = np.bincount(inverse, weights=label == 1, minlength=len(names))
    neg = np.bincount(inverse, weights=label != 1, minlength=len(names))
    odds = np.log((pos + 0.5) / ((y == 1).sum() + 1)) - np.log((neg + 0.5) / ((y != 1).sum() + 1))
    # a lower bound of the odds, so that rare words need more rows; half of it is enough for words that no clean row has
    bound = odds - 1.64 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    given = np.isin(names, np.array([word_feature(w) for w in lexicon], U)) & (odds > 0) & (pos > 0)
    good = np.flatnonzero(given | ((pos >= min_rows) & ((bound >= min_odds) | ((neg == 0) & (bound >= min_odds / 2)))))
    good = good[np.lexsort((names[good], -pos[good]))][: 4 * max_voters]
    if not len(good):
        return NOTHING
    column = np.full(len(names), -1)
    column[good] = np.arange(len(good))
    votes = np.zeros((len(y), len(good)), np.float32)
    hit = column[inverse] >= 0
    votes[np.repeat(np.arange(len(y)), [len(r) for r in x])[hit], column[inverse][hit]] = 1
    votes = votes[:, distinct_voters(votes)[:max_voters]]
    model = fit_label_model(votes, float((y == 1).mean()))
    soft = model.posterior(votes)
    # features whose share among toxic posteriors stands out from chance by over 6 standard errors
    hard = np.repeat(soft, [len(r) for r in x])
    on, total = np.bincount(inverse, weights=hard, minlength=len(names)), pos + neg
    base = soft.mean()
    seen = (total >= 4) & (np.abs(on - total * base) > 6 * np.sqrt(total * base * (1 - base)))
    seen[good] = True
    place = np.cumsum(seen) - 1
    found = [place[i[seen[i]]] for i in (np.searchsorted(names, r) for r in x)]
    w, b = fit_linear(found, int(seen.sum()), soft)
    scale, shift = calibrate(b + np.array([w[f].sum() for f in found]), y == 1, weight)
    return Classifier(names[seen], scale * w, scale * b + shift, votes.shape[1], model)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, **voters) -> Classifier:
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(fold("doc_id", 5) != 0)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("h", pa.binary())])

    def hashed(batches):
        for batch in batches:
            yield record({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "h": [features(t.encode()).tobytes() for t in batch.column("text").to_pylist()]}, schema)

    # the sample holds at most per_class ids of each label, so it may be broadcast at any size of input; one row of each id teaches
    sample = sample_by_hash(marks, "toxic", per_class, "toxic", total=2 * per_class)
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(hashed, "doc_id long, toxic int, h binary")
    # in id order, so that the fit does not depend on partitions
    got = rows.groupBy("doc_id", "toxic").agg(F.min("h").alias("h")).toArrow().sort_by("doc_id")
    y = np.array(got["toxic"].to_pylist(), np.int64)
    x = [np.frombuffer(b, U) for b in got["h"].to_pylist()]
    if not len(y) or y.min() == y.max():
        return NOTHING
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    weight = np.array([counts[t] / (y == t).sum() for t in y.tolist()])
    return fit(x, y, weight / weight.mean(), **voters)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score for every text; the model is as small as its sample is bounded."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def predict(batches):
        for batch in batches:
            yield record({"doc_id": batch.column("doc_id"), "score": [model.score(t.encode()) for t in batch.column("text").to_pylist()]}, schema)

    return id_and_text(docs).mapInArrow(predict, "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for every text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
