"""Windows of a fixed number of symbols, grouped by their smallest k-gram.

A window's anchor is the least hash among its k-grams: equal windows have equal anchors wherever they stand. Consecutive
windows with one anchor form a run, and a text of n symbols has some 2n / (window - k + 2) runs, so that runs can be
exchanged where single windows could not.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHECKS, byte_values, gram_hashes, id_and_text, pieces, prefix_sums, run_hashes, sliding_min, word_hashes


def symbols(text: bytes, unit: str) -> np.ndarray:
    return byte_values(text) if unit == "bytes" else word_hashes(text)


def anchor_runs(values: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window, number of windows of each run; nothing for a text shorter than a window."""
    if len(values) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    least = sliding_min(gram_hashes(values, k), window - k + 1)
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[lo], lo, np.diff(np.append(lo, len(least)))


def periodic_runs(values: np.ndarray, k: int, window: int) -> np.ndarray:
    """The anchors of runs that hold their anchor more than once, so that windows of one run may be equal.

    The first and the last place of a window's least gram differ there; places go into the low 16 bits of the hash.
    """
    if len(values) < window:
        return np.zeros(0, np.uint64)
    grams, width = gram_hashes(values, k), window - k + 1
    place, low = np.arange(len(grams), dtype=np.uint64) & np.uint64(0xFFFF), np.uint64(0xFFFF)
    high = grams & ~low
    first, last = sliding_min(high | place, width), sliding_min(high | (low - place), width)
    twice = (first & low) != low - (last & low)
    return np.unique(sliding_min(grams, width)[twice]) if twice.any() else np.zeros(0, np.uint64)


def content_hashes(values: np.ndarray, lo: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Second hash of each run's whole content, independent of the anchors."""
    return run_hashes(prefix_sums(values, CHECKS), lo, lo + n - 1 + window, CHECKS)


def window_hashes(values: np.ndarray, window: int) -> np.ndarray:
    """Second hash of each window."""
    if len(values) < window:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(values) - window + 1)
    return run_hashes(prefix_sums(values, CHECKS), starts, starts + window, CHECKS)


def expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All window starts of runs."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1])) + np.repeat(lo - (ends - n), n) if len(n) else np.zeros(0, np.int64)


def text_tag(text: bytes) -> int:
    """Tells rows apart that share an id but not the text."""
    return zlib.crc32(text) - (1 << 31)


RUN_DDL = "anchor long, content long, doc_id long, tag int, lo int, n int"
_RUN = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])


def runs_of(docs: DataFrame, unit: str, k: int, window: int) -> DataFrame:
    """anchor, content, doc_id, tag, lo, n for every run of every text. Rows with a null id are left out: nothing can refer to them."""

    def find(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in pieces([len(t) for t in texts], 1 << 21):
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                for doc, text in zip(ids[part], texts[part], strict=True):
                    raw = text.encode()
                    values = symbols(raw, unit)
                    a, lo, n = anchor_runs(values, k, window)
                    if len(a):
                        c = content_hashes(values, lo, n, window)
                        for col, v in zip(cols, (a.view(np.int64), c.view(np.int64), np.full(len(a), doc), np.full(len(a), text_tag(raw), np.int32), lo.astype(np.int32), n.astype(np.int32)), strict=True):
                            col.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(cols, _RUN, strict=True)], schema=_RUN)

    return id_and_text(docs).where(F.col("doc_id").isNotNull()).mapInArrow(find, RUN_DDL)


def cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n symbols some window from ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def maximal(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


