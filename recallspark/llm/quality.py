"""Quality classifier on random-indexing word vectors.

Every word (hashed to ``WORDS`` rows) has a sparse random index vector; its context vector is the sum
of the index vectors of its neighbours over all documents. A document is the mean of its words'
context and index vectors with three counts, and a two-layer network turns it into a probability
whose temperature is set on labelled rows that the fit did not see.

The context sums cover every document. Words share ``WORDS`` rows: in a corpus of more distinct words
the rarer ones blend with others, and the frequent ones keep most of their row. Only the fit takes a
bounded number of labelled rows (``max_labelled``, those with the smallest hash of their id; of several
texts of one id the one with the smallest hash). Neither ids, sources, languages nor
labels are inputs of a score.

Defined cases: a null text is the empty text and is scored as one without words; repeated label rows
count once with their largest label; without labelled rows every score is 0.5; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .near_dedup import _mixed
from .units import code_points

WORDS, DIMS, NONZERO = 1 << 14, 32, 4
_rng = np.random.default_rng(11)
INDEX_AT = _rng.integers(0, DIMS, (WORDS, NONZERO))
INDEX_SIGN = _rng.choice([-1, 1], (WORDS, NONZERO))
INDEX = np.zeros((WORDS, DIMS), np.float32)
for _k in range(NONZERO):
    np.add.at(INDEX, (np.arange(WORDS), INDEX_AT[:, _k]), INDEX_SIGN[:, _k])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, whether it is made of signs, and where the words of each text start (one more
    at the end). Words are runs of letters and digits, or runs of other signs."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = code_points(texts)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(lengths)
    begin = ends - lengths
    space = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0)
    alnum = ((cp >= 48) & (cp < 58)) | ((cp >= 65) & (cp < 91)) | ((cp >= 97) & (cp < 123)) | (cp >= 0xC0)
    kind = np.where(space, 0, np.where(alnum, 1, 2)).astype(np.uint8)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[begin[lengths > 0]] = True
    at = np.flatnonzero(start)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    powers = np.cumprod(np.full(int(place.max()) + 1, _MULT, np.uint64))
    h = _mixed(np.add.reduceat((cp.astype(np.uint64) + np.uint64(7)) * powers[place], at))
    ink = kind[at] > 0
    at, h = at[ink], h[ink]
    offsets = np.append(np.searchsorted(at, begin, side="left"), len(at))
    return (h & np.uint64(WORDS - 1)).astype(np.int64), kind[at] == 2, offsets


def slices(texts: list[str], max_chars: int = 500_000):
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > max_chars:
            yield texts[start:i]
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield texts[start:]


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sum of the neighbours' index vectors for each word row, over all documents: each task sums its
    own rows, the sums are added by word row. The result has a fixed size."""
    names = [f"v{k}" for k in range(DIMS)]

    def run(rows):
        total = np.zeros(WORDS * DIMS, np.int64)
        for batch in rows:
            for part in slices([t or "" for t in batch.column(text_col).to_pylist()]):
                word, _, offsets = words_of(part)
                if len(word) < 2:
                    continue
                inner = np.ones(len(word) - 1, bool)  # whether a word and the next are of one text
                cut = offsets[1:-1]
                inner[cut[(cut > 0) & (cut < len(word))] - 1] = False
                a, b = word[:-1][inner], word[1:][inner]
                own, near = np.concatenate((a, b)), np.concatenate((b, a))
                place = (own * DIMS)[:, None] + INDEX_AT[near]
                total += np.bincount(place.ravel(), INDEX_SIGN[near].ravel(), WORDS * DIMS).astype(np.int64)
        total = total.reshape(WORDS, DIMS)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(total[used, k]) for k in range(DIMS)], names=["word", *names])

    sums = docs.select(text_col).mapInArrow(run, ", ".join(["word long", *(f"{n} long" for n in names)]))
    sums = sums.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most WORDS rows
    out = np.zeros((WORDS, DIMS), np.float32)
    vectors = sums[names].to_numpy(np.float64)
    out[sums["word"].to_numpy(np.int64)] = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1)
    return out


def features(texts: list[str], context: np.ndarray) -> np.ndarray:
    """Mean context vector, mean index vector, log count, share of distinct words, of words like the one
    before, and of signs."""
    out = []
    both, ones = np.concatenate((context, INDEX), axis=1), np.ones(1 << 16, np.float32)
    for part in slices(texts):
        word, sign, offsets = words_of(part)
        n = np.diff(offsets)
        x = np.zeros((len(part), both.shape[1] + 4), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            again = np.append(False, word[1:] == word[:-1])
            again[offsets[full]] = False
            for i, a, b in zip(full.tolist(), offsets[full].tolist(), offsets[full + 1].tolist()):
                for k in range(a, b, 1 << 16):  # row by row the vectors stay in the cache
                    own = word[k:min(b, k + (1 << 16))]
                    x[i, :-4] += ones[:len(own)] @ both.take(own, axis=0)
            x[full, :-4] /= n[full, None]
            x[full, -4] = np.add.reduceat(again, offsets[full], dtype=np.int64) / n[full]
            x[full, -1] = np.add.reduceat(sign, offsets[full], dtype=np.int64) / n[full]
            pairs = np.unique(np.repeat(np.arange(len(part)), n) * WORDS + word) // WORDS
            x[full, -2] = np.bincount(pairs, minlength=len(part))[full] / n[full]
        x[:, -3] = np.log1p(n)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, both.shape[1] + 4), np.float32)


class Network:
    """Two layers, trained by Adam on the log loss; ``temperature`` divides the last sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, seed: int = 3):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held = max(1, len(x) // 5)
        calibrate, fit = order[:held], order[held:] if len(x) > 5 else order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        z = self._scaled(x)
        w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(z[rows] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[rows]) / len(rows)
                back = d[:, None] * w[2] * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logit, own = self._logit(x[calibrate]), y[calibrate]
        tried = np.geomspace(0.25, 16, 61)
        loss = [np.mean(np.logaddexp(0, logit / t) - own * logit / t) for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x), -500, 500)))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_labelled: int = 20_000) -> Column:
    """The fitted score as a column over ``text_col``; learns from ``docs`` joined with ``labels``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("__y")).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    context = context_sums(docs, text_col)

    @F.pandas_udf("array<float>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series(list(features([t or "" for t in text], context)))

    picked = F.min_by(F.struct("__y", F.col(text_col).alias("__text")), F.struct(F.xxhash64(text_col), text_col))
    sample = docs.join(F.broadcast(known), id_col).groupBy(id_col).agg(picked.alias("__s"))  # at most max_labelled rows
    sample = sample.select(id_col, F.col("__s.__y").alias("__y"), vector("__s.__text").alias("x")).toPandas()
    sample = sample.sort_values(id_col, kind="stable")
    net = Network(np.stack(sample["x"]).astype(np.float32), sample["__y"].to_numpy(float)) if len(sample) else None

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series(np.full(len(text), 0.5))
        return pd.Series(net.score(features([t or "" for t in text], context)))

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                    **kw) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    score = quality_score(docs, labels, id_col, text_col, **kw)
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that the classifier does not reject."""
    score = quality_score(docs, labels, id_col, text_col, **kw)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("__score", score).where(F.col("__score") >= threshold).select(*names)
