"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed into buckets with learned vectors; a document is the average of its vectors, a
softmax layer gives the class, and numpy stochastic gradient descent trains both. For scoring, the average and the layer
are linear, so that each bucket's vector is folded into one number and a document's score is the mean of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, giving_back, id_fold, slices, utf8

BUCKET_BITS, DIM, ORDERS = 17, 8, (3, 4)
#: Labelled documents that a fit uses at most, and characters of the window that it takes of each.
SAMPLE_DOCS, WINDOW = 4000, 8000
#: Documents scored below this are predicted label 0.
THRESHOLD = 0.7
#: Each document also has so many copies of one feature common to all, which steadies the average of short texts.
COMMON = 100
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """The upper bits of a 64-bit hash as a bucket."""
    h = (h + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return np.maximum(h >> np.uint64(64 - BUCKET_BITS), np.uint64(1)).astype(np.int32)  # bucket 0 is the common feature


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and for each n-gram order: buckets, and where each text's run of them begins and ends."""
    starts, ends = offsets[:-1], offsets[1:]
    out = []
    wide = data.astype(np.uint64) + np.uint64(1)
    for n in ORDERS:
        m = max(0, len(data) - n + 1)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * _P + wide[j : j + m]
        low = np.minimum(starts, m)
        out.append((_mix(h, n), low, np.maximum(low, np.minimum(ends - n + 1, m))))
    # Words: a prefix sum of byte * P^i, differences of which are brought to the same power.
    white = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~white
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first[1:] &= white[:-1] | cut[1 : len(data)]
    last = ~white
    last[:-1] &= white[1:] | cut[1 : len(data)]
    power = np.full(len(data) + 1, _P, np.uint64)
    power[:1] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(wide * power[:-1], out=sums[1:])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    back = np.full(len(data) + 1, _P_INV, np.uint64)
    back[:1] = 1
    np.cumprod(back, out=back)
    word = (sums[end] - sums[begin]) * back[begin]
    # A word that repeats the one before it is one feature of its own, whatever the word.
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[np.searchsorted(begin, starts[starts < (begin[-1] if len(begin) else 0)])] = False
    out.append((_mix(np.where(again, np.uint64(0), word), 1), np.searchsorted(begin, starts), np.searchsorted(begin, ends)))
    return out


class Model:
    """One number a bucket, and the bias; scores are probabilities of label 1."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        total, n = np.full(len(texts), self.weight[0] * COMMON), np.full(len(texts), COMMON)
        for buckets, begin, end in features(data, offsets):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.weight[buckets], out=sums[1:])
            total += sums[end] - sums[begin]
            n += end - begin
        return 1 / (1 + np.exp(-np.clip(total / n + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = 5, rate: float = 1.0, seed: int = 3) -> Model:
    """Softmax over averaged hashed vectors by stochastic gradient descent, one document a step, falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    shift = np.zeros(2, np.float32)
    bags = []
    for text in texts:
        data, offsets = utf8(pa.array([text]))
        buckets, n = np.unique(np.concatenate([np.zeros(COMMON, np.int32), *(b[lo[0] : hi[0]] for b, lo, hi in features(data, offsets))]), return_counts=True)
        bags.append((buckets, (n / n.sum()).astype(np.float32)))
    step, steps = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets, part = bags[i]
            y = labels[i]
            hidden = part @ vectors[buckets]
            z = hidden @ layer + shift
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= rate * (1 - step / steps)
            # Each vector moves by its part; together they move the average by one step of the gradient.
            vectors[buckets] -= np.outer(part / (part @ part), layer @ p)
            layer -= np.outer(hidden, p)
            shift -= p
            step += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(shift[1] - shift[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, seed: int = 11) -> Model:
    """Fit on a seeded sample of about SAMPLE_DOCS labelled ids outside the held-out fold, of each text a seeded window of
    WINDOW characters from anywhere in it.

    Null labels, and ids that are null or held out, are left out; an id with several labels has the one that most of them
    give (1 where they tie), an id with several texts the first by text. Without any label all scores are 0.5.
    """
    key, y, t = (f"{OWN}{c}" for c in ("id", "y", "t"))
    known = labels.where(F.col(label_col).isNotNull() & (id_fold(id_col, folds) != held)).groupBy(F.col(id_col).alias(key)).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias(y))
    n = known.count()
    few = known.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30) * n < SAMPLE_DOCS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    begin = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.greatest(F.lit(1), F.length(text) - WINDOW + 1)).cast("int") + 1
    # About SAMPLE_DOCS rows of a label: a bounded side; and one row of each id comes back.
    rows = docs.select(F.col(id_col).alias(f"{OWN}doc"), F.substring(text, begin, F.lit(WINDOW)).alias(t)).join(F.broadcast(few), F.col(f"{OWN}doc") == F.col(key))
    rows = rows.groupBy(key, y).agg(F.min(t).alias(t)).collect()
    rows = sorted((r[key], r[t], r[y]) for r in rows)
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(text: Column, model: Model, spark) -> Column:
    """Probability of label 1 of each whole text; null counts as empty, an empty text has the score of the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.score(t) for t in slices(texts, 1 << 17)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    scores = giving_back(scores)
    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, folds: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, score, predicted) of every row. A null id is neither learned from nor held out."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, held)
    out = docs.select(F.col(id_col), F.coalesce(id_fold(id_col, folds) == held, F.lit(False)).alias("held_out"), score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
