"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is computed in time linear in the
features as 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Buckets of hashed words; statistics and metadata have the places after them.
BUCKETS = 1 << 14
STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "line_words", "upper", "digit", "ending", "symbol", "pipe", "space",
    "beyond_ascii", "capital_words", "distinct_words", "top_word", "word_again", "distinct_lines", "long_word",
)
FEATURES = BUCKETS + len(STATISTICS)

_CLASSES = np.zeros(256, np.int64)  # 0: lower case and the rest of ASCII
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[[ord(c) for c in ".,;:?!'\"-()"]] = 3
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 4
_CLASSES[ord("|")] = 5
_CLASSES[[9, 11, 12, 13, 32]] = 6
_CLASSES[128:192] = 8  # continues a character
_CLASSES[192:] = 7
_CLASSES[10] = 9
#: Characters of a text whose classes are counted at once.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Training:
    """Bounds and steps of the fit. max_rows bounds the labelled sample: the rows of least hash of their doc_id."""

    max_rows: int = 6000
    rank: int = 8
    epochs: int = 12
    batch: int = 64
    step: float = 0.05
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, words: np.ndarray, values: np.ndarray, statistics: np.ndarray) -> float:
        """Probability of label 1 for one document's features."""
        at = np.concatenate([words, np.arange(BUCKETS, FEATURES)])
        x = np.concatenate([values, np.clip((statistics - self.mean) / self.scale, -4, 4)])
        v = self.v[at]
        y = self.w0 + float(self.w[at] @ x) + 0.5 * float(((x @ v) ** 2 - (x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of a whole text; null counts as empty, a null n_chars as the text's length.

    A bucket's value is log(1 + count) over the norm of them all.
    """
    text = text or ""
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    sums: dict[int, int] = {}
    for word, n in counts.items():
        at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        sums[at] = sums.get(at, 0) + n
    buckets, values = np.fromiter(sums.keys(), np.int64, len(sums)), np.log1p(np.fromiter(sums.values(), np.float64, len(sums)))
    values /= max(float(np.sqrt(values @ values)), 1e-9)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.zeros(10, np.int64)
    for start in range(0, len(raw), _BLOCK):
        kinds += np.bincount(_CLASSES[raw[start : start + _BLOCK]], minlength=10)
    n, m, k = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    length = len(text) if n_chars is None or n_chars != n_chars else max(float(n_chars), 0.0)
    statistics = np.array([
        np.log1p(length), np.log1p(len(words)), np.log1p(len(lines)), n / m, np.log1p(m / k), kinds[1] / n, kinds[2] / n, kinds[3] / m, kinds[4] / n, kinds[5] / m, kinds[6] / n,
        kinds[7] / n, sum(c for w, c in counts.items() if w[0].isupper()) / m, len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m, len(set(lines)) / k, np.log1p(max(map(len, counts), default=0)),
    ], np.float64)
    return buckets, values, statistics


_FEATURES_TYPE = T.StructType([
    T.StructField("buckets", T.ArrayType(T.IntegerType())),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("statistics", T.ArrayType(T.DoubleType())),
])


@pandas_udf(_FEATURES_TYPE)
def features_udf(texts: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
    found = [features(t, c) for t, c in zip(texts, n_chars, strict=True)]
    return pd.DataFrame({"buckets": [f[0].astype(np.int32) for f in found], "weights": [f[1] for f in found], "statistics": [f[2] for f in found]})


def held_out() -> Column:
    """Whether a row's label may not be learnt from: crc32 of doc_id as text leaves 2 by 4 (null doc_ids: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, training: Training) -> list:
    """Features and labels of at most max_rows documents; those of a doc_id with differing labels are left out."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
        .where("low = quality")
    )
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id").join(marks.select("doc_id", "quality"), "doc_id").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.max_rows)  # bounded: max_rows ids
    return (
        docs.select("doc_id", "text", "n_chars")
        .join(F.broadcast(chosen), "doc_id")
        .select(features_udf("text", F.col("n_chars").cast("double")).alias("f"), "quality", "doc_id", F.xxhash64("text", "n_chars").alias("place"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "place")
        .limit(2 * training.max_rows)  # where doc_ids repeat
        .select("f.*", "quality", "doc_id", "place")
        .collect()
    )


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """A factorisation machine fitted by AdaGrad on the log loss over the bounded sample.

    Without a labelled row, or with one class alone, the score is the smoothed share of label 1 for every text.
    """
    rows = sorted(training_rows(docs, labels, training), key=lambda r: (r["doc_id"], r["place"]))
    y = np.array([r["quality"] for r in rows], np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(FEATURES), np.zeros((FEATURES, training.rank))
    statistics = np.array([r["statistics"] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    mean, scale = statistics.mean(axis=0), np.maximum(statistics.std(axis=0), 1e-3)
    model = Model(w0, w, v, mean, scale)
    if len(set(y.tolist())) < 2:
        return model
    rng = np.random.default_rng(training.seed)
    v[:] = rng.normal(0, 0.02, v.shape)
    places = np.arange(BUCKETS, FEATURES)
    at = [np.concatenate([np.array(r["buckets"], np.int64), places]) for r in rows]
    x = [np.concatenate([np.array(r["weights"]), np.clip((s - mean) / scale, -4, 4)]) for r, s in zip(rows, statistics, strict=True)]
    g0, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(training.epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), training.batch):
            batch = order[start : start + training.batch]
            sizes = np.array([len(at[i]) for i in batch])
            index, value = np.concatenate([at[i] for i in batch]), np.concatenate([x[i] for i in batch])
            first = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(batch)), sizes)
            vx = v[index] * value[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
            z = w0 + np.add.reduceat(w[index] * value, first) + pairs
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            used, inverse = np.unique(index, return_inverse=True)
            slope = np.bincount(inverse, error[row] * value, len(used)) + training.decay * w[used]
            each = (error[row] * value)[:, None] * (sums[row] - vx)
            slopes = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(training.rank)], axis=1) + training.decay * v[used]
            g0 += error.sum() ** 2
            gw[used] += slope**2
            gv[used] += slopes**2
            w0 -= training.step * error.sum() / np.sqrt(g0)
            w[used] -= training.step * slope / np.sqrt(gw[used])
            v[used] -= training.step * slopes / np.sqrt(gv[used])
    return Model(float(w0), w, v, mean, scale)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs(doc_id, text, n_chars, ...) with score double, predicted int and held_out boolean.

    Null and empty texts have the score of a text without words. Columns of other names pass through; those three are
    replaced where docs has them.
    """

    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, n_chars in batches:
            yield pd.Series([model.score(*features(t, c)) for t, c in zip(texts, n_chars, strict=True)], dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]
    return (
        docs.select(*kept)
        .withColumn("score", score("text", F.col("n_chars").cast("double")))
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
        .withColumn("held_out", held_out())
    )
