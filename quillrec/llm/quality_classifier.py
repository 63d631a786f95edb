"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fold_of, text_of

#: Frequent function words of the languages at hand (fixed values).
STOP_WORDS = frozenset(
    b"the of and to in a is that it for on was as with by be this are an or from at not"
    b" der die und in den von zu das mit sich des auf im ein nicht eine als"
    b" de la le et les des en un du une que est dans qui par pour au"
    b" el los se del las una con no su para es al".split()
)
#: Byte classes whose shares are features.
_CLASSES = (
    b"#*$%&", b"|<>{}[]_=\\~^", b"!?", b".", b",;:", b"'\"()-/", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz", b" ", b"\n", b"\t\r\x0b\x0c",
    bytes(range(128, 256)), b"@", b"aeiou", bytes(i for i in range(32) if i not in (9, 10, 11, 12, 13)),
)
_CLASS = np.array([[b in c for c in _CLASSES] for b in range(256)], dtype=np.float64)
FEATURES = len(_CLASSES) + 13


def statistics(texts: list[str]) -> np.ndarray:
    """One row of features for each whole text; an empty text has zeros."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            continue
        n = len(data)
        out[i, : len(_CLASSES)] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / n
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        k = max(len(words), 1)
        distinct = set(words)
        pairs = len(set(zip(words, words[1:], strict=False)))
        size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        out[i, len(_CLASSES) :] = (
            np.log1p(n),
            np.log1p(len(words)),
            size.mean(),
            size.max(),
            size.std(),
            len(distinct) / k,
            pairs / max(len(words) - 1, 1),
            sum(map(STOP_WORDS.__contains__, words)) / k,
            np.log1p(len(lines)),
            len(set(lines)) / max(len(lines), 1),
            len(words) / max(len(lines), 1),
            sum(map(bytes.isupper, words)) / k,
            sum(map(bytes.isalpha, distinct)) / max(len(distinct), 1),
        )
    return out


@dataclass
class Trees:
    """Boosted trees flattened into arrays of shape (trees, nodes); a leaf points to itself."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: every tree walks all rows at once."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                low = x[rows, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(low, self.left[t, at], self.right[t, at])
            total += self.value[t, at]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: float = 3.0, l2: float = 1.0
) -> Trees:
    """Histogram gradient boosting with the logistic loss. Deterministic; ties go to the first feature and lowest bin.

    Without labels of both kinds the score is constant: the share of label 1 among them (0.5 without any).
    """
    nodes = 2 ** (depth + 1) - 1
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Trees(float(np.log(mean / (1 - mean))), *(np.zeros((0, nodes), k) for k in (np.int64, float, np.int64, np.int64, float)), depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    flat = binned + np.arange(x.shape[1]) * bins
    margin = np.full(len(y), model.prior)
    parts: list[tuple] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.zeros(nodes)
        left, right, value = np.arange(nodes), np.arange(nodes), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + l2)
            if node >= 2**depth - 1 or hs < 2 * least:
                continue
            keys = flat[rows].ravel()
            shape = (x.shape[1], bins)
            gl = np.bincount(keys, np.repeat(g[rows], x.shape[1]), minlength=shape[0] * bins).reshape(shape).cumsum(1)
            hl = np.bincount(keys, np.repeat(h[rows], x.shape[1]), minlength=shape[0] * bins).reshape(shape).cumsum(1)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(hl < least) | (hs - hl < least)] = 0
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-6:
                continue
            f, b = divmod(best, bins)
            feature[node], threshold[node] = f, cuts[f][b]
            left[node], right[node] = 2 * node + 1, 2 * node + 2
            at[rows] = np.where(binned[rows, f] <= b, left[node], right[node])
        margin += value[at]
        parts.append((feature, threshold, left, right, value))
    return Trees(model.prior, *(np.stack(c) for c in zip(*parts, strict=True)), depth)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    """Fits on at most ``sample`` labelled documents, those with the smallest hash of their doc_id.

    Only rows of fold 1 to 4 (crc32 of the doc_id as text, mod 5) are learned from. Several labels of a document count
    as their rounded mean; null labels and null doc_ids are left out. Of several texts of a doc_id the one with the smallest hash
    counts, so that the sample bounds what is broadcast and collected, however often a doc_id is repeated.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(fold_of(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "id": pdf["id"], "h": pdf["h"], "x": list(statistics(pdf["text"].tolist()))})

    rows = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.col("doc_id").cast("long").alias("id"), "y", F.xxhash64("text").alias("h"), "text")
    rows = rows.mapInPandas(run, "y double, id long, h long, x array<double>")
    got = rows.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("h", "x")).alias("t")).select("id", "y", F.col("t.x").alias("x")).toPandas()
    if not len(got):
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    x, y, ids = np.stack(got["x"].to_numpy()), got["y"].to_numpy(), got["id"].to_numpy()
    order = np.lexsort((*x.T, y, ids))  # tasks end in any order
    return fit(x[order], y[order])


def score_of(model: Trees, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics(texts.tolist())))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; null and empty texts are scored as empty."""
    model = train(docs, labels)
    rows = docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), score_of(model, text_of()).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    return docs.where(score_of(train(docs, labels), text_of()) >= threshold)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
