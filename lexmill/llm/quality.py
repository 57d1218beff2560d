"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, remainder, token_hashes

#: Hash buckets of words, length of a word's vector, entries of an index vector that are not 0, and words to each side that count as its context.
BUCKETS, WIDTH, ENTRIES, WINDOW = 1 << 14, 64, 4, 2
#: Labelled rows of each class that the network is fitted to, about.
ROWS_PER_CLASS = 3000
HIDDEN = 32
PREDICTED_FROM = 0.3
#: Buckets of a chunk in which sums of contexts are passed on.
_CHUNK = 64
#: Characters of the texts that are hashed together, at most, unless one is longer.
_TOGETHER = 2_000_000

_rng = np.random.default_rng(11)
_PLACE = np.argsort(_rng.random((BUCKETS, WIDTH)), axis=1)[:, :ENTRIES].astype(np.int64)
_SIGN = np.where(_rng.random((BUCKETS, ENTRIES)) < 0.5, -1.0, 1.0)


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to] or "") <= _TOGETHER):
            n += len(texts[to] or "")
            to += 1
        yield texts[at:to]
        at = to


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    h, text = token_hashes(texts)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64), text


def context_pairs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word with each word up to WINDOW places before or after it in the same text."""
    left, right = [], []
    for d in range(1, min(WINDOW, len(words) - 1) + 1):
        near = text[:-d] == text[d:]
        left.append(words[:-d][near])
        right.append(words[d:][near])
    none = [np.zeros(0, words.dtype)]
    return np.concatenate([*left, *right, *none]), np.concatenate([*right, *left, *none])


def context_sums(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each word bucket, the sum of the index vectors of the words around it, and its count, over all rows.

    Each task adds up its rows in one table of BUCKETS x WIDTH numbers and hands it on in chunks; a chunk's sums are added
    up as they stream by. The driver gets one such table, whatever the size of the corpus.
    """
    size = WIDTH + 1

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS)
        for part in parts:
            for some in groups(list(part.iloc[:, 0])):
                b, text = words(some)
                count += np.bincount(b, minlength=BUCKETS)
                own, other = context_pairs(b, text)
                # one weighted count adds up all entries of the index vectors
                at = (own[:, None] * WIDTH + _PLACE[other]).ravel()
                total += np.bincount(at, _SIGN[other].ravel(), minlength=BUCKETS * WIDTH)
        if count.any():
            both = np.concatenate([total.reshape(BUCKETS, WIDTH), count[:, None]], axis=1)
            yield pd.DataFrame({"chunk": range(BUCKETS // _CHUNK), "sums": [both[i : i + _CHUNK].astype(np.float32).tobytes() for i in range(0, BUCKETS, _CHUNK)]})

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for chunk, data in zip(part["chunk"], part["sums"], strict=True):
                own = sums.setdefault(int(chunk), np.zeros(_CHUNK * size))
                own += np.frombuffer(data, np.float32)
        yield pd.DataFrame({"chunk": list(sums), "sums": [x.tobytes() for x in sums.values()]})

    schema = "chunk int, sums binary"
    rows = texts.mapInPandas(summed, schema).repartition(64, "chunk").mapInPandas(added, schema).toPandas()
    out = np.zeros((BUCKETS, size))
    for chunk, data in zip(rows["chunk"], rows["sums"], strict=True):
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(data, np.float64).reshape(_CHUNK, size)
    return out[:, :WIDTH], out[:, WIDTH]


@dataclass
class Vectors:
    """Unit context vectors of the word buckets, and a weight of each that falls with its frequency."""

    unit: np.ndarray
    weight: np.ndarray


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> Vectors:
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    weight = 1e-2 / (1e-2 + counts / max(counts.sum(), 1.0))
    return Vectors((sums / np.maximum(length, 1e-9)).astype(np.float32), weight.astype(np.float32))


def pooled(texts: list[str | None], vectors: Vectors) -> np.ndarray:
    """A row for each text: the weighted mean of its words' vectors, how alike adjoining words' vectors are on the mean, how many agree, and the logarithm of its length.

    Repeated words agree in full and other neighbours hardly do. An empty text has zeros.
    """
    out = np.zeros((len(texts), WIDTH + 3), np.float32)
    at = 0
    for some in groups(texts):
        b, text = words(some)
        n = np.bincount(text, minlength=len(some)).astype(np.float32)
        if len(b):
            has = np.flatnonzero(n)
            starts = np.searchsorted(text, has)
            u = vectors.unit[b]
            alike = np.zeros(len(b), np.float32)
            alike[1:] = np.einsum("ij,ij->i", u[1:], u[:-1]) * (text[1:] == text[:-1])
            u *= vectors.weight[b][:, None]
            own = out[at : at + len(some)]
            own[has, :WIDTH] = np.add.reduceat(u, starts) / n[has, None]
            own[:, WIDTH] = np.bincount(text, alike, minlength=len(some)) / np.maximum(n, 1)
            own[:, WIDTH + 1] = np.bincount(text, alike > 0.99, minlength=len(some)) / np.maximum(n, 1)
            own[:, WIDTH + 2] = np.log1p(n) / 8
        at += len(some)
    return out


@dataclass
class QualityModel:
    vectors: Vectors
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.spread @ w1 + b1, 0) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.logit(pooled(texts, self.vectors)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """Two layers by Adam on the weighted logistic loss."""
    rng = np.random.default_rng(2)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            k = order[i : i + 64]
            w1, b1, w2, b2 = layers
            h = np.maximum(x[k] @ w1 + b1, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[k]) * weight[k] / len(k)
            gh = g[:, None] * w2 * (h > 0)
            t += 1
            for j, grad in enumerate((x[k].T @ gh + decay * w1, gh.sum(0), h.T @ g + decay * w2, g.sum())):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                layers[j] = layers[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    if not len(z):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 120))
    loss = lambda t: float((weight * np.logaddexp(0, np.where(y > 0, -z, z) / t)).sum())
    return float(min(grid, key=loss))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Word vectors come from all texts; labels from rows outside the held-out fold (crc32 of doc_id modulo 5 is 0) with a quality of 0 or 1.

    The network is fitted to about rows_per_class rows of each class, by a hash of doc_id, weighed to the classes' true
    shares; one in five is kept for the temperature. Without labels of both classes, the score is the share of label 1, 0.5 for none.
    """
    vectors = word_vectors(*context_sums(docs.select("text")))
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return QualityModel(vectors, np.zeros(1), np.ones(1), [], 1.0, float(next(iter(shares), 0.5)))
    sample = bounded_sample(known, F.col("doc_id"), F.col("quality"), rows_per_class)

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = pooled(list(part["text"]), vectors)
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "x": [r.tobytes() for r in x]})

    # the sample is bounded, so it can go to all tasks
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInPandas(featured, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "quality", "x"], ignore_index=True)
    if got["quality"].nunique() < 2:
        return QualityModel(vectors, np.zeros(1), np.ones(1), [], 1.0, shares[1] / sum(shares.values()))
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]], np.float64)
    y = got["quality"].to_numpy(np.float64)
    weight = np.where(y > 0, shares[1] / max(y.sum(), 1), shares[0] / max((1 - y).sum(), 1)) * len(y) / sum(shares.values())
    mean, spread = x.mean(0), x.std(0) + 1e-3
    kept = np.random.default_rng(3).permutation(len(y))
    fitted, rest = kept[: len(y) * 4 // 5], kept[len(y) * 4 // 5 :]
    layers = fit_network((x[fitted] - mean) / spread, y[fitted], weight[fitted])
    model = QualityModel(vectors, mean, spread, layers, 1.0)
    model.temperature = fit_temperature(model.logit(x[rest]), y[rest], weight[rest])
    return model


def score_column(text: Column, model: QualityModel) -> Column:
    """The calibrated probability of label 1, for empty and null texts too. The model (4 MB) goes with the tasks."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(list(part)), dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. An empty table gives an empty result; repeated rows repeat.

    Null and empty texts have the score of a text without words. A row whose doc_id is null is not held out. Of texts that
    score alike, nothing depends on the order. Only doc_id and text are read, whatever else the table's columns are called.
    """
    model = model or train(docs, labels)
    out = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
