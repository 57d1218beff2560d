"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, remainder

#: Hash buckets of n-grams.
BITS = 15
BUCKETS = 1 << BITS
#: Labelled rows that a language contributes to the fit, about; counts of n-grams come from all of them.
ROWS_PER_LANGUAGE = 1000
UNKNOWN = "und"
#: Code points hashed at a time, so that a very long text needs no more memory than this.
_STRETCH = 1 << 20
_BLANK = 32
#: Whether a code point is a letter.
_LETTER = np.array([chr(i).isalpha() for i in range(0x11_0000)], bool)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-case text, other signs than letters being blanks; None if it has no letter."""
    out, some = np.zeros(BUCKETS, np.float64), False
    text = text or ""
    tail = np.array([_BLANK, _BLANK], np.uint32)
    for at in range(0, len(text), _STRETCH):
        code = np.frombuffer(text[at : at + _STRETCH].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[code]
        some = some or bool(letter.any())
        code = np.where(letter, code, np.uint32(_BLANK))
        # runs of blanks count once, and there is a blank before the text
        keep = code != _BLANK
        keep[1:] |= code[:-1] != _BLANK
        keep[0] |= tail[-1] != _BLANK
        code = np.concatenate([tail, code[keep]])
        tail = code[-2:]
        # multilinear hashes, of which the upper bits are the bucket
        one = code[2:] * np.uint32(0x9E3779B1) + np.uint32(0x165667B1)
        two = one + code[1:-1] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
        three = two + code[:-2] * np.uint32(0xC2B2AE35) + np.uint32(0x2545F491)
        out += np.bincount((np.concatenate([one, two, three]) * np.uint32(0x846CA68B) >> np.uint32(32 - BITS)).astype(np.intp), minlength=BUCKETS)
    return out if some else None


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, and how many have any, over all rows: sums per task, added up by bucket; BUCKETS rows reach the driver."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for part in parts:
            for t in part.iloc[:, 0]:
                counts = ngram_counts(t)
                if counts is not None:
                    total[np.flatnonzero(counts)] += 1
                    total[-1] += 1
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": hit, "n": total[hit]})

    rows = texts.mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of unit length, with damped counts."""
    hit = np.flatnonzero(counts)
    value = np.log1p(counts[hit]) * idf[hit]
    return hit, value / max(float(np.sqrt(value @ value)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int = BUCKETS, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05
) -> np.ndarray:
    """Weights by follow-the-proximally-regularised-leader, one row at a time, with elastic-net penalties.

    Each coordinate keeps the sum z of its adjusted gradients and n of their squares; its weight is the minimiser of the
    linearised loss so far plus l1 |w| + l2 w^2 / 2 and the proximal terms, which is 0 while |z| is within l1.
    """
    z, n = np.zeros((buckets, classes)), np.zeros((buckets, classes))
    order = np.random.default_rng(5)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            hit, value, label = rows[i]
            zi, ni = z[hit], n[hit]
            w = weights(zi, ni)
            p = softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[hit] = zi + g - sigma * w
            n[hit] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives the least loss on rows that the weights were not fitted to, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; UNKNOWN with 0 if the text is null or has no letter, or nothing was learned."""
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        hit, value = tf_idf(counts, self.idf)
        p = softmax(value @ self.weights[hit] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from text and lang of the rows outside the held-out fold (crc32 of doc_id modulo 4 is 2) whose lang is not null.

    n-gram document frequencies are counted over all of these rows. The weights are fitted to about rows_per_language rows
    of each language, chosen by a hash of doc_id; of them, one in five is kept for the temperature. Languages are few, so
    the sample is bounded, and rows reach the driver as at most BUCKETS buckets with counts. Rows without letters are left out.
    """
    rows = docs.where("lang is not null").where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    frequency, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for key, text, lang in zip(part["doc_id"], part["text"], part["lang"], strict=True):
                counts = ngram_counts(text)
                if counts is not None:
                    hit = np.flatnonzero(counts)
                    made.append((key, lang, hit.astype(np.int32).tobytes(), counts[hit].astype(np.float32).tobytes()))
            yield pd.DataFrame(made, columns=["doc_id", "lang", "hit", "n"])

    sample = bounded_sample(rows, F.col("doc_id"), F.col("lang"), rows_per_language)
    got = sample.mapInPandas(featured, "doc_id long, lang string, hit binary, n binary").toPandas()
    got = got.sort_values(["doc_id", "lang", "hit"], ignore_index=True)
    languages = sorted(got["lang"].unique())
    at = {x: i for i, x in enumerate(languages)}
    made = []
    for lang, hit, count in zip(got["lang"], got["hit"], got["n"], strict=True):
        counts = np.zeros(BUCKETS)
        counts[np.frombuffer(hit, np.int32)] = np.frombuffer(count, np.float32)
        made.append((*tf_idf(counts, idf), at[lang]))
    if not made:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    kept = np.random.default_rng(3).permutation(len(made))
    fitted, rest = kept[: max(1, len(made) * 4 // 5)], kept[max(1, len(made) * 4 // 5) :]
    weights = ftrl([made[i] for i in fitted], len(languages))
    logits = np.array([made[i][1] @ weights[made[i][0]] for i in rest]).reshape(len(rest), len(languages))
    return LanguageModel(languages, idf, weights.astype(np.float32), temperature(logits, np.array([made[i][2] for i in rest], int)))


def language_column(text: Column, model: LanguageModel) -> Column:
    """struct<lang, score> of each text. The model (about a MB) goes with the tasks."""

    @F.pandas_udf("lang string, score double")
    def named(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang", "score"])

    return named(text)


def identify_documents(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. An empty table gives an empty result; repeated rows repeat.

    A text that is null or has no letter is `und` with a score of 0. A row whose doc_id is null is not held out. Of equally
    likely languages, the first by name is given. Texts are read in stretches, so one of any length needs little memory.
    """
    model = model or train(docs)
    out = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), language_column(F.col("text"), model).alias("__l"))
    return out.select("doc_id", "held_out", F.col("__l.lang").alias("lang_pred"), F.col("__l.score").alias("score"))
