"""Toxicity by non-negative positive-unlabelled learning (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many confirmed and unlabelled documents are gathered to fit the classifier: those with the least key hashes.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 9000
#: Words that the classifier sees: those whose document rates differ most clearly between the two samples.
MOST_WORDS, CLEAR = 600, 4.0
FOLDS, HELD_OUT = 5, 0
STEPS, RATE, L2, SEED = 400, 0.1, 1e-4, 3
#: Everything in a text but letters and digits of ASCII, and what lies above ASCII, parts words.
APART = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()} | dict.fromkeys("“”‘’«»…—–¿¡", " "))


def fold(key: Column) -> Column:
    """Fold of a row: crc32 of its key as text, mod FOLDS. Null keys belong to fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(0))


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text."""
    return set(text.lower().translate(APART).split()) if text else set()


@dataclass(frozen=True)
class Classifier:
    """A linear classifier on the presence of words."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[w] for w in words(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk of logistic loss and its derivatives by the outputs (Kiryo et al., 2017).

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second part is negative it is stepped back on instead."""
    soft = lambda x: np.logaddexp(0, x)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    plus, minus, unl = soft(-z_p).mean(), soft(z_p).mean(), soft(z_u).mean()
    negative = unl - prior * minus
    if negative >= 0:
        return prior * plus + negative, (prior * -sig(-z_p) - prior * sig(z_p)) / len(z_p), sig(z_u) / len(z_u)
    return prior * plus, prior * sig(z_p) / len(z_p), -sig(z_u) / len(z_u)


class Vocabulary(dict):
    """Numbers of words in the order in which they are met; texts are kept as arrays of them."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def encode(self, found: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint32)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], vocabulary: Vocabulary, prior: float, most_words: int = MOST_WORDS, clear: float = CLEAR) -> Classifier:
    """Fit on samples of texts, each an array of its distinct words. Without positives, or without clear words, every score
    is the prior.

    Words enter by the z-value of the difference of document rates; ties go by the word. Adam on the whole sample.
    """
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return Classifier({}, base)
    n, m, size = len(positive), len(unlabelled), len(vocabulary)
    in_p, in_u = (np.bincount(np.concatenate(d), minlength=size) if size else np.zeros(0) for d in (positive, unlabelled))
    both = (in_p + in_u) / (n + m)
    z = (in_p / n - in_u / m) / np.maximum(np.sqrt(both * (1 - both) * (1 / n + 1 / m)), 1e-9)
    names = list(vocabulary)
    able = np.flatnonzero((in_p + in_u >= 5) & (np.abs(z) >= clear)).tolist()
    chosen = [i for _, _, i in sorted((-abs(z[i]), names[i], i) for i in able)[:most_words]]
    if not chosen:
        return Classifier({}, base)
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(docs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(docs), len(chosen)), dtype=np.float32)
        for i, d in enumerate(docs):
            at = place[d]
            x[i, at[at >= 0]] = 1
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(chosen)), base
    g1, g2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        _, dp, du = risk(xp @ w + b, xu @ w + b, prior)
        g = np.append(xp.T @ dp + xu.T @ du + L2 * w, dp.sum() + du.sum())
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        move = RATE * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier({names[c]: float(x) for c, x in zip(chosen, w, strict=True)}, float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Classifier:
    """Train on the rows outside the held-out fold: confirmed toxic texts against unlabelled ones.

    The class prior is the toxic share of all labels outside the fold. Both samples are the rows with the least key hashes,
    at most ``most_positive`` and ``most_unlabelled``; their word sets, not their texts, come to the driver. Unlabelled
    are rows of ``docs`` whatever their label; a key counts once, however many rows have it. Null keys, null labels and labels without a document take no part.
    """
    open_ = labels.where((fold(F.col(key)) != HELD_OUT) & F.col("toxic").isNotNull() & F.col(key).isNotNull())
    n, toxic = open_.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(0.9, max(toxic / n if n else 0.0, 1e-3))
    pick = lambda df, most, kind: df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("_key"), F.lit(kind).alias("_positive"))
    rest = docs.where((fold(F.col(key)) != HELD_OUT) & F.col(key).isNotNull())
    chosen = pick(open_.where("toxic = 1").join(rest.select(key), key, "left_semi"), most_positive, True).unionByName(pick(rest, most_unlabelled, False))
    texts = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_key"))  # bounded by the sample's size
    # of rows that share a key the one with the least hash stands for all, so the samples' bounds hold for rows as well
    texts = texts.groupBy("_key", "_positive").agg(F.min_by(F.struct(F.col(text).alias("_text")), F.xxhash64(text)).alias("_t")).select("_positive", F.col("_t._text").alias(text))

    def to_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"positive": b["_positive"], "words": [" ".join(sorted(words(t))) for t in b[text]]})

    got: dict[bool, list[np.ndarray]] = {True: [], False: []}
    vocabulary = Vocabulary()
    for r in texts.mapInPandas(to_words, "positive boolean, words string").toLocalIterator():
        got[r.positive].append(vocabulary.encode(r.words.split()))
    return fit(got[True], got[False], vocabulary, prior)


def score(text: Column, model: Classifier) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts get the score of no words."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """Score every row: its columns, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Whole texts are scored; labels, keys and other columns are no inputs of a score. Equal texts get equal scores. An empty
    table gives an empty result. Input columns named like an output give way to it.
    """
    model = train(docs, labels, key, text, **bounds)
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*own, (fold(F.col(key)) == HELD_OUT).alias("held_out"), score(F.col(text), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
