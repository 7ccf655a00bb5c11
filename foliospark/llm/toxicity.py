"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over presence features of a text (words and word beginnings) is trained with numpy from confirmed toxic
examples and unlabelled text. With class prior p and logistic loss l the risk is

    p * mean_P l(+g) + max(0, mean_U l(-g) - p * mean_P l(-g))

The second part estimates the risk on clean text; when it falls below zero in a batch, the step goes against it instead,
so that the classifier does not learn to reject unlabelled texts that are toxic.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import durable

from .common import fold_of, lowest_keys, with_text_columns

_WORDS = re.compile(r"[^\W\d_]+")
MEMO = 300_000


def word_features(word: str) -> list[str]:
    """The word itself and its first four and five letters."""
    return [word, *(f"{word[:n]}+" for n in (4, 5) if len(word) >= n)]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORDS.findall(text.lower())) for f in word_features(w)}


@dataclass
class Model:
    """Weights of a bounded vocabulary; a text's score is the logistic function of bias plus weights of its features."""

    weights: dict[str, float]
    bias: float
    prior: float

    def scorer(self):
        """Function from texts to scores; remembers the weights of words."""
        names = list(self.weights)
        values = np.array([self.weights[n] for n in names] + [0.0])
        ids = {n: i for i, n in enumerate(names)}

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                found = (ids.get(f) for w in _WORDS.findall(piece) for f in word_features(w))
                made = tuple(i for i in found if i is not None)
                if len(self) < MEMO:
                    self[piece] = made
                return made

        look = Pieces().__getitem__
        bias = self.bias

        def score(texts: list[str]) -> list[float]:
            sums = [values[list(set(itertools.chain.from_iterable(map(look, t.lower().split()))))].sum() if t else 0.0 for t in texts]
            return (1 / (1 + np.exp(-np.clip(bias + np.array(sums), -60, 60)))).tolist()

        return score


Part = tuple[np.ndarray, np.ndarray, int]


def _gathered(rows: list[np.ndarray]) -> Part:
    """Feature lists as flat indices: row of each feature, features, number of rows."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), [len(p) for p in rows]), flat.astype(np.int64), len(rows)


def _values(w: np.ndarray, part: Part) -> np.ndarray:
    own, flat, n = part
    return np.bincount(own, w[flat], n) + w[-1]


def _push(part: Part, slope: np.ndarray, to: np.ndarray) -> None:
    own, flat, _ = part
    to[:-1] += np.bincount(flat, slope[own], len(to) - 1)
    to[-1] += slope.sum()


def clean_risk(w: np.ndarray, positive: Part, unlabelled: Part, prior: float) -> float:
    """Estimated risk on clean text: that of unlabelled text as clean, less the toxic share's."""
    return float(np.logaddexp(0, _values(w, unlabelled)).mean() - prior * np.logaddexp(0, _values(w, positive)).mean())


def toxic_risk(w: np.ndarray, positive: Part, prior: float) -> float:
    """Risk on confirmed toxic text, by its share."""
    return float(prior * np.logaddexp(0, -_values(w, positive)).mean())


def direction(w: np.ndarray, positive: Part, unlabelled: Part, prior: float, beta: float = 0.0) -> np.ndarray:
    """Gradient of the sum of both risks; that of minus the clean risk alone where this one is below minus ``beta``."""
    sp, su = (1 / (1 + np.exp(-np.clip(_values(w, part), -60, 60))) for part in (positive, unlabelled))
    grad = np.zeros_like(w)
    sign = 1.0 if clean_risk(w, positive, unlabelled, prior) >= -beta else -1.0
    if sign > 0:
        _push(positive, prior * (sp - 1) / positive[2], grad)  # toxic examples should score high
    _push(unlabelled, sign * su / unlabelled[2], grad)  # unlabelled ones low
    _push(positive, -sign * prior * sp / positive[2], grad)  # but for the share of them that is toxic
    return grad


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, epochs: int = 40, batches: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 3
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over mini-batches of feature index lists."""
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)  # the last one is the bias
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        p_deal, u_deal = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_rows, u_rows in zip(np.array_split(p_deal, batches), np.array_split(u_deal, batches), strict=True):
            if not len(p_rows) or not len(u_rows):
                continue
            grad = direction(w, _gathered([positive[i] for i in p_rows]), _gathered([unlabelled[i] for i in u_rows]), prior)
            grad[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0,
    most_positive: int = 4000, most_unlabelled: int = 12000, vocabulary: int = 20000, least: int = 3, significance: float = 4.0,
    **training,
) -> Model:
    """Model from the rows outside fold ``held``.

    At most ``most_positive`` confirmed toxic texts and ``most_unlabelled`` texts of any kind are used, taken by a hash of
    the key from all rows. The class prior is the share of toxic rows among all labelled rows of the training folds. The
    vocabulary has at most ``vocabulary`` features that occur in ``least`` toxic examples or more and whose share there is
    ``significance`` standard deviations or more from their share among unlabelled ones, the most significant first. Rows with a null key, label or text teach nothing.
    ``training`` goes to ``train``. Without a toxic example the model scores every text 0.
    """
    train_fold = fold_of(F.col(key), folds) != held
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isNotNull() & train_fold)
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p")).first()
    if not total["p"]:
        return Model({}, -60.0, 0.0)
    prior = total["p"] / total["n"]
    toxic = lowest_keys(known.where("y = 1"), key, most_positive, total["p"]).withColumn("__toxic", F.lit(True))
    others = lowest_keys(docs.where(train_fold), key, most_unlabelled, docs.count()).withColumn("__any", F.lit(True))
    chosen = durable(toxic.join(others, key, "full"))  # at most most_positive + most_unlabelled keys
    rows = docs.select(F.col(key), F.col(text).alias("__text")).where(F.col("__text").isNotNull()).join(F.broadcast(chosen), key)

    def words(texts: list[str]):
        return [[" ".join(sorted(text_features(t))) for t in texts]]

    made = durable(with_text_columns(rows, "__text", {"__features": "string"}, lambda: words).select("__toxic", "__any", F.split("__features", " ").alias("__features")))
    sizes = made.agg(F.count("__toxic").alias("p"), F.count("__any").alias("u")).first()
    if not sizes["p"] or not sizes["u"]:
        return Model({}, -60.0, prior)
    counts = made.select("__toxic", "__any", F.explode("__features").alias("f")).where("f <> ''").groupBy("f").agg(F.count("__toxic").alias("p"), F.count("__any").alias("u"))
    n_p, n_u = float(sizes["p"]), float(sizes["u"])
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    deviation = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    marked = counts.where(F.col("p") >= least).withColumn("z", F.abs(F.try_divide(F.col("p") / n_p - F.col("u") / n_u, deviation)))
    names = [r["f"] for r in marked.where(F.col("z") >= significance).orderBy(F.desc("z"), "f").limit(vocabulary).collect()]
    ids = {name: i for i, name in enumerate(names)}  # at most ``vocabulary`` names

    def numbers(texts: list[str]):
        return [[sorted(ids[f] for f in t.split(" ") if f in ids) for t in texts]]

    lists = with_text_columns(made.withColumn("__features", F.array_join("__features", " ")), "__features", {"at": "array<bigint>"}, lambda: numbers).select("__toxic", "__any", "at").collect()  # bounded by the sample
    # Sorted, so that the order in which tasks end does not change the model.
    positive = [np.array(x, np.int32) for x in sorted(r["at"] for r in lists if r["__toxic"])]
    unlabelled = [np.array(x, np.int32) for x in sorted(r["at"] for r in lists if r["__any"])]
    w, bias = train(positive, unlabelled, len(names), prior, **training)
    return Model(dict(zip(names, w.tolist(), strict=True)), bias, prior)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the model's score (0 to 1) of each whole text; null and empty texts have the score of no feature."""

    def make():
        one = model.scorer()
        return lambda texts: [one(texts)]

    return with_text_columns(df, text, {name: "double"}, make)
