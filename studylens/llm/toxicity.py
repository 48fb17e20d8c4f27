"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other texts count as unlabelled: some of them are
toxic too, in the proportion of the class prior. Numpy classifiers minimise the non-negative risk
estimate  prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])  with the logistic loss,
by full-batch Adam on hashed features: words and their beginnings, so that inflected or
compounded forms share a stem. Each classifier sees all positives of the sample and its own share of
the unlabelled texts, in a task of its own; a score is the mean of their probabilities.

Only the fit uses a sample, of at most about ``MAX_POSITIVE`` + ``MAX_UNLABELLED`` distinct texts drawn
by hash; every whole text is scored. The model holds at most ``MAX_FEATURES`` weights for each classifier.

Defined cases: a null text is an empty one, scored by the intercepts; repeated rows are scored each and
count once in the fit; without positives or unlabelled texts the score is the prior (0 if there are no
labels); a null label is no label; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .textbytes import LOWER, as_bytes, prefix_hash, runs, slices, span_hash

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
MAX_FEATURES = 8_192
CLASSIFIERS = 4
BITS = 20
HEADS = (4, 5, 6)  # bytes of a word's beginning that make a feature
LEAST = 4  # positives that must hold a feature
LIFT = 0.4  # of the greatest lift possible, 1 / prior
SURPRISE = 10.0  # Poisson log-likelihood ratio against a feature that tells nothing
ROUNDS, RATE, DECAY = 400, 0.05, 2e-4

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every word and word beginning; repeated ones are repeated."""
    data = LOWER[data]
    starts, ends, doc = runs(_WORD[data], offsets)
    sums = prefix_hash(data)
    shift = np.uint64(64 - BITS)
    found = [span_hash(sums, starts, ends)]
    docs = [doc]
    for head in HEADS:
        at = np.flatnonzero(ends - starts > head)
        found.append(span_hash(sums, starts[at], starts[at] + head) + np.uint64(head))
        docs.append(doc[at])
    return (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(docs)


def risk_gradient(
    weights: np.ndarray, positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float
) -> tuple[float, np.ndarray]:
    """Non-negative risk and the gradient to follow; a set is (row, feature, rows), the last weight is the intercept."""

    def outputs(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=weights[columns], minlength=n) + weights[-1]

    def back(rows: np.ndarray, columns: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(columns, weights=slope[rows], minlength=len(weights))
        g[-1] += slope.sum()
        return g

    f_pos, f_unl = outputs(*positive), outputs(*unlabelled)
    s_pos, s_unl = 1 / (1 + np.exp(-f_pos)), 1 / (1 + np.exp(-f_unl))
    as_positive = np.logaddexp(0, -f_pos).mean()
    negative = np.logaddexp(0, f_unl).mean() - prior * np.logaddexp(0, f_pos).mean()
    g_positive = back(positive[0], positive[1], (s_pos - 1) / len(s_pos))
    g_negative = back(unlabelled[0], unlabelled[1], s_unl / len(s_unl)) - prior * back(positive[0], positive[1], s_pos / len(s_pos))
    if negative >= 0:
        return prior * as_positive + negative, prior * g_positive + g_negative
    return prior * as_positive, -g_negative  # step back until the estimate is no longer negative


def fit(positive: tuple, unlabelled: tuple, width: int, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the features and the intercept."""
    w = np.zeros(width + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, g = risk_gradient(w, positive, unlabelled, prior)
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Scorer:
    """Trained classifiers over a small table of features."""

    def __init__(self, selected: np.ndarray, weights: np.ndarray, intercepts: np.ndarray):
        self.selected, self.weights, self.intercepts = selected, weights, intercepts  # (features, classifiers)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.tile(self.intercepts, (n, 1))
        if len(self.selected):
            place = np.full(1 << BITS, -1, np.int32)
            place[self.selected] = np.arange(len(self.selected))
            feature, doc = features(data, offsets)
            column = place[feature]
            hit = column >= 0
            pairs = np.unique(doc[hit] * len(self.selected) + column[hit])
            doc, column = np.divmod(pairs, len(self.selected))
            for i in range(total.shape[1]):
                total[:, i] += np.bincount(doc, weights=self.weights[column, i], minlength=n)
        return (1 / (1 + np.exp(-total))).mean(axis=1)


def _feature_rows(table: DataFrame, columns: str, names: list[str]) -> DataFrame:
    """Adds ``feats``, the distinct features of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                feature, doc = features(*as_bytes(part.column("text")))
                doc, feature = np.divmod(np.unique(doc << BITS | feature), 1 << BITS)
                at = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                feats = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [feats], names=[*names, "feats"])

    return table.mapInArrow(run, f"{columns}, feats array<int>")


def train(
    labelled: DataFrame,
    label: str,
    text: str,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    classifiers: int = CLASSIFIERS,
) -> Scorer:
    """From texts whose ``label`` is 1 (confirmed), 0 or null; only the 1s count as labels in the risk.

    The class prior is the share of 1s among the labels there are.
    """
    rows = labelled.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{label}`").alias("y"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n, known, ones = rows.agg(F.count(F.lit(1)), F.count("y"), F.sum((F.col("y") == 1).cast("int"))).first()
    ones = ones or 0
    prior = ones / known if known else 0.0
    if not 0 < ones < n or not 0 < prior < 1:
        logit = -40.0 if prior <= 0 else 40.0 if prior >= 1 else math.log(prior / (1 - prior))
        return Scorer(np.zeros(0, np.int64), np.zeros((0, 1)), np.array([logit]))

    def drawn(most: int, there: int) -> Column:
        return F.pmod(F.col("h"), F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * most / there)))

    # The two sets overlap, as they must: unlabelled texts come from the whole population.
    sample = (
        rows.filter((F.col("y") == 1) & drawn(max_positive, ones))
        .select("text", "h", F.lit(1).alias("pos"))
        .unionByName(rows.filter(drawn(max_unlabelled, n)).select("text", "h", F.lit(0).alias("pos")))
    )
    sample = sample.dropDuplicates(["h", "pos"]).select("text", "pos", F.pmod(F.shiftright("h", 40), F.lit(classifiers)).cast("int").alias("part"))
    sample = materialize(_feature_rows(sample, "pos int, part int", ["pos", "part"]), "toxicity-sample")
    n_pos, n_unl = sample.agg(F.sum("pos"), F.sum(1 - F.col("pos"))).first()
    counts = sample.select("pos", F.explode("feats").alias("f")).groupBy("f").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("u"))
    expected = F.lit(n_pos / n_unl) * (F.col("u") + 1)
    surprise = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
    chosen = counts.filter((F.col("p") >= LEAST) & (F.col("p") >= expected * LIFT / prior) & (surprise >= SURPRISE)).orderBy(F.desc("p"), "f").limit(MAX_FEATURES)
    selected = np.array(sorted(r["f"] for r in chosen.select("f").collect()), np.int64)
    width = len(selected)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = batch.column("feats")
            flat, at = feats.values.to_numpy(), feats.offsets.to_numpy()
            column = np.searchsorted(selected, flat)
            hit = selected[np.minimum(column, width - 1)] == flat
            ends = np.concatenate([[0], np.cumsum(hit)])[at].astype(np.int32)
            chosen = pa.ListArray.from_arrays(pa.array(ends), pa.array(column[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), chosen], names=["pos", "part", "feats"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        sets = []
        for value in (1, 0):
            own = group[group["pos"] == value]["feats"].to_numpy()
            rows = np.repeat(np.arange(len(own)), [len(f) for f in own])
            sets.append((rows, np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64), len(own)))
        usable = bool(sets[0][2] and sets[1][2])
        w = fit(*sets, width, prior) if usable else np.zeros(width + 1)
        return pd.DataFrame({"part": group["part"].iloc[:1], "weights": [w], "used": [usable]})

    learned = []
    if width:
        # Only the chosen features travel on; the positives go to every classifier.
        small = sample.select("pos", "part", "feats").mapInArrow(narrow, "pos int, part int, feats array<int>")
        to = F.when(F.col("pos") == 1, F.sequence(F.lit(0), F.lit(classifiers - 1))).otherwise(F.array("part"))
        groups = small.select("pos", "feats", F.explode(to).alias("part")).groupBy("part")
        learned = groups.applyInPandas(learn, "part int, weights array<double>, used boolean").filter("used").orderBy("part").collect()
    if not learned:
        return Scorer(np.zeros(0, np.int64), np.zeros((0, 1)), np.array([math.log(prior / (1 - prior))]))
    weights = np.array([r["weights"] for r in learned]).T
    return Scorer(selected, weights[:-1], weights[-1])


def score(table: DataFrame, key: str, text: str, scorer: Scorer) -> DataFrame:
    """(key, score) of every row."""
    kind = table.schema[key].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast(scorer)  # at most MAX_FEATURES x classifiers weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = shared.value.scores(*as_bytes(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found)], names=[key, "score"])

    return table.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, score double")
