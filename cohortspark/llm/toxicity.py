"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are used: what a label calls harmless is treated as unlabelled. With
the class prior p, the risk of a classifier f is

    p E[loss(f) | toxic]  +  max(0, E[loss(-f) | unlabelled] - p E[loss(-f) | toxic])

where the second term estimates the risk on harmless text. A flexible model could push it below zero by fitting the
toxic documents inside the unlabelled ones; in a step where it is negative the gradient of that term is taken with the
opposite sign instead. Loss is logistic, so 1 / (1 + exp(-f)) estimates the probability of being toxic.

Features of a text are its distinct words and the leading 4 to 8 bytes of each distinct word, hashed into 2^18 places;
a weight counts once for every distinct word that has the feature, and the sum is scaled by the root of their number.
Only features whose rates in toxic and unlabelled samples differ beyond chance get a weight.
Several classifiers are fitted, each in a task of its own on its own bounded sample (about ``POSITIVES``
toxic documents and ``UNLABELLED`` of any kind, ``SAMPLE_CHARS`` characters of each at most, from a place inside it), and
their outputs are averaged. Scoring covers whole texts of all rows; the weights that are broadcast take three megabytes.

Defined results: null and empty texts get the score of a text without features, the smaller of the prior and its own
estimate; without any toxic example every score is the prior, 0 if nothing is known. Labels other than 1 count as
unlabelled; ids that repeat in the labels count as toxic if any row says so. Repeated documents get equal scores.
Columns besides the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm import words as W

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
MODELS = 3
POSITIVES, UNLABELLED = 2000, 6000  # expected, for each model
SPARE = 2  # times that at most, where ids or rows repeat
SAMPLE_CHARS = 4000
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.15, 2e-5
DEVIATIONS = 4.0  # a feature is used if its rates in toxic and unlabelled samples differ by so many


def features(found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place) of every feature of every distinct word, and the number of distinct words of each text."""
    n_texts = len(found.text_start) - 1
    if len(found) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(n_texts, dtype=np.int64)
    text_of = found.text_of()
    h = found.hashes()
    firsts = []
    for a, b in zip(found.text_start[:-1].tolist(), found.text_start[1:].tolist(), strict=True):
        firsts.append(a + np.unique(h[a:b], return_index=True)[1])
    one = np.concatenate(firsts)
    sub = W.Words(found.low, found.starts[one], found.ends[one], found.text_start, found.sums)
    shift = np.uint64(64 - BITS)
    owner = text_of[one]
    texts, places = [owner], [(h[one] >> shift).astype(np.int64)]
    for k in PREFIXES:
        texts.append(owner)
        # The length takes part, so a whole word and the same bytes as a prefix are different features.
        places.append((W.mix(sub.hashes(k) + np.uint64(k)) >> shift).astype(np.int64))
    return np.concatenate(texts), np.concatenate(places), np.bincount(owner, minlength=n_texts)


def scale(distinct: np.ndarray) -> np.ndarray:
    return 3.0 / np.sqrt(10.0 + distinct)


def _sums(weights: np.ndarray, texts: np.ndarray, places: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    return np.bincount(texts, weights=weights[places], minlength=len(distinct)) * scale(distinct)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray  # models x places
    bias: np.ndarray
    prior: float

    def score(self, found: W.Words) -> np.ndarray:
        texts, places, distinct = features(found)
        out = np.zeros(len(distinct))
        for w, b in zip(self.weights, self.bias, strict=True):
            out += _sigmoid(_sums(w, texts, places, distinct) + b)
        out = out / max(len(self.bias), 1) if len(self.bias) else np.full(len(distinct), self.prior)
        return np.where(distinct == 0, np.minimum(out, self.prior), out)


def nnpu_gradient(f: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the corrected risk with respect to the outputs ``f`` of one batch."""
    s = _sigmoid(f)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    rest = np.log1p(np.exp(np.clip(f, -40, 40)))  # loss(-f)
    harmless = rest[~positive].sum() / n_u - prior * rest[positive].sum() / n_p
    grad = np.where(positive, prior * (s - 1) / n_p, 0.0)
    of_rest = np.where(positive, -prior * s / n_p, s / n_u)
    return grad + of_rest if harmless >= 0 else -of_rest


def telling_features(places: np.ndarray, begin: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Flags of the features whose share of toxic texts differs from that of unlabelled ones beyond chance."""
    rates = []
    for kind in (positive, ~positive):
        have = np.zeros(1 << BITS)
        for t in np.flatnonzero(kind).tolist():
            have[np.unique(places[begin[t] : begin[t + 1]])] += 1
        rates.append(have)
    n_p, n_u = positive.sum(), (~positive).sum()
    both = (rates[0] + rates[1]) / (n_p + n_u)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    return np.abs(rates[0] / n_p - rates[1] / n_u) >= DEVIATIONS * spread


def train(texts: list[str | None], positive: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier; every batch has both kinds, steps are scaled by past gradients."""
    rng = np.random.default_rng(seed)
    parts, counts, kinds = [], [], []
    for _, _, raw, offsets in W.chunks(pa.array(texts, type=pa.large_string())):
        text_of, at, n = features(W.split(raw, offsets))
        parts.append(at[np.argsort(text_of, kind="stable")].astype(np.int32))
        counts.append(np.bincount(text_of, minlength=len(n)))
        kinds.append(n)
    places, distinct = np.concatenate(parts), np.concatenate(kinds)
    begin = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    telling = telling_features(places, begin, positive)
    begin = np.concatenate([[0], np.cumsum(telling[places])])[begin]
    places = places[telling[places]]
    factor = scale(distinct)
    w, past = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    bias, bias_past = float(np.log(prior / (1 - prior))), 1e-8
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    steps = max(1, -(-len(texts) // BATCH))
    for _ in range(EPOCHS):
        pos, unl = rng.permutation(pos), rng.permutation(unl)
        for p, u in zip(np.array_split(pos, steps), np.array_split(unl, steps), strict=True):
            rows = np.concatenate([p if len(p) else rng.choice(pos, 1), u])
            sizes = begin[rows + 1] - begin[rows]
            ends = np.cumsum(sizes)
            at = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(begin[rows], sizes)
            owner, cols = np.repeat(np.arange(len(rows)), sizes), places[at]
            f = np.bincount(owner, weights=w[cols], minlength=len(rows)) * factor[rows] + bias
            g = nnpu_gradient(f, positive[rows], prior)
            grad = np.bincount(cols, weights=(g * factor[rows])[owner], minlength=1 << BITS) + DECAY * w
            past += grad * grad
            w -= RATE * grad / np.sqrt(past)
            bias_past += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(bias_past)
    return w.astype(np.float32), bias


def fit(
    docs: DataFrame,
    labels: DataFrame,
    trainable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    prior: float | None = None,
) -> Model:
    """Models from the documents for which ``trainable`` (on ``doc_id``) holds.

    The class prior is an argument; by default it is the share of toxic rows among the labelled training rows.
    """
    marks = labels.where(trainable & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    marks = marks.agg(F.max((F.col(toxic) == 1).cast("int")).alias("_toxic"))
    known = marks.agg(F.count("*").alias("n"), F.sum("_toxic").alias("t")).first()
    n_toxic = int(known["t"] or 0)
    share = prior if prior is not None else n_toxic / known["n"] if known["n"] else 0.0
    if n_toxic == 0:
        return Model(np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros(0), share)
    share = min(max(share, 1e-3), 0.5)
    sample = draw(docs, marks, n_toxic, trainable, doc_id, text)

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("positive", "ascending")])
        flags = t["positive"].to_numpy().astype(bool)
        if not flags.any() or flags.all():
            return pa.table({"weights": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        w, bias = train(t["text"].to_pylist(), flags, share, seed=7)
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    got = sample.groupBy("model").applyInArrow(one, "weights binary, bias double").toArrow()
    got = got.sort_by([("bias", "ascending")])
    weights = [np.frombuffer(w, dtype=np.float32) for w in got["weights"].to_pylist()]
    return Model(np.array(weights, dtype=np.float32).reshape(-1, 1 << BITS), got["bias"].to_numpy().copy(), share)


def draw(docs: DataFrame, marks: DataFrame, n_toxic: int, trainable: Column, doc_id: str, text: str) -> DataFrame:
    """Bounded samples by hash, one for each model: model, positive, key, text.

    Unlabelled text is drawn from all training rows, toxic ones included. Null or repeated ids do not change the bounds.
    """
    rows = docs.where(trainable).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    n_docs = rows.count()

    def drawn(salt: str, want: int, n: int, key: list[str]) -> Column:
        share_of = int((1 << 30) * min(1.0, want / max(n, 1)))
        pick = lambda m: F.pmod(F.xxhash64(F.lit(salt), F.lit(m), *key), F.lit(1 << 30)) < share_of
        models = F.array(*[F.when(pick(m), F.lit(m)) for m in range(MODELS)])
        return F.explode(F.filter(models, lambda m: m.isNotNull())).alias("model")

    # About MODELS * POSITIVES ids at most, whatever the number of labels: broadcast, so that texts are not shuffled.
    chosen = marks.where("_toxic = 1").select("_id", drawn("toxic", POSITIVES, n_toxic, ["_id"]))
    positives = rows.join(F.broadcast(chosen), "_id")
    others = rows.select("*", drawn("any", UNLABELLED, n_docs, ["_id", "text"]))
    sample = positives.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    # Ids may repeat, so rows are bounded as well; the bound is reached by repeated ids and repeated rows alone.
    nth = F.row_number().over(Window.partitionBy("model").orderBy("key"))
    place = F.pmod(F.xxhash64("_id", "text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    sample = sample.select(
        "model",
        "positive",
        F.xxhash64("_id", "text").alias("key"),
        F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("text"),
    )
    first = lambda kind, most: sample.where(kind).withColumn("_nth", nth).where(F.col("_nth") <= most)
    return first("positive", SPARE * POSITIVES).unionByName(first("NOT positive", SPARE * UNLABELLED)).drop("_nth")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and score, from 0 to 1."""
    slim = docs.select(F.col(doc_id), F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            parts = [shared.value.score(W.split(raw, offsets)) for _, _, raw, offsets in W.chunks(batch.column(1))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[batch.schema.names[0], "score"])

    return slim.mapInArrow(run, f"`{doc_id}` {slim.schema[0].dataType.simpleString()}, score double")
