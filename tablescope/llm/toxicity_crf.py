"""Toxicity by a linear-chain conditional random field that tags toxic words.

Documents carry labels, words do not: of a bounded sample of labelled texts, the words that occur in
toxic texts far more often than chance allows are labelled toxic there, all others clean.  The field
learns those tags from letters and context, so that it also tags forms it has not seen.  Forward-backward
gives every word's marginal; a text's score is a logistic function of the marginals' sum and maximum,
fitted on texts the field has not seen, and words tagged toxic are returned as spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm import chains
from tablescope.llm.common import byte_chunks, crc_mod, labelled_sample

#: Labelled texts of each label (toxic, clean) that the model is fitted on, whole.
TRAIN_TEXTS = 1_000
EPOCHS = 4
BATCH_TEXTS = 30
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7
#: How many times as often as in clean texts a toxic word occurs in toxic ones, at least.
RATIO = 8.0
#: Lengths of the beginnings of words that are counted beside whole words.
STEMS = (4, 5, 6, 7)
#: Steps of the fit, at least.
STEPS = 200
#: Bytes of the texts whose words are held at once.
CHUNK = 2 << 20
_TRIM = re.compile(r"^[\W\d_]+|[\W\d_]+$")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("score", T.DoubleType())]))


@dataclass
class Model:
    """Without ``weights``, the same score for every text: the share of toxic ones."""

    share: float
    weights: np.ndarray | None = None      # BUCKETS x 2
    transitions: np.ndarray | None = None  # 2 x 2
    logistic: np.ndarray | None = None     # of the document features

    def marginals(self, words: chains.Words) -> np.ndarray:
        """The probability of each word to be toxic."""
        if not len(words.codes):
            return np.zeros(0)
        em, _ = chains.scores(words.vocab, self.weights)
        return chains.marginals(em[words.codes], words.lengths, self.transitions)[0][1].astype(float)

    def scores(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(document_features(marginals, lengths) @ self.logistic, -500, 500)))


def document_features(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A constant, the largest marginal, and logarithms of the sums of the marginals over a half and of all."""
    some = np.flatnonzero(lengths)
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1.0
    if len(some):
        begin = (np.cumsum(lengths) - lengths)[some]
        out[some, 1] = np.maximum.reduceat(marginals, begin)
        out[some, 2] = np.log1p(np.add.reduceat(np.where(marginals >= 0.5, marginals, 0.0), begin))
        out[some, 3] = np.log1p(np.add.reduceat(marginals, begin))
    return out


def toxic_words(words: chains.Words, toxic: np.ndarray) -> np.ndarray:
    """For each word of the vocabulary, whether the texts' labels make it toxic: the word (lower-cased,
    without signs at its ends) or one of its beginnings of ``STEMS`` letters stands in toxic texts
    ``RATIO`` times as often as in clean ones, by a likelihood ratio that none would reach by chance."""
    forms = [_TRIM.sub("", w.lower()) for w in words.vocab.to_pylist()]
    text = np.repeat(np.arange(len(words.lengths)), words.lengths)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    limit = 2 * np.log(max(2, len(set(forms)))) + 10
    out = np.zeros(len(forms), dtype=bool)
    for cut in (None, *STEMS):
        keys: dict[str, int] = {"": 0}
        key = np.array([keys.setdefault(x[:cut] if cut is None or len(x) >= cut else "", len(keys)) for x in forms], dtype=np.int64)
        seen = np.unique(key[words.codes] * len(words.lengths) + text)  # each key once a text
        place = toxic[seen % len(words.lengths)]
        a, b = (np.bincount(seen // len(words.lengths), weights=x, minlength=len(keys)) for x in (place, ~place))
        g = sum(2 * np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum((a + b) * n / (n1 + n0), 1e-12)), 0.0)
                for x, n in ((a, n1), (b, n0)))
        bad = (((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)) >= RATIO) & (g >= limit)
        bad[0] = False
        out |= bad[key]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) / weight.sum() + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) / weight.sum() - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[bool], share: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit field and logistic function.  ``share``: of toxic texts among all that may be learnt from."""
    y = np.array(toxic, dtype=bool)
    if y.all() or not y.any():
        return Model(share)
    turn = np.random.default_rng(seed).permutation(len(texts))
    if len(texts) < 400:  # too few to part
        first = second = turn
    else:
        first, second = turn[:3 * len(turn) // 4], turn[3 * len(turn) // 4:]
        if y[second].all() or not y[second].any():
            second = turn
    words = chains.split_words(pa.array([texts[i] for i in first], pa.string()))
    bad = toxic_words(words, y[first])
    if not bad.any():
        return Model(share)
    tags = (bad[words.codes] & np.repeat(y[first], words.lengths)).astype(np.int64)
    epochs = max(epochs, -(-STEPS * BATCH_TEXTS // len(first)))
    weights, _, transitions = chains.fit(words.vocab, words.codes, words.lengths, tags, 2, None, epochs, BATCH_TEXTS, seed)
    model = Model(share, weights, transitions)
    words = chains.split_words(pa.array([texts[i] for i in second], pa.string()))
    x = document_features(model.marginals(words), words.lengths)
    part = y[second].mean()
    model.logistic = _logistic(x, y[second].astype(float), np.where(y[second], share / part, (1 - share) / (1 - part)))
    return model


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
              folds: int = 3, held: int = 1, max_texts: int = TRAIN_TEXTS) -> Model:
    """Fit on at most ``max_texts`` distinct texts of each label (a documented bound; those of the smallest
    hashes) of the labelled documents that are not held out.  Labels other than 0 count as 1, and of
    several labels of a document the largest counts."""
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id"))
             .agg(F.max((F.col(label_col) != 0).cast("int")).alias("__label")))
    texts = (docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
             .where(crc_mod("__id", folds) != held).withColumn("__h", F.xxhash64("__text")))
    hashed = texts.select("__id", "__h").join(marks, "__id")
    sample = labelled_sample(texts, hashed, max_texts)
    count = {r["__label"]: r["n"] for r in hashed.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = count.get(1, 0) / max(1, sum(count.values()))
    return train([t for t, _ in sample], [x == 1 for _, x in sample], share)


def _spans(text: str, words: list[str], marginals: np.ndarray) -> list[dict]:
    """Places of the words tagged toxic, neighbours joined: code points, and the largest marginal."""
    out, at, last = [], 0, -2
    for i, (word, p) in enumerate(zip(words, marginals.tolist(), strict=True)):
        a = text.index(word, at)
        at = a + len(word)
        if p >= 0.5:
            if last == i - 1:
                out[-1]["end"], out[-1]["score"] = at, max(out[-1]["score"], p)
            else:
                out.append({"start": a, "end": at, "score": p})
            last = i
    return out


def _predictions(shared, text: str, threshold: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in byte_chunks(batches, text, CHUNK):
            scores, spans = np.full(b.num_rows, model.share), [[]] * b.num_rows
            if model.weights is not None:
                words = chains.split_words(b.column(text))
                p = model.marginals(words)
                scores = model.scores(p, words.lengths)
                ends = np.cumsum(words.lengths)
                tagged = np.unique(np.searchsorted(ends, np.flatnonzero(p >= 0.5), side="right"))
                for i in tagged.tolist():
                    here = slice(ends[i] - words.lengths[i], ends[i])
                    spans[i] = _spans(b.column(text)[i].as_py(), words.vocab.take(pa.array(words.codes[here])).to_pylist(), p[here])
            keep = [i for i, name in enumerate(b.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)],
                names=[*(b.schema.names[i] for i in keep), "score", "predicted", "spans"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and spans (start, end, score) of
    toxic words.

    Defined cases: null, empty and blank texts have no words and the score of a text without any toxic
    word; a null identifier counts as the empty text when folds are dealt; repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a size fixed by BUCKETS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == held).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictions(shared, "text", threshold), T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPANS)]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             folds: int = 3, held: int = 1, max_texts: int = TRAIN_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` with a model fitted on the labelled rows whose crc32(identifier as text) modulo ``folds``
    is not ``held``.  Without labels of both kinds, or without words that they tell apart, every text
    has the share of toxic labels as its score (0 without labels)."""
    return score(docs, fit_model(docs, labels, id_col, text_col, label_col, folds, held, max_texts), id_col, text_col, folds, held, threshold)
