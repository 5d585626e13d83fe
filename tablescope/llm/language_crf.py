"""Language identification by a linear-chain conditional random field over words.

Each word has a score for each language from its features (the word itself, affixes, character
n-grams, membership in each language's lexicon), and neighbouring words are tied by learned
transitions; forward-backward gives every word's distribution over languages in its context, so
code-switched texts get labels word by word.  A text's language is that of the largest sum of word
marginals, and its score the mean marginal.  Features and chains: ``chains``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm import chains
from tablescope.llm.chains import BUCKETS
from tablescope.llm.common import byte_chunks, crc_mod, labelled_sample, release_memory, tidy

#: Labelled texts of each language that the model is fitted on (whole texts; see ``fit_model``).
TRAIN_TEXTS = 700
EPOCHS = 6
#: Words of each language's lexicon.
LEXICON = 2_000
#: Bytes of the texts whose words are held at once.
CHUNK = 2 << 20
UNDETERMINED = "und"


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, prefix and suffix, and character two- and three-grams of the
    whole word with its borders (which make the shorter affixes)."""
    return chains.grams([word]).flat()[0].tolist()


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray      # BUCKETS x L
    lexicon: dict[str, int]  # lower-cased word -> bit set of languages
    lexicon_weights: np.ndarray  # L x L: language of the lexicon, language scored
    transitions: np.ndarray  # L x L
    _hashes: np.ndarray = field(init=False, repr=False)  # of the lexicon's words, ascending
    _sets: np.ndarray = field(init=False, repr=False)    # their sets' rows in the table
    _table: np.ndarray = field(init=False, repr=False)   # distinct sets x L, the last empty

    def __post_init__(self):
        words = sorted(self.lexicon)
        hashes = chains.grams(words).whole if words else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        sets = sorted(set(self.lexicon.values()))
        number = {x: i for i, x in enumerate(sets)}
        self._hashes = hashes[order]
        self._sets = np.array([number[self.lexicon[words[i]]] for i in order], dtype=np.int64)
        self._table = np.array([[(x >> k) & 1 for k in range(len(self.languages))] for x in [*sets, 0]], dtype=np.float32)

    def _member(self, whole: np.ndarray) -> np.ndarray:
        """Rows of the table for words of these hashes."""
        if not len(self._hashes):
            return np.zeros(len(whole), dtype=np.int64)
        at = np.minimum(np.searchsorted(self._hashes, whole), len(self._hashes) - 1)
        return np.where(self._hashes[at] == whole, self._sets[at], len(self._table) - 1)

    def member(self, words: pa.Array | list[str]) -> np.ndarray:
        return self._table[self._member(chains.grams(words).whole)] if len(words) else np.zeros((0, len(self.languages)))

    def emissions(self, words: pa.Array | list[str]) -> np.ndarray:
        """Scores of words by language, each divided by the root of its number of features."""
        out, whole = chains.scores(words, self.weights)
        out += (self._table @ self.lexicon_weights).astype(out.dtype)[self._member(whole)]
        return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = chains.BLOCK):
    """Marginals of every word (rows of ``emissions``, chains of ``lengths`` laid end to end) and the
    expected number of each transition in all chains."""
    gamma, joint = chains.marginals(emissions, lengths, transitions, block, expect=True)
    return gamma.T, joint


def _training_chains(words: chains.Words, labels: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Half of the texts as they are; of the others, pairs spliced by random spans, so that the model
    sees switches between languages.  Chains of word codes, and their labels."""
    texts = np.split(words.codes, np.cumsum(words.lengths)[:-1])
    out, tags = [], []
    order = rng.permutation(len(texts))
    half = len(order) // 2
    half += (len(order) - half) % 2  # none is left without a partner
    for i in order[:half]:
        out.append(texts[i])
        tags.append(np.full(len(texts[i]), labels[i]))
    for i, j in zip(order[half::2], order[half + 1::2], strict=False):
        pair, place, turn = (i, j), [0, 0], 0
        parts, tag = [texts[i][:0]], [np.zeros(0, dtype=np.int64)]
        while place[0] < len(texts[i]) or place[1] < len(texts[j]):
            part = texts[pair[turn]][place[turn]:place[turn] + int(rng.integers(8, 80))]
            parts.append(part)
            tag.append(np.full(len(part), labels[pair[turn]]))
            place[turn] += len(part)
            turn = 1 - turn
        out.append(np.concatenate(parts))
        tags.append(np.concatenate(tag))
    return out, tags


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Fit by adaptive stochastic gradient ascent of the chains' conditional likelihood."""
    languages = sorted(set(labels))
    L = len(languages)
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    words = chains.split_words(pa.array(texts, pa.string()))
    cut, tags = _training_chains(words, y, np.random.default_rng(seed))
    codes, tag = np.concatenate(cut), np.concatenate(tags)
    # lexicon: the most frequent words of each language
    lower = pd.Series([w.lower() for w in words.vocab.to_pylist()])
    lexicon: dict[str, int] = {}
    for k in range(L):
        counts = pd.Series(np.bincount(codes[tag == k], minlength=len(words.vocab))).groupby(lower.values).sum()
        counts = counts[counts > 1].sort_values(ascending=False, kind="stable").head(LEXICON)
        for w in counts.index:
            lexicon[w] = lexicon.get(w, 0) | (1 << k)
    members = Model(languages, np.zeros((0, L)), lexicon, np.zeros((L, L)), np.zeros((L, L))).member(words.vocab)
    lengths, vocab = np.array([len(c) for c in cut]), words.vocab
    del words, cut, tags, lower, counts
    release_memory()  # the driver has little, and keeps what it has freed
    weights, extra, transitions = chains.fit(vocab, codes, lengths, tag, L, members, epochs, seed=seed)
    return Model(languages, weights, lexicon, extra, transitions)


def fit_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4,
              held: int = 2, max_texts: int = TRAIN_TEXTS) -> Model | None:
    """Fit on at most ``max_texts`` distinct texts of each language (a documented bound; those of the
    smallest hashes) of the rows that may be learnt from: a label, a text with letters, and not held
    out.  Every label of such a row is learnt, however rare it is.  None if there are none."""
    rows = (df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.col(label_col).alias("__label"))
            .where((crc_mod("__id", folds) != held) & F.col("__label").isNotNull() & F.col("__text").rlike(r"\p{L}"))
            .withColumn("__h", F.xxhash64("__text")))
    sample = labelled_sample(rows.drop("__label"), rows.drop("__text"), max_texts)
    model = train([t for t, _ in sample], [x for _, x in sample]) if sample else None
    del sample
    release_memory()
    return model


def _predictions(shared, text: str, with_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages if model else [], dtype=object)
        for b in byte_chunks(batches, text, CHUNK):
            texts = b.column(text)
            use = chains.has_letter(texts) if model is not None else np.zeros(b.num_rows, dtype=bool)
            labels = np.full(b.num_rows, UNDETERMINED, dtype=object)
            scores = np.zeros(b.num_rows)
            tags = [[] for _ in range(b.num_rows)]
            if use.any():
                words = chains.split_words(texts.filter(pa.array(use)))
                gamma, _ = chains.marginals(model.emissions(words.vocab)[words.codes], words.lengths, model.transitions)
                begin = np.cumsum(words.lengths) - words.lengths  # a text with a letter has a word
                mean = np.add.reduceat(gamma, begin, axis=1, dtype=float) / words.lengths
                best = mean.argmax(axis=0)
                labels[use] = names[best]
                scores[use] = np.clip(mean[best, np.arange(len(best))], 0.0, 1.0)
                if with_words:
                    each = np.split(names[gamma.argmax(axis=0)], begin[1:])
                    for i, x in zip(np.flatnonzero(use), each, strict=True):
                        tags[i] = x.tolist()
            cols, out = [pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            if with_words:
                cols.append(pa.array(tags, pa.list_(pa.string())))
                out.append("word_langs")
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *out])
    return run


def predict(df: DataFrame, model: Model | None, text_col: str = "text", with_words: bool = False) -> DataFrame:
    """``df`` with lang_pred and score (and word_langs: each word's language).

    Defined cases: null, empty and letterless texts, and all texts without a model, are ``und`` with
    score 0; ties go to the first language in alphabetical order; an empty table gives no rows.
    Columns of ``df`` that have a name of the new ones are dropped.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a size fixed by BUCKETS, LEXICON and the languages
    new = {"lang_pred", "score", "word_langs"}
    kept = df.drop(*[c for c in df.columns if c.lower() in new and c != text_col])
    fields = [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if with_words:
        fields.append(T.StructField("word_langs", T.ArrayType(T.StringType())))
    return kept.mapInArrow(tidy(_predictions(shared, text_col, with_words)), T.StructType(fields))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4,
             held: int = 2, max_texts: int = TRAIN_TEXTS) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(identifier as text) modulo ``folds`` is not ``held``; a null
    identifier counts as the empty text there.
    """
    model = fit_model(df, id_col, text_col, label_col, folds, held, max_texts)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == held).alias("held_out"),
                     F.col(text_col).alias("text"))
    return predict(rows, model, "text").drop("text")
