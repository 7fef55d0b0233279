"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of its words and their beginnings; a document's is the noisy-or of its sentences',
``1 - product(1 - p)``.  The weights are learned from document labels alone,
and afterwards single out the offending sentences.

What clean sentences give by chance adds up with their number.  From the
training documents it is known how many of them give ``CHANCE`` together; the
bias of a document with ``k`` times as many sentences is less by ``log(k)``.

Training takes at most ``SAMPLE`` labelled documents of each label, those with
the least hash of their id, and of each label at most ``SAMPLE_TOTAL``
characters; these bounds hold at any corpus size.  Of a clean document above
``SAMPLE_CHARS`` characters, every k-th sentence is taken; a toxic one is not
chosen, as a part of it need not be toxic.  The model is a table of at most
``MAX_FEATURES`` weights.  Scoring is one pass over whole texts, without
shuffle.

Sentences end at ``. ! ?``, their full-width and other forms, and line breaks;
words are runs of letters and digits, A-Z as a-z.  Runs in scripts without
spaces, and runs of more than ``LONG_WORD`` bytes, give the character n-grams
of their whole length as features.

Cases: null and empty texts have no sentences and score 0; a document with
several labels is toxic if one of them is; null labels and labels of unknown
documents teach nothing; without labels of both kinds every score is 0; other
columns are ignored by ``score`` and kept by ``with_score``.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import utf8

#: training documents of each label, their greatest length, and all lengths together
SAMPLE, SAMPLE_CHARS, SAMPLE_TOTAL = 3_000, 100_000, 50_000_000
#: ``-log(1 - score)`` that clean sentences may give together
CHANCE = 0.3
#: a feature must occur in so many training documents, and its share differ
#: between the labels by so many standard errors; features in a model
LEAST_DOCS, LEAST_Z, MAX_FEATURES = 3, 5.0, 20_000
#: lengths of the beginnings of words; of the n-grams of runs that are not one
#: word, among them all runs of more than so many bytes
PREFIXES, GRAMS, LONG_WORD = (3, 4, 5, 6, 7), (2, 3, 4), 64
#: words whose weight a worker keeps
KEPT = 100_000
STEPS, RATE, RIDGE, START_BIAS = 300, 0.15, 1e-5, -6.0
THRESHOLD = 0.7

_SENTENCE = re.compile(rb"[.!?\n\r]+")
#: in UTF-8: ends of sentences beside ASCII's (full-width and half-width forms,
#: ellipsis, double marks, Arabic, Devanagari, Burmese, Khmer, Ethiopic; line and
#: paragraph separators); other spaces and punctuation; scripts without spaces
_SENTENCE_UTF8 = re.compile(
    rb"(?:[.!?\n\r]|\xc2\x85|\xd8\x9f|\xdb\x94|\xe0\xa5[\xa4\xa5]|\xe1\x81[\x8a\x8b]|\xe1\x8d[\xa2\xa7]|\xe1\x9f[\x94\x95]"
    rb"|\xe2\x80[\xa6\xa8\xa9\xbc\xbd]|\xe2\x81[\x87-\x89]|\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]|\xef\xbd\xa1)+"
)
_BREAK = re.compile(
    rb"\xc2[\x85\xa0\xa1\xab\xb7\xbb\xbf]|\xd8[\x8c\x9b\x9f]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\x90-\xbf]|\xe2\x81[\x80-\x9f]"
    rb"|\xe3\x80[\x80-\x83\x88-\x9f]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]"
)
_UNSPACED = re.compile(rb"\xe0[\xb8-\xbf]|\xe1[\x80-\x82\x9e\x9f]|\xe3[\x81-\x83\x90-\xbf]|[\xe4-\xe9]|\xf0[\xa0-\xb3]")
#: bytes that are not letters or digits, as spaces; A-Z as a-z
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def sentences(text: bytes) -> list[bytes]:
    """The texts of the sentences, white space stripped, none empty."""
    return [s for s in (x.strip() for x in split_sentences(text)) if s]


def split_sentences(text: bytes) -> list[bytes]:
    return (_SENTENCE if text.isascii() else _SENTENCE_UTF8).split(text)


def words(sentence: bytes) -> list[bytes]:
    if not sentence.isascii():
        sentence = _BREAK.sub(b" ", sentence)
    return sentence.translate(_WORDS).split()


def features(word: bytes) -> Iterator[str]:
    """A word and its beginnings, so that inflected and compound words share
    what they begin with; of a run that is not one word, its n-grams."""
    w = word.decode("utf-8", "replace")
    if len(word) <= LONG_WORD:
        yield w
        yield from (w[:n] + "-" for n in PREFIXES if n < len(w))
    if len(word) > LONG_WORD or not word.isascii() and _UNSPACED.search(word):
        for n in GRAMS:
            yield from (w[i : i + n] + "~" for i in range(len(w) - n + 1))


@dataclass
class Model:
    """Weights of features, the bias of a sentence, and the number of
    sentences above which the bias falls."""

    weights: dict[str, float]
    bias: float
    span: float = float("inf")

    def __post_init__(self):
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "span": self.span, "known": {}}

    def word(self, w: bytes) -> float:
        """A word's part of the logit, kept for the next time unless long."""
        if len(w) > LONG_WORD:
            return self.part(w)
        if w not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[w] = self.part(w)
        return self.known[w]

    def part(self, w: bytes) -> float:
        """The weights of a word's features, each once."""
        return sum(self.weights[f] for f in dict.fromkeys(f for f in features(w) if f in self.weights))

    def sentence_logits(self, text: bytes) -> list[float]:
        return [self.bias + sum(map(self.word, set(words(s)))) for s in sentences(text)]

    def score(self, text: bytes) -> float:
        """The noisy-or of a text's sentences."""
        if not self.weights or not text:
            return 0.0
        known = self.known
        logits = []
        for s in split_sentences(text):
            own = set(words(s))
            if own:
                try:
                    logits.append(sum([known[w] for w in own]))
                except KeyError:
                    logits.append(sum(map(self.word, own)))
            elif s.strip():
                logits.append(0.0)
        bias = self.bias - np.log(max(1.0, len(logits) / self.span))
        return float(-np.expm1(-np.logaddexp(0.0, bias + np.array(logits)).sum()))


def _informative(texts: list[bytes], y: np.ndarray) -> dict[str, int]:
    """Features whose share of the documents differs between the labels by
    ``LEAST_Z`` standard errors, numbered."""
    both, toxic = Counter(), Counter()
    for text, label in zip(texts, y):
        own = {f for w in {w for s in sentences(text) for w in words(s)} for f in features(w)}
        both.update(own)
        if label:
            toxic.update(own)
    n, n1 = len(y), y.sum()
    out = []
    for f, k in both.items():
        if k >= LEAST_DOCS:
            p = k / n
            z = (toxic[f] / n1 - (k - toxic[f]) / (n - n1)) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)) + 1e-12)
            if abs(z) >= LEAST_Z:
                out.append((-abs(z), f))
    return {f: i for i, (_, f) in enumerate(sorted(out)[:MAX_FEATURES])}


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Feature weights by gradient descent on the log loss of the documents."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, START_BIAS)
    index = _informative(texts, y)
    # as numbers, not as Python objects: there is one for each feature of each sentence
    feature, sent, doc = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for s in sentences(text):
            own = [index[f] for w in set(words(s)) for f in dict.fromkeys(f for f in features(w) if f in index)]
            feature.extend(own)
            sent.extend([len(doc)] * len(own))
            doc.append(d)
    feature, sent, doc = (np.array(x, dtype=np.int64) for x in (feature, sent, doc))
    n_features, n_sents, n_docs = len(index), len(doc), len(y)
    w, bias = np.zeros(n_features), START_BIAS
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent, w[feature], n_sents)
        p = 1 / (1 + np.exp(-z))
        stay = np.bincount(doc, -np.logaddexp(0.0, z), n_docs)  # log of no toxic sentence
        q = np.clip(-np.expm1(stay), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p (1 - y / q), both labels at once
        g = p * (1 - y[doc] / q[doc]) / n_docs
        gw = np.bincount(feature, g[sent], n_features) + RIDGE * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-7)
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-7)
    clean = y[doc] == 0
    chance = np.logaddexp(0.0, bias + np.bincount(sent, w[feature], n_sents))[clean].mean() if clean.any() else 0.0
    span = CHANCE / chance if chance > 0 else float("inf")
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(bias), max(1.0, span))


def _part(text: bytes, size: int) -> bytes:
    """Every k-th sentence of a long text, ``size`` bytes at most."""
    return b"\n".join(sentences(text)[:: -(-len(text) // size)])[:size]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels of rows that are not held out."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    size = F.coalesce(F.length("text"), F.lit(0))
    fits = known.join(docs.select("doc_id", size.alias("chars")), "doc_id").where((F.col("toxic") == 0) | (F.col("chars") <= SAMPLE_CHARS))
    fits = fits.groupBy("doc_id", "toxic").agg(F.least(F.max("chars"), F.lit(SAMPLE_CHARS)).alias("chars"))
    both = [fits.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(SAMPLE) for t in (0, 1)]
    chosen = both[0].unionByName(both[1])
    # chosen has 2 * SAMPLE rows at most
    upto = F.sum("chars").over(Window.partitionBy("toxic").orderBy(order, "doc_id"))
    chosen = chosen.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_TOTAL).select("doc_id", "toxic")

    chars = SAMPLE_CHARS

    @F.pandas_udf("binary")
    def part(texts: pd.Series) -> pd.Series:
        short = (len(t) <= chars or len(t.decode("utf-8", "replace")) <= chars for t in texts)
        return pd.Series([t if s else _part(t, chars) for t, s in zip(texts, short)], dtype="object")

    texts = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "toxic", part("text").alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id") if len(rows) else rows
    return fit([bytes(t) for t in rows["text"]], [int(t) for t in rows["toxic"]])


def score_column(model: Model, spark) -> Column:
    """The score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document."""
    rows = docs.select("doc_id", held_out().alias("held_out"), score_column(model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, place, sentence, probability) of the sentences that are toxic
    by themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            out = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                text = bytes(text)
                for i, (s, z) in enumerate(zip(sentences(text), m.sentence_logits(text))):
                    p = 1 / (1 + np.exp(-z))
                    if p >= least:
                        out.append((doc_id, i, s.decode("utf-8", "replace"), float(p)))
            yield pd.DataFrame(out, columns=["doc_id", "place", "sentence", "probability"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, place int, sentence string, probability double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
