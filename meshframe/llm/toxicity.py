"""Toxicity by multiple-instance learning.

Labels belong to documents, but sentences are what is scored: a sentence's logistic score adds up weights of its words'
features, and a document is toxic if any sentence is, p = 1 - prod(1 - p_s) (noisy-or). The weights are learned through
that formula from document labels, on a bounded sample of labelled rows; the sentences with the highest scores then say
where a document offends.

Scoring counts only what a sentence's words add to the bias, and only if they speak clearly: every other sentence has
probability 0, so a text is no more toxic for being long.
"""

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .language_id import sample_ids
from .tokens import TokenTable, held_out, kept_table, stripped

#: Labelled documents of each class, and characters of each class, that training takes at most.
SAMPLE_DOCS, SAMPLE_CHARS = 2048, 10_000_000
FEATURES = 1 << 18
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
#: Features whose likelihood ratio G is less than this get no weight. At any sample size, chance alone reaches G about as
#: rarely as exp(-G / 2), so among FEATURES it comes to about 25; a sample with fewer features has a bar that is as rare.
LEAST_G = 30.0
#: A longer run of words without an end is cut.
SENTENCE_WORDS = 40
ENDS = ".!?"
ROUNDS, RATE, DECAY, BIAS = 120, 0.1, 1e-4, -5.0
THRESHOLD = 0.7
#: Sentences whose words add less than this to the log odds score 0.
LEAST_EVIDENCE = 2.0
#: The bias of a model that could learn nothing: every sentence scores 0.
UNTRAINED = -np.inf


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def features(token: str) -> list[int]:
    w = stripped(token)
    if not w:
        return []
    names = [f"={w}"] + [f"^{w[:k]}" for k in PREFIXES if len(w) >= k] + [f"{w[-k:]}$" for k in SUFFIXES if len(w) >= k]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def _lines(text: str | None) -> str:
    return (text or "").replace("\n", " . ")


def sentence_heads(ends: np.ndarray) -> np.ndarray:
    """First token of each sentence, for tokens of which some end one."""
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    new = np.append(True, ends[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(ends)), 0))
    return np.flatnonzero(new | ((np.arange(len(ends)) - head) % SENTENCE_WORDS == 0))


class _Sample:
    """Token numbers and sentence heads of each document, and the features of each token in one flat array."""

    def __init__(self, texts: list[str | None]) -> None:
        self.vocabulary: dict[str, int] = {}
        flat, edges = array("i"), array("i", [0])
        self.tokens, self.heads, self.n_sentences = [], [], []
        for text in texts:
            own = _lines(text).lower().split()
            ids = np.empty(len(own), dtype=np.int32)
            for i, t in enumerate(own):
                k = self.vocabulary.get(t)
                if k is None:
                    k = self.vocabulary[t] = len(self.vocabulary)
                    flat.extend(features(t))
                    edges.append(len(flat))
                ids[i] = k
            self.tokens.append(ids)
            heads = sentence_heads(np.array([t[-1] in ENDS for t in own], dtype=bool))
            self.heads.append(heads.astype(np.int32))
            said = np.array([edges[k + 1] > edges[k] for k in ids.tolist()], dtype=bool)
            self.n_sentences.append(int((np.add.reduceat(said, heads) > 0).sum()) if len(heads) else 0)
        self.feature, self.edges = np.array(flat, dtype=np.int32), np.array(edges, dtype=np.int32)

    def features_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the words, and for each the place of its word."""
        k = self.edges[words + 1] - self.edges[words]
        at = np.repeat(self.edges[words] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        return self.feature[at], np.repeat(np.arange(len(words)), k)

    def telling(self, y: np.ndarray) -> np.ndarray:
        """Whether the labels of the documents that have a feature are further from the sample's than by chance; a document
        at a time."""
        have, bad = np.zeros(FEATURES), np.zeros(FEATURES)
        for ids, label in zip(self.tokens, y, strict=True):
            found = np.unique(self.features_of(np.unique(ids))[0])
            have[found] += 1
            bad[found] += label
        n, n_bad = len(y), y.sum()
        g = np.zeros(FEATURES)
        for seen, of, among in (
            (bad, have, n_bad), (have - bad, have, n - n_bad), (n_bad - bad, n - have, n_bad), (n - n_bad - have + bad, n - have, n - n_bad)
        ):
            some = seen > 0
            g[some] += 2 * seen[some] * np.log(seen[some] * n / (of[some] * among))
        found = have > 0
        return found & (g >= LEAST_G - 2 * np.log(FEATURES / max(found.sum(), 1)))


@dataclass
class _Bags:
    """What training sums over. word: token numbers of all kept sentences, which sentence numbers them and doc the
    sentences; plain counts a document's other sentences. feature and owner give the telling features of each token."""

    y: np.ndarray
    plain: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    feature: np.ndarray
    owner: np.ndarray

    def __post_init__(self) -> None:
        bad = self.y.sum()
        self.share = np.where(self.y > 0, 0.5 / bad, 0.5 / (len(self.y) - bad))
        self.n_words = int(self.word.max()) + 1

    def gradient(self, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """The classes' mean negative log likelihood, and its gradient for the weights and the bias."""
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        score = np.bincount(self.owner, weights=weights[self.feature], minlength=self.n_words)
        p = sigmoid(bias + np.bincount(self.sentence, weights=score[self.word], minlength=len(self.doc)))
        p0 = sigmoid(bias)
        none = np.bincount(self.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(self.y)) + self.plain * np.log1p(-p0)
        whole = np.clip(1 - np.exp(none), 1e-9, 1.0)
        pull = np.where(self.y > 0, -(1 - whole) / whole, 1.0) * self.share
        gz = pull[self.doc] * p
        by_word = np.bincount(self.word, weights=gz[self.sentence], minlength=self.n_words)
        g = np.bincount(self.feature, weights=by_word[self.owner], minlength=len(weights))
        loss = -(self.share * np.where(self.y > 0, np.log(whole), none)).sum()
        return float(loss), g, float(gz.sum() + (pull * self.plain).sum() * p0)


def train(texts: list[str | None], labels: list[int]) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood; the same rows in the same order give the same model.

    Only sentences with a telling feature are kept; the others all have the bias's probability and are counted.
    """
    y = np.array(labels, dtype=float)
    weights = np.zeros(FEATURES)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(weights, UNTRAINED)
    sample = _Sample(texts)
    telling = sample.telling(y)
    every = np.arange(len(sample.vocabulary))
    f, of = sample.features_of(every)
    word_ok = np.bincount(of, weights=telling[f], minlength=len(every)) > 0
    words, docs, sentences, plain, n = [], [], [], np.zeros(len(y)), 0
    for d, (ids, heads) in enumerate(zip(sample.tokens, sample.heads, strict=True)):
        at = np.flatnonzero(word_ok[ids])
        own, place = np.unique(np.searchsorted(heads, at, "right"), return_inverse=True)
        plain[d] = sample.n_sentences[d] - len(own)
        words.append(ids[at]), sentences.append(n + place), docs.append(np.full(len(own), d))
        n += len(own)
    if not n:
        return ToxicityModel(weights, UNTRAINED)
    word, sentence, doc = np.concatenate(words), np.concatenate(sentences), np.concatenate(docs)
    used, word = np.unique(word, return_inverse=True)
    feature, owner = sample.features_of(used)
    feature, owner = feature[telling[feature]], owner[telling[feature]]

    bags = _Bags(y, plain, word, sentence, doc, feature, owner)
    m, v, bias, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), BIAS, 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        _, g, gb = bags.gradient(weights, bias)
        g += DECAY * weights
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.999 * v + 0.001 * g * g, 0.999 * vb + 0.001 * gb * gb
        step = RATE / (1 - 0.9**k)
        weights = weights - step * m / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        bias = bias - step * mb / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return ToxicityModel(weights, float(bias))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled rows that are not held out, at most SAMPLE_DOCS rows and SAMPLE_CHARS characters a class.

    Characters go to the shortest documents first, so a long text that does not fit leaves out no other, wherever its
    hash is. Lengths are compared before any text travels.
    """
    usable = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    ids = [
        sample_ids(usable.where(F.col(label_col) == y), id_col, SAMPLE_DOCS).distinct().withColumn("y", F.lit(y)) for y in (0, 1)
    ]
    ids = ids[0].unionByName(ids[1])
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    sized = own.select("__id", F.coalesce(F.length("__text"), F.lit(0)).cast("long").alias("n"))
    sized = sized.join(F.broadcast(ids), F.col("__id") == F.col("__sample_id")).groupBy("__id", "y").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("y").orderBy("n", F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0)
    fit = sized.withColumn("upto", F.sum("n").over(so_far)).where(F.col("upto") <= SAMPLE_CHARS)
    fit = fit.select(F.col("__id").alias("__fit_id"), "y")  # 2 * SAMPLE_DOCS rows at most
    rows = own.join(F.broadcast(fit), F.col("__id") == F.col("__fit_id")).select("__id", "y", "__text").collect()
    rows.sort(key=lambda r: (r["__id"], r["y"], r["__text"] or ""))
    return train([r["__text"] for r in rows], [r["y"] for r in rows])


def token_row(model: ToxicityModel, token: str) -> tuple[float, float, float]:
    """Weight of a token, whether it ends a sentence, and whether it is more than punctuation."""
    w = model.weights
    found = features(token)
    return sum([w[f] for f in found]), float(token[-1] in ENDS), float(bool(found))


def sentence_scores(model: ToxicityModel, table: TokenTable, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """First token and probability of each sentence that says anything; what the bias alone gives counts as 0."""
    rows = table.values(_lines(text))
    heads = sentence_heads(rows[:, 1] > 0)
    if not len(heads):
        return heads, np.zeros(0)
    z, _, said = np.add.reduceat(rows, heads, axis=0).T
    heads, z = heads[said > 0], z[said > 0]
    p, loud = np.zeros(len(z)), z >= LEAST_EVIDENCE
    if model.bias == UNTRAINED or not loud.any():
        return heads, p
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    alone = sigmoid(model.bias)
    p[loud] = (sigmoid(model.bias + z[loud]) - alone) / (1 - alone)
    return heads, p


def noisy_or(p: np.ndarray) -> float:
    return float(0.0 - np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with two more columns: `out`, the probability of the whole text (0 without words), and `out`_worst, the first
    word (counted from 0) of the worst sentence, null without words. Columns of docs by these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        table = kept_table(key, lambda t: token_row(m, t), 3)
        for texts in batches:
            found = []
            for t in texts:
                heads, p = sentence_scores(m, table, t)
                found.append((noisy_or(p), int(heads[p.argmax()]) if len(p) else None))
            yield pd.DataFrame({"p": [x[0] for x in found], "at": pd.array([x[1] for x in found], dtype="Int64")})

    score = F.pandas_udf(run, "p double, at long")
    rest = [c for c in docs.columns if c not in (out, f"{out}_worst", "__tox")]
    rest = [F.col(f"`{c}`") for c in rest]
    scored = docs.select(*rest, score(docs[text_col].cast("string")).alias("__tox"))
    return scored.select(*rest, F.col("__tox.p").alias(out), F.col("__tox.at").alias(f"{out}_worst"))


def toxicity_report(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_sentence_word) of every row, from the whole text alone.

    Null and empty texts score 0. Without labels of both classes, or where no feature is telling, every row scores 0.
    Rows are judged one by one; no rows give no rows. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score_texts(own, model)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("toxicity_worst").alias("worst_sentence_word"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that score below THRESHOLD, with the columns of docs."""
    return score_texts(docs, model, out="__toxicity").where(F.col("__toxicity") < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])
