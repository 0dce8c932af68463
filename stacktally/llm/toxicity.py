"""Toxic spans by a linear-chain conditional random field.

Labels are of whole documents, so token labels come first: in toxic documents of the training
sample, the tokens whose word or word beginning tells toxic documents from others. A chain with
the tags "clean" and "toxic" is fitted to them. Its forward-backward marginals give the spans,
and, through a logistic curve fitted on the same sample, the score of the document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from stacktally import workspace as w
from stacktally.llm.common import whole

# Labelled documents of each class that the model is fitted on, with their whole texts.
SAMPLE_PER_CLASS = 800
HASHED_FEATURES = 1 << 18
EPOCHS = 5
# A word or beginning marks tokens toxic from this log odds on.
LEAST_LOG_ODDS = 2.5
LEAST_DOCS = 3
SPAN_PROBABILITY = 0.5

TOKEN = re.compile(r"\w+")
# Words whose features are kept by a worker.
_KNOWN_WORDS = 500_000
# A longer document is several chains of so many tokens; features still see across their ends.
CHAIN_TOKENS = 64
# Share of the chains without a toxic token that the model is fitted on.
CLEAN_CHAINS = 0.15

_SCORE = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("probability", T.DoubleType()),
    ]))),
])


def features_of(word: str) -> list[str]:
    """The word, its beginnings and its end, in lower case."""
    return ["w" + word, "4" + word[:4], "5" + word[:5], "e" + word[-3:]]


class Model(NamedTuple):
    """Weights of a hashed feature of the token itself and of its two neighbours."""

    weights: np.ndarray  # 3 x HASHED_FEATURES: own, previous, next
    bias: float
    stay: np.ndarray  # 2 x 2 transition scores
    curve: np.ndarray  # logistic curve over the document's aggregates
    prior: float | None  # the score of every text if there was nothing to learn


def _ids(word: str) -> list[int]:
    return [xxh3_64_intdigest(f) & (HASHED_FEATURES - 1) for f in features_of(word)]


# --- the chain: two tags, scores as log odds ----------------------------------------


def marginals(scores: np.ndarray, lengths: np.ndarray, stay: np.ndarray) -> tuple:
    """Probability of "toxic" per token, and of each pair of tags, of padded chains.

    ``scores`` (chains, tokens) is the score of "toxic" over "clean". Forward and backward
    keep normalised probabilities, so no chain is too long for them.
    """
    n, size = scores.shape
    step = np.exp(stay - stay.max())
    odds = np.clip(scores, -30, 30)
    local = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=2)
    forward = np.empty((n, size, 2))
    state = np.full((n, 2), 0.5)
    for t in range(size):
        state = (state @ step if t else state) * local[:, t]
        state /= state.sum(axis=1, keepdims=True)
        forward[:, t] = state
    backward = np.ones((n, size, 2))
    state = np.ones((n, 2))
    for t in range(size - 1, 0, -1):
        state = np.where((lengths > t)[:, None], (state * local[:, t]) @ step.T, state)
        state = state / state.sum(axis=1, keepdims=True)
        backward[:, t - 1] = state
    both = forward * backward
    p = both[:, :, 1] / both.sum(axis=2)
    pairs = forward[:, :-1, :, None] * step * (local * backward)[:, 1:, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return p, pairs


def chain_probabilities(odds: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """As ``marginals``, for chains of equal length along the first axis, from exp(scores).

    Forward and backward messages are ratios of the two tags.
    """
    (cc, ct), (tc, tt) = np.exp(stay - stay.max())
    ahead = np.empty_like(odds)
    ahead[0] = odds[0]
    for t in range(1, len(odds)):
        ahead[t] = odds[t] * (ct + ahead[t - 1] * tt) / (cc + ahead[t - 1] * tc)
    back = np.ones_like(odds[0])
    for t in range(len(odds) - 1, 0, -1):
        ahead[t] *= back
        seen = odds[t] * back
        back = (tc + seen * tt) / (cc + seen * ct)
    ahead[0] *= back
    return ahead / (1 + ahead)


def aggregates(p: np.ndarray) -> np.ndarray:
    """What a document's score rests on: surest token, expected number, expected share."""
    if not len(p):
        return np.array([-6.0, 0.0, 0.0, 1.0])
    top = np.clip(p.max(), 1e-6, 1 - 1e-6)
    return np.array([np.log(top / (1 - top)), np.log1p(p.sum()), p.mean(), 1.0])


def _padded(chains: list[np.ndarray], fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains])
    out = np.full((len(chains), max(1, lengths.max(initial=0))), fill)
    for row, chain in zip(out, chains):
        row[: len(chain)] = chain
    return out, lengths


# --- fitting ----------------------------------------------------------------------------


def _marks(docs: list[list[str]], toxic: list[int]) -> set[str]:
    """Features that tell toxic documents from others, by document counts."""
    seen = {0: Counter(), 1: Counter()}
    for words, label in zip(docs, toxic):
        seen[label].update({f for word in set(words) for f in features_of(word) if f[0] != "e"})
    n = {label: max(1, sum(t == label for t in toxic)) for label in (0, 1)}
    return {
        f for f, c in seen[1].items() if c >= LEAST_DOCS
        and np.log((c + 0.5) / n[1]) - np.log((seen[0][f] + 0.5) / n[0]) > LEAST_LOG_ODDS
    }


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits the chain by AdaGrad on batches of sentences. With one class only, a constant."""
    empty = Model(np.zeros((3, 1), np.float32), 0.0, np.zeros((2, 2)), np.zeros(4), None)
    if len(set(toxic)) < 2:
        # Laplace's rule: even without any label the score says something.
        return empty._replace(prior=(sum(toxic) + 1) / (len(toxic) + 2) if toxic else 0.0)
    docs = [[x.lower() for x in TOKEN.findall(t)] for t in texts]
    marks = _marks(docs, toxic)
    flags: dict[str, bool] = {}
    ids: dict[str, list[int]] = {}
    for words in docs:
        for word in words:
            if word not in flags:
                flags[word] = not marks.isdisjoint(features_of(word))
                ids[word] = _ids(word)
    random = np.random.default_rng(seed)
    chains = []
    for words, label in zip(docs, toxic):
        for start in range(0, len(words), CHAIN_TOKENS):
            part = words[start : start + CHAIN_TOKENS]
            tags = np.array([float(label and flags[x]) for x in part])
            if tags.any() or random.random() < CLEAN_CHAINS:
                chains.append((part, tags))
    weights = np.zeros((3, HASHED_FEATURES))
    squares = np.full((3, HASHED_FEATURES), 1e-2)
    bias, bias_square, stay, stay_square = -3.0, 1e-2, np.zeros((2, 2)), np.full((2, 2), 1e-2)
    width = len(features_of(""))
    for _ in range(epochs):
        order = random.permutation(len(chains))
        for start in range(0, len(order), 128):
            chosen = [chains[i] for i in order[start : start + 128]]
            lengths = np.array([len(c[0]) for c in chosen])
            tags, _ = _padded([c[1] for c in chosen])
            at = np.full((len(chosen), lengths.max(), width), -1)
            for row, (part, _) in zip(at, chosen):
                row[: len(part)] = [ids[x] for x in part]
            used = (at >= 0)
            safe = np.where(used, at, 0)
            own, before, after = ((weights[k][safe] * used).sum(axis=2) for k in range(3))
            scores = own + bias
            scores[:, 1:] += before[:, :-1]
            scores[:, :-1] += after[:, 1:]
            real = np.arange(lengths.max()) < lengths[:, None]
            p, pairs = marginals(np.where(real, scores, 0), lengths, stay)
            delta = np.where(real, p - tags, 0) / len(chosen)
            shifted = (delta, np.pad(delta[:, 1:], ((0, 0), (0, 1))), np.pad(delta[:, :-1], ((0, 0), (1, 0))))
            for k in range(3):
                flat = np.broadcast_to(shifted[k][:, :, None], at.shape)[used]
                touched, where = np.unique(safe[used], return_inverse=True)
                gradient = np.bincount(where, weights=flat) + 1e-5 * weights[k][touched]
                squares[k][touched] += gradient**2
                weights[k][touched] -= 0.3 * gradient / np.sqrt(squares[k][touched])
            bias_square += delta.sum() ** 2
            bias -= 0.3 * delta.sum() / np.sqrt(bias_square)
            one = np.stack([1 - tags, tags], axis=2)
            truth = one[:, :-1, :, None] * one[:, 1:, None, :]
            gap = ((pairs - truth) * real[:, 1:, None, None]).sum(axis=(0, 1)) / len(chosen)
            stay_square += gap**2
            stay = stay - 0.3 * gap / np.sqrt(stay_square)
    model = Model(weights.astype(np.float32), bias, stay, np.zeros(4), None)
    tagger = Tagger(model)
    seen = np.array([aggregates(p) for p in tagger.tag(docs)])
    return model._replace(curve=_curve(seen, np.array(toxic, dtype=float)))


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, a little shrunk; clean documents, which are the
    many outside the sample, weigh three times as much as toxic ones."""
    weight = np.where(y == 1, 0.25 / max(1, y.sum()), 0.75 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        beta = beta + np.linalg.solve(bend, slope)
    return beta


# --- scoring -----------------------------------------------------------------------------


class Tagger(dict):
    """Marginals of token lists. Maps a word to its row of weights, for itself and its neighbours."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.empty((1 << 12, 3), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        """Adds the rows of words not seen before."""
        fresh = list(words.difference(self))
        if not fresh:
            return
        ids = np.array([_ids(word.lower()) for word in fresh])
        first, end = len(self), len(self) + len(fresh)
        while end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[first:end] = self.model.weights[:, ids].sum(axis=2).T
        self.update(zip(fresh, range(first, end)))

    def tag(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Probability of "toxic" for every token."""
        if len(self) > _KNOWN_WORDS:
            self.clear()
        lengths = np.array([len(words) for words in docs], dtype=np.int64)
        total = int(lengths.sum())
        if not total:
            return [np.empty(0)] * len(docs)
        self.learn(set().union(*docs))
        at = np.fromiter(
            (i for words in docs for i in map(self.__getitem__, words)), dtype=np.int64, count=total
        )
        own, before, after = self.rows[at].T.astype(np.float64)
        ends = np.cumsum(lengths)
        last = np.zeros(total, dtype=bool)
        last[ends[lengths > 0] - 1] = True
        scores = own + self.model.bias
        scores[1:] += np.where(last[:-1], 0, before[:-1])
        scores[:-1] += np.where(last[:-1], 0, after[1:])
        # Every document is cut into chains.
        starts = ends - lengths
        token = np.arange(total) - np.repeat(starts, lengths)
        first_chain = np.concatenate([[0], np.cumsum(-(-lengths // CHAIN_TOKENS))])
        chain = np.repeat(first_chain[:-1], lengths) + token // CHAIN_TOKENS
        size = np.bincount(chain)
        p = np.empty(total)
        odds = np.exp(np.clip(scores, -30, 30))
        # Padding that adds no evidence would still shift the last tokens, so chains of one
        # length go together: the full ones, then the ends by their length.
        order = np.argsort(size[chain], kind="stable")
        bounds = np.flatnonzero(np.diff(size[chain][order], prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:]):
            mine = order[a:b]  # whole chains, one after the other
            grid = odds[mine].reshape(-1, size[chain[mine[0]]]).T
            p[mine] = chain_probabilities(grid, self.model.stay).T.ravel()
        return [p[a:b] for a, b in zip(starts, ends)]


def score_texts(model: Model, tagger: Tagger, texts: list[str]) -> list[tuple]:
    """(score, spans) of each text; spans are (start, end, probability) in code points."""
    if model.prior is not None:
        return [(model.prior, []) for _ in texts]
    out = []
    for text, p in zip(texts, tagger.tag([TOKEN.findall(t) for t in texts])):
        score = 1 / (1 + np.exp(-np.clip(aggregates(p) @ model.curve, -30, 30)))
        spans: list[list] = []
        sure = np.flatnonzero(p >= SPAN_PROBABILITY).tolist()
        tokens = list(TOKEN.finditer(text)) if sure else []
        last = -2
        for i in sure:
            if i == last + 1:
                spans[-1][1] = tokens[i].end()
                spans[-1][2] = max(spans[-1][2], float(p[i]))
            else:
                spans.append([tokens[i].start(), tokens[i].end(), float(p[i])])
            last = i
        out.append((float(score), [tuple(s) for s in spans]))
    return out


_taggers: dict[bytes, Tagger] = {}


def _tagger(model: Model) -> Tagger:
    """One per Python worker and model, kept over its tasks."""
    name = hashlib.blake2b(model.weights.tobytes(), digest_size=16).digest()
    if name not in _taggers:
        _taggers.clear()
        _taggers[name] = Tagger(model)
    return _taggers[name]


def _scorer(model: Model):
    @F.pandas_udf(_SCORE)
    def scorer(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = _tagger(model)
        for batch in texts:
            rows = []
            for start in range(0, len(batch), 256):
                rows += score_texts(model, tagger, batch.iloc[start : start + 256].tolist())
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in r[1]] for r in rows]
            yield pd.DataFrame({"score": [r[0] for r in rows], "spans": spans})

    return scorer


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id's text divisible by 5; not null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits a model on a bounded sample of the labelled rows that are not held out.

    At most ``per_class`` documents of each label, chosen by a hash of their id; their texts are read
    whole, on the driver, where the model is fitted. A document labelled twice counts as toxic if any label says so; null
    ids and labels are left out. Without labels every score is 0.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = w.publish(chosen, "toxic_sample")  # at most 2 * per_class rows
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")
    ).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with struct ``toxicity``: score from 0 to 1 and spans (start, end, probability).

    Only the text is read. Null and empty texts are chains without tokens and get the lowest
    evidence; repeated rows get equal scores. A column ``toxicity`` of ``docs`` is replaced.
    """
    return docs.withColumn("toxicity", _scorer(model)(whole(F.col("text"))))
