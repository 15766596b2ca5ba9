"""Toxicity by class-conditional Kneser-Ney models.

For each class a Kneser-Ney model gives the words of a text (runs of letters, lower-cased), in this chain of backing off:
  words of the class, by continuation counts (how many different words come before them) -> characters of a word (with its edges)
  from the ORDER - 1 before them, in the class -> shorter n-grams of characters of both classes together, by continuation counts.
So an expression that is rare or unseen backs off to counts that both classes share and only what a class really says apart moves
the score. The discount is DISCOUNT: what is seen once counts as unseen, for a small class says much by chance. A word's evidence is
its log-likelihood under the toxic model less that under the ordinary one, within CAP. (Word pairs were tried as a level above and
left out: on three folds of sf0.1 they cost 6 of 98 toxic texts of the smaller languages and added 12 false ones of 2120.)

Evidence is normalised by length: its mean over the text, and the mean log-likelihood ratio of a text in which a share of RATE words
comes from the toxic model and all others from the ordinary one, for toxic texts are mostly ordinary words; the latter also by its
logarithm. The largest mean of a window of WINDOW words stands beside them, for one insult in a long text is toxic too. Weights and a bias, learned by logistic regression on documents that gave no counts, turn these into a probability.

The models come from a bounded sample (PER_CLASS documents and labelled.BYTES of text of each class at most, whole texts; every
third of them is for the weights); all documents are scored in tasks, where a word's evidence is remembered.

Defined results: null, empty and letterless texts have no evidence, and get the score of the bias; equal texts get equal scores;
null ids are scored; if the sample lacks a class, all scores are 0 (none toxic) or 1; an empty table gives no rows; labels, lang,
source and doc_id are not inputs of a score; other columns may have any name but the score's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_fold, table
from .labelled import sample

ORDER = 7
DISCOUNT = 1.0
CAP = 8.0
RATE = 0.002
WINDOW = 6
PER_CLASS = 3000
MEMO = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _level(counts: dict) -> tuple[dict, dict]:
    """(discounted count by n-gram, (total, share that backs off) by context) of counts by n-gram; where all backs off, neither is kept."""
    kept, contexts = {}, {}
    order = sorted(counts, key=lambda g: (len(g), g))  # n-grams of one context stand together
    for _, same in groupby(order, key=len):
        for context, grams in groupby(same, key=lambda g: g[:-1]):
            grams = list(grams)
            total, off = sum(map(counts.__getitem__, grams)), sum(min(counts[g], DISCOUNT) for g in grams)
            if off < total:
                contexts[context] = total, off / total
                kept.update((g, counts[g] - DISCOUNT) for g in grams if counts[g] > DISCOUNT)
    return kept, contexts


def _interpolated(level: tuple[dict, dict], gram, lower: float) -> float:
    total, share = level[1].get(gram[:-1], (1, 1.0))
    return level[0].get(gram, 0) / total + share * lower


class Characters:
    """Kneser-Ney models of the characters of words, one a class, from words and how often each occurs by class."""

    def __init__(self, words: list[str], counts: list[np.ndarray]):
        # Of the shorter n-grams: probabilities of those that are seen twice or more, and the share that backs off by context.
        self.known: dict[str, float] = {}
        self.off: dict[str, float] = {}
        self.types = len({ch for w in words for ch in w}) + 2
        for k in range(1, ORDER):
            # How many different characters come before an n-gram; before a word's edge there is one, nothing.
            longer = {s[i - k : i + 1] for s in (f"\x00<{w}>" for w in words) for i in range(max(2, k), len(s))}
            shorter = Counter(g[1:] for g in longer)
            del longer
            level = _level(shorter)
            found = {g: _interpolated(level, g, self._shared(g[1:])) for g in level[0]}
            self.off.update({h: share for h, (_, share) in level[1].items()})
            self.known.update(found)
        self.top = []
        for own in counts:
            top: Counter = Counter()
            for i, n in zip(np.flatnonzero(own).tolist(), own[own > 0].tolist()):
                s = f"<{words[i]}>"
                for i in range(1, len(s)):
                    top[s[max(0, i - ORDER + 1) : i + 1]] += n
            self.top.append(_level(top))

    def _shared(self, gram: str) -> float:
        weight = 1.0
        while gram:
            found = self.known.get(gram)
            if found is not None:
                return weight * found
            weight *= self.off.get(gram[:-1], 1.0)
            gram = gram[1:]
        return weight / self.types

    def words(self, word: str) -> list[float]:
        """Log probability of a word's characters, by class."""
        s, out = f"<{word}>", [0.0] * len(self.top)
        for i in range(1, len(s)):
            gram = s[max(0, i - ORDER + 1) : i + 1]
            lower = self._shared(gram[1:])
            for c, level in enumerate(self.top):
                out[c] += math.log(_interpolated(level, gram, lower))
        return out

    def ratios(self) -> tuple[dict[str, float], dict[str, float]]:
        """Log of the second class' probability of a character over the first's: by n-gram that a class knows, and by context for all other n-grams, as what both back off to is the same."""
        (first, first_contexts), (second, second_contexts) = self.top
        grams = {}
        for gram in first.keys() | second.keys():
            lower = self._shared(gram[1:])
            grams[gram] = math.log(_interpolated(self.top[1], gram, lower) / _interpolated(self.top[0], gram, lower))
        off = {h: math.log(second_contexts.get(h, (1, 1.0))[1] / first_contexts.get(h, (1, 1.0))[1]) for h in first_contexts.keys() | second_contexts.keys()}
        return grams, {h: x for h, x in off.items() if x}


class Models:
    """Kneser-Ney models of words, one a class, from tokenised texts by class."""

    def __init__(self, texts: list[Iterable[list[str]]]):
        number: dict[str, int] = {}
        found, lefts = [], []
        for docs in texts:
            own = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in docs]
            ids = np.concatenate([np.zeros(0, np.int64), *own])
            before = np.concatenate([np.zeros(0, np.int64), *(np.concatenate([[-1], x[:-1]]) for x in own if len(x))])
            found.append(ids)
            lefts.append(np.unique((before + 1) << 32 | ids) & 0xFFFFFFFF)  # one for each different word before
        words = list(number)
        self.characters = Characters(words, [np.bincount(ids, minlength=len(words)) for ids in found])
        self.levels = []
        for left in lefts:
            n = np.bincount(left, minlength=len(words))
            total, off = int(n.sum()), float(np.minimum(n, DISCOUNT).sum())
            kept = np.flatnonzero(n > DISCOUNT).tolist()
            self.levels.append(({(words[i],): int(n[i]) - DISCOUNT for i in kept}, {(): (total, off / total)} if off < total else {}))

    def words(self, word: str) -> list[float]:
        """Log probability of a word, by class."""
        return [math.log(max(_interpolated(level, (word,), math.exp(max(c, -600.0))), 1e-300)) for level, c in zip(self.levels, self.characters.words(word))]


class Ratios:
    """What scoring needs of the models: log P(word | toxic) - log P(word | ordinary) of words that a class knows, and what gives it for all others."""

    def __init__(self, models: Models):
        first, second = models.levels
        self.known = {w: float(np.subtract(*models.words(w)[::-1])) for (w,) in first[0].keys() | second[0].keys()}
        self.unseen = math.log(second[1].get((), (1, 1.0))[1] / first[1].get((), (1, 1.0))[1])
        self.grams, self.contexts = models.characters.ratios()

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            s, found, grams, contexts = f"<{word}>", self.unseen, self.grams, self.contexts
            for i in range(1, len(s)):
                gram = s[max(0, i - ORDER + 1) : i + 1]
                x = grams.get(gram)
                found += contexts.get(gram[:-1], 0.0) if x is None else x
        return found


class Evidence:
    """Evidence of the words of texts, within CAP, remembered by word."""

    def __init__(self, ratios: Ratios):
        self.ratios, self.memo = ratios, {}

    def _of(self, word: str) -> float:
        self.memo[word] = found = min(max(self.ratios.word(word), -CAP), CAP)
        return found

    def text(self, text: str) -> tuple[float, float, float, float]:
        """(mean evidence, mean log ratio of a mixture, the latter's logarithm, largest mean of a window)."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        ws = tokens(text)
        each = list(map(memo.get, ws))
        if None in each:
            each = [memo[w] if w in memo else self._of(w) for w in ws]
        each = np.array(each or [0.0])
        mixed = np.log1p(RATE * np.exp(each)).mean()
        upto = np.cumsum(each)
        window = (max(upto[WINDOW - 1], (upto[WINDOW:] - upto[:-WINDOW]).max()) if len(each) > WINDOW else upto[-1]) / WINDOW
        return float(each.mean()), float(mixed), float(np.log(mixed + 1e-3)), float(window)


def train(texts: list[str], labels: list[int]) -> tuple | None:
    """(ratios, weights of the features and bias); None where a class is missing."""
    fold = {c: [i for i, y in enumerate(labels) if y == c] for c in (0, 1)}
    if min(map(len, fold.values())) < 2:
        return None
    tune = [i for c in (0, 1) for i in fold[c][1::3]]
    held = set(tune)
    ratios = Ratios(Models([(tokens(texts[i]) for i in fold[c] if i not in held) for c in (0, 1)]))
    evidence = Evidence(ratios)
    x = np.array([[*evidence.text(texts[i]), 1.0] for i in tune])
    y = np.array([labels[i] for i in tune], float)
    scale = np.abs(x).max(axis=0) + 1e-9
    w, z = np.zeros(x.shape[1]), x / scale
    for _ in range(60):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + 1e-3 * w)
    return ratios, w / scale


def score_texts(model, only: float, texts: list[str], evidence: Evidence | None = None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), only)
    evidence = evidence or Evidence(model[0])
    z = np.array([[*evidence.text(t), 1.0] for t in texts]).reshape(-1, 5) @ model[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic") -> tuple:
    """(model, the score of all where it is None)."""
    rows = sample(docs, labels, label, may_learn, PER_CLASS)
    known = rows["label"].astype(int).tolist()
    return train(rows["text"].tolist(), known), float(bool(known) and min(known) == 1)


def score(docs: DataFrame, model: tuple, carry: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The carried columns and each whole text's probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, only = shared.value
        evidence = Evidence(own[0]) if own else None
        for batch in batches:
            yield pd.Series(score_texts(own, only, batch.tolist(), evidence), dtype="float64")

    return docs.select(*[F.col(f"`{c}`") for c in carry], scored(F.coalesce(F.col(text_col), F.lit(""))).alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, id_fold(F.col("doc_id"), 5) != 0)
    return (score(docs, model, ["doc_id"]).withColumns({"held_out": id_fold(F.col("doc_id"), 5) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})
            .select("doc_id", "held_out", "score", "predicted"))
