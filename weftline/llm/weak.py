"""A quality classifier from heuristic labellers: expectation-maximisation, then a hashed linear scorer.

Each labeller votes for good or bad quality, or abstains. How many documents
have which pattern of votes is counted over the whole corpus; patterns are at
most 3 to the number of labellers, so expectation-maximisation runs on the
counts and is exact at any size. It estimates the labellers' accuracies and the
share of good documents, without any label. The posterior of a document's
pattern is its label for the linear scorer, which judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import chunks, discard, materialise
from .quality import counts
from .tokens import Words

#: Documents of each posterior class that the scorer is fitted on at most, in the order of a hash.
SAMPLE_PER_CLASS = 800
#: A document is kept at this probability of good quality or more: only likely junk goes.
KEEP_AT = 0.2
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Votes of each kind that a labeller has beforehand in either class: labellers are better than chance.
PSEUDO = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])


def _shares(texts: list[str], words: Words) -> dict[str, np.ndarray]:
    n_words, word_chars, symbols, dup_lines, repeated = counts(texts, words)
    n, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    bounds = np.concatenate([[0], words.text_end + 1])
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    cp = words.cp
    upper = per_text((cp >= 65) & (cp <= 90))
    letter = per_text(((cp >= 97) & (cp <= 122)) | (cp >= 0xC0)) + upper
    per_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.first])
    last = cp[words.end - 1] if len(words) else cp[:0]
    size = words.end - words.start
    end = (last == 46) | (last == 33) | (last == 63)
    return {
        "n": n_words,
        "symbols": symbols / n,
        "odd_ends": per_word(np.isin(last, [35, 36, 37, 38, 42])) / n,
        "upper": upper / np.maximum(letter, 1),
        "shouts": per_text(cp == 33) / n,
        "bars": per_text(cp == 124) / n,
        "lone_marks": per_word((size == 1) & (last < 128) & ~((last >= 48) & (last <= 57)) & ~(((last | 32) >= 97) & ((last | 32) <= 122))) / n,
        "repeated": repeated / n,
        "new_words": np.array([len(set(x)) for x in np.split(words.hashes(), words.first[1:-1])]) / n if len(words) else np.zeros(len(texts)),
        "sentences": per_word(end) / n,
        "letters": (letter + per_text((cp >= 48) & (cp <= 57))) / chars,
    }


#: Labellers: a share, where it votes for bad, and where for good (None: never).
LABELLERS = (
    ("symbols", lambda s: s["symbols"] > 0.25, None),
    ("odd_ends", lambda s: s["odd_ends"] > 0.2, None),
    ("upper", lambda s: s["upper"] > 0.5, None),
    ("shouts", lambda s: s["shouts"] > 0.3, None),
    ("bars", lambda s: s["bars"] > 0.2, None),
    ("lone_marks", lambda s: s["lone_marks"] > 0.15, None),
    ("repeated", lambda s: s["repeated"] > 0.2, None),
    ("new_words", lambda s: (s["n"] >= 20) & (s["new_words"] < 0.12), lambda s: (s["n"] >= 20) & (s["new_words"] > 0.5)),
    ("sentences", lambda s: (s["n"] >= 20) & (s["sentences"] < 0.005), lambda s: (s["sentences"] > 0.02) & (s["sentences"] < 0.6) & (s["new_words"] > 0.3)),
    ("letters", lambda s: s["letters"] < 0.7, lambda s: (s["letters"] > 0.85) & (s["upper"] < 0.3) & (s["symbols"] < 0.1)),
)


def vote(texts: list[str], words: Words) -> np.ndarray:
    """Each text's pattern of votes, a number with a ternary digit for each labeller."""
    s = _shares(texts, words)
    pattern = np.zeros(len(texts), np.int64)
    for _, bad, good in LABELLERS:
        v = np.full(len(texts), ABSTAIN)
        if good is not None:
            v[good(s)] = GOOD
        v[bad(s)] = BAD
        pattern = pattern * 3 + np.where(s["n"] == 0, ABSTAIN, v)
    return pattern


def digits(pattern: np.ndarray) -> np.ndarray:
    """Votes of patterns, a column for each labeller."""
    k = len(LABELLERS)
    return pattern[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


@dataclass(frozen=True)
class LabelModel:
    """rates: (class, labeller, vote), each class's share of votes; prior: share of good documents."""

    rates: np.ndarray
    prior: float

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good quality; to abstain is an outcome like the votes, as most labellers only ever vote for bad."""
        if not len(pattern):
            return np.zeros(0)
        log = self.joint(pattern)
        return linear.sigmoid(log[1] - log[0])

    def joint(self, pattern: np.ndarray) -> np.ndarray:
        """Log probability of each class together with each pattern."""
        votes = digits(pattern)
        log = [np.log(self.rates[c][np.arange(votes.shape[1]), votes]).sum(axis=1) for c in (0, 1)]
        return np.array(log) + np.log([1 - self.prior, self.prior])[:, None]

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        p = np.array([1 - self.prior, self.prior])[:, None, None] * self.rates
        right = p[0, :, BAD] + p[1, :, GOOD]
        return dict(zip([x[0] for x in LABELLERS], (right / (right + p[0, :, GOOD] + p[1, :, BAD])).tolist(), strict=True))


def estimate(pattern: np.ndarray, n: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from pattern counts; it starts from bad for any vote for bad.

    Each round raises the likelihood times the prior that PSEUDO stands for.
    """
    votes, total = digits(pattern), n.sum()
    good = np.where((votes == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        rates = np.zeros((2, votes.shape[1], 3))
        for c, weight in enumerate((n * (1 - good), n * good)):
            for v in range(3):
                rates[c, :, v] = (weight[:, None] * (votes == v)).sum(axis=0)
        prior = float(np.clip((n * good).sum() / max(total, 1), 0.01, 0.99))
        rates += PSEUDO[:, None, :]
        model = LabelModel(rates / rates.sum(axis=2, keepdims=True), prior)
        last, good = good, model.posterior(pattern)
        if np.abs(last - good).max(initial=0) < 1e-9:
            break
    return model


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(vote(texts, Words(texts)))], names=["doc_id", "mark", "pattern"])


def _judge(labels: LabelModel, model: linear.Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            pattern = vote(texts, words)
            posterior = labels.posterior(pattern)
            score = posterior if model is None else model.probability(linear.buckets(words, True))
            score = np.where(np.diff(words.first) == 0, 0.0, score)
            n_bad = (digits(pattern) == BAD).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bad), pa.array(posterior), pa.array(score), pa.array(score >= KEEP_AT)], names=["doc_id", "n_bad_votes", "posterior", "score", "kept"])

    return run


def fit(docs: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[LabelModel, linear.Model | None]:
    """The label model over all documents, and the scorer fitted on a bounded sample of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    votes = materialise(marked.mapInArrow(_votes, f"doc_id {kind}, mark long, pattern long"), "weak-votes")
    seen = votes.groupBy("pattern").count().orderBy("pattern").collect()
    pattern, n = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    labels = estimate(pattern, n)
    table = votes.sparkSession.createDataFrame(list(zip(pattern.tolist(), labels.posterior(pattern).tolist(), strict=True)), "pattern long, target double")
    known = votes.join(F.broadcast(table), "pattern").select("doc_id", "mark", "target").distinct()  # at most 3^10 patterns
    rank = F.xxhash64("doc_id", F.lit(13))
    picked = [known.filter(side).orderBy(rank, "doc_id", "mark").limit(per_class) for side in ("target < 0.5", "target >= 0.5")]
    rows = linear.one_text_each(marked.join(F.broadcast(picked[0].union(picked[1])), ["doc_id", "mark"]))
    model = linear.fit(rows.select("text", "target", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(4)).alias("fold")), labels.prior, repeats=True)
    discard(votes)
    return labels, model


def judge(docs: DataFrame, labels: LabelModel, model: linear.Model | None) -> DataFrame:
    """doc_id, n_bad_votes, posterior, score (probability of good quality), kept for every row of docs (doc_id, text).

    All labellers abstain on null and empty texts, which score 0. If all
    documents are of one class, the posterior is the score. Repeated rows get
    equal results, an empty table none. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judge(labels, model), f"doc_id {kind}, n_bad_votes long, posterior double, score double, kept boolean")
