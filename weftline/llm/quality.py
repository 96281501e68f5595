"""Quality rules: fixed base rules, then a calibrated hashed linear model trained on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .linear import Model, buckets, fit, one_text_each
from .tokens import Words, mix, windows

#: Labelled rows of each class that the model is fitted on at most, taken in the order of a hash.
SAMPLE_PER_CLASS = 800
#: A document is kept at this probability of good quality or more.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_GAPS = " \t\n\x0b\x0c\r"

VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model of quality from labels (doc_id, quality 0 or 1); None if a class is missing.

    Other labels are ignored. Of rows that repeat a labelled doc_id one is used.
    """
    prior = labels.agg(F.avg(F.when(F.col("quality").isin(0, 1), F.col("quality")))).first()[0]  # over all labels
    rank = F.xxhash64("doc_id", F.lit(7))
    picked = [labels.filter(F.col("quality") == q).select("doc_id", F.col("quality").alias("target")).orderBy(rank, "doc_id").limit(per_class) for q in (0, 1)]
    # two classes of per_class rows: small enough to broadcast at any size of the corpus
    rows = one_text_each(docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id"))
    return fit(rows.select("text", "target", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)).alias("fold")), prior)


def counts(texts: list[str], words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = np.diff(words.first)
    chars = np.diff(np.concatenate([[0], np.cumsum(words.end - words.start)])[words.first])
    bounds = np.concatenate([[0], words.text_end + 1])
    symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[np.minimum(words.cp, 127)])])[bounds])
    dup_lines = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(_GAPS)]
        dup_lines.append(len(lines) - len(set(lines)))
    runs, at = windows(words.hashes(), words.doc, REPEAT_WINDOW)
    runs = runs ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(runs)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    repeated = np.zeros(len(texts), np.int64)
    if len(again):
        begin = at[np.isin(runs, again)]
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + REPEAT_WINDOW, -1)
        repeated = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])[words.first])
    return [n, chars, symbols, np.array(dup_lines, np.int64), repeated]


def _judge(model: Model | None, column: int, whole_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, column):
            words = Words(texts)
            found = counts(texts, words)
            failed = (found[0] < MIN_WORDS) | (100 * found[4] > MAX_REPEAT_PERCENT * found[0])
            p = np.ones(len(texts)) if model is None else model.probability(buckets(words))
            kept = ~failed & (p >= KEEP_AT)
            if whole_rows:
                yield part.filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found), pa.array(failed), pa.array(kept), pa.array(p)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return run


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the model's probability for every row of docs (doc_id, text).

    Null and empty texts have no words and fail the base rules. Without a model
    the base rules alone decide. Rows are judged one by one: repeated rows get
    the same verdict, an empty table none, and other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judge(model, 1, False), f"doc_id {kind}, {VERDICT}")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names; nothing is shuffled."""
    return docs.mapInArrow(_judge(model, docs.columns.index("text"), True), docs.schema)
