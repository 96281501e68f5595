"""Word count, TF-IDF inverted index and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import words
from weftline.sources import io

#: Scores are rounded to this many digits before ranking, so that equal scores tie.
DIGITS = 9


def word_count(docs: DataFrame, text: str = "text", count: str = "count") -> DataFrame:
    """Each word (in the text's column) and how often it occurs, by count, then word."""
    found = docs.select(F.explode(words(F.col(text))).alias(text))
    return found.groupBy(text).agg(F.count("*").alias(count)).orderBy(count, text)


def _dealt(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """_doc and _text; all rows of a document are in one partition."""
    return io.deal(docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")), ["_doc"])


def _counts(texts: DataFrame, longer_than: int = 0) -> DataFrame:
    """_doc, _word, _n of every word in every document of dealt texts, without another shuffle."""
    found = texts.select("_doc", F.explode(words(F.col("_text"))).alias("_word"))
    if longer_than:
        found = found.filter(F.length("_word") > longer_than)
    return found.groupBy("_doc", "_word").agg(F.count("*").alias("_n"))


def _ordered(ranked: DataFrame, *order: str | Column) -> DataFrame:
    """Sorted rows; the shuffle before keeps the sample, by which the sort finds its ranges, from making the rows another time."""
    return ranked.repartition("_doc", "_word").orderBy(*order)


def inverted_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", result: str = "tf_idf", top: int = 3) -> DataFrame:
    """For each word the documents with the highest tf * idf, ties by document; by word, then score descending.

    tf is the word's share of the document's words; idf the natural logarithm of
    all rows of docs over the documents with the word.
    """
    texts = _dealt(docs, doc, text)
    counts = _counts(texts).withColumn("_all", F.sum("_n").over(Window.partitionBy("_doc")))
    # one row; this reads the texts, so that it shares their exchange and the source is read once
    n = texts.agg(F.sum(F.when(F.length("_text") < 0, 0).otherwise(1)).alias("_docs"))
    spread = counts.repartition(io.parts(docs), "_word").withColumn("_df", F.count("*").over(Window.partitionBy("_word")))
    score = F.round(F.col("_n") / F.col("_all") * F.ln(F.col("_docs") / F.col("_df")), DIGITS)
    ranked = spread.crossJoin(F.broadcast(n)).select("_doc", "_word", score.alias("_score"))
    best = Window.partitionBy("_word").orderBy(F.desc("_score"), "_doc")
    ranked = ranked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    return _ordered(ranked, "_word", F.desc("_score"), "_doc").select(F.col("_doc").alias(doc), F.col("_word").alias(text), F.col("_score").alias(result))


def pmi(docs: DataFrame, doc: str = "doc_id", text: str = "text", result: str = "pmi", top: int = 10, longer_than: int = 4, least: int = 2) -> DataFrame:
    """For each document the words with the highest pointwise mutual information, ties by word; by document, then score descending.

    Only words of more than `longer_than` characters that a document has `least`
    times or more are counted, in all of the sums.
    """
    counts = _counts(_dealt(docs, doc, text), longer_than).filter(F.col("_n") >= least)
    counts = counts.repartition(io.parts(docs), "_word")
    # by document first, which reads all columns, so that both uses of the counts share one exchange and texts are cut into words once
    whole = counts.groupBy("_doc").agg(F.sum("_n").alias("_in_doc")).agg(F.sum("_in_doc").alias("_all"))  # one row
    joined = counts.withColumn("_of_word", F.sum("_n").over(Window.partitionBy("_word"))).withColumn("_in_doc", F.sum("_n").over(Window.partitionBy("_doc"))).crossJoin(F.broadcast(whole))
    score = F.round(F.ln((F.col("_n") / F.col("_in_doc")) / (F.col("_of_word") / F.col("_all"))), DIGITS)
    ranked = joined.select("_doc", "_word", score.alias("_score"))
    best = Window.partitionBy("_doc").orderBy(F.desc("_score"), "_word")
    ranked = ranked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    return _ordered(ranked, "_doc", F.desc("_score"), "_word").select(F.col("_doc").alias(doc), F.col("_word").alias(text), F.col("_score").alias(result))
