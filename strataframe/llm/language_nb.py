"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all n-grams of one to three characters over the whole training table, hashed to ``BUCKETS``, make a matrix
of log-probabilities (languages x buckets), which is broadcast; its size does not depend on the documents. Texts are
scored in sparse batches: each n-gram gathers its row of the matrix, and rows are summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strataframe.llm import bytescan as B

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
UNKNOWN = "und"
LETTER = r"\p{L}"


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray  # log share of each language's documents
    weight: np.ndarray  # (BUCKETS, languages) log-probabilities


def ngrams(block: B.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of every n-gram that lies in one text, and the texts' offsets among them."""
    code, bounds = B.chars(block)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = np.zeros(len(code), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(code) - order + 1
        if n <= 0:
            break
        h = (h[:n] + code[order - 1 :] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if order in ORDERS:
            whole = text[:n] == text[order - 1 :]
            bucket = (h >> np.uint64(64 - 14)).astype(np.int32)[whole]
            yield bucket, np.searchsorted(text[:n][whole], np.arange(len(bounds)))


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows, summed within each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column(1).dictionary_encode()
            names, code = languages.dictionary.to_pylist(), languages.indices.to_numpy()
            for name in names:
                totals.setdefault(name, np.zeros(BUCKETS, np.int64))
            for block in B.blocks(batch.column(0)):
                own = code[block.first : block.last]
                for bucket, bounds in ngrams(block):
                    key = np.repeat(own, np.diff(bounds)) * BUCKETS + bucket
                    found = np.bincount(key, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                    for i in np.unique(own):
                        totals[names[i]] += found[i]
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([name] * len(used)), pa.array(used, pa.int32()), pa.array(counts[used])], ["lang", "bucket", "n"])

    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row whose language is not null. What reaches the driver is languages x buckets counts."""
    known = docs.filter(F.col(lang).isNotNull())
    shares = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    counts = np.zeros((BUCKETS, len(languages)))
    found = ngram_counts(known, text, lang).toArrow()
    column = {name: i for i, name in enumerate(languages)}
    place = np.array([column[x] for x in found["lang"].to_pylist()], np.intp)
    counts[found["bucket"].to_numpy(), place] = found["n"].to_numpy()
    total = np.array([shares[x] for x in languages], float)
    weight = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * BUCKETS)
    return Model(languages, np.log(total / total.sum()), weight.astype(np.float32))


def predict_language(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A struct of lang_pred and score (posterior of lang_pred, 0 to 1) for each whole text.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned. Ties go
    to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, prior, weight = shared.value
        names = pa.array([*languages, UNKNOWN])
        for column in columns:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for block in B.blocks(column):
                n = block.last - block.first
                total = np.tile(prior, (n, 1))
                for bucket, bounds in ngrams(block):
                    for k in range(len(languages)):
                        total[:, k] += B.sums(weight[:, k][bucket], bounds)
                if languages:
                    top = total.argmax(1)
                    score.append(np.round(1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 6))
                else:
                    top = np.zeros(n, np.int64)
                    score.append(np.zeros(n))
                best.append(top)
            yield pa.StructArray.from_arrays(
                [names.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(score))], ["lang_pred", "score"]
            )

    found = predict.asNondeterministic()(F.col(text))
    return F.when(F.col(text).rlike(LETTER), found).otherwise(F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
