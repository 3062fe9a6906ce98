"""Quality rules: exact text measures with fixed limits, then a calibrated n-gram model.

The model is a logistic regression over hashed word (one and two words) and character (three to five characters)
n-grams, trained on a bounded sample of labelled rows and calibrated on rows kept out of training. Measures and
model are computed over whole texts in one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strataframe.llm import bytescan as B
from strataframe.llm.labelled import clean_labels, sample_per_class
from strataframe.plans.storage import materialise

BUCKETS = 1 << 14  # for each kind of n-gram
PER_CLASS = 600  # labelled rows of each class that training and calibration may use
CALIBRATION = 4  # every so manieth of them calibrates
STEPS, BATCH = 300, 64
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_QUALITY = 0.3  # calibrated probability of label 1 from which the model keeps a text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


class Measures(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def measures(block: B.Block) -> Measures:
    """Exact counts per text.

    Words are runs of anything but ASCII white space; word_chars counts their code points. n_dup_lines counts lines
    (split at line feeds) that hold a word and equal an earlier line. n_repeat_words counts the words lying in any
    three-word window that occurs twice or more in the text, the first occurrence included.
    """
    data, offsets = block.data, block.offsets
    spans = B.words(block)
    n = len(offsets) - 1
    chars = B.sums((~B.WHITE[data] & ((data & 0xC0) != 0x80)), offsets)
    symbols = B.sums(SYMBOLS[data], offsets)
    lines = B.runs(data != ord("\n"), offsets)
    with_word = np.searchsorted(spans.start, lines.end) > np.searchsorted(spans.start, lines.start)
    h = B.span_hashes(data, lines.start[with_word], lines.end[with_word])
    text = lines.text[with_word]
    again = _seen_before(h, text)
    dup_lines = np.bincount(text[again], minlength=n)

    windows, first = B.window_hashes(B.span_hashes(data, spans.start, spans.end), spans.text, 3)
    twice = first[_occurs_again(windows, spans.text[first])]
    covered = np.zeros(len(spans.text) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + 3, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return Measures(
        np.bincount(spans.text, minlength=n), chars, symbols, dup_lines, np.bincount(spans.text, inside, n).astype(np.int64)
    )


def _grouped(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (text, hash) together, earlier places first, and whether each equals the one before."""
    key = B.mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    return order, same


def _seen_before(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    order, same = _grouped(h, text)
    return order[same]


def _occurs_again(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    order, same = _grouped(h, text)
    either = same.copy()
    either[:-1] |= same[1:]
    return order[either]


def ngrams(block: B.Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams and their texts' offsets, for each kind: words, word pairs, 3 to 5 characters."""
    n = len(block.offsets) - 1
    spans = B.words(block._replace(data=B.LOWER[block.data]))
    h = B.span_hashes(B.LOWER[block.data], spans.start, spans.end)
    top = np.uint64(64 - 14)
    out = [((h >> top).astype(np.int32), np.searchsorted(spans.text, np.arange(n + 1)))]
    pairs, first = B.window_hashes(h, spans.text, 2)
    out.append(((pairs >> top).astype(np.int32), np.searchsorted(spans.text[first], np.arange(n + 1))))
    code, bounds = B.chars(block)
    text = np.repeat(np.arange(n), np.diff(bounds))
    h = np.zeros(len(code), np.uint64)
    for order in range(1, 6):
        size = len(code) - order + 1
        if size <= 0:
            out += [(np.zeros(0, np.int32), np.zeros(n + 1, np.int64))] * (5 - max(3, order) + 1)
            break
        h = (h[:size] + code[order - 1 :] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if order >= 3:
            whole = text[:size] == text[order - 1 :]
            out.append(((h >> top).astype(np.int32)[whole], np.searchsorted(text[:size][whole], np.arange(n + 1))))
    return out


N_KINDS = 5


class NgramModel(NamedTuple):
    """Weights per kind and bucket, an intercept, and the calibration's slope and shift; no weights: keep all."""

    weight: np.ndarray | None
    bias: float
    slope: float
    shift: float

    def probability(self, block: B.Block) -> np.ndarray:
        """Calibrated probability of label 1; a text's evidence of a kind is the mean weight of its n-grams."""
        logit = np.full(len(block.offsets) - 1, self.bias)
        for kind, (bucket, bounds) in enumerate(ngrams(block)):
            logit += B.sums(self.weight[kind][bucket], bounds) / np.maximum(1, np.diff(bounds))
        p = 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))
        return np.round(p, 6)  # how a batch is cut must not show in the last bits of equal texts' scores


def _features_udf():
    @F.arrow_udf("struct<place:array<int>,share:array<float>>")
    def features(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            places, shares, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
            for block in B.blocks(column):
                kinds = ngrams(block)
                for i in range(block.last - block.first):
                    size = 0
                    for kind, (bucket, bounds) in enumerate(kinds):
                        found, counts = np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True)
                        places.append((found + kind * BUCKETS).astype(np.int32))
                        shares.append((counts / max(1, counts.sum())).astype(np.float32))
                        size += len(found)
                    ends.append(ends[-1] + size)
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (places, shares)]
            yield pa.StructArray.from_arrays(lists, ["place", "share"])

    return features


def fit_ngrams(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text") -> NgramModel:
    """Train and calibrate on at most ``per_class`` labelled rows of each class (``labels``: doc_id, quality).

    Their hashed n-grams come to the driver: at most ``N_KINDS * BUCKETS`` numbers a row. Without labels of both
    kinds there is nothing to learn, and the model keeps every text.
    """
    chosen = materialise(sample_per_class(clean_labels(labels, "quality"), per_class), "sample")
    chosen = chosen.select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    table = rows.select("_id", "label", _features_udf()(F.col("_text")).alias("f")).toArrow().combine_chunks()
    y = table["label"].to_numpy().astype(float) if table.num_rows else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return NgramModel(None, 0.0, 1.0, 0.0)
    order = np.argsort(table["_id"].to_numpy(), kind="stable")
    features = [table["f"][int(i)] for i in order]
    place = [np.asarray(f["place"].values) for f in features]
    share = [np.asarray(f["share"].values) for f in features]
    y = y[order]
    spare = np.zeros(len(y), bool)
    for label in (0, 1):  # the same share of both classes
        spare[np.flatnonzero(y == label)[CALIBRATION - 1 :: CALIBRATION]] = True
    enough = len(set(y[spare])) == 2
    fitted = ~spare if enough else np.ones(len(y), bool)
    weight, bias = _logistic([p for p, f in zip(place, fitted) if f], [s for s, f in zip(share, fitted) if f], y[fitted])
    flat = weight.ravel()
    logit = np.array([flat[p] @ s for p, s in zip(place, share)]) + bias
    slope, shift = _calibrate(logit[spare], y[spare]) if enough else (1.0, 0.0)
    return NgramModel(weight, bias, slope, shift)


def _logistic(
    place: list, share: list, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, penalty: float = 1e-5, seed: int = 7
) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows by Adam on balanced small batches."""
    rng = np.random.default_rng(seed)
    classes = [np.flatnonzero(y == label) for label in (0, 1)]
    w, m, v = (np.zeros(N_KINDS * BUCKETS) for _ in range(3))
    bias = 0.0
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(c, batch // 2) for c in classes])
        bounds = np.concatenate([[0], np.cumsum([len(place[i]) for i in rows])])
        at, value = np.concatenate([place[i] for i in rows]), np.concatenate([share[i] for i in rows])
        logit = B.sums(w[at] * value, bounds) + bias
        error = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
        g = np.bincount(at, np.repeat(error, np.diff(bounds)) * value, len(w)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 0.5 * error.sum()
    return w.reshape(N_KINDS, BUCKETS), bias


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and shift of the logit, with smoothed targets, by Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logit, np.ones_like(logit)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * (beta - np.array([1.0, 0.0])))
        beta = beta - np.clip(step, -1, 1)
    return float(max(beta[0], 1e-3)), float(beta[1])


REPORT = T.StructType(
    [T.StructField(k, T.LongType()) for k in Measures._fields] + [T.StructField("quality", T.DoubleType())]
)


def measured(model: NgramModel, docs: DataFrame, text: str = "text") -> Column:
    """A struct of the measures and the model's probability (1 where nothing was learned) for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(REPORT)
    def measure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in columns:
            parts = [[np.zeros(0, np.int64)] for _ in Measures._fields] + [[np.zeros(0)]]
            for block in B.blocks(column):
                found = measures(block)
                keep = np.ones(len(found.n_words)) if model.weight is None else model.probability(block)
                for values, new in zip(parts, (*found, keep)):
                    values.append(new)
            arrays = [pa.array(np.concatenate(x), f.dataType.typeName() == "long" and pa.int64() or pa.float64()) for x, f in zip(parts, REPORT)]
            yield pa.StructArray.from_arrays(arrays, REPORT.names)

    return measure.asNondeterministic()(F.col(text))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, quality and kept.

    base_failed: under ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PERCENT`` percent of the words repeated. kept:
    not failed and quality at least ``MIN_QUALITY``. Null and empty texts count 0 throughout and fail. Repeated rows
    get equal results; an empty table gives no rows.
    """
    model = fit_ngrams(docs, labels, text=text)
    rows = docs.select("doc_id", measured(model, docs, text).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), (~failed & (F.col("quality") >= MIN_QUALITY)).alias("kept"))
