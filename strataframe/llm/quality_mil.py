"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded: shares of character kinds and of each
ASCII punctuation mark, word lengths, and how often words recur at short distances, then a learned hidden layer.
Gated attention weighs the passages, the weighted sum is the document's representation, and a logistic unit scores
it. All weights are learned together from document labels.

Training uses a bounded sample of labelled documents (``PER_CLASS`` of each label); scoring is one Arrow pass over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strataframe.llm import bytescan as B
from strataframe.llm.labelled import clean_labels, sample_per_class
from strataframe.llm.names import fresh
from strataframe.plans.storage import materialise

PASSAGE_WORDS = 64
PER_CLASS = 1_500  # labelled documents of each class that training may use
HIDDEN, GATE = 24, 12
STEPS = 300
LAGS = 8

_KINDS = np.full(256, 5, np.intp)  # 5: parts of non-ASCII characters
_KINDS[:128] = 6
_KINDS[ord("a") : ord("z") + 1] = 0
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
_KINDS[ord(" ")], _KINDS[ord("\n")] = 3, 4
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS[_MARKS] = 7 + np.arange(len(_MARKS))
N_KINDS = 7 + len(_MARKS)
N_FEATURES = N_KINDS + LAGS + 3


def passages(block: B.Block, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the offsets of the texts counted in passages; every text has one at least."""
    spans = B.words(block)
    n = len(block.offsets) - 1
    per_text = np.bincount(spans.text, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(per_text)])
    per_bag = np.maximum(1, -(-per_text // size))
    bags = np.concatenate([[0], np.cumsum(per_bag)])
    passage = bags[spans.text] + (np.arange(len(spans.text)) - first_word[spans.text]) // size
    total = int(bags[-1])

    begins = np.zeros(total, np.int64)  # where each passage begins in the block's bytes; texts are covered whole
    begins[passage[::-1]] = spans.start[::-1]
    begins[bags[:-1]] = block.offsets[:-1]
    of_byte = np.repeat(np.arange(total), np.diff(np.append(begins, len(block.data))))
    kinds = np.bincount(of_byte * N_KINDS + _KINDS[block.data], minlength=total * N_KINDS).reshape(total, N_KINDS)
    n_bytes = np.maximum(1, kinds.sum(1, keepdims=True))

    n_words = np.bincount(passage, minlength=total)
    h = B.span_hashes(block.data, spans.start, spans.end)
    rows = [np.sqrt(kinds / n_bytes)]
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (spans.text[lag:] == spans.text[:-lag]) if lag < len(h) else False
        rows.append((np.bincount(passage, same, total) / np.maximum(1, n_words))[:, None])
    length = (spans.end - spans.start).astype(float)
    mean = np.bincount(passage, length, total) / np.maximum(1, n_words)
    square = np.bincount(passage, length**2, total) / np.maximum(1, n_words)
    rows += [np.log1p(x)[:, None] for x in (mean, np.sqrt(np.maximum(0, square - mean**2)), n_words)]
    return np.hstack(rows).astype(np.float32), bags


class AttentionModel:
    """Gated attention over encoded passages; plain numpy, trained by Adam on whole batches."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.weights: dict[str, np.ndarray] = {}
        self.mean = np.zeros(N_FEATURES, np.float32)
        self.scale = np.ones(N_FEATURES, np.float32)
        self.base_rate = 0.5

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        hidden = np.tanh(((x - self.mean) * self.scale) @ w["enc"] + w["enc_b"])
        tanh, gate = np.tanh(hidden @ w["v"]), 1 / (1 + np.exp(-(hidden @ w["u"])))
        raw = (tanh * gate) @ w["att"]
        starts = bags[:-1]
        top = np.maximum.reduceat(raw, starts)
        e = np.exp(raw - np.repeat(top, np.diff(bags)))
        attention = e / np.repeat(np.add.reduceat(e, starts), np.diff(bags))
        pooled = np.add.reduceat(attention[:, None] * hidden, starts, axis=0)
        logit = pooled @ w["out"] + w["out_b"][0]
        return {"hidden": hidden, "tanh": tanh, "gate": gate, "attention": attention, "pooled": pooled, "logit": logit}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(bags) - 1, self.base_rate)
        return 1 / (1 + np.exp(-np.clip(self._forward(x, bags)["logit"].astype(float), -30, 30)))

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = STEPS) -> AttentionModel:
        """With no rows, or rows of one label only, the score stays the smoothed share of label 1."""
        self.base_rate = float((y.sum() + 1) / (len(y) + 2))
        if not 0 < y.sum() < len(y):
            return self
        self.mean = x.mean(0)
        self.scale = 1 / (x.std(0) + 1e-3)
        shapes = {
            "enc": (N_FEATURES, HIDDEN), "enc_b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE),
            "att": (GATE,), "out": (HIDDEN,), "out_b": (1,),
        }
        self.weights = {k: self.rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32) for k, shape in shapes.items()}
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.weights.items()}
        # label 1 carries 0.7 of the loss whatever the sample's balance: losing clean documents costs more
        weight = np.where(y == 1, 0.7 / y.mean(), 0.3 / (1 - y.mean())) / len(y)
        for step in range(1, steps + 1):
            for k, g in self._gradients(x, bags, y, weight).items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
                self.weights[k] -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x, bags)
        count = np.diff(bags)
        d_logit = ((1 / (1 + np.exp(-f["logit"])) - y) * weight).astype(np.float32)
        d_pooled = np.repeat(d_logit[:, None] * w["out"], count, axis=0)
        d_attention = (d_pooled * f["hidden"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["attention"] * d_attention, bags[:-1]), count)
        d_raw = f["attention"] * (d_attention - mean)
        d_joint = d_raw[:, None] * w["att"]
        d_tanh = d_joint * f["gate"] * (1 - f["tanh"] ** 2)
        d_gate = d_joint * f["tanh"] * f["gate"] * (1 - f["gate"])
        d_hidden = f["attention"][:, None] * d_pooled + d_tanh @ w["v"].T + d_gate @ w["u"].T
        d_enc = d_hidden * (1 - f["hidden"] ** 2)
        out = {
            "enc": ((x - self.mean) * self.scale).T @ d_enc, "enc_b": d_enc.sum(0), "v": f["hidden"].T @ d_tanh,
            "u": f["hidden"].T @ d_gate, "att": (f["tanh"] * f["gate"]).T @ d_raw, "out": f["pooled"].T @ d_logit,
            "out_b": d_logit.sum(keepdims=True),
        }
        return {k: g + (1e-4 * w[k] if k in ("enc", "v", "u", "out") else 0) for k, g in out.items()}


def _encode_udf():
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            ends, parts = [0], []
            for block in B.blocks(column):
                x, bags = passages(block)
                parts.append(x.ravel())
                ends += list(ends[-1] + bags[1:] * N_FEATURES)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return encode


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text") -> AttentionModel:
    """Train on labelled documents: ``labels`` has doc_id and quality (0 or 1).

    At most ``per_class`` documents of each label are used; their passages come to the driver as features.
    """
    chosen = materialise(sample_per_class(clean_labels(labels, "quality"), per_class), "sample")
    chosen = chosen.select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    table = rows.select("_id", "label", _encode_udf()(F.col("_text")).alias("x")).toArrow().combine_chunks()
    if table.num_rows == 0:
        return AttentionModel()
    order = np.argsort(table["_id"].to_numpy(), kind="stable")
    y = table["label"].to_numpy()[order].astype(np.float32)
    bags = [np.asarray(x.values, np.float32).reshape(-1, N_FEATURES) for x in (table["x"][int(i)] for i in order)]
    return AttentionModel().fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def quality_score(model: AttentionModel, docs: DataFrame, text: str = "text") -> Column:
    """A column with the quality of each whole text (0 to 1). Null and empty texts are a bag of one empty passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [shared.value.score(*passages(block)) for block in B.blocks(column)]
            # six places: how a batch is cut must not show in the last bits of equal texts' scores
            yield pa.array(np.round(np.concatenate(parts), 6) if parts else np.zeros(0), pa.float64())

    return score.asNondeterministic()(F.col(text))  # so marked, it is not run twice for a filter on it


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns.

    Without labels of both kinds nothing can be told apart and all stay. Repeated rows get equal scores.
    """
    model = fit_quality(docs, labels, text=text)
    if not model.weights:
        return docs
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, quality_score(model, docs, text)).filter(F.col(score) >= threshold).drop(score)
