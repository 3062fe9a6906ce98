"""Toxicity by maximum-scoring segment search over token log-odds.

Tokens (runs of letters and digits, case folded) get the log-odds of standing in a toxic rather than another labelled
text, shrunk by a Dirichlet prior centred on the pooled rate and cut back to what the evidence bears out. Less a
constant drift, a text is then a walk that falls except where toxic tokens cluster; one linear scan finds all its
maximal scoring segments. How high segments climb by chance in texts of a given length follows an extreme-value law,
fitted on texts labelled as clean; what segments score beyond it adds up to the text's evidence, which a logistic
step turns into a probability.

Training uses a bounded sample of labelled rows (``PER_CLASS`` of each label), so that their ids can be broadcast and
no text is shuffled. Log-odds are counted and scored in Spark; only tokens whose log-odds stand out are kept, the
``VOCABULARY`` most telling ones at most. The calibration uses some of the rows (``CALIBRATION`` of each label), scored
with log-odds learned on the other half of them.
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

VOCABULARY = 100_000  # tokens with a score of their own; bounds what is broadcast
PER_CLASS = 10_000  # labelled rows of each class that training may use; bounds a broadcast of their ids
CALIBRATION = 2_000  # of these, the rows of each class that the calibration uses
PRIOR = 1.0  # pseudo-rows per token, split between the classes by their sizes
CAUTION = 2.0  # standard errors taken off a log-odds towards 0
DRIFT = 0.3
LIMIT = 5.0
BINS = 256  # of the token score histogram, over [-LIMIT - DRIFT, LIMIT]

_LETTERS = np.zeros(256, bool)
_LETTERS[[b for b in range(128) if chr(b).isalnum()]] = True
_LETTERS[128:] = True


def tokens(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and the texts' offsets among tokens. Upper case is folded for ASCII and Latin letters."""
    data = B.LOWER[block.data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    data[capital] += 0x20
    spans = B.runs(_LETTERS[data], block.offsets)
    return B.span_hashes(data, spans.start, spans.end).view(np.int64), np.searchsorted(spans.text, np.arange(len(block.offsets)))


def segments(scores: np.ndarray) -> list[float]:
    """Scores of all maximal scoring segments of one text (Ruzzo and Tompa's linear scan over positive tokens)."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    after = total[positive].tolist()
    before = (total[positive] - scores[positive]).tolist()
    low: list[float] = []  # running sum before each candidate, and at its end
    high: list[float] = []
    below: list[int] = []  # nearest earlier candidate that begins lower, or -1
    for left, right in zip(before, after):
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = below[j]
            if j < 0 or high[j] >= right:
                break
            left = low[j]
            del low[j:], high[j:], below[j:]
        low.append(left)
        high.append(right)
        below.append(j)
    return [h - x for x, h in zip(low, high)]


class Lexicon:
    """Scores by token hash; all other tokens score minus the drift."""

    def __init__(self, token: np.ndarray, score: np.ndarray):
        order = np.argsort(token)
        self.token, self.score = token[order], score[order].astype(np.float32)
        self.present = np.zeros(1 << 20, bool)  # by 20 bits of the hash, to look up few others in vain
        self.present[self._bits(self.token)] = True

    @staticmethod
    def _bits(token: np.ndarray) -> np.ndarray:
        return (token >> 40) & ((1 << 20) - 1)

    def __call__(self, token: np.ndarray) -> np.ndarray:
        out = np.full(len(token), -DRIFT, np.float32)
        likely = np.flatnonzero(self.present[self._bits(token)])
        if len(likely):
            place = np.minimum(np.searchsorted(self.token, token[likely]), len(self.token) - 1)
            hit = self.token[place] == token[likely]
            out[likely[hit]] = self.score[place[hit]]
        return out


class Model(NamedTuple):
    """Token scores, the extreme-value law's decay and scale, and the logistic step; no lexicon: a constant."""

    lexicon: Lexicon | None
    decay: float
    scale: float
    slope: float
    shift: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))

    def evidence(self, n_tokens: int, found: list[float]) -> float:
        """What the segments score beyond what chance reaches in a text of this length, in nats."""
        chance = np.log1p(self.scale * max(1, n_tokens))
        return float(sum(max(0.0, self.decay * s - chance) for s in found))


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """A token's score from the number of rows of each class that hold it."""
    share = n_toxic / (n_toxic + n_clean)
    a, b = toxic + F.lit(PRIOR * share), clean + F.lit(PRIOR * (1 - share))
    rest_a, rest_b = (F.greatest(F.lit(n + PRIOR) - x, F.lit(1e-3)) for n, x in ((n_toxic, a), (n_clean, b)))
    delta = F.log(a) - F.log(rest_a) - F.log(b) + F.log(rest_b)
    error = F.lit(CAUTION) * F.sqrt(1 / a + 1 / b)
    size = F.least(F.greatest(F.abs(delta) - error, F.lit(0.0)), F.lit(LIMIT))
    return F.signum(delta) * size - F.lit(DRIFT)


def token_rows(rows: DataFrame) -> DataFrame:
    """(token, half, label, n): how many rows (text, half, label) hold each token, summed within batches first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = 2 * batch.column(1).to_numpy() + batch.column(2).to_numpy()
            for block in B.blocks(batch.column(0)):
                token, bounds = tokens(block)
                held = [np.unique(token[a:b]) for a, b in zip(bounds, bounds[1:])]
                own = group[block.first : block.last]
                for g in np.unique(own):
                    found, n = np.unique(np.concatenate([h for h, x in zip(held, own) if x == g]), return_counts=True)
                    half, label = (pa.array(np.full(len(found), x), pa.int32()) for x in divmod(int(g), 2))
                    yield pa.record_batch([pa.array(found), half, label, pa.array(n, pa.int64())], ["token", "half", "label", "n"])

    counted = rows.select(F.coalesce("text", F.lit("")).alias("text"), "half", "label").mapInArrow(
        count, "token long, half int, label int, n long"
    )
    return counted.groupBy("token").agg(
        *(F.coalesce(F.sum(F.when((F.col("half") == h) & (F.col("label") == y), F.col("n"))), F.lit(0)).alias(f"n{h}{y}")
          for h in (0, 1) for y in (0, 1))
    )


def learn_lexicon(counts: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Lexicon:
    scored = counts.select("token", log_odds(toxic, clean, max(1, n_toxic), max(1, n_clean)).alias("score"))
    telling = scored.filter(F.abs(F.col("score") + DRIFT) > 1e-6)
    found = telling.orderBy(F.abs(F.col("score") + DRIFT).desc(), "token").limit(VOCABULARY).toArrow()
    return Lexicon(found["token"].to_numpy(), found["score"].to_numpy())


SCAN = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("segments", T.ArrayType(T.DoubleType())),
        T.StructField("histogram", T.ArrayType(T.LongType())),
    ]
)


def _scan(lexicon: Lexicon, block: B.Block) -> Iterator[tuple[np.ndarray, list[float]]]:
    """Token scores and segment scores of each text."""
    token, bounds = tokens(block)
    s = lexicon(token)
    for a, b in zip(bounds, bounds[1:]):
        yield s[a:b], segments(s[a:b])


def _scan_udf(shared):
    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array, half: pa.Array) -> pa.Array:
        other = 1 - half.to_numpy(zero_copy_only=False)
        edges = np.linspace(-LIMIT - DRIFT, LIMIT, BINS + 1)
        rows = []
        for block in B.blocks(texts):
            both = [list(_scan(x, block)) for x in shared.value]
            for i in range(block.last - block.first):
                s, found = both[int(other[block.first + i])][i]
                rows.append({"n": len(s), "segments": found, "histogram": np.histogram(s, edges)[0].tolist()})
        return pa.array(rows, pa.struct([("n", pa.int64()), ("segments", pa.list_(pa.float64())), ("histogram", pa.list_(pa.int64()))]))

    return scan


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text") -> Model:
    """Learn from the labelled documents (``labels``: doc_id, toxic; pass the training rows' labels only, as their
    balance counts too). The driver gets the telling tokens' scores and the
    segment scores of the calibration rows. Without labels of both kinds the score is their smoothed share."""
    known = clean_labels(labels, "toxic")
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = materialise(sample_per_class(known, per_class), "sample")
    calibrating = sample_per_class(chosen, min(per_class, CALIBRATION)).select("doc_id", F.lit(True).alias("calibrates"))
    chosen = materialise(chosen.join(calibrating, "doc_id", "left").withColumnRenamed("doc_id", "_id"), "chosen")
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    half = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(2)).cast("int")
    rows = rows.select("_id", "text", half.alias("half"), "label", "calibrates")
    sizes = np.zeros((2, 2), np.int64)
    for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect():
        sizes[r["half"], r["label"]] = r["n"]
    n_clean, n_toxic = sizes.sum(0)
    if not (n_clean and n_toxic):
        rate = (n_toxic + 1) / (n_clean + n_toxic + 2)
        return Model(None, 1.0, 1.0, 0.0, float(np.log(rate / (1 - rate))))
    counts = materialise(token_rows(rows), "tokens")
    in_toxic, in_clean = [F.col("n01"), F.col("n11")], [F.col("n00"), F.col("n10")]
    lexicon = learn_lexicon(counts, in_toxic[0] + in_toxic[1], in_clean[0] + in_clean[1], int(n_toxic), int(n_clean))
    halves = [learn_lexicon(counts, in_toxic[h], in_clean[h], int(sizes[h, 1]), int(sizes[h, 0])) for h in (0, 1)]

    shared = docs.sparkSession.sparkContext.broadcast(halves)
    sample = rows.filter("calibrates")
    scanned = sample.select("_id", "label", _scan_udf(shared)(F.col("text"), F.col("half")).alias("s")).toArrow().to_pylist()
    scanned.sort(key=lambda r: r["_id"])
    y = np.array([r["label"] for r in scanned])
    n = np.array([max(1, r["s"]["n"]) for r in scanned])
    best = np.array([max(r["s"]["segments"], default=0.0) for r in scanned])
    histogram = np.sum([r["s"]["histogram"] for r in scanned if r["label"] == 0] or [np.zeros(BINS)], axis=0)
    decay = _decay(histogram)
    clean = y == 0
    scale = clean.sum() / max(1e-9, float((n[clean] * np.exp(-decay * best[clean])).sum())) if clean.any() else 1.0
    model = Model(lexicon, decay, scale, 1.0, 0.0)
    evidence = np.array([model.evidence(int(k), r["s"]["segments"]) for k, r in zip(n, scanned)])
    # the sample may hold the classes in other shares than the labels do: weigh its rows back
    weight = np.where(clean, share[0] / max(1, clean.sum()), share[1] / max(1, (~clean).sum()))
    slope, shift = _logistic(np.minimum(evidence, 50.0) / 10, y, weight * len(y) / weight.sum())
    return model._replace(slope=slope / 10, shift=shift)


def _decay(histogram: np.ndarray) -> float:
    """The positive root of E[exp(decay * score)] = 1 over token scores of clean texts, within [0.1, 5]."""
    edges = np.linspace(-LIMIT - DRIFT, LIMIT, BINS + 1)
    s, p = (edges[1:] + edges[:-1]) / 2, histogram / max(1, histogram.sum())
    low, high = 0.1, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * s)).sum() < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a light penalty on the slope."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    penalty = np.diag([0.05, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design.T * (p * (1 - p) * weight)) @ design + penalty
        step = np.linalg.solve(hessian, design.T @ ((p - y) * weight) + penalty @ beta)
        beta = beta - np.clip(step, -2, 2)
    return float(max(beta[0], 0.0)), float(beta[1])


def toxicity_score(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column with the probability (0 to 1) that each whole text is toxic. Texts without tokens have no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in columns:
            if model.lexicon is None:
                yield pa.array(model.probability(np.zeros(len(column))))
                continue
            found = [
                model.evidence(len(s), parts) for block in B.blocks(column) for s, parts in _scan(model.lexicon, block)
            ]
            yield pa.array(model.probability(np.minimum(np.array(found, float), 50.0)))

    return score.asNondeterministic()(F.col(text))
