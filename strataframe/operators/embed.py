"""Batched text embedding with a pluggable encoder, and PCA scores of embeddings."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.model_cache import ModelCache
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# Batch size and output width of the study's encoder.
BATCH_SIZE = 64
WIDTH = 768

Encoder = Callable[[], Callable[[np.ndarray], np.ndarray]]


def embed_text(
    df: DataFrame,
    c: str,
    encoder: Encoder,
    out: str = "embedding",
    batch_size: int = BATCH_SIZE,
    tasks: int | None = None,
) -> DataFrame:
    """``out``: one float vector per text. ``encoder`` is called once per worker and returns the function
    that maps a batch of texts to a 2-d array, so a model is loaded once and reused.

    Inference costs far more than moving its text, so ``tasks`` may spread rows that arrive in few input
    splits; leave it out when the scan already has enough of them."""
    df = df.repartition(tasks) if tasks else df
    key = uuid.uuid4()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = ModelCache.get(key)
        if encode is None:
            encode = encoder()
            ModelCache.add(key, encode)
        for texts in batches:
            for i in range(0, len(texts), batch_size):
                # texts become Python's a few at a time, and vectors leave as they are made
                part = np.array(texts.slice(i, batch_size).to_pylist(), dtype=object)
                found = np.asarray(encode(part), dtype=np.float32)
                if found.ndim != 2 or len(found) != len(part):
                    raise ValueError(f"the encoder gave {found.shape} for {len(part)} texts")
                ends = np.arange(len(part) + 1, dtype=np.int32) * found.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return df.withColumn(out, predict(F.coalesce(F.col(c), F.lit(""))))


def hashing_encoder(width: int = WIDTH, max_tokens: int | None = None) -> Encoder:
    """A deterministic stand-in for a language model: token counts hashed into ``width`` places.

    Whole texts are encoded unless the model's own token limit is given.
    """

    def load():
        places: dict[str, int] = {}

        def place(token: str) -> int:
            found = places.get(token)
            if found is None:
                found = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % width
                if len(places) < 100_000:
                    places[token] = found
            return found

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width), dtype=np.float32)
            for i, text in enumerate(np.asarray(texts).ravel()):
                tokens = [t for t in re.split(r"[ \t\n\r\f\v]+", text) if t][:max_tokens]
                if tokens:
                    out[i] = np.bincount([place(t) for t in tokens], minlength=width)
            return out

        return encode

    return load


class FittedPca:
    """Centring, exact principal components and a sign rule, fitted on the whole table."""

    def __init__(self, scaler: StandardScalerModel, pca: PCAModel):
        self.scaler, self.pca = scaler, pca
        loadings = pca.pc.toArray()
        # the largest loading of every component is positive
        peaks = loadings[np.argmax(np.abs(loadings), axis=0), np.arange(loadings.shape[1])]
        self.signs = np.where(peaks < 0, -1.0, 1.0)

    @property
    def explained_variance(self) -> list[float]:
        return [float(v) for v in self.pca.explainedVariance.toArray()]

    def transform(self, df: DataFrame, c: str, prefix: str = "cc_pca_") -> DataFrame:
        scores = self.pca.transform(self.scaler.transform(df.withColumn("_vec", _vector(df, c))))
        signed = ElementwiseProduct(scalingVec=Vectors.dense(self.signs), inputCol="_pc", outputCol="_signed")
        named = signed.transform(scores).withColumn("_a", vector_to_array("_signed"))
        columns = {f"{prefix}{i}": F.col("_a")[i] for i in range(len(self.signs))}
        return named.withColumns(columns).drop("_vec", "_centred", "_pc", "_signed", "_a")


def _vector(df: DataFrame, c: str):
    is_array = isinstance(df.schema[c].dataType, T.ArrayType)
    return array_to_vector(F.col(c)) if is_array else F.col(c)


def pca_fit(df: DataFrame, c: str, k: int) -> FittedPca:
    """Fit ``k`` components. The covariance is summed on the executors; only a width x width matrix, which
    does not grow with the rows, is decomposed on the driver."""
    vectors = df.select(_vector(df, c).alias("_vec"))
    scaler = StandardScaler(inputCol="_vec", outputCol="_centred", withMean=True, withStd=False).fit(vectors)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(scaler.transform(vectors))
    return FittedPca(scaler, pca)


def pca_fit_transform(df: DataFrame, c: str, k: int, prefix: str = "cc_pca_") -> DataFrame:
    return pca_fit(df, c, k).transform(df, c, prefix)


def explained_variance(df: DataFrame, model: FittedPca) -> DataFrame:
    """``component, ratio``, one row per component."""
    rows = [(i, v) for i, v in enumerate(model.explained_variance)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double")


def eigen_check(df: DataFrame, c: str, model: FittedPca) -> DataFrame:
    """``(component, residual, peak)``: what shows that loadings are eigenvectors and follow the sign rule.

    ``residual`` is the largest cell of covariance times loading less eigenvalue times loading, where the product with
    the covariance is summed on the executors from centred rows and their scores, without the covariance itself;
    ``peak`` is the loading of largest size, with the sign it is used with. Null vectors are not allowed; with fewer
    than two rows nothing is known and no row is given.
    """
    loadings = model.pca.pc.toArray() * model.signs
    width, k = loadings.shape
    shared = df.sparkSession.sparkContext.broadcast(loadings)
    vectors = df.select(_vector(df, c).alias("_vec"))
    centred = model.scaler.transform(vectors).select(vector_to_array("_centred").alias("x"))

    def products(batches):
        total, squares, rows = np.zeros((width, k)), np.zeros(width), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ (x @ shared.value)
            squares += (x * x).sum(0)
            rows += len(x)
        yield pa.RecordBatch.from_pydict({"p": [total.ravel()], "s": [squares], "n": [rows]})

    parts = centred.mapInArrow(products, "p array<double>, s array<double>, n long")
    summed = lambda name: parts.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col").alias("v"))
    rows = parts.agg(F.sum("n")).first()[0] or 0
    if rows < 2:
        return df.sparkSession.createDataFrame([], "component int, residual double, peak double")
    moved = np.zeros(width * k)
    for r in summed("p").collect():  # width x components numbers, whatever the rows
        moved[r["pos"]] = r["v"]
    total = summed("s").agg(F.sum("v")).first()[0] / (rows - 1)
    values = np.asarray(model.explained_variance) * total
    off = np.abs(moved.reshape(width, k) / (rows - 1) - loadings * values).max(0)
    peaks = loadings[np.argmax(np.abs(loadings), axis=0), np.arange(k)]
    found = [(i, float(off[i]), float(peaks[i])) for i in range(k)]
    return df.sparkSession.createDataFrame(found, "component int, residual double, peak double")


class FoldPca:
    """Principal components of the rows outside each fold, by fold."""

    def __init__(self, means: np.ndarray, loadings: np.ndarray, ratios: np.ndarray):
        self.means, self.loadings, self.ratios = means, loadings, ratios

    def transform(self, df: DataFrame, c: str, without: str, prefix: str = "cc_pca_") -> DataFrame:
        """Scores of each row by the components of the training rows of the fold in its column ``without``."""
        shared = df.sparkSession.sparkContext.broadcast((self.means, self.loadings))
        k = self.loadings.shape[2]

        @F.arrow_udf("array<double>")
        def scores(vectors: pa.Array, fold: pa.Array) -> pa.Array:
            means, loadings = shared.value
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1)
            f = fold.to_numpy(zero_copy_only=False)
            out = np.zeros((len(f), k))
            for at in np.unique(f):
                out[f == at] = (x[f == at] - means[at]) @ loadings[at]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * k), pa.array(out.ravel()))

        numbers = F.col(c).cast("array<double>") if isinstance(df.schema[c].dataType, T.ArrayType) else vector_to_array(c)
        named = df.withColumn("_scores", scores(numbers, F.col(without).cast("int")))
        return named.withColumns({f"{prefix}{i}": F.col("_scores")[i] for i in range(k)}).drop("_scores")


def fold_pca(df: DataFrame, c: str, fold: str, folds: int, k: int) -> FoldPca:
    """Components of each fold's training rows from one pass: sums and products per fold, the total less one fold.

    Tasks add up ``x`` and ``x x'`` of their rows by fold; those are summed on the executors row by row of the matrix.
    What reaches the driver are ``folds`` matrices of the vectors' width, whatever the number of rows.
    """
    is_array = isinstance(df.schema[c].dataType, T.ArrayType)
    cells = df.select((F.col(c).cast("array<double>") if is_array else vector_to_array(c)).alias("x"), F.col(fold).cast("int").alias("fold"))

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            f = batch["fold"].to_numpy(zero_copy_only=False)
            for at in np.unique(f):
                part = np.column_stack([np.ones((f == at).sum()), x[f == at]])
                sums[int(at)] = sums.get(int(at), 0.0) + part.T @ part
        for at, total in sums.items():
            rows = {"fold": np.full(len(total), at, np.int32), "i": np.arange(len(total), dtype=np.int32), "v": list(total)}
            yield pa.RecordBatch.from_pydict(rows)

    parts = cells.mapInArrow(products, "fold int, i int, v array<double>").withColumn("v", array_to_vector("v"))
    found = parts.groupBy("fold", "i").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    if not found:
        raise ValueError("no rows to find components of")
    width = len(found[0]["v"])
    gram = np.zeros((folds, width, width))
    for r in found:
        gram[r["fold"], r["i"]] = r["v"].toArray()
    means, loadings, ratios = [], [], []
    for at in range(folds):
        left = gram.sum(0) - gram[at]
        n, mean = left[0, 0], left[0, 1:] / max(left[0, 0], 1.0)
        spread = (left[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1.0, 1.0)
        values, vectors = np.linalg.eigh(spread)
        order = np.argsort(values)[::-1][:k]
        peaks = vectors[np.argmax(np.abs(vectors[:, order]), axis=0), order]
        means.append(mean)
        loadings.append(vectors[:, order] * np.where(peaks < 0, -1.0, 1.0))
        ratios.append(values[order] / max(values.sum(), 1e-300))
    return FoldPca(np.asarray(means), np.asarray(loadings), np.asarray(ratios))
