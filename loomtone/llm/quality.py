"""Quality of reports by nearest-neighbour voting among latent-semantic vectors.

A report is counted into hashed runs of bytes of several lengths over its whole text; counts are damped and weighted by rarity. A truncated
singular value decomposition of a bounded sample of judged reports gives the latent space. The judged vectors of the sample are broadcast
(``SAMPLE_ROWS`` x ``DIMENSIONS`` floats), every report is compared with all of them by blocked cosine products, and the labels of its nearest
neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.llm.blocks import blocks, mix
from loomtone.llm.shared import fold, judged_sample

#: Judged reports that the model is fitted on at most, taken in the order of a hash of the text.
SAMPLE_ROWS = 4_000
FEATURES = 2_048
DIMENSIONS = 48
NEIGHBOURS = 25
#: The power of a neighbour's cosine that is its weight.
SHARPNESS = 4
_GRAMS = (1, 2, 3)


def _byte_kinds() -> np.ndarray:
    """Letters by case, digits and blanks become one kind each, so that the form of words counts, not their letters."""
    kind = np.arange(256, dtype=np.uint64)
    kind[0x30:0x3A] = 0x30
    kind[0x41:0x5B] = 0x41
    kind[0x61:0x7B] = 0x61
    kind[0x80:] = 0x61
    kind[9:14] = 0x20
    return kind


_KIND = _byte_kinds()


def counts(column: pa.Array) -> np.ndarray:
    """Damped counts of byte runs, text x ``FEATURES``: half of the features for the bytes themselves, half for their classes."""
    out = np.zeros((len(column), FEATURES), np.float32)
    half = np.uint64(FEATURES // 2)
    for first, stop, text, at in blocks(column, 1 << 18):
        rows = np.repeat(np.arange(stop - first), np.diff(at))
        got = np.zeros((stop - first) * FEATURES, np.int64)
        for side, codes in enumerate((text.astype(np.uint64), _KIND[text])):
            run = np.zeros(len(codes), np.uint64)
            for n in range(1, 1 + _GRAMS[-1] + side):
                if len(codes) < n:
                    break
                run = run[: len(codes) - n + 1] * np.uint64(257) + codes[n - 1:] + np.uint64(1)
                own = rows[: len(run)] == rows[n - 1:]
                slot = (mix(run + np.uint64(n << 40)) >> np.uint64(33)) % half + np.uint64(side) * half
                got += np.bincount(rows[: len(run)][own] * FEATURES + slot[own].astype(np.int64), minlength=len(got))
        out[first:stop] = got.reshape(-1, FEATURES)
    total = out.sum(axis=1, keepdims=True)
    return np.log1p(1e3 * out / np.maximum(total, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass
class QualityModel:
    """What scoring needs: the mean and weights of features, the latent axes, the judged vectors and their labels."""

    mean: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    judged: np.ndarray
    label: np.ndarray
    prior: float

    def project(self, damped: np.ndarray) -> np.ndarray:
        return _unit(((damped - self.mean) * self.weight) @ self.axes)

    def score(self, damped: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest judged vectors, each weighted by its cosine; without any, the prior."""
        out = np.full(len(damped), self.prior)
        if not len(self.label):
            return out
        near = min(NEIGHBOURS, len(self.label))
        some = damped.any(axis=1)
        for k in range(0, len(damped), 512):
            cosine = self.project(damped[k: k + 512]) @ self.judged.T
            top = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosine, top, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.label[top]).sum(axis=1)
            good = total > 0
            out[k: k + 512][good] = vote[good] / total[good]
        out[~some] = self.prior
        return np.clip(out, 0.0, 1.0)


def _sample_vectors(batches):
    for batch in batches:
        damped = counts(batch.column(0)).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in damped], pa.binary()), batch.column(1)], names=["damped", "label"])


def fit(loops: DataFrame, judged: DataFrame, id_column: str = "file_id", text_column: str = "report", label_column: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most ``sample_rows`` judged reports, in the order of a hash of their texts.

    Only rows whose id has a ``fold`` of 5 other than 0 are learnt from; null labels and ids are left out. Only vectors reach the driver.
    """
    sample = judged_sample(loops, judged, id_column, text_column, label_column, sample_rows).select("text", "label")
    got: pd.DataFrame = sample.repartition(8).mapInArrow(_sample_vectors, "damped binary, label int").toPandas()
    got = got.sort_values(["damped", "label"], kind="stable")
    label = got["label"].to_numpy(np.float64)
    x = np.frombuffer(b"".join(got["damped"]), np.float16).reshape(-1, FEATURES).astype(np.float32)
    if not len(label):
        empty = np.zeros(FEATURES, np.float32)
        return QualityModel(empty, empty, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), label, 0.5)
    mean = x.mean(axis=0)
    weight = (1 / (x.std(axis=0) + 0.25)).astype(np.float32)
    centred = (x - mean) * weight
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    return QualityModel(mean, weight, axes, _unit(centred @ axes), label, float(label.mean()))


def scorer(loops: DataFrame, model: QualityModel):
    """A function of a text column to its quality, 0 to 1, with the model broadcast."""
    shared = loops.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def quality(column: pa.Array) -> pa.Array:
        parts = [shared.value.score(counts(column.slice(k, 256))) for k in range(0, len(column), 256)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return lambda report: quality(F.coalesce(report.cast("string"), F.lit("")))


def score_quality(loops: DataFrame, judged: DataFrame, id_column: str = "file_id", text_column: str = "report",
                  label_column: str = "quality") -> DataFrame:
    """``(id, held_out, score)``, one row per row of ``loops``: the likelihood of label 1 from the text alone.

    ``held_out`` marks the fold that is never learnt from. Null, empty and blank-only texts get what the model says of them; a text without any
    byte gets the share of label 1 among the judged. Equal texts get equal scores. Without judged rows every score is 0.5. Further
    columns are not looked at.
    """
    quality = scorer(loops, fit(loops, judged, id_column, text_column, label_column))
    return loops.select(id_column, (fold(id_column, 5) == 0).alias("held_out"), quality(F.col(text_column)).alias("score"))


def keep_good(loops: DataFrame, judged: DataFrame, least: float, id_column: str = "file_id", text_column: str = "report",
              label_column: str = "quality") -> DataFrame:
    """``loops`` whose score is at least ``least``; all columns stay."""
    quality: Column = scorer(loops, fit(loops, judged, id_column, text_column, label_column))(F.col(text_column))
    return loops.where(quality >= least)
