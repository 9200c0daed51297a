"""Toxicity of reports by two class-conditional Kneser-Ney models.

Each class has a model of the letters of its judged reports: the probability of a letter after the four before it, by absolute discounting,
then after three and after two with the class's continuation counts. Below that both classes share one backoff, the continuation counts of all judged
reports together, so that an expression which is rare or new in either class is smoothed alike. A report's score compares the two
log-likelihoods per letter: a logistic curve, fitted on judged reports that gave no counts, turns the difference into 0 to 1.

Whole texts give counts, summed in tasks by run of letters. Neither class is favoured for having been seen more: the counts of the longer one are those expected
of a random part as long as the other, with the discount due there, so all its letters have a say. The model is one table of
log-ratios over all five-letter runs of a 32-letter alphabet, 32 MB whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.llm.blocks import blocks
from loomtone.llm.shared import fold, judged_sample, keep

#: Judged reports per class that the model is fitted on at most, taken in the order of a hash of the text.
SAMPLE_ROWS = 1_500
DISCOUNT = 0.95
ORDER = 5
#: Orders up to this one are shared by the classes.
SHARED_ORDER = 2
#: Size of one step of the stored log-ratios.
STEP = 0.05
_BITS = 5


def _alphabet() -> np.ndarray:
    """Bytes to 32 letters: A-Z as a-z, 27 for digits, 28-31 for bytes beyond ASCII, 0 for all else."""
    letter = np.zeros(256, np.int32)
    letter[0x61:0x7B] = letter[0x41:0x5B] = np.arange(1, 27)
    letter[0x30:0x3A] = 27
    letter[0x80:] = 28 + np.arange(128) % 4
    return letter


_LETTER = _alphabet()


def _runs(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the ``ORDER`` letters that end at each byte (blanks before the start) and the byte's text number."""
    letter = _LETTER[text]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    since = np.arange(len(text)) - at[owner]
    code = letter.copy()
    for k in range(1, min(ORDER, len(text))):
        code[k:] += np.where(since[k:] >= k, letter[:-k], 0) << (_BITS * k)
    return code, owner


class _Counts:
    """Counts of runs by order: plain counts of the longest, below them how many different letters precede a run.

    With a ``rate`` below 1 they are expectations over a random part of the letters: each run is taken with that chance. ``here`` is the
    chance that a run is met at all, kept as the log of the chance that it is not.
    """

    def __init__(self, codes: np.ndarray, count: np.ndarray | None = None, rate: float | np.ndarray = 1.0):
        if count is None:
            codes, count = np.unique(codes, return_counts=True)
        with np.errstate(divide="ignore"):
            missing = np.log1p(-np.broadcast_to(np.asarray(rate, np.float64), count.shape))
        self.code, at = np.unique(codes, return_inverse=True)
        self.count = np.bincount(at, count * rate, minlength=len(self.code))
        missing = np.bincount(at, count * missing, minlength=len(self.code))
        self.met = -np.expm1(missing)
        self.lower, self.here = {}, {}
        code, met = self.code, self.met
        for order in range(ORDER - 1, 0, -1):
            size = 1 << _BITS * order
            self.lower[order] = np.bincount(code & (size - 1), met, minlength=size).astype(np.float32)
            missing = np.bincount(code & (size - 1), missing, minlength=size)
            met = -np.expm1(missing)
            self.here[order] = met.astype(np.float32)
            code = np.arange(size)

    def smoothed(self, count: np.ndarray, here: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Kneser-Ney probabilities of all runs of one order, given those of the order below for the same last letters."""
        by, off = count.reshape(-1, 1 << _BITS), DISCOUNT * here.reshape(-1, 1 << _BITS)
        total = by.sum(1, keepdims=True)
        seen = np.where(total > 0, total, 1)
        out = np.maximum(by - off, 0) / seen + np.where(total > 0, off.sum(1, keepdims=True) / seen, 1) * below.reshape(by.shape)
        return out.ravel()

    def up_to(self, order: int, start: int, below: np.ndarray) -> np.ndarray:
        for k in range(start, order + 1):
            below = self.smoothed(self.lower[k], self.here[k], np.tile(below, len(self.lower[k]) // len(below)))
        return below


def _table(ordinary: tuple[np.ndarray, np.ndarray], toxic: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log-ratios of toxic to ordinary for every run of ``ORDER`` letters, in steps of ``STEP``, from the runs of each class and their counts."""
    letters = [int(n.sum()) for _, n in (ordinary, toxic)]
    rates = [min(letters) / max(1, n) for n in letters]
    classes = [_Counts(code, n, rate) for (code, n), rate in zip((ordinary, toxic), rates)]
    both = [np.concatenate(x) for x in zip(ordinary, toxic)]
    shared = _Counts(*both, np.repeat(rates, [len(ordinary[0]), len(toxic[0])])).up_to(SHARED_ORDER, 1, np.full(1 << _BITS, 1 / (1 << _BITS), np.float32))
    below = [c.up_to(ORDER - 1, SHARED_ORDER + 1, shared) for c in classes]
    part = 1 << _BITS * (ORDER - 1)
    out = np.zeros(1 << _BITS * ORDER, np.int8)
    for k in range(1 << _BITS):
        logs = []
        for c, low in zip(classes, below):
            a, b = np.searchsorted(c.code, [k * part, (k + 1) * part])
            count, here = np.zeros((2, part), np.float32)
            at = c.code[a:b] - k * part
            count[at], here[at] = c.count[a:b], c.met[a:b]
            logs.append(np.log(c.smoothed(count, here, low)))
        out[k * part: (k + 1) * part] = np.clip(np.rint((logs[1] - logs[0]) / STEP), -127, 127)
    return out


@dataclass
class ToxicityModel:
    """The log-ratios and the curve from the mean log-ratio to the score."""

    ratio: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, column: pa.Array) -> np.ndarray:
        """Toxic minus ordinary log-likelihood per letter; 0 for an empty text."""
        out = np.zeros(len(column))
        for first, stop, text, at in blocks(column):
            code, owner = _runs(text, at)
            gain = np.bincount(owner, self.ratio[code], minlength=stop - first)
            out[first:stop] = STEP * gain / np.maximum(np.diff(at), 1)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(column) + self.offset, -30, 30)))


def _run_counts(batches):
    """Counts of the runs of each label's whole texts, combined within a batch."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, text, at in blocks(batch.column(0)):
            code, owner = _runs(text, at)
            key, n = np.unique(label[first + owner] << (_BITS * ORDER) | code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])


def _differences(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.value.difference(batch.column(0))), batch.column(1), batch.column(2)], names=["difference", "label", "place"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the differences ``x`` of the labels ``y``, each class weighing half, by Newton's steps."""
    if len(np.unique(y)) < 2:
        return 1.0, -2.0
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 0.5 * np.array([w[0], 0])
        w = w - np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag([0.5, 1e-6]), grad)
    return float(w[0] / scale), float(w[1])


def fit(loops: DataFrame, judged: DataFrame, id_column: str = "file_id", text_column: str = "report", label_column: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` judged reports per class, in the order of a hash of their texts; a quarter of them only fits the curve.

    Only rows whose id has a ``fold`` of 5 other than 0 are learnt from; null labels and ids are left out.
    """
    taken = judged_sample(loops, judged, id_column, text_column, label_column, sample_rows, each_label=True)
    taken = keep(taken, "toxicity-sample").repartition(8)
    marks: pd.DataFrame = taken.select("label", "place").toPandas()
    rest = marks["place"] % 4 == 0
    apart = min(marks["label"].groupby(rest).nunique().reindex([False, True], fill_value=0)) == 2
    # too few to set some apart: the same reports give counts and curve
    learnt, rest = (taken.where("pmod(place, 4) <> 0"), taken.where("pmod(place, 4) = 0")) if apart else (taken, taken)
    # at most 32 ** 5 runs a label, whatever the texts' length
    counts = learnt.mapInArrow(_run_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (counts[c].to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    key, n = key[order], n[order]
    cut = np.searchsorted(key, 1 << (_BITS * ORDER))
    model = ToxicityModel(_table((key[:cut], n[:cut]), (key[cut:] - (1 << (_BITS * ORDER)), n[cut:])))
    shared = loops.sparkSession.sparkContext.broadcast(model)
    got = rest.mapInArrow(_differences(shared), "difference double, label int, place bigint").toPandas().sort_values(["label", "place"], kind="stable")
    model = ToxicityModel(model.ratio, *_curve(got["difference"].to_numpy(), got["label"].to_numpy(np.float64)))
    return model


def score_toxicity(loops: DataFrame, judged: DataFrame, id_column: str = "file_id", text_column: str = "report",
                   label_column: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted)``, one row per row of ``loops``, from the text alone.

    ``score`` is 0 to 1, higher where label 1 is likelier; ``predicted`` is 1 from 0.5 on; ``held_out`` marks the fold that is never
    learnt from. Null, empty and wordless texts have difference 0 and get the curve's value there. Equal texts get equal scores. Without judged rows of both
    classes nothing is known and no report is called toxic. Further columns are not looked at.
    """
    shared = loops.sparkSession.sparkContext.broadcast(fit(loops, judged, id_column, text_column, label_column))

    @F.arrow_udf(T.DoubleType())
    def toxicity(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(column))

    scored = loops.select(id_column, (fold(id_column, 5) == 0).alias("held_out"), toxicity(F.col(text_column).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
