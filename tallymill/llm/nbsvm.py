"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte n-grams, hashed to a fixed number of buckets, and of n-grams over the text's shape
(runs of letters, digits, marks) and over its pattern of repeated words, which tell style from content. An indicator's value is its log-count ratio between
the classes, rows are scaled to unit length, a linear hinge-loss model is fitted by dual coordinate descent, and margins
become probabilities by a logistic fit on held-out folds of the training rows.

The model is fitted on at most SAMPLE labelled rows, drawn by a hash of their ids, and on no more of them than have
SAMPLE_BYTES of features; everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import drop_scratch, free_name, materialize, odd_names_aside, quoted, slices

SAMPLE, SAMPLE_BYTES, BITS, SIZES, SHAPE_SIZE = 6000, 64 << 20, 18, (2, 3), 5
THRESHOLD, COST, EPOCHS, FOLDS = 0.3, 1.0, 30, 4
_BUCKETS = 1 << BITS


def _shapes() -> np.ndarray:
    """A class for each byte value: space, line end, lower, upper, digit, six of marks, control, part of a longer character."""
    t = np.full(256, 12, np.uint32)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            t[i] = 2
        elif c == " ":
            t[i] = 0
        elif c in "\n\r":
            t[i] = 1
        elif c.islower():
            t[i] = 2
        elif c.isupper():
            t[i] = 3
        elif c.isdigit():
            t[i] = 4
        elif c in ".,;:":
            t[i] = 5
        elif c in "!?":
            t[i] = 6
        elif c.isprintable():
            t[i] = 7 + i % 5
    return t


SHAPES = _shapes()


def _hash(code: np.ndarray, kind: int) -> np.ndarray:
    h = (code + np.uint32(kind)) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _repeats(raw: bytes) -> np.ndarray:
    """n-grams over the words' pattern: for four words in a row, which equal the word before and which the one before that."""
    words = np.fromiter(map(hash, raw.split()), np.int64)
    if len(words) < 6:
        return np.zeros(0, np.uint32)
    flag = (words[2:] == words[1:-1]).astype(np.uint32) * 2 + (words[2:] == words[:-2])
    return _hash(np.unique(flag[3:] | flag[2:-1] << 2 | flag[1:-2] << 4 | flag[:-3] << 6), 77)


def features(raw: bytes | None) -> np.ndarray:
    """Buckets of the distinct n-grams of a text in UTF-8, over all of it."""
    b = np.frombuffer(raw or b"", np.uint8)
    found = []
    wide = b.astype(np.uint32)
    for n in SIZES:
        if len(b) >= n:
            code = wide[: len(b) - n + 1].copy()
            for i in range(1, n):
                code = (code << np.uint32(8)) | wide[i : len(b) - n + 1 + i]
            found.append(_hash(code, n))
    if len(b):
        shape = SHAPES[b]
        runs = shape[np.concatenate([[True], shape[1:] != shape[:-1]])]
        if len(runs) >= SHAPE_SIZE:
            code = runs[: len(runs) - SHAPE_SIZE + 1].copy()
            for i in range(1, SHAPE_SIZE):
                code = (code << np.uint32(4)) | runs[i : len(runs) - SHAPE_SIZE + 1 + i]
            found.append(_hash(code, 99))
        found.append(_repeats(raw))
    if not found:
        return np.zeros(0, np.uint32)
    code = np.concatenate(found)
    if len(code) < 20_000:
        return np.unique(code)
    seen = np.zeros(_BUCKETS, bool)
    seen[code] = True
    return np.flatnonzero(seen).astype(np.uint32)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """Margin of each row: its log-count ratios, scaled to unit length, times the weights."""
        out = np.full(len(rows), self.bias)
        both = self.ratio * self.weight
        for i, f in enumerate(rows):
            if len(f):
                r = self.ratio[f]
                out[i] += both[f].sum() / max(np.sqrt(r @ r), 1e-9)
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(rows) + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = {k: np.bincount(np.concatenate([r for r, q in zip(rows, y) if q == k] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=_BUCKETS) + 1.0 for k in (1, 0)}
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear L1-loss support vector machine by dual coordinate descent; classes weigh alike."""
    sign = np.where(y == 1, 1.0, -1.0)
    upper = COST * len(y) / (2 * np.where(y == 1, max((y == 1).sum(), 1), max((y == 0).sum(), 1)))
    values = [ratio[f] / max(np.linalg.norm(ratio[f]), 1e-9) for f in rows]
    norm = np.array([1.0 + (len(f) > 0) for f in rows])
    w, bias, alpha, rng = np.zeros(_BUCKETS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            g = sign[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            d = (new - alpha[i]) * sign[i]
            if d:
                alpha[i] = new
                w[f] += d * v
                bias += d
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w, bias


def fit_logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve through margins, by Newton steps with Platt's smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, a, b = np.where(y == 1, hi, lo), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, [((p - t) * m).sum() + 1e-6 * a, (p - t).sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model | None:
    """The model, or None when no row is labelled; with rows of one class alone, a constant in its favour."""
    if not len(y):
        return None
    if y.min() == y.max():
        return Model(np.zeros(_BUCKETS), np.zeros(_BUCKETS), 4.0 if y[0] == 1 else -4.0)
    margins = np.zeros(len(y))
    folds = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        inside = folds != k
        part = [r for r, u in zip(rows, inside) if u]
        held = [r for r, u in zip(rows, inside) if not u]
        if held and len(set(y[inside])) == 2:
            ratio = log_count_ratio(part, y[inside])
            margins[~inside] = Model(ratio, *fit_hinge(part, y[inside], ratio)).margin(held)
    ratio = log_count_ratio(rows, y)
    return Model(ratio, *fit_hinge(rows, y, ratio), *fit_logistic(margins, y))


def held_out(id_col: str):
    """True for the fifth of the ids that labels are never learnt from; null ids are never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES
) -> Model | None:
    """Model from labelled rows outside the held-out fifth, least hashes of ids first: at most `sample` of them, and no more than take `most_bytes` of features.

    Null labels and ids are no labels; an id whose labels differ counts as none. Of rows that share an id, the one of
    least features counts. Other columns are ignored, whatever their names. No labelled rows make no model.
    """
    y = F.col(label_col).cast("int")
    one = labels.select(F.col(id_col).alias("id"), y.alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    one = one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    picked = one.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches):
        for b in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["id", "y", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    rows = texts.join(F.broadcast(picked), "id").select("id", "y", "t").mapInArrow(run, f"id {kind}, y int, f binary")
    rows = materialize(rows.groupBy("id", "y").agg(F.min("f").alias("f")).withColumn("h", F.xxhash64("id")))
    sizes = sorted(rows.select("h", "id", F.length("f")).collect())
    fits = int((np.cumsum([n for _, _, n in sizes]) <= most_bytes).sum())
    if fits < len(sizes):
        last = sizes[fits]
        rows = rows.where((F.col("h") < last[0]) | (F.col("h") == last[0]) & (F.col("id") < F.lit(last[1])))
    made = rows.groupBy().applyInArrow(_fitted, "ratio binary, weight binary, bias double, slope double, shift double").first()
    drop_scratch(rows)
    return made and Model(np.frombuffer(made.ratio), np.frombuffer(made.weight), *made[2:])


def _fitted(t: pa.Table) -> pa.Table:
    """The model of the sample's rows (id, y, f, h), as one row; the sample is bounded, so one task fits it."""
    t = t.sort_by([("h", "ascending"), ("id", "ascending")])
    m = fit([np.frombuffer(f, np.uint32) for f in t.column("f").to_pylist()], t.column("y").to_numpy().astype(np.int64))
    return pa.table({"ratio": [m.ratio.tobytes()], "weight": [m.weight.tobytes()], "bias": [float(m.bias)], "slope": [float(m.slope)], "shift": [float(m.shift)]})


@odd_names_aside
def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a DOUBLE column in 0..1, higher where label 1 is likelier; a model of None gives 0.5.

    A null or empty text has no features and gets the score of no evidence; a text of any length is read whole. All
    other columns and rows stay, whatever their names; a column that has the new name is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    names = [*keep, *([] if text_col in keep else [free_name(docs, "_raw")])]
    at = keep.index(text_col) if text_col in keep else len(keep)
    schema = StructType([*(docs.schema[c] for c in keep), StructField(out, DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in slices(batches, at):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            s = np.full(len(texts), 0.5) if m is None else m.score([features(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s)], names=schema.names)

    return docs.select(*map(quoted, keep), *(F.col(text_col).alias(n) for n in names[len(keep) :])).mapInArrow(run, schema)
