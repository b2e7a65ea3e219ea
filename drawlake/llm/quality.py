"""Quality of a text by compression.

Two zstandard dictionaries are trained, on pieces of good and of bad labelled texts. A text is cut into
pieces, every piece is compressed with either dictionary, and the difference of the summed sizes, normalised
by the larger of them and by the text's length, is turned into a score by logistic calibration on other
labelled texts. The length only scales the differences: it says how far they can be trusted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import fold_of, free_name, giving_back

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PIECE = 512
LEVEL = 3
DICT_BYTES = 112_640
#: Bounds of the sample that the model is fitted on; all else is done on all rows.
DICT_DOCS, DICT_PIECES, CALIBRATION_DOCS = 1500, 8, 8000
RIDGE = 0.1
CLIP = 6.0
FEATURES = [f"f{i}" for i in range(4)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Sizes:
    """The features of a text: by how much its pieces come out larger with the bad dictionary than with the good one."""

    def __init__(self, good: bytes, bad: bytes):
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d) if d else None
            if known:
                known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, **options).compress)

    def features(self, text: str | None) -> tuple[float, ...]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        cut, n = pieces(raw), max(len(raw), 1)
        good, bad = (sum(len(f(p)) for p in cut) for f in self.by)
        of_size, of_length, trust = (bad - good) / max(good, bad, 1), (bad - good) / n, float(np.log1p(n))
        return of_size, of_length, of_size * trust, of_length * trust


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -CLIP, CLIP)])


def fitted(good: bytes, bad: bytes, x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's steps; with one class or none, the smoothed share of label 1."""
    x = x.reshape(-1, len(FEATURES))
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = scaled(x, mean, scale)
    w = np.zeros(z.shape[1])
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    w[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            hessian = (z.T * (p * (1 - p))) @ z + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hessian, z.T @ (y - p) - RIDGE * w)
            w = w + step
            if np.abs(step).max() < 1e-10:
                break
    return Model(good, bad, mean, scale, w)


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of samples too few to train one, their bytes themselves."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, of labels whose fold isn't held out.

    A hash of the id sends half of the labels to the dictionaries, half to the calibration. Of the first,
    DICT_DOCS of either class are drawn (of each DICT_PIECES pieces at most, evenly spaced); of the second
    CALIBRATION_DOCS whatever their class, so that classes keep their shares. What the driver gets is bounded
    at any size. Null labels are ignored; of several labels or texts of an id the largest holds.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    known = known.withColumns({"in_dict": F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0, "place": F.xxhash64(F.lit("place"), "doc_id")})
    parts = [known.where(F.col("in_dict") & (F.col("y") == y)).orderBy("place", "doc_id").limit(DICT_DOCS) for y in (0, 1)]
    parts.append(known.where(~F.col("in_dict")).orderBy("place", "doc_id").limit(CALIBRATION_DOCS))
    drawn = [tuple(r) for part in parts for r in part.select("doc_id", "y", "in_dict").collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame(drawn, "sampled_id long, y int, in_dict boolean")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * DICT_DOCS + CALIBRATION_DOCS ids: broadcast, so that no text is shuffled
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("sampled_id")).groupBy("doc_id", "y", "in_dict").agg(F.max("text").alias("text"))

    def cut(batches):
        for b in batches:
            y, out = [], []
            for label, text in zip(b.column("y"), b.column("text")):
                parts = pieces((text.as_py() or "").encode("utf-8", "surrogatepass"))
                for p in parts[:: max(1, -(-len(parts) // DICT_PIECES))]:
                    y.append(label.as_py())
                    out.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.binary())], names=["y", "piece"])

    cuts = sorted((r[0], bytes(r[1])) for r in rows.where("in_dict").select("y", "text").mapInArrow(giving_back(cut), "y int, piece binary").collect())
    good, bad = (trained([p for y, p in cuts if y == k]) for k in (1, 0))

    def measure(batches):
        sizes = Sizes(good, bad)
        for b in batches:
            x = [sizes.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(c, pa.float64()) for c in np.array(x).reshape(-1, len(FEATURES)).T)], names=["doc_id", "y", *FEATURES])

    seen = sorted(tuple(r) for r in rows.where("not in_dict").select("doc_id", "y", "text").mapInArrow(giving_back(measure), "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).collect())
    return fitted(good, bad, np.array([r[2:] for r in seen]), np.array([r[1] for r in seen], float))


def scores(texts, model: Model, sizes: Sizes) -> np.ndarray:
    x = np.array([sizes.features(t) for t in texts]).reshape(-1, len(FEATURES))
    return 1 / (1 + np.exp(-np.clip(scaled(x, model.mean, model.scale) @ model.weights, -40, 40)))


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` and the score of each row's whole text, from 0 to 1; a null text counts as empty. One pass, no shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        sizes = Sizes(model.good, model.bad)
        for b in batches:
            s = scores((t.as_py() for t in b.column(text_col)), model, sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(giving_back(run), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts get the score that the calibration gives to an empty text. Null ids pass (held_out
    null). Repeated rows get equal scores. Without labels of both classes every score is the smoothed share
    of label 1. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_score(rows, fit(docs, labels)).drop("text")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns."""
    name = free_name(docs.columns, "score")
    return with_score(docs, fit(docs, labels), name).where(F.col(f"`{name}`") >= THRESHOLD).drop(name)
