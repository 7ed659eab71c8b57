"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, fits a text better.

A text is cut into blocks of equal size, so that the dictionaries matter all along a long text. Each block is
compressed with both; the difference of the sizes over all blocks, divided by the length of the text, is the feature,
and a logistic regression over other labelled rows turns it into a probability.

Training reads a bounded sample of the labelled rows outside the held-out fold: per label the ``per_class`` first by a
hash of the id, of which every second one feeds the dictionaries and the others the calibration. Texts above
``max_chars`` characters are not sampled, which bounds the sample's bytes; every text is scored whole.

Nulls and odd cases: null and empty texts have feature 0 and get the score of that; null labels and labels of unknown
documents are ignored; several labels of a document each count; if a label is missing altogether, the score is the
smoothed share of good rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, table
from tidelog.llm.training import fit_logistic, held_out, one_each, sample_per_class

FOLDS, FOLD = 5, 0
PER_CLASS = 1600
MAX_CHARS = 20_000
DICT_BYTES = 256 * 1024
BLOCK = 512
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    """Dictionaries are kept as bytes; each task makes its own compressors."""

    good: bytes = b""
    bad: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def __post_init__(self):
        self._tools = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_tools": None}

    def feature(self, data: bytes | None) -> float:
        """Size with the bad dictionary less that with the good one, per byte."""
        if not data or not self.good or not self.bad:
            return 0.0
        if self._tools is None:
            self._tools = [_compressor(self.bad), _compressor(self.good)]
        bad, good = self._tools
        less = 0
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            less += len(bad.compress(part)) - len(good.compress(part))
        return less / len(data)

    def score(self, data: bytes | None) -> float:
        a, b = self.weights
        return float(1.0 / (1.0 + np.exp(-np.clip(a * self.feature(data) + b, -35, 35))))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few or too alike texts zstandard makes none, and the texts' starts serve as one."""
    if not texts:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        share = max(64, DICT_BYTES // len(texts))
        return b"\n".join(text[:share] for text in texts)


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad) of the rows to learn from."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    fit = docs.filter((F.length("text") > 0) & (F.length("text") <= max_chars)).select("doc_id", "text")
    # Joined before sampling by id alone: texts of sampled rows are the only ones that move.
    ids = sample_per_class(known.join(fit.select("doc_id"), "doc_id", "left_semi"), "quality", per_class)
    rows = one_each(fit, ids, "quality").select("quality", "doc_id", F.col("text").cast("binary").alias("text"))
    taken = sorted(map(tuple, rows.collect()))
    texts = {q: [bytes(t) for label, _, t in taken if label == q] for q in (0, 1)}
    model = Model(_dictionary(texts[1][::2]), _dictionary(texts[0][::2]))
    rest = [(q, t) for q in (0, 1) for t in texts[q][1::2]]
    seen = known.groupBy("quality").count().collect()
    share = {r["quality"]: r["count"] for r in seen}
    good, bad = share.get(1, 0) + 1, share.get(0, 0) + 1
    if len({q for q, _ in rest}) < 2:
        model.good = model.bad = b""
        model.weights = np.array([0.0, np.log(good / bad)])
        return model
    x = np.array([[model.feature(t)] for _, t in rest])
    y = np.array([q for q, _ in rest])
    model.weights = fit_logistic(x, y)
    # The sample holds the labels in equal parts; the corpus does not.
    sampled = (y == 1).sum() / (y == 0).sum()
    model.weights[1] += np.log(good / bad) - np.log(sampled)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` added, the other columns unchanged."""
    name = "__quality_score"
    kept = docs.columns
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = pa.array([model.score(_bytes(t)) for t in text], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def _bytes(value: pa.Scalar) -> bytes | None:
    got = value.as_py()
    return got.encode() if isinstance(got, str) else got


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from the labels outside the held-out fold."""
    return train(docs, labels.filter(~held_out(F.col("doc_id"), FOLDS, FOLD)), **options)


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).withColumnRenamed("__quality_score", "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
