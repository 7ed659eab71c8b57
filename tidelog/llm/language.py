"""Language identification in two steps: the family of languages, then the language within it.

A text becomes the counts of its hashed letter triplets (lower-cased; all that is no letter is one blank), square-rooted
and of length 1. Linear support vector machines, one against the rest, tell the families apart. Within a family, one
machine for every pair of languages votes; equal votes go to the larger sum of margins. Languages outside the table of
families are a family of their own, so any set of labels can be learned.

Training reads a bounded sample: of each language the ``per_class`` labelled rows that come first by a hash of the id.
Their features, over whole texts, are computed in tasks; only these vectors reach the driver.

Nulls and odd cases: a null text, or one without a letter, is ``und`` with score 0; null labels are not learned; if
nothing could be learned all is ``und``; rows without id are predicted like others and never learned; repeated rows
are predicted alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.base import query, table
from tidelog.llm.training import fit_svm, held_out, one_each, sample_per_class

#: Fixed knowledge: closely related languages.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}
FOLDS, FOLD = 3, 1
PER_CLASS = 500
DIM = 1 << 12
UNKNOWN = "und"
_ROWS = 1 << 20
#: ASCII bytes that are no letters become blanks; letters are lower-cased; bytes of longer characters stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    data = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    data = b" " + b" ".join(data.split()) + b" "
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(DIM)
    for at in range(0, max(1, len(raw) - 2), _ROWS):
        part = raw[at : at + _ROWS + 2].astype(np.uint32)
        if len(part) < 3:
            break
        mixed = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA6B)) ^ (part[2:] * np.uint32(0xC2B2AE35))
        counts += np.bincount((mixed ^ mixed >> np.uint32(15)) & np.uint32(DIM - 1), minlength=DIM)
    root = np.sqrt(counts)
    size = np.linalg.norm(root)
    return root / size if size else root


def _margin(w: np.ndarray, x: np.ndarray) -> float:
    return float(w[:-1] @ x + w[-1])


def _sigmoid(m: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(3.0 * m, -35, 35))))


@dataclass
class Model:
    families: dict[str, list[str]]
    family_machines: dict[str, np.ndarray]
    pair_machines: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        margins = {f: _margin(w, x) for f, w in self.family_machines.items()}
        family = max(sorted(self.families), key=lambda f: margins.get(f, 0.0))
        sure = _sigmoid(margins[family]) if margins else 1.0
        votes = {name: [0, 0.0] for name in self.families[family]}
        duels = {}
        for a, b in combinations(self.families[family], 2):
            m = _margin(self.pair_machines[a, b], x)
            duels[a, b] = m
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(sorted(votes), key=lambda name: votes[name])
        for (a, b), m in duels.items():
            if best in (a, b):
                sure *= _sigmoid(m if best == a else -m)
        return best, sure


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    names = sorted({lang for lang, _ in rows})
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(FAMILIES.get(name, name), []).append(name)
    langs = np.array([lang for lang, _ in rows])
    x = np.array([v for _, v in rows], np.float64).reshape(len(rows), DIM)
    family = np.array([FAMILIES.get(lang, lang) for lang in langs])
    machines = {f: fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            own = (langs == a) | (langs == b)
            pairs[a, b] = fit_svm(x[own], np.where(langs[own] == a, 1.0, -1.0))
    return Model(families, machines, pairs)


def learn(docs: DataFrame, *, per_class: int = PER_CLASS) -> Model:
    """``docs`` has ``doc_id``, ``text`` and ``lang`` of the rows to learn from. An id counts once for a language. More than
    256 languages raise ``ValueError``: the machines are fitted on the driver, from ``per_class`` rows of each."""
    # Letters are asked for again below; here a text of blanks only is left out.
    fit = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    fit = fit.select("doc_id", F.col("lang").alias("label"), "text")
    ids = sample_per_class(fit.select("doc_id", "label").distinct(), "label", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, t) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            vectors = [features(t).astype(np.float32).tobytes() for _, t in kept]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array(vectors, pa.binary())],
                                             names=["label", "vector"])

    rows = one_each(fit, ids, "label").select("label", "text").mapInArrow(run, "label string, vector binary")
    taken = sorted((r["label"], bytes(r["vector"])) for r in rows.collect())
    return train([(label, np.frombuffer(v, np.float32)) for label, v in taken])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out(F.col("doc_id"), FOLDS, FOLD)))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
