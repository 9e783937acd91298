"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector over hashed text features shared by all grades and ordered
thresholds theta_1 < theta_2 < ... Features are present or absent: each hashed lower-case word, its first four and five letters, and the class of each word shape's share
of the text. An L1 penalty leaves words without evidence at exactly zero, so the length of a text does not move its grade.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ._sample import bounded_ids
from ._words import slices, tidied, words_of

BITS = 20
PREFIXES = (4, 5)
SHAPES = ("upper", "marks", "bar", "letters", "digits", "mixed", "bang", "repeat")
STEPS = np.array([0.02, 0.1, 0.3, 0.6])
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << BITS) - 1)


def _shapes(words: pa.Array) -> np.ndarray:
    """(words, shapes) booleans; ``repeat`` is filled in by position."""
    out = np.zeros((len(words), len(SHAPES)), bool)
    bare = pc.utf8_trim(words, EDGE)
    letters = pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False)
    upper = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False)
    long = pc.greater(pc.utf8_length(bare), 1).to_numpy(zero_copy_only=False)
    out[:, 0] = upper & long
    out[:, 1] = pc.match_substring_regex(words, r"[^\pL\pN\s.,;:!?'\"()\-|]").to_numpy(zero_copy_only=False)
    out[:, 2] = pc.match_substring_regex(words, r"^\|+$").to_numpy(zero_copy_only=False)
    out[:, 3] = letters
    out[:, 4] = pc.match_substring_regex(words, r"\pN").to_numpy(zero_copy_only=False)
    out[:, 5] = out[:, 4] & letters
    out[:, 6] = pc.match_substring(words, "!!").to_numpy(zero_copy_only=False)
    return out


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of every feature present, each once; words only where ``wanted`` marks their bucket."""
    codes, offsets, words = words_of(texts)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bare = pc.utf8_lower(pc.utf8_trim(words, EDGE))
    found = [np.zeros(0, np.int64)]
    for length in (0, *PREFIXES):
        # hashed once for each distinct word or beginning of the batch
        part = (pc.utf8_slice_codeunits(bare, 0, length) if length else bare).dictionary_encode()
        beginnings = part.dictionary.to_pylist()
        bucket = np.fromiter((_bucket(f"{length}^{w}" if length else w) for w in beginnings), np.int64, len(beginnings))[part.indices.to_numpy()]
        use = np.ones(len(bucket), bool) if wanted is None else wanted[bucket] if len(bucket) else np.zeros(0, bool)
        if length:
            use &= pc.greater(pc.utf8_length(bare), length).to_numpy(zero_copy_only=False)
        hit = use[codes] if len(codes) else np.zeros(0, bool)
        found.append(doc[hit] * (1 << BITS) + bucket[codes[hit]])
    pairs = np.unique(np.concatenate(found))
    shape = _shapes(words)
    total = np.maximum(1, np.diff(offsets))
    rows, cols = [pairs >> BITS], [pairs & ((1 << BITS) - 1)]
    for s, name in enumerate(SHAPES):
        if name == "repeat":
            on = np.zeros(len(codes), bool)
            on[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        else:
            on = shape[codes, s] if len(codes) else np.zeros(0, bool)
        share = np.bincount(doc[on], minlength=n) / total
        level = np.searchsorted(STEPS, share, "right")
        rows.append(np.arange(n))
        cols.append((1 << BITS) + s * (len(STEPS) + 1) + level)
    return np.concatenate(rows), np.concatenate(cols)


SIZE = (1 << BITS) + len(SHAPES) * (len(STEPS) + 1)


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.wanted = weights[: 1 << BITS] != 0

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, levels: int, rounds: int = 400, l1: float = 1e-3, least_docs: int = 4) -> OrdinalModel:
        """Accelerated proximal gradient on the mean cumulative-link loss, grades weighing alike; deterministic."""
        n = len(grades)
        often = np.bincount(cols, minlength=SIZE)[cols] >= least_docs  # rarer features are no evidence
        rows, cols = rows[often], cols[often]
        used, col = np.unique(cols, return_inverse=True)
        col = col.astype(np.int32)
        share = np.bincount(grades, minlength=levels)
        importance = (1.0 / np.maximum(1, share))[grades] / max(1, (share > 0).sum())
        above = grades[:, None] >= np.arange(1, levels)[None, :]
        theta = np.linspace(-1.0, 1.0, levels - 1) if levels > 2 else np.zeros(levels - 1)
        w = np.zeros(len(used))
        step = 2.0 / (max(1, levels - 1) * cls._curvature(rows, col, importance, len(used)))
        velocity_w, velocity_t = np.zeros_like(w), np.zeros_like(theta)
        for turn in range(rounds if n else 0):
            momentum = turn / (turn + 3)
            look_w, look_t = w + momentum * velocity_w, theta + momentum * velocity_t
            score = np.bincount(rows, look_w[col], n)
            slack = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - look_t[None, :], -30, 30))) - above
            slack *= importance[:, None]
            new = look_w - step * np.bincount(col, slack.sum(1)[rows], len(used))
            new = np.sign(new) * np.maximum(0.0, np.abs(new) - step * l1)
            grown = np.sort(look_t + 2.0 * slack.sum(0))
            velocity_w, velocity_t, w, theta = new - w, grown - theta, new, grown
        weights = np.zeros(SIZE, np.float32)
        weights[used] = w
        return cls(weights, theta)

    @staticmethod
    def _curvature(rows: np.ndarray, col: np.ndarray, importance: np.ndarray, width: int) -> float:
        """The largest eigenvalue of the weighted feature products, by power iteration (a tenth above what it has reached)."""
        v, value = np.ones(width), 1.0
        for _ in range(30 if width else 0):
            v = np.bincount(col, (importance * np.bincount(rows, v[col], len(importance)))[rows], width)
            value = float(np.linalg.norm(v)) or 1.0
            v /= value
        return max(1e-9, 1.1 * value)

    def tails(self, texts: pa.Array) -> np.ndarray:
        """(texts, levels - 1): P(grade >= 1), P(grade >= 2), ..."""
        rows, cols = features(texts, self.wanted)
        score = np.bincount(rows, self.weights[cols], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def grade_of(quality, toxic):
    """0: toxic, 1: poor, 2: good; null where either rating is."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def fit(docs: DataFrame, ratings: DataFrame, levels: int = 3, per_grade: int = 3000, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = 1 << 20, **options) -> OrdinalModel:
    """A model from about ``per_grade`` rated documents of each grade; ``ratings`` has the id and an int ``grade``.

    Null grades, null texts, texts of more than ``text_bytes`` bytes and ratings without a document are not learned from; a document with several ratings
    counts with its lowest, and of an id's several texts one is learned from. Without any rating every document gets the same tails.
    """
    one = ratings.filter("grade is not null").groupBy(id_col).agg(F.min("grade").alias("grade"))
    some = bounded_ids(one, "grade", id_col, per_grade)
    picked = docs.select(id_col, text_col).filter(F.octet_length(text_col) <= text_bytes).join(F.broadcast(some), id_col)  # at most per_grade a grade
    picked = picked.groupBy(id_col, "grade").agg(F.min(text_col).alias(text_col)).select(id_col, text_col, "grade")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                rows, cols = features(part.column(text_col))
                order = np.argsort(rows, kind="stable")
                ends = np.cumsum(np.bincount(rows, minlength=part.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(cols[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("grade"), lists], names=["id", "grade", "cols"])

    found = picked.mapInArrow(tidied(describe), f"id {docs.schema[id_col].dataType.simpleString()}, grade int, cols array<int>").toArrow()
    found = found.sort_by("id").combine_chunks()  # one row an id; columns stay packed, as a list a row would take several times their memory
    lists = found["cols"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows = np.repeat(np.arange(len(found), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    return OrdinalModel.fit(rows, lists.flatten().to_numpy(), found["grade"].to_numpy().astype(np.int64), levels, **options)


def score(docs: DataFrame, model: OrdinalModel, levels: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, tails (array of P(grade >= k)).

    Null text is the empty text; repeated rows and very long texts score like any other; extra columns pass through,
    but columns named like the two new ones give way to them; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights
    docs = docs.select(*[c for c in docs.columns if c == text_col or c.lower() not in ("expected_grade", "tails")])
    names = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                tails = shared.value.tails(part.column(text_col))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(tails.sum(1)), lists], names=[*names, "expected_grade", "tails"])

    out = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]
    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, *out]))


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade (0 to 2), p_not_toxic, p_good, toxic, keep.

    ``toxic``: P(grade >= 1) below one half; ``keep``: P(grade >= 2) of ``keep_from`` or more. Null, empty and very long
    texts, ties, repeated rows and empty tables as in ``fit`` and ``score``; other columns of both tables are ignored.
    """
    model = fit(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"),
        (F.col("tails")[0] < 0.5).alias("toxic"), (F.col("tails")[1] >= keep_from).alias("keep"),
    )
