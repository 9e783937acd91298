"""Hard negatives by one-dimensional distance keys.

1. Each vector x takes one more component, sqrt(M^2 - |x|^2), where M is the greatest norm; an anchor takes 0 there. The nearest rows to an anchor are
   then those of greatest inner product.
2. A vector's key is (its nearest pivot, its distance to it). The index is range-partitioned and sorted by this key and packed in segments of
   bounded size; rows that repeat stand side by side and still spread over segments.
3. An anchor scans key intervals: rows within r of it have keys within r of its own distance to their pivot. The interval grows on both
   sides, each row is met in one annulus only, and an anchor stops when no row beyond r can enter one of its lists.
4. A first search finds the positives (same label), a second the negatives (other labels) below each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._cut import cut
from ._vectors import LAST, NONE, Best, exact_type, id_array, in_blocks, matrix, meet, packed, parts, peak, runs, unpacked, whole

SEGMENT = "dim long, pivot long, uids binary, ids binary, missing binary, labels binary, vectors binary, keys binary, asks binary, n_asks long"
CHUNK = 64  # segments that a task holds at a time
SLACK = 1e-5  # of M: more than rounding moves a distance


class Space:
    """Distances after the further component has made all norms M."""

    def __init__(self, square: float, pivots: list[list[int]]):
        self.square = square
        self.slack = SLACK * (square**0.5 + 1)
        self.pivots: dict[int, np.ndarray] = {}
        for d in {len(p) for p in pivots}:
            self.pivots[d] = np.array([p for p in pivots if len(p) == d], float).reshape(-1, d)

    def further(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))

    def to_pivots(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances to the pivots of this dimension, or where it has none to the origin."""
        norm = (x * x).sum(1) + last * last
        p = self.pivots.get(x.shape[1])
        if p is None:
            return np.sqrt(norm)[:, None]
        inner = x @ p.T + last[:, None] * self.further(p)
        return np.sqrt(np.maximum(norm[:, None] + self.square - 2 * inner, 0))

    def reach(self, norm: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A score that no row farther than ``radius`` reaches; ``norm`` is the anchors' squared norm."""
        return (norm + self.square - radius * radius) / 2 + self.slack * (self.square**0.5 + 1)


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                x = matrix(rows.column("vector"), d).astype(float)
                away = space.to_pivots(x, space.further(x))
                pivot = away.argmin(1)
                rows = rows.append_column("pivot", pa.array(pivot))
                yield rows.append_column("key", pa.array(away[np.arange(len(x)), pivot]))

    return run


def _segments(segment_rows: int, segment_bytes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for rows in runs(batches, ["dim", "pivot"], lambda k: max(1, min(segment_rows, segment_bytes // (8 * max(k["dim"], 1))))):
            dim, pivot = rows["dim"][0].as_py(), rows["pivot"][0].as_py()
            ids, asks = rows["id"].combine_chunks(), np.flatnonzero(rows["asks"].to_numpy())
            uids = place + np.arange(len(rows))
            place += len(rows)
            cells = [
                dim, pivot, packed(uids), packed(ids.fill_null(LAST).to_numpy()), packed(ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)),
                packed(rows["label"].to_numpy()), packed(matrix(rows["vector"], dim)), rows["key"].to_numpy().tobytes(), packed(asks), len(asks),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], [f.split()[0] for f in SEGMENT.split(", ")])

    return build


class _Segment:
    def __init__(self, row: dict):
        self.dim, self.pivot = row["dim"], row["pivot"]
        self.uids, self.ids, self.labels, self.asks = (unpacked(row[c]) for c in ("uids", "ids", "labels", "asks"))
        self.missing = unpacked(row["missing"]).astype(bool)
        self.x = unpacked(row["vectors"]).reshape(len(self.ids), self.dim)
        self.keys = np.frombuffer(row["keys"])
        self.peak = peak(self.x)


class Anchors:
    """Anchors of one dimension, each with ``m`` lists: list j takes rows of scores from ``low`` to ``high`` with the anchor's label or another."""

    def __init__(self, space: Space, q, uids, labels, lows, highs, same: bool, k: int, floor=None):
        self.space, self.q, self.uids, self.labels, self.lows, self.highs, self.same = space, q, uids, labels, lows, highs, same
        self.m = lows.shape[1]
        self.best = Best(lows.size, k, floor)
        x = q.astype(float)
        self.norm, self.peak = (x * x).sum(1), peak(q)
        self.away = space.to_pivots(x, np.zeros(len(q)))

    def open(self, radius: float) -> np.ndarray:
        """Which anchors may still take a row farther than ``radius`` into one of their lists."""
        reach = self.space.reach(self.norm, np.full(len(self.q), radius))[:, None]
        least = np.maximum(self.best.least().reshape(self.lows.shape).astype(float), self.lows)
        return ((reach > least) & (self.lows <= self.highs)).any(1)

    def search(self, segments: list[_Segment]) -> None:
        """Expanding key intervals over ``segments``."""
        if not len(self.q):
            return
        gaps = np.array([np.maximum(np.maximum(s.keys[0] - self.away[:, s.pivot], self.away[:, s.pivot] - s.keys[-1]), 0) for s in segments]).T
        spans = np.array([np.maximum(abs(s.keys[0] - self.away[:, s.pivot]), abs(s.keys[-1] - self.away[:, s.pivot])) for s in segments]).T
        before, radius, end = -1.0, max(self.space.square**0.5 / 64, 1e-9), spans.max()
        live = self.open(0.0)
        while live.any() and before < end:
            wide = radius + 2 * self.space.slack
            meets = live[:, None] & (gaps <= wide) & (spans > before)
            for g in np.flatnonzero(meets.any(0)):
                self._scan(segments[g], np.flatnonzero(meets[:, g]), before, wide)
            live &= self.open(radius)
            before, radius = wide, radius * 2

    def _scan(self, s: _Segment, who: np.ndarray, before: float, wide: float) -> None:
        away = self.away[who, s.pivot]
        rows = slice(np.searchsorted(s.keys, away.min() - wide), np.searchsorted(s.keys, away.max() + wide, "right"))
        kind = exact_type(s.dim, self.peak, s.peak)
        scores = (self.q[who].astype(kind) @ s.x[rows].astype(kind).T).astype(np.float64 if kind != np.int64 else np.int64)
        ring = abs(s.keys[rows][None, :] - away[:, None])
        fits = (ring > before) & (ring <= wide) & ((s.labels[rows][None, :] == self.labels[who][:, None]) == self.same) & (s.uids[rows][None, :] != self.uids[who][:, None])
        least = np.maximum(self.best.least().reshape(self.lows.shape), self.lows)
        for j in range(self.m):
            i, r = np.nonzero(fits & (scores >= least[who, j][:, None]) & (scores <= self.highs[who, j][:, None]))
            self.best.add(who[i] * self.m + j, scores[i, r].astype(np.int64), s.ids[rows][r], s.missing[rows][r])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Segment]]:
    held: list[_Segment] = []
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(_Segment(batch.slice(i, 1).to_pylist()[0]))
            if len(held) == CHUNK:
                yield held
                held = []
    if held:
        yield held


def _own(space: Space, k: int):
    """The anchors of each segment, with the k-th score of their own label in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for s in chunk:
                n = len(s.asks)
                if not n:
                    continue
                full = np.full((n, 1), NONE), np.full((n, 1), LAST)
                mine = Anchors(space, s.x[s.asks], s.uids[s.asks], s.labels[s.asks], *full, True, k)
                mine.search([s])
                cells = [s.uids[s.asks], id_array(s.ids[s.asks], s.missing[s.asks]), s.labels[s.asks], np.full(n, s.dim), [packed(v) for v in mine.q], mine.best.least()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], ["uid", "anchor_id", "label", "dim", "vector", "floor"])

    return run


def _everywhere(space: Space, k: int, same: bool):
    """Searches a block of anchors. Positives begin at the floor; for negatives the block names each list's limits."""

    def search(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dims, uids, labels, vectors = block["dim"].to_numpy(), block["uid"].to_numpy(), block["label"].to_numpy(), block["vector"].to_pylist()
            sides: dict[int, tuple[np.ndarray, Anchors]] = {}
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                q = np.array([unpacked(vectors[i]) for i in at]).reshape(len(at), d)
                if same:
                    floor = block["floor"].to_numpy()[at]
                    limits = floor[:, None].copy(), np.full((len(at), 1), LAST)
                else:
                    floor, given = None, [block["limits"][i.item()].as_py() for i in at]
                    most = max(map(len, given))
                    limits = tuple(np.array([[p[c] for p in g] + [pad] * (most - len(g)) for g in given]) for c, pad in (("low", 0), ("high", -1)))
                sides[d] = at, Anchors(space, q, uids[at], labels[at], *limits, same, k, None)
            for chunk in _chunks(batches):
                for d, (_, anchors) in sides.items():
                    if of := [s for s in chunk if s.dim == d]:
                        anchors.search(of)
            for at, anchors in sides.values():
                lists, scores, ids, missing = anchors.best.rows()
                cells = [pa.array(uids[at][lists // anchors.m]), pa.array(lists % anchors.m), id_array(ids, missing), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(cells, ["uid", "list", "vec_id", "score"])

        return run

    return search


FOUND = "uid long, list long, vec_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, low_pct: int = 80, high_pct: int = 100, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 64, segment_rows: int = 1024, segment_bytes: int = 4 << 20, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score) of the hard negatives of the rows that ``anchors`` holds for.

    A score is the inner product with the anchor, components counted as floor(scale * x). An anchor's positives are its ``positives`` best other rows of its
    label; each has as negatives the ``negatives`` best rows of other labels with low_pct * positive <= 100 * negative <= high_pct * positive. Ties go to the
    smaller id. Fewer candidates give fewer rows; an anchor without positives or negatives gives none, as does an empty table.
    Rows with a null label or vector, or a null, NaN or infinite component, take no part; a row without an id is no anchor by its id but a candidate,
    after others of its score. Vectors meet only those of their own number of components. Rows that repeat count each, so an anchor id that
    repeats has several rows of a rank. Products beyond a long raise ArithmeticError. Labels are whole numbers. Other columns are not read, whatever their names.
    The pivots are the ``pivots`` rows of smallest hash; any rows give the same result.
    """
    spark = rows.sparkSession
    fit = whole(rows, id_col, vector_col, scale, asks=F.coalesce(anchors, F.lit(False)), label=label.cast("long")).filter("label is not null")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = fit.agg(F.max(norm).alias("square"), F.count("*").alias("n")).first()
    drawn = [r["vector"] for r in fit.orderBy(F.xxhash64("vector"), "vector").limit(pivots).select("vector").collect()]
    space = Space((facts["square"] or 0.0) * (1 + 1e-9), drawn)
    keyed = fit.mapInArrow(_keyed(space), "id long, vector array<long>, dim long, asks boolean, label long, pivot long, key double")
    order = ["dim", "pivot", "key", "id"]
    n = parts(spark, facts["n"], 8 * segment_rows)
    sorted_rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    index = cut(sorted_rows.mapInArrow(_segments(segment_rows, segment_bytes), SEGMENT), "distance-keys")
    asked = index.agg(F.sum(F.col("n_asks") * (8 * F.col("dim") + 64 + 32 * positives * negatives)).alias("bytes")).first()["bytes"] or 0
    own = index.mapInArrow(_own(space, positives), "uid long, anchor_id long, label long, dim long, vector binary, floor long")
    queries, blocks = in_blocks(own, asked, block_bytes, "anchors")
    near = _ranked(meet(index, queries, blocks, _everywhere(space, positives, True), FOUND, "positives"), positives)
    near = cut(near.select("uid", (F.col("rank") - 1).cast("long").alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "ranked-positives")
    # 80 * positive <= 100 * negative <= 100 * positive, solved for whole scores
    low = F.ceil(F.col("positive_score") * F.lit(low_pct) / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = F.floor(F.col("positive_score") * F.lit(high_pct) / F.lit(100).cast("decimal(3,0)")).cast("long")
    limits = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("list", low.alias("low"), high.alias("high")))).alias("limits"))
    wanted, blocks = in_blocks(queries.drop("block", "floor").join(limits, "uid"), asked, block_bytes, "anchor-limits")
    far = _ranked(meet(index, wanted, blocks, _everywhere(space, negatives, False), FOUND, "negatives"), negatives)
    ids = queries.select("uid", "anchor_id")
    return (
        far.select("uid", "list", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["uid", "list"]).join(ids, "uid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
