"""Exact top-k search by inner product: a k-d tree per shard, best-first traversal, a kth score that travels on.

1. Rows are dealt evenly into shards of bounded size (by no key, so a vector that repeats spreads). Each shard is cut at the median of its widest
   dimension until leaves are small; every node keeps the tight box of its rows.
2. Every query, being a row itself, is searched in its own shard first: the kth score there is a bound that travels to all other shards.
3. Queries meet the shards in blocks of bounded size. In a shard, a query always opens the node whose box allows the greatest inner product, and stops
   when no open box allows its kth score; all queries of a block advance together, one node each a round. From shard to shard of a task the kth
   score goes on.
4. The best of all tasks are ranked for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._cut import cut
from ._vectors import NONE, LAST, Best, exact_type, id_array, in_blocks, matrix, meet, packed, parts, peak, runs, unpacked, whole

SHARD = "shard long, dim long, uids binary, ids binary, missing binary, vectors binary, asks binary, n_asks long, starts binary, stops binary, lefts binary, lows binary, highs binary"
STEP = 4096  # queries that advance together


def grow(x: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """(order of rows, starts, stops, lefts, lows, highs): node i holds the rows ``order[starts[i]:stops[i]]`` in the box ``lows[i]`` to
    ``highs[i]``; its children are lefts[i] and the next, or none (0)."""
    order, starts, stops, lefts, lows, highs = np.arange(len(x)), [0], [len(x)], [], [], []
    while len(lefts) < len(starts):
        a, b = starts[len(lefts)], stops[len(lefts)]
        part = x[order[a:b]]
        low, high = part.min(0), part.max(0)
        lows.append(low)
        highs.append(high)
        wide = int(np.argmax(high - low)) if x.shape[1] else 0
        if b - a <= leaf or not x.shape[1] or high[wide] == low[wide]:
            lefts.append(0)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, wide], middle)]
        lefts.append(len(starts))
        starts += [a, a + middle]
        stops += [a + middle, b]
    return order, np.array(starts), np.array(stops), np.array(lefts), np.array(lows), np.array(highs)


def _shards(shard_rows: int, shard_bytes: int, leaf: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24
        for n, rows in enumerate(runs(batches, ["dim"], lambda k: max(1, min(shard_rows, shard_bytes // (8 * max(k["dim"], 1)))))):
            dim = rows["dim"][0].as_py()
            x = matrix(rows["vector"], dim)
            order, *tree = grow(x, leaf)
            missing = rows["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)[order]
            ids = rows["id"].combine_chunks().fill_null(LAST).to_numpy()[order]
            asks = np.flatnonzero(rows["asks"].to_numpy()[order])
            uids = ((base + n) << 24) + np.arange(len(x))
            cells = [base + n, dim, packed(uids), packed(ids), packed(missing.astype(np.int64)), packed(x[order]), packed(asks), len(asks), *map(packed, tree)]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], [f.split()[0] for f in SHARD.split(", ")])

    return build


class _Shard:
    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.uids, self.ids = unpacked(row["uids"]), unpacked(row["ids"])
        self.missing, self.asks = unpacked(row["missing"]).astype(bool), unpacked(row["asks"])
        self.starts, self.stops, self.lefts = (unpacked(row[c]) for c in ("starts", "stops", "lefts"))
        shape = lambda c, n: unpacked(row[c], self.dim) if self.dim else np.zeros((n, 0), np.int64)
        self.x, self.lows, self.highs = shape("vectors", len(self.ids)), shape("lows", len(self.starts)), shape("highs", len(self.starts))
        self.peak = peak(self.x)

    def search(self, q: np.ndarray, uids: np.ndarray, best: Best, at: np.ndarray) -> None:
        """Adds to the lists ``at`` of ``best`` what the queries ``q`` (rows ``uids`` themselves excepted) find here."""
        kind = exact_type(self.dim, peak(q), self.peak)
        x, lows, highs = (a.astype(kind) for a in (self.x, self.lows, self.highs))
        for begin in range(0, len(q), STEP):
            some = slice(begin, begin + STEP)
            self._advance(q[some].astype(kind), uids[some], best, at[some], x, lows, highs)

    def _advance(self, q, uids, best, at, x, lows, highs) -> None:
        above, below = np.maximum(q, 0), np.minimum(q, 0)
        bound = lambda who, node: above[who] @ highs[node] + below[who] @ lows[node]
        every = np.arange(len(q))
        frontier = np.full((len(q), len(self.starts)), float("-inf"))  # the bounds of open nodes
        frontier[:, 0] = bound(every, 0)
        while True:
            node = frontier.argmax(1)
            live = np.flatnonzero(frontier[every, node] >= best.least()[at].astype(float))
            live = live[frontier[live, node[live]] > float("-inf")]
            if not len(live):
                return
            for n in np.unique(node[live]):
                who = live[node[live] == n]
                frontier[who, n] = float("-inf")
                if left := self.lefts[n]:
                    frontier[who, left], frontier[who, left + 1] = bound(who, left), bound(who, left + 1)
                else:
                    self._leaf(n, q, who, uids, best, at, x)

    def _leaf(self, n, q, who, uids, best, at, x) -> None:
        rows = slice(self.starts[n], self.stops[n])
        scores = q[who] @ x[rows].T
        fits = scores >= best.least()[at[who]].astype(scores.dtype)[:, None]
        i, j = np.nonzero(fits & (uids[who][:, None] != self.uids[rows]))
        best.add(at[who][i], scores[i, j].astype(np.int64), self.ids[rows][j], self.missing[rows][j])


def _own(k: int):
    """The queries of each shard with the kth score that they find in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row)
                n = len(shard.asks)
                if not n:
                    continue
                best, q = Best(n, k), shard.x[shard.asks]
                shard.search(q, shard.uids[shard.asks], best, np.arange(n))
                ids = id_array(shard.ids[shard.asks], shard.missing[shard.asks])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.uids[shard.asks]), ids, pa.array([shard.dim] * n), pa.array([packed(v) for v in q]), pa.array(best.least())],
                    ["uid", "query_id", "dim", "vector", "floor"],
                )

    return run


def _everywhere(k: int):
    def search(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dims, uids = block["dim"].to_numpy(), block["uid"].to_numpy()
            best = Best(len(block), k, block["floor"].to_numpy().copy())
            vectors = block["vector"].to_pylist()
            of = {d: np.flatnonzero(dims == d) for d in np.unique(dims).tolist()}
            q = {d: np.array([unpacked(vectors[i]) for i in at]).reshape(len(at), d) for d, at in of.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = _Shard(batch.slice(i, 1).to_pylist()[0])
                    if shard.dim in of:
                        at = of[shard.dim]
                        shard.search(q[shard.dim], uids[at], best, at)
            lists, scores, ids, missing = best.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids[lists]), block["query_id"].combine_chunks().take(pa.array(lists)), id_array(ids, missing), pa.array(scores)],
                ["uid", "query_id", "vec_id", "score"],
            )

        return run

    return search


def top_k(
    rows: DataFrame, asks: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 4096, shard_bytes: int = 16 << 20, leaf: int = 512, block_bytes: int = 16 << 20,
) -> DataFrame:
    """(query_id, rank int, vec_id, score): the ``k`` rows of greatest inner product for every row that ``asks`` holds for, itself excepted.

    Components count as floor(scale * x). Ties go to the smaller id. Null vectors and those with null, NaN or infinite components take no part;
    vectors meet only those of their own number of components (empty ones score 0 with each other). A row without an id is no query by its id, but a candidate, after others of its
    score. Of rows that repeat each is a query and a candidate of its own (an id that repeats then has several rows of a rank). Fewer than ``k``
    candidates give fewer rows, an empty table none. Products that do not fit in a long raise ArithmeticError. Other columns are not read, whatever their names.
    ``asks`` may use any column of ``rows``; ids are whole numbers.
    """
    spark = rows.sparkSession
    fit = whole(rows, id_col, vector_col, scale, asks=F.coalesce(asks, F.lit(False)))
    n = parts(spark, rows.count(), shard_rows)
    index = cut(fit.repartition(n).sortWithinPartitions("dim").mapInArrow(_shards(shard_rows, shard_bytes, leaf), SHARD), "kd-trees")
    asked = index.agg(F.sum(F.col("n_asks") * (8 * F.col("dim") + 32 + 32 * k)).alias("bytes")).first()["bytes"] or 0
    own = index.mapInArrow(_own(k), "uid long, query_id long, dim long, vector binary, floor long")
    queries, blocks = in_blocks(own, asked, block_bytes, "kd-queries")
    found = meet(index, queries, blocks, _everywhere(k), "uid long, query_id long, vec_id long, score long", "kd-found")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
