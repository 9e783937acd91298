import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, importance_resample, kd_search
from tidemark.llm._vectors import Best, exact_type, packed, runs, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, score string, rank int, block int, dim int"


def _whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(9)
    draw = lambda d: [rng.choice([rng.gauss(0, 0.2), 0.0, 0.25, -0.25]) for _ in range(d)]
    rows = [(i, draw(6), i % 10) for i in range(300)]
    rows += [(300 + i, rows[7][1], 3 if i % 2 else 4) for i in range(200)]  # a vector of a third of all rows
    rows += [(None, draw(6), 1), (None, rows[7][1], 3), (600, None, 1), (601, draw(6), None), (602, [None] + draw(5), 1), (603, [float("nan")] + draw(5), 2)]
    rows += [(604, [float("inf")] + draw(5), 2), (605, [float("-inf")] * 6, 2), (700, draw(3), 2), (710, draw(3), 2), (720, draw(3), 5), (740, [], 1), (741, [], 1)]
    rows += [(0, draw(6), 0), (100, rows[100][1], 0), (800, [0.0] * 6, 9), (801, [-0.2] * 6, 9)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(i, v, y, 1, "x", 2, 3, 4) for i, v, y in rows], SCHEMA).repartition(3)


def _fit(rows, scale):
    return [(i, _whole(v, scale), y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def _order(pair):
    score, i = pair
    return (-score, i is None, i or 0)


def _ranked(fit, at, allowed):
    q = fit[at][1]
    found = [(sum(a * b for a, b in zip(q, x)), i) for n, (i, x, y) in enumerate(fit) if n != at and len(x) == len(q) and allowed(y)]
    return sorted(found, key=_order)


@pytest.mark.parametrize("k,options", [(4, {}), (20, {"shard_rows": 37, "leaf": 5, "block_bytes": 4000}), (3, {"shard_bytes": 900, "leaf": 1})])
def test_kd_search_equals_brute_force(odd_vectors, k, options):
    rows, df = odd_vectors
    fit = _fit(rows, 64)
    want = Counter()
    for at, (i, *_) in enumerate(fit):
        if i is not None and i % 20 == 0:
            want.update((i, r + 1, j, s) for r, (s, j) in enumerate(_ranked(fit, at, lambda y: True)[:k]))
    got = kd_search.top_k(df, F.col("vec_id") % 20 == 0, k, **options)
    assert dict(got.dtypes)["rank"] == "int" and Counter(tuple(r) for r in got.collect()) == want


def test_no_vectors_and_no_queries(spark, odd_vectors):
    empty = spark.createDataFrame([], SCHEMA)
    assert kd_search.top_k(empty, F.lit(True)).count() == 0 and kd_search.top_k(odd_vectors[1], F.lit(False)).count() == 0
    label = F.col("label").cast("long")
    assert hard_negatives.mine(empty, F.lit(True), label).count() == 0 and hard_negatives.mine(odd_vectors[1], F.lit(False), label).count() == 0
    lone = spark.createDataFrame([(20, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert kd_search.top_k(lone, F.lit(True)).count() == 0 and hard_negatives.mine(lone, F.lit(True), label).count() == 0


def test_products_beyond_a_float(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-2.0**24, 2.0**24) for _ in range(4)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fit = [(i, [math.floor(64 * x) for x in v], y) for i, v, y in rows]
    want = {(i, r + 1, j, s) for at, (i, *_) in enumerate(fit) if i % 20 == 0 for r, (s, j) in enumerate(_ranked(fit, at, lambda y: True)[:5])}
    assert {tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 20 == 0, 5, leaf=7).collect()} == want
    with pytest.raises(ArithmeticError):
        exact_type(4, 1 << 31, 1 << 31)


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "segment_rows": 11, "block_bytes": 6000}, {"pivots": 1, "segment_bytes": 300}, {"low_pct": -50, "high_pct": 90, "positives": 2, "negatives": 7, "segment_rows": 30}])
def test_hard_negatives_equal_brute_force(odd_vectors, options):
    rows, df = odd_vectors
    fit = _fit([(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None], 256)
    n_pos, n_neg, low, high = (options.get(o, d) for o, d in (("positives", 5), ("negatives", 5), ("low_pct", 80), ("high_pct", 100)))
    want = Counter()
    for at, (i, _, y) in enumerate(fit):
        if i is None or i % 100:
            continue
        others = _ranked(fit, at, lambda z: z != y)
        for score, positive in _ranked(fit, at, lambda z: z == y)[:n_pos]:
            hard = [(s, j) for s, j in others if low * score <= 100 * s <= high * score][:n_neg]
            want.update((i, positive, r + 1, j, score, s) for r, (s, j) in enumerate(hard))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label, **options)
    assert len(want) > 20 and Counter(tuple(r) for r in got.collect()) == want


def test_annuli_meet_each_row_once_and_stop_when_certain():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (900, 4))
    space = hard_negatives.Space(float((x * x).sum(1).max()), x[:6].tolist())
    away = space.to_pivots(x.astype(float), space.further(x.astype(float)))
    pivot = away.argmin(1)
    segments, seen = [], Counter()
    for p in range(6):
        own = np.flatnonzero(pivot == p)
        own = own[np.argsort(away[own, p])]
        for part in np.array_split(own, max(1, len(own) // 40)):
            if len(part):
                cells = {"dim": 4, "pivot": p, "uids": packed(part), "ids": packed(part), "missing": packed(part * 0), "labels": packed(part * 0), "vectors": packed(x[part]),
                         "keys": away[part, p].tobytes(), "asks": packed(part[:0])}
                segments.append(hard_negatives._Segment(cells))
    q = x[[5]]
    one = hard_negatives.Anchors(space, q, np.array([5]), np.array([0]), np.full((1, 1), -(1 << 60)), np.full((1, 1), 1 << 60), True, 3)
    scan = one._scan

    def counted(s, who, before, wide):
        ring = abs(s.keys - one.away[0, s.pivot])
        seen.update(s.uids[(ring > before) & (ring <= wide)].tolist())
        scan(s, who, before, wide)

    one._scan = counted
    one.search(segments)
    want = np.sort((x @ q[0])[np.arange(900) != 5])[::-1][:3]
    assert one.best.scores[0].tolist() == want.tolist() and set(seen.values()) == {1} and len(seen) < 900


def test_kd_tree_boxes_are_tight_and_bounds_prune():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-9, 9, (500, 3)) + c for c in ([60, 0, 0], [0, 60, 0], [0, 0, -60])])
    order, starts, stops, lefts, lows, highs = kd_search.grow(x, 16)
    assert sorted(order.tolist()) == list(range(1500))
    for i, left in enumerate(lefts):
        rows = x[order[starts[i] : stops[i]]]
        assert (rows.min(0) == lows[i]).all() and (rows.max(0) == highs[i]).all()
        if left:
            assert (starts[left], stops[left], starts[left + 1], stops[left + 1]) == (starts[i], starts[left + 1], stops[left], stops[i])
    row = {"dim": 3, "uids": packed(order), "ids": packed(order), "missing": packed(order * 0), "asks": packed(order[:0]), "vectors": packed(x[order])}
    shard = kd_search._Shard(row | {n: packed(v) for n, v in zip(("starts", "stops", "lefts", "lows", "highs"), (starts, stops, lefts, lows, highs))})
    visits, leaf = [], shard._leaf
    shard._leaf = lambda *a: (visits.append(a[0]), leaf(*a))
    best = Best(1, 5)
    shard.search(np.array([[50, 1, 2]]), np.array([-1]), best, np.array([0]))
    assert best.scores[0].tolist() == np.sort(x @ [50, 1, 2])[::-1][:5].tolist() and len(visits) < (lefts == 0).sum() / 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63) + 2, 2**63 - 1)), st.integers(1, 5))
def test_packing_and_best_lists(values, k):
    assert unpacked(packed(np.array(values, np.int64))).tolist() == values
    best, lists = Best(2, k), np.array([v % 2 for v in values], np.int64)
    for half in (slice(0, len(values) // 2), slice(len(values) // 2, None)):
        v = np.array(values, np.int64)[half]
        best.add(lists[half], v // 1000, v, v < 0)
    for n in (0, 1):
        want = sorted((-(v // 1000), v, v < 0) for v in values if v % 2 == n)[:k]
        assert [(-s, i, m) for s, i, m in zip(best.scores[n].tolist(), best.ids[n].tolist(), best.missing[n].tolist())][: len(want)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=7), max_size=5), st.integers(1, 4))
def test_runs_keep_order_and_keys(batches, most):
    names = pa.schema([("k", pa.int64()), ("v", pa.int64())])
    n, data = 0, []
    for keys in batches:
        data.append(pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(n, n + len(keys)), pa.int64())], schema=names))
        n += len(keys)
    out = list(runs(iter(data), ["k"], lambda _: most))
    assert [v for t in out for v in t["v"].to_pylist()] == list(range(n)) and all(0 < len(t) <= most and len(set(t["k"].to_pylist())) == 1 for t in out)


PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


ALPHABET = list("aZ09 ,.\n\t\x00\x7fÄßé漢😀ſK-_~{`@[/:")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(ALPHABET), max_size=30)), max_size=6), st.integers(1, 3), st.integers(0, 3), st.booleans())
def test_automaton_equals_the_pattern(texts, longest, skip, wide):
    array = pa.array(texts, pa.large_string() if wide else pa.string()).slice(min(skip, len(texts)))
    crcs, of, words = importance_resample.features(array, longest)
    want = Counter()
    for t, text in enumerate(texts[min(skip, len(texts)) :]):
        ws = _words(text)
        assert words[t] == len(ws)
        want.update((t, zlib.crc32(" ".join(ws[i : i + n]).encode())) for n in range(1, longest + 1) for i in range(len(ws) - n + 1))
    assert Counter(zip(of.tolist(), crcs.tolist())) == want


def test_very_long_words():
    texts = ["x" * 3_000_000 + " " + "ab" * 40, "é" * 33 + "!" + "q" * 64, ""]
    crcs, of, _ = importance_resample.features(pa.array(texts), 2)
    want = Counter((t, zlib.crc32(f.encode())) for t, text in enumerate(texts) for ws in [_words(text)] for f in [*ws, *map(" ".join, zip(ws, ws[1:]))])
    assert Counter(zip(of.tolist(), crcs.tolist())) == want


def _drawn(rows, target, share=10, least=20, buckets=10_000, longest=1):
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = Counter(), Counter()
    for _, text in rows:
        raw.update(map(bucket, grams(_words(text))))
    for text in target:
        wanted.update(map(bucket, grams(_words(text))))
    s_all, t_all, out = raw.total(), wanted.total(), []
    for i, text in rows:
        fs = grams(_words(text))
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(able[: share * len(able) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("options", [{}, {"share": 60, "least": 2, "longest": 2, "buckets": 97}])
def test_resample_equals_brute_force(spark, odd_rows, odd_docs, options):
    target = [odd_rows[1][1], None, "", odd_rows[2][1].upper()]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    named = {{"share": "share_pct", "least": "least_words"}.get(k, k): v for k, v in options.items()}
    got = importance_resample.resample(odd_docs, goal, **named)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == _drawn([(r[0], r[1]) for r in odd_rows], target, **options)


def test_resample_of_nothing(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "text string")
    assert importance_resample.resample(no_docs, none).count() == 0
    got = importance_resample.resample(odd_docs, none)
    assert got.count() == odd_docs.count() and got.filter("rank is not null").count() > 0
    string_ids = spark.createDataFrame([("b", "w " * 30), ("a", "w " * 30), (None, "w")], "doc_id string, text string")
    assert {r.doc_id: r.rank for r in importance_resample.resample(string_ids, none, share_pct=100).collect() if r.rank}.keys() == {"a", "b"}
