import io
import json
import os
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import _cut, fair_mix, kd_shards, token_planes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8]))
def test_planes_round_trip(values, kind):
    ids = np.array(values, np.uint32)
    assert (token_planes.ids_of(token_planes.planes_of(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind", [1, 8])
def test_file_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(7, rng.integers(0, 50_000, 2500)), (None, np.zeros(0, int)), (-3, rng.integers(0, 9, 10)), (9, rng.integers(0, 70_000, 999))]
    out = io.BytesIO()
    writer = token_planes.PlaneWriter(out, 1000, kind)
    for i, ids in docs:
        writer.add([i], np.array([len(ids)]), ids)
    writer.close()
    reader = token_planes.PlaneReader(out)
    assert [(i, x.tolist()) for i, x in reader.documents()] == [(i, x.tolist()) for i, x in docs]
    whole = np.concatenate([x for _, x in docs])
    assert (reader.read_block(2) == whole[2000:3000]).all()
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(b"0" * 64))


ALPHABET = list(" \t\n.,'!$%&#*|;:sStTrReEvVmMlLdD12éÉßΣσςİı́\x85　漢<|>-_()\"")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(ALPHABET), max_size=40), st.text(max_size=20)), min_size=1, max_size=6))
def test_word_lookup_equals_the_library(texts):
    encoder = token_planes._encoder(PATH)
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, lengths = encoder.encode(pa.array(texts, pa.string()))
    want = [e.ids + [1] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_bounded_memory_and_other_vocabularies_equal_the_library():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdé1.,") for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(30)] + [None, "", "<|endoftext|>."]
    for path, wordwise in ((PATH, True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        encoder = token_planes.TextEncoder(path, most=40)
        assert encoder.wordwise == wordwise
        for at in range(0, len(texts), 5):
            some = texts[at : at + 5]
            ids, lengths = encoder.encode(pa.array(some, pa.string()))
            want = [e.ids + [1] for e in encoder.tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_token_output_equals_the_library(odd_docs, odd_rows, no_docs):
    tokenizer = token_planes._encoder(PATH).tokenizer
    got = token_planes.encode(odd_docs.repartition(4), PATH).orderBy("start").collect()
    assert len(got) == len(odd_rows)
    want, start = defaultdict(list), 0
    for i, text, *_ in odd_rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    have = defaultdict(list)
    for r in got:
        assert r.start == start
        start += r.n_tokens
        have[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[-1].doc_id is None
    assert token_planes.encode(no_docs, PATH).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_special_tokens_in_texts_as_the_library_has_them(spark, special_as_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = special_as_text
    start, stop = "<|startoftext|>", "<|endoftext|>"
    texts = [f"{start}One two.{stop}", f"a {stop} b", f"A{stop}, B!{start}{stop}x.", "<|EndOfText|> <|endoftext |>", f"é{stop}\u0301 'S{start}'s", f"{stop}|>", None, "plain Text."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_planes.encode(docs, PATH, special_as_text=special_as_text).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_are_even_and_slots_gapless(odd_docs, odd_rows, no_docs):
    rows = kd_shards.by_metadata(odd_docs).collect()
    assert len(rows) == len(odd_rows) and {r.law for r in rows} == {"bytes"}
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in odd_rows)
    assert sorted((r.size, r.text_crc32) for r in rows) == want
    assert kd_shards.by_metadata(no_docs).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shard_sizes_near_equal_with_a_hot_value(spark, shards):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(1, 60), "en", "hot" if i % 3 else f"s{i % 11}") for i in range(1500)]
    out = kd_shards.by_metadata(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6), shards)
    sums = [r["n"] for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == shards and max(sums) - min(sums) <= 4 * 61


def test_shards_equal_a_brute_force_tree(spark):
    rng = random.Random(6)
    sources = [f"https://a-long-common-prefix/{i}" for i in range(9)] + [None]
    rows = [(i, "x" * rng.randint(0, 90), rng.choice(["en", "de", None]), rng.choice(sources[:1] * 8 + sources)) for i in range(700)] + [(None, None, "en", sources[3])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = sorted((r.shard, r.slot, r.doc_id, r.size) for r in kd_shards.by_metadata(docs, 6).collect())
    ids = docs.select("doc_id", "text", "lang", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    ids = ids.withColumn("tie", F.xxhash64("doc_id", "crc")).collect()
    low = lambda v: (v is not None, v)
    place = {c: {v: float(i) for i, v in enumerate(sorted({r[c] for r in ids}, key=low))} for c in ("source", "lang")}
    points = [((place["source"][r.source], place["lang"][r.lang], float(len(r.text or ""))), r.tie, low(r.doc_id), r.crc, len(r.text or "") + 1) for r in ids]
    spread = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in range(3)]

    def split(some, leaves):
        if leaves == 1:
            return [some]
        width = [(max(p[0][d] for p in some) - min(p[0][d] for p in some)) / (spread[d] or 1.0) for d in range(3)]
        d = width.index(max(width))
        total, before, half, sides = sum(p[4] for p in some), 0, leaves // 2, ([], [])
        for p in sorted(some, key=lambda p: (p[0][d], *p[1:4])):
            sides[(2 * before + p[4]) * leaves > 2 * total * half].append(p)
            before += p[4]
        return split(sides[0], half) + split(sides[1], leaves - half)

    want = [(s, i, p[2][1], p[4]) for s, leaf in enumerate(split(points, 6)) for i, p in enumerate(sorted(leaf, key=lambda p: (p[2], p[3])))]
    key = lambda x: (x[0], x[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def _fill(sizes, budget):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, free = {}, dict(weight)
    while free:
        level = (budget - sum(target.values())) / sum(free.values())
        over = [s for s in free if level * free[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in free.items()}
        for s in over:
            target[s] = 2.0 * sizes[s]
            del free[s]
    return target


def test_mix_meets_targets(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["b"] * 12 + ["a", "c", "d", "é", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = fair_mix.mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes["1" if source is None else "0" + source] += len(text.split())
    want = _fill(sizes, 1.5 * sum(sizes.values()))
    taken, source_of = defaultdict(int), {i: "1" if s is None else "0" + s for i, _, s in rows}
    for r in got:
        assert r.size in (r.taken, r.taken - r.size) or r.taken == 0
        assert r.source_size == sizes[source_of[r.doc_id]] and abs(r.target - want[source_of[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 41 for s in want)
    assert sorted(got) == sorted(fair_mix.mix(docs.repartition(3)).collect())
    odd = fair_mix.mix(odd_docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in odd) == sorted(words(t) for _, t, *_ in odd_rows)
    assert all(r.taken <= 2 * r.size for r in odd)
    assert fair_mix.mix(no_docs).count() == 0


def test_mixed_rows_follow_the_mix(odd_docs):
    mixed = fair_mix.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    total = fair_mix.mix(odd_docs).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(fair_mix.word_count(F.col("text")))).first()[0] == total


def test_no_path_is_local(spark):
    source = open(token_planes.__file__).read() + json.dumps(os.listdir(os.path.dirname(token_planes.__file__)))
    assert "localCheckpoint" not in source and "/tmp" not in source


def test_batches_of_written_tables_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("a"), F.when(F.col("id") == 7, 9_000_000).otherwise(8_000)).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    before = spark.conf.get(key)
    got = [(r.rows, r.size) for r in _cut.cut(docs.mapInArrow(sizes, "rows long, size long"), "batches").collect()]
    assert sum(rows for rows, _ in got) == 2000 and spark.conf.get(key) == before
    usual = sorted(size for _, size in got)[:-1]  # the last holds the row that is longer than the bound
    bound = (4 << 20) + 10_000  # and the row that goes beyond
    assert max(usual) <= bound and max(size for _, size in got) <= 9_000_000 + bound


def test_ids_are_gathered_in_pieces():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=n)) for n in [900] * 300 + [70_000, 0, 1]] + [None]
    encoder = token_planes.TextEncoder(PATH)
    encoder.encode(pa.array(texts[:30]))
    body = pa.array(texts, pa.string())
    tracemalloc.start()
    ids, lengths = encoder.encode(body)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert most < 4 * ids.nbytes
