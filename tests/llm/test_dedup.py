import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_winnow, ngram_join
from tidemark.llm._components import components


def _squash(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("options", [{}, {"hot_rows": 0}, {"digest": lambda t: F.substring(F.sha2(t, 256), 1, 1), "hot_rows": 0}])
def test_exact_dedup_equals_brute_force(odd_docs, odd_rows, options):
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[_squash(text)].append(i)
    want = []
    for i, text, *_ in odd_rows:
        ids = groups[_squash(text)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(odd_docs, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_digest(odd_docs, no_docs):
    row = exact_dedup.dedup(odd_docs).filter("doc_id = 63").first()
    assert row.text_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert exact_dedup.dedup(no_docs).count() == 0


def _shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def _brute_components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_ngram_join_equals_brute_force(spark, odd_docs, odd_rows, no_docs):
    want = _brute_components([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    got = ngram_join.join(odd_docs.filter("doc_id is not null")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert ngram_join.join(odd_docs).count() == len(odd_rows)
    assert ngram_join.join(no_docs).count() == 0


def test_ngram_join_chains_and_borderline_pairs(spark):
    """Copies edited step by step link in chains; sets at 74 to 76 percent fall on their right side."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, text = [], [word() for _ in range(60)]
    for i in range(40):
        text = list(text)
        text[(7 * i) % 60] = word()
        rows.append((i, " ".join(text)))
    base = [word() for _ in range(104)]
    for i, cut in enumerate(range(8, 24)):
        rows.append((100 + i, " ".join(base[:-cut] + [word() for _ in range(cut)])))
    rows.append((99, " ".join(base)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), per_bucket=50)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _brute_components(rows)


@pytest.mark.parametrize("per_task", [25, 1000])
def test_components_of_a_path_and_a_star(spark, per_task):
    rng = random.Random(2)
    path = list(range(0, 301))
    rng.shuffle(path[1:])
    edges = [(a, b) for a, b in zip(path, path[1:], strict=False)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (3000, 2999), (5, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), per_task=per_task).collect()}
    assert all(got[i] == 0 for i in path) and all(got[1000 + i] == 1000 for i in range(60)) and got[3000] == 2999 and len(got) == 301 + 60 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_lets_every_key_through(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    from tidemark.llm._bitmap import within

    rows = spark.range(50_000).select("id", F.xxhash64("id").alias("key"))
    passed = rows.filter(within(keys, "key")(F.col("key")))
    assert passed.filter("id < 5000").count() == 5000 and passed.count() < 5000 + 0.2 * 45_000


def test_ngram_join_of_unlinked_rows_of_one_template(spark):
    """Rows that share 20 words and link with none never meet one by one: pairs are ruled out by their profiles."""
    rows = [(i, " ".join([f"t{j}" for j in range(20)] + [f"own{i}x{j}" for j in range(3)])) for i in range(3000)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(3)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[5000 + i] == i for i in range(3)) and all(got[i] == i for i in range(3000))


def test_ngram_join_in_blocks(spark, monkeypatch):
    """Many classes of one shingle in different components, in blocks of few classes."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, shared = [], [word() for _ in range(30)]
    for i in range(60):
        text = list(shared)
        for at in rng.sample(range(30), rng.choice([1, 1, 2])):
            text[at] = word()
        rows.append((i, " ".join(text)))
    want = _brute_components(rows)
    for stars in (0, 1, 2):
        monkeypatch.setattr(ngram_join._across, "__defaults__", (4,))
        got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), stars=stars).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def _brute_lines(rows, least):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [(p, line) for p, line in enumerate(lines) if line.split()]
        gone, windows = set(), []
        for a in range(len(full)):
            for b in range(a, len(full)):
                if sum(len(x.split()) for _, x in full[a : b + 1]) >= least:
                    windows.append((full[a][0], full[b][0], tuple(x for _, x in full[a : b + 1])))
        for first, last, body in sorted(windows):
            if body in seen:
                gone |= set(range(first, last + 1))
            seen.add(body)
        out[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def test_line_winnowing_equals_all_windows(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = []
    for i in range(40):
        body = [rng.choice(lines) for _ in range(rng.randint(0, 8))]
        if i % 3:
            at = rng.randint(0, 50)
            body += lines[at : at + rng.randint(2, 8)] + ([""] if i % 2 else [])
        rows.append((i, "\n".join(body)))
    got = line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=10)
    assert {r.doc_id: (r.n_lines, r.removed_lines, r.clean_text) for r in got.collect()} == _brute_lines(rows, 10)


def test_line_winnowing_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = line_winnow.dedup_lines(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert {r.clean_text for r in got if r.doc_id == 60} == {""}
    assert all(r.removed_lines <= r.n_lines for r in got)
    assert line_winnow.dedup_lines(no_docs).count() == 0


def test_line_winnowing_of_the_largest_id_and_none(spark):
    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(8))
    rows = [((1 << 63) - 1, body), (None, body), (3, "short")]
    got = {r.doc_id: (r.removed_lines, r.clean_text) for r in line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == (0, "short") and sorted([got[(1 << 63) - 1][0], got[None][0]]) == [0, 8]


def test_shuffle_files_go_with_their_query(spark):
    from tidemark.llm import _cut

    def held() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {name for name in files.split("\n") if "shuffle_" in name}

    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "uuid() as u").repartition(7, "id")
    before, setting = held(), spark.conf.get(_cut.CLEANUP, None)
    out = _cut.cut(rows, "tidy")
    until = time.monotonic() + 5
    while held() - before and time.monotonic() < until:  # files go in the background
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(_cut.CLEANUP, None) == setting and out.count() == 1000


def test_pairs_meet_their_texts_in_pieces(spark, odd_docs, monkeypatch):
    from tidemark.llm import ngram_join

    rows = lambda: sorted(ngram_join.join(odd_docs).collect(), key=repr)
    whole, real, pieces = rows(), ngram_join.cut, []
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: (pieces.append(name), real(df, name))[1])
    monkeypatch.setattr(ngram_join, "PIECE", 1000)
    assert rows() == whole and pieces.count("ngram-links") > 3 * pieces.count("ngram-pairs")
