import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cgk_decontam, ordinal_quality, ppm_lang, url_rules


def _brute_bits(texts, order, doc):
    counts = defaultdict(Counter)
    for t in texts:
        flow = bytes([ppm_lang.START] * order) + t
        for i in range(order, len(flow)):
            for k in range(order + 1):
                counts[flow[i - k : i]][flow[i]] += 1
    flow, total = bytes([ppm_lang.START] * order) + doc, 0.0
    for i in range(order, len(flow)):
        for k in range(order, -1, -1):
            seen = counts.get(flow[i - k : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if flow[i] in seen:
                    total -= math.log2(seen[flow[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_code_lengths_equal_brute_force(most):
    rng = random.Random(3)
    texts = {"a": [bytes(rng.choice(b"abcde ") for _ in range(60)) for _ in range(4)] + [b""], "b": [bytes(rng.choice(b"efgh \n") for _ in range(50)) for _ in range(5)]}
    docs = [b"abcde", b"", b"z", b"hello efgh\xff", b"ab", bytes(rng.choice(b"abcdefgh \n") for _ in range(200))]
    ends = np.cumsum([len(d) for d in docs])
    model = ppm_lang.PpmModel.fit(texts)
    bits = model.bits(np.frombuffer(b"".join(docs), np.uint8), np.concatenate(([0], ends[:-1])), ends, most)
    for i, doc in enumerate(docs):
        assert bits[i] == pytest.approx([_brute_bits(texts[k], 3, doc) for k in "ab"], abs=1e-3)


def test_language_of_held_out_and_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(5)
    words = {"xx": ["kato", "miru", "sone", "tako"], "yy": ["brunk", "stelp", "grond", "vlast"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 30))), k) for i, k in enumerate(rng.choice(["xx", "yy"]) for _ in range(300))]
    rows += [(900, None, "xx"), (901, "  12 . !", "yy"), (902, "kato miru", None), (None, "brunk grond", None)]
    out = ppm_lang.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert len(out) == len(rows) and any(r.held_out for r in out)
    truth = {i: k for i, _, k in rows[:300]}
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.doc_id in truth)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id not in truth}
    assert odd[900] == ("und", 0.0) and odd[901] == ("und", 0.0) and odd[902][0] == "xx" and odd[None][0] == "yy"
    assert all(0 <= r.score <= 1 for r in out)
    assert ppm_lang.identify(odd_docs).count() == len(odd_rows)
    assert ppm_lang.identify(no_docs).count() == 0
    assert {r.lang_pred for r in ppm_lang.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def _edit(words, n, rng):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else ["zzz"]
    return words


def test_edit_distance_of_the_best_place():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, region = rng.integers(1, 5, rng.integers(1, 8)), rng.integers(1, 5, 12)

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        want = min(distance(item, region[a:b]) for a in range(13) for b in range(a, 13))
        assert cgk_decontam.best_edits(item, region[None, :])[0] == want


def test_decontamination_recall_and_clean_rows(spark, odd_docs, no_docs):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(40)]
    rows, want = [], {}
    for i in range(400):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 2:
            k = rng.randrange(40)
            at = rng.randint(0, len(body))
            body[at:at] = _edit(items[k], len(items[k]) * 15 // 100, rng)
            want[i] = k
        rows.append((i, " ".join(w.upper() + "," if j % 9 == 4 else w for j, w in enumerate(body))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, " .. ")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in cgk_decontam.find(docs, bench).collect()}
    hits = sum((i, k) in found for i, k in want.items())
    assert hits >= 0.95 * len(want) and not {i for i, _ in found} - set(want)
    blocks = {(r.doc_id, r.item_id) for r in cgk_decontam.find(docs, bench, block=9).collect()}
    assert sum((i, k) in blocks for i, k in want.items()) >= 0.95 * len(want)
    assert cgk_decontam.find(odd_docs, bench).count() == 0
    assert cgk_decontam.find(no_docs, bench).count() == 0 and cgk_decontam.find(docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in cgk_decontam.clean(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in found}


def _found(index, copies):
    text, item, edits = index.matches(pa.array([" ".join(w) for _, w in copies]))
    have = set(zip(text.tolist(), item.tolist(), strict=True))
    return [(i, k) in have for i, (k, _) in enumerate(copies)]


def test_short_items_are_found_whatever_the_edit():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in range(1, 24) for _ in range(4)]
    around = lambda w: ["xx", rng.choice(vocabulary), *w, rng.choice(vocabulary), "yy"]
    copies = [(k, around(w)) for k, w in enumerate(items)] + [(k, w) for k, w in enumerate(items)]
    for k, w in enumerate(items):
        if len(w) >= 5:
            for at in range(len(w)):
                copies += [(k, around([*w[:at], *new, *w[at + 1 :]])) for new in ([], ["zzz"], ["zzz", w[at]])]
            copies += [(k, _edit(w, len(w) // 5, rng)) for _ in range(20)]
    index = cgk_decontam.CgkIndex(list(enumerate(items)), 20, 0.97)
    assert all(_found(index, copies))


def test_windows_in_chunks_and_words_in_columns(monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(300)] + ["\u00e9t\u00e9", "\u0130x", "a_b"]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in range(24, 70, 3)]
    texts = [" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 90))] + _edit(w, len(w) // 5, rng)) for w in items * 3] + ["", None, "..."]
    index = cgk_decontam.CgkIndex([(k, cgk_decontam.item_words(" ".join(w))) for k, w in enumerate(items)], 20, 0.97)
    assert index.walks and not index.exact
    whole = [x.tolist() for x in index.matches(pa.array(texts))]
    monkeypatch.setattr(cgk_decontam, "CHUNK", 37)
    assert [x.tolist() for x in index.matches(pa.array(texts))] == whole
    words = ["V7,", "__", "\u0130X", "A_b", "\u00c9T\u00c9!", "none", "-", "v299"]
    assert index._known(pa.array(words)).tolist() == [index.vocabulary.get(w, 0) if w else -1 for w in map(cgk_decontam.normal, words)]


@pytest.mark.parametrize("most, recall", [(24, 0.97), (1, 1.0)])
def test_long_items_meet_the_recall_at_every_length(most, recall):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (24, 25, 31, 32, 39, 40, 47, 60, 150) for _ in range(3)]
    index = cgk_decontam.CgkIndex(list(enumerate(items)), 20, recall, most=most)
    assert (len(index.exact) == len(items)) == (most == 1)
    for n in {len(w) for w in items}:
        found = _found(index, [(k, _edit(w, n // 5, rng)) for k, w in enumerate(items) if len(w) == n for _ in range(200)])
        assert all(found) if most == 1 else sum(found) >= 0.96 * len(found)


def test_ordinal_grades_held_out(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        grade, words = i % 3, [rng.choice(common) for _ in range(rng.randint(20, 200))]
        if grade == 0:
            words[3:3] = rng.sample(["foul", "vile", "nasty", "mean", "cruel"], 3)
        if grade == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(grade != 1), int(grade == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rated = spark.createDataFrame(labels + [(0, None, 1), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in ordinal_quality.classify(docs, rated).collect()}
    assert len(out) == 900 and all(0 <= r.p_good <= r.p_not_toxic <= 1 and 0 <= r.expected_grade <= 2 for r in out.values())
    held = [i for i in range(900) if i % 5 == 0]
    assert sum(out[i].toxic == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert sum(out[i].keep == (i % 3 == 2) for i in held) >= 0.95 * len(held)
    assert ordinal_quality.classify(odd_docs, rated).count() == len(odd_rows)
    assert ordinal_quality.classify(no_docs, rated).count() == 0
    assert ordinal_quality.classify(docs, rated.limit(0)).count() == 900


def test_ordinal_fit_is_a_minimum_of_the_plain_loss():
    """Finite differences of the cumulative-link loss, added up row by row, vanish at the fit but for the penalty's pull."""
    rng = np.random.default_rng(3)
    present = rng.random((90, 6)) < 0.5
    grades = np.clip((present @ np.array([2.0, -2.0, 1.0, 0.0, 0.0, 0.5]) + rng.normal(0, 1, 90) + 1).astype(int), 0, 2)
    rows, cols = np.nonzero(present)
    l1 = 5e-3
    model = ordinal_quality.OrdinalModel.fit(rows, cols, grades, 3, rounds=6000, l1=l1)
    share = Counter(grades.tolist())

    def loss(w, theta):
        total = 0.0
        for i in range(90):
            score = sum(w[j] for j in range(6) if present[i, j])
            for k in (1, 2):
                p = 1 / (1 + math.exp(-(score - theta[k - 1])))
                total -= math.log(p if grades[i] >= k else 1 - p) / share[int(grades[i])] / len(share)
        return total

    w, theta, step = model.weights[:6].astype(float), model.thresholds.astype(float), 1e-5
    assert theta[0] <= theta[1] and np.count_nonzero(w) >= 3
    for j in range(6):
        e = np.eye(6)[j] * step
        slope = (loss(w + e, theta) - loss(w - e, theta)) / (2 * step)
        assert abs(slope + l1 * np.sign(w[j])) < 2e-3 if w[j] else abs(slope) <= l1 + 2e-3
    for k in range(2):
        e = np.eye(2)[k] * step
        assert abs(loss(w, theta + e) - loss(w, theta - e)) / (2 * step) < 2e-3


def test_features_are_present_once():
    rows, cols = ordinal_quality.features(pa.array(["a A a, b", "", None]))
    words = [(r, c) for r, c in zip(rows.tolist(), cols.tolist(), strict=True) if c < 1 << ordinal_quality.BITS]
    assert len(words) == 2 and {r for r, _ in words} == {0}
    assert len(set(zip(rows.tolist(), cols.tolist(), strict=True))) == len(rows)


def _rank(seeds, links, rounds):
    mass, base = dict(seeds), {h: s * 15 // 100 for h, s in seeds.items()}
    total = Counter()
    for (a, _), n in links.items():
        total[a] += n
    for _ in range(rounds):
        new = Counter(base)
        for (a, b), n in links.items():
            if a in mass:
                new[b] += (mass[a] * 85 // 100) * n // total[a]
        mass = dict(new)
    return mass


def test_propagation_and_rules(spark, no_docs):
    links = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 3, ("d", "c"): 1}
    seeds = {"a": url_rules.UNIT, "d": url_rules.UNIT // 2}
    got = url_rules.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed long"), spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long"), 6)
    assert {r.host: r.mass for r in got.collect()} == _rank(seeds, links, 6)
    page = lambda *hosts: "".join(f'<a HREF="https://{h}/x">x</a><a href=//{h}/y>' for h in hosts)
    rows = [
        (1, "http://bad.com/en/1", None), (2, "http://bad.com/q", ""), (3, "http://Fan.example.net/x?y", page("bad.com")), (4, "http://www.example.com/en/77", page("Fine.org")),
        (5, "https://example.net/de/8", None), (6, "https://notexample.net/de/8#z", None), (7, "nothing", None), (8, None, None), (9, "http://fine.org/", page("fine.org")), (10, "x://com/en/", None),
    ]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == ("bad.com", "/en/1", "com/en/", "block") and out[2][2:] == (None, "block") and out[3] == ("fan.example.net", "/x", None, "block")
    assert out[4][2:] == ("example.com/en/7", "allow") and out[5][2:] == ("example.net/de/8", "block") and out[6][2:] == ("net/de/", "allow")
    assert out[7] == ("", "", None, "allow") and out[8] == ("", "", None, "allow") and out[9][3] == "allow" and out[10] == ("com", "/en/", "com/en/", "block")
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_settles_beyond_a_dozen_hosts(spark):
    chain = [f"h{i}.info" for i in range(17)]
    links = {(a, b): 1 for a, b in zip(chain, chain[1:], strict=False)} | {("p", "q"): 3, ("q", "p"): 1, ("q", "r"): 1, ("r", "q"): 2}
    seeds = {chain[0]: url_rules.UNIT, "p": url_rules.UNIT // 2}
    hosts = [*chain, "p", "q", "r"]
    step, total = np.zeros((len(hosts), len(hosts))), Counter()
    for (a, _), n in links.items():
        total[a] += n
    for (a, b), n in links.items():
        step[hosts.index(b), hosts.index(a)] = 0.85 * n / total[a]
    want = np.linalg.solve(np.eye(len(hosts)) - step, [0.15 * seeds.get(h, 0) for h in hosts])
    table = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long")
    got = {r.host: r.mass for r in url_rules.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed long"), table).collect()}
    assert all(abs(got[h] - x) <= url_rules.TOLERANCE + 100 for h, x in zip(hosts, want, strict=True))


def test_large_masses_do_not_overflow(spark):
    seeds = spark.createDataFrame([("a", 10**16)], "host string, seed long")
    links = spark.createDataFrame([("a", "b", 4 * 10**9), ("a", "c", 10**9)], "src string, dst string, n long")
    got = {r.host: r.mass for r in url_rules.propagate(seeds, links).collect()}
    assert got == {"a": 15 * 10**14, "b": 15 * 10**14 * 85 // 100 * 4 // 5, "c": 15 * 10**14 * 85 // 100 // 5}


def test_verdicts_along_a_chain_of_hosts(spark):
    rows = [(0, "http://bad.com/en/1", "")] + [(i, f"http://h{i}.info/", f'<a href="http://{f"h{i - 1}.info" if i > 1 else "bad.com"}/">') for i in range(1, 17)]
    out = {r.page_id: r.verdict for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "block" if i == 0 or 0.15 * 0.85**i >= 0.05 else "allow" for i in range(17)}


def test_pipeline_stages(spark, odd_rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    words = {"xx": ["kato", "miru", "sone", "tako", "ripe", "lomu"], "yy": ["brunk", "stelp", "grond", "vlast", "dorst", "kralt"]}
    item = [rng.choice(words["xx"]) + str(i) for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice("aeiou") for _ in range(60)), k, f"s{i % 3}", 0) for i, k in ((i, "xy"[i % 2] * 2) for i in range(80))]
    rows += [(100 + i, rows[4][1] + " end" * (i % 2), "xx", "s0", 0) for i in range(6)] + [(200, rows[6][1] + " " + " ".join(item), "xx", "s1", 0), (201, "12 34", "xx", "s1", 0), (202, None, None, None, None)]
    folder = str(tmp_path / "sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns or i == 4
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        ids.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    every = {r[0] for r in rows}
    assert set(ids[0]) == every - {201, 202}
    assert set(ids[1]) == set(ids[0]) - set(range(100, 106)) and len(ids[1]) == len(set(ids[1]))
    assert set(ids[2]) == set(ids[1]) - {200}
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 2
    assert ids[4] == ids[3]
    assert pipeline.ORACLE_SQL is None


def test_edits_in_long_regions():
    rng = np.random.default_rng(8)
    item = rng.integers(1, 900, 300)
    region = np.concatenate([rng.integers(1, 900, 34_000), item])
    assert cgk_decontam.best_edits(item, region[None, :]).tolist() == [0]
    changed = np.where(np.arange(300) % 30 == 7, 950, item)
    assert cgk_decontam.best_edits(item, np.concatenate([region[:34_000], changed, region[:9]])[None, :]).tolist() == [10]


def test_find_equals_an_exhaustive_scan(spark):
    rng = random.Random(12)
    words = [f"t{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(n)] for n in (6, 11, 18, 24, 30, 45, 80)]
    docs = []
    for i in range(240):
        body = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if i % 2:
            copy = list(rng.choice(items))
            for _ in range(rng.randint(0, len(copy) * 26 // 100)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            at = rng.randint(0, len(body))
            body[at:at] = copy
        docs.append(body)
    place = {w: k for k, w in enumerate(words)}
    want = {}
    for d, body in enumerate(docs):
        for k, item in enumerate(items):
            least = cgk_decontam.best_edits(np.array([place[w] for w in item]), np.array([[place[w] for w in body]], np.int64).reshape(1, -1))[0]
            if least <= cgk_decontam.edits_allowed(len(item), 20):
                want[d, k] = least
    rows = spark.createDataFrame([(d, " ".join(b)) for d, b in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in cgk_decontam.find(rows, spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id int, text string")).collect()}
    assert len(want) > 60 and got.keys() <= want.keys() and all(got[k] == want[k] for k in got)
    assert {k for k in want if len(items[k[1]]) < cgk_decontam.SHORT} <= got.keys() and len(got) >= 0.97 * len(want)


def test_repeated_ids_and_huge_texts_bound_the_fit(spark):
    rows = [(7, f"copy {i}") for i in range(50)] + [(8, "x" * 3000), (9, "good words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "doc_id long, grade int")
    one = spark.createDataFrame([(7, "copy 0"), (9, "good words here")], "doc_id long, text string")
    a, b = ordinal_quality.fit(docs, ratings, text_bytes=2000), ordinal_quality.fit(one, ratings)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
