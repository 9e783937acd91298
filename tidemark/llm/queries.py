"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cgk_decontam, exact_dedup, fair_mix, hard_negatives, importance_resample, kd_search, kd_shards, line_winnow, ngram_join, ordinal_quality, ppm_lang, token_planes, url_rules


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_docs(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_docs(spark, sf_dir))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.by_metadata(_docs(spark, sf_dir))


def op4_token_planes(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_planes.encode(_docs(spark, sf_dir), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(_docs(spark, sf_dir))


def op6_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_winnow.dedup_lines(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_runs", F.md5(F.encode("clean_text", "UTF-8")).alias("clean_md5"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_lang.identify(_docs(spark, sf_dir))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, moved)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_join, op2_exact_dedup, op3_kd_shards, op4_token_planes, op5_fair_mix, op6_line_winnow, op7_url_rules, op8_cgk_decontam, op9_ppm_language,
        op10_ordinal_quality, op11_hard_negatives, op12_importance_resample, op13_kd_search,
    )}


_SPLIT = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPLIT}', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""

OP6_SQL = rf"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM raw),
worded AS (
  SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS words FROM numbered WHERE regexp_matches(line, '{_WORD}')),
run AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS stop FROM worded),
placed AS (SELECT *, stop - words AS start FROM run),
win AS (
  SELECT doc_id, false AS backward, min(pos) OVER f AS first, max(pos) OVER f AS last, sum(words) OVER f AS total,
         string_agg(line, chr(10)) OVER f AS body
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN 0 PRECEDING AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, true, min(pos) OVER b, max(pos) OVER b, sum(words) OVER b, string_agg(line, chr(10)) OVER b
  FROM placed WINDOW b AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND 0 FOLLOWING)),
later AS (
  SELECT doc_id, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY backward, body ORDER BY doc_id, first) AS n FROM win WHERE total >= 50)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later),
runs AS (
  SELECT doc_id, count(*) AS removed_lines, count(*) FILTER (WHERE before IS DISTINCT FROM pos - 1) AS removed_runs
  FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id),
kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS clean
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT raw.doc_id, CAST(len(parts) AS BIGINT) AS n_lines, coalesce(removed_lines, 0) AS removed_lines,
       coalesce(removed_runs, 0) AS removed_runs, md5(coalesce(clean, '')) AS clean_md5
FROM raw LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _op7_sql(rounds: int = 12) -> str:
    """Rule matching and both propagations, a common table expression each round (integer arithmetic as in the operator)."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_rules.RULES)

    def propagation(name: str, seed: str, src: str, dst: str) -> str:
        steps = [f"{name}_s AS (SELECT host, {seed} * {url_rules.UNIT} // n AS seed FROM hosts WHERE {seed} > 0), {name}0 AS (SELECT host, seed AS mass FROM {name}_s)"]
        for i in range(rounds):
            steps.append(
                f"{name}{i + 1} AS (SELECT host, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT host, seed * 15 // 100 AS mass FROM {name}_s UNION ALL "
                f"SELECT l.{dst}, (m.mass * 85 // 100) * l.n // o.total FROM links l JOIN {name}{i} m ON m.host = l.{src} "
                f"JOIN (SELECT {src} AS h, sum(n) AS total FROM links GROUP BY 1) o ON o.h = l.{src}) GROUP BY host)"
            )
        return ", ".join(steps)

    return rf"""
WITH cutoff AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutoff),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
hits AS (
  SELECT p.page_id, p.host, p.path, p.html, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS best
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
judged AS (SELECT * FROM hits WHERE best = 1),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE verdict = 'allow') AS good, count(*) FILTER (WHERE verdict = 'block') AS bad
  FROM judged WHERE host <> '' GROUP BY host),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?((?:[a-z][a-z0-9+.\-]*:)?//[^\s"''<>]+)', 1)) AS link FROM judged),
links AS (
  SELECT src, translate(regexp_extract(substr(link, strpos(link, '//') + 2), '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}') AS dst, count(*) AS n
  FROM hrefs GROUP BY 1, 2 HAVING src <> '' AND dst <> '' AND src <> dst),
{propagation("good", "good", "src", "dst")}, {propagation("bad", "bad", "dst", "src")}
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN b.mass >= {url_rules.UNIT // 20} AND b.mass > coalesce(g.mass, 0) THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN good{rounds} g ON g.host = j.host LEFT JOIN bad{rounds} b ON b.host = j.host
"""


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _scores(scale: int) -> str:
    """(id, label, a vector of whole numbers): the rows that take part."""
    return (
        f"v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, "
        f"list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {_FINITE})"
    )


OP11_SQL = f"""
WITH {_scores(256)},
p AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE a.label IS NOT NULL AND b.label IS NOT NULL),
pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM p WHERE same) WHERE n <= 5),
neg AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, p.vec_id AS negative_id, pos.score AS positive_score, p.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same AND 80 * pos.score <= 100 * p.score AND 100 * p.score <= 100 * pos.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""

OP13_SQL = f"""
WITH {_scores(64)},
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The polynomial's table, then each distinct word's bytes folded through it.
OP12_SQL = rf"""
WITH crc AS (
  SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END, b) ORDER BY b) AS t
  FROM range(0, 256) g(b)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '{_PLAIN}') AS ws FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '{_PLAIN}')) AS w FROM benchmark),
raw AS (SELECT doc_id, unnest(ws) AS w FROM d),
each AS (SELECT w FROM raw UNION SELECT w FROM q),
bucket AS MATERIALIZED (
  SELECT w, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), CAST(4294967295 AS BIGINT))) % 10000 AS b
  FROM each, crc),
counts AS (
  SELECT b, sum(s) AS s, sum(t) AS t FROM (
    SELECT b, 1 AS s, 0 AS t FROM raw JOIN bucket USING (w) UNION ALL SELECT b, 0, 1 FROM q JOIN bucket USING (w)) GROUP BY b),
total AS (SELECT CAST(coalesce(sum(s), 0) + 10000 AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) + 10000 AS DOUBLE) AS t FROM counts),
gain AS (
  SELECT b, CAST(floor(1000 * ln((CAST(c.t + 1 AS DOUBLE) * total.s) / (CAST(c.s + 1 AS DOUBLE) * total.t))) AS BIGINT) AS g FROM counts c, total),
weight AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM raw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (doc_id)),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN a.n <= a.drawn THEN a.n END AS rank
FROM scored s LEFT JOIN able a USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_line_winnow": OP6_SQL, "op7_url_rules": _op7_sql(), "op11_hard_negatives": OP11_SQL,
        "op12_importance_resample": OP12_SQL, "op13_kd_search": OP13_SQL,
    }
