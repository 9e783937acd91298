"""Target-distribution importance resampling over hashed word features, read from the bytes of Arrow text buffers.

1. A byte automaton: a table lowers A-Z and classifies every byte of a batch's text buffer at once; words begin and end where the class differs from
   the byte before (or a text begins). All words then advance through a table-driven CRC-32 together, a byte each a step; the state after
   one word goes on through a space into the next for longer features.
2. Bucket counts of the raw and of the target texts, added up in tasks first, give each bucket's gain (a table of fixed size).
3. A second reading adds the gains of each text. A hash of the id makes the Gumbel noise; the highest sums are drawn without a single-task sort.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._cut import cut
from ._names import unused
from ._prefix import running_total
from ._words import ragged, slices, tidied

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)  # 0-9, a-z and every byte of a character beyond ASCII
WORD[48:58] = WORD[97:123] = WORD[128:] = True
TOGETHER = 64  # bytes of a word that advance with all others; what is longer goes on by itself


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


CRC = _crc_table()


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, offsets): word w is bytes[starts[w]:ends[w]]; text t has words offsets[t] to offsets[t + 1]. Null texts have none."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    raw = LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = WORD[raw]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]  # a text's end parts the bytes on both sides
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return raw, starts, stops, np.searchsorted(starts, bounds)


def _advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each word, all words a byte a step (longest first, so that those that go on are a prefix)."""
    length = stops - starts
    order = np.argsort(-length, kind="stable")
    begin, size, state = starts[order], length[order], state[order]
    for step in range(min(int(size[0]) if len(size) else 0, TOGETHER)):
        n = int(np.searchsorted(-size, -step, "left"))  # words longer than step
        some = state[:n]
        state[:n] = CRC[(some ^ raw[begin[:n] + step]) & np.uint32(255)] ^ (some >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -TOGETHER, "left"))):
        rest = raw[begin[i] + TOGETHER : begin[i] + size[i]]
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: pa.Array, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of each feature, the text of each, words of each text): features are the runs of 1 to ``longest`` words, joined by one space."""
    raw, starts, stops, offsets = word_spans(texts)
    words = np.diff(offsets)
    of = np.repeat(np.arange(len(words)), words)
    state = _advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), raw, starts, stops)
    crcs, texts_of = [state ^ np.uint32(0xFFFFFFFF)], [of]
    left = ragged(np.zeros(len(words), np.int64), words)
    left = np.repeat(words, words) - left  # words from here to the text's end
    at = np.arange(len(starts))
    for run in range(2, longest + 1):
        going = left[at] >= run
        at, state = at[going], state[going]
        if not len(at):
            break
        space = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _advance(space, raw, starts[at + run - 1], stops[at + run - 1])
        crcs.append(state ^ np.uint32(0xFFFFFFFF))
        texts_of.append(of[at])
    return np.concatenate(crcs), np.concatenate(texts_of), words


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> dict[int, int]:
    """How often each bucket occurs in all texts (the driver sees one row a bucket)."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(features(part.column("text"), longest)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    per_task = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Each bucket's gain: floor(1000 ln of its smoothed share in the target over that in the raw texts)."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (float(target.get(b, 0) + 1) * s_all) / (float(raw.get(b, 0) + 1) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw), fixed by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gain: np.ndarray, text_col: str, longest: int, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` without the text, with words, features and weight of each row under ``names``."""

    @tidied
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                crcs, of, words = features(part.column(text_col), longest)
                n = np.bincount(of, minlength=part.num_rows)
                sums = np.bincount(of, gain[crcs % np.uint32(len(gain))].astype(float), part.num_rows)  # whole numbers below 2^53
                kept = part.drop_columns([text_col])
                for name, values in zip(names, (words, n, sums)):
                    kept = kept.append_column(name, pa.array(values.astype(np.int64)))
                yield kept

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    return docs.mapInArrow(weigh, f"{fields}, " + ", ".join(f"`{n}` long" for n in names))


def resample(
    docs: DataFrame, target: DataFrame, share_pct: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, n_features, weight, score (weight plus noise) and rank (1, 2, ... of the drawn ones; else null).

    Of the N rows with ``least_words`` words or more, the floor(share_pct * N / 100) of highest score are drawn; ties go to the smaller id, rows without an id come
    last. A null or wordless text has no features and weight 0. Rows that repeat count and are drawn each (they have one score). Words of
    any length count whole. An empty table gives no rows; without target texts every bucket's target count is 0. Other columns are not read, whatever their names.
    """
    key, text = unused([id_col], "doc_key", "doc_text")
    rows = docs.select(F.col(id_col).alias(key), F.col(text_col).alias(text))
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest), buckets)
    scored = weights(rows, gain, text, longest, ("words", "n_features", "weight"))
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col(key), seed)), "importance")
    able = scored.filter(F.col("words") >= least_words)
    drawn = able.count() * share_pct // 100
    placed = running_total(able, [F.desc("score"), F.asc_nulls_last(key)], None, "before")
    rank = F.when(F.col("before") < drawn, F.col("before") + 1)
    out = placed.withColumn("rank", rank).drop("before").unionByName(scored.filter(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col(key).alias(id_col), "n_features", "weight", "score", "rank")
