"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes, with symbol counts of a bounded sample of its documents. A byte
costs the code length of its count in the longest known context, or of an escape (method C: distinct symbols over
distinct symbols plus count) and then its cost in the next shorter one, down to eight bits; statistics stay frozen while
scoring. The trees of all languages are compiled into one table of (context, byte, language) costs; the sample's bounds bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._names import unused
from ._sample import bounded_ids
from ._words import slices, tidied

START = 10  # the byte that stands before every text


class PpmModel:
    """Compiled code lengths; ``fit`` builds it from (language, texts)."""

    def __init__(self, langs: list[str], symbol: np.ndarray, state: np.ndarray, cost: np.ndarray, width: int, order: int):
        self.langs, self.symbol, self.state, self.cost, self.width, self.order = langs, symbol, state, cost, width, order
        self.typical = np.full(len(langs), 8.0)

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]], order: int = 3) -> PpmModel:
        """All contexts of ``texts`` with their frozen counts, and each language's typical bits a byte in its own texts."""
        model = cls._compiled(texts, order)
        for i, lang in enumerate(model.langs):
            data = np.frombuffer(b"".join(texts[lang]), np.uint8)
            if len(data):
                ends = np.cumsum([len(t) for t in texts[lang]])
                model.typical[i] = model.bits(data, np.concatenate(([0], ends[:-1])), ends)[:, i].sum() / len(data)
        return model

    @classmethod
    def _compiled(cls, texts: dict[str, list[bytes]], order: int) -> PpmModel:
        langs = sorted(texts)
        seen = np.zeros(256, bool)
        for lang in langs:
            for t in texts[lang]:
                seen[np.frombuffer(t, np.uint8)] = True
        seen[START] = True
        symbol = np.zeros(256, np.int64)  # 0: a byte of no tree
        symbol[seen] = np.arange(1, seen.sum() + 1)
        width = int(seen.sum()) + 1
        grams = []
        for lang in langs:
            parts, starts, n = [], [], 0
            for t in texts[lang]:
                body = symbol[np.frombuffer(t, np.uint8)]
                parts += [np.full(order, symbol[START]), body]
                starts.append(n + order + np.arange(len(body)))
                n += order + len(body)
            flow = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            per, key = [], flow[at]
            for k in range(order + 1):
                if k:
                    key = key + flow[at - k] * width ** k
                per.append(np.unique(key, return_counts=True))
            grams.append(per)
        kept = [np.zeros(1, np.int64)]
        for k in range(1, order + 1):
            kept.append(np.unique(np.concatenate([g[k][0] // width for g in grams])) if grams else np.zeros(0, np.int64))
        costs = [np.full((1, width, len(langs)), 8.0, np.float32)]
        for k in range(order + 1):
            contexts = kept[k]
            if k:
                below = costs[-1][np.searchsorted(kept[k - 1], contexts % width ** (k - 1))]
            else:
                below = costs[0]
            here = below.copy()
            for i, g in enumerate(grams):
                keys, counts = g[k]
                row = np.searchsorted(contexts, keys // width)
                row = np.minimum(row, len(contexts) - 1) if len(contexts) else row
                hit = contexts[row] == keys // width if len(contexts) else np.zeros(len(keys), bool)
                row, sym, counts = row[hit], keys[hit] % width, counts[hit]
                total, distinct = np.bincount(row, counts, len(contexts)), np.bincount(row, minlength=len(contexts))
                used = distinct > 0
                escape = np.zeros(len(contexts))
                escape[used] = -np.log2(distinct[used] / (total[used] + distinct[used]))
                here[:, :, i] += escape[:, None].astype(np.float32)
                here[row, sym, i] = -np.log2(counts / (total[row] + distinct[row]))
            costs.append(here)
        costs = costs[1:]
        base = np.cumsum([0] + [len(c) for c in costs])
        state = np.zeros(1, np.int32)  # by context, shorter ones first
        for k in range(1, order + 1):
            state = np.tile(state, width)  # context key = older symbol * width ** (k - 1) + the newer ones
            state[kept[k]] = base[k] + np.arange(len(kept[k]))
        return cls(langs, symbol.astype(np.int32), state, np.concatenate(costs).reshape(int(base[-1]) * width, len(langs)), width, order)

    def bits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Code lengths (texts, languages) of the byte ranges ``starts[i]:ends[i]`` of ``data`` (in order, without gaps)."""
        out = np.zeros((len(starts), len(self.langs)))
        full = np.flatnonzero(ends > starts)
        if not len(full):
            return out
        starts, ends = starts[full], ends[full]
        for a in range(0, len(data), most):
            b = min(len(data), a + most)
            lead = min(a, self.order)
            sym = self.symbol[data[a - lead : b]]
            previous, weight = np.zeros(b - a, np.int32), 1
            for k in range(1, self.order + 1):
                shifted = np.full(b - a, self.symbol[START], np.int32)
                have = max(0, k - lead)
                shifted[have:] = sym[lead + have - k : len(sym) - k]
                for j in range(k):
                    at = starts + j
                    shifted[at[(at < ends) & (at >= a) & (at < b)] - a] = self.symbol[START]
                previous += shifted * np.int32(weight)
                weight *= self.width
            row = self.state[previous].astype(np.int64) * self.width + sym[lead:]
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            out[full[i:j]] += np.add.reduceat(self.cost[row], np.maximum(starts[i:j], a) - a, axis=0, dtype=np.float64)
        return out


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def fit(
    docs: DataFrame, per_lang: int = 200, text_bytes: int = 1 << 20, order: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> PpmModel:
    """A model of the labelled documents ``docs``, from whole texts of about ``per_lang`` of each language.

    These two parameters bound the sample: texts of more than ``text_bytes`` are not learned from, nor are null, empty and letterless ones and
    those of a null language. Rows that repeat an id and text count once. Without a labelled text the model has no language.
    """
    body = F.lower(text_col)
    labelled = docs.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)) & (F.octet_length(body) <= text_bytes))
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    some = bounded_ids(labelled.select(row.alias("row"), F.col(lang_col).alias("lang")).distinct(), "lang", "row", per_lang).select("row").distinct()
    picked = labelled.select(row.alias("row"), F.col(lang_col).alias("lang"), body.alias("body"))
    picked = picked.join(F.broadcast(some), "row", "left_semi").distinct()  # about per_lang rows a language
    texts: dict[str, list[bytes]] = {}
    for found in picked.select("lang", "body").collect():  # the bounded sample
        texts.setdefault(found["lang"], []).append(found["body"].encode())
    return PpmModel.fit({k: sorted(v) for k, v in texts.items()}, order)


def predict(docs: DataFrame, model: PpmModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from the text alone.

    ``und`` with score 0: null, empty or letterless text, or a model without languages. The score is the best
    language's share of two to the minus code length, halved for every bit a byte that the text costs beyond what is typical of
    that language. Equal code lengths go to the first language by name. Repeated
    rows and very long texts are scored like any other; extra columns pass through, but columns named like the two new ones give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.select(*[c for c in docs.columns if c == text_col or c.lower() not in (lang_out.lower(), score_out.lower())])
    names = docs.schema.names
    (asked_col,) = unused(names, "ppm_body")
    asked = docs.withColumn(asked_col, F.when(has_letter(F.col(text_col)), F.lower(text_col)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        langs = np.array([*ppm.langs, "und"], object)
        for batch in batches:
            for rows in slices(batch, asked_col, 4 << 20):
                body = rows.column(asked_col)
                valid = pc.is_valid(body).to_numpy(zero_copy_only=False)
                if not ppm.langs:
                    valid = np.zeros(len(body), bool)
                body = pc.fill_null(body, "")
                ends = np.cumsum(pc.binary_length(body).to_numpy().astype(np.int64))
                data = np.frombuffer(b"".join(body.cast(pa.binary()).to_pylist()), np.uint8)
                best, sure = np.full(len(body), len(ppm.langs)), np.zeros(len(body))
                if valid.any():
                    bits = ppm.bits(data, np.concatenate(([0], ends[:-1])), ends)
                    found = bits.argmin(1)
                    least = bits.min(1)
                    share = 1.0 / np.exp2(np.maximum(-1000.0, least[:, None] - bits)).sum(1)
                    size = np.maximum(1, np.diff(np.concatenate(([0], ends))))
                    share *= np.exp2(-np.maximum(0.0, least / size - ppm.typical[found]))
                    best[valid], sure[valid] = found[valid], share[valid]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(n) for n in names), pa.array(langs[best], pa.string()), pa.array(sure)], names=[*names, lang_out, score_out]
                )

    out = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return asked.mapInArrow(tidied(score), out)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no model may learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the other folds of the same table.

    All cases are as in ``fit`` and ``predict``; a null id is in no held-out fold; other columns are ignored.
    """
    model = fit(docs.filter(~held_out()), **options)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
