"""Benchmark decontamination by CGK random-walk embedding and bit-sampling LSH.

Documents and items are sequences of normalised words (lower case, letters and digits only). The CGK walk reads a
sequence with a pointer: step j puts out the word under the pointer and moves on by a random bit of (j, word), so that a
small edit distance becomes a small Hamming distance. Every item is embedded whole, and so is the window of its size
that starts at each word of a text. A repetition draws a new walk and samples two of its places; a window and an item
that agree on all of them are a candidate. A walk is a random order of ``BLOCKS`` short random blocks of steps, so that a block's moves
are worked out once for all repetitions. The number of repetitions is what the items need, under as many random edits as are allowed, to
meet ``recall`` at every length.

Items of less than ``SHORT`` words leave no room for spread samples, and some items may not meet ``recall`` in the most repetitions: these are cut
into one part more than edits are allowed. Some part stays as it is in every copy, so windows that begin with a whole part are all the candidates
there can be. Such a window is a walk whose pointer always moves, sampled at every place.

Candidates pass a count of the item's words in the window and then an exact word edit distance of the item to the best place around the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._words import ragged, slices, tidied, words_of

DROP = re.compile(r"[\W_]+")
SAMPLES, BLOCKS, SHORT, TRIALS, CHUNK = 2, 10, 24, 1000, 1 << 17
REGION_CELLS = 1 << 20  # words of candidate regions that are compared at a time


def normal(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else DROP.sub("", low)  # \w is alphanumerics and the underscore


def item_words(text: str | None) -> list[str]:
    return [w for w in map(normal, re.split("[\x20\x09-\x0d]+", text or "")) if w]


def edits_allowed(words: int, pct: int) -> int:
    return words * pct // 100


def best_edits(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least word edit distance of ``item`` to any run of words of each row of ``regions``."""
    kind = np.int16 if regions.shape[1] + len(item) < 1 << 14 else np.int32  # counts of edits and places, which no region outgrows
    places = np.arange(regions.shape[1] + 1, dtype=kind)
    row = np.zeros((len(regions), len(places)), kind)
    for i, word in enumerate(item):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (regions != word))
        new[:, 0] = i + 1
        row = np.minimum.accumulate(new - places, axis=1) + places
    return row.min(1)


@dataclass
class Sizes:
    """Items of about one length, one after another with a pad after each, and what a repetition samples of them."""

    members: np.ndarray
    least: int
    most: int
    flow: np.ndarray
    starts: np.ndarray


@dataclass
class Samples:
    """The places that one repetition samples for items of one size, and the items' sorted keys there."""

    size: int
    places: list[int]
    first: np.ndarray
    levels: list[np.ndarray]
    keys: np.ndarray
    items: np.ndarray


class CgkIndex:
    """Items of one block with their keys in every repetition."""

    def __init__(self, items: list[tuple[object, list[str]]], pct: int, recall: float, seed: int = 11, most: int = 48):
        self.pct = pct
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, words in self.items for w in words}))}
        self.pad = len(self.vocabulary) + 1
        self.tokens = [np.array([self.vocabulary[w] for w in words], np.int32) for _, words in self.items]
        rng = np.random.default_rng(seed)
        self.blocks = [rng.integers(0, 2, (2 + b % 4, self.pad + 1), np.int8) for b in range(BLOCKS)]
        for bits in self.blocks:
            bits[:, self.pad] = 0
        groups: dict[int, list[int]] = {}
        for k, t in enumerate(self.tokens):
            groups.setdefault(int(np.log(len(t) / SHORT) / np.log(1.35)) if len(t) >= SHORT else -1, []).append(k)
        self.exact = groups.pop(-1, [])
        self.walks = self._repetitions([self._sizes(g) for _, g in sorted(groups.items())], recall, most, rng)
        self.runs = self._whole_parts(self.exact)

    def _sizes(self, members: list[int]) -> Sizes:
        lengths = np.array([len(self.tokens[k]) for k in members])
        flow = np.concatenate([np.append(self.tokens[k], self.pad) for k in members])
        return Sizes(np.array(members), int(lengths.min()), int(lengths.max()), flow, np.cumsum(lengths + 1) - lengths - 1)

    def _moves(self, flow: np.ndarray) -> list[np.ndarray]:
        """For each block: where its steps take a pointer from every place of ``flow``. A pad holds the pointer."""
        moves = []
        for bits in self.blocks:
            at = np.arange(len(flow))
            for row in bits:
                at = at + row[flow][at]
            moves.append(at)
        return moves

    def _repetitions(self, sizes: list[Sizes], recall: float, most: int, rng) -> list[tuple[list[int], int, np.ndarray, list[Samples]]]:
        """Repetitions until randomly edited items of every length are found by two standard errors more than ``recall``.

        Items of a size that ``most`` repetitions do not bring there are left to ``exact``.
        """
        need = min(1.0, recall + 2 * (recall * (1 - recall) / TRIALS) ** 0.5)
        trials = [self._trials(s, rng) for s in sizes]
        own, missed, found = [self._moves(s.flow) for s in sizes], [np.ones(len(t[0]), bool) for t in trials], []
        left = list(range(len(sizes)))
        while left and len(found) < most:
            order = rng.integers(0, BLOCKS, 2 * sizes[left[-1]].most).tolist()
            ends = np.cumsum([len(self.blocks[b]) for b in order])
            depth = [int(np.searchsorted(ends, 1.8 * sizes[g].least, "right")) for g in left]  # where about nine tenths of the item are read
            first, drawn = int(rng.integers(0, depth[0], SAMPLES).min()), {}
            for g, deep in zip(left, depth, strict=True):
                places = sorted((first + 1 + rng.choice(deep - first, SAMPLES - 1, replace=False)).tolist())
                drawn[g] = self._samples(sizes[g], own[g], order, [first, *places])
                missed[g] &= self._missed(trials[g], order, first, drawn[g])
            found.append((order, first, drawn))
            left = [g for g in left if (1 - missed[g].reshape(-1, TRIALS).mean(1) < need).any()]
        for g in left:
            self.exact = self.exact + sizes[g].members.tolist()
        walks = []
        for order, first, drawn in found:
            kept = [x for g, x in drawn.items() if g not in left]
            if kept:
                walks.append((order, first, np.logical_or.reduce([x.first for x in kept]), kept))
        return walks

    def _samples(self, sizes: Sizes, moves: list[np.ndarray], order: list[int], places: list[int]) -> Samples:
        at, done, key, levels = sizes.starts, 0, np.zeros(len(sizes.starts), np.int64), []
        for place in places:
            at, done = self._walked(moves, at, order[done:place]), place
            key = key * (self.pad + 1) + sizes.flow[at]
            levels.append(np.unique(key))
        first = np.zeros(self.pad + 1, bool)
        first[levels[0]] = True
        by_key = np.argsort(key, kind="stable")
        return Samples(sizes.most, places[1:], first, levels[1:], key[by_key], sizes.members[by_key])

    @staticmethod
    def _walked(moves: list[np.ndarray], at: np.ndarray, blocks: list[int]) -> np.ndarray:
        for b in blocks:
            at = moves[b][at]
        return at

    def _agreeing(self, flow, moves, starts, index, at, word, order, done, sampled: Samples) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, item) of the windows that agree with an item on all samples; a window is dropped at the first that no item has."""
        keep = sampled.first[word]
        index, at, key = index[keep], at[keep], word[keep].astype(np.int64)
        for place, level in zip(sampled.places, sampled.levels, strict=True):
            at, done = self._walked(moves, at, order[done:place]), place
            key = key * (self.pad + 1) + np.where(at - starts[index] < sampled.size, flow[at], self.pad)
            keep = level[np.minimum(np.searchsorted(level, key), len(level) - 1)] == key
            index, at, key = index[keep], at[keep], key[keep]
        low, high = np.searchsorted(sampled.keys, key, "left"), np.searchsorted(sampled.keys, key, "right")
        return np.repeat(index, high - low), sampled.items[ragged(low, high - low)]

    def _windows(self, flow: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in flow, item) of the candidates of all repetitions, from a bounded number of places at a time."""
        reach = max((sum(len(self.blocks[b]) for b in order) for order, *_ in self.walks), default=0)
        for low in range(0, len(flow) if self.walks else 0, CHUNK):
            part = np.append(flow[low : low + CHUNK + reach], self.pad)
            moves = self._moves(part)
            starts = np.flatnonzero(part[:CHUNK] != self.pad)
            for order, first, table, kept in self.walks:
                at = self._walked(moves, starts, order[:first])
                word = part[at]
                some = np.flatnonzero(table[word])
                at, word = at[some], word[some]
                for sampled in kept:
                    index, item = self._agreeing(part, moves, starts, some, at, word, order, first, sampled)
                    yield starts[index] + low, item

    def _trials(self, sizes: Sizes, rng) -> tuple:
        """TRIALS edited items for each length (steps of 8 words): their items, sizes, places and moves."""
        lengths: dict[int, list[int]] = {}
        for k in sizes.members.tolist():
            lengths.setdefault(len(self.tokens[k]) // 8, []).append(k)
        trials = [t for some in lengths.values() for t in self._edited(some, rng)]
        counts = np.array([len(flow) for _, flow in trials])
        flow = np.concatenate([np.append(flow, self.pad) for _, flow in trials])
        starts = np.flatnonzero(flow != self.pad)
        return np.array([k for k, _ in trials]), counts, flow, starts, np.repeat(np.arange(len(trials)), counts), self._moves(flow)

    def _missed(self, trials: tuple, order: list[int], first: int, sampled: Samples) -> np.ndarray:
        """Which edited items get no candidate whose region holds all of them."""
        item, counts, flow, starts, trial, moves = trials
        at = self._walked(moves, starts, order[:first])
        index, hit = self._agreeing(flow, moves, starts, np.arange(len(starts)), at, flow[at], order, first, sampled)
        m = np.array([len(self.tokens[k]) for k in item.tolist()])
        e, on = edits_allowed(m, self.pct), trial[index]
        base = starts[index] - (np.cumsum(counts + 1) - counts - 1)[on]
        missed = np.ones(len(item), bool)
        missed[on[(hit == item[on]) & (base <= e[on]) & (base + m[on] + e[on] >= counts[on])]] = False
        return missed

    def _whole_parts(self, members: list[int]) -> list:
        """A run for each length of the parts of ``members``."""
        parts: dict[int, list[tuple[int, int]]] = {}
        for k in members:
            m = len(self.tokens[k])
            n = min(m, edits_allowed(m, self.pct) + 1)
            for i in range(n):
                parts.setdefault(m * (i + 1) // n - m * i // n, []).append((k, m * i // n))
        runs = []
        for size, anchors in sorted(parts.items()):
            bits = np.ones((size, self.pad + 1), np.uint8)
            bits[:, self.pad] = 0
            at = list(range(size))
            levels = self._levels(np.stack([self.tokens[k][o : o + size] for k, o in anchors]), bits, at)
            runs.append((size, bits, at, levels, np.array(anchors, np.int64)))
        return runs

    def _edited(self, members: list[int], rng) -> list[tuple[int, np.ndarray]]:
        """TRIALS items with as many random word edits as are allowed (each a deletion, insertion or replacement)."""
        out = []
        for k in rng.choice(members, TRIALS).tolist():
            flow = self.tokens[k].tolist()
            for _ in range(edits_allowed(len(flow), self.pct)):
                at, kind = int(rng.integers(0, len(flow))), int(rng.integers(0, 3))
                flow[at : at + (kind != 1)] = [] if kind == 0 else [0]
            out.append((k, np.array(flow, np.int32)))
        return out

    def _walk(self, flow, at, ends, bits, first, last):
        """Pointers after steps first..last-1 of the walk."""
        for j in range(first, last):
            at = np.minimum(at + bits[j, flow[at]], ends)
        return at

    def _levels(self, windows: np.ndarray, bits: np.ndarray, places: list[int]):
        """For each prefix of the sampled places: sorted keys; for all of them also the anchors in key order."""
        flow = np.concatenate((windows, np.full((len(windows), 1), self.pad, np.int32)), 1).ravel()
        at = np.arange(len(windows)) * (windows.shape[1] + 1)
        ends, key, done, levels = at + windows.shape[1], np.zeros(len(windows), np.int64), 0, []
        for place in places:
            at = self._walk(flow, at, ends, bits, done, place)
            done = place
            key = key * (self.pad + 1) + flow[at]
            levels.append(np.unique(key))
        return levels, np.sort(key), np.argsort(key, kind="stable")

    def _hits(self, flow, starts, ends, run) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, anchor) of the windows whose samples agree with an anchor's; a window is dropped at the first sample that no anchor has."""
        _, bits, places, (levels, keys, order), _ = run
        index, at, key, done = np.arange(len(starts)), starts, np.zeros(len(starts), np.int64), 0
        for n, place in enumerate(places):
            at = self._walk(flow, at, ends[index], bits, done, place)
            done = place
            key = key * (self.pad + 1) + flow[at]
            if n == 0:
                table = np.zeros(self.pad + 1, bool)
                table[levels[0]] = True
                keep = table[key]
            else:
                keep = levels[n][np.minimum(np.searchsorted(levels[n], key), len(levels[n]) - 1)] == key
            index, at, key = index[keep], at[keep], key[keep]
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        return np.repeat(index, high - low), order[ragged(low, high - low)]

    def _known(self, words: pa.Array) -> np.ndarray:
        """The vocabulary's number of each word's normal form: 0 if it has none, -1 if nothing is left of the word."""
        ascii = pc.string_is_ascii(words)
        plain = pc.replace_substring_regex(pc.ascii_lower(words.filter(ascii)), "[^0-9a-z]+", "")
        number = pc.add(pc.fill_null(pc.index_in(plain, value_set=pa.array(list(self.vocabulary), words.type)), -1), 1)
        out, own = np.empty(len(words), np.int32), ascii.to_numpy(zero_copy_only=False)
        out[own] = pc.if_else(pc.equal(pc.binary_length(plain), 0), -1, number).to_numpy(zero_copy_only=False)
        out[~own] = [self.vocabulary.get(w, 0) if w else -1 for w in map(normal, words.filter(pc.invert(ascii)).to_pylist())]
        return out

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, item index, edits) of every candidate that is within the allowed edits."""
        codes, offsets, words = words_of(texts)
        known = self._known(words)
        flow = known[codes] if len(codes) else np.zeros(0, np.int32)
        full = np.concatenate(([0], np.cumsum(flow >= 0)))
        offsets, flow = full[offsets], flow[flow >= 0]
        n, counts = len(offsets) - 1, np.diff(offsets)
        doc = np.repeat(np.arange(n), counts)
        flow = np.insert(flow, offsets[1:], self.pad)  # one pad after every text
        starts = np.arange(len(doc)) + doc
        last = offsets[1:] + np.arange(n)
        ends = last[doc]
        found, room = [np.zeros(0, np.int64)], len(flow) + (1 << 20)
        for place, item in self._windows(flow):
            found.append(np.unique(item * room + place + (1 << 19)))
        for run in self.runs:
            index, which = self._hits(flow, starts, ends, run)
            anchor = run[4][which]
            found.append(np.unique(anchor[:, 0] * room + starts[index] - anchor[:, 1] + (1 << 19)))
        item_of, base_of = np.divmod(np.unique(np.concatenate(found)), room)
        base_of = base_of - (1 << 19)
        out, member = [], np.zeros(self.pad + 1, bool)
        cuts = np.flatnonzero(np.concatenate(([True], item_of[1:] != item_of[:-1]))) if len(item_of) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(item_of)), strict=True) if len(cuts) else ():
            item = int(item_of[a])
            m = len(self.tokens[item])
            e = edits_allowed(m, self.pct)
            member[:] = False
            member[self.tokens[item]] = True
            step = max(1, min(20_000, REGION_CELLS // (m + 2 * e)))
            for c in range(a, b, step):
                base = base_of[c : min(b, c + step)]
                middle = np.searchsorted(last, base + m // 2)  # the text that holds most of the window
                text = np.minimum(middle, n - 1)
                places = base[:, None] + np.arange(-e, m + e)[None, :]
                inside = (places >= (offsets[:-1] + np.arange(n))[text][:, None]) & (places < last[text][:, None])
                region = np.where(inside, flow[np.clip(places, 0, len(flow) - 1)], self.pad)
                enough = member[region].sum(1) >= m - e
                if enough.any():
                    edits = best_edits(self.tokens[item], region[enough])
                    ok = edits <= e
                    out.append((text[enough][ok], np.full(ok.sum(), item), edits[ok]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def find(
    docs: DataFrame, benchmark: DataFrame, pct: int = 20, recall: float = 0.97, block: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, edits, item_words): documents that hold an item within pct percent of its words in edits.

    ``edits`` is the least found; all documents with an item of less than SHORT words are found, others with probability ``recall``
    at least, as measured on random edits, or certainly where repetitions do not do. Items may be as long as texts are. Regions of equal edits give one row with their least. The benchmark is the query set: it is read in blocks of ``block`` items, each against all documents. Null
    or wordless texts and items match nothing; repeated rows give one row; an empty side gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, edits long, item_words long"
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    numbered, result, after = rows.orderBy("item_id", "text"), None, 0
    while True:
        part = numbered.offset(after).limit(block).collect()
        if not part and result is not None:
            break
        index = CgkIndex([(r["item_id"], item_words(r["text"])) for r in part], pct, recall)
        shared = spark.sparkContext.broadcast(index)  # at most ``block`` items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            names = [i for i, _ in index.items]
            for batch in batches:
                for piece in slices(batch, "text", 1 << 20):
                    text, item, edits = index.matches(piece.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(id_col).take(pa.array(text)),
                            pa.array([names[i] for i in item.tolist()], piece_type),
                            pa.array(edits.astype(np.int64)),
                            pa.array(np.array([len(index.tokens[i]) for i in item.tolist()], np.int64)),
                        ],
                        names=[id_col, "item_id", "edits", "item_words"],
                    )

        piece_type = to_arrow_type(benchmark.schema[item_col].dataType)
        some = docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)
        result = some if result is None else result.unionByName(some)
        after += block
        if len(part) < block:
            break
    return result.groupBy(id_col, "item_id").agg(F.min("edits").alias("edits"), F.max("item_words").alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null id stay (they cannot be told apart)."""
    leaks = find(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(leaks, id_col, "left_anti")
