"""Token ids in a binary file of byte or bit planes.

File layout (integers little-endian):

    "TMPLANE1" | u8 plane kind (8: byte planes, 1: bit planes) | u32 ids in a block
    blocks, each: its planes one after another, every plane compressed with zstandard
    documents: zstandard of int64 ids, u8 null marks, int64 lengths
    chunk index: zstandard of JSON [[offset, ids, [bytes of each plane]], ...]
    u64 documents' offset, u64 documents, u64 index's offset, "TMPLANE1"

Byte plane p of a block holds byte p of each of its ids, bit plane p bit p of each; planes above the block's largest id
are left out. The chunk index lets a reader fetch any block alone.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, functions as F

from ._cut import cut, fresh_path, note
from ._words import ragged, slices, tidied, trim, words_of

MAGIC = b"TMPLANE1"
#: ASCII marks that never join a letter or digit before them into one piece of the vocabulary's word pattern.
TAIL = ".,;:!?$%&#*|)"
#: Words whose ids are gathered at once.
GATHER = 1 << 15
ENDS_IN_LETTER = r"[A-Za-z0-9À-ÖØ-öø-ÿ]$"


def planes_of(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of one block of uint32 ids, lowest first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == 8:
        parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [parts[:, p].tobytes() for p in range((top + 7) // 8)]
    return [np.packbits((ids >> p & 1).astype(np.uint8)).tobytes() for p in range(top)]


def ids_of(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    """The block of ``n`` ids that ``planes`` hold."""
    out = np.zeros(n, np.uint32)
    for p, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        values = values if kind == 8 else np.unpackbits(values, count=n)
        out |= values.astype(np.uint32) << np.uint32(p * (8 if kind == 8 else 1))
    return out


def _open(path: str, mode: str):
    """A file of the shared folder, by plain or file: path or through pyarrow's file systems."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, mode)
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), mode)
    store, inner = pa.fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def _make_dir(path: str) -> None:
    if path.startswith("file:") or "://" not in path:
        os.makedirs("/" + path[5:].lstrip("/") if path.startswith("file:") else path, exist_ok=True)
    else:
        store, inner = pa.fs.FileSystem.from_uri(path)
        store.create_dir(inner)


def _delete_file(path: str) -> None:
    if path.startswith("file:") or "://" not in path:
        os.remove("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
    else:
        store, inner = pa.fs.FileSystem.from_uri(path)
        store.delete_file(inner)


class PlaneWriter:
    """Writes one file; ``close`` writes the document table and the chunk index."""

    def __init__(self, out, block: int = 1 << 16, kind: int = 8):
        self.out, self.block, self.kind, self.at = out, block, kind, 0
        self.index, self.docs, self.lengths, self.rest = [], [], [], np.zeros(0, np.uint32)
        self.pack = zstandard.ZstdCompressor(level=3)
        self._put(MAGIC + struct.pack("<BI", kind, block))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in planes_of(ids, self.kind)]
        self.index.append([self.at, len(ids), [len(p) for p in planes]])
        self._put(b"".join(planes))

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in a row: their ids one after another and how many each has."""
        self.docs.extend(doc_ids)
        self.lengths.append(lengths.astype("<i8"))
        self.rest = np.concatenate((self.rest, ids.astype(np.uint32)))
        whole = len(self.rest) // self.block * self.block
        for i in range(0, whole, self.block):
            self._block(self.rest[i : i + self.block])
        self.rest = self.rest[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        docs_at = self.at
        values = np.array([0 if d is None else d for d in self.docs], "<i8")
        nulls = np.array([d is None for d in self.docs], np.uint8)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<i8")
        self._put(self.pack.compress(values.tobytes() + nulls.tobytes() + lengths.tobytes()))
        index_at = self.at
        self._put(self.pack.compress(json.dumps(self.index).encode()))
        self._put(struct.pack("<QQQ", docs_at, len(self.docs), index_at) + MAGIC)


class PlaneReader:
    """Reads a file: ``docs`` (ids, None for null), ``lengths``, and blocks of ids by the chunk index."""

    def __init__(self, src):
        self.src = src
        src.seek(0, 2)
        size = src.tell()
        src.seek(size - 32)
        tail = src.read(32)
        if tail[24:] != MAGIC:
            raise ValueError("not a token plane file")
        docs_at, n, index_at = struct.unpack("<QQQ", tail[:24])
        unpack = zstandard.ZstdDecompressor()
        src.seek(len(MAGIC))
        self.kind, self.block = struct.unpack("<BI", src.read(5))
        src.seek(docs_at)
        raw = unpack.decompress(src.read(index_at - docs_at))
        values, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.docs = [None if gone else v for v, gone in zip(values.tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)
        src.seek(index_at)
        self.index = json.loads(unpack.decompress(src.read(size - 32 - index_at)))
        self.unpack = unpack

    def read_block(self, i: int) -> np.ndarray:
        at, n, parts = self.index[i]
        self.src.seek(at)
        data, planes, start = self.src.read(sum(parts)), [], 0
        for part in parts:
            planes.append(self.unpack.decompress(data[start : start + part]))
            start += part
        return ids_of(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, token ids) of each document, block by block."""
        held, blocks = np.zeros(0, np.uint32), iter(range(len(self.index)))
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.read_block(next(blocks)))
                    have += len(parts[-1])
                held = np.concatenate(parts)
            yield doc, held[:n]
            held = held[n:]


#: The normaliser and the word pattern under which a text's ids are those of its words in a row.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Memory:
    """Ids of distinct strings, kept as columns: ``flat[ends[i]:ends[i + 1]]`` are those of string i.

    Beyond ``most`` strings the older half stays: frequent words come early.
    """

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most
        self.words, self.flat, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``flat``, number of ids) of each of the distinct ``items``; unknown ones are encoded first."""
        if len(self.words) > self.most:
            self.words = pa.concat_arrays([self.words.slice(0, self.most // 2)])
            self.ends = self.ends[: len(self.words) + 1]
            self.flat = self.flat[: self.ends[-1]].copy()
        at = pc.index_in(items, value_set=self.words)
        unknown = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if unknown.any():
            new = items.filter(pa.array(unknown))
            at[unknown] = len(self.words) + np.arange(len(new))
            parts, counts = [self.flat], []
            for start in range(0, len(new), 4096):
                found = [got.ids for got in self.encode(new.slice(start, 4096).to_pylist())]
                counts.extend(map(len, found))
                parts.append(np.fromiter(chain.from_iterable(found), np.uint32))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate(parts)
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))
        return self.ends[at], self.ends[at + 1] - self.ends[at]


class TextEncoder:
    """Ids of whole texts, as the tokenizers library's plain call with add_special_tokens=False gives them.

    Where the file's normaliser and pattern are those of ``WORDWISE``, nothing reaches across white space, so a text's ids
    are those of its words in a row: the library encodes each distinct word once and a bounded memory keeps its ids; closing
    ASCII marks after a letter or digit are pieces of their own and are looked up apart. Any other file's texts go to
    the library whole. Strings of special tokens in a text become these tokens, as the library does by default (a word that
    may hold one is looked up whole and as it is written), or are ordinary text with ``special_as_text``.
    """

    def __init__(self, path: str, most: int = 500_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [] if special_as_text else [t.content for t in added]
        described = {k: json.loads(part.__getstate__()) for k in WORDWISE if (part := getattr(self.tokenizer, k)) is not None}
        plain = all(t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized or any(c.isspace() for c in t.content)) for t in added)
        self.wordwise = plain and all(described.get(k) == v for k, v in WORDWISE.items())
        encode = lambda words: self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.stems, self.tails = _Memory(encode, most), _Memory(encode, most)

    def encode(self, texts: pa.Array, end: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the texts one after another, each closed by ``end``."""
        return self._by_word(texts, end) if self.wordwise else self._whole(texts, end)

    def _whole(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        last = [] if end is None else [end]
        parts = [np.array(got.ids + last, np.uint32) for got in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array([len(x) for x in parts], np.int64)

    def _by_word(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets, words = words_of(texts)
        whole, written, words = pa.array(np.zeros(len(words), bool)), words, pc.ascii_lower(words)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(words, pc.ascii_lower(token).as_py()))
        stem = pc.utf8_rtrim(words, TAIL)
        split = pc.match_substring_regex(stem, ENDS_IN_LETTER)
        if whole.true_count:
            words, split = pc.if_else(whole, written, words), pc.and_not(split, whole)
        stem = pc.if_else(split, stem, words)
        tail = _tails(words, stem)
        stems, tails = stem.dictionary_encode(), tail.dictionary_encode()
        stem_at, stem_n = self.stems.find(stems.dictionary)
        tail_at, tail_n = self.tails.find(tails.dictionary)
        flat = np.concatenate((self.stems.flat, self.tails.flat, np.array([end or 0], np.uint32)))
        tail_at = tail_at + len(self.stems.flat)
        s, t = stems.indices.to_numpy(), tails.indices.to_numpy()
        stem_at, stem_n, tail_at, tail_n = stem_at[s], stem_n[s], tail_at[t], tail_n[t]
        ids, lengths, low = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while low < len(offsets) - 1:  # whole texts of about GATHER words: indices take many times the words' room
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GATHER, "right")) - 1)
            part, here = codes[offsets[low] : offsets[high]], 2 * (offsets[low : high + 1] - offsets[low])
            starts = np.stack((stem_at[part], tail_at[part]), 1).ravel()
            counts = np.stack((stem_n[part], tail_n[part]), 1).ravel()
            n = np.diff(np.concatenate(([0], np.cumsum(counts)))[here])
            if end is not None:
                starts = np.insert(starts, here[1:], len(flat) - 1)
                counts = np.insert(counts, here[1:], 1)
                n = n + 1
            ids.append(flat[ragged(starts, counts)])
            lengths.append(n)
            low = high
        return np.concatenate(ids), np.concatenate(lengths)


def _tails(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What each word has after its stem, as strings (ASCII by construction)."""
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    extra = lengths - pc.binary_length(stems).to_numpy()
    ends = np.cumsum(lengths)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    data = data[np.frombuffer(words.buffers()[1], np.int32)[words.offset] :]
    out = data[ragged(ends - extra, extra)]
    offsets = np.concatenate(([0], np.cumsum(extra))).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def _encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    """The worker's encoder of this file, with its memory of words, for as long as the worker lives."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, special_as_text=special_as_text)
        trim()  # what parsing the file took
    return _encoders[key]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 1, block: int = 1 << 16, kind: int = 8, special_as_text: bool = False) -> DataFrame:
    """Token files of ``docs`` in ascending id order; returns the manifest (part, path, docs, ids), one row a file.

    Null text is the empty text, which still has its end id; null ids come last; rows that share an id are ordered
    by a hash of their text; an empty table writes nothing. Very long texts are encoded whole; other columns are ignored.
    Strings of special tokens are tokens unless ``special_as_text``. A file is complete when the manifest names it: a failed
    task deletes its file where it can, and a lost one's keeps a name of its own that no manifest has.
    """
    if folder is None:
        note(folder := fresh_path(docs.sparkSession, "token-planes"))
    _make_dir(folder)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = [F.asc_nulls_last("id"), F.xxhash64("text").asc()]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, writer, out = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.planes", None, None
        encoder = _encoder(tokenizer, special_as_text)
        n_ids = n_docs = 0
        try:
            for batch in batches:
                for rows in slices(batch, "text", 2 << 20):
                    ids, lengths = encoder.encode(rows.column("text"), end)
                    if writer is None:
                        out = _open(path, "wb")
                        writer = PlaneWriter(out, block, kind)
                    writer.add(rows.column("id").to_pylist(), lengths, ids)
                    n_ids, n_docs = n_ids + len(ids), n_docs + len(lengths)
            if writer:
                writer.close()
                out.close()
        except BaseException:
            if out:
                out.close()
                _delete_file(path)
            raise
        if writer:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [n_docs], "ids": [n_ids]})

    return cut(ordered.mapInArrow(tidied(put), "part long, path string, docs long, ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` names."""
    spark = manifest.sparkSession
    files, base = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row a file
        files.append((row["path"], base))
        base += row["ids"]

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in frames:
            for path, start in zip(pdf["path"], pdf["base"], strict=True):
                with _open(path, "rb") as src:
                    rows = []
                    for doc, ids in PlaneReader(src).documents():
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))

    listed = spark.createDataFrame(files, "path string, base long")
    listed = listed.repartition(max(1, len(files)))
    return listed.mapInPandas(tidied(get), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``write`` and ``read`` in a row: one row per document, read back from the files (all cases as in ``write``)."""
    return read(write(docs, tokenizer, **options))
