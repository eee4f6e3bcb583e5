"""Token ids in binary shards, each document compressed by itself with one shared dictionary.

A shard is a file of zstandard frames in ascending order of doc_id, and beside it an index of
fixed-size entries (id, place, size, tokens) that ends the search for a short document after one
small read. The dictionary's hash is part of every entry of the manifest. A shard is committed by
its row in the manifest, which Spark writes; files of failed or repeated tasks are not in it.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechmill.llm.common import shared_path

END_ID = 0
#: Documents that the dictionary is trained on, at most, and its size in bytes.
SAMPLE, DICTIONARY_BYTES = 300, 64 << 10
CACHED_PIECES, LONGEST_CACHED = 900_000, 64
ENTRY = np.dtype([("has_id", "<u8"), ("doc_id", "<i8"), ("place", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
MANIFEST = "shard long, data string, index string, dictionary string, n_docs long, n_tokens long"
#: A space before something that is not white space always begins a word of byte-level BPE.
CUT = re.compile(r" (?=\S)")


class Encoder:
    """Ids of whole texts from the tokenizers library, which sees every distinct word once.

    Byte-level BPE merges within words only, so a text's ids are those of its words in order. Added
    tokens that stand in a text get their own id, as in the library's plain call; they part the text
    before it is cut at spaces. With added tokens of other rules (white space around them, whole
    words, normalised text) texts are not cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        added = self.tool.get_added_tokens_decoder()
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.marks = {t.content: struct.pack("<I", i) for i, t in added.items()}
        # Of tokens that begin at one place the library takes the longest.
        self.marked = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")")
        self.known: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        got = self.tool.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in got)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return self._plain(texts)
        if not any(mark in t for mark in self.marks for t in texts):
            return self._by_word(texts)
        parted = [self.marked.split(t) for t in texts]
        between = iter(self._by_word([part for parts in parted for part in parts[::2]]))
        return [b"".join(self.marks[part] if k % 2 else next(between) for k, part in enumerate(parts)) for parts in parted]

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known = self.known
        cut = [CUT.split(t) for t in texts]
        heads = [parts.pop(0) for parts in cut]
        # The other pieces follow a space; they are remembered without it.
        fresh = list(set().union(*cut).difference(known))
        ids = self._plain(heads + [" " + p for p in fresh])
        known.update(zip(fresh, ids[len(heads) :], strict=True))
        out = [head + b"".join(map(known.__getitem__, parts)) for head, parts in zip(ids, cut, strict=False)]
        for piece in fresh:
            if len(piece) > LONGEST_CACHED:
                del known[piece]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts, about ``most`` characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; too little to train on makes the samples' end the dictionary itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train(docs: DataFrame, tokenizer: str, sample: int = SAMPLE) -> bytes:
    """The dictionary from the ids of ``sample`` documents taken by hash, trained in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        samples = [data for _, texts in _groups(batches) for data in tool(texts) if data]
        yield pa.RecordBatch.from_arrays([pa.array([trained_dictionary(samples)], pa.binary())], names=["dictionary"])

    chosen = docs.orderBy(F.xxhash64("doc_id", F.length("text")), "doc_id").limit(sample)
    got = chosen.select("doc_id", "text").coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(got[0]["dictionary"]) if got else b""


def write_shards(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode, compress and write all documents; returns the manifest, one row per shard.

    Ids of one document are its tokens and ``end_id``, as little-endian unsigned 32-bit integers. An
    added token that stands in a text, such as one for the end of a text, is encoded as that token.
    Shards are ranges of doc_id in order, null ids first; equal ids are ordered by text hash. Null
    text counts as empty and holds the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train(rows, tokenizer)
    store, root = files.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary.zstd", compression=None) as out:
        out.write(dictionary)
    name, uri = dictionary_hash(dictionary), folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        tool, known = encoder(tokenizer), _dictionary(dictionary)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        data, index = f"{root}/shard-{shard:06d}-{attempt}.zst", f"{root}/shard-{shard:06d}-{attempt}.index"
        out, entries, place, end = None, [], 0, end_id.to_bytes(4, "little")
        for ids, texts in _groups(batches):
            out = out or store.open_output_stream(data, compression=None)
            for one, tokens in zip(ids, tool(texts), strict=True):
                frame = squeeze.compress(tokens + end)
                out.write(frame)
                entries.append((one is not None, one or 0, place, len(frame), len(tokens) // 4 + 1))
                place += len(frame)
        if out is None:
            return
        out.close()
        table = np.array(entries, dtype=ENTRY)
        with store.open_output_stream(index, compression=None) as sink:
            sink.write(table.tobytes())
        row = [[shard], [data], [index], [name], [len(table)], [int(table["n_tokens"].sum())]]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _opened(folder: str) -> tuple[files.FileSystem, bytes]:
    store, root = files.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    with store.open_input_stream(f"{root}/dictionary.zstd", compression=None) as source:
        return store, source.read()


def _unpacker(dictionary: bytes, expected: str) -> zstandard.ZstdDecompressor:
    if dictionary_hash(dictionary) != expected:
        raise ValueError("the dictionary is not the one the shard was written with")
    known = _dictionary(dictionary)
    return zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``start`` counts the ids of all documents before; it comes from the manifest's totals (one row
    per shard) and the index of the shard. Shards are read frame by frame.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, dictionary = _opened(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                unpack = _unpacker(dictionary, shard["dictionary"])
                with store.open_input_stream(shard["index"], compression=None) as source:
                    table = np.frombuffer(source.read(), dtype=ENTRY)
                sums = []
                with store.open_input_stream(shard["data"], compression=None) as source:
                    for entry in table:
                        ids = unpack.decompressobj().decompress(source.read(int(entry["size"])))
                        if len(ids) != 4 * int(entry["n_tokens"]):
                            raise ValueError("a frame does not hold the tokens of its index entry")
                        sums.append(zlib.crc32(ids))
                tokens = table["n_tokens"].astype(np.int64)
                ends = np.cumsum(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(table["doc_id"], pa.int64(), mask=table["has_id"] == 0),
                        pa.array(shard["start"] + ends - tokens, pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    each = placed.select("shard", "data", "index", "dictionary", "start").repartitionByRange(shards, "shard")
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(manifest_row: dict, folder: str, position: int) -> np.ndarray:
    """The ids of one document of a shard: one index entry and one frame are read."""
    store, dictionary = _opened(folder)
    with store.open_input_file(manifest_row["index"]) as source:
        entry = np.frombuffer(source.read_at(ENTRY.itemsize, position * ENTRY.itemsize), dtype=ENTRY)[0]
    with store.open_input_file(manifest_row["data"]) as source:
        frame = source.read_at(int(entry["size"]), int(entry["place"]))
    unpack = _unpacker(dictionary, manifest_row["dictionary"])
    return np.frombuffer(unpack.decompressobj().decompress(frame), dtype="<u4")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to a new folder that is shared, and read them back."""
    folder = shared_path(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, tokenizer, folder), folder)
