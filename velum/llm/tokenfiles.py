"""Token ids as flat binary files.

A part is two files: ``*.bin``, the ids of its documents one after the other as little-endian unsigned integers of 16
bits (32 if the vocabulary needs them), and ``*.idx``, which has the magic bytes, the width of an id in bytes, the
number of documents and of those with a null id, which come first, their ids as signed 64-bit integers and their 64-bit
offsets in the part. Both are memory-mapped on reading, or read by ranges where the folder isn't a mounted one. Parts are
in ascending order of document ids; the base of a part, the number of ids before it, comes from prefix sums over the
parts. A range of ids has about PART_BYTES of text, or more where there would be more than MOST_RANGES; a range's task
begins another part whenever one has FILE_BYTES.

A task names its files after its attempt, and the manifest names the files of the attempts that ended well; a lost
executor leaves at most files that the manifest doesn't name.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from velum.llm.common import narrow, prepare, shared_folder, texts

MAGIC = b"VELUMIDS"
#: UTF-8 bytes of text in a range of ids, and the most ranges: shuffle blocks are ranges times tasks.
PART_BYTES, MOST_RANGES = 16 << 20, 10_000
#: Bytes of token ids after which a task begins another part.
FILE_BYTES = 256 << 20
#: Documents whose ids are read at once.
BLOCK = 4096
#: Bytes of words that a worker knows before it puts them aside, and those of a word beside its characters.
CACHED_BYTES, WORD_BYTES = 48 << 20, 160

# The normalizer, the splitting pattern and what follows it, for which words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTE_LEVEL = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
# The same pattern for text in lower case that has Latin-1 characters only, without controls and no-break spaces.
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]")


class _Known(dict):
    """Packed ids of what stands between spaces, by the tokenizer's model: of a word as it is met first, of several words
    by those of each. What is met again of ``before`` stays."""

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype, spelled: dict[int, str], before: dict[str, bytes]):
        self.model, self.code, self.spelled, self.before, self.held = tokenizer.model, dtype.char, spelled, before, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            words = (chunk,) if chunk.isalpha() else _WORDS.findall(chunk)
            if len(words) > 1:
                ids = b"".join(map(self.__getitem__, words))
            else:
                ids = array(self.code, [x.id for x in self.model.tokenize(chunk if chunk.isascii() else chunk.translate(self.spelled))]).tobytes()
        self[chunk] = ids
        self.held += WORD_BYTES + len(chunk) + len(ids)
        return ids


class Encoder:
    """Ids of texts as the tokenizer gives them without special tokens, packed. Where its words are independent of each
    other, a text is cut at its spaces, and what is new between two of them is encoded once; a text with any unusual
    character goes to the tokenizer whole."""

    def __init__(self, tokenizer_json: str, end_id: int):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        made = json.loads(tokenizer_json)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.special = [x["content"] for x in made["added_tokens"]]
        split = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = made["normalizer"] == _NORMALIZER and split[0].get("pattern") == {"Regex": _SPLIT} and split[1:] == _BYTE_LEVEL and not made["truncation"] and not made["post_processor"]
        spelled = {c: "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0xA1, 0x100)} if self.by_word else {}
        self.fresh = partial(_Known, self.tokenizer, self.dtype, spelled)
        self.known = self.fresh({})

    def _whole(self, texts_: list[str]) -> Iterator[bytes]:
        begin, size = 0, 0
        for k, t in enumerate(texts_):  # about a megabyte of text at a time
            size += len(t)
            if size > 1 << 20 or k + 1 == len(texts_):
                for e in self.tokenizer.encode_batch(texts_[begin : k + 1], add_special_tokens=False):
                    yield np.array(e.ids, self.dtype).tobytes()
                begin, size = k + 1, 0

    def _by_word(self, text: str) -> bytes:
        ids = b"".join(map(self.known.__getitem__, text.lower().split()))
        if self.known.held > CACHED_BYTES:
            self.known.before = {}
            self.known = self.fresh(self.known)
        return ids

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id last."""
        easy = [self.by_word and not _OTHER.search(t) and not any(s in t for s in self.special) for t in texts_]
        hard = self._whole([t for t, plain in zip(texts_, easy, strict=True) if not plain])
        return [(self._by_word(t) if plain else next(hard)) + self.end for t, plain in zip(texts_, easy, strict=True)]


@lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str, end_id: int) -> Encoder:
    """One encoder in a worker process, so that tasks that follow each other there share the words it has met."""
    return Encoder(tokenizer_json, end_id)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^file:", "", uri))


def write_token_files(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the parts into ``folder`` (a URI that all executors can reach) and return the manifest: part, piece, file
    (without ending), n_docs, n_tokens, base. Documents are exchanged once, by ranges of their ids; a task writes a new
    pair of files when one has FILE_BYTES. Rows that share an id are neighbours, by their hashes, and may be parted. Null texts are encoded as empty ones, null ids come first. An empty table writes nothing."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        here, piece, part = TaskContext.get(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = _Part(fs, path, f"part-{here.partitionId():06d}-{piece:04d}-{here.taskAttemptId()}", encoder_of(sent.value, end_id))
            part.add(b.column(0), texts(b.column(1)))
            if part.written >= FILE_BYTES:
                yield part.close(here.partitionId(), piece)
                part, piece = None, piece + 1
        if part is not None:
            yield part.close(here.partitionId(), piece)

    d = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, order = max(1, min(MOST_RANGES, -(-size // PART_BYTES))), [F.col("doc_id").asc_nulls_first()]
    if _shared_id(d, ranges):
        order.append(F.xxhash64("text"))
    ranged = d.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    manifest = ranged.mapInArrow(write, "part int, piece int, file string, n_docs long, n_tokens long").checkpoint()
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _shared_id(d: DataFrame, ranges: int) -> bool:
    """Whether rows of one id are as many as a range should have, so that they have to be parted by their hashes."""
    n = d.select("doc_id").groupBy("doc_id").count().agg(F.max("count"), F.sum("count")).first()
    return bool(n[0] and n[0] > 1 and n[0] * ranges >= n[1])


class _Part:
    """Two files that are being written."""

    def __init__(self, fs: pafs.FileSystem, path: str, file: str, encoder: Encoder):
        self.fs, self.path, self.file, self.encoder = fs, path, file, encoder
        self.out = fs.open_output_stream(f"{path}/{file}.bin", compression=None)
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.nulls = self.written = 0

    def add(self, ids: pa.Array, batch: list[str]) -> None:
        packed = self.encoder.encode(batch)
        self.nulls += ids.null_count
        self.ids.append(np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        self.sizes.append(np.array([len(x) // self.encoder.dtype.itemsize for x in packed], np.int64))
        for x in packed:
            self.out.write(x)
            self.written += len(x)

    def close(self, part: int, piece: int) -> pa.RecordBatch:
        self.out.close()
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)))).astype("<i8")
        own = np.concatenate(self.ids).astype("<i8")
        with self.fs.open_output_stream(f"{self.path}/{self.file}.idx", compression=None) as f:
            f.write(MAGIC + struct.pack("<qqq", self.encoder.dtype.itemsize, len(own), self.nulls) + own.tobytes() + offsets.tobytes())
        row = [part], [piece], [self.file], [len(own)], [int(offsets[-1])]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["part", "piece", "file", "n_docs", "n_tokens"])


def open_part(folder: str, file: str) -> tuple[int, np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]:
    """Of a part: how many null ids come first, document ids, offsets, and a function that gives the token ids from one
    offset to another; memory-mapped where the folder is a local or mounted one, else read by ranges."""
    fs, path = _filesystem(folder)
    local = isinstance(fs, pafs.LocalFileSystem)

    def raw(name: str) -> np.ndarray:
        if local:
            return np.memmap(f"{path}/{name}", np.uint8, "r")
        with fs.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), np.uint8)

    index = raw(f"{file}.idx")
    if index[:8].tobytes() != MAGIC:
        raise ValueError(f"{file}.idx is no index of token ids")
    width, n, nulls = struct.unpack("<qqq", index[8:32].tobytes())
    mapped = raw(f"{file}.bin").view(f"<u{width}") if local else None
    stored = None if local else fs.open_input_file(f"{path}/{file}.bin")

    def ids(a: int, z: int) -> np.ndarray:
        return mapped[a:z] if local else np.frombuffer(stored.read_at((z - a) * width, a * width), f"<u{width}")

    return nulls, index[32 : 32 + 8 * n].view("<i8"), index[32 + 8 * n : 32 + 8 * (2 * n + 1)].view("<i8"), ids


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of
    its ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nulls, own, offsets, ids = open_part(folder, file)
                for k in range(0, len(own), BLOCK):
                    at = offsets[k : min(k + BLOCK, len(own)) + 1].astype(np.int64)
                    crc = [zlib.crc32(ids(a, z).astype("<u4").tobytes()) for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    docs = own[k : k + BLOCK].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.arange(k, k + len(docs)) < nulls), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "base").repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` into a new shared folder and read the files back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_json, end_id, id_col, text_col), folder)
