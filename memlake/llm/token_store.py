"""Token ids in byte planes, compressed, with a chunk index (operator 7).

Documents go in ascending id order into chunks of whole documents.  Inside a
chunk the id stream is cut into blocks of ``BLOCK`` ids; a block's ids are
transposed into four byte planes (little-endian unsigned 32 bits) and each
plane is compressed with zstandard.  The chunk starts with the index of its
blocks.  A store is a folder: ``chunks`` has the payloads and each chunk's
documents, ``index`` says where each chunk's ids start in the whole stream.
Both are Parquet, so any file system that Spark reads will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm import textvec as tv

BLOCK = 16384
MAGIC = b"MLT1"


def encode_chunk(ids: np.ndarray, block: int = BLOCK, level: int = 3) -> bytes:
    """Magic, id count, block size, four plane lengths per block, then the planes."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    planes, lengths = [], []
    for at in range(0, len(ids), block):
        for plane in np.ascontiguousarray(ids[at : at + block].astype("<u4").view(np.uint8).reshape(-1, 4).T):
            planes.append(pack(plane.tobytes()))
            lengths.append(len(planes[-1]))
    return b"".join([struct.pack("<4sQI", MAGIC, len(ids), block), struct.pack(f"<{len(lengths)}I", *lengths), *planes])


def decode_chunk(raw: bytes) -> np.ndarray:
    """The ids of an encoded chunk."""
    import zstandard

    magic, count, block = struct.unpack_from("<4sQI", raw)
    if magic != MAGIC:
        raise ValueError("not a chunk of a token store")
    blocks = -(-count // block)
    at = struct.calcsize("<4sQI")
    lengths = struct.unpack_from(f"<{4 * blocks}I", raw, at)
    at += 16 * blocks
    unpack = zstandard.ZstdDecompressor().decompress
    out = np.empty((count, 4), np.uint8)
    for i, n in enumerate(lengths):
        low = i // 4 * block
        high = min(low + block, count)
        out[low:high, i % 4] = np.frombuffer(unpack(raw[at : at + n], max_output_size=high - low), np.uint8)
        at += n
    return out.view("<u4").ravel()


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """A memory that works a missing entry out."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        found = self[key] = self.find(key)
        return found


#: How a tokenizer must cut texts for its words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def cuts_as_known(tokenizer_json: str) -> bool:
    """Whether a tokenizer file normalises and cuts texts as ``WordEncoder`` does."""
    got = json.loads(tokenizer_json)
    model = got["model"]
    return (
        got["normalizer"] == NORMALIZER and got["pre_tokenizer"] == PRE_TOKENIZER and model["type"] == "BPE" and not model["dropout"]
        and all(t["content"].startswith("<") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in got["added_tokens"]))


class WordEncoder:
    """Encodes texts word by word with a memory of ``memory`` words.

    For a byte-level BPE with word ends that lower-cases and drops white space
    (``cuts_as_known``; any other tokenizer encodes each text whole): a text's
    ids are its words' ids in turn.  Words of printable ASCII and
    Latin-1 letters are cut into runs of letters, single digits and other signs,
    as that tokenizer cuts them, and the runs go straight to the library's BPE
    model; all other words go through the whole tokenizer.
    """

    plain = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch  # no apostrophe, no start of a special token
    runs = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall

    def __init__(self, tokenizer_file: str, memory: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.memory, self.words, self.pieces = memory, _Known(self._word), _Known(self._piece)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.by_word = cuts_as_known(self.tokenizer.to_str())

    def _piece(self, run: str) -> bytes:
        written = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode("utf-8")))
        found = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(found)}I", *found)

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8")
        if self.plain(word):
            return b"".join(map(self.pieces.__getitem__, self.runs(word.lower())))
        found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        for known in (self.words, self.pieces):
            if len(known) > self.memory:
                known.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def _encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _encode(tokenizer_file: str, end_id: int, chunk_ids: int):
    end = struct.pack("<I", end_id)
    shape = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, chunk = _encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        ids, held, n = [], [], 0

        def packed() -> pa.RecordBatch:
            payload = encode_chunk(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], shape.field("ids").type),
                 pa.array([[len(x) // 4 for x in held]], shape.field("lengths").type), pa.array([payload], pa.binary())], schema=shape)

        for batch in batches:
            data, offsets = tv.utf8(batch.column("text"))
            names = batch.column("id").to_pylist()
            for low, high in tv.slices(offsets):
                raw = data[offsets[low] : offsets[high]].tobytes()
                cut = (offsets[low : high + 1] - offsets[low]).tolist()
                for name, found in zip(names[low:high], encode([raw[a:b] for a, b in zip(cut, cut[1:])])):
                    ids.append(name)
                    held.append(found + end)
                    n += len(held[-1]) // 4
                    if n >= chunk_ids:
                        yield packed()
                        ids, held, n, chunk = [], [], 0, chunk + 1
        if ids:
            yield packed()

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, chunk_ids: int = 1 << 17) -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each, and write the store at ``path``.

    Documents stand in ascending id order, null ids first; rows that repeat an
    id stand side by side, ordered by a hash of their texts.  A text of any
    length is one document of one chunk.  Only the two named columns are read,
    so others cannot clash.  An empty table makes an empty store.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = base.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    chunks = dealt.mapInArrow(_encode(tokenizer_file, end_id, chunk_ids), "part int, chunk int, n_ids long, ids array<long>, lengths array<long>, payload binary")
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{path}/chunks").select("part", "chunk", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part")
    index.select("part", "chunk", "n_ids", (F.col("base") + F.col("own")).alias("start")).write.parquet(f"{path}/index")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            raw = decode_chunk(batch.column("payload")[i].as_py()).tobytes()
            lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
            ends = np.cumsum(lengths)
            cut = [0, *(ends * 4).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("ids")[i].as_py(), pa.int64()), pa.array(batch.column("start")[i].as_py() + ends - lengths), pa.array(lengths),
                 pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                ["id", "start", "n_tokens", "tokens"])


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, tokens)`` of each document; tokens are little-endian unsigned 32-bit ids."""
    chunks = spark.read.schema("part int, chunk int, ids array<long>, lengths array<long>, payload binary").parquet(f"{path}/chunks")
    index = spark.read.schema("part int, chunk int, start long").parquet(f"{path}/index")
    return chunks.join(index, ["part", "chunk"]).mapInArrow(_decode, "id long, start long, n_tokens long, tokens binary")
