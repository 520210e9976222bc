"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A bounded sample of short documents trains the dictionary.  Each document is encoded and compressed in the task that
reads it, so only frames are shuffled, to shards that are ranges of ids with about equal counts.  A shard's file is

    magic | SHA-256 of the dictionary | frames | index, compressed | place of the index, documents, width | magic

where the index holds per document its id, the frame's offset and length, its first token within the shard and its
tokens.  The manifest (a Parquet table) adds up the shards' tokens; the dictionary lies beside it under its hash.
One document is read with the manifest's ranges, the index and one range of the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from virocohort.llm.common import file_size, file_system, get_range, put_file, shared_path
from virocohort.llm.tokens import encoder

MAGIC = b"TOKFILE1"
TAIL = "<qqqq8s"  # index offset, index length, documents, bytes an id, magic
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("start", "<i8"), ("tokens", "<i8")])
MANIFEST = "shard long, file string, documents long, tokens long, bytes long, first_id long, last_id long"


def train_dictionary(docs: DataFrame, rows: int, tokenizer: str, split: str | None, width: int, sample_rows: int, sample_bytes: int, dictionary_bytes: int) -> bytes:
    """A dictionary of the serialised ids of at most ``sample_rows`` whole documents of at most ``sample_bytes`` each, chosen
    by a hash of their ids; empty where they are too few to train one."""
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // sample_rows))) == 0
    few = docs.where(chosen & F.octet_length("text").between(1, sample_bytes)).limit(sample_rows)
    encode = encoder(tokenizer, split)
    samples = [np.frombuffer(encode(r[0].encode()), "<u4").astype(f"<u{width}").tobytes() for r in few.select("text").collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_ids(docs: DataFrame, folder: str, tokenizer: str, split: str | None, end_id: int, vocabulary_size: int,
              id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20, level: int = 3,
              sample_rows: int = 1000, sample_bytes: int = 8192, dictionary_bytes: int = 65536) -> DataFrame:
    """Write all documents' ids, each followed by the end id, in ascending order of their ids; the manifest.

    ``shard_bytes`` is the aimed text size of a shard.  Documents with a null id come first; of repeated ids the
    order is that of length and content.  Null texts are empty.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = 2 if vocabulary_size <= 1 << 16 else 4
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    dictionary = train_dictionary(docs, rows, tokenizer, split, width, sample_rows, sample_bytes, dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    put_file(f"{folder}/{digest.hex()}.zdict", [dictionary])
    shards = max(1, -(-(size or 0) // shard_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10_000)).first()[0] if shards > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, split), int(end_id).to_bytes(4, "little")
        packed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            shard = [0 if i is None else int(np.searchsorted(cuts, i, "left")) for i in ids]
            frames, tokens = [], []
            for text in batch.column("text").cast(pa.binary()):
                data = encode(text.as_py()) + end
                tokens.append(len(data) // 4)
                frames.append(packed.compress(np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes() if width == 2 else data))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(frames, pa.binary())],
                                             names=["shard", "doc_id", "tokens", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        out, shard, index, at, start = None, None, [], 0, 0

        def close():
            table = np.array(index, INDEX)
            data = zstandard.ZstdCompressor().compress(table.tobytes())
            out.write(data + struct.pack(TAIL, at, len(data), len(index), width, MAGIC))
            out.close()
            name = f"shard-{shard:08d}.ids"
            system.move(part, f"{base}/{name}")
            known = [i[0] for i in index if i[1]]
            row = (shard, name, len(index), start, at + len(data) + struct.calcsize(TAIL), known[0] if known else None, known[-1] if known else None)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for s, doc, tokens, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if out:
                        yield close()
                    shard, index, start = s, [], 0
                    part = f"{base}/shard-{s:08d}.ids.{TaskContext.get().taskAttemptId()}.part"
                    out = system.open_output_stream(part)
                    out.write(MAGIC + digest)
                    at = len(MAGIC) + len(digest)
                out.write(frame)
                index.append((doc or 0, doc is not None, at, len(frame), start, tokens))
                at, start = at + len(frame), start + tokens
        if out:
            yield close()

    frames = docs.mapInArrow(compress, "shard long, doc_id long, tokens long, frame binary")
    written = frames.repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tokens", "frame").mapInArrow(write, MANIFEST)
    written.write.parquet(f"{folder}/shards")
    # one row a shard: adding up their tokens is small work
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spark.read.schema(MANIFEST).parquet(f"{folder}/shards").withColumn("start", before).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _open(folder: str, file: str):
    """The index of a shard file and its decompressor; the dictionary must have the hash that the file names."""
    path = f"{folder}/{file}"
    size = file_size(path)
    at, length, documents, width, magic = struct.unpack(TAIL, get_range(path, size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
    head = get_range(path, 0, len(MAGIC) + 32)
    if magic != MAGIC or head[:len(MAGIC)] != MAGIC:
        raise ValueError(f"{path} is no token file")
    name = f"{folder}/{head[len(MAGIC):].hex()}.zdict"
    dictionary = get_range(name, 0, file_size(name))
    if hashlib.sha256(dictionary).digest() != head[len(MAGIC):]:
        raise ValueError(f"{name} doesn't have its hash")
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(get_range(path, at, length), documents * INDEX.itemsize), INDEX)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    return index, reader, int(width)


def read_ids(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """All documents of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, ids
    (32-bit little-endian; null unless asked for)."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "start")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, reader, width = _open(folder, file)
                system, base = file_system(folder)
                with system.open_input_file(f"{base}/{file}") as f:
                    f.seek(len(MAGIC) + 32)
                    for k in range(0, len(index), 1000):
                        some = index[k:k + 1000]
                        crc, out = [], []
                        for n, tokens in zip(some["length"].tolist(), some["tokens"].tolist(), strict=True):
                            data = reader.decompress(f.read(n), tokens * width)
                            data = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                            if len(data) != 4 * tokens:
                                raise ValueError(f"{file}: a document doesn't have its length")
                            crc.append(zlib.crc32(data))
                            out.append(data if ids else None)
                        yield pa.RecordBatch.from_arrays([pa.array(some["doc_id"], pa.int64(), mask=some["has_id"] == 0), pa.array(some["start"] + start), pa.array(some["tokens"]),
                                                          pa.array(crc, pa.int64()), pa.array(out, pa.binary())], names=names)

    files = max(1, manifest.count())
    return manifest.repartition(files, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each, where an id is repeated): manifest, index and one range of a file each."""
    found = []
    hit = spark.read.parquet(f"{folder}/manifest").where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))).orderBy("shard")
    for r in hit.select("file").collect():
        index, reader, width = _open(folder, r[0])
        for i in index[(index["doc_id"] == doc_id) & (index["has_id"] == 1)]:
            data = reader.decompress(get_range(f"{folder}/{r[0]}", int(i["offset"]), int(i["length"])), int(i["tokens"]) * width)
            found.append(np.frombuffer(data, f"<u{width}").astype("<u4"))
    return found


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, split: str | None, end_id: int, vocabulary_size: int, folder: str | None = None) -> DataFrame:
    folder = folder or shared_path(spark, "token-ids")
    write_ids(docs, folder, tokenizer, split, end_id, vocabulary_size)
    return read_ids(spark, folder, ids=False).drop("ids")
