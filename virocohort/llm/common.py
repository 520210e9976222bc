"""Helpers shared by the training-data operators: tables, row numbers, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virocohort.session import checkpoint_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The table written with a number for each row, so that repeated rows stay apart, and the number's name.

    It holds whole texts, so it is written more densely than by default.
    """
    row = fresh(df, "row_no")
    path, numbered_rows = shared_path(df.sparkSession, "rows"), df.withColumn(row, F.monotonically_increasing_id())
    numbered_rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(numbered_rows.schema).parquet(path), row


def marks_of(kept: DataFrame) -> str:
    """A shared folder with the row numbers in the one column of ``kept``: for each partition a file of one bit a row."""
    folder = shared_path(kept.sparkSession, "marks")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def put() -> None:
            places = np.concatenate(held)
            bits = np.zeros(int(places[-1]) + 1, bool)
            bits[places] = True
            put_file(f"{folder}/{part}", [np.packbits(bits).tobytes()])

        for batch in batches:
            parts, places = batch.column("part").to_numpy(), batch.column("place").to_numpy()
            cuts = [*np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]), len(parts)] if len(parts) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts[a] != part and held:
                    put()
                    held = []
                part = int(parts[a])
                held.append(places[a:b])
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["done"])

    number = F.col(kept.columns[0])
    places = kept.select(F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("place"))
    places.repartition("part").sortWithinPartitions("part", "place").mapInArrow(mark, "done long").agg(F.count("*")).collect()

    return folder


class Marks:
    """Tells which row numbers are marked in a folder of ``marks_of``; holds the marks of one partition."""

    def __init__(self, folder: str):
        self.folder, self.part, self.bits = folder, None, np.zeros(0, bool)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), bool)
        for part in np.unique(numbers >> 33):
            if part != self.part:
                self.part, self.bits = part, np.unpackbits(np.frombuffer(read_file(f"{self.folder}/{part}"), np.uint8)).astype(bool)
            at = np.flatnonzero(numbers >> 33 == part)
            place = numbers[at] & ((1 << 33) - 1)
            inside = place < len(self.bits)
            out[at[inside]] = self.bits[place[inside]]
        return out


def labels_of(labelled: DataFrame) -> str:
    """A shared folder with a label for row numbers (two columns of integers): for each partition a file of places and labels."""
    folder = shared_path(labelled.sparkSession, "labels")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def put() -> None:
            put_file(f"{folder}/{part}", [np.concatenate(held).astype("<i8").tobytes()])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            both = np.stack([batch.column("place").to_numpy(), batch.column("label").to_numpy()], axis=1)
            cuts = [*np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]), len(parts)] if len(parts) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts[a] != part and held:
                    put()
                    held = []
                part = int(parts[a])
                held.append(both[a:b])
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["done"])

    number, label = (F.col(c) for c in labelled.columns)
    places = labelled.select(F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("place"), label.alias("label"))
    places.repartition("part").sortWithinPartitions("part", "place").mapInArrow(write, "done long").agg(F.count("*")).collect()
    return folder


class Labels:
    """Tells the labels of row numbers in a folder of ``labels_of``, the number itself where it has none; holds those of one partition."""

    def __init__(self, folder: str):
        self.folder, self.part, self.table = folder, None, np.zeros((0, 2), "<i8")

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for part in np.unique(numbers >> 33):
            if part != self.part:
                self.part, self.table = part, np.frombuffer(read_file(f"{self.folder}/{part}"), "<i8").reshape(-1, 2)
            at = np.flatnonzero(numbers >> 33 == part)
            out[at] = numbers[at]
            if len(self.table):
                place = numbers[at] & ((1 << 33) - 1)
                near = np.minimum(np.searchsorted(self.table[:, 0], place), len(self.table) - 1)
                met = self.table[near, 0] == place
                out[at[met]] = self.table[near[met], 1]
        return out


def keep_rows(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose numbers (as ``numbered`` makes them, none null) are in the one column of ``kept``.

    The rows themselves aren't dealt out: a task reads the marks of the partitions that it meets.
    """
    folder = marks_of(kept)

    @F.arrow_udf("boolean")
    def marked(numbers: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Marks(folder)
        for n in numbers:
            yield pa.array(marks(n.to_numpy(zero_copy_only=False)))

    return rows.where(marked(F.col(f"`{row}`")))


def file_system(uri: str):
    """The file system of a path and the path within it, for tasks that write files of their own format."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def replace_file(system, part: str, path: str) -> None:
    """Move a finished file into place, also where an earlier attempt of the task has left one."""
    try:
        system.move(part, path)
    except OSError:  # a rename that doesn't replace
        system.delete_file(path)
        system.move(part, path)


def put_file(uri: str, chunks) -> int:
    """Write a file under another name, then move it into place: a repeated task leaves one whole file."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    replace_file(system, part, path)
    return size


def read_file(uri: str) -> bytes:
    """The whole file; nothing where there is none."""
    from pyarrow import fs

    system, path = file_system(uri)
    if system.get_file_info(path).type != fs.FileType.File:
        return b""
    with system.open_input_file(path) as f:
        return f.read()


def get_range(uri: str, offset: int, length: int) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def file_size(uri: str) -> int:
    system, path = file_system(uri)
    return system.get_file_info(path).size
