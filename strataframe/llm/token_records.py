"""Token ids as length-delimited binary records: a Spark data source that writes and reads them.

A folder holds data files, an index beside each, and a manifest. All numbers are little-endian; a checksum is CRC-32,
masked (rotated and shifted) so that a checksum of bytes that hold checksums stays telling.

=========  ===================================================================================================
record     length of the payload (8 bytes), checksum of those bytes (4), payload, checksum of the payload (4)
payload    doc_id (8 bytes), flags (4): 1 for a doc_id that is not null, 2 for narrow ids; ids, of 2 bytes each where
           all of the record's are below 65,536, which is what ``narrow`` says, and of 4 bytes otherwise
index      magic (8 bytes); for each record its offset in the data file (8) and the ids before it in the file (8);
           a last entry for the end of the file
manifest   one line of JSON per data file, in order, with its records, bytes, ids and checksum of the index
=========  ===================================================================================================

Every task writes files of its own name; the manifest, written last and moved into place, names those of the attempts
that were committed. A lost executor therefore leaves at most unnamed files, which the commit deletes, and readers see
a whole data set or none.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from strataframe.llm.names import fresh
from strataframe.llm.packing import END_ID, encoded_bytes

FORMAT = "token_records"
MAGIC = b"TKRINDEX"
MANIFEST = "_manifest.jsonl"
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<qI")
KNOWN, NARROW = 1, 2
ENTRY = 16
SPLIT_BYTES = 32 << 20  # of a data file that one reading task gets
CHUNK_BYTES = 4 << 20  # read at once, unless one record is longer
MASK_DELTA = 0xA282EAD8

RECORDS = "file string, record long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
INDEX = "file string, record long, offset long, end long, start long, n_tokens long"


def masked(data: bytes) -> int:
    """CRC-32 of the bytes, rotated right by 15 bits and shifted by a constant, modulo 2**32."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record of 32-bit ids."""
    numbers = np.frombuffer(ids, "<u4")
    flags = KNOWN if doc_id is not None else 0
    if not len(numbers) or numbers.max() < 1 << 16:
        flags |= NARROW
        ids = numbers.astype("<u2").tobytes()
    payload = KEY.pack(doc_id or 0, flags) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int, where: str) -> tuple[int | None, bytes, int]:
    """doc_id, 32-bit ids and the place after the record at ``at``; a record that fails a checksum is an error."""
    size, check = HEAD.unpack_from(data, at)
    begin = at + HEAD.size
    if masked(bytes(data[at : at + 8])) != check or begin + size + 4 > len(data) or size < KEY.size:
        raise ValueError(f"{where}: no record begins at byte {at} of the part read")
    payload = data[begin : begin + size]
    if masked(payload) != struct.unpack_from("<I", data, begin + size)[0]:
        raise ValueError(f"{where}: the record at byte {at} of the part read is damaged")
    doc_id, flags = KEY.unpack_from(payload)
    ids = bytes(payload[KEY.size :])
    if flags & NARROW:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return doc_id if flags & KNOWN else None, ids, begin + size + 4


def folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path.rstrip("/"))
    return arrow_fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path))


def read_manifest(path: str) -> list[dict]:
    """One entry per data file, in order, with the ids of all files before it as ``start``."""
    files, root = folder(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
        entries = [json.loads(line) for line in stream.read().decode().splitlines()]
    start = 0
    for entry in entries:
        entry["start"] = start
        start += entry["ids"]
    return entries


@dataclass
class Written(WriterCommitMessage):
    partition: int
    entry: dict | None


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, replace: bool):
        self.path = path
        self.replace = replace

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        files, root = folder(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        index, place, total, out = array("Q"), 0, 0, None
        for batch in iterator:
            for doc_id, ids in zip(batch["doc_id"], batch["ids"]):
                record = frame(doc_id.as_py(), ids.as_py())
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20)
                out.write(record)
                index.extend((place, total))
                place += len(record)
                total += len(ids.as_buffer()) // 4
        if out is None:
            return Written(context.partitionId(), None)
        out.close()
        index.extend((place, total))
        content = MAGIC + np.asarray(index, "<u8").tobytes()
        with files.open_output_stream(f"{root}/{name}.idx") as side:
            side.write(content)
        entry = {"file": name, "records": len(index) // 2 - 1, "bytes": place, "ids": total, "index": masked(content)}
        return Written(context.partitionId(), entry)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = folder(self.path)
        files.create_dir(root, recursive=True)
        done = sorted((m for m in messages if m is not None and m.entry), key=lambda m: m.partition)
        waiting = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
        with files.open_output_stream(waiting) as stream:
            stream.write("".join(json.dumps(m.entry) + "\n" for m in done).encode())
        files.move(waiting, f"{root}/{MANIFEST}")
        self._delete_but({m.entry["file"] for m in done})

    def abort(self, messages: list[Written | None]) -> None:
        if not self.replace:  # what stood there before stays readable
            self._delete_but(set())

    def _delete_but(self, named: set[str]) -> None:
        files, root = folder(self.path)
        for found in files.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
            stem, _, kind = found.base_name.rpartition(".")
            if kind in ("rec", "idx") and stem.startswith("part-") and stem not in named:
                files.delete_file(found.path)


@dataclass
class Part(InputPartition):
    """Records [first, last) of a data file whose ids start at ``start`` in the whole data set."""

    file: str
    first: int
    last: int
    start: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str, index_only: bool, with_ids: bool, split: int):
        self.path = path
        self.index_only = index_only
        self.with_ids = with_ids
        self.split = split

    def partitions(self) -> list[Part]:
        parts = []
        for e in read_manifest(self.path):
            pieces = min(e["records"], -(-e["bytes"] // self.split))
            cuts = [e["records"] * i // pieces for i in range(pieces + 1)]
            parts += [Part(e["file"], a, b, e["start"]) for a, b in zip(cuts, cuts[1:])]
        return parts or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        files, root = folder(self.path)
        with files.open_input_file(f"{root}/{part.file}.idx") as side:
            content = side.read_at(ENTRY * (part.last - part.first + 1), len(MAGIC) + ENTRY * part.first)
        offsets, before = np.frombuffer(content, "<u8").astype(np.int64).reshape(-1, 2).T
        if self.index_only:
            n = part.last - part.first
            records = np.arange(part.first, part.last)
            columns = ([part.file] * n, records, offsets[:-1], offsets[1:], part.start + before[:-1], np.diff(before))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "record", "offset", "end", "start", "n_tokens"])
            return
        with files.open_input_file(f"{root}/{part.file}.rec") as data:
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
                piece = memoryview(data.read_at(int(offsets[b] - offsets[a]), int(offsets[a])))
                yield self._batch(part, piece, offsets[a : b + 1] - offsets[a], a, part.start + before[a:b])
                a = b

    def _batch(self, part: Part, piece: memoryview, offsets: np.ndarray, skipped: int, starts: np.ndarray) -> pa.RecordBatch:
        docs, counts, crcs, ids = [], [], [], []
        for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            doc_id, content, after = unframe(piece, at, part.file)
            if after != end:
                raise ValueError(f"{part.file}: index and records disagree")
            docs.append(doc_id)
            counts.append(len(content) // 4)
            crcs.append(zlib.crc32(content))
            ids.append(content if self.with_ids else None)
        numbers = part.first + skipped + np.arange(len(docs))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = ([part.file] * len(docs), numbers, docs, starts, counts, crcs, ids)
        names = ("file", "record", "doc_id", "start", "n_tokens", "ids_crc32", "ids")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


class TokenRecords(DataSource):
    """``spark.write.format("token_records")`` of (doc_id, ids), and the way back.

    Reading options: ``what`` is ``records`` or ``index``; ``ids`` may be ``false`` where their checksums will do;
    ``splitBytes`` is how much of a data file one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return INDEX if self.options.get("what", "records") == "index" else RECORDS

    def reader(self, schema) -> RecordReader:
        index_only = self.options.get("what", "records") == "index"
        with_ids = self.options.get("ids", "true") == "true"
        return RecordReader(self.options["path"], index_only, with_ids, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        path = self.options["path"]
        files, root = folder(path)
        if not overwrite and files.get_file_info(f"{root}/{MANIFEST}").type != arrow_fs.FileType.NotFound:
            raise ValueError(f"{path} holds records already")
        return RecordWriter(path, overwrite)


def write_records(encoded: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``encoded`` (doc_id long, ids binary of little-endian 32-bit numbers) in the order of its partitions."""
    encoded.sparkSession.dataSource.register(TokenRecords)
    encoded.select("doc_id", "ids").write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def write_token_records(
    docs: DataFrame, path: str, tokenizer: str, text: str = "text", end_id: int = END_ID, overwrite: bool = False
) -> None:
    """Token ids of every whole text and the end id, as records in ascending doc_id order.

    Null ids come first. Rows with equal ids follow the hash of their text, so that a frequent id is spread over
    files; equal rows are equal records, as often as they occur. A null or empty text is the end id alone, an empty
    table a data set without files. Texts are encoded one at a time, so a very long one costs its own ids only.
    Other columns are not read. ``tokenizer`` is a file that every executor can open.
    """
    ident, order, place = fresh(docs, "ident", "order", "place")
    encode = encoded_bytes(tokenizer, end_id)
    keyed = docs.select(F.col("doc_id").cast("long").alias(ident), F.col(text), F.xxhash64(text).alias(order))
    by = [F.col(ident).asc_nulls_first(), F.col(order)]
    # equal rows, which any order suits, are told apart by where they are read
    ranged = keyed.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*by, F.col(place))
    rows = ranged.sortWithinPartitions(*by, F.col(text), F.col(place))
    write_records(rows.select(F.col(ident).alias("doc_id"), encode(F.col(text)).alias("ids")), path, overwrite)


def read_records(spark: SparkSession, path: str, with_ids: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record with its file, number, doc_id, start (ids of all records before it), n_tokens, ids_crc32 and ids."""
    spark.dataSource.register(TokenRecords)
    options = {"ids": str(with_ids).lower(), "splitBytes": str(split_bytes)}
    return spark.read.format(FORMAT).options(**options).load(path)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every record lies, from the index files alone."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format(FORMAT).option("what", "index").load(path)


def shuffled_records(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a pseudo-random order that depends on seed, file and record number: (place, doc_id, ids).

    Only index rows are sorted; each task then fetches its records where the index says they lie.
    """
    place = F.xxhash64(F.lit(seed), "file", "record")
    order = ["place", "file", "record"]
    rows = record_index(spark, path).select(place.alias("place"), "file", "record", "offset", "end")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = folder(path)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            places, docs, ids, held = [], [], [], 0
            for row in batch.to_pylist():
                if row["file"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[row["file"]] = files.open_input_file(f"{root}/{row['file']}.rec")
                found = memoryview(opened[row["file"]].read_at(row["end"] - row["offset"], row["offset"]))
                doc_id, content, _ = unframe(found, 0, row["file"])
                places.append(row["place"])
                docs.append(doc_id)
                ids.append(content)
                held += len(content)
                if held >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(docs, pa.int64()), pa.array(ids)], ["place", "doc_id", "ids"])
                    places, docs, ids, held = [], [], [], 0
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(docs, pa.int64()), pa.array(ids)], ["place", "doc_id", "ids"])
        for file in opened.values():
            file.close()

    return rows.mapInArrow(fetch, "place long, doc_id long, ids binary")


def id_array(ids: Column | str) -> Column:
    """The ids of a record as an array of numbers."""

    @F.arrow_udf("array<long>")
    def numbers(content: pa.Array) -> pa.Array:
        parts = [np.frombuffer(c.as_buffer(), "<u4").astype(np.int64) if c.is_valid else np.zeros(0, np.int64) for c in content]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    return numbers(F.col(ids) if isinstance(ids, str) else ids)
