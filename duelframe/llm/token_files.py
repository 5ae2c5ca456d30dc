"""Token files: one long array of ids, and Elias-Fano encoded boundaries of its documents.

Documents are sorted by id and encoded in blocks. A block is one row of a Parquet file that Spark's committer
writes, so a lost task leaves nothing half-written, and holds the ids of its documents one after the other (2 bytes each
where the vocabulary allows), the ends of the documents and the document ids, both as Elias-Fano sequences.

An Elias-Fano sequence of n rising numbers below u keeps the lower log2(u/n) bits of each as they are, and the rest in
unary: about 2 + log2(u/n) bits a number, with no table of 64-bit offsets. ``select`` finds the i-th number from the
place of every 256th unary mark.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.common import small_batches, tidied
from duelframe.llm.tokens import default_path, encoder
from duelframe.storage import new_path

#: A block ends with the document that brings it to so many ids: a quarter of a MB, which the JVM still allocates cheaply.
BLOCK_IDS = 1 << 17
#: One in so many unary marks has its place stored.
SAMPLE = 256

_HEAD = np.dtype([("n", "<u4"), ("low_bits", "<u4"), ("high_bits", "<u8"), ("samples", "<u4")])


class EliasFano:
    """A non-decreasing sequence of non-negative whole numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, high_bits: int, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.high_bits, self.places = n, low_bits, low, high, high_bits, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        marks = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high_bits = int(marks[-1]) + 1 if n else 0
        unary = np.zeros(high_bits, np.uint8)
        unary[marks] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), high_bits, marks[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        """The lower parts of numbers ``first`` to ``last`` - 1."""
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        begin, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))

    def all(self) -> np.ndarray:
        marks = np.flatnonzero(np.unpackbits(self.high, count=self.high_bits, bitorder="little"))
        return ((marks - np.arange(self.n)) << self.low_bits) + self._lows(0, self.n)

    def select(self, i: int) -> int:
        """The ``i``-th number, from the stored mark at or before it and the unary bits up to the next stored one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.places[i // SAMPLE])
        next_place = i // SAMPLE + 1
        end = int(self.places[next_place]) if next_place < len(self.places) else self.high_bits
        bits = np.unpackbits(self.high[at // 8 : -(-end // 8)], bitorder="little")[at % 8 :]
        mark = at + int(np.flatnonzero(bits)[i % SAMPLE])
        return ((mark - i) << self.low_bits) + int(self._lows(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        head = np.array([(self.n, self.low_bits, self.high_bits, len(self.places))], _HEAD)
        return b"".join([head.tobytes(), self.places.tobytes(), self.low.tobytes(), self.high.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        head = np.frombuffer(data, _HEAD, 1)[0]
        n, low_bits, high_bits = int(head["n"]), int(head["low_bits"]), int(head["high_bits"])
        at = _HEAD.itemsize
        places = np.frombuffer(data, "<u4", int(head["samples"]), at)
        at += places.nbytes
        low = np.frombuffer(data, np.uint8, -(-n * low_bits // 8), at)
        high = np.frombuffer(data, np.uint8, -(-high_bits // 8), at + low.nbytes)
        return cls(n, low_bits, low, high, high_bits, places)


_BLOCK = pa.schema(
    [
        ("part", pa.int32()),
        ("before", pa.int64()),
        ("n_ids", pa.int64()),
        ("n_docs", pa.int32()),
        ("null_keys", pa.int32()),
        ("first_key", pa.int64()),
        ("id_bytes", pa.int32()),
        ("keys", pa.binary()),
        ("ends", pa.binary()),
        ("ids", pa.binary()),
    ]
)
_BLOCK_SQL = "part int, before long, n_ids long, n_docs int, null_keys int, first_key long, id_bytes int, keys binary, ends binary, ids binary"


def _block(part: int, before: int, width: int, keys: list, lengths: list[int], ids: list[bytes]) -> pa.RecordBatch:
    known = np.array([k for k in keys if k is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum(lengths)
    row = {
        "part": part,
        "before": before,
        "n_ids": int(ends[-1]),
        "n_docs": len(keys),
        "null_keys": len(keys) - len(known),
        "first_key": first,
        "id_bytes": width,
        # the difference of 64-bit ids may need the full unsigned range
        "keys": EliasFano.of(known.view(np.uint64) - np.uint64(first & (1 << 64) - 1)).to_bytes(),
        "ends": EliasFano.of(ends).to_bytes(),
        "ids": b"".join(ids),
    }
    return pa.RecordBatch.from_pylist([row], _BLOCK)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of ``docs`` to folder ``path``, in ascending order of ``key`` (whole numbers, NULL first).

    Each document is the ids of its whole text and ``end_id``; NULL and empty texts are just ``end_id``. Rows with equal
    keys keep the order they are read in. A document longer than a block is a block of its own. Only texts
    are shuffled, once, by ranges of the key; every task holds one block. An empty table gives a folder without blocks.
    """

    @tidied
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, before, width = TaskContext.get().partitionId(), 0, encode.dtype.itemsize
        end = np.array([end_id], encode.dtype).tobytes()
        keys, lengths, ids, total = [], [], [], 0
        for batch in batches:
            for k, found in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1)), strict=True):
                packed = found.tobytes() + end
                keys.append(k)
                lengths.append(len(packed) // width)
                ids.append(packed)
                total += lengths[-1]
                if total >= block_ids:
                    yield _block(part, before, width, keys, lengths, ids)
                    before += total
                    keys, lengths, ids, total = [], [], [], 0
        if keys:
            yield _block(part, before, width, keys, lengths, ids)

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.col("_at")]
    slim = slim.withColumn("_at", F.monotonically_increasing_id())
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    stored = ranged.mapInArrow(blocks, _BLOCK_SQL).write
    small_batches(docs.sparkSession)
    stored.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of token files, with ``first_id``: the number of ids in all blocks before. One row per task is summed up."""
    read = spark.read.parquet(path)
    parts = read.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    return read.join(F.broadcast(starts), "part").withColumn("first_id", F.col("_start") + F.col("before")).drop("_start")


def decoded(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, place of the first id in the whole array, ids) of each document of a block, by select over the ends."""
    ends, known = EliasFano.from_bytes(row["ends"]), EliasFano.from_bytes(row["keys"])
    ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
    begin = 0
    for i in range(ends.n):
        end = ends.select(i)
        key = None if i < row["null_keys"] else known.select(i - row["null_keys"]) + row["first_key"]
        yield key, row["first_id"] + begin, ids[begin:end]
        begin = end


def _found(row: dict, key: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, n_tokens) of the documents of a block with a key: a binary search by select over the keys, then two selects over the ends."""
    known, ends = EliasFano.from_bytes(row["keys"]), EliasFano.from_bytes(row["ends"])
    i = bisect_left(range(known.n), key - row["first_key"], key=known.select)
    while i < known.n and known.select(i) == key - row["first_key"]:
        at = row["null_keys"] + i
        begin = ends.select(at - 1) if at else 0
        yield key, row["first_id"] + begin, ends.select(at) - begin
        i += 1


def find(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """(doc_id, start, n_tokens) of the documents with the given keys, one row per document; keys without one are left out.

    Only the two sequences of a block are read and of them only what select touches; the ids and the other documents are not.
    """
    wanted = sorted(set(keys))

    @tidied
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["n_docs"] > row["null_keys"]:
                    last = EliasFano.from_bytes(row["keys"])
                    last = last.select(last.n - 1) + row["first_key"]
                    inside = wanted[bisect_left(wanted, row["first_key"]) : bisect_right(wanted, last)]
                    out += [found for key in inside for found in _found(row, key)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens"])

    needed = blocks(spark, path).select("first_id", "n_docs", "null_keys", "first_key", "keys", "ends")
    return needed.mapInArrow(look, "doc_id long, start long, n_tokens long")


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in token files; the checksum is over 32-bit ids."""

    @tidied
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = [(k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, at, ids in decoded(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _DOC.types, strict=True)], schema=_DOC)

    needed = ["first_id", "null_keys", "first_key", "id_bytes", "keys", "ends", "ids"]
    return blocks(spark, path).select(*needed).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Query op6_token_files: write the files of all documents, then read them back."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = new_path(spark, "token-files")
    write(docs, path, tokenizer or default_path("word_bpe_49k.json"), end_id=1)
    return contents(spark, path)
