"""Packing documents into sequences of fixed length, with lower bounds that say when to stop.

Documents become pieces of at most ``LENGTH`` tokens, and pieces are dealt to groups of a bounded number of tokens. Each
group is packed best-fit decreasing. Dual feasible functions bound the number of sequences a group needs from below: a
group that meets its bound is certified and stays. Groups with a gap give up their sequences that are not full; those
pieces are dealt anew, across groups, and packed again, as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import small_batches, tidied
from duelframe.llm.tokens import GENERATION, SLICE_BYTES, cut_points, default_path, encoder
from duelframe.storage import materialise

LENGTH = 1024
#: Tokens dealt to one group, on average. A group is packed in one task.
GROUP_TOKENS = 8 << 20
#: Pieces dealt to one group, on average, however short they are.
GROUP_ROWS = 500_000
ROUNDS = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = False, key: str = "doc_id", text: str = "text", generation: int = GENERATION,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents.

    A document is the ids of its whole text and ``end_id``; NULL and empty texts are just ``end_id``. Only a document
    longer than ``length`` is cut, into full pieces; its first piece takes the remainder. ``ids`` are packed
    little-endian, as wide as the vocabulary needs. ``generation`` is how many encoded pieces of text a task remembers,
    ``slice_bytes`` how much text it holds and encodes at a time.
    """
    schema = _PIECE.append(pa.field("ids", pa.binary())) if with_ids else _PIECE

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, generation, slice_bytes)
        for batch in batches:
            rows = []
            for k, found in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1)), strict=True):
                packed = np.append(found, encode.dtype.type(end_id))
                for i, (a, b) in enumerate(cut_points(len(packed), length)):
                    crc = zlib.crc32(packed[a:b].astype("<u4").tobytes())
                    rows.append((k, i, a, b - a, crc, packed[a:b].tobytes()) if with_ids else (k, i, a, b - a, crc))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    small_batches(docs.sparkSession, slice_bytes)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """No packing of ``sizes`` (1 to ``length``) has fewer sequences: the best of three families of dual feasible functions.

    A dual feasible function maps sizes so that what fits in one sequence still does; the mapped sizes' sum over the
    length is then a bound. Used are the sizes themselves; rounding to multiples of 1/k; and, for each threshold t up to half,
    leaving out sizes below t and counting sizes above length - t as full.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=length + 1).astype(np.int64)
    size = np.arange(length + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // length)
    for k in range(1, 33):
        steps, rest = np.divmod((k + 1) * size, length)
        # in units of 1 / (k * length): a multiple of 1/(k+1) counts as it is, anything else as floor((k+1)x)/k
        value = np.where(rest == 0, k * size, steps * length)
        best = max(best, -(-int((count * value).sum()) // (k * length)))
    number, total = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, length // 2 + 1)
    middle = total[length - t] - total[t - 1]
    large = number[length] - number[length - t]
    return max(best, int((-(-middle // length) + large).max(initial=0)))


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size. Largest first, each into the fullest sequence that has room."""
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(length + 1)]  # open sequences by free tokens
    some = 0  # bit r is set if a sequence with r free tokens is open
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            free, at = length, opened
            opened += 1
        sequence[i], offset[i] = at, length - free
        if free > size:
            room[free - size].append(at)
            some |= 1 << (free - size)
    return sequence, offset


_PACKED = _PIECES + ", sequence_id long, offset long, open boolean, spare long"


def _packed(dealt: DataFrame, salt: int, groups: int, length: int) -> DataFrame:
    """Pack each of ``groups`` groups. ``open`` marks sequences that a group with a gap would give up; ``spare`` is the gap."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy(np.int64)
        sequence, offset = best_fit_decreasing(sizes, length)
        used = int(sequence.max()) + 1
        gap = used - lower_bound(sizes, length)
        filled = np.bincount(sequence, sizes, minlength=used)
        out = group[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (np.int64(salt) << 58) + (np.int64(group["_group"].iloc[0]) << 32) + sequence
        out["offset"], out["open"], out["spare"] = offset, (filled < length)[sequence] & (gap > 0), gap
        return out

    # a row's place in the stored table is part of the key: copies of a row are dealt apart
    deal = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(salt)), F.lit(groups))
    return dealt.withColumn("_group", deal).groupBy("_group").applyInPandas(pack, _PACKED)


def pack(items: DataFrame, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, rounds: int = ROUNDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``items`` of ``pieces`` with ``sequence_id``, ``offset`` and ``gap``; every piece is placed once, sequences have no gaps.

    ``gap`` is the certificate: 0 if the piece's group has as many sequences as its lower bound, or if its sequence is full; else how many
    sequences of the group are above the bound, which no packing may be able to save.
    Groups hold ``group_tokens`` tokens and ``group_rows`` pieces on average, so their number grows with the data and no task with it: pieces
    of a hot document are dealt one by one. Repeated rows are pieces of their own. In each round only the sequences that are not full
    in groups with a gap are packed again; the round counts if it needs fewer sequences for them, else packing ends
    with what there is. An empty table gives an empty table.
    """
    stored = materialise(items.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    number = lambda tokens, rows: max(1, -(-(tokens or 0) // group_tokens), -(-rows // group_rows))
    groups = number(*stored.agg(F.sum("length"), F.count("*")).first())
    done = []
    packed = materialise(_packed(stored, 0, groups, length), "packed")
    for salt in range(1, rounds + 1):
        given = packed.where("open").agg(F.sum("length").alias("tokens"), F.count_if(F.col("offset") == 0).alias("sequences"), F.count("*").alias("rows")).first()
        if not given["sequences"] or groups == 1:
            break
        groups = number(given["tokens"], given["rows"])
        again = materialise(_packed(packed.where("open").drop("sequence_id", "offset", "open", "spare"), salt, groups, length), "repacked")
        if again.where("offset = 0").count() >= given["sequences"]:
            break
        # what stays is certified or full
        done.append(packed.where("NOT open").withColumn("spare", F.lit(0).cast("long")))
        packed = again
    packed = packed.withColumn("spare", F.when(F.col("open"), F.col("spare")).otherwise(0))
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop("open").withColumnRenamed("spare", "gap")


def digest(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Query op9_best_fit_packing: all documents in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, generation: int = GENERATION, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    return pack(pieces(docs, tokenizer or default_path("byte_bpe_50k.json"), end_id=2, generation=generation, slice_bytes=slice_bytes))
