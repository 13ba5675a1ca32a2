"""Best-fit packing planned on a histogram of lengths.

Pass one tokenizes every document once, cuts only those longer than a sequence, and
numbers the pieces of each length within their part (PART_PIECES of an input partition);
it is settled, so that the numbers cannot change. A count by length and part turns these
numbers into ranks within length, and each part meets its own counts only. The plan is best-fit decreasing over counts: groups of equal sequences are
filled together, so its size follows the distinct lengths (at most LENGTH of them) and
not the documents. Last, each piece takes the planned slot that has its length and rank.

Defined results: null or empty text is the end token alone; repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common
from lodestone.llm.tokenize import Encoder

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 4096, 1
#: Bytes of text that are encoded together; a longer run shares more of its words.
CHUNK_BYTES = 1_000_000
#: Pieces of a part.
PART_PIECES = 200_000
_OF_PIECE = (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))


def _schema(kind: T.DataType, *more: str) -> T.StructType:
    return T.StructType([T.StructField("id", kind), *(T.StructField(*x) for x in _OF_PIECE), *(T.StructField(c, T.LongType()) for c in more)])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    encode = Encoder.of(path)
    part = TaskContext.get().partitionId() << 32
    in_part = 0
    tail = np.array([end], "<u4").tobytes()
    seen = np.zeros(size + 1, np.int64)
    for batch in common.chunks(batches, limit=CHUNK_BYTES):
        ids, cuts = encode(*common.text_bytes(batch.column("text")))
        raw = memoryview(ids.tobytes())
        out: list[tuple] = []
        row: list[int] = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            total = b - a + 1
            for k, at in enumerate(range(0, total, size)):
                n = min(size, total - at)
                crc = zlib.crc32(raw[4 * (a + at) : 4 * min(a + at + n, b)])
                if at + n == total:
                    crc = zlib.crc32(tail, crc)
                if in_part == PART_PIECES:
                    part, in_part = part + 1, 0
                    seen[:] = 0
                row.append(i)
                out.append((k, at, n, crc, part, int(seen[n])))
                seen[n] += 1
                in_part += 1
        kinds = (pa.int32(), *(pa.int64(),) * 5)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])


class Plan:
    """For each length, ranges of ranks with the sequences and offsets that they take."""

    def __init__(self) -> None:
        self.first: dict[int, list[int]] = {}
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0

    def put(self, length: int, rank: int, sequence: int, each: int, offset: int) -> None:
        """From this rank on, each pieces in a row go to one sequence, from offset on, and the next to the sequence after it."""
        self.first.setdefault(length, []).append(rank)
        self.slots.setdefault(length, []).append((rank, sequence, each, offset))


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing for counts of lengths: each goes where the least room is left that holds it.

    Room is kept as room -> [(first sequence, how many)], with the rooms in order, so one
    step places as many equal pieces as one group of equal sequences takes.
    """
    plan = Plan()
    rooms: list[int] = []
    free: dict[int, list[tuple[int, int]]] = {}

    def open_(room: int, group: tuple[int, int]) -> None:
        if room:
            if room not in free:
                rooms.insert(bisect_left(rooms, room), room)
                free[room] = []
            free[room].append(group)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = size // length
                number = left // each or 1
                each = min(each, left)
                group, room = (plan.sequences, number), size
                plan.sequences += number
            else:
                room = rooms[k]
                group = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
                each = min(room // length, left)
                number = min(group[1], left // each)
                if number < group[1]:
                    open_(room, (group[0] + number, group[1] - number))
            plan.put(length, rank, group[0], each, size - room)
            open_(room - each * length, (group[0], number))
            rank += each * number
            left -= each * number
    return plan


def _place(pieces: pa.Table, before: pa.Table, plan) -> pa.Table:
    """The pieces of one part in their planned places; before: pieces of each length in the parts before it."""
    pieces = pieces.combine_chunks()
    slots = plan.value.slots
    length, rank = pieces["length"].to_numpy(), pieces["nth"].to_numpy()
    earlier = dict(zip(before["length"].to_pylist(), before["before"].to_pylist()))
    sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
    for at in np.split(order, cuts[1:]) if len(order) else ():
        n = int(length[at[0]])
        first, begin, each, base = np.array(slots[n], np.int64).T
        own = rank[at] + earlier[n]
        k = np.searchsorted(first, own, side="right") - 1
        inside = own - first[k]
        sequence[at] = begin[k] + inside // each[k]
        offset[at] = base[k] + inside % each[k] * n
    out = pieces.select(["id", *(c for c, _ in _OF_PIECE)])
    return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", size: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("text").cast("string").alias("text"))
    kind = made.schema["id"].dataType
    pieces = common.settle(made.mapInArrow(lambda it: _pieces(it, tokenizer, size, end), _schema(kind, "part", "nth")), "pieces")
    # at most size rows a part, which a window over one length adds up; then at most size rows in all
    parts = common.settle(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit(counts, size))
    parts = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    out = pieces.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(lambda a, b: _place(a, b, plan), _schema(kind, "sequence_id", "offset"))
    return out.withColumnRenamed("id", id_col)
