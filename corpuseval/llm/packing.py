"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by linear grouping.

Texts are turned into ids where they are read, one vocabulary look-up per distinct word of a chunk, and cut into pieces;
only the pieces' lengths and checksums move on. They are dealt round robin into bins of work of about ``shard`` pieces,
which lose less than one sequence each against a packing of all pieces at once, and each is packed in one task:

1. pieces above ``capacity / 4`` are sorted into groups of equal cardinality and rounded up to their group's largest;
2. configurations of these few sizes are chosen one after another, each holding the largest size left and filled as
   far as a bounded knapsack allows, and used as often as the groups last;
3. actual pieces take the places of the rounded sizes;
4. all other pieces go, longest first, into the sequence with the least room that holds them.

Defined cases: a null or empty text is the end id alone, one piece of length 1; repeated rows and null ids are packed
like any others, one piece row for each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuseval.llm.subword import encoder
from corpuseval.llm.units import chunks, coded, frugal, gather, split_units, text_bytes
from corpuseval.session import ship_package

CHUNK = 4 << 20
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(file: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(file)
        for part in chunks(batches, 1, CHUNK):
            units, of_text = split_units(*text_bytes(part.column(1)))
            codes, names = coded(units)
            offsets, ids = tokens.encode(names)
            sizes = np.diff(offsets)[codes]
            before = np.concatenate([[0], np.cumsum(sizes)])
            flat = ids.astype("<u4")[gather(offsets[:-1][codes], sizes)]
            doc, piece, start, length, crc = [], [], [], [], []
            for k in range(part.num_rows):
                own = np.append(flat[before[of_text[k]] : before[of_text[k + 1]]], np.uint32(end_id))
                for i, at in enumerate(range(0, len(own), capacity)):
                    cut = own[at : at + capacity]
                    doc.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
            columns = [
                part.column(0).take(pa.array(doc, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


@dataclass
class Bins:
    """Open sequences: their contents, and which of them have how much room."""

    capacity: int
    members: list[list[int]] = field(default_factory=list)
    by_room: dict[int, list[int]] = field(default_factory=dict)
    rooms: int = 0  # bit r is set if some sequence has room r

    def put_back(self, sequence: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(sequence)
            self.rooms |= 1 << room

    def best(self, length: int) -> tuple[int, int] | None:
        """Take out the sequence with the least room that holds ``length``."""
        left = self.rooms >> length
        if not left:
            return None
        room = length + (left & -left).bit_length() - 1
        waiting = self.by_room[room]
        sequence = waiting.pop()
        if not waiting:
            self.rooms &= ~(1 << room)
        return sequence, room

    def add(self, item: int, length: int) -> None:
        found = self.best(length)
        if found is None:
            self.members.append([])
            found = len(self.members) - 1, self.capacity
        self.members[found[0]].append(item)
        self.put_back(found[0], found[1] - length)


def configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many pieces of each size: one of the largest left, the rest filled as far as a bounded knapsack can."""
    first = next(i for i, n in enumerate(left) if n)
    take = [0] * len(sizes)
    take[first] = 1
    room = capacity - sizes[first]
    reach, steps = 1, []  # bit s of reach: a total of s can be formed
    for i in range(first, len(sizes)):
        for _ in range(min(left[i] - take[i], room // sizes[i])):
            more = reach | (reach << sizes[i]) & ((1 << room + 1) - 1)
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
    total = reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> total & 1:
            take[i] += 1
            total -= sizes[i]
    return take


def pack(lengths: np.ndarray, capacity: int, groups: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    bins = Bins(capacity)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > capacity // 4]
    parts = [p for p in np.array_split(large, min(groups, len(large))) if len(p)] if len(large) else []
    sizes, queues = [int(lengths[p[0]]) for p in parts], [list(map(int, p[::-1])) for p in parts]
    left = [len(q) for q in queues]
    while any(left):
        take = configuration(sizes, left, capacity)
        for _ in range(min(left[i] // n for i, n in enumerate(take) if n)):
            own = [queues[i].pop() for i, n in enumerate(take) for _ in range(n)]
            bins.members.append(own)
            bins.put_back(len(bins.members) - 1, capacity - int(lengths[own].sum()))
            for i, n in enumerate(take):
                left[i] -= n
    for item in order[len(large) :]:
        bins.add(int(item), int(lengths[item]))
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for s, own in enumerate(bins.members):
        at = np.cumsum(lengths[own])
        sequence[own], offset[own] = s, at - lengths[own]
    return sequence, offset


def _packed(capacity: int, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        used, held, rows = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal used, held, rows
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sequence, offset = pack(table.column(3).to_numpy(zero_copy_only=False), capacity)
            out = [*table.columns, pa.array(sequence + base + used), pa.array(offset)]
            used += int(sequence.max()) + 1
            held, rows = [], 0
            return pa.RecordBatch.from_arrays(out, names=[*table.schema.names, "sequence_id", "offset"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 2 * shard:
                yield flush()
        if rows:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    file: str = "word_bpe_49k.json",
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard: int = 50_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(1, round(docs.count() / shard))
    pieces = texts.mapInArrow(frugal(_pieces(file, end_id, capacity)), PIECE)
    return pieces.repartition(shards).mapInArrow(frugal(_packed(capacity, shard)), f"{PIECE}, sequence_id bigint, offset bigint")
