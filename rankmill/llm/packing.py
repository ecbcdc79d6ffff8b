"""Hierarchical packing of token sequences into several context sizes.

Every document is cut into whole windows of the longest context, and what remains is
routed to the smallest tier that holds it. Tiers are packed from the longest: a window
starts with the longest piece of its tier, its gap takes the longest pieces that fit, its
own tier's first and then shorter tiers', and the last hole is closed by cutting
one piece. Windows are therefore full; full windows of the shorter tiers have
power-of-two lengths of their own and need no padding. Sequences are dealt to step groups of about
``STEP_TOKENS`` tokens, largest first to the emptiest group.

Packing runs inside the partitions of the scan, without a shuffle: a partition is
packed in buffers of ``BUFFER`` tokens and hands leftovers on to its next buffer; only the last leftovers of
a partition are cut to powers of two. Memory does not grow with a partition, and a hot
source or copy group is nothing special. A lost task packs the same rows again.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.tokens import worker_tokenizer

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048
BUFFER = 1 << 20  # tokens packed at a time
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "context_size long, step_group long"
)
Piece = tuple[int, int]  # place of the document in the buffer, start in the document


class Shelf:
    """Pieces by length, the longest not above a given length at hand."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def put(self, piece: Piece, length: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append(piece)
        self.tokens += length

    def take(self, at: int) -> tuple[Piece, int]:
        """A piece of the ``at``-th length in ascending order."""
        length = self.lengths[at]
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length]
            self.lengths.pop(at)
        self.tokens -= length
        return piece, length

    def fill(self, room: int) -> list[tuple[Piece, int]]:
        """Pieces for ``room`` tokens, all of it while there are tokens; at most one is cut."""
        window = []
        while room and self.lengths:
            at = bisect_right(self.lengths, room) - 1
            piece, length = self.take(max(at, 0))
            if length > room:
                self.put((piece[0], piece[1] + room), length - room)
                length = room
            window.append((piece, length))
            room -= length
        return window


def pack_shelf(shelf: Shelf, tiers: tuple[int, ...], last: bool) -> list[list[tuple[Piece, int]]]:
    """Windows from the shelf. Without ``last``, what cannot fill a window of its tier stays on the shelf."""
    windows = []
    for tier, below in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while shelf.tokens >= tier:
            at = bisect_right(shelf.lengths, tier) - 1  # a longer piece may wait for more tokens
            if at < 0 or shelf.lengths[at] <= below:
                break
            piece, length = shelf.take(at)
            windows.append([(piece, length), *shelf.fill(tier - length)])
    if last:  # powers of two for the rest
        while shelf.tokens:
            room = min(tiers[-1], 1 << (shelf.tokens.bit_length() - 1))
            windows.append(shelf.fill(room))
    return windows


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence: largest first, to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (tokens + sizes[i], g))
    return out


class Packer:
    """Packs the documents of one partition."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.sequence = self.group = partition << 36
        self.shelf = Shelf()
        self.docs: dict[int, tuple[int | None, bytes]] = {}
        self.whole: list[list[tuple[Piece, int]]] = []
        self.tokens = self.count = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, longest = len(ids) // 4, self.tiers[-1]
        self.docs[self.count] = (doc_id, ids)
        whole = n - n % longest
        self.whole += [[((self.count, at), longest)] for at in range(0, whole, longest)]
        if n > whole:
            self.shelf.put((self.count, whole), n - whole)
        self.count += 1
        self.tokens += n

    def flush(self, last: bool) -> pa.RecordBatch:
        windows = self.whole + pack_shelf(self.shelf, self.tiers, last)
        sizes = [sum(n for _, n in w) for w in windows]
        groups = step_groups(sizes, self.step_tokens)
        rows: list[tuple] = []
        for window, size, group in zip(windows, sizes, groups, strict=True):
            offset = 0
            for (doc, start), length in window:
                doc_id, ids = self.docs[doc]
                rows.append((
                    doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, self.sequence, offset,
                    size, self.group + group,
                ))
                offset += length
            self.sequence += 1
        self.group += max(groups, default=-1) + 1
        self.whole, self.tokens = [], self.shelf.tokens
        kept = {doc for pieces in self.shelf.by_length.values() for doc, _ in pieces}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: document, ids (little-endian uint32), place in the document and in its sequence.

    ``tiers`` are powers of two, ascending. Each document's ids end with ``end_id``; a null or empty text has that id
    alone, a null id packs like any other, repeated rows are packed each. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_tokenizer(tokenizer), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            texts = (text.as_py() for text in batch["text"])
            for doc_id, ids in zip(batch["doc"].to_pylist(), encoder.encode_all(texts), strict=True):
                packer.add(doc_id, ids + end)
                if packer.tokens >= BUFFER:
                    yield packer.flush(False)
        yield packer.flush(True)

    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, SCHEMA)
