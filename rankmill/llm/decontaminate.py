"""Benchmark passages in documents: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are compared lower-cased with runs of white space as one blank. An item of m
characters may be matched with at most ``floor(rate * m)`` edits. It is split into one piece more than
that, so every match leaves at least one piece intact: an Aho-Corasick automaton finds exact
piece hits, and each hit's window is verified with the bit-parallel recurrence, whose bit vectors
are Python integers of m bits. Hits of one item on neighbouring diagonals share a window.

The benchmark is the bounded side: it is read in blocks of at most ``BLOCK_CHARS`` characters, and every block
passes over all documents inside the scan, without a shuffle. A larger benchmark means more
passes, never a larger automaton. Documents are read whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08  # edits for each character of an item
BLOCK_CHARS = 4_000_000
MATCHES = "doc_id long, item_id long, start long, end long, distance long"
NAMES = ["doc_id", "item_id", "start", "end", "distance"]
KINDS = [pa.int64()] * 5


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces with their places, as even as can be."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(item: str, text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the first best place of ``item`` in ``text`` with at most ``errors`` edits."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, None
    for at, c in enumerate(text):
        equal = places.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score <= errors and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for lo, piece in pieces_of(text, errors):
                found.setdefault(piece, []).append((n, lo))
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item_id -> (start, end, distance) of its best match, the first among equals."""
        text = plain(text)
        starts: dict[int, list[int]] = {}
        if text and len(self.automaton):
            for end, (length, places) in self.automaton.iter(text):
                for n, lo in places:
                    starts.setdefault(n, []).append(end + 1 - length - lo)
        out: dict[int, tuple[int, int, int]] = {}
        for n, diagonals in starts.items():
            item_id, item, errors = self.items[n]
            best = None
            for lo, hi in self._windows(sorted(set(diagonals)), errors):
                if lo == hi and lo >= 0 and text.startswith(item, lo):
                    match = (0, lo + len(item))
                else:
                    left = max(0, lo - errors)
                    match = best_match(item, text[left : hi + len(item) + errors], errors)
                    match = match and (match[0], match[1] + left)
                if match and (best is None or match < best):
                    best = match
            if best:
                distance, end = best
                known = out.get(item_id)
                if known is None or distance < known[2]:
                    out[item_id] = (self._start(item, text, end, distance, errors), end, distance)
        return out

    @staticmethod
    def _windows(diagonals: list[int], errors: int) -> Iterator[tuple[int, int]]:
        lo = hi = diagonals[0]
        for d in diagonals[1:]:
            if d - hi > 2 * errors:
                yield lo, hi
                lo = d
            hi = d
        yield lo, hi

    @staticmethod
    def _start(item: str, text: str, end: int, distance: int, errors: int) -> int:
        """Start of the match: the same search backwards from its end."""
        if distance == 0:
            return end - len(item)
        left = max(0, end - len(item) - errors)
        back = best_match(item[::-1], text[left:end][::-1], distance)
        return end - back[1] if back else left


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator(prefetchPartitions=False)
    block, chars = [], 0
    for item_id, text in rows:
        text = plain(text)
        if not text or item_id is None:
            continue
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    yield block


def matches(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per (document, item) found: ``doc_id, item_id, start, end, distance``.

    Places count code points of the lower-cased text with single blanks; the best match
    is returned, the first among equals. Null or blank items and texts match nothing, items without an id
    are left out, a null document id stays null, repeated rows are reported each. Empty tables give no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [
                    (doc.as_py(), item, *place)
                    for doc, text in zip(batch["doc"], batch["text"], strict=True)
                    for item, place in sorted(matcher.find(text.as_py()).items())
                ]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

        part = given.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionAll(part)
    return out


def without_matches(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; nothing is shuffled."""
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
