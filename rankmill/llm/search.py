"""Ranked lexical search, reversed: the items are the index and the documents stream through it.

The items are worked through in blocks of about ``BLOCK_CHARS`` characters, each its own pair of passes, so what is
broadcast has a fixed bound and the driver holds one block at a time. A block is an inverted index: for
each term the items that hold it, with repeats. The first pass counts documents, terms, and for each term of the
block the documents that hold it; a task adds up its own and hands on one row per term. The second
pass sends every document's term counts through the index and keeps the ``k`` best per item on heaps. Heaps leave a task
once, and meet in two steps: first within ``MERGES`` groups of tasks, then over all.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage, shared_folder

BLOCK_CHARS = 4_000_000  # of items worked on at once
MERGES = 64
# fixed rule: ASCII letters and digits and everything beyond ASCII make terms; only A-Z is lower-cased
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
HEAPS = "item_id long, doc_id long, score long, task long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, with repeats."""
    return text.translate(FOLD).split() if text else []


class Index:
    """Inverted index over the terms of one block of items."""

    def __init__(self, items: dict[int, Counter[bytes]]):
        self.ids = sorted(items)
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for at, item in enumerate(self.ids):
            for term, repeats in items[item].items():
                postings.setdefault(term, []).append((at, repeats))
        self.place = {t: i for i, t in enumerate(postings)}
        self.starts = np.cumsum([0, *map(len, postings.values())])
        flat = [p for own in postings.values() for p in own]
        self.items = np.array([p[0] for p in flat], np.int64)
        self.repeats = np.array([p[1] for p in flat], np.int64)

    def weighted(self, documents: int, df: dict[bytes, int]) -> None:
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in self.place], np.int64
        )

    def matched(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Places of the known terms among ``words`` and their counts."""
        counts = Counter(words)
        known = self.place.keys() & counts.keys() if len(counts) < len(self.place) else counts.keys() & self.place.keys()
        return [self.place[t] for t in known], [counts[t] for t in known]

    def scores(self, places: list[int], tf: list[int], m: int) -> np.ndarray:
        """Score of the document for every item of the block."""
        at, n = np.array(places), np.array(tf, np.int64)
        part = self.weight[at] * ((1_000_000_000 * n) // (1000 * n + 8 * m))
        length = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(length)
        flat = np.repeat(self.starts[at] - (ends - length), length) + np.arange(ends[-1])
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.items[flat], np.repeat(part, length) * self.repeats[flat])
        return out


def _counted(docs: DataFrame, index: Index) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, all their terms, and for each term of the index the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, documents, total = shared.value.place, 0, 0
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                words = terms_of(text.as_py())
                documents, total = documents + bool(words), total + len(words)
                held.update(own.keys() & set(words))
        rows = [(None, documents, total), *((t, n, 0) for t, n in held.items())]
        columns = zip(*rows, strict=True)
        kinds = (pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["term", "n", "total"])

    parts = docs.select("text").mapInArrow(run, "term binary, n long, total long")
    sums = parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row per term of the block
    shared.destroy()
    whole = next(((r["n"], r["total"]) for r in sums if r["term"] is None), (0, 0))
    return *whole, {bytes(r["term"]): r["n"] for r in sums if r["term"] is not None}


def _streamed(docs: DataFrame, index: Index, documents: int, total: int, k: int, path: str) -> None:
    """Writes the k best documents of every item among those of each task."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in own.ids]
        least = np.ones(len(own.ids), np.int64)  # scores below do not enter
        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
                words = terms_of(text.as_py()) if doc is not None else []
                places, tf = own.matched(words)
                if not places:
                    continue
                scores = own.scores(places, tf, 25 + (75 * len(words) * documents) // total)
                for i in np.flatnonzero(scores >= least).tolist():
                    entry, heap = (int(scores[i]), -doc), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[i] = max(1, heap[0][0])
        rows = [(own.ids[i], -doc, score, TaskContext.get().partitionId()) for i, heap in enumerate(heaps) for score, doc in heap]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score", "task"])

    docs.select("doc", "text").mapInArrow(run, HEAPS).write.parquet(path)
    shared.destroy()


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("item_id", *keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item, by integer BM25 with score above 0.

    Equal scores rank by ascending id. Null and empty texts have no terms and no score; rows without an id count in the
    corpus statistics and take no rank. Rows that repeat an id are documents of their own; an item's terms are those of all its different
    texts, and items without an id are left out. Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    asked = items.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text")
    ).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_chars)
    asked = cut_lineage(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))), "items")
    folder, written = shared_folder(spark, "heaps"), []
    for block in range(blocks):
        terms: dict[int, Counter[bytes]] = {}
        for r in asked.where(F.col("block") == block).toLocalIterator():
            terms.setdefault(r["item"], Counter()).update(terms_of(bytes(r["text"])))
        index = Index({i: c for i, c in terms.items() if c})
        documents, total, df = _counted(docs, index) if index.ids else (0, 0, {})
        if total:
            index.weighted(documents, df)
            written.append(f"{folder}/{block}")
            _streamed(docs, index, documents, total, k, written[-1])
    found = spark.read.schema(HEAPS).parquet(*written) if written else spark.createDataFrame([], HEAPS)
    near = _best(found.withColumn("part", F.pmod("task", F.lit(MERGES))), k, "part").drop("rank")
    return _best(near, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
