"""Near-duplicate groups: b-bit MinHash, a multi-index Hamming join, exact confirmation.

A shingle set of similarity J to another agrees with it in each symbol of the
signature with probability J. ``SYMBOLS`` symbols are cut into ``CHUNKS`` chunks; two
signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have, by pigeonhole,
a chunk with at most ``ERRORS`` = 1 wrong symbol. Every signature is filed under each
chunk with each one symbol left out (all allowed chunk errors), so equal file keys find *all*
pairs below that distance. At J = 0.8 a pair exceeds it with probability 3e-6.

Nothing is emitted per pair of a group:

* equal sets fold into one document before anything is joined;
* per key only its first holder is linked with the others. Documents within the distance of
  a first holder form a family, and families are cut into blocks of about ``BLOCK``;
* the blocks of a large family first work by themselves, each beside the same ``HEADS`` members of the
  family, those that share most keys. Two documents that each join the first of these are one group;
  only documents that do not join it meet the other blocks;
* keys that span families are tested inside tasks (tiles of bounded size, two bits per
  symbol), and give (block, partner) rows only;
* blocks and partners meet once more with full signatures and full sets; a union-find per
  block keeps the confirmed links that join something, so links stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.llm.components import components
from rankmill.llm.shingles import MinHash, shingle_set
from rankmill.session import cut_lineage

CHUNKS, WIDTH = 20, 5
SYMBOLS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1  # one error a chunk allowed
BLOCK = 256  # documents of a block, on average
TILE = 1024  # holders of one key tested against as many at a time
HEADS = 16  # members of a large family that go to each of its blocks
PARTNERS = 2048  # partners of a block in one group of rows
PAIRS = 1 << 16  # pairs compared by one numpy call at most


def _sketches(size: int):
    kinds = {"doc": pa.int64(), "n": pa.int64(), "same": pa.binary(), "sig": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(SYMBOLS)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingle_set(text.as_py(), size)
                some = len(found) > 0
                rows.append((len(found), _digest(found) if some else None, hasher.signature(found).tobytes() if some else None))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, list(kinds.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc"], *arrays], list(kinds))

    return run


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """File keys of each signature: per chunk, one for each symbol left out."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch["sig"]), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
        for out in range(WIDTH):
            mixed = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out), sig.shape[:2])
            for i in range(WIDTH):
                if i != out:
                    mixed = (mixed ^ sig[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = mixed ^ (mixed >> np.uint64(31))
            keys[:, :, out] = mixed
        yield pd.DataFrame({"doc": batch["doc"], "keys": list(keys.reshape(len(sig), SYMBOLS).view(np.int64))})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First holders within the distance."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, SYMBOLS) for c in ("sig", "first_sig"))
            yield batch.loc[(a != b).sum(axis=1) <= DISTANCE, ["doc", "first"]]


def _low_bits(sigs: list[bytes]) -> list[bytes]:
    """Two bits a symbol: equal symbols have equal bits, so their distance is never larger."""
    low = (np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), SYMBOLS) & 3).astype(np.uint8)
    low = low.reshape(len(sigs), -1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return [x.tobytes() for x in low.sum(axis=2).astype(np.uint8)]


def _tagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"doc": batch["doc"], "tag": _low_bits(list(batch["sig"]))})


_DIFFERENT = np.array([sum((i >> s) & 3 != 0 for s in (0, 2, 4, 6)) for i in range(256)], np.uint8)


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal ``by`` values of sorted batches, each whole."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for c in by:
            v = batch[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.iloc[lo:hi]
            if held and any(held[-1][c].iloc[0] != part[c].iloc[0] for c in by):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host block, partner document) of holders of one key that may be within the distance."""
    out: set[tuple[str, int]] = set()
    for group in _groups(batches, ["key", "ta", "tb"]):
        tile, doc = group["tile"].to_numpy(), group["doc"].to_numpy()
        block, size = group["block"].to_numpy(), group["size"].to_numpy()
        family = group["family"].to_numpy()
        ta, tb = group["ta"].iloc[0], group["tb"].iloc[0]
        tags = np.frombuffer(b"".join(group["tag"]), np.uint8).reshape(len(group), -1)
        left, right = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            close = _DIFFERENT[tags[rows][:, None, :] ^ tags[right][None, :, :]].sum(axis=2, dtype=np.uint16) <= DISTANCE
            close &= family[rows][:, None] != family[right][None, :]
            for i, j in zip(*np.nonzero(close), strict=True):
                a, b = rows[i], right[j]
                if ta != tb or a < b:
                    if (size[a], block[b]) < (size[b], block[a]):
                        a, b = b, a
                    out.add((block[a], doc[b]))
        if len(out) > 100_000:
            yield pd.DataFrame(sorted(out), columns=["host", "doc"])
            out = set()
    yield pd.DataFrame(sorted(out), columns=["host", "doc"])


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"doc": batch["doc"], "shingles": [shingle_set(t, size).tobytes() for t in batch["text"]]}
            )

    return run


class _Block:
    """Members of one block with a union-find over them and the partner at hand."""

    def __init__(self, percent: int):
        self.percent = percent
        self.docs: list[int] = []
        self.sigs = np.empty((BLOCK, SYMBOLS), np.uint16)
        self.sets: list[np.ndarray] = []
        self.up: list[int] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, doc: int, sig: np.ndarray, shingles: np.ndarray, stay: bool) -> list[tuple[int, int]]:
        """Confirmed links of a document to the members, one for each group it joins."""
        n, links = len(self.docs), []
        if n:
            apart = (self.sigs[:n] != sig).sum(axis=1)
            done: set[int] = set()
            for i in np.argsort(apart, kind="stable"):
                if apart[i] > DISTANCE:
                    break
                if (r := self.root(i)) in done:
                    continue
                a, b = self.sets[i], shingles
                if 100 * min(len(a), len(b)) >= self.percent * max(len(a), len(b)):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * common >= self.percent * (len(a) + len(b) - common):
                        links.append((self.docs[i], doc))
                        done.add(r)
        if stay:
            if n == len(self.sigs):
                self.sigs = np.concatenate([self.sigs, np.empty_like(self.sigs)])
            self.docs.append(doc)
            self.sigs[n] = sig
            self.sets.append(shingles)
            self.up.append(n)
            for r in (done if n else ()):
                self.up[r] = n
        elif n and links:  # what a partner links is one group from now on
            first, *rest = done
            for r in rest:
                self.up[r] = first
        return links


def _links(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block, links = None, None, []
        for batch in batches:
            for host, salt, partner, doc, sig, shingles in batch[
                ["host", "salt", "partner", "doc", "sig", "shingles"]
            ].itertuples(index=False, name=None):
                if at != (host, salt):
                    at, block = (host, salt), _Block(percent)
                links += block.add(
                    doc, np.frombuffer(sig, np.uint16), np.frombuffer(shingles, np.uint64), stay=not partner
                )
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []

    return run


def _settled(percent: int):
    """Links inside each block of a large family, and ``(document, null)`` for members that do not join the first head."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["host"]):
            block, links, ids = _Block(percent), [], set(group["doc"][group["own"]])
            for doc, sig, shingles in group[["doc", "sig", "shingles"]].itertuples(index=False, name=None):
                links += block.add(doc, np.frombuffer(sig, np.uint16), np.frombuffer(shingles, np.uint64), stay=True)
            joined = {doc for i, doc in enumerate(block.docs) if block.root(i) == block.root(0)}
            rows = [*links, *((doc, None) for doc in sorted(ids - joined))]
            yield pd.DataFrame({"a": pd.array([a for a, _ in rows], "Int64"), "b": pd.array([b for _, b in rows], "Int64")})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    ``words``-word shingles; ``component_id`` is the smallest id reachable. A null, empty or blank text has no
    shingles and is its own component; so is a row without an id (null component, kept). Rows that
    repeat an id are one node: what either links is linked. An empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketches = cut_lineage(
        given.mapInArrow(_sketches(words), "doc long, n long, same binary, sig binary"), "sketches"
    )
    usable = sketches.where("doc IS NOT NULL AND same IS NOT NULL")
    same = usable.groupBy("same").agg(F.min("doc").alias("rep"))
    placed_rows = cut_lineage(sketches.join(same, "same", "left").select("doc", "n", "rep"), "reps")
    # one row for each distinct set: its smallest document
    sets = cut_lineage(usable.groupBy("same").agg(F.min_by(F.struct("doc", "sig"), "doc").alias("x")).select("x.*"), "sets")

    keys = sets.mapInPandas(_filed, "doc long, keys array<long>").select("doc", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last")
    shared = cut_lineage(keys.join(first.drop("last"), "key"), "shared")

    stars = shared.where("doc != first").select("doc", "first").distinct()
    stars = stars.join(sets, "doc").join(sets.select(F.col("doc").alias("first"), F.col("sig").alias("first_sig")), "first")
    near = stars.mapInPandas(_near, "doc long, first long").groupBy("doc").agg(F.min("first").alias("family"))
    held = shared.groupBy("doc").agg(F.count("*").alias("keys"))
    family = held.join(near, "doc", "left").select("doc", F.coalesce("family", "doc").alias("family"), "keys")
    family = cut_lineage(family, "families")
    count = family.groupBy("family").count()
    parts = F.ceil(F.col("count") / BLOCK)
    part = F.pmod(F.xxhash64("doc"), parts)
    blocks = family.join(count, "family").select("doc", "family", "keys", part.alias("part"), parts.alias("parts"))
    blocks = blocks.withColumn("block", F.concat_ws(":", "family", "part"))
    size = blocks.groupBy("block").agg(F.count("*").alias("size"))
    blocks = cut_lineage(blocks.join(size, "block"), "blocks")

    def full_sets(ids: DataFrame) -> DataFrame:
        return (
            given.join(ids.select("doc").distinct(), "doc", "left_semi")
            .mapInPandas(_sets(words), "doc long, shingles binary").join(sets, "doc")
        )

    # large families: each block with the heads, the members that share most keys, which come first
    large = blocks.where("parts > 1")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.col("keys").desc(), "doc"))
    heads = large.select("family", "doc", place.alias("turn")).where(F.col("turn") <= HEADS)
    beside = large.select("family", F.col("block").alias("host")).distinct().join(heads, "family").select("host", "doc", "turn", F.lit(False).alias("own"))
    members = large.select(F.col("block").alias("host"), "doc", F.lit(HEADS + 1).alias("turn"), F.lit(True).alias("own"))
    inside = members.unionByName(beside).groupBy("host", "doc").agg(F.min("turn").alias("turn"), F.max("own").alias("own"))
    settled = cut_lineage(
        inside.join(full_sets(inside), "doc").repartition("host").sortWithinPartitions("host", "turn", "doc")
        .mapInPandas(_settled(percent), "a long, b long"), "settled"
    )
    open_docs = settled.where("b IS NULL").select(F.col("a").alias("doc"))
    # what does not join meets the family's other blocks
    other = large.join(open_docs, "doc", "left_semi").select(
        "doc", "family", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("of")
    )
    kin = other.where("part != of").select(F.concat_ws(":", "family", "of").alias("host"), "doc")

    # keys whose holders lie in several families
    blocks = blocks.drop("part", "keys")
    placed = shared.select("key", "doc").join(blocks, "doc")
    spread = (
        placed.groupBy("key")
        .agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count("*").alias("holders"))
        .where("lo != hi")
        .select("key", F.ceil(F.col("holders") / TILE).alias("tiles"))
    )
    tags = sets.join(blocks.select("doc"), "doc", "left_semi").mapInPandas(_tagged, "doc long, tag binary")
    tiled = placed.join(spread, "key").withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")))
    tiled = tiled.join(tags, "doc").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select(
        "key", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "doc", "family", "block", "size", "tag"
    )
    meet = (
        tiled.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")
        .mapInPandas(_meetings, "host string, doc long").distinct()
    )
    meet = cut_lineage(meet.union(kin), "meetings")

    # blocks with several members or partners, with the partners after the members
    busy = meet.groupBy("host").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    members = (
        blocks.join(busy.withColumnRenamed("host", "block"), "block", "left")
        .where("size > 1 AND parts = 1 OR salts IS NOT NULL")
        .select(
            F.col("block").alias("host"), "doc",
            F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"),
        )
    )
    partners = meet.join(busy, "host").select("host", "doc", F.pmod(F.xxhash64("doc"), F.col("salts")).alias("salt"))
    rows = cut_lineage(
        members.withColumn("partner", F.lit(0)).unionByName(partners.withColumn("partner", F.lit(1))), "rows"
    )
    links = (
        rows.join(full_sets(rows), "doc").repartition("host", "salt").sortWithinPartitions("host", "salt", "partner", "doc")
        .mapInPandas(_links(percent), "a long, b long")
    )
    # an id of several texts is one node: its sets are linked
    held_by = placed_rows.where("doc IS NOT NULL AND rep IS NOT NULL").groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = held_by.where("a != b").select("doc", "a")
    own = placed_rows.join(several, "doc").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    joined = components(links.unionByName(settled.where("b IS NOT NULL")).unionByName(own), "a", "b")
    label = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    return (
        placed_rows.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"),
            (F.col("doc").isNull() | (F.col("doc") == label)).alias("kept"),
        )
    )
