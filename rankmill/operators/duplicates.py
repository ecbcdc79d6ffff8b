"""Exact and near duplicates without a document-by-document cross join.

A text is a near duplicate of an earlier one when the normalised texts are equal
or the Jaccard index of their word sets is above 0.85. The answer is one flag per
row, so its size never depends on how many copies a text has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions.arrays import bind
from rankmill.functions.text import ascii_digits, canonical_answer, canonical_hash, scrub
from rankmill.session import cut_lineage

# Jaccard > 17/20, kept as whole numbers so that no rounding can flip a pair.
NUM, DEN = 17, 20
# Sizes within a factor of 4/3 share the number of parts their words are dealt into.
BAND = math.log(4 / 3)
# Longs of the parity sketch that travels with each part of a set.
SKETCH = 4
# Holders of one part that one task meets; more are dealt out by the earlier set.
CROWD = 2000


def exact_groups(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """Groups of copies by canonical hash: size and first id, never the members."""
    scrubbed = docs.select(row_id, scrub(ascii_digits(F.col(text))).alias("_s"))
    return (
        scrubbed.select(canonical_hash(F.col("_s")).alias("hash"), row_id)
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id"))
        .where("n > 1")
    )


def word_set(normal: Column) -> Column:
    return F.sort_array(
        F.array_distinct(F.filter(F.split(normal, " "), lambda w: F.length(w) > 2))
    )


def jaccard_counts(left: Column, right: Column) -> Column:
    """Struct (common, joint) of two word sets."""
    return F.struct(
        F.size(F.array_intersect(left, right)).alias("common"),
        F.size(F.array_union(left, right)).alias("joint"),
    )


def _close(a: str, b: str) -> Column:
    """Exact test on two word-set columns: common/joint > 17/20."""
    common = F.size(F.array_intersect(F.col(a), F.col(b)))
    return common * (NUM + DEN) > (F.size(F.col(a)) + F.size(F.col(b))) * NUM


def _most_apart(total: Column) -> Column:
    """Most words that only one of two close sets holds, from the sum of their sizes."""
    return F.call_function("div", (DEN - NUM) * total - 1, F.lit(NUM + DEN)).cast("int")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / BAND).cast("int")


def _bands(n: Column) -> Column:
    """Own band of a size, and the one below where that holds a close size."""
    return F.sequence(_band(F.floor(n * NUM / DEN) + 1), _band(n))


def _hashes(words: Column) -> Column:
    """63-bit hashes of the words, in order."""
    return F.sort_array(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 1)))


def _longs(n: Column) -> Column:
    """Longs of the sketch of ``n`` words: a bit for two words at least, a power of two so that sketches fold."""
    doubled = F.ceil(F.log2(n / (128 * SKETCH))).cast("int")
    return F.call_function("shiftleft", F.lit(SKETCH), F.greatest(doubled, F.lit(0)))


def _sketch(hashes: Column, longs: Column) -> Column:
    """Parities of the words per hash bit. The sketches of two sets differ in no more bits than the sets do in words.

    Each long has an equal range of hashes, so one walk over the sorted hashes fills them in order.
    """
    none = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        at = F.shiftright(F.shiftright(x, 32) * longs, 31).cast("int")
        flip = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        same = at == acc["at"]
        bits = F.when(same, acc["bits"].bitwiseXOR(flip)).otherwise(flip)
        done = F.when(same, acc["done"]).otherwise(filled(acc, at))
        return F.struct(at.alias("at"), bits.alias("bits"), done.alias("done"))

    def filled(acc: Column, end: Column) -> Column:
        return F.concat(acc["done"], F.array(acc["bits"]), F.array_repeat(none, end - acc["at"] - 1))

    start = F.struct(F.lit(0).alias("at"), none.alias("bits"), F.array().cast("array<long>").alias("done"))
    return F.aggregate(hashes, start, step, lambda acc: filled(acc, longs))


def _folded(sketch: Column, longs: Column) -> Column:
    """The sketch of the same words in fewer longs."""
    share = F.call_function("div", F.size(sketch), longs).cast("int")
    fold = F.transform(
        F.sequence(F.lit(0), longs - 1),
        lambda i: F.aggregate(F.slice(sketch, i * share + 1, share), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)),
    )
    return F.when(share == 1, sketch).otherwise(fold)


def _flips(left: Column, right: Column) -> Column:
    """Bits in which two sketches differ, in the longs of the shorter one."""
    longs = F.least(F.size(left), F.size(right))
    differing = F.zip_with(_folded(left, longs), _folded(right, longs), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(differing, F.lit(0), lambda acc, x: acc + x)


def _part_keys(hashes: Column, n: Column) -> Column:
    """Keys of the parts by which a set of ``n`` words can meet every close one (see ``near_duplicate_flags``)."""
    def of_band(band: Column) -> Column:
        # partners of the own band may be larger, those of the band below are smaller
        largest = F.when(band == _band(n), F.floor((n * DEN - 1) / NUM)).otherwise(n)
        keep = _most_apart(n + largest) + 1
        top = F.exp((band + 1) * BAND) * (1 + DEN / NUM) * (DEN - NUM) / (NUM + DEN)
        parts = F.ceil(top * 1.1).cast("int") + 3
        return bind(F.struct(band.alias("band"), keep.alias("keep"), parts.alias("parts")), keys)

    def keys(scheme: Column) -> Column:
        part = F.transform(hashes, lambda x: F.shiftright(F.shiftright(x, 32) * scheme["parts"], 31))
        return bind(part, lambda p: bind(filled(p, scheme), lambda f: best(f, p, scheme)))

    def key(scheme: Column, part: Column, held: Column) -> Column:
        return F.struct((-F.size(held)).alias("size"), F.xxhash64(scheme["band"], part, held).alias("key"))

    def filled(p: Column, scheme: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(p, i) != F.get(p, i - 1)))
        return bind(
            starts,
            lambda st: F.transform(
                st, lambda i, k: key(scheme, F.get(p, i), F.slice(hashes, i + 1, F.coalesce(F.get(st, k + 1), n) - i))
            ),
        )

    def best(f: Column, p: Column, scheme: Column) -> Column:
        none = F.slice(hashes, 1, 0)
        every = F.sequence(F.lit(0).cast("long"), scheme["parts"].cast("long") - 1)
        empty = F.transform(F.array_except(every, p), lambda part: key(scheme, part, none))
        enough = F.when(F.size(f) < scheme["keep"], F.concat(f, empty)).otherwise(f)
        return F.transform(F.slice(F.sort_array(enough), F.lit(1), scheme["keep"]), lambda x: x["key"])

    close_sizes = _most_apart(n + F.floor((n * DEN - 1) / NUM)) > 0  # smaller sets are close to equal ones only
    return F.when(close_sizes, F.flatten(F.transform(_bands(n), of_band))).otherwise(F.array().cast("array<long>"))


def _may_be_close(left: str, right: str) -> Column:
    """Sizes and short sketches of two structs allow a close pair."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    flips = [F.bit_count(F.col(f"{left}.sketch{i}").bitwiseXOR(F.col(f"{right}.sketch{i}"))) for i in range(SKETCH)]
    return (F.least(n, m) * DEN > F.greatest(n, m) * NUM) & (sum(flips[1:], flips[0]) <= _most_apart(n + m))


def _still_close(left: str, right: str) -> Column:
    """Whole sketches of two structs allow a close pair."""
    flips = _flips(F.col(f"{left}.sketch"), F.col(f"{right}.sketch"))
    return flips <= _most_apart(F.col(f"{left}.n") + F.col(f"{right}.n"))


def _passing(pairs: DataFrame, values: DataFrame, test: Callable[[str, str], Column], label: str) -> DataFrame:
    """The pairs (rep, prior) whose ``values`` (id, value) pass. Only values of sets in a pair are moved."""
    ids = cut_lineage(pairs.select(F.explode(F.array("rep", "prior")).alias("id")).distinct(), f"{label}-ids")
    held = cut_lineage(values.join(ids, "id", "left_semi"), label)
    return (
        pairs.join(held.select(F.col("id").alias("rep"), F.col("value").alias("own")), "rep")
        .join(held.select(F.col("id").alias("prior"), F.col("value").alias("other")), "prior")
        .where(test("own", "other")).select("rep", "prior")
    )


def _tested(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """``rep`` of the pairs that are close. Words are moved only for pairs that the whole sketches leave."""
    pairs = cut_lineage(pairs.select("rep", "prior").distinct(), f"{label}-pairs")
    sketches = sets.select("id", F.struct("n", "sketch").alias("value"))
    left = cut_lineage(_passing(pairs, sketches, _still_close, f"{label}-sketches"), f"{label}-left")
    close = _passing(left, sets.select("id", F.col("words").alias("value")), _close, f"{label}-words")
    return cut_lineage(close.select("rep").distinct(), f"{label}-sets")


def near_duplicate_flags(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, is_duplicate): is there an earlier row that is equal or close?

    1. Copies fold to one row per distinct word set (the smallest id); every
       further copy is a duplicate at once. This removes hot groups of copies.
    2. Two sets with Jaccard > 0.85 differ in at most d = (3 (n + m) - 1) div 37 words. The words of a
       set are dealt into k > d parts by hash, k by size band; so at least k - d parts of a close pair are equal.
       A set keeps the d + 1 parts that hold most words (ties by hash): of the equal parts the
       one that comes first in this order is kept by both sets. It lies among the rows of one key.
    3. Each row of a key first meets the earliest set of that key. In a
       cluster of near copies this settles almost all sets in linear work.
    4. Sets still open meet the other earlier sets of their keys. Keys that more than ``CROWD`` sets
       hold are dealt out by the earlier set's id.

    Sizes and short sketches (see ``_sketch``) drop pairs inside the join; they tell sets of some hundred words apart. The
    pairs left meet the whole sketches, which grow with the sets; the exact test on the words decides the rest.
    """
    normal = docs.select(row_id, canonical_answer(F.col(text)).alias("normal"))
    sets = normal.select(row_id, word_set(F.col("normal")).alias("words"), F.sha2("normal", 256).alias("h"))
    # texts without words compare by their normalised form only
    key = F.when(F.size("words") > 0, F.sha2(F.array_join("words", " "), 256)).otherwise(F.col("h"))
    n = F.size("words")
    short = [f"sketch{i}" for i in range(SKETCH)]

    def sketches(sketch: Column) -> Column:
        folded = bind(_folded(sketch, F.lit(SKETCH)), lambda f: F.struct(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(short))))
        return F.struct(sketch.alias("whole"), folded.alias("short"))

    def hashed(h: Column) -> Column:
        whole = bind(_longs(n), lambda longs: _sketch(h, longs))
        return F.struct(bind(whole, sketches).alias("sketches"), _part_keys(h, n).alias("keys"))

    keyed = cut_lineage(
        sets.select(row_id, "words", key.alias("set_key"), n.alias("n"), F.when(n > 0, bind(_hashes(F.col("words")), hashed)).alias("p")).select(
            row_id, "words", "set_key", "n", F.col("p.sketches.whole").alias("sketch"), "p.sketches.short.*", "p.keys"
        ),
        "word-sets",
    )

    first = keyed.groupBy("set_key").agg(F.min(row_id).alias("rep"))
    light = keyed.drop("words", "sketch").where("n > 0")
    reps = light.join(first, (light["set_key"] == first["set_key"]) & (light[row_id] == first["rep"]), "left_semi")
    held = reps.select(
        F.struct(F.col(row_id).alias("rep"), "n", *short).alias("own"),
        F.explode("keys").alias("key"),
    )
    same = Window.partitionBy("key")
    led = held.withColumns({"holders": F.count(F.lit(1)).over(same), "leader": F.min("own").over(same)})
    led = led.where("own.rep > leader.rep").withColumn(
        "prior", F.when(_may_be_close("own", "leader"), F.col("leader.rep"))
    )
    # two holders have met; of more the others are still to meet
    met = cut_lineage(led.where("prior is not null or holders > 2").drop("leader"), "shared-parts")
    whole = keyed.select(F.col(row_id).alias("id"), "n", "sketch", "words")
    settled = _tested(met.where("prior is not null").select("own.rep", "prior"), whole, "led")

    parts = F.ceil((F.col("holders") - 1) / CROWD).cast("int")
    crowd = met.where("holders > 2").select("key", "own", F.col("own.rep").alias("rep"), parts.alias("parts"))
    earlier = crowd.select("key", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), F.col("own").alias("other"))
    looking = crowd.join(settled, "rep", "left_anti").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own"
    )
    candidates = looking.join(earlier, ["key", "part"]).where("other.rep < own.rep").where(_may_be_close("own", "other"))
    found = _tested(candidates.select("own.rep", F.col("other.rep").alias("prior")), whole, "open")

    close_reps = settled.unionByName(found).withColumn("close", F.lit(True))
    flags = first.join(close_reps, "rep", "left")
    return keyed.select(row_id, "set_key").join(flags, "set_key", "left").select(
        row_id,
        F.coalesce(F.col("close") | (F.col(row_id) > F.col("rep")), F.col(row_id) > F.col("rep"), F.lit(False)).alias("is_duplicate"),
    )
