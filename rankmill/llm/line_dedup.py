"""Lines that many documents share, as compressed keep bitmaps per document.

Native: lines become (hash, document, position) rows, are range-partitioned by hash and document
and sorted with position last, so the first occurrence in each document streams by
(a row whose predecessor has another hash or document). First occurrences are counted per hash,
combined before the shuffle; a line that a third of all documents hold is spread over many ranges.
The rows of frequent lines become 64-bit words of a bitmap; words without a dropped
line are left out. Texts do not travel: only hashes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

# fixed values: the blanks of the contract, as character codes 9-13 and 32
BLANKS = "".join(map(chr, [*range(9, 14), 32]))
UPPER, LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
WORD = 64  # lines in a word of the bitmap


def line_key(line: Column) -> Column:
    """Stripped line with A-Z lower-cased. ``lower`` is the faster way for pure ASCII."""
    core = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(core) == F.char_length(core), F.lower(core)).otherwise(F.translate(core, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """A row's identity: its id (its text's hash where the id is null), and the text's hash."""
    text = F.xxhash64(F.coalesce(text_col, F.lit("")))
    return [F.coalesce(F.col(id_col).cast("long"), text).alias("_doc"), text.alias("_of")]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(
    docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``_doc, _of, _dropped``: for each document that loses lines, its bitmap as sorted (word, bits), a set bit for a dropped line.

    A line is dropped when its key is not empty and is held by at least ``min_docs`` documents; with
    ``keep_first`` its first occurrence (smallest document, then position) stays. A null or empty text is one empty line
    and loses nothing; rows without an id are documents of their own; repeated rows share a bitmap.
    """
    # keys first: beside the generator they would be computed again for every line
    whole = docs.select(*row_key(id_col, text_col), lines_of(F.col(text_col)).alias("_lines"))
    lines = whole.select("_doc", "_of", F.posexplode("_lines").alias("_pos", "_line"))
    lines = lines.withColumn("_line", line_key(F.col("_line"))).where("_line != ''")
    # 128 bits: two seeds
    hashed = lines.select(
        F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), F.col("_line")).alias("_g"), "_doc", "_of", "_pos"
    )
    hashed = cut_lineage(hashed, "lines")
    ranged = hashed.repartitionByRange("_h", "_g", "_doc").sortWithinPartitions("_h", "_g", "_doc", "_pos")
    before = F.lag("_pos").over(Window.partitionBy("_h", "_g", "_doc").orderBy("_pos"))
    firsts = ranged.select("_h", "_g", "_doc", "_pos", before.isNull().alias("_first")).where("_first")
    stats = [F.count("*").alias("_n")]
    if keep_first:
        stats.append(F.min("_doc").alias("_keep"))
    frequent = firsts.groupBy("_h", "_g").agg(*stats).where(F.col("_n") >= min_docs)
    hit = hashed.join(frequent, ["_h", "_g"])
    if keep_first:
        # the first document keeps the line where it first has it
        home = hit.where("_doc = _keep").groupBy("_h", "_g").agg(F.min("_pos").alias("_at"))
        hit = hit.join(home, ["_h", "_g"]).where("_doc != _keep OR _pos != _at")
    words = hit.groupBy("_doc", "_of", F.floor(F.col("_pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, _pos % {WORD})")).alias("bits")
    )
    return words.groupBy("_doc", "_of").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("_dropped"))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with their bitmap in ``fresh("_dropped", docs.columns)`` (null: nothing is dropped)."""
    names = {c: fresh(c, docs.columns) for c in ("_doc", "_of", "_dropped")}
    doc, of = row_key(id_col, text_col)
    found = bitmaps.select(*[F.col(c).alias(n) for c, n in names.items()])
    keys = [names["_doc"], names["_of"]]
    return docs.withColumn(keys[0], doc).withColumn(keys[1], of).join(found, keys, "left").drop(*keys)


def kept_text(text_col: str = "text", dropped: str = "_dropped") -> Column:
    """The text without its dropped lines; the sorted words become one dense array, so the work is linear in the lines."""
    words, text = F.col(dropped), F.col(text_col)

    def run(word: Column, i: Column) -> Column:
        before = F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), word["word"] - before - 1), F.array(word["bits"]))

    def kept(dense: Column) -> Column:
        bits = lambda i: F.coalesce(F.get(dense, F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
        return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.getbit(bits(i), i % WORD) == 0), "\n")

    dense = F.flatten(F.transform(words, run))
    keep = F.get(F.transform(F.array(dense), kept), F.lit(0))  # a lambda's argument is computed once
    return F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(keep)


def n_dropped(dropped: str = "_dropped") -> Column:
    return F.expr(f"coalesce(aggregate({dropped}, 0L, (n, w) -> n + bit_count(w.bits)), 0L)")
