"""The registered queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.ann import nearest
from rankmill.llm.decontaminate import matches
from rankmill.llm.licenses import file_licenses
from rankmill.llm.line_dedup import dropped_lines, kept_text, lines_of, n_dropped, with_bitmaps
from rankmill.llm.main_text import extract
from rankmill.llm.near_dedup import near_duplicates
from rankmill.llm.packing import pack
from rankmill.llm.pii import KINDS, listed, personal_data
from rankmill.llm.quality import quality
from rankmill.llm.search import search
from rankmill.llm.toxicity import toxicity
from rankmill.llm.warc import archive_pages
from rankmill.llm.whitening import whitened
from rankmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_near_dedup",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
        list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
      FROM w
    ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) + any_value(b.n) - count(*) AS u
          FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * u UNION SELECT b, a FROM p WHERE 100 * k >= 80 * u),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, b) AS component_id,
           doc_id = least(doc_id, b) AS kept
    FROM s LEFT JOIN c ON doc_id = a
    """,
)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at 4 words and 0.8, one row per document."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens; SQL has no tokenizer."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "context_size", "step_group",
    )


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with place and edit distance."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op6_line_dedup",
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
    k AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM l),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines held by ten documents or more leave every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs, dropped_lines(docs, 10)).select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), n_dropped().alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th vector, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, normalised, and read back by offset; DuckDB has no base32 digest."""
    return archive_pages(spark, table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; DuckDB's patterns give no places, so this is tested against brute force."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"size(filter(_base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans")
    )


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, filed as source/lang/block of 100 ids/id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100), "doc_id")
    found = file_licenses(docs.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along the 16 leading components; SQL has no eigenvectors."""
    return whitened(table(spark, sf_dir, "embeddings"))


@query("op12_main_text")
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the consensus of its host; SQL reads no markup."""
    return extract(table(spark, sf_dir, "pages"))


TERMS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_search",
    f"""
    WITH d AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
    a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, a GROUP BY term, docs),
    q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
    r AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY ALL),
    s AS (
      SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l)))) AS BIGINT) AS score
      FROM r JOIN t USING (term) JOIN f USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
)
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, among all."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
