"""How the given tables play the roles of jobs, entities, scores and ranges.

job = nation, entity = customer, criterion scores = orders per priority,
deal-breaker = negative balance, years = balance in thousands. Every frame has its
SQL twin as a WITH fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions import labels
from rankmill.operators.scoring import weighted_total
from rankmill.sources.tables import table

CRITERIA = {
    "1-URGENT": ("urgent", 30), "2-HIGH": ("high", 25), "3-MEDIUM": ("medium", 20),
    "4-NOT SPECIFIED": ("unspecified", 15), "5-LOW": ("low", 10),
}
SCORES = tuple(name for name, _ in CRITERIA.values())
WEIGHTS = tuple(w for _, w in CRITERIA.values())
BANDS = ((80.0, 100.0, 18000, 22000), (65.0, 79.0, 14000, 17999), (40.0, 64.0, 9000, 13999))


def order_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with five scores 0..10, null without such orders."""
    n = {
        name: F.count_if(F.col("o_orderpriority") == key) for key, (name, _) in CRITERIA.items()
    }
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(*[c.alias(k) for k, c in n.items()])
    return counted.select(
        F.col("o_custkey").alias("id"),
        *[F.when(F.col(k) > 0, F.least(F.lit(10), F.col(k) * 4)).alias(k) for k in n],
    )


def title_for(segment: Column) -> Column:
    return (
        F.when(segment == "BUILDING", "Senior Site Manager")
        .when(segment == "AUTOMOBILE", "Graduate Engineer")
        .when(segment == "MACHINERY", "Head of Machinery")
        .when(segment == "HOUSEHOLD", "n/a")
        .otherwise("Furniture Designer")
    )


def band_array() -> Column:
    return F.array(
        *[
            F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(c).alias("pay_low"), F.lit(e).alias("pay_high"))
            for a, b, c, e in BANDS
        ]
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ranked read model without its rank."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    nation = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("job"), "n_name", "r_name"
    )
    base = (
        c.withColumnsRenamed({"c_custkey": "id", "c_nationkey": "job"})
        .join(nation, "job", "left")
        .join(order_scores(spark, d), "id", "left")
    )
    breaker = F.col("c_acctbal") < 0
    scored = F.coalesce(*[F.col(s) for s in SCORES]).isNotNull()
    total = F.when(scored, weighted_total([F.col(s) for s in SCORES], WEIGHTS, breaker))
    nationality = (
        F.when(F.col("n_name") == "NATION_4", "n/a").when(F.col("n_name") == "NATION_7", None)
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lower("n_name")).otherwise(F.col("n_name"))
    )
    spoken = F.array_compact(
        F.array(
            F.when(F.col("urgent") > 0, "Arabic"), F.when(F.col("high") > 0, "English"),
            F.when(F.col("medium") > 0, "english"), F.when(F.col("low") > 0, "n/a"),
        )
    )
    # the total is a column of its own: everything derived from it reads the value
    base = base.withColumn("total", total)
    return base.select(
        "id", F.col("c_name").alias("name"), F.concat(F.lit("cv_"), "id", F.lit(".pdf")).alias("file_name"),
        "job", nationality.alias("nationality"), F.col("r_name").alias("location"),
        title_for(F.col("c_mktsegment")).alias("current_title"),
        F.when(F.col("c_acctbal") >= -500, F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 1000).alias("years"),
        "total", breaker.alias("deal_breaker"), labels.tier(F.col("total")).alias("recommendation"),
        F.concat(F.col("c_mktsegment"), F.lit(" track")).alias("strengths"),
        spoken.alias("languages"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        *SCORES,
    )


SCORES_SQL = """
os AS (
  SELECT o_custkey AS id,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS n1, count(*) FILTER (o_orderpriority = '2-HIGH') AS n2,
    count(*) FILTER (o_orderpriority = '3-MEDIUM') AS n3, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS n4,
    count(*) FILTER (o_orderpriority = '5-LOW') AS n5
  FROM orders GROUP BY o_custkey),
sc AS (
  SELECT id, CASE WHEN n1 > 0 THEN least(10, 4*n1) END AS urgent, CASE WHEN n2 > 0 THEN least(10, 4*n2) END AS high,
    CASE WHEN n3 > 0 THEN least(10, 4*n3) END AS medium, CASE WHEN n4 > 0 THEN least(10, 4*n4) END AS unspecified,
    CASE WHEN n5 > 0 THEN least(10, 4*n5) END AS low
  FROM os)"""

TIER_SQL = (
    "CASE WHEN {x} >= 80 THEN 'Strong candidate — recommend technical interview' "
    "WHEN {x} >= 65 THEN 'Good — conditional interview' WHEN {x} >= 50 THEN 'Average — reserve list' "
    "WHEN {x} IS NOT NULL THEN 'Not suitable at this time' END"
)

CAND_SQL = SCORES_SQL + """,
c0 AS (
  SELECT c.c_custkey AS id, c.c_name AS name, 'cv_' || c.c_custkey || '.pdf' AS file_name, c.c_nationkey AS job,
    CASE WHEN n_name = 'NATION_4' THEN 'n/a' WHEN n_name = 'NATION_7' THEN NULL
         WHEN c_mktsegment = 'AUTOMOBILE' THEN lower(n_name) ELSE n_name END AS nationality,
    r_name AS location,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Senior Site Manager' WHEN 'AUTOMOBILE' THEN 'Graduate Engineer'
      WHEN 'MACHINERY' THEN 'Head of Machinery' WHEN 'HOUSEHOLD' THEN 'n/a' ELSE 'Furniture Designer' END AS current_title,
    CASE WHEN c_acctbal >= -500 THEN greatest(c_acctbal, 0) / 1000 END AS years,
    CASE WHEN sc.id IS NULL THEN NULL WHEN c_acctbal < 0 THEN 0.0::DOUBLE
      ELSE (floor((coalesce(urgent,0)*30 + coalesce(high,0)*25 + coalesce(medium,0)*20 + coalesce(unspecified,0)*15
        + coalesce(low,0)*10)::DOUBLE * 100 / 100 + 0.5) / 10)::DOUBLE END AS total,
    c_acctbal < 0 AS deal_breaker, c_mktsegment || ' track' AS strengths,
    list_filter([CASE WHEN urgent > 0 THEN 'Arabic' END, CASE WHEN high > 0 THEN 'English' END,
      CASE WHEN medium > 0 THEN 'english' END, CASE WHEN low > 0 THEN 'n/a' END], lambda x: x IS NOT NULL) AS languages,
    c_mktsegment AS segment, c_acctbal AS balance, urgent, high, medium, unspecified, low
  FROM customer c LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN sc ON sc.id = c.c_custkey),
cand AS (SELECT *, """ + TIER_SQL.format(x="total") + """ AS recommendation FROM c0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY coalesce(total, -1) DESC, id) AS rank FROM cand),
shown AS (
  SELECT *, CASE WHEN current_title <> 'n/a' THEN current_title END AS title_shown, years AS years_shown,
    CASE WHEN nationality IS NULL OR nationality = 'n/a' THEN 'Not stated' ELSE nationality END AS nationality_shown,
    coalesce(location, 'Not stated') AS location_shown,
    CASE WHEN segment = 'BUILDING' THEN 'Supervisory' WHEN segment = 'AUTOMOBILE' THEN 'Junior'
      WHEN segment = 'MACHINERY' THEN 'Executive' WHEN years < 3 THEN 'Junior' WHEN years < 7 THEN 'Mid-level'
      WHEN years < 11 THEN 'Supervisory' WHEN years < 16 THEN 'Supervisory and leadership'
      WHEN years IS NOT NULL THEN 'Executive' ELSE 'Not stated' END AS seniority_shown
  FROM ranked)"""


def with_cand(body: str) -> str:
    return f"WITH {CAND_SQL}{body}"


# --- documents as parsed rows of a run ----------------------------------------
# parse status: near-empty texts need OCR, texts above a size limit are errors.
# stage: by label (1 scored, 0 failed, none pending), long pending ones are stopped.


def document_rows(spark: SparkSession, d: str) -> DataFrame:
    from rankmill.functions.text import near_empty

    docs, marks = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    parse = (
        F.when(near_empty(F.col("text")), "needs_ocr").when(F.col("n_chars") > 15000, "error").otherwise("parsed")
    )
    stage = (
        F.when(F.col("quality") == 1, "scored").when(F.col("quality") == 0, "failed")
        .when(F.col("n_chars") > 3000, "not_screened_time_budget").otherwise("pending")
    )
    error = (
        F.when(F.col("parse_status") == "needs_ocr", "Extracted text was nearly empty; this CV needs OCR")
        .when(F.col("parse_status") == "error", "File is larger than 15 MB")
        .when(F.col("stage_status") == "failed", "Turbo LLM failed; Pass A kept. timeout")
        .when((F.col("stage_status") == "not_screened_time_budget") & (F.col("lang") == "en"), "Stopped at the time budget")
        .when(F.col("stage_status") == "not_screened_time_budget", "Outside Pass A cap")
    )
    return (
        docs.join(marks, "doc_id", "left")
        .select("doc_id", "source", "lang", "n_chars", parse.alias("parse_status"), stage.alias("stage_status"))
        .withColumn("error", error)
    )


ROWS_SQL = """
drows AS (
  SELECT *, CASE WHEN parse_status = 'needs_ocr' THEN 'Extracted text was nearly empty; this CV needs OCR'
    WHEN parse_status = 'error' THEN 'File is larger than 15 MB'
    WHEN stage_status = 'failed' THEN 'Turbo LLM failed; Pass A kept. timeout'
    WHEN stage_status = 'not_screened_time_budget' AND lang = 'en' THEN 'Stopped at the time budget'
    WHEN stage_status = 'not_screened_time_budget' THEN 'Outside Pass A cap' END AS error
  FROM (SELECT d.doc_id, source, lang, n_chars,
    CASE WHEN length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) < 80 THEN 'needs_ocr'
      WHEN n_chars > 15000 THEN 'error' ELSE 'parsed' END AS parse_status,
    CASE WHEN quality = 1 THEN 'scored' WHEN quality = 0 THEN 'failed'
      WHEN n_chars > 3000 THEN 'not_screened_time_budget' ELSE 'pending' END AS stage_status
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


# --- date ranges ----------------------------------------------------------------
NOW_M = 2002 * 12 + 1


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """entity, pos, start_m, end_m, precise, evidence: one range per order."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    shipped = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))

    def month(c: str) -> Column:
        return (F.year(c) * 12 + F.month(c) - 1).cast("int")

    return o.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("pos"),
        month("o_orderdate").alias("start_m"), (month("shipped") + 1).alias("end_m"),
        (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("precise"),
        F.concat(F.lit("[CV p."), "o_orderkey", F.lit("]")).alias("evidence"),
    )


RANGES_SQL = """
rg AS (
  SELECT o_custkey AS entity, o_orderkey AS pos, (year(o_orderdate)*12 + month(o_orderdate) - 1)::INT AS start_m,
    (year(shipped)*12 + month(shipped))::INT AS end_m, o_orderpriority <> '4-NOT SPECIFIED' AS precise,
    '[CV p.' || o_orderkey || ']' AS evidence
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
ok AS (SELECT * FROM rg WHERE start_m < end_m AND end_m <= 24025)"""


# --- ratings: deduplicated line items ---------------------------------------------


def lines_once(spark: SparkSession, d: str) -> DataFrame:
    """One line per (order, line number): the smallest by a total order.

    Rows are dealt out first, so that only shuffled partitions are sorted and not whole scan splits as well.
    """
    key = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    return (
        table(spark, d, "lineitem").repartition("l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber").agg(F.min(key).alias("k"))
        .select("l_orderkey", "l_linenumber", "k.*")
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    def grade(x: Column) -> Column:
        return F.when(x >= 40, "A").when(x >= 30, "B").when(x >= 20, "C").when(x >= 10, "D").otherwise("E")

    second = F.when(F.col("l_returnflag") != "N", grade(F.col("l_extendedprice") / 2000))
    return lines_once(spark, d).select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("criterion"),
        grade(F.col("l_quantity")).alias("grade1"), second.alias("grade2"),
    )


ONCE_SQL = """
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1)"""

RATINGS_SQL = ONCE_SQL + """,
rt AS (
  SELECT l_orderkey AS entity, l_linenumber AS criterion,
    CASE WHEN l_quantity >= 40 THEN 'A' WHEN l_quantity >= 30 THEN 'B' WHEN l_quantity >= 20 THEN 'C'
      WHEN l_quantity >= 10 THEN 'D' ELSE 'E' END AS grade1,
    CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_extendedprice/2000 >= 40 THEN 'A' WHEN l_extendedprice/2000 >= 30 THEN 'B'
      WHEN l_extendedprice/2000 >= 20 THEN 'C' WHEN l_extendedprice/2000 >= 10 THEN 'D' ELSE 'E' END AS grade2
  FROM once),
rp AS (
  SELECT *, CASE grade1 WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 ELSE 1 END AS p1,
    CASE grade2 WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'E' THEN 1 END AS p2 FROM rt),
rm AS (SELECT *, CASE WHEN p2 IS NULL THEN p1::DOUBLE ELSE (p1 + p2) / 2.0::DOUBLE END AS m FROM rp)"""
