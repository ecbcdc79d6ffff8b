"""Filters, facets, sorts, joins onto lists and export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions import labels
from rankmill.functions import text as tx
from rankmill.operators import changes, exports, filters, scoring, tracking
from rankmill.operators.filters import ViewFilters
from rankmill.operators.ranking import ranked, top_k
from rankmill.plans.bindings import (
    ROWS_SQL, SCORES, SCORES_SQL, TIER_SQL, band_array, candidates, document_rows, with_cand,
)
from rankmill.plans.registry import query
from rankmill.sources.tables import table


def _view(spark, d):
    return filters.with_view_columns(candidates(spark, d))


def _ranked_view(spark, d):
    return filters.with_view_columns(ranked(candidates(spark, d), ["job"], "total", "id"))


def _top15(spark, d):
    order = [F.coalesce("total", F.lit(-1.0)).desc(), F.col("id")]
    return top_k(candidates(spark, d).where("total is not null"), ["job"], order, 15)


# --- projections and filters ----------------------------------------------------------


@query("b01_scoring_columns", with_cand("SELECT id, location, current_title, years FROM cand"))
def b01(spark, d):
    # the profile carries a nationality, which must not reach scoring
    profile = candidates(spark, d).select("id", "nationality", "location", "current_title", "years")
    return scoring.assert_scoring_safe(scoring.allowed_for_scoring(profile))


@query("b02_forbidden_columns", with_cand("""
SELECT 'name' AS field, count(name) AS filled FROM cand UNION ALL SELECT 'nationality', count(nationality) FROM cand
"""))
def b02(spark, d):
    df = candidates(spark, d)
    found = scoring.forbidden_fields(df)
    counts = df.agg(*[F.count(c).alias(c) for c in found])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in found])).alias("r")
    ).select("r.field", "r.filled")


HAY_SQL = "lower(concat_ws(' ', name, file_name, title_shown, location_shown, nationality_shown, nullif(array_to_string(languages, ' '), ''), strengths))"


@query("b04_term_search", with_cand(f"SELECT id FROM shown WHERE contains({HAY_SQL}, 'asia') AND contains({HAY_SQL}, 'manager')"))
def b04(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(query="ASIA  manager")).select("id")


@query("b05_equal_ignoring_case", with_cand("SELECT id, nationality_shown FROM shown WHERE lower(nationality_shown) = 'nation_3'"))
def b05(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(nationality="Nation_3")).select("id", "nationality_shown")


@query("b06_class_filter", with_cand("SELECT id FROM shown WHERE seniority_shown = 'Supervisory'"))
def b06(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(seniority="Supervisory")).select("id")


@query("b07_array_member", with_cand("SELECT id FROM shown WHERE list_contains(languages, 'English') OR list_contains(languages, 'english')"))
def b07(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(language="ENGLISH")).select("id")


@query("b08_tier_filter", with_cand("SELECT id FROM shown WHERE recommendation = 'Good — conditional interview'"))
def b08(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(recommendation=labels.TIERS[1][1])).select("id")


@query("b09_minimum_score", with_cand("SELECT id FROM shown WHERE coalesce(total, -1) >= 72.5"))
def b09(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(min_score=72.5)).select("id")


@query("b10_hide_deal_breakers", with_cand("SELECT id FROM shown WHERE NOT deal_breaker"))
def b10(spark, d):
    return filters.apply_filters(_view(spark, d), ViewFilters(hide_deal_breakers=True)).select("id")


@query("b11_shortlist_only", with_cand("SELECT id, total FROM shown WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)"))
def b11(spark, d):
    picked = table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("id"))
    return filters.keep_ids(candidates(spark, d), picked, "id").select("id", "total")


@query("b12_interview_preset", with_cand("""
SELECT id, job, total FROM shown WHERE total >= 65 AND NOT deal_breaker
"""))
def b12(spark, d):
    preset = filters.INTERVIEW_PRESET
    assert preset.is_active()
    return filters.apply_filters(_view(spark, d), preset).select("id", "job", "total")


@query("b13_status_group", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND contains(lower(o_orderpriority), 'not') AND contains(lower(o_orderpriority), 'spec')
""")
def b13(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    terms = filters.terms_match(F.lower("o_orderpriority"), "NOT spec")
    return o.where(filters.status_in_group(status, "active") & terms).select("o_orderkey", "o_orderstatus")


@query("b14_status_split", f"""
WITH {ROWS_SQL} SELECT 'ranked' AS bucket, doc_id FROM drows WHERE parse_status = 'parsed'
UNION ALL SELECT 'unparsed', doc_id FROM drows WHERE parse_status IN ('needs_ocr', 'error') OR stage_status = 'failed'
UNION ALL SELECT 'not_screened', doc_id FROM drows WHERE stage_status = 'not_screened_time_budget'
""")
def b14(spark, d):
    buckets = F.array_compact(
        F.array(
            F.when(F.col("parse_status") == "parsed", "ranked"),
            F.when(F.col("parse_status").isin("needs_ocr", "error") | (F.col("stage_status") == "failed"), "unparsed"),
            F.when(F.col("stage_status") == tracking.STOPPED, "not_screened"),
        )
    )
    return document_rows(spark, d).select(F.explode(buckets).alias("bucket"), "doc_id")


FACET_FILTERS = ViewFilters(query="customer", nationality="Nation_3", seniority="Supervisory", language="english", min_score=50.0, hide_deal_breakers=True)
FACET_SQL = f"""
fl AS (SELECT *, contains({HAY_SQL}, 'customer') AND coalesce(total, -1) >= 50 AND NOT deal_breaker AS base, lower(nationality_shown) = 'nation_3' AS f1, seniority_shown = 'Supervisory' AS f2,
  list_contains(languages, 'English') OR list_contains(languages, 'english') AS f3 FROM shown),
fe AS (SELECT id, total, 'nationality' AS facet, nationality_shown AS value FROM fl WHERE base AND f2 AND f3
  UNION ALL SELECT id, total, 'seniority', seniority_shown FROM fl WHERE base AND f1 AND f3
  UNION ALL SELECT id, total, 'language', unnest(list_filter(languages, lambda x: x <> 'n/a')) FROM fl WHERE base AND f1 AND f2
  UNION ALL SELECT id, total, 'recommendation', recommendation FROM fl WHERE base AND f1 AND f2 AND f3 AND recommendation IS NOT NULL),
fc AS (SELECT facet, lower(value) AS k, count(*) AS n, arg_min(value, (-coalesce(total, -1), id, value)) AS v FROM fe GROUP BY ALL),
facets AS (SELECT facet, CASE WHEN facet = 'nationality' AND k = 'nation_3' THEN 'Nation_3' WHEN facet = 'language' AND k = 'english' THEN 'english' ELSE v END AS value, n FROM fc)"""


@query("d06_facet_counts", with_cand("," + FACET_SQL) + " SELECT facet, value, n FROM facets")
def d06(spark, d):
    return filters.facet_counts(_view(spark, d), FACET_FILTERS)


@query("d06_facet_counts_per_job", with_cand("""
, e AS (SELECT job, id, total, 'nationality' AS facet, nationality_shown AS value FROM shown UNION ALL SELECT job, id, total, 'seniority', seniority_shown FROM shown
  UNION ALL SELECT job, id, total, 'language', unnest(list_filter(languages, lambda x: x <> 'n/a')) FROM shown UNION ALL SELECT job, id, total, 'recommendation', recommendation FROM shown WHERE recommendation IS NOT NULL)
SELECT job, facet, arg_min(value, (-coalesce(total, -1), id, value)) AS value, count(*) AS n FROM e GROUP BY job, facet, lower(value)
"""))
def d06_per_job(spark, d):
    return filters.facet_counts(_view(spark, d), ViewFilters(), by=("job",))


@query("b17_facet_useful", with_cand("," + FACET_SQL) + " SELECT facet, max(value <> 'Not stated') AS useful FROM facets GROUP BY 1")
def b17(spark, d):
    return filters.facet_useful(filters.facet_counts(_view(spark, d), FACET_FILTERS))


@query("f05_facet_order", with_cand("," + FACET_SQL) + """
SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'seniority' THEN list_position(['Junior', 'Mid-level', 'Supervisory', 'Supervisory and leadership', 'Executive', 'Not stated'], value)
  WHEN facet = 'recommendation' THEN list_position(['Strong candidate — recommend technical interview', 'Good — conditional interview', 'Average — reserve list', 'Not suitable at this time'], value) ELSE 0 END,
  CASE WHEN facet NOT IN ('seniority', 'recommendation') THEN (value = 'Not stated')::INT END, CASE WHEN facet NOT IN ('seniority', 'recommendation') THEN -n END, lower(value)) AS place FROM facets
""")
def f05(spark, d):
    from pyspark.sql import Window

    facets = filters.facet_counts(_view(spark, d), FACET_FILTERS)
    keys = filters.facet_sort_key(F.col("facet"), F.col("value"), F.col("n"), by_count=True)
    # one row per facet value: a short list per facet
    return facets.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(*keys)))


# --- sorts: the whole list in each order; the id ends every key, so equal values spread
# over the sort ranges like any others ------------------------------------------------------


@query("f01_sort_by_name", with_cand("SELECT id, coalesce(name, file_name) AS shown_name FROM cand ORDER BY lower(coalesce(name, file_name)), id"))
def f01(spark, d):
    shown = F.coalesce("name", "file_name")
    return candidates(spark, d).select("id", shown.alias("shown_name")).orderBy(F.collate("shown_name", "UNICODE_CI_AI"), "id")


@query("f02_sort_by_years", with_cand("SELECT id, years FROM cand ORDER BY years DESC NULLS LAST, id"))
def f02(spark, d):
    return _view(spark, d).select("id", F.col("years_shown").alias("years")).orderBy(F.desc_nulls_last("years"), "id")


@query("f03_missing_last", with_cand("SELECT id, nationality_shown FROM shown ORDER BY nationality_shown = 'Not stated', lower(nationality_shown), id"))
def f03(spark, d):
    df = _view(spark, d).select("id", "nationality_shown")
    return df.orderBy(F.col("nationality_shown") == tx.NOT_STATED, F.collate("nationality_shown", "UNICODE_CI_AI"), "id")


@query("f04_keep_rank_order", with_cand("SELECT id, job, rank FROM ranked ORDER BY job, rank"))
def f04(spark, d):
    return ranked(candidates(spark, d), ["job"], "total", "id").select("id", "job", "rank").orderBy("job", "rank")


@query("f06_newest_first", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def f06(spark, d):
    o = table(spark, d, "orders")
    newest = o.select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return newest.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query("f07_head_limits", with_cand("SELECT id, array_to_string(languages[1:2], '; ') AS two FROM cand"))
def f07(spark, d):
    return candidates(spark, d).select("id", F.array_join(F.slice("languages", 1, 2), "; ").alias("two"))


# --- joins --------------------------------------------------------------------------------


@query("c01_parent_with_children", """
SELECT n_nationkey, n_name, count(c_custkey) AS children, coalesce(sum(c_acctbal::DECIMAL(18,2)), 0)::DOUBLE AS balance
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
""")
def c01(spark, d):
    # children fold to one row per parent before they meet it
    kids = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("children"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance")
    )
    return table(spark, d, "nation").join(kids, "n_nationkey", "left").select(
        "n_nationkey", "n_name", F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce("balance", F.lit(0)).cast("double").alias("balance"),
    )


@query("c02_rubric_onto_rows", f"""
WITH {SCORES_SQL}, rb AS (SELECT n_nationkey AS job, 30 + n_nationkey AS w1, 25 AS w2, 20 AS w3, CASE WHEN n_nationkey = 5 THEN -120 ELSE 15 END AS w4, 10 AS w5 FROM nation)
SELECT c_custkey AS id, job, CASE WHEN c_acctbal < 0 OR w1+w2+w3+w4+w5 <= 0 THEN 0.0 ELSE
  floor((coalesce(urgent,0)*w1 + coalesce(high,0)*w2 + coalesce(medium,0)*w3 + coalesce(unspecified,0)*w4 + coalesce(low,0)*w5)::DOUBLE * 100 / (w1+w2+w3+w4+w5) + 0.5) / 10 END::DOUBLE AS total
FROM customer JOIN rb ON c_nationkey = job LEFT JOIN sc ON sc.id = c_custkey
""")
def c02(spark, d):
    from rankmill.plans.bindings import order_scores

    rubrics = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("job"), (F.col("n_nationkey") + 30.0).alias("w1"),
        F.when(F.col("n_nationkey") == 5, -120.0).otherwise(15.0).alias("w4"),
    )
    weights = [F.col("w1"), 25.0, 20.0, F.col("w4"), 10.0]
    # no broadcast hint: Spark broadcasts the rubrics when their measured size allows
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("job"), "c_acctbal")
    joined = rows.join(rubrics, "job").join(order_scores(spark, d), "id", "left")
    total = scoring.weighted_total([F.col(s) for s in SCORES], weights, F.col("c_acctbal") < 0)
    return joined.select("id", "job", total.alias("total"))


@query("c03_first_matching_band", with_cand("""
SELECT id, CASE WHEN total BETWEEN 80 AND 100 THEN '18000–22000 AED/month. Indicative estimate, not an offer' WHEN total BETWEEN 65 AND 79 THEN '14000–17999 AED/month. Indicative estimate, not an offer'
  WHEN total BETWEEN 40 AND 64 THEN '9000–13999 AED/month. Indicative estimate, not an offer' ELSE 'Not set — add salary bands. Indicative estimate, not an offer' END AS salary FROM cand WHERE total IS NOT NULL
"""))
def c03(spark, d):
    rows = candidates(spark, d).where("total is not null")
    return rows.select("id", scoring.salary_for(F.col("total"), band_array()).alias("salary"))


@query("c10_fill_blank", with_cand("SELECT id, CASE WHEN nationality IS NULL OR nationality = 'n/a' THEN location ELSE nationality END AS nationality FROM cand"))
def c10(spark, d):
    # a blank, or the text null, is filled from the labelled value of the raw text
    stored = F.when(F.col("nationality") == "n/a", " NULL ").otherwise(F.col("nationality"))
    found = tx.labelled_nationality(F.concat(F.lit("x\nNationality: "), "location", F.lit(" | Visa: none")))
    blank = F.coalesce(F.lower(tx.trim_ws(stored)).isin("", "null"), F.lit(True))
    return candidates(spark, d).select("id", F.when(blank, F.coalesce(found, stored)).otherwise(stored).alias("nationality"))


@query("c11_contact_override", """
SELECT c_custkey AS id, CASE WHEN s_name IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NOT NULL THEN 'supplier-' || s_suppkey END AS phone
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def c11(spark, d):
    contact = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.concat(F.lit("supplier-"), "s_suppkey").alias("phone")
    )
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return rows.join(contact, "id", "left").select("id", F.coalesce("full_name", "c_name").alias("name"), "phone")


@query("c12_ordered_lookup", """
WITH req AS (SELECT unnest([7, 3, 99, 3, 21]) AS k, unnest([0, 1, 2, 3, 4]) AS pos) SELECT pos, n_nationkey, n_name, count(c_custkey) AS rows FROM req JOIN nation ON n_nationkey = k LEFT JOIN customer ON c_nationkey = k GROUP BY ALL
""")
def c12(spark, d):
    asked = F.posexplode(F.array(*[F.lit(k) for k in (7, 3, 99, 3, 21)])).alias("pos", "n_nationkey")
    request = spark.range(1).select(asked)
    held = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("rows"))
    return (
        request.join(table(spark, d, "nation"), "n_nationkey").join(held, "n_nationkey", "left")
        .select("pos", "n_nationkey", "n_name", F.coalesce("rows", F.lit(0)).alias("rows"))
    )


@query("c13_guarded_delete", """
WITH busy AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < -980),
ask AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2), gate AS (SELECT count(*) AS n FROM ask JOIN busy USING (k))
SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey IN (SELECT k FROM ask) AND (SELECT n FROM gate) = 0)
""")
def c13(spark, d):
    jobs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("job")).agg(
        F.when(F.min("c_acctbal") < -980, "running").otherwise("done").alias("status")
    )
    kids = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("job"))
    asked = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("job"))
    _, left = changes.delete_all_or_nothing(asked, jobs, kids, "job", ["queued", "running"])
    return left.withColumnRenamed("job", "c_nationkey")


@query("c14_dictionary", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'مبان' WHEN 'MACHINERY' THEN 'آلات' ELSE c_mktsegment END AS label FROM customer
""")
def c14(spark, d):
    words = spark.createDataFrame([("BUILDING", "مبان"), ("MACHINERY", "آلات")], "source string, target string")
    return exports.translated(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", words, "label").drop("c_mktsegment")


# --- exports --------------------------------------------------------------------------------


def _csv_cells():
    return [
        F.col("rank"), F.col("name"), F.col("file_name"), exports.number_text(F.col("total")), F.col("recommendation"),
        *[F.col(s) for s in SCORES], F.col("deal_breaker"), F.col("location"), F.col("shown_strengths"),
    ]


Q = "CASE WHEN regexp_matches({x}, '[\",\\n\\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
NUM = "CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


def q_(x: str) -> str:
    return Q.replace("{x}", x)


def num_(x: str) -> str:
    return NUM.replace("{x}", x)


@query("a10_results_csv", with_cand(f"""
, t AS (SELECT *, CASE WHEN deal_breaker THEN 'said "no", left' ELSE strengths END AS ss FROM ranked)
SELECT id, concat_ws(',', rank::VARCHAR, name, file_name, coalesce({num_('total')}, ''), coalesce(recommendation, ''), coalesce(urgent::VARCHAR, ''), coalesce(high::VARCHAR, ''), coalesce(medium::VARCHAR, ''),
  coalesce(unspecified::VARCHAR, ''), coalesce(low::VARCHAR, ''), deal_breaker::VARCHAR, coalesce(location, ''), {q_('ss')}) AS line FROM t
"""))
def a10(spark, d):
    rows = ranked(candidates(spark, d), ["job"], "total", "id").withColumn(
        "shown_strengths", F.when(F.col("deal_breaker"), 'said "no", left').otherwise(F.col("strengths"))
    )
    return rows.select("id", exports.csv_line(_csv_cells()).alias("line"))


@query("a11_view_csv", with_cand(f"""
SELECT id, concat_ws(',', rank::VARCHAR, name, file_name, nationality_shown, seniority_shown, coalesce({num_('years_shown')}, ''), location_shown, coalesce(title_shown, ''),
  coalesce({num_('total')}, ''), CASE WHEN total >= 80 THEN 'Strong' WHEN total >= 65 THEN 'Good' WHEN total >= 50 THEN 'Reserve' WHEN total IS NOT NULL THEN 'Not suitable' ELSE 'Not stated' END,
  CASE WHEN deal_breaker THEN 'Yes' ELSE 'No' END) AS line FROM shown WHERE NOT deal_breaker
"""))
def a11(spark, d):
    rows = filters.apply_filters(_ranked_view(spark, d), ViewFilters(hide_deal_breakers=True))
    cells = [
        F.col("rank"), F.col("name"), F.col("file_name"), F.col("nationality_shown"), F.col("seniority_shown"),
        exports.number_text(F.col("years_shown")), F.col("location_shown"), F.col("title_shown"),
        exports.number_text(F.col("total")), labels.tier_label(F.col("total")),
        F.when(F.col("deal_breaker"), "Yes").otherwise("No"),
    ]
    return rows.select("id", exports.csv_line(cells, quote_on_cr=False).alias("line"))


@query("a12_detail_sheet", with_cand("""
SELECT rank, name, coalesce(total, 0.0)::DOUBLE AS score, coalesce(recommendation, 'Not stated') AS recommendation, 'Not stated' AS phone, 'Not stated' AS email, 'Not stated' AS linkedin,
  coalesce(nationality, 'Not stated') AS nationality, coalesce(location, 'Not stated') AS current_location, current_title, 'Not stated' AS last_employer, 'Not stated' AS specialization, 'Not stated' AS education,
  'Not stated' AS total_experience, 'Not stated' AS relevant_experience, 'Not stated' AS leadership_experience, 'Not stated' AS uae_experience, 'Not stated' AS software, 'Not stated' AS technical_skills,
  'Not stated' AS certifications, 'Not stated' AS courses, coalesce(nullif(array_to_string(languages, '; '), ''), 'Not stated') AS languages, 'Not stated' AS key_achievements, strengths, 'Not stated' AS gaps,
  'Not stated' AS availability, 'Not stated' AS expected_salary,
  CASE WHEN total IS NULL THEN 'Not stated' WHEN total BETWEEN 80 AND 100 THEN '18000–22000 AED/month' WHEN total BETWEEN 65 AND 79 THEN '14000–17999 AED/month' WHEN total BETWEEN 40 AND 64 THEN '9000–13999 AED/month' ELSE 'Not set — add salary bands' END AS suggested_salary,
  'Not stated' AS data_quality, 'Not stated' AS evidence_pages, file_name FROM ranked
"""))
def a12(spark, d):
    rows = ranked(candidates(spark, d), ["job"], "total", "id").withColumn(
        "salary", F.when(F.col("total").isNotNull(), scoring.salary_for(F.col("total"), band_array()))
    )
    return exports.sheet(rows, exports.DETAIL_COLUMNS)


@query("a13_shortlist_sheet", with_cand("""
SELECT rank, name, total AS score, coalesce(location, 'Not stated') AS location, current_title, 'Not stated' AS phone, 'Not stated' AS email, 'Not stated' AS total_experience, 'Not stated' AS uae_experience, strengths,
  coalesce(nullif(array_to_string(languages, E'\n'), ''), 'Not stated') AS verification,
  CASE WHEN total BETWEEN 80 AND 100 THEN '18000–22000 AED/month' WHEN total BETWEEN 65 AND 79 THEN '14000–17999 AED/month' WHEN total BETWEEN 40 AND 64 THEN '9000–13999 AED/month' ELSE 'Not set — add salary bands' END AS suggested_salary,
  recommendation FROM ranked WHERE total IS NOT NULL AND rank <= 15
"""))
def a13(spark, d):
    rows = _top15(spark, d).withColumns(
        {"salary": scoring.salary_for(F.col("total"), band_array()), "verification": F.col("languages")}
    )
    return exports.sheet(rows, exports.SHORTLIST_COLUMNS)


@query("a14_run_summary", with_cand(f"""
, s AS (SELECT job, count(*) AS n, any_value(location) AS scope FROM cand GROUP BY 1),
rv AS (SELECT job, count(*) AS n FROM (SELECT job FROM cand UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1),
t AS (SELECT job, string_agg(name, '; ' ORDER BY rank) AS names FROM ranked WHERE total IS NOT NULL AND rank <= 15 GROUP BY 1)
SELECT job, unnest(['Role', 'Geographic scope', 'CVs reviewed', 'Scoring method', 'Initial top candidates', 'Notice', 'Privacy and fairness']) AS key,
  unnest(['Job ' || job, scope, rv.n::VARCHAR, 'urgent (30); high (25); medium (20); unspecified (15); low (10)', coalesce(names, 'Not stated'), '{exports.NOTICE}', '{exports.PRIVACY}']) AS value FROM s JOIN rv USING (job) LEFT JOIN t USING (job)
"""))
def a14(spark, d):
    rows = candidates(spark, d)
    # suppliers stand for the files that could not be parsed (in debt) or were not screened in time
    files = table(spark, d, "supplier").select(F.col("s_nationkey").alias("job"), (F.col("s_acctbal") < 0).alias("unparsed"))
    reviewed = exports.reviewed_counts("job", rows, files.where("unparsed"), files.where("NOT unparsed"))
    scopes = rows.groupBy("job").agg(F.max("location").alias("scope"))
    counts = scopes.join(reviewed.withColumnRenamed("reviewed", "n"), "job")
    # at most 15 names per job
    names = _top15(spark, d).groupBy("job").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]), "; ").alias("names")
    )
    method = "; ".join(f"{k} ({w})" for k, w in zip(SCORES, (30, 25, 20, 15, 10)))
    pairs = [
        ("Role", F.concat(F.lit("Job "), "job")), ("Geographic scope", tx.display_value(F.col("scope"))),
        ("CVs reviewed", F.col("n").cast("string")), ("Scoring method", F.lit(method)),
        ("Initial top candidates", tx.display_value(F.col("names"))), ("Notice", F.lit(exports.NOTICE)),
        ("Privacy and fairness", F.lit(exports.PRIVACY)),
    ]
    kv = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return counts.join(names, "job", "left").select("job", F.explode(kv).alias("r")).select("job", "r.key", "r.value")


# the generic questions of a sheet come from the caller
THEMES = tuple((t, f"Which facts and papers support: {t.lower()}?") for t in exports.CHECK_THEMES)


@query("a15_verification_sheet", with_cand("""
, g AS (SELECT unnest([""" + ", ".join(f"'{t}'" for t, _ in THEMES) + """]) AS theme, unnest([""" + ", ".join(f"'{q}'" for _, q in THEMES) + """]) AS question, unnest(range(1, """ + str(len(THEMES) + 1) + """)) AS place)
SELECT job, theme, question, place FROM (SELECT DISTINCT job FROM cand) CROSS JOIN g
UNION ALL SELECT job, name, coalesce(nullif(array_to_string(languages, E'\n'), ''), 'Not stated'), """ + str(len(THEMES)) + """ + rank FROM ranked WHERE total IS NOT NULL AND rank <= 15
"""))
def a15(spark, d):
    points = _top15(spark, d).withColumn("verification", F.col("languages"))
    return exports.verification_sheet(candidates(spark, d).select("job").distinct(), points, "job", THEMES)


def _skipped(spark, d):
    rows = document_rows(spark, d)
    unparsed = rows.where("parse_status in ('needs_ocr', 'error') or stage_status = 'failed'")
    return unparsed, rows.where(F.col("stage_status") == tracking.STOPPED)


CODE_SQL = """CASE error WHEN 'Extracted text was nearly empty; this CV needs OCR' THEN 'NEEDS_OCR' WHEN 'File is larger than 15 MB' THEN 'FILE_SIZE'
  WHEN 'Stopped at the time budget' THEN 'TIME_BUDGET' WHEN 'Outside Pass A cap' THEN 'PASS_A_CAP' ELSE CASE WHEN error IS NULL THEN 'Not stated' ELSE 'UNKNOWN' END END"""


@query("a16_not_screened_sheet", f"""
WITH {ROWS_SQL}, s AS (SELECT * FROM drows WHERE parse_status IN ('needs_ocr', 'error') OR stage_status = 'failed' UNION ALL SELECT * FROM drows WHERE stage_status = 'not_screened_time_budget')
SELECT 'doc_' || doc_id || '.pdf' AS file_name, CASE WHEN parse_status = 'parsed' THEN stage_status ELSE parse_status END AS status, {CODE_SQL} AS reason FROM s
""")
def a16(spark, d):
    rows = document_rows(spark, d).withColumn("file_name", F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")))
    return exports.not_screened_table(rows)


@query("s01_union_of_skipped", f"""
WITH {ROWS_SQL} SELECT doc_id, error FROM drows WHERE parse_status IN ('needs_ocr', 'error') OR stage_status = 'failed' UNION ALL SELECT doc_id, error FROM drows WHERE stage_status = 'not_screened_time_budget'
""")
def s01(spark, d):
    unparsed, stopped = _skipped(spark, d)
    return unparsed.unionByName(stopped).select("doc_id", "error")


@query("a17_multi_job_summary", with_cand("""
, req AS (SELECT unnest([12, 4, 77, 9]) AS job, unnest([0, 1, 2, 3]) AS pos),
t AS (SELECT pos, r.job, r.rank, r.name, r.total FROM req JOIN ranked r USING (job) WHERE total IS NOT NULL AND rank <= 15),
n AS (SELECT job, count(total) AS scored FROM cand GROUP BY 1),
j AS (SELECT pos, r_name AS scope, CASE WHEN n_regionkey % 2 = 0 THEN 'Full-time' ELSE 'Contract' END AS type, 'Level ' || n_nationkey % 3 AS level FROM req JOIN nation ON n_nationkey = job JOIN region ON r_regionkey = n_regionkey),
u AS (SELECT (SELECT string_agg(v, ' / ' ORDER BY p) FROM (SELECT scope AS v, min(pos) AS p FROM j GROUP BY 1)) AS scopes,
  (SELECT string_agg(v, ' / ' ORDER BY p) FROM (SELECT type AS v, min(pos) AS p FROM j GROUP BY 1)) AS types, (SELECT string_agg(v, ' / ' ORDER BY p) FROM (SELECT level AS v, min(pos) AS p FROM j GROUP BY 1)) AS levels)
SELECT pos, job, rank, name, total, scored, scopes, types, levels FROM t JOIN n USING (job) CROSS JOIN u
"""))
def a17(spark, d):
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in (12, 4, 77, 9)])).alias("pos", "job"))
    rows = candidates(spark, d).join(asked.select("job"), "job", "left_semi")
    scored = rows.groupBy("job").agg(F.count("total").alias("scored"))
    order = [F.coalesce("total", F.lit(-1.0)).desc(), F.col("id")]
    top = top_k(rows.where("total is not null"), ["job"], order, 15).join(asked, "job")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    jobs = asked.join(n, F.col("job") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "pos", F.col("r_name").alias("scopes"), F.when(F.col("n_regionkey") % 2 == 0, "Full-time").otherwise("Contract").alias("types"),
        F.concat(F.lit("Level "), F.col("n_nationkey") % 3).alias("levels"),
    )
    heading = exports.first_seen_join(jobs, ["scopes", "types", "levels"], "pos")
    page = top.join(scored, "job").select("pos", "job", "rank", "name", "total", "scored")
    every = heading.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(3))))  # the heading goes to each asked position
    return page.join(every, "pos")


@query("a18_shortlist_lines", with_cand(f"""
SELECT job, id, concat_ws(' | ', rank || '. ' || name, coalesce(title_shown, 'Title not stated'), nationality_shown, seniority_shown, coalesce({num_('years_shown')} || ' years', 'Years not stated'), coalesce({num_('total')}, 'No score'),
  CASE WHEN total >= 80 THEN 'Strong' WHEN total >= 65 THEN 'Good' WHEN total >= 50 THEN 'Reserve' ELSE 'Not suitable' END) AS line FROM shown WHERE total IS NOT NULL AND rank <= 15
"""))
def a18(spark, d):
    top = filters.with_view_columns(_top15(spark, d))
    return top.select("job", "id", exports.shortlist_line(top).alias("line"))


@query("d25_unique_join", """
SELECT r_name, string_agg(seg, ' / ' ORDER BY first_id) AS segments FROM (SELECT n_regionkey, c_mktsegment AS seg, min(c_custkey) AS first_id FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) JOIN region ON r_regionkey = n_regionkey GROUP BY 1
""")
def d25(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    # fold to distinct values before any list is built
    firsts = (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_id"))
    )
    lists = firsts.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("first_id", "c_mktsegment"))).alias("l"))
    return lists.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "r_name", exports.unique_join(F.transform("l", lambda x: x["c_mktsegment"])).alias("segments")
    )


@query("h17_cleaned_values", with_cand("SELECT id, title_shown, nationality_shown, location_shown, years_shown FROM shown"))
def h17(spark, d):
    return _view(spark, d).select("id", "title_shown", "nationality_shown", "location_shown", "years_shown")


@query("h18_seniority", with_cand("SELECT id, seniority_shown AS seniority FROM shown"))
def h18(spark, d):
    return _view(spark, d).select("id", F.col("seniority_shown").alias("seniority"))


@query("h19_tiers", with_cand("SELECT id, " + TIER_SQL.format(x="total") + """ AS tier,
  CASE WHEN total >= 80 THEN 'Strong' WHEN total >= 65 THEN 'Good' WHEN total >= 50 THEN 'Reserve' WHEN total IS NOT NULL THEN 'Not suitable' ELSE 'Not stated' END AS label FROM cand"""))
def h19(spark, d):
    t = F.col("total")
    return candidates(spark, d).select("id", labels.tier(t).alias("tier"), labels.tier_label(t).alias("label"))


@query("h21_display_values", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Not stated' ELSE c_mktsegment END AS shown, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Not stated' ELSE c_name || '; ' || c_mktsegment END AS listed, coalesce(strftime(latest, '%Y-%m-%d'), 'Not stated') AS stamp
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def h21(spark, d):
    seg = F.when(F.col("c_mktsegment") == "BUILDING", " \t ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    listed = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit(" "), F.lit(""))).otherwise(F.array("c_name", F.lit(" "), seg))
    latest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("latest"))
    return table(spark, d, "customer").join(latest, "c_custkey", "left").select(
        "c_custkey", tx.display_value(seg).alias("shown"), tx.join_list(listed).alias("listed"),
        tx.display_value(exports.date_stamp(F.col("latest"))).alias("stamp"),
    )


@query("h32_meta_line", with_cand(f"""
SELECT id, concat_ws(' · ', nullif(seniority_shown, 'Not stated'), nullif(nationality_shown, 'Not stated'), nullif(location_shown, 'Not stated'), {num_('years_shown')} || ' years') AS meta, coalesce(urgent::VARCHAR || '.0', '—') AS urgent_shown FROM shown
"""))
def h32(spark, d):
    v = _view(spark, d)
    return v.select("id", exports.meta_line(v).alias("meta"), exports.score_cell(F.col("urgent")).alias("urgent_shown"))
