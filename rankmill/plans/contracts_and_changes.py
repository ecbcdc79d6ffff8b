"""Contract reports, row changes, audit and incremental runs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rankmill.functions import text as tx
from rankmill.operators import changes, contracts
from rankmill.operators import json_contracts as jc
from rankmill.operators.contracts import outside, too_long, violations
from rankmill.plans.bindings import ROWS_SQL, candidates, document_rows, with_cand
from rankmill.plans.registry import query
from rankmill.sources.tables import table

# --- contracts: one report row per (key, broken rule) ------------------------------------------


@query("k01_row_contract", with_cand("""
 SELECT id, 'nationality_present' AS rule FROM cand WHERE nationality IS NULL UNION ALL SELECT id, 'years_present' FROM cand WHERE years IS NULL UNION ALL SELECT id, 'lists_filled' FROM cand WHERE len(languages) = 0
"""))
def k01(spark, d):
    return violations(
        candidates(spark, d), ["id"],
        {"nationality_present": F.col("nationality").isNull(), "years_present": F.col("years").isNull(), "lists_filled": F.size("languages") == 0},
    )


@query("k02_score_contract", """
WITH s AS (SELECT o_orderkey, o_orderpriority AS criterion, floor(o_totalprice)::BIGINT % 13 - 1 AS score FROM orders)
SELECT o_orderkey, 'criterion_known' AS rule FROM s WHERE criterion = '4-NOT SPECIFIED' UNION ALL SELECT o_orderkey, 'score_range' FROM s WHERE score < 0 OR score > 10
""")
def k02(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("criterion"), (F.floor("o_totalprice") % 13 - 1).alias("score"))
    return violations(
        s, ["o_orderkey"],
        {"criterion_known": ~F.col("criterion").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), "score_range": outside(F.col("score"), 0, 10)},
    )


@query("k03_compact_contract", """
WITH e AS (SELECT event_id, value / 40 AS score, event_type, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, 'score_whole' AS rule FROM e WHERE score <> floor(score) UNION ALL SELECT event_id, 'score_range' FROM e WHERE score > 10 UNION ALL SELECT event_id, 'flag_known' FROM e WHERE event_type IN ('error', 'view')
UNION ALL SELECT event_id, 'flags_max' FROM e WHERE k % 6 > 3 UNION ALL SELECT event_id, 'text_length' FROM e WHERE k > 90
""")
def k03(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select(
        "event_id", (F.col("value") / 40).alias("score"),
        F.array_repeat(F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).otherwise("overlap"), F.greatest(F.lit(1), k % 6)).alias("flags"),
        F.repeat(F.lit("x"), k + 30).alias("strengths"),
    )
    known = ("date_gap", "overlap", "summary_mismatch", "future_date", "missing_dates")
    return violations(
        e, ["event_id"],
        {
            "score_whole": contracts.not_whole(F.col("score")), "score_range": outside(F.col("score"), 0, 10),
            "flag_known": ~F.forall("flags", lambda f: f.isin(*known)), "flags_max": F.size("flags") > 3,
            "text_length": too_long(F.col("strengths"), 120),
        },
    )


@query("k04_weight_and_band_ranges", """
SELECT p_partkey, 'weight_not_negative' AS rule FROM part WHERE p_size - 5 < 0 UNION ALL SELECT p_partkey, 'band_score_range' FROM part WHERE p_size * 2.5 > 100 UNION ALL SELECT p_partkey, 'pay_not_negative' FROM part WHERE p_retailprice - 950 < 0
""")
def k04(spark, d):
    return violations(
        table(spark, d, "part"), ["p_partkey"],
        {"weight_not_negative": F.col("p_size") - 5 < 0, "band_score_range": outside(F.col("p_size") * 2.5, 0, 100), "pay_not_negative": F.col("p_retailprice") - 950 < 0},
    )


@query("k05_question_contract", """
WITH q AS (SELECT p_partkey, p_size, CASE p_type WHEN 'PROMO' THEN 'multiple_choice' WHEN 'LARGE' THEN 'case' WHEN 'SMALL' THEN 'calculation' WHEN 'ECONOMY' THEN 'true_false' ELSE 'identification' END AS t FROM part)
SELECT p_partkey, 'key_in_options' AS rule FROM q WHERE t IN ('multiple_choice', 'true_false') AND p_size > 30 UNION ALL SELECT p_partkey, 'options_unique' FROM q WHERE t = 'multiple_choice' AND p_size % 2 = 0
UNION ALL SELECT p_partkey, 'two_options' FROM q WHERE t = 'true_false' UNION ALL SELECT p_partkey, 'calculation_present' FROM q WHERE t = 'calculation' AND p_size < 10
UNION ALL SELECT p_partkey, 'rubric_total' FROM q WHERE t = 'case' AND p_size % 3 = 0 UNION ALL SELECT p_partkey, 'points_positive' FROM q WHERE p_size <= 1
""")
def k05(spark, d):
    size, kind = F.col("p_size"), F.col("p_type")
    q_type = F.when(kind == "PROMO", "multiple_choice").when(kind == "LARGE", "case").when(kind == "SMALL", "calculation").when(kind == "ECONOMY", "true_false").otherwise("identification")
    options = F.when(kind == "ECONOMY", F.array(F.lit("A"))).when(size % 2 == 0, F.array(F.lit("A"), F.lit("B"), F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    points = F.when(size <= 1, 0.0).otherwise(size.cast("double"))
    q = table(spark, d, "part").select(
        "p_partkey", q_type.alias("q_type"), options.alias("options"), F.when(size > 30, "C").otherwise("A").alias("correct"), points.alias("points"),
        F.array(points / 2, points / 2 + F.when(size % 3 == 0, 0.5).otherwise(0.0005)).alias("rubric_points"), (size >= 10).alias("has_calculation"),
    )
    return violations(q, ["p_partkey"], contracts.question_rules())


@query("k06_stated_result", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE abs(l_extendedprice * (1 - l_discount) - floor(l_extendedprice * (1 - l_discount) * 10) / 10) > 0.05
""")
def k06(spark, d):
    # the stated value is cut to one decimal; the tolerance is a parameter
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    stated = F.floor(net * 10) / 10
    return table(spark, d, "lineitem").where(F.abs(net - stated) > 0.05).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("k07_interview_contract", """
WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS dn, min(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS lo, max(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'criteria_complete' AS rule FROM g WHERE dn <> 7 UNION ALL SELECT l_orderkey, 'criteria_unique' FROM g WHERE n <> dn UNION ALL SELECT l_orderkey, 'same_rater_count' FROM g WHERE lo <> hi UNION ALL SELECT l_orderkey, 'one_or_two_raters' FROM g WHERE hi > 2
""")
def k07(spark, d):
    n = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("criterion"), n.alias("n_grades"))
    return contracts.interview_rules(rows, "l_orderkey", 7)


@query("k08_claim_contract", """
WITH c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Inference' WHEN 'de' THEN 'Guess' ELSE 'Evidence' END AS kind, text, CASE WHEN source = 'src3' THEN 'EXAM Q' WHEN source = 'src4' THEN NULL ELSE 'x' END AS bad, n_chars < 1000 AS unverified, source FROM documents)
SELECT doc_id, 'kind_known' AS rule FROM c WHERE kind = 'Guess' UNION ALL SELECT doc_id, 'text_filled' FROM c WHERE length(text) < 1 UNION ALL SELECT doc_id, 'evidence_tagged' FROM c WHERE source IN ('src3', 'src4')
UNION ALL SELECT doc_id, 'inference_verified' FROM c WHERE kind = 'Inference' AND unverified UNION ALL SELECT doc_id, 'status_known' FROM c WHERE source = 'src5'
""")
def k08(spark, d):
    src, lang = F.col("source"), F.col("lang")
    none = F.array().cast("array<string>")
    evidence = (
        F.when(src == "src3", F.array(F.lit("[CV]"), F.lit("[EXAM Q]"))).when(src == "src4", none)
        .otherwise(F.array(F.lit("[JD]"), F.concat(F.lit("[EXAM Q"), "n_chars", F.lit("]")), F.lit("[INTERVIEW #2]")))
    )
    c = table(spark, d, "documents").select(
        "doc_id", F.when(lang == "en", "Inference").when(lang == "de", "Guess").otherwise("Evidence").alias("kind"), F.col("text").alias("claim"), evidence.alias("evidence"),
        F.when(F.col("n_chars") < 1000, " \t").otherwise("ask").alias("verification"), F.when(src == "src5", "Maybe").otherwise("Not met").alias("status"),
    )
    return violations(c, ["doc_id"], contracts.claim_rules())


@query("k09_decision_contract", with_cand("""
 SELECT id, 'composite_range' AS rule FROM cand WHERE total IS NULL OR total + 5 > 100 UNION ALL SELECT id, 'outcome_known' FROM cand WHERE segment = 'FURNITURE' UNION ALL SELECT id, 'weights_positive' FROM cand WHERE coalesce(high, 0) + coalesce(low, 0) <= 0
 UNION ALL SELECT id, 'reason_required' FROM cand WHERE balance > 9000 AND segment <> 'BUILDING'
"""))
def k09(spark, d):
    outcome = F.when(F.col("segment") == "FURNITURE", "Perhaps").otherwise("Conditional hire")
    reason = F.when(F.col("segment") == "BUILDING", "needed on site").otherwise(" ")
    return violations(
        candidates(spark, d), ["id"],
        {
            "composite_range": outside(F.col("total") + 5, 0, 100), "outcome_known": ~outcome.isin("Hire", "Conditional hire", "Hold", "Reject"),
            "weights_positive": F.coalesce("high", F.lit(0)) + F.coalesce("low", F.lit(0)) <= 0,
            "reason_required": (F.col("balance") > 9000) & (F.length(tx.trim_ws(reason)) == 0),
        },
    )


@query("k10_job_contract", """
SELECT doc_id, 'description_length' AS rule FROM documents WHERE length(trim(text, E' \\n\\t\\r')) NOT BETWEEN 20 AND 20000 UNION ALL SELECT doc_id, 'title_length' FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 'scope_length' FROM documents WHERE source = 'src1'
""")
def k10(spark, d):
    title = F.when(F.col("lang") == "fr", "  x ").otherwise("Clerk")
    scope = F.when(F.col("source") == "src1", "").otherwise(F.col("source"))
    return violations(
        table(spark, d, "documents"), ["doc_id"],
        {
            "description_length": contracts.trimmed_outside(F.col("text"), 20, 20_000),
            "title_length": contracts.trimmed_outside(title, 2, 200), "scope_length": contracts.trimmed_outside(scope, 1, 200),
        },
    )


@query("k11_references_and_keys", """
SELECT 'orphan' AS rule, o_orderkey AS k1, 0 AS k2, 1 AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'repeated', l_orderkey, l_linenumber, count(*) FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1
""")
def k11(spark, d):
    lost = contracts.orphans(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")
    again = contracts.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return lost.select(F.lit("orphan").alias("rule"), F.col("o_orderkey").alias("k1"), F.lit(0).alias("k2"), F.lit(1).cast("long").alias("n")).unionByName(
        again.select(F.lit("repeated").alias("rule"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), "n")
    )


@query("k12_salary_reference_contract", """
SELECT page_id, 'source_https' AS rule FROM pages WHERE url NOT LIKE 'https://%' UNION ALL SELECT page_id, 'currency_code' FROM pages WHERE url LIKE '%/de/%' UNION ALL SELECT page_id, 'max_at_least_min' FROM pages WHERE 5000 < length(html)
UNION ALL SELECT page_id, 'confidence_known' FROM pages WHERE url LIKE '%?%' UNION ALL SELECT page_id, 'role_length' FROM pages WHERE length(url) > 80
""")
def k12(spark, d):
    has = lambda s: F.contains("url", F.lit(s))
    ref = table(spark, d, "pages").select(
        "page_id", F.col("url").alias("role_family"), F.length("html").alias("pay_min"), F.lit(5000).alias("pay_max"),
        F.when(has("/de/"), "eur").otherwise("EUR").alias("currency"), F.col("url").alias("source_url"), F.when(has("?"), "sure").otherwise("high").alias("confidence"),
    )
    return violations(ref, ["page_id"], contracts.salary_reference_rules())


# stored JSON: each customer's document is whole or breaks one rule; which, its id says. The rule
# names in the SQL are written out by hand, not taken from the schema.


def _documents(spark, d, whole: dict, cases: list[tuple[str, dict]]):
    """(c_custkey, body): case ``c_custkey % (cases + 1)`` of a document that bears the customer's name, the last one whole."""
    bodies = [json.dumps({k: v for k, v in (whole | change).items() if v is not MISSING}, ensure_ascii=False) for _, change in cases]
    every = F.array(*[F.lit(b) for b in [*bodies, json.dumps(whole, ensure_ascii=False)]])
    body = F.get(every, (F.col("c_custkey") % (len(cases) + 1)).cast("int"))
    # two short columns are dealt out, so that a file of few row groups is judged by every core
    customers = table(spark, d, "customer", 4 * spark.sparkContext.defaultParallelism)
    return customers.select("c_custkey", F.replace(body, F.lit("$NAME"), F.col("c_name")).alias("body"))


def cases_sql(cases: list[tuple[str, dict]]) -> str:
    names = ", ".join(f"'{rule}'" for rule, _ in cases)
    return f"SELECT c_custkey, ([{names}])[c_custkey % {len(cases) + 1} + 1] AS rule FROM customer WHERE c_custkey % {len(cases) + 1} < {len(cases)}"


MISSING = object()
ROW = {n: "$NAME" for n in jc.NULLABLE_TEXTS} | {"totalYearsExperience": 7.5, "nationality": None} | {n: ["a", "b"] for n in jc.TEXT_LISTS}
ROW_CASES = [
    ("fullName:type", {"fullName": 7}), ("nationality:type", {"nationality": MISSING}), ("currentLocation:type", {"currentLocation": True}),
    ("currentTitle:type", {"currentTitle": []}), ("lastEmployer:type", {"lastEmployer": {}}), ("specialization:type", {"specialization": 1.5}),
    ("education:type", {"education": MISSING}), ("totalExperienceText:type", {"totalExperienceText": 7}), ("totalYearsExperience:type", {"totalYearsExperience": "7"}),
    ("availabilityNotice:type", {"availabilityNotice": 7}), ("expectedSalary:type", {"expectedSalary": 100}), ("dataQualityNote:type", {"dataQualityNote": MISSING}),
    ("evidencePages:type", {"evidencePages": [1]}), ("phone:type", {"phone": 971}), ("email:type", {"email": MISSING}), ("linkedin:type", {"linkedin": False}),
    ("relevantExperienceText:type", {"relevantExperienceText": 2}), ("leadershipExperienceText:type", {"leadershipExperienceText": 2}), ("uaeExperienceText:type", {"uaeExperienceText": 2}),
    ("softwareSystems:type", {"softwareSystems": None}), ("technicalSkills:type", {"technicalSkills": "a; b"}), ("certifications:type", {"certifications": MISSING}),
    ("courses[]:type", {"courses": ["a", 1]}), ("languages[]:type", {"languages": ["$NAME", None]}), ("keyAchievements:type", {"keyAchievements": {}}),
    ("gaps[]:type", {"gaps": [["a"]]}), ("inconsistencies:type", {"inconsistencies": 0}),
]


@query("k01_candidate_contract", cases_sql(ROW_CASES))
def k01_candidate(spark, d):
    return jc.json_violations(_documents(spark, d, ROW, ROW_CASES), ["c_custkey"], "body", jc.CANDIDATE)


GOOD_SCORE = {"criterion": "leadership", "score": 10, "evidence": "$NAME"}
RESULT = {
    "scores": [GOOD_SCORE, GOOD_SCORE | {"score": 0}], "dealBreakerHit": False, "strengths": "$NAME", "risksAndGaps": "", "verificationPoints": ["ask"],
    "recommendationNarrative": "", "tier": "Good — conditional interview",
}
RESULT_CASES = [
    ("scores:type", {"scores": None}), ("scores[].criterion:enum", {"scores": [GOOD_SCORE, GOOD_SCORE | {"criterion": "charm"}]}), ("scores[].score:max", {"scores": [GOOD_SCORE | {"score": 10.5}]}),
    ("scores[].score:min", {"scores": [GOOD_SCORE | {"score": -1}]}), ("scores[].score:type", {"scores": [GOOD_SCORE | {"score": "9"}]}), ("scores[].evidence:type", {"scores": [{"criterion": "jobFit", "score": 1}]}),
    ("dealBreakerHit:type", {"dealBreakerHit": "no"}), ("strengths:type", {"strengths": None}), ("verificationPoints[]:type", {"verificationPoints": [1]}),
    ("recommendationNarrative:type", {"recommendationNarrative": MISSING}), ("tier:enum", {"tier": "Strong candidate"}), ("tier:type", {"tier": None}),
]


@query("k02_score_result_contract", cases_sql(RESULT_CASES))
def k02_result(spark, d):
    return jc.json_violations(_documents(spark, d, RESULT, RESULT_CASES), ["c_custkey"], "body", jc.SCORE)


STEP = {"id": "s1", "instruction": {"en": "$NAME", "ar": ""}, "points": 5, "evidence": ""}
PRACTICAL = {"system": "", "timeLimitMin": 30, "steps": [STEP]}
PLAN = {
    "level": "mid", "questionCount": 20, "durationMin": 45.5, "passMark": 60, "difficulty": {"easy": 0.2, "medium": 0.5, "hard": 0.3}, "includesCase": True,
    "topicWeights": {"$NAME": 2, "tax": 0.5}, "probes": ["p"], "uncoveredProbes": [], "practical": PRACTICAL,
}
PLAN_CASES = [
    ("level:enum", {"level": "boss"}), ("questionCount:whole", {"questionCount": 2.5}), ("questionCount:above", {"questionCount": 0}), ("durationMin:above", {"durationMin": -1}),
    ("passMark:max", {"passMark": 100.5}), ("passMark:min", {"passMark": -0.5}), ("difficulty.hard:type", {"difficulty": {"easy": 1, "medium": 1}}), ("difficulty:type", {"difficulty": MISSING} | {"difficulty": 3}),
    ("includesCase:type", {"includesCase": "yes"}), ("topicWeights{}:above", {"topicWeights": {"a": 1, "b": 0}}), ("topicWeights{}:type", {"topicWeights": {"a": "1"}}), ("probes[]:type", {"probes": [None]}),
    ("uncoveredProbes:type", {"uncoveredProbes": MISSING}), ("practical.steps:min_items", {"practical": PRACTICAL | {"steps": []}}), ("practical.steps[].instruction.en:min_length", {"practical": PRACTICAL | {"steps": [STEP | {"instruction": {"en": "", "ar": ""}}]}}),
    ("practical.steps[].points:above", {"practical": PRACTICAL | {"steps": [STEP, STEP | {"points": 0}]}}), ("practical.timeLimitMin:type", {"practical": PRACTICAL | {"timeLimitMin": None}}),
]


@query("k09_blueprint_contract", cases_sql(PLAN_CASES))
def k09_blueprint(spark, d):
    return jc.json_violations(_documents(spark, d, PLAN, PLAN_CASES), ["c_custkey"], "body", jc.BLUEPRINT)


RULED = {
    "compositeWeights": {"cv": 1, "exam": 0, "interview": 0}, "relevantExcludedItems": [2, 26], "relevanceReason": "$NAME", "blueprintOverrides": {"questionCount": 10}, "marketReference": {"text": "", "source": "s", "date": ""},
}
RULED_CASES = [
    ("compositeWeights.exam:min", {"compositeWeights": {"cv": 2, "exam": -1, "interview": 0}}), ("compositeWeights:sum", {"compositeWeights": {"cv": 0, "exam": 0, "interview": 0}}),
    ("relevantExcludedItems[]:enum", {"relevantExcludedItems": [4]}), ("relevanceReason:required", {"relevanceReason": " "}), ("blueprintOverrides.questionCount:min", {"blueprintOverrides": {"questionCount": 9}}),
    ("blueprintOverrides.questionCount:max", {"blueprintOverrides": {"questionCount": 101}}), ("blueprintOverrides.passMark:max", {"blueprintOverrides": {"passMark": 101}}), ("blueprintOverrides.durationMin:above", {"blueprintOverrides": {"durationMin": 0}}),
    ("marketReference.source:min_length", {"marketReference": {"text": "", "source": "", "date": ""}}), ("marketReference.date:type", {"marketReference": {"text": "", "source": "s"}}),
]


@query("k09_settings_contract", cases_sql(RULED_CASES))
def k09_settings(spark, d):
    return jc.json_violations(_documents(spark, d, RULED, RULED_CASES), ["c_custkey"], "body", jc.SETTINGS, jc.settings_rules())


GRADED = {"answers": {"q1": {"answer": "$NAME", "rubricScores": [1, 0]}, "q2": {"answer": "", "override": None}}, "practical": {"s1": {"points": 0, "evidence": "seen"}}, "durationMin": None, "confirmed": True}
GRADED_CASES = [
    ("answers{}.answer:type", {"answers": {"q1": {}}}), ("answers{}.rubricScores[]:min", {"answers": {"q1": {"answer": "", "rubricScores": [1, -1]}}}), ("answers{}.override:min", {"answers": {"q1": {"answer": "", "override": -2}}}),
    ("answers{}.overrideReason:type", {"answers": {"q1": {"answer": "", "overrideReason": None}}}), ("practical{}.points:min", {"practical": {"s1": {"points": -1, "evidence": "x"}}}), ("practical{}.evidence:min_length", {"practical": {"s1": {"points": 1, "evidence": ""}}}),
    ("durationMin:above", {"durationMin": 0}), ("durationMin:type", {"durationMin": MISSING}), ("confirmed:equals", {"confirmed": False}), ("answers:type", {"answers": []}),
]


@query("k09_grade_input_contract", cases_sql(GRADED_CASES))
def k09_grade(spark, d):
    return jc.json_violations(_documents(spark, d, GRADED, GRADED_CASES), ["c_custkey"], "body", jc.GRADE_INPUT)


SEEN = {"reference": "[CV]", "snippet": "$NAME", "confidence": "low"}
FOUND = {"fact": "$NAME", "evidence": [SEEN] * 8, "confidence": "high"}
FOUND_CASES = [
    ("fact:max_length", {"fact": "x" * 1801}), ("fact:type", {"fact": None}), ("evidence:max_items", {"evidence": [SEEN] * 9}), ("evidence[].reference:max_length", {"evidence": [SEEN | {"reference": "r" * 121}]}),
    ("evidence[].snippet:max_length", {"evidence": [SEEN, SEEN | {"snippet": "s" * 501}]}), ("evidence[].confidence:enum", {"evidence": [SEEN | {"confidence": "sure"}]}), ("confidence:enum", {"confidence": "sure"}),
    ("insufficientEvidence:type", {"insufficientEvidence": "no"}), ("evidence[].snippet:type", {"evidence": [{"reference": "", "confidence": "low"}]}),
]


@query("k12_finding_contract", cases_sql(FOUND_CASES))
def k12_finding(spark, d):
    return jc.json_violations(_documents(spark, d, FOUND, FOUND_CASES), ["c_custkey"], "body", jc.FINDING)


@query("h16_contact_validity", """
SELECT c_custkey, c_mktsegment <> 'BUILDING' AS email_ok, c_mktsegment <> 'MACHINERY' AS phone_ok, c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') AS url_ok FROM customer
""")
def h16(spark, d):
    seg = F.col("c_mktsegment")
    mail = F.when(seg == "BUILDING", "a b@c.d").when(seg == "FURNITURE", None).otherwise(F.concat("c_custkey", F.lit("@x.org")))
    phone = F.when(seg == "MACHINERY", "12-3").when(seg == "FURNITURE", "+٩٧١ ٥٠ ١٢٣٤٥٦٧").otherwise(F.concat(F.lit("+971 (50) "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    url = F.when(seg == "BUILDING", "http://linkedin.com/in/x").when(seg == "HOUSEHOLD", "https://linkedin.com/company/x").otherwise("https://www.LinkedIn.com/pub/x")
    return table(spark, d, "customer").select(
        "c_custkey", F.coalesce(tx.mail_ok(mail), F.lit(True)).alias("email_ok"), F.coalesce(tx.phone_ok(phone), F.lit(True)).alias("phone_ok"), F.coalesce(tx.profile_url_ok(url), F.lit(True)).alias("url_ok"),
    )


@query("h29_redacted_lists", """
SELECT c_custkey, 'met [REDACTED] and [REDACTED]|write to [EMAIL]|' || c_mktsegment AS skills FROM customer
""")
def h29(spark, d):
    items = F.array(F.concat(F.lit("met "), F.upper("c_name"), F.lit(" and "), "c_name"), F.lit("write to a.b@mail.org"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(tx.redact_values(items, [F.col("c_name"), F.lit(None).cast("string")]), "|").alias("skills"))


# --- row changes ----------------------------------------------------------------------------------


@query("m02_clone_rows", f"""
WITH {ROWS_SQL} SELECT doc_id, 'copy' AS job, parse_status, CASE WHEN parse_status = 'parsed' AND lang = 'en' THEN 'extracted' ELSE 'pending' END AS stage_status, CASE WHEN parse_status <> 'parsed' THEN error END AS error, NULL::DOUBLE AS total, NULL::DOUBLE AS relevance FROM drows
""")
def m02(spark, d):
    rows = document_rows(spark, d).withColumns({"job": F.col("source"), "has_profile": F.col("lang") == "en", "total": F.lit(50.0), "relevance": F.lit(10.0)})
    return changes.clone_rows(rows, "copy").select("doc_id", "job", "parse_status", "stage_status", "error", "total", "relevance")


@query("m03_reset_resumable", f"""
WITH {ROWS_SQL}, h AS (SELECT *, stage_status = 'not_screened_time_budget' AND coalesce(error, '') <> 'Outside Pass A cap' AS hit FROM drows)
SELECT doc_id, CASE WHEN hit THEN 'pending' ELSE stage_status END AS stage_status, CASE WHEN NOT hit THEN error END AS error, max(hit) OVER (PARTITION BY source) AS accepted FROM h
""")
def m03(spark, d):
    return changes.reset_resumable(document_rows(spark, d), "source").select("doc_id", "stage_status", "error", "accepted")


WANT = {"view": "queued", "signup": "approved", "click": "running", "purchase": "done", "error": "cancelled"}


def _some_unknown():
    """The event's user; every tenth event names a key nobody has."""
    return F.when(F.col("event_id") % 10 == 0, -F.col("event_id") - 1).otherwise(F.col("user_id"))


@query("m04_status_moves", """
WITH st AS (SELECT o_orderkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status FROM orders),
rq AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -event_id - 1 ELSE user_id END AS user_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'approved' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'cancelled' END AS wanted FROM events)
SELECT event_id, wanted, status, CASE WHEN status IS NULL THEN 'not_found' WHEN (status, wanted) IN (('queued','running'),('queued','cancelled'),('running','cancelled'),('running','done')) THEN 'accepted' ELSE 'not_allowed' END AS verdict FROM rq LEFT JOIN st USING (user_id)
""")
def m04(spark, d):
    o = table(spark, d, "orders")
    state = o.select(F.col("o_orderkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"))
    wanted = F.lit("cancelled")
    for event, want in WANT.items():
        wanted = F.when(F.col("event_type") == event, want).otherwise(wanted)
    requests = table(spark, d, "events").select("event_id", _some_unknown().alias("user_id"), wanted.alias("wanted"))
    return changes.status_moves(requests, state, "user_id").select("event_id", "wanted", "status", "verdict")


@query("m05_upsert_latest", """
WITH st AS (SELECT c_custkey AS user_id, c_mktsegment AS outcome, c_acctbal AS amount FROM customer),
l AS (SELECT CASE WHEN event_id % 10 = 0 THEN -event_id - 1 ELSE user_id END AS user_id, arg_max(event_type, (ts, event_id)) AS outcome, arg_max(value, (ts, event_id)) AS amount, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n IS NOT NULL THEN l.outcome ELSE st.outcome END AS outcome, CASE WHEN n IS NOT NULL THEN l.amount ELSE st.amount END AS amount, coalesce(n, 0) AS n_changes FROM st FULL OUTER JOIN l USING (user_id)
""")
def m05(spark, d):
    state = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("outcome"), F.col("c_acctbal").alias("amount"))
    new = table(spark, d, "events").select(_some_unknown().alias("user_id"), "ts", "event_id", F.col("event_type").alias("outcome"), F.col("value").alias("amount"))
    return changes.upsert_latest(state, new, "user_id", ["ts", "event_id"], ["outcome", "amount"])


@query("m05_audit_rows", """
SELECT event_id, user_id, lag('{"outcome":"' || event_type || '","event_id":' || event_id || '}') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_json, '{"outcome":"' || event_type || '","event_id":' || event_id || '}' AS after_json FROM events
""")
def m05_audit(spark, d):
    new = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("outcome"), F.date_trunc("minute", "ts").alias("minute"))
    return changes.audit_rows(new, "user_id", "minute", ["ts", "event_id"], ["outcome", "event_id"]).select("event_id", "user_id", "before_json", "after_json")


@query("m06_audit_log", "SELECT event_type AS entity_type, user_id AS entity_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL")
def m06(spark, d):
    from rankmill.session import shared_folder

    path = shared_folder(spark, "audit")
    log = table(spark, d, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), "event_id", "ts")
    # two appends, as two runs would do
    for part in ("event_type in ('view', 'click')", "event_type not in ('view', 'click')"):
        changes.append_audit(log.where(part.replace("event_type", "entity_type")), path)
    back = spark.read.schema("entity_id long, event_id long, ts timestamp_ntz, entity_type string").parquet(path)
    return back.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("m08_resume_unfinished", f"WITH {ROWS_SQL} SELECT doc_id, parse_status FROM drows WHERE doc_id NOT IN (SELECT doc_id FROM drows WHERE parse_status = 'parsed' AND stage_status IN ('scored', 'failed'))")
def m08(spark, d):
    rows = document_rows(spark, d)
    done = rows.where("parse_status = 'parsed' and stage_status in ('scored', 'failed')")
    return changes.unfinished(rows, done, "doc_id").select("doc_id", "parse_status")


@query("m09_failure_isolation", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract(props, '$.k')::INT END AS k, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'scored' END AS stage_status,
  CASE WHEN event_type = 'error' THEN 'Turbo LLM failed; Pass A kept. unreadable answer' END AS error FROM events
""")
def m09(spark, d):
    from rankmill.operators.tracking import FAIL_PREFIX

    body = F.when(F.col("event_type") == "error", F.concat(F.lit("<"), "props")).otherwise(F.col("props"))
    k = F.try_variant_get(F.try_parse_json(body), "$.k", "int")
    return table(spark, d, "events").select(
        "event_id", k.alias("k"), F.when(k.isNull(), "failed").otherwise("scored").alias("stage_status"),
        F.when(k.isNull(), f"{FAIL_PREFIX}unreadable answer").alias("error"),
    )
