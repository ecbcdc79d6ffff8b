"""Date ranges, grading, rater statistics and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions import labels
from rankmill.functions.numbers import percentage, round2
from rankmill.functions.text import canonical_answer
from rankmill.operators import decision, grading, intervals, raters
from rankmill.plans.bindings import NOW_M, ONCE_SQL, RANGES_SQL, RATINGS_SQL, candidates, lines_once, ranges, ratings, with_cand
from rankmill.plans.registry import query
from rankmill.sources.tables import pieces, table

# --- date ranges: entity = customer, one range per order ------------------------------------------


@query("e06_gaps", f"""
WITH {RANGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start_m, end_m, pos) AS i FROM ok),
p AS (SELECT *, max((end_m, -start_m, -pos)) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o),
f AS (SELECT p.*, r.end_m AS before_end, r.precise AS before_precise, r.evidence AS before_evidence FROM p JOIN ok r ON r.entity = p.entity AND r.pos = -p.b[3])
SELECT entity, start_m, start_m - before_end AS months, before_evidence AS evidence_before, evidence AS evidence_after FROM f WHERE start_m - before_end >= 3 AND precise AND before_precise
""")
def e06(spark, d):
    return intervals.gaps(ranges(spark, d), NOW_M)


@query("d24_covered_years", f"""
WITH {RANGES_SQL}, m AS (SELECT DISTINCT entity, unnest(range(start_m, end_m)) AS mo FROM ok)
SELECT entity, count(*) AS months, (floor(count(*) / 12.0::DOUBLE * 100 + 0.5) / 100)::DOUBLE AS years FROM m GROUP BY 1
""")
def d24(spark, d):
    return intervals.covered_years(ranges(spark, d), NOW_M)


@query("e07_range_anomalies", f"""
WITH {RANGES_SQL} SELECT pos, CASE WHEN start_m >= end_m THEN 'impossible_tenure' WHEN end_m > 24025 OR start_m >= 24025 THEN 'future_date' ELSE 'impossible_tenure' END AS code,
  CASE WHEN start_m >= end_m THEN start_m - end_m WHEN end_m > 24025 OR start_m >= 24025 THEN end_m - 24025 ELSE end_m - start_m END AS months FROM rg WHERE start_m >= end_m OR end_m > 24025 OR start_m >= 24025 OR end_m - start_m > 600
""")
def e07(spark, d):
    found = ranges(spark, d).select("pos", intervals.anomaly(F.col("start_m"), F.col("end_m"), NOW_M).alias("a"))
    return found.where("a is not null").select("pos", "a.code", "a.months")


@query("c05_overlaps", f"""
WITH {RANGES_SQL}, p AS (SELECT a.entity, least((a.start_m, a.end_m), (b.start_m, b.end_m)) AS x, greatest((a.start_m, a.end_m), (b.start_m, b.end_m)) AS y, least(a.end_m, b.end_m) - greatest(a.start_m, b.start_m) AS months
  FROM ok a JOIN ok b ON a.entity = b.entity AND a.pos < b.pos WHERE a.precise AND b.precise AND least(a.end_m, b.end_m) > greatest(a.start_m, b.start_m))
SELECT entity, x[1] AS a_start, x[2] AS a_end, y[1] AS b_start, y[2] AS b_end, months, count(*) AS n_pairs FROM p GROUP BY ALL
""")
def c05(spark, d):
    return intervals.overlaps(ranges(spark, d), NOW_M)


@query("c05_overlap_evidence", f"""
WITH {RANGES_SQL} SELECT a.entity, a.pos AS a_pos, b.pos AS b_pos, least(a.end_m, b.end_m) - greatest(a.start_m, b.start_m) AS months, a.evidence AS evidence_a, b.evidence AS evidence_b
  FROM ok a JOIN ok b ON a.entity = b.entity AND a.pos < b.pos WHERE a.precise AND b.precise AND least(a.end_m, b.end_m) > greatest(a.start_m, b.start_m)
""")
def c05_evidence(spark, d):
    return intervals.overlap_pairs(ranges(spark, d), NOW_M)


MON = "['Jan','FEB','mar','April','may','jun','July','aug','sept','Oct','november','dec']"


@query("h14_ranges_in_text", f"""
WITH {RANGES_SQL}, t AS (SELECT rg.*, o_orderpriority AS p FROM rg JOIN orders ON o_orderkey = pos)
SELECT pos, CASE WHEN p = '4-NOT SPECIFIED' THEN (start_m // 12) * 12 ELSE start_m END::INT AS start_m,
  CASE WHEN p = '4-NOT SPECIFIED' THEN ((end_m - 1) // 12) * 12 + 12 WHEN p = '3-MEDIUM' THEN 24025 ELSE end_m END::INT AS end_m,
  precise, CASE WHEN p = '5-LOW' THEN '[CV]' ELSE '[CV p.' || (pos % 3 + 1) || ']' END AS evidence FROM t
""")
def h14(spark, d):
    # a resume line per order, in one of five date styles
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("p"))
    rows = ranges(spark, d).join(o, "pos")
    names = F.array(*[F.lit(m) for m in ("Jan", "FEB", "mar", "April", "may", "jun", "July", "aug", "sept", "Oct", "november", "dec")])
    last = F.col("end_m") - 1

    def ym(m):
        return (F.floor(m / 12)).cast("int"), (m % 12 + 1).cast("int")

    (y1, m1), (y2, m2) = ym(F.col("start_m")), ym(last)
    line = (
        F.when(F.col("p") == "1-URGENT", F.concat(F.element_at(names, m1), F.lit(" "), y1, F.lit(" – "), F.element_at(names, m2), F.lit("  "), y2))
        .when(F.col("p") == "2-HIGH", F.concat(y1, F.lit("-"), F.lpad(m1.cast("string"), 2, "0"), F.lit(" to "), y2, F.lit("/"), m2))
        .when(F.col("p") == "3-MEDIUM", F.concat(m1, F.lit("/"), y1, F.lit(" - Present")))
        .when(F.col("p") == "4-NOT SPECIFIED", F.concat(y1, F.lit("-"), y2))
        .otherwise(F.translate(F.concat(y1, F.lit("/"), m1, F.lit(" حتى "), y2, F.lit("/"), m2), "0123456789", "٠١٢٣٤٥٦٧٨٩"))
    )
    page = F.when(F.col("p") != "5-LOW", F.concat(F.lit("[[PAGE "), F.col("pos") % 3 + 1, F.lit("]]\n"))).otherwise("")
    text = F.concat(page, F.lit("Acme trading, 13/2001 - 15/2002 is no date\nWorked "), line, F.lit(" as clerk\n"))
    found = rows.select("pos", F.explode(intervals.ranges_in_text(text, NOW_M - 1)).alias("r"))
    return found.select("pos", "r.start_m", "r.end_m", "r.precise", "r.evidence")


# --- grading: attempt = order, question = part, answer = line item ----------------------------------

ITEM_SQL = ONCE_SQL + """,
it AS (SELECT l_orderkey, l_linenumber, p_size::DOUBLE AS points, p_type AS topic, p_brand AS difficulty, l_returnflag AS flag, l_linestatus AS status,
  CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'case' ELSE 'identification' END AS q_type, l_quantity, l_discount FROM once JOIN part ON p_partkey = l_partkey),
im AS (SELECT *, CASE WHEN l_discount >= 0.09 AND l_quantity <= points THEN l_quantity WHEN flag = 'N' THEN 0.0 WHEN q_type = 'case' THEN floor(least(points, l_quantity) / 2) * 2 WHEN status = 'O' THEN points ELSE 0.0 END::DOUBLE AS earned FROM it),
items AS (SELECT *, CASE WHEN flag = 'N' THEN 'blank' WHEN earned = points THEN 'correct' WHEN earned = 0 THEN 'wrong' ELSE 'partial' END AS result FROM im)"""


def _items(spark, d):
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("points"), F.col("p_type").alias("topic"),
        F.col("p_brand").alias("difficulty"), F.when(F.col("p_type").isin("PROMO", "LARGE"), "case").otherwise("identification").alias("q_type"),
    )
    lines = lines_once(spark, d).join(parts, "l_partkey")
    # an answer in need of canonical form: blank, or the status letter with dressing
    answer = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.concat(F.lit(" "), F.lower("l_linestatus"), F.lit(". ")))
    half = F.floor(F.least("points", "l_quantity") / 2).cast("double")
    override = F.when((F.col("l_discount") >= 0.09) & (F.col("l_quantity") <= F.col("points")), F.col("l_quantity"))
    mark = grading.item_mark(
        canonical_answer(answer), F.col("q_type"), F.col("points"), F.array(F.lit("o"), F.lit("open")), F.array(half, half), override
    )
    return lines.select("l_orderkey", "l_linenumber", "topic", "difficulty", "q_type", F.col("points").alias("possible"), mark.alias("m")).select(
        "*", "m.earned", "m.result"
    ).drop("m")


@query("h34_item_marks", f"WITH {ITEM_SQL} SELECT l_orderkey, l_linenumber, earned, points AS possible, result FROM items")
def h34(spark, d):
    return _items(spark, d).select("l_orderkey", "l_linenumber", "earned", "possible", "result")


@query("h34_refused_marks", f"""
WITH {ITEM_SQL}, o AS (SELECT *, flag <> 'N' AND q_type = 'case' AS opened, l_discount >= 0.09 AS stated, l_quantity % 5 = 0 AS short, floor(least(points, l_quantity)) AS given FROM it)
SELECT l_orderkey, l_linenumber, 'rubric_confirmed' AS rule FROM o WHERE opened AND short UNION ALL SELECT l_orderkey, l_linenumber, 'rubric_maximum' FROM o WHERE opened AND given > points / 2
UNION ALL SELECT l_orderkey, l_linenumber, 'override_reason' FROM o WHERE stated AND status = 'O' UNION ALL SELECT l_orderkey, l_linenumber, 'override_maximum' FROM o WHERE stated AND l_quantity > points
""")
def h34_refused(spark, d):
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("points"),
        F.when(F.col("p_type").isin("PROMO", "LARGE"), "case").otherwise("identification").alias("q_type"),
    )
    half, given = F.col("points") / 2, F.floor(F.least("points", "l_quantity")).cast("double")
    lines = lines_once(spark, d).join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "q_type", "points", F.when(F.col("l_returnflag") == "N", " ").otherwise("x").alias("answer"),
        F.array(half, half).alias("rubric_maxima"), F.when(F.col("l_quantity") % 5 == 0, F.array(given)).otherwise(F.array(given, F.lit(0.0))).alias("rubric_points"),
        F.when(F.col("l_discount") >= 0.09, F.col("l_quantity")).alias("override"), F.when(F.col("l_linestatus") != "O", "checked by hand").alias("override_reason"),
    )
    return grading.mark_violations(lines, ["l_orderkey", "l_linenumber"])


@query("d11_test_totals", f"""
WITH {ITEM_SQL}, g AS (SELECT l_orderkey, sum(earned) AS raw_score, sum(points) AS max_score, count(*) FILTER (result = 'correct') AS correct_count, count(*) FILTER (result = 'wrong') AS wrong_count,
  count(*) FILTER (result = 'blank') AS blank_count, count(*) FILTER (result = 'partial') AS partial_count, min(points) AS lo, max(points) AS hi FROM items GROUP BY 1)
SELECT l_orderkey, raw_score, max_score, floor((100.0::DOUBLE * raw_score / max_score + 2.220446049250313e-16) * 100.0 + 0.5) / 100.0::DOUBLE AS percentage, raw_score * 100 >= max_score * 60 AS passed, correct_count, wrong_count, blank_count, partial_count,
  CASE WHEN lo = hi THEN ceil(max_score * 60.0::DOUBLE / 100 / lo)::BIGINT END AS answers_needed, greatest(0, floor((max_score * 60.0::DOUBLE / 100 - raw_score + 2.220446049250313e-16) * 100.0 + 0.5) / 100.0::DOUBLE)::DOUBLE AS points_needed FROM g
""")
def d11(spark, d):
    return grading.totals(_items(spark, d), "l_orderkey", 60.0)


@query("d12_score_groups", f"""
WITH {ITEM_SQL}, g AS (SELECT l_orderkey, CASE WHEN grouping(topic) = 0 THEN 'topic' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'type' END AS dimension, coalesce(topic, difficulty, q_type) AS member, sum(earned) AS earned, sum(points) AS possible
  FROM items GROUP BY GROUPING SETS ((l_orderkey, topic), (l_orderkey, difficulty), (l_orderkey, q_type)))
SELECT *, floor((100.0::DOUBLE * earned / possible + 2.220446049250313e-16) * 100.0 + 0.5) / 100.0::DOUBLE AS percentage FROM g
""")
def d12(spark, d):
    # every item becomes a row per dimension in the map of the aggregate, so the items of a task are bounded by number
    items = _items(spark, d).repartition(pieces(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    return grading.score_groups(items, "l_orderkey", {"topic": "topic", "difficulty": "difficulty", "type": "q_type"})


@query("d13_practical_score", """
WITH g AS (SELECT l_suppkey, sum(least(l_quantity, 40)) AS earned, count(*) * 40.0::DOUBLE AS possible FROM lineitem GROUP BY 1)
SELECT l_suppkey, earned::DOUBLE AS earned, possible, floor((100.0::DOUBLE * earned / possible + 2.220446049250313e-16) * 100.0 + 0.5) / 100.0::DOUBLE AS percentage FROM g
""")
def d13(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.least(F.col("l_quantity"), F.lit(40.0))).alias("earned"), (F.count(F.lit(1)) * 40.0).alias("possible")
    )
    return g.withColumn("percentage", percentage(F.col("earned"), F.col("possible")))


# line 7 of an order names a question or step that does not exist
ASKED_SQL = "CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END"


def _asked():
    return F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey"))


@query("c08_answers_to_questions", f"""
WITH a AS (SELECT {ASKED_SQL} AS question, count(*) AS n_answers, max(l_quantity) AS best FROM lineitem GROUP BY 1)
SELECT p_partkey AS question, coalesce(n_answers, 0) AS n_answers, best, false AS is_unknown FROM part LEFT JOIN a ON question = p_partkey
UNION ALL SELECT question, n_answers, best, true FROM a WHERE question NOT IN (SELECT p_partkey FROM part)
""")
def c08(spark, d):
    # answers fold to one row per question first, so a much-answered question is no hot key
    answers = table(spark, d, "lineitem").groupBy(_asked().alias("question")).agg(
        F.count(F.lit(1)).alias("n_answers"), F.max("l_quantity").alias("best")
    )
    questions = table(spark, d, "part").select(F.col("p_partkey").alias("question"), F.lit(True).alias("asked"))
    both = questions.join(answers, "question", "full_outer")
    return both.select("question", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "best", F.col("asked").isNull().alias("is_unknown"))


@query("c09_practical_steps", f"""
WITH r AS (SELECT {ASKED_SQL} AS rated_step, max(l_quantity) AS rated, count(*) AS n_ratings FROM lineitem GROUP BY 1), s AS (SELECT p_partkey, p_size + 10.0::DOUBLE AS allowed FROM part)
SELECT coalesce(rated_step, p_partkey) AS step, rated, n_ratings, allowed, CASE WHEN allowed IS NULL THEN 'unknown' WHEN rated IS NULL THEN 'missing' WHEN rated > allowed THEN 'over_limit' END AS violation FROM r FULL OUTER JOIN s ON rated_step = p_partkey
""")
def c09(spark, d):
    rated = table(spark, d, "lineitem").select(_asked().alias("step"), F.col("l_quantity").alias("points"))
    steps = table(spark, d, "part").select(F.col("p_partkey").alias("step"), (F.col("p_size") + 10.0).alias("points"))
    return grading.practical_check(rated, steps, "step")


# --- blueprints ------------------------------------------------------------------------------------

ALLOC_SQL = """
w AS (SELECT c_nationkey AS run, c_mktsegment AS item, count(*) AS weight, ascii(c_mktsegment[1]) * 1000 + ascii(c_mktsegment[2]) AS pos FROM customer GROUP BY 1, 2),
x AS (SELECT *, 45 * weight / (sum(weight) OVER (PARTITION BY run))::DOUBLE AS exact FROM w), y AS (SELECT *, floor(exact)::BIGINT AS fl FROM x),
z AS (SELECT *, 45 - sum(fl) OVER (PARTITION BY run) AS lft, row_number() OVER (PARTITION BY run ORDER BY exact - fl DESC, pos) AS turn FROM y),
al AS (SELECT run, item, weight, pos, (fl + CASE WHEN turn <= lft THEN 1 ELSE 0 END)::BIGINT AS n FROM z)"""


def _allocation(spark, d):
    weights = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("item")).agg(F.count(F.lit(1)).alias("weight"))
    pos = F.ascii("item") * 1000 + F.ascii(F.substring("item", 2, 1))
    return grading.allocate(weights.withColumn("pos", pos), ["run"], "item", 45)


@query("e08_largest_remainder", f"WITH {ALLOC_SQL} SELECT run, item, weight, n FROM al")
def e08(spark, d):
    return _allocation(spark, d).select("run", "item", "weight", "n")


@query("e09_positional_pairing", f"""
WITH {ALLOC_SQL}, t AS (SELECT run, item, row_number() OVER (PARTITION BY run ORDER BY pos, k) - 1 AS i FROM (SELECT run, item, pos, unnest(range(n)) AS k FROM al)),
dl AS (SELECT i, CASE WHEN i < 7 THEN 'easy' WHEN i < 27 THEN 'medium' ELSE 'hard' END AS difficulty FROM (SELECT unnest(range(45)) AS i))
SELECT run, i, item AS topic, difficulty, CASE WHEN i = 44 THEN 'case' WHEN i < 27 AND i % 8 = 0 THEN 'true_false' WHEN i < 27 THEN 'multiple_choice' WHEN i < 36 THEN 'identification' WHEN i % 3 = 0 THEN 'scenario' WHEN i % 3 = 1 THEN 'journal_entry' ELSE 'calculation' END AS q_type FROM t JOIN dl USING (i)
""")
def e09(spark, d):
    topics = grading.positions(_allocation(spark, d), ["run"], "item").withColumnRenamed("item", "topic")
    runs = table(spark, d, "customer").select(F.col("c_nationkey").alias("run")).distinct()
    shares = F.array(*[F.struct(F.lit(k).alias("difficulty"), F.lit(w).alias("weight"), F.lit(i).alias("pos")) for i, (k, w) in enumerate((("easy", 15), ("medium", 45), ("hard", 40)))])
    levels = runs.select("run", F.explode(shares).alias("s")).select("run", "s.*")
    hard = grading.positions(grading.allocate(levels, ["run"], "difficulty", 45), ["run"], "difficulty")
    return topics.join(hard, ["run", "i"]).select("run", "i", "topic", "difficulty", grading.question_type(F.col("i"), F.lit(45), F.lit(True)).alias("q_type"))


@query("d18_topic_weights", """
SELECT p_brand, topic, sum(w)::BIGINT AS weight FROM (SELECT p_brand, p_type AS topic, 2 AS w FROM part WHERE p_size >= 25 UNION ALL SELECT p_brand, p_type, 1 FROM part WHERE p_size < 25 AND p_size > 2 UNION ALL
  SELECT p_brand, 'Role fundamentals', 1 FROM part GROUP BY 1 HAVING max(p_size) <= 2) GROUP BY ALL
""")
def d18(spark, d):
    part = table(spark, d, "part")
    weight = F.when(F.col("p_size") >= 25, 2).when(F.col("p_size") > 2, 1)
    topics = part.where(weight.isNotNull()).groupBy("p_brand", F.col("p_type").alias("topic")).agg(F.sum(weight).alias("weight"))
    bare = part.groupBy("p_brand").agg(F.max("p_size").alias("m")).where("m <= 2").select("p_brand", F.lit("Role fundamentals").alias("topic"), F.lit(1).cast("long").alias("weight"))
    return topics.unionByName(bare)


PROBES = ("strengths", "current_title", "location", "segment", "nationality")


def _probe_lists():
    return [F.array(F.col("strengths"), F.col("location")), F.array_compact(F.array("current_title", "nationality")), F.array("location", "segment"), F.col("languages"), F.array("segment", F.lit("gap"))]


P_SQL = """
u AS (SELECT id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT id, list_concat(list_concat(list_concat([strengths, location], list_filter([current_title, nationality], lambda x: x IS NOT NULL)), list_concat([location, segment], languages)), [segment, 'gap']) AS l FROM cand)),
f AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS k FROM u GROUP BY id, x)"""


@query("e10_probe_split", with_cand("," + P_SQL + " SELECT id, string_agg(x, '|' ORDER BY k) FILTER (k <= 3) AS kept, coalesce(string_agg(x, '|' ORDER BY k) FILTER (k > 3), '') AS uncovered FROM f GROUP BY 1"))
def e10(spark, d):
    split = grading.probe_split(_probe_lists(), 15)
    return candidates(spark, d).select("id", split.alias("p")).select("id", F.array_join("p.kept", "|").alias("kept"), F.array_join("p.uncovered", "|").alias("uncovered"))


@query("s04_distinct_probes", with_cand("," + P_SQL + " SELECT id, string_agg(x, '|' ORDER BY k) AS probes FROM f GROUP BY 1"))
def s04(spark, d):
    return candidates(spark, d).select("id", F.array_join(F.array_distinct(F.concat(*_probe_lists())), "|").alias("probes"))


@query("h15_title_level", """
SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'lead' WHEN contains(p_name, 'small') THEN 'senior' WHEN contains(p_name, 'blue') THEN 'junior' ELSE 'mid' END AS level,
  CASE WHEN contains(p_name, 'red') OR p_size >= 40 THEN 'lead' WHEN p_size >= 24 THEN 'senior' WHEN p_size >= 12 THEN 'mid' ELSE 'junior' END AS test_level FROM part
""")
def h15(spark, d):
    title = (
        F.when(F.contains("p_name", F.lit("red")), "Managing Director").when(F.contains("p_name", F.lit("small")), "SENIOR clerk")
        .when(F.contains("p_name", F.lit("blue")), "Trainee clerk").otherwise("clerk")
    )
    return table(spark, d, "part").select("p_partkey", labels.title_level(title).alias("level"), labels.test_level(F.col("p_size") / 4.0, title).alias("test_level"))


# --- raters: entity = order, criterion = line number ----------------------------------------------

EXCLUDED = (2, 3, 6)
CLUSTERS = {"conduct": (1, 2, 3), "technical": (4, 5), "physical": (6,), "learning": (7,)}
R2 = "floor(({x} + 2.220446049250313e-16) * 100.0 + 0.5) / 100.0::DOUBLE"


def r2(x: str) -> str:
    return R2.replace("{x}", x)


@query("d14_interview_totals", f"""
WITH {RATINGS_SQL}, g AS (SELECT entity, sum(p1)::BIGINT AS total1, sum(p2)::BIGINT AS total2, avg(m) AS raw, coalesce(avg(m) FILTER (criterion NOT IN (2,3,6)), 0.0::DOUBLE) AS ov FROM rm GROUP BY 1)
SELECT entity, total1, total2, {r2('total1 / 7.0::DOUBLE')} AS average1, {r2('total2 / 7.0::DOUBLE')} AS average2, {r2('raw')} AS raw_average, {r2('ov')} AS overall_average, {r2('100.0::DOUBLE * raw / 5.0')} AS raw_percentage, {r2('100.0::DOUBLE * ov / 5.0')} AS percentage,
  CASE WHEN ov >= 4.5 THEN 'Excellent' WHEN ov >= 3.5 THEN 'Very Good' WHEN ov >= 2.5 THEN 'Good' WHEN ov >= 1.5 THEN 'Average' ELSE 'Poor' END AS band FROM g
""")
def d14(spark, d):
    return raters.interview_totals(ratings(spark, d), "entity", 7, EXCLUDED)


@query("d15_cluster_means", f"""
WITH {RATINGS_SQL} SELECT entity, {r2('avg(m) FILTER (criterion = 1)')} AS conduct, {r2('avg(m) FILTER (criterion IN (4,5))')} AS technical, NULL::DOUBLE AS physical, {r2('avg(m) FILTER (criterion = 7)')} AS learning FROM rm GROUP BY 1
""")
def d15(spark, d):
    return raters.cluster_means(ratings(spark, d), "entity", CLUSTERS, EXCLUDED)


@query("d16_grade_histogram", f"""
WITH {RATINGS_SQL} SELECT 'grade' AS kind, g AS member, count(*) AS n, NULL::DOUBLE AS mean FROM (SELECT grade1 AS g FROM rt UNION ALL SELECT grade2 FROM rt WHERE grade2 IS NOT NULL) GROUP BY g
UNION ALL SELECT 'criterion', criterion::VARCHAR, count(*), {r2('sum(2*m)::BIGINT / (2.0::DOUBLE * count(*))')} FROM rm GROUP BY criterion
""")
def d16(spark, d):
    r = ratings(spark, d)
    hist = raters.grade_histogram(r).select(F.lit("grade").alias("kind"), F.col("grade").alias("member"), "n", F.lit(None).cast("double").alias("mean"))
    # twice the mean is a whole number, so the sum is exact in any order
    twice = (raters.criterion_mean(F.col("grade1"), F.col("grade2")) * 2).cast("long")
    per = r.groupBy("criterion").agg(F.count(F.lit(1)).alias("n"), F.sum(twice).alias("t")).select(
        F.lit("criterion").alias("kind"), F.col("criterion").cast("string").alias("member"), "n", round2(F.col("t") / (2.0 * F.col("n"))).alias("mean")
    )
    return hist.unionByName(per)


@query("d17_rater_agreement", f"""
WITH {RATINGS_SQL}, g AS (SELECT entity, count(*) AS n, sum(p1) / count(*)::DOUBLE AS mean1, sum(p2) / count(*)::DOUBLE AS mean2, (count(*)*sum(p1*p1) - sum(p1)*sum(p1)) / (count(*)*count(*))::DOUBLE AS var1,
  (count(*)*sum(p2*p2) - sum(p2)*sum(p2)) / (count(*)*count(*))::DOUBLE AS var2, sum(abs(p1-p2))::BIGINT AS delta_sum, count(*) FILTER (abs(p1-p2) >= 2) AS disagreements FROM rp WHERE p2 IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN abs(mean1 - mean2) >= 1 THEN 'relative leniency/severity; not proof of bias' ELSE 'none' END AS leniency, n >= 4 AND var1 < 0.1 AS halo1, n >= 4 AND var2 < 0.1 AS halo2, n < 4 AS insufficient FROM g
""")
def d17(spark, d):
    return raters.agreement(ratings(spark, d), "entity")


@query("d17_disagreements", f"WITH {RATINGS_SQL} SELECT entity, criterion, abs(p1 - p2) AS delta FROM rp WHERE abs(p1 - p2) >= 2")
def d17_list(spark, d):
    return raters.disagreements(ratings(spark, d), "entity")


@query("h20_rating_band", f"""
WITH {RATINGS_SQL} SELECT entity, criterion, p1, CASE WHEN m >= 4.5 THEN 'Excellent' WHEN m >= 3.5 THEN 'Very Good' WHEN m >= 2.5 THEN 'Good' WHEN m >= 1.5 THEN 'Average' ELSE 'Poor' END AS band FROM rm
""")
def h20(spark, d):
    mean = raters.criterion_mean(F.col("grade1"), F.col("grade2"))
    return ratings(spark, d).select("entity", "criterion", raters.grade_points(F.col("grade1")).alias("p1"), labels.rating_band(mean).alias("band"))


# --- decisions --------------------------------------------------------------------------------------


@query("h33_decision", with_cand(f"""
, i AS (SELECT id, CASE WHEN years >= 10 THEN 'lead' WHEN years >= 6 THEN 'senior' WHEN years >= 3 THEN 'mid' ELSE 'junior' END AS level, total AS cv, least(100, coalesce(high, 0) * 10.0)::DOUBLE AS exam, (coalesce(low, 0) * 10.0)::DOUBLE AS interview, deal_breaker, segment, urgent FROM cand WHERE total IS NOT NULL),
c AS (SELECT *, {r2("CASE level WHEN 'junior' THEN (cv*25 + exam*40 + interview*35) WHEN 'mid' THEN (cv*25 + exam*35 + interview*40) WHEN 'senior' THEN (cv*20 + exam*30 + interview*50) ELSE (cv*20 + exam*25 + interview*55) END / 100.0::DOUBLE")} AS composite,
  CASE WHEN exam < 60 THEN 1 ELSE 0 END + CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END + CASE WHEN urgent IS NULL THEN 1 ELSE 0 END + deal_breaker::INT AS n FROM i)
SELECT id, level, composite, n AS n_gates, CASE WHEN deal_breaker OR composite < 40 THEN 'Reject' WHEN composite < 60 THEN 'Hold' WHEN n > 0 THEN 'Conditional hire' WHEN composite >= 75 THEN 'Hire' ELSE 'Hold' END AS outcome,
  concat_ws('; ', CASE WHEN exam < 60 THEN 'Retake exam and achieve at least 60% before independent duties' END, CASE WHEN segment = 'BUILDING' THEN 'Verify and demonstrate ERP before offer' END, CASE WHEN urgent IS NULL THEN 'Show a licence' END,
  CASE WHEN deal_breaker THEN 'Resolve confirmed deal-breaker before reconsideration' END) AS conditions FROM c
"""))
def h33(spark, d):
    rows = candidates(spark, d).where("total is not null")
    level = labels.test_level(F.coalesce("years", F.lit(0.0)), F.lit(""))
    exam = F.least(F.lit(100.0), F.coalesce("high", F.lit(0)) * 10.0)
    interview = F.coalesce("low", F.lit(0)) * 10.0

    def item(req, status, verification):
        return F.struct(F.lit(req).alias("requirement"), status.alias("status"), F.lit(verification).alias("verification"))

    coverage = F.array(
        item("ERP", F.when(F.col("segment") == "BUILDING", "Partial").otherwise("Met"), ""),
        item("Licence", F.when(F.col("urgent").isNull(), "Unverified").otherwise("Met"), "Show a licence"),
    )
    scored = rows.select(
        "id", "deal_breaker", level.alias("level"), F.col("total").alias("cv"), exam.alias("exam"), interview.alias("interview"), coverage.alias("coverage")
    ).where(decision.valid_inputs(F.col("cv"), F.col("exam"), F.col("interview")))
    made = scored.select(
        "id", "level", "deal_breaker",
        decision.composite(F.col("level"), F.col("cv"), F.col("exam"), F.col("interview")).alias("composite"),
        decision.gates(F.col("exam"), F.lit(60.0), F.col("coverage"), F.col("deal_breaker")).alias("gates"),
    )
    return made.select(
        "id", "level", "composite", F.size("gates").alias("n_gates"), decision.outcome(F.col("composite"), F.col("gates"), F.col("deal_breaker")).alias("outcome"),
        F.array_join(F.transform("gates", lambda g: g["condition"]), "; ").alias("conditions"),
    )
