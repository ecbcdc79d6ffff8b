"""Known inputs and results of the rules, one assertion per rule."""

import pytest
from pyspark.sql import functions as F

from rankmill.functions import labels, loose_json, numbers
from rankmill.functions import text as tx
from rankmill.operators import contracts, decision, exports, grading, intake, intervals, requests, requirements, scoring, tracking
from rankmill.operators.filters import INTERVIEW_PRESET, ViewFilters

CRITERIA = list(scoring.DEFAULT_WEIGHTS)


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)

    def value(column):
        return row.select(column.alias("v")).first()["v"]

    return value


def total(one, scores, breaker=False, weights=None):
    w = weights or scoring.DEFAULT_WEIGHTS
    cols = [F.lit(s) for s in scores]
    return one(scoring.weighted_total(cols, [w[c] for c in CRITERIA], F.lit(breaker)))


def test_weighted_total(one):
    assert total(one, [8, 6, 10, 5, 7, 8, 8]) == 78.0
    assert total(one, [8, 6, 10, 5, 7, 8, 8], breaker=True) == 0.0
    assert total(one, [10, None, None, None, None, None, None]) == 25.0
    assert total(one, [8, 6, 10, 5, 7, 8, 8], weights=dict.fromkeys(CRITERIA, 0.0)) == 0.0


@pytest.mark.parametrize(("score", "start"), [(80.0, "Strong"), (70.0, "Good"), (55.0, "Average"), (10.0, "Not suitable")])
def test_tier(one, score, start):
    assert one(labels.tier(F.lit(score))).startswith(start)


def test_band_in_list_order_with_gaps(one):
    band = lambda a, b, c, e: F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(c).alias("pay_low"), F.lit(e).alias("pay_high"))
    bands = F.array(band(80.0, 100.0, 18000, 22000), band(65.0, 79.0, 14000, 17999))
    assert one(scoring.salary_for(F.lit(82.0), bands)).startswith("18000–22000")
    assert one(scoring.salary_for(F.lit(79.5), bands)).startswith("Not set — add salary bands")
    assert one(scoring.salary_for(F.lit(40.0), bands)).startswith("Not set — add salary bands")


def test_scrub_searches_a_text_once_per_step(one):
    """Long runs of line ends cost their length, and steps that meet at a line end still see each other's lines."""
    import time

    start = time.monotonic()
    assert one(tx.scrub(F.concat(F.lit("a"), F.repeat(F.lit("\n"), 100_000), F.lit("b")))) == "a\n\nb"
    assert time.monotonic() - start < 10
    assert one(tx.scrub(F.lit("x\nAge\n31 y\nplain"))) == "x\n[AGE] y\nplain"
    assert one(tx.scrub(F.lit("Gender:\n\nphoto of me, tail\nplain 12"))) == "[GENDER]\nplain 12"
    assert one(tx.scrub(F.lit("plain\nTel\n+971 50 123 4567\nann é@b ann@b.org\nend"))) == "plain\n[PHONE]ann é@b [EMAIL]\nend"
    assert one(tx.scrub(F.lit("😀 a\nprofile\nphotograph\n😀 end"))) == "😀 a\n[PHOTO]\n😀 end"


def test_scrub(one):
    raw = "Ahmed Amer\nahmed@example.com\nMobile: +971 50 123 4567\nhttps://www.linkedin.com/in/ahmed-amer\nNationality: Egyptian\nSkills: Adobe, single source of truth in Essex"
    out = one(tx.scrub(F.lit(raw)))
    for mark in ("[NAME]", "[EMAIL]", "[PHONE]", "[LINKEDIN]", "[NATIONALITY]"):
        assert mark in out
    assert "Skills: Adobe, single source of truth in Essex" in out
    assert one(tx.scrub(F.lit(out))) == out
    out = one(tx.scrub(F.lit("x9\nDate of birth: 1990\nGender: M\nMarital status: single\nSenior Accountant")))
    assert out == "x9\n[DATE OF BIRTH]\n[GENDER]\n[MARITAL STATUS]\nSenior Accountant"
    assert not one(tx.has_raw_pii(F.lit(out))) and one(tx.contains_placeholder(F.lit(out)))


@pytest.mark.parametrize(
    ("text", "name"),
    [("Ahmed Amer\nx", "Ahmed Amer"), ("a@b.com\nChief Engineer", None), ("PROFESSIONAL SUMMARY\n1 x", None), (" \n\n  Zoë O'Neil-Đặng \n", "Zoë O'Neil-Đặng")],
)
def test_header_name(one, text, name):
    assert one(tx.header_name(F.lit(text))) == name


def test_header_name_reads_eight_filled_lines(one):
    filler = "\n\n".join(f"line {i} 9" for i in range(7))
    assert one(tx.header_name(F.lit(f"{filler}\nAnn Lee"))) == "Ann Lee"
    assert one(tx.header_name(F.lit(f"{filler}\n8\nAnn Lee"))) is None


def test_contact(one):
    text = "Sara Ali\nsara@x.org\n+971 50 123 4567\nlinkedin.com/in/sara"
    assert one(tx.first_mail(F.lit(text))) == "sara@x.org"
    assert "971" in one(tx.first_phone(F.lit(text)))
    assert one(tx.first_profile_url(F.lit(text))) == "linkedin.com/in/sara"
    assert one(tx.first_phone(F.lit("2018-2021"))) == "2018-2021"
    assert one(tx.first_phone(F.lit("2018-2021"), strict=True)) is None
    assert one(tx.display_name(F.lit("PROFESSIONAL SUMMARY"), F.lit("Neha Khandelwal.pdf"))) == "Neha Khandelwal"
    assert one(tx.labelled_nationality(F.lit("Nationality \t: Indian | Visa Status: x"))) == "Indian"
    assert one(tx.labelled_nationality(F.lit("International Trading LLC"))) is None


def test_shorten_by_section(one):
    text = "Summary\nAccountant\nExperience\nGL and AP\nReferences\nMr X\nHobbies\nfootball " + "y" * 90
    out = one(tx.shorten_by_section(F.lit(text), 30))
    assert "GL and AP" in out and "football" not in out and len(out) <= 30
    assert one(tx.shorten_by_section(F.lit("Summary\n"), 30)) == "Summary"
    assert one(tx.drop_repeated_lines(F.lit("a\n\n\nA\n b\na"))) == "a\n\nb"
    assert one(tx.truncate(F.lit("abcdef"), 3)) == "abc\n\n[TRUNCATED]"


def test_pages(one):
    assert one(tx.page_marked(F.array(F.lit("First"), F.lit("Second")), F.lit("x"))) == "[[PAGE 1]]\nFirst\n\n[[PAGE 2]]\nSecond"
    assert one(tx.page_marked(F.array().cast("array<string>"), F.lit("x"))) == "x"
    assert one(tx.string_members(F.lit("not json"))) == [] and one(tx.string_members(F.lit('["a", 1]'))) == ["a"]
    assert one(tx.string_members(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    ("title", "years", "want"),
    [
        ("Trainee", None, "Junior"), ("Graduate Director", 1.0, "Executive"), ("Vice President", None, "Executive"), ("Team Lead", None, "Supervisory and leadership"),
        ("Sr. Accountant", None, "Supervisory"), ("Mid-level Clerk", None, "Mid-level"), ("Clerk", 2.9, "Junior"), ("Clerk", 3.0, "Mid-level"), (None, 7.0, "Supervisory"),
        (" n/a ", 11.0, "Supervisory and leadership"), ("Clerk", 16.0, "Executive"), ("Clerk", -1.0, "Not stated"), (None, None, "Not stated"), ("Internal Auditor", None, "Not stated"),
    ],
)
def test_seniority(one, title, years, want):
    assert one(labels.seniority(F.lit(title).cast("string"), F.lit(years).cast("double"))) == want


def test_csv_quoting(one):
    assert one(tx.csv_cell(F.lit('Ada "A" Lovelace'))) == '"Ada ""A"" Lovelace"'
    assert one(tx.csv_cell(F.lit("a\rb"), quote_on_cr=False)) == "a\rb"
    assert one(tx.csv_cell(F.lit("a\rb"))) == '"a\rb"'


def test_numbers(one):
    assert one(numbers.half_up(F.lit(0.285), 2)) == 0.28
    assert one(numbers.round2(F.lit(1.005))) == 1.01
    assert one(numbers.percentage(F.lit(1.0), F.lit(0.0))) == 0.0
    for value, text in ((7.0, "7"), (0.00079, "0.00079"), (7.5023100000000005, "7.5023100000000005"), (0.0038599999999999997, "0.0038599999999999997"), (12345678.5, "12345678.5")):
        assert one(exports.number_text(F.lit(value))) == text


def test_run_tracking(one):
    assert one(tracking.rate_per_minute(F.lit(6), F.lit(30000))) == 12.0
    assert one(tracking.rate_per_minute(F.lit(0), F.lit(0))) == 0.0
    assert one(tracking.queue_size(F.lit(26), F.lit(160), F.lit(True))) == 26
    assert one(tracking.queue_size(F.lit(26), F.lit(10), F.lit(False))) == 36
    assert one(tracking.resumable(F.lit("Stopped at the time budget"))) and not one(tracking.resumable(F.lit(None).cast("string")))

    def stage(status, pending, extracted, scored, two_pass=False, turbo=False, stopped=0):
        return one(tracking.stage(*[F.lit(x) for x in (status, pending, extracted, scored, two_pass, turbo, stopped)]))

    assert stage("running", 3, 0, 0) == "extracting" and stage("running", 0, 0, 12, two_pass=True) == "rescoring"
    assert stage("done", 0, 0, 33, stopped=145) == "partial" and stage("cancelled", 1, 0, 0) == "cancelled"
    start = F.lit("2026-01-01 10:00:00").cast("timestamp_ntz")
    for now, past in (("2026-01-01 10:54:00", False), ("2026-01-01 10:55:00", True)):
        assert one(F.lit(now).cast("timestamp_ntz") >= tracking.deadline(start, 55)) is past


def test_best_setting(spark):
    rows = [(2, 0, 6.0), (4, 1, 12.0), (6, 2, 8.0)]
    df = spark.createDataFrame(rows, "setting int, pos int, rate double").withColumn("g", F.lit(1))
    assert tracking.best_setting(df, ["g"]).first()["setting"] == 4


def test_damping(one):
    tens = {c: F.lit(10) for c in CRITERIA}
    none = F.lit(None).cast("double")
    out = scoring.dampen(tens, F.lit(2.0), F.lit(2.0), none, F.lit(None).cast("string"), F.lit("short"), F.lit(None).cast("double"))
    assert (one(out["leadership"]), one(out["uaeExperience"]), one(out["achievements"]), one(out["jobFit"])) == (3, 2, 5, 10)


def test_archive_entries(spark):
    names = ["cv1.pdf", "nested/cv2.docx", "foo..bar.pdf", "__MACOSX/._cv.pdf", "readme.txt", "../x.pdf", "/x.pdf", "dir/", "a/.hidden.pdf"]
    df = spark.createDataFrame([(n, 10) for n in names] + [("empty.pdf", 0)], "entry string, size int")
    kept = df.where(intake.archive_entry_ok(F.col("entry"), F.col("size")))
    assert sorted(r["entry"] for r in kept.collect()) == ["cv1.pdf", "foo..bar.pdf", "nested/cv2.docx"]


@pytest.mark.parametrize(
    ("answer", "stage"),
    [('{"a": 1}', "as_is"), ('```json\n{"a": 1}\n```', "as_is"), ('{"a": , "b": 1}', "rewritten"), ("{a: 1, b: [1,],}", "rewritten"), ('{"a": {"b": [1, 2', "closed"), ('{"a": "x', "closed"), ("nothing", "quarantine")],
)
def test_loose_json(one, answer, stage):
    assert one(loose_json.repaired(F.lit(answer)))["stage"] == stage


def test_hydrate(one):
    raw = '{"scores":{"leadership":"7","jobFit":99,"achievements":2.5},"profile":{"software":["a",1],"totalYears":"4"},"flags":["odd","overlap"],"dealBreaker":"no","gaps":3}'
    h = one(loose_json.hydrated(F.lit(raw), CRITERIA))
    assert (h["scores"]["leadership"], h["scores"]["jobFit"], h["scores"]["achievements"], h["scores"]["uaeExperience"]) == (7, 10, 3, 0)
    assert h["profile"]["software"] == ["a"] and h["profile"]["totalYears"] is None and h["flags"] == ["overlap"]
    assert h["dealBreaker"] is True and h["gaps"] == ""


def test_questions(one):
    flags = F.array(F.lit("date_gap"), F.lit("missing_dates"))
    asked = one(requests.verification_questions(flags, F.array().cast("array<string>"), F.lit(3.0)))
    assert len(asked) == 4 and asked[2] == requests.ASK_CERTIFICATES


def test_requirements(one):
    text = F.lit("Senior or Junior\nMinimum 2 years in ERP systems\nSenior: 5+ years\nVAT returns and ledger work\nEmail: a@b.c ledger")
    dual = requirements.dual_track(F.lit("Accountant"), text)
    assert one(dual) and one(requirements.years_required(text, dual)) == 2
    must = one(requirements.must_have(text))
    assert any("ERP" in m for m in must) and any("VAT" in m for m in must) and not any(m.startswith("Email") for m in must)


def test_ranges_in_text(one):
    text = "[[PAGE 1]]\nClerk, Jan 2010 - March 2012\nx [[PAGE 2]]\n2013 to 2014 and 5/2015 – Present\nFrom ٢٠١٦/٠٢ حتى ٢٠١٧-٠٣\nbad 13/2001 - 2/2002"
    got = [(r["start_m"], r["end_m"], r["precise"], r["evidence"]) for r in one(intervals.ranges_in_text(F.lit(text), 2026 * 12 + 6))]
    assert got == [
        (2010 * 12, 2012 * 12 + 3, True, "[CV p.1]"), (2013 * 12, 2014 * 12 + 12, False, "[CV p.2]"),
        (2015 * 12 + 4, 2026 * 12 + 7, True, "[CV p.2]"), (2016 * 12 + 1, 2017 * 12 + 3, True, "[CV p.2]"),
    ]


def test_item_mark(one):
    def mark(answer, kind="identification", override=None):
        m = one(grading.item_mark(F.lit(answer).cast("string"), F.lit(kind), F.lit(4.0), F.array(F.lit("a")), F.array(F.lit(1.0), F.lit(2.0)), F.lit(override).cast("double")))
        return m["earned"], m["result"]

    assert mark("a") == (4.0, "correct") and mark("b") == (0.0, "wrong") and mark(" ", override=4.0) == (4.0, "blank")
    assert mark("b", "case") == (3.0, "partial") and mark("b", override=4.0) == (4.0, "correct") and mark(None) == (0.0, "blank")


def test_decision(one):
    none = F.array().cast("array<struct<requirement:string,status:string,verification:string>>")

    def outcome(score, breaker=False, exam=90.0):
        g = decision.gates(F.lit(exam), F.lit(60.0), none, F.lit(breaker))
        return one(decision.outcome(F.lit(score), g, F.lit(breaker)))

    assert outcome(39.9) == "Reject" and outcome(90.0, breaker=True) == "Reject" and outcome(59.0) == "Hold"
    assert outcome(80.0, exam=50.0) == "Conditional hire" and outcome(75.0) == "Hire" and outcome(70.0) == "Hold"
    assert one(decision.composite(F.lit("lead"), F.lit(50.0), F.lit(60.0), F.lit(70.0))) == 63.5


def test_filters():
    assert not ViewFilters(query="  ").is_active() and INTERVIEW_PRESET.is_active()
    assert ViewFilters(min_score=65.0, hide_deal_breakers=True) == INTERVIEW_PRESET


def test_scoring_guard(spark):
    df = spark.range(1).select("id", F.struct(F.lit("x").alias("Email")).alias("contact"))
    assert scoring.forbidden_fields(df) == ["contact.Email"]
    with pytest.raises(ValueError):
        scoring.assert_scoring_safe(df)


def test_contract_null_counts_as_broken(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert [tuple(r) for r in contracts.violations(df, ["id"], {"low": F.col("v") < 0}).collect()] == [(1, "low")]


def test_request_texts(spark):
    """Slots, missing values, kinds without a template, language rules and the line on flags."""
    rows = [(1, "a", "de", "x"), (2, "a", None, None), (3, "b", "??", ""), (4, None, "de", "y"), (5, "z", "en", "y")]
    df = spark.createDataFrame(rows, "id int, kind string, lang string, v string")
    templates = {"a": ("Sys {v}", "User {v}{v}"), "b": ("{v}", "plain")}
    rules = {"en": "English.", "de": "German."}
    out = requests.request_texts(df, ["id"], "kind", templates, {"v": F.col("v")}, F.col("lang"), rules, "en")
    got = {r["id"]: (r["system_text"], r["user_text"]) for r in out.collect()}
    assert got == {
        1: ("Sys x\nGerman.", "User xx"), 2: ("Sys none\nEnglish.", "User nonenone"), 3: ("none\nEnglish.", "plain"),
        4: (None, None), 5: (None, None),
    }
    with pytest.raises(ValueError, match="w"):
        requests.filled("{w}", {"v": F.col("v")})
    ask = spark.createDataFrame([(True,), (False,), (None,)], "f boolean").select(requests.user_text(F.lit("t"), F.col("f")).alias("u"))
    lines = [r["u"].split("\n\n")[1] for r in ask.collect()]
    assert lines == [requests.FLAG_LINE, requests.NO_FLAG_LINE, requests.NO_FLAG_LINE]
    docs = spark.createDataFrame([(1, "j", "some text"), (2, "k", "some text")], "id int, job string, text string")
    jobs = spark.createDataFrame([("j", "s", True), ("k", "s", False)], "job string, system_text string, ask boolean")
    made = requests.request_table(docs, jobs, "job", "id", flags=F.col("ask")).collect()
    assert {r["id"]: r["user_text"].endswith(requests.FLAG_LINE) for r in made} == {1: True, 2: False}


def test_small_numbers_as_in_sql(one):
    """Below 0.0001 the text has an exponent, as the SQL of the lists prints it."""
    for value, text in ((1e-05, "1e-05"), (5.9999999999999995e-05, "5.9999999999999995e-05"), (-1e-05, "-1e-05"), (1.5e-10, "1.5e-10"), (0.0001, "0.0001"), (0.00012, "0.00012")):
        assert one(exports.number_text(F.lit(value))) == text


def test_meta_line_of_few_hours(spark):
    row = spark.createDataFrame([("Junior", "Not stated", "ASIA", 4e-05)], "seniority_shown string, nationality_shown string, location_shown string, years_shown double")
    assert row.select(exports.meta_line(row)).first()[0] == "Junior · ASIA · 4e-05 years"


def test_contact_fields_search_a_text_once(spark, one):
    """One search for each field, also where a text has a match; the patterns find what they found."""
    df = spark.createDataFrame([("x",)], "text string")
    for field in (tx.first_mail, tx.first_phone, tx.first_profile_url):
        plan = df.select(field(F.col("text")).alias("v"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_extract") == 1
    assert one(tx.first_mail(F.lit("no..at here, %a.b+c@d-e.co.uk!"))) == "a.b+c@d-e.co.uk"
    assert one(tx.first_phone(F.lit("Whatsapp: +971 50 123 4567."))) == "Whatsapp: +971 50 123 4567"
    assert one(tx.first_phone(F.lit("(04) 333-4444"))) == "(04) 333-4444"
    assert one(tx.first_profile_url(F.lit("see HTTPS://WWW.LinkedIn.com/in/ann-1/ now"))) == "HTTPS://WWW.LinkedIn.com/in/ann-1/"
    assert one(tx.first_mail(F.lit("none"))) is None and one(tx.first_phone(F.lit("12 34"))) is None
