"""Intake, text, duplicate and relevance queries over documents, pages and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions import text as tx
from rankmill.functions.arrays import first_by_lower
from rankmill.operators import duplicates, intake, relevance, requests, requirements
from rankmill.operators.ranking import cap_split, ranked, top_k
from rankmill.plans.bindings import ROWS_SQL, document_rows
from rankmill.plans.registry import query
from rankmill.session import cut_lineage
from rankmill.sources.tables import expected_entries, table

NE = "length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))"


def _docs(spark, d):
    return table(spark, d, "documents")


def _busy_docs(spark, d):
    """For work that costs far more per row than moving the row."""
    return _docs(spark, d)


# --- scans, admission, reuse -------------------------------------------------------


@query("a01_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def a01(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")


@query("a02_admission", """
WITH f AS (SELECT doc_id, 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.DOCX' WHEN 'es' THEN '.zip' ELSE '.txt' END AS file_name,
  n_chars * 2048 AS size, lang FROM documents),
g AS (SELECT *, CASE WHEN lang = 'es' AND size > 500*1024*1024 THEN 'ZIP files can be up to 500 MB'
  WHEN lang = 'de' THEN 'Only PDF, DOCX, and ZIP files are supported'
  WHEN lang <> 'es' AND size > 15*1024*1024 THEN 'File is larger than 15 MB' END AS reason FROM f)
SELECT doc_id, file_name, CASE WHEN reason IS NOT NULL THEN 'error' WHEN lang = 'es' THEN 'archive' ELSE 'accepted' END AS status, reason FROM g
""")
def a02(spark, d):
    ext = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".DOCX").when(F.col("lang") == "es", ".zip").otherwise(".txt")
    files = _docs(spark, d).select(
        "doc_id", F.concat(F.lit("doc_"), "doc_id", ext).alias("file_name"), (F.col("n_chars") * 2048).alias("size")
    )
    return intake.admit_files(files).select("doc_id", "file_name", "status", "reason")


@query("a03_capacity_per_job", """
WITH held AS (SELECT source, count(*) AS held FROM documents JOIN labels USING (doc_id) GROUP BY 1),
inc AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS slot, count(*) OVER (PARTITION BY source) AS offered
  FROM documents ANTI JOIN labels USING (doc_id)),
r AS (SELECT inc.*, coalesce(held, 0) AS h, greatest(0, 40 - coalesce(held, 0)) AS room FROM inc LEFT JOIN held USING (source))
SELECT source, doc_id, slot, greatest(0, offered - room) AS skipped FROM r WHERE slot <= room
""")
def a03(spark, d):
    docs, marks = _docs(spark, d).select("doc_id", "source"), table(spark, d, "labels")
    known = docs.join(marks, "doc_id", "left_semi")
    new = docs.join(marks, "doc_id", "left_anti")
    return intake.within_capacity(new, known, "source", "doc_id", 40).select("source", "doc_id", "slot", "skipped")


@query("a04_archive_entries", """
WITH e AS (SELECT page_id, length(html) AS size,
  CASE WHEN url LIKE 'http://%' THEN substr(url, 7) ELSE regexp_replace(regexp_replace(url, '^https://', ''), '[?#].*$', '') END ||
  CASE WHEN url LIKE '%/en/%' THEN '.pdf' WHEN url LIKE '%/fr/%' THEN '.docx' WHEN url LIKE '%/de/%' THEN '/../x.pdf' ELSE '.html' END AS entry FROM pages)
SELECT page_id, entry, regexp_extract(entry, '[^/]*$') AS base_name FROM e
WHERE entry NOT LIKE '/%' AND NOT list_contains(string_split(entry, '/'), '..') AND regexp_matches(regexp_extract(entry, '[^/]*$'), '[^./]\\.(pdf|docx)$')
  AND regexp_extract(entry, '[^/]*$') NOT LIKE '.%' AND size > 0 AND size <= 15*1024*1024
""")
def a04(spark, d):
    url = F.col("url")
    path = F.when(url.startswith("http://"), F.regexp_replace(url, r"\Ahttp:/", "")).otherwise(
        F.regexp_replace(F.regexp_replace(url, r"\Ahttps://", ""), r"[?#].*\z", "")
    )
    tail = (
        F.when(F.contains(url, F.lit("/en/")), ".pdf").when(F.contains(url, F.lit("/fr/")), ".docx")
        .when(F.contains(url, F.lit("/de/")), "/../x.pdf").otherwise(".html")
    )
    entries = table(spark, d, "pages").select("page_id", F.concat(path, tail).alias("entry"), F.length("html").alias("size"))
    return entries.where(intake.archive_entry_ok(F.col("entry"), F.col("size"))).select(
        "page_id", "entry", F.element_at(F.split("entry", "/"), -1).alias("base_name")
    )


@query("a05_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a05(spark, d):
    return _docs(spark, d).select("doc_id", intake.content_hash(F.col("text")).alias("content_hash"))


@query("a07_page_assembly", """
WITH p AS (SELECT conv_id, turn, trim(text, E' \\n') AS t, length(text) AS n FROM conversations)
SELECT conv_id, coalesce(string_agg(t, E'\\n\\n' ORDER BY turn, t) FILTER (length(t) > 0), '') AS text, count(*) FILTER (length(t) > 0) AS n_pages, 'parsed' AS status
FROM p GROUP BY 1
""")
def a07(spark, d):
    built = intake.assemble_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return built.select("conv_id", "text", F.size("pages").cast("long").alias("n_pages"), "status")


@query("a08_stored_page_list", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 2 WHEN 'system' THEN 0 ELSE 0 END AS n_pages,
  CASE role WHEN 'user' THEN text ELSE '' END AS first_page FROM conversations
""")
def a08(spark, d):
    # user turns: mixed array; system turns: an object; assistant turns: broken JSON
    body = F.to_json(F.array("text"))
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    stored = (
        F.when(F.col("role") == "user", F.concat(F.lit("["), inner, F.lit(',1,null,"'), "role", F.lit('",{"a":"b"}]')))
        .when(F.col("role") == "system", F.to_json(F.struct("role")))
        .otherwise(F.concat(F.lit("["), inner))
    )
    pages = table(spark, d, "conversations").select("conv_id", "turn", tx.string_members(stored).alias("pages"))
    return pages.select(
        "conv_id", "turn", F.size("pages").alias("n_pages"), F.coalesce(F.get("pages", F.lit(0)), F.lit("")).alias("first_page")
    )


@query("a09_typed_decode", """
SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE json_extract(props, '$.k')::INT END AS k FROM events
""")
def a09(spark, d):
    # error events carry the number as text, signup events are cut off: both fail the type check
    stored = (
        F.when(F.col("event_type") == "error", F.regexp_replace("props", r": (\d+)", ': "$1"'))
        .when(F.col("event_type") == "signup", F.regexp_replace("props", r"\}", ""))
        .otherwise(F.col("props"))
    )
    return table(spark, d, "events").select("event_id", F.from_json(stored, "k int")["k"].alias("k"))


@query("a19_expected_list", """
SELECT entry FROM (SELECT doc_id, CASE WHEN quality = 0 THEN '' ELSE 'doc_' || doc_id || '.pdf' END AS entry, toxic FROM labels)
WHERE entry <> '' AND toxic = 0 ORDER BY doc_id LIMIT 10
""")
def a19(spark, d):
    line = F.when(F.col("toxic") == 1, "# skipped").when(F.col("quality") == 0, " \t").otherwise(
        F.concat(F.lit("  doc_"), "doc_id", F.lit(".pdf "))
    )
    lines = table(spark, d, "labels").select("doc_id", line.alias("line"))
    return expected_entries(lines, "line", [F.col("doc_id")]).select("entry")


@query("a20_safe_file_names", """
WITH b AS (SELECT page_id, url, trim(substr(regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9_.\\- ()+]', '_', 'g'), 1, 180)) AS s FROM pages),
c AS (SELECT *, CASE WHEN s = '' THEN 'cv' ELSE s END AS safe_name FROM b)
SELECT page_id, safe_name, 'run7-' || page_id || '-' || safe_name AS stored_name,
  coalesce(nullif(substr(regexp_replace(url, '[^A-Za-z0-9_\\x{0600}-\\x{06FF}.-]+', '_', 'g'), 1, 80), ''), 'export') AS safe_part FROM c
""")
def a20(spark, d):
    return table(spark, d, "pages").select(
        "page_id", tx.safe_file_name(F.col("url")).alias("safe_name"),
        tx.stored_file_name(F.col("url"), "run7", F.col("page_id")).alias("stored_name"),
        tx.safe_file_part(F.col("url")).alias("safe_part"),
    )


@query("b18_stage_gates", f"""
WITH {ROWS_SQL} SELECT doc_id, parse_status = 'parsed' AND stage_status = 'pending' AS to_extract,
  parse_status = 'parsed' AND stage_status = 'scored' AS to_rank FROM drows WHERE parse_status = 'parsed'
""")
def b18(spark, d):
    rows = document_rows(spark, d).where("parse_status = 'parsed'")
    return rows.select("doc_id", (F.col("stage_status") == "pending").alias("to_extract"), (F.col("stage_status") == "scored").alias("to_rank"))


# --- scrub and extract -------------------------------------------------------------

MAIL_RE = r"\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"
# the personal-data lines put in front of each document, in Spark and in SQL
CARD_SQL = """
card AS (SELECT doc_id, text, 'Ann ' || upper(lang) || 'son' AS who,
  'Ann ' || upper(lang) || E'son\\nNationality : ' || CASE lang WHEN 'en' THEN 'British | Visa Status: x' WHEN 'fr' THEN 'n/a' WHEN 'de' THEN 'German  citizen, visa ok' ELSE '1st class' END ||
  E'\\nDate of birth: 1 May 1990\\nAge: 31\\nSex: F\\nMarital status - single\\nhttps://www.linkedin.com/in/ann-' || doc_id || E'\\nMobile: +971 50 123 4567 ann' || doc_id || E'@mail.example.com\\nProfile photo\\n' AS head
  FROM documents)"""


def _cards(spark, d):
    nat = (
        F.when(F.col("lang") == "en", "British | Visa Status: x").when(F.col("lang") == "fr", "n/a")
        .when(F.col("lang") == "de", "German  citizen, visa ok").otherwise("1st class")
    )
    head = F.concat(
        F.lit("Ann "), F.upper("lang"), F.lit("son\nNationality : "), nat,
        F.lit("\nDate of birth: 1 May 1990\nAge: 31\nSex: F\nMarital status - single\nhttps://www.linkedin.com/in/ann-"),
        "doc_id", F.lit("\nMobile: +971 50 123 4567 ann"), "doc_id", F.lit("@mail.example.com\nProfile photo\n"),
    )
    return _busy_docs(spark, d).select("doc_id", "text", F.concat(F.lit("Ann "), F.upper("lang"), F.lit("son")).alias("who"), head.alias("head"))


SCRUBBED_SQL = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
 '(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|pub)/[\w%.-]+/?', '[LINKEDIN]', 'g'),
 '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]', 'g'),
 '(?i)(?:tel|phone|mobile|cell|whatsapp)\s*[:\-]?\s*[+\d][\d\s().-]{6,}', '[PHONE]', 'g'),
 '(?:\+|00)\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b', '[PHONE]', 'g'),
 '\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b', '[PHONE]', 'g'),
 '(?i)\b(?:date of birth|d\.?o\.?b\.?|born|birthday)\s*[:：\-]\s*[^\n]*', '[DATE OF BIRTH]', 'g')"""
SCRUBBED2_SQL = r"""
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
 '(?i)(?:^|\n)\s*age\s*[:\-]?\s*\d{1,2}\b', E'\n[AGE]', 'g'),
 '(?i)\b(?:nationality|citizenship)\s*[:：\-]\s*[^\n]*', '[NATIONALITY]', 'g'),
 '(?i)\b(?:gender|sex)\b\s*[:：\-]\s*[^\n]*', '[GENDER]', 'g'),
 '(?i)\bmarital status\b\s*[:：\-]\s*[^\n]*', '[MARITAL STATUS]', 'g'),
 '(?i)(?:profile\s*)?(?:photo|photograph|headshot|passport photo)\b', '[PHOTO]', 'g'),
 '\n{3,}', E'\n\n', 'g'), E' \n\t\r')"""
NAME_OK = r"""(length(l) <= 60 AND NOT regexp_matches(l, '[0-9@]') AND len(regexp_split_to_array(l, '\s+')) BETWEEN 2 AND 5
  AND NOT regexp_full_match(l, '[a-z ]+') AND regexp_full_match(l, '[\p{L}''’-]+(?:\s+[\p{L}''’-]+)*')
  AND NOT regexp_full_match(l, '(?i)(?:professional summary|key achievements|curriculum vitae|resume|cv|profile|objective|education|experience|skills|contact|summary|work history|personal details)')
  AND NOT regexp_matches(l, '(?i)\b(accountant|engineer|manager|developer|director|analyst|consultant|officer|specialist|supervisor|assistant|chief|trainee|senior|junior|lead|bookkeeper)\b'))"""
HEAD_SQL = r"""
ln AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({t}, '\r?\n'), lambda x: trim(x, E' \t\r')), lambda x: length(x) > 0)[1:8] AS ls FROM {src}),
nm AS (SELECT doc_id, list_filter(ls, lambda l: {ok})[1] AS header_name FROM ln)"""


def head_sql(src: str, t: str) -> str:
    return HEAD_SQL.replace("{t}", t).replace("{src}", src).replace("{ok}", NAME_OK)


@query("h01_scrub", f"""
WITH {CARD_SQL}, s1 AS (SELECT doc_id, {SCRUBBED_SQL.replace("{x}", "replace(head || text, who, '[NAME]')")} AS t FROM card)
SELECT doc_id, {SCRUBBED2_SQL.replace("{x}", "t")} AS scrubbed FROM s1
""")
def h01(spark, d):
    return _cards(spark, d).select("doc_id", tx.scrub(F.concat("head", "text")).alias("scrubbed"))


@query("h02_header_name", f"WITH {head_sql('documents', 'text')} SELECT doc_id, header_name FROM nm")
def h02(spark, d):
    return _busy_docs(spark, d).select("doc_id", tx.header_name(F.col("text")).alias("header_name"))


@query("h03_file_name_to_name", r"""
WITH a AS (SELECT page_id, trim(regexp_replace(replace(regexp_replace(f, '\.[^.]+$', ''), '_', ' '), '\s+', ' ', 'g')) AS b FROM
   (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/', '_', 'g') || '_CV (2) final.pdf' AS f FROM pages)),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?i)\b(cv|resume|updated|copy|final|ats|new|old)\b', '', 'g'),
   '\(\d+\)', '', 'g'), '\d{5,}', '', 'g'), '-+', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM a)
SELECT page_id, CASE WHEN length(n) >= 3 AND (len(string_split(n, ' ')) BETWEEN 2 AND 6 OR length(n) >= 4) THEN n END AS name FROM c
""")
def h03(spark, d):
    file_name = F.concat(
        F.regexp_replace(F.regexp_replace("url", r"\Ahttps?://", ""), "/", "_"), F.lit("_CV (2) final.pdf")
    )
    return table(spark, d, "pages").select("page_id", tx.display_name(F.lit("Resume"), file_name).alias("name"))


PHONE_RE = r"(?i)(?:(?:tel|phone|mobile|cell|whatsapp)\s*[:\-]?\s*)?(?:(?:\+|00)\d{1,3}[\s.-]?)?(?:\(?0?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}\b"


@query("h04_contact_fields", r"""
SELECT doc_id, nullif(trim(regexp_extract(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')), '') AS email,
  nullif(trim(regexp_extract(text, '{P}')), '') AS phone,
  nullif(trim(regexp_extract(text, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|pub)/[\w%.-]+/?')), '') AS linkedin
FROM (SELECT doc_id, text || E'\nhttps://www.linkedin.com/in/ann-' || doc_id AS text FROM documents)
""".replace("{P}", PHONE_RE))
def h04(spark, d):
    text = F.concat("text", F.lit("\nhttps://www.linkedin.com/in/ann-"), "doc_id")
    return _busy_docs(spark, d).select(
        "doc_id", tx.first_mail(text).alias("email"), tx.first_phone(text).alias("phone"),
        tx.first_profile_url(text).alias("linkedin"),
    )


@query("a06_reuse_by_hash", rf"""
WITH hist AS (SELECT sha256(text) AS content_hash, min(doc_id) AS reused_from FROM documents SEMI JOIN labels USING (doc_id) WHERE {NE} >= 80 GROUP BY 1),
{head_sql('documents', 'text')}, x AS (SELECT d.doc_id, text, header_name, CASE WHEN header_name IS NULL THEN text ELSE replace(text, header_name, '[NAME]') END AS named FROM documents d JOIN nm USING (doc_id) WHERE doc_id IN (SELECT reused_from FROM hist)),
y AS (SELECT *, {SCRUBBED_SQL.replace("{x}", "named")} AS t FROM x),
store AS (SELECT content_hash, reused_from, text AS raw_text, 1 AS n_pages, trim(text, E' \n\t\r') AS first_page, {SCRUBBED2_SQL.replace("{x}", "t")} AS anonymized_text, header_name AS full_name,
  nullif(trim(regexp_extract(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b')), '') AS email, nullif(trim(regexp_extract(text, '{PHONE_RE}')), '') AS phone FROM hist JOIN y ON y.doc_id = reused_from)
SELECT doc_id, sha256(text) AS content_hash, reused_from, CASE WHEN reused_from IS NULL AND {NE} < 80 THEN 'needs_ocr' ELSE 'parsed' END AS parse_status,
  raw_text, n_pages, first_page, anonymized_text, full_name, email, phone
FROM documents n ANTI JOIN labels USING (doc_id) LEFT JOIN store ON store.content_hash = sha256(text)
""")
def a06(spark, d):
    marks = table(spark, d, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    rows = _docs(spark, d).join(marks, "doc_id", "left")
    found = intake.reuse_by_hash(rows, F.col("known"), "doc_id")
    pages = F.when(F.col("pages").isNotNull(), F.size("pages"))
    return found.select(
        "doc_id", "content_hash", "reused_from", "parse_status", "raw_text", pages.alias("n_pages"), F.get("pages", F.lit(0)).alias("first_page"),
        "anonymized_text", "contact.full_name", "contact.email", "contact.phone",
    )


@query("h05_labelled_value", "SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z]{2,12}'), '') AS nationality FROM documents")
def h05(spark, d):
    # the label stands in front of the text or behind it, the value is a word of the text
    word = F.regexp_extract("text", "[A-Za-z]{2,12}", 0)
    line = F.concat(F.lit("Nationality : "), word, F.lit(" | Visa Status: x"))
    stated = F.when(F.col("doc_id") % 2 == 0, F.concat(line, F.lit("\n"), "text")).otherwise(F.concat("text", F.lit("\n"), line))
    return _busy_docs(spark, d).select("doc_id", tx.labelled_nationality(stated).alias("nationality"))


@query("h06_near_empty", rf"""
SELECT doc_id, {NE} < 80 AS near_empty, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n\t\r') AS collapsed FROM documents
""")
def h06(spark, d):
    return _docs(spark, d).select("doc_id", tx.near_empty(F.col("text")).alias("near_empty"), tx.collapse_blank(F.col("text")).alias("collapsed"))


# resume-like text with headers around the parts of a document
def _sectioned(spark, d):
    return _busy_docs(spark, d).select(
        "doc_id",
        F.concat(
            F.lit("Intro of "), "source", F.lit("\nSkills:\n"), "lang", F.lit(" skill one\nskill two\nReferences\nref line\nWork Experience\n"),
            F.regexp_replace("text", "\n", " "), F.lit("\nSummary\nshort summary\n  \nHobbies\nchess\nEDUCATION :\ndegree\nEducation\nSkill Two\nmore education"),
        ).alias("text"),
    )


# the same result put together directly: each section is known, the budget is applied in order
H07_SQL = r"""
WITH b AS (SELECT doc_id, 'short summary' AS s1, trim(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '[ \t]+', ' ', 'g')) AS s2,
  E'degree\nmore education' AS s3, lang || E' skill one\nskill two' AS s4, 'Intro of ' || source || E'\nref line\nchess' AS s6 FROM documents),
p AS (SELECT *, length(s1) + 1 AS u1 FROM b),
q AS (SELECT *, substr(s2, 1, 600 - u1) AS c2 FROM p),
r AS (SELECT *, u1 + CASE WHEN length(s2) > 0 THEN length(c2) + 1 ELSE 0 END AS u2 FROM q),
s AS (SELECT *, substr(s3, 1, greatest(0, 600 - u2)) AS c3 FROM r),
t AS (SELECT *, u2 + CASE WHEN u2 < 600 THEN length(c3) + 1 ELSE 0 END AS u3 FROM s),
u AS (SELECT *, CASE WHEN u3 < 600 THEN substr(s4, 1, 600 - u3) END AS c4 FROM t),
v AS (SELECT *, u3 + coalesce(length(c4) + 1, 0) AS u4 FROM u),
w AS (SELECT *, CASE WHEN u4 < 600 THEN substr(s6, 1, 600 - u4) END AS c6 FROM v)
SELECT doc_id, substr(trim(concat_ws(E'\n', s1, CASE WHEN length(s2) > 0 THEN c2 END, CASE WHEN u2 < 600 THEN c3 END, c4, c6), E' \n'), 1, 600) AS short_text FROM w
"""


@query("h07_shorten_by_section", H07_SQL)
def h07(spark, d):
    return _sectioned(spark, d).select("doc_id", tx.shorten_by_section(F.col("text"), 600).alias("short_text"))


@query("h08_truncate", r"SELECT doc_id, CASE WHEN length(text) > 1600 THEN substr(text, 1, 1600) || E'\n\n[TRUNCATED]' ELSE text END AS text FROM documents")
def h08(spark, d):
    return _docs(spark, d).select("doc_id", tx.truncate(F.col("text"), 1600).alias("text"))


@query("h09_page_markers", r"""
WITH p AS (SELECT conv_id, turn, trim(text, E' \n') AS t FROM conversations),
n AS (SELECT conv_id, t, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS i FROM p WHERE length(t) > 0)
SELECT conv_id, string_agg('[[PAGE ' || i || E']]\n' || t, E'\n\n' ORDER BY i) AS marked, '' AS label FROM n GROUP BY 1
""")
def h09(spark, d):
    built = intake.assemble_pages(table(spark, d, "conversations"), "conv_id", "turn", "text").where("status = 'parsed'")
    return built.select("conv_id", tx.page_marked(F.col("pages"), F.col("text")).alias("marked"), tx.page_label(F.col("pages")).alias("label"))


TOK_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"


def tok(x: str) -> str:
    return TOK_SQL.replace("{x}", x)


@query("h10_tokenise", f"SELECT doc_id, len({tok('text')}) AS n_tokens, array_to_string({tok('text')}, ' ') AS tokens FROM documents")
def h10(spark, d):
    t = tx.tokens(F.col("text"))
    return _busy_docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


CANON = r"trim(regexp_replace(regexp_replace(translate(regexp_replace(lower({x}), '[\x{064B}-\x{065F}\x{0670}\x{0640}]', '', 'g'), 'أإآى٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'اااي01234567890123456789'), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("h11_canonical_answer", "SELECT doc_id, " + CANON.replace("{x}", "'إجابة رَقم ٣۴: ' || text") + " AS canonical FROM documents")
def h11(spark, d):
    return _busy_docs(spark, d).select("doc_id", tx.canonical_answer(F.concat(F.lit("إجابة رَقم ٣۴: "), "text")).alias("canonical"))


@query("h12_ascii_digits", """
SELECT doc_id, doc_id || '/' || n_chars || ' ' || source AS label FROM documents
""")
def h12(spark, d):
    arabic = F.translate(F.col("doc_id").cast("string"), "0123456789", tx.ARABIC_INDIC)
    persian = F.translate(F.col("n_chars").cast("string"), "0123456789", tx.EXTENDED_INDIC)
    return _docs(spark, d).select("doc_id", tx.ascii_digits(F.concat(arabic, F.lit("/"), persian, F.lit(" "), "source")).alias("label"))


@query("h13_script_class", r"""
SELECT doc_id, CASE WHEN lang = 'es' THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'ar' ELSE 'en' END WHEN NOT regexp_matches(text, '[A-Za-z]') THEN CASE lang WHEN 'fr' THEN 'ar' ELSE 'en' END
  WHEN lang = 'fr' THEN 'mixed' ELSE 'en' END AS script FROM documents
""")
def h13(spark, d):
    text = F.when(F.col("lang") == "es", F.regexp_replace("text", "[A-Za-z]+", "نص")).when(F.col("lang") == "fr", F.concat(F.lit("نص "), "text")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", tx.script_class(text).alias("script"))


@query("b03_pii_gate", r"""
SELECT doc_id, regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') OR regexp_matches(text, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/(?:in|pub)/') AS raw_pii,
  regexp_matches({s}, '\[(?:NAME|EMAIL|PHONE|LINKEDIN|NATIONALITY|AGE|GENDER|MARITAL STATUS|PHOTO|DATE OF BIRTH)\]') AS has_marker
FROM (SELECT doc_id, text, trim(text, E' \n') AS t FROM documents)
""".replace("{s}", SCRUBBED2_SQL.replace("{x}", SCRUBBED_SQL.replace("{x}", "CASE WHEN doc_id IN (SELECT doc_id FROM named) THEN '[NAME]' || text ELSE text END"))).replace(
    "\nSELECT doc_id, regexp", "\nWITH " + head_sql("documents", "text") + ", named AS (SELECT doc_id FROM nm WHERE header_name IS NOT NULL)\nSELECT doc_id, regexp", 1))
def b03(spark, d):
    return _busy_docs(spark, d).select(
        "doc_id", tx.has_raw_pii(F.col("text")).alias("raw_pii"), tx.contains_placeholder(tx.scrub(F.col("text"))).alias("has_marker")
    )


@query("s02_distinct_lines", r"""
WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x, E' \t\r')) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS k FROM u),
g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM f WHERE x = '' OR k = 1)
SELECT doc_id, string_agg(x, E'\n' ORDER BY i) AS text FROM g WHERE x <> '' OR j = 1 OR prev <> '' GROUP BY 1
""")
def s02(spark, d):
    return _busy_docs(spark, d).select("doc_id", tx.drop_repeated_lines(F.col("text")).alias("text"))


# --- duplicates -------------------------------------------------------------------


@query("c07_exact_duplicate_groups", f"""
WITH {head_sql('documents', 'text')},
s0 AS (SELECT doc_id, CASE WHEN header_name IS NULL THEN text ELSE replace(text, header_name, '[NAME]') END AS text FROM documents JOIN nm USING (doc_id)),
s1 AS (SELECT doc_id, {SCRUBBED_SQL.replace("{x}", "text")} AS t FROM s0),
s2 AS (SELECT doc_id, {SCRUBBED2_SQL.replace("{x}", "t")} AS t FROM s1),
h AS (SELECT doc_id, sha256(trim(regexp_replace(lower(t), '\\s+', ' ', 'g'))) AS hash FROM s2)
SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY 1 HAVING count(*) > 1
""")
def c07(spark, d):
    return duplicates.exact_groups(_busy_docs(spark, d), "doc_id", "text")


NEAR_SQL = f"""
WITH n AS (SELECT doc_id, {CANON.replace("{x}", "text")} AS c FROM documents),
w AS (SELECT doc_id, c, list_distinct(list_filter(string_split(c, ' '), lambda x: length(x) > 2)) AS ws FROM n),
t AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS token FROM w),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.k AS ka, b.k AS kb, count(*) AS common FROM t a JOIN t b ON a.token = b.token AND b.doc_id < a.doc_id GROUP BY ALL),
hit AS (SELECT DISTINCT x AS doc_id FROM p WHERE common * 37 > (ka + kb) * 17
  UNION SELECT a.doc_id FROM n a JOIN n b ON a.c = b.c AND b.doc_id < a.doc_id)
SELECT n.doc_id, hit.doc_id IS NOT NULL AS is_duplicate FROM n LEFT JOIN hit USING (doc_id)
"""


@query("c06_near_duplicates", NEAR_SQL)
def c06(spark, d):
    return duplicates.near_duplicate_flags(_busy_docs(spark, d), "doc_id", "text")


@query("s06_word_set_sizes", f"""
WITH j AS (SELECT doc_id, {CANON.replace("{x}", "d.text")} AS a, {CANON.replace("{x}", "b.text")} AS b FROM documents d JOIN benchmark b ON source = 'src' || item_id),
w AS (SELECT doc_id, list_distinct(list_filter(string_split(a, ' '), lambda x: length(x) > 2)) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: length(x) > 2)) AS y FROM j)
SELECT doc_id, len(list_intersect(x, y)) AS common, len(list_distinct(list_concat(x, y))) AS joint FROM w
""")
def s06(spark, d):
    jobs = table(spark, d, "benchmark").select(
        F.concat(F.lit("src"), "item_id").alias("source"), duplicates.word_set(tx.canonical_answer(F.col("text"))).alias("y")
    )
    docs = _busy_docs(spark, d).select("doc_id", "source", duplicates.word_set(tx.canonical_answer(F.col("text"))).alias("x"))
    both = docs.join(jobs, "source").select("doc_id", duplicates.jaccard_counts(F.col("x"), F.col("y")).alias("j"))
    return both.select("doc_id", F.col("j.common").alias("common"), F.col("j.joint").alias("joint"))


# --- relevance: each document against the job text of its source ---------------------

REL_SQL = f"""
job AS (SELECT 'src' || item_id AS source, text AS description, CASE WHEN item_id % 3 = 0 THEN NULL ELSE (item_id % 7)::DOUBLE END AS min_years,
  list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 5) AS long_words FROM benchmark),
jobs AS (SELECT *, long_words[1:4] AS must, long_words[5:6] AS nice,
  description || ' ' || array_to_string(long_words[1:4], ' ') || ' ' || array_to_string(long_words[5:6], ' ') || ' Degree Dubai' AS blob FROM job),
jt AS (SELECT source, token, count(*) AS n FROM (SELECT source, unnest({tok('blob')}) AS token FROM jobs) GROUP BY ALL),
dd AS (SELECT doc_id, source, text || CASE lang WHEN 'en' THEN ' with ' || (doc_id % 12) || '+ years and 2.5 yrs in Dubai' WHEN 'fr' THEN ' 4 years' ELSE '' END AS text FROM documents),
dt AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tok('text')}) AS token FROM dd) GROUP BY ALL),
dsq AS (SELECT doc_id, sum(n*n) AS sq FROM dt GROUP BY 1), jsq AS (SELECT source, sum(n*n) AS sq FROM jt GROUP BY 1),
dot AS (SELECT dd.doc_id, sum(dt.n * jt.n) AS v FROM dd JOIN dt USING (doc_id) JOIN jt ON jt.source = dd.source AND jt.token = dt.token GROUP BY 1),
parts AS (SELECT dd.doc_id, dd.source, CASE WHEN dsq.sq IS NULL OR jsq.sq IS NULL THEN 0.0 ELSE coalesce(v, 0)::DOUBLE / (sqrt(jsq.sq::DOUBLE) * sqrt(dsq.sq::DOUBLE)) END::DOUBLE AS cosine,
  CASE WHEN len(must) = 0 THEN 0.0 ELSE len(list_filter(must, lambda w: contains(lower(dd.text), w)))::DOUBLE / len(must) END::DOUBLE AS must_ratio,
  CASE WHEN len(nice) = 0 THEN 0.0 ELSE len(list_filter(nice, lambda w: contains(lower(dd.text), w)))::DOUBLE / len(nice) END::DOUBLE AS nice_ratio,
  len(list_filter(['dubai', 'uae', 'abu dhabi', 'dubai', 'الإمارات', 'أبوظبي'], lambda w: contains(lower(dd.text), w)))::DOUBLE / 6 AS location_ratio,
  list_max(list_transform(regexp_extract_all(dd.text, '(?i)(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:years?|yrs?|سنة|سنوات|عام|أعوام)', 1), lambda v: v::DOUBLE)) AS years, min_years
  FROM dd JOIN jobs USING (source) LEFT JOIN dsq USING (doc_id) LEFT JOIN jsq ON jsq.source = dd.source LEFT JOIN dot ON dot.doc_id = dd.doc_id),
parts2 AS (SELECT *, CASE WHEN years IS NULL THEN 0.5 WHEN min_years IS NOT NULL THEN least(1.0, years / greatest(min_years, 1)) ELSE least(1.0, years / 10) END::DOUBLE AS years_ratio FROM parts),
rel AS (SELECT doc_id, source, (floor(least(100, greatest(0, cosine*40::DOUBLE + must_ratio*30::DOUBLE + nice_ratio*10::DOUBLE + years_ratio*10::DOUBLE + location_ratio*10::DOUBLE)) * 10::DOUBLE + 0.5::DOUBLE) / 10)::DOUBLE AS relevance FROM parts2)"""


def _jobs(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 5)
    must, nice = F.slice(words, 1, 4), F.slice(words, 5, 2)
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("src"), "item_id").alias("source"), must.alias("must"), nice.alias("nice"),
        F.when(F.col("item_id") % 3 != 0, (F.col("item_id") % 7).cast("double")).alias("min_years"),
        F.lit(None).cast("string").alias("location"), F.lit("Dubai").alias("scope"),
        relevance.job_terms(F.col("text"), must, nice, F.lit("Degree"), F.lit("Dubai")).alias("terms"),
    )


def _stated_docs(spark, d):
    extra = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" with "), F.col("doc_id") % 12, F.lit("+ years and 2.5 yrs in Dubai")))
        .when(F.col("lang") == "fr", " 4 years").otherwise("")
    )
    return _busy_docs(spark, d).select("doc_id", "source", F.concat("text", extra).alias("text"))


@query("d19_term_frequency", f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tok('text')}) AS token FROM documents) GROUP BY ALL")
def d19(spark, d):
    return relevance.term_frequencies(_busy_docs(spark, d), "doc_id", "text")


@query("d20_cosine", f"WITH {REL_SQL} SELECT doc_id, cosine FROM parts")
def d20(spark, d):
    return relevance.relevance_parts(_stated_docs(spark, d), _jobs(spark, d), "source").select("doc_id", "cosine")


@query("d21_keyword_ratio", f"WITH {REL_SQL} SELECT doc_id, must_ratio, nice_ratio, location_ratio FROM parts")
def d21(spark, d):
    return relevance.relevance_parts(_stated_docs(spark, d), _jobs(spark, d), "source").select("doc_id", "must_ratio", "nice_ratio", "location_ratio")


@query("d22_years_stated", f"WITH {REL_SQL} SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:years?|yrs?)', 1), lambda v: v::DOUBLE)) AS years FROM dd")
def d22(spark, d):
    return _stated_docs(spark, d).select("doc_id", tx.years_stated(F.col("text")).alias("years"))


def _relevance(spark, d):
    return relevance.relevance(_stated_docs(spark, d), _jobs(spark, d), "source")


@query("d23_relevance", f"WITH {REL_SQL} SELECT doc_id, source, relevance FROM rel")
def d23(spark, d):
    return _relevance(spark, d)


@query("e02_rank_by_relevance", f"WITH {REL_SQL} SELECT doc_id, source, relevance, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS rank FROM rel")
def e02(spark, d):
    return ranked(cut_lineage(_relevance(spark, d), "relevance"), ["source"], "relevance", "doc_id")


@query("e04_cap_split", f"""
WITH {REL_SQL}, {ROWS_SQL}, k AS (SELECT rel.*, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) <= 20 AS inside FROM rel)
SELECT doc_id, source, inside, CASE WHEN NOT inside AND stage_status IN ('pending', 'not_screened_time_budget') THEN 'not_screened_time_budget' ELSE stage_status END AS stage_status,
  CASE WHEN NOT inside AND stage_status IN ('pending', 'not_screened_time_budget') THEN 'Outside Pass A cap' ELSE error END AS error
FROM k JOIN (SELECT doc_id, stage_status, error FROM drows) USING (doc_id)
""")
def e04(spark, d):
    rows = document_rows(spark, d).select("doc_id", "stage_status", "error")
    scored = cut_lineage(_relevance(spark, d), "relevance")
    split = cap_split(scored, ["source"], "relevance", "doc_id", 20).join(rows, "doc_id")
    out = ~F.col("inside") & F.col("stage_status").isin("pending", "not_screened_time_budget")
    return split.select(
        "doc_id", "source", "inside",
        F.when(out, "Outside Pass A cap").otherwise(F.col("error")).alias("error"),
        F.when(out, "not_screened_time_budget").otherwise(F.col("stage_status")).alias("stage_status"),
    )


@query("c15_overlap_at_k", f"""
WITH {REL_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS rank FROM rel)
SELECT source, count(l.doc_id) AS overlap, count(*) AS shown, 10 AS k FROM t LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = t.doc_id WHERE rank <= 10 GROUP BY 1
""")
def c15(spark, d):
    top = top_k(_relevance(spark, d), ["source"], [F.col("relevance").desc(), F.col("doc_id")], 10)
    return relevance.overlap_at_k(top, table(spark, d, "labels").where("quality = 1"), "source", "doc_id", 10)


# --- rules from text, requests -------------------------------------------------------

# a job text from the values of a document row
JD_SQL = r"""
jd AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'Senior Accountant / Junior Accountant' ELSE 'Accountant' END AS title,
  E'How to apply: VAT desk\n' || '• Bachelor degree in ' || source || E'\n - Minimum ' || (n_chars % 45) || E' years of experience\n\n* minimum ' || (n_chars % 45) || E' YEARS of experience\n' ||
  CASE lang WHEN 'en' THEN E'Looking to hire VAT experts\nERP such as SAP or Oracle\nBank reconciliation and ledger\n' WHEN 'fr' THEN E'Based in Abu Dhabi with 3+ years\nWork in Abu Dhabi office\n' ELSE E'short\nExcel skills required\n' END ||
  regexp_replace(text, '\n', ' ', 'g') || E'\nYear-end accounts\nAudit files\nLedger upkeep\nPayroll runs' AS description FROM documents),
jl AS (SELECT *, list_filter(list_transform(regexp_split_to_array(description, '\n+'), lambda x: trim(regexp_replace(x, '^[\s•*\-–]+', ''))), lambda l:
    length(l) BETWEEN 8 AND 160 AND NOT regexp_matches(l, '(?i)^(how to apply|email|mobile|phone|tel|positions?:|responsibilit|qualifications?|requirements?|location:)')
    AND NOT regexp_matches(l, '(?i)leading company|looking to hire|based in|landscap|nursery|nurseries')
    AND regexp_matches(l, '(?i)bachelor|degree|diploma|master|erp|zoho|sap|oracle|odoo|dynamics|vat|ifrs|excel|account|reconcil|payable|receivable|abu dhabi|uae|year|budget|audit|ledger|payroll'))[1:8] AS ls FROM jd),
js AS (SELECT *, list_filter([CASE WHEN regexp_matches(description, '(?i)bachelor|degree') THEN 'Bachelor''s degree in Accounting or Finance' END,
    CASE WHEN regexp_matches(description, '(?i)erp|zoho|sap|oracle|odoo|dynamics') THEN 'ERP (Zoho, SAP, Oracle, Dynamics, or Odoo)' END,
    CASE WHEN regexp_matches(description, '(?i)vat|uae regulation') THEN 'UAE VAT / FTA compliance' END,
    CASE WHEN regexp_matches(description, '(?i)payable|receivable|ap/ar|reconcil') THEN 'AP/AR and reconciliations' END,
    CASE WHEN regexp_matches(description, '(?i)abu dhabi') THEN 'Based in or willing to work in Abu Dhabi' END], lambda x: x IS NOT NULL) AS syn,
    list_filter(list_transform(regexp_extract_all(description, '(?i)(\d+)\s*\+?\s*years?', 1), lambda y: try_cast(y AS BIGINT)), lambda y: y > 0 AND y < 40) AS ys,
    title LIKE 'Senior%' AS dual FROM jl),
ju AS (SELECT doc_id, unnest(list_concat(syn, ls)) AS x, unnest(range(len(syn) + len(ls))) AS i FROM js),
jf AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS k FROM ju),
jm AS (SELECT doc_id, array_to_string(list(x ORDER BY i)[1:6], '|') AS must FROM jf WHERE k = 1 GROUP BY 1)"""


def _job_texts(spark, d):
    years = (F.col("n_chars") % 45).cast("string")
    middle = (
        F.when(F.col("lang") == "en", "Looking to hire VAT experts\nERP such as SAP or Oracle\nBank reconciliation and ledger\n")
        .when(F.col("lang") == "fr", "Based in Abu Dhabi with 3+ years\nWork in Abu Dhabi office\n")
        .otherwise("short\nExcel skills required\n")
    )
    tail = F.regexp_replace("text", "\n", " ")
    description = F.concat(
        F.lit("How to apply: VAT desk\n• Bachelor degree in "), "source", F.lit("\n - Minimum "), years,
        F.lit(" years of experience\n\n* minimum "), years, F.lit(" YEARS of experience\n"), middle, tail,
        F.lit("\nYear-end accounts\nAudit files\nLedger upkeep\nPayroll runs"),
    )
    title = F.when(F.col("lang") == "de", "Senior Accountant / Junior Accountant").otherwise("Accountant")
    return _busy_docs(spark, d).select("doc_id", title.alias("title"), description.alias("description"))


@query("h31_requirement_rules", f"""
WITH {JD_SQL} SELECT js.doc_id, must, CASE WHEN dual THEN '5+ years and senior-track leadership for Senior Accountant' ELSE array_to_string(ls[7:], '|') END AS nice,
  CASE WHEN dual THEN list_min(ys) ELSE ys[1] END AS min_years, 'Bachelor''s degree' AS education,
  CASE WHEN regexp_matches(description, '(?i)abu dhabi') THEN 'Abu Dhabi' ELSE 'United Arab Emirates' END AS location, dual AS dual_track FROM js JOIN jm USING (doc_id)
""")
def h31(spark, d):
    t, x = F.col("title"), F.col("description")
    dual = requirements.dual_track(t, x)
    return _job_texts(spark, d).select(
        "doc_id", F.array_join(requirements.must_have(x), "|").alias("must"),
        F.array_join(requirements.nice_to_have(x, dual), "|").alias("nice"),
        requirements.years_required(x, dual).alias("min_years"), requirements.education_required(x).alias("education"),
        requirements.location_required(x, F.lit("United Arab Emirates")).alias("location"), dual.alias("dual_track"),
    )


@query("s03_distinct_requirements", f"WITH {JD_SQL} SELECT doc_id, must FROM jm")
def s03(spark, d):
    x = F.col("description")
    both = F.concat(requirements.synthesized(x), requirements.requirement_lines(x))
    return _job_texts(spark, d).select("doc_id", F.array_join(F.slice(first_by_lower(both), 1, requirements.MUST_CAP), "|").alias("must"))


@query("h22_rubric_cleaning", """
SELECT doc_id, source || '|' || lang AS must, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS education, coalesce(CASE WHEN lang = 'fr' THEN NULL ELSE upper(lang) END, 'AED') AS currency,
  CASE WHEN lang = 'es' THEN 25.0 ELSE (n_chars % 30)::DOUBLE END AS w1, CASE WHEN lang = 'es' THEN 10.0 ELSE 5.0 END::DOUBLE AS w2 FROM documents
""")
def h22(spark, d):
    lang = F.col("lang")
    w = requirements.weights_or_default(
        {"relevantExperience": (F.col("n_chars") % 30).cast("double"), "leadership": F.when(lang != "es", 5.0)},
        {"relevantExperience": 25.0, "leadership": 10.0},
    )
    return _docs(spark, d).select(
        "doc_id",
        F.array_join(requirements.clean_list(F.array(F.concat(F.lit("  "), "source"), F.lit(" NULL "), F.lit(""), F.concat("lang", F.lit("\t")))), "|").alias("must"),
        requirements.clean_text(F.when(lang == "de", " null ").otherwise(lang)).alias("education"),
        requirements.clean_required(F.when(lang == "fr", "  ").otherwise(F.upper("lang")), "AED").alias("currency"),
        w["relevantExperience"].alias("w1"), w["leadership"].alias("w2"),
    )


@query("a21_request_table", f"""
WITH {head_sql('documents', 'text')},
s0 AS (SELECT doc_id, source, CASE WHEN header_name IS NULL THEN text ELSE replace(text, header_name, '[NAME]') END AS text FROM documents JOIN nm USING (doc_id)),
s1 AS (SELECT doc_id, source, {SCRUBBED_SQL.replace("{x}", "text")} AS t FROM s0),
s2 AS (SELECT doc_id, source, {SCRUBBED2_SQL.replace("{x}", "t")} AS t FROM s1),
s3 AS (SELECT doc_id, list_transform(string_split(trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), E' \\n'), E'\\n'), lambda x: trim(x)) AS ls FROM s2),
s4 AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM s3),
s5 AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS k FROM s4 WHERE x <> ''),
s6 AS (SELECT doc_id, trim(substr(string_agg(x, E'\\n' ORDER BY i), 1, 2000), E' \\n') AS short FROM s5 WHERE k = 1 GROUP BY 1),
s7 AS (SELECT s2.doc_id, source, coalesce(short, '') AS short FROM s2 LEFT JOIN s6 USING (doc_id)),
s8 AS (SELECT *, regexp_matches(short, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b') AS bad FROM s7)
SELECT doc_id, source, CASE WHEN bad THEN 'quarantine' ELSE 'ready' END AS state, CASE WHEN NOT bad THEN E'CV text:\\n' || short || E'\\n\\nInclude flags when date issues are explicit.' END AS user_text,
  E'Must:' || 'item ' || item_id || E'\\nNice:none\\nMinYears:' || item_id || E'\\nEdu:n\\nLoc:Dubai\\nDB:none\\nW:fit:60,skill:40' AS system_text
FROM s8 JOIN benchmark ON source = 'src' || item_id
""")
def a21(spark, d):
    none = F.array().cast("array<string>")
    jobs = table(spark, d, "benchmark").select(
        F.concat(F.lit("src"), "item_id").alias("source"),
        requests.rubric_block(
            F.array(F.concat(F.lit("item "), "item_id")), none, F.col("item_id"), F.lit(None).cast("string"),
            F.lit("Dubai"), none, [("fit", F.lit(60)), ("skill", F.lit(40))],
        ).alias("system_text"),
    )
    return requests.request_table(_busy_docs(spark, d), jobs, "source", "doc_id")


# the wording of a request comes from the caller: system and user text of each kind
REQUESTS = {
    "clarify": ("Ask what the posting leaves open.", "Posting {source}, {chars} characters.\n{text}"),
    "rubric": ("Draft a rubric from the posting.", "Place: {place}\n{text}"),
    "identity": ("Read name and contact from pages.", "{text}"),
    "experience": ("Read employers and dates from pages.", "Source {source}\n{text}"),
    "score": ("Score the text against {source}.", "{text}\nPlace: {place}"),
}
RULES = {"en": "Answer in English.", "de": "Answer in German.", "fr": "Answer in French."}


@query("a21_request_texts", """
WITH k AS (SELECT doc_id, ['clarify', 'rubric', 'identity', 'experience', 'score', 'other'][doc_id % 6 + 1] AS kind, coalesce(nullif(source, ''), 'none') AS source,
  CASE WHEN lang = 'es' OR lang = '' THEN 'none' ELSE coalesce(lang, 'none') END AS place, coalesce(n_chars::VARCHAR, 'none') AS chars, coalesce(nullif(text, ''), 'none') AS text,
  CASE lang WHEN 'de' THEN 'Answer in German.' WHEN 'fr' THEN 'Answer in French.' ELSE 'Answer in English.' END AS rule FROM documents)
SELECT doc_id, kind, CASE kind WHEN 'clarify' THEN 'Ask what the posting leaves open.' WHEN 'rubric' THEN 'Draft a rubric from the posting.' WHEN 'identity' THEN 'Read name and contact from pages.'
    WHEN 'experience' THEN 'Read employers and dates from pages.' WHEN 'score' THEN 'Score the text against ' || source || '.' END || E'\\n' || rule AS system_text,
  CASE kind WHEN 'clarify' THEN 'Posting ' || source || ', ' || chars || E' characters.\\n' || text WHEN 'rubric' THEN 'Place: ' || place || E'\\n' || text WHEN 'identity' THEN text
    WHEN 'experience' THEN 'Source ' || source || E'\\n' || text WHEN 'score' THEN text || E'\\nPlace: ' || place END AS user_text FROM k
""")
def a21_texts(spark, d):
    kinds = F.array(*map(F.lit, [*REQUESTS, "other"]))
    docs = table(spark, d, "documents").withColumn("kind", F.get(kinds, (F.col("doc_id") % 6).cast("int")))
    values = {"source": F.col("source"), "chars": F.col("n_chars"), "text": F.col("text"), "place": F.when(F.col("lang") != "es", F.col("lang"))}
    return requests.request_texts(docs, ["doc_id"], "kind", REQUESTS, values, F.col("lang"), RULES, "en")
