"""Text functions as Column expressions. Nothing here leaves the JVM except NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.functions.arrays import bind, indexed

# What JavaScript counts as white space, as a regex class.
WS = (
    r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
WS_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ASCII word edges (Java's \b would also see letters such as é).
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"
# An ASCII word edge on a side where either kind of neighbour may stand.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Patterns of the scrub and of contact extraction.
MAIL = r"[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"
PROFILE_URL = r"(?:https?://)?(?:www\.)?linkedin\.com/(?:in|pub)/[A-Za-z0-9_%.-]+/?"
PROFILE_URL_HEAD = r"(?:https?://)?(?:www\.)?linkedin\.com/(?:in|pub)/"
PHONE_LABEL = r"(?:tel|phone|mobile|cell|whatsapp)"
PHONE_ANY = (  # the look-ahead names what a match may begin with, so most places fail at once
    rf"(?=[tpmcwTPMCW0-9+(])(?:{PHONE_LABEL}{WS}*[:\-]?{WS}*)?(?:(?:\+|00)[0-9]{{1,3}}(?:{WS}|[.-])?)?"
    rf"(?:\(?0?[0-9]{{2,4}}\)?(?:{WS}|[.-])?)?[0-9]{{3,4}}(?:{WS}|[.-])?[0-9]{{3,4}}"
)
SECTION_TITLES = (
    "professional summary", "key achievements", "curriculum vitae", "resume", "cv",
    "profile", "objective", "education", "experience", "skills", "contact", "summary",
    "work history", "personal details",
)
ROLE_WORDS = (
    "accountant", "engineer", "manager", "developer", "director", "analyst",
    "consultant", "officer", "specialist", "supervisor", "assistant", "chief",
    "trainee", "senior", "junior", "lead", "bookkeeper",
)
LABELLED = (
    "date of birth", r"d\.?o\.?b\.?", "born", "birthday", "nationality", "citizenship",
    "gender", "sex", "marital status",
)
PLACEHOLDERS = (
    "NAME", "EMAIL", "PHONE", "LINKEDIN", "NATIONALITY", "AGE", "GENDER",
    "MARITAL STATUS", "PHOTO", "DATE OF BIRTH",
)
EMPTY_MARKERS = (
    "", "null", "n/a", "na", "none", "unknown", "not specified", "not stated", "-", "—",
)
NOT_STATED = "Not stated"
# Section headers recognised when a text is shortened, in output order.
SECTION_HEADERS = {
    "summary": r"(summary|profile|objective|about|professional summary|الملخص|نبذة)",
    "experience": r"(experience|work experience|employment|career|الخبرة|الخبرات|التوظيف)",
    "education": r"(education|academic|qualifications|التعليم|المؤهلات)",
    "skills": r"(skills|technical skills|competenc|المهارات)",
    "certifications": r"(certifications?|licen[cs]es?|courses|الشهادات|التراخيص)",
}
DROPPED_HEADERS = (
    r"(references?|hobbies|interests|declaration|i hereby|personal details|passport"
    r"|national id|المراجع|الهوايات)"
)
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_INDIC = "۰۱۲۳۴۵۶۷۸۹"
YEAR_UNITS = r"(?:years?|yrs?|سنة|سنوات|عام|أعوام)"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze_ws(c: Column) -> Column:
    """Trim, and turn each run of white space into one space."""
    return F.regexp_replace(trim_ws(c), rf"{WS}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def lines(c: Column) -> Column:
    return F.split(c, "\r?\n", -1)


def is_section_title(c: Column) -> Column:
    return trim_ws(c).rlike(rf"(?iu)\A(?:{'|'.join(SECTION_TITLES)})\z")


def looks_like_name(c: Column) -> Column:
    word = r"[\p{L}'’-]+"
    return (
        (F.length(c) <= 60)
        & c.rlike(rf"\A{word}(?:{WS}+{word}){{1,4}}\z")
        & ~c.rlike(r"\A[a-z ]+\z")
        & ~is_section_title(c)
        & ~c.rlike(rf"(?iu){EDGE_L}(?:{'|'.join(ROLE_WORDS)}){EDGE_R}")
    )


def header_name(text: Column) -> Column:
    """First of the first eight filled lines that reads like a personal name."""
    # take only the part of the text that holds those lines
    top = F.regexp_extract(text, rf"\A(?:{WS}*+[^\n]++\n?+){{0,8}}", 0)
    filled = F.filter(F.transform(lines(top), trim_ws), lambda x: F.length(x) > 0)
    return F.get(F.filter(F.slice(filled, 1, 8), looks_like_name), F.lit(0))


def scrub(text: Column) -> Column:
    """Replace personal data by placeholders; the order of the steps matters."""
    name = header_name(text)
    # \\Q..\\E quotes the name; a name made of letters cannot contain \\E.
    out = F.coalesce(
        F.regexp_replace(text, F.concat(F.lit(r"(?iu)\Q"), name, F.lit(r"\E")), F.lit("[NAME]")),
        text,
    )
    tail = rf"{WS}*[:：\-]{WS}*[^\n]*"
    # look-aheads name what a match may begin with, so that most places fail at their first character
    label = rf"(?=[dbncgsm])(?:{'|'.join(LABELLED)}){WS}*[:：\-]"
    # of a run of line ends only the first begins a match: a run of n costs n, not n squared
    age = rf"(?:\A|\n(?<!\n\n)){WS}*+age"
    # the text up to the end of the last line that any step below can change; what follows is not searched again
    touched = (
        rf"(?is)\A.*(?:[+(0-9][0-9().\-{WS}]{{6,}}+|{label}{WS}*+|{age}{WS}*+[:\-]?{WS}*+[0-9]|(?=[ph])(?:photo|headshot))[^\n]*+"
    )
    # (cheap test, steps): most texts fail the test and skip the costly patterns
    groups = (
        (
            "[0-9]",
            [
                # one class and possessive runs: constant stack, one pass
                (rf"(?i)(?=[tpmcw]){PHONE_LABEL}{WS}*+[:\-]?{WS}*+[+0-9][0-9().\-{WS}]{{6,}}+", "[PHONE]"),
                (
                    rf"(?=[+0])(?:\+|00)[0-9]{{1,3}}(?:{WS}|[.-])?\(?[0-9]{{2,4}}\)?(?:{WS}|[.-])?"
                    rf"[0-9]{{3,4}}(?:{WS}|[.-])?[0-9]{{3,4}}{EDGE_R}",
                    "[PHONE]",
                ),
                (rf"(?=[(0-9])\(?[0-9]{{3}}\)?(?:{WS}|[.-])[0-9]{{3}}(?:{WS}|[.-])[0-9]{{4}}{EDGE_R}", "[PHONE]"),
            ],
        ),
        (
            f"(?i){label}",
            [(rf"(?i)(?=[db]){EDGE_L}(?:date of birth|d\.?o\.?b\.?|born|birthday){tail}", "[DATE OF BIRTH]")],
        ),
        (
            f"(?i){age}",
            [(rf"(?i){age}{WS}*[:\-]?{WS}*[0-9]{{1,2}}{EDGE_R}", "\n[AGE]")],
        ),
        (
            f"(?i){label}",
            [
                (rf"(?i)(?=[nc]){EDGE_L}(?:nationality|citizenship){tail}", "[NATIONALITY]"),
                (rf"(?i)(?=[gs]){EDGE_L}(?:gender|sex){EDGE_R}{tail}", "[GENDER]"),
                (rf"(?i)(?=m){EDGE_L}marital status{EDGE_R}{tail}", "[MARITAL STATUS]"),
            ],
        ),
        (
            "(?i)photo|headshot",
            [(rf"(?i)(?=[ph])(?:profile{WS}*)?(?:photo|photograph|headshot|passport photo){EDGE_R}", "[PHOTO]")],
        ),
    )

    def guarded(value: Column, test: str, steps: list[tuple[str, str]]) -> Column:
        def apply(t: Column) -> Column:
            new = t
            for pattern, mark in steps:
                new = F.regexp_replace(new, pattern, mark)
            return F.when(t.rlike(test), new).otherwise(t)

        return bind(value, apply)

    def unlinked(line: Column) -> Column:
        found = F.contains(F.lower(line), F.lit("linkedin.com/"))
        return F.when(found, F.regexp_replace(line, rf"(?i)(?=[hwl]){PROFILE_URL}", "[LINKEDIN]")).otherwise(line)

    def unmailed(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("@")), F.regexp_replace(line, rf"(?i){EDGE}{MAIL}{EDGE_R}", "[EMAIL]")).otherwise(line)

    # links and mails never cross a line end, so only the lines that hold one are searched
    def by_line(t: Column) -> Column:
        marked = F.contains(F.lower(t), F.lit("linkedin.com/")) | F.contains(t, F.lit("@"))
        done = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: bind(unlinked(x), unmailed)), "\n")
        return F.when(marked, done).otherwise(t)

    def marked_up_to(t: Column, head: Column) -> Column:
        new = head
        for test, steps in groups:
            new = guarded(new, test, steps)
        return F.concat(new, F.substr(t, F.length(head) + 1))

    out = bind(out, by_line)
    # lengths of invalid UTF-8 are not those of what a pattern sees of it: such a text is searched whole
    out = bind(out, lambda t: bind(
        F.when(F.is_valid_utf8(t), F.regexp_extract(t, touched, 0)).otherwise(t), lambda head: marked_up_to(t, head)
    ))
    out = bind(out, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t))
    return trim_ws(out)


def contains_placeholder(text: Column) -> Column:
    return text.rlike(rf"(?iu)\[(?:{'|'.join(PLACEHOLDERS)})\]")


def has_raw_pii(text: Column) -> Column:
    return (F.contains(text, F.lit("@")) & text.rlike(rf"(?i){EDGE}{MAIL}{EDGE_R}")) | text.rlike(rf"(?i){PROFILE_URL_HEAD}")


def _first_match(text: Column, pattern: str) -> Column:
    """First match, trimmed, null without one; a list of one value, so that the text is searched once."""
    found = F.array(trim_ws(F.regexp_extract(text, pattern, 0)))
    return F.get(F.filter(found, lambda x: F.length(x) > 0), F.lit(0))


def first_mail(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), _first_match(text, rf"(?i){EDGE}{MAIL}{EDGE_R}"))


def first_profile_url(text: Column) -> Column:
    return _first_match(text, rf"(?i)(?=[hwl]){PROFILE_URL}")


def first_phone(text: Column, strict: bool = False) -> Column:
    """First phone-like run. ``strict`` refuses spans such as 2018-2021."""
    found = _first_match(text, rf"(?i){PHONE_ANY}{EDGE_R}")
    if strict:
        found = F.when(~found.rlike(r"\A(?:19|20)[0-9]{2}\W?(?:19|20)[0-9]{2}\z"), found)
    return found


def contact_fields(text: Column) -> Column:
    """Struct of full name, mail, phone and profile URL, null where the text has none."""
    return F.struct(
        header_name(text).alias("full_name"), first_mail(text).alias("email"), first_phone(text).alias("phone"),
        first_profile_url(text).alias("linkedin"),
    )


def name_from_file(file_name: Column) -> Column:
    base = F.regexp_replace(file_name, r"\.[^.]+$", "")
    base = squeeze_ws(F.regexp_replace(base, r"_+", " "))
    base = F.regexp_replace(
        base, rf"(?iu){EDGE_L}(?:cv|resume|updated|copy|final|ats|new|old){EDGE_R}", ""
    )
    base = F.regexp_replace(base, r"\([0-9]+\)", "")
    base = F.regexp_replace(base, r"[0-9]{5,}", "")
    base = squeeze_ws(F.regexp_replace(base, r"-+", " "))
    n_words = F.size(F.split(base, rf"{WS}+", -1))
    return F.when(
        (F.length(base) >= 3)
        & ~is_section_title(base)
        & (n_words.between(2, 6) | (F.length(base) >= 4)),
        base,
    )


def display_name(full_name: Column, file_name: Column) -> Column:
    usable = (F.length(full_name) > 0) & ~is_section_title(full_name)
    return F.when(usable, full_name).otherwise(name_from_file(file_name))


def labelled_nationality(text: Column) -> Column:
    found = F.regexp_extract(
        text, rf"(?iu)(?:nationality|citizenship|الجنسية){WS}*[:：\-]{WS}*([^\n|•]{{2,60}})", 1
    )
    stop = (
        rf"(?iu){EDGE_L}(?:visa|marital|sex|gender|driving|date of birth|d\.?o\.?b){EDGE_R}"
    )
    head = F.get(F.split(squeeze_ws(found), stop), F.lit(0))
    value = trim_ws(F.regexp_replace(head, rf"[:–—\-,;/{WS}]+$", ""))
    return F.when(
        F.length(value).between(2, 40)
        & ~value.rlike(r"[0-9]")
        & ~value.rlike(r"(?iu)\A(?:n/a|na|none|unknown|not specified|null)\z"),
        value,
    )


def collapse_blank(text: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def near_empty(text: Column, min_chars: int = 80) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")) < min_chars


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, longer than two characters."""
    spaced = F.regexp_replace(F.lower(text), rf"(?:[^\p{{L}}\p{{N}}])+", " ")
    return F.filter(F.split(spaced, " "), lambda w: F.length(w) > 2)


def canonical_answer(text: Column) -> Column:
    """Answer form for equality: NFKC, lower case, folded Arabic letters and digits."""
    folded = F.lower(nfkc(text))
    folded = F.regexp_replace(folded, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    folded = F.translate(folded, "أإآى" + ARABIC_INDIC + EXTENDED_INDIC, "اااي" + "0123456789" * 2)
    return squeeze_ws(F.regexp_replace(folded, r"[\p{P}\p{S}]", " "))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_INDIC + EXTENDED_INDIC, "0123456789" * 2)


def script_class(text: Column) -> Column:
    arabic = text.rlike(r"[\x{0600}-\x{06FF}]")
    latin = text.rlike(r"[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "ar").otherwise("en")


@F.pandas_udf(T.StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """NFKC form. Only rows that hold a character the form can change travel to
    Python; ASCII and the plain Latin-1 letters are already normal."""
    risky = F.when(text.rlike(r"[^\x00-\x7F\x{00C0}-\x{00FF}]"), text)
    return F.coalesce(_nfkc_batch(risky), text)


def canonical_hash(scrubbed: Column) -> Column:
    """Hash of the scrubbed text in normal form: equal for copies of one document.
    Give it a stored column: the text is read more than once."""
    return F.sha2(squeeze_ws(F.lower(nfkc(scrubbed))), 256)


def truncate(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n\n[TRUNCATED]"))
    ).otherwise(text)


def drop_repeated_lines(text: Column) -> Column:
    """First spelling of each line stays; runs of blank lines become one.

    Works inside the row: lines are sorted with their position, the first of
    each equal run stays, and the rest is put back in order (n log n per text,
    no shuffle).
    """
    return bind(indexed(F.transform(lines(text), trim_ws)), _without_repeats)


def _without_repeats(rows: Column) -> Column:
    filled = F.filter(rows, lambda r: F.length(r["x"]) > 0)
    keyed = F.sort_array(
        F.transform(filled, lambda r: F.struct(F.lower(r["x"]).alias("key"), r["i"].alias("i"), r["x"].alias("x")))
    )
    firsts = bind(
        keyed,
        lambda s: F.filter(s, lambda r, i: (i == 0) | (r["key"] != F.get(s, i - 1)["key"])),
    )
    kept = F.transform(firsts, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))
    blanks = F.filter(rows, lambda r: F.length(r["x"]) == 0)
    merged = bind(
        F.sort_array(F.concat(kept, blanks)),
        lambda s: F.filter(
            s, lambda r, i: (F.length(r["x"]) > 0) | (i == 0) | (F.length(F.get(s, i - 1)["x"]) > 0)
        ),
    )
    return F.array_join(F.transform(merged, lambda r: r["x"]), "\n")


def section_of_header(line: Column) -> Column:
    """Section a header line opens; null for any other line. ``line`` is trimmed."""

    def classify(bare: Column) -> Column:
        out = F.when(line.rlike(rf"(?iu)\A{DROPPED_HEADERS}\z"), "other")
        for section, pattern in SECTION_HEADERS.items():
            out = out.when(bare.rlike(rf"(?iu)\A{pattern}\z"), section)
        # no header word is longer than 40 characters
        return F.when(F.length(bare) <= 40, out)

    return bind(F.ltrim(F.rtrim(line, F.lit(WS_CHARS + ":")), F.lit(WS_CHARS)), classify)


def shorten_by_section(text: Column, limit: int) -> Column:
    """Keep the sections in a fixed order within a character budget.

    Header lines cut the text into segments (array slices, linear in the number
    of lines); each section is the join of its segments.
    """
    cleaned = drop_repeated_lines(collapse_blank(text))

    def shorten(clean: Column) -> Column:
        filled = F.filter(F.transform(F.split(clean, "\n"), trim_ws), lambda x: F.length(x) > 0)
        return bind(filled, lambda body: _sections(clean, body, limit))

    return bind(cleaned, shorten)


def _sections(clean: Column, body: Column, limit: int) -> Column:
    heads = F.filter(
        F.transform(
            body, lambda x, i: F.struct((i + 1).alias("at"), section_of_header(x).alias("section"))
        ),
        lambda h: h["section"].isNotNull(),
    )
    heads = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("other").alias("section"))), heads)
    segments = bind(
        heads,
        lambda hs: F.transform(
            hs,
            lambda h, i: F.struct(
                h["section"].alias("section"),
                F.slice(
                    body,
                    h["at"] + 1,
                    F.greatest(
                        F.lit(0),
                        F.coalesce(F.get(hs, i + 1)["at"], F.size(body) + 1) - h["at"] - 1,
                    ),
                ).alias("part"),
            ),
        ),
    )

    def budgeted(segs: Column) -> Column:
        def block(section: str) -> Column:
            chosen = F.filter(segs, lambda s: s["section"] == section)
            return F.array_join(F.flatten(F.transform(chosen, lambda s: s["part"])), "\n")

        blocks = F.array(*[block(name) for name in (*SECTION_HEADERS, "other")])
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(0).alias("n"))

        def add(acc: Column, part: Column) -> Column:
            room = F.greatest(F.lit(0), F.lit(limit) - acc["used"])
            cut = F.when(F.length(part) > room, F.substring(part, F.lit(1), room)).otherwise(part)
            joined = F.when(acc["n"] == 0, cut).otherwise(F.concat(acc["out"], F.lit("\n"), cut))
            # +1 pays for the newline between sections
            return F.when(
                (F.length(part) == 0) | (room == 0), acc
            ).otherwise(
                F.struct(
                    joined.alias("out"),
                    (acc["used"] + F.length(cut) + 1).alias("used"),
                    (acc["n"] + 1).alias("n"),
                )
            )

        return trim_ws(F.aggregate(blocks, start, add)["out"])

    return bind(
        bind(segments, budgeted),
        lambda joined: F.when(F.length(joined) > 0, F.substring(joined, 1, limit)).otherwise(
            F.substring(clean, 1, limit)
        ),
    )


def page_marked(pages: Column, fallback: Column) -> Column:
    marked = F.transform(
        pages,
        lambda p, i: trim_ws(F.concat(F.lit("[[PAGE "), (i + 1).cast("string"), F.lit("]]\n"), p)),
    )
    return F.when(F.size(pages) == 0, fallback).otherwise(F.array_join(marked, "\n\n"))


def page_label(pages: Column) -> Column:
    return F.when(F.size(pages) == 0, "N/A").otherwise("")


def string_members(json_text: Column) -> Column:
    """String members of a JSON array; anything unreadable gives an empty array."""
    parsed = F.try_parse_json(json_text)
    as_list = F.when(
        F.schema_of_variant(parsed).startswith("ARRAY"), parsed
    ).cast("array<variant>")
    texts = F.transform(
        F.filter(as_list, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")
    )
    return F.coalesce(texts, F.array().cast("array<string>"))


def years_stated(text: Column) -> Column:
    """Largest number that stands before a year word; null when there is none."""
    found = F.regexp_extract_all(
        text, F.lit(rf"(?i)([0-9]+(?:\.[0-9]+)?){WS}*\+?{WS}*{YEAR_UNITS}"), F.lit(1)
    )
    return F.array_max(F.transform(found, lambda v: v.cast("double")))


def keyword_ratio(lower_text: Column, needles: Column) -> Column:
    """Share of needles found as substrings of a lower-case text; blank needles
    stay in the divisor."""
    words = F.transform(needles, lambda n: F.lower(trim_ws(n)))
    hits = F.filter(words, lambda w: (F.length(w) > 1) & F.contains(lower_text, w))
    return F.when(F.size(needles) == 0, F.lit(0.0)).otherwise(F.size(hits) / F.size(needles))


def stated(c: Column) -> Column:
    """Null when the value is one of the empty markers."""
    value = squeeze_ws(F.coalesce(c, F.lit("")))
    return F.when(~F.lower(value).isin(*EMPTY_MARKERS), value)


def or_not_stated(c: Column) -> Column:
    return F.coalesce(stated(c), F.lit(NOT_STATED))


def display_value(c: Column, missing: str = NOT_STATED) -> Column:
    return F.coalesce(blank_to_null(trim_ws(c.cast("string"))), F.lit(missing))


def join_list(c: Column, sep: str = "; ") -> Column:
    kept = F.filter(F.transform(c, trim_ws), lambda x: F.length(x) > 0)
    return F.coalesce(blank_to_null(F.array_join(kept, sep)), F.lit(NOT_STATED))


def safe_file_name(name: Column) -> Column:
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"[^A-Za-z0-9_.\- ()+]", "_")
    return F.coalesce(blank_to_null(trim_ws(F.substring(base, 1, 180))), F.lit("cv"))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]*)$", 1))


def stored_file_name(name: Column, run_id: str, index: Column) -> Column:
    safe = safe_file_name(name)
    ext = file_extension(safe)
    stem = F.substring(safe, F.lit(1), F.greatest(F.lit(1), F.length(safe) - F.length(ext)))
    return F.concat_ws("-", F.lit(run_id), index.cast("string"), F.concat(stem, ext))


def safe_file_part(value: Column) -> Column:
    cut = F.substring(F.regexp_replace(value, r"[^A-Za-z0-9_\x{0600}-\x{06FF}.-]+", "_"), 1, 80)
    return F.coalesce(blank_to_null(cut), F.lit("export"))


def csv_cell(c: Column, quote_on_cr: bool = True) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    needs = text.rlike('[",\n\r]' if quote_on_cr else '[",\n]')
    return F.when(
        needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(text)


def mail_ok(c: Column) -> Column:
    free = rf"(?:(?!{WS})[^@])"
    return F.coalesce(c == "", F.lit(True)) | c.rlike(rf"\A{free}+@{free}+\.{free}+\z")


def phone_ok(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True)) | ascii_digits(c).rlike(r"\A\+?[0-9 ()-]{7,24}\z")


def profile_url_ok(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True)) | c.rlike(r"(?iu)\Ahttps://(?:www\.)?linkedin\.com/(?:in|pub)/")


def redact_values(items: Column, values: list[Column]) -> Column:
    """Replace known personal values inside each list item, then scrub the item."""

    def one(item: Column) -> Column:
        out = item
        for value in values:
            quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
            out = F.when(
                F.length(value) > 0, F.regexp_replace(out, quoted, F.lit("[REDACTED]"))
            ).otherwise(out)
        return F.regexp_replace(scrub(F.concat(F.lit("Skills: "), out)), r"\ASkills: ", "")

    return F.transform(items, one)
