"""Contracts of stored JSON, from a declared schema.

A contract is a ``StructType`` whose fields carry their limits as metadata; ``broken_rules`` turns it into one list of rule names,
for every field and every element of lists and records. Documents are parsed once into Spark's variant type, so a
value of the wrong type is a finding and not a failed read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, MapType, StringType, StructField, StructType

from rankmill.functions.text import trim_ws


def text(name: str, nullable: bool = False, **limits) -> StructField:
    return StructField(name, StringType(), nullable, limits)


def number(name: str, nullable: bool = False, **limits) -> StructField:
    return StructField(name, DoubleType(), nullable, limits)


def flag(name: str, nullable: bool = False, **limits) -> StructField:
    return StructField(name, BooleanType(), nullable, limits)


def listed(name: str, element: StructField | StructType, nullable: bool = False, **limits) -> StructField:
    """A list; a single field as ``element`` gives the limits of each value."""
    return StructField(name, ArrayType(_element(element)), nullable, limits)


def record(name: str, value: StructField | StructType, nullable: bool = False, **limits) -> StructField:
    """An object of any keys."""
    return StructField(name, MapType(StringType(), _element(value)), nullable, limits)


def group(name: str, fields: StructType, nullable: bool = False, **limits) -> StructField:
    return StructField(name, fields, nullable, limits)


def _element(element: StructField | StructType) -> DataType:
    # a value with limits travels as a structure of one nameless field
    return element if isinstance(element, StructType) else StructType([StructField("", element.dataType, element.nullable, element.metadata)])


def _named(name: str, broken: Column) -> Column:
    """A list of the rule's name where the rule is broken, else an empty one."""
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def _many(value: Column, kind: DataType) -> Column:
    """The elements of a list or the values of a record, null where the value is neither."""
    if isinstance(kind, ArrayType):
        return F.try_variant_get(value, "$", "array<variant>")
    return F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))


def _broken_in(value: Column, f: StructField, path: str) -> Column:
    """Names of the broken rules of one field, each value read once."""
    limits, kind = f.metadata, f.dataType

    def judged(right: Column, inner: list[Column]) -> Column:
        absent, null = value.isNull(), F.coalesce(F.is_variant_null(value), F.lit(False))
        wrong = F.when(absent, F.lit(not limits.get("optional", False))).when(null, F.lit(not f.nullable)).otherwise(F.lit(True))
        within = F.concat(*inner) if inner else F.array().cast("array<string>")
        return F.when(right, within).otherwise(_named(f"{path}:type", wrong))

    def limited(x: Column, checks: dict[str, Callable]) -> list[Column]:
        return [_named(f"{path}:{name}", broken(x, limits[name])) for name, broken in checks.items() if name in limits]

    if isinstance(kind, StructType):
        return judged(_is_object(value), [broken_rules(kind, value, path)])
    if isinstance(kind, (ArrayType, MapType)):
        many = isinstance(kind, ArrayType)
        inner = f"{path}[]" if many else f"{path}{{}}"
        element = kind.elementType if many else kind.valueType

        def of_values(values: Column) -> Column:
            each = F.array_distinct(F.flatten(F.transform(values, lambda v: _broken_in_element(v, element, inner))))
            sizes = {"min_items": lambda x, n: F.size(x) < n, "max_items": lambda x, n: F.size(x) > n}
            return judged(values.isNotNull(), [*limited(values, sizes), each])

        return _bound(_many(value, kind), of_values)

    stated = F.schema_of_variant(value)
    if isinstance(kind, DoubleType):
        right = stated.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(stated, F.lit("DECIMAL"))
        checks = {
            "min": lambda x, n: x < n, "max": lambda x, n: x > n, "above": lambda x, n: x <= n, "whole": lambda x, _: x != F.floor(x),
            "enum": lambda x, known: ~x.isin(*known),
        }
    elif isinstance(kind, StringType):
        right = stated == "STRING"
        checks = {
            "enum": lambda s, known: ~s.isin(*known), "min_length": lambda s, n: F.char_length(s) < n, "max_length": lambda s, n: F.char_length(s) > n,
            "pattern": lambda s, form: ~s.rlike(form),
        }
    else:
        right, checks = stated == "BOOLEAN", {"equals": lambda b, wanted: b != wanted}
    plain = F.try_variant_get(value, "$", kind.simpleString())
    return judged(_known(right), limited(plain, checks))


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _broken_in_element(value: Column, element: StructType, path: str) -> Column:
    if len(element.fields) == 1 and element.fields[0].name == "":
        return _broken_in(value, element.fields[0], path)
    return F.concat(_named(f"{path}:type", ~_is_object(value)), broken_rules(element, value, path))


def broken_rules(schema: StructType, value: Column, path: str = "") -> Column:
    """Names (``field.field[]:rule``) of the rules that the document breaks, each once.

    A field is taken out of the document once, and what lies below it is looked at only where its type is right, so
    the work for a document grows with its size and not with rules times depth.
    """
    def of_field(f: StructField) -> Column:
        at = f"{path}.{f.name}" if path else f.name
        return _bound(F.try_variant_get(value, f"$['{f.name}']", "variant"), lambda v: _broken_in(v, f, at))

    return F.concat(*[of_field(f) for f in schema.fields])


def json_violations(df: DataFrame, keys: list[str], document: str, schema: StructType, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per (key, broken rule) of a JSON column; ``more``: rules over the parsed column ``doc``.

    What is no JSON object, null included, breaks ``document:type`` and every field that must be there.
    """
    parsed = df.select(*keys, F.try_parse_json(document).alias("doc"))
    whole = _named("document:type", ~_is_object(F.col("doc")))
    further = [_named(name, broken) for name, broken in (more or {}).items()]
    return parsed.select(*keys, F.explode(F.concat(whole, broken_rules(schema, F.col("doc")), *further)).alias("rule"))


# --- the stored documents; names, values and limits are fixed values ---------------------------

NULLABLE_TEXTS = (
    "fullName", "nationality", "currentLocation", "currentTitle", "lastEmployer", "specialization", "education", "totalExperienceText",
    "availabilityNotice", "expectedSalary", "dataQualityNote", "evidencePages", "phone", "email", "linkedin", "relevantExperienceText",
    "leadershipExperienceText", "uaeExperienceText",
)
TEXT_LISTS = ("softwareSystems", "technicalSkills", "certifications", "courses", "languages", "keyAchievements", "gaps", "inconsistencies")
CANDIDATE = StructType(
    [*[text(n, True) for n in NULLABLE_TEXTS], number("totalYearsExperience", True), *[listed(n, text("")) for n in TEXT_LISTS]]
)
CRITERIA = ("relevantExperience", "leadership", "technicalSkills", "softwareSystems", "achievements", "uaeExperience", "jobFit")
TIERS = (
    "Strong candidate — recommend technical interview", "Good — conditional interview", "Average — reserve list", "Not suitable at this time",
)
SCORE = StructType(
    [
        listed("scores", StructType([text("criterion", enum=list(CRITERIA)), number("score", min=0.0, max=10.0), text("evidence")])),
        flag("dealBreakerHit"), text("strengths"), text("risksAndGaps"), listed("verificationPoints", text("")), text("recommendationNarrative"),
        text("tier", enum=list(TIERS)),
    ]
)
BOTH_LANGUAGES = StructType([text("en", min_length=1), text("ar")])
BLUEPRINT = StructType(
    [
        text("level", enum=["junior", "mid", "senior", "lead"]), number("questionCount", whole=True, above=0.0), number("durationMin", above=0.0),
        number("passMark", min=0.0, max=100.0), group("difficulty", StructType([number("easy"), number("medium"), number("hard")])),
        flag("includesCase"), record("topicWeights", number("", above=0.0)), listed("probes", text("")), listed("uncoveredProbes", text("")),
        group(
            "practical",
            StructType(
                [
                    text("system"), number("timeLimitMin", above=0.0),
                    listed(
                        "steps", StructType([text("id"), group("instruction", BOTH_LANGUAGES), number("points", above=0.0), text("evidence")]),
                        min_items=1,
                    ),
                ]
            ),
        ),
    ]
)
SETTINGS = StructType(
    [
        group(
            "compositeWeights", StructType([number("cv", min=0.0), number("exam", min=0.0), number("interview", min=0.0)]), optional=True
        ),
        listed("relevantExcludedItems", number("", whole=True, enum=[2.0, 3.0, 26.0]), optional=True), text("relevanceReason", optional=True),
        group(
            "blueprintOverrides",
            StructType(
                [
                    number("questionCount", whole=True, min=10.0, max=100.0, optional=True), number("durationMin", above=0.0, optional=True),
                    number("passMark", min=0.0, max=100.0, optional=True),
                ]
            ),
            optional=True,
        ),
        group("marketReference", StructType([text("text"), text("source", min_length=1), text("date")]), True, optional=True),
    ]
)
GRADE_INPUT = StructType(
    [
        record(
            "answers",
            StructType(
                [
                    text("answer"), listed("rubricScores", number("", min=0.0), optional=True), number("override", True, min=0.0, optional=True),
                    text("overrideReason", optional=True),
                ]
            ),
        ),
        record("practical", StructType([number("points", min=0.0), text("evidence", min_length=1)])),
        number("durationMin", True, above=0.0), flag("confirmed", equals=True),
    ]
)
CONFIDENCE = ["high", "medium", "low"]
EVIDENCE = StructType([text("reference", max_length=120), text("snippet", max_length=500), text("confidence", enum=CONFIDENCE)])
FINDING = StructType(
    [
        text("fact", max_length=1800), listed("evidence", EVIDENCE, max_items=8), text("confidence", enum=CONFIDENCE, optional=True),
        flag("insufficientEvidence", optional=True),
    ]
)


def settings_rules() -> dict[str, Column]:
    """Rules between fields of ``SETTINGS``: some weight is positive, and excluded items have a reason."""
    weights = F.col("doc")
    total = sum((F.try_variant_get(weights, f"$.compositeWeights.{w}", "double") for w in ("cv", "exam", "interview")), F.lit(0.0))
    reason = F.coalesce(F.try_variant_get("doc", "$.relevanceReason", "string"), F.lit(""))
    return {
        "compositeWeights:sum": total <= 0,
        "relevanceReason:required": (F.size(F.try_variant_get("doc", "$.relevantExcludedItems", "array<variant>")) > 0) & (F.length(trim_ws(reason)) == 0),
    }
