"""Scalar column expressions for messy question-answer records: trimming, aliases, yes/no parsing, ids, names, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_OBJECT = "unknown"
# The question whose object is named, and the words that answer it.
OBJECT_QUESTION = r"(?iUd)^\s*is there\s+(?:a|an)\s+(.+?)\s+in the image\?\s*$"
YES_WORDS, NO_WORDS = ("yes", "y", "1", "true", "present"), ("no", "n", "0", "false", "absent")
STRICT_YES, STRICT_NO = ("yes", "1", "true", "present"), ("no", "0", "false", "absent")
BYTE_UNITS = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "tb": 1000**4, "kib": 1024, "mib": 1024**2, "gib": 1024**3, "tib": 1024**4}
WHOLE_YES_NO = r"(?iu)(?<![\p{L}\p{N}_])(yes|no)(?![\p{L}\p{N}_])"  # word characters as Python has them: no marks
QUESTION_SUFFIX = "Respond with only one word: yes or no."


def trimmed(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space; null becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def text_or_null(c: Column | str) -> Column:
    """Trimmed, and null where nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def first_text(*cols: Column | str) -> Column:
    """The first that is not blank, else ''."""
    return F.coalesce(*[text_or_null(c) for c in cols], F.lit(""))


def truthy_text(c: Column | str) -> Column:
    """Null where a scripting language would take the value for false: null, '', 0, 0.0 and false."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(~s.isin("", "0", "0.0", "false"), s)


def yes_no_label(text: Column) -> Column:
    """1, 0 or null from a label's text."""
    t = F.lower(trimmed(text))
    return F.when(t.isin(*YES_WORDS), 1).when(t.isin(*NO_WORDS), 0)


def yes_no_number(n: Column) -> Column:
    """1 for positive numbers, else 0; null stays."""
    return F.when(n.isNotNull(), (n > 0).cast("int"))


def variant_label(v: Column) -> Column:
    """Label of a JSON value: booleans as they are, whole numbers by sign, other values by their text."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "bigint")
    flag = F.try_variant_get(v, "$", "boolean")
    return F.when(kind == "BOOLEAN", flag.cast("int")).when(kind == "BIGINT", yes_no_number(number)).otherwise(yes_no_label(F.try_variant_get(v, "$", "string")))


def strict_label(text: Column) -> Column:
    """1 or 0; anything else raises."""
    t = F.lower(trimmed(text))
    return F.when(t.isin(*STRICT_YES), 1).when(t.isin(*STRICT_NO), 0).otherwise(F.raise_error(F.concat(F.lit("unsupported label: "), F.coalesce(text, F.lit("null")))).cast("int"))


def yes_no_answer(text: Column | str) -> Column:
    """1 or 0 by the first whole word yes or no in a free answer, else null."""
    text = F.col(text) if isinstance(text, str) else text
    word = F.lower(F.regexp_extract(text, WHOLE_YES_NO, 1))
    return F.when(word == "yes", 1).when(word != "", 0)


def response_answer(text: Column | str) -> Column:
    """As ``yes_no_answer``, thinking tags taken for spaces."""
    text = F.col(text) if isinstance(text, str) else text
    return yes_no_answer(F.replace(F.replace(text, F.lit("<think>"), F.lit(" ")), F.lit("</think>"), F.lit(" ")))


def image_id(path: Column, explicit: Column | None = None) -> Column:
    """The explicit id if it is not blank, else the last run of digits of the path without leading zeros, else ''."""
    last = F.try_element_at(F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1))
    found = F.coalesce(F.regexp_replace(last, "^0+(?=.)", ""), F.lit(""))
    return found if explicit is None else F.coalesce(text_or_null(explicit), found)


def image_number(path: Column) -> Column:
    """The last run of digits as a number; raises if there is none."""
    return F.when(image_id(path) == "", F.raise_error(F.concat(F.lit("no image id in "), path)).cast("decimal(38,0)")).otherwise(image_id(path).cast("decimal(38,0)"))


def object_name(question: Column, *explicit: Column) -> Column:
    """The first explicit name that is not blank, else the one that the question asks for in lower case, else 'unknown'."""
    asked = F.nullif(F.lower(F.regexp_extract(question, OBJECT_QUESTION, 1)), F.lit(""))
    return F.coalesce(*[text_or_null(c) for c in explicit], asked, F.lit(UNKNOWN_OBJECT))


def question_text(template: str, name: Column, *given: Column) -> Column:
    return F.coalesce(*[text_or_null(c) for c in given], F.replace(F.lit(template), F.lit("{object_name}"), name))


def formatted_question(question: Column | str, suffix: str = QUESTION_SUFFIX) -> Column:
    """The question with the suffix once, after a full stop if it has no end mark."""
    q = trimmed(question)
    ended = F.when(q.rlike(r"[?.!]$"), q).otherwise(F.concat(q, F.lit(".")))
    return F.when(F.contains(F.lower(q), F.lit(suffix.lower())), q).otherwise(F.concat_ws(" ", ended, F.lit(suffix)))


def rate_text(n: Column, d: Column) -> Column:
    """``n / d`` with at most six decimals and no trailing zeros; null unless d > 0."""
    six = F.format_string("%.6f", F.bround(F.try_divide(n.cast("double"), d.cast("double")), 6))
    return F.when(d > 0, F.regexp_replace(F.regexp_replace(six, "0+$", ""), r"\.$", ""))


def byte_size(text: Column | str) -> Column:
    """Bytes of sizes like '10GiB', '500 MB' or '1024'; null where it is no size."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$"
    units = F.create_map(*[x for u, m in BYTE_UNITS.items() for x in (F.lit(u), F.lit(float(m)))])
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.floor(number * F.try_element_at(units, F.lower(F.regexp_extract(text, pattern, 2))))


def absolute_path(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", F.lit(root), path))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def layer_bounds(total: Column, part: str) -> tuple[Column, Column]:
    """First and last layer of the first half, the middle half, the second half, or of all."""
    quarter, half = F.floor(total / 4), F.floor(total / 2)
    return {"early": (F.lit(0), F.greatest(half - 1, F.lit(0))), "middle": (quarter, total - quarter - 1), "late": (half, total - 1), "all": (F.lit(0), total - 1)}[part]


def spaced_layers(start: Column, end: Column, count: Column) -> Column:
    """``count`` layers evenly between two, halves rounded to even; a single one in the middle."""
    gap = (end - start) / F.greatest(count - 1, F.lit(1))
    many = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda s: F.bround(start + s * gap).cast("int"))
    return F.when(count == 1, F.array(F.floor((start + end) / 2).cast("int"))).otherwise(many)


def quarter_layers(total: Column) -> Column:
    """First, quarter, half, three quarters and last layer."""
    n = total.cast("int")
    return F.array(F.lit(0), *[F.floor(n * k / 4).cast("int") for k in (1, 2, 3)], n - 1)


def population_class(label: Column, parsed: Column) -> Column:
    """Of a row with its true label and the parsed answer."""
    return (
        F.when(label.isNull() | ~label.isin(0, 1), "invalid_label")
        .when(parsed.isNull(), "parsed_none")
        .when(parsed == label, "correct")
        .when((label == 0) & (parsed == 1), "hard_hallucination")
        .otherwise("false_negative_error")
    )
