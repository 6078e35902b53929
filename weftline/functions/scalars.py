"""Column functions: durations, names, buckets, texts that begin with a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units of a duration, in seconds.
UNITS = {"ns": "0.000000001", "us": "0.000001", "µs": "0.000001", "μs": "0.000001", "ms": "0.001", "s": "1", "m": "60", "h": "3600"}
_TOKEN = "([0-9]+[.]?[0-9]*|[.][0-9]+)(ns|us|µs|μs|ms|s|m|h)"
DURATION = f"^[-+]?(0|({_TOKEN})+)$"
#: Error types by status code.
ERROR_TYPES = {
    400: "BadRequestError",
    401: "AuthenticationError",
    403: "PermissionDeniedError",
    404: "NotFoundError",
    422: "UnprocessableEntityError",
    429: "RateLimitError",
    501: "NotImplementedError",
}
#: Upper bounds of the job size classes.
SIZE_BOUNDS = (100, 1000, 10000, 30000)


def is_duration(text: Column) -> Column:
    """Whether the text is a signed run of number-unit pairs, or a bare 0."""
    return F.coalesce(text.rlike(DURATION), F.lit(False))


def duration_seconds(text: Column) -> Column:
    """Seconds as decimal(30,9), exact to the nanosecond; null for anything that is no duration or over 10^11 of a unit."""
    exact = "decimal(30,9)"
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    factor = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v).cast("decimal(13,9)"))])

    def seconds(token: Column) -> Column:
        number = F.regexp_extract(token, _TOKEN, 1)
        # "1." and ".5" are numbers here
        return (F.concat(F.lit("0"), number, F.when(number.endswith("."), "0").otherwise("")).try_cast("decimal(20,9)") * factor[F.regexp_extract(token, _TOKEN, 2)]).cast(exact)

    total = F.aggregate(tokens, F.lit("0").cast(exact), lambda a, t: (a + seconds(t)).cast(exact))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(is_duration(text), signed)


def error_code_to_type(code: Column) -> Column:
    chain = None
    for value, name in ERROR_TYPES.items():
        chain = F.when(code == value, name) if chain is None else chain.when(code == value, name)
    return chain.when(code >= 500, "InternalServerError").otherwise("APIConnectionError")


def error_type(code: Column, given: Column) -> Column:
    """The type that was given, derived from the code only where it is blank."""
    return F.coalesce(F.nullif(given, F.lit("")), error_code_to_type(code))


def size_bucket(lines: Column) -> Column:
    chain = None
    for bound in SIZE_BOUNDS:
        chain = F.when(lines < bound, str(bound)) if chain is None else chain.when(lines < bound, str(bound))
    return F.when(lines.isNotNull(), chain.otherwise("large"))


def request_status_name(status: Column) -> Column:
    """0 is OK, 1 is ERROR; any other number raises, as it names nothing."""
    return F.element_at(F.array(F.lit("OK"), F.lit("ERROR")), status + 1)


def tag_condition_name(condition: Column) -> Column:
    return F.element_at(F.create_map(F.lit(1), F.lit("and"), F.lit(2), F.lit("or")), condition)


def leading_int(text: Column) -> Column:
    """The whole number a text begins with, after white space; null without one."""
    return F.regexp_extract(text, r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint")


def identifier(given: Column, new: Column) -> Column:
    """The identifier that came with the request, else the new one."""
    return F.coalesce(F.nullif(given, F.lit("")), new)


def contains(text: Column, part: Column) -> Column:
    """Whether the part stands in the text, compared exactly; the empty part stands in every text."""
    return F.contains(text, part)


def utc_text(seconds: Column) -> Column:
    """Epoch seconds as ``2025-03-01T09:30:00Z``, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400)).cast("bigint")
    part = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), part(rest / 3600), F.lit(":"), part(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), part(F.pmod(rest, F.lit(60))), F.lit("Z"))


def without_item(items: Column, at: Column) -> Column:
    """The array without the item at the 0-based place; a place outside changes nothing."""
    inside = (at >= 0) & (at < F.size(items))
    return F.when(inside, F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))).otherwise(items)


def with_item(items: Column, item: Column) -> Column:
    """The array with one more item at its end; of a null array the item alone."""
    return F.array_append(F.coalesce(items, F.array().cast("array<string>")), item)


def name_uuid(text: Column) -> Column:
    """A UUID of version 3 shape made from the text, so that the same text gives the same one."""
    h = F.md5(text)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def join_path(folder: Column, file: Column) -> Column:
    """folder/file, or nothing where there is no file."""
    return F.when(file != "", F.concat_ws("/", folder, file)).otherwise("")


def random_letters(n: int, seed: int) -> Column:
    """n random letters and digits; the same seed gives the same ones."""
    return F.randstr(F.lit(n), F.lit(seed))
