"""Small text functions: offsets, snippets, highlighting, display formats, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_CHARS = 120


def char_offset(text: Column, byte_offset: Column) -> Column:
    """The character offset of a byte offset; a cut character counts as one."""
    return F.char_length(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset.cast("int")).cast("string")))


def snippet(text: Column, at: Column, match_bytes: int, context: int = CONTEXT_CHARS) -> Column:
    """Text around a match at a character offset; the match's byte length widens the end."""
    start = F.greatest(at - context, F.lit(0))
    return F.substring(text, (start + 1).cast("int"), (at + match_bytes + context - start).cast("int"))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def highlight(text: Column, pattern: str) -> Column:
    """Escaped text with every non-overlapping occurrence in a mark element."""
    from glyphspark.functions.match import quoted

    if not pattern:
        return escape_html(text)
    mark = F.concat(F.lit('<mark class="match-highlight">'), escape_html(F.lit(pattern)), F.lit("</mark>"))
    pieces = F.transform(F.split(text, quoted(pattern), -1), escape_html)
    marked = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(mark, p)))
    return F.array_join(marked, "")


def format_duration(ms: Column) -> Column:
    """Microseconds, milliseconds or seconds; a dash for null."""
    return (
        F.when(ms.isNull(), "—")
        .when(ms < 1, F.format_string("%s µs", F.round(ms * 1000, 0).cast("bigint")))
        .when(ms < 1000, F.format_string("%.2f ms", ms))
        .otherwise(F.format_string("%.2f s", ms / 1000))
    )


def format_kb(size: Column) -> Column:
    return F.when(size.isNull() | (size == 0), "—").otherwise(F.format_string("%.1f KB", size / 1024))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago: seconds, minutes or hours, else the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    ago = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, ago(s, "s")).when(s < 3600, ago(F.round(s / 60), "m")).when(s < 86400, ago(F.round(s / 3600), "h")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def parse_patterns(lines: Column) -> Column:
    """One pattern per line, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(lines, "\n", -1), lambda p: F.trim(p)), lambda p: p != "")


def suffix(path: Column) -> Column:
    """Lower-cased extension of a path or URL path with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


# The shapes of an e-mail address and of a user name.
EMAIL_SHAPE = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
NAME_SHAPE = "^[a-zA-Z0-9_]+$"
#: Fewest characters of a password; fewest and most of a user name.
PASSWORD_LEAST, NAME_LEAST, NAME_MOST = 8, 3, 32


def valid_email(email: Column) -> Column:
    return F.trim(email).rlike(EMAIL_SHAPE)


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that does not hold, '' if all do."""
    names = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in checks]))
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))


def password_problem(password: Column) -> Column:
    """'' for a valid password, else what it lacks: length, upper_case or digit."""
    return first_failing([("length", F.char_length(password) >= PASSWORD_LEAST), ("upper_case", password.rlike("[A-Z]")), ("digit", password.rlike("[0-9]"))])


def username_problem(name: Column) -> Column:
    """'' for a valid user name, else what is wrong: too_short, too_long or characters."""
    size = F.char_length(F.trim(name))
    return first_failing([("too_short", size >= NAME_LEAST), ("too_long", size <= NAME_MOST), ("characters", F.trim(name).rlike(NAME_SHAPE))])


def json_envelope(data: Column, message: str = "OK", success: bool = True) -> Column:
    body = F.struct(F.lit("success" if success else "error").alias("status"), F.lit(success).alias("success"), F.lit(message).alias("message"), data.alias("data" if success else "details"))
    return F.to_json(body)
