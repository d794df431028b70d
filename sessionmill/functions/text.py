"""String functions with the lengths of UTF-16 code units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5

# Category, its directory, its id letter.
CATEGORIES = (("decision", "decisions", "D"), ("learning", "learnings", "L"), ("reusable", "reusable", "R"), ("anti-pattern", "anti-patterns", "A"))
UNIVERSALITIES = ("universal", "app-specific", "unverified")
SEVERITIES = ("critical", "normal")


def js_len(text: Column) -> Column:
    """Length in UTF-16 code units: characters outside the basic plane count twice."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("bigint")


def _fitting(n: int, part) -> Column:
    """The longest part, by number of characters, that takes at most ``n`` code units."""
    fits = F.filter(F.sequence(F.lit(n), F.lit(n // 2), F.lit(-1)), lambda k: js_len(part(k)) <= n)
    return part(F.get(fits, F.lit(0)))


def js_left(text: Column, n: int) -> Column:
    """The first ``n`` code units; a character that would be cut in half is left out."""
    plain = F.left(text, F.lit(n))
    return F.when(js_len(plain) <= n, plain).otherwise(_fitting(n, lambda k: F.left(text, k)))


def js_right(text: Column, n: int) -> Column:
    """The last ``n`` code units, in the same way."""
    plain = F.right(text, F.lit(n))
    return F.when(js_len(plain) <= n, plain).otherwise(_fitting(n, lambda k: F.right(text, k)))


def js_trim(text: Column) -> Column:
    """White space as JavaScript sees it, off both ends."""
    space = r"[\s ﻿  -     　]+"
    return F.regexp_replace(text, rf"^{space}|{space}$", "")


def tokens(chars: Column) -> Column:
    return F.round(chars / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def head_and_tail(text: Column, over: int, head: int, tail: int) -> Column:
    """Longer texts keep their head and tail, and say how much is gone."""
    cut = F.concat(js_left(text, head), F.lit(" ... [truncated "), (js_len(text) - head - tail).cast("string"), F.lit(" chars] ... "), js_right(text, tail))
    return F.when(js_len(text) > over, cut).otherwise(text)


def head_only(text: Column, over: int, mark: str) -> Column:
    """Longer texts keep their first ``over`` units; ``mark`` has {} for the number left out."""
    before, after = mark.split("{}")
    return F.when(js_len(text) > over, F.concat(js_left(text, over), F.lit(before), (js_len(text) - over).cast("string"), F.lit(after))).otherwise(text)


def language(hangul: Column, ascii_letters: Column) -> Column:
    """ko at half or more hangul, else en; mixed without letters."""
    return F.when(hangul + ascii_letters == 0, "mixed").when(2 * hangul >= hangul + ascii_letters, "ko").otherwise("en")


def decided_language(requested: Column, detected: Column) -> Column:
    """What was asked for, unless it is auto; a mixed session is written in ko."""
    return F.when(requested != "auto", requested).when(detected == "en", "en").otherwise("ko")


def category_dir(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in c[:2]]), category)


def category_letter(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in c[::2]]), category)


def category_of_letter(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c[2], c[0])]), letter)


def slug_of_file(name: Column, otherwise: Column) -> Column:
    slug = F.regexp_extract(name, r"^[DLRA]-[0-9]{3}-(.+)\.md$", 1)
    return F.when(slug != "", slug).otherwise(otherwise)


def title_of_slug(slug: Column) -> Column:
    spaced = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, 2, 1 << 30))


def one_line(text: Column, most: int = 60) -> Column:
    """The text on one line, cut after ``most`` units.

    A text's start without the white space at its end is made the same line as in the
    whole text, so the rest is read only where that line is not too long already.
    """
    whole = lambda t: js_trim(F.regexp_replace(t, r"\s*\n\s*", " "))
    begun = whole(F.left(text, F.lit(8 * most)))
    line = F.when(js_len(begun) > most, begun).otherwise(whole(text))
    return F.when(js_len(line) > most, F.concat(js_left(line, most), F.lit("…"))).otherwise(line)


def cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def short_date(updated: Column, now: Column) -> Column:
    """MM-DD in the year of ``now``, else the whole date; what is no date stays."""
    same = F.left(updated, F.lit(4)) == F.left(now, F.lit(4))
    return F.when(~updated.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), updated).when(same, F.substring(updated, 6, 5)).otherwise(F.left(updated, F.lit(10)))


def iso_of_millis(millis: Column) -> Column:
    """ISO-8601 with the session time zone's offset, in seconds."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ssxxx")


def status_kind(status: Column) -> Column:
    return F.when(status.startswith("superseded-by-cross:"), "superseded-by-cross").when(status.startswith("superseded-by:"), "superseded-by").otherwise(status)


def superseded_id(status: Column) -> Column:
    found = F.regexp_extract(status, r"^superseded-by(?:-cross:.+)?:([DLRA]-[0-9]{3})$", 1)
    return F.when(found != "", found)


def superseded_path(status: Column) -> Column:
    found = F.regexp_extract(status, r"^superseded-by-cross:(.+):[DLRA]-[0-9]{3}$", 1)
    return F.when(found != "", found)


def with_history(body: Column, entry: Column) -> Column:
    """A line under the first "## History" heading, newest first; the section is added where there is none."""
    body, line = F.replace(body, F.lit("\r\n"), F.lit("\n")), F.concat(F.lit("\n\n- "), entry)
    heading = r"(?s)^(.*?(?:^|\n)## History[ \t]*)(?=\n|$)(.*)$"
    before, after = F.regexp_extract(body, heading, 1), F.regexp_extract(body, heading, 2)
    added = F.concat(before, line, F.regexp_replace(after, r"^\n\n", "\n"))
    trimmed = F.regexp_replace(body, r"\s+$", "")
    section = F.concat(F.lit("## History"), line)
    return F.when(before != "", added).when(trimmed == "", section).otherwise(F.concat(trimmed, F.lit("\n\n"), section))
