"""Column-level text and date helpers, all built from Spark SQL functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from . import fixed


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), fixed.ACCENTED, fixed.UNACCENTED)


def tokens(c: Column) -> Column:
    """Every run of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(c: Column) -> Column:
    """Search terms of a question: letters and digits only, longer than two characters."""
    words = F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: F.length(w) > 2)


def prefixes(c: Column, width: int = 6) -> Column:
    """Lower-case word starts used for matching inflected forms; short words are left out."""
    words = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(words, lambda w: F.substring(F.lower(w), 1, width)))


def as_list(c: Column) -> Column:
    """Comma separated text to a clean array; NULL gives an empty array."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def sender_name(c: Column) -> Column:
    """Display name of a mail header, or the local part of a bare address."""
    pattern = r'^"?([^"<]+?)"?\s*<'
    named = F.regexp_extract(c, pattern, 1)
    return F.trim(F.when(c.rlike(pattern), named).otherwise(F.substring_index(c, "@", 1)))


def parse_flexible_date(c: Column) -> Column:
    """First accepted date format on the first ten characters; anything else is NULL."""
    head = F.substring(F.trim(c), 1, 10)
    shapes = [r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$",
              r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$"]
    tries = [F.when(head.rlike(s), F.try_to_date(head, f))
             for s, f in zip(shapes, fixed.DATE_FORMATS)]
    return F.coalesce(*tries)


def infer_doc_type(path: Column) -> Column:
    low = F.lower(path)
    part = lambda names: low.rlike(rf"(?:^|[/\\])(?:{names})(?:[/\\]|\z)")
    return F.when(part("meetings"), "meeting").when(part("decisions"), "decision").when(part("papers|research"), "paper").otherwise("note")


def is_title_case(c: Column) -> Column:
    return c.rlike(r"^\P{L}*(?:\p{Lu}\p{Ll}*(?:\P{L}+|$))+$")


def plain_ascii(c: Column) -> Column:
    """Letters a-z, digits and spaces only; how titles and authors are compared."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def reason_label(parts: list[tuple[Column, str]], empty: str) -> Column:
    """``3 tareas · 1 preguntas`` from counts; zero counts are left out."""
    pieces = [F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + label))) for n, label in parts]
    label = F.concat_ws(" · ", *pieces)
    return F.when(label == "", F.lit(empty)).otherwise(label)


def short_label(c: Column, limit: int = 46) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit - 2), F.lit("…")))


def natural_id(prefix: str, *parts: Column) -> Column:
    """Id from the natural key, so that re-runs and task retries give the same rows."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(key, 256), 1, 24))


def intent(c: Column) -> Column:
    """Ordered pattern families; the first family with a hit names the intent."""
    low = F.lower(c)
    out = None
    for name, patterns in fixed.INTENT_PATTERNS:
        hit = low.rlike("(?u)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(fixed.DEFAULT_INTENT)


def memory_plan(intent_col: Column) -> Column:
    out = None
    for name, plan in fixed.MEMORY_PLAN.items():
        arr = F.array(*[F.lit(p) for p in plan])
        out = F.when(intent_col == name, arr) if out is None else out.when(intent_col == name, arr)
    return out


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def last_value(names: Column, values: Column, key: str) -> Column:
    """Value beside the last occurrence of ``key`` in two parallel arrays, NULL if absent."""
    at = F.array_position(F.reverse(names), F.lit(key))
    return F.when(at > 0, F.element_at(values, (-at).cast("int")))


def date_windows(day: Column, as_of: dt.date) -> dict[str, Column]:
    """Named date conditions around ``as_of``. The recent ones have no upper bound, so rows
    dated in the future count as recent."""
    today = F.lit(as_of)
    return {
        "next_7d": day.between(today, F.date_add(today, 7)),
        "next_14d": day.between(today, F.date_add(today, 14)),
        "horizon_3d": day.between(today, F.date_add(today, 3)),
        "last_7d": day >= F.date_sub(today, 7),
        "last_14d": day >= F.date_sub(today, 14),
        "last_30d": day >= F.date_sub(today, 30),
        "older_30d": day <= F.date_sub(today, 30),
        "overdue": day < today,
    }
