"""Names, keys and figures read out of text: stable ids, account classes, surface keys, amounts and loose dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What in a name or organisation tells the class of an account, in the order in which it is asked.
CLASS_RULES = (
    ("checking", ("ckg", "checking"), ()),
    ("savings", ("saving",), ()),
    ("loan", ("loan",), ()),
    ("investment", ("pcra", "trust"), ("schwab",)),
    ("card", ("visa", "mastercard", "card"), ("american express", "apple card")),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def account_class(name: Column, org: Column) -> Column:
    """checking, savings, loan, investment, card or other, by parts of the name and of the organisation."""
    n, o = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(org, F.lit("")))
    out = F.lit("other")
    for label, in_name, in_org in reversed(CLASS_RULES):
        hit = F.lit(False)
        for part in in_name:
            hit = hit | F.contains(n, F.lit(part))
        for part in in_org:
            hit = hit | F.contains(o, F.lit(part))
        out = F.when(hit, label).otherwise(out)
    return out


def quoted(c: Column) -> Column:
    """A JSON string of ASCII alone, or null; characters beyond the basic plane are not expected."""
    escaped = F.regexp_replace(F.regexp_replace(c, r'([\\"])', r"\\$1"), "\n", r"\\n")
    one = lambda x: F.when(F.ascii(x) > 126, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(x)), 4, "0")))).otherwise(x)
    text = F.when(F.regexp_like(escaped, F.lit("[^\\x00-\\x7e]")), F.array_join(F.transform(F.split(escaped, ""), one), "")).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def digest_id(prefix: str, fields: dict[str, Column], comma: str = ", ", colon: str = ": ") -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the fields as a JSON object, keys in order."""
    parts = [F.concat(F.lit(f'"{k}"{colon}'), quoted(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}")), 256), 1, 16))


def content_hash(content: Column, description: Column, due: Column, priority: Column) -> Column:
    """16 hex digits that change with any of the four; a missing due date or priority counts as empty."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("\n", content, description, empty(due), empty(priority)), 256), 1, 16)


def surface_key(description: Column) -> Column:
    """The key in the first [fa:key] of a text; null where there is none or it is blank."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(description, F.lit("")), r"(?s)\[fa:(.*?)\]", 1)), F.lit(""))


def label_slug(label: Column) -> Column:
    """Lower case words joined by underscores, 48 characters at most; unlabeled where nothing is left."""
    s = F.substring(F.btrim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_")), 1, 48)
    return F.when(s == "", "unlabeled").otherwise(s)


def amount_in(text: Column) -> Column:
    """The first dollar figure written into a text; null without one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def month_day(text: Column, year: int) -> Column:
    """The first 'month day' written into a text, in that year; null where it is no date."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = r"([a-z]{3})[a-z]*\s+(\d{1,2})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, pattern, 1))
    return F.when(month > 0, F.try_to_timestamp(F.concat_ws("-", F.lit(str(year)), month, F.regexp_extract(low, pattern, 2)), F.lit("yyyy-M-d")).cast("date"))
