"""Column functions over names, scores, timestamps and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and what they are folded to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinoooooouuuuyy"


def fold_name(name: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower case without marks, stop words and anything but a-z and 0-9."""
    low = F.translate(F.lower(name), MARKED, FOLDED)
    for w in stop_words:
        low = F.regexp_replace(low, rf"\b{w}\b", "")
    return F.regexp_replace(low, "[^a-z0-9]", "")


def score_part(score: Column, side: int) -> Column:
    """Goals of one side of an "h-a" text; null on anything else."""
    return F.nullif(F.regexp_extract(F.trim(score), r"^(\d{1,4})\s*-\s*(\d{1,4})$", side + 1), F.lit("")).cast("int")


def safe_number(text: Column, default: Column | None = None) -> Column:
    """A number; null or the default for empty, 'none', 'nan' and other junk."""
    clean = F.when(F.lower(F.trim(text)).isin("", "none", "nan", "null"), None).otherwise(F.trim(text))
    value = clean.try_cast("double")
    return value if default is None else F.coalesce(value, default)


def to_utc(text: Column) -> Column:
    """A timestamp from epoch seconds or one of four layouts; without a zone it is UTC."""
    digits = F.when(text.rlike(r"^\d{9,10}$"), F.timestamp_seconds(text.try_cast("long")))
    layouts = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(digits, *(F.try_to_timestamp(text, F.lit(p)) for p in layouts))


def record_hash(*columns: str) -> Column:
    """SHA-256 of name=value pairs in the order of the names; nulls spelled out."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws(";", *pairs), 256)


def redact(url: Column, name: str = "api_token") -> Column:
    """The named query parameter's value replaced."""
    return F.regexp_replace(url, rf"(?i)({name}=)[^&\s]+", "$1REDACTED")


def local(time: Column, zone: str = "UTC") -> Column:
    """An instant's wall clock in a zone, whatever the session's own."""
    return F.convert_timezone(None, F.lit(zone), time.cast("timestamp_ntz"))


def clock(text: Column, zone: str = "UTC", suffix: str = "UTC", half_days: bool = False, day: bool = False) -> Column:
    """A kickoff as "18:30 UTC", by half days as "05:00 PM IST", with its day as "27 Aug 2026, 18:30 UTC".

    text is anything that to_utc reads, all else stays as it is. Without a suffix only the time is left.
    """
    layout = ("dd MMM yyyy, " if day else "") + ("hh:mm a" if half_days else "HH:mm")
    shown = F.date_format(local(to_utc(text), zone), layout)
    return F.coalesce(F.concat(shown, F.lit(f" {suffix}" if suffix else "")), text)


def local_day(text: Column, zone: str = "UTC") -> Column:
    """The calendar day yyyy-MM-dd of a kickoff in a zone; of a text without a time its first ten characters."""
    return F.coalesce(F.date_format(local(to_utc(text), zone), "yyyy-MM-dd"), F.left(text, F.lit(10)))


def on_day(text: Column, day: Column | str, zone: str = "UTC") -> Column:
    """Whether a kickoff falls on a day (yyyy-MM-dd) in a zone."""
    return local_day(text, zone) == (day if isinstance(day, Column) else F.lit(day))
