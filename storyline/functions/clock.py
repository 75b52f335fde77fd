"""Time functions: parsing, cursors, calendar weeks and back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline.functions.text import let, strip_space

# Obsolete zone names of mail dates.
MAIL_ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_iso(col: Column) -> Column:
    """ISO-8601 date or date-time; values without a zone are UTC (the session zone)."""
    text = strip_space(col)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def parse_mail_date(col: Column) -> Column:
    """RFC-2822 date; the week day is ignored, missing seconds are zero, no zone means UTC."""
    text = F.regexp_replace(strip_space(col), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")
    for name, offset in MAIL_ZONES.items():
        text = F.regexp_replace(text, rf" {name}$", f" {offset}")
    text = F.regexp_replace(text, r" (\d{2}:\d{2})( |$)", " $1:00$2")
    text = F.regexp_replace(text, r"(:\d{2})$", "$1 +0000")
    return F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z"))


def parse_time(col: Column) -> Column:
    return F.coalesce(parse_iso(col), parse_mail_date(col))


def iso_text(ts: Column) -> Column:
    """``2024-01-01T00:00:07.179575+00:00``; no fraction when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1000000
    return F.concat(
        whole,
        F.when(micros == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
        ),
        F.lit("+00:00"),
    )


def encode_cursor(ts: Column, story_id: Column) -> Column:
    """Opaque page cursor: URL-safe base64 of ``["timestamp",id]`` without padding."""
    payload = F.concat(F.lit('["'), iso_text(ts), F.lit('",'), story_id.cast("string"), F.lit("]"))
    return F.translate(
        F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), r"=+|\s+", ""), "+/", "-_"
    )


def decode_cursor(col: Column) -> Column:
    """Struct (ts, id, error); error is set for oversized or malformed cursors."""
    padded = F.translate(col, "-_", "+/")
    padded = F.concat(padded, F.repeat(F.lit("="), F.expr("0") + (4 - F.length(col) % 4) % 4))

    def read(text: Column) -> Column:
        fields = F.from_json(text, "array<string>")
        ts = parse_iso(F.get(fields, F.lit(0)))
        sid = F.get(fields, F.lit(1)).try_cast("bigint")
        good = (F.size(fields) == 2) & ts.isNotNull() & (sid >= 1)
        error = F.when(F.length(col) > 256, F.lit("cursor is too long")).when(
            ~F.coalesce(good, F.lit(False)), F.lit("invalid cursor")
        )
        return let(
            error,
            lambda e: F.struct(
                F.when(e.isNull(), ts).alias("ts"), F.when(e.isNull(), sid).alias("id"), e.alias("error")
            ),
        )

    return let(F.try_to_binary(padded, F.lit("base64")).cast("string"), read)


def week_start(ts: Column, zone: str, weekday: int) -> Column:
    """UTC start of the local week that begins at midnight of the day after ``weekday`` (0=Monday)."""
    return F.to_utc_timestamp(_start_date(ts, zone, weekday).cast("timestamp"), zone)


def _start_date(ts: Column, zone: str, weekday: int) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    days = F.pmod(F.weekday(local) - F.lit((weekday + 1) % 7), F.lit(7))
    return F.date_sub(F.to_date(local), days)


def week_scheduled(ts: Column, zone: str, weekday: int, hour: int) -> Column:
    """UTC time at which that week's digest is scheduled."""
    day = F.date_add(_start_date(ts, zone, weekday), 6)
    local = day.cast("timestamp") + F.expr(f"INTERVAL {int(hour)} HOURS")
    return F.to_utc_timestamp(local, zone)


def retry_delay(interval_seconds: Column, failures: Column) -> Column:
    """Exponential back-off in seconds, at most a day."""
    doubling = F.pow(F.lit(2), F.least(failures + 1, F.lit(8))).cast("bigint")
    return F.least(interval_seconds * doubling, F.lit(86400))
