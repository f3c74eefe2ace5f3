"""Scalar functions of the task model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("active", "pending", "scheduled", "retry", "archived", "completed", "aggregating")
TERMINAL = ("archived", "completed")


def now_of(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def epoch(ts: Column) -> Column:
    """Unix seconds, rounded down before 1970 as well."""
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def is_state(text: Column) -> Column:
    return text.isin(*STATES)


def unique_key(queue: Column, kind: Column, payload: Column) -> Column:
    """Lock key; a null payload leaves out the hash, unlike an empty one."""
    return F.concat(F.lit("q:{"), queue, F.lit("}:unique:"), kind, F.lit(":"), F.coalesce(F.md5(payload), F.lit("")))


def queue_key(queue: Column, part: str) -> Column:
    return F.concat(F.lit("q:{"), queue, F.lit("}:" + part))


def _wrapped(x: Column) -> Column:
    """A decimal taken into the range of a signed 64-bit integer, as overflow would."""
    two64, two63 = (F.lit(str(2**n)).cast("decimal(38,0)") for n in (64, 63))
    rest = F.pmod(x, two64)
    return F.when(rest >= two63, rest - two64).otherwise(rest).cast("decimal(38,0)")


def backoff_nanos(retried: Column, jitter: Column) -> Column:
    """Default delay before retry n: n^4 + 15 + jitter * (n + 1) seconds, 64-bit overflow wrapping, negative as 0."""
    n, j = (x.cast("decimal(19,0)") for x in (retried, jitter))
    square = (n * n).cast("decimal(19,0)")
    seconds = _wrapped(((square * square).cast("decimal(38,0)") + F.lit(15) + (j * (n + 1)).cast("decimal(38,0)")).cast("decimal(38,0)"))
    nanos = _wrapped((seconds.cast("decimal(19,0)") * F.lit(10**9).cast("decimal(18,0)")).cast("decimal(38,0)"))
    return F.greatest(nanos, F.lit(0).cast("decimal(38,0)")).cast("bigint")


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as ``1h30m`` or ``1.5s``; null if malformed."""
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+\.?[0-9]*|\.[0-9]+)(h|ms|m|us|µs|ns|s)"), F.lit(0))

    def value(x: Column) -> Column:
        name = F.regexp_extract(x, r"[a-zµ]+$", 0)
        scale = F.lit(None).cast("double")
        for k, v in unit.items():
            scale = F.when(name == k, F.lit(v)).otherwise(scale)
        return F.regexp_extract(x, r"^[0-9.]+", 0).cast("double") * scale

    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + value(x))
    fine = text.rlike(r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(h|ms|m|us|µs|ns|s))+$")
    return F.when(text.isin("0", "+0", "-0"), F.lit(0.0)).when(fine, F.when(text.startswith("-"), -total).otherwise(total))


def duration_nanos(text: Column) -> Column:
    """Nanoseconds (long) of texts such as ``-1h30m`` or ``1.5s``; null if malformed or beyond 64 bits.

    Whole numbers are exact. A fraction counts by its first 18 digits as a double, cut off.
    """
    unit = {"h": 3_600 * 10**9, "m": 60 * 10**9, "s": 10**9, "ms": 10**6, "us": 10**3, "µs": 10**3, "μs": 10**3, "ns": 1}
    one = r"([0-9]*)(?:\.([0-9]*))?(ns|us|µs|μs|ms|h|m|s)"
    wide, top = "decimal(38,0)", F.lit(str(2**63)).cast("decimal(38,0)")

    def nanos(x: Column) -> Column:
        name = F.regexp_extract(x, r"[a-zµμ]+$", 0)
        scale = F.lit(None).cast("bigint")
        for k, v in unit.items():
            scale = F.when(name == k, F.lit(v)).otherwise(scale)
        digits = F.regexp_replace(F.regexp_extract(x, r"^[0-9]*", 0), "^0+", "")
        whole = F.when(digits == "", F.lit("0")).when(F.length(digits) > 20, F.lit("9" * 20)).otherwise(digits).cast("decimal(20,0)")
        part = F.substring(F.regexp_extract(x, r"\.([0-9]*)", 1), 1, 18)
        fraction = F.when(part == "", F.lit(0.0)).otherwise(F.concat(F.lit("0"), part).cast("double") * (scale / F.pow(F.lit(10.0), F.length(part))))
        return F.least((whole * scale.cast("decimal(13,0)")).cast(wide) + fraction.cast("bigint"), top + 1).cast(wide)

    parts = F.regexp_extract_all(text, F.lit(one), F.lit(0))
    total = F.aggregate(parts, F.lit(0).cast(wide), lambda a, x: (a + nanos(x)).cast(wide))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    fine = text.rlike(r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|h|m|s))+$") & (signed >= -top) & (signed < top)
    return F.when(text.isin("0", "+0", "-0"), F.lit(0).cast("bigint")).when(fine, signed.cast("bigint"))


def format_nanos(nanos: Column) -> Column:
    """Nanoseconds, none negative, as ``1h2m3.5s``, ``1.5ms``, ``2µs`` or ``7ns``; ``0s`` for none."""

    def shown(whole: Column, rest: Column, width: int, unit: str) -> Column:
        digits = F.rtrim(F.lpad(rest.cast("string"), width, "0"), F.lit("0"))
        return F.concat(whole.cast("string"), F.when(rest > 0, F.concat(F.lit("."), digits)).otherwise(""), F.lit(unit))

    over = lambda n: F.call_function("div", nanos, F.lit(n))
    total, rest = over(10**9), nanos % 10**9
    h, m = over(3_600 * 10**9), over(60 * 10**9) % 60
    return (
        F.when(nanos == 0, "0s")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), shown(total % 60, rest, 9, "s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), shown(total % 60, rest, 9, "s")))
        .when(total > 0, shown(total, rest, 9, "s"))
        .when(nanos >= 10**6, shown(over(10**6), nanos % 10**6, 6, "ms"))
        .when(nanos >= 10**3, shown(over(10**3), nanos % 10**3, 3, "µs"))
        .otherwise(F.concat(nanos.cast("string"), F.lit("ns")))
    )


def every_seconds(spec: Column) -> Column:
    """Seconds of an ``@every 1m30s`` line, parts of seconds cut off, one at least; null if it is none."""
    text = F.when(spec.startswith("@every "), F.substring(spec, 8, 2**31 - 1))
    nanos = F.when(text == F.trim(text), duration_nanos(text))
    return F.when(nanos.isNotNull(), F.greatest(F.call_function("div", nanos, F.lit(10**9)), F.lit(1)))


def unix_date(ts: Column) -> Column:
    """A time as ``Mon Jan  2 15:04:05 UTC 2006``; parts of seconds are left out."""
    at = ts.cast("timestamp")
    return F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.day(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss 'UTC' yyyy"))


def instant(seconds: Column, nanos: Column) -> Column:
    """(seconds, nanos) with nanos brought into 0 to 999,999,999, the rest carried over to the seconds."""
    whole = F.floor(nanos.cast("decimal(20,0)") / 1_000_000_000).cast("bigint")
    return F.struct((seconds + whole).alias("seconds"), F.pmod(nanos, F.lit(1_000_000_000)).cast("int").alias("nanos"))


def instant_of(ts: Column) -> Column:
    """A time as (seconds, nanos): seconds rounded down, nanos from 0, before 1970 as well."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.struct(F.floor(micros / 1_000_000).cast("bigint").alias("seconds"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nanos"))


def time_of(instant: Column) -> Column:
    """The time of (seconds, nanos), to microseconds; 1970 if there is none, null for the year 1 that stands for a time that never was."""
    never = (instant["seconds"] == -62_135_596_800) & (instant["nanos"] == 0)
    micros = F.coalesce(instant["seconds"], F.lit(0)) * 1_000_000 + F.call_function("div", F.coalesce(instant["nanos"], F.lit(0)), F.lit(1000))
    return F.when(F.coalesce(never, F.lit(False)), F.lit(None)).otherwise(F.timestamp_micros(micros).cast("timestamp_ntz"))


def nanos_between(later: Column, earlier: Column) -> Column:
    """Signed nanoseconds from one time to another, as a decimal that holds any two times."""
    return ((F.unix_micros(later.cast("timestamp")).cast("decimal(20,0)") - F.unix_micros(earlier.cast("timestamp"))) * 1000).cast("decimal(38,0)")


def time_or_null(seconds: Column) -> Column:
    """The time of unix seconds; zero stands for none."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def span_or_zero(seconds: Column) -> Column:
    """Seconds of a time span; negative ones count as none."""
    return F.greatest(seconds, F.lit(0))


def utf8_or_null(raw: Column) -> Column:
    """The text of bytes; null if they aren't UTF-8."""
    return F.try_validate_utf8(raw.cast("string"))


def format_seconds(seconds: Column) -> Column:
    """Seconds as ``1h2m3s``, leaving out leading zero units."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    text = F.concat(s.cast("string"), F.lit("s"))
    text = F.when(seconds >= 60, F.concat(m.cast("string"), F.lit("m"), text)).otherwise(text)
    return F.when(seconds >= 3600, F.concat(h.cast("string"), F.lit("h"), text)).otherwise(text)


# Escapes of double-quoted text.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v"))


def quoted(text: Column) -> Column:
    """Double-quoted text with backslash escapes for quotes, backslashes, white space and control characters."""
    for raw, shown in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(shown))

    def escaped(c: Column) -> Column:
        code = F.lower(F.hex(F.ascii(c)))
        low = F.concat(F.lit("\\x"), F.lpad(code, 2, "0"))
        return F.when(c.rlike(r"[\x00-\x1f\x7f]"), low).when(c.rlike(r"[\x80-\x9f\u2028\u2029]"), F.concat(F.lit("\\u"), F.lpad(code, 4, "0"))).otherwise(c)

    rare = F.array_join(F.transform(F.split(text, ""), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"), rare).otherwise(text), F.lit('"'))


def all_option_strings(options: dict[str, Column]) -> Column:
    """Options that are set, as texts, in fixed order; of ``options`` by name, spans are in nanoseconds and times are timestamps."""
    span = lambda x: format_nanos(x)
    # Names of options and how each shows its value.
    shown = {
        "Queue": quoted, "TaskID": quoted, "MaxRetry": lambda x: x.cast("string"), "Timeout": span, "Deadline": unix_date,
        "Unique": span, "ProcessAt": unix_date, "ProcessIn": span, "Retention": span, "Group": quoted,
    }
    texts = [F.concat(F.lit(name + "("), show(options[name]), F.lit(")")) for name, show in shown.items() if name in options]
    return F.filter(F.array(*texts), lambda x: x.isNotNull())


def option_strings(queue: Column, max_retry: Column, timeout: Column, unique_for: Column, group: Column) -> Column:
    """Five of the options, if set, as texts, with spans in whole seconds."""
    call = lambda name, x: F.concat(F.lit(name + "("), x, F.lit(")"))
    return F.filter(
        F.array(
            call("Queue", quoted(queue)), call("MaxRetry", max_retry.cast("string")), call("Timeout", format_seconds(timeout)),
            call("Unique", format_seconds(unique_for)), call("Group", quoted(group)),
        ),
        lambda x: x.isNotNull(),
    )
