"""Column functions: everything here is a built-in expression, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.functions import fixed

# A float as people write it: digits may be grouped by '_', signs, exponent, nan, inf.
_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"(?i)[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})(e[+-]?{_DIGITS})?|[+-]?(nan|inf|infinity)"


def parse_float(token: Column) -> Column:
    """Text to double, null when it is not a plain number (no Java suffixes such as ``1d``)."""
    plain = F.replace(F.lower(token), F.lit("_"), F.lit(""))
    plain = F.regexp_replace(plain, r"^[+-]?nan$", "nan")
    return F.when(token.rlike(rf"^({_NUMBER})$"), plain.try_cast("double"))


def parse_row(text: Column) -> Column:
    """Numbers of a text row split at commas and white space; a bad token gives null."""
    tokens = F.filter(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    return F.transform(tokens, parse_float)


def is_rejected(values: Column) -> Column:
    """True when a token of ``parse_row`` was not a number."""
    return F.exists(values, lambda v: v.isNull())


def width_message(values: Column, features: list[str]) -> Column:
    """Null when the row has one value per feature, else what is wrong with it."""
    return F.when(
        F.size(values) != len(features),
        F.format_string(
            fixed.WIDTH, F.lit(len(features)), F.lit(", ".join(features)), F.size(values)
        ),
    )


def require_width(values: Column, features: list[str]) -> Column:
    """The values, or an error that ends the job."""
    bad = width_message(values, features)
    return F.when(bad.isNull(), values).otherwise(F.raise_error(bad).cast("array<double>"))


def decode_class(classes: Column, index: Column) -> Column:
    """Class name by 0-based index; null past the end."""
    return F.get(classes, index.cast("int"))


def given(text: Column) -> Column:
    """Trimmed text, null when it only says "not given"."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*fixed.BLANKS), t)


def fixed_text(value: Column, places: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def epoch_text(seconds: Column, pattern: str) -> Column:
    """Epoch seconds as UTC text, whatever the session zone."""
    s = seconds.cast("double")
    stamp = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)")
    )
    return F.date_format(stamp, pattern)


def run_key(dag_id: Column, created_at: Column, *seed: Column) -> Column:
    """``<dag>__<time>__<6 hex>``; the hex part is a hash of ``seed``, so re-runs agree."""
    digest = F.md5(F.concat_ws("|", *[s.cast("string") for s in (dag_id, created_at, *seed)]))
    return F.concat_ws("__", dag_id.cast("string"), epoch_text(created_at, fixed.RUN_KEY_TIME), F.substring(digest, 1, 6))


_INTERVAL = r"^\s*(\d+(?:\.\d+)?)([smhd])\s*$"


def schedule_seconds(text: Column) -> Column:
    """Interval of a schedule text in seconds; null for none, one-off and unreadable ones."""
    number = F.regexp_extract(text, _INTERVAL, 1).try_cast("double")
    unit = F.regexp_extract(text, _INTERVAL, 2)
    factor = F.create_map(*[x for k, v in fixed.UNIT_SECONDS.items() for x in (F.lit(k), F.lit(v))])
    words = F.create_map(*[x for k, v in fixed.SCHEDULE_SECONDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(words[text], number * F.try_element_at(factor, unit))


def is_bad_schedule(text: Column) -> Column:
    known = text.isin(*fixed.SCHEDULE_SECONDS, fixed.SCHEDULE_ONCE)
    return F.coalesce(~known & ~text.rlike(_INTERVAL), F.lit(False))


def require_schedule(text: Column) -> Column:
    """Seconds as ``schedule_seconds``, but an unreadable text ends the job."""
    message = F.concat(F.lit("bad schedule "), text)
    return F.when(~is_bad_schedule(text), schedule_seconds(text)).otherwise(F.raise_error(message).cast("double"))


def is_due(schedule: Column, last_run_at: Column, now: Column) -> Column:
    seconds = schedule_seconds(schedule)
    return (
        F.when(schedule == fixed.SCHEDULE_ONCE, last_run_at.isNull())
        .when(seconds.isNull(), False)
        .otherwise(last_run_at.isNull() | (now - last_run_at >= seconds))
    )


def age_label(at: Column, now: Column) -> Column:
    """``3d ago`` in the largest unit that fits, rounded half to even; ``-`` without a time."""
    delta = (now - at).cast("double")
    label = F.when(at.isNull(), "-")
    for unit in ("d", "h", "m"):
        size = fixed.UNIT_SECONDS[unit]
        whole = F.bround(delta / size, 0).cast("bigint").cast("string")
        label = label.when(delta >= size, F.concat(whole, F.lit(f"{unit} ago")))
    return label.otherwise(F.concat(F.bround(delta, 0).cast("bigint").cast("string"), F.lit("s ago")))


def run_seconds(created_at: Column, finished_at: Column, now: Column) -> Column:
    return F.coalesce(finished_at, now) - created_at


def task_seconds(started_at: Column, finished_at: Column) -> Column:
    return finished_at - started_at


def decode_result(text: Column) -> Column:
    """Stored JSON as a variant; JSON null when nothing was stored."""
    return F.try_parse_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("null")))


def is_auth_failure(message: Column) -> Column:
    low = F.lower(message)
    hit = F.lit(False)
    for needle in fixed.AUTH_NEEDLES:
        hit = hit | low.contains(needle)
    return F.coalesce(hit, F.lit(False))


def log_tail(text: Column) -> Column:
    return F.right(text, F.lit(fixed.LOG_TAIL_CHARS))


def ref_module(ref: Column) -> Column:
    return F.regexp_extract(ref, r"(?s)^([^:]*)", 1)


def ref_function(ref: Column) -> Column:
    """What follows the first colon, empty without one."""
    return F.regexp_extract(ref, r"(?s)^[^:]*:(.*)$", 1)


def error_type(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, r"(?s)^([A-Za-z_]\w*): (.*)$", 1), F.lit(""))


def error_message(error: Column) -> Column:
    """Text behind ``<Type>: ``, or the whole text without a type."""
    return F.when(error_type(error).isNull(), error).otherwise(
        F.regexp_extract(error, r"(?s)^([A-Za-z_]\w*): (.*)$", 2)
    )


def list_tag(names: list[str]) -> Column:
    """String list as JSON text for a tag map."""
    return F.to_json(F.array(*[F.lit(n) for n in names])) if names else F.lit("[]")


def tag_list(tags: Column, key: str, own: Column | None = None) -> Column:
    """List kept under ``key``; ``own`` wins where set; no tag is an empty list."""
    empty = F.array().cast("array<string>")
    kept = F.coalesce(F.from_json(F.try_element_at(tags, F.lit(key)), "array<string>"), empty)
    return kept if own is None else F.coalesce(own, kept)


def experiment_of(tag: Column) -> Column:
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit(fixed.DEFAULT_EXPERIMENT))


def model_uri(name: Column, version: Column) -> Column:
    return F.concat(F.lit("models:/"), name, F.lit("/"), version.cast("string"))


def kind_of(tag: Column) -> Column:
    """The model's kind by its tag; without one it is some pipeline."""
    return F.coalesce(tag, F.lit(fixed.DEFAULT_KIND))
