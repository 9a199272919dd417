"""Typed reading of payload fields: paths, times, numbers, fault codes, switches.

Divergences from a JavaScript reader, all on malformed input: a hexadecimal or array value
is no number, a boolean is no time, and an ISO time without an offset is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from convoy.schemas import DISTANCE_FACTORS, SPEED_FACTORS

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DMY_PATTERN = r"^([0-9]{2})/([0-9]{2})/([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2})$"
ISO_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}(-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?$"
)
MAX_EPOCH_MS = 8.64e15


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _json_paths(path: str) -> list[str]:
    """JSONPath spellings of a dotted path; a numeric step may be an index or a key."""
    spellings = ["$"]
    for step in path.split("."):
        name = "['" + step.replace("\\", "\\\\").replace("'", "\\'") + "']"
        if step.isdigit():
            spellings = [s + end for s in spellings for end in (f"[{int(step)}]", name)]
        else:
            spellings = [s + name for s in spellings]
    return spellings


def path_sql(path: str, as_type: str = "string", payload: str = "payload") -> str:
    """SQL text reading a dotted path of a VARIANT column; null where a step is missing or null."""
    found = [f"try_variant_get({payload}, {quoted(p)}, '{as_type}')" for p in _json_paths(path)]
    return found[0] if len(found) == 1 else f"coalesce({', '.join(found)})"


def kind_sql(path: str, payload: str = "payload") -> str:
    """SQL text for the ``schema_of_variant`` name of the value at a path."""
    return f"schema_of_variant({path_sql(path, 'variant', payload)})"


def extract_path(payload: str, path: str, as_type: str = "string") -> Column:
    """Value at a dotted path of the VARIANT column ``payload``."""
    return F.expr(path_sql(path, as_type, payload))


def kind_of(payload: str, path: str) -> Column:
    return F.expr(kind_sql(path, payload))


def to_number(text: Column, kind: Column | None = None) -> Column:
    """Finite double read from a value's text, else null. Blank text counts as zero."""
    bare = F.trim(text)
    number = F.when(bare == "", F.lit(0.0)).when(
        bare.rlike(NUMBER_PATTERN), bare.try_cast("double")
    )
    if kind is not None:
        number = F.when(
            text.isin("true", "false") & (kind == "BOOLEAN"),
            F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0)),
        ).otherwise(number)
    return finite(number)


def finite(number: Column) -> Column:
    """The number, or null for one beyond the range of a double."""
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def _from_epoch_ms(ms: Column) -> Column:
    whole = F.when(F.abs(ms) <= MAX_EPOCH_MS, ms.cast("bigint"))
    return F.timestamp_millis(whole)


def parse_ts(text: Column, fmt: Column | str = "iso", kind: Column | None = None) -> Column:
    """Event time at millisecond precision, or null where it cannot be read.

    Day and month numbers beyond their range roll over into the next month or year. A bare number
    (by ``kind``) in an ISO field counts as epoch milliseconds.
    """
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    epoch = fmt.isin("epoch_ms", "epoch_s")
    if kind is not None:
        epoch = epoch | ((fmt == "iso") & kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"))
    factor = F.when(fmt == "epoch_s", F.lit(1000.0)).otherwise(F.lit(1.0))
    iso = F.when(
        text.rlike(ISO_PATTERN),
        F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text),
    ).try_cast("timestamp")
    return (
        F.when(epoch, _from_epoch_ms(to_number(text) * factor))
        .when(fmt == "ddmmyyyy_hms", F.when(text.rlike(DMY_PATTERN), _from_day_first(text)))
        .otherwise(F.date_trunc("MILLISECOND", iso))
    )


def _from_day_first(text: Column) -> Column:
    """Time of a text known to read dd/mm/yyyy hh:mm:ss; two-digit years belong to the 1900s."""

    def at(start: int, length: int) -> Column:
        return F.substring(text, start, length).try_cast("int")

    year = at(7, 4) + F.when(F.substring(text, 7, 2) == "00", F.lit(1900)).otherwise(F.lit(0))
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), at(4, 2) - 1)
    days = (F.unix_date(first) + at(1, 2) - 1).cast("bigint")
    return F.timestamp_seconds(days * 86400 + at(12, 2) * 3600 + at(15, 2) * 60 + at(18, 2))


def unit_factor(quantity: str, unit: str | None) -> float:
    """Multiplier to km/h or km; a unit that does not belong to the quantity changes nothing."""
    table = SPEED_FACTORS if quantity == "speed" else DISTANCE_FACTORS
    return table.get(unit or "", 1.0)


def convert_unit(value: Column, quantity: str, unit: str | None) -> Column:
    return value * F.lit(unit_factor(quantity, unit))


def required_number(
    text: Column,
    name: str,
    factor: Column | float = 1.0,
    scale: Column | float = 1.0,
    kind: Column | None = None,
) -> tuple[Column, Column]:
    """(value, reason): the reason is ``missing:<name>`` or ``bad_number:<name>`` or null."""
    number = to_number(text, kind)
    return number * factor * scale, number_problem(text, number, name)


def number_problem(text: Column, number: Column, name: str) -> Column:
    """Why a required number cannot be used, or null."""
    return F.when(text.isNull() | (text == ""), F.lit(f"missing:{name}")).when(
        number.isNull(), F.lit(f"bad_number:{name}")
    )


def optional_number(
    text: Column, scale: Column | float = 1.0, kind: Column | None = None
) -> Column:
    """Number times scale; anything unusable is null, never a failure."""
    return F.when(text != "", to_number(text, kind)) * scale


def fault_codes(items: Column, text: Column, kind: Column, split: Column | str = ",") -> Column:
    """Upper-case codes from an array, or from text cut at a literal separator."""
    split = F.lit(split) if isinstance(split, str) else split
    separator = F.when(F.coalesce(split, F.lit("")) == "", F.lit(",")).otherwise(split)
    pattern = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    from_array = F.transform(items, lambda x: F.upper(F.coalesce(x, F.lit("null"))))
    from_text = F.filter(
        F.transform(
            F.split(text, pattern), lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+$", ""))
        ),
        lambda x: x != "",
    )
    empty = F.array().cast("array<string>")
    return (
        F.when(items.isNotNull(), from_array)
        .when((kind == "STRING") & (text != ""), from_text)
        .otherwise(empty)
    )


def as_text(value: object) -> str:
    """The text a mapping constant has once it is compared with a payload value."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def truthy(text: Column, values: tuple = (True,)) -> Column:
    """Whether the value's text equals any listed constant; absent values are false."""
    return F.coalesce(text.isin(*[as_text(v) for v in values]), F.lit(False))
