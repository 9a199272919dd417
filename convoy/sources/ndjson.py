"""Decoding of raw text: newline-delimited batches, single lines, envelopes, partition keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoy.functions.fields import extract_path, kind_of, path_sql
from convoy.functions.plan import settle
from convoy.operators.mapping import by_vendor, mapping_dict
from convoy.schemas import FALLBACK_VIN_KEYS


def parse_ndjson(
    df: DataFrame, text_col: str = "text", batch_col: str = "batch_id", max_lines: int | None = None
) -> DataFrame:
    """One row per non-blank line of each batch.

    ``truncated`` marks the lines beyond the batch's allowance of ``max_lines``, for the dead letters;
    they are handed on like the others.
    """
    lines = F.filter(
        F.transform(F.split(F.col(text_col), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
        lambda x: x != "",
    )
    keep = [c for c in df.columns if c not in (text_col, batch_col)]
    return (
        df.select(batch_col, *keep, F.posexplode(lines).alias("line_no", "line"))
        .withColumn("truncated", F.lit(False) if max_lines is None else F.col("line_no") >= max_lines)
        .select(batch_col, *keep, "truncated", "line_no", "line")
    )


def shown(line_col: str = "line", max_chars: int = 300) -> Column:
    """A line's beginning, for lists; the line itself is stored whole."""
    return F.left(F.col(line_col), F.lit(max_chars))


def _one_value() -> Column:
    """Whether the bracketed text in ``_doc`` parsed as exactly one value; ``_item`` is its first."""
    doc = F.col("_doc")
    return doc.isNotNull() & F.col("_item").isNotNull() & F.try_variant_get(doc, "$[1]", "variant").isNull()


def classify_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``payload`` (VARIANT object) or ``reason`` (``bad_json`` / ``not_object``).

    Wrapping the line in brackets makes trailing text an error; of a repeated key the last value
    counts, as ``configure`` sets the session. Rejected lines stay whole, so they can be replayed.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(line_col), F.lit("]")))
    reason = F.when(~_one_value(), F.lit("bad_json")).when(
        ~F.col(line_col).rlike(r"^\s*\{"), F.lit("not_object")
    )
    out = (
        df.withColumn("_doc", wrapped)
        .withColumn("_item", F.try_variant_get("_doc", "$[0]", "variant"))  # taking a value out copies it: once
        .withColumn("reason", reason)
        .withColumn("payload", F.when(F.col("reason").isNull(), F.col("_item")))
    )
    return settle(out.drop("_doc", "_item"), "reason")


def decode_envelope(df: DataFrame, value_col: str = "value") -> DataFrame:
    """``{oem, r, p}`` text to ``oem, received_at, payload``; unreadable text is ``bad_envelope``."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(value_col), F.lit("]")))
    usable = _one_value() & (F.trim(F.col(value_col)) != "null")
    millis = F.try_variant_get(F.col("_doc"), "$[0].r", "double")
    out = (
        df.withColumn("_doc", wrapped)
        .withColumn("_item", F.try_variant_get("_doc", "$[0]", "variant"))
        .withColumn("reason", F.when(~usable, F.lit("bad_envelope")))
        .withColumn("oem", F.try_variant_get(F.col("_doc"), "$[0].oem", "string"))
        .withColumn("received_at", F.timestamp_millis(millis.try_cast("bigint")))
        .withColumn("payload", F.try_variant_get(F.col("_doc"), "$[0].p", "variant"))
    )
    return settle(out.drop("_doc", "_item"), "reason")


def with_partition_key(
    df: DataFrame, mappings, fallback: tuple[str, ...] = FALLBACK_VIN_KEYS
) -> DataFrame:
    """Add ``key``: the mapped VIN value, else the first text among the usual VIN keys, else null."""
    mapped = by_vendor(mapping_dict(mappings), "vin", lambda spec, _: path_sql(spec["path"]))
    usual = [
        F.when(kind_of("payload", k) == "STRING", extract_path("payload", k)) for k in fallback
    ]
    return df.withColumn("key", F.coalesce(mapped, *usual))
