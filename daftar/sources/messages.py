"""Push deliveries and metric expositions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T

_STRINGS = ("doc_id", "title", "text", "source_url")


def decode_push(pushes: DataFrame, body: str = "body") -> DataFrame:
    """Envelope to document: message_id, subscription, the document's columns and ``reject_reason``.

    Every failure is permanent, so a bad message is a row with its reason, never an exception.
    """
    known = [c for c in pushes.columns if c != body]
    oversized = F.octet_length(body) > S.MAX_PUSH_BYTES
    envelope = F.when(~oversized, F.try_parse_json(body))
    rows = pushes.select(*known, oversized.alias("_big"), envelope.alias("_e"))

    def kind(value: Column) -> Column:
        return F.schema_of_variant(value)

    message = F.try_variant_get("_e", "$.message", "variant")
    data = F.try_variant_get("_e", "$.message.data", "variant")
    strict = F.when(kind(data) == "STRING", F.try_variant_get("_e", "$.message.data", "string"))
    # whole groups of four with at most two pads: anything else is not strict base64
    valid = strict.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    payload = F.when(valid, F.try_validate_utf8(F.try_to_binary(strict, F.lit("base64")).cast("string")))
    rows = rows.select(
        *known,
        "_big",
        F.col("_e").isNull().alias("_no_json"),
        F.coalesce(kind(F.col("_e")).startswith("OBJECT"), F.lit(False)).alias("_object"),
        F.coalesce(kind(message).startswith("OBJECT"), F.lit(False)).alias("_message"),
        strict.isNotNull().alias("_data"),
        F.coalesce(valid, F.lit(False)).alias("_base64"),
        F.try_parse_json(payload).alias("_d"),
        F.coalesce(F.try_variant_get("_e", "$.message.messageId", "string"), F.lit("")).alias("message_id"),
        F.coalesce(F.try_variant_get("_e", "$.subscription", "string"), F.lit("")).alias("subscription"),
    )
    texts = [
        F.when(kind(F.try_variant_get("_d", f"$.{n}", "variant")) == "STRING", F.try_variant_get("_d", f"$.{n}", "string")).alias(n)
        for n in _STRINGS
    ]
    url_kind = kind(F.try_variant_get("_d", "$.source_url", "variant"))
    rows = rows.select("*", *texts, (~url_kind.isin("STRING", "VOID")).alias("_odd_url"))
    reason = (
        F.when(F.col("_big"), "push body too large")
        .when(F.col("_no_json"), "push body is not JSON")
        .when(~F.col("_object"), "push body is not an object")
        .when(~F.col("_message"), "no message object")
        .when(~F.col("_data"), "message.data is not a string")
        .when(~F.col("_base64"), "message.data is not base64")
        .when(F.col("_d").isNull(), "payload is not JSON")
        .when(~F.coalesce(kind(F.col("_d")).startswith("OBJECT"), F.lit(False)), "payload is not an object")
        .when(F.col("_odd_url"), "source_url: not a string")
        .otherwise(T.document_reject_reason(*_STRINGS))
    )
    return rows.select(*known, "message_id", "subscription", *_STRINGS, reason.alias("reject_reason"))


# A sample line and a label pair of the exposition format.
SAMPLE_LINE = r"\A([a-zA-Z_:][a-zA-Z0-9_:]*)(\{.*\})?\s+(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|NaN|[+-]Inf)\z"
LABEL_PAIR = r"([a-zA-Z_][a-zA-Z0-9_]*)=\"((?:[^\"\\]|\\.)*)\""


def parse_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) per sample line; comments and lines of another form are skipped."""
    line = F.col(column)
    known = [c for c in lines.columns if c != column]
    kept = lines.where(~line.startswith("#") & line.rlike(SAMPLE_LINE))
    block = F.regexp_extract(line, SAMPLE_LINE, 2)
    keys = F.regexp_extract_all(block, F.lit(LABEL_PAIR), 1)
    raw = F.regexp_extract_all(block, F.lit(LABEL_PAIR), 2)
    values = F.transform(raw, lambda v: F.regexp_replace(v, r"\\(.)", "$1"))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    # a repeated label keeps its last value
    labels = F.map_from_entries(
        F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p.k))
    )
    text = F.regexp_extract(line, SAMPLE_LINE, 3)
    number = F.when(text.endswith("Inf"), F.concat(text, F.lit("inity"))).otherwise(text)
    number = F.regexp_replace(number, r"\A\+", "").cast("double")
    return kept.select(*known, F.regexp_extract(line, SAMPLE_LINE, 1).alias("name"), labels.alias("labels"), number.alias("value"))
