"""Replies of remote readers: strict JSON to the record of a document, with a reason for each reply that is none.

Everything is an expression over VARIANT; a reply that breaks the contract keeps
its row, with `error` set and no fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.functions.text import let
from lontar.plans.fields import FIELD_TYPE

#: Words for the two states of a field, warnings that are passed on, and their beginnings.
OK_WORDS = ("ok", "present", "valid", "found", "read", "detected", "confirmed")
MISSING_WORDS = ("missing", "absent", "unreadable", "not_found", "not found", "empty")
WARNINGS = ("document_type:auto_guess", "document_type_mismatch", "document_type_unknown", "screen_or_desktop_capture", "blur_detected", "document_too_small", "low_text_density")
WARNING_STARTS = "^(?:missing_required:|invalid:|quality:)"
GIVEN, INVALID = 0.85, 0.35


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... or null of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _part(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _truthy(v: Column) -> Column:
    """Whether a value says something: null, false, 0, empty texts, lists and objects do not."""
    text = F.coalesce(F.to_json(v), F.lit("null"))
    number = text.try_cast("double")
    return ~text.isin("null", "false", '""', "[]", "{}") & ~F.coalesce(number == 0, F.lit(False))


def rescued(reply: Column) -> Column:
    """The JSON object of a reply: the whole, what stands between fences, or from the first brace to the last; else the reply."""
    inside = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    good = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(good(reply), good(inside), good(braces), reply)


def _field(v: Column) -> Column:
    """Field of one value: an object with its parts, or a bare value."""

    def of_object(o: Column) -> Column:
        value = _part(o, "value")
        says = F.when(value.isNotNull(), _truthy(value)).otherwise(False)
        word = F.lower(F.trim(F.coalesce(_part(o, "status", "string"), F.lit("ok"))))
        status = F.when(~says, "missing").when(word.isin(*OK_WORDS), "ok").when(word.isin(*MISSING_WORDS), "missing").otherwise(word)
        evidence = _part(o, "evidence")
        listed = F.try_variant_get(evidence, "$", "array<string>")
        one = _text(evidence)
        proof = F.when(evidence.isNull() | F.is_variant_null(evidence), F.array().cast("array<string>")).when(_kind(evidence) == "ARRAY", listed).otherwise(F.array(one))
        confidence = F.coalesce(_part(o, "confidence", "double"), F.when(says, GIVEN).otherwise(0.0))
        return F.struct(_text(value).alias("value"), confidence.alias("confidence"), status.alias("status"), proof.alias("evidence"), _part(o, "raw", "string").alias("raw")).cast(FIELD_TYPE)

    bare = _text(v)
    given = F.struct(bare.alias("value"), F.lit(GIVEN).alias("confidence"), F.lit("ok").alias("status"), F.array(bare).alias("evidence"), F.lit(None).alias("raw")).cast(FIELD_TYPE)
    none = F.struct(F.lit(None).alias("value"), F.lit(0.0).alias("confidence"), F.lit("missing").alias("status"), F.array().alias("evidence"), F.lit(None).alias("raw")).cast(FIELD_TYPE)
    return F.when(v.isNotNull() & (_kind(v) == "OBJECT"), let(v, of_object)).when(v.isNotNull() & _truthy(v), given).otherwise(none)


def _checked_plate(f: Column) -> Column:
    plate = T.plate_number(f["value"])
    good, bad = f.withField("value", plate), f.withField("status", F.lit("invalid")).withField("confidence", F.least(f["confidence"], F.lit(INVALID)))
    return F.when(F.coalesce(f["value"], F.lit("")) == "", f).when(plate.isNotNull(), good).otherwise(bad)


def read_replies(replies: DataFrame, names: dict[str, list[str]], reply_col: str = "reply", type_col: str = "requested_type", fenced: bool = False) -> DataFrame:
    """Add document_type, schema_version, fields, warnings, reply_text and error to replies.

    `names` are the fields of each document type; AUTO counts as KTP.  Errors, in
    this order: not_json, not_object, unknown_type, fields_not_object,
    bad_confidence (one that is given and is no number).  Null replies are
    not_json; with `fenced`, an object inside other text is looked for first.
    """
    reply = rescued(F.col(reply_col)) if fenced else F.col(reply_col)
    rows = replies.withColumn("_v", F.try_parse_json(reply))
    v = F.col("_v")
    kind = F.upper(F.coalesce(F.nullif(_part(v, "document_type", "string"), F.lit("")), F.col(type_col), F.lit("AUTO")))
    given = _part(v, "fields")
    holds = F.coalesce(given.isNotNull() & _truthy(given), F.lit(False))
    rows = rows.withColumns({"_type": F.when(kind == "AUTO", "KTP").otherwise(kind), "_fields": F.when(holds, given), "_listed": F.when(_kind(v) == "OBJECT", _part(v, "warnings"))})
    every = sorted({n for some in names.values() for n in some})
    confidence = [F.try_variant_get(F.col("_fields"), f"$.{n}.confidence", "variant") for n in every]
    wrong = [c.isNotNull() & F.try_variant_get(c, "$", "double").isNull() for c in confidence]
    any_wrong = F.exists(F.array(*wrong), lambda x: x)
    error = (
        F.when(v.isNull(), "not_json")
        .when(_kind(v) != "OBJECT", "not_object")
        .when(~F.col("_type").isin(*names), "unknown_type")
        .when(F.col("_fields").isNotNull() & (_kind(F.col("_fields")) != "OBJECT"), "fields_not_object")
        .when(F.coalesce(any_wrong, F.lit(False)), "bad_confidence")
    )
    rows = rows.withColumn("_error", error)
    made = {n: _field(F.try_variant_get(F.col("_fields"), f"$.{n}", "variant")) for n in every}
    if "nomor_polisi" in made:
        made["nomor_polisi"] = F.when(F.col("_type") == "STNK", let(made["nomor_polisi"], _checked_plate)).otherwise(made["nomor_polisi"])
    whole = F.create_map(*(x for n, f in made.items() for x in (F.lit(n), f)))
    own = F.map_filter(whole, lambda k, _: F.array_contains(F.element_at(F.create_map(*(x for t, some in names.items() for x in (F.lit(t), F.array(*map(F.lit, some))))), F.col("_type")), k))
    rows = rows.withColumn("fields", F.when(F.col("_error").isNull(), own))
    passed = F.filter(F.transform(F.coalesce(F.try_variant_get(F.col("_listed"), "$", "array<string>"), F.array().cast("array<string>")), lambda w: F.regexp_replace(w, r"^\s+|\s+$", "")), lambda w: w.rlike(WARNING_STARTS) | w.isin(*WARNINGS))
    plate = F.when(F.try_element_at("fields", F.lit("nomor_polisi"))["status"] == "invalid", "invalid:nomor_polisi")
    warnings = F.when(plate.isNotNull() & ~F.array_contains(passed, plate), F.array_append(passed, plate)).otherwise(passed)
    no_error = F.col("_error").isNull()
    rows = rows.withColumns({
        "document_type": F.when(no_error, F.col("_type")),
        "schema_version": F.when(no_error, F.concat(F.lower("_type"), F.lit(".agent.v1"))),
        "warnings": F.when(no_error, F.coalesce(warnings, passed)),
        "reply_text": F.when(no_error, F.coalesce(_part(v, "raw_text", "string"), F.lit(""))),
        "error": F.col("_error"),
    })
    return rows.drop("_v", "_type", "_fields", "_listed", "_error")
