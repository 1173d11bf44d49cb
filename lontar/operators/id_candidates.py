"""Identity numbers read again from parts of a card, scored by what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.plans.fields import FIELD_TYPE

#: Misreadings of the label, the score's parts and its cap, and the confidence of a number in a line.
LABELS = ("NIK", "NTK", "HIK", "N1K", "NIKK")
BASE, BY_CONFIDENCE, BY_LABEL, BY_BIRTH, CAP = 0.55, 0.2, 0.18, 0.18, 0.92
LINE_CONFIDENCE = 0.78
#: Tokens and lines on either side that may hold the label, and the shape of a spaced number.
TOKEN_WINDOW, LINE_WINDOW = 3, 2
SPACED = r"(?<!\d)(\d[\d\s.:\-/]{14,24}\d)(?!\d)"
_CANDIDATE = "struct<score:double,value:string>"


def birth_segments(birth: Column, gender: Column, raw_text: Column) -> Column:
    """DDMMYY as an identity number shows it, for every date of the birth field and the text; days of women are 40 more."""
    dates = F.regexp_extract_all(F.concat_ws("\n", birth, raw_text), F.lit(r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"), 0)

    def segments(d: Column) -> Column:
        part = lambda k: F.get(d, F.lit(k)).cast("int")
        made = lambda day: F.format_string("%02d%02d%02d", day, part(1), part(2) % 100)
        days = F.when(gender == "PEREMPUAN", F.array(made(part(0) + 40))).when(gender == "LAKI-LAKI", F.array(made(part(0)))).otherwise(F.array(made(part(0)), made(part(0) + 40)))
        return F.when(part(0).between(1, 31) & part(1).between(1, 12), days).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.transform(dates, lambda x: F.split(x, "[-/.]")), segments))


def _around(texts: Column, at: Column, window: int) -> Column:
    start = F.greatest(at - window, F.lit(0))
    return F.array_join(F.slice(texts, start + 1, at + window - start + 1), " ")


def _scored(value: Column, confidence: Column, around: Column, segments: Column) -> Column:
    """(score, value) of an acceptable candidate: one near a label or with the right birth date."""
    near = T.compact(around).rlike("|".join(LABELS))
    born = F.array_contains(segments, F.substring(value, 7, 6))
    held = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    score = F.lit(BASE) + held * BY_CONFIDENCE + F.when(near, BY_LABEL).otherwise(0.0) + F.when(born, BY_BIRTH).otherwise(0.0)
    return F.when(value.isNotNull() & (near | born), F.struct(F.least(score, F.lit(CAP)).alias("score"), value.alias("value")))


def best_candidate(tokens: Column, raw_text: Column, segments: Column) -> Column:
    """(score, value) of the best number among tokens (text, confidence) and lines; of equal ones the first."""
    texts = F.transform(tokens, lambda t: t["text"])
    of_tokens = F.transform(tokens, lambda t, i: T.let(T.id_number(t["text"]), lambda v: _scored(v, t["confidence"].cast("double"), _around(texts, i, TOKEN_WINDOW), segments)))
    lines = F.filter(F.transform(F.split(raw_text, r"\r?\n|\r"), F.trim), lambda x: x != "")

    def of_line(line: Column, i: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(SPACED), 1)
        return F.transform(found, lambda x: T.let(T.id_number(x), lambda v: _scored(v, F.lit(LINE_CONFIDENCE), _around(lines, i, LINE_WINDOW), segments)))

    every = F.concat(of_tokens, F.flatten(F.transform(lines, of_line)))
    better = lambda best, x: F.when(x.isNotNull() & (best.isNull() | (x["score"] > best["score"])), x).otherwise(best)
    return F.aggregate(every, F.lit(None).cast(_CANDIDATE), better)


def repair_id(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Cards whose number is not ok take the best number of `reread`, an array of (source, raw_text, tokens).

    Rows carry fields, warnings, raw_text and reread; `reread` null or empty, or
    without an acceptable number, leaves the row as it is.
    """
    value = lambda n: F.try_element_at("fields", F.lit(n))["value"]
    segments = birth_segments(value("tempat_tanggal_lahir"), F.upper(F.coalesce(value("jenis_kelamin"), F.lit(""))), F.col("raw_text"))
    kind = "struct<score:double,value:string,source:string>"

    def better(best: Column, part: Column) -> Column:
        found = best_candidate(part["tokens"], part["raw_text"], F.col("_segments"))
        named = T.let(found, lambda c: F.when(c.isNotNull(), F.struct(c["score"].alias("score"), c["value"].alias("value"), part["source"].alias("source"))))
        return T.let(named, lambda x: F.when(x.isNotNull() & (best.isNull() | (x["score"] > best["score"])), x).otherwise(best))

    rows = parsed.withColumn("_segments", segments)
    open_ = F.coalesce(F.col("document_type") == "KTP", F.lit(False)) & F.coalesce(F.try_element_at("fields", F.lit("nik"))["status"] != "ok", F.lit(False))
    rows = rows.withColumn("_best", F.when(open_, F.aggregate(F.coalesce("reread", F.expr("filter(reread, x -> false)")), F.lit(None).cast(kind), better)))
    best = F.col("_best")
    made = F.struct(
        best["value"].alias("value"),
        F.round(best["score"], 2).alias("confidence"),
        F.lit("ok").alias("status"),
        F.array(best["value"], F.concat(F.lit("image_fallback:"), best["source"])).alias("evidence"),
        F.lit("image_nik_fallback").alias("raw"),
    ).cast(FIELD_TYPE)
    fields = F.transform_values("fields", lambda k, v: F.when((k == "nik") & best.isNotNull(), made).otherwise(v))
    warnings = F.when(best.isNotNull(), F.array_except("warnings", F.array(F.lit("invalid:nik"), F.lit("missing_required:nik")))).otherwise(F.col("warnings"))
    return rows.withColumns({"fields": fields, "warnings": warnings}).drop("_segments", "_best")
