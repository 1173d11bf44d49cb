"""Numbers read again from parts of a card."""

import pytest
from pyspark.sql import functions as F

from lontar.operators.id_candidates import repair_id
from lontar.plans.fields import FIELD_TYPE

GOOD, OTHER = "3171016505900001", "3171011203850002"


def rows(spark, reread, status="invalid", gender="PEREMPUAN", kind="KTP"):
    fields = {"nik": (None, 0.35, status, [], None), "tempat_tanggal_lahir": ("BANDUNG, 25-05-1990", 0.9, "ok", [], None), "jenis_kelamin": (gender, 0.9, "ok", [], None)}
    schema = f"doc_id long, document_type string, raw_text string, warnings array<string>, fields map<string,{FIELD_TYPE}>, reread array<struct<source:string,raw_text:string,tokens:array<struct<text:string,confidence:double>>>>"
    return spark.createDataFrame([(1, kind, "text", ["invalid:nik", "other"], fields, reread)], schema)


@pytest.mark.parametrize(
    ("reread", "value", "confidence"),
    [
        # Label and birth date: capped; a number with the date alone beats one with neither.
        ([("a", "", [("NIK", 0.9), (GOOD, 1.0)])], GOOD, 0.92),
        ([("a", f"x\n{OTHER}\ny", []), ("b", f"{GOOD[:6]} {GOOD[6:12]}-{GOOD[12:]}", [])], GOOD, 0.89),
        ([("a", f"N1K\n{OTHER}", [])], OTHER, 0.89),
        ([("a", f"{OTHER}", [(OTHER, 0.5)])], None, 0.35),
        ([], None, 0.35),
        (None, None, 0.35),
    ],
)
def test_best_number(spark, reread, value, confidence):
    got = repair_id(rows(spark, reread)).first()
    nik = got["fields"]["nik"]
    assert (nik["value"], nik["confidence"]) == (value, pytest.approx(confidence))
    assert got["warnings"] == (["other"] if value else ["invalid:nik", "other"]) and nik["status"] == ("ok" if value else "invalid")
    if value:
        assert nik["evidence"] == [value, f"image_fallback:{reread[-1][0]}"]


def test_other_rows_stay(spark):
    part = [("a", "", [("NIK", 0.9), (GOOD, 1.0)])]
    for df in (rows(spark, part, status="ok"), rows(spark, part, kind="STNK")):
        assert repair_id(df).select(F.to_json("fields"), "warnings").first() == df.select(F.to_json("fields"), "warnings").first()
