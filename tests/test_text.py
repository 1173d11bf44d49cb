"""Normalisers: accepted and rejected values."""

import unicodedata


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators import lookup

DAY = "2025-06-01"

CASES = [
    (T.id_number, "32.01-0101 9001 0001", "3201010190010001"),
    (T.id_number, "123", None),
    (T.repaired_id_number, "32O101019001000I", "3201010190010001"),
    (T.repaired_id_number, "3ZO10I0190SS0001", None),
    (T.plate_number, "b-1234.xyz", "B 1234 XYZ"),
    (T.plate_number, "B 12", "B 12"),
    (T.plate_number, "B 0000 XX", None),
    (T.plate_number, "ABC 1", None),
    (T.gender, "LAKl-LAKI", "LAKI-LAKI"),
    (T.gender, "PEREMPUAM", "PEREMPUAN"),
    (T.gender, "x", None),
    (T.religion, "Agama: Islam", "ISLAM"),
    (T.religion, "KATHOLIK", "KATHOLIK"),
    (T.marital_status, "BEIUM KAWIN", "BELUM KAWIN"),
    (T.marital_status, "CERAI MATI", "CERAI MATI"),
    (T.marital_status, "KAWIN", "KAWIN"),
    (T.citizenship, "VN1", "WNI"),
    (T.citizenship, "WNA", "WNA"),
    (T.citizenship, "USA", None),
    (T.expiry, "Seumur Hidup", "SEUMUR HIDUP"),
    (T.expiry, "1-2-2027", "01-02-2027"),
    (T.expiry, "1-2-1999", None),
    (T.rt_rw, "3/4", "003/004"),
    (T.rt_rw, "O12/OO3", "012/003"),
    (T.rt_rw, "003004", "003/004"),
    (T.rt_rw, "01-02-2020", None),
    (T.postal_code, "4O115", "40115"),
    (T.postal_code, "123", None),
    (T.month_date, "7 AGUSTUS 2026", "07-08-2026"),
    (T.iso_date, "29-02-2024", "2024-02-29"),
    (T.iso_date, "31-02-2024", None),
    (T.short_id_number, "1234 5678 9012 34", "12345678901234"),
    (T.mask_ids, "no 3201010190010001.", "no 320101******0001."),
    (T.address, "jalan  melati no5", "JL. MELATI NO. 5"),
    (T.person_name, "Siti Aminah", "SITI AMINAH"),
    (T.person_name, "NIK 12", None),
    (lambda c: T.year(c, F.to_date(F.lit(DAY))), "TAHUN 2O19", "2019"),
    (lambda c: T.year(c, F.to_date(F.lit(DAY))), "1900", None),
    (lambda c: T.birth_place_date(c, F.to_date(F.lit(DAY))), "BANDUNG, 01-02-1990", "BANDUNG, 01-02-1990"),
    (lambda c: T.birth_place_date(c, F.to_date(F.lit(DAY))), "BANDUNG, 41-02-1990", None),
    (lambda c: T.birth_date_of_id(c, F.to_date(F.lit(DAY))), "3201014102900001", "01-02-1990"),
    (lambda c: T.birth_date_of_id(c, F.to_date(F.lit(DAY))), "3201010113900001", None),
    (T.gender_of_id, "3201014102900001", "PEREMPUAN"),
]



def test_cases(spark):
    row = spark.range(1).select(*(f(F.lit(v)).alias(f"c{i}") for i, (f, v, _) in enumerate(CASES))).first()
    assert [(v, row[i]) for i, (_, v, _) in enumerate(CASES)] == [(v, want) for _, v, want in CASES]


def test_nulls(spark):
    row = spark.range(1).select(*(f(F.lit(None).cast("string")).alias(f"c{i}") for i, (f, _, _) in enumerate(CASES))).first()
    assert set(row) == {None}


def test_lines(spark):
    text = "  a ： b;\r\n\n\t c　d \n:;\n"
    assert spark.range(1).select(T.normalized_lines(F.lit(text))).first()[0] == ["a : b", "c d"]
    assert spark.range(1).select(T.normalized_lines(F.lit(None).cast("string"))).first()[0] == []


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789 ab-", max_size=40), min_size=20, max_size=60))
def test_masking_hides_every_standalone_id(spark, texts):
    masked = spark.createDataFrame([(t,) for t in texts], "t string").select(T.mask_ids(F.col("t")).alias("m"))
    assert masked.where(F.col("m").rlike(r"\b\d{16}\b")).count() == 0
    again = masked.select(T.mask_ids(F.col("m")).alias("n"), "m")
    assert again.where("n <> m").count() == 0


def test_accents_and_region_names(spark):
    rows = {"Çafé Ünïcödé Ł": "CAFE UNICODE", "ＡＢ１": "AB1", "é": "E", "Kota Bandung, Kec. Coblong": "BANDUNG COBLONG", "Daerah  Istimewa Yogyakarta": "DI YOGYAKARTA", "Kepulauan Riau": "KEP RIAU", "KOTABARU": "KOTABARU", "日本": "", "": ""}
    df = spark.createDataFrame([(k,) for k in rows], "x string")
    assert {r["x"]: r["got"] for r in df.select("x", lookup.normalized(F.col("x")).alias("got")).collect()} == rows
    for text in ("Århus naïve façade", "Ǆ ﬁ Þ", "a\u0301b", "½²"):
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        got = spark.createDataFrame([(text,)], "x string").select(T.fold_accents(F.col("x")).alias("got")).first()["got"]
        assert got == plain or len(plain) > len(got)
