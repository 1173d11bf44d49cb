"""Identity cards with lines out of order, and the operators on shapes of lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lontar.operators import line_codes as L
from lontar.operators.label_window import line_ngrams
from lontar.plans import card_repair as R
from lontar.plans import identity_card as I
from lontar.plans.fields import FIELD_TYPE
from lontar.sources import tables

HEAD = "PROVINSI JAWA BARAT\nKOTA BANDUNG\nNIK : 3201014102900001\n"
PLACES = {"kelurahan_desa": "CIHAPIT", "kecamatan": "SUKAJADI"}
SHAPES = {
    "swapped": (HEAD + "Kel/Desa\nSUKAJADI\nCIHAPIT\nKecamatan\nAgama : ISLAM", PLACES),
    "reversed": (HEAD + "Kecamatan\nKel/Desa\nRT/RW\nSUKAJADI\nLAKI-LAKI\nCIHAPIT\n003/004", PLACES),
    "bare": (HEAD + "Kel/Desa\nKecamatan\nCIHAPIT\nSUKAJADI", PLACES),
    "late": (HEAD + "RT/RW\nKel/Desa\n003/004\nKecamatan\nCIHAPIT\nSUKAJADI", PLACES),
    "misread labels": (HEAD + "KeWDesa : CIHAPIT\nXecamatan : SUKAJADI\nBerfaku Hingga : SEUMUR HIDUP", PLACES | {"berlaku_hingga": "SEUMUR HIDUP"}),
    "behind the id": ("KOTA BANDUNG\n3201014102900001\nCIHAPIT\n003/004\nKecamatan : SUKAJADI", PLACES),
    "fragments": (HEAD + "Kel/Desa : KELDEAN\nKecamatan\nSUKAJADI\nCIHAPIT", PLACES),
    "rewritten": (HEAD + "Kel/Desa : TANAHABANG\nKecamatan : SUKAJADI", {"kecamatan": "SUKAJADI"}),
    "plain": (HEAD + "Nama : SITI AMINAH\nKel/Desa : CIHAPIT\nKecamatan : SUKAJADI", PLACES | {"nama": "SITI AMINAH"}),
    "name above id": ("Nama\nJenis Kelamin : PEREMPUAN\nSITI AMINAH\n3201014102900001", {"nama": "SITI AMINAH"}),
    "name above birth": ("NIK : 3201014102900001\nSITI AMINAH\nTempat/Tgl Lahir : BANDUNG, 01-02-1990", {"nama": "SITI AMINAH"}),
    "name behind birth": ("Tempat/Tgl Lahir : BANDUNG, 01-02-1990\nPEREMPUAN\nAMINAH\nAgama : ISLAM", {"nama": "AMINAH"}),
    "wrapped": (HEAD + "Nama\nSITI AMINAH\nRAHAYU\nTempat/Tgl Lahir : BANDUNG, 01-02-1990", {"nama": "SITI AMINAH RAHAYU"}),
    "not wrapped": (HEAD + "Nama\nSITI AMINAH\nRAHAYU\nAlamat : JL MELATI NO 5", {"nama": "SITI AMINAH"}),
    "joined": (HEAD + "Nama : SITIRAHAYU", {"nama": "SITI RAHAYU"}),
    "initial": (HEAD + "Nama : SYARIFULA. WIJAYA", {"nama": "SYARIFUL A. WIJAYA"}),
    "province of city": ("KOTA JAKARTA TIMUR\nNIK : 3201014102900001", {"provinsi": "DKI JAKARTA", "kabupaten_kota": "JAKARTA TIMUR"}),
    "wrong year": (HEAD + "Tempat/Tgl Lahir : BANDUNG, 01-02-1980", {"tempat_tanggal_lahir": "BANDUNG, 01-02-1990"}),
    "other month": (HEAD + "Tempat/Tgl Lahir : BANDUNG, 01-03-1980", {"tempat_tanggal_lahir": "BANDUNG, 01-03-1980"}),
    "broken birth": (HEAD + "Tempat/Tgl Lahir\nBANDUNG,\n01-02-\n1990\nAgama : ISLAM", {"tempat_tanggal_lahir": "BANDUNG, 01-02-1990"}),
    "nothing": ("", {"nama": None, "kelurahan_desa": None, "kecamatan": None}),
}


@pytest.fixture(scope="module")
def cards(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in SHAPES.items()] + [("null", None)], "doc_id string, raw_text string")
    day = F.lit("2025-01-01").cast("date")
    return I.with_id_births(I.parse(rows, day), day).cache()


@pytest.fixture(scope="module")
def read(cards):
    return {r["doc_id"]: r["fields"] for r in cards.collect()}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(read, name):
    assert {k: read[name][k]["value"] for k in SHAPES[name][1]} == SHAPES[name][1]


def test_confidence_says_where_a_value_comes_from(read):
    assert read["plain"]["kelurahan_desa"]["confidence"] == 0.88 and read["plain"]["nama"]["raw"] == "Nama : SITI AMINAH"
    assert read["swapped"]["kelurahan_desa"]["confidence"] == 0.72 and read["swapped"]["kelurahan_desa"]["raw"] == "fallback:region_shape"
    assert (read["joined"]["nama"]["confidence"], read["initial"]["nama"]["confidence"], read["wrapped"]["nama"]["confidence"]) == (0.78, 0.82, 0.78)
    assert read["wrong year"]["tempat_tanggal_lahir"]["confidence"] == 0.88 and all(f["status"] == "missing" for f in read["null"].values())


def test_defaults(cards):
    rows = {r["doc_id"]: r["fields"] for r in I.with_defaults(cards).collect()}
    assert rows["misread labels"]["status_perkawinan"]["value"] == "BELUM KAWIN" and rows["misread labels"]["kewarganegaraan"]["confidence"] == 0.42
    assert rows["plain"]["kewarganegaraan"]["status"] == "missing"


def test_locate_against_search(spark):
    rnd = random.Random(3)
    codes = ["".join(rnd.choice("KCpuqtTN") for _ in range(rnd.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in codes], "codes string")
    cases = [("K[^KCpuq]{0,3}", "[puq]", ""), ("", "[pu]", "[^pu]{0,3}N"), ("", "p", ""), ("CK", "t", "[pq]")]
    for before, at, behind in cases:
        shape = re.compile(f"(?={before}){before}(?P<at>{at})" + (f"(?={behind})" if behind else ""))
        got = df.select("codes", L.locate(F.col("codes"), before, at, behind).alias("first"), L.locate(F.col("codes"), before, at, behind, last=True).alias("last")).collect()
        for r in got:
            # Every place that some beginning of `before` leads to.
            places = {m.end("at") - 1 for i in range(len(r["codes"])) for m in [shape.match(r["codes"], i)] if m}
            assert (r["first"] is None) == (not places) and (r["first"] in places or not places)
            if before == "":
                assert r["first"] == min(places, default=None) and r["last"] == max(places, default=None)


def test_fold_against_a_loop(spark):
    rnd = random.Random(9)
    pick = lambda: rnd.choice([None, "A", "B", "DESA"])
    flags = [(rnd.random() < 0.5, rnd.random() < 0.3, rnd.random() < 0.3, rnd.random() < 0.3) for _ in range(5)]
    rows = [(pick(), pick(), *(pick() for _ in range(10))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, " + ", ".join(f"p{i} string" for i in range(10)))
    proposals = [L.proposal(F.col(f"p{2 * i}"), F.col(f"p{2 * i + 1}"), *f) for i, f in enumerate(flags)]
    got = [tuple(r["x"]) for r in df.select(L.fold(F.col("a"), F.col("b"), proposals, R.is_fragment).alias("x")).collect()]
    for row, found in zip(rows, got, strict=True):
        a, b = row[:2]
        for i, (fills, shifts, swaps, equals) in enumerate(flags):
            p, q = row[2 + 2 * i : 4 + 2 * i]
            whole = p is not None and q is not None
            same = a is not None and a == b
            if whole and ((shifts and a == q) or (swaps and a == q and b == p) or (equals and same)):
                a, b = p, q
                continue
            bad = lambda v: v is None or v == "DESA" or same
            a, b = (p if fills and p is not None and bad(a) else a), (q if fills and q is not None and bad(b) else b)
        assert found == (a, b)


def test_line_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], 1), ([], 0), (["a"], 0)], "lines array<string>, at int")
    got = [r["x"] for r in df.select(line_ngrams(F.col("lines"), F.col("at"), 3).alias("x")).collect()]
    assert got == [["b", "b c", "b c d", "c", "c d", "d"], [], ["a"]]


def test_kinds_of_lines(spark):
    lines = {
        "3201014102900001": "N", "Nama :": "m", "KEL/DESA": "K", "Kel/Desa : X": "k", "KECAMATAN": "C", "Kecamatan : X": "c", "RT/RW 3/4": "U", "RT/RW": "t", "003/004": "T",
        "Tempat/Tgl Lahir": "b", "BANDUNG, 01-02-1990": "B", "NIK": "n", "Alamat": "x", "LAKI-LAKI": "y", "SITI AMINAH": "p", "AMINAH": "u", "JAKARTA TIMUR": "R", "ABC 12": "q", "JL MELATI": "a", "??": "z",
    }
    df = spark.createDataFrame([(k, v) for k, v in lines.items()], "line string, want string")
    assert {r["line"]: r["got"] for r in df.select("line", R.kind(F.col("line")).alias("got")).collect()} == lines
    assert set(lines.values()) - {"z"} == set(R.KINDS)


def test_spaced_names(spark):
    names = {
        "SITIRAHAYU": "SITI RAHAYU", "BUDISANTOSO": "BUDI SANTOSO", "BUDISANTIKA": "BUDISANTIKA", "DEWIAYU": "DEWIAYU", "MUHAMMADRIZKY ALI": "MUHAMMAD RIZKY ALI", "PUTRIAYUNI": "PUTRI AYUNI",
        "KARYAWAN": "KARYAWAN", "SETIOWATISUSANTI": "SETIOWATI SUSANTI", "SYARIFULB.": "SYARIFUL B.", "NURUL HIDAYAH": "NURUL HIDAYAH",
    }
    df = spark.createDataFrame([(k,) for k in names], "name string")
    assert {r["name"]: r["got"] for r in df.select("name", R.spaced_name(F.col("name")).alias("got")).collect()} == names


POSTAL = [("40114", "CIHAPIT BANDUNG WETAN", "CIHAPIT", "kelurahan", "3273", "KOTA BANDUNG", "32", "JAWA BARAT", "327301", "BANDUNG WETAN"), ("13330", "CAWANG KRAMAT JATI", "CAWANG TIMUR", "kelurahan", "3175", "KOTA JAKARTA TIMUR", "31", "DKI JAKARTA", "317501", "CAWANG")]


def test_postal_by_row_and_canonical_names(spark):
    postal = spark.createDataFrame(POSTAL, list(tables.POSTAL_COLUMNS))
    card = "PROVINSI JAWA BARA\nKOTA BANDUNG\nNIK : 3201014102900001\nKel/Desa : CI HAPIT\nKecamatan : BANDUNGWETAN"
    texts = [(1, card), (1, card), (None, card), (None, card), (2, card + "\nKode Pos : 40114"), (3, card + "\nKode Pos : 99999"), (4, "Nama : SITI AMINAH"), (5, None)]
    parsed = I.parse(spark.createDataFrame(texts, "doc_id long, raw_text string").withColumn("match", F.lit("mine")), F.lit("2025-01-01").cast("date"))
    got = I.with_postal(parsed, postal).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in texts), key=repr) and {r["match"] for r in got} == {"mine"}
    value = lambda r, n: r["fields"][n]["value"]
    filled = [r for r in got if r["doc_id"] in (1, None)]
    assert len(filled) == 4 and {value(r, "kode_pos") for r in filled} == {"40114"}
    for r in filled:
        assert (value(r, "provinsi"), value(r, "kelurahan_desa"), value(r, "kecamatan")) == ("JAWA BARAT", "CIHAPIT", "BANDUNG WETAN")
        assert r["postal_match"]["city_code"] == "3273" and r["fields"]["kecamatan"]["evidence"][-1] == "db_kode_wilayah:canonical_kecamatan"
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["fields"]["kode_pos"]["status"] == "ok" and by_id[3]["fields"]["kode_pos"]["status"] == "invalid" and by_id[4]["postal_match"] is None


def test_points_of_the_compass_come_back(spark):
    fields = lambda **v: {k: (x, 0.9, "ok" if x else "missing", [], None) for k, x in v.items()}
    kind = f"fields map<string,{FIELD_TYPE}>"
    match = "match struct<province_name:string,city_name:string,locality:string,district_name:string,confidence:double,match_status:string>"
    entry = ("DKI JAKARTA", "KOTA JAKARTA TIMUR", "CAWANG TIMUR", "CAWANG", 0.95, "exact_match")
    rows = [
        (fields(provinsi=None, kabupaten_kota="JAKARTA TIMU", kelurahan_desa="CAWANG", kecamatan="CAWANG"), entry),
        (fields(provinsi="BANTEN", kabupaten_kota=None, kelurahan_desa="CAWANG", kecamatan="OTHER"), entry),
        (fields(provinsi=None, kabupaten_kota=None, kelurahan_desa="CAWANG", kecamatan="CAWANG"), (*entry[:4], 0.7, "partial_match")),
        (fields(provinsi=None, kabupaten_kota=None, kelurahan_desa=None, kecamatan=None), None),
    ]
    df = spark.createDataFrame(rows, f"{kind}, {match}")
    names = ("provinsi", "kabupaten_kota", "kelurahan_desa", "kecamatan")
    new = I.canonical_fields(F.col("fields"), F.col("match"))
    got = [tuple(r) for r in df.select(*(new[n]["value"].alias(n) for n in names)).collect()]
    assert got == [("DKI JAKARTA", "JAKARTA TIMUR", "CAWANG TIMUR", None), (None, "JAKARTA TIMUR", None, None), (None,) * 4, (None,) * 4]


def test_birth_from_id(spark):
    rows = [("BANDUNG, 01-02-1980", "01-02-1990", "BANDUNG, 01-02-1990"), ("BANDUNG, 01-02-1970", "01-02-1990", "BANDUNG, 01-02-1990"), ("BANDUNG, 01-02-1951", "01-02-1990", None), ("BANDUNG, 02-02-1990", "01-02-1990", None), (None, "01-02-1990", None), ("X, 01-02-1990", None, None)]
    df = spark.createDataFrame(rows, "value string, born string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", R.birth_from_id(F.col("value"), F.col("born")).alias("got")).collect())


def test_place_names(spark):
    rows = {"TANAHABANG": "TANAH ABANG", ": CIHAPIT -": "CIHAPIT", "BEKASI KOTA": "BEKASI KOTA", "KOTA BEKASI": None, "DESA": None, "JL MELATI": None, "TAMAN SARI": "TAMAN SARI", "ISLAM": None, "01-02-1990": None, "CIPETE 2": "CIPETE 2", "AB": None, "C!HAPIT": "CIHAPIT"}
    df = spark.createDataFrame([(k,) for k in rows], "line string")
    assert {r["line"]: r["got"] for r in df.select("line", R.place_name(F.col("line")).alias("got")).collect()} == rows

