"""Spreadsheets of several kinds of cells, written here as zip files of XML."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from lontar.operators import lookup
from lontar.sources import spreadsheet

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letters(k):
    return chr(65 + k) if k < 26 else chr(64 + k // 26) + chr(65 + k % 26)


def write(path, rows, shared=False):
    strings: list[str] = []

    def cell(r, k, v):
        at = f'r="{letters(k)}{r}"'
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        if shared:
            strings.append(v)
            return f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c {at} t="inlineStr"><is><r><t>{escape(v[:2])}</t></r><r><t>{escape(v[2:])}</t></r></is></c>'

    body = "".join(f'<row r="{i}">{"".join(cell(i, k, v) for k, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in strings)}</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_cells(spark, tmp_path, shared):
    write(tmp_path / "a.xlsx", [["A ", None, "B & C", ""], ["x", "lost", 1.5], [], [None, None, "<y>"]], shared)
    write(tmp_path / "b.xlsx", [], shared)
    rows = spreadsheet.read_sheets(spark, f"{tmp_path}/*.xlsx").orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"]) for r in rows] == [(1, {"A": "x", "B & C": "1.5"}), (2, {}), (3, {"B & C": "<y>"})]
    assert {r["path"].rsplit("/", 1)[1] for r in rows} == {"a.xlsx"}


def test_many_rows_leave_in_batches(spark, tmp_path, monkeypatch):
    wide = [f"c{k}" for k in range(30)]
    write(tmp_path / "a.xlsx", [wide, *([i] * 30 for i in range(25))])
    assert spreadsheet.read_sheets(spark, str(tmp_path)).agg(F.sum(F.col("cells")["c29"].cast("int")), F.count("*")).first()[:] == (300, 25)
    assert [spreadsheet.column_number(x) for x in ("A1", "Z9", "AA10", "AD2", "")] == [0, 25, 26, 29, 0]


def test_postal_sheets(spark, tmp_path):
    write(tmp_path / "M_PROVINSI.xlsx", [["KODE_PROVINSI", "PROVINSI"], [32, "JAWA BARAT"], ["32.0", "JAWA BARAT"]])
    write(tmp_path / "M_KOTA.xlsx", [["KODE_KOTA", "NAMA_KOTA", "KODE_PROVINSI"], [3273.0, "KOTA BANDUNG", "32"], [99, "NOWHERE", 77]], True)
    write(tmp_path / "M_KECAMATAN.xlsx", [["KODE_KECAMATAN", "NAMA_KECAMATAN"], [327301, "BANDUNG WETAN"]])
    write(
        tmp_path / "M_KODEPOS.xlsx",
        [
            ["KODE_POS", "ALAMAT", "KODE_KOTA", "KODE_KECAMATAN", "SIFAT_POS"],
            [" 40114 ", "CIHAPIT, BANDUNG", 3273, 327301, "Kelurahan"],
            ["4011", "SHORT", 3273, 327301, "Kelurahan"],
            ["40115", "UNKNOWN CITY", 1, 327301, "Kelurahan"],
            ["40116", "NO DISTRICT", "3273", 0, "Kantor"],
            ["40117", "NO PROVINCE", 99, None, "Kantor"],
        ],
    )
    got = {r["kode_pos"]: r for r in spreadsheet.read_postal_sheets(spark, str(tmp_path)).collect()}
    assert set(got) == {"40114", "40116", "40117"}
    assert tuple(got["40114"]) == ("40114", "CIHAPIT, BANDUNG", "CIHAPIT", "Kelurahan", "3273", "KOTA BANDUNG", "32", "JAWA BARAT", "327301", "BANDUNG WETAN")
    assert (got["40116"]["district_code"], got["40116"]["district_name"], got["40117"]["province_name"]) == ("", "", "")
    asked = spark.createDataFrame([(1, None, "JAWA BARAT", "BANDUNG", "CIHAPIT", None, None)], "doc_id long, kode_pos string, provinsi string, kabupaten_kota string, kelurahan_desa string, kecamatan string, alamat string")
    assert lookup.lookup_postal(asked, spreadsheet.read_postal_sheets(spark, str(tmp_path))).first()["match"]["kode_pos"] == "40114"
