"""The command line over small files."""

import json

from lontar import __main__ as cli
from lontar.sources import tables

from .test_spreadsheet import write


def test_read(spark, tmp_path, capsys):
    docs = [{"doc_id": 1, "raw_text": "NIK : 3201014102900001\nNama : SITI AMINAH", "requested_type": "KTP"}, {"doc_id": 2, "raw_text": None}, {"doc_id": 2, "raw_text": "NO RANGKA : MHKA1BA1JFK000001", "requested_type": "STNK"}]
    (tmp_path / "docs.jsonl").write_text("\n".join(map(json.dumps, docs)))
    cli.main(["read", str(tmp_path / "docs.jsonl"), str(tmp_path / "out")])
    printed = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sum(r["count"] for r in printed) == 3 and {r["document_type"] for r in printed} == {"KTP", "STNK"}
    records = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert {r["fields"]["nama"]["value"] for r in records if r["doc_id"] == 1} == {"SITI AMINAH"}
    spark.createDataFrame([(1, "x")], "doc_id long, raw_text string").write.parquet(str(tmp_path / "p"))
    assert cli.read_documents(spark, str(tmp_path / "p")).first()["requested_type"] == "AUTO"


def test_postal(spark, tmp_path):
    write(tmp_path / "M_PROVINSI.xlsx", [["KODE_PROVINSI", "PROVINSI"], [32, "JAWA BARAT"]])
    write(tmp_path / "M_KOTA.xlsx", [["KODE_KOTA", "NAMA_KOTA", "KODE_PROVINSI"], [3273, "KOTA BANDUNG", 32]])
    write(tmp_path / "M_KECAMATAN.xlsx", [["KODE_KECAMATAN", "NAMA_KECAMATAN"], [327301, "BANDUNG WETAN"]])
    write(tmp_path / "M_KODEPOS.xlsx", [["KODE_POS", "ALAMAT", "KODE_KOTA", "KODE_KECAMATAN", "SIFAT_POS"], ["40114", "CIHAPIT, BANDUNG", 3273, 327301, "Kelurahan"]])
    cli.main(["postal", str(tmp_path), str(tmp_path / "tsv")])
    row = tables.read_postal_tsv(spark, str(tmp_path / "tsv")).first()
    assert (row["kode_pos"], row["city_name"], row["district_name"]) == ("40114", "KOTA BANDUNG", "BANDUNG WETAN")
