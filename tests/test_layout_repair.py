"""Fields by position and the join back to parsed cards."""

import pytest
from pyspark.sql import functions as F

from lontar.operators import layout, layout_repair
from lontar.plans import identity_card
from lontar.plans.fields import FIELD_TYPE


def tokens(spark, cards):
    rows = [(i, w, [[x * 10.0, y * 20.0], [x * 10.0 + 8, y * 20.0 + 10]]) for i, lines in cards.items() for y, line in enumerate(lines) for x, w in enumerate(line.split())]
    return layout.layout_lines(layout.positioned(spark.createDataFrame(rows, "doc_id long, text string, bbox array<array<double>>")))


CARDS = {
    1: ["NIK 1", "Kel/Desa : CIHAPIT", "Kecamatan SUKAJADI", "x", "Status Perkawinan KAWIN", "Kewarganegaraan WNA", "Berlaku Hingga 1-2-2030"],
    2: ["f", "f", "f", "f", "f", "NIK 1", "KeWDesa TEGAL SARI", "xx ECAMATAN BARU KOTA", "SEUMURHIDUP", "zz", "Berfaku Hingga", "zz", "zz", "VNI", "Kevrganegaraan", "q"],
    3: ["KAWIN STATUS", "a", "b", "c", "Kel/Desa ISLAM 12-12-2020", "Kec AGAMA", "WNI", "Berlaku"],
}


def test_values_by_position(spark):
    got = {r["doc_id"]: r["found"] for r in layout_repair.by_position(tokens(spark, CARDS)).collect()}
    assert got[1] == {"kelurahan_desa": "CIHAPIT", "kecamatan": "SUKAJADI", "berlaku_hingga": "01-02-2030", "status_perkawinan": "KAWIN", "kewarganegaraan": "WNA"}
    # The expiry stands two lines above its label; the citizenship a line above its own.
    assert got[2] == {"kelurahan_desa": "TEGAL SARI", "berlaku_hingga": "SEUMUR HIDUP", "kewarganegaraan": "WNI"}
    assert got[3] == {}


def parsed_cards(spark):
    empty = (None, 0.0, "missing", [], None)
    card = lambda **v: {n: v.get(n, empty) for n in identity_card.LABELS}
    default = ("BELUM KAWIN", 0.35, "ok", [], layout_repair.DEFAULT_STATUS_RAW)
    own = ("CERAI MATI", 0.5, "ok", [], "line")
    rows = [(1, "KTP", card(status_perkawinan=default)), (1, "KTP", card(status_perkawinan=own, kecamatan=("LAMA", 0.4, "ok", [], "x"))), (2, "STNK", card()), (9, "KTP", card()), (None, "KTP", card())]
    return spark.createDataFrame(rows, f"doc_id long, document_type string, fields map<string,{FIELD_TYPE}>").withColumn("found", F.lit("mine"))


def test_good_values_stay(spark):
    rows = layout_repair.with_layout(parsed_cards(spark), tokens(spark, CARDS)).collect()
    assert len(rows) == 5 and {r["found"] for r in rows} == {"mine"}
    short = [(r["doc_id"], {n: (f["value"], f["confidence"]) for n, f in r["fields"].items() if f["value"]}) for r in rows]
    first, second = (v for i, v in sorted(short, key=lambda x: str(x[1])) if i == 1)
    both = sorted([first, second], key=lambda v: v["status_perkawinan"][0])
    assert both[0]["status_perkawinan"] == ("CERAI MATI", 0.88) and both[0]["kecamatan"] == ("LAMA", 0.84) and both[0]["kelurahan_desa"] == ("CIHAPIT", 0.78)
    assert both[1]["status_perkawinan"] == ("KAWIN", 0.78) and both[1]["kecamatan"] == ("SUKAJADI", 0.78)
    assert [v for i, v in short if i in (2, 9, None)] == [{}, {}, {}]
    assert layout_repair.with_layout(parsed_cards(spark).limit(0), tokens(spark, CARDS)).count() == 0


@pytest.mark.parametrize("text, want", [("SEUMUR HIDUP", "SEUMUR HIDUP"), ("SEUMUR H1DUP", "SEUMUR HIDUP"), ("1.2.1999", "01-02-1999"), ("2030", None), ("", None), (None, None)])
def test_expiry_values(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(layout_repair.expiry_value(F.col("x")).alias("v")).first()["v"] == want
