"""Parsers, label windows, lookup, assessment, summary, layout, extractors and streams on small invented rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators import assess, extract, fuzzy, layout, lookup, summary
from lontar.operators.label_window import capture, capture_relational, explode_lines
from lontar.plans import catalogue, documents, identity_card, vehicle_registration
from lontar.sources import tables
from lontar.streaming import events as streams

DAY = "2025-06-01"

CARD = """PROVINSI JAWA BARAT
KOTA BANDUNG
NIK : 3201010102900001
Nama : SITI AMINAH
Tempat/Tgl Lahir : BANDUNG, 01-02-1990
Jenis Kelamin : LAKI-LAKI
Alamat
JL MELATI NO 5
RT/RW : 3/4
Kel/Desa : CIHAPIT
Kecamatan : BANDUNG WETAN
Agama : ISLAM
Status Perkawinan : BELUM KAWIN
Pekerjaan : PELAJAR/MAHASISWA
Kewarganegaraan : WNI
Berlaku Hingga : SEUMUR HIDUP"""
VEHICLE = """SURAT TANDA NOMOR KENDARAAN
NOMOR POLISI : B 1234 XYZ
NAMA PEMILIK : PT CONTOH JAYA
ALAMAT : JL MAWAR 7
MERK : TOYOTA
TYPE : AVANZA 1.3
TAHUN PEMBUATAN : 2019
WARNA : HITAM METALIK
NOMOR RANGKA : MHKA1BA1JFK123456
NOMOR MESIN : 1NRF123456
BAHAN BAKAR : BENSIN
BERLAKU SAMPAI : 7 AGUSTUS 2026"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("card", CARD, "AUTO"), ("vehicle", VEHICLE, "STNK"), ("other", "halo dunia", "AUTO"), ("none", None, "KTP"), ("wrong", VEHICLE, "KTP")]
    docs = spark.createDataFrame(rows, "doc_id string, raw_text string, requested_type string")
    return documents.parse_documents(docs, F.to_date(F.lit(DAY))).cache()


def values(parsed, doc_id):
    fields = parsed.where(F.col("doc_id") == doc_id).first()["fields"]
    return {k: v["value"] for k, v in fields.items()}


def test_identity_card(parsed):
    got = values(parsed, "card")
    assert got == {
        "provinsi": "JAWA BARAT",
        "kabupaten_kota": "BANDUNG",
        "nik": "3201010102900001",
        "nama": "SITI AMINAH",
        "tempat_tanggal_lahir": "BANDUNG, 01-02-1990",
        "jenis_kelamin": "LAKI-LAKI",
        "alamat": "JL. MELATI NO. 5",
        "rt_rw": "003/004",
        "kelurahan_desa": "CIHAPIT",
        "kecamatan": "BANDUNG WETAN",
        "agama": "ISLAM",
        "status_perkawinan": "BELUM KAWIN",
        "pekerjaan": "PELAJAR/MAHASISWA",
        "kewarganegaraan": "WNI",
        "kode_pos": None,
        "berlaku_hingga": "SEUMUR HIDUP",
    }


def test_vehicle_registration(parsed):
    got = values(parsed, "vehicle")
    assert got["nomor_polisi"] == "B 1234 XYZ" and got["nama_pemilik"] == "PT CONTOH JAYA" and got["tahun_pembuatan"] == "2019"
    assert got["nomor_rangka"] == "MHKA1BA1JFK123456" and got["nomor_mesin"] == "1NRF123456" and got["warna"] == "HITAM"
    assert got["bahan_bakar"] == "BENSIN" and got["berlaku_sampai"] == "07-08-2026" and got["merek"] == "TOYOTA"


def test_types_and_warnings(parsed):
    rows = {r["doc_id"]: r for r in parsed.collect()}
    assert {k: r["document_type"] for k, r in rows.items()} == {"card": "KTP", "vehicle": "STNK", "other": "KTP", "none": "KTP", "wrong": "STNK"}
    assert rows["card"]["warnings"] == [] and rows["vehicle"]["warnings"] == []
    assert rows["other"]["warnings"][-1] == "document_type:auto_guess"
    assert "missing_required:nik" in rows["none"]["warnings"]


def test_assessment(parsed):
    rows = {r["doc_id"]: r for r in documents.assess_documents(parsed, F.to_date(F.lit(DAY))).collect()}
    decisions = {k: r["input_assessment"]["decision"] for k, r in rows.items()}
    assert decisions == {"card": "approved_for_auto", "vehicle": "approved_for_auto", "other": "needs_review", "none": "rejected_input", "wrong": "rejected_input"}
    assert rows["wrong"]["input_assessment"]["reason_codes"][0] == "document_type_mismatch"
    assert rows["vehicle"]["score"] > rows["other"]["score"]


def test_best_attempt_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, "x"), ("a", 1, 3.0, "y"), ("a", 2, 3.0, "z")], "doc_id string, attempt_index int, score double, tag string")
    assert documents.best_attempt(rows).first()["tag"] == "y"


def test_checkout_and_long_fields(parsed):
    row = documents.checkout(parsed.where("doc_id = 'vehicle'")).first()
    assert row["ready"] and set(row["fields"]) == {"nomor_polisi", "nama_pemilik", "nomor_rangka", "nomor_mesin"}
    assert documents.long_fields(parsed).where("doc_id = 'vehicle'").count() == 12


def test_label_window(spark):
    text = "x\nNama\n: \nBUDI SANTOSO\nNIK 1\nbefore\nAgama"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    lines = T.normalized_lines(F.col("text"))
    got = docs.select("doc_id", capture(lines, ["NAMA"], ["NIK"], after=3)["value"].alias("after"), capture(lines, ["AGAMA"], (), after=0, before=2, normalize=T.person_name)["value"].alias("before"), capture(lines, ["NAMA"], ["BUDI"], after=3)["value"].alias("stopped")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "BUDI SANTOSO", "BEFORE", None), (2, None, None, None), (3, None, None, None)]
    relational = capture_relational(explode_lines(docs, lines), ["NAMA"], after=2)
    assert [tuple(r) for r in relational.collect()] == [(1, "BUDI SANTOSO")]


POSTAL = [
    ("40114", "CIHAPIT, JL RIAU", "CIHAPIT", "kelurahan", "1", "KOTA BANDUNG", "32", "JAWA BARAT", "10", "BANDUNG WETAN"),
    ("40115", "CITARUM, JL DIPONEGORO", "CITARUM", "kelurahan", "1", "KOTA BANDUNG", "32", "JAWA BARAT", "10", "BANDUNG WETAN"),
    ("60111", "CIHAPIT BARU", "CIHAPIT BARU", "kelurahan", "2", "KOTA SURABAYA", "35", "JAWA TIMUR", "20", "GUBENG"),
]


def test_postal_lookup(spark, tmp_path):
    postal = spark.createDataFrame(POSTAL, list(tables.POSTAL_COLUMNS))
    tables.write_postal_tsv(postal, str(tmp_path / "p"))
    postal = tables.read_postal_tsv(spark, str(tmp_path / "p"))
    assert postal.count() == 3
    asked = [
        (1, None, "JAWA BARAT", "BANDUNG", "CIHAPIT", "BANDUNG WETAN", "JL RIAU"),
        (2, "4O115", None, None, None, None, None),
        (3, None, None, None, "NOWHERE", None, None),
        (4, None, "JAWA TIMUR", "SURABAYA", "CIHAPIT", None, None),
        (5, None, None, None, None, None, None),
    ]
    queries = spark.createDataFrame(asked, "doc_id long, kode_pos string, provinsi string, kabupaten_kota string, kelurahan_desa string, kecamatan string, alamat string")
    got = {r["doc_id"]: r["match"] for r in lookup.lookup_postal(queries, postal).collect()}
    assert got[1]["kode_pos"] == "40114" and got[1]["confidence"] == 0.95 and got[1]["match_status"] == "exact_match"
    assert got[2]["locality"] == "CITARUM" and got[3] is None and got[5] is None
    assert got[4]["kode_pos"] == "60111"


def _plain_lookup(asked, entries):
    """Best entry of (code, city, place) among (code, address, locality, city): (code, locality, score, confidence, options, status)."""
    tight = lambda v: v.replace(" ", "")
    digits = str.maketrans("0158", "OISB")

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, last = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
        return row[-1]

    def alike(a, b):
        x, y = sorted((tight(a).translate(digits), tight(b).translate(digits)), key=len)
        return a == b or bool(x and y) and (edits(x, y) <= 1 or len(x) >= 5 and y.startswith(x) and len(y) - len(x) <= 1)

    def holds(text, part):
        return bool(text and part) and (f" {part} " in f" {text} " or tight(part) in tight(text))

    clean = lambda v: re.sub("[^A-Z0-9]+", " ", (v or "").upper()).strip()
    code, city, place = (asked[0] or "").translate(str.maketrans("OILSB", "01158")), clean(asked[1]), clean(asked[2])
    tokens = {w for w in place.split() if len(w) >= 3}
    by_name = [e for e in entries if clean(e[2]) == place or tight(clean(e[2])) == tight(place) or tokens & {w for w in clean(e[2]).split() if len(w) >= 3}]
    scored = []
    for e in [e for e in entries if e[0] == code] if code else by_name or entries:
        locality, address, e_city = clean(e[2]), clean(e[1]), clean(e[3])
        if not code and not (place in locality or locality in place or tight(place) == tight(locality)):
            continue
        s_city = 3 if alike(city, e_city) else 2 if city in e_city or e_city in city else None
        s_place = 6 if alike(place, locality) else 4 if holds(locality, place) or holds(place, locality) else 3 if holds(address, place) else None
        if s_city is not None and s_place is not None and (score := (8 if code else 0) + s_city + s_place + 1) >= 8:
            scored.append((-score, len(e[1]), e[0], e[1], e[2]))
    if not scored:
        return (None,) * 6
    best = min(scored)
    confidence = round(min(0.95, 0.55 - best[0] / 20), 2)
    return best[2], best[4], float(-best[0]), confidence, sum(e[2] == best[2] for e in scored), "exact_match" if confidence >= 0.9 else "partial_match"


def test_postal_query_against_plain_lookup(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    entries = [(f"{r['p_partkey'] % 100000:05d}", r["p_name"], r["p_name"].upper(), r["p_brand"]) for r in parts]
    asked = {r["p_partkey"]: (f"{r['p_partkey'] % 100000:05d}".replace("0", "O") if r["p_partkey"] % 4 == 0 else None, r["p_brand"], r["p_name"].upper().replace("O", "0")) for r in parts}
    want = sorted((key, *_plain_lookup(a, entries)) for key, a in asked.items())
    got = sorted(tuple(r) for r in catalogue.QUERIES["postal_lookup"](spark, sf_dir).collect())
    assert got == want and len(got) == len(parts)
    assert all(r[1] == f"{r[0] % 100000:05d}" for r in got if r[0] % 4 == 0)


def test_postal_lookup_of_repeated_and_null_ids(spark):
    postal = spark.createDataFrame(POSTAL, list(tables.POSTAL_COLUMNS))
    asked = [(1, "40114", None), (1, None, "CIHAPIT"), (None, "40115", None), (None, "40115", None)]
    rows = spark.createDataFrame([(i, c, None, "BANDUNG", k, None, None) for i, c, k in asked], "doc_id long, kode_pos string, provinsi string, kabupaten_kota string, kelurahan_desa string, kecamatan string, alamat string")
    got = [(r["doc_id"], r["match"]["kode_pos"]) for r in lookup.lookup_postal(rows, postal).collect()]
    assert sorted(got, key=repr) == [(1, "40114"), (1, "40114"), (None, "40115"), (None, "40115")]


def test_postal_lookup_of_repeated_entries(spark):
    other = ("40114", "CIHAPIT, JL RIAU", "CIHAPIT", "kelurahan", "1", "KOTA CIMAHI", "32", "JAWA BARAT", "10", "BANDUNG WETAN")
    postal = spark.createDataFrame([*POSTAL, POSTAL[0], other], list(tables.POSTAL_COLUMNS))
    asked = [(1, "40114", "BANDUNG", None), (2, "40114", None, None), (3, "40114", "CIMAHI", None), (4, None, "BANDUNG", "CIHAPIT")]
    rows = spark.createDataFrame([(i, c, None, t, k, None, None) for i, c, t, k in asked], "doc_id long, kode_pos string, provinsi string, kabupaten_kota string, kelurahan_desa string, kecamatan string, alamat string")

    def options(**how):
        return {r["doc_id"]: (r["match"]["city_name"], r["match"]["total_options"]) for r in lookup.lookup_postal(rows, postal, **how).collect()}

    coded = {1: ("KOTA BANDUNG", 2), 2: ("KOTA BANDUNG", 3), 3: ("KOTA CIMAHI", 1)}
    assert options() == coded | {4: ("KOTA BANDUNG", 1)} and options(repeated=True) == coded | {4: ("KOTA BANDUNG", 2)}


def test_postal_query_where_codes_come_round(spark, sf_dir, tmp_path):
    import duckdb

    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 40")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 100000)).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = connection.execute(catalogue.SQL["postal_lookup"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["postal_lookup"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[5] for r in got} >= {2}


def test_rows_of_one_name_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BLOCK", 8)
    monkeypatch.setattr(lookup, "TASK_PAIRS", 64)
    rows = [(k, "hot ring") for k in range(40)] + [(k, "hot rings") for k in range(40, 45)] + [(45, "cold gear"), (45, "cold gear"), (46, None), (47, "ox")]
    left = spark.createDataFrame(rows, "l long, ln string").coalesce(1)
    right = spark.createDataFrame(rows, "r long, rn string").coalesce(1)
    found = lookup.fuzzy_token_join(left, right, "ln", "rn")
    made = found.withColumn("task", F.spark_partition_id()).collect()
    near = lambda a, b: a and b and len(a) > 2 and (a == b or {a, b} == {"hot ring", "hot rings"})
    assert found.columns == ["l", "ln", "r", "rn"]
    assert sorted((x["l"], x["r"]) for x in made) == sorted((i, j) for i, a in rows for j, b in rows if near(a, b))
    assert len({x["task"] for x in made if x["ln"] == x["rn"] == "hot ring"}) > 4


def test_card_with_postal_code(spark, parsed):
    postal = spark.createDataFrame(POSTAL, list(tables.POSTAL_COLUMNS))
    row = identity_card.with_postal(parsed.where("doc_id = 'card'").select("doc_id", "fields", "warnings"), postal).first()
    assert row["fields"]["kode_pos"]["value"] == "40114" and row["fields"]["kode_pos"]["status"] == "ok"


def test_star_source(spark):
    postal = spark.createDataFrame([("40114", "CIHAPIT, X", "1", "10", "Kelurahan"), ("x", "BAD", "1", "10", ""), ("50000", "LOST", "9", "0", "")], "kode_pos string, address string, city_code string, district_code string, sifat_pos string")
    cities = spark.createDataFrame([("1", "BANDUNG", "32")], "city_code string, city_name string, province_code string")
    provinces = spark.createDataFrame([("99", "OTHER")], "province_code string, province_name string")
    districts = spark.createDataFrame([("10", "WETAN")], "district_code string, district_name string")
    rows = tables.postal_star(postal, cities, provinces, districts).collect()
    assert [(r["kode_pos"], r["province_name"], r["district_name"], r["locality"]) for r in rows] == [("40114", "", "WETAN", "CIHAPIT")]


def test_records_and_summary(spark, tmp_path):
    lines = [
        '{"file":"a","status":"ok","document_type":"STNK","processing_time_ms":100,"warnings":["w"],"stnk_structure_score":0.9,"input_assessment":{"decision":"approved_for_auto","can_auto_publish":true,"reason_codes":[]},"fields":{"nomor_polisi":{"status":"ok","value":"B 1"}},"quality":{"flags":["blur_detected"],"metrics":{"overall_score":0.8}},"ocr":{"token_count":20,"timings":{"total_ms":90,"attempts":[{"ocr_ms":10},{"ocr_ms":30}]}}}',
        '{"file":"b","status":"error"}',
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    records = tables.read_records(spark, str(tmp_path / "r.json"))
    counts = {(r["counter"], r["value"]): r["n"] for r in summary.counters(records).collect()}
    assert counts[("decisions", "unknown")] == 1 and counts[("document_types", "UNKNOWN")] == 1 and counts[("auto_publish", "false")] == 1 and counts[("warnings", "w")] == 1
    numbers = {r["series"]: r for r in summary.series(records).collect()}
    assert numbers["ocr"]["p50"] == 20.0 and numbers["ocr"]["count"] == 2 and numbers["processing_time_ms"]["count"] == 1
    assert [r["ocr_ms_total"] for r in summary.slowest(records).collect()] == [40.0]
    assert summary.summarize(records).first()["total"] == 2
    classes = {r["file"]: (r["usage_class"], r["usage_reasons"]) for r in assess.usage_gate(assess.usage_class(records)).collect()}
    assert classes == {"a": ("bad_input", ["quality:blur_detected"]), "b": ("bad_input", ["processing_failed"])}
    gated = assess.usage_gate(assess.usage_class(records)).where("file = 'a'").first()
    assert gated["input_assessment"]["decision"] == "rejected_input" and gated["needs_review"]
    tables.write_records(records, str(tmp_path / "out"))
    assert tables.read_records(spark, str(tmp_path / "out")).count() == 2


def test_quality_score(spark):
    row = spark.range(1).select(*(assess.quality_score(F.array(*map(F.lit, f)) if f else F.array().cast("array<string>")).alias(f"c{i}") for i, f in enumerate([[], ["blur_detected"], ["x", "screen_or_desktop_capture"]]))).first()
    assert tuple(row) == (1.0, 0.8, 0.55)


def test_fuzzy_labels():
    labels = vehicle_registration.LABELS
    assert fuzzy.best_label("NOMOR RANGKA : X", labels)[0] == "nomor_rangka"
    assert fuzzy.best_label("N0M0R P0LISI", labels)[:2] == ("nomor_polisi", "NOMOR POLISI")
    assert fuzzy.best_label("lorem ipsum dolor sit amet", labels) is None
    for line in ("NOMR RANGKA", "WARNA", "BAHAN BAKR X", "TIPE AB", "NAMA PEMILIX Y"):
        plain = max((fuzzy.similarity(line[:e], n), e) for names in labels.values() for n in names for e in fuzzy._spans(line, n) if fuzzy.similarity(line[:e], n) >= fuzzy.threshold(n))
        assert fuzzy.best_label(line, labels)[2:] == (round(plain[0], 3), plain[1])


def test_layout(spark):
    word = lambda t, x, y: ("d", t, [[x, y], [x + 8.0, y], [x + 8.0, y + 8.0], [x, y + 8.0]])
    rows = [word("TOP", 0.0, 0.0), word("STATUS", 0.0, 60.0), word("KAWIN", 30.0, 60.5), word("KEWARGANEGARAAN", 0.0, 80.0), word("WNI", 30.0, 81.0), word("END", 0.0, 100.0), ("d", "nobox", [])]
    tokens = spark.createDataFrame(rows, "doc_id string, text string, bbox array<array<double>>")
    lines = layout.layout_lines(layout.positioned(tokens)).cache()
    assert [r["line"] for r in lines.orderBy("y").collect()] == ["TOP", "STATUS KAWIN", "KEWARGANEGARAAN WNI", "END"]
    got = {r["field"]: r["value"] for r in layout.repairs(lines).collect()}
    assert got == {"status_perkawinan": "KAWIN", "kewarganegaraan": "WNI"}
    assert lines.where("line_no = 1").select(layout.right_of(F.col("tokens"), "STATUS").alias("x")).first()["x"] == "KAWIN"


def _plain_lines(tokens):
    """Lines of (x, y, text) tokens of one document: each joins the first line whose mean y is within reach."""
    spread = lambda vs: (min(vs), (max(vs) - min(vs)) or 1.0)
    (x0, w), (y0, h) = (spread([t[k] for t in tokens]) for k in (0, 1))
    lines = []
    for y, x, text in sorted(((y - y0) / h, (x - x0) / w, t) for x, y, t in tokens):
        for line in lines:
            if abs(sum(t[0] for t in line) / len(line) - y) <= layout.LINE_GAP:
                line.append((y, x, text))
                break
        else:
            lines.append([(y, x, text)])
    return [(k, round(sum(t[0] for t in g) / len(g), 6), len(g), " ".join(t for _, t in sorted((x, t) for _, x, t in g))) for k, g in enumerate(lines)]


def test_layout_query_holds_every_word(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    by_doc: dict = {}
    for r in turns:
        by_doc.setdefault(r["conv_id"], []).extend((i * 10.0 + 4, r["turn"] * 20.0 + 5, w) for i, w in enumerate(r["text"].split(" ")))
    want = sorted((d, *line) for d, tokens in by_doc.items() for line in _plain_lines(tokens))
    got = sorted(tuple(r) for r in catalogue.QUERIES["layout_repair"](spark, sf_dir).collect())
    assert got == want
    assert sum(r[3] for r in got) == sum(len(r["text"].split(" ")) for r in turns)


def test_layout_lines_of_crowded_rows(spark):
    dice = random.Random(7)
    docs = {d: [(float(dice.randint(0, 400)), round(dice.random() * h, 3), f"w{dice.randint(0, 99)}") for _ in range(n)] for d, n, h in ((1, 400, 900.0), (2, 60, 900.0), (3, 5, 1.0), (4, 1, 1.0))}
    rows = [(d, t, [[x, y]]) for d, tokens in docs.items() for x, y, t in tokens]
    lines = layout.layout_lines(layout.positioned(spark.createDataFrame(rows, "doc_id long, text string, bbox array<array<double>>")))
    got = sorted((r["doc_id"], r["line_no"], round(r["y"], 6), len(r["tokens"]), r["line"]) for r in lines.collect())
    want = sorted((d, *line) for d, tokens in docs.items() for line in _plain_lines(tokens))
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert all(abs(g[2] - w[2]) < 1e-5 for g, w in zip(got, want, strict=True))


def _fake_extractor():
    def read(content: bytes, path: str) -> list[dict]:
        if content == b"bad":
            raise ValueError("unreadable")
        return [{"text": w, "confidence": 1.0, "bbox": [[0.0, 0.0]]} for w in content.decode().split()]

    return read


def test_extractors_and_file_scan(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"NIK 1")
    (tmp_path / "b.png").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"x")
    extract.register("fake", _fake_extractor)
    rows = extract.extract(tables.scan_files(spark, str(tmp_path)), "fake").orderBy("path").collect()
    assert [(r["raw_text"], r["error"]) for r in rows] == [("NIK\n1", None), ("", "ValueError: unreadable")]
    seeded = [[r["path"] for r in tables.scan_files(spark, str(tmp_path), seed=3, limit=1).collect()] for _ in range(2)]
    assert seeded[0] == seeded[1] and len(seeded[0]) == 1


def test_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = streams.read_stream(spark, sf_dir, batch, "events.parquet")
    got: dict = {}

    def sink(df, epoch):
        got["rows"] = sorted(tuple(r) for r in df.collect())

    streams.run_available(streams.tumbling_counts(stream), str(tmp_path / "c1"), sink)
    assert got["rows"] == sorted(tuple(r) for r in streams.tumbling_counts(batch).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = streams.read_stream(spark, sf_dir, docs, "documents.parquet")
    streams.run_available(streams.sensitive_counts(stream), str(tmp_path / "c2"), sink)
    assert got["rows"] == sorted(tuple(r) for r in streams.sensitive_counts(docs).collect())


def test_frame_number_over_two_lines(spark):
    texts = {
        "behind": "SURAT TANDA NOMOR KENDARAAN BERMOTOR\nNOMOR RANGKA\nMHKA1BA1\nTOYOTA\nJFK123456",
        "before": "NO RANGKA\nBA1JFK123\nMHKA1X99",
        "whole": "NO RANGKA\nMHKA1BA1\nJFK12345\nJFK123456",
        "unnamed": "MHKA1BA1\nJFK123456",
    }
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id string, raw_text string")
    got = {r["doc_id"]: r["fields"]["nomor_rangka"] for r in vehicle_registration.parse(rows, F.lit("2025-01-01").cast("date")).collect()}
    assert got["behind"]["value"] == "MHKA1BA1JFK123456" and got["behind"]["confidence"] == 0.78
    assert got["before"]["value"] == "MHKA1X99BA1JFK123" and got["whole"]["value"] == "MHKA1BA1JFK123456"
    assert got["unnamed"]["value"] is None
