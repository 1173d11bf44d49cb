"""Identity card (KTP): fields from the lines of a noisy text.

Each field is one stage: its label-window scan first, then fallbacks on the
lines alone.  Names and places are then repaired by the shape of the whole card
(`card_repair`).  Stages read only the lines and the columns made before them,
so the plan stays a chain of small projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.functions.text import let
from lontar.operators.label_window import capture, first, first_accepted, line_ngrams
from lontar.operators.lineage import written
from lontar.operators.lookup import lookup_postal
from lontar.plans import card_repair
from lontar.plans.fields import field, found_field, invalid, labelled, missing, scanned, warnings

SCHEMA_VERSION = "ktp.v1"
#: Label spellings of the fields, common misreadings included.
LABELS = {
    "provinsi": ["PROVINSI"],
    "kabupaten_kota": ["KOTA ADMINISTRASI", "KABUPATEN", "KAB/KOTA", "KAB/ KOTA", "KAB/KATA", "KOTA"],
    "nik": ["NIK", "NTK", "HIK"],
    "nama": ["NAMA", "NAME", "NAMS", "NANIA", "NAMAT", "NAM"],
    "tempat_tanggal_lahir": ["TEMPAT/TGL LAHIR", "TEMPAT TGL LAHIR", "TEMPAT/TANGGAL LAHIR", "TEMPATTGLLAHIR"],
    "jenis_kelamin": ["JENIS KELAMIN"],
    "alamat": ["ALAMAT", "ALAMAL", "ALMAL", "ALANAT", "ALSMAT"],
    "rt_rw": ["RT/RW", "RTRW", "TT/RW", "TIT/RW", "AT/RW"],
    "kelurahan_desa": [
        "KEL/DESA", "KEL DESA", "KELDESA", "KELURAHAN", "DESA", "DESA/KEL", "KEDESA", "KEILDESA", "KEWDESA", "KEVDESA", "KEL/DESN", "KEL/DOSA", "KEL/OOSA",
        "KOL/DESA", "KOL/DASA", "KEL/DESS", "KEL/DEAN", "DESA/KOL", "KAL/DESS", "KAL/DESA", "NOESA", "EL/DESA", "VOASA",
    ],
    "kecamatan": [
        "KECAMATAN", "KECAMNATAN", "KECAMATAR", "KECANATAR", "KECANATAN", "KECAMETAN", "KECAMRETAN", "KICANALAN", "KECAMATEN", "XECAMATAN", "ECOMATAN", "ECAMATAN",
        "ECEMATAN", "COMATAN",
    ],
    "agama": ["AGAMA"],
    "status_perkawinan": ["STATUS PERKAWINAN"],
    "pekerjaan": ["PEKERJAAN", "PEKERIAAN", "PEKERIAN", "POKERJAAN", "PAKERAAN", "PEKEREAN", "PAKERJAAN"],
    "kewarganegaraan": ["KEWARGANEGARAAN", "KEWARGANE", "KEWARGANEGARAAR", "KEWARGANEGARAART", "KEVRGANEGARAAN", "KWARGANEGARAAN", "KOWARGANEGARAAN"],
    "kode_pos": ["KODE POS", "KODEPOS"],
    "berlaku_hingga": [
        "BERLAKU HINGGA", "BERLAKUHINGGA", "BERLAKU HING", "BARLAKU HINGGA", "BERLAKY HINGGA", "BORLAKU HINGGA", "BERBAKY HINGGA", "BERFAKU HINGGA", "SERFAKU HINGGA",
        "BERTAKU HINGGA", "BERLAKU HINGOA", "BERLAKU HINGGE", "BERLAKU HINGGS", "BERLAKU HNOGS", "BERAKU HINGGA", "BERIAKU HINGGA", "BERIAKY HINGGA", "BERIAKUHINGGA",
        "BERIAKU HINGUA", "AK. HINGQA", "IEDAKUHINGGA",
    ],
}
REQUIRED = ("nik", "nama", "alamat")
STOPS = tuple(x for labels in LABELS.values() for x in labels)
LABELLED, FALLBACK = 0.88, 0.78
ID_CLEAN, ID_REPAIRED = 0.98, 0.86
POSTAL_UNCONFIRMED = 0.72
#: Confidence of a province that follows from its city, of a date put right by the id number, of a name that a postal entry fills in.
PROVINCE_OF_CITY = {"JAKARTA ": ("DKI JAKARTA", 0.78), "JAMBI": ("JAMBI", 0.72)}
BORN_REPAIRED, CANONICAL = 0.74, 0.84
#: Lines from a birth label on in which place and date may be broken up, and the confidence of what is put together.
BIRTH_SIZE, BIRTH_LINES = 6, 0.72
#: Values of fields that cards of this kind nearly always have, and their confidence, for `with_defaults`.
DEFAULT_STATUS, DEFAULT_CITIZEN = ("BELUM KAWIN", 0.35), ("WNI", 0.42)


def _normalizers(as_of: Column) -> dict:
    return {
        "provinsi": (T.region_name, 2, 0),
        "kabupaten_kota": (T.region_name, 3, 0),
        "nama": (T.person_name, 4, 3),
        "tempat_tanggal_lahir": (lambda x: T.birth_place_date(x, as_of), 3, 0),
        "jenis_kelamin": (T.gender, 2, 0),
        "alamat": (T.address, 2, 0),
        "rt_rw": (T.rt_rw, 11, 4),
        "kelurahan_desa": (T.region_name, 4, 0),
        "kecamatan": (T.region_name, 4, 0),
        "agama": (T.religion, 2, 0),
        "status_perkawinan": (T.marital_status, 3, 0),
        "pekerjaan": (T.job, 5, 5),
        "kewarganegaraan": (T.citizenship, 3, 4),
        "kode_pos": (T.postal_code, 2, 0),
        "berlaku_hingga": (T.expiry, 4, 3),
    }


def _birth_lines(lines: Column, normalize: Callable[[Column], Column]) -> Column:
    """Place and date broken over up to three of the lines from a birth label on."""
    marked = F.filter(F.transform(lines, lambda x, i: F.when(F.upper(x).rlike("LAHIR|TEMPAT"), i)), lambda i: i.isNotNull())
    return first(marked, lambda at: first(line_ngrams(lines, at, BIRTH_SIZE), normalize))


def _id_field(lines: Column) -> Column:
    labelled = capture(lines, LABELS["nik"], STOPS, after=2)
    value = labelled["value"]
    found = F.flatten(F.transform(lines, T.id_numbers_in))
    spaced = first_accepted(lines, lambda x: T.id_number(F.regexp_extract(x, r"\b(\d[\d\s\-]{14,24}\d)\b", 1)))
    short = first_accepted(lines, T.short_id_number)
    clean = F.coalesce(T.id_number(value), F.get(found, F.lit(0)), spaced)
    repaired = T.repaired_id_number(value)
    raw = labelled["raw"]
    return (
        F.when(clean.isNotNull(), field(clean, ID_CLEAN, raw))
        .when(repaired.isNotNull(), field(repaired, ID_REPAIRED, raw))
        .when(value.isNotNull(), invalid(value, raw))
        .when(short.isNotNull(), invalid(short, F.lit(None)))
        .otherwise(missing())
    )


def parse(docs: DataFrame, as_of: Column | None = None, text_col: str = "raw_text") -> DataFrame:
    """Add document_type, schema_version, fields (a map of structs) and warnings."""
    day = as_of if as_of is not None else F.current_date()
    rows = docs.withColumn("_lines", T.normalized_lines(F.col(text_col)))
    lines = F.col("_lines")
    loose = {
        "tempat_tanggal_lahir": lambda x: T.birth_place_date(x, day),
        "jenis_kelamin": T.gender,
        "agama": T.religion,
        "alamat": lambda x: F.when(T.looks_like_address(x), T.address(x)),
        "pekerjaan": T.job,
        "berlaku_hingga": lambda x: F.when(T.expiry(x) == "SEUMUR HIDUP", T.expiry(x)),
        "kewarganegaraan": T.citizenship,
    }
    wanted = _normalizers(day)
    found = {}
    for name, (normalize, after, before) in wanted.items():
        stops = STOPS if name not in ("rt_rw", "nama", "kewarganegaraan") else ()
        ways = [labelled(capture(lines, LABELS[name], stops, after, before, normalize=normalize), LABELLED)]
        if name == "tempat_tanggal_lahir":
            ways.append(scanned(_birth_lines(lines, normalize), BIRTH_LINES, "fallback:birth_lines"))
        if name in loose:
            ways.append(scanned(first_accepted(lines, loose[name]), FALLBACK))
        # Later ways are only tried where the earlier ones find nothing.
        found[f"_c_{name}"] = F.coalesce(*ways)
    rows = rows.withColumns(found | {"_f_nik": _id_field(lines)})
    rows = rows.withColumns({"_codes": card_repair.coded(lines), "_places": F.transform(lines, card_repair.place_name)})
    rows = rows.withColumn("_regions", _regions())
    rows = rows.withColumns(_by_shape(rows, lines))
    rows = rows.withColumns({f"_f_{name}": found_field(F.col(f"_c_{name}")) for name in wanted})
    # An id number dates the birth where the line is unreadable.
    born = T.birth_date_of_id(F.col("_f_nik.value"), day)
    place = first_accepted(lines, lambda x: F.when(F.upper(x).rlike("LAHIR"), T.region_name(F.regexp_replace(F.upper(x), r"^.*LAHIR\W*|[,.]?\s*\d.*$", ""))))
    derived = F.when(place.isNotNull() & born.isNotNull(), F.concat(place, F.lit(", "), born))
    rows = rows.withColumn("_f_tempat_tanggal_lahir", F.when(F.col("_f_tempat_tanggal_lahir.status") == "ok", F.col("_f_tempat_tanggal_lahir")).otherwise(field(derived, 0.7, F.lit("fallback:nik"))))
    names = list(LABELS)
    fields = F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"_f_{n}"))))
    out = rows.withColumn("fields", fields)
    out = out.withColumns({"document_type": F.lit("KTP"), "schema_version": F.lit(SCHEMA_VERSION), "warnings": warnings(F.col("fields"), REQUIRED)})
    return out.drop("_lines", "_codes", "_places", "_regions", *(f"_f_{n}" for n in names), *found)


def _regions() -> Column:
    """(first, second): kelurahan and kecamatan by the shape of the card."""
    value = lambda n: F.col(f"_c_{n}")["value"]
    return card_repair.repaired_regions(value("kelurahan_desa"), value("kecamatan"), [value(n) for n in ("nama", "provinsi", "kabupaten_kota")], F.col("_codes"), F.col("_places"))


def _by_shape(rows: DataFrame, lines: Column) -> dict[str, Column]:
    """Readings of province, name and places after the repairs that need the shape of the card."""
    reading = rows.schema["_c_nama"].dataType.simpleString()
    got = lambda n: F.col(f"_c_{n}")
    city = got("kabupaten_kota")["value"]
    province = got("provinsi")
    for name, (whole, confidence) in PROVINCE_OF_CITY.items():
        known = city.startswith(name) if name.endswith(" ") else city == name
        province = F.coalesce(province, F.when(known, F.struct(F.lit(whole).alias("value"), F.lit(confidence).alias("confidence"), F.lit("fallback:admin_area").alias("raw"))))
    codes = F.col("_codes")
    others = [got("provinsi")["value"], city]

    def named(r: Column) -> Column:
        same = F.struct(r["value"].alias("value"), F.coalesce(F.least(r["confidence"], got("nama")["confidence"]), got("nama")["confidence"]).alias("confidence"), F.coalesce(got("nama")["raw"], r["raw"]).alias("raw"))
        return F.when(r["raw"].isNull(), got("nama")).when(r["raw"].startswith("fallback:name"), r).otherwise(F.when(got("nama").isNull(), r).otherwise(same)).cast(reading)

    name = let(card_repair.repaired_name(got("nama")["value"], others, codes, lines), named)

    def region(old: Column, new: Column) -> Column:
        made = F.struct(new.alias("value"), F.when(old.isNull(), card_repair.FOUND).otherwise(card_repair.REPLACED).alias("confidence"), F.lit("fallback:region_shape").alias("raw"))
        return F.when(new.isNull(), F.lit(None)).when(old["value"] == new, old).otherwise(made).cast(reading)

    village, district = region(got("kelurahan_desa"), F.col("_regions.first")), region(got("kecamatan"), F.col("_regions.second"))
    return {"_c_provinsi": province.cast(reading), "_c_nama": name, "_c_kelurahan_desa": village, "_c_kecamatan": district}


def with_id_births(parsed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Put a misread year of birth right by the id number, where day and month agree and the years are near.

    A step of its own: without it, assessment sees both dates as the card says them.
    """
    day = as_of if as_of is not None else F.current_date()
    now = lambda n: F.try_element_at("fields", F.lit(n))
    read, born = now("tempat_tanggal_lahir"), T.birth_date_of_id(F.when(now("nik")["status"] == "ok", now("nik")["value"]), day)
    righted = card_repair.birth_from_id(read["value"], born)
    dated = F.when(righted.isNotNull() & (righted != read["value"]), field(righted, F.greatest(read["confidence"], F.lit(BORN_REPAIRED)), F.coalesce(read["raw"], F.lit("fallback:nik_birth_date"))))
    return parsed.withColumn("fields", F.map_zip_with("fields", F.create_map(F.lit("tempat_tanggal_lahir"), dated), lambda k, a, b: F.coalesce(b, a)))


def with_defaults(parsed: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Fill in a marital status that was not read, and the citizenship of cards with an id number that name no other one."""
    fields, text = F.col("fields"), F.upper(F.coalesce(F.col(text_col), F.lit("")))
    gone = lambda n: F.try_element_at(fields, F.lit(n))["status"] == "missing"
    card = (F.try_element_at(fields, F.lit("nik"))["status"] == "ok") & text.rlike("K[EO]?WARG|BERLAK|BERAK|HINGGA|SEUMUR|SEUSUR") & ~text.rlike(r"\bWNA\b|WARGA\s+NEGARA\s+ASING")
    status = F.when(gone("status_perkawinan"), field(F.lit(DEFAULT_STATUS[0]), DEFAULT_STATUS[1], F.lit("fallback:default_marital_status")))
    citizen = F.when(gone("kewarganegaraan") & card, field(F.lit(DEFAULT_CITIZEN[0]), DEFAULT_CITIZEN[1], F.lit("fallback:default_citizenship")))
    given = F.create_map(F.lit("status_perkawinan"), status, F.lit("kewarganegaraan"), citizen)
    return parsed.withColumn("fields", F.map_zip_with("fields", given, lambda k, a, b: F.coalesce(b, a)))


def _same_place(current: Column, canonical: Column) -> Column:
    """Equal but for spaces and signs, or one letter longer at the end."""
    a, b = T.compact(current), T.compact(canonical)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((short >= 5) & (long - short <= 1) & (a.startswith(b) | b.startswith(a)))


def canonical_fields(fields: Column, match: Column) -> dict[str, Column]:
    """Fields of places as an exact postal match writes them; null where a field stays as it is.

    Province and city are filled in where they are missing; all four are
    respelled where they say the same, and a kelurahan that repeats its
    kecamatan gets its point of the compass back.
    """
    exact = (match["confidence"] >= 0.9) & (match["match_status"] == "exact_match")
    now = lambda n: F.try_element_at(fields, F.lit(n))
    city = F.regexp_replace(F.upper(match["city_name"]), r"^(?:KOTA ADMINISTRASI|KABUPATEN|KAB\.?|KOTA)\s+", "")
    names = {"provinsi": F.upper(match["province_name"]), "kabupaten_kota": city, "kelurahan_desa": F.upper(match["locality"]), "kecamatan": F.upper(match["district_name"])}
    out = {}
    for name, canonical in names.items():
        f, wide = now(name), name in ("provinsi", "kabupaten_kota")
        spelled = f.withField("value", canonical).withField("evidence", F.concat(f["evidence"], F.array(F.lit(f"db_kode_wilayah:canonical_{name}"))))
        filled = field(canonical, F.greatest(f["confidence"], F.lit(CANONICAL)), F.lit("db_kode_wilayah"))
        same = _same_place(f["value"], canonical) if wide else T.compact(f["value"]) == T.compact(canonical)
        if name == "kelurahan_desa":
            bare = T.compact(f["value"])
            ends = [T.compact(canonical) == F.concat(bare, F.lit(x)) for x in ("BARAT", "TIMUR", "UTARA", "SELATAN", "TENGAH")]
            cut_short = ends[0] | ends[1] | ends[2] | ends[3] | ends[4]
            same = same | ((T.compact(now("kecamatan")["value"]) == bare) & cut_short)
        given = exact & canonical.isNotNull() & (canonical != "")
        out[name] = F.when(given & (f["status"] == "ok") & same & (f["value"] != canonical), spelled)
        if wide:
            out[name] = F.coalesce(out[name], F.when(given & (f["status"] != "ok"), filled))
    return out


def with_postal(parsed: DataFrame, postal: DataFrame) -> DataFrame:
    """Confirm, fill or reject the postal code of parsed cards against reference data.

    Adds `postal_match`, the entry that the code comes from or is held against
    (null without one).  Rows are looked up by what they ask, so rows with the
    same or a null id stay rows of their own.
    """
    value = lambda n: F.try_element_at("fields", F.lit(n))["value"]
    places = {n: value(n) for n in ("provinsi", "kabupaten_kota", "kelurahan_desa", "kecamatan", "alamat")}
    ask = lambda code: F.struct(code.alias("kode_pos"), *(c.alias(n) for n, c in places.items()))
    asked = {"_own": F.when(value("kode_pos").isNotNull(), ask(value("kode_pos"))), "_free": ask(F.lit(None).cast("string"))}
    # Each question is asked once; the questions are written, as the lookup reads them many times.
    questions = written(parsed.select(F.explode(F.array_compact(F.array(*asked.values()))).alias("q")).distinct())
    answers = written(lookup_postal(questions.select("q.*"), postal).where("match IS NOT NULL"))
    rows = parsed
    for name, question in asked.items():
        found = answers.select(F.to_json(F.struct("kode_pos", *places)).alias("_key"), F.col("match").alias(name))
        rows = rows.withColumn("_key", F.to_json(question)).join(found, "_key", "left").drop("_key")
    current = F.try_element_at("fields", F.lit("kode_pos"))
    code = current["value"]
    better = F.col("_free.kode_pos")
    confirmed = F.col("_own.kode_pos") == code
    checked = (
        F.when(code.isNull() & better.isNotNull(), field(better, F.col("_free.confidence"), F.lit("postal_lookup")))
        .when(code.isNull(), current)
        .when(confirmed, field(code, F.greatest(current["confidence"], F.col("_own.confidence")), current["raw"]))
        .when(better.isNotNull() & (better != code), invalid(code, current["raw"]))
        .otherwise(current.withField("confidence", F.least(current["confidence"], F.lit(POSTAL_UNCONFIRMED))))
    )
    status = F.when(code.isNotNull() & F.col("_own").isNull() & better.isNotNull(), "postal_code:mismatch").when(code.isNotNull() & F.col("_own").isNull(), "postal_code:unconfirmed")
    # Names follow the entry that gave or confirmed the code.
    used = F.when(code.isNull(), F.col("_free")).when(confirmed, F.col("_own"))
    spelled = canonical_fields(F.col("fields"), used)
    given = F.create_map(F.lit("kode_pos"), checked, *(x for n, c in spelled.items() for x in (F.lit(n), c)))
    replaced = F.map_zip_with("fields", given, lambda k, a, b: F.coalesce(b, a))
    made = {"fields": replaced, "warnings": F.array_compact(F.concat("warnings", F.array(status))), "postal_match": F.coalesce(F.col("_own"), F.col("_free"))}
    return rows.withColumns(made).drop("_own", "_free")
