"""Whole documents: classify, parse, choose, assess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.operators import assess
from lontar.plans import identity_card, vehicle_registration


def parse_documents(docs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Parsed rows of docs(doc_id, raw_text, requested_type, ...).

    The requested type holds unless the text clearly is the other one; texts of
    no known type are read as both and the better reading stays (ties: the
    identity card), with a warning.
    """
    typed = docs.withColumn("detected_type", assess.document_type(F.col("raw_text")))
    asked = F.upper(F.coalesce("requested_type", F.lit("AUTO")))
    fixed = asked.isin(*assess.FIXED_TYPES)
    other = fixed & F.col("detected_type").isin(*assess.FIXED_TYPES) & (F.col("detected_type") != asked)
    chosen = F.when(other, F.col("detected_type")).when(fixed, asked).otherwise(F.col("detected_type"))
    typed = typed.withColumns({"expected_type": asked, "_read_as": chosen})
    # Each parser stands in the plan once and reads the texts that are its own or of no known type; both readings are
    # structs of one row, so repeated ids stay rows of their own.
    made = ("document_type", "schema_version", "fields", "warnings")
    read, unknown = F.col("_read_as"), F.col("_read_as") == "UNKNOWN"
    rows = typed.withColumns({f"_text_{k}": F.when((read == k) | unknown, F.col("raw_text")) for k in assess.FIXED_TYPES})
    rows = identity_card.parse(rows, as_of, "_text_KTP").withColumn("_a", F.struct(*made)).drop(*made)
    rows = vehicle_registration.parse(rows, as_of, "_text_STNK").withColumn("_b", F.struct(*made)).drop(*made)
    worth = {x: assess.reading_score(F.col(f"{x}.fields"), F.col(f"{x}.warnings")) for x in ("_a", "_b")}
    guessed = F.when(worth["_a"] >= worth["_b"], F.col("_a")).otherwise(F.col("_b"))
    guessed = guessed.withField("warnings", F.concat(guessed["warnings"], F.array(F.lit("document_type:auto_guess"))))
    chosen = F.when(read == "KTP", F.col("_a")).when(read == "STNK", F.col("_b")).otherwise(guessed)
    kept = [c for c in typed.columns if c != "_read_as"]
    return rows.withColumn("_r", chosen).select(*kept, "_r.*")


def assess_documents(parsed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Parsed rows with their assessment and score; rows may carry quality_flags and provider."""
    given = {c: F.lit(None).cast(t) for c, t in (("quality_flags", "array<string>"), ("provider", "string")) if c not in parsed.columns}
    rows = assess.assess(parsed.withColumns(given) if given else parsed, as_of)
    score = assess.document_score(F.col("document_type"), F.col("fields"), F.col("warnings"), F.col("input_assessment.decision"))
    return rows.withColumns({"score": score, "needs_review": assess.needs_review(F.col("warnings"), F.col("fields"))})


def best_attempt(attempts: DataFrame, id_col: str = "doc_id", order: str = "attempt_index") -> DataFrame:
    """The attempt with the highest score of each document; ties go to the earliest."""
    columns = [c for c in attempts.columns if c != id_col]
    top = attempts.groupBy(id_col).agg(F.max_by(F.struct(*columns), F.struct("score", -F.col(order))).alias("r"))
    return top.select(id_col, "r.*")


def long_fields(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, field, value, confidence, status, evidence, raw)."""
    return parsed.select(id_col, F.explode("fields").alias("field", "f")).select(id_col, "field", "f.*")


def checkout(parsed: DataFrame, wanted: tuple[str, ...] = ("nomor_polisi", "nama_pemilik", "nomor_rangka", "nomor_mesin"), id_col: str = "doc_id") -> DataFrame:
    """(id, fields, missing_required, ready, needs_review): the few fields that a purchase needs.

    Rows that carry an assessment are ready only if it approves them, and vehicle
    documents that carry a usage class only if they are web usable.
    """
    kept = F.map_filter("fields", lambda k, v: k.isin(*wanted))
    gone = F.array_compact(F.array(*(F.when(~assess.field_ok(F.col("fields"), n), F.lit(n)) for n in wanted)))
    yes = F.lit(True)
    approved = F.coalesce(F.col("input_assessment.decision") == "approved_for_auto", F.lit(False)) if "input_assessment" in parsed.columns else yes
    usable = (F.upper(F.coalesce("document_type", F.lit(""))) != "STNK") | F.coalesce(F.col("usage_class") == "web_usable", F.lit(False)) if "usage_class" in parsed.columns else yes
    review = F.col("needs_review") if "needs_review" in parsed.columns else ~yes
    held = F.size(gone) > 0
    return parsed.select(id_col, kept.alias("fields"), gone.alias("missing_required"), (~held & usable & approved).alias("ready"), (review | held | ~usable).alias("needs_review"))


#: Codes of marital status and gender in partner records, looked for in this order.
MARITAL_CODES = {"BELUM": "TK", "KAWIN": "K", "CERAI": "C"}
GENDER_CODES = {"PEREMPUAN": "P", "LAKI": "L"}


def partner_record(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, status, ocr_data, kodepos_data): identity cards in the flat form that a partner reads."""
    value = lambda n: F.nullif(F.try_element_at("fields", F.lit(n))["value"], F.lit(""))
    coded = lambda c, codes: F.coalesce(*(F.when(F.upper(c).contains(k), v) for k, v in codes.items()), c)
    born = value("tempat_tanggal_lahir")
    part = lambda k: F.regexp_extract(born, r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", k)
    date = F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")
    more = (F.concat(F.lit(label), value(n)) for label, n in (("RT/RW ", "rt_rw"), ("Kel/Desa ", "kelurahan_desa"), ("Kecamatan ", "kecamatan")))
    found = assess.field_ok(F.col("fields"), "kode_pos")
    ocr = {
        "nama": value("nama"),
        "no_ktp": value("nik"),
        "tempat_lahir": F.nullif(F.trim(F.substring_index(born, ",", 1)), F.lit("")),
        "tanggal_lahir": F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00.000Z")),
        "alamat": F.when(value("alamat").isNotNull(), F.concat_ws(", ", value("alamat"), *more)),
        "kota": value("kabupaten_kota"),
        "agama": value("agama"),
        "status_perkawinan": coded(value("status_perkawinan"), MARITAL_CODES),
        "pekerjaan": value("pekerjaan"),
        "kewarganegaraan": value("kewarganegaraan"),
        "jenis_kelamin": coded(value("jenis_kelamin"), GENDER_CODES),
    }
    postal = {"kode_pos": value("kode_pos"), "kelurahan": value("kelurahan_desa"), "kecamatan": value("kecamatan"), "nama_kota": value("kabupaten_kota")}
    flat = lambda columns: F.struct(*(c.alias(n) for n, c in columns.items()))
    return parsed.select(id_col, F.when(found, "success").otherwise("not_found").alias("status"), flat(ocr).alias("ocr_data"), flat(postal).alias("kodepos_data"))
