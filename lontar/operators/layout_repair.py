"""Fields of identity cards by position: values right of labels or near them, joined back to the parsed card.

Layout lines give at most one value a field; the first line that has one holds.
A card's own good values stay, so positions only fill what the text did not
give.  Everything is a projection of lines, one aggregate a card, one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.functions.text import let
from lontar.operators.layout import CITIZEN_BAND, NEAR, STATUS_BAND
from lontar.plans.fields import field

#: Labels of places and of the expiry on a line or as one token, and what is no value of a place.
VILLAGE_INLINE = r"(?i)(?:KEL\s*/?\s*DES[AN]?|KELDESA|KEWDESA|KEVDESA|KELDOSA|KELDESS|KALDESS|NOESA|EL\s*/?\s*DESA)\s*[:_\-]?\s*(.+)$"
DISTRICT_INLINE = r"(?i)(?:KECAMATAN|KECAMNATAN|KECAMATAR|KECANATAN|KECA\s*MATEN|XECAMATAN|ECAMATAN|ECOMATAN)\s*[:_\-]?\s*(.+)$"
VILLAGE_TOKEN = "^(?:KELD.*|KELURAHAN|DESA|KEWDESA|KEVDESA|KALDESS|NOESA|N0ESA|ELDESA)$"
DISTRICT_TOKEN = "^(?:KEC|EATAN|CAMATAN|[KXE]?ECAM[A-Z]*|KECAN[A-Z]*|KEC[A-Z]*NATAN)$"
EXPIRY_INLINE = r"(?i)(?:BERLAK\w*|BARLAK\w*|BORLAK\w*|BERBAKY|BERFAK\w*|SERFAK\w*|BERTAK\w*|BARTARAR|NAKU)\s*:?\s*(?:HING\w*|HIN\w*|HNOG\w*)?\s*[:_\-]?\s*(.*)$"
EXPIRY_TOKEN = "BERLAKU|BARLAKU|BERLAKY|BORLAKU|BERBAKY|BERFAKU|SERFAKU|BERTAKU|BARTARAR|NAKU"
EXPIRY_START = "^(?:BERLAKU|BARLAKU|BERLAKY|SERFAKU|BERTAKU)"
OTHER_LABEL = r"\b(?:NIK|NAMA|TEMP\w*|TGL|TANGGAL|LAHIR|ALAMAT|AGAMA|STATUS|PEKER\w*|K[EO]WARG\w*|BERLAKU|HINGGA|PROVINSI|KABUPATEN|KOTA|GOL|DARAH|PERKAW\w*)\b|\bJENIS\s*KELAMIN\b"
#: Lines behind and before an expiry label that may hold its value, nearest first.
EXPIRY_NEAR = (1, 2, 3, -1, -2)
#: Confidence of values found by position, and of good values that the card already had.
FOUND = 0.78
KEPT = {"status_perkawinan": 0.88, "kewarganegaraan": 0.88, "kelurahan_desa": 0.84, "kecamatan": 0.84, "berlaku_hingga": 0.84}
DEFAULT_STATUS_RAW = "fallback:default_marital_status"


def expiry_value(value: Column) -> Column:
    """'SEUMUR HIDUP', misread or not, or any date as DD-MM-YYYY."""
    compact = F.translate(T.compact(value), "10", "IO")
    part = lambda k: F.regexp_extract(value, r"(?<!\d)(\d{1,2})[-/.\s]+(\d{1,2})[-/.\s]+(\d{4})(?!\d)", k)
    dated = F.concat_ws("-", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))
    return F.when(compact.rlike("^SEUMURHID|^(?:SEUMURHIOUP|SEUMUHIDUP)$"), "SEUMUR HIDUP").when(part(3) != "", dated)


def place_value(value: Column) -> Column:
    clean = F.regexp_replace(F.btrim(F.upper(T.clean_candidate(value)), F.lit(" :;._-")), r"\s+", " ")

    def accepted(c: Column) -> Column:
        other = c.rlike(OTHER_LABEL) | F.coalesce(T.marital_status(c), T.citizenship(c), expiry_value(c)).isNotNull() | c.rlike(r"\d{1,2}[-/.\s]+\d{1,2}[-/.\s]+\d{2,4}")
        return F.when(~other & (F.length(T.letters(c)) >= 3) & c.rlike(r"^[A-Z][A-Z0-9 .'\-/]{2,}$"), c)

    return let(clean, accepted)


def _right_of(tokens: Column, is_label) -> Column:
    """Text of a line right of each label token, the leftmost label first: an array."""
    texts = F.transform(tokens, lambda t: t["text"])
    rest = F.transform(texts, lambda x, i: F.when(is_label(x), F.array_join(F.slice(texts, i + 2, F.size(texts)), " ")))
    return F.filter(rest, lambda x: x.isNotNull())


def _first(values: Column, accept) -> Column:
    return F.aggregate(values, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, accept(x)))


def _is_expiry_label(text: Column) -> Column:
    bare = T.letters(text)
    return bare.rlike(EXPIRY_TOKEN) & (bare.rlike("HIN|HNOG") | bare.rlike(EXPIRY_START))


def by_position(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, found): a map from field to its value, from layout lines (id, line_no, y, tokens, line)."""
    text, tokens = F.col("line"), F.col("tokens")
    order = W.partitionBy(id_col).orderBy("line_no")
    inline = lambda shape, accept: accept(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")))
    village = F.coalesce(inline(VILLAGE_INLINE, place_value), _first(_right_of(tokens, lambda x: T.compact(x).rlike(VILLAGE_TOKEN)), place_value))
    district = F.coalesce(inline(DISTRICT_INLINE, place_value), _first(_right_of(tokens, lambda x: T.letters(x).rlike(DISTRICT_TOKEN)), place_value))
    own = F.coalesce(inline(EXPIRY_INLINE, expiry_value), _first(_right_of(tokens, _is_expiry_label), expiry_value))
    near = F.coalesce(*(F.lead("_any", k).over(order) if k > 0 else F.lag("_any", -k).over(order) for k in EXPIRY_NEAR))
    rows = lines.withColumn("_any", expiry_value(text))
    expiry = F.coalesce(own, F.when(_is_expiry_label(text), near))
    bare = T.letters(text)
    status = F.when(F.col("y").between(*STATUS_BAND) & bare.rlike("STATUS|PERKAW|KAWIN|MENIKAH"), T.marital_status(text))
    # Citizenship beside its label, or on a line near one: the labels of a card are few, and so are its lines.
    labels = F.collect_list(F.when(bare.rlike("KEWARG|KEVRG"), F.col("y"))).over(W.partitionBy(id_col))
    named = T.citizenship(F.regexp_extract(F.upper(text), r"\b([WVY]N[IA1L])\b", 1))
    citizen = F.when(F.col("y").between(*CITIZEN_BAND) & F.exists("_labels", lambda y: F.abs(y - F.col("y")) <= NEAR), named)
    rows = rows.withColumn("_labels", labels)
    values = {"kelurahan_desa": village, "kecamatan": district, "berlaku_hingga": expiry, "status_perkawinan": status, "kewarganegaraan": citizen}
    # Windows stay in a projection of their own.
    read = rows.select(id_col, "line_no", *(c.alias(n) for n, c in values.items()))
    firsts = read.groupBy(id_col).agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in values))
    return firsts.select(id_col, F.map_filter(F.create_map(*(x for n in values for x in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull()).alias("found"))


def with_layout(parsed: DataFrame, lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Parsed identity cards whose five fields are completed from the layout lines of their tokens.

    A good value stays, with the confidence of a value that was seen twice; a
    default does not count as one.  Cards without positioned tokens and other
    documents stay as they are; rows with the same id share that id's lines.
    """
    fields = F.col("fields")
    now = lambda n: F.try_element_at(fields, F.lit(n))
    normal = {"status_perkawinan": T.marital_status, "kewarganegaraan": T.citizenship, "kelurahan_desa": place_value, "kecamatan": place_value, "berlaku_hingga": expiry_value}
    rows = parsed.join(by_position(lines, id_col).withColumnRenamed("found", "_found"), id_col, "left")
    given = []
    for name, normalize in normal.items():
        value = normalize(now(name)["value"])
        good = F.when(now(name)["raw"].isNull() | (now(name)["raw"] != DEFAULT_STATUS_RAW), value) if name == "status_perkawinan" else value
        found = F.try_element_at("_found", F.lit(name))
        kept = field(good, F.lit(KEPT[name]), now(name)["raw"])
        given += [F.lit(name), F.when(good.isNotNull(), kept).when(found.isNotNull(), field(found, FOUND, F.lit("layout")))]
    card = (F.col("document_type") == "KTP") & F.col("_found").isNotNull()
    replaced = F.map_zip_with(fields, F.create_map(*given), lambda k, a, b: F.coalesce(b, a))
    return rows.withColumn("fields", F.when(card, replaced).otherwise(fields)).select(*parsed.columns)
