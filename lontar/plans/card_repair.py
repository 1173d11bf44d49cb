"""Identity cards whose lines are out of order: names and places that label windows miss or mix up.

Lines become letters (`KINDS`), and each repair is a shape of letters that says
where a value stands.  Repairs are tried in a fixed order; places are a fold of
proposals over the pair (kelurahan, kecamatan), as every one depends on what
those before it left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.functions.text import let
from lontar.operators.line_codes import code_lines, fold, line_at, locate, proposal

#: Letters of the kinds of lines, in the order in which they are tried.
KINDS = {
    "N": "id number",
    "m": "name label alone",
    "k": "kelurahan label with a value",
    "K": "kelurahan label alone",
    "c": "kecamatan label with a value",
    "C": "kecamatan label alone",
    "B": "date",
    "U": "RT/RW label with a value",
    "T": "RT/RW value",
    "t": "RT/RW label alone",
    "b": "birth label without a date",
    "n": "id label",
    "x": "any other label",
    "y": "sex, religion, marital status, citizenship, job, expiry",
    "R": "place that is no name",
    "p": "place or name of several words",
    "u": "place or name of one word",
    "q": "place with digits, slashes or few letters",
    "a": "street",
}
PLACE, PERSON = "[Rpuq]", "[pu]"

#: Spellings of labels of places, without what is no letter or digit.
VILLAGE_LABELS = (
    "KELDESA", "KALDESA", "KEDESA", "KEILDESA", "KELURAHAN", "DESA", "DESAKEL", "KOLDESA", "KOLDASA", "KEWDESA", "KEVDESA", "KELDESN", "KELDOSA",
    "KELOOSA", "KELDESS", "KELDEAN", "DESAKOL", "KALDESS", "NOESA", "NOASA", "N0ESA", "VOASA", "ELDESA",
)
DISTRICT_LABEL = "^(?:KEC|EATAN|CAMATAN|COMATAN|ECEMATAN|IECAMATAN|KICANALAN|CAMNATAN|[KXE]?ECAM[A-Z]*|KECAN[A-Z]*|KEC[A-Z]*NATAN|KECAMRETAN)$"
AREA_LABEL = r"\b(?:RT\s*/?\s*(?:RW|AW|RV)|TT\s*/?\s*RW|TIT\s*/?\s*RW|AT\s*/?\s*RW|ATIAW|RTIAW|RTRW|RTAW|TTRW|TITRW|ATRW)\b"
NAME_LABEL = r"^:?\s*(?:NAMA|NAME|NAMS|NANIA|NAMAT|NAM|AM)\s*:?$"
ANY_LABEL = (
    r"\b(?:NIK|NAMA|TEMP\w*|TGL|TANGGAL|LAHIR|JENIS|KELAMIN|ALAMAT|RT\s*/?\s*(?:RW|AW)|AT\s*/?\s*RW|RTRW|RTAW|KEL(?:/|\b)|KELURAHAN|DESA|KECAM\w*|AGAMA|STATUS|PERKAW\w*"
    r"|PEKER\w*|PEIKER\w*|PAKER\w*|POKERJAAN|K[EO]WARG\w*|BERLAKU|HINGGA|PROVINSI|KABUPATEN|KOTA|GOL|DARAH)\b"
)
#: Pieces of labels that are no place, and places whose spaces and letters are often lost.
FRAGMENTS = ("EATAN", "MATAN", "CAMATAN", "DESA", "KELDESA", "KEILDESA", "KELDEAN", "KICANALAN", "NANIA", "DESS", "DOSA", "DESN")
PLACE_REWRITES = {
    "GANDARA SELATAN": "GANDARIA SELATAN",
    "CLANDAK": "CILANDAK",
    "TANAHABANG": "TANAH ABANG",
    "BENDUNGANHLIR": "BENDUNGAN HILIR",
    "PB SELAYANGI": "PADANG BULAN SELAYANG I",
}
#: Words that no name has, values of other fields, parts of names of cities.
NO_NAME_WORDS = (
    "KARYAWAN", "SWASTA", "WIRASWASTA", "PELAJAR", "MAHASISWA", "MENGURUS", "RUMAH", "TANGGA", "BURUH", "PETANI", "NELAYAN", "PEDAGANG", "PNS", "TNI", "POLRI",
    "GURU", "DOSEN", "DOKTER", "DRIVE", "MANAGE", "TOSHIBA", "TYPE", "HERE", "WINDOWS", "ISLAM", "KRISTEN", "KATHOLIK", "KATOLIK", "HINDU", "BUDDHA", "BUDHA",
    "KONGHUCU", "KAWIN", "CERAI", "WNI", "WNA", "SEUMUR", "HIDUP", "LAKI", "PEREMPUAN",
)
CITY_PARTS = r"AKARTA|\b(?:BARA|BARAT|TIMU|TIMUR|UTAR|UTARA|SELATA|SELATAN|PUSAT)\b"
#: First names that are often joined to the next one, beginnings of those, and names joined to an initial.
JOINED_FIRST = (
    "MUHAMMAD", "MOHAMAD", "MOCHAMAD", "ABDUL", "AHMAD", "ANNISA", "ANISA", "DEWI", "DIAH", "SITI", "NUR", "SRI", "SETIOWATI", "SETIO", "TRI", "DWI", "EKO", "BUDI",
    "AGUS", "PUTRI", "PUTRA",
)
JOINED_SECOND = (
    "AGUS", "AN", "ANG", "BUDI", "CAH", "DEWI", "DIAN", "DWI", "EKA", "FIT", "HART", "HIDAY", "KURN", "LEST", "MAUL", "NINGS", "NUG", "PRA", "PRI", "PUT", "RAH",
    "RAT", "RET", "RIZ", "SAP", "SANT", "SET", "SUL", "SUP", "SUR", "SUS", "WAH", "WID", "YUL", "YUN",
)
JOINED_INITIAL = ("SYARIFUL",)
ALONE_FIRST = ("PUTRI", "PUTRA")
#: Confidence of what is found where nothing was, of what replaces a value, and of names that were taken apart.
FOUND, REPLACED, NAME_FOUND, NAME_REPLACED, WRAPPED, SPACED, INITIAL = 0.78, 0.72, 0.72, 0.70, 0.78, 0.78, 0.82


def _dated(line: Column) -> Column:
    return line.rlike(r"\d{1,2}[-./]\d{1,2}[-./]\d{2,4}")


def is_fragment(value: Column) -> Column:
    return T.letters(value).isin(*FRAGMENTS)


def is_other_value(line: Column) -> Column:
    """Whether a line is a value of a field that is neither a name nor a place."""
    return F.coalesce(T.gender(line), T.religion(line), T.marital_status(line), T.citizenship(line), T.job(line), T.expiry(line)).isNotNull()


def is_street(line: Column) -> Column:
    return F.upper(line).rlike(r"\b(?:J|JL|JLN|JALAN|KP|KAMP|KAMPUNG|DSN|DUSUN|DUKUH|LINGK|GG|GANG|PERUM|KOMP\w*|BLOK\w*|KAV|TMN|TAMAN|SIMPANG)\b|\bNO\.?\s*\d+")


def place_name(line: Column) -> Column:
    """The line as the name of a place, known misreadings put right; null if it is something else."""
    clean = F.regexp_replace(F.btrim(F.translate(F.upper(T.clean_candidate(line)), "!", "I"), F.lit(" :;._-")), r"\s+", " ")
    for wrong, right in PLACE_REWRITES.items():
        clean = F.replace(clean, F.lit(wrong), F.lit(right))

    def accepted(c: Column) -> Column:
        own_city = c.rlike(r"^(?!KOTA )[A-Z][A-Z .'\-]{4,}(?<= KOTA)$")
        street = is_street(c) & ~c.rlike("^(?:TAMAN |TMN |DUKUH)")
        bad = c.rlike(ANY_LABEL) | c.rlike(AREA_LABEL) | _dated(c) | is_other_value(c) | T.rt_rw(c).isNotNull() | street
        fits = c.rlike(r"^[A-Z][A-Z0-9 .'\-/]{2,}$") & (F.length(T.letters(c)) >= 3)
        return F.when(~is_fragment(c) & (own_city | (fits & ~bad)), c)

    return let(clean, accepted)


def kind(line: Column) -> Column:
    """The letter of a line: of the first of `KINDS` that it is, else z."""
    upper, bare, only_letters = F.upper(line), T.compact(line), T.letters(line)
    village = rf"^\W*(?:{'|'.join(('KEL', 'KAL', 'KOL', 'EL'))})?\W*/?\W*(?:KELURAHAN|DESA|DESS|DESN|DOSA|OOSA|DASA|DEAN)\s*[:_\-]+\s*\S|^\W*(?:{'|'.join(VILLAGE_LABELS)})\s*[:_\-]+\s*\S"
    district = r"^\W*(?:[KXE]?ECAM[A-Z]*|KECAN[A-Z]*|KICANALAN|CAMATAN)\s*(?:[:_\-]+\s*\S|\s+\S)"
    area = upper.rlike(AREA_LABEL) | only_letters.isin("RTRW", "RTRV", "TTRW", "TITRW", "ATRW", "RYRW")
    place = place_name(line)
    clean = F.btrim(F.upper(T.clean_candidate(line)))
    no_name = clean.rlike(rf"\b(?:{'|'.join(NO_NAME_WORDS)})\b") | clean.rlike(CITY_PARTS)
    of_place = F.when(no_name, "R").when(clean.rlike("^(?=.{5})[A-Z.']+(?: +[A-Z.']+)+$"), "p").when(clean.rlike("^[A-Z.']{5,}$"), "u").otherwise("q")
    of_area = F.when(area, "U").otherwise("T")
    ladder = (
        F.when(T.id_number(line).isNotNull(), "N")
        .when(upper.rlike(NAME_LABEL), "m")
        .when(upper.rlike(village), "k")
        .when(bare.isin(*VILLAGE_LABELS) | bare.startswith("KELD"), "K")
        .when(upper.rlike(district), "c")
        .when(only_letters.rlike(DISTRICT_LABEL), "C")
        .when(_dated(line) & ~upper.rlike("BERLAKU|HINGGA"), "B")
        .when(T.rt_rw(line).isNotNull(), of_area)
        .when(area, "t")
        .when(upper.rlike("LAHIR|TEMPAT"), "b")
        .when(bare.isin("NIK", "NTK", "HIK"), "n")
        .when(upper.rlike(ANY_LABEL), "x")
        .when(is_other_value(line), "y")
        .when(place.isNotNull(), of_place)
        .when(is_street(line), "a")
    )
    return ladder.otherwise("z")


def region_proposals(codes: Column, places: Column) -> list[Column]:
    """What each shape says of (kelurahan, kecamatan), in the order in which the shapes are believed."""
    at = lambda before, behind="", last=False: line_at(places, locate(codes, before, PLACE, behind, last))
    none = F.lit(None).cast("string")
    v, no = PLACE, "[^Rpuq]"
    # Both values between the labels: the upper one is the kecamatan's.
    held = f"(?:K(?:[^KCRpuq]){{0,3}})"
    between_first = at(held, f"[^KC]{{0,3}}{v}[^KCRpuq]{{0,2}}C")
    between_last = at(f"{held}{v}[^KC]{{0,3}}", "[^KCRpuq]{0,2}C")
    # Behind an id number and before the RT/RW value; behind its label and before its value.
    behind_id = at("N[^TUmKkCcnxb]{0,4}", "[TU]")
    before_area = at(f"t(?:[^TU]){{0,10}}", "[TaBNy]")
    # Behind the last of the labels: kecamatan first.
    last_first = at("[KCtU][^KCtURpuq]{0,17}", "[^KCtU]*$")
    last_second = at(f"[KCtU][^KCtURpuq]{{0,17}}{v}[^KCtURpuq]{{0,16}}", "[^KCtU]*$")
    # Labels in reverse order above the RT/RW label: values follow in that order.
    above_first, above_second = at(f"CK[tU]{no}{{0,8}}"), at(f"CK[tU]{no}{{0,7}}{v}{no}{{0,7}}")
    # Labels below each other without values: values follow in their order.
    bare_first, bare_second = at("KC[^Rpuqy]{0,5}"), at(f"KC[^Rpuqy]{{0,4}}{v}[^Rpuqy]{{0,4}}")
    # Two values in a row behind the kecamatan's label.
    row_first, row_second = at(f"C{no}{{0,3}}", v), at(f"C{no}{{0,2}}{v}")
    adjacent = codes.rlike("CK")
    # A kelurahan label without a value, its value behind the kecamatan's label.
    late_first, late_second = at(f"K[TUy]{{0,6}}C{no}{{0,8}}"), at(f"K[TUy]{{0,6}}C{no}{{0,7}}{v}[^RpuqmxnKC]{{0,7}}")
    return [
        proposal(between_last, between_first, fills=between_last.isNotNull(), shifts=True),
        proposal(F.when(adjacent, F.coalesce(behind_id, before_area, last_second)), none, fills=True),
        proposal(behind_id, none, fills=True),
        proposal(before_area, none, fills=True),
        proposal(last_second, last_first, fills=True),
        proposal(above_second, above_first, fills=True),
        proposal(bare_first, bare_second, swaps=True),
        proposal(row_first, row_second, fills=~adjacent & row_second.isNotNull()),
        proposal(last_second, last_first, equals=adjacent),
        proposal(late_first, late_second, fills=True, swaps=True),
    ]


def repaired_regions(village: Column, district: Column, taken: list[Column], codes: Column, places: Column) -> Column:
    """(first, second): kelurahan and kecamatan after all repairs; values that are another field's are no values."""
    free = lambda x: F.when(~is_fragment(x) & ~F.coalesce(x.isin(*taken), F.lit(False)), x)
    return fold(free(village), free(district), region_proposals(codes, places), is_fragment)


def name_candidates(codes: Column, lines: Column) -> dict[str, Column]:
    """Names by where they stand."""
    clean = F.transform(lines, lambda x: F.btrim(F.upper(T.clean_candidate(x))))
    at = lambda before, behind="", kind=PERSON, last=False: line_at(clean, locate(codes, before, kind, behind, last))
    return {
        "before_id": at("m.{0,16}", "[^pu]{0,3}N"),
        "before_birth": at("", "[^pu]{0,2}B"),
        "last_of_several_words": at("", kind="p", last=True),
        "behind_label": at("m[^pu]{0,12}"),
        "above_label": at("", "[^pu]{0,2}m"),
        "behind_id": at("(?:N[^p]{0,11}|n[^p]{0,3})", kind="p"),
        "behind_birth": at("B[^pu]{0,4}"),
    }


def needs_repair(name: Column) -> Column:
    return name.rlike(ANY_LABEL) | name.rlike(rf"AKARTA|[0-9]|\b(?:{'|'.join(NO_NAME_WORDS)})\b") | is_street(name) | T.expiry(name).isNotNull() | (F.length(T.letters(name)) <= 1)


def spaced_name(name: Column) -> Column:
    """A name with words that were read as one taken apart."""
    one_word = r"(?<![A-Z'.])(?=[A-Z']{9,}(?![A-Z'.]))"
    longest = "|".join(sorted(JOINED_FIRST, key=lambda x: (-len(x), x)))
    joined = rf"{one_word}({longest})(?!SANT(?!OSO(?![A-Z'])))(?=(?:{'|'.join(JOINED_SECOND)}))(?=[A-Z']{{5,}})"
    alone = rf"{one_word}({'|'.join(ALONE_FIRST)})(?=[A-Z']{{5,}})"
    initial = rf"(?<![A-Z'])({'|'.join(JOINED_INITIAL)})([A-Z]\.)"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, initial, "$1 $2"), joined, "$1 "), alone, "$1 ")


def repaired_name(name: Column, taken: list[Column], codes: Column, lines: Column) -> Column:
    """(value, confidence, raw) of a name after all repairs; confidence and raw are null where the name stays as it was."""
    c = name_candidates(codes, lines)
    wrong = F.coalesce(needs_repair(name) | F.coalesce(name.isin(*taken), F.lit(False)), F.lit(False))
    expired = F.coalesce(T.expiry(name).isNotNull(), F.lit(False))
    instead = F.coalesce(c["before_id"], c["before_birth"], F.when(~expired, c["last_of_several_words"]), c["behind_label"], c["above_label"])
    absent = F.coalesce(c["last_of_several_words"], c["before_id"], c["before_birth"], c["behind_id"])
    later = F.coalesce(c["behind_birth"], c["behind_label"])
    part = lambda v, k, raw: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("confidence"), F.lit(raw).alias("raw")))
    kept = F.struct(name.alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("raw"))
    found = F.when(wrong, part(instead, NAME_REPLACED, "fallback:name")).when(name.isNotNull(), kept).otherwise(F.coalesce(part(absent, NAME_FOUND, "fallback:name"), part(later, NAME_REPLACED, "fallback:name")))

    def spaced(r: Column) -> Column:
        apart = spaced_name(r["value"])
        cap = F.when(r["value"].rlike(rf"\b(?:{'|'.join(JOINED_INITIAL)})[A-Z]\."), INITIAL).otherwise(SPACED)
        return F.when(apart == r["value"], r).otherwise(F.struct(apart.alias("value"), F.least(F.coalesce(r["confidence"], F.lit(1.0)), cap).alias("confidence"), F.coalesce(r["raw"], F.lit("fallback:joined_name_spacing")).alias("raw")))

    def extended(r: Column) -> Column:
        # The name's own line, one word below it, then the birth label.
        first = locate(codes, "", PERSON, "u[bB]")
        own, more = (line_at(F.transform(lines, lambda x: F.btrim(F.upper(T.clean_candidate(x)))), first + k) for k in (0, 1))
        wrapped = F.struct(F.concat_ws(" ", own, more).alias("value"), F.least(F.coalesce(r["confidence"], F.lit(1.0)), F.lit(WRAPPED)).alias("confidence"), F.coalesce(r["raw"], F.lit("fallback:wrapped_name")).alias("raw"))
        return F.when(own == r["value"], wrapped).otherwise(r)

    return let(let(found, lambda r: F.when(r.isNotNull(), spaced(r))), lambda r: F.when(r.isNotNull(), extended(r)))


def birth_from_id(value: Column, born: Column) -> Column:
    """The place with the date of the id number, where both differ in a digit of the year or by ten years at most; else null."""
    shape = r"^(.+), (\d{2}-\d{2})-(\d{4})$"
    part = lambda k: F.regexp_extract(value, shape, k)
    year, other = part(3), F.substring(born, 7, 4)
    differing = sum(((F.substring(year, k, 1) != F.substring(other, k, 1)).cast("int") for k in range(1, 5)), F.lit(0))
    near = (differing <= 1) | (F.abs(year.try_cast("int") - other.try_cast("int")) <= 10)
    return F.when(value.rlike(shape) & (part(2) == F.substring(born, 1, 5)) & near, F.concat(part(1), F.lit(", "), born))


def coded(lines: Column) -> Column:
    return code_lines(lines, kind)
