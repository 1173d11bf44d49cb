"""Normalisers of noisy document text, each a Column expression.

A normaliser returns null where it does not accept a value.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width punctuation and what it stands for; letters that are read for digits, and back.
WIDE, NARROW = "：／，－．　", ":/,-. "
LETTER_DIGITS = ("OILSB", "01158")
DIGIT_LETTERS = ("0158", "OISB")
MONTHS = ("JANUARI", "FEBRUARI", "MARET", "APRIL", "MEI", "JUNI", "JULI", "AGUSTUS", "SEPTEMBER", "OKTOBER", "NOVEMBER", "DESEMBER")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _some(value: Column) -> Column:
    return let(value, lambda v: F.when(v != "", v))


def _folding() -> tuple[str, str]:
    """Letters with one ASCII letter or sign at their base, and these: accented Latin letters and wide forms."""
    points = [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]
    bases = {chr(p): unicodedata.normalize("NFKD", chr(p)).encode("ascii", "ignore").decode() for p in points}
    single = {c: b for c, b in bases.items() if len(b) == 1}
    return "".join(single), "".join(single.values())


_ACCENTED, _BASES = _folding()


def fold_accents(value: Column) -> Column:
    """ASCII text: accents go from their letters, what has no ASCII letter at its base goes altogether."""
    return F.regexp_replace(F.translate(value, _ACCENTED, _BASES), r"[^\x00-\x7F]", "")


def collapse_spaces(value: Column) -> Column:
    """Runs of white space become one space; space, colon and semicolon go from both ends."""
    return F.btrim(F.regexp_replace(value, r"\s+", " "), F.lit(" :;"))


def normalized_lines(text: Column) -> Column:
    """Cleaned non-empty lines of a text, in order."""
    narrow = F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW)
    lines = F.split(F.translate(narrow, "\r", "\n"), "\n")
    return F.filter(F.transform(lines, collapse_spaces), lambda x: x != "")


def compact(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def letters(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z]", "")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def mask_ids(value: Column) -> Column:
    """Hide the middle six digits of standalone 16-digit runs."""
    return F.regexp_replace(value, r"\b(\d{6})\d{6}(\d{4})\b", "$1******$2")


def clean_candidate(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s:;\-]+", "")


def repair_digits(value: Column) -> Column:
    """Read look-alike letters as digits."""
    return F.translate(F.upper(value), *LETTER_DIGITS)


def repair_letters(value: Column) -> Column:
    return F.translate(F.upper(value), *DIGIT_LETTERS)


def id_number(value: Column) -> Column:
    """A 16-digit id, whatever stands between its digits."""
    return let(digits(value), lambda d: F.when(F.length(d) == 16, d))


def repaired_id_number(value: Column) -> Column:
    """A 16-digit id with at most two look-alike characters."""
    marks = F.regexp_replace(F.upper(value), "[^0-9,.OQIL|SB]", "")
    return let(marks, lambda m: F.when((F.length(m) == 16) & (F.length(F.regexp_replace(m, "[0-9]", "")) <= 2), F.translate(m, ",.OQIL|SB", "110011158")))


def id_numbers_in(line: Column) -> Column:
    """All 16-digit runs of a line that are no part of longer runs."""
    return F.regexp_extract_all(line, F.lit(r"(?<!\d)(\d{16})(?!\d)"), 1)


def short_id_number(line: Column) -> Column:
    """14 or 15 digits on a line that holds nothing but digits and punctuation."""
    return F.when(line.rlike(r"^[:\s\d.\-/]+$") & F.length(digits(line)).between(14, 15), digits(line))


def birth_date_of_id(value: Column, as_of: Column) -> Column:
    """Birth date DD-MM-YYYY that an id number holds; days over 40 mark women."""

    def born(n: Column) -> Column:
        part = lambda at: F.substring(n, at, 2).cast("int")
        day = part(7) - F.when(part(7) > 40, 40).otherwise(0)
        year = part(11) + F.when(part(11) <= F.year(as_of) % 100, 2000).otherwise(1900)
        return F.when(day.between(1, 31) & part(9).between(1, 12), F.format_string("%02d-%02d-%04d", day, part(9), year))

    return let(id_number(value), born)


def gender_of_id(value: Column) -> Column:
    day = F.substring(id_number(value), 7, 2).cast("int")
    return F.when(day > 40, "PEREMPUAN").when(day.isNotNull(), "LAKI-LAKI")


def plate_number(value: Column) -> Column:
    """Vehicle plate as 'B 1234 XYZ'."""

    def spaced(bare: Column) -> Column:
        part = lambda k: F.regexp_extract(bare, r"^([A-Z]{1,2})(\d{1,4})([A-Z]{0,3})$", k)
        return F.when(part(2).try_cast("int") > 0, F.rtrim(F.concat_ws(" ", part(1), part(2), part(3))))

    return let(F.regexp_replace(F.upper(value), r"[\s.\-]", ""), spaced)


def misread_plate_number(value: Column) -> Column:
    """A plate whose last letters, or whose first letter B, were read as digits."""
    shape = r"^([A-Z]{1,2}|[83])(\d{1,4})([A-Z0-9]{1,3})$"

    def repaired(bare: Column) -> Column:
        part = lambda k: F.regexp_extract(bare, shape, k)
        area = F.when(part(1).isin("8", "3"), "B").otherwise(part(1))
        return F.coalesce(plate_number(bare), F.when(bare.rlike(shape), plate_number(F.concat(area, part(2), F.translate(part(3), "013568", "OIJSGB")))))

    return let(F.regexp_replace(F.upper(value), r"[\s.\-]", ""), repaired)


def plates_in(line: Column) -> Column:
    """All plate-like words of a line: letters, digits, letters with single spaces at most."""
    return F.regexp_extract_all(F.upper(line), F.lit(r"\b([A-Z]{1,2}[ .\-]?\d{1,4}[ .\-]?[A-Z]{1,3})\b"), 1)


def date_part(value: Column, size: int) -> Column:
    """Digits of a date part after look-alike repair, of the given length."""
    return let(F.translate(F.regexp_replace(F.upper(value), r"[^0-9OIL|SB]", ""), "OIL|SB", "011158"), lambda d: F.when(F.length(d) == size, d))


_BIRTH = r"(?i)\b([A-Z][A-Z0-9.\s'-]{2,}?)[,.\s]*([0-9OILSB]{1,2})[-/.\s]+([0-9OILSB]{1,2})[-/.\s:]*([0-9OILSB:]{4,6})\b"


def birth_place_date(value: Column, as_of: Column) -> Column:
    """'PLACE, DD-MM-YYYY' with look-alike repair and range checks."""
    blocked = r"\b(NIK|NAMA|ALAMAT|RT|RW|KEL|KECAMATAN|AGAMA|STATUS|PEKERJAAN|BERLAKU|PROVINSI|KABUPATEN)\b"

    def parts(text: Column) -> Column:
        group = lambda k: F.regexp_extract(text, _BIRTH, k)
        place = collapse_spaces(F.regexp_replace(F.regexp_replace(repair_letters(group(1)), r"^.*LAHIR\W*", ""), r"[.\s]+", " "))
        return F.when(text.rlike(_BIRTH), F.struct(place.alias("place"), date_part(group(2), 2).alias("day"), date_part(group(3), 2).alias("month"), date_part(group(4), 4).alias("year")))

    def joined(p: Column) -> Column:
        inside = p["day"].cast("int").between(1, 31) & p["month"].cast("int").between(1, 12) & p["year"].cast("int").between(F.lit(1900), F.year(as_of))
        return F.when(inside & (p["place"] != "") & ~p["place"].rlike(blocked), F.concat(p["place"], F.lit(", "), p["day"], F.lit("-"), p["month"], F.lit("-"), p["year"]))

    return let(let(F.translate(value, "·•", "--"), parts), joined)


def _gender(c: Column) -> Column:
    return F.when(c.rlike("^(LAK|TAK)|LAKI?LAKI|LAKLAKI"), "LAKI-LAKI").when(c.rlike("^(PEREMP|PEREP|PERENP|PERENU)|PEREMPU"), "PEREMPUAN")


def gender(value: Column) -> Column:
    return let(letters(value), _gender)


def _religion(c: Column) -> Column:
    ladder = F.when(c.rlike("KATH?OL|KATOH|KHATOL"), "KATHOLIK")
    for name in ("ISLAM", "KRISTEN", "PROTESTAN", "HINDU", "BUDDHA", "BUDHA", "KONGHUCU", "KHONGHUCU"):
        ladder = ladder.when(c.contains(name), name)
    return ladder


def religion(value: Column) -> Column:
    return let(letters(value), _religion)


def _marital_status(c: Column) -> Column:
    return F.when(c.rlike("BE[LI]UM"), "BELUM KAWIN").when(c.rlike("CERA[IL]H[IL]DUP"), "CERAI HIDUP").when(c.rlike("CERA[IL]MAT[IL]"), "CERAI MATI").when(c.rlike("KAW[IL]N"), "KAWIN")


def marital_status(value: Column) -> Column:
    return let(letters(value), _marital_status)


def _citizenship(c: Column) -> Column:
    return F.when(c.isin("WNI", "VNI", "YNI"), "WNI").when(c.isin("WNA", "VNA", "YNA"), "WNA")


def citizenship(value: Column) -> Column:
    return let(F.translate(compact(value), "1L", "II"), _citizenship)


def _job(c: Column) -> Column:
    ladder = F.when(c.rlike("PELAJAR|MAHASIS"), "PELAJAR/MAHASISWA").when(c.rlike("RUMAHTANGGA|URUSRUMAH"), "MENGURUS RUMAH TANGGA").when(c.rlike("BELUM.?TIDAKBEKERJA|TIDAKBEKERJA"), "BELUM/TIDAK BEKERJA")
    ladder = ladder.when(c.rlike("PEGAWAINEGERI"), "PEGAWAI NEGERI SIPIL").when(c.rlike("KARYAWANSWASTA|KARYAWANSW"), "KARYAWAN SWASTA").when(c.rlike("BURUHHARIAN"), "BURUH HARIAN LEPAS")
    for name in ("WIRASWASTA", "PETANI", "PEDAGANG", "NELAYAN", "GURU", "DOKTER", "PERAWAT", "PENSIUNAN", "SOPIR"):
        ladder = ladder.when(c.contains(name), name)
    return ladder


def job(value: Column) -> Column:
    return let(letters(value), _job)


def expiry(value: Column) -> Column:
    """'SEUMUR HIDUP' or DD-MM-YYYY from 2000 on."""
    group = lambda k: F.regexp_extract(value, r"\b(\d{1,2})[-/.\s]+(\d{1,2})[-/.\s]+(\d{4})\b", k)
    dated = F.concat(F.lpad(group(1), 2, "0"), F.lit("-"), F.lpad(group(2), 2, "0"), F.lit("-"), group(3))
    return F.when(compact(value).rlike("SEUM[UL]R|UMURH[I1L]DUP|SEUMURH"), "SEUMUR HIDUP").when(group(3).try_cast("int") >= 2000, dated)


def rt_rw(value: Column) -> Column:
    """Neighbourhood numbers as 000/000."""

    def sides(text: Column) -> Column:
        group = lambda k: F.regexp_extract(text, r"(?<!\d)([0-9OIL|.]{1,3})\s*/\s*([0-9OIL|.]{1,3})(?!\d)", k)
        side = lambda k: F.lpad(F.translate(group(k), "OIL|.", "01111"), 3, "0")
        plain = lambda d: F.when(F.length(d) == 6, F.concat_ws("/", F.substring(d, 1, 3), F.substring(d, 4, 3))).when((F.length(d) == 7) & (F.substring(d, 4, 1) == "1"), F.concat_ws("/", F.substring(d, 1, 3), F.substring(d, 5, 3)))
        found = F.when(group(1) != "", F.concat_ws("/", side(1), side(2))).otherwise(let(digits(text), plain))
        return F.when(~text.rlike(r"\d{2}[-.]\d{2}[-.]\d{2,4}"), found)

    return let(F.upper(clean_candidate(value)), sides)


def postal_code(value: Column) -> Column:
    return let(F.translate(compact(value), *LETTER_DIGITS), lambda d: F.when(d.rlike(r"^\d{5}$"), d))


def person_name(value: Column) -> Column:
    """Letters, dots and apostrophes only, at least three letters, no label word."""
    label = r"\b(NIK|NAMA|ALAMAT|LAHIR|JENIS|KELAMIN|AGAMA|STATUS|PEKERJAAN|BERLAKU|HINGGA|PROVINSI|KABUPATEN|KOTA|KECAMATAN|KEL|DESA|RT|RW|GOL|DARAH|NOMOR|POLISI|RANGKA|MESIN)\b"
    fits = lambda t: t.rlike(r"^[A-Z][A-Z.' ]*$") & (F.length(letters(t)) >= 3) & ~t.rlike(label)
    return let(F.upper(collapse_spaces(value)), lambda t: F.when(fits(t), t))


def region_name(value: Column) -> Column:
    """A place name: at least three letters, no digits, no label of another field."""
    label = r"\b(NIK|NAMA|ALAMAT|LAHIR|JENIS|KELAMIN|AGAMA|STATUS|PERKAWINAN|PEKERJAAN|BERLAKU|HINGGA|RT|RW|GOL|DARAH|KEWARGANEGARAAN)\b|/"
    fits = lambda t: (F.length(letters(t)) >= 3) & ~t.rlike(r"\d") & ~t.rlike(label)
    return let(F.upper(collapse_spaces(clean_candidate(value))), lambda t: F.when(fits(t), t))


_ADDRESS_REWRITES = (
    (r"\bJALAN\b\.?", "JL."),
    (r"\bJLN?\b\.?\s*", "JL. "),
    (r"\bGANG\b\.?", "GG."),
    (r"\bGG\b\.?\s*", "GG. "),
    (r"\bBLOK(?=[A-Z0-9])", "BLOK "),
    (r"\bN[O0]\.?\s*(?=\d)", "NO. "),
    (r"\s+,", ","),
    (r"\s+", " "),
)


def address(value: Column) -> Column:
    """Street abbreviations and spacing made uniform."""
    return _some(F.trim(reduce(lambda c, r: F.regexp_replace(c, *r), _ADDRESS_REWRITES, F.upper(collapse_spaces(value)))))


def looks_like_address(value: Column) -> Column:
    return F.upper(value).rlike(r"\b(JL|JLN|JALAN|GG|GANG|KP|KAMPUNG|DUSUN|DSN|BLOK|PERUM|KOMP|KOMPLEK|LINGK)\b|\bNO\.?\s*\d")


def year(value: Column, as_of: Column) -> Column:
    """A year of manufacture from 1950 to next year."""
    found = F.regexp_extract(repair_digits(value), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return let(found, lambda y: F.when(y.try_cast("int").between(F.lit(1950), F.year(as_of) + 1), y))


def vehicle_code(value: Column) -> Column:
    """Chassis or engine number: 6 to 20 letters and digits, some of them digits."""
    return let(compact(value), lambda bare: F.when(bare.rlike(r"^(?=.*\d)[A-Z0-9]{6,20}$"), bare))


def month_date(value: Column) -> Column:
    """'D MONTHNAME YYYY' as DD-MM-YYYY."""
    text = F.upper(value)
    group = lambda k: F.regexp_extract(text, rf"\b(\d{{1,2}})\s*({'|'.join(MONTHS)})\s*(\d{{4}})\b", k)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), group(2))
    return F.when(group(1) != "", F.concat_ws("-", F.lpad(group(1), 2, "0"), F.lpad(number.cast("string"), 2, "0"), group(3)))


def iso_date(value: Column) -> Column:
    """Calendar-checked ISO date of DD-MM-YYYY text."""
    return F.date_format(F.try_to_date(value, "dd-MM-yyyy"), "yyyy-MM-dd")


def count_markers(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the substrings stand in the upper-cased text."""
    upper = F.upper(text)
    return reduce(lambda a, b: a + b, (F.coalesce(F.contains(upper, F.lit(m)), F.lit(False)).cast("int") for m in markers))
