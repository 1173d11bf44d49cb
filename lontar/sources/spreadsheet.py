"""Rows of spreadsheet files (XLSX), read where the tasks run.

Files come through Spark's binary reader, so they may lie in any store that
Spark reads; each is unpacked by one task and its rows leave it in bounded
batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.sources.tables import postal_star

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Rows that leave a task at once.
BATCH_ROWS = 10_000
_ROWS = pa.schema([("path", pa.string()), ("row_no", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
#: File names and columns of the postal sheets.
SHEETS = {
    "provinces": ("M_PROVINSI.xlsx", {"KODE_PROVINSI": "province_code", "PROVINSI": "province_name"}),
    "cities": ("M_KOTA.xlsx", {"KODE_KOTA": "city_code", "NAMA_KOTA": "city_name", "KODE_PROVINSI": "province_code"}),
    "districts": ("M_KECAMATAN.xlsx", {"KODE_KECAMATAN": "district_code", "NAMA_KECAMATAN": "district_name"}),
    "postal": ("M_KODEPOS.xlsx", {"KODE_POS": "kode_pos", "ALAMAT": "address", "KODE_KOTA": "city_code", "KODE_KECAMATAN": "district_code", "SIFAT_POS": "sifat_pos"}),
}


def column_number(reference: str) -> int:
    """Number (from 0) of the column of a cell such as AB12."""
    number = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return max(0, number - 1)


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[dict[int, str]]:
    """Rows of one sheet as column number to text, empty cells left out; one row in memory at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as file:
                shared = [_texts(node) for _, node in ElementTree.iterparse(file) if node.tag == f"{_MAIN}si"]
        with book.open(f"xl/worksheets/sheet{sheet}.xml") as file:
            for _, row in ElementTree.iterparse(file):
                if row.tag != f"{_MAIN}row":
                    continue
                cells = {}
                for k, cell in enumerate(row.findall(f"{_MAIN}c")):
                    at = column_number(cell.get("r")) if cell.get("r") else k
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        cells[at] = _texts(cell)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield cells
                row.clear()


def _named(content: bytes, sheet: int) -> Iterator[list[tuple[str, str]]]:
    rows = sheet_rows(content, sheet)
    header = {k: name.strip() for k, name in next(rows, {}).items() if name.strip()}
    for row in rows:
        yield [(name, row[k]) for k, name in header.items() if k in row]


def read_sheets(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row_no, cells) of files of a path or pattern: every row below the first one, which names the columns.

    `cells` is a map without the empty cells; a file without rows gives none; one
    that is no spreadsheet fails the job, as a broken table does.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for some in batched(enumerate(_named(content.as_py(), sheet), 1), BATCH_ROWS):
                    columns = [pa.array([place] * len(some)), pa.array([n for n, _ in some], pa.int64()), pa.array([c for _, c in some], _ROWS.field("cells").type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "path string, row_no long, cells map<string,string>")


def clean_code(value: Column) -> Column:
    """A code as a whole number without a point, else as it is; empty where there is none."""
    number = value.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), number.cast("decimal(20,0)").cast("string")), F.trim(value), F.lit(""))


def read_postal_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Postal reference rows of the four sheets of a folder."""

    def sheet(name: str) -> DataFrame:
        file, columns = SHEETS[name]
        cell = lambda c: F.try_element_at("cells", F.lit(c))
        value = lambda c, out: clean_code(cell(c)) if out.endswith("_code") else F.coalesce(F.trim(cell(c)) if out == "kode_pos" else cell(c), F.lit(""))
        return read_sheets(spark, f"{folder}/{file}").select(*(value(c, out).alias(out) for c, out in columns.items()))

    def once(rows: DataFrame, key: str) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, "r.*")

    # A code that a sheet names twice counts once.
    keyed = {"provinces": "province_code", "cities": "city_code", "districts": "district_code"}
    return postal_star(sheet("postal"), *(once(sheet(n), keyed[n]) for n in ("cities", "provinces", "districts")))
