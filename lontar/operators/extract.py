"""Plug-in extractors: any function from file content to tokens, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_TYPE = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"
Extractor = Callable[[bytes, str], list[dict]]
_REGISTRY: dict[str, Callable[[], Extractor]] = {}


def register(name: str, factory: Callable[[], Extractor]) -> None:
    """Name an extractor; the factory runs once in each Python worker, so models load there."""
    _REGISTRY[name] = factory


def extract(files: DataFrame, name: str) -> DataFrame:
    """(path, provider, tokens, raw_text, error) of files (path, content); a file that fails gives its error."""
    factory = _REGISTRY[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = factory()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, name, extractor(bytes(content), path), None))
                except Exception as error:  # a bad file is a row, not a failed job
                    rows.append((path, name, [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "provider", "tokens", "error"])

    read = files.select("path", "content").mapInPandas(run, f"path string, provider string, tokens {TOKEN_TYPE}, error string")
    return read.withColumn("raw_text", F.array_join(F.transform("tokens", lambda t: t["text"]), "\n"))


def box_polygon(box: Column) -> Column:
    """A box of four numbers as its polygon."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
