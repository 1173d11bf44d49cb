"""Tokens from the raw JSON output of text recognisers, however deep they stand.

Three shapes are met in one output, at any depth and side by side: objects with
lists of texts, scores and boxes; pairs of a box and (text, score); and flat
rows (box, text, score) or (text, score).  Depth is not known, which no
expression of the JVM walks, so a small walk over each parsed output runs in
Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = "array<struct<text:string,confidence:double,bbox:string>>"
#: Names of the lists, the first that is there and not null holds.
TEXTS, SCORES, BOXES = ("rec_texts", "texts"), ("rec_scores", "scores"), ("rec_boxes", "dt_polys", "boxes")
ROW_TEXTS = ("txts",)
_KIND = pa.struct([("tokens", pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.string())]))), ("error", pa.string())])


def _number(value: Any) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def _first(node: dict, names: tuple[str, ...]) -> list:
    found = next((node[n] for n in names if node.get(n) is not None), [])
    return found if isinstance(found, list) else []


def _token(text: Any, score: Any, box: Any) -> list[dict]:
    clean = "" if text is None else str(text).strip()
    return [{"text": clean, "confidence": _number(score), "bbox": None if box is None else json.dumps(box, ensure_ascii=False)}] if clean else []


def _listed(texts: list, scores: list, boxes: list) -> list[dict]:
    at = lambda values, i: values[i] if i < len(values) else None
    return [t for i, text in enumerate(texts) for t in _token(text, at(scores, i), at(boxes, i))]


def nested_tokens(root: Any) -> list[dict]:
    """Tokens of nested output in the order of the document, by a stack of what is still to be read."""
    found: list[dict] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            texts = _first(node, TEXTS)
            if texts:
                found += _listed(texts, _first(node, SCORES), _first(node, BOXES))
            else:
                todo.extend(reversed(node.values()))
        elif isinstance(node, list):
            pair = node[1] if len(node) == 2 else None
            if isinstance(pair, list) and len(pair) == 2 and isinstance(pair[0], str):
                found += _token(pair[0], pair[1], node[0])
            else:
                todo.extend(reversed(node))
    return found


def row_tokens(root: Any) -> list[dict]:
    """Tokens of flat output: lists side by side, or rows (box, text, score) or (text, score)."""
    if isinstance(root, dict):
        return _listed(_first(root, ROW_TEXTS), _first(root, SCORES), _first(root, BOXES))
    found: list[dict] = []
    for row in root if isinstance(root, list) else []:
        if isinstance(row, list) and len(row) >= 2:
            box, text, score = row[:3] if len(row) >= 3 else (None, *row)
            found += _token(text, score, box)
    return found


WALKS = {"nested": nested_tokens, "rows": row_tokens}


def tokens_of(output: Column, shape: str = "nested") -> Column:
    """struct(tokens, error) of a JSON text: `error` is not_json for malformed or too deep text, whose tokens are empty."""
    walk = WALKS[shape]

    def read(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append({"tokens": walk(json.loads(text)) if text is not None else [], "error": None})
            except (ValueError, RecursionError):
                out.append({"tokens": [], "error": "not_json"})
        return pa.array(out, _KIND)

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, f"struct<tokens:{TOKENS},error:string>")(output)


def read_output(outputs: DataFrame, output_col: str = "output", shape: str = "nested") -> DataFrame:
    """Add tokens, raw_text (their texts, one a line) and error to rows of raw output.

    Null output has no tokens and no error; repeated rows and any other columns stay.
    """
    rows = outputs.withColumn("_read", tokens_of(F.col(output_col), shape))
    return rows.select(*(c for c in rows.columns if c != "_read"), F.col("_read.tokens").alias("tokens"), F.array_join(F.col("_read.tokens.text"), "\n").alias("raw_text"), F.col("_read.error").alias("error"))
