"""Recogniser output and agent replies of every shape."""

import json

import pytest
from pyspark.sql import functions as F

from lontar.operators import agent_reply, ocr_output

BOX = [[0, 0], [10, 0], [10, 10], [0, 10]]
NESTED = {
    "lists": ([{"rec_texts": ["NAMA", "BUDI"], "rec_scores": [0.91, 0.88], "rec_boxes": [BOX, BOX]}], [("NAMA", 0.91, True), ("BUDI", 0.88, True)]),
    "gaps": ([{"rec_texts": ["NAMA", None, " BUDI "], "rec_scores": [None, 0.8, "bad"], "rec_boxes": []}], [("NAMA", 0.0, False), ("BUDI", 0.0, False)]),
    "other names": ({"texts": ["A"], "scores": ["0.5"], "dt_polys": [BOX]}, [("A", 0.5, True)]),
    "pairs": ([[[BOX, ["NAMA", 0.9]], [BOX, ["BUDI", "x"]]]], [("NAMA", 0.9, True), ("BUDI", 0.0, True)]),
    "mixed and deep": ({"a": [None, {"b": [[{"rec_texts": ["X"]}]]}, [[BOX, ["Y", 1]]]], "c": {"rec_texts": []}}, [("X", 0.0, False), ("Y", 1.0, True)]),
    "order": ([{"texts": ["1"]}, [{"texts": ["2"]}, {"z": {"texts": ["3"]}}], {"texts": ["4"]}], [(str(i), 0.0, False) for i in range(1, 5)]),
    "nothing": ({"a": 1, "b": [], "c": "text", "rec_texts": None}, []),
    "scalar": (5, []),
}
ROWS = {
    "threes": ([[BOX, "NAMA", 0.9], [BOX, "", 0.9]], [("NAMA", 0.9, True)]),
    "twos": ([["NAMA", "0.7"], ["B"], "x"], [("NAMA", 0.7, False)]),
    "object": ({"txts": ["A", None, "B"], "scores": [0.5], "boxes": [BOX]}, [("A", 0.5, True), ("B", 0.0, False)]),
    "scalar": ("x", []),
}


@pytest.mark.parametrize("shape, cases", [("nested", NESTED), ("rows", ROWS)])
def test_shapes(spark, shape, cases):
    rows = [(k, json.dumps(v[0])) for k, v in cases.items()] + [("null", None), ("cut", '{"a": ['), ("too deep", "[" * 100_000)]
    read = ocr_output.read_output(spark.createDataFrame(rows, "name string, output string").withColumn("tokens_of", F.lit(1)), shape=shape)
    got = {r["name"]: r for r in read.collect()}
    for name, (_, want) in cases.items():
        assert [(t["text"], t["confidence"], t["bbox"] is not None) for t in got[name]["tokens"]] == want, name
        assert got[name]["raw_text"] == "\n".join(w[0] for w in want) and got[name]["error"] is None
    assert (got["null"]["tokens"], got["null"]["error"]) == ([], None)
    assert got["cut"]["error"] == got["too deep"]["error"] == "not_json" and got["cut"]["raw_text"] == ""
    assert read.limit(0).count() == 0


def test_boxes_stay_json(spark):
    df = spark.createDataFrame([(json.dumps([{"texts": ["A"], "boxes": [BOX]}]),)], "output string")
    assert json.loads(ocr_output.read_output(df).first()["tokens"][0]["bbox"]) == BOX


NAMES = {"KTP": ["nik", "nama"], "STNK": ["nomor_polisi", "merek"]}


def reply(**parts):
    return json.dumps(parts)


REPLIES = {
    "object": (reply(fields={"nik": {"value": "32", "status": "Detected", "confidence": 0.7, "evidence": ["a", 1], "raw": "r"}}), (None, "KTP", {"nik": ("32", 0.7, "ok", ["a", "1"], "r"), "nama": (None, 0.0, "missing", [], None)}, [])),
    "bare values": (reply(fields={"nik": 32, "nama": False}), (None, "KTP", {"nik": ("32", 0.85, "ok", ["32"], None), "nama": (None, 0.0, "missing", [], None)}, [])),
    "states": (reply(fields={"nik": {"value": "1", "status": "Not Found"}, "nama": {"value": "", "status": "ok", "evidence": None}}), (None, "KTP", {"nik": ("1", 0.85, "missing", [], None), "nama": ("", 0.0, "missing", [], None)}, [])),
    "own state": (reply(fields={"nik": {"value": "1", "status": "blurred", "evidence": "x"}}), (None, "KTP", {"nik": ("1", 0.85, "blurred", ["x"], None), "nama": (None, 0.0, "missing", [], None)}, [])),
    "plate": (reply(document_type="stnk", fields={"nomor_polisi": "b-1234-xyz", "other": 1}), (None, "STNK", {"nomor_polisi": ("B 1234 XYZ", 0.85, "ok", ["b-1234-xyz"], None), "merek": (None, 0.0, "missing", [], None)}, [])),
    "bad plate": (reply(document_type="STNK", fields={"nomor_polisi": "??"}, warnings=["invalid:nomor_polisi", "quality:low", "hm"]), (None, "STNK", {"nomor_polisi": ("??", 0.35, "invalid", ["??"], None), "merek": (None, 0.0, "missing", [], None)}, ["invalid:nomor_polisi", "quality:low"])),
    "no fields": (reply(fields={}, warnings=[" blur_detected "]), (None, "KTP", {"nik": (None, 0.0, "missing", [], None), "nama": (None, 0.0, "missing", [], None)}, ["blur_detected"])),
    "fenced": ('Sure:\n```json\n{"fields": {"nik": "7"}}\n```', ("not_json", None, None, None)),
    "list": ("[1]", ("not_object", None, None, None)),
    "text": ('"x"', ("not_object", None, None, None)),
    "cut": ('{"fields": ', ("not_json", None, None, None)),
    "null": (None, ("not_json", None, None, None)),
    "type": (reply(document_type="SIM"), ("unknown_type", None, None, None)),
    "fields": (reply(fields=["nik"]), ("fields_not_object", None, None, None)),
    "confidence": (reply(fields={"nik": {"value": "1", "confidence": "high"}}), ("bad_confidence", None, None, None)),
}


def test_replies(spark):
    rows = spark.createDataFrame([(k, v[0], "AUTO") for k, v in REPLIES.items()], "name string, reply string, requested_type string")
    for r in agent_reply.read_replies(rows, NAMES).collect():
        fields = r["fields"] and {k: tuple(f) for k, f in r["fields"].items()}
        assert (r["error"], r["document_type"], fields, r["warnings"]) == REPLIES[r["name"]][1], r["name"]


def test_rescue(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'x ```json\n{"a": 1}\n``` y': '{"a": 1}', 'so {"a": {"b": 2}} it is': '{"a": {"b": 2}}', "none": "none", "{broken": "{broken"}
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    assert {r["reply"]: r["got"] for r in df.select("reply", agent_reply.rescued(F.col("reply")).alias("got")).collect()} == cases
