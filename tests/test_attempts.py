"""Rules of attempts on rows that the tables do not hold."""

from pyspark.sql import functions as F

from lontar.plans import attempts
from lontar.plans.fields import FIELD_TYPE

REQUESTS = "id int, requested_type string, processing_mode string, quality_flags array<string>, force_strategy string"


def test_requests(spark):
    rows = [(0, None, None, None, None), (1, "ktp", "Fast", ["blur_detected"], None), (2, "AUTO", "fast", ["blur_detected"], None), (3, "STNK", "accurate", ["document_too_small"], None), (4, "KTP", "slow", [None], None), (5, "STNK", "fast", [], "stnk_full_page")]
    got = {r["id"]: (r["mode"], r["rejected"], r["strategy"], r["max_side"]) for r in attempts.plan_requests(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert got == {
        0: ("accurate", False, "full_page", 1280), 1: ("fast", True, None, None), 2: ("fast", False, "full_page", 1280), 3: ("accurate", False, "stnk_official_roi", 1200),
        4: (None, False, "full_page", 1280), 5: ("fast", False, "stnk_full_page", 1600),
    }


def test_what_follows(spark):
    ok, gone = (("x", 0.9, s, [], None) for s in ("ok", "invalid"))
    kind = f"id int, requested_type string, mode string, force_strategy string, document_type string, decision string, reason_codes array<string>, fields map<string,{FIELD_TYPE}>, n_tokens int"
    rows = [
        (0, "STNK", "accurate", None, "STNK", None, None, {"nomor_mesin": gone}, 0),
        (1, "STNK", "accurate", None, "STNK", None, ["screen_or_desktop_capture"], {"nomor_mesin": gone}, 9),
        (2, "STNK", "accurate", None, "STNK", None, [], {"nomor_mesin": ok, "merek": gone}, 9),
        (3, "STNK", "accurate", "x", "STNK", None, [], {"nomor_mesin": gone}, 9),
        (4, "KTP", "fast", None, "KTP", "needs_review", ["ktp_nik_ttl_mismatch"], {}, 1),
        (5, "KTP", "fast", None, "KTP", "needs_review", ["ktp_nik_ttl_mismatch"], None, 0),
        (6, "KTP", "accurate", None, "KTP", "needs_review", ["ktp_nik_ttl_mismatch"], {}, 1),
        (7, "KTP", "fast", None, "KTP", "needs_review", [None, "other"], {}, 1),
        (8, "KTP", "fast", None, "KTP", "approved_for_auto", ["ktp_nik_ttl_mismatch"], {}, 1),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r["id"]: r["x"] and tuple(r["x"]) for r in df.select("id", attempts.next_attempt({c: F.col(c) for c in df.columns}).alias("x")).collect()}
    assert got == {0: ("stnk_full_page", 1600), 4: ("full_page", 1280)} | dict.fromkeys((1, 2, 3, 5, 6, 7, 8))


def test_selection(spark):
    kind = "doc_id string, attempt_index int, max_side int, requested_type string, document_type string, detected_type string, decision string, n_tokens int, strategy string, warnings array<string>, score double"
    at = lambda d, i, score, tokens=3, kind="KTP", seen="KTP", decision="needs_review", ask=None: (d, i, 10 * i, ask, kind, seen, decision, tokens, "s", ["w"], score)
    rows = [at("a", 0, 1.0), at("a", 1, 2.0), at("a", 2, 2.0), at("b", 0, None), at("b", 1, -5.0, tokens=0), at("c", 0, 1.0, seen="UNKNOWN", decision="rejected_input"), at("d", 0, 1.0, kind="STNK"), at("e", 0, 1.0, ask="STNK"), at(None, 0, 1.0), at(None, 1, 0.0, tokens=None)]
    df = spark.createDataFrame(rows, kind)
    got = {r["doc_id"]: (r["attempt_index"], r["retry_count"], r["id_scan"], [x["attempt_index"] for x in r["attempts"]]) for r in attempts.select_attempts(df).collect()}
    assert got == {"a": (1, 2, True, [0, 1, 2]), "b": (1, 1, False, [0, 1]), "c": (0, 0, False, [0]), "d": (0, 0, False, [0]), "e": (0, 0, False, [0]), None: (0, 1, True, [0, 1])}
    assert attempts.select_attempts(df.limit(0)).count() == 0
