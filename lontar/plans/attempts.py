"""Attempts at reading a document: how the first one is made, whether another follows, which one is kept.

Rules of one attempt are expressions over its row; a document's attempts, a few
rows, meet in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.operators.assess import FIXED_TYPES, STNK_REQUIRED

FAST, ACCURATE = "fast", "accurate"
#: Longest sides of prepared images by strategy, of cards by mode, and of everything else.
SIDES = {"ktp_fast": 496, "stnk_fast_roi": 720, "stnk_official_roi": 1200, "stnk_full_page": 1600}
CARD_FAST_SIDE, CARD_RETRY_SIDE, VEHICLE_SIDE, DEFAULT_SIDE = 496, 1280, 1200, 1280
#: Flags that end a fast request before it is read, and reasons for reading a card's full page.
HOPELESS = ("document_too_small", "blur_detected")
CARD_RETRY = (
    "missing_required:nama", "ktp_auto_missing:nama", "ktp_auto_missing:berlaku_hingga", "ktp_auto_missing:kecamatan", "ktp_auto_missing:kelurahan_desa",
    "ktp_auto_missing:alamat", "ktp_auto_low_confidence:nama", "ktp_suspicious_field:tempat_tanggal_lahir", "ktp_nik_ttl_mismatch",
)
NO_VEHICLE_RETRY = ("document_type_mismatch", "screen_or_desktop_capture")


def requested(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit("AUTO")))


def mode_of(mode: Column) -> Column:
    """fast or accurate, which nothing stands for; null where it is neither."""
    lower = F.lower(F.coalesce(F.nullif(mode, F.lit("")), F.lit(ACCURATE)))
    return F.when(lower.isin(FAST, ACCURATE), lower)


def rejected_before_reading(kind: Column, mode: Column, flags: Column) -> Column:
    """Whether a fast request of a known type is not worth reading."""
    hopeless = F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, HOPELESS)))
    return requested(kind).isin(*FIXED_TYPES) & (F.coalesce(mode, F.lit("")) == FAST) & F.coalesce(hopeless, F.lit(False))


def first_strategy(kind: Column, mode: Column) -> Column:
    k = requested(kind)
    fast = F.coalesce(mode == FAST, F.lit(False))
    return F.when((k == "KTP") & fast, "ktp_fast").when((k == "STNK") & fast, "stnk_fast_roi").when(k == "STNK", "stnk_official_roi").otherwise("full_page")


def first_side(kind: Column, mode: Column, strategy: Column) -> Column:
    """Longest side of the image of the first attempt; a forced strategy has its own."""
    k = requested(kind)
    own = F.when(strategy == "stnk_official_roi", SIDES["stnk_official_roi"]).when(strategy == "stnk_fast_roi", SIDES["stnk_fast_roi"])
    own = own.when((k == "KTP") & F.coalesce(mode == FAST, F.lit(False)), CARD_FAST_SIDE).when(strategy == "stnk_full_page", SIDES["stnk_full_page"])
    return own.when(k == "STNK", VEHICLE_SIDE).otherwise(DEFAULT_SIDE)


def plan_requests(requests: DataFrame) -> DataFrame:
    """Add mode, rejected, strategy and max_side to requests (requested_type, processing_mode, quality_flags, force_strategy); a rejected one has no strategy."""
    kind, mode = F.col("requested_type"), F.col("mode")
    rows = requests.withColumn("mode", mode_of(F.col("processing_mode")))
    rows = rows.withColumn("rejected", rejected_before_reading(kind, mode, F.col("quality_flags")))
    rows = rows.withColumn("strategy", F.when(~F.col("rejected"), F.coalesce("force_strategy", first_strategy(kind, mode))))
    return rows.withColumn("max_side", F.when(~F.col("rejected"), first_side(kind, mode, F.col("strategy"))))


def next_attempt(attempt: dict[str, Column]) -> Column:
    """struct(strategy, max_side) of the attempt that follows a first one; null where none does.

    `attempt` has requested_type, mode, force_strategy, document_type, decision,
    reason_codes, fields (a map of structs) and n_tokens.
    """
    kind, codes = requested(attempt["requested_type"]), F.coalesce(attempt["reason_codes"], F.array().cast("array<string>"))
    approved = F.coalesce(attempt["decision"] == "approved_for_auto", F.lit(False))
    gone = [F.coalesce(F.try_element_at(attempt["fields"], F.lit(n))["status"].isin("missing", "invalid"), F.lit(False)) for n in STNK_REQUIRED]
    lacks = F.exists(F.array(*gone), lambda x: x)
    barred = F.arrays_overlap(codes, F.array(*map(F.lit, NO_VEHICLE_RETRY)))
    vehicle = (kind == "STNK") & (attempt["document_type"] == "STNK") & ~F.coalesce(barred, F.lit(False)) & ~approved & lacks
    starts = F.exists(codes, lambda c: F.coalesce(c.rlike("^(?:" + "|".join(CARD_RETRY) + ")"), F.lit(False)))
    card = (kind == "KTP") & (F.coalesce(attempt["n_tokens"], F.lit(0)) > 0) & ~approved & starts
    follows = lambda strategy, side: F.struct(F.lit(strategy).alias("strategy"), F.lit(side).alias("max_side"))
    free = attempt["force_strategy"].isNull()
    return F.when(free & (attempt["mode"] == ACCURATE) & vehicle, follows("stnk_full_page", SIDES["stnk_full_page"])).when(free & (attempt["mode"] == FAST) & card, follows("full_page", CARD_RETRY_SIDE))


def select_attempts(attempts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, attempt_index, max_side, document_type, decision, retry_count, id_scan, attempts) of each document.

    The attempt with the highest score is kept, the earliest among equals (one
    without a score goes last); `id_scan` says whether the id number is to be
    looked for in parts of the image; `attempts` are the summaries in order.
    """
    summary = F.struct("attempt_index", "max_side", "strategy", "document_type", "detected_type", "decision", "warnings")
    # The least struct: highest score, earliest attempt, then whatever is least, so that repeated rows do not matter.
    worst = F.struct(-F.coalesce("score", F.lit(float("-inf"))), "attempt_index", "max_side", "requested_type", "document_type", "detected_type", "decision", "n_tokens")
    grouped = attempts.groupBy(id_col).agg(
        F.min(worst).alias("s"),
        (F.count(F.lit(1)) - 1).cast("int").alias("retry_count"),
        F.array_sort(F.collect_list(summary)).alias("attempts"),
    )
    s = F.col("s")
    unreadable = F.coalesce((s["detected_type"] == "UNKNOWN") & (s["decision"] == "rejected_input"), F.lit(False))
    id_scan = (F.coalesce(s["n_tokens"], F.lit(0)) > 0) & ~unreadable & (F.upper(s["document_type"]) == "KTP") & requested(s["requested_type"]).isin("AUTO", "KTP")
    return grouped.select(id_col, "s.attempt_index", "s.max_side", "s.document_type", "s.decision", "retry_count", F.coalesce(id_scan, F.lit(False)).alias("id_scan"), "attempts")
