"""Summary of evaluation records: counters, field by status, exact percentiles, slowest records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.operators.lineage import written

#: Name, column and whether the column is an array whose elements count, of each counter.
COUNTERS = (
    ("document_types", F.coalesce, "document_type", "UNKNOWN"),
    ("statuses", F.coalesce, "status", "unknown"),
    ("decisions", F.coalesce, "input_assessment.decision", "unknown"),
    ("stnk_usage_classes", None, "stnk_usage_class", None),
    ("reason_codes", F.explode, "input_assessment.reason_codes", None),
    ("warnings", F.explode, "warnings", None),
    ("quality_flags", F.explode, "quality.flags", None),
    ("stnk_usage_reasons", F.explode, "stnk_usage_reasons", None),
)
#: Name and column of each series; the second group holds one value an attempt.
SERIES = {
    "processing_time_ms": "processing_time_ms",
    "stnk_structure_score": "stnk_structure_score",
    "ocr_tokens": "ocr.token_count",
    "ocr_retry_count": "ocr.preprocess.retry_count",
    "selected_max_side": "ocr.preprocess.selected_max_side",
    "quality_score": "quality.metrics.overall_score",
    "pipeline_total": "ocr.timings.total_ms",
    "nik_fallback": "ocr.timings.nik_fallback_ms",
}
ATTEMPT_SERIES = {"prepare": "prepare_ms", "ocr": "ocr_ms", "parse": "parse_ms", "quality": "quality_ms", "assessment": "assessment_ms", "attempt_total": "total_ms"}
POINTS = (0.5, 0.95, 0.99)


def _counted(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("counter"), v.alias("value"))


def counters(records: DataFrame) -> DataFrame:
    """(counter, value, n) of all counters in one pass: each record gives one row a counted value."""
    lists = []
    for name, kind, column, other in COUNTERS:
        c = F.col(column)
        values = F.coalesce(c, F.array().cast("array<string>")) if kind is F.explode else F.array(F.coalesce(c, F.lit(other)) if other else c)
        lists.append(F.transform(F.filter(values, lambda v: v.isNotNull()), _counted(name)))
    publish = F.array(F.struct(F.lit("auto_publish").alias("counter"), F.coalesce("input_assessment.can_auto_publish", F.lit(False)).cast("string").alias("value")))
    return records.select(F.explode(F.concat(*lists, publish)).alias("c")).groupBy("c.counter", "c.value").agg(F.count(F.lit(1)).alias("n"))


def field_status(records: DataFrame) -> DataFrame:
    """(field, status, n)."""
    rows = records.select(F.explode("fields").alias("field", "result"))
    return rows.groupBy("field", F.coalesce("result.status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, value: str, by: list[str], points: tuple[float, ...] = POINTS) -> DataFrame:
    """(*by, points): linearly interpolated percentiles of a column for each group, exact for any number of values.

    Equal values are counted first.  Distinct ones are dealt by ranges of group
    and value, so a group of any size is spread over tasks: the numbers below a
    range are sums over ranges, the places inside it a window over one range.
    Nulls are left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_here"))
    group = W.partitionBy(*by)
    below = F.sum("_here").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumns({"_below": F.coalesce(below, F.lit(0)), "_all": F.sum("_here").over(group)}).drop("_here")
    upto = F.col("_below") + F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_v"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_part")]
    placed = ranged.alias("a").join(starts.alias("b"), reduce(and_, same)).select("a.*", "_below", "_all").withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), F.col("_v")))

    made = {}
    for i, p in enumerate(points):
        place = (F.col("_all") - 1) * F.lit(p)
        made |= {f"_l{i}": at(F.floor(place)), f"_h{i}": at(F.ceil(place)), f"_p{i}": F.max(place - F.floor(place))}
    # As the interpolation of the percentile function: parts of both neighbours, the value itself where they are equal.
    part = lambda i: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}").cast("double")).otherwise((1 - F.col(f"_p{i}")) * F.col(f"_l{i}") + F.col(f"_p{i}") * F.col(f"_h{i}"))
    found = placed.groupBy(*by).agg(*(c.alias(n) for n, c in made.items()))
    return found.select(*by, F.array(*(part(i) for i in range(len(points)))).alias("points"))


def number_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, min, max, avg and linearly interpolated percentiles of a column, for each group; nulls are left out."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = rows.alias("a").join(percentiles(df, value, by).alias("b"), reduce(and_, same)) if by else rows.crossJoin(percentiles(df, value, by))
    own = [F.col(f"a.{c}") if by else F.col(c) for c in (*by, "count", "min", "max")]
    return both.select(*own, F.bround("avg", 2).alias("avg"), *(F.bround(F.get("points", F.lit(i)), 2).alias(f"p{int(p * 100)}") for i, p in enumerate(POINTS)))


def series(records: DataFrame) -> DataFrame:
    """(series, count, min, max, avg, p50, p95, p99) of every series."""
    pair = lambda name, c: F.struct(F.lit(name).alias("series"), c.cast("double").alias("value"))
    own = F.array(*(pair(n, F.col(c)) for n, c in SERIES.items()))
    tries = F.coalesce("ocr.timings.attempts", F.array().cast("array<struct<prepare_ms:double,ocr_ms:double,parse_ms:double,quality_ms:double,assessment_ms:double,total_ms:double>>"))
    each = F.flatten(F.transform(tries, lambda a: F.array(*(pair(n, a[c]) for n, c in ATTEMPT_SERIES.items()))))
    return number_summary(records.select(F.explode(F.concat(own, each)).alias("s")).select("s.*"), "value", ["series"])


def slowest(records: DataFrame, limit: int = 5) -> DataFrame:
    """The slowest records, ties by file name."""
    a = F.col("ocr.timings.attempts")
    total = F.bround(F.aggregate(F.coalesce(a["ocr_ms"], F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))), 2)
    none = F.array().cast("array<string>")
    rows = records.where("processing_time_ms IS NOT NULL").orderBy(F.col("processing_time_ms").desc(), "file").limit(limit)
    return rows.select(
        "file",
        "document_type",
        "processing_time_ms",
        F.col("input_assessment.decision").alias("decision"),
        F.coalesce("input_assessment.reason_codes", none).alias("reason_codes"),
        F.coalesce("quality.flags", none).alias("quality_flags"),
        F.col("ocr.preprocess.retry_count").alias("retry_count"),
        F.col("ocr.preprocess.selected_max_side").alias("selected_max_side"),
        F.col("ocr.timings.total_ms").alias("pipeline_total_ms"),
        total.alias("ocr_ms_total"),
        F.col("ocr.timings.nik_fallback_ms").alias("nik_fallback_ms"),
    )



def summarize(records: DataFrame) -> DataFrame:
    """One row: total and the summaries above as maps and arrays; each part is aggregated first, so parts are small."""
    total = records.agg(F.count(F.lit(1)).alias("total"))
    counted = counters(records).groupBy("counter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("values"))
    counted = counted.agg(F.map_from_entries(F.collect_list(F.struct("counter", "values"))).alias("counters"))
    matrix = field_status(records).groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by"))
    matrix = matrix.agg(F.map_from_entries(F.collect_list(F.struct("field", "by"))).alias("field_status"))
    numbers = series(records).agg(F.array_sort(F.collect_list(F.struct("series", "count", "min", "max", "avg", "p50", "p95", "p99"))).alias("series"))
    slow = slowest(records).agg(F.sort_array(F.collect_list(F.struct("processing_time_ms", "file", "decision", "ocr_ms_total")), asc=False).alias("slowest_records"))
    return total.crossJoin(counted).crossJoin(matrix).crossJoin(numbers).crossJoin(slow)
