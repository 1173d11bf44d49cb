"""Positioned tokens: normalised centres, layout lines and position-aware repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.functions import text as T

#: Distance within which tokens share a line and labels are near, and the bands of the two repairs.
LINE_GAP, NEAR = 0.035, 0.08
STATUS_BAND, CITIZEN_BAND = (0.50, 0.82), (0.66, 1.0)
STATUS_CONFIDENCE, CITIZEN_CONFIDENCE = 0.78, 0.88


def box_center(bbox: Column) -> tuple[Column, Column]:
    """Mean x and y of a polygon, an array of points."""
    mean = lambda k: F.aggregate(bbox, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(k))) / F.size(bbox)
    return mean(0), mean(1)


def minmax(value: str, key: str) -> Column:
    """Value scaled to 0..1 over its group; 0 where all are equal."""
    w = W.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)


def positioned(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Tokens with a box, with x and y from 0 to 1 over their document."""
    x, y = box_center(F.col("bbox"))
    centred = tokens.where(F.size("bbox") > 0).withColumns({"cx": x, "cy": y})
    return centred.withColumns({"x": minmax("cx", id_col), "y": minmax("cy", id_col)}).drop("cx", "cy")


def layout_lines(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, y, tokens, line): tokens by rising y join the first line whose mean y is within LINE_GAP.

    The clustering depends on order, so it runs as a fold over the document's sorted tokens.  As y rises, a line that
    is out of reach stays so: only the last line can take a token, and lines are runs of the sorted tokens.  The fold
    holds their means and lengths, a few tens a document, so it is linear in the tokens.
    """
    sorted_tokens = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    run = lambda s: F.struct(s["y"].alias("y"), s["n"].alias("n"), s["start"].alias("start"))
    closed = F.array().cast("array<struct<y:double,n:int,start:int>>")
    empty = F.struct(F.lit(0.0).alias("y"), F.lit(0).alias("n"), F.lit(1).alias("start"), closed.alias("closed"))

    def place(s: Column, t: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(s["y"] - t["y"]) <= LINE_GAP)
        grown = F.struct(((s["y"] * s["n"] + t["y"]) / (s["n"] + 1)).alias("y"), (s["n"] + 1).alias("n"), s["start"].alias("start"), s["closed"].alias("closed"))
        done = F.when(s["n"] > 0, F.concat(s["closed"], F.array(run(s)))).otherwise(s["closed"])
        return F.when(joins, grown).otherwise(F.struct(t["y"].alias("y"), F.lit(1).alias("n"), (s["start"] + s["n"]).alias("start"), done.alias("closed")))

    sorted_rows = tokens.groupBy(id_col).agg(sorted_tokens.alias("sorted"))
    runs = F.aggregate("sorted", empty, place, lambda s: F.concat(s["closed"], F.array(run(s))))
    cut_out = lambda g: F.struct(g["y"].alias("y"), F.slice("sorted", g["start"], g["n"]).alias("tokens"))
    grouped = sorted_rows.withColumn("runs", runs).select(id_col, F.transform("runs", cut_out).alias("lines"))
    lines = grouped.select(id_col, F.posexplode("lines").alias("line_no", "g"))
    by_x = F.array_sort(F.transform("g.tokens", lambda t: F.struct(t["x"].alias("x"), t["text"].alias("text"))))
    return lines.select(id_col, "line_no", F.col("g.y").alias("y"), by_x.alias("tokens"), F.array_join(F.transform(by_x, lambda t: t["text"]), " ").alias("line"))


def right_of(tokens: Column, label: str) -> Column:
    """Texts of a line's tokens right of its first label token, joined by spaces."""
    at = F.array_position(F.transform(tokens, lambda t: t["text"].rlike(label)), True).cast("int")
    rest = F.slice(tokens, at + 1, F.size(tokens))
    return F.when(at > 0, F.array_join(F.transform(rest, lambda t: t["text"]), " "))


def repairs(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, field, value, confidence) of marital status and citizenship found by position."""
    squeezed = T.letters(F.col("line"))
    status = lines.where(F.col("y").between(*STATUS_BAND) & squeezed.rlike("STATUS|PERKAW")).withColumn("value", T.marital_status(F.col("line")))
    first = lambda df: df.where("value IS NOT NULL").groupBy(id_col).agg(F.min_by("value", F.struct("y", "line_no")).alias("value"))
    labels = lines.where(squeezed.rlike("K[EO]?[WV]A?RGA?")).select(F.col(id_col).alias("doc"), F.col("y").alias("label_y"))
    value = lines.withColumn("value", T.citizenship(F.regexp_extract(F.upper("line"), r"\b([WVY]N[IA1L])\b", 1))).where(F.col("y").between(*CITIZEN_BAND))
    near = value.join(labels, (F.col(id_col) == F.col("doc")) & (F.abs(F.col("y") - F.col("label_y")) <= NEAR), "left_semi")
    out = lambda df, name, c: first(df).select(id_col, F.lit(name).alias("field"), "value", F.lit(c).alias("confidence"))
    return out(status, "status_perkawinan", STATUS_CONFIDENCE).unionByName(out(near, "kewarganegaraan", CITIZEN_CONFIDENCE))
