"""Mixing sources to target weights over a domain - language - source tree.

A token budget is passed down the tree.  At each node it is divided among the
children by weight; a child takes no more than its subtree holds (tokens times
the largest number of epochs), and what it cannot take goes to its siblings by
weight.  Only when all children of a node are full does less reach the node at
all, because the node's own share was capped in the same way: shortages go to
siblings before ancestors.  A leaf with budget b and t tokens takes b div t
whole epochs and, of the next epoch in its seeded order, the longest prefix
that fits.

DataFrame functions only.  Documents are summed to leaves, leaves to nodes; the
prefix is found over the sums of hash buckets of a leaf and then within the one
bucket where it ends, so a leaf with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.llm.shared import cut

LEVELS = ("domain", "lang", "source")
#: Name of a missing label.
NONE = "(none)"
#: Hexadecimal digits of the order key that name a bucket.
BUCKET_DIGITS = 3
#: Leaves that are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"

#: Domain of each source, and the weights of the nodes.
DOMAINS = {
    "web": ("src0", "src1", "src2", "src3", "src4", "src5"),
    "books": ("src6", "src7", "src8", "src9", "src10"),
    "reference": ("src11", "src12", "src13", "src14", "src15"),
}
OTHER_DOMAIN = "other"
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "reference": 1, "other": 1},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}
#: Share of all tokens that is asked for, in percent; epochs of a leaf at most; seed of the order.
PRODUCTION = {"weights": WEIGHTS, "budget_percent": 60, "max_epochs": 2, "seed": 7}


def domain_of(source: Column, domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """Domain of a source."""
    named = F.lit(OTHER_DOMAIN)
    for name, sources in reversed(domains.items()):
        named = F.when(source.isin(*sources), name).otherwise(named)
    return named


def default_labels() -> dict[str, Column]:
    """Levels of the tree and where a row of `documents` stands in it."""
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    listed = weights.get(level, {})
    chosen = F.lit(1)
    for name, w in listed.items():
        chosen = F.when(F.col(level) == name, w).otherwise(chosen)
    return chosen.cast("long")


def divide(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Divide `budget` of each parent among rows (parent, child, capacity, weight); adds `share`.

    Children are taken in the order of capacity per weight: those whose whole
    capacity is below their part of what is left are full; the rest divide what
    the full ones leave.  Whole tokens only; roundings stay unspent.
    """
    group = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    # Order by the ratio, children without weight last.
    ratio = F.when(F.col("weight") == 0, F.lit(1e300)).otherwise(F.col("capacity").cast("double") / F.col("weight"))
    before = group.orderBy(ratio, child).rowsBetween(W.unboundedPreceding, -1)
    onward = group.orderBy(ratio, child).rowsBetween(0, W.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = (F.col("weight") > 0) & (F.col("capacity") * F.sum("weight").over(onward) <= left * F.col("weight"))
    marked = children.withColumn("full", full)
    return (
        marked.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(group))
        .withColumn("share", F.when(F.col("full"), F.col("capacity")).when(F.col("rest_weight") > 0, F.expr("rest * weight div rest_weight")).otherwise(0))
        .drop("full", "rest", "rest_weight")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Token budget of every leaf; `leaves` has the levels, `tokens` and `capacity`."""
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if above is None:
            nodes = nodes.withColumn("budget", F.least(budget, F.sum("capacity").over(W.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(above, path[:-1])
        above = divide(nodes, path[:-1], level).select(*path, F.col("share").alias("budget"), *(["tokens"] if depth == len(levels) - 1 else []))
    return above


def _with_leaf(df: DataFrame, leaves: DataFrame, few: bool, levels: tuple[str, ...]) -> DataFrame:
    return df.join(F.broadcast(leaves) if few else leaves, list(levels))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int, max_epochs: int, seed: int, labels: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen rows: (row, at, n_tokens, copies).

    `row` is a struct of the columns of `docs`, whatever they are called; `at` a
    struct of the row's labels; `copies` the number of epochs that hold the row.
    Tokens are words.  A missing label is a leaf of its own; null and empty texts
    have no tokens.  Rows of a leaf with the same id are taken or left together;
    rows with a null id form one such group.  A leaf without tokens gives its
    rows once if it has any budget or weight at all.  Texts of any length count
    whole.  An empty table gives none.
    """
    labels = labels or default_labels()
    levels = tuple(labels)
    shown = F.struct(*(c.cast("string").alias(level) for level, c in labels.items())).alias("at")
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(level) for level, c in labels.items()]
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = cut(docs.select(*named, name.alias("name"), count.alias("n")))
    leaves = rows.groupBy(*levels).agg(F.sum("n").alias("tokens")).withColumn("capacity", F.col("tokens") * max_epochs)
    asked = rows.agg(F.expr(f"coalesce(sum(n), 0) * {budget_percent} div 100").alias("asked")).first()["asked"]
    shares = budgets(leaves, weights, F.lit(int(asked)), levels)
    # Whole epochs, and what is left for the next one.
    epochs = cut(
        shares.withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 1 END"))
        .withColumn("rest", F.expr("CASE WHEN tokens > 0 THEN budget - epochs * tokens ELSE 0 END"))
        .select(*levels, "epochs", "rest")
    )
    few = epochs.count() <= BROADCAST_LEAVES
    keyed = _with_leaf(rows, epochs, few, levels).where("rest > 0").select(*levels, "n", "rest", order_key(seed).alias("key"))
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sums = keyed.groupBy(*levels, bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("key").alias("last"))
    run = W.partitionBy(*levels).orderBy("bucket")
    sums = cut(sums.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n")))
    whole = sums.where("upto <= rest").groupBy(*levels).agg(F.max("last").alias("last"))
    ends = sums.where("before <= rest AND upto > rest").select(*levels, "bucket", "before")
    inside = keyed.withColumn("bucket", bucket).join(F.broadcast(ends) if few else ends, [*levels, "bucket"])
    # Rows with equal keys count together, and are summed before they meet: null ids may be many.
    inside = inside.groupBy(*levels, "key", "before").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*levels).orderBy("key"))
    part = inside.withColumn("upto", upto).where("upto <= rest").groupBy(*levels).agg(F.max("key").alias("last"))
    cutoffs = whole.unionByName(part).groupBy(*levels).agg(F.max("last").alias("last"))
    chosen = cut(epochs.join(cutoffs, list(levels), "left").where("epochs > 0 OR last IS NOT NULL"))
    tree = chosen.select(F.struct(*levels).alias("leaf"), "epochs", "last")
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), shown, F.struct(*named).alias("leaf"), name.alias("name"), count.alias("n_tokens"))
    copies = F.col("epochs") + F.when(order_key(seed) <= F.col("last"), 1).otherwise(0)
    placed = out.join(F.broadcast(tree) if few else tree, "leaf").withColumn("copies", copies.cast("int"))
    return placed.where("copies > 0").select("row", "at", "n_tokens", "copies")


def order_key(seed: int, epochs: str = "epochs", name: str = "name") -> Column:
    """Place of a row in its leaf's seeded order of the epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epochs).cast("string"), F.col(name)))
