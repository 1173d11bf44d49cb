"""Registered queries of the document and record operators, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators import agent_reply, assess, fuzzy, label_window, layout, lookup, ocr_output, summary
from lontar.operators import layout_repair as by_layout
from lontar.plans import attempts, documents, identity_card, vehicle_registration
from lontar.sources.tables import read_table, spread
from lontar.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-01-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Text ---------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(text, '\b(\d{6})\d{6}(\d{4})\b', '\1******\2', 'g') AS masked FROM documents WHERE regexp_matches(text, '\b\d{16}\b')")
def mask_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\b\d{16}\b"))
    return docs.select("doc_id", T.mask_ids(F.col("text")).alias("masked"))


@query(r"""
WITH found AS (SELECT doc_id, source, unnest(list_filter(regexp_extract_all(text, '\d+'), lambda x: length(x) = 16)) AS id_number FROM documents)
SELECT source, count(*) AS n_ids, count(DISTINCT id_number) AS n_distinct, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY source
""")
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: ids standing in texts, by source."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", "source", F.explode(T.id_numbers_in(F.col("text"))).alias("id_number"))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_ids"), F.countDistinct("id_number").alias("n_distinct"), F.countDistinct("doc_id").alias("n_docs"))


@query(r"SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '\d+'), lambda x: length(x) = 16)) AS id_number FROM documents")
def find_16_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(T.id_numbers_in(F.col("text"))).alias("id_number"))


@query(r"""
WITH t AS (SELECT o_orderkey AS doc_id, 'seen b ' || CAST(o_orderkey % 5000 AS VARCHAR) || ' ' || substr('xyzab', 1 + CAST(o_orderkey % 4 AS INTEGER), 2) || ' and z-' || CAST(o_custkey % 700 AS VARCHAR) || '-q' AS text FROM orders),
f AS (SELECT doc_id, unnest(regexp_extract_all(upper(text), '\b([A-Z]{1,2}[ .\-]?\d{1,4}[ .\-]?[A-Z]{1,3})\b', 1)) AS plate FROM t),
b AS (SELECT doc_id, plate, regexp_replace(plate, '[ .\-]', '', 'g') AS bare FROM f)
SELECT doc_id, plate, regexp_replace(bare, '^([A-Z]+)(\d+)([A-Z]+)$', '\1 \2 \3') AS normal FROM b WHERE CAST(regexp_extract(bare, '\d+') AS INTEGER) > 0
""")
def plate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates in any spelling, in texts made of orders."""
    key = F.col("o_orderkey")
    middle = F.substr(F.lit("xyzab"), (1 + key % 4).cast("int"), F.lit(2))
    text = F.concat(F.lit("seen b "), (key % 5000).cast("string"), F.lit(" "), middle, F.lit(" and z-"), (F.col("o_custkey") % 700).cast("string"), F.lit("-q"))
    rows = read_table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.explode(T.plates_in(text)).alias("plate"))
    return rows.withColumn("normal", T.plate_number(F.col("plate"))).where("normal IS NOT NULL")


@query(r"""
WITH f AS (SELECT event_id, ts FROM events), d AS (SELECT event_id, strftime(ts, '%d-%m-%Y') AS text FROM f)
SELECT event_id, text, CAST(substr(text, 1, 2) AS INTEGER) AS day, CAST(substr(text, 4, 2) AS INTEGER) AS month, CAST(substr(text, 7, 4) AS INTEGER) AS year,
       strftime(strptime(text, '%d-%m-%Y'), '%Y-%m-%d') AS iso FROM d
""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd-MM-yyyy").alias("text"))
    part = lambda k: F.regexp_extract("text", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", k).cast("int")
    return rows.select("event_id", "text", part(1).alias("day"), part(2).alias("month"), part(3).alias("year"), T.iso_date(F.col("text")).alias("iso"))


@query(rf"""
WITH f AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '\d+'), lambda x: length(x) = 16)) AS id FROM documents),
p AS (SELECT *, CAST(substr(id, 7, 2) AS INTEGER) AS d, CAST(substr(id, 9, 2) AS INTEGER) AS m, CAST(substr(id, 11, 2) AS INTEGER) AS y FROM f),
q AS (SELECT *, CASE WHEN d > 40 THEN d - 40 ELSE d END AS day, CASE WHEN y <= CAST('{AS_OF[2:4]}' AS INTEGER) THEN 2000 + y ELSE 1900 + y END AS year FROM p)
SELECT doc_id, id AS id_number, CASE WHEN day BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 THEN printf('%02d-%02d-%04d', day, m, year) END AS born,
       CASE WHEN d > 40 THEN 'PEREMPUAN' ELSE 'LAKI-LAKI' END AS gender FROM q
""")
def id_birth_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(T.id_numbers_in(F.col("text"))).alias("id_number"))
    day = F.lit(AS_OF).cast("date")
    return rows.withColumns({"born": T.birth_date_of_id(F.col("id_number"), day), "gender": T.gender_of_id(F.col("id_number"))})


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS raw FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(raw, '[ \t\n\f\r\x0B]+', ' ', 'g'), ' :;') AS line FROM l)
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(length(line))::INTEGER AS longest FROM c WHERE line <> '' GROUP BY doc_id
""")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = label_window.explode_lines(read_table(spark, sf_dir, "documents"), T.normalized_lines(F.col("text")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length("line")).alias("longest"))


@query(r"""
WITH l AS (SELECT doc_id, trim(regexp_replace(x.raw, '[ \t\n\f\r\x0B]+', ' ', 'g'), ' :;') AS line, x.i AS i
           FROM (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents) t, LATERAL (SELECT t.z[1] AS raw, t.z[2] AS i) x),
n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no FROM l WHERE line <> ''),
h AS (SELECT doc_id, line_no AS head FROM n WHERE regexp_matches(line, '(?i)(?:^|[^A-Za-z0-9])(?:token)(?:[^A-Za-z0-9]|$)')),
m AS (SELECT n.doc_id, line, head, line_no FROM n JOIN h ON n.doc_id = h.doc_id AND line_no > head AND line_no <= head + 2)
SELECT doc_id, arg_min(trim(line, ' :;'), row(head, line_no)) AS value FROM m GROUP BY doc_id
""")
def label_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational form: first of the two lines behind a label line."""
    lines = label_window.explode_lines(read_table(spark, sf_dir, "documents"), T.normalized_lines(F.col("text")))
    return label_window.capture_relational(lines, ("token",), after=2)


@query(r"""
WITH h AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])(?:Licensed\s*under|Released\s*under)(?:[^A-Za-z0-9]|$)'))
SELECT doc_id, trim(regexp_replace(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(?:Licensed[ ]*under|Released[ ]*under)[ ]*[:-]?[ ]*([^\n]+)', 1), '[ \t]+', ' ', 'g'), ' :;') AS value
FROM h WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])(?:Licensed[ ]*under|Released[ ]*under)[ ]+[A-Za-z]')
""")
def label_capture_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-local form: the rest of the first label line."""
    docs = read_table(spark, sf_dir, "documents")
    found = label_window.capture(T.normalized_lines(F.col("text")), ("Licensed under", "Released under"), after=0)
    return docs.select("doc_id", found["value"].alias("value")).where("value IS NOT NULL")


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(upper(text), 'NO(\.|MOR)?\s*RANGKA|\bSTNK\b') THEN 'STNK'
  WHEN contains(upper(text), 'PROVINSI') OR contains(upper(text), 'KABUPATEN') OR contains(upper(text), 'KECAMATAN') OR contains(upper(text), 'KEL/DESA') THEN 'KTP' ELSE 'UNKNOWN' END AS kind,
  length(regexp_replace(text, '\D', '', 'g'))::INTEGER AS n_digits FROM documents
""")
def doc_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", assess.document_type(F.col("text")).alias("kind"), F.length(T.digits(F.col("text"))).alias("n_digits"))


_MARKED = " + ".join(f"contains(upper(text), '{m}')::INTEGER" for m in assess.SCREEN_MARKERS)


@query(f"SELECT doc_id, ({_MARKED})::INTEGER AS hits, ({_MARKED}) >= 2 AS is_screen FROM documents")
def marker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.count_markers(F.col("text"), assess.SCREEN_MARKERS).alias("hits"), assess.screen_capture(F.col("text")).alias("is_screen"))


@query(r"""
SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations c
WHERE turn >= coalesce((SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'user'), 0) GROUP BY conv_id
""")
def section_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from the last title row of each group on."""
    rows = read_table(spark, sf_dir, "conversations")
    start = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return rows.withColumn("start", F.coalesce(start, F.lit(0))).where("turn >= start").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


@query("""
SELECT conv_id, turn, role, lead(role, 1) OVER w AS next_role, lead(role, 2) OVER w AS third_role, text = lead(text, 1) OVER w AS repeats
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", F.lead("role", 1).over(w).alias("next_role"), F.lead("role", 2).over(w).alias("third_role"), (F.col("text") == F.lead("text", 1).over(w)).alias("repeats"))


@query("""
SELECT conv_id, turn, md5(string_agg(text, chr(10) ORDER BY t)) AS context_md5 FROM (
  SELECT c.conv_id, c.turn, d.turn AS t, d.text FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn BETWEEN c.turn - 3 AND c.turn + 3
) GROUP BY conv_id, turn
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_window.context(read_table(spark, sf_dir, "conversations"), 3, "text", "conv_id", "turn")
    return rows.select("conv_id", "turn", F.md5("context").alias("context_md5"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase
FROM events
""")
def last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return read_table(spark, sf_dir, "events").select("event_id", "user_id", last.alias("last_purchase"))


@query(r"SELECT doc_id, translate(upper(n), 'OILSB', '01158') AS repaired, regexp_matches(translate(upper(n), 'OILSB', '01158'), '^\d{16}$') AS is_id FROM (SELECT doc_id, regexp_extract(text, '\b[0-9OILSB]{16}\b') AS n FROM documents) WHERE n <> ''")
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"\b[0-9OILSB]{16}\b", 0).alias("n")).where("n <> ''")
    return rows.select("doc_id", T.repair_digits(F.col("n")).alias("repaired"), T.repair_digits(F.col("n")).rlike(r"^\d{16}$").alias("is_id"))


# Joins and lookups --------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, n_name, coalesce(r_name, '') AS r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def region_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey, "left")
    return joined.select("s_suppkey", "s_name", "n_name", F.coalesce("r_name", F.lit("")).alias("r_name"))


@query(r"""
WITH w AS (SELECT p_partkey, p_name, unnest(list_distinct(list_filter(regexp_split_to_array(upper(p_name), '[^A-Z0-9]+'), lambda x: length(x) >= 3))) AS word FROM part)
SELECT DISTINCT a.p_partkey AS left_key, b.p_partkey AS right_key FROM w a JOIN w b ON a.word = b.word AND a.p_partkey < b.p_partkey AND levenshtein(upper(a.p_name), upper(b.p_name)) <= 1
""")
def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share a word and are equal up to one edit."""
    part = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    left = part.select(F.col("p_partkey").alias("left_key"), F.col("p_name").alias("left_name"))
    right = part.select(F.col("p_partkey").alias("right_key"), F.col("p_name").alias("right_name"))
    return lookup.fuzzy_token_join(left, right, "left_name", "right_name").where("left_key < right_key").select("left_key", "right_key")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def unmatched_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""
WITH rest AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08 AND l_linenumber = 1))
SELECT s_suppkey, n_nationkey FROM rest, nation WHERE contains(s_name, substr(n_name, 8))
""")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a candidate meet the reference rows whose names stand in theirs."""
    supplier, nation = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    busy = read_table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08 AND l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey"))
    rest = supplier.join(busy, "s_suppkey", "left_anti")
    part = F.substring("n_name", 8, 3)
    held = lookup.containing(rest.select(F.col("s_name").alias("name")).distinct(), nation.select(part.alias("name")).distinct())
    named = held.join(rest, F.col("whole") == F.col("s_name"))
    return named.join(nation, F.col("part") == part).select("s_suppkey", "n_nationkey")


@query("""
SELECT event_id FROM events a WHERE event_type = 'click' AND EXISTS (
  SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000)
""")
def semi_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a label row of the same key within a band."""
    events = read_table(spark, sf_dir, "events").withColumn("us", F.unix_micros("ts"))
    near = events.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("us").alias("at"))
    clicks = events.where("event_type = 'click'")
    return clicks.join(near, (F.col("user_id") == F.col("u")) & (F.abs(F.col("us") - F.col("at")) <= 86_400_000_000), "left_semi").select("event_id")


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, 1 AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_totalprice > 100000)
SELECT o_orderkey, o_custkey, min(src)::INTEGER AS src FROM c GROUP BY ALL
""")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of candidate lists, first list wins."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    tagged = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_totalprice") > 100000, 2).alias("src"))
    return tagged.where("src IS NOT NULL").groupBy("o_orderkey", "o_custkey").agg(F.min("src").alias("src"))


@query("""
WITH s AS (SELECT source, list(DISTINCT lang) AS a FROM documents GROUP BY source),
t AS (SELECT list(DISTINCT d.lang) AS b FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)
SELECT source, array_to_string(list_sort(list_intersect(a, b)), ',') AS langs FROM s, t
""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    own = docs.groupBy("source").agg(F.collect_set("lang").alias("a"))
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").agg(F.collect_set("lang").alias("b"))
    return own.crossJoin(F.broadcast(toxic)).select("source", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("langs"))


# Order, top-k and windows -------------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def topk_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "user_id", "value").orderBy(F.col("value").desc(), "event_id").limit(5)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, length(o_orderpriority), o_orderkey) AS p FROM orders) WHERE p = 1")
def top1_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), F.length("o_orderpriority"), "o_orderkey"))
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


@query("SELECT user_id, arg_min(event_id, row(-value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("""
SELECT vec_id, (CAST(embedding[1] AS DOUBLE) - lo) / (hi - lo) AS x FROM embeddings, (SELECT min(CAST(embedding[1] AS DOUBLE)) AS lo, max(CAST(embedding[1] AS DOUBLE)) AS hi FROM embeddings)
""")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled over the whole table; extremes are one row, joined back, so no window holds all rows."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).select("vec_id", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))


@query("""
SELECT vec_id, (list_sum(list_transform(range(1, len(embedding)), lambda i: abs(CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1000000) AS BIGINT) - CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT)))))::BIGINT AS edge
FROM embeddings
""")
def adjacent_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of absolute differences of neighbours, in millionths."""
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    steps = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.abs(F.get("v", i) - F.get("v", i - 1)))
    return rows.select("vec_id", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("edge"))


# Records ------------------------------------------------------------------------------------------

#: Evaluation records made of documents and labels: one a document.
_RECORDS_SQL = """
WITH d AS (
  SELECT doc_id, n_chars, lang, source, coalesce(quality, -1) AS q, coalesce(toxic, -1) AS t,
    list_filter([CASE WHEN n_chars < 100 THEN 'low_text_density' END, CASE WHEN n_chars > 8000 THEN 'document_too_small' END, CASE WHEN coalesce(toxic, 0) = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS flags
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    rows = docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "low_text_density"), F.when(F.col("n_chars") > 8000, "document_too_small"), F.when(F.col("toxic") == 1, "toxic")))
    return rows.withColumns({"flags": flags, "q": F.coalesce("quality", F.lit(-1)), "t": F.coalesce("toxic", F.lit(-1))})


@query(_RECORDS_SQL + " SELECT doc_id, round(greatest(100 - list_sum(list_concat([0], list_transform(flags, lambda f: CASE f WHEN 'low_text_density' THEN 15 WHEN 'document_too_small' THEN 20 ELSE 10 END))), 0))::INTEGER AS percent FROM d")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.round(assess.quality_score(F.col("flags")) * 100).cast("int").alias("percent"))


@query(_RECORDS_SQL + """
, r AS (SELECT doc_id, list_filter(list_concat([CASE WHEN lang <> 'en' THEN 'document_type_mismatch' END], flags, [CASE WHEN q = 0 THEN 'invalid:quality' END, CASE WHEN q = -1 THEN 'missing_required:quality' END]), lambda x: x IS NOT NULL) AS codes FROM d)
SELECT doc_id, array_to_string(codes, '|') AS reason_codes,
  CASE WHEN list_contains(codes, 'document_type_mismatch') THEN 'rejected_input' WHEN len(codes) > 0 THEN 'needs_review' ELSE 'approved_for_auto' END AS decision FROM r
""")
def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered reason codes and the decision they lead to."""
    none = F.array().cast("array<string>")
    code = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(none)
    codes = F.array_distinct(F.concat(code(F.col("lang") != "en", "document_type_mismatch"), "flags", code(F.col("q") == 0, "invalid:quality"), code(F.col("q") == -1, "missing_required:quality")))
    decision = F.when(F.array_contains("codes", "document_type_mismatch"), "rejected_input").when(F.size("codes") > 0, "needs_review").otherwise("approved_for_auto")
    return records(spark, sf_dir).withColumn("codes", codes).select("doc_id", F.array_join("codes", "|").alias("reason_codes"), decision.alias("decision"))


_AUTO_MISSING = ", ".join(f"CASE WHEN doc_id % {k + 3} = 0 THEN 'stnk_auto_missing:{n}' END" for k, n in enumerate(assess.STNK_REQUIRED))
_MISSING_WARNINGS = ", ".join(f"CASE WHEN doc_id % {k + 3} = 0 AND doc_id % 2 = 0 THEN 'missing_required:{n}' END" for k, n in enumerate(assess.STNK_REQUIRED))


@query(_RECORDS_SQL + f"""
, w AS (SELECT *, list_filter([{_MISSING_WARNINGS}], lambda x: x IS NOT NULL) AS warned, lang <> 'en' AS other FROM d),
c AS (SELECT *, list_filter(list_concat([CASE WHEN lang = 'es' THEN 'document_type_mismatch' END, CASE WHEN lang = 'fr' AND len(warned) > 0 THEN 'document_type_unknown' END, CASE WHEN doc_id % 11 = 0 THEN 'screen_or_desktop_capture' END], flags, warned,
        [CASE WHEN doc_id % 7 = 0 THEN 'ocr_provider_needs_review:rapidocr' END, {_AUTO_MISSING}, CASE WHEN doc_id % 4 <> 0 AND doc_id % 9 = 0 THEN 'stnk_auto_low_confidence:nama_pemilik' END,
         CASE WHEN doc_id % 4 <> 0 AND doc_id % 13 = 0 THEN 'stnk_suspicious_field:nama_pemilik' END]), lambda x: x IS NOT NULL) AS codes FROM w),
e AS (SELECT *, lang = 'es' OR (len(warned) > 0 AND (doc_id % 11 = 0 OR lang = 'fr')) AS rejected,
        len(warned) > 0 OR len(list_filter(codes, lambda x: x IN ('document_too_small', 'low_text_density', 'screen_or_desktop_capture') OR starts_with(x, 'ocr_provider') OR starts_with(x, 'stnk_'))) > 0 AS held FROM c)
SELECT doc_id, array_to_string(codes, '|') AS reason_codes, CASE WHEN rejected THEN 'rejected_input' WHEN held THEN 'needs_review' ELSE 'approved_for_auto' END AS decision, NOT rejected AND NOT held AS can_auto_publish,
  CASE WHEN lang = 'es' THEN 'Dokumen yang diupload terdeteksi KTP, bukan STNK. Mohon upload dokumen yang sesuai.'
       WHEN list_contains(codes, 'document_type_unknown') THEN 'Jenis dokumen tidak bisa dipastikan sebagai STNK. Mohon upload ulang dokumen yang sesuai dan jelas.'
       WHEN doc_id % 11 = 0 AND rejected THEN 'Foto terlihat seperti foto layar atau viewer. Mohon upload foto dokumen asli secara langsung.'
       WHEN doc_id % 11 = 0 THEN 'Foto terindikasi dari layar, sehingga hasil tidak boleh auto-terbit dan perlu review.'
       WHEN held THEN 'Data berhasil diekstrak sebagian, tetapi perlu review karena ada field wajib atau kualitas yang belum memenuhi syarat.'
       ELSE 'Dokumen memenuhi syarat untuk auto-processing.' END AS message FROM e
""")
def assess_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason codes, decision and message of vehicle records by the assessment itself."""
    key = F.col("doc_id")
    text = lambda n: F.lit("ALAMAT") if n is None else F.lit(n)
    made = {}
    for k, n in enumerate(assess.STNK_REQUIRED):
        ok = key % (k + 3) != 0
        value = F.when(key % 13 == 0, text(None)).otherwise(text("BUDI")) if n == "nama_pemilik" else F.lit("X1")
        confidence = F.when(key % 9 == 0, 0.75).otherwise(0.9) if n == "nama_pemilik" else F.lit(0.9)
        made[n] = F.struct(F.when(ok, value).alias("value"), F.when(ok, confidence).otherwise(0.0).alias("confidence"), F.when(ok, "ok").otherwise("missing").alias("status"))
    warned = F.array_compact(F.array(*(F.when((key % (k + 3) == 0) & (key % 2 == 0), F.lit(f"missing_required:{n}")) for k, n in enumerate(assess.STNK_REQUIRED))))
    rows = records(spark, sf_dir).select(
        "doc_id",
        F.when(key % 11 == 0, "Windows zoom 100%").otherwise("text").alias("raw_text"),
        F.lit("stnk").alias("expected_type"),
        F.lit("STNK").alias("document_type"),
        F.when(F.col("lang") == "es", "KTP").when(F.col("lang") == "fr", "UNKNOWN").otherwise("STNK").alias("detected_type"),
        F.create_map(*(x for n, f in made.items() for x in (F.lit(n), f))).alias("fields"),
        warned.alias("warnings"),
        F.col("flags").alias("quality_flags"),
        F.when(key % 7 == 0, "rapidocr").otherwise("paddleocr").alias("provider"),
    )
    found = assess.assess(rows, F.lit(AS_OF).cast("date"))
    return found.select("doc_id", F.array_join("input_assessment.reason_codes", "|").alias("reason_codes"), "input_assessment.decision", "input_assessment.can_auto_publish", "input_assessment.message")


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the evaluation schema, derived from documents and labels."""
    r = records(spark, sf_dir)
    status = lambda ok: F.when(ok, "ok").otherwise("missing")
    fields = F.create_map(*(x for k, n in enumerate(assess.STNK_REQUIRED) for x in (F.lit(n), F.struct(F.lit("x").alias("value"), F.lit(0.9).alias("confidence"), status((F.col("doc_id") % (k + 3)) != 0).alias("status")))))
    decision = F.when(F.col("q") == 1, "approved_for_auto").when(F.col("q") == 0, "rejected_input").otherwise("needs_review")
    codes = F.when(F.col("q") == 0, F.array(F.lit("document_type_unknown"))).otherwise(F.array().cast("array<string>"))
    return r.select(
        F.col("doc_id").cast("string").alias("file"),
        "doc_id",
        F.when(F.col("doc_id") % 17 == 0, "error").otherwise("ok").alias("status"),
        F.when(F.col("lang") == "es", "KTP").otherwise("STNK").alias("document_type"),
        (F.col("n_chars") * 2).cast("double").alias("processing_time_ms"),
        ((F.col("doc_id") % 10) / 10.0).alias("stnk_structure_score"),
        F.struct(decision.alias("decision"), (decision == "approved_for_auto").alias("can_auto_publish"), codes.alias("reason_codes")).alias("input_assessment"),
        fields.alias("fields"),
        F.struct(F.col("flags").alias("flags"), F.struct(assess.quality_score(F.col("flags")).alias("overall_score")).alias("metrics")).alias("quality"),
        F.struct((F.col("n_chars") / 50).cast("int").alias("token_count")).alias("ocr"),
    )


_FIELD_NOT_OK = ", ".join(f"CASE WHEN doc_id % {k + 3} = 0 THEN 'field_not_ok:{n}' END" for k, n in enumerate(assess.STNK_REQUIRED))


@query(_RECORDS_SQL + f"""
, e AS (SELECT *, (doc_id % 10) / 10.0 AS structure, CASE q WHEN 1 THEN 'approved_for_auto' WHEN 0 THEN 'rejected_input' ELSE 'needs_review' END AS decision, list_sort(flags) AS f,
        list_sort(list_filter(flags, lambda x: x IN ('document_too_small', 'low_text_density'))) AS bad FROM d),
u AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN ['processing_failed'] WHEN len(bad) > 0 THEN list_transform(bad, lambda x: 'quality:' || x)
        WHEN lang = 'es' AND structure < 0.5 THEN ['not_stnk'] WHEN structure < 0.1 AND CAST(trunc(n_chars / 50.0) AS INTEGER) < 15 THEN ['low_ocr_signal'] END AS bad_reasons,
      list_filter(list_concat([{_FIELD_NOT_OK}, CASE WHEN n_chars * 2 > 20000 THEN 'processing_time_over_20s' END, CASE WHEN q = 0 THEN 'document_type_unknown' WHEN q <> 1 THEN 'needs_review' END,
        CASE WHEN structure < 0.7 THEN 'structure_score_below_web_threshold' END], list_transform(f, lambda x: 'quality:' || x)), lambda x: x IS NOT NULL) AS reasons FROM e)
SELECT doc_id, CASE WHEN bad_reasons IS NOT NULL THEN 'bad_input' WHEN len(reasons) > 0 THEN 'internal_only' ELSE 'web_usable' END AS usage_class, array_to_string(coalesce(bad_reasons, reasons), '|') AS reasons FROM u
""")
def usage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assess.usage_class(_evaluation(spark, sf_dir))
    return rows.select("doc_id", "usage_class", F.array_join("usage_reasons", "|").alias("reasons"))


@query(_RECORDS_SQL + """
SELECT 'document_types' AS counter, CASE WHEN lang = 'es' THEN 'KTP' ELSE 'STNK' END AS value, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'statuses', CASE WHEN doc_id % 17 = 0 THEN 'error' ELSE 'ok' END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'decisions', CASE q WHEN 1 THEN 'approved_for_auto' WHEN 0 THEN 'rejected_input' ELSE 'needs_review' END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'auto_publish', CASE WHEN q = 1 THEN 'true' ELSE 'false' END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'reason_codes', 'document_type_unknown', count(*) FROM d WHERE q = 0 HAVING count(*) > 0
UNION ALL SELECT 'quality_flags', f, count(*) FROM (SELECT unnest(flags) AS f FROM d) GROUP BY 2
""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    rows = _evaluation(spark, sf_dir).withColumns({"stnk_usage_class": none.cast("string"), "warnings": none.cast("array<string>"), "stnk_usage_reasons": none.cast("array<string>")})
    return summary.counters(rows)


@query(_RECORDS_SQL + " SELECT field, status, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS field, CASE WHEN doc_id % {k + 3} <> 0 THEN 'ok' ELSE 'missing' END AS status FROM d" for k, n in enumerate(assess.STNK_REQUIRED)) + ") GROUP BY ALL")
def field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.field_status(_evaluation(spark, sf_dir))


@query("""
SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high,
  CAST(CAST(quantile_cont(value, 0.5) AS DECIMAL(18,6)) AS DOUBLE) AS p50, CAST(CAST(quantile_cont(value, 0.95) AS DECIMAL(18,6)) AS DOUBLE) AS p95, CAST(CAST(quantile_cont(value, 0.99) AS DECIMAL(18,6)) AS DOUBLE) AS p99 FROM events GROUP BY event_type
""")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    rows = events.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    rows = rows.join(summary.percentiles(events, "value", ["event_type"]), "event_type")
    return rows.select("event_type", "n", "low", "high", *(F.get("points", F.lit(i)).cast("decimal(18,6)").cast("double").alias(f"p{int(q * 100)}") for i, q in enumerate(summary.POINTS)))


@query(_RECORDS_SQL + """
, s AS (
  SELECT unnest(['processing_time_ms', 'pipeline_total', 'prepare', 'ocr', 'parse', 'quality', 'assessment', 'attempt_total']) AS series, (n_chars * 2)::DOUBLE AS value FROM d
  UNION ALL SELECT 'stnk_structure_score', ((doc_id % 10) / 10.0)::DOUBLE FROM d
  UNION ALL SELECT 'ocr_tokens', trunc(n_chars / 50.0)::DOUBLE FROM d
  UNION ALL SELECT unnest(['ocr_retry_count', 'selected_max_side']), unnest([0.0, 720.0])::DOUBLE FROM d
  UNION ALL SELECT 'quality_score', (greatest(100 - list_sum(list_concat([0], list_transform(flags, lambda f: CASE f WHEN 'low_text_density' THEN 15 WHEN 'document_too_small' THEN 20 ELSE 10 END))), 0) / 100.0)::DOUBLE FROM d
)
SELECT series, count(*) AS count, min(value) AS min, max(value) AS max, round_even(avg(value), 2) AS avg,
  round_even(quantile_cont(value, 0.5), 2) AS p50, round_even(quantile_cont(value, 0.95), 2) AS p95, round_even(quantile_cont(value, 0.99), 2) AS p99 FROM s GROUP BY series
""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles and averages of all series of the evaluation records."""
    rows = _evaluation(spark, sf_dir)
    timings = F.struct(F.col("processing_time_ms").alias("total_ms"), F.lit(None).cast("double").alias("nik_fallback_ms"), F.array(F.struct(*(F.col("processing_time_ms").alias(c) for c in summary.ATTEMPT_SERIES.values()))).alias("attempts"))
    pre = F.struct(F.lit(0).alias("retry_count"), F.lit(720).alias("selected_max_side"))
    return summary.series(rows.withColumn("ocr", F.col("ocr").withField("preprocess", pre).withField("timings", timings)))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.' || (json_keys(props)[1])) AS first_value FROM events WHERE props IS NOT NULL")
def json_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").where("props IS NOT NULL")
    parsed = F.from_json("props", "map<string,string>")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_element_at(F.map_values(parsed), F.lit(1)).alias("first_value"))


@query(r"""
WITH r AS (SELECT event_id, '```json' || chr(10) || props || chr(10) || '```' AS reply FROM events WHERE props IS NOT NULL)
SELECT event_id, json_array_length(json_keys(regexp_extract(reply, '```(?:json)?\s*(\{.*\})\s*```', 1, 's'))::JSON)::INTEGER AS n_keys FROM r
""")
def json_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object inside a fenced reply."""
    rows = read_table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("reply"))
    body = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return rows.select("event_id", F.size(F.map_keys(F.from_json(body, "map<string,string>"))).alias("n_keys"))


@query(r"""
SELECT page_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g')) AS t FROM pages)
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of a page, tags taken out (Spark built-ins, beyond the document operators)."""
    no_code = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(no_code, "<[^>]*>", " "), r"\s+", " "))
    return read_table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


# Documents ----------------------------------------------------------------------------------------


@query()
def fuzzy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure score of every text by fuzzy label lines (no SQL form)."""
    return fuzzy.structure_score(read_table(spark, sf_dir, "documents"), vehicle_registration.LABELS, assess.STNK_REQUIRED)


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the shape of the two documents, made of customers and their orders."""
    c = spread(read_table(spark, sf_dir, "customer").select("c_custkey"))
    key = F.col("c_custkey")
    day = F.format_string("%02d", key % 28 + 1)
    nik = F.concat(F.lpad((key % 999999).cast("string"), 6, "0"), day, F.format_string("%02d", key % 12 + 1), F.format_string("%02d", key % 90 + 10), F.lpad((key % 9999).cast("string"), 4, "0"))
    born = F.concat(day, F.lit("-"), F.format_string("%02d", key % 12 + 1), F.lit("-"), (1940 + key % 60).cast("string"))
    name = F.concat(F.lit("BUDI "), F.translate(F.regexp_replace(key.cast("string"), r"\D", ""), "0123456789", "ABCDEFGHIJ"), F.lit("AN"))
    ktp = F.concat_ws("\n", F.lit("PROVINSI JAWA BARAT"), F.lit("KOTA BANDUNG"), F.concat(F.lit("NIK : "), nik), F.concat(F.lit("Nama : "), name), F.concat(F.lit("Tempat/Tgl Lahir : BANDUNG, "), born), F.lit("Jenis Kelamin : LAKI-LAKI"), F.lit("Alamat : JL MELATI NO 5"), F.lit("RT/RW : 003/004"), F.lit("Agama : ISLAM"), F.lit("Kewarganegaraan : WNI"), F.lit("Berlaku Hingga : SEUMUR HIDUP"))
    plate = F.concat(F.lit("B "), (key % 8999 + 1000).cast("string"), F.lit(" XYZ"))
    frame = F.concat(F.lit("MHKA1BA1JFK"), F.lpad((key % 999999).cast("string"), 6, "0"))
    stnk = F.concat_ws("\n", F.lit("SURAT TANDA NOMOR KENDARAAN"), F.concat(F.lit("NOMOR POLISI : "), plate), F.concat(F.lit("NAMA PEMILIK : "), name), F.lit("MERK : TOYOTA"), F.concat(F.lit("TAHUN PEMBUATAN : "), (2000 + key % 20).cast("string")), F.lit("WARNA : HITAM"), F.concat(F.lit("NOMOR RANGKA : "), frame), F.concat(F.lit("NOMOR MESIN : 1NRF"), F.lpad((key % 999999).cast("string"), 6, "0")), F.lit("BAHAN BAKAR : BENSIN"))
    return c.select(key.alias("doc_id"), F.when(key % 2 == 0, ktp).otherwise(stnk).alias("raw_text"), F.lit("AUTO").alias("requested_type"))


_NAME_SQL = "'BUDI ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || 'AN'"


@query(f"""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'KTP' ELSE 'STNK' END AS document_type, {_NAME_SQL} AS name,
  CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey % 999999 AS VARCHAR), 6, '0') || printf('%02d', c_custkey % 28 + 1) || printf('%02d', c_custkey % 12 + 1) || printf('%02d', c_custkey % 90 + 10) || lpad(CAST(c_custkey % 9999 AS VARCHAR), 4, '0')
       ELSE 'B ' || CAST(c_custkey % 8999 + 1000 AS VARCHAR) || ' XYZ' END AS number,
  CASE WHEN c_custkey % 2 = 0 THEN 'BANDUNG, ' || printf('%02d', c_custkey % 28 + 1) || '-' || printf('%02d', c_custkey % 12 + 1) || '-' || CAST(1940 + c_custkey % 60 AS VARCHAR) ELSE CAST(2000 + c_custkey % 20 AS VARCHAR) END AS dated,
  CASE WHEN c_custkey % 2 = 0 THEN '003/004' ELSE 'MHKA1BA1JFK' || lpad(CAST(c_custkey % 999999 AS VARCHAR), 6, '0') END AS code FROM customer
""")
def parse_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parsers over form texts: the fields that are read back."""
    parsed = documents.parse_documents(_forms(spark, sf_dir), F.lit(AS_OF).cast("date"))
    value = lambda n: F.try_element_at("fields", F.lit(n))["value"]
    ktp = F.col("document_type") == "KTP"
    pick = lambda a, b: F.when(ktp, value(a)).otherwise(value(b))
    return parsed.select("doc_id", "document_type", pick("nama", "nama_pemilik").alias("name"), pick("nik", "nomor_polisi").alias("number"), pick("tempat_tanggal_lahir", "tahun_pembuatan").alias("dated"), pick("rt_rw", "nomor_rangka").alias("code"))


#: Ways in which `noisy_registrations` spoils a form, by key.
_SPOILT = ("labels", "series", "broken", "section", "plate", "company")


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration forms of customers, each spoilt in one way: misread labels, numbers and plates, broken and contradicting lines."""
    key = F.col("c_custkey")
    six = F.lpad((key % 999999).cast("string"), 6, "0")
    way = F.element_at(F.array(*map(F.lit, _SPOILT)), (key % len(_SPOILT) + 1).cast("int"))
    code = F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ")
    frame, engine = F.concat(F.lit("MHKA1BA1JFK"), six), F.concat(F.lit("1NRF"), six)
    number = (key % 8999 + 1000).cast("string")
    line = lambda label, value, spoilt=None: F.concat(F.when(way == "labels", F.lit(spoilt or label)).otherwise(F.lit(label)), F.lit(" : "), value)
    plate = F.when(way == "plate", F.concat(F.lit("8 "), number, F.lit(" X1Z"))).otherwise(F.concat(F.lit("B "), number, F.lit(" XIZ")))
    name = F.when(way == "company", F.concat(F.lit("FT MAJU "), code, F.lit(" JAYA"))).otherwise(F.concat(F.lit("BUDI "), code, F.lit("AN")))
    framed = F.when(way == "broken", F.concat(F.lit("NOMOR RANGKA\nMHKA1BA1\nHITAM\nJFK"), six)).when(way == "section", F.concat(F.lit("NOMOR RANGKA\n"), frame)).otherwise(line("NOMOR RANGKA", frame, "N0MOR RANGXA"))
    engined = F.when(way == "series", F.concat(F.lit("N0M0R MEIN\nJOBE"), six)).when(way == "section", F.concat(F.lit("NOMOR MESIN\n"), engine)).otherwise(line("NOMOR MESIN", engine, "NOM0R MES1N"))
    first_half = F.when(way == "section", F.concat(F.lit("NOMOR RANGKA : MHKA9XX9JFK"), six, F.lit("\nNOMOR MESIN : 9NRF"), six))
    text = F.concat_ws("\n", first_half, F.when(~way.isin("series", "broken"), F.lit("SURAT TANDA NOMOR KENDARAAN BERMOTOR")), line("NOMOR POLISI", plate, "NOM0R POLLSI"), line("NAMA PEMILIK", name, "NAMA PEMIL1X"), line("MERK", F.lit("TOYOTA")), line("TAHUN PEMBUATAN", (2000 + key % 20).cast("string"), "TAHUN PENBUATAM"), framed, engined)
    return spread(read_table(spark, sf_dir, "customer").select("c_custkey")).select(key.alias("doc_id"), way.alias("spoilt"), text.alias("raw_text"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey % 999999 AS VARCHAR), 6, '0') AS six, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS code FROM customer)
SELECT k AS doc_id, list_extract({list(_SPOILT)}, (k % {len(_SPOILT)} + 1)::INTEGER) AS spoilt, 'B ' || CAST(k % 8999 + 1000 AS VARCHAR) || ' XIZ' AS plate,
  CASE WHEN k % 6 = 5 THEN 'PT MAJU ' || code || ' JAYA' ELSE 'BUDI ' || code || 'AN' END AS owner, CAST(2000 + k % 20 AS VARCHAR) AS year,
  'MHKA1BA1JFK' || six AS frame, CASE WHEN k % 6 = 1 THEN 'J08E' ELSE '1NRF' END || six AS engine, 'TOYOTA' AS brand FROM c
""")
def noisy_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle parser over spoilt forms: what they said before they were spoilt."""
    parsed = vehicle_registration.parse(_registrations(spark, sf_dir), F.lit(AS_OF).cast("date"))
    read = {"plate": "nomor_polisi", "owner": "nama_pemilik", "year": "tahun_pembuatan", "frame": "nomor_rangka", "engine": "nomor_mesin", "brand": "merek"}
    return parsed.select("doc_id", "spoilt", *(F.try_element_at("fields", F.lit(n))["value"].alias(a) for a, n in read.items()))


#: Ways in which `noisy_cards` spoils a form, by key.
_SHUFFLED = ("swapped", "reversed", "joined", "moved", "wrapped", "misread", "dated", "late", "bare", "trailing")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity card forms of customers, each spoilt in one way: places exchanged or below the wrong label, names joined, moved or broken."""
    key = F.col("c_custkey")
    way = F.element_at(F.array(*map(F.lit, _SHUFFLED)), (key % len(_SHUFFLED) + 1).cast("int"))
    code = F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ")
    day, month, year = F.format_string("%02d", key % 28 + 1), F.format_string("%02d", key % 12 + 1), 1960 + key % 30
    nik = F.concat(F.lpad((key % 999999).cast("string"), 6, "0"), day, month, F.format_string("%02d", year % 100), F.lpad((key % 9999).cast("string"), 4, "0"))
    born = F.concat_ws("-", day, month, F.when(way == "dated", year - 10).otherwise(year).cast("string"))
    village, district = F.concat(F.lit("CI"), code, F.lit("SARI")), F.concat(F.lit("SUKA"), code, F.lit("MAJU"))
    line = lambda *parts: F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    of = lambda ways, other: F.coalesce(*(F.when(way == w, c) for w, c in ways.items()), other)
    second = F.concat(F.lit("RAHAYU"), code)
    id_line, name = F.concat(F.lit("NIK : "), nik), F.concat_ws(" ", F.lit("SITI"), second)
    head = of({"joined": line(id_line, F.concat(F.lit("Nama : SITI"), second)), "moved": line("Nama", "Jenis Kelamin : PEREMPUAN", name, nik), "wrapped": line(id_line, "Nama", F.lit("SITI AMINAH"), second)}, line(id_line, F.concat(F.lit("Nama : "), name)))
    birth = F.concat(F.lit("Tempat/Tgl Lahir : BANDUNG, "), born)
    area = F.lit("RT/RW : 003/004")
    places = of(
        {
            "swapped": line(area, "Kel/Desa", district, village, "Kecamatan"),
            "reversed": line("Kecamatan", "Kel/Desa", "RT/RW", district, village, "003/004"),
            "misread": line(area, F.concat(F.lit("KeilDesa : "), village), F.concat(F.lit("Kecamretan : "), district)),
            "late": line("RT/RW", "Kel/Desa", "003/004", "Kecamatan", village, district),
            "bare": line(area, "Kel/Desa", "Kecamatan", village, district),
            "trailing": line("RT/RW", "Kel/Desa", "Kecamatan", "003/004", village, district),
        },
        line(area, F.concat(F.lit("Kel/Desa : "), village), F.concat(F.lit("Kecamatan : "), district)),
    )
    expiry = of({"misread": F.lit("Berlaky Hingga : SEUMUR HIDUP")}, F.lit("Berlaku Hingga : SEUMUR HIDUP"))
    text = line("PROVINSI JAWA BARAT", "KOTA BANDUNG", head, birth, "Alamat : JL MELATI NO 5", places, "Agama : ISLAM", expiry)
    return spread(read_table(spark, sf_dir, "customer").select("c_custkey")).select(key.alias("doc_id"), way.alias("spoilt"), text.alias("raw_text"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, list_extract({list(_SHUFFLED)}, (c_custkey % {len(_SHUFFLED)} + 1)::INTEGER) AS spoilt, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS code FROM customer)
SELECT k AS doc_id, spoilt, 'SITI ' || CASE WHEN spoilt = 'wrapped' THEN 'AMINAH ' ELSE '' END || 'RAHAYU' || code AS name,
  'BANDUNG, ' || printf('%02d-%02d-%d', k % 28 + 1, k % 12 + 1, 1960 + k % 30) AS born, '003/004' AS area, 'CI' || code || 'SARI' AS village, 'SUKA' || code || 'MAJU' AS district,
  'SEUMUR HIDUP' AS expiry, 'BELUM KAWIN' AS marital_status, 'WNI' AS citizenship FROM c
""")
def noisy_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity card parser over spoilt forms: what they said before they were spoilt, and the values that most cards have."""
    day = F.lit(AS_OF).cast("date")
    parsed = identity_card.with_defaults(identity_card.with_id_births(identity_card.parse(_cards(spark, sf_dir), day), day))
    read = {"name": "nama", "born": "tempat_tanggal_lahir", "area": "rt_rw", "village": "kelurahan_desa", "district": "kecamatan", "expiry": "berlaku_hingga", "marital_status": "status_perkawinan", "citizenship": "kewarganegaraan"}
    return parsed.select("doc_id", "spoilt", *(F.try_element_at("fields", F.lit(n))["value"].alias(a) for a, n in read.items()))


@query("""
SELECT c_custkey AS doc_id, 'fields' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 16 ELSE 12 END::INTEGER AS n FROM customer
UNION ALL SELECT c_custkey, 'warnings', 0 FROM customer
""")
def form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = documents.parse_documents(_forms(spark, sf_dir), F.lit(AS_OF).cast("date"))
    both = F.array(F.struct(F.lit("fields").alias("kind"), F.size("fields").alias("n")), F.struct(F.lit("warnings").alias("kind"), F.size("warnings").alias("n")))
    return parsed.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.kind", "x.n")


@query(f"""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'needs_review' ELSE 'approved_for_auto' END AS decision,
  CASE WHEN c_custkey % 2 <> 0 THEN '' ELSE 'ktp_auto_missing:kelurahan_desa|ktp_auto_missing:kecamatan|ktp_auto_missing:pekerjaan' ||
    CASE WHEN c_custkey % 90 + 10 + CASE WHEN c_custkey % 90 + 10 <= {AS_OF[2:4]} THEN 2000 ELSE 1900 END <> 1940 + c_custkey % 60 THEN '|ktp_nik_ttl_mismatch' ELSE '' END END AS reason_codes,
  CASE WHEN c_custkey % 2 = 0 THEN 54.28 ELSE 171.15 END::DOUBLE AS score FROM customer
""")
def assess_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.assess_documents(documents.parse_documents(_forms(spark, sf_dir), F.lit(AS_OF).cast("date")), F.lit(AS_OF).cast("date"))
    return rows.select("doc_id", "input_assessment.decision", F.array_join("input_assessment.reason_codes", "|").alias("reason_codes"), F.round("score", 4).alias("score"))


@query(f"""
SELECT c_custkey AS doc_id, 'not_found' AS status, {_NAME_SQL} AS nama, 'BANDUNG' AS tempat_lahir,
  printf('%04d-%02d-%02dT00:00:00.000Z', 1940 + c_custkey % 60, c_custkey % 12 + 1, c_custkey % 28 + 1) AS tanggal_lahir, 'JL. MELATI NO. 5, RT/RW 003/004' AS alamat,
  'L' AS jenis_kelamin, NULL::VARCHAR AS status_perkawinan, NULL::VARCHAR AS kode_pos, 'WNI' AS kewarganegaraan FROM customer WHERE c_custkey % 2 = 0
""")
def partner_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity card forms in the flat form of the partner record."""
    cards = _forms(spark, sf_dir).where(F.col("raw_text").startswith("PROVINSI"))
    rows = documents.partner_record(identity_card.parse(cards, F.lit(AS_OF).cast("date")))
    return rows.select("doc_id", "status", "ocr_data.nama", "ocr_data.tempat_lahir", "ocr_data.tanggal_lahir", "ocr_data.alamat", "ocr_data.jenis_kelamin", "ocr_data.status_perkawinan", "kodepos_data.kode_pos", "ocr_data.kewarganegaraan")


@query("""
WITH n AS (
  SELECT p_partkey, p_name, lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS code, trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')) AS city,
    trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS loc, trim(regexp_replace(replace(upper(p_name), 'O', '0'), '[^A-Z0-9]+', ' ', 'g')) AS place FROM part
), k AS (
  SELECT *, replace(place, ' ', '') AS tight, translate(replace(place, ' ', ''), '0158', 'OISB') AS tplace, translate(replace(loc, ' ', ''), '0158', 'OISB') AS tloc, translate(replace(city, ' ', ''), '0158', 'OISB') AS tcity,
    list_filter(string_split(place, ' '), lambda w: length(w) >= 3) AS pw, list_filter(string_split(loc, ' '), lambda w: length(w) >= 3) AS lw FROM n
), words AS (SELECT DISTINCT unnest(lw) AS w FROM k), met AS (SELECT DISTINCT place FROM (SELECT place, unnest(pw) AS w FROM k) JOIN words USING (w) UNION SELECT a.place FROM k a JOIN k b ON a.tight = replace(b.loc, ' ', '')),
places AS (SELECT DISTINCT place, pw, tight FROM k), locs AS (SELECT DISTINCT loc, lw FROM k),
fit AS (
  SELECT p.place, l.loc FROM places p JOIN locs l ON contains(l.loc, p.place) OR contains(p.place, l.loc) OR p.tight = replace(l.loc, ' ', '')
  WHERE list_has_any(pw, lw) OR p.tight = replace(l.loc, ' ', '') OR p.place NOT IN (SELECT place FROM met)
), cand AS (
  SELECT q.p_partkey AS doc_id, true AS coded, e.p_partkey AS ekey FROM k q JOIN k e ON q.p_partkey % 4 = 0 AND q.code = e.code
  UNION ALL SELECT q.p_partkey, false, e.p_partkey FROM k q JOIN fit f ON q.p_partkey % 4 <> 0 AND f.place = q.place JOIN k e ON e.loc = f.loc
), sc AS (
  SELECT c.*, e.code AS kode_pos, e.p_name AS address, upper(e.p_name) AS locality, q.place AS qp, q.city AS qc,
    CASE WHEN coded THEN 8.0 ELSE 0.0 END + 1.0
    + CASE WHEN q.city = e.city OR q.tcity = e.tcity OR levenshtein(q.tcity, e.tcity) <= 1 THEN 3.0 WHEN contains(e.city, q.city) OR contains(q.city, e.city) THEN 2.0 END
    + CASE WHEN q.place = e.loc OR q.tplace = e.tloc OR levenshtein(q.tplace, e.tloc) <= 1 THEN 6.0
           WHEN contains(replace(e.loc, ' ', ''), q.tight) OR contains(q.tight, replace(e.loc, ' ', '')) THEN 4.0 END AS score
  FROM cand c JOIN k q ON q.p_partkey = c.doc_id JOIN k e ON e.p_partkey = c.ekey
), ok AS (SELECT *, count(*) OVER (PARTITION BY doc_id, kode_pos) AS total_options FROM sc WHERE score >= 8),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(address), kode_pos, address) AS p FROM ok)
SELECT part.p_partkey AS doc_id, kode_pos, locality, score::DOUBLE AS score, CASE WHEN score IS NOT NULL THEN round(least(0.95, 0.55 + score / 20.0), 2) END::DOUBLE AS confidence, total_options,
  CASE WHEN score IS NULL THEN NULL WHEN round(least(0.95, 0.55 + score / 20.0), 2) >= 0.9 THEN 'exact_match' ELSE 'partial_match' END AS match_status
FROM part LEFT JOIN top ON top.doc_id = part.p_partkey AND p = 1
""")
def postal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy lookup of every part's name against the same names as reference data; every fourth part asks by code as well."""
    part = read_table(spark, sf_dir, "part")
    none = F.lit("")
    postal = part.select(
        F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0").alias("kode_pos"), F.col("p_name").alias("address"), F.upper("p_name").alias("locality"), F.lit("kelurahan").alias("sifat_pos"),
        none.alias("city_code"), F.col("p_brand").alias("city_name"), none.alias("province_code"), none.alias("province_name"), none.alias("district_code"), none.alias("district_name"),
    )
    none = F.lit(None).cast("string")
    code = F.when(F.col("p_partkey") % 4 == 0, F.translate(F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), "0", "O"))
    asked = part.select(F.col("p_partkey").alias("doc_id"), code.alias("kode_pos"), none.alias("provinsi"), F.col("p_brand").alias("kabupaten_kota"), F.regexp_replace(F.upper("p_name"), "O", "0").alias("kelurahan_desa"), none.alias("kecamatan"), none.alias("alamat"))
    found = lookup.lookup_postal(asked, postal, repeated=True)
    return found.select("doc_id", "match.kode_pos", "match.locality", "match.score", "match.confidence", "match.total_options", "match.match_status")


def _laid_out(rows: DataFrame, words: Column, line: Column) -> DataFrame:
    """One positioned token a word: words of a line stand side by side, lines below each other."""
    tokens = rows.select("doc_id", line.alias("row"), F.posexplode(words).alias("i", "text"))
    x, y = F.col("i") * 10.0, F.col("row") * 20.0
    return layout.positioned(tokens.select("doc_id", "text", F.array(F.array(x, y), F.array(x + 8, y + 10)).alias("bbox")))


@query("""
WITH t AS (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM conversations)
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS line_no, round(CASE WHEN hi > lo THEN (turn - lo) / (hi - lo)::DOUBLE ELSE 0.0 END, 6) AS y,
  len(string_split(text, ' '))::INTEGER AS n_tokens, text AS line FROM t
""")
def layout_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout lines of all words of all conversations, a turn a row of tokens; `layout_fields` reads repairs from lines."""
    rows = read_table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    lines = layout.layout_lines(_laid_out(rows, F.split("text", " "), F.col("turn")))
    return lines.select("doc_id", "line_no", F.round("y", 6).alias("y"), F.size("tokens").alias("n_tokens"), "line")


@query("SELECT c_custkey AS doc_id, 'kewarganegaraan' AS field, 'WNI' AS value, 0.88::DOUBLE AS confidence FROM customer WHERE c_custkey % 2 = 0")
def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position-aware repairs from the layout lines of the identity card forms."""
    cards = _forms(spark, sf_dir).where(F.col("raw_text").startswith("PROVINSI"))
    rows = cards.select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("row", "text"))
    return layout.repairs(layout.layout_lines(_laid_out(rows, F.split("text", " "), F.col("row"))))


@query("""
WITH c AS (SELECT c_custkey AS k, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS code FROM customer)
SELECT k AS doc_id, 'kelurahan_desa' AS field, 'CI' || code || 'SARI' AS value, CASE WHEN k % 3 = 0 THEN 0.84 ELSE 0.78 END::DOUBLE AS confidence FROM c
UNION ALL SELECT k, 'kecamatan', 'SUKA' || code || 'MAJU', 0.78 FROM c
UNION ALL SELECT k, 'berlaku_hingga', CASE WHEN k % 2 = 0 THEN 'SEUMUR HIDUP' ELSE printf('%02d-12-20%02d', k % 28 + 1, k % 90 + 10) END, 0.78 FROM c
UNION ALL SELECT k, 'status_perkawinan', CASE k % 4 WHEN 0 THEN 'KAWIN' WHEN 1 THEN 'BELUM KAWIN' WHEN 2 THEN 'CERAI HIDUP' ELSE 'CERAI MATI' END, 0.78 FROM c
UNION ALL SELECT k, 'kewarganegaraan', CASE WHEN k % 5 = 0 THEN 'WNA' ELSE 'WNI' END, 0.78 FROM c
""")
def layout_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fields that only the positions of tokens give, joined back to parsed cards; every third card has one of them in its text."""
    key = F.col("c_custkey")
    code = F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ")
    village, district = F.concat(F.lit("CI"), code, F.lit("SARI")), F.concat(F.lit("SUKA"), code, F.lit("MAJU"))
    status = F.element_at(F.array(*map(F.lit, ("KAWIN", "BELUM KAWIN", "CERAI HIDUP", "CERAI MATI"))), (key % 4 + 1).cast("int"))
    expiry = F.when(key % 2 == 0, "SEUMUR HIDUP").otherwise(F.format_string("%02d-12-20%02d", key % 28 + 1, key % 90 + 10))
    seen = F.array(
        F.lit("NIK : 3201014102900001"), F.concat(F.lit("Kel/Desa "), village), F.concat(F.lit("Kecamatan "), district), F.lit("Berlaku Hingga"),
        F.concat(F.lit("Status Perkawinan : "), status), F.concat(F.lit("Kewarganegaraan : "), F.when(key % 5 == 0, "WNA").otherwise("WNI")), expiry,
    )
    text = F.concat_ws("\n", F.lit("NIK : 3201014102900001\nNama : SITI AMINAH"), F.when(key % 3 == 0, F.concat(F.lit("Kel/Desa : "), village)))
    rows = spread(read_table(spark, sf_dir, "customer").select("c_custkey")).select(key.alias("doc_id"), text.alias("raw_text"), seen.alias("seen"))
    tokens = _laid_out(rows.select("doc_id", F.posexplode("seen").alias("row", "text")), F.split("text", " "), F.col("row"))
    parsed = identity_card.with_defaults(identity_card.parse(rows.drop("seen"), F.lit(AS_OF).cast("date")))
    merged = by_layout.with_layout(parsed, layout.layout_lines(tokens))
    return documents.long_fields(merged).where(F.col("field").isin(*by_layout.KEPT)).select("doc_id", "field", "value", "confidence")


# Output of readers --------------------------------------------------------------------------------


@query(r"""
WITH w AS (SELECT conv_id, turn, CAST(turn % 3 AS INTEGER) AS shape, conv_id % 7 = 3 AS cut, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '') AS words FROM conversations)
SELECT conv_id, turn, CASE WHEN cut THEN 0 ELSE len(words) END::INTEGER AS n_tokens, CASE WHEN cut THEN '' ELSE coalesce(array_to_string(words, chr(10)), '') END AS raw_text,
  CASE WHEN cut OR len(words) = 0 THEN 0 WHEN shape = 0 THEN 0.25 WHEN shape = 1 THEN 0.5 * len(words) ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN cut THEN 0 WHEN shape = 1 THEN len(words) ELSE 0 END::INTEGER AS n_boxes, CASE WHEN cut THEN 'not_json' END AS error FROM w
""")
def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of recogniser output in three shapes, a turn of a conversation an output; every seventh conversation is cut off."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    words = F.filter(F.split("text", " "), lambda x: F.trim(x) != "")
    texts = F.to_json(words)
    listed = F.concat(F.lit('{"res": {"pages": [{"rec_texts": '), texts, F.lit(', "rec_scores": [0.25, null, "bad"], "rec_boxes": null}]}, "page": 1}'))
    pairs = F.concat(F.lit("[[["), F.array_join(F.transform(words, lambda x, i: F.concat(F.lit("[["), i.cast("string"), F.lit(", 0], ["), quoted(x), F.lit(', "0.5"]]'))), ", "), F.lit("]]]"))
    deep = F.concat(F.lit('{"a": [null, {"b": [[{"texts": '), texts, F.lit("}]]}]}"))
    output = F.when(F.col("turn") % 3 == 0, listed).when(F.col("turn") % 3 == 1, pairs).otherwise(deep)
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 3, F.substring(output, 1, 9)).otherwise(output).alias("output"))
    read = ocr_output.read_output(rows)
    boxed = F.size(F.filter("tokens", lambda t: t["bbox"].isNotNull()))
    total = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["confidence"])
    return read.select("conv_id", "turn", F.size("tokens").alias("n_tokens"), "raw_text", total.alias("confidence"), boxed.alias("n_boxes"), "error")


@query(r"""
WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS w, CAST(c_custkey % 8999 + 1000 AS VARCHAR) AS n FROM customer)
SELECT k AS doc_id, CASE w WHEN 3 THEN 'not_object' WHEN 4 THEN 'not_json' WHEN 5 THEN 'fields_not_object' WHEN 6 THEN 'unknown_type' WHEN 7 THEN 'bad_confidence' END AS error,
  CASE WHEN w <= 1 THEN 'STNK' WHEN w = 2 THEN 'KTP' END AS document_type, CASE w WHEN 0 THEN 'B ' || n || ' XYZ' WHEN 1 THEN '?' || n WHEN 2 THEN lpad(n, 16, '3') END AS number,
  CASE w WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid' WHEN 2 THEN 'ok' END AS status, CASE w WHEN 0 THEN 0.9 WHEN 1 THEN 0.35 WHEN 2 THEN 0.85 END::DOUBLE AS confidence,
  CASE w WHEN 0 THEN 'invalid:x|blur_detected' WHEN 1 THEN 'invalid:nomor_polisi' WHEN 2 THEN '' END AS warnings, CASE WHEN w <= 1 THEN '2019' END AS year, CASE WHEN w <= 1 THEN 12 WHEN w = 2 THEN 16 END::INTEGER AS n_fields FROM c
""")
def agent_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of remote readers to customers' documents: three that keep the contract and five that break it, by key."""
    key = F.col("c_custkey")
    n = (key % 8999 + 1000).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    replies = [
        text('{"document_type": "stnk", "fields": {"nomor_polisi": {"value": "b-', n, '-xyz", "status": " Found ", "confidence": "0.9", "evidence": "plate"}, "tahun_pembuatan": 2019, "merek": ""}, "warnings": ["invalid:x", " hello ", " blur_detected"]}'),
        text('{"fields": {"nomor_polisi": {"value": "?', n, '", "evidence": ["a", 1]}, "tahun_pembuatan": {"value": "2019", "status": "detected"}}, "document_type": "STNK"}'),
        text('As asked:\n```json\n{"fields": {"nik": "', F.lpad(n, 16, "3"), '", "nama": {"value": null, "status": "ok"}}}\n```'),
        text('[{"fields": ', n, "}]"),
        text('{"fields": {"nik": "', n),
        text('{"fields": [', n, "]}"),
        text('{"document_type": "SIM", "fields": {"nik": ', n, "}}"),
        text('{"fields": {"nik": {"value": ', n, ', "confidence": "high"}}}'),
    ]
    reply = F.element_at(F.array(*replies), (key % len(replies) + 1).cast("int"))
    rows = spread(read_table(spark, sf_dir, "customer").select("c_custkey")).select(key.alias("doc_id"), F.lit("AUTO").alias("requested_type"), reply.alias("reply"))
    read = agent_reply.read_replies(rows, {"KTP": list(identity_card.LABELS), "STNK": list(vehicle_registration.LABELS)}, fenced=True)
    of = lambda name: F.try_element_at("fields", F.lit(name))
    number = F.when(F.col("document_type") == "STNK", of("nomor_polisi")).otherwise(of("nik"))
    size = F.when(F.col("fields").isNotNull(), F.size("fields"))
    return read.select("doc_id", "error", "document_type", number["value"].alias("number"), number["status"].alias("status"), number["confidence"].alias("confidence"), F.array_join("warnings", "|").alias("warnings"), of("tahun_pembuatan")["value"].alias("year"), size.alias("n_fields"))


#: Timeout of the jobs of `job_transitions`, whose events are hours apart.
_JOB_TIMEOUT = 6 * 3_600_000


def job_events(events: DataFrame) -> DataFrame:
    """Events as those of jobs, one a user and day: clicks and signups hand in, purchases and errors are results."""
    kind = F.when(F.col("event_type").isin("click", "signup"), jobs.SUBMIT).when(F.col("event_type") == "purchase", jobs.DONE).when(F.col("event_type") == "error", jobs.FAILED)
    ts = F.col("ts").cast("timestamp")
    job = F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.unix_millis(ts) / 86_400_000).cast("string"))
    return events.select(job.alias("job_id"), kind.alias("kind"), ts.alias("ts")).where("kind IS NOT NULL")


@query(f"""
WITH e AS (
  SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS job_id, CASE WHEN event_type IN ('click', 'signup') THEN 'submit' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS kind, epoch_us(ts) // 1000 AS t
  FROM events WHERE event_type IN ('click', 'signup', 'purchase', 'error')
), s AS (SELECT job_id, min(t) AS start FROM e WHERE kind = 'submit' GROUP BY job_id),
r AS (SELECT s.job_id, start, min({{'t': t, 'kind': kind}}) AS x FROM s JOIN e ON e.job_id = s.job_id AND kind <> 'submit' AND t >= start AND t < start + {jobs.KEPT_MS} GROUP BY ALL),
j AS (SELECT s.job_id, s.start, r.x.t AS done, r.x.kind AS status, coalesce(r.x.t >= s.start + {_JOB_TIMEOUT}, true) AS queued, (SELECT max(t) FROM e) AS until FROM s LEFT JOIN r ON r.job_id = s.job_id)
SELECT job_id, 'pending' AS status, false AS late, start::BIGINT AS at_ms FROM j
UNION ALL SELECT job_id, 'queued', false, start + {_JOB_TIMEOUT} FROM j WHERE queued AND start + {_JOB_TIMEOUT} <= until
UNION ALL SELECT job_id, status, queued, done FROM j WHERE done IS NOT NULL
UNION ALL SELECT job_id, 'expired', false, coalesce(done, start) + {jobs.KEPT_MS} FROM j WHERE coalesce(done, start) + {jobs.KEPT_MS} <= until
""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending, queued, completed, failed, late and expired jobs over the events."""
    return jobs.transitions(job_events(read_table(spark, sf_dir, "events")), timeout_ms=_JOB_TIMEOUT)


# Attempts -----------------------------------------------------------------------------------------


_ATTEMPTS_SQL = """
WITH a AS (
  SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber - 1 AS attempt_index, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 4 AS w, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem
)"""


@query(_ATTEMPTS_SQL + """, b AS (
  SELECT k, attempt_index, CASE w WHEN 0 THEN 'KTP' WHEN 1 THEN 'STNK' WHEN 2 THEN 'AUTO' ELSE 'ktp' END AS kind, CASE WHEN q % 2 = 0 THEN 'fast' ELSE 'accurate' END AS mode, q, p FROM a
), c AS (SELECT *, upper(kind) AS u, upper(kind) IN ('KTP', 'STNK') AND mode = 'fast' AND p % 5 = 0 AS rejected FROM b),
d AS (SELECT *, CASE WHEN NOT rejected THEN CASE WHEN q % 7 = 0 THEN 'stnk_full_page' WHEN u = 'KTP' AND mode = 'fast' THEN 'ktp_fast' WHEN u = 'STNK' AND mode = 'fast' THEN 'stnk_fast_roi' WHEN u = 'STNK' THEN 'stnk_official_roi' ELSE 'full_page' END END AS strategy FROM c)
SELECT k AS doc_id, attempt_index::INTEGER AS attempt_index, mode, rejected, strategy,
  CASE WHEN NOT rejected THEN CASE WHEN strategy = 'stnk_official_roi' THEN 1200 WHEN strategy = 'stnk_fast_roi' THEN 720 WHEN u = 'KTP' AND mode = 'fast' THEN 496 WHEN strategy = 'stnk_full_page' THEN 1600 WHEN u = 'STNK' THEN 1200 ELSE 1280 END END::INTEGER AS max_side,
  CASE WHEN q % 7 = 0 THEN NULL WHEN mode = 'accurate' AND u = 'STNK' AND p % 3 <> 0 AND p % 4 <> 0 THEN 'stnk_full_page:1600' WHEN mode = 'fast' AND u = 'KTP' AND p % 3 <> 0 AND p % 4 <> 0 AND q > 5 THEN 'full_page:1280' END AS follows FROM d
""")
def attempt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each first attempt is made and which one follows it, over order lines as attempts."""
    rows = attempts.plan_requests(_attempts(spark, sf_dir))
    columns = {n: F.col(n) for n in ("requested_type", "mode", "force_strategy", "document_type", "decision", "reason_codes", "fields", "n_tokens")}
    follows = attempts.next_attempt(columns)
    return rows.select("doc_id", "attempt_index", "mode", "rejected", "strategy", "max_side", F.concat_ws(":", follows["strategy"], follows["max_side"].cast("string")).alias("follows")).withColumn("follows", F.nullif("follows", F.lit("")))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as attempts at reading their order's document."""
    q, p = F.col("l_quantity").cast("long"), F.floor("l_extendedprice")
    kind = F.element_at(F.array(*map(F.lit, ("KTP", "STNK", "AUTO", "ktp"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    status = F.when(p % 4 == 0, "ok").otherwise("missing")
    field = F.struct(F.lit("x").alias("value"), F.lit(0.5).alias("confidence"), status.alias("status"), F.array().cast("array<string>").alias("evidence"), F.lit(None).cast("string").alias("raw"))
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("attempt_index"), kind.alias("requested_type"), F.when(q % 2 == 0, "FAST").alias("processing_mode"),
        F.when(p % 5 == 0, F.array(F.lit("x"), F.lit("blur_detected"))).alias("quality_flags"), F.when(q % 7 == 0, "stnk_full_page").alias("force_strategy"), F.upper(F.when(F.upper(kind) != "AUTO", kind).otherwise("KTP")).alias("document_type"),
        F.when(p % 3 == 0, "approved_for_auto").otherwise("needs_review").alias("decision"), F.when(p % 4 != 0, F.array(F.lit("ktp_auto_missing:nama:x"))).alias("reason_codes"),
        F.create_map(F.lit("nomor_rangka"), field).alias("fields"), F.when(q > 5, q).alias("n_tokens"),
        F.when(p % 6 == 0, "UNKNOWN").otherwise("KTP").alias("detected_type"), F.array().cast("array<string>").alias("warnings"), F.when(q % 11 != 0, (p % 10).cast("double")).alias("score"), F.lit("full_page").alias("strategy"), F.lit(1280).alias("max_side"),
    )


@query(_ATTEMPTS_SQL + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN q % 11 <> 0 THEN p % 10 ELSE -1 END DESC, attempt_index, p % 6 = 0, p % 3 <> 0, CASE WHEN q > 5 THEN q END NULLS FIRST) AS place, count(*) OVER (PARTITION BY k) AS n FROM a
)
SELECT k AS doc_id, attempt_index::INTEGER AS attempt_index, CASE WHEN w = 1 THEN 'STNK' ELSE 'KTP' END AS document_type, CASE WHEN p % 3 = 0 THEN 'approved_for_auto' ELSE 'needs_review' END AS decision,
  (n - 1)::INTEGER AS retry_count, q > 5 AND w <> 1 AS id_scan, n::INTEGER AS n_attempts FROM r WHERE place = 1
""")
def attempt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that is kept of each order's lines."""
    kept = attempts.select_attempts(_attempts(spark, sf_dir))
    return kept.select("doc_id", "attempt_index", "document_type", "decision", "retry_count", "id_scan", F.size("attempts").alias("n_attempts"))
