"""DuckDB SQL for the numbered queries that SQL can express."""

from lontar.llm import mixture, url_cascade


def _url_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(url_cascade.RULES, key=lambda r: -len(r[0] + r[1]))]
    blocked = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in url_cascade.BLOCKED_HOSTS)
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce({lower.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path
  FROM cut
)
SELECT page_id, host, path,
       CASE {rule} END AS rule,
       CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


def _case(column: str, values: dict, other: str) -> str:
    if not values:
        return other
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in values.items())} ELSE {other} END"


def mixture_sql(documents: str = "documents", weights: dict = mixture.WEIGHTS, budget_percent: int = 60, max_epochs: int = 2, seed: int = 7) -> str:
    """The mixture with one plain window per step."""
    domain = _case("source", {s: f"'{d}'" for d, ss in mixture.DOMAINS.items() for s in ss}, f"'{mixture.OTHER_DOMAIN}'")
    steps = [
        f"""rows AS (
  SELECT doc_id, {domain} AS domain, lang, source, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
         len(regexp_extract_all(coalesce(text, ''), '{mixture.WORD}')) AS n
  FROM {documents}
)""",
        f"leaf AS (SELECT domain, l, s, sum(n)::BIGINT AS tokens, sum(n)::BIGINT * {max_epochs} AS capacity FROM rows GROUP BY ALL)",
        f"b0 AS (SELECT least(sum(tokens)::BIGINT * {budget_percent} // 100, sum(capacity)::BIGINT) AS budget FROM leaf)",
    ]
    path: list[str] = []
    for k, (column, level) in enumerate((("domain", "domain"), ("l", "lang"), ("s", "source")), 1):
        parent, path = ", ".join(path), [*path, column]
        by = f"PARTITION BY {parent}" if parent else ""
        order = f"{by} ORDER BY ratio, {column}"
        keys = ", ".join(path)
        steps += [
            f"n{k} AS (SELECT {keys}, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens, ({_case(column, weights.get(level, {}), '1')})::BIGINT AS w FROM leaf GROUP BY {keys})",
            f"r{k} AS (SELECT n{k}.*, budget, CASE WHEN w = 0 THEN 1e300 ELSE capacity::DOUBLE / w END AS ratio FROM n{k} " + (f"JOIN b{k - 1} USING ({parent}))" if parent else f"CROSS JOIN b{k - 1})"),
            f"f{k} AS (SELECT *, w > 0 AND capacity * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM r{k})",
            f"b{k} AS (SELECT {keys}, tokens, (CASE WHEN is_full THEN capacity ELSE coalesce((budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0))::BIGINT * w // nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by})::BIGINT, 0), 0) END)::BIGINT AS budget FROM f{k})",
        ]
    steps += [
        "e AS (SELECT domain, l, s, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b3)",
        f"k AS (SELECT rows.*, epochs, rest, md5('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM rows JOIN e USING (domain, l, s))",
        "c AS (SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY key) AS upto FROM k)",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies
FROM c WHERE epochs > 0 OR (rest > 0 AND upto <= rest)
"""


TOP_PRODUCTS = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), placed AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM placed WHERE rank <= 10
"""

FILL_MIDDLE = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
hashed AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         list_transform([1, 9, 17, 25], lambda k: ('0x' || digest[k : k + 7])::BIGINT) AS h
  FROM rows
), ranked AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, h[1] % (len(units) + 1) AS a, h[2] % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1 : least(a, b)], '') AS p,
         array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1 : n], '') AS s
  FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), places AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM places GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM places JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v AS total
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN counts c USING (lang, source, term)
), shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)::HUGEINT) // total::HUGEINT AS p FROM cells),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang) AS total FROM shares GROUP BY lang, term),
lang_shares AS (SELECT lang, term, 1 + (1000000000 * (n + 1)::HUGEINT) // total::HUGEINT AS q FROM whole),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 200
"""

ORACLE_SQL = {
    "op2_bit_sliced_topk": TOP_PRODUCTS,
    "op5_url_filter": _url_sql(),
    "op8_mixture": mixture_sql(),
    "op11_fill_in_middle": FILL_MIDDLE,
    "op13_source_divergence": DIVERGENCE,
}
