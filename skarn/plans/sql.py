"""DuckDB text of the adapters and text primitives, for the oracle queries."""

from __future__ import annotations

SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SEPARATORS = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff},，。、；;：:!！?？\-_/\\]+"
SUB = "['網頁','爬蟲','動態','簡報','股票','語音','影片','圖片','文件','測試','數據','資料','自動化','量化','視覺']"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{SPACE}+', ' ', 'g'))"


def tokens(normed: str) -> str:
    """Distinct tokens with sub-keywords, as a list without an order."""
    words = f"list_filter(regexp_split_to_array({normed}, '{SEPARATORS}'), lambda t: t <> '')"
    return f"list_distinct(list_concat({words}, list_filter({SUB}, lambda k: contains({normed}, k))))"


def squeezed(normed: str) -> str:
    return f"regexp_replace({normed}, '{SPACE}+', '', 'g')"


def bigrams(z: str) -> str:
    """Distinct bigrams of a column without white space (a column, not an expression: it is read for each of them)."""
    return f"CASE WHEN length({z}) < 2 THEN [{z}] ELSE list_distinct(list_transform(range(1, length({z})), lambda i: {z}[i : i + 1])) END"


def round_to(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


TOOLS = """tools AS (
    SELECT 'part-' || p_partkey AS id, p_name AS name, 'https://github.com/' || replace(lower(p_brand), '#', '-') || '/' || replace(p_name, ' ', '-') AS url,
        p_name || ' ' || p_type || ' ' || p_brand AS description, p_type AS cat, lower(p_brand) AS language,
        CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN string_split(p_name, ' ') ELSE list_append(string_split(p_name, ' '), lower(p_type)) END AS triggers,
        CASE WHEN p_partkey % 10 = 0 THEN 'deprecated' WHEN p_partkey % 10 = 1 THEN 'experimental' ELSE 'active' END AS status,
        CASE WHEN p_size % 3 = 0 THEN [lower(p_type) || '-kit'] ELSE [] END AS capabilities,
        CASE WHEN p_size % 5 <> 0 THEN 'rag ' || p_type END AS use_case,
        CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE [] END AS advantages,
        CASE WHEN p_size % 7 = 0 THEN [string_split(p_name, ' ')[1]] ELSE [] END AS negs,
        CAST(floor(p_retailprice * 10) AS BIGINT) AS stars, p_size % 4 = 0 AS has_sub, p_name, p_type, p_brand, CAST(p_partkey AS BIGINT) AS ord
    FROM part)"""
LIVE = "live AS (SELECT * FROM tools WHERE status IN ('active', 'experimental'))"
TRACES = """traces AS (
    SELECT 'part-' || (event_id % (SELECT count(*) FROM part)) AS tool_id, event_type <> 'error' AS success, value AS duration, ts, event_id FROM events)"""
STATS = """stats AS (
    SELECT tool_id, count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS fail, count(*) FILTER (success) / count(*) AS success_rate
    FROM traces GROUP BY tool_id)"""
LOG = """log AS (
    SELECT CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'click' WHEN 'error' THEN 'abandon' END AS type,
        json_extract_string(props, '$.k') AS query, user_id || ':' || json_extract_string(props, '$.k') AS user_query, ts, event_id AS seq
    FROM events WHERE event_type IN ('view', 'click', 'error'))"""
SNAPS = """snaps AS (
    SELECT week, full_name, CAST(sum(n) OVER (PARTITION BY full_name ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stars
    FROM (SELECT strftime(o_orderdate, '%G-W%V') AS week, n_name AS full_name, count(*) AS n
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2))"""


def query_row(text: str) -> str:
    """One query as a table q (nq, toks)."""
    n = norm(f"'{text}'")
    return f"q AS (SELECT {n} AS nq, {tokens(n)} AS toks)"


def keyword(of: str = "") -> str:
    """Second-tier scores of live over q, as table l2 (id, ord, score, neg); of: a column of q that tells queries apart, and a comma."""
    hits = lambda c, least=2: f"len(list_filter(toks, lambda k: length(k) >= {least} AND contains({c}, k)))"
    trigger = f"list_sum(list_transform(triggers, lambda g: (CASE WHEN contains(nq, {norm('g')}) THEN 3.0 ELSE 0.0 END) + 1.5 * len(list_filter(toks, lambda k: length(k) >= 2 AND contains({norm('g')}, k)))))"
    each = lambda c: f"coalesce(list_sum(list_transform({c}, lambda g: len(list_filter(toks, lambda k: length(k) >= 2 AND contains({norm('g')}, k))))), 0)"
    union = f"len(list_filter(toks, lambda k: (length(k) >= 2 AND contains({norm('p_name')}, k)) OR (length(k) >= 3 AND contains({norm('p_type')}, k))))"
    sub = f"CASE WHEN has_sub AND {union} >= (CASE WHEN len(toks) > 1 THEN len(toks) ELSE 1 END) THEN least(6.0, 1.5 * {hits(norm('p_name'))} + {hits(norm('p_type'), 3)}) ELSE 0.0 END"
    return f"""s AS (SELECT {of}id, ord, {trigger} + 2 * {hits(norm('cat'))} + {hits(norm('description'))} + 1.5 * {each('capabilities')} + 2 * {hits(norm('use_case'))} + 2 * {each('advantages')} + {sub} AS raw,
            len(list_filter(negs, lambda g: length({norm('g')}) >= 2 AND contains(nq, {norm('g')}))) > 0 AS neg,
            4.5 * len(triggers) + 7 + 2 * len(capabilities) + CASE WHEN has_sub THEN 6 ELSE 0 END AS most,
            len(list_filter(toks, lambda k: length(k) >= 2 AND (contains({norm('cat')}, k) OR contains({norm('description')}, k)))) AS n_matched FROM live, q),
        l2 AS (SELECT {of}id, ord, CASE WHEN neg THEN 0.01 ELSE {round_to('least(raw / most, 0.99)', 2)} END AS score, neg, n_matched FROM s WHERE raw > 0 OR neg)"""


def semantic(docs: str, synonyms: str = "") -> str:
    """Third-tier scores over table docs (id, ord, text) for q, as table l3 (id, ord, c, cos, dice). synonyms: VALUES of term and synonym."""
    n = norm("text")
    more = f" UNION SELECT {norm('synonym')} FROM (SELECT unnest(toks) AS token FROM q) JOIN (VALUES {synonyms}) y(term, synonym) ON token = term" if synonyms else ""
    return f"""d0 AS (SELECT id, ord, {n} AS t FROM {docs}), dn AS (SELECT *, {squeezed('t')} AS z FROM d0), q0 AS (SELECT {squeezed('nq')} AS z FROM q),
        dt AS (SELECT id, unnest({tokens('t')}) AS token FROM dn),
        df AS (SELECT token, ln(((SELECT count(*) FROM dn) + 1) / (count(*) + 1)) + 1 AS idf FROM dt GROUP BY token),
        dl AS (SELECT id, sqrt(sum(idf * idf)) AS dn FROM dt JOIN df USING (token) GROUP BY id),
        qt AS (SELECT token, coalesce(idf, 1.0) AS qw FROM (SELECT unnest(toks) AS token FROM q{more}) LEFT JOIN df USING (token)),
        ql AS (SELECT sqrt(sum(qw * qw)) AS qn FROM qt),
        co AS (SELECT id, sum(qw * qw) / ((SELECT qn FROM ql) * any_value(dl.dn)) AS cos FROM dt JOIN qt USING (token) JOIN dl USING (id) GROUP BY id),
        dg AS (SELECT id, {bigrams('z')} AS g FROM dn), qg AS (SELECT {bigrams('z')} AS h FROM q0),
        di AS (SELECT id, 2.0 * len(list_intersect(g, h)) / (len(g) + len(h)) AS dice FROM dg, qg),
        l3 AS (SELECT id, ord, coalesce(cos, 0) AS cos, coalesce(dice, 0) AS dice, 0.6 * coalesce(cos, 0) + 0.4 * coalesce(dice, 0) AS c
               FROM dn LEFT JOIN co USING (id) LEFT JOIN di USING (id) WHERE 0.6 * coalesce(cos, 0) + 0.4 * coalesce(dice, 0) >= 0.03)"""


TOOL_TEXT = """texts AS (
    SELECT id, ord, substr(name || ' ' || name || ' ' || name || ' ' || array_to_string(triggers, ' ') || ' ' || array_to_string(triggers, ' ') || ' ' || description || ' ' || cat || ' ' || cat || ' ' ||
        replace(array_to_string(capabilities, ' '), '-', ' ') || coalesce(' ' || use_case, '') || ' ' || array_to_string(advantages, ' ') || CASE WHEN has_sub THEN ' ' || p_name || ' ' || p_type ELSE '' END, 1, 3000) AS text FROM live)"""


def best(text: str, k: int, rerank: str) -> str:
    """rank, id, score of the best k live tools for a query without telemetry; rerank: the final score from post and stars."""
    return f"""WITH {TOOLS}, {LIVE}, {query_row(text)}, {keyword()}, {TOOL_TEXT}, {semantic('texts')},
        e AS (SELECT id, ord, 1.0 AS score, 1.0 AS post, 0 AS tier, 1.0 AS pre FROM live WHERE {norm('name')} = (SELECT nq FROM q) ORDER BY ord LIMIT {k}),
        m AS (SELECT id, ord, score AS post, score AS pre, 0 AS tier FROM l2 UNION ALL
              SELECT id, ord, {round_to(round_to('c', 2) + ' * 0.5', 2)}, {round_to('c', 2)}, 1 FROM l3 WHERE id NOT IN (SELECT id FROM l2)),
        r AS (SELECT m.id, m.ord, {rerank} AS score, post, tier, pre FROM m JOIN live USING (id) WHERE NOT EXISTS (SELECT 1 FROM e)),
        o AS (SELECT *, row_number() OVER (ORDER BY score DESC, post DESC, tier, pre DESC, ord) AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM r))
        SELECT CAST(rank AS INTEGER) AS rank, id, score FROM o WHERE rank <= {k}"""
