"""Declarative queries, each written once for both engines.

Every function takes a dialect and returns a SELECT over the driver's tables.  Group keys
shuffle once each; windows always have a PARTITION BY unless they run over a calendar or
a per-group table of a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from plumbline.plans.dialects import Spark

Statement = Callable[[Spark], str]
DAILY = """SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value * (event_id % 5)) / sum(event_id % 5), 6) AS v, count(*) AS n
FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING sum(event_id % 5) > 0"""


def peak_first_tie(f: Spark) -> str:
    return f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(avg(value) / 10) AS v FROM events GROUP BY 1, 2)
SELECT user_id, max(v) AS peak, {f.text(f.first_at_peak("day", "v"))} AS peak_day FROM d GROUP BY user_id"""


def trapezoid_auc(f: Spark) -> str:
    return f"""WITH d AS ({DAILY}), s AS (SELECT user_id, v, day, lag(v) OVER w AS pv, lag(day) OVER w AS pd FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, CAST(count(*) AS BIGINT) AS points, round(sum({f.days_between("day", "pd")} * (v + pv) / 2), 4) AS auc FROM s GROUP BY user_id"""


def season_gate(f: Spark) -> str:
    return "SELECT o_custkey, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years, count(DISTINCT year(o_orderdate)) > 1 AS mixed FROM orders GROUP BY o_custkey"


def hour_completeness(f: Spark) -> str:
    return """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, CAST(count(DISTINCT hour(ts)) AS BIGINT) AS hours, count(DISTINCT hour(ts)) = 24 AS complete
FROM events GROUP BY event_type, CAST(ts AS DATE)"""


def shifted_cycle_total(f: Spark) -> str:
    return f"""WITH c AS (SELECT event_type, event_id, ts, value, CAST(ts - INTERVAL 1 HOUR AS DATE) AS cycle FROM events)
SELECT event_type, {f.text("cycle")} AS cycle, {f.max_by("value", "ts", "event_id")} AS terminal, CAST(count(*) AS BIGINT) AS steps FROM c GROUP BY event_type, cycle"""


def cycle_decreases(f: Spark) -> str:
    return f"""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, max(value) AS v FROM events GROUP BY 1, 2),
s AS (SELECT event_type, CAST(h - INTERVAL 1 HOUR AS DATE) AS cycle, v, v - lag(v) OVER (PARTITION BY event_type, CAST(h - INTERVAL 1 HOUR AS DATE) ORDER BY h) AS step FROM h)
SELECT event_type, {f.text("cycle")} AS cycle, CAST(sum(CASE WHEN step < -1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS decreases, min(v) >= 0 AS nonnegative FROM s GROUP BY event_type, cycle"""


def degree_days(f: Spark) -> str:
    return f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, min(value) / 10 AS low, max(value) / 10 AS high, count(DISTINCT hour(ts)) >= 22 AS whole FROM events GROUP BY 1, 2)
SELECT event_type, {f.text("day")} AS day, round(CASE WHEN whole THEN greatest((high + low) / 2 - 5, 0) END, 6) AS gdd5, round(CASE WHEN whole THEN greatest((high + low) / 2 - 10, 0) END, 6) AS gdd10,
CASE WHEN whole THEN CAST(high >= 30 AS INT) END AS hot, CASE WHEN whole THEN CAST(low < 0 AS INT) END AS frost FROM d"""


def poisoned_cumulative(f: Spark) -> str:
    return f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT hour(ts)) >= 22 THEN round(sum(value), 6) END AS v FROM events GROUP BY 1, 2)
SELECT event_type, {f.text("day")} AS day, v, CASE WHEN sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN round(sum(v) OVER w, 4) END AS total
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def calendar_scaffold(f: Spark) -> str:
    return f"""WITH e AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
SELECT {f.text("c.d")} AS day, CAST(coalesce(n, 0) AS BIGINT) AS n, total FROM {f.days("2023-12-25", "2024-02-05")} c LEFT JOIN e ON c.d = e.d"""


def coverage_summary(f: Spark) -> str:
    return """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT hour(ts)) >= 22 THEN sum(value) END AS v FROM events GROUP BY 1, 2)
SELECT event_type, CAST(count(*) AS BIGINT) AS days, CAST(count(v) AS BIGINT) AS valid_days, round(CASE WHEN count(*) = count(v) THEN sum(v) END, 4) AS full_total, round(sum(v), 4) AS partial_total FROM d GROUP BY event_type"""


def request_plan(f: Spark) -> str:
    return f"""SELECT {f.format("d", "yyyy")} AS year, {f.format("d", "MM")} AS month, {f.join_sorted(f.format("d", "dd"))} AS days, CAST(count(*) AS BIGINT) AS n FROM {f.days("2024-12-15", "2025-02-10")} c GROUP BY 1, 2"""


def contract_reasons(f: Spark) -> str:
    return """SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'missing' WHEN value <= 0.5 THEN 'not positive' WHEN value > 300 THEN 'too large'
WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown type' WHEN user_id % 10 = 0 THEN 'identity' END AS reason FROM events) r GROUP BY reason"""


def page_gate(f: Spark) -> str:
    return f"""WITH p AS (SELECT {f.div("event_id", "500")} AS page, value <= 0.1 AS bad FROM events)
SELECT CAST(page AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS bad_rows, sum(CASE WHEN bad THEN 1 ELSE 0 END) = 0 AS accepted FROM p GROUP BY page"""


def text_fingerprint_dedup(f: Spark) -> str:
    return f"SELECT {f.sha('text')} AS fingerprint, min(doc_id) AS first_doc, CAST(count(*) - 1 AS BIGINT) AS duplicates FROM documents GROUP BY {f.sha('text')}"


def key_first_writer(f: Spark) -> str:
    return """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS nth FROM lineitem) t WHERE nth = 1"""


def key_last_writer(f: Spark) -> str:
    return f"SELECT user_id, {f.max_by('event_id', 'ts', 'event_id')} AS last_event, {f.max_by('event_type', 'ts', 'event_id')} AS last_type, {f.max_by('value', 'ts', 'event_id')} AS last_value FROM events GROUP BY user_id"


def conditional_upsert(f: Spark) -> str:
    """Stored orders meet what their lines say: the refresh state follows the closed flag."""
    return """WITH stored AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS closed, CASE WHEN o_orderpriority = '1-URGENT' THEN 'pending' WHEN o_orderpriority = '2-HIGH' THEN 'active' ELSE 'none' END AS refresh FROM orders),
incoming AS (SELECT l_orderkey AS k, max(l_linestatus) = 'F' AS closed FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(s.k, i.k) AS k, coalesce(i.closed, s.closed) AS closed, CASE WHEN s.k IS NULL THEN 'none' WHEN i.k IS NULL THEN s.refresh WHEN NOT i.closed THEN 'none'
WHEN NOT s.closed THEN 'pending' ELSE s.refresh END AS refresh, s.k IS NULL AS discovered FROM stored s FULL OUTER JOIN incoming i ON s.k = i.k"""


def work_skip(f: Spark) -> str:
    return "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '1-URGENT')"


def cursor_chain(f: Spark) -> str:
    return """WITH p AS (SELECT user_id, event_id, event_id AS next_cursor, CASE WHEN event_id % 97 = 0 THEN -1 ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS request_cursor FROM events),
c AS (SELECT *, lag(next_cursor) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM p)
SELECT user_id, event_id, request_cursor, expected FROM c WHERE request_cursor IS DISTINCT FROM expected"""


def cursor_cycles(f: Spark) -> str:
    k = f"CAST({f.json('props', '$.k')} AS INT)"
    return f"""WITH p AS (SELECT user_id, event_id, CASE WHEN {k} % 10 = 0 THEN NULL ELSE {k} END AS cur FROM events),
t AS (SELECT *, sum(CASE WHEN prev_null THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS traversal
FROM (SELECT *, coalesce(lag(CASE WHEN cur IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) = 1 AS prev_null FROM p) x)
SELECT user_id, CAST(traversal AS BIGINT) AS traversal, cur, CAST(count(*) AS BIGINT) AS times FROM t WHERE cur IS NOT NULL GROUP BY user_id, traversal, cur HAVING count(*) > 1"""


def identity_reconcile(f: Spark) -> str:
    """Texts of documents and of conversations: each table is read once, and the two sides meet in one aggregate."""
    h = f.sha("text")
    return f"""WITH x AS (SELECT h, max(a) AS a, max(b) AS b FROM (SELECT {h} AS h, 1 AS a, 0 AS b FROM documents UNION ALL SELECT {h} AS h, 0 AS a, 1 AS b FROM conversations) u GROUP BY h)
SELECT CASE WHEN a = 1 THEN 'committed only' ELSE 'indexed only' END AS side, h FROM x WHERE a <> b"""


def orphan_rows(f: Spark) -> str:
    return "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F') GROUP BY l_orderkey"


def latest_checkpoint(f: Spark) -> str:
    return f"SELECT user_id, event_type, {f.max_by('event_id', 'event_id')} AS last_page, {f.max_by('props', 'event_id')} AS cursor_text, CAST(count(*) AS BIGINT) AS pages FROM events GROUP BY user_id, event_type"


def cursor_set_compare(f: Spark) -> str:
    k = f.json("props", "$.k")
    return f"""WITH a AS (SELECT user_id, {f.join_sorted(k)} AS seen FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id), b AS (SELECT user_id, {f.join_sorted(k)} AS held FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, seen, held, seen IS NOT DISTINCT FROM held AS equal FROM a FULL OUTER JOIN b ON a.user_id = b.user_id"""


def category_mapping(f: Spark) -> str:
    return f"""WITH c AS (SELECT doc_id, source, count(*) AS n FROM documents GROUP BY doc_id, source)
SELECT coalesce(nullif({f.text("quality")}, ''), 'UNKNOWN') AS category, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN labels ON c.doc_id = labels.doc_id GROUP BY 1"""


def supplier_region_mapping(f: Spark) -> str:
    return """WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT coalesce(r_name, 'UNKNOWN') AS region, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


def pending_topk(f: Spark) -> str:
    return """SELECT d.doc_id, coalesce(quality, 0) AS last_attempt, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY coalesce(quality, 0), n_chars DESC, d.doc_id LIMIT 60"""


def inventory_stats(f: Spark) -> str:
    figures = f"CAST(count(*) AS BIGINT) AS n, round(min({f.epoch('ts')}), 3) AS first_ts, round(max({f.epoch('ts')}), 3) AS last_ts, CAST(count(DISTINCT user_id) AS BIGINT) AS users"
    return f"SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, {figures} FROM events GROUP BY GROUPING SETS ((event_type), ())"


def quality_gate(f: Spark) -> str:
    return "SELECT event_type, count(*) > 0 AND coalesce(min(CASE WHEN value > 0.02 THEN 1 ELSE 0 END), 0) = 1 AS passed, CAST(sum(CASE WHEN value > 0.02 THEN 0 ELSE 1 END) AS BIGINT) AS failures FROM events GROUP BY event_type"


BOOK = """b AS (SELECT part, side, price, sum(size) AS size FROM (SELECT l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 'bid' ELSE 'ask' END AS side, round(l_extendedprice / l_quantity * CASE WHEN l_returnflag = 'R' THEN 0.03 ELSE 1 END / 1000) AS price, l_quantity AS size
FROM lineitem WHERE l_returnflag IN ('R', 'N')) x GROUP BY part, side, price),
top AS (SELECT part, max(CASE WHEN side = 'bid' THEN price END) AS bid, min(CASE WHEN side = 'ask' THEN price END) AS ask, max_by(CASE WHEN side = 'bid' THEN size END, CASE WHEN side = 'bid' THEN price END) AS bid_size,
min_by(CASE WHEN side = 'ask' THEN size END, CASE WHEN side = 'ask' THEN price END) AS ask_size FROM b GROUP BY part)"""


def top_of_book(f: Spark) -> str:
    return f"WITH {BOOK} SELECT part, bid, ask, bid_size, ask_size, ask - bid AS spread, bid > ask AS crossed FROM top"


def quote_diagnostics(f: Spark) -> str:
    return f"""WITH {BOOK} SELECT part, part % 130 - 5 AS age_seconds, part % 130 - 5 BETWEEN -5 AND 120 AS fresh, CASE WHEN ask IS NULL THEN 'missing or invalid asks' END AS size_diagnostic_error,
5 * ask AS minimum_notional, 100 / nullif(ask, 0) >= 5 AS stake_meets_minimum, ask_size * ask >= 100 AS depth_covers_stake, ask_size >= 5 AS depth_covers_minimum FROM top"""


def final_outcome(f: Spark) -> str:
    position = "array_position(tokens, t)" if f.name == "spark" else "list_position(tokens, t)"
    array = "array" if f.name == "spark" else "list_value"
    pick = "try_element_at(prices, CAST(i AS INT))" if f.name == "spark" else "prices[i]"
    ordered = "array_sort(prices) = array(0, 1)" if f.name == "spark" else "list_sort(prices) = [0, 1]"
    return f"""WITH m AS (SELECT o_orderkey, o_orderstatus = 'F' AS closed, o_orderpriority <> '5-LOW' AS resolved, {array}({f.text("o_custkey % 5")}, {f.text("o_orderkey % 5")}) AS tokens,
{array}(CAST(o_orderkey % 2 AS INT), CAST((o_orderkey + o_custkey % 3) % 2 AS INT)) AS prices, {f.text("o_custkey % 4")} AS t FROM orders),
p AS (SELECT *, {position} AS i FROM m)
SELECT o_orderkey, CASE WHEN closed AND resolved AND tokens[{0 if f.name == "spark" else 1}] <> tokens[{1 if f.name == "spark" else 2}] AND {ordered} AND i > 0 THEN {pick} END AS outcome FROM p"""


def grid_index_stats(f: Spark) -> str:
    if f.name == "spark":
        return """WITH v AS (SELECT vec_id, filter(zip_with(slice(embedding, 1, 32), slice(embedding, 33, 32), (r, n) -> CASE WHEN r >= 0 AND n >= 0 AND r + n > 0 THEN (CAST(n AS double) - r) / (CAST(n AS double) + r) END), x -> x IS NOT NULL) AS x FROM embeddings)
SELECT vec_id, CAST(size(x) AS BIGINT) AS valid, round(aggregate(x, 0D, (a, b) -> a + b) / nullif(size(x), 0), 6) AS mean,
round((get(array_sort(x), CAST(floor((size(x) - 1) / 2) AS INT)) + get(array_sort(x), CAST(floor(size(x) / 2) AS INT))) / 2, 6) AS median FROM v"""
    return """WITH p AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS r, unnest(embedding[33:64])::DOUBLE AS n FROM embeddings), v AS (SELECT vec_id, CASE WHEN r >= 0 AND n >= 0 AND r + n > 0 THEN (n - r) / (n + r) END AS x FROM p)
SELECT vec_id, count(x) AS valid, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM v GROUP BY vec_id"""


def band_scaling(f: Spark) -> str:
    if f.name == "spark":
        return "SELECT vec_id, CAST(size(filter(x, y -> y >= 0)) AS BIGINT) AS valid, round(aggregate(filter(x, y -> y >= 0), 0D, (a, b) -> a + b), 6) AS total FROM (SELECT vec_id, transform(embedding, e -> e * 2D + 0.1D) AS x FROM embeddings)"
    return "SELECT vec_id, count(*) FILTER (WHERE x >= 0) AS valid, round(coalesce(sum(x) FILTER (WHERE x >= 0), 0), 6) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 2 + 0.1 AS x FROM embeddings) GROUP BY vec_id"


def fraction_consistency(f: Spark) -> str:
    return """WITH c AS (SELECT event_id, CAST(user_id % 9 AS double) AS valid, CAST(user_id % 5 AS double) AS geometry, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN (user_id % 9) / CAST(nullif(user_id % 5, 0) AS double) + 1e-7 ELSE 0.5 END AS fraction FROM events),
e AS (SELECT event_id, fraction, valid / nullif(geometry, 0) AS expected FROM c)
SELECT event_id, coalesce(abs(fraction - expected) <= 1e-8 + 1e-5 * abs(expected), fraction IS NULL AND expected IS NULL) AS consistent FROM e"""


def _cube(f: Spark, missing: bool) -> str:
    cell = f"CAST({f.div('i', '8')} AS INT) AS n, CAST(1995 + i % 8 AS INT) AS y, i AS flat"
    return f"""WITH v AS (SELECT (c_nationkey * 8 + (year(o_orderdate) - 1995)) AS flat, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1995 AND 2002 GROUP BY 1)
SELECT n_name AS geo, y AS year, value, value IS NULL AS is_missing FROM (SELECT {cell} FROM {f.series("200")} s) c JOIN nation ON n = n_nationkey {"LEFT" if missing else "INNER"} JOIN v ON v.flat = c.flat"""


def cube_decode_sparse(f: Spark) -> str:
    return _cube(f, True)


def cube_decode_dense(f: Spark) -> str:
    return _cube(f, False)


def cube_product_guard(f: Spark) -> str:
    return "SELECT CAST((SELECT count(*) FROM nation) * (SELECT count(*) FROM region) * (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS BIGINT) AS cells, (SELECT count(*) FROM nation) * (SELECT count(*) FROM region) * (SELECT count(DISTINCT year(o_orderdate)) FROM orders) <= 2000000 AS allowed"


def catalog_dedup_conflict(f: Spark) -> str:
    return f"SELECT source, lang, CAST(count(*) AS BIGINT) AS copies, CAST(count(DISTINCT {f.sha('text')}) AS BIGINT) AS contents, count(DISTINCT {f.sha('text')}) > 1 AS conflicting, min(doc_id) AS first_doc FROM documents GROUP BY source, lang"


def request_keys(f: Spark) -> str:
    key = f.sha("concat('GET', '|', url, '|', '')")
    return f"SELECT page_id, {key} AS request_key FROM pages"


def freshness_window(f: Spark) -> str:
    e = f.epoch("ts")
    return f"WITH a AS (SELECT event_id, (floor({e} / 300) + 1) * 300 - {e} - 180 AS age FROM events) SELECT event_id, round(age, 4) AS age, age BETWEEN -5 AND 120 AS fresh FROM a"


def late_availability(f: Spark) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS cutoff, CAST(sum(CASE WHEN ts <= TIMESTAMP '{c} 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS happened, CAST(sum(CASE WHEN ts <= TIMESTAMP '{c} 00:00:00' AND ts + {f.hours('CAST(event_id % 72 AS INT)')} <= TIMESTAMP '{c} 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS visible FROM events"
        for c in ("2024-01-05", "2024-01-15", "2024-01-25")
    )


def asof_latest_event(f: Spark) -> str:
    """Of each purchase the user's latest earlier error: one ordered pass per user, no range join."""
    error = f.last_known("CASE WHEN event_type = 'error' THEN event_id END")
    return f"""WITH o AS (SELECT user_id, event_id, event_type, {error} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_id FROM events WHERE event_type IN ('purchase', 'error'))
SELECT event_id, user_id, error_id FROM o WHERE event_type = 'purchase'"""


def json_unpack(f: Spark) -> str:
    k = f.try_double(f.json("props", "$.k"))
    return f"SELECT event_type, CAST(count({k}) AS BIGINT) AS numbers, sum({k}) AS total, max({k}) AS largest FROM events GROUP BY event_type"


def decimal_contract(f: Spark) -> str:
    return "SELECT o_orderkey, CAST(o_totalprice / 1000000 AS DECIMAL(18, 4)) BETWEEN 0 AND 0.45 AS in_range FROM orders"


def manifest_contract(f: Spark) -> str:
    return "WITH m AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE concat('m', CAST(c_custkey % 1200 AS VARCHAR(12))) END AS condition FROM customer) SELECT condition, CAST(count(*) AS BIGINT) AS n, trim(condition) = '' AS blank, count(*) > 1 AS repeated FROM m GROUP BY condition HAVING count(*) > 1 OR trim(condition) = ''"


def ledger_audit(f: Spark) -> str:
    return f"""WITH p AS (SELECT {f.div("event_id", "500")} AS page, count(*) AS held FROM events GROUP BY 1), d AS (SELECT page, CASE WHEN page % 4 = 0 THEN 499 ELSE 500 END AS declared FROM p)
SELECT 'page count differs' AS problem, CAST(count(*) AS BIGINT) AS n FROM p JOIN d ON p.page = d.page WHERE held IS DISTINCT FROM declared
UNION ALL SELECT 'row without market', CAST(count(*) AS BIGINT) FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 0)
UNION ALL SELECT 'repeated identity', CAST(count(*) AS BIGINT) FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1) r"""


STATEMENTS: dict[str, Statement] = {
    f.__name__: f
    for f in (
        peak_first_tie, trapezoid_auc, season_gate, hour_completeness, shifted_cycle_total, cycle_decreases, degree_days, poisoned_cumulative, calendar_scaffold, coverage_summary,
        request_plan, contract_reasons, page_gate, text_fingerprint_dedup, key_first_writer, key_last_writer, conditional_upsert, work_skip, cursor_chain, cursor_cycles, identity_reconcile,
        orphan_rows, latest_checkpoint, cursor_set_compare, category_mapping, supplier_region_mapping, pending_topk, inventory_stats, quality_gate, top_of_book, quote_diagnostics, final_outcome,
        grid_index_stats, band_scaling, fraction_consistency, cube_decode_sparse, cube_decode_dense, cube_product_guard, catalog_dedup_conflict, request_keys, freshness_window, late_availability,
        asof_latest_event, json_unpack, decimal_contract, manifest_contract, ledger_audit,
    )
}
