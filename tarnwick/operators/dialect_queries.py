"""Queries in the dialect over the star schema: (text, SQL that gives the same; None: the text itself is plain SQL)."""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"

QUERIES: dict[str, tuple[str, str | None]] = {
    # scans and sources
    "scan_table": ("SELECT * FROM nation", None),
    "scan_point": ("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77", None),
    "scan_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1200", None),
    "scan_in_list": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 1400, 999999)", None),
    "values_source": ("VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(column1, column2)"),
    "values_derived": ("SELECT v.k, v.t FROM (VALUES (1, 'x'), (2, 'y')) AS v (k, t) WHERE v.k > 1", None),
    "no_from": ("SELECT 1 + 2 AS a, 'x' AS b", None),
    "empty": ("SELECT n_name FROM nation WHERE 1 = 0", None),
    "count_all": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "min_max": ("SELECT MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, MIN(l_quantity) AS q FROM lineitem", None),
    "derived_table": ("SELECT d.k, d.n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS d (k, n) WHERE d.n > 15", None),
    # projection, filters, predicates
    "project_alias": ("SELECT c_custkey AS id, c_acctbal * 2 AS twice, c_name FROM customer", None),
    "star_beside_items": ("SELECT n.*, n_nationkey + 1 AS next_key FROM nation n", None),
    "filter_and_or_not": ("SELECT p_partkey FROM part WHERE NOT p_size > 10 AND (p_brand = 'Brand#11' OR p_retailprice > 1500) OR p_size = 50", None),
    "comparisons": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity <> 20 AND l_quantity != 30 AND l_discount < 0.05 AND l_tax <= 0.06 AND l_linenumber > 1", None),
    "is_null": ("SELECT COUNT(*) AS n FROM (SELECT NULLIF(o_orderstatus, 'F') AS s FROM orders) AS t WHERE s IS NULL OR s IS NOT NULL AND s = 'O'", None),
    "between_not": ("SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 450000", None),
    "not_in_null": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 2, NULL)", None),
    "three_valued": (
        "SELECT k, (v > 2) AS gt, (v > 2 AND k > 1) AS a, (v > 2 OR k > 1) AS o, NOT (v > 2) AS n FROM (VALUES (1, NULL), (2, 3), (3, 1)) AS t (k, v)",
        None,
    ),
    "like_any_case": ("SELECT c_custkey FROM customer WHERE c_name LIKE 'CUSTOMER#%7_'", "SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER#%7_'"),
    "like_escape": ("SELECT t FROM (VALUES ('a%b'), ('aXb'), ('A%B'), ('a\nb')) AS v (t) WHERE t LIKE 'a!%b' ESCAPE '!' OR t NOT LIKE 'a_b'", "SELECT t FROM (VALUES ('a%b'), ('aXb'), ('A%B'), (concat('a', chr(10), 'b'))) v(t) WHERE t ILIKE 'a!%b' ESCAPE '!' OR t NOT ILIKE 'a_b'"),
    "glob": ("SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*[A-M]???*' AND p_brand GLOB 'Brand#[!1]?'", None),
    "arithmetic": ("SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 2 AS b, l_quantity * 3 AS c, l_quantity / 4 AS d, - l_linenumber AS e, l_orderkey % 7 AS f FROM lineitem", None),
    "divide_by_zero": ("SELECT n_nationkey / n_regionkey AS q, n_nationkey % n_regionkey AS r, n_nationkey FROM nation", "SELECT n_nationkey / NULLIF(n_regionkey, 0) AS q, CAST(n_nationkey % NULLIF(n_regionkey, 0) AS BIGINT) AS r, n_nationkey FROM nation"),
    "bitwise": ("SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS o, ~ n_nationkey AS t, n_nationkey << 3 AS l, n_nationkey >> 1 AS r FROM nation", "SELECT n_nationkey, CAST(n_nationkey & 6 AS BIGINT) AS a, CAST(n_nationkey | 9 AS BIGINT) AS o, CAST(~ n_nationkey AS BIGINT) AS t, CAST(n_nationkey << 3 AS BIGINT) AS l, CAST(n_nationkey >> 1 AS BIGINT) AS r FROM nation"),
    "concat_operator": ("SELECT c_name || '/' || c_mktsegment AS t, c_custkey FROM customer", None),
    "text_plus": ("SELECT 'n: ' + n_name AS t FROM nation", "SELECT 'n: ' || n_name AS t FROM nation"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders", None),
    "case_simple_null": ("SELECT k, CASE v WHEN NULL THEN 'none' WHEN 1 THEN 'one' ELSE 'other' END AS t FROM (VALUES (1, NULL), (2, 1), (3, 5)) AS x (k, v)", "SELECT k, CASE WHEN v IS NULL THEN 'none' WHEN v = 1 THEN 'one' ELSE 'other' END AS t FROM (VALUES (1, NULL), (2, 1), (3, 5)) x(k, v)"),
    "iif": ("SELECT c_custkey, IIF(c_acctbal > 0, 'pos', 'neg') AS s, IIF(NULL, 1, 2) AS n FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS s, 2 AS n FROM customer"),
    "cast_lenient": ("SELECT CAST('12' AS BIGINT) AS a, CAST('x' AS BIGINT) AS b, CAST('2.5' AS DOUBLE) AS c, CAST(o_orderkey AS TEXT) AS d FROM orders", "SELECT CAST(12 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(2.5 AS DOUBLE) AS c, CAST(o_orderkey AS VARCHAR) AS d FROM orders"),
    "collate": ("SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'", "SELECT COUNT(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "typed_literals": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP'1995-01-01 00:00:00' AND o_orderdate < DATE'1995-03-01'", None),
    "hex_literal": ("SELECT 0x1F AS h, HEX(x'0aff') AS b", "SELECT 31 AS h, '0AFF' AS b"),
    # joins
    "join_group_having": (
        "SELECT c.c_custkey, c.c_name, COUNT(o.o_orderkey) AS order_count, ROUND(SUM(o.o_totalprice), 2) AS total FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name HAVING COUNT(o.o_orderkey) > 5",
        None,
    ),
    "join_left": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "join_right": ("SELECT l.doc_id, l.toxic, d.lang FROM documents d RIGHT OUTER JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en'", None),
    "join_full": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT * FROM nation WHERE n_nationkey < 15) AS a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 9) AS b ON a.n_nationkey = b.n_nationkey", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey", None),
    "join_residual": ("SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate", None),
    "join_null_keys": ("SELECT a.k, b.w FROM (VALUES (1, 'a'), (NULL, 'b'), (3, 'c')) AS a (k, v) LEFT JOIN (VALUES (1, 'x'), (NULL, 'y')) AS b (k, w) ON a.k = b.k", None),
    "join_comma": ("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey > 1", None),
    "join_four": (
        f"SELECT n.n_name, ROUND(SUM({REVENUE}), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        None,
    ),
    "lateral_top": ("SELECT n.n_name, t.c_custkey FROM nation n, LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_custkey LIMIT 2) AS t", None),
    "cross_apply": ("SELECT n.n_name, t.m FROM nation n CROSS APPLY (SELECT MAX(s.s_acctbal) AS m FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS t", "SELECT n.n_name, t.m FROM nation n, LATERAL (SELECT MAX(s.s_acctbal) AS m FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t"),
    "outer_apply": (
        "SELECT r.r_name, t.n_name FROM region r OUTER APPLY (SELECT n.n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20 ORDER BY n.n_name LIMIT 1) AS t",
        "SELECT r.r_name, t.n_name FROM region r LEFT JOIN LATERAL (SELECT n.n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20 ORDER BY n.n_name LIMIT 1) t ON true",
    ),
    # subqueries
    "scalar_subquery": ("SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r, (SELECT COUNT(*) FROM region) AS n FROM nation", None),
    "scalar_correlated": ("SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT AVG(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)", None),
    "exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15)", None),
    "not_in_subquery": ("SELECT COUNT(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", None),
    "any_filter": ("SELECT n_name FROM nation WHERE n_nationkey > ANY (SELECT n_regionkey * 5 FROM nation WHERE n_regionkey > 1)", None),
    "all_filter": ("SELECT n_name FROM nation WHERE n_nationkey >= ALL (SELECT r_regionkey * 3 FROM region)", None),
    "any_all_values": ("SELECT k, k = ANY (SELECT v FROM (VALUES (1), (NULL)) AS s (v)) AS a, k <> ALL (SELECT v FROM (VALUES (1), (NULL)) AS s (v)) AS b FROM (VALUES (1), (2), (NULL)) AS t (k)", None),
    # aggregation
    "group_by": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_by_expression": ("SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1"),
    "global_aggregate": ("SELECT COUNT(*) AS n, SUM(o_totalprice) IS NULL AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", None),
    "having": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) BETWEEN 200000 AND 300000 AND COUNT(*) >= 5", None),
    "aggregate_expression": ("SELECT o_orderstatus, CAST(SUM(o_totalprice) / COUNT(*) AS BIGINT) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(trunc(SUM(o_totalprice) / COUNT(*)) AS BIGINT) AS a FROM orders GROUP BY o_orderstatus"),
    "hidden_group_keys": ("SELECT COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority", None),
    "count_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS c, COUNT(NULLIF(o_orderstatus, 'F')) AS nn, SUM(DISTINCT o_custkey % 10) AS s FROM orders", "SELECT COUNT(DISTINCT o_custkey) AS c, COUNT(NULLIF(o_orderstatus, 'F')) AS nn, CAST(SUM(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM orders"),
    "group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name) AS g, GROUP_CONCAT(n_name, ' | ') AS h FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS g, string_agg(n_name, ' | ' ORDER BY n_name) AS h FROM nation GROUP BY n_regionkey"),
    "aggregate_aliases": ("SELECT AVERAGE(n_nationkey) AS a, MINIMUM(n_name) AS b, MAXIMUM(n_name) AS c FROM nation", "SELECT AVG(n_nationkey) AS a, MIN(n_name) AS b, MAX(n_name) AS c FROM nation"),
    "group_nulls": ("SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)", None),
    # windows
    "window_ranking": (
        "SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber) AS rn, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rk, DENSE_RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS dr FROM lineitem",
        None,
    ),
    "window_ntile": ("SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders", None),
    "window_distribution": ("SELECT n_nationkey, PERCENT_RANK() OVER (ORDER BY n_regionkey) AS p, CUME_DIST() OVER (ORDER BY n_regionkey DESC) AS c FROM nation", None),
    "window_values": (
        "SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
        None,
    ),
    "window_lag_lead": ("SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_totalprice - LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders", None),
    "window_aggregates": (
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS s, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS a, MIN(o_orderdate) OVER (PARTITION BY o_custkey) AS lo, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM orders",
        None,
    ),
    "window_frames": (
        "SELECT n_nationkey, SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, COUNT(*) OVER (ORDER BY n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, SUM(n_nationkey) OVER (ORDER BY n_regionkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 FOLLOWING AND 4 FOLLOWING) AS d FROM nation",
        "SELECT n_nationkey, CAST(SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS a, COUNT(*) OVER (ORDER BY n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, CAST(SUM(n_nationkey) OVER (ORDER BY n_regionkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS c, CAST(SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 FOLLOWING AND 4 FOLLOWING) AS BIGINT) AS d FROM nation",
    ),
    "window_null_order": (
        "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2), n_nationkey) AS a, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey) AS d FROM nation",
        "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) NULLS LAST, n_nationkey) AS a, ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC NULLS FIRST, n_nationkey) AS d FROM nation",
    ),
    "window_count_distinct": ("SELECT o_orderkey, COUNT(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders", None),
    # sort, limit, distinct
    "order_by": ("SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_name", None),
    "order_by_position": ("SELECT n_regionkey AS r, n_name FROM nation ORDER BY 1 DESC, 2 ASC NULLS LAST", None),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "offset_alone": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "limit_negative": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT -1", "SELECT n_nationkey FROM nation"),
    "top_n": ("SELECT TOP 7 o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    # set operations and CTEs
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region", None),
    "intersect": ("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "intersect_all": ("SELECT n_regionkey AS x FROM nation INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey > 10", None),
    "except_all": ("SELECT n_regionkey AS x FROM nation EXCEPT ALL SELECT r_regionkey FROM region", None),
    "set_left_to_right": ("SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 3", "(SELECT 1 AS x UNION SELECT 2) INTERSECT SELECT 3"),
    "set_parenthesised": ("(SELECT n_name AS x FROM nation ORDER BY n_name LIMIT 3) UNION ALL (SELECT r_name FROM region ORDER BY r_name DESC LIMIT 2) ORDER BY x LIMIT 4", None),
    "cte": ("WITH big (k, t) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE t > 1000000) SELECT c.c_name FROM customer c JOIN top ON c.c_custkey = top.k", None),
    "cte_recursive": ("WITH RECURSIVE r (n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT n, f FROM r", None),
    "cte_hierarchy": (
        "WITH RECURSIVE tree (id, depth) AS (SELECT t.id, 0 FROM (VALUES (1, NULL), (2, 1), (3, 1), (4, 2), (5, 4)) AS t (id, parent) WHERE t.parent IS NULL UNION ALL SELECT c.id, tree.depth + 1 FROM (VALUES (1, NULL), (2, 1), (3, 1), (4, 2), (5, 4)) AS c (id, parent) JOIN tree ON c.parent = tree.id) SELECT id, depth FROM tree",
        None,
    ),
    # scalar functions
    "fn_numeric": (
        "SELECT c_custkey, ABS(c_acctbal) AS a, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, ROUND(c_acctbal, 1) AS r, TRUNC(c_acctbal) AS t, SIGN(c_acctbal) AS s, ROUND(SQRT(ABS(c_acctbal)), 6) AS q, POWER(2, c_nationkey) AS p, MOD(c_custkey, 7) AS m FROM customer",
        "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(FLOOR(c_acctbal) AS DOUBLE) AS f, CAST(CEIL(c_acctbal) AS DOUBLE) AS c, round_even(c_acctbal, 1) AS r, CAST(TRUNC(c_acctbal) AS DOUBLE) AS t, CAST(SIGN(c_acctbal) AS INTEGER) AS s, ROUND(SQRT(ABS(c_acctbal)), 6) AS q, POWER(2, c_nationkey) AS p, CAST(c_custkey % 7 AS BIGINT) AS m FROM customer",
    ),
    "fn_round_even": ("SELECT ROUND(0.5) AS a, ROUND(1.5) AS b, ROUND(2.5) AS c, ROUND(-2.5) AS d, TRUNC(-1.987, 2) AS e", "SELECT 0e0 AS a, 2e0 AS b, 2e0 AS c, -2e0 AS d, -1.98e0 AS e"),
    "fn_logs": ("SELECT p_partkey, ROUND(EXP(p_size / 10), 6) AS e, ROUND(LN(p_size), 6) AS l, ROUND(LOG10(p_size), 6) AS t, ROUND(LOG2(p_size), 6) AS b, ROUND(PI(), 6) AS p FROM part", None),
    "fn_trigonometry": (
        "SELECT n_nationkey, ROUND(SIN(n_nationkey), 9) AS s, ROUND(COS(n_nationkey), 9) AS c, ROUND(ATAN(n_nationkey), 9) AS t, ROUND(ATAN2(n_nationkey, 2), 9) AS a2, ROUND(ASIN(n_regionkey / 10), 9) AS a, ROUND(ACOS(n_regionkey / 10), 9) AS ac, ROUND(TAN(n_nationkey), 6) AS tn, ROUND(DEGREES(n_nationkey), 6) AS d, ROUND(RADIANS(n_nationkey), 9) AS r FROM nation",
        None,
    ),
    "fn_string": (
        "SELECT c_custkey, LENGTH(c_name) AS l, UPPER(c_name) AS u, LOWER(c_name) AS lo, SUBSTR(c_name, 3, 4) AS s, SUBSTRING(c_name, -2, 3) AS s2, LEFT(c_name, 4) AS le, RIGHT(c_name, 3) AS ri, INSTR(c_name, '#') AS i, REVERSE(c_name) AS rv, REPLACE(c_name, '0', 'o') AS rp FROM customer",
        "SELECT c_custkey, CAST(LENGTH(c_name) AS INTEGER) AS l, UPPER(c_name) AS u, LOWER(c_name) AS lo, SUBSTR(c_name, 3, 4) AS s, SUBSTR(c_name, 1, 3) AS s2, LEFT(c_name, 4) AS le, RIGHT(c_name, 3) AS ri, CAST(INSTR(c_name, '#') AS INTEGER) AS i, REVERSE(c_name) AS rv, REPLACE(c_name, '0', 'o') AS rp FROM customer",
    ),
    "fn_pad_repeat": ("SELECT n_name, LPAD(n_name, 20, 'xy') AS a, RPAD(n_name, 4, '-') AS b, REPEAT('ab', n_regionkey) AS c, '[' || SPACE(2) || ']' AS d FROM nation", "SELECT n_name, LPAD(n_name, 20, 'x') AS a, RPAD(n_name, 4, '-') AS b, REPEAT('ab', n_regionkey) AS c, '[  ]' AS d FROM nation"),
    "fn_trim_concat": ("SELECT TRIM('  a b ') AS a, LTRIM('  x ') AS b, RTRIM('  y  ') AS c, CONCAT('a', 1, 'b') AS d, CONCAT_WS('-', 'a', 'b') AS e, CONCAT_WS('-', 'a', NULL) AS f, CONCAT('a', NULL) AS g, POSITION('c', 'abc') AS h", "SELECT 'a b' AS a, 'x ' AS b, '  y' AS c, 'a1b' AS d, 'a-b' AS e, CAST(NULL AS VARCHAR) AS f, CAST(NULL AS VARCHAR) AS g, 3 AS h"),
    "fn_octets": ("SELECT doc_id, OCTET_LENGTH(text) AS b, CHAR_LENGTH(text) AS c FROM documents", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS b, CAST(length(text) AS INTEGER) AS c FROM documents"),
    "fn_format": ("SELECT c_custkey, FORMAT(c_acctbal, 'F2') AS f, FORMAT(c_custkey, 'D6') AS d FROM customer", "SELECT c_custkey, printf('%.2f', c_acctbal) AS f, printf('%06d', c_custkey) AS d FROM customer WHERE true"),
    "fn_date_parts": (
        "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS m, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s, DAYOFWEEK(ts) AS dw, DAYOFYEAR(ts) AS dy, WEEKOFYEAR(ts) AS w, QUARTER(ts) AS q, DATE(ts) AS dt FROM events",
        "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(dayofweek(ts) + 1 AS INTEGER) AS dw, CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(weekofyear(ts) AS INTEGER) AS w, CAST(quarter(ts) AS INTEGER) AS q, CAST(ts AS DATE) AS dt FROM events",
    ),
    "fn_date_arithmetic": (
        "SELECT o_orderkey, DATEADD(month, 1, o_orderdate) AS a, DATEADD(day, -3, o_orderdate) AS b, DATEADD(hh, 5, o_orderdate) AS c, DATEDIFF(year, o_orderdate, TIMESTAMP'2000-06-15 00:00:00') AS y, DATEDIFF(month, o_orderdate, TIMESTAMP'2000-06-15 00:00:00') AS m, DATEDIFF(day, o_orderdate, TIMESTAMP'2000-06-15 12:00:00') AS d FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 3 DAY AS b, o_orderdate + INTERVAL 5 HOUR AS c, CAST(2000 - year(o_orderdate) AS BIGINT) AS y, CAST((2000 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) AS BIGINT) AS m, CAST(trunc(epoch(TIMESTAMP '2000-06-15 12:00:00' - o_orderdate) / 86400) AS BIGINT) AS d FROM orders",
    ),
    "fn_strftime": ("SELECT event_id, STRFTIME('%Y-%m-%d %H:%M:%S', ts) AS a, STRFTIME('%j', ts) AS j FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%j') AS j FROM events"),
    "fn_make": ("SELECT n_nationkey, MAKEDATE(2024, n_nationkey + 50) AS d, TOTAL_MINUTES(MAKETIME(n_regionkey, 30, 15)) AS t FROM nation", "SELECT n_nationkey, CAST(DATE '2024-01-01' + CAST(n_nationkey + 49 AS INTEGER) AS DATE) AS d, (n_regionkey * 3600 + 30 * 60 + 15) / 60e0 AS t FROM nation"),
    "fn_nulls": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 2), -1) AS a, IFNULL(NULLIF(n_name, 'x'), 'y') AS b, NVL(NULL, 'z') AS c FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 2), -1) AS a, n_name AS b, 'z' AS c FROM nation"),
    "fn_convert": ("SELECT TOINT('7') AS a, TOINT('x') AS b, TOREAL('2.5') AS c, TOBOOL('true') AS d, TOSTRING(12) AS e, HEX('AB') AS f, BASE64('abc') AS g, TYPEOF(1) AS h, TYPEOF('a') AS i, TYPEOF(2.5) AS j, CONVERT('9', 'INT') AS k", "SELECT CAST(7 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 2.5e0 AS c, true AS d, '12' AS e, '4142' AS f, 'YWJj' AS g, 'Integer' AS h, 'Text' AS i, 'Real' AS j, CAST(9 AS BIGINT) AS k"),
    "json_read": (
        "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, JSON_VALUE(props, '$.k') AS v, JSON_QUERY(props, '$.k') AS q, JSON_TYPE(props) AS t, JSON_VALID(props) AS ok FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS v, CAST(NULL AS VARCHAR) AS q, 'object' AS t, json_valid(props) AS ok FROM events",
    ),
    "json_nested": (
        """SELECT JSON_EXTRACT(j, '$.a.b') AS x, JSON_EXTRACT(j, '$.c[1]') AS y, JSON_ARRAY_LENGTH(j, '$.c') AS n, JSON_TYPE(j, '$.c') AS t, JSON_TYPE(j, '$.z') AS z, JSON_QUERY(j, '$.a') AS q FROM (VALUES ('{"a":{"b":5},"c":[1,2,3],"z":null}')) AS v (j)""",
        """SELECT '5' AS x, '2' AS y, 3 AS n, 'array' AS t, 'null' AS z, '{"b":5}' AS q""",
    ),
    "json_write": (
        """SELECT JSON_SET(j, '$.a', 2) AS s, JSON_INSERT(j, '$.a', 9, '$.n', 'x') AS i, JSON_REPLACE(j, '$.a', 3, '$.q', 4) AS r, JSON_REMOVE(j, '$.a') AS d, JSON_ARRAY(1, 'b', NULL) AS arr, JSON_OBJECT('k', 1, 't', 'v') AS o FROM (VALUES ('{"a":1,"b":{"c":2}}')) AS v (j)""",
        """SELECT '{"a":2,"b":{"c":2}}' AS s, '{"a":1,"b":{"c":2},"n":"x"}' AS i, '{"a":3,"b":{"c":2}}' AS r, '{"b":{"c":2}}' AS d, '[1,"b",null]' AS arr, '{"k":1,"t":"v"}' AS o""",
    ),
    "json_group": ("SELECT JSON_VALUE(props, '$.k') AS k, COUNT(*) AS n FROM events GROUP BY JSON_VALUE(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS k, COUNT(*) AS n FROM events GROUP BY 1"),
}
