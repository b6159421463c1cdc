"""DuckDB SQL that gives the result of each registered query on the same tables."""

from __future__ import annotations

from workloads.ledgers import MESSY_SQL, RECON_SQL, TEXT_JOURNAL_SQL, journal_sql

ORACLES: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _verdict(a: str, b: str, limit: str = "50000") -> str:
    agree = f"(({a} = 0 AND {b} = 0) OR abs({a} - {b}) <= {limit})"
    return f"""
  CASE WHEN {a} = 0 AND {b} = 0 THEN 'Ambos zero' WHEN abs({a} - {b}) <= {limit} THEN 'Conferem'
       WHEN {a} = 0 THEN 'Apenas B' WHEN {b} = 0 THEN 'Apenas A' ELSE 'Divergência' END AS status,
  CASE WHEN {agree} THEN 'Conciliados' ELSE 'Não conciliados' END AS grp,
  CAST({a} - {b} AS DOUBLE) AS difference"""


def _recon(ordinal: int, name: str, a_key: str, b_key: str, a_value: str = "v", b_value: str = "v") -> str:
    """One key definition of the line items / orders ledgers as a CTE body."""
    return f"""
  SELECT {ordinal} AS key_ordinal, '{name}' AS key_name, key, in_a, in_b, a, b, {_verdict('a', 'b')}
  FROM (
    SELECT coalesce(x.key, y.key) AS key, x.key IS NOT NULL AS in_a, y.key IS NOT NULL AS in_b,
           coalesce(x.t, 0) AS a, coalesce(y.t, 0) AS b
    FROM (SELECT CAST({a_key} AS VARCHAR) AS key, SUM({a_value}) AS t FROM ledger_a GROUP BY 1) x
    FULL JOIN (SELECT CAST({b_key} AS VARCHAR) AS key, SUM({b_value}) AS t FROM ledger_b
               WHERE NOT is_canceled GROUP BY 1) y ON x.key = y.key)"""


_ORDER = _recon(0, "pedido", "l_orderkey", "o_orderkey")
_YEAR = _recon(1, "ano", "ship_year", "order_year")
_ONE = _with(RECON_SQL, f"recon AS ({_ORDER})")
_TWO = _with(RECON_SQL, f"recon AS ({_ORDER} UNION ALL {_YEAR})")
_FOUND = """key_name, key, CAST(a AS DOUBLE) AS value_a, CAST(b AS DOUBLE) AS value_b, status, grp AS "group", difference"""
_RESULT = """CAST(1 AS BIGINT) AS run_id, CAST(NULL AS BIGINT) AS dataset_id, key AS row_identifier, status,
  grp AS group_name, key_name AS key_used, difference, key_ordinal"""

# --- reconcile --------------------------------------------------------------
ORACLES["recon_basic"] = f"{_ONE} SELECT {_FOUND} FROM recon"
ORACLES["recon_multi_key"] = f"{_TWO} SELECT key_ordinal, {_FOUND} FROM recon"
ORACLES["recon_invert"] = _with(
    RECON_SQL, f"recon AS ({_recon(0, 'pedido', 'l_orderkey', 'o_orderkey', b_value='-v')})") + f"SELECT {_FOUND} FROM recon"
ORACLES["recon_presence"] = f"{_ONE} SELECT key, in_a, in_b, status FROM recon"
ORACLES["recon_text_values"] = _with(MESSY_SQL) + f"""
SELECT 'pedido' AS key_name, CAST(k AS VARCHAR) AS key, CAST(a AS DOUBLE) AS value_a, CAST(b AS DOUBLE) AS value_b,
  status, grp AS "group", difference
FROM (SELECT k, a, b, {_verdict('a', 'b', '0')} FROM (
  SELECT k, CASE WHEN k % 8 = 7 THEN 0 ELSE CAST(cents AS DECIMAL(18,2)) / 100 END::DECIMAL(18,2) AS a,
         (CAST(clean_cents AS DECIMAL(18,2)) / 100)::DECIMAL(18,2) AS b FROM messy))"""
ORACLES["recon_resolved_column"] = ORACLES["recon_basic"]
ORACLES["recon_no_value"] = _with(
    RECON_SQL, f"recon AS ({_recon(0, 'pedido', 'l_orderkey', 'o_orderkey', 'v * 0', 'v * 0')})") + f"SELECT {_FOUND} FROM recon"
ORACLES["recon_one_side"] = _with(RECON_SQL) + f"""
SELECT {_FOUND} FROM (SELECT 'pedido' AS key_name, key, a, b, {_verdict('a', 'b')} FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS key, SUM(v) AS a, CAST(0 AS DECIMAL(18,2)) AS b FROM ledger_a GROUP BY 1))"""
ORACLES["recon_summary"] = f"""{_TWO}
SELECT count(*) AS keys_evaluated, count(*) FILTER (grp = 'Conciliados') AS matched_keys,
       count(*) FILTER (grp <> 'Conciliados') AS unmatched_keys FROM recon"""
ORACLES["recon_status_breakdown"] = f"""{_ONE}
SELECT l.position, l.value, l.label, l.description, coalesce(n.keys, 0) AS keys
FROM (VALUES (0, 'Ambos zero', 'Ambos zero', 'Ambos os lados são zero'),
             (1, 'Conferem', 'Conferem', 'Valores coincidem dentro do limite'),
             (2, 'Apenas A', 'Apenas A', 'Presente somente na base A'),
             (3, 'Apenas B', 'Apenas B', 'Presente somente na base B'),
             (4, 'Divergência', 'Divergência', 'Ambos presentes, valores divergentes além do limite'))
     l(position, value, label, description)
LEFT JOIN (SELECT status, count(*) AS keys FROM recon GROUP BY 1) n ON n.status = l.value"""
ORACLES["recon_group_breakdown"] = f"""{_ONE}
SELECT l.position, l.value, l.label, l.description, coalesce(n.keys, 0) AS keys
FROM (VALUES (0, 'Conciliados', 'Conciliados', 'Considerados conciliados'),
             (1, 'Não conciliados', 'Não conciliados', 'Considerados não conciliados'))
     l(position, value, label, description)
LEFT JOIN (SELECT grp, count(*) AS keys FROM recon GROUP BY 1) n ON n.grp = l.value"""
ORACLES["classify_rows"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, status, grp AS group_name
FROM (SELECT *, {_verdict('a', 'b', '1000')} FROM (
  SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(l_quantity * 1500 AS DECIMAL(18,2)) AS b FROM lineitem))"""
_HALF = """half AS (
  SELECT CAST(o_custkey AS VARCHAR) AS key, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderstatus = 'F' END AS canceled,
         CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS DECIMAL(18,2)) AS v FROM orders)"""
ORACLES["side_totals_kept"] = _with(_HALF) + """
SELECT key, CAST(SUM(v) AS DOUBLE) AS total FROM half WHERE canceled IS NULL OR NOT canceled GROUP BY key"""
ORACLES["side_totals_strict"] = _with(_HALF) + """
SELECT key, CAST(SUM(v) AS DOUBLE) AS total FROM half WHERE NOT canceled GROUP BY key"""
ORACLES["missing_order_keys"] = """
WITH a AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS key FROM lineitem),
     b AS (SELECT DISTINCT CAST(o_orderkey + 100 AS VARCHAR) AS key FROM orders)
SELECT key, 'a' AS side FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT key, 'b' FROM b WHERE key NOT IN (SELECT key FROM a)"""

# --- keys and values --------------------------------------------------------
ORACLES["composite_keys"] = """
SELECT o_orderkey, concat_ws('|', CAST(o_custkey AS VARCHAR),
  CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey // 2 AS VARCHAR) ELSE CAST(o_custkey // 2 AS VARCHAR) || '.5' END,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END, '',
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')) AS key
FROM orders"""
ORACLES["number_clean"] = _with(MESSY_SQL) + "SELECT k, clean_cents / 100.0 AS value FROM messy"
ORACLES["truthy_flags"] = _with(MESSY_SQL) + """
SELECT k, coalesce(lower(ind) IN ('1', 'true', 'yes', 'y', 't'), false) AS text_flag,
       coalesce(num <> 0, false) AS number_flag, cents % 2 <> 0 AS odd_flag FROM messy"""
ORACLES["inverted_values"] = _with(MESSY_SQL) + """
SELECT k, -num AS num, CASE WHEN k % 8 = 0 THEN -(cents / 100.0) END AS num_text FROM messy"""
ORACLES["nested_list_value"] = """
SELECT vec_id, CAST(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))[1] AS DOUBLE) AS value FROM embeddings"""
ORACLES["nested_map_value"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS first_value, value AS named_value FROM events"""
ORACLES["dup_column_sum"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       l_extendedprice + CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0.0 END AS value FROM lineitem"""
ORACLES["dup_column_first"] = _with(MESSY_SQL) + "SELECT k, coalesce(num_text, ind, txt) AS value FROM messy"
ORACLES["yes_no_labels"] = _with(MESSY_SQL) + """
SELECT k, CASE WHEN ind IS NULL THEN '' WHEN lower(trim(ind)) IN ('1', 'true', 't', 'y', 'yes', 'sim') THEN 'Sim'
               WHEN lower(trim(ind)) IN ('0', 'false', 'f', 'n', 'no', 'nao', 'não') THEN 'Não' ELSE ind END AS text_label,
       CASE WHEN cents % 2 <> 0 THEN 'Sim' ELSE 'Não' END AS odd_label FROM messy"""
ORACLES["title_labels"] = """
SELECT c_custkey,
  array_to_string(list_transform(list_filter(string_split(c_mktsegment || '_' || upper(c_name), '_'), lambda x: x <> ''),
                                 lambda x: upper(x[1]) || lower(x[2:])), ' ') AS snake,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS word, c_name AS mixed
FROM customer"""

# --- preparation ------------------------------------------------------------
_BLANK = "({0} IS NULL OR regexp_full_match({0}, '\\s*'))"
ORACLES["fill_null_cells"] = _with(MESSY_SQL) + "SELECT k, cents, " + ", ".join(
    f"CASE WHEN {_BLANK.format(c)} THEN 'NULL' ELSE {c} END AS {c}" for c in ("ind", "num_text", "txt")
) + ", coalesce(num, 0) AS num FROM messy"
ORACLES["fill_null_counts"] = _with(MESSY_SQL) + "SELECT CAST(sum(" + " + ".join(
    f"CASE WHEN {_BLANK.format(c)} THEN 1 ELSE 0 END" for c in ("ind", "num_text", "txt")
) + ") AS BIGINT) AS filled_string, count(*) FILTER (num IS NULL) AS filled_number FROM messy"
ORACLES["cancel_exact"] = _with(MESSY_SQL) + "SELECT k, coalesce(ind = 'S', false) AS is_canceled FROM messy"
_CANCELED = "coalesce(upper(trim(ind, ' ')) IN ('S', '1', 'TRUE', 'YES', 'Y', 'T'), false)"
ORACLES["cancel_normalized"] = _with(MESSY_SQL) + f"SELECT k, {_CANCELED} AS is_canceled FROM messy"
ORACLES["cancel_flag_counts"] = _with(MESSY_SQL) + f"""
SELECT count(*) AS total_rows, count(*) FILTER ({_CANCELED}) AS canceled_rows,
       count(*) FILTER (NOT {_CANCELED}) AS active_rows FROM messy"""


def _partner(rows: str, a: str, b: str) -> str:
    """Another row with swapped accounts whose value cancels that of x."""
    return f"EXISTS (SELECT 1 FROM {rows} y WHERE x.{a} = y.{b} AND x.{b} = y.{a} AND x.v = -y.v AND x.row_index <> y.row_index)"


ORACLES["concilable_rows"] = _with(TEXT_JOURNAL_SQL) + f"""
SELECT row_index, acct_a, acct_b, v FROM text_journal x
WHERE NOT {_CANCELED} AND NOT {_partner('text_journal', 'acct_a', 'acct_b')}"""

# --- reversals --------------------------------------------------------------
_PAIRS = journal_sql() + """,
pairs AS (
  SELECT x.row_index AS i, y.row_index AS j, x.a AS xa, x.b AS xb, x.v AS xv
  FROM journal x JOIN journal y ON x.a = y.b AND x.b = y.a
  WHERE abs(x.v + y.v) <= 1e-9 AND x.row_index < y.row_index)"""
ORACLES["reversal_pair_groups"] = _with(_PAIRS) + """
SELECT low, high, level, count(DISTINCT f) AS rows_forward, count(DISTINCT m) AS rows_mirrored, count(*) AS pairs
FROM (
  SELECT least(xa, xb) AS low, greatest(xa, xb) AS high,
         CASE WHEN xa > xb OR (xa = xb AND xv < 0) THEN -xv ELSE xv END AS level,
         CASE WHEN xa > xb OR (xa = xb AND xv < 0) THEN j ELSE i END AS f,
         CASE WHEN xa > xb OR (xa = xb AND xv < 0) THEN i ELSE j END AS m
  FROM pairs)
GROUP BY 1, 2, 3"""
ORACLES["reversal_group_rows"] = _with(_PAIRS) + """
SELECT r.row_index, least(a, b) AS low, greatest(a, b) AS high,
       CASE WHEN a > b OR (a = b AND v < 0) THEN -v ELSE v END AS level, n.partners
FROM journal r JOIN (SELECT i, count(*) AS partners FROM (SELECT i FROM pairs UNION ALL SELECT j FROM pairs) GROUP BY 1) n
  ON n.i = r.row_index"""
_ONE_TO_ONE = journal_sql() + """,
ranked AS (
  SELECT row_index, a, b, v, row_number() OVER (PARTITION BY a, b, v ORDER BY row_index) AS n FROM journal),
pairs AS (
  SELECT x.row_index AS row_i, y.row_index AS row_j
  FROM ranked x JOIN ranked y ON x.a = y.b AND x.b = y.a AND x.v = -y.v AND x.n = y.n AND x.row_index < y.row_index)"""
ORACLES["reversal_pairs_1to1"] = _with(_ONE_TO_ONE) + "SELECT row_i, row_j FROM pairs"
ORACLES["reversal_flags"] = _with(_PAIRS) + """
SELECT row_index, a, b, v, row_index IN (SELECT i FROM pairs UNION SELECT j FROM pairs) AS is_reversal FROM journal"""
ORACLES["reversal_flags_1to1"] = _with(_ONE_TO_ONE) + """
SELECT row_index, row_index IN (SELECT row_i FROM pairs UNION SELECT row_j FROM pairs) AS is_reversal FROM journal"""
_DRIFTED = journal_sql("round(0.01 * (o_orderkey % 3) - o_totalprice, 2)")
ORACLES["reversal_flags_tolerance"] = _with(_DRIFTED, """
exact AS (SELECT row_index, a, b, CAST(v AS DECIMAL(18,2)) AS v FROM journal)""") + """
SELECT row_index, EXISTS (
  SELECT 1 FROM exact y WHERE x.a = y.b AND x.b = y.a AND abs(x.v + y.v) <= 0.01 AND x.row_index <> y.row_index
) AS is_reversal FROM exact x"""
_WITHIN = _with(_DRIFTED, """
exact AS (SELECT row_index, a, b, CAST(v AS DECIMAL(18,2)) AS v FROM journal),
pairs AS (
  SELECT x.row_index AS i, y.row_index AS j FROM exact x JOIN exact y ON x.a = y.b AND x.b = y.a
  WHERE abs(x.v + y.v) <= 0.01 AND x.row_index < y.row_index),
involved AS (SELECT i, count(*) AS partners FROM (SELECT i FROM pairs UNION ALL SELECT j FROM pairs) GROUP BY 1)""")
ORACLES["reversal_totals_tolerance"] = _WITHIN + """
SELECT count(*) AS reversals, (SELECT count(*) FROM involved) AS rows_marked FROM pairs"""
ORACLES["reversal_rows_tolerance"] = _WITHIN + """
SELECT row_index, least(a, b) AS low, greatest(a, b) AS high, partners FROM exact JOIN involved ON i = row_index"""
ORACLES["reversal_totals"] = _with(_PAIRS) + """
SELECT count(*) AS reversals, (SELECT count(*) FROM (SELECT i FROM pairs UNION SELECT j FROM pairs)) AS rows_marked FROM pairs"""
ORACLES["reversal_result_records"] = _with(_PAIRS) + """
SELECT CAST(7 AS BIGINT) AS run_id, CAST(3 AS BIGINT) AS dataset_id, CAST(i AS VARCHAR) AS row_identifier,
       'Conciliado_Estorno' AS status, '01_Conciliado' AS group_name, CAST(NULL AS VARCHAR) AS key_used, CAST(0 AS DOUBLE) AS difference
FROM (SELECT i FROM pairs UNION SELECT j FROM pairs)"""

# --- verdicts on rows -------------------------------------------------------
_BOTH = _with(RECON_SQL, f"recon AS MATERIALIZED ({_ORDER} UNION ALL {_YEAR})",
              "by_order AS MATERIALIZED (SELECT *, CAST(key AS BIGINT) AS number FROM recon WHERE key_ordinal = 0)",
              "by_year AS MATERIALIZED (SELECT *, CAST(key AS BIGINT) AS number FROM recon WHERE key_ordinal = 1)")
_HITS = """
FROM {rows} r LEFT JOIN by_order p ON p.number = r.{by_order} LEFT JOIN by_year q ON q.number = r.{by_year}"""
_HITS_A = _HITS.format(rows="ledger_a", by_order="l_orderkey", by_year="ship_year")
_HITS_B = _HITS.format(rows="ledger_b", by_order="o_orderkey", by_year="order_year")
_FIRST = """CASE WHEN p.key IS NOT NULL THEN p.status ELSE q.status END AS status,
  CASE WHEN p.key IS NOT NULL THEN p.grp ELSE q.grp END AS group_name,
  CASE WHEN p.key IS NOT NULL THEN p.key_name ELSE q.key_name END AS key_used"""
ORACLES["enrich_first"] = f"{_BOTH} SELECT o_orderkey, o_custkey, {_FIRST} {_HITS_B}"
ORACLES["enrich_last"] = f"""{_BOTH}
SELECT o_orderkey, CASE WHEN q.key IS NOT NULL THEN q.key_name ELSE p.key_name END AS recon_key_name,
  CASE WHEN q.key IS NOT NULL THEN q.status ELSE p.status END AS recon_status,
  CASE WHEN q.key IS NOT NULL THEN q.grp ELSE p.grp END AS recon_group,
  CASE WHEN q.key IS NOT NULL THEN q.difference ELSE p.difference END AS recon_difference {_HITS_B}"""
ORACLES["enrich_many_keys"] = _with(
    RECON_SQL, f"recon AS MATERIALIZED ({_ORDER} UNION ALL {_recon(1, 'parte', 'l_partkey', 'o_custkey')} UNION ALL {_recon(2, 'ano', 'ship_year', 'order_year')})",
    "keyed AS MATERIALIZED (SELECT *, CAST(key AS BIGINT) AS number FROM recon)",
    "tags AS (SELECT o_orderkey, 0 AS k, o_orderkey AS number FROM ledger_b UNION ALL SELECT o_orderkey, 1, o_custkey FROM ledger_b "
    "UNION ALL SELECT o_orderkey, 2, order_year FROM ledger_b)",
    "best AS (SELECT o_orderkey, max(k) AS k FROM tags JOIN keyed ON key_ordinal = k AND keyed.number = tags.number GROUP BY 1)") + """
SELECT r.o_orderkey, o_custkey, status, grp AS group_name, key_name AS key_used
FROM ledger_b r LEFT JOIN best USING (o_orderkey) LEFT JOIN tags t ON t.o_orderkey = r.o_orderkey AND t.k = best.k
LEFT JOIN keyed ON key_ordinal = best.k AND keyed.number = t.number"""
ORACLES["enrich_items"] = f"{_BOTH} SELECT l_orderkey, l_linenumber, l_extendedprice, {_FIRST} {_HITS_A}"
ORACLES["attach_by_key"] = f"""{_ONE}
SELECT o_orderkey, f.status, f.grp AS group_name, f.difference
FROM orders LEFT JOIN (SELECT * FROM recon WHERE grp = 'Conciliados') f ON f.key = CAST(o_orderkey AS VARCHAR)"""
ORACLES["run_then_enrich"] = f"""{_BOTH}
SELECT 'a' AS side, key_used, status, count(*) AS rows FROM (SELECT {_FIRST} {_HITS_A}) GROUP BY ALL
UNION ALL
SELECT 'b', key_used, status, count(*) FROM (SELECT {_FIRST} {_HITS_B}) GROUP BY ALL"""

# --- results ----------------------------------------------------------------
ORACLES["persisted_run"] = f"""{_TWO}
SELECT CAST(12 AS BIGINT) AS run_id, CAST(1 AS BIGINT) AS config_id, 'completed' AS status, 'itens x pedidos' AS config_name,
       count(*) AS keys_evaluated, count(*) FILTER (grp = 'Conciliados') AS matched_keys,
       count(*) FILTER (grp <> 'Conciliados') AS unmatched_keys FROM recon"""
ORACLES["appended_results"] = _with(RECON_SQL, f"recon AS ({_ORDER})", _PAIRS) + """
SELECT key AS row_identifier, CAST(NULL AS BIGINT) AS dataset_id, status, grp AS group_name, key_name AS key_used FROM recon
UNION ALL
SELECT CAST(i AS VARCHAR), 10, 'Conciliado_Estorno', '01_Conciliado', NULL
FROM (SELECT i FROM pairs UNION SELECT j FROM pairs)"""
ORACLES["run_lookup"] = f"""{_TWO}
SELECT key_name AS key_used, status, count(*) AS keys, 'completed' AS run_status FROM recon GROUP BY 1, 2"""
ORACLES["results_page"] = f"""{_TWO}
SELECT {_RESULT} FROM recon WHERE status = 'Divergência' ORDER BY key_ordinal, key LIMIT 100 OFFSET 50"""
ORACLES["results_page_after"] = f"""{_TWO}
SELECT {_RESULT} FROM recon WHERE key_ordinal = 0 AND key > '100' ORDER BY key LIMIT 100"""
ORACLES["results_total"] = f"""{_TWO} SELECT count(*) AS total FROM recon WHERE grp = 'Conciliados' AND key_ordinal = 0"""
ORACLES["label_translate"] = f"""{_TWO}
SELECT key AS row_identifier, status, grp AS group_name, key_name AS key_used, difference FROM recon"""
ORACLES["header_translate"] = _with(TEXT_JOURNAL_SQL) + f"""
SELECT row_index, {_CANCELED} AS "Cancelado", {_partner('text_journal', 'acct_a', 'acct_b')} AS "Estorno" FROM text_journal x"""
_HISTORY = """
doomed AS (SELECT n_nationkey AS config_id FROM nation WHERE n_regionkey = 3 OR n_nationkey % 7 = 3),
doomed_runs AS (SELECT s_suppkey AS run_id FROM supplier WHERE s_nationkey IN (SELECT config_id FROM doomed))"""
ORACLES["purge_results"] = _with(_HISTORY) + """
SELECT l_suppkey AS run_id, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 11 END AS dataset_id,
       l_orderkey AS row_identifier, l_extendedprice AS difference
FROM lineitem WHERE l_partkey % 11 <> 3 AND l_suppkey NOT IN (SELECT run_id FROM doomed_runs)"""
ORACLES["purge_runs"] = _with(_HISTORY) + """
SELECT s_suppkey AS run_id, s_nationkey AS config_id, s_name AS name
FROM supplier WHERE s_nationkey NOT IN (SELECT config_id FROM doomed)"""

# --- sources and sinks ------------------------------------------------------
_TYPED = """
SELECT '{0}' AS "column", count({1}) AS filled,
  CASE WHEN count({1}) = 0 THEN 'double'
       WHEN count(*) = count(*) FILTER ({1} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) THEN 'boolean'
       WHEN count({1}) = count(*) FILTER (regexp_full_match({1}, '[+-]?\\d+')) THEN
         CASE WHEN count({1}) = count(*) FILTER (try_cast({1} AS BIGINT) IS NOT NULL) THEN 'bigint' ELSE 'string' END
       WHEN count({1}) = count(*) FILTER (regexp_full_match({1}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')) THEN 'double'
       ELSE 'string' END AS storage
FROM orders"""
_TYPED_COLUMNS = {c: f"CAST({c} AS VARCHAR)" for c in (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}
_TYPED_COLUMNS["final"] = "CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END END"
_TYPED_COLUMNS["access_key"] = "lpad(CAST(o_orderkey AS VARCHAR), 44, '9')"
ORACLES["infer_types"] = """SELECT *, CASE WHEN storage = 'string' THEN 'string' ELSE 'number' END AS data_type FROM (
""" + " UNION ALL ".join(_TYPED.format(n, e) for n, e in _TYPED_COLUMNS.items()) + ")"
ORACLES["column_catalog"] = """
SELECT name, name AS logical_name, data_type, data_type = 'number' AS is_value_column, false AS is_candidate_key, filled
FROM (SELECT 'l_orderkey' AS name, 'number' AS data_type, count(l_orderkey) AS filled FROM lineitem
      UNION ALL SELECT 'l_extendedprice', 'number', count(l_extendedprice) FROM lineitem
      UNION ALL SELECT 'l_returnflag', 'string', count(l_returnflag) FROM lineitem)"""
ORACLES["logical_names"] = "SELECT c_custkey AS cliente, c_name, c_acctbal AS saldo FROM customer"
_DATE = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
_ORDINAL = "row_number() OVER (ORDER BY o_orderkey)"
ORACLES["ingest_roundtrip"] = f"""
SELECT {_ORDINAL} AS row_index, o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_DATE} AS o_orderdate, o_orderpriority
FROM orders"""
_ORDER_ROWS = "o_orderkey AS pedido, o_custkey AS cliente, o_orderstatus AS situacao, o_totalprice AS valor"
ORACLES["header_at_coordinates"] = f"""
SELECT {_ORDINAL} AS row_index, {_ORDER_ROWS}, {_DATE} AS data, o_orderpriority AS data_1 FROM orders"""
ORACLES["header_detected"] = f"""
SELECT {_ORDINAL} AS row_index, {_ORDER_ROWS}, {_DATE} AS data, o_orderpriority AS prioridade FROM orders"""
ORACLES["row_ordinals"] = f"SELECT {_ORDINAL} AS row_index, o_orderkey, o_totalprice FROM orders"
ORACLES["ordinals_json"] = f"SELECT {_ORDINAL} AS row_index, o_orderkey, o_orderstatus FROM orders"
ORACLES["ordinals_orc"] = ORACLES["ordinals_json"]
ORACLES["preview_rows"] = """
SELECT row_number() OVER (ORDER BY c_custkey) AS row_index, c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50"""
ORACLES["export_ordered"] = _with(MESSY_SQL) + f"""
SELECT k, cents, ind, num_text, num, txt, {_CANCELED} AS "Cancelado" FROM messy"""
ORACLES["prepared_sink"] = ORACLES["fill_null_cells"].replace(
    "coalesce(num, 0) AS num FROM", "coalesce(num, 0) AS num, false AS is_reversal FROM")
ORACLES["run_export"] = ORACLES["label_translate"]
ORACLES["run_export_summary"] = f"""{_TWO}
SELECT 4 AS run_id, 'completed' AS status, 'itens x pedidos' AS config_name, count(*) AS keys_evaluated,
       count(*) FILTER (grp = 'Conciliados') AS matched_keys, count(*) FILTER (grp <> 'Conciliados') AS unmatched_keys FROM recon"""
ORACLES["enriched_export"] = f"""{_BOTH}
SELECT recon_key_name, recon_status, count(*) AS rows, count(*) FILTER (d > 0) AS positive FROM (
  SELECT coalesce(q.key_name, p.key_name) AS recon_key_name, coalesce(q.status, p.status) AS recon_status,
         coalesce(q.difference, p.difference) AS d {_HITS_A})
GROUP BY 1, 2"""

# --- preprocessing jobs -----------------------------------------------------
_FILLED = TEXT_JOURNAL_SQL + """,
filled AS (
  SELECT row_index, coalesce(acct_a, 'NULL') AS acct_a, coalesce(acct_b, 'NULL') AS acct_b, v,
         CASE WHEN trim(ind) = '' THEN 'NULL' ELSE ind END AS ind
  FROM text_journal)"""
ORACLES["preprocess_upload"] = _with(_FILLED) + f"""
SELECT row_index, acct_a, acct_b, v, ind, {_CANCELED} AS is_canceled,
       {_partner('filled', 'acct_a', 'acct_b')} AS is_reversal FROM filled x"""
ORACLES["preprocess_raw_keys"] = _with(_FILLED) + f"""
SELECT row_index, coalesce(acct_a, 'NULL') AS acct_a, coalesce(acct_b, 'NULL') AS acct_b,
       {_partner('text_journal', 'acct_a', 'acct_b')} AS is_reversal FROM text_journal x"""
ORACLES["upload_reversal_runs"] = _with(_FILLED, f"""
flagged AS (SELECT row_index FROM filled x WHERE {_partner('filled', 'acct_a', 'acct_b')})""") + """
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(2 AS BIGINT) AS dataset_id, CAST(row_index AS VARCHAR) AS row_identifier,
       'Conciliado_Estorno' AS status, '01_Conciliado' AS group_name, CAST(NULL AS VARCHAR) AS key_used, CAST(0 AS DOUBLE) AS difference
FROM flagged, (VALUES (31), (32)) r(run_id)"""
ORACLES["base_b_rows"] = _with(MESSY_SQL) + "SELECT k, cents, " + ", ".join(
    f"CASE WHEN {_BLANK.format(c)} THEN 'NULL' ELSE {c} END AS {c}" for c in ("ind", "num_text", "txt")
) + f", coalesce(num, 0) AS num, {_CANCELED} AS is_canceled FROM messy"
ORACLES["base_b_counts"] = ORACLES["cancel_flag_counts"]
ORACLES["generic_preprocess"] = _with(_FILLED) + f"""
SELECT count(*) AS rows, 6 AS columns, count(*) FILTER ({_partner('filled', 'acct_a', 'acct_b')}) AS reversals_count FROM filled x"""

# --- files, pages and values that need care ---------------------------------
_CELL = """CASE o_orderkey % 8 WHEN 0 THEN ' x ' WHEN 2 THEN '  y' WHEN 4 THEN 'q"uo"te' WHEN 5 THEN 'line' || chr(10) || 'break'
  WHEN 6 THEN 'a,b' WHEN 7 THEN 'plain' END"""
ORACLES["export_csv_roundtrip"] = f"SELECT CAST(o_orderkey AS VARCHAR) AS k, {_CELL} AS cell FROM orders"
ORACLES["ingest_quoted_lines"] = f"SELECT {_ORDINAL} AS row_index, o_orderkey AS k, {_CELL} AS cell FROM orders"
ORACLES["header_many_files"] = """
SELECT o_orderstatus AS situacao, o_orderpriority AS prioridade, count(*) AS pedidos, min(o_orderkey) AS primeiro,
       max(o_orderkey) AS ultimo FROM orders GROUP BY 1, 2"""
ORACLES["preprocess_many_reversals"] = _with(_FILLED) + f"""
SELECT row_index, acct_a, acct_b, {_partner('filled', 'acct_a', 'acct_b')} OR {_partner('filled', 'acct_a', 'ind')}
       OR {_partner('filled', 'acct_b', 'ind')} AS is_reversal FROM filled x"""
ORACLES["pages_cover_all"] = f"""{_TWO} SELECT key_name AS key_used, key AS row_identifier, status FROM recon"""
ORACLES["side_totals_nested"] = """
SELECT event_type AS key, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS total FROM events GROUP BY 1"""
ORACLES["side_totals_duplicates"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(sum(l_linenumber + CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS total
FROM lineitem GROUP BY 1"""
ORACLES["results_page_deep"] = f"""{_TWO}, ordered AS (
  SELECT key_name AS key_used, key AS row_identifier, status, grp AS group_name, difference,
         row_number() OVER (ORDER BY key_ordinal, key) AS n, count(*) OVER () AS total FROM recon)
SELECT key_used, row_identifier, status, group_name, difference FROM ordered WHERE n > total - 150 AND n <= total - 50"""
ORACLES["purge_applied"] = ORACLES["purge_results"]
ORACLES["preprocess_run_record"] = _with(MESSY_SQL, _FILLED.strip()) + f"""
SELECT CAST(1 AS BIGINT) AS run_id, CAST(5 AS BIGINT) AS dataset_id, 'completed' AS status, CAST(NULL AS BIGINT) AS rows,
       CAST(NULL AS INTEGER) AS columns, count(*) AS total_rows, count(*) FILTER ({_CANCELED}) AS canceled_rows,
       count(*) FILTER (NOT {_CANCELED}) AS active_rows, CAST(NULL AS BIGINT) AS reversals_count, (SELECT count(*) FROM messy) AS stored_rows
FROM messy
UNION ALL
SELECT 2, 6, 'completed', count(*), 6, NULL, NULL, NULL, count(*) FILTER ({_partner('filled', 'acct_a', 'acct_b')}), (SELECT count(*) FROM messy)
FROM filled x"""
ORACLES["reversal_run_rows"] = _with(_FILLED) + f"""
SELECT CAST(41 AS BIGINT) AS run_id, CAST(2 AS BIGINT) AS dataset_id, 'Conciliado_Estorno' AS status, count(*) AS rows,
       'completed' AS run_status, CAST(NULL AS BIGINT) AS config_id
FROM filled x WHERE {_partner('filled', 'acct_a', 'acct_b')}"""
ORACLES["reload_promoted"] = f"""
SELECT {_ORDINAL} AS row_index, CAST(o_orderkey AS VARCHAR) AS pedido, CAST(o_custkey AS VARCHAR) AS cliente, o_orderstatus AS situacao,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS valor, {_DATE} AS data, o_orderpriority AS data_1 FROM orders"""
ORACLES["preprocessed_export"] = _with(TEXT_JOURNAL_SQL) + f"""
SELECT acct_a, acct_b, v, ind, {_CANCELED} AS "Cancelado", false AS "Estorno" FROM text_journal"""
