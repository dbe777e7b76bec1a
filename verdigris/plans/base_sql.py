"""The graph tables as DuckDB common table expressions, for the oracles."""

BASE = r"""
WITH RECURSIVE customers AS (
  SELECT c_custkey, c_name, r_name AS framework FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rule AS (
  SELECT o_orderkey AS rule_id, framework, CAST((year(o_orderdate) - 1990) * 1000000 + month(o_orderdate) * 1000 AS BIGINT) AS sortable,
    CASE o_orderstatus WHEN 'F' THEN 'actionable' WHEN 'O' THEN 'incomplete' END AS classification,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS severity,
    CASE o_orderkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'config' ELSE 'general' END AS scope,
    CASE o_orderkey % 4 WHEN 0 THEN 'breaking' WHEN 1 THEN 'mandatory_migration' WHEN 2 THEN 'behavioral' ELSE 'deprecation' END AS rule_type
  FROM orders JOIN customers ON o_custkey = c_custkey),
version AS (
  SELECT DISTINCT framework, sortable, CAST(sortable // 1000000 AS VARCHAR) || '.' || CAST(sortable // 1000 % 1000 AS VARCHAR) || '.0' AS version FROM rule),
part_words AS (
  SELECT *, replace(lower(p_brand), '#', '') AS brand, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
entity AS (
  SELECT p_partkey, p_brand, p_type, p_size, p_name, p_retailprice,
    CASE p_partkey % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'ApplicationProperty' ELSE 'Dependency' END AS kind,
    CASE p_partkey % 3
      WHEN 0 THEN 'org.' || brand || '.' || lower(p_type) || '.' || upper(w1[1]) || w1[2:] || upper(w2[1]) || w2[2:]
      WHEN 1 THEN brand || '.' || lower(p_type) || '.' || w1 || '.' || w2
      ELSE 'org.' || brand || ':' || w1 || '-' || w2 END AS name
  FROM part_words),
affects AS (SELECT DISTINCT l_orderkey AS rule_id, kind, name FROM lineitem JOIN entity ON l_partkey = p_partkey),
role_edge AS (
  SELECT DISTINCT l_orderkey AS rule_id, kind, name, CASE WHEN l_returnflag = 'R' THEN 'removed' WHEN l_linestatus = 'F' THEN 'replacement' ELSE 'mentioned' END AS role
  FROM lineitem JOIN entity ON l_partkey = p_partkey),
scan_names AS (
  SELECT name FROM entity WHERE p_partkey % 17 = 0
  UNION SELECT string_split(name, '.')[-1] FROM entity WHERE p_partkey % 101 = 0 AND kind = 'Class'),
scan AS (
  SELECT 'deps_ga' AS bucket, split_part(name, ':', 1) || ':' || split_part(name, ':', 2) AS name FROM scan_names WHERE contains(name, ':')
  UNION SELECT 'dep_artifacts', split_part(name, ':', 2) FROM scan_names WHERE contains(name, ':')
  UNION SELECT CASE
      WHEN contains(name, '.') THEN CASE WHEN regexp_matches(string_split(name, '.')[-1], '^\p{Lu}') THEN 'classes' ELSE 'props' END
      WHEN regexp_matches(name, '^\p{Lu}') THEN 'class_simple' ELSE 'dep_artifacts' END, name
    FROM scan_names WHERE NOT contains(name, ':')),
classes AS (SELECT name FROM scan WHERE bucket = 'classes'),
hits AS (
  SELECT kind, name,
    CASE kind
      WHEN 'Class' THEN name IN (FROM classes) OR string_split(name, '.')[-1] IN (SELECT name FROM scan WHERE bucket = 'class_simple')
      WHEN 'ApplicationProperty' THEN name IN (SELECT name FROM scan WHERE bucket = 'props')
      ELSE name IN (SELECT name FROM scan WHERE bucket = 'deps_ga') OR split_part(name, ':', 2) IN (SELECT name FROM scan WHERE bucket = 'dep_artifacts') END AS direct,
    kind = 'Dependency' AND EXISTS (FROM classes c WHERE starts_with(c.name, split_part(e.name, ':', 1) || '.')) AS under_group,
    kind = 'Class' AND EXISTS (FROM classes c WHERE starts_with(c.name, left(e.name, length(e.name) - length(string_split(e.name, '.')[-1])))) AS under_package
  FROM (SELECT DISTINCT kind, name FROM affects) e),
per_rule AS (
  SELECT rule_id, count(*) AS affected_count, count(*) FILTER (direct) AS n_direct, count(*) FILTER (kind = 'Dependency' AND NOT direct) AS n_other,
    count(*) FILTER (under_group AND NOT direct) AS n_group, bool_or(kind = 'Class') AS has_class, bool_or(under_package) AS in_package,
    count(*) FILTER (name IN (SELECT name FROM entity WHERE p_partkey % 50 = 1)) AS n_forced
  FROM affects JOIN hits USING (kind, name) GROUP BY 1),
matched AS (
  SELECT r.*, coalesce(affected_count, 0) AS affected_count,
    coalesce(n_direct + CASE WHEN NOT has_class THEN n_group ELSE 0 END, 0) AS match_count,
    coalesce(n_direct + CASE WHEN in_package THEN n_other WHEN NOT has_class THEN n_group ELSE 0 END, 0) AS plan_match_count,
    coalesce(n_forced, 0) AS n_forced,
    CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity_rank
  FROM rule r LEFT JOIN per_rule USING (rule_id)),
applied AS (
  SELECT *,
    CASE WHEN affected_count = 0 THEN 'informational' WHEN NOT EXISTS (FROM scan) THEN 'universal' WHEN match_count > 0 THEN 'matched' WHEN severity_rank <= 1 THEN 'uncertain' ELSE 'excluded' END AS applicability,
    CASE WHEN affected_count = 0 THEN 'informational' WHEN NOT EXISTS (FROM scan) THEN 'universal' WHEN plan_match_count > 0 THEN 'matched' WHEN severity_rank <= 1 THEN 'uncertain' ELSE 'excluded' END AS plan_applicability,
    CASE WHEN affected_count = 0 THEN 'informational' WHEN NOT EXISTS (FROM scan) THEN 'universal' WHEN plan_match_count > 0 OR n_forced > 0 THEN 'matched' WHEN severity_rank <= 1 THEN 'uncertain' ELSE 'excluded' END AS pending_applicability
  FROM matched),
path AS (SELECT * FROM applied WHERE framework = 'ASIA' AND sortable > 5006000 AND sortable <= 7006000),
step AS (
  SELECT l_orderkey * 10 + l_linenumber AS step_id, l_orderkey AS rule_id, l_linenumber AS step_index,
    CASE l_returnflag WHEN 'A' THEN 'mechanical' WHEN 'N' THEN 'moderate' ELSE 'architectural' END AS effort, l_linestatus = 'F' AS automatable,
    CASE l_partkey % 5 WHEN 0 THEN 'Replace part' || l_partkey || ' with part' || l_suppkey WHEN 1 THEN 'Rename key' || l_partkey || ' to key' || l_suppkey
      WHEN 2 THEN 'Review the configuration by hand' WHEN 3 THEN 'old() -> new()' ELSE 'Check release notes' END AS instruction,
    CASE WHEN l_discount >= 0.05 THEN l_suppkey END AS recipe_id, CASE WHEN l_discount >= 0.05 THEN l_tax <= 0.04 END AS auto, l_discount >= 0.05 AND l_quantity > 40 AS missing_params
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1),
replaced_by AS (
  SELECT * FROM (SELECT p_partkey AS old_part, lead(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS new_part FROM part) WHERE new_part IS NOT NULL),
context AS (
  SELECT c_custkey AS context_id, framework, CAST(2006000 + (c_custkey % 5) * 1000000 AS BIGINT) AS from_sortable, CAST(4006000 + (c_custkey % 5) * 1000000 AS BIGINT) AS to_sortable,
    CASE WHEN c_custkey % 7 = 0 THEN 'complete' ELSE 'in-progress' END AS status FROM customers),
outcome_event AS (
  SELECT event_id, ts, user_id AS context_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS step_key,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'deferred' WHEN 'signup' THEN 'excluded' END AS status, value FROM events),
outcome AS (
  SELECT context_id, step_key, event_id, status, value FROM (SELECT *, row_number() OVER (PARTITION BY context_id, step_key ORDER BY ts DESC, event_id DESC) AS rn FROM outcome_event) WHERE rn = 1),
insight AS (
  SELECT doc_id AS insight_id, text AS statement, lang AS framework, source, coalesce(quality, 0) = 1 AS verified
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))
"""
