"""The graph model projected onto the general tables, in SQL that Spark and DuckDB both run.

Tables are written in braces; a view may name views above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS = {
    # files: one of each supplier
    "v_file": """
SELECT s_suppkey AS file_id, concat('/src/d', CAST(s_nationkey AS VARCHAR(10)), '/', s_name, '.h') AS path,
  s_acctbal < -500 AS is_system, s_acctbal > 0 AS in_project FROM {supplier}""",
    # symbols: one of each part, in a tree of tens
    "v_sym": """
SELECT p_partkey AS usr, p_name AS name, concat(p_brand, '::', p_name) AS qualified,
  concat('(', CAST(p_size AS VARCHAR(10)), ')') AS signature,
  CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'namespace' END AS kind,
  p_size <= 25 AS in_project, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS stub,
  CAST(p_size AS BIGINT) AS file_id, CAST(p_partkey % 1000 + 1 AS INT) AS line,
  CASE WHEN p_size % 3 = 0 THEN CAST(NULL AS INT) ELSE CAST(p_partkey % 1000 + 1 + p_size % 7 AS INT) END AS end_line,
  CASE WHEN p_partkey >= 10 THEN CAST(floor(p_partkey / 10) AS BIGINT) END AS parent_usr FROM {part}""",
    # edges: parts lead to the next part of the same order
    "v_edge": """
SELECT * FROM (
  SELECT l_orderkey AS tu_id,
    CASE WHEN (l_partkey + l_linenumber) % 10 IN (5, 6) AND l_suppkey % 5 > 0 THEN 'calls' ELSE
      CASE (l_partkey + l_linenumber) % 10 WHEN 4 THEN 'references' WHEN 5 THEN 'inherits' WHEN 6 THEN 'overrides'
      WHEN 7 THEN 'instantiates' WHEN 8 THEN 'param_type' WHEN 9 THEN 'calls_indirect' ELSE 'calls' END END AS kind,
    l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
    l_suppkey AS file_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS weight,
    CASE WHEN l_returnflag = 'R' THEN '{{"virt":1,"acc":"pub"}}' WHEN l_linestatus = 'F' THEN '{{"pure":1,"acc":"priv"}}'
      WHEN l_linenumber % 2 = 0 THEN '{{"virtual":1,"acc":"prot"}}' END AS flags
  FROM {lineitem}) q WHERE dst IS NOT NULL AND src <> dst""",
    # unmerged records: every order reports its parts
    "v_raw": """
SELECT l_orderkey AS tu_id, l_partkey AS usr, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS stub,
  CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS def_file_id, l_suppkey AS file_id, l_linenumber AS line FROM {lineitem}""",
    # a sparse cyclic graph of includes
    "v_inc": """
SELECT s_suppkey AS from_file, CAST((7 * s_suppkey + 3) % (SELECT count(*) FROM {supplier}) AS BIGINT) AS to_file, 1 AS line, 0 AS angled FROM {supplier}
UNION ALL
SELECT s_suppkey, CAST((5 * s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS BIGINT), 2, 1 FROM {supplier}""",
    "v_unit": "SELECT s_suppkey AS file_id FROM {supplier} WHERE s_nationkey < 5",
    # spans: one of each order; ranges: one of each event
    "v_span": """
SELECT o_orderkey AS usr, o_custkey % 50 AS file_id, CAST(o_orderkey % 1000 AS INT) AS line,
  CAST(o_orderkey % 1000 + o_custkey % 40 AS INT) AS end_line, CAST(NULL AS BIGINT) AS def_file_id, CAST(NULL AS INT) AS def_line,
  CASE WHEN o_orderpriority < '3' THEN 'function' WHEN o_orderpriority < '5' THEN 'class' ELSE 'field' END AS kind,
  concat('n', CAST(o_custkey AS VARCHAR(20))) AS name, CAST(NULL AS VARCHAR(10)) AS qualified, o_orderstatus AS signature FROM {orders}""",
    "v_range": """
SELECT event_id AS range_id, user_id % 50 AS file_id, CAST(event_id % 1000 AS INT) AS "start", CAST(event_id % 1000 + event_id % 5 AS INT) AS "end"
FROM {events}""",
    "v_diag": """
SELECT event_id AS diag_id, CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'warning' WHEN 'purchase' THEN 'fatal' ELSE 'note' END AS severity,
  user_id % 120 AS file_id, CAST(event_id % 1000 AS INT) AS line FROM {events}""",
    # turns of a conversation are each other's parents
    "v_parent": """
SELECT concat(CAST(conv_id AS VARCHAR(20)), '.', CAST(turn AS VARCHAR(20))) AS usr,
  CASE WHEN turn > 0 THEN concat(CAST(conv_id AS VARCHAR(20)), '.', CAST(turn - 1 AS VARCHAR(20))) END AS parent_usr FROM {conversations}""",
}



def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables and views as DataFrames."""
    out = []
    for name in names:
        if name in VIEWS:
            sql = VIEWS[name].replace('"start"', "`start`").replace('"end"', "`end`")
            used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
            out.append(spark.sql(sql, **used))
        else:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


def with_views(sql: str) -> str:
    """The SQL with the views that it names as common table expressions."""
    ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[len('WITH RECURSIVE') :]}"
    if body.upper().startswith("WITH"):
        return f"WITH {', '.join(ctes)}, {body[4:]}"
    return f"WITH {', '.join(ctes)} {body}"
