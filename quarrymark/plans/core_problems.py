"""Queries p1, p2, p4 and p5 over the domain tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.operators import hierarchy, intervals, orphans, quality
from quarrymark.sources.tables import table


def _stays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "employee_department_history").select("edh_id", "business_entity_id", "start_date", "end_date", "modified_date")
    return intervals.latest_version(rows, "edh_id", "modified_date")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.gaps(_stays(spark, d), "business_entity_id", "start_date", "end_date")
    return found.select(F.col("entity").alias("business_entity_id"), F.date_format("gap_start", "yyyy-MM-dd").alias("gap_start"), F.date_format("gap_end", "yyyy-MM-dd").alias("gap_end"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.periods(_stays(spark, d), "business_entity_id", "start_date", "end_date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select(F.col("entity").alias("business_entity_id"), text("period_start"), text("period_end"), "starts")


_STAYS_SQL = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edh_id ORDER BY modified_date DESC) AS rn FROM employee_department_history) WHERE rn = 1
), stays AS (
  SELECT business_entity_id, start_date AS s, CASE WHEN end_date IS NULL OR end_date >= DATE '9999-12-31' THEN DATE '9999-12-31' ELSE end_date END AS e
  FROM latest WHERE start_date IS NOT NULL AND (end_date IS NULL OR end_date >= start_date) AND business_entity_id IS NOT NULL
), runs AS (
  SELECT *, max(e) OVER (PARTITION BY business_entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stays
)
"""

P1_FOUND_SQL = _STAYS_SQL + """
SELECT business_entity_id, strftime(before + INTERVAL 1 DAY, '%Y-%m-%d') AS gap_start, strftime(s - INTERVAL 1 DAY, '%Y-%m-%d') AS gap_end
FROM runs WHERE before < DATE '9999-12-31' AND s > before + INTERVAL 1 DAY
"""

P1_PERIODS_SQL = _STAYS_SQL + """
, marked AS (
  SELECT *, sum(CASE WHEN before IS NULL OR (before < DATE '9999-12-31' AND s > before + INTERVAL 1 DAY) THEN 1 ELSE 0 END)
    OVER (PARTITION BY business_entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM runs
)
SELECT business_entity_id, strftime(min(s), '%Y-%m-%d') AS period_start,
  CASE WHEN max(e) < DATE '9999-12-31' THEN strftime(max(e), '%Y-%m-%d') END AS period_end, count(DISTINCT s) AS starts
FROM marked GROUP BY business_entity_id, island
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return quality.profiled_loads(table(spark, d, "extract_cells"), table(spark, d, "col_inventory"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(_judged(spark, d)).select("column_id", F.col("load_no").cast("long").alias("load_no"), "finding")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Of the columns of large tables (row_count_estimate of 10,000 or more, or unknown) and all others alike; is_large tells them apart."""
    columns = table(spark, d, "col_inventory")
    tables = table(spark, d, "tbl_inventory").select("table_id", (F.coalesce("row_count_estimate", F.lit(0)) >= 10_000).alias("is_large"))
    facts = columns.select("column_id", "table_id").join(tables, "table_id", "left").select("column_id", F.coalesce("is_large", F.lit(False)).alias("is_large"))
    return quality.profile(_judged(spark, d)).join(facts, "column_id")


_CELLS_SQL = r"""
WITH cells AS (
  SELECT DISTINCT column_id, load_no, row_no, cell_value, extracted_at FROM extract_cells WHERE column_id IS NOT NULL AND load_no IS NOT NULL
), typed AS (
  SELECT c.column_id, c.load_no, c.cell_value, i.data_type, i.is_nullable, i.max_length, i.min_val, i.max_val,
    regexp_replace(c.cell_value, '^\s+|\s+$', '', 'g') AS t
  FROM cells c JOIN col_inventory i USING (column_id)
), judged AS (
  SELECT *, CASE
    WHEN cell_value IS NULL THEN NULL
    WHEN data_type = 'integer' THEN regexp_full_match(t, '[+-]?[0-9]+') AND coalesce(TRY_CAST(t AS HUGEINT) BETWEEN -2147483648 AND 2147483647, false)
    WHEN data_type = 'bigint' THEN regexp_full_match(t, '[+-]?[0-9]+') AND coalesce(TRY_CAST(t AS HUGEINT) BETWEEN -9223372036854775808 AND 9223372036854775807, false)
    WHEN data_type = 'numeric' THEN regexp_full_match(t, '[+-]?[0-9]+(\.[0-9]+)?')
    WHEN data_type = 'boolean' THEN lower(t) IN ('true', 'false', 't', 'f')
    WHEN data_type = 'date' THEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(t AS DATE) IS NOT NULL
    WHEN data_type = 'timestamp with time zone' THEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}(:[0-9]{2})?)?') AND TRY_CAST(t[1:10] AS DATE) IS NOT NULL
    WHEN data_type = 'uuid' THEN regexp_full_match(t, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')
    WHEN data_type = 'jsonb' THEN json_valid(t) AND NOT regexp_matches(t, 'NaN|Infinity')
    WHEN data_type = 'character varying' THEN max_length IS NULL OR length(t) <= max_length
    ELSE true END AS valid
  FROM typed
), measured AS (
  SELECT *, CASE
    WHEN NOT coalesce(valid, false) THEN NULL
    WHEN data_type IN ('integer', 'bigint', 'numeric') THEN CAST(t AS DOUBLE)
    WHEN data_type = 'date' THEN epoch(CAST(t AS DATE))
    WHEN data_type = 'timestamp with time zone' THEN epoch_us(CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{2}(:[0-9]{2})?)$') AND NOT regexp_full_match(t, '.{10}[ T].{8}(\.[0-9]+)?') THEN t ELSE t || '+00' END AS TIMESTAMPTZ)) / 1e6
    END AS m,
    CASE WHEN NOT coalesce(valid, false) THEN NULL WHEN data_type IN ('integer', 'bigint', 'numeric') THEN TRY_CAST(t AS DECIMAL(38,6)) WHEN data_type = 'date' THEN epoch(CAST(t AS DATE))
      WHEN data_type = 'timestamp with time zone' THEN epoch_us(CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{2}(:[0-9]{2})?)$') AND NOT regexp_full_match(t, '.{10}[ T].{8}(\.[0-9]+)?') THEN t ELSE t || '+00' END AS TIMESTAMPTZ)) ELSE 0 END AS k,
    CASE WHEN data_type IN ('integer', 'bigint', 'numeric') THEN TRY_CAST(min_val AS DOUBLE) WHEN data_type = 'date' THEN epoch(TRY_CAST(min_val AS DATE)) WHEN data_type = 'timestamp with time zone' THEN epoch(TRY_CAST(min_val AS TIMESTAMPTZ)) END AS lo,
    CASE WHEN data_type IN ('integer', 'bigint', 'numeric') THEN TRY_CAST(max_val AS DOUBLE) WHEN data_type = 'date' THEN epoch(TRY_CAST(max_val AS DATE)) WHEN data_type = 'timestamp with time zone' THEN epoch(TRY_CAST(max_val AS TIMESTAMPTZ)) END AS hi
  FROM judged
)
"""

P2_PROFILE_SQL = _CELLS_SQL + """
, extremes AS (
  SELECT column_id, load_no, arg_min(t, (k, t)) AS min_value, arg_max(t, (k, t)) AS max_value FROM measured WHERE valid GROUP BY ALL
), counts AS (
  SELECT column_id, load_no, cell_value, count(*) AS n, sum(CASE WHEN valid = false THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN m < lo OR m > hi THEN 1 ELSE 0 END) AS out FROM measured GROUP BY ALL
), totals AS (
  SELECT column_id, load_no, sum(n) AS cells, sum(CASE WHEN cell_value IS NULL THEN n ELSE 0 END) AS nulls, count(cell_value) AS distinct_values,
    sum(CASE WHEN cell_value IS NOT NULL THEN n * log2(n) ELSE 0 END) AS nlogn, sum(bad) AS invalid, sum(out) AS out_of_range
  FROM counts GROUP BY ALL
)
SELECT column_id, load_no, CAST(cells AS BIGINT) AS cells, CAST(nulls AS BIGINT) AS nulls, round(nulls / cells, 6) AS null_share, distinct_values,
  round(CASE WHEN cells > nulls THEN greatest(0.0, log2(cells - nulls) - nlogn / (cells - nulls)) ELSE 0.0 END, 6) AS entropy,
  CAST(invalid AS BIGINT) AS invalid, CAST(out_of_range AS BIGINT) AS out_of_range, min_value, max_value, coalesce(row_count_estimate, 0) >= 10000 AS is_large
FROM totals LEFT JOIN extremes USING (column_id, load_no) JOIN col_inventory USING (column_id) LEFT JOIN tbl_inventory USING (table_id)
"""

P2_FOUND_SQL = _CELLS_SQL + """
, loads AS (
  SELECT column_id, load_no, count(*) AS cells, count(*) - count(cell_value) AS nulls, quantile_cont(m, 0.1) AS p10, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.9) AS p90
  FROM measured GROUP BY ALL
), chained AS (
  SELECT *, lag(load_no) OVER w AS prev_load, lag(cells) OVER w AS cells_b, lag(nulls) OVER w AS nulls_b, lag(p10) OVER w AS p10_b, lag(p90) OVER w AS p90_b
  FROM loads WINDOW w AS (PARTITION BY column_id ORDER BY load_no)
), vals AS (
  SELECT column_id, load_no, cell_value, count(*) AS n FROM measured WHERE cell_value IS NOT NULL AND data_type IN ('boolean', 'character varying') GROUP BY ALL
), shares AS (
  SELECT column_id, c.load_no, cell_value, sum(CASE WHEN v.load_no = c.load_no THEN n ELSE 0 END) / (max(cells) - max(nulls)) AS now, sum(CASE WHEN v.load_no = prev_load THEN n ELSE 0 END) / (max(cells_b) - max(nulls_b)) AS old
  FROM chained c JOIN vals v USING (column_id) WHERE prev_load IS NOT NULL AND v.load_no IN (c.load_no, prev_load) AND cells > nulls AND cells_b > nulls_b GROUP BY ALL
)
SELECT DISTINCT column_id, load_no, finding FROM (
  SELECT column_id, load_no, 'null' AS finding FROM measured WHERE cell_value IS NULL AND NOT is_nullable
  UNION ALL SELECT column_id, load_no, 'type' FROM measured WHERE valid = false
  UNION ALL SELECT column_id, load_no, 'range' FROM measured WHERE m < lo OR m > hi
  UNION ALL SELECT column_id, load_no, 'shift' FROM chained WHERE 5 * abs(nulls * cells_b - nulls_b * cells) >= cells * cells_b OR p50 < p10_b OR p50 > p90_b
  UNION ALL SELECT column_id, load_no, 'shift' FROM shares WHERE abs(now - old) >= 0.25
)
"""


def _hierarchies(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "candidates").select("id", "referrer_id", "loaded_at")
    out = hierarchy.links(table(spark, d, "categories"), "categories", "id", "parent_category_id")
    out = out.unionByName(hierarchy.links(table(spark, d, "skill_taxonomy"), "skill_taxonomy", "id", "parent_id"))
    return out.unionByName(hierarchy.links(intervals.latest_version(people, "id", "loaded_at"), "candidates", "id", "referrer_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(_hierarchies(spark, d)).where("has_parent")
    return found.select(F.col("h").alias("hierarchy"), F.col("id").alias("node_id"), F.col("root").alias("root_id"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(_hierarchies(spark, d), paths=True)
    return found.select(F.col("h").alias("hierarchy"), F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("long").alias("depth"), "cyclic", F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.resolve(_hierarchies(spark, d), paths=True))
    return pairs.select(F.col("h").alias("hierarchy"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), F.col("distance").cast("long").alias("distance"))


_TREES_SQL = """
WITH RECURSIVE edges AS (
  SELECT 'categories' AS hierarchy, id, min(parent_category_id) AS p FROM categories GROUP BY id
  UNION ALL SELECT 'skill_taxonomy', id, min(parent_id) FROM skill_taxonomy GROUP BY id
  UNION ALL SELECT 'candidates', id, referrer_id FROM (SELECT id, referrer_id, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM candidates) WHERE rn = 1
), tops AS (
  SELECT e.* FROM edges e WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM edges x WHERE x.hierarchy = e.hierarchy AND x.id = e.p)
), tree AS (
  SELECT hierarchy, id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM tops
  UNION ALL SELECT e.hierarchy, e.id, t.root, t.depth + 1, t.path || '/' || e.id FROM tree t JOIN edges e ON e.hierarchy = t.hierarchy AND e.p = t.id
), loose AS (
  SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.hierarchy = e.hierarchy AND t.id = e.id)
), reach AS (
  SELECT hierarchy, id, p AS at FROM loose
  UNION SELECT r.hierarchy, r.id, l.p FROM reach r JOIN loose l ON l.hierarchy = r.hierarchy AND l.id = r.at
), cyc AS (
  SELECT r.hierarchy, r.id, min(r.at) AS root FROM reach r WHERE EXISTS (SELECT 1 FROM reach s WHERE s.hierarchy = r.hierarchy AND s.id = r.at AND s.at = r.at) GROUP BY ALL
)
"""

P4_FOUND_SQL = _TREES_SQL + """
SELECT hierarchy, id AS node_id, root AS root_id FROM tree WHERE depth > 0 UNION ALL SELECT hierarchy, id, root FROM cyc
"""

P4_PATHS_SQL = _TREES_SQL + """
SELECT hierarchy, id AS node_id, root AS root_id, CAST(depth AS BIGINT) AS depth, false AS cyclic, path FROM tree
UNION ALL SELECT hierarchy, id, root, NULL, true, NULL FROM cyc
"""

P4_DESCENDANTS_SQL = _TREES_SQL + """
SELECT hierarchy, CAST(s[i] AS BIGINT) AS ancestor_id, id AS node_id, CAST(depth + 1 - i AS BIGINT) AS distance
FROM (SELECT hierarchy, id, depth, string_split(path, '/') AS s, unnest(range(1, depth + 1)) AS i FROM tree WHERE depth > 0)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    def one(child: str, ref: str, parent: str) -> DataFrame:
        children = table(spark, d, child).select("id", ref, "loaded_at")
        parents = table(spark, d, parent).select("id", "deleted_at", "loaded_at")
        found = orphans.orphan_references(children, parents, child_key="id", ref=ref, child_loaded="loaded_at", parent_key="id", deleted="deleted_at", parent_loaded="loaded_at")
        return found.withColumn("child_table", F.lit(child))

    return one("applications", "candidate_id", "candidates").unionByName(one("payroll_entries", "employee_id", "employees"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "row_id")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


def _orphans_sql(child: str, ref: str, parent: str) -> str:
    return f"""
SELECT '{child}' AS child_table, c.row_id, c.child_loaded, CASE WHEN p.id IS NULL THEN 'absent' WHEN p.gone THEN 'deleted' ELSE 'late' END AS reason
FROM (SELECT id AS row_id, arg_max({ref}, loaded_at) AS ref, min(loaded_at) AS child_loaded FROM {child} GROUP BY id) c
LEFT JOIN (SELECT id, min(loaded_at) AS first_loaded, arg_max(CAST(deleted_at IS NOT NULL AS INT), loaded_at) = 1 AS gone FROM {parent} GROUP BY id) p ON p.id = c.ref
WHERE c.ref IS NOT NULL AND (p.id IS NULL OR p.gone OR p.first_loaded > c.child_loaded)
"""


_ORPHANS_SQL = _orphans_sql("applications", "candidate_id", "candidates") + " UNION ALL " + _orphans_sql("payroll_entries", "employee_id", "employees")
P5_FOUND_SQL = f"SELECT child_table, row_id FROM ({_ORPHANS_SQL})"
P5_COUNTS_SQL = f"SELECT child_table, strftime(child_loaded AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS orphan_count FROM ({_ORPHANS_SQL}) GROUP BY ALL"

QUERIES = {
    "p1_found": p1_found, "p1_periods": p1_periods, "p2_found": p2_found, "p2_profile": p2_profile,
    "p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p5_found": p5_found, "p5_counts": p5_counts,
}
ORACLE = {
    "p1_found": P1_FOUND_SQL, "p1_periods": P1_PERIODS_SQL, "p2_found": P2_FOUND_SQL, "p2_profile": P2_PROFILE_SQL,
    "p4_found": P4_FOUND_SQL, "p4_paths": P4_PATHS_SQL, "p4_descendants": P4_DESCENDANTS_SQL, "p5_found": P5_FOUND_SQL, "p5_counts": P5_COUNTS_SQL,
}
