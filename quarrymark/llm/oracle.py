"""SQL that the training-data queries are compared with."""

_MEMBERS = """
WITH m AS (SELECT DISTINCT column_id, key_value FROM key_values WHERE column_id IS NOT NULL AND key_value <> ''),
sizes AS (SELECT column_id, count(*) AS size FROM m GROUP BY ALL),
pairs AS (
  SELECT x.column_id AS column_id_a, y.column_id AS column_id_b, count(*) AS shared FROM m x JOIN m y ON x.key_value = y.key_value AND x.column_id < y.column_id GROUP BY ALL
)
"""
ORACLE = {
    "p3_found": _MEMBERS + """
SELECT column_id_a, column_id_b FROM pairs JOIN sizes a ON a.column_id = column_id_a JOIN sizes b ON b.column_id = column_id_b WHERE 2 * shared >= least(a.size, b.size)
""",
    "p3_overlaps": _MEMBERS + """
SELECT column_id_a, column_id_b, shared, a.size AS size_a, b.size AS size_b, round(shared / least(a.size, b.size), 6) AS containment, round(shared / (a.size + b.size - shared), 6) AS jaccard
FROM pairs JOIN sizes a ON a.column_id = column_id_a JOIN sizes b ON b.column_id = column_id_b
""",
}
