"""The inventory of a source: its tables and columns from catalog tables, from JDBC or from the files themselves.

Catalog tables have the columns of an information schema and of the index catalog; they are
metadata, joined and kept as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.functions import types as kinds
from quarrymark.operators import profile

#: What is read of a source's catalog, by name; {schema} is checked before it is put in.
CATALOG = {
    "tables": "SELECT table_name, table_type FROM information_schema.tables WHERE table_schema = '{schema}'",
    "columns": "SELECT table_name, column_name, ordinal_position, data_type, is_nullable, character_maximum_length FROM information_schema.columns WHERE table_schema = '{schema}'",
    "constraints": "SELECT constraint_name, table_name, constraint_type FROM information_schema.table_constraints WHERE table_schema = '{schema}'",
    "key_usage": "SELECT constraint_name, table_name, column_name, ordinal_position FROM information_schema.key_column_usage WHERE table_schema = '{schema}'",
    "references": "SELECT c.constraint_name, u.table_name AS parent_table, u.column_name AS parent_column FROM information_schema.referential_constraints c JOIN information_schema.constraint_column_usage u ON u.constraint_name = c.constraint_name AND u.constraint_schema = c.constraint_schema WHERE c.constraint_schema = '{schema}'",
    "stats": "SELECT tablename AS table_name, attname AS column_name, n_distinct, null_frac FROM pg_catalog.pg_stats WHERE schemaname = '{schema}'",
    "index": "SELECT indrelid, CAST(indkey AS text) AS indkey, indisunique, indisprimary FROM pg_catalog.pg_index",
    "attribute": "SELECT attrelid, attnum, attname FROM pg_catalog.pg_attribute WHERE NOT attisdropped",
    "class": "SELECT c.oid, c.relname, c.reltuples, n.nspname FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace",
}
#: Probes of a connection by dialect: version, whether the schema is there, and its number of base tables.
PROBES = {
    "postgresql": ("SELECT version() AS v", "SELECT count(*) AS n FROM information_schema.schemata WHERE schema_name = '{schema}'", "SELECT count(*) AS n FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'"),
    "mysql": ("SELECT version() AS v", "SELECT count(*) AS n FROM information_schema.schemata WHERE schema_name = '{schema}'", "SELECT count(*) AS n FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'"),
    "sqlserver": ("SELECT @@VERSION AS v", "SELECT count(*) AS n FROM sys.schemas WHERE name = '{schema}'", "SELECT count(*) AS n FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'"),
    "oracle": ("SELECT banner AS v FROM v$version WHERE rownum = 1", "SELECT count(*) AS n FROM all_users WHERE username = upper('{schema}')", "SELECT count(*) AS n FROM all_tables WHERE owner = upper('{schema}')"),
}


def checked(name: str) -> str:
    """A schema's name that may stand in a query; others are refused."""
    if not name or not all(c.isalnum() or c in "_$" for c in name) or name[0].isdigit():
        raise ValueError(f"not a schema name: {name!r}")
    return name


def catalog_of(run: Callable[[str], DataFrame], schema: str) -> dict[str, DataFrame]:
    """The catalog tables of a schema; run turns a query into a DataFrame (as ``exports.from_jdbc`` does)."""
    return {name: run(query.replace("{schema}", checked(schema))) for name, query in CATALOG.items()}


def connection_probe(run: Callable[[str], DataFrame], dialect: str, schema: str) -> dict[str, object]:
    """version, schema_exists, tables of a source; a failing query gives ok False and its error."""
    try:
        version, there, tables = (run(q.replace("{schema}", checked(schema))).first()[0] for q in PROBES[dialect])
    except Exception as e:  # whatever the driver raises
        return {"ok": False, "error": f"{type(e).__name__}: {e}"[:500]}
    return {"ok": True, "version": str(version), "schema_exists": int(there) > 0, "tables": int(tables)}


def index_flags(index: DataFrame, attribute: DataFrame, class_: DataFrame, schema: str) -> DataFrame:
    """table_name, column_name, is_unique_indexed: every column of an index; unique if any of its indexes is unique or primary, of several columns too.

    indkey lists attribute numbers with spaces between; 0 stands for an expression and is left out.
    """
    parts = index.select("indrelid", (F.col("indisunique") | F.col("indisprimary")).alias("u"), F.explode(F.split(F.trim("indkey"), " +")).alias("n")).withColumn("attnum", F.col("n").try_cast("int")).where("attnum <> 0")
    tables = class_.where(F.col("nspname") == schema).select(F.col("oid").alias("indrelid"), F.col("relname").alias("table_name"))
    names = attribute.select(F.col("attrelid").alias("indrelid"), F.col("attnum").cast("int").alias("attnum"), F.col("attname").alias("column_name"))
    return parts.join(tables, "indrelid").join(names, ["indrelid", "attnum"]).groupBy("table_name", "column_name").agg(F.bool_or("u").alias("is_unique_indexed"))


def inventory(tables: DataFrame, columns: DataFrame, constraints: DataFrame, key_usage: DataFrame, flags: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """table_name, column_name, ordinal, data_type, type_class, is_nullable, is_pk, is_indexed, is_unique_indexed, eligible, status, exclusion_reason[, n_distinct, null_frac]: the columns of all base tables."""
    base = tables.where("table_type = 'BASE TABLE'").select("table_name").distinct()
    pk = constraints.where("constraint_type = 'PRIMARY KEY'").select("constraint_name", "table_name").join(key_usage.select("constraint_name", "table_name", "column_name"), ["constraint_name", "table_name"])
    key = ["table_name", "column_name"]
    out = columns.join(base, "table_name").join(pk.select(*key, F.lit(True).alias("is_pk")).distinct(), key, "left").join(flags.withColumn("is_indexed", F.lit(True)), key, "left")
    out = out.fillna(False, ["is_pk", "is_indexed", "is_unique_indexed"]).withColumn("type_class", kinds.type_class(F.col("data_type"), F.col("character_maximum_length")))
    reason = kinds.exclusion_reason(F.col("table_name"))
    out = out.withColumns({"eligible": kinds.is_eligible(F.col("type_class"), F.col("column_name"), F.col("is_pk"), F.col("is_unique_indexed")), "exclusion_reason": reason, "status": F.when(reason.isNotNull(), "excluded").otherwise("pending")})
    keep = [*key, F.col("ordinal_position").alias("ordinal"), "data_type", "type_class", (F.col("is_nullable") == "YES").alias("is_nullable"), "is_pk", "is_indexed", "is_unique_indexed", "eligible", "status", "exclusion_reason"]
    if stats is not None:
        out = out.join(stats.select(*key, "n_distinct", "null_frac"), key, "left")
        keep += ["n_distinct", "null_frac"]
    return out.select(*keep)


def declared_edges(constraints: DataFrame, key_usage: DataFrame, references: DataFrame) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, confidence (1.0), cardinality (1:N) of declared foreign keys."""
    fk = constraints.where("constraint_type = 'FOREIGN KEY'").select("constraint_name", F.col("table_name").alias("child_table"))
    use = key_usage.select("constraint_name", F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"))
    return fk.join(use, ["constraint_name", "child_table"]).join(references, "constraint_name").select("child_table", "child_column", "parent_table", "parent_column", F.lit(1.0).alias("confidence"), F.lit("1:N").alias("cardinality")).distinct()


def of_tables(spark: SparkSession, tables: dict[str, DataFrame], declared: list[tuple[str, str]] = ()) -> DataFrame:
    """The same inventory of a folder of tables, whose schemas know no keys; declared: (table, column) of primary keys."""
    out = profile.catalog(spark, tables)
    pk = F.concat_ws(".", "table_name", "column_name").isin([f"{t}.{c}" for t, c in declared]) if declared else F.lit(False)
    reason = kinds.exclusion_reason(F.col("table_name"))
    return out.withColumns({"is_pk": pk, "eligible": kinds.is_eligible(F.col("type_class"), F.col("column_name"), pk, F.lit(False)), "exclusion_reason": reason, "status": F.when(reason.isNotNull(), "excluded").otherwise("pending")})


def re_inventoried(old: DataFrame, now: DataFrame) -> DataFrame:
    """old's tables (table_name, status, exclusion_reason, parquet_path) after a new look: those left out before that now (table_name, exclusion_reason) have no reason are pending again, without path; new reasons hold."""
    n = now.select("table_name", F.col("exclusion_reason").alias("_reason"), F.lit(True).alias("_seen"))
    out = old.join(n, "table_name", "left")
    back = F.coalesce("_seen", F.lit(False)) & F.col("_reason").isNull() & (F.col("status") == "excluded")
    out_now = F.coalesce(F.col("_reason").isNotNull(), F.lit(False))
    status = F.when(back, "pending").when(out_now, "excluded").otherwise(F.col("status"))
    return out.select("table_name", status.alias("status"), F.when(back, F.lit(None)).otherwise(F.coalesce("_reason", "exclusion_reason")).alias("exclusion_reason"), F.when(~back, F.col("parquet_path")).alias("parquet_path"))


def in_scope(df: DataFrame, schemas: list[str] | None, column: str = "schema_name") -> DataFrame:
    """Rows of the schemas; all of them if none are named."""
    return df.where(F.col(column).isin(schemas)) if schemas else df


def name_cardinality(child_column: str, parent_column: str) -> str:
    """1:N from the parent's side where only names are known and the child is named for a key; else M:N."""
    child, parent = child_column.lower(), parent_column.lower()
    return "1:1" if child == parent == "id" else "N:1" if child.endswith("_id") or child.endswith("_key") else "1:N" if parent.endswith("_id") else "M:N"
