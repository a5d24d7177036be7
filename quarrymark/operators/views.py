"""Read models over results: unified relationships, figures against a gold set, edges between clusters, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymark.functions import names


def unified(relationships: DataFrame, composites: DataFrame) -> DataFrame:
    """All relationships in one form; a composite is anchored on its first pair of columns.

    relationships: child_table, child_column, parent_table, parent_column, containment,
    confidence; composites: child_table, parent_table, child_columns, parent_columns (comma
    lists), containment, confidence.
    """
    one = relationships.select(F.lit("single").alias("kind"), "child_table", "child_column", "parent_table", "parent_column", "containment", "confidence")
    first = lambda c: F.split_part(F.col(c), F.lit(","), F.lit(1))
    many = composites.select(F.lit("composite").alias("kind"), "child_table", first("child_columns").alias("child_column"), "parent_table", first("parent_columns").alias("parent_column"), "containment", "confidence")
    return one.unionByName(many)


def recall_precision(found: DataFrame, gold: DataFrame) -> DataFrame:
    """hits, found, expected, recall, precision of exact (child_table, child_column, parent_table, parent_column), compared in lower case; four digits."""
    key = ["child_table", "child_column", "parent_table", "parent_column"]
    low = lambda df: df.select(*[F.lower(c).alias(c) for c in key]).distinct()
    both = low(found).withColumn("f", F.lit(1)).withColumn("g", F.lit(0)).unionByName(low(gold).withColumn("f", F.lit(0)).withColumn("g", F.lit(1))).groupBy(*key).agg(F.max("f").alias("f"), F.max("g").alias("g"))
    out = both.agg(F.count_if((F.col("f") == 1) & (F.col("g") == 1)).alias("hits"), F.count_if(F.col("f") == 1).alias("found"), F.count_if(F.col("g") == 1).alias("expected"))
    share = lambda of: F.round(F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0), 4)
    return out.select("*", share("expected").alias("recall"), share("found").alias("precision"))


def cluster_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_a, cluster_b, edges, weight between different clusters; edges: parent, child, weight; members: table_name, cluster_id."""
    side = lambda s: members.select(F.col("table_name").alias(s), F.col("cluster_id").alias(f"c_{s}"))
    both = edges.join(side("parent"), "parent").join(side("child"), "child").where("c_parent <> c_child")
    return both.groupBy(F.least("c_parent", "c_child").alias("cluster_a"), F.greatest("c_parent", "c_child").alias("cluster_b")).agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def latest_runs(log: DataFrame) -> DataFrame:
    """Of each (phase, scope_type, scope_id) the last entry by finished_at; a null scope is the whole run, 0."""
    scoped = log.fillna({"scope_id": 0})
    last = Window.partitionBy("phase", "scope_type", "scope_id").orderBy(F.desc_nulls_last("finished_at"), F.desc("status"))
    return scoped.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def run_summary(log: DataFrame) -> DataFrame:
    return latest_runs(log).groupBy("phase", "status").agg(F.count("*").alias("n"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """old with new's rows put in place of those with equal keys. Of new rows with equal keys that with the greatest version stays, of equal versions or without one the greatest in the order of its other columns."""
    rest = [c for c in new.columns if c not in keys and c != version]
    best = F.max(F.struct(*([version] if version else []), *rest)).alias("_r")
    last = new.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.`{c}`") for c in new.columns if c not in keys]).select(*new.columns)
    return last.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def with_regulations(found: DataFrame, rules: DataFrame) -> DataFrame:
    """found with its regulations as a comma list, empty if none names the kind."""
    lists = rules.groupBy("pii_type").agg(F.array_join(F.sort_array(F.collect_set("regulation")), ",").alias("regulations"))  # a few per kind
    return found.join(F.broadcast(lists), "pii_type", "left").fillna("", ["regulations"])


def foreign_columns(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """columns (table_name, column_name) with is_fk: whether an edge (child_table, child_column) starts there."""
    marks = edges.select(F.col("child_table").alias("table_name"), F.col("child_column").alias("column_name"), F.lit(True).alias("_fk")).distinct()
    return columns.join(marks, ["table_name", "column_name"], "left").withColumn("is_fk", F.coalesce("_fk", F.lit(False))).drop("_fk")


def context_graph(tables: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, domain, entity type) and links (source, target, weight, cardinality) of a schema; tables: table_name, domain, table_type."""
    nodes = tables.select(F.col("table_name").alias("id"), F.col("domain").alias("group"), "table_type")
    links = relationships.groupBy(F.col("child_table").alias("source"), F.col("parent_table").alias("target")).agg(F.max("confidence").alias("weight"), F.max_by("cardinality", "confidence").alias("cardinality"))
    return nodes, links


def direction_reason(child_column: Column, parent_column: Column, child_pk: Column, parent_pk: Column, parent_unique: Column) -> Column:
    """Why an edge points the way it does, by the first rule that holds."""
    pk = lambda c: F.coalesce(c, F.lit(False))
    low = F.lower(parent_column)
    role = F.lower(child_column).isin(*names.ROLES) & ((low == "id") | low.endswith("_id"))
    return (
        F.when(role, "role-FK bypass").when(pk(parent_pk) & ~pk(child_pk), "declared PK on parent").when(pk(parent_pk) & pk(child_pk), "inheritance — both PKs, larger parent")
        .when(pk(parent_unique), "implicit PK reconciled").otherwise("name similarity / containment")
    )


def quality_view(findings: DataFrame) -> DataFrame:
    """Quality findings with rank, their place by severity (HIGH, MEDIUM, others), table, column and finding; findings are metadata."""
    grade = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return findings.withColumn("rank", F.row_number().over(Window.orderBy(grade, "table_name", "column_name", "finding")))


def cluster_detail(tables: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, tables, rows, inner_edges, bridge_edges, inner_weight of each cluster: tables (table_name, row_count), edges (parent, child, weight), members (table_name, cluster_id). A bridge edge leads to another cluster and counts for both."""
    side = lambda s: members.select(F.col("table_name").alias(s), F.col("cluster_id").alias(f"c_{s}"))
    both = edges.join(side("parent"), "parent").join(side("child"), "child")
    inner = both.where("c_parent = c_child").groupBy(F.col("c_parent").alias("cluster_id")).agg(F.count("*").alias("inner_edges"), F.round(F.sum("weight"), 6).alias("inner_weight"))
    across = both.where("c_parent <> c_child")
    bridge = across.select(F.col("c_parent").alias("cluster_id")).unionByName(across.select(F.col("c_child").alias("cluster_id"))).groupBy("cluster_id").agg(F.count("*").alias("bridge_edges"))
    size = members.join(tables, "table_name", "left").groupBy("cluster_id").agg(F.count("*").alias("tables"), F.sum(F.coalesce("row_count", F.lit(0))).alias("rows"))
    return size.join(inner, "cluster_id", "left").join(bridge, "cluster_id", "left").fillna(0, ["inner_edges", "bridge_edges"]).fillna(0.0, ["inner_weight"])


def source_schemas(tables: DataFrame) -> DataFrame:
    """schema_name, table_count; the catalog's own schemas aside."""
    return tables.where(~F.col("schema_name").isin("pg_catalog", "information_schema")).groupBy("schema_name").agg(F.count("*").alias("table_count"))
