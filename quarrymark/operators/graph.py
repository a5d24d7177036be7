"""The graph of tables: weighted edges, archetypes, junctions, clusters and patterns of a schema.

Nodes are tables and edges relationships, so these DataFrames have as many rows as a schema has
tables and columns. Louvain, which is sequential by nature, runs on the driver over them.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymark.functions.names import singular

#: Weights, name patterns and limits of the archetype rules.
FACTORS = {"MANY_TO_MANY": 0.3}
SAME_SCHEMA, SHARED_PII = 0.15, 0.10
AUDIT_NAME = r"(?i)(audit|history|log|change|event)"
AUDIT_COLUMN = r"(?i)^(created_at|updated_at|created_by|updated_by|deleted_at|created_on|updated_on|last_update|last_updated|last_modified|version|row_version|etl_loaded_at)$"
LOOKUP_ROWS = 100
SURROGATE_NAME = r"(?i)^(.*_id|id)$"
INTEGER_TYPE = r"(?i)^(int|integer|bigint|smallint|serial|bigserial|tinyint)\b"
#: Tables by which well-known schemas are recognised.
KNOWN_SCHEMAS = {
    "AdventureWorks": ("business_entity", "person", "customer", "employee", "vendor", "address", "address_type", "country_region", "state_province", "business_entity_address", "business_entity_contact", "credit_card", "person_credit_card", "sales_order_header", "sales_order_detail", "sales_person", "sales_territory", "sales_reason", "currency", "currency_rate", "product", "product_category", "product_subcategory", "product_inventory", "product_model", "product_review", "product_vendor", "purchase_order_header", "purchase_order_detail", "department", "shift", "store"),
    "Northwind": ("categories", "customers", "employees", "order_details", "orders", "products", "shippers", "suppliers", "territories", "region", "employee_territories"),
    "Saleor": ("account_user", "checkout_checkout", "checkout_checkoutline", "order_order", "order_orderline", "product_product", "product_productvariant", "product_category", "warehouse_warehouse", "shipping_shippingmethod", "discount_voucher", "channel_channel"),
    "DVDRental": ("actor", "address", "category", "city", "country", "customer", "film", "film_actor", "film_category", "inventory", "language", "payment", "rental", "staff", "store"),
    "WordPress": ("wp_posts", "wp_postmeta", "wp_users", "wp_usermeta", "wp_options", "wp_terms", "wp_term_relationships", "wp_term_taxonomy", "wp_comments", "wp_commentmeta"),
    "Drupal": ("node", "node_field_data", "users", "users_field_data", "taxonomy_term_data", "file_managed", "block_content", "menu_link_content"),
    "Magento": ("catalog_product_entity", "catalog_category_entity", "sales_order", "sales_order_item", "customer_entity", "quote", "quote_item", "store", "store_website"),
}


def edge_weight(confidence: Column, cardinality: Column, shared_pii: Column) -> Column:
    factor = F.when(cardinality == "MANY_TO_MANY", FACTORS["MANY_TO_MANY"]).otherwise(1.0)
    return confidence * factor + SAME_SCHEMA + F.when(shared_pii, SHARED_PII).otherwise(0.0)


def table_edges(relationships: DataFrame, pii: DataFrame, confidence_floor: float = 0.0) -> DataFrame:
    """parent, child, weight, cardinality (that with most weight): relationships (child_table, parent_table, confidence, cardinality) between different tables, summed; pii: table_name, pii_type."""
    kinds = pii.groupBy("table_name").agg(F.collect_set("pii_type").alias("kinds"))  # kinds are few
    k = lambda side: kinds.select(F.col("table_name").alias(f"{side}_table"), F.col("kinds").alias(f"{side}_kinds"))
    rows = relationships.where((F.col("confidence") >= confidence_floor) & (F.col("child_table") != F.col("parent_table"))).join(k("child"), "child_table", "left").join(k("parent"), "parent_table", "left")
    weight = edge_weight(F.col("confidence"), F.col("cardinality"), F.coalesce(F.arrays_overlap("child_kinds", "parent_kinds"), F.lit(False)))
    by_kind = rows.groupBy("parent_table", "child_table", "cardinality").agg(F.sum(weight).alias("w"))
    return by_kind.groupBy(F.col("parent_table").alias("parent"), F.col("child_table").alias("child")).agg(F.round(F.sum("w"), 6).alias("weight"), F.max_by("cardinality", F.struct("w", "cardinality")).alias("cardinality"))


def archetypes(tables: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """table_name, archetype: JUNCTION, LOOKUP, FACT, AUDIT, DIMENSION, or EMPTY without rows.

    tables: table_name, row_count; columns: table_name, column_name, is_key, is_fk; edges as from
    ``table_edges``. The upper median and the interpolated third quartile are of tables with rows.
    """
    out_e = edges.groupBy(F.col("child").alias("table_name")).agg(F.count("*").alias("n_out"), F.count_if(F.col("cardinality") == "MANY_TO_ONE").alias("n_mto"), F.bool_and(F.col("cardinality").isin("MANY_TO_ONE", "ONE_TO_ONE")).alias("joins_only"))
    in_e = edges.groupBy(F.col("parent").alias("table_name")).agg(F.count("*").alias("n_in"))
    plain = ~F.col("is_key") & ~F.col("is_fk") & ~F.col("column_name").rlike(AUDIT_COLUMN)
    cols = columns.groupBy("table_name").agg(F.count("*").alias("n_cols"), F.bool_or("is_key").alias("has_key"), F.count_if(plain).alias("n_plain"))
    ranked = tables.where("row_count > 0").select("row_count")
    stats = ranked.agg(F.percentile("row_count", 0.75).alias("q3"), F.sort_array(F.collect_list("row_count")).alias("sorted"))  # a number per table
    stats = stats.select(F.coalesce("q3", F.lit(0.0)).alias("q3"), F.coalesce(F.get("sorted", F.floor(F.size("sorted") / 2).cast("int")), F.lit(0)).alias("median"))
    t = tables.join(out_e, "table_name", "left").join(in_e, "table_name", "left").join(cols, "table_name", "left").fillna(0, ["n_out", "n_mto", "n_in", "n_cols", "n_plain"]).crossJoin(F.broadcast(stats))  # one row
    c = F.col
    audit = c("table_name").rlike(AUDIT_NAME) & (c("n_in") >= 1)
    middle = (c("row_count") < c("q3")) & (c("n_in") >= 1) & (c("n_out") <= 2) & (c("row_count") >= c("median") / 4)
    junction = (c("n_cols") <= 4) & (c("n_out") >= 2) & c("joins_only") & c("has_key") & (c("n_plain") == 0)
    kind = (
        F.when(F.coalesce(c("row_count"), F.lit(0)) == 0, "EMPTY").when(junction, "JUNCTION").when((c("row_count") < LOOKUP_ROWS) & (c("n_in") >= 3) & (c("n_out") <= 1), "LOOKUP")
        .when((c("row_count") >= c("q3")) & (c("n_mto") >= 3), "FACT").when(middle & audit, "AUDIT").when(middle, "DIMENSION").when(audit, "AUDIT").when(c("row_count") >= c("median"), "FACT").otherwise("DIMENSION")
    )
    return t.select("table_name", kind.alias("archetype"))


def collapsed(edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """edges with each junction table replaced by an edge between its two heaviest parents, with the lesser weight; junctions: table_name."""
    j = junctions.select(F.col("table_name").alias("child"), F.lit(True).alias("_j"))
    marked = edges.join(F.broadcast(j), "child", "left").join(F.broadcast(j.select(F.col("child").alias("parent"), F.col("_j").alias("_p"))), "parent", "left")
    kept = marked.where("_j is null and _p is null").select("parent", "child", "weight", "cardinality")
    top = marked.where("_j and _p is null").withColumn("n", F.row_number().over(Window.partitionBy("child").orderBy(F.desc("weight"), "parent")))
    a, b = top.where("n = 1").select("child", F.col("parent").alias("a"), F.col("weight").alias("wa")), top.where("n = 2").select("child", F.col("parent").alias("b"), F.col("weight").alias("wb"))
    made = a.join(b, "child").select(F.least("a", "b").alias("parent"), F.greatest("a", "b").alias("child"), F.least("wa", "wb").alias("weight"), F.lit("MANY_TO_MANY").alias("cardinality"))
    return kept.unionByName(made).groupBy("parent", "child").agg(F.sum("weight").alias("weight"), F.max_by("cardinality", F.struct("weight", "cardinality")).alias("cardinality"))


def louvain(edges: list[tuple[str, str, float]], nodes: list[str]) -> dict[str, int]:
    """Community of each node by Louvain's method with resolution 1, nodes taken in sorted order, so that a graph has one result.

    Communities are numbered in order of their first node.
    """
    graph: dict = {n: defaultdict(float) for n in sorted(nodes)}
    for a, b, w in edges:
        graph[a][b] += w
        if a != b:
            graph[b][a] += w
    of = {n: n for n in graph}
    while True:
        community = _moved(graph)
        if len(set(community.values())) == len(graph):
            break
        of = {n: community[c] for n, c in of.items()}
        merged: dict = {c: defaultdict(float) for c in sorted(set(community.values()))}
        for a, near in graph.items():
            for b, w in near.items():
                x, y = community[a], community[b]
                merged[x][y] += w if a != b or x != y else w
        for c in merged:  # inner edges were seen from both ends
            inner = sum(w for a, near in graph.items() if community[a] == c for b, w in near.items() if b != a and community[b] == c)
            own = sum(near.get(a, 0.0) for a, near in graph.items() if community[a] == c)
            merged[c][c] = inner / 2 + own
        graph = merged
    names: dict = {}
    return {n: names.setdefault(of[n], len(names)) for n in sorted(of)}


def _moved(graph: dict) -> dict:
    """One phase of local moves: each node to the neighbouring community of greatest gain, until none moves."""
    degree = {n: sum(near.values()) + near.get(n, 0.0) for n, near in graph.items()}
    total = sum(degree.values()) / 2
    community = {n: n for n in graph}
    if not total:
        return community
    size = dict(degree)
    changed = True
    while changed:
        changed = False
        for n, near in graph.items():
            here = community[n]
            size[here] -= degree[n]
            links: dict = defaultdict(float)
            for m, w in near.items():
                if m != n:
                    links[community[m]] += w
            gain = lambda c: links.get(c, 0.0) - size[c] * degree[n] / (2 * total)  # noqa: B023, E731
            best = max(sorted({here, *links}), key=lambda c: (round(gain(c), 12), c == here))
            size[best] += degree[n]
            if best != here:
                community[n], changed = best, True
    return community


def clusters(tables: DataFrame, edges: DataFrame, kinds: DataFrame, schema: str) -> DataFrame:
    """table_name, cluster_id, cluster_name, archetype, modularity (the cluster's part): tables without rows form a last cluster of their own.

    Junctions join the cluster of their parent with the greater weighted degree (of equals the
    first by name), one without parents is alone. A cluster is named after its FACT or DIMENSION
    of greatest weighted degree.
    """
    spark = tables.sparkSession
    kind = {r["table_name"]: r["archetype"] for r in kinds.collect()}  # tables of a schema
    rows = [(r["parent"], r["child"], r["weight"]) for r in edges.collect()]
    junction = {t for t, k in kind.items() if k == "JUNCTION"}
    plain = [(r["parent"], r["child"], r["weight"]) for r in collapsed(edges, kinds.where("archetype = 'JUNCTION'")).collect()]
    live = sorted(t for t, k in kind.items() if k not in ("EMPTY", "JUNCTION"))
    of = louvain([e for e in plain if e[0] in live and e[1] in live], live)
    degree: dict = defaultdict(float)
    for a, b, w in plain:
        degree[a] += w
        degree[b] += w
    extra = max(of.values(), default=-1)
    for t in sorted(junction):
        parents = [p for p, c, _ in rows if c == t and p in of]
        if parents:
            of[t] = of[min(parents, key=lambda p: (-degree[p], p))]
        else:
            extra += 1
            of[t] = extra
    empty = sorted(t for t, k in kind.items() if k == "EMPTY")
    last = extra + 1
    m = sum(w for _, _, w in plain)
    out = []
    for c in sorted(set(of.values())):
        members = sorted(t for t in of if of[t] == c)
        anchors = [t for t in members if kind[t] in ("FACT", "DIMENSION")]
        prefix = [t.split("_")[0] for t in members]
        common = max(sorted(set(prefix)), key=prefix.count)
        name = f"{singular(min(anchors, key=lambda t: (-degree[t], t)))}_cluster" if anchors else f"{common}_cluster" if prefix.count(common) >= 0.6 * len(prefix) else f"{schema}_cluster_{c}"
        inside = sum(w for a, b, w in plain if of.get(a) == c and of.get(b) == c)
        part = inside / m - (sum(degree[t] for t in members) / (2 * m)) ** 2 if m else 0.0
        out += [(t, c, name, kind[t], round(part, 6)) for t in members]
    out += [(t, last, f"{schema}_empty_tables", "EMPTY", 0.0) for t in empty]
    return spark.createDataFrame(out, "table_name string, cluster_id long, cluster_name string, archetype string, modularity double")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, inside, degree, modularity: of weighted edges (parent, child, weight) under a division (table_name, cluster_id)."""
    side = lambda s: members.select(F.col("table_name").alias(s), F.col("cluster_id").alias(f"c_{s}"))
    e = edges.join(side("parent"), "parent").join(side("child"), "child")
    ends = e.select(F.col("c_parent").alias("cluster_id"), "weight", (F.col("c_parent") == F.col("c_child")).alias("inner")).withColumn("half", F.lit(1)).unionByName(e.select(F.col("c_child").alias("cluster_id"), "weight", F.lit(False).alias("inner")).withColumn("half", F.lit(1)))
    total = e.agg(F.sum("weight").alias("m"))
    by = ends.groupBy("cluster_id").agg(F.sum(F.when(F.col("inner"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    return by.crossJoin(F.broadcast(total)).select("cluster_id", F.round("inside", 6).alias("inside"), F.round("degree", 6).alias("degree"), F.round(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2), 6).alias("modularity"))  # one row


# ---- patterns of a schema ------------------------------------------------------


def known_schema(tables: DataFrame, least: float = 0.30) -> DataFrame:
    """name, jaccard, matched: the well-known schemas whose tables overlap by at least that Jaccard, best first."""
    spark = tables.sparkSession
    known = spark.createDataFrame([(s, t) for s, ts in KNOWN_SCHEMAS.items() for t in ts], "name string, table_name string")
    mine = tables.select(F.lower("table_name").alias("table_name")).distinct()
    size, sizes = mine.agg(F.count("*").alias("n")), known.groupBy("name").agg(F.count("*").alias("k"))
    hit = known.join(mine, "table_name").groupBy("name").agg(F.count("*").alias("matched")).join(sizes, "name").crossJoin(F.broadcast(size))  # one row
    return hit.withColumn("jaccard", F.round(F.col("matched") / (F.col("n") + F.col("k") - F.col("matched")), 4)).where(F.col("jaccard") >= least).select("name", "jaccard", "matched")


def temporal_coverage(columns: DataFrame, pattern: str) -> DataFrame:
    """tracked_tables, total_tables, fraction, supports_cdc: tables with a column that tells when a row changed."""
    by = columns.groupBy("table_name").agg(F.bool_or(F.col("column_name").rlike(pattern)).alias("tracked"))
    out = by.agg(F.count_if("tracked").alias("tracked_tables"), F.count("*").alias("total_tables"))
    share = F.col("tracked_tables") / F.greatest(F.col("total_tables"), F.lit(1))
    return out.select("tracked_tables", "total_tables", F.round(share, 4).alias("fraction"), (share >= 0.75).alias("supports_cdc"))


def surrogate_keys(columns: DataFrame) -> DataFrame:
    """tables_with_pk, surrogate_count, integer_count and their shares, of (table_name, column_name, data_type, is_pk)."""
    by = columns.where("is_pk").groupBy("table_name").agg(F.bool_or(F.col("column_name").rlike(SURROGATE_NAME)).alias("s"), F.bool_or(F.col("data_type").rlike(INTEGER_TYPE)).alias("i"))
    out = by.agg(F.count("*").alias("tables_with_pk"), F.count_if("s").alias("surrogate_count"), F.count_if("i").alias("integer_count"))
    n = F.greatest(F.col("tables_with_pk"), F.lit(1))
    return out.withColumns({"surrogate_pct": F.round(F.col("surrogate_count") / n, 4), "integer_pct": F.round(F.col("integer_count") / n, 4)})


def bridges(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """table_name, fk_count, total_cols, parents: tables with two or three parents and at most two further columns; edges: child, parent."""
    parents = edges.where("child <> parent").groupBy(F.col("child").alias("table_name")).agg(F.sort_array(F.collect_set("parent")).alias("p"))
    out = columns.groupBy("table_name").agg(F.count("*").alias("total_cols")).join(parents, "table_name").withColumn("fk_count", F.size("p").cast("long"))
    return out.where("fk_count between 2 and 3 and total_cols - fk_count <= 2").select("table_name", "fk_count", "total_cols", F.array_join("p", ",").alias("parents"))


def supertypes(edges: DataFrame, least: int = 2) -> DataFrame:
    """supertype, fk_column, subtypes, count: parents that several tables refer to by the parent's own key name; edges: child, child_column, parent."""
    parent, column = F.lower("parent"), F.lower("child_column")
    forms = [parent, F.when(parent.endswith("ies") & (F.length(parent) > 3), F.regexp_replace(parent, "ies$", "y")), F.when(parent.endswith("s") & ~parent.endswith("ss") & (F.length(parent) > 1), F.regexp_replace(parent, "s$", ""))]
    own = edges.where(F.coalesce(F.array_contains(F.array(F.lit("id"), *[F.concat(f, F.lit("_id")) for f in forms]), column), F.lit(False)) & (F.col("child") != F.col("parent")))
    out = own.groupBy(F.col("parent").alias("supertype"), F.col("child_column").alias("fk_column")).agg(F.sort_array(F.collect_set("child")).alias("s"))
    return out.where(F.size("s") >= least).select("supertype", "fk_column", F.array_join("s", ",").alias("subtypes"), F.size("s").cast("long").alias("count"))
