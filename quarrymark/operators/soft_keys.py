"""Keys of several columns, keys that name their table in another column, and keys inside JSON."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrymark.functions import names
from quarrymark.functions.types import compat_group
from quarrymark.operators import inclusion
from quarrymark.operators.inclusion import Side


def soft_confidence(name: Column, containment: Column, distinct: Column) -> Column:
    return F.round(0.7 * containment + 0.2 * name + 0.1 * F.least(distinct / 1000.0, F.lit(1.0)), 4)


def composite_proposals(singles: DataFrame, max_arity: int = 3, least: float = 0.95, least_name: float = 0.5, most: int = 10) -> list[tuple[str, str, tuple[str, ...], tuple[str, ...], float]]:
    """(child table, parent table, child columns, parent columns, mean name similarity) to be tested as tuples.

    singles: child_table, child_column, parent_table, parent_column, containment of single-column
    candidates, which are metadata. A subset is proposed if each containment reaches ``least`` but
    not all are full, all names are alike by ``least_name``, and no column occurs twice; at most
    ``most`` of a pair of tables, best names first.
    """
    groups: dict[tuple[str, str], list] = {}
    for r in singles.orderBy("child_table", "parent_table", "child_column", "parent_column").collect():
        if r["child_table"] != r["parent_table"]:
            groups.setdefault((r["child_table"], r["parent_table"]), []).append(r)
    out = []
    for (child, parent), rows in groups.items():
        made = []
        for n in range(2, max_arity + 1):
            for subset in combinations(rows, n):
                held = [r["containment"] for r in subset]
                alike = [names.ratio(r["child_column"].lower(), r["parent_column"].lower()) for r in subset]
                distinct = len({r["child_column"] for r in subset}) == n == len({r["parent_column"] for r in subset})
                if distinct and min(held) >= least and min(held) < 1.0 and min(alike) >= least_name:
                    made.append((-sum(alike) / n, -min(alike), child, parent, tuple(r["child_column"] for r in subset), tuple(r["parent_column"] for r in subset)))
        out += [(c, p, a, b, -mean) for mean, _, c, p, a, b in sorted(made)[:most]]
    return out


def composite_keys(spark: SparkSession, tables: dict[str, DataFrame], proposals: list, least: float = 0.95) -> DataFrame:
    """child_table, parent_table, child_columns, parent_columns (comma lists), counts and containment of the proposals that hold."""
    out = None
    for child, parent, a, b, mean in proposals:
        one = inclusion.tuple_containment(tables[child], list(a), tables[parent], list(b), least).where(F.col("containment") >= least)
        one = one.select(F.lit(child).alias("child_table"), F.lit(parent).alias("parent_table"), F.lit(",".join(a)).alias("child_columns"), F.lit(",".join(b)).alias("parent_columns"), "child_distinct", "parent_distinct", "orphans", "containment", "cardinality", F.lit(round(mean, 4)).alias("name_similarity"))
        out = one if out is None else out.unionByName(one)
    schema = "child_table string, parent_table string, child_columns string, parent_columns string, child_distinct long, parent_distinct long, orphans long, containment double, cardinality string, name_similarity double"
    return spark.createDataFrame([], schema) if out is None else out


def discriminator_pairs(columns: DataFrame) -> DataFrame:
    """table_name, type_column, id_column: ``<p>_type`` or ``<p>_kind`` (short text) beside ``<p>_id`` (integer or uuid)."""
    kind = columns.where(F.col("column_name").rlike(r"(?i)^.+_(type|kind)$") & (F.col("type_class") == "STRING_SHORT")).select("table_name", F.col("column_name").alias("type_column"), F.lower(F.regexp_extract("column_name", r"(?i)^(.+)_(type|kind)$", 1)).alias("p"))
    ids = columns.where(F.lower("column_name").endswith("_id") & compat_group(F.col("type_class")).isin("INT", "UUID")).select("table_name", F.col("column_name").alias("id_column"), F.lower(F.regexp_extract("column_name", r"(?i)^(.+)_id$", 1)).alias("p"))
    return kind.join(ids, ["table_name", "p"]).drop("p")


def polymorphic_keys(table: DataFrame, type_col: str, id_col: str, parents: list[Side], least: float = 0.95, most_kinds: int = 20) -> DataFrame:
    """kind, parent, counts, containment, confidence: the parents that hold the ids of a discriminator value.

    A column with more than ``most_kinds`` values is no discriminator and gives no rows. Each
    value is tested against every parent in one pass; of a parent named like the value the name
    counts in full, of others 0.85.
    """
    kinds = [r[0] for r in table.where(F.col(type_col).isNotNull()).select(type_col).distinct().limit(most_kinds + 1).collect()]
    if len(kinds) > most_kinds:
        kinds = []
    out = inclusion.partition_containment(table, type_col, id_col, [(k, p) for k in kinds for p in parents], least)
    named = {k: names.table_forms(k) for k in kinds}
    hit = [F.struct(F.lit(k).alias("kind"), F.lit(p.name).alias("parent")) for k in kinds for p in parents if p.name.split(".")[-2].lower() in named[k]]
    is_named = F.struct("kind", "parent").isin(*hit) if hit else F.lit(False)
    out = out.withColumn("confidence", soft_confidence(F.when(is_named, 1.0).otherwise(0.85), F.col("containment"), F.col("child_distinct")))
    return out.where((F.col("child_distinct") > 0) & (F.col("containment") >= least)).select("kind", "parent", "child_distinct", "parent_distinct", "orphans", "containment", "cardinality", "confidence")


def discovered_polymorphic(tables: dict[str, DataFrame], columns: DataFrame, parents: list[Side], least: float = 0.95) -> DataFrame:
    """table_name, type_column, id_column and what ``polymorphic_keys`` gives, of every pair that ``discriminator_pairs`` finds in the tables; columns: table_name, column_name, type_class."""
    found = None
    for r in discriminator_pairs(columns).orderBy("table_name", "type_column", "id_column").collect():  # metadata
        one = polymorphic_keys(tables[r["table_name"]].select(r["type_column"], r["id_column"]), r["type_column"], r["id_column"], parents, least)
        one = one.select(F.lit(r["table_name"]).alias("table_name"), F.lit(r["type_column"]).alias("type_column"), F.lit(r["id_column"]).alias("id_column"), "*")
        found = one if found is None else found.unionByName(one)
    schema = "table_name string, type_column string, id_column string, kind string, parent string, child_distinct long, parent_distinct long, orphans long, containment double, cardinality string, confidence double"
    return columns.sparkSession.createDataFrame([], schema) if found is None else found


def json_keys(name: str, table: DataFrame, column: str, parents: dict[str, list[Side]], least: float = 0.95, least_distinct: int = 5) -> DataFrame:
    """path, parent, counts, containment, confidence: leaves of a JSON column whose values lie in a key.

    parents: keys by kind (``int``, ``uuid``). Leaves within arrays are left out; a leaf counts
    as the kind that most of its values have.
    """
    leaves = inclusion.json_leaves(table, column).where("kind <> 'none'")
    paths = [(r["path"], r["kind"]) for r in leaves.groupBy("path").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind")).where("kind in ('int', 'uuid') and not path like '%[*]%'").orderBy("path").collect()]
    out = None
    for path, kind in paths:
        leaf = inclusion.json_side(f"{name}.{column}.{path}", table, column, path)
        for p in parents.get(kind, []):
            one = inclusion.containment(leaf, inclusion.as_text(p), least)
            alike = 1.0 if path.split(".")[-1].lower() in (f"{names.singular(p.name.split('.')[-2])}_id", p.name.split(".")[-1].lower()) else 0.6
            one = one.withColumn("path", F.lit(path)).withColumn("confidence", soft_confidence(F.lit(alike), F.col("containment"), F.col("child_distinct")))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return table.sparkSession.createDataFrame([], "path string, parent string, child_distinct long, parent_distinct long, orphans long, containment double, cardinality string, confidence double")
    return out.where((F.col("containment") >= least) & (F.col("child_distinct") >= least_distinct)).select("path", "parent", "child_distinct", "parent_distinct", "orphans", "containment", "cardinality", "confidence")
