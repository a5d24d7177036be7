"""Which column's distinct values lie within another's: single, grouped, top-k, all pairs, tuples, partitions and JSON leaves.

Distinct values of both sides go through one shuffle on the value, with the map side already
combined; nothing depends on how often a value occurs, so hot values cost nothing. Nulls are
outside of every comparison, and columns of different physical families are never compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrymark.functions.types import family
from quarrymark.sources.shared import staged

THRESHOLD = 0.95
#: The type in which the values of a family are compared; of the others, text.
NATIVE = {"INTEGER": "long", "FLOAT": "double", "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean"}


@dataclass(frozen=True)
class Side:
    """A column of a table, and the name by which results call it."""

    name: str
    table: DataFrame
    column: str

    @property
    def family(self) -> str:
        return family(self.table.schema[self.column].dataType)

    def values(self) -> DataFrame:
        """value (in the family's own type), nulls left out; repeated values still there."""
        c = F.col(f"`{self.column}`")
        return self.table.where(c.isNotNull()).select(c.cast(NATIVE.get(self.family, "string")).alias("value"))


def cardinality(child: Column, parent: Column, orphans: Column, threshold: float = THRESHOLD) -> Column:
    """Class of a reference from distinct counts; the unrounded containment decides, and equal sets come first (two empty ones included)."""
    held = F.when(child > 0, 1 - orphans / child).otherwise(0.0)
    return F.when((orphans == 0) & (child == parent), "ONE_TO_ONE").when((orphans == 0) & (child > 0), "MANY_TO_ONE").when((child > 0) & (held >= threshold), "PARTIAL").otherwise("NO_RELATIONSHIP")


def _judged(counts: DataFrame, threshold: float) -> DataFrame:
    held = F.round(F.when(F.col("child_distinct") > 0, 1 - F.col("orphans") / F.col("child_distinct")).otherwise(0.0), 4)
    kind = cardinality(F.col("child_distinct"), F.col("parent_distinct"), F.col("orphans"), threshold)
    return counts.withColumn("containment", held).withColumn("cardinality", kind)


def _split(counts: DataFrame) -> list[Column]:
    in_child, in_parent = F.col("c") == 1, F.col("p") == 1
    return [F.count_if(in_child).alias("child_distinct"), F.count_if(in_parent).alias("parent_distinct"), F.count_if(in_child & ~in_parent).alias("orphans")]


def _mismatch(child: Side, parent: Side) -> DataFrame:
    zero = F.lit(0).cast("long")
    spark = child.table.sparkSession
    return spark.range(1).select(zero.alias("child_distinct"), zero.alias("parent_distinct"), zero.alias("orphans"), F.lit(0.0).alias("containment"), F.lit("TYPE_MISMATCH").alias("cardinality"))


def containment(child: Side, parent: Side, threshold: float = THRESHOLD) -> DataFrame:
    """child, parent, child_distinct, parent_distinct, orphans, containment, cardinality: one row, also for empty tables.

    Different families: TYPE_MISMATCH and zeros.
    """
    if child.family != parent.family:
        out = _mismatch(child, parent)
    else:
        both = child.values().select("value", F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(parent.values().select("value", F.lit(0).alias("c"), F.lit(1).alias("p")))
        merged = both.groupBy("value").agg(F.max("c").alias("c"), F.max("p").alias("p"))
        out = _judged(merged.agg(*_split(merged)), threshold)
    return out.select(F.lit(child.name).alias("child"), F.lit(parent.name).alias("parent"), "child_distinct", "parent_distinct", "orphans", "containment", "cardinality")


def memberships(sides: list[Side]) -> DataFrame:
    """columns (sorted array of names), n: how many values lie in exactly those columns, per family.

    The inverted index of all columns by one shuffle on the value; equal memberships are then
    counted, so that later pairing handles combinations of columns and not values.
    """
    by_family: dict[str, DataFrame] = {}
    for s in sides:
        part = s.values().select(F.lit(s.name).alias("name"), "value")
        by_family[s.family] = by_family[s.family].unionByName(part) if s.family in by_family else part
    counted = []
    for kind, rows in by_family.items():
        index = rows.distinct().groupBy("value").agg(F.sort_array(F.collect_set("name")).alias("columns"))  # at most one entry per column
        counted.append(index.groupBy("columns").agg(F.count("*").alias("n")).select(F.lit(kind).alias("family"), "columns", "n"))
    return reduce(DataFrame.unionByName, counted)


def all_pairs(sides: list[Side], threshold: float = THRESHOLD) -> DataFrame:
    """Every ordered pair of columns that share a value: child, parent, shared, child_distinct, parent_distinct, orphans, containment, cardinality."""
    return pairs_of(staged(memberships(sides), "memberships"), threshold)


def sizes_of(held: DataFrame) -> DataFrame:
    """name, size: the distinct values of each column, from memberships; columns without any are missing."""
    return held.select(F.explode("columns").alias("name"), "n").groupBy("name").agg(F.sum("n").alias("size"))


def pairs_of(held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``all_pairs`` from memberships."""
    sizes = sizes_of(held)
    pairs = held.select(F.explode("columns").alias("child"), "columns", "n").select("child", F.explode("columns").alias("parent"), "n").where("child <> parent").groupBy("child", "parent").agg(F.sum("n").alias("shared"))
    out = pairs.join(sizes.select(F.col("name").alias("child"), F.col("size").alias("child_distinct")), "child").join(sizes.select(F.col("name").alias("parent"), F.col("size").alias("parent_distinct")), "parent")
    return _judged(out.withColumn("orphans", F.col("child_distinct") - F.col("shared")), threshold)


def grouped(parent: Side, children: list[Side], threshold: float = THRESHOLD) -> DataFrame:
    """``containment`` of many children in one parent, whose values are made distinct once; pos is the children's order."""
    spark = parent.table.sparkSession
    names = spark.createDataFrame([(i, c.name, c.family == parent.family) for i, c in enumerate(children)], "pos int, child string, comparable boolean")
    index = [c for c in children if c.family == parent.family]
    rows = parent.values().select(F.lit(None).cast("string").alias("name"), "value")
    for c in index:
        rows = rows.unionByName(c.values().select(F.lit(c.name).alias("name"), "value"))
    merged = rows.distinct().groupBy("value").agg(F.max(F.col("name").isNull().cast("int")).alias("p"), F.collect_set("name").alias("children"))
    per = merged.select(F.explode("children").alias("child"), "p").groupBy("child").agg(F.count("*").alias("child_distinct"), F.count_if(F.col("p") == 0).alias("orphans"))
    total = merged.agg(F.count_if(F.col("p") == 1).alias("parent_distinct"))
    out = names.join(per, "child", "left").fillna(0, ["child_distinct", "orphans"]).crossJoin(F.broadcast(total))  # one row
    out = _judged(out.withColumn("parent_distinct", F.when(F.col("comparable"), F.col("parent_distinct")).otherwise(0)), threshold)
    return out.select("pos", "child", F.lit(parent.name).alias("parent"), "child_distinct", "parent_distinct", "orphans", "containment", F.when(F.col("comparable"), F.col("cardinality")).otherwise("TYPE_MISMATCH").alias("cardinality"))


def top_k(child: Side, parents: list[Side], k: int = 32, threshold: float = THRESHOLD) -> DataFrame:
    """The k parents that hold most of the child's values, best first, ties in the order given; incomparable parents score 0."""
    spark = child.table.sparkSession
    names = spark.createDataFrame([(i, p.name, p.family == child.family) for i, p in enumerate(parents)], "pos int, parent string, comparable boolean")
    rows = child.values().select(F.lit(None).cast("string").alias("name"), "value")
    for p in parents:
        if p.family == child.family:
            rows = rows.unionByName(p.values().select(F.lit(p.name).alias("name"), "value"))
    merged = rows.distinct().groupBy("value").agg(F.max(F.col("name").isNull().cast("int")).alias("c"), F.collect_set("name").alias("parents"))
    per = merged.select("c", F.explode("parents").alias("parent")).groupBy("parent").agg(F.count("*").alias("parent_distinct"), F.sum("c").alias("shared"))
    total = merged.agg(F.count_if(F.col("c") == 1).alias("child_distinct"))
    out = names.join(per, "parent", "left").fillna(0, ["parent_distinct", "shared"]).crossJoin(F.broadcast(total))  # one row
    out = _judged(out.withColumn("orphans", F.col("child_distinct") - F.col("shared")), threshold).withColumn("containment", F.when(F.col("comparable"), F.col("containment")).otherwise(0.0))
    ranked = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("containment"), "pos"))).where(F.col("rank") <= k)  # a row per parent column
    return ranked.select("rank", F.lit(child.name).alias("child"), "parent", "child_distinct", "parent_distinct", "orphans", "containment", F.when(F.col("comparable"), F.col("cardinality")).otherwise("TYPE_MISMATCH").alias("cardinality"))


def tuple_containment(child: DataFrame, child_cols: list[str], parent: DataFrame, parent_cols: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """child_distinct, parent_distinct, orphans, containment, cardinality of tuples; one with any null member is left out."""
    families = [(family(child.schema[a].dataType), family(parent.schema[b].dataType)) for a, b in zip(child_cols, parent_cols)]
    if any(a != b for a, b in families):
        return _mismatch(Side("", child, child_cols[0]), Side("", parent, parent_cols[0]))
    keys = [f"k{i}" for i in range(len(child_cols))]

    def side(df: DataFrame, cols: list[str], c: int) -> DataFrame:
        return df.select(*[F.col(f"`{x}`").cast(NATIVE.get(f, "string")).alias(k) for x, k, (f, _) in zip(cols, keys, families)], F.lit(c).alias("c"), F.lit(1 - c).alias("p")).dropna(subset=keys)

    merged = side(child, child_cols, 1).unionByName(side(parent, parent_cols, 0)).groupBy(*keys).agg(F.max("c").alias("c"), F.max("p").alias("p"))
    return _judged(merged.agg(*_split(merged)), threshold)


def partition_containment(child: DataFrame, kind_col: str, id_col: str, parents: dict[str, Side] | list[tuple[str, Side]], threshold: float = THRESHOLD) -> DataFrame:
    """kind, parent, child_distinct, parent_distinct, orphans, containment, cardinality: the ids of each discriminator value within the parent given for it, or within each of several.

    All are decided in one pass: child and parents are read once each. Values of kind without a
    parent here are left out, as are parents of another family than the ids.
    """
    of = family(child.schema[id_col].dataType)
    pairs = [(k, p) for k, p in (parents.items() if isinstance(parents, dict) else parents) if p.family == of]
    schema = "kind string, child_distinct long, parent_distinct long, orphans long, containment double, cardinality string, parent string"
    if not pairs:
        return child.sparkSession.createDataFrame([], schema)
    wanted = F.create_map(*[x for kind in dict.fromkeys(k for k, _ in pairs) for x in (F.lit(kind), F.array(*[F.lit(p.name) for k, p in pairs if k == kind]))])
    ids = child.select(F.col(kind_col).cast("string").alias("kind"), F.col(f"`{id_col}`").cast(NATIVE.get(of, "string")).alias("value")).where("kind is not null and value is not null").distinct()
    rows = ids.select("kind", "value", F.explode(F.try_element_at(wanted, F.col("kind"))).alias("parent")).withColumns({"c": F.lit(1), "p": F.lit(0)})
    for p in {p.name: p for _, p in pairs}.values():
        kinds = F.explode(F.array(*[F.lit(k) for k, q in pairs if q.name == p.name])).alias("kind")
        rows = rows.unionByName(p.values().distinct().select(kinds, "value", F.lit(p.name).alias("parent"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    merged = rows.groupBy("kind", "parent", "value").agg(F.max("c").alias("c"), F.max("p").alias("p"))
    return _judged(merged.groupBy("kind", "parent").agg(*_split(merged)), threshold).select(*[x.split()[0] for x in schema.split(", ")])


def json_side(name: str, table: DataFrame, column: str, path: str) -> Side:
    """The values at a path of a JSON text column, as text; a text that isn't JSON has none."""
    return Side(name, table.select(F.get_json_object(F.col(f"`{column}`"), path).alias("leaf")), "leaf")


def as_text(side: Side) -> Side:
    """The same column compared as text."""
    return Side(side.name, side.table.select(F.col(f"`{side.column}`").cast("string").alias("leaf")), "leaf")


def json_leaves(table: DataFrame, column: str) -> DataFrame:
    """path, kind (``int``, ``uuid``, ``string``, ``none``), n: the scalar leaves of a JSON text column; array elements share a path with [*].

    Leaves of arrays of arrays are followed as long as new levels come. Texts that aren't JSON
    have no leaves.
    """
    level = table.select(F.expr(f"try_parse_json(`{column}`)").alias("v"), F.lit("$").alias("path")).where("v is not null")
    leaves = None
    while True:
        level = staged(level.withColumn("kind", F.schema_of_variant("v")), "json-level")
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        here = level.where(~nested).select("path", "kind", F.expr("try_variant_get(v, '$', 'string')").alias("text"))
        leaves = here if leaves is None else leaves.unionByName(here)
        deeper = level.where(nested)
        if not deeper.limit(1).count():
            break
        entries = table.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e")
        step = F.when(F.col("e.key").isNull(), F.concat("path", F.lit("[*]"))).otherwise(F.concat("path", F.lit("."), F.col("e.key")))
        level = deeper.lateralJoin(entries).select(F.col("e.value").alias("v"), step.alias("path"))
    uuid = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    plain = ~F.col("kind").isin("BOOLEAN", "VOID") & ~F.col("kind").startswith("DECIMAL") & ~F.col("kind").isin("DOUBLE", "FLOAT")
    kinds = F.when(~plain, "none").when((F.col("kind") == "BIGINT") | F.col("text").rlike("^[0-9]+$"), "int").when(F.col("text").rlike(uuid), "uuid").otherwise("string")
    return leaves.select("path", kinds.alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n"))
