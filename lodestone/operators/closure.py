"""Trees as closure tables: one row (ancestor_id, descendant_id, depth) per pair, depth 0 being the node itself."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.sources.sinks import folder, shared
from lodestone.views import edges, table, view


def build_closure(tree: DataFrame, path: str | None = None) -> DataFrame:
    """The closure of edges (id, parent_id), stored in the shared folder, of a tree of any depth.

    Distances double: the rows of at least 2**k steps and less than twice that are the pairs just 2**k apart, met with all
    rows below that. Each row is made once, and a tree of depth d takes log d rounds, each of them written. A node that is its own
    ancestor is an error.
    """
    spark, path = tree.sparkSession, path or folder(tree.sparkSession, "closure")
    parts, apart = [], []

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(at := f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(at)

    parts.append(put(tree.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("depth")), "rows-0"))
    apart.append(put(tree.where("parent_id IS NOT NULL").select(F.col("id").alias("low"), F.col("parent_id").alias("high")), "apart-0"))
    while not apart[-1].isEmpty():
        step = 2 ** (len(apart) - 1)
        lower = parts[0]
        for rows in parts[1:]:
            lower = lower.union(rows)
        above = apart[-1].join(lower, F.col("high") == F.col("descendant_id")).select("ancestor_id", F.col("low").alias("descendant_id"), (F.col("depth") + step).alias("depth"))
        parts.append(put(above, f"rows-{step}"))
        if not parts[-1].where("ancestor_id = descendant_id").isEmpty():
            raise ValueError("the tree has a cycle")
        once = apart[-1].alias("x").join(apart[-1].alias("y"), F.col("x.high") == F.col("y.low")).select("x.low", "y.high")
        apart.append(put(once, f"apart-{2 * step}"))
    out = parts[0]
    for rows in parts[1:]:
        out = out.union(rows)
    return out


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the stored tree."""
    return stored_closure(edges(spark, sf_dir))


def stored_closure(tree: DataFrame) -> DataFrame:
    """The closure of a tree (id, parent_id), built once and then read for as long as the tree's rows stay the same.

    It lies in the shared folder under a digest of the rows, one number that each call sums up anew; a row with its
    place is written when all parts are there.
    """
    spark = tree.sparkSession
    n, digest = tree.agg(F.count("*"), F.sum(F.xxhash64("id", "parent_id").cast("decimal(38,0)"))).first()
    path = f"{shared(spark)}/lodestone/closure-of-{n}-{digest}"
    try:
        at = spark.read.schema("at string").parquet(f"{path}/built").agg(F.max("at")).first()[0]
    except AnalysisException:  # nothing there yet
        at = None
    if at is None:
        build_closure(tree, at := f"{path}/{uuid.uuid4().hex}")
        spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("append").parquet(f"{path}/built")
    return spark.read.schema("ancestor_id long, descendant_id long, depth int").parquet(f"{at}/rows-*")


def move(rows: DataFrame, node: int, parent: int) -> DataFrame:
    """The closure after node's subtree went under parent."""
    below = rows.where(F.col("ancestor_id") == node).select(F.col("descendant_id").alias("d"), F.col("depth").alias("dd"))
    inside = below.select(F.col("d").alias("descendant_id"))
    outside = rows.join(inside, "descendant_id", "left_semi").join(inside.withColumnRenamed("descendant_id", "ancestor_id"), "ancestor_id", "left_anti")
    kept = rows.join(outside, ["ancestor_id", "descendant_id", "depth"], "left_anti")
    above = rows.where(F.col("descendant_id") == parent).select(F.col("ancestor_id").alias("a"), F.col("depth").alias("ad"))
    # every ancestor of the new parent, as many as the tree is deep, with every node of the subtree: as many rows as the closure gains
    fresh = below.withColumn("k", F.lit(1)).join(F.broadcast(above.withColumn("k", F.lit(1))), "k").select(F.col("a").alias("ancestor_id"), F.col("d").alias("descendant_id"), (F.col("ad") + F.col("dd") + 1).alias("depth"))
    return kept.select("ancestor_id", "descendant_id", "depth").union(fresh)


@query("SELECT ancestor_id, descendant_id, depth FROM closure")
def closure_insert(spark, sf):
    return closure(spark, sf)


@query("SELECT c.descendant_id, c.depth, n.name FROM closure c JOIN (SELECT 100 + id AS id, name FROM categories WHERE deleted_at IS NULL) n ON n.id = c.descendant_id WHERE c.ancestor_id = 2")
def descendants(spark, sf):
    names = view(spark, sf, "categories").where("deleted_at IS NULL").select((F.col("id") + 100).alias("descendant_id"), "name")
    return closure(spark, sf).where("ancestor_id = 2").join(names, "descendant_id").select("descendant_id", "depth", "name")


@query("SELECT ancestor_id, depth FROM closure WHERE descendant_id = 1007")
def ancestors(spark, sf):
    return closure(spark, sf).where("descendant_id = 1007").select("ancestor_id", "depth")


@query("SELECT a.ancestor_id, d.descendant_id, a.depth + d.depth + 1 AS depth FROM closure a, closure d WHERE a.descendant_id = 3 AND d.ancestor_id = 105")
def closure_move_cross(spark, sf):
    c = closure(spark, sf)
    above = c.where("descendant_id = 3").select("ancestor_id", F.col("depth").alias("x"), F.lit(1).alias("k"))
    below = c.where("ancestor_id = 105").select("descendant_id", F.col("depth").alias("y"), F.lit(1).alias("k"))
    return below.join(F.broadcast(above), "k").select("ancestor_id", "descendant_id", (F.col("x") + F.col("y") + 1).alias("depth"))


@query(""", sub AS (SELECT descendant_id FROM closure WHERE ancestor_id = 105)
SELECT ancestor_id, descendant_id, depth FROM closure WHERE NOT (descendant_id IN (FROM sub) AND ancestor_id NOT IN (FROM sub))
UNION ALL SELECT a.ancestor_id, d.descendant_id, a.depth + d.depth + 1 FROM closure a, closure d WHERE a.descendant_id = 3 AND d.ancestor_id = 105""")
def closure_move(spark, sf):
    return move(closure(spark, sf), 105, 3)


@query("SELECT ancestor_id, descendant_id, depth FROM closure WHERE NOT (ancestor_id IN (SELECT descendant_id FROM closure WHERE ancestor_id = 2) OR descendant_id IN (SELECT descendant_id FROM closure WHERE ancestor_id = 2))")
def cascade_delete(spark, sf):
    """Closure rows left after a folder went with its subtree."""
    c = closure(spark, sf)
    gone = c.where("ancestor_id = 2").select(F.col("descendant_id").alias("g"))
    return c.join(gone, c["ancestor_id"] == gone["g"], "left_anti").join(gone, c["descendant_id"] == gone["g"], "left_anti")


@query("SELECT ancestor_id, descendant_id, depth FROM closure WHERE NOT (ancestor_id IN (101, 102) OR descendant_id IN (101, 102))")
def subtree_remove(spark, sf):
    return closure(spark, sf).where("NOT (ancestor_id IN (101, 102) OR descendant_id IN (101, 102))")


@query("SELECT count(*) > 0 AS is_ancestor FROM closure WHERE ancestor_id = 2 AND descendant_id = 108")
def is_ancestor(spark, sf):
    return closure(spark, sf).where("ancestor_id = 2 AND descendant_id = 108").agg((F.count("*") > 0).alias("is_ancestor"))


@query("SELECT e.id, (e.id = 105 OR c.ancestor_id IS NOT NULL) AS rejected FROM edges e LEFT JOIN closure c ON c.ancestor_id = 105 AND c.descendant_id = e.id")
def cycle_guard(spark, sf):
    """Whether node 105 may go under each folder: not under itself or its own subtree."""
    sub = closure(spark, sf).where("ancestor_id = 105").select(F.col("descendant_id").alias("id"), F.lit(True).alias("inside"))
    return edges(spark, sf).join(sub, "id", "left").select("id", (F.col("inside").isNotNull() | (F.col("id") == 105)).alias("rejected"))


@query("SELECT descendant_id AS id, max(CASE WHEN depth = 1 THEN ancestor_id END) AS parent_id, max(depth) AS depth FROM closure GROUP BY 1")
def category_placement(spark, sf):
    return closure(spark, sf).groupBy(F.col("descendant_id").alias("id")).agg(F.max(F.when(F.col("depth") == 1, F.col("ancestor_id"))).alias("parent_id"), F.max("depth").alias("depth"))


@query(", own AS (SELECT 1000 + o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT c.ancestor_id AS id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM closure c LEFT JOIN own ON own.id = c.descendant_id GROUP BY 1")
def folder_counts(spark, sf):
    own = table(spark, sf, "orders").groupBy((F.col("o_custkey") + 1000).alias("descendant_id")).agg(F.count("*").alias("n"))
    return closure(spark, sf).join(own, "descendant_id", "left").groupBy(F.col("ancestor_id").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


#: First words of folders' names, with letters that only Vietnamese order puts right: fixed values.
FOLDERS = ("Ăn", "ân", "an", "Đá", "da", "Ơn", "ốc", "Ếch", "em", "Zalo")
INDENT = "\u00a0\u00a0\u00a0"


def listed_tree(nodes: DataFrame, locale: str = "vi") -> DataFrame:
    """id, parent_id, level, place among its siblings and indented label of folders (id, parent_id, name), siblings in a language's order.

    A folder whose parent is not there becomes a root; a cycle is an error. Sorting by the places on the way from the root
    gives the list (column path).
    """
    there = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    visible = nodes.join(there, "parent_id", "left").select("id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id"), "name")
    siblings = Window.partitionBy("parent_id").orderBy(F.collate("name", locale), "id")
    placed = visible.withColumn("place", F.row_number().over(siblings))
    above = stored_closure(visible.select("id", "parent_id")).join(placed.select(F.col("id").alias("ancestor_id"), "place"), "ancestor_id")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), F.format_string("%09d", "place").alias("at"))))
    paths = above.groupBy(F.col("descendant_id").alias("id")).agg(F.array_join(F.transform(steps, lambda x: x["at"]), "/").alias("path"), F.max("depth").alias("level"))
    return placed.join(paths, "id").select("id", "parent_id", "level", "place", F.concat(F.repeat(F.lit(INDENT), F.col("level")), "name").alias("label"), "path")


_FOLDER = "CASE id % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(FOLDERS)) + " END"


@query(f""", n AS (SELECT id, parent_id, concat({_FOLDER}, ' ', id % 97) AS name FROM edges WHERE id NOT IN (SELECT 100 + id FROM categories WHERE deleted_at IS NOT NULL)),
v AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM n) THEN parent_id END AS parent_id, name FROM n), w AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY name COLLATE vi, id) AS place FROM v),
p AS (SELECT *, 0 AS level, printf('%09d', place) AS path FROM w WHERE parent_id IS NULL UNION ALL SELECT w.*, level + 1, p.path || '/' || printf('%09d', w.place) FROM w JOIN p ON w.parent_id = p.id)
SELECT id, parent_id, level, place, repeat(chr(160), 3 * level) || name AS label, path FROM p""")
def folder_tree(spark, sf):
    """The folder tree as an indented list in Vietnamese order; folders of deleted ones are roots."""
    dead = view(spark, sf, "categories").where("deleted_at IS NOT NULL").select((F.col("id") + 100).alias("id"))
    nodes = edges(spark, sf).join(dead, "id", "left_anti").selectExpr("id", "parent_id", f"concat({_FOLDER}, ' ', id % 97) AS name")
    return listed_tree(nodes)


@query(", dead AS (SELECT 100 + id AS id FROM categories WHERE deleted_at IS NOT NULL) SELECT ancestor_id, descendant_id, depth FROM closure WHERE ancestor_id IN (FROM dead) OR descendant_id IN (FROM dead)")
def orphan_closure(spark, sf):
    c = closure(spark, sf)
    dead = view(spark, sf, "categories").where("deleted_at IS NOT NULL").select((F.col("id") + 100).alias("g"))
    left = c.join(dead, c["ancestor_id"] == dead["g"], "left_semi")
    return left.union(c.join(dead, c["descendant_id"] == dead["g"], "left_semi")).distinct()


@query("SELECT e.id FROM edges e LEFT JOIN closure c ON c.ancestor_id = e.id AND c.descendant_id = e.id AND c.depth = 0 AND e.id % 6 <> 0 WHERE c.depth IS NULL")
def missing_self_rows(spark, sf):
    """Nodes without a self row, after those of every sixth node are taken out."""
    rows = closure(spark, sf).where("depth = 0 AND ancestor_id % 6 <> 0").select(F.col("ancestor_id").alias("id"))
    return edges(spark, sf).select("id").join(rows, "id", "left_anti")


@query("SELECT ancestor_id, descendant_id, depth FROM closure WHERE ancestor_id = descendant_id AND depth > 0")
def cycle_indicators(spark, sf):
    return closure(spark, sf).where("ancestor_id = descendant_id AND depth > 0")


@query(", mine AS (SELECT 100 + id AS id FROM categories WHERE user_id = 2) SELECT DISTINCT ancestor_id, descendant_id, depth FROM closure WHERE ancestor_id IN (FROM mine) OR descendant_id IN (FROM mine)")
def closure_by_owner(spark, sf):
    c, mine = closure(spark, sf), view(spark, sf, "categories").where("user_id = 2").select((F.col("id") + 100).alias("g"))
    return c.join(mine, c["ancestor_id"] == mine["g"], "left_semi").union(c.join(mine, c["descendant_id"] == mine["g"], "left_semi")).distinct()
