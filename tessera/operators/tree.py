"""Layer trees as adjacency lists (id, parent, ordinal, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.staging import Staging


def with_ancestry(nodes: DataFrame) -> DataFrame:
    """(id, above) for each node and each of its ancestors and itself, by doubling: a round for each power of two of the depth.

    A cycle raises ValueError.
    """
    staging = Staging(nodes.sparkSession, "tree")
    hop = staging.keep(nodes.where("parent is not null").select("id", F.col("parent").alias("up")), "hop-0")
    seen = staging.keep(nodes.select("id", F.col("id").alias("above")), "seen-0")
    k = 0
    while hop.limit(1).count():
        if k > 40:
            raise ValueError("the tree has a cycle")
        k += 1
        more = seen.join(hop, seen["above"] == hop["id"]).select(seen["id"], F.col("up").alias("above"))
        seen = staging.keep(seen.union(more).distinct(), f"seen-{k}")
        nxt = hop.select(F.col("id").alias("_i"), F.col("up").alias("_u"))
        hop = staging.keep(hop.join(nxt, F.col("up") == F.col("_i")).select("id", F.col("_u").alias("up")), f"hop-{k}")
    return seen


def effective_visibility(nodes: DataFrame) -> DataFrame:
    """(id, visible): whether a node and all its ancestors are shown."""
    above = with_ancestry(nodes)
    shown = nodes.select(F.col("id").alias("above"), "show")
    return above.join(shown, "above").groupBy("id").agg(F.min("show").alias("visible"))


def renumber(nodes: DataFrame) -> DataFrame:
    """Ordinals 0, 1, ... among siblings, in their present order (ties: id)."""
    w = Window.partitionBy("parent").orderBy("ordinal", "id")
    return nodes.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def subtree(nodes: DataFrame, root: int) -> DataFrame:
    """The nodes at and below ``root``."""
    return nodes.join(with_ancestry(nodes).where(F.col("above") == root).select("id"), "id", "left_semi")


def remove(nodes: DataFrame, root: int) -> DataFrame:
    """The tree without ``root`` and what is below it, siblings renumbered."""
    return renumber(nodes.join(subtree(nodes, root).select("id"), "id", "left_anti"))


def move(nodes: DataFrame, node: int, parent: int, index: int) -> DataFrame:
    """``node`` as child number ``index`` of ``parent``; a move below itself raises ValueError."""
    if subtree(nodes, node).where(F.col("id") == parent).limit(1).count():
        raise ValueError("a node cannot be moved below itself")
    rest = renumber(nodes.where(F.col("id") != node))
    at = F.when((F.col("parent") == parent) & (F.col("ordinal") >= index), F.col("ordinal") + 1).otherwise(F.col("ordinal"))
    moved = nodes.where(F.col("id") == node).withColumns({"parent": F.lit(parent).cast("long"), "ordinal": F.lit(index).cast("long")})
    return renumber(rest.withColumn("ordinal", at).unionByName(moved))


def clone(nodes: DataFrame, root: int, first_id: int) -> DataFrame:
    """A deep copy of a subtree under the same parent, its ids from ``first_id`` on in the order of the old ones.

    Subtrees are what a user copies at once; their ids are numbered in one window.
    """
    part = subtree(nodes, root)
    ids = part.select("id", (F.row_number().over(Window.orderBy("id")) - 1 + first_id).cast("long").alias("new"))
    up = ids.select(F.col("id").alias("parent"), F.col("new").alias("new_parent"))
    made = part.join(ids, "id").join(up, "parent", "left")
    made = made.withColumn("parent", F.coalesce("new_parent", "parent")).withColumn("id", F.col("new")).drop("new", "new_parent")
    return nodes.unionByName(made.select(*nodes.columns))


def paste(nodes: DataFrame, root: int, parent: int, first_id: int, suffix: str = " copy") -> DataFrame:
    """A deep copy of a subtree as the last child of ``parent``, its ids from ``first_id`` on, ``suffix`` added to the name of its root.

    A copy into the subtree itself is allowed: it holds what was there before.
    """
    made = clone(nodes, root, first_id).join(nodes.select("id"), "id", "left_anti")
    # The copy of the root is the one whose parent is no copy.
    top = ~F.coalesce(F.col("parent") >= first_id, F.lit(False))
    last = nodes.where(F.col("parent") == parent).agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    placed = made.withColumns({"name": F.when(top, F.concat("name", F.lit(suffix))).otherwise(F.col("name")), "ordinal": F.when(top, F.lit(last)).otherwise(F.col("ordinal")), "parent": F.when(top, F.lit(parent)).otherwise(F.col("parent"))})
    return nodes.unionByName(placed.select(*[F.col(c).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]))


def shift(nodes: DataFrame, node: int, by: int) -> DataFrame:
    """``node`` moved ``by`` places down among its siblings, or up if negative, to the first or last place at most; a root raises ValueError."""
    at = renumber(nodes).where(F.col("id") == node).first()
    if at is None or at["parent"] is None:
        raise ValueError("no node with siblings of this number")
    return move(nodes, node, at["parent"], max(0, at["ordinal"] + by))


def next_name(nodes: DataFrame, base: str, kind: str) -> str:
    """``base`` with the smallest number from 1 on that no node of the type ``kind`` has in its name."""
    number = F.expr(f"try_cast(substring(name, {len(base) + 1}) AS bigint)")
    used = nodes.where((F.col("type") == kind) & F.col("name").startswith(base)).select(number.alias("n"), "name").where((F.col("n") > 0) & (F.col("name") == F.concat(F.lit(base), F.col("n").cast("string")))).select("n").distinct()
    free = used.select((F.col("n") + 1).alias("n")).union(nodes.sparkSession.range(1, 2).toDF("n")).join(used, "n", "left_anti")
    return f"{base}{free.agg(F.min('n')).first()[0]}"


def cleared(nodes: DataFrame, primitives: DataFrame, root: int, layer_col: str = "layer") -> DataFrame:
    """``primitives`` without those of the layers at and below ``root``; those of other layers, or of none, stay."""
    return primitives.join(subtree(nodes, root).select(F.col("id").alias("_gone")), F.col(layer_col) == F.col("_gone"), "left_anti")


def scene_rows(df: DataFrame, json_col: str) -> DataFrame:
    """Nodes (id, parent, ordinal, name, type, show) of scene documents of any depth; unknown types are kept.

    One round for each level, until none has children; a null document gives no rows.
    """
    staging = Staging(df.sparkSession, "scene")
    kind = "struct<id:bigint,name:string,type:string,show:boolean,children:array<string>>"
    rows = df.select(F.posexplode(F.from_json(F.col(json_col), "array<string>")).alias("ordinal", "n")).select(F.lit(None).cast("bigint").alias("parent"), "n", F.col("ordinal").cast("long").alias("ordinal"))
    out, level = None, 0
    while True:
        parsed = staging.keep(rows.select("parent", "ordinal", F.from_json("n", kind).alias("s")), f"level{level}")
        here = parsed.select("s.id", "parent", "ordinal", "s.name", "s.type", "s.show")
        out = here if out is None else out.unionByName(here)
        if not parsed.where("size(s.children) > 0").limit(1).count():
            return out
        rows = parsed.select(F.col("s.id").alias("parent"), F.posexplode("s.children").alias("ordinal", "n")).select("parent", "n", F.col("ordinal").cast("long").alias("ordinal"))
        level += 1


def scene_json(nodes: DataFrame) -> DataFrame:
    """One scene document (an array of root nodes) by folding children into parents, deepest level first.

    A document is one value; so its text bounds what a scene may hold.
    """
    up = with_ancestry(nodes).groupBy("id").agg((F.count("*") - 1).alias("depth"))
    rows = nodes.join(up, "id").withColumn("children", F.array().cast("array<string>"))
    own = F.to_json(F.struct("id", "name", "type", "show"))
    as_json = F.concat(F.regexp_replace(own, "[}]$", ""), F.lit(',"children":['), F.array_join("children", ","), F.lit("]}"))
    rows = Staging(nodes.sparkSession, "scene").keep(rows, "rows")
    for d in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        below = rows.where(F.col("depth") == d).groupBy(F.col("parent").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", as_json.alias("j")))), lambda x: x["j"]).alias("_kids"))
        rows = rows.where(F.col("depth") < d).join(below, F.col("id") == F.col("_p"), "left").withColumn("children", F.coalesce("_kids", "children")).drop("_p", "_kids")
    return rows.groupBy().agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", as_json.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("scene"))
