"""Saved games: the variables that a chain of differences adds up to.

A moment's variables are a tree; merging the next one into it replaces, at each path, a list or a plain value by whatever comes, and a
tree by a list or plain value, but joins trees. So the last value at a path isn't enough: a value at a path drops all that was
below it, and anything below a path drops a value at it. Every moment is opened into leaves, each node is told when it was
last touched as a value and as a tree, and a leaf stays if nothing later touched its own path and no later value stands on the way to it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tree_leaves(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """keys, path (array of names), value (JSON; `{}` for an empty tree) of each leaf of a JSON object; lists are leaves. Any depth; what isn't an object gives nothing."""
    part = rows.select(*keys, F.col(tree).cast("string").alias("tree__"))
    schema = T.StructType([*part.schema.fields[:-1], *T._parse_datatype_string("path array<string>, value string").fields])

    def leaves(text: str | None) -> Iterator[tuple[list[str], str]]:
        try:
            node = json.loads(text) if text else None
        except (ValueError, RecursionError):
            node = None
        left = [([], node)] if isinstance(node, dict) else []
        while left:
            path, node = left.pop()
            if isinstance(node, dict) and node:
                left += [([*path, k], v) for k, v in reversed(node.items())]
            elif path:
                yield path, json.dumps(node, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *leaf) for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()) for leaf in leaves(t)]
            if found:
                at, paths, values = zip(*found)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[:-1]), pa.array(paths, pa.list_(pa.string())), pa.array(values, pa.string())], names=schema.names)

    return part.mapInArrow(run, schema)


def folded(moments: DataFrame, key: str, order: str, tree: str) -> DataFrame:
    """key, path, value: what the trees of each key, merged in order, come to, as leaves."""
    k, t = F.col("k__"), F.col("t__")
    leaves = tree_leaves(moments.select(F.col(key).alias("k__"), F.col(order).alias("t__"), F.col(tree).alias("tree")), ["k__", "t__"], "tree")
    empty = F.col("value") == "{}"
    # A leaf touches its own node as a value (an empty tree: as a tree) and all nodes above it as trees.
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    above = F.when(F.size("path") > 1, above).otherwise(F.array().cast("array<array<string>>"))
    own = leaves.select(k, t, F.col("path").alias("node"), (~empty).alias("plain"), F.col("value"))
    touched = own.unionByName(leaves.select(k, t, F.explode(above).alias("node"), F.lit(False).alias("plain"), F.lit(None).cast("string").alias("value")))
    nodes = touched.groupBy("k__", "node").agg(
        F.max("t__").alias("last"),
        F.max(F.when(F.col("plain"), F.col("t__"))).alias("last_plain"),
        F.max_by("value", F.when(F.col("plain"), F.col("t__"))).alias("value"),
        F.bool_or(F.col("value").isNull()).alias("held"),
    )
    # A node's own last touch says what it is; the values on the way to it say whether it is still there.
    plain = F.col("last_plain").isNotNull() & (F.col("last_plain") == F.col("last"))
    is_leaf = nodes.select("k__", "node", "last", "last_plain", plain.alias("plain"), "value", "held")
    way = F.transform(F.sequence(F.lit(1), F.size("node") - 1), lambda n: F.slice("node", F.lit(1), n))
    asked = is_leaf.where(F.size("node") > 1).select("k__", "node", F.explode(way).alias("up"))
    values = nodes.where("last_plain IS NOT NULL").select(F.col("k__").alias("k2"), F.col("node").alias("up2"), F.col("last_plain").alias("cut"))
    cuts = asked.join(values, (F.col("k__") == F.col("k2")) & (F.col("up") == F.col("up2"))).groupBy("k__", "node").agg(F.max("cut").alias("cut"))
    alive = is_leaf.join(cuts, ["k__", "node"], "left").where(F.col("cut").isNull() | (F.col("cut") < F.col("last")))
    shown = alive.where("plain").select("k__", "node", "value")
    # Trees without anything in them.
    bare = alive.where("NOT plain").select("k__", "node")
    full = alive.where(F.size("node") > 1).select("k__", F.slice("node", F.lit(1), F.size("node") - 1).alias("node")).distinct()
    hollow = bare.join(full, ["k__", "node"], "left_anti").withColumn("value", F.lit("{}"))
    return shown.unionByName(hollow).select(F.col("k__").alias(key), F.col("node").alias("path"), "value")


def save_variables(saves: DataFrame, key: str = "save", data: str = "data") -> DataFrame:
    """key, path, value: the variables of saved games (JSON with state: index, and history or delta: moments with variables).

    Of differences the first `index` moments are merged (index from 1, kept within their number); of a history the moment at index counts, or the last one
    if there is none. Keys are unique. A save without moments gives nothing.
    """
    kind = "state struct<index: long, history: array<struct<variables: variant>>, delta: array<struct<variables: variant>>>"
    s = saves.select(F.col(key).alias("key"), F.from_json(data, kind)["state"].alias("s"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    s = s.select("key", some("s.delta").alias("fold"), F.when(some("s.history"), F.col("s.history")).otherwise(F.col("s.delta")).alias("m"), F.col("s.index").alias("i"))
    s = s.where(some("m")).withColumn("n", F.size("m")).withColumn("i", F.coalesce("i", "n"))
    upto = F.greatest(F.lit(1), F.least("i", "n"))
    shown = F.when(F.col("i").between(1, F.col("n")), F.col("i")).otherwise(F.col("n"))
    rows = s.select("key", "fold", upto.alias("upto"), shown.alias("shown"), F.posexplode("m").alias("at", "moment"))
    rows = rows.where(F.when(F.col("fold"), F.col("at") < F.col("upto")).otherwise(F.col("at") == F.col("shown") - 1))
    out = folded(rows.select("key", "at", F.to_json("moment.variables").alias("tree")), "key", "at", "tree")
    return out.withColumnRenamed("key", key)
