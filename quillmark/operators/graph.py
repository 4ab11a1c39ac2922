"""Graph table functions over a table of edges.

Edges have edge_id, source_type, source_id, target_type, target_id, edge_type and
weight (1 where missing; negative or non-finite weights are errors).  Paths are
grown by joining a settled frontier with the edges, for one start or many at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.shared import settle

OUTPUT = ["depth", "path_rank", "cost", "node_type", "node_id", "edge_id", "edge_type", "source_type", "source_id", "target_type", "target_id", "path_nodes", "path_edges"]


def _output() -> list[Column]:
    """The output columns, with paths as JSON."""
    return [F.to_json(c).alias(c) if c.startswith("path_") and c != "path_rank" else F.col(c) for c in OUTPUT]


def adjacency(edges: DataFrame, direction: str = "out", edge_types: str = "*") -> DataFrame:
    """Edges with from_* and to_* ends for a direction: out, in or both; types are a comma list or *."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    bad = (weight < 0) | F.isnan(weight) | (weight == float("inf"))
    e = edges.withColumn("weight", F.when(bad, F.raise_error(F.lit("edge weights are finite and not negative")).cast("double")).otherwise(weight))
    types = [t.strip().lower() for t in edge_types.split(",")]
    if not edge_types.strip():
        raise ValueError("edge types are blank")
    if "*" not in types:
        e = e.filter(F.lower("edge_type").isin(*types))
    ends = lambda a, b: e.select("*", *(F.col(f"{x}_{k}").alias(f"{n}_{k}") for x, n in ((a, "from"), (b, "to")) for k in ("type", "id")))
    out, back = ends("source", "target"), ends("target", "source")
    if direction in ("out", "outgoing"):
        return out
    if direction in ("in", "incoming"):
        return back
    if direction != "both":
        raise ValueError(f"unknown direction {direction}")
    return out.union(back).dropDuplicates(["edge_id", "from_type", "from_id", "to_type", "to_id"])


def _edge_order() -> list[Column]:
    return [F.col(c) for c in ("weight", "edge_id", "to_type", "to_id")]


def neighbors(edges: DataFrame, node_type: str, node_id: str, direction: str = "out", edge_types: str = "*", limit: int = 100) -> DataFrame:
    """The edges of a node by weight and id."""
    e = adjacency(edges, direction, edge_types).filter((F.col("from_type") == node_type) & (F.col("from_id") == node_id))
    e = e.orderBy(*_edge_order()).limit(limit)
    rank = F.row_number().over(Window.orderBy(*_edge_order())).cast("long")
    node = lambda t, i: F.struct(F.col(i).alias("node_id"), F.col(t).alias("node_type"))
    return e.select(F.lit(1).cast("long").alias("depth"), rank.alias("path_rank"), F.col("weight").alias("cost"), F.col("to_type").alias("node_type"), F.col("to_id").alias("node_id"), "edge_id", "edge_type", "source_type", "source_id", "target_type", "target_id", F.to_json(F.array(node("from_type", "from_id"), node("to_type", "to_id"))).alias("path_nodes"), F.to_json(F.array(F.col("edge_id").cast("string"))).alias("path_edges"))


def _start(edges: DataFrame, starts: DataFrame) -> DataFrame:
    node = F.struct("node_id", "node_type")
    return starts.select("start", "node_type", "node_id", F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("cost"), F.array(node).alias("path_nodes"), F.array().cast("array<string>").alias("path_edges"), F.array().cast("array<struct<w:double,e:string,t:string,i:string>>").alias("steps"))


def _grow(frontier: DataFrame, adjacent: DataFrame, simple: bool = True) -> DataFrame:
    """Each path of the frontier with each edge of its end that leads to a new node."""
    f = frontier.select("start", "node_type", "node_id", "depth", F.col("cost").alias("cost0"), F.col("path_nodes").alias("nodes0"), F.col("path_edges").alias("edges0"), F.col("steps").alias("steps0"))
    on = (F.col("node_type") == F.col("from_type")) & (F.col("node_id") == F.col("from_id"))
    nxt = F.struct(F.col("to_id").alias("node_id"), F.col("to_type").alias("node_type"))
    grown = f.join(adjacent, on)
    if simple:
        grown = grown.filter(~F.array_contains("nodes0", nxt))
    step = F.struct(F.col("weight").alias("w"), F.col("edge_id").cast("string").alias("e"), F.col("to_type").alias("t"), F.col("to_id").alias("i"))
    return grown.select("start", F.col("to_type").alias("node_type"), F.col("to_id").alias("node_id"), (F.col("depth") + 1).alias("depth"), (F.col("cost0") + F.col("weight")).alias("cost"), F.concat("nodes0", F.array(nxt)).alias("path_nodes"), F.concat("edges0", F.array(F.col("edge_id").cast("string"))).alias("path_edges"), F.concat("steps0", F.array(step)).alias("steps"), "edge_id", "edge_type", "source_type", "source_id", "target_type", "target_id")


def expand_all(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "out", edge_types: str = "*", max_results: int = 1000) -> DataFrame:
    """Breadth-first simple paths from each start (start, node_type, node_id), at most ``max_results`` each.

    The order is that of a queue: by depth, then by the weights and ids of the steps.
    """
    adjacent = settle(adjacency(edges, direction, edge_types))
    frontier = _start(edges, starts)
    order = [F.col("depth"), F.col("steps")]
    found = None
    for _ in range(max_depth):
        frontier = _grow(frontier, adjacent)
        if found is not None:  # a start that has its results already grows no further
            full = found.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max_results).select(F.col("start").alias("s"))
            frontier = frontier.join(full, F.col("start") == F.col("s"), "left_anti")
        frontier = settle(frontier.withColumn("__n", F.row_number().over(Window.partitionBy("start").orderBy(*order))).filter(F.col("__n") <= max_results).drop("__n"))
        if not frontier.take(1):
            break
        found = frontier if found is None else found.union(frontier)
    if found is None:
        found = _grow(frontier, adjacent).limit(0) if max_depth == 0 else frontier
    rank = F.row_number().over(Window.partitionBy("start").orderBy(*order)).cast("long")
    return found.withColumn("path_rank", rank).filter(F.col("path_rank") <= max_results).select("start", *_output())


def expand(edges: DataFrame, node_type: str, node_id: str, max_depth: int, direction: str = "out", edge_types: str = "*", max_results: int = 1000) -> DataFrame:
    """``expand_all`` from one node."""
    start = edges.sparkSession.createDataFrame([("", node_type, node_id)], "start string, node_type string, node_id string")
    return expand_all(edges, start, max_depth, direction, edge_types, max_results).drop("start")


def shortest_path(edges: DataFrame, source_type: str, source_id: str, target_type: str, target_id: str, max_depth: int, direction: str = "out", edge_types: str = "*", max_paths: int = 1) -> DataFrame:
    """The ``max_paths`` cheapest paths within ``max_depth`` steps; ties go to fewer steps, then to smaller edges.

    Label setting by rounds: a round keeps the best ``max_paths`` paths to each (node,
    depth), and paths dearer than so many that already reached the target are dropped.
    """
    spark = edges.sparkSession
    adjacent = settle(adjacency(edges, direction, edge_types))
    frontier = _start(edges, spark.createDataFrame([("", source_type, source_id)], "start string, node_type string, node_id string"))
    target = (F.col("node_type") == target_type) & (F.col("node_id") == target_id)
    reached, best = None, None
    for _ in range(max_depth):
        grown = _grow(frontier, adjacent)
        if best is not None:
            grown = grown.filter(F.col("cost") <= best)
        w = Window.partitionBy("node_type", "node_id").orderBy("cost", "steps")
        grown = settle(grown.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_paths).drop("__n"))
        if not grown.take(1):
            break
        hit = grown.filter(target)
        reached = hit if reached is None else reached.union(hit)
        costs = [r["cost"] for r in reached.select("cost").orderBy("cost").limit(max_paths).collect()]
        best = costs[-1] if len(costs) == max_paths else None
        frontier = grown.filter(~target)
    if reached is None:
        reached = _grow(frontier, adjacent).limit(0)
    order = ["cost", "depth", "steps"]
    top = reached.orderBy(*order).limit(max_paths)
    return top.withColumn("path_rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select(*_output())
