"""Path patterns as data, compiled to joins.

A pattern is a list of steps from a frontier of vertices.  A path is an array of elements
(vertex, edge, vertex, ...); ``cur`` is the id it stands on.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.sources.tpch_graph import Graph


@dataclass(frozen=True)
class Expand:
    """Follow edges of ``types``; ``reverse`` goes from target to source.

    ``optional`` keeps a path that no edge continues, standing where it was.  ``contains``
    asks the next vertex's label to contain a keyword.  ``then`` is a nested optional step: only
    paths that this step has continued take it.  ``limit`` is not a step of its own: paths are
    bags.
    """

    types: tuple[str, ...]
    reverse: bool = False
    optional: bool = False
    contains: str | None = None
    then: Expand | None = None


@dataclass(frozen=True)
class Union:
    """All paths of several patterns from the same frontier."""

    branches: tuple[tuple, ...] = field(default_factory=tuple)


#: Shares into which paths at a hub are dealt.
HUB_SHARES = 16


def reachable(graph: Graph, step: Expand) -> set[str] | None:
    """The vertex types that a step leads to, or None where the graph does not know."""
    if not all(t in graph.ends for t in step.types):
        return None
    here = {t for e in step.types for t in graph.ends[e][0 if step.reverse else 1]}
    then = reachable(graph, step.then) if step.then else set()
    return None if then is None else here | then


def _element(kind: str, id_: Column, type_: Column, label: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), type_.alias("type"), label.alias("label"))


def start(graph: Graph, condition: Column | None = None, text: bool = False) -> DataFrame:
    """Paths of one vertex each: ``root, cur, objects``, or as ``text`` ``root, cur, path, vertices``."""
    seeds = graph.vertices if condition is None else graph.vertices.where(condition)
    if text:
        return seeds.select(F.col("id").alias("root"), F.col("id").alias("cur"), F.col("id").alias("path"), F.lit(1).cast("long").alias("vertices"))
    return seeds.select(F.col("id").alias("root"), F.col("id").alias("cur"), F.array(_element("vertex", F.col("id"), F.col("type"), F.col("label"))).alias("objects"))


def expand(paths: DataFrame, graph: Graph, step: Expand) -> DataFrame:
    """Each path with every edge and vertex that continue it.

    Where the graph knows which types an edge type leads to, only these vertices are read.
    """
    return _expand(paths.withColumn("_at", F.col("cur")), graph, step).drop("_at")


def _expand(paths: DataFrame, graph: Graph, step: Expand) -> DataFrame:
    """The same from ``_at``, which is null for a path that may not go on."""
    here, there = ("dst", "src") if step.reverse else ("src", "dst")
    edges = graph.edges.where(F.col("type").isin(*step.types)).select(F.col(here).alias("_here"), F.col(there).alias("next"), F.col("type").alias("e_type"))
    ends = graph.vertices
    if all(t in graph.ends for t in step.types):
        ends = ends.where(F.col("type").isin(*sorted({t for e in step.types for t in graph.ends[e][0 if step.reverse else 1]})))
    ends = ends.select(F.col("id").alias("next"), F.col("type").alias("v_type"), F.col("label").alias("v_label"))
    if step.contains is not None:
        ends = ends.where(F.col("v_label").contains(step.contains))
    # edge and vertex are joined first: an edge without its vertex continues nothing
    hops = edges.join(ends, "next")
    on = F.col("_at") == F.col("_here")
    if graph.hubs and all(set(graph.ends[t][1 if step.reverse else 0]) <= set(graph.hubs) for t in step.types if t in graph.ends) and all(t in graph.ends for t in step.types):
        # few vertices with many paths and many edges: their edges once for each share of the paths
        hops = hops.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(HUB_SHARES - 1))))
        paths = paths.withColumn("_part", F.pmod(F.xxhash64("root"), F.lit(HUB_SHARES)).cast("int"))
        on = on & (F.col("_part") == F.col("_share"))
    joined = paths.join(hops, on, "left" if step.optional else "inner")
    if "path" in paths.columns:
        # the text and the count grow with the path; no array of elements is kept
        more = F.concat(F.lit(">"), F.col("e_type"), F.lit(">"), F.col("next"))
        form = [F.concat("path", F.coalesce(more, F.lit(""))).alias("path"), (F.col("vertices") + F.col("next").isNotNull().cast("long")).alias("vertices")]
    else:
        edge = _element("edge", F.concat_ws("-", "_here", "next", "e_type"), F.col("e_type"), F.col("e_type"))
        longer = F.concat("objects", F.array(edge, _element("vertex", F.col("next"), F.col("v_type"), F.col("v_label"))))
        form = [F.when(F.col("next").isNull(), F.col("objects")).otherwise(longer).alias("objects")]
    out = joined.select("root", F.coalesce("next", "cur").alias("cur"), *form, F.col("next").alias("_at"))
    return out if step.then is None else _expand(out, graph, step.then)


def compile_pattern(paths: DataFrame, graph: Graph, steps: tuple | list) -> DataFrame:
    """The paths that a pattern yields from a frontier."""
    for step in steps:
        if isinstance(step, Union):
            parts = [compile_pattern(paths, graph, branch) for branch in step.branches]
            paths = parts[0]
            for part in parts[1:]:
                paths = paths.unionAll(part)
        else:
            paths = expand(paths, graph, step)
    return paths


def line(graph: Graph, steps: tuple | list) -> list[Expand] | None:
    """A pattern's steps one after another, if its paths make trees; else None.

    They do if it has no union, nothing but nested steps follows an optional one, and the graph
    knows each step's one edge type and the one vertex type that it leads to.
    """
    out: list[Expand] = []
    for step in steps:
        if isinstance(step, Union) or any(s.optional for s in out):
            return None
        while step is not None:
            one = replace(step, then=None)
            if len(step.types) > 1 or len(reachable(graph, one) or ()) != 1 or (not step.optional and any(s.optional for s in out)):
                return None
            out.append(one)
            step = step.then
    return out


def _hops(graph: Graph, step: Expand) -> tuple[DataFrame, DataFrame]:
    """``here, id`` of a step's edges and ``id`` of the vertices that they may lead to."""
    here, there = ("dst", "src") if step.reverse else ("src", "dst")
    edges = graph.edges.where(F.col("type") == step.types[0]).select(F.col(here).alias("here"), F.col(there).alias("id"))
    ends = graph.vertices.where(F.col("type").isin(*reachable(graph, step)))
    return edges, (ends if step.contains is None else ends.where(F.col("label").contains(step.contains))).select("id")


def trees(graph: Graph, steps: list[Expand], roots: DataFrame) -> DataFrame:
    """``id, next``: each of the roots (``id``) that has paths of a :func:`line`, with its paths as
    one tree.

    ``next`` is an array of ``id, next``, on the last level of ids; it is null where nothing
    follows.  Arrays are in the order of the paths' texts: an id that is followed ends in the
    ``>`` that the text has there.  Paths that begin alike are one row up to where they part,
    and rows are made from the paths' ends, so that the widest tables are those of single hops.
    """
    below, optional = None, False
    for step in reversed(steps):
        edges, ends = _hops(graph, step)
        item = F.col("id")
        if below is not None:
            ends = ends.join(below, "id", "left" if optional else "inner")
            item = F.struct(F.concat("id", F.when(F.col("next").isNull(), "").otherwise(">")).alias("id"), "next")
        below = edges.join(ends, "id").groupBy("here").agg(F.sort_array(F.collect_list(item)).alias("next")).withColumnRenamed("here", "id")
        optional = step.optional
    return roots.select("id").distinct().join(below, "id", "left" if optional else "inner")


def larger(graph: Graph, steps: list[Expand], roots: DataFrame, limit: int) -> DataFrame | None:
    """``id`` of the roots whose trees have more than ``limit`` places, or None where none can.

    None can if the steps' largest fan-outs multiply to less; else the places are counted.
    """
    bound = total = 1
    for step in steps:
        edges, _ = _hops(graph, step)
        bound *= edges.groupBy("here").count().agg(F.max("count")).first()[0] or 0
        total += bound
    if total <= limit:
        return None
    below = None
    for step in reversed(steps):
        edges, ends = _hops(graph, step)
        n = F.lit(1)
        if below is not None:
            ends, n = ends.join(below, "id", "left"), 1 + F.coalesce("n", F.lit(0))
        below = edges.join(ends, "id").groupBy("here").agg(F.sum(n).alias("n")).withColumnRenamed("here", "id")
    return roots.select("id").distinct().join(below.where(F.col("n") >= limit), "id", "left_semi")


def path_text() -> Column:
    """Vertex ids and edge types of a path, joined by ``>``."""
    return F.array_join(F.transform("objects", lambda o: F.when(o["kind"] == "edge", o["type"]).otherwise(o["id"])), ">")


def hops() -> Column:
    """Vertices of a path, as results count them; edges are one fewer."""
    return F.size(F.filter("objects", lambda o: o["kind"] == "vertex"))
