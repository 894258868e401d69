"""Graphs of files and symbols: degrees, neighbours, bounded search, cycles, trees and the capped graphs that diagrams show."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators.resolve import folder_of
from loomdex.runtime import checkpoint, dealt

#: A frontier of no more nodes is sent to every task.
BROADCAST_ROWS = 1 << 16


def in_degree(edges: DataFrame, dst: str = "dst_file", weight: str | None = "count") -> DataFrame:
    """dst, in_degree: weighted, or the number of edges."""
    return edges.groupBy(dst).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("in_degree"))


def neighbours(edges: DataFrame, node: str, src: str = "src_qname", dst: str = "dst_qname") -> DataFrame:
    """direction, name: distinct callers and callees of a node."""
    callers = edges.where(F.col(dst) == node).select(F.lit("caller").alias("direction"), F.col(src).alias("name"))
    callees = edges.where(F.col(src) == node).select(F.lit("callee").alias("direction"), F.col(dst).alias("name"))
    return callers.union(callees).distinct()


def related(edges: DataFrame, src: str = "src_file", dst: str = "dst_file") -> DataFrame:
    """node, other: both directions of every edge, once."""
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).union(edges.select(dst, src)).distinct()


def top_edges(edges: DataFrame, most: int, nodes: DataFrame | None = None, src: str = "src_qname", dst: str = "dst_qname") -> DataFrame:
    """The heaviest edges, ties by names; with ``nodes`` (one column, ``node``) only edges between known ones."""
    if nodes is not None:
        for end in (src, dst):
            edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges.orderBy(F.desc("count"), src, dst).limit(most).select(src, dst, "count")


def _ends(edges: DataFrame, src: str = "src_qname", dst: str = "dst_qname") -> DataFrame:
    """node, direction, other of every edge, seen from either end, in one pass; repeated edges stay."""
    end = lambda node, direction, other: F.struct(F.col(node).alias("node"), F.lit(direction).alias("direction"), F.col(other).alias("other"))
    return edges.select(F.inline(F.array(end(dst, "caller", src), end(src, "callee", dst))))


def ranked_neighbours(edges: DataFrame, most: int, src: str = "src_qname", dst: str = "dst_qname", parts: int | None = None) -> DataFrame:
    """node, direction, name, rank: at most ``most`` callers and callees of every node, by name; nodes are dealt to ``parts`` tasks.

    Equal names share a rank, so ranks are cut before what is left of repeated edges is made one.
    """
    both = dealt(_ends(edges, src, dst), parts, "node", "direction").select("node", "direction", F.col("other").alias("name"))
    rank = F.dense_rank().over(Window.partitionBy("node", "direction").orderBy("name"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).distinct()


def reach(edges: DataFrame, roots: DataFrame, depth: int = 2, src: str = "src_qname", dst: str = "dst_qname") -> DataFrame:
    """node, depth: the nodes within ``depth`` steps of the roots in either direction, with their least depth.

    One join per step with the frontier only, to which a small frontier is sent; visited nodes are left out by an anti join, and each step is checkpointed.
    """
    both = _ends(edges, src, dst).select("node", "other")
    seen = checkpoint(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        near = front.select("node")
        near = F.broadcast(near) if near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else near
        step = both.join(near, "node").select(F.col("other").alias("node")).distinct()
        front = checkpoint(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(front)
    return seen


class Found(NamedTuple):
    """What a search met, and whether its bound kept it from anything."""

    hits: DataFrame
    cut: bool


def search(edges: DataFrame, roots: DataFrame, stops: DataFrame, depth: int = 2, most: int | None = None, parts: int | None = None) -> Found:
    """node, via, direction, depth: the ``stops`` that a breadth-first search from all roots meets, and whether it was cut.

    The queue begins with the roots by name; a node's neighbours follow by direction (callee, caller) and name. Stops are not searched beyond. Without
    ``most`` the search is whole: a node's place in the queue is its path of names and directions, and the least path is found by aggregation, so
    no step is gathered or numbered; edges to nodes that were seen are dropped before each step, dealt to ``parts`` tasks. With it, see ``bounded_search``; then a search that saw more nodes than ``most`` says so.
    """
    if most is not None:
        hits, seen = _bounded(edges, roots, stops, depth, most)
        return Found(hits, seen.limit(most + 1).count() > most)
    known = stops.select(F.col("node").alias("other"), F.lit(True).alias("stop")).distinct()
    new = checkpoint(roots.select("node").where("node is not null").distinct())
    front, found = new.select("node", F.array("node").alias("path")), []
    rest = dealt(_ends(edges), parts, "other")
    for d in range(1, depth + 1):
        rest = rest.join(new.select(F.col("node").alias("other")), "other", "left_anti")
        rest = checkpoint(rest) if d < depth else rest
        first = rest.join(front, "node").groupBy("other").agg(F.min(F.concat("path", F.array("direction"))).alias("by"))
        ranked = checkpoint(first.join(known, "other", "left"))
        new = ranked.select(F.col("other").alias("node"))
        hit = ranked.where("stop").select(F.col("other").alias("node"), F.element_at("by", -2).alias("via"), F.element_at("by", -1).alias("direction"), F.lit(d).alias("depth"))
        found.append(hit)
        front = ranked.where("stop is null").select(F.col("other").alias("node"), F.concat("by", F.array("other")).alias("path"))
    return Found(reduce(DataFrame.union, found), False)


def bounded_search(edges: DataFrame, roots: DataFrame, stops: DataFrame, depth: int = 2, most: int = 256) -> DataFrame:
    """node, via, direction, depth: the ``stops`` that a breadth-first search meets.

    The queue begins with the roots by name; a node's neighbours follow by direction (callee, caller) and name. Stops are not searched beyond.
    Nodes after the ``most``-th, roots counted, are seen but neither given nor searched; ``search`` says whether there were such. A step holds at
    most most * 2 * most candidates, whatever the graph's size.
    """
    return _bounded(edges, roots, stops, depth, most)[0]


def _bounded(edges: DataFrame, roots: DataFrame, stops: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    both = checkpoint(_ends(edges).distinct())  # every step joins it with a few nodes only
    near = Window.partitionBy("node", "direction").orderBy("other")
    seen = checkpoint(roots.select("node").distinct())
    first = seen.orderBy("node").limit(most)  # later roots are beyond the bound, and so is what they alone lead to
    front = checkpoint(first.select("node", F.row_number().over(Window.orderBy("node")).alias("at")))
    found = None
    for d in range(1, depth + 1):
        step = both.join(front, "node").withColumn("n", F.row_number().over(near)).where(F.col("n") <= most)
        step = step.join(seen.select(F.col("node").alias("other")), "other", "left_anti")
        first = step.groupBy("other").agg(F.min(F.struct("at", "direction", "node")).alias("by"))
        order = Window.orderBy("by.at", "by.direction", "other")
        ranked = first.withColumn("at", F.row_number().over(order))
        room = most - seen.count()
        ranked = checkpoint(ranked.join(stops.select(F.col("node").alias("other"), F.lit(True).alias("stop")).distinct(), "other", "left"))
        seen = checkpoint(seen.union(ranked.select("other")))
        kept = ranked.where(F.col("at") <= room)
        hits = kept.where("stop").select(F.col("other").alias("node"), F.col("by.node").alias("via"), F.col("by.direction").alias("direction"), F.lit(d).alias("depth"))
        found = hits if found is None else found.union(hits)
        front = kept.where("stop is null").select(F.col("other").alias("node"), "at")
    return found, seen


def _followed(single: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Where nodes with one edge out, (v, end), lead: v, end and ``on``, for those that never come to a node of another kind; the jumps of 1, 2, 4, ...
    edges (v, end) among them; and the rings they make (v, component), if any.

    Jumps double until all have come to an end, or the nodes that they come to get no fewer: those stand in rings, which whatever is left leads to. So
    there are as many rounds as the longest way has binary digits.
    """
    known = single.select(F.col("v").alias("end"), F.lit(True).alias("_on"))
    steps = checkpoint(single.join(known, "end", "left").select("v", "end", F.coalesce("_on", F.lit(False)).alias("on"), F.least("v", F.when(F.col("_on"), F.col("end"))).alias("least")))
    jumps: list[DataFrame] = []
    ends, before = steps.where("on").select(F.countDistinct("end")).first()[0], None
    while ends and ends != before:
        jumps.append(steps.where("on").select("v", "end"))
        ahead = steps.select(F.col("v").alias("end"), F.col("end").alias("_end"), F.col("on").alias("_on"), F.col("least").alias("_least"))
        gone = steps.where("on").join(ahead, "end").select("v", F.col("_end").alias("end"), F.col("_on").alias("on"), F.least("least", "_least").alias("least"))
        steps = checkpoint(gone.union(steps.where("not on")))
        before, ends = ends, steps.where("on").select(F.countDistinct("end")).first()[0]
    if not ends:
        return steps.select("v", "end", "on"), jumps, None
    around = checkpoint(steps.join(steps.where("on").select(F.col("end").alias("v")).distinct(), "v", "left_semi").select("v", "end", "least"))
    moved = 1
    while moved:  # until no node learns of a lesser one from as far ahead as it has looked
        ahead = around.select(F.col("v").alias("end"), F.col("end").alias("_end"), F.col("least").alias("_least"))
        step = checkpoint(around.join(ahead, "end").select("v", F.col("_end").alias("end"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_moved")))
        moved, around = step.where("_moved").count(), step.select("v", "end", "least")
    return steps.select("v", "end", "on"), jumps, around.select("v", F.col("least").alias("component"))


class Layer(NamedTuple):
    """What a contraction took out: its edges by way of their first node (a, v, b), and the jumps from there on."""

    entries: DataFrame
    jumps: list[DataFrame]


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, Layer | None]:
    """Edges among nodes with several edges out, where ways by nodes with one are single edges; the rings of those; and what stood on the ways.

    Ways that come to a node without edges, or into a ring, lie on no circle and are dropped, however deep the trees that they make.
    """
    out = checkpoint(edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("end")))
    many = out.where("n > 1").select("a")
    fate, jumps, ring = _followed(out.where("n = 1").select(F.col("a").alias("v"), "end"))
    start = edges.join(many, "a", "left_semi").join(fate.select(F.col("v").alias("b"), "end", "on"), "b", "left").where("on is null or not on")
    each = start.select("a", F.when(F.col("end").isNotNull(), F.col("b")).alias("v"), F.coalesce("end", "b").alias("b"))
    each = checkpoint(each.join(many.select(F.col("a").alias("b")), "b", "left_semi").select("a", "v", "b"))
    return checkpoint(each.select("a", "b").distinct()), ring, Layer(each.where("v is not null"), jumps)


def _between(layer: Layer, known: DataFrame) -> DataFrame:
    """v, component of the nodes of a layer that stand between two nodes of one component: the first of each such way, and all that follow it."""
    a, b = known.select(F.col("v").alias("a"), F.col("component").alias("_a")), known.select(F.col("v").alias("b"), F.col("component").alias("_b"))
    found = checkpoint(layer.entries.join(a, "a").join(b, "b").where("_a = _b").select("v", F.col("_a").alias("component")).distinct())
    if found.limit(1).count():
        for jump in layer.jumps:
            found = checkpoint(found.union(found.join(jump, "v").select(F.col("end").alias("v"), "component")).distinct())
    return found


def _coloured(edges: DataFrame) -> DataFrame:
    """v, component of the strongly connected components that hold the least node to reach each of their nodes: one for each colour.

    A node's colour is the least node that it can be reached from; the component of the least itself are the nodes of its colour that reach it.
    """
    both = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    colour, moved = checkpoint(both.withColumn("c", F.col("v"))), 1
    while moved:
        came = edges.join(colour.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("c").alias("_c"))
        step = checkpoint(colour.join(came, "v", "left").select("v", F.least("c", "_c").alias("c"), (F.col("_c") < F.col("c")).alias("_moved")))
        moved, colour = step.where("_moved").count(), step.select("v", "c")
    same = edges.join(colour.withColumnRenamed("v", "a"), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("_c")), "b").where("c = _c").select("a", "b", "c")
    same = checkpoint(same)
    found = front = checkpoint(colour.where("v = c"))
    while front.limit(1).count():
        step = same.join(front.select(F.col("v").alias("b")), "b").select(F.col("a").alias("v"), "c").distinct()
        front = checkpoint(step.join(found.select("v"), "v", "left_anti"))
        found = checkpoint(found.union(front))
    return found.select("v", F.col("c").alias("component"))


def circles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the nodes that reach themselves, and the least node of their strongly connected component that the search kept as its name.

    Nodes with one edge out are contracted, with whole trees and chains of them at once, then those with one edge in, until neither changes anything;
    then components are taken out, one a colour, and so on until no edge is left. At last what was contracted follows its ways' ends, from the last
    contraction to the first. Every table is linear in the edges: no pair of nodes is made that isn't an edge. Rounds are as many as the digits of the
    longest way, and steps across what is left.
    """
    rest = checkpoint(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct())
    taken: list[DataFrame | Layer] = []  # nodes with components, or a layer, as they went

    def plain(rest: DataFrame) -> tuple[DataFrame, int]:
        """Without edges from a node to itself, which is a component of its own if in no other."""
        n, own = rest.agg(F.count("*"), F.count_if(F.col("a") == F.col("b"))).first()
        if own:
            taken.append(rest.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("component")))
        return rest.where("a <> b"), n - own

    rest, n = plain(rest)
    while n:
        before = n
        for _ in range(2):  # by edges out, then by edges in
            if n:
                rest, ring, layer = _contracted(rest)
                taken += [x for x in (layer, ring) if x is not None]
                rest, n = plain(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if n == before:
            own = _coloured(rest)
            sizes = own.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
            taken.append(own.join(sizes, "component", "left_semi").select("v", "component"))
            rest = checkpoint(rest.join(own.select(F.col("v").alias("a")), "a", "left_anti").join(own.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b"))
            n = rest.count()
    known = rest.select(F.col("a").alias("v"), F.col("a").alias("component")).limit(0)
    for each in reversed(taken):
        more = _between(each, known) if isinstance(each, Layer) else each
        known = checkpoint(known.union(more.join(known.select("v"), "v", "left_anti")))
    return known.select(F.col("v").alias("node"), "component")


def cycle_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node: the nodes that reach themselves."""
    return circles(edges, src, dst).select("node")


def tree_edges(files: DataFrame, path: str = "path") -> DataFrame:
    """parent, child: each edge of the directory tree once; the root is empty."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("parent"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("child")))
    return files.select(F.inline(steps)).distinct()


def inheritance(symbols: DataFrame) -> DataFrame:
    """child, base, parent: every base of every class; parent is the known class of that name (the last one), or null."""
    classes = symbols.where(F.col("kind").isin("class", "interface"))
    known = classes.groupBy(F.col("name").alias("base")).agg(F.max("qualified_name").alias("parent"))
    bases = classes.select(F.col("qualified_name").alias("child"), F.explode("bases").alias("base")).distinct()
    return bases.join(known, "base", "left").select("child", "base", "parent")


def prefetch_order(symbol: str, symbols: DataFrame, edges: DataFrame, refs: DataFrame, most: int = 10) -> DataFrame:
    """page, priority, rank of what to load beside a symbol: its callers, its callees, symbols of its folder (most called first, then by name
    downwards), files related to its own.
    """
    own = symbols.where(F.col("qualified_name") == symbol).select(F.col("file").alias("own_file"), folder_of(F.col("file")).alias("own_folder")).limit(1)
    first = neighbours(edges, symbol).select(F.col("name").alias("page"), F.when(F.col("direction") == "caller", 0).otherwise(1).alias("priority"), F.lit(0).alias("degree"))
    degree = in_degree(edges, "dst_qname", None).withColumnRenamed("dst_qname", "page").withColumnRenamed("in_degree", "degree")
    beside = symbols.join(F.broadcast(own), folder_of(F.col("file")) == F.col("own_folder")).where(F.col("file") != F.col("own_file")).select(F.col("qualified_name").alias("page")).distinct()
    beside = beside.join(degree, "page", "left").select("page", F.lit(2).alias("priority"), F.coalesce("degree", F.lit(0)).alias("degree"))
    files = related(refs).join(F.broadcast(own), F.col("node") == F.col("own_file")).select(F.col("other").alias("page"), F.lit(3).alias("priority"), F.lit(0).alias("degree"))
    each = first.union(beside).union(files).where(F.col("page") != symbol).groupBy("page").agg(F.min(F.struct("priority", (-F.col("degree")).alias("less"))).alias("by"))
    down = F.when(F.col("by.priority") == 2, F.col("page"))
    return each.orderBy("by.priority", "by.less", F.desc(down), "page").limit(most).select("page", F.col("by.priority").alias("priority"))


def known_file_nodes(refs: DataFrame, files: DataFrame) -> DataFrame:
    """path, name: the ends of references that are files of the index, with a label for diagrams."""
    ends = related(refs).select(F.col("node").alias("path")).distinct().join(files.select("path"), "path", "left_semi")
    return ends.select("path", text.label(F.element_at(F.split("path", "/"), -1), 32).alias("name"))
