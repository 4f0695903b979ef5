"""Strongly connected components by trimming, chain contraction, and forward-backward search by colour.

A node without a way in or out is a component of its own. A node with one way out lies on a cycle only with the node that it
leads to, so chains of such nodes fold into the first node with several ways (or end in a cycle of their own): their pointers
double each round, so that a chain or cycle of n nodes takes log n rounds. What is left is coloured: every node takes the
largest name that reaches it, and those that reach back to that name within the colour are its component. The rest, without the
edges between colours, goes round again. Folded nodes are told at the end, last fold first: one is of its head's component
if a node of that component leads into the chain before it.

Before all this, nodes without a way out are trimmed for a few rounds while edges are as given: what is shallow and wide goes
there, before it is folded or made distinct. Where no node of what is left branches, its rings are shortened first: a node
named higher (by a hash) than those before and after it is skipped, a third of all, so that all rounds together handle three
times the rows, not their number times the logarithm of the longest ring.

Rounds follow the depth of the part that branches; each is a few joins of edges, written to the shared folder. Rows are nodes
and edges, never reaches or pairs. A component is named by its smallest node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwell.sources.shared import written


#: Rounds of trimming before the first fold, and dead ends beyond which the edges left are written anew.
TRIMS, MANY = 8, 100_000
#: Rows of rings that are followed by doubling, without skipping nodes.
SHORT = 200_000


@dataclass
class Fold:
    heads: DataFrame  # node, head: a chain's node and the branching node that it leads to
    jumps: list[DataFrame]  # at, to: 1, 2, 4, ... steps along a chain, within it
    entries: DataFrame  # src, at, head: an edge from a branching node into a chain


def _keep(df: DataFrame) -> DataFrame:
    return written(df, "components")


def _doubled(chain: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers (at, to) after 1, 2, 4, ... steps, held at the first node that isn't of the chain; and the last ones, with the
    smallest node passed (label; its own counts, the last one's doesn't).

    Cycles never come to an end. Paths lose moving nodes in every round, so if as many move as before, all of these lead into
    cycles; if no label changes and the nodes that they lead to are no fewer than before, all stand on cycles, and the labels
    are those of whole cycles.
    """
    last, size, steps, jumps, before = chain.withColumn("label", F.col("at")), chain.count(), 1, [chain], None
    while steps <= size:
        ahead = last.select(F.col("at").alias("to"), F.col("to").alias("_next"), F.col("label").alias("_label"))
        both = last.join(ahead, "to", "left")
        moved, least = F.col("_next").isNotNull(), F.least("label", "_label")  # least passes over nulls
        new = _keep(both.select("at", F.coalesce("_next", "to").alias("to"), least.alias("label"), moved.alias("_moved"), (least < F.col("label")).alias("_less")))
        last = new.select("at", "to", "label")
        jumps.append(new.select("at", "to"))
        steps *= 2
        moving, less = new.agg(F.count_if("_moved"), F.count_if(F.col("_moved") & F.col("_less"))).first()
        if not moving:
            break
        if moving == before and not less and jumps[-2].select("to").distinct().count() == jumps[-1].select("to").distinct().count():
            break
        before = moving
    return jumps, last


def _without_dead_ends(edges: DataFrame) -> DataFrame:
    """The distinct edges that a few rounds of trimming leave."""
    for _ in range(TRIMS):
        ways = edges.select(F.col("src").alias("node")).distinct()
        dead = _keep(edges.select(F.col("dst").alias("node")).distinct().join(ways, "node", "left_anti"))
        n = dead.count()
        if not n:
            break
        edges = edges.join(dead.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        edges = _keep(edges) if n > MANY else edges
    return _keep(edges.distinct())


def _skipping(chain: DataFrame, k: int) -> DataFrame:
    """at, to, skipped: pointers past the nodes whose names rank, by the k-th hash, above those before and after them. A node
    meets the pointers to it and its own at one place."""
    rank = lambda c: F.xxhash64(c, F.lit(k))
    none, by_node = F.lit(None).cast(chain.schema["at"].dataType), Window.partitionBy("node")
    rows = chain.select(F.col("at").alias("node"), none.alias("at"), "to").unionByName(chain.select(F.col("to").alias("node"), "at", none.alias("to")))
    rows = rows.withColumn("_on", F.max("to").over(by_node)).withColumn("_top", F.max(F.when(F.col("at").isNotNull(), rank("at"))).over(by_node))
    skip = F.col("_on").isNotNull() & (rank("node") > rank("_on")) & (rank("node") > F.col("_top"))
    return rows.filter("at IS NOT NULL").select("at", F.when(skip, F.col("_on")).otherwise(F.col("node")).alias("to"), F.when(skip, F.col("node")).alias("skipped"))


def _rings(chain: DataFrame) -> DataFrame:
    """node, label of the nodes on cycles where every node has one way out. Of a skipped node's pointers at most one comes from
    its ring, whose label it takes."""
    size, rounds = chain.count(), []
    while size > SHORT:
        rounds.append(_keep(_skipping(chain, len(rounds))))
        chain = rounds[-1].select("at", "to")
        n = chain.count()
        if n > 0.9 * size:  # many lead into rings from outside: those that none leads to are on no ring
            chain = _keep(chain.join(chain.select(F.col("to").alias("at")).distinct(), "at", "left_semi").select("at", "to"))
            n = chain.count()
            if n > 0.9 * size:
                break
        size = n
    _, last = _doubled(chain)
    circling = _keep(last.join(chain.select(F.col("at").alias("to")), "to", "left_semi"))
    ring = circling.select(F.col("to").alias("node")).distinct()
    labels = _keep(circling.join(ring, F.col("at") == ring["node"], "left_semi").select(F.col("at").alias("node"), "label"))
    for met in reversed(rounds):
        own = met.filter("skipped IS NOT NULL").join(labels.withColumnRenamed("node", "at"), "at").select(F.col("skipped").alias("node"), "label")
        labels = labels.unionByName(_keep(own))
    return labels


def _reduce(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, Fold | None] | None:
    """One round of trimming and folding: the edges left, (node, label) of cycles of chains, the fold. None: nothing to do."""
    ways = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    chain = _keep(ways.filter("n = 1").select(F.col("node").alias("at"), "to"))
    if chain.isEmpty():  # else a path would be trimmed node by node
        dead_end = edges.select(F.col("dst").alias("node")).join(ways.select("node"), "node", "left_anti").distinct()
        unreached = ways.select("node").join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        dead = _keep(dead_end.unionByName(unreached))
        if dead.isEmpty():
            return None
        gone = lambda side: dead.select(F.col("node").alias(side))
        return _keep(edges.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst")), None, None
    size = chain.count()
    if size > SHORT and size == edges.count():  # nothing branches
        return edges.limit(0), _rings(chain), None
    jumps, last = _doubled(chain)
    inner = chain.select(F.col("at").alias("to"))
    circling = _keep(last.join(inner, "to", "left_semi"))  # they end in a cycle of chain nodes
    ring = circling.select(F.col("to").alias("node")).distinct()
    labels = circling.join(ring, F.col("at") == ring["node"], "left_semi").select(F.col("at").alias("node"), "label")
    heads = _keep(last.join(inner, "to", "left_anti").select(F.col("at").alias("node"), F.col("to").alias("head")))
    branching = edges.join(chain.select(F.col("at").alias("src")), "src", "left_anti")
    into = heads.select(F.col("node").alias("dst"), "head")
    entries = _keep(branching.join(into, "dst").select("src", F.col("dst").alias("at"), "head"))
    direct = branching.join(chain.select(F.col("at").alias("dst")), "dst", "left_anti").select("src", "dst")
    left = direct.unionByName(entries.select("src", F.col("head").alias("dst"))).filter("src <> dst").distinct()
    if heads.isEmpty():  # all of the chain are on cycles or lead into them
        return _keep(left), labels, None
    return _keep(left), labels, Fold(heads, [j.join(inner, "to", "left_semi").select("at", "to") for j in jumps], entries)


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the components that the largest names of a branching graph find, and the edges left."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colours = _keep(nodes.withColumn("colour", F.col("node")).withColumn("new", F.lit(True)))
    while True:  # only nodes whose colour has changed tell it on
        told = colours.filter("new").select(F.col("node").alias("src"), "colour").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_c"))
        better = F.coalesce(F.col("_c") > F.col("colour"), F.lit(False))
        colours = _keep(colours.join(told, "node", "left").select("node", F.when(better, F.col("_c")).otherwise(F.col("colour")).alias("colour"), better.alias("new")))
        if colours.filter("new").isEmpty():
            break
    colour = colours.select("node", "colour")
    inside = edges.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_d")), "dst").filter("colour = _d").select("src", "dst")
    inside = _keep(inside)
    found = frontier = _keep(colour.filter("node = colour"))
    while True:
        back = frontier.withColumnRenamed("node", "dst").join(inside, "dst").select(F.col("src").alias("node"), "colour").distinct()
        frontier = _keep(back.join(found.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        found = _keep(found.unionByName(frontier))
    done = lambda side: found.select(F.col("node").alias(side))
    left = _keep(inside.join(done("src"), "src", "left_anti").join(done("dst"), "dst", "left_anti").select("src", "dst"))
    return found.select("node", F.col("colour").alias("label")), left


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component, size of every node (of nodes, if given, and of the edges). Edges: src, dst."""
    edges = edges.select("src", "dst")
    all_nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    all_nodes = (all_nodes if nodes is None else all_nodes.unionByName(nodes.select("node"))).filter("node IS NOT NULL").distinct()
    kind = dict(all_nodes.dtypes)["node"]
    left, labels, folds = _without_dead_ends(edges.filter("src <> dst")), all_nodes.sparkSession.createDataFrame([], f"node {kind}, label {kind}"), []
    while not left.isEmpty():
        reduced = _reduce(left)
        if reduced is None:
            own, left = _coloured(left)
        else:
            left, own, fold = reduced
            if fold is not None:
                folds.append(fold)
        if own is not None:
            labels = labels.unionByName(own)
    labels = _keep(labels)
    for fold in reversed(folds):
        of = lambda name, column: labels.select(F.col("node").alias(name), F.col("label").alias(column))
        # A branching node without a label is a component of its own, and so is named by itself.
        into = fold.entries.join(of("src", "_s"), "src", "left").join(of("head", "_h"), "head", "left")
        hit = _keep(into.filter(F.coalesce("_s", "src") == F.coalesce("_h", "head")).select("at").distinct())
        for jump in fold.jumps:
            hit = _keep(hit.unionByName(hit.join(jump, "at").select(F.col("to").alias("at"))).distinct())
        inside = fold.heads.join(hit.select(F.col("at").alias("node")), "node").join(of("head", "_h"), "head", "left")
        labels = _keep(labels.unionByName(inside.select("node", F.coalesce("_h", "head").alias("label"))).unionByName(inside.filter("_h IS NULL").select(F.col("head").alias("node"), F.col("head").alias("label")).distinct()))
    named = all_nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return named.join(sizes, "label").select("node", "component", "size")
