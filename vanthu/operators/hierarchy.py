"""Problem 3: parent-child links to full hierarchies.

Method: leaves are peeled to expose cycles (each step peels twice as many layers as the one before, since a node
survives m layers exactly if it is the m-th ancestor of some node; nodes whose way has ended at a root leave the work), then
the forest's Euler tours are ranked by pointer jumping. Entry and exit positions give descendants and their number; the jumps
along the parents that end at the roots give root, depth and path, the path by joining the strings of both halves.
Containment of intervals is an equi-join on dyadic blocks of the tour of at most ``2 ** TOP_LEVEL`` positions, so neither a
tree nor half of one is gathered in one task; the children of one parent are ordered in ranges, not in one window.

Defined cases: repeated rows of one id count once (smallest parent, then type and number); a null parent is a root;
a null type or number is an empty part of the path; an empty table gives empty results; a node that is its own parent
is a cycle; nodes below a missing parent keep a path from that fragment's top, with ``rooted`` false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vanthu.runtime import cut, stored

#: No block of a tour is larger than 2 to this power.
TOP_LEVEL = 16


def _nodes(sections: DataFrame) -> DataFrame:
    picked = F.min(F.struct(F.col("parent_id").isNull(), "parent_id", "section_type", "number")).alias("r")
    rows = sections.where(F.col("id").isNotNull()).groupBy("id").agg(picked)
    return rows.select("id", F.col("r.parent_id").alias("parent_id"), F.col("r.section_type").alias("section_type"), F.col("r.number").alias("number"))


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes on cycles, nodes that lead into a cycle or are on one) of ``edges`` (id, anc), one edge for each id.

    Each step squares the ancestor map, so step k has peeled 2^k layers of leaves; the set of ancestors left shrinks
    until only cycles remain. The number of steps is logarithmic in the depth.
    """
    jump, last = edges, -1
    while True:
        alive = jump.agg(F.count_distinct("anc")).first()[0]
        if alive == last or alive == 0:
            break
        last = alive
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.anc") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.anc").alias("anc")))
    return jump.select(F.col("anc").alias("id")).distinct(), jump.select("id")


def classify(sections: DataFrame) -> DataFrame:
    """All nodes with ``fault`` (on_cycle, below_cycle, missing_parent or null)."""
    nodes = cut(_nodes(sections))
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = cut(nodes.join(known, "parent_id", "left"))
    on, into = peel(linked.where("_known").select("id", F.col("parent_id").alias("anc")))
    marked = linked.join(on.withColumn("_on", F.lit(True)), "id", "left").join(into.distinct().withColumn("_into", F.lit(True)), "id", "left")
    fault = F.when(F.col("_on"), "on_cycle").when(F.col("_into"), "below_cycle").when(F.col("parent_id").isNotNull() & F.col("_known").isNull(), "missing_parent")
    return marked.select("id", "parent_id", "section_type", "number", fault.alias("fault"))


def faults(sections: DataFrame) -> DataFrame:
    """(id, fault): the sections without a way to a root."""
    return classify(sections).where("fault is not null").select("id", "fault")


def _next_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(par, id, nxt, p) of (par, id, p) sorted within a range p: the next child of the same parent; -1 in the last row of the range, which only the next range knows."""
    held = None
    for batch in batches:
        par, ids, p = (np.asarray(batch.column(k)) for k in range(3))
        if not len(par):
            continue
        if held is not None:
            par, ids = np.append(held[0], par), np.append(held[1], ids)
        nxt = np.where(par[1:] == par[:-1], ids[1:], 0)
        same = par[1:] == par[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(par[:-1]), pa.array(ids[:-1]), pa.array(nxt, mask=~same), pa.array(np.full(len(nxt), p[0]))], names=["par", "id", "nxt", "p"])
        held = par[-1], ids[-1], p[0]
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(held[0])], pa.int64()), pa.array([int(held[1])], pa.int64()), pa.array([-1], pa.int64()), pa.array([int(held[2])], pa.int32())], names=["par", "id", "nxt", "p"])


def siblings(children: DataFrame) -> DataFrame:
    """(id, par, nxt) of (id, par): the next child of the parent by id, null for its last. Children are sorted in ranges, so those of one parent may lie in several tasks."""
    ranged = children.select("par", "id").repartitionByRange("par", "id").sortWithinPartitions("par", "id").withColumn("p", F.spark_partition_id())
    got = cut(ranged.mapInArrow(_next_in_range, "par long, id long, nxt long, p int"))
    # one row for each range: its first child, seen by the range before
    firsts = got.groupBy("p").agg(F.min(F.struct("par", "id")).alias("f"))
    after = firsts.select("p", F.lead("f").over(W.orderBy("p")).alias("f"))
    last = got.where("nxt = -1").join(F.broadcast(after), "p").select("id", "par", F.when(F.col("f.par") == F.col("par"), F.col("f.id")).alias("nxt"))
    return got.where("nxt is null or nxt <> -1").select("id", "par", "nxt").unionByName(last)


def tours(forest: DataFrame) -> DataFrame:
    """(id, to_end_in, to_end_out): the elements from a node's entry and from its exit to the end of its tree's Euler tour, of a forest (id, par).

    The tour of a tree is a linked list, children by id. A node with children has an element for its entry (2 * id) and one
    for its exit (2 * id + 1), a leaf one of weight two. Pointer jumping adds up the weights up to the end of the list.
    """
    sib = cut(siblings(forest.where("par is not null")))
    first = sib.groupBy(F.col("par").alias("id")).agg(F.min("id").alias("child"))
    base = cut(forest.select("id").join(first, "id", "left").join(sib, "id", "left"))
    behind = F.when(F.col("nxt").isNotNull(), F.col("nxt") * 2).when(F.col("par").isNotNull(), F.col("par") * 2 + 1)
    enter = base.select((F.col("id") * 2).alias("e"), F.when(F.col("child").isNotNull(), F.col("child") * 2).otherwise(behind).alias("s"), F.when(F.col("child").isNull(), 2).otherwise(1).cast("long").alias("n"))
    leave = base.where("child is not null").select((F.col("id") * 2 + 1).alias("e"), behind.alias("s"), F.lit(1).cast("long").alias("n"))
    # (element, element its sum reaches up to or null at the end of the list, sum up to there)
    state = stored(enter.unionByName(leave), "tours")
    while state.where("s is not null").limit(1).count():
        b = state.select(F.col("e").alias("s"), F.col("s").alias("s2"), F.col("n").alias("n2"))
        going = state.where("s is not null").join(b, "s").select("e", F.col("s2").alias("s"), (F.col("n") + F.col("n2")).alias("n"))
        state = stored(going.unionByName(state.where("s is null")), "tours")
    both = state.groupBy(F.expr("e div 2").alias("id")).agg(F.max(F.when(F.col("e") % 2 == 0, F.col("n"))).alias("to_end_in"), F.max(F.when(F.col("e") % 2 == 1, F.col("n"))).alias("out"))
    return both.select("id", "to_end_in", F.coalesce("out", F.col("to_end_in") - 1).alias("to_end_out"))


def lineage(forest: DataFrame, with_path: bool = True) -> DataFrame:
    """(id, root_id, depth, path) of a forest (id, par, label) by jumps along the parents: the path up to an ancestor is joined with that ancestor's. Only nodes with children are jumped to."""
    inner = forest.where("par is not null").select(F.col("par").alias("id")).distinct().withColumn("inner", F.lit(True))
    label = F.col("label") if with_path else F.lit(None).cast("string")
    state = stored(forest.join(inner, "id", "left").select("id", F.col("par").alias("anc"), F.col("id").alias("root_id"), F.lit(1).alias("depth"), label.alias("path"), F.coalesce("inner", F.lit(False)).alias("inner")), "lineage")
    while state.where("anc is not null").limit(1).count():
        b = state.where("inner").select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("root_id").alias("root2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        going = state.where("anc is not null").join(b, "anc")
        moved = going.select("id", F.col("anc2").alias("anc"), F.col("root2").alias("root_id"), (F.col("depth") + F.col("depth2")).alias("depth"), F.concat("path2", F.lit("/"), "path").alias("path"), "inner")
        state = stored(moved.unionByName(state.where("anc is null")), "lineage")
    return state.select("id", "root_id", "depth", "path")


def intervals(lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, root_id, depth, path, len, entry, exit) from ``lineage`` and ``tours``; len is the length of the tree's tour."""
    both = lines.join(ranks, "id")
    roots = both.where("id = root_id").select("root_id", F.col("to_end_in").alias("len"))
    return both.join(roots, "root_id").select("id", "root_id", "depth", "path", "len", (F.col("len") - F.col("to_end_in")).alias("entry"), (F.col("len") - F.col("to_end_out")).alias("exit"))


def closure(iv: DataFrame) -> DataFrame:
    """(id, descendant_id) of every node and each node beneath it, by containment of tour intervals.

    An interval splits into at most two blocks of each dyadic level below ``TOP_LEVEL`` and blocks of that level in
    between; a position lies in one block of each level of its tree. Equal (root, level, block) is containment, found once
    for each pair.
    """
    blocks = iv.where("exit > entry + 1").select("id", "root_id", F.explode(_dyadic(F.col("entry"), F.col("exit"))).alias("b"))
    levels = F.least(F.lit(TOP_LEVEL), F.length(F.bin(F.col("len"))))
    points = iv.select(F.col("id").alias("descendant_id"), "root_id", "entry", F.posexplode(F.sequence(F.lit(0), levels)).alias("lv", "_k"))
    left = blocks.select("id", "root_id", F.col("b.lv").alias("lv"), F.col("b.bk").alias("bk"))
    right = points.select("descendant_id", "root_id", "lv", F.expr("shiftright(entry, lv)").alias("bk"))
    return left.join(right, ["root_id", "lv", "bk"]).where("id <> descendant_id").select("id", "descendant_id")


def _dyadic(lo, hi):
    """Blocks (lv, bk) that exactly cover positions lo..hi, as a column expression.

    Level k contributes a left block if the running lower bound is odd there, a right block if the upper bound is even;
    what is left at the top level is listed.
    """
    kind = "array<struct<lv:int,bk:bigint>>"
    none = F.array().cast(kind)
    zero = F.struct(lo.cast("long").alias("l"), hi.cast("long").alias("h"), none.alias("out"))

    def step(acc, k):
        l, h = acc["l"], acc["h"]
        live = l <= h
        take_l = live & (l % 2 == 1)
        take_h = live & (h % 2 == 0) & ~(take_l & (l == h))
        one = lambda cond, v: F.when(cond, F.array(F.struct(k.alias("lv"), v.alias("bk")))).otherwise(none)
        l2 = F.when(take_l, l + 1).otherwise(l)
        h2 = F.when(take_h, h - 1).otherwise(h)
        nl = F.when(live & (l2 <= h2), F.shiftright(l2, 1)).otherwise(F.lit(1).cast("long"))
        nh = F.when(live & (l2 <= h2), F.shiftright(h2, 1)).otherwise(F.lit(0).cast("long"))
        return F.struct(nl.alias("l"), nh.alias("h"), F.concat(acc["out"], one(take_l, l), one(take_h, h)).alias("out"))

    def listed(acc):
        top = F.transform(F.sequence(acc["l"], F.greatest(acc["l"], acc["h"])), lambda b: F.struct(F.lit(TOP_LEVEL).alias("lv"), b.alias("bk")))
        return F.concat(acc["out"], F.when(acc["l"] <= acc["h"], top).otherwise(none))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TOP_LEVEL - 1)), zero, step, listed)


def _forest(sections: DataFrame) -> DataFrame:
    """(id, par, label, rooted): the nodes with a way to a top, which has no parent or a missing one."""
    known = classify(sections).where("fault is null or fault = 'missing_parent'")
    label = F.trim(F.concat_ws(" ", F.coalesce("section_type", F.lit("")), F.coalesce("number", F.lit(""))))
    return cut(known.select("id", F.when(F.col("fault").isNull(), F.col("parent_id")).alias("par"), label.alias("label"), F.col("fault").isNull().alias("rooted")))


def hierarchy(sections: DataFrame) -> DataFrame:
    """(id, root_id, depth, path, n_descendants, entry, exit, rooted): depth of a root is 1, the path "type number/type number"."""
    forest = _forest(sections)
    iv = intervals(lineage(forest), tours(forest))
    tops = forest.where("par is null").select(F.col("id").alias("root_id"), "rooted")
    return iv.join(tops, "root_id").select("id", "root_id", "depth", "path", F.expr("(exit - entry - 1) div 2").alias("n_descendants"), "entry", "exit", "rooted")


def descendants(sections: DataFrame) -> DataFrame:
    """(id, descendant_id) of every node and each node beneath it."""
    forest = _forest(sections)
    return closure(cut(intervals(lineage(forest, with_path=False), tours(forest))))
