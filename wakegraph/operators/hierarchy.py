"""Parent-child links to full hierarchies: paths, depths, roots, descendants and cycles.

Bottom-up peeling takes away, round by round, the nodes that have no child left; only the parents of what was peeled
in a round are looked at in the next. What cannot be peeled holds the cycles. Where only these are wanted, roots are
peeled together with leaves and single-child runs are contracted meanwhile, so that the rounds grow with the logarithm
of the depth; the strongly connected parts of the rest are found by colouring. Each part is then one vertex of an
acyclic graph, over whose peel order descendants go up and paths come down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.session import Workspace


def links(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct (child, parent) links with no null end."""
    return edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where(
        F.col("child").isNotNull() & F.col("parent").isNotNull()
    ).distinct()


def class_links(extends: DataFrame, implements: DataFrame) -> DataFrame:
    return links(extends, "from_class_fqn", "to_class_fqn").union(links(implements, "from_class_fqn", "to_interface_fqn")).distinct()


def numbered(space: Workspace, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, id) and the links as ids (child, parent), both written, as ids must not change when a task runs again."""
    names = edges.select(F.explode(F.array("child", "parent")).alias("name")).distinct()
    nodes = space.put(names.select("name", F.monotonically_increasing_id().alias("id")))
    pairs = edges.join(nodes.select(F.col("name").alias("child"), F.col("id").alias("c")), "child").join(nodes.select(F.col("name").alias("parent"), F.col("id").alias("p")), "parent")
    return nodes, space.put(pairs.select(F.col("c").alias("child"), F.col("p").alias("parent")))


def peel(space: Workspace, arcs: DataFrame) -> DataFrame:
    """(node, level) of arcs(child, parent) without cycles: 0 for leaves, else one more than the highest child.

    A round sends a mark up from every node peeled in the last one. Marks are summed before and after they are sent, so
    a popular parent is no group in one task; a node is peeled when it has as many marks as children. All rounds
    together send each arc once.
    """
    needs = arcs.groupBy("parent").agg(F.count(F.lit(1)).alias("need"))
    up = space.put(arcs.join(needs, "parent").select("child", "parent", "need"))
    leaves = arcs.select("child").join(needs.select(F.col("parent").alias("child")), "child", "left_anti").distinct()
    marks = leaves.select(F.col("child").alias("node"), F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("need"))
    rounds = space.folder(marks.withColumn("level", F.lit(0)), "level")
    level = 0
    while rounds.append_seen(level, marks, F.col("got") == F.col("need")):
        here = rounds.part(level)
        sent = here.where("got = need").select(F.col("node").alias("child")).join(up, "child").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("got"), F.max("need").alias("need"))
        waiting = here.where("got < need")
        marks = waiting.unionByName(sent).groupBy("node").agg(F.sum("got").alias("got"), F.max("need").alias("need"))
        level += 1
    return rounds.all().where("got = need").select("node", "level")


def trim(space: Workspace, edges: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """The links from which peeling from both sides leaves nothing to peel, what was contracted, and whether links are left.

    edges: child, parent, via (ids). A round takes away the links of nodes without children or without parents. Of the
    nodes with one child and one parent it takes those with the least hash among the three, which no two neighbours
    are: the links at such a node become one from its child to its parent, whose `via` is the node, and a link that
    already had a via leaves (via, into) behind. Rounds end when nothing was peeled. The degrees are aggregates and the
    links of a hot node stay where they are, on the side of the joins that may be split.
    """
    # what differs from round to round is in the rows, so that the code of a round is compiled once
    left, pointers = edges.withColumn("turn", F.lit(0)), None
    while True:
        end = lambda node, c, p: F.struct(F.col(node).alias("node"), c.alias("c"), p.alias("p"))
        none = F.lit(None).cast("long")
        ends = left.select(F.explode(F.array(end("child", none, F.col("parent")), end("parent", F.col("child"), none))).alias("e"), "turn").select("e.*", "turn")
        degrees = ends.groupBy("node").agg(F.max("turn").alias("turn"), F.min("c").alias("c"), F.max("c").alias("c2"), F.min("p").alias("p"), F.max("p").alias("p2"))
        mark = lambda n: F.xxhash64("turn", n)
        inner = (F.col("c") == F.col("c2")) & (F.col("p") == F.col("p2")) & (mark("node") < mark("c")) & (mark("node") < mark("p"))
        ended = F.col("c").isNull() | F.col("p").isNull()
        out, peeled = space.put_seen(degrees.withColumn("ended", ended).where(ended | inner).select("node", "ended", "c", "p", "turn"), any=F.col("ended"))
        at = lambda side: out.select(F.col("node").alias(side), F.col("ended").alias(f"{side}_ended"), F.when(~F.col("ended"), F.col("node")).alias(f"{side}_into"))
        met = left.join(at("child"), "child", "left").join(at("parent"), "parent", "left")
        kept = F.col("child_ended").isNull() & F.col("parent_ended").isNull()
        into = F.coalesce("child_into", "parent_into")
        rows = met.where(kept | (F.col("via").isNotNull() & into.isNotNull())).select("child", "parent", "via", F.when(~kept, into).alias("into"), (F.col("turn") + 1).alias("turn"))
        joined = out.where("not ended").select(F.col("c").alias("child"), F.col("p").alias("parent"), F.col("node").alias("via"), F.lit(None).cast("long").alias("into"), (F.col("turn") + 1).alias("turn"))
        now, seen = space.put_seen(rows.unionByName(joined), left=F.col("into").isNull())
        moved = now.where("into is not null").select("via", "into")
        pointers = moved if pointers is None else pointers.unionByName(moved)
        left = now.where("into is null").select("child", "parent", "via", "turn")
        if not (peeled["any"] and seen["left"]):
            return left.drop("turn"), pointers, seen["left"]


def least_reaching(space: Workspace, edges: DataFrame) -> DataFrame:
    """(node, least): the least id among a node and those from which (child, parent) links lead to it.

    Ids go along links, and along the ids already taken: what reaches my least also reaches me.
    """
    state = space.put(edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("least", F.col("node")).withColumn("moved", F.lit(True)))
    while True:
        sent = edges.join(state.select(F.col("node").alias("child"), "least"), "child").select(F.col("parent").alias("node"), "least", F.lit(None).cast("long").alias("was"))
        now = state.select("node", "least", F.col("least").alias("was")).unionByName(sent).groupBy("node").agg(F.min("least").alias("least"), F.max("was").alias("was"))
        jump = state.select(F.col("node").alias("least"), F.col("least").alias("further"))
        now = now.join(jump, "least").select("node", F.least("least", "further").alias("least"), "was")
        now, seen = space.put_seen(now.select("node", "least", (F.col("least") < F.col("was")).alias("moved")), moved=F.col("moved"))
        space.drop(state)
        state = now
        if not seen["moved"]:
            return state.select("node", "least")


def components(space: Workspace, edges: DataFrame) -> DataFrame | None:
    """(node, part) of the strongly connected parts with a cycle, of links (child, parent) as ids; None if there is none.

    Colouring: every node takes the least id that reaches it; those that in turn reach this id within its colour are
    one part. They are taken out, the rest is trimmed and coloured again.
    """
    left, pointers, some = trim(space, edges.withColumn("via", F.lit(None).cast("long")))
    found, absorbed = None, [pointers]
    while some:
        plain = left.select("child", "parent").distinct()
        colour = least_reaching(space, plain)
        inner = space.put(
            plain.join(colour.select(F.col("node").alias("child"), F.col("least").alias("c")), "child")
            .join(colour.select(F.col("node").alias("parent"), "least"), "parent").where("c = least").select("child", "parent")
        )
        back = least_reaching(space, inner.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        part = space.put(colour.join(back.withColumnRenamed("least", "reaches"), "node").where("least = reaches").select("node", F.col("least").alias("part")))
        # a node between cycles is a part of its own, but on a cycle only if it links to itself
        loops = plain.where("child = parent").select(F.col("child").alias("node"), F.lit(True).alias("loop"))
        sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        on_cycle = space.put(part.join(sizes, "part").join(loops, "node", "left").where("n > 1 or loop").select("node", "part"))
        # what was contracted into a link within a part lies on its cycles
        within = left.where("via is not null").join(on_cycle.select(F.col("node").alias("child"), "part"), "child").join(on_cycle.select(F.col("node").alias("parent"), F.col("part").alias("other")), "parent").where("part = other")
        these = on_cycle.unionByName(within.select(F.col("via").alias("node"), "part"))
        found = these if found is None else found.unionByName(these)
        taken = part.select("node")
        rest = space.put(left.join(taken.withColumnRenamed("node", "child"), "child", "left_anti").join(taken.withColumnRenamed("node", "parent"), "parent", "left_anti"))
        left, pointers, some = trim(space, rest.select("child", "parent", "via"))
        absorbed.append(pointers)
    if found is None:
        return None
    # contracted nodes to those they went into, by doubling, and on to their part
    found = space.put(found)
    into = absorbed[0]
    for more in absorbed[1:]:
        into = into.unionByName(more)
    into, moved = space.put_seen(into.select("via", "into", F.lit(True).alias("moved")), moved=F.lit(True))
    while moved["moved"]:
        further = into.select(F.col("via").alias("into"), F.col("into").alias("next"))
        into, moved = space.put_seen(into.join(further, "into", "left").select("via", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")), moved=F.col("moved"))
    return found.unionByName(into.join(found.withColumnRenamed("node", "into"), "into").select(F.col("via").alias("node"), "part"))


def cycles(edges: DataFrame, space: Workspace | None = None) -> DataFrame:
    """(node, cycle) of all nodes that reach themselves; cycle is the least name of those on the same cycles.

    edges: child, parent, as of links(). No links or no cycles give no rows.
    """
    space = space or Workspace(edges.sparkSession)
    nodes, pairs = numbered(space, edges)
    found = components(space, pairs)
    if found is None:
        return edges.select(F.col("child").alias("node"), F.col("parent").alias("cycle")).limit(0)
    named = space.put(found.join(nodes.withColumnRenamed("id", "node"), "node").select(F.col("name").alias("node"), "part"))
    return named.join(named.groupBy("part").agg(F.min("node").alias("cycle")), "part").select("node", "cycle")


class Hierarchy:
    """The full hierarchy of (child, parent) links, each computed once and written to the shared folder.

    members   node, vertex: nodes of one cycle share the vertex named by the least of them, others are their own
    levels    vertex, level: peel order from the leaves (0) up
    """

    def __init__(self, edges: DataFrame):
        self.space = space = Workspace(edges.sparkSession)
        self.links = space.put(edges)
        nodes = self.links.select(F.col("child").alias("node")).union(self.links.select("parent")).distinct()
        self.cycles = space.put(cycles(self.links, space))
        self.members = space.put(nodes.join(self.cycles, "node", "left").select("node", F.coalesce("cycle", "node").alias("vertex"), F.col("cycle").isNotNull().alias("on_cycle")))
        to = self.members.select("node", "vertex")
        self.arcs = space.put(
            self.links.join(to.select(F.col("node").alias("child"), F.col("vertex").alias("c")), "child")
            .join(to.select(F.col("node").alias("parent"), F.col("vertex").alias("p")), "parent")
            .where("c <> p").select(F.col("c").alias("child"), F.col("p").alias("parent")).distinct()
        )
        peeled = peel(space, self.arcs)
        # vertices without arcs are leaves and roots at once
        vertices = self.members.select(F.col("vertex").alias("node")).distinct()
        self.levels = space.put(vertices.join(peeled, "node", "left").select(F.col("node").alias("vertex"), F.coalesce("level", F.lit(0)).alias("level")))
        self.top = self.levels.agg(F.max("level")).first()[0] or 0

    def vertex_descendants(self) -> DataFrame:
        """Distinct (vertex, descendant) over the acyclic graph, sent upwards in peel order.

        Lists travel as rows, so that a root over a third of all nodes is no single value. A vertex's list is complete
        when its level's turn comes; it is then sent to each parent and filed under the parent's level, one job a level.
        What was filed, each row once, is the result.
        """
        space = self.space
        arcs = (
            self.arcs.join(self.levels.select(F.col("vertex").alias("parent"), F.col("level").alias("to_level")), "parent")
            .join(self.levels.select(F.col("vertex").alias("child"), F.col("level").alias("at_level")), "child")
        )
        arcs = space.put(arcs.select("child", "parent", "to_level", "at_level"))
        first = arcs.select(F.col("parent").alias("vertex"), F.col("child").alias("descendant"), "to_level")
        up = arcs.select(F.col("child").alias("vertex"), F.col("parent").alias("up"), "to_level", "at_level")
        inbox, outgoing = space.folder(first, "to_level"), space.folder(up, "at_level")
        inbox.append(first)
        outgoing.append(up)
        for level in range(1, self.top):
            inbox.append(inbox.part(level).distinct().join(outgoing.part(level), "vertex").select(F.col("up").alias("vertex"), "descendant", "to_level"))
        return inbox.all().select("vertex", "descendant").distinct()

    def descendants(self) -> DataFrame:
        """(ancestor, descendant) of all names: what reaches the ancestor over one or more links.

        A node on a cycle is its own descendant.
        """
        m = self.members
        down = self.vertex_descendants()
        inner = self.cycles.select(F.col("cycle").alias("vertex"), F.col("cycle").alias("descendant")).distinct()
        pairs = down.unionByName(inner)
        return (
            pairs.join(m.select("vertex", F.col("node").alias("ancestor")), "vertex")
            .join(m.select(F.col("vertex").alias("descendant"), F.col("node").alias("below")), "descendant")
            .select("ancestor", F.col("below").alias("descendant"))
        )

    def paths(self) -> DataFrame:
        """node, root, depth, path (root first, `/` between), on_cycle, level of every node.

        A node has one path, though it may have several parents: through the parent of the highest level, the least
        name among equals; so the path is a longest one by levels. A cycle stands in a path by its least name, and
        its members share the path of the cycle. Nodes without parents are roots of depth 0.
        """
        space = self.space
        lv = self.levels
        ranked = (
            self.arcs.join(lv.withColumnRenamed("vertex", "parent"), "parent")
            .groupBy("child").agg(F.min_by("parent", F.struct(-F.col("level"), F.col("parent"))).alias("parent"))
        )
        placed = space.put(lv.join(ranked.withColumnRenamed("child", "vertex"), "vertex", "left").withColumn("jump", F.col("parent")).withColumn("root", F.col("vertex")).withColumn("path", F.col("vertex")).withColumn("depth", F.lit(0)))
        # reverse peel order over single parents, doubled: each round joins a path to the one of the vertex it ends at
        while not placed.where("jump is not null").isEmpty():
            up = placed.select(F.col("vertex").alias("jump"), F.col("jump").alias("j2"), F.col("root").alias("r2"), F.col("path").alias("p2"), F.col("depth").alias("d2"))
            now = space.put(
                placed.join(up, "jump", "left").select(
                    "vertex", "level", "parent", F.col("j2").alias("jump"), F.coalesce("r2", "root").alias("root"),
                    F.when(F.col("p2").isNull(), F.col("path")).otherwise(F.concat_ws("/", "p2", "path")).alias("path"),
                    F.when(F.col("p2").isNull(), F.col("depth")).otherwise(F.col("d2") + F.col("depth") + 1).alias("depth"),
                )
            )
            space.drop(placed)
            placed = now
        return self.members.join(placed, "vertex").select(
            "node", "root", "depth", "path", "on_cycle", "level"
        )

    def summary(self) -> DataFrame:
        """paths() with n_descendants (distinct names below; a node on a cycle counts itself)."""
        counted = self.descendants().groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
        return self.paths().join(counted, "node", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)).cast("long"))
