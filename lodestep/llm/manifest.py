"""Merkle manifest of a table: a digest for every row, roots, and a proof for each row. DataFrame functions only.

Rows are leaves. Within a group (a language) they stand in order; runs of ``FAN`` neighbours are
hashed into parents until one node, the subroot, is left. The subroots, in the order of their groups,
likewise give the root. A proof lists the siblings on the way up, level by level; whoever has a row, its
proof and the root can fold them and so find out whether the row is what was listed.

Proofs are made by pointer jumping. Each inner node holds the segment of siblings towards an ancestor,
its parent at first. A self-join on the ancestor brings the segment that the ancestor itself
holds: the two are concatenated and the distance is doubled. So a tree of depth d takes log2(d) joins. Nobody
points to a leaf, so leaves take part in the last join only, with the parents that have reached the root.

Far ancestors are shared by millions of nodes. They are therefore copied once for each ``CHUNK`` leaves that they
cover, and nodes are joined to the copy of their own chunk: a key holds at most a chunk's nodes, and
there are CHUNK times fewer copies than leaves on each level.

Defined results: null fields are written ``-``. Rows with a null order column come first in
their group, a null group first of all; rows that are equal in group and order stand by their digests (rows that
repeat each other are leaves of their own, and interchangeable). An empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import in_order
from .common import P, quoted, written

FAN, CHUNK = 8, 4_096
#: What the subroots are numbered by: the tree above them. Groups have numbers from 0.
TOP = -1
_STEPS = "array<struct<before:binary,after:binary>>"


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its length before it, as 32 bytes."""
    one = lambda s: F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.unhex(F.sha2(F.concat(*(one(f.cast("string")) for f in fields)).cast("binary"), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _joined(digests: Column) -> Column:
    """Several digests as one binary: their hexadecimal text is the concatenation of theirs."""
    return F.unhex(F.array_join(F.transform(digests, _hex), ""))


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """The parents of nodes (tree, pos, size, node, first, last): one for each run, with its ``kids`` in order."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "node", "first", "last")))
    per = nodes.groupBy("tree", F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size")).agg(kids.alias("kids"))
    made = F.aggregate("kids", F.lit(""), lambda text, kid: F.concat(text, _hex(kid["node"])))
    return per.select("tree", F.lit(level).alias("level"), "pos", "size", _hash(made).alias("node"), F.col("kids")[0]["first"].alias("first"), F.element_at("kids", -1)["last"].alias("last"), "kids")


class Tree:
    """The inner nodes over ordered leaves.

    ``leaves`` has group, order, leaf and what is carried along, numbered by ``tree`` (its group) and
    ``pos``; ``groups`` has a row for each group with its subroot; ``runs`` the inner nodes by level.
    """

    def __init__(self, leaves: DataFrame, group: str, order: str):
        self.group = group
        placed = written(in_order(leaves, [group, order, P + "leaf"], P + "place"), "leaves")
        sizes = placed.groupBy(group).agg(F.count("*").alias("size"), F.min(P + "place").alias("first"))
        groups = written(in_order(sizes, ["first"], "tree"), "groups")
        largest, trees = groups.agg(F.max("size"), F.count("*")).first()
        named = groups.select(F.col(group).alias(P + "of"), "tree", F.col("size"), "first")
        self.leaves = placed.join(named, F.col(group).eqNullSafe(F.col(P + "of"))).drop(P + "of").withColumn("pos", F.col(P + "place") - F.col("first")).drop("first")
        below = self.leaves.select("tree", "pos", "size", F.col(P + "leaf").alias("node"), F.col(P + "place").alias("first"), F.col(P + "place").alias("last"))
        self.of_groups = self._grown(below, largest or 0)
        alone = below.where("size = 1").select("tree", "node", "first", "last")
        tops = alone.unionByName(self._all(self.of_groups).where("size = 1").select("tree", "node", "first", "last"))
        self.groups = written(tops.select("tree", F.col("node").alias("subroot"), "first", "last"), "subroots")
        roots = self.groups.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("bigint").alias("size"), F.col("subroot").alias("node"), "first", "last")
        self.of_tops = self._grown(roots, trees)
        self.root_level = len(self.of_tops)
        root = self.of_tops[-1].select("node").first() if self.of_tops else self.groups.select("subroot").first()
        self.root: bytes | None = bytes(root[0]) if root else None
        self.depth = max(1, len(self.of_groups) + self.root_level)

    def _grown(self, nodes: DataFrame, largest: int) -> list[DataFrame]:
        levels: list[DataFrame] = []
        while largest > 1:
            runs = written(_runs(nodes.where("size > 1"), len(levels) + 1), "runs")
            levels.append(runs)
            nodes, largest = runs.select("tree", "pos", "size", "node", "first", "last"), -(-largest // FAN)
        return levels

    def _all(self, levels: list[DataFrame]) -> DataFrame:
        some = self.leaves.select("tree", F.lit(0).alias("level"), "pos", "size", F.col(P + "leaf").alias("node"), F.col("pos").alias("first"), F.col("pos").alias("last"), F.lit(None).cast("array<struct<pos:bigint,node:binary,first:bigint,last:bigint>>").alias("kids")).limit(0)
        for level in levels:
            some = some.unionByName(level)
        return some

    def links(self) -> DataFrame:
        """(tree, level, pos, first, last, to_tree, to_level, to_pos, steps): each inner node with its parent and its siblings.

        A group's subroot is a node of the top tree: it goes by that name.
        """
        runs = self._all(self.of_groups).unionByName(self._all(self.of_tops))
        sub = (F.col("size") == 1) & (F.col("tree") >= 0)
        to = [F.when(sub, TOP).otherwise(F.col("tree")).cast("bigint").alias("to_tree"), F.when(sub, 0).otherwise(F.col("level")).cast("int").alias("to_level"), F.when(sub, F.col("tree")).otherwise(F.col("pos")).alias("to_pos")]
        kids = runs.where((F.col("level") > 1) | (F.col("tree") == TOP)).select("tree", (F.col("level") - 1).cast("int").alias("level"), *to, "kids", F.posexplode("kids").alias("at", "kid"))
        return kids.select("tree", "level", F.col("kid.pos").alias("pos"), F.col("kid.first").alias("first"), F.col("kid.last").alias("last"), "to_tree", "to_level", "to_pos", F.array(_siblings(F.col("at"))).alias("steps"))

    def jumped(self) -> DataFrame:
        """The links of inner nodes after they have all reached the root."""
        chunk = lambda c: F.expr(f"{c} div {CHUNK}")
        state, distance = written(self.links(), "links"), 1
        there = (F.col("to_tree") == TOP) & (F.col("to_level") == self.root_level)
        while distance < self.depth:
            far = state.where(~there).withColumn("chunk", chunk("first"))
            helper = state.select(
                F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("pos").alias("to_pos"), F.explode(F.sequence(chunk("first"), chunk("last"))).alias("chunk"),
                F.col("to_tree").alias("next_tree"), F.col("to_level").alias("next_level"), F.col("to_pos").alias("next_pos"), F.col("steps").alias("more"),
            )
            further = far.join(helper, ["to_tree", "to_level", "to_pos", "chunk"])
            moved = further.select("tree", "level", "pos", "first", "last", F.col("next_tree").alias("to_tree"), F.col("next_level").alias("to_level"), F.col("next_pos").alias("to_pos"), F.concat("steps", "more").alias("steps"))
            state, distance = written(state.where(there).unionByName(moved), "links"), 2 * distance
        return state

    def proofs(self) -> DataFrame:
        """The leaves with ``steps``, their siblings before and after them on each level up to the root, and ``subroot``."""
        up = self.jumped().select("tree", "level", "pos", "steps")
        none = F.array().cast(_STEPS)
        first = self.of_groups[0].select("tree", "pos", "size", "kids") if self.of_groups else self._all([]).select("tree", "pos", "size", "kids")
        # a leaf's next node: its run, or itself where its group has no other
        own = first.select("tree", "pos", "kids", F.when(F.col("size") == 1, TOP).otherwise(F.col("tree")).cast("bigint").alias("u"), F.when(F.col("size") == 1, 0).otherwise(1).alias("v"), F.when(F.col("size") == 1, F.col("tree")).otherwise(F.col("pos")).alias("w"))
        alone = self.leaves.where("size = 1").select("tree", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast(first.schema["kids"].dataType).alias("kids"), F.lit(TOP).cast("bigint").alias("u"), F.lit(0).alias("v"), F.col("tree").alias("w"))
        named = up.select(F.col("tree").alias("u"), F.col("level").alias("v"), F.col("pos").alias("w"), "steps")
        parents = own.unionByName(alone).join(named, ["u", "v", "w"], "left").select("tree", F.col("pos").alias("run"), "kids", F.coalesce("steps", none).alias("steps"))
        joined = self.leaves.withColumn("run", F.expr(f"pos div {FAN}")).join(parents, ["tree", "run"])
        steps = F.when(F.col("kids").isNull(), F.col("steps")).otherwise(F.concat(F.array(_siblings(F.col("pos") % FAN)), F.col("steps")))
        return joined.withColumn("steps", steps).drop("kids", "run").join(self.groups.select("tree", "subroot"), "tree")


def _siblings(at: Column) -> Column:
    """What stands before and after place ``at`` of ``kids``."""
    of = lambda keep: _joined(F.transform(F.filter("kids", keep), lambda kid: kid["node"]))
    return F.struct(of(lambda kid, i: i < at).alias("before"), of(lambda kid, i: i > at).alias("after"))


def proof_text(steps: Column) -> Column:
    """All siblings of a proof as hexadecimal text, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: _hex(F.concat(s["before"], s["after"]))), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give, as bytes."""
    return F.aggregate(steps, leaf, lambda node, s: _hash(F.concat(_hex(s["before"]), _hex(node), _hex(s["after"]))))


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, steps, and the columns of ``carry``) for each row of ``docs``; digests are bytes."""
    carry = carry or {}
    rows = docs.select(F.col(quoted(group)).alias(P + "group"), F.col(quoted(order)).alias(P + "order"), digest(*(F.col(quoted(f)) for f in fields)).alias(P + "leaf"), *(c.alias(f"{P}c{i}") for i, c in enumerate(carry.values())))
    tree = Tree(written(rows, "digests"), P + "group", P + "order")
    root = F.lit(tree.root) if tree.root else F.lit(None).cast("binary")
    return tree.proofs().select(F.col(P + "order").alias(order), F.col(P + "leaf").alias("leaf"), "subroot", root.alias("root"), "steps", *(F.col(f"{P}c{i}").alias(name) for i, name in enumerate(carry)))


def tampered(docs: DataFrame, text: Column, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> Column:
    """The digest of a row with another text in the field ``text``."""
    return digest(*(text if f == "text" else F.col(quoted(f)) for f in fields))
