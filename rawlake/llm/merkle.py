"""Merkle manifest of a table: a tree per group of rows, and one over the groups' roots.

Every level of a tree is a *slot pivot*: conditional aggregates spread the children of each
parent into ``fanout`` columns. The columns concatenated give the parent's digest; without a
child's own column they are that child's siblings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rawlake.llm.common import stage
from rawlake.session import attach

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["s", "i", "n", "digest"]
# Levels of a tree that one job makes.
TOGETHER = 4


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value as text, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's values: lower-case hex SHA-256 of their encodings, one after another."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``s`` (their group), ``i`` (place in it) and ``n`` (its rows).

    Groups, and rows in them, ascend by ``group`` and ``order``, null first and texts by
    their bytes; ``s`` ascends with the groups. Rows are sorted in ranges; each range counts
    its rows by group, and what earlier ranges hold of a group is added, so that a group of
    any size spans as many ranges as it needs. Rows that tie in ``order`` may change places.
    """
    held = rows.withColumn("__g", F.struct(*group) if group else F.struct(F.lit(0).alias("all")))
    held = held.repartitionByRange("__g", *order).sortWithinPartitions("__g", *order)
    held = stage(held.withColumn("__at", F.monotonically_increasing_id()))
    # the high bits of the number are the range
    held = held.withColumn("__range", F.shiftright("__at", 33))
    counts = stage(held.groupBy("__g", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")))
    # as many rows per group as ranges that hold it
    whole = W.partitionBy("__g")
    before = whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    marks = counts.select("__g", "__range", shift.alias("__shift"), F.min("__first").over(whole).alias("s"), F.sum("__n").over(whole).alias("n"))
    out = attach(held, marks, ["__g", "__range"], "inner").withColumn("i", F.col("__at") + F.col("__shift"))
    return out.drop("__g", "__range", "__at", "__shift")


@dataclass(frozen=True)
class Forest:
    """Trees of equal fanout, built from nodes (s, i, n, digest, payload): tree, place, leaves of the tree."""

    leaves: DataFrame
    #: Per level the parents (s, i, n, digest) with children ``c0``, ``c1``, ...; in the first also payloads ``p0``, ...
    levels: list[DataFrame]
    #: (s, digest, depth): the root of each tree and the number of levels above its leaves.
    tops: DataFrame
    fanout: int

    def paths(self, tops: DataFrame) -> DataFrame:
        """(payload, digest, path, above) of every leaf, from (s, depth, path, above) of the roots.

        A path has the left and right siblings of each level, from the leaf upwards. It goes
        down the tree: a parent's path is that of all its children but for their siblings.
        """
        below = None
        for depth in range(len(self.levels), 0, -1):
            level = self.levels[depth - 1]
            known = tops.where(F.col("depth") == depth).select("s", F.lit(0).cast("bigint").alias("i"), "path", "above")
            known = known if below is None else known.unionByName(below.select("s", "i", "path", "above"))
            below = self._children(level.drop("digest").join(known, ["s", "i"]), depth == 1)
        lone = self.leaves.where(F.col("n") == 1).join(tops.where(F.col("depth") == 0).select("s", "path", "above"), "s")
        lone = lone.select("payload", "digest", "path", "above")
        return lone if below is None else lone.unionByName(below.select(*lone.columns))

    def _children(self, parents: DataFrame, leaves: bool) -> DataFrame:
        columns = [f"c{k}" for k in range(self.fanout)]

        def child(k: int) -> Column:
            left, right = (F.concat_ws("", *c) if c else F.lit("") for c in (columns[:k], columns[k + 1 :]))
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
            payload = [F.col(f"p{k}").alias("payload")] if leaves else []
            return F.struct((F.col("i") * self.fanout + k).alias("i"), F.col(columns[k]).alias("digest"), path.alias("path"), *payload)

        return parents.select("s", "above", F.inline(F.array(*[child(k) for k in range(self.fanout)]))).where(F.col("digest").isNotNull())


def _parents(nodes: DataFrame, fanout: int, payload: bool) -> DataFrame:
    """The slot pivot of one level."""
    slot = F.pmod("i", F.lit(fanout))
    spread = [F.max(F.when(slot == k, F.col(c))).alias(f"{c[0]}{k}") for c in (["child", "payload"] if payload else ["child"]) for k in range(fanout)]
    keys = ["s", F.expr(f"i div {fanout}").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")]
    parents = nodes.where(F.col("n") > 1).withColumnRenamed("digest", "child").groupBy(*keys).agg(*spread)
    return parents.withColumn("digest", F.sha2(F.concat_ws("", *[f"c{k}" for k in range(fanout)]), 256))


def grown(leaves: DataFrame, fanout: int) -> Forest:
    """The trees above the leaves: one job for the first level, one for every ``TOGETHER`` above it."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = []
    if most > 1:
        levels.append(stage(_parents(leaves, fanout, True)))
        most = -(-most // fanout)
    while most > 1:
        nodes, some = levels[-1], []
        while most > 1 and len(some) < TOGETHER:
            nodes = _parents(nodes.select(*NODE), fanout, False)
            some.append(nodes.withColumn("level", F.lit(len(some))))
            most = -(-most // fanout)
        # a level's shuffle is written once and read by its own branch and the next
        held = stage(reduce(DataFrame.unionByName, some), "level")
        levels += [held.where(F.col("level") == k).drop("level") for k in range(len(some))]
    tops = [t.where(F.col("n") == 1).select("s", "digest", F.lit(k).alias("depth")) for k, t in enumerate([leaves, *levels])]
    return Forest(leaves, levels, stage(reduce(DataFrame.unionByName, tops)), fanout)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "source",
    order_col: str = "doc_id",
    fanout: int = 3,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """The Merkle leaf of every row with its way up to the root of the table.

    A row's ``leaf`` is the digest of its ``fields``, null as ``-``. Leaves of one group
    (null is one, before all others) ascend by ``order_col``, null first; rows that tie there
    ascend by leaf, so equal rows are leaves side by side. Every ``fanout`` neighbours become
    their digest until one is left, the group's ``subroot``; a lone leaf is its own. Subroots,
    ordered by the bytes of their group, likewise give ``root``.

    Returns ``order_col``, the columns of ``carry`` (computed where the texts lie), ``leaf``,
    ``subroot``, ``root`` and ``path``: left and right siblings of each level, the leaf's
    first; see :func:`folded` and :func:`sibling_digest`. Texts of any length are hashed whole
    and never move; an empty table has no rows. Other columns are not read.
    """
    carried = {order_col: F.col(order_col)} | (carry or {})
    payload = F.struct(*[c.alias(f"v{k}") for k, c in enumerate(carried.values())])
    leaf = leaf_digest(*[F.col(f) for f in fields])
    rows = stage(docs.select(F.col(group_col).alias("grp"), F.col(order_col).alias("place"), leaf.alias("digest"), payload.alias("payload")))
    leaves = numbered(rows, ["grp"], ["place", "digest"])
    trees = grown(leaves.select(*NODE, "payload"), fanout)

    subroots = trees.tops.select("digest", F.col("s").alias("of"), F.struct(F.col("s").alias("of")).alias("payload"))
    subroots = numbered(subroots, [], ["of"]).select(*NODE, "payload")
    upper = grown(subroots, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    crown = upper.tops.select("s", "depth", none.alias("path"), F.struct(F.col("digest").alias("root")).alias("above"))
    found = upper.paths(crown).select(F.col("payload.of").alias("s"), "path", F.struct(F.col("digest").alias("subroot"), "above.root").alias("above"))
    tops = stage(found.join(trees.tops.select("s", "depth"), "s"))
    out = trees.paths(tops)
    named = [F.col(f"payload.v{k}").alias(name) for k, name in enumerate(carried)]
    return out.select(*named, F.col("digest").alias("leaf"), "above.subroot", "above.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def sibling_digest(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)
