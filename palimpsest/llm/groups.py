"""Problem 6: related records share a split.

Records and what they have in common (pair and number in the id, source text, reference text) form a graph. Its
components are found by breadth-first search from many seeds at once: adjacency lists are hash-partitioned once, every node
whose hash is less than its neighbours' is a seed (so each component has one), all frontiers advance together, a node reached
from two seeds gives an edge of a small graph of seed labels, and the labels are merged there. Nodes with very many
neighbours are split before. Components are then dealt to the splits in hash order by prefix sums of their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import prefix_sums
from ..session import cut_lineage, materialize, shuffle_width
from .unicode_forms import caseless_skeleton

#: Most neighbours of a node: one with more is split into nodes of so many, linked to it.
MOST_EDGES = 10_000


def same_text_key(text: Column) -> Column:
    """Hash of a text in comparison form: case, spaces and look-alike characters do not matter. Null for null and blank.

    A struct of two independent 64-bit hashes ``(key, check)``; see :func:`apart`."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known: dict[str, str] = {}
            out = []
            for value in batch:
                if value is not None and value not in known:
                    known[value] = "".join((caseless_skeleton(value) or "").split())
                out.append(None if value is None else known[value])
            yield pd.Series(out, dtype=object, index=batch.index)

    folded = F.pandas_udf(run, "string")(text)
    return F.when(F.length(folded) > 0, F.struct(F.xxhash64(F.lit("text"), folded).alias("key"), F.xxhash64(F.lit("check"), folded).alias("check")))


def id_key(column: Column) -> Column:
    """Hash of the pair and number an id names, however it is written; null if it names none."""
    pattern = r"^[\s\p{Z}]*(\p{L}{2,3})[^\p{L}\d]+(\p{L}{2,3})[^\p{L}\d]*?0*(\d+)(?:\D|$)"
    low = F.lower(F.coalesce(column, F.lit("")))
    first, second, number = (F.regexp_extract(low, pattern, k) for k in (1, 2, 3))
    return F.when(number != "", F.xxhash64(F.lit("id"), first, second, number.cast("decimal(38,0)")))


def apart(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the ``(key, check)`` structs of ``columns`` as one number. Two texts whose keys collide (their checks
    differ) get numbers of their own, made of both hashes."""
    pairs = rows.select(F.explode(F.array(*columns)).alias("h")).where("h is not null").select("h.*")
    collided = pairs.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("key")
    collided = cut_lineage(collided)
    if collided.isEmpty():
        return rows.withColumns({c: F.col(c)["key"] for c in columns})
    for c in columns:
        known = collided.select(F.col("key").alias("_key"), F.lit(True).alias("_twice"))
        rows = rows.join(known, F.col(c)["key"] == F.col("_key"), "left")
        rows = rows.withColumn(c, F.when(F.col("_twice"), F.xxhash64(F.col(c)["key"], F.col(c)["check"])).otherwise(F.col(c)["key"])).drop("_key", "_twice")
    return rows


def split_hubs(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """``edges`` ``(a bigint, b bigint)`` where a node with more than ``most`` edges is replaced by nodes of so many, each with
    an edge to it. Components stay the same."""
    for side, other in (("b", "a"), ("a", "b")):
        todo, done = edges, None
        while True:
            sizes = todo.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
            hubs = cut_lineage(sizes.select(F.col(side).alias("_hub"), F.ceil(F.col("n") / most).alias("_parts")))
            if hubs.isEmpty():
                break
            cut = todo.join(hubs, F.col(side) == F.col("_hub"), "left").withColumn(
                "_part", F.when(F.col("_parts").isNotNull(), F.xxhash64(F.lit("hub"), F.lit(side), side, F.pmod(F.xxhash64(F.lit(1), other), "_parts")))
            )
            kept = cut.select(F.coalesce("_part", side).alias(side), other).select("a", "b")
            done = kept if done is None else done.unionByName(kept)
            todo = cut.where("_part is not null").select(F.col("_part").alias(other), F.col(side)).distinct().select("a", "b")
        edges = todo if done is None else done.unionByName(todo)
    return edges


def _merge_labels(pairs: DataFrame) -> DataFrame:
    """``(label, root)`` of the small graph of colliding labels: each label's root is the least of its component."""
    both = cut_lineage(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct())
    roots = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    while True:
        near = both.join(roots.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        stepped = roots.join(near, "a").select("a", "root", F.least("root", "near").alias("low"))
        # the root of the root: chains halve with every round
        jumped = stepped.join(roots.toDF("low", "far"), "low", "left").select("a", "root", F.least("low", F.coalesce("far", "low")).alias("next"))
        jumped = cut_lineage(jumped)
        roots = jumped.select("a", F.col("next").alias("root"))
        if jumped.where("next <> root").isEmpty():
            return roots.toDF("label", "root")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the undirected graph ``(a bigint, b bigint)``. Loops and repeated edges do no harm; a node with
    no edge but a loop is a component of its own. Nothing but row counts comes to the driver.

    An edge is looked at from both ends once each. A node reached from the frontier of step k is new or in the frontiers of
    steps k-1 and k, so only those two are compared with what is reached, however deep the search goes."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    lists = cut_lineage(both.repartition(shuffle_width(spark), "a").dropDuplicates(["a", "b"]))
    # the hash of a 64-bit number is one to one, so no two neighbours tie
    least = F.min(F.when(F.col("a") != F.col("b"), F.xxhash64("b")))
    seeds = lists.groupBy("a").agg(least.alias("least")).where(F.col("least").isNull() | (F.xxhash64("a") < F.col("least")))
    frontier = seeds.select(F.col("a").alias("node"), F.col("a").alias("label"))
    visited, before, collisions = [], None, None
    while True:
        frontier = cut_lineage(frontier) if before is None else frontier
        if frontier.isEmpty():
            break
        visited.append(frontier)
        reached = frontier.join(lists, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "label", F.lit(None).cast("bigint").alias("old"))
        known = frontier if before is None else frontier.unionByName(before)
        met = reached.unionByName(known.select("node", F.lit(None).cast("bigint").alias("label"), F.col("label").alias("old")))
        # as many labels as a node has neighbours at most
        step = cut_lineage(met.groupBy("node").agg(F.collect_set("label").alias("labels"), F.max("old").alias("old")).where(F.size("labels") > 0))
        # a node's label is the one it has, else the least that reached it; every other label there collides with it
        own = F.coalesce("old", F.array_min("labels"))
        pairs = step.select(own.alias("b"), F.explode("labels").alias("a")).where("a <> b").select("a", "b")
        collisions = pairs if collisions is None else collisions.unionByName(pairs)
        before, frontier = frontier, step.where("old is null").select("node", own.alias("label"))
    if collisions is None:
        return lists.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = reduce(DataFrame.unionByName, visited)
    return found.join(_merge_labels(collisions.distinct()), "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def related_rows(benchmark: DataFrame) -> DataFrame:
    """``(idx, split, root)``: each distinct row with its plain split (null, blank: null) and its component. A null id or
    text relates a row to nothing."""
    split = F.regexp_replace(F.lower(F.col("split")), r"[\s\p{Z}]+", "")
    rows = benchmark.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.when(split != "", split).alias("split"),
        id_key(F.col("id")).alias("by_id"),
        same_text_key(F.col("source")).alias("by_source"),
        same_text_key(F.col("reference")).alias("by_reference"),
    )
    rows = rows.withColumn("anchor", F.coalesce("by_id", F.xxhash64(F.lit("row"), "idx")))
    rows = materialize(apart(materialize(rows.distinct()), ["by_source", "by_reference"]))
    edges = rows.select(F.col("anchor").alias("a"), F.explode(F.array("by_source", "by_reference", "anchor")).alias("b")).where("b is not null").distinct()
    found = components(split_hubs(edges))
    return rows.join(found, rows["anchor"] == found["node"]).select("idx", "split", "root")


def broken_groups(benchmark: DataFrame) -> DataFrame:
    """``(idx)`` of all rows of each related group that has more than one split."""
    rows = materialize(related_rows(benchmark))
    mixed = rows.groupBy("root").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high").select("root")
    return rows.join(mixed, "root", "left_semi").select("idx").distinct()


def assign_splits(benchmark: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(idx, root, new_split)``: whole components dealt to the splits in hash order, so that the splits' rows come as near
    to ``shares`` as the largest component allows."""
    rows = materialize(related_rows(benchmark).select("idx", "root").distinct())
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(sizes, [], F.xxhash64("root", F.lit(11)), "n")
    total = sizes.agg(F.sum("n").alias("total"))
    middle = (F.col("before") + F.col("n") / 2) / F.col("total")
    names, edge, choice = list(shares), 0.0, None
    for name in names[:-1]:
        edge += shares[name] / sum(shares.values())
        choice = F.when(middle <= edge, name) if choice is None else choice.when(middle <= edge, name)
    choice = F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])
    dealt = placed.crossJoin(F.broadcast(total)).select("root", choice.alias("new_split"))  # one row of totals
    return rows.join(dealt, "root").select("idx", "root", "new_split")
