"""Problem 6: what changed between consecutive full snapshots.

Keys are hashed into ``2**LEAF_BITS`` ranges per (group, run). Every range has an order-independent
128-bit digest and a row count; a node above hashes the digests of its children together with their places.
Consecutive runs are compared from the root down, and only rows inside leaves whose digests differ reach
the row diff.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hash ranges of the leaves, and of the nodes between leaves and root.
LEAF_BITS, NODE_BITS = 12, 6
_DIGEST = ("n", "d1", "d2")


def squeezed(c: Column) -> Column:
    """White space of any kind and amount becomes nothing between marks and one blank between words."""
    one = F.trim(F.regexp_replace(c, r"(?U)[\s​﻿]+", " "))
    return F.regexp_replace(one, r" ?([^\w ]) ?", "$1")


def _digest(cols: Sequence[Column]) -> list[Column]:
    """Two independent hashes that tell null from any value."""
    marked = [x for c in cols for x in (c, c.isNull())]
    return [F.xxhash64(*marked).alias("d1"), F.xxhash64(F.lit(0x5BD1E995), *reversed(marked)).alias("d2")]


def _parent(children: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Digests of nodes from those of their children and the children's places."""
    of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), place, *_DIGEST))
    return children.groupBy(*keys).agg(F.sum("n").alias("n"), of(1).alias("d1"), of(2).alias("d2"))


def row_digests(df: DataFrame, group: str, run: str, key: str, version: str, payload: Sequence[Column]) -> DataFrame:
    """``(group, leaf, run, key, d1, d2)``: the digest of the row of the greatest version of every key.

    Rows with a null group, run, key or version are left out; rows of one version that differ count by the
    greater of each hash, whatever their order. Payloads are hashed before the only exchange of rows, so that
    it carries fixed widths and the key. Hash ranges, not keys or groups, are its unit of distribution: a
    group with a third of all rows spreads over ``2**LEAF_BITS`` of them. Aggregates over fixed widths need
    no sort.
    """
    leaf = F.shiftrightunsigned(F.xxhash64(key), 64 - LEAF_BITS).cast("int").alias("leaf")
    kept = df.where(F.col(group).isNotNull() & F.col(run).isNotNull() & F.col(key).isNotNull() & F.col(version).isNotNull())
    kept = kept.select(group, leaf, run, key, F.col(version).alias("_version"), *_digest([F.col(key), *payload])).repartition(group, "leaf")
    same = kept.groupBy(group, "leaf", run, key, "_version").agg(F.max("d1").alias("d1"), F.max("d2").alias("d2"))
    newest = lambda c: F.max_by(c, "_version").alias(c)
    return same.groupBy(group, "leaf", run, key).agg(newest("d1"), newest("d2"))


def _pairs(touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``touched`` as one list of pairs of runs a place; a list is no longer than the group has runs."""
    return touched.groupBy(*keys).agg(F.collect_list(F.struct("pair", "base")).alias("pairs"))


def _sides(at: DataFrame, pairs: DataFrame, on: Sequence[str], run: str) -> DataFrame:
    """Every row once for each touched pair of runs it belongs to; ``now`` tells the later run's side."""
    mine = F.filter("pairs", lambda p: (p["pair"] == F.col(run)) | (p["base"] == F.col(run)))
    sides = F.transform(mine, lambda p: F.struct(p["pair"], p["base"], (p["pair"] == F.col(run)).alias("now")))
    return at.join(pairs, list(on)).select(*at.columns, F.explode(sides).alias("_p")).select(*at.columns, "_p.*")


def _side(c: str, now: bool) -> Column:
    return F.max(F.when(F.col("now") == now, F.col(c))).alias(f"{c}_{'now' if now else 'base'}")


def _differing(nodes: DataFrame, pairs: DataFrame, on: Sequence[str], place: Sequence[str], run: str) -> DataFrame:
    """Nodes under touched ones whose digests differ between the two runs of a pair."""
    folded = _sides(nodes, pairs, on, run).groupBy(*place, "pair", "base").agg(*[_side(c, now) for c in _DIGEST for now in (True, False)])
    differs = reduce(lambda a, b: a | b, [~F.col(f"{c}_now").eqNullSafe(F.col(f"{c}_base")) for c in _DIGEST])
    return folded.where(differs).select(*place, "pair", "base")


def snapshot_diff(
    snapshots: DataFrame,
    *,
    group: str = "projectId",
    run: str = "runNumber",
    key: str = "stableKey",
    version: str = "rowId",
    payload: Sequence[str] = ("name", "type", "startLine", "endLine", "signature"),
    squeeze: Sequence[str] = ("signature",),
) -> DataFrame:
    """``(group, run, key, change)`` for every key that differs from the run before.

    ``run`` is the later of two consecutive runs that have rows. Null equals null; columns in
    ``squeeze`` are compared without regard to white space. A group with one run, and an empty table,
    give no rows; other columns of the input are never read.

    Rows are exchanged once, by (group, leaf): leaf digests, the comparison of leaves and the row diff all
    run inside that partitioning, and leaf digests are exchanged once, by (group, node).
    """
    compared = [squeezed(F.col(c)) if c in squeeze else F.col(c) for c in payload]
    rows = row_digests(snapshots, group, run, key, version, compared)

    leaves = rows.groupBy(group, "leaf", run).agg(F.count("*").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    leaves = leaves.withColumn("node", F.shiftright("leaf", LEAF_BITS - NODE_BITS)).repartition(group, "node")
    nodes = _parent(leaves, [group, "node", run], "leaf")
    roots = _parent(nodes, [group, run], "node")

    # top-down: a pair of runs goes on only into ranges whose digests differ
    by_run = W.partitionBy(group).orderBy(run)
    differs = reduce(lambda a, b: a | b, [F.col(c) != F.lag(c).over(by_run) for c in _DIGEST])
    roots = roots.select(group, F.col(run).alias("pair"), F.lag(run).over(by_run).alias("base"), differs.alias("differs")).where("differs")
    touched = _differing(nodes, _pairs(roots, [group]), [group], [group, "node"], run)
    touched = _differing(leaves, _pairs(touched, [group, "node"]), [group, "node"], [group, "node", "leaf"], run)

    sides = _sides(rows, _pairs(touched, [group, "leaf"]), [group, "leaf"], run)
    diff = sides.groupBy(group, "leaf", key, "pair").agg(*[_side(c, now) for c in ("d1", "d2") for now in (True, False)])
    changed = (F.col("d1_now") != F.col("d1_base")) | (F.col("d2_now") != F.col("d2_base"))
    change = F.when(F.col("d1_base").isNull(), "added").when(F.col("d1_now").isNull(), "removed").when(changed, "changed")
    return diff.select(group, F.col("pair").alias(run), key, change.alias("change")).where(F.col("change").isNotNull())
