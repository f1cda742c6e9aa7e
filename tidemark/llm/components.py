"""Connected components of a link table, by randomised contraction.

Every round hashes the labels anew, lets each node take the label with the least hash among itself and its
neighbours, and renames the ends of the links. A constant share of the nodes goes in every round, so the
tables shrink geometrically; no group is ever collected and no link reaches the driver. Each round's tables
are written to the shared folder. Once FEW links are left, one task does all rounds that remain: rounds over a few
thousand links, each cut into as many tasks as a shuffle has partitions, cost far more files and time than links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged

#: Links, each of them in both directions, that one task contracts to the end (4 MB).
FEW = 1 << 18
SEED = 42


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links (a, b), which are there in both directions, and a node of its component for each."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label, rng = np.arange(len(nodes)), np.random.default_rng(SEED)
    while len(a):
        rank = rng.permutation(len(nodes))
        least = rank.copy()
        np.minimum.at(least, a, rank[b])
        rep = np.argsort(rank)[least]
        label, a, b = rep[label], rep[a], rep[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held := list(batches):
        table = pa.Table.from_batches(held)
        nodes, reps = contracted(*(table.column(c).to_numpy() for c in "ab"))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(reps)], names=["node", "rep"])


def components(links: DataFrame) -> DataFrame:
    """links: long columns a, b. Returns (node, root): nodes of one component, and only they, share a root.

    Nodes without a link to another node are not returned; loops and repeated links change nothing.
    """
    both = links.filter("a <> b").select("a", "b")
    edges = staged(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while n := edges.count():
        if n <= FEW:
            rounds.append(staged(edges.coalesce(1).mapInArrow(_finish, "node long, rep long"), "reps"))
            break
        k = len(rounds)
        least = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        near = edges.groupBy(F.col("a").alias("node")).agg(F.min(least(F.col("b"))).alias("m"))
        reps = staged(near.select("node", F.least("m", least(F.col("node")))["v"].alias("rep")), "reps")
        rounds.append(reps)
        reps = maybe_broadcast(reps, 24)
        ra, rb = reps.select(F.col("node").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        moved = edges.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = staged(moved.distinct(), "edges")
    if not rounds:
        return links.sparkSession.createDataFrame([], "node long, root long")
    if len(rounds) == 1:
        return rounds[0].select("node", F.col("rep").alias("root"))
    roots = maybe_broadcast(rounds[-1], 24).select("node", F.col("rep").alias("root"))
    for reps in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("rep"), "root")
        roots = reps.join(later, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    return staged(roots, "roots")
