"""Digests of a replica's state, to tell whether replicas agree and to prove what a record holds.

Leaves are records' digests; a leaf's place is the SHA-256 of its key. The tree has 16 children to a node and
`depth` levels, as many as leave LEAVES records or fewer, on average, to a lowest node; those are combined in order
of key. Each level is one aggregation over 16 times fewer rows than the one below.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Replica
from .query import live_cells

LEAST_DEPTH, LEAVES = 2, 1024


def depth_for(replica: Replica) -> int:
    """The depth of a replica's tree; replicas that agree have as many records, so they have the same."""
    n = live_cells(replica).select("record_id").distinct().count()
    return max(LEAST_DEPTH, math.ceil(math.log(max(1, n / LEAVES), 16)))


def leaves(replica: Replica) -> DataFrame:
    """(record_id, place, leaf) of every live record; only fields count, never versions."""
    field = F.when(F.col("present"), F.struct("col_name", "value"))
    pairs = F.array_sort(F.collect_list(field))
    spelt = F.transform(pairs, lambda p: F.concat(F.length(p["col_name"]).cast("string"), F.lit(":"), p["col_name"], F.coalesce(F.concat(F.lit("="), F.length(p["value"]).cast("string"), F.lit(":"), p["value"]), F.lit("-"))))
    rows = live_cells(replica).groupBy("record_id").agg(F.array_join(spelt, ";").alias("body"))
    return rows.select("record_id", F.sha2("record_id", 256).alias("place"), F.sha2(F.concat("record_id", F.lit("|"), "body"), 256).alias("leaf"))


def levels(replica: Replica, depth: int | None = None) -> list[DataFrame]:
    """(place, hash) of the nodes, the lowest level first, the root last."""
    depth = depth or depth_for(replica)
    bottom = leaves(replica).groupBy(F.substring("place", 1, depth).alias("place"))
    nodes = [bottom.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "leaf"))), lambda x: x["leaf"]), ""), 256).alias("hash"))]
    for d in range(depth - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat(F.substring(x["place"], d + 1, 1), x["hash"])), "")  # noqa: B023
        up = F.substring("place", 1, d) if d else F.lit("")
        nodes.append(nodes[-1].select(up.alias("up"), "place", "hash").groupBy("up").agg(F.sha2(children, 256).alias("hash")).select(F.col("up").alias("place"), "hash"))
    return nodes


def root(replica: Replica, depth: int | None = None) -> DataFrame:
    """One row, the root hash; no row for an empty state."""
    return levels(replica, depth)[-1].select(F.col("hash").alias("root"))


def with_root(changes: DataFrame, replica: Replica, depth: int | None = None) -> DataFrame:
    """changes, each with the root hash of the state that it comes from (null for an empty state)."""
    found = root(replica, depth).first()
    return changes.withColumn("root", F.lit(found.root if found else None).cast("string"))


def prove(replica: Replica, record_id: str, depth: int | None = None) -> dict | None:
    """What verify() needs: the record's leaf, the leaves beside it and the nodes beside its ancestors."""
    depth = depth or depth_for(replica)
    place = hashlib.sha256(record_id.encode()).hexdigest()
    beside = [(r.record_id, r.leaf) for r in leaves(replica).filter(F.substring("place", 1, depth) == place[:depth]).orderBy("record_id").collect()]
    if record_id not in dict(beside):
        return None
    nodes = [[(r.place[-1], r.hash) for r in level.filter(F.substring("place", 1, depth - 1 - k) == place[: depth - 1 - k]).orderBy("place").collect()] for k, level in enumerate(levels(replica, depth)[:-1])]
    return {"record_id": record_id, "leaf": dict(beside)[record_id], "leaves": beside, "nodes": nodes}


def verify(root_hash: str, proof: dict) -> bool:
    """Whether a proof leads to the root."""
    place = hashlib.sha256(proof["record_id"].encode()).hexdigest()
    if dict(proof["leaves"]).get(proof["record_id"]) != proof["leaf"]:
        return False
    at = hashlib.sha256("".join(leaf for _, leaf in proof["leaves"]).encode()).hexdigest()
    depth = len(proof["nodes"])
    for k, siblings in enumerate(proof["nodes"]):
        if dict(siblings).get(place[depth - 1 - k]) != at:
            return False
        at = hashlib.sha256("".join(c + h for c, h in siblings).encode()).hexdigest()
    return at == root_hash
