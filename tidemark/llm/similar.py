"""Near-duplicates by the Jaccard similarity of their sets of word shingles: SimHash groups, checked and completed.

Texts with equal sets are one node throughout. Each node has a SimHash fingerprint of its set; multi-index hashing
(simhash.py) groups those that differ in at most 2 bits, and the sets of a group are compared exactly. Nodes may be
similar and differ in more bits, so each has BANDS keys of ROWS MinHash minima besides; nodes that share a key may be
similar, and their sets are compared exactly too, so every link is right. A pair is overlooked only if it is in no
group and all its keys differ: a chance of (1 - similarity^ROWS)^BANDS, 4e-7 for a pair at exactly 0.8, less above.

Groups are not expanded into pairs. First each node is compared with the leader of its SimHash group, then with one
leader of each of its keys, three times with other leaders. A key's leader is done with then, and so are keys (a group
is one) whose other nodes are in one component. The nodes of other keys may be many and all alike, but for less than
the similarity that counts. They are compared only if they share a shingle among the rarest of both: the exact prefix
filter, which lets no similar pair go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from .common import maybe_broadcast, slices, small_batches, staged
from .components import components
from .simhash import BITS, SEED, keep_least, majority, named_groups, shingles
from .simhash import near_groups as simhash_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 4
#: Leaders that the nodes of a key are compared with, one after the other.
LEADERS = 3
#: Text bytes whose sets a worker holds together.
SLICE_BYTES = 1 << 20
#: Odd factors: each orders all hashes in another way.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    parts = list(shingles(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def name_of(found: np.ndarray) -> int:
    """A set's own hash, as a signed long."""
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A signed long for each band; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 512):
        least = np.minimum(least, (found[at : at + 512, None] * FACTORS).min(axis=0))
    return np.array([int.from_bytes(xxhash.xxh64_digest(band.tobytes(), b), "big", signed=True) for b, band in enumerate(least.reshape(BANDS, ROWS))], np.int64)


def set_fingerprint(found: np.ndarray) -> int:
    """A set's SimHash fingerprint, as a signed long."""
    return majority(found[at : at + (1 << 16)] for at in range(0, len(found), 1 << 16))


def _of_texts(docs: DataFrame, id_col: str, text_col: str, words: int, **values) -> DataFrame:
    """id, fp (the set's name), n (its size) and for every name=(type, function) a column of what function(set) gives."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    kinds = thin.select("id").schema.add("fp", "long").add("n", "long")
    for name, (kind, _) in values.items():
        kinds = kinds.add(name, kind)
    arrow = [to_arrow_type(f.dataType) for f in kinds.fields[1:]]
    makers = [name_of, len, *(made for _, made in values.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = [[make(found) for make in makers] for found in (shingle_set(t, words) for t in batch.column("text").to_pylist())]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "fp", "n", *values])

    return thin.mapInArrow(run, kinds)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets(fp, n, found) share at least `similarity` of their union."""
    first, second = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("found").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.distinct().join(first, "a").join(second, "b").filter(both / (F.col("na") + F.col("nb") - both) >= similarity).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with all those of nodes(fp, root) that have different roots and whose sets are similar.

    Shingles are put in one order, rarest first. A set of n that is similar to one of as many or more shares at
    least 2s / (1 + s) of its n, so one of its first n - 2s / (1 + s) n + 1 is the first that both have; the larger
    one shares s of its n. What is left after that place in both must still be enough.
    """
    held = sets.join(nodes, "fp").select("fp", "root", "n", F.explode("found").alias("token"))
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # A shingle of one node only takes its place in the order and meets nothing.
    order = [F.coalesce("often", F.lit(1)), "token"]
    place = F.row_number().over(Window.partitionBy("fp").orderBy(*order)) - 1
    placed = held.join(often, "token", "left").withColumn("place", place).filter("often is not null")
    most = lambda share: F.col("n") - F.ceil(share * F.col("n") - 1e-9)
    prefixes = staged(placed.filter(F.col("place") <= most(similarity)).select("token", "fp", "n", "root", "place"), "prefixes")
    fewer = prefixes.filter(F.col("place") <= most(2 * similarity / (1 + similarity)))
    larger, smaller = (side.select("token", F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}"), F.col("place").alias(f"p{c}")) for side, c in ((prefixes, "a"), (fewer, "b")))
    a_first = (F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = left + 1e-9 >= similarity / (1 + similarity) * (F.col("na") + F.col("nb"))
    met = larger.join(smaller, (larger.token == smaller.token) & (F.col("ra") != F.col("rb")) & a_first & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def shared_keys(keyed: DataFrame, name: str) -> DataFrame:
    """The rows of keyed(fp, n, key) whose key has more than one."""
    twice = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return staged(keyed.join(twice, "key").select("fp", "n", "key"), name)


def near_groups(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bits: int = BITS) -> DataFrame:
    """(fp, component) for every distinct fp of rows(id, fp, n, sim, keys); component is the least id reachable over links."""
    first = [F.first(c).alias(c) for c in ("n", "sim", "keys")]
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("least"), *first), "distinct")
    close = simhash_groups(distinct.select(F.col("least").alias("id"), F.col("sim").alias("fp")), bits).select(F.col("fp").alias("sim"), F.xxhash64("component").alias("key"))
    grouped = shared_keys(distinct.select("fp", "n", "sim").join(maybe_broadcast(close, 24), "sim").select("fp", "n", "key"), "close")
    shared = shared_keys(distinct.select("fp", "n", F.explode("keys").alias("key")), "shared")
    # No pair is similar if one set is smaller than `similarity` of the other.
    near = lambda a, b: F.least(a, b) / F.greatest(a, b) >= similarity
    asked = distinct.join(shared.select("fp").unionAll(grouped.select("fp")).distinct(), "fp", "left_semi").select("fp", "least")
    ids = staged(asked.select(F.col("least").alias("asked_id")).distinct(), "asked")
    texts = docs.select(id_col, text_col).join(maybe_broadcast(ids, 24), F.col(id_col).eqNullSafe(F.col("asked_id")), "left_semi")
    found = _of_texts(texts, id_col, text_col, words, found=(ArrayType(LongType()), lambda s: s.view(np.int64)))
    sets = staged(found.select("fp", "n", "found").dropDuplicates(["fp"]), "sets")
    links, roots, left = None, None, grouped
    # Within a key, a leader has been compared with all others then, and goes: small keys are soon done.
    for k in range(LEADERS + 2):
        if k == 1:
            # Keys whose nodes SimHash has linked by now are done.
            left = left.unionByName(shared)
        if roots is None:
            rest = left.withColumn("root", F.col("fp"))
        else:
            labelled = left.join(roots, left.fp == roots.node, "left").select("fp", "n", "key", F.coalesce("root", "fp").alias("root"))
            split = labelled.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key")
            rest = staged(labelled.join(split, "key"), "rest")
        if k > LEADERS:
            pairs = prefix_pairs(staged(rest.select("fp", "root").distinct(), "unlinked"), sets, similarity)
        else:
            # The first leaders are few nodes, so that most copies of one text meet at once.
            order = F.struct(F.xxhash64("fp") if k < 2 else F.xxhash64(F.lit(k), "key", "fp"), "fp")
            leader = F.min_by(F.struct("fp", "n", "root"), order)
            mine = staged(rest.groupBy("key").agg(leader.alias("m")).select("key", F.col("m.fp").alias("a"), F.col("m.n").alias("na"), F.col("m.root").alias("ra")), "leaders")
            other = rest.select("key", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
            pairs = mine.join(other, "key").filter((F.col("a") != F.col("b")) & (F.col("ra") != F.col("rb")) & near(F.col("na"), F.col("nb")))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            left = rest.drop("root").join(mine.select("key", F.col("a").alias("fp")), ["key", "fp"], "left_anti")
        new = staged(similar(pairs, sets, similarity), "links")
        links = new if links is None else links.unionAll(new)
        roots = components(links)
    return named_groups(distinct.select("fp", "least"), roots)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, fp (the set's name), n (its size), sim (its SimHash fingerprint) and keys (of MinHash) for every row."""
    return _of_texts(docs, id_col, text_col, words, sim=(LongType(), set_fingerprint), keys=(ArrayType(LongType()), band_keys))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, without the rows whose component has a row with a smaller id; repeated ids stay once.

    Rows are linked if the sets of their shingles of `words` words (ASCII case and white space aside) share at
    least `similarity` of their union. A text of fewer words is one shingle; texts without words, null ones
    too, are copies of each other. An empty table gives an empty result.
    """
    rows = staged(sketches(docs, id_col, text_col, words), "sketches")
    return keep_least(docs, rows, near_groups(docs, rows, id_col, text_col, words, similarity), id_col)
