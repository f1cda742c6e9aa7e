"""SimHash near-duplicates, found by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most 2 bits, either
their first segments differ in at most 1 bit, or their second segments are equal. So each distinct fingerprint
asks the table of first segments for the 33 values of its Hamming ball of radius 1 and the table of second
segments for its own value, and the whole distance of what is found is verified. Copies of one fingerprint
are one row throughout; groups are never expanded into pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, shuffled, slices, small_batches, staged
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
SHINGLE, BITS = 3, 2


def shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the runs of `words` words, 65,536 at a time; of a shorter text, of all its words; none of no words."""
    found = WORD.findall((text or "").encode().translate(LOWER))
    if not found:
        return
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)), np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; zero for no words."""
    return majority(shingles(text, words))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes, as a signed long."""
    set_bits, n = np.zeros(64, np.int64), 0
    for h in parts:
        set_bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """docs' first column as `id` and the text's fingerprint as the signed long `fp`."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(docs.columns[0]).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    return thin.mapInArrow(run, thin.select("id").schema.add("fp", "long"))


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b), a < b, of the column fp's distinct values that differ in at most `bits` (0 to 2) bits."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with balls of radius 1 and 0 find distances up to 2")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    ball = F.array(high, *[high.bitwiseXOR(F.lit(1 << k)) for k in range(32)])
    asks = distinct.select(F.col("fp").alias("a"), F.explode(ball).alias("key"))
    table = distinct.select(F.col("fp").alias("b"), high.alias("key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    first = asks.join(shuffled(table), (asks.key == table.key) & close & (F.col("a") < F.col("b"))).select("a", "b")
    mine, other = distinct.select(F.col("fp").alias("a"), low.alias("key")), distinct.select(F.col("fp").alias("b"), low.alias("key"))
    # Pairs that the first table has already found are left out here.
    new = F.bit_count(F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), 32)) > 1
    second = mine.join(shuffled(other), (mine.key == other.key) & close & new & (F.col("a") < F.col("b"))).select("a", "b")
    return first.unionAll(second)


def near_groups(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component) for every distinct fp of rows(id, fp); component is the least id reachable over links."""
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    return named_groups(distinct, components(links(distinct, bits)))


def named_groups(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component) for distinct(fp, least) and the components (node, root) of the fps that have links."""
    named = distinct.join(maybe_broadcast(roots, 24), distinct.fp == roots.node, "left").select("fp", "least", "root")
    linked = named.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    met = linked.join(least, "root").select("fp", "component")
    return staged(named.filter("root is null").select("fp", F.col("least").alias("component")).unionAll(met), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """For every row: its id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Repeated rows and
    ids each get a row. A null id is the least only where its whole component has no other. Other columns are
    not looked at. An empty table gives an empty result.
    """
    rows = staged(fingerprints(docs.select(id_col, text_col), text_col, words), "fingerprints")
    groups = near_groups(rows, bits)
    return rows.join(maybe_broadcast(groups, 24), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs, all columns, without the rows whose component has a row with a smaller id; repeated ids stay once."""
    rows = staged(fingerprints(docs.select(id_col, text_col), text_col, words), "fingerprints")
    return keep_least(docs, rows, near_groups(rows, bits), id_col)


def keep_least(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows(id, fp) whose component in groups(fp, component) has a smaller id; repeated ids stay once."""
    judged = rows.join(maybe_broadcast(groups, 24), "fp")
    gone = staged(judged.filter(~F.col("id").eqNullSafe(F.col("component"))).select("id").distinct(), "gone")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    twice = staged(twice, "twice")
    left = docs.join(maybe_broadcast(gone, 24), F.col(id_col).eqNullSafe(gone.id), "left_anti")
    if twice.isEmpty():
        return left
    same = F.col(id_col).eqNullSafe(twice.id)
    return left.join(twice, same, "left_anti").unionAll(left.join(twice, same, "left_semi").dropDuplicates([id_col]))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
