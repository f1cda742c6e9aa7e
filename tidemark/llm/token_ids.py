"""Token ids in a compact binary form.

A written set of ids is a folder with two Parquet tables. `codebook` has one row: the code lengths of all ids.
`blocks` has independent blocks of whole documents in ascending id order: (part, block, n_ids, doc_ids, doc_ns,
bits, marks). `bits` are the block's ids in a canonical length-limited Huffman code made from the counts over
the whole table, `marks` the bit offsets of every 256th id, so decoding can begin at any of them.
"""

import json as jsons
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import huffman
from .common import coded_words, maybe_broadcast, new_path, ragged, slices, small_batches, staged

END_ID = 1
#: Ids after which a block ends with its document.
BLOCK_IDS = 1 << 17
#: Ids that are decoded side by side.
DECODE_IDS = 1 << 20
#: Distinct words that a worker remembers; then it forgets half.
MOST_WORDS = 600_000
#: Text bytes encoded together: of more text, more words are met again.
SLICE_BYTES = 6 << 20
#: Words of letters, then marks, whose ids are those of the letters followed by those of the marks: no
#: apostrophes, which begin words of their own, and only letters whose lower case is one letter.
SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!#$%&()*+,./:;=?@|\[\]{}~_^-]*)$"
END_OF_WORD = "</w>"
#: What a tokenizer must do for its ids to be those of words, and of the pieces of SIMPLE words.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_words(json: str) -> bool:
    """Whether a tokenizer drops white space, cuts at it, and ends words with END_OF_WORD, as the shortcuts need."""
    found = jsons.loads(json)
    return all(found.get(k) == v for k, v in BY_WORDS.items()) and found["model"].get("end_of_word_suffix") == END_OF_WORD


class Encoder:
    """Encodes texts as a tokenizer does without special tokens.

    Where the tokenizer works by_words(), words that were met before are looked up; any other encodes whole texts.
    """

    def __init__(self, json: str):
        self.tokenizer = Tokenizer.from_str(json)
        self.by_words = by_words(json)
        self.known: dict[str, bytes] = {}  # little-endian 32-bit ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Adds the ids of simple pieces, each of which is one word to the tokenizer."""
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self.known.update({w: raw[b:e] for w, b, e in zip(some, [0, *cuts], cuts, strict=False)})
            else:
                self.known.update(zip(some, self.each(some), strict=True))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > MOST_WORDS:
            for w in list(known)[: MOST_WORDS // 2]:
                del known[w]
        known[""] = b""
        self.learn([p for p in pieces if p not in known])
        return list(map(known.__getitem__, pieces))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every one of distinct words, and all ids one after the other."""
        cut = pc.extract_regex(words, SIMPLE)
        odd = np.flatnonzero(pc.is_null(cut).to_numpy(zero_copy_only=False))
        letters = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(cut, "letters")))
        marks = pc.dictionary_encode(pc.struct_field(cut, "marks"))
        ids = self.pieces(letters.dictionary.to_numpy(zero_copy_only=False).tolist())
        first = pc.fill_null(letters.indices, 0).to_numpy().astype(np.int64)
        second = pc.fill_null(marks.indices, 0).to_numpy() + len(ids)
        ids += self.pieces(marks.dictionary.to_numpy(zero_copy_only=False).tolist())
        # An odd word is a piece by itself, followed by the empty one.
        first[odd] = len(ids) + np.arange(len(odd))
        second[odd] = len(ids) + len(odd)
        ids += [*self.each(words.take(pa.array(odd)).to_pylist()), b""]
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        both = np.stack((first, second), axis=1)
        flat = np.frombuffer(b"".join(ids), "<u4")[ragged((np.cumsum(lens) - lens)[both.ravel()], lens[both.ravel()])]
        return lens[both].sum(axis=1), flat

    def texts(self, text: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every text, and all ids one after the other."""
        if not self.by_words:
            whole = self.each([t or "" for t in text.to_pylist()])
            ns, got = np.fromiter(map(len, whole), np.int64, len(whole)) >> 2, np.frombuffer(b"".join(whole), "<u4")
            return self.ended(ns, got, end_id)
        bounds, index, distinct = coded_words(text)
        lens, flat = self.words(distinct)
        each = lens[index]
        ends = np.concatenate(([0], np.cumsum(each)))[bounds]
        ns = np.diff(ends)
        return self.ended(ns, flat[ragged((np.cumsum(lens) - lens)[index], each)], end_id)

    def ended(self, ns: np.ndarray, got: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """With the end id after every text's ids."""
        if end_id is None:
            return ns, got
        out = np.empty(len(got) + len(ns), np.uint32)
        last = np.cumsum(ns + 1) - 1
        out[last] = end_id
        keep = np.ones(len(out), bool)
        keep[last] = False
        out[keep] = got
        return ns + 1, out


_encoders: dict[int, Encoder] = {}


def encoder(json: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    key = zlib.crc32(json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(json)
    return _encoders[key]


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, path: str | None = None) -> str:
    """Encodes every text and writes the ids below path, which is returned.

    Null and empty texts have the end id only. Rows that repeat an id follow each other in the order of their
    texts; a null id comes first. A document's ids stay in one block, however long. Any tokenizer of the
    tokenizers library will do; only one that works by_words() is fast. Other columns are not looked at. An
    empty table gives an empty set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "ids")
    with open(tokenizer_path, encoding="utf-8") as f:
        json = spark.sparkContext.broadcast(f.read())
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = thin.repartitionByRange("id").sortWithinPartitions("id", "text")

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of plain 32-bit ids."""
        part, block, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in chain(slices(batches, "text", SLICE_BYTES), [None]):
            if batch is not None:
                ns, ids = encoder(json.value).texts(batch.column("text"), end_id)
                ends = np.cumsum(ns)
                a = at = 0
                # Texts before any id are in block -1; no block is -2.
                for b in np.flatnonzero(np.diff((n + ends - 1) // BLOCK_IDS, append=-2)) + 1:
                    e = int(ends[b - 1])
                    held.append((batch.column("id").slice(a, b - a), ns[a:b], ids[at:e]))
                    n += e - at
                    a, at = int(b), e
                    if b == len(ns) and n < BLOCK_IDS:
                        break
                    if n >= BLOCK_IDS:
                        yield joined(part, block, held)
                        block, held, n = block + 1, [], 0
            elif held:
                yield joined(part, block, held)

    def joined(part: int, block: int, held: list) -> pa.RecordBatch:
        doc_ids, ns, ids = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        small = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
        return pa.RecordBatch.from_pydict(
            {"part": [part], "block": [block], "n_ids": [len(ids)], "doc_ids": pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), "doc_ns": pa.array([ns], pa.list_(pa.int64())), "wide": [small.itemsize == 4], "ids": [small.tobytes()]}
        )

    plain = staged(ordered.mapInArrow(to_ids, "part long, block long, n_ids long, doc_ids array<long>, doc_ns array<long>, wide boolean, ids binary"), "plain-ids", compression="zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for wide, ids in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
                found = np.bincount(np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(which, pa.int64()), "n": pa.array(total[which], pa.int64())})

    # At most one row for each entry of the vocabulary reaches the driver.
    counted = plain.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(counted.column("id").to_pylist(), default=0) + 1, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    table = spark.sparkContext.broadcast((lengths, huffman.canonical_codes(lengths)))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<u4" if batch.column("wide")[i].as_py() else "<u2")
                bits, marks = huffman.encode(ids, *table.value)
                out = {k: batch.column(k).slice(i, 1) for k in ("part", "block", "n_ids", "doc_ids", "doc_ns")}
                yield pa.RecordBatch.from_pydict(out | {"bits": [bits], "marks": [marks.astype("<u8").tobytes()]})

    blocks = plain.mapInArrow(compress, "part long, block long, n_ids long, doc_ids array<long>, doc_ns array<long>, bits binary, marks binary")
    blocks.write.parquet(f"{path}/blocks", compression="zstd")
    return path


def _read(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    """A row for each document of a written set; make(ids, ends) gives its columns after doc_id, start, n_tokens."""
    lengths = spark.read.parquet(f"{path}/codebook").first().lengths
    sent = spark.sparkContext.broadcast(bytes(lengths))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = staged(blocks.select("part", "block", "n_ids"), "sizes")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    starts = sizes.withColumn("in_part", before(Window.partitionBy("part").orderBy("block"))).join(parts, "part")
    starts = staged(starts.select("part", "block", (F.col("base") + F.col("in_part")).alias("start")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.Decoder.of(np.frombuffer(sent.value, np.uint8))
        for batch in batches:
            ns = batch.column("n_ids").to_numpy()
            group = (np.cumsum(ns) - ns) // DECODE_IDS
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(int(a), int(b - a))
                blocks = [(p.as_py(), np.frombuffer(m.as_buffer(), "<u8"), n.as_py()) for p, m, n in zip(part.column("bits"), part.column("marks"), part.column("n_ids"), strict=True)]
                ids = decoder.decode(blocks)
                doc_ns = part.column("doc_ns").flatten().to_numpy()
                ends = np.cumsum(doc_ns)
                heads = np.repeat(part.column("start").to_numpy() - (np.cumsum(ns[a:b]) - ns[a:b]), np.diff(part.column("doc_ns").offsets.to_numpy()))
                made = make(ids, ends)
                yield pa.RecordBatch.from_arrays([part.column("doc_ids").flatten(), pa.array(heads + ends - doc_ns), pa.array(doc_ns), *made.values()], names=["doc_id", "start", "n_tokens", *made])

    met = blocks.join(maybe_broadcast(starts, 32), ["part", "block"]).select("n_ids", "doc_ids", "doc_ns", "bits", "marks", "start")
    return met.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a written set; start counts the ids before it."""
    return _read(spark, path, "ids array<long>", lambda ids, ends: {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int64)))})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with ids_crc32, the unsigned CRC-32 of the ids as little-endian 32-bit integers, in place of ids."""

    def crcs(ids: np.ndarray, ends: np.ndarray) -> dict:
        raw = memoryview(ids.astype("<u4").tobytes())
        return {"ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.int64())}

    return _read(spark, path, "ids_crc32 long", crcs)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(spark, write_ids(docs, public_tokenizers.path("word_bpe_49k.json")))
