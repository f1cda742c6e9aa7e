"""Language identification: words first, then shorter and shorter character n-grams.

A word that the training texts hold is scored by its log-frequency in each language. Any other word is scored
by the mean over its n-grams of 5 characters, those that training doesn't hold by their n-grams of 4, and so on
to single characters; a character that no language has says nothing.

What is learnt is kept sparsely: for each word and n-gram only the languages that have it, and how much more
than an unseen entry it says for them. So the model grows with what the labelled rows hold, not with that times
the number of languages, and nothing rare is left out.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, ragged, slices, small_batches, split_words, spread

#: The model is fitted to about this many labelled rows of each language at most, those whose ids have the least
#: hashes; to all of a language that has fewer.
SAMPLE_ROWS = 1500
LONGEST = 5
#: Words are level 0; level k has the n-grams of LONGEST + 1 - k characters.
LEVELS = LONGEST + 1
SMOOTHING = 0.5
UNKNOWN = "und"
HELD_OUT_MOD, HELD_OUT_REST = 4, 2
LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
LETTERS_OR_END = regex.compile(rf"\n|{LETTERS.pattern}")
#: Text bytes that are scored together, and (row, language) cells.
SLICE_BYTES, MOST_CELLS = 2 << 20, 1 << 22


def words_of(piece: str) -> list[str]:
    """The lower-cased runs of letters of what stands between white space."""
    return LETTERS.findall(piece.lower())


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between two spaces, or that whole where it is shorter; of the word, for n = 1."""
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def keys_of(level: int, entries: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, entries, repeat(level)), np.uint64, len(entries))


@dataclass
class Model:
    """Languages, most labelled rows first. The i-th of the sorted keys has gains[starts[i]:starts[i + 1]] in the
    languages of the same places; base[level] is what an unseen entry of that level says for each language."""

    langs: list[str]
    priors: np.ndarray
    base: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    gains: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What each piece says: (the number of its parts, their languages, their gains), one after the other, how
        much of it was found at each level, and its number of words."""
        # No piece has a line end, so all are searched at once.
        found = LETTERS_OR_END.findall("\n".join(pieces).lower())
        ends = np.fromiter(map("\n".__eq__, found), bool, len(found))
        owner = np.cumsum(ends)[~ends]
        entries = [w for w in found if w != "\n"]
        words = np.bincount(owner, minlength=len(pieces))
        weight = np.ones(len(entries))
        depth = np.zeros((len(pieces), LEVELS))
        whose, place, how_much = [], [], []
        for level in range(LEVELS):
            n = LEVELS - level
            if level == 1:
                split = [grams_of(w, n) for w in entries]
            elif level:
                split = [[e[i : i + n] for i in range(max(1, len(e) - n + 1))] for e in entries]
            if level:
                lens = np.fromiter(map(len, split), np.int64, len(split))
                entries, owner, weight = [e for es in split for e in es], np.repeat(owner, lens), np.repeat(weight / np.maximum(lens, 1), lens)
            at = self.find(keys_of(level, entries))
            hit = at >= 0
            depth[:, level] = np.bincount(owner[hit], weight[hit], len(pieces))
            whose.append(owner[hit])
            place.append(at[hit])
            how_much.append(weight[hit])
            entries, owner, weight = [entries[i] for i in np.flatnonzero(~hit)], owner[~hit], weight[~hit]
        owner, at, weight = np.concatenate(whose), np.concatenate(place).astype(np.int64), np.concatenate(how_much)
        order = np.argsort(owner, kind="stable")
        owner, at, weight = owner[order], at[order], weight[order]
        lens = self.starts[at + 1] - self.starts[at]
        parts = ragged(self.starts[at], lens)
        return np.bincount(owner, lens, len(pieces)).astype(np.int64), self.owners[parts], self.gains[parts] * np.repeat(weight, lens), depth, words

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and their posterior probabilities; `und` and 0 for texts without letters."""
        bounds, index, distinct = split_words(text)
        lens, owners, gains, depth, words = self.pieces(distinct)
        starts = np.cumsum(lens) - lens
        names, sure = [], []
        step = max(1, MOST_CELLS // len(self.langs))
        for a in range(0, len(text), step):
            b = min(a + step, len(text))
            some = index[bounds[a] : bounds[b]]
            row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            parts = ragged(starts[some], lens[some])
            cell = np.repeat(row, lens[some]) * len(self.langs) + owners[parts]
            score = np.bincount(cell, gains[parts], (b - a) * len(self.langs)).reshape(b - a, -1) + self.priors
            for level in range(LEVELS):
                score += np.bincount(row, depth[some, level], b - a)[:, None] * self.base[level]
            n = np.bincount(row, words[some], b - a)
            score = np.exp(score - score.max(axis=1, keepdims=True))
            score /= score.sum(axis=1, keepdims=True)
            best = score.argmax(axis=1)
            sure.append(np.where(n > 0, score[np.arange(b - a), best], 0.0))
            names += [self.langs[k] if c else UNKNOWN for k, c in zip(best, n, strict=True)]
        return names, np.concatenate([np.zeros(0), *sure])


def fit(langs: list[str], shares: np.ndarray, level: np.ndarray, key: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model:
    """The model of counts n of entries (level, key) in languages; shares are the languages' numbers of rows."""
    order = np.lexsort((lang, key))
    level, key, lang, n = level[order], key[order], lang[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.zeros((LEVELS, len(langs)))
    np.add.at(total, (level, lang), n)
    size = total + SMOOTHING * np.maximum(1, np.bincount(level[heads], minlength=LEVELS))[:, None]
    return Model(
        langs, np.log(shares / shares.sum()), np.log(SMOOTHING) - np.log(size), key[heads], np.append(heads, len(key)), lang.astype(np.int32), np.log1p(n / SMOOTHING).astype(np.float32)
    )


def held_out(id_col) -> F.Column:
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD) == HELD_OUT_REST


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the rows that have a language and an id and aren't held out; None if there are none.

    A repeated id counts once for a language's share. Every language that has a row is learnt. The driver gets a
    row for each language, and one for each word and n-gram that a language's sampled rows hold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(usable)
    counts = rows.select("id", "lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").toArrow()
    langs, shares = counts.column("lang").to_pylist(), counts.column("n").to_numpy().astype(np.float64)
    if not langs:
        return None
    # A threshold on the ids' hashes for each language takes about sample_rows of them, without a sort.
    taken = spark.createDataFrame([(name, k, float(min(1.0, sample_rows / n))) for k, (name, n) in enumerate(zip(langs, shares, strict=True))], "lang string, k int, share double")
    position = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
    sample = rows.withColumn("at", position).join(maybe_broadcast(taken, 100), "lang").filter("at <= share").select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words: dict[int, Counter] = defaultdict(Counter)
            for text, k in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist(), strict=True):
                found = words[k]
                for piece, n in Counter((text or "").split()).items():
                    for w in words_of(piece):
                        found[w] += n
            for k, found in words.items():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(found), pa.int32()), "word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    # By word alone: that serves the sums, too, and keeps as many tasks as there are for the n-grams.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = spread(sample, "text").mapInArrow(count, "k int, word string, n long").repartition(parts, "word").groupBy("k", "word").agg(F.sum("n").alias("n"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and their n-grams; an n-gram counts once for each word, as frequent words are looked up whole."""
        for batch in batches:
            found, k, n = batch.column("word").to_pylist(), batch.column("k").to_numpy(), batch.column("n").to_numpy()
            for level in range(LEVELS):
                if level:
                    m = LEVELS - level
                    split = [[g for g in grams_of(w, m) if len(g) == m] for w in found]
                    owner = np.repeat(k, np.fromiter(map(len, split), np.int64, len(split)))
                    key = keys_of(level, [g for gs in split for g in gs])
                    order = np.lexsort((owner, key))
                    key, owner = key[order], owner[order]
                    heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))) if len(key) else np.zeros(0, np.int64)
                    key, owner, times = key[heads], owner[heads], np.diff(np.append(heads, len(key)))
                else:
                    key, owner, times = keys_of(0, found), k, n
                yield pa.RecordBatch.from_pydict({"level": np.full(len(key), level, np.int32), "key": key.view(np.int64), "k": owner.astype(np.int32), "n": times.astype(np.int64)})

    schema = "level int, key long, k int, n long"
    entries = words.mapInArrow(spell, schema).groupBy("level", "key", "k").agg(F.sum("n").alias("n")).toArrow()
    level, key, k, n = (entries.column(c).to_numpy() for c in ("level", "key", "k", "n"))
    return fit(langs, shares, level, key.view(np.uint64), k, n)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row, repeated ones too; `und` with score 0 for texts that are null or
    have no letter.

    Without a model every text is `und`. Texts of letters that the model doesn't know get the language with the
    largest prior. Ties go to the language with more labelled rows. Other columns are not looked at. An empty
    table gives an empty result.
    """
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return thin.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            langs, score = sent.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return spread(thin, "id").mapInArrow(run, thin.select("id").schema.add("lang_pred", "string").add("score", "double")).withColumnRenamed("id", id_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify(docs, learn(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
