"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, names (capitalised inside a sentence) and units after a number become typed
placeholders. A capitalised word that opens a sentence may be a name or not: its windows have both forms.
Windows of five such tokens are hashed and joined between documents and benchmark items. What the placeholders
stand for must be replaced consistently along a run of matches, so a question that was asked again with other
numbers is caught and a chance likeness of templates is not.

An item without such windows, as it is too short or hasn't enough words, is looked for as it stands: by literal
windows of five tokens or, if it has fewer, by all its tokens, where they are whole sentences of a document.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import maybe_broadcast, ragged, slices, small_batches, split_words, spread, staged

WINDOW, COVERAGE = 5, 0.8
#: Windows with fewer words that aren't placeholders say nothing about their source.
LEAST_WORDS = 2
#: Marks the slot of a word that opens a sentence and is taken for a name. No token has it.
PERHAPS = "^"
#: Units that follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi miles mile meters meter metres metre kilometers kilometres feet inches inch yards "
    "mg g kg t lb lbs oz grams gram kilograms pounds pound ounces tons ml l liters liter litres litre gallons "
    "s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year "
    "usd eur gbp dollars dollar euros euro cents cent percent degrees degree mph kmh kph w kw v a hz khz mhz ghz kb mb gb tb "
    "stunden stunde tage tag jahre jahr euros heures heure jours jour ans horas hora dias año años".split()
)
TOKEN = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+")
ENDS = regex.compile(r"[.!?:;…][\"'”’)\]]*$")
NUM, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(f"<{k}>", 1)) for k in ("num", "name", "unit"))
#: What literal windows hash first, and their mark among the choices of names.
LITERAL, AS_IT_STANDS = np.uint64(xxhash.xxh64_intdigest("<literal>", 1)), 255
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
IS_NUM, IS_CAP, IS_UNIT, FIRST, LAST_ENDS = 1, 2, 4, 8, 16
#: Cells of the bitmap that lets only windows with a chance of a match leave their task: half a MB.
CELLS = 1 << 22
#: Distinct words that a worker remembers; then it forgets half. Text bytes that it looks at together.
MOST_WORDS, SLICE_BYTES = 200_000, 1 << 20
#: A token as it is remembered: the hash of its lower-cased string and its flags.
PACKED = np.dtype([("hash", ">u8"), ("flags", "u1")])
#: Words of one run of letters, with marks after it that don't end a sentence or do.
SIMPLE = regex.compile(r"([\p{L}]+)(?:[,*#$%&)|]*|([.!?:;]+))")
_FLAG_BYTES = [bytes([f]) for f in range(32)]
_known: dict[str, bytes] = {}


def _tokens(word: str) -> list[str]:
    return TOKEN.findall(word)


def _flags(token: str, low: str) -> int:
    return (IS_NUM if token[0].isnumeric() else 0) | (IS_CAP if token[0].isupper() and not (len(token) > 1 and token.isupper()) else 0) | (IS_UNIT if low in UNITS else 0)


def _pack(word: str) -> bytes:
    """The packed tokens of what stands between white space."""
    m = SIMPLE.fullmatch(word)
    if m:
        token = m[1]
        low = token.lower()
        flags = (0 if token == low and low not in UNITS else _flags(token, low)) | FIRST | (LAST_ENDS if m[2] else 0)
        return xxhash.xxh64_digest(low, 1) + _FLAG_BYTES[flags]
    found = _tokens(word)
    out = []
    for k, token in enumerate(found):
        low = token.lower()
        flags = _flags(token, low) | (FIRST if k == 0 else 0) | (LAST_ENDS if k == len(found) - 1 and ENDS.search(word) else 0)
        out.append(xxhash.xxh64_digest(low, 1) + _FLAG_BYTES[flags])
    return b"".join(out)


def _packed(words: list[str]) -> list[bytes]:
    if len(_known) > MOST_WORDS:
        for w in list(_known)[: MOST_WORDS // 2]:
            del _known[w]
    out = list(map(_known.get, words))
    for i, got in enumerate(out):
        if got is None:
            out[i] = _known[words[i]] = _pack(words[i])
    return out


def windows(text: pa.Array, literal: tuple[int, ...] = (), whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, callable]:
    """Of every window of all rows: row, position in its row, hash. And a function: the slots of given windows.

    Slots are, for each token of a window, what its placeholder stands for, and the empty string for a word. A
    window that holds capitalised words which open sentences comes once for each choice of those that are names.
    Literal windows of given lengths (at most WINDOW) come besides; shorter ones than WINDOW are whole sentences
    or, with `whole`, whole rows.
    """
    bounds, index, distinct = split_words(text)
    got = _packed(distinct)
    lens = np.fromiter(map(len, got), np.int64, len(got)) // PACKED.itemsize
    packed = np.frombuffer(b"".join(got), PACKED)
    flat_hash, flat_flags = packed["hash"].astype(np.uint64), packed["flags"].copy()
    starts = np.cumsum(lens) - lens
    each = lens[index]
    at = ragged(starts[index], each)
    hashes, flags = flat_hash[at], flat_flags[at]
    per_row = np.concatenate(([0], np.cumsum(each)))[bounds]
    n = len(at)
    row = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(per_row))
    opens = np.zeros(n, bool)
    opens[1:] = (flags[:-1] & LAST_ENDS) > 0
    opens &= (flags & FIRST) > 0
    heads = per_row[:-1]
    opens[heads[heads < n]] = True
    num = (flags & IS_NUM) > 0
    after_num = np.zeros(n, bool)
    after_num[1:] = num[:-1]
    after_num[heads[heads < n]] = False
    name = ((flags & IS_CAP) > 0) & ~opens
    unit = ((flags & IS_UNIT) > 0) & after_num
    code = np.where(num, NUM, np.where(unit, UNIT, np.where(name, NAME, hashes)))
    slot = num | unit | name
    m = max(0, n - WINDOW + 1)
    key, plain = np.zeros(m, np.uint64), np.zeros(m, np.int8)
    for k in range(WINDOW):
        key = (key ^ code[k : k + m]) * MULTIPLIER
        key ^= key >> np.uint64(29)
        plain += ~slot[k : k + m]
    inside = row[:m] == row[WINDOW - 1 :][:m]
    good = np.flatnonzero(inside & (plain >= LEAST_WORDS))
    # An item begins a sentence where the document may not: then its first word looks like a name.
    head = np.flatnonzero(inside & name[:m] & (plain + 1 >= LEAST_WORDS))
    other = (np.zeros(len(head), np.uint64) ^ hashes[head]) * MULTIPLIER
    other ^= other >> np.uint64(29)
    for k in range(1, WINDOW):
        other = (other ^ code[head + k]) * MULTIPLIER
        other ^= other >> np.uint64(29)
    # A bit for each of a window's words that open a sentence and may be names.
    perhaps = ((flags & IS_CAP) > 0) & opens & ~slot
    may = np.zeros(m, np.uint8)
    for k in range(WINDOW):
        may |= perhaps[k : k + m].view(np.uint8) << np.uint8(k)
    some = np.flatnonzero(inside & (may > 0))
    forms = [(good, key[good], 0), (head, other, 0)]
    for chosen in range(1, 1 << WINDOW):
        which = some[((may[some] & chosen) == chosen) & (plain[some] - chosen.bit_count() >= LEAST_WORDS)]
        named = np.zeros(len(which), np.uint64)
        for k in range(WINDOW):
            named = (named ^ (NAME if chosen >> k & 1 else code[which + k])) * MULTIPLIER
            named ^= named >> np.uint64(29)
        forms.append((which, named, chosen))
    closes = np.ones(n, bool)
    closes[:-1] = opens[1:] | (row[1:] != row[:-1])
    for size in literal:
        many = max(0, n - size + 1)
        fits = row[:many] == row[size - 1 :][:many]
        if whole:
            each_row = np.diff(per_row)[row[:many]]
            fits &= each_row == size if size < WINDOW else each_row >= size
        elif size < WINDOW:
            fits &= opens[:many] & closes[size - 1 :][:many]
        which = np.flatnonzero(fits)
        as_is = np.full(len(which), LITERAL)
        for k in range(size):
            as_is = (as_is ^ hashes[which + k]) * MULTIPLIER
            as_is ^= as_is >> np.uint64(29)
        forms.append((which, as_is, AS_IT_STANDS))
    sizes = np.concatenate([np.full(len(w), WINDOW) for w, _, _ in forms[: len(forms) - len(literal)]] + [np.full(len(w), z) for (w, _, _), z in zip(forms[len(forms) - len(literal) :], literal, strict=True)])
    is_name = np.ones(sum(len(w) for w, _, _ in forms), bool)
    is_name[len(good) : len(good) + len(head)] = False
    chosen = np.concatenate([np.full(len(w), c, np.uint8) for w, _, c in forms])
    good, key = np.concatenate([w for w, _, _ in forms]), np.concatenate([h for _, h, _ in forms])

    def slots(which: np.ndarray) -> list[list[str]]:
        owner = np.repeat(index, each)  # the word that each token is from, and the token's place in it
        nth = at - starts[owner]
        string = lambda t: _tokens(distinct[owner[t]])[nth[t]].lower()
        filled = lambda w, k: PERHAPS + string(good[w] + k) if int(chosen[w]) >> k & 1 else string(good[w] + k) if slot[good[w] + k] and (k or is_name[w]) else ""
        return [[""] * int(sizes[w]) if chosen[w] == AS_IT_STANDS else [filled(w, k) for k in range(WINDOW)] for w in which]

    return row[good], good - per_row[row[good]], key.view(np.int64), slots


def template_windows(table: DataFrame, id_col: str, text_col: str, only: np.ndarray | None = None, literal: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """(id, at, key, slots): the windows of every row's text; only those whose cell is set, if a bitmap is given."""
    small_batches(table.sparkSession)
    thin = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = None if only is None else table.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            row, at, key, slots = windows(batch.column("text"), literal, whole)
            which = np.arange(len(key))
            if sent is not None:
                cell = key & (CELLS - 1)
                which = np.flatnonzero((sent.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
            for a in range(0, len(which), 1 << 16):
                w = which[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row[w])), pa.array(at[w]), pa.array(key[w]), pa.array(slots(w), pa.list_(pa.string()))], names=["id", "at", "key", "slots"]
                )

    return spread(thin, "id", "text").mapInArrow(run, thin.select("id").schema.add("at", "long").add("key", "long").add("slots", ArrayType(StringType())))


def cells_of(items: DataFrame) -> np.ndarray:
    """The bitmap of the items' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(CELLS // 8, np.uint8)
        for batch in batches:
            cell = batch.column("key").to_numpy() & (CELLS - 1)
            np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": [bits.tobytes()]})

    out = np.zeros(CELLS // 8, np.uint8)
    for r in items.select("key").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id_col, item_col, n_windows, n_matched, coverage, changed) for each document that holds an item.

    A document holds an item if at least `coverage` of the item's window positions occur in it, in runs along
    which each filled slot of the item is always replaced by one and the same value; `changed` says that some
    value differs. A position occurs if any of its forms does; of several, the one with the fewest words taken
    for names counts. A word that opens a sentence is not taken for a name where that would contradict the rest
    of the run. Items of fewer than five words, or of placeholders only, are looked for as they stand; those of
    fewer than five must be whole sentences of the document. Null texts, and texts without words, match nothing.
    Rows that share an id are judged together, also those without one; copies of an item are items of their own.
    Very long texts are read whole. Other columns are not looked at. Empty tables give an empty result.
    """
    usual = staged(template_windows(benchmark, item_col, text_col), "items")
    others = benchmark.join(usual.select(F.col("id").alias("__has")).distinct(), F.col(item_col).eqNullSafe(F.col("__has")), "left_anti")
    short = staged(template_windows(others, item_col, text_col, None, tuple(range(1, WINDOW + 1)), True), "short-items")
    literal = tuple(sorted(r.size for r in short.select(F.size("slots").alias("size")).distinct().collect()))
    items = usual.unionAll(short).select(F.col("id").alias("item"), F.col("at").alias("item_at"), "key", F.col("slots").alias("item_slots"))
    totals = items.groupBy("item").agg(F.countDistinct("item_at").alias("n_windows"))
    hits = staged(template_windows(docs, id_col, text_col, cells_of(items), literal), "windows")
    met = hits.join(maybe_broadcast(items, 200), "key")
    is_guess = lambda p: p["item_slots"].startswith(PERHAPS) | p["slots"].startswith(PERHAPS)
    bare = lambda c: F.ltrim(c, F.lit(PERHAPS))
    pair = lambda p: F.struct(bare(p["item_slots"]).alias("mine"), bare(p["slots"]).alias("theirs"), is_guess(p).alias("guess"))
    pairs = F.transform(F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != ""), pair)
    guesses = F.size(F.filter("pairs", lambda p: p["guess"]))
    form = F.min(F.struct(guesses.alias("guesses"), "pairs"))["pairs"].alias("pairs")
    at = met.select("id", "item", "at", "item_at", pairs.alias("pairs")).groupBy("id", "item", "at", "item_at").agg(form)
    # On a run the item's windows come once each, so its lists are no longer than the item.
    run = at.groupBy("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_list(F.struct("item_at", "pairs")).alias("found"))
    all_pairs = F.array_distinct(F.flatten(F.transform("found", lambda w: w["pairs"])))
    run = run.withColumn("all", all_pairs).withColumn("sure", F.filter("all", lambda p: ~p["guess"]))
    steady = F.size(F.array_distinct(F.transform("sure", lambda p: p["mine"]))) == F.size("sure")
    # A guess goes, with its window, if its slot has another value anywhere in the run.
    clash = lambda p: F.exists("all", lambda q: (q["mine"] == p["mine"]) & (q["theirs"] != p["theirs"]))
    run = run.filter(steady).withColumn("bad", F.filter("all", lambda p: p["guess"] & clash(p)))
    kept = F.filter("found", lambda w: ~F.arrays_overlap(w["pairs"], F.col("bad")))
    run = run.select("id", "item", kept.alias("found"))
    changed = F.exists("found", lambda w: F.exists(w["pairs"], lambda p: p["mine"] != p["theirs"]))
    held = run.select("id", "item", changed.alias("changed"), F.explode("found.item_at").alias("item_at"))
    held = held.groupBy("id", "item", "item_at").agg(F.min("changed").alias("changed")).groupBy("id", "item").agg(F.count(F.lit(1)).alias("n_matched"), F.max("changed").alias("changed"))
    share = F.col("n_matched") / F.col("n_windows")
    return held.join(totals, "item").filter(share >= coverage).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_matched", share.alias("coverage"), "changed")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs, all columns, without the documents that hold an item. An empty table gives an empty result."""
    gone = staged(contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias("id")).distinct(), "contaminated")
    return docs.join(maybe_broadcast(gone, 24), F.col(id_col).eqNullSafe(gone.id), "left_anti")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
