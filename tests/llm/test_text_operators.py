"""Operators on documents, held against brute force on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import common, components, decontamination, exact_dedup, huffman, language, mixing, quality, sharding, similar, simhash, token_ids

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key string, digest string, fp string, bucket string"
LONG = " ".join(f"word{i % 977} thing" for i in range(40_000))


def frame(spark, rows):
    """Documents with additional columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows], DDL)


AWKWARD = [
    (1, "Alpha beta  gamma\tdelta.", "en", "a"), (2, "Alpha beta gamma delta.", None, "a"), (3, None, "en", None), (4, "", None, "b"), (5, "   ", "en", "b"),
    (6, LONG, "en", "c"), (7, LONG + " end", "en", "c"), (8, "one", "de", "b"), (8, "one", "de", "b"), (9, "日本 語 é", None, None), (10, "x", "en", None),
]


def test_exact_groups(spark):
    rows = exact_dedup.exact_groups(frame(spark, AWKWARD)).collect()
    groups = defaultdict(list)
    for i, t, *_ in AWKWARD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(map(tuple, rows)) == want
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []


def test_exact_groups_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1 << 10)
    monkeypatch.setattr(exact_dedup, "MOST_CELLS", 1 << 10)
    rows = AWKWARD + [(100 + k, f"text {k % 150}", None, None) for k in range(200)]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def test_repeat_filter_misses_no_repeat(spark):
    rng = random.Random(1)
    digests = [hashlib.sha256(str(rng.randrange(300)).encode()).digest() for _ in range(400)]
    cells = exact_dedup.SEGMENT
    bits = exact_dedup.repeat_filter(spark.createDataFrame([(bytearray(d),) for d in digests], "digest binary").repartition(5), cells)
    at = exact_dedup._cells(pa.array(digests), cells)
    hit = exact_dedup._is_set(bits, at).all(axis=1)
    counts = Counter(digests)
    assert all(h for h, d in zip(hit, digests, strict=True) if counts[d] > 1)
    assert sum(h for h, d in zip(hit, digests, strict=True) if counts[d] == 1) < 5


def _simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = list(AWKWARD)
    for k in range(20):
        words = base[:]
        for _ in range(k % 5):
            words[rng.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(words).upper(), "en", "z"))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = {i: _simhash(t) for i, t, *_ in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    label = _classes(prints, [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in got} == label and len(got) == len(rows)
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values())) and kept.columns == frame(spark, rows).columns
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_links_are_all_close_pairs(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64), f ^ 7}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = sorted(map(tuple, simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()))
    assert got == sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2)


def test_driver_holds_no_large_side(spark, tmp_path):
    """Spark takes the balls of written fingerprints for as small as their file; the driver must not hold them."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")
    assert "Broadcast" not in simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    joined = fps.join(common.maybe_broadcast(fps.withColumnRenamed("fp", "x"), 24, limit=24), F.col("fp") == F.col("x"))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    links = {"path": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 40)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "none": [(1, 1)]}[shape]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    label = _classes(nodes, [(a, b) for a, b in links if a != b])
    assert set(got) == nodes
    assert len(set(got.values())) == len({(label[n], got[n]) for n in nodes}) == len(set(label.values()))


def _mix(rows):
    docs = [(i, "1" if s is None else "0" + s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows]
    sizes = Counter()
    for _, k, n in docs:
        sizes[k] += n
    keys = sorted(sizes)
    weight = {k: 1 + j % 3 for j, k in enumerate(keys)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:  # reshare the excess until none is above
        left, open_ = total - sum(3 * sizes[k] for k in capped), [k for k in keys if k not in capped]
        target = {k: 3 * sizes[k] if k in capped else left * weight[k] / max(1, sum(weight[x] for x in open_)) for k in keys}
        above = [k for k in open_ if target[k] > 3 * sizes[k]]
        if not above:
            break
        capped |= set(above)
    digest = lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()
    taken = Counter()
    for k in keys:
        at = 0
        queue = sorted(((i, n) for i, s, n in docs if s == k), key=lambda d: (digest(d[0]), d))
        for i, n in queue * 3:
            if n and abs(at + n - target[k]) <= abs(at - target[k]):  # taken while that comes nearer
                taken[i] += n
            at += n
    return sizes, target, taken


def test_mix(spark):
    rng = random.Random(5)
    rows = [r for r in AWKWARD if r[0] != 6 and r[0] != 7 and r[0] != 8]
    rows += [(100 + k, "w " * rng.randrange(1, 60), None, rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for k in range(300)]
    sizes, target, taken = _mix(rows)
    got = mixing.plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, target[r.key], abs_tol=1e-6) and r.source_size == sizes[r.key] and r.times * r.size == taken[r.id]
    mixed = mixing.mix(frame(spark, rows))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.id: r.times for r in got if r.times}) and mixed.columns == frame(spark, rows).columns
    clash = frame(spark, rows).withColumnsRenamed({"id": "mix_at", "size": "mix_queue", "key": "mix_turn", "fp": "mix_source"})
    assert Counter(map(tuple, mixing.mix(clash, ordered=True).collect())) == Counter(map(tuple, mixed.collect()))
    for empty in ([], [(1, "", None, "a"), (2, None, None, None)]):
        assert [r.times for r in mixing.plan(frame(spark, empty)).collect()] == [0] * len(empty)


def test_sources_of_large_documents_come_near_their_targets(spark):
    rows = [(1, "w " * 1000, None, "a"), *((10 + k, "w " * 10, None, "b") for k in range(10))]
    got = mixing.plan(frame(spark, rows)).collect()
    taken = {s: sum(r.times * r.size for r in got if r.key == s) for s in ("0a", "0b")}
    assert taken == {"0a": 1000, "0b": 300}  # targets are 800 and 300
    rows = [(k, "w " * (400 if k < 3 else 7), None, "a" if k < 3 else "b") for k in range(200)]
    got = mixing.plan(frame(spark, rows)).collect()
    for s, largest in (("0a", 400), ("0b", 7)):
        mine = [r for r in got if r.key == s]
        assert abs(sum(r.times * r.size for r in mine) - mine[0].target) <= largest / 2


def test_an_ordered_mix_has_the_sources_in_proportion(spark):
    rows = [(k, "w " * 5, None, "abc"[k % 3]) for k in range(600)]
    mixed = [r.source for r in mixing.mix(frame(spark, rows), ordered=True).collect()]
    whole = Counter(mixed)
    for part in (mixed[: len(mixed) // 2], mixed[len(mixed) // 2 :]):
        assert all(abs(n - whole[s] / 2) < 20 for s, n in Counter(part).items())


def test_shards(spark):
    rows = AWKWARD + [(100 + k, "same" if k % 3 else f"t{k}", None, "s") for k in range(200)]
    docs = frame(spark, rows)
    got = sharding.shard(docs, shards=7, bucket_bytes=600).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)
    assert sharding.shard(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(docs.withColumnRenamed("bucket", "shard"))
    path = sharding.write_shards(docs, shards=3, file_rows=30)
    written = spark.read.parquet(path)
    assert written.count() == len(rows) and len(written.inputFiles()) > 6


def test_repeated_rows_are_scattered(spark, monkeypatch):
    rows = [(7, "the same row", None, "s")] * 500 + [(k, f"t{k}", None, "s") for k in range(100)]
    docs = frame(spark, rows).withColumnsRenamed({"id": "shard_mark", "size": "shard_salt", "key": "shard_part", "fp": "shard_at"})
    numbered = sharding._numbered(docs, "doc_id", "text", "n").collect()
    assert sorted(r.n for r in numbered if r.doc_id == 7 and r.text == "the same row") == list(range(500))
    monkeypatch.setattr(sharding, "staged", _largest_group := _Groups(sharding.staged))
    runs = [sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(docs, shards=7, bucket_bytes=600).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 600
    assert _largest_group.most < 60


class _Groups:
    """staged(), noting the largest bucket."""

    def __init__(self, call):
        self.call, self.most = call, 0

    def __call__(self, df, name, **options):
        out = self.call(df, name, **options)
        if name == "counts":
            self.most = max(self.most, out.agg({"n": "max"}).first()[0])
        return out


def test_huffman_lengths_are_optimal():
    rng = np.random.default_rng(0)
    for limit in (4, 6, 18):
        for n in (1, 2, 3, 16):
            counts = rng.integers(1, 1000, n) ** 2
            lengths = huffman.code_lengths(counts, limit)
            assert lengths.max() <= limit and (n == 1 or sum(2.0 ** -int(x) for x in lengths) == 1)
    # against a search over all length vectors
    counts = np.array([1, 1, 2, 30, 50])
    best = min(sum(c * x for c, x in zip(sorted(counts), v, strict=True)) for v in [(a, b, c, d, e) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) for d in (1, 2, 3) for e in (1, 2, 3)] if sum(2.0**-x for x in v) <= 1)
    assert (huffman.code_lengths(counts, 3) * counts).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_huffman_round_trip():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 5000) ** 3
    lengths = huffman.code_lengths(counts)
    codes, used = huffman.canonical_codes(lengths), np.flatnonzero(counts)
    decoder = huffman.Decoder.of(lengths)
    blocks, whole = [], []
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.choice(used, n).astype(np.uint32)
        blocks.append((*huffman.encode(ids, lengths, codes), n))
        whole.append(ids)
    assert (decoder.decode(blocks) == np.concatenate(whole)).all()


@pytest.mark.parametrize("block", [1 << 17, 50])
def test_token_ids_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", block)
    odd = ["It's don't 'S", "<|endoftext|>x a<|startoftext|>", "İstanbul É É", "12,5 3km x\x1cy z\u0085q", "--- ''' '", "ΑΣ Σ", 'a|b <b> "q" ...a']
    rows = AWKWARD + [(50 + k, t, None, None) for k, t in enumerate(odd)]
    name = public_tokenizers.path("word_bpe_49k.json")
    path = token_ids.write_ids(frame(spark, rows).repartition(3), name)
    got = {r.doc_id: r for r in token_ids.read_ids(spark, path).collect()}
    digests = {r.doc_id: r for r in token_ids.read_digests(spark, path).collect()}
    tokenizer, start = Tokenizer.from_file(name), 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert digests[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        if i != 8:  # a repeated id
            assert got[i].start == digests[i].start == start
        start += len(ids)
    assert token_ids.read_ids(spark, path).count() == len(rows)
    assert token_ids.read_ids(spark, token_ids.write_ids(frame(spark, []), name)).collect() == []


def test_any_tokenizer_will_do(spark):
    name = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, t, None, None) for k, t in enumerate(["Hello  World", "it's\n\nfine", None, "", "É 日本", "<|endoftext|> x"])]
    got = {r.doc_id: list(r.ids) for r in token_ids.read_ids(spark, token_ids.write_ids(frame(spark, rows), name)).collect()}
    assert got == {i: [*Tokenizer.from_file(name).encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    read = lambda f: open(public_tokenizers.path(f), encoding="utf-8").read()  # noqa: E731, SIM115
    assert token_ids.by_words(read("word_bpe_49k.json")) and not token_ids.by_words(read("byte_bpe_50k.json"))


def test_documents_without_ids_are_written(spark):
    name = public_tokenizers.path("word_bpe_49k.json")
    for texts in (["", None, ""], ["", "some words", None]):
        rows = [(k, t, None, None) for k, t in enumerate(texts)]
        path = token_ids.write_ids(frame(spark, rows).coalesce(1), name, end_id=None)
        got = {r.doc_id: list(r.ids) for r in token_ids.read_ids(spark, path).collect()}
        assert got == {k: Tokenizer.from_file(name).encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_contaminated(spark):
    items = spark.createDataFrame([(1, "A train leaves Paris at 12 km per hour and then drives for 3 hours until it stops in London today"), (2, "too short text"), (3, None), (4, " ".join(f"w{chr(97 + k)}x" for k in range(20)))], "item_id long, text string")
    again = "foo. A train leaves Berlin at 45 miles per hour and then drives for 7 hours until it stops in Rome today yes"
    clash = "A train leaves Berlin at 45 miles per hour and then drives for 45 hours"
    rows = AWKWARD + [(20, again, None, None), (21, "Some " + " ".join(f"w{chr(97 + k)}x" for k in range(20)).upper() + "!", None, None), (22, clash, None, None), (23, "It is too short text, or so", None, None), (24, "Yes. Too short, text? No", None, None)]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    assert set(got) == {(20, 1), (21, 4), (24, 2)} and got[20, 1].changed and not got[21, 4].changed
    assert sorted(r.doc_id for r in decontamination.keep_clean(frame(spark, rows), items).collect()) == sorted(r[0] for r in rows if r[0] not in (20, 21, 24))
    for docs, bench in ((frame(spark, []), items), (frame(spark, rows), items.limit(0))):
        assert decontamination.contaminated(docs, bench).collect() == []


def test_items_without_template_windows_are_found_as_they_stand(spark):
    items = [(1, "17 + 25 - 3 = 39 * 12 / 4"), (2, "Name the capital."), (3, "1 2 3 4"), (4, "?!"), (5, "5 6 7 8 9 10 11 12 13")]
    rows = [
        (1, "First: 17 + 25 - 3 = 39 * 12 / 4 and more", None, None), (2, "so 17 + 25 - 3 = 38 * 12 / 4", None, None), (3, "Well. Name the capital! Now", None, None),
        (4, "they name the capital city", None, None), (5, "1 2 3 4", None, None), (6, "0 1 2 3 4 5", None, None), (7, "4 5 6 7 8 9 10 11 12 13 14", None, None),
    ]
    got = decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (5, 3), (7, 5)}


def test_windows_and_slots_are_those_of_a_plain_loop(spark):
    """Documents of plain lower-case words and numbers only: a template is a tuple, slots are looked up."""
    rng = random.Random(11)
    word = lambda: rng.choice("red blue tall small tree house river runs sees with from under".split())
    token = lambda: str(rng.randrange(30)) if rng.random() < 0.25 else word()
    items = [(k, " ".join(token() for _ in range(rng.randrange(8, 25)))) for k in range(25)]
    rows = []
    for k in range(120):
        text = [token() for _ in range(rng.randrange(60))]
        if k % 2:
            of = rng.choice(items)[1].split()
            filled = {t: str(rng.randrange(90)) for t in of if t.isdigit()}
            copy = [filled.get(t, t) for t in of]
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(["odd", "77"])
            text[5:5] = copy
        rows.append((k, " ".join(text), None, None))

    def templates(text):
        tokens = text.split()
        codes = ["#" if t.isdigit() else t for t in tokens]
        for i in range(len(tokens) - 4):
            if sum(c != "#" for c in codes[i : i + 5]) >= 2:
                yield i, tuple(codes[i : i + 5]), tokens[i : i + 5]

    want = set()
    for item, text in items:
        mine = list(templates(text))
        for doc, whole, *_ in rows:
            runs = defaultdict(list)
            for i, code, filled in templates(whole):
                for j, other, slots in mine:
                    if code == other:
                        runs[i - j].append((j, {(a, b) for a, b in zip(slots, filled, strict=True) if a.isdigit()}))
            held = set()
            for run in runs.values():
                pairs = set().union(*(p for _, p in run))
                if len({a for a, _ in pairs}) == len(pairs):
                    held |= {j for j, _ in run}
            if mine and len(held) >= 0.8 * len(mine):
                want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 20


def test_recall_of_items_asked_again_with_other_names_and_numbers(spark):
    """Measured: all of 60 items are found, none in the documents of invented prose."""
    rng = random.Random(12)
    names, things, acts = "James Oliver Maria Chen Peter Ann".split(), "apples pens books coins".split(), "buys sells finds counts".split()

    def ask(form, a, b, n):
        return [
            f"{a} {acts[form % 4]} {n[0]} {things[form // 4 % 4]} and then {n[1]} more {things[form // 4 % 4]}. How many {things[form // 4 % 4]} does {a} have in all after {n[2]} days?",
            f"{a} has {n[0]} {things[form % 4]}, and {b} has {n[1]} times as many {things[form % 4]} as {a}. If {b} gives {n[2]} {things[form % 4]} away, how many {things[form % 4]} do they have together?",
            f"A train that {a} drives for {n[0]} hours at {n[1]} miles per hour stops {n[2]} times on the way, as form {chr(97 + form)} says. How far does {a} get?",
        ][form % 3]

    pick = lambda: (rng.sample(names, 2), rng.sample(range(2, 90), 3))
    items, rows = [], []
    for k in range(60):
        (a, b), n = pick()
        items.append((k, ask(k, a, b, n)))
        (a, b), n = pick()
        rows.append((k, "It was a fine day. " + ask(k, a, b, n) + " Nobody knew.", None, None))
    docs = frame(spark, rows).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k, _ in items} <= {d for d, i in got if d == i} and all(d < 1000 for d, _ in got)


def test_slots_must_be_filled_alike(spark):
    items = spark.createDataFrame([(1, "take 5 apples and then give away 5 pears so that no one has 5 left")], "item_id long, text string")
    rows = [(1, "take 8 apples and then give away 8 pears so that no one has 8 left", None, None), (2, "take 8 apples and then give away 9 pears so that no one has 7 left", None, None)]
    assert [(r.doc_id, r.changed) for r in decontamination.contaminated(frame(spark, rows), items).collect()] == [(1, True)]


def test_names_that_open_sentences(spark):
    james = "James writes a 3 page letter to 2 different friends twice a week. James sends them on Monday. How many pages does James write a year?"
    plain = "The old mill grinds wheat all day. The miller sleeps at noon. The river never stops running below the wheel."
    items = spark.createDataFrame([(1, james), (2, plain)], "item_id long, text string")
    oliver = james.replace("James", "Oliver").replace("3", "5").replace("2", "4").replace("Monday", "Friday")
    two = james.replace("James writes", "Oliver writes").replace("James sends", "Peter sends").replace("does James", "does Oliver")
    rows = [(1, oliver, None, None), (2, f"then, {oliver}", None, None), (3, plain.replace("The miller", "Every miller"), None, None), (4, two, None, None), (5, james, None, None)]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame(spark, rows), items).collect()}
    assert {k: r.changed for k, r in got.items()} == {(1, 1): True, (2, 1): True, (3, 2): True, (5, 1): False}
    assert all(got[k, 1].coverage == 1 for k in (1, 2, 5))


def test_windows_are_those_of_a_plain_loop():
    texts = ["the cat sat on the mat and ran", None, "", "a b c d", "One two Three four. Five six 7 km off, x-y z"]
    row, at, _, _ = decontamination.windows(pa.array(texts))
    counts = Counter(row.tolist())
    assert counts[0] == 4 and counts[1] == counts[2] == counts[3] == 0
    same = decontamination.windows(pa.array([texts[0], "zz. " + texts[0].replace("cat", "CAT")]))
    assert set(same[2][same[0] == 0]) <= set(same[2][same[0] == 1])


def test_slices():
    batches = [pa.RecordBatch.from_pydict({"t": ["x" * k for k in range(i, i + 9)] + [None, ""]}) for i in (0, 5, 40)]
    for most in (1, 30, 10**9):
        out = list(common.slices(iter(batches), "t", most))
        assert sum((b.column("t").to_pylist() for b in out), []) == sum((b.column("t").to_pylist() for b in batches), [])


def _prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "mono tele photo geo".split() for b in "graph phone scope logy".split()]
    rows, labels = list(AWKWARD), []
    for k in range(400):
        good = k % 4 > 0
        text = _prose(rng, words, 40)
        rows.append((1000 + k, text if good else text.replace(" ", " | "), None, None))
        labels.append((1000 + k, int(good), 0))
    labels += [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, marks, sample_rows=300)
    got = {r.doc_id: r.quality_score for r in quality.scores(docs, model).collect()}
    assert len(got) == len({r[0] for r in rows}) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.3) == bool(q) for i, q, _ in labels if i and i >= 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(right) > 40 and np.mean(right) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() < len(rows)
    lone = quality.learn(docs, marks.filter("quality = 1"))
    assert lone.score("anything") == lone.score("") == lone.score(None) > 0.5
    assert quality.learn(frame(spark, []), marks.limit(0)).score("x") == 0.5


def test_quality_columns_and_empty_tables(spark):
    model = quality.fit([], np.zeros(0, bool))
    docs = frame(spark, AWKWARD).withColumnRenamed("id", "quality_score")
    with pytest.raises(ValueError):
        quality.scores(docs, model)
    assert sorted(map(repr, quality.keep_good(docs, model).collect())) == sorted(map(repr, docs.collect()))
    assert quality.keep_good(docs.limit(0), model).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs.limit(0), labels).score("x") == 0.5


def test_what_is_learnt_from_is_bounded(spark, monkeypatch):
    rows = [(k, f"text {k} {'yes' if k % 2 else 'no'} " + "abc " * k, None, None) for k in range(1, 200)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 200)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda found, good: seen.append(found))
    for most in (1, 2000, 1 << 25):
        monkeypatch.setattr(quality, "SAMPLE_FEATURES", most)
        quality.learn(frame(spark, rows), labels)
    assert len(seen[0]) == 1 < len(seen[1]) < len(seen[2]) and sum(map(len, seen[1])) <= 2000


def test_fit_is_that_of_plain_loops(monkeypatch):
    """Ratios by counting; weights, where descent may go on until it rests, by plain descent in another order."""
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    good = np.array([len(set(r) & {1, 2, 3, 4, 5}) > 1 for r in rows])
    counts = {y: Counter(int(b) for r, g in zip(rows, good, strict=True) if g == y for b in r) for y in (False, True)}
    size = {y: sum(counts[y].values()) + quality.ALL_BINS for y in counts}
    ratio = lambda b: math.log((counts[True][b] + 1) / size[True]) - math.log((counts[False][b] + 1) / size[False])
    ratios, weights, bias = quality.fit_margins(rows, good)
    assert all(math.isclose(ratios[b], ratio(b), rel_tol=1e-9) for b in range(40))
    vectors = []
    for r in rows:
        x = {int(b): ratio(int(b)) for b in r}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors.append({b: v / norm for b, v in x.items()})
    # Plain dual coordinate descent, in order, until it rests.
    w, b0, alpha = defaultdict(float), 0.0, [0.0] * len(rows)
    n = {y: int((good == y).sum()) for y in (False, True)}
    for _ in range(3000):
        for i, x in enumerate(vectors):
            y = 1 if good[i] else -1
            gradient = y * (sum(w[b] * v for b, v in x.items()) + b0) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in x.values()) + 1), 0), 0.5 * len(rows) / n[bool(good[i])])
            for b, v in x.items():
                w[b] += (new - alpha[i]) * y * v
            b0 += (new - alpha[i]) * y
            alpha[i] = new
    model = quality.Model(weights, ratios, bias, 1.0, 0.0)
    for r, x in zip(rows, vectors, strict=True):
        assert abs(model.margin(r) - (sum(w[b] * v for b, v in x.items()) + b0)) < 0.03


def test_ngram_features_are_those_of_a_set():
    text = "abab ab ab"
    raw = text.encode()
    grams = {raw[i : i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)}
    bins = quality.features(text)
    assert len(np.unique(bins)) == len(bins)
    assert sum(b < quality.BINS for b in bins) == len(grams)
    assert len(quality.features("")) == len(quality.features(None))
    assert (quality.features(LONG * 4) == quality.features(LONG * 5)).all()


def test_language(spark):
    rng = random.Random(7)
    known = {"en": "the and with from house water river stone".split(), "de": "der und mit von haus wasser fluss stein".split()}
    rows = [(k, _prose(rng, known[lang], 12), lang, "s") for k in range(200) for lang in [("en", "de")[k % 2]]]
    rows += [(500, None, "en", None), (501, "123 !!", "en", None), (502, "", None, None), (503, "watery housing", None, None), (504, "flüsse wassern", None, None), (505, "日本", None, None), (506, LONG, None, None)]
    model = language.learn(frame(spark, rows), sample_rows=60)
    got = {r.doc_id: r for r in language.identify(frame(spark, rows), model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows if i < 200)
    assert [got[i].lang_pred for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "en", "de"]
    assert got[505].lang_pred in known and all(0 <= r.score <= 1 for r in got.values()) and got[500].score == 0
    assert language.learn(frame(spark, [])) is None
    assert [r.lang_pred for r in language.identify(frame(spark, rows[:1]), None).collect()] == ["und"]


def _plain_scores(texts, labelled, langs):
    """Posteriors by dictionaries and recursion."""
    find = re.compile(r"[^\W\d_]+")
    words, grams = {k: Counter() for k in langs}, [{k: Counter() for k in langs} for _ in range(6)]
    for text, lang in labelled:
        words[lang].update(find.findall(text.lower()))
    for lang in langs:
        for w in words[lang]:
            for n in range(1, 6):
                marked = f" {w} " if n > 1 else w
                grams[n][lang].update(marked[i : i + n] for i in range(len(marked) - n + 1))

    def say(table, entry):
        size = len({e for k in langs for e in table[k]})
        return [math.log((table[k][entry] + 0.5) / (sum(table[k].values()) + 0.5 * max(1, size))) for k in langs] if any(table[k][entry] for k in langs) else None

    def back(piece, n):
        if n == 0:
            return [0.0] * len(langs)
        parts = [piece[i : i + n] for i in range(max(1, len(piece) - n + 1))]
        got = [say(grams[n], p) or back(p, n - 1) for p in parts]
        return [sum(g[k] for g in got) / len(parts) for k in range(len(langs))]

    rows = Counter(lang for _, lang in labelled)
    for text in texts:
        total = [math.log(rows[k] / sum(rows.values())) for k in langs]
        for w in find.findall(text.lower()):
            total = [a + b for a, b in zip(total, say(words, w) or back(f" {w} ", 5), strict=True)]
        top = max(total)
        odds = [math.exp(t - top) for t in total]
        yield langs[odds.index(1.0)], 1 / sum(odds)


def test_language_scores_are_those_of_plain_loops(spark):
    rng = random.Random(9)
    letters = {"x": "abcdefgh", "y": "efghijkl", "z": "abclmnop"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randrange(1, 8)))
    rows = [(k, " ".join(word(lang) for _ in range(rng.randrange(1, 6))), lang, "s") for k in range(240) for lang in [rng.choice("xxxyyz")]]
    rows += [(k, t, None, "s") for k, t in enumerate(["ab", "q", "qqqqqqqq", "efgh-abc d1e", "Abc ABC", "é a"], 500)]
    taught = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = [k for k, _ in sorted(Counter(lang for _, lang in taught).items(), key=lambda x: (-x[1], x[0]))]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows + rows[:5]), language.learn(frame(spark, rows))).collect()}
    for (i, t, *_), (lang, sure) in zip(rows, _plain_scores([t for _, t, *_ in rows], taught, langs), strict=True):
        assert got[i].lang_pred == lang and abs(got[i].score - sure) < 1e-4, (t, lang)
    assert language.identify(frame(spark, rows + rows[:5]), language.learn(frame(spark, rows))).count() == len(rows) + 5
    assert language.identify(frame(spark, []), language.learn(frame(spark, rows))).collect() == []


def test_all_languages_are_learnt(spark):
    """Many more than 500, the rare ones by a few rows each."""
    name = lambda k: "".join(chr(97 + int(d)) for d in f"{k:03d}")
    rows = [(1000 * k + j, " ".join(f"{name(k)}{w}" for w in ("vor", "zin", "lum")), f"l{k}", "s") for k in range(700) for j in range(4)]
    rows += [(2_000_000 + j, "plain common words", "l0", "s") for j in range(400)]
    model = language.learn(frame(spark, rows))
    assert len(model.langs) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}) > 690
    got = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, rows), model).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows if lang in model.langs)


def test_similar_rows_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = list(AWKWARD)
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 300]))]
        for k in range(8):
            words = base[:]
            for _ in range(rng.randrange(6) * len(base) // 100):
                words[rng.randrange(len(base))] = f"changed{rng.randrange(50)}"
            rows.append((100 + 10 * g + k, " ".join(words), "en", "z"))
    rng.shuffle(rows)
    sets = {}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8
    label = _classes(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    docs = frame(spark, rows)
    kept = similar.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values())) and kept.columns == docs.columns
    assert len(set(label.values())) < simhash.keep_one(docs).count()
    staged = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in staged.collect()) == sorted(set(label.values()))
    assert similar.keep_one(frame(spark, [])).collect() == []
    assert [r.doc_id for r in similar.keep_one(frame(spark, [(3, None, "", ""), (2, "", "", "")])).collect()] == [2]


def test_distinct_words_are_cut_by_arrow():
    """Ids are the tokenizer's; of words that differ in case and marks, the letters are encoded once for all."""
    json = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder, plain = token_ids.Encoder(json), Tokenizer.from_str(json)
    words = [a + b for a in ("Lorem", "lorem", "ÀÉß", "ÿ", "") for b in ("", ".", ",***", "...%%%")] + ["it's", "日本", "a-b", "x1", "1,5", "A\u0301.", "É\x00", "\u00a0", "İ!"]
    for some in (words, words[::-1], [], ["it's"], ["lorem"]):
        lens, flat = encoder.words(pa.array(some, pa.large_string()))
        want = [plain.encode(w, add_special_tokens=False).ids for w in some]
        assert lens.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
    assert {w for w in encoder.known if w.isalpha()} == {"lorem", "àéß", "ÿ"}


def test_similar_rows_are_found_by_simhash(spark):
    """Without any MinHash key, what multi-index hashing finds is compared: fingerprints at most 2 bits apart."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    texts = {0: " ".join(base), 100: "one two three", 101: "one two four"}
    texts |= {k: " ".join(base[: 150 * k] + ["changed"] + base[150 * k + 1 :]) for k in range(1, 25)}
    prints = {i: similar.set_fingerprint(similar.shingle_set(t)) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2]
    label = _classes(texts, near)
    assert len(set(label.values())) < len(texts) - 10 and label[100] != label[101]
    docs = frame(spark, [(i, t, "en", "z") for i, t in texts.items()])
    rows = similar.sketches(docs, "doc_id", "text", similar.SHINGLE)
    bare = rows.withColumn("keys", F.array().cast("array<long>"))
    groups = {r.fp: r.component for r in similar.near_groups(docs, bare, "doc_id", "text", similar.SHINGLE, similar.SIMILARITY).collect()}
    assert {r.id: groups[r.fp] for r in rows.collect()} == label
    # Alike in all bits, but not in their sets: the exact check keeps them apart.
    same = bare.withColumn("sim", F.lit(0).cast("long")).filter("id >= 100")
    apart = similar.near_groups(docs, same, "doc_id", "text", similar.SHINGLE, similar.SIMILARITY)
    assert sorted(r.component for r in apart.collect()) == [100, 101]


def test_prefix_pairs_let_no_similar_pair_go(spark):
    rng = random.Random(13)
    base = list(range(1000, 1060))
    sets = {}
    for k in range(120):
        own = set(base)
        for _ in range(rng.randrange(16)):
            own.discard(rng.choice(base))
            own.add(10_000 + 100 * k + rng.randrange(100) if rng.random() < 0.7 else rng.randrange(2000, 2010))
        sets[k] = own
    nodes = spark.createDataFrame([(k, k // 2) for k in sets], "fp long, root long")
    table = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "fp long, n long, found array<long>")
    want = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    found = similar.prefix_pairs(nodes, table, 0.8)
    assert want <= {tuple(r) for r in found.collect()}
    assert {tuple(r) for r in similar.similar(found, table, 0.8).collect()} == want and len(want) > 100


def test_many_copies_that_are_not_quite_similar_make_few_pairs(spark):
    """Each copy has shingles of its own, so that any two share less than 0.8 of their union."""
    sets = {k: [*range(1000, 1100), *range(10_000 + 100 * k, 10_000 + 100 * k + 16)] for k in range(300)}
    nodes = spark.createDataFrame([(k, k) for k in sets], "fp long, root long")
    table = spark.createDataFrame([(k, len(v), v) for k, v in sets.items()], "fp long, n long, found array<long>")
    assert similar.prefix_pairs(nodes, table, 0.8).isEmpty()


@pytest.mark.parametrize("few", [0, 60, None])
def test_components_finish_in_one_task(spark, few, monkeypatch):
    """What Spark contracts, what one task does and any mix of them agree; a small table is written twice, not twice a round."""
    rng = random.Random(15)
    links = [(i, i + 1) for i in range(-60, 60)] + [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(50)] + [(2**62, -(2**62))]
    written = []
    monkeypatch.setattr(components, "staged", lambda df, name, real=components.staged: written.append(name) or real(df, name))
    if few is not None:
        monkeypatch.setattr(components, "FEW", few)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    label = _classes(nodes, [(a, b) for a, b in links if a != b])
    assert set(got) == nodes
    assert len(set(got.values())) == len({(label[n], got[n]) for n in nodes}) == len(set(label.values()))
    assert written == ["edges", "reps"] if few is None else len(written) > 4
