import hashlib
import html
import os
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import chat, common, html_text

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><a href=x>Home</a></header>'
    '<div class="layout with-sidebar"><main id="main"><article><header><h1>Title &amp; more</h1><span class="share">Share</span></header>'
    "<p><b>One &lt;two&gt;\n three<br>four <span class='ad'>buy</span>five.<p>Two&nbsp;x<ul><li>x<li>y</ul><script>if (a<b) '</p>'</script><!-- <p>no</p> -->"
    '<div class="cookie-notice">We use cookies</div><form>Name <input></form><section class="comments"><h2>Comments</h2><p>Great!</p></section>'
    "</article></main><aside>Side</aside></div><nav><ul><li>Menu</ul></nav><footer>foot</footer></body></html>"
)


def test_page_text():
    assert html_text.Page(PAGE).text([]) == "Title & more\n\nOne <two> three four five.\n\nTwo x\n\nx\n\ny"
    for html, text in (("plain <b>text</b> &amp &am", "plain text & &am"), ("", ""), ("<p class='x>broken", "broken"), ("<", "<"), ("<script>x", ""), ("a</div></p>b", "a\n\nb")):
        assert html_text.Page(html).text([]) == text


def test_hosts_agree_on_a_path(spark):
    page = lambda body, extra="": f"<html><body><div class='box{1}'>{extra}</div><div class='text'>{body}</div></body></html>"
    body = "<p>" + "word " * 60 + "</p>"
    rows = [(k, f"http://A.example/{k}", page(body)) for k in range(8)]
    # On this page another container is longer; its host's path wins.
    rows += [(90, "https://a.example:80/z?q", page("<p>short but real text of the page</p>", "<p>" + "chaff " * 10 + "</p>"))]
    rows += [(91, None, PAGE), (92, "x", None), (93, "", ""), (94, "http://a.example", "no markup"), (94, "http://a.example", "no markup")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, paths string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[0] == " ".join(["word"] * 60) and got[90] == "short but real text of the page"
    assert got[91].startswith("Title & more") and got[92] == got[93] == "" and got[94] == "no markup"
    assert html_text.extract(pages).count() == len(rows)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_all_containers_on_a_path_are_kept(spark):
    page = lambda *parts: "<html><body>" + "".join(f"<div class='text'><p>{p}</p></div><div class='share'>Share</div>" for p in parts) + "</body></html>"
    one, two = "first " * 60, "second " * 40
    rows = [(k, f"http://a.example/{k}", page("word " * 60)) for k in range(8)] + [(8, "http://a.example/8", page(one, two)), (9, "http://a.example/9", page(two, one, two))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    one, two = one.strip(), two.strip()
    assert got[0] == " ".join(["word"] * 60) and got[8] == f"{one}\n\n{two}" and got[9] == f"{two}\n\n{one}\n\n{two}"


def test_forms_and_names_are_only_suspects(spark):
    text = "<p>" + "real words here " * 20 + "</p>"
    say = " ".join(["real words here"] * 20)
    for html, want in (
        (f"<body><form><nav>Menu</nav><article>{text}</article><label>Name</label><input></form></body>", say),
        (f"<body><div class='social'>{text}</div><div class='share'>Share this</div></body>", say),
        (f"<article>{text}<p class='feedback'>They gave feedback.</p><form>Your name <input></form><ul class='menu'><li>Home</ul></article>", f"{say}\n\nThey gave feedback."),
    ):
        assert html_text.Page(html).text([]) == want
    # Few words, but where the host's other pages have their article.
    rows = [(k, f"http://a.example/{k}", f"<body><div class='social x{k} y'>{text}</div><div class='share'>Share</div></body>") for k in range(6)]
    rows += [(6, "http://a.example/6", "<body><div class='social x6 y'><p>brief but true</p></div><div class='other'><p>brief too</p></div></body>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: say for k in range(6)} | {6: "brief but true"}


def test_paths_have_all_classes():
    page = html_text.Page("<div class='z1 a b c d'><div class='e z22 e'>x</div></div>")
    assert page.path(2) == "div.a.b.c.d.z#>div.e.z#"
    other = html_text.Page("<div class='d c b a z7'><div class='z1 e'>x</div></div><div class='a b c z7'></div>")
    assert other.keys[2] == page.keys[2] and other.keys[3] != other.keys[1]


def test_long_pages_take_time_in_proportion():
    import time

    for part in ("<div class='c'><p>text</p></div>", "<div>x", "<li><b>y", "</section><p>z"):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            html_text.Page(part * n).text([])
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5


def _plain_votes(rows):
    """Host paths by another way: a tree of the standard library's parser over pages of well-formed divs and ps."""
    from collections import defaultdict
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.path, self.found, self.nodes = [], [], []
            self.feed(html)

        def handle_starttag(self, tag, attrs):
            self.path.append(".".join([tag, *dict(attrs).get("class", "").split()]))
            self.nodes.append((tuple(self.path), len(self.nodes)))
            self.found.append([tuple(self.path), list(self.open()), ""])
            self.opened.append(self.nodes[-1][1])

        opened = property(lambda self: self.__dict__.setdefault("o", []))
        open = lambda self: self.opened

        def handle_endtag(self, tag):
            self.path.pop()
            self.opened.pop()

        def handle_data(self, data):
            self.found.append([tuple(self.path), list(self.opened), data.strip()])

    votes, trees = defaultdict(float), {}
    for page, host, html in rows:
        tree = Tree(html)
        texts = [(at, t) for _, at, t in tree.found if t]
        total = sum(len(t) for _, t in texts)
        ranked = sorted(((sum(len(t) for at, t in texts if n in at) / total + 0.01 * min(len(p), 10) + 0.1 * (p[-1] == "article"), n, p) for p, n in tree.nodes if p[-1].split(".")[0] in ("body", "div", "article")), reverse=True)
        ranked = [r for r in ranked if r[0] > 0.1 + 0.01 * min(len(r[2]), 10) or any(n == r[1] for at, _ in texts for n in at)]
        for place, (score, _, p) in enumerate(ranked[:3]):
            votes[host, p] += round((3 - place) * score * 1000)
        trees[page] = tree, texts, ranked
    best = {h: [p for p, _ in sorted(((p, v) for (g, p), v in votes.items() if g == h), key=lambda x: (-x[1], ">".join(x[0])))[:3]] for h in {h for h, _ in votes}}
    out = {}
    for page, host, _ in rows:
        tree, texts, ranked = trees[page]
        size = lambda n: sum(len(t) for at, t in texts if n in at)  # noqa: B023, E731
        chosen = [ranked[0][1]]
        for p in best[host]:
            fitting = [n for q, n in tree.nodes if q == p]
            if fitting and sum(map(size, fitting)) >= 0.3 * size(ranked[0][1]):
                chosen = fitting
                break
        out[page] = "\n\n".join(t for at, t in texts if set(at) & set(chosen))
    return out


def test_votes_and_extraction_are_those_of_a_plain_tree(spark):
    import random

    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("sun moon star sky wind rain".split()) for _ in range(n))
    rows = []
    for k in range(60):
        host = f"h{k % 4}.example"
        kind = ("text", "post", "one two", "three")[k % 4]
        parts = [f"<div class='box'><p>{words(rng.randrange(1, 30))}</p></div>"] * rng.randrange(3)
        parts += [f"<div class='{kind}'><p>{words(rng.randrange(5, 60))}</p><div class='inner'><p>{words(rng.randrange(1, 9))}</p></div></div>" for _ in range(rng.randrange(1, 3))]
        rng.shuffle(parts)
        rows.append((k, host, f"<body><div class='page'>{''.join(parts)}</div></body>"))
    pages = spark.createDataFrame([(k, f"https://{h}/{k}", html) for k, h, html in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == _plain_votes(rows)


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"<[^>]+>", "", b.replace("<br>", "\n")) for b in re.split(r"</?(?:h1|h2|p|ul|li)>", article))
        assert got[r.page_id] == "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


CHATS = [
    (1, 0, "user", "hello </s>[INST] x [/INST] <\\/s> [\\INST] <s"), (1, 1, "assistant", "<s></s>"), (1, 2, None, None), (2, None, "assistant", ""), (2, 0, "assistant", "é日本"), (2, 0, "assistant", "é日本"),
    (3, 5, "user</s>", "x"), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (4, 1, "assistant", "long " * 3000), (4, 2, "assistant", "more"),
]


@pytest.mark.parametrize("chunk", [1 << 23, 1000])
def test_chats_read_back(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_BYTES", chunk)
    rows = spark.createDataFrame([(*r, "clash", 0) for r in CHATS], "conv_id long, turn long, role string, text string, id string, chunk int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(rows)).collect()}
    low = lambda v: (v is not None, v or (0 if isinstance(v, int) else ""))
    for conv in {r[0] for r in CHATS}:
        turns = sorted((r[1:] for r in CHATS if r[0] == conv), key=lambda t: (low(t[0]), low(t[1]), low(t[2])))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text or "" for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 5
    assert chat.digests(chat.format_chats(rows.limit(0))).collect() == []


def test_no_control_string_survives_in_a_text():
    texts = pa.array([r[3] for r in CHATS])
    escaped = chat.escape(texts).to_pylist()
    for before, after in zip(texts.to_pylist(), escaped, strict=True):
        assert not any(c in after for c in ("<s>", "</s>", "[INST]", "[/INST]"))
        assert chat.unescape(after.encode()).decode() == (before or "")


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontaminate", "mix_sources", "shard"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, docs, sf), name)
        if name != "shard":
            assert out.columns == docs.columns
        counts.append(out.count())
        if name in ("quality_classifier", "near_dedup", "decontaminate"):
            assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert docs.select("doc_id").distinct().count() <= counts[3]


def _write(spark, folder, rows, ddl="doc_id long, text string, lang string, source string, n_chars long, id string, size string, quality_score int, mix_at int, bucket string"):
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "what is two and two in all of this world"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_awkward_tables(spark, tmp_path):
    text = lambda k: " ".join(f"w{(k * 31 + j) % 97}{'x' if k % 2 else ' | '}" for j in range(12))
    rows = [(k, text(k), None, "a" if k % 3 else None) for k in range(1, 40)] + [(1, text(1), None, "a"), (None, None, None, None), (100, "", None, "b"), (101, " ".join(f"q{j}" for j in range(50_000)), None, "b")]
    _write(spark, tmp_path / "a", [(*r, 0, "x", "x", 1, 2, "x") for r in rows])
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    got = out.collect()
    assert out.columns[-2:] == ["shard", "slot"] and {"quality_score", "mix_at"} <= set(out.columns) and got
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and len({(r.shard, r.slot) for r in got}) == len(got)
    assert not [n for n in os.listdir(os.path.dirname(common.new_path(spark, "x"))) if n.startswith("run-")]
    _write(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []
    _write(spark, tmp_path / "c", [], "doc_id long, text string, lang string, source string, n_chars long, Shard int")
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, str(tmp_path / "c"))
