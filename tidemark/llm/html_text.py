"""HTML extraction by consensus host paths.

Pass one scores the containers of every page and lets the page vote for its best ones, as generalised paths of
tags and classes (digits become #). The votes of a host's pages are added up in Spark. Pass two extracts each
page's text again from all containers that its host's winning path leads to, in page order.

HTML's own elements and roles say what is never text: navigation, asides, footers, scripts, hidden parts; so do
names of adverts, cookie notices and reader comments. Forms, and containers whose names speak of other
boilerplate, are only suspects: they stay where the host's winning path leads through them, or where they hold
most of the page's text.
"""

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, slices, small_batches, spread, staged

#: Paths a page votes for, and paths that a host keeps. A page's best container's score counts VOTES times, its
#: next one's once less, and so on.
VOTES, WINNERS = 3, 3
#: Parts that a host's pages are dealt into where the hosts' paths are too many to broadcast.
SALTS = 32
#: If the winning containers have less than this share of the text of the page's own best one, the latter is taken.
LEAST_SHARE = 0.3
#: A suspect with more than this share of the page's text is none.
MAIN_SHARE = 0.5

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[a-z]+")

# How HTML's elements lay out, and what the names of boilerplate say.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address details summary fieldset legend hr header footer nav aside form dialog menu center hgroup noscript "
    "template head search option optgroup select button svg canvas object video audio math".split()
)
SKIPPED = frozenset("nav footer aside script style noscript template iframe button select textarea title head svg canvas object video audio dialog menu search input noframes noembed xmp".split())
FORMS = frozenset("form fieldset".split())
LABELS = frozenset("label output datalist".split())
#: Elements of text, whose names don't make them suspects.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption main article address legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("body main article section div td".split())
#: An open element of the key's kind ends where one of these begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: Closing of the key's kind doesn't look beyond these.
SCOPES = frozenset("table ul ol dl div section article body main td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
ALWAYS = frozenset("comment comments commentlist disqus reply replies respond ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored cookie cookies consent gdpr newsletter popup modal".split())
BOILERPLATE = frozenset(
    "banner promo promos promotion promoted notice notices alert alerts overlay subscribe subscription signup sidebar sidebars aside widget widgets related "
    "recommended recommendations recommendation share sharing social discussion discussions breadcrumb breadcrumbs menu menus nav navbar navigation footer foot "
    "header masthead toolbar pagination pager login signin search copyright disclaimer feedback".split()
)
#: Parts of a class that make a boilerplate part of it speak of something else.
REAL = frozenset("content article post entry main story body text has with no without page wrapper layout site".split())


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v[1:-1] if v[:1] in "\"'" and v else v or "") for k, v in reversed(ATTRIBUTE.findall(raw))}


def judge(tag: str, attr: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is suspected to be."""
    if tag in ("html", "body"):
        return False, False
    if tag in SKIPPED or "hidden" in attr or attr.get("aria-hidden") == "true" or "display:none" in attr.get("style", "").replace(" ", "").lower():
        return True, False
    role = attr.get("role", "").lower()
    if tag == "header" and not in_article or role in ROLES:
        return True, False
    suspect = tag in FORMS or role == "form"
    for name in f"{attr.get('class', '')} {attr.get('id', '')}".lower().split():
        parts = set(NAME_PARTS.findall(name))
        if parts & ALWAYS and not parts & {"no", "without", "has", "with"}:
            return True, False
        suspect |= bool(parts & BOILERPLATE) and not parts & REAL and tag not in TEXTUAL and not (in_article and "header" in parts)
    return False, suspect


def path_key(parent: int, label: str) -> int:
    """The key of a path, from that of the path above and its last element."""
    return xxhash.xxh64_intdigest(label, parent)


class Page:
    """A page's containers and blocks of text. Nodes are block elements in page order; blocks know their node.

    All that is done with a page takes time in proportion to its length.
    """

    def __init__(self, html: str):
        self.tags, self.labels, self.parents, self.depths, self.keys, self.last = ["#root"], [""], [0], [0], [0], [0]
        self.hard, self.suspect, self.header = [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        stack, buffer, at = [0], [], 0
        inline_skip: list[str] = []
        opened: dict[str, int] = {}
        linked, in_link = 0, False
        article = 0
        top = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                buffer.clear()
            linked = 0

        def close(upto: int) -> None:
            nonlocal article
            while len(stack) > upto:
                node = stack.pop()
                self.last[node] = top
                opened[self.tags[node]] -= 1
                article -= self.tags[node] in ("article", "main")

        end = len(html)
        while at < end:
            m = TAG.search(html, at)
            text = html[at : m.start() if m else end]
            if text and not inline_skip and not self.hard[stack[-1]]:
                text = unescape(text)
                buffer.append(text)
                if in_link:
                    linked += len(text.strip())
            if not m:
                break
            at = m.end()
            slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if tag == "a":
                    in_link = False
                if inline_skip and tag == inline_skip[-1]:
                    inline_skip.pop()
                elif tag in BLOCKS:
                    inline_skip.clear()
                    flush()
                    for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                        name = self.tags[stack[i]]
                        if name == tag:
                            close(i)
                            break
                        if tag in ("p", "li", "dt", "dd") and name in SCOPES and not (tag == "li" and name not in ("ul", "ol")):
                            break
                continue
            if tag in RAW:
                ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = ended.end() if ended else end
                continue
            if tag == "br":
                buffer.append("\n")
            if tag not in BLOCKS:
                if tag == "a":
                    in_link = True
                if tag in LABELS and not inline_skip:
                    inline_skip.append(tag)
                elif tag not in VOID and rest and ("class" in rest or "hidden" in rest or "role" in rest or "id" in rest or "style" in rest):
                    if inline_skip and inline_skip[-1] == tag or not inline_skip and any(judge(tag, attributes(rest), article > 0)):
                        inline_skip.append(tag)
                elif inline_skip and inline_skip[-1] == tag:
                    inline_skip.append(tag)
                continue
            flush()
            inline_skip.clear()
            in_link = False
            # A paragraph has no blocks inside, so what ends here is on top.
            while len(stack) > 1 and (self.tags[stack[-1]] == "p" or tag in ENDED_BY.get(self.tags[stack[-1]], ())):
                close(len(stack) - 1)
            if tag == "hr" or rest.endswith("/") and tag not in ("p", "div", "section", "article", "main", "body", "html", "li", "td"):
                continue
            attr = attributes(rest) if rest else {}
            top = len(self.tags)
            parent = stack[-1]
            names = sorted(set(re.sub(r"\d+", "#", attr.get("class", "")).lower().split()))
            hard, suspect = judge(tag, attr, article > 0)
            self.tags.append(tag)
            self.labels.append(".".join([tag, *names]))
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.keys.append(path_key(self.keys[parent], self.labels[top]))
            self.hard.append(self.hard[parent] or hard)
            self.suspect.append(suspect)
            self.header.append(self.header[parent] or tag == "header")
            self.last.append(top)
            stack.append(top)
            opened[tag] = opened.get(tag, 0) + 1
            article += tag in ("article", "main")
        flush()
        close(1)
        self.last[0] = top
        weights = [0 if self.hard[node] else max(0, len(text) - 2 * links) for node, text, links in self.blocks]
        held, total = self.sums(weights), sum(weights)
        self.main = [s and h > MAIN_SHARE * total for s, h in zip(self.suspect, held, strict=True)]

    def sums(self, values: list[int]) -> list[int]:
        """For every node, the sum of the blocks' values inside it."""
        upto = [0] * (len(self.tags) + 1)
        for (node, _, _), v in zip(self.blocks, values, strict=True):
            upto[node + 1] += v
        for n in range(len(self.tags)):
            upto[n + 1] += upto[n]
        return [upto[last + 1] - upto[n] for n, last in enumerate(self.last)]

    def skipped(self, leading: list[int] = ()) -> list[bool]:
        """Whether each node is boilerplate, where the article is known to be in the nodes `leading`."""
        through = [False] * len(self.tags)
        for n in leading:
            while not through[n]:
                through[n] = True
                n = self.parents[n]
        out: list[bool] = []
        for n, parent in enumerate(self.parents):
            out.append(self.hard[n] or self.suspect[n] and not self.main[n] and not through[n] or n > 0 and out[parent])
        return out

    def real(self, skip: list[bool]) -> list[bool]:
        """Whether each block is text: not in boilerplate, and of a header inside an article, the headings."""
        return [not skip[n] and (not self.header[n] or self.tags[n] in HEADINGS) for n, _, _ in self.blocks]

    def scores(self) -> list[tuple[float, int]]:
        """Containers by descending score. A container scores the share of the page's real text that it holds,
        text in links counting against it; of two that hold the same, the inner one scores more, an article most."""
        skip = self.skipped()
        weights = [max(0, len(text) - 2 * links) if ok else 0 for (_, text, links), ok in zip(self.blocks, self.real(skip), strict=True)]
        total, held = sum(weights), self.sums(weights)
        found = [
            (held[n] / total + 0.01 * min(self.depths[n], 10) + (0.1 if tag in ("article", "main") else 0.0), n)
            for n, tag in enumerate(self.tags)
            if held[n] and not skip[n] and (tag in CONTAINERS or n == 0)
        ]
        return sorted(found, key=lambda x: (-x[0], -x[1]))  # of equal scores, the inner container first

    def path(self, node: int) -> str:
        """The generalised path, for people; keys tell paths apart."""
        parts = []
        while node:
            parts.append(self.labels[node])
            node = self.parents[node]
        return ">".join(reversed(parts))

    def text(self, paths: list[int]) -> str:
        """The text of the containers that the first fitting path, given by its key, leads to, or else of the
        page's own best one."""
        ranked = self.scores()
        best = [ranked[0][1]] if ranked else [0]
        ok = self.real(self.skipped())
        own = self.sums([len(b[1]) * k for b, k in zip(self.blocks, ok, strict=True)])[best[0]]
        for path in paths:
            # Equal paths are equally deep, so none of these is inside another.
            fitting = [n for n, key in enumerate(self.keys) if key == path and not self.hard[n]]
            if fitting:
                here = self.real(self.skipped(fitting))
                held = self.sums([len(b[1]) * k for b, k in zip(self.blocks, here, strict=True)])
                if sum(held[n] for n in fitting) >= LEAST_SHARE * own:
                    best, ok = fitting, here
                    break
        inside = [False] * len(self.tags)
        for n in best:
            inside[n : self.last[n] + 1] = [True] * (self.last[n] + 1 - n)
        return "\n\n".join(text for (n, text, _), k in zip(self.blocks, ok, strict=True) if k and inside[n])


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, keys, paths): the winning paths of every host, best first."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                out += [(name, page.keys[node].to_bytes(8, "big"), page.path(node), (VOTES - place) * score) for place, (score, node) in enumerate(page.scores()[:VOTES])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string(), pa.float64()))], names=["host", "key", "path", "score"])

    thin = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    # Scores are added as whole thousandths: sums don't depend on the order.
    votes = spread(thin, "html").mapInArrow(vote, "host string, key binary, path string, score double").groupBy("host", "key")
    votes = votes.agg(F.sum(F.round(F.col("score") * 1000).cast("long")).alias("votes"), F.min("path").alias("path"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path", "key"))
    won = votes.withColumn("place", place).filter(F.col("place") <= WINNERS)
    won = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "key", "path"))).alias("w"))
    return won.select("host", F.col("w.key").alias("keys"), F.col("w.path").alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) for every row: the blocks of the article, joined by two new lines.

    Null, empty and textless pages have the empty text. Pages without a host vote together. Each row counts,
    repeated ones too, and has a row in the result. Other columns are not looked at. An empty table gives an empty
    result. Hosts' paths are broadcast if they are few, else the pages shuffle by host and a part of the id, so
    that a host with a third of all pages goes to many tasks.
    """
    small_batches(pages.sparkSession)
    winners = staged(host_paths(pages, url_col, html_col), "host-paths").select("host", "keys")
    thin = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    thin = spread(thin, "html")
    few = maybe_broadcast(winners, 500)
    if few is winners:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = thin.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    else:
        met = thin.join(few, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            keys = [[int.from_bytes(k, "big") for k in row or []] for row in batch.column("keys").to_pylist()]
            texts = [Page(html).text(row) if html else "" for html, row in zip(batch.column("html").to_pylist(), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return met.select("id", "url", "html", "keys").mapInArrow(run, thin.select("id", "url").schema.add("text", "string")).withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
