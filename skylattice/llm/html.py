"""Main text of web pages, with site templates removed by subtree hashes.

Pages are read by a lenient scanner that closes what HTML lets stand open, in time linear in the page.
Every element's subtree is hashed (names, attributes and text); Spark counts on how many pages of a host each
hash occurs, once a page, and hashes on many pages of a host (min_pages, and min_share of its pages) are its
template.  On the second reading those subtrees go first, wherever in the page they stand.  Of what is left go
elements that never hold main text, by name or by what their class, id or role says (sites with few pages
show no template, and adverts or comments differ from page to page): by any word in it, but in a marked
article, and for prose anywhere, by whole tokens alone, and prose never by its id.  If a page marks its
article (article or main), the text is taken from there, unless those hold less text than the rest of what
stays: then they are no more than comments or cards, and the whole page counts.  An article can itself be
marked as no main text.  Template removal spares subtrees in it that hold prose (paragraphs, headings,
quotations, code), because the same article may stand on a site many times.  template_chars and
named_chars say how much text of a page either way took away.

Text: character references decoded text node by text node, white space inside a block one space, trimmed,
blocks in page order joined by two line feeds.  Code keeps no line breaks either.

Defined results: null html counts as empty; a null url is host ""; a page without text gives the empty
string and 0; a page that is all template gives nothing; repeated rows are pages of their own; truncated
tags are dropped; a quote that nothing closes is a letter.  An empty table gives an empty result.  Only id,
url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import SALTS
from .common import TEXT, checkpointed, joined_evenly, map_texts, small_slices, table

MIN_PAGES, MIN_SHARE = 10, 0.3
BROADCAST_ROWS = 200_000
TAKEN = ["text", "n_chars", "template_chars", "named_chars"]
# Element names of HTML by their part here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
NEVER = RAW | set("head nav header footer aside form button select option datalist dialog menu object audio video canvas map".split())
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
MAIN = {"article", "main"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class, id or role that mark what is no main text.
SAYS_NO = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navigation navbar menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar complementary contentinfo search cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription paywall signup login comment comments discussion disqus replies reply respond share sharing social related recommended recommendations widget pagination pager toolbar tags "
    "alert skip hidden".split()
)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")


def attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(said)} if said.strip(" /") else {}


def says_no(own: dict[str, str], whole: bool = False, prose: bool = False) -> bool:
    """Whether attributes mark what is no main text.  whole: only by whole tokens ("comments", not "how-to-comment"); prose: never by id, which names a place to link to."""
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    return any(not SAYS_NO.isdisjoint(own.get(k, "").lower().split() if whole else WORDS.findall(own.get(k, "").lower())) for k in ("class", "id", "role") if not (prose and k == "id"))


class Node:
    __slots__ = ("name", "no", "parts", "prose", "hash", "said", "size")

    def __init__(self, name: str, said: str = "", inside: bool = False):
        own = attributes(said)
        self.name, self.said, self.parts = name, said, []
        self.no = name in NEVER or name not in ("html", "body", "main") and says_no(own, inside or name in PROSE or name == "article", name in PROSE)
        self.prose, self.hash, self.size = name in PROSE, 0, 0

    def close(self) -> None:
        """All parts are there: their hash, their characters, and whether one is prose."""
        said = [self.name, self.said]
        for p in self.parts:
            if isinstance(p, str):
                said.append(p)
                self.size += len(p)
            else:
                said.append(f"\1{p.hash}")
                self.size += p.size
                self.prose = self.prose or p.prose
        self.hash = xxhash.xxh64_intdigest("\0".join(said).encode("utf-8", "replace"))


class Open:
    """The elements that stand open, with what is asked of them at hand, so that no question costs their number."""

    def __init__(self):
        self.root = Node("")
        self.stack, self.blocks, self.names = [self.root], [], Counter()

    def push(self, name: str, said: str) -> Node:
        node = Node(name, said, self.names["article"] > 0 or self.names["main"] > 0)
        self.stack[-1].parts.append(node)
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        self.names[name] += 1
        return node

    def pop(self) -> Node:
        node = self.stack.pop()
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.names[node.name] -= 1
        node.close()
        return node

    def end(self, name: str) -> None:
        if self.names[name] > 0:
            while self.pop().name != name:
                pass

    def make_room(self, name: str) -> None:
        """A block ends an open paragraph, and what it holds, even under inline elements."""
        ends = CLOSES.get(name, set()) | {"p"}
        if self.blocks and self.stack[self.blocks[-1]].name in ends:
            at = self.blocks[-1]
            while len(self.stack) > at:
                self.pop()


def tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Behind the > that ends a tag, or -1; quotes after = hold what they hold, unless nothing closes them (found once for a page)."""
    while m := STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        q = m[0][-1]
        close = -1 if q in unclosed else page.find(q, at)
        if close < 0:
            unclosed.add(q)
        else:
            at = close + 1
    return -1


def parse(page: str) -> Node:
    """The tree: parts are strings and nodes; every closed node has its subtree's hash."""
    now, at, unclosed = Open(), 0, set()

    def behind(what: str, start: int) -> int:
        k = page.find(what, start)
        return len(page) if k < 0 else k + len(what)

    def text(a: int, b: int) -> None:
        if a < b:
            now.stack[-1].parts.append(page[a:b])

    while at < len(page):
        lt = page.find("<", at)
        text(at, len(page) if lt < 0 else lt)
        if lt < 0:
            break
        mark = page[lt + 1 : lt + 2]
        if mark == "!" or mark == "?":
            if page.startswith("<!--", lt):
                at = behind("-->", lt + 4)
            else:
                at = behind("]]>", lt + 9) if page.startswith("<![CDATA[", lt) else behind(">", lt + 2)
        else:
            ending = mark == "/"
            m = NAME.match(page, lt + 1 + ending)
            if not m:
                text(lt, lt + 1)
                at = lt + 1
                continue
            name, at = m[0].lower(), tag_end(page, m.end(), unclosed)
            if at < 0:
                break  # cut off in a tag
            said = page[m.end() : at - 1]
            if ending:
                now.end(name)
                continue
            if name in BLOCKS and name not in ("article", "main", "body", "html"):
                now.make_room(name)
            now.push(name, said)
            if name in VOID or said.endswith("/") and name not in BLOCKS:
                now.pop()
            elif name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                text(at, stop.start() if stop else len(page))
                at = stop.end() if stop else len(page)
                now.pop()
    while now.stack:
        now.pop()
    return now.root


def walk(root: Node):
    """All nodes, each with whether a marked article stands above it."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        below = inside or node.name in MAIN
        todo += [(p, below) for p in reversed(node.parts) if not isinstance(p, str)]


def subtree_hashes(page: str) -> list[int]:
    """Hashes that may be template, once each: all subtrees but the page's own frame and prose in its article."""
    out = set()
    for node, inside in walk(parse(page)):
        if node.name not in ("", "html", "body", "head", *MAIN) and node.name not in VOID and not (inside and node.prose) and any(not isinstance(p, str) or p.strip() for p in node.parts):
            out.add(node.hash)
    return sorted(out)


def _blocks(tops: list[Node], template: frozenset | set) -> tuple[list[str], int, int]:
    """The blocks of text below the given nodes without what goes; characters that went as template, and by what they are named."""
    blocks, line, gone = [], [], [0, 0]

    def flush():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in tops:
        todo = [(top, top.name in MAIN)]
        while todo:
            p, inside = todo.pop()
            if p is None:
                flush()
            elif isinstance(p, str):
                line.append(html.unescape(p))
            elif p is not top and p.hash in template and not (inside and p.prose) and p.name not in MAIN:
                gone[0] += p.size
            elif p is not top and p.no:
                gone[1] += p.size
            else:
                block = p.name in BLOCKS
                inside = inside or p.name in MAIN
                if block:
                    flush()
                    todo.append((None, inside))
                elif p.name == "br":
                    line.append(" ")
                todo += [(x, inside) for x in reversed(p.parts)]
        flush()
    return blocks, *gone


def taken(page: str, template: frozenset | set = frozenset()) -> tuple[str, int, int]:
    """(main text, characters that went as template, and by what they are named)."""
    root = parse(page)
    mains = []
    todo = [(root, False)]
    while todo:  # the outermost marked articles
        node, dead = todo.pop()
        dead = dead or node.no
        if node.name in MAIN and not dead:
            mains.append(node)
            continue
        todo += [(p, dead) for p in reversed(node.parts) if not isinstance(p, str)]
    whole, by_template, by_name = _blocks([root], template)
    marked = _blocks(mains, template)[0]
    held, all_of = sum(map(len, marked)), sum(map(len, whole))
    return "\n\n".join(whole if held < all_of - held else marked), by_template, by_name


def main_text(page: str, template: frozenset | set = frozenset()) -> str:
    return taken(page, template)[0]


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template hashes) of hosts that have any."""
    src = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("page"))

    def run(texts):
        rows, out = [], []
        for i, t in enumerate(texts):
            own = subtree_hashes(t.decode("utf-8", "replace"))
            rows += [i] * (len(own) + 1)
            out += [None, *(x - (1 << 64) if x >> 63 else x for x in own)]
        return rows, [pa.array(out, pa.int64())]

    # A null hash counts the pages themselves.
    seen = map_texts(src, "page", ["host"], [T.StructField("hash", T.LongType())], run, one_to_one=False).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = checkpointed(seen.where((F.col("n") >= min_pages) | F.col("hash").isNull()))
    size = often.where("hash is null").select("host", F.col("n").alias("pages"))
    found = often.where("hash is not null").join(size, "host").where(F.col("n") >= F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * min_share)))
    return checkpointed(found.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, url, text, n_chars, template_chars, named_chars) a page."""
    templates = site_templates(pages, url_col, html_col, min_pages, min_share)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("page"), host_of(url_col).alias("host"))
    # A template has at most (subtrees a page / min_share) hashes; so many hosts are still small enough to broadcast.
    few = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    if few <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(templates), "host", "left")
    else:  # pages of one host go to many tasks, by a salt that is a hash of the row
        salt = F.pmod(F.xxhash64("id", "url", "page"), F.lit(SALTS)).cast("int")
        both = joined_evenly(rows.withColumn("salt", salt), templates, ["host"], "salt", "left")
    src = both.select("id", "url", "template", F.col("page").cast("string").cast("binary").alias(TEXT))

    def run(batches):
        for batch in batches:
            for part in small_slices(batch, TEXT):
                got = [taken((t or b"").decode("utf-8", "replace"), {x & ((1 << 64) - 1) for x in own or ()}) for t, own in zip(part.column(TEXT).to_pylist(), part.column("template").to_pylist(), strict=True)]
                sizes = [[len(g[0]) for g in got], [g[1] for g in got], [g[2] for g in got]]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array([g[0] for g in got], pa.string()), *(pa.array(x, pa.int64()) for x in sizes)], names=["id", "url", *TAKEN])

    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), *(T.StructField(x, T.LongType()) for x in TAKEN[1:])])
    return src.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), *TAKEN)


def op5_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
