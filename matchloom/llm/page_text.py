"""Main text of web pages, by container paths that the pages of a host agree on."""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.scratch import written
from matchloom.session import table

#: With at most so many hosts, their paths are broadcast (a few MB at most); with more, hosts are joined by salted keys.
BROADCAST_HOSTS, HOST_SALTS = 50_000, 32
#: An element that holds so large a share of a page's text is not taken for boilerplate because of its class; one that holds
#: nearly all not even if its class says nothing else.
MOST_TEXT, ALL_TEXT = 0.5, 0.95
#: A weak class word counts where so large a share of the element's text is links.
LINKED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|button|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</[^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body center details div main section table tbody td tr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILER_TAG = frozenset("aside dialog footer form head menu nav".split())
_BOILER_ROLE = frozenset("alert banner complementary contentinfo dialog menu navigation search".split())
#: Class words that speak for boilerplate, and those that do so only for elements full of links.
_BOILER_WORD = frozenset(
    "ad ads adslot advert adverts advertisement banner bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright cta disclaimer disqus dropdown footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notification "
    "outbrain overlay paging pagination pager popup promo promotion replies respond responses sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola teaser teasers toolbar topbar".split()
)
_WEAK_WORD = frozenset("alert discussion feedback links reader recommended related remark reply search share tags trending widget".split())
#: First words of classes that tell a state or a topic of an element, not what it is.
_STATE_WORD = frozenset("category format has hide is no not show status tag theme topic type with without".split())
_MAIN_WORD = frozenset("article articlebody body content entry main post story text".split())
#: A start tag of the first kind ends an open element of the second kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def class_level(names: str) -> int:
    """How strongly classes and ids speak for boilerplate: 3 a class that is a boiler word, 2 one that begins or ends with it,
    1 one with a weak word, 0 none. Classes that begin with a word of state or topic say nothing."""
    level = 0
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words or words[0] in _STATE_WORD and len(words) > 1:
            continue
        if words[0] in _BOILER_WORD and len(words) == 1:
            return 3
        if words[0] in _BOILER_WORD or words[-1] in _BOILER_WORD:
            level = 2
        elif _WEAK_WORD & {words[0], words[-1]}:
            level = max(level, 1)
    return level


@dataclass
class Node:
    parent: int
    tag: str
    label: str
    boiler: bool
    level: int
    main: bool
    header: bool
    inline: bool = False


@dataclass
class Block:
    node: int
    text: str
    link_chars: int


@dataclass
class Page:
    """Elements, each after its parent, and text blocks in page order. settle() works out, from the top down and in linear
    time, what holds for each element because of those around it."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def settle(self) -> None:
        nodes = self.nodes
        chars, links = [0] * len(nodes), [0] * len(nodes)
        for block in self.blocks:
            if block.node >= 0:
                chars[block.node] += len(block.text)
                links[block.node] += block.link_chars
        outside = [n.boiler for n in nodes]  # by tag, an ancestor's included
        for k, node in enumerate(nodes):
            outside[k] = outside[k] or node.parent >= 0 and outside[node.parent]
        total = sum(len(b.text) for b in self.blocks if b.node < 0 or not outside[b.node])
        for k in range(len(nodes) - 1, -1, -1):
            if (parent := nodes[k].parent) >= 0 and not (nodes[k].boiler and not nodes[parent].boiler):
                chars[parent] += chars[k]
                links[parent] += links[k]
        self.keys: list[bytes] = []  #: of the path from the root: tags and classes, digits as #
        self.boiler: list[int] = []  #: the innermost boilerplate element around, itself included; -1 if none
        self.header: list[int] = []  #: likewise the innermost header
        self.holder: list[int] = []  #: likewise the innermost container
        self.main: list[int] = []  #: likewise the innermost main container
        for k, node in enumerate(nodes):
            up = node.parent
            share = chars[k] / total if total else 0.0
            named = node.level == 3 and share < ALL_TEXT or node.level == 2 and share < MOST_TEXT or node.level == 1 and share < MOST_TEXT and links[k] > LINKED * max(1, chars[k])
            boiler = node.boiler or named and not (node.main and node.level < 3)
            above = self.keys[up] if up >= 0 else b""
            self.keys.append(above if node.inline or k == 0 else hashlib.blake2b(above + node.label.encode(), digest_size=8).digest())
            self.boiler.append(k if boiler else self.boiler[up] if up >= 0 else -1)
            self.header.append(k if node.header else self.header[up] if up >= 0 else -1)
            self.holder.append(k if k == 0 or node.tag in _CONTAINER else self.holder[up] if up >= 0 else -1)
            self.main.append(k if node.main and not boiler else self.main[up] if up >= 0 else -1)


def path_key(labels: list[str]) -> bytes:
    """The key of a path, from the root's label down."""
    key = b""
    for label in labels:
        key = hashlib.blake2b(key + label.encode(), digest_size=8).digest()
    return key


def parse(source: str) -> Page:
    """Elements and text blocks in page order; broken and cut-off markup is read as far as it goes."""
    page = Page()
    nodes, stack = page.nodes, [0]
    nodes.append(Node(-1, "", "", False, 0, False, False))  # the root holds what stands outside all elements
    opened: Counter[str] = Counter()
    words: list[str] = []
    link_chars = link = 0

    def flush() -> None:
        nonlocal link_chars
        if words:
            if text := " ".join("".join(words).split()):
                page.blocks.append(Block(stack[-1], text, link_chars))
            words.clear()
        link_chars = 0

    def take(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html_module.unescape(raw) if "&" in raw else raw
            if not (stack[-1] >= 0 and nodes[stack[-1]].inline):
                words.append(text)
                link_chars += len(text) if link else 0

    def cut(depth: int) -> None:
        for n in stack[depth:]:
            opened[nodes[n].tag] -= 1
        del stack[depth:]

    at = 0
    for m in _TOKEN.finditer(source):
        take(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag == "a":
                link = 0
            if tag in _BLOCK or stack[-1] >= 0 and nodes[stack[-1]].inline:
                if tag in _BLOCK:
                    flush()
                if opened[tag]:
                    cut(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag == "a":
            link = 1
        block = tag in _BLOCK
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m["attrs"])} if m["attrs"].strip(" /") else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
        level = class_level(names) if names.strip() and tag not in ("html", "body") else 0
        hides = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""))
        boiler = tag not in ("html", "body") and (tag in _BOILER_TAG and tag != "header" or hides or attrs.get("role", "") in _BOILER_ROLE)
        inline = not block and (boiler or level >= 2)
        if not block and not inline or tag in _VOID:
            continue
        if block:
            flush()
            link = 0
            if nodes and stack[-1] >= 0 and nodes[stack[-1]].tag == "p":
                cut(len(stack) - 1)
            ends = _ENDS.get(tag)
            for i in range(len(stack) - 1, 0, -1) if ends and any(opened[t] for t in ends) else ():
                if nodes[stack[i]].tag in ends:
                    cut(i)
                    break
                if nodes[stack[i]].tag in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()))
        main = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        header = tag == "header" or any(c.split("-")[-1].split("_")[-1] == "header" for c in names.lower().split())
        nodes.append(Node(stack[-1], tag, f"{tag}.{classes}" if classes else tag, boiler, level, main, header, inline))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    tail = source[at:]
    take(tail[: tail.rfind("<")] if re.search(r"<[a-zA-Z/!?][^>]*\Z", tail) else tail)
    flush()
    page.settle()
    return page


def is_boiler(page: Page, block: Block, top: int = -1) -> bool:
    """Whether an element between the block and top (excluded) is boilerplate; of a header only headings are text."""
    if block.node < 0:
        return False
    in_header = page.header[block.node] > top and not (top >= 0 and page.nodes[block.node].tag in _HEADING)
    return page.boiler[block.node] > top or in_header


def container_scores(page: Page) -> dict[int, float]:
    """A score for each element that holds text: long, punctuated blocks with few links speak for what holds them."""
    scores: dict[int, float] = {}
    for block in page.blocks:
        if is_boiler(page, block):
            continue
        n = len(block.text)
        value = (0.2 + block.text.count(",") + block.text.count(".") + min(n / 100, 3.0)) * (1 - min(1.0, block.link_chars / n))
        holder = page.holder[block.node] if block.node >= 0 else -1
        for share in (1.0, 0.5):
            if holder < 0:
                break
            node = page.nodes[holder]
            named = set(re.split(r"[^a-z]+", node.label)) & _MAIN_WORD and node.tag != "body"
            scores[holder] = scores.get(holder, 0.0) + value * share * (1.25 if named else 1.0)
            holder = page.holder[node.parent] if node.parent >= 0 and node.tag != "body" else -1
        if block.node >= 0 and (main := page.main[block.node]) >= 0:
            scores[main] = scores.get(main, 0.0) + 1.5 * value
    return scores


def text_under(page: Page, tops: set[int]) -> str:
    """The blocks under the given elements, in page order."""
    outermost: list[int] = []
    for k, node in enumerate(page.nodes):
        above = outermost[node.parent] if node.parent >= 0 else -1
        outermost.append(above if above >= 0 else k if k in tops else -1)
    return "\n".join(b.text for b in page.blocks if b.node >= 0 and (top := outermost[b.node]) >= 0 and not is_boiler(page, b, top))


def extract(source: str, path: bytes | None) -> str:
    """The text under the elements with the key of the host's path; a page without one uses its own best container."""
    page = parse(source)
    text = text_under(page, {n for n, key in enumerate(page.keys) if key == path and not page.nodes[n].inline}) if path else ""
    if not text and (scores := container_scores(page)):
        text = text_under(page, {max(scores, key=lambda n: (scores[n], -n))})
    return text


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: for each host the key of the container path to which its pages give the largest share of their scores.

    Every container of a page votes with its share. Votes are added by (host, path) before and after the shuffle, so the pages of a large host are never together.
    """

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, paths, shares = [], [], []
            for row, source in enumerate(batch.column(1)):
                page = parse(source.as_py() or "")
                scores = container_scores(page)
                total = sum(scores.values())
                for n in sorted(scores):
                    rows.append(row)
                    paths.append(page.keys[n])
                    shares.append(scores[n] / total if total else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(paths, pa.binary()), pa.array(shares, pa.float64())], ["host", "path", "share"])

    cast = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(votes, "host string, path binary, share double")
    return (
        cast.groupBy("host", "path")
        .agg(F.sum("share").alias("share"))
        .groupBy("host")
        .agg(F.max(F.struct(F.round("share", 6).alias("share"), "path")).alias("best"))
        .select("host", F.col("best.path").alias("path"))
    )


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def page_text(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars; the main text, blocks joined by one newline.

    Null html: empty text. Null url: the pages without a host vote together. Repeated rows vote and each return their row;
    paths with equal votes: the larger key. What stands outside all elements, as in a page without a body, is under the
    page's root; very long and very deep pages
    take time in proportion to their length. An empty table returns no rows. Other columns are ignored.
    """

    @F.pandas_udf("string")
    def extracted(sources, paths):
        return sources.combine(paths, lambda source, path: extract(source or "", path))

    paths = written(host_paths(pages, url_col, html_col))
    rows = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    if paths.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(HOST_SALTS)).cast("int"))
        dealt = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
        joined = rows.join(dealt, ["host", "salt"], "left")
    return joined.select("page_id", "url", extracted("html", "path").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))
