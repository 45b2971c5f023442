"""Text of web pages without the site's template.

Every element's subtree (tag, attributes, text and subtrees below) is hashed; Spark counts beside how many different main
contents of its host a subtree occurs, so copies of a page or article count once; subtrees that recur beside many are
deleted, and what is left becomes text. The main content is the element that holds most of a page's text; what is inside
it is template only if most main contents of the host have it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import scan, table, written

#: A subtree is template if it is on so many pages of its host, and on such a share of them.
MIN_PAGES, MIN_SHARE = 4, 0.005
#: So many are enough on any host, however large: a section of it has its own template.
MANY_PAGES = 50
#: The share that makes a subtree inside the main content template.
MAIN_SHARE = 0.5
#: Template tables of up to so many bytes are broadcast; larger ones are joined.
BROADCAST_BYTES = 32 << 20
#: What is no element, and a tag: only after an equals sign does a quote begin a value, which may hold what ends a tag. No
#: quantifier gives anything back, so nothing is read twice.
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?+", re.S)
_TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_HIDDEN = frozenset("script style noscript template iframe svg head title textarea select".split())
_BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split()
)
_PAGE = frozenset(("", "html", "body"))
#: The main content is none of these, and isn't sought in _WHOLE.
_ASIDE = frozenset("nav header footer aside form menu".split())
_WHOLE = frozenset("article main p h1 h2 h3 h4 h5 h6 li td pre blockquote table ul ol dl".split())
#: Mixed into the digest of a subtree inside the main content.
_INSIDE = 0x9E3779B97F4A7C15
#: An opening tag of these ends an open element of the others.
_ENDS = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_ENDS |= {t: {"p"} for t in _BLOCK - set(_ENDS) - {"br", "html", "body"}}


@dataclass
class Element:
    tag: str
    attributes: str
    children: list[Element | str]
    digest: int = 0
    #: Whether it can be template: it has text below, and isn't the page itself.
    countable: bool = False
    #: Characters of visible text below.
    size: int = 0

    def close(self) -> None:
        h = blake2b(f"{self.tag} {self.attributes}>".encode("utf-8", "surrogatepass"), digest_size=8)
        for child in self.children:
            if isinstance(child, Element):
                h.update(b"\x01" + child.digest.to_bytes(8, "little"))
                self.countable |= child.countable
                self.size += child.size
            elif text := _SPACE.sub(" ", child).strip():
                h.update(b"\x02" + text.encode("utf-8", "surrogatepass"))
                self.countable = True
                self.size += len(text)
        self.digest = int.from_bytes(h.digest(), "little")
        if self.tag in _HIDDEN:
            self.countable, self.size = False, 0


def parse(source: str) -> Element:
    """The tree of a page under a root without tag. Comments and declarations are dropped, open elements end with their
    parent, closing tags without an opening one are ignored; anything is accepted, in time proportional to its length. After
    a quote that hides the end of a tag to the end of the page, quotes no longer count; a tag that never ends is text."""
    root = Element("", "", [])
    stack, open_, at, look = [root], Counter(), 0, 0
    tag_of = _TAG

    def pop() -> None:
        element = stack.pop()
        open_[element.tag] -= 1
        element.close()

    while (start := source.find("<", look)) >= 0:
        second = source[start + 1 : start + 2]
        if second in "!?" and second:
            m, tag = _OTHER.match(source, start), ""
        else:
            m = tag_of.match(source, start)
            if m is None and tag_of is _TAG and re.match(r"</?[a-zA-Z]", source[start : start + 3]):
                tag_of = _PLAIN_TAG
                m = tag_of.match(source, start)
                if m is None:
                    break
            if m is None:
                if tag_of is _PLAIN_TAG and source.find(">", start) < 0:
                    break
                look = start + 1
                continue
            tag = m[2].lower()
        if start > at:
            stack[-1].children.append(source[at:start])
        at = look = m.end()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if open_[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        while len(stack) > 1 and stack[-1].tag in _ENDS.get(tag, ()):
            pop()
        rest = m[3].rstrip()
        element = Element(tag, _SPACE.sub(" ", rest.rstrip("/")).strip(), [])
        stack[-1].children.append(element)
        if tag in _VOID or rest.endswith("/"):
            element.close()
        elif tag in _RAW:
            end = _RAW[tag].search(source, at)
            element.children.append(source[at : end.start() if end else len(source)])
            at = look = end.end() if end else len(source)
            element.close()
        else:
            stack.append(element)
            open_[tag] += 1
    if at < len(source):
        stack[-1].children.append(source[at:])
    while stack:
        pop()
    return root


def elements(root: Element) -> Iterator[Element]:
    """All elements below root."""
    todo: list[Element | str] = list(root.children)
    while todo:
        e = todo.pop()
        if isinstance(e, Element):
            yield e
            todo += e.children


def main_content(root: Element) -> Element:
    """The element that holds more than half of the page's text and isn't cut any smaller; root, if there is none."""
    at = root
    while at.tag not in _WHOLE:
        inner = next((e for e in at.children if isinstance(e, Element) and 2 * e.size > root.size and e.tag not in _ASIDE), None)
        if inner is None:
            break
        at = inner
    return root if at.tag in _PAGE else at


def page_text(root: Element, template: frozenset[int] | set[int]) -> tuple[str, int]:
    """The visible text without the subtrees of template, a line for each block, and how many subtrees were deleted."""
    parts: list[str] = []
    removed = 0
    main, left_main = main_content(root), Element("", "", [])
    inside = 0
    todo: list[Element | str] = [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            parts.append(e)
        elif e is left_main:
            inside = 0
        elif e.countable and e.tag not in _PAGE and e.digest ^ inside in template:
            removed += 1
            parts.append("\n" if e.tag in _BLOCK else "")
        elif e.tag not in _HIDDEN:
            edge = ["\0"] if e.tag in _BLOCK else []
            if e is main and e is not root:
                inside = _INSIDE
                todo.append(left_main)
            todo += [*edge, *reversed(e.children), *edge]
    lines = "".join(_SPACE.sub(" ", html.unescape(p)) if p not in ("\0", "\n") else "\0" for p in parts).split("\0")
    return "\n".join(x for line in lines if (x := _SPACE.sub(" ", line).strip())), removed


def hosts(pages: DataFrame) -> DataFrame:
    """(page_id, host, html): the host of the URL in lower case, without port; the empty string if it has none."""
    url = F.lower(F.trim(F.coalesce(F.col("url").cast("string"), F.lit(""))))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))


def _page_digests(source: str | None) -> tuple[set[int], set[int], int]:
    """The subtrees, as page_text looks for them: outside and inside the main content; and the digest of that."""
    root = parse(source or "")
    main = main_content(root)
    within = {id(e) for e in elements(main)} if main is not root else set()
    outside, inside = set(), set()
    for e in elements(root):
        if e.countable and e.tag not in _PAGE:
            inside.add(e.digest ^ _INSIDE) if id(e) in within else outside.add(e.digest)
    return outside, inside, main.digest


def template_subtrees(named: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, digest) of the subtrees beside at least min_pages different main contents of the host and min_share of them,
    or MANY_PAGES; inside the main contents, in min_pages and MAIN_SHARE of them. Subtrees without text and the body
    itself don't count. Pages without host share nothing."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, digests, mains, places = [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            outside, inside, main = _page_digests(source)
            own = [*outside, *inside]
            names += [host] * len(own)
            digests += own
            mains += [main] * len(own)
            places += [False] * len(outside) + [True] * len(inside)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.uint64()).view(pa.int64()), pa.array(mains, pa.uint64()).view(pa.int64()), pa.array(places, pa.bool_())], ["host", "digest", "main", "inside"])

    usable = named.where("host <> '' and html is not null")
    seen = written(scan(usable.select("host", "html"), run, "host string, digest long, main long, inside boolean").distinct())
    counted = seen.groupBy("host", "digest", "inside").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    size = seen.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("all"))
    enough = F.when(F.col("inside"), MAIN_SHARE * F.col("all")).otherwise(F.least(F.lit(float(MANY_PAGES)), min_share * F.col("all")))
    return counted.join(size, "host").where(F.col("pages") >= enough).select("host", "digest").distinct()


def _texts(named: DataFrame, template: DataFrame, broadcast_bytes: int) -> DataFrame:
    spark, schema = named.sparkSession, "page_id long, host string, text string, removed long"
    names = ["page_id", "host", "text", "removed"]

    def rows(batch: pa.RecordBatch, subtrees) -> Iterator[pa.RecordBatch]:
        done = [page_text(parse(source or ""), known) for source, known in zip(batch.column(2).to_pylist(), subtrees)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names)

    if template.count() * 48 <= broadcast_bytes:
        by_host: dict[str, set[int]] = {}
        for host, digest in template.toLocalIterator():
            by_host.setdefault(host, set()).add(digest % (1 << 64))
        shared, nothing = spark.sparkContext.broadcast(by_host), frozenset()
        return scan(named, lambda batch: rows(batch, (shared.value.get(h, nothing) for h in batch.column(1).to_pylist())), schema)

    # a page's own template subtrees are joined to it: few, whatever the host has
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pages, keys, names, digests = [], [], [], []
        for page, key, host, source in zip(*(batch.column(i).to_pylist() for i in range(4))):
            outside, inside, _ = _page_digests(source)
            own = outside | inside
            for out, value in ((pages, page), (keys, key), (names, host)):
                out += [value] * len(own)
            digests += own
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(digests, pa.uint64()).view(pa.int64())], ["p", "k", "host", "digest"])

    keyed = named.withColumn("key", F.xxhash64("host", "html"))
    seen = scan(keyed.select("page_id", "key", "host", "html"), run, "p long, k long, host string, digest long")
    hits = seen.join(template, ["host", "digest"]).groupBy("p", "k").agg(F.collect_set("digest").alias("subtrees"))
    joined = keyed.join(hits, keyed["page_id"].eqNullSafe(hits["p"]) & (F.col("key") == F.col("k")), "left").select("page_id", "host", "html", "subtrees")
    return scan(joined, lambda batch: rows(batch, ({d % (1 << 64) for d in x.as_py() or ()} for x in batch.column(3))), schema)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, text, removed) for each row of pages (page_id, url, html, anything else): the visible text after the
    template of the page's host is deleted, and how many subtrees that took away.

    Null and empty pages have the empty text. A URL that is null or has no host gives the host '' and no template. A null
    page_id is carried. Repeated rows repeat in the result."""
    named = hosts(pages)
    return _texts(named, written(template_subtrees(named, min_pages, min_share)), broadcast_bytes)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return extract(table(spark, sf_dir, "pages"))
