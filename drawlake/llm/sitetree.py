"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of branches (a branch's place is the path of its tags, ids and
classes). What a branch looks like on a page is the layout of its whole subtree and the order of magnitude of
its text; the entropy of that over the host's pages is its presentation importance. Its content importance is
one less the mean entropy of its text pieces, which is high where every page says something else. The product
tells how a branch counts: navigation, adverts and notices look and measure alike on every page, an article
doesn't. Branches that come to less than half of the host's most important one are cut from each page. Hosts
with few pages lean on the tree of all sites together.

Beside the tree, only what HTML itself declares goes: scripts, styles, forms, navigation, footers and the like.
Nothing inside an article or main element is cut by the tree, nor is a branch that holds most of the text.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import stored

#: A branch is cut below this share of the importance of its host's most important branch.
LEAST_SHARE = 0.5
#: Different pages that must have a branch before its host's tree, or the tree of all sites, decides on it.
LEAST_PAGES = 32
#: Presentation is complete at so many equally frequent layouts.
LAYOUTS = 16
#: A host may hold a third of all pages: they are dealt out by salt, and the host's short list to each part.
SALTS = 64
#: The tree of all sites.
ALL = "*"

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|/([A-Za-z][^\s/>]*)[^>]*>?|([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[!?][^>]*>?)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIP = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg canvas object dialog menu audio video datalist noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Whole class names and ids of what varies like an article and so can't be told by a tree: readers' comments and share bars.
_APART = frozenset("comment comments comment-list commentlist comments-area comment-section disqus_thread respond replies share sharing share-buttons share-bar social-share".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_FENCE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}
_BRANCHES = frozenset("div section ul ol dl table span center figure header footer aside nav form details fieldset blockquote".split())
_MAIN = ("article", "main")


class _Node:
    __slots__ = ("tag", "key", "skip", "main", "at", "layout", "named")

    def __init__(self, tag: str, key: str, skip: bool, main: int, at: int, named: bool):
        self.tag, self.key, self.skip, self.main, self.at, self.layout, self.named = tag, key, skip, main, at, [], named


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTR.finditer(s)}


def _boilerplate(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is, by its own account, no part of the article."""
    if tag in _SKIP or (tag == "header" and not inside):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "").lower()):
        return True
    if attrs.get("role", "").lower() in _ROLES:
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    return tag not in ("html", "body", "main") and any(name in _APART for name in names)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """One pass over a page: its blocks of text, and the branches that the site's tree is made of."""

    def __init__(self, source: str | None, cut: frozenset[int] = frozenset()):
        self.cut = cut
        self.blocks: list[tuple[str, int]] = []  # text; 2 in an article, 1 in a main element, 0 elsewhere
        self.branches: dict[int, list] = {}  # key: texts, layouts, whether it is, holds or lies in an article or main element
        self._text: list[str] = []
        self._walk(source or "")

    def _flush(self, main: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, main))
            self._text = []

    def _walk(self, s: str) -> None:
        stack: list[_Node] = [_Node("", "", False, 0, 0, False)]
        at, n = 0, len(s)

        def close(to: int) -> None:
            while len(stack) > to:
                node = stack[-1]
                if node.tag in _BLOCK:
                    self._flush(node.main)
                stack.pop()
                layout = f"{node.tag}({','.join(node.layout)})" if node.layout else node.tag
                stack[-1].layout.append(layout if len(layout) < 64 else f"{_hash(layout):x}")
                if node.named and not node.skip:
                    inside = self.blocks[node.at :]
                    b = self.branches.setdefault(_hash(node.key), [[], [], False])
                    b[0] += [t for t, _ in inside]
                    b[1].append(layout)
                    b[2] = b[2] or node.main > 0 or any(m for _, m in inside)

        for m in _TAG.finditer(s):
            if m.start() < at:
                continue
            top = stack[-1]
            if m.start() > at and not top.skip:
                piece = s[at : m.start()]
                piece = html_lib.unescape(piece) if "&" in piece else piece
                self._text.append(piece)
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                else:
                    if tag in _BLOCK and not top.skip:
                        self._flush(top.main)
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag == "br":
                if not top.skip:
                    self._text.append(" ")
                continue
            if tag in _BLOCK:
                # an open paragraph ends where a block begins; items, cells and rows end where the next one begins
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in _BLOCK or stack[k].tag == "button":
                        break
                if tag in _CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in _CLOSES[tag]:
                            close(k)
                            break
                        if stack[k].tag in _FENCE[tag]:
                            break
                top = stack[-1]
                if not top.skip:
                    self._flush(top.main)
            if tag in _VOID or (m[3] and m[3].endswith("/") and tag not in _BLOCK and tag not in _RAW):
                continue
            attrs = _attributes(m[3]) if m[3] and m[3].strip() else {}
            main = max(top.main, 2 if tag == "article" else 1 if tag == "main" or attrs.get("role", "").lower() == "main" else 0)
            name = tag + ("#" + attrs["id"] if attrs.get("id") else "") + ("." + ".".join(sorted(attrs["class"].split())) if attrs.get("class") else "")
            key = f"{top.key}/{name}"
            named = tag in _BRANCHES or tag in _MAIN or (name != tag and tag not in ("html", "body"))
            skip = top.skip or _boilerplate(tag, attrs, main > 0 and tag not in _MAIN) or (named and not main and bool(self.cut) and _hash(key) in self.cut)
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
                if tag == "textarea" and not skip:
                    self._text.append(html_lib.unescape(s[at : end.start() if end else n]))
                at = s.find(">", end.start()) + 1 or n if end else n
                continue
            stack.append(_Node(tag, key, skip, main, len(self.blocks), named))
        if at < n and not stack[-1].skip:
            piece = s[at:]
            self._text.append(html_lib.unescape(piece) if "&" in piece else piece)
        close(1)
        self._flush(0)

    def text(self, by_tree: bool = False) -> str:
        """All blocks, where a tree has decided; else those of article elements, without any those of the main element, else all."""
        for level in () if by_tree else (2, 1):
            if any(m == level for _, m in self.blocks):
                return "\n".join(t for t, m in self.blocks if m >= level)
        return "\n".join(t for t, _ in self.blocks)

    def mark(self) -> int:
        """What near-copies of a page have in common: its longest block."""
        return _hash(max((t for t, _ in self.blocks), key=len, default=""))

    def rows(self) -> list[tuple[int, int, list[int], bool]]:
        """(key, presentation, pieces of content, held) of each branch that has text; held ones must not be cut."""
        volume, out = sum(len(t) for t, _ in self.blocks), []
        for key, (texts, layouts, main) in self.branches.items():
            size = sum(map(len, texts))
            if size:
                out.append((key, _hash(f"{'|'.join(layouts)} {size.bit_length()}"), sorted({_hash(t) for t in texts}), main or 2 * size > volume))
        return out


def _branches(batches):
    kinds = [("host", pa.string()), ("page", pa.int64()), ("key", pa.int64()), ("style", pa.int64()), ("pieces", pa.list_(pa.int64())), ("held", pa.bool_())]
    for b in batches:
        rows: list[tuple] = []
        for host, source in zip(b.column("host"), b.column("html")):
            page = Page(source.as_py())
            mark = page.mark()
            rows += [(host.as_py(), mark, *row) for row in page.rows()]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], names=[k for k, _ in kinds])


def _host(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)


def importance(pages: DataFrame) -> DataFrame:
    """(host, key, pages, importance, held) of the branches of each host's tree and, as host ALL, of the tree of all sites.

    Importance is the product of presentation and content importance, each from 0 to 1. Pages of a host whose
    longest blocks are equal count once, so copies don't make an article a template. All is summed up from
    counts, so a large host is no large group.
    """
    rows = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    seen = rows.mapInArrow(_branches, "host string, page long, key long, style long, pieces array<long>, held boolean")
    seen = seen.withColumn("host", F.explode(F.array_distinct(F.array(F.lit(ALL), F.when(F.col("host") != "", F.col("host")).otherwise(F.lit(ALL))))))
    seen = seen.groupBy("host", "key", "page").agg(F.min(F.struct("style", "pieces", F.col("held").cast("int").alias("held"))).alias("s")).select("host", "key", "s.*")
    seen = stored(seen, "branches")
    total = F.sum("n")
    styles = seen.groupBy("host", "key", "style").agg(F.count("*").alias("n"), F.sum("held").alias("h")).groupBy("host", "key")
    styles = styles.agg(total.alias("pages"), (F.sum("h") * 2 > total).alias("held"), ((F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.log(F.least(total, F.lit(LAYOUTS)))).alias("presentation"))
    pieces = seen.select("host", "key", F.explode("pieces").alias("piece")).groupBy("host", "key", "piece").agg(F.count("*").alias("n")).groupBy("host", "key")
    pieces = pieces.agg((F.sum(F.col("n") * F.log("n")) / total).alias("shared"))
    both = styles.where("pages > 1").join(pieces, ["host", "key"])
    content = 1 - F.col("shared") / F.log("pages")
    return both.select("host", "key", "pages", (F.least("presentation", F.lit(1.0)) * content).alias("importance"), "held")


def decisions(tree: DataFrame) -> DataFrame:
    """(host, cut): the branches to cut of every host of whose branches any is decided, by its own tree or by that of all sites."""
    best = tree.where(F.col("pages") >= LEAST_PAGES).groupBy("host").agg(F.max("importance").alias("most"))
    judged = tree.join(best, "host", "left").withColumn("low", F.when(F.col("pages") >= LEAST_PAGES, ~F.col("held") & (F.col("importance") < LEAST_SHARE * F.col("most"))))
    common = judged.where((F.col("host") == ALL) & F.col("low").isNotNull()).select("key", F.col("low").alias("low_anywhere"))
    rows = judged.join(common, "key", "left").withColumn("low", F.coalesce("low", "low_anywhere")).where("low is not null")
    return rows.groupBy("host").agg(F.sort_array(F.collect_set(F.when(F.col("low"), F.col("key")))).alias("cut"))  # a template's nodes: few for any host


def article(source: str | None, cut: list[int] | None = None) -> str:
    """A page's main text; ``cut`` are the branches that its site's tree cuts, None where there is no tree."""
    return Page(source, frozenset(cut or ())).text(by_tree=cut is not None)


def _extracted(batches):
    for b in batches:
        texts = [article(source.as_py(), cut.as_py()) for source, cut in zip(b.column("html"), b.column("cut"))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null, empty and text-less pages give an empty text. Pages without a host belong to the tree of all sites.
    Where no tree knows a branch of the host (LEAST_PAGES different pages), a page's own article or main
    element is taken. Repeated rows give equal texts; null ids pass; other columns are ignored.
    """
    cut = decisions(stored(importance(pages), "style-tree")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = stored(cut, "low-branches")
    host = _host(F.col("url"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.when(host != "", host).otherwise(F.lit(ALL)).alias("host"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(cut, ["host", "salt"], "left").select("page_id", "url", "html", "cut")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long")
