"""HTML extraction by composite text density.

A page becomes a tree of its structural elements (inline formatting only passes its text on; scripts, styles, forms,
navigation and what is marked as advert, sidebar, notice or comment is left out). For every node the characters per tag
are adjusted by its links:

    density = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e))

with C characters, T tags, LC characters in links, LT links of the subtree (0 counts as 1). A node's density sum is that
of its children. The node of the largest sum is taken; the least density on its path to body is the threshold. From
body down, each node that reaches the threshold contributes the node of largest sum in its subtree, so that parts of an
article beside the first one are found too. The chosen subtrees' text blocks, in page order, are the result.

One pass in mapInArrow, a page at a time: no shuffle, memory of a batch.

Defined cases: null or empty html, or a page without text, gives an empty text; broken markup is read leniently; pages
and attributes of any length are read whole;
repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.llm.common import in_arrow

# a quoted value, which may hold >, is read to its closing quote, whatever its length
_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^<>])*+)>|[!?/][^<>]*+>)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_MARKING = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")

#: Kinds of elements, and words in class, id or role that mark what isn't the article.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas form button select textarea input nav footer aside dialog menu link meta base title".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside cookie cookies consent gdpr notice alert comment comments commentlist disqus respond nav navbar navigation "
    "menu breadcrumb breadcrumbs footer share sharing social related recommended newsletter subscribe subscription popup modal overlay widget masthead login signup search pagination pager toolbar contentinfo complementary skip".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Page:
    """The tree in lists by node number; parents come before their children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.blocks = ["body"], [-1], []  # blocks: (node, text parts)
        self.links, self.link_chars, self.chars, self.tags = [0], [0], [0], [0]
        self._open, self._dropped, self._in_link, self._inline = [0], 0, 0, [0]
        self._parts: list[str] = []
        self._drop_stack: list[str] = []
        self._read(source)
        self._flush()
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.links[p] += self.links[i]
            self.link_chars[p] += self.link_chars[i]
            self.tags[p] += self.tags[i] + 1

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        self._parts = []
        if text:
            self.blocks.append((self._open[-1], text))
            self.chars[self._open[-1]] += len(text)

    def _text(self, text: str) -> None:
        if self._drop_stack or not text:
            return
        text = html.unescape(text)
        self._parts.append(text)
        if self._in_link:
            self.link_chars[self._open[-1]] += len(text.strip())

    def _inside(self, names) -> bool:
        return any(self.tag[i] in names for i in self._open)

    def _unwanted(self, name: str, attrs: str) -> bool:
        if name in DROPPED:
            return True
        if name == "header":
            return not self._inside(("article", "main"))
        if name in ("article", "main", "body", "html"):
            return False
        if attrs:
            for m in _ATTR.finditer(attrs):
                value = (m[2] or m[3] or m[4] or "").lower()
                kind = m[1].lower()
                if kind not in _MARKING:
                    continue
                if kind == "hidden" or kind == "aria-hidden" and value == "true":
                    return True
                if not MARKS.isdisjoint(_SPLIT.split(value)):
                    return True
        return False

    def _close_to(self, depth: int) -> None:
        self._flush()
        del self._open[depth:]

    def _start(self, name: str, attrs: str) -> None:
        if self._drop_stack:
            if name == self._drop_stack[-1] and name not in VOID:
                self._drop_stack.append(name)
            return
        if name in INLINE:
            if name == "br":
                self._parts.append(" ")
            elif name == "a":
                self._in_link = 1
                self.links[self._open[-1]] += 1
            if name not in VOID and self._unwanted(name, attrs):
                self._drop_stack.append(name)
            return
        if name in ("html", "body"):
            return
        self._in_link = 0
        if name in CLOSES_P and self.tag[self._open[-1]] == "p":
            self._close_to(len(self._open) - 1)
        elif name in SELF_CLOSING:
            for d in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[d]] in SELF_CLOSING[name]:
                    break
                if self.tag[self._open[d]] == name:
                    self._close_to(d)
                    break
        self._flush()
        if self._unwanted(name, attrs):
            if name not in VOID:
                self._drop_stack.append(name)
            return
        if name in VOID:
            self.tags[self._open[-1]] += 1
            return
        self.tag.append(name)
        self.parent.append(self._open[-1])
        for values in (self.links, self.link_chars, self.chars, self.tags):
            values.append(0)
        self._open.append(len(self.tag) - 1)

    def _end(self, name: str) -> None:
        if self._drop_stack:
            if name == self._drop_stack[-1]:
                self._drop_stack.pop()
            elif name in ("body", "html"):
                self._drop_stack.clear()
            return
        if name == "a":
            self._in_link = 0
        if name in INLINE:
            return
        for d in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[d]] == name:
                self._close_to(d)
                return

    def _read(self, source: str) -> None:
        at = 0
        while (m := _TAG.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["close"]:
                self._end(name)
                continue
            self._start(name, m["attrs"])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(source, at)
                stop = end.start() if end else len(source)
                at = stop
        self._text(source[at:])

    def densities(self) -> list[float]:
        body_share = self.link_chars[0] / self.chars[0] if self.chars[0] else 0.0
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.links, strict=True):
            if not c:
                out.append(0.0)
                continue
            t, plain = max(1, t), max(1, c - lc)
            base = math.log(math.log(c / plain * lc + body_share * c + math.e) + 1e-9)
            ratio = math.log(max(1.0 + 1e-9, c / max(1, lc) * t / max(1, lt)))
            out.append(c / t * ratio / max(base, 0.1))
        return out

    def content(self) -> set[int]:
        """The nodes of the chosen subtrees. The node of the largest density sum gives the threshold, the least density on its
        path to body. From body down, as long as nodes reach the threshold, each contributes its subtree's node of largest sum."""
        density, n = self.densities(), len(self.tag)
        sums = [0.0] * n
        for i in range(n - 1, 0, -1):
            sums[self.parent[i]] += density[i]
        top = list(range(n))  # of each subtree
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if (sums[top[i]], -top[i]) > (sums[top[p]], -top[p]):
                top[p] = top[i]
        threshold, i = density[top[0]], top[0]
        while i >= 0:
            threshold = min(threshold, density[i])
            i = self.parent[i]
        chosen, reached = {top[0]}, {0}
        for i in range(1, n):
            if self.parent[i] in reached and self.chars[i] and density[i] >= threshold:
                reached.add(i)
                chosen.add(top[i])
        for i in range(min(chosen) + 1, n):
            if self.parent[i] in chosen:
                chosen.add(i)
        return chosen

    def text(self) -> str:
        inside = self.content() if self.chars[0] else set()
        return "\n".join(t for i, t in self.blocks if i in inside)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return in_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
