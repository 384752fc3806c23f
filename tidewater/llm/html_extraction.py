"""Main text of web pages, by a consensus of each host's pages on where it lies."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.session import small, staged

# HTML's element names by role, and the names that pages give to what is not the article.
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article blockquote body center dd details div dl figure html li main ol pre section table tbody td th tr ul".split())
NEVER = set("nav header footer aside head button select textarea iframe svg math canvas object video audio noscript template dialog search menu script style title".split())
RAW = set("script style textarea title iframe noscript template xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("article body div section main ul ol dl table blockquote html td th".split())
CELL_SCOPE = SCOPE - {"td", "th"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription nav navbar navigation menu menus breadcrumb breadcrumbs header footer masthead topbar sidebar aside widget widgets related recommended "
    "share sharing social comment comments disqus respond reply replies login signup search searchform form pagination pager skip toolbar".split()
)
CONTENT = set("content body text main wrapper wrap container page layout article story post entry column columns inner".split())
MODIFIES = set("has with no is without".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARK = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][^\s=/>"']*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[a-z0-9]+")
HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

#: Containers of a page that vote, at most.
VOTES = 3


def noisy(attributes: str) -> tuple[str, bool]:
    """(how a path shows the element's class and id, whether they say that it is not part of the article)."""
    shown, noise = "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for one in value.lower().split():
                parts = NAMES.findall(one)
                shown += ("." if name == "class" else "#") + re.sub(r"\d+", "0", one)
                if parts and parts[0] not in MODIFIES and parts[-1] not in CONTENT:
                    noise |= not NOISE.isdisjoint(parts)
        elif name == "role":
            noise |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noise = True
        elif name == "style":
            noise |= "display:none" in value.lower().replace(" ", "")
    return shown, noise


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag, comment and declaration; the name of the latter two is
    empty. A quote that is never closed is no quote: then the tag ends at the first ">". Each character is looked at a
    bounded number of times, whatever is left open."""
    at, n = source.find("<"), len(source)
    last = {c: source.rfind(c) for c in ">\"'"}
    plain = 0  # up to here quotes don't count, as one that is not closed is about to come
    while at >= 0:
        if source.startswith("<!--", at):
            ends = [(x, len(mark)) for mark in ("-->", "--!>") if (x := source.find(mark, at + 4)) >= 0]
            end = min(x + k for x, k in ends) if ends else n
            yield at, end, "", False, ""
        elif at > last[">"]:
            return  # no tag ends any more
        elif source[at + 1 : at + 2] in ("!", "?") or source.startswith("</", at) and not NAME.match(source, at + 2):
            end = source.index(">", at) + 1
            yield at, end, "", False, ""
        elif m := NAME.match(source, at + 1 + (closes := source.startswith("</", at))):
            where, end = m.end(), -1
            while at >= plain and (mark := MARK.search(source, where)):
                if mark[0] == ">":
                    end = mark.end()
                    break
                where = source.find(mark[0], mark.end()) + 1 if last[mark[0]] >= mark.end() else 0
                if not where:
                    plain = mark.end()
                    break
            if end < 0:
                first = source.find(">", m.end())
                if first < 0:
                    return
                end = first + 1
            yield at, end, m[0].lower(), closes, source[m.end() : end - 1]
        else:
            end = at + 1
        at = source.find("<", end)


class Page:
    """A page's elements and blocks of text, read in one pass that forgives what is left open. Elements are numbered as they
    open; each knows its parent and its own step of the path, so a page takes memory in proportion to its length."""

    def __init__(self, source: str):
        self.parent, self.tag, self.step, self.depth, self.sum, self.hidden = [-1], [""], [""], [0], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self.stack, self.buffer, self.linked, self.in_link = [0], [], 0, False
        self.places: dict[str, list[int]] = {}  # places in the stack, by tag
        self.scopes, self.cell_scopes = [0], [0]  # and of what bounds a search
        self.read(source)
        self.hide_forms()

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            if text:
                self.blocks.append((self.stack[-1], text, self.linked))
            self.buffer, self.linked = [], 0

    def last(self, tag: str) -> int:
        """The highest place in the stack of an element with this tag; 0: none."""
        there = self.places.get(tag)
        return there[-1] if there else 0

    def add(self, tag: str, step: str, hidden: bool) -> None:
        above = self.stack[-1]
        self.parent.append(above)
        self.tag.append(tag)
        self.step.append(step)
        self.depth.append(self.depth[above] + 1)
        self.sum.append(zlib.crc32(f"/{step}".encode("utf-8", "surrogatepass"), self.sum[above]))
        self.hidden.append(hidden)

    def push(self) -> None:
        tag, place = self.tag[-1], len(self.stack)
        self.places.setdefault(tag, []).append(place)
        if tag in SCOPE:
            self.scopes.append(place)
            if tag in CELL_SCOPE:
                self.cell_scopes.append(place)
        self.stack.append(len(self.tag) - 1)

    def cut(self, k: int) -> None:
        """The stack without what lies at k and above."""
        while len(self.stack) > k:
            self.places[self.tag[self.stack.pop()]].pop()
        for scopes in (self.scopes, self.cell_scopes):
            while scopes[-1] >= k:
                scopes.pop()

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        ended = max(map(self.last, (*ENDS_SAME.get(tag, ()), "p")))
        if ended and ended >= (self.cell_scopes if tag in ("td", "th", "tr") else self.scopes)[-1]:
            self.cut(ended)
        shown, noise = noisy(attributes) if attributes.strip() else ("", False)
        keeps = tag in ("html", "body", "article", "main")
        self.add(tag, tag + shown, self.hidden[self.stack[-1]] or tag in NEVER or noise and not keeps)
        if tag not in VOID:
            self.push()

    def close(self, tag: str) -> None:
        if k := self.last(tag):
            self.flush()
            self.cut(k)

    def text(self, raw: str) -> None:
        if raw and not self.hidden[self.stack[-1]]:
            self.buffer.append(raw)
            if self.in_link:
                self.linked += len(raw)

    def read(self, source: str) -> None:
        at = 0
        for start, end, tag, closes, attributes in tags(source):
            if start < at:
                continue  # in a script or the like
            self.text(source[at:start])
            at = end
            if not tag:
                continue
            if closes:
                if tag == "a":
                    self.in_link = False
                elif tag in BLOCK or tag in NEVER:
                    self.close(tag)
                elif k := self.skipped(tag):
                    self.cut(k)
                continue
            if tag in RAW:
                at = self.raw_end(source, tag, at)
            elif tag == "br":
                self.text("\n")
            elif tag == "a":
                self.in_link = True
            elif tag in BLOCK or tag in NEVER:
                self.open(tag, attributes)
            elif tag not in VOID and (attributes and noisy(attributes)[1] or self.skipped(tag)):
                self.skip_inline(tag)
        self.text(source[at:])
        self.flush()

    @staticmethod
    def raw_end(source: str, tag: str, at: int) -> int:
        """Behind the end tag of a script or the like; the end of the page, if it has none."""
        end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
        return end.end() if end else len(source)

    def hide_forms(self) -> None:
        """A form is hidden, unless it wraps the page: it holds an article, a main element or a first heading, or a paragraph and
        half of the text."""
        if "form" not in self.tag:
            return
        n = len(self.tag)
        size, paragraphs, main = [0] * n, [0] * n, [False] * n
        for at, text, _ in self.blocks:
            size[at] += len(text)
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            size[up] += size[i]
            paragraphs[up] += paragraphs[i] + (self.tag[i] == "p")
            main[up] |= main[i] or self.tag[i] in ("article", "main", "h1") and not self.hidden[i]
        for i in range(1, n):
            form = self.tag[i] == "form" and not (main[i] or paragraphs[i] and 2 * size[i] >= size[0])
            self.hidden[i] = self.hidden[i] or self.hidden[self.parent[i]] or form
        self.blocks = [b for b in self.blocks if not self.hidden[b[0]]]

    def path(self, i: int) -> str:
        steps = []
        while i > 0:
            steps.append(self.step[i])
            i = self.parent[i]
        return "".join(f"/{s}" for s in reversed(steps))

    def skip_inline(self, tag: str) -> None:
        """An inline element that is not part of the article, such as an advert in a span: hidden up to its own end tag or the
        end of the block that holds it. It ends no paragraph and divides no text."""
        self.add(tag, tag, True)
        self.push()

    def skipped(self, tag: str) -> int:
        """Where in the stack the innermost skipped inline element of this tag is, within its container; 0: nowhere."""
        if self.hidden[self.stack[-1]]:
            k = self.last(tag)
            return k if k >= self.scopes[-1] else 0
        return 0

    def scores(self) -> list[tuple[float, int, int]]:
        """(score, element, visible characters) of containers that hold text, best first."""
        size, linked = [0] * len(self.tag), [0] * len(self.tag)
        for at, text, in_links in self.blocks:
            size[at] += len(text)
            linked[at] += min(in_links, len(text))
        for i in range(len(self.tag) - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        whole = size[0] or 1
        out = []
        for i in range(1, len(self.tag)):
            if size[i] and not self.hidden[i] and self.tag[i] in CONTAINER:
                names = set(NAMES.findall(self.step[i]))
                likely = self.tag[i] in ("article", "main") or not CONTENT.isdisjoint(names - {"body"})
                score = size[i] / whole * (1 - linked[i] / size[i]) + 0.25 * likely - 0.1 * (self.tag[i] in ("body", "html"))
                out.append((score + 0.001 * self.depth[i], -i, size[i]))
        return [(s, -i, n) for s, i, n in sorted(out, reverse=True)]

    def on(self, path: str) -> set[int]:
        """The visible elements on a path."""
        crc = zlib.crc32(path.encode("utf-8", "surrogatepass"))
        return {i for i in range(1, len(self.tag)) if self.sum[i] == crc and not self.hidden[i] and self.path(i) == path}

    def extract(self, winner: str | None) -> str:
        chosen = self.inside(self.on(winner)) if winner else []
        if not chosen:
            best = self.scores()
            chosen = self.inside({best[0][1]}) if best else [t for _, t, _ in self.blocks]
        return "\n\n".join(chosen)

    def inside(self, roots: set[int]) -> list[str]:
        under = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            under[i] = i in roots or under[self.parent[i]]
        return [t for at, t, _ in self.blocks if under[at]]


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages(page_id, url, html): page_id, url, text, n_chars, host, path.

    Each page scores its containers (share of the text outside menus, adverts and the like, less what is links) and its
    best VOTES vote, with their scores, halved from one to the next, for their paths of tags and classes, in which digits are generalised. The path
    with the most votes wins its host, ties to the first by code point, and each page's text is that of the elements on
    the winning path; a page that has none there keeps its own best container.
    Blocks are joined by an empty line; white space within a block, line breaks too, becomes one space.

    Null and empty html: an empty text, no vote. Null url or no host: the page is its own host. Pages without tags: all of
    their text. Repeated rows: a row each. Very long pages are read whole. An empty table: no rows. Other columns play no part.
    """
    rows = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], int] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if host and source:
                    page = Page(source)
                    for rank, (score, i, _) in enumerate(page.scores()[:VOTES]):
                        key = host, page.path(i)
                        total[key] = total.get(key, 0) + max(0, round(score * 1000 / 2**rank))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["host", "path", "votes"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, votes long")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    won = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))
    rows = rows.join(small(staged(won.withColumnRenamed("host", "_host"))), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "host", "path")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h).extract(p) if h else "" for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), b.column("host"), b.column("path")]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "host", "path"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(again, f"page_id {kind['page_id']}, url string, text string, n_chars long, host string, path string")
