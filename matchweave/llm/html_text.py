"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption legend".split())
#: Elements whose start ends an open element of the same set.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = set(
    "aside audio button canvas datalist dialog footer head iframe input menu nav noscript object script select style"
    " svg template textarea title video".split()
)
MARKS = set(
    "ad ads adv advert advertisement advertisements adverts banner banners breadcrumb breadcrumbs comment comments consent"
    " cookie cookies copyright disclaimer discussion footer footers header login masthead menu menus modal nav navbar"
    " navigation newsletter notice notices pager pagination popup promo promos promotion related reply replies respond"
    " search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Marks of reader comments, which go however long they are.
COMMENTS = set("comment comments discussion reply replies respond".split())
#: What may follow a mark within a class name: "sidebar-left" is a sidebar, "social-policy" is not social.
PLACES = set("area bar block body bottom box column container content group inner item items left link links list main outer panel primary right section secondary top wrap wrapper".split())
#: What turns a mark within a class name into a remark about the layout: "has-sidebar".
REMARKS = set("has is no non not with without".split())
CONTROLS = set("button input select textarea".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
KEPT = {"html", "body", "article", "main"}


class Page:
    """A page's elements in document order, with its text as (element, text or None for a block edge)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.marked = ["#root"], [-1], [None]
        self.events: list[tuple[int, str | None]] = []
        self._parse(html)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.marked.append(self._mark(attributes) if attributes and tag not in KEPT else None)
        return len(self.tags) - 1

    @staticmethod
    def _mark(attributes: str) -> str | None:
        """What an element's attributes, each read by its own name, tell: hidden, comment, mark or nothing."""
        found = None
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
                return "hidden"
            if name == "role" and value.lower() in ROLES:
                found = found or "mark"
            if name in ("class", "id"):
                for token in value.split():
                    parts = [p.lower() for p in PARTS.findall(token)]
                    if not parts or parts[0] in REMARKS:
                        continue
                    named = parts[-1] if parts[-1] in MARKS else parts[0] if parts[0] in MARKS and PLACES.issuperset(parts[1:]) else None
                    if named:
                        found = "comment" if named in COMMENTS else found or "mark"
        return found

    def _parse(self, html: str) -> None:
        """One pass; open elements are found by tag, so that deep and unclosed markup costs no search."""
        stack, at, events = [0], 0, self.events
        places: dict[str, list[int]] = {}
        blocks: list[int] = []

        def close(k: int) -> None:
            while len(stack) > k:
                n = stack.pop()
                places[self.tags[n]].pop()
                if self.tags[n] in BLOCK:
                    blocks.pop()
                    events.append((n, None))

        def tag_at(k: int) -> str:
            return self.tags[stack[k]]

        while True:
            m = TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                events.append((stack[-1], unescape(text)))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag or (m[5] and not m[0].endswith(">")):
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if not places.get(tag):
                    continue
                k, wall = places[tag][-1], -1
                if tag not in BLOCK:
                    wall = next((b for b in reversed(blocks) if tag_at(b) != "p"), -1)
                if k > wall:
                    close(k)
                continue
            ends = SIBLINGS.get(tag, {"p"} if tag in CLOSES_P else set())
            while ends and blocks:
                open_tag = tag_at(blocks[-1])
                if open_tag in ends:
                    close(blocks[-1])
                    if tag != "tr" or open_tag == "tr":
                        break
                else:
                    break
            if tag == "br":
                events.append((stack[-1], " "))
            n = self._open(tag, stack[-1], m[3] or m[6] or "")
            if tag in BLOCK:
                events.append((n, None))
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            elif tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    blocks.append(len(stack))
                stack.append(n)
        close(1)

    def dropped(self) -> list[bool]:
        """Elements outside the article by kind: by their tag, or by a telling class, id or role.

        Hidden elements go, and reader comments unless they hold a main heading, an article or a main element. Another marked element goes only if it is a lesser part of the page:
        one that holds a main heading, an article or a main element, or over half of the unlinked text outside
        dropped tags, stays. A form goes unless it holds one of these or at least 200 such characters for each of its
        controls, as a form around a whole page does. A header goes unless it lies inside an article or main element.
        """
        n, tags, parents, marked = len(self.tags), self.tags, self.parents, self.marked
        holds = [t in ("h1", "article", "main") for t in tags]
        plain, controls, aside = [0] * n, [t in CONTROLS for t in tags], [False] * n
        for k in range(1, n):
            aside[k] = aside[parents[k]] or tags[k] in DROPPED or tags[k] == "a" or marked[k] in ("hidden", "comment")
        for k, text in self.events:
            if text and not aside[k]:
                plain[k] += len("".join(text.split()))
        for k in range(n - 1, 0, -1):
            p = parents[k]
            holds[p] = holds[p] or holds[k]
            plain[p] += plain[k]
            controls[p] += controls[k]
        inside, out = [False] * n, [False] * n
        for k in range(1, n):
            p, tag = parents[k], tags[k]
            inside[k] = inside[p] or tag in ("article", "main")
            lesser = not holds[k] and 2 * plain[k] <= plain[0]
            out[k] = (
                out[p] or tag in DROPPED or (tag == "header" and not inside[k]) or marked[k] == "hidden"
                or (marked[k] == "comment" and not holds[k]) or (marked[k] == "mark" and lesser) or (tag == "form" and not holds[k] and plain[k] < 200 * (controls[k] + 1))
            )
        return out


def composite_density(page: Page, out: list[bool]) -> list[float]:
    """For every element: its characters per tag, lowered the more of its text is linked; 0 without text.

    With C characters, T tags, LC linked characters and LT links below it, and the page's share of
    linked characters: C/T * log(C/LC * T/LT + 1) / log(log(C/(C - LC) * LC + share * C + e) + e - 1);
    zeros among the divisors count as 1. Dropped parts count nowhere.
    """
    n, parents, tags = len(page.tags), page.parents, page.tags
    chars, links, count, linked = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[parents[k]] or tags[k] == "a"
    for k, text in page.events:
        if text and not out[k]:
            size = len("".join(text.split()))
            chars[k] += size
            links[k] += size * in_link[k]
    for k in range(n - 1, 0, -1):
        p = parents[k]
        if not out[k]:
            chars[p] += chars[k]
            links[p] += links[k]
            count[p] += count[k] + 1
            linked[p] += linked[k] + (tags[k] == "a")
    share, density = links[0] / max(chars[0], 1), [0.0] * n
    for k in range(n):
        if not out[k] and chars[k]:
            c, t = chars[k], max(count[k], 1)
            base = log(log(c / max(c - links[k], 1) * links[k] + share * c + e) + e - 1)
            density[k] = c / t * log(max(c / max(links[k], 1) * t / max(linked[k], 1), 1) + 1) / base
    return density


def main_text(html: str | None) -> str:
    """The article of a page: one line for each block.

    Of what is left after the parts named in Page.dropped, each block element gets the composite
    text density (composite_density). The block whose child blocks' densities sum highest is the
    centre; the smallest density on its way up to the body is the threshold. Blocks at or above it
    contribute the highest-sum block below them; on the centre's way up, those that add the main
    heading or close off the article contribute as a whole.
    """
    if not html:
        return ""
    page = Page(html)
    out, n = page.dropped(), len(page.tags)
    parents, tags = page.parents, page.tags
    density = composite_density(page, out)
    if not any(density):
        return ""
    total, up = [0.0] * n, list(range(n))
    for k in range(1, n):
        p = parents[k]
        up[k] = p if tags[p] in BLOCK or p == 0 else up[p]
        if tags[k] in BLOCK:
            total[up[k]] += density[k]
    best = max(range(n), key=lambda k: (total[k], -k))
    if not total[best]:
        best = 0
    heads = [t == "h1" and not o for t, o in zip(tags, out, strict=True)]
    for k in range(n - 1, 0, -1):
        heads[parents[k]] = heads[parents[k]] or heads[k]
    way, k = [], best
    while k >= 0:
        way.append(k)
        k = parents[k]
    threshold = min(density[k] for k in way)
    whole = best
    for k in way:
        if tags[k] in ("body", "html", "#root"):
            break
        if tags[k] in ("article", "main") or (heads[k] and not heads[whole]):
            whole = k
    top = list(range(n))
    for k in range(n - 1, 0, -1):
        p = parents[k]
        if not out[k] and total[top[k]] > total[top[p]]:
            top[p] = top[k]
    chosen = {whole} | {top[k] for k in range(n) if tags[k] in BLOCK and not out[k] and density[k] > 0 and density[k] >= threshold}
    covered = [False] * n
    for k in range(n):
        covered[k] = (k in chosen or (k > 0 and covered[parents[k]])) and not out[k]
    lines, parts = [], []
    for k, text in [*page.events, (0, None)]:
        if text is None:
            line = " ".join("".join(parts).split())
            if line:
                lines.append(line)
            parts = []
        elif covered[k]:
            parts.append(text)
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars), one row for each row.

    Null, empty and text-free pages give an empty text. Unclosed and truncated markup is read as
    far as it goes. Each page is read in one pass, whatever its length.
    """

    def run(batches):
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, main text and n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
