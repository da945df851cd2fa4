"""HTML to text, links and article, with the standard library's parser, batch by batch (Arrow)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Elements that are dropped with all they hold; phrases of page furniture and of paywalls.
DROPPED = set("script style noscript nav header footer aside form iframe svg button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = r"(?i)\b(subscribe|newsletter|advertisement|sign in|sign up|cookies?|privacy policy|share this article|related stories|most popular)\b"
PAYWALL = (
    r"(?i)(subscribe to continue|continue reading your article|already a subscriber|to continue reading|"
    r"this article is for subscribers|create a free account)"
)
BODY_CLASS = re.compile(r"(article|story|post|content)-?(body|text)?", re.I)
_FURNITURE = re.compile(FURNITURE)


class Page(HTMLParser):
    """One pass: visible text, links, titles, and paragraphs by enclosing container. A new <p> closes an open one."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[str] = []
        self.title, self.og = "", ""
        self.open: list[tuple[str, int | None]] = []
        self.skip = 0
        self.containers: list[tuple[str, list[str]]] = []
        self.active: list[int] = []
        self.para: list[str] | None = None
        self.in_title = False
        self.feed(html)
        self.close()
        self._end_para()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("property") == "og:title" and a.get("content"):
            self.og = self.og or a["content"].strip()
        if tag == "a" and "href" in a:
            href = a["href"].strip()
            if href.startswith(("http://", "https://")):
                self.links.append(href)
        if tag in VOID:
            return
        if tag == "title" and not self.skip:
            self.in_title = True
        box = None
        if tag in DROPPED:
            self.skip += 1
        elif not self.skip:
            if tag == "p":
                self._end_para()
                self.para = []
            if tag in ("article", "main", "body") or tag == "div" and BODY_CLASS.search(a.get("class", "")):
                box = len(self.containers)
                self.containers.append((tag, []))
                self.active.append(box)
        self.open.append((tag, box))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, box = self.open.pop()
            if t in DROPPED:
                self.skip -= 1
            if t == "p":
                self._end_para()
            if box is not None:
                self._end_para()
                self.active.remove(box)
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.in_title and not self.title:
            self.title = data.strip()
        if self.skip:
            return
        self.text.append(data)
        if self.para is not None:
            self.para.append(data.strip())

    def _end_para(self) -> None:
        if self.para is not None:
            t = " ".join(x for x in self.para if x)
            for box in self.active:
                self.containers[box][1].append(t)
        self.para = None

    def article(self) -> str:
        boxes = [ps for tag, ps in self.containers if tag != "body"] or [ps for tag, ps in self.containers if tag == "body"]
        best = ""
        for ps in boxes:
            kept = [p for p in ps if len(p) > 40 and not (len(p) < 120 and _FURNITURE.search(p))]
            text = squeeze("\n\n".join(kept))
            if len(text) > len(best):
                best = text
        return best


def squeeze(text: str) -> str:
    """Blanks of a line to one, lines stripped, at most one blank line between others."""
    out: list[str] = []
    for line in text.splitlines():
        words = " ".join(line.split())
        if words or (out and out[-1]):
            out.append(words)
    return "\n".join(out).strip()


RESULT = StructType(
    [
        StructField("title", StringType()),
        StructField("text", StringType()),
        StructField("article", StringType()),
        StructField("links", ArrayType(StringType())),
    ]
)


@F.pandas_udf(RESULT)
def read_html(html: pd.Series) -> pd.DataFrame:
    """title (og:title before title), whole text, article text, links (absolute, distinct, at most 60). Null is ''."""
    out = []
    for h in html:
        if not h:
            out.append(("", "", "", []))
            continue
        p = Page(h)
        out.append((p.og or p.title, squeeze("\n".join(p.text)), p.article(), list(dict.fromkeys(p.links))[:60]))
    return pd.DataFrame(out, columns=RESULT.names)


def looks_paywalled(text: Column, least: int = 900) -> Column:
    """A stub: nothing, short, or not long and with a subscription phrase near its end."""
    n = F.length(text)
    return F.when(text.isNull() | (text == ""), True).otherwise(
        (F.right(text, F.lit(1500)).rlike(PAYWALL) & (n < 3 * least)) | (n < least)
    )
