"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its tag path (the structural tags from the root down, with their class, id
and role words). Per path the text length and the punctuation are added up over the path's nodes, giving two ratios:
characters per node, and characters per node weighted by punctuation per link character. Both are smoothed along the page's
sequence of blocks, fused by their product and cut at a share of their spread; paths below the cut, and paths
that run through an element made for something else, are not content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 64

# Element names of the public HTML standard, by what they mean for text blocks.
UNSEEN = frozenset("head script style template noscript svg math iframe object canvas audio video select option datalist button textarea input form title".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class, id and role that name what is not the article. A name counts if all its parts do: "cookie-notice", not "no-sidebar".
_NOT_CONTENT = (
    r"(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|"
    r"comments?|reply|replies|respond|disqus|discussion|cookies?|consent|gdpr|notice\w*|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|"
    r"related|recommend\w*|complementary|navigation|contentinfo|search|skip|toolbar|pagination|pager|alert|dialog)"
)
NOT_CONTENT = re.compile(rf"(?<!\S){_NOT_CONTENT}(?:[_-]+{_NOT_CONTENT})*(?!\S)", re.I)
NEVER_JUDGED = frozenset("html body main article".split())  # by their names; what they hold decides
MAIN = frozenset("article main".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡«»]")
WHITE = re.compile(r"\s+")
HEADING = re.compile(r"h[1-6]$")


class _Blocks(HTMLParser):
    """Cuts a page into ``[path, text, link characters, heading, main]`` in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, bool]] = []  # tag, label, boilerplate, unseen
        self.blocks: list[list] = []
        self.parts: list[str] = []
        self.linked = 0
        self.anchors = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            self.anchors += tag == "a"
            if tag == "br":
                self.parts.append(" ")
            return
        self._end_block()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_to("p", CLOSES_P - {"p"})
        if tag in SAME_LEVEL:
            self._close_to(tag, SAME_LEVEL[tag])
        if tag == "body":
            while self.open and self.open[-1][0] != "html":
                self.open.pop()
        said = {k: v or "" for k, v in attrs}
        words = " ".join(said.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")) is not None
        label = tag if not words.strip() else f"{tag}.{'.'.join(sorted(words.split()))}"
        self.open.append((tag, label, tag in BOILERPLATE or (tag not in NEVER_JUDGED and NOT_CONTENT.search(words) is not None), hidden or tag in UNSEEN))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.anchors = max(0, self.anchors - (tag == "a"))
            return
        self._end_block()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.anchors:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_block()

    def _close_to(self, tag: str, stops: frozenset | set) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return
            if self.open[at][0] in stops:
                return

    def _end_block(self) -> None:
        text = WHITE.sub(" ", "".join(self.parts)).strip()
        if text and not any(unseen for *_, unseen in self.open):
            tags = [t for t, *_ in self.open]
            heading = bool(tags and HEADING.match(tags[-1]))
            inside = max((i for i, t in enumerate(tags) if t in MAIN), default=-1)
            # A header inside the article holds its title; any other boilerplate on the way excludes the block.
            other = any(b and not (heading and t == "header" and 0 <= inside < i) for i, (t, _, b, _) in enumerate(self.open))
            self.blocks.append(["/".join(label for _, label, *_ in self.open), text, min(self.linked, len(text)), heading, inside >= 0, other])
        self.parts, self.linked, self.anchors = [], 0, 0


def blocks(html: str) -> list[list]:
    """``[path, text, link characters, is heading, inside article or main, boilerplate]`` of each text block, in page order."""
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    return reader.blocks


def _smooth(values: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian mean over neighbouring blocks, renormalised at the ends."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    inner = slice(radius, radius + len(values))
    return np.convolve(values, kernel)[inner] / np.convolve(np.ones(len(values)), kernel)[inner]


def content(found: list[list], unnamed_share: float = 0.3, link_share: float = 0.6) -> list[bool]:
    """Which blocks are content. ``unnamed_share``: the cut, as a part of the standard deviation of the fused ratios.

    In pages that name an article every block of it is content that no excluded element holds. The others are cut at ``unnamed_share``
    and lose paths with over ``link_share`` of their text in links.
    """
    if any(b[4] and not b[5] for b in found):
        return [b[4] and not b[5] for b in found]
    if not found:
        return []
    text = [0 if b[5] else len(b[1]) for b in found]
    sums: dict[str, list[float]] = {}
    for b, n in zip(found, text, strict=True):
        s = sums.setdefault(b[0], [0, 0, 0, 0])
        s[0] += n
        s[1] += 1
        s[2] += len(PUNCTUATION.findall(b[1])) if n else 0
        s[3] += b[2]
    plain, marked, frees = {}, {}, {}
    for path, (n, nodes, marks, linked) in sums.items():
        frees[path] = free = max(n - linked, 0) / max(n, 1)
        plain[path] = n / nodes * free
        marked[path] = (n / nodes) * (1 + marks) / nodes * free
    one = _smooth(np.array([math.log1p(plain[b[0]]) for b in found]))
    two = _smooth(np.array([math.log1p(marked[b[0]]) for b in found]))
    fused = one * two
    # The ratio belongs to the path: its best node decides for all its nodes, however short.
    of_path: dict[str, float] = {}
    for b, f in zip(found, fused, strict=True):
        of_path[b[0]] = max(of_path.get(b[0], 0.0), float(f))
    cut = unnamed_share * float(np.std(fused))

    def keeps(b: list) -> bool:
        return frees[b[0]] >= 1 - link_share and not b[5] and of_path[b[0]] > cut

    return list(map(keeps, found))


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(b[1] for b, keep in zip(found, content(found), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)``: the article of each row's whole html; its blocks in page order, one per line.

    Null and empty pages, and pages without content, give an empty text; a null url stays null. Rows, order and repeats stay
    as they are; other columns are ignored. A page that names its article (``article`` or ``main``) has no content elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                text = list(map(main_text, part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kinds = ((id_col, "long", "page_id"), (url_col, "string", "url"), (html_col, "string", "html"))
    rows = pages.select(*[F.col(c).cast(kind).alias(name) for c, kind, name in kinds])
    return rows.mapInArrow(run, "page_id long, url string, text string")
