"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events; they become lines, broken at line ends and block tags. Each line has the
ratio of its characters to its tags. The ratios are smoothed by a Gaussian, so that short lines between long ones keep up
with them, and split in two at a share of their standard deviation: the lines above are the content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import common

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4"
    " h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("head script style noscript template svg iframe object".split())
#: What may stand in a head: any other start tag ends it, as its end tag and the body's start tag may be left out.
HEAD = frozenset("title meta link base basefont bgsound script style template noscript noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class LineParser(HTMLParser):
    """Gathers lines of text with the number of tags that belong to each; tags between lines belong to the next one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.tags: list[int] = []
        self.held: list[str] = []
        self.count = 0
        self.hidden: list[str] = []
        self.page = ""
        self.ends: dict[str, int] = {}
        self.ended: Counter[str] = Counter()
        self.outside: Counter[str] = Counter()
        self.inside: Counter[str] = Counter()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A bogus comment up to the next '>', as HTML has it; the parser's own raises or looks for the end far away."""
        return self.parse_bogus_comment(i, report)

    def close_line(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held.clear()
            if text:
                self.lines.append(text)
                self.tags.append(self.count)
                self.count = 0

    def feed(self, data: str) -> None:
        self.page = data
        super().feed(data)

    def closes(self, tag: str) -> bool:
        """Whether an end tag of ``tag`` may still follow."""
        if tag not in self.ends:
            self.ends[tag] = len(re.findall(rf"</\s*{tag}\b", self.page, re.I)) - self.ended[tag]
        return self.ends[tag] > 0

    def show(self, depth: int) -> None:
        """End the hidden elements from ``depth`` on."""
        del self.hidden[depth:]
        if not self.hidden:
            self.inside.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden and self.hidden[-1] in ("head", "title") and (tag not in HEAD if self.hidden[-1] == "head" else tag in BLOCKS and tag != "title"):
            self.show(self.hidden.index("head"))
        if tag == "body":
            self.show(0)
        if tag in BLOCKS and tag not in VOID and tag != "head":
            (self.inside if self.hidden else self.outside)[tag] += 1
        # What is never closed can't hide anything; the parser itself reads scripts and styles to their end tags.
        if tag in ("head", "script", "style") or tag in HIDDEN and self.closes(tag) or tag == "title" and self.hidden == ["head"]:
            self.hidden.append(tag)
        if tag in BLOCKS:
            self.close_line()
        self.count += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.close_line()
        self.count += 1

    def handle_endtag(self, tag: str) -> None:
        self.ended[tag] += 1
        if tag in self.ends:
            self.ends[tag] -= 1
        if tag in self.hidden:
            self.show(self.hidden.index(tag))
        elif self.hidden and self.inside[tag]:
            self.inside[tag] -= 1
        elif self.outside[tag]:
            # The end of a block that was open before the hidden elements ends those too.
            self.outside[tag] -= 1
            self.show(0)
        self.count += 1
        if tag in BLOCKS:
            self.close_line()

    def handle_data(self, data: str) -> None:
        if self.hidden == ["head"] and data.strip():
            self.show(0)
        if self.hidden:
            return
        if "\n" not in data:
            self.held.append(data)
            return
        first, *rest = data.split("\n")
        self.held.append(first)
        for part in rest:
            self.close_line()
            self.held.append(part)


def smooth(ratios: np.ndarray, radius: int) -> np.ndarray:
    """A Gaussian mean over ``radius`` lines on either side, with weights that sum to 1 at the ends too."""
    if radius < 1 or not len(ratios):
        return ratios
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2.0 * radius**2))
    inside = slice(radius, radius + len(ratios))
    return np.convolve(ratios, kernel)[inside] / np.convolve(np.ones(len(ratios)), kernel)[inside]


def content(html: str, radius: int = 1, strength: float = 0.5) -> tuple[str, int, int]:
    """The content lines of a page, and how many lines it has and how many of them were chosen.

    The threshold is ``strength`` standard deviations of the smoothed ratios. Where no line reaches it, as on pages of one
    line or of equal ones, all lines are content.
    """
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.close_line()
    ratios = np.array([len(t) / max(c, 1) for t, c in zip(parser.lines, parser.tags, strict=True)], float)
    smoothed = smooth(ratios, radius)
    chosen = smoothed >= strength * smoothed.std() if len(smoothed) else np.zeros(0, bool)
    if not chosen.any():
        chosen[:] = True
    return "\n".join(t for t, c in zip(parser.lines, chosen, strict=True) if c), len(chosen), int(chosen.sum())


def _run(radius: int, strength: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, 0, 0) if h is None else content(h, radius, strength) for h in batch.column(2).to_pylist()]
            text, lines, chosen = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(lines, pa.int32()), pa.array(chosen, pa.int32())],
                names=["page_id", "url", "text", "n_lines", "n_content"],
            )

    return run


def extract(pages: DataFrame, radius: int = 1, strength: float = 0.5) -> DataFrame:
    """``page_id``, ``url``, the content ``text``, and the numbers of lines and of content lines of every page.

    A null page gives a null text and no lines, an empty one an empty text. Pages are read by themselves, so repeated rows
    give equal results; lines whose ratio ties with the threshold are content. Very long pages are read whole, one at a time in
    a task's memory. Ids must be whole numbers. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    common.ship(pages.sparkSession)
    return common.spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(_run(radius, strength), "page_id long, url string, text string, n_lines int, n_content int")
