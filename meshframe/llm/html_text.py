"""Main text of web pages by two-pass block rules.

A page becomes blocks of running text, each with its length, the share of its characters inside links and the share of
stop words among its words. The first pass decides blocks by these figures: many links are out, dense stop words are in,
long text without stop words is out, and what is short or middling stays open. The second pass gives an open block the
class of the nearest decided blocks before and after it.

Marks are features of the first pass. What stands in a menu, header, footer, sidebar, notice, advert, form or comment is
out, unless that element holds most of the page's text; such blocks say nothing about their neighbours. A marked article
moves a verdict one step: what would be out is open there, unless it is mostly links. Blocks of a marked article and the
others are neighbours among themselves only. On pages in languages without a list of stop words, length decides instead.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of fewer characters are short; above LONG a block of middling stop-word density is good by itself.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
#: Long text without any link is out below this share of stop words only.
STOPS_FEW = 0.05
LINKS_HIGH, LINKS_MOST = 0.33, 0.66
#: An element with more than this share of a page's text outside links is no margin, whatever its name.
MOST = 0.5
#: Characters of a script without blanks say about as much as so many letters.
DENSE_SCRIPT = 3

# Frequent function words of the languages that pages are written in.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this from or an at not have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un une du que qui dans pour est sur pas avec au par ce "
    "el los las y del se por con para una su al lo como más o sus no son "
    "il di che è per non sono della gli nel da si ha anche "
    "os um uma não dos das em na ao mais foi "
    "het van een niet op te voor zijn dat aan met".split()
)
# Elements of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object".split())
OUT_TAGS = frozenset("nav header footer aside form button select option dialog menu head fieldset label".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header "
    "masthead comment comments reply replies disqus share sharing social related recommended newsletter subscribe signup "
    "popup modal overlay toolbar pagination pager login search copyright disclaimer".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
NEVER_OUT = frozenset("html body".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Margins however much text they hold.
FIRM_TAGS = frozenset("nav footer aside button select option menu head".split())
FIRM_NAMES = frozenset("comment comments reply replies disqus".split())
#: A class name with one of these words says what the page has, not what the element is.
HAVING = frozenset("with has no not without non hide show".split())
#: A header of one of these is the head of a text.
TEXT_NAMES = frozenset("article content entry post story".split())
HEADER_NAMES = frozenset("header masthead".split())
#: Opening one of these closes an open one of the same family in the same list or table.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSES_P = BLOCKS - frozenset("head title option optgroup tr td th thead tbody tfoot caption legend summary body html".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+|[\"'])*+)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])(?:([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|(hidden)(?![a-zA-Z-]))")
DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\u0e00-\u0eff]")
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
PARTS = re.compile(r"[a-z0-9]+")


@dataclass
class Mark:
    """An element whose name says that it is no main text; chars counts its text outside links."""

    parent: Mark | None
    firm: bool
    heads_text: bool
    chars: int = 0
    heading: bool = False
    out: bool = True


@dataclass
class Block:
    text: str
    link_chars: int
    out: bool
    main: bool
    code: bool = False


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, Mark | None, bool]] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)
    marked: list[Mark | None] = field(default_factory=list)
    inner: Mark | None = None
    chars: int = 0
    main: int = 0
    headings: int = 0
    breaks: int = 0

    def end_block(self) -> None:
        raw = "".join(x for x, _ in self.pieces)
        text = " ".join(html.unescape(raw).split())
        if text:
            linked = sum(len(" ".join(html.unescape(x).split())) for x, link in self.pieces if link)
            self.blocks.append(Block(text, linked, False, self.main > 0, self.open["pre"] > 0))
            self.marked.append(self.inner)
            own = max(0, len(text) - linked)
            self.chars += own
            if self.inner:
                self.inner.chars += own
                self.inner.heading = self.inner.heading or self.headings > 0
        self.pieces = []
        self.breaks = 0

    def say(self, text: str) -> None:
        if text:
            if not text.isspace():
                self.breaks = 0
            self.pieces.append((text, self.open["a"] > 0))

    def push(self, tag: str, attributes: str) -> None:
        is_main = tag in MAIN_TAGS
        out, firm, header = tag in OUT_TAGS, tag in FIRM_TAGS, tag == "header"
        if attributes and tag not in NEVER_OUT:
            named = {(a or e).lower(): b or c or d or e for a, b, c, d, e in ATTRIBUTE.findall(attributes)}
            for name in f"{named.get('class', '')} {named.get('id', '')}".lower().split():
                words = frozenset(PARTS.findall(name))
                found = words & OUT_NAMES
                if not found or words & HAVING:
                    continue
                if found <= HEADER_NAMES:
                    header = True
                    if words & TEXT_NAMES:
                        continue
                out = True
                firm = firm or not found.isdisjoint(FIRM_NAMES)
            out = out or named.get("role", "").lower() in OUT_ROLES
            unseen = "hidden" in named or named.get("aria-hidden", "").lower() == "true"
            unseen = unseen or "display:none" in named.get("style", "").lower().replace(" ", "")
            out, firm = out or unseen, firm or unseen
            is_main = is_main or named.get("role", "").lower() == "main" or named.get("itemprop", "") == "articleBody"
        is_main = is_main and not out
        mark = None
        if out:
            mark = self.inner = Mark(self.inner, firm, header and self.main > 0)
            self.marks.append(mark)
        self.stack.append((tag, mark, is_main))
        self.open[tag] += 1
        self.main += is_main
        self.headings += tag in HEADINGS

    def pop(self) -> str:
        tag, mark, is_main = self.stack.pop()
        self.open[tag] -= 1
        self.main -= is_main
        self.headings -= tag in HEADINGS
        if mark:
            self.inner = mark.parent
            if mark.parent:
                mark.parent.chars += mark.chars
                mark.parent.heading = mark.parent.heading or mark.heading
        return tag

    def finish(self) -> list[Block]:
        """The blocks, each out if an element around it is."""
        self.end_block()
        while self.stack:
            self.pop()
        for m in self.marks:  # an outer one comes first
            kept = (m.heads_text and m.heading) or (not m.firm and m.chars > MOST * self.chars and m.heading)
            m.out = (m.parent is not None and m.parent.out) or not kept
        if self.marks and all(m is not None and m.out for m in self.marked):
            for m in self.marks:  # all of the page stands in margins: only the firm ones are
                m.out = (m.parent is not None and m.parent.out) or m.firm
        for b, m in zip(self.blocks, self.marked, strict=True):
            b.out = m is not None and m.out
        return self.blocks

    def close(self, tag: str) -> None:
        if self.open[tag]:
            while self.pop() != tag:
                pass

    def close_sibling(self, family: frozenset[str], limits: frozenset[str]) -> None:
        """Close an open element of the family unless a list, table or other limit was opened since."""
        for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 64), -1):
            tag = self.stack[k][0]
            if tag in family:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in limits:
                return


_LIMITS = frozenset("ul ol dl table select menu article section div nav aside header footer main body form".split())


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in page order; a reference is decoded in the block that holds it."""
    r, at, lower = _Reader(), 0, None
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            r.say(page[at:])
            break
        r.say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        block = tag in BLOCKS
        if m[1]:
            if block:
                r.end_block()
            r.close(tag)
            continue
        if tag == "br":
            r.breaks += 1
            if r.breaks > 1:
                r.end_block()
            else:
                r.pieces.append((" ", False))
            continue
        if tag in RAW and not m[3].endswith("/"):
            if block:
                r.end_block()
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):  # a letter whose lower case is longer: search without folding it
                lower = re.sub(r"[A-Z]", lambda x: x[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            if end >= 0:
                stop = page.find(">", end)
                at = len(page) if stop < 0 else stop + 1
            continue
        if block:
            r.end_block()
            if r.open["p"] and tag in CLOSES_P:
                r.close_sibling(frozenset(["p"]), _LIMITS)
            if tag in SIBLINGS:
                r.close_sibling(frozenset(SIBLINGS[tag].split()), _LIMITS)
        if tag not in VOID:
            r.push(tag, m[3])
    return r.finish()


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = [w.strip(".,;:!?()\"'%&$#*|") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words), sum(map(bool, words))


def weight(text: str) -> int:
    """Length in letters of an alphabet."""
    return len(text) if text.isascii() else len(text) + (DENSE_SCRIPT - 1) * len(DENSE.findall(text))


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """Of each block whether it is in, out, or open (None)."""
    said = [(0, 0) if b.out else stop_words(b.text) for b in blocks]
    prose = [x for b, x in zip(blocks, said, strict=True) if b.link_chars <= LINKS_HIGH * len(b.text) and not b.code]
    listed = sum(k for k, _ in prose) >= STOPS_LOW * max(1, sum(n for _, n in prose))
    return [False if b.out else _verdict(b, k / max(n, 1), listed) for b, (k, n) in zip(blocks, said, strict=True)]


def _verdict(b: Block, stops: float, listed: bool) -> bool | None:
    """listed: whether the page's language has a list of stop words."""
    links, n = b.link_chars / len(b.text), weight(b.text)
    if links > LINKS_HIGH:
        return None if b.main and links <= LINKS_MOST else False
    if n < SHORT:
        return False if not b.main and COPYRIGHT.match(b.text) else None
    if stops >= STOPS_HIGH or n > LONG and (stops >= STOPS_LOW or not listed):
        return True
    if n <= LONG or b.main or b.code or not listed or links == 0 and stops >= STOPS_FEW:
        return None
    return False


def second_pass(decided: list[bool | None]) -> list[bool]:
    """Open blocks take the class of the nearest decided neighbours: in if both are, or if the nearer one is."""
    n = len(decided)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            side[i] = last
            if decided[i] is not None:
                last = (i, bool(decided[i]))
    out = []
    for i, d in enumerate(decided):
        if d is not None:
            out.append(d)
            continue
        a, b = before[i], after[i]
        if a is None or b is None:
            near = a or b
            out.append(near[1] if near else True)
        elif a[1] == b[1]:
            out.append(a[1])
        else:
            out.append(a[1] if i - a[0] < b[0] - i else b[1] if b[0] - i < i - a[0] else True)
    return out


def kept_blocks(blocks: list[Block]) -> list[bool]:
    """Both passes: whether each block is main text."""
    decided = first_pass(blocks)
    kept = [False] * len(blocks)
    marked = any(b.main and not b.out for b in blocks)
    for main in (True, False):
        part = [i for i, b in enumerate(blocks) if b.main == main and not b.out]
        own = [decided[i] for i in part]
        if any(own) or main or not marked:  # beside a marked article, open blocks need a good one among them
            for i, k in zip(part, second_pass(own), strict=True):
                kept[i] = k
    return kept


def main_text(page: str | None) -> str:
    """The page's main text: decoded blocks joined by an empty line."""
    blocks = read_blocks(page or "")
    return "\n\n".join(b.text for b, k in zip(blocks, kept_blocks(blocks), strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages, and pages without main text, give an empty text. Pages without any markup are one block.
    Nothing is shuffled: rows are read one by one and repeated rows repeat their result. Other columns are ignored.
    """
    own = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return own.mapInArrow(_extract, f"page_id {dict(own.dtypes)['page_id']}, url string, text string, n_chars long")
