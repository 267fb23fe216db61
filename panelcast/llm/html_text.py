"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; what stands inside scripts, styles, form
controls and the like is never text, and of a form only what it frames. Pass 1 decides each block from its surroundings and its own
statistics: blocks inside menus, headers, footers, sidebars, notices, adverts and comment
lists are bad; blocks full of links are bad; long blocks with a normal density of stop
words are good, without it bad; short blocks stay open. Pass 2: an open block inherits
the label of the nearest decided block, first inside its own section, on a tie or where
its section has none the good one of its two neighbours in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset("""
the and of to a in is that for it as was with be by on not he his but at are this have from or had an they which
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou
el y los se del las por con no una su para es al lo como más o pero sus le ha me sin sobre este
""".split())
#: Tags whose content is no text; tags that end a block; parts of a page that are not the article.
#: RAW elements hold no markup, MUTE ones do. Only scripts and styles without an end tag run to the end of the page.
RAW = frozenset("script style noscript template iframe textarea title".split())
MUTE = frozenset("svg math object select button label legend canvas video audio".split())
BLOCKS = frozenset("""address article aside blockquote body br canvas caption center dd details dialog div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
AROUND = frozenset(["nav", "header", "footer", "aside", "menu", "dialog"])
#: Of these, the ones that hold no article: one inside means that the end tag is missing.
BEFORE = frozenset(["nav", "header", "menu"])
SECTIONS = AROUND | frozenset(["article", "main", "section", "div", "ul", "ol", "table", "dl", "body"])
ARTICLES = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CLOSED_BY_NEXT = frozenset(["p", "li", "td", "th", "tr", "dt", "dd", "option"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose class can mark a part inside an article; of the others the class speaks of the text.
PARTS = SECTIONS | frozenset(["form", "figure", "fieldset", "details", "span"])
#: A class, id or role names such a part if each of its words is a MARK or a word of the page's build, one a MARK.
MARK = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|"
                  r"side|menu|nav(?:bar|igation|menu|s)?|breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|"
                  r"respon[ds]e?|replies|reply|related|share|social|widgets?|login|search|toolbar|complementary|contentinfo")
BUILD = frozenset("""site main page top bottom global primary secondary list box bar area block section item items link links inner
outer post posts body content text title meta form button buttons icon icons group row col column panel slot unit zone thread
article articles story stories""".split())
#: Class words that speak of the layout around the article, not of a part beside it.
LAYOUT = re.compile(r"\S*[-_](?:left|right|both|none|layout|container|wrapper|by[-_]side)(?=\s|$)|(?:^|(?<=\s))(?:with|has|no)[-_]\S*")
HARD = 2
#: Bounds of pass 1: characters of a short block, of a long one; share of linked characters; shares of stop words; the
#: share of stop words in a whole page below which its language is not one of theirs.
SHORT, LONG, LINKED, STOP_LOW, STOP_HIGH, FOREIGN = 70, 200, 0.3, 0.08, 0.12, 0.02

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUICK = re.compile(r"((?:\s+[a-zA-Z_:-]+=\"[^\"<>]*\")*)\s*(/?)>")
_QUICK_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)=\"([^\"]*)\"")
_SKIP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>=<][^\s/>=<]*|=")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_DISPLAY_NONE = re.compile(r"display\s*:\s*none")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW | MUTE | AROUND}
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")


class _Block:
    __slots__ = ("bits", "linked", "around", "heading", "section", "article", "form")

    def __init__(self, around, heading, section, article, form):
        self.bits, self.linked = [], 0
        self.around, self.heading, self.section, self.article, self.form = around, heading, section, article, form


class _Reader:
    """Tags of a page, one after another; no place is read more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.last_end: dict[str, int] = {}
        self.no_comment_end = len(page) + 1

    def ends_after(self, tag: str, at: int) -> bool:
        if tag not in self.last_end:
            self.last_end[tag] = max((m.start() for m in _ENDS[tag].finditer(self.page)), default=-1)
        return self.last_end[tag] >= at

    def after_comment(self, at: int) -> int:
        """The place behind the comment whose `<!--` ends at `at`; an open one ends at its first `>`, or at the page's end."""
        page = self.page
        if page.startswith((">", "->"), at):
            return page.index(">", at) + 1
        if at < self.no_comment_end:
            if m := _COMMENT_END.search(page, at):
                return m.end()
            self.no_comment_end = at
        return len(page)

    def attributes(self, at: int):
        """(place behind the tag, attributes) of a tag whose name ends at `at`; the place is None at the page's end."""
        page, found = self.page, {}
        if m := _QUICK.match(page, at):
            for k, v in _QUICK_ATTRIBUTE.findall(m[1]):
                found.setdefault(k.lower(), v)
            return m.end(), found
        while True:
            at = _SKIP.match(page, at).end()
            if at >= len(page):
                return None, found
            if page[at] == ">":
                return at + 1, found
            if page[at] == "<":  # the tag was never closed
                return at, found
            m = _ATTRIBUTE.match(page, at)
            name, at, value = m.group().lower(), m.end(), ""
            if m := _EQUALS.match(page, at):
                at = m.end()
                quote = page[at:at + 1]
                close = page.find(quote, at + 1) if quote and quote in "\"'" and at < self.last[quote] else -1
                if close >= 0:
                    value = page[at + 1:close]
                    if ">" in value and value.rstrip().endswith("="):  # the quote that begins the next attribute
                        close = at + value.index(">")
                        value = page[at + 1:close + 1]
                    at = close + 1
                else:
                    m = _UNQUOTED.match(page, at)
                    value, at = m.group(), m.end()
            found.setdefault(name, value)


def _marked(found: dict) -> bool:
    """Whether class, id, role or a short label name a part beside the article."""
    label = found.get("aria-label", "")
    words = " ".join((found.get("class", ""), found.get("id", ""), found.get("role", ""), label if label.count(" ") < 3 else ""))
    for token in LAYOUT.sub(" ", words.lower()).split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        named = [bool(MARK.fullmatch(x)) for x in parts]
        if any(named) and all(n or x in BUILD for n, x in zip(named, parts, strict=True)):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, _Block]]:
    """(text, block) of every block that is not empty, in page order; the time is linear in the page."""
    reader, out, links, sections, forms = _Reader(page), [], 0, 0, 0
    # (tag, around, section, form): around is what holds inside the element: 0, 1 (a mark) or HARD
    stack: list[tuple] = []
    counts: dict[str, int] = {}
    inside = {"article": 0, "mute": 0, "hard": 0}
    block = _Block(False, False, 0, False, 0)

    def top(k, none=0):
        return stack[-1][k] if stack else none

    def push(tag, around, section, form, hard=False):
        stack.append((tag, around, section, form, hard))
        counts[tag] = counts.get(tag, 0) + 1
        inside["article"] += tag in ARTICLES
        inside["mute"] += tag in MUTE
        inside["hard"] += hard

    def pop():
        tag, _, _, _, hard = stack.pop()
        counts[tag] -= 1
        inside["article"] -= tag in ARTICLES
        inside["mute"] -= tag in MUTE
        inside["hard"] -= hard
        return tag

    def close(tag):
        if counts.get(tag):
            while pop() != tag:
                pass

    def turn(heading=False):
        nonlocal block
        text = _SPACES.sub(" ", html.unescape("".join(block.bits))).strip()
        if text:
            out.append((text, block))
        block = _Block(bool(top(1)) or inside["hard"] > 0, heading, top(2), inside["article"] > 0, top(3))

    def say(text):
        if text and not inside["mute"]:
            block.bits.append(text)
            if links:
                block.linked += len(text.strip())
    at, said = 0, 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            say(page[said:start])
            at = said = reader.after_comment(start + 4)
            continue
        if page.startswith("<![CDATA[", start):
            say(page[said:start])
            end = page.find("]]>", start)
            at = said = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), start):
            say(page[said:start])
            end = page.find(">", start)
            at = said = end + 1 if end >= 0 else len(page)
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            at = start + 1
            continue
        end, found = reader.attributes(name.end())
        if found and start and page[start - 1].isalnum() and not closing and "=" not in page[name.end():end]:
            at = start + 1  # a<b and c>d: words, no tag
            continue
        say(page[said:start])
        at = said = len(page) if end is None else end
        if end is None:
            break
        tag = name.group().lower()
        empty = page[end - 2:end] == "/>"
        if tag in RAW and not closing:
            if reader.ends_after(tag, at) and (tag in ("script", "style") or not empty):
                at = said = _ENDS[tag].search(page, at).end()
            elif tag in ("script", "style"):
                at = said = len(page)
            turn()
            continue
        if tag in MUTE and not closing:
            # self-closed, or never closed: empty; else up to its end tag or that of an element around it
            turn()
            if not empty and reader.ends_after(tag, at):
                push(tag, top(1), top(2), top(3))
            continue
        if inside["mute"]:
            if closing:
                close(tag)
                if not inside["mute"]:
                    turn()
            elif tag in BLOCKS and tag not in VOID and not empty:
                push(tag, top(1), top(2), top(3))
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag not in BLOCKS:
            continue
        if closing:
            close(tag)
            links = 0 if tag in SECTIONS else links
            turn()
            continue
        if tag not in VOID and not empty:
            if tag in CLOSED_BY_NEXT:  # an open one ends here
                while stack and stack[-1][0] == tag:
                    pop()
            article = inside["article"] > 0
            marked = (tag in PARTS or not article) and _marked(found)
            # a header inside the article is the article's own head
            own_head = tag == "header" and article
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(
                _DISPLAY_NONE.search(found.get("style", "").lower()))
            around = top(1)
            # an article in another one, or with a mark of its own, may be a comment: it ends no outer mark
            if tag in ARTICLES and not marked and not counts.get("article") and around < HARD:
                around = 0
            if tag in AROUND and not own_head:
                # what holds no article, or has no end tag, ends at an article inside it
                around = max(around, 1 if tag in BEFORE or not reader.ends_after(tag, at) else HARD)
            elif marked and not own_head and tag not in ("body", "html", *ARTICLES):
                around = max(around, 1)
            form = top(3)
            if tag == "form":
                forms += 1
                form = forms if not article else -1
            elif tag in ARTICLES and not marked:
                form = 0
            if tag in SECTIONS:
                sections += 1
            push(tag, around, sections if tag in SECTIONS else top(2), form, hidden)
        turn(tag in HEADINGS)
    else:
        say(page[said:])
    turn()
    return out


def _length(text: str) -> int:
    """Characters, those of scripts without spaces counting for three."""
    return len(text) + 2 * len(_DENSE.findall(text))


def density(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(text: str, block: _Block, foreign: bool = False) -> bool | None:
    """True: good, False: bad, None: open. A page in a language without stop words here is judged by lengths and links."""
    if block.around:
        return False
    linked = block.linked / len(text)
    if linked > LINKED:
        return None if block.article else False
    size = _length(text)
    if size < SHORT or block.heading:
        return None
    if foreign:
        return True
    stops, words = density(text)
    share = stops / max(1, words)
    if share >= STOP_HIGH or (share >= STOP_LOW and size >= LONG):
        return True
    if block.article:  # its place speaks for it
        return None
    return False if share < STOP_LOW and size >= LONG else None


def second_pass(labels: list[bool | None], blocks: list[_Block]) -> list[bool]:
    """Open blocks take the label of the nearest decided block."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    same_before, same_after = [None] * n, [None] * n
    for order, near, same in ((range(n), before, same_before), (range(n - 1, -1, -1), after, same_after)):
        last, by_section = None, {}
        for i in order:
            near[i], same[i] = last, by_section.get(blocks[i].section)
            if labels[i] is not None:
                last = by_section[blocks[i].section] = i
    out = []
    for i, label in enumerate(labels):
        if label is None:
            found = [j for j in (same_before[i], same_after[i]) if j is not None]
            if found:
                gap = min(abs(j - i) for j in found)
                label = any(labels[j] for j in found if abs(j - i) == gap)
            else:
                found = [j for j in (before[i], after[i]) if j is not None]
                label = blocks[i].article or any(labels[j] for j in found)
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines; '' for a null or empty page."""
    found = blocks_of(page or "")
    counted = [density(t) for t, b in found if not b.around and _length(t) >= SHORT]
    foreign = sum(s for s, _ in counted) < FOREIGN * sum(w for _, w in counted)
    labels = [first_pass(t, b, foreign) for t, b in found]
    # a form that holds a long good text is a frame around the page; of any other form nothing is text
    frames = {b.form for (t, b), label in zip(found, labels, strict=True) if label and b.form > 0 and _length(t) >= LONG}
    kept = [k for k, (_, b) in enumerate(found) if b.form == 0 or b.form in frames]
    good = second_pass([labels[k] for k in kept], [found[k][1] for k in kept])
    return "\n".join(found[k][0] for k, g in zip(kept, good, strict=True) if g)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: <id_col>, <url_col>, text, n_chars.

    A null or empty page, or one without main text, has an empty text of 0 characters. A
    page of plain text without tags is one block. Unclosed and stray tags are tolerated;
    nothing is cut off. Repeated rows are extracted each; an empty table gives an empty
    result; other columns are ignored.
    """
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([main_text(h if isinstance(h, str) else None) for h in s], dtype=object)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                        F.pandas_udf(run, "string")(F.col(html_col)).alias("_text"))
    return rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"),
                       F.length("_text").cast("long").alias("n_chars"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
