"""Main text of web pages by two passes over their blocks.

Pass one labels each block by itself. Dense links make it bad; LONG_WORDS words or more with many function words make
it good, with few of them bad; the rest, mostly short, is open. Function words are those of four languages: a page that
has hardly any of them in all its blocks is in another language, and there length and links decide alone. (Of scripts
without spaces two characters count as a word.) Markup is evidence beside that: menus, page headers and footers, asides,
forms, notices, adverts and reader comments are bad whatever they say; on a page that marks its article, what stands
beside the article is bad too, and long blocks within it without function words stay open. A class, id or role says so
if it is such a word, alone or with words of layout (comment-list); a name that holds such a word among others
(social-studies) makes open blocks bad if they are outside of an article and nothing else in that element is good.
Pass two gives open blocks the label that their nearest decided neighbours share; where these differ, the nearer one's,
counted in words; of equally near ones a heading takes the later and other blocks the earlier. A page's edges count as
bad neighbours; blocks of an article look for neighbours within it, and are good if it has no decided block.

Defined results: null and empty html give an empty text; html without any good block gives an empty text; character
references are decoded once; comments, scripts and styles that are never closed reach to the end, text areas and the like
to the next tag, buttons and lists of choices to the next tag of a block; repeated rows give equal texts; very long pages are read whole; an empty table gives an empty result; further columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrymill.llm.quality import STOP_WORDS

_RAW = "script|style"
#: Elements whose text is never shown as such, up to their closing tag.
_HIDDEN = frozenset("template iframe title textarea".split())
_TOKEN = re.compile(
    # attributes end at the next tag's bracket, and are not tried in shorter forms: unclosed tags cost no second look
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*+>",
    re.S | re.I,
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    # what stands within a line of text, and may have text of its own
    "math mi mn mo mrow mfrac msup msub msubsup msqrt mroot mtext mspace mover munder mstyle semantics "
    "svg g path circle rect line text tspan object canvas noscript picture audio video".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text, and names (of class, id or role) that say so.
_NEVER = frozenset("nav footer aside form menu dialog select button".split())
#: Elements that a button or a list of choices cannot hold: one that is still open ends there.
_CLOSES = frozenset("p h1 h2 h3 h4 h5 h6 article section main ul ol dl table form nav header footer aside".split())
_NAME = re.compile(
    r"(?:ads?|advert\w*|advertisement|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|footer|masthead|"
    r"comments?|comment\w*|respond|replies|cookies?|consent|notice|newsletter|subscribe|signup|login|popup|modal|share|sharing|social|"
    r"related|recommended|widget|toolbar|pagination|pager|copyright|disclaimer|search|contentinfo|complementary|navigation)",
    re.I,
)
#: Words of layout that names are put together with.
_LAYOUT = frozenset(
    "site page main top bottom left right list box bar wrap wrapper container section area block item items inner outer header head body "
    "link links primary secondary global local form text unit slot first last row col column panel group content small large sticky fixed js".split()
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of scripts that are written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_STOPS = frozenset(STOP_WORDS)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Thresholds of pass one.
LONG_WORDS, STOP_DENSITY, FEW_STOPS, LINK_DENSITY = 12, 0.15, 0.05, 0.5
GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class Block:
    text: str
    n_words: int
    stop_density: float
    link_density: float
    n_links: int
    never: bool
    article: bool
    heading: bool
    label: str = OPEN
    n_named: int = 0
    n_stops: int = 0
    doubtful: int = 0  # the outermost element of a doubtful name that it is in, counted from 1


@dataclass
class _State:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    n_links: int = 0
    heading: bool = False


def blocks(html: str) -> list[Block]:
    """The page's blocks of text, in order, with what pass one looks at."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, int]] = []  # element; before it: in markup that is never text, in an article, of a doubtful name
    now, links, at = _State(), 0, 0
    never = article = False
    doubtful = n_doubtful = 0
    unclosed: set[str] = set()  # hidden elements that no closing tag follows any more

    def end() -> None:
        nonlocal now
        text = " ".join("".join(now.parts).split())
        if text:
            found = _WORD.findall(text.lower())
            stops = sum(w in _STOPS for w in found)
            share = min(1.0, now.link_chars / len(text))
            n = len(text.split()) + (0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)
            density = stops / len(found) if found else 0.0
            out.append(Block(text, n, density, share, now.n_links, never, article, now.heading, OPEN, len(found), stops, doubtful))
        now = _State(n_links=0)

    def say(text: str) -> None:
        if text:
            text = unescape(text)
            now.parts.append(text)
            if links:
                now.link_chars += len(" ".join(text.split()))

    while m := _TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _HIDDEN:
            if not m["close"]:
                shut = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if shut is None:
                    unclosed.add(name)
                    at = next_tag if (next_tag := html.find("<", at)) >= 0 else len(html)
                else:
                    at = shut.end()
        elif name == "br":
            now.parts.append(" ")
        elif name in _VOID:
            if name == "hr":
                end()
        elif name in _INLINE:
            if name == "a":
                links = max(0, links - 1) if m["close"] else 1
                now.n_links += not m["close"]
            if not m["close"] and "=" in m["rest"] and name in ("span", "small", "label") and _unwanted(m["rest"]) == NEVER:
                end()
                open_.append((name, never, article, doubtful))
                never = True
            elif m["close"] and open_ and open_[-1][0] == name:
                end()
                _, never, article, doubtful = open_.pop()
        elif m["close"]:
            end()
            links = 0
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    _, never, article, doubtful = open_[i]
                    del open_[i:]
                    break
        else:
            end()
            links = 0
            if open_ and (open_[-1][0] == "p" or open_[-1][0] == name == "li"):  # closed by what follows
                _, never, article, doubtful = open_.pop()
            while name in _CLOSES and open_ and open_[-1][0] in ("select", "button", "option", "optgroup"):
                _, never, article, doubtful = open_.pop()
            open_.append((name, never, article, doubtful))
            said = _unwanted(m["rest"]) if "=" in m["rest"] and name not in ("html", "body") else ""
            never = never or name in _NEVER or (name == "header" and not article) or said == NEVER
            if said == DOUBTFUL and not doubtful:
                doubtful = n_doubtful = n_doubtful + 1
            article = article or name in ("article", "main")
            now.heading = name in _HEADINGS
    say(html[at:])
    end()
    return out


NEVER, DOUBTFUL = "never", "doubtful"


def _unwanted(rest: str) -> str:
    """What names in a tag's attributes say of its text: it is never the article's, that is doubtful, or nothing."""
    found = ""
    for a, b, c in _ATTRIBUTE.findall(rest):
        # has-sidebar, no-ads and the like are said of what stands beside them
        for name in re.sub(r"\b(?:with|has|no|without)[-_]\w+", "", a or b or c).split():
            parts = [x for x in re.split(r"[-_]+", name.lower()) if x and not x.isdigit()]
            listed = [_NAME.fullmatch(x) is not None for x in parts]
            if any(listed):
                if all(x or part in _LAYOUT for x, part in zip(listed, parts, strict=True)):
                    return NEVER
                found = DOUBTFUL
    return found


def first_pass(b: Block, has_article: bool, listed: bool = True) -> str:
    """A block's label by itself.

    Length and densities decide; markup is evidence beside them: what is never text is bad whatever it says, and so is
    what stands beside the article of a page that marks one, while within it a long block without function words (of a
    language that is not listed, say) stays open. listed: whether function words of the page's language are known.
    """
    if b.never or (has_article and not b.article):
        return BAD
    if b.link_density > LINK_DENSITY:
        return BAD if b.n_links > 1 or not b.article else OPEN
    if b.n_words >= LONG_WORDS and (b.stop_density >= STOP_DENSITY or not listed):
        return GOOD
    if b.n_words >= LONG_WORDS and b.stop_density < FEW_STOPS and not b.article:
        return BAD
    return OPEN


def classify(found: list[Block]) -> list[Block]:
    """Both passes. Neighbours of an article's blocks are those of the article."""
    has_article = any(b.article and not b.never for b in found)
    words = sum(b.n_named for b in found)
    listed = sum(b.n_stops for b in found) >= FEW_STOPS * words
    for b in found:
        b.label = first_pass(b, has_article, listed)
    prose = {b.doubtful for b in found if b.label == GOOD}
    for b in found:
        if b.label == OPEN and b.doubtful and not b.article and b.doubtful not in prose:
            b.label = BAD
    inside = [b for b in found if b.article and not b.never] if has_article else found
    edge = OPEN if has_article else BAD
    before, after = _neighbours(inside, edge), _neighbours(inside[::-1], edge)[::-1]
    labels = [second_pass(b, *left, *right) for b, left, right in zip(inside, before, after, strict=True)]
    for b, label in zip(inside, labels, strict=True):
        b.label = label
    return found


def second_pass(b: Block, left: str, far_left: int, right: str, far_right: int) -> str:
    """An open block's label by its nearest decided neighbours; an article without any decided block is good."""
    if b.label != OPEN:
        return b.label
    if left == right:
        return GOOD if left == OPEN else left
    if OPEN in (left, right):
        return left if right == OPEN else right
    if far_left == far_right:
        return right if b.heading else left
    return left if far_left < far_right else right


def _neighbours(found: list[Block], edge: str) -> list[tuple[str, int]]:
    """Each block's nearest decided block before it: label and words between; `edge` where there is none."""
    out, label, far = [], edge, 0
    for b in found:
        out.append((label, far))
        label, far = (b.label, 0) if b.label != OPEN else (label, far + b.n_words)
    return out


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(html)) if b.label == GOOD) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
