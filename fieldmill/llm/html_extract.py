"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by what it stands
in, its link density, its length and its density of stop words: good, bad, or ambiguous where it
is short. The second pass gives an ambiguous block the label of its nearest decided neighbours:
both agree, or the nearer one, or the edge of what it stands in (the edge of an article counts as
good and the edge of a page as bad). Good blocks in page order are the text.

Elements that say what they are need no guess: navigation, footers, asides, forms, scripts, styles,
adverts, notices and reader comments are bad. A name of several words says what its last one does,
containers apart: google-ad and comment-thread, not notice-board. Where the words before aren't known,
weaker names (menu, alert, share and the like) only make a block doubtful, which is good if it is long,
has the stop words of a text and few links. An article isn't bad for its own names, but one that is
called a comment is, where there are others.

Where a page marks an article, what stands outside it is its text only if it is long, has many stop
words and hardly a link; inside it no long block is bad for its words: one with few stop words is
ambiguous, as are short ones, and links must make up four fifths of a short block to make it bad.

Stop words tell nothing about languages that the list doesn't have. Where the long blocks of a page
together have few of them, or a block is in another script or reads like sentences without one, it is
decided by length and link density alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces, strings

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qui que sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der die ein eine einen er es für hat ich im in ist mit nach nicht sich sie sind und von war wie zu zum zur "
    "al como con del el en era es esta fue ha la las lo los más no o para pero por que se sin sobre su sus un una y ya "
    "che da dei della di e gli i il ma nel non per più si sono è com do dos em foi mais na não os pela são uma aan dat een het naar niet ook op te van voor zijn".split()
)
# Elements, and words of class, id and role attributes.
SKIPPED = frozenset("nav footer aside form button select option textarea input label fieldset dialog menu noscript template iframe object svg canvas audio video map head".split())
RAW = frozenset("script style title noframes noembed xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset("article main".split())
ARTICLE_WORDS = frozenset("articlebody articlecontent articletext entrycontent maincontent pagecontent postbody postcontent storybody storycontent".split())
BAD_WORDS = frozenset(
    "ad ads adslot adbox advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices disclaimer newsletter subscribe "
    "subscription signup login popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments "
    "commentlist commenters disqus replies reply respond share sharing social related recommended widget toolbar complementary contentinfo search alert dialog alertdialog skiplink".split()
)
# Of these the names that may be an article's subject too, where words beside them aren't known.
DOUBTFUL_WORDS = frozenset("menu menus search alert dialog share sharing social related recommended widget toolbar reply respond promo promotion promotions sponsor sponsors popup modal overlay cookie cookies consent subscription login signup banner".split())
# Words that stand beside those in a name and change nothing about it.
NEUTRAL = frozenset(
    "area articles aside bar block body bottom box btn button buttons card center col column container content count div element feed form frame global group header heading holder icon icons inner item items label large left "
    "link links list main mobile module notification outer panel post posts primary region right row secondary section site slot small stories stream sub tag tags text thread threads title top unit view wrap wrapper zone".split()
)
#: A word of an attribute that begins so tells of a page's layout, as in has-sidebar.
LAYOUT_WORDS = frozenset("no without has with hide full non".split())

LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS, LINKS_ARTICLE, LINKS_OUTSIDE = 70, 200, 0.15, 0.25, 0.3, 0.8, 0.05

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z:_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z0-9]+(?:[-_]+[a-z0-9]+)*", re.I)
GOOD, BAD, AMBIGUOUS = 1, -1, 0


CERTAIN, DOUBTED, HIDDEN = 1, 2, 3
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _named(name: str) -> int:
    """What a name says: CERTAIN, DOUBTED or nothing (0). It says what its last word does, containers
    and numbers apart, but nothing where it tells of a layout, as has-sidebar."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    joined = "".join(parts)
    if joined in BAD_WORDS:
        return CERTAIN
    if any(p in LAYOUT_WORDS for p in parts):
        return 0
    kept = list(parts)
    while kept and (kept[-1] in NEUTRAL and kept[-1] not in BAD_WORDS or kept[-1].isdigit()):
        kept.pop()
    if not kept or kept[-1] not in BAD_WORDS:
        return 0
    known = all(p in BAD_WORDS or p in NEUTRAL or p.isdigit() for p in kept)
    return DOUBTED if kept[-1] in DOUBTFUL_WORDS and not known else CERTAIN


def _marks(attributes: str) -> tuple[int, bool]:
    """What attributes say against a block (HIDDEN, CERTAIN, DOUBTED or 0), and whether they name an article."""
    bad = HIDDEN if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) else 0
    good, named = False, 0
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            for word in _WORD.findall(value):
                word = _HUMP.sub("-", word).lower()
                good |= re.sub(r"[-_]+", "", word) in ARTICLE_WORDS or (name == "role" and word in ("main", "article"))
                says = _named(word)
                named = CERTAIN if CERTAIN in (says, named) else says or named
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            bad = HIDDEN
    return bad or (0 if good else named), good


class Block:
    __slots__ = ("parts", "linked", "bad", "doubted", "article", "heading", "text")

    def __init__(self, bad: bool, article: int, heading: bool, doubted: bool = False):
        self.parts, self.linked, self.bad, self.doubted, self.article, self.heading, self.text = [], 0, bad, doubted, article, heading, ""


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # element, bad so far, number of the article (0: outside), doubted
    called: set[int] = set()  # articles whose own names speak against them
    opened: Counter[str] = Counter()  # elements on the stack by name, so that a stray end tag costs nothing
    articles = links = breaks = 0
    now: Block | None = None
    heading = False

    def text(raw: str) -> None:
        nonlocal now, breaks
        if raw and (now is not None or not raw.isspace()):
            if now is None:
                _, bad, article, doubted = stack[-1] if stack else ("", False, 0, False)
                now = Block(bad, article, heading, doubted)
                out.append(now)
            plain = html.unescape(raw) if "&" in raw else raw
            now.parts.append(plain)
            if links:
                now.linked += len(plain)
            if not raw.isspace():
                breaks = 0

    def push(name: str, bad: bool, article: int, doubted: bool) -> None:
        stack.append((name, bad, article, doubted))
        opened[name] += 1

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def close(name: str) -> None:
        while opened[name] and pop() != name:
            pass

    at, find = 0, _TAG.search
    while m := find(page, at):
        text(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not end:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if not stop:
                at = len(page)
                break
            at = page.find(">", stop.start()) + 1 or len(page)
            continue
        if name == "a":
            links = 0 if end else 1
        elif name == "br":
            breaks += 1
            if breaks > 1:
                now = None
            else:
                text(" ")
        elif name in BLOCKS or name in SKIPPED:
            now, breaks = None, 0
            if name == "p" or name in HEADINGS or name in ARTICLES:
                links = 0  # a link that was never closed ends here
            heading = name in HEADINGS and not end
            if end:
                close(name)
            elif name not in VOID:
                if stack and stack[-1][0] == "p" and name in BLOCKS:
                    pop()
                if name == "li" and stack and stack[-1][0] == "li":
                    pop()
                above = stack[-1] if stack else ("", False, 0, False)
                says, good = _marks(attributes) if attributes.strip() else (0, False)
                if name in ("html", "body"):
                    says = 0
                article, doubted = above[2], above[3] or says == DOUBTED
                bad = says in (CERTAIN, HIDDEN)
                if (name in ARTICLES or good) and not article and not above[1] and says != HIDDEN:
                    articles += 1
                    article = articles
                    if says:
                        called.add(article)
                    bad, doubted = False, above[3]
                skip = name in SKIPPED or (name == "header" and not article)
                push(name, above[1] or bad or skip, article, doubted)
        elif not end and name not in VOID and attributes and (says := _marks(attributes)[0]):
            now = None
            above = stack[-1] if stack else ("", False, 0, False)
            push(name, above[1] or says != DOUBTED, above[2], above[3] or says == DOUBTED)
        elif end and opened[name]:
            now = None
            close(name)
    text(page[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    if called and any(b.article and b.article not in called and not b.bad for b in out):
        for b in out:
            b.bad |= b.article in called
    return out


def labels(blocks: list[Block]) -> list[int]:
    """GOOD or BAD for every block."""
    marked = any(b.article and not b.bad for b in blocks)
    dense = [stop_words(b) if not b.bad and len(b.text) >= LENGTH_LOW and b.linked <= LINKS * len(b.text) else (0, 0) for b in blocks]
    inside = [d for b, d in zip(blocks, dense) if b.article or not marked]
    known = sum(n for n, _ in inside) >= STOP_LOW * sum(n for _, n in inside)
    first = []
    for b, (stops, words) in zip(blocks, dense):
        size = len(b.text)
        links, stop = b.linked / max(1, size), stops / max(1, words)
        if b.bad:
            first.append(BAD)
        elif b.doubted or (marked and not b.article):
            first.append(GOOD if size >= LENGTH_HIGH and stop >= STOP_HIGH and links <= LINKS_OUTSIDE else BAD)
        elif links > (LINKS_ARTICLE if b.article or b.heading else LINKS) and not (b.heading and b.article):
            first.append(AMBIGUOUS if b.article and size >= LENGTH_LOW else BAD)
        elif size < LENGTH_LOW:
            first.append(AMBIGUOUS)
        elif not known or stop >= STOP_HIGH or (stop >= STOP_LOW and size >= LENGTH_HIGH) or (stop < STOP_LOW and foreign(b)):
            first.append(GOOD)
        else:
            first.append(AMBIGUOUS if stop >= STOP_LOW or b.article else BAD)
    before, seen = [], None
    for i, (b, v) in enumerate(zip(blocks, first)):
        if v and decides(b):
            seen = (i, v, b.article)
        before.append(seen)
    out, seen = [0] * len(blocks), None
    for i in range(len(blocks) - 1, -1, -1):
        b, v = blocks[i], first[i]
        if v:
            out[i] = v
            if decides(b):
                seen = (i, v, b.article)
            continue
        edge = GOOD if b.article else BAD
        near = [x if x and x[2] == b.article else None for x in (before[i], seen)]
        left, right = (x[1] if x else edge for x in near)
        if left == right:
            out[i] = left
        elif b.heading and right == GOOD:
            out[i] = GOOD
        else:
            gaps = [abs(i - x[0]) if x else far for x, far in zip(near, (i + 1, len(blocks) - i))]
            out[i] = left if gaps[0] < gaps[1] else right if gaps[1] < gaps[0] else GOOD
    if GOOD not in out:  # nothing was decided: all that isn't known to be bad
        out = [GOOD if not b.bad and not links_only(b) and (not v or (w and not marked)) else BAD for b, v, (_, w) in zip(blocks, first, dense)]
    return out


def stop_words(b: Block) -> tuple[int, int]:
    """Stop words and words of a block."""
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def foreign(b: Block) -> bool:
    """Whether a block reads like text of a language whose stop words aren't known: most of its letters
    are of another script than Latin, or it ends as a sentence, with few digits and few capitals."""
    letters = [c for c in b.text if c.isalpha()]
    if 2 * sum(c > "\u024f" for c in letters) > len(letters):
        return True
    words = b.text.split()
    return b.text.rstrip("\"')»”")[-1:] in (".", "!", "?", "…") and 20 * sum(c.isdigit() for c in b.text) <= len(b.text) and 4 * sum(w[:1].isupper() for w in words) <= len(words)


def decides(b: Block) -> bool:
    """Whether a block's label says something about its neighbours."""
    return not (b.bad or b.doubted or links_only(b))


def links_only(b: Block) -> bool:
    return b.linked > LINKS_ARTICLE * len(b.text)


def main_text(page: str) -> str:
    """The good blocks of a page, joined by an empty line."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, v in zip(blocks, labels(blocks)) if v == GOOD)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page, from its whole html.

    A null or empty page gives an empty text; null keys and urls stay null; repeated rows are taken
    each by itself; an empty table gives no row; other columns are ignored. No row is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                texts = [main_text(p) for p in strings(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("_k"), F.col(url).cast("string").alias("_u"), F.col(page).alias("_p")).transform(mapped, run, f"`{key}` long, `{url}` string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
