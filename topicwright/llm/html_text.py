"""Main text of web pages by two-pass block rules.

A page is read once from left to right: comments, scripts, styles and the like
go, tags open and close elements on a stack (closing tags that nothing answers
are left aside, `p`, `li` and such end an open one of their kind), and text
falls into blocks at the borders of block elements. Each block knows whether it
lies in an element that never holds article text (by tag, role, class or id),
whether in an article or main element, and how much of it is link text.

Every page goes through both passes; whether a block lies in a marked article is
one of the features of the first. Pass 1 decides blocks by length, link density
and share of stop words. Outside of articles a block is good, bad or undecided
(short, or near the border). In an article a block is good if it is long, or not
short and has stop words enough, and else undecided, never bad. On a
page that marks an article, what lies outside is bad but for long blocks full of
stop words, which are undecided. Pass 2 gives undecided blocks the label of their
nearest decided neighbours. In an article these are its own; one without any
decided block is a teaser if it has links and another article is decided, and
then goes by the blocks on both sides of it, else its blocks are good. Outside,
the blocks on both sides must be good, or near-good ones on either side. So
articles split over several elements come whole, in page order. An article in an
article, or one marked as a comment, is left out (comments unless the page has no
other text).

Elements that never hold article text are left out by tag, role and hiding
attributes, and by words of class and id: in an article only containers, and
only names made of such words and neutral ones.

Defined results: null or empty html gives an empty text; markup that ends in the
middle ends there; repeated rows give a row each.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes

SLICE_BYTES = 8 << 20

#: Block elements: text on either side of their tags is in different blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no markup and never article text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements that never hold article text.
OUTSIDE = frozenset("nav footer aside form button select datalist dialog menu noscript object svg canvas template audio video head search label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status tablist".split())
#: Words of class and id names of such elements, by the kind they mark.
MARKS = frozenset(
    (
        "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar "
        "header masthead footer copyright legal sidebar aside widget widgets related recommended recommendations trending "
        "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner "
        "notice notices cookie cookies consent gdpr alert popup modal overlay paywall newsletter subscribe subscription signup login form search "
        "share sharing social comment comments commentlist reply replies respond disqus discussion reactions"
    ).split()
)
#: Words of class and id names of articles that are readers' comments.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that say nothing of what an element holds, beside those of MARKS.
NEUTRAL = frozenset("article post entry page site main content body box bar block list links link section wrapper wrap container inner outer area item items group row col column button buttons icon icons top bottom left right primary secondary mobile desktop print js the and slot unit panel title heading message".split())
#: Elements that hold others, not a passage of text.
CONTAINERS = frozenset("div section ul ol dl table details center fieldset hgroup address".split())
#: An open element that a start tag of the key's kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements at which the search for an open element stops.
SCOPES = frozenset("ul ol dl table article main section aside nav div body form footer header select".split())

#: Frequent words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her him his how i if in into is it its may more my no not of on one only or other our out she should so some such than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et été être il ils je la le les leur lui mais même ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur tout un une vous
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le les lo los más me mi muy no nos o para pero por que qué se ser si sin sobre son su sus también un una y ya
    """.split()
)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)|[^>])*+)(?:>|\Z)"
    r"|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>][^\s>]*))|(?<![^\s/])(hidden)(?![^\s/])""", re.I)
_ARTICLE = re.compile(r"<article(?=[\s/>])", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    text: str
    link_chars: int
    article: int  # number of the article element, negative in one marked as a comment, 0 outside of any
    heading: bool
    label: str = ""


@dataclass
class _Open:
    name: str
    outside: bool
    article: int
    header: bool = False


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    opened: Counter[str] = field(default_factory=Counter)
    text: list[str] = field(default_factory=list)
    link: int = 0
    link_from: int | None = None
    heading: bool = False
    articles: int = 0

    def flush(self) -> None:
        if self.text:
            found = " ".join("".join(self.text).split())
            if found:
                top = self.stack[-1] if self.stack else None
                outside = bool(top and (top.outside or (top.header and not (top.article and self.heading))))
                if not outside:
                    self.blocks.append(Block(found, min(self.link, len(found)), top.article if top else 0, self.heading))
            self.text = []
        self.link = 0

    def push(self, made: _Open) -> None:
        self.stack.append(made)
        self.opened[made.name] += 1

    def close(self, names: set[str] | frozenset[str], until: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these names and all in it, if no element of `until` is in between."""
        if not any(self.opened[name] for name in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name in names:
                self.opened.subtract(x.name for x in self.stack[k:])
                del self.stack[k:]
                return
            if self.stack[k].name in until:
                return


def _attributes(text: str) -> dict[str, str]:
    """Names and values; the first of several of one name counts."""
    found: dict[str, str] = {}
    for key, a, b, c, hidden in _ATTRIBUTE.findall(text):
        found.setdefault((key or hidden).lower(), a or b or c)
    return found


def _hidden(own: dict[str, str]) -> bool:
    """Whether role or a hiding attribute says that the element holds no article text."""
    return own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I))


def _marks(own: dict[str, str], marks: frozenset[str], only: bool = False) -> bool:
    """Whether a name in class or id has a word of marks; only: and else no words but neutral ones."""
    for name in (own.get("class", "") + " " + own.get("id", "")).split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if {"has", "no", "with", "without"} & set(parts[:1]) or not marks & set(parts):
            continue
        if not only or all(p in marks or p in NEUTRAL or p.isdigit() for p in parts):
            return True
    return False


def blocks(source: str) -> list[Block]:
    """Blocks of a page in page order, without those in elements that never hold article text."""
    r = _Reader()
    at, n = 0, len(source)
    last_article = max((m.start() for m in _ARTICLE.finditer(source)), default=-1)
    while at < n:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            if "&" in text:
                text = entities.unescape(text)
            r.text.append(text)
            if r.link_from is not None:
                r.link += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in BLOCK:
                r.flush()
                if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    r.heading = False
                r.close({name})
            elif name == "a":
                r.link_from = None
            elif name in OUTSIDE:
                r.flush()
                r.close({name})
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = closing.end() if closing else n
            continue
        if name == "br":
            r.text.append(" ")
        elif name == "a":
            r.link_from = at
        elif name in BLOCK or name in OUTSIDE:
            r.flush()
            if name in VOID or m["attributes"].endswith("/") and name in OUTSIDE:
                continue
            if name in BLOCK:
                r.close({"p"}, SCOPES)
                if name in ENDS:
                    r.close(ENDS[name], SCOPES - {"div"} if name != "li" else SCOPES)
            r.link_from = None
            r.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            top = r.stack[-1] if r.stack else _Open("", False, 0)
            outside, article = top.outside, top.article
            if name not in ("html", "body"):
                own = _attributes(m["attributes"]) if m["attributes"].strip() else {}
                marked = name in OUTSIDE or _hidden(own)
                if name not in ("article", "main"):
                    marked = marked or (name in CONTAINERS and _marks(own, MARKS, only=True) if article else _marks(own, MARKS))
                outside = outside or marked
                if article and name == "article":
                    outside = True  # an article in an article is a comment or a teaser
                if not outside and not article and (name == "article" or (name == "main" or own.get("role", "").lower() == "main") and at > last_article):
                    r.articles += 1
                    article = -r.articles if name == "article" and _marks(own, COMMENTS) else r.articles
            r.push(_Open(name, outside, article, top.header or name == "header"))
    r.flush()
    return r.blocks


@dataclass(frozen=True)
class Rules:
    """Borders of pass 1; lengths in characters."""

    short: int = 70
    long: int = 200
    links: float = 0.2
    stops_low: float = 0.30
    stops_high: float = 0.32


def _first(b: Block, rules: Rules, marked: bool) -> str:
    """Label of a block by itself: good, bad, near (near the border) or short; marked: the page marks an article."""
    size, linked = len(b.text), b.link_chars > rules.links * len(b.text)
    if b.article > 0 and (linked or size < rules.short or size > rules.long):
        return "good" if size > rules.long and not linked else "short"
    if b.article < 0 or b.article == 0 and (linked or re.match(r"(?:©|\(c\)|copyright\b)", b.text, re.I)):
        return "bad"
    if b.article == 0 and not marked and size < rules.short:
        return "bad" if b.link_chars else "short"
    words = _WORDS.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.article > 0:
        return "good" if stops >= rules.stops_low else "short"
    if marked:
        return "near" if size > rules.long and stops >= rules.stops_high else "bad"
    if stops >= rules.stops_high:
        return "good" if size > rules.long else "near"
    return "near" if stops >= rules.stops_low else "bad"


def _sides(first: list[str], accepted: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """For each block the nearest label of the accepted ones before and after it; bad at the page's ends."""
    out = []
    for order in (range(len(first)), reversed(range(len(first)))):
        near, seen = ["bad"] * len(first), "bad"
        for k in order:
            near[k] = seen
            if first[k] in accepted:
                seen = first[k]
        out.append(near)
    return out[0], out[1]


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Sets each block's label to good or bad."""
    marked = any(b.article > 0 for b in found)
    first = [_first(b, rules, marked) for b in found]
    before, after = _sides(first, ("good", "bad"))
    before_near, after_near = _sides(first, ("good", "bad", "near"))
    decided = {b.article for b, label in zip(found, first, strict=True) if b.article > 0 and label == "good"}
    linked = {b.article for b in found if b.link_chars}
    for k, b in enumerate(found):
        b.label = first[k]
        if b.article > 0:
            teaser = b.article not in decided and decided and b.article in linked
            b.label = "good" if not teaser or before[k] == after[k] == "good" else "bad"
        elif first[k] == "near":
            sides = {before[k], after[k]}
            b.label = "good" if sides == {"good"} or not marked and "good" in sides else "bad"
        elif first[k] == "short":
            sides = {after_near[k]} if b.heading else {before_near[k], after_near[k]}
            b.label = "good" if sides <= {"good"} or "near" in sides and ("good" in sides or sides == {"near"}) else "bad"
    return found


def main_text(source: str | None, rules: Rules = Rules()) -> str:
    found = classify(blocks(source or ""), rules)
    own = [b for b in found if b.label == "good"] or [b for b in found if b.article]
    return "\n\n".join(b.text for b in own)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page; other columns are left out."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html", SLICE_BYTES):
                texts = [main_text(x, rules) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
