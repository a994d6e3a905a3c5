"""HTML extraction by two-pass block rules.

A page is read once, from left to right, and cut into blocks at block-level tags.  Markup, comments, scripts, styles and
forms carry no text; blocks in navigation, headers, footers, asides and containers whose class or id names such a part,
an advert, a notice or reader comments are decided as boilerplate by their place.  A name counts by its words, and not
where it only says that a part is there or not (``has-sidebar``, ``no-comments``) or where a word of several meanings
stands beside a word of the page's subject (``market-share``).  An article or main element inside a named container or a
form overrules it, unless both belong to reader comments: then it is a comment.  Inline elements named as adverts are
left out of their block.

Pass 1 decides the other blocks by stop-word density, length and link density: many links make boilerplate; long
blocks with enough stop words are content; short blocks, and long ones with few stop words, stay undecided.  Inside an
article long linked blocks with enough stop words are content too, and linked headings stay undecided.  On a page whose
long blocks hold hardly any stop word that is listed, so in another language, long blocks with a sentence's end are content.
Pass 2 gives undecided blocks the label of the nearest decided neighbour.  Inside an article or main element the
neighbours are those of the element, and such an element counts as content on both its sides: its short paragraphs and
headings are part of the article.  Elsewhere a tie between two neighbours goes to boilerplate.

White space inside a block becomes one space; blocks are joined in page order by one space.  Unclosed elements end with
the page, a quote that nothing closes is a character like others, and a ``<`` that begins no tag is text.  The time is
linear in the page's length whatever it holds, so very long pages are read whole like others.

Nulls: a null page is empty, a null page_id or url is carried along.  Repeated rows are read one by one.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea noscript iframe template svg math object".split())
APART = frozenset("nav header footer aside head menu dialog button select fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = frozenset(("article", "main"))
ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
# words of class and id names
ADVERT = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banners?")
COMMENT = re.compile(r"comments?|commentlist|respond|disqus")
HINT = re.compile(r"cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|nav\w*|menus?|breadcrumbs?|sidebars?|footer|header|masthead|share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|login|signup|copyright|legal")
# words that name a part of a page alone or beside words of the second list, but not beside others
AMBIGUOUS = frozenset("share header legal related social notice notices alert alerts".split())
PART_WORDS = frozenset("site page main top bottom left right box block bar container wrap wrapper inner outer section area list link links button buttons icon icons post posts article articles stories content contents primary secondary col column row item items text media global info panel title fixed sticky mobile desktop".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ONLY_SAYS = frozenset("has have with without no not is hide hidden show".split())
STOP_WORDS = frozenset(
    """a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qui que sa se ses son sont sur un une vous
    als am auf aus bei das dem den der die dir du ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so und von vor war wie wir zu zum zur
    al como con de del el ella en es esta este fue ha las lo los más no o para pero por que se sin sobre su sus un una y ya""".split()
)
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
BETWEEN = re.compile(r"[-_]+")
SENTENCE_END = re.compile(r"[.!?…؟।](?=\s|$)|[。！？]")

HIGH_LINKS = 0.5
LONG = 60
STOP_SHARE = 0.2
FEW_STOP_WORDS = 0.05

GOOD, BAD, OPEN = 1, -1, 0


class Block:
    __slots__ = ("article", "linked", "place", "text")

    def __init__(self, text: str, linked: int, place: Place):
        self.text, self.linked, self.place, self.article = text, linked, place, place.article

    @property
    def apart(self) -> bool:
        return self.place.apart or self.place.named is not None and not self.place.named.overruled


class Named:
    """A form, or a container whose class or id names a part that isn't content."""

    __slots__ = ("overruled",)

    def __init__(self):
        self.overruled = False


class Place:
    """An open element: its name and what holds for the text in it."""

    __slots__ = ("apart", "article", "left_out", "name", "named")

    def __init__(self, name: str, around: Place | None):
        self.name = name
        self.apart = around.apart if around else False
        self.left_out = around.left_out if around else False
        self.article = around.article if around else 0
        self.named = around.named if around else None


def hint(names: str) -> str | None:
    """What a class or id says of an element: advert, comments, other, or nothing."""
    for name in names.lower().split():
        words = [w for w in BETWEEN.split(name) if w]
        if not words or words[0] in ONLY_SAYS or words[-1] == "layout":
            continue
        for kind, pattern in (("advert", ADVERT), ("comments", COMMENT)):
            if any(pattern.fullmatch(w) for w in words):
                return kind
        hints = [w for w in words if HINT.fullmatch(w)]
        if hints and (not AMBIGUOUS.issuperset(hints) or all(w in hints or w in PART_WORDS or w.isdigit() for w in words)):
            return "other"
    return None


def read_attributes(attributes: str) -> tuple[bool, str | None]:
    """(whether the element isn't shown or has a role apart, what its names say)."""
    apart, said = False, None
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            said = said or hint(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLE:
            apart = True
    return apart, said


class Reader:
    """One pass over a page; ``blocks`` are its text blocks in order."""

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[Block] = []
        self.stack: list[Place] = []
        self.open: Counter[str] = Counter()
        self.waiting: list[Named] = []  # forms and named containers around this place that no article has overruled
        self.parts: list[str] = []
        self.linked = self.links = self.articles = 0
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.outside = Place("", None)
        self._read()

    def _read(self) -> None:
        page, at = self.page, 0
        while (lt := page.find("<", at)) >= 0:
            if lt > at:
                self._text(page[at:lt])
            if m := NAME.match(page, lt + 1):
                at = self._tag(m[0].lower(), m.end())
            elif page.startswith("<!--", lt):
                at = self._after(page.find("-->", lt + 4), 3)
            elif page.startswith(("<!", "<?", "</"), lt):
                at = self._after(page.find(">", lt + 2), 1)
            else:
                self._text("<")
                at = lt + 1
        self._text(page[at:])
        self._end()

    def _after(self, found: int, size: int) -> int:
        return found + size if found >= 0 else len(self.page)

    def _close_of(self, at: int) -> int:
        """Where the ``>`` of a tag stands (or the page ends); those in quotes don't count."""
        while m := STOP.search(self.page, at):
            q = m[0]
            if q == ">":
                return m.start()
            at = self.page.find(q, m.end()) + 1 if m.start() < self.last_quote[q] else m.end()
        return len(self.page)

    def _text(self, s: str) -> None:
        if s and not (self.stack and self.stack[-1].left_out):
            self.parts.append(s)
            if self.links:
                self.linked += len(s)

    def _end(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.stack[-1] if self.stack else self.outside))
        self.parts.clear()
        self.linked = 0

    def _pop(self) -> Place:
        place = self.stack.pop()
        self.open[place.name] -= 1
        outer = self.stack[-1].named if self.stack else None
        if self.waiting and place.named is self.waiting[-1] and outer is not place.named:
            self.waiting.pop()
        return place

    def _tag(self, name: str, at: int) -> int:
        stop = self._close_of(at)
        attributes, at = self.page[at:stop], min(stop + 1, len(self.page))
        if name[0] == "/":
            self._closing(name[1:])
            return at
        if name in BLOCK:
            self._end()
        if name in RAW:
            if attributes.rstrip().endswith("/"):
                return at
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(self.page, at)
            return self._after(self.page.find(">", m.end()), 1) if m else len(self.page)
        if name == "a":
            self.links += 1
        if name in VOID or name not in BLOCK and name not in APART and "class" not in attributes and "id" not in attributes:
            return at
        if name == "p" and self.stack and self.stack[-1].name == "p":
            self._pop()
        self._opening(name, attributes)
        return at

    def _closing(self, name: str) -> None:
        if name in BLOCK:
            self._end()
        if name == "a":
            self.links = max(0, self.links - 1)
        if self.open[name]:
            while self._pop().name != name:
                pass

    def _opening(self, name: str, attributes: str) -> None:
        place = Place(name, self.stack[-1] if self.stack else None)
        apart, said = read_attributes(attributes) if attributes else (False, None)
        whole = name in ("html", "body")
        if name in ARTICLE:
            if said == "comments":
                place.apart = True
            elif not place.apart and not place.article:
                for w in self.waiting:
                    w.overruled = True
                self.waiting = []
            self.articles += 1
            place.article = place.article or self.articles
        elif name in APART or apart and not whole and name in BLOCK:
            place.apart = True
        elif (said or name == "form") and not whole:
            if name in BLOCK:
                place.named = Named()
                if said != "comments":  # no article overrules those
                    self.waiting.append(place.named)
            elif said == "advert":
                place.left_out = True
        self.stack.append(place)
        self.open[name] += 1


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    return Reader(page).blocks


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?()[]\"'*#$%&|<>").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(found: list[Block]) -> list[int]:
    labels, candidates = [], []  # candidates: (place, share of stop words) of the long blocks outside links
    for i, b in enumerate(found):
        linked, long = b.linked > HIGH_LINKS * len(b.text), len(b.text) >= LONG
        if b.apart or linked and not (b.article and (long or b.place.name in HEADINGS)):
            labels.append(BAD)
        elif not long:
            labels.append(OPEN)
        else:
            share = stop_share(b.text)
            labels.append(GOOD if share >= STOP_SHARE else BAD if linked else OPEN)
            if not linked:
                candidates.append((i, share))
    if candidates and sum(share for _, share in candidates) < FEW_STOP_WORDS * len(candidates):
        for i, _ in candidates:
            if SENTENCE_END.search(found[i].text):
                labels[i] = GOOD
    return labels


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    n = len(found)
    before, after = [0] * n, [0] * n  # (label, distance) of the nearest decided neighbour on each side
    dist_b, dist_a = [0] * n, [0] * n
    for order, label, dist in ((range(n), before, dist_b), (range(n - 1, -1, -1), after, dist_a)):
        last, gone, where = None, 0, None
        for i in order:
            if found[i].article != where:
                where = found[i].article
                last, gone = (GOOD if where else None), 0
            gone += 1
            if labels[i] != OPEN and not (where and labels[i] == BAD):
                last, gone = labels[i], 0
            label[i], dist[i] = last or OPEN, gone
    out = []
    for i, x in enumerate(labels):
        if x == OPEN:
            sides = sorted((d, lab) for d, lab in ((dist_b[i], before[i]), (dist_a[i], after[i])) if lab != OPEN)
            x = sides[0][1] if sides else BAD
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = second_pass(found, first_pass(found))
    return " ".join(b.text for b, x in zip(found, labels) if x == GOOD)


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
