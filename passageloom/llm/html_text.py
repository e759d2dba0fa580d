"""Main text of web pages by scoring the element tree.

A page is read into a tree of elements in one pass. Each paragraph, a run of
text between block boundaries, earns points for its length and its commas,
discounted by the share of its text that is links; it passes them to its
ancestors, less to the farther ones. The container with the most points, after
a discount for its own link density, is the article; with it are kept headings
and blocks of few links next to it, also those next to its containers up to the
enclosing article or main. Menus, page headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments take no part. They are told by element,
role and name, and by structure: siblings of one kind that each have an author or a
date of their own are comments; a form goes unless the article stands in it; a
heading goes with all that stood under it. Links within the page are no links here, so
a table of contents in an article stays.

Rows: a null or empty page, or one without text, gives an empty text. Broken
markup is read as it comes: unclosed elements end with their parent. Very long
and very deep pages take time in proportion to their length. Repeated rows give
the same text; rows without an id or url are rows like others.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quoted values may hold ">".
REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|rel|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Where a name of a class or id is cut into words.
JOINT = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and those that hold no article text.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
#: Elements with markup of their own or a stand-in inside; unclosed ones end with
#: their parent, and drawings and formulas with the next block too.
DRAWN = frozenset("svg math".split())
EMBEDDED = DRAWN | frozenset("object canvas audio video template".split())
DROPPED = RAW | EMBEDDED | frozenset("nav aside footer button select option datalist dialog menu head".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of a class or id that tell an element beside the article, and one that holds it.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner banners bio breadcrumb breadcrumbs comment comments commentlist"
    " copyright discussion disqus feedback respond responses replies reviews consent cookie cookies gdpr notice notices alert alerts footer footnav header"
    " masthead menu menus nav navbar navigation newsletter pager pagination popup modal overlay promo promos promoted promotion recommended related share"
    " sharing sidebar sidebars sidenav skip social sponsor sponsored subscribe subscription signup login tagcloud taglist tags toolbar widget widgets".split()
)
#: What a word may begin with to be one of them, as in cookiebar or adbox.
BEGINS = re.compile(r"advert|adbox|adslot|adunit|adspace|breadcrumb|comment|cookie|copyright|disqus|footer|newsletter|sharebar|sharebutton|sharedaddy|sidebar|sponsor|subscri")
#: Words of a class that tell a column beside another; marks of who wrote something, and
#: of when, as a class and as a short text of its own.
SIDE = frozenset("right left rail secondary tertiary side sidecol sidecolumn".split())
WHO = frozenset("author avatar byline commenter nick nickname reviewer user username".split())
WHEN = frozenset("date datetime posted published time timestamp".split())
SAYS = re.compile(r"(?:.{0,40}\b\d+ (?:second|minute|hour|day|week|month|year)s? ago|\S[^.!?]{0,40} (?:says|said|wrote|writes|schrieb|sagt|dit|escribió|dice)\W{0,3}(?:\d[^!?]{0,40})?)", re.I)
DATE = re.compile(r".{0,40}\b(?:(?:19|20)\d\d-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./](?:19|20)?\d\d|\d{1,2}\.? [^\W\d_]{3,9} (?:19|20)\d\d|[^\W\d_]{3,9} \d{1,2}, (?:19|20)\d\d)\b.{0,20}")
#: Elements that may be a comment; those that make a form one around an article.
REPEATED = frozenset("article blockquote dd div li section".split())
WHOLE = frozenset("article main".split())
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
INNER = re.compile(r"""(?:^|\s)href\s*=\s*["']?\s*#""", re.I)
HOLDS = frozenset("article articles body content entry hentry main page post story text".split())
#: Those that tell one whose header is an article's own.
POST = frozenset("article entry hentry post story".split())
#: Words of BESIDE that say nothing in a name that also tells a holder; words that
#: make a name tell what an element has, or that it goes around several.
FAINT = frozenset("widget widgets header masthead skip".split())
AROUND = frozenset("and has layout no outer with without wrap wrapper".split())
#: Names that make even an article element no part of the article.
REMARKS = frozenset("comment comments related recommended promoted sponsored".split())
#: A start tag of the key ends open elements of the value, up to a boundary.
ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}
BOUNDARY = frozenset("ul ol dl table menu body html div section article".split())
#: Points of an article or main element; how many ancestors get points.
FAVOURED, LEVELS = 25.0, 6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu".split())
#: Share of a block's text from which links make it no part of the article.
LINKED = 0.25


def named_words(attributes: str) -> list[list[str]]:
    """The words of each name in the classes and the id."""
    names = " ".join(v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id"))
    return [[w.lower() for w in JOINT.split(name) if w] for name in names.split()]


def beside_names(names: list[list[str]]) -> bool:
    """Whether names tell an element beside the article. A name that is one such
    word does; one that has such a word does too, whatever else it tells
    (article-comments), unless another name tells a holder."""
    told = False
    for words in names:
        found = BESIDE.intersection(words) or {w for w in words if BEGINS.match(w)}
        if not found or AROUND.intersection(words) or found <= FAINT and HOLDS.intersection(words):
            continue
        if len(words) == 1 and not found <= FAINT:
            return True
        told = True
    return told and not any(words[-1:] and words[-1] in HOLDS - {"page", "text"} and not BESIDE.intersection(words) for words in names)


class Page:
    """Elements in the order of their start tags, and the paragraphs. Each step
    costs what is read or closed, never the depth: where[name] has the depths of
    the open elements of a name, blocks those of open blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last = ["#"], [-1], [0]
        self.dropped, self.points, self.size, self.linked, self.post = [False], [0.0], [0], [0], [False]
        self.kind, self.signed, self.dated, self.side = [""], [0], [0], [False]
        self.paragraphs: list[tuple[int, str, int]] = []
        self.open, self.held, self.linked_now, self.own = [0], [], 0, 0
        self.inner = False  # the open link leads to a place in the page
        self.where: dict[str, list[int]] = {}
        self.blocks = [0]
        self.read(source)
        while len(self.open) > 1:
            self.close()
        self.flush()
        self.last[0] = len(self.tag) - 1
        self.score()

    def flush(self) -> None:
        """End the paragraph that is being read."""
        text, links = " ".join(html.unescape("".join(self.held)).split()), self.linked_now
        self.held, self.linked_now = [], 0
        if text:
            self.paragraphs.append((self.open[self.blocks[-1]], text, min(links, len(text))))

    def sums(self, each: list[int]) -> list[int]:
        """What the nodes and all below them hold."""
        for k in range(len(self.tag) - 1, 0, -1):
            each[self.parent[k]] += each[k]
        return each

    def score(self) -> None:
        """Drop forms, comments and headings of nothing; give points."""
        for at, text, _ in self.paragraphs:
            if len(text) <= 80:
                self.signed[at] += SAYS.fullmatch(text) is not None
                self.dated[at] += DATE.fullmatch(text) is not None
        self.sums(self.signed)
        self.sums(self.dated)
        self.drop_forms()
        self.add_up()
        if self.drop_comments() | self.drop_headings():
            self.add_up()
        self.list = [0] * len(self.tag)  # the nearest list that a node is or stands in
        for k in range(1, len(self.tag)):
            self.list[k] = k if self.tag[k] in LISTS else self.list[self.parent[k]]

    def drop(self, k: int) -> None:
        self.dropped[k : self.last[k] + 1] = [True] * (self.last[k] + 1 - k)

    def add_up(self) -> None:
        """Points and sizes of what isn't dropped."""
        n = len(self.tag)
        self.paragraphs = [x for x in self.paragraphs if not self.dropped[x[0]]]
        self.points = [FAVOURED if t in WHOLE else 0.0 for t in self.tag]
        self.size, self.linked = [0] * n, [0] * n
        for at, text, links in self.paragraphs:
            self.size[at] += len(text)
            self.linked[at] += links
            self.gain(at, text, links)
        self.sums(self.size)
        self.sums(self.linked)

    def drop_forms(self) -> None:
        """A form stays if an article or main element stands in it; if it has a first
        heading and the page has no such thing outside; or if no heading or paragraph
        stands outside. Every other form goes, whatever its size."""
        forms = [k for k, t in enumerate(self.tag) if t in ("form", "fieldset") and not self.dropped[k]]
        if not forms:
            return
        n, texts = len(self.tag), {at for at, _, _ in self.paragraphs}
        upto: dict[str, list[int]] = {}
        for what, has in (("whole", lambda k: self.tag[k] in WHOLE), ("top", lambda k: self.tag[k] in WHOLE or self.tag[k] == "h1"), ("any", lambda k: self.tag[k] in WHOLE or self.tag[k] in HEADINGS or self.tag[k] == "p" and k in texts)):
            count = upto[what] = [0] * (n + 1)
            for k in range(n):
                count[k + 1] = count[k] + (has(k) and not self.dropped[k])
        for k in forms:
            if self.dropped[k]:
                continue
            inside = {w: c[self.last[k] + 1] - c[k] for w, c in upto.items()}
            outside = {w: c[n] - inside[w] for w, c in upto.items()}
            if not (inside["whole"] or inside["top"] and not outside["top"] or not outside["any"]):
                self.drop(k)

    def value(self, k: int) -> float:
        return self.points[k] * (1 - self.linked[k] / max(1, self.size[k]))

    def best(self, among: Callable[[int], bool] = lambda k: True) -> int:
        return max((k for k in range(len(self.tag)) if among(k)), key=lambda k: (self.value(k), -k))

    def drop_comments(self) -> bool:
        """Siblings of one kind of which each has an author, or a date over some text
        where nothing follows in the article, are comments, unless nothing of the page
        is left without them."""
        held = [0] * len(self.tag)  # paragraphs
        for at, _, _ in self.paragraphs:
            held[at] += 1
        self.sums(held)
        ends, last = [0] * len(self.tag), max((at for at, _, _ in self.paragraphs), default=0)  # of the text around each
        for k in range(1, len(self.tag)):
            ends[k] = self.last[k] if self.tag[k] in WHOLE else ends[self.parent[k]] or last
        groups: dict[tuple[int, str, str], list[int]] = {}
        for k in range(1, len(self.tag)):
            told = self.signed[k] or self.dated[k] and held[k] > 1
            if self.tag[k] in REPEATED and told and self.size[k] and not self.dropped[k]:
                groups.setdefault((self.parent[k], self.tag[k], self.kind[k]), []).append(k)
        articles = sum(t == "article" and size > 0 and not gone for t, size, gone in zip(self.tag, self.size, self.dropped))
        # articles are comments beside one of another kind only
        groups = {x: ks for x, ks in groups.items() if x[1] != "article" or articles > len(ks)}
        texts = sorted(at for at, _, _ in self.paragraphs)
        follows = lambda k: bisect_right(texts, self.last[k]) < bisect_right(texts, ends[k] if self.last[k] <= ends[k] else last)
        groups = {x: ks for x, ks in groups.items() if all(self.signed[k] for k in ks) or not follows(ks[-1])}
        found = sorted(k for (up, _, _), ks in groups.items() if len(ks) > 1 for k in ks)
        if not found:
            return False
        inside, stop = [False] * len(self.tag), -1
        for k in found:
            if k > stop:
                stop = self.last[k]
                inside[k : stop + 1] = [True] * (stop + 1 - k)
        left = sum(len(t) - links for at, t, links in self.paragraphs if not inside[at])
        if not left or self.value(self.best(lambda k: not inside[k] and not any(k <= f <= self.last[k] for f in found[:1]) or self.tag[k] in WHOLE)) <= 0:
            return False
        for k in found:
            self.drop(k)
        return True

    def drop_headings(self) -> bool:
        """Headings below the first level after which, up to the next, everything has
        been dropped."""
        children: dict[int, list[int]] = {}
        for k in range(1, len(self.tag)):
            children.setdefault(self.parent[k], []).append(k)
        kept = [False] * len(self.tag)
        for at, _, _ in self.paragraphs:
            kept[at] = kept[at] or not self.dropped[at]
        for k in range(len(self.tag) - 1, 0, -1):
            kept[self.parent[k]] = kept[self.parent[k]] or kept[k]
        gone = []
        own = {at for at, _, _ in self.paragraphs}
        for up, ks in children.items():
            after, text, below = False, False, ""  # of what follows, backwards
            for k in reversed(ks):
                if self.tag[k] in HEADINGS and not self.dropped[k]:
                    if self.tag[k] != "h1" and after and not text and not below > self.tag[k] and not (up in own and self.tag[up] not in BLOCKS):
                        gone.append(k)
                    else:
                        after, text, below = False, False, self.tag[k]
                elif self.dropped[k] and self.tag[k] in BLOCKS:
                    after = True
                elif kept[k] or self.holds_dropped(k, children):
                    text, after = text or kept[k], True
        for k in gone:
            self.drop(k)
        return bool(gone)

    def holds_dropped(self, k: int, children: dict[int, list[int]]) -> bool:
        return any(self.dropped[c] and self.tag[c] in BLOCKS for c in children.get(k, ()))

    def gain(self, at: int, text: str, links: int) -> None:
        gain = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
        node, level = at, 0
        if self.tag[at] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "td", "pre"):
            node = self.parent[at]
        while node > 0 and level < LEVELS:
            self.points[node] += gain / (1 if not level else 2 * level)
            node, level = self.parent[node], level + 1

    def depth(self, names: frozenset[str] | tuple[str, ...]) -> int:
        """The depth of the innermost open element of the names, 0 if none is."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def close(self) -> None:
        k = self.open.pop()
        self.last[k] = len(self.tag) - 1
        self.where[self.tag[k]].pop()
        self.own -= self.post[k] or self.tag[k] in ("article", "main")
        if self.tag[k] in BLOCKS:
            self.blocks.pop()

    def text(self, part: str) -> None:
        if part and not self.dropped[self.open[-1]]:
            self.held.append(part)
            if self.where.get("a") and not self.inner:
                self.linked_now += len(part.strip())

    def starts(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.undraw()
            self.flush()
            self.ends("p")
        if name in ENDS and (found := self.depth(ENDS[name])) > self.depth(BOUNDARY):
            self.ends(self.tag[self.open[found]])
        if name == "br":
            self.text(" ")
        if name in VOID:
            return
        up, names = self.open[-1], named_words(attributes) if attributes and name in BLOCKS else []
        if name == "a":
            self.inner = bool(INNER.search(attributes))
        self.tag.append(name)
        self.parent.append(up)
        self.last.append(0)
        self.dropped.append(self.dropped[up] or self.beside(name, attributes, names))
        self.post.append(any(POST.intersection(words) for words in names))
        self.points.append(FAVOURED if name in ("article", "main") else 0.0)
        self.size.append(0)
        self.linked.append(0)
        given = ATTRIBUTE.findall(attributes) if attributes else ()
        self.kind.append(next((v.strip("\"'").split()[0] for a, v in given if a.lower() == "class" and v.strip("\"' ")), ""))
        self.side.append(bool(names) and any(SIDE.intersection(w) for w in names))
        marks = [w for a, v in given if a.lower() in ("class", "rel", "itemprop") for w in JOINT.split(v.strip("\"'").replace(" ", "-").lower())]
        self.signed.append(int(not WHO.isdisjoint(marks)))
        self.dated.append(int(name == "time" or not WHEN.isdisjoint(marks)))
        self.where.setdefault(name, []).append(len(self.open))
        if name in BLOCKS:
            self.blocks.append(len(self.open))
        self.own += self.post[-1] or name in ("article", "main")
        self.open.append(len(self.tag) - 1)

    def undraw(self) -> None:
        """End an unclosed drawing or formula, unless it holds text of the page."""
        if (found := self.depth(DRAWN)) > self.depth(("foreignobject", "annotation-xml")):
            while len(self.open) > found:
                self.close()

    def beside(self, name: str, attributes: str, names: list[list[str]]) -> bool:
        """Whether an element stands beside the article."""
        if name in DROPPED or name == "label" and self.where.get("form") and not self.where.get("p"):
            return True
        if name == "header":  # a page's header; an article's own holds its heading
            return not self.own
        if not attributes or name in ("html", "body", "main"):
            return False
        if name not in BLOCKS:  # inline markup that isn't shown
            return any(a.lower() == "hidden" or a.lower() == "style" and HIDDEN.search(v) for a, v in ATTRIBUTE.findall(attributes))
        if name == "article":
            return beside_names([words for words in names if REMARKS.intersection(words)]) and beside_names(names)
        for key, value in ATTRIBUTE.findall(attributes):
            key, words = key.lower(), frozenset(value.strip("\"'").lower().split())
            if key == "hidden" or key == "aria-hidden" and "true" in words or key == "style" and HIDDEN.search(value) or key == "role" and words & (ROLES - {"form"} if name == "form" else ROLES):
                return True
        return beside_names(names)

    def ends(self, name: str) -> None:
        depth = self.depth((name,))
        if not depth or (name == "p" or name not in BLOCKS and name not in EMBEDDED) and self.blocks[-1] > depth:
            return  # not open, or markup that crosses a block; it ends with the block
        if name in BLOCKS:
            self.flush()
        while len(self.open) > depth:
            self.close()

    def read(self, source: str) -> None:
        """Go through the tags once. What a search to the end didn't find isn't
        looked for again: a tag whose quotes never close ends, as do all after
        it, with the next ">"."""
        at, plain, low, gone = 0, False, None, {}
        found: dict[str, int] = {}

        def after(what: str, place: int) -> int:
            """Where what stands next, -1 if nowhere; linear over all calls."""
            if found.get(what, place - 1) < place and what not in gone:
                found[what] = low.find(what, place)
                if found[what] < 0:
                    gone[what] = True
            return -1 if what in gone else found[what]

        low = source.lower() if len(source.lower()) == len(source) else "".join(c.lower() if c.isascii() else c for c in source)
        while m := MARK.search(source, at):
            here, kind = m.start(), m[0]
            if kind in ("<!--", "<![CDATA["):
                end = after("-->" if kind == "<!--" else "]]>", m.end())
                if end < 0 and kind == "<!--":
                    self.text(source[at:here])
                    return
                stop = end + 3 if end >= 0 else after(">", here) + 1
            elif kind in ("<!", "<?"):
                stop = after(">", here) + 1
            else:
                name = NAME.match(source, here)
                rest = None if plain else REST.match(source, name.end())
                plain = rest is None
                stop = after(">", name.end()) + 1 if plain else rest.end()
            self.text(source[at:here])
            if not stop:
                return  # the page breaks off in a tag
            at = stop
            if kind[-1] in "-[!?":
                continue
            tag, attributes = name[2].lower(), source[name.end() : stop - 1]
            if name[1]:
                self.ends(tag)
            elif tag in RAW:
                end = after(f"</{tag}", at)
                if attributes.endswith("/") and (end < 0 or 0 <= after(f"<{tag}", at) < end):
                    continue  # empty: no end tag is its own
                close = after(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(source)
                self.text(" ")
            elif tag in EMBEDDED - DRAWN and after(f"</{tag}", at) < 0:
                self.text(" ")  # never closed: it holds nothing
            elif not (attributes.endswith("/") and (tag in EMBEDDED or self.depth(DRAWN) and tag not in BLOCKS)):
                if tag in EMBEDDED - DRAWN:
                    self.text(" ")
                self.starts(tag, attributes)
        self.text(source[at:])

    def main(self) -> list[str]:
        """The blocks of the article, in page order."""
        if not self.paragraphs:
            return []
        value, top = self.value, self.best()
        if value(top) <= 0:
            return [] if all(links for _, _, links in self.paragraphs) else [t for _, t, links in self.paragraphs if links < len(t) / 2]
        kept, bare = self.around(top, value)
        starts = [a for a, _ in kept]

        def inside(at: int) -> bool:
            k = bisect_right(starts, at) - 1
            return k >= 0 and at <= kept[k][1]

        beside = self.columns(top)
        firsts = [a for a, _ in beside]

        def column(at: int) -> bool:
            k = bisect_right(firsts, at) - 1
            return k >= 0 and at <= beside[k][1]

        return [t for at, t, links in self.paragraphs if (inside(at) or at in bare and links < LINKED * len(t)) and not self.menu(at) and not column(at)]

    def columns(self, top: int) -> list[tuple[int, int]]:
        """Columns beside top or what it stands in, by their names."""
        found, node = [], top
        over = {top}
        while node > 0:
            node = self.parent[node]
            over.add(node)
        for k in range(1, len(self.tag)):
            if self.side[k] and self.parent[k] in over and k not in over:
                found.append((k, self.last[k]))
        return found

    def around(self, top: int, value: Callable[[int], float]) -> tuple[list[tuple[int, int]], set[int]]:
        """The elements of the article in page order, each with its last one: the
        article or main around top with what stands next to it; without one, top
        and what stands next to it and to its containers, while nothing beside
        the article is met; and those containers, for text of their own."""
        children: dict[int, list[int]] = {}
        for k in range(1, len(self.tag)):
            if self.size[k] or self.dropped[k]:
                children.setdefault(self.parent[k], []).append(k)
        over, node = [], top
        while node > 0:
            over.append(node)
            node = self.parent[node]
        goal = next((k for tag in ("article", "main") for k in over if self.tag[k] == tag), 0)
        node, bare, bar = goal or top, set(), max(10.0, 0.2 * value(top))
        kept = [(node, self.last[node])]
        while node > 0:
            up = self.parent[node]
            near = [k for k in children.get(up, ()) if k != node and not (self.tag[node] == "article" and self.tag[k] == "article" and value(k) < bar)]
            for k in near:
                if not self.dropped[k] and (self.tag[k] in HEADINGS or self.linked[k] < LINKED * self.size[k] or value(k) >= bar):
                    kept.append((k, self.last[k]))
            if goal or up <= 0 or self.tag[up] in ("html", "body") or any(self.dropped[k] and self.tag[k] in BLOCKS - {"form", "fieldset"} for k in near):
                break
            node = up
            bare.add(up)
        return sorted(kept), bare

    def menu(self, at: int) -> bool:
        """Whether a paragraph stands in a list of links."""
        k = self.list[at]
        return k > 0 and self.linked[k] >= 0.9 * self.size[k]


def main_text(source: str | None) -> str:
    return "\n".join(Page(source).main()) if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the main text of each page; an out_col of pages' own
    is replaced."""
    schema = T.StructType([f for f in pages.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])
    place = pages.columns.index(html_col)
    kept = [k for k, c in enumerate(pages.columns) if c != out_col]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(texts, pa.string())], names=schema.names)

    return pages.mapInArrow(extract, schema)


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
