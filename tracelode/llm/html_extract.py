"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Its blocks of text (what lies between two borders of block elements) pass
points for their length and commas to the elements around them: all to the nearest container, half to the next one,
a third share of that further up.  An element's points are discounted by its link density; semantic elements and
telling class names add or subtract.  From the best container the way leads up to the article or main element
around it, or to the outermost element with no more text.  What is found is kept with those siblings, of whatever tag and
class, that score well or are paragraphs of text, and with headings right before them; what is boilerplate inside of them goes.

Scale: one pass over the pages without a shuffle; a page is one row and its tree lives in one call, in time linear in its
length, however deep it is.  Arrow batches hold few pages, and a page of any length is one row of one.

Defined cases: null or empty html and pages without a container of text give an empty text; unclosed and stray tags
are closed and ignored as browsers do in the main; raw elements (scripts and the like) end at their own closing tag, or
with the page; a "<" that starts no tag is text; formulas stay; equal rows get equal results; of other columns than
page_id, url and html none is read, whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# a "<" inside a tag ends the attempt, so that a stray one is text and not the rest of its block
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|</[^a-zA-Z>][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_SPACE = re.compile(r"\s+")

# Elements of HTML.
_RAW = {"script", "style", "textarea", "title", "noscript", "noembed", "noframes", "template", "iframe", "xmp"}
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
#: Elements that the start of a block element ends, if they are open.
_NO_BLOCKS = ("select", "svg")
#: What the start of an item ends, and the elements that it doesn't look beyond.
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = {"ul", "ol", "dl", "table", "menu", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "mrow", "mfrac", "msup", "msub", "msqrt", "mtext", "ms", "semantics", "annotation", "object", "nobr", "slot", "output"}
_NOT_IN_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "input", "select", "svg", "annotation", "header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXTS = {"p", "li", "dd", "dt", "td", "th", "pre", "blockquote", "figcaption", "caption", *_HEADINGS}
#: Words of class names and ids that mark boilerplate wherever they stand, those that do so for containers only (a paragraph or
#: heading may be called so for its looks), and those that mark the article.
_BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|sharing|social|comments?|commentlist|disqus|respond|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|outbrain|taboola|pagination|pager)(?=$|[\s_-])",
    re.I,
)
_BAD_CONTAINERS = re.compile(
    r"(?:^|[\s_-])(?:banner|notice|overlay|share|replies|reply|side|aside|widget|crumbs|foot|header|related|recommend\w*|skip|search|tags?|meta|byline|copyright|legal|disclaimer|discussion|thread|responses?|feedback|talkback|toc|ad-?(?:slot|box|unit|block|wrap\w*))(?=$|[\s_-])",
    re.I,
)
#: A word that says what is beside or in the element, not what it is: its own name goes no further.
_LAYOUT = re.compile(r"^(?:has|with|without|no|is|not|show|hide|layout|template)[_-]", re.I)
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_GOOD_WORDS = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|blog|hentry|prose)(?=$|[\s_-])", re.I)
#: Points of a semantic container, the share of the best score from which a sibling is kept, and the points that do whatever the best score is.
SEMANTIC, SIBLING, ENOUGH = 25.0, 0.2, 25.0
#: Paragraphs beside the main text of so many characters are kept if less than this share of them is in links, shorter ones if they are sentences without links.
LONG, LINKED = 80, 0.25
#: Ancestors of a paragraph's container that still get points.
LEVELS = 8
_SENTENCE = re.compile(r"[.!?:…。！？][\"'”’»)\]]*$")


@dataclass(eq=False)
class Node:
    tag: str
    names: str = ""
    role: str = ""
    hidden: bool = False
    parent: Node | None = None
    inside: bool = False  # of an article or main element
    holds: bool = False  # a main element or a first heading
    kids: list = field(default_factory=list)  # of Node and str
    points: float = 0.0
    chars: int = 0
    linked: int = 0


class Tree:
    """Builds the tree of a page in time linear in its length: an element that isn't open is looked for no further, and one that
    is gets closed when it is found."""

    def __init__(self):
        self.root = self.at = Node("html")
        self.open: dict[str, int] = {}

    def text(self, piece: str) -> None:
        self.at.kids.append(piece)

    def start(self, node: Node, empty: bool) -> None:
        node.parent, node.inside = self.at, self.at.inside or self.at.tag in ("article", "main")
        self.at.kids.append(node)
        if node.tag in ("main", "h1"):
            above = self.at
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        if not empty:
            self.at = node
            self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def close(self, tag: str, until: frozenset[str] | set[str] = frozenset()) -> bool:
        """End an open element of this tag that no element of ``until`` stands in the way of."""
        if not self.open.get(tag):
            return False
        node = self.at
        while node.tag != tag:
            if node.tag in until or node is self.root:
                return False
            node = node.parent
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[tag] -= 1
        self.at = node.parent
        return True


def parse(page: str) -> Node:
    """The tree of a page; raw elements (scripts, styles and the like) are left out and end at their own closing tag only."""
    tree = Tree()
    last, size = 0, len(page)
    while last < size:
        m = _TOKEN.search(page, last)
        if m is None:
            tree.text(page[last:])
            break
        if m.start() > last:
            tree.text(page[last : m.start()])
        last = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if closing:
            if not tree.close(name) and name in ("p", "br"):
                tree.start(Node(name), True)
            continue
        if name in _NOT_IN_P:
            for other in _NO_BLOCKS:
                tree.close(other)
            tree.close("p", _NOT_IN_P - {"p"})
        for same in _ITEMS.get(name, ()):
            tree.close(same, _LISTS)
        if name in _RAW:
            end = _ENDS[name].search(page, last)
            last = end.end() if end else size
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] and not m[3].isspace() else {}
        style = attributes.get("style", "").replace(" ", "").lower()
        hidden = "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(_QUOTED.sub("", m[3])))
        node = Node(name, f"{attributes.get('class', '')} {attributes.get('id', '')}".strip(), attributes.get("role", "").lower(), hidden)
        tree.start(node, name in _VOID or (m[3].rstrip().endswith("/") and name in ("svg", "math", *(t for t in _INLINE if t[0] == "m"))))
    return tree.root


def boilerplate(n: Node) -> bool:
    if n.hidden or n.tag in _BOILERPLATE or n.role in _ROLES:
        # an article's own header holds its title, and a form may stand around a whole page
        return n.hidden or not ((n.tag == "header" and n.inside) or (n.tag == "form" and n.holds and not n.role))
    if not n.names or n.tag in ("article", "main") or not _bad(n):
        return False
    # a bad word that ends a name says what the element is, whatever it belongs to: post-comments, main-nav, articleAd
    if any(_names_bad(n, name) for name in n.names.split()):
        return True
    return not _GOOD_WORDS.search(n.names)


def _names_bad(n: Node, name: str) -> bool:
    if _LAYOUT.match(name):
        return False
    name = _CAPITAL.sub("-", name.split("--")[0].rstrip("_-"))
    last = name.replace("_", "-").rsplit("-", 2)
    return any(_bad_name(n, "-".join(last[-k:])) for k in (1, 2))


def _bad(n: Node) -> bool:
    """Whether a bad word stands in the element's own names, as they are written or with capitals as borders."""
    names = " ".join(x for x in n.names.split() if not _LAYOUT.match(x))
    return _bad_name(n, names) or _bad_name(n, _CAPITAL.sub("-", names))


def _bad_name(n: Node, name: str) -> bool:
    if _BAD_WORDS.search(name):
        return True
    # a paragraph or heading may be called so for its looks, and what holds the page's main element or first heading holds the article
    return n.tag not in _TEXTS and n.tag not in _INLINE and not n.holds and bool(_BAD_CONTAINERS.search(name))


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(nearest block element, text, characters in links) of each block, in page order, without boilerplate below root."""
    out: list[tuple[Node, str, int]] = []
    run: list[tuple[str, bool]] = []

    def flush(owner: Node) -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in run))).strip()
            if text:
                out.append((owner, text, sum(len(t) for t, linked in run if linked)))
            run.clear()

    # iterative, since unclosed tags nest deeply: (node, next kid, owner, linked)
    stack: list[list] = [[root, 0, root, False]]
    while stack:
        frame = stack[-1]
        node, k, owner, linked = frame
        if k == len(node.kids):
            stack.pop()
            if owner is node:
                flush(node)
            continue
        frame[1] += 1
        kid = node.kids[k]
        if isinstance(kid, str):
            run.append((kid, linked))
        elif kid.tag == "br":
            run.append((" ", False))
        elif not boilerplate(kid):
            if kid.tag in _INLINE:
                stack.append([kid, 0, owner, linked or kid.tag == "a"])
            elif kid.tag in _VOID:
                if kid.tag == "hr":
                    flush(owner)
            else:
                flush(owner)
                stack.append([kid, 0, kid, linked])
        elif kid.tag not in _INLINE:
            flush(owner)
    return out


def _weight(n: Node) -> float:
    w = SEMANTIC * 2 if n.tag == "article" else SEMANTIC if n.tag == "main" or n.role in ("main", "article") else 0.0
    if n.names:
        w += SEMANTIC * bool(_GOOD_WORDS.search(n.names)) - SEMANTIC * _bad(n)
    return w


def _whole(best: Node) -> Node:
    """The outermost article around the best container, else the nearest main element, unless half of it is links; else
    the outermost element with no more text than the best."""
    around = best
    found: dict[str, Node] = {}
    while around is not None:
        kind = around.tag if around.tag in ("article", "main") else around.role if around.role in ("article", "main") else ""
        if kind == "article" or kind not in found:
            found[kind] = around
        around = around.parent
    top = found.get("article") or found.get("main")
    if top is not None and 2 * top.linked <= top.chars:
        best = top
    while best.parent is not None and best.parent.chars == best.chars:
        best = best.parent
    return best


def _with_siblings(best: Node, score: dict[int, float], least: float) -> list[Node]:
    """best and what belongs to it among its siblings, in page order."""
    if best.parent is None:
        return [best]
    keep: list[Node] = []
    near = False  # something kept follows with no other text in between
    for s in reversed(best.parent.kids):
        if not isinstance(s, Node) or s.tag in _VOID or s.tag in _INLINE:
            near = near and not (isinstance(s, str) and s.strip())
            continue
        if s is not best and boilerplate(s):
            near = near and s.tag != "nav" and s.role != "navigation"
            continue
        if s is not best and not s.chars:
            continue
        if s is best:
            ok = True
        elif s.tag in _HEADINGS or s.tag in ("header", "hgroup"):
            ok = near and 2 * s.linked < s.chars
        elif s.tag == "p":
            ok = s.linked < LINKED * s.chars if s.chars >= LONG else not s.linked and any(_SENTENCE.search(t) for _, t, _ in blocks(s))
        else:
            ok = score.get(id(s), 0.0) >= least
        near = ok
        if ok:
            keep.append(s)
    return keep[::-1]


def main_text(page: str) -> str:
    root = parse(page)
    found = blocks(root)
    scored: dict[int, Node] = {}
    for owner, text, linked in found:
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3.0)
        if owner.tag in _HEADINGS:
            points = 0.0
        owner.chars += len(text)
        owner.linked += min(linked, len(text))
        # a paragraph's points go to what holds it
        node = owner.parent if owner.parent is not None and owner.tag not in ("div", "section", "article", "main", "td", "html") else owner
        for level in range(LEVELS):
            node.points += points * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3.0 * level))
            scored[id(node)] = node
            node = node.parent
            if node is None:
                break
    order = [root]
    for n in order:
        order += [k for k in n.kids if isinstance(k, Node)]
    for n in reversed(order[1:]):  # kids come behind their parents
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    best, top = None, 0.0
    score = {}
    for k, n in scored.items():
        score[k] = (n.points + _weight(n)) * (1 - n.linked / n.chars if n.chars else 0.0)
        if score[k] > top:
            best, top = n, score[k]
    if best is None:
        return ""
    keep = _with_siblings(_whole(best), score, min(SIBLING * top, ENOUGH))
    return "\n".join(text for n in keep for _, text, _ in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(c: dict) -> dict:
        found = [main_text(x.decode()) for x in c["html"]]
        return {"page_id": c["page_id"], "url": [None if u is None else u.decode() for u in c["url"]], "text": found, "n_chars": list(map(len, found))}

    return map_batches(asked, run, "page_id long, url string, text string, n_chars long")
