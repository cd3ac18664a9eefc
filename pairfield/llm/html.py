"""Main text of web pages by tree scoring.

A page is read into a tree. Each text block passes points for its length and commas to its parent and, halved, to the
grandparent and further up; a container's points are discounted by the share of its text that is in links. The best
container, or the whole of the article or main that it is in, is kept with all siblings that aren't mostly links.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never main text.
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea input iframe svg canvas object head title menu dialog noembed noframes".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that pass the points of their text to their parents.
LEAVES = frozenset("p pre td blockquote li dd dt figcaption".split())
P_SCOPE = frozenset("table td th button object".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
#: Words of class, id and role that mark what is around an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner billboard sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toolbar header masthead topbar footer footnav bottom copyright legal social share sharing sharebar related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion reactions tags skip search form complementary contentinfo".split()
)
#: Those of them that mark readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Words that mark an article; an element with one of these isn't taken for what is around it.
WITHIN = frozenset("article content main post story entry body text".split())

#: Tags of headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A sibling of the main text with this share of its text in links isn't part of it.
LINKS = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "soft", "comments", "points", "length", "linked", "in_link")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop, self.soft = tag, parent, drop, False
        self.comments = bool(parent) and parent.comments
        self.children: list = []
        self.points = self.length = self.linked = 0.0
        self.in_link = bool(parent) and (tag == "a" or parent.in_link)


def _hidden(attributes: str) -> bool:
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", bare) or re.search(r"aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", attributes, re.I))


def _named_around(attributes: str, marks: frozenset[str] = AROUND) -> bool:
    """Whether a class, id or role names what is around an article: its first or last word does, as in sidebar-left.

    Words such as has or no before it, or enabled after it, tell of something else. An element that is also named as the article, by
    another class, isn't around it.
    """
    around = within = False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            value = entities.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
            for name in value.split():
                words = [w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
                if words and words[0] not in ("has", "with", "no", "is", "without") and words[-1] not in ("open", "closed", "enabled", "disabled", "on", "off"):
                    around |= words[0] in marks or words[-1] in marks
                    within |= len(words) == 1 and words[0] in WITHIN
    return around and not within


def _named_within(attributes: str) -> bool:
    """Whether an element is named as the article: by its id, or by a class of two or more such words, as in entry-content."""
    for m in _ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind in ("class", "id"):
            for name in entities.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]).split():
                words = [w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
                if len(words) >= (1 if kind == "id" else 2) and WITHIN.issuperset(words):
                    return True
    return False


def parse(source: str) -> Node:
    """The tree of a page: open elements end as HTML's rules imply; what is cut off at the end of the page is kept."""
    root = Node("#root", None, False)
    at, node, end = 0, root, len(source)
    opened: Counter[str] = Counter()

    def ended(node: Node, tags: set[str], scope: frozenset[str] | set[str] = frozenset()) -> Node:
        """Ends the innermost open element of these tags, unless one of scope is open inside it; the element then open."""
        if not any(opened[t] for t in tags):
            return node
        up = node
        while up.parent is not None and up.tag not in tags:
            if up.tag in scope:
                return node
            up = up.parent
        while node is not up.parent:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while at < end:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else end
        if stop > at and not node.drop:
            node.children.append(entities.unescape(source[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                node = ended(node, {tag})
            elif tag == "br" and not node.drop:
                node.children.append(" ")
            continue
        if tag in ENDS_P:
            node = ended(node, {"p"}, P_SCOPE)
        if tag in CLOSES:
            node = ended(node, *CLOSES[tag])
        attributes = m[3]
        outside = tag == "header" and not (opened["article"] or opened["main"])
        child = Node(tag, node, node.drop or tag in DROPPED or outside or bool(attributes) and _hidden(attributes))
        named = bool(attributes) and tag not in ("html", "body", "main") and not child.drop
        child.comments = tag != "main" and (child.comments or named and _named_around(attributes, COMMENTS))
        if tag == "main" or not child.comments and (tag == "article" or bool(attributes) and opened["#soft"] and _named_within(attributes)):
            up = node
            while opened["#soft"] and up.parent is not None:
                up.soft, up.comments, up = False, up.comments and tag != "main", up.parent
        elif named and _named_around(attributes):
            child.soft = True
            opened["#soft"] += 1
        node.children.append(child)
        if tag in VOID:
            if tag in ("br", "hr"):
                node.children[-1] = " "
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}[^>]*>?", re.I).search(source, at)
            at = over.end() if over else end
            continue
        opened[tag] += 1
        node = child
    return root


def _blocks(node: Node) -> list[tuple[Node, str]]:
    """Text blocks in page order, with the element that holds each; white space within a block is one space."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []
    holder = [node]

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append((holder[0], text))

    stack: list = [(node, iter(node.children))]
    while stack:
        here, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if here.tag in BLOCK or here is node:
                flush()
                up = here.parent
                while up is not None and up.tag not in BLOCK and up is not node:
                    up = up.parent
                holder[0] = up or node
        elif isinstance(child, str):
            parts.append(child)
        elif not child.drop:
            if child.tag in BLOCK:
                flush()
                holder[0] = child
            stack.append((child, iter(child.children)))
    flush()
    return out


def _measure(root: Node) -> None:
    """Drops what is named as being around an article, and sets each element's length of kept text and of its part in links.

    Readers' comments go whatever else there is. Other named elements go as well, unless no text but headings and links
    is left outside them, which shows that the name is a wrapper's; an element that holds the article was never taken for
    what is around it. How much of the page an element holds doesn't matter.
    """
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node) and not c.drop)
    named = [n for n in order if n.soft and not n.comments]
    for n in order:
        n.drop = n.drop or n.soft or n.comments
    for again in (False, True):
        for n in reversed(order):
            own = sum(len(_SPACE.sub(" ", c)) for c in n.children if isinstance(c, str))
            inner = [c for c in n.children if isinstance(c, Node) and not c.drop]
            n.length = own + sum(c.length for c in inner)
            n.linked = (own if n.in_link else 0) + sum(c.linked for c in inner)
        if again or not named or any(holder.tag not in HEADINGS and _density(holder) < 1 for holder, _ in _blocks(root)):
            break
        for n in named:
            n.drop = False


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def extract(source: str) -> str:
    """The main text of a page; empty if there is none."""
    root = parse(source)
    _measure(root)
    blocks = _blocks(root)
    scored: dict[int, Node] = {}
    for holder, text in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        leaf = holder.tag in LEAVES or holder.tag in HEADINGS
        up = holder.parent if leaf and holder.parent is not None else holder
        level = 0
        while up is not None and level < 6:
            up.points += points / (1 if level == 0 else 2 * level)
            scored[id(up)] = up
            up, level = up.parent, level + 1
    if not scored:
        return ""
    value = {i: n.points * (1 - _density(n)) * (1.5 if n.tag in ("article", "main") else 1.0) for i, n in scored.items()}
    best = max(scored.values(), key=lambda n: value[id(n)])  # the first of equals, which is the earliest
    up = best
    while up is not None:  # the whole of the article or main that it is in
        best, up = up if up.tag in ("article", "main") else best, up.parent
    kept = [best]
    if best.parent is not None and best.parent.tag != "#root":
        kept, following = [], False
        for s in reversed(best.parent.children):
            if not isinstance(s, Node) or s.drop or not s.length:
                continue
            if s is not best:
                if s.tag in HEADINGS:  # a heading goes with what follows it
                    keep = following
                else:
                    keep = _density(s) < LINKS
            following = s is best or keep
            if following:
                kept.append(s)
        kept.reverse()
    return "\n".join(text for n in kept for _, text in _blocks(n))


def texts_of(sources: list) -> tuple[list[str], list[int]]:
    texts = [extract((s or b"").decode("utf-8", "replace")) for s in sources]
    return texts, [len(t) for t in texts]


def main_texts(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keys, text and n_chars (code points) of each page.

    A null or empty page has an empty text. Repeated pages give a row each; other columns are ignored; an empty table
    gives an empty result; of containers with equal points the earliest is kept. Pages are independent of each other and
    their trees take memory in proportion to one page.
    """
    return per_text(pages, "text string, n_chars long", lambda: texts_of, keys, html, 128)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).select(F.col("page_id"), "url", "text", "n_chars")
