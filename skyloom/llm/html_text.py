"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import col

# Fixed values of HTML: elements without content, those that begin a block, those that close an open paragraph,
# and those whose content is never text of the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
DROPPED = frozenset(
    "aside audio button canvas datalist embed fieldset footer frame frameset head iframe input label map math menu meter nav noembed "
    "noframes noscript object option progress script select style svg template textarea title video".split())
# An open element of the first kind ends where one of the second begins.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "option": {"option", "optgroup"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
BESIDE = PARAGRAPHS | frozenset("article center dd details div dl dt figure main ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class and id names.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|alertdialog|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|dialog|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|pagination|pager|popup|promo|related|replies|respond|share|sharing|sidebar|skyscraper|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
WANTED = re.compile(r"(?:^|[\s_-])(article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
MODIFIERS = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S+", re.I)
# Words that name buttons, and also what texts are about.
SHARED = re.compile(r"(?:^|[\s_-])(share|sharing|social)(?=$|[\s_-])", re.I)
WHOLE = frozenset("p blockquote dl figure li ol pre table td ul".split())  # elements of running text, which such a word does not rule out
PASSAGE = 80  # characters of a passage, rather than of a caption or a call
COMMENTS = re.compile(r"\W*(\d+\W+)?((all|reader|user|your)\W+)?(comments?|discussion|replies|responses|leave a (comment|reply)|join the (conversation|discussion))(\W+\d+)?\W*", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "score", "dropped", "text_length", "link_length", "weight", "scored", "named")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False, weight: float = 0.0):
        self.tag, self.parent, self.dropped, self.weight = tag, parent, dropped, weight
        self.children: list[Node | str] = []
        self.score, self.text_length, self.link_length, self.scored = 0.0, 0, 0, False
        self.named: str | None = None  # class, id and role, where they hold an unwanted word; the tag of a form or dialog


class Tree(HTMLParser):
    """The element tree of a page, with the end tags that HTML lets authors leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {}  # of the open elements of each tag

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._end("p", {"article", "section", "div", "td", "th", "li", "button", "table"} - {tag} if tag == "p" else {"button", "table", "td", "th"})
        for open_tag, starters in ENDED_BY.items():
            if tag in starters:
                self._end(open_tag, HOLDERS[open_tag])
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self._close(len(self.open) - 1)
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        inside = self.depths.get("article") or self.depths.get("main")
        bad = tag in DROPPED or tag == "header" and not inside or any(k == "hidden" or k == "style" and HIDDEN.search(v or "") for k, v in attrs)
        node = Node(tag, self.at, self.at.dropped or bad, 25.0 if tag in ("article", "main") or WANTED.search(names) else 0.0)
        if tag not in ("article", "main") and UNWANTED.search(told := MODIFIERS.sub("", names)):
            node.named = told
        elif tag in ("form", "dialog") or any(k == "aria-modal" and v == "true" for k, v in attrs):
            node.named = tag
        self.at.children.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        if tag == "p":
            self._end("p", {"button", "table", "td", "th"})
        else:
            self._end(tag, {"table"} if tag not in BLOCK else set())

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        pass

    def _end(self, tag: str, walls: set[str]) -> None:
        """Closes the innermost open element of the tag, if no wall stands before it; the work is that of the elements closed."""
        if at := self.depths.get(tag):
            if all(not (d := self.depths.get(w)) or d[-1] <= at[-1] for w in walls):
                self._close(at[-1])

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.open.pop().tag].pop()
        self.at = self.open[-1]


def _tree(html: str) -> Node:
    parser = Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _walk(root: Node):
    """Nodes, parents first, without recursion."""
    front = [root]
    while front:
        node = front.pop()
        yield node
        front.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _drop_named(root: Node) -> None:
    """Drops elements with an unwanted name, but for those that hold the article.

    These hold a main element or the longest article, or are forms, dialogs or of a name that is wanted as well, with most of the page's text
    and few links. A paragraph, list or table of some length and few links is not dropped for a word of ``SHARED`` that isn't the last of its name.
    """
    nodes = _measure(root)
    named = [n for n in nodes if n.named]
    holders = set()
    articles = [n for n in nodes if n.tag in ("article", "main")]
    longest = max(articles, key=lambda n: n.text_length - n.link_length, default=None)
    for node in articles:
        if node.tag == "main" or node is longest:
            while node is not None and node not in holders:
                holders.add(node)
                node = node.parent
    # the last word says what an element is: post-comments are comments
    mixed = {n for n in named if WANTED.search(" ".join(x for x in n.named.split() if not UNWANTED.search(re.split("[_-]", x)[-1])))}
    mixed |= {n for n in named if n.named == n.tag}
    for node in named:
        last = re.split(r"[\s_-]", node.named.strip())[-1]
        passage = (node.tag in WHOLE and not UNWANTED.search(last) and not UNWANTED.search(SHARED.sub(" ", node.named))
                   and node.text_length >= PASSAGE and link_density(node) < 0.25)
        if node not in holders and node not in mixed and not passage:
            node.dropped = True
    _inherit(root)
    if mixed - holders:
        _measure(root)
        for node in mixed - holders:
            node.dropped = node.dropped or 2 * node.text_length <= root.text_length or link_density(node) >= 0.25
        _inherit(root)


def _drop_comments(root: Node) -> None:
    """Drops sections that begin with a heading of reader comments and hold no article or main element."""
    heads = [n for n in _walk(root) if not n.dropped and n.tag in HEADINGS and COMMENTS.fullmatch(_own_text(n))]
    holders = set()
    for node in [n for n in _walk(root) if heads and n.tag in ("article", "main")]:
        while node is not None and node not in holders:
            holders.add(node)
            node = node.parent
    for head in heads:
        above = head.parent
        first = next((c for c in above.children if isinstance(c, Node) or c.strip()), None)
        if first is head and above.tag in ("section", "div") and above not in holders:
            above.dropped = True
    if heads:
        _inherit(root)


def _inherit(root: Node) -> None:
    """What stands below a dropped element is dropped; lengths are to be measured anew."""
    for node in _walk(root):
        node.dropped = node.dropped or node.parent is not None and node.parent.dropped
        node.text_length = node.link_length = 0


def _measure(root: Node) -> list[Node]:
    nodes = [n for n in _walk(root) if not n.dropped]
    for node in reversed(nodes):
        own = sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.text_length += own
        node.link_length = node.text_length if node.tag == "a" else node.link_length
        if node.parent is not None:
            node.parent.text_length += node.text_length
            node.parent.link_length += node.link_length
    return nodes


def link_density(node: Node) -> float:
    return node.link_length / node.text_length if node.text_length else 0.0


def _lines(nodes, lone_text: bool = True) -> list[str]:
    """Blocks of text below some nodes, in page order."""
    lines, line = [], []

    def flush():
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            lines.append(text)
        line.clear()

    front = list(reversed(nodes))
    while front:
        node = front.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif not node.dropped:
            block = node.tag in BLOCK
            if block:
                flush()
                front.append(None)
            front.extend(reversed(node.children))
    flush()
    return lines


def main_text(html: str) -> str:
    """Text of the best container and of those siblings that belong to it, one line per block."""
    root = _tree(html)
    if any(n.named for n in _walk(root)):
        _drop_named(root)
    _drop_comments(root)
    nodes = _measure(root)
    candidates = []
    for node in nodes:
        if node.tag not in PARAGRAPHS and not (node.tag in ("div", "section", "article", "main") and any(isinstance(c, str) and c.strip() for c in node.children)):
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        above, share = node if node.tag in ("div", "section", "article", "main") else node.parent, 1.0
        for level in range(3):
            if above is None:
                break
            if not above.scored:
                above.scored, above.score = True, above.weight
                candidates.append(above)
            above.score += points * share
            above, share = above.parent, 1 / 2 if level == 0 else 1 / 6
    if not candidates:
        return "\n".join(_lines([root]))
    for node in candidates:
        node.score *= 1 - link_density(node)
    best = max(candidates, key=lambda n: n.score)
    while best.parent is not None and best.parent.tag in ("article", "main"):
        best = best.parent
    if best.parent is None:
        return "\n".join(_lines([best]))
    while best.parent.parent is not None and best.parent.text_length == best.text_length:  # wrappers of nothing else
        best = best.parent
    least, chosen, run = max(10.0, best.score * 0.2), [], []
    for n in [*best.parent.children, None]:
        if isinstance(n, str) or n is not None and n is not best and n.tag not in BLOCK - {"br"}:
            run.append(n)
            continue
        # loose text with its inline elements is judged together
        length, links = (sum(x) for x in zip((0, 0), *[(len(r.strip()), 0) if isinstance(r, str) else (r.text_length, r.link_length) for r in run if isinstance(r, str) or not r.dropped]))
        if links < 0.25 * length:
            chosen += run
        run = []
        if n is not None and not n.dropped and (n is best or n.scored and n.score >= least or _belongs(n, best)):
            chosen.append(n)
    return "\n".join(_lines(chosen))


def _belongs(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container is article text by its kind and links; headings of an article element stand inside it."""
    if node.tag in HEADINGS:
        return link_density(node) < 0.25 and best.tag not in ("article", "main")
    if node.tag in PARAGRAPHS and node.text_length <= 80:
        return not node.link_length
    return node.tag in BESIDE and link_density(node) < 0.25


def _own_text(node: Node) -> str:
    """Text of a block without that of paragraphs inside it."""
    out, front = [], list(reversed(node.children))
    while front:
        n = front.pop()
        if isinstance(n, str):
            out.append(n)
        elif not n.dropped and n.tag not in BLOCK - {"br"}:
            front.extend(reversed(n.children))
    return SPACE.sub(" ", "".join(out)).strip()


def html_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row of ``pages``: the key, the columns of ``keep``, text of the article, n_chars (code points).

    Paragraphs give points for their presence, length and commas: all to their parent, half to the next ancestor, a sixth to
    the one above. Points shrink by the share of text in links. The container with most points, its siblings with enough of
    them and other siblings that are not links (text, paragraphs, lists, tables, sections) make the article. Menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and comments are left out by element and by class name, in the article too, unless an element so named holds the
    article: a main element, the longest article, or in a form, a dialog or under a name that is wanted too most of the text. Sections headed
    as comments are left out. Building the tree takes time in proportion to the page. Character references
    are decoded; white space in a block becomes one space; blocks are joined by one \\\\n. A null or empty page, or one
    without text, gives the empty text; equal points: the container that ends the list of none before it, that is the first. Repeated
    rows and null keys are kept row by row. An empty table gives an empty result.
    """
    rows = pages.select(col(key), *[col(c) for c in keep], F.col(html).cast("string").alias("_html"))
    names = [key, *keep]

    def texts(batches):
        for batch in batches:
            out = [main_text(h) if h else "" for h in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_html").schema.fields)
    return rows.mapInArrow(texts, f"{schema}, text string, n_chars long")
