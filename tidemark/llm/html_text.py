"""Main text of web pages by tree scoring.

A page becomes a light tree. Elements that never hold an article (menus, headers, footers, sidebars, notices, adverts,
scripts, styles, reader comments) are left out. A form, a dialog or one that only its class or id tells, adverts excepted, stays
if it holds most of the page's text and no article or main has text outside it. Comments without such a name are known by
their structure: three or more siblings of one tag and class, each a short text that begins with a short line and a date,
which together hold less than half of the text. Every block with text of its own passes points for its length and
commas to its ancestors, less with distance; an ancestor's points are discounted by the share of its text inside links, and
count more for article and main. The best container is kept with those siblings that score well too or hold plain text
blocks, and its blocks are joined in page order.

Null or empty html gives an empty text. Broken markup is read as far as it goes: unclosed elements end with their parent.
Time grows with a page's length, however deep its elements are. Repeated rows get a result each; extra columns are not
returned.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import arrow_type, schema_of

# HTML's own names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select article section div main aside nav body html td th".split())

# What holds no article text.
LEFT_OUT = frozenset("script style template head title nav footer aside button select option textarea input iframe object embed svg canvas audio video map menu noembed noframes".split())
#: These as well, unless they hold most of the page's text.
LEFT_OUT_SMALL = frozenset("form dialog noscript".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES_OUT = frozenset("ad ads advert adverts advertisement advertising advertorial adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split())
#: Of these, what is out however much of the page it holds.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored".split())
#: Other words in names such as cookie-bar or site-header; a name with any further word, such as has-sidebar, tells nothing.
NAMES_BESIDE = frozenset("area article articles author bar block blog body bottom box button buttons container content count entry fixed form global icon icons inner item items left link links list main media meta mobile outer page panel post posts primary right secondary section site slot text thread top unit wrap wrapper".split())
#: Of a name's words the last one tells if it is one of these, whatever it is of, as in reader-comments ...
NAMES_LAST = frozenset("ads advert adverts breadcrumbs comment comments footer nav navbar navigation newsletter pagination sidebar".split())
#: ... unless one of these goes before, as in has-sidebar.
NAMES_ABOUT = frozenset("above after before below but has hide hides in is no not of off on over show shows than the to toggle under with without".split())
#: The header of these holds an article's title.
NAMES_TITLED = frozenset("article entry post".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s ]+")
#: Points that pass to the parent, its parent and so on.
SHARES = (1.0, 0.5, 0.25)
#: What an element's own name adds to its points.
WEIGHTS = {"article": 2.0, "main": 1.5}
#: A sibling stays with this share of the best container's points.
SIBLING_SHARE = 0.2
#: So does one with such blocks and few links, unless the best container's own name tells where the text ends.
TEXT_BLOCKS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 dd li td figcaption".split())


#: Comments as a list: its least entries, the most characters of one and of its first line, and how dates look.
ENTRIES, ENTRY_CHARS, ENTRY_HEAD = 3, 1500, 80
_MONTH = r"(?:jan|feb|fév|mar|mär|apr|avr|abr|may|mai|jun|juin|jul|juil|aug|aoû|ago|sep|oct|okt|nov|dec|dez|déc|dic|ene)[a-zûé]*"
DATE = re.compile(rf"\b(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{4}}-\d\d-\d\d|{_MONTH}\.? \d{{1,2}}\b|\d{{1,2}}\.? (?:de )?{_MONTH}\b|\d+ (?:sec|second|min|minute|hour|day|week|month|year)s? ago|vor \d+ \w+|il y a \d+ \w+|hace \d+ \w+|\d{{1,2}}:\d\d)", re.I)


class Node:
    __slots__ = ("children", "name", "named", "out", "parent", "points", "shape")

    def __init__(self, name: str, parent: Node | None, out: bool = False, named: bool = False, shape: str = ""):
        self.name, self.parent, self.out, self.named, self.shape = name, parent, out, named, shape
        self.children: list = []
        self.points = 0.0


def attributes(text: str) -> list[tuple[str, str]]:
    """(name, value) of a tag's attributes, in lower case, read one after the other."""
    return [(name.lower(), value.strip("\"'").lower()) for name, value in ATTRIBUTE.findall(text)] if text else []


def is_out(tag: str, own: list[tuple[str, str]], open_tags: Counter) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag == "header":
        return not open_tags["article"] and not open_tags["main"]
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in own:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value in ROLES_OUT or name in ("class", "id") and not ADVERTS.isdisjoint(value.split()):
            return True
    return False


def is_named_out(tag: str, own: list[tuple[str, str]]) -> bool:
    """Whether a class or an id, as a whole, names what holds no article text."""
    if tag in LEFT_OUT_SMALL:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in own:
        if name in ("class", "id"):
            for token in value.split():
                words = NAME.findall(token)
                parts = set(words)
                if "header" in parts and not NAMES_TITLED.isdisjoint(parts):
                    continue
                if not NAMES_OUT.isdisjoint(parts) and (parts - NAMES_OUT) <= NAMES_BESIDE and ("hidden" not in parts or token == "hidden"):
                    return True
                if words and words[-1] in NAMES_LAST and NAMES_ABOUT.isdisjoint(parts):
                    return True
    return False


def leave_out_named(root: Node) -> None:
    """Leaves out the elements with such names, but those that hold most of the page's text."""
    order = kept_nodes(root)
    if not any(node.named for node in order):
        return
    size = dict.fromkeys(order, 0)
    for at in reversed(order):
        size[at] += sum(len(c.strip()) for c in at.children if isinstance(c, str))
        if at.parent is not None:
            size[at.parent] += size[at]
    inside: dict[Node, bool] = {}
    apart = False
    for at in order:
        inside[at] = at.named or at.parent is not None and inside[at.parent]
        apart |= at.name in ("article", "main") and size[at] > 0 and not inside[at]
    for at in order:
        at.out = at.out or at.named and (apart or 2 * size[at] <= size[root])


def kept_nodes(root: Node) -> list[Node]:
    """The nodes that aren't left out, each after its parent."""
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [c for c in at.children if isinstance(c, Node) and not c.out]
    return order


def leave_out_comments(root: Node) -> bool:
    """Leaves out lists that look like comments; whether there was one."""
    order = kept_nodes(root)
    lists: dict[tuple[Node, str], list[Node]] = {}
    for at in order:
        if at.shape and at.parent is not None:
            lists.setdefault((at.parent, at.shape), []).append(at)
    lists = {k: v for k, v in lists.items() if len(v) >= ENTRIES}
    if not lists:
        return False
    # Of each entry its characters and its first two lines; blocks come in page order and are summed upwards once.
    size = dict.fromkeys(order, 0)
    first: dict[Node, list[tuple[int, str]]] = {node: [] for node in order}
    for i, (owner, text, _) in enumerate(blocks(root)):
        size[owner] += len(text)
        if len(first[owner]) < 2:
            first[owner].append((i, text))
    for at in reversed(order):
        if at.parent is not None:
            size[at.parent] += size[at]
            first[at.parent] = sorted(first[at.parent] + first[at])[:2]
    found = False
    for entries in lists.values():
        like = [x for x in entries if 0 < size[x] <= ENTRY_CHARS and (lines := [t for _, t in first[x]]) and len(lines[0]) <= ENTRY_HEAD and any(DATE.search(t[: 2 * ENTRY_HEAD]) for t in lines)]
        if len(like) >= ENTRIES and 10 * len(like) >= 9 * len(entries) and 2 * sum(size[x] for x in entries) < size[root]:
            for x in entries:
                x.out = found = True
    return found


def tree(page: str) -> Node:
    root = at = Node("#root", None)
    last, n = 0, len(page)
    open_tags: Counter = Counter()

    def close_to(at: Node, up: Node) -> Node:
        """Closes the elements from at up to, but not, `up`."""
        while at is not up:
            open_tags[at.name] -= 1
            at = at.parent
        return up

    while last < n:
        m = TOKEN.search(page, last)
        if m is None:
            at.children.append(page[last:])
            break
        if m.start() > last:
            at.children.append(page[last : m.start()])
        last = m.end()
        if m["cdata"]:
            at.children.append(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in VOID or not open_tags[tag]:
                continue
            up = at
            while up is not None and up.name != tag:
                up = None if tag in INLINE and up.name in SCOPES else up.parent
            if up is not None and up.parent is not None:
                at = close_to(at, up.parent)
            continue
        if tag in CLOSES_P and open_tags["p"]:
            up = at
            while up is not None and up.name != "p" and up.name not in SCOPES:
                up = up.parent
            if up is not None and up.name == "p":
                at = close_to(at, up.parent)
        if tag in SAME_CLOSES and any(open_tags[x] for x in SAME_CLOSES[tag]):
            scope = SCOPES - {"td", "th"}
            up, found = at, None
            while up is not None and up.name not in scope:
                if up.name in SAME_CLOSES[tag]:
                    found = up
                up = up.parent
            at = close_to(at, found.parent) if found is not None else at
        own = attributes(m["attrs"])
        shape = next((f"{tag} {re.sub('[0-9]+', '', value)}" for name, value in own if name == "class" and value), "li" if tag == "li" else "")
        node = Node(tag, at, is_out(tag, own, open_tags), is_named_out(tag, own), shape)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, last)
            node.children.append(page[last : close.start() if close else n])
            last = close.end() if close else n
        elif tag not in VOID and not m["attrs"].endswith("/"):
            at = node
            open_tags[tag] += 1
    return root


def text_of(pieces: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(pieces))).strip()


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters of it inside links) in page order, what is left out excepted."""
    found: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked: list[str] = []

    def flush(owner: Node) -> None:
        if pieces:
            if text := text_of(pieces):
                found.append((owner, text, len(text_of(linked))))
            pieces.clear()
            linked.clear()

    # Without recursion: broken pages can be nested deeply.
    stack: list[tuple] = [(node, node, False, 0)]
    while stack:
        at, owner, link, index = stack.pop()
        if index == 0 and at.name not in INLINE:
            flush(owner)
            owner = at
        while index < len(at.children):
            child = at.children[index]
            index += 1
            if isinstance(child, str):
                pieces.append(child)
                if link:
                    linked.append(child)
            elif child.name == "br":
                pieces.append(" ")
            elif not child.out:
                if child.name not in INLINE:
                    flush(owner)
                stack.append((at, owner, link, index))
                stack.append((child, owner, link or child.name == "a", 0))
                break
        else:
            if at.name not in INLINE:
                flush(owner)
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    leave_out_named(root)
    leave_out_comments(root)
    found = blocks(root)
    if not found:
        return ""
    order = kept_nodes(root)
    chars: dict[Node, list[int]] = {}
    scored: list[Node] = []
    for owner, text, links in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        n = chars.setdefault(owner, [0, 0])
        n[0] += len(text)
        n[1] += links
        level = 0
        holder = owner if owner.name not in ("p", "pre", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "dt", "figcaption") else owner.parent
        up = holder
        while up is not None and level < len(SHARES):
            if not up.points:
                scored.append(up)
            up.points += points * SHARES[level]
            up, level = up.parent, level + 1

    for at in reversed(order):  # sums go up once
        if at in chars and at.parent is not None:
            n = chars.setdefault(at.parent, [0, 0])
            n[0] += chars[at][0]
            n[1] += chars[at][1]

    def value(node: Node) -> float:
        return WEIGHTS.get(node.name, 1.0) * node.points * (1 - chars[node][1] / max(1, chars[node][0]))

    top = max(scored, key=value)
    least = SIBLING_SHARE * value(top)
    while top.parent is not None and top.name not in WEIGHTS and chars[top.parent][0] == chars[top][0]:
        top = top.parent  # a wrapper that holds nothing else
    keep = {top}
    if top.parent is not None and top.name not in ("body", "html"):
        told: set[Node] = set()
        for owner, _, _ in found:
            if owner.name in TEXT_BLOCKS:
                while owner is not None and owner not in told:
                    told.add(owner)
                    owner = owner.parent
        for sibling in top.parent.children:
            if isinstance(sibling, Node) and sibling in chars:
                n, links = chars[sibling]
                if value(sibling) >= least or top.name not in WEIGHTS and sibling in told and links < 0.25 * n:
                    keep.add(sibling)
    kept: set[Node] = set()
    for at in order:  # and what is kept goes down once
        if at in keep or at.parent in kept:
            kept.add(at)
    return "\n".join(text for owner, text, _ in found if owner in kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row."""
    import pyarrow as pa

    schema = T.StructType([df.schema[id_col], df.schema[url_col], *schema_of(df.schema[id_col], "text string, n_chars long").fields[1:]])
    types = [arrow_type(f.dataType) for f in schema.fields[2:]]

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, types[0]), pa.array([len(t) for t in texts], types[1])], names=schema.names)

    return df.select(id_col, url_col, html_col).mapInArrow(run, schema)
