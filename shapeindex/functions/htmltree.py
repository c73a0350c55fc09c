"""Per-page helper: HTML text -> toc links and section items, with the stdlib parser only.

Called once per page inside a Spark task (``operators.html`` wraps it in ``mapInArrow``).
The tree builder tolerates unclosed tags: a new ``p`` or a block start closes an open ``p``,
``li``/``dt``/``dd`` close their open siblings, void tags are never opened, and an end tag
without a matching open element is ignored.
"""
from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

from ..config import HtmlRules

VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
                  "source", "track", "wbr"})
CLOSES_P = frozenset({"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
                      "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
                      "section", "table", "ul"})
SIBLING_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPE_STOP = frozenset({"ul", "ol", "dl", "div", "article", "section", "body", "html", "table", "nav"})
P_SCOPE_STOP = frozenset({"table", "button", "html"})


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def has_class(self, part: str | None) -> bool:
        return part is None or part in (self.attrs.get("class") or "")

    def kids(self, tag: str, cls: str | None = None):
        return [c for c in self.children if isinstance(c, Element) and c.tag == tag and c.has_class(cls)]

    def iter(self):
        """Descendants-or-self elements in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(reversed([c for c in e.children if isinstance(c, Element)]))

    def texts(self):
        """All text nodes below, in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                yield e
            elif e.tag not in ("script", "style"):
                stack.extend(reversed(e.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.cur = self.root

    def _close_to(self, tags, stop=SCOPE_STOP):
        e = self.cur
        while e is not self.root and e.tag not in stop:
            if e.tag in tags:
                self.cur = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_to({"p"}, stop=P_SCOPE_STOP)
        if tag in SIBLING_CLOSE:
            self._close_to(SIBLING_CLOSE[tag])
        el = Element(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(el)
        if tag not in VOID:
            self.cur = el

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Element(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        e = self.cur
        while e is not self.root:
            if e.tag == tag:
                self.cur = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        self.cur.children.append(data)


#: Markup whose tokens need no tolerance: tags in lower case with quoted attributes, and text between them. Any other ``<`` is the last group.
_PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&]*")*)>|</([a-z][a-z0-9]*)>|([^<]+)|(<)')
_ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')
#: Elements whose content the parser reads by other rules.
_OWN_RULES = frozenset({"iframe", "math", "noembed", "noframes", "noscript", "plaintext", "script", "style", "svg", "textarea", "title", "xmp"})


def _plain_tokens(html: str) -> list | None:
    """The tokens of plain markup, which the parser would report one by one; None if any token is not plain."""
    tokens = _PLAIN.findall(html)
    if any(t[4] or t[0] in _OWN_RULES for t in tokens) or (tokens and "&" in tokens[-1][3]):
        return None
    return tokens


def parse_html(html: str) -> Element:
    b = _Builder()
    tokens = _plain_tokens(html or "")
    if tokens is None:
        b.feed(html)
        b.close()
        return b.root
    for start, attrs, end, text, _ in tokens:
        if start:
            b.handle_starttag(start, _ATTRIBUTE.findall(attrs) if attrs else ())
        elif end:
            b.handle_endtag(end)
        else:
            b.handle_data(unescape(text) if "&" in text else text)
    return b.root


# --------------------------------------------------------------------------- EXT1

def toc_links(root: Element, rules: HtmlRules) -> list[str | None]:
    """Raw href of every toc link, in document order."""
    out = []
    for scope in root.iter():
        if rules.toc_container is not None:
            if scope.tag != rules.toc_container:
                continue
            anchors = [e for e in scope.iter() if e.tag == "a"]
        else:
            if scope.tag != "ul":
                continue
            anchors = [a for li in scope.kids("li", rules.toc_item_class) for a in li.kids("a")]
        for a in anchors:
            href = next((e.attrs["href"] for e in a.iter() if "href" in e.attrs), None)
            out.append(href)
    return out


# --------------------------------------------------------------------------- EXT4-EXT8

def snippet_text(block: Element, prompts) -> str:
    """EXT8: text nodes under the code block, whole nodes starting with a prompt dropped."""
    return "".join(t for t in block.texts() if not t.startswith(tuple(prompts)))


def _title(section: Element, rules: HtmlRules) -> str:
    """EXT5: direct text of header children plus all text under <code> in them, document order."""
    parts = []
    for h in section.children:
        if not (isinstance(h, Element) and h.tag in rules.header_tags):
            continue
        stack = [(c, True) for c in reversed(h.children)]
        while stack:
            node, direct = stack.pop()
            if isinstance(node, str):
                if direct:
                    parts.append(node)
                continue
            if node.tag == "code":
                parts.extend(node.texts())
            else:
                stack.extend((c, False) for c in reversed(node.children))
    return "".join(parts)


def _section_href(section: Element, rules: HtmlRules) -> str | None:
    """EXT6: first headerlink href under any header below the section."""
    for e in section.iter():
        if e.tag in rules.header_tags:
            for a in e.kids("a", rules.headerlink_class):
                if "href" in a.attrs:
                    return a.attrs["href"]
    return None


def resolve(base: str, href: str) -> str:
    """The link of ``href`` on a page; one that can't be resolved stays as written."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _definition_item(dl: Element, name, parent_url: str, parent_title: str | None, rules: HtmlRules) -> tuple | None:
    blocks = [b for dd in dl.kids("dd") for b in dd.kids(rules.code_tag, rules.code_class)]
    if not blocks:
        return None
    links = (a.attrs["href"] for dt in dl.kids("dt") for a in dt.kids("a", rules.headerlink_class) if "href" in a.attrs)
    href = next(links, None)
    return ("%s: %s" % (parent_title, name), resolve(parent_url, href) if href else parent_url,
            [snippet_text(b, rules.shell_prompts) for b in blocks])


def _walk(first: Element, page_url: str, rules: HtmlRules) -> list[tuple]:
    """Items of a section in crawl order: subsections, then definitions (inner ones first), then its own code. A stack of
    open work instead of recursion: a page may be nested as deeply as it likes."""
    out: list = []
    stack: list[tuple] = [("section", first, page_url, None)]
    while stack:
        kind, e, url, title = stack.pop()
        if kind == "item":
            if e is not None:
                out.append(e)
        elif kind == "section":
            title = _title(e, rules)
            href = _section_href(e, rules)
            url = resolve(page_url, href) if href else page_url
            blocks = e.kids(rules.code_tag, rules.code_class)
            own = (title, url, [snippet_text(b, rules.shell_prompts) for b in blocks]) if blocks else None
            todo = [("section", sub, page_url, None) for sub in e.kids(rules.section_tag, rules.section_class)]
            todo += [("dl", dl, url, title) for dl in e.kids("dl")] if rules.definitions else []
            stack += reversed([*todo, ("item", own, None, None)])
        else:
            name = next((dt.attrs["id"] for dt in e.kids("dt") if "id" in dt.attrs), None)
            todo = [("dl", child, url, name or title) for dd in e.kids("dd") for child in dd.kids("dl")]
            stack += reversed([*todo, ("item", _definition_item(e, name, url, title, rules), None, None)])
    return out


def section_items(root: Element, page_url: str, rules: HtmlRules) -> list[tuple]:
    """EXT4-EXT7: (title, url, raw snippets) per section/definition with code, in crawl order."""
    first = next((e for e in root.iter() if e.tag == rules.section_tag and e.has_class(rules.section_class)), None)
    return [] if first is None else _walk(first, page_url, rules)

# --------------------------------------------------------------------------- the tree as rows

def rows(root: Element) -> dict[str, list]:
    """The tree in preorder, one entry per element and text node: ``pre`` numbers them, the subtree of a node is
    ``[pre, pre + size - 1]``. Text nodes have the tag ``#text``; text inside scripts and styles has the tag ``#hidden``."""
    out: dict[str, list] = {c: [] for c in ("pre", "size", "parent", "depth", "tag", "parent_tag", "cls", "id", "href", "text")}
    stack: list[tuple] = [(root, -1, 0, False)]
    n = 0
    while stack:
        node, parent, depth, hidden = stack.pop()
        text = isinstance(node, str)
        out["pre"].append(n)
        out["size"].append(1)
        out["parent"].append(parent)
        out["depth"].append(depth)
        out["tag"].append(("#hidden" if hidden else "#text") if text else node.tag)
        out["parent_tag"].append(out["tag"][parent] if parent >= 0 else None)
        out["cls"].append(None if text else node.attrs.get("class"))
        out["id"].append(None if text else node.attrs.get("id"))
        out["href"].append(None if text else node.attrs.get("href"))
        out["text"].append(node if text else None)
        if not text:
            below = hidden or node.tag in ("script", "style")
            stack += [(c, n, depth + 1, below) for c in reversed(node.children)]
        n += 1
    for k in range(n - 1, 0, -1):
        out["size"][out["parent"][k]] += out["size"][k]
    return out


def markup_rows(html: str | None) -> dict[str, list]:
    """``rows(parse_html(html))``. The rows of plain markup are made as its tokens come, for elements open in document order, which is
    preorder."""
    tokens = _plain_tokens(html or "")
    if tokens is None:
        b = _Builder()
        b.feed(html)
        b.close()
        return rows(b.root)
    parent, depth, tag, above, cls, ids, href, texts = [-1], [0], ["#root"], [None], [None], [None], [None], [None]

    def closed(e, tags, stop):
        at = e
        while at and tag[at] not in stop:
            if tag[at] in tags:
                return parent[at]
            at = parent[at]
        return e

    cur, n, p_seen = 0, 1, False
    for start, attrs, end, text, _ in tokens:
        if end:
            e = cur
            while e:
                if tag[e] == end:
                    cur = parent[e]
                    break
                e = parent[e]
            continue
        if start:
            if p_seen and start in CLOSES_P:
                cur = closed(cur, ("p",), P_SCOPE_STOP)
            if start in SIBLING_CLOSE:
                cur = closed(cur, SIBLING_CLOSE[start], SCOPE_STOP)
            p_seen = p_seen or start == "p"
        parent.append(cur)
        depth.append(depth[cur] + 1)
        above.append(tag[cur])
        if start:
            tag.append(start)
            get = dict(_ATTRIBUTE.findall(attrs)).get if attrs else {}.get
            cls.append(get("class"))
            ids.append(get("id"))
            href.append(get("href"))
            texts.append(None)
            if start not in VOID:
                cur = n
        else:
            tag.append("#text")
            cls.append(None)
            ids.append(None)
            href.append(None)
            texts.append(unescape(text) if "&" in text else text)
        n += 1
    size = [1] * n
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    return {"pre": list(range(n)), "size": size, "parent": parent, "depth": depth, "tag": tag, "parent_tag": above, "cls": cls, "id": ids, "href": href, "text": texts}
