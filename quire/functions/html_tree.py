"""A tolerant HTML tree on the standard library's tokenizer, and what is made from it: Markdown and safe HTML.

Grammar for Markdown: ATX headings, ``---`` rules, ``-`` bullets, fenced code, ``*`` emphasis, ``**`` strong, ``~~`` strike, pipe
tables, ``[x]`` task items.  Script, style and head content is dropped.

Elements nest up to ``MAX_DEPTH``; what lies deeper becomes content of the last element that was opened, as browsers do it, so no text
is lost and no input can exhaust the stack.
"""

from __future__ import annotations

import re
from collections import Counter
from html import escape, unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style template noscript title".split())
#: Open elements that a start tag closes, up to the elements that stop the search.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
WS = re.compile("[ \t\n\r\f\v]+")
MAX_DEPTH = 200

# Tags and attributes that safe HTML may have.
ALLOWED_TAGS = frozenset("a article blockquote br code del em figcaption figure h1 h2 h3 h4 h5 h6 hr img li main mark nav ol p pre section strong sub sup table tbody td th thead tr ul".split())
ALLOWED_ATTRIBUTES = {"a": ("href", "title", "rel"), "img": ("src", "alt", "title", "width", "height"), "code": ("class",), "ol": ("start",), "th": ("scope",), "td": ("colspan", "rowspan")}


class Node:
    __slots__ = ("tag", "attrs", "children", "has_block")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        #: A block element lies somewhere below.
        self.has_block = False

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def named(self, *tags: str) -> list["Node"]:
        return [c for c in self.children if not isinstance(c, str) and c.tag in tags]

    def walk(self):
        """This node and all below it, parents first."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.flat = Counter()  # elements too deep to be opened, by tag

    def _close_to(self, i: int) -> None:
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in stops:
                    break
                if self.open[i].tag in closed:
                    self._close_to(i)
                    if tag != "tr":
                        break
        if tag in BLOCKS and tag not in ("td", "th", "li"):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "p":
                    self._close_to(i)
                    break
                if self.open[i].tag in BLOCKS:
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag in BLOCKS:
            for parent in reversed(self.open):
                if parent.has_block:
                    break
                parent.has_block = True
        if tag not in VOID:
            if len(self.open) <= MAX_DEPTH:
                self.open.append(node)
            else:
                self.flat[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in VOID:
            return
        if self.flat[tag]:
            self.flat[tag] -= 1
        elif self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close_to(i)
                return
            if tag not in BLOCKS and self.open[i].tag in BLOCKS:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _closed(html: str) -> str:
    """``html`` without a comment that nothing closes: it reaches to the end, as the standard has it; found here, it is searched for once."""
    last = html.rfind("-->")
    open_comment = html.find("<!--", last + 3 if last >= 0 else 0)
    return html if open_comment < 0 else html[:open_comment]


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(_closed(html))
    b.close()
    return b.root


class _Attributes(HTMLParser):
    def __init__(self, name: str) -> None:
        super().__init__(convert_charrefs=True)
        self.name, self.found = name, []

    def handle_starttag(self, tag, attrs):
        value = next((v for k, v in attrs if k == self.name), None)
        if value is not None:
            self.found.append(value)


def attribute_values(html: str | None, name: str) -> list[str]:
    """Values of an attribute of start tags, in order, however they are quoted; comments and scripts have none."""
    p = _Attributes(name)
    p.feed(_closed(html or ""))
    p.close()
    return p.found


# -- Markdown ---------------------------------------------------------------------------------------------------


def to_markdown(html: str | None) -> str:
    if not html:
        return ""
    top = _Place([])
    _blocks(parse(html), top)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(top.lines)).strip("\n")


def _escape(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>])", r"\\\1", text)


def _inline(node: Node) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(_escape(WS.sub(" ", c)))
        elif c.tag in HIDDEN:
            continue
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "img":
            title = f' "{c.attrs["title"]}"' if c.attrs.get("title") else ""
            if c.attrs.get("src"):
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src'].replace(' ', '%20')}{title})")
        elif c.tag in ("code", "kbd", "samp", "tt"):
            t = c.text()
            out.append(f"`` {t} ``" if "`" in t else f"`{t}`")
        elif c.tag == "input" and c.attrs.get("type") == "checkbox":
            out.append("[x] " if "checked" in c.attrs else "[ ] ")
        elif c.tag in ("em", "i", "strong", "b", "del", "s", "strike"):
            mark = {"em": "*", "i": "*", "strong": "**", "b": "**"}.get(c.tag, "~~")
            t = _inline(c)
            core = t.strip()
            if core:
                lead, tail = t[: len(t) - len(t.lstrip())], t[len(t.rstrip()) :]
                out.append(f"{lead and ' '}{mark}{core}{mark}{tail and ' '}")
            elif t:
                out.append(" ")
        elif c.tag == "a" and c.attrs.get("href"):
            title = f' "{c.attrs["title"]}"' if c.attrs.get("title") else ""
            out.append(f"[{_inline(c).strip()}]({c.attrs['href'].replace(' ', '%20')}{title})")
        else:
            out.append(_inline(c))
    return "".join(out)


def _tidy(text: str) -> str:
    return "\n".join(re.sub(" +", " ", x).strip() for x in text.split("\n")).strip()


class _Place:
    """Where blocks go: the document, a list item or a quotation.  Lines are written once, with the whole prefix of their place."""

    __slots__ = ("lines", "parent", "mark", "rest", "item", "listed", "quoted", "filled")

    def __init__(self, lines: list[str], parent: "_Place | None" = None, mark: str = "", item: bool = False) -> None:
        self.lines, self.parent, self.mark, self.item = lines, parent, mark, item
        self.rest = (parent.rest if parent else "") + (" " * len(mark) if item else mark)
        self.listed = item or bool(parent and parent.listed)
        self.quoted = bool(parent and (parent.quoted or not item))
        self.filled = False

    def behind(self) -> "_Place":
        """The same place for list items behind the first, which no blank line sets apart."""
        other = _Place(self.lines, self)
        other.item, other.listed, other.quoted, other.filled = True, self.listed, self.quoted, True
        return other

    def begin(self, tight: bool) -> str:
        """Prefix of the first line of a new block; blocks are a blank line apart, but for lists behind another block of an item."""
        if not self.filled:
            self.filled = True
            return (self.parent.begin(self.item) if self.parent else "") + self.mark
        if not (tight and self.item):
            self.lines.append(self.rest.rstrip(" "))
        return self.rest

    def put(self, block: str) -> None:
        if not block:
            return
        prefix = self.begin(bool(re.match(r"(-|\d+\.) ", block)))
        for line in block.split("\n"):
            self.lines.append((prefix + line).rstrip() if self.quoted else prefix + line)
            prefix = self.rest


def _list(node: Node, ordered: bool, place: _Place) -> None:
    start = node.attrs.get("start", "1")
    n = int(start) if re.fullmatch("[0-9]{1,9}", start) else 1
    outer = place
    for item in node.named("li"):
        first = len(place.lines)
        here = _Place(place.lines, outer, f"{n}. " if ordered else "- ", item=True)
        _blocks(item, here)
        if not here.filled:
            prefix = here.begin(True)
            place.lines.append(prefix.rstrip() if here.quoted else prefix)
        if not place.listed:  # blanks at line ends, but for the last line of an outermost item
            place.lines[first:-1] = [x.rstrip(" \t") for x in place.lines[first:-1]]
        if outer is place:  # further items follow without a blank line
            outer = place.behind()
        n += 1


def _table(node: Node) -> str:
    rows = []
    for x in node.walk():
        if x.tag == "tr":
            rows.append([_tidy(_inline(c)).replace("\n", " ").replace("|", "\\|") for c in x.named("td", "th")])
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join(["---"] * width) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])])


def _blocks(node: Node, place: _Place) -> None:
    """Write the blocks below ``node`` to their place."""
    run = Node("#run")

    def flush() -> None:
        if run.children:
            place.put(_tidy(_inline(run)))
            run.children = []

    for c in node.children:
        if isinstance(c, str) or (c.tag not in BLOCKS and c.tag not in HIDDEN and not c.has_block):
            run.children.append(c)
            continue
        flush()
        if c.tag in HIDDEN:
            continue
        if re.fullmatch("h[1-6]", c.tag):
            text = _tidy(_inline(c)).replace("\n", " ")
            place.put(f"{'#' * int(c.tag[1])} {text}" if text else "")
        elif c.tag == "hr":
            place.put("---")
        elif c.tag in ("ul", "ol"):
            _list(c, c.tag == "ol", place)
        elif c.tag == "blockquote":
            _blocks(c, _Place(place.lines, place, "> "))
        elif c.tag == "pre":
            code = next(iter(c.named("code")), c)
            language = re.search(r"language-([\w+-]+)", code.attrs.get("class", "") or c.attrs.get("class", ""))
            text = code.text().strip("\n")
            fence = "```" if "```" not in text else "````"
            place.put(f"{fence}{language[1] if language else ''}\n{text}\n{fence}")
        elif c.tag == "table":
            place.put(_table(c))
        else:
            _blocks(c, place)
    flush()


# -- Safe HTML --------------------------------------------------------------------------------------------------


def _remote(v: str) -> bool:
    return bool(re.match(r"(?i)(?:[a-z][a-z\d+.-]*:|//)", v))


def safe_href(v: str) -> bool:
    if not v or v.startswith(("#", "/read/")) or re.match("(?i)(?:https?:|mailto:)", v):
        return True
    return not _remote(v) and ".." not in re.split(r"[\\/]", v) and "\0" not in v


def safe_image(v: str) -> bool:
    m = re.match(r"(?:\.\./)?assets/images/", v)
    rest = v[m.end() :] if m else ""
    return bool(m) and not _remote(v) and bool(rest) and not rest.startswith("/") and ".." not in re.split(r"[\\/]", rest)


def sanitize(html: str | None) -> str:
    """Allowed tags and attributes only; content of other tags stays, but for script and style."""
    out: list[str] = []

    def emit(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                out.append(escape(c, quote=False))
                continue
            if c.tag in ("script", "style", "textarea", "option", "noscript"):
                continue
            keep = c.tag in ALLOWED_TAGS
            attrs = {k: c.attrs[k] for k in c.attrs if k in ALLOWED_ATTRIBUTES.get(c.tag, ())}
            if c.tag == "a":
                attrs["href"] = attrs["href"] if "href" in attrs and safe_href(attrs["href"]) else "#"
                attrs["rel"] = "noreferrer noopener"
            if c.tag == "img" and not safe_image(attrs.get("src", "")):
                continue
            if keep:
                out.append(f"<{c.tag}{''.join(f' {k}=' + chr(34) + escape(v) + chr(34) for k, v in attrs.items())}{' /' if c.tag in VOID else ''}>")
            emit(c)
            if keep and c.tag not in VOID:
                out.append(f"</{c.tag}>")

    if html:
        emit(parse(html))
    return "".join(out)


def skeleton(html: str) -> dict:
    """Pre-order blocks, link targets and image sources."""
    blocks, links, images = [], [], []
    empty = {"kind": None, "level": None, "ordered": None, "item_count": None, "rows": None, "columns": None, "language": None}
    for n in parse(html).walk():
        if n.tag == "a" and "href" in n.attrs:
            links.append(n.attrs["href"])
        elif n.tag == "img" and "src" in n.attrs:
            images.append(n.attrs["src"])
        elif re.fullmatch("h[1-6]", n.tag):
            blocks.append(empty | {"kind": "heading", "level": int(n.tag[1])})
        elif n.tag in ("p", "blockquote"):
            blocks.append(empty | {"kind": "paragraph" if n.tag == "p" else "blockquote"})
        elif n.tag in ("ul", "ol"):
            blocks.append(empty | {"kind": "list", "ordered": n.tag == "ol", "item_count": len(n.named("li"))})
        elif n.tag == "table":
            rows = _rows(n)
            blocks.append(empty | {"kind": "table", "rows": len(rows), "columns": max((len(r.named("td", "th")) for r in rows), default=0)})
        elif n.tag == "pre":
            code = next(iter(n.named("code")), None)
            m = re.search(r"language-([\w+-]+)", (code.attrs.get("class") if code is not None and "class" in code.attrs else n.attrs.get("class")) or "")
            blocks.append(empty | {"kind": "code", "language": m[1] if m else None})
        elif n.tag == "hr":
            blocks.append(empty | {"kind": "thematic-break"})
    return {"blocks": blocks, "links": links, "images": images}


def _rows(node: Node) -> list[Node]:
    """Rows of a table; rows of tables inside its cells are not its own."""
    out = []
    for c in node.children:
        if not isinstance(c, str):
            out += [c] if c.tag == "tr" else _rows(c)
    return out


def plain(html: str) -> str:
    return unescape(parse(html).text())
