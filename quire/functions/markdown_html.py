"""Markdown to HTML: CommonMark's core with tables, strikethrough and task lists.

Blocks nest up to ``MAX_BLOCKS`` and link labels up to ``MAX_LABELS``; what lies deeper is text.  Every step takes time in proportion to
the text, whatever the text is.
"""

from __future__ import annotations

import re
from html import escape
from itertools import chain

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})([ \t].*)?$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:/?(?:address|article|aside|blockquote|body|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|script|section|style|table|tbody|td|th|thead|tr|ul)\b|!--)", re.I)
MAX_BLOCKS, MAX_LABELS = 100, 20


def to_html(markdown: str | None) -> str:
    if not markdown:
        return ""
    lines = markdown.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ").split("\n")
    return "".join(_blocks(lines, False, 0))


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _starts_block(line: str) -> bool:
    m = _ITEM.match(line)
    item = bool(m) and bool((m[4] or "").strip()) and (m[2] in "-*+" or m[2][:-1] == "1")
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or item or re.match(r" {0,3}>", line) or _HTML.match(line))


def _title(line: str) -> str:
    """Text of a heading line after its marks, without closing marks."""
    text = line.strip()
    bare = text.rstrip("#")
    return bare.rstrip() if bare != text and (not bare or bare[-1] in " \t") else text


def _blocks(lines: list[str], tight: bool, depth: int) -> list[str]:
    if depth > MAX_BLOCKS:
        text = inline("\n".join(x.strip() for x in lines if x.strip()))
        return [f"<p>{text}</p>\n"] if text else []
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            mark, info, body = m[1], m[2].strip(), []
            indent = len(line) - len(line.lstrip(" "))
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                body.append(re.sub(f"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            i += 1
            language = f' class="language-{escape(info.split()[0])}"' if info else ""
            out.append(f"<pre><code{language}>{escape(''.join(x + chr(10) for x in body))}</code></pre>\n")
        elif m := _HEADING.match(line):
            out.append(f"<h{len(m[1])}>{inline(_title(m[2] or ''))}</h{len(m[1])}>\n")
            i += 1
        elif _RULE.match(line):
            out.append("<hr />\n")
            i += 1
        elif re.match(r" {0,3}>", line):
            body = []
            while i < len(lines) and (re.match(r" {0,3}>", lines[i]) or (lines[i].strip() and body and body[-1].strip() and not _starts_block(lines[i]))):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(f"<blockquote>\n{''.join(_blocks(body, False, depth + 1))}</blockquote>\n")
        elif _ITEM.match(line):
            html, i = _list(lines, i, depth)
            out.append(html)
        elif line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            while body and not body[-1].strip():
                body.pop()
            out.append(f"<pre><code>{escape(''.join(x + chr(10) for x in body))}</code></pre>\n")
        elif _HTML.match(line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append("\n".join(body) + "\n")
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            head = _cells(line)
            i += 2
            rows = []
            while i < len(lines) and lines[i].strip() and not _starts_block(lines[i]):
                cells = _cells(lines[i])[: len(head)]
                rows.append(cells + [""] * (len(head) - len(cells)))
                i += 1
            body = "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>\n" for r in rows)
            out.append("<table>\n<thead>\n<tr>" + "".join(f"<th>{inline(c)}</th>" for c in head) + "</tr>\n</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if rows else "") + "</table>\n")
        else:
            body = [line]
            i += 1
            level = 0
            while i < len(lines) and lines[i].strip() and not level:
                if re.match(r" {0,3}=+[ \t]*$", lines[i]):
                    level = 1
                elif re.match(r" {0,3}-+[ \t]*$", lines[i]):
                    level = 2
                elif _starts_block(lines[i]):
                    break
                else:
                    body.append(lines[i])
                i += 1
            text = inline("\n".join(x.lstrip() for x in body).rstrip())
            out.append(f"<h{level}>{text}</h{level}>\n" if level else text + "\n" if tight else f"<p>{text}</p>\n")
    return out


def _list(lines: list[str], i: int, depth: int) -> tuple[str, int]:
    first = _ITEM.match(lines[i])
    ordered, kind = first[2][-1] in ".)", first[2][-1]
    start = int(first[2][:-1]) if ordered else 1
    items: list[list[str]] = []
    loose = False
    blank = False
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m or m[2][-1] != kind or _RULE.match(lines[i]):
            break
        pad = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] and len(m[3]) <= 4 and m[4] else 1)
        loose |= blank
        body, blank = [lines[i][pad:] if m[4] else ""], False
        i += 1
        while i < len(lines):
            if not lines[i].strip():
                blank = True
                body.append("")
            elif lines[i].startswith(" " * pad):
                loose |= blank and any(x.strip() for x in body)
                blank = False
                body.append(lines[i][pad:])
            elif blank or _ITEM.match(lines[i]) or _starts_block(lines[i]):
                break
            else:
                body.append(lines[i].strip())
            i += 1
        while body and not body[-1].strip():
            body.pop()
        items.append(body)
    out = []
    for body in items:
        task = re.match(r"\[([ xX])\] ", body[0]) if body else None
        if task:
            body = [body[0][4:], *body[1:]]
        html = "".join(_blocks(body, not loose, depth + 1)).rstrip("\n")
        box = f'<input type="checkbox" disabled=""{" checked=" + chr(34) * 2 if task[1] != " " else ""} /> ' if task else ""
        out.append(f"<li>{box}{chr(10) + html + chr(10) if html.startswith('<p>') else html}</li>\n")
    tag = "ol" if ordered else "ul"
    number = f' start="{start}"' if ordered and start != 1 else ""
    return f"<{tag}{number}>\n{''.join(out)}</{tag}>\n", i


_TOKEN = r"""\\([!-/:-@\[-`{-~])|(`+)|(!?)\[|<((?:https?|mailto):[^\s<>]*)>|(</?[a-zA-Z][^<>]*>%s)|((?<! ) {2,}|\\)\n|(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"""
#: With comments, and without them for the text behind the last end of a comment.
_TOKENS = tuple(re.compile(_TOKEN % x, re.S) for x in ("|<!--.*?-->", ""))
_TARGET = re.compile(r"""\([ \n]*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:[ \n]+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'))?[ \n]*\)""", re.S)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def _closing(text: str) -> dict[int, int]:
    """The bracket that closes each opening one, in one pass."""
    found, stack, skip = {}, [], -1
    for m in re.finditer(r"[\\\[\]]", text):
        k = m.start()
        if k == skip:
            continue
        if m[0] == "\\":
            skip = k + 1
        elif m[0] == "[":
            stack.append(k)
        elif stack:
            found[stack.pop()] = k
    return found


def _link(text: str, i: int, closing: dict[int, int]) -> tuple[str, str, str | None, int] | None:
    """(label, target, title, end) of a link whose bracket opens at i."""
    k = closing.get(i)
    m = None if k is None else _TARGET.match(text, k + 1)
    if not m:
        return None
    plain = lambda s: _ESCAPED.sub(r"\1", s)
    title = m[3] if m[3] is not None else m[4]
    return text[i + 1 : k], plain(m[1] if m[1] is not None else m[2]), None if title is None else plain(title), m.end()


def _marks(text: str) -> tuple[str, str]:
    """Two characters that the text does not have; they stand around the numbers of finished pieces."""
    used = set(text)
    free = (c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x110000))) if c not in used)
    return next(free), next(free)


def inline(text: str, depth: int = 0) -> str:
    held: list[str] = []
    begin, stop = _marks(text)
    closing, comments = _closing(text), text.rfind("-->")
    lone: set[str] = set()  # runs of backticks that nothing closes any more

    def hold(html: str) -> str:
        held.append(html)
        return f"{begin}{len(held) - 1}{stop}"

    def inner(label: str) -> str:
        return inline(label, depth + 1) if depth < MAX_LABELS else escape(label, quote=False)

    out, i = [], 0
    while m := _TOKENS[i > comments].search(text, i):
        out.append(escape(text[i : m.start()], quote=False))
        i = m.end()
        if m[1]:
            out.append(hold(escape(m[1])))
        elif m[2]:
            end = None if m[2] in lone else re.compile(rf"(?<!`){m[2]}(?!`)").search(text, i)
            if end:
                code = text[i : end.start()].replace("\n", " ")
                code = code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code
                out.append(hold(f"<code>{escape(code)}</code>"))
                i = end.end()
            else:
                lone.add(m[2])
                out.append(hold(m[2]))
        elif m[4]:
            out.append(hold(f'<a href="{escape(m[4])}">{escape(m[4])}</a>'))
        elif m[5] or m[7]:
            out.append(hold(m[0]))
        elif m[6]:
            out.append(hold("<br />\n"))
        else:
            found = _link(text, m.end() - 1, closing)
            if found is None:
                out.append(m[0])
                continue
            label, target, title, i = found
            extra = f' title="{escape(title)}"' if title is not None else ""
            if m[3]:
                alt = re.sub(r"<[^>]*>", "", inner(label))
                out.append(hold(f'<img src="{escape(target)}" alt="{alt}"{extra} />'))
            else:
                out.append(hold(f'<a href="{escape(target)}"{extra}>{inner(label)}</a>'))
    out.append(escape(text[i:], quote=False))
    html = "".join(out)
    html = re.sub(r"~~(?=\S)((?:(?!~~).)+?)(?<=\S)~~", r"<del>\1</del>", html, flags=re.S)
    for mark, tag in ((r"\*\*", "strong"), ("__", "strong"), (r"\*", "em"), ("_", "em")):
        edge = r"(?<!\w)" if "_" in mark else ""
        after = r"(?!\w)" if "_" in mark else ""
        body = r"(?:(?!" + mark + r").)+?" if len(mark.replace("\\", "")) == 2 else r"[^*]+?" if "*" in mark else r"[^_]+?"
        html = re.sub(rf"{edge}{mark}(?=\S)({body})(?<=\S){mark}{after}", rf"<{tag}>\1</{tag}>", html, flags=re.S)
    # pieces are finished and hold no marks of this text, so one pass puts them back
    return re.sub(f"{begin}(\\d+){stop}", lambda m: held[int(m[1])], html)
