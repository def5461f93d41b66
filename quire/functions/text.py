"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \\s knows it, inside a character class.
WS = r"\s\x0B\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Words that open a heading line, languages written right to left, names of languages.
HEADING_WORDS = ("chapter", "part", "section", "appendix", "prologue", "epilogue", "introduction", "conclusion", "contents", "foreword", "afterword")
RTL_LANGUAGES = ("ar", "dv", "fa", "he", "ps", "ur", "yi")
LANGUAGE_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French", "it": "Italian", "ja": "Japanese", "nl": "Dutch", "pt": "Portuguese", "ru": "Russian", "zh": "Chinese"}


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(F.encode(c, "UTF-16BE")) / 2


def trim_js(c: Column) -> Column:
    return _sub(c, f"^[{WS}]+|[{WS}]+$", "")


def normalize_text(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    # a single space is no match, so plain prose is only looked at
    return F.trim(_sub(c, f"[{WS}](?:[{WS}]+|(?<! ))", " "))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_markdown(c: Column) -> Column:
    return _sub(c, r"([\\`*_\[\]<>])", r"\\$1")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition leaves one ASCII letter or digit, and those."""
    left, right = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(cp)) if not "̀" <= x <= "ͯ")
        if len(base) == 1 and base.isascii() and base.isalnum():
            left.append(chr(cp))
            right.append(base)
        elif cp in range(0x300, 0x370):
            left.append(chr(cp))
    return "".join(c for c in left if not "̀" <= c <= "ͯ") + "".join(c for c in left if "̀" <= c <= "ͯ"), "".join(right)


def slug(c: Column) -> Column:
    """Stable name of a path or title: base name, without what follows its last dot, folded to ``a-z0-9`` and hyphens.

    Folding covers characters that decompose to one letter or digit; ``slug_exact`` covers the others too.
    """
    base = F.regexp_extract(_sub(c, "/+$", ""), "([^/]*)$", 1)
    base = F.translate(_sub(base, r"(?s)^(.+)\.[^.]*$", "$1"), *_folds())
    out = _sub(_sub(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "document").otherwise(out)


def slug_exact(value: str) -> str:
    """The same for one string on the driver or inside an Arrow function, by full NFKD."""
    import re

    base = value.rstrip("/").rsplit("/", 1)[-1]
    base = re.sub(r"^(.+)\.[^.]*$", r"\1", base, flags=re.S)
    base = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", base)).lower()
    return re.sub("[^a-z0-9]+", "-", base).strip("-") or "document"


def unit_id(n: Column) -> Column:
    return F.format_string("unit-%03d", n)


def unit_path(n: Column, title: Column) -> Column:
    return F.format_string("chapters/%03d-%s.md", n, slug(title))


def _where(c: Column, holds: Callable[[Column], Column], pattern: str, by: str) -> Column:
    """``c`` with ``pattern`` replaced if ``holds``, which is cheap and true wherever the pattern occurs; ``c`` is worked out once."""
    return F.get(F.transform(F.array(c), lambda x: F.when(holds(x), _sub(x, pattern, by)).otherwise(x)), F.lit(0))


def _has(*parts: str) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts])


# What is no readable text of Markdown, in this order: code blocks, code, images, link targets, quotation marks, bullets, numbers of items, other marks.
_UNREADABLE = (
    (_has("```"), r"(?s)```.*?```", " "), (_has("`"), "`[^`]*`", " "), (_has("!["), r"!\[[^\]]*\]\([^)]*\)", " "), (_has("]("), r"\[([^\]]*)\]\([^)]*\)", "$1"), (_has(">"), r"(?m)^[ \t]*>[ \t]?", ""),
    (_has(*[m + b for m in "-*+" for b in " \t"]), r"(?m)^[ \t]*[-*+][ \t]+", ""), (lambda x: x.rlike(r"\d[.)][ \t]"), r"(?m)^[ \t]*\d+[.)][ \t]+", ""), (lambda x: x.rlike("[*_~#>|]"), "[*_~#>|]", " "),
)


def _readable(c: Column) -> Column:
    """Readable text with its white space as it is.  A text is changed only by the replacements it has a mark for."""
    return reduce(lambda x, rule: _where(x, *rule), _UNREADABLE, c)


def readable_text(c: Column) -> Column:
    """Words of a Markdown text without code, images, targets and marks."""
    return normalize_text(_readable(c))


def plain_title(c: Column) -> Column:
    """A heading as plain text."""
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("`([^`]*)`", "$1"), ("[*_~]", "")):
        c = _sub(c, pattern, by)
    return normalize_text(c)


def first_words(c: Column, n: int = 10) -> Column:
    # the split stops after the words that are wanted; white space in front makes one empty part
    return F.array_join(F.slice(F.filter(F.split(c, f"[{WS}]+", n + 2), lambda w: w != ""), 1, n), " ")


def derive_title(markdown: Column) -> Column:
    """The first heading of level 1 or 2, else the first ten readable words, else ``Untitled``."""
    heading = plain_title(F.regexp_extract(markdown, r"(?m)^#{1,2}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1))
    # each candidate appears once in the expression, so each is worked out once
    return F.get(F.filter(F.array(heading, first_words(_readable(markdown)), F.lit("Untitled")), lambda x: x != ""), F.lit(0))


def heading_lines(markdown: Column) -> Column:
    return F.filter(F.split(markdown, "\n"), lambda x: x.rlike(r"^#{1,6}[ \t]+"))


def without_headings(markdown: Column) -> Column:
    return F.array_join(F.filter(F.split(markdown, "\n"), lambda x: ~x.rlike(r"^#{1,6}[ \t]+")), "\n")


def is_empty_chapter(markdown: Column) -> Column:
    return (F.size(heading_lines(markdown)) == 0) & (readable_text(markdown) == "")


def is_title_only(markdown: Column) -> Column:
    return (F.size(heading_lines(markdown)) > 0) & (readable_text(without_headings(markdown)) == "")


def is_heading_line(line: Column) -> Column:
    """A line of extracted page text that looks like a section heading."""
    size = utf16_length(line)
    words = line.rlike(r"(?i)^(" + "|".join(HEADING_WORDS) + r")\b")
    numbered = line.rlike(r"^\d+(?:\.\d+)*[.)]?[" + WS + "]+[A-Z]")
    shouted = (line == F.upper(line)) & line.rlike("[A-Z]")
    return (size > 0) & (size <= 100) & (words | numbered | shouted)


def is_page_marker(line: Column) -> Column:
    return line.rlike(r"(?i)^--[" + WS + r"]*\d+[" + WS + r"]+of[" + WS + r"]+\d+[" + WS + "]*--$")


def is_external_href(href: Column) -> Column:
    return href.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)")


def has_traversal(path: Column) -> Column:
    return F.array_contains(F.split(path, r"[\\/]"), "..")


def is_safe_image_source(src: Column) -> Column:
    local = r"^(?:\.\./)?assets/images/"
    rest = _sub(src, local, "")
    return ~is_external_href(src) & src.rlike(local) & (F.length(rest) > 0) & ~rest.startswith("/") & ~has_traversal(rest)


def is_safe_href(href: Column) -> Column:
    known = (href == "") | href.startswith("#") | href.rlike("(?i)^(?:https?:|mailto:)") | href.startswith("/read/")
    return known | (~is_external_href(href) & ~has_traversal(href) & ~F.contains(href, F.lit("\0")))


def is_data_source(src: Column) -> Column:
    return src.startswith("data:")


def image_format(content: Column) -> Column:
    """png, jpeg, gif or webp by the first bytes, else null."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(head(1, 4) == "89504E47", "png")
        .when(head(1, 3) == "FFD8FF", "jpeg")
        .when(head(1, 3) == "474946", "gif")
        .when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "webp")
    )


def is_embeddable(fmt: Column) -> Column:
    return fmt.isin("png", "jpeg")


def is_inside_root(root: str, path: Column) -> Column:
    """A path that is the root or below it, after ``.`` and ``..`` are resolved by ``normalize_path``."""
    normal = normalize_path(path)
    root = root.rstrip("/") or "/"
    return (normal == root) | normal.startswith("/" if root == "/" else root + "/")


def normalize_path(path: Column) -> Column:
    """POSIX normal form; leading ``..`` of relative paths stay."""
    absolute = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        popped = F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when((part == "") | (part == "."), acc).when(part == "..", popped).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus sign stays; malformed escapes give null."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def resolve_archive_path(base: Column, href: Column) -> Column:
    """Archive path of ``href`` seen from the directory ``base``; null when it leaves the archive or is malformed."""
    clean = percent_decode(F.element_at(F.split(href, "#", 2), 1))
    path = normalize_path(F.when(base.isin("", "."), clean).otherwise(F.concat_ws("/", base, clean)))
    return F.when(clean.isNull() | (path == "..") | path.startswith("../"), F.lit(None)).otherwise(path)


def dirname(path: Column) -> Column:
    out = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(out == "", ".").otherwise(out)


def is_safe_name(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def direction(language: Column) -> Column:
    return F.when(language.rlike("(?i)^(" + "|".join(RTL_LANGUAGES) + ")(?:-|$)"), "rtl").otherwise("ltr")


def language_name(tag: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.element_at(F.split(F.lower(tag), "-"), 1)), tag)


def cache_key(model: Column, to: Column, prompt_version: Column, markdown: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, to, prompt_version, markdown), 256)


def estimate_cost(no_cache: Column, cache_read: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """US dollars, rounded half up to six places."""
    cost = (no_cache * price_in + cache_read * F.coalesce(price_cached, price_in) + output * price_out) / 1_000_000
    return F.floor(cost * 1e6 + 0.5) / 1e6


def usd(c: Column) -> Column:
    return F.format_string("%.4f", c.cast("double"))


def seconds(ms: Column) -> Column:
    return F.format_string("%.2f", ms.cast("double") / 1000)


def format_location(location: Column) -> Column:
    """``page n``, ``spine item n``, the selector, or ``source``."""
    page = F.when(location["page"].isNotNull(), F.format_string("page %d", location["page"]))
    spine = F.when(location["spine_index"].isNotNull(), F.format_string("spine item %d", location["spine_index"] + 1))
    return F.coalesce(page, spine, location["selector"], F.lit("source"))


def describe_block(block: Column) -> Column:
    """A block of a skeleton as JSON; only code says that it has no language."""
    plain_code = F.when((block["kind"] == "code") & block["language"].isNull(), '{"kind":"code","language":null}')
    return F.coalesce(plain_code, F.to_json(block), F.lit("nothing (end of document)"))


def strip_outer_fence(c: Column) -> Column:
    pattern = r"(?s)^```[\w+-]*\r?\n(.*?)\r?\n?```$"
    trimmed = trim_js(c)
    return F.when(trimmed.rlike(pattern), F.regexp_extract(trimmed, pattern, 1)).otherwise(c)


def chapter_asset_link(path: Column) -> Column:
    return F.when(path.startswith("../"), path).otherwise(F.concat(F.lit("../"), path))


def manifest_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def image_stem(name: Column) -> Column:
    return _sub(name, r"\.[^.]+$", "")


def decode_text(content: Column) -> Column:
    """Bytes as text by their byte-order mark: UTF-16BE, UTF-16LE, else UTF-8; the mark goes."""
    head = F.hex(F.substring(content, 1, 2))
    wide = lambda charset: F.decode(F.substring(content, 3, 2147483647), charset)
    out = F.when(head == "FEFF", wide("UTF-16BE")).when(head == "FFFE", wide("UTF-16LE")).otherwise(F.make_valid_utf8(content.cast("string")))
    return _sub(out, "^\\x{feff}", "")


#: Markdown images and links: text, target, title, blanks after an image.
MARKDOWN_IMAGE = r'!\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)([ \t]*)'
MARKDOWN_LINK = r'(?<!!)\[((?:[^\[\]]|\[[^\]]*\])*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)'
ASSET_REFERENCE = r"\.\./(assets/images/[^)\s\"]+)"
