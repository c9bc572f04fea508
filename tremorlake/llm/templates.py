"""Main text of web pages by equivalence classes of template tokens.

A token is a tag at its place (the chain of containers above it, with their classes and ids), the text
of a block there, or a word of a short block. Its occurrence vector tells how often each page of the
host has it; tokens of equal vectors form an equivalence class. A class is valid if it has several tokens
on several pages of different text, in the same order on the pages compared, and nests in one other
class or none. Valid classes, nested in one another, are the template of their pages, so a host
has as many layouts as its pages show, and what they leave open are the slots. Blocks
whose text stands wherever their container does belong to the template, as do slots of links; of the others
the narrowest one that has most of the text is the main slot.

An element that names the article wins over a slot found by size, and nothing of it is template. Names of
classes tell what is not the article if they say nothing else, and not where they would leave nothing of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.llm.common import arrow_map, checkpointed

#: A valid class has this many tokens, on this many pages of different texts.
MIN_TOKENS = 3
MIN_PAGES = 3
#: Slots with a greater share of their characters in links are template.
LINK_SHARE = 0.6
#: Share of its page's open text that the main slot must hold.
MAIN_SHARE = 0.7
#: Blocks of up to so many words give their words as tokens; where a page has no main slot, such blocks go if
#: this share of their words is template.
SHORT_WORDS = 8
WORD_SHARE = 0.6
#: Templates of all hosts beyond this many bytes are joined by host instead of broadcast.
BROADCAST_BYTES = 32 << 20
#: Tokens that a task sums up before it sends them on.
HELD_TOKENS = 200_000
_LANE = (1 << 40) - 1

# Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "button", "canvas", "xmp", "noembed", "noframes", "math"}
NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "figure", "fieldset", "details", "center", "td"} | NEVER
BREAKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr", "tr", "th", "dt", "dd", "pre", "blockquote", "address", "figcaption", "tbody", "thead", "tfoot", "caption", "summary", "legend", "option", "optgroup", "hgroup", "search"} | CONTAINERS
#: Elements that end where the next block begins, and elements without content.
ENDS_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "option"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# Words of classes, ids and roles that mark what is not the article.
MARKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead header ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup share sharing social comment comments disqus respond related recommended login search widget widgets pagination pager toolbar skip contentinfo complementary".split())
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)|[!?][^>]*(?:>|\Z)|/(?=[^A-Za-z])[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Words that leave a marked name what it is.
FILLERS = frozenset("area bar block box bottom btn button buttons col column container count counter form group icon icons inner item items left link links list label module outer panel primary right row secondary section site slot title top unit wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    """The host of an address in lower case; empty if it has none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _marks(attrs: str) -> set[str]:
    """Words that mark what is not the article, of the class, id and role; a name counts if it says nothing else."""
    out: set[str] = set()
    if attrs and not attrs.isspace():
        for _, a, b, c in _ATTR.findall(attrs):
            for name in (a or b or c).split():
                words = {w.lower() for w in _WORD.findall(name)}
                if words & MARKS and words <= MARKS | FILLERS:
                    out |= words & MARKS
    return out


def _token(name: str, attrs: str) -> str:
    """A container's tag with its classes and id, digits as zeros."""
    if not attrs or attrs.isspace():
        return name
    said = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    return name + "".join(f".{w}" for w in re.sub(r"[0-9]+", "0", said.get("class", "")).split()) + (f"#{re.sub(r'[0-9]+', '0', said['id'])}" if "id" in said else "")


class Frame:
    """An open container: its tag's token as a number that stands for the chain above it too, whether it is marked
    (1 by names, 2 by its element), and whether it lies within an article or main element."""

    __slots__ = ("name", "path", "mark", "named", "article", "up", "depth", "inside", "closed", "chars", "links")

    def __init__(self, name: str, path: int, mark: int, up: Frame | None):
        self.name, self.path, self.up = name, path, up
        self.mark = max(mark, up.mark) if up else mark
        self.article = name == "article" or bool(up and up.article)
        self.named = name in ("article", "main") or bool(up and up.named)
        self.depth = up.depth + 1 if up else 0
        self.inside = self.closed = False
        self.chars = self.links = 0


def pieces(page: str | None) -> Iterator[tuple[Frame, str | None, bool, int]]:
    """Stretches of text in page order: (container, text, whether it lies in a link, how it is marked); None for a
    text tells that the container opens, and a new line is a break between blocks. Element names are in
    lower case; unclosed elements end with what holds them; scripts, styles and markup give nothing."""
    from xxhash import xxh64_intdigest

    page = page or ""
    root = Frame("", 0, 0, None)
    stack: list[Frame] = []
    opened: dict[str, int] = {}
    at_, link = root, False
    hidden, nested = "", 0  # a marked element that holds no containers by itself, and how often it is nested
    at = 0
    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            yield at_, page[at:], link, max(at_.mark, bool(hidden))
            return
        if m.start() > at:
            yield at_, page[at : m.start()], link, max(at_.mark, bool(hidden))
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        closing = bool(m[1])
        if name in RAW and not closing:
            if not m[3].endswith("/") or name not in ("svg", "math"):
                at = _RAW_END[name].search(page, at).start()
            continue
        if hidden and (name == hidden or (hidden in ENDS_BY_BLOCK and name in BREAKS and name != "br") or (closing and name in CONTAINERS)):
            # it ends with its own tag, with a block that it cannot hold, or with what holds it
            nested += (-1 if closing else 1) if name == hidden and hidden not in ENDS_BY_BLOCK else -nested
            if nested <= 0:
                hidden = ""
        if not hidden and not closing and name not in CONTAINERS and name not in VOID and _marks(m[3]):
            hidden, nested = name, 1
        if name == "a":
            link = not closing
        elif name in CONTAINERS:
            yield at_, "\n", link, at_.mark
            if closing:
                while opened.get(name):
                    last = stack.pop().name
                    opened[last] -= 1
                    if last == name:
                        break
                link = False
            elif not (name in ("html", "body") and opened.get(name)):
                if name == "body":
                    stack, opened = [s for s in stack if s.name == "html"], {"html": opened.get("html", 0)}
                up = stack[-1] if stack else root
                marks = _marks(m[3]) if name not in ("html", "body") else set()
                if up.named and marks <= {"header"}:
                    marks = set()  # an article's own header is part of it
                mark = 2 if name in NEVER or (name == "header" and not up.named) else int(bool(marks))
                path = xxh64_intdigest(up.path.to_bytes(8, "little") + _token(name, m[3]).encode("utf-8", "surrogatepass")) >> 1
                stack.append(Frame(name, path, mark, up))
                opened[name] = opened.get(name, 0) + 1
                yield stack[-1], None, False, stack[-1].mark
            at_ = stack[-1] if stack else root
        elif name in BREAKS:
            yield at_, "\n", link, at_.mark


Block = tuple[Frame, list[tuple[str, int]], int]


def read(page: str | None) -> tuple[list[Frame | Block], list[Frame], list[Block]]:
    """Containers and blocks of a page in order, and both by themselves; a block is (container, [(text, mark)],
    characters in links)."""
    order: list[Frame | Block] = []
    parts: list[tuple[str, int]] = []
    holder, linked = None, 0

    def flush():
        nonlocal parts, linked
        if parts:
            order.append((holder, parts, linked))
        parts, linked = [], 0

    for frame, text, link, mark in pieces(page):
        if text is None or frame is not holder or (text == "\n"):
            flush()
            holder = frame
            if text is None:
                order.append(frame)
        if text and not (text == "\n" or (text.isspace() and not parts)):
            parts.append((text, mark))
            linked += len(text.strip()) if link and not mark else 0
    flush()
    return order, [x for x in order if isinstance(x, Frame)], [x for x in order if not isinstance(x, Frame)]


def _clean(parts: list[tuple[str, int]], most: int) -> str:
    """The text of a block's parts that are marked ``most`` at most."""
    return " ".join(html.unescape("".join(t if m <= most else "\n" for t, m in parts)).split())


TAG, BLOCK, WORD = 0, 1, 2


def page_tokens(page: str | None) -> tuple[int, dict[tuple[int, int], list[int]]]:
    """A number for the page's text, and by (kind, token): its container's token, how often it occurs, its first
    place, and of tags the characters below it, those of them in links, and how it is marked. Texts in
    article elements and marked texts are no tokens."""
    from xxhash import xxh64_intdigest

    order, frames, blocks = read(page)
    out: dict[tuple[int, int], list[int]] = {}
    said = []
    place = 0

    def count(kind, token, up, mark):
        nonlocal place
        place += 1
        x = out.setdefault((kind, token), [up, 0, place, 0, 0, 0])
        x[1] += 1
        x[5] = max(x[5], mark)

    for x in order:
        if isinstance(x, Frame):
            count(TAG, x.path, x.up.path, x.mark)
            continue
        frame, parts, linked = x
        text = _clean(parts, 0)
        if not text:
            continue
        said.append(text)
        frame.chars += len(text)
        frame.links += min(linked, len(text))
        if not frame.article:
            of = frame.path.to_bytes(8, "little")
            count(BLOCK, xxh64_intdigest(of + text.encode("utf-8", "surrogatepass"), 1) >> 1, frame.path, 0)
            words = text.split()
            if len(words) <= SHORT_WORDS:
                for w in words:
                    count(WORD, xxh64_intdigest(of + w.encode("utf-8", "surrogatepass"), 2) >> 1, frame.path, 0)
    for frame in reversed(frames):  # what a container holds is part of what holds it
        x = out[TAG, frame.path]
        x[3] += frame.chars
        x[4] += frame.links
        frame.up.chars += frame.chars
        frame.up.links += frame.links
    return xxh64_intdigest("\n".join(said).encode("utf-8", "surrogatepass")), out


_TOKENS = "host string, kind int, token long, up long, n long, total long, v1 long, v2 long, seen1 long, seen2 long, low struct<page:long,place:int>, high struct<page:long,place:int>, chars long, links long, mark int"


def occurrences(pages: DataFrame) -> DataFrame:
    """Tokens by host: on how many pages, how often, the occurrence vector as two sums over pages of count times a
    number of the page, which pages have it (by some bits of their texts' hashes), its first place on the pages
    of least and greatest hash, and of tags the characters below it. Each task sums up its own pages first."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(_TOKENS))

    def run(batches):
        got: dict[tuple[str, int, int], list] = {}

        def rows():
            keys, vals = list(got), list(got.values())
            for a in range(0, len(keys), 10_000):
                k, v = keys[a : a + 10_000], vals[a : a + 10_000]
                cols = list(zip(*k, strict=True)) + list(zip(*v, strict=True))
                cols[10:12] = [[dict(page=p, place=q) for p, q in c] for c in cols[10:12]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            got.clear()

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                code, tokens = page_tokens(page)
                h1, h2, page_id = code & _LANE or 1, (code * 0x9E3779B97F4A7C15 >> 20) & _LANE or 1, code >> 1
                for (kind, token), (up, count, place, chars, links, mark) in tokens.items():
                    x = got.get((host, kind, token))
                    if x is None:
                        got[host, kind, token] = [up, 1, count, count * h1 & _LANE, count * h2 & _LANE, 1 << code % 61, 1 << code % 59, (page_id, place), (page_id, place), chars, links, mark]
                        continue
                    x[1] += 1
                    x[2] += count
                    x[3] = x[3] + count * h1 & _LANE
                    x[4] = x[4] + count * h2 & _LANE
                    x[5] |= 1 << code % 61
                    x[6] |= 1 << code % 59
                    x[7], x[8] = min(x[7], (page_id, place)), max(x[8], (page_id, place))
                    x[9] += chars
                    x[10] += links
                    x[11] = max(x[11], mark)
                if len(got) > HELD_TOKENS:
                    yield from rows()
        yield from rows()

    add = lambda c: F.sum(c).alias(c)
    lane = lambda c: F.pmod(F.sum(c), F.lit(_LANE + 1)).alias(c)
    part = pages.mapInArrow(run, _TOKENS)
    return part.groupBy("host", "kind", "token").agg(F.min("up").alias("up"), add("n"), add("total"), lane("v1"), lane("v2"), F.bit_or("seen1").alias("seen1"), F.bit_or("seen2").alias("seen2"), F.min("low").alias("low"), F.max("high").alias("high"), add("chars"), add("links"), F.max("mark").alias("mark"))


def classes(tokens: DataFrame) -> DataFrame:
    """The tokens of valid equivalence classes: (host, kind, token, up, n, chars, links, mark, class, up_class), the last
    being their containers' class."""
    several = (F.bit_count("seen1") >= MIN_PAGES) | (F.bit_count("seen2") >= MIN_PAGES)
    t = tokens.filter((F.col("n") >= MIN_PAGES) & several).withColumn("class", F.xxhash64("v1", "v2", "n", "total"))
    of = W.partitionBy("host", "class")
    rank = lambda c: F.row_number().over(of.orderBy(c, "token"))
    # tokens of one class stand on the same pages, so the places compared are of the same two pages
    t = t.withColumn("ordered", rank("low.place") == rank("high.place")).filter("ordered")
    above = t.filter(F.col("kind") == TAG).select("host", F.col("token").alias("up"), F.col("class").alias("up_class"))
    t = t.join(above, ["host", "up"], "left")
    outer = F.size(F.collect_set(F.when(F.col("up_class") != F.col("class"), F.col("up_class"))).over(of))
    t = t.withColumn("size", F.count(F.lit(1)).over(of)).withColumn("outer", outer)
    return t.filter((F.col("size") >= MIN_TOKENS) & (F.col("outer") <= 1)).select("host", "kind", "token", "up", "n", "chars", "links", "mark", "class", "up_class")


def templates(pages: DataFrame) -> DataFrame:
    """The template of each host with valid classes: its tags with their characters a page and whether their slot is one
    of links, and the blocks and words that belong to it."""
    t = classes(checkpointed(occurrences(pages)))  # few rows, which both sides of a join need
    fixed = F.col("up_class") == F.col("class")  # it stands wherever its container does
    slot = F.struct(F.col("token").alias("path"), (F.col("chars") / F.col("n")).alias("chars"), (F.col("links") > LINK_SHARE * F.col("chars")).alias("closed"))
    of = lambda kind, what: F.collect_list(F.when(what, F.col("token") if kind else slot))
    found = t.groupBy("host").agg(of(TAG, F.col("kind") == TAG).alias("slots"), of(BLOCK, (F.col("kind") == BLOCK) & fixed).alias("texts"), of(WORD, (F.col("kind") == WORD) & fixed).alias("words"))
    return found.filter(F.size("slots") > 0)


class Template:
    """What is known of a host's pages; without anything, each page goes by itself."""

    def __init__(self, slots=(), texts=(), words=()):
        self.slots = {s["path"]: (s["chars"], s["closed"]) for s in slots}
        self.texts, self.words = frozenset(texts), frozenset(words)


def main_text(page: str | None, template: Template | None = None) -> str:
    """The text of one page: of its article or main elements, else of the main slot of its template, else of
    all that is not marked."""
    from xxhash import xxh64_intdigest

    template = template or Template()
    _, frames, blocks = read(page)
    blocks = [b for b in blocks if b[0].mark < 2]
    named = any(b[0].named and not t.isspace() for b in blocks for t, _ in b[1])
    if named:
        chosen = [b for b in blocks if b[0].named]
    else:
        known = [(f, *template.slots[f.path]) for f in frames if f.path in template.slots and not f.mark]
        most = max((c for _, c, closed in known if not closed), default=0)
        deep = max((f.depth for f, c, closed in known if not closed and c >= MAIN_SHARE * most), default=0) if most else 0
        main = {f.path for f, c, closed in known if not closed and c >= MAIN_SHARE * most and f.depth == deep and f.name not in ("html", "body")} if most else set()
        for f in frames:
            f.inside = f.path in main or f.up.inside
            f.closed = f.up.closed or template.slots.get(f.path, (0, False))[1]
        chosen = [b for b in blocks if not b[0].closed and (b[0].inside or not main)]

    def template_text(frame: Frame, text: str) -> bool:
        if frame.article or not (template.texts or template.words):
            return False
        of = frame.path.to_bytes(8, "little")
        if xxh64_intdigest(of + text.encode("utf-8", "surrogatepass"), 1) >> 1 in template.texts:
            return True
        words = text.split()
        return not named and not main and len(words) <= SHORT_WORDS and sum(xxh64_intdigest(of + w.encode("utf-8", "surrogatepass"), 2) >> 1 in template.words for w in words) > WORD_SHARE * len(words)

    plain = [(b[0], _clean(b[1], 0)) for b in chosen]
    plain = [t for f, t in plain if t and not template_text(f, t)]
    if named and not plain:  # an article of which names leave nothing: they do not tell what it is
        plain = [t for b in chosen if (t := _clean(b[1], 1))]
    return " ".join(plain)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, address, main ``text`` (empty if none) and ``n_chars``, its code points.

    Character references are decoded, white space runs are one space, blocks are joined by one space;
    menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left
    out by their elements and names, and by the host's template. A null page is empty; a null
    address has the empty host; repeated rows and pages of the same text count once among the pages that a
    class needs and give repeated rows; an empty table gives none. Templates are broadcast where their
    counted size allows it, else joined by host.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = checkpointed(templates(src.select("url", "html")))
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long"
    size = found.agg(F.sum(F.length("host") + 80 * F.size("slots") + 40 * (F.size("texts") + F.size("words")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = src.sparkSession.sparkContext.broadcast({r.host: ([s.asDict() for s in r.slots], r.texts, r.words) for r in found.collect()})

        def make():
            made: dict[str, Template] = {}

            def of(host):
                if host not in made:
                    made[host] = Template(*known.value.get(host, ()))
                return made[host]

            def f(id, url, html):
                text = [main_text(h, of(host_of(u))) for u, h in zip(url, html, strict=True)]
                return {id_col: id, url_col: url, "text": text, "n_chars": list(map(len, text))}

            return f

        return arrow_map(src, schema, make)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = src.withColumn("host", host).join(found, "host", "left").select("id", "url", "html", "slots", "texts", "words")

    def joined():
        def f(id, url, html, slots, texts, words):
            text = [main_text(h, Template(s or (), t or (), w or ())) for h, s, t, w in zip(html, slots, texts, words, strict=True)]
            return {id_col: id, url_col: url, "text": text, "n_chars": list(map(len, text))}

        return f

    return arrow_map(rows, schema, joined)
