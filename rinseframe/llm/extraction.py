"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block element leaves one line. Lines of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, known by element or by
class, id and role names, are taken out and part nothing; a class or id name does not take
out a wrapper that holds most of the page's text, unless the article is marked elsewhere.
On every page the weights of three neighbouring lines are summed: where the sum rises from
nothing is a surge point, where it falls back to nothing a dive point, and the lines
between them are a region. A line weighs its text outside links. Links count as text inside
marks (``article``, ``main``, containers named for content), in lines as long as the page's
typical line, and, where marks do not hold most of the text, in fewer neighbouring lines
than a window, since these are no menu, and in lists between two paragraphs that each
hold more text, since these belong to the article.

Every region is kept but stubs: those that peak nearer to one character than to the page's
typical line, on a logarithmic scale. Marks never drop what lies outside them.

Defined results: a null or empty page has an empty text; an unclosed tag is text; what an
unclosed script or comment hides stays hidden; repeated rows are extracted each; an empty
table stays empty; input columns named like an added column are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from statistics import median_low

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import fresh, without

WINDOW = 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>"
    r"|<[!?][^>]*>|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# fixed values: element names of HTML
RAW = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: an element that a following one of these ends, if it is open in the same container
ENDED_BY = {
    "p": BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
CONTAINERS = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote figure".split())

#: elements that are not part of an article
BESIDE = frozenset(
    "head nav footer aside form dialog menu select button datalist fieldset noscript template iframe object svg canvas "
    "audio video map search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: words of class and id names, and those that also hold for an article element
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification notifications overlay pager pagination paywall popup popover promo promotion recommended "
    "related reply replies respond responses share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "teaser teasers toolbar widget widgets".split()
)
ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments promo related reply replies sponsored teaser teasers widget".split())
#: reader comments can be longer than the article
READERS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
CONDITIONS = ("has-", "with-", "no-", "is-", "without-", "js-")
WORD = re.compile(r"[a-z0-9]+")
#: class and id names of containers for the main text
CONTENT = re.compile(
    r"(?:(?:main|article|post|entry|story|page|blog|news)[-_]?)?(?:content|body|text|article|post|entry|story|main)"
)


def role_of(tag: str, attributes: str, in_article: bool) -> tuple[bool, str, frozenset[str]]:
    """Whether an element is beside the article, what it marks (article, main, content or nothing), and names that speak against it."""
    nothing: frozenset[str] = frozenset()
    marks = tag if tag in ("article", "main") else ""
    if tag in BESIDE or (tag == "header" and not in_article):
        return True, "", nothing
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return False, marks, nothing
    values = {}
    for name, *given in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), next((v for v in given if v), "").lower())
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        return True, "", nothing
    role = values.get("role", "")
    if role in ROLES:
        return True, "", nothing
    if role in ("article", "main") or values.get("itemprop") == "articlebody":
        marks = marks or ("main" if role == "main" else "article")
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    against = nothing
    if tag != "main":
        wanted = ARTICLE_NAMES if marks == "article" else NAMES
        against = frozenset(w for name in names if not name.startswith(CONDITIONS) for w in WORD.findall(name) if w in wanted)
    if not marks and not against and tag in CONTAINERS and any(CONTENT.fullmatch(name) for name in names):
        marks = "content"
    return False, marks, against


class Lines:
    """The lines of a page that have text and are in no element beside the article.

    Each is (text, characters outside links, in an article, main, content, the open wrappers with a name against them).
    """

    def __init__(self, page: str):
        self.found: list[tuple[str, int, bool, bool, bool, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.plain = 0
        self.open: list[tuple[str, bool, str, bool]] = []
        self.depth = {"article": 0, "main": 0, "content": 0, "": 0, "a": 0, "beside": 0}
        #: the names of each wrapper that has some against it, and those of them that are open
        self.against: list[frozenset[str]] = []
        self.within: tuple[int, ...] = ()
        at = 0
        while at < len(page):
            token = TOKEN.match(page, at)
            at = token.end()
            tag = token["tag"]
            if tag is None:
                text = token[0]
                if text[0] != "<" or text == "<":
                    self.add(html.unescape(text) if "&" in text else text)
                continue
            tag = tag.lower()
            if token["close"]:
                self.close(tag)
            else:
                self.begin(tag, token["attributes"])
                if tag in RAW:
                    end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                    at = end.start() if end else len(page)
        self.flush()

    def add(self, text: str) -> None:
        self.parts.append(text)
        if not self.depth["a"] and not text.isspace():
            self.plain += len(text)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not self.depth["beside"]:
            inside = [self.depth[k] > 0 for k in ("article", "main", "content")]
            self.found.append((text, min(self.plain, len(text)), *inside, self.within))
        self.parts, self.plain = [], 0

    def push(self, tag: str, apart: bool, marks: str, against: frozenset[str]) -> None:
        self.open.append((tag, apart, marks, bool(against)))
        if against:
            self.within += (len(self.against),)
            self.against.append(against)
        self.depth["a"] += tag == "a"
        self.depth[marks] += 1
        self.depth["beside"] += apart

    def pop(self) -> None:
        tag, apart, marks, against = self.open.pop()
        if against:
            self.within = self.within[:-1]
        self.depth["a"] -= tag == "a"
        self.depth[marks] -= 1
        self.depth["beside"] -= apart

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.add(" ")
            return
        apart, marks, against = role_of(tag, attributes, self.depth["article"] > 0)
        if tag in BLOCK or apart or against:
            self.flush()
            self.end_implied(tag)
        if tag == "body":
            while self.open and self.open[-1][0] != "html":
                self.pop()
        if tag not in VOID:
            self.push(tag, apart, marks, against)

    def end_implied(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if tag in ENDED_BY.get(name, ()):
                while len(self.open) > i:
                    self.pop()
                return
            if name in CONTAINERS:
                return

    def close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name, apart, _, against = self.open[i]
            if name == tag:
                if tag in BLOCK or apart or against:
                    self.flush()
                while len(self.open) > i:
                    if self.open[-1][0] in BLOCK or self.open[-1][1] or self.open[-1][3]:
                        self.flush()
                    self.pop()
                return
            if name in ("article", "main", "body") and tag not in BLOCK:
                return
        if tag in BLOCK:
            self.flush()


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """Line ranges between a surge point and its dive point of the summed weights."""
    found, start = [], None
    for i, weight in enumerate(weights):
        if weight and start is None:
            start = i
        if start is not None and not sum(weights[i : i + WINDOW]):
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    return found


def beside_by_name(page: Lines) -> set[int]:
    """The wrappers that their names take out.

    Not those with most of the page's text that hold an article or main element, or, on pages
    where these have no text at all, that are not for readers' comments.
    """
    lines = page.found
    total, held, holders = sum(line[1] for line in lines), [0] * len(page.against), set()
    for line in lines:
        for w in line[5]:
            held[w] += line[1]
        if line[2] or line[3]:
            holders.update(line[5])
    marked = any(line[2] or line[3] for line in lines)

    def wraps(w: int) -> bool:
        return 2 * held[w] > total and (w in holders or not (marked or page.against[w] & READERS))

    return {w for w in range(len(page.against)) if not wraps(w)}


def weighed(lines: list[tuple]) -> tuple[list[int], int]:
    """The weight of each line, and that of the typical one."""
    # a container around an article, or a content container around or inside another mark, marks nothing more
    main = not any(line[2] and line[3] for line in lines)
    content = not any((line[2] or line[3]) and line[4] for line in lines)
    marked = [line[2] or (main and line[3]) or (content and line[4]) for line in lines]
    weights = [len(line[0]) if m else line[1] for line, m in zip(lines, marked)]
    typical = median_low(sorted(w for w in weights if w) or [0])
    loose = 2 * sum(w for w, m in zip(weights, marked) if m) <= sum(weights)
    start = 0
    while start < len(lines):
        end = start
        while end < len(lines) and not weights[end]:
            end += 1
        inside = loose and (end - start < WINDOW or between_paragraphs(lines, weights, typical, start, end))
        for i in range(start, end):
            if len(lines[i][0]) >= typical or inside:
                weights[i] = len(lines[i][0])
        start = end + 1
    return weights, typical


def between_paragraphs(lines: list[tuple], weights: list[int], typical: int, start: int, end: int) -> bool:
    """Whether the lines without weight stand between two typical lines at least, in texts that each outweigh them."""
    if not 0 < start < end < len(lines) or min(weights[start - 1], weights[end]) < typical:
        return False
    before, after = start, end
    while before and weights[before - 1]:
        before -= 1
    while after < len(lines) and weights[after]:
        after += 1
    return sum(len(line[0]) for line in lines[start:end]) <= min(sum(weights[before:start]), sum(weights[end:after]))


def main_text(page: str | None) -> str:
    read = Lines(page or "")
    gone = beside_by_name(read)
    lines = [line for line in read.found if not gone.intersection(line[5])]
    weights, typical = weighed(lines)
    kept = [(a, b) for a, b in regions(weights) if max(sum(weights[i : i + WINDOW]) for i in range(a, b)) ** 2 >= typical]
    return "\n\n".join(line[0] for a, b in kept for line in lines[a:b])


def extracted(df: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Replace the page by its main text; other columns stay."""
    df = without(df, *([name] if name.lower() != html_col.lower() else []))
    kept = [c for c in df.columns if c.lower() != html_col.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").alias(fresh(df, "page_source")))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{name}` string"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = pa.array([main_text(page.as_py()) for page in batch.column(len(kept))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], names=[*kept, name])

    return source.mapInArrow(extract, kinds)
