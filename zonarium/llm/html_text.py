"""Main text of web pages by line-block distribution over structure-aware lines.

A page becomes a list of lines, one for each block element's text. Lines of boilerplate elements (navigation, footers,
sidebars, adverts, notices, forms, comments, known by element, role or class) count as empty, and so do lines outside
the article where a page marks one. Text lengths are then summed over sliding windows of lines: a surge point is where
the sum rises above the threshold, a dive point where it falls to it, and the lines from the first surge to the last
dive are kept. On pages with a marked article the threshold is zero, so that a short paragraph is as safe as a long
one; on others it is the length of a sentence, or zero where no window reaches that, and link text does not count, nor
do lines that are over four fifths links.

Inside a marked article, class names count only where they name adverts, comments, sharing and the like as a whole
("related", not "related-work"), and never on headings. The scan is linear in the page: a quote that is never closed
is found once, and tags after it end at the next ">".
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
#: Elements of which nothing up to their end tag is text.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template iframe textarea title xmp".split()}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav footer aside form head button select menu dialog svg object audio video canvas datalist fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|newsletter|subscribe|subscription|paywall|sidebar|side|widget|related|recommend(?:ed|ations)?|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|breadcrumbs?|menu|nav|navbar|navigation|pagination|pager|footer|foot|header|masthead|topbar|toolbar|login|signup|search|copyright|skip)(?:[\s_-]|$)",
    re.I,
)
#: Class names and ids that are boilerplate inside a marked article too.
_INNER = re.compile(
    r"(?:[a-z]+-)*comments?(?:-(?:list|area|section|thread|form|wrapper|body))?|commentlist|disqus(?:-thread)?|respond|replies|reply|(?:[a-z]+-)*(?:ads?|adverts?|advertisement|advertising|adsense)|(?:ads?|adverts?)-(?:slot|unit|box|container|banner|wrapper|block|top|bottom|inline|label)|sponsor(?:ed)?(?:-(?:content|post|box))?|promos?|promotion|share|sharing|(?:share|sharing|social)-(?:buttons?|links?|bar|tools|icons?|share|media)|social|newsletter(?:-(?:signup|form|box))?|subscribe(?:-(?:form|box))?|subscription|paywall|(?:[a-z]+-)*cookies?-(?:notice|banner|consent|bar)|consent|gdpr|notices?|notification|alert|popup|modal|sidebar|widget|related|(?:related|recommended)-(?:posts|articles|links|stories|content|reading)|recommended|recommendations|breadcrumbs?|pagination|pager|menu|navbar|navigation|nav|toolbar|login|signup|skip-link"
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?:[\s_-]|$)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_LIST_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table article main section body html div".split())


def _boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """0 for content, 1 for boilerplate, 2 for readers' comments."""
    if tag in ("html", "body"):
        return 0
    names = [(name.lower(), re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values))) for name, *values in _ATTRIBUTE.findall(attributes)]
    if tag in ("article", "main"):
        return 2 * any(name != "role" and _COMMENTS.search(value) for name, value in names)
    if tag in _BOILERPLATE or tag == "header" and not in_article:
        return 1
    if in_article and tag in _HEADINGS:
        return 0
    for name, value in names:
        if name == "role":
            if value.lower() in _ROLES:
                return 1
        elif any(_INNER.fullmatch(x.replace("_", "-")) for x in value.lower().split()) if in_article else _NAMES.search(value):
            return 2 if _COMMENTS.search(value) else 1
    return 0


def _pieces(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Begin, end, whether it closes, name (empty for what is no element) and attributes of the markup of a page."""
    at, size, quotes = page.find("<"), len(page), True
    last = page.rfind(">")
    while at >= 0:
        begin, end, tag = at, 0, ("", "", "")
        if page.startswith("<!--", at):
            m = None if page.startswith((">", "->"), at + 4) else _COMMENT_END.search(page, at + 4)
            end = page.index(">", at) + 1 if page.startswith((">", "->"), at + 4) else m.end() if m else size
        elif at < last:
            m = _TAG.match(page, at) if quotes else None
            if not m and (loose := _LOOSE.match(page, at)):
                # No ">" outside quotes up to the end of the page: a quote is open.
                quotes, m = False, loose
            if m:
                tag, end = m.groups(), m.end()
                if not tag[0] and (raw := _RAW.get(tag[1].lower())):
                    close = raw.search(page, end)
                    gone = page.find(">", close.end()) if close else -1
                    tag, end = ("", "", ""), gone + 1 if gone >= 0 else size
            elif page[at + 1] in "!?/":
                end = page.index(">", at) + 1
        if end:
            yield begin, end, tag[0] == "/", tag[1].lower(), tag[2]
        at = page.find("<", end or at + 1)


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, boilerplate, in an article) of each block of a page, in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, int]] = []  # open elements, and whether they begin boilerplate
    text: list[str] = []
    state = {"skip": 0, "comments": 0, "article": 0, "link": 0, "linked": 0}
    names: dict[str, int] = {}

    def flush() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                out.append((line, max(0, len(line) - state["linked"]), state["skip"] > 0, state["article"] > 0))
            text.clear()
        state["linked"] = 0

    def pop() -> None:
        tag, skips = stack.pop()
        names[tag] -= 1
        state["skip"] -= skips > 0
        state["comments"] -= skips > 1
        state["article"] -= tag in ("article", "main")
        state["link"] -= tag == "a"

    def close(tag: str, stops: frozenset[str]) -> None:
        if not names.get(tag):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in stops:
                return

    at = 0
    for begin, end, closes, tag, attributes in _pieces(page):
        if begin > at:
            piece = page[at:begin]
            text.append(piece)
            if state["link"]:
                state["linked"] += len(piece.strip())
        at = end
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if closes:
            close(tag, frozenset())
            continue
        if tag in _CLOSES_P:
            close("p", _SCOPES)
        for other in _LIST_ITEMS.get(tag, ()):
            close(other, frozenset(("ul", "ol", "dl", "table")))
        skips = _boilerplate(tag, attributes, state["article"] > 0)
        if tag in ("article", "main") and state["skip"] and not skips and not state["comments"]:
            # Boilerplate left open before the article does not hold it.
            while state["skip"]:
                pop()
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, skips))
            names[tag] = names.get(tag, 0) + 1
            state["skip"] += skips > 0
            state["comments"] += skips > 1
            state["article"] += tag in ("article", "main")
            state["link"] += tag == "a"
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def main_text(page: str | None, window: int = 3, sentence: int = 60) -> str:
    lines = lines_of(page or "")
    marked = any(a and not b for _, _, b, a in lines)
    length = [0 if b or marked and not a else (len(t) if marked else n * (5 * n >= len(t))) for t, n, b, a in lines]
    total = [0]
    for n in length:
        total.append(total[-1] + n)
    windows = [total[min(len(lines), i + window)] - total[i] for i in range(len(lines))]
    threshold = 0 if marked or max(windows, default=0) <= sentence else sentence
    # Surge: the first window that exceeds the threshold; dive: the end of the last one.
    over = [i for i, n in enumerate(windows) if n > threshold and length[i]]
    if not over:
        return ""
    return "\n".join(lines[i][0] for i in range(over[0], min(len(lines), over[-1] + window)) if length[i])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            texts = [main_text(h) for h in C.column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages; null, empty or textless html gives an empty text."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
