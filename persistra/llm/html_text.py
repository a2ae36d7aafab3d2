"""Main text of web pages by tag-path ratios.

A page is read into blocks: stretches of text between block-level tags, each
with its path of tags and classes from the root.  Over each path the text
length and the punctuation are summed and divided by the number of its blocks;
the two ratios are smoothed along the page, fused (multiplied), and paths at
or over a share of the best one are content paths.  The content node is the
innermost article or main element, or else the innermost element, that holds
nearly all text of content paths; its blocks, headings and short paragraphs
included, are the text, and with them the blocks outside it on content paths
that reach the share by their own ratios, not by their neighbours', and the
headings on content paths right before such a block.

What a page says it is not is no content to begin with: scripts, styles,
pictures in markup, navigation, headers and footers of the page, sidebars,
forms, hidden elements, and elements whose class, id or role names an advert,
notice, menu, share bar or reader comments.  Words that content bears as well
(``social``, ``related``, ``form`` and the like) only raise a doubt, which the
ratios settle: a block in such an element is content where its path's own ratio
reaches the share of the best path.

Character references are decoded; white space of any kind inside a block is one
space; blocks are joined by an empty line; nothing else is dropped.

Defined cases.  Null or empty html, or a page without text: empty text.
Unclosed and crossing tags: an end tag closes the innermost element of its
name and all inside it, and is ignored without one; a block tag closes an open
paragraph.  Equal ratios: the innermost, then the heavier element.  Pages of
any length and depth are read whole, in time that grows with both together, not
with their product.  Repeated rows give equal results.  An empty table gives an
empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from persistra.llm.base import lean

#: a content path's fused ratio, at least, as a share of the best; of text, the share that its node must hold
THRESHOLD, HELD = 0.1, 0.9

# fixed values: kinds of elements
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "search", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NO_CONTENT = {"head", "nav", "menu", "footer", "aside", "form", "dialog", "button", "search", "fieldset", "label", "option", "input", *RAW}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"table", "ul", "ol", "dl", "td", "th", "article", "section", "main", "body", "html", "blockquote", "aside", "nav", "footer", "header", "form", "div"}
NOT_CONTENT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsored|nav\w*|menu\w*|sidebar\w*|side-bar|footer|masthead|site-header|page-header|topbar|breadcrumbs?"
    r"|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|comments?|disqus|respond|replies"
    r"|pagination|pager|toolbar|skip-link)(?:$|[\s_-])",
    re.I,
)
#: words that content bears too
DOUBTFUL_WORDS = re.compile(
    r"(?:^|[\s_-])(?:sponsor\w*|promo\w*|banner|aside|notification|alert|social|related|recommend\w*|widget\w*|form)(?:$|[\s_-])",
    re.I,
)
NOT_CONTENT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note"}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")
_SPACE = re.compile(r"[\s\u200b\u2060\ufeff]+")


class Element:
    """``order`` numbers the elements of a page as they open; ``path`` numbers the paths of its block-level tags."""

    __slots__ = ("article", "attrs", "block", "doubt", "order", "out", "parent", "path", "scope", "tag")

    def __init__(self, tag: str, parent: "Element | None", attrs: dict[str, str], order: int, paths: dict):
        self.tag, self.parent, self.attrs, self.order = tag, parent, attrs, order
        named = tag in ("article", "main")
        self.article = named or (parent is not None and parent.article)
        self.out, self.doubt = _no_content(tag, attrs, parent) if parent else (False, False)
        self.block = self if tag in BLOCKS or parent is None else parent.block
        #: the innermost element that ends the search for an open paragraph
        self.scope = self if tag == "p" or tag in SCOPES or parent is None else parent.scope
        if self.block is self:
            self.path = paths.setdefault((parent.path if parent else -1, tag, attrs.get("class", "")), len(paths))
        else:
            self.path = parent.path

    def above(self):
        e = self
        while e is not None:
            yield e
            e = e.parent


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\n\r") else {}


def _no_content(tag: str, attrs: dict[str, str], parent: Element) -> tuple[bool, bool]:
    """Whether an element is no content, and whether that is in doubt."""
    if parent.out or tag in NO_CONTENT or (tag == "header" and not parent.article):
        return True, False
    if not attrs:
        return False, parent.doubt
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True, False
    if attrs.get("role", "").lower() in NOT_CONTENT_ROLES:
        return True, False
    if tag in ("html", "body", "article", "main"):
        return False, parent.doubt
    names = (attrs.get("class", ""), attrs.get("id", ""))
    return any(map(NOT_CONTENT_WORDS.search, names)), parent.doubt or any(map(DOUBTFUL_WORDS.search, names))


def blocks_of(page: str) -> list[tuple[Element, str]]:
    """(innermost block-level element, text) of every block with text, in page order."""
    paths: dict[tuple[int, str, str], int] = {}
    root = top = Element("html", None, {}, 0, paths)
    opened, is_open = 1, Counter()
    found: list[tuple[Element, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ")
            held.clear()
            if text:
                found.append((top.block, text))

    def close(e: Element) -> None:
        nonlocal top
        # the innermost block-level element is the first to close, if any is
        if top.block.order >= e.order:
            flush()
        while top is not e:
            is_open[top.tag] -= 1
            top = top.parent
        is_open[e.tag] -= 1
        top = e.parent

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and not top.out:
            held.append(page[at : m.start()])
        at = m.end()
        end, tag, raw = m[1] if m[2] else m[4], m[2] or m[5], m[3] if m[2] else m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                held.append(" ")
            else:
                if is_open[tag] > 0:
                    close(next(x for x in top.above() if x.tag == tag))
                elif tag == "p":
                    flush()
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "svg" and raw.endswith("/"):
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            stop = page.find(">", stop.start() if stop else len(page))
            at = len(page) if stop < 0 else stop + 1
            continue
        if raw.endswith("/") and tag not in BLOCKS:
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            if top.scope.tag == "p":
                close(top.scope)
            flush()
            for name in CLOSES.get(tag, ()):
                e = next((x for x in top.above() if x.tag == name or (x.tag in SCOPES and x.tag not in CLOSES.get(tag, ()))), None)
                if e is not None and e.tag == name and e is not root:
                    close(e)
        if tag == "body":
            top = root
            is_open.clear()
        inner = Element(tag, top, _attributes(raw), opened, paths)
        if inner.out and not top.out and tag not in BLOCKS:
            held.append(" ")
        top, opened = inner, opened + 1
        is_open[tag] += 1
    if at < len(page) and not top.out:
        held.append(page[at:])
    flush()
    return found


def _smooth(x: list[float]) -> list[float]:
    return [sum(w * x[j] for j, w in ((i - 1, 0.25), (i, 0.5), (i + 1, 0.25)) if 0 <= j < len(x)) for i in range(len(x))]


def path_ratios(found: list[tuple[Element, str]]) -> tuple[dict[int, float], dict[int, float]]:
    """Fused ratio of every path: the greatest of its blocks' smoothed ones, and its own alone.

    A path's text and punctuation are summed and divided by its blocks; both
    are smoothed along the page's blocks, and fused as length * (1 + marks)."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, text in found:
        length[e.path] += len(text)
        marks[e.path] += len(_PUNCTUATION.findall(text))
        count[e.path] += 1
    own = {path: length[path] / n * (1 + marks[path] / n) for path, n in count.items()}
    fused = defaultdict(float)
    text_ratio = _smooth([length[e.path] / count[e.path] for e, _ in found])
    mark_ratio = _smooth([marks[e.path] / count[e.path] for e, _ in found])
    for (e, _), t, p in zip(found, text_ratio, mark_ratio):
        fused[e.path] = max(fused[e.path], t * (1 + p))
    return dict(fused), own


def content(found: list[tuple[Element, str]], threshold: float = THRESHOLD) -> list[str]:
    """Texts of the content node's blocks and of what else is content, in page order."""
    if not found:
        return []
    fused, alone = path_ratios(found)
    best = max(fused.values())
    chosen = {path for path, score in fused.items() if score >= threshold * best}
    # smoothing lifts a short block beside the content as well; outside the node, and in doubt, a path must do without
    own = {path for path in chosen if alone[path] >= threshold * best}
    found = [(e, text) for e, text in found if not e.doubt or e.path in own]
    # every element that holds a block, outermost first: weight, depth, and the last element inside it
    held: dict[int, Element] = {}
    for e, _ in found:
        for x in e.above():
            if x.order in held:
                break
            held[x.order] = x
    order = sorted(held)
    depth, weight, last = {}, dict.fromkeys(order, 0), {i: i for i in order}
    for i in order:
        depth[i] = depth[held[i].parent.order] + 1 if held[i].parent else 0
    for e, text in found:
        if e.path in chosen:
            weight[e.order] += len(text)
    for i in reversed(order):
        if (up := held[i].parent) is not None:
            weight[up.order] += weight[i]
            last[up.order] = max(last[up.order], last[i])
    total = weight[order[0]] if order else 0
    heavy = [i for i in order if total and weight[i] >= HELD * total]
    # an article says itself what belongs to it; several articles belong to what holds them
    pool = [i for i in heavy if held[i].tag in ("article", "main") or held[i].attrs.get("role", "").lower() in ("main", "article")]
    pool = pool or [i for i in heavy if held[i].tag not in ("p", "li")] or order
    node = max(pool, key=lambda i: (depth[i], weight[i])) if pool else 0
    texts, follows = [], False
    for e, text in reversed(found):
        inside = bool(pool) and node <= e.order <= last[node]
        follows = e.path in own or inside or (follows and e.tag in HEADINGS and e.path in chosen)
        if follows:
            texts.append(text)
    return texts[::-1]


def main_text(page: str | None) -> str:
    return "\n\n".join(content(blocks_of(page))) if page else ""


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        held = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, held), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*held, "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ids, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return lean(pages).select("page_id", "url", "html").mapInArrow(_extract, f"page_id {ids}, url {url}, text string, n_chars long")
