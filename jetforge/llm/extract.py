"""Main text of HTML pages by the maximum-scoring contiguous region.

A page is a run of tokens. Words score positive and tags negative; one linear scan finds the
region with the greatest sum. The weights are log-likelihood ratios of words (by the block they
stand in) and tags inside and outside the article, counted on pages whose markup names it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

SAMPLE_PAGES = 5_000  # about so many labelled pages are counted for the weights
MIN_SEEN = 20  # tokens of a kind from which its own weight holds
WORD_DEFAULT, TAG_DEFAULT, INLINE_DEFAULT = 1.0, -1.0, -0.25  # of kinds not seen
WORD_LEAST, WORD_MOST, TAG_COST, TAG_MOST = 0.25, 3.0, -0.5, -4.0
LIST_MOST = -0.1  # a tag of a list or a table: a list of single words must not end a text

# HTML elements by role, and name parts by which sites mark what is no article.
UNSEEN = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "select", "textarea", "button")
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
ASIDE_NAMES = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent",
               "disqus", "footer", "header", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup",
               "promo", "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")
NEVER_ASIDE = ("html", "body", "main", "article")
# Words that, behind one of ASIDE_NAMES, say no more than that it is a box of the page.
FURNITURE = ("area", "articles", "bar", "block", "box", "button", "buttons", "container", "content", "form", "icon", "icons", "inner", "items", "links",
             "list", "outer", "panel", "posts", "section", "slot", "stories", "thread", "wrap", "wrapper")
NO_PARAGRAPHS = ("ad", "ads", "advert", "advertisement", "consent", "cookie", "cookies", "newsletter", "notice", "promo", "promoted", "sponsored", "subscribe")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")
# An element ends the open one of its kind up to the next outer element of the scope.
ENDS = {"td": ("cell", "table"), "th": ("cell", "table"), "tr": ("row", "table"), "tbody": ("row", "table"), "thead": ("row", "table"),
        "tfoot": ("row", "table"), "li": ("item", "ul ol menu"), "dt": ("term", "dl"), "dd": ("term", "dl"), "option": ("option", "select")}
OPENS = {"td": "cell", "th": "cell", "tr": "row", "li": "item", "dt": "term", "dd": "term", "option": "option"}
SCOPES = {"table": ("cell", "row"), "ul": ("item",), "ol": ("item",), "menu": ("item",), "dl": ("term",), "select": ("option",)}
TELLS = ("has", "have", "is", "no", "non", "not", "show", "with", "without", "hide")

_REST = r"|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)"
_NAME_OF = r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(_NAME_OF + r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)" + _REST, re.S)
_LOOSE_TOKEN = re.compile(_NAME_OF + r"(?P<attrs>[^>]*+)(?:>|\Z)" + _REST, re.S)  # after a quotation mark that nothing closes
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in UNSEEN if n != "head"}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?\s*([^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"[ \t-\r]+")
_NAME = re.compile(r"[^ \t-\r]+")


def _marks(name: str) -> bool:
    """Whether a class, id or role names what is no article. What follows a word of TELLS says that
    the element has or lacks such a part, not that it is one."""
    for part in _PARTS.split(name):
        if part in TELLS:
            return False
        if part in ASIDE_NAMES:
            return True
    return False


def _box(name: str) -> bool:
    """Whether a class, id or role as a whole names what is no article: inside an article a part of
    a name says little (a share price, related work)."""
    parts = [p for p in _PARTS.split(name) if p]
    return bool(parts) and parts[0] in ASIDE_NAMES and all(p in ASIDE_NAMES or p in FURNITURE for p in parts)


def _aside(name: str, attrs: str, inside: bool, headed: bool) -> bool:
    """inside: in an article. headed: the element has a heading in it."""
    if name in NEVER_ASIDE or inside and name in HEADINGS:
        return False
    if name in ASIDE:
        return not (name == "header" and inside and headed)
    named = {n for m in _NAMED.finditer(attrs) for n in _NAME.findall("".join(filter(None, m.groups())).lower())}
    if inside and name == "p":
        return not named.isdisjoint(NO_PARAGRAPHS)
    return any(_box(n) if inside else _marks(n) for n in named)


class _Open:
    """An open element. What depends on the elements around it is carried along, so that no token
    looks through the stack."""

    __slots__ = ("name", "own", "up", "aside", "article", "unseen", "link", "main", "block", "number", "words", "scopes")

    def __init__(self, name: str, kind: str, outer: _Open | None, own: bool, article: bool, number: int, place: int, words: int):
        self.name, self.own, self.number, self.words = name, own, number, words
        self.up = (outer if outer.own else outer.up) if outer else None  # the nearest element around it that is set aside
        self.aside = own or self.up is not None
        self.article = article or bool(outer) and outer.article
        self.unseen = name in UNSEEN or bool(outer) and outer.unseen
        self.link = name == "a" or bool(outer) and outer.link
        self.main = name == "main" or bool(outer) and outer.main
        self.block = kind if name not in INLINE else outer.block if outer else ""
        # Of each kind that a later element may end: the place of the open one on the stack.
        self.scopes = outer.scopes if outer else {}
        if name in SCOPES:
            self.scopes = {k: v for k, v in self.scopes.items() if k not in SCOPES[name]}
        elif name in OPENS:
            self.scopes = self.scopes | {OPENS[name]: place}
            if name == "tr":
                self.scopes.pop("cell", None)


def tokens(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """(token, kind, text, aside, article): ``tag`` tokens, ``break`` at block boundaries, and
    ``text`` with the kind of block it stands in. aside: within something that is no article by its
    markup; article: within an article element. Around main and around the article with the most
    words (in main, if there is one) nothing is aside, whatever its name."""
    out, around = _tokens(page, frozenset())
    return _tokens(page, around)[0] if around else out


def _headers(page: str):
    """Whether the header that starts at a place has a heading before it ends."""
    if "<header" not in page.lower():
        return lambda at: False
    heads = [m.start() for m in re.finditer(r"<h[1-6][\s>]", page, re.I)]
    ends = [m.start() for m in re.finditer(r"</header", page, re.I)]

    def headed(at: int) -> bool:
        k, e = bisect_left(heads, at), bisect_left(ends, at)
        return k < len(heads) and (e == len(ends) or heads[k] < ends[e])

    return headed


def _tokens(page: str, kept: frozenset[int]) -> tuple[list[tuple[str, str, str, bool, bool]], frozenset[int]]:
    """Tokens with the elements of the numbers ``kept`` not aside, and the numbers of the elements
    that are, but hold a main or the longest article. The time follows the length of the page."""
    out, stack, at, number, words, token = [], [], 0, 0, 0, _TOKEN
    mains, articles, has_main, headed, names = set(), [], False, _headers(page), Counter()

    def chain(e: _Open | None, into: set[int]) -> set[int]:
        while e is not None and e.number not in into:
            into.add(e.number)
            e = e.up
        return into

    def close(place: int) -> None:
        while len(stack) > place:
            e = stack.pop()
            names[e.name] -= 1
            e.words = words - e.words

    while at < len(page):
        m = token.match(page, at)
        if token is _TOKEN and m["text"] == "<" and _LOOSE_TOKEN.match(page, at)["name"]:
            token = _LOOSE_TOKEN
            continue
        at = m.end()
        name = (m["name"] or "").lower()
        top = stack[-1] if stack else None
        if name:
            attrs = m["attrs"] or ""
            if name in _RAW_END and not m["close"]:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                out.append(("tag", name, "", True, False))
                continue
            named = _CLASS.search(attrs)
            kind = f"{name}.{named[1].lower()}" if named else name
            inside = bool(top) and top.article
            number += 1
            own = not m["close"] and number not in kept and _aside(name, attrs, inside, name == "header" and headed(at))
            out.append(("tag", kind if not m["close"] else f"/{name}", "", own or bool(top) and top.aside, inside))
            if name not in INLINE:
                out.append(("break", "", "", False, inside))
            if m["close"]:
                if names[name] > 0:
                    place = len(stack) - 1
                    while stack[place].name != name:
                        place -= 1
                    close(place)
            elif name not in VOID and not attrs.endswith("/"):
                if name not in INLINE:
                    if stack and stack[-1].name == "p":
                        close(len(stack) - 1)
                    if name in ENDS and stack and ENDS[name][0] in stack[-1].scopes:
                        close(stack[-1].scopes[ENDS[name][0]])
                article = name in ("article", "main")
                if article and stack and stack[-1].name in ("nav", "header"):
                    close(len(stack) - 1)  # left open by mistake
                top = stack[-1] if stack else None
                around = (top if top.own else top.up) if top and article else None
                entry = _Open(name, kind, top, own, article and around is None, number, len(stack), words)
                stack.append(entry)
                names[name] += 1
                if name == "main":
                    chain(around, mains)
                    has_main = True
                elif name == "article":
                    articles.append((entry, around, bool(top) and top.main))
        elif m["text"] is not None:
            if _SPACE.sub("", m["text"]) == "":
                out.append(("text", "", m["text"], True, False))
                continue
            block = (top.block if top else "") + (">a" if top and top.link else "")
            out.append(("text", block, m["text"], bool(top) and (top.aside or top.unseen), bool(top) and top.article))
            if not (top and top.unseen):
                words += _words(m["text"])
    close(0)
    longest = max((x for x in articles if x[2] or not has_main), key=lambda x: x[0].words, default=None)
    return out, frozenset(mains | (chain(longest[1], set()) if longest else set()))


def _words(text: str) -> int:
    return len(_SPACE.sub(" ", text).split())


def count_kinds(page: str) -> Counter:
    """Tokens of each kind in and outside the article of a page, but for those set aside by the
    markup, which have no score; nothing for pages without an article."""
    found, counts = tokens(page), Counter()
    if not any(t[4] for t in found):
        return counts
    for token, kind, text, aside, inside in found:
        if aside:
            continue
        if token == "tag":
            counts["tag", kind, inside] += 1
        elif token == "text" and kind:
            counts["word", kind, inside] += _words(text)
    return counts


def weights_of(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Weight of each kind seen often enough: words WORD_LEAST to WORD_MOST, tags TAG_MOST to TAG_COST.
    Where hardly a word stands outside articles, words get near WORD_MOST."""
    total = Counter()
    for (token, _, inside), n in counts.items():
        total[token, inside] += n
    out = {}
    for token, kind in {k[:2] for k in counts}:
        a, b = counts.get((token, kind, True), 0), counts.get((token, kind, False), 0)
        if a + b < MIN_SEEN:
            continue
        inside, outside = (a + 1) / (total[token, True] + 2), (b + 1) / (total[token, False] + 2)
        if token == "word":
            outside = (b + MIN_SEEN * inside * math.exp(-WORD_MOST)) / (total[token, False] + MIN_SEEN)
        ratio = math.log(inside / outside)
        out[token, kind] = min(max(ratio, WORD_LEAST), WORD_MOST) if token == "word" else max(min(ratio, 0.0) + TAG_COST, _least(kind))
    return out


def _least(kind: str) -> float:
    return LIST_MOST if kind.lstrip("/").split(".")[0] in LISTS else TAG_MOST


def _tag_weight(kind: str, weights: dict[tuple[str, str], float]) -> float:
    default = INLINE_DEFAULT if kind.lstrip("/").split(".")[0] in INLINE else TAG_DEFAULT
    return weights.get(("tag", kind), max(default, _least(kind)))


def main_text(page: str, weights: dict[tuple[str, str], float]) -> str:
    """Text of the best region: one linear scan for the greatest sum, then all blocks inside it,
    whatever their weight. What the markup itself sets aside (navigation, forms, adverts, comments) scores nothing and is
    left out. Tags inside an article that the markup names cost nothing, so that nothing in it can end the region."""
    found = tokens(page)
    scores = []
    for token, kind, text, aside, inside in found:
        if aside or token == "break":
            scores.append(0.0)
        elif token == "text":
            scores.append(weights.get(("word", kind), WORD_DEFAULT) * _words(text))
        else:
            scores.append(0.0 if inside else _tag_weight(kind, weights))
    best, start, stop, total, begin = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best or total == best and s > 0:
            best, start, stop = total, begin, i + 1
    blocks, now = [], []
    for token, kind, text, aside, _ in found[start:stop]:
        if token == "break":
            blocks.append("".join(now))
            now = []
        elif token == "text" and (not aside or text.isspace()):
            now.append(text)
    blocks.append("".join(now))
    clean = (_SPACE.sub(" ", html.unescape(b)).strip(" ") for b in blocks)
    return "\n".join(b for b in clean if b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for batch in batches:
        for page in batch.column(0):
            counts.update(count_kinds(page.as_py() or ""))
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()),
         pa.array([counts[k] for k in keys], pa.int64())], names=["token", "kind", "inside", "n"])


def fit_weights(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[tuple[str, str], float]:
    """Weights from about ``sample_pages`` pages that name their article, chosen by the digest of
    the page. What reaches the driver are kinds seen MIN_SEEN times in that sample."""
    labelled = pages.select(quoted(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = labelled.count()
    share = min(1.0, sample_pages / n) if n else 0.0
    part = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(share * 1_000_000))
    sums = part.mapInArrow(_count, "token string, kind string, inside boolean, n long").groupBy("token", "kind", "inside").agg(F.sum("n").alias("n"))
    return weights_of({(r[0], r[1], r[2]): r[3] for r in sums.collect()})


def extract_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: id columns, text and n_chars (code points).

    Blocks of the best region are joined by line feeds; character references are decoded, white
    space is one space. Null and empty pages and pages without words have an empty text. Pages
    without labels anywhere get the default weights. Repeated rows are rows of their own; an empty
    table gives none. Every page is read where it lies, without a shuffle.
    """
    weights = fit_weights(pages, html_col, sample_pages)
    thin = pages.select(*[quoted(c).alias(f"_id{i}") for i, c in enumerate(id_cols)], quoted(html_col).alias("_html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", weights) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*batch.schema.names[:-1], "text", "n_chars"])

    out = thin.mapInArrow(run, f"{fields}, text string, n_chars long")
    return out.select(*[F.col(f"_id{i}").alias(c) for i, c in enumerate(id_cols)], "text", "n_chars")
