"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. A block is described by its word count and link density and those of
its two neighbours; the tree that is grown on the small labelled table in html_labels.py asks for these first. Where
they leave doubt (an advert of ten words, a reader's long comment), it asks what the enclosing elements say.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bounded
from tesserae.llm.html_labels import LABELLED_PAGES

# Names of elements, by what they mean for a text block.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("script style noscript template iframe object svg canvas textarea title head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSE_P = BLOCKS - {"br", "button", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BAD_ELEMENTS = frozenset("nav header footer aside form button select menu dialog fieldset label option".split())
GOOD_ELEMENTS = frozenset("article main".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|sidebar\w*|aside|widget\w*|related\w*|recommend\w*|share|sharing|social\w*"
    r"|comment\w*|respond|responses?|reply|replies|disqus\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|newsletter\w*|subscribe\w*|signup|login|pagination|pager|byline|copyright|disclaimer|skip\w*|toolbar|hidden)(?=$|[\s_-])"
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")

NUMBERS = ("words", "links", "before_words", "before_links", "after_words", "after_links")
FEATURES = (*NUMBERS, "furniture", "named", "article", "heading")


# Elements whose meaning is remembered: so many, with attributes of so many characters at most.
REMEMBERED, SHORT = 16_384, 400


def _meaning(name: str, attributes: str) -> tuple[int, int, int, bool]:
    """Whether an element is furniture by kind or role, by class or id, or an article; and whether it is shown."""
    furniture, named, article, shown = int(name in BAD_ELEMENTS), 0, int(name in GOOD_ELEMENTS), name not in UNSEEN
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            named |= int(bool(BAD_NAMES.search(value)))
        elif key == "role":
            furniture |= int(value in BAD_ROLES)
            article |= int(value in ("main", "article"))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            shown = False
    return furniture, named, article, shown


_remembered = lru_cache(REMEMBERED)(_meaning)

# Of a block: its text, its words, its words in links, and whether an enclosing element is furniture by kind, by name,
# an article, a heading.
Block = tuple[str, int, int, int, int, int, int]
INLINE = frozenset("b i em strong span font a u".split())
SECTIONS = frozenset("article footer aside nav main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks(page: str) -> list[Block]:
    """In page order; only blocks with text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int, bool]] = []  # name; sums over what encloses; shown
    opened: Counter[str] = Counter()  # names in the stack
    parts: list[str] = []
    linked: list[str] = []

    def end() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, furniture, named, article, heading, _ = stack[-1] if stack else ("", 0, 0, 0, 0, True)
                out.append((text, len(text.split()), len(html.unescape("".join(linked)).split()), min(furniture, 1), min(named, 1), min(article, 1), min(heading, 1)))
            parts.clear()
            linked.clear()

    def leave(name: str) -> None:
        """Closes the innermost element of this name and what is open in it."""
        if not opened[name]:
            return
        at = len(stack) - 1
        while stack[at][0] != name:
            at -= 1
        if any(x[0] in BLOCKS for x in stack[at:]):
            end()
        for x in stack[at:]:
            opened[x[0]] -= 1
        del stack[at:]

    at = 0
    while token := TOKEN.match(page, at):
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if text[:2] in ("<!", "<?") or stack and not stack[-1][5]:
                continue
            parts.append(text)
            if opened["a"]:
                linked.append(text)
            continue
        name = name.lower()
        if token[1]:
            leave(name)
            if name in BLOCKS:
                end()
            continue
        if name in BLOCKS:
            end()
        if name in CLOSE_P and opened["p"]:
            leave("p")
        if name in SAME and stack and stack[-1][0] in SAME[name]:
            leave(stack[-1][0])
        if name in SECTIONS:
            while stack and stack[-1][0] in INLINE:
                leave(stack[-1][0])  # inline elements left open end with the block they are in
        if name in RAW:  # its content is no markup
            found = RAW_END[name].search(page, at)
            at = found.start() if found else len(page)
        if name in VOID or token[0].endswith("/>"):
            continue
        _, furniture, named, article, heading, shown = stack[-1] if stack else ("", 0, 0, 0, 0, True)
        attributes = token[3].strip()
        more = (_remembered if len(attributes) <= SHORT else _meaning)(name, attributes)
        stack.append((name, furniture + more[0], named + more[1], article + more[2], heading + (name in HEADINGS), shown and more[3]))
        opened[name] += 1
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block, columns as FEATURES."""
    x = np.array([(b[1], b[2] / max(1, b[1]), *b[3:]) for b in found], np.float64).reshape(-1, 6)
    edge = np.zeros((1, 2))
    return np.hstack([x[:, :2], np.vstack([edge, x[:-1, :2]])[: len(x)], np.vstack([x[1:, :2], edge])[: len(x)], x[:, 2:]])


# What the tree may ask for, in this order: columns, levels, and how many labelled blocks a side must have. Numbers come
# first; what encloses a block is asked where they leave doubt; where that says nothing either, numbers again.
STAGES = ((range(len(NUMBERS)), 2, 60), (range(len(NUMBERS), len(FEATURES)), 4, 1), (range(len(NUMBERS)), 3, 10))


def grow(x: np.ndarray, y: np.ndarray, stage: int = 0, level: int = 0) -> tuple:
    """A binary decision tree by Gini impurity: (label,) or (feature, threshold, low, high)."""
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0) or stage == len(STAGES):
        return (bool(share >= 0.5),)
    columns, levels, least = STAGES[stage]
    best = _cut(x, y, columns, least) if level < levels else None
    if best is None:
        return grow(x, y, stage + 1)
    f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], stage, level + 1), grow(x[~low], y[~low], stage, level + 1)


def _cut(x: np.ndarray, y: np.ndarray, columns: range, least: int) -> tuple[int, float] | None:
    """The feature and threshold that part labels best, with so many blocks at least on either side."""
    share = y.mean()
    most, best = 1e-9, None
    for f in columns:
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if least <= n <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                gain = share * (1 - share) * len(y) - p * (1 - p) * n - q * (1 - q) * (len(y) - n)
                if gain > most + 1e-12:
                    most, best = gain, (f, float(cut))
    return best


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[low] = decide(tree[2], x[low])
    out[~low] = decide(tree[3], x[~low])
    return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The blocks of the labelled pages: a block is article text if it starts with the page's mark."""
    xs, ys = [], []
    for page in LABELLED_PAGES:
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([b[0].startswith("+") for b in found]))
    return np.vstack(xs), np.concatenate(ys)


@cache
def tree() -> tuple:
    return grow(*labelled())


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = decide(tree(), features(found))
    return "\n".join(b[0] for b, k in zip(found, keep.tolist(), strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (article blocks joined by one line break), n_chars: one row for each row of pages.

    Null and empty pages, and pages without article text, give an empty text. Null ids and urls pass through;
    repeated rows give a row each; other columns are not read; no rows give no rows.
    """
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
