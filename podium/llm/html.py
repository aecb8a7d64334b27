"""Main text of web pages: flat text blocks with the word counts and link densities of their neighbours, classified by a
decision tree that is trained on the small labelled table below."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import slices

#: Labelled pages: a line for each, a block after another in page order as words/words in links and + (main text) or -.
#: [ and ] stand around what lies in an article or main element. Containers that name themselves navigation, advert or the
#: like are left out here: their blocks are never main text, but count as neighbours.
LABELLED = """
1/1- 1/1- 1/1- 5/0+ 60/0+ 80/2+ 45/0+ 8/0-
2/2- 2/2- 3/3- 6/0+ 3/0+ 90/0+ 70/4+ 30/0+ 6/2-
1/1- 2/2- 1/1- 40/0+ 35/0+ 18/0+ 12/0+
2/2- 3/3- 80/0+ 40/0+ 30/1+ 18/0+
4/4- 2/2- 1/1- 7/0+ 120/0+ 9/0+ 100/3+ 20/0+ 3/3- 2/2- 2/2-
3/3- 4/0+ 25/0+ 60/5+ 3/0+ 44/0+ 5/0+ 38/0+ 10/8- 12/11-
1/1- 1/1- 9/0- 5/0+ 70/0+ 66/0+ 22/0+ 7/0-
12/10- 8/0+ 200/10+ 150/0+ 90/2+ 14/12-
2/2- 2/2- 2/2- 2/2- 2/2- 2/2- 3/0- 2/2- 2/2-
6/6- 7/7- 5/5- 8/8- 6/6- 2/0- 9/9- 7/7-
1/0- 2/0- 1/0- 3/0- 4/4- 5/0- 2/2-
55/0+ 40/0+ 65/3+
150/0+
30/0+ 6/0+ 9/0+ 7/0+ 11/0+ 34/0+
5/0+ 28/0+ 16/1+ 40/2+ 15/0+ 21/0+ 4/4- 3/3- 4/4- 3/3-
3/3- 3/3- 6/0+ 50/0+ 1/0+ 60/0+ 2/0+ 45/0+ 9/0- 2/2-
2/1- 4/2- 10/0+ 75/1+ 80/0+ 35/0+ 4/2- 6/3-
1/1- 7/0- 6/0+ 48/0+ 52/0+ 3/0+ 5/1-
8/0+ 90/6+ 85/0+ 7/7- 6/6- 8/8- 5/5- 4/0-
4/0+ 12/0+ 33/0+ 14/0+ 41/2+ 13/0+ 8/6-
20/18- 15/14- 9/0+ 64/0+ 20/1+ 58/2+ 24/20-
2/2- 5/0+ 36/8+ 42/9+ 50/12+ 3/3- 3/3-
1/1- 1/1- 4/0+ 17/0+ 19/0+ 23/0+ 26/0+ 2/0-
2/2- 2/2- [ 5/0+ 60/0+ 3/0+ 80/1+ ] 8/0-
1/1- 1/1- 1/1- 10/0- [ 4/0+ 3/0+ ] 9/0-
3/3- [ 1/0+ 2/0+ 90/3+ 1/0+ 1/0+ ] 7/1-
2/2- 1/1- [ 6/0+ 70/0+ 4/4+ 65/2+ 2/0+ 5/0+ ] 2/2- 2/2- 11/0-
[ 40/0+ 2/2- 2/2- 3/3- 2/2- 55/0+ ] 6/0-
[ 3/0+ 12/6+ 9/0+ 1/1+ 60/0+ 8/3+ ] 4/4-
1/1- [ 7/0+ ] 8/0-
2/2- [ 5/0+ 33/0+ 3/3- 4/4- 3/3- ] 5/5- 12/0-
[ 2/0+ 1/0+ 6/0+ 3/0+ 4/0+ 2/0+ ] 9/1-
3/3- 2/2- [ 1/0+ 30/30+ 50/1+ 2/0+ ] 10/0-
2/2- 60/0+ 80/0+ 35/1+
3/3- 90/2+ 40/0+ 9/0-
4/4- 50/0+ 30/0+ 3/3-
5/5- 70/1+ 65/0+ 2/2- 60/0+
[ 5/0+ 60/0+ 3/0+ ]
2/2- [ 4/0+ 70/1+ 2/0+ ]
[ 6/0+ 8/0+ ]
1/1- 2/2- [ 3/0+ 40/0+ 9/0+ 6/0+ ]
3/3- [ 5/0+ 80/2+ 1/0+ 4/0+ ]
"""

#: A comment, a tag that ends at the first > outside quotes, a tag that ends at the first >, a declaration.
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED_END = re.compile(r"[^'\">]*+(?:\"[^\"]*+\"[^'\">]*+|'[^']*+'[^'\">]*+)*+>")
_HIDDEN = frozenset("script style noscript template iframe textarea select button option title head".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for x in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NESTED = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figure footer form header hgroup main menu nav ol section table ul".split())
_NOISE = frozenset("nav footer aside form menu dialog".split())
_NAMED = frozenset(("class", "id", "role", "aria-label"))
#: Names of what is no main text, and words that may stand beside one of them in a name: sidebar-left, ad_box, siteFooter.
_HINTS = re.compile(
    r"(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|footer|masthead|cookies?|"
    r"consent|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|replies|disqus|widget\w*|toolbar|"
    r"pagination|pager|login|signup|search|contentinfo|complementary)"
)
_BESIDE = re.compile(
    r"(?:left|right|top|bottom|main|site|page|global|primary|secondary|inner|outer|box|bar|area|block|section|container|wrapper|wrap|panel|region|"
    r"list|items?|links?|unit|slot|form|buttons?|icons?|thread|user|reader|post|article|\d+)?"
)
_COMMENTS = re.compile(r"comments?|replies|disqus")
_PART = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_]+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def _hint(name: str) -> int:
    """Whether a whole name is a hint (2: of comments): one part at least, with nothing but words of place and form beside it."""
    parts = [x.lower() for x in _PART.split(name)]
    hints = [bool(_HINTS.fullmatch(x)) for x in parts]
    if not any(hints) or not all(h or _BESIDE.fullmatch(x) for h, x in zip(hints, parts, strict=True)):
        return 0
    return 2 if any(map(_COMMENTS.fullmatch, parts)) else 1


def _meaning(attributes: str) -> tuple[bool, int]:
    """Whether attributes hide the element, and whether they name it as something else than main text (2: as comments)."""
    hidden, named = False, 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        hidden |= name == "hidden" or (name == "aria-hidden" and value.strip().lower().startswith("true")) or (name == "style" and bool(_NO_DISPLAY.search(value)))
        if name in _NAMED:
            named = max(named, *map(_hint, value.split()), 0)
    return hidden, named


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag, and of comments and declarations with an empty name; send() moves
    on to a place. Each character is looked at a bounded number of times, whatever the page."""
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end, found = _COMMENT.match(page, start).end(), None  # type: ignore[union-attr]
        elif start > last:
            return
        elif page[start + 1 : start + 2] in ("!", "?"):
            end, found = page.index(">", start) + 1, None
        else:
            found = _NAME.match(page, start)
            if not found:
                at = start + 1
                continue
            whole = _QUOTED_END.match(page, found.end()) if quotes else None
            quotes = quotes and whole is not None  # no > outside quotes up to the end of the page: don't look again
            end = whole.end() if whole else page.find(">", found.end()) + 1
            if not end:
                return
        at = (yield (start, end, bool(found[1]), found[2].lower(), page[found.end() : end - 1]) if found else (start, end, False, "", "")) or end


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, noise, main) of each block with a word, in page order.

    A block is what stands between two block-level tags; white space in it is one space. Contents of scripts, styles and
    form fields are no text. A container that is never closed ends with the one around it.

    A container with the name of something else than main text is noise, unless it is or holds an article or main element, or
    the page has none elsewhere and the container holds half of the words outside links and outside what is noise by its tag: such
    names tell how a page looks. Comments are noise unless they hold all of these words; articles in them are comments too.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    under: list[int] = []  # of each block: the innermost named container around it, or -1
    outer: list[int] = []  # of each named container: the named one around it, or -1
    holds: list[bool] = []  # of each named container: whether an article or main element lies in it
    kinds: list[int] = []  # of each named container: 2 if it names itself comments
    stack: list[tuple[str, bool, bool, int]] = []  # containers: name, noise, main, the innermost named one
    hidden: list[str] = []
    inside: Counter[str] = Counter()  # names in stack
    covered: Counter[str] = Counter()  # names in hidden
    text: list[tuple[str, bool]] = []
    link = 0
    at = 0

    def flush() -> None:
        nonlocal link
        if text:
            whole = " ".join(html.unescape("".join(x for x, _ in text)).split())
            if whole:
                linked = len(html.unescape(" ".join(x for x, in_link in text if in_link)).split()) if any(x for _, x in text) else 0
                words = whole.count(" ") + 1
                noise, main, name_of = stack[-1][1:] if stack else (False, False, -1)
                out.append((whole, words, min(words, linked), noise, main))
                under.append(name_of)
            text.clear()

    tokens = _tokens(page)
    token = next(tokens, None)
    while token:
        start, end, closing, name, attributes = token
        if not hidden and start > at:
            text.append((page[at:start], link > 0))
        at = end
        gone, named = _meaning(attributes) if attributes and not closing else (False, 0)
        if not name:
            pass
        elif closing:
            if hidden:
                if covered[name]:
                    while (x := hidden.pop()) != name:
                        covered[x] -= 1
                    covered[name] -= 1
            elif name == "a":
                link = max(0, link - 1)
            elif name in _BLOCK:
                flush()
                link = 0
                if inside[name]:
                    while (x := stack.pop()[0]) != name:
                        inside[x] -= 1
                    inside[name] -= 1
        elif name in _RAW:
            found = _RAW_END[name].search(page, at)
            at = found.end() if found else len(page)
        elif name in _HIDDEN or gone:
            if not attributes.endswith("/") and name not in _VOID:
                hidden.append(name)
                covered[name] += 1
        elif hidden:
            if name == hidden[-1] and name not in _VOID:
                hidden.append(name)
                covered[name] += 1
            elif name == "body" and covered["head"]:
                hidden.clear()
                covered.clear()
        elif name == "a":
            link = 1
        elif name == "br":
            text.append((" ", link > 0))
        if name and not closing and name in _BLOCK and not hidden:
            flush()
            link = 0
            if name in _NESTED and not attributes.endswith("/"):
                noise, main, name_of = stack[-1][1:] if stack else (False, False, -1)
                own = name in _NOISE or (name == "header" and not main)
                # an article may be a reader's comment
                article = name in ("article", "main") and named < 2 and (name_of < 0 or kinds[name_of] < 2)
                while article and not noise and name_of >= 0 and not holds[name_of] and kinds[name_of] < 2:  # each is marked once
                    holds[name_of] = True
                    name_of = outer[name_of]
                name_of = stack[-1][3] if stack else -1
                if named and name not in ("body", "main") and not article:
                    outer.append(name_of)
                    holds.append(False)
                    kinds.append(named)
                    name_of = len(outer) - 1
                stack.append((name, noise or own, main or article, name_of))
                inside[name] += 1
        try:
            token = tokens.send(at)
        except StopIteration:
            token = None
    if not hidden and at < len(page):
        text.append((page[at:], link > 0))
    flush()
    plain = [words - linked if not noise else 0 for _, words, linked, noise, _ in out]
    weight, total = [0] * len(outer), sum(plain)
    for k, w in zip(under, plain, strict=True):
        if k >= 0:
            weight[k] += w
    for k in range(len(outer) - 1, -1, -1):  # containers come after those around them
        if outer[k] >= 0:
            weight[outer[k]] += weight[k]
    # a container that holds no article has none of its blocks in one, or lies in one itself
    article = any(b[4] and not b[3] for b in out)
    gone: list[bool] = []
    for k, around in enumerate(outer):
        own = weight[k] < max(total, 1) if kinds[k] == 2 else not holds[k] and (article or 2 * weight[k] < max(total, 1))
        gone.append(own or (around >= 0 and gone[around]))
    return [(*b[:3], b[3] or (k >= 0 and gone[k]), b[4]) for b, k in zip(out, under, strict=True)]


def features(found: list[tuple[int, int, bool]]) -> list[tuple[float, ...]]:
    """found: words, words in links, main -> words, link density, both of the block before and of the one after, main."""
    own = [(float(w), linked / w) for w, linked, _ in found]
    pad = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*pad[i + 1], *pad[i], *pad[i + 2], float(f[2])) for i, f in enumerate(found)]


def labelled_rows(lines: list[str]) -> list[tuple[float, ...]]:
    """The features and the label of each block of labelled pages."""
    rows = []
    for line in lines:
        main, page, labels = False, [], []
        for x in line.split():
            if x in "[]":
                main = x == "["
            else:
                words, linked = map(int, x[:-1].split("/"))
                page.append((words, linked, main))
                labels.append(float(x[-1] == "+"))
        rows += [(*f, y) for f, y in zip(features(page), labels, strict=True)]
    return rows


def grow(rows: list[tuple[float, ...]], depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (share,) or (feature, limit, tree up to it, tree above). Last column: the label."""
    share = sum(r[-1] for r in rows) / len(rows)
    best = None
    if depth and 0 < share < 1:
        for k in range(len(rows[0]) - 1):
            values = sorted({r[k] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                sides = [[r for r in rows if r[k] <= (a + b) / 2], [r for r in rows if r[k] > (a + b) / 2]]
                impurity = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in sides)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, k, (a + b) / 2, sides)
    return (share,) if best is None else (best[1], best[2], grow(best[3][0], depth - 1), grow(best[3][1], depth - 1))


@lru_cache(1)
def trained() -> tuple:
    return grow(labelled_rows(LABELLED.strip().split("\n")))


def is_content(tree: tuple, row: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """The content blocks of a page, joined by a line end; empty for null or empty pages and those without content."""
    found = blocks(page or "")
    tree = tree or trained()
    of = features([(words, linked, main) for _, words, linked, _, main in found])
    kept = [not b[3] and is_content(tree, f) for b, f in zip(found, of, strict=True)]
    # blocks without links between two of the content belong to it, however short
    last, open_ = -1, []
    for i, (b, k) in enumerate(zip(found, kept, strict=True)):
        if k:
            for j in open_ if last >= 0 else ():
                kept[j] = True
            last, open_ = i, []
        elif b[3]:
            continue
        elif b[2]:
            last, open_ = -1, []
        else:
            open_.append(i)
    return "\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars), a row for each row of pages; null html is empty.

    n_chars counts code points. Pages are read whole, one at a time, whatever their length, in a time that grows with it;
    other columns are ignored, whatever their names, and repeated rows give equal results. An empty table gives no rows. The tree
    decides on blocks by their word count and link density, those of their neighbours, and whether they lie in an article;
    what lies in a menu, form and the like by its tag, or in a small container with such a name (see blocks), is no main text,
    and blocks without links between two of the main text are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, tree) for x in part.column("html").to_pylist()]
                arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
