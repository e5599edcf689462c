"""HTML extraction: flat text blocks, judged by a decision tree.

A page is read once from left to right into flat blocks, the stretches of text between block-level tags. A block knows its words and
link density, those of both neighbours, its tag, and where it stands: whether an article or main element holds it, whether the page has
one at all, and whether an element by its tag (nav, footer, ...) or by a word of its class, id, role or label (advert, comments, ...) surrounds it. Only what lies
between the block and its article or main element counts for the latter two. A decision tree, grown on the blocks of a small labelled table, says which
blocks are main text. Where a page has no article or main element, it goes by words and link densities of the block and its
neighbours. The table is a fixed set of some fifty made-up pages; the tree travels inside the closure and the pages move nowhere.

Null and empty pages give an empty text. Unclosed and misnested tags are tolerated: a new paragraph, item or cell ends the open one, an
unclosed script, style or comment ends with the page, and so does a tag without its ">". Scripts, styles, templates, drawings (svg), frames, titles of the
window and controls (select, textarea, button) hold no text of the page; without an end tag they are empty, except scripts and styles. The text of
math, noscript and object elements counts as any other. Character references are decoded as browsers do, so a cut one stays as it
is. Every character is looked at a bounded number of times, so time and memory are linear in the page, also for hostile and very long ones. Repeated rows are treated alike. An empty
table gives an empty result. Extra columns pass through whatever their names; a column named like the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, free_name, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[a-z]+")
_RAW = frozenset(("script", "style"))
_CLOSER = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in _RAW}
_NESTED = frozenset("title textarea iframe svg select template button".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag ends, and those that keep it from reaching further out.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_ASIDE = frozenset("nav footer aside form menu dialog header".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LABELS = frozenset("class id role aria-label".split())
#: Words that mark what surrounds an article, and words beside which some of them do not.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar navbar nav navigation menu submenu cookie cookies consent notice gdpr popup modal overlay "
    "comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget widgets complementary contentinfo toolbar".split()
)
#: Words that say nothing but how a marked element looks or where it is. A name with any other word is that of a subject (notice-board, comment-on-policy) and marks nothing.
_FRAME = frozenset(
    "a area bar block bottom box btn button buttons card col column container content count form global group heading hidden icon icons inner item items js label left link links list main message "
    "mini mobile new no number outer page panel primary right row section site slot space strip text thread title top unit user view wrap wrapper zone one two three id".split()
)
_PLACES = frozenset("header footer side aside masthead".split())
_OWN = frozenset("article post entry content story body text main title".split())
_STATES = frozenset("has with without no layout is".split())
_KNOWN = _MARKS | _PLACES | _OWN | _FRAME

#: Of a block: itself, its neighbours, its tag, and where it stands.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "paragraph", "in_main", "page_has_main", "in_aside_tag", "in_marked_element")


class _Tags:
    """The tags of a page, from left to right: (start, end, "/" or "", name, where its attributes begin). Comments and raw elements are passed over."""

    def __init__(self, page: str):
        self.page, self.none_ahead = page, set()

    def _find(self, what: str, at: int) -> int:
        """Where `what` comes next, or -1; a search that failed is not made again."""
        if what in self.none_ahead:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none_ahead.add(what)
        return found

    def _end(self, at: int) -> int:
        """Past the ">" of a tag; values in quotes may hold others. -1 without one."""
        page = self.page
        while m := _STOP.search(page, at):
            at = m.end()
            if m[0] == ">":
                return at
            back = m.start() - 1
            while page[back] in " \t\n\r\f":
                back -= 1
            if page[back] == "=":
                close = self._find(m[0], at)
                if close >= 0:
                    at = close + 1
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, int]]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            head = page[at : at + 1]
            if head == "!" and page.startswith("<!--", start):
                end = start + 5 if page.startswith("<!-->", start) else self._find("-->", start + 4) + 3
                end = len(page) if end == 2 else end
                yield start, end, "!", "", end
            elif head in ("!", "?"):
                end = self._find(">", at) + 1 or len(page)
                yield start, end, "!", "", end
            elif m := _NAME.match(page, at + (head == "/")):
                end = self._end(m.end())
                if end < 0:
                    yield start, len(page), "!", "", len(page)
                    return
                kind, name = "/" if head == "/" else "", m[0].lower()
                if kind or name not in _RAW:
                    yield start, end, kind, name, m.end()
                else:
                    key = f"</{name}"
                    close = None if key in self.none_ahead else _CLOSER[name].search(page, end)
                    if close:
                        gt = self._end(close.end())
                        end = gt if gt >= 0 else len(page)
                    else:
                        self.none_ahead.add(key)
                        end = len(page)
                    yield start, end, "!", " ", end
            else:
                continue
            at = end


def _marked(attributes: str, heading: bool, main: bool) -> bool:
    """Whether a name in class, id, role or label says that this is not the article. A title may be called what it likes, and an article may have a header."""
    if heading or "=" not in attributes:
        return False
    for m in _ATTR.finditer(attributes):
        if m[1].lower() in _LABELS:
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                parts = set(_PART.findall(token))
                if not parts & _STATES and parts <= _KNOWN and (parts & _MARKS or (parts & _PLACES and not parts & _OWN and not (main and "header" in parts))):
                    return True
    return False


def blocks(page: str) -> list[tuple[str, tuple[float, ...]]]:
    """The text of each block, and its words, link density, tag and place."""
    found: list[tuple[str, tuple[float, ...]]] = []
    names: list[str] = []  # the open block elements
    places: list[tuple[bool, bool, bool]] = []  # of each: within main, within an aside tag, within a marked element
    open_: dict[str, list[int]] = {}  # where each is open
    parts: list[str] = []
    linked, link = 0, -1  # words in links; how deep the open link began
    tags = list(_Tags(page))

    ends: dict[int, int] = {}  # of nested elements without text: the tag that ends each
    begun: dict[str, list[int]] = {}
    for i, (_, end, kind, name, _) in enumerate(tags):
        if name in _NESTED:
            if kind == "/" and begun.get(name):
                ends[begun[name].pop()] = i
            elif kind == "" and page[end - 2] != "/":
                begun.setdefault(name, []).append(i)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                tag, (main, aside, marked) = (names[-1], places[-1]) if names else ("", (False, False, False))
                found.append((" ".join(words), (float(len(words)), min(1.0, linked / len(words)), float(tag in _HEADINGS), float(tag in ("p", "blockquote", "pre")), float(main), float(aside), float(marked))))
        parts, linked = [], 0

    def close(depth: int) -> None:
        nonlocal link
        while len(names) > depth:
            open_[names.pop()].pop()
            places.pop()
        if link > depth:
            link = -1

    def text(lo: int, hi: int) -> None:
        nonlocal linked
        if lo < hi:
            t = html.unescape(page[lo:hi])
            parts.append(t)
            if link >= 0:
                linked += len(t.split())

    at, i, has_main = 0, 0, False
    while i < len(tags):
        start, end, kind, name, rest = tags[i]
        text(at, start)
        at = end
        if i in ends:
            i = ends[i]
            at = tags[i][1]
            parts.append(" ")
        elif name == "br" or kind == "!":
            parts.append(" " if name else "")
        elif name == "a":
            link = -1 if kind else len(names)
        elif name == "hr":
            flush()
        elif name in _BLOCK:
            flush()
            if kind:
                if open_.get(name):
                    close(open_[name][-1])
            else:
                if names and names[-1] == "p":
                    close(len(names) - 1)
                if name in _CLOSES:
                    inner, outer = (max((open_[n][-1] for n in group if open_.get(n)), default=-1) for group in _CLOSES[name])
                    if inner > outer:
                        close(inner)
                main, aside, marked = places[-1] if places else (False, False, False)
                if name in _MAIN:
                    main, aside, marked, has_main = True, False, False, True
                if name not in ("html", "body"):
                    aside = aside or (name in _ASIDE and not (name == "header" and main))
                    marked = marked or _marked(page[rest:end], name in _HEADINGS, main)
                open_.setdefault(name, []).append(len(names))
                names.append(name)
                places.append((main, aside, marked))
        i += 1
    text(at, len(page))
    flush()
    return [(t, (*x[:5], float(has_main), *x[5:])) for t, x in found]


def featured(page: str) -> tuple[list[str], np.ndarray]:
    """The blocks' texts and FEATURES."""
    found = blocks(page)
    if not found:
        return [], np.zeros((0, len(FEATURES)))
    own = np.array([f for _, f in found])
    edge = np.zeros((1, 2))
    around = np.vstack([edge, own[:, :2], edge])
    return [t for t, _ in found], np.hstack([own[:, :2], around[:-2], around[2:], own[:, 2:]])


#: The labelled table. {n} stands for n words, [n] for a link of n words, and @ before a block marks main text. Each page is taken in all SCALES.
LABELLED = (
    "<header>[1] {4}</header><nav><ul><li>[1]<li>[2]<li>[1]</ul></nav><div class=advert>{9}</div><article><h1>@{6}</h1><p>@{40}</p><p>@{1}</p><p>@{12} [2] {9}</p><ul><li>@[3]<li>@{4}</ul><p>@{25}</p></article><aside><h3>{2}</h3><p>{14}</p></aside><footer>{11}</footer>",
    "<div role=navigation>[1] [1] [2]</div><main><h2>@{4}</h2><p>@{30}</p><blockquote>@{18}</blockquote><table><tr><td>@{1}<td>@{2}</table><p>@{2}</p></main><div class=sidebar><p>{22}</p><p>[4]</p></div><footer><p>{17}</p></footer>",
    "<article><header><h1>@{7}</h1><p>@{5}</p></header><p>@{35}</p><div class='ad box'>{12}</div><p>@{3}</p><p>@[6]</p><section class=comments><h3>{2}</h3><p>{30}</p><p>{6}</p></section></article><form><p>{8}</p></form>",
    "<nav>[1] [1]</nav><div class=cookie-notice>{14} [1]</div><article><p>@{20}</p><pre>@{5}</pre><div>@{11}</div><footer>{6}</footer><div class=share>[1] [1] {2}</div></article><footer>{5} [1]</footer>",
    "<main><article><h1>@{5}</h1><p>@{28}</p><aside><p>{12}</p></aside><p>@{1}</p></article><div class=related><p>[5]</p><p>[6]</p></div></main>",
    "<div>[1] [1] [1]</div><div>[2]</div><h1>@{6}</h1><div>@{45}</div><div>@{3}</div><div>@{30}</div><div>@{20} [1] {15}</div><div>[2] [3]</div><div>{4} [1]</div>",
    "<ul><li>[1]<li>[2]<li>[1]<li>[1]</ul><p>@{38}</p><p>@{6}</p><p>@{42}</p><ul><li>@{9}<li>@{12}</ul><p>@{33}</p><ul><li>[3]<li>[4]<li>[2]</ul><div>{3}</div>",
    "<table><tr><td>[1]<td>[1]<td>[2]</table><center><h2>@{4}</h2></center><p>@{50}</p><p>@{24} [3] {20}</p><p>@{4}</p><p>@{40}</p><p>[1] [1]</p><address>{6} [1]</address>",
    "<div>{3}</div><div>[1]</div><div>[1]</div><div>[2]</div><h1>@{5}</h1><p>@{22}</p><p>@{31}</p><p>@{2}</p><p>@{27}</p><h3>{2}</h3><div>[6]</div><div>[7]</div><div>[5]</div><div>{5}</div>",
    "<nav>[1] [2]</nav><h1>@{5}</h1><p>@{12} [2]</p><p>@{20} [2] {5}</p><p>@{40} [4] {5}</p><p>@[2] {14} [3] {9}</p><p>@{15} [9] {12}</p><p>@{26}</p><div>[2] {1}</div><div>[3] [4]</div>",
    "<div>[1] [1]</div><h2>@{4}</h2><div>@{11} [2] {6}</div><div>@{22} [3]</div><div>@{9} [4] {8}</div><div>@{31} [2] {7}</div><ul><li>@{7} [2] {5}<li>@{12} [3]</ul><p>[4]</p><p>[2] {2} [1]</p>",
    "<p>@{31}</p><p>@{6}</p><p>@{28}</p><p>@{5}</p><div>[9] [12] [7]</div><p>{6}</p>",
    "<h1>@{5}</h1><div>@{25}</div><div>@{7}</div><div>@{26}</div><div>@{8}</div><div>[14] [10]</div><div>{7}</div><div>[11] [16]</div><div>{5}</div>",
    "<div>{3}</div><div>{2}</div><div>{3}</div><h1>@{6}</h1><div>@{33}</div><div>@{3}</div><div>@{41}</div><div>@{3}</div><div>@{28}</div><div>{2}</div><div>{3}</div>",
    "<h1>@{5}</h1><p>@{45}</p><p>@{50}</p>",
    "<p>@{60}</p><p>@{80}</p><p>@{24}</p><p>@{9}</p>",
    "<div>@{90}</div><div>@{120}</div><div>@{65}</div>",
    "<h2>@{4}</h2><p>@{70}</p><p>@{12}</p>",
    "<p>@{24} [5] {11}</p><p>@{16} [2]</p><p>@{13} [6] {14} [3]</p><p>@{35} [3]</p><div>[3] {1} [2]</div><div>{1} [2]</div>",
    "<article><h1>@{5}</h1><p>@{12} [2]</p><p>@{3} [6]</p><section class=search-history><p>@{21} [2]</p></section><div class=notice-board><p>@{17}</p><p>@{4}</p></div><div class=advert><p>{17}</p></div></article>",
    "<div>[2] {1} [2]</div><div>@{60}</div><div>@{55}</div><div>@{48}</div><div>[2] {2}</div><div>{2} [2]</div>",
    "<div><p>[1] [1] [1]</p></div><div class=post><h2 class=post-header>@{5}</h2><p>@{26}</p><p>@{5}</p><p>@{36}</p></div><div class=comments><p>{25}</p><p>{18}</p></div><div id=footer><p>{9}</p></div>",
    "<div class=promo><p>{15}</p></div><h1>@{7}</h1><p>@{34}</p><div class='banner ad'><p>{10}</p></div><p>@{29}</p><p>@{8}</p><p>@{30}</p><div class=newsletter><p>{16}</p></div><p>[2] [2]</p>",
    "<h1>@{4}</h1><p>@{18}</p><p>@{21}</p><p>@{3}</p><p>@{25}</p>",
    "<p>@{30}</p><p>@{44}</p>",
    "<div>[1] [1] [1] [1]</div><div>{2}</div><p>@{33}</p><p>@{29} [1] {4}</p><div>{2}</div><div>[3]</div><div>{4}</div><div>[4]</div>",
    "<dl><dt>[1]<dd>[2]<dt>[1]<dd>[2]</dl><div>@{41}</div><div>@{7}</div><div>@{52}</div><dl><dt>{1}<dd>[2]<dt>{1}<dd>[3]</dl>",
    "<article><h2>@{3}</h2><p>@[2]</p><h2>@{2}</h2><ul><li>@[1]<li>@[3]<li>@[2]</ul><div>@{6}</div><div>@[4]</div><div>@{2}</div></article>",
    "<main><div>@[3]</div><div>@{3}</div><table><tr><td>@[1]<td>@{1}<td>@[2]</table><p>@{1}</p></main>",
    "<nav>[1]</nav><article><div>@{9}</div><p>@[1]</p><div>@{4}</div><h3>@{2}</h3><div>@[3]</div></article><div>[2]</div><div>{40}</div>",
    "<nav>[2]</nav><div>@{25}</div><div>@{6}</div><div>@{37}</div><footer>{20}</footer>",
    "<header><p>{10}</p></header><h1>@{6}</h1><p>@{23}</p><p>@{2}</p><p>@{40}</p><aside><p>{19}</p></aside>",
)
SCALES = (0.5, 1.0, 3.0)
MARK = "\ue000"
_VOCABULARY = "the river ran past an old mill and people of our town came to see it every day in summer".split()


#: Whatever stands in an article without a mark is main text: an article has these in every order of three.
KINDS = ("<p>@{1}</p>", "<div>@{9}</div>", "<p>@{30}</p>", "<li>@[1]</li>", "<p>@[7]</p>", "<h3>@{2}</h3>")


def _every_three(kinds: tuple[str, ...]) -> str:
    return "<article>" + "".join(a + b + c for a in kinds for b in kinds for c in kinds) + "</article>"


def labelled_pages() -> list[str]:
    pages, k = [], 0

    def words(n: int) -> str:
        nonlocal k
        k += n
        return " ".join(_VOCABULARY[(k + i) % len(_VOCABULARY)] for i in range(n))

    for page in (*LABELLED, _every_three(KINDS)):
        for scale in SCALES if page in LABELLED else (1.0,):
            size = lambda m, scale=scale: max(1, round(int(m[1]) * (scale if int(m[1]) > 3 else 1)))
            made = re.sub(r"\{(\d+)\}", lambda m: words(size(m)), page)
            made = re.sub(r"\[(\d+)\]", lambda m: f"<a href=#>{words(size(m))}</a>", made)
            pages.append(made.replace("@", MARK))
    return pages


def training_table(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, whether it is main text) of the blocks of marked pages. A mark is part of a word."""
    found = [featured(p) for p in pages]
    return np.vstack([x for _, x in found]), np.array([MARK in t for texts, _ in found for t in texts])


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = 3) -> tuple | bool:
    """A tree of (feature, threshold, tree up to it, tree beyond it); leaves are verdicts and come of `least` blocks or more."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = (2 * y.mean() * (1 - y.mean()) - 1e-12, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= threshold
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(part.sum() / len(y) * 2 * (q := y[part].mean()) * (1 - q) for part in (low, ~low))
            if impurity < best[0] - 1e-12:
                best = (float(impurity), f, float(threshold))
    if best[1] < 0:
        return bool(y.mean() >= 0.5)
    low = x[:, best[1]] <= best[2]
    below, above = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return below if isinstance(below, bool) and below is above else (best[1], best[2], below, above)


@lru_cache(maxsize=1)
def trained_tree(depth: int = 8) -> tuple | bool:
    return grow(*training_table(labelled_pages()), depth)


def classify(tree: tuple | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    out = np.empty(len(x), dtype=bool)
    low = x[:, tree[0]] <= tree[1]
    out[low], out[~low] = classify(tree[2], x[low]), classify(tree[3], x[~low])
    return out


def main_text(page: str | None, tree: tuple | bool) -> str:
    texts, x = featured(page or "")
    return "\n".join(t for t, keep in zip(texts, classify(tree, x).tolist(), strict=True) if keep)


def extract(pages: DataFrame, page_html: str = "html", text: str = "text") -> DataFrame:
    """pages with `text`, the main text, in place of the html column."""
    tree = trained_tree()
    kept = [c for c in pages.columns if c not in (page_html, text)]
    raw = free_name(pages.columns, "html")
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{page_html}`").alias(raw))
    schema = rows.select(*(F.col(f"`{c}`") for c in kept), F.lit("").cast("string").alias(text)).schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 4 << 20):
            n = batch.num_columns - 1
            out = pa.array([main_text(p, tree) for p in batch.column(n).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], out], names=[*kept, text])

    return rows.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
