"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each under its root-to-leaf tag path (element names with their classes), and into blocks, whose
path ends at the block element. Per path, text length and punctuation are summed over its blocks; length per block and marks
per block are its ratios. The ratios are smoothed along the page and fused, one score a path between 0 and 1, with what else
is known of it: its link density, smoothed likewise, the part that its elements play (menus, footers, sidebars, forms;
articles) and telling words among its classes.

Otsu's cut, weighted by text length, parts the scores of a page into two levels. The article is the page's article elements
or, where it has none, the innermost element that holds nearly all of the upper level's text. Being short is no ground to leave a
block of the article out: its paths fall only if something else speaks against them (a boilerplate element, a list of links,
a telling class). Paths outside fall if they are of the lower level. Nothing else but invisible elements is left out, so a
page with one level of text only, or without boilerplate, stays whole.

White space inside a block becomes one space, blocks are joined by a newline in page order. Null and empty pages give an
empty text, an empty table gives no rows; unclosed and misnested tags are tolerated; pages of any length and depth are read
whole, in one pass. Scores equal to the cut are on its upper side. Repeated rows are extracted one by one. Columns but the
named three are left alone, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by the part they play in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math canvas iframe object audio video select textarea title head noframes noembed datalist map".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog input fieldset option search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LISTS = frozenset("ul ol dl dir menu".split())
#: What holds sentences: a link that fills one of these is no menu, a label or button in one of these is part of it.
SENTENCES = HEADINGS | frozenset("p blockquote pre td th dd dt li figcaption caption summary".split())
CONTROLS = frozenset(["label", "button"])
#: Classes and ids, as whole words between white space, of what is no article whatever its text is like.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent "
    "consent gdpr popup modal nav navbar navigation menu main-menu site-nav breadcrumb breadcrumbs sidebar side-bar footer site-footer page-footer masthead "
    "site-header topbar toolbar comments comment comment-list commentlist comment-section comments-section comments-area comment-body comment-form disqus disqus_thread "
    "replies reply-list reader-comments user-comments".split()
)
#: The same, but only where the text's ratios are low, too.
HINTING = frozenset("promo promos promotion related related-posts related-articles recommended recommendations sharing share social social-links subscribe newsletter pagination pager copyright".split())
#: Closing one of these also closes what it may still hold; opening one closes an open one of its kind.
SELF_CLOSING = {
    "p": BLOCKS - {"option", "optgroup", "caption", "legend"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: A quote opens a value only behind an equals sign.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: What a path's score is multiplied by: in a boilerplate element or role; under a telling class name; outside the page's article.
PART, NAMED, OUTSIDE = 0.05, 0.3, 0.3
#: What an article's path has at least of the score, whatever its ratios; below which share of the best ratio a hint counts.
MARKED, LOW = 0.6, 0.5
#: Two levels of scores are means at least LEVELS apart, with no path's score within APART between them.
LEVELS, APART = 0.2, 0.05
#: Spread of the smoothing along the page, in blocks.
SPREAD = 0.5
#: Shares: of the upper level's text that the article's element holds; of a list's or block's text that makes it one of links; of the
#: page's text, menus and the like not counted, that the upper level has if it is to tell where the article is.
MOST, LINKS, PLAIN = 0.97, 0.8, 0.5


@dataclass(frozen=True)
class Place:
    """An open element: its path (a number for each different row of labels), its block's path, and what its path says."""

    name: str
    path: int = 0
    block_path: int = 0
    hidden: bool = False
    part: bool = False
    header: bool = False
    named: int = 0
    content: bool = False
    linked: bool = False
    heading: bool = False
    #: In what holds sentences; the number of the element and of its innermost list, in page order.
    sentence: bool = False
    node: int = 0
    in_list: int = 0


def attributes(raw: str) -> dict[str, str]:
    """Names in small letters with their values; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), "".join(values))
    return found


def text_nodes(page: str) -> tuple[list[tuple[str, int, Place]], list[int], set[int]]:
    """(text, block number, place) of every visible text node, in page order; each element's parent, by their numbers; and the
    numbers of those that are the whole page."""
    nodes: list[tuple[str, int, Place]] = []
    parents, whole = [0], {0}
    stack, paths, opened = [Place("")], {}, Counter()
    block, at, n = 0, 0, len(page)

    def pop() -> str:
        name = stack.pop().name
        opened[name] -= 1
        return name

    while at < n:
        found = _TOKEN.search(page, at)
        end = found.start() if found else n
        if end > at and not stack[-1].hidden:
            nodes.append((page[at:end], block, stack[-1]))
        if not found:
            break
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            block += 1
        elif name == "br" and not stack[-1].hidden:
            nodes.append((" ", block, stack[-1]))
        if found[1]:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        while name in SELF_CLOSING.get(stack[-1].name, ()):
            pop()
        if name in BLOCKS:  # an open paragraph ends before a block, even if inline elements are still open in it
            k = len(stack) - 1
            while k and stack[k].name not in BLOCKS:
                k -= 1
            if stack[k].name == "p":
                while len(stack) > k:
                    pop()
        if name in VOID or found[3].rstrip().endswith("/"):
            continue
        up, has = stack[-1], attributes(found[3]) if found[3] else {}
        role, label = has.get("role", "").lower(), (up.path, name, has.get("class", ""))
        path = paths.setdefault(label, len(paths) + 1)
        words = set(f"{has.get('class', '')} {has.get('id', '')}".lower().split()) if name not in ("html", "body", *CONTENT) else ()
        named = 2 if TELLING.intersection(words) else 1 if HINTING.intersection(words) else 0
        control = name in CONTROLS and not up.sentence
        stack.append(
            Place(
                name,
                path,
                path if name in BLOCKS else up.block_path,
                up.hidden or name in HIDDEN or "hidden" in has or has.get("aria-hidden", "").lower() == "true",
                up.part or name in BOILERPLATE or role in ROLES or control,
                up.header or (name == "header" and not up.content),
                max(up.named, named),
                up.content or name in CONTENT or role in CONTENT,
                up.linked or name == "a",
                up.heading or name in HEADINGS,
                name in SENTENCES or (up.sentence and name not in BLOCKS),
                len(parents),
                len(parents) if name in LISTS else up.in_list,
            )
        )
        if name in ("html", "body"):
            whole.add(len(parents))
        parents.append(up.node)
        opened[name] += 1
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = close.start() if close else n
    return nodes, parents, whole


def level(scores: np.ndarray, weights: np.ndarray) -> float:
    """The least score of the upper level by Otsu's cut; -inf if there is one level only."""
    order = np.argsort(scores, kind="stable")
    x, w = scores[order], weights[order]
    below, sums = np.cumsum(w)[:-1], np.cumsum(w * x)[:-1]
    above = w.sum() - below
    low, high = sums / np.maximum(below, 1e-9), ((w * x).sum() - sums) / np.maximum(above, 1e-9)
    parted = np.where((np.diff(x) >= APART) & (high - low >= LEVELS), below * above * (high - low) ** 2, 0)
    return float(x[parted.argmax() + 1]) if parted.max(initial=0) > 0 else -np.inf


@dataclass
class Block:
    """A run of text of one block element and one part of the page."""

    place: Place
    texts: list[str]
    chars: int = 0
    marks: int = 0
    linked: int = 0
    #: A list of links, or a block of them that holds no sentences.
    menu: bool = False
    #: Of the page's article.
    inside: bool = False

    @property
    def key(self) -> tuple:
        p = self.place
        return p.block_path, p.part or (p.header and not self.inside), p.named, self.inside, self.menu


def path_scores(blocks: list[Block], marked: bool) -> dict[tuple, tuple[float, int]]:
    """The fused score of every path, and its characters. marked: the page says itself what its article is."""
    of: dict[tuple, list[int]] = defaultdict(list)
    for k, b in enumerate(blocks):
        of[b.key].append(k)
    chars, marks, linked = (np.array([getattr(b, x) for b in blocks], float) for x in ("chars", "marks", "linked"))
    kernel = np.exp(-0.5 * (np.arange(-1, 2) / SPREAD) ** 2)
    weight = np.convolve(np.ones(len(blocks)), kernel, "full")[1:-1]
    smooth = lambda x: np.convolve(x, kernel, "full")[1:-1] / weight
    text = np.where([b.menu for b in blocks], 1 - linked / chars, 1 - smooth(linked) / smooth(chars))
    length, points = np.zeros(len(blocks)), np.zeros(len(blocks))
    for at in of.values():
        length[at], points[at], text[at] = chars[at].mean(), marks[at].mean(), text[at].mean()
    ratio = np.sqrt(smooth(length * text) * (1 + smooth(points * text)))
    for k in range(len(blocks) - 2, -1, -1):  # a heading belongs to what it heads
        if blocks[k].place.heading:
            ratio[k], text[k] = max(ratio[k], ratio[k + 1]), max(text[k], text[k + 1])
    per_path = {key: ratio[at].mean() for key, at in of.items()}
    most = max(per_path.values())
    out = {}
    for key, at in of.items():
        _, part, named, inside, menu = key
        own = per_path[key] / most if most else 0.0
        weighs = named == 2 or (named == 1 and own < LOW)
        if inside:
            own = MARKED + (1 - MARKED) * own
        out[key] = own * text[at].mean() * (PART if part else 1) * (NAMED if weighs else 1) * (OUTSIDE if marked and not inside else 1), int(chars[at].sum())
    return out


def cut(scores: dict[tuple, tuple[float, int]]) -> float:
    return level(*(np.array(x, float) for x in zip(*scores.values())))


def article(blocks: list[Block], parents: list[int], whole: set[int]) -> list[bool]:
    """Which blocks lie in the innermost element that holds MOST of the upper level's text. Where that is the page itself, its
    headers are the site's."""
    scores = path_scores(blocks, False)
    bar, held = cut(scores), np.zeros(len(parents))
    plain = sum(b.chars for b in blocks if not (b.menu or b.place.part))
    for b in blocks:
        held[b.place.node] += b.chars * (scores[b.key][0] >= bar)
    if held.sum() < PLAIN * plain:  # the upper level is too little to tell where the article is
        return [not b.place.header for b in blocks]
    for node in range(len(parents) - 1, 0, -1):
        held[parents[node]] += held[node]
    root = int(np.flatnonzero(held >= MOST * held[0])[-1])
    within = np.zeros(len(parents), bool)
    within[root] = True
    for node in range(root + 1, len(parents)):
        within[node] = within[parents[node]]
    return [bool(within[b.place.node]) and not (root in whole and b.place.header) for b in blocks]


def main_text(page: str | None) -> str:
    nodes, parents, whole = text_nodes(page or "")
    runs: dict[tuple, Block] = {}
    for raw, block, place in nodes:
        text = html.unescape(raw) if "&" in raw else raw
        run = runs.setdefault((block, place.part, place.header, place.named, place.content), Block(place, []))
        run.texts.append(text)
        if not text.isspace():
            if not run.chars:
                run.place = place
            run.chars += len(text)
            run.marks += len(PUNCTUATION.findall(text))
            run.linked += len(text) * place.linked
    found = {key: run for key, run in runs.items() if run.chars}
    if not found:
        return ""
    blocks = list(found.values())
    listed: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in blocks:
        listed[b.place.in_list][0] += b.linked
        listed[b.place.in_list][1] += b.chars
    for b in blocks:
        linked, chars = listed[b.place.in_list] if b.place.in_list else (0, 1)
        b.menu = linked > LINKS * chars or (b.linked > LINKS * b.chars and not b.place.sentence)
    marked = any(b.place.content and not b.place.part for b in blocks)
    for b, inside in zip(blocks, [b.place.content for b in blocks] if marked else article(blocks, parents, whole)):
        b.inside = inside
    scores = path_scores(blocks, marked)
    bar = cut(scores)
    lines: dict[int, list[str]] = defaultdict(list)
    for (block, *_), run in found.items():
        _, part, named, inside, menu = run.key
        if scores[run.key][0] >= bar or (inside and not (part or named or menu)):
            lines[block] += run.texts
    return "\n".join(line for line in (" ".join("".join(parts).split()) for parts in lines.values()) if line)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars."""
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    out = slim.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
