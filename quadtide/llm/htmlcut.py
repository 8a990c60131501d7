"""Main text of HTML pages by minimum cut.

A page becomes a row of text blocks. A logistic score of each block's place and make-up gives the costs
of calling it content or boilerplate, which are the capacities to the two terminals. Neighbouring
blocks are joined by edges that weigh more the closer they stand in the document tree. The minimum cut
of that graph, found by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from quadtide.llm.common import column, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS_IN_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

# The HTML standard's sets of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video noframes xmp".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements and parts of class, id and role names of what is not the article.
OUTSIDE = frozenset("nav header footer aside form button select menu dialog label input fieldset option".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
NO_WORDS: frozenset[str] = frozenset()
INSIDE = frozenset("article main".split())
INSIDE_NAMES = frozenset("article body content entry main post story text".split())


@dataclass
class Block:
    text: str
    path: tuple[tuple[int, str], ...]  # numbered open elements, outermost first
    outside: bool
    inside: bool
    linked: int  # characters inside links


@dataclass(frozen=True)
class Costs:
    """Log-odds of content: what each property of a block adds, and the weight of the edges."""

    base: float = -0.6
    outside: float = -7.0
    inside: float = 4.0
    link: float = -4.0
    words: float = 0.9
    heading: float = 0.3
    sentence: float = 0.6
    near: float = 1.2


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; elements that never show text are left out."""
    stack: list[tuple[int, str]] = []
    state = [(False, False, False)]  # outside, inside, in a link: of the page and of each open element
    out: list[Block] = []
    parts: list[str] = []
    linked = count = pos = 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, tuple(stack), state[-1][0], state[-1][1], linked))
        parts.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            if state[-1][2]:
                linked += len(text)

    while True:
        m = MARKUP.search(page, pos)
        if m is None:
            break
        say(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            if any(s[1] == name for s in stack):
                while stack.pop()[1] != name:
                    pass
                del state[len(stack) + 1 :]
        elif name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ")
        elif name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            if name in BLOCK:
                flush()
        else:
            if name in BLOCK:
                flush()
                implied = CLOSES.get(name)
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] in implied), None) if implied else None
                if at is not None and not any(s[1] in ("table", "ul", "ol", "dl", "div", "article", "section") for s in stack[at:]):
                    del stack[at:], state[at + 1 :]
            words = NO_WORDS
            if attributes:
                words = frozenset(w.lower() for a in ATTRIBUTE.finditer(attributes) for w in WORDS_IN_NAME.findall(a[2] or a[3] or a[4] or ""))
            up_out, up_in, linking = state[-1]
            own_in = name in INSIDE or (name in ("div", "section") and bool(words & INSIDE_NAMES))
            # A heading's own wrapper inside the article is part of it.
            own_out = (name in OUTSIDE and not (name == "header" and up_in)) or (name not in HEADINGS and name not in INSIDE and name not in ("html", "body") and bool(words & OUTSIDE_NAMES) and not own_in)
            # These names outweigh those of an article, but on the page or the article itself they say what it has beside it.
            own_out = own_out or (name not in HEADINGS and name not in INSIDE and name not in ("html", "body") and bool(words & {"comment", "comments", "sidebar", "respond", "replies"}))
            count += 1
            if not attributes.endswith("/") or name in BLOCK:
                stack.append((count, name))
                state.append((up_out or own_out, up_in or own_in, linking or name == "a"))
    say(page[pos:])
    flush()
    return out


def odds(b: Block, c: Costs) -> float:
    """Log-odds that a block is content."""
    n = len(b.text)
    z = c.base + c.words * math.log1p(n / 60) + c.link * min(1.0, b.linked / max(n, 1))
    z += c.outside * b.outside + c.inside * (b.inside and not b.outside)
    z += c.heading * (b.path[-1][1] in HEADINGS if b.path else 0) + c.sentence * (b.text[-1] in ".!?:;\"'»”)")
    return z


def tree_distance(a: Block, b: Block) -> int:
    shared = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        shared += 1
    return len(a.path) + len(b.path) - 2 * shared


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the minimum cut leaves with the source. A node's terminals have been offset already:
    a positive gain is its capacity from the source, a negative one that to the sink."""
    room: list[dict[int, float]] = [{} for _ in gain]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    left, tiny = list(gain), 1e-9
    while True:
        came: dict[int, int] = {i: -1 for i, g in enumerate(left) if g > tiny}
        queue, end = deque(came), None
        while queue and end is None:
            u = queue.popleft()
            for v, w in room[u].items():
                if w > tiny and v not in came:
                    came[v] = u
                    if left[v] < -tiny:
                        end = v
                        break
                    queue.append(v)
        if end is None:
            return [i in came for i in range(len(gain))]
        flow, v = -left[end], end
        while came[v] >= 0:
            flow, v = min(flow, room[came[v]][v]), came[v]
        flow = min(flow, left[v])
        left[v] -= flow
        left[end] += flow
        v = end
        while came[v] >= 0:
            u = came[v]
            room[u][v] -= flow
            room[v][u] += flow
            v = u


def main_blocks(page: str | None, costs: Costs = Costs()) -> list[str]:
    """The texts of a page's content blocks in order; null and empty pages have none."""
    found = blocks_of(page) if page else []
    edges = []
    for i in range(1, len(found)):
        edges.append((i - 1, i, costs.near / (1 + tree_distance(found[i - 1], found[i]))))
        if i > 1:
            edges.append((i - 2, i, costs.near / 2 / (1 + tree_distance(found[i - 2], found[i]))))
    keep = min_cut([odds(b, costs) for b in found], edges)
    return [b.text for b, k in zip(found, keep) if k]


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url"), costs: Costs = Costs()) -> DataFrame:
    """The key columns, ``text`` (blocks joined by a line feed) and ``n_chars`` of every row.

    Null, empty and text-less pages give the empty text; pages are read whole, broken markup included;
    repeated rows give a row each; null keys stay null; columns not named are not looked at.
    """
    fields = ", ".join(f"k{i} {dict(pages.dtypes)[k]}" for i, k in enumerate(keys))

    def run(batches):
        for b in batches:
            texts = ["\n".join(main_blocks(h.as_py(), costs)) for h in b.column("h")]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keys))] + made, [*(f"k{i}" for i in range(len(keys))), "text", "n_chars"])

    rows = small_batches(pages, 64).select(*(column(pages, k).alias(f"k{i}") for i, k in enumerate(keys)), column(pages, html_col).cast("string").alias("h"))
    out = rows.mapInArrow(run, f"{fields}, text string, n_chars long")
    return out.select(*(out[f"k{i}"].alias(k) for i, k in enumerate(keys)), "text", "n_chars")
