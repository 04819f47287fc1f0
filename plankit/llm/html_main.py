"""Main text of web pages by a graphical model on the DOM tree.

Each block element of a page is a variable: content or not. A potential on each edge of the tree
couples it with its parent, given what is seen of it: tag, the structure of what it holds (amounts of
text and of links, paragraphs, form controls), and words of class, id and role, where they say anything. The graph is a tree, so sum-product messages, once upward and once downward,
give the exact marginals. The potentials are counted, with smoothing, from labelled pages: pages whose
elements say in a data-label attribute whether they are content.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plankit.llm.arrow import map_arrow

# Fixed values of the HTML standard: elements without an end, elements whose text is not parsed (to
# their end tag or the page's end), elements whose content is no text of the page, elements of formulas,
# elements that stand in lines of text, and which open elements a start tag ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes".split())
_APART = frozenset("noscript template svg object canvas select annotation annotation-xml".split())
_FORMULA = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark meter nobr output "
    "picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button audio video".split()
) | _FORMULA
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_CONTROLS = frozenset(("input", "button", "textarea", "select"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"']+)", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAMED = frozenset(("class", "id", "role"))


class Block:
    """A block element: its parent's number, what is seen of it, and its label in a labelled page."""

    __slots__ = ("anchors", "chars", "controls", "label", "link_chars", "parent", "seen", "tag")

    def __init__(self, parent: int, tag: str, seen: list[str], label: int | None):
        self.parent, self.tag, self.seen, self.label = parent, tag, seen, label
        self.chars = self.link_chars = self.anchors = self.controls = 0


def _seen(tag: str, attributes: str, labelled: bool) -> tuple[list[str], int | None]:
    seen, label = [], None
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes) if attributes.strip(" /\t\r\n") else ():
        name, value = (name or bare).lower(), a or b or c
        if name in _NAMED:
            seen += {f"word {w.lower()}" for w in _WORD.findall(value)}
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value == "true"):
            seen.append("hidden")
        elif labelled and name == "data-label":
            label = int(value)
    return seen, label


def _raw_end(page: str, tag: str, at: int) -> tuple[int, int]:
    """Where the text of an element that is not parsed ends, and its end tag: at the page's end if there is none."""
    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
    return stop.span() if stop else (len(page), len(page))


def _closed(attributes: str) -> bool:
    return attributes.endswith("/")


def _ends_apart(page: str, at: int) -> dict[int, int]:
    """For the elements of _APART from there on that have an end tag: the end of the start tag, and that of the element.

    An end tag is that of the last open start tag of its name. One pass for a page.
    """
    found, open_ = {}, {t: [] for t in _APART}
    while match := _TAG.search(page, at):
        at = match.end()
        tag = (match[2] or "").lower()
        if tag in _APART:
            if not match[1]:
                if not _closed(match[3]):
                    open_[tag].append(at)
            elif open_[tag]:
                found[open_[tag].pop()] = at
        elif (tag in _RAW or tag == "xmp") and not match[1]:
            at = _raw_end(page, tag, at)[1]
    return found


def parse(page: str, labelled: bool = True) -> tuple[list[Block], list[tuple[int, list[str]]]]:
    """The block elements of a page (0: the page itself), and its runs of text: (block, pieces) in page order.

    labelled: read the labels of blocks, in data-label attributes. Pages that are not made to train on
    can have that attribute for anything.
    """
    blocks = [Block(-1, "#page", [], None)]
    runs: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, inline ones too; the block each is in
    open_at: dict[str, list[int]] = defaultdict(list)  # where the open elements of each tag stand in the stack
    open_blocks = [0]  # and those that are no inline ones
    links, now, pieces, at = 0, 0, [], 0
    apart: dict[int, int] | None = None

    def broken() -> None:
        nonlocal pieces
        if pieces:
            runs.append((now, pieces))
            pieces = []

    def push(tag: str) -> None:
        open_at[tag].append(len(stack))
        stack.append((tag, now))

    def pop_to(depth: int) -> None:
        nonlocal now, links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
            open_at[tag].pop()
        del stack[depth:]
        while open_blocks[-1] >= depth:
            open_blocks.pop()
        now = stack[-1][1]

    def innermost(tags: tuple[str, ...]) -> int:
        """Where the innermost open element of these tags stands; 0 if there is none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def text(some: str) -> None:
        if not some.isspace():
            some = unescape(some) if "&" in some else some
            blocks[now].chars += len(some)
            blocks[now].link_chars += len(some) if links else 0
        pieces.append(some)

    tag_at = _TAG.search
    while match := tag_at(page, at):
        start, end = match.span()
        if start > at:
            text(page[at:start])
        at = end
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            depth = innermost((tag,))
            if not depth or (tag in _INLINE and open_blocks[-1] > depth):
                continue  # an inline element does not end the blocks inside it
            if open_blocks[-1] >= depth:
                broken()
            pop_to(depth)
            continue
        if tag in _RAW:
            blocks[now].controls += tag in _CONTROLS
            at = _raw_end(page, tag, at)[1]
            broken()
            continue
        if tag in _APART:
            blocks[now].controls += tag in _CONTROLS
            if not _closed(match[3]):
                if apart is None:
                    apart = _ends_apart(page, start)
                at = apart.get(at, at)  # without an end tag, what follows is the page's
            broken()
            continue
        if tag in _INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag in _CONTROLS:
                blocks[now].controls += 1
            if tag not in _VOID and not (tag in _FORMULA and _closed(match[3])):
                push(tag)
                links += tag == "a"
                blocks[now].anchors += tag == "a"
            continue
        broken()
        if tag in _VOID:
            continue
        if stack[open_blocks[-1]][0] == "p":  # a block ends an open paragraph, with what is open in it
            pop_to(open_blocks[-1])
        if tag in _ENDS:
            scope = innermost(_SCOPE.get(tag, ()))
            while (depth := innermost(_ENDS[tag])) > scope:
                pop_to(depth)
                if tag != "tr":
                    break
        seen, label = _seen(tag, match[3], labelled)
        if tag == "xmp":  # preformatted text that is not parsed
            blocks.append(Block(now, "pre", seen, label))
            stop, end = _raw_end(page, tag, at)
            some = page[at:stop]
            blocks[-1].chars = 0 if some.isspace() else len(some)
            blocks[-1].link_chars = blocks[-1].chars if links else 0
            runs.append((len(blocks) - 1, [some]))
            at = end
            continue
        blocks.append(Block(now, tag, seen, label))
        now = len(blocks) - 1
        open_blocks.append(len(stack))
        push(tag)
    if at < len(page):
        text(page[at:])
    broken()
    return blocks, runs


def _features(blocks: list[Block]) -> None:
    """Add to what is seen of each block the structure of all that it holds.

    Its tag with the share of text in links; how much text there is, of its own and against its
    parent's, with that share; how many long paragraphs; how long its links are; form controls.
    """
    chars, links, anchors, controls = ([getattr(b, k) for b in blocks] for k in ("chars", "link_chars", "anchors", "controls"))
    long = [int(b.tag == "p" and b.chars >= 60) for b in blocks]
    for i in range(len(blocks) - 1, 0, -1):
        parent = blocks[i].parent
        for sums in (chars, links, anchors, controls, long):
            sums[parent] += sums[i]
    for i, b in enumerate(blocks):
        share = min(3, 4 * links[i] // chars[i]) if chars[i] else "none"
        size = min(12, chars[i].bit_length())
        b.seen += [b.tag, f"{b.tag} size {size} links {share}", f"paragraphs {min(3, long[i])}"]
        if i:
            b.seen.append(f"{b.tag} in {blocks[b.parent].tag}")
        if i and chars[i]:
            b.seen += [f"part {4 * chars[i] // chars[b.parent]} of {min(12, chars[b.parent].bit_length())}", f"of page {4 * chars[i] // chars[0]}"]
        if anchors[i]:
            b.seen.append(f"{b.tag} anchors {min(3, anchors[i])} of {min(6, (links[i] // anchors[i]).bit_length())}")
        if controls[i]:
            b.seen.append(f"controls {size}")


class Model:
    """Edge potentials. seen: by what is seen of a block, its log-likelihood for each (parent's label, own
    label), in the order (0,0), (0,1), (1,0), (1,1); edges: the log-probabilities of those pairs of labels.

    What is seen of a block thus speaks for its label given its parent's: a list in a menu looks like
    a menu, a list in an article like an article. The page itself counts as a child of content.
    """

    def __init__(self, seen: dict[str, tuple[float, ...]], edges: tuple[float, ...]):
        self.seen, self.edges = seen, edges

    def potentials(self, block: Block) -> tuple[float, ...]:
        """The block's potential for each pair of labels, the largest of them 1."""
        a, b, c, d = self.edges
        for s in block.seen:
            if (x := self.seen.get(s)) is not None:
                a, b, c, d = a + x[0], b + x[1], c + x[2], d + x[3]
        top = max(a, b, c, d)
        return exp(max(a - top, -60.0)), exp(max(b - top, -60.0)), exp(max(c - top, -60.0)), exp(max(d - top, -60.0))

    def marginals(self, blocks: list[Block]) -> list[float]:
        """For each block, the probability that it is content."""
        n = len(blocks)
        edge = [self.potentials(b) for b in blocks]
        below = [(1.0, 1.0)] * n  # the product of the messages from a block's children
        message = [(1.0, 1.0)] * n  # from a block to its parent
        for i in range(n - 1, 0, -1):
            a, b, c, d = edge[i]
            x0, x1 = below[i]
            m0, m1 = a * x0 + b * x1, c * x0 + d * x1
            scale = m0 + m1
            message[i] = m0, m1 = m0 / scale, m1 / scale
            p0, p1 = below[blocks[i].parent]
            p0, p1 = p0 * m0, p1 * m1
            scale = p0 + p1
            below[blocks[i].parent] = (p0 / scale, p1 / scale)
        belief = [(0.0, 1.0)] * n
        for i in range(n):
            if i:
                q0, q1 = belief[blocks[i].parent]
                m0, m1 = message[i]
                q0, q1 = q0 / max(m0, 1e-300), q1 / max(m1, 1e-300)  # the parent's belief but for this block
            else:
                q0, q1 = 0.0, 1.0
            a, b, c, d = edge[i]
            x0, x1 = below[i]
            x0, x1 = x0 * (q0 * a + q1 * c), x1 * (q0 * b + q1 * d)
            belief[i] = (x0 / (x0 + x1), x1 / (x0 + x1))
        return [b[1] for b in belief]


def train(pages: list[str], weight: float = 0.5, backed: float = 4.0) -> Model:
    """Count potentials from labelled pages. A block without data-label has its parent's; the page is content.

    weight: the counts added to each feature's, for and against, by a block's label; backed: the counts
    that this adds to those by its parent's label too, so that pairs of labels that are rare, or never
    met, have the likelihoods of the block's label.
    """
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1)]
    seen, total = {p: Counter() for p in pairs}, Counter()
    for page in pages:
        blocks, _ = parse(page)
        _features(blocks)
        for b in blocks:
            above = 1 if b.parent < 0 else blocks[b.parent].label
            b.label = b.label if b.label is not None else above
            total[above, b.label] += 1
            seen[above, b.label].update(b.seen)
    known = set().union(*seen.values())
    likelihood = {}
    for s in known:
        own = [(seen[0, y][s] + seen[1, y][s] + weight) / (total[0, y] + total[1, y] + 2 * weight) for y in (0, 1)]
        likelihood[s] = tuple(log((seen[p][s] + backed * own[p[1]]) / (total[p] + backed)) for p in pairs)
    edges = tuple(log((total[p] + weight) / (total[p[0], 0] + total[p[0], 1] + 2 * weight)) for p in pairs)
    return Model(likelihood, edges)


def main_text(page: str, model: Model) -> str:
    """The content blocks of a page: entities decoded, white space to single spaces, a line for each."""
    blocks, runs = parse(page, labelled=False)
    _features(blocks)
    belief = model.marginals(blocks)
    lines = (" ".join("".join(pieces).split()) for block, pieces in runs if belief[block] > 0.5)
    return "\n".join(x for x in lines if x)


def labelled_pages(count: int = 800, seed: int = 11) -> list[str]:
    """Pages to train on: articles among menus, notices, adverts, forms and comments, in semantic and in plain markup.

    Two of five elements have no name or one that says nothing, so that structure has to decide.
    """
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))

    def nameless() -> str:
        """A name that says nothing, as build tools make them."""
        return rng.choice(("css-", "sc-", "", "")) + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(4, 7)))

    def mark(tag: str, inner: str, label: int | None = None, named: str = "") -> str:
        kind = rng.random()
        named = named if kind < 0.6 else nameless() if kind < 0.8 else ""
        name = f' {rng.choice(("class", "class", "id"))}="{named}"' if named else ""
        return f"<{tag}{name}{'' if label is None else f' data-label={label}'}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        return mark("ul", "".join(mark("li", f"<a href=/x>{words(1, 2)}</a>") for _ in range(rng.randint(low, high))))

    def off(*names: str) -> str:
        return rng.choice(names) + rng.choice(("", "", "-wrap", " box", " main-" + names[0]))

    def furniture(inside: bool = False) -> str:
        kind = rng.randrange(9)
        short = rng.choice(("p", "div", "span"))
        if kind == 0 and not inside and rng.random() < 0.15:
            return mark("ul", "".join(mark("li", f"<a href=/x>{words(1, 2)}</a>") for _ in range(rng.randint(3, 8))), 0)
        if kind == 0:
            return mark(*(("nav", links(3, 8), 0) if rng.random() < 0.6 else ("div", links(3, 8), 0, off("menu", "nav", "navbar", "navigation", "breadcrumb", "toolbar"))))
        if kind == 1:
            inner = mark("div", words(1, 4), None, "logo") + (links(2, 5) if rng.random() < 0.5 else "")
            return mark(*(("header", inner, 0) if rng.random() < 0.6 else ("div", inner, 0, off("header", "masthead", "banner", "topbar"))))
        if kind == 2:
            inner = f"&copy; {words(2, 14)}" if rng.random() < 0.5 else mark("p", words(2, 14)) + (links(2, 5) if rng.random() < 0.5 else "")
            return mark(*(("footer", inner, 0) if rng.random() < 0.7 else ("div", inner, 0, off("footer", "copyright", "bottom", "legal"))))
        if kind == 3:
            inner = mark("h3", words(1, 3)) + (links(2, 6) if rng.random() < 0.6 else mark("p", words(5, 40)))
            return mark(*(("aside", inner, 0) if rng.random() < 0.6 else ("div", inner, 0, off("sidebar", "related", "widget", "recommended", "popular", "trending", "tags", "rail"))))
        if kind == 4:
            return mark("div", mark(short, words(4, 30)) + ("<button>ok</button>" if rng.random() < 0.5 else ""), 0, off("cookie", "notice", "consent", "alert", "popup", "modal", "gdpr", "paywall"))
        if kind in (5, 6):
            return mark("div", words(3, 40) if rng.random() < 0.6 else mark(short, words(3, 40)), 0, off("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad"))
        if kind == 7:
            return mark("form", mark("p", words(2, 12)) + "<input name=q><button>go</button>", 0, rng.choice(("", "newsletter", "subscribe", "search", "login")))
        return mark("div", links(2, 5), 0, off("share", "social", "pagination", "pager"))

    def comments() -> str:
        each = "".join(mark(rng.choice(("div", "li", "article")), mark("p", words(5, 60)), None, rng.choice(("comment", "reply", "response"))) for _ in range(rng.randint(1, 4)))
        return mark(rng.choice(("section", "div", "ol")), each, 0, off("comments", "discussion", "responses", "disqus", "replies"))

    def article() -> str:
        blocks = [mark(rng.choice(("h1", "h1", "h2")), words(2, 10))]
        if rng.random() < 0.2:
            blocks = [mark("header", blocks[0], 1)]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                blocks.append(mark("p", words(1, 120)) if rng.random() < 0.8 else f"<p><b>{words(3, 30)}<br>" if rng.random() < 0.6 else words(10, 90))
            else:
                linked = rng.random() < 0.5  # sources, chapters, further reading
                inner = "".join(mark("li", f"<a href=/x>{words(2, 9)}</a>" if linked else words(1, 15)) for _ in range(rng.randint(1, 6)))
                blocks.append(rng.choice((mark("ul", inner), mark("ul", inner), mark("ol", inner), mark("h2", words(1, 6)), mark("blockquote", mark("p", words(5, 40))), mark("pre", words(5, 30)), mark("table", mark("tr", mark("td", words(1, 9)) * 2)), mark("figure", mark("figcaption", words(3, 12))))))
        if rng.random() < 0.3:
            blocks.insert(rng.randint(1, len(blocks)), furniture(inside=True))
        if rng.random() < 0.2:
            blocks.append(comments())
        if rng.random() < 0.25:  # text without paragraphs, and short ones
            blocks = ["<br><br>".join(words(1, 60) for _ in range(rng.randint(1, 6)))] if rng.random() < 0.5 else [mark("p", words(1, 4)), words(1, 4), mark("ul", mark("li", words(1, 2)) * 2)][: rng.randint(1, 3)]
        inner = "".join(blocks)
        kind = rng.random()
        if kind < 0.4:
            return mark("article", inner, 1, rng.choice(("", "", "post", "story")))
        if kind < 0.5:
            return mark("main", inner, 1, rng.choice(("", "content")))
        return mark(rng.choice(("div", "section")), inner, 1, rng.choice(("content", "article", "post", "entry", "story", "article body", "post content", "main content", "text")))

    made = []
    for _ in range(count):
        before = "".join(furniture() for _ in range(rng.randint(0, 4)))
        after = "".join(furniture() for _ in range(rng.randint(0, 3))) + (comments() if rng.random() < 0.4 else "")
        inner = before + article() + after
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            inner = mark("div", inner, 1, rng.choice(("", "page", "wrapper", "container", "site", "layout", "row", "app", "root")))
        made.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{inner}</body></html>" if rng.random() < 0.8 else inner)
    return made


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) for each row of pages.

    A null or empty page, and one without content, has an empty text. Rows without page_id and
    repeated rows are extracted like others; an empty table gives none; other columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [main_text(x, known) if x else "" for x in some.column(2).to_pylist()]
                arrays = [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(slim, each, "page_id long, url string, text string, n_chars long")
