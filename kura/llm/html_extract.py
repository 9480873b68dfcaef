"""HTML extraction by a tree-structured graphical model.

A page's block elements form a tree. Each node has a hidden label, content or not; a child's label depends on its
parent's, and a node's features (tag, hint words of class, id and role, link density, length, sentence marks) on its
label. Sum-product messages go up from the leaves and down from the root, and give each node's marginal of
being content. The tables are counted on labelled pages, which `labelled_pages` lays out from the
common parts of web pages. Text of a node is kept where its marginal is at least one half.

What no reader sees (scripts, styles, templates, titles), fallbacks (noscript, iframe) and the content of a textarea never count as
text; formulas, drawings' labels and objects are text of their block, and other form controls are judged as any node. Blocks come in page
order, white space inside a block (also of a line break or a no-break space) becomes one space, blocks are joined by \\n.

Defined results: null and empty pages give an empty text; broken markup is read as far as it goes, open elements
end where their parent ends; equal rows give equal texts; existing columns of the outputs' names are replaced.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts_of, with_columns

PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder mstyle svg g text tspan object".split()
)
#: An element that ends those open ones of its kind, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KINDS = {
    "article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "select": "form", "button": "form", "dialog": "form",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "p": "p", "pre": "p", "blockquote": "p", "table": "table", "tr": "table", "td": "table", "th": "table",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "body": "body",
}
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar topbar toc skip",
    "header": "header masthead banner branding logo site-header hero",
    "footer": "footer copyright colophon contentinfo legal foot",
    "side": "sidebar side aside complementary widget widgets related recommended trending popular rail more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall toast",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad adsense dfp outbrain taboola",
    "form": "form search login signup comment-form contact-form",
    "comment": "comment comments reply replies respond disqus discussion feedback reviews",
    "share": "share sharing social follow author-box byline-share tags tag-list",
    "content": "content article post entry story body text main article-body post-content entry-content story-body prose page",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}


class Node:
    __slots__ = ("tag", "hint", "kids", "text", "links", "parent")

    def __init__(self, tag: str, hint: str, parent: Node | None):
        self.tag, self.hint, self.parent = tag, hint, parent
        self.kids: list[Node | str] = []  # child blocks and text runs in page order
        self.text = self.links = 0


def hint_of(attributes: str) -> str:
    """The kind named by the words of class, id and role; anything but content wins over content."""
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        for name in re.split(r"\s+", (m[2] or m[3] or m[4] or "").lower()):
            words = [name, *re.split(r"[-_]+", name)]
            kinds = [HINT_OF[w] for w in words if w in HINT_OF]
            found.update(kinds)
    others = sorted(found - {"content"})
    return others[0] if others else "content" if found else "none"


def parse(page: str) -> Node:
    """The tree of blocks of a page."""
    root = Node("body", "none", None)
    here, stack, inline = root, [], []
    run: list[str] = []
    in_link, skip, at = 0, "", 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            here.kids.append(text)
            here.text += len(text)

    def close(depth: int) -> None:
        nonlocal here, in_link
        flush()
        while len(stack) > depth:
            stack.pop()
            here = here.parent or root
        inline.clear()
        in_link = 0

    def say(text: str) -> None:
        if text and not skip:
            run.append(text)
            if in_link:
                here.links += len(text.strip())

    for m in PART.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if tag == "head" and skip == "head":
                skip = ""
            elif tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "p" and "p" not in stack:
                flush()
            elif tag not in INLINE and tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            run.append(" ")
            continue
        if tag == "head":
            skip = "head"
            continue
        if tag == "body":
            skip = ""
            root.hint = "none"
            continue
        if tag == "html" or skip:
            continue
        if tag == "br" or tag in VOID:
            run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            in_link += tag == "a"
            continue
        if "p" in stack and tag not in ("object",):
            last = len(stack) - 1 - stack[::-1].index("p")
            if not any(t in ("td", "th", "div", "li", "section", "article") for t in stack[last:]):
                close(last)
        if tag in ENDS:
            kinds, until = ENDS[tag]
            cut = len(stack)
            for d in range(len(stack) - 1, -1, -1):
                if stack[d] in until:
                    break
                if stack[d] in kinds:
                    cut = d
            if cut < len(stack):
                close(cut)
        flush()
        in_link = 0
        child = Node(tag, hint_of(m[3]), here)
        here.kids.append(child)
        stack.append(tag)
        here = child
    say(page[at:])
    close(0)
    return root


def order(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out = [root]
    for node in out:
        out += [k for k in node.kids if isinstance(k, Node)]
    return out


def features(nodes: list[Node]) -> list[tuple[str, str, str, str, str]]:
    total, linked, marks = {}, {}, {}
    for node in reversed(nodes):
        own = [k for k in node.kids if isinstance(k, str)]
        kids = [id(k) for k in node.kids if isinstance(k, Node)]
        total[id(node)] = node.text + sum(total[k] for k in kids)
        linked[id(node)] = node.links + sum(linked[k] for k in kids)
        marks[id(node)] = any(re.search(r"[.!?。！？]", k) for k in own) or any(marks[k] for k in kids)
    out = []
    for node in nodes:
        n = total[id(node)]
        density = linked[id(node)] / n if n else 0
        out.append((KINDS.get(node.tag, "box"), node.hint, "none" if not n else str(int(min(density, 0.99) * 3)), str(min(4, int(math.log(n + 1, 8)))), str(marks[id(node)])))
    return out


class Model:
    """Counts of a labelled tree; log tables with add-half smoothing."""

    def __init__(self):
        self.seen = [[Counter() for _ in range(5)] for _ in range(2)]
        self.step = [Counter(), Counter()]
        self.labels = Counter()

    def learn(self, root: Node, label_of) -> None:
        nodes = order(root)
        label = {id(n): label_of(n) for n in nodes}
        for node, values in zip(nodes, features(nodes), strict=True):
            y = label[id(node)]
            self.labels[y] += 1
            for table, v in zip(self.seen[y], values, strict=True):
                table[v] += 1
            if node.parent:
                self.step[label[id(node.parent)]][y] += 1

    def done(self) -> Model:
        sizes = [len(set(a) | set(b)) + 1 for a, b in zip(*self.seen, strict=True)]
        self.local = [[{v: math.log((c + 0.5) / (sum(t.values()) + 0.5 * n)) for v, c in t.items()} | {None: math.log(0.5 / (sum(t.values()) + 0.5 * n))} for t, n in zip(self.seen[y], sizes, strict=True)] for y in (0, 1)]
        self.move = [[(self.step[a][b] + 0.5) / (sum(self.step[a].values()) + 1) for b in (0, 1)] for a in (0, 1)]
        return self

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """P(content) of each node, by one sweep of messages up and one down."""
        own = {}
        for node, values in zip(nodes, features(nodes), strict=True):
            logs = [sum(t.get(v, t[None]) for t, v in zip(self.local[y], values, strict=True)) for y in (0, 1)]
            top = max(logs)
            own[id(node)] = [math.exp(x - top) for x in logs]
        up, below = {}, {}
        for node in reversed(nodes):
            b = own[id(node)]
            for kid in node.kids:
                if isinstance(kid, Node):
                    m = up[id(kid)]
                    b = [b[0] * m[0], b[1] * m[1]]
                    s = b[0] + b[1]
                    b = [b[0] / s, b[1] / s]
            below[id(node)] = b
            m = [sum(self.move[a][y] * b[y] for y in (0, 1)) for a in (0, 1)]
            s = m[0] + m[1]
            up[id(node)] = [m[0] / s, m[1] / s]
        belief, out = {}, {}
        for node in nodes:
            b = below[id(node)]
            if node.parent:
                p, m = belief[id(node.parent)], up[id(node)]
                q = [p[0] / max(m[0], 1e-300), p[1] / max(m[1], 1e-300)]  # the parent without this child
                b = [b[y] * (q[0] * self.move[0][y] + q[1] * self.move[1][y]) for y in (0, 1)]
            s = b[0] + b[1]
            belief[id(node)] = b = [b[0] / s, b[1] / s]
            out[id(node)] = b[1]
        return out


def labelled_pages(many: int = 300, seed: int = 7) -> list[str]:
    """Pages whose elements outside the article carry the class word x-no and whose article parts carry x-yes; a
    body with data-content is content itself."""
    rng = random.Random(seed)
    syllables = "an er on re in st tion ou le de la ver ge ung ado cion que".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + "."
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    name = lambda kind: rng.choice(HINTS[kind].split())

    def links(tag: str, mark: str) -> str:
        return f'<{tag} class="{mark}">' + "".join(f'<li class="{mark}"><a href="/">{words(1, 4)}</a></li>' for _ in range(rng.randint(2, 9))) + f"</{tag}>"

    def box(kind: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        tag, hint = rng.choice([(tag, ""), (tag, name(kind)), ("div", name(kind)), ("section", name(kind))]) if tag != "div" else (rng.choice(["div", "section"]), name(kind))
        inner = {"menu": lambda: links("ul", "x-no"), "side": lambda: f'<h3 class="x-no">{words(1, 3)}</h3>' + links("ul", "x-no") + f'<p class="x-no">{prose(0, 2)}</p>', "comment": lambda: "".join(f'<div class="x-no {name("comment")}"><p class="x-no">{prose(1, 4)}</p></div>' for _ in range(rng.randint(1, 5)))}
        plain = lambda: rng.choice([prose(1, 2), f'<p class="x-no">{prose(1, 3)}</p>', f'<h2 class="x-no">{words(1, 4)}</h2><p class="x-no">{prose(1, 2)}</p>', f'<a href="/">{words(1, 3)}</a> {words(1, 4)}'])
        return f'<{tag} class="x-no {hint}">' + inner.get(kind, plain)() + f"</{tag}>"

    def part() -> str:
        kind = rng.choices(["p", "h2", "ul", "blockquote", "table", "h1", "div"], [70, 8, 6, 3, 2, 4, 5])[0]
        if kind == "ul":
            return '<ul class="x-yes">' + "".join(f'<li class="x-yes">{rng.choice([words(2, 9), prose(1, 2)])}</li>' for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind == "table":
            return '<table class="x-yes"><tr class="x-yes">' + f'<td class="x-yes">{words(1, 4)}</td>' * 3 + "</tr></table>"
        body = words(2, 9) if kind[0] == "h" else prose(1, 9)
        if rng.random() < 0.15:
            body += f' <a href="/">{words(1, 3)}</a>'
        return f'<{kind} class="x-yes">{rng.choice([body, f"<b>{body}</b>"]) if rng.random() < 0.2 else body}</{kind}>'

    out = []
    for _ in range(many):
        kinds = ["menu", "header", "side", "notice", "ad", "form", "comment", "share", "footer"]
        some = [k for k in kinds if rng.random() < 0.6]
        tag, hint = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", name("content")), ("section", name("content"))])
        parts = ["".join(part() for _ in range(rng.randint(1, 12)))]
        inside = [k for k in ("ad", "share", "side", "comment", "form") if rng.random() < 0.08]
        body = "".join(parts) + "".join(box(k) for k in inside)
        before = [box(k) for k in some if k in ("menu", "header", "notice", "ad")]
        after = [box(k) for k in some if k in ("side", "form", "comment", "share", "footer")]
        bare = rng.random() < 0.2  # the article's parts stand in the body itself
        inner = body if bare else f'<{tag} class="x-yes {hint}">{body}</{tag}>'
        out.append(("<body data-content>" if bare else "<body>") + "".join(before) + inner + "".join(after) + "</body>")
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    model = Model()
    for page in labelled_pages():
        model.learn(*labelled(page))
    return model.done()


def labelled(page: str) -> tuple[Node, object]:
    """The tree of a labelled page, and the label of its nodes."""
    labels: list[int] = []
    plain = re.sub(r'class="x-(yes|no) ?', lambda m: labels.append(int(m[1] == "yes")) or f'data-at="{len(labels) - 1}" class="', page)
    root = parse(plain)
    at = {}
    nodes = [n for n in preorder(root) if n is not root]
    for node, y in zip(nodes, labels, strict=True):
        at[id(node)] = y
    return root, lambda n: at.get(id(n), int("data-content" in page))


def preorder(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def main_text(page: str, model: Model | None = None) -> str:
    """The text of the content blocks."""
    root = parse(page)
    share = (model or trained()).marginals(order(root))
    out, todo = [], [(root, 0)]
    while todo:
        node, i = todo.pop()
        if i == len(node.kids):
            continue
        todo.append((node, i + 1))
        kid = node.kids[i]
        if isinstance(kid, Node):
            todo.append((kid, 0))
        elif share[id(node)] >= 0.5 or len(share) == 1:  # text without any block is all there is
            out.append(kid)
    return "\n".join(out)


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with text_col string and n_chars long."""

    def make():
        model = trained()

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [main_text(t, model) for t in texts_of(batch, html_col)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return fn

    return with_columns(df, html_col, [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())], make, drop)
