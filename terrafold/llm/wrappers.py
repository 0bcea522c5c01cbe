"""Operator 7, main text of web pages by wrapper induction.

A page is a tree of blocks; runs of like siblings are one repeated slot. Pages of a host with like outer elements are a
layout, whose wrapper is some of its own pages. Every page is aligned with them by simple tree matching and votes, for
each node, on its text: the same or not, how long, how much of it links. Summed over all pages of the layout, that
tells template from slots: constant nodes are template; of the varying text, the innermost element that holds nearly
all is the region of the content. Tags and names decide where a layout has too few pages or no such element, and inside
of a region on menus, adverts, forms and comments. No host meets in one task.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import LOWER, UPPER, small, staged

#: Pages of a layout that serve as its wrapper, at most (votes come from all pages); how deep the elements are that tell layouts apart.
WRAPPERS, OUTER = 3, 4
#: A node is template if so many pages of different content were aligned with it and this share of them has its text.
#: Constants of more than this share of a region's text are taken for copies of one article, not for a template.
MIN_PAGES, CONSTANT, COPIES = 4, 0.6, 0.3
#: The region is the innermost element with this share of the varying text.
REGION = 0.9
#: Sibling lists are aligned within so many places of their diagonal, beyond what is alike at both ends.
BAND = 32
#: Wrappers are broadcast for at most so many layouts.
BROADCAST_LAYOUTS = 10_000
#: A block whose text is links by more than this share is linked.
LINKED = 0.5

# Elements whose text is never content, inline elements, elements without an end tag, and those that an equal one ends.
DROPPED = set("nav footer aside form script style noscript template button select option textarea iframe svg head title dialog menu canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img input label math semantics mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section div main body nav footer aside header form blockquote".split())
ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
# Names, in class, id or role, of what isn't the article, and what may stand before and behind one.
NAMES = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar sidebars side aside "
    "widget widgets cookie cookies cookieconsent consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations pagination pager search skip toolbar copyright contentinfo complementary dialog"
).split()
BEFORE = "site page global top bottom left right main user reader".split()
BEHIND = "bar box block container wrap wrapper list section area item items inner content top bottom left right main primary secondary link links menu panel form slot unit banner header footer title text message overlay thread".split()
NAMED = re.compile(rf"(?:(?:{'|'.join(BEFORE)})[-_])?(?:{'|'.join(NAMES)})(?:[-_]?(?:{'|'.join(BEHIND)}|\d+))*", re.I)
TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[/a-zA-Z!?][^>]*\Z""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


HEADINGS, ALL_HEADINGS, LISTED = {"h1", "h2"}, {f"h{k}" for k in range(1, 7)}, {"li", "dd", "dt", "td", "th", "option"}
#: Why an element isn't content: by its tag, by its name, as a header outside of an article.
BY_TAG, BY_NAME, BY_HEADER = 1, 2, 3
#: What a skeleton's node holds.
LABEL, PARENT, HASH, SIZE, WHY, LINKS, ARTICLE = range(7)


class Node:
    """An element that isn't inline: its label, its children, why it isn't content (0: it may be), and whether an article holds it."""

    __slots__ = ("article", "children", "label", "tag", "why")

    def __init__(self, tag: str, label: str, why: int, article: bool):
        self.tag, self.label, self.why, self.article = tag, label, why, article
        self.children: list = []


class Block:
    """A run of text without a block's border in it, and how much of it links."""

    __slots__ = ("label", "linked", "text")

    def __init__(self, text: str, linked: float):
        self.label, self.text, self.linked = "#text", text, linked


def is_named(names: str) -> bool:
    return any(NAMED.fullmatch(n) for n in names.split())


def tree(page: str) -> Node:
    """The page's tree of elements and blocks. Any text gives one: missing, crossed and cut-off tags are put up with, at any depth."""
    root = Node("#root", "#root", 0, False)
    stack, opened, at, text, linked, links = [root], Counter(), 0, [], 0, 0

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                stack[-1].children.append(Block(whole, min(1.0, linked / max(1, sum(map(len, text))))))
            text.clear()
            linked = 0

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if links else 0

    def cut(k: int):
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(html.escape(m["cdata"]))
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if end:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE and opened[tag] <= 0:
                continue
            flush()
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if stack[k].tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html", "article", "main"):
                        break
            continue
        names = named(attrs) if attrs else ""
        # Within an article an id is a place to link to (a section may be called search), and a heading is content whatever it is called.
        told = names if not stack[-1].article else "" if not attrs or tag in ALL_HEADINGS else named(attrs, ids=False)
        if tag in INLINE and not (tag not in VOID and is_named(told)):
            if tag in ("br", "wbr"):
                add(" " if tag == "br" else "")
            links += tag == "a"
            continue
        flush()
        if tag in ENDS_P and stack[-1].tag == "p":
            cut(len(stack) - 1)
        if any(opened[c] > 0 for c in CLOSES.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    cut(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in ("body", "article", "main", "section", "div", "nav") and opened["head"] > 0:
            cut(next(k for k, n in enumerate(stack) if n.tag == "head"))
        up = stack[-1]
        main = tag in ("article", "main") or "role=main" in names
        if tag in DROPPED or (attrs and not up.article and HIDDEN.search(attrs)) or (tag == "article" and re.search(r"\bcomment|\bteaser", names)):
            why = BY_TAG
        elif not main and tag not in ("html", "body") and is_named(told):
            why = BY_NAME
        elif not up.article and (tag == "header" or re.search(r"(?:^|\s|site-|page-)header(?:\s|$)", names)):
            why = BY_HEADER
        else:
            why = 0
        node = Node(tag, f"{tag} {re.sub(r'[0-9]+', '0', names)}".strip(), up.why if up.why in (BY_TAG, BY_NAME) and why != BY_TAG else why or up.why, up.article or main)
        up.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1
        if tag not in INLINE:
            links = 0
    add(page[at:])
    flush()
    return root


def named(attrs: str, ids: bool = True) -> str:
    """The values of class, id (if asked for) and role; role=main is told apart."""
    found = []
    for m in ATTR.finditer(attrs):
        if m[1].lower() == "id" and not ids:
            continue
        value = m[2] or m[3] or m[4] or ""
        found.append("role=main" if m[1].lower() == "role" and value == "main" else value)
    return " ".join(found)


def skeleton(root: Node) -> tuple[list, list[list[tuple[str, float]]]]:
    """Nodes in page order (see LABEL and the following), and each node's blocks: text, and how much of it links.

    Elements that hold only text are leaves. Of three or more like leaves in a row, those between the first and the
    last are one repeated slot.
    """
    nodes, texts = [], []

    def add(label: str, parent: int, own: list[Block], why: int, article: bool) -> int:
        size, linked = sum(len(b.text) for b in own), sum(round(len(b.text) * b.linked) for b in own)
        value = hashlib.blake2b("\n".join(b.text for b in own).encode("utf-8", "replace"), digest_size=6).hexdigest() if own else ""
        nodes.append([label, parent, value, size, why, linked, int(article)])
        texts.append([(b.text, b.linked) for b in own])
        return len(nodes) - 1

    todo: list[tuple] = [(root, -1, None)]
    while todo:
        what, parent, leaf = todo.pop()
        if leaf is not None:
            add(leaf[0], parent, what, leaf[1], leaf[2])
            continue
        at = parent if what is root else add(what.label, parent, [], what.why, what.article)
        runs: list[list] = []  # like leaves in a row
        for c in what.children:
            if isinstance(c, Block):
                kind, own = (c.label, what.why, what.article), [c]
            elif all(isinstance(x, Block) for x in c.children):
                kind, own = (c.label, c.why, c.article), c.children
            else:
                runs.append([None, c])
                continue
            if runs and runs[-1][0] == kind:
                runs[-1][1].append(own)
            else:
                runs.append([kind, [own]])
        more: list[tuple] = []
        for kind, own in runs:
            if kind is None:
                more.append((own, at, None))
            elif len(own) < 3:
                more += [(o, at, kind) for o in own]
            else:
                more += [(own[0], at, kind), ([b for o in own[1:-1] for b in o], at, (kind[0] + "+", *kind[1:])), (own[-1], at, kind)]
        todo += reversed(more)
    return nodes, texts


def layout(nodes: list) -> int:
    """What tells layouts of a host apart: the outer elements that can hold others."""
    path, outer = [], set()
    inner = {n[PARENT] for n in nodes}
    for k, n in enumerate(nodes):
        depth, up = (path[n[PARENT]] if n[PARENT] >= 0 else (0, ""))
        path.append((depth + 1, f"{up}/{n[LABEL]}"))
        if depth < OUTER and k in inner and not n[ARTICLE]:
            outer.add(path[-1][1])
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(outer)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def shapes(nodes: list) -> tuple[list[list[int]], list[int], list[int]]:
    """Children (of node -1 at the end), shapes (equal for subtrees of equal labels) and sizes of all subtrees."""
    kids: list[list[int]] = [[] for _ in range(len(nodes) + 1)]
    shape, size = [0] * len(nodes), [1] * len(nodes)
    for k, n in enumerate(nodes):
        kids[n[PARENT]].append(k)
    for k in range(len(nodes) - 1, -1, -1):
        shape[k] = hash((nodes[k][LABEL], *[shape[c] for c in kids[k]]))
        size[k] += sum(size[c] for c in kids[k])
    return kids, shape, size


def matched(a: list, b: list, band: int = 0) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes, in order, under matched parents with equal labels, as many as there can be.

    Subtrees of one shape match whole. What siblings have alike at both ends matches so; the rest is aligned within
    band places (BAND, if none are given) of its diagonal, so that the work grows with the siblings, not their square.
    """
    band = band or BAND
    (kids_a, shape_a, size_a), (kids_b, shape_b, size_b) = shapes(a), shapes(b)
    done: dict[tuple[int, int], tuple[int, list]] = {}

    def forest(i: int, j: int):
        """Yields pairs of nodes whose forests it needs, and is sent their sizes; leaves the size and the children that match."""
        left, right = kids_a[i], kids_b[j]
        lo, hi, total, pairs = 0, 0, 0, []
        short = min(len(left), len(right))
        while lo < short and shape_a[left[lo]] == shape_b[right[lo]]:
            pairs.append((left[lo], right[lo]))
            total += size_a[left[lo]]
            lo += 1
        while hi < short - lo and shape_a[left[-1 - hi]] == shape_b[right[-1 - hi]]:
            pairs.append((left[-1 - hi], right[-1 - hi]))
            total += size_a[left[-1 - hi]]
            hi += 1
        left, right = left[lo : len(left) - hi], right[lo : len(right) - hi]
        tall, wide = len(left), len(right)
        rows = [(0, [0] * (min(wide, band) + 1))]  # of each row: its first place on the right, best sizes from there on
        get = lambda x, y: rows[x][1][y - rows[x][0]] if 0 <= y - rows[x][0] < len(rows[x][1]) else -1
        for x in range(1, tall + 1) if wide else ():
            first, last = max(0, (x - 1) * wide // tall - band), min(wide, x * wide // tall + band)
            row, l = [], left[x - 1]
            rows.append((first, row))
            for y in range(first, last + 1):
                best = max(get(x - 1, y), row[-1] if row else 0)
                if y and a[l][LABEL] == b[right[y - 1]][LABEL] and (before := get(x - 1, y - 1)) >= 0:
                    r = right[y - 1]
                    best = max(best, before + (size_a[l] if shape_a[l] == shape_b[r] else 1 + (yield l, r)))
                row.append(best)
        x, y = tall, wide
        if tall and wide:
            total += get(x, y)
        while x and y:
            here = get(x, y)
            if here == get(x - 1, y):
                x -= 1
            elif here == get(x, y - 1):
                y -= 1
            else:
                x, y = x - 1, y - 1
                pairs.append((left[x], right[y]))
        done[i, j] = total, pairs

    calls, sent = [(-1, -1, forest(-1, -1))], None
    while calls:
        i, j, call = calls[-1]
        try:
            need = call.send(sent)
        except StopIteration:
            calls.pop()
            sent = done[i, j][0]
            continue
        sent = done[need][0] if need in done else None
        if sent is None:
            calls.append((*need, forest(*need)))
    out, todo = [], [(-1, -1)]
    while todo:
        for l, r in done[todo.pop()][1]:
            if shape_a[l] == shape_b[r]:
                out += zip(range(l, l + size_a[l]), range(r, r + size_b[r]), strict=True)
            else:
                out.append((l, r))
                todo.append((l, r))
    return out


def nearest(nodes: list, wrapper: list[list]) -> tuple[int, list[tuple[int, int]]]:
    """The wrapper's page with which most nodes match, and the pairs (its node, own node)."""
    pairs = [matched(w, nodes) for w in wrapper]
    k = max(range(len(pairs)), key=lambda i: (len(pairs[i]), -i))
    return k, pairs[k]


def judged(page: list, votes: list[tuple[int, int, int, int]]) -> tuple[list[bool], list[bool] | None]:
    """Of a wrapper's page, by its nodes' votes (pages, with its text, characters, linked ones): which nodes are template, and which are in the content's region (None: none is told).

    The region is the innermost element that holds REGION of the varying text that neither links nor is dropped by tag
    or name; it ends at an article, or where a heading stands beside what it would go into.
    """
    constant = [n[SIZE] > 0 and p >= MIN_PAGES and s >= CONSTANT * p for n, (p, s, _, _) in zip(page, votes, strict=True)]
    mass = [0 if c or n[WHY] else max(0, chars - linked) for n, c, (_, _, chars, linked) in zip(page, constant, votes, strict=True)]
    total, kids = list(mass), shapes(page)[0]
    for k in range(len(page) - 1, -1, -1):
        if page[k][PARENT] >= 0:
            total[page[k][PARENT]] += total[k]
    whole, inside = sum(mass), None
    if whole and max(p for p, *_ in votes) >= MIN_PAGES:
        at = -1
        while True:
            if at >= 0 and (page[at][LABEL].split(" ")[0] in ("article", "main") or any(page[c][LABEL].split(" ")[0].rstrip("+") in HEADINGS and not page[c][WHY] for c in kids[at])):
                break
            into = [c for c in kids[at] if kids[c] and total[c] >= REGION * whole]
            if not into:
                break
            at = into[0]
        while at >= 0 and page[at][ARTICLE] and page[at][PARENT] >= 0 and page[page[at][PARENT]][ARTICLE]:
            at = page[at][PARENT]  # the whole article
        if at >= 0 and page[at][LABEL].split(" ")[0] not in ("html", "body"):
            inside = [False] * len(page)
            for k, n in enumerate(page):
                inside[k] = k == at or n[PARENT] >= 0 and inside[n[PARENT]]
    # Characters of the constant nodes that could be content, against all of it: most of an article isn't its template.
    live = {k for k, n in enumerate(page) if not n[WHY] and (inside is None or inside[k])}
    if sum(votes[k][2] for k in live if constant[k]) > COPIES * sum(votes[k][2] for k in live):
        constant = [c and k not in live for k, c in enumerate(constant)]
    return constant, inside


def main_text(page: str, wrapper: list | None = None) -> str:
    """The page's content; see content."""
    return content(*skeleton(tree(page)), wrapper)


def content(nodes: list, texts: list, wrapper: list | None = None) -> str:
    """The content of a page's skeleton. wrapper: (skeleton, template, region) of each of its layout's pages.

    Blocks in the wrapper's region that are no template; without a region, those in an article or main element; without
    one, all, but for lists of links. What tags drop is dropped throughout, and what names do, unless names would take
    most of the text.
    """
    template, inside = [False] * len(nodes), None
    if wrapper and nodes:
        k, pairs = nearest(nodes, [w[0] for w in wrapper])
        own, flags, region = wrapper[k]
        to = {j: i for i, j in pairs}
        template = [j in to and flags[to[j]] and own[to[j]][HASH] == n[HASH] for j, n in enumerate(nodes)]
        if region is not None:
            inside = [False] * len(nodes)
            for j, n in enumerate(nodes):
                inside[j] = region[to[j]] if j in to else n[PARENT] >= 0 and inside[n[PARENT]]
    article = [bool(n[ARTICLE]) for n in nodes]
    for where in (article, None) if inside is None else (inside, article, None):
        if where is not None and not any(w and n[SIZE] and n[WHY] != BY_TAG for w, n in zip(where, nodes, strict=True)):
            continue
        live = [j for j, n in enumerate(nodes) if n[SIZE] and n[WHY] not in (BY_TAG, BY_HEADER) and not template[j] and (where is None or where[j])]
        by_name = sum(nodes[j][SIZE] for j in live if nodes[j][WHY] == BY_NAME)
        if where is None or 2 * by_name <= sum(nodes[j][SIZE] for j in live):
            live = [j for j in live if nodes[j][WHY] != BY_NAME]
        blocks = [(b, nodes[j]) for j in live for b in texts[j]]
        if where is None:
            blocks = [x for k, x in enumerate(blocks) if not is_menu(blocks, k)]
        return "\n\n".join(text for (text, _), _ in blocks)
    return ""


def is_menu(blocks: list[tuple[tuple[str, float], list]], k: int) -> bool:
    """Whether a block is mostly links, and stands in a list or beside another such block; a lone sentence that links isn't."""
    if blocks[k][0][1] <= LINKED:
        return False
    beside = [blocks[i][0][1] > LINKED for i in (k - 1, k + 1) if 0 <= i < len(blocks)]
    return blocks[k][1][LABEL].split(" ")[0].rstrip("+") in LISTED or any(beside)


def _parsed():
    """page_id, url, host, layout, fp (hash of what can be content), skeleton and blocks of each page, so that pages are parsed once."""
    names = ["page_id", "url", "host", "layout", "fp", "skeleton", "blocks"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                rows, part = [], b.slice(lo, 100)
                for page_id, url, host, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
                    nodes, texts = skeleton(tree(page))
                    own = "".join(n[HASH] for n in nodes if not n[WHY])
                    fp = int.from_bytes(hashlib.blake2b(own.encode(), digest_size=8).digest(), "little", signed=True)
                    rows.append((page_id, url, host, layout(nodes), fp, json.dumps(nodes, ensure_ascii=False, separators=(",", ":")), json.dumps(texts, ensure_ascii=False, separators=(",", ":"))))
                yield _batch(rows, names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return run, "page_id long, url string, host string, layout long, fp long, skeleton string, blocks string"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names)


class Known(dict):
    """What a task keeps of the layouts that it meets; emptied where they are many."""

    def __init__(self, make, most: int = 2_000):
        self.make, self.most = make, most

    def of(self, key, *args):
        if key not in self:
            if len(self) > self.most:
                self.clear()
            self[key] = self.make(*args)
        return self[key]


def _votes():
    """host, layout, wrapper's page, its node, pages aligned, pages with its text, characters, linked ones: summed within the batch."""

    def run(batches):
        known = Known(lambda b, i: [json.loads(w) for w in b.column("wrapper")[i].as_py()])
        for b in batches:
            total: dict[tuple, list[int]] = {}
            for i, (host, of, page) in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "layout", "skeleton")), strict=True)):
                own, nodes = known.of((host, of), b, i), json.loads(page)
                k, pairs = nearest(nodes, own)
                for w, j in pairs:
                    v = total.setdefault((host, of, k, w), [0, 0, 0, 0])
                    v[0] += 1
                    v[1] += own[k][w][HASH] == nodes[j][HASH]
                    v[2] += nodes[j][SIZE]
                    v[3] += nodes[j][LINKS]
            yield _batch([(*key, *v) for key, v in total.items()], ["host", "layout", "k", "node", *VOTES], [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4])

    return run, "host string, layout long, k int, node int, pages long, same long, chars long, linked long"


VOTES = ["pages", "same", "chars", "linked"]


def _made(b: pa.RecordBatch, i: int) -> list | None:
    """The wrapper of a row's layout, as content takes it."""
    wrapper, votes = b.column("wrapper")[i].as_py(), b.column("votes")[i].as_py()
    if not wrapper:
        return None
    pages = [json.loads(w) for w in wrapper]
    counts = [[(0, 0, 0, 0)] * len(p) for p in pages]
    for v in votes or []:
        counts[v["k"]][v["node"]] = tuple(v[n] for n in VOTES)
    return [(p, *judged(p, c)) for p, c in zip(pages, counts, strict=True)]


def _texts():
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        known = Known(_made)
        for b in batches:
            out = []
            for i, (host, of, nodes, texts) in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "layout", "skeleton", "blocks")), strict=True)):
                out.append(content(json.loads(nodes), json.loads(texts), known.of((host, of), b, i)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names)

    return run, "page_id long, url string, text string, n_chars long"


def induced(pages: DataFrame) -> DataFrame:
    """host, layout, wrapper (skeletons of up to WRAPPERS of its pages) and votes (k, node and VOTES) for each layout of pages (as _parsed gives them) that has MIN_PAGES pages of different content.

    The pages that serve are those with the smallest hashes, so the choice is the same in every run. Sums are combined
    in each task before they are shuffled; the count of wrappers follows the layouts.
    """
    made = staged(pages.groupBy("host", "layout", "fp").agg(F.min("skeleton").alias("skeleton")), "skeletons")
    slots = made.groupBy("host", "layout", F.pmod("fp", F.lit(WRAPPERS)).alias("slot")).agg(F.count("*").alias("n"), F.min(F.struct("fp", "skeleton")).alias("x"))
    wrappers = slots.groupBy("host", "layout").agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["skeleton"]).alias("wrapper"))
    wrappers = staged(wrappers.where(f"n >= {MIN_PAGES}").drop("n"), "wrappers")
    run, schema = _votes()
    votes = made.drop("fp").join(small(wrappers, BROADCAST_LAYOUTS), ["host", "layout"]).mapInArrow(run, schema)
    votes = votes.groupBy("host", "layout", "k", "node").agg(*[F.sum(v).alias(v) for v in VOTES])
    votes = votes.groupBy("host", "layout").agg(F.collect_list(F.struct("k", "node", *VOTES)).alias("votes"))  # bounded by the wrapper's nodes
    return staged(wrappers.join(votes, ["host", "layout"]), "induced")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for each row of pages (page_id, url, html; others are ignored).

    Null and empty html give an empty text. Pages without a host, or with a null url, are one host's. Repeated rows get
    equal answers; null ids stay. An empty table gives no row. Pages of any depth and length are read whole. Layouts
    of fewer than MIN_PAGES pages have no wrapper: tags and names alone tell.
    """
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    run, schema = _parsed()
    rows = staged(p.mapInArrow(run, schema), "parsed")
    wrappers = small(induced(rows), BROADCAST_LAYOUTS)
    run, schema = _texts()
    return rows.join(wrappers, ["host", "layout"], "left").mapInArrow(run, schema)
