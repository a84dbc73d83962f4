"""Main text of web pages: site templates are found by counting element subtrees per host.

Every page is parsed into a tree, and its subtrees are hashed in two ways before anything is deleted:

* with their text: a subtree that recurs word for word on many pages of its host is deleted;
* by their skeleton, the tags and class words below an element with repeated children counted once: menus,
  adverts and footers keep it while their words change. Skeletons are taken outside the page's content
  (its marked article or main part, else the chain of elements that hold half of the words), and one that
  recurs is deleted if it is short or mostly links. A plain box or block of prose has no skeleton to tell.

Spark counts on how many different pages of a host each occurs; pages with the same text count once, so
that copies of an article under several addresses are no template. Many means at least 3, half of the
host's pages up to 10 of them, and a tenth of them all up to ``MANY``. Blocks of prose in an article must
recur word for word on 10 pages at least, and stay where they are more than half of a page's text, as in
near copies of one article; its words in bold and the like and its table cells are never deleted alone.
Templates reach the pages by host where they are few, else by (host, subtree) in a shuffle.

On hosts with few pages nothing can be counted, so elements whose role is plain from the markup (menus,
headers, footers, sidebars, notices, adverts, forms, comments) go in addition; ``by_markup=False`` leaves
these rules out and takes the whole page, so that templates alone decide.

Text: character references are decoded, white space inside a block becomes one space, and blocks are
joined in page order by line ends. Where a page marks its article, the text is taken from there.

Defined results: NULL html is an empty page (empty text, 0 characters); a NULL or odd url has the
empty host; unclosed and stray tags are repaired as browsers do in the common cases; repeated rows and
NULL ids are carried; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, save

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open elements a start tag closes, and where the search for them ends.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "tr": ("tr td th", "table thead tbody tfoot"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot", "table"), "thead": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
PARAGRAPH = frozenset(["p"])
P_SCOPE = frozenset("table td th caption button object html".split())

#: Elements that are never main text, and the words in class, id or role that say so.
DROPPED = frozenset("head script style noscript template iframe nav footer aside form button select textarea input label svg canvas object embed dialog menu audio video map".split())
NAMED = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs pagination pager sidebar rail footer foot masthead topbar toolbar ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login search form share sharing social related recommended comment comments disqus respond reply replies copyright legal skip hidden widget "
    "contentinfo complementary dialog".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr b i em strong span a code q cite u s small mark sub sup".split())


#: Prose that may be a template itself if it recurs in articles: whole blocks.
PROSE_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt tr".split())
#: Never shown as text.
HIDDEN = frozenset("head script style noscript template".split())
#: Elements whose skeleton says something without class, id or role; plain boxes and prose say nothing.
SECTIONS = frozenset("nav footer header aside form menu address dialog".split())
#: A skeleton's mean words up to which it is short; the share of its words in links from which it is a menu.
SHORT_WORDS, LINK_SHARE = 15, 0.5
#: Pages that are enough on any host; pages that are needed for a block of an article.
MANY, PROSE_PAGES = 50, 10


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "whole", "skeleton")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.digest, self.whole, self.skeleton = tag, attributes, [], 0, 0, 0


def parse(source: str) -> Node:
    """A tolerant tree of elements and texts."""
    root = Node("html")
    stack, at = [root], 0
    open_: Counter = Counter()  # how often a tag is open, so that deep pages are not searched in vain
    while True:
        found = TAG.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if text:
            stack[-1].children.append(text)
        if not found:
            return root
        at = found.end()
        tag = found.group(2) or found.group(5)
        if tag is None:
            continue  # comment, doctype or instruction
        tag = tag.lower()
        if found.group(1) or found.group(4):
            if open_[tag]:
                while True:
                    gone = stack.pop().tag
                    open_[gone] -= 1
                    if gone == tag:
                        break
            continue
        if tag in ("html", "body"):
            root.attributes += found.group(3) or found.group(6) or ""
            continue
        if tag in BLOCK:
            _close(stack, open_, PARAGRAPH, P_SCOPE)
        if tag in CLOSES:
            _close(stack, open_, *CLOSES[tag])
        node = Node(tag, found.group(3) or found.group(6) or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            if tag in ("textarea", "title"):
                node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif tag not in VOID and not node.attributes.rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
        elif tag not in VOID and tag in BLOCK:
            stack.append(node)  # a slash does not close these
            open_[tag] += 1


def _close(stack: list[Node], open_: Counter, tags: frozenset, until: frozenset) -> None:
    if not any(open_[t] for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            open_.subtract(n.tag for n in stack[i:])
            del stack[i:]
            return
        if stack[i].tag in until:
            return


def is_furniture(node: Node, in_article: bool) -> bool:
    """Whether tag, class, id or role say that the element is not main text."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attributes or node.tag in ("main", "h1"):
        return False
    for name, value in ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in ("class", "id", "role") and not NAMED.isdisjoint(WORDS.findall(value)):
            # a wrapper may be named after its sidebar
            return node.tag == "article" or not _holds(node, ("article", "main", "h1"))
    return False


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n is not node and n.tag in tags:
            return True
        todo += [c for c in n.children if not isinstance(c, str)]
    return False


def strip(node: Node, in_article: bool = False) -> None:
    """Delete furniture below ``node``."""
    todo = [(node, in_article)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        n.children = [c for c in n.children if isinstance(c, str) or not is_furniture(c, inside)]
        todo += [(c, inside) for c in n.children if not isinstance(c, str)]


def roots(page: Node) -> list[Node]:
    """The outermost articles; else the main part; else the page."""
    for wanted in ("article", "main"):
        found, todo = [], [page]
        while todo:
            n = todo.pop()
            if n.tag == wanted:
                found.append(n)
            else:
                todo += [c for c in reversed(n.children) if not isinstance(c, str)]
        if found:
            return found
    return [page]


def text_of(nodes: list[Node], dropped: frozenset | set = frozenset()) -> str:
    """Blocks in page order, one per line; subtrees whose hash is dropped are left out."""
    blocks: list[list[str]] = [[]]
    for root in nodes:
        todo: list = [root]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                blocks[-1].append(n)
                continue
            if n is None:
                blocks.append([])
                continue
            if dropped and (n.digest in dropped or n.whole in dropped or n.skeleton in dropped):
                continue
            if n.tag == "br":
                blocks[-1].append(" ")
            block = n.tag in BLOCK
            if block:
                blocks.append([])
                todo.append(None)
            todo += reversed(n.children)
        blocks.append([])
    lines = []
    for b in blocks:
        if b:
            line = "".join(b)
            line = " ".join((html.unescape(line) if "&" in line else line).split())
            if line:
                lines.append(line)
    return "\n".join(lines)


def hash_subtrees(nodes: list[Node]) -> list[int]:
    """Hash the subtrees that may be a template and return their hashes, each once; odd ones are blocks of an article."""
    out: dict[int, None] = {}

    def walk(root: Node) -> None:
        order, todo = [], [(root, False)]
        while todo:
            n, inside = todo.pop()
            inside = inside or n.tag in ("article", "main")
            order.append((n, inside))
            todo += [(c, inside) for c in n.children if not isinstance(c, str)]
        digests: dict[int, bytes] = {}
        for n, inside in reversed(order):
            h = xxhash.xxh3_64(n.tag)
            words = False
            for c in n.children:
                if isinstance(c, str):
                    squeezed = " ".join(c.split())
                    if squeezed:
                        h.update(squeezed)
                        words = True
                else:
                    h.update(digests[id(c)])
                    words = words or digests[id(c)][-1:] == b"\1"
            digests[id(n)] = h.digest() + (b"\1" if words else b"\0")
            prose = inside and n.tag in PROSE
            if words and n.tag not in ("html", "article", "main") and not (prose and n.tag not in PROSE_BLOCK):
                value = h.intdigest() & ~1 | int(prose)
                n.digest = value - (1 << 64) if value >= 1 << 63 else value
                out[n.digest] = None

    for root in nodes:
        walk(root)
    return list(out)


def _words(node: Node) -> dict[int, tuple[int, int]]:
    """Words, and words in links, of every element below ``node``, by its id()."""
    order, todo = [], [(node, False)]
    while todo:
        n, link = todo.pop()
        link = link or n.tag in ("a", "button")
        order.append((n, link))
        todo += [(c, link) for c in n.children if not isinstance(c, str) and c.tag not in HIDDEN]
    out: dict[int, tuple[int, int]] = {}
    for n, link in reversed(order):
        words = links = 0
        for c in n.children:
            if isinstance(c, str):
                k = len(c.split())
                words, links = words + k, links + k * link
            elif id(c) in out:
                words, links = words + out[id(c)][0], links + out[id(c)][1]
        out[id(n)] = (words, links)
    return out


def outside(page: Node) -> list[Node]:
    """The elements beside the page's content: what hangs off the way from the root to it."""
    way: set[int] = set()
    content = roots(page)
    if content != [page]:
        ends = {id(n) for n in content}
        stack: list[tuple[Node, bool]] = [(page, False)]
        while stack:  # the ancestors of the content
            n, back = stack.pop()
            elements = [c for c in n.children if not isinstance(c, str)]
            if back:
                if any(id(c) in way or id(c) in ends for c in elements):
                    way.add(id(n))
            elif id(n) not in ends:
                stack.append((n, True))
                stack += [(c, False) for c in elements]
        found, todo = [], [page]
        while todo:
            n = todo.pop()
            for c in n.children:
                if not isinstance(c, str) and id(c) not in ends and c.tag not in HIDDEN:
                    (todo if id(c) in way else found).append(c)
        return found
    words, found, n = _words(page), [], page
    whole = words[id(page)][0]
    while True:
        elements = [c for c in n.children if not isinstance(c, str) and id(c) in words]
        inner = next((c for c in elements if 2 * words[id(c)][0] >= whole), None)
        if inner is None or not whole:
            return found
        found += [c for c in elements if c is not inner]
        n = inner


def name_skeletons(page: Node) -> list[tuple[int, int, int]]:
    """(skeleton, words, words in links) of the elements outside the content, each skeleton once; sets ``skeleton``."""
    out: dict[int, tuple[int, int]] = {}
    for top in outside(page):
        words, order, todo = _words(top), [], [top]
        while todo:
            n = todo.pop()
            order.append(n)
            todo += [c for c in n.children if not isinstance(c, str) and id(c) in words]
        for n in reversed(order):
            h, named = xxhash.xxh3_64(n.tag, seed=11), n.tag in SECTIONS
            for name, value in ATTRIBUTE.findall(n.attributes):
                if name.lower() in ("class", "id", "role"):
                    h.update("." + ".".join(sorted(WORDS.findall(value.lower()))))
                    named = True
            for key in sorted({c.skeleton for c in n.children if not isinstance(c, str) and id(c) in words}):
                h.update(key.to_bytes(8, "little", signed=True))
            value = h.intdigest() & ~1
            n.skeleton = value - (1 << 64) if value >= 1 << 63 else value
            w, links = words[id(n)]
            if w and (named or links >= LINK_SHARE * w) and n.tag not in PROSE_BLOCK:
                a, b = out.get(n.skeleton, (0, 0))
                out[n.skeleton] = (a + w, b + links)
    return [(k, w, links) for k, (w, links) in out.items()]


def host() -> Column:
    return F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))


def _read(source: str) -> list[Node]:
    page = parse(source)
    strip(page)
    return roots(page)


def _hashed(source: str, by_markup: bool = True) -> tuple[list[Node], list[int], list[tuple[int, int, int]]]:
    """The parts of a page that hold its text, the hashes of its subtrees with and without furniture, and its skeletons."""
    page = parse(source)
    skeletons = name_skeletons(page)
    found = dict.fromkeys(hash_subtrees([page]))
    if not by_markup:
        todo = [page]
        while todo:
            n = todo.pop()
            n.children = [c for c in n.children if isinstance(c, str) or c.tag not in HIDDEN]
            todo += [c for c in n.children if not isinstance(c, str)]
        return [page], list(found), skeletons
    todo = [page]
    while todo:
        n = todo.pop()
        n.whole, n.digest = n.digest, 0
        todo += [c for c in n.children if not isinstance(c, str)]
    strip(page)
    found.update(dict.fromkeys(hash_subtrees([page])))
    return roots(page), list(found), skeletons


def _inventory(by_markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, subtrees, skeletons = [], [], []
            for source in batch.column(2):
                nodes, found, shapes = _hashed(source.as_py() or "", by_markup)
                subtrees.append(found)
                skeletons.append([{"subtree": k, "words": w, "links": n} for k, w, n in shapes])
                same.append(xxhash.xxh3_64_intdigest(text_of(nodes)) >> 1)
            kind = pa.list_(pa.struct([("subtree", pa.int64()), ("words", pa.int64()), ("links", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.int64()), pa.array(subtrees, pa.list_(pa.int64())), pa.array(skeletons, kind)], ["host", "page", "same", "subtrees", "skeletons"]
            )

    return run


INVENTORY = "host string, page string, same long, subtrees array<long>, skeletons array<struct<subtree: long, words: long, links: long>>"


def inventory(base: DataFrame, by_markup: bool = True) -> DataFrame:
    """(host, page, same, subtrees, skeletons) of every page; ``page`` stands for its html, ``same`` for its text."""
    rows = base.select(host().alias("host"), page().alias("page"), "html")
    return save(rows.mapInArrow(_inventory(by_markup), INVENTORY), "subtrees")


def page() -> Column:
    return F.md5(F.coalesce("html", F.lit("")).cast("binary"))


def find_templates(rows: DataFrame) -> DataFrame:
    """(host, subtree): hashes of the subtrees and skeletons that recur on many pages of the host."""
    # of pages with one text the one with the least digest of its html counts
    once = rows.groupBy("host", "same").agg(F.min_by(F.struct("subtrees", "skeletons"), "page").alias("r")).select("host", "r.*")
    sizes = once.groupBy("host").agg(F.count("*").alias("pages"))
    exact = once.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).where("n >= 3")
    shapes = once.select("host", F.inline("skeletons")).groupBy("host", "subtree").agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.sum("links").alias("l")).where("n >= 3")
    shapes = shapes.where((F.col("w") <= SHORT_WORDS * F.col("n")) | (F.col("l") >= LINK_SHARE * F.col("w"))).select("host", "subtree", "n")
    need = F.greatest(F.lit(3.0), F.least(F.lit(10.0), F.col("pages") / 2), F.least(F.lit(float(MANY)), F.col("pages") / 10))
    need = F.when(F.col("subtree").bitwiseAND(F.lit(1)) == 1, F.greatest(F.lit(float(PROSE_PAGES)), need)).otherwise(need)
    return exact.union(shapes).join(sizes, "host").where(F.col("n") >= need).select("host", "subtree").distinct()


def _extract(by_markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, templates in zip(batch.column(2), batch.column(3)):
                if by_markup and not templates.is_valid:
                    texts.append(text_of(_read(source.as_py() or "")))
                    continue
                nodes, _, _ = _hashed(source.as_py() or "", by_markup)
                dropped = set(templates.as_py() or ())
                text = text_of(nodes, {t for t in dropped if not t & 1})
                less = text_of(nodes, dropped)
                texts.append(less if 2 * len(less) >= len(text) else text)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return run


#: Templates in all, and of one host, up to which they are broadcast by host; beyond it they meet the pages by shuffle.
BROADCAST_TEMPLATES, HOST_TEMPLATES = 200_000, 2_000


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_TEMPLATES, by_markup: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. Without ``by_markup`` only templates are deleted."""
    base = only(pages, page_id="long", url="string", html="string")
    rows = inventory(base, by_markup)
    found = save(find_templates(rows), "templates")
    most = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    keyed = base.withColumn("host", host())
    if most[0] <= broadcast_rows and most[1] <= HOST_TEMPLATES:
        joined = keyed.join(F.broadcast(found.groupBy("host").agg(F.collect_list("subtree").alias("templates"))), "host", "left")
    else:
        every = F.array_union("subtrees", F.transform("skeletons", lambda x: x["subtree"]))
        held = rows.select("host", "page", F.explode(every).alias("subtree")).distinct().join(found, ["host", "subtree"])
        lists = held.groupBy("host", "page").agg(F.collect_list("subtree").alias("templates"))
        joined = keyed.withColumn("page", page()).join(lists, ["host", "page"], "left")
    return joined.select("page_id", "url", "html", "templates").mapInArrow(_extract(by_markup), "page_id long, url string, text string, n_chars long")
