"""Main-text extraction with site template removal.

A small HTML parser builds each page's element tree and hashes all subtrees. Spark counts, per host,
on how many different pages each subtree occurs; subtrees on many of a host's pages are its template
and are deleted, along with elements whose kind or class says that they aren't the article. A menu
whose words change from page to page has another hash on each, so subtrees that are mostly links are
also counted by their shape: the tags and marks from the page's root down, without words.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, small_batches
from .url_filter import host_and_path

#: A subtree is template if it is on at least so many different pages of its host, and on this share of them.
LEAST_PAGES, SHARE = 5, 0.5
#: Template hashes of all hosts that are broadcast at most (a few MB).
MOST_BROADCAST = 300_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements without content, with raw content, and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: What isn't article text by its element.
DROPPED = frozenset(
    """aside audio button canvas dialog embed fieldset footer form frame frameset head header iframe input label legend link math menu
    meta nav noembed noframes noscript object optgroup option script select style svg template textarea title video""".split()
)
_P_ENDS = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Parts of a class, id or role that mark what isn't the article: whole parts, as hyphens, low lines and capitals separate them.
MARKED = frozenset(
    """ad ads adsense adslot advert advertisement advertising adverts alert banner banners breadcrumb breadcrumbs comment comments complementary consent
    contentinfo cookie cookies disqus footer footers gdpr hidden login masthead menu menubar menus modal nav navbar navigation newsletter notice notices overlay
    pager pagination paywall popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar sidebars signup
    skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets""".split()
)
#: Parts that do so only together, and a header's, which inside an article is the title's unless it is the site's.
MARKED_PAIRS = (("top", "bar"), ("tool", "bar"), ("nav", "bar"), ("side", "bar"), ("sign", "up"), ("log", "in"), ("bread", "crumb"), ("bread", "crumbs"), ("bottom", "bar"))
OF_SITE = frozenset("site page global top main".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A subtree counts by its shape if it has so many links or more, and this share of its words in them.
LEAST_LINKS, LINK_SHARE = 3, 0.6


class Node:
    __slots__ = ("tag", "marks", "children", "hash", "shape", "words", "linked", "links")

    def __init__(self, tag: str, marks: str):
        self.tag, self.marks, self.children = tag, marks, []
        self.hash = self.shape = 0  # of the subtree with its words; of the way to it from the root, if it is mostly links
        self.words = self.linked = self.links = 0


def parse(source: str | None) -> Node:
    """The page's tree: children are nodes or decoded strings. Every input gives a tree; unclosed elements end with their parent."""
    root = Node("#page", "")
    stack, at, source = [root], 0, source or ""
    opened: Counter[str] = Counter()  # by tag, the elements in the stack: an end tag without one costs no search
    end = len(source)

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].children.append(references.unescape(source[a:b]))

    def close(i: int) -> None:
        opened.subtract(node.tag for node in stack[i:])
        del stack[i:]

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not (name := m.group(2)):
            if m.group().startswith("<![CDATA["):
                stack[-1].children.append(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[i].tag == name:
                    close(i)
                    break
                if stack[i].tag in ("table", "article", "main", "body") and name not in BLOCKS:
                    break
            continue
        if name in _P_ENDS and opened["p"] > 0:  # a block ends an open paragraph, and the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        if name in _CLOSES and any(opened[x] > 0 for x in _CLOSES[name][0]):
            same, scope = _CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in same:
                    close(i)
                    break
        attributes = m.group(3)
        marks = ""
        if attributes and not attributes.isspace():
            marks = " ".join(f"{k.lower()}={v.strip(chr(34) + chr(39))}" if k.lower() in ("class", "id", "role") else f"{k.lower()}:{v}" for k, v in _NAMED.findall(attributes))
        node = Node(name, marks)
        stack[-1].children.append(node)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            last = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            node.children.append(source[at : last.start() if last else end])
            at = last.end() if last else end
            continue
        stack.append(node)
        opened[name] += 1
    return root


def hash_subtrees(root: Node) -> list[Node]:
    """Sets every node's hash from its tag, marks, text without outer space, and children's hashes, and the shape of
    what is mostly links from the tags and marks on the way to it; returns the elements below the root."""
    order, todo = [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        node.shape = xxhash.xxh3_64_intdigest(f"{above}\0{node.tag}\0{node.marks}")
        order.append(node)
        todo += [(c, node.shape) for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        h = xxhash.xxh3_64(f"{node.tag}\0{node.marks}")
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                node.words += c.words
                node.linked += c.linked
                node.links += c.links
            else:
                words = c.split()
                node.words += len(words)
                h.update(b"\1" + " ".join(words).encode("utf-8", "replace"))
        if node.tag == "a":
            node.links, node.linked = node.links + 1, node.words
        node.hash = h.intdigest()
        if node.links < LEAST_LINKS or node.linked < LINK_SHARE * node.words or node.tag in ("html", "body", "main", "article"):
            node.shape = 0
    return order[1:]


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def template_hashes(node: Node) -> list[int]:
    """What an element counts and goes by: its hash and shape, if it is a block that holds something. Inline elements are parts of sentences."""
    if node.tag not in BLOCKS or not any(node.children):
        return []
    return [signed(node.hash), signed(node.shape)] if node.shape else [signed(node.hash)]


def marked(value: str, inside: bool) -> bool:
    """Whether a class, id or role marks what isn't the article."""
    for word in value.split():
        parts = [p.lower() for p in _PARTS.findall(word)]
        if not MARKED.isdisjoint(parts) or any(pair in MARKED_PAIRS for pair in zip(parts, parts[1:])):
            return True
        if "header" in parts and (not inside or len(parts) == 1 or not OF_SITE.isdisjoint(parts)):
            return True
    return False


def unwanted(node: Node, inside: bool) -> bool:
    """Whether the element's kind or marks say that it isn't article text; ``inside``: of an article, where a plain header is the title's.

    An article element goes only if it is hidden or a reader's comment; html, body and main stay.
    """
    if node.tag in DROPPED and not (inside and node.tag == "header"):
        return True
    if not node.marks or node.tag in ("html", "body", "main"):
        return False
    for part in re.findall(r"(class|id|role|hidden|aria-hidden|style)([=:])(.*?)(?= (?:class|id|role)=| (?:hidden|aria-hidden|style):|$)", node.marks):
        kind, _, value = part
        if kind == "hidden" or kind == "aria-hidden" and "true" in value or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if kind not in ("class", "id", "role"):
            continue
        if node.tag == "article":
            if not _COMMENT.isdisjoint(p.lower() for p in _PARTS.findall(value)):
                return True
        elif marked(value, inside) and not (inside and node.tag == "header" and not MARKED.intersection(p.lower() for p in _PARTS.findall(value))):
            return True
    return False


_COMMENT = frozenset("comment comments reply replies".split())


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the article, white space inside each made one space, joined by an empty line.

    The article is the outermost article elements, else main, else the body or the whole page.
    """
    starts: list[Node] = []  # few, as a rule one
    for wanted in ("article", "main", "body"):
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == wanted and (wanted == "body" or not unwanted(node, False)):
                starts.append(node)
            elif wanted == "body" or not unwanted(node, False):
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if starts:
            break
    inside = bool(starts) and starts[0].tag != "body"
    blocks: list[list[str]] = [[]]
    todo: list[Node | str | None] = list(reversed(starts or [root]))
    while todo:
        item = todo.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item not in starts and (unwanted(item, inside) or template and not template.isdisjoint(template_hashes(item))):
            continue
        elif item.tag in ("br", "img", "wbr"):
            blocks[-1].append("" if item.tag == "wbr" else " ")
        else:
            block = item.tag in BLOCKS
            if block:
                blocks.append([])
                todo.append(None)
            todo += reversed(item.children)
    texts = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, same, hash): every different subtree of a page, and 0 for the page; same is a hash of its host and html.

    Subtrees count by their hash, and those that are mostly links by their shape as well.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            at: list[int] = []
            hashes: list[int] = []
            for i, source in enumerate(batch.column(2).to_pylist()):
                nodes = hash_subtrees(parse(source))
                own = {0}.union(*(template_hashes(node) for node in nodes))
                at += [i] * len(own)
                hashes += own
            rows = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes, pa.int64())], ["host", "same", "hash"])

        return one

    known = pages.where("html is not null").select(host_and_path(F.col("url"))[0].alias("host"), "html")
    return in_arrow(known.select("host", _same(), "html"), make, "host string, same long, hash long")


def _same():
    return F.xxhash64("host", "html").alias("same")


def templates(found: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash) of the ``subtrees`` on many different pages of the host.

    Pages of a host with the same html count once, so that copies of an article don't make a template
    of it: subtrees are first made distinct by page, which deals a large host to all tasks, and then
    counted, in each task before the shuffle. A host keeps at most elements-per-page / share hashes.
    """
    often = cut(found.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    total = often.where("hash = 0").select("host", F.col("n").alias("all"))
    return often.where("hash <> 0").join(total, "host").where(F.col("n") >= share * F.col("all")).select("host", "hash")


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per page: page_id, url, text (main text of the whole html, empty if none), n_chars (its code points).

    Null html counts as empty. Pages with a null or odd url share the empty host. Repeated rows stay.
    The article element itself is never template. An empty table gives an empty result; further columns
    are ignored.
    """
    small_batches(pages.sparkSession, 500)
    found = cut(subtrees(pages))
    known = cut(templates(found))
    own = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))
    if known.count() <= most_broadcast:
        # Few hashes go to all tasks, so that the pages stay where they are.
        by_host = known.groupBy("host").agg(F.collect_set("hash").alias("template"))
        with_template = own.join(F.broadcast(by_host), "host", "left")
    else:
        # Else subtrees meet their host's templates by (host, hash), and pages get what they have themselves: no host's pages meet in one task.
        by_page = found.distinct().join(known, ["host", "hash"]).groupBy("same").agg(F.collect_set("hash").alias("template"))
        with_template = own.withColumn("same", _same()).join(by_page, "same", "left")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                root = parse(source)
                if template:
                    hash_subtrees(root)
                out.append(main_text(root, set(template or ())))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return one

    return in_arrow(with_template.select("page_id", "url", "html", "template"), make, "page_id long, url string, text string, n_chars long")
