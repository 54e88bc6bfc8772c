"""Main text of web pages by consensus: containers are scored on each page, hosts agree on their paths, pages are read by them.

1. Every page is parsed once to a tree. Containers get a score: text of the blocks below them, less with each level between,
   less what is in links. The best one votes for its generalised path, tags with classes without digits from the body down.
2. Votes are summed per host and path in Spark (partial sums first, so a host with a third of all pages is no burden), and
   each host keeps the paths with a share of the votes, but none that leads to a path with more.
3. Every page is read again: its text is that of the nodes on the best of its host's paths that the page has, or else of its
   own best container. Boilerplate inside the container (menus, adverts, forms, comments, ...) is left out. Parts whose class
   or id may as well name a part of an article ("discussion", "popular", ...) stay unless they are mostly links or their text
   recurs on a fifth of their host's different pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements of the language, by what they are (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEAD = set("head title meta link script style base noscript template body".split())
CONTAINERS = set("article body center div main section td".split())
NEVER = set("script style noscript template iframe object embed svg canvas audio video button select option textarea input label head title nav footer aside form menu dialog noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = set("ul ol dl table body html div article section main blockquote".split())
#: Words in a class or id that tell boilerplate wherever they stand.
BOILERPLATE = re.compile(
    r"^(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|newsletters?|subscribe|subscription|signup|login|popups?|modals?|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|toolbar|sidebars?|widgets?|footer|masthead|site-?header|topbar|"
    r"comments?|replies|respond|disqus|share|sharing|tagcloud)$",
    re.I,
)
#: Words that may as well name a part of an article: they count only with evidence, see ``doubtful``.
DOUBTFUL = re.compile(r"^(?:notices?|alerts?|overlay|aside|rail|skip|reply|discussion|social|related|recommended|recommendations|trending|popular|tags?|toc|metadata|byline-share)$", re.I)
#: A doubtful part goes if so much of its text is in links, or if its text recurs on so many of its host's different pages.
LINKS, RECURS, PAGES = 0.5, 0.2, 3
#: The least share of its host's votes with which a path is kept, so at most 20 are.
SHARE = 0.05
#: So many hosts' paths (under 1 KB each) are broadcast at most; beyond it they are joined.
BROADCAST_HOSTS = 20_000


class Node:
    __slots__ = ("tag", "label", "kids", "parent", "skip", "doubt")

    def __init__(self, tag: str, label: str = "", parent: Node | None = None, skip: bool = False, doubt: bool = False):
        self.tag, self.label, self.kids, self.parent, self.skip, self.doubt = tag, label, [], parent, skip, doubt


def _words(value: str) -> list[str]:
    return re.findall(r"[A-Za-z][A-Za-z-]*", value)


def _node(tag: str, attributes: str, parent: Node) -> Node:
    classes: list[str] = []
    doubt = False
    skip = tag in NEVER or tag == "header" and not _within(parent, "article") and not _within(parent, "main")
    if attributes and attributes != "/":
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name == "class":
                classes = sorted({re.sub(r"\d+", "", w) for w in value.split()} - {""})
            if name in ("class", "id", "role", "aria-label") and tag not in ("body", "html", "article", "main"):
                for word in value.split():
                    parts = [word, *re.split(r"[-_]+", word)]
                    parts = parts if len(parts) <= 4 else parts[:1]
                    skip = skip or any(map(BOILERPLATE.match, parts))
                    doubt = doubt or any(map(DOUBTFUL.match, parts))
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                skip = True
    return Node(tag, ".".join([tag, *classes]) if tag != "body" else tag, parent, skip, doubt)


def _within(node: Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def parse(source: str) -> Node:
    """A tree of any input: unknown tags are inline, ends without a start are ignored, missing ends are implied."""
    root = at = Node("html", "html")
    body = None
    place = 0

    def inside() -> Node:
        """Where content goes: a body is implied."""
        nonlocal body
        if at is not root:
            return at
        if body is None:
            body = _node("body", "", root)
            root.kids.append(body)
        return body

    while place < len(source):
        m = TOKEN.search(source, place)
        text = source[place : m.start() if m else len(source)]
        if text and (at is not root or not text.isspace()):
            inside().kids.append(text)
        if m is None:
            break
        place = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent if tag not in ("b", "i", "em", "strong", "span", "a", "u", "font", "p") or node.tag not in BLOCKS else None
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag == "html" or tag == "body" and body is not None:
            continue
        if tag == "body":
            at = root
        elif tag not in HEAD:
            at = inside()
        if tag in BLOCKS:
            node = at
            while node is not None and node.tag != "p" and node.tag not in BLOCKS:
                node = node.parent
            if node is not None and node.tag == "p":
                at = node.parent
        if tag in CLOSES:
            node = at
            while node is not None and node.tag not in CLOSES[tag] and node.tag not in SCOPE:
                node = node.parent
            while node is not None and node.tag in CLOSES[tag]:
                at = node.parent
                node = at
        node = _node(tag, m[3], at)
        at.kids.append(node)
        if tag == "body":
            body = node
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, place)
            node.kids.append(source[place : end.start() if end else len(source)])
            place = end.end() if end else len(source)
            continue
        at = node
    return root


def path_of(node: Node) -> str:
    parts = []
    while node is not None and node.tag != "html":
        parts.append(node.label)
        node = node.parent
    return ">".join(reversed(parts))


def blocks(node: Node) -> list[str]:
    """Text of a node's blocks in page order, without boilerplate below it; white space is one space."""
    found: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = " ".join("".join(open_).split())
        open_.clear()
        if text:
            found.append(text)

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, i = stack.pop()
        if i == 0 and at.tag in BLOCKS:
            close()
        while i < len(at.kids):
            kid = at.kids[i]
            i += 1
            if isinstance(kid, str):
                open_.append(html.unescape(kid))
            elif kid.tag in ("br", "hr"):
                open_.append(" ") if kid.tag == "br" else close()
            elif not kid.skip:
                stack.append((at, i))
                stack.append((kid, 0))
                break
            elif kid.tag in BLOCKS:
                close()
        else:
            if at.tag in BLOCKS:
                close()
    close()
    return found


def scores(root: Node) -> list[tuple[float, Node]]:
    """Containers of a page with positive scores, best first; ties in page order."""
    found: dict[int, tuple[float, int, Node]] = {}

    def credit(node: Node, amount: float) -> None:
        up, share = node, 1.0
        while up is not None and share > 0.05:
            if up.tag in CONTAINERS and not up.skip:
                value, order, _ = found.get(id(up), (0.0, len(found), up))
                found[id(up)] = (value + amount * share * (1.5 if up.tag in ("article", "main") else 1.0), order, up)
                share *= 0.6
            up = up.parent

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        amount = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if amount:
            credit(node, -0.5 * amount if link else float(amount))
        stack.extend((k, link) for k in reversed(node.kids) if not isinstance(k, str) and not k.skip)
    ranked = sorted(found.values(), key=lambda x: (-x[0], x[1]))
    return [(value, node) for value, _, node in ranked if value > 0]


def nodes_on(root: Node, path: str) -> list[Node]:
    """The outermost nodes on a generalised path, in page order."""
    level = [root]
    for label in path.split(">"):
        level = [k for node in level for k in node.kids if not isinstance(k, str) and k.label == label and not k.skip]
    return level


def best(root: Node) -> Node | None:
    """The container with the best score, or the article that it's a part of: its title may stand outside that part."""
    for _, node in scores(root)[:1]:
        up = node
        while up is not None and up.tag != "article":
            up = up.parent
        return up if up is not None and not up.skip else node
    return None


def doubtful(root: Node) -> list[tuple[Node, str, bool]]:
    """The outermost nodes below ``root`` whose name leaves it open whether they are boilerplate: the node, a name for its text,
    and whether most of it is links."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.doubt:
            stack.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.skip)
            continue
        total = links = 0
        inside: list[tuple[Node, bool]] = [(node, node.tag == "a")]
        while inside:
            at, link = inside.pop()
            own = sum(len(k.strip()) for k in at.kids if isinstance(k, str))
            total, links = total + own, links + own * link
            inside.extend((k, link or k.tag == "a") for k in at.kids if not isinstance(k, str) and not k.skip)
        found.append((node, f"~{xxhash.xxh64_hexdigest(chr(10).join(blocks(node)).encode('utf-8', 'surrogatepass'))}", links >= LINKS * total))
    return found


def votes(source: str | None) -> list[tuple[str, int]]:
    """(path, 0) of the best container; (name, page) of each text whose part is doubtful, ``page`` telling different pages apart."""
    root = parse(source or "")
    node = best(root)
    if node is None:
        return []
    page = xxhash.xxh64_intdigest("\n".join(blocks(node)).encode("utf-8", "surrogatepass")) >> 1
    return [(path_of(node), 0), *((name, page) for _, name, linked in doubtful(node) if not linked)]


def read(source: str | None, paths: list[str], recurring: list[str] | None = None) -> tuple[str, str]:
    """The main text, and the path that it was read by (empty: none)."""
    root = parse(source or "")
    for node, name, linked in doubtful(root):
        node.skip = linked or name in (recurring or ())
    for path in paths:
        if path and (text := "\n".join(b for node in nodes_on(root, path) for b in blocks(node))):
            return text, path
    node = best(root)
    return ("\n".join(blocks(root)), "") if node is None else ("\n".join(blocks(node)), path_of(node))


def host_of(url):
    """The host of a column of URLs, lower-case, without user and port; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def host_paths(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, paths, recurring): the paths with the most votes of each host, best first, and the names of doubtful texts that
    recur on its pages. Both are shares of a host's pages, so their number is bounded however many pages it has."""
    rows = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [(h, p, page) for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, page in votes(source)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["host", "path", "page"])

    is_path = ~F.startswith("path", F.lit("~"))
    cast = rows.mapInArrow(run, "host string, path string, page long").groupBy("host", "path", "page").agg(F.count("*").alias("n"))
    summed = cast.groupBy("host", "path").agg(F.sum(F.when(is_path, F.col("n")).otherwise(1)).alias("votes"))
    all_ = F.sum(F.when(is_path, F.col("votes"))).over(Window.partitionBy("host"))
    shares = summed.withColumn("all", all_).where(F.when(is_path, F.col("votes") >= SHARE * F.col("all")).otherwise((F.col("votes") >= RECURS * F.col("all")) & (F.col("votes") >= PAGES)))
    vote = F.when(is_path, F.struct((-F.col("votes")).alias("rank"), "path"))
    ranked = shares.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(vote)), lambda x: x["path"]).alias("all"), F.collect_list(F.when(~is_path, F.col("path"))).alias("recurring"))
    below = lambda x, i: F.exists(F.slice("all", F.lit(1), i), lambda y: F.startswith(y, F.concat(x, F.lit(">"))))
    return ranked.select("host", F.filter("all", lambda x, i: ~below(x, i)).alias("paths"), "recurring")


def main_text(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, text, path): one row per row of ``pages``.

    Null and empty pages have an empty text, pages without a container that of their body. Null or odd URLs are pages of
    the host "". Repeated rows stay; other columns are ignored.
    """
    paths = stored(host_paths(pages, url_col, html_col), "host-paths").withColumnRenamed("host", "h")
    held = F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    joined = rows.withColumn("host", host_of(F.col("url"))).join(held, F.col("host") == F.col("h"), "left").select("id", "url", "html", "paths", "recurring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [read(source, p or [], r) for source, p, r in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["id", "url", "text", "path"])

    return joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, path string")
