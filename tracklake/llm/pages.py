"""Main text of web pages with a site style tree.

A page is read into blocks, each with the path of its elements (tags with their classes). The style tree of a host merges
the pages' paths: at each path, pages differ in presentation (the sequence of child elements) and in content (the text).
A text that d of a path's m pages have weighs (m - d + 1) / m: found once, 1; common to all, 1 / m, which is little only
if there are many pages; for the same share of the pages about the same, however many they are. A node's content averages
that over its texts; its presentation, which counts where it has no text, is the chance that two pages differ in it. Both
reach a node's ancestors with weight GAMMA for each step up. What elements say of themselves is a prior: menus, headers,
footers, sidebars, notices, adverts, forms, hidden parts, reader comments and, on pages with an article or main element,
what is outside these, have FAINT of the importance that the pages give them. Blocks of nodes below LEAST are removed from
the host's pages; below an article or main element only those that the prior makes faint.

The tree is built by aggregation on (host, path, text): a hot host is pre-aggregated in each task and never gathered.
Pages that are equal count once. The list of removed branches is broadcast up to BROADCAST_ROWS rows and joined by host
beyond that; pages are not shuffled for it otherwise. Reading takes time in proportion to the page, whatever is in it.

Edge cases: null or empty html gives an empty text; a null url is the host of no name; a page with article or main elements
gives all that remains inside them, in page order, one without them all blocks that remain, short or linked ones too;
repeated rows stay; other columns are not read. Broken markup is closed as browsers do for paragraphs and list items; a
tag that never ends is text from there on; after a quote that never ends, quotes have no meaning; elements more than
DEPTH deep belong to the branch at that depth.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize

GAMMA, LEAST, FAINT = 0.9, 0.2, 0.1
#: Levels of the tree: a node of that many steps down has a weight of a hundredth in its root.
DEPTH = 44
BROADCAST_ROWS = 200_000
#: Pages that a task holds as objects at once.
SLICE = 100

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea svg iframe object select title math canvas audio video".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption legend".split()
)
OUT = frozenset("nav footer aside form head button dialog menu label fieldset input".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Words in class, id or role that name what is not main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "footer sidebar sidebars aside cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup "
    "login toolbar pagination pager skip contentinfo complementary search widget widgets disclaimer masthead topbar form".split()
)
REMARKS = frozenset("comment comments commentlist reply replies respond disqus discussion reviews".split())
HEADERS = frozenset("header pageheader siteheader".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str | None) -> str:
    found = re.match(HOST, url or "")
    return found[1].lower() if found else ""


class Element:
    __slots__ = ("tag", "path", "out", "kids", "place", "depth")

    def __init__(self, tag: str, path: str, out: str, place: str, depth: int):
        self.tag, self.path, self.out, self.kids, self.place, self.depth = tag, path, out, [], place, depth


def judged(tag: str, attributes: str, parent: Element) -> tuple[str, str]:
    """(name for paths, why the prior is faint). Reasons: 'tag' and 'remark' are final, 'name' may be lifted by an article inside."""
    names: set[str] = set()
    label, hidden = tag, False
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key = key.lower()
            value = value.strip("\"'")
            if key in ("class", "id", "role"):
                names.update(SPLIT.split(CAMEL.sub("-", value).lower()))
                if key == "class" and value:
                    label = tag + "." + ".".join(value.replace("/", "").split()[:2])
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    if parent.out in ("tag", "remark"):
        return label, parent.out
    if tag in OUT or hidden:
        return label, "tag"
    if names & REMARKS and tag not in ("html", "body"):
        return label, "remark"
    if (tag == "header" or names & HEADERS) and not parent.place and tag not in ("html", "body", "article", "main"):
        return label, "tag"
    if tag in ("article", "main"):
        return label, ""
    if parent.out:
        return label, parent.out
    if names & NAMES and tag not in ("html", "body"):
        return label, "name"
    return label, ""


def tokens(html: str):
    """(text, '', '') of plain runs, (end mark, tag, attributes) of tags; comments, declarations and raw elements are left out."""
    at, size, quoted = 0, len(html), True
    while at < size:
        open_at = html.find("<", at)
        if open_at < 0:
            break
        if html.startswith("<!--", open_at):
            if open_at > at:
                yield html[at:open_at], "", ""
            end = html.find("-->", open_at + 4)
            at = end + 3 if end >= 0 else size
            continue
        tag = TAG.match(html, open_at)
        if tag is None:
            # A declaration, or a sign in the text.
            end = html.find(">", open_at) if html.startswith(("<!", "<?", "</"), open_at) else open_at
            if end < 0:
                break
            if end == open_at:
                yield html[at : open_at + 1], "", ""
                at = open_at + 1
            else:
                if open_at > at:
                    yield html[at:open_at], "", ""
                at = end + 1
            continue
        rest = REST.match(html, tag.end()) if quoted else None
        if rest is None:
            quoted = False
            end = html.find(">", tag.end())
            if end < 0:
                break
        else:
            end = rest.end() - 1
        if open_at > at:
            yield html[at:open_at], "", ""
        name = tag[2].lower()
        at = end + 1
        if name in RAW:
            if not tag[1]:
                close = CLOSE[name].search(html, at)
                at = close.end() if close else size
            continue
        yield tag[1] or "+", name, html[tag.end() : end]
    if at < size:
        yield html[at:], "", ""


def blocks_of(html: str | None):
    """(path, text, place, out) of each block, and (path, child names, out) of each element."""
    root = Element("", "", "", "", 0)
    stack = [root]
    opened: dict[str, list[int]] = {}  # places in the stack by tag, and of blocks and of bounds that inline ends don't cross
    block_at, bounds = [0], [0]
    blocks, shapes = [], []
    buffer: list[str] = []

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((stack[block_at[-1]].path, text, stack[-1].place, stack[-1].out))

    def pop(to: int):
        while len(stack) > to:
            e = stack.pop()
            opened[e.tag].pop()
            for places in (block_at, bounds):
                if places[-1] == len(stack):
                    places.pop()
            shapes.append((e.path, ",".join(e.kids), e.out))

    for mark, tag, attributes in tokens(html or ""):
        if not tag:
            buffer.append(mark)
            continue
        if mark == "/":
            if tag in BLOCKS:
                flush()
            if opened.get(tag) and (tag in BLOCKS or opened[tag][-1] >= bounds[-1]):
                pop(opened[tag][-1])
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            nearest = stack[block_at[-1]].tag
            if nearest == "p" or nearest in ENDS.get(tag, ()):
                pop(block_at[-1])
        parent = stack[-1]
        name, out = judged(tag, attributes, parent)
        place = tag if tag in ("article", "main") and parent.place != "article" else parent.place
        if not parent.kids or parent.kids[-1] != name:
            parent.kids.append(name)
        # Why a path is faint is part of it, so that all elements of a path have one prior.
        e = Element(tag, f"{parent.path}/{name}{'!' + out if out else ''}" if parent.depth < DEPTH else parent.path, out, place, parent.depth + 1)
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            block_at.append(len(stack))
        if tag in ("article", "main", "body"):
            bounds.append(len(stack))
        stack.append(e)
    flush()
    pop(1)
    if any(place and not out for _, _, place, out in blocks):
        blocks = [b if b[2] or b[3] else (b[0] + "!outside", b[1], "", "outside") for b in blocks]
    return blocks, shapes


def main_text(html: str | None, removed: set[str] | None = None) -> str:
    """The page's text without the removed branches of its host; alone, a page is the only one of its host."""
    blocks, _ = blocks_of(html)
    # A block goes by its own path, not for what else a branch holds.
    return "\n".join(text for path, text, _, out in blocks if (not out if removed is None else path not in removed))


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, prior, page): kind 0 for content, 1 for presentation; page is a hash of the whole page."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64()), ("prior", pa.float64()), ("page", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(at, SLICE), []
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    host, page = host_of(url), _key(html or "")
                    blocks, shapes = blocks_of(html)
                    seen = {(path, 0, _key(text), FAINT if gone else 1.0) for path, text, _, gone in blocks}
                    seen |= {(path, 1, _key(shape), FAINT if gone else 1.0) for path, shape, gone in shapes if shape}
                    out += [(host, *node, page) for node in seen]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return mapped(pages.select("url", "html"), run, "host string, path string, kind int, feature long, prior double, page long")


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, m, text, importance) of each node of each host's style tree, from its distinct nodes; text: it has content."""
    counts = nodes.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("d"), F.max("prior").alias("prior"))
    # Pages of a path: each has one presentation there; contents may be several, so the pages are counted themselves.
    sizes = nodes.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("m"))
    joined = counts.join(sizes, ["host", "path"])
    differs = (F.col("m") - F.col("d") + 1) / F.col("m")
    share = F.col("d") / F.col("m")
    own = joined.groupBy("host", "path").agg(
        F.max("m").alias("m"), F.max("prior").alias("prior"),
        F.avg(F.when(F.col("kind") == 0, differs)).alias("content"),
        F.sum(F.when(F.col("kind") == 1, share * differs)).alias("presentation"),
    )
    parts = F.split(F.substring("path", 2, 1 << 20), "/")
    up = own.withColumn("parts", parts).withColumn("steps", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)))
    up = up.withColumn("node", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("steps")), "/")))
    weight = F.pow(F.lit(GAMMA), F.col("steps")) * F.col("m")
    value = F.coalesce("content", "presentation")
    merged = up.groupBy("host", F.col("node").alias("path")).agg((F.sum(weight * value) / F.sum(weight)).alias("given"))
    return merged.join(own, ["host", "path"]).select("host", "path", "m", F.col("content").isNotNull().alias("text"), F.col("prior"), (F.col("given") * F.col("prior")).alias("importance"))


def removed_branches(pages: DataFrame) -> DataFrame:
    """(host, branches): paths of low-importance blocks. What no prior makes faint goes only beside something important, and not below an article."""
    tree = importance(materialize(style_nodes(pages).distinct(), "pages-nodes"))
    best = tree.groupBy("host").agg(F.max("importance").alias("best"))
    plain = (F.col("best") > 0.5) & ~F.col("path").rlike(r"/(html|body|p|h1)$|/(article|main)([./!]|$)")
    low = tree.join(best, "host").filter(F.col("text") & (F.col("importance") < LEAST) & ((F.col("prior") < 1) | plain))
    return low.groupBy("host").agg(F.collect_set("path").alias("branches"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    removed = materialize(removed_branches(pages), "pages-removed")
    hosts = mapped_hosts(pages)
    size = removed.agg(F.sum(F.size("branches"))).first()[0] or 0
    removed = F.broadcast(removed) if size <= BROADCAST_ROWS else removed

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, texts = batch.slice(at, SLICE), []
                found: dict[tuple, set[str]] = {}
                for html, branches in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    key = tuple(branches or ())
                    texts.append(main_text(html, found.setdefault(key, set(key))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = hosts.join(removed, "host", "left").select("page_id", "url", "html", "branches")
    return mapped(joined, run, "page_id long, url string, text string, n_chars long")


def mapped_hosts(pages: DataFrame) -> DataFrame:
    """Pages with their host, as host_of finds it."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.withColumn("host", host)
