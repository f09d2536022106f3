"""HTML extraction by site style trees.

All pages of a host are merged into one tree of style nodes (tag, class and id
along the path). A node's importance joins two entropies over the host's pages:
that of its presentation (what it shows side by side) and that of its content
(how many pages share each of its texts). Navigation, notices and footers
repeat, so their entropy is low; such branches are cut from each page. Texts hang
on the leaves, so a branch with any important leaf loses only the others.

What HTML itself says of a branch multiplies its importance: nothing is left of
a nav, footer, form or script, little of what is named "advert" and nothing
else, and where a page has an article, nothing of what stands beside it. Nodes in
articles are in the tree like any others; a plain paragraph there is prose, and is
never cut for its frequency alone. A node known from few pages is drawn toward
importance (as if PRIOR more pages had shown something new), so the number of
pages decides gradually.

A page is parsed once. The tree is never built in one place: pages emit hashed
(node, feature) rows, counts are aggregated map-side first, and a host with a
third of all pages is only a larger count.

Edge cases: null, empty or text-free html gives an empty text and 0 characters.
A null url belongs to the host "". Broken markup (unclosed or misnested tags, a
page cut off anywhere) is read as far as it goes; only an unclosed script, style,
textarea or title takes the rest of the page, as in HTML. Pages of a host with
the same main text count once in the entropies, and each comes out. An empty
table gives an empty result; other columns of the table aren't read.
"""

from __future__ import annotations

import html as html_
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: Weight of content against presentation in a node's importance.
GAMMA = 0.9
#: Branches whose importance is under this are cut.
THRESHOLD = 0.3
#: Pages' worth of belief that a node is important.
PRIOR = 4
#: What is left of the importance of a branch that bears the name of site furniture, wholly or in part.
NAMED, HALF_NAMED = 0.2, 0.7
#: Nodes under THRESHOLD / HALF_NAMED, over all hosts, up to which they are broadcast (24 bytes each).
BROADCAST_NODES = 200_000

#: Elements whose content is no markup; unclosed, the first kind takes the rest of the page.
RAW, RAW_IF_CLOSED = "script|style|textarea|title", "noscript|template|iframe|noembed|noframes|xmp"
#: These hold nothing of the page's text, and end where a block of text begins.
EMBEDDED, TEXT_BEGINS = "svg|math|select|object|canvas|audio|video", "p|div|h[1-6]|ul|ol|dl|table|pre|blockquote|article|section|main|header|footer|nav|aside|body"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<({RAW_IF_CLOSED})\b[^>]*>.*?</\2\s*>"
    rf"|<({EMBEDDED})\b[^>]*>(?:[^<]|<(?!(?:{TEXT_BEGINS})\b))*?</\3\s*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?/a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr ins del acronym".split())
#: An opening tag of the first kind ends open elements of the second, up to a boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table article section main body div nav aside header footer form blockquote".split())
NOISE_TAGS = frozenset("nav aside footer form button menu dialog".split())
NO_TEXT = frozenset(EMBEDDED.split("|"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs comment comments reply replies respond disqus pagination pager toolbar skip".split()
)
OUTER_NOISE_WORDS = frozenset("header masthead topbar widget rail alert".split())
#: Parts of a name that say nothing by themselves.
HOLDERS = frozenset("box list container wrapper wrap block section bar area links link posts articles item items inner outer left right top bottom main site page global the and us more".split())
SPACES = re.compile(r"\s+")


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """The parts of each name in class and id: "cookie-notice" has cookie and notice."""
    return [[x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower()) if x] for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]


def _weight(tag: str, attrs: dict[str, str], inside: bool) -> float:
    """What HTML leaves of a node's importance: 0 for what it calls furniture or hides, NAMED for a name of furniture, HALF_NAMED for one with other words in it."""
    if tag in NOISE_TAGS or tag in NO_TEXT or (tag == "header" and not inside):
        return 0.0
    if not attrs:
        return 1.0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("role", "").lower() in NOISE_ROLES:
        return 0.0
    weight = 1.0
    for parts in _names(attrs):
        bad = [x in NOISE_WORDS or not inside and x in OUTER_NOISE_WORDS for x in parts]
        if any(bad):
            weight = min(weight, NAMED if all(b or x in HOLDERS or x.isdigit() for b, x in zip(bad, parts, strict=True)) else HALF_NAMED)
    return weight


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, bool, float]]:
    """The text blocks of a page in order: (style path, text, in an article, weight of the branch)."""
    source = page or ""
    #: open elements: (tag, style, in article, weight of the branch)
    stack: list[tuple[str, str, bool, float]] = []
    out: list[tuple[tuple[str, ...], str, bool, float]] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = SPACES.sub(" ", html_.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                inside, weight = (stack[-1][2], stack[-1][3]) if stack else (False, 1.0)
                out.append((tuple(f[1] for f in stack if f[0] not in INLINE), text, inside, weight))

    end = 0
    for m in TOKEN.finditer(source):
        if m.start() > end:
            pending.append(source[end : m.start()])
        end = m.end()
        tag = m[5]
        if not tag:
            continue  # comments, declarations, scripts and other raw elements
        tag = tag.lower()
        if m[4]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE or tag in ("p", "li", "td", "tr") and stack[i][0] in BOUNDARY:
                    break  # a stray end tag closes nothing
            continue
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
        else:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()) or (stack[i][0] in NO_TEXT and (tag in BOUNDARY or tag in PROSE)):
                    del stack[i:]
                    break
                if stack[i][0] in BOUNDARY:
                    break
        if tag in VOID or m[6].endswith("/") and (tag in INLINE or tag in NO_TEXT):
            continue
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[6])} if m[6] else {}
        above, weight = (stack[-1][2], stack[-1][3]) if stack else (False, 1.0)
        style = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}" if attrs else tag
        # an article is what it is wherever it stands, but not in furniture
        own = _weight(tag, attrs, above)
        starts = not above and weight > 0 and (tag in ("article", "main") or attrs.get("role", "").lower() == "main")
        stack.append((tag, style, above or starts, min(weight, own)))
    if end < len(source):
        pending.append(source[end:])
    flush()
    return out


def _key(*parts: str) -> int:
    x = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def candidates(page: str | None, host: str) -> tuple[list[tuple[int, float, str]], list[tuple[int, int]]]:
    """((leaf, weight, text) of each block that HTML lets stand, (node, what it shows) of each node), nodes as keys."""
    found = blocks(page)
    if any(inside and weight >= THRESHOLD for _, _, inside, weight in found):
        found = [b for b in found if b[2]]  # beside an article nothing is of importance
    shows: dict[tuple[str, ...], set[str]] = {}
    kept: list[tuple[int, float, str]] = []
    keys: dict[tuple[str, ...], int] = {}
    for path, text, inside, weight in found:
        if not weight:
            continue
        for depth in range(len(path)):
            shows.setdefault(path[:depth], set()).add(path[depth])
        if path not in keys:
            # a plain paragraph of an article is marked by an odd key
            prose = inside and bool(path) and path[-1] in PROSE
            keys[path] = _key(host, *path) & ~1 | prose
        shows.setdefault(path, set()).add("text")
        kept.append((keys[path], weight, text))
    return kept, [(keys.get(p, _key(host, *p) & ~1), _key(*sorted(c))) for p, c in shows.items()]


_BLOCK = pa.list_(pa.struct([("node", pa.int64()), ("weight", pa.float64()), ("text", pa.string())]))
_SHOWN = pa.list_(pa.struct([("node", pa.int64()), ("feature", pa.int64())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, main, row = [], [], []
        for page, host in zip(b.column(2), b.column(3).to_pylist(), strict=True):
            rows.append(candidates(page.as_py(), host))
            main.append(_key(*(t for _, _, t in rows[-1][0])))
            row.append(random.getrandbits(62))
        blocks_ = pa.array([[{"node": n, "weight": w, "text": t} for n, w, t in r[0]] for r in rows], _BLOCK)
        shown = pa.array([[{"node": n, "feature": f} for n, f in r[1]] for r in rows], _SHOWN)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(main, pa.int64()), pa.array(row, pa.int64()), blocks_, shown], names=["page_id", "url", "host", "main", "row", "blocks", "shown"])


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, main (key of the main text), row (a random name of the row), blocks and shown of every page, written once."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    schema = "page_id long, url string, host string, main long, row long, blocks array<struct<node:bigint,weight:double,text:string>>, shown array<struct<node:bigint,feature:bigint>>"
    return materialise(map_arrow(p, _parse, schema), "style-tree")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(parsed: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the style nodes, merged over each host's pages; pages with one main text count once."""
    again = parsed.groupBy("host", "main").agg(F.count("*").alias("n"), F.min("row").alias("_row")).where("n > 1").select(F.col("host").alias("_h"), F.col("main").alias("_m"), "_row")
    once = parsed.select("host", "main", "row", "shown", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("feature"))).alias("texts"))
    once = once.join(again, (once["host"] == again["_h"]) & (once["main"] == again["_m"]), "left").where("_row IS NULL OR _row = row")
    features = once.select("host", F.lit(0).alias("kind"), F.explode("shown").alias("f")).unionByName(once.select("host", F.lit(1).alias("kind"), F.explode(F.array_distinct("texts")).alias("f")))
    counts = features.groupBy("host", F.col("f.node").alias("node"), "kind", F.col("f.feature").alias("feature")).agg(F.count("*").alias("c"))
    c, shown = F.col("c"), F.col("kind") == 0
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(shown, c)).alias("pages"),
        F.sum(F.when(shown, c * F.log(c))).alias("s"),
        F.sum(F.when(~shown, c)).alias("n"),
        F.sum(F.when(~shown, c * F.log(c))).alias("t"),
    )
    m = F.col("pages")
    presentation = F.when(m > 1, 1 - F.col("s") / (m * F.log(m))).otherwise(1.0)
    content = F.when((m > 1) & (F.col("n") > 0), 1 - F.col("t") / (F.col("n") * F.log(m))).otherwise(1.0)
    prior = PRIOR + F.when(F.col("node") % 2 != 0, m).otherwise(0)
    seen = (1 - GAMMA) * presentation + GAMMA * content
    return nodes.select("host", "node", "pages", ((m * seen + prior) / (m + prior)).alias("importance"))


def extract(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    parsed = parse(pages)
    low = materialise(importance(parsed).where(F.col("importance") < THRESHOLD / HALF_NAMED).select("host", "node", "importance"), "low-nodes")
    per_host = low.groupBy(F.col("host").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("_low"))
    joined = parsed.join(F.broadcast(per_host) if low.count() <= broadcast_nodes else per_host.hint("merge"), parsed["host"] == per_host["_h"], "left")
    important = lambda b: b["weight"] * F.when(F.col("_low").isNull(), 1.0).otherwise(F.coalesce(F.try_element_at(F.col("_low"), b["node"]), F.lit(1.0))) >= THRESHOLD
    text = F.array_join(F.transform(F.filter("blocks", important), lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
