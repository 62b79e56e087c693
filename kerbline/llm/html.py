"""Main text of pages by a site style tree.

Each page's elements are named by their path of tags (with class or id). Pages of a host are merged into a tree: for
each path Spark counts the distinct contents and the distinct presentations (tags of the children),
over the host's different pages. The entropy of either, over the largest that so many pages allow, tells how much differs from page to page.

A host with few pages says little of that, one with a single page nothing. So trees back off, from the host to its domain and from there to all hosts that
have the path: the entropy of a scope is the mean of its hosts' own (a menu is the same within each host, though not between hosts), and each narrower scope counts against
the wider one by the pages it has seen, ``PRIOR`` pages of the wider one to its own. A path that no host has on two pages is taken as wholly important.
Words of a path a page back off in the same way, by ``USUAL`` pages. There is no size at which anything else is done.

A path's information is the entropy of its content times its words; a branch holds that of all paths in it.

1. A branch's importance is its information relative to the largest branch beside it, and, by a tenth, the entropy of its
   presentation; the fewer pages have told of it, the nearer it is to 1. Containers below ``LIGHT`` go: menus, adverts and footers say little beside an article.
2. A path with content has the composite importance of its content's entropy and, by a tenth, of its parent's
   presentation. Text directly in a path below ``LEAST`` goes, but not what deeper elements hold; a branch where all content is so goes too.

The inside of a marked article and branches with a first-level heading stay. ``purposes=True`` adds what pages say themselves: elements that state another
purpose (nav, footer, aside, form, an advert's or comment's class and the like) go, and so does what lies outside a marked article; but not an
element with over ``MOST`` of its host's information.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, spread_join, staged

LEAST, LIGHT, MOST, BLEND = 0.3, 0.15, 0.8, 0.1
PRIOR, USUAL = 2, 8
#: The path of an element deeper than this is its ancestor's there and a hash of the rest.
DEPTH = 64
# HTML's elements by their parts in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NEVER = frozenset("head script style noscript template svg math canvas object button select option datalist input textarea iframe audio video map title noembed noframes".split())
APART = frozenset("nav footer aside form dialog menu".split())
CONTAINERS = frozenset("div section header footer nav aside form article main ul ol dl table td center address details fieldset dialog menu".split())
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr hgroup center".split())
CLOSED_BY_BLOCK = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div body html td th blockquote nav aside footer header form".split())
PURPOSES = frozenset("ad ads advert adverts advertisement advertisements advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert sidebar sidebars menu menus nav navbar navigation navigations breadcrumb breadcrumbs crumbs footer footers masthead toolbar topbar comment comments commentlist disqus respond reply replies share sharing social subscribe newsletter signup login popup modal overlay related recommended recommendations widget widgets pagination pager paging skip copyright legal tags taglist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])", re.S)
_SPLIT, _CAMEL = re.compile(r"[^a-z0-9]+"), re.compile(r"([a-z0-9])([A-Z])")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, bare in _ATTR.findall(text):
        out.setdefault((name or bare).lower(), entities.unescape(a or b or c))
    return out


def _apart(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether the element's tag, role, class or id state a purpose other than content."""
    if tag in APART or tag == "header" and not in_article or attributes.get("role") in ROLES:
        return True
    if tag in ("body", "html", "article", "main") and not in_article:
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    if not names:
        return False
    words = set(_SPLIT.split(_CAMEL.sub(r"\1 \2", names).lower()))
    return bool(words & PURPOSES) or "header" in words and not in_article


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the element is never shown as text."""
    style = attributes.get("style", "").lower().replace(" ", "")
    return tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class Element:
    __slots__ = ("apart", "article", "children", "hidden", "path", "tag")

    def __init__(self, tag: str, path: str, article: bool, hidden: bool, apart: str):
        self.tag, self.path, self.article, self.hidden, self.apart, self.children = tag, path, article, hidden, apart, []


Block = tuple[str, bool, str, str]


def parse(html: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Shown blocks (path, in article, path of the outermost element of another purpose, text) in page order; and (path, tags of the children) of the elements with any."""
    stack = [Element("", "", False, False, "")]
    blocks: list[Block] = []
    styles: list[tuple[str, str]] = []
    text: list[str] = []
    owner = stack[0]  # the element that the gathered text is in

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined and not owner.hidden:
                blocks.append((owner.path, owner.article, owner.apart, joined))

    def close(depth: int) -> None:
        nonlocal owner
        while len(stack) > depth:
            e = stack.pop()
            if e.tag in BLOCKS or e.hidden or e.apart:
                flush()
            if e.children and not e.hidden:
                styles.append((e.path, " ".join(e.children)))

    def say(part: str) -> None:
        nonlocal owner
        if part:
            if not text:
                owner = next(e for e in reversed(stack) if e.tag in BLOCKS or e.hidden or e.apart or e.tag == "")
            text.append(entities.unescape(part))

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1].replace("&", "&amp;"))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br" or tag == "p" and not any(e.tag == "p" for e in stack):
                say(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph; items, cells and rows end their like
                if stack[k].tag == "p" or stack[k].tag in CLOSED_BY_BLOCK.get(tag, ()):
                    close(k)
                    if tag not in CLOSED_BY_BLOCK or stack[-1].tag in SCOPES and tag != "tr":
                        break
                elif stack[k].tag in SCOPES:
                    break
            flush()
        top = stack[-1]
        if tag == "br" or tag == "hr":
            say(" ")
        if tag in VOID:
            continue
        attributes = _attributes(m[4]) if m[4] and "=" in m[4] or "hidden" in m[4] else {}
        mark = "." + "-".join(sorted(attributes["class"].split())) if attributes.get("class") else "#" + attributes["id"] if attributes.get("id") else ""
        mark = mark.replace("/", "|").replace("~", "|")
        path = f"{top.path}/{tag}{mark}"
        if len(stack) > DEPTH:
            path = f"{top.path.partition('/~')[0]}/~{xxhash.xxh64_hexdigest(path.encode(errors='replace'))}"
        hidden = top.hidden or _hidden(tag, attributes)
        apart = top.apart or (path if _apart(tag, attributes, top.article) else "")
        if (hidden, apart) != (top.hidden, top.apart):
            flush()
        top.children.append(tag + mark)
        e = Element(tag, path, top.article or tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody", hidden, apart)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if not hidden:
                stack.append(e)
                say(html[at : end.start() if end else n])
                close(len(stack) - 1)
            at = end.end() if end else n
            continue
        if m[4].rstrip().endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        stack.append(e)
    close(1)
    flush()
    return blocks, styles


def _judged(html: str | None) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]], list[bool]]:
    """The shown blocks as (path, apart, text), the styles, and whether each block is article. ``apart`` is the element that breaks a tie against the block, or empty."""
    blocks, styles = parse(html or "")
    article = [inside and not apart for _, inside, apart, _ in blocks]
    marked = any(article)
    return [(path, apart or (path or "/" if marked and not inside else ""), t) for path, inside, apart, t in blocks], styles, article


def main_text(html: str | None, removed: frozenset[str] | set[str] = frozenset()) -> str:
    """The text of a page on its own, of whose host nothing else is known: all ties are broken by the page itself, and paths in ``removed`` go."""
    return "\n".join(t for path, apart, t in _judged(html)[0] if not apart and path not in removed)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\t".join(parts).encode(errors="replace"), 42) - 2**63


def _key(blocks: list[tuple[str, str, str]]) -> int:
    """A page's blocks with all that decides on them as a number. Where two pages share one, they share what is removed of both, which changes neither."""
    return _hash(*("\t".join(b) for b in blocks))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


NODES = "host string, page long, key long, path string, kind string, apart string, node long, words long"


def page_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, key, path, kind, apart, node, words) of each page's paths: ``page`` and ``node`` are hashes of the page's and the path's content."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks, styles, article = _judged(html.as_py())
                page, key = _hash(*(t for *_, t in blocks)), _key(blocks)
                nodes: dict[tuple[str, str, str], list[str]] = {}
                for (path, apart, t), inside in zip(blocks, article, strict=True):
                    nodes.setdefault((path, "article" if inside else "content", apart), []).append(t)
                for path, tags in styles:
                    nodes.setdefault((path, "style", ""), []).append(tags)
                out += [(host, page, key, *where, _hash(*v), sum(len(t.split()) for t in v)) for where, v in nodes.items()]
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in NODES.split(", ")])

    return short_batches(pages).select(_host(F.col("url")).alias("host"), "html").mapInArrow(walk, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """(host, path, kind, pages, own, words) of the merged trees: own is the relative entropy over the host's different pages, words those of all of them.

    Pages with the same text count once, so copies don't make their article look like a notice.
    """
    counts = nodes.select("host", "page", "path", "kind", "node", "words").distinct().groupBy("host", "path", "kind", "node").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum(F.col("n") * F.col("words")).alias("words"))
    entropy = F.log("pages") - F.col("s") / F.col("pages")
    return sums.select("host", "path", "kind", "pages", F.when(F.col("pages") > 1, entropy / F.log("pages")).otherwise(1.0).alias("own"), "words")


def _domain(host: Column) -> Column:
    """The last two labels of a host's name."""
    return F.substring_index(host, ".", -2)


def backed_off(tree: DataFrame) -> DataFrame:
    """``merged`` with own and words backed off from the host to its domain and to all hosts, and evidence: the repeated looks at the path that all hosts had."""
    rows = staged(tree.withColumn("domain", _domain(F.col("host"))))
    looks = F.col("pages") - 1
    pools = []
    for name, keys in (("domain", ["domain", "path", "kind"]), ("every", ["path", "kind"])):
        sums = staged(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(looks).alias(f"looks_{name}"), F.sum(looks * F.col("own")).alias(f"own_{name}"), F.sum("pages").alias(f"pages_{name}"), F.sum("words").alias(f"words_{name}")))
        pools.append((keys, sums))
    for keys, sums in pools:
        rows = spread_join(rows, sums.drop("n"), keys, sums.select(*keys, "n"), F.xxhash64("host", "path"))
    own, words = F.lit(1.0), F.try_divide("words_every", "pages_every")
    for name in ("every", "domain"):
        own = (F.col(f"own_{name}") + PRIOR * own) / (F.col(f"looks_{name}") + PRIOR)
        words = (F.col(f"words_{name}") + USUAL * words) / (F.col(f"pages_{name}") + USUAL)
    own = (looks * F.col("own") + PRIOR * own) / (looks + PRIOR)
    words = F.col("pages") * (F.col("words") + USUAL * words) / (F.col("pages") + USUAL)
    return rows.select("host", "path", "kind", "pages", own.alias("own"), words.alias("words"), F.col("looks_every").alias("evidence"))


def style_tree(tree: DataFrame) -> DataFrame:
    """(host, path, importance, information, evidence, article) of the paths with content, from ``backed_off``."""
    parents = tree.where("kind = 'style'").select("host", F.col("path").alias("parent"), F.col("own").alias("style"))
    content = tree.where("kind != 'style'").withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    composite = (1 - BLEND) * F.col("own") + BLEND * F.coalesce("style", F.lit(0.0))
    importance = F.when(F.col("kind") == "article", F.greatest(composite, F.lit(1.0))).otherwise(composite)
    rows = content.join(parents, ["host", "parent"], "left").select("host", "path", "kind", "evidence", importance.alias("importance"), (F.col("own") * F.col("words")).alias("information"))
    stays = (F.col("kind") == "article") | F.col("path").rlike(r"/h1([.#/]|$)")
    return rows.groupBy("host", "path").agg(F.max("evidence").alias("evidence"), F.max("importance").alias("importance"), F.sum("information").alias("information"), F.max(stays).alias("article"))


#: A path's branches: itself and all that it lies in.
_ABOVE = "transform(sequence(2, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))"


def weak_paths(tree: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, path) whose own content is unimportant, or that lie in a branch where all content is: a branch is as important as the most important path in it."""
    weak = F.col("importance") < least
    tree = tree.where("path != ''")
    placed = tree.select("host", "path", "importance", F.explode(F.expr(_ABOVE)).alias("branch"))
    branches = placed.groupBy("host", "branch").agg(F.max("importance").alias("importance")).where(weak).select("host", "branch")
    return tree.where(weak).select("host", "path").unionByName(placed.select("host", "path", "branch").join(branches, ["host", "branch"]).select("host", "path")).distinct()


def branches(tree: DataFrame, styles: DataFrame) -> DataFrame:
    """(host, branch, importance, share, article): importance by information beside the largest sibling and by presentation, share of the host's information, either as far as there is evidence."""
    placed = tree.where("path != ''").select("host", "evidence", "information", "article", F.explode(F.expr(_ABOVE)).alias("branch"))
    rows = placed.groupBy("host", "branch").agg(F.max("evidence").alias("evidence"), F.sum("information").alias("information"), F.max("article").alias("article"))
    rows = rows.withColumn("parent", F.regexp_replace("branch", "/[^/]*$", ""))
    largest = rows.groupBy("host", "parent").agg(F.max("information").alias("largest"))
    whole = tree.groupBy("host").agg(F.sum("information").alias("whole"))
    styles = styles.where("kind = 'style'").select("host", F.col("path").alias("branch"), F.col("own").alias("style"))
    rows = rows.join(largest, ["host", "parent"]).join(whole, "host").join(styles, ["host", "branch"], "left")
    importance = (1 - BLEND) * F.coalesce(F.try_divide("information", "largest"), F.lit(1.0)) + BLEND * F.coalesce("style", F.lit(0.0))
    told = F.col("evidence") / (F.col("evidence") + PRIOR)
    return rows.select("host", "branch", (told * importance + 1 - told).alias("importance"), (told * F.coalesce(F.try_divide("information", "whole"), F.lit(0.0))).alias("share"), "article")


def decisions(nodes: DataFrame, least: float = LEAST, light: float = LIGHT, most: float = MOST) -> DataFrame:
    """(host, path, apart) of what is removed on all pages of the host that have it: by the tree, and by a stated purpose where ``nodes`` tell one."""
    tree_nodes = staged(backed_off(merged(nodes)))
    tree = staged(style_tree(tree_nodes))
    known = staged(branches(tree, tree_nodes))
    is_box = F.regexp_extract("branch", r"/([^/.#]*)[^/]*$", 1).isin(*sorted(CONTAINERS))
    weak = known.where(is_box & ~F.col("article") & (F.col("importance") < light)).select("host", "branch")
    placed = tree.where("path != ''").select("host", "path", F.explode(F.expr(_ABOVE)).alias("branch"))
    low = weak_paths(tree, least).unionByName(placed.join(weak, ["host", "branch"]).select("host", "path")).distinct().withColumn("low", F.lit(True))
    great = known.where(F.col("share") >= most).select("host", F.col("branch").alias("apart"), F.lit(True).alias("great"))
    kept = nodes.where("kind != 'style'").select("host", "path", "apart").distinct()
    kept = kept.join(low, ["host", "path"], "left").join(great, ["host", "apart"], "left")
    return kept.where("low or apart != '' and great is null").select("host", "path", "apart")


def extract(pages: DataFrame, least: float = LEAST, light: float = LIGHT, most: float = MOST, purposes: bool = False) -> DataFrame:
    """page_id, url, text, n_chars for each row, as the tree decides; ``purposes=True`` adds what the pages state themselves.

    Null and empty html give an empty text; a null url belongs to the host without a name; repeated rows give repeated results; an empty
    table gives no rows; other columns don't matter. Very long pages are read whole.
    A page meets just those removed paths that it has itself, however many its host has. Pages are parsed twice: once for their nodes,
    which are written, and once for their texts, which are not.
    """
    nodes = staged(page_nodes(pages))
    if not purposes:
        nodes = nodes.withColumn("apart", F.lit(""))
    gone = decisions(nodes, least, light, most)
    own = nodes.where("kind != 'style'").select("host", "key", "path", "apart").distinct()
    counts = staged(own.groupBy("host", "path", "apart").agg(F.count("*").alias("n")))
    own = spread_join(own, gone, ["host", "path", "apart"], counts, F.col("key"))
    removed = own.groupBy("host", "key").agg(F.collect_set(F.xxhash64("path", "apart")).alias("removed"))
    counts = staged(nodes.groupBy("host", "key").agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, texts = [], [], []
            for html in batch.column(3):
                blocks, _, _ = _judged(html.as_py())
                parts: list[tuple[tuple[str, str], list[str]]] = []  # neighbours of one path together
                for path, apart, t in blocks:
                    if not parts or parts[-1][0] != (path, apart):
                        parts.append(((path, apart), []))
                    parts[-1][1].append(t)
                keys.append(_key(blocks))
                places.append([{"path": path, "apart": apart if purposes else ""} for (path, apart), _ in parts])
                texts.append(["\n".join(v) for _, v in parts])
            where = pa.list_(pa.struct([("path", pa.string()), ("apart", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(keys, pa.int64()), pa.array(places, where), pa.array(texts, pa.list_(pa.string()))], ["page_id", "url", "host", "key", "places", "texts"])

    shown = short_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), _host(F.col("url")).alias("host"), F.col("html").cast("string"))
    shown = shown.mapInArrow(run, "page_id long, url string, host string, key long, places array<struct<path: string, apart: string>>, texts array<string>")
    shown = shown.withColumn("places", F.transform("places", lambda p: F.xxhash64(p["path"], p["apart"])))
    kept = F.expr("if(removed is null, texts, filter(texts, (t, i) -> not array_contains(removed, places[i])))")
    text = spread_join(shown, removed, ["host", "key"], counts, F.xxhash64("page_id", "url"), "left").select("page_id", "url", F.concat_ws("\n", kept).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
