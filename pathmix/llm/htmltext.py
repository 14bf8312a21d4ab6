"""Main text of web pages by site style trees: pages of one host are merged by element path, and branches whose look
and content hardly vary over the host are left out."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Importance below which a branch is noise, pages of a host from which importance counts, weight of the children.
LEAST, PAGES, GAMMA = 0.4, 8, 0.9
#: Rows of style trees that are broadcast at once; more are handled in blocks of hosts.
TREE_ROWS = 200_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote figure details".split())
#: Elements, roles and words of class or id that mark what isn't the article.
NOISE_TAGS = RAW | frozenset("head nav footer aside form button dialog menu label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion related replies reply respond sharing share sidebar "
    "signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Block:
    """A run of text between block borders: its element path, its text, whether the tags call it noise, and the path
    of the article it is in (or None)."""

    __slots__ = ("path", "text", "noise", "article")

    def __init__(self, path: str, text: str, noise: bool, article: str | None):
        self.path, self.text, self.noise, self.article = path, text, noise, article


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Text blocks in page order, and for each element path the names of its children in order."""
    stack: list[tuple] = [("", "", False, None)]  # tag, path, noise, path of the article
    out: list[Block] = []
    look: dict[str, list[str]] = {}
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Block(stack[-1][1], text, *stack[-1][2:]))

    def close(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                flush()
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            held.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                continue
            close({tag}, frozenset() if tag in SCOPE else SCOPE - {tag})
            continue
        if tag in BLOCK:
            flush()
            if tag != "br":
                close({"p"}, SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], frozenset({"ul", "ol", "dl", "table"}))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            if end is not None:
                at = page.find(">", at) + 1 or len(page)
            continue
        _, path, noise, article = stack[-1]
        words, role = [], ""
        for a in _ATTR.finditer(m[3] or m[6] or ""):
            value = a[2] or a[3] or a[4] or ""
            if a[1].lower() == "role":
                role = value.lower().strip()
            else:
                words += [w.lower() for w in _WORD.findall(value)]
        name = tag + "".join(f".{w}" for w in sorted(set(words)))
        if tag in BLOCK:
            look.setdefault(path, []).append(name)
            path = f"{path}/{name}"
        if article is None and (tag in ("article", "main") or role in ("article", "main")):
            article = path
        bad = noise or tag in NOISE_TAGS or role in NOISE_ROLES or not NOISE_WORDS.isdisjoint(words) or (tag == "header" and article is None)
        stack.append((tag, path, bad, article))
    flush()
    return out, look


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def importance(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The merged style trees: host, path, pages (of the host), look and content, both entropies from 0 to 1.

    look: how much the children's sequence varies over the host's pages; content: one less the mean entropy with
    which the path's texts spread over pages, so a text on all pages counts 0 and a text on one page 1. Pages of a host
    with the same texts (besides what the tags call noise) count as one, by the copy of smallest hash.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, copies, wholes, at, rows = [], [], [], [0], []
            for u, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, look = parse(body or "")
                own = sorted({(b.path, 1, _hash(b.text)) for b in found})
                own += [(path, 2, _hash(" ".join(children))) for path, children in look.items()]
                hosts.append(host(u))
                copies.append(_hash("\n".join(b.text for b in found if not b.noise)))
                wholes.append(_hash(repr(own)))
                rows += own
                at.append(len(rows))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            types = (pa.string(), pa.int32(), pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c, t)) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(copies, pa.int64()), pa.array(wholes, pa.int64()), *lists], names=["host", "copy", "whole", "path", "kind", "feature"])

    found = df.select(url, page).mapInArrow(nodes, "host string, copy bigint, whole bigint, path array<string>, kind array<int>, feature array<bigint>")
    each = found.groupBy("host", "copy").agg(F.min_by(F.struct("path", "kind", "feature"), "whole").alias("x"))
    own = F.array(F.struct(F.lit("").alias("path"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("feature")))
    rows = each.select("host", F.explode(F.concat(own, F.arrays_zip("x.path", "x.kind", "x.feature"))).alias("y")).select("host", "y.path", "y.kind", "y.feature")
    seen = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    sums = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("own"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.ln("n"))).alias("text_logs"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("looks"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.ln("n"))).alias("look_logs"),
    )
    log_m = F.ln(F.greatest(F.col("pages"), F.lit(2)))
    sums = settle(sums)  # pages are parsed once for both the counts and the number of pages
    pages = sums.where("own is not null").select("host", F.col("own").alias("pages"))
    return sums.join(pages, "host").select(
        "host", "path", "pages",
        F.try_divide(F.ln(F.col("looks")) - F.col("look_logs") / F.col("looks"), log_m).alias("look"),
        (1 - F.col("text_logs") / F.col("texts") / log_m).alias("content"),
        F.col("texts"),
    )


def noisy(tree: dict[str, tuple]) -> frozenset[str]:
    """Paths of one host's tree whose composite importance is below LEAST. tree: path -> (pages, look, content, texts)."""
    if not tree or max(v[0] for v in tree.values()) < PAGES:
        return frozenset()
    total: dict[str, list[float]] = {}
    low: set[str] = set()
    for path in sorted(tree, key=lambda p: -p.count("/")):
        _, look, content, texts = tree[path]
        own, weight = total.get(path, [0.0, 0.0])
        if content is not None:
            own, weight = own + content * texts, weight + texts
        if not weight:
            continue
        below = own / weight
        value = below if look is None or content is not None else (1 - GAMMA) * look + GAMMA * below
        if value < LEAST:
            low.add(path)
        up = path.rpartition("/")[0]
        if path:
            above = total.setdefault(up, [0.0, 0.0])
            above[0] += below * weight
            above[1] += weight
    return frozenset(low)


def main_text(page: str | None, low: frozenset[str]) -> str:
    """The page's main text, one block to a line. `low`: paths of its host that the style tree finds unimportant.

    The tree decides first: blocks on a branch of low importance go, by whatever name. Inside an article this holds
    for branches below the article's own element, and only where the article as a whole varies over the host: where
    it doesn't, its pages are copies and tell nothing. What is left outside the article, or in an element whose tag,
    role or names call it something else, goes next: such text may well differ from page to page.
    """
    found, _ = parse(page or "")
    kept = [b for b in found if not (low and _branch(b, low))]
    kept = [b for b in kept if not b.noise]
    if any(b.article is not None for b in kept):
        kept = [b for b in kept if b.article is not None]
    return "\n".join(b.text for b in kept)


def _branch(block: Block, low: frozenset[str]) -> bool:
    """Whether the block's path or a branch above it (below the body, or below its article) is unimportant."""
    if block.article is not None and block.article in low:
        return False
    path, top = block.path, block.article if block.article is not None else ""
    while len(path) > len(top) and path.rpartition("/")[2] not in ("body", "html"):
        if path in low:
            return True
        path = path.rpartition("/")[0]
    return False


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: key, url, text, n_chars (code points).

    Pages of one host are merged into a style tree by counting over all pages (no group is gathered: counts are
    summed before they are shuffled, and the tree is written once to the shared folder). Branches of low composite
    importance are left out, inside an article too (see `main_text`); then what tags, roles and class names call menu,
    header, footer, sidebar, notice, advert, form or comment. Copies of a page count as one in the tree, so that copied
    articles don't look like templates; copies that differ in any other text outside of marked noise still count each.
    Hosts of fewer than PAGES distinct pages rely on the tags. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by a line feed. Null html is empty, a null url is the host ""; repeated
    rows give repeated results; an empty table gives an empty one; other columns are left out. Style trees are
    broadcast up to TREE_ROWS rows; beyond that, blocks of hosts are handled one after the other.
    """
    spark = df.sparkSession
    trees = importance(df, url, page)
    rows = settle(trees.where(F.col("pages") >= PAGES).select("host", "path", "pages", "look", "content", "texts"))
    size = rows.count()
    if size <= TREE_ROWS:
        return _apply(df, spark, rows, None, key, url, page)
    parts = -(-size // TREE_ROWS)
    out = None
    for b in range(parts):
        own = rows.where(F.pmod(F.xxhash64("host"), F.lit(parts)) == b)
        part = _apply(df, spark, own, (parts, b), key, url, page)
        out = part if out is None else out.unionByName(part)
    return out


def _apply(df: DataFrame, spark, rows: DataFrame, part: tuple[int, int] | None, key: str, url: str, page: str) -> DataFrame:
    trees: dict[str, dict] = {}
    for r in rows.toLocalIterator():
        trees.setdefault(r[0], {})[r[1]] = (r[2], r[3], r[4], r[5])
    low = spark.sparkContext.broadcast({h: noisy(t) for h, t in trees.items()})
    if part is not None:
        name = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST.pattern, 1))
        df = df.where(F.pmod(F.xxhash64(name), F.lit(part[0])) == part[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, low.value.get(host(u), frozenset())) for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return df.select(key, url, page).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{url}` string, text string, n_chars bigint")
