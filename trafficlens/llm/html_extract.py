"""Main text of web pages with a style tree per site.

Every page's element tree is merged into its host's style tree: elements of
the same path (tag and classes from the root) are one node, which keeps, over
the host's m distinct pages, the child sequences it appears with (presentation)
and the texts directly in it (content).  A node's importance is, for
presentation, the entropy -sum p log_m p of its child sequences, and for content
1 minus the mean over its texts of their entropy over pages, log_m of the number
of pages that hold the text; the larger counts.  A branch is as important as
its most important node, and branches below ``THRESHOLD`` are cut from every
page of the host.

Entropy tells what repeats, not what an element is for, so markup has its say as
well: elements whose tag or class names a menu, header, footer, sidebar, notice,
advert, form or reader comments are cut, and a page's articles, else its main part, are kept alone where they hold
the most of its important text: text outside the articles is cut if the
largest of them has as much, text outside main if main has as much as there is
outside both.  Where neither does, the whole body is kept, articles included.
Hosts with fewer than ``LEAST_PAGES`` distinct pages are judged by markup
alone (all their text is important), and a page is never left empty by the
style tree: if nothing else is left, its chosen part is kept.

Scale: pages are parsed where they lie.  What is shuffled is (host, path,
hash, page hash) rows without text, counted with map-side combining, so a host
with a third of all pages is no hot task; the result, the low branches of each
host, is written and joined to the pages by Spark's own choice: broadcast
only under its size threshold, a skew-splitting join above.

Defined results: null or empty html: empty text, 0 characters.  A null url is
the host ''.  Repeated rows count once in the tree and are each extracted.
Elements nested deeper than ``MAX_DEPTH`` are one node with the one there.
An unclosed script, style, title, textarea or xmp runs to the end of the page;
of another skipped element without a closing tag only the tag itself goes.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, arrow_schema, map_batches, stored
from .url_filter import url_parts

THRESHOLD = 0.1
LEAST_PAGES = 10
MAX_DEPTH = 64

# HTML's block elements, what ends an open element of its kind, elements without text, noise by tag and by class.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
 thead tr ul""".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "body": ("head",)}
NO_CLOSE = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("head nav header footer aside form dialog menu fieldset".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
 disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo
 related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget""".split())
# Elements skipped with what they hold, if they are closed; those that hold others of their kind; those that "/>" closes.
SKIPPED = frozenset("noscript template iframe svg math object select button".split())
NESTED = frozenset("template svg math object".split())
SELF_CLOSED = frozenset(("svg", "math"))
ARTICLE_NOISE = frozenset("ad ads advert advertisement comment comments promo related reply replies sponsored".split())

MAIN, ARTICLE = 1, 2  # bits

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(script|style|title|textarea|xmp)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
                    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_SKIPPED = re.compile(r"<(/?)(noscript|template|iframe|svg|math|object|select|button)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, bool, int]:
    """(label in the tree, is noise, region: ``MAIN``, ``ARTICLE`` or 0) of a start tag."""
    names = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMES.finditer(attributes)} if "=" in attributes else {}
    classes = sorted(set(names.get("class", "").split()))
    words = set(re.split(r"[^a-z]+", " ".join(names.values())))
    region = ARTICLE if tag == "article" else MAIN if tag == "main" or names.get("role") == "main" else 0
    if tag in ("html", "body"):
        noise = False
    else:
        noise = tag in NOISE_TAGS or bool(words & (ARTICLE_NOISE if region else NOISE_WORDS))
    return ".".join([tag, *classes]), noise, region


def _skips(html: str) -> dict[int, int]:
    """Start and end of each closed element of ``SKIPPED``; one without a closing tag is not among them."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    for m in _SKIPPED.finditer(html):
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                ends[opened[tag].pop()] = m.end()
        elif not (tag in SELF_CLOSED and m[3].endswith("/")):
            if tag not in NESTED:
                opened[tag].clear()
            opened[tag].append(m.start())
    return ends


def page_blocks(html: str, decode: bool = True) -> Iterator[tuple[str, bool, int, str]]:
    """(path, noise, region, text) of each block in page order; with ``decode``, character references are read.

    Also gives ``(path, noise, region, "")`` for each element's own start, so that the tree can be built."""
    stack: list[tuple[str, str, bool, int, bool]] = [("", "", False, 0, False)]  # tag, path, noise, region, noise within a block
    depth: dict[str, int] = {}
    text: list[str] = []
    at = 0
    skips: dict[int, int] | None = None

    def flush():
        if text:
            got = " ".join("".join(text).split())
            text.clear()
            if got:
                _, path, noise, region, _ = next(e for e in reversed(stack) if not e[4])
                return path, noise, region, got
        return None

    def pop():
        depth[stack.pop()[0]] -= 1
    while m := _TOKEN.search(html, at):
        if m.start() > at and not stack[-1][4]:
            piece = html[at:m.start()]
            text.append(_html.unescape(piece) if decode and "&" in piece else piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED and not m[2]:
            skips = _skips(html) if skips is None else skips
            at = skips.get(m.start(), at)
            continue
        block = tag in BLOCKS
        if m[2]:
            if depth.get(tag):
                if (block or not stack[-1][4]) and (got := flush()):
                    yield got
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif block and (got := flush()):
                yield got
            continue
        if tag == "br":
            text.append(" ")
            continue
        label, noise, region = _element(tag, m[4]) if block or "=" in m[4] else (tag, False, 0)
        if not block and not noise and not region:
            continue
        within = not block and not region
        if not within and (got := flush()):
            yield got
        for other in CLOSES.get(tag, ("p",) if block else ()):
            if depth.get(other) and stack[-1][0] in (other, "p"):
                while stack[-1][0] in (other, "p"):
                    pop()
        if tag in NO_CLOSE:
            continue
        _, path, above, where, _ = stack[-1]
        deeper = f"{path}/{label}" if len(stack) <= MAX_DEPTH else path
        stack.append((tag, deeper, above or noise, where | region, within))
        depth[tag] = depth.get(tag, 0) + 1
        yield deeper, above or noise, where | region, ""
    if at < len(html) and not stack[-1][4]:
        piece = html[at:]
        text.append(_html.unescape(piece) if decode and "&" in piece else piece)
    if got := flush():
        yield got


def _is_article(label: str) -> bool:
    return label == "article" or label.startswith("article.")


def main_text(html: str | None, low: frozenset[str] = frozenset()) -> str:
    """The blocks of the page's main part without noise and without the ``low`` paths, joined by blank lines."""
    blocks, sizes, outside = [], [0], {0: 0, MAIN: 0}  # important characters: of each outermost article, and outside articles by region
    for path, noise, region, text in page_blocks(html or ""):
        if not text:
            if region & ARTICLE and _is_article((labels := path.split("/"))[-1]) and not any(map(_is_article, labels[:-1])):
                sizes.append(0)
        elif not noise:
            blocks.append((path, region, text))
            size = 0 if path in low else len(text)
            if region & ARTICLE:
                sizes[-1] += size
            else:
                outside[region] += size
    regions = {region for _, region, _ in blocks}
    best = 0
    if any(region & ARTICLE for region in regions) and max(sizes) >= sum(outside.values()):
        best = ARTICLE
    elif any(region & MAIN for region in regions):
        in_main = sum(len(text) for path, region, text in blocks if region & MAIN and path not in low)
        best = MAIN if in_main >= outside[0] else 0
    inside = [(path, text) for path, region, text in blocks if region & best == best]
    kept = [text for path, text in inside if path not in low]
    return "\n\n".join(kept or [text for _, text in inside])


# --- the style tree --------------------------------------------------------

TREE = "path string, kind int, feature long, page long"


def _hash(data: str) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(data.encode("utf-8", "replace")) - (1 << 63)


def _tree_rows(html: str) -> Iterator[tuple[str, int, int]]:
    """(path, kind, feature): child sequences (kind 0) and texts (kind 1), each once; '' stands for the page."""
    children: dict[str, list[str]] = {"": []}
    texts: set[tuple[str, int]] = set()
    for path, _, _, text in page_blocks(html, decode=False):
        if text:
            texts.add((path, _hash(text)))
        else:
            up, _, label = path.rpartition("/")
            row = children.setdefault(up, [])
            if not row or row[-1] != label:  # a run of like children is one
                row.append(label)
            children.setdefault(path, [])
    yield "", 2, 0
    for path, labels in children.items():
        if labels and path:
            yield path, 0, _hash(" ".join(labels))
    for path, feature in texts:
        yield path, 1, feature


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance, m): the importance of the branch at every node, from pages (host, html)."""
    schema = arrow_schema("host string, " + TREE)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows: list = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                value = html.as_py()
                if value:
                    page = _hash(value)
                    rows += [(host, *row, page) for row in _tree_rows(value)]
            for i in range(0, len(rows), 1 << 15):
                part = zip(*rows[i:i + (1 << 15)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema, strict=True)], schema=schema)
    rows = map_batches(pages.select("host", "html"), run, "host string, " + TREE)
    # Pages that are the same through and through count once.
    counts = rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).cast("double").alias("n"))
    nodes = stored(counts.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("pages"), F.sum(F.expr("n * ln(n)")).alias("nlogn"), F.avg(F.expr("ln(n)")).alias("log")), "style-nodes")
    size = nodes.where("kind = 2").select("host", F.col("pages").alias("m"))
    own = nodes.where("kind < 2").join(size, "host")
    # With p = n / pages: -sum p ln p = ln(pages) - sum(n ln n) / pages.
    entropy = F.when(F.col("kind") == 0, F.ln("pages") - F.col("nlogn") / F.col("pages")).otherwise(F.ln("m") - F.col("log"))
    own = own.select("host", "path", "m", F.when(F.col("m") > 1, entropy / F.ln("m")).otherwise(1.0).alias("importance"))
    names = F.split(F.substring("path", 2, 1 << 30), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), n), "/")))
    return own.select("host", "m", "importance", F.explode(above).alias("path")) \
        .groupBy("host", "path").agg(F.max("importance").alias("importance"), F.max("m").alias("m"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    host, _ = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    tree = style_tree(rows)
    low = tree.where((F.col("m") >= least_pages) & (F.col("importance") < threshold))
    low = stored(low.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("low")), "style-low")

    def run(htmls, lows):
        return [((main_text(h, frozenset(p)) if p else main_text(h)),) for h, p in zip(htmls, lows, strict=True)]
    cut = append_columns(rows.join(low, "host", "left").select("page_id", "url", "html", "low"), "text string", run, "html", "low")
    return cut.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
