"""Main text of web pages, by markup and by differencing with the page of the nearest URL.

A page becomes text blocks. Pages are sorted by host and URL path, neighbours whose blocks differ
are aligned by the longest common subsequence of their blocks, and blocks that both hold are
the site's and not the page's: they go. Markup guards against deleting what two articles of a
site share: paragraphs, headings and the like stay if they lie in an article or main element, since
those are proved to be the page's. Everything else that markup doesn't rule out, in and outside
such elements, is decided by differencing. Pages are parsed once; sorting and aligning work on
hashes of blocks alone.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import table, written

#: Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
_SKIP = frozenset(
    "nav footer aside form script style noscript template svg math iframe button select textarea dialog head title "
    "object canvas audio video map menu".split()
)
#: Words in class and id names, and roles, of what isn't a page's text.
_SKIP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice "
    "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus "
    "share sharing social related newsletter subscribe subscription signup login search toolbar widget pagination pager".split()
)
#: Words that say what kind of box it is, and nothing of what is in it.
_BOX_NAMES = frozenset(
    "area bar block body bottom box button buttons column container content count entry form group head header holder icons inline inner "
    "item items left line link links list main meta outer panel placeholder post page reader readers region reply replies right row section "
    "site slot strip text thread title top unit user users wrap wrapper zone".split()
)
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^>]*>",
    re.S,
)
_NAME = re.compile(r"[a-z0-9]+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
#: Elements that hold an article's text, as against its layout.
_PROVED = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: Zones of blocks by the markup around them: not text, outside of articles, of an article's layout, of its text.
BOILER, PLAIN, LAYOUT, MAIN = 0, 1, 2, 3


def _skips(name: str, rest: str, in_main: bool) -> bool:
    if name in _SKIP or (name == "header" and not in_main):
        return True
    if not rest or name in ("body", "html", "main"):
        return False
    for key, *values, hidden in _ATTRIBUTE.findall(rest):
        value, key = "".join(values).lower(), key.lower()
        if hidden or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in _SKIP_ROLES:
            return True
        if key in ("class", "id"):
            if value in ("header", "site-header", "page-header") and not in_main:
                return True
            # a name that says something else too is no proof: "related-work" is no advert, "notice-board" no notice
            for parts in map(_NAME.findall, value.split()):
                kinds = [x for x in parts if x not in _BOX_NAMES]
                if kinds and all(x in _SKIP_NAMES for x in kinds):
                    return True
    return False


def blocks_of(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its zone. Takes time in proportion to the page."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside them
    blocks: list[int] = []  # places of block elements in it
    opened: Counter[str] = Counter()
    zone, at, last = PLAIN, 0, page.rfind(">")

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append((joined, zone))
            text.clear()

    def close(k: int) -> None:
        nonlocal zone
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()
        zone = stack[-1][1] if stack else PLAIN

    while at < len(page):
        # behind the last ">" only a comment that never ends can be markup
        tag = _TAG.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        if not tag:
            text.append(page[at:])
            break
        text.append(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            if opened[name] > 0:
                if name in _BLOCK or zone == BOILER:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            elif name in _BLOCK:
                flush()
            continue
        rest = tag["rest"]
        if name == "br":
            text.append(" ")
            continue
        skips = zone == BOILER or _skips(name, rest, zone >= LAYOUT)
        if name in _BLOCK or skips:
            flush()
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at) if at <= last else None
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        # these end one of their kind, if no other block was opened in it
        if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and blocks and stack[blocks[-1]][0] == name:
            close(blocks[-1])
            skips = zone == BOILER or _skips(name, rest, zone >= LAYOUT)
        if skips:
            zone = BOILER
        elif name in ("article", "main"):
            zone = max(zone, LAYOUT)  # also where an element before it was never closed
        elif zone == LAYOUT and name in _PROVED:
            zone = MAIN
        if not rest.endswith("/") or name in _BLOCK:
            if name in _BLOCK:
                blocks.append(len(stack))
            stack.append((name, zone))
            opened[name] += 1
        elif stack:
            zone = stack[-1][1]
    flush()
    return out


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """A longest common subsequence, by Hunt and Szymanski's method."""
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []  # for each length, the chain (place in a, chain before)
    for i, x in enumerate(a):
        for j in reversed(at.get(x, ())):
            p = bisect_left(tails, j)
            chain = (i, ends[p - 1] if p else None)
            tails[p : p + 1] = [j]
            ends[p : p + 1] = [chain]
    out, chain = [], ends[-1] if ends else None
    while chain:
        out.append(a[chain[0]])
        chain = chain[1]
    return out[::-1]


def is_open(zones: list[int]) -> bool:
    """Whether the page's text depends on what its neighbours hold."""
    article = any(z >= LAYOUT for z in zones)
    return any(z == LAYOUT if article else z == PLAIN for z in zones)


def main_blocks(zones: list[int], lines: list[int], shared: set[int]) -> list[int]:
    """Which blocks are the page's text: those of its article if it has one, less what it shares with a neighbour."""
    article = any(z >= LAYOUT for z in zones)
    found = [k for k, z in enumerate(zones) if (z >= LAYOUT if article else z == PLAIN)]
    own = [k for k in found if zones[k] == MAIN or lines[k] not in shared]
    return own or found


def extract(page: str, shared: set[int]) -> str:
    blocks = blocks_of(page)
    return "\n".join(blocks[k][0] for k in main_blocks([z for _, z in blocks], [line_hash(t) for t, _ in blocks], shared))


def _place(url: str) -> tuple[str, str]:
    """Host and path of a URL, without scheme, www. and fragment."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().split("#")[0], flags=re.I)
    host, slash, path = rest.partition("/")
    return host.lower().removeprefix("www."), slash + path


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, whether neighbours matter, and the blocks: hashes (lines), zones and texts, empty for BOILER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
        names = ["page_id", "url", "host", "path", "open", "lines", "zones", "texts"]
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(1), batch.column(2), strict=True):
                blocks = blocks_of(html.as_py() or "")
                rows.append((*_place(url.as_py()), is_open([z for _, z in blocks]), [line_hash(t) for t, _ in blocks], [z for _, z in blocks], [t if z != BOILER else "" for t, z in blocks]))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, host string, path string, open boolean, lines array<long>, zones array<int>, texts array<string>"
    )


#: A page's run, the blocks that a run shares with a neighbour, and runs at the edges of a partition.
_ALIGNED = "page_id long, part long, run long, shared array<long>, host string, lines array<long>, inner array<long>, sides long"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a partition's pages in order of host and path.

    Pages with the same blocks that follow each other are one run, and so share what the run does
    with the runs before and after it. The first and the last run of a partition are given with
    the blocks of their neighbour inside it, for what lies beyond the edge.
    """
    part = TaskContext.get().partitionId()
    schema = pa.schema(
        [(n, pa.list_(pa.int64()) if n in ("shared", "lines", "inner") else pa.string() if n == "host" else pa.int64()) for n in (x.split()[0] for x in _ALIGNED.split(", "))]
    )
    last: tuple[str, list[int]] | None = None
    edges: list[dict] = []
    run = -1
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            mine = (row["host"], row["lines"])
            if mine != last:
                run += 1
                inner = last[1] if last and last[0] == mine[0] else None
                if inner is not None:
                    both = common_lines(inner, mine[1])
                    out += [{"part": part, "run": run - 1, "shared": both}, {"part": part, "run": run, "shared": both}]
                    if run == 1:
                        edges[0]["inner"] = mine[1]
                here = {"part": part, "run": run, "host": mine[0], "lines": mine[1], "inner": inner}
                edges = [*edges[:1], here] if run else [here]
                last = mine
            out.append({"page_id": row["page_id"], "part": part, "run": run})
        yield pa.RecordBatch.from_pylist(out, schema)
    # 1 for the run that begins the partition, 2 for the one that ends it
    sides = [3] if len(edges) == 1 else [1, 2]
    yield pa.RecordBatch.from_pylist([e | {"sides": x} for e, x in zip(edges, sides, strict=False)], schema)


def _over_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """(part, run, shared) for the runs of one host at edges of partitions, at most two of each."""
    runs = rows.sort_values(["part", "run"]).to_dict("records")
    out: list[tuple] = []
    for side, order in ((1, runs), (2, runs[::-1])):
        # the blocks of the run met last, and of the nearest before it that has others
        met: list[int] | None = None
        other: list[int] | None = None
        for r in order:
            mine = list(r["lines"])
            if not r["sides"] & side:  # its neighbour on this side is in its partition
                met, other = mine, None if r["inner"] is None else list(r["inner"])
                continue
            if met is not None and met != mine:
                other = met
            met = mine
            if other is not None:
                out.append((r["part"], r["run"], common_lines(*((other, mine) if side == 1 else (mine, other)))))
    return pd.DataFrame(out, columns=["part", "run", "shared"])


def shared_lines(blocks: DataFrame) -> DataFrame:
    """page_id and shared: hashes of the blocks a page has in common with its neighbours.

    A neighbour is the next page before or after it in its host's order of paths whose blocks are
    not all the same, since copies tell nothing. Pages are range-partitioned by host and path,
    so a host of any size spreads, and the result doesn't depend on where partitions end.
    """
    aligned = written(
        blocks.filter("page_id IS NOT NULL").select("page_id", "host", "path", "lines")
        .repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id").mapInArrow(_align, _ALIGNED),
        "aligned",
    )
    edges = aligned.filter("lines IS NOT NULL").select("part", "run", "host", "lines", "inner", "sides")
    over = edges.groupBy("host").applyInPandas(_over_edges, "part long, run long, shared array<long>")
    runs = aligned.filter("shared IS NOT NULL").select("part", "run", "shared").unionByName(over).filter(F.size("shared") > 0)
    runs = runs.groupBy("part", "run").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    found = aligned.filter("page_id IS NOT NULL").select("page_id", "part", "run").join(runs, ["part", "run"])
    return found.groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and malformed pages are read as far as they go; a page without text has an empty one.
    Repeated rows are rows of their own and don't count as each other's neighbours. A page with a
    null page_id is extracted by its markup alone. Null URLs share the empty host. A page whose
    blocks are all shared keeps them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines, zones, texts, shared in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                out.append("\n".join(texts[k] for k in main_blocks(zones, lines, set(shared or ()))))
            sizes = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
            )

    blocks = written(parsed(pages), "blocks")
    shared = shared_lines(blocks).select(F.col("page_id").alias("_page"), "shared")
    own = ["page_id", "url", "lines", "zones", "texts"]
    # only pages that differencing has a say in are shuffled to meet what they share
    asked = blocks.filter("open").join(shared, F.col("page_id") == F.col("_page"), "left").select(*own, "shared")
    sure = blocks.filter("NOT open").select(*own, F.lit(None).cast("array<long>").alias("shared"))
    return asked.unionByName(sure).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
