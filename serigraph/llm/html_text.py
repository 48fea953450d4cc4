"""Main text of web pages by differencing each page against the one with the nearest URL."""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from serigraph.llm._common import checkpoint, record_batch

#: Neighbouring addresses that are compared in one task, and pages of one address: as many as make GROUPS tasks of all, within these.
GROUP_PAGES, MOST_PAGES, GROUPS = 512, 8_192, 2_000

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|title|iframe|object)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<[!?/][^>]*>"
    r"|</?[a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Elements and words of class, id or role that mark what is no article text.
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice"
    " newsletter subscribe promo promotion sponsored sponsor share sharing social related comment comments commentlist respond disqus popup modal".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))


def _is_chrome(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME_TAGS or tag == "header" and not in_main:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    return any(w in CHROME_WORDS for m in _NAMED.finditer(attrs) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))


#: Addresses on each side of a page's own that are compared with it, and how many of them must hold a line at an end of the article.
NEAR, HELD_BY = 2, 2


def page_lines(source: str) -> list[tuple[int, str]]:
    """(where, text) of each block in page order; where: 3 a title (h1, h2) inside an article or main element, 2 other text in one, 1 elsewhere, 0 chrome."""
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, whether it made the text chrome, whether it made it main
    chrome = main = title = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            lines.append((0 if chrome else 3 if main and title else 2 if main else 1, text))

    at = 0
    for m in _MARK.finditer(source):
        if m.start() > at:
            held.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
            title = tag in ("h1", "h2") and not m["close"]
        if m["close"]:
            # an element that was left open inside ends with the one around it; paragraphs may stay open
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    if any(x[1] or x[2] for x in open_[i:]):
                        flush()
                    for _, was_chrome, was_main in open_[i:]:
                        chrome -= was_chrome
                        main -= was_main
                    del open_[i:]
                    break
                if open_[i][0] in ("article", "main", "body", "nav", "footer", "aside", "form") and tag in ("p", "b", "i", "a", "span", "em", "strong"):
                    break
        elif tag not in VOID_TAGS:
            if tag in ("p", "li", "tr", "td", "option"):
                # such an element ends an open one of its kind
                for i in range(len(open_) - 1, max(-1, len(open_) - 4), -1):
                    if open_[i][0] == tag and not open_[i][1] and not open_[i][2]:
                        if not any(x[1] or x[2] for x in open_[i:]):
                            del open_[i:]
                        break
            is_chrome, is_main = _is_chrome(tag, m["attrs"], main > 0), tag in MAIN_TAGS
            if is_chrome or is_main:
                flush()
            open_.append((tag, is_chrome, is_main))
            chrome += is_chrome
            main += is_main
    held.append(html.unescape(source[at:]))
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> dict[int, int]:
    """Positions of a, and those of b they align with, in a longest common subsequence of a and b.

    Equal ends are aligned first, the rest by the longest chain of increasing matches.
    """
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while min(high_a, high_b) > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    places: dict[str, list[int]] = {}
    for j in range(high_b - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(low, high_a):
        for j in places.get(a[i], ()):  # from right to left, so that a line is used once
            k = bisect_left(ends, j)
            chain = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            elif j < ends[k]:
                ends[k], chains[k] = j, chain
    out = {i: i for i in range(low)} | {i: i + high_b - high_a for i in range(high_a, len(a))}
    link = chains[-1] if chains else None
    while link:
        out[link[0]] = link[1]
        link = link[2]
    return out


def _ends(page: list[tuple[int, str]], kept: list[int], near: Sequence[list[tuple[int, str]]]) -> list[int]:
    """kept without the notices at the ends of the article: lines before its first or after its last own line that HELD_BY of the near pages hold as well.

    A shared line between own lines is text, as is a title that only this page has. Copies of the page don't count.
    """
    texts = [page[i][1] for i in kept]
    held = [0] * len(kept)
    for other in near:
        least = 2 if any(where >= 2 for where, _ in other) else 1
        aligned = shared_lines(texts, [t for where, t in other if where >= least])
        if len(aligned) < len(kept):
            for i in aligned:
                held[i] += 1
    gone = set()
    for order in (range(len(kept)), reversed(range(len(kept)))):
        for i in order:
            if held[i] >= HELD_BY:
                gone.add(i)
            elif page[kept[i]][0] != 3:
                break
    return [k for i, k in enumerate(kept) if i not in gone]


def main_text(page: list[tuple[int, str]], *others: list[tuple[int, str]], near: Sequence[list[tuple[int, str]]] = ()) -> str:
    """Blocks of page that are no chrome, without those shared with the first other that is no copy of it; of pages with an article, only its blocks.

    A block that both pages hold inside their article element is text of both articles and stays, but at the article's ends
    goes if several of the near pages hold it. A page that would have nothing left is a copy, of the same body.
    """
    least = 2 if any(where >= 2 for where, _ in page) else 1
    kept = [i for i, (where, _) in enumerate(page) if where >= least]
    for other in others:
        aligned = shared_lines([t for _, t in page], [t for _, t in other])
        gone = {i for i, j in aligned.items() if min(page[i][0], other[j][0]) < 2}
        own = [i for i in kept if i not in gone]
        if own:
            kept = own
            break
    kept = _ends(page, kept, near) or kept
    return " ".join(page[i][1] for i in kept)


def _partners(paths: list[str]) -> list[int | None]:
    """For each of the sorted paths, the neighbour of another path with the longer common prefix (the one before on ties)."""
    n = len(paths)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for i in range(1, n):
        before[i] = i - 1 if paths[i] != paths[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if paths[i] != paths[i + 1] else after[i + 1]
    out = []
    for i, path in enumerate(paths):
        near = [j for j in (before[i], after[i]) if j is not None]
        out.append(max(near, key=lambda j: len(commonprefix([path, paths[j]]))) if near else None)
    return out


ADDRESS = ["host", "path", "query"]


def _neighbourhoods(rows: DataFrame) -> tuple[list[tuple], dict[tuple, int], dict[tuple, tuple]]:
    """The first address of each group in order, the parts of addresses with more pages than a group, and for addresses that
    other groups need: their first page (url, page_id) and those groups (number, part). A few rows for each group: with
    MOST_PAGES some 120,000 groups, or about 100 MB, for a billion pages."""
    keys = rows.groupBy(*ADDRESS).agg(F.count("*").alias("n"), F.min(F.struct("url", "page_id")).alias("rep"))
    keys = checkpoint(keys.repartitionByRange(*ADDRESS).sortWithinPartitions(*ADDRESS).withColumn("m", F.monotonically_increasing_id()))
    at, bases = 0, []
    for task, n in sorted(map(tuple, keys.groupBy(F.shiftright("m", 33)).count().collect())):
        bases.append((task, at))
        at += n
    bases = F.broadcast(rows.sparkSession.createDataFrame(bases, "task long, base long"))
    size = max(GROUP_PAGES, min(MOST_PAGES, at // GROUPS))
    rank = F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    parts = F.ceil(F.col("n") / size).cast("int")
    keys = keys.withColumn("task", F.shiftright("m", 33)).join(bases, "task").select(*ADDRESS, "rep", rank.alias("rank"), F.floor(rank / size).alias("number"), parts.alias("parts"))
    paths = keys.groupBy("host", "path").agg((F.min("rank") - 1).alias("low"), (F.max("rank") + 1).alias("high"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    needs = keys.join(paths, ["host", "path"]).select("host", "number", every, F.array(*[F.col("rank") + k for k in range(-NEAR, NEAR + 1) if k], "low", "high").alias("ranks"))
    needs = needs.select("host", "number", "part", F.explode("ranks").alias("rank")).distinct()
    owners = keys.select(*ADDRESS, "rep", "rank", F.col("number").alias("own"), "parts")
    lent = needs.join(owners, ["host", "rank"]).where("own <> number or part <> 0 or parts > 1").groupBy(*ADDRESS).agg(F.first("rep").alias("rep"), F.collect_set(F.struct("number", "part")).alias("to"))
    bounds = keys.where(F.col("rank") % size == 0).orderBy("rank").select(*ADDRESS).collect()
    return (
        [tuple(r) for r in bounds], {(r["host"], r["path"], r["query"]): r["parts"] for r in keys.where("parts > 1").collect()},
        {(r["host"], r["path"], r["query"]): (tuple(r["rep"]), [tuple(x) for x in r["to"]]) for r in lent.collect()},
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    Blocks of text are read from the whole html, however long, paired with the page of the nearest path and query on the same
    host, and lines that the two share are deleted, unless both mark them as article or nothing would be left: then the pages
    are copies, and if only the query differs, the nearest other path is taken instead. Of lines of the article those before its first or
    after its last own line are deleted if HELD_BY of the pages at the NEAR addresses on each side hold them too: notices that a
    site puts into its articles; a line that documents repeat between lines of their own stays. Menus, forms and the like go
    by element and class. Null html, and html without text, give an empty text; a null url is a host of
    its own; rows that repeat are separate pages, none of which is the other's partner; on ties the earlier path is nearer,
    and the first page by url and page_id stands for an address; a page without a partner is judged by its elements alone;
    other columns are dropped; an empty table gives an empty one. All addresses are put in order and cut into groups; pages
    next to a cut go to both sides, so that a host of any size gives each page its nearest one on the whole host.
    """
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.substring_index(address, "/", 1))
    path = F.regexp_replace(F.substr(address, F.length(host) + 1), r"(\.html?|/)$", "")
    query = F.regexp_extract(F.regexp_replace(F.coalesce("url", F.lit("")), r"#.*$", ""), r"\?.*$", 0)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), query.alias("query"), "html")
    shared = pages.sparkSession.sparkContext.broadcast(_neighbourhoods(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        bounds, parts, lent = shared.value
        for batch in batches:
            packed = [packer.compress(json.dumps(page_lines(h.as_py() or ""), ensure_ascii=False).encode("utf-8", "replace")) for h in batch.column("html")]
            at, number, part, own = [], [], [], []
            for i, (page, url, *key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", *ADDRESS)), strict=True)):
                key = tuple(key)
                rep, to = lent.get(key, (None, ()))
                homes = [(bisect_right(bounds, key) - 1, zlib.crc32(f"{page} {url} {i}".encode()) % parts.get(key, 1)), *(to if rep == (url, page) else ())]
                for k, home in enumerate(homes):
                    at.append(i)
                    number.append(home[0])
                    part.append(home[1])
                    own.append(k == 0)
            take = pa.array(at, pa.int64())
            columns = [batch.column(c).take(take) for c in ("page_id", "url", *ADDRESS)]
            columns += [pa.array(number, pa.int64()), pa.array(part, pa.int32()), pa.array(own, pa.bool_()), pa.array(packed, pa.binary()).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", *ADDRESS, "number", "part", "own", "lines"])

    def difference(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        group = group.sort_by([(c, "ascending") for c in (*ADDRESS, "url", "page_id", "lines")])
        packed, own = group.column("lines").to_pylist(), group.column("own").to_pylist()
        rows = list(zip(*(group.column(c).to_pylist() for c in ADDRESS), strict=True))
        first = {key: i for i, key in reversed(list(enumerate(rows)))}
        hosts: dict[str, list[tuple]] = {}
        for key in sorted(first):
            hosts.setdefault(key[0], []).append(key)
        partners: dict[tuple, list[int]] = {}
        around: dict[tuple, list[int]] = {}
        for keys in hosts.values():
            near, far = _partners([k[1] + k[2] for k in keys]), _partners([k[1] for k in keys])
            for key, a, b in zip(keys, near, far, strict=True):
                chosen = [a, b] if a is not None and keys[a][1] == key[1] else [b]
                partners[key] = [first[keys[j]] for j in chosen if j is not None]
            for i, key in enumerate(keys):
                around[key] = [first[k] for k in keys[max(0, i - NEAR) : i] + keys[i + 1 : i + 1 + NEAR]]
        texts, mine, read_at = [], [], {}
        for i in range(len(rows)):
            if not own[i]:
                continue
            for j in (i, *partners[rows[i]], *around[rows[i]]):
                if j not in read_at:
                    read_at[j] = json.loads(unpack(packed[j]))
            mine.append(i)
            texts.append(main_text(read_at[i], *(read_at[j] for j in partners[rows[i]]), near=[read_at[j] for j in around[rows[i]]]))
            # neighbours only are needed again
            if len(read_at) > 64:
                read_at = {j: x for j, x in read_at.items() if j in around[rows[i]] or j >= i}
        group = group.take(pa.array(mine, pa.int64()))
        batch = record_batch({"page_id": (group.column("page_id").to_pylist(), pa.int64()), "url": (group.column("url").to_pylist(), pa.string()), "text": (texts, pa.string()), "n_chars": (list(map(len, texts)), pa.int64())})
        return pa.Table.from_batches([batch])

    lines = rows.mapInArrow(read, "page_id long, url string, host string, path string, query string, number long, part int, own boolean, lines binary")
    return lines.groupBy("number", "part").applyInArrow(difference, "page_id long, url string, text string, n_chars long")
