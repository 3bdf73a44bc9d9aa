"""HTML extraction: structure first, then a suffix array over the pages of each host.

A page is cut into blocks. What stands in its articles and its main element is its text, without the parts
that tags, classes and roles name as menus, adverts, forms, comments and the like. If these elements hold no first
heading, the last one before them and what follows it are the title and lead, unless the host's pages share them. A page
that marks no such element, or whose marked ones hold little of its text (teasers), has its text among the
other blocks, between boilerplate. The token streams of the host's
pages are dealt into groups and sorted by suffix; substrings are counted by their different pages over all groups of
the host. Blocks that repeated ones cover go, and the unique runs stay. Of marked text only the host's template goes:
lines in its articles that no name tells from them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter.llm.common import Words, mixed, sequence_hashes, slices
from knotmeter.session import materialize

#: Elements whose content is no markup, up to their end tag.
RAW = {"script", "style", "iframe", "textarea", "title"}
#: Elements that are never part of the main text. One that is not closed ends with its parent.
DROPPED = RAW | {
    "nav", "footer", "aside", "form", "dialog", "menu", "head", "noscript", "template", "svg", "select", "button", "object", "audio", "video", "canvas",
}
#: Words in a class, id or role that name such parts.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "subscription", "signup", "popup",
    "modal", "overlay", "share", "sharing", "social", "sidebar", "widget", "related", "recommended", "breadcrumb", "breadcrumbs",
    "menu", "nav", "navbar", "navigation", "masthead", "header", "footer", "comment", "comments", "disqus", "reply", "replies",
    "respond", "pagination", "pager", "toolbar", "login", "search", "skip", "contentinfo", "complementary", "hidden",
}
CONTENT = {"article", "main"}
#: In articles and main elements, and of these themselves, a class with such a word names a part that is no text.
CONTENT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments",
    "disqus", "reply", "replies", "related", "recommended", "newsletter",
}
#: There a class of other words of :data:`NAMES` alone is one too, but for these, which name parts of a text as well.
TEXT_NAMES = {"notice", "alert", "header", "banner", "search", "skip", "masthead"}
WHOLE = {"html", "body"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An element that opens ends an open one of these kinds, unless a container lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"article", "aside", "blockquote", "body", "div", "dl", "footer", "form", "header", "main", "nav", "ol", "section", "table", "td", "th", "ul"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Where a block stands: in a dropped part, outside the main element, in it, in an article.
GONE, OUTSIDE, MAIN, ARTICLE = -1, 0, 1, 2


def _dropped(tag: str, rest: str, zone: int) -> bool:
    if tag in WHOLE:
        return False
    if tag in DROPPED or (tag == "header" and zone < MAIN):
        return True
    if not rest.strip():
        return False
    if _HIDDEN.search(rest):
        return True
    for found in _NAMED.findall(rest):
        for name in "".join(found).split():
            parts = {part.lower() for part in _PART.findall(name)}
            if tag in CONTENT or zone >= MAIN:
                if parts & CONTENT_NAMES or (tag not in CONTENT and parts and parts <= NAMES - TEXT_NAMES):
                    return True
            elif parts & NAMES:
                return True
    return False


class _Open:
    """The elements that are open, with their zones; the depths of each kind are at hand, so no step looks through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, str]] = []
        self.depths: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, tag: str, zone: int, dropped_by: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((tag, zone, dropped_by))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _, _ = self.stack.pop()
            self.depths[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()

    def last(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these kinds, or -1."""
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=-1)

    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else OUTSIDE

    def dropped_by(self) -> str:
        return self.stack[-1][2] if self.stack else ""


def _blocks(page: str) -> list[tuple[str, int, bool]]:
    """The blocks of a page with text, in order, where each stands and whether it is a first heading; linear in the page."""
    blocks: list[tuple[str, int, bool]] = []
    open_, pieces = _Open(), []
    unclosed: set[str] = set()
    zone = at = 0

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append((text, zone, bool(open_.depths.get("h1"))))
            pieces.clear()

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            pieces.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        ending = m["end"] or m["end2"]
        if tag in RAW and not ending and tag not in unclosed:
            if end := _RAW_END[tag].search(page, at):
                at = end.end()
                continue
            unclosed.add(tag)
        if tag in BLOCKS:
            close()
        if ending:
            depth = open_.last([tag])
            if depth >= 0:
                if open_.stack[depth][1] != zone or open_.zone() != (open_.stack[depth - 1][1] if depth else OUTSIDE):
                    close()
                open_.pop_to(depth)
                zone = open_.zone()
            continue
        if tag in VOID:
            continue
        ended = ENDS.get(tag) or ({"p"} if tag in BLOCKS else None)
        if ended:
            depth = open_.last(ended)
            # a container ends the look-out, unless it is itself of a kind that ends
            if depth >= 0 and (not open_.containers or open_.containers[-1] <= depth):
                open_.pop_to(depth)
                zone = open_.zone()
        rest = m["rest"] or m["rest2"] or ""
        inner, dropped_by = zone, open_.dropped_by()
        # some pages are one form
        outer = OUTSIDE if zone == GONE and dropped_by == "form" and tag in CONTENT else zone
        if outer != GONE:
            if _dropped(tag, rest, outer):
                inner, dropped_by = GONE, dropped_by or tag
            elif tag == "article":
                inner, dropped_by = ARTICLE, ""
            elif tag == "main" or "role=\"main\"" in rest:
                inner, dropped_by = max(outer, MAIN), ""
        if inner != zone:
            close()
        open_.push(tag, inner, dropped_by)
        zone = inner
    if at < len(page):
        pieces.append(page[at:])
    close()
    return blocks


def page_blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page with text, in order, and where each stands."""
    return [(text, zone) for text, zone, _ in _blocks(page)]


#: Marked elements with a smaller share of the characters that are not dropped are teasers.
TEASER = 0.25
#: What becomes of a block: it is boilerplate, the search judges it, or it is text.
BOILERPLATE, OPEN, TEXT = 0, 1, 2


def states(blocks: list[tuple[str, int, bool]]) -> list[int]:
    """What the structure of a page says about each block."""
    marked = sum(len(text) for text, zone, _ in blocks if zone >= MAIN)
    outside = sum(len(text) for text, zone, _ in blocks if zone == OUTSIDE)
    if marked < TEASER * (marked + outside) or not marked:
        return [BOILERPLATE if zone == GONE else OPEN for _, zone, _ in blocks]
    out = [TEXT if zone >= MAIN else BOILERPLATE for _, zone, _ in blocks]
    if not any(first and zone >= MAIN for _, zone, first in blocks):
        body = out.index(TEXT)
        title = max((i for i in range(body) if blocks[i][1] == OUTSIDE and blocks[i][2]), default=body)
        for i in range(title, body):
            if blocks[i][1] == OUTSIDE:
                out[i] = OPEN
    return out


#: A boilerplate run has so many tokens at least and stands on so many different pages of a host.
RUN, PAGES = 6, 3
#: On this share of the pages of a page's most frequent run, a run is of the host's template.
TEMPLATE = 0.5
#: The pages of a host meet its number of groups under so many keys.
DEALS = 32
#: Bytes of blocks of a host that are sorted together.
GROUP_BYTES = 4 << 20


#: Bytes of a word's number in the streams of marked text.
WORD_BYTES = 3


def _pages_of_runs(run: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different runs, and on how many pages each stands."""
    order = np.lexsort((page, run))
    run, page = run[order], page[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (page[1:] != page[:-1])
    run, n = np.unique(run[new], return_counts=True)
    return run, n.astype(np.int64)


def _suffixes(host: str, streams: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of the pages, the places of suffixes with :data:`RUN` words at least, and a number for these words on the host."""
    words = Words(pa.array(streams, pa.string()))
    runs = sequence_hashes(words.hashes(), RUN)
    start = np.arange(len(runs))
    start = start[start + RUN <= words.first[words.row[:len(runs)] + 1]]  # no run goes from one page to the next
    salt = np.frombuffer(hashlib.blake2b(host.encode(), digest_size=8).digest(), np.uint64)
    return words, start, mixed(runs[start] ^ salt).view(np.int64)


def _stream(blocks: list[dict]) -> str:
    return " ".join(b["text"] for b in blocks if b["state"] != TEXT)


def _page(row: dict) -> tuple[str, int | None]:
    """Pages with equal ones are the same: the tokens alone, if all of a page's text is searched, else the whole page."""
    found = {b["state"] for b in row["blocks"]}
    return _stream(row["blocks"]), None if OPEN in found and TEXT not in found else row["kind"]


def _counted_runs(part: pa.Table) -> pa.Table:
    """On how many different pages of the group each run stands.

    A host of one group has no use for the runs on fewer than :data:`PAGES`.
    """
    rows = part.to_pylist()
    words, start, run = _suffixes(rows[0]["host"], [stream for stream, _ in {_page(r) for r in rows}])
    run, n = _pages_of_runs(run, words.row[start])
    if rows[0]["groups"] == 1:
        run, n = run[n >= PAGES], n[n >= PAGES]
    keys = [pa.array([rows[0][name]] * len(run), kind) for name, kind in (("host", pa.string()), ("group", pa.int64()))]
    return pa.table({"host": keys[0], "group": keys[1], "run": pa.array(run), "n": pa.array(n)})


def unique_blocks(blocks: list[dict], pages: np.ndarray) -> list[str]:
    """The blocks that stay, given for each token of the stream the most pages of the host that a run over it stands on.

    Open blocks of the template go: half of their tokens stand on :data:`TEMPLATE` of the pages of the most frequent
    run. Of the others those go that are repeated, such as notices on some pages, unless these are more than
    half of what is left: then the page carries an article of other pages. Beside text that the structure names, only
    the template goes.
    """
    template = max(PAGES, TEMPLATE * pages.max(initial=0))
    at, left = 0, []
    for block in blocks:
        if block["state"] == TEXT:
            left.append((block["text"], 0, False))
            continue
        own = pages[at:at + len(block["text"].split())]
        at += len(own)
        if block["state"] == OPEN and len(own) and (own >= template).mean() < 0.5:
            left.append((block["text"], len(own), (own >= PAGES).mean() >= 0.5))
    again = sum(n for _, n, repeated in left if repeated)
    spared = 2 * again > sum(n for _, n, _ in left) or any(b["state"] == TEXT for b in blocks)
    return [text for text, _, repeated in left if spared or not repeated]


def _unique_runs(part: pa.Table, repeated: pa.Table) -> pa.Table:
    rows = part.to_pylist()
    if not rows:
        return pa.table({"host": pa.array([], pa.string()), "kind": pa.array([], pa.int64()), "found": pa.array([], pa.string())})
    words, start, run = _suffixes(rows[0]["host"], [_stream(r["blocks"]) for r in rows])
    known, n = repeated.column("run").to_numpy(), repeated.column("pages").to_numpy()
    order = np.argsort(known)
    known, n = np.append(known[order], 0), np.append(n[order], 0)
    at = np.searchsorted(known[:-1], run)
    n = np.where(known[at] == run, n[at], 0)
    pages = np.zeros(len(words), np.int64)
    for k in range(RUN):
        np.maximum.at(pages, start + k, n)
    searched = [(i, r) for i, r in enumerate(rows) if any(b["state"] == OPEN for b in r["blocks"])]
    texts = ["\n".join(unique_blocks(r["blocks"], pages[words.first[i]:words.first[i + 1]])) for i, r in searched]
    return pa.table({
        "host": pa.array([r["host"] for _, r in searched], pa.string()), "kind": pa.array([r["kind"] for _, r in searched], pa.int64()),
        "found": pa.array(texts, pa.string()),
    })


def _word_numbers(texts: pa.Array) -> list[bytes]:
    """The words of each text as numbers of :data:`WORD_BYTES`."""
    words = Words(texts)
    data = words.hashes().view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
    return [data[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _runs(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each stream, and the places, streams and numbers of all runs."""
    counts = [len(x) // WORD_BYTES for x in streams]
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    raw = np.zeros((first[-1], 8), np.uint8)
    raw[:, :WORD_BYTES] = np.frombuffer(b"".join(streams), np.uint8).reshape(-1, WORD_BYTES)
    runs = sequence_hashes(mixed(raw.view("<u8")[:, 0]), RUN)
    row = np.repeat(np.arange(len(streams)), counts)[:len(runs)]
    start = np.arange(len(runs))
    start = start[start + RUN <= first[row + 1]]
    return first, start, row[start], runs[start].view(np.int64)


def _marked_streams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, groups, stream``, equal ones of a batch once."""
    for batch in slices(batches, "text"):
        rows = dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _word_numbers(batch.column(2)), strict=True))
        columns = zip(*rows, strict=True)
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["host", "groups", "stream"])


def _frequent_runs(part: pa.Table) -> pa.Table:
    """The runs on :data:`TEMPLATE` of the group's different pages, and a row without run that has the number of these pages.

    A run on such a share of the host's pages is on that share in one of its groups at least.
    """
    streams = list(set(part["stream"].to_pylist()))
    _, _, page, run = _runs(streams)
    run, n = _pages_of_runs(run, page)
    frequent = n >= TEMPLATE * len(streams)
    run, n = run[frequent], n[frequent]
    size = len(run) + 1
    return pa.table({
        "host": pa.array([part["host"][0].as_py()] * size, pa.string()), "groups": pa.array([part["groups"][0].as_py()] * size, pa.int64()),
        "run": pa.array([None, *run.tolist()], pa.int64()), "n": pa.array([len(streams), *n.tolist()], pa.int64()),
    })


def _counted_again(part: pa.Table, wanted: pa.Table) -> pa.Table:
    """On how many different pages of the group the wanted runs stand."""
    _, _, page, run = _runs(list(set(part["stream"].to_pylist())))
    asked = np.isin(run, wanted["run"].to_numpy())
    run, n = _pages_of_runs(run[asked], page[asked])
    host = part["host"][0].as_py() if len(part) else None
    return pa.table({"host": pa.array([host] * len(run), pa.string()), "run": pa.array(run), "n": pa.array(n)})


def host_templates(parsed: DataFrame) -> DataFrame:
    """``host, template``: the runs on :data:`TEMPLATE` of the different marked texts of a host, and on :data:`PAGES` at least; stored.

    Streams are shuffled once; those of a host of many groups once more if it has runs that may be frequent.
    """
    groups = F.ceil((F.sum("size") + 1) / GROUP_BYTES).alias("groups")
    # at most one a group of blocks
    large = F.broadcast(parsed.groupBy("host").agg(groups).where("groups > 1"))
    marked = (
        parsed.join(large, "host", "left").select("host", F.coalesce("groups", F.lit(1)).cast("long").alias("groups"), _texts(TEXT, " ").alias("text"))
        .where("text <> ''")
    )
    kind = "host string, groups long, stream binary"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_marked_streams, kind).withColumn("group", F.pmod(F.xxhash64("stream"), F.col("groups")))

    found = materialize(dealt(marked).groupBy("host", "group").applyInArrow(_frequent_runs, "host string, groups long, run long, n long"))
    pages = found.where("run is null").groupBy("host").agg(F.sum("n").alias("pages"))
    wanted = found.where("run is not null and groups > 1").select("host", "groups", "run").distinct()
    spread_out = wanted.select("host", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    again = (
        dealt(marked.where("groups > 1").join(wanted.select("host").distinct(), "host", "left_semi")).groupBy("host", "group")
        .cogroup(spread_out.groupBy("host", "group")).applyInArrow(_counted_again, "host string, run long, n long")
    )
    counted = found.where("run is not null and groups = 1").select("host", "run", "n").unionByName(again)
    total = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(pages, "host")
    return materialize(
        total.where((F.col("n") >= PAGES) & (F.col("n") >= TEMPLATE * F.col("pages"))).groupBy("host").agg(F.collect_list("run").alias("template"))
    )


def _without_template(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked blocks of which half the words stand in runs of the template are boilerplate, unless these have more than
    half of the page's marked words: then the host copies articles."""
    for batch in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
        at = batch.schema.get_field_index("blocks")
        pages = batch.column(at).to_pylist()
        marked = [[b for b in blocks if b["state"] == TEXT] for blocks in pages]
        first, start, row, run = _runs(_word_numbers(pa.array([" ".join(b["text"] for b in blocks) for blocks in marked], pa.string())))
        hit = np.zeros(len(run), bool)
        edges = np.searchsorted(row, np.arange(len(pages) + 1))
        for i, template in enumerate(batch.column(at + 1).to_pylist()):
            hit[edges[i]:edges[i + 1]] = np.isin(run[edges[i]:edges[i + 1]], np.array(template, np.int64))
        covered = np.zeros(first[-1] + RUN, bool)
        for k in range(RUN):
            covered[start[hit] + k] = True
        for i, blocks in enumerate(marked):
            place, gone = first[i], []
            for b in blocks:
                n = len(b["text"].split())
                if n and 2 * int(covered[place:place + n].sum()) >= n:
                    gone.append((b, n))
                place += n
            if 2 * sum(n for _, n in gone) <= first[i + 1] - first[i]:
                for b, _ in gone:
                    b["state"] = BOILERPLATE
        columns = [pa.array(pages, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:at + 1])]
        yield pa.record_batch(columns, batch.schema.names[:at + 1])


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = []
        for page in batch.column(2).to_pylist():
            blocks = _blocks(page or "")
            found.append([{"text": b[0], "state": x} for b, x in zip(blocks, states(blocks), strict=True)])
        kind = pa.list_(pa.struct([("text", pa.string()), ("state", pa.int32())]))
        yield pa.record_batch([*batch.columns[:2], pa.array(found, kind)], ["page_id", "url", "blocks"])


def _texts(state: int, mark: str) -> Column:
    return F.array_join(F.transform(F.filter("blocks", lambda b: b["state"] == state), lambda b: b["text"]), mark)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of each page, its blocks joined by line feeds; empty if there is none.

    Null html counts as empty. Rows are kept apart even if they are equal. A host's pages are sorted in
    groups of about :data:`GROUP_BYTES` of blocks, so that a host with a
    third of all pages is many groups. Marked texts are shuffled as word numbers, to count their runs; pages of hosts without a template
    are not shuffled further, unless their title is in doubt. Equal pages are searched once and
    equal streams of pages without marked text are dealt to one group, so the pages of a run add up over the groups, and the result does not depend on
    how many there are. A host without a name is one like any other.
    """
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = narrow.mapInArrow(_parse, "page_id long, url string, blocks array<struct<text:string,state:int>>")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    parsed = materialize(parsed.select("page_id", "url", host.alias("host"), size.alias("size"), "blocks"), "zstd")
    templates = host_templates(parsed)
    shared = parsed.join(templates, "host").select(*parsed.columns, "template")
    shared = shared.mapInArrow(_without_template, parsed.schema)
    judged = parsed.join(templates, "host", "left_anti").select(*parsed.columns).unionByName(shared)
    searched = F.exists("blocks", lambda b: b["state"] == OPEN)
    marked = judged.where(~searched).select("page_id", "url", _texts(TEXT, "\n").alias("text"))
    return marked.unionByName(_searched_texts(judged, searched))


def _searched_texts(judged: DataFrame, searched: Column) -> DataFrame:
    """``page_id, url, text`` of the pages with blocks that their host's search judges."""
    blocks = F.when(searched, F.col("blocks")).otherwise(F.filter("blocks", lambda b: b["state"] != TEXT))
    parsed = judged.select("page_id", "url", "host", "size", blocks.alias("blocks"), F.xxhash64("blocks").alias("kind"), searched.alias("searched"))
    # only hosts with a page that has to be searched
    groups = (
        parsed.groupBy("host").agg(F.sum("size").alias("bytes"), F.count_if("searched").alias("n")).where("n > 0")
        .select("host", F.ceil((F.col("bytes") + 1) / GROUP_BYTES).alias("groups"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    )
    stream = F.array_join(F.transform(F.filter("blocks", lambda b: b["state"] != TEXT), lambda b: b["text"]), " ")
    plain = F.exists("blocks", lambda b: b["state"] == OPEN) & ~F.exists("blocks", lambda b: b["state"] == TEXT)
    dealt = (
        parsed.select("host", "kind", "blocks").dropDuplicates(["host", "kind"])
        .withColumn("deal", F.pmod("kind", F.lit(DEALS)).cast("int")).join(groups, ["host", "deal"])
        .withColumn("group", F.pmod(F.when(plain, F.xxhash64(stream)).otherwise(F.col("kind")), F.col("groups")))
    )
    runs = materialize(dealt.groupBy("host", "group").applyInArrow(_counted_runs, "host string, group long, run long, n long"))
    repeated = runs.groupBy("run").agg(F.sum("n").alias("pages")).where(F.col("pages") >= PAGES)
    known = runs.select("host", "group", "run").join(repeated, "run")
    found = (
        dealt.groupBy("host", "group").cogroup(known.groupBy("host", "group"))
        .applyInArrow(_unique_runs, "host string, kind long, found string")
    )
    open_ = parsed.where("searched").select("host", "kind", "page_id", "url").join(found, ["host", "kind"], "left")
    return open_.select("page_id", "url", F.coalesce("found", F.lit("")).alias("text"))
