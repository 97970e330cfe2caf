"""Main text of web pages by nearest-URL page differencing, with the structure of the page as a prior.

A page is read as lines, one for each block of text. Within each host, pages are ordered by path; every page is paired
with the neighbour that shares more of its path; all lines of both are aligned by longest common subsequence, and the
shared ones are deleted. A neighbour whose text is the very same is a copy and shows nothing about the template, so the
nearest one before it that differs is used.

The prior takes away what differs from page to page and isn't text all the same: lines inside menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like, by element or by the words of class, id and role; and lines
outside the article, if the page marks one (article, main, or the like). These lines take part in the alignment, too.

Pages of a host, hot or not, are dealt into ranges of path; the rows at the ends of a range go to the next range
too, so that every page meets its true neighbours whatever the number of ranges.

Defined results: null and empty html give an empty text; a null url counts as host and path empty; a page alone in
its host, or among copies only, keeps all lines; repeated rows are each judged; ties between neighbours go to the
one before; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, hash_share

#: Pages in one range of paths, about; rows of the sample that finds the ranges, at most.
RANGE_ROWS = 20_000
SAMPLE = 8192
SEED = 4

# Elements of HTML by what they do to text.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "math", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
_DROP = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "fieldset", "label", "legend", "datalist"}
_REGION = {"html", "body", "article", "main", "section", "div", "header", "table", "ul", "ol", "dl", "figure", "blockquote", "details", "center", "span", "p", "td", "li"} | _DROP
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "meta", "link", "base"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "toolbar", "alertdialog", "form"}
_DROP_WORDS = {"ad", "ads", "adv", "banner", "popup", "modal", "overlay", "gdpr", "consent", "toolbar", "pagination", "pager", "login", "signup", "search", "searchbox", "widget", "disqus", "replies", "respond", "masthead", "copyright", "share", "sharing", "social", "related", "recommended", "outbrain", "taboola", "notice", "notices", "hidden"}
_DROP_OPENINGS = ("advert", "sponsor", "promo", "cookie", "comment", "sidebar", "breadcrumb", "newsletter", "subscri", "footer", "navbar", "navigation", "menu", "topbar", "skiplink")
_MAIN_WORDS = re.compile(r"(?:^|[\s\"'])(?:article|post|entry|story|page|main)[-_]?(?:body|content|text)(?:$|[\s\"'])", re.I)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _role(tag: str, attributes: str, inside: bool) -> str:
    """`drop`, `main` or ``: what an element makes of what is in it. inside: whether it is inside an article."""
    if tag in _DROP or tag == "header" and not inside:
        return "drop"
    if not attributes or tag in ("html", "body"):
        return "main" if tag in ("article", "main") else ""
    values = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), a or b or c)
    if values.get("role", "").lower() in _DROP_ROLES or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|$)", _ATTRIBUTE.sub(" ", attributes)):
        return "drop"
    named = f"{values.get('class', '')} {values.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(named)}
    if tag in ("article", "main"):
        return "drop" if any(w.startswith(("comment", "advert", "sponsor")) for w in words) else "main"
    if words & _DROP_WORDS or any(w.startswith(_DROP_OPENINGS) for w in words) or not inside and words & {"header", "nav"}:
        return "drop"
    if values.get("role", "").lower() in ("main", "article") or values.get("itemprop", "") == "articleBody" or _MAIN_WORDS.search(f" {named} "):
        return "main"
    return ""


def all_lines(page: str | None) -> tuple[bool, list[str], list[bool]]:
    """Whether the page marks its article, all lines of the page, and which the prior keeps: the article's, or else all
    that no element drops."""
    page = page or ""
    found: list[tuple[str, str]] = []  # lines, and `main`, `drop` or `` for where they were
    piece: list[str] = []
    dropped: list[str] = []
    open_: list[tuple[str, str]] = []  # the regions that are open
    drop = inside = 0
    marked = False
    at = 0

    def end(pieces: list[str], where: str) -> None:
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces)).replace("​", "")).strip()
            pieces.clear()
            if text:
                found.append((text, where))

    def leave(k: int) -> None:
        nonlocal drop, inside
        for _, role in open_[k:]:
            drop -= role == "drop"
            inside -= role == "main"
        del open_[k:]
        if not drop:
            end(dropped, "drop")

    while True:
        m = _TAG.search(page, at)
        if m is None:
            (dropped if drop else piece).append(page[at:])
            break
        if m.start() > at:
            (dropped if drop else piece).append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in _RAW and not closing:
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                at = close.end() if close else len(page)
            continue
        if tag not in _INLINE:
            if tag == "br":
                (dropped if drop else piece).append(" ")
            elif drop:
                end(dropped, "drop")
            else:
                end(piece, "main" if inside else "")
        if tag not in _REGION or tag in _VOID:
            continue
        if closing:
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
            # A stray end inside a smaller region doesn't close a larger one of inline or paragraph kind.
            if k is not None and not (tag in ("p", "span", "li", "td") and any(t in ("article", "main", "body", "nav", "aside", "footer", "form", "div", "section") for t, _ in open_[k + 1 :])):
                leave(k)
            continue
        if tag in ("p", "li", "td") and open_ and open_[-1][0] == tag:
            leave(len(open_) - 1)
        role = _role(tag, m[3] or m[6] or "", inside > 0)
        if role == "" and tag in ("span", "p", "td", "li"):
            continue  # only what has a role need be followed
        open_.append((tag, role))
        drop += role == "drop"
        inside += role == "main"
        marked |= role == "main" and not drop
    end(dropped, "drop")
    if not drop:
        end(piece, "main" if inside else "")
    marked = marked and any(where == "main" for _, where in found)
    return marked, [line for line, _ in found], [where == ("main" if marked else "") for _, where in found]


def lines(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the lines that the prior keeps."""
    marked, every, kept = all_lines(page)
    return marked, [line for line, k in zip(every, kept) if k]


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in the longest common subsequence of a and b (bit-parallel, whole rows kept for the way back)."""
    of_b, shared = set(b), [False] * len(a)
    # Lines that the other page lacks are in no common subsequence.
    at = [i for i, line in enumerate(a) if line in of_b]
    a = [a[i] for i in at]
    of_a = set(a)
    b = [line for line in b if line in of_a]
    masks: dict[str, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for line in a:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    common = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j = len(a), len(b)
    while i and j and (n := common(i, j)):
        if common(i - 1, j) == n:
            i -= 1
            continue
        while rows[i] >> (j - 1) & 1:
            j -= 1
        shared[at[i - 1]] = True
        i, j = i - 1, j - 1
    return shared


def _key(url: Column, page_id: Column) -> Column:
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    return F.concat(host, F.lit("\x01"), path, F.lit("\x01"), F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0"))


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_shared) of each row of pages; n_shared lines were found on a neighbour and deleted."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _key(F.col(url_col), F.col(id_col)).alias("key"), F.col(html_col).alias("html"))
    id_type = dict(pages.dtypes)[id_col]

    @F.arrow_udf("struct<lines:array<string>,kept:array<boolean>>")
    def read(htmls: pa.Array) -> pa.Array:
        found = [all_lines(h) for h in htmls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.bool_()))], names=["lines", "kept"])

    parsed = rows.select("id", "url", "key", read("html").alias("r")).select("id", "url", "key", "r.lines", "r.kept")

    # The ranges: bounds from a sample, then the true first and last key of each range.
    count = rows.count()
    sample = sorted((r.key for r in rows.where(hash_share("key", bounded_share(count, SAMPLE), SEED)).select("key").collect()), key=str.encode)  # about SAMPLE at most
    parts = max(1, min(len(sample), max(-(-count // RANGE_ROWS), pages.sparkSession.sparkContext.defaultParallelism)))
    bounds = [sample[len(sample) * i // parts].encode() for i in range(1, parts)] if sample else []

    @F.arrow_udf("int")
    def part_of(keys: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, k.encode()) for k in keys.to_pylist()], pa.int32())

    ends = sorted(rows.select("key", part_of("key").alias("part")).groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())  # one row a range
    also: dict[str, set[int]] = {}
    for a, b in zip(ends[:-1], ends[1:]):
        also.setdefault(a.last, set()).add(b.part)
        also.setdefault(b.first, set()).add(a.part)

    @F.arrow_udf("array<int>")
    def parts_of(keys: pa.Array) -> pa.Array:
        own = [bisect.bisect_right(bounds, k.encode()) for k in keys.to_pylist()]
        return pa.array([[p, *sorted(also.get(k, ()))] for p, k in zip(own, keys.to_pylist())], pa.list_(pa.int32()))

    dealt = parsed.select("id", "url", "key", "lines", "kept", F.posexplode(parts_of("key")).alias("guest", "part"))
    dealt = dealt.repartition(max(1, len(ends)), "part").sortWithinPartitions("part", "key")

    def difference(batches):
        before = None  # the nearest row before whose text differs from that of the one at hand
        held = None  # the row whose next isn't known yet, and its neighbour before
        out: list[tuple] = []

        def settle(following):
            row, prior = held
            best, most = None, -1
            for mate in (prior, following):
                if mate is not None and mate[:2] == row[:2] and mate[3] != row[3] and (n := _common_prefix(mate[2], row[2])) > most:
                    best, most = mate, n
            if not row[4]:
                every, kept = row[7], row[8]
                marks = shared_lines(every, best[7]) if best else [False] * len(every)
                out.append((row[5], row[6], " ".join(x for x, k, s in zip(every, kept, marks) if k and not s), sum(k and s for k, s in zip(kept, marks))))

        def flush():
            batch = pa.record_batch([pa.array([o[0] for o in out], id_kind), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.int32())], names=["id", "url", "text", "n_shared"])
            out.clear()
            return batch

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("id").type
            for r in batch.to_pylist():
                host, path, _ = r["key"].split("\x01", 2)
                text = [x for x, k in zip(r["lines"], r["kept"]) if k]
                row = (r["part"], host, path, text, r["guest"] > 0, r["id"], r["url"], r["lines"], r["kept"])
                if held:
                    settle(row)
                    if held[0][:2] != row[:2]:
                        before = None
                    elif held[0][3] != row[3]:
                        before = held[0]
                held = (row, before)
            if len(out) > 1000:
                yield flush()
        if held:
            settle(None)
        if out:
            yield flush()

    found = dealt.select("id", "url", "key", "lines", "kept", "guest", "part").mapInArrow(difference, f"id {id_type}, url string, text string, n_shared int")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
