"""Main-text extraction from HTML by equivalence-class template deduction.

Pass 1 reads every page as tokens: tags and text blocks, each with the path of elements around it. Tokens of
one host are summed up: on how many pages they are, a fingerprint of their occurrence vector (which pages, how often
on each) and their mean place. Tokens of a host with equal vectors that are on at least ``MIN_PAGES`` and ``SUPPORT`` of its pages
form an equivalence class. On a page a class is valid if it is ordered (the first occurrences of its tokens come in the order of
their mean places, then the second ones, and so on) and nested with the valid classes of more pages: where tokens of one come between
two tokens of another, the whole occurrence does. A class of texts without a tag counts only on ``WIDE`` of the pages: on fewer it is a passage that
articles share. What the valid classes hold is the template; what lies between is the slots.

Pass 2 takes the slots of each page and leaves out elements that are no part of an article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments: by tag, role and class names). The article is where the
slots' text is: from the page down, the one element of the template (one that comes once a page) that holds over ``HOLDS`` of it, until none does or
it is an ``article``. Of several articles there the largest is taken; a ``main`` is taken in place of what is around it; elsewhere blocks
that are mostly links go, and ``h1`` headings of the page stay. Without a template (a host of under MIN_PAGES pages) only article and main count.
Classes on under ``WIDE`` of the pages that together hold over half of the text are copies of a page and stay; so does the text if
all of it is template.

Scale: tokens are summed per batch before they shuffle by (host, token), so a host with a third of all pages
sends few rows; only tokens above the support are kept, at most 1 / SUPPORT times a page's length. The templates are broadcast, packed,
if they have at most ``BROADCAST_ROWS`` rows (some 30 MB); else they meet the pages, compressed, in groups of some ``TOGETHER``, hosts with more than
that and a thousandth of all pages dealt to several. Both ways give the same texts.

Defined results: null or empty html gives an empty text and 0; a page without markup is one block; a null or odd url is a
host of its own; repeated rows are rows of their own; unclosed tags end with what holds them.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, tidy

SUPPORT = 0.01
MIN_PAGES = 5
#: Part of a host's pages from which on a class can't be copies of one page or a passage of articles.
WIDE = 0.5
#: Part of the slots' text that the element with the article holds.
HOLDS = 2 / 3
BROADCAST_ROWS = 1_000_000
#: Hosts of which a worker keeps the unpacked template.
UNPACKED = 256
#: Pages that a task takes together where templates aren't broadcast.
TOGETHER = 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|math|canvas|video|audio)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul caption button option".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "title", "button", "option", "legend", "caption"}
NOT_TEXT = frozenset("head title nav footer aside form menu dialog button label legend option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
PARTS = re.compile(r"[a-z]+")
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager skip".split()
)
WRAPS = frozenset("html body main article".split())
#: Elements that may hold an article.
BOXES = frozenset("body div section main article td center".split())


def _names(attrs: str) -> tuple[set[str], str, bool]:
    """(parts of class and id, role, whether hidden) of a tag."""
    parts: set[str] = set()
    role, hidden = "", False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            parts.update(PARTS.findall(value))
        elif key == "role":
            role = value.strip()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return parts, role, hidden


class Block:
    __slots__ = ("article", "head", "links", "main", "path", "place", "skip", "text")


def read_page(source: str):
    """(tokens, blocks, boxes): every tag path and text block in order; the blocks with what they lie in; of the elements in BOXES that aren't
    left out their first place, the place after their last, and name."""
    tokens: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, skipped, article number, in main
    boxes: list[list] = []
    opened: list[list | None] = []  # the box of each element of the stack
    path: list[str] = []
    buffer: list[str] = []
    linked = size = articles = 0

    def flush():
        nonlocal linked, size
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        if text:
            b = Block()
            b.text, b.links, b.place = text, linked / max(1, size), len(tokens)
            _, b.skip, b.article, b.main = stack[-1] if stack else ("", False, 0, False)
            b.path = ">".join(path)
            b.head = any(x[0] == "h1" for x in stack)
            blocks.append(b)
            tokens.append(f"{b.path}|{text}")
        buffer.clear()
        linked = size = 0

    def close(i: int):
        for box in opened[i:]:
            if box:
                box[1] = len(tokens)
        del stack[i:], path[i:], opened[i:]

    for m in TOKEN.finditer(source):
        if m[5] is not None:
            buffer.append(m[5])
            n = len(m[5])
            size += n
            if any(x[0] == "a" for x in stack[-3:]):
                linked += n
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            buffer.append(" ")
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID:
            continue
        attrs = m[4]
        over = {"li": ("li", "ul ol menu"), "tr": ("tr", "table"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select")}.get(name)
        if name in CLOSES_P:
            over = over or ("p", "div section article main td li blockquote body aside nav footer header form")
        if over:
            ends, stops = over[0].split(), over[1].split()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in stops:
                    break
        parts, role, hidden = _names(attrs) if attrs else (set(), "", False)
        _, skip, article, main = stack[-1] if stack else ("", False, 0, False)
        if not skip:
            nested = name == "article" and article > 0
            page_header = name == "header" and not article
            other = bool(parts & OTHER) and name not in WRAPS
            skip = name in NOT_TEXT or role in ROLES or hidden or nested or page_header or other
        if name == "article" and not skip:
            articles += 1
            article = articles
        main = main or name == "main" or role == "main"
        if not attrs.rstrip().endswith("/"):
            stack.append((name, skip, article, main))
            path.append(name + ("." + ".".join(sorted(parts)[:3]) if parts else ""))
            opened.append([len(tokens), 0, name] if name in BOXES and not skip else None)
            if opened[-1]:
                boxes.append(opened[-1])
            if name in BLOCK or name in BOXES:
                tokens.append(">".join(path))
    flush()
    close(0)
    return tokens, blocks, boxes


def token_key(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _nested(one: tuple[int, ...], owner: dict[int, int], wholes: list[tuple[int, ...]]) -> bool:
    """Whether an occurrence of a class lies in one slot of each that it meets, or each lies in one slot of it."""
    for x, y in zip(one, one[1:], strict=False):
        for n in {owner[k] for k in range(x + 1, y) if k in owner}:
            other = wholes[n]
            if (other[0] < x or other[-1] > y) and bisect.bisect(other, one[0]) != bisect.bisect(other, one[-1]):
                return False
    return True


def valid_classes(tokens: list[str], template: dict[int, tuple]) -> dict[int, float]:
    """Places of the page's tokens in valid classes, with the class's part of the host's pages."""
    held: dict[int, dict[int, tuple[float, float, list[int]]]] = {}
    for k, token in enumerate(tokens):
        key = token_key(token)
        if got := template.get(key):
            held.setdefault(got[0], {}).setdefault(key, (got[1], got[2], []))[2].append(k)
    known: dict[int, float] = {}
    owner: dict[int, int] = {}  # the occurrence of a class that a place belongs to
    wholes: list[tuple[int, ...]] = []
    for number in sorted(held, key=lambda c: (-next(iter(held[c].values()))[1], -len(held[c]), c)):
        members = sorted(held[number].values(), key=lambda m: (m[0], m[2]))
        if len({len(m[2]) for m in members}) > 1:
            continue
        times = list(zip(*(m[2] for m in members), strict=True))
        flat = [k for t in times for k in t]
        if any(x >= y for x, y in zip(flat, flat[1:], strict=False)):
            continue
        if members[0][1] < WIDE and all("|" in tokens[k] for k in times[0]):
            continue  # texts alone: passages that articles share
        if not all(_nested(t, owner, wholes) for t in times):
            continue
        for t in times:
            owner.update((k, len(wholes)) for k in t)
            known.update((k, members[0][1]) for k in t)
            wholes.append(t)
    return known


def region(boxes: list[list], sizes: np.ndarray, marked: set[int]) -> tuple[int, int, str]:
    """(first place, place after the last, name) of the smallest element, in turn, that holds over HOLDS of the text in the one before. sizes: the slots'
    text by place; marked: the places of elements that count beside article and main."""
    text = np.concatenate(([0], np.cumsum(sizes)))
    now = (0, len(sizes), "")
    for low, high, name in boxes:  # in page order: what lies in an element comes after it
        inside = low >= now[0] and high <= now[1]
        if now[2] != "article" and inside and (name in ("article", "main") or low in marked) and text[high] - text[low] > HOLDS * (text[now[1]] - text[now[0]]):
            now = (low, high, name)
    return now


def pick_text(source: str | None, template: dict[int, tuple] | None) -> str:
    """The article's blocks; template has a class number, mean place, part of the pages and whether it comes once a page for each token of the
    host's template."""
    if not source:
        return ""
    tokens, blocks, boxes = read_page(source)
    own = [b for b in blocks if not b.skip]
    known = valid_classes(tokens, template) if template else {}
    sizes = np.zeros(len(tokens), np.int64)
    for b in own:
        if b.place not in known:
            sizes[b.place] = len(b.text)
    marked = {low for low, *_ in boxes if low in known and template[token_key(tokens[low])][3]} if template else set()
    low, high, name = region(boxes, sizes, marked)
    inside = [b for b in own if low <= b.place < high]
    size: dict[int, int] = {}
    for b in inside:
        if b.article:
            size[b.article] = size.get(b.article, 0) + len(b.text)
    if size:
        best = max(size, key=lambda a: (size[a], -a))
        picked = [b for b in inside if b.article == best]
    elif any(b.main for b in inside):
        picked = [b for b in inside if b.main]
    else:
        picked = [b for b in own if (low <= b.place < high or b.head) and b.links < 0.5]
    left = [b for b in picked if known.get(b.place, 0.0) < WIDE]
    slots = [b for b in left if b.place not in known]
    if 2 * sum(len(b.text) for b in slots) < sum(len(b.text) for b in left):
        slots = left
    return "\n".join(b.text for b in (slots or picked))


def host_of(url: str | None) -> str:
    return re.sub(r"\A[a-z][a-z0-9+.-]*://|[/?#].*\Z", "", (url or "").strip().lower(), flags=re.S)


_SUMS = "host string, token long, pages long, vector long, least long, most long, place double, n_pages long"


def _summed(batches):
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for page, url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host = host_of(url)
            sums.setdefault((host, 0), [0, 0, 1, 1, 0.0, 0])[5] += 1
            seen: dict[str, list[int]] = {}
            own = token_key(page or "")
            for k, token in enumerate(read_page(source)[0] if source else ()):
                seen.setdefault(token, [0, k])[0] += 1
            for token, (n, k) in seen.items():
                term = ((own ^ n * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 17) & 0xFFFFFFFF  # sums stay in 64 bits
                row = sums.setdefault((host, token_key(token)), [0, 0, n, n, 0.0, 0])
                row[0] += 1
                row[1] += term
                row[2], row[3] = min(row[2], n), max(row[3], n)
                row[4] += k
        cols = list(zip(*((h, t, *r) for (h, t), r in sums.items()), strict=True))
        if cols:
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(c, k) for n, k, c in zip(("host", "token", "pages", "vector", "least", "most", "place", "n_pages"), (pa.string(), *[pa.int64()] * 5, pa.float64(), pa.int64()), cols, strict=True)}
            )


def deduce_templates(spark, pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, token, class (smallest token of the equivalence class), place, part (of the pages), of (pages of the host): tokens of each host's template."""
    scratch = Scratch(spark, "html")
    sums = (
        pages.select(pages[page_col].cast("string"), pages[url_col], pages[html_col])
        .mapInArrow(tidy(_summed), _SUMS)
        .groupBy("host", "token")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "vector", "place", "n_pages")], F.min("least").alias("least"), F.max("most").alias("most"))
    )
    sums = scratch.table(sums.where((F.col("n_pages") > 0) | (F.col("pages") >= MIN_PAGES)), "sums")
    hosts = sums.where((F.col("n_pages") >= MIN_PAGES) & (F.col("token") == 0)).select("host", F.col("n_pages").alias("of"))
    common = sums.where(F.col("token") != 0).join(hosts.hint("merge"), "host").where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), SUPPORT * F.col("of")))
    classes = common.groupBy("host", "pages", "vector").agg(F.min("token").alias("class"))
    made = common.join(classes, ["host", "pages", "vector"])
    return scratch.table(
        made.select("host", "token", "class", (F.col("place") / F.col("pages")).alias("place"), (F.col("pages") / F.col("of")).alias("part"), (F.col("most") == 1).alias("once"), "of"), "templates"
    )


_PACKED = (("token", np.int64), ("class", np.int64), ("place", np.float64), ("part", np.float64), ("once", np.bool_))


def pack(table: pa.Table) -> bytes:
    """A host's template, 33 bytes a token."""
    cols = [np.ascontiguousarray(table.column(c).to_numpy()).astype(t) for c, t in _PACKED]
    return len(cols[0]).to_bytes(8, "little") + b"".join(c.tobytes() for c in cols)


def unpack(data: bytes) -> dict[int, tuple]:
    n, at, cols = int.from_bytes(data[:8], "little"), 8, []
    for _, t in _PACKED:
        cols.append(np.frombuffer(data, t, n, at).tolist())
        at += n * np.dtype(t).itemsize
    return dict(zip(cols[0], zip(*cols[1:], strict=True), strict=True))


def _packed(table: pa.Table) -> pa.Table:
    return pa.table({"host": [table.column("host")[0].as_py()], "data": pa.array([pack(table)], pa.binary())})


def extract_pages(spark, pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    slim = pages.select(pages[page_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    templates = deduce_templates(spark, slim, "page_id", "url", "html")
    out = f"page_id {slim.schema[0].dataType.simpleString()}, url string, text string, n_chars long"

    def made(ids, urls, texts, kind=pa.RecordBatch):
        return kind.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if templates.count() <= BROADCAST_ROWS:
        # a host's template has at most 1 / SUPPORT times the tokens of its mean page
        packed = templates.drop("of").groupBy("host").applyInArrow(_packed, "host string, data binary")
        shared = spark.sparkContext.broadcast({r.host: bytes(r.data) for r in packed.collect()})

        def run(batches):
            held: dict[str, dict] = {}
            for batch in batches:
                texts = []
                for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    host = host_of(u)
                    if host in shared.value and host not in held:
                        if len(held) >= UNPACKED:
                            held.pop(next(iter(held)))
                        held[host] = unpack(shared.value[host])
                    texts.append(pick_text(h, held.get(host)))
                yield made(batch.column(0), batch.column(1), texts)

        return slim.mapInArrow(tidy(run), out)

    host = F.regexp_replace(F.lower(F.trim(F.coalesce("url", F.lit("")))), r"(?s)\A[a-z][a-z0-9+.-]*://|[/?#].*\z", "")
    n = slim.count()
    hot = templates.groupBy("host").agg(F.max("of").alias("of")).where(F.col("of") > max(TOGETHER, n / 1000)).select("host", F.ceil(F.col("of") / TOGETHER).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("host", "part_of"), F.lit(n // TOGETHER + 1)).alias("g")
    dealt = slim.withColumn("host", host).join(F.broadcast(hot), "host", "left")  # at most a thousand hosts
    dealt = dealt.withColumn("part_of", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1))).cast("int")).select(group, "page_id", "url", "html", "host")
    each = templates.join(F.broadcast(hot), "host", "left").withColumn("part_of", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    each = each.select(group, "host", *[c for c, _ in _PACKED])

    def squeezed(batches):
        for batch in batches:
            small = [None if h is None else zlib.compress(h.encode("utf-8", "surrogatepass"), 1) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(small, pa.binary()), batch.column(4)], batch.schema.names)

    def run_grouped(rows, known):
        held: dict[str, dict[int, tuple]] = {}
        for h, t, *rest in zip(*(known.column(c).to_pylist() for c in ("host", *[c for c, _ in _PACKED])), strict=True):
            held.setdefault(h, {})[t] = tuple(rest)
        sources = ((h, x and zlib.decompress(x).decode("utf-8", "surrogatepass")) for h, x in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist(), strict=True))
        return made(rows.column("page_id"), rows.column("url"), [pick_text(x, held.get(h)) for h, x in sources], pa.Table)

    dealt = dealt.mapInArrow(tidy(squeezed), dealt._jdf.schema().toDDL().replace("html STRING", "html BINARY"))
    return dealt.groupBy("g").cogroup(each.groupBy("g")).applyInArrow(run_grouped, out)


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
