"""Operator 11: the main text of web pages, by what markup says and by differences between neighbouring pages of a host."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: What markup says of a line: not of the article, undecided, of the article.
OUT, OPEN, MAIN = 0, 1, 2
#: Up to so many distinct pages with deleted lines are broadcast. Beyond that those of which this share of all pages are copies, or more, still are.
FEW, OFTEN = 50_000, 0.001

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = frozenset("script style title textarea iframe xmp noframes noembed".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen".split())
BREAKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hr html legend li main menu nav ol option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
#: Elements that are tracked even without a mark of their own.
CONTAINERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header main menu nav ol section select svg table template ul noscript object canvas video audio datalist".split())
NEVER = frozenset("aside button select svg template dialog noscript object canvas video audio datalist".split())
AROUND = frozenset("nav header footer form menu".split())
ENDS_ITSELF = frozenset("p li dt dd td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class and id that mark what is not of an article.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments disqus respond cookie cookies consent gdpr"
    " notice notification newsletter subscribe subscription signup paywall share sharing social related recommended recommendations breadcrumb breadcrumbs"
    " pagination pager popup modal overlay widget login search toolbar hidden teaser".split()
)
AROUND_WORDS = frozenset("nav navbar navigation menu header footer masthead topbar".split())
MAIN_WORDS = frozenset(["articlebody", "article-body", "article-content", "post-content", "post-body", "entry-content", "story-body"])
NEVER_ROLES = frozenset("complementary search alert dialog alertdialog menu menubar toolbar".split())
AROUND_ROLES = frozenset("navigation banner contentinfo form".split())
#: States of an element: undecided, article, around an article (an article inside counts), header of an article (its headings count), never.
S_OPEN, S_MAIN, S_AROUND, S_HEAD, S_NEVER = range(5)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def state_of(tag: str, attributes: str, parent: int) -> int:
    """State of an element inside one of state parent."""
    if parent == S_NEVER or tag in NEVER:
        return S_NEVER
    kinds, role, main = set(), "", tag in ("article", "main")
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                kinds.update(w.lower() for w in WORDS.findall(value))
                main = main or not MAIN_WORDS.isdisjoint(value.lower().split())
            elif name == "role":
                role = value.lower()
                main = main or role in ("main", "article")
            elif name == "itemprop":
                main = main or value.lower() == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                return S_NEVER
    if tag not in ("html", "body", "main"):
        if role in NEVER_ROLES or not NEVER_WORDS.isdisjoint(kinds):
            return S_NEVER
        if not main and (tag in AROUND or role in AROUND_ROLES or not AROUND_WORDS.isdisjoint(kinds)):
            return S_HEAD if parent == S_MAIN and (tag == "header" or "header" in kinds) else S_AROUND
    if main or (parent == S_HEAD and tag in HEADINGS):
        return S_MAIN
    return parent


def lines(page: str) -> list[tuple[str, int]]:
    """(text, what markup says) of each line: text between block boundaries, references decoded, runs of white space as one space.

    Markup may be broken: elements that never close end with what is around them, closing tags without an opening one count for nothing,
    a tag or comment cut off at the end is no text. Time is linear in the length. Lines outside any article that are mostly links are menus;
    where a page has an article, undecided lines are no part of it, but for h1.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    state, linked, all_chars, link_chars, heading = S_OPEN, False, 0, 0, False
    line_state = S_OPEN

    def flush():
        nonlocal pieces, all_chars, link_chars
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                kind = MAIN if line_state == S_MAIN else OPEN if line_state == S_OPEN and 2 * link_chars <= all_chars else OUT
                out.append((text, kind, heading))
            pieces, all_chars, link_chars = [], 0, 0

    def say(text):
        nonlocal line_state, all_chars, link_chars
        if state != line_state:
            if pieces:
                flush()
            line_state = state
        pieces.append(text)
        if state == S_OPEN:
            n = len(text.strip())
            all_chars += n
            link_chars += n if linked else 0

    def pop():
        nonlocal state
        name, _ = stack.pop()
        opened[name] -= 1
        state = stack[-1][1] if stack else S_OPEN

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in BREAKS:
                flush()
                heading = False
            if tag == "a":
                linked = False
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BREAKS:
            flush()
            linked = False
            heading = tag == "h1"
            if stack and stack[-1][0] in ENDS_ITSELF and (tag == stack[-1][0] or stack[-1][0] == "p"):
                pop()
        elif tag == "a":
            linked = True
        if tag in VOID:
            continue
        own = state_of(tag, m.group(3), state)
        if tag in CONTAINERS or own != state:
            if m.group(3).endswith("/") and tag == "svg":
                continue
            stack.append((tag, own))
            opened[tag] = opened.get(tag, 0) + 1
            state = own
    flush()
    has_main = any(kind == MAIN for _, kind, _ in out)
    return [(t, OUT if kind == OPEN and has_main and not h1 else kind) for t, kind, h1 in out]


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both are empty where there is none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "", parts.path)
    except ValueError:
        return ("", url or "")


def hashed(found: list[tuple[str, int]]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in found], dtype=np.uint64).view(np.int64)


def signature(hashes: np.ndarray, kinds: bytes) -> tuple[int, int]:
    """128 bits that tell pages of a host apart by their lines and what markup says of them."""
    both = hashes.tobytes() + kinds
    return xxhash.xxh64_intdigest(both, seed=1) - (1 << 63), xxhash.xxh64_intdigest(both, seed=2) - (1 << 63)


def common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b; a row of the table is one long integer."""
    match: dict[int, int] = {}
    for i, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << i
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & match.get(x, 0)
        v = ((v + u) | (v - u)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8 or 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b. Memory is linear: halves of a are aligned with the parts of b that suit them best."""
    both = set(a) & set(b)
    found, todo = [], [([(i, x) for i, x in enumerate(a) if x in both], [x for x in b if x in both])]
    while todo:
        left, right = todo.pop()
        head = 0
        while head < min(len(left), len(right)) and left[head][1] == right[head]:
            found.append(left[head][0])
            head += 1
        tail = 0
        while tail < min(len(left), len(right)) - head and left[-1 - tail][1] == right[-1 - tail]:
            found.append(left[-1 - tail][0])
            tail += 1
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if not left or not right:
            continue
        if len(left) == 1:
            if left[0][1] in right:
                found.append(left[0][0])
            continue
        middle = len(left) // 2
        first = common_lengths([x for _, x in left[:middle]], right)
        second = common_lengths([x for _, x in reversed(left[middle:])], right[::-1])[::-1]
        cut = int((first + second).argmax())
        todo += [(left[:middle], right[:cut]), (left[middle:], right[cut:])]
    return sorted(found)


def deletions(own: np.ndarray, kinds: bytes, other: np.ndarray) -> np.ndarray | None:
    """For each line whether it goes, being undecided and shared with the other page; None if none does, or none would be left."""
    what = np.frombuffer(kinds, dtype=np.uint8)
    if not len(what) or not (what == OPEN).any():
        return None
    shared = np.zeros(len(own), dtype=bool)
    shared[aligned(own.tolist(), other.tolist())] = True
    goes = shared & (what == OPEN)
    return goes if goes.any() and ((what != OUT) & ~goes).any() else None


PAGE = "host string, path string, s1 long, s2 long, hashes array<long>, kinds binary"
CUT = "host string, s1 long, s2 long, copies long, goes array<boolean>"
TEXT = "page_id long, url string, host string, s1 long, s2 long, n_lines long, at array<int>, line array<string>"


def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of the lines of each page."""
    for b in batches:
        out = []
        for url, page in zip(b.url, b.html):
            found = lines(page or "")
            hashes, kinds = hashed(found), bytes(k for _, k in found)
            out.append((*place(url), *signature(hashes, kinds), hashes, kinds))
        yield pd.DataFrame(out, columns=["host", "path", "s1", "s2", "hashes", "kinds"])


def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each page that markup doesn't rule out, and their places."""
    for b in batches:
        out = []
        for page_id, url, page in zip(b.page_id, b.url, b.html):
            found = lines(page or "")
            kept = [(i, t.encode("utf-8", "replace").decode()) for i, (t, k) in enumerate(found) if k != OUT]
            out.append((page_id, url, place(url)[0], *signature(hashed(found), bytes(k for _, k in found)), len(found), [i for i, _ in kept], [t for _, t in kept]))
        made = pd.DataFrame(out, columns=["page_id", "url", "host", "s1", "s2", "n_lines", "at", "line"])
        made["page_id"] = made["page_id"].astype("Int64")
        yield made


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which lines of each page go, of those pages that lose some."""
    for b in batches:
        out = []
        for r in b.itertuples():
            goes = deletions(np.asarray(r.hashes, dtype=np.int64), r.kinds, np.asarray(r.other, dtype=np.int64))
            if goes is not None:
                out.append((r.host, r.s1, r.s2, r.copies, goes.tolist()))
        yield pd.DataFrame(out, columns=["host", "s1", "s2", "copies", "goes"])


def neighbours(found: DataFrame) -> DataFrame:
    """found(host, path, s1, s2, hashes, kinds) as one row per distinct page of a host, with copies and other: the hashes of the page
    next to it in the order of paths, before or after, whichever shares more leading segments of its path (equal: the one before).

    Pages are dealt by ranges of (host, path), so a host of any size is spread over tasks; each range also gets the last page of the range
    before it and the first of the one after it.
    """
    one = found.groupBy("host", "s1", "s2").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("kinds").alias("kinds"), F.count("*").alias("copies"))
    order = ["host", "path", "s1", "s2"]
    dealt = stored(one.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "pages-dealt")
    row = F.struct(*[c for c in dealt.columns if c != "range"])
    ends = dealt.groupBy("range").agg(F.min_by(row, F.struct(*order)).alias("low"), F.max_by(row, F.struct(*order)).alias("high"))
    w = Window.orderBy("range")  # one row per range
    ends = ends.withColumn("before", F.lag("high").over(w)).withColumn("after", F.lead("low").over(w))
    guests = ends.select("range", F.explode(F.array("before", "after")).alias("r")).where("r is not null").select("r.*", "range", F.lit(True).alias("guest"))
    all_rows = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    w = Window.partitionBy("range", "host").orderBy("path", "s1", "s2")
    near = lambda f: f(F.struct("path", "hashes")).over(w)
    both = all_rows.withColumn("b", near(F.lag)).withColumn("a", near(F.lead)).where("not guest")

    def alike(c):
        """Number of leading segments of two paths that are equal."""
        pairs = F.zip_with(F.split("path", "/"), F.split(F.col(c)["path"], "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.coalesce(F.array_position(F.concat(pairs, F.array(F.lit(False))), False), F.lit(0))

    nearest = F.when(F.col("b").isNull() | (F.col("a").isNotNull() & (alike("a") > alike("b"))), F.col("a")).otherwise(F.col("b"))
    return both.withColumn("other", nearest["hashes"]).where("other is not null").select("host", "s1", "s2", "copies", "hashes", "kinds", "other")


def extracted(pages: DataFrame, few: int = FEW, often: float = OFTEN) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_deleted) of pages(page_id, url, html): the lines of the article, joined by one space.

    Lines that markup puts in an article stay, lines that it puts in menus, headers, footers, sidebars, notices, adverts, forms and comments
    go. Lines of which markup says nothing are judged by the nearest page of the host: both pages' lines, all of them, are aligned by their
    longest common subsequence, and undecided lines that are part of it go, unless the page would be left without a line. Pages of a
    host with the same lines count as one page, so a copy is never compared with itself, and all of them lose the same lines.
    Null html or html without text gives an empty text; null or broken URLs are pages of one host without a name; repeated rows stay;
    an empty table gives no rows. More columns are ignored.

    Only hashes of lines are shuffled; texts are read again, and are shuffled only if more than few distinct pages lose lines.
    """
    found = stored(pages.select("url", "html").mapInPandas(parsed, PAGE), "pages-lines")
    cuts = stored(neighbours(found).mapInPandas(compared, CUT), "pages-cuts")
    text = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(texts, TEXT)
    key, n = ["host", "s1", "s2"], found.count()
    cut, total = cuts.select(*key, "goes"), cuts.count()
    dropped(found)
    if total <= few:
        joined = text.join(F.broadcast(cut), key, "left")
    else:
        hot = cuts.where(F.col("copies") >= max(2.0, often * n)).select(*key, F.col("goes").alias("hot_goes"))
        first = text.join(F.broadcast(hot), key, "left")
        rest = first.where("hot_goes is null").drop("hot_goes").join(cut, key, "left")
        joined = first.where("hot_goes is not null").withColumnRenamed("hot_goes", "goes").unionByName(rest)
    kept = F.filter("line", lambda t, i: ~F.coalesce(F.get("goes", F.get("at", i)), F.lit(False)))
    whole = F.when(F.col("goes").isNull(), F.array_join("line", " ")).otherwise(F.array_join(kept, " "))
    gone = F.coalesce(F.size(F.filter("goes", lambda g: g)), F.lit(0))
    made = joined.select("page_id", "url", whole.alias("text"), "n_lines", F.when(F.col("goes").isNull(), 0).otherwise(gone).cast("long").alias("n_deleted"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_deleted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
