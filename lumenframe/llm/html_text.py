"""Main text of web pages by equivalence-class template deduction.

A page is read as a stream of tokens: its elements, each named by the path of element names and classes from the root, and
their texts. Over the pages of one host, a token's occurrence vector is how often each page has it. Tokens with equal
vectors form an equivalence class. A class counts if its tokens occur once on each page that has them, on two pages or
more. It is ordered if every token follows the same token of its class on all pages, and nested if no token of the class of
most pages (the host's frame) lies between them; where it is not, it is broken into parts that are. Parts of two tokens or
more are the host's template, and the places between its elements are slots.
The slot that holds the article is the nearest ``article`` or ``main`` element, or else the deepest template container that
holds most of the text that differs between pages. Vectors are combined as hashes (an xor and a sum over pages), so a host of
any size is combined before the shuffle. All pages together give one more template, used by pages whose host has none.

The template is one short row per host. Pages are then read once more and give the text of the article's slot, without
menus, footers, forms, adverts and the like; template elements of those kinds are known by name, role or a whole class name.
Elements whose text is a token of their own class (the same on every page) are left out, inside an article if its texts differ otherwise.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

#: fixed values: element names by their part in a page
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript iframe template svg math button select textarea dialog menu object canvas audio video title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body html caption legend option summary tbody td tfoot th thead tr".split())
#: fixed values: whole class names and ids, and roles, of what is not the article; the page's own frame is never meant
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo recommended related reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
FRAME = frozenset("html body main article".split())
CONTAINERS = tuple("article body center div main section table tbody td tr".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form".split())

_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
DEPTH = 512  # elements nested deeper share the path of their ancestor there, as browsers flatten them
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class _Element:
    """``apart``: not the article by element name or role; ``above`` and ``within``: by class or id, set outside or inside an article."""

    __slots__ = ("name", "path", "depth", "apart", "above", "within", "article")

    def __init__(self, name: str, path: str, depth: int = 0, apart: bool = False, above: bool = False, within: bool = False, article: bool = False):
        self.name, self.path, self.depth, self.apart, self.above, self.within, self.article = name, path, depth, apart, above, within, article

    @property
    def side(self) -> bool:
        return self.apart or self.above or self.within


class _Finder:
    """``find`` in one text for ascending starts: a place found is kept until it is passed, a miss for good."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def __call__(self, what: str, start: int) -> int:
        at = self.known.get(what, 0)
        if at >= 0 and (at < start or what not in self.known):
            at = self.known[what] = self.page.find(what, start)
        return at


def _tag_end(page: str, at: int, find: _Finder) -> int:
    """Place of the '>' that ends a tag whose name ends before ``at``: not one in a quoted value, where the quote closes."""
    while True:
        end = find(">", at)
        sign = page.find("=", at, end) if end >= 0 else -1
        if sign < 0:
            return end
        at = sign + 1
        while page[at : at + 1].isspace():
            at += 1
        quote = page[at : at + 1]
        if quote in ('"', "'") and quote:
            close = find(quote, at + 1)
            at = close + 1 if close >= 0 else at + 1


def tags(page: str):
    """(start, end, closing, name, attributes) of every tag and comment in order, name '' for what only goes; one pass."""
    find, at = _Finder(page), 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        after = page[at : at + 1]
        if page.startswith("!--", at):
            end = find("-->", at + 3)
            at = end + 3 if end >= 0 else len(page)
            at = yield (start, at, "", "", "")
            continue
        if after in ("!", "?"):
            end = find(">", at)
            if end >= 0:
                at = yield (start, end + 1, "", "", "")
            continue
        m = _NAME.match(page, at)
        if m:
            end = _tag_end(page, m.end(), find)
            if end >= 0:  # else there is no '>' any more, and it is text
                at = yield (start, end + 1, m[1], m[2].lower(), page[m.end() : end])


def stream(page: str):
    """('open' or 'break', element) and ('text', raw text, element) tokens in page order, element being the innermost one."""
    stack, held = [_Element("", "")], Counter()
    at, end, found = 0, len(page), tags(page)
    went = None  # where the scan goes on
    while True:
        try:
            start, after, closing, name, attributes = next(found) if went is None else found.send(went)
        except StopIteration:
            if at < end:
                yield "text", page[at:], stack[-1]
            return
        if start > at:
            yield "text", page[at:start], stack[-1]
        at = went = after
        if not name:
            continue
        if closing:
            if held[name]:
                while stack[-1].name != name:
                    held[stack.pop().name] -= 1
                held[stack.pop().name] -= 1
            if name in BLOCKS:
                yield "break", None, stack[-1]
            continue
        if name in ENDS_P and held["p"]:
            while stack[-1].name != "p":
                held[stack.pop().name] -= 1
            held[stack.pop().name] -= 1
        elif name in ("li", "td", "th", "tr", "dd", "dt", "option") and stack[-1].name == name:
            held[stack.pop().name] -= 1
        up = stack[-1]
        names = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _NAMES.findall(attributes)} if "=" in attributes else {}
        role = names.get("role")
        apart = up.apart or name in OUTSIDE or (name == "header" and not up.article) or role in SIDE_ROLES
        named = name not in FRAME and role != "main" and not SIDE_NAMES.isdisjoint((names.get("class", "") + " " + names.get("id", "")).split())
        label = name + ("." + ".".join(sorted(names["class"].split())) if names.get("class") else "")
        article = up.article or (not apart and (name in ("article", "main") or role == "main"))
        element = _Element(name, f"{up.path}/{label}" if up.depth < DEPTH else up.path, up.depth + 1, apart, up.above or (named and not up.article), up.within or (named and up.article), article)
        if name in BLOCKS:
            yield "break", None, up
        yield "open", None, element
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            raw_end = close.start() if close else end
            if raw_end > at:
                yield "text", page[at:raw_end], element
            at = went = close.end() if close else end
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(element)
            held[name] += 1


def _squeezed(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def main_text(page: str | None, slot: str | None, fixed: frozenset[str] = frozenset()) -> str:
    """Blocks of the article, or of the slot's elements where no article element has text, one to a line, less the ``fixed`` paths."""
    tokens = list(stream(page or ""))
    texts = [(e, len(raw)) for kind, raw, e in tokens if kind == "text" and raw.strip()]
    marked = any(e.article and not e.side for e, _ in texts)
    # a class name above the article, or around all there is, does not make it a side element
    lifted = False
    if not marked:
        plain = sum(n for e, n in texts if not e.side)
        marked = lifted = plain < sum(n for e, n in texts if e.article and not e.apart and not e.within)
        lifted = lifted or not plain

    def inside(e: _Element) -> bool:
        if e.apart or e.within or (e.above and not lifted) or e.path in fixed:
            return False
        return e.article if marked else slot is None or e.path == slot or e.path.startswith(slot + "/")

    if not any(inside(e) for e, _ in texts):
        if marked:
            fixed = frozenset()  # an article is not all template
        else:
            slot = None
    blocks, now = [], []
    for kind, raw, e in tokens:
        if kind == "break":
            blocks.append("".join(now))
            now = []
        elif kind == "open":
            if e.name == "br":
                now.append(" ")
        elif inside(e):
            now.append(raw)
    blocks.append("".join(now))
    return "\n".join(b for b in map(_squeezed, blocks) if b)


def _elements(pages: DataFrame) -> DataFrame:
    """host, page, key, path, at, n, chars, text (a hash), article, side of every page's elements, and whole: a hash of its articles' texts.

    ``page`` is a row of ``pages``, ``at`` the place of an element's first occurrence among them.
    """

    def run(batches):
        for b in batches:
            out = []
            for host, row_id, key, page in zip(*(b.column(c).to_pylist() for c in ("host", "page", "key", "html")), strict=True):
                seen: dict[str, list] = {}
                whole = 0
                for kind, raw, e in stream(page or ""):
                    if kind == "open":
                        row = seen.setdefault(e.path, [0, 0, 0, e.article, e.side])
                        row[0] += 1
                    elif kind == "text" and e.path and (text := _squeezed(raw)):
                        row = seen.setdefault(e.path, [1, 0, 0, e.article, e.side])
                        row[1] += len(text)
                        data = text.encode("utf-8", "surrogatepass")
                        row[2] = zlib.crc32(data, row[2])
                        if e.article and not e.side:
                            whole = zlib.crc32(data, whole)
                out += [(host, row_id, key, path, at, *row, whole) for at, (path, row) in enumerate(seen.items())]
            cols = list(zip(*out, strict=True)) or [[]] * 11
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
            names = ["host", "page", "key", "path", "at", "n", "chars", "text", "article", "side", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    kinds = "host string, page long, key long, path string, at long, n long, chars long, text long, article boolean, side boolean, whole long"
    return materialize(pages.withColumn("page", F.monotonically_increasing_id()).mapInArrow(run, kinds))


APART = 3  # different articles that repeat a template text; told apart by a bit each, so never counted too high


LARGE = 2  # tokens of a part of a class that is template
MEMBERS = 1_000_000  # template tokens that may be broadcast


def _vector(n, there):
    """Aggregates that are equal for tokens of one occurrence vector: pages, occurrences and two hashes over (page, occurrences)."""
    mark = F.when(there, F.xxhash64("key", n))
    return F.struct(F.count(mark).alias("pages"), F.sum(F.when(there, n)).alias("times"), F.bit_xor(mark).alias("mark"), F.sum(F.shiftright(mark, 32)).alias("sum"))


def _token(kind: int):
    return F.xxhash64("host", "path", F.lit(kind))


def _classes(seen: DataFrame, paths: DataFrame) -> DataFrame:
    """token, part: the tokens in large ordered nested parts of equivalence classes; ``paths`` has host, path, vector, and said of texts."""

    def tokens(kind, vector):
        return paths.where(f"{vector} is not null").select("host", _token(kind).alias("token"), F.col(vector).alias("vector"))

    tokens = tokens(0, "vector").union(tokens(1, "said")).where("vector.times = vector.pages and vector.pages >= 2")
    tokens = tokens.withColumn("class", F.xxhash64("host", "vector"))
    classes = tokens.groupBy("host", "class").agg(F.count("*").alias("size"), F.max("vector.pages").alias("pages")).where(F.col("size") >= LARGE)
    frame = classes.groupBy("host").agg(F.max_by("class", F.struct("pages", "size", "class")).alias("frame"))
    members = materialize(tokens.join(classes.join(frame, "host"), ["host", "class"]).select("token", "class", (F.col("class") == F.col("frame")).alias("frame")))
    if members.count() <= MEMBERS:
        members = F.broadcast(members)
    # every page's template tokens in their order; an element's text follows its start
    both = F.array(F.struct(_token(0).alias("token"), (2 * F.col("at")).alias("at")), F.when(F.col("chars") > 0, F.struct(_token(1).alias("token"), (2 * F.col("at") + 1).alias("at"))))
    placed = seen.select("host", "page", F.explode(F.filter(both, lambda t: t.isNotNull())).alias("t")).select("host", "page", "t.token", "t.at").join(members, "token")
    line = W.partitionBy("host", "page").orderBy("at")
    placed = placed.withColumn("gap", F.last(F.when(F.col("frame"), F.col("token")), True).over(line.rowsBetween(W.unboundedPreceding, -1)))
    own = W.partitionBy("host", "page", "class").orderBy("at")
    placed = placed.select("token", "class", "page", "at", F.lag("token").over(own).alias("before"), (F.col("frame") | F.lag("gap").over(own).eqNullSafe(F.col("gap"))).alias("nested"))
    # the tokens of a class are on the same pages, so the first of these pages has all of them
    order = placed.groupBy("token", "class").agg(
        F.min_by("at", "page").alias("at"), (F.min("nested") & (F.count("before") == F.count("*")) & (F.min("before") == F.max("before"))).alias("follows"),
    )
    parts = order.withColumn("part", F.sum(F.when(F.coalesce("follows", F.lit(False)), 0).otherwise(1)).over(W.partitionBy("class").orderBy("at", "token")))
    parts = parts.withColumn("size", F.count("*").over(W.partitionBy("class", "part"))).where(F.col("size") >= LARGE)
    return parts.select("token", F.xxhash64("class", "part").alias("part"))


def templates(pages: DataFrame) -> DataFrame:
    """host, slot, fixed: per host the path of the article's slot and the paths of template texts; host '*' stands for all pages."""
    seen = _elements(pages)
    seen = seen.withColumn("host", F.explode(F.array("host", F.lit("*"))))
    text = F.when(F.col("chars") > 0, F.col("text"))
    paths = seen.groupBy("host", "path").agg(
        _vector(F.col("n"), F.lit(True)).alias("vector"), F.sum("chars").alias("chars"),
        # a path's text is one token if it is the same wherever it has any
        F.when(F.min(text) == F.max(text), _vector(F.lit(1).cast("long"), text.isNotNull())).alias("said"),
        (F.min("text") != F.max("text")).alias("varies"), F.bool_or("article").alias("article"), F.bool_or("side").alias("side"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(pmod(whole, 63) as int))"))).alias("articles"),
    )
    paths = materialize(paths)
    parts = materialize(_classes(seen, paths))
    part, filled = (parts.select(F.col("token").alias(f"t{k}"), F.col("part").alias(name)) for k, name in enumerate(("part", "filled")))
    paths = paths.join(part, _token(0) == F.col("t0"), "left").join(filled, _token(1) == F.col("t1"), "left")
    paths = materialize(paths.withColumn("valid", F.col("part").isNotNull()).withColumn("template", F.col("part") == F.col("filled")))
    body = paths.where(~F.col("side"))
    # text under a template element, by walking up the path of every element: a page's depth is its own bound
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    under = body.where("varies").select("host", F.explode(above).alias("path"), F.col("chars").alias("held")).groupBy("host", "path").agg(F.sum("held").alias("held"))
    name = F.regexp_extract("path", r"/([^/.]*)[^/]*$", 1)
    nested = body.where(F.col("valid") & name.isin(*CONTAINERS)).join(under, ["host", "path"])
    most = nested.groupBy("host").agg(F.max("held").alias("most"))
    deep = nested.join(most, "host").where(F.col("held") >= 0.6 * F.col("most"))
    slot = deep.groupBy("host").agg(F.max_by("path", F.struct("article", F.length("path"), "vector.mark")).alias("slot"))
    # inside articles only what at least three different ones repeat: two may be near copies
    fixed = body.where(f"template and (not article or articles >= {APART})").groupBy("host").agg(F.collect_set("path").alias("fixed"))  # a template's own elements
    return slot.join(fixed, "host", "full")


HOSTS = 100_000  # templates that may be broadcast


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; other columns are not read).

    A null or empty page has an empty text. A page whose url is null or has no host uses the template of all pages. Rows
    that repeat a page are separate rows. An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    known = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url").alias("key"))
    found = materialize(templates(known.select("host", "key", "html")))
    common = found.where("host = '*'").select("slot", "fixed").first()  # one row
    own = found.where("host <> '*'")
    own = F.broadcast(own) if own.count() <= HOSTS else own

    def run(batches):
        for b in batches:
            texts = []
            for page, slot, fixed in zip(b.column("html").to_pylist(), b.column("slot").to_pylist(), b.column("fixed").to_pylist(), strict=True):
                if slot is None and common is not None:
                    slot, fixed = common["slot"], common["fixed"]
                texts.append(main_text(page, slot, frozenset(fixed or ())))
            kind = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(kind), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), kind)], ["page_id", "url", "text", "n_chars"])

    return known.join(own, "host", "left").select("page_id", "url", "html", "slot", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
