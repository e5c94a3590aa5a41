"""HTML main text by the template of a host's pages, deduced from equivalence classes.

Every page becomes a sequence of tokens: start tags with their path of open elements
(names, classes and ids, digits alike) and text nodes with theirs.  A token's occurrence
vector says how often each of the host's distinct pages holds it; copies of a page count
once.  Tags of one vector in one container form a class, and so does every text.  Classes on at least SUPPORT_PERCENT of the
pages, and on two, are candidates; one is valid if its tokens stand in one order, as
often repeated as they occur, on every page, and if it nests: between two of its tokens
another class begins and ends, or doesn't begin.  Valid classes nested in one another
are the template; what stands between their tokens are its slots.  A text is the template's
if its vector is that of a valid class of tags.

The main container is the innermost tag of the template with MAIN_PERCENT of the text
in its slots, one that holds an h1 element before others (but for the body); an article or
main element comes first and needs half of the text.  A page's text is that of the
slots in the container, and of the template's h1 elements before it.  Text of the
template itself (notices and labels) is left out where FIXED_PERCENT of the pages and
FIXED_PAGES hold it; but if that is more than half of a page's main text, the page is a
near copy and keeps it.  A page without the container, or of a host without a template,
gives its article or main element, else its body.

Elements that are never main text are left out by element name, role, or a whole class
or id (not a part of one): menus, page headers, footers, sidebars, forms, scripts,
styles, adverts, notices, reader comments.  Names that an article's own parts bear too
(header, notice, related and the like) say nothing of headings, and nothing inside the
container or an article: there the template decides, so such a text stays unless it is the
template's.  A form that spans half of its page and holds most of its text is walked, its
controls are not.

Occurrence vectors are compared by two sums over pages of 64-bit hashes, so no host's pages
meet in one task; classes go by 128 bits.  Character references are decoded in each text
node by itself, after white space is cut.  Defined results: pages are parsed whole, however
long, one at a time; null or empty html has empty text; null url is a host of
its own; a host with one distinct page has no template; repeated rows each give a row;
other columns are ignored.  Markup cut off at the end of a page is dropped, unknown
character references stay as they are.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .words import map_batches

SUPPORT_PERCENT = 50
MAIN_PERCENT = 67
FIXED_PERCENT, FIXED_PAGES = 90, 4
#: Templates are broadcast up to so many tokens (some MB); beyond, pages are joined with them by host.
BROADCAST_TOKENS = 200_000

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")  # every one, so that values hold no names
_READ = frozenset("class id role itemprop hidden aria-hidden".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_LEFT_OUT = frozenset("head script style noscript template iframe svg math object canvas audio video nav header footer aside form button select textarea option input label fieldset menu dialog title xmp noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDERS = frozenset("article body center div main section td".split())
_CLOSES_P = _BLOCKS - frozenset("td th tr tbody thead tfoot caption li dd dt body html".split())
_SELF = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sidebar nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr popup modal comment comments disqus share sharing social newsletter subscribe signup login pagination pager".split())
#: Names that parts of an article bear as well.
_DOUBTFUL = frozenset("promo banner side menu header masthead footer notice alert overlay reply replies related recommended search widget toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


def _attributes(raw: str) -> tuple[str, str, str, bool]:
    """class and id words, role, itemprop, and whether it is hidden."""
    names, role, prop, hidden = "", "", "", False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key not in _READ:
            continue
        if key in ("class", "id"):
            names += " " + value.lower()
        elif key == "role":
            role = value.lower()
        elif key == "itemprop":
            prop = value.lower()
        else:
            hidden = hidden or key == "hidden" or value.lower() == "true"
    return names, role, prop, hidden


class Node:
    """An open element: its path's hash, whether it is left out, whether by a doubtful name
    only, whether it is in an article or main element, and the containers and h1 elements it is
    in, as paths."""

    __slots__ = ("chain", "doubt", "main", "name", "out", "path", "title")

    def __init__(self, name: str, path: int, out: bool, doubt: bool, main: bool, chain: tuple, title: int):
        self.name, self.path, self.out, self.doubt, self.main, self.chain, self.title = name, path, out, doubt, main, chain, title


_FORM = re.compile(r"<(/?)form[\s/>]", re.I)


def _wide_forms(page: str) -> frozenset:
    """Where the forms begin that span half of a page and hold most of its text."""
    if "<form" not in page and _FORM.search(page) is None:
        return frozenset()
    wide, begin = [], None
    for m in [*_FORM.finditer(page), None]:
        if m is None or m[1]:
            if begin is not None and 2 * ((len(page) if m is None else m.start()) - begin) >= len(page):
                wide.append(begin)
            begin = None
        elif begin is None:
            begin = m.start()
    if not wide:
        return frozenset()
    size = lambda walked: sum(len(_SPACE.sub(" ", text)) for kind, *rest in _events(page, walked) if kind == "text" for node, text in [rest] if not node.out and not node.doubt)
    return frozenset(wide) if 2 * size(frozenset()) < size(frozenset(wide)) else frozenset()


def parse(page: str):
    """('open', node), ('text', node, string) and ('break', None) events of a page."""
    return _events(page, _wide_forms(page))


def _events(page: str, walked: frozenset):
    stack = [Node("", 0, False, False, False, (0,), 0)]
    at, end = 0, len(page)

    def close(name: str) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                del stack[k:]
                return True
        return False

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            tail = page[at:]
            yield "text", stack[-1], tail
            return
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if m[4] == "":
            return  # cut off inside a tag
        name = name.lower()
        if m[1]:
            if name in _BLOCKS:
                yield "break", None
            close(name)
            continue
        if name in _BLOCKS:
            yield "break", None
        if name in _CLOSES_P and any(n.name == "p" for n in stack):
            close("p")
        if name in _SELF:
            closes, within = _SELF[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in within:
                    break
                if stack[k].name in closes.split():
                    del stack[k:]
                    break
        parent = stack[-1]
        raw = m[3]
        names, role, prop, hidden = _attributes(raw) if "=" in raw or "hidden" in raw else ("", "", "", False)
        main = parent.main or name in ("article", "main") or role in ("main", "article") or prop == "articlebody"
        left = name in _LEFT_OUT and not (name == "header" and parent.main) and not (name == "form" and m.start() in walked)
        named = doubt = False
        if names and name not in ("html", "body", "article", "main") and name not in _HEADINGS:
            words = names.split()
            named, doubt = not _NAMES.isdisjoint(words), not _DOUBTFUL.isdisjoint(words)
        path = hash_path(parent.path, name, _DIGITS.sub("0", names))
        chain = (*parent.chain, path) if name in _HOLDERS else parent.chain
        node = Node(name, path, parent.out or left or named or hidden or role in _ROLES and m.start() not in walked, parent.doubt or doubt, main, chain, path if name == "h1" else parent.title)
        yield "open", node
        if name == "br":
            yield "text", parent, " "
        if name in _VOID or raw.endswith("/") and name not in _BLOCKS and name not in _RAW:
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if stop is None:
                return
            at = page.find(">", stop.start()) + 1 or end
            continue
        stack.append(node)


@lru_cache(1 << 14)
def hash_path(parent: int, name: str, names: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent} {name} {names}".encode(), digest_size=8).digest(), "little", signed=True)


def _text_hash(path: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path} #{text}".encode(), digest_size=8).digest(), "little", signed=True)


def page_tokens(page: str):
    """The sequence of tokens, and token -> [characters in it, kind, its container, whether an
    h1 element is in it]; kinds are containers (1, or 2 in an article or main element), h1
    elements (3), texts (4), others (0)."""
    sequence, facts, bodies = [], {0: [0, 1, 0, False]}, {0}
    for kind, *rest in parse(page):
        if kind == "open":
            node = rest[0]
            sequence.append(node.path)
            held = node.name in _HOLDERS
            known = 0 if node.out or node.doubt else 3 if node.name == "h1" else 0 if not held else 2 if node.main else 1
            facts.setdefault(node.path, [0, known, node.chain[-2 if held else -1], False])
            if node.name == "body":
                bodies.add(node.path)
            elif known == 3:
                for holder in node.chain:
                    if holder in facts and holder not in bodies:
                        facts[holder][3] = True
        elif kind == "text":
            node, text = rest
            text = _SPACE.sub(" ", text).strip()
            if text and not node.out:
                token = _text_hash(node.path, text)
                sequence.append(token)
                facts.setdefault(token, [0 if node.doubt else len(text), 4, node.chain[-1], False])
                for holder in node.chain if not node.doubt else ():
                    if holder in facts:
                        facts[holder][0] += len(text)
    return sequence, facts


def order_of(sequence: list[int], classes: dict[int, str]) -> dict[str, tuple[int, bool]]:
    """For the classes of a page: a hash of the order of their tokens (of a unit, if the
    page repeats it), and whether the class is at fault: repeated in another order, or
    not nested.

    classes: class by token.  A unit is open from its first token to its last.
    """
    own: dict[str, list[int]] = {}
    for token in sequence:
        if (c := classes.get(token)) is not None:
            own.setdefault(c, []).append(token)
    out, unit = {}, {}
    for c, tokens in own.items():
        size = len(set(tokens))
        first = tokens[:size]
        unit[c] = size
        whole = len(set(first)) == size and len(tokens) % size == 0 and all(tokens[k] == first[k % size] for k in range(len(tokens)))
        out[c] = [_text_hash(size, " ".join(map(str, first))), not whole]
    stack, seen = [], dict.fromkeys(own, 0)
    for token in sequence:
        c = classes.get(token)
        if c is None or out[c][1]:
            continue
        at = seen[c] % unit[c]
        seen[c] += 1
        if at:
            while stack and stack[-1] != c:
                other = stack.pop()  # open between two tokens of c, and not closed
                worse = other if len(own[other]) <= len(own[c]) else c
                out[worse][1] = True
                if worse == c:
                    break
            if out[c][1]:
                continue
        elif unit[c] > 1:
            stack.append(c)
        if at == unit[c] - 1 and stack and stack[-1] == c:
            stack.pop()
    return {c: (h, bad) for c, (h, bad) in out.items()}


def extract(page: str, fixed: frozenset, container: int | None, titles: frozenset = frozenset()) -> str:
    """The page's main text: slots in the container and in the template's titles; fixed are
    the template's texts. Without a container on the page, its article or main or body."""
    parts: list = []  # (whether in an article, whether in the container, text, path), None between blocks
    seen_main = seen = False
    for kind, *rest in parse(page):
        if kind == "break":
            parts.append(None)
        elif kind == "open":
            node = rest[0]
            if not node.out:
                seen_main = seen_main or node.main
                seen = seen or node.path == container
        else:
            node, text = rest
            if not node.out and (not node.doubt or node.main or container in node.chain):
                parts.append((node.main, container in node.chain or not seen and node.title in titles, text, node.path))
    if container is not None and seen:
        parts = [p for p in parts if p is None or p[1]]
        if fixed:
            bare = [None if p is None else _SPACE.sub(" ", p[2]).strip() for p in parts]
            slots = [p is None or _text_hash(p[3], x) not in fixed for p, x in zip(parts, bare, strict=True)]
            size = [len(x or "") for x in bare]
            if 2 * sum(n for n, kept in zip(size, slots, strict=True) if kept) >= sum(size):
                parts = [p for p, kept in zip(parts, slots, strict=True) if kept]
    elif seen_main:
        parts = [p for p in parts if p is None or p[0]]
    blocks, pending = [], []
    for part in [*parts, None]:
        if part is not None:
            pending.append(part[2])
        elif pending:
            text = _SPACE.sub(" ", "".join(map(entities.unescape, pending))).strip()
            if text:
                blocks.append(text)
            pending = []
    return "\n\n".join(blocks)


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][^:/?#]*://([^/?#]*)", 1), F.lit("")))


def candidates(keyed: DataFrame) -> DataFrame:
    """keyed: host, row, html. Tokens of the candidate classes: host, token, vector (two sums
    and the support) and class (128 bits), kind, mass, support, fixed (a text on enough pages)."""

    def run(batch):
        host, row, token, count, mass, kind, holder, titled = ([] for _ in range(8))
        for h, r, page in zip(batch.column("host").to_pylist(), batch.column("row").to_pylist(), batch.column("html").to_pylist(), strict=True):
            sequence, facts = page_tokens(page or "")
            counts = Counter(sequence)
            counts[0] = 1
            for key, n in counts.items():
                chars, k, within, title = facts[key]
                host.append(h)
                row.append(r)
                token.append(key)
                count.append(n)
                mass.append(chars)
                kind.append(k)
                holder.append(within)
                titled.append(title)
        if host:
            yield [host, row, token, count, mass, kind, holder, titled]

    n_pages = keyed.select("host", "row").distinct().groupBy("host").agg(F.count("*").alias("n_pages")).where("n_pages > 1")
    tokens = map_batches(keyed, run, "host string, row long, token long, count long, mass long, kind int, holder long, titled boolean").dropDuplicates(["host", "token", "row"])
    # a vector's hash: the sum over pages of hashes of (page, count), in two lanes
    lane = lambda k: F.sum(F.xxhash64(F.lit(k), "row", "count").cast("decimal(20,0)"))
    found = tokens.groupBy("host", "token").agg(F.count("*").alias("support"), lane(0).alias("v0"), lane(1).alias("v1"), F.sum("mass").alias("mass"), F.max("kind").alias("kind"), F.first("holder").alias("holder"), F.max("titled").alias("titled"))
    # few rows a host pass: each is on half of its pages
    found = found.where("support > 1").join(n_pages, "host").where(F.col("support") * 100 >= F.col("n_pages") * SUPPORT_PERCENT)
    fixed = (F.col("kind") == 4) & (F.col("support") >= FIXED_PAGES) & (F.col("support") * 100 >= F.col("n_pages") * FIXED_PERCENT)
    own = F.when(F.col("kind") == 4, F.col("token")).otherwise(F.col("holder"))
    vector = F.concat_ws(" ", "v0", "v1", "support")
    return found.select("host", "token", vector.alias("vector"), F.md5(F.concat_ws(" ", vector, (F.col("kind") == 4).cast("int"), own)).alias("class"), "kind", "mass", "support", "titled", fixed.alias("fixed"))


def valid_classes(keyed: DataFrame, tokens: DataFrame) -> DataFrame:
    """(host, class) of the candidate classes in one order on all pages, and nested."""
    by_host = tokens.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("tokens"))  # on half of a host's pages each: two pages' worth
    joined = keyed.join(_small(by_host, tokens), "host")

    def run(batch):
        last, classes, found = None, {}, {}
        given = batch.column("tokens")
        for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host != last:
                last, classes = host, {t["token"]: t["class"] for t in given[k].as_py()}
            for c, (order, bad) in order_of(page_tokens(page or "")[0], classes).items():
                low, high, fault = found.get((host, c), (order, order, False))
                found[host, c] = (min(low, order), max(high, order), fault or bad)
        if found:
            yield [[h for h, _ in found], [c for _, c in found], *zip(*found.values(), strict=True)]

    rows = map_batches(joined.select("host", "html", "tokens"), run, "host string, class string, low long, high long, bad boolean")
    checked = rows.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"))
    return checked.where("low = high AND NOT bad").select("host", "class")


def _small(by_host: DataFrame, tokens: DataFrame) -> DataFrame:
    """A table of tokens by host, broadcast if all tokens are few; tokens is a stored table."""
    return F.broadcast(by_host) if tokens.count() <= BROADCAST_TOKENS else by_host


def templates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed: host, row, html. A row per host with a template: host, container, fixed (its
    texts), titles (its h1 elements); and the stored tokens it comes from."""
    tokens = stored(candidates(keyed))
    valid = stored(valid_classes(keyed, tokens))
    template = tokens.where("token != 0").join(valid, ["host", "class"])
    vectors = template.where("kind != 4").select("host", "vector").distinct().withColumn("tags", F.lit(True))
    template = template.join(vectors, ["host", "vector"], "left")
    total = tokens.where("token = 0").select("host", F.col("mass").alias("total"))
    article = F.col("kind") == 2
    holder = F.col("kind").isin(1, 2) & (F.col("mass") > 0)
    enough = F.when(article, 2 * F.col("mass") >= F.col("total")).otherwise(100 * F.col("mass") >= MAIN_PERCENT * F.col("total"))
    marked = template.join(total, "host").withColumn("rank", F.when(holder & enough, F.struct(~article, ~F.col("titled"), F.col("mass"), -F.col("support"), F.col("token"))))
    out = marked.groupBy("host").agg(
        F.min_by("token", "rank").alias("container"),
        F.collect_set(F.when(F.col("fixed") & F.col("tags"), F.col("token"))).alias("fixed"),
        F.collect_set(F.when(F.col("kind") == 3, F.col("token"))).alias("titles"),
    )
    return out, tokens


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = pages.select(_host().alias("host"), F.xxhash64("html").alias("row"), "html")
    known, tokens = templates(keyed)
    joined = pages.withColumn("host", _host()).join(_small(stored(known), tokens), "host", "left")

    def run(batch):
        last, sets = None, (frozenset(), frozenset())
        texts = []
        fixed, titles, containers = batch.column("fixed"), batch.column("titles"), batch.column("container").to_pylist()
        for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host != last:
                last, sets = host, (frozenset(fixed[k].as_py() or ()), frozenset(titles[k].as_py() or ()))
            texts.append(extract(page or "", sets[0], containers[k], sets[1]))
        yield [batch.column("page_id"), batch.column("url"), texts, np.array([len(t) for t in texts], np.int64)]

    return map_batches(joined.select("page_id", "url", "html", "host", "fixed", "container", "titles"), run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
