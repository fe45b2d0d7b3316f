"""Operator 7: main text of pages by template deduction over equivalence classes.

A token is a tag or a text, told apart by its path of elements. Tokens with the same
occurrences across all distinct pages of a host form an equivalence class: per token
the pages it is on, its occurrences and two sums of hashes of (page, times) stand for
its occurrence vector, so vectors of any length are compared by one aggregation. A
class is large enough with ``LEAST_TOKENS`` tokens on ``LEAST_PAGES`` pages and on
``SHARE`` of the host's pages. It is valid if its tokens come in one order in every
turn on every page, and nest alike in the frame, the host's largest class that
comes once a page. Tokens of valid classes are the template. What stands between
them are the slots, and a block of text is kept if part of it is in a slot.

Among slots the article is what a page marks as its article or main part, else
what is in the deepest element that holds three quarters of the most running text on
the host's pages without such a mark. Parts that are navigation, notices, adverts,
forms, comments and the like by element or class are never text.

Null and empty pages have an empty text; a null url is a host of its own; repeated
rows each get a row, and equal pages count once in vectors. Of elements of equal
depth the one with most text is taken. Pages of any length are parsed whole, in memory
linear in their tags. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Memo, batches, release, slices, small, written

#: A class of fewer tokens, on fewer pages or on a smaller share of the host's pages is no template.
LEAST_TOKENS, LEAST_PAGES, SHARE = 3, 3, 0.3
#: Hosts beyond which what is known of them is joined by shuffle: each has the tokens of 1 / SHARE pages at most.
HOSTS = 20_000
#: Elements by what they are (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside form button select option input textarea script style noscript template iframe svg canvas object head title menu dialog video audio math".split())
HOLDERS = frozenset("html body main article section div td center figure details".split())
OUTER = frozenset("html body main article".split())
#: Words of class and id names that mark what is no article (fixed values).
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus feedback footer gdpr hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended related replies reply search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Elements an opening tag of which ends an open one (fixed values).
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Roles that mark what is no article (fixed values).
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|noscript|template|textarea|iframe|svg|title)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[^<]+|<""", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

def attributes(raw: str) -> tuple[str, bool, bool, bool]:
    """class, and whether attributes mark a main part, something that is no article, and such by class or id alone."""
    names = {k.lower(): (a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(raw)}
    marked = not MARKS.isdisjoint(re.split(r"[^a-z]+", f"{names.get('class', '')} {names.get('id', '')}"))
    return names.get("class", ""), names.get("role") == "main", names.get("role") in ROLES, marked


class Parser:
    """Parses pages, with memos of attributes and paths that end with it."""

    def __init__(self):
        self.attributes = Memo(attributes, 20_000)
        self.path = Memo(lambda k: xxhash.xxh64_intdigest(f"{k[1]}.{k[2]}", k[0]), 50_000)

    def parse(self, page: str) -> Page:
        """Tags and text nodes in page order; unclosed elements end with their parents."""
        p = Page()
        stack: list[tuple] = []  # name, node, out, main, link, place of the nearest element in the stack that isn't inline
        open_names: dict[str, int] = {}
        block = 0

        def close(at: int) -> bool:
            """End the elements of the stack from ``at`` on; whether any isn't inline."""
            blocks = False
            for entry in stack[at:]:
                open_names[entry[0]] -= 1
                blocks |= entry[0] not in INLINE
            del stack[at:]
            return blocks

        for m in TOKEN.finditer(page):
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                _, up, out, main, link, _ = stack[-1] if stack else BARE
                if p.texts and p.texts[-1] is not None and p.up[-1] == up and not p.breaks[-1]:  # parts of one node
                    p.texts[-1] += html_lib.unescape(raw)
                else:
                    p.add(0, html_lib.unescape(raw), up, out, main, link, block)
                continue
            name = (m.group(3) or "").lower()
            if not name:  # comments, declarations, elements without text
                continue
            if m.group(2):  # an end tag ends what is open within its element
                if open_names.get(name):
                    at = len(stack) - 1
                    while stack[at][0] != name:
                        at -= 1
                    block += close(at)
                elif name not in INLINE:
                    block += 1
                continue
            if name not in INLINE:
                block += name != "br"
            if name in ENDS:
                at = stack[-1][5] if stack else -1
                while at >= 0:
                    if stack[at][0] in ENDS[name]:
                        close(at)
                        break
                    if stack[at][0] not in ("p", "td", "th", "li"):
                        break
                    at = stack[at - 1][5] if at else -1
            given = m.group(4) or ""
            cls, is_main, by_role, marked = self.attributes[given] if given.strip("/ ") else ("", False, False, False)
            _, up, out, main, link, solid = stack[-1] if stack else BARE
            out = out or name in NEVER or by_role or (marked and name not in OUTER) or (name == "header" and not main)
            main, link = main or name in ("article", "main") or is_main, link or name == "a"
            key = self.path[p.keys[up] if up >= 0 else 0, name, cls]
            p.add(key, None, up, out, main, link, block)
            if name == "br":  # parts words, not blocks
                p.add(1, " ", up, out, main, link, block, True)
            if name not in VOID and not given.rstrip().endswith("/"):
                stack.append((name, len(p.keys) - 2 if name == "br" else len(p.keys) - 1, out, main, link, solid if name in INLINE else len(stack)))
                open_names[name] = open_names.get(name, 0) + 1
                if name in HOLDERS:
                    p.holders.append(len(p.keys) - 1)
        for i, text in enumerate(p.texts):
            if text is not None and not p.breaks[i]:
                p.words[i] = " ".join(text.split())
                p.keys[i] = xxhash.xxh64_intdigest(p.words[i], (p.keys[p.up[i]] if p.up[i] >= 0 else 0) ^ 1)
        return p


#: What stands for an element where none is open.
BARE = ("", -1, False, False, False, -1)


@dataclass(slots=True)
class Page:
    """The nodes of a page, by lists. Tags have no text; ``up`` is the node of the element around a node."""

    keys: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    words: dict[int, str] = field(default_factory=dict)
    up: list[int] = field(default_factory=list)
    out: list[bool] = field(default_factory=list)  # never text
    main: list[bool] = field(default_factory=list)  # in the page's article or main part
    link: list[bool] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)
    holders: list[int] = field(default_factory=list)

    def add(self, key: int, text: str | None, up: int, out: bool, main: bool, link: bool, block: int, breaks: bool = False) -> None:
        for column, value in ((self.keys, key), (self.texts, text), (self.up, up), (self.out, out), (self.main, main), (self.link, link), (self.block, block), (self.breaks, breaks)):
            column.append(value)

    def line(self) -> np.ndarray:
        """The keys of all tokens in page order."""
        return np.array([k for k, b in zip(self.keys, self.breaks, strict=True) if not b], np.uint64).view(np.int64)

    def marked(self) -> bool:
        return any(self.main[i] and not self.out[i] and w for i, w in self.words.items())

    def boxes(self) -> list[tuple[int, int, int]]:
        """(key, depth, running text) of the elements that hold blocks, empty ones left out."""
        weight, depth = [0] * len(self.keys), [0] * len(self.keys)
        for i, up in enumerate(self.up):
            depth[i] = depth[up] + 1 if up >= 0 else 0
        for i in range(len(self.keys) - 1, -1, -1):
            if i in self.words and not self.out[i] and not self.link[i]:
                weight[i] += len(self.words[i])
            if self.up[i] >= 0:
                weight[self.up[i]] += weight[i]
        return [(self.keys[i], depth[i], weight[i]) for i in self.holders if weight[i]]

    def text(self, known: set[int], good: int | None) -> str:
        """The text of blocks that aren't all template, of the article or else of the element ``good``."""
        inside = self.main
        if not self.marked():
            inside = [good is None] * len(self.keys)
            for i, up in enumerate(self.up):
                inside[i] = inside[i] or self.keys[i] == good or (up >= 0 and inside[up])
        texts = [i for i, t in enumerate(self.texts) if t is not None and inside[i] and not self.out[i]]
        own = {self.block[i] for i in texts if self.words.get(i) and self.keys[i] not in known}
        parts: list[str] = []
        last = None
        for i in texts:
            if self.block[i] in own:
                parts += [self.texts[i]] if self.block[i] == last else [" ", self.texts[i]]
                last = self.block[i]
        return " ".join("".join(parts).split())


def signed(values: Iterable[int]) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


def mapped(df: DataFrame, make, schema: str, fields: list[tuple[str, pa.DataType]], whole: int) -> DataFrame:
    """``df`` by a function of a slice of a batch, cut by the bytes of column ``whole``, to columns."""

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in given:
            for a, b in slices(batch.column(whole)):
                cols = call(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])
        call = None
        release()

    batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def tokens_of(pages: DataFrame) -> DataFrame:
    """host, page, line (its tokens in order), keys and counts of its distinct tokens, and the boxes of pages without a mark."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    fields = [("host", pa.int64()), ("page", pa.int64()), ("line", pa.binary()), ("keys", longs), ("counts", ints), ("boxes", longs), ("depths", ints), ("weights", longs)]

    def make():
        parser = Parser()

        def call(batch):
            out: list[list] = [[] for _ in range(6)]
            for page in batch.column(2).to_pylist():
                p = parser.parse(page)
                line = p.line()
                boxes = [] if p.marked() else p.boxes()
                row = (line.tobytes(), *np.unique(line, return_counts=True), signed(b[0] for b in boxes), [b[1] for b in boxes], [b[2] for b in boxes])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return [batch.column(0), batch.column(1), *out]

        return call

    return mapped(pages.select("host", "page", "html"), make, "host long, page long, line binary, keys array<long>, counts array<int>, boxes array<long>, depths array<int>, weights array<long>", fields, 2)


def classes(parsed: DataFrame, share: float = SHARE) -> DataFrame:
    """host, pages, times (occurrences) and keys of each large enough class. A host has the tokens of 1 / ``share`` pages at most."""
    each = parsed.select("host", "page", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("host", "page", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    once = each.groupBy("host", "key", "page").agg(F.max("n").alias("n"))  # equal pages are one
    # sums of 31 bits stay within 64 for four thousand million pages
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "n"), F.lit(1 << 31))).alias(f"sum{seed}")
    vectors = once.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("times"), part(1), part(2)).where(F.col("pages") >= LEAST_PAGES)
    hosts = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    large = vectors.join(small(written(hosts, "hosts")), "host").where(F.col("pages") >= share * F.col("all"))
    alike = large.groupBy("host", "pages", "times", "sum1", "sum2").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return alike.where(F.size("keys") >= LEAST_TOKENS).select("host", "pages", "times", "keys")


def turns(line: np.ndarray, keys: np.ndarray, frame: np.ndarray) -> tuple[int | None, int | None] | None:
    """A hash of the order in which a class's tokens come on a page, and one of how they nest in the frame
    (none where the page has no frame); None for the first where turns differ. None if the page has none of them."""
    at = np.flatnonzero(np.isin(line, keys))
    if not len(at):
        return None
    size = len(keys)
    if len(at) % size:
        return None, None
    order = line[at].reshape(-1, size)
    if (order != order[0]).any() or len(np.unique(order[0])) != size:
        return None, None
    inner = np.isin(line, frame)
    if not inner.any():
        return xxhash.xxh64_intdigest(order[0].tobytes()), None
    gaps = np.cumsum(inner)[at].reshape(-1, size)
    gaps = gaps - gaps[:, :1]
    if (gaps != gaps[0]).any():
        return None, None
    return xxhash.xxh64_intdigest(order[0].tobytes()), xxhash.xxh64_intdigest(gaps[0].tobytes())


def template(parsed: DataFrame, share: float = SHARE) -> DataFrame:
    """host and known (keys of the tokens of valid classes), one row a host."""
    found = written(classes(parsed, share), "classes")
    order = F.struct(-F.col("pages"), "times", -F.size("keys"), "keys")
    by_host = found.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("order"), "pages", "times", "keys"))), lambda x: x.dropFields("order")).alias("all"))
    once = F.filter("all", lambda c: c["pages"] == c["times"])
    sized = by_host.select("host", F.flatten(F.transform("all", lambda c: c["keys"])).alias("flat"), F.transform("all", lambda c: F.size(c["keys"])).alias("sizes"), F.coalesce(F.get(once, F.lit(0))["keys"], F.array().cast("array<bigint>")).alias("frame"))
    fields = [("host", pa.int64()), ("class", pa.int64()), ("right", pa.bool_()), ("turn", pa.int64()), ("nest", pa.int64())]

    def make():
        def call(batch):
            rows = []
            for host, line, flat, sizes, frame in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                line, at = np.frombuffer(line, np.int64), 0
                frame = np.array(frame, np.int64)
                for size in sizes:
                    keys = np.array(flat[at : at + size], np.int64)
                    at += size
                    seen = turns(line, keys, frame)
                    if seen:
                        rows.append((host, int(keys[0]), seen[0] is not None, *(None if x is None else x - (1 << 63) for x in seen)))
            return [[r[i] for r in rows] for i in range(5)]

        return call

    told = parsed.select("host", "line").join(small(written(sized, "frames"), HOSTS), "host")
    seen = mapped(told, make, "host long, class long, right boolean, turn long, nest long", fields, 1)
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    valid = seen.groupBy("host", "class").agg((F.min("right") & same("turn") & same("nest")).alias("valid")).where("valid").drop("valid")
    keys = found.withColumn("class", F.get("keys", F.lit(0))).join(valid, ["host", "class"])
    return keys.groupBy("host").agg(F.flatten(F.collect_list("keys")).alias("known"))


def fullest(parsed: DataFrame) -> DataFrame:
    """host and good, the deepest element that holds three quarters of the most running text of pages without a mark."""
    each = parsed.select("host", F.explode(F.arrays_zip("boxes", "depths", "weights")).alias("x")).select("host", "x.*")
    sums = written(each.groupBy("host", "boxes").agg(F.sum("weights").alias("weight"), F.max("depths").alias("depth")), "boxes")
    most = sums.groupBy("host").agg(F.max("weight").alias("most"))
    return sums.join(most, "host").where("weight * 4 >= most * 3").groupBy("host").agg(F.max(F.struct("depth", "weight", "boxes")).alias("x")).select("host", F.col("x.boxes").alias("good"))


def host_of(url: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    parsed = written(tokens_of(own.withColumn("page", F.xxhash64("html"))), "tokens")
    about = written(template(parsed, share).join(fullest(parsed), "host", "full"), "template")
    told = own.join(small(about, HOSTS), "host", "left").select("page_id", "url", "html", "host", "known", "good")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]

    def make():
        parser, seen = Parser(), {}

        def call(batch):
            texts = []
            for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host not in seen:  # one host's template at a time stays
                    seen.clear()
                    good = batch.column(5)[i].as_py()
                    seen[host] = set(np.array(batch.column(4)[i].as_py() or [], np.int64).view(np.uint64).tolist()), None if good is None else good % (1 << 64)
                texts.append(parser.parse(page).text(*seen[host]))
            return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

        return call

    return mapped(told, make, "page_id long, url string, text string, n_chars long", fields, 2)
