"""Main text of web pages, with site templates removed.

A page is parsed into elements; each element's subtree has a hash of its tags, classes and text. The pages of a
host are counted for each hash, whatever the subtree is (menus and footers as well as parts of the text), and subtrees
that recur on many pages of their host are deleted. What is left of the article (the ``article`` or ``main`` element,
else the body) without the elements that are never main text by their tag or by a word of their class is joined block
by block; those rules also hold on hosts of a few pages, where nothing can recur.

Inside an article, and in running text (headings, paragraphs, lists, quotes, tables), a template must recur on half
of its host's pages, as articles may quote or copy each other; elsewhere ``TEMPLATE_SHARE`` of the pages is enough.
The two are counted and deleted apart. Pages of the same main text are copies and count as one. An article as a whole
is never a template, nor are all its blocks. Hosts with fewer pages than ``TEMPLATE_PAGES`` have no templates.

Null or empty html: empty text. Null urls: one host without templates. Broken markup is closed as browsers do;
repeated rows each count as a page and get the same text; extra columns are carried if asked for. Long pages are
parsed whole; time and memory are linear in a page, however deep its elements are nested.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, slices

#: A subtree is a template from so many pages of its host and this share of them on.
TEMPLATE_PAGES, TEMPLATE_SHARE, TEMPLATE_TEXT_SHARE = 5, 0.1, 0.5
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea label fieldset iframe object svg canvas audio video dialog menu".split()
)
#: Words of a class, id or role that mark an element as something else than main text.
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "aside widget widgets footer masthead toolbar share sharing social related recommended comment comments commentlist disqus reply replies "
    "pagination pager search skip complementary contentinfo".split()
)
#: Of these, the ones that also name what holds a page's text; they do not empty a page.
WEAK_WORDS = frozenset("notice notices alert widget widgets search skip overlay modal promo promotion banner related recommended social".split())
#: A name like comments-open or search-results, a word with one of these, says nothing of the element's own part.
STATE_WORDS = frozenset("open closed on off enabled disabled active inactive allowed available results result true false".split())
#: Blocks: a new line of the text begins and ends with them.
BLOCKS = frozenset(
    "html body article section main div header h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody "
    "tfoot tr address hr details summary center hgroup".split()
) | DROPPED
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th b i em strong a span br".split())
_CLOSES_P = BLOCKS - {"tr", "thead", "tbody", "tfoot", "caption"}
#: Start tags that end an open element of the same list, up to the element that holds it.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
             "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_SPACE = re.compile(r"[\s\x00]+")
_PARTS = re.compile(r"[^a-z0-9]+")
#: A class like has-sidebar says nothing of the element's own part.
_WITHOUT = frozenset("has with without no is".split())
#: Elements that hold a whole article are never templates.
WHOLE = frozenset(("html", "body", "article", "main"))


def skip_words(marks: str, whole: bool) -> set[str]:
    """The words that mark an element as something else; ``whole``: only names that are such a word altogether count."""
    found: set[str] = set()
    for name in marks.split():
        parts = [x for x in _PARTS.split(name) if x]
        words = [x for i, x in enumerate(parts) if x in SKIP_WORDS and not (i and parts[i - 1] in _WITHOUT)]
        if words and (len(parts) == 1 if whole else STATE_WORDS.isdisjoint(parts)):
            found.update(words)
    return found


class Element:
    __slots__ = ("tag", "parent", "skip", "weak", "main", "digest", "has_text", "first")

    def __init__(self, tag: str, parent: Element | None, skip: bool, weak: bool, main: bool, marks: str, first: int):
        self.tag, self.parent, self.skip, self.weak, self.main, self.first = tag, parent, skip, weak, main, first
        self.digest = xxhash.xxh64(f"<{tag} {marks}>")
        self.has_text = False


class Page(HTMLParser):
    """Collects ``blocks``: (text, element it is in), and ``subtrees``: (hash, running text, first block, block after the last)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, Element]] = []
        self.subtrees: list[tuple[int, bool, int, int]] = []
        self.at = Element("", None, False, False, False, "", 0)
        self.depth: dict[str, int] = {}
        self.text: list[str] = []
        self.owner: Element | None = None
        self.has_main = False

    def _flush(self):
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            if line and self.owner is not None:
                self.blocks.append((line, self.owner))
            self.text = []
        self.owner = None

    def _close(self):
        e = self.at
        if e.tag in BLOCKS:
            self._flush()
        self.at = e.parent
        self.depth[e.tag] -= 1
        value = e.digest.intdigest()
        if e.has_text and e.tag not in WHOLE:
            number = value - (1 << 64) if value >> 63 else value
            self.subtrees.append((number, e.main or e.tag in TEXT_ELEMENTS, e.first, len(self.blocks)))
        self.at.digest.update(value.to_bytes(8, "little"))
        self.at.has_text |= e.has_text

    def _pop(self, tags, stop=()):
        """Closes the nearest open element of ``tags`` unless one of ``stop`` is nearer."""
        if not any(self.depth.get(t) for t in tags):
            return
        e = self.at
        while e.parent is not None:
            if e.tag in tags:
                while self.at is not e:
                    self._close()
                self._close()
                return
            if e.tag in stop:
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._pop(("p",), ("table", "article", "section", "div", "body", "li", "td", "blockquote", "aside", "nav", "footer", "header", "form"))
        if tag in _SIBLINGS:
            self._pop(*_SIBLINGS[tag])
        if tag == "body":
            self._pop(("head",))
        if tag in BLOCKS:
            self._flush()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in VOID:
            self.at.digest.update(f"<{tag}>")
            return
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
        own = tag in ("article", "main") or (tag != "body" and "main" == dict(attrs).get("role"))
        main = self.at.main or own
        words = skip_words(marks, own) if marks and tag not in ("html", "body") else set()
        weak = self.at.weak or bool(words & WEAK_WORDS)
        skip = self.at.skip or hidden or tag in DROPPED or (tag == "header" and not main) or not words <= WEAK_WORDS
        self.has_main |= main and not skip and not weak
        # text that waits for its block's end belongs to an element around this one
        self.at = Element(tag, self.at, skip, weak, main, marks, len(self.blocks) + (self.owner is not None))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self._pop((tag,), ("table",) if tag not in ("table", "body", "html", "article", "main", "div", "section") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot") else ())

    def handle_data(self, data):
        e = self.at
        self.text.append(data)
        if not data.isspace():
            e.digest.update(_SPACE.sub(" ", data).strip())
            e.has_text = True
            if e.skip:
                # text of a dropped element is never part of a block
                self.text.pop()
                return
            if self.owner is None:
                self.owner = e
            while self.owner.parent is not None and self.owner.tag not in BLOCKS:
                self.owner = self.owner.parent

    def finish(self):
        self.close()
        while self.at.parent is not None:
            self._close()
        self._flush()
        return self


def parse(html: str | None) -> tuple[list[str], list[tuple[int, bool, int, int]], bool]:
    """Lines of main text, all subtrees (hash, whether running text, first line, line after the last), and whether the text is an article's."""
    page = Page()
    page.feed((html or "").replace("\x00", ""))
    page.finish()
    inside = [not (page.has_main and not e.main) for _, e in page.blocks]
    kept = [k and not e.weak for k, (_, e) in zip(inside, page.blocks)]
    if not any(kept):
        kept = inside
    at = [0, *accumulate(map(int, kept))]
    lines = [line for (line, _), k in zip(page.blocks, kept) if k]
    last = len(page.blocks)
    return lines, [(h, running, at[min(a, last)], at[b]) for h, running, a, b in page.subtrees], page.has_main


#: Templates of so many rows are broadcast; more meet the pages in a salted join.
BROADCAST_TEMPLATES = 20_000


def _key(host: str, number: int) -> int:
    """A host's subtree as one number."""
    value = xxhash.xxh64_intdigest(number.to_bytes(8, "little", signed=True) + host.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def parsed(df: DataFrame, html: str = "html", url: str = "url", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row a page: the carried columns as k0 ..., host, lines of main text, the hashes of all subtrees and whether each is running text;
    then, for each place where a subtree has lines, its number among the hashes and its lines; and whether the text is an article's."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"://([^/?#]*)", 1))
    source = df.select(*kept, host.alias("host"), F.monotonically_increasing_id().alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    names = [f"k{i}" for i in range(len(carry))] + ["host", "row"]
    fields = [f.simpleString().replace(":", " ", 1) for f in source.select(*names).schema.fields]
    kinds = {
        "lines": pa.list_(pa.string()), "trees": pa.list_(pa.int64()), "running": pa.list_(pa.bool_()),
        "tree_at": pa.list_(pa.int32()), "tree_from": pa.list_(pa.int32()), "tree_to": pa.list_(pa.int32()), "article": pa.bool_(),
    }

    def run(batches):
        for batch, texts in slices(batches, "html"):
            hosts = batch.column(len(names) - 2).to_pylist()
            found = {c: [] for c in kinds}
            for h, t in zip(hosts, texts):
                lines, subtrees, article = parse(t)
                # those with lines have the first numbers
                number = {key: i for i, key in enumerate(dict.fromkeys([(n, r) for n, r, a, b in subtrees if a < b] + [(n, r) for n, r, *_ in subtrees]))}
                places = [(number[n, r], a, b) for n, r, a, b in subtrees if a < b]
                row = (lines, [_key(h, n) for n, _ in number], [r for _, r in number], *([x[i] for x in places] for i in range(3)), article)
                for c, x in zip(kinds, row):
                    found[c].append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(x, kinds[c]) for c, x in found.items())], names=[*names, *kinds])

    return source.mapInArrow(run, ", ".join([*fields, "lines array<string>, trees array<long>, running array<boolean>, tree_at array<int>, tree_from array<int>, tree_to array<int>, article boolean"]))


def left_over(pages: DataFrame, names: list[str]) -> DataFrame:
    """The named columns and ``text``: the lines in no subtree that is ``gone``; all lines of an article that would have none left."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = []
            for i in range(batch.num_rows):
                lines, gone = col["lines"][i].as_py(), col["gone"][i].values
                if gone is not None and len(gone) and lines:
                    at, first, last = (col[c][i].values.to_numpy() for c in ("tree_at", "tree_from", "tree_to"))
                    hit = np.isin(at, gone.to_numpy())
                    depth = np.zeros(len(lines) + 1, np.int64)
                    np.add.at(depth, first[hit], 1)
                    np.add.at(depth, last[hit], -1)
                    free = np.cumsum(depth)[:-1] == 0
                    if free.any() or not col["article"][i].as_py():
                        lines = [x for x, f in zip(lines, free) if f]
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    fields = [f.simpleString().replace(":", " ", 1) for f in pages.select(*names).schema.fields]
    return pages.select(*names, "lines", "tree_at", "tree_from", "tree_to", "article", "gone").mapInArrow(run, ", ".join([*fields, "text string"]))


def _met(trees: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Rows of ``trees`` whose (tree, running) is in ``found``. A subtree may be on a large share of the pages: both sides are salted unless one is small."""
    if found.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        return trees.join(F.broadcast(found), ["tree", "running"])
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return trees.withColumn("salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(salted, ["tree", "running", "salt"]).drop("salt")


def templates(pages: DataFrame, scratch: Scratch, pages_least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE, text_share: float = TEMPLATE_TEXT_SHARE) -> DataFrame:
    """Rows (tree, running) of the subtrees that recur on many pages of their host; pages of the same lines count once.

    Counts of pages, summed before the shuffle, tell which subtrees can be meant; only for them are copies told apart.
    """
    known = pages.where("host <> ''").select(F.xxhash64("host").alias("h"), F.xxhash64("lines").alias("copy"), "trees", "running")
    hosts = known.select("h", "copy").distinct().groupBy("h").agg(F.count("*").alias("pages")).where(F.col("pages") >= pages_least)
    trees = known.select("h", "copy", F.explode(F.arrays_zip("trees", "running")).alias("t")).select("h", "copy", F.col("t.trees").alias("tree"), F.col("t.running").alias("running"))
    often = trees.groupBy("tree", "running").agg(F.count("*").alias("n")).where(F.col("n") >= pages_least).select("tree", "running")
    met = _met(trees, scratch.put(often, "often"), "copy").distinct()
    counted = met.groupBy("h", "tree", "running").agg(F.count("*").alias("n")).where(F.col("n") >= pages_least)
    needed = F.when(F.col("running"), F.lit(text_share)).otherwise(F.lit(share))
    return counted.join(hosts, "h").where(F.col("n") >= needed * F.col("pages")).select("tree", "running").distinct()


def main_text(df: DataFrame, html: str = "html", url: str = "url", carry: tuple[str, ...] = ("page_id", "url"), **limits) -> DataFrame:
    """The carried columns and ``text``, one line a block, of every page."""
    scratch = Scratch(df.sparkSession, "html")
    pages = scratch.put(parsed(df, html, url, carry), "pages", compression="zstd")
    found = scratch.put(templates(pages, scratch, **limits), "templates")
    trees = pages.select("row", F.coalesce(F.array_max("tree_at") + 1, F.lit(0)).alias("with_lines"), F.posexplode(F.arrays_zip("trees", "running")).alias("place", "t")).select("row", "place", "with_lines", F.col("t.trees").alias("tree"), F.col("t.running").alias("running"))
    # most subtrees that recur are outside of the text and have nothing to delete
    met = _met(trees.where("place < with_lines").drop("with_lines"), found, "row")
    gone = scratch.put(met.groupBy("row").agg(F.collect_set("place").alias("gone")), "gone")
    # the bound of templates holds for pages that lose something, too
    few = gone.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES
    out = left_over(pages.join(F.broadcast(gone) if few else gone, "row", "left"), [f"k{i}" for i in range(len(carry))])
    return scratch.keep(out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(carry)}))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
