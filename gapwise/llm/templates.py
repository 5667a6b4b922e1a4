"""Main text of pages by deducing the template of their site from equivalence classes.

Pages of a host are made by one template.  Its tokens are element paths and texts, all of a page, in page
order.  Tokens that occur equally often on every page of the host have the same occurrence vector and form an
equivalence class.  A vector is never collected: its hash is an exclusive-or over pages, a partial aggregate,
so a host with a third of all pages is no group of one task.  A class is a candidate if it holds on enough
pages of the host and has an element path.  On every page its tokens stand in an order, over and over; those
that keep their place in it on all pages are valid, if the class nests: it follows the same token of the
classes on more pages than its own.  The valid tokens, nested by that, are the template; texts among them are
its own words, and the gaps between them are slots.

Extraction takes the open slots: what is no word of the template and not in an element that says it is a
menu, header, footer, sidebar, notice, advert, form, script, style or reader comment.  Elements say so by
their name or role, or, as a hint, by a class or id that has no other word; nothing is held against an
element that is or holds the article or the main part.  A list of nothing but links beside them is a menu.
If the page has a main part, its slots are the text; if articles hold half of the open text or more, theirs
are; else all open slots are.  A page whose every word would be template keeps them.

Null and empty pages give an empty text, a null URL belongs to the host "".  One row per row.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gapwise.llm.common import Scratch, steps

#: A class is valid if it holds on so many pages of the host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 8, 0.6
#: Tokens of templates that are sent to all tasks at most; beyond, pages and templates meet by host.
BROADCAST_TOKENS = 200_000
#: Parts of a host's pages then, each with a copy of the host's template.
SALTS = 64

# Fixed values of HTML: elements by how they hold text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html head body option optgroup".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Elements, roles and words of class or id that are never the article.
APART = frozenset("nav footer aside form button select menu dialog svg head object audio video canvas fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar aside rail menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies "
    "respond disqus discussion share sharing social related recommended newsletter subscribe subscription popup modal overlay widget "
    "widgets login signup signin search pagination pager toolbar masthead topbar copyright".split()
)
# Words that change nothing beside one of the former.
NEUTRAL_WORDS = frozenset(
    "site page main left right top bottom box bar block container wrapper wrap inner outer list section area item items post posts "
    "article articles user reader content global primary secondary button buttons link links text the a my js id".split()
)
LISTS = frozenset(("ul", "ol", "dl", "menu"))

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Element:
    name: str
    path: str
    above: int  # place of the parent in the page's list; the root's is -1
    apart: bool = False
    scope: str = ""  # main or article
    link: bool = False
    holds: bool = False  # is or holds the article or main part


@dataclass
class Block:
    element: int
    text: str
    size: int
    linked: int
    token: int


@dataclass
class Page:
    """Elements, text blocks and template token candidates (number, whether a text) in page order."""

    elements: list[Element] = field(default_factory=lambda: [Element("", "", -1)])
    blocks: list[Block] = field(default_factory=list)
    tokens: list[tuple[int, bool]] = field(default_factory=list)

    def chain(self, at: int) -> list[int]:
        out = []
        while at >= 0:
            out.append(at)
            at = self.elements[at].above
        return out

    def slots(self) -> list[Block]:
        """The blocks that are no part of what stands around the article."""
        elements = self.elements
        weight, linked, blocks = ([0] * len(elements) for _ in range(3))
        for block in self.blocks:
            for e in self.chain(block.element):
                weight[e] += block.size
                linked[e] += block.linked
                blocks[e] += 1
        inner = [False] * len(elements)  # inside an apart element
        scoped = [""] * len(elements)  # the outermost scope it is in
        for i, e in enumerate(elements):
            inner[i] = i > 0 and (inner[e.above] or elements[e.above].apart)
            scoped[i] = (i > 0 and scoped[e.above]) or e.scope
        outer = [i for i, e in enumerate(elements) if e.scope and not scoped[e.above]]
        chosen = [i for i in outer if not inner[i]] or sorted(outer, key=lambda i: -weight[i])[:1]
        for i in chosen:
            for e in self.chain(i):
                elements[e].holds = True
        gone = [False] * len(elements)
        for i, e in enumerate(elements):
            menu = e.name in LISTS and not scoped[i] and blocks[i] > 1 and linked[i] == weight[i]
            gone[i] = (i > 0 and gone[e.above]) or ((e.apart or menu) and not e.holds)
            # A site's header is apart, an article's own is not.
            gone[i] |= e.name == "header" and not scoped[i] and not e.holds
        open_ = [b for b in self.blocks if not gone[b.element]]
        main = [b for b in open_ if any(elements[e].scope == "main" for e in self.chain(b.element))]
        if main:
            return main
        inside = [b for b in open_ if scoped[b.element]]
        return inside if 2 * sum(b.size for b in inside) >= sum(b.size for b in open_) > 0 else open_


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t\r") else {}


def _says(names: str) -> bool:
    """Whether a class or id names what is no article, with no other word in it."""
    for one in names.lower().split():
        words = set(WORD.findall(one))
        if words & APART_WORDS and words <= APART_WORDS | NEUTRAL_WORDS:
            return True
    return False


def _is_apart(name: str, attributes: dict[str, str]) -> bool:
    if name in APART:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in APART_ROLES:
        return True
    return name not in ("html", "body") and (_says(attributes.get("class", "")) or _says(attributes.get("id", "")))


def parse(source: str) -> Page:
    """Walk the tags once; unclosed and crossing elements are closed as browsers do."""
    page, stack = Page(), [0]
    elements = page.elements
    text: list[str] = []
    linked = 0
    at = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if elements[stack[-1]].link and not piece.isspace() else 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                token = number(f"{elements[stack[-1]].path}\0{words}")
                size = sum(len(t) for t in text if not t.isspace())
                page.blocks.append(Block(stack[-1], words, size, min(linked, size), token))
                page.tokens.append((token, True))
            text.clear()
        linked = 0

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        """Close the innermost open element of the names, unless one of ``within`` is open inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if elements[stack[i]].name in names:
                if any(elements[e].name in BLOCKS for e in stack[i:]):
                    flush()
                del stack[i:]
                return
            if elements[stack[i]].name in within:
                return

    for token in TOKEN.finditer(source):
        if token.start() < at:
            continue  # inside raw text
        add(source[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["close"]:
            if name in BLOCKS:
                flush()
            close((name,), frozenset(("td", "th", "table", "article", "body")) - {name} if name not in ("body", "html") else frozenset())
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in RAW:
            end = re.compile(f"</{name}(?![a-z0-9-])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in CLOSES_P:
            close(("p",), frozenset(("button", "td", "th", "table", "article", "div", "section", "li")))
        if name in CLOSED_BY:
            close(CLOSED_BY[name], frozenset(("ul", "ol", "dl", "table", "select")))
        attributes = _attributes(token["rest"])
        above = elements[stack[-1]]
        path = f"{above.path}/{name}"
        if attributes.get("class") or attributes.get("id"):
            path += f".{attributes.get('class', '')}#{attributes.get('id', '')}"
        page.tokens.append((number(path), False))
        if name in VOID or token["rest"].endswith("/") and name not in BLOCKS and name not in ("a", "b", "i", "span", "em", "strong"):
            continue
        scope = "article" if name == "article" else "main" if name == "main" or attributes.get("role") == "main" else ""
        elements.append(Element(name, path, stack[-1], _is_apart(name, attributes), scope, above.link or name == "a"))
        stack.append(len(elements) - 1)
    add(source[at:])
    flush()
    return page


TOKENS = "host string, page long, token long, is_text boolean, n long"


def _columns(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], names=schema.names)


def tokens(pages: DataFrame) -> DataFrame:
    """How often each template token candidate occurs on each page (``host``, ``page``, ``html``)."""
    schema = T.StructType.fromDDL(TOKENS)

    def run(batches):
        for batch in steps(batches, "html"):
            out = []
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                out += [(host, page, token, is_text, n) for (token, is_text), n in Counter(parse(source or "").tokens).items()]
            yield _columns(out, schema)

    return pages.select("host", "page", "html").mapInArrow(run, schema)


def candidate_classes(pages: DataFrame) -> DataFrame:
    """Per host ``classes``: ``vector, support, tokens, texts`` of equivalence classes on enough pages, with an element path.

    Each token is on ``LEAST_SHARE`` of the host's pages, so they are few, however many pages there are.
    """
    vector = F.bit_xor(F.xxhash64("page", "n"))
    found = tokens(pages).groupBy("host", "token", "is_text").agg(F.count(F.lit(1)).alias("support"), vector.alias("vector"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    often = found.where(F.col("support") >= LEAST_PAGES).join(sizes, "host").where(F.col("support") >= LEAST_SHARE * F.col("n_pages"))
    texts = F.collect_list(F.when(F.col("is_text"), F.col("token")))
    classes = often.groupBy("host", "vector", "support").agg(F.bool_or(~F.col("is_text")).alias("nests"), F.collect_list("token").alias("tokens"), texts.alias("texts"))
    return classes.where("nests").groupBy("host").agg(F.collect_list(F.struct("vector", "support", "tokens", "texts")).alias("classes"))


def class_marks(sequence: list[int], classes: list) -> list[tuple[int, int, int | None, int]]:
    """For each class token on a page: the vector of its class, the token, its place in the order of the class (null
    if that has none) and the token of a class on more pages that the class follows."""
    of = {token: c for c, found in enumerate(classes) for token in found["tokens"]}
    orders: dict[int, list[int]] = {}
    follows: dict[int, int] = {}
    latest: dict[int, tuple[int, int]] = {}  # newest token, with its place, of the classes of one support
    for at, token in enumerate(t for t in sequence if t in of):
        c = of[token]
        if c not in orders:
            above = [place for support, place in latest.items() if support > classes[c]["support"]]
            follows[c] = max(above)[1] if above else 0
        orders.setdefault(c, []).append(token)
        latest[classes[c]["support"]] = (at, token)
    out = []
    for c, order in orders.items():
        cycle = order[: len(classes[c]["tokens"])]
        regular = len(order) % len(cycle) == 0 and all(t == cycle[i % len(cycle)] for i, t in enumerate(order))
        out += [(classes[c]["vector"], token, place if regular else None, follows[c]) for place, token in enumerate(cycle)]
    return out


def template_texts(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Per host with any: ``texts``, the template's own words, from the tokens that keep their place in classes that nest."""
    candidates = scratch.put(candidate_classes(pages), "classes")
    schema = T.StructType.fromDDL("host string, vector long, token long, place long, follows long")

    def run(batches):
        for batch in steps(batches, "html"):
            out = []
            for host, source, classes in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "classes")), strict=True):
                out += [(host, *mark) for mark in class_marks([t for t, _ in parse(source or "").tokens], classes)]
            yield _columns(out, schema)

    size = candidates.agg(F.sum(F.aggregate("classes", F.lit(0).cast("long"), lambda n, c: n + F.size(c["tokens"])))).first()[0] or 0
    marks = _met(pages.select("host", "page", "html"), candidates, size, "inner").select("host", "html", "classes").mapInArrow(run, schema)
    one = F.count_if(F.col("place").isNull()) == 0
    for mark in ("place", "follows"):
        one = one & F.min(mark).eqNullSafe(F.max(mark))
    valid = marks.groupBy("host", "token").agg(one.alias("valid")).where("valid")
    words = candidates.select("host", F.inline("classes")).select("host", F.explode("texts").alias("token")).join(valid, ["host", "token"])
    out = scratch.put(words.groupBy("host").agg(F.collect_set("token").alias("texts")), "templates")
    scratch.drop(candidates)
    return out


def _met(pages: DataFrame, templates: DataFrame, size: int, how: str) -> DataFrame:
    """Pages (``host``, ``page``) beside their host's row; a host with very many pages is no one key."""
    if size <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(templates), "host", how)
    salted = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], how).drop("_salt")


def extract(source: str, template: set[int]) -> str:
    slots = parse(source).slots()
    free = [b for b in slots if b.token not in template] if template else slots
    return "\n".join(b.text for b in (free or slots))


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """All columns but the html, and the main text of every page; a column called like ``out`` is replaced."""
    scratch = Scratch(pages.sparkSession, "templates")
    keep = [c for c in pages.columns if c not in (html, out)]
    named = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(key, html).alias("page"), F.col(html).alias("html"), F.struct(*keep).alias("kept"))
    templates = template_texts(named.drop("kept"), scratch)
    size = templates.agg(F.sum(F.size("texts"))).first()[0] or 0
    joined = _met(named, templates, size, "left").select("kept", "html", "texts")
    schema = T.StructType([joined.schema["kept"], T.StructField("out", T.StringType())])

    def run(batches):
        for batch in steps(batches, "html"):
            texts = [extract(s or "", set(t or ())) for s, t in zip(batch.column("html").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string())], names=["kept", "out"])

    return joined.mapInArrow(run, schema).select("kept.*", F.col("out").alias(out))
