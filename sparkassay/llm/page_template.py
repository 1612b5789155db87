"""HTML extraction by template deduction over pages of one host.

Tokens of a page are its block elements, named by their path from the root down (once with tag, class and id, digits as one sign, so that
numbered ids are one token; once with tags alone), and its blocks of text, named by their path and words. The occurrence vector of a token tells
on which pages of the host it occurs and how often. Spark sums it up in one pass as a sketch: pages, times, the SKETCH least page hashes
under as many hash functions, and which of 64 kinds of pages (by a MinHash of their words in threes) hold it.

Tokens of a host whose vectors agree up to noise are an equivalence class: equal least hashes for at least three in four functions, and at most a tenth
fewer pages. A container that occurs once on at least nine in ten of the pages that have it, on at least one in a hundred of the host's pages and on two
(if the host has two), and holds at least half of the words outside links and page furniture of the pages that have it, is a slot of its class. Odd pages
therefore do not spoil a template, and each layout of a host has a class of its own.
A page's skeleton is its class of most pages, body apart; its main slot is the deepest slot of it, and from there on the deepest of nested classes
that hold at least nine tenths of the share of words of the slot around them; else the body.

A block of text is template, not text, if it stands inside a slot on at least half of the slot's pages and on at least half of their kinds, four at least.
Copies of one article are one kind of page, so their words stay. What is left of the main slot, without furniture inside it, is the page's text.
Furniture whose words differ from page to page is known by element and class names. It counts only below the main slot: a form around the
article (on half of a host's pages) may hold the slot. Headings in the header of an article are text.

Sums are added up map-side, also for a host with a third of all pages; a host's slots are one row, of bounded length by the share of pages.
Null and empty pages have the empty text. Repeated rows are extracted alike. Pages without a host form one group. Markup that ends in the
middle (an open tag, comment, script) is dropped; unclosed elements end with their parent.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.storage import staged
from sparkassay.llm.url_cascade import host_and_path

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split())
CONTAINERS = frozenset("article body center div form main section td".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas select textarea button".split())
FURNITURE_TAGS = frozenset("nav footer aside form header menu dialog".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer header menu modal nav navbar navigation "
    "newsletter notice pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar".split())
#: Words that stand beside those above in names of furniture; a name with any other word is not one.
NEUTRAL = frozenset(
    "area article bar block body bottom box button buttons center col column consent container content desktop element first form global group head icons inline inner item "
    "items last left link links list main mobile module my outer page panel post posts primary respond right row secondary section site slot small stories sub "
    "text the title tools top unit widget wide wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
SCOPES = frozenset("ul ol dl table body html article section div nav footer aside".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)([^>=]*(?:=(?:\s*(?:\"[^\"]*\"|'[^']*'))?[^>=]*)*)(>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


#: Hash functions of an occurrence vector, and how many of them agree on one class.
SKETCH, AGREE = 16, 12
MASK = (1 << 64) - 1  # Spark hands bits as a signed number


class _Element:
    """mark: depth of the deepest element of furniture around it, forms apart; form: that of the deepest form; past: mark of a heading below."""
    __slots__ = ("tag", "path", "bare", "depth", "mark", "form", "past", "silent", "link")

    def __init__(self, tag: str, path: str, bare: str, above: _Element | None = None):
        self.tag, self.path, self.bare = tag, path, bare
        self.depth = self.mark = self.form = self.past = 0
        self.silent = self.link = False
        if above:
            self.depth, self.mark, self.form, self.past = above.depth, above.mark, above.form, above.past
            self.silent, self.link = above.silent, above.link


def _is_furniture(names: list[str]) -> bool:
    for name in " ".join(names).lower().split():
        words = set(re.findall("[a-z]+", name))
        if words & FURNITURE_NAMES and words <= FURNITURE_NAMES | NEUTRAL:
            return True
    return False


def _events(page: str) -> Iterator[tuple[str, _Element, str]]:
    """("text", innermost element, raw text), ("open", element, "") and ("break", element, "") at each block's edge."""
    root = _Element("", "", "~")
    stack, at = [root], 0
    for found in _MARKUP.finditer(page):
        if found.start() > at:
            yield "text", stack[-1], page[at : found.start()]
        at = found.end()
        if found[3] is None or not found[5]:
            continue  # a comment, a script, a declaration, or a tag cut off
        tag = found[3].lower()
        if found[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(e.tag not in INLINE for e in stack[i:]):
                        yield "break", stack[i - 1], ""
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag does not close blocks
            continue
        if tag in CLOSES_P and any(e.tag == "p" for e in stack):
            del stack[max(i for i, e in enumerate(stack) if e.tag == "p") :]
        if own := CLOSES_OWN.get(tag):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == own:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        above = stack[-1]
        if tag in INLINE:
            if tag == "br":
                yield "text", above, " "
            elif tag not in VOID and not found[4].endswith("/"):
                own = _Element(tag, above.path, above.bare, above)
                own.link = above.link or tag == "a"
                stack.append(own)
            continue
        names = [a or b or c for _, a, b, c in _NAMED.findall(found[4])]
        path = f"{above.path}/{tag}" + "".join("." + re.sub(r"[\s/]+", ".", re.sub(r"\d+", "#", name.strip())) for name in names if name.strip())
        own = _Element(tag, path, f"{above.bare}/{tag}", above)
        own.depth = above.depth + 1
        own.silent = above.silent or tag in SILENT
        named = tag not in ("body", "html") and _is_furniture(names)
        if tag == "form" and not named:
            own.form = own.depth
        elif named or tag in FURNITURE_TAGS:
            own.mark = own.depth
            if named or tag != "header" or not any(e.tag in ("article", "main") for e in stack):
                own.past = own.depth
        elif tag in HEADINGS:
            own.mark = own.past
        yield "break", own, ""
        yield "open", own, ""
        if tag not in VOID:
            stack.append(own)
    if at < len(page):
        yield "text", stack[-1], page[at:]


def _blocks(page: str, opened: list[_Element]) -> Iterator[tuple[_Element, list[str], int]]:
    """Each block of text: its element, words, and how many of them stand outside links. Elements go to opened as they begin."""
    parts, own, inside = [], 0, None
    for kind, element, text in _events(page):
        if kind == "text":
            if not element.silent:
                parts.append(text)
                inside = element
                if not element.link:
                    own += len(text.split())
            continue
        if parts:
            if words := entities.unescape("".join(parts)).split():
                yield inside, words, own
            parts, own = [], 0
        if kind == "open" and not element.silent:
            opened.append(element)
    if words := entities.unescape("".join(parts)).split():
        yield inside, words, own


def _text_token(bare: str, words: list[str]) -> str:
    """The token of a block of text, told from those of elements by its first sign."""
    return "=" + blake2b(" ".join([bare, *words]).encode("utf-8", "replace"), digest_size=8).hexdigest()


def occurrences(page: str) -> tuple[dict[str, list], set[tuple[str, str]], int, int]:
    """For each element of the page: times, words outside links and furniture below it, tag. Then the blocks of text as
    (bare path, token), the words of the page outside links and furniture (forms count), and the kind of the page."""
    opened: list[_Element] = []
    below: dict[tuple[str, int], int] = {}
    texts, whole, kind = set(), 0, 0xFFFFFFFF
    for element, words, own in _blocks(page, opened):
        mark = max(element.mark, element.form)
        for path in (element.path, element.bare):
            below[path, mark] = below.get((path, mark), 0) + own
        if not element.mark:
            whole += own
            texts.add((element.bare, _text_token(element.bare, words)))
            raw = [w.encode("utf-8", "replace") for w in words]
            kind = min(kind, min(map(zlib.crc32, map(b" ".join, zip(raw, raw[1:], raw[2:]))), default=zlib.crc32(b" ".join(raw))))
    out: dict[str, list] = {}
    for element in opened:
        for path in (element.path, element.bare):
            out.setdefault(path, [0, 0, element.tag])[0] += 1
    for (path, mark), n in below.items():
        depth = path.count("/")
        while path and path != "~" and depth >= mark:
            if path in out:
                out[path][1] += n
            path, depth = path.rpartition("/")[0], depth - 1
    return out, texts, whole, kind


def with_classes(tokens: list[dict]) -> list[dict]:
    """A host's slots with the number of their equivalence class: the first, by pages, whose leader has the same occurrence vector up to noise."""
    leaders: list[dict] = []
    out = []
    for t in sorted(tokens, key=lambda t: (-t["pages"], t["path"])):
        for nth, leader in enumerate(leaders):
            if t["pages"] * 10 >= leader["pages"] * 9 and sum(a == b for a, b in zip(t["vector"], leader["vector"], strict=True)) >= AGREE:
                break
        else:
            nth = len(leaders)
            leaders.append(t)
        out.append({"path": t["path"], "tag": t["tag"], "pages": t["pages"], "share": t["words"] / max(t["whole"], 1), "nth": nth})
    return out


def template_texts(slots: list[dict], texts: list[dict]) -> list[str]:
    """The blocks of text that belong to the template of a slot around them, the body too."""
    bare = [(s["path"], s["pages"], s["kinds"]) for s in slots if s["path"].startswith("~")]
    return sorted({t["path"] for t in texts for path, pages, kinds in bare
                   if (t["tag"] == path or t["tag"].startswith(path + "/")) and t["pages"] * 2 >= pages
                   and (both := (t["kinds"] & kinds & MASK).bit_count()) >= 4 and both * 2 >= (kinds & MASK).bit_count()})


def choose(slots: list[dict], present: set[str] | None = None) -> str | None:
    """The main slot among a host's slots (those on a page): the deepest of the skeleton, with names if it has any, then of classes nested in it."""
    here = [s for s in slots if present is None or s["path"] in present]
    inner = [s for s in here if s["tag"] != "body"]
    rank = lambda s: (s["path"].count("/"), not s["path"].startswith("~"), s["pages"], s["path"])
    if not inner:
        return max(here, key=rank)["path"] if here else None
    skeleton = max(inner, key=lambda s: (s["pages"], -s["nth"]))["nth"]
    main = max((s for s in inner if s["nth"] == skeleton), key=rank)
    while nested := [s for s in inner if s["path"].startswith(main["path"] + "/") and s["share"] >= main["share"] * 0.9]:
        main = max(nested, key=rank)
    return main["path"]


def slot_text(page: str, slots: list[dict], template: frozenset[str] = frozenset()) -> str:
    """The blocks of the page's main slot (else of all) outside furniture and template, one line each."""
    opened: list[_Element] = []
    blocks = list(_blocks(page, opened))
    slot = choose(slots, {path for e in opened for path in (e.path, e.bare)}) if slots else None
    depth = slot.count("/") if slot else 0
    out = []
    for element, words, _ in blocks:
        own = element.bare if slot and slot.startswith("~") else element.path
        if (slot is None or own == slot or own.startswith(slot + "/")) and max(element.mark, element.form) <= depth:
            if not template or _text_token(element.bare, words) not in template:
                out.append(" ".join(words))
    return "\n".join(out)


def _tokens(page: Column) -> Column:
    """The containers and blocks of text of a page that has a body; whole: the page's words; tag: of a block of text, its bare path."""
    kind = "array<struct<path:string,tag:string,times:int,words:bigint,whole:bigint,kind:int>>"
    fields = pa.list_(pa.struct([("path", pa.string()), ("tag", pa.string()), ("times", pa.int32()), ("words", pa.int64()), ("whole", pa.int64()),
                                 ("kind", pa.int32())]))

    def compute(pages: pa.Array) -> pa.Array:
        out = []
        for p in pages:
            found, texts, whole, signature = occurrences(p.as_py() or "")
            if not any(tag == "body" for _, _, tag in found.values()):
                out.append([])
                continue
            out.append([{"path": path, "tag": tag, "times": times, "words": words, "whole": whole, "kind": signature % 64}
                        for path, (times, words, tag) in found.items() if tag in CONTAINERS])
            out[-1] += [{"path": token, "tag": bare, "times": 1, "kind": signature % 64} for bare, token in texts]
        return pa.array(out, fields)

    return F.arrow_udf(compute, kind)(page)


def host_slots(pages: DataFrame) -> DataFrame:
    """(host, slots, template): slots as array of (path, tag, pages, share, nth), tokens of template text as array; hosts without a page with a body are left out."""
    host = host_and_path(F.col("url"))[0]
    tokens = pages.select(host.alias("host"), F.xxhash64("html").alias("page"), F.explode(_tokens(F.col("html"))).alias("t")).select("host", "page", "t.*")
    once, is_text = F.col("times") == 1, F.startswith("path", F.lit("="))
    # The least hashes of text are not asked for, so the many blocks of one page travel as short rows.
    counted = tokens.groupBy("host", "path", "tag").agg(
        F.count("*").alias("pages"), F.count_if(once).alias("once"), F.sum(F.when(once, F.col("words"))).alias("words"),
        F.sum(F.when(once, F.col("whole"))).alias("whole"), F.bit_or(F.expr("shiftleft(1L, kind)")).alias("kinds"),
        *[F.min(F.when(~is_text, F.hash("page", F.lit(i)))).alias(f"least{i}") for i in range(SKETCH)])
    counted = staged(counted.where(~is_text | (F.bit_count("kinds") >= 4)).select(
        "host", "path", "tag", "pages", "once", "words", "whole", "kinds", F.array(*[f"least{i}" for i in range(SKETCH)]).alias("vector")), "markup-tokens")
    total = counted.where("tag = 'body'").groupBy("host").agg(F.max("pages").alias("total"))
    # A block of text on half of a slot's pages is on one in two hundred of the host's.
    valid = counted.join(total, "host").where(
        "CASE WHEN path LIKE '=%' THEN pages * 200 >= total WHEN tag = 'body' THEN pages * 100 >= total "
        "ELSE once * 10 >= pages * 9 AND words * 2 >= whole AND pages * 100 >= total AND (pages >= 2 OR total = 1) AND (tag <> 'form' OR pages * 2 >= total) END")
    grouped = valid.groupBy("host").agg(
        F.collect_list(F.when(~is_text, F.struct("path", "tag", "pages", "words", "whole", "kinds", "vector"))).alias("slots"),
        F.collect_list(F.when(is_text, F.struct("path", "tag", "pages", "kinds"))).alias("texts"))
    slot_fields = pa.list_(pa.struct([("path", pa.string()), ("tag", pa.string()), ("pages", pa.int64()), ("share", pa.float64()), ("nth", pa.int32())]))
    classes = F.arrow_udf(lambda slots: pa.array([with_classes(s) for s in slots.to_pylist()], slot_fields),
                          "array<struct<path:string,tag:string,pages:bigint,share:double,nth:int>>")
    template = F.arrow_udf(lambda slots, texts: pa.array([template_texts(s, t) for s, t in zip(slots.to_pylist(), texts.to_pylist(), strict=True)],
                                                         pa.list_(pa.string())), "array<string>")
    return staged(grouped.select("host", classes("slots").alias("slots"), template("slots", "texts").alias("template")), "page-templates")


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot): the main slot of each host's most common layout."""
    main = F.arrow_udf(lambda slots: pa.array([choose(s) for s in slots.to_pylist()], pa.string()), "string")
    return host_slots(pages).select("host", main("slots").alias("slot"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    def compute(pages: pa.Array, slots: pa.Array, template: pa.Array) -> pa.Array:
        return pa.array([slot_text(p.as_py() or "", s.as_py() or [], frozenset(t.as_py() or ())) for p, s, t in zip(pages, slots, template, strict=True)],
                        pa.string())

    host = host_and_path(F.col("url"))[0]
    slots = host_slots(pages).withColumnRenamed("host", "__host")
    # The templates are a written table of known size: Spark sends them to tasks if they are small, else joins sorted and splits hot hosts.
    table = pages.select("page_id", "url", "html", host.alias("host")).join(slots, F.col("host") == F.col("__host"), "left")
    text = F.arrow_udf(compute, "string")("html", "slots", "template")
    return table.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
