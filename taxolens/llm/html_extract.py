"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags, named by their place (the path of open elements, each with its class and
id words). On each host the occurrence vector of a token - how often each page has it - is folded into one signature
(the xor of a hash of page and count), with the pages that have it, so tokens that share occurrence vectors are found
by grouping, without gathering a host. Tokens with one signature form an equivalence class; a class is valid if
enough pages support it and its places nest: the place around each member belongs to the class itself or to a valid
class (the slot that it repeats in). Valid classes nested in each other are the host's template. Its slots are the
text places below it; a slot whose text is the same on every page is template, not data.

From a page the text of the remaining slots is taken, if the template gives the slot to the main part: inside the
article (``article`` or ``main``, or else the place that holds most of the varying text of the classes which this page
holds, so pages of several templates on one host are each read by their own), and not inside a menu, header, footer,
sidebar, notice, advert, form, script, style or reader comments, by element or by whole class and id names. Names
never drop ``article``, ``main`` or what is around them: an article inside a part that is named as beside it counts if
the page has no other. Host templates are broadcast if they are small (``BROADCAST_BYTES``, measured), and joined by
host otherwise; either way gives the same rows.

A place deeper than ``MAX_DEPTH`` elements, and a name longer than ``MAX_NAME`` characters, goes by its hash, so a
path stays short and different places stay different. Template places are those on at least ``SUPPORT`` pages and
``SUPPORT_SHARE`` of the host's pages.

Defined cases: a null or empty html gives the empty text; a null url has the empty host; a host with fewer than
``SUPPORT`` pages has no template of its own, and its pages are read by element and class words alone; repeated
pages count as pages; other columns are unread.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import keep

SUPPORT = 3
#: Least share of a host's pages that a template token is on.
SUPPORT_SHARE = 0.01
BROADCAST_BYTES = 4_000_000
MAX_DEPTH = 64
MAX_NAME = 200

#: Elements of HTML by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "select", "option", "head", "label",
         "fieldset"} | RAW
MAIN = {"article", "main"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
#: Class and id names that mark parts beside the article.
BESIDE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
          "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside",
          "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup",
          "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form", "share",
          "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "replies",
          "reply", "disqus", "widget", "pagination", "pager", "toolbar", "copyright"}
#: The words that may stand with them in one name, as in ``site-header``.
BESIDE_WITH = {"site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "list", "slot",
               "box", "bar", "block", "container", "wrapper", "wrap", "area", "section", "unit", "link", "links", "post",
               "posts", "user", "reader", "google", "inner", "outer", "inline", "text", "body", "item", "items", "group",
               "panel", "buttons", "icons", "thread", "module", "column", "col", "row", "fixed", "sticky", "mobile"}
#: Names by which an article inside another one is a reader's comment or an advert.
NOT_ARTICLE = {"ad", "ads", "advert", "advertisement", "sponsored", "comment", "comments", "reply", "replies"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/])[^<]*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def names_beside(name: str, marks: set[str] = BESIDE) -> bool:
    """Whether a whole class or id name marks a part beside the article: ``site-header``, but not ``has-header``."""
    words = _WORD.findall(name)
    return not marks.isdisjoint(words) and all(w in marks or w in BESIDE or w in BESIDE_WITH for w in words)


def place_of(tag: str, attrs: str) -> tuple[str, bool, list[str]]:
    """Name of an element in a path, whether it stands beside the article by element, its class and id names."""
    names: list[str] = []
    beside = tag in ASIDE
    if attrs and ("=" in attrs or "hidden" in attrs.lower()):
        for m in _ATTR.finditer(attrs):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden" or kind == "aria-hidden" and value == "true":
                beside = True
            elif kind in ("class", "id"):
                names += value.split()
            elif value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
                beside = True
    name = ".".join([tag, *(w for n in names for w in _WORD.findall(n))])
    return (name if len(name) <= MAX_NAME else f"{tag}.{_digest(name)}"), beside, names


def _digest(name: str) -> str:
    return xxhash.xxh3_64_hexdigest(name.encode("utf-8", "replace"))


def walk(page: str):
    """Events of a page in order: ``("open", path, beside, main)`` and ``("text", path, text, beside, main, block)``.

    ``main`` is 0 outside the article, 1 in one whose surroundings are named as beside it, 2 in any other. ``block``
    numbers the blocks: it changes where a block element opens or closes. A page may end anywhere.
    """
    # tag, path, beside by element, beside by name, main
    stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, 0)]
    block = 0
    pos = 0
    raw: str | None = None
    while pos < len(page):
        if raw is not None:
            end = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(page, pos)
            raw = None
            if end is None:
                return
            stack.pop()
            pos = end.end()
            continue
        m = _TOKEN.search(page, pos)
        upto = m.start() if m else len(page)
        if upto > pos:
            _, path, beside, named, main = stack[-1]
            yield "text", path, page[pos:upto], beside or named, main, block
        if m is None:
            return
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            # a close tag does not reach out of the part that it stands in
            wall = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ASIDE | MAIN | {"td", "body"}), 0)
            if depth and (depth >= wall or tag in BLOCK):
                del stack[depth:]
            if tag in BLOCK:
                block += 1
            continue
        if tag in BLOCK:
            block += 1
        if tag in CLOSES_P or tag in SIBLING:
            shut = {"p"} if tag in CLOSES_P else set()
            shut |= SIBLING.get(tag, set())
            depth = len(stack) - 1
            # inline elements left open end with their paragraph
            while depth > 0 and stack[depth][0] not in BLOCK and stack[depth][0] not in ASIDE:
                depth -= 1
            if depth > 0 and stack[depth][0] in shut:
                del stack[depth:]
        if tag in VOID:
            if tag == "br":
                _, path, beside, named, main = stack[-1]
                yield "text", path, " ", beside or named, main, block
            continue
        name, beside, names = place_of(tag, m[3])
        _, outer, out, named, main = stack[-1]
        if len(stack) < MAX_DEPTH:
            path = f"{outer}>{name}"
        else:
            path = f"{stack[MAX_DEPTH - 1][1]}>{tag}.{_digest(outer + '>' + name)}"
        if tag in MAIN and not main:
            main, named = 1 if named else 2, False
        elif tag not in ("body", "html"):
            marks = NOT_ARTICLE if tag in MAIN else BESIDE
            named = named or any(names_beside(n, marks) for n in names)
        here = (tag, path, beside or out, named, main)
        yield "open", path, here[2] or here[3], main
        if m[3].endswith("/") and tag in {"svg", "path"}:
            continue
        stack.append(here)
        if tag in RAW:
            raw = tag


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def page_tokens(page: str) -> tuple[Counter, dict[str, list]]:
    """Occurrences of each place on a page, and the text of each place: ``[characters, hash, main]``."""
    seen: Counter = Counter()
    text: dict[str, list] = {}
    for e in walk(page):
        if e[0] == "open":
            seen[e[1]] += 1
        elif not e[3]:
            t = _SPACE.sub(" ", e[2]).strip()
            if t:
                got = text.setdefault(e[1], [0, 0, bool(e[4])])
                got[0] += len(t)
                got[1] = (got[1] * 31 + xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"))) & ((1 << 62) - 1)
    return seen, text


def _signatures(batches):
    """Rows ``(host, place, sig, pages, chars, low, high, main)`` of one task, folded by host and place."""
    acc: dict[tuple[str, str], list] = {}

    def rows():
        out = [(h, p, *v) for (h, p), v in acc.items()]
        acc.clear()
        return pd.DataFrame(out, columns=["host", "place", "sig", "pages", "chars", "low", "high", "main"])

    for pdf in batches:
        for pid, url, page in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            host = host_of(url)
            seen, text = page_tokens(page or "")
            for place, n in seen.items():
                # the occurrence vector's entry for this page; equal vectors fold to equal signatures
                h = xxhash.xxh3_64_intdigest(f"{pid}|{url}|{n}".encode("utf-8", "replace")) >> 1
                chars, mark, main = text.get(place, (0, 0, False))
                v = acc.get((host, place))
                if v is None:
                    acc[host, place] = [h, 1, chars, mark, mark, main]
                else:
                    v[0] ^= h
                    v[1] += 1
                    v[2] += chars
                    v[3], v[4], v[5] = min(v[3], mark), max(v[4], mark), v[5] or main
            if len(acc) > 100_000:
                yield rows()
    if acc:
        yield rows()


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """Places of every host with their occurrence signature: ``host, place, sig, pages, chars, constant, main``."""
    part = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInPandas(
        _signatures, "host string, place string, sig long, pages long, chars long, low long, high long, main boolean")
    return (part.groupBy("host", "place")
            .agg(F.bit_xor("sig").alias("sig"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"),
                 (F.min("low") == F.max("high")).alias("constant"), F.max("main").alias("main"))
            .filter(F.col("pages") >= SUPPORT))


def supported(eq: DataFrame) -> DataFrame:
    """The places on at least ``SUPPORT_SHARE`` of their host's pages (by its most frequent place).

    A host has at most 1 / ``SUPPORT_SHARE`` times as many of them as a page has places on average.
    """
    most = eq.groupBy("host").agg(F.max("pages").alias("most"))
    return eq.join(most, "host").filter(F.col("pages") >= SUPPORT_SHARE * F.col("most")).drop("most")


def templates(pages: DataFrame) -> DataFrame:
    """Each host's template: ``host, classes`` with a row per host.

    ``classes`` are the valid equivalence classes, outer ones first: their members' places, what a place's text is
    (``constant`` on all pages or data), and the characters it holds. :func:`supported` bounds a host's row.
    """
    eq = keep(supported(keep(equivalence_classes(pages))))
    parent = F.regexp_replace("place", r">[^>]*$", "")
    rows = eq.withColumn("parent", parent)
    # valid: the place around a member recurs on the host too, so classes nest up to the root
    up = rows.select("host", F.col("place").alias("parent"), F.lit(True).alias("inside"))
    nested = rows.join(up, ["host", "parent"], "left").filter(F.col("inside") | (F.col("parent") == ""))
    classes = nested.groupBy("host", "sig", "pages").agg(
        F.sort_array(F.collect_list(F.struct("place", "chars", "constant", "main"))).alias("members"))
    return classes.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("pages", "members")), asc=False).alias("classes"))


def slots_of(classes: list) -> dict[str, float]:
    """The text slots of a host's template outside ``article`` and ``main``: place and varying characters a page.

    A slot that holds the same text on all its pages varies by 0 and is template.
    """
    return {m["place"]: 0.0 if m["constant"] else m["chars"] / c["pages"]
            for c in classes for m in c["members"] if m["chars"] and not m["main"]}


def article_of(slots: dict[str, float], held: set[str]) -> str:
    """The deepest place with at least two thirds of the varying text of the slots that a page holds ("": none)."""
    weight: Counter = Counter()
    for place in held:
        if slots.get(place):
            parts = place.split(">")
            for k in range(2, len(parts) + 1):
                weight[">".join(parts[:k])] += slots[place]
    total = max(weight.values(), default=0)
    best = [p for p, n in weight.items() if 3 * n >= 2 * total and p.rpartition(">")[2].split(".")[0] in
            ("div", "section", "td", "body", "center")]
    return max(best, key=lambda p: (p.count(">"), p)) if best else ""


def main_text(page: str | None, slots: dict[str, float] | None = None) -> str:
    """Main text of one page under its host's template.

    A page with ``article`` or ``main`` elements: the text inside them. Any other: the text below its template's
    article, without constant slots; all text that is not beside the article if there is no such place.
    """
    if not page:
        return ""
    events = [e for e in walk(page) if e[0] == "text" and not e[3]]
    # white space alone names no article
    level = max((e[4] for e in events if e[4] and not e[2].isspace()), default=0)
    if level:
        events = [e for e in events if e[4] == level]
    elif slots:
        article = article_of(slots, {e[1] for e in events})
        inside = [e for e in events if article and (e[1] == article or e[1].startswith(article + ">"))]
        events = inside or events
        # the slots that are the same everywhere are template; a page with nothing else keeps them
        events = [e for e in events if slots.get(e[1]) != 0.0] or events
    blocks: list[str] = []
    last = None
    for e in events:
        if e[5] == last:
            blocks[-1] += e[2]
        else:
            blocks.append(e[2])
            last = e[5]
    done = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in done if b)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rules = templates(pages)
    slots = keep(rules.mapInPandas(_slots, "host string, slots map<string,double>"))
    size = slots.agg(F.sum(F.length("host") + F.length(F.array_join(F.map_keys("slots"), ","))
                           + 32 * F.size("slots") + 48).alias("b")).first()["b"] or 0
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    if size <= BROADCAST_BYTES:
        table = pages.sparkSession.sparkContext.broadcast({r["host"]: r["slots"] for r in slots.collect()})

        def run(batches):
            for pdf in batches:
                t = [main_text(h, table.value.get(host_of(u))) for u, h in zip(pdf["url"], pdf["html"])]
                yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": t,
                                    "n_chars": [len(x) for x in t]})

        return src.mapInPandas(run, f"page_id {dict(src.dtypes)['page_id']}, url string, text string, n_chars long")
    host = F.udf(host_of)(F.col("url").cast("string"))
    joined = src.withColumn("host", host).join(slots, "host", "left")

    def run_joined(batches):
        for pdf in batches:
            t = [main_text(h, dict(m) if m is not None else None) for h, m in zip(pdf["html"], pdf["slots"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": t,
                                "n_chars": [len(x) for x in t]})

    return joined.select("page_id", "url", "html", "slots").mapInPandas(
        run_joined, f"page_id {dict(src.dtypes)['page_id']}, url string, text string, n_chars long")


def _slots(batches):
    for pdf in batches:
        yield pd.DataFrame([(h, slots_of(c)) for h, c in zip(pdf["host"], pdf["classes"])], columns=["host", "slots"])
