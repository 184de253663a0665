"""Main text of web pages by removing each site's template.

A first pass hashes the element subtrees; Spark counts in how many different texts of its host each
occurs, apart for those in and those outside an article. A second pass drops the subtrees that recur in
texts of the host, and elements that never hold an article's text (by tag, role or class), and
returns the blocks left. Prose recurs too, so what looks like prose has to recur on most of the site: an
element without attributes and links goes only outside articles and if at least half of the host's texts
have it; within articles only containers with attributes or links go, and none that holds a headline.
Articles are a hint only: outside them short blocks that are no sentence go, but for headlines.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_64_intdigest

from .common import given_back, staged, table, text_batches

# Fixed values of HTML: elements without content, with raw text, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object audio video canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article's own text.
ASIDE = frozenset("head nav header footer aside form menu dialog button".split())
#: Words of a class, id or role that name such elements (a trailing * stands for any ending).
ASIDE_WORDS = (
    "ad ads adv advert* adsense banner* breadcrumb* byline comment comments commentlist consent cookie* complementary contentinfo dialog disclaimer discussion disqus "
    "footer gdpr header login masthead menu* modal nav navbar navigation newsletter notice* notification* overlay pagination pager popup* promo* related* "
    "reply replies respond search share sharing sidebar* sidenav signup skip social* sponsor* subscribe* toolbar widgets".split()
)
#: Further words that such a class or id may have beside them: it has to have no others.
NEUTRAL_WORDS = frozenset(
    "and area article articles bar block body bottom box btn button buttons center column container content copyright description entry extra fixed float footnote global group head holder icon icons "
    "image img inline inner item items js large left line link links list lists main media meta mini mobile module network networks outer page pages panel post posts primary right row rows secondary "
    "section sections site slot small sticky story stories tag tags text the title top unit web wide widget wrap wrapper".split()
)
#: Elements that may be a site's block within an article, if they have attributes or links.
CONTAINERS = frozenset("center details div dl fieldset figure ol section table ul".split())
ARTICLE = frozenset(("article", "main"))
KEPT = ARTICLE | {"html", "body"}
_SCOPE = frozenset("article aside blockquote body button div dd dl fieldset figure footer form header html li main nav ol section table td th ul".split())
_SIBLINGS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
#: The same where some quote is never closed.
_LOOSE = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_ASIDE = re.compile("(?:" + "|".join(w[:-1] + r"\w*" if w[-1] == "*" else w for w in ASIDE_WORDS) + ")")
_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"""[.!?…。！？؟।]["'”’»)\]]*$|.{40}""", re.S)
_STATE = re.compile(r"\b(?:has|with|no|without)[-_]\w+")


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if not attributes:
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if tag in KEPT:
            if tag == "article" and name == "class" and re.search(r"\bcomment|\breply", value):
                return True
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        value = _STATE.sub(" ", value)
        if name in ("class", "id", "role") and any(map(_names_aside, value.split())):
            return True
    return False


def _names_aside(token: str) -> bool:
    """Whether a class names such an element: by one word at least, and by no other word but neutral ones and numbers."""
    words = _WORD.findall(token)
    named = [_ASIDE.fullmatch(w) is not None for w in words]
    return any(named) and all(n or w in NEUTRAL_WORDS or w[0].isdigit() for n, w in zip(named, words, strict=True))


def walk(html: str, recurring: frozenset[int] = frozenset()) -> tuple[list[str], set[int]]:
    """The blocks of a page's main text, and the hashes of its deletable element subtrees with text.

    Subtrees with a hash in recurring are left out. Articles and what is around them cannot be. The hash of
    an element that may be prose is odd.
    """
    blocks: list[str] = []
    marks: list[bool] = []  # whether a block is in an article or is a headline
    hashes: set[int] = set()
    stack: list[list] = []  # tag, digests of children (an inline element's are its parent's), blocks before it, aside, protected, attributes or links, headline
    places: dict[str, list[int]] = {}  # of the open elements of each tag on the stack
    scopes: list[int] = []  # of those that a paragraph does not reach across
    text: list[str] = []
    inside = aside = guarded = 0  # guarded: elements at the stack's foot that hold an article
    low = None

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush():
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                if not aside:
                    blocks.append(line)
                    marks.append(inside > 0 or bool(places.get("h1")))
                if stack:
                    stack[-1][1].append(xxh3_64_digest(line.encode("utf-8", "surrogatepass")))

    def close(k: int):
        """Ends all elements from place k of the stack."""
        nonlocal inside, aside, guarded
        while len(stack) > k:
            tag, children, before, is_aside, protected, formed, headed = stack[-1]
            if tag in BLOCK:
                flush()
            stack.pop()
            places[tag].pop()
            if stack:
                stack[-1][5] |= tag == "a" or (formed and tag not in ARTICLE)
                stack[-1][6] |= headed or tag == "h1"
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            guarded = min(guarded, len(stack))
            aside -= is_aside
            if tag in ARTICLE and not is_aside:
                inside -= 1
            if tag not in BLOCK:
                continue
            key = tag.encode() + b"".join(children)
            site = tag in CONTAINERS and formed
            if len(blocks) > before and not protected and tag not in KEPT and (not inside or (site and not headed)):
                h = xxh3_64_intdigest(b"+" + key if inside else key) >> 2 << 1 | (not site)
                hashes.add(h)
                if h in recurring:
                    del blocks[before:], marks[before:]
            if stack:
                stack[-1][1].append(xxh3_64_digest(key))

    at, n, end, pattern = 0, len(html), html.rfind(">"), _TAG
    while at < n:
        start = html.find("<", at)
        if start < 0 or (start > end and not html.startswith("<!--", start)):  # no tag ends after here
            text.append(html[at:])
            break
        m = pattern.match(html, start)
        if not m and pattern is _TAG and html[start + 1 : start + 2].isalpha():
            pattern = _LOOSE
            m = pattern.match(html, start)
        if not m:
            text.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            text.append(html[at:start])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            k = last((tag,))
            if k >= 0 and (tag in KEPT or k > last(ARTICLE)):
                close(k)
            elif k < 0 and tag in BLOCK and (tag in KEPT or last(ARTICLE) < 0):
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                if low is None:
                    low = html.lower()
                    if len(low) != n:  # some letters change length: look for the names as written
                        low = html
                stop = low.find(f"</{tag}", at)
                at = n if stop < 0 else (html.find(">", stop) + 1 or n)
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if (k := last("p")) > (scopes[-1] if scopes else -1):  # a block ends an open paragraph
                close(k)
            if tag in _SIBLINGS:
                k = last(("dt", "dd", "td", "th") if tag in ("dt", "dd", "td", "th") else (tag,))
                if k > last(_SIBLINGS[tag]):
                    close(k)
            elif tag == "body" and places.get("head"):  # a head left open ends here
                close(places["head"][0])
        is_aside = _is_aside(tag, m[3])
        if tag in ARTICLE and not is_aside and not aside:
            for frame in stack[guarded:]:
                frame[4] = True
            guarded = len(stack)
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append([tag, [] if tag in BLOCK or not stack else stack[-1][1], len(blocks), is_aside, tag in ARTICLE, bool(m[3].strip(" /\n\t\r\f")), False])
        aside += is_aside
        inside += tag in ARTICLE and not is_aside
    close(0)
    flush()
    return ([b for b, m in zip(blocks, marks, strict=True) if m or _SENTENCE.search(b)] if any(marks) else blocks), hashes


def _hash(batches):
    for whole in batches:
        for batch in text_batches(whole, 64):
            found = [walk(h) if h else ([], set()) for h in batch.column(2).to_pylist()]
            contents = pa.array([xxh3_64_intdigest("\n".join(b).encode("utf-8", "surrogatepass")) >> 1 for b, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], contents, pa.array([sorted(s) for _, s in found], pa.list_(pa.int64()))], ["host", "page", "content", "subtrees"])


def _text(batches):
    for whole in batches:
        for batch in text_batches(whole, 64):
            last = len(batch.schema.names) - 2
            texts = [
                "\n".join(walk(h, frozenset(r or ()))[0]) if h else ""
                for h, r in zip(batch.column(last).to_pylist(), batch.column(last + 1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string())], [*batch.schema.names[:last], "text"])


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), least: int = 3) -> DataFrame:
    """The main text of every page: the columns in keep and text.

    pages has url and html; other columns count only if kept. An element subtree goes if it occurs,
    in or else outside articles, in at least `least` different texts of its host, and one that may be prose
    in at least half of all: pages of a host with the same text before this deletion are one. Every page
    is joined with its own recurring subtrees.
    Pages without a host in their url count as one host. Blocks are joined by a newline. Null or empty
    html, and pages of which nothing is left, give an empty text; an empty table gives an empty result.
    Tags that never end are text; a quote that never ends does not hide the tags after it. keep must not
    name text.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    html = F.col("html").cast("string")
    page = F.unhex(F.md5(html.cast("binary")))
    rows = pages.select(host.alias("host"), page.alias("page"), html.alias("html"))
    seen = staged(rows.mapInArrow(given_back(_hash), "host string, page binary, content long, subtrees array<long>"), "html-subtrees")
    votes = seen.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
    counted = votes.groupBy("host", "subtree").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    texts = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    often = staged(counted.join(texts, "host").where("subtree % 2 = 0 or 2 * k >= texts").select("host", "subtree"), "html-recurring")
    met = seen.select("host", "page", F.explode("subtrees").alias("subtree")).join(often, ["host", "subtree"])
    lists = staged(met.groupBy(F.col("host").alias("host_"), F.col("page").alias("page_")).agg(F.sort_array(F.collect_set("subtree")).alias("recurring")), "html-lists")
    own = [f"__keep_{k}" for k in range(len(keep))]
    full = pages.select(*[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], html.alias("html_"), host.alias("host_"), page.alias("page_"))
    joined = full.join(lists, ["host_", "page_"], "left").select(*own, "html_", "recurring")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-2])
    found = joined.mapInArrow(given_back(_text), ", ".join(filter(None, [schema, "text string"])))
    return found.withColumnsRenamed(dict(zip(own, keep, strict=True)))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
