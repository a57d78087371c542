r"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of one host.

Each page is a token stream of tags and texts.  :func:`condense` reads it into
an expression of its own: an element is its label (tag, classes, id, role,
long numbers as 000), its text slot and a chain of items, where neighbours of one label
become one repeated item, and labels that come back after others become a
repeated group of optional ones.  :func:`align` takes two chains in step and
resolves every mismatch: a label that only one side has becomes optional, labels
in crossing order become a repeated group, and texts that differ become a
variable slot.  All pages of a host are aligned so, first within a task, then
the tasks' expressions with each other in rounds of 256, so that a host of any
size is no single task; an expression is as large as its labels, not its pages.
Counts, largest numbers and slots add up in any order, so that what
:func:`regions` decides does not depend on how the pages are dealt.

The wrapper says which parts are the article: its ``article`` (or ``main``)
elements where they hold a good part of the host's text, else the whole body;
without navigation, page headers, footers, asides, forms, scripts and styles,
without parts labelled as menus, notices, adverts, comments and so on (but for
such that hold the article itself), and, where nothing marks the article,
without texts that are equal on all pages and lists that are links.
:func:`main_text` reads a page through its host's wrapper.  Its blocks are the
elements that are not inline; ``br`` is white space.

Edge cases: null html has no text and null urls share the host ''; the one page
of a host is its own wrapper; repeated pages count as often as they are there;
unclosed, stray and truncated tags are read as browsers do in the common cases;
elements nested over 200 deep are read as if they stood at that depth; an empty
table gives no rows.  Only the three named columns are read, so others may have
any name.  A page is held whole by a worker, at about 60 bytes a byte.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import cluster

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?""", re.S)
MARK = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: An open element that a start tag closes, and where the search for it ends.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}
#: Elements that are never part of an article; a form may hold the whole page.
NEVER = frozenset("head title script style noscript template nav footer aside button select textarea input iframe object embed svg canvas audio video dialog menu noembed noframes xmp".split())
#: Words of classes, ids and roles that mark parts which are no article.
NO_ARTICLE = re.compile(
    r"ads?|adv|advert\w*|adsbygoogle|ad(box|slot|unit|sense|wrap\w*|container|banner|block|zone|space)|sponsor\w*|promo\w*|dfp|outbrain|taboola"
    r"|\w*nav(bar|igation|menu|list|links)?|\w*menu|menus|menubar|breadcrumbs?|crumbs?|pag(er|ination)|skip\w*|toolbar|\w*footer|colophon|contentinfo|copyright|\w*sidebar|side|aside|rail|complementary"
    r"|cookies?\w*|consent\w*|gdpr\w*|notices?|alerts?|popups?|modals?|overlays?|paywall|toast|subscri\w*|newsletters?|signup|signin|login|search\w*"
    r"|comments?|comment(list|box|area|section|thread|form|body|text)|\w*comments|repl(y|ies)|respond|discussions?|disqus\w*|shar(e|ing)\w*|social\w*|related\w*|recommend\w*|trending"
)
#: Words that mark a header, which is dropped unless the article's own heading is in it.
HEADER = re.compile(r"\w*header|masthead|topbar|banners?")
DEPTH, MANY = 200, 64
#: Wrappers of one task go out when their labels have this many characters.
HELD = 16 << 20
FAN = 256


class Element:
    __slots__ = ("kids", "label", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []


@functools.lru_cache(1 << 14)
def label_of(tag: str, attrs: str) -> str:
    """``tag.class#id[role]`` with long numbers as 000: elements of one label are one in a template."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in MARK.finditer(attrs)} if attrs else {}
    marks = "".join("." + c for c in sorted(set(found.get("class", "").split())))
    marks += "".join(f"#{x}" for x in found.get("id", "").split()[:1]) + "".join(f"[{x}]" for k in ("role", "itemprop") for x in found.get(k, "").split())
    return tag + re.sub(r"\d{3,}", "000", re.sub(r"[/*]", "_", marks))


def parse(text: str) -> Element:
    """The element tree under a root that stands for the body."""
    root = Element("", "")
    stack, missing = [root], {}
    at = 0
    skip = None

    def cut_to(k: int) -> None:
        del stack[k:]

    for m in TOKEN.finditer(text):
        start = m.start()
        if start < at:
            continue
        if start > at:
            stack[-1].kids.append(text[at:start])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in ("html", "body"):
                continue
            if missing.get(tag):
                missing[tag] -= 1
                stack[-1].kids.append(Element(tag, tag))
                continue
            inline = tag in INLINE
            stops = CLOSES[tag][1] if tag in CLOSES else ()
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == tag:
                    cut_to(k)
                    tag = ""
                    break
                if (inline or tag == "p") and t not in INLINE or t in stops:
                    break
            if tag == "p":  # an end without a start is an empty paragraph
                stack[-1].kids.append(Element(tag, tag))
            continue
        if tag in ("html", "body"):
            cut_to(1)
            continue
        if len(stack) > 1 and stack[1].tag == "head" and tag not in IN_HEAD:
            cut_to(1)
        if tag not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in closed:
                    cut_to(k)
        attrs = m[3] or m[6] or ""
        node = Element(tag, label_of(tag, attrs))
        stack[-1].kids.append(node)
        if tag in RAW:
            skip = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(text, at)
            at = skip.end() if skip else len(text)
        elif tag not in VOID:
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                missing[tag] = missing.get(tag, 0) + 1
    if at < len(text):
        stack[-1].kids.append(text[at:])
    return root


def said(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


# A wrapper's element: [label, occurrences, elements above that have it, most in one of them, characters, of them in links, text slot, chain].
# The slot is the checksum of a text that never changes, or VARIES. A chain is a list of items [repeated, elements].
LABEL, TIMES, SEEN, MOST, CHARS, LINKS, SLOT, CHAIN = range(8)
VARIES = -1


def condense(node: Element) -> tuple[list, list[str]]:
    """The expression of one element of one page, and its text's pieces."""
    texts, links, places, elements, reach = [], 0, {}, [], []
    for k in _flat(node, False):
        if isinstance(k, tuple):
            piece = said(k[0])
            texts.append(piece)
            links += len(piece.strip()) * k[1]
        elif k.tag not in INLINE and k.tag not in VOID:
            sub, below = condense(k) if k.tag not in NEVER else ([k.label, 1, 1, 1, 0, 0, 0, []], [])
            links += sub[LINKS]
            texts += ["\n", *below, "\n"]
            if sub[LABEL] in places:
                k = places[sub[LABEL]]
                merge(elements[k], sub, within=True)
                reach[k] = len(elements) - 1
            else:
                places[sub[LABEL]] = len(elements)
                reach.append(len(elements))
                elements.append(sub)
    # A label that comes back after others spans a repeated group up to the last label that came before its return.
    chain, first = [], 0
    while first < len(elements):
        end = k = first
        while k <= end:
            end = max(end, reach[k])
            k += 1
        chain.append([end > first, elements[first : end + 1]])
        first = end + 1
    text = " ".join("".join(texts).split())
    return [node.label, 1, 1, 1, len(text), links, zlib.crc32(text.encode("utf-8", "surrogatepass")), few_labels(chain)], texts


def _flat(node: Element, link: bool):
    """The texts, with whether they are links, and the blocks of an element, through its inline ones."""
    for k in node.kids:
        if isinstance(k, str):
            yield (k, link)
        elif k.tag == "br":
            yield (" ", link)
        elif k.tag in INLINE and category(k.label) != "no":
            yield from _flat(k, link or k.tag == "a")
        elif k.tag not in INLINE:
            yield k


def merge(a: list, b: list, within: bool = False) -> list:
    """``a`` aligned with ``b``, an element of the same label: of another page, or of the same element above."""
    a[TIMES] += b[TIMES]
    if within:
        a[MOST] += b[MOST]
    else:
        a[SEEN] += b[SEEN]
        a[MOST] = max(a[MOST], b[MOST])
    a[CHARS] += b[CHARS]
    a[LINKS] += b[LINKS]
    if a[SLOT] != b[SLOT]:
        a[SLOT] = VARIES
    a[CHAIN] = few_labels(align(a[CHAIN], b[CHAIN]))
    return a


def align(a: list, b: list) -> list:
    """The chain that both chains are words of."""
    if not a or not b:
        return a or b
    in_a = {e[LABEL]: i for i, item in enumerate(a) for e in item[1]}
    in_b = {e[LABEL]: j for j, item in enumerate(b) for e in item[1]}
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and not any(e[LABEL] in in_b for e in a[i][1]):  # only a has it: optional
            out.append(a[i])
            i += 1
            continue
        if j < len(b) and not any(e[LABEL] in in_a for e in b[j][1]):
            out.append(b[j])
            j += 1
            continue
        # Both go on with something that the other has too: take as much as it needs to have the same labels on both sides.
        to_i, to_j, p, q = i + 1, j + 1, i, j
        while p < to_i or q < to_j:
            if p < to_i:
                to_j = max([to_j, *(in_b[e[LABEL]] + 1 for e in a[p][1] if e[LABEL] in in_b)])
                p += 1
            else:
                to_i = max([to_i, *(in_a[e[LABEL]] + 1 for e in b[q][1] if e[LABEL] in in_a)])
                q += 1
        found: dict[str, list] = {}
        for item in (*a[i:to_i], *b[j:to_j]):
            for e in item[1]:
                found[e[LABEL]] = merge(found[e[LABEL]], e) if e[LABEL] in found else e
        one = to_i == i + 1 and to_j == j + 1
        out.append([(a[i][0] or b[j][0]) if one and len(found) == 1 else True, list(found.values())])
        i, j = to_i, to_j
    return out


def few_labels(chain: list) -> list:
    """A tag with over MANY labels side by side marks nothing by them: they become one, ``tag*``."""
    labels = [e[LABEL] for item in chain for e in item[1]]
    if len(labels) <= MANY and not any(x.endswith("*") for x in labels):
        return chain
    tags: dict[str, int] = {}
    for x in labels:
        tags[tag_of(x)] = tags.get(tag_of(x), 0) + (MANY + 1 if x.endswith("*") else 1)
    if max(tags.values()) <= MANY:
        return chain
    out, first = [], {}
    for item in chain:
        rest = []
        for e in item[1]:
            tag = tag_of(e[LABEL])
            if tags[tag] <= MANY:
                rest.append(e)
            elif tag in first:
                most = first[tag][MOST] + e[MOST]
                merge(first[tag], e)[MOST] = most
            else:
                e[LABEL] = tag + "*"
                first[tag] = e
                rest.append(e)
        if rest:
            out.append([True, rest] if len(rest) < len(item[1]) or item[0] else item)
    return out


@functools.lru_cache(1 << 14)
def tag_of(label: str) -> str:
    return re.match(r"[^.#\[*]*", label)[0]


@functools.lru_cache(1 << 14)
def category(label: str) -> str:
    """``never``, ``no``, ``header``, ``article``, ``main`` or nothing, by tag and marks."""
    tag = tag_of(label)
    if tag in NEVER:
        return "never"
    marks = [w for x in re.findall(r"[.#\[]([^.#\[\]]*)", label) for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) if w]
    if tag == "form" or any(NO_ARTICLE.fullmatch(w) for w in marks):
        return "no"
    if tag == "article":
        return "article"
    if tag == "main" or re.search(r"\[(main|article|articleBody)\]", label):
        return "main"
    if tag == "header" or any(HEADER.fullmatch(w) for w in marks):
        return "header"
    return ""


def _below(e: list):
    for item in e[CHAIN]:
        yield from item[1]


def _heading(e: list, above: int) -> bool:
    """Whether a heading whose text varies (or was seen less than three times) is in it."""
    return any((re.fullmatch("h[1-3]", tag_of(x[LABEL])) is not None and (x[SLOT] == VARIES or above < 3)) or _heading(x, above) for x in _below(e) if category(x[LABEL]) not in ("never", "no"))


def _has(e: list, kinds: tuple) -> bool:
    return any(category(x[LABEL]) in kinds or (category(x[LABEL]) != "never" and _has(x, kinds)) for x in _below(e))


def regions(wrapper: list) -> dict[str, list[str]]:
    """``roots``: paths of the article's elements (none: the body); ``drops``: paths that are not part of it; both by kind of root."""
    pages = wrapper[TIMES]
    found: dict[str, list] = {"article": [], "main": []}
    drops: list[str] = []
    folded: list[str] = []

    def outermost(e: list, path: str, inside: bool) -> None:
        for x in _below(e):
            kind, at = category(x[LABEL]), f"{path}/{x[LABEL]}"
            if kind == "never" or kind == "no" and not _has(x, ("article", "main")):
                continue
            if kind == "article" and not inside:
                found["article"].append((at, x))
            if kind == "main" and not inside:
                found["main"].append((at, x))
            outermost(x, at, inside or kind == "article")

    outermost(wrapper, "", False)
    found["main"] = [(p, x) for p, x in found["main"] if not any(p.startswith(o + "/") for o, _ in found["main"] if o != p)]
    total = sum(x[CHARS] for x in _below(wrapper) if category(x[LABEL]) not in ("never", "no") or _has(x, ("article", "main")))
    kind = next((k for k in ("article", "main") if found[k] and 10 * sum(x[CHARS] for _, x in found[k]) >= 3 * total), "")
    roots = [p for p, _ in found[kind]] if kind else []

    def mark(e: list, path: str, inside: bool) -> None:
        for x in _below(e):
            what, at = category(x[LABEL]), f"{path}/{x[LABEL]}"
            if x[LABEL].endswith("*"):
                folded.append(at)
            here = inside or at in roots
            holds = any(p == at or p.startswith(at + "/") for p in roots) or (not roots and 10 * x[CHARS] >= 6 * total)
            gone = what == "never" or what == "no" and not holds
            if what == "header" and not holds:
                gone = not _heading(x, pages) or not (inside or not roots)
            if not (gone or here or roots or holds) and pages >= 3:
                constant = x[SLOT] != VARIES and x[TIMES] >= 3 and 10 * x[SEEN] >= 6 * pages and x[CHARS] > 0
                linked = 10 * x[LINKS] >= 6 * x[CHARS] > 0 and tag_of(x[LABEL]) not in ("p", "blockquote")
                gone = (constant and wrapper[SLOT] == VARIES) or linked
            if gone:
                drops.append(at)
            else:
                mark(x, at, here)

    mark(wrapper, "", False)
    return {"roots": sorted(roots), "drops": sorted(drops), "folded": sorted(folded)}


def expression(e: list, optional: bool = False) -> str:
    """The wrapper as a union-free regular expression: ``?`` optional, ``+`` repeated, ``*`` both, #PCDATA a text that varies, #TEXT one that does not."""
    parts = []
    for repeated, elements in e[CHAIN]:
        if repeated and len(elements) > 1:
            parts.append("(" + " ".join(expression(x, True) for x in elements) + ")+")
        else:
            parts += [expression(x, x[SEEN] < e[TIMES]) for x in elements]
    slot = ["#PCDATA" if e[SLOT] == VARIES else "#TEXT"] if e[CHARS] and not parts else []
    sign = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, e[MOST] > 1]
    return f"<{e[LABEL] or 'body'}>({' '.join(parts + slot)}){sign}"


def main_text(html: str, roots: frozenset, drops: frozenset, folded: frozenset) -> str:
    """The blocks of a page under its roots, without what its wrapper drops."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run.clear()

    def read(node: Element, path: str, inside: bool) -> None:
        for k in node.kids:
            if isinstance(k, str):
                if inside:
                    run.append(said(k))
            elif k.tag == "br":
                run.append(" ")
            elif k.tag in INLINE:
                if category(k.label) != "no":
                    read(k, path, inside)
            else:
                flush()
                at = f"{path}/{k.label}"
                if folded and (wide := f"{path}/{k.tag}*") in folded:
                    at = wide
                    if category(k.label) in ("never", "no"):
                        continue
                if at not in drops:
                    read(k, at, inside or at in roots)
                    flush()

    tree = parse(html)
    read(tree, "", not roots)
    flush()
    if not blocks and roots:  # a page without the host's article
        read(tree, "", True)
        flush()
    return "\n".join(blocks)


def _wrapper_rows(held: dict[str, list]) -> pa.RecordBatch:
    rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())], names=["host", "wrapper"])
    held.clear()
    return rows


def _learn(batches):
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = condense(parse(html or ""))[0]
            if host in held:
                merge(held[host], page)
            else:
                held[host] = page
            size += min(len(html or ""), 1 << 16)
            if size > HELD * 16:
                yield _wrapper_rows(held)
                size = 0
    if held:
        yield _wrapper_rows(held)


def _merge(batches):
    """Rows arrive sorted by host; one wrapper is held at a time."""
    now, total = None, None
    for batch in batches:
        for host, salt, text in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper")), strict=True):
            part = json.loads(text)
            if (host, salt) == now:
                merge(total, part)
            else:
                if now is not None:
                    yield _wrapper_rows({now[0]: total})
                now, total = (host, salt), part
    if now is not None:
        yield _wrapper_rows({now[0]: total})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of (host, html) rows: one row a host, from all its pages."""
    found = cluster.cut(pages.select("host", "html").mapInArrow(_learn, "host string, wrapper string"), "op11-learned")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        salt = F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(-(-most // FAN)))
        merged = found.select("host", salt.alias("salt"), "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_merge, "host string, wrapper string")
        before, found = found, cluster.cut(merged, "op11-merged")
        cluster.drop(before)


def host_of(url: str):
    """The lower-case host of a url column, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page, read through the wrapper of its host."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))

    def decide(batches):
        for batch in batches:
            said = [json.dumps(regions(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(said, pa.string())], names=["host", "regions"])

    decided = cluster.cut(wrappers(rows).mapInArrow(decide, "host string, regions string"), "op11-regions")
    size = decided.agg(F.sum(F.octet_length("regions") + 64)).first()[0] or 0
    if size <= cluster.BROADCAST_BYTES:
        joined = rows.join(F.broadcast(decided), "host")
    else:
        counts = cluster.cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).join(decided, "host"), "op11-counts")
        joined = cluster.join_heavy(rows, counts, ["host"], "rows", int(counts.agg(F.sum("rows")).first()[0]))

    def read(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for html, regions_ in zip(batch.column("html").to_pylist(), batch.column("regions").to_pylist(), strict=True):
                if regions_ not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[regions_] = tuple(frozenset(json.loads(regions_)[k]) for k in ("roots", "drops", "folded"))
                texts.append(main_text(html or "", *known[regions_]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema
    out = f"page_id {kind['page_id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string"
    return joined.select("page_id", "url", "html", "regions").mapInArrow(read, out)
