"""Operator 10, HTML extraction: wrappers inferred as union-free regular expressions, one per host.

A page is read as a tree of block elements with text slots; inline markup is no structure. Within a page, neighbouring
alike siblings (or tandem groups of up to ``GROUP`` of them) become one repeated group. Trees of a host are aligned:
children that match are merged, mismatches become optional groups, so alternatives never arise. The result is the
host's wrapper; a text slot is a place in it. Each page is matched against its host's wrapper. Figures of each slot over
the host's pages (text, whether it ever varies) and what its elements are called tell the main text's slots from the
rest, for each layout (the slots that a page has) on its own, and extraction reads those slots from every page.

A host's distinct trees are aligned in rounds of groups of about ``TREES``, equal trees are matched once a task, and slot
figures combine map-side, so a host with a third of all pages is no larger task than others.

Cases: null and empty html give an empty text; a null or odd url is a host of its own kind; unclosed, stray and cut-off
tags are tolerated as browsers do, in time linear in the page; repeated rows are extracted each; null page_ids are kept; an empty table gives no
rows; other columns are not read, so their names cannot clash. Depth of nesting is followed up to ``DEPTH`` elements,
deeper ones count as inline (their text stays).
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.llm.common import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = 4
TREES = 64
DEPTH = 200

# Element names of HTML and words that pages use in class, id and role names.
BLOCKS = frozenset("""html head title body header footer nav aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li
dl dt dd table caption thead tbody tfoot tr td th form fieldset blockquote pre figure figcaption address details summary
hr center menu dialog""".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button|canvas|audio|video"
CLOSES_PARAGRAPH = BLOCKS - frozenset("html head title body td th tr thead tbody tfoot caption".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}}
SCOPE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th"}}
NOT_MAIN = frozenset("nav footer aside form dialog menu".split())
NOT_MAIN_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup
modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments
commentlist reply replies respond discussion disqus search searchform widget toolbar pagination pager skip complementary
contentinfo masthead""".split())
MAIN = frozenset(("article", "main"))

#: Possessive, so that a tag that does not end is given up after one look at the rest of the page.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z][^<>]*+|[!?/][^>]*+)(?:>|\Z)")
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split("|")}
#: So many tags of a page may end nowhere (for an open quote, say); after them quotes no longer hide a >.
OPEN_ENDS = 16
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_BREAK = "\n"


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup in page order: where it starts and ends, its tag's name (empty for none), if it closes, its attributes.
    Comments and elements without text of the page are one piece each. In time linear in the page."""
    at, open_ends = 0, 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        tag = (_TAG if open_ends < OPEN_ENDS else _PLAIN_TAG).match(page, at)
        if tag:
            end, name = tag.end(), tag.group(2).lower()
            if name in _END and not tag.group(1):
                if name not in ("svg", "math") or not tag.group(3).endswith("/"):
                    close = _END[name].search(page, end)
                    end = close.end() if close else len(page)
                name = ""
            yield at, end, name, bool(tag.group(1)), tag.group(3)
            at = end
            continue
        open_ends += page[at + 1:at + 2].isalpha()
        cut = _CUT_TAG.match(page, at)
        if cut:
            yield at, cut.end(), "", False, ""
        at = cut.end() if cut else at + 1


def texts(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """Text runs in page order with their path: the names of the open block elements, with class, id and role."""
    open_: list[str] = []
    kinds: list[str] = []
    run: list[str] = []

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text and "title" not in kinds:
            if "head" in kinds:  # text ends the head
                pop_to(kinds.index("head"))
            yield tuple(open_), text

    def pop_to(at: int) -> None:
        del open_[at:], kinds[at:]

    at = 0
    for start, end, tag, closing, attributes in tags(page):
        run.append(page[at:start])
        at = end
        if tag == "br":
            run.append(_BREAK)
        if tag not in BLOCKS:
            continue
        yield from flush()
        if closing:
            if tag in kinds:
                pop_to(len(kinds) - 1 - kinds[::-1].index(tag))
            continue
        if tag not in ("html", "head", "title") and "head" in kinds:
            pop_to(kinds.index("head"))
        if tag in CLOSES_PARAGRAPH and "p" in kinds:
            pop_to(len(kinds) - 1 - kinds[::-1].index("p"))
        closes = SAME_CLOSES.get(tag, ())
        for i in range(len(kinds) - 1, -1, -1):
            if closes and tag in SCOPE.get(kinds[i], ()):
                break
            if kinds[i] in closes:
                pop_to(i)
        if tag != "hr" and len(open_) < DEPTH:
            names = re.sub(r"\d+", "0", " ".join(sorted(x.group(2).strip("\"'") for x in _NAMES.finditer(
                attributes))).lower())
            kinds.append(tag)
            open_.append(f"{tag} {names}" if names else tag)
    run.append(page[at:])
    yield from flush()


# A node of a wrapper: [name, mark, children]. The mark: "" once, "?" optional, "+" repeated, "*" both.
def _marked(node: list, optional: bool = False, repeated: bool = False) -> list:
    optional, repeated = optional or node[1] in "?*" and node[1] != "", repeated or node[1] in "+*" and node[1] != ""
    return [node[0], {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[int(optional), int(repeated)], node[2]]


def merged(a: list, b: list) -> list:
    """One node for two of the same name."""
    node = _marked(_marked(a, b[1] in ("?", "*"), b[1] in ("+", "*")))
    if node[0] == "#":  # of a page: the numbers of its text runs
        return [node[0], node[1], a[2] + b[2]]
    return [node[0], node[1], aligned(a[2], b[2])]


def aligned(xs: list, ys: list) -> list:
    """One list of nodes for two: what matches is merged, what does not is optional."""
    if xs == ys:
        return xs
    out: list = []
    names = [x[0] for x in xs], [y[0] for y in ys]
    if names[0] == names[1]:
        return [merged(x, y) for x, y in zip(xs, ys)]
    match = SequenceMatcher(None, *names, autojunk=False)
    for kind, a, b, c, d in match.get_opcodes():
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(xs[a:b], ys[c:d])]
        else:
            out += [_marked(n, optional=True) for n in (*xs[a:b], *ys[c:d])]
    return folded(out)


def folded(nodes: list) -> list:
    """Neighbours of one name, and tandem groups of names, as repeated nodes."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            both = merged(out[-1], node)
            # Once at least stays certain if either is.
            optional = out[-1][1] in ("?", "*") and node[1] in ("?", "*")
            out[-1] = [both[0], "*" if optional else "+", both[2]]
        else:
            out.append(node)
    for width in range(2, GROUP + 1):
        i = 0
        while i + 2 * width <= len(out):
            names = [n[0] for n in out[i:i + width]]
            end = i + width
            while [n[0] for n in out[end:end + width]] == names:
                end += width
            if end > i + width:
                body = out[i:i + width]
                for j in range(i + width, end, width):
                    body = [merged(x, y) for x, y in zip(body, out[j:j + width])]
                out[i:end] = [["(" + "|".join(names) + ")", "+", body]]
            i += 1
    return out


def read_page(page: str) -> tuple[list, list[int], list[str]]:
    """The wrapper of one page alone (its tree of blocks with text slots ``#``, folded), and of each text run in page
    order the number of its slot in that tree and its text."""
    root: list = ["", "", []]
    before: tuple[str, ...] = ()
    chain, runs = [root], []
    for path, text in texts(page):
        same = 0
        while same < min(len(path), len(before)) and path[same] == before[same]:
            same += 1
        # Equal paths in a row are separate elements of one kind, which folding would join anyway.
        del chain[same + 1:]
        for name in path[same:]:
            node = [name, "", []]
            chain[-1][2].append(node)
            chain.append(node)
        chain[-1][2].append(["#", "", [len(runs)]])
        runs.append(text)
        before = path

    def fold(node: list) -> list:
        return node if node[0] == "#" else [node[0], node[1], folded([fold(c) for c in node[2]])]

    at, n = [0] * len(runs), 0

    def bare(node: list) -> list:
        nonlocal n
        if node[0] != "#":
            return [node[0], node[1], [bare(c) for c in node[2]]]
        for run in node[2]:
            at[run] = n
        n += 1
        return ["#", node[1], []]

    return bare(fold(root)), at, runs


def structure(page: str) -> list:
    return read_page(page)[0]


def flat(nodes: list) -> tuple[list, list[tuple[int, int]]]:
    """The elements of a list of nodes, groups opened: (node, step, whether it may be left out), and the repeated
    groups as ranges. A step is an element's place in the list."""
    out: list = []
    loops: list[tuple[int, int]] = []

    def add(nodes: list, at: str, free: bool) -> None:
        for i, node in enumerate(nodes):
            left = free or node[1] in ("?", "*")
            if node[0].startswith("("):
                start = len(out)
                add(node[2], f"{at}{i}.", left)
                loops.append((start, len(out)))
            else:
                out.append((node, f"{at}{i}", left))

    add(nodes, "", False)
    return out, loops


def slots(node: list, path: tuple = ()) -> Iterator[tuple[str, tuple]]:
    """A wrapper's text slots: their place, and the (step, name) of each element on the way to them."""
    for child, step, _ in flat(node[2])[0]:
        if child[0] == "#":
            yield "/".join([*(x[0] for x in path), step]), path
        else:
            yield from slots(child, (*path, (step, child[0])))


def matched(wrapper: list, page: list, at: str = "") -> list[str | None]:
    """The places in the wrapper of a page's slots, in the page's order, by the cheapest way to read the page's tree
    with the wrapper as a regular expression (an element that must be there and is not costs 1)."""
    far = 1000
    elements, loops = flat(wrapper[2])
    must = [0]
    for _, _, free in elements:
        must.append(must[-1] + (not free))
    of: dict[str, list[int]] = {}
    for j, (node, _, _) in enumerate(elements):
        of.setdefault(node[0], []).append(j)
    inner = [{x[0][0] for x in flat(node[2])[0]} for node, _, _ in elements]

    def step(i: int, j: int) -> int:
        if j > i:
            return must[j] - must[i + 1]
        if j == i and elements[i][0][1] in ("+", "*"):
            return 0
        return min((must[e] - must[i + 1] + must[j] - must[s] for s, e in loops if s <= j <= i < e), default=far)

    read = flat(page[2])[0]
    ways: list[dict[int, tuple[int, int]]] = []
    for node, _, _ in read:
        names, now = {x[0][0] for x in flat(node[2])[0]}, {}
        before = next((w for w in reversed(ways) if w), {-1: (0, -1)})
        for j in of.get(node[0], ()):
            cost, i = min((c + step(i, j), i) for i, (c, _) in before.items())
            now[j] = cost + len(names - inner[j]), i
        ways.append(now)
    last = next((w for w in reversed(ways) if w), {})
    j = min(last, key=lambda j: (last[j][0] + must[-1] - must[j + 1], j), default=-1)
    chosen = []
    for way in reversed(ways):
        chosen.append(j if way else -1)
        j = way[j][1] if way else j
    out: list[str | None] = []
    for (node, _, _), j in zip(read, reversed(chosen)):
        if node[0] == "#":
            out.append(at + elements[j][1] if j >= 0 else None)
        else:
            out += matched(elements[j][0] if j >= 0 else ["", "", []], node, f"{at}{elements[j][1]}/" if j >= 0 else at)
    return out


def shown(node: list) -> str:
    """A wrapper as a regular expression over tags."""
    inner = "".join(shown(c) for c in node[2])
    if node[0] == "#":
        return "(#)" + node[1] if node[1] else "#"
    tag = node[0] != "" and not node[0].startswith("(")
    body = f"<{node[0]}>{inner}</{node[0].split()[0]}>" if tag else inner
    return f"({body}){node[1]}" if node[1] else body


def _is_main(name: str) -> bool:
    tag, _, names = name.partition(" ")
    return tag in MAIN or "main" in names.split()


def _set_aside(path: list[str], unnamed: int = 0) -> bool:
    """Whether the elements along a path speak against main text. The first ``unnamed`` elements, html, body and what
    is around an article or main element only do so by their kind."""
    unnamed = max(unnamed, next((i for i, name in enumerate(path) if _is_main(name)), 0))
    inside = False
    for i, name in enumerate(path):
        tag, _, names = name.partition(" ")
        if tag in NOT_MAIN and (tag != "form" or i >= unnamed) or (
                tag == "header" and not inside):
            return True
        if i >= unnamed and tag not in ("html", "body") and NOT_MAIN_WORDS & set(re.split(r"[^a-z]+", names)):
            return True
        inside |= _is_main(name)
    return False


def _dominating(rows: list[tuple]) -> tuple:
    """The innermost element that holds most of the text of rows (slot, path, chars)."""
    total, top = sum(r[2] for r in rows), ()
    while True:
        share: dict[tuple, float] = {}
        for r in rows:
            if len(r[1]) > len(top) and r[1][:len(top)] == top:
                key = r[1][:len(top) + 1]
                share[key] = share.get(key, 0) + r[2]
        best = max(share, key=lambda k: (share[k], k), default=None)
        if best is None or share[best] < 0.7 * total or best[-1][1].split()[0] in ("p", "li", "td", "h1", "h2", "h3"):
            return top
        top = best


def main_slots(rows: list[tuple]) -> set[str]:
    """Of the slots that one layout of a host has (slot, path, chars, varies) those of the main text: in article or
    main elements if there are any, else below the element that holds most of the text that varies."""
    names = {r[0]: [name for _, name in r[1]] for r in rows}
    within = {r[0] for r in rows if any(map(_is_main, names[r[0]])) and not _set_aside(names[r[0]])}
    if within:
        return within
    # What never varies is left out, unless nothing else is there.
    some = [r for r in rows if r[3] and not _set_aside(names[r[0]], len(r[1]))]
    kept = [r for r in some if not _set_aside(names[r[0]])]
    if sum(r[2] for r in kept) < 0.3 * sum(r[2] for r in some):  # the names are those of the dominating block
        top = _dominating(some)
        kept = [r for r in some if r[1][:len(top)] == top and not _set_aside(names[r[0]], len(top))] or kept
    kept = kept or [r for r in rows if not _set_aside(names[r[0]])]
    top = _dominating(kept)
    return {r[0] for r in kept if r[1][:len(top)] == top}


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id and url with host, content (a hash of tree and text), tree, and slot number and text of each run."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for page in batch.column(3).to_pylist():
                tree, at, runs = read_page(page or "")
                shape = json.dumps(tree)
                digest = hashlib.blake2b("\0".join([shape, *runs]).encode("utf-8", "replace"), digest_size=8).digest()
                for column, value in zip(out, (int.from_bytes(digest, "little", signed=True), shape, at, runs)):
                    column.append(value)
            types = pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, out, types)], [
                "page_id", "url", "host", "content", "tree", "at", "runs"])

    return pages.select("page_id", "url", host(F.col("url")).alias("host"), "html").mapInArrow(
        read, f"page_id {kind}, url string, host string, content long, tree string, at array<int>, runs array<string>")


def inferred(rows: DataFrame) -> DataFrame:
    """Per host of read pages: ``tree``, its wrapper. Trees of a host are aligned in groups of about ``TREES``, then
    what comes of these, until one is left; the number of groups follows the trees."""
    def align(group: pd.DataFrame) -> pd.DataFrame:
        trees = [json.loads(t) for t in sorted(group["tree"])]
        wrapper = trees[0]
        for tree in trees[1:]:
            wrapper = merged(wrapper, tree)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [json.dumps(wrapper)]})

    trees = stage(rows.select("host", "tree").distinct(), "distinct")
    while True:
        sizes = trees.groupBy("host").count()
        most = sizes.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return trees
        groups = sizes.select(F.col("host").alias("site"), F.ceil(F.col("count") / TREES).alias("groups"))
        trees = stage(trees.join(groups, F.col("host") == F.col("site")).select(
            "host", "tree", F.pmod(F.xxhash64("tree"), F.col("groups")).alias("salt")).groupBy("host", "salt").applyInPandas(
                align, "host string, tree string").distinct(), "aligned")


def _places(wrapper: str, tree: str, kept: dict) -> list[str | None]:
    """The places of a page's slots; equal trees of one host are matched once."""
    if kept.get("wrapper") != wrapper:
        kept.clear()
        kept.update(wrapper=wrapper, node=json.loads(wrapper), trees={})
    if tree not in kept["trees"]:
        if len(kept["trees"]) >= 1000:
            kept["trees"].clear()
        kept["trees"][tree] = matched(kept["node"], json.loads(tree))
    return kept["trees"][tree]


def slot_figures(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Per host: ``figures``, of each slot of its wrapper that has text the place, characters a page and whether it
    varies over the pages. Copies of a page count once; slots of fewer than three pages count as varying."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            found = []
            for tree, at, runs, wrapper in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                places, slot = _places(wrapper, tree, kept), {}
                for i, text in zip(at, runs):
                    if places[i] is not None:
                        slot.setdefault(places[i], []).append(text)
                found.append([{"slot": k, "chars": sum(map(len, t)), "hash": int.from_bytes(hashlib.blake2b(
                    "\n".join(t).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)}
                    for k, t in slot.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.struct([
                ("slot", pa.string()), ("chars", pa.int64()), ("hash", pa.int64())])))], ["host", "content", "found"])

    once = rows.join(wrappers, F.col("host") == F.col("site")).select(
        "host", "content", "tree", "at", "runs", "wrapper").mapInArrow(
            read, "host string, content long, found array<struct<slot:string,chars:long,hash:long>>")
    once = once.dropDuplicates(["host", "content"])
    return once.select("host", F.explode("found").alias("f")).groupBy("host", "f.slot").agg(
        F.avg("f.chars").alias("chars"), ((F.count("*") < 3) | (F.min("f.hash") != F.max("f.hash"))).alias(
            "varies")).groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "varies")).alias("figures"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page, read through its host's wrapper."""
    rows = stage(read_pages(pages), "trees")
    wrappers = inferred(rows).select(F.col("host").alias("site"), F.col("tree").alias("wrapper"))
    figures = slot_figures(rows, wrappers).select(F.col("host").alias("place"), "figures")
    known = stage(wrappers.join(figures, F.col("site") == F.col("place"), "left").select(
        "site", "wrapper", "figures"), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            out = []
            for tree, at, runs, wrapper, figures in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                places = _places(wrapper, tree, kept)
                if "slots" not in kept:
                    kept.update(slots=dict(slots(kept["node"])), layouts={}, figures={
                        f["slot"]: (f["chars"], f["varies"]) for f in figures or ()})
                layout = frozenset(p for p in places if p in kept["figures"])
                if layout not in kept["layouts"]:
                    kept["layouts"][layout] = main_slots([
                        (p, kept["slots"][p], *kept["figures"][p]) for p in sorted(layout)])
                main = kept["layouts"][layout]
                out.append(" ".join(text for i, text in zip(at, runs) if places[i] in main))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return rows.join(known, F.col("host") == F.col("site")).select(
        "page_id", "url", "tree", "at", "runs", "wrapper", "figures").mapInArrow(
            read, f"page_id {kind}, url string, text string")
