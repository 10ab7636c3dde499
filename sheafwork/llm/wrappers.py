"""Main text of web pages by wrapper induction.

Every page is parsed once, to its layout (the tree of its element names, runs of equal neighbours taken
as one) and its blocks of text.  All different layouts of a host are merged by simple tree matching, some
at a time and then what came of them, into the host's wrapper: a tree of the places that its pages have
in common.  Then every layout is aligned with its host's wrapper, and for each place counted how many
different pages have the same text there.  Places with one text on nearly all pages that have the place
are template, the others are slots; so a page of another layout, an error page or an empty one does not
count against it.  Last, every page's text is put together from its slots: from inside the article where
the page marks one, never from elements that by name, class or role are menus, headers, adverts, forms,
scripts, comments and the like.

Pages that are copies of each other count once, so that a host full of one article keeps it.  No step
works on a sample.  What cannot be template by counts over all pages is left out of wrappers: hosts and
paths of names with fewer different pages than a template needs, and the inside of elements in which no
text recurs.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.arrays import chunks, utf8
from sheafwork.llm.dom import Group, Node, Slot, grouped, numbered, parse, settled, tree_match
from sheafwork.llm.tables import hot_keys, partitions, shared

#: Share of the different pages with a place that must have one text there for it to be template.
TEMPLATE_SHARE = 0.9
#: Different pages that must have the place for that.
TEMPLATE_PAGES = 5
#: Pages that have a text at one path of names, at least, where it matters: half of ``TEMPLATE_PAGES``.
RECURRING = (TEMPLATE_PAGES + 1) // 2
#: Share of a block's characters in links from which it is a menu, outside a marked article.
LINKED = 0.6
#: Layouts, and then wrappers, that are merged at a time.
MERGED = 32


def host_of(url):
    """The host of an address in lower case; empty for none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _hash(text: str | bytes) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


def merged(slots: list[Slot], others: list, known: dict | None = None) -> list[Slot]:
    """A wrapper with the places of a page, or of another wrapper; new ones are put in where they stand."""
    known = {} if known is None else known
    _, pairs = tree_match(others, slots, known)
    partner = dict(pairs)
    out: list[Slot] = []
    taken = 0
    for i, other in enumerate(others):
        if i in partner:
            out += slots[taken : partner[i]]
            slot, taken = slots[partner[i]], partner[i] + 1
        else:
            slot = Slot(other.name)
        if slot.shape != other.shape:
            slot.children = merged(slot.children, other.children, known)
            settled(slot)
        out.append(slot)
    return out + slots[taken:]


def places(groups: list, slots: list[Slot], known: dict | None = None) -> dict[int, int]:
    """Number of a slot by number of a group, for the groups of a page that have a place in the wrapper."""
    known = {} if known is None else known
    found = {}
    for i, j in tree_match(groups, slots, known)[1]:
        found[groups[i].number] = slots[j].number
        found |= places(groups[i].children, slots[j].children, known)
    return found


def measured(root: Node) -> tuple[list[Group], list[tuple[int, int, int, str | None]]]:
    """The groups of a page, numbered from 1, and its blocks of text in their order.

    A block is (number of its group, or 0; hash of all texts of its element; hash of its text; its text if
    it is main text unless it is template).  Elements that never hold content have none.
    """
    groups = grouped(root.children())
    numbered(groups, 1)
    number: dict[int, int] = {}

    def take(level: list[Group]) -> None:
        for group in level:
            number.update((id(m), group.number) for m in group.members)
            take(group.children)

    take(groups)

    def has_main(node: Node) -> bool:
        return any(not c.never and ((c.main and _prose(c)) or has_main(c)) for c in node.children())

    marked = has_main(root)
    blocks: list[tuple[int, int, int, str | None]] = []

    def walk(node: Node, inside: bool) -> None:
        own = [t for t, _ in node.texts()]
        whole = _hash("\n".join(own)) if own else 0
        for item in node.items:
            if isinstance(item, Node):
                if not item.never:
                    walk(item, inside or item.main)
            else:
                text, linked = item
                wanted = inside or (not marked and linked <= LINKED * len(text))
                piece = whole if len(own) == 1 else _hash(text)
                blocks.append((number.get(id(node), 0), whole, piece, text if wanted else None))

    walk(root, False)
    return groups, blocks


def extract(root: Node, slots: list[Slot], template: set[tuple[int, int]]) -> str:
    """The blocks of the main text, in order, joined by line feeds, without (slot, text hash) of ``template``."""
    groups, blocks = measured(root)
    found = places(groups, slots) if template else {}
    texts = [t for place, own, _, t in blocks if t is not None and (found.get(place), own) not in template]
    return "\n".join(texts)


def _prose(node: Node) -> bool:
    return bool(node.texts()) or any(_prose(c) for c in node.children() if not c.never)


def _page_rows(batches):
    """(batch, row, html) of all rows, a bounded number of bytes taken out of Arrow at a time."""
    for batch in batches:
        _, offsets = utf8(batch.column("html"))
        for low, high in chunks(offsets):
            yield batch.slice(low, high - low), batch.column("html").slice(low, high - low).to_pylist()


def extract_pages(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per row of ``pages``: (page_id, url, text, n_chars).

    A null or empty page has an empty text.  Pages without a host are taken as one host.  Repeated
    rows stay.  What is known of layouts with a share of the pages, a bounded number, is broadcast; pages
    of other layouts are joined with it.
    """
    source = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
        host_of(F.col(url_column)).alias("host"),
    )
    parsed = shared(source.mapInArrow(_parsed, _PARSED), "parsed-pages", "zstd")
    rows = parsed.groupBy("layout").agg(F.count("*").alias("rows"))
    hot = shared(hot_keys(rows, "layout"), "hot-layouts")
    different = parsed.select("host", "layout", "content").distinct()
    counts = shared(different.groupBy("host", "layout").agg(F.count("*").alias("pages")), "layout-pages")
    hosts = counts.groupBy("host").agg(F.sum("pages").alias("host_pages"), F.count("*").alias("layouts"))
    hosts = shared(hosts.where(F.col("host_pages") >= TEMPLATE_PAGES), "hosts")
    recurring = _recurring(parsed)
    layouts = _layouts(parsed, counts, hosts, recurring)
    aligned = shared(_aligned(layouts, _wrappers(layouts)), "aligned")
    template = shared(_template(parsed, aligned, hosts, recurring, hot), "templates")
    final = _by_layout(parsed.select("page_id", "url", "layout", "places", "owns", "texts"), template, hot, "left")
    blocks = F.arrays_zip("places", "owns", "texts")
    kept = F.transform(
        blocks, lambda b: F.when(~F.array_contains("template", F.xxhash64(b["places"], b["owns"])), b["texts"])
    )
    text = F.array_join(F.when(F.col("template").isNull(), F.col("texts")).otherwise(kept), "\n")
    return final.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


_PARSED = (
    "page_id bigint, url string, host string, layout bigint, content bigint, shape string, paths array<bigint>, "
    "steps array<bigint>, places array<int>, owns array<bigint>, pieces array<bigint>, texts array<string>"
)


def _shape(groups: list[Group]) -> list:
    return [[g.name, _shape(g.children)] for g in groups]


def _paths(groups: list[Group], above: str) -> list[int]:
    """A hash of the host and the names from the root, for each group in the order of their numbers."""
    found = []
    for group in groups:
        path = f"{above}\n{group.name}"
        found += [_hash(path), *_paths(group.children, path)]
    return found


def _parsed(batches):
    """Layout and blocks of every page; its names and paths come with a layout's first page of a task.

    ``steps`` are the paths of the blocks' groups, ``pieces`` null where they equal ``owns``.
    """
    known: dict[int, list[int]] = {}
    for batch, htmls in _page_rows(batches):
        layouts, contents, shapes, paths, ends = [], [], [], [], [0]
        steps, places_, owns, pieces, texts = [], [], [], [], []
        for host, html in zip(batch.column("host").to_pylist(), htmls):
            groups, blocks = measured(parse(html or ""))
            shape = json.dumps(_shape(groups), separators=(",", ":"))
            layout = _hash(f"{host}\n{shape}")
            told = layout in known
            if not told:
                if len(known) >= 10_000:
                    known.clear()
                known[layout] = _paths(groups, host)
            layouts.append(layout)
            shapes.append(None if told else shape)
            paths.append(None if told else known[layout])
            numbers = array("q", [layout])
            for place, own, piece, text in blocks:
                steps.append(known[layout][place - 1] if place else None)
                places_.append(place)
                owns.append(own)
                pieces.append(None if piece == own else piece)
                texts.append(text)
                numbers.extend((place, own, piece))
            contents.append(_hash(numbers.tobytes()))
            ends.append(len(texts))
        offsets = pa.array(ends, pa.int32())
        lists = ((steps, pa.int64()), (places_, pa.int32()), (owns, pa.int64()), (pieces, pa.int64()), (texts, pa.string()))
        yield pa.record_batch(
            [
                batch.column("page_id"),
                batch.column("url"),
                batch.column("host"),
                pa.array(layouts, pa.int64()),
                pa.array(contents, pa.int64()),
                pa.array(shapes, pa.string()),
                pa.array(paths, pa.list_(pa.int64())),
                *(pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in lists),
            ],
            names=[
                "page_id", "url", "host", "layout", "content", "shape", "paths",
                "steps", "places", "owns", "pieces", "texts",
            ],
        )


def _by_layout(left: DataFrame, right: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """Join of pages with a table of one row per layout; that of hot layouts, at most 1/HOT_SHARE, is broadcast."""
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "layout", "left")
    known = F.broadcast(right.join(F.broadcast(hot), "layout", "left_semi"))
    often = marked.where("_hot").drop("_hot").join(known, "layout", how)
    seldom = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, "layout", how)
    return often.unionByName(seldom)


def _recurring(parsed: DataFrame) -> DataFrame:
    """(step, own): the texts that at least ``RECURRING`` different pages have at one path of names."""
    at = F.explode(F.array_distinct(F.arrays_zip("steps", "owns"))).alias("at")
    seen = parsed.select("content", at).select("content", "at.*").where("steps is not null").distinct()
    found = seen.groupBy("steps", "owns").count().where(F.col("count") >= RECURRING)
    return shared(found.select(F.col("steps").alias("step"), F.col("owns").alias("own")), "recurring")


def _layouts(parsed: DataFrame, counts: DataFrame, hosts: DataFrame, recurring: DataFrame) -> DataFrame:
    """(host, layout, shape, rare, busy, buckets, bucket) of the layouts with recurring texts.

    ``rare`` has the numbers of groups whose path of names fewer pages of the host have than a template
    needs, ``busy`` of those with recurring texts at theirs.  A bucket has about ``MERGED`` layouts of a host.
    """
    known = parsed.where("shape is not null").select("layout", "shape", "paths").dropDuplicates(["layout"])
    known = shared(known.join(counts, "layout").join(hosts, "host"), "layouts")
    path = F.explode(F.array_distinct("paths")).alias("path")
    held = known.select("pages", path).groupBy("path").agg(F.sum("pages").alias("held"))
    busy = recurring.select(F.col("step").alias("path")).distinct().withColumn("busy", F.lit(True))
    held = held.join(busy, "path", "left").where(F.col("busy") | (F.col("held") < TEMPLATE_PAGES))
    at = known.select("layout", F.posexplode("paths").alias("at", "path")).join(shared(held, "paths"), "path")
    number = F.col("at") + 1
    at = at.groupBy("layout").agg(
        F.collect_list(F.when(F.col("held") < TEMPLATE_PAGES, number)).alias("rare"),
        F.collect_list(F.when((F.col("held") >= TEMPLATE_PAGES) & F.col("busy"), number)).alias("busy"),
    )
    found = known.join(at.where(F.size("busy") > 0), "layout").drop("layouts")
    found = shared(found.select("host", "layout", "shape", "rare", "busy"), "recurring-layouts")
    buckets = found.groupBy("host").agg(F.ceil(F.count("*") / MERGED).cast("bigint").alias("buckets"))
    return shared(found.join(buckets, "host").withColumn("bucket", F.pmod("layout", "buckets")), "layout-buckets")


def _common(shape: str, rare, busy) -> tuple[list[Slot], int]:
    """The groups of a layout with their numbers, and how many it has with those left out.

    Left out are rare ones, and what is inside a group without busy ones in it.
    """
    level = [Slot.from_list(v) for v in json.loads(shape)]
    end = numbered(level, 1)
    rare, busy = set(rare), set(busy)

    def keep(level: list[Slot]) -> list[Slot]:
        kept, wanted = [], False
        for slot in level:
            if slot.number not in rare:
                slot.children = keep(slot.children)
                wanted |= bool(slot.children) or slot.number in busy
                kept.append(settled(slot))
        return kept if wanted else []

    return keep(level), end


def _merge(trees: Callable) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        slots: list[Slot] = []
        for tree in trees(frame):
            slots = merged(slots, tree)
        wrapper = json.dumps([s.as_list() for s in slots], separators=(",", ":"))
        return pd.DataFrame({"host": frame["host"].iloc[:1], "bucket": frame["bucket"].iloc[:1], "wrapper": wrapper})

    return run


def _of_layouts(frame: pd.DataFrame):
    frame = frame.sort_values("layout")
    return (_common(*row)[0] for row in zip(frame["shape"], frame["rare"], frame["busy"]))


def _of_wrappers(frame: pd.DataFrame):
    return ([Slot.from_list(v) for v in json.loads(w)] for w in frame.sort_values("part")["wrapper"])


def _spread(trees: DataFrame, *keys: str) -> DataFrame:
    """Groups over as many tasks as set: trees are few bytes but much work, so tasks are not joined by size."""
    return trees.repartition(partitions(trees.sparkSession), *keys)


def _wrappers(layouts: DataFrame) -> DataFrame:
    """(host, wrapper) from all layouts: those of a bucket merged, then so many buckets at a time."""
    columns = "host string, bucket bigint, wrapper string"
    most = layouts.agg(F.max("buckets").alias("most")).first().most or 0
    found = _spread(layouts, "host", "bucket").groupBy("host", "bucket").applyInPandas(_merge(_of_layouts), columns)
    while most > 1:
        parts = shared(found, "wrappers").withColumnRenamed("bucket", "part")
        parts = parts.withColumn("bucket", F.floor(F.col("part") / MERGED))
        found = _spread(parts, "host", "bucket").groupBy("host", "bucket").applyInPandas(_merge(_of_wrappers), columns)
        most = -(-most // MERGED)
    return shared(found.select("host", "wrapper"), "wrappers")


def _aligned(layouts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, layout, slots): for number 0 and those of the groups of a layout, the slot's number or -1."""

    def align(frame: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
        slots = [Slot.from_list(v) for v in json.loads(wrapper["wrapper"].iloc[0])]
        numbered(slots, 0)
        found = []
        for row in zip(frame["shape"], frame["rare"], frame["busy"]):
            groups, end = _common(*row)
            partner = places(groups, slots)
            found.append([partner.get(number, -1) for number in range(end)])
        return pd.DataFrame({"host": frame["host"], "layout": frame["layout"], "slots": found})

    buckets = layouts.select("host", F.col("bucket").alias("part")).distinct().join(wrappers, "host")
    buckets = buckets.select(F.col("host").alias("site"), "part", "wrapper")
    each = _spread(layouts, "host", "bucket").groupBy("host", "bucket")
    each = each.cogroup(_spread(buckets, "site", "part").groupBy("site", "part"))
    return each.applyInPandas(align, "host string, layout bigint, slots array<int>")


def _template(
    parsed: DataFrame, aligned: DataFrame, hosts: DataFrame, recurring: DataFrame, hot: DataFrame
) -> DataFrame:
    """(layout, template): hashes of (group, text hash) that nearly all different pages of the host have there."""
    columns = ("steps", "places", "owns")
    texts = F.transform(
        F.arrays_zip(*columns),
        lambda b: F.struct(
            F.col("slots")[b["places"]].alias("slot"), b["steps"].alias("step"), b["owns"].alias("own")
        ),
    )
    texts = F.array_distinct(F.filter(texts, lambda t: t["slot"] >= 0))

    def of_pages(pages: DataFrame, page: str) -> DataFrame:
        """(host, slot, own, pages): different pages with a recurring text in a place."""
        seen = pages.select("host", page, F.explode(texts).alias("at")).select("host", page, "at.*")
        seen = seen.join(recurring, ["step", "own"], "left_semi").select("host", page, "slot", "own").distinct()
        return seen.groupBy("host", "slot", "own").agg(F.count("*").alias("pages"))

    most = of_pages(_by_layout(parsed.select("layout", "content", *columns), aligned, hot, "inner"), "content")
    most = most.groupBy("host", "slot").agg(F.max("pages").alias("most"))
    # Places where half of all different pages share a text do not tell pages apart.
    constant = most.join(hosts, "host").where(F.col("most") * 2 >= F.col("host_pages"))
    constant = constant.groupBy("host").agg(F.collect_list("slot").alias("constant"))
    marked = shared(aligned.join(constant, "host", "left"), "constant-places")

    rest = F.filter(
        F.arrays_zip("places", "owns", "pieces"),
        lambda b: F.col("constant").isNull() | ~F.array_contains("constant", F.col("slots")[b["places"]]),
    )
    rest = F.xxhash64(F.transform(rest, lambda b: F.coalesce(b["pieces"], b["owns"])))
    pages = _by_layout(parsed.select("layout", "pieces", *columns), marked, hot, "inner").withColumn("page", rest)
    counts = shared(of_pages(pages, "page"), "places")
    counts = counts.where(F.col("pages") >= TEMPLATE_PAGES * TEMPLATE_SHARE)
    having = F.explode(F.array_distinct(F.transform(texts, lambda t: t["slot"]))).alias("slot")
    having = pages.select("host", "page", having).join(counts, ["host", "slot"], "left_semi").distinct()
    totals = having.groupBy("host", "slot").agg(F.count("*").alias("total"))
    found = counts.join(totals.where(F.col("total") >= TEMPLATE_PAGES), ["host", "slot"])
    found = found.where(F.col("pages") >= F.col("total") * TEMPLATE_SHARE).select("host", "slot", "own")
    each = aligned.select("host", "layout", F.posexplode("slots").alias("place", "slot"))
    each = each.join(shared(found, "template-texts"), ["host", "slot"])
    return each.groupBy("layout").agg(F.collect_list(F.xxhash64("place", "own")).alias("template"))
