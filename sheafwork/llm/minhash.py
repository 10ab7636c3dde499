"""Near duplicates by MinHash: an inverted join on the coordinates of signatures, then exact sets.

A signature has ``COORDINATES`` least hashes of a document's word shingles.  Documents are posted under
coordinate-value pairs, seldom pairs first.  Two signatures that agree in ``MATCHES`` coordinates or more
share at least L of the first ``COORDINATES - MATCHES + L`` pairs of each, in any one order of all pairs: so
only this prefix is posted, documents with fewer than L shared postings are skipped, and two documents have
to collide L times before anything else of them is read.  Only then are the other coordinates merged: the
signatures are compared whole, and those with ``MATCHES`` agreements are compared by their full sets.  A
pair of the wanted index has 86 of 128 agreements but for a chance of some 1e-8.

Only connected groups are asked for, so pairs inside a large group are not all listed.  Each posting is
first linked as a star around its least member.  What is then still in several components is compared:
in pairs where postings are small; in larger ones block against block inside a task, first by signatures
and then, for what hangs together by these, by sets.  Only links that join something leave such a task.

Documents with equal sets are one class, known by a 64-bit hash; links are between classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.llm.arrays import Slices, mix, text_chunks
from sheafwork.llm.components import components
from sheafwork.llm.tables import lookup, shared, spent
from sheafwork.operators.scale import possibly_in

SHINGLE = 5
#: Links have an intersection of at least 85 hundredths of the union.
SHARE = (85, 100)
COORDINATES = 128
MATCHES = 86
#: So many collisions are counted in the longer prefix.
COLLISIONS = 9
#: A pair is frequent if this share of the classes has it; there are at most COORDINATES / FREQUENT of them.
FREQUENT = 0.001
PREFIX = COORDINATES - MATCHES + COLLISIONS
#: Postings with more classes than this are not compared in pairs but in blocks.
PAIRED = 48
#: Classes of a block.
BLOCK = 512
#: Different shingles whose counts are multiplied at a time.
COLUMNS = 4096

_SKETCH = "doc_id bigint, fp bigint, n bigint, sig binary"


def _multipliers(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


_LOW, _HIGH = _multipliers(11)[:, None], _multipliers(12)[:, None]

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[9:14] = _IN_WORD[32] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the different word shingles of each text, ascending; none for a text without words.

    The texts lie end to end.  ASCII letters are lower-cased, words are cut at ASCII white space; fewer
    words than a shingle are one shingle.
    """
    lower = _LOWER[data]
    inside = np.concatenate((_IN_WORD[lower], [False]))
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(before & (~inside | edge[:-1]))
    words = Slices(lower).hash(starts, ends)
    first = np.searchsorted(starts, offsets).tolist()
    whole = len(words) - shingle + 1
    joined = np.zeros(max(whole, 0), np.uint64)
    for k in range(shingle):
        joined = joined * _STEP + words[k : k + whole] if whole > 0 else joined
    joined = mix(joined)
    for low, high in zip(first, first[1:]):
        if high - low >= shingle:
            yield np.unique(joined[low : high - shingle + 1])
        elif high > low:
            total = np.array([high - low], np.uint64)
            for k in range(low, high):
                total = total * _STEP + words[k]
            yield mix(total)
        else:
            yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        values = _LOW * low[at : at + 512]
        values += _HIGH * high[at : at + 512]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures (rows, COORDINATES) of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _set_hash(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.astype("<u8").tobytes())


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, n, sig) of every row: hash and size of its set, and its signature."""

    def make(batches):
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                prints = np.zeros(high - low, np.uint64)
                sizes = np.zeros(high - low, np.int64)
                signatures = np.zeros((high - low, COORDINATES), "<u4")
                for row, own in enumerate(shingle_sets(data, offsets)):
                    sizes[row] = len(own)
                    if len(own):
                        prints[row] = _set_hash(own)
                        signatures[row] = signature(own)
                yield pa.record_batch(
                    [batch.column(0).slice(low, high - low), pa.array(prints.view(np.int64)), pa.array(sizes),
                     _binary(signatures)],
                    names=["doc_id", "fp", "n", "sig"],
                )

    return _source(docs, id_column, text_column).mapInArrow(make, _SKETCH)


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(f"`{text_column}`").alias("text")
    return docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text)


def _tokens(signatures: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs (rows, COORDINATES) as numbers."""
    return signatures.astype(np.int64) | np.arange(COORDINATES, dtype=np.int64) << 32


def _frequent(classes: DataFrame):
    """Frequent coordinate-value pairs, ascending, and about how often they occur; at most 128,000 of them.

    A pair that a share of all classes has, has that share of the classes of some batch, so each
    batch gives the pairs that are frequent in it.  The counts only decide in which order pairs are posted.
    """

    def count(batches):
        for batch in batches:
            found, often = np.unique(_tokens(_matrix(batch.column(0))), return_counts=True)
            on = often >= max(2, FREQUENT * batch.num_rows)
            yield pa.record_batch([pa.array(found[on]), pa.array(often[on])], names=["token", "rows"])

    total = classes.count()
    counts = classes.select("sig").mapInArrow(count, "token bigint, rows bigint")
    counts = counts.groupBy("token").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= FREQUENT * total)
    found = counts.toArrow()
    token, rows = (found.column(c).to_numpy() for c in ("token", "rows"))
    order = np.argsort(token)
    return classes.sparkSession.sparkContext.broadcast((token[order], rows[order]))


def postings(classes: DataFrame, frequent) -> DataFrame:
    """(token, fp, n) of the prefix of every class (fp, n, sig), seldom pairs first."""

    def post(batches):
        known, often = frequent.value
        for batch in batches:
            tokens = _tokens(_matrix(batch.column(2)))
            rows = np.zeros(tokens.shape, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                rows = np.where(known[at] == tokens, often[at], 0)
            order = np.lexsort((tokens, rows), axis=1)[:, :PREFIX]
            each = pa.array(np.repeat(np.arange(len(tokens)), PREFIX))
            yield pa.record_batch(
                [
                    pa.array(np.take_along_axis(tokens, order, 1).ravel()),
                    batch.column(0).take(each), batch.column(1).take(each),
                ],
                names=["token", "fp", "n"],
            )

    return classes.select("fp", "n", "sig").mapInArrow(post, "token bigint, fp bigint, n bigint")


def _shared_postings(classes: DataFrame) -> DataFrame:
    """(token, fp, n) of shared postings, of classes that have enough of them."""
    posted = postings(classes, _frequent(classes))
    sizes = posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token")
    sizes = shared(sizes, "postings")
    members = shared(possibly_in(posted, sizes, "token").join(sizes, "token"), "members")
    spent(sizes)
    often = members.groupBy("fp").agg(F.count("*").alias("c")).where(F.col("c") >= COLLISIONS)
    kept = shared(members.join(often.select("fp"), "fp"), "members")
    spent(members)
    return kept


def _sized(members: DataFrame, *more: Column) -> DataFrame:
    """The members of postings with two or more, with the ``size`` and the ``least`` (fp, n) of each."""
    sizes = members.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("fp", "n")).alias("least"), *more)
    return members.join(sizes.where("size > 1"), "token")


def _sizes_allow(n: str, m: str) -> Column:
    """Whether sets of these sizes can have the wanted index."""
    low, high = F.least(n, m), F.greatest(n, m)
    return low * SHARE[1] >= high * SHARE[0]


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose signatures agree in enough coordinates."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    known = shared(possibly_in(classes.select("fp", "sig"), wanted, "fp"), "signatures")
    both = pairs
    for side in ("a", "b"):
        both = both.join(known.select(F.col("fp").alias(side), F.col("sig").alias(f"sig_{side}")), side)

    def merge(batches):
        for batch in batches:
            agreed = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(agreed >= MATCHES))

    close = both.select("a", "b", "sig_a", "sig_b").mapInArrow(merge, "a bigint, b bigint")
    close = shared(close, "close")
    spent(known)
    return close


def _sets(source: DataFrame) -> DataFrame:
    """(fp, own) of texts (doc_id, text): hash and shingles of their sets."""

    def make(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                sets = list(shingle_sets(data, offsets))
                prints = np.array([_set_hash(s) for s in sets], np.uint64).view(np.int64)
                own = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                yield pa.record_batch([pa.array(prints), own], names=["fp", "own"])

    return source.mapInArrow(make, "fp bigint, own binary")


def _known_sets(wanted: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """(fp, own) of the wanted classes (fp), and of some more; only their texts are read again."""
    chosen = shared(classes.join(wanted, "fp", "left_semi").select(F.col("first").alias("doc_id")), "chosen")
    sets = shared(_sets(possibly_in(source, chosen, "doc_id")).dropDuplicates(["fp"]), "sets")
    spent(chosen)
    return sets


def _linked(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have the wanted index."""
    pairs = shared(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    close = _agreeing(pairs, classes)
    sets = _known_sets(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), classes, source)
    both = close
    for side in ("b", "a"):
        needed = sets.join(close.select(F.col(side).alias("fp")).distinct(), "fp", "left_semi")
        both = both.join(needed.select(F.col("fp").alias(side), F.col("own").alias(f"own_{side}")), side)

    def confirm(batches):
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_py(), "<u8") for x in (a, b))
                common = len(np.intersect1d(one, two, assume_unique=True))
                alike.append(common * SHARE[1] >= (len(one) + len(two) - common) * SHARE[0])
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    links = both.select("a", "b", "own_a", "own_b").mapInArrow(confirm, "a bigint, b bigint")
    links = shared(links, "links")
    spent(pairs, close, sets)
    return links


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """(token, fp, n, size, root) of the postings that still have several components."""
    roots = components(links)
    placed = members.join(roots, F.col("fp") == F.col("node"), "left")
    placed = shared(placed.select("token", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
    several = _sized(placed, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = shared(several.select("token", "fp", "n", "size", "root"), "apart")
    spent(placed)
    return apart


def _side(members: DataFrame, name: str) -> DataFrame:
    return members.select("token", *[F.col(c).alias(f"{c}_{name}") for c in ("fp", "n", "root")])


def _colliding(few: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that collide often enough in these postings."""
    both = _side(few, "a").join(_side(few, "b"), "token").where("fp_a > fp_b and root_a != root_b")
    both = both.where(_sizes_allow("n_a", "n_b")).groupBy(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    return both.agg(F.count("*").alias("collisions")).where(F.col("collisions") >= COLLISIONS).select("a", "b")


class _Forest:
    """Which of some rows hang together, and the links that made it so."""

    def __init__(self, roots: np.ndarray):
        self.label = np.unique(roots, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def join(self, row: int, other: int) -> None:
        old, new = self.label[other], self.label[row]
        if old != new:
            self.label[self.label == old] = new
            self.links.append((row, other))


def _in_blocks(members: DataFrame, key: str, join: Callable[[pa.Table, _Forest], None]) -> DataFrame:
    """Links (a, b) that ``join`` finds between members (key, size, fp, root, ...) of each key.

    Each two blocks of the members of a key meet in one task; only links that join something there leave it.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    dealt = members.withColumn("_own", F.pmod(F.xxhash64("fp"), blocks)).withColumn("_other", other)
    dealt = dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})

    def compare(table: pa.Table) -> pa.Table:
        forest = _Forest(table.column("root").to_numpy())
        join(table, forest)
        fp = table.column("fp").to_numpy()
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"a": fp[links].max(axis=1, initial=-(1 << 63)), "b": fp[links].min(axis=1, initial=(1 << 63) - 1)})

    return dealt.groupBy(key, "_i", "_j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _sizes_close(n: np.ndarray, m: int) -> np.ndarray:
    return np.minimum(n, m) * SHARE[1] >= np.maximum(n, m) * SHARE[0]


def _join_agreeing(table: pa.Table, forest: _Forest) -> None:
    """Join the rows whose signatures agree in enough coordinates."""
    signatures, n = _matrix(table.column("sig")), table.column("n").to_numpy()
    for row in range(1, len(n)):
        on = np.flatnonzero(_sizes_close(n[:row], n[row]))
        while len(on := on[forest.label[on] != forest.label[row]]):
            some, on = on[:32], on[32:]
            for other in some[(signatures[some] == signatures[row]).sum(axis=1) >= MATCHES].tolist():
                forest.join(row, other)


def _join_alike(table: pa.Table, forest: _Forest) -> None:
    """Join the rows whose sets have the wanted index; common shingles are counted as a product of matrices."""
    sets = [np.frombuffer(x.as_py(), "<u8") for x in table.column("own")]
    n = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), n)
    found, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = often > 1
    place = np.cumsum(several) - 1
    on = several[column]
    rows, column = rows[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(several.sum()), COLUMNS):
        first, last = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[rows[first:last], column[first:last] - low] = 1
        common += held @ held.T
    union = n[:, None] + n[None, :] - common
    for row, other in np.argwhere(np.tril(common * SHARE[1] >= union * SHARE[0], -1)).tolist():
        forest.join(row, other)


def _linked_in_blocks(large: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components in large postings (token, fp, n, size, root).

    Classes whose signatures agree, directly or through others, are a cluster; in it sets are compared.
    """
    known = possibly_in(classes.select("fp", "sig"), large.select("fp").distinct(), "fp")
    signed = large.join(known, "fp").withColumn("root", F.col("fp"))
    agreeing = shared(_in_blocks(signed, "token", _join_agreeing), "agreeing")
    if agreeing.isEmpty():
        return agreeing
    clusters = components(agreeing).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    placed = large.select("fp", "root").distinct().join(clusters, "fp")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    sets = _known_sets(placed.select("fp"), classes, source)
    links = shared(_in_blocks(placed.join(sizes, "cluster").join(sets, "fp"), "cluster", _join_alike), "links")
    spent(agreeing, sets)
    return links


def class_links(classes: DataFrame, source: DataFrame, paired: int | None = None) -> DataFrame:
    """Links (a, b) that connect all classes (fp, n, sig, first) of the wanted index, and no others.

    Postings of more than ``paired`` classes are compared in blocks.
    """
    paired = PAIRED if paired is None else paired
    members = _shared_postings(classes)
    stars = _sized(members).where(F.col("fp") != F.col("least.fp")).where(_sizes_allow("n", "least.n"))
    stars = stars.groupBy(*_ordered("fp", "least.fp")).agg(F.count("*").alias("c"))
    links = _linked(stars.where("c > 1").select("a", "b"), classes, source)
    apart = _apart(members, links)
    links = links.unionByName(_linked(_colliding(apart.where(F.col("size") <= paired)), classes, source))
    large = apart.where(F.col("size") > paired)
    if not large.isEmpty():
        links = links.unionByName(_linked_in_blocks(large, classes, source))
    spent(members, apart)
    return links


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", paired: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if their sets of five-word shingles have an index of 85/100 or more;
    ``component_id`` is the smallest id reachable, itself included.  A null, empty or blank text has no
    shingles and is linked with nothing.  A text of fewer than five words is one shingle.  Repeated
    rows stay.  A row without an id takes the smallest id of its component, if that has any.
    """
    source = _source(docs, id_column, text_column)
    drawn = shared(sketches(source), "sketches")
    ids = drawn.select("doc_id", "fp", "n")
    first = [F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("first")]
    classes = drawn.where("n > 0").groupBy("fp").agg(*first, F.count("*").alias("rows"))
    classes = shared(classes, "classes")
    roots = components(class_links(classes, source, paired))
    rooted = classes.select("fp", "first").join(roots, F.col("fp") == F.col("node"), "left")
    rooted = shared(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = shared(rooted.join(least, "root").select("fp", "component_id"), "named")
    found = lookup(ids, named, "fp", classes.select("fp", "rows"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
