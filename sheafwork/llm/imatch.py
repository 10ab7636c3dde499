"""Document fingerprints by I-Match, with several randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: neither so common that
they say nothing, nor so rare that an edit brings them in.  A text's distinct terms in a lexicon are
sorted and hashed together, to 64 bits.  The first hash is that of the whole lexicon.  The others are
those of randomised lexicons: ``DRAWS`` independent draws, of each the lexicons with a quarter, a 16th,
a 64th and a 256th of the terms, so a term may be in several.  Every term of the band counts, in texts of
any length, and every text has all hashes.

Two texts are compared at each share by itself: alike in the part of its draws that give both the same
hash, of those that hold a term of either, if at least half of the draws do.  The largest of these
is their likeness; 1 if the whole lexicons agree.  Lexicons with few terms of a text tell how much of it
an edit has left, those with many whether it has changed at all.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions.binding import bind
from sheafwork.llm.order import next_smaller
from sheafwork.llm.tables import shared

#: Shares of the documents between which a term is in the lexicon.
LOW, HIGH = 0.002, 0.2
#: Draws of randomised lexicons, each by eight bits of a term's hash: a lexicon of a draw has the
#: terms with so many of these bits zero.
DRAWS = 8
ZEROS = (2, 4, 6, 8)

_NOT_A_TERM = r"[^\p{L}\p{N}]+"
#: Lists that the lexicon is dealt to for look-ups.
_LISTS = 1 << 14


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words of a text."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), _NOT_A_TERM)), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(texts: DataFrame, column: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms of the band, from the exact document frequencies in all of ``texts``.

    A term of the band is in ``low`` of the texts at least, so there are at most (mean number of
    distinct terms of a text) / ``low`` of them, however many texts there are: the driver may hold
    them.  In a small table every term that is not too common is in the band.
    """
    counts = texts.select(F.explode(terms(F.col(column))).alias("term")).groupBy("term").count()
    total = texts.count()
    band = F.col("count").between(low * total, max(2.0, high * total))
    return counts.where(band).select("term").toArrow().column(0).to_pylist()


def _in_lexicon(members: list[int]):
    """A test on a term: its list is found by its hash, and searched.  The lists are one literal."""
    lists: list[list[int]] = [[] for _ in range(_LISTS)]
    for term in members:
        lists[term % _LISTS].append(term)
    table = F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")
    return lambda t: F.array_contains(F.get(table, F.pmod(t, F.lit(_LISTS)).cast("int")), t)


def fingerprint(text: Column, inside) -> Column:
    """Array of hashes, 0 for no term: the whole lexicon's, then those of each draw by falling share.

    A text without a term in the band is fingerprinted from all its terms.
    """
    found = F.transform(F.array(terms(text)), lambda t: F.struct(t.alias("t"), F.filter(t, inside).alias("b")))
    banded = F.transform(found, lambda s: F.when(F.size(s["b"]) > 0, s["b"]).otherwise(s["t"]))

    def hashes(members: Column) -> Column:
        draws = [_of_draw(members, draw, ZEROS) for draw in range(DRAWS)]
        return F.concat(F.array(_one_hash(members)), *draws)

    return F.transform(banded, lambda b: bind(F.array_sort(b), hashes))[0]


def _of_draw(members: Column, draw: int, zeros: tuple[int, ...]) -> Column:
    """Hashes of the lexicons of a draw; each is a part of the one before, and looked for there only."""
    bits = F.lit((1 << zeros[0]) - 1)
    kept = F.filter(members, lambda t: F.shiftrightunsigned(t, 8 * draw).bitwiseAND(bits) == 0)

    def further(part: Column) -> Column:
        own = F.array(_one_hash(part))
        return F.concat(own, _of_draw(part, draw, zeros[1:])) if zeros[1:] else own

    return bind(kept, further)


def _one_hash(members: Column) -> Column:
    hashed = F.xxhash64(members)
    return F.when(F.size(members) == 0, F.lit(0)).when(hashed == 0, F.lit(1)).otherwise(hashed).cast("bigint")


def as_text(print_: Column) -> Column:
    """A fingerprint as hexadecimal text, sixteen digits per lexicon."""
    return F.array_join(F.transform(print_, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1, as the module says; 1 if neither text has a term."""
    steps = len(ZEROS)
    same = F.zip_with(a, b, lambda p, q: (p == q) & (p != 0))
    held = F.zip_with(a, b, lambda p, q: (p != 0) | (q != 0))

    def share(step: int) -> Column:
        def count(flags: Column) -> Column:
            return F.size(F.filter(flags, lambda set_, i: set_ & (i > 0) & ((i - 1) % steps == step)))

        return F.when(count(held) * 2 >= DRAWS, count(same) / count(held)).otherwise(F.lit(0.0))

    shares = reduce(F.greatest, [share(step) for step in range(steps)])
    return F.when(a[0] == b[0], F.lit(1.0)).otherwise(shares)


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint every text and an edited one, and compare it with both the edit and its neighbour.

    The edited text has the last third of the characters (rounded down) replaced by as many, or
    all, of the first of the next document in descending order of ids; after the last comes
    the first.  Null texts are empty.  Of several rows with one id, the one with the largest hash of its
    text stands as the next document for others; each row is compared with its own next one.  A
    row without an id has no next document: its edited text is its text, ``near_next`` is 0.
    """
    # Under its own name an id would lose its alias in one of the two joins with the texts below,
    # and they would not share one exchange.
    source = docs.select(
        F.col(id_column).cast("bigint").alias("document"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    inside = _in_lexicon(lexicon(source))
    third = F.floor(F.length("text") / 3).cast("int")
    named = source.where("document is not null")
    ids = named.groupBy(F.col("document").alias("doc_id")).agg(
        F.max(F.xxhash64("text")).alias("chosen"), F.max(third).alias("needed")
    )
    order = shared(next_smaller(ids, "doc_id", ["needed", "chosen"]), "order")
    # Each document hands its first characters to the one it follows.  Other rows with its id hand
    # nothing; a filter would become a join key, and the two joins would not share one exchange.
    follows = order.select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.col("needed").alias("handed")
    ).join(order.select("doc_id", "chosen"), "doc_id").withColumnRenamed("doc_id", "document")
    head = F.when(F.xxhash64("text") == F.col("chosen"), F.expr("substring(text, 1, handed)"))
    heads = (
        named.join(follows.hint("shuffle_hash"), "document")
        .select(F.col("before").alias("doc_id"), head.alias("head"))
        .groupBy("doc_id").agg(F.max("head").alias("head"))
    )
    neighbours = heads.join(order.select("doc_id", "next_id"), "doc_id")
    neighbours = neighbours.withColumnRenamed("doc_id", "document")
    joined = named.join(neighbours.hint("shuffle_hash"), "document").unionByName(
        source.where("document is null").select(
            "document", "text", F.expr("right(text, cast(floor(length(text) / 3) as int))").alias("head"),
            F.lit(None).cast("bigint").alias("next_id"),
        )
    )
    kept = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))")
    edited = F.concat(kept, F.substring("head", F.lit(1), third))
    texts = joined.select(
        F.col("document").alias("doc_id"), "next_id", F.xxhash64("text").alias("text_hash"), F.length("text").cast("bigint").alias("n_chars"),
        "text", edited.alias("edited"),
    )
    printed = shared(
        texts.select(
            "doc_id", "next_id", "text_hash", "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            fingerprint(F.col("text"), inside).alias("print"),
            fingerprint(F.col("edited"), inside).alias("edited_print"),
        ),
        "prints",
    )
    chosen = (
        printed.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("next_id"))
        .agg(F.max_by("print", "text_hash").alias("next_print"))
    )
    return printed.join(chosen, "next_id", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        F.coalesce(likeness(F.col("print"), F.col("next_print")), F.lit(0.0)).alias("near_next"),
    )
