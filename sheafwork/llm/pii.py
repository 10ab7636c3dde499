"""Personal data: fixed patterns first, then contexts learned from what they find.

The base spans of four kinds come from regular expressions and checks.  They are the seeds of a
bootstrap: each seed, and each other token that looks like an identifier, is a mention with
lexical patterns around it (the word before, the two words before, the word after).  Mentions and
patterns form a graph.  In each round a pattern gets, for each kind, the share of its different
mentions that are of the kind, and a mention that is no seed gets the best share of its patterns.  A
pattern with a high share and enough seeds is trusted, and gives its kind to the mentions it holds.

A pattern that goes with several kinds is not trusted for any, so common words teach nothing.
Base spans always stay.  Everything is built from Spark's own functions, and the text is read once.
Places come from running sums, overlaps from binary searches and contexts from blocks of the text, so a
text of many matches takes time in proportion to its length, but for a logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions.binding import bind
from sheafwork.llm.tables import all_of, lookup, shared
from sheafwork.operators.outlines import running_sum

KINDS = ("email", "ip", "card", "phone")

#: Rounds of scoring, share from which a pattern is trusted, seeds it must hold, and a prior count.
ROUNDS = 3
TRUSTED = 0.75
SEEDS = 5
PRIOR = 1.0
#: Characters before and after a mention that its patterns are taken from.
CONTEXT = 48
#: Code points in a block of a text, more than ``CONTEXT``.
BLOCK = 256

# The expressions match what the plain ones do; they start where a run starts and give nothing back,
# so that a long run of signs takes no more than one pass.
_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A token that may be an identifier: it has an at sign, or digits.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

_SPAN = "struct<start:int,end:int,match:string>"


def _found(text: Column, pattern: str) -> Column:
    """Spans of all matches: the pieces between them give their places."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
    )

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
        spans = F.zip_with(
            pieces,
            running_sum(sizes),
            lambda p, end: F.struct(
                (end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match")
            ),
        )
        return F.filter(spans, lambda s: s["match"].isNotNull())

    return bind(pieces, placed)


def _count_below(ascending: Column, bound: Column) -> Column:
    """How many of the values of a sorted array are below ``bound``, by halving."""
    return F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(27, -1, -1)]),
        F.lit(0),
        lambda found, power: F.when(F.get(ascending, found + power - 1) < bound, found + power).otherwise(found),
    )


def _of_kinds(spans: Column, name: str) -> Column:
    """The starts or ends of sorted spans, an array for each kind.  Spans of one kind are disjoint, so it is sorted."""

    def of(kind: int) -> Column:
        return F.transform(F.filter(spans, lambda s: s["kind"] == kind), lambda s: s[name])

    return F.array(*[of(kind) for kind in range(len(KINDS))])


def _end_before(starts: Column, ends: Column, kind: int, bound: Column) -> Column:
    """The end of the last span of a kind that starts below ``bound``; 0 if none does."""
    of_kind = F.get(starts, F.lit(kind))
    return F.coalesce(F.get(F.get(ends, F.lit(kind)), _count_below(of_kind, bound) - 1), F.lit(0))


def _blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points, so that places in it are found without reading what is before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _block(at: Column) -> Column:
    return ((at - at % BLOCK) / BLOCK).cast("int")


def _between(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to before ``end``."""
    first, last = _block(begin), _block(end)
    head = F.coalesce(F.get(blocks, first), F.lit(""))
    tail = F.coalesce(F.get(blocks, last), F.lit(""))
    across = F.concat(
        head.substr(begin % BLOCK + 1, F.lit(BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        tail.substr(F.lit(1), end % BLOCK),
    )
    return F.when(end <= begin, "").when(first == last, head.substr(begin % BLOCK + 1, end - begin)).otherwise(across)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(digits.substr(i, F.lit(1))) - 48
        twice = (size - i) % 2 * digit
        doubled = digit + twice
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    size = F.length(_digits(match))
    if kind == "card":
        return F.when(size.between(14, 19), _luhn(_digits(match))).otherwise(False)
    return size.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds by start, then kind: structs of start, end, kind and match."""
    none = F.array().cast(f"array<{_SPAN}>")
    has_digit, has_at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    has_plus = F.contains(text, F.lit("+"))
    wanted = {"email": has_at, "ip": has_digit, "card": has_digit, "phone": has_plus}
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}

    def of(order: int, kind: str) -> Column:
        spans = F.when(wanted[kind], _found(text, patterns[kind])).otherwise(none)
        valid = F.filter(spans, lambda s: _valid(kind, s["match"]))
        return F.transform(
            valid,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"), s["match"].alias("match")
            ),
        )

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _mentions(text: Column, base: Column) -> Column:
    """Seeds, and tokens like identifiers that no seed overlaps (kind -1), with their patterns."""
    none = F.array().cast(f"array<{_SPAN}>")
    tokens = F.when(text.rlike("[0-9@]"), _found(text, _TOKEN)).otherwise(none)
    likely = F.filter(
        tokens, lambda t: (F.length(_digits(t["match"])) >= 5) | F.contains(t["match"], F.lit("@"))
    )

    def free(starts: Column, ends: Column) -> Column:
        return F.filter(
            likely,
            lambda t: all_of([_end_before(starts, ends, k, t["end"]) <= t["start"] for k in range(len(KINDS))]),
        )

    candidates = bind(_of_kinds(base, "start"), lambda starts: bind(_of_kinds(base, "end"), lambda ends: free(starts, ends)))
    loose = F.transform(
        candidates,
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(-1).alias("kind"), t["end"].alias("end"), t["match"].alias("match")
        ),
    )

    def described(m: Column, blocks: Column) -> Column:
        begin = F.greatest(m["start"] - CONTEXT, F.lit(0))
        left = F.split(F.rtrim(_between(blocks, begin, m["start"])), r"\s+")
        right = F.split(F.ltrim(_between(blocks, m["end"], m["end"] + CONTEXT)), r"\s+")
        last, first = F.lower(F.get(left, F.size(left) - 1)), F.lower(F.get(right, F.lit(0)))
        second = F.lower(F.get(left, F.size(left) - 2))
        patterns = F.filter(
            F.array(
                F.when(last != "", F.concat(F.lit("L "), last)),
                F.when(last != "", F.concat(F.lit("LL "), second, F.lit(" "), last)),
                F.when(first != "", F.concat(F.lit("R "), first)),
            ),
            lambda p: p.isNotNull(),
        )
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"),
            F.xxhash64(F.lower(m["match"])).alias("value"), patterns.alias("patterns"),
        )

    found = F.concat(base, loose)
    blocks = F.when(F.size(found) > 0, _blocks(text))
    return bind(blocks, lambda blocks: F.transform(found, lambda m: described(m, blocks)))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, share) of the trusted patterns, from (pattern, value, kind) with kind -1 for no seed.

    Each round sums over the edges per pattern, and looks the shares up for the mentions that are no
    seeds; a pattern that very many mentions have is looked up apart.
    """
    edges = shared(edges.distinct(), "edges")
    loose = edges.where("kind = -1").select("pattern", "value")
    counts = loose.groupBy("pattern").agg(F.count("*").alias("rows"))
    seeds = edges.where("kind >= 0").groupBy("pattern").agg(
        F.count_distinct("value").alias("values"),
        *[F.sum((F.col("kind") == k).cast("double")).alias(f"seeds{k}") for k in range(len(KINDS))],
    )
    # Patterns without a seed have no share to give.
    loose = shared(lookup(loose, seeds.select("pattern", F.lit(True).alias("known")), "pattern", counts).where("known").drop("known"), "loose")
    counts = loose.groupBy("pattern").agg(F.count("*").alias("rows"))
    scores = None
    patterns = None
    for turn in range(rounds):
        if scores is None:
            gained = loose.groupBy("pattern").agg(
                F.count("*").alias("more"), *[F.lit(0.0).alias(f"gain{k}") for k in range(len(KINDS))]
            )
        else:
            gained = loose.join(scores, "value").groupBy("pattern").agg(
                F.count("*").alias("more"), *[F.sum(f"score{k}").alias(f"gain{k}") for k in range(len(KINDS))]
            )
        total = F.col("values") + F.coalesce("more", F.lit(0)) + PRIOR
        patterns = shared(
            seeds.join(gained, "pattern", "left").select(
                "pattern",
                *[f"seeds{k}" for k in range(len(KINDS))],
                *[
                    ((F.col(f"seeds{k}") + F.coalesce(f"gain{k}", F.lit(0.0))) / total).alias(f"share{k}")
                    for k in range(len(KINDS))
                ],
            ),
            "patterns",
        )
        if turn + 1 < rounds:
            scores = shared(
                lookup(loose, patterns, "pattern", counts).groupBy("value").agg(
                    *[F.max(f"share{k}").alias(f"score{k}") for k in range(len(KINDS))]
                ),
                "scores",
            )
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(f"share{k}").alias("share"), F.col(f"seeds{k}").alias("seeds"))
            for k in range(len(KINDS))
        ]
    )
    best = patterns.select("pattern", F.inline(kinds)).where((F.col("share") >= TRUSTED) & (F.col("seeds") >= SEEDS))
    return best.select("pattern", "kind", "share")


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, text_hash, base, spans).

    ``base`` and ``spans`` are arrays of (start, kind, end) in code points, end exclusive, by start and
    kind; kinds are numbers of ``KINDS``.  A null text is empty and has none.  Rows with one id and one
    text have the same spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    located = source.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), base_spans(text).alias("base"))
    seen = shared(
        located.select("doc_id", "text_hash", "base", _mentions(F.col("text"), F.col("base")).alias("mentions")), "mentions"
    )
    mentions = seen.where(F.size("mentions") > 0).select("doc_id", "text_hash", F.inline("mentions"))
    edges = mentions.select(F.explode("patterns").alias("pattern"), "value", "kind")
    trusted = shared(score_patterns(edges), "trusted").groupBy("pattern").agg(F.max_by("kind", "share").alias("new_kind"))
    loose = shared(
        mentions.where("kind = -1").select("doc_id", "text_hash", "start", "end", F.explode("patterns").alias("pattern")), "loose"
    )
    counts = loose.groupBy("pattern").agg(F.count("*").alias("rows"))
    new = lookup(loose, trusted, "pattern", counts).where("new_kind is not null")
    extra = (
        new.groupBy("doc_id", "text_hash", "start", "end").agg(F.min("new_kind").alias("kind"))
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    )
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (
        seen.select("doc_id", "text_hash", plain.alias("base"))
        .join(
            extra.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
            "left",
        )
        .select(
            "doc_id", "text_hash", "base",
            F.array_sort(F.concat(F.col("base"), F.coalesce("extra", none))).alias("spans"),
        )
    )


def spans_as_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets, as ``[EMAIL]``.

    Spans that overlap are replaced by the first of them.  All columns and rows stay; null texts too.
    """
    found = find_personal_data(docs, id_column, text_column).where(F.size("spans") > 0)
    found = shared(found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("_spans")), "spans")
    found = found.withColumnsRenamed({"doc_id": "_span_id", "text_hash": "_span_hash"})
    text = F.col(f"`{text_column}`")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def masked_by(blocks: Column, starts: Column, ends: Column) -> Column:
        def before(s: Column) -> Column:
            """Where the spans that stand before this one, by start and kind, end at the furthest."""
            return F.greatest(
                *[_end_before(starts, ends, k, s["start"] + (s["kind"] > k).cast("int")) for k in range(len(KINDS))]
            )

        reached = F.transform(F.col("_spans"), lambda s: F.struct(s.alias("span"), before(s).alias("before")))
        first = F.filter(reached, lambda r: r["before"] <= r["span"]["start"])
        pieces = F.transform(
            first,
            lambda r: F.concat(_between(blocks, r["before"], r["span"]["start"]), F.get(names, r["span"]["kind"])),
        )
        rest = _between(blocks, F.array_max(F.transform(F.col("_spans"), lambda s: s["end"])), F.length(text))
        return F.array_join(F.concat(pieces, F.array(rest)), "")

    masked = bind(
        _blocks(text),
        lambda blocks: bind(
            _of_kinds(F.col("_spans"), "start"),
            lambda starts: bind(_of_kinds(F.col("_spans"), "end"), lambda ends: masked_by(blocks, starts, ends)),
        ),
    )
    joined = docs.join(
        found.hint("shuffle_hash"),
        F.col(f"`{id_column}`").cast("bigint").eqNullSafe(F.col("_span_id"))
        & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_span_hash")),
        "left",
    )
    columns = [
        F.when(F.col("_spans").isNull(), text).otherwise(masked).alias(c) if c == text_column else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return joined.select(*columns)
