"""Base spans, their counts and their digest against plain regular expressions on the smallest test table."""

import hashlib
import re

from conftest import SMALL

from sheafwork.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def test_base_spans_equal_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_bootstrapped_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts) and list(PATTERNS) == list(pii.KINDS)
    seen = 0
    for row in rows:
        spans = []
        for order, (kind, pattern) in enumerate(PATTERNS.items()):
            found = [m for m in re.finditer(pattern, texts[row.doc_id]) if counts(kind, m[0])]
            assert row[f"n_{kind}"] == len(found)
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in found]
        listed = [s for _, _, s in sorted(spans)]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row.spans.split(","))
        seen += len(listed)
    assert seen
