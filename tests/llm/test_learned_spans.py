"""What contexts teach, on planted identifiers, and texts of many matches."""

import re

from sheafwork.llm import pii

UNIT = "call me at +1 (555) 123-4567 or u{0}@mail.example.com from 10.1.2.{1}, id 99{0}77 ok. "


def stored(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def planted():
    """Texts with seeds, identifiers that only their context shows (their spans), and numbers that are none."""
    texts, hidden = [], {}
    for i in range(120):
        word = f"w{'abcdefghij'[i % 10]}{'klmnopqr'[i % 8]}"
        texts.append(f"{word} reach us by hotline: +44 (20) 7946-{1000 + i} today {word}")
        texts.append(f"{word} e-post: person{i}@post.example.org danke {word}")
        texts.append(f"{word} part number {500000 + i} in stock {word}")
    for i in range(40):
        word = f"v{'abcdefghij'[i % 10]}"
        for lead, token, kind, tail in (
            ("reach us by hotline:", f"020-7946-{2000 + i}", "phone", "today"),
            ("e-post:", f"person{i}(at)post{10000 + i}", "email", "danke"),
        ):
            start = len(f"{word} {lead} ")
            hidden[len(texts)] = f"{kind}:{start}:{start + len(token)}"
            texts.append(f"{word} {lead} {token} {tail} {word}")
    return texts, hidden


def test_contexts_find_planted_identifiers(spark, tmp_path):
    texts, hidden = planted()
    found = pii.find_personal_data(stored(spark, tmp_path / "planted", texts))
    rows = found.select("doc_id", pii.spans_as_text("base").alias("base"), pii.spans_as_text("spans").alias("spans")).collect()
    learned = {(r.doc_id, s) for r in rows for s in set(r.spans.split(",")) - set(r.base.split(",")) if s}
    right = learned & set(hidden.items())
    assert len(right) / len(hidden) >= 0.95 and len(right) / len(learned) >= 0.95


def test_texts_of_many_matches(spark, tmp_path):
    """A megabyte of matches: spans and the masked text equal plain ones; quadratic work would not end."""
    long = "".join(UNIT.format(i, i % 256) for i in range(12000))
    docs = stored(spark, tmp_path / "long", [long, "9" * 1_000_000, "é" * 300 + " a@b.cd " + "ß" * 300, None, ""])
    plain = [
        (m.start(), m.end(), kind)
        for kind, pattern in (
            ("email", r"u\d+@mail\.example\.com"), ("ip", r"\d+\.\d+\.\d+\.\d+"), ("phone", r"\+1 \(555\) 123-4567"),
        )
        for m in re.finditer(pattern, long)
    ]
    rows = {r.doc_id: r.b for r in pii.find_personal_data(docs).select("doc_id", pii.spans_as_text("base").alias("b")).collect()}
    assert rows[0] == ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(plain))
    assert rows[1] == rows[3] == rows[4] == "" and rows[2] == "email:301:307"
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    text = re.sub(r"u\d+@mail\.example\.com", "[EMAIL]", long.replace("+1 (555) 123-4567", "[PHONE]"))
    text = re.sub(r"10\.1\.2\.\d+", "[IP]", text)
    assert re.sub(r"id \S+ ok", "id ok", masked[0]) == re.sub(r"id \S+ ok", "id ok", text)
    assert masked[1] == "9" * 1_000_000 and masked[2] == "é" * 300 + " [EMAIL] " + "ß" * 300
    assert masked[3] is None and masked[4] == ""


def test_overlapping_spans_are_masked_by_the_first(spark, tmp_path):
    """An address inside a longer match of another kind: the first takes its place, and no sign stays twice."""
    texts = ["x 1.2.3.4@h.com y", "+1 (234) 567.1.2.3 z", "4111 1111 1111 1111@h.com"]
    docs = stored(spark, tmp_path / "overlaps", texts)
    spans = {
        r.doc_id: [(s["start"], s["end"], pii.KINDS[s["kind"]]) for s in r.spans]
        for r in pii.find_personal_data(docs).collect()
    }
    assert any(len(s) > 1 for s in spans.values())
    for row in pii.redact(docs).collect():
        out, at = [], 0
        for start, end, kind in spans[row.doc_id]:
            if start >= at:
                out += [texts[row.doc_id][at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        assert row.text == "".join(out) + texts[row.doc_id][at:]
