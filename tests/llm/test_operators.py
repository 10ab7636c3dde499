"""The operators of sheafwork.llm against plain versions on small rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafwork.llm import (
    attribution, decontaminate, dom, imatch, language, packing, pii, quality, repeats, simhash, wrappers,
)
from sheafwork.llm.components import components
from sheafwork.llm.order import next_smaller
from sheafwork.llm.tables import importable_on_workers
from sheafwork.llm.tokens import encoder, tokenizer_path

DOCS = "doc_id bigint, text string, n_words string, score string, start string, page string"
EDGE = ["", None, " \n\t", "!!!", "Of.", "Of.", "Ünder <|endoftext|> it's", "日本 words", "long " * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge texts with clashing extra columns, a repeated row, and two texts under one id."""
    importable_on_workers(spark)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = EDGE + [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(60)]
    texts += [texts[20] + " tail", texts[20], "x" + texts[21][:200], texts[22]]
    rows = [(i, t, "a", None, "b", "c") for i, t in enumerate(texts)]
    rows += [rows[12], (3, texts[30], None, None, None, None), (None, texts[31], None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_repeats_equal_brute_force(docs, none, monkeypatch):
    first = {}
    for i, t in pairs(docs):
        raw = t.encode()
        for k in range(len(raw) - 49 if i is not None else 0):
            first[raw[k : k + 50]] = min(i, first.get(raw[k : k + 50], i))
    expected = []
    for i, t in pairs(docs):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49 if i is not None else 0):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        expected.append((i, len(raw), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    for frequent in (repeats.FREQUENT_TEXTS, 1):
        monkeypatch.setattr(repeats, "FREQUENT_TEXTS", frequent)
        found = repeats.find_repeats(docs).select("doc_id", "n_bytes", "n_removed", "kept_sha256")
        assert key(map(tuple, found.collect())) == key(expected)
    assert repeats.find_repeats(none).count() == 0


def test_contamination_equals_brute_force(spark, docs, none):
    texts = [t for _, t in pairs(docs)]
    items = [(1, texts[20][:90]), (2, "w3 w4"), (3, None), (4, "..."), (5, "of"), (None, "w1"), (6, texts[25])]
    table = spark.createDataFrame(items, "item_id int, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def split(text):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for name, text in items:
        own = split(text)
        for k in range(max(1, len(own) - 9)):
            if own and name is not None:
                windows.setdefault(tuple(own[k : k + 10]), set()).add(str(name))
    expected = []
    for i, text in pairs(docs):
        own, hit, names = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in windows:
                    names |= windows[tuple(own[k : k + size])]
                    hit.update(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected.append((i, len(own), len(hit), len(names), digest, bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for size in (1 << 20, 1):
        found = decontaminate.find_contamination(docs, table, block_bytes=size).select(*columns)
        assert key(map(tuple, found.collect())) == key(expected)
    clean = decontaminate.drop_contaminated(docs, table)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not e[-1] for e in expected)
    assert decontaminate.find_contamination(none, table).count() == 0
    assert decontaminate.drop_contaminated(docs, table.limit(0)).count() == docs.count()


def test_simhash_components_equal_brute_force(spark, docs, none):
    found = simhash.near_duplicates(docs).collect()
    prints = sorted({int(r.fingerprint, 16) for r in found})
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for r in found:
        if r.doc_id is not None:
            p = top(int(r.fingerprint, 16))
            least[p] = min(least.get(p, r.doc_id), r.doc_id)
    assert len(found) == docs.count()
    assert all(r.component_id == least[top(int(r.fingerprint, 16))] for r in found)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(least.values()))
    rng = np.random.default_rng(1)
    base = [int(rng.integers(1 << 62)) for _ in range(20)]
    near = {b ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for b in base for _ in range(9)} | set(base)
    frame = spark.createDataFrame([(v,) for v in near], "fp bigint")
    groups = [
        len({r.root for r in components(simhash.linked_fingerprints(frame, paired=n)).collect()}) for n in (1, 99)
    ]
    assert groups[0] == groups[1]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}


def test_tokens_and_packing(docs, none):
    plain = Tokenizer.from_file(tokenizer_path())
    texts = EDGE[:2] + ["a  b\n\n c", "x'll 12ab ,,é\u0085²", "<|endoftext|> b"]
    texts = [t or "" for t in texts + [t for _, t in pairs(docs)]]
    ids, spans, where = encoder(tokenizer_path()).encode(texts)
    for n, text in enumerate(texts):
        one = plain.encode(text, add_special_tokens=False)
        assert one.ids == ids[where[n] : where[n + 1]].tolist()
        assert one.offsets == [tuple(s) for s in spans[where[n] : where[n + 1]].tolist()]
    rows = packing.pack_documents(docs, 64).collect()
    by_document = {}
    for i, t in pairs(docs):
        whole = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(whole) % 64 or 64, len(whole) + 1, 64)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            by_document.setdefault((i, n, a, b - a, zlib.crc32(whole[a:b].tobytes())), 0)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == set(by_document)
    places = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert places.get(r.sequence_id, 0) == r.offset
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 64
    assert len(places) >= packing.lower_bound(np.array([r.length for r in rows]), 64)
    assert packing.pack_documents(none).count() == 0


def test_sections_add_up(docs, none):
    plain = Tokenizer.from_file(tokenizer_path())
    total = sum(len(plain.encode(t, add_special_tokens=False).ids) for _, t in pairs(docs))
    for rule in attribution.RULES:
        assert attribution.section_tokens(docs, rule).agg(F.sum("n_tokens")).first()[0] == total
    bounds = attribution.line_bounds("ab\ncd")
    assert bounds.tolist() == [0, 3, 5]
    spans = np.array([[0, 2], [2, 5]])
    assert [attribution.attribute(spans, bounds, r)[0].tolist() for r in attribution.RULES] == [[0, 0], [0, 1], [0, 1]]
    assert attribution.section_tokens(none).count() == 0


def test_languages_and_quality(spark, docs, none):
    known = [(i, ["der hund und die katze", "the dog and the cat"][i % 2] * 3, ["de", "en"][i % 2]) for i in range(40)]
    model = language.fit_languages(spark.createDataFrame(known, "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, "die katze"), (2, "the cat"), (3, None), (4, " .12"), (5, "")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in language.predict_language(asked, model).collect()}
    assert [found[i].lang_pred for i in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.predict_language(docs, model).count() == docs.count()
    assert language.keep_identified(docs, model).columns == docs.columns
    assert language.predict_language(none, model).count() == 0
    measured = quality.document_statistics(docs.select("doc_id", "text"), ["doc_id", "text"])
    assert quality.score_quality(measured, None).where("score = 0.5").count() == docs.count()
    labelled = measured.withColumn("label", (F.col("doc_id") % 2).cast("int"))
    scored = quality.score_quality(measured, quality.fit_discriminant(labelled))
    assert scored.where("score between 0 and 1").count() == docs.count()


def test_fingerprints_and_order(spark, docs, none):
    rows = imatch.fingerprint_edits(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = spark.createDataFrame([(5, "abc abc"), (9, "xyz xyz xyz"), (7, None)], "doc_id bigint, text string")
    edited = {r.doc_id: r.edited_sha256 for r in imatch.fingerprint_edits(one).collect()}
    expected = {9: "xyz xyz ", 7: "", 5: "abc axy"}
    assert edited == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in expected.items()}
    assert imatch.fingerprint_edits(none).count() == 0
    ids = spark.range(0, 300, 7)
    found = {r.id: r.next_id for r in next_smaller(ids, "id", []).collect()}
    assert found == {i: (i - 7 if i else 294) for i in range(0, 300, 7)}


def test_personal_data(spark, none):
    texts = ["é a@b.c@d.e x@y.z_w@q.r", "4111 1111 1111 1111 4111 1111 1111 1112", "1.2.3.4.5 999.1.1.1", None, "", "+1 (555) 123-4567", "9" * 20000]
    texts += [f"mail me: user{i} at host{i}99999 please" for i in range(6)]
    texts += [f"word{chr(97 + i)} mail me: u{i}@h.com please" for i in range(9)]
    texts += ["10.0.0.1 0.0.0.0 000.00.0.0255 1.2.3.0256"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find_personal_data(frame)
    rows = {r.doc_id: r for r in found.select("doc_id", pii.spans_as_text(F.col("base")).alias("b"), pii.spans_as_text(F.col("spans")).alias("s")).collect()}
    assert rows[0].b == "email:2:7,email:12:17,email:17:23"
    assert rows[1].b == "" and rows[2].b == "ip:0:7" and rows[5].b == "phone:0:17"
    assert rows[3].b == rows[4].b == rows[6].b == ""
    assert all(rows[i].s.startswith("email:") and rows[i].b == "" for i in range(7, 13))
    assert rows[len(texts) - 1].b == "ip:0:8,ip:9:16,ip:17:30"
    masked = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert masked[5] == "[PHONE]" and masked[3] is None
    assert pii.find_personal_data(none).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_main_texts(spark):
    page = (
        "<html><head><title>T</title></head><body><header>Site</header><div id=menu><a href=x>Home</a></div>"
        "<div class='cookie-notice'>Cookies</div><div><h2>Title %d</h2><p>One %d &eacute; x&nbsp; y<span class=ad>BUY</span>"
        "<p>Sold by us</p><div class=comments><p>nice</div><form><p>q</form><footer>f</footer><script>x<p></script>"
    )
    rows = [(i, f"http://h.com/{i}", page % (i, i)) for i in range(12)] + [(90, None, None), (91, "x", ""), (0, "http://h.com/0", page % (0, 0))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    importable_on_workers(spark)
    found = {r.page_id: r.text for r in wrappers.extract_pages(frame).collect()}
    assert found[3] == "Title 3\nOne 3 é x y" and found[90] == found[91] == ""
    copies = spark.createDataFrame([(i, "http://c.com", "<article><p>all the same") for i in range(9)], frame.schema)
    assert {r.text for r in wrappers.extract_pages(copies).collect()} == {"all the same"}
    assert wrappers.extract_pages(frame.limit(0)).count() == 0
    for bad in ("<!--a", "<script>", "<", '<a href="', "<div>", "<p>", "</p>"):
        dom.parse(bad * 20000)
