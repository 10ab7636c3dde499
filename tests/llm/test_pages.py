"""Tags and attributes of web pages."""

from random import Random

from sheafwork.llm import dom, wrappers
from sheafwork.llm.tables import importable_on_workers


def text_of(html):
    return wrappers.extract(dom.parse(html), [], set())


def test_quoted_values_of_any_length():
    for size in (9999, 10000, 300000):
        value = "x>" * (size // 2)
        page = f"<article><p>one</p><div data-props='{value}'><p>two</p></div><p>three</p></article><p>out</p>"
        assert text_of(page) == "one\ntwo\nthree"
        assert text_of(f'<p>a</p><script src="{value}">var x;</script><nav title="{value}"><p>menu</p></nav><p>b</p>') == "a\nb"
    for bad in ("<a '>' ", "<a b='\">\" ", "<a \">' ", '<a href=">'):
        for end in ("", '"', "'", "<"):
            dom.parse(bad * 100000 + end)


def test_attributes_by_whole_names():
    shown = ("style='overflow:hidden'", "title='Hidden gems'", "data-id=comment-5", "data-hidden", "title='a id=menu'", "href=/x?role=menu", "lang='true'", "aria-hidden=false", "data-class = 'ad'")
    for attributes in shown:
        assert text_of(f"<article {attributes}><p>one</article>") == "one", attributes
    for attributes in ("hidden", "lang=de hidden", "HIDDEN=''", "class='ad'id=x", "title='a'class = ad", "aria-hidden=\"true\"", "id=comment-5", "data-x role=menu"):
        assert text_of(f"<div {attributes}><p>one</div><p>two") == "two", attributes


def test_template_of_each_layout(spark):
    importable_on_workers(spark)
    one = "<div><div class=x><p>Legal line</div><div class=y><p>Text %d</div></div>"
    two = "<section><div class=z><p>Other line</div><div class=y><p>Words %d</div></section>"
    pages = [one % i if i % 2 else two % i for i in range(40)] + ["", "<p>error"]
    rows = [(i, "http://two.com/", page) for i, page in enumerate(pages)]
    rows += [(100 + i, "http://small.com/", one % i if i else "<p>error") for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract_pages(frame).collect()}
    assert all(found[i] == f"{'Text' if i % 2 else 'Words'} {i}" for i in range(40))
    assert all(found[100 + i] == f"Text {i}" for i in range(1, 9)) and found[41] == found[100] == "error"


def test_places_of_all_pages(spark):
    importable_on_workers(spark)
    tags = [f"{a}><{b}" for a in ("div", "section", "article-x", "ul", "dl", "table", "center") for b in ("p", "h2", "h3", "h4", "li", "pre", "blockquote")]
    rows = []
    for layout, tag in enumerate(tags):
        begin, end = f"<{tag}>", "".join(f"</{t}>" for t in reversed(tag.split("><")))
        for i in range(6):
            page = f"<div class=top>{begin}Legal line {layout}{end}</div><div class=text><p>Text {layout}-{i}</p></div>"
            rows.append((len(rows), "http://many.com/", page))
    rows += [(1000 + i, "http://many.com/", f"<p>Plain {i}</p><div id={i}><p>Words {i}</p></div>") for i in range(600)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract_pages(frame).collect()}
    seldom = [t for t in found.values() if t.startswith("Legal")]
    assert not seldom and all(found[i] == f"Text {i // 6}-{i % 6}" for i in range(6 * len(tags)))
    assert all(found[1000 + i] == f"Plain {i}\nWords {i}" for i in range(600))


def test_tree_match_against_all_pairs(monkeypatch):
    random = Random(3)

    def forest(depth):
        grown = [dom.Slot(random.choice("abc"), forest(depth + 1) if random.random() < 0.6 - depth / 4 else []) for _ in range(random.randint(0, 5))]
        return [dom.settled(slot) for slot in grown]

    def weight(g, s):
        return 1 + size(g.children, s.children) if g.name == s.name else 0

    def size(groups, slots):
        best = [[0] * (len(slots) + 1) for _ in range(len(groups) + 1)]
        for i, g in enumerate(groups):
            for j, s in enumerate(slots):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(g, s))
        return best[-1][-1]

    for cells in (dom.CELLS, 4):
        monkeypatch.setattr(dom, "CELLS", cells)
        for _ in range(200):
            groups, slots = forest(0), forest(0)
            total, pairs = dom.tree_match(groups, slots)
            assert total == size(groups, slots) == sum(weight(groups[i], slots[j]) for i, j in pairs)
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
