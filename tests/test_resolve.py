import pytest
from conftest import rows_of

from sheafwork.operators import cascade, matching, reports, selection
from sheafwork.operators.cascade import (
    AMBIGUOUS, INVALID_GLOB, NO_SUCH_PATH, NOT_FOUND, SUCCESS, resolve, resolution_status,
)

FILES = {
    "README.md": "# r",
    "src/main.rs": "fn main() {}",
    "src/ui/view.ts": "let a = 1",
    "src/ui/deep/view.ts": "let b = 2",
    "src-old/main.rs": "fn old() {}",
    "odd[1].txt": "odd",
    "odd1.txt": "plain",
    ".hidden/x.py": "pass",
    "src/{a,b}.rs": "braces",
}

STATUSES = [
    ("src/main.rs", SUCCESS, "file", 1),
    ("./src//main.rs", SUCCESS, "file", 1),
    ("src", SUCCESS, "directory", 4),
    ("src/", SUCCESS, "directory", 4),
    ("src/ui/.", SUCCESS, "directory", 2),
    ("", SUCCESS, "directory", 9),
    (".", SUCCESS, "directory", 9),
    ("odd[1].txt", SUCCESS, "file", 1),
    ("odd[12].txt", SUCCESS, "glob", 1),
    ("src/**/*.ts", SUCCESS, "glob", 2),
    ("*", SUCCESS, "glob", 3),
    ("**/*", SUCCESS, "glob", 9),
    ("?*/*.rs", SUCCESS, "glob", 3),
    ("src/{a,b}.rs", SUCCESS, "file", 1),
    ("src/{a*", SUCCESS, "glob", 1),
    ("{a,b}.rs", NOT_FOUND, None, 0),
    ("*.zip", NOT_FOUND, None, 0),
    ("no/*.zip", NOT_FOUND, None, 0),
    ("src/**", NOT_FOUND, None, 0),
    ("src/[a", INVALID_GLOB, None, 0),
    ("a**", INVALID_GLOB, None, 0),
    ("deep", SUCCESS, "substring", 1),
    ("README", SUCCESS, "substring", 1),
    ("D", SUCCESS, "substring", 1),
    ("main", AMBIGUOUS, "substring", 2),
    # There is no such directory at the root.
    ("ui/", AMBIGUOUS, "substring", 2),
    ("i/", AMBIGUOUS, "substring", 2),
    ("readme", NOT_FOUND, None, 0),
    ("no/such", NO_SUCH_PATH, None, 0),
    ("/src", NO_SUCH_PATH, None, 0),
    ("/main", AMBIGUOUS, "substring", 2),
    ("src/main.rs/", NO_SUCH_PATH, None, 0),
    ("src/../src", NO_SUCH_PATH, None, 0),
]


@pytest.mark.parametrize("large", [False, True])
def test_status_of_every_tier(request, large, catalog_of, requests_of):
    if large:
        request.getfixturevalue("no_broadcast")
    inputs = [s[0] for s in STATUSES]
    resolution = resolve(requests_of(inputs, inputs[:3] * 3), catalog_of(FILES), "/r")
    status = resolution_status(resolution).filter("request_id = 1")
    found = {r.input: (r.status, r.tier, r.n_matches) for r in status.collect()}
    assert found == {s[0]: s[1:] for s in STATUSES}
    assert resolution_status(resolution).filter("request_id = 2").count() == 9
    tried = {r.input: r.path_tried for r in status.filter("path_tried IS NOT NULL").collect()}
    assert tried["no/such"] == "/r/no/such"
    assert tried["/src"] == "/src"
    assert set(tried) == {s[0] for s in STATUSES if s[1] == NO_SUCH_PATH}


@pytest.mark.parametrize("large", [False, True])
def test_matches_equal_brute_force(request, large, catalog_of, requests_of):
    if large:
        request.getfixturevalue("no_broadcast")
    files = {f"d{i % 4}/{w}{i}.txt": "" for i in range(60) for w in ("a", "abc-long-name-")}
    files |= {"aaaaaaaaaaaaa/aaaaaaaaaaaaa": "", "a": ""}
    substrings = ["aaa", "aaaaaaaaa", "/aaaaaaaaa", "a", "a1", "long-name-3", "d1/", "txt", "é"]
    substrings += ["/abc-long-name-11.", "d3/abc-long-name-7.txt x"]
    inputs = requests_of(substrings).select("input")
    found = rows_of(matching.match_substring(inputs, catalog_of(files)), "input", "path")
    assert found == sorted((s, p) for s in substrings for p in files if s in p)


def test_pieces_are_filtered_before_the_shuffle(no_broadcast, catalog_of, requests_of):
    """Beyond the broadcast bound the pieces pass a filter by hash in the task that cuts them."""
    inputs = requests_of(["abc-long-name-7", "*/x*.txt"]).select("input")
    catalog = catalog_of({f"d{i}/abc-long-name-{i}.txt": "" for i in range(30)} | {"d/x1.txt": ""})
    patterns = matching.rarest_pieces(matching.path_patterns(inputs), catalog)
    for tier, n in ((matching.SUBSTRING, 1), (matching.GLOB, 1)):
        found = matching.candidates(patterns, catalog, tier)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        filters = [k for k, line in enumerate(lines) if "bitmap_construct_agg" in line]
        cuts = [k for k, line in enumerate(lines) if "Generate" in line]
        assert filters and cuts and found.count() == n


def test_file_wins_over_directory_of_the_same_name(catalog_of, requests_of):
    resolution = resolve(requests_of(["a"]), catalog_of({"a": "1", "a/b": "2"}))
    assert rows_of(resolution.matches(), "tier", "path") == [("file", "a")]


def test_empty_requests_and_no_patterns(catalog_of, requests_of):
    resolution = resolve(requests_of(["src"]).limit(0), catalog_of(FILES))
    assert resolution_status(resolution).count() == 0
    assert resolution.matches().count() == 0


def test_unmatched_inputs(catalog_of, requests_of):
    requests = requests_of(["src", "zzz", "zzz"])
    matches = matching.match_directory(matching.distinct_inputs(requests), catalog_of(FILES))
    unmatched = matching.unmatched_inputs(requests, matches)
    assert rows_of(unmatched, *requests.columns) == [(1, 1, "zzz"), (1, 2, "zzz")]


@pytest.mark.parametrize("large", [False, True])
def test_keep_first_takes_the_first_input_and_then_the_first_path(
    request, large, spark, catalog_of, requests_of
):
    if large:
        request.getfixturevalue("no_broadcast")
    df = spark.createDataFrame(
        [("w/a", "k1"), ("m/a", "k1"), ("w/b", "k2"), ("w-x/b", "k2")], "p string, k string"
    )
    from sheafwork.sources.tables import table_catalog

    catalog = table_catalog(df, "p", "p", canonical_key="k")
    resolution = resolve(requests_of(["w/a", ""], [""], ["w", "w/b", "nope"]), catalog)
    assert rows_of(selection.chosen_files(resolution), "request_id", "input_ord", "path") == [
        (1, 0, "w/a"), (1, 1, "w/b"), (2, 0, "m/a"), (2, 0, "w/b"),
    ]
    assert rows_of(selection.chosen_files(resolution, passed=False), "request_id", "path") == [
        (3, "w/a"), (3, "w/b"),
    ]
    kept = selection.keep_first(resolution.matches())
    again = selection.keep_first(kept)
    assert rows_of(kept) == rows_of(again)


def test_gate_and_counts(catalog_of, requests_of):
    requests = requests_of(["src", "main"], ["src"], ["[", "zz", "z/z", "src", "zz"])
    status = resolution_status(resolve(requests, catalog_of(FILES)))
    assert rows_of(cascade.request_gate(status)) == [(1, False), (2, True), (3, False)]
    assert rows_of(cascade.outcome_counts(status)) == [
        (1, 1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0, 0), (3, 1, 0, 1, 2, 1, 0),
    ]


def test_conflict_preview_and_report(catalog_of, requests_of):
    cases = [("e", 8, None), ("f", 9, "1 more match."), ("g", 11, "3 more matches.")]
    files = {f"d/{name}{i:02}": "" for name, n, _ in cases for i in range(n)} | {"x": ""}
    requests = requests_of(*[[f"/{name}", "x"] for name, _, _ in cases], ["x"])
    resolution = resolve(requests, catalog_of(files))
    preview = reports.conflict_preview(resolution)
    assert rows_of(preview, "request_id", "match_no", "path", "n_matches", "n_more") == [
        (k, i + 1, f"d/{name}{i:02}", n, n - 8)
        for k, (name, n, _) in enumerate(cases, 1)
        for i in range(8)
    ]
    lines = (
        reports.error_report(resolution)
        .orderBy("request_id", "section_no", "input_ord", "line_no")
        .collect()
    )
    assert {r.request_id for r in lines} == {1, 2, 3}
    for k, (name, _, tail) in enumerate(cases, 1):
        expected = [
            reports.HEADING,
            f"  • Input '/{name}' matched:",
            *[f'    → "d/{name}{i:02}"' for i in range(8)],
            *([f"    → ... and {tail}"] if tail else []),
            '  ✓ "x"',
            reports.CLOSING,
        ]
        assert [r.text for r in lines if r.request_id == k] == expected


def test_report_sections(catalog_of, requests_of):
    requests = requests_of(["zz", "no/such", "[", "src/main.rs"])
    report = reports.error_report(resolve(requests, catalog_of(FILES), "/r"))
    lines = report.orderBy("request_id", "section_no", "input_ord", "line_no").collect()
    assert [(r.section, r.text) for r in lines[1:-1]] == [
        (reports.NO_SUCH_PATH_TITLE, "  • Input: 'no/such' (checked: \"/r/no/such\")"),
        (
            reports.INVALID_GLOB_TITLE,
            "  • Input: '[' (error: Pattern syntax error near position 0: invalid range pattern)",
        ),
        (reports.NOT_FOUND_TITLE, "  • Input: 'zz'"),
        (reports.RESOLVED_TITLE, '  ✓ "src/main.rs"'),
    ]


def test_ordered_candidates(catalog_of, requests_of):
    catalog = catalog_of({"a-b/x": "", "a/x": "", "a/y": ""})
    ordered = selection.ordered_candidates(resolve(requests_of(["a"], ["/"]), catalog).matches())
    assert [tuple(r) for r in ordered.collect()] == [
        (1, 0, "a/x"), (1, 0, "a/y"), (2, 0, "a/x"), (2, 0, "a/y"), (2, 0, "a-b/x"),
    ]
