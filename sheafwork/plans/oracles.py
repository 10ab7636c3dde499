"""The same results in DuckDB SQL, written the plain way: every request against every path."""

from __future__ import annotations

from sheafwork.functions.text import WHITE_SPACE
from sheafwork.operators.outlines import OPTIONAL_CLOSE, VOID_ELEMENTS
from sheafwork.plans.queries import BRACKET_LEVELS, DEPTH, PART_BYTES, ROOT

SPACE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
NEWLINE = "chr(10)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- catalogs -----------------------------------------------------------------------------------

DOCUMENTS = """documents_cat AS (
    SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, 'txt' AS ext,
           text AS content, lang
    FROM documents)"""
PAGES = """page_paths AS (
    SELECT page_id, html,
           regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://', '') AS path
    FROM pages),
pages_cat AS (
    SELECT rtrim(path, '/') || '/' || page_id || '.html' AS path,
           rtrim(regexp_replace(path, '^(www|m)\\.', ''), '/') AS canonical_key,
           'html' AS ext, html AS content
    FROM page_paths)"""
CONVERSATIONS = """conversations_cat AS (
    SELECT conv_id || '/' || printf('%03d', turn) || '-' || role || '.md' AS path,
           'md' AS ext, text AS content
    FROM conversations)"""
EVENTS = """events_cat AS (
    SELECT event_type || '/' || event_id || '.json' AS path, 'json' AS ext, props AS content
    FROM events)"""
SCRIPTS = f"""scripts_cat AS (
    SELECT source || '/' || doc_id || '.py' AS path, 'py' AS ext,
           'def doc_' || doc_id || '():' || {NEWLINE} || '    '
               || replace(text, {NEWLINE}, {NEWLINE} || '        ') AS content
    FROM documents)"""

# --- requests -----------------------------------------------------------------------------------

_UNNEST = """SELECT request_id, (generate_subscripts(inputs, 1) - 1)::INTEGER AS input_ord,
           unnest(inputs) AS input"""

MIXED_REQUESTS = f"""requests AS (
    {_UNNEST} FROM (
        SELECT doc_id AS request_id, CASE lang
            WHEN 'en' THEN [source || '/en/' || doc_id || '.txt',
                            './' || source || '/en/' || doc_id || '.txt',
                            source || '/*/' || doc_id || '.t?t', '*/en/' || doc_id || '*.txt',
                            source || '/[!d]?/' || doc_id || '.txt', 'en/' || doc_id || '.t']
            WHEN 'fr' THEN ['./' || source || '/fr/' || doc_id || '.txt', '**/' || doc_id || '.txt',
                            'fr/' || doc_id || '.', 'zzz' || doc_id]
            WHEN 'de' THEN [source || '/de/' || doc_id || '.txt', '/' || doc_id,
                            'no/such/' || doc_id]
            ELSE [source || '/' || lang || '/' || doc_id || '.txt', source || '/[' || doc_id,
                  '{{' || source || ',x}}/' || doc_id, doc_id || '.txt',
                  source || '/' || lang || '/' || doc_id || '.txt']
            END AS inputs
        FROM documents
        UNION ALL
        SELECT -1 - min(doc_id), CASE
            WHEN lang = 'en' THEN [source || '/en', './' || source || '/en/']
            ELSE [source || '/' || lang, './' || source || '/' || lang || '/',
                  'zzz' || source || '/' || lang] END
        FROM documents GROUP BY source, lang)
    UNION ALL
    SELECT -1000000000 - doc_id, 0,
           CASE WHEN lang NOT IN ('en', 'fr') THEN source || '/' || lang || '/' || doc_id || '.txt' END
    FROM documents
    UNION ALL
    SELECT -1000000000 - doc_id, 1, NULL FROM documents WHERE lang = 'de')"""
DIRECTORY_REQUESTS = f"""requests AS (
    {_UNNEST} FROM (
        SELECT min(doc_id) AS request_id, [source || '/' || lang, source] AS inputs
        FROM documents GROUP BY source, lang))"""
PAGE_REQUESTS = f"""requests AS (
    {_UNNEST} FROM (
        SELECT min(page_id) AS request_id, ['*/' || split_part(path, '/', 2) || '/*/*', ''] AS inputs
        FROM page_paths GROUP BY split_part(path, '/', 2)))"""
CONVERSATION_REQUESTS = f"""requests AS (
    {_UNNEST} FROM (
        SELECT conv_id AS request_id, [conv_id::VARCHAR] AS inputs
        FROM conversations GROUP BY conv_id))"""

# --- cascade ------------------------------------------------------------------------------------


def _catalog(name: str, key: str = "path") -> str:
    return f"cat AS (SELECT path, {key} AS canonical_key, ext, content FROM {name})"


_SLASHES = "len({0}) - len(replace({0}, '/', ''))"
GLOB_MATCH = f"""CASE
    WHEN starts_with(input, '**/') THEN ends_with('/' || path, substr(input, 3))
    ELSE path GLOB input AND {_SLASHES.format("path")} = {_SLASHES.format("input")} END"""

MATCHERS = f"""inputs AS (
    SELECT input, regexp_matches(input, '[*?\\[{{]') AS is_glob,
           contains(input, '[') AND NOT contains(input, ']') AS malformed,
           CASE WHEN NOT starts_with(input, '/')
                THEN rtrim(regexp_replace(input, '^\\./', ''), '/') END AS name
    FROM (SELECT DISTINCT input FROM requests WHERE input IS NOT NULL)),
by_file AS (
    SELECT input, 'file' AS tier, path, canonical_key
    FROM inputs JOIN cat ON path = name WHERE NOT ends_with(input, '/')),
by_directory AS (
    SELECT input, 'directory' AS tier, path, canonical_key
    FROM inputs JOIN cat ON name = '' OR starts_with(path, name || '/')),
by_glob AS (
    SELECT input, 'glob' AS tier, path, canonical_key
    FROM inputs JOIN cat ON is_glob AND NOT malformed AND {GLOB_MATCH}),
by_substring AS (
    SELECT input, 'substring' AS tier, path, canonical_key
    FROM inputs JOIN cat ON NOT is_glob AND contains(path, input))"""

CASCADE = f"""{MATCHERS},
exact AS (SELECT * FROM by_file UNION ALL SELECT * FROM by_directory),
found AS (
    SELECT * FROM exact
    UNION ALL SELECT * FROM by_glob WHERE input NOT IN (SELECT input FROM exact)
    UNION ALL SELECT * FROM by_substring WHERE input NOT IN (SELECT input FROM exact)),
counts AS (SELECT input, tier, count(*) AS n FROM found GROUP BY input, tier),
outcomes AS (
    SELECT input, tier, coalesce(n, 0) AS n_matches,
           CASE WHEN tier = 'substring' AND n > 1 THEN 'Ambiguous'
                WHEN n > 0 THEN 'Success'
                WHEN malformed THEN 'InvalidGlobPattern'
                WHEN NOT is_glob AND contains(input, '/') THEN 'PathDoesNotExist'
                ELSE 'NotFound' END AS status,
           CASE WHEN malformed THEN 'Pattern syntax error near position '
                || (strpos(input, '[') - 1) || ': invalid range pattern' END AS error
    FROM inputs LEFT JOIN counts USING (input)),
status AS (
    SELECT request_id, input_ord, input, status, tier, n_matches, error,
           CASE WHEN status = 'PathDoesNotExist' THEN
                CASE WHEN starts_with(input, '/') THEN input ELSE '{ROOT}/' || input END
           END AS path_tried
    FROM requests JOIN outcomes USING (input)
    UNION ALL
    SELECT request_id, input_ord, NULL, 'MissingInput', NULL, 0, NULL, NULL
    FROM requests WHERE input IS NULL),
gate AS (SELECT request_id, bool_and(status = 'Success') AS passed FROM status GROUP BY request_id),
matches AS (
    SELECT request_id, input_ord, input, tier, path, canonical_key
    FROM requests JOIN found USING (input)),
ranked AS (
    SELECT request_id, input_ord, path, canonical_key,
           row_number() OVER (PARTITION BY request_id, canonical_key
                              ORDER BY input_ord, string_split(path, '/')) AS place
    FROM matches JOIN status USING (request_id, input_ord) WHERE status = 'Success'),
chosen AS (SELECT request_id, input_ord, path, canonical_key FROM ranked WHERE place = 1)"""

MIXED = _with(DOCUMENTS, _catalog("documents_cat"), MIXED_REQUESTS, CASCADE)
DOCUMENT_BATCH = _with(DOCUMENTS, _catalog("documents_cat"), DIRECTORY_REQUESTS, CASCADE)
PAGE_BATCH = _with(PAGES, _catalog("pages_cat", "canonical_key"), PAGE_REQUESTS, CASCADE)
CONVERSATION_BATCH = _with(
    CONVERSATIONS, _catalog("conversations_cat"), CONVERSATION_REQUESTS, CASCADE
)


def _matcher(name: str) -> str:
    batch = _with(DOCUMENTS, _catalog("documents_cat"), MIXED_REQUESTS, MATCHERS)
    return f"{batch} SELECT input, tier, path, canonical_key FROM {name}"


CONFLICTS = """
conflicts AS (
    SELECT input, path, row_number() OVER (PARTITION BY input ORDER BY string_split(path, '/'))::INTEGER
           AS match_no
    FROM found JOIN outcomes USING (input) WHERE status = 'Ambiguous')"""

CONFLICT_PREVIEW = f"""{MIXED}, {CONFLICTS}
SELECT request_id, input_ord, input, path, match_no, n_matches, greatest(n_matches - 8, 0) AS n_more
FROM requests JOIN conflicts USING (input) JOIN outcomes USING (input) WHERE match_no <= 8"""

# The paths of the test tables hold nothing that would be escaped between the quotes.
ERROR_REPORT = f"""{MIXED}, {CONFLICTS},
resolved AS (
    SELECT request_id, input_ord, path,
           row_number() OVER (PARTITION BY request_id ORDER BY input_ord, string_split(path, '/')) AS n
    FROM chosen JOIN gate USING (request_id) WHERE NOT passed),
lines AS (
    SELECT request_id, 0 AS section_no, '' AS section, -1 AS input_ord, 0 AS line_no,
           'Could not proceed due to unresolved inputs:' AS text FROM gate WHERE NOT passed
    UNION ALL
    SELECT request_id, 1, 'The following specified paths do not exist:', input_ord, 0,
           '  • Input: ''' || input || ''' (checked: "' || path_tried || '")'
    FROM status WHERE status = 'PathDoesNotExist'
    UNION ALL
    SELECT request_id, 2, 'The following glob patterns are invalid:', input_ord, 0,
           '  • Input: ''' || input || ''' (error: ' || error || ')'
    FROM status WHERE status = 'InvalidGlobPattern'
    UNION ALL
    SELECT request_id, 3, 'The following inputs could not be found:', input_ord, 0,
           '  • Input: ''' || input || '''' FROM status WHERE status = 'NotFound'
    UNION ALL
    SELECT request_id, 4, 'The following inputs are ambiguous:', input_ord, 0,
           '  • Input ''' || input || ''' matched:' FROM status WHERE status = 'Ambiguous'
    UNION ALL
    SELECT request_id, 4, 'The following inputs are ambiguous:', input_ord, match_no,
           '    → "' || path || '"'
    FROM requests JOIN conflicts USING (input) WHERE match_no <= 8
    UNION ALL
    SELECT request_id, 4, 'The following inputs are ambiguous:', input_ord, 9,
           '    → ... and ' || (n_matches - 8) || ' more match'
           || CASE WHEN n_matches = 9 THEN '' ELSE 'es' END || '.'
    FROM status WHERE status = 'Ambiguous' AND n_matches > 8
    UNION ALL
    SELECT request_id, 5, 'The following inputs are missing:', input_ord, 0,
           '  • Input number ' || (input_ord + 1) FROM status WHERE status = 'MissingInput'
    UNION ALL
    SELECT request_id, 6, 'However, these files were successfully resolved:', input_ord, n,
           '  ✓ "' || path || '"' FROM resolved
    UNION ALL
    SELECT request_id, 7, '', -1, 0, 'Please resolve the issues above and try again.'
    FROM gate WHERE NOT passed)
SELECT request_id, section_no::INTEGER AS section_no, section, input_ord::INTEGER AS input_ord,
       line_no::BIGINT AS line_no, text
FROM lines"""

# --- bundles ------------------------------------------------------------------------------------


def _lines(text: str) -> str:
    return (
        f"(len({text}) - len(replace({text}, {NEWLINE}, ''))"
        f" + CASE WHEN {text} <> '' AND NOT ends_with({text}, {NEWLINE}) THEN 1 ELSE 0 END)"
    )


def _block(path: str, hint: str, body: str) -> str:
    return (
        f"{path} || {NEWLINE} || '```' || {hint} || {NEWLINE} || rtrim({body}, {SPACE})"
        f" || {NEWLINE} || '```' || {NEWLINE} || {NEWLINE}"
    )


def _numbered(bodies: str) -> str:
    """``bodies`` is a relation of path, hint and body."""
    return f"""bodies AS ({bodies}),
blocks AS (
    SELECT path, {_lines("body")} AS n_lines, len(body) AS n_chars,
           {_block("path", "hint", "body")} AS block
    FROM bodies),
placed AS (
    SELECT request_id, path, n_lines, n_chars, block, strlen(block) AS block_bytes,
           row_number() OVER bundle AS seq,
           sum(strlen(block)) OVER bundle - strlen(block) AS start_byte
    FROM chosen JOIN gate USING (request_id) JOIN blocks USING (path) WHERE passed
    WINDOW bundle AS (PARTITION BY request_id ORDER BY input_ord, string_split(path, '/')
                      ROWS UNBOUNDED PRECEDING))"""


CONTENT_BODIES = "SELECT path, ext AS hint, content AS body FROM cat"


def _parts(batch: str, bodies: str) -> str:
    return f"""{batch}, {_numbered(bodies)}
SELECT request_id, (start_byte // {PART_BYTES})::BIGINT AS part_no, count(*) AS n_files,
       string_agg(block, '' ORDER BY seq) AS markdown
FROM placed GROUP BY ALL"""


def _totals(batch: str, bodies: str, metric: str, unit: str) -> str:
    return f"""{batch}, {_numbered(bodies)}
SELECT request_id, count(*) AS n_files, sum({metric})::BIGINT AS total_metric, '{unit}' AS unit,
       count(*) || CASE WHEN count(*) = 1 THEN ' file, ' ELSE ' files, ' END
           || sum({metric})::BIGINT || ' {unit}' AS summary
FROM placed GROUP BY request_id"""


def _manifest(batch: str, bodies: str, label: str, metric: str, unit: str) -> str:
    return f"""{batch}, {_numbered(bodies)}
SELECT request_id, seq::BIGINT AS seq, {label} AS label, {metric}::BIGINT AS metric, '{unit}' AS unit
FROM placed"""


# --- outlines -----------------------------------------------------------------------------------

_MARKUP_TOKEN = (
    "<!--(?:.|\\n)*?-->"
    "|<(?:script|style)(?:[ \\t\\r\\n\\f/][^>]*)?>(?:.|\\n)*?</(?:script|style)[^>]*>"
    "|<[^>]*>|[^<]+"
)
_NO_LEVEL = ", ".join(f"'{name}'" for name in VOID_ELEMENTS + OPTIONAL_CLOSE)


def _nodes(docs: str) -> str:
    """``docs`` is a relation of doc_id and markup."""
    return f"""tokens AS (
    SELECT doc_id, unnest(toks) AS tok, (generate_subscripts(toks, 1) - 1)::INTEGER AS ord
    FROM (SELECT doc_id, regexp_extract_all(markup, '{_MARKUP_TOKEN}') AS toks FROM ({docs}))),
named AS (
    SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:-]*)[^>]*>$', 1)) AS name,
           NOT starts_with(tok, '<') AS is_leaf
    FROM tokens),
levels AS (
    SELECT *, sum(CASE WHEN name = '' OR name IN ({_NO_LEVEL}) OR ends_with(tok, '/>') THEN 0
                       WHEN starts_with(tok, '</') THEN -1 ELSE 1 END)
              OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS level
    FROM named),
nodes AS (
    SELECT doc_id, ord, (CASE WHEN is_leaf THEN level + 1 ELSE level END)::INTEGER AS depth,
           is_leaf, tok
    FROM levels)"""


def _joined(max_depth: int) -> str:
    return f"""SELECT doc_id, coalesce(string_agg(trim(tok, {SPACE}), ' ' ORDER BY ord)
           FILTER (WHERE is_leaf AND depth <= {max_depth + 1} AND trim(tok, {SPACE}) <> ''),
           '(No structure found)') AS outline
    FROM nodes GROUP BY doc_id"""


PAGE_DOCS = "SELECT page_id AS doc_id, html AS markup FROM pages"
PAGE_OUTLINE_BATCH = f"""{PAGE_BATCH},
{_nodes("SELECT path AS doc_id, content AS markup FROM cat")},
outlined AS ({_joined(DEPTH)})"""
OUTLINE_BODIES = "SELECT doc_id AS path, '' AS hint, outline AS body FROM outlined"

# Level 0 holds the braces, level 1 what is between them; brackets inside are not in the data.
_JSON_TOKEN = '"[^"]*"|\\p{N}+\\.\\p{N}+|[\\p{L}\\p{N}_$]+|[^\\s\\p{L}\\p{N}_$]'
EVENT_OUTLINES = f"""WITH nested AS (
    SELECT event_id, '{{"at":[{{"id":' || event_id || ',"props":' || props || '}}],"type":"'
           || event_type || '"}}' AS content
    FROM events),
tokens AS (
    SELECT event_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS ord
    FROM (SELECT event_id, regexp_extract_all(content, '{_JSON_TOKEN}') AS toks FROM nested)),
levels AS (
    SELECT *, sum(CASE WHEN tok IN ('{{', '[') THEN 1 WHEN tok IN ('}}', ']') THEN -1 ELSE 0 END)
              OVER (PARTITION BY event_id ORDER BY ord ROWS UNBOUNDED PRECEDING)
              - CASE WHEN tok IN ('{{', '[') THEN 1 ELSE 0 END AS level
    FROM tokens)
SELECT event_id AS doc_id, max_level, string_agg(tok, ' ' ORDER BY ord) AS outline
FROM levels JOIN (SELECT unnest({list(BRACKET_LEVELS)})::INTEGER AS max_level) ON level <= max_level
GROUP BY event_id, max_level"""


def _indented(docs: str) -> str:
    """Lines within level 1: those without an indent, and those that no line since has a smaller indent than."""
    return f"""SELECT path AS doc_id, string_agg(tok, ' ' ORDER BY ord) AS outline
    FROM (
        SELECT *, min(CASE WHEN width > 0 THEN width END) OVER (
            PARTITION BY path, block ORDER BY ord ROWS UNBOUNDED PRECEDING) AS least
        FROM (
            SELECT *, sum((width = 0)::INTEGER) OVER (
                PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block
            FROM (
                SELECT path, ord, trim(line, {SPACE}) AS tok, len(line) - len(ltrim(line, ' ' || chr(9))) AS width
                FROM (
                    SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS ord
                    FROM (SELECT path, string_split(content, {NEWLINE}) AS lines FROM {docs}))
                WHERE trim(line, {SPACE}) <> '')))
    WHERE width = 0 OR width = least
    GROUP BY path"""


def _fallback(docs: str) -> str:
    return f"""SELECT path, '---' || {NEWLINE} || '-- ERROR: Could not extract symbols from "' || path
        || '": Language support not configured for file extension: ''' || ext || '''' || {NEWLINE}
        || '-- Falling back to full file content.' || {NEWLINE} || '---' || {NEWLINE} || {NEWLINE}
        || content AS body
    FROM {docs}"""


_PAGE_NODES = _nodes("SELECT path AS doc_id, content AS markup FROM pages_cat")
DISPATCH = f"""{_with(DOCUMENTS, PAGES, EVENTS, SCRIPTS, _PAGE_NODES)}
SELECT doc_id AS path, outline AS body FROM ({_joined(1)})
UNION ALL
SELECT path, array_to_string(regexp_extract_all(content, '{_JSON_TOKEN}'), ' ') FROM events_cat
UNION ALL
SELECT doc_id, outline FROM ({_indented("scripts_cat")})
UNION ALL
{_fallback("documents_cat")}"""

CONTENT_OR_ERROR = f"""{_with(DOCUMENTS)}
SELECT path, hint, outlined, CASE
    WHEN lang = 'de' THEN 'Error: Could not read file content for "' || path || '".' || {NEWLINE}
        || 'Details: stream did not contain valid UTF-8'
    ELSE body END AS body
FROM (
    SELECT path, 'txt' AS hint, false AS outlined, content AS body, lang FROM documents_cat
    UNION ALL
    SELECT path, '', true, body, lang
    FROM ({_fallback("documents_cat")}) JOIN documents_cat USING (path))"""

# --- scalar functions ---------------------------------------------------------------------------

_PART_FILE = "request_id || '/' || printf('%08d', part_no) || '.md'"

TABLE_CATALOG = f"""{_with(DOCUMENTS, PAGES, CONVERSATIONS, EVENTS)}
SELECT path, canonical_key, ext, content, NULL::VARCHAR AS read_error FROM (
    SELECT path, path AS canonical_key, ext, content FROM documents_cat
    UNION ALL SELECT path, canonical_key, ext, content FROM pages_cat
    UNION ALL SELECT path, path, ext, content FROM conversations_cat
    UNION ALL SELECT path, path, ext, content FROM events_cat)"""

# An extension starts after the last dot of the last name, unless nothing is before that dot.
FILE_EXTENSION = f"""{_with(DOCUMENTS, PAGES, CONVERSATIONS, EVENTS)}
SELECT path,
       CASE WHEN contains(substr(name, 2), '.') THEN string_split(name, '.')[-1] ELSE '' END AS ext,
       CASE WHEN contains(flat, '.') THEN string_split(flat, '.')[-1] ELSE '' END AS hidden_ext
FROM (SELECT path, string_split(rtrim(path, '/'), '/')[-1] AS name, replace(path, '/', '-') AS flat
      FROM (SELECT path FROM documents_cat UNION ALL SELECT path FROM pages_cat
            UNION ALL SELECT path FROM conversations_cat UNION ALL SELECT path FROM events_cat))"""

# From the known shape of each request, not by translating its globs.
GLOB_TO_REGEX = r"""
SELECT doc_id AS request_id, input_ord::INTEGER AS input_ord,
       '\A(?:' || body || ')\z' AS regex, error
FROM (
    SELECT doc_id, 2 AS input_ord, source || '/[^/]*/' || doc_id || '\.t[^/]t' AS body, NULL AS error
    FROM documents WHERE lang = 'en'
    UNION ALL
    SELECT doc_id, 3, '[^/]*/en/' || doc_id || '[^/]*\.txt', NULL FROM documents WHERE lang = 'en'
    UNION ALL
    SELECT doc_id, 4, source || '/[^/d][^/]/' || doc_id || '\.txt', NULL
    FROM documents WHERE lang = 'en'
    UNION ALL
    SELECT doc_id, 1, '(?:[^/]+/)*' || doc_id || '\.txt', NULL FROM documents WHERE lang = 'fr'
    UNION ALL
    SELECT doc_id, 1, NULL, 'Pattern syntax error near position ' || (len(source) + 1)
        || ': invalid range pattern' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
    UNION ALL
    SELECT doc_id, 2, '\{' || source || ',x\}/' || doc_id, NULL
    FROM documents WHERE lang NOT IN ('en', 'fr', 'de'))"""

RESOLVE_ALIASES = """
WITH RECURSIVE links AS (
    SELECT DISTINCT conv_id || '/' || turn AS alias,
           CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1)
                WHEN conv_id % 5 = 0 THEN conv_id || '/1' END AS target
    FROM conversations),
known AS (SELECT * FROM links WHERE target IS NOT NULL),
walk AS (
    SELECT alias, target AS place, 1 AS hops, [alias] AS seen FROM known
    UNION ALL
    SELECT walk.alias, known.target, hops + 1, list_append(seen, known.alias)
    FROM walk JOIN known ON known.alias = walk.place
    WHERE NOT list_contains(seen, walk.place)),
ends AS (
    SELECT alias, arg_max(place, hops) AS place, max(hops) AS hops, arg_max(seen, hops) AS seen
    FROM walk GROUP BY alias)
SELECT alias,
       CASE WHEN NOT list_contains(seen, place) THEN place END AS target,
       CASE WHEN NOT list_contains(seen, place) THEN hops::BIGINT END AS hops,
       CASE WHEN list_contains(seen, place) THEN 'alias leads into a cycle' END AS error
FROM ends"""

ORACLES: dict[str, str] = {
    "file_catalog": f"""
        SELECT {_PART_FILE} AS path, {_PART_FILE} AS canonical_key, 'md' AS ext,
               strlen(markdown) AS n_bytes, NULL::VARCHAR AS read_error
        FROM ({_parts(DOCUMENT_BATCH, CONTENT_BODIES)})""",
    "file_contents": f"""
        SELECT {_PART_FILE} AS path, {_PART_FILE} AS canonical_key, 'md' AS ext,
               markdown AS content, NULL::VARCHAR AS read_error
        FROM ({_parts(DOCUMENT_BATCH, CONTENT_BODIES)})""",
    "table_catalog": TABLE_CATALOG,
    "request_batch": f"{_with(MIXED_REQUESTS)} SELECT request_id, input_ord, input FROM requests",
    "write_bundles": _parts(DOCUMENT_BATCH, CONTENT_BODIES),
    "display_path": f"""{_with(PAGES)}
        SELECT page_id, substr(path, strpos(path, '/') + 1) AS below_host, path AS elsewhere
        FROM page_paths""",
    "canonical_key": f"""{_with(PAGES)}
        SELECT page_id, rtrim(regexp_replace(path, '^(www|m)\\.', ''), '/') AS page_key,
               rtrim(path, '/') || '/x' AS path_key
        FROM page_paths""",
    "file_extension": FILE_EXTENSION,
    "is_glob": f"""{_with(MIXED_REQUESTS)}
        SELECT request_id, input_ord, contains(input, '*') OR contains(input, '?')
               OR contains(input, '[') OR contains(input, '{{') AS is_glob
        FROM requests""",
    "glob_to_regex": GLOB_TO_REGEX,
    "line_count": f"""
        SELECT doc_id, n AS n_ending,
               (len(string_split(text, {NEWLINE})) + greatest(n - 1, 0))::BIGINT AS n_lines,
               n::BIGINT AS n_bare_lines
        FROM documents, (SELECT unnest([0, 1, 2])::INTEGER AS n)""",
    "text_size": "SELECT doc_id, len(text) AS n_chars, strlen(text) AS n_bytes FROM documents",
    "trim_end": "SELECT doc_id, chr(12288) || ' ' || text AS trimmed FROM documents",
    "fence_block": f"""{_with(DOCUMENTS)}
        SELECT path, {_block("path", "ext", "content")} AS block FROM documents_cat""",
    "content_or_error": CONTENT_OR_ERROR,
    "match_direct": _matcher("by_file"),
    "match_directory": _matcher("by_directory"),
    "match_glob": _matcher("by_glob"),
    "match_substring": _matcher("by_substring"),
    "resolve_cascade": f"{MIXED} SELECT * FROM matches",
    "attach_content": f"""{DOCUMENT_BATCH}
        SELECT request_id, input_ord, path, chosen.canonical_key, content
        FROM chosen JOIN cat USING (path)""",
    "unmatched_inputs": f"""{MIXED}
        SELECT request_id, input_ord, input FROM status WHERE n_matches = 0""",
    "resolution_status": f"{MIXED} SELECT * FROM status",
    "request_gate": f"{MIXED} SELECT request_id, passed FROM gate",
    "outcome_counts": f"""{MIXED}
        SELECT request_id, count(*) FILTER (WHERE status = 'Success') AS n_success,
               count(*) FILTER (WHERE status = 'Ambiguous') AS n_ambiguous,
               count(*) FILTER (WHERE status = 'InvalidGlobPattern') AS n_invalid_glob,
               count(*) FILTER (WHERE status = 'NotFound') AS n_not_found,
               count(*) FILTER (WHERE status = 'PathDoesNotExist') AS n_path_does_not_exist,
               count(*) FILTER (WHERE status = 'MissingInput') AS n_missing_input
        FROM status GROUP BY request_id""",
    "bundle_totals": _totals(DOCUMENT_BATCH, CONTENT_BODIES, "n_lines", "lines"),
    "outline_totals": _totals(PAGE_OUTLINE_BATCH, OUTLINE_BODIES, "block_bytes", "characters"),
    "assemble_bundle": _parts(DOCUMENT_BATCH, CONTENT_BODIES),
    "conversation_bundles": _parts(CONVERSATION_BATCH, CONTENT_BODIES),
    "outline_bundles": _parts(PAGE_OUTLINE_BATCH, OUTLINE_BODIES),
    "join_tokens": f"{_with(_nodes(PAGE_DOCS))} {_joined(2)}",
    "resolve_aliases": RESOLVE_ALIASES,
    "keep_first": f"""{PAGE_BATCH} SELECT request_id, input_ord, path, canonical_key FROM chosen""",
    "manifest": _manifest(DOCUMENT_BATCH, CONTENT_BODIES, "path", "n_lines", "lines"),
    "outline_manifest": _manifest(
        PAGE_OUTLINE_BATCH,
        OUTLINE_BODIES,
        f"path || ' (skeleton only; depth={DEPTH})'",
        "n_chars",
        "characters",
    ),
    "conflict_preview": CONFLICT_PREVIEW,
    "nesting_depth": f"{_with(_nodes(PAGE_DOCS))} SELECT * FROM nodes",
    "ordered_candidates": f"""{MIXED}
        SELECT DISTINCT request_id, input_ord, path FROM matches""",
    "error_report": ERROR_REPORT,
    "outline_markup": f"{_with(_nodes(PAGE_DOCS))} {_joined(DEPTH)}",
    "outline_brackets": EVENT_OUTLINES,
    "outline_indent": f"{_with(SCRIPTS)} {_indented('scripts_cat')}",
    "outline_dispatch": DISPATCH,
}
