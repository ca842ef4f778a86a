"""SQL that states what the operators on code and failures do, for checks in another engine. Only text is made here."""

from __future__ import annotations

from fathom.functions import vocabulary as V

SPACE = "[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NORMAL = "lower(regexp_replace(regexp_replace(trim(replace({p}, chr(92), '/')), '^(\\./)+', ''), '^/+|/+$', '', 'g'))"
_IS_TEST = "(contains('/' || {n} || '/', '/tests/') OR regexp_matches(regexp_extract({n}, '([^/]*)$', 1), '^(conftest\\.py|test_.*|.*_test\\.py)$'))"


def pieces(t: str) -> str:
    """The distinct identifier pieces of a text: RE2 has no lookahead, so case changes become underscores first."""
    word = f"regexp_extract_all(coalesce({t}, ''), '[A-Za-z_][A-Za-z0-9_]*')"
    cut = "regexp_replace(regexp_replace(w, '[A-Z]([0-9])', '_\\1', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
    part = f"list_transform(list_filter(string_split({cut}, '_'), lambda p: p <> ''), lambda p: regexp_extract_all(p, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))"
    return f"list_distinct(list_transform(flatten(flatten(list_transform({word}, lambda w: {part}))), lambda x: lower(x)))"


def normal(p: str) -> str:
    return _NORMAL.format(p=p)


def is_test(p: str) -> str:
    return _IS_TEST.format(n=normal(p))


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def any_of(tokens: str, values: tuple[str, ...]) -> str:
    return f"list_has_any({tokens}, {listed(values)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+$', '')"


def folder(f: str) -> str:
    return f"CASE WHEN contains({f}, '/') THEN regexp_extract({f}, '^(.*)/[^/]*$', 1) ELSE '.' END"


def first_of_case(values: str) -> str:
    """The first of values that differ only in case, in order."""
    return f"list_filter({values}, lambda x, i: list_position(list_transform({values}, lambda y: lower(y)), lower(x)) = i)"


def with_forms(t: str) -> str:
    """Tokens and their normal forms."""
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in V.NORMAL_FORMS.items()) + "}"
    return f"list_distinct(list_concat({t}, list_filter(list_transform({t}, lambda x: map_extract({table}, x)[1]), lambda x: x IS NOT NULL)))"


# resolution


def module_parts(f: str) -> str:
    q = f"list_filter(string_split(regexp_replace(replace({f}, ':', ''), '\\.[^./]*$', ''), '/'), lambda x: trim(x) NOT IN ('', '.'))"
    return f"CASE WHEN ({q})[-1] = '__init__' THEN ({q})[1:len({q}) - 1] ELSE {q} END"


def absolute(module: str, file: str) -> str:
    parts, level = f"({module_parts(file)})", f"length(regexp_extract({module}, '^(\\.*)', 1))"
    rest = f"list_filter(string_split(regexp_replace({module}, '^\\.+', ''), '.'), lambda p: p <> '')"
    package = f"(CASE WHEN regexp_matches({file}, '(^|/)__init__\\.[^/]*$') THEN {parts} ELSE {parts}[1:greatest(len({parts}) - 1, 0)] END)"
    return f"array_to_string(CASE WHEN {level} > 0 THEN list_concat({package}[1:greatest(len({package}) - greatest({level} - 1, 0), 0)], {rest}) ELSE {rest} END, '.')"


def bindings(source: str) -> str:
    """CTEs up to bind(repo, file, kind, local, target, ord) over source(repo, file_path, imports)."""
    item = "'^(\\S+)(?:\\s+as\\s+(\\S+))?$'"
    return f"""
    il AS (SELECT DISTINCT repo, replace(file_path, chr(92), '/') AS file, imports FROM {source} WHERE imports IS NOT NULL),
    il2 AS (SELECT repo, file, (i - 1)::INT AS line_no, trim(imports[i]) AS line FROM il, unnest(range(1, len(imports) + 1)) AS r(i)),
    il3 AS (SELECT *, regexp_matches(line, '^import\\s+\\S') AS plain, regexp_extract(line, '^from\\s+(\\S+)\\s+import\\s', 1) AS module FROM il2 WHERE line <> ''),
    il4 AS (SELECT repo, file, line_no, plain, module, string_split(CASE WHEN plain THEN regexp_replace(line, '^import\\s+', '') ELSE regexp_replace(regexp_replace(line, '^from\\s+\\S+\\s+import\\s+', ''), '^\\(|\\)$', '', 'g') END, ',') AS items FROM il3 WHERE plain OR module <> ''),
    il5 AS (SELECT repo, file, line_no, plain, module, (i - 1)::INT AS n, regexp_extract(trim(items[i]), {item}, 1) AS name, regexp_extract(trim(items[i]), {item}, 2) AS alias FROM il4, unnest(range(1, len(items) + 1)) AS r(i) WHERE plain OR trim(items[i]) <> ''),
    il6 AS (SELECT repo, file, CASE WHEN plain THEN 'module' ELSE 'symbol' END AS kind, CASE WHEN alias <> '' THEN alias WHEN plain THEN string_split(name, '.')[-1] ELSE name END AS local,
        CASE WHEN plain THEN name ELSE module || CASE WHEN module LIKE '%.' THEN '' ELSE '.' END || name END AS target, line_no, n FROM il5),
    bind AS (SELECT repo, file, kind, local, target, line_no * 1000 + n AS ord FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, kind, local ORDER BY line_no DESC, n DESC) AS k FROM il6) WHERE k = 1)"""


EDGES = f"""
    base AS (SELECT DISTINCT ON (id) id, coalesce(repo, '') AS repo, replace(coalesce(file_path, ''), chr(92), '/') AS file, replace(coalesce(file_path, ''), chr(92), '/') AS file_path, chunk_type, name, parent, imports, dependencies FROM code_chunks WHERE id IS NOT NULL AND name IS NOT NULL),
    {bindings("base")},
    names AS (SELECT repo, file, name AS key, id AS dst FROM base UNION SELECT repo, file, parent || '.' || name, id FROM base WHERE parent <> ''),
    deps AS (SELECT repo, file, src, parent, dep_ord, dep, list_filter(string_split(dep, '.'), lambda p: p <> '') AS parts FROM (SELECT repo, file, id AS src, parent, (i - 1)::INT AS dep_ord, trim(dependencies[i]) AS dep FROM base, unnest(range(1, len(dependencies) + 1)) AS r(i)) WHERE dep <> ''),
    modules AS (SELECT DISTINCT repo, file AS target_file, {folder("file")} AS dir, array_to_string(q[i:], '.') AS module FROM (SELECT DISTINCT repo, file, {module_parts("file")} AS q FROM base), unnest(range(1, len(q) + 1)) AS r(i)),
    anywhere AS (SELECT repo, module, min(target_file) AS target_file FROM modules GROUP BY repo, module HAVING count(*) = 1),
    beside AS (SELECT repo, module, dir, min(target_file) AS target_file FROM modules GROUP BY repo, module, dir HAVING count(*) = 1),
    bm AS (SELECT *, regexp_extract(target, '([^.]+)$', 1) AS last, {absolute("target", "file")} AS module, {absolute("regexp_replace(regexp_replace(target, '([^.])\\.[^.]+$', '\\1'), '^(\\.+)[^.]+$', '\\1')", "file")} AS package FROM bind),
    wanted AS (SELECT DISTINCT repo, file, module FROM bm UNION SELECT DISTINCT repo, file, package FROM bm),
    chosen AS (SELECT w.repo, w.file, w.module, coalesce(a.target_file, b.target_file) AS target_file FROM wanted w LEFT JOIN anywhere a ON a.repo = w.repo AND a.module = w.module LEFT JOIN beside b ON b.repo = w.repo AND b.module = w.module AND b.dir = {folder("w.file")} WHERE w.module <> '' AND coalesce(a.target_file, b.target_file) IS NOT NULL),
    heads AS (SELECT b.repo, b.file, b.local, c.target_file FROM bm b JOIN chosen c ON c.repo = b.repo AND c.file = b.file AND c.module = b.module WHERE b.kind = 'module' OR NOT EXISTS (SELECT 1 FROM bm x WHERE x.repo = b.repo AND x.file = b.file AND x.local = b.local AND x.kind = 'module')),
    members AS (SELECT DISTINCT b.repo, b.file, c.target_file FROM bm b JOIN chosen c ON c.repo = b.repo AND c.file = b.file AND c.module = b.module WHERE b.kind = 'module' OR b.last = b.local),
    froms AS (SELECT b.repo, b.file, b.local, b.last AS key, c.target_file FROM bm b JOIN chosen c ON c.repo = b.repo AND c.file = b.file AND c.module = b.package WHERE b.kind = 'symbol'),
    only_name AS (SELECT repo, key, min(dst) AS dst FROM names GROUP BY repo, key HAVING count(DISTINCT dst) = 1),
    only_method AS (SELECT repo, name AS key, min(id) AS dst FROM base WHERE chunk_type = 'method' GROUP BY repo, name HAVING count(*) = 1),
    found AS (
        SELECT d.src, d.dep_ord, d.dep, n.key AS matched_name, n.dst, 1 AS rule FROM deps d JOIN names n ON n.repo = d.repo AND n.file = d.file AND n.key = d.parent || '.' || d.parts[-1] WHERE len(d.parts) >= 2 AND d.parts[1] IN ('self', 'cls') AND d.parent <> ''
        UNION SELECT d.src, d.dep_ord, d.dep, n.key, n.dst, 2 FROM deps d JOIN heads h ON h.repo = d.repo AND h.file = d.file AND h.local = d.parts[1] JOIN names n ON n.repo = d.repo AND n.file = h.target_file AND n.key = d.parts[-1] WHERE len(d.parts) >= 2
        UNION SELECT d.src, d.dep_ord, d.dep, n.key, n.dst, 3 FROM deps d JOIN names n ON n.repo = d.repo AND n.file = d.file AND n.key = d.dep
        UNION SELECT d.src, d.dep_ord, d.dep, n.key, n.dst, 4 FROM deps d JOIN froms f ON f.repo = d.repo AND f.file = d.file AND f.local = d.dep JOIN names n ON n.repo = d.repo AND n.file = f.target_file AND n.key = f.key
        UNION SELECT src, dep_ord, dep, key, dst, 5 FROM (SELECT *, count(*) OVER (PARTITION BY src, dep_ord) AS n FROM (SELECT DISTINCT d.src, d.dep_ord, d.dep, n.key, n.dst FROM deps d JOIN members m ON m.repo = d.repo AND m.file = d.file JOIN names n ON n.repo = d.repo AND n.file = m.target_file AND n.key = d.dep)) WHERE n = 1
        UNION SELECT d.src, d.dep_ord, d.dep, d.dep, m.dst, 6 FROM deps d JOIN only_method m ON m.repo = d.repo AND m.key = d.dep
        UNION SELECT d.src, d.dep_ord, d.dep, d.dep, o.dst, 7 FROM deps d JOIN only_name o ON o.repo = d.repo AND o.key = d.dep
        UNION SELECT d.src, d.dep_ord, d.dep, d.dep, n.dst, 7 FROM deps d JOIN names n ON n.repo = d.repo AND n.key = d.dep AND {normal("n.file")} = {normal("d.file")}),
    edges AS (SELECT src, dep_ord, dep, matched_name, dst, rule FROM (SELECT *, min(rule) OVER (PARTITION BY src, dep_ord) AS first FROM found) WHERE rule = first AND src <> dst)"""


def related(results: str, queries: str, sources: int = 2, limit: int = 5, least: int = 2, per_hop: int = 10) -> str:
    """What results(query_id, chunk_id, rank) lead to within two hops, for queries(query_id, query)."""
    facts = f"facts AS (SELECT DISTINCT ON (id) id AS node, replace(file_path, chr(92), '/') AS path, chunk_type, name, coalesce(parent, '') AS parent, start_line, {is_test('file_path')} AS is_test, {folder('file_path')} AS dir FROM code_chunks WHERE id IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL)"
    words = "list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: w <> '')"

    def hop(depth: int, frontier: str, visited: str) -> str:
        score = f"""CASE WHEN f.path = s.s_path THEN 3 ELSE 0 END + CASE WHEN e.matched_name = f.name THEN 2 WHEN f.parent <> '' AND e.matched_name = f.parent || '.' || f.name THEN 1 ELSE 0 END + CASE WHEN s.s_parent <> '' AND f.parent = s.s_parent THEN 1 ELSE 0 END
            + CASE WHEN f.path <> s.s_path AND f.dir = s.s_dir THEN 1 ELSE 0 END + CASE WHEN f.path <> s.h_path AND f.dir = s.h_dir THEN 1 ELSE 0 END + {max(0, 3 - depth)}"""
        return f"""
        a{depth} AS (SELECT s.*, e.dep_ord, f.node, f.path, f.chunk_type, f.name, f.parent, f.start_line, f.dir, {score} AS score FROM {frontier} s JOIN edges e ON e.src = s.hop JOIN facts f ON f.node = e.dst
            WHERE (s.ask_tests OR NOT f.is_test) AND NOT EXISTS (SELECT 1 FROM results r WHERE r.query_id = s.query_id AND r.chunk_id = f.node) AND NOT EXISTS (SELECT 1 FROM ({visited}) v WHERE v.query_id = s.query_id AND v.source = s.source AND v.node = f.node)),
        b{depth} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, node ORDER BY score DESC, h_path, hop, dep_ord) AS k FROM a{depth}) WHERE k = 1),
        c{depth} AS (SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, path, node) AS k FROM b{depth}) WHERE k <= {per_hop})"""

    return f"""WITH {EDGES}, results AS ({results}), queries AS ({queries}), {facts},
        s0 AS (SELECT r.query_id, r.chunk_id AS source, f.path AS s_path, f.parent AS s_parent, f.dir AS s_dir, list_has_any({words}, {listed(V.TEST_QUERY_WORDS)}) AS ask_tests, r.chunk_id AS hop, f.path AS h_path, f.dir AS h_dir FROM results r JOIN queries q ON q.query_id = r.query_id JOIN facts f ON f.node = r.chunk_id WHERE r.rank <= {sources}),
        {hop(1, "s0", "SELECT query_id, source, source AS node FROM s0")},
        s1 AS (SELECT query_id, source, s_path, s_parent, s_dir, ask_tests, node AS hop, path AS h_path, dir AS h_dir FROM c1),
        {hop(2, "s1", "SELECT query_id, source, source AS node FROM s0 UNION ALL SELECT query_id, source, node FROM c1")},
        every AS (SELECT query_id, node, score, 1 AS depth, path, chunk_type, parent, name, start_line FROM c1 UNION ALL SELECT query_id, node, score, 2, path, chunk_type, parent, name, start_line FROM c2),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, depth) AS k FROM every) WHERE k = 1 AND score >= {least})
        SELECT query_id, node AS chunk_id, score::INT AS score, depth::INT AS depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, depth, path, chunk_type, parent, name, start_line, node)::INT AS rank FROM best) WHERE rank <= {limit}"""


# chunks

_OTHERS = "|".join(p for p in V.VALIDATION_PREFIXES if p != "can")
_GUARD = lambda x: f"regexp_matches(regexp_replace(lower({x}), '^_+', ''), '^(?:can(?:_|$)|(?:{_OTHERS}))')"
_NO_DEFINITIONS = "regexp_replace(src, '(?m)^[ \\t]*(?:async )?def .*$', '', 'g')"
_CALLED = "[A-Za-z_]\\w*"
_ASSIGNED = "(?:\\+=|-=|=(?:[^=]|$))"

SIGNALS = f"""
    WITH b AS (SELECT DISTINCT ON (id) * FROM code_chunks),
    c AS (SELECT id, name, chunk_type, coalesce(parent, '') AS parent, file_path, coalesce(source_code, '') AS src, list_filter(coalesce(dependencies, []), lambda x: x IS NOT NULL) AS deps, list_filter(coalesce(decorators, []), lambda x: x IS NOT NULL) AS decs FROM b),
    t AS (SELECT *, {with_forms(pieces("concat_ws(chr(10), name, parent, src, nullif(array_to_string(deps, chr(10)), ''), nullif(array_to_string(decs, chr(10)), ''))"))} AS tokens, {pieces("concat_ws(chr(10), file_path, name, parent)")} AS roles,
        list_concat(list_transform(deps, lambda d: string_split(d, '.')[-1]), regexp_extract_all({_NO_DEFINITIONS}, '\\b({_CALLED})\\s*\\(', 1)) AS called FROM c),
    s AS (SELECT *, regexp_matches(lower(src), '\\b(?:self\\.)?[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w+|\\[[^\\]]+\\])\\s*{_ASSIGNED}') OR CASE WHEN regexp_matches(lower(src), '\\b[A-Za-z_]\\w*\\s*{_ASSIGNED}') THEN {any_of("tokens", V.STATE_UPDATE_WORDS)} ELSE regexp_matches(lower(src), '\\.(?:{"|".join(V.MUTATORS)})\\s*\\(') END AS state_logic,
        {any_of("tokens", V.FILTERING_WORDS)} AND regexp_matches(lower(src), '(?s)\\bfor\\b.+\\bif\\b|\\bfilter\\s*\\(|\\bsorted\\s*\\(|\\bwhere\\b|\\bmatches\\b|>=|<=|==|!=| in | not in ') AS filter_logic FROM t)
    SELECT id, {_GUARD("name")} AS guard_name, len(list_filter(deps, lambda d: {_GUARD("string_split(d, '.')[-1]")})) > 0 OR regexp_matches({_NO_DEFINITIONS}, '\\b(?:can_[A-Za-z0-9_]*|(?:{_OTHERS})[A-Za-z0-9_]*)\\s*\\(') AS calls_guard,
        array_to_string(list_sort(list_intersect({pieces("array_to_string(called, chr(10))")}, {listed(V.PAIRED_WORDS)})), ' ') AS called_pairs, state_logic, filter_logic, {any_of("roles", V.BUSINESS_ROLES)} AS business_role,
        {any_of("roles", V.ROUTE_ROLES)} AND NOT state_logic AND NOT filter_logic AND contains(lower(src), 'return ') AND len(string_split(regexp_replace(src, '\\n\\z', ''), chr(10))) <= 20 AS route_passthrough,
        chunk_type = 'class' AND {any_of(pieces("concat_ws(chr(10), name, src)"), ("error", "exception"))} AS exception_class, len(tokens)::INT AS n_tokens
    FROM s
"""


# failures

_FILE_LINE = "File\\s+[\"'']([^\"'']+?\\.py)[\"''],\\s+line\\s+(\\d+)(?:,\\s+in\\s+([A-Za-z_]\\w*))?"
_LOCATION = "(\\S+?\\.py):(\\d+):"
_ENDS = "'\\r\\n|\\r|\\n'"
_PLACE = lambda p: f"CASE WHEN regexp_matches(x, '{p}') THEN {strip(f'''regexp_extract(x, '{p}', 1)''')} || ':' || regexp_replace(regexp_extract(x, '{p}', 2), '^0+([0-9])', '\\1') END"
_SPLIT = lambda x: f"regexp_split_to_array(regexp_replace({x}, '(\\r\\n|\\r|\\n)$', ''), {_ENDS})"
_OR = lambda x, other: f"CASE WHEN {x} = '' THEN '{other}' ELSE {x} END"
_CUT = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {rstrip(f'({x})[1:{n}]')} || '...' END"
_LIST = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, chr(10)) ELSE '<none>' END"

HINTS = f"""
    WITH f AS (SELECT DISTINCT ON (failure_id) failure_id, coalesce(test_name, '') AS test_name, coalesce(file_path, '') AS file_path, line_number, coalesce(error_type, '') AS error_type, coalesce(message, '') AS message, coalesce(traceback, '') AS traceback FROM test_failures),
    r AS (SELECT *, CASE WHEN traceback = '' THEN [] ELSE list_transform({_SPLIT("traceback")}, lambda x: {strip("x")}) END AS rows, CASE WHEN traceback = '' THEN [] ELSE list_transform({_SPLIT("traceback")}, lambda x: {rstrip("x")}) END AS right_rows, concat_ws(chr(10), test_name, error_type, message, traceback) AS whole FROM f),
    h AS (SELECT *, list_filter(flatten(list_transform(rows, lambda x: [{_PLACE(_FILE_LINE)}, {_PLACE(_LOCATION)}])), lambda x: x IS NOT NULL) AS all_hints,
        list_filter(flatten(list_transform(rows, lambda x: list_concat([nullif(regexp_extract(x, '{_FILE_LINE}', 3), ''), nullif(regexp_extract(x, '\\bin\\s+([A-Za-z_]\\w*)\\b', 1), '')], regexp_extract_all(x, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)))), lambda x: x IS NOT NULL AND NOT list_contains({listed(V.NOISY_SYMBOLS)}, lower(x))) AS all_names,
        flatten(list_transform(list_transform(regexp_extract_all(whole, '(?i)DID NOT RAISE\\s+<class\\s+''([^'']+)''>', 1), lambda x: {strip("x")}), lambda q: [string_split(q, '.')[-1], q])) AS all_expected FROM r),
    k AS (SELECT *, list_filter(all_hints, lambda x, i: list_position(list_transform(all_hints, lambda y: lower(replace(y, chr(92), '/'))), lower(replace(x, chr(92), '/'))) = i)[1:10] AS hints, ({first_of_case("all_names")})[1:12] AS symbols, {first_of_case("all_expected")} AS expected,
        CASE WHEN {strip("file_path")} = '' THEN [] ELSE [{strip("file_path")} || CASE WHEN line_number IS NULL THEN '' ELSE ':' || line_number END] END AS place,
        list_filter(right_rows, lambda x: {strip("x")} <> '' AND NOT regexp_matches({strip("x")}, '{_FILE_LINE}') AND NOT regexp_matches({strip("x")}, '{_LOCATION}')) AS told FROM h),
    m AS (SELECT *, list_concat(place, hints) AS places, array_to_string(told[greatest(len(told) - 13, 1):], chr(10)) AS tail FROM k),
    n AS (SELECT *, {first_of_case("places")} AS each_place, {_CUT("tail", 800)} AS excerpt FROM m),
    o AS (SELECT *, concat_ws(chr(10), 'Test:', {_OR(strip("test_name"), "<unknown>")}, chr(10) || 'Error:', {_OR(strip("error_type"), "<unknown>")}, chr(10) || 'Message:', {_OR(f"({_CUT(strip('message'), 400)})", "<none>")}, chr(10) || 'Traceback symbols:', {_LIST("symbols")}, chr(10) || 'Source hints:', {_LIST("each_place")}) AS parts FROM n)
    SELECT failure_id, array_to_string(symbols, ' ') AS symbols, array_to_string(hints, ' ') AS hints, array_to_string(expected, ' ') AS expected, CASE WHEN traceback = '' OR excerpt = '' THEN parts ELSE concat_ws(chr(10), parts, chr(10) || 'Traceback excerpt:', excerpt) END || chr(10) AS query FROM o
"""

_LOG = "l AS (SELECT doc_id AS log_id, generate_subscripts(s, 1)::INT AS line_no, unnest(s) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS s FROM documents WHERE text IS NOT NULL))"
_BESIDE = "(p.path = e.target OR p.path LIKE '%/' || replace(replace(e.target, '%', '\\%'), '_', '\\_') ESCAPE '\\')"

PARSED = f"""
    WITH {_LOG}, a AS (SELECT log_id, line_no, line, {strip("line")} AS s FROM l),
    b AS (SELECT log_id, line_no, regexp_extract(s, '^(\\w+) ', 1) AS outcome, {strip("regexp_replace(s, '^\\w+ ', '')")} AS rest FROM a WHERE regexp_matches(s, '^(FAILED|ERROR) ')),
    e0 AS (SELECT log_id, line_no, outcome, {strip("CASE WHEN strpos(rest, ' - ') > 0 THEN rest[1:strpos(rest, ' - ') - 1] ELSE rest END")} AS nodeid FROM b),
    e AS (SELECT *, string_split(nodeid, '::')[1] AS file_path, {normal("string_split(nodeid, '::')[1]")} AS target, regexp_replace(string_split(nodeid, '::')[-1], '\\[.*$', '') AS shown FROM (SELECT *, row_number() OVER (PARTITION BY log_id, outcome, nodeid ORDER BY line_no) AS k FROM e0 WHERE nodeid <> '') WHERE k = 1),
    p AS (SELECT log_id, line_no AS spot, {normal(strip("regexp_extract(s, '^(.*?):\\s*(\\d+)\\s*:([^:]*)$', 1)"))} AS path, regexp_extract(s, '^(.*?):\\s*(\\d+)\\s*:([^:]*)$', 2)::INT AS line_number, regexp_split_to_array({strip("regexp_extract(s, '^(.*?):\\s*(\\d+)\\s*:([^:]*)$', 3)")}, '\\s+')[1] AS error_type FROM a
        WHERE regexp_matches(s, '^(.*?):\\s*(\\d+)\\s*:([^:]*)$') AND {strip("regexp_extract(s, '^(.*?):\\s*(\\d+)\\s*:([^:]*)$', 3)")} <> ''),
    q AS (SELECT log_id, outcome, nodeid, spot, line_number, error_type FROM (SELECT e.log_id, e.outcome, e.nodeid, p.spot, p.line_number, p.error_type, row_number() OVER (PARTITION BY e.log_id, e.outcome, e.nodeid ORDER BY p.spot) AS k FROM e JOIN p ON p.log_id = e.log_id WHERE p.path <> '' AND {_BESIDE}) WHERE k = 1),
    m AS (SELECT log_id, line_no AS mark, s, length(s) >= 9 AND regexp_matches(s, '^_.*[^_\\s].*_$') AS head FROM a WHERE length(s) >= 9 AND regexp_matches(s, '^_.*[^_\\s].*_$') OR regexp_matches(s, '^=.{{8,}}=$')),
    j AS (SELECT e.log_id, e.line_no, e.outcome, e.nodeid, e.file_path, e.shown, q.spot, q.line_number, q.error_type FROM e LEFT JOIN q ON q.log_id = e.log_id AND q.outcome = e.outcome AND q.nodeid = e.nodeid),
    v AS (SELECT j.*, (SELECT max(mark) FROM m WHERE m.log_id = j.log_id AND m.head AND m.mark <= j.spot AND contains(m.s, j.shown)) AS head_at, (SELECT min(mark) FROM m WHERE m.log_id = j.log_id AND m.mark > j.spot) AS stop FROM j),
    w AS (SELECT *, CASE WHEN spot IS NULL THEN -1 ELSE coalesce(head_at, spot) END AS start FROM v),
    y AS (SELECT w.log_id, w.outcome, w.nodeid, {strip("string_agg(l.line, chr(10) ORDER BY l.line_no)")} AS traceback FROM w JOIN l ON l.log_id = w.log_id AND l.line_no >= w.start AND (w.stop IS NULL OR w.spot IS NULL OR l.line_no < w.stop) GROUP BY w.log_id, w.outcome, w.nodeid)
    SELECT w.log_id, w.line_no, w.nodeid AS test_name, w.file_path, w.line_number, w.error_type, y.traceback FROM w JOIN y ON y.log_id = w.log_id AND y.outcome = w.outcome AND y.nodeid = w.nodeid
"""


# scores

_ENDS_IN = lambda t, s: f"{t} LIKE '%{s}'"
_ROOT = lambda t, n: f"{t}[1:length({t}) - {n}]"


def _variants(t: str) -> str:
    ing, root = f"({_ENDS_IN(t, 'ing')} AND length({t}) > 5)", _ROOT(t, 3)
    double = f"length({t}) > 5 AND {t}[length({t}) - 3] = {t}[length({t}) - 4]"
    forms = [t, f"CASE WHEN {_ENDS_IN(t, 'ies')} AND length({t}) > 4 THEN {root} || 'y' END", f"CASE WHEN {ing} THEN {root} END", f"CASE WHEN {ing} THEN {root} || 'e' END", f"CASE WHEN {ing} AND {double} THEN {_ROOT(t, 4)} END", f"CASE WHEN {_ENDS_IN(t, 'ed')} AND length({t}) > 4 THEN {_ROOT(t, 2)} END", f"CASE WHEN {_ENDS_IN(t, 's')} AND length({t}) > 3 THEN {_ROOT(t, 1)} END"]
    return "list_filter([" + ", ".join(forms) + "], lambda v: v IS NOT NULL)"


def _kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: length(w) > 1 AND NOT list_contains({listed(V.INVESTIGATION_STOP_WORDS)}, w))"


def meaningful(text: str) -> str:
    """Identifier tokens and their stems without stop words."""
    return _kept(f"list_distinct(flatten(list_transform({pieces(text)}, lambda t: {_variants('t')})))")


def displayed(text: str) -> str:
    return _kept(pieces(text))


def _display_variants(t: str) -> str:
    plural = f"({_ENDS_IN(t, 's')} AND length({t}) > 3)"
    forms = [t, f"CASE WHEN {plural} THEN {_ROOT(t, 1)} ELSE {t} || 's' END", f"CASE WHEN {_ENDS_IN(t, 'y')} AND length({t}) > 2 THEN {_ROOT(t, 1)} || 'ies' END", f"CASE WHEN {_ENDS_IN(t, 'ies')} AND length({t}) > 4 THEN {_ROOT(t, 3)} || 'y' END"]
    return "list_filter([" + ", ".join(forms) + "], lambda v: v IS NOT NULL)"


def counterparts(tokens: str) -> str:
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in V.COUNTERPARTS.items()) + "}"
    return f"list_distinct(list_transform({tokens}, lambda t: map_extract({table}, t)[1]))"


_BARE = lambda x: f"lower(regexp_replace({x}, '^_+', ''))"
_LAST = "string_split(d, '.')[-1]"
_PARTS = "list_filter(string_split(d, '.'), lambda p: p <> '')"

# what scores ask of a chunk alone
FACTS = f"""
    b AS (SELECT DISTINCT ON (id) * FROM code_chunks WHERE id IS NOT NULL),
    c AS (SELECT id, name, chunk_type, coalesce(parent, '') AS parent, file_path, start_line, coalesce(source_code, '') AS src, list_filter(coalesce(dependencies, []), lambda x: x IS NOT NULL) AS deps, list_filter(coalesce(decorators, []), lambda x: x IS NOT NULL) AS decs FROM b),
    g AS (SELECT *, {is_test("file_path")} AS is_test, {normal("file_path")} AS path_key, chunk_type IN ('function', 'method') AS is_function, {pieces("name")} AS name_terms, {pieces("parent")} AS parent_terms, {pieces("regexp_replace(regexp_extract(replace(file_path, chr(92), '/'), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')")} AS stem_terms,
        {_GUARD("name")} AS guard_name, len(list_filter(deps, lambda d: {_GUARD(_LAST)})) > 0 OR regexp_matches({_NO_DEFINITIONS}, '\\b(?:can_[A-Za-z0-9_]*|(?:{_OTHERS})[A-Za-z0-9_]*)\\s*\\(') AS calls_guard,
        list_intersect({pieces(f"array_to_string(list_concat(list_transform(deps, lambda d: {_LAST}), regexp_extract_all({_NO_DEFINITIONS}, '\\b({_CALLED})\\s*\\(', 1)), chr(10))")}, {listed(V.PAIRED_WORDS)}) AS called_pairs,
        chunk_type IN ('function', 'method') AND regexp_matches({_BARE("name")}, '^(?:{"|".join(V.PAIRED_WORDS)})') AS defines_pair FROM c)"""

_WORDS = "concat_ws(chr(10), name, parent, file_path, src, nullif(array_to_string(deps, chr(10)), ''), nullif(array_to_string(decs, chr(10)), ''))"

INVESTIGATION = f"""
    WITH {FACTS},
    f AS (SELECT *, {meaningful(_WORDS)} AS terms, {displayed(_WORDS)} AS shown_terms, regexp_matches(src, '\\bif\\b|\\bfor\\b|\\bsorted\\s*\\(|\\bfilter\\s*\\(|[<>]=?|==|!=') AS compares, regexp_matches(src, '\\b(?:self|cls|[A-Za-z_]\\w*)\\.[A-Za-z_]\\w*\\s*(?:[+*/-]?=)') AS changes FROM g),
    q AS (SELECT query_id, {meaningful("query")} AS q_terms, {displayed("query")} AS q_shown FROM (SELECT query_id, min(query) AS query FROM investigation_results WHERE query IS NOT NULL GROUP BY query_id)),
    p AS (SELECT query_id, chunk_id, max(score) AS base FROM investigation_results WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id),
    x AS (SELECT *, len(list_intersect(q_terms, terms)) AS n, list_intersect(q_terms, terms) AS matched, list_sort(list_intersect(q_shown, flatten(list_transform(shown_terms, lambda t: {_display_variants("t")}))))[1:4] AS shown, is_function AND NOT regexp_matches(name, '^__.*__$') AND NOT is_test AS works, list_concat(parent_terms, stem_terms) AS places FROM p JOIN q USING (query_id) JOIN f ON f.id = p.chunk_id),
    y AS (SELECT *, works AND {any_of("places", V.INVESTIGATION_ROLES)} AND (n > 0 OR compares) AS business, works AND {any_of("q_terms", V.INVESTIGATION_FILTERING)} AND {any_of("terms", V.INVESTIGATION_FILTERING)} AND compares AS filtering,
        list_has_any(q_terms, list_concat(called_pairs, list_intersect(name_terms, {listed(V.INVESTIGATION_STATE)}))) AS calls,
        NOT is_test AND (guard_name OR calls_guard OR regexp_matches({_BARE("name")}, '^(?:{"|".join(V.INVESTIGATION_VALIDATION_PREFIXES)})')) AS validation,
        len(list_filter(deps, lambda d: len({_PARTS}) > 0 AND list_has_any({pieces(f"({_PARTS})[-1]")}, called_pairs) AND (len({_PARTS}) = 1 OR NOT {any_of(pieces(f"({_PARTS})[1]"), V.IGNORED_CALL_HEADS)}))) > 0 AS domain_call FROM x),
    z AS (SELECT *, works AND {any_of("q_terms", V.INVESTIGATION_STATE)} AND {any_of("terms", V.INVESTIGATION_STATE)} AND (changes OR len(called_pairs) > 0 AND calls) AS state,
        CASE WHEN works AND len(called_pairs) > 0 AND (list_has_any(q_terms, list_concat(called_pairs, {counterparts("called_pairs")})) OR domain_call AND calls) THEN 'possible missing counterpart operation'
            WHEN works AND defines_pair AND changes AND list_has_any(q_terms, list_concat(name_terms, terms)) THEN 'paired state operation' END AS paired,
        NOT is_test AND {any_of("places", V.INVESTIGATION_DATA_ACCESS)} AND {any_of("name_terms", V.GENERIC_DATA_ACCESS_NAMES)} AND NOT {any_of("q_terms", V.STORAGE_QUERY_WORDS)} AS access,
        NOT is_test AND chunk_type = 'class' AND NOT {any_of("matched", V.INVESTIGATION_FILTERING + V.INVESTIGATION_STATE)} AS vague FROM y)
    SELECT query_id, chunk_id, round(base + CASE WHEN is_test THEN -1.25 ELSE 0.25 END + least(1.2, n * 0.12) + CASE WHEN business THEN 0.7 ELSE 0 END + CASE WHEN filtering THEN 0.65 ELSE 0 END + CASE WHEN state THEN 0.6 ELSE 0 END + CASE WHEN validation THEN 0.55 ELSE 0 END + CASE WHEN paired IS NOT NULL THEN 0.45 ELSE 0 END - CASE WHEN access THEN 0.5 ELSE 0 END - CASE WHEN vague THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score,
        array_to_string(list_filter(['semantic match', CASE WHEN is_test THEN 'test context' END, CASE WHEN len(shown) > 0 THEN 'operation match: ' || array_to_string(shown, ', ') END, CASE WHEN business THEN 'business operation' END, CASE WHEN filtering THEN 'filtering logic' END, CASE WHEN state THEN 'state update logic' END, CASE WHEN validation THEN 'validation logic' END, paired, CASE WHEN access THEN 'data-access context' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM z
"""

_TEXT = "concat_ws(chr(10), name, parent, src, nullif(array_to_string(deps, chr(10)), ''), nullif(array_to_string(decs, chr(10)), ''))"
_W = V.FAILURE_WEIGHTS
_SUM = lambda *parts: "(" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for _, c, v in parts) + ")"
_NAMES = lambda *parts: "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in parts) + "]"
_ANY = lambda values, name, test: f"len(list_filter({values}, lambda {name}: {test})) > 0"

_HEAD = (("contains_expected_exception", "x_in_text", _W["contains_expected_exception"]), ("expected_exception_definition", "x_defines", _W["expected_exception_definition"]))
_WEAK = tuple((n, f"len(list_intersect({c}, tokens)) > 0", f"least({V.OVERLAP_WEIGHTS[n][1]}, len(list_intersect({c}, tokens)) * {V.OVERLAP_WEIGHTS[n][0]})") for n, c in (("exception_symbol_overlap", "exception_symbols"), ("behavioral_keyword_overlap", "behavioral"), ("operation_keyword_overlap", "operation"), ("domain_keyword_overlap", "domain")))
_OPERATION = ("business_operation", f"usable AND list_has_any(list_concat(name_terms, parent_terms), action_terms) AND (business_role OR state_logic OR filter_logic)", _W["business_operation"])
_PAIRED = f"usable AND pair_context AND len(called_pairs) > 0 AND (list_has_any(list_concat(called_pairs, {counterparts('called_pairs')}), meaningful) OR list_has_any(name_terms, action_terms))"
_BUSINESS = (
    _OPERATION, ("state_update_logic", "usable AND state_logic AND shared", _W["state_update_logic"]), ("paired_state_operation", _PAIRED, _W["paired_state_operation"]), ("possible_missing_counterpart_operation", _PAIRED, _W["possible_missing_counterpart_operation"]),
    ("filtering_logic", "is_function AND filter_logic AND shared AND NOT constructor", _W["filtering_logic"]), ("generic_crud_or_data_access_penalty", "is_function AND business_context AND data_access", _W["generic_crud_or_data_access_penalty"]),
    ("route_or_controller_passthrough_penalty", "is_function AND business_context AND route_passthrough", _W["route_or_controller_passthrough_penalty"]), ("constructor_or_init_penalty", "is_function AND business_context AND constructor", _W["constructor_or_init_penalty"]),
    ("single_paired_operation_penalty", "is_function AND business_context AND pair_context AND defines_pair AND len(called_pairs) = 0 AND NOT business_role AND state_logic", _W["single_paired_operation_penalty"]),
    ("unrelated_exception_class_penalty", "chunk_type = 'class' AND business_context AND exception_class AND NOT x_defines AND NOT x_in_text", _W["unrelated_exception_class_penalty"]),
)
_GUARDS = (
    ("raises_expected_exception", "x_raises", 2.5), ("validation_raise_logic", "NOT x_raises AND has_raise AND relevant", 0.5), ("generic_raise_statement", "NOT x_raises AND has_raise AND NOT relevant", 0.1), ("validation_raise_logic", "x_in_source AND validation_text", 1.0),
    ("validation_helper_name", "guard_name", "CASE WHEN x_in_source OR relevant THEN 0.9 ELSE 0.2 END"), ("calls_validation_helper", "x_guard_call OR calls_guard", "CASE WHEN x_guard_call THEN 0.8 ELSE 0.15 END"),
    ("validation_raise_logic", "validation_text AND x_in_source", 0.25), ("validation_signal_overlap", "validation_text AND NOT x_in_source", "CASE WHEN relevant THEN 0.25 ELSE 0.1 END"),
)
_STRONG = "(x_defines OR x_raises OR x_in_source OR guard_name AND relevant OR x_guard_call)"
_SPECIFIC = (("specific_source_chunk_boost", f"{_STRONG} AND is_function", 0.2),)
_OWN = (
    ("semantic_base_score", "true", "base"), ("test_chunk_penalty", "is_test", _W["test_chunk_penalty"]), ("source_chunk_boost", "NOT is_test", _W["source_chunk_boost"]), ("message_symbol_match", "list_contains(message_symbols, name)", _W["message_symbol_match"]), ("traceback_symbol_match", "list_contains(symbols, name)", _W["traceback_symbol_match"]),
    ("same_file_source_hint", _ANY("hint_files", "h", "path_key = h OR ends_with(path_key, '/' || h)"), _W["same_file_source_hint"]), ("same_directory_source_hint", _ANY("hint_folders", "h", "starts_with(path_key, h || '/')"), _W["same_directory_source_hint"]),
)
_SILENT = (
    ("validation_helper_name", "guard_name AND NOT did_not_raise", 0), ("calls_validation_helper", "calls_guard AND NOT did_not_raise", 0), ("generic_crud_or_data_access_penalty", "data_access", 0),
    ("source_first_selection_signal", "NOT is_test AND (list_contains(message_symbols, name) OR list_contains(symbols, name) OR x_defines OR x_raises OR x_in_text OR relevant OR guard_name OR x_guard_call OR calls_guard AND list_has_any(tokens, signal_words) OR has_raise AND validation_text)", 0),
)
_ACTION = f"list_concat(operation, list_concat(behavioral, {listed(V.FILTERING_WORDS + V.STATE_UPDATE_WORDS)}))"
_STATES = listed(tuple(dict.fromkeys(V.PAIRED_WORDS + V.STATE_CONTEXT_WORDS + V.STATE_CHANGE_WORDS)))

FAILURE_SCORES = f"""
    WITH {HINTS.strip().removeprefix("WITH ").rsplit("SELECT failure_id, array_to_string", 1)[0].rstrip()},
    {FACTS.replace(" b AS (", " cb AS (").replace("FROM b)", "FROM cb)").replace(" c AS (", " cc AS (").replace("FROM c)", "FROM cc)").replace(" g AS (", " cg AS (")},
    s1 AS (SELECT failure_id, symbols, hints, expected, regexp_matches(whole, '(?i)DID NOT RAISE\\s+<class\\s+''([^'']+)''>') AS did_not_raise, {with_forms(pieces("whole"))} AS f_tokens, list_distinct(list_transform(expected, lambda e: string_split(e, '.')[-1])) AS expected_short, {with_forms(pieces("array_to_string(expected, chr(10))"))} AS exception_symbols,
        {pieces("concat_ws(chr(10), test_name, file_path, error_type, message)")} AS primary_terms, regexp_extract_all(message, '\\b([A-Za-z_]\\w*)\\s*\\(', 1) AS message_symbols, list_filter(list_transform(hints, lambda x: {normal(f"regexp_extract({strip('x')}, '^(.+?\\.py)(?::\\d+)?$', 1)")}), lambda x: x <> '' AND NOT {is_test("x")}) AS hint_files FROM o),
    s2 AS (SELECT *, list_filter({pieces("array_to_string(expected_short, chr(10))")}, lambda x: x NOT IN ('error', 'exception', 'invalid')) AS exception_terms, list_intersect(f_tokens, {listed(V.BEHAVIORAL_WORDS)}) AS behavioral, list_intersect(f_tokens, {listed(V.OPERATION_WORDS)}) AS operation,
        list_filter(f_tokens, lambda w: length(w) > 2 AND NOT list_contains({listed(V.DOMAIN_STOP_WORDS)}, w)) AS domain, list_filter(list_transform(hint_files, lambda x: regexp_extract(x, '^(.*)/[^/]*$', 1)), lambda x: x <> '') AS hint_folders FROM s1),
    s3 AS (SELECT *, list_concat(operation, list_concat(behavioral, domain)) AS signal_words FROM s2),
    s4 AS (SELECT *, list_filter(list_concat(primary_terms, signal_words), lambda w: NOT list_contains({listed(V.MEANINGLESS_FAILURE_WORDS)}, w)) AS meaningful, list_intersect(primary_terms, {_ACTION}) AS action_terms, NOT did_not_raise AND list_has_any(list_concat(signal_words, primary_terms), {_STATES}) AS pair_context FROM s3),
    fail AS (SELECT *, list_has_any(meaningful, {_ACTION}) AS business_context FROM s4),
    d1 AS (SELECT *, {with_forms(pieces(_TEXT))} AS tokens, lower({_TEXT}) AS signal_text, {pieces("concat_ws(chr(10), file_path, name, parent)")} AS roles, {pieces("array_to_string(list_filter(list_concat(list_transform(deps, lambda d: " + _LAST + "), regexp_extract_all(src, '\\b(" + _CALLED + ")\\s*\\(', 1)), lambda d: " + _GUARD("d") + "), chr(10))")} AS guard_call_terms,
        regexp_matches(src, '(?i)\\braise\\b') AS has_raise, lower(name) IN ('__init__', 'init', 'initialize') AS constructor,
        (list_has_any(string_split(path_key, '/'), {listed(V.DATA_ACCESS_FOLDERS)}) OR regexp_matches(lower(parent), '{"|".join(V.DATA_ACCESS_PARENTS)}')) AND regexp_matches({_BARE("name")}, '^(?:{"|".join(V.CRUD_PREFIXES)})(?:_|$)') AS data_access FROM cg),
    d2 AS (SELECT *, regexp_matches(lower(src), '\\b(?:self\\.)?[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w+|\\[[^\\]]+\\])\\s*{_ASSIGNED}') OR CASE WHEN regexp_matches(lower(src), '\\b[A-Za-z_]\\w*\\s*{_ASSIGNED}') THEN {any_of("tokens", V.STATE_UPDATE_WORDS)} ELSE regexp_matches(lower(src), '\\.(?:{"|".join(V.MUTATORS)})\\s*\\(') END AS state_logic,
        {any_of("tokens", V.FILTERING_WORDS)} AND regexp_matches(lower(src), '(?s)\\bfor\\b.+\\bif\\b|\\bfilter\\s*\\(|\\bsorted\\s*\\(|\\bwhere\\b|\\bmatches\\b|>=|<=|==|!=| in | not in ') AS filter_logic, {any_of("roles", V.BUSINESS_ROLES)} AS business_role, {any_of("tokens", V.VALIDATION_WORDS)} AS validation_text,
        chunk_type = 'class' AND {any_of(pieces("concat_ws(chr(10), name, src)"), ("error", "exception"))} AS exception_class FROM d1),
    code AS (SELECT *, {any_of("roles", V.ROUTE_ROLES)} AND NOT state_logic AND NOT filter_logic AND contains(lower(src), 'return ') AND len(string_split(regexp_replace(src, '\\n\\z', ''), chr(10))) <= 20 AS route_passthrough FROM d2),
    pairs AS (SELECT failure_id, chunk_id, max(score) AS base FROM llm_chunk_contexts WHERE score IS NOT NULL AND NOT isnan(score) AND failure_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY failure_id, chunk_id),
    e1 AS (SELECT *, chunk_type = 'class' AND list_contains(expected_short, name) AS x_defines, {_ANY("expected", "e", "contains(signal_text, lower(e))")} AS x_in_text, {_ANY("expected", "e", "contains(lower(src), lower(e))")} AS x_in_source,
        {_ANY("expected_short", "e", "regexp_matches(src, '\\braise\\s+(?:[A-Za-z_]\\w*\\.)*' || regexp_escape(e) || '\\b')")} AS x_raises, list_has_any(exception_terms, tokens) AS relevant, list_has_any(guard_call_terms, exception_terms) AS x_guard_call,
        is_function AND NOT data_access AND NOT constructor AS usable, list_has_any(list_concat(list_concat(name_terms, parent_terms), tokens), meaningful) AS shared FROM pairs JOIN fail USING (failure_id) JOIN code ON code.id = pairs.chunk_id),
    e2 AS (SELECT *, {_SUM(*_OWN)} AS own, {_SUM(*_HEAD)} AS head, {_SUM(*_WEAK)} AS weak, {_SUM(*_BUSINESS)} AS business, {_SUM(*_GUARDS)} AS guards, {_SUM(_OPERATION)} * 0.6 AS operations, {_SUM(*_SPECIFIC)} AS specific FROM e1),
    e3 AS (SELECT *, CASE WHEN did_not_raise THEN (head + guards + CASE WHEN {_STRONG} OR weak <= 0.15 THEN weak ELSE 0.15 END + operations + specific) * CASE WHEN chunk_type = 'class' AND NOT x_defines THEN 0.35 ELSE 1 END ELSE head + weak + business END AS signal FROM e2)
    SELECT failure_id, chunk_id, round(own + signal * CASE WHEN is_test THEN 0.25 ELSE 1 END, 6)::DOUBLE AS score,
        array_to_string(list_filter(flatten([{_NAMES(*_OWN)}, CASE WHEN did_not_raise THEN flatten([{_NAMES(*_HEAD)}, {_NAMES(*_GUARDS)}, {_NAMES(*_WEAK)}, {_NAMES(_OPERATION)}, {_NAMES(*_SPECIFIC)}]) ELSE flatten([{_NAMES(*_HEAD)}, {_NAMES(*_WEAK)}, {_NAMES(*_BUSINESS)}]) END, {_NAMES(*_SILENT)}]), lambda n: n IS NOT NULL), ',') AS parts FROM e3
"""


# texts


def _section(title: str, values: str) -> str:
    return f"CASE WHEN len({values}) > 0 THEN '{title}' || chr(10) || array_to_string(list_transform({values}, lambda x: '- ' || x), chr(10)) END"


_ROUTE = "(?i)^@\\w+\\.(get|post|put|patch|delete)\\(\\s*(?:''([^''\"]*)''|\"([^''\"]*)\")"
EMBEDDING_TEXTS = f"""
    WITH b AS (SELECT DISTINCT ON (id) *, coalesce(imports, []) AS im, coalesce(decorators, []) AS de, list_filter(list_transform(coalesce(dependencies, []), lambda x: {strip("x")}), lambda x: x <> '') AS dp FROM code_chunks),
    c AS (SELECT *, list_filter(dp, lambda x, i: list_position(dp, x) = i)[1:12] AS each_dep, flatten(list_transform(list_filter(de, lambda d: regexp_matches(d, '{_ROUTE}')), lambda d: ['FastAPI route handler: ' || upper(regexp_extract(d, '{_ROUTE}', 1)) || ' ' || regexp_extract(d, '{_ROUTE}', 2) || regexp_extract(d, '{_ROUTE}', 3), upper(regexp_extract(d, '{_ROUTE}', 1)) || ' route endpoint'])) AS hints FROM b)
    SELECT id, {strip(f'''array_to_string(list_filter(['type: ' || chunk_type, 'name: ' || CASE WHEN coalesce(parent, '') <> '' THEN parent || '.' || name ELSE name END, 'path: ' || file_path || ':' || start_line || '-' || coalesce(end_line::VARCHAR, ''), {_section("imports:", "im")}, {_section("decorators:", "de")}, {_section("framework hints:", "hints")}, {_section("dependencies:", "each_dep")}, 'source:', regexp_replace(coalesce(source_code, ''), '\\n+\\z', '')], lambda p: p IS NOT NULL), chr(10))''')} || chr(10) AS content FROM c
"""


def short(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {rstrip(f'({x})[1:{n - 3}]')} || '...' END"


def packet_chunks(redacted, per_kind: int = 5, reasons: int = 6, dependencies: int = 12, code: int = 3000, lines: int = 80, message: int = 1200, total: int = 12_000) -> str:
    """The chunks that fit beside a failure's facts; redacted gives the SQL of a redacted text."""
    size = lambda v: f"coalesce(list_sum(list_transform({v}, lambda y: length(y))), 0)"
    return f"""
    WITH f AS (SELECT DISTINCT ON (failure_id) failure_id, coalesce(test_name, '') AS test_name, coalesce(file_path, '') AS file_path, coalesce(error_type, '') AS error_type, {redacted(strip("coalesce(message, '')"))} AS message, {redacted(strip("coalesce(traceback, '')"))} AS traceback FROM test_failures),
    g AS (SELECT failure_id, length({redacted("test_name")}) + length(file_path) + length(error_type) + length({short("message", message)}) + length({short("traceback", message)}) AS fixed FROM f),
    x AS (SELECT DISTINCT ON (context_id) *, CASE WHEN source_label = 'related' THEN 'related' ELSE 'semantic' END AS kind, {rstrip(redacted("code_snippet"))} AS code FROM llm_chunk_contexts),
    k AS (SELECT *, regexp_split_to_array(regexp_replace(code, '(\\r\\n|\\r|\\n)\\z', ''), '\\r\\n|\\r|\\n') AS rows FROM (SELECT *, row_number() OVER (PARTITION BY failure_id, kind ORDER BY rank, context_id) AS k FROM x) WHERE k <= {per_kind}),
    m AS (SELECT *, CASE WHEN len(rows) > {lines} THEN {rstrip(f"array_to_string(rows[1:{lines}], chr(10))")} || chr(10) || '...' ELSE array_to_string(rows, chr(10)) END AS cut FROM k),
    n AS (SELECT *, {short("cut", code)} AS snippet, list_transform(coalesce(reasons, []), lambda r: {redacted("r")})[1:{reasons}] AS said, list_transform(coalesce(dependencies, []), lambda r: {redacted("r")})[1:{dependencies}] AS deps FROM m),
    o AS (SELECT n.*, g.fixed, sum(length(coalesce(snippet, '')) + length(name) + length(file_path) + length(chunk_type) + length(kind) + {size("said")} + {size("deps")}) OVER (PARTITION BY n.failure_id ORDER BY CASE WHEN kind = 'semantic' THEN 0 ELSE 1 END, rank, context_id ROWS UNBOUNDED PRECEDING) AS running FROM n JOIN g ON g.failure_id = n.failure_id)
    SELECT failure_id, kind, rank, name, snippet AS code_snippet, array_to_string(said, '; ') AS reasons FROM o WHERE running + fixed <= {total}"""


# explanations


def _public(r: str) -> str:
    return f"CASE WHEN {r} = 'source chunk from traceback file' THEN 'traceback file match' ELSE {r} END"


def failure_reasons(labels: tuple[tuple[str, str], ...]) -> str:
    """The public reasons of every scored chunk; labels are the components' in order."""
    prefix, last = FAILURE_SCORES.rsplit("SELECT failure_id, chunk_id, round(own", 1)
    names = "list_filter(" + last.split("array_to_string(list_filter(", 1)[1].rsplit(", ',') AS parts", 1)[0]
    shared = {"behavioral_keyword_overlap": "behavioral", "operation_keyword_overlap": "operation"}
    said = []
    for name, label in labels:
        if name in shared:
            words = f"list_sort(list_intersect({shared[name]}, tokens))[1:3]"
            said.append(f"CASE WHEN list_contains(names, '{name}') THEN '{label}' || array_to_string({words}, ', ') END")
        else:
            but = " AND NOT list_contains(names, 'raises_expected_exception')" if name == "contains_expected_exception" else ""
            said.append(f"CASE WHEN list_contains(names, '{name}'){but} THEN '{label}' END")
    files = f"list_filter(list_transform(list_concat(regexp_extract_all(traceback, '{_FILE_LINE}', 1), regexp_extract_all(traceback, '{_LOCATION}', 1)), lambda p: {normal('p')}), lambda p: p <> '')"
    traced = _ANY("files", "h", "h = path_key OR ends_with(path_key, '/' || h) OR ends_with(h, '/' || path_key)")
    return f"""{prefix}, r1 AS (SELECT e3.failure_id, chunk_id, {names} AS names, behavioral, operation, tokens, path_key, is_test, {files} AS files FROM e3 JOIN (SELECT failure_id, traceback FROM o) t ON t.failure_id = e3.failure_id),
    r2 AS (SELECT failure_id, chunk_id, list_transform(list_filter([{", ".join(said)}, CASE WHEN NOT is_test AND path_key <> '' AND {traced} THEN 'source chunk from traceback file' END], lambda r: r IS NOT NULL), lambda r: {_public("r")}) AS said FROM r1)
    SELECT failure_id, chunk_id, array_to_string(CASE WHEN len(said) > 0 THEN ({first_of_case("said")})[1:4] ELSE ['semantic match'] END, '; ') AS reasons FROM r2"""


_KEPT = f"""f AS (SELECT DISTINCT ON (failure_id) failure_id, coalesce(test_name, '') AS test_name, coalesce(error_type, '') AS error_type, coalesce(message, '') AS message, coalesce(traceback, '') AS traceback FROM test_failures),
    x AS (SELECT *, CASE WHEN source_label = 'related' THEN 'related' ELSE 'semantic' END AS kind, {is_test("file_path")} AS is_test FROM (SELECT DISTINCT ON (context_id) * FROM llm_chunk_contexts)),
    k AS (SELECT *, row_number() OVER (PARTITION BY failure_id, is_test ORDER BY CASE WHEN kind = 'semantic' THEN 0 ELSE 1 END, rank, context_id) AS place FROM x)"""
_ONE_LINE = lambda x: strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")

SUMMARIES = f"""
    WITH {_KEPT}, t AS (SELECT DISTINCT ON (failure_id) failure_id, name AS top_name, replace(file_path, chr(92), '/') AS top_path, coalesce(dependencies, []) AS top_deps FROM k ORDER BY failure_id, is_test, place),
    n AS (SELECT failure_id, list(name ORDER BY rank, context_id) FILTER (kind = 'related') AS others, list(DISTINCT name) AS names, max((len(coalesce(dependencies, [])) > 0)::INT) = 1 AS any_deps FROM x GROUP BY failure_id),
    j AS (SELECT f.*, t.top_name, t.top_path, t.top_deps, coalesce(n.others, []) AS others, coalesce(n.names, []) AS names, coalesce(n.any_deps, false) AS any_deps, {strip("f.test_name")} AS test, {strip("f.error_type")} AS error, {_CUT(_ONE_LINE("f.message"), 140)} AS said, regexp_extract_all(concat_ws(chr(10), f.test_name, f.message, f.traceback), '\\b([A-Za-z_]\\w*)\\b', 1) AS words FROM f LEFT JOIN t USING (failure_id) LEFT JOIN n USING (failure_id)),
    r AS (SELECT *, ({first_of_case("others")})[1:5] AS related FROM j)
    SELECT failure_id, concat_ws(chr(10), 'Diagnosis summary:', '- Failing test: ' || CASE WHEN test = '' THEN '<unknown>' ELSE string_split(test, '::')[-1] END,
        '- Failure signal: ' || CASE WHEN error <> '' AND said <> '' THEN error || ', ' || said WHEN error <> '' THEN error WHEN said <> '' THEN said ELSE '<none>' END,
        '- Most relevant source chunk: ' || coalesce(top_name || ' in ' || top_path, '<none>'), '- Related context: ' || CASE WHEN len(related) > 0 THEN array_to_string(related, ', ') ELSE '<none>' END,
        '- Why: ' || CASE WHEN top_name IS NULL THEN 'no retrieved chunks were available to explain.' WHEN list_has_any(words, names) THEN 'failure/query symbols overlap with retrieved source/context chunks.' WHEN list_has_any(top_deps, names) THEN 'the top source chunk depends on retrieved related context.'
            WHEN any_deps THEN 'retrieved chunks share dependency names that provide nearby context.' ELSE 'semantic retrieval ranked these chunks closest to the failure details.' END) AS summary FROM r
"""

HYPOTHESES = f"""
    WITH {_KEPT}, t AS (SELECT failure_id, name, coalesce(code_snippet, '') AS src FROM k WHERE NOT is_test AND place = 1),
    r AS (SELECT f.failure_id, t.name, list_filter([
        CASE WHEN (contains(lower(message), 'assert true is false') OR contains(lower(message), 'assert false is true')) AND regexp_matches(name, '(?i)^(validate|check|is_|has_|authorize)') THEN name || ' may contain boolean validation logic returning the opposite truth value from what the test expects.' END,
        CASE WHEN regexp_matches(message, '(?i)\\breturned\\s+.+?\\s+instead\\s+of\\s+.+') THEN name || ' may compute an incorrect value.' END,
        CASE WHEN regexp_matches(lower(concat_ws(' ', test_name, message, traceback)), 'expired|boundary|limit|threshold|edge') AND regexp_matches(src, '(?:^|[^=!<>])(?:<=|>=|<|>)(?:[^=]|$)') THEN 'The retrieved source includes comparison logic and the failing test appears boundary-related.' END
    ], lambda s: s IS NOT NULL) AS rules FROM f LEFT JOIN t USING (failure_id))
    SELECT failure_id, CASE WHEN name IS NOT NULL AND len(rules) > 0 THEN concat_ws(chr(10), 'Possible issue:', array_to_string(list_transform(rules, lambda s: '- ' || s), chr(10)), '- This is a hypothesis based on the failure signal and retrieved code, not a proven root cause.') END AS hypothesis FROM r
"""


# answers

_QUESTIONS = "SELECT v.vec_id AS query_id, v.name AS query, v.e, v.n FROM vectors v WHERE v.vec_id % 20 = 0"
_VECTORS = "SELECT *, sqrt(list_inner_product(e, e)) AS n FROM (SELECT DISTINCT ON (v.chunk_id) v.vec_id, v.chunk_id, k.name, v.embedding::DOUBLE[] AS e FROM chunk_vectors v JOIN (SELECT DISTINCT id, name FROM code_chunks WHERE name IS NOT NULL AND file_path IS NOT NULL) k ON k.id = v.chunk_id WHERE len(v.embedding) = 64 AND len(list_filter(v.embedding, lambda x: x IS NULL OR isnan(x))) = 0 ORDER BY v.chunk_id, v.vec_id)"
_HITS = f"""WITH vectors AS ({_VECTORS}), questions AS ({_QUESTIONS}), s AS (SELECT q.query_id, v.chunk_id, round(CASE WHEN q.n * v.n = 0 THEN 0 ELSE list_inner_product(q.e, v.e) / (q.n * v.n) END, 6) AS score FROM vectors v, questions q)
    SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 5"""


def _shown(likely: str, queries: str, related_to: str) -> str:
    """Likely rows (query_id, chunk_id, rank, score, reasons) and what they lead to, as answers show them."""
    return f"""
    WITH likely AS ({likely}), found AS ({related(related_to, queries)}),
    both_ AS (SELECT query_id, 'semantic' AS kind, rank, chunk_id, score, reasons FROM likely UNION ALL SELECT query_id, 'related', rank, chunk_id, NULL, 'dependency context' FROM found),
    c AS (SELECT DISTINCT ON (id) id, name, parent, chunk_type, replace(file_path, chr(92), '/') AS file_path, start_line, end_line FROM code_chunks)
    SELECT b.query_id, b.kind, b.rank, b.chunk_id, CASE WHEN c.chunk_type = 'method' AND c.parent <> '' THEN c.parent || '.' || c.name ELSE c.name END AS name, c.chunk_type, c.file_path, c.start_line, c.end_line, b.score, b.reasons FROM both_ b JOIN c ON c.id = b.chunk_id
"""


_ASKED = f"WITH vectors AS ({_VECTORS}) SELECT query_id, query FROM ({_QUESTIONS})"
_RANKED = INVESTIGATION.replace("FROM (SELECT query_id, min(query) AS query FROM investigation_results WHERE query IS NOT NULL GROUP BY query_id)", f"FROM ({_ASKED})").replace("SELECT query_id, chunk_id, max(score) AS base FROM investigation_results WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id", f"SELECT query_id, chunk_id, score AS base FROM ({_HITS.replace('rank <= 5', 'rank <= 40')})")
_RANKED = _RANKED.replace("SELECT query_id, chunk_id, round(base", "SELECT query_id, chunk_id, is_test, path_key, start_line, name, (base").replace(", 6)::DOUBLE AS score", ")::DOUBLE AS score")
_FIRST = f"SELECT query_id, chunk_id, score, reasons, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, is_test, path_key, start_line, chunk_id, name)::INT AS rank FROM ({_RANKED})) WHERE rank <= 5"
ANSWERS = _shown(f"SELECT *, 'semantic match' AS reasons FROM ({_HITS})", _ASKED, "SELECT * FROM likely")
RANKED_ANSWERS = _shown(f"SELECT query_id, chunk_id, round(score, 6) AS score, reasons, rank FROM ({_FIRST})", _ASKED, "SELECT * FROM likely")


# messages of parsed logs

_WHERE = "^\\+\\s*where\\s+(.+?)\\s*=\\s*(.+)$"
_EQUALS = "^assert\\s+(.+?)\\s*==\\s*(.+)$"
_REST = strip("CASE WHEN strpos(rest, ' - ') > 0 THEN rest[strpos(rest, ' - ') + 3:] ELSE '' END")
_SUMMARY = PARSED.replace("AS nodeid FROM b)", f"AS nodeid, {_REST} AS message FROM b)", 1).replace("e.nodeid, e.file_path, e.shown", "e.nodeid, e.message, e.file_path, e.shown", 1).replace("SELECT w.log_id, w.line_no, w.nodeid AS test_name,", "SELECT w.log_id, w.line_no, w.nodeid AS test_name, w.message,", 1)
LOG_MESSAGES = f"""
    WITH p AS ({_SUMMARY}),
    r AS (SELECT *, list_filter(list_transform(regexp_split_to_array(traceback, '\\r\\n|\\r|\\n'), lambda x: {strip("x")}), lambda x: NOT (length(x) >= 9 AND regexp_matches(x, '^_.*[^_\\s].*_$')) AND NOT regexp_matches(x, '^=.{{8,}}=$')) AS rows FROM p),
    t AS (SELECT *, list_filter(list_transform(list_filter(rows, lambda x: starts_with(x, 'E')), lambda x: {strip("x[2:]")}), lambda x: x <> '') AS told, list_transform(list_filter(rows, lambda x: starts_with(x, '>') AND contains(x, 'assert ')), lambda x: 'assert ' || {strip("x[strpos(x, 'assert ') + 7:]")})[1] AS asserted FROM r),
    k AS (SELECT *, list_filter(told, lambda x: NOT regexp_matches(x, '{_WHERE}') AND x NOT IN ('+', '-', '?', '|')) AS plain, list_filter(told, lambda x: regexp_matches(x, '{_WHERE}')) AS wheres FROM t),
    b AS (SELECT *, coalesce(list_filter(plain, lambda x: starts_with(x, 'AssertionError:') AND contains(x, 'assert '))[1], list_filter(plain, lambda x: starts_with(x, 'assert '))[1], list_filter(plain, lambda x: starts_with(x, 'AssertionError:'))[1], plain[1], asserted, '') AS best FROM k),
    c AS (SELECT *, coalesce(nullif({strip("regexp_replace(best, '^AssertionError:', '')")}, ''), best) AS bare FROM b),
    d AS (SELECT *, {strip(f"regexp_extract(bare, '{_EQUALS}', 1)")} AS left_, {strip(f"regexp_extract(bare, '{_EQUALS}', 2)")} AS right_ FROM c),
    e AS (SELECT *, list_transform(list_filter(wheres, lambda x: {strip(f"regexp_extract(x, '{_WHERE}', 1)")} = left_), lambda x: {strip(f"regexp_extract(x, '{_WHERE}', 2)")})[-1] AS value FROM d),
    f AS (SELECT *, CASE WHEN error_type = 'AssertionError' THEN CASE WHEN best = '' THEN coalesce(told[1], '') WHEN left_ <> '' AND contains(coalesce(value, ''), '(') THEN value || ' returned ' || left_ || ' instead of ' || right_ ELSE bare END ELSE coalesce(told[1], '') END AS said FROM e),
    g AS (SELECT *, {short(_ONE_LINE("said"), 220)} AS extracted FROM f)
    SELECT log_id, line_no, test_name, file_path, line_number, error_type, CASE WHEN error_type = 'AssertionError' THEN CASE WHEN extracted <> '' THEN extracted ELSE message END WHEN message = '' THEN extracted ELSE message END AS message, traceback FROM g
"""
