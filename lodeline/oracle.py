r"""DuckDB SQL for the queries of the log operators.

DuckDB's regular expressions have no lookaround and are ASCII. NUMBER and PATH are rewritten without lookaround: NUMBER is replaced twice by
a sentinel that ends in a word character, and the sentinel by the placeholder.
"""

from __future__ import annotations

from .functions.patterns import CLASSES, CORE, EXTRA, OPTIONAL, WHOLE
from .operators.alignment import INSTRUCTION, OTHER, SHAPES
from .operators.synthesis import _ORDINARY, EXAMPLES

_OFFLINE = (*CORE, "HEX", "PATH")
def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _masked(column: str, labels) -> str:
    for label in labels:
        if label == "NUMBER":
            once = r"regexp_replace({}, '(^|[^\w.])-?\d+(?:\.\d+)?($|[^\w.])', '\1' || chr(1) || 'Z\2', 'g')"
            column = f"replace({once.format(once.format(column))}, chr(1) || 'Z', '<VAR:NUMBER>')"
        elif label == "PATH":
            column = rf"regexp_replace({column}, '(^|\s)/[A-Za-z0-9_.\-/]+', '\1<VAR:PATH>', 'g')"
        else:
            column = f"regexp_replace({column}, {_q(CLASSES[label])}, '<VAR:{label}>', 'g')"
    return column


def _tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({column}, '[\s\x1c-\x1f]+'), lambda x: x <> '')"


_DOC = r"""docl AS (SELECT doc_id * 4294967296 + n - 1 AS line_no, ls[n] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(n)
    WHERE regexp_matches(ls[n], '[^\s\x1c-\x1f]'))"""
_EVENT = """ev AS (SELECT event_id AS line_no, event_type AS kind, ['INFO', 'WARN', 'ERROR', 'DEBUG'][event_id % 4 + 1] AS level, 'u' || (user_id % 10) AS dataset, user_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || ['INFO', 'WARN', 'ERROR', 'DEBUG'][event_id % 4 + 1] || ' ' || event_type || ' user ' || user_id || ' value ' || CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) AS line FROM events)"""
_TRUTH = _EVENT + """, tp AS (SELECT line_no, dataset, kind, CASE WHEN level = 'WARN' THEN 'ERROR' ELSE level END AS level FROM ev)"""
_TALK = "talk AS (SELECT CAST(conv_id AS VARCHAR) AS dataset, turn AS line_no, text AS line FROM conversations WHERE trim(text) <> '')"
_HEX_RUN = r"regexp_replace({}, '(^|[^\pL\pN_])(?:0x)?[0-9A-Fa-f]{{4,}}($|[^\pL\pN_])', '\1#H#\2', 'g')"
_NORMAL = rf"regexp_replace({_HEX_RUN.format(_HEX_RUN.format('line'))}, '\d+', '#N#', 'g')"
_SAMPLE_TOKENS = f"regexp_extract_all({_NORMAL}, '[A-Za-z0-9_./:%@#-]+')"
_KEY = r"array_to_string(list_transform(t[1:5], lambda x: CASE WHEN (starts_with(x, '<VAR:') AND ends_with(x, '>')) OR regexp_full_match(x, '\d+') THEN '<*>' ELSE x END), ' ')"
_WILD = "regexp_replace({}, '<VAR:[A-Z0-9]+>', '<*>', 'g')"


def _mined(labels) -> str:
    """Buckets of event lines, all of them single clusters: key, n, first_line, size, template_typed, cluster_id; and line (line_no, key, n)."""
    return f"""{_EVENT}, line AS (SELECT line_no, {_tokens(_masked("line", labels))} AS t FROM ev), keyed AS (SELECT line_no, t, {_KEY} AS key, len(t) AS n FROM line),
    b AS (SELECT key, n, min(line_no) AS first_line, count(*) AS size FROM keyed GROUP BY key, n),
    p AS (SELECT key, n, i, min(t[i]) AS a, max(t[i]) AS z FROM keyed, unnest(range(1, n + 1)) u(i) GROUP BY key, n, i),
    tt AS (SELECT key, n, string_agg(CASE WHEN a = z THEN a ELSE '<*>' END, ' ' ORDER BY i) AS template_typed FROM p GROUP BY key, n),
    c AS (SELECT *, row_number() OVER (ORDER BY first_line) - 1 AS cluster_id FROM b JOIN tt USING (key, n))"""


def _case(shapes, column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({column}, {_q(s)}) THEN {_q(p)}" for s, p in shapes) + f" ELSE {other} END"


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / {union} END"


_CLASSIFIED = "CASE " + " ".join(f"WHEN regexp_full_match(token, {_q(p)}) THEN '{c}'" for c, p in WHOLE.items()) + " END"
_ENTROPY = f"""ent AS (SELECT dataset, line_no, {_SAMPLE_TOKENS} AS t FROM talk), freq AS (SELECT dataset, line_no, x, count(*)::DOUBLE AS f, any_value(len(t)) AS n FROM ent, unnest(t) u(x) GROUP BY dataset, line_no, x),
    e AS (SELECT ent.dataset, ent.line_no, round(coalesce(h, 0.0), 6) + 0.0 AS entropy FROM ent LEFT JOIN (SELECT dataset, line_no, -sum(f / n * log2(f / n)) AS h FROM freq GROUP BY dataset, line_no) USING (dataset, line_no))"""
_USER_PAIRS = f"""{_EVENT}, tok AS (SELECT line_no, user_id, {_tokens("line")} AS t FROM ev), pr AS (SELECT line_no, t, lead(t) OVER (PARTITION BY user_id ORDER BY line_no) AS u FROM tok)"""
_PREDICTED = _TRUTH + ", pp AS (SELECT dataset, line_no, kind, level, kind = CASE WHEN line_no % 3 = 0 THEN kind ELSE level END AS right_template FROM tp)"


def _ga(prediction: str) -> str:
    return f"""q AS (SELECT dataset, kind AS t, {prediction} AS p, count(*) AS n FROM tp GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY dataset, t) AS nt, sum(n) OVER (PARTITION BY dataset, p) AS np FROM q),
    ga AS (SELECT dataset, sum(CASE WHEN n = nt AND n = np THEN n ELSE 0 END)::DOUBLE / sum(n) AS g FROM w GROUP BY dataset)"""


_SCORES = f"""{_PREDICTED}, {_ga("level")}, sc AS (SELECT ga.dataset, 'level' AS method, round(g, 4) AS ga, round(pa, 4) AS pa FROM ga JOIN (SELECT dataset, avg(right_template::INT)::DOUBLE AS pa FROM pp GROUP BY dataset) USING (dataset))"""
_OPTIONAL_WHOLE = {c: (WHOLE.get(c) or EXTRA[c].replace(r"\b", "")) for c in OPTIONAL}
_PATTERNS = {**CLASSES, **EXTRA}


def _literal(p: str) -> str:
    back = "chr(92)"
    return f"""CASE WHEN contains({p}, '"') OR ends_with({p}, {back}) THEN '"' || replace(replace({p}, {back}, {back} || {back}), '"', {back} || '"') || '"' ELSE 'r"' || {p} || '"' END"""


_BLANK_TOKENS = "CASE WHEN len({0}) = 0 THEN [''] ELSE {0} END"


def _drained(source: str) -> str:
    """The ordered parser, bucket by bucket and line by line, over src (dataset, line_no, t): res (dataset, line_no, cluster_id, template).

    A recursion carries the templates of every bucket from one line to the next.
    """
    like = "list_sum(list_transform(range(1, n + 1), lambda p: (x[p] = t[p] OR x[p] = '<*>')::INT))"
    merged = "list_transform(ts[slot], lambda x, p: CASE WHEN x = t[p] THEN x ELSE '<*>' END)"
    return f"""WITH RECURSIVE {source}, k AS (SELECT *, len(t) AS n, {_KEY} AS key FROM src),
    o AS (SELECT *, row_number() OVER (PARTITION BY dataset, n, key ORDER BY line_no) AS i, dense_rank() OVER (ORDER BY dataset, n, key) AS b FROM k),
    st(b, i, ts, slot) AS (SELECT b, i, [t], 1::BIGINT FROM o WHERE i = 1 UNION ALL
        SELECT b, i, CASE WHEN fresh THEN list_append(ts, t) ELSE list_concat(list_concat(ts[1:slot - 1], [{merged}]), ts[slot + 1:]) END, CASE WHEN fresh THEN len(ts) + 1 ELSE slot END
        FROM (SELECT *, most::DOUBLE / n < 0.4 AND len(ts) < 100 AS fresh, CASE WHEN most::DOUBLE / n >= 0.4 THEN list_position(same, most) ELSE 1 END AS slot
              FROM (SELECT *, list_max(same) AS most FROM (SELECT st.b, o.i, t, n, ts, list_transform(ts, lambda x: {like}) AS same FROM st JOIN o ON o.b = st.b AND o.i = st.i + 1)))),
    lineat AS (SELECT o.dataset, o.line_no, o.b, st.slot FROM st JOIN o ON o.b = st.b AND o.i = st.i),
    ids AS (SELECT b, slot, row_number() OVER (PARTITION BY dataset ORDER BY first_line) - 1 AS cluster_id FROM (SELECT dataset, b, slot, min(line_no) AS first_line FROM lineat GROUP BY ALL)),
    last AS (SELECT b, arg_max(ts, i) AS ts FROM st GROUP BY b),
    res AS (SELECT dataset, line_no, cluster_id, {_WILD.format("array_to_string(ts[slot], ' ')")} AS template FROM lineat JOIN ids USING (b, slot) JOIN last USING (b))"""


def _lines(column: str, labels, table: str, dataset: str, cte: str) -> str:
    found = _tokens(_masked(column, labels))
    return f"{cte}, src AS (SELECT {dataset} AS dataset, line_no, {_BLANK_TOKENS.format(found)} AS t FROM {table})"


_NUMBERS = ", ".join(f"o_orderkey * {p} % 997" for p in (1, 7, 31, 101, 211, 307, 401, 503))
_TURN_LINES = """turnl AS (SELECT conv_id * 4096 + turn * 64 + i - 1 AS line_no, ls[i] AS line FROM (SELECT conv_id, turn, string_split(text || chr(10) || chr(10) || ' ' || chr(10) || text, chr(10)) AS ls FROM conversations), unnest(range(1, len(ls) + 1)) u(i))"""
_ONLINE = f"""WITH RECURSIVE {_TALK}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) AS i FROM (SELECT dataset AS source, line_no, {_tokens('line')} AS t FROM talk) WHERE len(t) > 0),
    st(source, i, line_no, ts, sizes, ids, keys, vals, slot) AS (
        SELECT source, i, line_no, [t], [2::BIGINT], [sha1(source || ':' || line_no)], [t[1] || chr(0) || len(t)], [1::BIGINT], 1::BIGINT FROM o WHERE i = 1 UNION ALL
        SELECT source, i, line_no,
            CASE WHEN fresh THEN list_append(ts, t) ELSE list_concat(list_concat(ts[1:slot - 1], [list_transform(ts[slot][1:len(t)], lambda x, p: CASE WHEN x = t[p] THEN x ELSE '<*>' END)]), ts[slot + 1:]) END,
            CASE WHEN fresh THEN list_append(sizes, 2::BIGINT) ELSE list_transform(sizes, lambda x, p: CASE WHEN p = slot THEN x + 1 ELSE x END) END,
            CASE WHEN fresh THEN list_append(ids, sha1(source || ':' || line_no)) ELSE ids END,
            CASE WHEN hit IS NULL THEN list_append(keys, key) ELSE keys END, CASE WHEN hit IS NULL THEN list_append(vals, CASE WHEN fresh THEN len(ts) + 1 ELSE slot END) ELSE vals END,
            CASE WHEN fresh THEN len(ts) + 1 ELSE slot END
        FROM (SELECT *, hit IS NULL AND most <= 0.6 AS fresh, coalesce(vals[hit], CASE WHEN most > 0.6 THEN list_position(same, most) END) AS slot
              FROM (SELECT *, list_max(same) AS most, list_position(keys, key) AS hit
                    FROM (SELECT o.source, o.i, o.line_no, t, ts, sizes, ids, keys, vals, t[1] || chr(0) || len(t) AS key,
                                 list_transform(ts, lambda x: coalesce(list_sum(list_transform(range(1, least(len(x), len(t)) + 1), lambda p: (x[p] = t[p] OR x[p] = '<*>')::INT)), 0)::DOUBLE / len(x)) AS same FROM st JOIN o ON o.source = st.source AND o.i = st.i + 1)))),
    res AS (SELECT source, line_no, ids[slot] AS group_id, sizes[slot] AS size, array_to_string(ts[slot], ' ') AS template FROM st)
    SELECT * FROM res"""
_EVENT_ENTROPY = f"""{_EVENT}, ent AS (SELECT line_no, line, {_SAMPLE_TOKENS} AS t FROM ev), freq AS (SELECT line_no, x, count(*)::DOUBLE AS f, any_value(len(t)) AS n FROM ent, unnest(t) u(x) GROUP BY line_no, x),
    e AS (SELECT line_no, any_value(line) AS line, any_value(list_distinct(t)) AS s, round(-sum(f / n * log2(f / n)), 12) AS h FROM ent JOIN freq USING (line_no) GROUP BY line_no)"""
_GREEDY = f"""WITH RECURSIVE {_EVENT_ENTROPY}, c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h DESC, line_no) AS r FROM e),
    pick(n, r, chosen) AS (SELECT 1, 1::BIGINT, [s] FROM c WHERE r = 1 UNION ALL
        SELECT n + 1, r, list_append(chosen, s) FROM (SELECT p.n, p.chosen, min_by(c.s, c.r) AS s, min(c.r) AS r FROM pick p JOIN c ON c.r > p.r
            WHERE len(list_filter(p.chosen, lambda x: len(list_intersect(x, c.s))::DOUBLE / len(list_distinct(list_concat(x, c.s))) >= 0.8)) = 0 AND p.n < 20 GROUP BY p.n, p.chosen))
    SELECT n - 1 AS rank, line_no, line FROM pick JOIN c USING (r)"""


def _evaluated() -> str:
    """Both parses of the two groups of users; every bucket of event lines is one cluster."""

    def parsed(name: str, labels) -> str:
        return f"""{name}l AS (SELECT d, line_no, {_tokens(_masked('line', labels))} AS t FROM evd), {name}k AS (SELECT *, {_KEY} AS key, len(t) AS n FROM {name}l),
        {name}p AS (SELECT d, key, n, i, min(t[i]) AS a, max(t[i]) AS z FROM {name}k, unnest(range(1, n + 1)) u(i) GROUP BY ALL),
        {name}t AS (SELECT d, key, n, string_agg(CASE WHEN a = z THEN a ELSE '<*>' END, ' ' ORDER BY i) AS typed FROM {name}p GROUP BY ALL),
        {name}r AS (SELECT d, line_no, key || '#' || n AS c, {_WILD.format('typed')} AS template FROM {name}k JOIN {name}t USING (d, key, n))"""

    return f"""WITH {_EVENT}, evd AS (SELECT 'u' || (user_id % 2) AS d, line_no, line FROM ev), {parsed('m', CORE)}, {parsed('g', CLASSES)},
    q AS (SELECT d, g.c AS t, m.c AS p, count(*) AS n FROM mr m JOIN gr g USING (d, line_no) GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY d, t) AS nt, sum(n) OVER (PARTITION BY d, p) AS np FROM q),
    sc AS (SELECT d, round(sum(CASE WHEN n = nt AND n = np THEN n ELSE 0 END)::DOUBLE / sum(n), 4) AS ga, pa FROM w JOIN (SELECT d, round(avg((m.template = g.template)::INT), 4) AS pa FROM mr m JOIN gr g USING (d, line_no) GROUP BY d) USING (d) GROUP BY d, pa)
    SELECT d AS dataset, 'lodeline' AS method, ga AS "GA", pa AS "PA" FROM sc UNION ALL SELECT 'MacroAvg', 'lodeline', round(avg(ga), 4), round(avg(pa), 4) FROM sc"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_WORD_PATTERNS = rf"""{_DOC}, pat AS (SELECT DISTINCT regexp_replace(t, '[0-9]+', '\\d+', 'g') AS pattern FROM (SELECT unnest({_tokens('line')}) AS t FROM docl) WHERE regexp_full_match(t, '[A-Za-z0-9_./:-]*[0-9][A-Za-z0-9_./:-]*'))"""


def _labelled() -> str:
    """Labels of patterns by the share of each class's examples that they take whole."""
    examples = _values((i, _q(label), _q(v)) for i, (label, values) in enumerate(EXAMPLES.items()) for v in values)
    return f"""WITH {_WORD_PATTERNS}, ex(place, label, v) AS (VALUES {examples}), wide(v) AS (VALUES {_values([_q(x)] for x in _ORDINARY)}),
    share AS (SELECT pattern, place, label, avg(regexp_full_match(v, pattern)::INT) AS s FROM pat, ex GROUP BY ALL),
    best AS (SELECT pattern, arg_max(label, s - place / 1000) AS label, max(s) AS s FROM share GROUP BY pattern)
    SELECT pattern, CASE WHEN s >= 0.5 AND NOT EXISTS (SELECT 1 FROM wide WHERE regexp_full_match(wide.v, best.pattern)) THEN label END AS label FROM best"""


_LINE_WITH = {**CLASSES, "PATH": r"(^|\s)/[A-Za-z0-9_.\-/]+", "NUMBER": r"(^|[^\w.])-?\d+(?:\.\d+)?($|[^\w.])"}  # without lookaround
_ASKED = rf"{_TALK}, asked AS (SELECT dataset, line_no, regexp_extract(line, '[a-z]+') || '\d+' AS own, length(line) % 2 AS attempt FROM talk)"


def _provided() -> str:
    """Each conversation's patterns by their first place, and the core classes that are left: numbers and blocks are named."""
    core = _values((i, _q(c), _q(CLASSES[c])) for i, c in enumerate(CORE) if c != "NUMBER")
    return rf"""WITH {_ASKED}, each AS (SELECT dataset, line_no, unnest([0, 1, 2, 3]) AS i, unnest([own, '\d+', '(', 'blk_-?\d+']) AS pattern FROM asked),
    first AS (SELECT dataset, pattern, min(line_no * 4 + i) AS spot FROM each GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY spot) - 1 AS place FROM first),
    masks AS (SELECT dataset, place, CASE pattern WHEN '\d+' THEN 'NUMBER' WHEN 'blk_-?\d+' THEN 'BLK' ELSE 'VAR' || place END AS label, pattern FROM placed WHERE pattern <> '('
              UNION ALL SELECT dataset, 1000000000 + i, label, p FROM (SELECT DISTINCT dataset FROM talk), (VALUES {core}) c(i, label, p))
    SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY place) - 1 AS ord, label, pattern FROM masks"""


_HEADED = "'### Instruction:' || chr(10) || " + _q(INSTRUCTION) + " || chr(10) || chr(10) || '### Input:' || chr(10) || line || chr(10) || chr(10) || '### Output:' || chr(10)"

_RECORDS = r"""l AS (SELECT doc_id % {0} AS part, doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(i)),
    rec AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY doc_id, i) - 1 AS line_no, '.txt' AS format_hint, regexp_replace(line, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS text FROM l)"""
_USERS = f"""{_TRUTH}, uk AS (SELECT ev.dataset, row_number() OVER (PARTITION BY ev.dataset ORDER BY line_no) - 1 AS line_no, line, kind AS template FROM ev),
    uf AS (SELECT dataset, template, row_number() OVER (PARTITION BY dataset ORDER BY min(line_no)) - 1 AS cluster_id FROM uk GROUP BY dataset, template)"""
_USER_TRUTH = f"WITH {_USERS} SELECT uk.dataset, line_no, line, cluster_id, uk.template FROM uk JOIN uf ON uk.dataset = uf.dataset AND uk.template = uf.template"


def _offline_masks(lines: str) -> str:
    """ord, label, pattern of the masks for the tokens of `lines` (line)."""
    core = [f"SELECT {i} AS place, '{c}' AS label, {_q(CLASSES[c])} AS pattern" for i, c in enumerate(CORE)]
    shown = [f"SELECT {4 + i}, '{c}', {_q(_PATTERNS[c])} WHERE EXISTS (SELECT 1 FROM tok WHERE regexp_full_match(token, {_q(_OPTIONAL_WHOLE[c])}))" for i, c in enumerate(OPTIONAL)]
    return f"tok AS (SELECT unnest({_tokens('line')}) AS token FROM {lines}), m AS ({' UNION ALL '.join([*core, *shown])}) SELECT row_number() OVER (ORDER BY place) - 1 AS ord, label, pattern FROM m"


ORACLE = {
    "file_records": f"WITH {_RECORDS.format(64)} SELECT *, text[1:50] AS short FROM rec",
    "truth_files": _USER_TRUTH,
    "whole_truth_files": _USER_TRUTH,
    "mask_files": f"WITH {_DOC}, {_offline_masks('docl')}",
    "parsed_csv": f"WITH {_mined(_OFFLINE)} SELECT line AS log, {_WILD.format('template_typed')} AS template FROM ev JOIN keyed USING (line_no) JOIN c USING (key, n)",
    "metric_files": f"WITH {_SCORES}, a AS (SELECT dataset, method, ga AS \"GA\", pa AS \"PA\" FROM sc UNION ALL SELECT 'MacroAvg', method, round(avg(ga), 4), round(avg(pa), 4) FROM sc GROUP BY method) SELECT *, true AS strings FROM a",
    "scrubbed_files": rf"WITH {_DOC}, s AS (SELECT '/anon/path anon@example.com hostname=anon ' || regexp_replace(regexp_replace(regexp_replace(line, '/[\w\-_/]+', '/anon/path', 'g'), '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+', 'anon@example.com', 'g'), 'hostname=[^,\s]+', 'hostname=anon', 'g') AS scrubbed FROM docl) SELECT scrubbed, count(*) AS n FROM s GROUP BY scrubbed",
    "timing": f"WITH {_EVENT} SELECT 'u' || (user_id % 2) AS dataset, count(*) AS n_logs, true AS timed FROM ev WHERE line_no < (SELECT count(*) // 2 FROM ev) GROUP BY ALL",
    "synth_masks_api": _GREEDY.replace("SELECT n - 1 AS rank, line_no, line FROM pick JOIN c USING (r)", ", sampled AS (SELECT line FROM pick JOIN c USING (r)), " + _offline_masks("sampled")),
    "miner_sessions": _drained(_lines("line", _OFFLINE, "docl", "'documents'", _DOC)) + " SELECT line_no, cluster_id FROM res",
    "miner_state": _drained(_lines("line", _OFFLINE, "docl", "'documents'", _DOC)) + " SELECT cluster_id, min(line_no) AS first_line, any_value(template) AS template FROM res GROUP BY cluster_id",
    "drain_slow_path": _drained("src AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS dataset, o_orderkey AS line_no, list_transform([o_orderkey % 7, o_orderkey % 5, o_orderkey % 3, o_orderkey % 11, o_orderkey % 2], lambda x: CAST(x AS VARCHAR)) AS t FROM orders)") + " SELECT * FROM res",
    "overflowing_bucket": _drained(f"src AS (SELECT CAST(o_orderkey % 40 AS VARCHAR) AS dataset, o_orderkey AS line_no, list_transform([{_NUMBERS}], lambda x: CAST(x AS VARCHAR)) AS t FROM orders)") + " SELECT * FROM res",
    "drain_parse_documents": _drained(_lines("line", _OFFLINE, "docl", "'documents'", _DOC)) + " SELECT line_no, cluster_id, template FROM res",
    "blank_lines": _drained(_lines("line", _OFFLINE, "turnl", "'turns'", _TURN_LINES)) + " SELECT line_no, cluster_id, template FROM res",
    "online_parse": _ONLINE,
    "streamed_groups": _ONLINE,
    "entropy_greedy_sample": _GREEDY,
    "evaluate_events": _evaluated(),
    "streamed_clusters": f"WITH {_mined(_OFFLINE)} SELECT line_no, sha1('events:' || n || ':' || key || ':0') AS cluster FROM keyed",
    "streamed_dense_ids": f"WITH {_mined(_OFFLINE)} SELECT line_no, cluster_id FROM keyed JOIN c USING (key, n)",
    "streamed_records": f"WITH {_RECORDS.format(8)} SELECT * FROM rec",
    "pattern_labels": _labelled(),
    "provider_masks": _provided(),
    "provider_attempts": f"WITH {_ASKED} SELECT dataset, line_no, attempt, 4::BIGINT AS n_patterns FROM asked",
    "read_answers": rf"""WITH {_TALK}, w AS (SELECT dataset, line_no, line_no % 4 AS kind, regexp_extract(line, '[A-Za-z]+') AS word FROM talk),
        p AS (SELECT dataset, line_no, unnest(CASE kind WHEN 0 THEN [word || '\d+', 'a b'] WHEN 1 THEN [word || '\w+', 'x' || chr(39) || word] WHEN 2 THEN [word] ELSE [] END) AS pattern,
                     unnest(range(0, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END)) AS ord FROM w)
        SELECT dataset, line_no, ord, pattern FROM p""",
    "prompts": f"WITH {_TALK} SELECT dataset, line_no, {_HEADED} AS question, {_HEADED} || md5(line) AS example FROM talk",
    "strict_patterns": f"WITH {_WORD_PATTERNS}, k AS (SELECT pattern, length(pattern) % 3 AS k FROM pat) SELECT CASE k WHEN 0 THEN pattern || '(' WHEN 1 THEN 'x.*' || pattern ELSE pattern END AS pattern, k <> 0 AS loose, k = 2 AS strict FROM k",
    "structured_csv": f"""WITH {_EVENT}, r AS (SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, line_no AS n, CASE WHEN line_no % 5 = 1 THEN replace(line, ' user ', chr(10) || '"user",' || chr(10)) ELSE line END AS line, kind FROM ev),
        c AS (SELECT * FROM r WHERE n % 7 <> 3), f AS (SELECT kind, row_number() OVER (ORDER BY min(line_no)) - 1 AS cluster_id FROM c GROUP BY kind) SELECT line_no, line, kind AS template, cluster_id FROM c JOIN f USING (kind)""",
    "corpus_files": r"""WITH l AS (SELECT lang AS dataset, doc_id, i, ls[i] AS line FROM (SELECT coalesce(lang, 'unknown') AS lang, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(i) WHERE regexp_matches(ls[i], '[^\s\x1c-\x1f]'))
        SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY doc_id, i) - 1 AS line_no, line FROM l""",
    "ts_prefix_members": f"WITH {_EVENT}, r AS (SELECT line_no, line, regexp_replace(line, '^.*?[0-9][0-9]:[0-9][0-9]:[0-9][0-9]', '') AS rest FROM ev) SELECT line_no, line, length(rest) AS length, rest[1:3] AS prefix FROM r",
    "lines_split": f"WITH {_DOC} SELECT line_no, line FROM docl",
    "tokenize": f"WITH {_DOC}, t AS (SELECT line_no, {_tokens('line')} AS ts FROM docl) SELECT line_no, i - 1 AS pos, ts[i] AS token FROM t, unnest(range(1, len(ts) + 1)) u(i)",
    "token_stats": f"WITH {_DOC} SELECT token, count(*) AS n, count(DISTINCT line_no) AS n_lines FROM (SELECT line_no, unnest({_tokens('line')}) AS token FROM docl) GROUP BY token",
    "mask_canonical": f"WITH {_DOC} SELECT line_no, {_masked('line', CLASSES)} AS masked FROM docl",
    "mask_offline": f"WITH {_EVENT} SELECT line_no, {_masked('line', _OFFLINE)} AS masked FROM ev",
    "bucket_keys": f"WITH {_DOC}, k AS (SELECT {_tokens(_masked('line', CLASSES))} AS t FROM docl) SELECT {_KEY} AS key, len(t) AS n_tokens, count(*) AS n_lines FROM k GROUP BY ALL",
    "sql_functions": rf"""WITH {_DOC}, k AS (SELECT line_no, line, {_masked('line', CLASSES)} AS masked FROM docl), s AS (SELECT *, {_tokens('masked')} AS t FROM k)
        SELECT line_no, masked, {_KEY} AS key, len(t) AS n_tokens, {_NORMAL} AS normal,
               regexp_replace(regexp_replace(regexp_replace(line, '/[\w\-_/]+', '/anon/path', 'g'), '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+', 'anon@example.com', 'g'), 'hostname=[^,\s]+', 'hostname=anon', 'g') AS scrubbed FROM s""",
    "template_mine_events": f"WITH {_mined(_OFFLINE)} SELECT cluster_id, {_WILD.format('template_typed')} AS template, template_typed, size AS n_lines FROM c",
    "cluster_sizes": f"WITH {_mined(CLASSES)} SELECT cluster_id, first_line, size FROM c",
    "num_clusters": f"WITH {_mined(CLASSES)} SELECT 'events' AS dataset, count(*) AS n_clusters FROM c",
    "drain_parse_events": f"WITH {_mined(_OFFLINE)} SELECT line_no, cluster_id, {_WILD.format('template_typed')} AS template FROM keyed JOIN c USING (key, n)",
    "typed_templates": f"WITH {_mined(CLASSES)} SELECT template_typed, sum(size)::BIGINT AS n_lines FROM c GROUP BY template_typed",
    "classify_tokens": f"WITH {_DOC} SELECT DISTINCT token, {_CLASSIFIED} AS class FROM (SELECT unnest({_tokens('line')}) AS token FROM docl)",
    "mask_tokens": f"WITH {_EVENT}, t AS (SELECT line_no, {_tokens('line')} AS ts FROM ev) SELECT line_no, array_to_string(list_transform(ts, lambda token: coalesce('<' || {_CLASSIFIED} || '>', token)), ' ') AS masked FROM t",
    "normalise_lines": f"WITH {_DOC} SELECT line_no, {_NORMAL} AS normal, array_to_string({_SAMPLE_TOKENS}, ' ') AS tokens FROM docl",
    "line_entropy": f"WITH {_TALK}, {_ENTROPY} SELECT dataset, line_no, entropy FROM e",
    "entropy_topk": f"WITH {_TALK}, {_ENTROPY} SELECT * FROM (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY entropy DESC, line_no) AS rank, line_no FROM e) WHERE rank <= 5",
    "jaccard_pairs": f"WITH {_TALK}, s AS (SELECT dataset, line_no, {_SAMPLE_TOKENS} AS t FROM talk), p AS (SELECT *, lead(t) OVER (PARTITION BY dataset ORDER BY line_no) AS u FROM s) SELECT dataset, line_no, round({_jaccard('t', 'u')}, 9) AS jaccard FROM p WHERE u IS NOT NULL",
    "synth_offline_masks": f"WITH {_DOC}, {_offline_masks('docl')}",
    "canonical_bundle": f"WITH {_DOC} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS ord, '{c}' AS label, {_q(p)} AS pattern, (SELECT count(*) FROM docl WHERE regexp_matches(line, {_q(_LINE_WITH[c])})) AS n_lines" for i, (c, p) in enumerate(CLASSES.items())),
    "grouping_accuracy": f"WITH {_TRUTH}, {_ga('''CASE WHEN kind = 'click' OR dataset = 'u3' THEN level ELSE kind END''')} SELECT dataset, round(g, 9) AS \"GA\" FROM ga",
    "parsing_accuracy": f"WITH {_PREDICTED} SELECT dataset, round(avg(right_template::INT)::DOUBLE, 9) AS \"PA\" FROM pp GROUP BY dataset",
    "macro_avg": f"WITH {_SCORES} SELECT dataset, method, ga AS \"GA\", pa AS \"PA\" FROM sc UNION ALL SELECT 'MacroAvg', method, round(avg(ga), 4), round(avg(pa), 4) FROM sc GROUP BY method",
    "format_report": f"WITH {_SCORES} SELECT dataset AS at, dataset || ' & ' || method || ' & ' || printf('%.3f', ga) || ' & ' || printf('%.3f', pa) || ' ' || chr(92) || chr(92) AS row FROM sc",
    "truth_from_templates": f"WITH {_TRUTH}, f AS (SELECT dataset, kind, min(line_no) AS m FROM tp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m) - 1 AS cluster_id FROM f) SELECT tp.dataset, line_no, cluster_id, tp.kind AS template FROM tp JOIN r ON tp.dataset = r.dataset AND tp.kind = r.kind",
    "length_mismatch_fallback": f"WITH {_TRUTH} SELECT dataset, dataset <> 'u5' AS from_file, CASE WHEN dataset <> 'u5' THEN kind ELSE level END AS template, count(*) AS n FROM tp GROUP BY ALL",
    "dataset_manifest": f"WITH {_TALK} SELECT dataset AS name, count(*) AS logs, count(DISTINCT lower(line)) AS templates, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS checksum FROM talk GROUP BY dataset",
    "align_template": rf"WITH {_EVENT}, g AS (SELECT line_no, regexp_extract(line, '^(\S+) (\S+) (.+?) user (.+?) value (.+)$', ['a', 'b', 'c', 'd', 'e']) AS x FROM ev) SELECT line_no, x.a || '|' || x.b || '|' || x.c || '|' || x.d || '|' || x.e AS slots FROM g",
    "classify_values": f"WITH {_DOC} SELECT DISTINCT value, {_case(SHAPES, 'value', _q(OTHER))} AS pattern FROM (SELECT unnest({_tokens('line')}) AS value FROM docl)",
    "training_examples": rf"WITH {_EVENT}, g AS (SELECT line_no, line, regexp_extract(line, '^(\S+) (\S+) (.+?) user (.+?) value (.+)$', ['a', 'b', 'c', 'd', 'e']) AS x FROM ev), v AS (SELECT line_no, line, list_transform([x.a, x.b, x.c, x.d, x.e], lambda w: {_case(SHAPES, 'w', _q(OTHER))}) AS ps FROM g), d AS (SELECT line_no, line, list_filter(ps, lambda p, i: list_position(ps, p) = i) AS ps FROM v) SELECT line_no, line AS input, '[' || chr(10) || '    ' || array_to_string(list_transform(ps, lambda p: {_literal('p')}), ',' || chr(10) || '    ') || ',' || chr(10) || ']' AS output FROM d",
    "max_per_system": f"WITH {_TRUTH}, r AS (SELECT dataset, line_no, kind || ' ' || level AS input, row_number() OVER (PARTITION BY dataset ORDER BY line_no) AS n FROM tp WHERE level <> 'INFO') SELECT dataset, line_no, input FROM r WHERE n <= 10",
    "raw_literals": f"""WITH p AS (SELECT page_id, html AS p FROM pages) SELECT page_id, {_literal('p')} AS literal, '[' || chr(10) || '    "a' || chr(92) || chr(92) || '",' || chr(10) || '    ' || {_literal('p')} || ',' || chr(10) || ']' AS list FROM p""",
    "scrub": rf"""WITH {_DOC}, s AS (SELECT line_no, line, 'document' AS kind FROM docl UNION ALL SELECT page_id, url || ' hostname=h-' || page_id || ',x', 'page' FROM pages)
        SELECT line_no, regexp_replace(regexp_replace(regexp_replace(line, '/[\w\-_/]+', '/anon/path', 'g'), '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+', 'anon@example.com', 'g'), 'hostname=[^,\s]+', 'hostname=anon', 'g') AS scrubbed, kind FROM s""",
    "ts_prefix_groups": f"WITH {_EVENT}, r AS (SELECT line, regexp_replace(line, '^.*?[0-9][0-9]:[0-9][0-9]:[0-9][0-9]', '') AS rest FROM ev) SELECT length(rest) AS length, rest[1:3] AS prefix, count(*) AS n_lines, min(line) AS first FROM r GROUP BY ALL",
    "cache_keys": f"WITH {_DOC}, t AS (SELECT {_tokens('line')} AS ts FROM docl) SELECT ts[1] AS first_token, len(ts) AS n_tokens, count(*) AS n_lines FROM t GROUP BY ALL",
    "pair_merge_template": f"WITH {_USER_PAIRS} SELECT line_no, CASE WHEN {_jaccard('t', 'u')} > 0.1 THEN array_to_string(list_transform(range(1, least(len(t), len(u)) + 1), lambda i: CASE WHEN t[i] = u[i] THEN t[i] ELSE '<*>' END), ' ') ELSE '' END AS template FROM pr WHERE u IS NOT NULL",
    "pair_jaccard": f"WITH {_USER_PAIRS} SELECT line_no, round({_jaccard('t', 'u')}, 9) AS jaccard, round(list_sum(list_transform(range(1, least(len(t), len(u)) + 1), lambda i: (t[i] = u[i] OR t[i] = '<*>')::INT))::DOUBLE / len(t), 9) AS similarity FROM pr WHERE u IS NOT NULL",
    "record_rows": "SELECT sha256(url || ':' || page_id) AS record_id, '[' || sha256(url || ':' || page_id) || '] ' || url || ' | ' || html[1:50] AS description FROM pages",
}
ORACLE["jsonl_files"] = ORACLE["training_examples"].removesuffix(" FROM d") + ", (SELECT count(*) FROM d) AS written FROM d"
