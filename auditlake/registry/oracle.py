"""DuckDB SQL for the registered queries.

Written from the meaning of each operator: windows and unnesting where the
Spark side works inside rows, recursion where it walks files.
"""

from __future__ import annotations

from auditlake.functions import review as R
from auditlake.functions import rules
from auditlake.operators.inventory import (
    EXCLUDED_DIRS,
    LINTER_MARKERS,
    NO_LINTER,
    NO_RUNNER,
    RUNNER_MARKERS,
)
from auditlake.registry import corpus
from auditlake.registry.spark_queries import RUN_SECONDS, TOKEN_BUDGET


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EXCLUDED = "|".join(d.replace(".", "\\.") for d in EXCLUDED_DIRS)
EXT = r"regexp_extract({0}, '(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$', 1)"
PRUNED = f"NOT regexp_matches(path, '(^|/)({EXCLUDED})/')"


def _language(ext: str) -> str:
    whens = " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in rules.LANGUAGES.items())
    return f"CASE {ext} {whens} END"


def _files(snapshot: str, name: str) -> str:
    repo, path, block = corpus.SNAPSHOTS[snapshot]
    return f"""{name} AS (
  SELECT repo, path, string_agg(block, chr(10) ORDER BY event_id) AS content
  FROM (SELECT {repo} AS repo, {path} AS path, event_id, {block} AS block FROM events)
  GROUP BY repo, path)"""


FILES = _files("current", "code_files")
BASE = _files("base", "base_files")
KNOWN = ", ".join(f"'{e}'" for e in rules.LANGUAGES)


def _sources(files: str = "code_files", where: str = PRUNED) -> str:
    ext = EXT.format("path")
    return f"""source_files AS (
  SELECT repo, path, content, {_language(ext)} AS language
  FROM {files} WHERE {ext} IN ({KNOWN}) AND {where})"""


CODE_LINES = """code_lines AS (
  SELECT repo, path, language, unnest(string_split(content, chr(10))) AS text,
    generate_subscripts(string_split(content, chr(10)), 1) AS line
  FROM source_files)"""

# The blocks of derived Python files are known, so their syntax facts can be read off the lines.
PY_LINES = r"""py_lines AS (
  SELECT repo, path, line, text,
    CASE WHEN regexp_full_match(text, 'except *:') THEN 'bare_except'
      WHEN regexp_matches(text, '^def ') THEN 'function' END AS kind,
    regexp_extract(text, '^def ([fg]\d+)', 1) AS name,
    CASE WHEN text LIKE 'def g%' THEN CAST(regexp_extract(text, '^def g(\d+)', 1) AS BIGINT) % 60 + 1
      ELSE 1 END AS length
  FROM code_lines WHERE language = 'python')"""

HITS = r"""hits AS (
  SELECT repo, path, line, 'bare_except' AS rule, text, NULL AS name, NULL AS amount, 1 AS phase, 0 AS k
    FROM py_lines WHERE kind = 'bare_except'
  UNION ALL
  SELECT repo, path, line, 'mutable_default', text, name, NULL, 0, i
    FROM py_lines, range(2) AS r(i) WHERE text LIKE 'def f%'
  UNION ALL
  SELECT repo, path, line, 'long_function', text, name, length, 0, 2
    FROM py_lines WHERE kind = 'function' AND length > 50
  UNION ALL
  SELECT repo, path, min(line), 'ts_any', arg_min(text, line), NULL, NULL, 0, 0
    FROM code_lines WHERE language = 'typescript' AND regexp_matches(text, ':\s*any\b') GROUP BY repo, path
  UNION ALL
  SELECT repo, path, line, 'ts_missing_return', text, NULL, NULL, 1, 0
    FROM code_lines WHERE language = 'typescript'
      AND regexp_matches(text, '^export\s+(function|const)\s+\w+\s*=')
      AND instr(string_split(text, '{')[1], ':') = 0
  UNION ALL
  SELECT repo, path, min(line), 'js_var', arg_min(text, line), NULL, NULL, 0, 0
    FROM code_lines WHERE language = 'javascript' AND regexp_matches(text, '^\s*var\s+\w+') GROUP BY repo, path
  UNION ALL
  SELECT repo, path, line, 'js_console', text, NULL, NULL, 1, 0
    FROM code_lines WHERE language = 'javascript' AND instr(text, 'console.log') > 0
      AND NOT starts_with(trim(text), '//')
  UNION ALL
  SELECT repo, path, min(line), 'go_ignored_error', arg_min(text, line), NULL, NULL, 0, 0
    FROM code_lines WHERE language = 'go' AND regexp_matches(text, '^\s*_\s*=\s*.*\b(?:Error|error)\b')
    GROUP BY repo, path)"""

CATALOGUE = (
    "catalogue(rule, severity, category, title, description, suggestion) AS (VALUES "
    + ", ".join(
        "(" + ", ".join(_text(v) for v in (rule, *texts)) + ")"
        for rule, texts in rules.CATALOGUE.items()
    )
    + ")"
)

FINDINGS = """findings AS (
  SELECT h.repo, h.path,
    CAST(row_number() OVER (PARTITION BY h.repo, h.path ORDER BY phase, line, k) - 1 AS INT) AS ordinal,
    CAST(h.line AS INT) AS line, h.rule, c.severity, c.category, c.title,
    replace(replace(c.description, '{name}', coalesce(h.name, '')), '{amount}', coalesce(CAST(h.amount AS VARCHAR), '')) AS description,
    c.suggestion, trim(h.text) AS context
  FROM hits h JOIN catalogue c USING (rule))"""

SCAN = ",\n".join([CODE_LINES, PY_LINES, HITS, CATALOGUE, FINDINGS])
SUMMARY = """summary AS (
  SELECT s.repo, count(*) AS files_scanned, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines_analyzed,
    CAST(sum(length(content) // 4) AS BIGINT) AS tokens, coalesce(any_value(f.n), 0) AS findings
  FROM source_files s LEFT JOIN (SELECT repo, count(*) AS n FROM findings GROUP BY repo) f USING (repo)
  GROUP BY s.repo)"""
FULL_SCAN = f"WITH RECURSIVE {FILES},\n{_sources()},\n{SCAN},\n{SUMMARY}"


def _severities(where: str) -> str:
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(rules.SEVERITIES))
    return f"""{FULL_SCAN}
SELECT s.severity, count(f.rule) AS findings
FROM (VALUES {names}) AS s(rank, severity)
LEFT JOIN (SELECT * FROM findings WHERE {where}) f USING (severity) GROUP BY s.severity"""


INVENTORY = f"""WITH inventory AS (
  SELECT o_orderkey, {corpus.INVENTORY_REPO} AS repo, {corpus.INVENTORY_PATH} AS path FROM orders)"""


def _metrics(keys: str, content: str, source: str) -> str:
    return f"""SELECT {keys}, CAST(len(string_split({content}, chr(10))) AS INT) AS n_lines,
  CAST(length({content}) // 4 AS BIGINT) AS est_tokens, sha256({content}) AS sha256 FROM {source}"""


def _marker(c: str, a: int, b: int) -> str:
    names = "[" + ", ".join(_text(m) for m in corpus.MARKERS) + "]"
    return f"{names}[({c} * {a} + {b}) % {len(corpus.MARKERS)} + 1]"


MARKERS = f"""WITH markers AS (
  SELECT c_custkey AS repo, unnest([{_marker('c_custkey', 1, 0)}, {_marker('c_custkey', 3, 2)},
    {_marker('c_custkey', 5, 7)}, 'sub/' || {_marker('c_custkey', 7, 0)}]) AS path FROM customer)"""

CHANGES = """changes AS (
  SELECT coalesce(n.repo, w.repo) AS repo, coalesce(n.path, w.path) AS path,
    CASE WHEN w.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
      WHEN n.content <> w.content THEN 'modified' ELSE 'same' END AS status
  FROM code_files n FULL OUTER JOIN base_files w ON n.repo = w.repo AND n.path = w.path)"""

# Repos with a base and a change are scanned in part, the others in full.
INCREMENTAL = f"""visited AS (
  SELECT f.* FROM code_files f JOIN changes c USING (repo, path)
  WHERE CASE WHEN f.repo IN (SELECT repo FROM base_files)
      AND f.repo IN (SELECT repo FROM changes WHERE status <> 'same')
    THEN c.status IN ('added', 'modified') ELSE {PRUNED} END)"""

LISTED = f"""visited AS (
  SELECT f.* FROM code_files f
  WHERE CASE WHEN f.repo IN (SELECT repo FROM base_files)
    THEN EXISTS (SELECT 1 FROM base_files b WHERE b.repo = f.repo AND b.path = f.path)
    ELSE {PRUNED} END)"""

REPAIR_PLANS = """repair_plans AS (
  SELECT sha256(repo || chr(31) || path || chr(31) || ordinal) AS plan_key,
    'audit-' || category || '-' || line AS finding_id, repo, path, ordinal AS seq,
    line AS line_start, line AS line_end, 'inline-fix' AS strategy, context AS original_snippet,
    replace(context, 'except:', 'except Exception:') AS target_snippet,
    'Fixed: ' || title AS explanation, true AS requires_type_check, true AS requires_lint
  FROM findings WHERE severity NOT IN ('info', 'low') AND category = 'anti-pattern'
    AND lower(title) LIKE '%except%')"""

WITHIN = f"repo IN (SELECT repo FROM summary WHERE tokens <= {TOKEN_BUDGET})"

EVENT_PLANS = (
    "event_plans AS (SELECT concat('p', event_id) AS plan_key, "
    + ", ".join(f"{text} AS {name}" for name, text in corpus.PLAN_COLUMNS.items())
    + " FROM events)"
)


def _first(c: str, s: str, t: str) -> str:
    return (
        f"CASE WHEN instr({c}, {s}) > 0 THEN substr({c}, 1, instr({c}, {s}) - 1) || {t} || "
        f"substr({c}, instr({c}, {s}) + length({s})) ELSE {c} END"
    )


def _edited(c: str, p: str) -> str:
    rows = f"string_split({c}, chr(10))"
    s, t = f"{p}.original_snippet", f"{p}.target_snippet"
    return f"""CASE WHEN {p}.strategy IN ('inline-fix', 'extract-function') THEN {_first(c, s, t)}
    WHEN {p}.strategy = 'rename' THEN replace({c}, {s}, {t})
    WHEN {p}.strategy = 'restructure' THEN
      CASE WHEN {p}.line_start > 1 THEN array_to_string({rows}[1:{p}.line_start - 1], chr(10)) || chr(10) ELSE '' END
      || {t} ||
      CASE WHEN {p}.line_end < len({rows}) THEN chr(10) || array_to_string({rows}[{p}.line_end + 1:], chr(10)) ELSE '' END
    END"""


def _single(where: str) -> str:
    return f"""WITH {FILES},
{EVENT_PLANS}
SELECT plan_key, repo, path, sha256(after) AS sha256, CAST(length(after) AS INT) AS length
FROM (SELECT p.plan_key, p.repo, p.path, {_edited('f.content', 'p')} AS after
  FROM event_plans p JOIN code_files f USING (repo, path) WHERE {where})"""


def _fold(
    plans: str,
    auto_rollback: bool = True,
    passed: str = corpus.VERDICT_PASSED,
    key: str = corpus.VERDICT_KEY,
) -> str:
    """CTEs that walk each file's plans in order, with the verdicts of the corpus."""
    simple = _first("mid", "split_part(original_snippet, chr(10), 1)", "split_part(target_snippet, chr(10), 1)")
    on_failure = (
        f"CASE WHEN passed THEN mid WHEN strategy = 'restructure' THEN {simple} ELSE before END"
        if auto_rollback
        else "mid"
    )
    return f"""verdicts AS (
  SELECT {key} AS plan_key, {passed} AS passed,
    {corpus.VERDICT_OUTPUT} AS output FROM {plans}),
ordered AS (
  SELECT p.*, coalesce(v.passed, true) AS passed, v.output,
    row_number() OVER (PARTITION BY p.repo, p.path ORDER BY p.seq) AS k
  FROM {plans} p LEFT JOIN verdicts v ON v.plan_key = p.plan_key),
walk AS (
  SELECT f.repo, f.path, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS version, CAST(NULL AS VARCHAR) AS plan_key,
    CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS mid, f.content AS after
  FROM code_files f
  UNION ALL
  SELECT repo, path, k, version + CASE WHEN known AND NOT passed AND strategy = 'restructure' AND {auto_rollback} THEN 2 ELSE 1 END,
    plan_key, before, mid, CASE WHEN NOT known THEN before ELSE {on_failure} END
  FROM (SELECT w.repo, w.path, o.k, w.version, o.plan_key, o.strategy, o.passed,
      o.original_snippet, o.target_snippet, w.after AS before,
      o.strategy IN ('inline-fix', 'extract-function', 'rename', 'restructure') AS known,
      {_edited('w.after', 'o')} AS mid
    FROM walk w JOIN ordered o ON o.repo = w.repo AND o.path = w.path AND o.k = w.k + 1)),
results AS (
  SELECT o.repo, o.path, o.seq, o.plan_key, o.k, w.version, w.before, w.mid, w.after, o.strategy, o.passed,
    w.plan_key IS NULL AS missing, w.plan_key IS NOT NULL AND w.mid IS NULL AS unknown, o.output
  FROM ordered o LEFT JOIN walk w ON w.plan_key = o.plan_key)"""


EVENT_FOLD = f"WITH RECURSIVE {FILES},\n{EVENT_PLANS},\n{_fold('event_plans')}"
LAST = """last_state AS (
  SELECT repo, path, arg_max(CASE WHEN NOT unknown AND NOT passed AND strategy = 'restructure' THEN mid ELSE
      CASE WHEN NOT unknown AND NOT passed THEN after ELSE before END END, version) AS previous,
    arg_max(after, version) AS content, CAST(max(version) AS INT) AS version
  FROM results WHERE NOT missing GROUP BY repo, path)"""
ERRORS = """CASE WHEN missing THEN 'Cannot refactor: ' || path || ' not found'
    WHEN unknown THEN 'Unknown strategy: ' || strategy {more} END"""

DIFFS = f"""code_diffs AS (
  SELECT diff_id, {corpus.DIFF_TEXT} AS diff
  FROM (SELECT diff_id, string_agg(block, chr(10) ORDER BY event_id) AS text
    FROM (SELECT {corpus.DIFF_ID} AS diff_id, event_id, {corpus.DIFF_BLOCK} AS block FROM events)
    GROUP BY diff_id))"""
DIFF_PARSE = """raw_lines AS (
  SELECT diff_id, unnest(string_split(diff, chr(10))) AS row_text,
    generate_subscripts(string_split(diff, chr(10)), 1) - 1 AS pos FROM code_diffs),
headed AS (
  SELECT *, last_value(CASE WHEN starts_with(row_text, '--- ') THEN trim(substr(row_text, 7)) END IGNORE NULLS)
    OVER (PARTITION BY diff_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file
  FROM raw_lines),
diff_lines AS (
  SELECT diff_id, CAST(pos AS INT) AS pos, file, substr(row_text, 1, 1) AS sign, substr(row_text, 2) AS text
  FROM headed WHERE file IS NOT NULL AND NOT starts_with(row_text, '--- ') AND NOT starts_with(row_text, '+++ '))"""

CREDENTIAL = r"""regexp_matches({0}, '(?i)(?:token|password|secret|api_key|apikey)\s*[=:]\s*["''].+["'']')"""
ADDED = (
    "CASE WHEN "
    + CREDENTIAL
    + r""" THEN 'credential'
    WHEN regexp_matches({0}, '(?i)\bTODO\b') THEN 'todo'
    WHEN length({0}) > 100 THEN 'long_line'
    WHEN regexp_matches({0}, '^\s*print\(') THEN 'print_call' END"""
)
REMOVED = r"""CASE WHEN regexp_matches({0}, 'try\s*:|except\s+\w+\s*:|raise\s+\w+') THEN 'removed_handling'
    WHEN regexp_matches({0}, '->\s*\w+') THEN 'removed_annotation' END"""
REVIEW_CATALOGUE = (
    "review_catalogue(rule, severity, message, suggestion) AS (VALUES "
    + ", ".join(
        "(" + ", ".join(_text(v) for v in (rule, *texts)) + ")" for rule, texts in R.CATALOGUE.items()
    )
    + ")"
)
COMMENTS = f"""{REVIEW_CATALOGUE},
comments AS (
  SELECT l.diff_id, l.pos, l.file, 0 AS line, c.rule, c.severity,
    replace(c.message, '{{length}}', CAST(length(l.text) AS VARCHAR)) AS message, c.suggestion
  FROM (SELECT *, CASE sign WHEN '+' THEN {ADDED.format('text')} WHEN '-' THEN {REMOVED.format('text')} END AS rule
    FROM diff_lines) l JOIN review_catalogue c USING (rule))"""

REPORTS = """folded AS (
  SELECT diff_id, count(*) AS n, count_if(severity = 'critical') AS n_critical,
    count_if(severity = 'suggestion') AS n_suggestion, count_if(severity = 'warning') AS n_warning,
    list_reduce(
      list_transform(list(severity ORDER BY pos), lambda s: {'sev': s, 'c': 1.0::DOUBLE, 'st': 1.0::DOUBLE, 'sa': 1.0::DOUBLE}),
      lambda a, b: {'sev': b.sev,
        'c': CASE WHEN b.sev = 'critical' THEN greatest(0::DOUBLE, a.c - 0.5::DOUBLE) ELSE a.c END,
        'st': CASE WHEN b.sev = 'suggestion' THEN greatest(0::DOUBLE, a.st - 0.04::DOUBLE) ELSE a.st END,
        'sa': CASE WHEN b.sev = 'critical' THEN greatest(0::DOUBLE, a.sa - 0.5::DOUBLE)
          WHEN b.sev = 'warning' THEN greatest(0::DOUBLE, a.sa - 0.12::DOUBLE) ELSE a.sa END},
      {'sev': '', 'c': 1.0::DOUBLE, 'st': 1.0::DOUBLE, 'sa': 1.0::DOUBLE}) AS dims
  FROM comments GROUP BY diff_id),
scored AS (
  SELECT d.diff_id, trim(d.diff) = '' AS blank, coalesce(n, 0) AS n, n_critical, n_suggestion, n_warning,
    CASE WHEN n IS NULL THEN 100 ELSE CAST(trunc((dims.c * 0.4::DOUBLE + dims.st * 0.2::DOUBLE
      + dims.sa * 0.25::DOUBLE + 1.0::DOUBLE * 0.15::DOUBLE) * 100) AS INT) END AS score
  FROM code_diffs d LEFT JOIN folded USING (diff_id)),
reports AS (
  SELECT *, score >= 75 AS approved,
    CASE WHEN blank THEN 'No changes to review.' ELSE
      'Score: ' || score || '/100 | ' || CASE WHEN score >= 75 THEN 'APPROVED' ELSE 'CHANGES REQUESTED' END
      || CASE WHEN n > 0 THEN ' | Comments: ' || n ELSE '' END
      || CASE WHEN n_critical > 0 THEN ' |   critical: ' || n_critical ELSE '' END
      || CASE WHEN n_suggestion > 0 THEN ' |   suggestion: ' || n_suggestion ELSE '' END
      || CASE WHEN n_warning > 0 THEN ' |   warning: ' || n_warning ELSE '' END END AS summary
  FROM scored)"""
REVIEW = f"WITH {DIFFS},\n{DIFF_PARSE},\n{COMMENTS},\n{REPORTS}"

# A repair plan changes one line, so its unified diff can be written down: up to
# three lines around it, and no line end after the last line of these files.
REPAIR_DIFFS = """changed AS (
  SELECT *, list_filter(range(1, len(b) + 1), lambda j: b[j] <> a[j])[1] AS spot
  FROM (SELECT repo, path, seq, plan_key, string_split(before, chr(10)) AS b, string_split(after, chr(10)) AS a
    FROM results WHERE NOT missing AND before <> after)),
spanned AS (
  SELECT *, greatest(1, spot - 3) AS lo, least(len(b), spot + 3) AS hi FROM changed),
repair_diffs AS (
  SELECT repo, path, seq, plan_key, '--- ' || path || chr(10) || '+++ ' || path || chr(10)
    || '@@ -' || span || ' +' || span || ' @@' || chr(10)
    || array_to_string(list_transform(range(lo, hi + 1), lambda j:
      CASE WHEN j = spot THEN '-' || b[j] || CASE WHEN j < len(b) THEN chr(10) ELSE '' END || '+' || a[j]
        ELSE ' ' || b[j] END || CASE WHEN j < len(b) THEN chr(10) ELSE '' END), '') AS diff
  FROM (SELECT *, CASE WHEN hi = lo THEN CAST(lo AS VARCHAR) ELSE lo || ',' || (hi - lo + 1) END AS span FROM spanned))"""
# An edit that changes nothing, or was rolled back, has no diff to review.
REPAIR_TAIL = (
    f"{REPAIR_PLANS},\n{_fold('repair_plans')},\n{REPAIR_DIFFS},\n"
    "code_diffs AS (SELECT plan_key AS diff_id, diff FROM repair_diffs),\n"
    f"{DIFF_PARSE},\n{COMMENTS},\n{REPORTS},\n"
    "reviewed AS (SELECT r.repo, r.path, r.plan_key, r.before <> r.after AS stands, coalesce(d.approved, false) AS approved "
    "FROM results r LEFT JOIN reports d ON d.diff_id = r.plan_key)"
)

REPAIR_FOLD = f"{FULL_SCAN},\n{REPAIR_TAIL}"
INCREMENTAL_SCAN = (
    f"WITH RECURSIVE {FILES},\n{BASE},\n{CHANGES},\n{INCREMENTAL},\n{_sources('visited', 'true')},\n{SCAN},\n{SUMMARY}"
)


def _run_report(budget: int | None, scanned: str = FULL_SCAN) -> str:
    tripped = f"tokens > {budget}" if budget else "false"
    return f"""{scanned},
{REPAIR_TAIL},
runs AS (
  SELECT s.repo, s.files_scanned, s.findings, s.tokens, {tripped} AS tripped,
    {tripped} OR s.findings = 0 AS early, coalesce(r.attempted, 0) AS attempted, CAST(coalesce(r.approved, 0) AS BIGINT) AS approved
  FROM summary s LEFT JOIN (SELECT repo, count(*) AS attempted, count_if(approved) AS approved
    FROM reviewed GROUP BY repo) r USING (repo)),
report AS (
SELECT repo AS run_id, NOT tripped AS success, files_scanned, findings,
  CASE WHEN early THEN 0 ELSE attempted END AS refactors_attempted,
  CASE WHEN early THEN 0 ELSE approved END AS refactors_approved,
  CASE WHEN early THEN 0 ELSE tokens END AS tokens_consumed,
  CASE WHEN early THEN 0.0::DOUBLE ELSE {RUN_SECONDS}::DOUBLE END AS duration_seconds,
  CASE WHEN tripped THEN 'Token budget exceeded (' || tokens || ' > {budget})'
    WHEN early THEN 'No issues found. Codebase is clean.'
    ELSE 'Audit Complete' || chr(10) || '  Duration: ' || printf('%.1f', {RUN_SECONDS}::DOUBLE) || 's' || chr(10)
      || '  Files scanned: ' || files_scanned || chr(10) || '  Findings: ' || findings || chr(10)
      || '  Refactors attempted: ' || attempted || chr(10) || '  Approved: ' || approved || chr(10)
      || '  Tokens consumed: ' || format('{{:,}}', tokens) || chr(10) || '  Status: ✅ All clear' END AS summary
FROM runs)"""


REPORT_COLUMNS = (
    "run_id, success, files_scanned, findings, refactors_attempted, refactors_approved, "
    "tokens_consumed, duration_seconds, summary"
)


def _rule(name: str) -> str:
    return f"{FULL_SCAN}\nSELECT * FROM findings WHERE rule = '{name}'"


def _check(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"{REVIEW}\nSELECT diff_id, pos, file, severity, message FROM comments WHERE rule IN ({listed})"


EVENT_FILES = f"""event_files AS (
  SELECT {corpus.REPO} AS repo, concat('e', event_id, '/', {corpus.PATH}) AS path, {corpus.BLOCK} AS content
  FROM events)"""

RUNNER = (
    "[" + ", ".join(f"'{r}'" for _, r in RUNNER_MARKERS) + "]",
    "CASE path " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, (m, _) in enumerate(RUNNER_MARKERS)) + " END",
)
LINTER = "CASE " + " ".join(
    f"WHEN path IN ({', '.join(_text(m) for m in markers)}) THEN '{name}'" for name, markers in LINTER_MARKERS
) + " END"

ORACLE: dict[str, str] = {
    "lang_inventory": f"""{INVENTORY}
SELECT ext, {_language('ext')} AS language, count(*) AS files
FROM (SELECT {EXT.format('path')} AS ext FROM inventory) GROUP BY ext""",
    "excluded_dirs": f"""{INVENTORY}
SELECT o_orderkey, repo, path, {_language(EXT.format('path'))} AS language FROM inventory
WHERE {PRUNED} AND {EXT.format('path')} IN ({KNOWN})""",
    "path_extensions": f"SELECT page_id, {EXT.format('url')} AS ext FROM pages",
    "decoded_text": _metrics(
        "doc_id",
        "content",
        "(SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)) || chr(13), '\\r\\n?', chr(10), 'g')"
        " || 'a' || chr(65533) || 'b' || chr(65533) || chr(65533) || 'c' AS content FROM documents)",
    ),
    "file_metrics": _metrics("doc_id", "text", "documents"),
    "py_facts": f"""WITH {FILES},
{_sources(where='true')},
{CODE_LINES},
{PY_LINES}
SELECT repo, path, kind, CAST(line AS INT) AS line, CAST(line + length AS INT) AS end_line,
  CASE WHEN kind = 'function' THEN name END AS name,
  CASE WHEN text LIKE 'def f%' THEN 2 ELSE 0 END AS mutable_defaults, text
FROM py_lines WHERE kind IS NOT NULL""",
    **{
        query: _rule(rule)
        for query, rule in {
            "py_bare_except": "bare_except",
            "py_mutable_default": "mutable_default",
            "py_long_function": "long_function",
            "ts_any": "ts_any",
            "ts_missing_return": "ts_missing_return",
            "js_var": "js_var",
            "js_console": "js_console",
            "go_ignored_error": "go_ignored_error",
        }.items()
    },
    "findings_union": f"{FULL_SCAN}\nSELECT * FROM findings",
    "scan_summary": f"{FULL_SCAN}\nSELECT * FROM summary",
    "scan_summary_snapshots": f"""WITH RECURSIVE {FILES},
{BASE},
both_files AS (
  SELECT repo, path, content, 'current' AS snapshot FROM code_files
  UNION ALL SELECT repo, path, content, 'base' FROM base_files),
code_files_by_snapshot AS (
  SELECT concat(snapshot, '/', repo) AS repo, path, content FROM both_files),
{_sources('code_files_by_snapshot')},
{SCAN},
{SUMMARY}
SELECT split_part(repo, '/', 2) AS repo, split_part(repo, '/', 1) AS snapshot,
  files_scanned, lines_analyzed, tokens, findings FROM summary""",
    "severity_counts": _severities("true"),
    "js_severity": _severities("rule IN ('js_var', 'js_console')"),
    "token_budget": f"""{FULL_SCAN}
SELECT repo, tokens, tokens <= {TOKEN_BUDGET} AS success,
  CASE WHEN tokens > {TOKEN_BUDGET} THEN 'Token budget exceeded (' || tokens || ' > {TOKEN_BUDGET})' END AS message
FROM summary""",
    "clean_gate": f"""{FULL_SCAN}
SELECT s.repo || '/' || s.path AS repo, count(f.rule) AS findings, count(f.rule) = 0 AS clean,
  CASE WHEN count(f.rule) = 0 THEN 'No issues found. Codebase is clean.' END AS message
FROM source_files s LEFT JOIN findings f USING (repo, path) GROUP BY s.repo, s.path""",
    "toolchain": f"""{MARKERS}
SELECT repo, coalesce({RUNNER[0]}[min({RUNNER[1]})], 'skip') AS runner,
  CASE WHEN min({RUNNER[1]}) IS NULL THEN {_text(NO_RUNNER)} END AS message FROM markers GROUP BY repo""",
    "linters": f"""{MARKERS}
SELECT repo, coalesce(string_agg(DISTINCT linter, ',' ORDER BY linter), '') AS linters,
  CASE WHEN count(linter) = 0 THEN {_text(NO_LINTER)} END AS message
FROM (SELECT repo, {LINTER} AS linter FROM markers) GROUP BY repo""",
    "changed_files": f"WITH {FILES},\n{BASE},\n{CHANGES}\nSELECT * FROM changes",
    "stored_changed_files": f"WITH {FILES},\n{BASE},\n{CHANGES}\nSELECT * FROM changes",
    "incremental_findings": f"""WITH {FILES},
{BASE},
{CHANGES},
{INCREMENTAL},
{_sources('visited', 'true')},
{SCAN}
SELECT * FROM findings""",
    "path_list_scan": f"WITH {FILES},\n{BASE},\n{LISTED},\n{_sources('visited', 'true')}\n"
    + _metrics("repo, path", "content", "source_files"),
    "plans": f"{FULL_SCAN},\n{REPAIR_PLANS}\nSELECT * FROM repair_plans",
    "gated_plans": f"{FULL_SCAN},\n{REPAIR_PLANS}\nSELECT plan_key, repo, path, seq FROM repair_plans WHERE {WITHIN}",
    "edited_files_budget": f"""{FULL_SCAN},
{REPAIR_PLANS},
gated AS (SELECT * FROM repair_plans WHERE {WITHIN}),
{_fold('gated')},
{LAST}
SELECT repo, path, version, content FROM last_state""",
    "degraded_plan": f"""WITH {EVENT_PLANS}
SELECT plan_key, repo, path, seq, 'inline-fix' AS strategy, split_part(original_snippet, chr(10), 1) AS original_snippet,
  split_part(target_snippet, chr(10), 1) AS target_snippet, line_start, line_end,
  'Degraded fix for: ' || explanation AS explanation
FROM event_plans WHERE strategy = 'restructure'""",
    "edit_inline_fix": _single("p.strategy = 'inline-fix'"),
    "edit_rename": _single("p.strategy = 'rename'"),
    "edit_extract_function": _single("p.strategy = 'extract-function'"),
    "edit_restructure": _single("p.strategy = 'restructure'"),
    "edit_invalid": f"""WITH {FILES},
{EVENT_PLANS}
SELECT p.plan_key, p.repo, p.path, CASE WHEN f.path IS NULL THEN 'Cannot refactor: ' || p.path || ' not found'
  ELSE 'Unknown strategy: ' || p.strategy END AS error
FROM event_plans p LEFT JOIN code_files f USING (repo, path)
WHERE f.path IS NULL OR p.strategy NOT IN ('inline-fix', 'extract-function', 'rename', 'restructure')""",
    "edit_batch": f"""{EVENT_FOLD}
SELECT repo, path, CAST(version - CASE WHEN twice THEN 1 ELSE 0 END AS INT) AS version, seq, plan_key, 'edit' AS step,
  sha256(before) AS before_sha256, sha256(CASE WHEN twice THEN mid ELSE after END) AS sha256
FROM (SELECT *, NOT unknown AND NOT passed AND strategy = 'restructure' AS twice FROM results WHERE NOT missing)
UNION ALL
SELECT repo, path, CAST(version AS INT), seq, plan_key, 'degraded', sha256(mid), sha256(after)
FROM results WHERE NOT missing AND NOT unknown AND NOT passed AND strategy = 'restructure'""",
    "edited_files": f"{EVENT_FOLD},\n{LAST}\nSELECT repo, path, version, content FROM last_state",
    "rollback": f"""{EVENT_FOLD},
{LAST},
{BASE}
SELECT repo, path, previous AS content, sha256(previous) AS sha256 FROM last_state
WHERE EXISTS (SELECT 1 FROM base_files b WHERE b.repo = last_state.repo AND b.path = last_state.path)""",
    "rollback_all": f"""{EVENT_FOLD},
{LAST}
SELECT repo, path, previous AS content, sha256(previous) AS sha256 FROM last_state""",
    "outcomes": f"""{EVENT_FOLD}
SELECT repo, path, seq, plan_key, NOT missing AND NOT unknown AS success,
  NOT missing AND NOT unknown AND NOT passed AND strategy <> 'restructure' AS rolled_back,
  {ERRORS.format(more='')} AS error FROM results""",
    "outcomes_repeated_verdicts": f"""WITH RECURSIVE {FILES},
{EVENT_PLANS},
{_fold('event_plans', passed=f"({corpus.VERDICT_PASSED}) AND ({corpus.SECOND_PASSED})", key="plan_key")}
SELECT repo, path, seq, plan_key, NOT missing AND NOT unknown AS success,
  NOT missing AND NOT unknown AND NOT passed AND strategy <> 'restructure' AS rolled_back,
  {ERRORS.format(more='')} AS error FROM results""",
    "outcomes_untested": f"""WITH RECURSIVE {FILES},
{EVENT_PLANS},
{_fold('event_plans', passed="true")}
SELECT repo, path, seq, plan_key, NOT missing AND NOT unknown AS success, false AS rolled_back,
  {ERRORS.format(more='')} AS error FROM results""",
    "outcomes_left_edited": f"""WITH RECURSIVE {FILES},
{EVENT_PLANS},
{_fold('event_plans', auto_rollback=False)}
SELECT repo, path, seq, plan_key, NOT missing AND NOT unknown AND passed AS success, false AS rolled_back,
  {ERRORS.format(more="WHEN NOT passed THEN 'Tests failed: ' || substr(output, 1, 200)")} AS error FROM results""",
    "diff_lines": f"WITH {DIFFS},\n{DIFF_PARSE}\nSELECT * FROM diff_lines",
    "diff_lines_by_range": f"WITH {DIFFS},\n{DIFF_PARSE}\nSELECT * FROM diff_lines",
    "added_credential": _check("credential"),
    "added_todo": _check("todo"),
    "added_long_line": _check("long_line"),
    "added_print": _check("print_call"),
    "removed_lines": _check("removed_handling", "removed_annotation"),
    "review_comments": f"{REVIEW}\nSELECT * FROM comments",
    "review_scores": f"{REVIEW}\nSELECT diff_id, approved, score, CAST(n AS INT) AS n_comments FROM reports",
    "review_summary": f"{REVIEW}\nSELECT diff_id, summary FROM reports",
    "review_body": f"""{REVIEW}
SELECT r.diff_id, '## Auto-Review' || chr(10) || chr(10) || '**Status:** '
  || CASE WHEN approved THEN '✅ Approved' ELSE '❌ Changes Requested' END || chr(10)
  || '**Score:** ' || score || '/100' || chr(10) || chr(10) || '### Refactoring Summary' || chr(10)
  || 'Change set ' || r.diff_id || chr(10) || chr(10) || '### Review Comments' || chr(10)
  || coalesce(b.listed, chr(10) || 'No issues found. Clean refactoring.') AS body
FROM reports r LEFT JOIN (
  SELECT diff_id, string_agg(chr(10) || '- **[' || upper(severity) || ']** (' || file || '): ' || message
    || chr(10) || '  → ' || suggestion, '' ORDER BY pos) AS listed
  FROM comments GROUP BY diff_id) b USING (diff_id)""",
    "text_line_checks": f"""WITH texts AS (
  SELECT 'documents' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents
  UNION ALL SELECT 'pages', page_id, CAST(0 AS BIGINT), html FROM pages
  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations),
text_lines AS (
  SELECT kind, id, part, unnest(string_split(text, chr(10))) AS line_text,
    CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM texts)
SELECT * FROM (SELECT kind, id, part, pos, {ADDED.format('line_text')} AS rule, CAST(length(line_text) AS INT) AS length
  FROM text_lines) WHERE rule IS NOT NULL""",
    "failed_reports": f"""{REPAIR_FOLD}
SELECT repo, path, plan_key, false AS approved, 0 AS score, 'Refactoring failed: None' AS summary
FROM reviewed WHERE NOT stands""",
    "repair_diffs": f"""{REPAIR_FOLD}
SELECT repo, path, seq, plan_key, diff FROM repair_diffs""",
    "repair_reviews": f"""{REPAIR_FOLD}
SELECT r.repo, r.path, r.plan_key, r.approved, d.score, d.summary
FROM reviewed r JOIN reports d ON d.diff_id = r.plan_key""",
    "run_report": f"{_run_report(None)}\nSELECT {REPORT_COLUMNS} FROM report",
    "incremental_run_report": f"{_run_report(TOKEN_BUDGET, INCREMENTAL_SCAN)}\nSELECT {REPORT_COLUMNS} FROM report",
    "repair_bodies": f"""{REPAIR_FOLD}
SELECT r.plan_key, '## Auto-Review' || chr(10) || chr(10) || '**Status:** '
  || CASE WHEN r.approved THEN '✅ Approved' ELSE '❌ Changes Requested' END || chr(10)
  || '**Score:** ' || CASE WHEN r.stands THEN d.score ELSE 0 END || '/100' || chr(10) || chr(10)
  || '### Refactoring Summary' || chr(10) || 'Repair of ' || r.path || chr(10) || chr(10) || '### Review Comments' || chr(10)
  || coalesce(b.listed, chr(10) || 'No issues found. Clean refactoring.') AS body
FROM reviewed r LEFT JOIN reports d ON d.diff_id = r.plan_key LEFT JOIN (
  SELECT diff_id, string_agg(chr(10) || '- **[' || upper(severity) || ']** (' || file || '): ' || message
    || chr(10) || '  → ' || suggestion, '' ORDER BY pos) AS listed
  FROM comments GROUP BY diff_id) b ON b.diff_id = r.plan_key""",
    "run_report_budget": f"{_run_report(TOKEN_BUDGET)}\nSELECT {REPORT_COLUMNS} FROM report",
    "run_report_json": f"""{_run_report(None)}
SELECT run_id, '{{"success":' || success || ',"files_scanned":' || files_scanned || ',"findings":' || findings
  || ',"refactors_attempted":' || refactors_attempted || ',"refactors_approved":' || refactors_approved
  || ',"tokens_consumed":' || tokens_consumed || ',"duration_seconds":' || duration_seconds
  || ',"summary":' || to_json(summary) || '}}' AS json FROM report""",
    "stream_findings": f"""WITH {EVENT_FILES},
{_sources('event_files', 'true')},
{SCAN}
SELECT * FROM findings""",
    "stream_changed_findings": f"""WITH RECURSIVE {FILES},
{BASE},
latest_files AS (
  SELECT c.repo, c.path, c.content,
    CAST(CASE WHEN b.repo IS NOT NULL AND b.content IS DISTINCT FROM c.content THEN 2 ELSE 1 END AS BIGINT) AS version
  FROM code_files c LEFT JOIN base_files b USING (repo, path)
  UNION ALL
  SELECT b.repo, b.path, b.content, CAST(1 AS BIGINT) FROM base_files b ANTI JOIN code_files c USING (repo, path)),
{_sources('latest_files', 'true')},
{SCAN}
SELECT f.*, l.version FROM findings f JOIN latest_files l USING (repo, path)""",
    "stream_severity_totals": f"""WITH {EVENT_FILES},
{_sources('event_files', 'true')},
{SCAN}
SELECT severity, count(*) AS count FROM findings GROUP BY severity""",
}
ORACLE["py_facts_any_line_end"] = ORACLE["py_facts"]
ORACLE["py_facts_by_content"] = ORACLE["py_facts"]
