"""Oracle SQL for the registered queries.

The oracle reads the texts line by line, which is all the derived corpus needs:
its statements stand on lines of their own and its functions end with a brace at
a known indentation.  It shares the corpus' construction with the engine but none
of its matching.
"""

from __future__ import annotations

import re

from sourceassay import fixed_values as fv
from sourceassay.operators import contracts
from sourceassay.operators.rules import CATALOGUE
from sourceassay.operators.signatures import NODE_PATTERNS
from sourceassay.plans import demo_corpus, demo_findings, demo_flows, demo_payloads

SQL: dict[str, str] = {}


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _in(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def _map(table) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _any(col: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({col}, '{f}')" for f in fragments) + ")"


def _segments(dirs) -> str:
    return f"list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), {_list(dirs)})"


_SUFFIX = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_TOKENS = (
    r"""'(?s)"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[^"''`/]+|.'"""
)
_PY_TOKENS = r"""'(?s)"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|#[^\n]*|[^"''#]+|.'"""


def _lang(extensions) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{tag}'" for e, tag in extensions.items())
    return f"CASE {_SUFFIX} {cases} END"


def _lines(table: str, extra: str = "") -> str:
    parts = "string_split(content, chr(10))"
    return (f"SELECT project, path{extra}, unnest({parts}) AS text, "
            f"CAST(generate_subscripts({parts}, 1) AS INT) AS line, len({parts}) AS n_lines FROM {table}")


_CALL = (
    "CASE " + " ".join(
        f"WHEN regexp_matches(text, '{pattern}') THEN '{c}'" for c, pattern in fv.CALL_PATTERNS.items())
    + " END"
)
_MINOR = r"TRY_CAST(nullif(regexp_extract(solidity_version, '0\.(\d+)\.', 1), '') AS BIGINT)"
_OWNERS = r"regexp_extract(text, '\b(" + "|".join(fv.OWNER_MODIFIERS) + r")\b', 1)"
_ORACLE = (
    f"CASE WHEN {_any('text', fv.CHAINLINK_FRAGMENTS)} THEN 'chainlink' "
    f"WHEN {_any('text', fv.UNISWAP_FRAGMENTS)} THEN 'uniswap' "
    r"WHEN regexp_matches(text, '\.balanceOf\s*\(') THEN 'balanceof' "
    r"WHEN regexp_matches(text, '\bTWAP\b|\btwap\b|\bTimeWeighted\b') THEN 'twap' END"
)
_AUTH = rf"regexp_matches(text, '\b(require|assert)\s*\(') AND {_any('text', fv.AUTH_KEYWORDS)}"
_UINT = r"regexp_matches(text, '\buint\d*\b|\bint\d*\b')"
_ARITH = r"'(\w[\w.\[\]]*)\s*(\+\+|--|\+=|-=|\*=|/=|\+|-|\*|/)\s*([\w.\[\]]*)'"
_NAMES = "|".join(fv.STATE_NAMES)


def _write(close: str) -> str:
    return rf"regexp_matches(text, '\b(?:{_NAMES})\s*[\[(].*?{close}\s*[-+*/]?=|\b\w+\s*[-+*/]?=')"


#: building blocks; every query names the ones it needs
CTES = {
    "src": demo_corpus.source_files_sql(),
    "gen0": f"SELECT *, {_lang(fv.GENERAL_EXTENSIONS)} AS language FROM src "
            f"WHERE NOT is_symlink AND NOT {_segments(fv.GENERAL_IGNORED_DIRS)}",
    "gen": "SELECT * FROM gen0 WHERE language IS NOT NULL",
    "dec": "SELECT project, path, language, raw, TRY(decode(raw)) AS content FROM gen",
    "ok": "SELECT * FROM dec WHERE content IS NOT NULL",
    "capped": "SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS rn, "
              "count(*) OVER (PARTITION BY project) AS discovered FROM dec",
    "kept": "SELECT * FROM capped WHERE content IS NOT NULL",
    "sol0": f"SELECT *, 'sol' AS language FROM src WHERE NOT is_symlink AND {_SUFFIX} = '.sol' "
            f"AND NOT {_segments(fv.SOLIDITY_IGNORED_DIRS)}",
    "sold": "SELECT project, path, language, raw, octet_length(raw) AS bytes, TRY(decode(raw)) AS content, "
            "row_number() OVER (PARTITION BY project ORDER BY path) AS rn, "
            "count(*) OVER (PARTITION BY project) AS discovered FROM sol0",
    "sol": "SELECT * FROM sold WHERE content IS NOT NULL",
    "sollines": _lines("sol"),
    "solversion": r"SELECT project, path, content, nullif(trim(regexp_extract(content, "
                  rf"'pragma\s+solidity\s+([^;]+);', 1), {_BLANKS}), '') AS solidity_version FROM sol",
    "sol08": f"SELECT project, path, content, solidity_version, coalesce({_MINOR} >= 8, false) AS is_solidity_08_plus "
             "FROM solversion",
    "solmask0": f"SELECT project, path, list_transform(regexp_extract_all(content, {_TOKENS}), lambda t: "
                "CASE WHEN t LIKE '//%' OR t LIKE '/*%' THEN regexp_replace(t, '[^\\n]+', ' ', 'g') ELSE t END) AS ts FROM sol",
    "solmask": "SELECT project, path, array_to_string(ts, '') AS content FROM solmask0",
    "sm": f"SELECT project, path, line, n_lines, trim(text, {_BLANKS}) AS text, text AS raw_text FROM ({_lines('solmask')})",
    "solheads": r"""SELECT project, path, line, text, regexp_extract(text, '^(function|modifier)\b', 1) AS kind,
        raw_text, lead(line, 1, 1000000) OVER (PARTITION BY project, path ORDER BY line) AS next_head
        FROM sm WHERE regexp_matches(text, '^(function|modifier)\b')""",
    "solends": "SELECT project, path, line FROM sm WHERE raw_text = '    }'",
    "fns": r"""SELECT h.project, h.path, h.line AS line_start, h.kind, h.text,
        regexp_extract(h.text, '^\w+\s+(\w+)', 1) AS name,
        CASE WHEN h.text LIKE '%}' THEN h.line ELSE min(e.line) END AS line_end
        FROM solheads h LEFT JOIN solends e ON e.project = h.project AND e.path = h.path
         AND e.line > h.line AND e.line < h.next_head
        GROUP BY h.project, h.path, h.line, h.kind, h.text""",
    "calls0": f"SELECT project, path, line, text, {_CALL} AS call_type FROM sm",
    "calls": r"""SELECT project, path, line, text, call_type, call_type AS method,
        regexp_extract(text, '([\w.\[\]()]+\.\s*(?:call|delegatecall|staticcall|transfer|send))\s*[{(]', 1) AS callee,
        trim(regexp_extract(text, 'value\s*:\s*([^,}]+)', 1)) AS value
        FROM calls0 WHERE call_type IS NOT NULL""",
    "writes": f"SELECT project, path, line, n_lines, trim(text, {_BLANKS}) AS text FROM sollines WHERE {_write(chr(92) + ')')}",
    "writesx": f"SELECT project, path, line, n_lines, trim(text, {_BLANKS}) AS text FROM sollines "
               rf"WHERE {_write('[' + chr(92) + '])]')}",
    "firstcall": """SELECT f.project, f.path, f.name, f.line_start, f.line_end, min(c.line) AS call_line
        FROM fns f JOIN calls c ON c.project = f.project AND c.path = f.path
         AND c.line BETWEEN f.line_start AND f.line_end GROUP BY ALL""",
    "arith0": f"SELECT s.project, s.path, s.text, s.line FROM sollines s JOIN sol08 v USING (project, path) "
              f"WHERE NOT v.is_solidity_08_plus AND ({_UINT.replace('text', 's.text')} OR {_any('s.text', fv.COMPOUND_OPERATORS)}) "
              f"AND NOT {_any('s.text', ('SafeMath', '.add(', '.sub('))}",
    "arith1": f"SELECT project, path, line, text, unnest(regexp_extract_all(text, {_ARITH}, 1)) AS l, "
              f"unnest(regexp_extract_all(text, {_ARITH}, 2)) AS o, unnest(regexp_extract_all(text, {_ARITH}, 3)) AS r, "
              f"generate_subscripts(regexp_extract_all(text, {_ARITH}, 1), 1) AS n FROM arith0",
    "arith": f"SELECT project, path, CAST(n - 1 AS INT) AS nth, o AS operator, trim(l || ' ' || o || ' ' || r) AS operands, "
             f"line, {_UINT} AS on_uint FROM arith1",
    # files of every language the rules read, comments blanked
    "rul0": f"SELECT *, {_lang(fv.RULE_EXTENSIONS)} AS language FROM src WHERE NOT is_symlink",
    "rul1": "SELECT project, path, language, TRY(decode(raw)) AS content FROM rul0 WHERE language IS NOT NULL",
    "rul2": f"""SELECT project, path, language, content AS source, CASE WHEN language = 'py' THEN
        list_transform(regexp_extract_all(content, {_PY_TOKENS}), lambda t:
          CASE WHEN t LIKE '#%' THEN regexp_replace(t, '[^\\n]+', ' ', 'g') ELSE t END)
        ELSE list_transform(regexp_extract_all(content, {_TOKENS}), lambda t:
          CASE WHEN t LIKE '//%' OR t LIKE '/*%' THEN regexp_replace(t, '[^\\n]+', ' ', 'g') ELSE t END) END AS ts
        FROM rul1 WHERE content IS NOT NULL""",
    "rul": "SELECT project, path, language, regexp_matches(source, 'pragma\\s+solidity\\s+\\^0\\.8\\.\\w') AS new_pragma, "
           "array_to_string(ts, '') AS content FROM rul2",
    "rl0": f"SELECT project, path, language, new_pragma, line, text AS raw_text, trim(text, {_BLANKS}) AS text "
           f"FROM ({_lines('rul', ', language, new_pragma')})",
    "rl1": r"""SELECT *, CASE WHEN language = 'sol' THEN regexp_matches(text, '^(function|modifier)\b')
          WHEN language = 'py' THEN regexp_matches(raw_text, '^(async )?def ')
          WHEN language = 'mq5' THEN regexp_matches(raw_text, '^void ')
          ELSE regexp_matches(raw_text, '^(async )?function ') END AS is_head FROM rl0""",
    "rl": """SELECT *, max(CASE WHEN is_head THEN line END) OVER f AS fn,
        last_value(CASE WHEN is_head THEN text END IGNORE NULLS) OVER f AS head
        FROM rl1 WINDOW f AS (PARTITION BY project, path ORDER BY line)""",
    "findings": demo_findings.findings_sql(),
    "manifests": demo_findings.manifests_sql(),
    "patches": demo_findings.patches_sql(),
    "findex": demo_findings.foreign_index_sql(),
    "fprojects": demo_findings.foreign_projects_sql(),
    "lastpatch": "SELECT project, finding_id, arg_max(patch, pos) AS patch, arg_max(explanation, pos) AS explanation "
                 "FROM patches GROUP BY project, finding_id",
    "report": """SELECT f.*, p.patch, p.explanation FROM findings f
        LEFT JOIN lastpatch p ON p.project = f.project AND p.finding_id = f.id""",
}


#: Building blocks that several parts of a query read.
MATERIALIZED = {"nodes", "spans", "flow_body", "flow_reads", "flow_edges"}


def _needs(sql: str, names: list[str]) -> list[str]:
    found = []
    for n in names:
        if re.search(rf"\b{n}\b", sql):
            found.append(n)
    return found


def add(name: str, sql: str, **own: str) -> None:
    """Register ``sql`` with the building blocks it mentions, in their order."""
    blocks = {**CTES, **own}
    order = list(blocks)
    wanted, todo = set(), [sql]
    while todo:
        for n in _needs(todo.pop(), order):
            if n not in wanted:
                wanted.add(n)
                todo.append(blocks[n])
    with_ = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({blocks[n]})" for n in order if n in wanted)
    SQL[name] = f"WITH RECURSIVE {with_}\n{sql}" if with_ else sql


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- sources -----------------------------------------------------------------------

add("src_1_scan_corpus", f"""
    SELECT project, path, CASE WHEN NOT is_symlink THEN octet_length(raw) END AS size, is_symlink FROM src
    WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), {_list(fv.GENERAL_IGNORED_DIRS)})""")
add("src_2_scan_solidity", "SELECT project, path FROM sol0")
add("src_3_decode_files", "SELECT project, path, CASE WHEN content IS NULL THEN 'invalid_utf8' END AS error FROM dec")
add("src_4_project_metadata", """
    SELECT p.project, CASE WHEN json_valid(j.t) THEN json_extract_string(j.t, '$.name') END AS name,
      CASE WHEN json_valid(j.t) THEN json_extract_string(j.t, '$.version') END AS version, 'nodejs' AS language,
      CASE WHEN j.project IS NOT NULL THEN CASE WHEN json_valid(j.t) THEN json_extract_string(j.t, '$.name') END
           WHEN h.project IS NOT NULL THEN 'hardhat.config.js' WHEN f.project IS NOT NULL THEN 'foundry.toml' END
        AS solidity_name
    FROM (SELECT DISTINCT project FROM src) p
    LEFT JOIN (SELECT project, decode(raw) AS t FROM src WHERE path = 'package.json') j USING (project)
    LEFT JOIN (SELECT project FROM src WHERE path = 'hardhat.config.js') h USING (project)
    LEFT JOIN (SELECT project FROM src WHERE path = 'foundry.toml') f USING (project)""")
add("src_5_rule_results", """
    SELECT project, 'r' || idx % 7 AS rule_id, file_path, line_start, line_end, 'm' AS message, 'ERROR' AS severity,
      vulnerability_class FROM findings
    UNION ALL SELECT project, 'bare' || idx % 5, 'elsewhere.js', 0, 0, '', 'WARNING', '' FROM findings""")
add("src_7_load_patches", """
    SELECT project, id AS finding_id, 'a' || idx AS patch, 'one' AS explanation, idx AS response, 0 AS nth FROM findings
    UNION ALL SELECT project, id, 'b' || idx, NULL, idx, 1 FROM findings""")

# --- filters and projections ----------------------------------------------------------

add("flt_1_prune_dirs", f"SELECT project, path FROM src WHERE NOT {_segments((*fv.GENERAL_IGNORED_DIRS, 'contracts'))}")
add("flt_2_language", f"SELECT * FROM (SELECT project, path, {_lang(fv.GENERAL_EXTENSIONS)} AS language FROM src) "
    "WHERE language IS NOT NULL")
add("flt_3_skip_symlinks", "SELECT project, path FROM src WHERE NOT is_symlink")
add("flt_4_oversize", f"SELECT project, path, CASE WHEN bytes > {fv.SOLIDITY_MAX_BYTES} THEN 'file_too_large' "
    f"ELSE 'invalid_utf8' END AS error FROM sold WHERE bytes > {fv.SOLIDITY_MAX_BYTES} OR content IS NULL")
add("flt_5_is_test", f"SELECT project, path, {_any('path', fv.GENERAL_TEST_MARKERS)} AS general, "
    f"{_any('path', fv.SOLIDITY_TEST_MARKERS)} AS solidity FROM src")
add("flt_6_is_third_party", f"SELECT project, path, {_any('path', fv.GENERAL_THIRD_PARTY_MARKERS)} AS general, "
    f"{_any('path', fv.SOLIDITY_THIRD_PARTY_MARKERS)} AS solidity FROM src")
add("flt_7_relative_path", "SELECT project, path_relative, coalesce(path_relative <> '' AND left(path_relative, 1) "
    "NOT IN ('/', '~', chr(92)) AND NOT regexp_matches(path_relative, '^[a-zA-Z]:[\\\\/]'), false) AS is_relative FROM findex")
add("flt_8_leaked_path", "SELECT project, idx, code_snippet FROM findings WHERE contains(code_snippet, '/home/') "
    "OR contains(code_snippet, '/root/') OR contains(code_snippet, '/Users/') OR regexp_matches(code_snippet, '[a-zA-Z]:\\\\')")
add("flt_9_has_solidity", "SELECT project, path FROM gen WHERE project IN (SELECT project FROM gen WHERE language = 'sol')")
add("flt_10_root_relative", "SELECT project, CASE WHEN length(path) % 3 <> 0 THEN '/work/' || project || '/' ELSE '' END "
    "|| path AS absolute, path AS relative FROM src")
add("prj_1_web3_severity", f"SELECT project, idx, coalesce({_map(fv.WEB3_SEVERITIES)}[vulnerability_class], 'MEDIUM') "
    "AS severity FROM findings")
_ABBR = (f"coalesce({_map(fv.CLASS_ABBREVIATIONS)}[vulnerability_class], "
         "upper(left(regexp_replace(vulnerability_class, '[^A-Za-z0-9]', '', 'g'), 6)))")
add("prj_2_abbreviation", f"SELECT project, idx, {_ABBR} AS abbreviation, "
    f"coalesce({_map(fv.WEB3_ABBREVIATIONS)}[vulnerability_class], 'UNKN') AS web3_abbreviation FROM findings")
add("prj_3_finding_id", f"SELECT project, idx, printf('FSA-%s-%03d', {_ABBR}, greatest(idx - 50, 0)) AS id FROM findings")
add("prj_4_confidence", "SELECT project, idx, coalesce(confidence, 0.5) AS confidence FROM findings")
add("prj_6_report_projection", "SELECT project, idx, id, file_path, line_start, line_end, vulnerability_class, severity, "
    "description, patch, explanation FROM report")
add("prj_7_suggestion_path", "SELECT project, idx, file_path || '.suggestion-' || "
    "CASE WHEN idx % 5 <> 0 THEN id ELSE 'patch' END || '.txt' AS suggestion FROM findings")
add("prj_8_project_identifier", "SELECT DISTINCT project, sha256(project) AS project_identifier FROM src")
add("prj_10_contract_fields", f"""
    SELECT field, value, count(*) AS n, CASE field WHEN 'severity' THEN value IN {_in(fv.SEVERITIES)}
      WHEN 'vulnerability_class' THEN value IN {_in(fv.VULNERABILITY_CLASSES)}
      ELSE value IN {_in(fv.FALSE_POSITIVE_RISKS)} END AS allowed
    FROM (SELECT 'severity' AS field, severity AS value FROM findings
          UNION ALL SELECT 'vulnerability_class', vulnerability_class FROM findings
          UNION ALL SELECT 'false_positive_risk', false_positive_risk FROM findings)
    WHERE value IS NOT NULL GROUP BY field, value""")
add("prj_11_utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")

# --- string functions ---------------------------------------------------------------------

_STRIPPED = (
    f"array_to_string(list_transform(regexp_extract_all(content, {_TOKENS}), lambda t: CASE WHEN t LIKE '//%' THEN '' "
    "WHEN t LIKE '/*%' THEN ' ' ELSE t END), '')"
)


def _no_line_ends(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, chr(10)), "
            "lambda l: rtrim(l, ' ' || chr(9))), chr(10))")


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


def _collapsed(x: str) -> str:
    return f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"


_NORMAL = _squeezed(_no_line_ends(_collapsed(_STRIPPED)))
for _name, _f in (("str_1_strip_comments", _STRIPPED), ("str_2_collapse_blanks", _collapsed("content")),
                  ("str_3_strip_line_ends", _no_line_ends("content")),
                  ("str_4_squeeze_newlines", _squeezed("content"))):
    add(_name, f"SELECT project, path, sha256({_f}) AS hash FROM ok")
add("str_5_explode_lines", f"SELECT project, path, line, text FROM ({_lines('ok')})")
add("str_6_pragma_version", "SELECT project, path, solidity_version FROM sol08")
add("str_7_is_08_plus", "SELECT project, path, is_solidity_08_plus FROM sol08")

CTES["norm"] = (f"SELECT project, path, language, octet_length(raw) AS original_size, {_NORMAL} AS stripped FROM kept")
add("prj_9_hash_and_sizes", "SELECT project, path AS path_relative, sha256(stripped) AS hash, original_size, "
    "strlen(stripped) AS stripped_size FROM norm")
add("audit_index_by_language", "SELECT project, language, count(*) AS files, CAST(sum(original_size) AS BIGINT) AS original_bytes, "
    "CAST(sum(strlen(stripped)) AS BIGINT) AS stripped_bytes, CAST(sum(original_size - strlen(stripped)) AS BIGINT) AS saved_bytes "
    "FROM norm GROUP BY project, language")

# --- facts ------------------------------------------------------------------------------------

_TRIM = f"trim(text, {_BLANKS})"
add("ext_1_line_calls", f"SELECT project, path, '' AS callee, {_CALL} AS method, {_CALL} AS call_type, '' AS value, "
    f"{_TRIM} AS text, line FROM sollines s WHERE {_CALL} IS NOT NULL".replace("trim(text", "trim(s.text"))
add("ext_2_statement_calls", "SELECT project, path, callee, method, call_type, value, text, line FROM calls")
add("ext_3_owner_modifiers", f"SELECT project, path, 'modifier' AS type, {_OWNERS} AS condition, line FROM sollines "
    f"WHERE {_OWNERS} <> ''")
_REQUIRED = r"regexp_extract(text, '\b((?:require|assert)\s*\(.*\))', 1)"
add("ext_4_auth_requirements", f"SELECT project, path, 'require' AS type, {_REQUIRED} AS condition, line FROM sm WHERE {_AUTH}")
add("ext_5_tx_origin", f"SELECT project, path, 'tx_origin' AS type, {_TRIM} AS condition, line FROM sollines "
    "WHERE contains(text, 'tx.origin')")
add("ext_6_oracle_uses", f"SELECT project, path, {_ORACLE} AS source, {_TRIM} AS identifier, line FROM sollines "
    f"WHERE {_ORACLE} IS NOT NULL")
add("ext_7_arithmetic_ops", "SELECT * FROM arith")
CTES["fnrows"] = r"""SELECT project, path, name,
      coalesce(nullif(regexp_extract(attrs, '\b(public|external|internal|private)\b', 1), ''), 'internal') AS visibility,
      coalesce(nullif(regexp_extract(attrs, '\b(pure|view|payable)\b', 1), ''), 'nonpayable') AS mutability,
      CASE WHEN contains(attrs, 'onlyOwner') THEN 'onlyOwner' ELSE '' END AS modifiers,
      replace(params, ', ', ';') AS parameters, line_start, CAST(line_end AS INT) AS line_end,
      kind || '_definition' AS node_type
    FROM (SELECT *, regexp_extract(text, '\(([^()]*)\)', 1) AS params,
                 regexp_extract(text, '^\w+\s+\w+\s*\([^()]*\)([^{]*)', 1) AS attrs FROM fns)"""
add("ext_8_functions", "SELECT *, mutability = 'payable' AS is_payable, visibility IN ('external', 'public') AS is_external "
    "FROM fnrows")
add("ext_9_state_variables", """
    SELECT project, path, CASE WHEN text LIKE 'mapping%' THEN 'balances' WHEN text LIKE '%FEE%' THEN 'FEE' ELSE 'owner' END AS name,
      CASE WHEN text LIKE 'mapping%' THEN 'mapping(address => uint)' WHEN text LIKE '%FEE%' THEN 'uint256' ELSE 'address' END AS type_name,
      CASE WHEN text LIKE '%public%' THEN 'public' ELSE 'internal' END AS visibility,
      contains(text, 'constant') AS is_constant, contains(text, 'immutable') AS is_immutable, line
    FROM sm WHERE line <= 6 AND raw_text LIKE '    %;' AND text NOT LIKE 'event%'""")
add("ext_10_modifiers", "SELECT project, path, name, parameters, line_start, line_end FROM fnrows "
    "WHERE node_type = 'modifier_definition'")
add("ext_11_events", r"SELECT project, path, regexp_extract(text, '^event\s+(\w+)', 1) AS name, "
    r"replace(regexp_extract(text, '\(([^)]*)\)', 1), ', ', ';') AS parameters, line FROM sm WHERE text LIKE 'event %'")
add("ext_12_flash_loan_markers", f"SELECT project, path, name AS function, line_start, CAST(line_end AS INT) AS line_end, "
    f"'{fv.FLASH_LOAN_NOTE}' AS note FROM fns WHERE name IN {_in(fv.FLASH_LOAN_RECEIVERS)}")


def _reentrancy(writes: str) -> str:
    return f"""SELECT f.project, f.path, f.name AS function, f.line_start, f.call_line AS external_call_line,
      min(w.line) AS state_write_line, arg_min(w.text, w.line) AS state_write_text, 'CRITICAL' AS severity
    FROM firstcall f JOIN {writes} w ON w.project = f.project AND w.path = f.path
      AND w.line >= f.call_line AND w.line < least(f.line_end, w.n_lines)
    GROUP BY f.project, f.path, f.name, f.line_start, f.call_line"""


CTES["risk"] = _reentrancy("writes")
CTES["riskx"] = _reentrancy("writesx")
_RISK = ("SELECT project, path, function, external_call_line, state_write_line, state_write_text, severity FROM ")
add("joi_2_reentrancy", _RISK + "risk")
add("joi_2_reentrancy_indexed", _RISK + "riskx")


def _count(table: str) -> str:
    return f"(SELECT count(*) FROM {table} x WHERE x.project = s.project AND x.path = s.path)"


CTES["capsol"] = "SELECT * FROM sold WHERE content IS NOT NULL"
_COUNTS = {
    "n_functions": "SELECT project, path FROM fns",
    "n_state_variables": "SELECT project, path FROM sm WHERE line <= 6 AND raw_text LIKE '    %;' AND text NOT LIKE 'event%'",
    "n_modifiers": "SELECT project, path FROM fns WHERE kind = 'modifier'",
    "n_events": "SELECT project, path FROM sm WHERE text LIKE 'event %'",
    "n_external_calls": "SELECT project, path FROM calls",
    "n_access_controls": f"SELECT project, path FROM sollines WHERE {_OWNERS} <> '' UNION ALL SELECT project, path FROM sm WHERE {_AUTH} "
                         "UNION ALL SELECT project, path FROM sollines WHERE contains(text, 'tx.origin')",
    "n_oracle_uses": f"SELECT project, path FROM sollines WHERE {_ORACLE} IS NOT NULL",
    "n_arithmetic_ops": "SELECT project, path FROM arith",
    "n_reentrancy_risk": "SELECT project, path FROM risk",
    "n_flash_loan_markers": f"SELECT project, path FROM fns WHERE name IN {_in(fv.FLASH_LOAN_RECEIVERS)}",
}
add("ext_13_nested_record", f"""
    SELECT s.project, s.path AS path_relative, sha256(s.raw) AS hash, s.bytes AS original_size,
      {_any('s.path', fv.SOLIDITY_TEST_MARKERS)} AS is_test_file, {_any('s.path', fv.SOLIDITY_THIRD_PARTY_MARKERS)} AS is_third_party,
      v.solidity_version, v.is_solidity_08_plus, {', '.join(f'coalesce({n}.n, 0) AS {n}' for n in _COUNTS)},
      coalesce(c.calls, '') AS calls, coalesce(r.risks, '') AS reentrancy
    FROM capsol s JOIN sol08 v USING (project, path)
    {' '.join(f'LEFT JOIN (SELECT project, path, count(*) AS n FROM ({q}) GROUP BY 1, 2) {n} USING (project, path)' for n, q in _COUNTS.items())}
    LEFT JOIN (SELECT project, path, string_agg(line || ':' || call_type, ',' ORDER BY line) AS calls FROM calls GROUP BY 1, 2) c USING (project, path)
    LEFT JOIN (SELECT project, path, string_agg(function || ':' || external_call_line || ':' || state_write_line, ',' ORDER BY line_start) AS risks
               FROM risk GROUP BY 1, 2) r USING (project, path)""")

# --- joins ----------------------------------------------------------------------------------------

add("joi_1_calls_in_functions", "SELECT f.project, f.path, f.name, f.line_start, CAST(f.line_end AS INT) AS line_end, c.line, c.call_type "
    "FROM fns f JOIN calls c ON c.project = f.project AND c.path = f.path AND c.line BETWEEN f.line_start AND f.line_end")
add("joi_3_report", "SELECT project, idx, id, patch, explanation FROM report")
_UNKNOWN = "findings f WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.project = f.code_project AND g.path = f.file_path)"
add("joi_4_unknown_files", f"SELECT code_project AS project, file_path, idx FROM {_UNKNOWN}")
add("joi_5_diff_snapshots", """
    SELECT project, path, CASE WHEN d NOT IN ('0', '1') THEN h END AS old_hash,
      CASE WHEN d IN ('4', '5') THEN reverse(h) WHEN d NOT IN ('2', '3') THEN h END AS new_hash,
      CASE WHEN d IN ('0', '1') THEN 'added' WHEN d IN ('2', '3') THEN 'removed' WHEN d IN ('4', '5') THEN 'modified'
        ELSE 'unchanged' END AS status
    FROM (SELECT project, path, sha256(raw) AS h, right(sha256(raw), 1) AS d FROM ok)""")

add("joi_5_changed_files", f"SELECT * FROM ({SQL['joi_5_diff_snapshots']}) WHERE status <> 'unchanged'")
add("joi_5_changed_directories", f"""
    SELECT project, dir, count(old_hash) AS files_before, count(new_hash) AS files_after,
      CASE WHEN count(old_hash) = 0 THEN 'added' WHEN count(new_hash) = 0 THEN 'removed' ELSE 'modified' END AS status,
      bool_or(i = len(names) - 1 AND status <> 'unchanged') AS own_changed
    FROM (SELECT *, array_to_string(names[1:i], '/') AS dir FROM (SELECT *, unnest(range(0, len(names))) AS i
      FROM (SELECT *, string_split(path, '/') AS names FROM ({SQL['joi_5_diff_snapshots']}))))
    GROUP BY project, dir HAVING bool_or(status <> 'unchanged')""")

# violations of the findings contract, one row each
_BAD_ID = "coalesce(NOT regexp_matches(id, '^FSA-[A-Z0-9]{3,10}-[0-9]{3,}$'), true)"
_CHECKS = (
    ("fix_principle", "B-000", "fix_principle IS NULL"),
    ("id", "B-007", _BAD_ID),
    ("line_start", "B-002", "NOT line_start >= 1"),
    ("line_end", "B-002", "line_start >= 1 AND line_end < line_start"),
    ("vulnerability_class", "B-004", f"vulnerability_class NOT IN {_in(fv.VULNERABILITY_CLASSES)}"),
    ("severity", "B-009", f"severity NOT IN {_in(fv.SEVERITIES)}"),
    ("code_snippet", "B-003", "length(code_snippet) > 4096"),
    ("code_snippet", "B-003", "contains(code_snippet, '/home/') OR regexp_matches(code_snippet, '[a-zA-Z]:\\\\')"),
    ("description", "B-010", "description = ''"),
    ("description", "B-010", "length(description) > 1000"),
    ("fix_principle", "B-010", "coalesce(fix_principle, '') = ''"),
    ("fix_principle", "B-010", "length(fix_principle) > 500"),
    ("confidence", "B-005", "confidence IS NOT NULL AND NOT confidence BETWEEN 0 AND 1"),
    ("false_positive_risk", "B-009", f"false_positive_risk NOT IN {_in(fv.FALSE_POSITIVE_RISKS)}"),
    ("related_finding_ids", "B-013", "bad_related"),
)
CTES["badfindings"] = " UNION ALL ".join(
    f"SELECT project, 'finding' AS entity, CAST(idx AS VARCHAR) AS idx, '{f}' AS field, '{r}' AS rule, 'ERROR' AS level "
    f"FROM findings WHERE {c}" for f, r, c in _CHECKS)
CTES["dups"] = f"""SELECT project, 'finding' AS entity, CAST(idx AS VARCHAR) AS idx, 'id' AS field, 'B-007' AS rule, 'ERROR' AS level
    FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY idx) AS nth FROM findings WHERE NOT {_BAD_ID}) WHERE nth > 1"""
CTES["heads"] = ("SELECT h.*, coalesce(c.n, 0) AS n FROM manifests h LEFT JOIN "
                 "(SELECT project, count(*) AS n FROM findings GROUP BY project) c USING (project)")
_HEAD_CHECKS = (
    ("contract_version", "B-011", "NOT regexp_matches(contract_version, '^1\\.[0-9]+\\.[0-9]+$')"),
    ("project_hash", "B-011", "NOT regexp_matches(project_hash, '^[a-f0-9]{64}$')"),
    ("generated_at", "B-011", "generated_at NOT LIKE '%T%Z'"),
    ("findings", "B-006", "n > 500"),
    ("scanner_version", "B-012", "scanner_version = ''"),
    ("files_analyzed", "B-012", "files_analyzed < 0"),
    ("target_tracks", "B-008", "tracks = ''"),
    ("target_tracks", "B-008", "contains(tracks, 'web9')"),
    ("preferred_model", "B-013", f"preferred_model NOT IN {_in(fv.PREFERRED_MODELS)}"),
)
CTES["badheads"] = " UNION ALL ".join(
    f"SELECT project, 'manifest' AS entity, project AS idx, '{f}' AS field, '{r}' AS rule, 'ERROR' AS level FROM heads WHERE {c}"
    for f, r, c in _HEAD_CHECKS)
CTES["badb"] = "SELECT * FROM badfindings UNION ALL SELECT * FROM dups UNION ALL SELECT * FROM badheads"
CTES["valid"] = "SELECT * FROM findings WHERE project NOT IN (SELECT project FROM badb)"
CTES["vreport"] = "SELECT * FROM report WHERE project NOT IN (SELECT project FROM badb)"
CTES["applicable"] = """SELECT r.*, project NOT IN (SELECT project FROM badb) AS is_valid FROM report r WHERE patch <> '' AND file_path <> ''
    AND EXISTS (SELECT 1 FROM src s WHERE NOT s.is_symlink AND s.project = r.code_project AND s.path = r.file_path)"""
add("joi_6_applicable_patches", "SELECT code_project AS project, idx, id, file_path, patch, is_valid FROM applicable")
_JOINED_CALLS = "SELECT project, path, callee, method, call_type, value, text, line FROM calls"
add("joi_7_external_calls", _JOINED_CALLS)
_FILE = "PARTITION BY project, path ORDER BY"
CTES["spans"] = f"""SELECT *, row_number() OVER ({_FILE} s NULLS FIRST, id NULLS FIRST) AS rn FROM (
    SELECT code_project AS project, file_path AS path, line_start + k AS s, line_end + 2 * k AS e, id || '-' || k AS id, patch || k AS patch
    FROM applicable, range(3) r(k))"""
CTES["walk"] = """SELECT DISTINCT project, path, 0::BIGINT AS rn, 0::BIGINT AS reach, false AS ok FROM spans UNION ALL
    SELECT o.project, o.path, o.rn, CASE WHEN o.s > w.reach AND o.e >= o.s THEN o.e ELSE w.reach END, coalesce(o.s > w.reach AND o.e >= o.s, false)
    FROM walk w JOIN spans o ON o.project = w.project AND o.path = w.path AND o.rn = w.rn + 1"""
CTES["accepted"] = f"SELECT o.*, lag(o.e, 1, 0) OVER ({_FILE} rn) AS before FROM spans o JOIN walk w USING (project, path, rn) WHERE w.ok"
add("joi_11_splice", """
    SELECT s.project, s.path, sha256(array_to_string(list_concat(
        flatten(coalesce(list(list_concat(list_slice(ls, before + 1, a.s - 1), string_split(patch, chr(10))) ORDER BY rn) FILTER (WHERE rn IS NOT NULL), [])),
        list_slice(any_value(ls), coalesce(max(e), 0) + 1, len(any_value(ls)))), chr(10))) AS hash,
      count(rn)::INTEGER AS applied, (any_value(n) - count(rn))::INTEGER AS rejected
    FROM (SELECT project, path, string_split(content, chr(10)) AS ls FROM rul1 WHERE content IS NOT NULL) s
    JOIN (SELECT project, path, count(*) AS n FROM spans GROUP BY ALL) t USING (project, path)
    LEFT JOIN accepted a ON a.project = s.project AND a.path = s.path GROUP BY s.project, s.path""")

# --- aggregations --------------------------------------------------------------------------------------

_KNOWN = f"({_lang(fv.GENERAL_EXTENSIONS)}) IS NOT NULL"
_FIRST_PRUNED = ("list_min(list_filter(generate_series(1, len(string_split(path, '/')) - 1), "
                 f"lambda i: list_contains({_list(fv.GENERAL_IGNORED_DIRS)}, string_split(path, '/')[i])))")
CTES["skips"] = (f"SELECT project, path, {_FIRST_PRUNED} AS at, CASE WHEN {_FIRST_PRUNED} IS NOT NULL THEN "
                 f"array_to_string(list_slice(string_split(path, '/'), 1, {_FIRST_PRUNED}), '/') END AS pruned, "
                 f"{_FIRST_PRUNED} IS NULL AND (is_symlink OR NOT {_KNOWN}) AS ignored FROM src")
CTES["ignored"] = ("SELECT project, count(DISTINCT pruned) AS ignored_dirs, count(*) FILTER (WHERE ignored) AS ignored_files "
                   "FROM skips GROUP BY project")
add("agg_2_total_ignored", "SELECT *, ignored_dirs + ignored_files AS total_ignored FROM ignored")
add("agg_1_scan_summary", f"""
    SELECT i.project, coalesce(c.total_files, 0) AS total_files, ignored_dirs + ignored_files AS total_ignored,
      coalesce(c.total_errors, 0) AS total_errors, CAST(coalesce(c.total_size_bytes, 0) AS BIGINT) AS total_size_bytes,
      coalesce(c.truncated, false) AS truncated
    FROM ignored i LEFT JOIN (SELECT project, count(*) FILTER (WHERE content IS NOT NULL) AS total_files,
      count(*) FILTER (WHERE content IS NULL) AS total_errors,
      sum(octet_length(raw)) FILTER (WHERE content IS NOT NULL) AS total_size_bytes,
      max(discovered) > {fv.GENERAL_MAX_FILES} AS truncated FROM capped GROUP BY project) c USING (project)""")
add("agg_3_solidity_summary", f"""
    SELECT project, count(*) FILTER (WHERE content IS NOT NULL) AS total_files, count(*) FILTER (WHERE content IS NULL) AS total_errors,
      count(*) FILTER (WHERE bytes > {fv.SOLIDITY_MAX_BYTES}) AS total_too_large, max(discovered) > {fv.SOLIDITY_MAX_FILES} AS truncated
    FROM sold GROUP BY project""")
_LEVELS = ", ".join(f"count(*) FILTER (WHERE lower(severity) = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
add("agg_4_severity_counts", f"SELECT project, count(*) AS total_findings, {_LEVELS} FROM findings GROUP BY project")
add("agg_5_first_call", "SELECT project, path, name AS function, line_start, call_line AS external_call_line FROM firstcall")
add("agg_6_truncated", f"""
    SELECT g.project, g.discovered, g.discovered > {fv.GENERAL_MAX_FILES} AS truncated, s.discovered AS sol_discovered,
      s.discovered > {fv.SOLIDITY_MAX_FILES} AS sol_truncated
    FROM (SELECT project, count(*) AS discovered FROM gen GROUP BY project) g
    LEFT JOIN (SELECT project, count(*) AS discovered FROM sol0 GROUP BY project) s USING (project)""")
add("agg_7_path_hash_map", "SELECT project, path, sha256(stripped) AS hash FROM norm")
add("agg_8_violation_counts", "SELECT project, rule, level, count(*) AS n FROM badb GROUP BY project, rule, level")
_HEAD_TEXT = ("'**Summary:** ' || count(*) || ' finding(s) -- ' || "
              + " || ', ' || ".join(f"count(*) FILTER (WHERE severity = '{s}') || ' {s.lower()}'" for s in fv.SEVERITIES) + " || '.'")
add("agg_9_markdown", f"""
    SELECT h.project, h.head || chr(10) || chr(10) || '| ID | Severity | File | Issue |' || chr(10) || '|----|----------|------|-------|'
      || coalesce(chr(10) || t.rows, '') AS body
    FROM (SELECT project, {_HEAD_TEXT} AS head FROM vreport GROUP BY project) h
    LEFT JOIN (SELECT project, string_agg('| ' || id || ' | ' || severity || ' | `' || file_path || '` | ' || vulnerability_class || ' |',
      chr(10) ORDER BY idx) AS rows FROM vreport WHERE patch <> '' GROUP BY project) t USING (project)""")
_OUTCOME = f"""SELECT project, CASE WHEN {demo_findings.FAILURES['parse']} THEN 'PARSE_ERROR' WHEN {demo_findings.FAILURES['index']} THEN 'INDEX_INVALID'
        WHEN project IN (SELECT project FROM badb) THEN 'MANIFEST_INVALID' WHEN n = 0 THEN 'NO_FINDINGS'
        WHEN m % 9 = 0 THEN 'AUDIT_FAILURE' WHEN m % 9 = 1 THEN 'CREDIT_EXHAUSTED' ELSE 'OK' END AS outcome FROM heads"""
add("agg_10_summary_line", "SELECT o.project, 'Audit status: ' || any_value(outcome) || '. Findings: total=' || count(f.project) || "
    + " || ".join(f"', {s.lower()}=' || count(*) FILTER (WHERE severity = '{s}')" for s in fv.SEVERITIES)
    + f" || '.' AS summary FROM ({_OUTCOME}) o LEFT JOIN findings f USING (project) GROUP BY o.project")
add("agg_11_audit_outcomes", f"""
    SELECT project, outcome, CASE WHEN outcome IN ('PARSE_ERROR', 'INDEX_INVALID', 'MANIFEST_INVALID') THEN 1
        WHEN outcome = 'AUDIT_FAILURE' THEN 2 ELSE 0 END AS exit_code
    FROM ({_OUTCOME})""")
add("agg_12_owner_rollup", f"SELECT owner, project, count(*) AS total_findings, {_LEVELS} FROM findings GROUP BY ROLLUP (owner, project)")

# --- windows, sorts, limits, set operations -------------------------------------------------------------

add("win_1_cap_files", f"SELECT project, path, rn > {fv.SOLIDITY_MAX_FILES} AS beyond_limit FROM sold")
add("win_2_finding_numbers", "SELECT project, file_path, line_start, vulnerability_class, idx, row_number() OVER "
    "(PARTITION BY project ORDER BY file_path, line_start, vulnerability_class, idx) AS seq FROM findings")
add("win_3_duplicate_ids", "SELECT *, 'id is used before' AS message FROM dups")
add("win_4_first_per_line", "SELECT project, path, line, call_type FROM calls")
add("win_5_block_spans", r"""
    SELECT project, path, line AS line_start, (SELECT max(e.line) FROM sm e WHERE e.project = s.project AND e.path = s.path AND e.raw_text = '}') AS line_end,
      text AS header FROM sm s WHERE text LIKE 'contract %'
    UNION ALL SELECT project, path, line_start, CAST(line_end AS INT), regexp_extract(text, '^[^{]*\{') FROM fns
    UNION ALL SELECT project, path, line, line, regexp_extract(text, '^[^{]*\{') FROM sm WHERE regexp_matches(text, '^if .*\{.*\}$')""")
add("win_6_last_patch", "SELECT * FROM lastpatch")
add("srt_1_sorted_index", "SELECT project, path FROM gen ORDER BY project, path")
add("lim_1_text_limits", "SELECT project, idx, " + ", ".join(
    f"length(left(code_snippet, {n})) AS at_{n}" for n in (200, 300, 400, 4096)) + " FROM findings")
add("set_1_access_controls", f"""
    SELECT project, path, 'modifier' AS type, {_OWNERS} AS condition, line, 0 AS part FROM sollines WHERE {_OWNERS} <> ''
    UNION ALL SELECT project, path, 'require', {_REQUIRED}, line, 1 FROM sm WHERE {_AUTH}
    UNION ALL SELECT project, path, 'tx_origin', {_TRIM}, line, 2 FROM sollines WHERE contains(text, 'tx.origin')""")
add("set_3_call_detectors", "SELECT call_type, 'statement' AS detector, count(*) AS n FROM calls GROUP BY call_type")

# --- rules -------------------------------------------------------------------------------------------------

_SCRIPT = "language IN ('js', 'ts', 'jsx', 'tsx')"
_SOL, _PY, _MQ = "language = 'sol'", "language = 'py'", "language = 'mq5'"


def _hit(where: str, more: str = "") -> str:
    """Single lines."""
    return (f"SELECT DISTINCT a.project, a.path, a.fn, a.line, a.line AS line_end FROM rl a WHERE {where} {more}")


def _earlier(pattern: str) -> str:
    return ("AND NOT EXISTS (SELECT 1 FROM rl g WHERE g.project = a.project AND g.path = a.path AND g.fn = a.fn "
            f"AND g.line < a.line AND regexp_matches(g.text, '{pattern}'))")


def _first_per_binding(inner: str, pattern: str, groups: tuple[int, ...]) -> str:
    """First line per function and binding."""
    keys = ", ".join(f"regexp_extract(a.text, '{pattern}', {g}) AS k{g}" for g in groups)
    return inner.replace("SELECT DISTINCT a.project, a.path, a.fn, a.line, a.line AS line_end",
                         f"SELECT project, path, fn, min(line) AS line, min(line) AS line_end FROM (SELECT a.project, a.path, a.fn, a.line, {keys}") \
        + f") GROUP BY project, path, fn, {', '.join(f'k{g}' for g in groups)}"


def _key(alias: str, pattern: str, groups) -> str:
    if groups is None:
        return "NULL"
    return " || '|' || ".join([f"regexp_extract({alias}.text, '{pattern}', {g})" for g in groups] or ["''"])


def _chain(where: str, steps, guards=(), more: str = "") -> str:
    """Steps in order within a function: from each first step, the earliest way through."""
    first, key = steps[0]
    sql = (f"SELECT DISTINCT a.project, a.path, a.fn, {_key('a', first, key)} AS k, a.line, a.line AS at "
           f"FROM rl a WHERE a.fn IS NOT NULL AND {where} AND regexp_matches(a.text, '{first}') {more}")
    for pattern, key in steps[1:]:
        same = f"AND {_key('n', pattern, key)} = c.k" if key is not None else ""
        sql = (f"SELECT c.project, c.path, c.fn, c.k, c.line, min(n.line) AS at FROM ({sql}) c JOIN rl n ON n.project = c.project "
               f"AND n.path = c.path AND n.fn = c.fn AND n.line > c.at AND regexp_matches(n.text, '{pattern}') {same} "
               f"{more.replace('a.', 'n.')} GROUP BY 1, 2, 3, 4, 5")
    tests = "".join(
        f" AND NOT EXISTS (SELECT 1 FROM rl g WHERE g.project = m.project AND g.path = m.path AND g.fn = m.fn AND {place} "
        f"AND regexp_matches(g.text, '{pattern}') AND {_key('g', pattern, key)} = m.k)" for pattern, key, place in guards)
    return f"SELECT m.project, m.path, m.fn, m.line, m.at AS line_end FROM ({sql}) m WHERE true{tests}"


_BETWEEN = "g.line > m.line AND g.line < m.at"
_BEFORE = "g.line < m.line"
_AFTER = "g.line > m.line"
_SET = r"([\w$.]+)\.balance\s*=[^=]"
_DEC = r"([\w$.]+)\.balance\s*-=\s*([\w$.]+)"
_SOLCALL = r"\.\s*call\s*\{[^}]*\}\s*\("
_SEND = r"broker\.send_order\s*\("


def _pay(name: str, ok: str) -> str:
    call = rf"(?:const\s+(\w+)\s*=\s*)?await\s+{name}\s*\("
    return _chain(_SCRIPT, [(call, (1,)), (r"[\w$.]+\.[\w$]+\s*-=", None)],
                  [(rf"if\s*\(\s*(\w+)\.status\s*!==\s*\"{ok}\"", (1,), _BETWEEN)])


_ASSIGN_ZERO = r"balances\[([\w.]+)\]\s*=\s*0\s*;"
_DECL = r"^uint\d*\s+(\w+)\s*;"
_RULES = (
    _first_per_binding(_hit(f"{_SCRIPT} AND a.head LIKE 'async function%' AND regexp_matches(a.text, '{_SET}')",
                            _earlier(r"if\s*\(\s*!\s*\w+\.session") + " " + _earlier(r"^require\s*\(")), _SET, (1,)),
    _hit(f"{_SCRIPT} AND regexp_matches(a.text, '{_DEC}') AND NOT regexp_matches(a.text, '^if\\s*\\(')",
         _earlier(r"^if\s*\(") + " " + _earlier(r"^require\s*\([^,]*\)\s*;")),
    _pay(r"stripe\.charges\.create", "succeeded"),
    _pay(r"flutterwave\.\w+", "success"),
    _chain(_SCRIPT, [(r"if\s*\(\s*([\w$.]+)\.balance\s*<\s*([\w$.]+)\s*\)", (1, 2)), (r"\bawait\s+[\w$.]+\s*\(", None), (_DEC, (1, 2))]),
    _hit(f"{_SCRIPT} AND regexp_matches(a.text, '^if\\s*\\(.*req\\.body\\.role\\b')"),
    _hit(f"{_SCRIPT} AND contains(a.text, 'req.body.isAdmin')"),
    _chain(_SCRIPT, [(r"const\s+(\w+)\s*=\s*req\.body\.amount\b", (1,)), (r"\.balance\s*-=\s*(\w+)", (1,))],
           [(r"if\s*\(\s*(\w+)\s*<=\s*0", (1,), _BETWEEN)]),
    _hit(f"{_SCRIPT} AND regexp_matches(a.text, '\\.status\\s*=\\s*\"completed\"') AND a.raw_text NOT LIKE '        %'"),
    _chain(_SOL, [(_SOLCALL, ()), (r"balances\[[^\]]+\]\s*-=", ())], more="AND a.head LIKE '% external %'"),
    _chain(_SOL, [(r"\(bool \w+,\)\s*=\s*([\w.]+)\.call\{value: \w+\}\(\"\"\)", (1,)), (_ASSIGN_ZERO, (1,))],
           [(_ASSIGN_ZERO, (1,), _BEFORE)]),
    _hit(f"{_SOL} AND regexp_matches(a.text, 'require\\s*\\(\\s*tx\\.origin\\s*==[^,]*\\)\\s*;')"),
    _hit(f"{_SOL} AND regexp_matches(a.text, 'if\\s*\\(\\s*tx\\.origin\\s*==')"),
    rf"""SELECT DISTINCT a.project, a.path, a.fn, a.line, a.line AS line_end FROM
        (SELECT *, unnest(regexp_extract_all(text, '(\w+)\s*\+\s*\w', 1)) AS x FROM rl WHERE {_SOL} AND NOT new_pragma) a
        JOIN rl d ON d.project = a.project AND d.path = a.path AND d.fn = a.fn AND d.line < a.line
         AND regexp_extract(d.text, '{_DECL}', 1) = a.x""",
    _first_per_binding(_hit(rf"{_SOL} AND a.head LIKE 'function withdraw%external%' AND NOT contains(a.head, 'onlyOwner') "
                            r"AND regexp_matches(a.text, '\.transfer\s*\(')",
                            _earlier(r"^require\s*\(\s*msg\.sender\s*==\s*owner\s*,")),
                       r"([\w.]+)\.transfer\s*\(([^,()]*)\)", (1, 2)),
    _chain(_SOL, [(r"\buint\s+(\w+)\s*=\s*balances\[([^\]]+)\]\s*;", (1, 2)), (_SOLCALL, None),
                  (r"balances\[([^\]]+)\]\s*=\s*(\w+)\s*-", (2, 1))]),
    _hit(rf"{_PY} AND regexp_matches(a.text, '{_SEND}symbol=\w+, volume=\w+, type=\w+\)')"),
    _chain(_PY, [(rf"^(\w+)\s*=\s*{_SEND}", (1,))],
           [(r"^if (\w+)\.retcode !=", (1,), _AFTER), (r"^if not (\w+):", (1,), _AFTER)]),
    _chain(_PY, [(r"^(\w+)\s*=\s*\w+\.\w+$", (1,)), (rf"{_SEND}.*\bvolume\s*=\s*(\w+)", (1,))],
           [(r"^if (\w+) <= 0", (1,), _BETWEEN), (r"^if (\w+) > \w", (1,), _BETWEEN)]),
    _chain(_PY, [(r"\bawait\s+[\w.]+\.\w+\s*\(", ()), (r"^self\.\w+\s*-=", ())],
           more="AND a.head LIKE 'async def%' AND a.raw_text NOT LIKE '        %'"),
    _hit(rf"{_PY} AND regexp_matches(a.text, '{_SEND}') AND regexp_matches(a.text, '[(,]\s*type\s*=') "
         r"AND NOT regexp_matches(a.text, '[(,]\s*(sl|stop_loss)\s*=')"),
    _hit(rf"{_MQ} AND regexp_matches(a.text, '^OrderSend\(([^,]+,){{6}}[^,]+\);')"),
    _hit(rf"{_MQ} AND regexp_matches(a.text, 'OrderSend\(([^,]+,){{5}}\s*0\s*,[^,]+\)')"),
)


def _rule_sql(i: int) -> str:
    return (f"SELECT '{CATALOGUE[i].rule_id}' AS rule_id, project, path AS file_path, line AS line_start, line_end "
            f"FROM ({_RULES[i]})")


for _i, _r in enumerate(CATALOGUE):
    add(f"rul_{_i + 1:02d}_{_r.rule_id.replace('-', '_')}", _rule_sql(_i))


def _rules_where(test) -> str:
    return " UNION ALL ".join(_rule_sql(i) for i, r in enumerate(CATALOGUE) if test(r))


add("rul_all", _rules_where(lambda r: True))
add("joi_8_rule_sequences", _rules_where(lambda r: len(r.steps) > 1))
add("joi_9_rule_scopes", _rules_where(lambda r: r.inside or r.not_inside or r.needs_guard))
_CATALOGUE_SQL = " UNION ALL ".join(
    "SELECT " + ", ".join(
        "NULL" if v is None else f"'{v}'" for v in
        (r.rule_id, r.track, r.vulnerability_class, r.severity, r.cwe, r.owasp, r.swc, ",".join(r.languages)))
    + f", {len(r.steps)}" for r in CATALOGUE)
CTES["catalogue"] = (
    "SELECT * FROM (" + _CATALOGUE_SQL + ") AS c(rule_id, track, vulnerability_class, severity, cwe, owasp, swc, languages, n_steps)")
CTES["matches"] = _rules_where(lambda r: True)
add("src_6_rule_catalogue", "SELECT c.*, coalesce(h.hits, 0) AS hits FROM catalogue c LEFT JOIN "
    "(SELECT rule_id, count(*) AS hits FROM matches GROUP BY rule_id) h USING (rule_id)")
_PROMOTED = (f"coalesce({_map(fv.CLASS_SEVERITIES)}[vulnerability_class], {_map(fv.WEB3_SEVERITIES)}[vulnerability_class], 'MEDIUM')")
add("joi_10_rule_lookup", f"SELECT vulnerability_class, cwe, count(*) AS n, {_PROMOTED} AS severity, {_ABBR} AS abbreviation "
    "FROM matches JOIN catalogue USING (rule_id) GROUP BY vulnerability_class, cwe")

# --- contract checks ---------------------------------------------------------------------------------------

_A_FILE = (
    ("path_relative", "A-004", "coalesce(path_relative, '') = ''"),
    ("path_relative", "A-004", "path_relative <> '' AND regexp_matches(path_relative, '^([a-zA-Z]:[\\\\/]|[\\\\/]|~)')"),
    ("language", "A-005", f"coalesce(language, '') NOT IN {_in(fv.LANGUAGES)}"),
    ("stripped_content", "A-003", "stripped_content IS NULL"),
    ("hash", "A-008", "hash = ''"),
    ("original_size", "A-008", "coalesce(original_size, -1) < 0"),
    ("stripped_size", "A-008", "stripped_size < 0"),
)
_A_PROJECT = (
    ("project_identifier", "A-006", "ERROR", "NOT regexp_matches(project_identifier, '^[a-f0-9]{64}$')"),
    ("files", "A-001", "ERROR", "n < 1"),
    ("files", "A-002", "ERROR", f"n > {fv.GENERAL_MAX_FILES}"),
    ("truncated", "A-007", "WARN", "truncated"),
)
CTES["afiles"] = " UNION ALL ".join(
    f"SELECT project, 'file' AS entity, path_relative AS idx, '{f}' AS field, '{r}' AS rule, 'ERROR' AS level FROM findex WHERE {c}"
    for f, r, c in _A_FILE)
CTES["aheads"] = ("SELECT p.*, coalesce(c.n, 0) AS n FROM fprojects p LEFT JOIN "
                  "(SELECT project, count(*) AS n FROM findex GROUP BY project) c USING (project)")
CTES["aprojects"] = " UNION ALL ".join(
    f"SELECT project, 'project' AS entity, project AS idx, '{f}' AS field, '{r}' AS rule, '{lv}' AS level FROM aheads WHERE {c}"
    for f, r, lv, c in _A_PROJECT)
CTES["bada"] = "SELECT * FROM afiles UNION ALL SELECT * FROM aprojects"
for _name, _codes in (("val_a1_a2_file_count", ("A-001", "A-002")), ("val_a4_relative_path", ("A-004",)),
                      ("val_a5_language", ("A-005",)), ("val_a6_project_identifier", ("A-006",)),
                      ("val_a7_truncated", ("A-007",)), ("val_a8_hash_and_sizes", ("A-008",))):
    add(_name, f"SELECT * FROM bada WHERE rule IN {_in(_codes)}")
add("val_a3_content", f"SELECT * FROM afiles WHERE rule = 'A-003' UNION ALL SELECT project, 'file', path, 'stripped_content', "
    f"'A-003', 'ERROR' FROM norm WHERE length(stripped) > {fv.MAX_CONTENT_CHARS}")
add("val_a9_valid_index", """
    SELECT p.project, count(b.rule) FILTER (WHERE level = 'ERROR') AS errors, count(b.rule) FILTER (WHERE level = 'WARN') AS warnings,
      count(b.rule) FILTER (WHERE level = 'ERROR') = 0 AS is_valid
    FROM fprojects p LEFT JOIN bada b USING (project) GROUP BY p.project""")
for _name, _codes in (("val_b0_required", ("B-000",)), ("val_b2_lines", ("B-002",)), ("val_b3_snippet", ("B-003",)),
                      ("val_b4_class", ("B-004",)), ("val_b5_confidence", ("B-005",)), ("val_b9_severity", ("B-009",)),
                      ("val_b10_texts", ("B-010",))):
    add(_name, f"SELECT * FROM badfindings WHERE rule IN {_in(_codes)}")
CTES["unknown"] = ("SELECT project, 'finding' AS entity, CAST(idx AS VARCHAR) AS idx, 'file_path' AS field, 'B-001' AS rule, 'ERROR' AS level "
                   f"FROM {_UNKNOWN}")
add("val_b1_known_file", "SELECT * FROM unknown")
add("val_b1_verdicts", """
    SELECT m.project, count(b.rule) FILTER (WHERE level = 'ERROR') AS errors, count(b.rule) FILTER (WHERE level = 'WARN') AS warnings,
      count(b.rule) FILTER (WHERE level = 'ERROR') = 0 AS is_valid
    FROM manifests m LEFT JOIN (SELECT * FROM badb UNION ALL SELECT * FROM unknown) b USING (project) GROUP BY m.project""")
add("val_b7_ids", "SELECT * FROM badfindings WHERE rule = 'B-007' UNION ALL SELECT * FROM dups")
for _name, _code in (("val_b6_count", "B-006"), ("val_b8_tracks", "B-008"), ("val_b11_header", "B-011"),
                     ("val_b12_metadata", "B-012")):
    add(_name, f"SELECT * FROM badheads WHERE rule = '{_code}'")
add("val_b13_request_metadata", "SELECT * FROM badheads WHERE rule = 'B-013' UNION ALL SELECT * FROM badfindings WHERE rule = 'B-013'")
add("val_b14_valid_manifest", "SELECT project, idx, id, coalesce(confidence, 0.5) AS confidence FROM valid")

# --- contract checks over JSON: own lists of (field, rule, problem, condition) on the document or element ``e`` ------------

_INT, _NUM, _STR = "('BIGINT', 'UBIGINT')", "('BIGINT', 'UBIGINT', 'DOUBLE')", "('VARCHAR')"


def _typed(field: str, rule: str, types: str, *more: tuple[str, str], missing: str = "", nullable: bool = False) -> list[tuple[str, ...]]:
    """A field's type, its presence if ``missing`` names a rule, and more conditions where the type is right."""
    name = field.rpartition(".")[2]
    kind = f"json_type(e, '$.{field}')"
    wrong = types if not nullable else types[:-1] + ", 'NULL')"
    found = [(name, missing, "missing", f"{kind} IS NULL")] if missing else []
    found.append((name, rule, "type", f"{kind} NOT IN {wrong}"))
    return found + [(name, more_rule or rule, problem, f"{kind} IN {types} AND ({test.replace('@', f'json_extract_string(e, {chr(39)}$.{field}{chr(39)})')})")
                    for problem, test, more_rule in ((*m, "")[:3] for m in more)]


def _outside(values) -> tuple[str, str]:
    return "value", f"@ NOT IN {_in(values)}"


_HEX = ("pattern", "NOT regexp_full_match(@, '[a-f0-9]{64}')")
_META, _REQ = "analysis_metadata", "request_metadata"
_JSON_CHECKS = {
    "A": {
        "payload": [
            *_typed("project_identifier", "A-006", _STR, _HEX, missing="A-006"),
            *_typed("files", "A-001", "('ARRAY')", ("minimum", "json_array_length(e, '$.files') = 0"), missing="A-001"),
            *_typed("truncated", "A-007", "('BOOLEAN')", ("truncated", "@ = 'true'")),
        ],
        "file": [
            *_typed("path_relative", "A-004", _STR, ("minimum", "@ = ''"), ("absolute", "regexp_matches(@, '^([a-zA-Z]:[\\\\/]|[\\\\/]|~)')"), missing="A-004"),
            *_typed("language", "A-005", _STR, _outside(fv.LANGUAGES), missing="A-005"),
            *_typed("hash", "A-008", _STR, ("minimum", "@ = ''"), missing="A-008"),
            *_typed("stripped_content", "A-003", _STR, missing="A-003"),
            *_typed("original_size", "A-008", _INT, ("minimum", "CAST(@ AS BIGINT) < 0"), missing="A-008"),
            *_typed("stripped_size", "A-008", _INT, ("minimum", "CAST(@ AS BIGINT) < 0"), missing="A-008"),
            *_typed("is_test_file", "A-008", "('BOOLEAN')"),
        ],
    },
    "B": {
        "payload": [
            *_typed("contract_version", "B-011", _STR, ("pattern", "NOT regexp_full_match(@, '1[.][0-9]+[.][0-9]+')"), missing="B-011"),
            *_typed("project_hash", "B-011", _STR, _HEX, missing="B-011"),
            *_typed("generated_at", "B-011", _STR, ("pattern", "NOT regexp_full_match(@, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]{8,}Z')"), missing="B-011"),
            *_typed("findings", "B-006", "('ARRAY')", missing="B-006"),
            *_typed(_META, "B-012", "('OBJECT')", missing="B-012"),
            *[(f, r, p, f"json_type(e, '$.{_META}') = 'OBJECT' AND {c}") for f, r, p, c in (
                *_typed(f"{_META}.scanner_version", "B-012", _STR, ("minimum", "@ = ''"), missing="B-012"),
                *_typed(f"{_META}.files_analyzed", "B-012", _INT, ("minimum", "CAST(@ AS BIGINT) < 0"), missing="B-012"),
                *_typed(f"{_META}.analysis_duration_seconds", "B-012", _NUM, ("minimum", "CAST(@ AS DOUBLE) < 0"), missing="B-012"),
                *_typed(f"{_META}.target_tracks", "B-008", "('ARRAY')", ("minimum", f"json_array_length(e, '$.{_META}.target_tracks') = 0"),
                        ("value", f"len(list_filter(from_json(json_extract(e, '$.{_META}.target_tracks'), '[\"JSON\"]'), "
                                  "lambda x: CAST(x AS VARCHAR) NOT IN ('\"web2\"', '\"web3\"', '\"quant\"'))) > 0"), missing="B-008"))],
            *_typed(_REQ, "B-013", "('OBJECT')", nullable=True),
            *_typed(f"{_REQ}.client_version", "B-013", _STR),
            *_typed(f"{_REQ}.user_id", "B-013", _STR),
            *_typed(f"{_REQ}.preferred_model", "B-013", _STR, _outside(fv.PREFERRED_MODELS)),
        ],
        "finding": [
            *_typed("id", "B-007", _STR, ("pattern", "NOT regexp_full_match(@, 'FSA-[A-Z0-9]{3,10}-[0-9]{3,}')"), missing="B-000"),
            *_typed("file_path", "B-010", _STR, ("minimum", "@ = ''"), missing="B-000"),
            *_typed("line_start", "B-002", _INT, ("minimum", "CAST(@ AS BIGINT) < 1"), missing="B-000"),
            *_typed("line_end", "B-002", _INT, ("minimum", "CAST(@ AS BIGINT) < 1"),
                    ("order", f"json_type(e, '$.line_start') IN {_INT} AND TRY_CAST(e->>'$.line_start' AS BIGINT) BETWEEN 1 AND 9999 "
                              "AND CAST(@ AS BIGINT) < TRY_CAST(e->>'$.line_start' AS BIGINT)"), missing="B-000"),
            *_typed("vulnerability_class", "B-004", _STR, _outside(fv.VULNERABILITY_CLASSES), missing="B-000"),
            *_typed("severity", "B-009", _STR, _outside(fv.SEVERITIES), missing="B-000"),
            *_typed("code_snippet", "B-003", _STR, ("maximum", "length(@) > 4096"), ("absolute", "contains(@, '/home/')"), missing="B-000"),
            *_typed("description", "B-010", _STR, ("minimum", "@ = ''"), ("maximum", "length(@) > 1000"), missing="B-000"),
            *_typed("fix_principle", "B-010", _STR, ("minimum", "@ = ''"), ("maximum", "length(@) > 500"), missing="B-000"),
            *_typed("confidence", "B-005", _NUM, ("minimum", "CAST(@ AS DOUBLE) < 0"), ("maximum", "CAST(@ AS DOUBLE) > 1"), nullable=True),
            *_typed("false_positive_risk", "B-009", _STR, _outside(fv.FALSE_POSITIVE_RISKS), nullable=True),
            *_typed("related_finding_ids", "B-013", "('ARRAY')",
                    ("value", "len(list_filter(from_json(json_extract(e, '$.related_finding_ids'), '[\"JSON\"]'), lambda x: coalesce(json_type(x), 'NULL') <> 'VARCHAR')) > 0"),
                    nullable=True),
        ],
    },
}
_JSON_ARRAYS = {"A": ("files", "file", "A-001"), "B": ("findings", "finding", "B-006")}
for _c, (_array, _entity, _code) in _JSON_ARRAYS.items():
    _low = _c.lower()
    CTES[f"jdocs_{_low}"] = f"SELECT project, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS e FROM ({demo_payloads.payloads_sql(_c)})"
    CTES[f"jelements_{_low}"] = (
        f"SELECT project, idx, json_extract(e, '$.{_array}[' || idx || ']') AS e FROM (SELECT project, e, "
        f"unnest(range(CAST(json_array_length(e, '$.{_array}') AS BIGINT))) AS idx FROM jdocs_{_low} WHERE json_type(e, '$.{_array}') = 'ARRAY')")
    _parts = [
        f"SELECT project, 'payload' AS entity, project AS idx, '{f}' AS field, '{r}' AS rule, "
        f"'{'WARN' if p == 'truncated' else 'ERROR'}' AS level, '{p}' AS problem FROM jdocs_{_low} WHERE json_type(e) = 'OBJECT' AND {c}"
        for f, r, p, c in _JSON_CHECKS[_c]["payload"]]
    _parts += [f"SELECT project, 'payload', project, 'payload', '{_c}-000', 'ERROR', CASE WHEN e IS NULL THEN 'malformed' ELSE 'type' END "
               f"FROM jdocs_{_low} WHERE coalesce(json_type(e), '') <> 'OBJECT'"]
    _parts += [
        f"SELECT project, '{_entity}', CAST(idx AS VARCHAR), '{f}', '{r}', 'ERROR', '{p}' FROM jelements_{_low} WHERE json_type(e) = 'OBJECT' AND {c}"
        for f, r, p, c in _JSON_CHECKS[_c][_entity]]
    _parts += [f"SELECT project, '{_entity}', CAST(idx AS VARCHAR), '{_array}', '{_code}', 'ERROR', 'type' FROM jelements_{_low} WHERE json_type(e) <> 'OBJECT'"]
    if _c == "B":
        _parts += ["SELECT project, 'finding', CAST(idx AS VARCHAR), 'id', 'B-007', 'ERROR', 'repeated' FROM (SELECT project, idx, row_number() OVER "
                   "(PARTITION BY project, e->>'$.id' ORDER BY idx) AS use FROM jelements_b WHERE json_type(e, '$.id') = 'VARCHAR' AND "
                   "regexp_full_match(e->>'$.id', 'FSA-[A-Z0-9]{3,10}-[0-9]{3,}')) WHERE use > 1"]
    CTES[f"jbad_{_low}"] = " UNION ALL ".join(_parts)
    add(f"val_json_{_low}_problems", f"SELECT * FROM jbad_{_low}")
    _owners = [("''", "NULL", "e", f"jdocs_{_low}"), (f"'{_array}.'", "idx", "e", f"jelements_{_low}")]
    if _c == "B":
        _owners += [(f"'{m}.'", "NULL", f"json_extract(e, '$.{m}')", "jdocs_b") for m in (_META, _REQ)]
    CTES[f"jkeys_{_low}"] = (
        "SELECT project, idx, parent || k AS path, json_extract(o, '$.' || k) AS value FROM (SELECT project, idx, parent, o, unnest(json_keys(o)) AS k FROM ("
        + " UNION ALL ".join(f"SELECT project, CAST({i} AS INTEGER) AS idx, {p} AS parent, {o} AS o FROM {t}" for p, i, o, t in _owners)
        + ") WHERE json_type(o) = 'OBJECT')")
MATERIALIZED |= {"jdocs_a", "jdocs_b", "jelements_a", "jelements_b"}
add("val_json_verdicts", " UNION ALL ".join(
    f"""SELECT d.project, '{c.upper()}' AS contract, count(b.rule) FILTER (WHERE level = 'ERROR') AS errors,
      count(b.rule) FILTER (WHERE level = 'WARN') AS warnings, count(b.rule) FILTER (WHERE level = 'ERROR') = 0 AS is_valid
    FROM jdocs_{c} d LEFT JOIN jbad_{c} b USING (project) GROUP BY d.project""" for c in "ab"))
add("val_json_valid_findings", """
    SELECT project, CAST(idx AS INTEGER) AS idx, e->>'$.id' AS id, e->>'$.file_path' AS file_path, e->>'$.vulnerability_class' AS vulnerability_class,
      e->>'$.severity' AS severity, e->>'$.code_snippet' AS code_snippet, e->>'$.description' AS description, e->>'$.fix_principle' AS fix_principle,
      e->>'$.false_positive_risk' AS false_positive_risk, CAST(e->>'$.line_start' AS BIGINT) AS line_start,
      CAST(e->>'$.line_end' AS BIGINT) AS line_end, coalesce(CAST(e->>'$.confidence' AS DOUBLE), 0.5) AS confidence,
      nullif(json_merge_patch('{}', json_object('note', e->'$.note', 'tag', e->'$.tag')), '{}') AS extra
    FROM jelements_b WHERE project NOT IN (SELECT project FROM jbad_b WHERE level = 'ERROR')""")
_UNKNOWN_PATHS = ("owner", "archive", "origin", "files.owner", "findings.note", "findings.tag", "analysis_metadata.host")
add("val_json_unknown_keys", " UNION ALL ".join(
    f"SELECT project, idx, path, CAST(value AS VARCHAR) AS value FROM jkeys_{c} WHERE path IN {_in(_UNKNOWN_PATHS)}" for c in "ab"))
_JSON_TYPES = {"VARCHAR": "string", "BIGINT": "integer", "UBIGINT": "integer", "DOUBLE": "number", "NULL": "null",
               "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}
add("prj_10_json_field_types", "SELECT u.*, w.type AS wanted FROM (" + " UNION ALL ".join(
    f"SELECT '{c.upper()}' AS contract, path, {_map(_JSON_TYPES)}[json_type(value)] AS type, count(*) AS n FROM jkeys_{c} GROUP BY ALL" for c in "ab")
    + ") u LEFT JOIN (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}')" for r in contracts.FIELDS) + ") w(contract, path, type) USING (contract, path)")

# --- signatures ------------------------------------------------------------------------------------------------

_RANK = {k: i for i, k in enumerate(NODE_PATTERNS, 1)}


def _node(kind: str) -> str:
    pattern, target, op = NODE_PATTERNS[kind]
    quoted = pattern.replace("'", "''")
    of = lambda g: f"regexp_extract(text, '{quoted}', {g})" if g else "''"
    return (f"SELECT project, path, fn AS head_line, regexp_extract(head, 'function\\s+(\\w+)', 1) AS fn, line, "
            f"line * 10 + {_RANK[kind]} AS seq, '{kind}' AS kind, {of(target)} AS target, {of(op)} AS op, text "
            f"FROM rl WHERE {_SCRIPT} AND fn IS NOT NULL AND NOT is_head AND regexp_matches(text, '{quoted}')")


CTES["nodes"] = " UNION ALL ".join(_node(k) for k in NODE_PATTERNS)
add("sig_0_fn_nodes", "SELECT project, path, fn, line, kind, target, op FROM nodes")
_SAME = "x.project = a.project AND x.path = a.path AND x.head_line = a.head_line"


def _sig(name: str, kind: str, where: str) -> str:
    return (f"SELECT a.project, a.path, a.fn, '{name}' AS vulnerability_class, a.line AS line_start, a.line AS line_end "
            f"FROM nodes a WHERE a.kind = '{kind}' AND {where}")


def _none(kinds: str, more: str = "AND x.seq < a.seq") -> str:
    return f"NOT EXISTS (SELECT 1 FROM nodes x WHERE {_SAME} AND x.kind IN ({kinds}) {more})"


def _pair(name: str, kind: str, link: str, where: str) -> str:
    """From a node to the first mutation after it that fits."""
    return f"""SELECT a.project, a.path, a.fn, '{name}' AS vulnerability_class, a.line AS line_start, a.to_line AS line_end
        FROM (SELECT s.*, min(m.line) AS to_line, min(m.seq) AS to_seq FROM nodes s JOIN nodes m ON m.project = s.project AND m.path = s.path
          AND m.head_line = s.head_line AND m.kind = 'state_mutation' AND m.seq > s.seq {link}
          WHERE s.kind = '{kind}' GROUP BY ALL) a WHERE {where}"""


_S = {
    "sig_1_double_spend": """SELECT v.project, v.path, v.fn, 'DOUBLE_SPEND' AS vulnerability_class, v.line AS line_start, min(m.line) AS line_end
        FROM (SELECT v.*, min(c.seq) AS call_seq FROM nodes v JOIN nodes c ON c.project = v.project AND c.path = v.path AND c.head_line = v.head_line
              AND c.kind = 'external_call' AND c.seq > v.seq WHERE v.kind = 'validation' AND v.op = '<' AND v.target LIKE '%.balance' GROUP BY ALL) v
        JOIN nodes m ON m.project = v.project AND m.path = v.path AND m.head_line = v.head_line AND m.kind = 'state_mutation'
          AND m.op = '-=' AND m.target = v.target AND m.seq > v.call_seq GROUP BY ALL""",
    "sig_2_broken_auth": _sig("BROKEN_AUTH", "state_mutation", _none("'auth'")),
    "sig_3_broken_access_control": _sig("BROKEN_ACCESS_CONTROL", "state_mutation", _none(
        "'ownership'", "AND x.seq < a.seq AND x.target = regexp_extract(a.target, '^(\\w+)', 1)")),
    "sig_4_privilege_escalation": _sig("PRIVILEGE_ESCALATION", "auth", "contains(a.text, 'req.body.')"),
    "sig_5_unchecked_external_call": _pair("UNCHECKED_EXTERNAL_CALL", "external_call", "", "a.target = '' OR " + _none(
        "'validation'", "AND x.seq > a.seq AND x.seq < a.to_seq AND regexp_matches(x.text, '\\b' || a.target || '\\b')")),
    "sig_6_settlement_bypass": _sig("SETTLEMENT_BYPASS", "lifecycle", _none("'settlement'")),
    "sig_7_financial_action_ordering": _sig("FINANCIAL_ACTION_ORDERING", "transfer", _none("'auth', 'settlement'")),
    "sig_8_invalid_state_transition": _sig("INVALID_STATE_TRANSITION", "lifecycle", "a.op = 'completed' AND " + _none("'settlement'")),
    "sig_9_missing_validation": _pair("MISSING_VALIDATION", "input", "AND regexp_matches(m.text, '\\b' || s.target || '\\b')", _none(
        "'validation'", "AND x.seq > a.seq AND x.seq < a.to_seq AND x.target = a.target AND regexp_matches(x.op, '[<>]')")),
    "sig_10_logic_flaw": _sig("LOGIC_FLAW", "state_mutation", _none("'auth', 'validation', 'ownership'", "")),
}
for _name, _sql in _S.items():
    add(_name, _sql)
add("sig_11_slippage_omission", f"SELECT project, path, 'SLIPPAGE_OMISSION' AS vulnerability_class, line AS line_start, line_end FROM ({_RULES[16]})")
_ACCESS = (f"SELECT project, path, line FROM sollines WHERE {_OWNERS} <> '' OR contains(text, 'tx.origin') "
           f"UNION ALL SELECT project, path, line FROM sm WHERE {_AUTH}")
CTES["access"] = _ACCESS
CTES["uses"] = f"SELECT project, path, {_ORACLE} AS source FROM sollines WHERE {_ORACLE} IS NOT NULL"
_IN_FN = "x.project = f.project AND x.path = f.path AND x.line BETWEEN f.line_start AND f.line_end"
_W = {
    "sig_12_web3_reentrancy": ("REENTRANCY", "SELECT project, path, external_call_line AS a, state_write_line AS b FROM risk"),
    "sig_13_web3_tx_origin_abuse": ("TX_ORIGIN_ABUSE", "SELECT project, path, line AS a, line AS b FROM sollines WHERE contains(text, 'tx.origin')"),
    "sig_14_web3_arithmetic_overflow": ("ARITHMETIC_OVERFLOW", "SELECT project, path, line AS a, line AS b FROM arith WHERE on_uint"),
    "sig_15_web3_flash_loan_oracle_manipulation": ("FLASH_LOAN_ORACLE_MANIPULATION", f"""
        SELECT project, path, line_start AS a, CAST(line_end AS INT) AS b FROM fns f WHERE name IN {_in(fv.FLASH_LOAN_RECEIVERS)}
        AND EXISTS (SELECT 1 FROM uses x WHERE x.project = f.project AND x.path = f.path AND source IN ('uniswap', 'balanceof'))
        AND NOT EXISTS (SELECT 1 FROM uses x WHERE x.project = f.project AND x.path = f.path AND source = 'twap')"""),
    "sig_16_web3_broken_access_control": ("BROKEN_ACCESS_CONTROL", f"""
        SELECT project, path, line_start AS a, CAST(line_end AS INT) AS b FROM fns f WHERE kind = 'function'
        AND regexp_matches(text, '\\b(external|public)\\b') AND NOT regexp_matches(text, '\\b(view|pure)\\b')
        AND EXISTS (SELECT 1 FROM calls x WHERE {_IN_FN}) AND NOT EXISTS (SELECT 1 FROM access x WHERE {_IN_FN})"""),
    "sig_17_web3_unchecked_external_call": ("UNCHECKED_EXTERNAL_CALL", """
        SELECT project, path, line AS a, line AS b FROM calls WHERE call_type IN ('call', 'send', 'delegatecall')
        AND NOT regexp_matches(text, '^[^{(]*=') AND NOT contains(text, ' = ') AND NOT regexp_matches(text, '^(require|assert|if|return)')"""),
}
for _name, (_cls, _sql) in _W.items():
    add(_name, f"SELECT project, path, '{_cls}' AS vulnerability_class, a AS line_start, b AS line_end FROM ({_sql})")
CTES["web3"] = " UNION ALL ".join(
    f"SELECT project, path, '{_cls}' AS vulnerability_class, a AS line_start, b AS line_end FROM ({_sql})" for _cls, _sql in _W.values())
_WSEV = f"coalesce({_map(fv.WEB3_SEVERITIES)}[vulnerability_class], 'MEDIUM')"
add("prj_5_web3_findings", f"""SELECT project, path AS file_path, line_start, line_end, vulnerability_class, {_WSEV} AS severity, '' AS code_snippet,
    '' AS description, '' AS fix_principle, CAST(0.7 AS DOUBLE) AS confidence, 'MEDIUM' AS false_positive_risk, 'web3' AS track FROM web3""")
add("set_2_merge_findings", f"""
    SELECT code_project AS project, file_path, line_start, vulnerability_class, severity, NULL AS track FROM findings
    UNION ALL SELECT project, path, line_start, vulnerability_class, {_WSEV}, 'web3' FROM web3""")

# --- signatures over flows ---------------------------------------------------------------------------------------

CTES["flow_files"] = demo_flows.flow_files_sql()
CTES["flow_lines"] = f"""SELECT project, path, line, text AS raw, trim(text) AS text, regexp_matches(text, '^(async )?function ') AS is_head
    FROM ({_lines('flow_files')})"""
CTES["flow_fns"] = r"""SELECT project, path, line AS fn, regexp_extract(text, 'function (\w+)', 1) AS name,
    string_split(regexp_extract(text, '\(([^)]*)\)', 1), ', ') AS params FROM flow_lines WHERE is_head"""
CTES["flow_body"] = r"""SELECT project, path, fn, line, mutated, owned, checks, awaits, bound, raw LIKE '        %' AS deep, var, text LIKE '% += %' AS updates,
      CASE WHEN var IS NULL THEN text ELSE regexp_extract(text, ' \+?= (.*)$', 1) END AS rhs,
      CASE WHEN var IS NOT NULL THEN 'd' || line WHEN text LIKE 'return%' THEN 'r' || fn END AS defines
    FROM (SELECT *, max(CASE WHEN is_head THEN line END) OVER (PARTITION BY project, path ORDER BY line) AS fn,
        nullif(regexp_extract(text, '^(?:const |let )?(\w+) \+?= ', 1), '') AS var,
        nullif(regexp_extract(text, '^(\w+)(\.\w+)*\.(balance|credits) -?\+?= ', 1), '') AS mutated,
        nullif(regexp_extract(text, '^if \((\w+)\.owner', 1), '') AS owned, text LIKE 'if (%' AS checks,
        contains(text, 'await ') AS awaits, nullif(regexp_extract(text, '^if \(([\w.]+) [<>]', 1), '') AS bound FROM flow_lines)
    WHERE NOT is_head"""
CTES["flow_defs"] = """SELECT project, path, fn, line, var, defines AS node FROM flow_body WHERE var IS NOT NULL
    UNION ALL SELECT project, path, fn, fn, unnest(params), 'p' || fn || '.' || (generate_subscripts(params, 1) - 1) FROM flow_fns"""
CTES["flow_called"] = r"""SELECT b.*, f.fn AS callee, f.params AS own_params, string_split(regexp_extract(rhs, '\b\w+\(([^)]*)\)', 1), ', ') AS passed
    FROM flow_body b JOIN flow_fns f ON f.project = b.project AND f.path = b.path AND f.name = regexp_extract(rhs, '\b(\w+)\(', 1)"""
CTES["flow_names"] = r"""SELECT *, CAST(NULL AS VARCHAR) AS target FROM (SELECT *, unnest(list_distinct(regexp_extract_all(rhs, '(?:^|[ (!])(req\.body\.\w+|[a-z]\w*)', 1)
        || CASE WHEN var IS NOT NULL AND (updates OR deep) THEN [var] ELSE [] END)) AS name FROM flow_body)
    UNION ALL SELECT * EXCLUDE (callee, own_params, passed), unnest(passed), 'p' || callee || '.' || (generate_subscripts(passed, 1) - 1) FROM flow_called"""
CTES["flow_reads"] = """SELECT n.*, CASE WHEN n.name LIKE 'req.body.%' THEN 'b' || n.fn || '.' || n.name ELSE coalesce(d.node, 'v' || n.fn || '.' || n.name) END AS node
    FROM flow_names n ASOF LEFT JOIN flow_defs d ON d.project = n.project AND d.path = n.path AND d.fn = n.fn AND d.var = n.name AND n.line > d.line
    UNION ALL SELECT * EXCLUDE (callee, own_params, passed), NULL, NULL, 'r' || callee FROM flow_called"""
CTES["flow_edges"] = """SELECT DISTINCT project, path, fn, line, node, coalesce(target, defines) AS dst FROM flow_reads WHERE coalesce(target, defines) IS NOT NULL"""
CTES["flow_copies"] = r"""SELECT project, path, fn, line, defines AS node, node AS dst FROM flow_reads
    WHERE var IS NOT NULL AND target IS NULL AND NOT deep AND NOT updates AND regexp_matches(rhs, '^[a-z]\w*;$')"""


def _reach(seeds: str, edges: str) -> str:
    return f"""SELECT DISTINCT project, path, source, home, node, pos FROM ({seeds})
        UNION SELECT s.project, s.path, s.source, s.home, e.dst, CASE WHEN e.fn = s.home THEN e.line ELSE s.pos END
        FROM flow_states s JOIN {edges} e ON e.project = s.project AND e.path = s.path AND e.node = s.node"""


_TOUCHED = """SELECT s.source, s.home, CASE WHEN r.fn = s.home THEN r.line ELSE s.pos END AS at, r.* FROM flow_states s
    JOIN flow_reads r ON r.project = s.project AND r.path = s.path AND r.node = s.node WHERE r.target IS NULL"""
add("sig_3_flow_broken_access_control", """
    SELECT a.project, a.path, f.name AS fn, 'BROKEN_ACCESS_CONTROL' AS vulnerability_class, a.line AS line_start, a.line AS line_end
    FROM flow_asked a JOIN flow_fns f ON f.project = a.project AND f.path = a.path AND f.fn = a.fn
    WHERE a.changes AND NOT EXISTS (SELECT 1 FROM flow_asked o WHERE o.project = a.project AND o.path = a.path AND o.fn = a.fn AND o.root = a.root
      AND NOT o.changes AND o.line < a.line)""",
    flow_states=_reach("SELECT project, path, node AS source, fn AS home, node, -1 AS pos FROM flow_reads "
                       "WHERE target IS NULL AND (name = mutated OR name = owned)", "flow_copies"),
    flow_ends="""SELECT * FROM flow_states s WHERE NOT EXISTS (SELECT 1 FROM flow_copies c WHERE c.project = s.project AND c.path = s.path
      AND c.node = s.node)""",
    flow_asked="""SELECT DISTINCT r.project, r.path, r.fn, r.line, coalesce(r.name = r.mutated, false) AS changes, e.node AS root FROM flow_reads r
      JOIN flow_ends e ON e.project = r.project AND e.path = r.path AND e.source = r.node
      WHERE r.target IS NULL AND (r.name = r.mutated OR r.name = r.owned)""")
add("sig_5_flow_unchecked_external_call", """
    SELECT c.project, c.path, f.name AS fn, 'UNCHECKED_EXTERNAL_CALL' AS vulnerability_class, c.line AS line_start, c.until AS line_end
    FROM flow_awaited c JOIN flow_fns f ON f.project = c.project AND f.path = c.path AND f.fn = c.fn
    WHERE NOT EXISTS (SELECT 1 FROM flow_touched t WHERE t.project = c.project AND t.path = c.path AND t.source = c.defines AND t.checks AND t.at <= c.until)""",
    flow_states=_reach("SELECT project, path, defines AS source, fn AS home, defines AS node, line AS pos FROM flow_body "
                       "WHERE awaits AND var IS NOT NULL", "flow_edges"),
    flow_touched=_TOUCHED,
    flow_awaited="""SELECT b.project, b.path, b.fn, b.line, b.defines, min(m.line) AS until FROM flow_body b JOIN flow_body m ON m.project = b.project
      AND m.path = b.path AND m.fn = b.fn AND m.line > b.line AND m.mutated IS NOT NULL WHERE b.awaits AND NOT b.checks GROUP BY ALL""")
add("sig_9_flow_missing_validation", """
    SELECT DISTINCT m.project, m.path, f.name AS fn, 'MISSING_VALIDATION' AS vulnerability_class, s.line AS line_start, m.line AS line_end,
      string_split(m.source, '.')[-1] AS field
    FROM flow_touched m JOIN flow_starts s ON s.project = m.project AND s.path = m.path AND s.source = m.source
    JOIN flow_fns f ON f.project = m.project AND f.path = m.path AND f.fn = m.home
    WHERE m.mutated IS NOT NULL AND NOT EXISTS (SELECT 1 FROM flow_touched c WHERE c.project = m.project AND c.path = m.path AND c.source = m.source
      AND c.bound = c.name AND (c.at < m.at OR c.at = m.at AND c.fn = m.fn AND c.line < m.line))""",
    flow_states=_reach("SELECT project, path, node AS source, fn AS home, node, -1 AS pos FROM flow_reads WHERE node LIKE 'b%' AND target IS NULL",
                       "flow_edges"),
    flow_touched=_TOUCHED,
    flow_starts="SELECT project, path, node AS source, fn, min(line) AS line FROM flow_reads WHERE node LIKE 'b%' AND target IS NULL GROUP BY ALL")

# --- sinks ---------------------------------------------------------------------------------------------------------

add("snk_1_report_json", """
    SELECT h.project, to_json({'project_hash': any_value(h.project_hash), 'scan_time': '2024-05-01T00:00:00Z',
      'status': CASE WHEN count(r.project) = 0 THEN 'NO_FINDINGS' ELSE 'OK' END,
      'summary': {'total_findings': count(r.project), 'critical': count(*) FILTER (WHERE severity = 'CRITICAL'),
        'high': count(*) FILTER (WHERE severity = 'HIGH'), 'medium': count(*) FILTER (WHERE severity = 'MEDIUM'),
        'low': count(*) FILTER (WHERE severity = 'LOW')},
      'findings': coalesce(list({'id': id, 'file_path': file_path, 'line_start': line_start, 'line_end': line_end,
        'vulnerability_class': vulnerability_class, 'severity': severity, 'description': description, 'patch': patch,
        'explanation': explanation} ORDER BY idx) FILTER (WHERE r.project IS NOT NULL), [])})::VARCHAR AS json
    FROM manifests h LEFT JOIN vreport r ON r.project = h.project WHERE h.project NOT IN (SELECT project FROM badb) GROUP BY h.project""")
add("snk_2_snapshot", "SELECT project, sha256(project) AS project_hash, '2024-05-01' AS last_scan, path, sha256(stripped) AS hash FROM norm")
add("snk_3_suggestions", "SELECT code_project AS project, file_path || '.suggestion-' || id || '.txt' AS suggestion_path, patch, is_valid FROM applicable")
