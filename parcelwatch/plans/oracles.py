r"""The named queries as DuckDB SQL, written set-wise and independently of the Spark plans.

RE2 has no look-arounds and no possessive repeats, so patterns are restated with ``\b`` and plain
repeats; ``\b`` is ASCII in RE2.
"""

from __future__ import annotations

from .. import rules
from ..sources.corpus import with_views

ORACLES: dict[str, str] = {}


def _re2(pattern: str) -> str:
    for java, re2 in (
        (rules.WB, r"\b"), (rules.WE, r"\b"), ("*+", "*"), ("++", "+"), ("}+", "}"),
        (r"\A", "^"), (r"\z", "$"),
    ):
        pattern = pattern.replace(java, re2)
    return pattern


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rx(pattern: str) -> str:
    return _q(_re2(pattern))


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_EXT = r"regexp_extract(path, '[^/](\.[^./]*)$', 1)"
_IS_CODE = (
    f"{_EXT} IN {_in(rules.CODE_EXTENSIONS)} AND NOT contains(path, 'node_modules')"
    + "".join(f" AND NOT ends_with(path, {_q(s)})" for s in rules.DECLARATION_SUFFIXES)
    + f" AND len(list_intersect(string_split_regex(path, '[\\\\/]'), {list(rules.TEST_SEGMENTS)})) = 0"
    + r" AND NOT regexp_matches(path, '\.(test|spec)\.[cm]?[jt]sx?$')"
)
_IS_TEXT = (
    f"lower({_EXT}) IN {_in(rules.TEXT_EXTENSIONS)} AND NOT contains(path, 'node_modules')"
)
_IS_BINARY = (
    f"lower({_EXT}) IN {_in(rules.BINARY_EXTENSIONS)} AND NOT contains(path, 'node_modules')"
)


def _evidence(line: str) -> str:
    return (
        f"substring(regexp_replace({line}, {_q('^' + rules.WS + '+|' + rules.WS + '+$')}, '', 'g'), 1, 200)"
    )


def _lines(name: str, condition: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT pkg, version, path, unnest(string_split(content, chr(10))) AS line,
    CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS n
  FROM package_files WHERE {condition})"""


# The two-state comment machine as a window: last constant effect, then the parity of toggles.
_COMMENT_STATE = r"""effect AS (
  SELECT *, contains(line, '*/') AS closes,
    contains(regexp_replace(line, '(?s)/\*.*?\*/', '', 'g'), '/*') AS opens FROM code_line),
const AS (
  SELECT *, CASE WHEN opens AND NOT closes THEN 1 WHEN closes AND NOT opens THEN 0 END AS fixed,
    CASE WHEN opens AND closes THEN 1 ELSE 0 END AS toggles FROM effect),
running AS (
  SELECT *, sum(toggles) OVER (PARTITION BY pkg, version, path ORDER BY n) AS up_to FROM const),
state AS MATERIALIZED (
  SELECT *, (coalesce(last_value(fixed IGNORE NULLS) OVER w, 0)
    + coalesce(last_value(up_to) OVER w, 0)
    - coalesce(last_value(CASE WHEN fixed IS NOT NULL THEN up_to END IGNORE NULLS) OVER w, 0)) % 2 = 1 AS inside
  FROM running
  WINDOW w AS (PARTITION BY pkg, version, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_STR = r"""(?:"[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`)"""
_CLEAN = rf"""(?s)^(?:/?(?:[^"'`/]|{_STR}))*/?$"""


def _static_rule(rule: rules.LineRule) -> str:
    if rule.rule_id == "exec":
        call = rf"exec{rules.WS}*\("
        matches = rf"(?:^|[^.0-9A-Za-z_]){call}"
        prefix = rf"(?s)^((?:.*?[^.0-9A-Za-z_])??){call}"
    else:
        matches = _re2(rule.pattern)
        prefix = rf"(?s)^(.*?){matches}"
    quoted = (
        f"(inside OR NOT regexp_matches(regexp_extract(line, {_q(prefix)}, 1), {_q(_CLEAN)}))"
        if rule.code_only else "false"
    )
    unless = f" AND NOT regexp_matches(line, {_rx(rule.unless)})" if rule.unless else ""
    cli = "coalesce(is_cli, false)" if rule.cli_expected else "false"
    return f"""SELECT pkg, version, 'static' AS scanner,
  CASE WHEN {cli} OR {quoted} THEN 'info' ELSE {_q(rule.severity)} END AS severity,
  {_q(rule.rule_id)} AS rule_id,
  CASE WHEN {cli} THEN {_q(rule.message + rules.CLI_SUFFIX)}
    WHEN {quoted} AND {_q(rule.severity)} <> 'info' THEN {_q(rule.message + rules.CONTEXT_SUFFIX)}
    ELSE {_q(rule.message)} END AS message,
  path AS file, n AS line, {_evidence("line")} AS evidence
FROM state LEFT JOIN pkg_flags USING (pkg, version)
WHERE regexp_matches(line, {_q(matches)}){unless}"""


_STATIC = (
    _lines("code_line", _IS_CODE) + ",\n" + _COMMENT_STATE + ",\nstatic_finding AS ("
    + "\nUNION ALL\n".join(_static_rule(r) for r in rules.STATIC_RULES) + ")"
)

_COUNTS = """CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS n_critical,
  CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS n_warning,
  CAST(count(*) FILTER (WHERE severity = 'info') AS BIGINT) AS n_info"""


def _with(views: list[str], ctes: str, body: str) -> str:
    """Planted views, further CTEs and a final select."""
    return with_views(views, ", " + ctes + "\n" + body) if ctes else with_views(views, body)


ORACLES["static_findings"] = _with(["package_files", "pkg_flags"], _STATIC, "SELECT * FROM static_finding")
ORACLES["static_summary"] = _with(
    ["package_files", "pkg_flags"], _STATIC,
    f"SELECT pkg, version, scanner, {_COUNTS} FROM static_finding GROUP BY ALL",
)
ORACLES["block_comment_lines"] = _with(
    ["package_files"], _lines("code_line", _IS_CODE) + ",\n" + _COMMENT_STATE,
    "SELECT pkg, version, path, n AS line, line AS text FROM state WHERE inside",
)

ORACLES["chunked_comment_lines"] = ORACLES["block_comment_lines"]

_ENTROPY = f"""file_entropy AS (
  SELECT pkg, version, path, -sum(p * log2(p)) AS entropy FROM (
    SELECT pkg, version, path, count(*) * 1.0 / any_value(size) AS p FROM (
      SELECT pkg, version, path, length(content) AS size, unnest(string_split(content, '')) AS ch
      FROM package_files WHERE {_IS_CODE} AND length(content) >= {rules.ENTROPY_MIN_LENGTH})
    GROUP BY pkg, version, path, ch)
  GROUP BY pkg, version, path)"""
ORACLES["entropy"] = _with(
    ["package_files"], _ENTROPY,
    "SELECT pkg, version, path, round(entropy, 6) AS entropy FROM file_entropy",
)

ORACLES["chunked_entropy"] = ORACLES["entropy"]

_KEYWORD = rf"\b(?:{'|'.join(rules.JS_KEYWORDS)})\b"
_ARRAY_RX = rf"(?s)^(.*?)(\[(?:{rules.WS}*{_STR}[,{rules.WS_CHARS}]*){{51}})(.*)$"


def _rotates(window: str) -> str:
    return "(" + " OR ".join(
        f"(regexp_matches({window}, {_q(a)}) AND regexp_matches({window}, {_q(b)}))"
        for a, b in rules.ROTATION_PAIRS
    ) + ")"


_OBFUSCATION = f"""{_lines("code_line", _IS_CODE)},
{_ENTROPY},
minified AS (
  SELECT pkg, version, path, content,
    len(list_filter(string_split(content, chr(10)), lambda x: length(x) > 500)) > 0
    AND regexp_matches(content, {_q(_KEYWORD)})
    AND len(regexp_extract_all(content, {_q(rules.OBFUSCATOR_NAME)})) <= 20 AS minified
  FROM package_files WHERE {_IS_CODE}),
big_array AS (
  SELECT pkg, version, path, right(regexp_extract(content, {_q(_ARRAY_RX)}, 1), 1000) AS before,
    substring(regexp_extract(content, {_q(_ARRAY_RX)}, 3), 1, 500) AS after
  FROM minified WHERE regexp_matches(content, {_q(_ARRAY_RX)})),
obfuscation_finding AS (
  SELECT pkg, version, 'obfuscation' AS scanner, CASE WHEN minified THEN 'info' ELSE 'warning' END AS severity,
    'hex-run' AS rule_id, concat('Hex-encoded string sequences detected', CASE WHEN minified THEN ' (in bundled code)' ELSE '' END) AS message,
    path AS file, n AS line, {_evidence("line")} AS evidence
  FROM code_line JOIN minified USING (pkg, version, path) WHERE regexp_matches(line, {_q(rules.HEX_RUN)})
  UNION ALL
  SELECT pkg, version, 'obfuscation', CASE WHEN minified THEN 'info' ELSE 'warning' END, 'base64-run',
    concat('Large base64-encoded blob (>500 chars)', CASE WHEN minified THEN ' (in bundled code)' ELSE '' END),
    path, n, {_evidence("line")}
  FROM code_line JOIN minified USING (pkg, version, path) WHERE regexp_matches(line, {_q(rules.BASE64_RUN)})
  UNION ALL
  SELECT pkg, version, 'obfuscation', 'info', 'long-line',
    concat('Very long line (', length(line), ' chars) — possible minification without source maps'), path, n, NULL
  FROM code_line WHERE length(line) > 1000
  UNION ALL
  SELECT pkg, version, 'obfuscation', CASE WHEN {_rotates("after")} OR {_rotates("before")} THEN 'critical' ELSE 'info' END,
    'string-array', CASE WHEN {_rotates("after")} OR {_rotates("before")}
      THEN 'Large string array (>50 elements) with obfuscation markers'
      ELSE 'Large string array (>50 elements) — appears to be a data table' END, path, NULL,
    CASE WHEN {_rotates("after")} OR {_rotates("before")}
      THEN 'String array with 50+ elements and rotation/encoding detected'
      ELSE 'String array with 50+ readable elements (keywords, identifiers, etc.)' END
  FROM big_array
  UNION ALL
  SELECT pkg, version, 'obfuscation',
    CASE WHEN minified THEN 'info' WHEN entropy >= 6.8 THEN 'critical' ELSE 'warning' END,
    CASE WHEN entropy >= 6.8 THEN 'entropy-critical' ELSE 'entropy-warning' END,
    concat(CASE WHEN entropy < 6.8 THEN 'Elevated' WHEN minified THEN 'High' ELSE 'Very high' END,
      ' Shannon entropy: ', printf('%.2f', entropy), ' (threshold: ', CASE WHEN entropy >= 6.8 THEN '6.8' ELSE '6.2' END, ') — ',
      CASE WHEN minified THEN 'appears to be minified code' WHEN entropy >= 6.8 THEN 'likely obfuscated' ELSE 'possible obfuscation' END),
    path, NULL, concat('File entropy: ', printf('%.2f', entropy), ' bits/char')
  FROM file_entropy JOIN minified USING (pkg, version, path) WHERE entropy >= 6.2)"""
ORACLES["obfuscation_findings"] = _with(
    ["package_files"], _OBFUSCATION, "SELECT * FROM obfuscation_finding"
)

_SECRETS = (
    _lines("text_line", _IS_TEXT) + ",\nsecret_finding AS ("
    + "\nUNION ALL\n".join(
        f"""SELECT pkg, version, 'secrets' AS scanner, {_q(r.severity)} AS severity, {_q(r.rule_id)} AS rule_id,
  {_q(r.message)} AS message, path AS file, n AS line,
  concat(left(found, 4), '****', right(found, 4)) AS evidence
FROM (SELECT *, unnest(regexp_extract_all(line, {_q(r.pattern)})) AS found FROM text_line)"""
        for r in rules.SECRET_RULES
    ) + ")"
)
ORACLES["secret_findings"] = _with(["package_files"], _SECRETS, "SELECT * FROM secret_finding")

# --- network indicators ---------------------------------------------------------------------

_IGNORED = f"list_value{_in(rules.IGNORED_DOMAINS)}"
_IOC = rf"""{_lines("text_line", _IS_TEXT)},
fragment AS (
  SELECT pkg, version, path, n, 0 AS step, NULL AS method, 0 AS nth_fragment, line AS text FROM text_line
  UNION ALL
  SELECT pkg, version, path, n, 1, 'hex', i, decode(unhex(replace(m, '\x', ''))) FROM (
    SELECT *, unnest(regexp_extract_all(line, {_rx(rules.HEX_ESCAPES)})) AS m,
      generate_subscripts(regexp_extract_all(line, {_rx(rules.HEX_ESCAPES)}), 1) AS i FROM text_line)
  UNION ALL
  SELECT pkg, version, path, n, 2, 'unicode', i, array_to_string(list_transform(
      regexp_extract_all(m, '\\u([0-9a-fA-F]{{4}})', 1), lambda x: chr(CAST(concat('0x', x) AS INTEGER))), '') FROM (
    SELECT *, unnest(regexp_extract_all(line, {_rx(rules.UNICODE_ESCAPES)})) AS m,
      generate_subscripts(regexp_extract_all(line, {_rx(rules.UNICODE_ESCAPES)}), 1) AS i FROM text_line)
  UNION ALL
  SELECT pkg, version, path, n, 3, 'charcode', i,
    array_to_string(list_transform(string_split(m, ','), lambda x: chr(CAST(trim(x) AS INTEGER))), '') FROM (
    SELECT *, unnest(regexp_extract_all(line, {_rx(rules.CHAR_CODES)}, 1)) AS m,
      generate_subscripts(regexp_extract_all(line, {_rx(rules.CHAR_CODES)}, 1), 1) AS i FROM text_line)
  UNION ALL
  SELECT pkg, version, path, n, 4, 'base64', i, t FROM (
    SELECT *, TRY(decode(from_base64(m))) AS t FROM (
      SELECT *, unnest(regexp_extract_all(line, {_rx(rules.BASE64_BLOB)})) AS m,
        generate_subscripts(regexp_extract_all(line, {_rx(rules.BASE64_BLOB)}), 1) AS i FROM text_line))
  WHERE length(t) >= 6 AND length(regexp_replace(t, '[^\x20-\x7e]', '', 'g')) / length(t) > 0.8),
indicator AS (
  SELECT pkg, version, path, n, step, method, nth_fragment, i, 'url' AS type,
    regexp_replace(m, {_rx(rules.URL_TRAILING)}, '') AS raw FROM (
    SELECT *, unnest(regexp_extract_all(text, {_rx(rules.URL_PATTERN)})) AS m,
      generate_subscripts(regexp_extract_all(text, {_rx(rules.URL_PATTERN)}), 1) AS i FROM fragment)
  UNION ALL
  SELECT pkg, version, path, n, step, method, nth_fragment, i, 'ipv4', m FROM (
    SELECT *, unnest(regexp_extract_all(text, {_rx(rules.IPV4_PATTERN)})) AS m,
      generate_subscripts(regexp_extract_all(text, {_rx(rules.IPV4_PATTERN)}), 1) AS i FROM fragment)),
hosted AS (
  SELECT *, CASE WHEN type = 'url' THEN lower(regexp_extract(raw, '^[a-z]+://(?:[^/?#]*@)?([^/:?#]+)', 1)) END AS host,
    CASE WHEN type = 'url' THEN lower(raw) ELSE raw END AS key FROM indicator),
sighting AS MATERIALIZED (
  SELECT * FROM hosted WHERE CASE WHEN type = 'url'
    THEN len(list_filter({_IGNORED}, lambda d: host = d OR ends_with(host, concat('.', d)))) = 0
    ELSE raw NOT IN {_in(rules.IGNORED_IPS)} END),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY pkg, version, type, key ORDER BY path, n, step, nth_fragment, i) AS INTEGER) AS nth_location
  FROM sighting),
location AS (
  SELECT pkg, version, type, key, method, nth_location, path AS file, n AS line,
    CASE WHEN type = 'ipv4' THEN replace(raw, '.', '[.]')
      ELSE concat(CASE WHEN raw LIKE 'https%' THEN 'hxxps' WHEN raw LIKE 'http%' THEN 'hxxp' ELSE 'fxp' END, '[://]',
        replace(regexp_extract(raw, '://([^/]*)', 1), '.', '[.]'), regexp_extract(raw, '://[^/]*(.*)$', 1)) END AS defanged
  FROM ranked WHERE nth_location <= 5),
ioc_finding AS (
  SELECT pkg, version, 'ioc' AS scanner, CASE WHEN method IS NULL THEN 'info' ELSE 'warning' END AS severity, type AS rule_id,
    concat(CASE WHEN method IS NULL THEN concat('External ', label) ELSE concat(label, ' (', method, '-decoded)') END, ': ', defanged) AS message,
    file, line, nullif(concat_ws('; ', CASE WHEN method IS NOT NULL THEN concat('Decoded from ', method, ' obfuscation') END,
      CASE WHEN found > 1 THEN concat('Found in ', found, ' location(s)') END), '') AS evidence
  FROM (SELECT *, CASE WHEN type = 'url' THEN 'URL' ELSE 'IP' END AS label,
      count(*) OVER (PARTITION BY pkg, version, type, key) AS found FROM location)
  WHERE nth_location = 1)"""
_OWN_LIST = """own_host AS (SELECT DISTINCT host AS h FROM hosted JOIN own_domain ON host = lower(domain) OR ends_with(host, concat('.', lower(domain)))),
sighting AS MATERIALIZED (
  SELECT * FROM hosted WHERE (host IS NULL OR host NOT IN (SELECT h FROM own_host)) AND"""
ORACLES["ioc_own_list"] = _with(
    ["package_files", "own_domain"],
    _IOC.replace("sighting AS MATERIALIZED (\n  SELECT * FROM hosted WHERE", _OWN_LIST),
    "SELECT * FROM ioc_finding",
)
ORACLES["ioc_findings"] = _with(["package_files"], _IOC, "SELECT * FROM ioc_finding")
ORACLES["ioc_locations"] = _with(["package_files"], _IOC, "SELECT * FROM location")
ORACLES["long_line_locations"] = ORACLES["ioc_locations"]
ORACLES["ioc_counts"] = _with(
    ["package_files"], _IOC,
    """SELECT pkg, version, CAST(count(DISTINCT CASE WHEN type = 'url' THEN key END) AS BIGINT) AS n_urls,
  CAST(count(DISTINCT CASE WHEN type = 'ipv4' THEN key END) AS BIGINT) AS n_ips FROM sighting GROUP BY ALL""",
)

# --- manifests ------------------------------------------------------------------------------


def _hooks(source: str) -> str:
    shell = " OR ".join(f"contains(lower(command), {_q(c)})" for c in rules.SHELL_COMMANDS)
    return f"""hook_finding AS (
  SELECT pkg, version, 'hooks' AS scanner,
    CASE WHEN name = 'prepare' THEN 'info' WHEN {shell} THEN 'critical' ELSE 'warning' END AS severity, name AS rule_id,
    concat('"', name, '"', CASE WHEN name = 'prepare' THEN ' script defined: '
      WHEN {shell} THEN ' script executes shell commands: ' ELSE ' lifecycle script defined: ' END, command) AS message,
    'package.json' AS file, CAST(NULL AS INTEGER) AS line, command AS evidence
  FROM {source} WHERE name IN ('prepare', {_in(rules.LIFECYCLE_HOOKS)[1:-1]}))"""


ORACLES["hook_findings"] = _with(["script"], _hooks("script"), "SELECT * FROM hook_finding")
ORACLES["hook_summary"] = _with(
    ["script"], _hooks("script"),
    """SELECT pkg, version, CASE WHEN count(*) FILTER (WHERE severity <> 'info') = 0 THEN 'Only benign lifecycle hooks (prepare)'
  ELSE concat('Lifecycle hooks: ', string_agg(rule_id, ', ' ORDER BY rule_id) FILTER (WHERE severity <> 'info'),
    CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0
      THEN concat(' (', count(*) FILTER (WHERE severity = 'critical'), ' with shell commands)') ELSE '' END) END AS summary
FROM hook_finding GROUP BY ALL""",
)


def _dependencies(source: str) -> str:
    return rf"""dep_count AS (
  SELECT pkg, version, CAST(count(*) FILTER (WHERE kind = 'direct') AS BIGINT) AS n_direct,
    CAST(count(*) FILTER (WHERE kind = 'optional') AS BIGINT) AS n_optional FROM {source} GROUP BY ALL),
dep_merged AS (
  SELECT pkg, version, name, spec FROM {source} WHERE kind = 'optional'
  UNION ALL
  SELECT d.pkg, d.version, d.name, d.spec FROM {source} d ANTI JOIN (SELECT * FROM {source} WHERE kind = 'optional') o
    USING (pkg, version, name) WHERE d.kind = 'direct'),
dep_finding AS (
  SELECT pkg, version, 'dependencies' AS scanner, CASE WHEN total > 50 THEN 'critical' ELSE 'warning' END AS severity, 'count' AS rule_id,
    CASE WHEN total > 50 THEN concat('Extreme dependency count: ', total, ' dependencies (threshold: 50) — dependency bloat')
      ELSE concat('High dependency count: ', total, ' dependencies (threshold: 20)') END AS message,
    'package.json' AS file, CAST(NULL AS INTEGER) AS line, concat(n_direct, ' direct + ', n_optional, ' optional') AS evidence
  FROM (SELECT *, n_direct + n_optional AS total FROM dep_count) WHERE total > 20
  UNION ALL
  SELECT pkg, version, 'dependencies', 'critical', 'unpinned', concat('Unpinned dependency: ', name, '@"', spec, '" — accepts any version'),
    'package.json', NULL, concat('"', name, '": "', spec, '"') FROM dep_merged WHERE spec IN ('*', '', 'latest')
  UNION ALL
  SELECT pkg, version, 'dependencies', 'warning', 'git-url', concat('Git URL dependency: ', name, ' — not pinned to npm registry'),
    'package.json', NULL, concat('"', name, '": "', spec, '"') FROM dep_merged
  WHERE spec NOT IN ('*', '', 'latest') AND (starts_with(spec, 'git://') OR starts_with(spec, 'git+http://') OR starts_with(spec, 'git+https://')
    OR starts_with(spec, 'gitssh://') OR starts_with(spec, 'github:') OR starts_with(spec, 'gitlab:') OR starts_with(spec, 'bitbucket:')
    OR regexp_matches(spec, '^https?://.*\.git$') OR regexp_matches(spec, '^[a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+')))"""


ORACLES["dependency_counts"] = _with(["dependency"], _dependencies("dependency"), "SELECT * FROM dep_count")
ORACLES["dependency_findings"] = _with(["dependency"], _dependencies("dependency"), "SELECT * FROM dep_finding")

_BINARIES = f"""binary_finding AS (
  SELECT pkg, version, 'binaries' AS scanner, 'warning' AS severity, substring(lower({_EXT}), 2) AS rule_id,
    concat('Binary file found: ', lower({_EXT}), ' (cannot be source-reviewed)') AS message, path AS file,
    CAST(NULL AS INTEGER) AS line, regexp_extract(path, '[^/]*$') AS evidence
  FROM package_files WHERE {_IS_BINARY})"""
ORACLES["binary_findings"] = _with(["package_files"], _BINARIES, "SELECT * FROM binary_finding")
ORACLES["binary_summary"] = _with(
    ["package_files"], _BINARIES,
    """SELECT pkg, version, CAST(sum(n) AS BIGINT) AS n_files,
  concat(sum(n), ' binary file(s): ', string_agg(concat(n, ' .', rule_id), ', ' ORDER BY rule_id)) AS summary
FROM (SELECT pkg, version, rule_id, count(*) AS n FROM binary_finding GROUP BY ALL) GROUP BY ALL""",
)

# --- names ----------------------------------------------------------------------------------

def _names(source: str) -> str:
    return rf"""asked AS (SELECT DISTINCT name, lower(regexp_replace(name, '^@[^/]+/', '')) AS bare FROM {source}),
listed AS (SELECT name, ord, lower(regexp_replace(name, '^@[^/]+/', '')) AS bare FROM popular),
near AS (
  SELECT a.name, l.name AS popular_name, l.ord, CAST(levenshtein(a.bare, l.bare) AS INTEGER) AS distance
  FROM asked a JOIN listed l ON levenshtein(a.bare, l.bare) <= 2
  WHERE a.bare NOT IN (SELECT bare FROM listed))"""


ORACLES["typosquat_pairs"] = _with(["popular", "candidate_names"], _names("candidate_names"), "SELECT * FROM near")
ORACLES["typosquat_summary"] = _with(
    ["popular", "candidate_names"], _names("candidate_names"),
    """SELECT a.name, n.shown IS NULL AS passed,
  CASE WHEN bare IN (SELECT bare FROM listed) THEN concat('"', a.name, '" is a known popular package')
    WHEN n.shown IS NOT NULL THEN concat('Similar to: ', n.shown) ELSE 'No similar popular package names' END AS summary
FROM asked a LEFT JOIN (SELECT name, string_agg(concat('"', popular_name, '" (dist ', distance, ')'), ', ' ORDER BY distance, ord) AS shown
  FROM near GROUP BY name) n USING (name)""",
)
_TYPOSQUAT = _names("release_name") + """,
typosquat_finding AS (
  SELECT pkg, version, 'typosquatting' AS scanner, CASE WHEN distance <= 1 THEN 'critical' ELSE 'warning' END AS severity, popular_name AS rule_id,
    concat('Package name "', name, '" is ', distance, ' edit(s) from popular package "', popular_name, '"') AS message,
    CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, concat('Levenshtein distance: ', distance) AS evidence
  FROM release_name JOIN near USING (name))"""
ORACLES["typosquat_findings"] = _with(["popular", "release_name"], _TYPOSQUAT, "SELECT * FROM typosquat_finding")

# --- source comparison ----------------------------------------------------------------------

_COMPARED = r"NOT regexp_matches(path, '(^|/)(node_modules|\.[^/]*)/')"
_DIFF = rf"""pub AS (SELECT pkg, version, path, sha256(content) AS sha FROM package_files WHERE {_COMPARED}),
src AS (SELECT pkg, version, path, sha256(content) AS sha FROM source_files WHERE {_COMPARED}),
missing AS (SELECT * FROM pub ANTI JOIN src USING (pkg, version, path)),
twin AS (
  SELECT DISTINCT m.pkg, m.version, m.path FROM (
    SELECT pkg, version, path, unnest([concat(base, '.ts'), concat(base, '.tsx'), concat(base, '.mts'), concat(base, '.cts'),
      concat('src/', base, '.ts'), concat('src/', base, '.tsx')]) AS candidate
    FROM (SELECT *, regexp_replace(path, '\.(js|mjs|cjs)$', '') AS base FROM missing WHERE regexp_matches(path, '\.(js|mjs|cjs)$'))) m
  JOIN src s ON s.pkg = m.pkg AND s.version = m.version AND s.path = m.candidate),
classified AS (
  SELECT m.pkg, m.version, m.path, CASE WHEN {" OR ".join(f"starts_with(m.path, {_q(p)})" for p in rules.BUILD_PREFIXES)}
    OR {" OR ".join(f"ends_with(m.path, {_q(s)})" for s in rules.GENERATED_SUFFIXES)}
    OR regexp_extract(m.path, '[^/]*$') IN {_in(rules.GENERATED_NAMES)} OR t.path IS NOT NULL THEN 'expected_build' ELSE 'unexpected' END AS class
  FROM missing m LEFT JOIN twin t USING (pkg, version, path)
  UNION ALL
  SELECT p.pkg, p.version, p.path, 'modified' FROM pub p JOIN src s USING (pkg, version, path)
  WHERE p.sha <> s.sha AND p.path NOT IN {_in(rules.CONTENT_EXEMPT)}),
diff_count AS (
  SELECT pkg, version, (pkg, version) IN (SELECT (pkg, version) FROM src) AS performed,
    CAST(count(*) FILTER (WHERE class = 'unexpected') AS BIGINT) AS n_unexpected,
    CAST(count(*) FILTER (WHERE class = 'expected_build') AS BIGINT) AS n_expected_build,
    CAST(count(*) FILTER (WHERE class = 'modified') AS BIGINT) AS n_modified
  FROM pub LEFT JOIN classified USING (pkg, version, path) GROUP BY ALL),
diff_score AS (
  SELECT *, CASE WHEN NOT performed THEN 0.0::DOUBLE WHEN n_unexpected = 0 THEN 10.0::DOUBLE
    ELSE 10 - least(8, 3 * (1 + ln(n_unexpected::DOUBLE))) END AS diff_points FROM diff_count)"""
ORACLES["diff_classes"] = _with(
    ["package_files", "source_files"], _DIFF,
    "SELECT * FROM classified WHERE (pkg, version) IN (SELECT (pkg, version) FROM src)",
)
ORACLES["diff_rollup"] = _with(
    ["package_files", "source_files"], _DIFF,
    "SELECT * REPLACE (round(diff_points, 6) AS diff_points) FROM diff_score",
)

# --- repositories and specifiers ------------------------------------------------------------


def _repository(links: str) -> str:
    return rf"""parsed AS (
  SELECT *, CASE WHEN starts_with(plain, 'github:') THEN nullif(split_part(substring(plain, 8), '/', 1), '')
      ELSE nullif(regexp_extract(full_url, '^[a-z+]+://(?:[^/]*@)?github\.com/+([^/?#]+)/+([^/?#]+)', 1), '') END AS owner,
    CASE WHEN starts_with(plain, 'github:') THEN nullif(regexp_replace(split_part(substring(plain, 8), '/', 2), '\.git$', ''), '')
      ELSE nullif(regexp_replace(regexp_extract(full_url, '^[a-z+]+://(?:[^/]*@)?github\.com/+([^/?#]+)/+([^/?#]+)', 2), '\.git$', ''), '') END AS repo
  FROM (SELECT *, regexp_replace(regexp_replace(plain, '^git\+', ''), '^git://', 'https://') AS full_url
    FROM (SELECT *, regexp_replace(trim(repository_url), '/+$', '') AS plain FROM {links}))),
repo_scored AS (
  SELECT pkg, version, full_name IS NOT NULL AS found,
    full_name IS NOT NULL AND lower(publisher) = lower(owner) AS publisher_matches,
    CASE WHEN full_name IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 15 - CASE WHEN archived THEN 10 ELSE 0 END
      - CASE WHEN stars = 0 THEN 5 ELSE 0 END
      - CASE WHEN created_at > (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 MONTH THEN 5 ELSE 0 END
      - CASE WHEN lower(publisher) = lower(owner) OR provenance_id IS NOT NULL THEN 0 WHEN stars >= 100 THEN 3 ELSE 10 END) END AS repository_points
  FROM parsed LEFT JOIN (SELECT DISTINCT ON (lower(requested)) * FROM repo_health) ON lower(requested) = lower(concat(owner, '/', repo)))"""


ORACLES["repo_parse"] = _with(
    ["repo_link", "repo_health"], _repository("repo_link"), "SELECT pkg, version, owner, repo FROM parsed"
)
ORACLES["repo_points"] = _with(
    ["repo_link", "repo_health"], _repository("repo_link"), "SELECT * FROM repo_scored"
)
ORACLES["spec_parse"] = with_views(
    ["specifier"],
    r"""SELECT id, CASE WHEN local THEN target WHEN cut > 1 THEN substring(target, 1, cut - 1) ELSE target END AS name,
  CASE WHEN NOT local AND cut > 1 THEN substring(target, cut + 1) END AS version, local AS is_local,
  cut > 1 AND substring(target, cut + 1) NOT IN ('', 'latest', 'next') AS is_pinned
FROM (SELECT *, regexp_matches(target, '^(\./|/|\.\./)|\.tgz$|\.tar\.gz$') AS local,
    CASE WHEN starts_with(target, '@') THEN length(target) - strpos(reverse(target), '@') + 1 ELSE strpos(target, '@') END AS cut
  FROM specifier)""",
)

# --- scores ---------------------------------------------------------------------------------


def _points(scanner: str, source: str) -> str:
    most, *bases = rules.CATEGORY_WEIGHTS[scanner]
    lost = " + ".join(
        f"CASE WHEN {s} > 0 THEN {b} * (1 + ln({s}::DOUBLE)) ELSE 0 END"
        for b, s in zip(bases, ("c", "w", "i"))
    )
    return f"""SELECT pkg, version, greatest(0.0::DOUBLE, {most}::DOUBLE - ({lost})) AS points FROM (
    SELECT r.pkg, r.version, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'warning') AS w,
      count(*) FILTER (WHERE severity = 'info') AS i
    FROM pkg_flags r LEFT JOIN {source} f ON f.pkg = r.pkg AND f.version = r.version GROUP BY ALL)"""


def _score(sources: dict[str, str], repository: str | None = None, compared: str | None = None) -> str:
    """Category points per release, total, grade, verdict and exit code."""
    points = {s: f"p_{s}.points" if s in sources else "0.0::DOUBLE" for s in rules.CATEGORY_WEIGHTS}
    joins = "".join(
        f" JOIN ({_points(s, src)}) AS p_{s} ON p_{s}.pkg = k.pkg AND p_{s}.version = k.version"
        for s, src in sources.items()
    )
    for name, source in (("repository", repository), ("diff", compared)):
        points[name] = f"coalesce(p_{name}.{name}_points, 0.0::DOUBLE)" if source else "0.0::DOUBLE"
        if source:
            joins += f" LEFT JOIN {source} AS p_{name} ON p_{name}.pkg = k.pkg AND p_{name}.version = k.version"
    total = " + ".join(points.values())
    listed = ", ".join(f"round({e}, 6) AS {n}_points" for n, e in points.items())
    return f"""SELECT * EXCLUDE (total), round(total, 6) AS score,
  CASE grade WHEN 'A' THEN {_q(rules.VERDICTS["A"])} WHEN 'B' THEN {_q(rules.VERDICTS["B"])} WHEN 'C' THEN {_q(rules.VERDICTS["C"])}
    ELSE {_q(rules.VERDICTS["F"])} END AS verdict,
  CAST(CASE grade WHEN 'A' THEN 0 WHEN 'B' THEN 0 WHEN 'C' THEN 1 ELSE 2 END AS INTEGER) AS exit_code
FROM (SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT k.pkg, k.version, {listed}, greatest(0.0::DOUBLE, least(100.0::DOUBLE, {total})) AS total
    FROM pkg_flags k{joins}))"""


def _merge(*parts: str) -> str:
    """Join CTE texts, dropping repeats of a shared CTE list."""
    seen, out = set(), []
    for part in parts:
        if part not in seen:
            seen.add(part)
            out.append(part)
    return ",\n".join(out)


_CODE_LINES = _lines("code_line", _IS_CODE)
_CONTENT = _merge(_STATIC, _OBFUSCATION.replace(_CODE_LINES + ",\n", ""), _SECRETS)
ORACLES["long_line_findings"] = _with(
    ["package_files", "pkg_flags"], _CONTENT,
    "SELECT * FROM static_finding UNION ALL SELECT * FROM obfuscation_finding",
)
_CONTENT_SOURCES = {
    "static": "static_finding", "obfuscation": "obfuscation_finding", "secrets": "secret_finding",
}
ORACLES["content_points"] = _with(
    ["package_files", "pkg_flags"], _CONTENT,
    "SELECT pkg, version, static_points, obfuscation_points, secrets_points, CAST(NULL AS VARCHAR) AS grade "
    f"FROM ({_score(_CONTENT_SOURCES)})",
)


_ALL_VIEWS = [
    "package_files", "pkg_flags", "source_files", "release_dependency", "release_script",
    "release_link", "release_name", "popular", "repo_health",
]
_MANIFEST = _merge(
    _hooks("release_script"), _BINARIES, _dependencies("release_dependency"), _TYPOSQUAT
)
_EVERYTHING = _merge(_CONTENT, _MANIFEST, _DIFF, _repository("release_link"))
_ALL_SOURCES = {
    **_CONTENT_SOURCES, "hooks": "hook_finding", "binaries": "binary_finding",
    "dependencies": "dep_finding", "typosquatting": "typosquat_finding",
}
# A comparison counts only where a repository was found.
_FOUND_DIFF = """(SELECT d.pkg, d.version, CASE WHEN r.found THEN d.diff_points ELSE 0 END AS diff_points
  FROM diff_score d LEFT JOIN repo_scored r USING (pkg, version))"""
_FINAL = _score(
    {s: _ALL_SOURCES[s] for s in rules.CATEGORY_WEIGHTS}, "repo_scored", _FOUND_DIFF
)
ORACLES["own_scanner_points"] = _with(
    ["package_files"],
    f"""content AS ({ORACLES["content_points"]}),
declared AS (SELECT pkg, version, count(*) AS n FROM package_files WHERE ends_with(path, '.d.ts') GROUP BY pkg, version),
earned AS (SELECT c.*, CASE WHEN n > 0 THEN greatest(0, 5 - (1 + ln(n))) ELSE 5.0 END AS own
  FROM content AS c LEFT JOIN declared AS d ON d.pkg = c.pkg AND d.version = c.version)""",
    """SELECT pkg, version, static_points, obfuscation_points, secrets_points, CAST(round(own, 6) AS DOUBLE) AS declarations_points,
  round(CAST(static_points + obfuscation_points + secrets_points + own AS DOUBLE), 6) AS score FROM earned""",
)

ORACLES["final_scores"] = _with(_ALL_VIEWS, _EVERYTHING, _FINAL)
ORACLES["package_scores"] = _with(
    _ALL_VIEWS, _EVERYTHING, f"SELECT pkg, version, score, grade, verdict, exit_code FROM ({_FINAL})"
)

_ALL_FINDINGS = _merge(
    _CONTENT, _MANIFEST, _IOC.replace(_lines("text_line", _IS_TEXT) + ",\n", "")
) + """,
finding AS (""" + " UNION ALL ".join(
    f"SELECT pkg, version, scanner, severity, rule_id, message, file, line, evidence FROM {t}"
    for t in (*_ALL_SOURCES.values(), "ioc_finding")
) + """),
run AS (SELECT pkg, version, unnest(['static', 'obfuscation', 'hooks', 'secrets', 'binaries', 'dependencies', 'typosquatting', 'ioc']) AS scanner
  FROM pkg_flags),
counted AS (
  SELECT r.pkg, r.version, r.scanner, count(severity) AS n, """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS n_{s}" for s in ("critical", "warning", "info")
) + """
  FROM run r LEFT JOIN finding f ON f.pkg = r.pkg AND f.version = r.version AND f.scanner = r.scanner GROUP BY ALL),
worded AS (
  SELECT *, concat_ws(', ', CASE WHEN n_critical > 0 THEN concat(n_critical, ' critical') END,
      CASE WHEN n_warning > 0 THEN concat(n_warning, ' warning') END) AS bad,
    concat_ws(', ', CASE WHEN n_critical > 0 THEN concat(n_critical, ' critical') END,
      CASE WHEN n_warning > 0 THEN concat(n_warning, ' warning') END, CASE WHEN n_info > 0 THEN concat(n_info, ' info') END) AS every,
    n_critical + n_warning = 0 AS clean FROM counted),
code_count AS (SELECT pkg, version, count(*) AS n_files FROM package_files WHERE """ + _IS_CODE + """ GROUP BY ALL),
hook_names AS (SELECT pkg, version, string_agg(DISTINCT rule_id, ', ' ORDER BY rule_id) AS names FROM hook_finding WHERE severity <> 'info' GROUP BY ALL),
ext_count AS (SELECT pkg, version, string_agg(concat(k, ' .', rule_id), ', ' ORDER BY rule_id) AS exts
  FROM (SELECT pkg, version, rule_id, count(*) AS k FROM binary_finding GROUP BY ALL) GROUP BY ALL),
ioc_count AS (SELECT pkg, version, count(*) FILTER (WHERE rule_id = 'url') AS u, count(*) FILTER (WHERE rule_id = 'ipv4') AS a FROM ioc_finding GROUP BY ALL),
named AS (
  SELECT r.pkg, r.version, r.name, lower(regexp_replace(r.name, '^@[^/]+/', '')) IN (SELECT bare FROM listed) AS known, near_shown.shown
  FROM release_name r LEFT JOIN (SELECT name, string_agg(concat('"', popular_name, '" (dist ', distance, ')'), ', ' ORDER BY distance, ord) AS shown
    FROM near GROUP BY name) near_shown USING (name)),
result AS (
  SELECT w.pkg, w.version, scanner, CASE scanner WHEN 'ioc' THEN true WHEN 'binaries' THEN n = 0 ELSE clean END AS passed,
    n_critical, n_warning, n_info,
    CASE scanner
      WHEN 'static' THEN CASE WHEN n = 0 THEN 'No dangerous patterns detected' ELSE
        concat('Found ', every, ' pattern(s) across ', coalesce(n_files, 0), ' files', CASE WHEN is_cli THEN ' (CLI tool — shell execution expected)' ELSE '' END) END
      WHEN 'obfuscation' THEN CASE WHEN n = 0 THEN 'No obfuscation detected' ELSE concat('Obfuscation indicators: ', every) END
      WHEN 'secrets' THEN CASE WHEN n = 0 THEN 'No embedded secrets detected' ELSE concat('Secrets found: ', bad) END
      WHEN 'hooks' THEN CASE WHEN name IS NULL THEN 'No package.json found'
        WHEN s.pkg IS NULL THEN 'No scripts defined' WHEN n = 0 THEN 'No lifecycle hooks found'
        WHEN names IS NULL THEN 'Only benign lifecycle hooks (prepare)'
        ELSE concat('Lifecycle hooks: ', names, CASE WHEN n_critical > 0 THEN concat(' (', n_critical, ' with shell commands)') ELSE '' END) END
      WHEN 'binaries' THEN CASE WHEN n = 0 THEN 'No binary files found' ELSE concat(n, ' binary file(s): ', exts) END
      WHEN 'dependencies' THEN CASE WHEN name IS NULL THEN 'No package.json found' ELSE concat(coalesce(n_direct, 0), ' direct, ', coalesce(n_optional, 0),
        ' optional dependencies', CASE WHEN clean THEN '' ELSE concat(' (', bad, ')') END) END
      WHEN 'typosquatting' THEN CASE WHEN known THEN concat('"', name, '" is a known popular package')
        WHEN n = 0 THEN 'No similar popular package names' ELSE concat('Similar to: ', shown) END
      ELSE CASE WHEN n = 0 THEN 'No URLs or IP addresses found' ELSE concat(concat_ws(', ',
        CASE WHEN u > 0 THEN concat(u, ' URL(s)') END, CASE WHEN a > 0 THEN concat(a, ' IP(s)') END), ' extracted (defanged)') END
    END AS summary
  FROM worded w LEFT JOIN pkg_flags USING (pkg, version) LEFT JOIN code_count USING (pkg, version)
    LEFT JOIN hook_names USING (pkg, version) LEFT JOIN ext_count USING (pkg, version) LEFT JOIN ioc_count USING (pkg, version)
    LEFT JOIN named USING (pkg, version) LEFT JOIN dep_count USING (pkg, version)
    LEFT JOIN (SELECT DISTINCT pkg, version FROM release_script) s ON s.pkg = w.pkg AND s.version = w.version)"""
ORACLES["severity_counts"] = _with(
    _ALL_VIEWS, _ALL_FINDINGS, f"SELECT pkg, version, scanner, {_COUNTS} FROM finding GROUP BY ALL"
)
ORACLES["scanner_results"] = _with(_ALL_VIEWS, _ALL_FINDINGS, "SELECT * FROM result")
ORACLES["report_index"] = _with(
    _ALL_VIEWS, _merge(_ALL_FINDINGS, _DIFF, _repository("release_link")),
    f"""SELECT pkg, version, CAST((SELECT count(*) FROM finding f WHERE f.pkg = s.pkg AND f.version = s.version) AS BIGINT) AS n_findings,
  CASE WHEN found AND performed THEN n_unexpected ELSE 0 END AS n_unexpected,
  CASE WHEN found AND performed THEN n_expected_build ELSE 0 END AS n_expected_build,
  CASE WHEN found AND performed THEN n_modified ELSE 0 END AS n_modified,
  coalesce(found, false) AS found, round(score, 2) AS score, grade, exit_code, CAST(8 AS INTEGER) AS n_scanners
FROM ({_FINAL}) s LEFT JOIN diff_count USING (pkg, version) LEFT JOIN repo_scored USING (pkg, version)""",
)

ORACLES["report_findings"] = _with(_ALL_VIEWS, _ALL_FINDINGS, "SELECT * FROM finding")
_HEADER = f"""SELECT s.pkg, s.version, 'header' AS section, '' AS key, CAST(to_json({{
  'package': {{'name': s.pkg, 'version': s.version}}, 'scanners': listed,
  'repository': CASE WHEN r.pkg IS NOT NULL THEN {{'found': r.found, 'publisher_matches': r.publisher_matches}} END,
  'diff': {{'performed': coalesce(r.found, false) AND coalesce(performed, false),
    'error': CASE WHEN NOT coalesce(r.found, false) THEN 'no repository found' WHEN NOT coalesce(performed, false) THEN 'no source files' END,
    'n_unexpected': CASE WHEN r.found AND performed THEN n_unexpected ELSE 0 END,
    'n_expected_build': CASE WHEN r.found AND performed THEN n_expected_build ELSE 0 END,
    'n_modified': CASE WHEN r.found AND performed THEN n_modified ELSE 0 END}},
  'score': round(score, 2), 'grade': grade, 'verdict': verdict, 'exit_code': exit_code}}) AS VARCHAR) AS body
FROM ({_FINAL}) s
JOIN (SELECT pkg, version, list({{'name': scanner, 'passed': passed, 'summary': summary, 'n_critical': n_critical,
    'n_warning': n_warning, 'n_info': n_info}} ORDER BY scanner) AS listed FROM result GROUP BY ALL) USING (pkg, version)
LEFT JOIN diff_count USING (pkg, version) LEFT JOIN repo_scored r ON r.pkg = s.pkg AND r.version = s.version"""
_SECTIONS = """SELECT pkg, version, scanner AS section, coalesce(file, '') AS key,
  CAST(to_json({'scanner': scanner, 'file': file, 'findings': list({'line': line, 'severity': severity, 'rule_id': rule_id,
    'message': message, 'evidence': evidence} ORDER BY line NULLS FIRST, severity, rule_id, message, evidence NULLS FIRST)}) AS VARCHAR) AS body
FROM finding GROUP BY pkg, version, scanner, file
UNION ALL
SELECT c.pkg, c.version, 'diff', path, CAST(to_json({'path': path, 'class': class}) AS VARCHAR)
FROM classified c JOIN diff_count d ON d.pkg = c.pkg AND d.version = c.version JOIN repo_scored r ON r.pkg = c.pkg AND r.version = c.version
WHERE performed AND found"""
ORACLES["report_json"] = _with(
    _ALL_VIEWS, _merge(_ALL_FINDINGS, _DIFF, _repository("release_link")), f"{_HEADER} UNION ALL {_SECTIONS}"
)

# --- registry documents ---------------------------------------------------------------------

_TEXT = "CASE WHEN json_type(m, {0}) = 'VARCHAR' THEN json_extract_string(m, {0}) END"


def _t(path: str) -> str:
    return _TEXT.format(_q(path))


_REPOSITORY_URL = (
    f"coalesce({_t('$.repository')}, regexp_replace(regexp_replace(coalesce({_t('$.repository.url')}, ''), '^git\\+', ''), '\\.git$', ''))"
)
_LICENSE = f"coalesce({_t('$.license')}, {_t('$.license.type')}, '')"
_IS_CLI = "coalesce(json_type(m, '$.bin') <> 'NULL', false)"
_REGISTRY = """doc AS (SELECT CAST(body AS JSON) AS d FROM registry_doc WHERE json_valid(body)),
release_key AS (SELECT d, unnest(json_keys(d, '$.versions')) AS key FROM doc),
release_doc AS (SELECT *, json_extract(d, concat('$.versions."', key, '"')) AS m,
  coalesce(json_extract_string(d, concat('$.versions."', key, '".name')), json_extract_string(d, '$.name')) AS pkg,
  coalesce(json_extract_string(d, concat('$.versions."', key, '".version')), key) AS version FROM release_key)"""
ORACLES["registry_snapshot"] = _with(
    ["registry_change"], "",
    """SELECT id, seq, deleted, CASE WHEN NOT deleted THEN json_extract_string(body, '$."dist-tags".latest') END AS latest
FROM registry_change AS c WHERE seq = (SELECT max(seq) FROM registry_change AS o WHERE o.id = c.id)""",
)
ORACLES["package_metadata"] = _with(
    ["registry_doc"], _REGISTRY,
    f"""SELECT pkg, version, key = json_extract_string(d, '$."dist-tags".latest') AS is_latest, coalesce({_t('$.description')}, '') AS description,
  {_LICENSE} AS license, coalesce({_t('$._npmUser.name')}, '') AS publisher,
  coalesce(json_extract_string(d, concat('$.time."', key, '"')), '') AS published_at, coalesce({_t('$.dist.tarball')}, '') AS tarball_url,
  {_REPOSITORY_URL} AS repository_url, coalesce({_t('$.homepage')}, '') AS homepage,
  coalesce(CAST(json_extract(m, '$.dist.fileCount') AS BIGINT), 0) AS file_count,
  coalesce(CAST(json_extract(m, '$.dist.unpackedSize') AS BIGINT), 0) AS unpacked_size, {_t('$._npmUser.trustedPublisher.id')} AS provenance_id,
  array_to_string(coalesce(nullif(json_extract_string(m, '$.maintainers[*].name'), []), json_extract_string(d, '$.maintainers[*].name')), ',') AS maintainers,
  {_IS_CLI} AS is_cli, coalesce(json_type(m, '$.scripts') = 'OBJECT', false) AS has_scripts FROM release_doc""",
)


def _members(field: str, value: str, extra: str = "") -> str:
    return f"""SELECT pkg, version, name, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') END AS {value}{extra}
FROM (SELECT *, json_extract(m, concat('$.{field}."', name, '"')) AS v
  FROM (SELECT *, unnest(json_keys(m, '$.{field}')) AS name FROM release_doc))"""


ORACLES["registry_dependencies"] = _with(
    ["registry_doc"], _REGISTRY,
    _members("dependencies", "spec", ", 'direct' AS kind") + " UNION ALL "
    + _members("optionalDependencies", "spec", ", 'optional' AS kind"),
)
ORACLES["registry_scripts"] = _with(["registry_doc"], _REGISTRY, _members("scripts", "command"))
ORACLES["manifest_metadata"] = with_views(
    ["manifest_doc"],
    f"""SELECT coalesce({_t('$.name')}, 'unknown') AS pkg, coalesce({_t('$.version')}, '0.0.0') AS version, {_LICENSE} AS license,
  coalesce({_t('$.author')}, {_t('$.author.name')}, '') AS publisher, {_REPOSITORY_URL} AS repository_url, {_IS_CLI} AS is_cli
FROM (SELECT CAST(body AS JSON) AS m FROM manifest_doc WHERE json_valid(body))""",
)
ORACLES["version_resolution"] = with_views(
    ["registry_doc", "target"],
    """, doc AS (
  SELECT json_extract_string(body, '$.name') AS name, json_extract_string(body, '$."dist-tags".latest') AS latest,
    CASE WHEN json_type(body, '$.versions') = 'OBJECT' THEN json_keys(body, '$.versions') END AS versions
  FROM (SELECT * FROM registry_doc WHERE json_valid(body))),
asked AS (SELECT id, split_part(target, '@', 1) AS name, nullif(split_part(target, '@', 2), '') AS wanted FROM target),
chosen AS (SELECT a.*, d.name IS NOT NULL AS known, versions, coalesce(wanted, latest) AS picked FROM asked a LEFT JOIN doc d USING (name)),
judged AS (SELECT *, CASE WHEN NOT known THEN concat('Package not found: ', name)
  WHEN picked IS NULL THEN concat('Cannot determine version for ', name, ': no dist-tags.latest found')
  WHEN versions IS NULL THEN concat('No versions found in packument for ', name)
  WHEN NOT list_contains(versions, picked) THEN concat('Version ', picked, ' not found for ', name, '. Recent versions: ', array_to_string(versions, ', '))
  END AS error FROM chosen)
SELECT id, name, CASE WHEN error IS NULL THEN picked END AS version, error FROM judged""",
)
ORACLES["health_records"] = with_views(
    ["health_doc"],
    """SELECT json_extract_string(body, '$.full_name') AS full_name, CAST(json_extract(body, '$.stargazers_count') AS BIGINT) AS stars,
  CAST(0 AS BIGINT) AS forks, CAST(0 AS BIGINT) AS open_issues, coalesce(json_extract_string(body, '$.license.spdx_id'), '') AS license,
  strftime(TRY_CAST(replace(json_extract_string(body, '$.created_at'), 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at,
  coalesce(CAST(json_extract(body, '$.archived') AS BOOLEAN), false) AS archived FROM health_doc""",
)
ORACLES["size_labels"] = """SELECT o_orderkey, n_bytes, CASE WHEN n_bytes < 1024 THEN concat(n_bytes, ' B')
  WHEN n_bytes < 1048576 THEN printf('%.1f KB', round(n_bytes / 1024, 1)) WHEN n_bytes < 1073741824 THEN printf('%.1f MB', round(n_bytes / 1048576, 1))
  ELSE printf('%.1f GB', round(n_bytes / 1073741824, 1)) END AS label
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * pow(10, o_orderkey % 8)) AS BIGINT) AS n_bytes FROM orders)"""

# --- archives, trees and tool servers -------------------------------------------------------

ORACLES["archive_files"] = with_views(
    ["package_files"], "SELECT pkg, version, path, sha256(content) AS sha256 FROM package_files"
)
ORACLES["popular_list"] = with_views(
    ["popular"], "SELECT name, row_number() OVER (ORDER BY ord) - 1 AS ord FROM popular"
)
ORACLES["archive_failures"] = with_views(
    ["package_files"],
    """SELECT pkg, version, 'damaged archive' AS error FROM package_files
WHERE TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) % 9 = 4""",
)
ORACLES["archive_scores"] = _with(
    _ALL_VIEWS, _EVERYTHING,
    f"""SELECT pkg, version, CASE WHEN ok THEN score END AS score, CASE WHEN ok THEN grade END AS grade,
  CASE WHEN ok THEN verdict END AS verdict, CASE WHEN ok THEN exit_code ELSE 2 END AS exit_code,
  CASE WHEN NOT ok THEN 'damaged archive' END AS error
FROM (SELECT *, CAST(substring(pkg, 5, 20) AS BIGINT) % 9 <> 4 AS ok FROM ({_FINAL}))""",
)
ORACLES["source_roots"] = with_views(
    ["archived_source"],
    """, tops AS (SELECT pkg, version, list(DISTINCT split_part(path, '/', 1)) AS top FROM archived_source WHERE contains(path, '/') GROUP BY ALL)
SELECT pkg, version, CASE WHEN len(top) = 1 THEN regexp_replace(path, '^[^/]*/', '') ELSE path END AS path
FROM archived_source JOIN tops USING (pkg, version) WHERE len(top) > 1 OR contains(path, '/')""",
)
ORACLES["tool_servers"] = with_views(
    ["tool_config"],
    """, parsed AS (SELECT config_file, CAST(body AS JSON) AS d FROM tool_config WHERE json_valid(body)),
server AS (SELECT config_file, d, unnest(json_keys(d, '$.mcpServers')) AS name FROM parsed),
entry AS (SELECT config_file, name, coalesce(json_extract_string(d, concat('$.mcpServers."', name, '".command')), '') AS command,
  coalesce(CAST(json_extract(d, concat('$.mcpServers."', name, '".args')) AS VARCHAR[]), []) AS args FROM server),
argument AS (SELECT config_file, name, unnest(args) AS arg, generate_subscripts(args, 1) AS i FROM entry),
eligible AS (SELECT * FROM (SELECT *, lag(arg) OVER (PARTITION BY config_file, name ORDER BY i) AS previous FROM argument)
  WHERE NOT starts_with(arg, '-') AND coalesce(previous, '') NOT IN ('-p', '--package')),
picked AS (SELECT config_file, name, arg_min(arg, i) AS package FROM eligible GROUP BY ALL),
joined AS (SELECT e.*, CASE WHEN regexp_replace(command, '\\.exe$', '') IN ('npx', 'bunx') THEN package END AS npm_package
  FROM entry e LEFT JOIN picked USING (config_file, name))
SELECT config_file, name, command, array_to_string(args, ' ') AS args, npm_package,
  coalesce(contains(npm_package[2:], '@') AND regexp_extract(npm_package, '@([^@]*)$', 1) NOT IN ('', 'latest', 'next'), false) AS version_pinned
FROM joined""",
)
_FLEET = _EVERYTHING + f""",
score AS ({_FINAL}),
tagged AS (SELECT json_extract_string(body, '$.name') AS pkg, json_extract_string(body, '$."dist-tags".latest') AS latest FROM package_doc),
wanted AS (
  SELECT config_file, 'main' AS server, json_extract_string(body, '$.mcpServers.main.args[1]') AS npm_package FROM fleet_config),
server_score AS (
  SELECT config_file, server, npm_package, contains(npm_package, '@') AS version_pinned, split_part(npm_package, '@', 1) AS pkg, s.version,
    s.score, s.grade, s.verdict, coalesce(s.exit_code, 2) AS exit_code
  FROM wanted w LEFT JOIN score s ON s.pkg = split_part(npm_package, '@', 1)
    AND s.version = coalesce(nullif(split_part(npm_package, '@', 2), ''), (SELECT latest FROM tagged t WHERE t.pkg = split_part(npm_package, '@', 1))))"""
_FLEET_VIEWS = [*_ALL_VIEWS, "package_doc", "fleet_config"]
ORACLES["server_scores"] = _with(_FLEET_VIEWS, _FLEET, "SELECT * FROM server_score")
ORACLES["fleet_gate"] = _with(
    _FLEET_VIEWS, _FLEET,
    """SELECT CAST(count(*) AS BIGINT) AS n_servers, CAST(count(*) FILTER (WHERE score IS NULL) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (WHERE NOT version_pinned) AS BIGINT) AS n_unpinned, max(exit_code) AS worst_exit FROM server_score""",
)

# --- own rules and streams ------------------------------------------------------------------


def _user_rules() -> str:
    from .queries import USER_RULES

    return (
        _CODE_LINES + ",\n" + _COMMENT_STATE + ",\nuser_finding AS ("
        + "\nUNION ALL\n".join(_static_rule(r) for r in USER_RULES) + ")"
    )


ORACLES["user_rule_findings"] = _with(
    ["package_files", "pkg_flags"], _user_rules(), "SELECT * FROM user_finding"
)
ORACLES["stream_findings"] = _with(
    ["package_files", "pkg_flags"], _merge(_CONTENT, _BINARIES),
    " UNION ALL ".join(f"SELECT * FROM {t}" for t in (*_CONTENT_SOURCES.values(), "binary_finding")),
)
ORACLES["stream_scores"] = ORACLES["final_scores"]
ORACLES["stream_ioc"] = ORACLES["ioc_findings"]
_ADMITTED = """released AS (
  SELECT pkg, version, CAST(substring(pkg, 5, 20) AS BIGINT) % 25 <> 3 AS announced, count(*) AS n_listed,
    count(*) FILTER (WHERE coalesce(TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) % 45 <> 7, true)) AS n_files
  FROM package_files GROUP BY ALL)"""
ORACLES["stream_admission"] = _with(
    _ALL_VIEWS, _merge(_EVERYTHING, _ADMITTED),
    f"""SELECT r.pkg, r.version,
  CASE WHEN announced AND n_files = n_listed THEN 'scored' WHEN announced THEN 'files missing' ELSE 'no manifest' END AS outcome,
  CASE WHEN announced AND n_files = n_listed THEN NULL ELSE n_files END AS n_files,
  CASE WHEN announced AND n_files = n_listed THEN score END AS score, CASE WHEN announced AND n_files = n_listed THEN grade END AS grade
FROM released r JOIN ({_FINAL}) f ON f.pkg = r.pkg AND f.version = r.version WHERE announced OR n_files > 0""",
)
ORACLES["stream_all_findings"] = _with(
    _ALL_VIEWS, _merge(_ALL_FINDINGS, _ADMITTED),
    f"""SELECT f.* FROM finding f JOIN released r ON f.pkg = r.pkg AND f.version = r.version
WHERE announced AND n_files = n_listed""",
)
