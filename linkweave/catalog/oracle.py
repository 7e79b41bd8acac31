"""SQL twins of the registered queries, written for DuckDB on the same tables.

They are formulated on their own where that is possible: recursion instead of folds,
``lag`` instead of blocks, anti joins instead of number ranges, unfolding instead of
level-wise traversal.
"""

from __future__ import annotations

from linkweave.functions.text import WHITE_SPACE

ORACLE: dict[str, str] = {}

# The token shapes of scripts and settings, one token per stretch.
_TOKEN = (
    r"''[^'']*(?:''''[^'']*)*''?|--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|::+|:[_A-Z][_0-9A-Z]*"
    r"|[^''\-/:]+|[\s\S]"
)
_NAME = r":[_A-Z][_0-9A-Z]*"
_HEX = "[0-9a-fA-F]{64}"


def _trim(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def _norm(x: str) -> str:
    return f"(CASE WHEN {_trim(x)} = '' THEN '' ELSE {_trim(x)} || chr(10) END)"


def _link(previous: str, body: str) -> str:
    return f"sha256(coalesce({previous}, '') || chr(10) || {_norm(body)})"


def _filename(version: str) -> str:
    too_long = "CAST(error('E37 sequence limit reached') AS VARCHAR)"
    return f"(CASE WHEN {version} > 999999 THEN {too_long} ELSE lpad(CAST({version} AS VARCHAR), 6, '0') || '.sql' END)"


def _refs(text: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all({text}, '{_TOKEN}'), "
        f"lambda t: regexp_full_match(t, '{_NAME}')), lambda t: substr(t, 2))"
    )


def _chain(name: str, bodies: str) -> str:
    """CTEs that hash ``bodies`` (chain_id, version, body) one version at a time."""
    return f"""
{name}_bodies AS (SELECT chain_id, version, {_norm('body')} AS body FROM ({bodies})),
{name}_links AS (
  SELECT chain_id, version, CAST(NULL AS VARCHAR) AS previous_hash,
         sha256(chr(10) || body) AS hash, body
  FROM {name}_bodies WHERE version = 1
  UNION ALL
  SELECT b.chain_id, b.version, l.hash, sha256(l.hash || chr(10) || b.body), b.body
  FROM {name}_links l
  JOIN {name}_bodies b ON b.chain_id = l.chain_id AND b.version = l.version + 1),
{name} AS (
  SELECT chain_id, version, {_filename('version')} AS filename, previous_hash, hash, body
  FROM {name}_links)"""


_LOG = _chain(
    "log",
    "SELECT conv_id AS chain_id, CAST(turn + 1 AS INTEGER) AS version, text AS body FROM conversations",
)

_TAMPERED = f"""{_LOG},
tampered_named AS (
  SELECT chain_id,
    CASE WHEN chain_id % 17 = 0 AND version = 3 THEN 'v3.sql'
         WHEN chain_id % 19 = 4 AND version >= 3 THEN {_filename('version + 1')}
         ELSE filename END AS filename,
    CASE WHEN chain_id % 13 = 0 AND version = 1 THEN repeat('a', 64) ELSE previous_hash END AS previous_hash,
    CASE WHEN chain_id % 11 = 0 AND version = 2 THEN repeat('b', 64)
         WHEN chain_id % 23 = 1 THEN upper(hash) ELSE hash END AS hash,
    CASE WHEN chain_id % 7 = 0 AND version = 2 THEN body || 'edited' || chr(10) ELSE body END AS body
  FROM log),
tampered AS (
  SELECT *, CASE WHEN regexp_full_match(filename, '[0-9]{{6}}\\.sql')
                 THEN CAST(substr(filename, 1, 6) AS INTEGER) END AS version
  FROM tampered_named)"""

_SLOTS = """
slots AS (
  SELECT chain_id, links, slot, chain_id * 3 + slot AS target_id
  FROM (SELECT conv_id AS chain_id, count(*) AS links FROM conversations GROUP BY conv_id),
       (SELECT unnest(range(3)) AS slot)),
targets AS (SELECT target_id, chain_id FROM slots)"""

_APPLIED = f"""{_SLOTS},
planned AS (
  SELECT target_id, chain_id, slot, CAST(unnest(range(1, (chain_id + slot * 2) % 9 + 1)) AS INTEGER) AS version
  FROM slots),
applied AS (
  SELECT p.target_id, p.chain_id, {_filename('p.version')} AS filename,
    CASE WHEN (p.chain_id + p.slot) % 7 = 3 AND p.version = 2 THEN repeat('c', 64)
         ELSE coalesce(l.hash, sha256(p.chain_id || ':' || p.version)) END AS hash,
    l.previous_hash
  FROM planned p LEFT JOIN log l ON l.chain_id = p.chain_id AND l.version = p.version)"""


def _histories(log: str) -> str:
    """Applied histories against ``log`` by position: summary per target."""
    return f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY target_id, chain_id ORDER BY filename) AS position FROM applied),
compared AS (
  SELECT p.*, c.filename IS NOT NULL AND (p.filename <> c.filename OR p.hash <> c.hash
              OR p.previous_hash IS DISTINCT FROM c.previous_hash) AS differs
  FROM placed p LEFT JOIN {log} c ON c.chain_id = p.chain_id AND c.version = p.position),
totals AS (SELECT chain_id, count(*) AS total_committed FROM {log} GROUP BY chain_id),
summary AS (
  SELECT target_id, chain_id, applied_count, coalesce(total_committed, 0) AS total_committed,
    diverged_position, diverged_filename,
    CASE WHEN applied_count > coalesce(total_committed, 0) THEN 'E20'
         WHEN diverged_position IS NOT NULL THEN 'E21' END AS error_code
  FROM (SELECT target_id, chain_id, count(*) AS applied_count,
               min(position) FILTER (differs) AS diverged_position,
               arg_min(filename, position) FILTER (differs) AS diverged_filename
        FROM compared GROUP BY target_id, chain_id) LEFT JOIN totals USING (chain_id)),
progress AS (
  SELECT t.target_id, t.chain_id, coalesce(s.applied_count, 0) AS applied_count,
         coalesce(o.total_committed, 0) AS total_committed, s.diverged_filename, s.error_code
  FROM targets t LEFT JOIN summary s ON s.target_id = t.target_id AND s.chain_id = t.chain_id
  LEFT JOIN totals o ON o.chain_id = t.chain_id)"""


def _violations(log: str) -> str:
    """Violations of ``log`` by plain windows over whole chains."""
    return f"""
lagged AS (
  SELECT chain_id, filename, version, previous_hash, lower(hash) AS hash,
    lower(hash) = {_link('previous_hash', 'body')} AS hash_ok,
    row_number() OVER w AS position, lag(lower(hash)) OVER w AS before
  FROM {log} WINDOW w AS (PARTITION BY chain_id ORDER BY filename)),
log_faults AS (
  SELECT chain_id, version, filename, 'E01' AS error_code, filename AS detail, 1 AS step
  FROM lagged WHERE version IS NULL
  UNION ALL SELECT chain_id, version, filename, 'E13', hash, 7 FROM lagged WHERE NOT hash_ok
  UNION ALL SELECT chain_id, version, filename, 'E14', CAST(position AS VARCHAR), 8
  FROM lagged WHERE version <> position
  UNION ALL SELECT chain_id, version, filename, 'E15', previous_hash, 9
  FROM lagged WHERE position = 1 AND previous_hash IS NOT NULL
  UNION ALL SELECT chain_id, version, filename, 'E16', before, 10
  FROM lagged WHERE position > 1 AND (previous_hash IS NULL OR previous_hash IS DISTINCT FROM before)),
first_faults AS (
  SELECT chain_id, filename, error_code FROM log_faults
  QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY filename, step) = 1)"""


_WHOLE = "(SELECT conv_id AS chain_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"

_CANDIDATES = f"""
candidates AS (
  SELECT chain_id, text,
    CASE chain_id % 6
      WHEN 0 THEN regexp_replace(text, '[^ \\n]', ' ', 'g') || chr(10) || chr(9)
      WHEN 1 THEN 'insert into :SCHEMA_NAME.notes select ''' || replace(text, '''', '''''')
                  || '''::TEXT; -- :IGNORED' || chr(10)
      WHEN 2 THEN '--! Hash: 0' || chr(10) || text
      WHEN 3 THEN 'select :MISSING_NAME, ''' || replace(text, '''', '''''') || ''''
      WHEN 4 THEN '--! include fixtures/base.sql' || chr(10) || 'select 1 as one'
      ELSE text || chr(13) || chr(10) || '--! include fixtures/../fixtures/sub/more.sql'
           || chr(13) || chr(10) || 'select :SCHEMA_NAME.a from b' || chr(13) || chr(10) END AS body
  FROM {_WHOLE}),
unfolded AS (
  SELECT chain_id, 'app_' || chain_id AS schema_name,
    CASE WHEN chain_id % 6 = 5 AND chain_id % 4 = 1 THEN 'E34' END AS include_error,
    CASE chain_id % 6
      WHEN 4 THEN '/* ' || replace(text, '*/', '') || ' */' || chr(10) || 'select 1 as one'
      WHEN 5 THEN text || chr(13) || chr(10) || '/* ' || replace(text, '*/', '') || ' */' || chr(10)
                  || 'select :SCHEMA_NAME.x' || chr(10)
                  || 'select :SCHEMA_NAME.a from b' || chr(13) || chr(10)
      ELSE body END AS expanded
  FROM candidates)"""

_SHADOW = f"""{_CANDIDATES},
lf AS (SELECT chain_id, replace(expanded, chr(13) || chr(10), chr(10)) AS body
       FROM unfolded WHERE include_error IS NULL),
shadow AS (
  SELECT chain_id, version, filename, error_code, detail FROM log_faults
  UNION ALL SELECT chain_id, NULL, 'current.sql', include_error, 'fixtures/sub/more.sql'
  FROM unfolded WHERE include_error IS NOT NULL
  UNION ALL SELECT chain_id, NULL, 'current.sql',
    CASE WHEN {_trim('body')} = '' THEN 'E30' ELSE 'E31' END, NULL
  FROM lf WHERE {_trim('body')} = '' OR regexp_matches({_trim('body')}, '(?:\\A|\\n)--! ')
  UNION ALL SELECT DISTINCT chain_id, NULL, filename, 'E36', name
  FROM (SELECT chain_id, 'current.sql' AS filename, unnest({_refs('body')}) AS name FROM lf
        UNION ALL SELECT chain_id, filename, unnest({_refs('body')}) FROM tampered)
  WHERE name <> 'SCHEMA_NAME')"""

_SCRIPTS = """
scripts AS (
  SELECT doc_id AS chain_id, 'load' AS script_id, lang,
    '-- :LANG from ' || source || chr(10) || 'insert into :TARGET_SCHEMA.docs select :DOC_ID::BIGINT, '''
    || replace(text, '''', '''''') || ''', ":LANG", a:::B /* :NOPE ' || replace(text, '*/', '') || ' */'
    || CASE WHEN n_chars % 10 = 0 THEN ' where x = :MISSING_1x' ELSE '' END || ';' || chr(10) AS text
  FROM documents)"""

_FAMILY = """
part_rows AS (
  SELECT CAST(p_partkey // 31 AS BIGINT) AS chain_id, CAST(p_partkey % 31 AS INTEGER) AS local, p_partkey, p_name, p_type, p_size
  FROM part),
part_lines AS (
  SELECT chain_id, (local - 1) // 2 AS parent,
    string_agg('--! include ' || CASE WHEN local >= 15 THEN 'deep/n' ELSE 'n' END || local || '.sql' || chr(10), ''
               ORDER BY local) AS includes
  FROM part_rows WHERE local > 0 GROUP BY 1, 2),
fragments AS (
  SELECT p.chain_id, 'fixtures/' || CASE WHEN p.local >= 15 THEN 'deep/n' ELSE 'n' END || p.local || '.sql' AS path,
    '-- ' || p_name || chr(10) || coalesce(includes, '') || {fault}
    || 'insert into parts values (' || p_partkey || ', ''' || p_type || ''');'
    || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END AS text
  FROM part_rows p LEFT JOIN part_lines l ON l.chain_id = p.chain_id AND l.parent = p.local),
roots AS (
  SELECT DISTINCT chain_id, 'current.sql' AS path,
    'begin;' || chr(10) || '--! include fixtures/n0.sql' || chr(10) || 'commit;' AS text
  FROM part_rows),
segments AS (
  SELECT chain_id, source, CAST(ord AS INTEGER) AS line, segment, WS_TRIM AS content,
    count(*) OVER (PARTITION BY chain_id, source) AS n_lines
  FROM (SELECT chain_id, path AS source, unnest(parts) AS segment, generate_subscripts(parts, 1) AS ord
        FROM (SELECT chain_id, path, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS parts
              FROM (SELECT * FROM fragments UNION ALL SELECT * FROM roots)))),
named AS (
  SELECT chain_id, source, line, trim(substr(content, 13)) AS written,
    regexp_replace(regexp_replace(
      regexp_replace(source, '[^/]*$', '') || replace(trim(substr(content, 13)), './missing', 'missing'),
      '[^/.]+/\\.\\./', ''), '[^/.]+/\\.\\./', '') AS path
  FROM segments WHERE starts_with(content, '--! include ')),
edges AS (
  SELECT n.*, CASE WHEN NOT starts_with(n.path, 'fixtures/') THEN 'E35'
                   WHEN f.path IS NULL THEN 'E34' END AS code
  FROM named n LEFT JOIN fragments f ON f.chain_id = n.chain_id AND f.path = n.path)""".replace(
    "WS_TRIM", _trim("segment")
)

_FAULT = """CASE p_size
      WHEN 1 THEN chr(9) || '--! include ' || CASE WHEN p.local >= 15 THEN '../n0.sql' ELSE 'n0.sql' END
                  || ' ' || chr(13) || chr(10)
      WHEN 2 THEN '--! include ./missing.sql' || chr(10)
      WHEN 3 THEN '--! include ../../current.sql' || chr(10)
      ELSE '' END"""
_CLEAN_FAMILY = _FAMILY.replace("{fault}", "''")
_DAMAGED_FAMILY = _FAMILY.replace("{fault}", _FAULT)

_UNFOLD = """
walk AS (
  SELECT chain_id, path AS root, CAST([] AS INTEGER[]) AS key, path, [path] AS above, CAST(NULL AS VARCHAR) AS code
  FROM roots
  UNION ALL
  SELECT w.chain_id, w.root, list_append(w.key, e.line), e.path, list_append(w.above, e.path),
    CASE WHEN e.code IS NULL AND list_contains(w.above, e.path) THEN 'again' ELSE e.code END
  FROM walk w JOIN edges e ON e.chain_id = w.chain_id AND e.source = w.path
  WHERE w.code IS NULL)"""

_CLOSURE = """
closure AS (
  SELECT chain_id, path AS root, path FROM roots
  UNION
  SELECT c.chain_id, c.root, e.path
  FROM closure c JOIN edges e ON e.chain_id = c.chain_id AND e.source = c.path WHERE e.code IS NULL)"""


def _stamps(snapshot: int) -> str:
    if snapshot == 1:
        changed, kept = ("ms", "size"), "o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'O'"
    else:
        changed = (
            "CASE WHEN o_orderkey % 10 = 0 THEN ms + 1 ELSE ms END",
            "CASE WHEN o_orderkey % 15 = 0 THEN size + 1 ELSE size END",
        )
        kept = "o_orderpriority <> '5-LOW' OR o_orderstatus <> 'F'"
    return f"""
s{snapshot} AS (
  SELECT 'orders/' || o_orderstatus || '/' || o_orderkey AS path,
         {changed[0]} AS modified_ms, {changed[1]} AS size
  FROM (SELECT *, epoch_ms(o_orderdate) AS ms, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders)
  WHERE {kept})"""


_EVENTS = """
changes AS (
  SELECT user_id AS chain_id, event_type AS key, value, event_type || ' ' || props AS body,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version
  FROM events)"""

_EVENT_SLOTS = """
eslots AS (
  SELECT chain_id, slot, links, chain_id * 3 + slot AS target_id,
    CASE slot WHEN 0 THEN links // 2 WHEN 1 THEN links ELSE 0 END AS prefix,
    slot = 0 AND chain_id % 10 = 3 AND links // 2 >= 1 AS blocked
  FROM (SELECT user_id AS chain_id, count(*) AS links FROM events GROUP BY user_id),
       (SELECT unnest(range(3)) AS slot))"""

_STATE_AT = """
replayed AS (
  SELECT s.target_id, s.chain_id, c.key, max(c.version) AS version, arg_max(c.value, c.version) AS value
  FROM eslots s JOIN changes c ON c.chain_id = s.chain_id AND c.version <= {upto}
  GROUP BY ALL)"""
_INCREMENTAL = _STATE_AT.replace("{upto}", "(CASE WHEN s.blocked THEN s.prefix ELSE s.links END)")
_REBUILT = _STATE_AT.replace("{upto}", "s.links").replace("replayed", "rebuilt")


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


ORACLE["normalize_bodies"] = f"""
WITH padded AS (SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN text
    WHEN 1 THEN chr(12288) || chr(160) || chr(9) || text || chr(13) || chr(10) || chr(8195)
    WHEN 2 THEN chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10)
    WHEN 3 THEN ' ' || chr(133) || chr(8232) || chr(13) || chr(10) || translate(text, 'aeiou', repeat(chr(8195), 5)) || chr(9)
    ELSE text || chr(8203) || ' ' END AS x FROM documents)
SELECT doc_id, {_norm('x')} AS body FROM padded"""

ORACLE["link_hashes"] = f"""
SELECT doc_id, {_link("CASE WHEN n_chars % 2 = 0 THEN sha256(source) END", 'text')} AS hash FROM documents"""

ORACLE["valid_hash_filter"] = f"""
WITH d AS (SELECT doc_id, CASE doc_id % 5
    WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substr(sha256(text), 1, 63)
    WHEN 3 THEN substr(sha256(text), 1, 63) || 'g' WHEN 4 THEN sha256(text) || chr(10)
    ELSE sha256(text) END AS hash FROM documents)
SELECT doc_id, hash FROM d WHERE regexp_full_match(hash, '{_HEX}')"""

ORACLE["parse_versions"] = """
WITH n AS (SELECT p_partkey, CASE p_partkey % 6
    WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.SQL'
    WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '.sql'
    WHEN 3 THEN p_partkey || '.sql'
    WHEN 4 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.sql' || chr(10)
    ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.sql' END AS filename FROM part)
SELECT p_partkey, filename, CASE WHEN regexp_full_match(filename, '[0-9]{6}\\.sql')
  THEN CAST(substr(filename, 1, 6) AS INTEGER) END AS version FROM n"""

ORACLE["identifier_check"] = """
WITH n AS (SELECT p_partkey, unnest([p_name, p_type, replace(p_name, ' ', '_'), replace(p_brand, '#', '"'),
    '_' || p_size, p_size || p_type, '']) AS name FROM part)
SELECT p_partkey, name, regexp_full_match(name, '[_A-Za-z][_A-Za-z0-9]*') AS is_identifier,
  regexp_full_match(name, '[_A-Z][_A-Z0-9]*') AS is_binding_name,
  '"' || replace(name, '"', '""') || '"' AS quoted FROM n"""

ORACLE["candidate_guard"] = _with(_CANDIDATES, select=f"""
SELECT chain_id, CASE WHEN {_trim('body')} = '' THEN 'E30'
  WHEN regexp_matches({_trim("replace(body, chr(13) || chr(10), chr(10))")}, '(?:\\A|\\n)--! ') THEN 'E31' END AS error_code
FROM candidates""")

_RENDERED = """('--! Previous: ' || coalesce(previous_hash, '') || chr(10) || '--! Hash: ' || hash
  || chr(10) || chr(10) || body)"""

ORACLE["render_changes"] = _with(_LOG, select=f"SELECT chain_id, filename, {_RENDERED} AS text FROM log")

ORACLE["parse_headers"] = _with(_LOG, f"""
rendered AS (SELECT chain_id, version, {_RENDERED} AS text FROM log),
damaged AS (
  SELECT chain_id, version, replace(CASE (chain_id * 3 + version) % 14
    WHEN 1 THEN '--! Previous: ' || chr(10) || text
    WHEN 2 THEN '--! Previous: ' || repeat('d', 64) || chr(10) || text
    WHEN 3 THEN '--! Previous: 12' || chr(10) || text
    WHEN 4 THEN '--! Hash: ' || repeat('d', 64) || chr(10) || text
    WHEN 5 THEN replace(text, '--! Hash: ', '--! Hash: 0')
    WHEN 6 THEN '--! Author : me' || chr(10) || text
    WHEN 7 THEN '--! ' || chr(10) || text
    WHEN 8 THEN replace(text, '--! Hash', chr(10) || '--! Hash')
    WHEN 9 THEN ' ' || text
    WHEN 10 THEN regexp_extract(text, '\\A[^\\n]*\\n[^\\n]*')
    WHEN 11 THEN regexp_replace(text, '\\A([^\\n]*)\\n[^\\n]*\\n', '\\1' || chr(10))
    WHEN 12 THEN replace(text, chr(10), chr(13) || chr(10))
    WHEN 13 THEN regexp_extract(text, '\\A[^\\n]*\\n[^\\n]*\\n') || chr(10) || ' ' || chr(9) || chr(10)
    ELSE text END, chr(13) || chr(10), chr(10)) AS text
  FROM rendered),
lines AS (
  SELECT chain_id, version, unnest(parts) AS line, generate_subscripts(parts, 1) AS ord
  FROM (SELECT chain_id, version, string_split(text, chr(10)) AS parts FROM damaged)),
runs AS (
  SELECT *, min(ord) FILTER (NOT starts_with(line, '--! ')) OVER (PARTITION BY chain_id, version) AS stop,
    min(ord) FILTER (NOT starts_with(line, '--! ') AND line <> '') OVER (PARTITION BY chain_id, version) AS body_at
  FROM lines),
headers AS (
  SELECT chain_id, version, ord, strpos(line, ':') > 0 AS has_colon,
    {_trim("split_part(substr(line, 5), ':', 1)")} AS key,
    {_trim("substr(line, strpos(line, ':') + 1)")} AS value
  FROM runs WHERE ord < coalesce(stop, ord + 1)),
judged AS (
  SELECT *, CASE WHEN NOT has_colon THEN 'E04'
    WHEN key = 'Previous' AND earlier_previous > 0 THEN 'E05'
    WHEN key = 'Previous' AND value <> '' AND NOT regexp_full_match(value, '{_HEX}') THEN 'E06'
    WHEN key = 'Previous' THEN NULL
    WHEN key = 'Hash' AND earlier_hash > 0 THEN 'E07'
    WHEN key = 'Hash' AND NOT regexp_full_match(value, '{_HEX}') THEN 'E08'
    WHEN key = 'Hash' THEN NULL ELSE 'E09' END AS code
  FROM (SELECT *,
      count(*) FILTER (key = 'Previous' AND value <> '') OVER w AS earlier_previous,
      count(*) FILTER (key = 'Hash') OVER w AS earlier_hash
    FROM headers
    WINDOW w AS (PARTITION BY chain_id, version ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
heads AS (
  SELECT chain_id, version, arg_min(code, ord) FILTER (code IS NOT NULL) AS code,
    max(lower(value)) FILTER (key = 'Previous' AND value <> '') AS previous_hash,
    max(lower(value)) FILTER (key = 'Hash') AS hash
  FROM judged GROUP BY ALL),
late AS (
  SELECT DISTINCT chain_id, version FROM runs
  WHERE ord > stop AND starts_with(line, '--! ') AND (body_at IS NULL OR ord < body_at)),
bodies AS (
  SELECT chain_id, version, string_agg(line, chr(10) ORDER BY ord) FILTER (ord >= stop) AS rest
  FROM runs GROUP BY ALL),
parsed AS (
  SELECT d.chain_id, d.version, h.previous_hash, h.hash, {_norm("coalesce(b.rest, '')")} AS body,
    CASE WHEN h.code IS NOT NULL THEN h.code WHEN l.chain_id IS NOT NULL AND h.chain_id IS NOT NULL THEN 'E03'
      WHEN h.chain_id IS NULL THEN 'E10'
      WHEN {_trim("coalesce(b.rest, '')")} = '' THEN 'E11'
      WHEN h.hash IS NULL THEN 'E12' END AS error_code
  FROM damaged d
  LEFT JOIN heads h ON h.chain_id = d.chain_id AND h.version = d.version
  LEFT JOIN late l ON l.chain_id = d.chain_id AND l.version = d.version
  LEFT JOIN bodies b ON b.chain_id = d.chain_id AND b.version = d.version)""", select="""
SELECT chain_id, version, CASE WHEN error_code IS NULL THEN previous_hash END AS previous_hash,
  CASE WHEN error_code IS NULL THEN hash END AS hash,
  CASE WHEN error_code IS NULL THEN body END AS body, error_code FROM parsed""")

_FILES = f"""
parsed AS ({ORACLE["parse_headers"]}),
files AS (SELECT *, {_filename('version')} AS filename FROM parsed),
sound AS (SELECT chain_id, filename, version, lower(previous_hash) AS previous_hash, hash, body FROM files WHERE error_code IS NULL)"""
_FILE_FAULTS = """
file_faults AS (
  SELECT chain_id, version, filename, error_code, step FROM log_faults
  UNION ALL
  SELECT chain_id, version, filename, error_code,
    CASE error_code WHEN 'E02' THEN 2 WHEN 'E10' THEN 4 WHEN 'E11' THEN 5 WHEN 'E12' THEN 6 ELSE 3 END
  FROM files WHERE error_code IS NOT NULL)"""
ORACLE["audit_files"] = _with(_FILES, _violations("sound"), _FILE_FAULTS, select="""
SELECT chain_id, version, filename, error_code FROM file_faults""")
ORACLE["first_violation_files"] = _with(_FILES, _violations("sound"), _FILE_FAULTS, select="""
SELECT chain_id, filename, error_code FROM file_faults
QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY filename, step) = 1""")
ORACLE["env_interpolate"] = """
WITH settings AS (SELECT c_custkey, c_name, c_mktsegment, CASE c_custkey % 7
    WHEN 0 THEN '${NAME}/${SEGMENT:-x}' WHEN 1 THEN 'a${EMPTY:-default}b$'
    WHEN 2 THEN '${UNSET:-d${NAME}' WHEN 3 THEN '${NAME}${UNSET}${'
    WHEN 4 THEN '{${:-x}}' WHEN 5 THEN 'x${NAME'
    ELSE '$${NAME:-a:-b}}${UNSET:-c:-d}$x' END AS setting FROM customer),
tokens AS (
  SELECT c_custkey, c_name, c_mktsegment, unnest(parts) AS token, generate_subscripts(parts, 1) AS ord
  FROM (SELECT *, regexp_extract_all(setting, '\\$\\{[^}]*\\}?|[^$]+|\\$') AS parts FROM settings)),
split AS (
  SELECT *, starts_with(token, '${') AS is_ref, regexp_extract(token, '^\\$\\{((?:[^:}]|:[^-])*)', 1) AS name,
    CASE WHEN contains(token, ':-') THEN regexp_extract(token, ':-([^}]*)', 1) END AS fallback
  FROM tokens),
looked AS (
  SELECT *, CASE name WHEN 'NAME' THEN c_name WHEN 'SEGMENT' THEN c_mktsegment WHEN 'EMPTY' THEN '' END AS value
  FROM split),
judged AS (
  SELECT c_custkey, ord, CASE WHEN NOT is_ref THEN token ELSE coalesce(value, fallback) END AS piece,
    CASE WHEN NOT is_ref THEN NULL WHEN NOT ends_with(token, '}') THEN 'E60' WHEN name = '' THEN 'E61'
      WHEN value IS NULL AND fallback IS NULL THEN 'E62'
      WHEN value IS NULL AND contains(fallback, '${') THEN 'E60' END AS code
  FROM looked)
SELECT c_custkey, CASE WHEN count(code) = 0 THEN string_agg(piece, '' ORDER BY ord) END AS value,
  arg_min(code, ord) FILTER (code IS NOT NULL) AS error_code
FROM judged GROUP BY c_custkey"""

ORACLE["invalid_bindings"] = """
WITH b AS (SELECT c_custkey AS chain_id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment)
    WHEN 2 THEN c_name ELSE '_' || c_nationkey END AS name FROM customer)
SELECT chain_id, name, 'E64' AS error_code FROM b WHERE NOT regexp_full_match(name, '[_A-Z][_A-Z0-9]*')"""

ORACLE["filled_bindings"] = """
SELECT c_custkey AS chain_id, 'SCHEMA_NAME' AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'test_' || lower(c_mktsegment) WHEN 1 THEN c_name || '/x'
    ELSE CASE WHEN c_nationkey = 7 THEN 'seven' END END AS value,
  CASE WHEN c_custkey % 3 = 2 AND c_nationkey <> 7 THEN 'E62' END AS error_code
FROM customer"""

ORACLE["chain_build"] = _with(
    _LOG, select="SELECT chain_id, version, filename, previous_hash, hash, body FROM log"
)
ORACLE["chain_head_fold"] = _with(
    _EVENTS, _chain("elog", "SELECT chain_id, version, body FROM changes"), select="""
SELECT chain_id, count(*) AS links, max(version) AS head_version, arg_max(hash, version) AS head_hash
FROM elog GROUP BY chain_id""")
ORACLE["chain_heads"] = _with(_LOG, select="""
SELECT chain_id, count(*) AS links, max(version) AS head_version, arg_max(hash, version) AS head_hash
FROM log GROUP BY chain_id""")
ORACLE["verify_links"] = _with(_TAMPERED, select=f"""
SELECT chain_id, filename, lower(hash) = {_link('previous_hash', 'body')} AS hash_ok FROM tampered""")
ORACLE["latest_change"] = _with(_LOG, select="""
SELECT chain_id, version, filename, previous_hash, hash, body FROM log
QUALIFY version = max(version) OVER (PARTITION BY chain_id)""")
ORACLE["next_versions"] = _with(_LOG, select="""
SELECT chain_id, CAST(count(*) + 1 AS INTEGER) AS next_version, CAST(NULL AS VARCHAR) AS error_code
FROM log GROUP BY chain_id""")
ORACLE["contiguity_violations"] = """
WITH ranked AS (
  SELECT l_orderkey AS chain_id, l_linenumber AS version,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS position FROM lineitem)
SELECT chain_id, version, count(*) AS n_rows, min(position) AS first_rank,
  count(*) FILTER (position <> version) AS off_rank_rows
FROM ranked GROUP BY chain_id, version HAVING count(*) FILTER (position <> version) > 0"""
ORACLE["uniqueness_violations"] = """
WITH k AS (
  SELECT l_orderkey AS target_id, 'filename' AS key_name, CAST(l_linenumber AS VARCHAR) AS key_value FROM lineitem
  UNION ALL
  SELECT l_orderkey, 'hash', nullif(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), '2000-04-04') FROM lineitem)
SELECT target_id, CAST(0 AS BIGINT) AS chain_id, key_name, key_value, count(*) AS n_rows
FROM k GROUP BY ALL HAVING count(*) > 1 OR key_value IS NULL"""
ORACLE["broken_links"] = _with(_TAMPERED, """
seq AS (SELECT chain_id, filename, lower(previous_hash) AS previous_hash, row_number() OVER w AS position,
    lag(lower(hash)) OVER w AS expected_previous
  FROM tampered WINDOW w AS (PARTITION BY chain_id ORDER BY filename))""", select="""
SELECT * FROM seq WHERE position > 1 AND (previous_hash IS NULL OR previous_hash IS DISTINCT FROM expected_previous)""")
ORACLE["genesis_violations"] = _with(_TAMPERED, select="""
SELECT chain_id, filename, previous_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY filename) AS position FROM tampered)
WHERE position = 1 AND previous_hash IS NOT NULL""")
ORACLE["first_violation"] = _with(
    _TAMPERED, _violations("tampered"), select="SELECT chain_id, filename, error_code FROM first_faults"
)
ORACLE["audit_all"] = _with(_TAMPERED, _APPLIED, _violations("tampered"), _histories("tampered"), select="""
SELECT chain_id, CAST(NULL AS BIGINT) AS target_id, version, filename, error_code, detail FROM log_faults
UNION ALL
SELECT chain_id, target_id, CASE WHEN error_code = 'E21' THEN CAST(diverged_position AS INTEGER) END,
  CASE WHEN error_code = 'E21' THEN diverged_filename END, error_code,
  applied_count || ' of ' || total_committed
FROM summary WHERE error_code IS NOT NULL
UNION ALL
SELECT chain_id, target_id, NULL, filename, 'E17', 'filename x' || count(*)
FROM applied GROUP BY chain_id, target_id, filename HAVING count(*) > 1
UNION ALL
SELECT chain_id, target_id, NULL, NULL, 'E18', 'hash x' || count(*)
FROM applied GROUP BY chain_id, target_id, hash HAVING count(*) > 1""")

_FLEET = (_LOG, _APPLIED, _histories("log"))
ORACLE["history_divergence"] = _with(*_FLEET, select="SELECT * FROM summary WHERE error_code IS NOT NULL")
ORACLE["orphan_applied"] = _with(_LOG, _APPLIED, select="""
SELECT target_id, chain_id, filename, hash FROM applied a
WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.chain_id = a.chain_id AND l.filename = a.filename)""")
ORACLE["pending_changes"] = _with(*_FLEET, select="""
SELECT t.target_id, t.chain_id, l.version, l.filename, l.hash, l.previous_hash
FROM targets t JOIN log l ON l.chain_id = t.chain_id
WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE a.target_id = t.target_id AND a.filename = l.filename)
  AND NOT EXISTS (SELECT 1 FROM summary s WHERE s.target_id = t.target_id AND s.error_code IS NOT NULL)""")
ORACLE["pending_by_offset"] = _with(_LOG, _APPLIED, select="""
SELECT t.target_id, t.chain_id, l.version, l.filename, l.hash, l.previous_hash
FROM targets t JOIN log l ON l.chain_id = t.chain_id
WHERE l.version > (SELECT count(*) FROM applied a WHERE a.target_id = t.target_id)""")
ORACLE["fleet_status"] = _with(*_FLEET, _CANDIDATES, select=f"""
SELECT target_id, chain_id, applied_count, total_committed, error_code,
  CASE WHEN error_code IS NULL THEN pending END AS pending_committed,
  CASE WHEN error_code IS NULL THEN changed END AS candidate_has_changes,
  CASE WHEN error_code IS NULL THEN CAST(pending AS INTEGER) + 2 * CAST(changed AS INTEGER) END AS code
FROM (SELECT p.*, p.total_committed > p.applied_count AS pending, {_trim('c.body')} <> '' AS changed
      FROM progress p JOIN candidates c ON c.chain_id = p.chain_id)""")
ORACLE["apply_summary"] = _with(_TAMPERED, _APPLIED, _violations("tampered"), _histories("tampered"), select="""
SELECT p.target_id, p.chain_id, p.total_committed, coalesce(f.error_code, p.error_code) AS error_code,
  CASE WHEN coalesce(f.error_code, p.error_code) IS NULL THEN p.total_committed - p.applied_count ELSE 0 END AS applied_count
FROM progress p LEFT JOIN first_faults f ON f.chain_id = p.chain_id""")
ORACLE["uncommit_latest"] = _with(*_FLEET, _CANDIDATES, f"""
per_chain AS (SELECT chain_id, min(error_code) AS history_error, bool_or(applied_count = total_committed) AS done
  FROM progress GROUP BY chain_id),
judged AS (
  SELECT l.chain_id, l.version, l.filename, l.body,
    CASE WHEN history_error IS NOT NULL THEN history_error WHEN done THEN 'E41'
         WHEN {_trim('c.body')} <> '' THEN 'E42' END AS error_code
  FROM log l JOIN totals o ON o.chain_id = l.chain_id AND o.total_committed = l.version
  JOIN per_chain p ON p.chain_id = l.chain_id JOIN candidates c ON c.chain_id = l.chain_id)""", select="""
SELECT chain_id, version, filename, error_code, CASE WHEN error_code IS NULL THEN body END AS restored_body FROM judged""")

ORACLE["restored_candidates"] = ORACLE["uncommit_latest"].replace(
    "SELECT chain_id, version, filename, error_code, CASE WHEN error_code IS NULL THEN body END AS restored_body FROM judged",
    "SELECT c.chain_id, CASE WHEN j.error_code IS NULL THEN j.body ELSE c.body END AS body "
    "FROM candidates c JOIN judged j ON j.chain_id = c.chain_id",
)

ORACLE["placeholder_refs"] = _with(_SCRIPTS, select=f"""
SELECT DISTINCT chain_id, script_id, unnest({_refs('text')}) AS name FROM scripts""")
ORACLE["unknown_placeholders"] = _with(_SCRIPTS, select=f"""
SELECT DISTINCT * FROM (SELECT chain_id, script_id, unnest({_refs('text')}) AS name FROM scripts)
WHERE name NOT IN ('TARGET_SCHEMA', 'DOC_ID', 'LANG')""")
ORACLE["render_templates"] = _with(_SCRIPTS, f"""
filled AS (
  SELECT chain_id, script_id, list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda t:
    CASE WHEN NOT regexp_full_match(t, '{_NAME}') THEN t
         WHEN t = ':TARGET_SCHEMA' THEN 'lang_' || lang WHEN t = ':DOC_ID' THEN CAST(chain_id AS VARCHAR)
         WHEN t = ':LANG' THEN lang END) AS pieces
  FROM scripts)""", select="""
SELECT chain_id, script_id,
  CASE WHEN len(list_filter(pieces, lambda p: p IS NULL)) = 0 THEN array_to_string(pieces, '') END AS rendered,
  CASE WHEN len(list_filter(pieces, lambda p: p IS NULL)) > 0 THEN 'E36' END AS error_code FROM filled""")

ORACLE["include_refs"] = _with(_DAMAGED_FAMILY, select="""
SELECT chain_id, source, line, written AS path FROM named WHERE source <> 'current.sql'""")
ORACLE["include_expand"] = _with(_CLEAN_FAMILY, _UNFOLD, """
pieces AS (
  SELECT w.chain_id, w.root, list_append(w.key, s.line) AS key,
    s.segment || CASE WHEN w.path <> w.root AND s.line = s.n_lines AND NOT ends_with(s.segment, chr(10))
                      THEN chr(10) ELSE '' END AS piece
  FROM walk w JOIN segments s ON s.chain_id = w.chain_id AND s.source = w.path
  WHERE NOT starts_with(s.content, '--! include '))""", select="""
SELECT chain_id, root, string_agg(piece, '' ORDER BY key) AS text FROM pieces GROUP BY chain_id, root""")
ORACLE["include_closure"] = _with(
    _DAMAGED_FAMILY, _CLOSURE, select="SELECT chain_id, root, path FROM closure WHERE path <> root"
)
ORACLE["duplicate_includes"] = _with(_DAMAGED_FAMILY, _CLOSURE, select="""
SELECT c.chain_id, c.root, e.path, count(*) AS uses
FROM closure c JOIN edges e ON e.chain_id = c.chain_id AND e.source = c.path
WHERE e.code IS NULL GROUP BY ALL HAVING count(*) > 1""")
ORACLE["include_edges"] = _with(_DAMAGED_FAMILY, select="""
SELECT chain_id, source, written, CASE WHEN NOT starts_with(path, '..') THEN path END AS path, code FROM edges""")
ORACLE["missing_includes"] = _with(
    _DAMAGED_FAMILY, select="SELECT chain_id, source, path FROM edges WHERE code = 'E34'"
)
ORACLE["include_violations"] = _with(_DAMAGED_FAMILY, _UNFOLD, """
faults AS (
  SELECT chain_id, root, key, path,
    CASE WHEN code IS NOT NULL AND code <> 'again' THEN code
         WHEN row_number() OVER (PARTITION BY chain_id, root, path ORDER BY key) > 1 THEN 'E33' END AS error_code
  FROM walk)""", select="""
SELECT chain_id, root, error_code, CASE WHEN error_code = 'E35' AND starts_with(path, '..') THEN NULL ELSE path END AS path
FROM faults WHERE error_code IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY chain_id, root ORDER BY key) = 1""")
ORACLE["compile_scripts"] = _with(_CANDIDATES, f"""
filled AS (
  SELECT chain_id, include_error, list_transform(regexp_extract_all(expanded, '{_TOKEN}'), lambda t:
    CASE WHEN NOT regexp_full_match(t, '{_NAME}') THEN t WHEN t = ':SCHEMA_NAME' THEN schema_name END) AS pieces
  FROM unfolded),
judged AS (
  SELECT chain_id, pieces, coalesce(include_error,
    CASE WHEN len(list_filter(pieces, lambda p: p IS NULL)) > 0 THEN 'E36' END) AS error_code
  FROM filled)""", select="""
SELECT chain_id, CASE WHEN error_code IS NULL THEN array_to_string(pieces, '') END AS compiled, error_code FROM judged""")
ORACLE["shadow_validation"] = _with(_TAMPERED, _violations("tampered"), _SHADOW, select="""
SELECT chain_id, CAST(NULL AS BIGINT) AS target_id, version, filename, error_code, detail FROM shadow""")
ORACLE["commit_candidates"] = _with(_TAMPERED, _violations("tampered"), _SHADOW, f"""
heads AS (SELECT chain_id, count(*) + 1 AS next, lower(arg_max(hash, version)) AS head FROM tampered GROUP BY chain_id)""", select=f"""
SELECT b.chain_id, CAST(next AS INTEGER) AS version, {_filename('next')} AS filename, head AS previous_hash,
  {_link('head', 'b.body')} AS hash, {_norm('b.body')} AS body
FROM lf b JOIN heads h ON h.chain_id = b.chain_id WHERE b.chain_id NOT IN (SELECT chain_id FROM shadow)""")
# A committed change is faulty only where its body was edited afterwards, and then by its own hash alone.
ORACLE["commit_then_audit"] = f"""
SELECT chain_id, version, CASE WHEN chain_id % 5 = 2 THEN 'E13' ELSE '' END AS error_codes
FROM ({ORACLE["commit_candidates"]})"""

_RECORDED = (_LOG, _APPLIED)
ORACLE["applied_recorded"] = _with(*_RECORDED, select="SELECT * FROM applied")
ORACLE["applied_refused"] = _with(*_RECORDED, select="""
SELECT target_id, chain_id, 'x' || filename AS filename, hash, previous_hash, 'E18' AS error_code
FROM applied WHERE CAST(filename[1:6] AS INTEGER) % 2 = 0
UNION ALL
SELECT target_id, chain_id, filename, sha256(hash), previous_hash, 'E17' FROM applied WHERE CAST(filename[1:6] AS INTEGER) % 2 = 1""")
ORACLE["applied_of_chains"] = _with(*_RECORDED, select="""
SELECT * FROM applied WHERE chain_id IN (SELECT chain_id FROM log WHERE version = 5)""")
ORACLE["applied_if_present"] = _with(*_RECORDED, select="""
SELECT target_id, chain_id, count(*) AS n_rows FROM applied GROUP BY ALL""")
ORACLE["applied_log_states"] = _with(*_RECORDED, select="""
SELECT '1 missing' AS step, false AS is_there, 0::BIGINT AS n_rows UNION ALL SELECT '2 required: E50', false, 0
UNION ALL SELECT '3 made', true, 0 UNION ALL SELECT '4 filled', true, (SELECT count(*) FROM applied)""")

ORACLE["stamp_diff"] = _with(_stamps(1), _stamps(2), select="""
SELECT coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
       WHEN a.modified_ms = b.modified_ms AND a.size = b.size THEN 'same' ELSE 'modified' END AS change,
  a.modified_ms AS old_modified_ms, b.modified_ms AS new_modified_ms, a.size AS old_size, b.size AS new_size
FROM s1 a FULL OUTER JOIN s2 b ON a.path = b.path""")
ORACLE["snapshot_equality"] = _with(_stamps(1), _stamps(2), """
d AS (SELECT (SELECT count(*) FROM (FROM s1 EXCEPT ALL FROM s2))
           + (SELECT count(*) FROM (FROM s2 EXCEPT ALL FROM s1)) AS differing_stamps)""", select="""
SELECT differing_stamps, differing_stamps = 0 AS equal FROM d""")
_SNAPSHOTS = """
stamps AS (
  SELECT CAST(k AS BIGINT) AS snapshot_id, 'orders/' || o_orderstatus || '/' || o_orderkey AS path,
    epoch_ms(o_orderdate) + CASE WHEN k >= 3 AND o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS modified_ms,
    CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN k >= 6 AND o_orderkey % 15 = 0 THEN 1 ELSE 0 END AS size
  FROM orders, (SELECT unnest([1, 2, 3, 4, 6, 7, 8]) AS k)
  WHERE NOT (k >= 4 AND o_orderpriority = '5-LOW') AND NOT (k < 8 AND o_orderkey % 100 = 0))"""
ORACLE["snapshot_changes"] = _with(_SNAPSHOTS, """
steps AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS before FROM (SELECT DISTINCT snapshot_id FROM stamps))""", select="""
SELECT * FROM (
  SELECT snapshot_id,
    (SELECT count(*) FROM (SELECT path, modified_ms, size FROM stamps a WHERE a.snapshot_id = s.snapshot_id
      EXCEPT ALL SELECT path, modified_ms, size FROM stamps b WHERE b.snapshot_id = s.before)) AS appeared,
    (SELECT count(*) FROM (SELECT path, modified_ms, size FROM stamps a WHERE a.snapshot_id = s.before
      EXCEPT ALL SELECT path, modified_ms, size FROM stamps b WHERE b.snapshot_id = s.snapshot_id)) AS gone
  FROM steps s) WHERE appeared + gone > 0""")
ORACLE["change_points"] = """
WITH seq AS (
  SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS previous_state
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT * FROM seq WHERE previous_state IS DISTINCT FROM event_type"""

ORACLE["change_points_stream"] = ORACLE["change_points"]
ORACLE["replay_state"] = _with(_EVENTS, select="""
SELECT chain_id, key, max(version) AS version, arg_max(value, version) AS value FROM changes GROUP BY chain_id, key""")
_STATE_COLUMNS = "target_id, chain_id, key, version, value"
ORACLE["rebuild_state"] = _with(
    _EVENTS, _EVENT_SLOTS, _REBUILT, select=f"SELECT {_STATE_COLUMNS} FROM rebuilt"
)
ORACLE["apply_pending"] = _with(
    _EVENTS, _EVENT_SLOTS, _INCREMENTAL, select=f"SELECT {_STATE_COLUMNS} FROM replayed"
)
ORACLE["apply_with_bindings"] = _with(_EVENTS, _EVENT_SLOTS, """
ends AS (
  SELECT s.target_id, coalesce(min(c.version) - 1, any_value(s.links)) AS upto
  FROM eslots s LEFT JOIN changes c
    ON c.chain_id = s.chain_id AND c.version > s.prefix AND c.version % 23 = 0 AND c.chain_id % 3 = 1
  GROUP BY s.target_id)""", """
replayed AS (
  SELECT s.target_id, s.chain_id, c.key, max(c.version) AS version, arg_max(c.value, c.version) AS value
  FROM eslots s JOIN ends USING (target_id) JOIN changes c ON c.chain_id = s.chain_id
    AND c.version <= CASE WHEN s.blocked THEN s.prefix ELSE upto END
  GROUP BY ALL)""", select=f"SELECT {_STATE_COLUMNS} FROM replayed")
ORACLE["apply_pending_recorded"] = _with(
    _EVENTS, _EVENT_SLOTS, _chain("elog", "SELECT chain_id, version, body FROM changes"), select="""
SELECT s.target_id, s.chain_id, l.filename, l.hash, l.previous_hash
FROM eslots s JOIN elog l ON l.chain_id = s.chain_id AND l.version > s.prefix WHERE NOT s.blocked""")
ORACLE["rebuild_vs_incremental"] = _with(_EVENTS, _EVENT_SLOTS, _INCREMENTAL, _REBUILT, select=f"""
SELECT {_STATE_COLUMNS}, CAST(sum(sign) AS BIGINT) AS balance
FROM (SELECT {_STATE_COLUMNS}, 1 AS sign FROM replayed UNION ALL SELECT {_STATE_COLUMNS}, -1 FROM rebuilt)
GROUP BY ALL HAVING sum(sign) <> 0""")
ORACLE["run_candidate"] = _with(_EVENTS, _EVENT_SLOTS, _INCREMENTAL, """
writes AS (
  SELECT s.target_id, s.chain_id, e.event_type AS key, CAST(max(s.links) + 1 AS INTEGER) AS version, max(e.value) AS value
  FROM eslots s JOIN events e ON e.user_id = s.chain_id
  WHERE NOT s.blocked
    AND s.chain_id % 20 NOT IN (5, 6)
    AND s.chain_id NOT IN (SELECT user_id FROM events WHERE value > 200)
  GROUP BY s.target_id, s.chain_id, e.event_type)""", select=f"""
SELECT {_STATE_COLUMNS} FROM writes UNION ALL
SELECT {_STATE_COLUMNS} FROM replayed r WHERE NOT EXISTS (
  SELECT 1 FROM writes w WHERE w.target_id = r.target_id AND w.chain_id = r.chain_id AND w.key = r.key)""")
# An altered click stays where it was already applied and no pending change writes the key again.
_VERDICTS = """
kept_clicks AS (
  SELECT s.target_id, s.chain_id FROM eslots s JOIN changes c ON c.chain_id = s.chain_id
  WHERE NOT s.blocked AND s.chain_id % 9 = 2 AND c.key = 'click'
  GROUP BY s.target_id, s.chain_id, s.prefix HAVING max(c.version) <= s.prefix),
verdicts AS (
  SELECT chain_id, 2 * (SELECT count(*) FROM kept_clicks k WHERE k.chain_id = c.chain_id) AS differing_rows
  FROM (SELECT DISTINCT chain_id FROM changes) c)"""
ORACLE["shadow_verdicts"] = _with(_EVENTS, _EVENT_SLOTS, _VERDICTS, select="""
SELECT chain_id, differing_rows FROM verdicts""")
ORACLE["commit_after_shadow"] = _with(
    _EVENTS, _EVENT_SLOTS, _VERDICTS, _chain("elog", "SELECT chain_id, version, body FROM changes"), f"""
faults AS (
  SELECT chain_id, 'E43' AS code FROM verdicts WHERE differing_rows > 0
  UNION ALL SELECT DISTINCT chain_id, 'E30' FROM changes WHERE chain_id % 20 = 6
  UNION ALL SELECT DISTINCT chain_id, 'E34' FROM changes WHERE chain_id % 20 = 5
  UNION ALL SELECT DISTINCT chain_id, 'E36' FROM changes WHERE chain_id % 20 NOT IN (5, 6) AND value > 200)""", select=f"""
SELECT chain_id, CAST(max(version) + 1 AS INTEGER) AS version, arg_max(hash, version) AS previous_hash,
  {_link("arg_max(hash, version)", "'-- base of :IGNORED' || chr(10) || 'select :SCHEMA_NAME'")} AS hash, CAST(NULL AS VARCHAR) AS error_codes
FROM elog WHERE chain_id NOT IN (SELECT chain_id FROM faults) GROUP BY chain_id
UNION ALL
SELECT chain_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), string_agg(code, ',' ORDER BY code) FROM faults GROUP BY chain_id""")
ORACLE["replay_counts"] = _with(_EVENTS, _EVENT_SLOTS, _INCREMENTAL, select="""
SELECT target_id, chain_id, count(*) AS n_rows FROM replayed GROUP BY ALL""")
ORACLE["evolve_union"] = """
SELECT event_id, user_id, NULL AS props, NULL AS value FROM events WHERE event_type IN ('click', 'view')
UNION ALL BY NAME SELECT event_id, user_id, props FROM events WHERE event_type = 'error'
UNION ALL BY NAME SELECT event_id, value, user_id FROM events WHERE event_type IN ('signup', 'purchase')"""
ORACLE["apply_stream"] = _with(_EVENTS, select="""
SELECT chain_id AS target_id, chain_id, key, max(version) AS version, arg_max(value, version) AS value
FROM changes GROUP BY chain_id, key""")

_SCANNED = _with(_LOG, select="""
SELECT chain_id, version, filename, previous_hash, hash, body, CAST(NULL AS VARCHAR) AS error_code FROM log""")
for _name in ("scanned_changes", "streamed_change_files", "change_table", "committed_files"):
    ORACLE[_name] = _SCANNED
_SNIPPETS = """
snippets AS (
  SELECT chain_id, 'fixtures/base.sql' AS path, '/* ' || replace(text, '*/', '') || ' */' AS text FROM candidates
  UNION ALL
  SELECT chain_id, 'fixtures/sub/more.sql', '--! include ../base.sql' || chr(10) || 'select :SCHEMA_NAME.x'
  FROM candidates WHERE chain_id % 4 <> 1)"""
ORACLE["scanned_candidates"] = _with(_CANDIDATES, select="SELECT chain_id, body FROM candidates")
ORACLE["watched_candidates"] = _with(_CANDIDATES, select="""
SELECT chain_id, 1 AS state, body FROM candidates
UNION ALL SELECT chain_id, 2, CASE WHEN chain_id % 3 = 1 THEN '-- edited' || chr(10) || body ELSE '' END
FROM candidates WHERE chain_id % 3 > 0""")
ORACLE["scanned_snippets"] = _with(_CANDIDATES, _SNIPPETS, select="SELECT chain_id, path, text FROM snippets")
ORACLE["scanned_stamps"] = _with(_LOG, _CANDIDATES, _SNIPPETS, select=f"""
SELECT path, octet_length(encode(text))::BIGINT AS size, true AS has_time FROM (
  SELECT chain_id || '/committed/' || filename AS path, {_RENDERED} AS text FROM log
  UNION ALL SELECT chain_id || '/current.sql', body FROM candidates
  UNION ALL SELECT chain_id || '/' || path, text FROM snippets)""")
ORACLE["stamps_of_projects"] = ORACLE["scanned_stamps"]
