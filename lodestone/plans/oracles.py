"""DuckDB SQL for the queries of the estate engine."""

from __future__ import annotations

from lodestone.operators import gaps, rules
from lodestone.plans import golden
from lodestone.plans.estate import ITEMS, with_estate
from lodestone.sources.readers import vocabulary

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DOCS = "docs AS (SELECT 'doc/' || doc_id || '.' || coalesce(lang, '') AS path, coalesce(text, '') AS text, doc_id FROM documents)"


def _lines(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{_BREAK}')) + CASE WHEN {text} = '' OR regexp_matches({text}, '({_BREAK})\\z') THEN 0 ELSE 1 END"


def _ending(text: str) -> str:
    crlf = f"len(regexp_extract_all({text}, '\\r\\n'))"
    lf, cr = (f"(len(regexp_extract_all({text}, '{c}')) - {crlf})" for c in ("\\n", "\\r"))
    return f"CASE WHEN ({crlf} > 0)::INT + ({lf} > 0)::INT + ({cr} > 0)::INT > 1 THEN 'mixed' WHEN {crlf} > 0 THEN 'crlf' WHEN {lf} > 0 THEN 'lf' WHEN {cr} > 0 THEN 'cr' ELSE 'none' END"


_EXT_KIND = """CASE {e} WHEN 'cbl' THEN 'program' WHEN 'cpy' THEN 'copybook' WHEN 'dcl' THEN 'copybook' WHEN 'jcl' THEN 'jcl' WHEN 'prc' THEN 'jcl' WHEN 'csd' THEN 'csd' WHEN 'bms' THEN 'bms'
  WHEN 'sql' THEN 'ddl' WHEN 'ams' THEN 'idcams' WHEN 'ctl' THEN 'control' WHEN 'md' THEN 'doc' ELSE 'other' END"""

# programs of the synthetic control flow
_FLOW = ITEMS + """
, n AS (SELECT l_orderkey, max(pos) AS n FROM items GROUP BY 1
), paragraphs AS (SELECT l_orderkey AS program, pos AS ord, l_returnflag = 'R' AS terminal FROM items
), transfers AS (
  SELECT l_orderkey AS program, pos AS ord, CASE WHEN l_partkey % 3 = 0 THEN 'GO TO' ELSE 'PERFORM' END AS type, CAST(l_suppkey % n + 1 AS INT) AS lo,
    CASE WHEN l_partkey % 3 = 0 THEN CAST(l_suppkey % n + 1 AS INT) ELSE CAST(l_partkey % n + 1 AS INT) END AS hi
  FROM items JOIN n USING (l_orderkey) WHERE l_returnflag <> 'A' OR pos = 1
), members AS (
  SELECT program, ord, lo + u AS member, hi < lo AS backwards FROM (SELECT *, unnest(range(0, greatest(hi - lo, 0) + 1)) AS u FROM transfers WHERE type = 'PERFORM')
)"""
_STATEMENTS = """
st AS (
  SELECT l_orderkey AS program, l_suppkey % 3 AS paragraph, (['IF', 'EVALUATE', 'PERFORM', 'MOVE', 'SEARCH', 'READ'])[l_partkey % 6 + 1] AS verb, l_partkey % 4 AS branches,
    (['until', 'times', 'varying', 'none'])[l_suppkey % 4 + 1] AS loop, l_partkey % 2 AS phrases, l_linenumber AS depth FROM lineitem
), complexity AS (
  SELECT program, paragraph, CAST(1 + sum(CASE WHEN verb = 'IF' THEN 1 WHEN verb IN ('EVALUATE', 'SEARCH') THEN branches WHEN verb = 'PERFORM' AND loop IN ('until', 'varying') THEN 1 ELSE 0 END + phrases) AS BIGINT) AS complexity
  FROM st GROUP BY program, paragraph
)"""
_CLOSED = """
, reach AS (
  SELECT program, ord AS start, ord AS node FROM (SELECT l_orderkey AS program, pos AS ord FROM items)
  UNION SELECT r.program, r.start, m.member FROM reach r JOIN members m ON m.program = r.program AND m.ord = r.node
), closed AS (
  SELECT DISTINCT r.program, r.start AS ord, 'W' || (l_partkey % 10) AS name FROM reach r JOIN items ON l_orderkey = r.program AND pos = r.node
)"""
_DDS = ITEMS + """
, dds0 AS (SELECT l_orderkey AS job, 1 AS step, pos AS ord, CASE WHEN pos % 3 <> 0 THEN 'DD' || (l_suppkey % 4) END AS ddname, CASE WHEN l_partkey % 6 <> 0 THEN 'PROD.D' || (l_partkey % 200) END AS dsn FROM items
), dds AS (SELECT job, step, ord, dsn, last_value(ddname IGNORE NULLS) OVER (PARTITION BY job ORDER BY ord) AS dd FROM dds0
), named AS (SELECT job, step, dd AS ddname, arg_min_null(dsn, ord) AS dsn FROM dds WHERE dd IS NOT NULL GROUP BY job, step, dd
), selects AS (
  SELECT 'PGM' || i AS program, 'IN-FILE' AS "select", 'DD' || (i % 4) AS ddname FROM range(50) t(i)
  UNION ALL SELECT 'PGM' || i, 'OUT-FILE', 'DD' || (i % 3) FROM range(50) t(i) WHERE i % 5 <> 0
), needs AS (SELECT o_orderkey AS job, 1 AS step, program, "select", ddname FROM orders JOIN selects ON program = 'PGM' || (o_custkey % 50)
)"""
_FLOWS = """flows AS (
  SELECT 'PGM' || (l_suppkey % 40) AS program, 'dataset:' || p_brand || ':' || (l_partkey % 3) AS entity, (['read', 'write', 'update', 'delete'])[l_partkey % 4 + 1] AS direction FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
# issues of the resolver, and the policy as rows
_ISSUES = """
, issues AS (
  SELECT ord, path, line, from_id AS subject, type || coalesce(' ' || target, '') AS message, target,
    CASE WHEN type = 'DYNAMIC_CALL' THEN 'dynamic_call' WHEN type = 'STATIC_CALL' AND resolution = 'system' THEN 'system_program'
      WHEN type = 'STATIC_CALL' AND resolution = 'unresolved' THEN 'missing_program' WHEN type = 'JCL_EXEC' AND resolution = 'unresolved' THEN 'missing_jcl_program'
      WHEN type = 'CSD_TRANSACTION' AND resolution = 'unresolved' THEN 'csd_program_missing'
      WHEN type = 'COPY' AND resolution = 'ambiguous' THEN 'ambiguous_member' WHEN type = 'COPY' AND resolution = 'unresolved' THEN 'missing_copybook'
      WHEN type = 'SQL_TABLE' AND resolution = 'undefined' THEN 'undefined_table' WHEN type = 'CICS_FILE' AND resolution = 'unresolved' THEN 'missing_cics_file'
      WHEN type = 'CICS_RETURN_TRANSID' AND resolution = 'unresolved' THEN 'missing_transaction' END AS code
  FROM resolved
), leveled AS (SELECT *, CASE WHEN code IN ('dynamic_call', 'system_program', 'undefined_table') THEN 'info' ELSE 'warning' END AS level FROM issues WHERE code IS NOT NULL)"""
def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_POLICY = "(VALUES " + ", ".join(f"('{c}', '{s}', '{k}', '{gaps.ACTIONS.get(c, gaps.DEFAULT_ACTION).replace(chr(39), chr(39) * 2)}')" for (s, k), codes in gaps.POLICY.items() for c in codes.split()) + ") p(code, severity, category, action)"
_GAPS = f"""{_ISSUES}
, gaps AS (
  SELECT 'gap:' || i.code || ':' || regexp_replace(subject, '^[^:]*:', '') AS gap_id, coalesce(any_value(p.severity), CASE any_value(level) WHEN 'warning' THEN 'medium' ELSE 'low' END) AS severity,
    coalesce(any_value(p.category), 'Other') AS category, i.code, subject, CASE count(*) WHEN 1 THEN min(message) ELSE regexp_replace(subject, '^[^:]*:', '') || ': ' || count(*) || ' x ' || replace(i.code, '_', ' ') END AS title,
    count(*) AS count, count(DISTINCT (path, line)) AS n_locations, array_to_string(list(message ORDER BY i.ord, message, path, line)[:20], '; ') AS details, coalesce(any_value(p.action), 'Review the finding.') AS action
  FROM leveled i LEFT JOIN {_POLICY} ON p.code = i.code WHERE i.code NOT IN ('system_program', 'dynamic_call', 'undefined_table') GROUP BY i.code, subject
), spots AS (SELECT code, subject, path, line, min(ord) AS o FROM leveled GROUP BY code, subject, path, line
), placed AS (SELECT code, subject, array_to_string(list(path || ':' || line ORDER BY o, path, line)[:50], '; ') AS locations FROM spots GROUP BY code, subject)"""
_ORDER = "list_position(['high', 'medium', 'low'], severity), list_position(['" + "', '".join(gaps.CATEGORIES) + "'], category), count DESC, subject, code"
_REL = "CASE type WHEN 'JCL_EXEC' THEN 'RUNS' WHEN 'CSD_TRANSACTION' THEN 'STARTS' WHEN 'STATIC_CALL' THEN 'CALLS' WHEN 'COPY' THEN 'COPIES' END"
_GRAPH = f"""
, defined AS (
  SELECT id, any_value(label) AS label, min(name) AS name, false AS missing FROM (
    SELECT id, 'Program' AS label, name FROM programs UNION ALL SELECT id, 'Copybook', member FROM copybooks UNION ALL SELECT 'transaction:' || name, 'Transaction', name FROM csd WHERE type = 'TRANSACTION'
    UNION ALL SELECT 'job:JOB' || o_orderkey, 'Job', 'JOB' || o_orderkey FROM orders UNION ALL SELECT id, 'DataStore', name FROM tables) GROUP BY id
), mapped AS (SELECT *, {_REL} AS rel FROM edges WHERE {_REL} IS NOT NULL
), gnodes AS (
  SELECT * FROM defined UNION ALL
  SELECT DISTINCT to_id, CASE split_part(to_id, ':', 1) WHEN 'program' THEN 'Program' WHEN 'copybook' THEN 'Copybook' END, regexp_replace(to_id, '^[^:]*:', ''), true FROM mapped
  WHERE to_id NOT IN (SELECT id FROM defined) AND split_part(to_id, ':', 1) IN ('program', 'copybook')
), rels AS (SELECT from_id, rel AS type, to_id, sum(count) AS count FROM mapped WHERE from_id IN (SELECT id FROM gnodes) AND to_id IN (SELECT id FROM gnodes) GROUP BY ALL
)"""
_CALLERS = """
, behind AS (
  SELECT to_id AS copybook, from_id AS member FROM resolved WHERE type = 'COPY' AND resolution IN ('resolved', 'ambiguous')
), callers AS (
  SELECT DISTINCT to_id AS id, from_id AS caller FROM resolved WHERE type = 'STATIC_CALL' AND resolution = 'resolved'
  UNION SELECT r.to_id, b.member FROM resolved r JOIN behind b ON r.from_id = b.copybook WHERE r.type = 'STATIC_CALL' AND r.resolution = 'resolved' AND b.member LIKE 'program:%'
), called AS (SELECT id, string_agg(caller, ',' ORDER BY caller) AS called_by, count(*) AS n FROM callers GROUP BY id
), executed AS (
  SELECT id, string_agg(f, ',' ORDER BY f) AS executed_by FROM (SELECT DISTINCT to_id AS id, from_id AS f FROM resolved WHERE type IN ('JCL_EXEC', 'CSD_TRANSACTION') AND resolution = 'resolved') GROUP BY id
), kinds AS (
  SELECT p.id, p.path, p.name, called.n AS n_called, executed_by, coalesce(executed_by, '') <> '' AS entry_point,
    CASE WHEN NOT scanned THEN 'unknown' WHEN has_cics OR p.name IN (SELECT name FROM csd WHERE type = 'PROGRAM') THEN 'online'
      WHEN p.id IN (SELECT to_id FROM resolved WHERE type = 'JCL_EXEC' AND resolution = 'resolved') THEN 'batch' WHEN has_using OR called.n > 0 THEN 'subroutine' ELSE 'batch' END AS kind
  FROM programs p LEFT JOIN called USING (id) LEFT JOIN executed USING (id)
)"""
_HEADERS = ["//STEP1 EXEC PGM=X", "       IDENTIFICATION DIVISION.", "MAP1 DFHMSD TYPE=MAP", " DEFINE TRANSACTION (AB)", "CREATE TABLE T (A INT)", " DEFINE CLUSTER (NAME(X))", "       01  REC-A.\n           05 A PIC X.", "plain", " DEFINE GDG (NAME(A.B))"]
_PIC = """
pics AS (
  SELECT p_partkey, ([ 'S9(' || p_size || ')V9(' || m || ')', 'X(' || p_size || ')', '9(' || m || ')PP', 'ZZ,ZZ9.99CR', 'A(' || m || ')B', 'N(' || p_size || ')', 'VPP9(' || m || ')'])[p_partkey % 7 + 1] AS pic,
    (['DISPLAY', 'COMP', 'COMP-3', 'COMP-5', 'COMP-1'])[p_partkey % 5 + 1] AS usage, p_partkey % 7 AS shape, p_size AS n, m
  FROM (SELECT *, p_partkey % 9 + 1 AS m FROM part)
), told AS (
  SELECT p_partkey, pic, usage, (['numeric', 'alphanumeric', 'numeric', 'numeric-edited', 'alphanumeric-edited', 'national', 'numeric'])[shape + 1] AS category,
    CAST(([n + m, n, m, 11, m + 1, n, m])[shape + 1] AS INT) AS positions, CAST(([n + m, 0, m, 3, 0, 0, m])[shape + 1] AS INT) AS digits, CAST(([m, 0, -2, 0, 0, 0, m + 2])[shape + 1] AS INT) AS scale, shape = 0 AS signed FROM pics
)
SELECT *, CAST(CASE WHEN usage = 'COMP-1' THEN 4 WHEN usage IN ('COMP', 'COMP-5') THEN CASE WHEN digits <= 4 THEN 2 WHEN digits <= 9 THEN 4 ELSE 8 END WHEN usage = 'COMP-3' THEN digits // 2 + 1
  WHEN category = 'national' THEN positions * 2 ELSE positions + signed::INT END AS INT) AS bytes FROM told"""
_TYPES = """
t AS (
  SELECT p_partkey, (['CHAR', 'VARCHAR', 'DECIMAL', 'INTEGER', 'SMALLINT', 'BIGINT', 'DATE', 'TIMESTAMP', 'BLOB'])[p_partkey % 9 + 1] AS type, p_partkey % 9 AS len, p_partkey % 9 AS prec, p_partkey % 3 AS sc,
    (['numeric', 'alphanumeric', 'group', 'numeric-edited'])[p_size % 4 + 1] AS cat, CASE WHEN p_partkey % 23 <> 0 THEN p_size % 9 END AS size, (['COMP', 'COMP-3', 'DISPLAY'])[p_size % 3 + 1] AS usage, p_size % 9 AS digits, CASE WHEN p_size % 2 = 0 THEN p_size % 3 END AS fs
  FROM part
)
SELECT p_partkey, type, CASE WHEN size IS NULL THEN NULL
  WHEN type = 'CHAR' THEN CASE WHEN cat NOT IN ('alphanumeric', 'group') THEN 'category' WHEN size <> len THEN 'length' END
  WHEN type = 'VARCHAR' THEN CASE WHEN cat <> 'group' AND size > len THEN 'length' END
  WHEN type = 'DECIMAL' THEN CASE WHEN cat <> 'numeric' THEN 'category' WHEN digits <> prec OR coalesce(fs, 0) <> sc THEN 'digits' WHEN usage <> 'COMP-3' THEN 'usage' END
  WHEN type IN ('INTEGER', 'SMALLINT', 'BIGINT') THEN CASE WHEN cat <> 'numeric' OR usage <> 'COMP' OR size <> CASE type WHEN 'SMALLINT' THEN 2 WHEN 'INTEGER' THEN 4 ELSE 8 END THEN 'binary' END
  WHEN type = 'DATE' THEN CASE WHEN size < 10 THEN 'length' END WHEN type = 'TIMESTAMP' THEN CASE WHEN size < 26 THEN 'length' END END AS reason FROM t"""
# the classifier's table of parts, decided by shape
_BRANCHES = """
b AS (
  SELECT p_partkey AS branch, p_partkey % 11 AS a, (['1000-MAIN', '9100-ERR', 'ABEND-IT', '2000-CALC'])[p_size % 4 + 1] AS para, p_size % 5 AS act,
    CASE WHEN p_partkey % 11 BETWEEN 6 AND 9 THEN 'PHRASE' WHEN p_partkey % 5 = 0 THEN 'WHEN' ELSE 'IF' END AS kind FROM part
), v AS (
  SELECT branch, CASE
    WHEN a = 6 THEN {'c': 'error_handling', 's': 1} WHEN a = 7 THEN {'c': 'control_flow', 's': 1} WHEN a = 8 THEN {'c': 'error_handling', 's': CASE WHEN act = 0 THEN 3 ELSE 2 END} WHEN a = 9 THEN {'c': 'calculation', 's': 3}
    WHEN a = 1 THEN {'c': 'error_handling', 's': 1}
    WHEN para IN ('9100-ERR', 'ABEND-IT') THEN {'c': 'error_handling', 's': 2}
    WHEN kind = 'WHEN' AND act IN (1, 3) THEN {'c': 'routing', 's': CASE WHEN a IN (4, 5) THEN 3 ELSE 2 END}
    WHEN a = 3 OR a = 0 THEN {'c': 'limit', 's': CASE WHEN act = 0 THEN 4 ELSE 3 END}
    WHEN act IN (0, 3) THEN {'c': 'validation', 's': CASE WHEN act = 0 THEN 4 ELSE 3 END}
    WHEN a = 4 THEN {'c': CASE WHEN act = 2 THEN 'state_change' ELSE 'decision' END, 's': 3}
    WHEN a = 2 THEN {'c': 'control_flow', 's': 1}
    WHEN a = 5 THEN {'c': 'decision', 's': 2} ELSE {'c': 'decision', 's': 1} END AS r FROM b
)
SELECT branch, r.c AS category, CAST(r.s AS INT) AS significance, r.s >= 3 AND r.c NOT IN ('error_handling', 'control_flow') AS business FROM v"""

ORACLES: dict[str, str] = {
    "file_catalog": f"""WITH {_DOCS} SELECT path, 'other' AS kind, octet_length(encode(text)) AS size_bytes, CAST({_lines('text')} AS BIGINT) AS lines, sha256(text) AS sha256, 'utf-8' AS encoding, {_ending('text')} AS line_ending, regexp_matches(text, '[\\n\\r]\\z') AS final_newline FROM docs""",
    "classify_by_extension": f"""SELECT p_partkey, 'a.b/' || replace(p_name, ' ', '_') || '.' || e AS path, {_EXT_KIND.format(e='e')} AS kind FROM (SELECT *, (['cbl', 'cpy', 'jcl', 'csd', 'bms', 'sql', 'ams', 'ctl', 'md', 'xyz', 'prc', 'dcl'])[p_partkey % 12 + 1] AS e FROM part)""",
    "sniff_content": f"""WITH {_DOCS}, h AS (SELECT doc_id, doc_id % 9 AS k, upper(left(text, 19000)) AS u FROM docs)
SELECT doc_id, CASE k WHEN 0 THEN 'jcl' WHEN 1 THEN 'program' WHEN 2 THEN 'bms' WHEN 3 THEN 'csd' WHEN 4 THEN 'ddl' WHEN 5 THEN 'idcams' WHEN 6 THEN 'copybook' WHEN 8 THEN 'idcams' ELSE 'none' END AS kind FROM h""",
    "line_endings": f"""WITH {_DOCS}, t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN text || chr(13) || chr(10) || chr(10) ELSE text END AS x FROM docs) SELECT doc_id, {_ending('x')} AS line_ending, CAST({_lines('x')} AS BIGINT) AS lines FROM t""",
    "blank_members": f"WITH {_DOCS} SELECT doc_id FROM docs WHERE doc_id % 10 = 0 OR NOT regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')",
    "format_votes": f"""WITH {_DOCS}, m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '       ' || replace(text, chr(10), chr(10) || '       ') ELSE text END AS text FROM docs
), l AS (SELECT doc_id, unnest(CASE WHEN text = '' THEN [] WHEN regexp_matches(text, '({_BREAK})\\z') THEN regexp_split_to_array(text, '{_BREAK}')[:-2] ELSE regexp_split_to_array(text, '{_BREAK}') END) AS raw FROM m
), f AS (SELECT doc_id, raw, length(raw) - length(ltrim(raw, ' ')) AS first FROM l
), v AS (SELECT doc_id, CASE WHEN trim(raw, ' ' || chr(9) || chr(11) || chr(12)) = '' THEN NULL WHEN first >= 6 OR (length(raw) > 6 AND substring(raw, 7, 1) IN (' ', '*', '-', '/', 'd', 'D') AND (trim(left(raw, 6)) = '' OR regexp_full_match(trim(left(raw, 6)), '[0-9]+'))) THEN 'fixed'
  WHEN substring(raw, first + 1, 1) = '*' OR (length(raw) > 6 AND NOT contains(substring(raw, first + 1, greatest(7 - first, 0)), ' ')) THEN 'free' END AS vote FROM f
), c AS (SELECT doc_id, count(*) FILTER (vote = 'fixed') AS fixed_votes, count(*) FILTER (vote = 'free') AS free_votes FROM v GROUP BY doc_id)
SELECT *, CASE WHEN free_votes > greatest(2, fixed_votes // 4) THEN 'free' ELSE 'fixed' END AS format FROM c""",
    "keyword_hits": f"""WITH {_DOCS}, w AS (SELECT unnest(regexp_extract_all(upper(text), '[A-Z0-9-]+')) AS word FROM docs) SELECT word, count(*) AS n FROM w WHERE word IN ({', '.join(f"'{v}'" for v in rules.VERBS)}) GROUP BY word""",
    "picture_analysis": f"WITH {_PIC}",
    "resolve_references": with_estate(" SELECT ord, type, from_id, target, to_id, resolution FROM resolved"),
    "resolve_copy": with_estate(" SELECT ord, target, resolution, CASE WHEN resolution = 'ambiguous' THEN c.n ELSE 0 END AS candidates FROM resolved LEFT JOIN copy_names c ON c.name = target WHERE type = 'COPY'"),
    "missing_member_issues": with_estate(f"{_ISSUES} SELECT level AS severity, code, target, count(*) AS n, min(path) AS first_path FROM leveled GROUP BY ALL"),
    "table_suffix_resolution": with_estate(" SELECT target, to_id, resolution, count(*) AS n FROM resolved WHERE type = 'SQL_TABLE' GROUP BY ALL"),
    "reference_ids": with_estate(" SELECT printf('R%05d', row_number() OVER (ORDER BY path, line, type, coalesce(target, ''), ord)) AS ref_id, ord, type FROM refs"),
    "first_wins_dedup": with_estate(" SELECT from_id, type, arg_min_null(target, ord) AS target, min(ord) AS ord FROM refs GROUP BY from_id, type"),
    "edge_aggregate": with_estate(" SELECT from_id, to_id, type, resolution, count FROM edges"),
    "graph_nodes": with_estate("""
, ends AS (
  SELECT id, min_by(status, (path, line, type, coalesce(target, ''), ord, side)) AS status FROM (
    SELECT to_id AS id, CASE WHEN resolution IN ('resolved', 'ambiguous') THEN 'defined' WHEN resolution = 'unresolved' THEN 'missing' ELSE resolution END AS status, path, line, type, target, ord, 0 AS side FROM resolved WHERE to_id IS NOT NULL
    UNION ALL SELECT from_id, 'defined', path, line, type, target, ord, 1 FROM resolved WHERE to_id IS NOT NULL) GROUP BY id
), own AS (SELECT id, any_value(kind) AS kind, min(path) AS path FROM (SELECT id, 'program' AS kind, path FROM programs UNION ALL SELECT id, 'copybook', path FROM copybooks) GROUP BY id
), alln AS (SELECT coalesce(e.id, o.id) AS id, coalesce(o.kind, split_part(e.id, ':', 1)) AS kind, CASE WHEN o.id IS NOT NULL THEN 'defined' ELSE e.status END AS status, o.path FROM ends e FULL JOIN own o ON e.id = o.id)
SELECT kind, status, count(*) AS n, min(id) AS first_id, count(path) AS with_path FROM alln GROUP BY kind, status"""),
    "called_by": with_estate(f"{_CALLERS} SELECT id, called_by FROM called"),
    "copybook_caller_expansion": with_estate(" SELECT DISTINCT to_id AS copybook, from_id AS program FROM resolved WHERE type = 'COPY' AND resolution IN ('resolved', 'ambiguous') AND from_id LIKE 'program:%'"),
    "executed_by": with_estate(f"{_CALLERS} SELECT id, executed_by FROM executed"),
    "copybook_map": with_estate(" SELECT id, string_agg(u, ',' ORDER BY u) AS used_by FROM (SELECT DISTINCT to_id AS id, regexp_replace(from_id, '^[^:]*:', '') AS u FROM resolved WHERE type = 'COPY' AND resolution IN ('resolved', 'ambiguous')) GROUP BY id"),
    "program_kind": with_estate(f"{_CALLERS} SELECT id, path, kind, entry_point FROM kinds"),
    "unreached_programs": with_estate(f"""{_CALLERS}, told AS (SELECT id AS subject, path, CASE WHEN kind = 'subroutine' AND n_called IS NULL THEN 'subroutine_without_callers' WHEN kind = 'batch' AND n_called IS NULL AND NOT entry_point THEN 'program_not_executed'
  WHEN kind = 'online' AND name NOT IN (SELECT name FROM csd WHERE type = 'PROGRAM') THEN 'online_program_not_in_csd' END AS code FROM kinds) SELECT *, CASE WHEN code = 'online_program_not_in_csd' THEN 'warning' ELSE 'info' END AS severity FROM told WHERE code IS NOT NULL"""),
    "unused_copybooks": with_estate(" SELECT id, path FROM copybooks WHERE id NOT IN (SELECT to_id FROM resolved WHERE type = 'COPY' AND resolution IN ('resolved', 'ambiguous'))"),
    "name_collision": with_estate(" SELECT DISTINCT name FROM programs WHERE name IN (SELECT replace(member, 'CPY', 'PGM') FROM copybooks)"),
    "duplicate_program_ids": with_estate(" SELECT program_id, count(*) AS files, string_agg(path, ',' ORDER BY path) AS paths FROM programs WHERE program_id IS NOT NULL GROUP BY program_id HAVING count(*) > 1"),
    "attach_check": with_estate(" SELECT r.to_id AS subject, r.from_id, r.path, r.line FROM resolved r WHERE type = 'JCL_EXEC' AND resolution = 'resolved' AND to_id IN (SELECT id FROM programs WHERE has_sql AND NOT has_cics) AND to_id NOT IN (SELECT from_id FROM refs WHERE type = 'STATIC_CALL' AND ord % 7 = 0)"),
    "csd_programs_without_source": with_estate(" SELECT name, line FROM csd WHERE type = 'PROGRAM' AND name NOT IN (SELECT member FROM programs WHERE scanned)"),
    "conflicting_definitions": """SELECT 'CL.' || s_nationkey || '.' || (s_suppkey % 7) AS name, count(*) AS definitions FROM supplier GROUP BY 1 HAVING count(DISTINCT (s_suppkey % 2, s_suppkey % 3)) > 1""",
    "scope_reachability": with_estate(", walk AS (SELECT 'transaction:T1' AS node, 0 AS depth UNION SELECT to_id, depth + 1 FROM walk JOIN edges ON from_id = node WHERE depth < 40) SELECT node, min(depth) AS depth FROM walk GROUP BY node", True),
    "bounded_impact": with_estate(""", calls AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM resolved WHERE to_id IS NOT NULL AND type IN ('STATIC_CALL', 'CSD_TRANSACTION', 'COPY')
), walk AS (SELECT seed, seed AS node, 0 AS depth FROM (VALUES ('transaction:T1'), ('transaction:T4')) s(seed) UNION SELECT seed, dst, depth + 1 FROM walk JOIN calls ON src = node WHERE depth < 5) SELECT seed, node, depth FROM walk WHERE depth > 0""", True),
    "recursion_cycles": f"WITH RECURSIVE {_FLOW}, r AS (SELECT DISTINCT program, ord, member FROM members UNION SELECT r.program, r.ord, m.member FROM r JOIN members m ON m.program = r.program AND m.ord = r.member) SELECT program, ord AS node FROM r WHERE ord = member",
    "perform_thru_range": f"WITH {_FLOW} SELECT program, ord, CAST(member AS INT) AS member, backwards FROM members",
    "fall_through": f"WITH {ITEMS}, x AS (SELECT l_orderkey AS program, pos AS ord, l_returnflag AS f, lead(pos) OVER (PARTITION BY l_orderkey ORDER BY pos) AS next FROM items) SELECT program, ord, next FROM x WHERE f <> 'R' AND next IS NOT NULL",
    "cfg_reachability": f"""WITH RECURSIVE {_FLOW}, walk AS (
  SELECT program, min(ord) AS ord, true AS flow FROM paragraphs GROUP BY program
  UNION
  SELECT * FROM (
    SELECT p.program, p.ord + 1, true FROM walk w JOIN paragraphs p ON p.program = w.program AND p.ord = w.ord WHERE w.flow AND NOT p.terminal
    UNION ALL SELECT w.program, t.lo, true FROM walk w JOIN transfers t ON t.program = w.program AND t.ord = w.ord WHERE t.type = 'GO TO'
    UNION ALL SELECT w.program, m.member, false FROM walk w JOIN members m ON m.program = w.program AND m.ord = w.ord)
) SELECT program, ord, (program, ord) IN (SELECT (program, ord) FROM walk) AS reachable FROM paragraphs""",
    "cyclomatic": f"WITH {_STATEMENTS} SELECT * FROM complexity",
    "statement_metrics": f"WITH {_STATEMENTS}, v AS (SELECT program, verb, count(*) AS n, max(depth) AS depth FROM st GROUP BY program, verb) SELECT program, CAST(sum(n) AS BIGINT) AS statements, max(depth) AS max_nesting, string_agg(verb || '=' || n, ',' ORDER BY verb || '=' || n) AS verbs FROM v GROUP BY program",
    "writes_closure": f"WITH RECURSIVE {_FLOW}{_CLOSED} SELECT program, ord, name FROM closed",
    "loop_termination": f"""WITH RECURSIVE {_FLOW}{_CLOSED}, body AS (SELECT DISTINCT m.program, m.ord, c.name FROM members m JOIN closed c ON c.program = m.program AND c.ord = m.member)
SELECT l_orderkey AS program, pos AS ord, CASE WHEN pos % 4 = 0 THEN 'counted' WHEN pos % 5 = 0 THEN 'unknown' WHEN name IS NOT NULL THEN 'condition_updated_in_loop' ELSE 'potential_infinite' END AS termination
FROM items LEFT JOIN body ON program = l_orderkey AND ord = pos AND name = 'W' || (l_suppkey % 10)""",
    "dd_carry_forward": f"WITH {_DDS} SELECT job, ord, dd FROM dds",
    "dataset_lineage": f'WITH {_DDS} SELECT job, step, program, "select", ddname, dsn FROM needs JOIN named USING (job, step, ddname)',
    "missing_dds": f'WITH {_DDS} SELECT job, step, program, "select", ddname FROM needs ANTI JOIN named USING (job, step, ddname)',
    "dataset_rollup": f"WITH {_DDS} SELECT dsn, count(DISTINCT program) AS programs, count(*) AS links, array_to_string(list_sort(list(DISTINCT ddname)), ',') AS ddnames FROM needs JOIN named USING (job, step, ddname) WHERE dsn IS NOT NULL GROUP BY dsn",
    "dsn_parts": """WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '&&' ELSE '' END || 'PROD.D' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '(+1)' WHEN 1 THEN '(MEM1)' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '.&HLQ' ELSE '' END AS dsn FROM part)
SELECT p_partkey, dsn, CASE WHEN p_partkey % 3 < 2 AND p_partkey % 7 <> 0 THEN split_part(dsn, '(', 1) ELSE dsn END AS base, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 <> 0 THEN '+1' END AS generation, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 7 <> 0 THEN 'MEM1' END AS member, p_partkey % 5 = 0 AS temporary, p_partkey % 7 = 0 AS symbolic FROM d""",
    "store_access_matrix": f"WITH {_FLOWS} SELECT entity, direction, string_agg(program, ',' ORDER BY program) AS programs FROM (SELECT DISTINCT * FROM flows) GROUP BY entity, direction",
    "producer_consumer": f"WITH {_FLOWS} SELECT DISTINCT w.program AS producer, entity, r.program AS consumer FROM (SELECT DISTINCT program, entity FROM flows WHERE direction IN ('write', 'update')) w JOIN (SELECT DISTINCT program, entity FROM flows WHERE direction = 'read') r USING (entity) WHERE w.program <> r.program",
    "open_modes": """WITH m AS (SELECT event_id, (['INPUT', 'OUTPUT', 'EXTEND', 'I-O', 'WHAT'])[event_id % 5 + 1] AS a, (['INPUT', 'OUTPUT', 'EXTEND'])[event_id % 3 + 1] AS b FROM events),
f AS (SELECT event_id, unnest(['FILE-A', 'FILE-B']) AS file, a AS mode FROM m WHERE a <> 'WHAT' UNION ALL SELECT event_id, 'FILE-C', b FROM m)
SELECT event_id, file, CASE mode WHEN 'INPUT' THEN 'read' WHEN 'I-O' THEN 'update' ELSE 'write' END AS access FROM f""",
    "type_compat": f"WITH {_TYPES}",
    "column_types": """SELECT p_partkey, CASE k WHEN 0 THEN 'CHAR' WHEN 1 THEN 'DECIMAL' WHEN 2 THEN 'DECIMAL' WHEN 3 THEN 'INTEGER' WHEN 4 THEN 'VARCHAR' WHEN 5 THEN 'TIMESTAMP' ELSE 'BLOB(' || p_size || ')' END AS type,
CASE WHEN k IN (0, 4) THEN p_size END AS length, CASE k WHEN 1 THEN p_size WHEN 2 THEN 5 END AS precision, CASE k WHEN 1 THEN 2 WHEN 2 THEN 0 END AS scale FROM (SELECT *, p_partkey % 7 AS k FROM part)""",
    "lrecl_check": "SELECT p_partkey, p_size AS size, CAST(p_partkey % 50 + 1 AS INT) AS lrecl, CASE WHEN p_partkey % 2 = 0 THEN 'VB' ELSE 'FB' END AS recfm FROM part WHERE CASE WHEN p_partkey % 2 = 0 THEN p_size > p_partkey % 50 + 1 - 4 ELSE p_size <> p_partkey % 50 + 1 END",
    "cluster_size_check": "SELECT p_partkey, p_size AS size, CAST(a AS INT) AS avg, CAST(m AS INT) AS max FROM (SELECT *, p_partkey % 30 AS a, p_partkey % 30 + p_partkey % 3 AS m FROM part) WHERE p_size > m OR (a = m AND p_size <> m)",
    "vsam_key_match": "SELECT 'CL' || s_suppkey AS name, s_suppkey % 5 AS key_offset, s_suppkey % 4 + 1 AS key_length FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey % 5 = s_suppkey % 5 AND l_linenumber % 4 = s_suppkey % 4)",
    "undefined_names": "WITH u AS (SELECT l_orderkey AS program, 'N' || (l_partkey % 50) AS name, l_linenumber AS line FROM lineitem WHERE l_linenumber % 3 = 0) SELECT program, name, count(*) AS uses, min(line) AS first_line FROM u WHERE (program, name) NOT IN (SELECT (l_orderkey, 'N' || (l_suppkey % 50)) FROM lineitem) GROUP BY program, name",
    "repeated_rule_groups": """WITH r AS (SELECT l_suppkey AS program, (['limit', 'validation', 'decision'])[l_partkey % 3 + 1] AS category, 'WS-F' || (l_partkey % 400) || ' > ' || (l_suppkey % 7) AS condition FROM lineitem WHERE l_partkey % 50 <> 0 AND l_partkey % 4 <> 0),
g AS (SELECT category, condition, count(*) AS members, count(DISTINCT program) AS programs FROM r GROUP BY category, condition HAVING count(*) > 1) SELECT 'rulegroup:' || row_number() OVER (ORDER BY members DESC, category, condition) AS id, * FROM g""",
    "rule_ids": f"""WITH {ITEMS} SELECT 'rule:' || l_suppkey || ':' || l_linenumber || CASE WHEN k > 1 THEN '.' || k ELSE '' END AS rule_id, ord FROM (SELECT *, l_orderkey * 100 + pos AS ord, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey * 100 + pos) AS k FROM items)""",
    "rule_classification": f"WITH {_BRANCHES}",
    "gap_register": with_estate(f"{_GAPS} SELECT gaps.*, locations FROM gaps JOIN placed USING (code, subject)"),
    "gap_ranking": with_estate(f"{_GAPS} SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, gap_id, severity FROM gaps ORDER BY {_ORDER} LIMIT 20"),
    "note_to_issue": """WITH n AS (SELECT 'cbl/' || l_orderkey AS path, (['nonstandard_comment', 'unterminated_literal', 'literal_truncated_at_column_72', 'copy_without_period'])[l_partkey % 4 + 1] AS code, l_suppkey % 5 + 1 AS line FROM lineitem),
k AS (SELECT DISTINCT path, code, line FROM n a WHERE NOT (code = 'unterminated_literal' AND EXISTS (SELECT 1 FROM n b WHERE b.path = a.path AND b.line = a.line AND b.code = 'literal_truncated_at_column_72')))
SELECT path, CASE code WHEN 'nonstandard_comment' THEN 'info' ELSE 'warning' END AS severity, code, CAST(min(line) AS INT) AS line, count(*) AS count, string_agg(line, ',' ORDER BY line) AS lines FROM k GROUP BY path, code""",
    "annotation_gate": f"""WITH {_DOCS}, f AS (SELECT CAST(doc_id AS VARCHAR) AS path, {_lines('text')} AS lines FROM docs)
SELECT doc_id AS item, 'unknown target' AS problem FROM labels WHERE doc_id % 97 >= 90 UNION ALL SELECT doc_id, 'unknown kind' FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'empty text' FROM labels WHERE doc_id % 13 = 0
UNION ALL SELECT doc_id, 'unknown confidence' FROM labels WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'no evidence' FROM labels WHERE doc_id % 19 = 0
UNION ALL SELECT doc_id, CASE WHEN f.path IS NULL THEN 'evidence file does not exist' ELSE 'evidence line does not exist' END FROM labels LEFT JOIN f ON f.path = CAST(doc_id + quality AS VARCHAR) WHERE doc_id % 19 <> 0 AND (f.path IS NULL OR toxic * 40 + 1 > f.lines)""",
    "inventory_stats": with_estate(" SELECT 'rows' AS metric, count(*) AS value FROM resolved UNION ALL SELECT 'type=' || type, count(*) FROM resolved GROUP BY type UNION ALL SELECT 'resolution=' || resolution, count(*) FROM resolved GROUP BY resolution"),
    "validate_stats": with_estate(" SELECT 'type=' || type AS metric, CASE WHEN type = 'COPY' THEN count(*) + 1 END AS stored, count(*) AS fresh FROM resolved WHERE type IN ('COPY', 'JCL_EXEC') GROUP BY type"),
    "referential_checks": with_estate(", there AS (SELECT id FROM programs UNION SELECT id FROM copybooks) SELECT type, 'from' AS side, count(*) AS n FROM edges WHERE from_id NOT IN (SELECT id FROM there) GROUP BY type UNION ALL SELECT type, 'to', count(*) FROM edges WHERE to_id NOT IN (SELECT id FROM there) GROUP BY type"),
    "top_k_complex": f"WITH {_STATEMENTS} SELECT program, CAST(sum(complexity - 1) + 1 AS BIGINT) AS complexity FROM complexity GROUP BY program ORDER BY 2 DESC, 1 LIMIT 10",
    "graph_counts": with_estate(f"{_GRAPH} SELECT label AS name, count(*) AS n, count(*) FILTER (missing) AS missing FROM gnodes GROUP BY label UNION ALL SELECT type, count(*), 0 FROM rels GROUP BY type"),
    "entry_points": with_estate(f"{_GRAPH} SELECT a.label AS kind, a.name AS entry, b.name AS program FROM rels r JOIN gnodes a ON a.id = from_id JOIN gnodes b ON b.id = to_id WHERE r.type IN ('RUNS', 'STARTS') AND b.label = 'Program'"),
    "missing_callees": with_estate(f"{_GRAPH} SELECT DISTINCT a.name AS caller, b.name AS missing FROM rels r JOIN gnodes a ON a.id = from_id JOIN gnodes b ON b.id = to_id WHERE r.type = 'CALLS' AND a.label = 'Program' AND b.label = 'Program' AND b.missing"),
    "copybook_impact": with_estate(f"{_GRAPH}, u AS (SELECT DISTINCT p.id, p.name FROM rels r JOIN gnodes c ON c.id = r.to_id JOIN gnodes p ON p.id = r.from_id WHERE r.type = 'COPIES' AND c.name = 'CPY10' AND c.label = 'Copybook' AND p.label = 'Program') SELECT u.name AS program, coalesce(string_agg(DISTINCT e.name, ',' ORDER BY e.name), '') AS entry_points FROM u LEFT JOIN (SELECT to_id, from_id FROM rels WHERE type IN ('RUNS', 'STARTS')) s ON s.to_id = u.id LEFT JOIN gnodes e ON e.id = s.from_id GROUP BY u.name"),
    "graph_csv_rows": with_estate(f"{_GRAPH} SELECT 'id:ID,name,missing:boolean,:LABEL' AS header, id || ',' || name || ',' || missing || ',Program' AS line FROM gnodes WHERE label = 'Program'"),
    "cypher_batches": with_estate(f"{_GRAPH}, b AS (SELECT label, id, (row_number() OVER (PARTITION BY label ORDER BY id) - 1) // 200 AS batch FROM gnodes) SELECT label, batch, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY label, batch"),
    "foreign_keys": 'SELECT n_name AS "table", r_name AS refers_to FROM nation JOIN region ON n_regionkey = r_regionkey',
    "paragraph_chains": f"""WITH RECURSIVE {_FLOW}, e AS (SELECT DISTINCT program, ord AS src, CAST(member AS INT) AS dst FROM members
), w AS (
  SELECT program, src AS node, [src] AS path, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT program, src FROM e WHERE (program, src) NOT IN (SELECT (program, dst) FROM e))
  UNION ALL SELECT w.program, e.dst, list_append(path, e.dst), list_append(used, e.src || '>' || e.dst) FROM w JOIN e ON e.program = w.program AND e.src = w.node WHERE len(path) < 5 AND NOT list_contains(used, e.src || '>' || e.dst)
) SELECT program, array_to_string(path, '>') AS chain FROM w WHERE len(path) > 1""",
}

ORACLES |= {
    "golden_files": golden.values(golden.FILES, "path, kind, line_ending, lines"),
    "golden_references": golden.values(golden.REFERENCES, "ref_id, type, from_id, to_id, resolution, path, line"),
    "golden_programs": golden.values(golden.PROGRAMS, "id, kind, called_by, executed_by"),
    "golden_issues": f"SELECT *, replace(code, '_', ' ') || ': ' || split_part(subject, ':', 2) AS message FROM ({golden.values(golden.ISSUES, 'severity, code, subject, path, line')})",
    "reserved_words": f"""SELECT word, CASE WHEN word IN ({_words(vocabulary.STARTING)}) THEN 'verb' WHEN word LIKE 'END-%' AND word NOT IN ('END-EXEC', 'END-OF-PAGE') THEN 'scope end'
WHEN word IN ({_words(vocabulary.FIGURATIVE)}) THEN 'figurative' WHEN word IN ({_words(vocabulary.USAGES)}) THEN 'usage' ELSE 'clause' END AS kind, false AS name FROM (SELECT unnest([{_words(vocabulary.RESERVED)}]) AS word)""",
    "golden_scope": golden.values(golden.SCOPE, "node, depth"),
    "golden_layout": golden.values(golden.LAYOUT, 'record, qualified_name, "offset", size, category'),
    "golden_paragraphs": golden.values(golden.PARAGRAPHS, "name, reachable, complexity"),
    "golden_parse_issues": golden.values(golden.PARSE_ISSUES, "severity, code, line"),
    "golden_branches": golden.values(golden.BRANCHES, "kind, condition, paragraph, category, significance"),
    "golden_rules": golden.values(golden.RULES, "rule_id, category, business"),
    "golden_loops": golden.values(golden.LOOPS, "line, type, condition, termination"),
    "golden_flows": golden.values(golden.FLOWS, "program, entity, direction"),
    "golden_record_lengths": golden.values([("program:SALES", "SALESIN", 19, 20)], "program, ddname, size, lrecl"),
    "golden_links": golden.values(golden.LINKS, 'ddname, dsn, "select"'),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
