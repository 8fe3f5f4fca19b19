"""SQL with the same results as the queries, for DuckDB."""

from __future__ import annotations

from ..functions import textrules as X

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _latest(table: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY chart_no ORDER BY loaded_at DESC, rec_id DESC) = 1)"


_ALT = f"CASE WHEN regexp_matches({_strip('climb_altitude')}, '^[+-]?[0-9]+$') THEN try_cast({_strip('climb_altitude')} AS INTEGER) END"
_TURN = f"CASE WHEN upper({_strip('turn_direction')}) IN ('LEFT', 'RIGHT', 'NONE', 'UNKNOWN') THEN upper({_strip('turn_direction')}) END"
_HOLD = f"CASE WHEN lower({_strip('holding_required')}) IN ('true', 'yes', '1') THEN true WHEN lower({_strip('holding_required')}) IN ('false', 'no', '0') THEN false END"
_FIX = f"CASE WHEN lower({_strip('holding_fix')}) NOT IN ('', 'null', 'none', 'unknown') THEN upper({_strip('holding_fix')}) END"
_WPS = f"list_distinct(list_filter(list_transform(coalesce(waypoints, []), lambda w: upper({_strip('coalesce(w, $$None$$)')})), lambda w: w <> ''))"


def _norm(table: str) -> str:
    return f"SELECT chart_no, {_ALT} AS alt, {_TURN} AS turn, {_HOLD} AS hold, {_FIX} AS fix, {_WPS} AS wps FROM {_latest(table)}"


_SCORES = f"""
WITH o AS ({_norm('path_o')}),
pred AS (SELECT 'A' AS path, * FROM ({_norm('path_a')}) UNION ALL SELECT 'C', * FROM ({_norm('path_c')})),
j AS (
  SELECT x.path, m.chart_no, m.pos, p.chart_no IS NOT NULL AS has_output,
         o.alt AS r_alt, o.turn AS r_turn, o.hold AS r_hold, CASE WHEN o.hold THEN o.fix END AS r_fix, coalesce(o.wps, []) AS r_wps,
         p.alt AS p_alt, p.turn AS p_turn, p.hold AS p_hold, CASE WHEN p.hold THEN p.fix END AS p_fix, coalesce(p.wps, []) AS p_wps
  FROM manifest m CROSS JOIN (VALUES ('A'), ('C')) x(path) LEFT JOIN o USING (chart_no) LEFT JOIN pred p ON p.chart_no = m.chart_no AND p.path = x.path),
c AS (
  SELECT path, chart_no, pos, has_output, u.* FROM j, LATERAL (VALUES
    ('climb_altitude', r_alt IS NOT NULL, p_alt IS NOT NULL, coalesce(r_alt = p_alt, false), 'wrong_value'),
    ('turn_direction', r_turn IS NOT NULL, p_turn IS NOT NULL, coalesce(r_turn = p_turn, false),
       CASE WHEN p_turn = 'NONE' AND r_turn IN ('LEFT', 'RIGHT') THEN 'missed_turn' WHEN p_turn IN ('LEFT', 'RIGHT') AND r_turn = 'NONE' THEN 'hallucinated_turn' ELSE 'wrong_direction' END),
    ('holding_required', r_hold IS NOT NULL, p_hold IS NOT NULL, coalesce(r_hold = p_hold, false), CASE WHEN r_hold THEN 'missed_hold' ELSE 'false_hold' END),
    ('holding_fix', r_fix IS NOT NULL, p_fix IS NOT NULL, coalesce(r_fix = p_fix, false), 'wrong_fix')) u(field, app, said, hit, wrong)),
w AS (
  SELECT path, chart_no, pos, has_output,
         CASE WHEN has_output THEN len(list_intersect(r_wps, p_wps)) ELSE 0 END AS tp,
         CASE WHEN has_output THEN len(p_wps) - len(list_intersect(r_wps, p_wps)) ELSE 0 END AS fp,
         len(r_wps) - CASE WHEN has_output THEN len(list_intersect(r_wps, p_wps)) ELSE 0 END AS fn
  FROM j),
ws AS (SELECT *, CASE WHEN NOT has_output THEN 0.0 WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn) END AS jaccard, has_output AND fp = 0 AND fn = 0 AS exact FROM w),
lab AS (
  SELECT path, chart_no, pos, field, field || ':' || CASE WHEN NOT app THEN 'spurious_prediction' WHEN NOT said THEN 'missing_prediction' ELSE wrong END AS label
  FROM c WHERE has_output AND (app OR said) AND NOT hit
  UNION ALL
  SELECT path, chart_no, pos, 'waypoints', 'waypoints:' || CASE WHEN tp = 0 AND fn = 0 THEN 'spurious_only' WHEN tp = 0 AND fp = 0 THEN 'missed_all' WHEN tp = 0 THEN 'noisy_mismatch'
         WHEN fn = 0 THEN 'extra_points' WHEN fp = 0 THEN 'missing_points' ELSE 'mixed_missing_and_extra' END
  FROM ws WHERE has_output AND (fp > 0 OR fn > 0)
  UNION ALL SELECT path, chart_no, pos, 'sample', 'sample:no_output' FROM j WHERE NOT has_output)
"""


def _prf(prefix: str = "") -> str:
    tp, fp, fn = (f"{prefix}{c}" for c in ("tp", "fp", "fn"))
    p, r = f"{tp}::DOUBLE / nullif({tp} + {fp}, 0)", f"{tp}::DOUBLE / nullif({tp} + {fn}, 0)"
    return f"round({p}, 6) AS {prefix}precision, round({r}, 6) AS {prefix}recall, round(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 6) AS {prefix}f1"


_CELL = "sum((app AND said AND hit)::BIGINT)::BIGINT AS {0}tp, sum((said AND NOT (app AND hit))::BIGINT)::BIGINT AS {0}fp, sum((app AND NOT (said AND hit))::BIGINT)::BIGINT AS {0}fn"

_LEG = ("trans_ident", "seq_no", "rt_type", "wpt_ident", "altitude1", "alt_desc")
#: Every leg of every pair, from cifp or from wherever body holds a list of legs.
_TREE = r"""
src AS (SELECT pair_no, 0 AS part, body AS j FROM pairs_100 WHERE json_valid(body)),
outer_ AS (SELECT pair_no, t.key, t.type, t.atom, t.fullkey AS path, t.id, t.parent FROM src, json_tree(j) t),
held AS (SELECT pair_no, id AS part, '{"legs":' || json_extract_string(atom, '$') || '}' AS j FROM outer_ WHERE key = 'legs' AND type = 'VARCHAR'),
tree AS (SELECT pair_no, 0 AS part, key, type, atom, path, id, parent FROM outer_
         UNION ALL SELECT pair_no, part, t.key, t.type, t.atom, t.fullkey, t.id, t.parent FROM held, json_tree(CASE WHEN json_valid(j) THEN j ELSE '{}' END) t),
lists AS (SELECT pair_no, part, id, path, type FROM tree WHERE key = 'legs' AND type IN ('ARRAY', 'OBJECT')),
named AS (SELECT DISTINCT n.pair_no, n.part, n.parent AS id FROM tree n JOIN lists l ON l.pair_no = n.pair_no AND l.part = n.part AND l.id = n.parent WHERE l.type = 'OBJECT' AND NOT regexp_full_match(n.key, '[0-9]+')),
entries AS (
  SELECT l.pair_no, l.part, n.id, n.path, n.key, l.id AS list, CASE WHEN l.type = 'OBJECT' THEN n.key::BIGINT ELSE 0 END AS rank, CASE WHEN l.type = 'OBJECT' THEN l.id ELSE n.id END AS place, l.type = 'OBJECT' AS keyed
  FROM lists l JOIN tree n ON n.pair_no = l.pair_no AND n.part = l.part AND n.type = 'OBJECT'
  WHERE (l.type = 'ARRAY' AND regexp_full_match(substr(n.path, length(l.path) + 1), '(\[[0-9]+\])+') AND starts_with(n.path, l.path))
     OR (l.type = 'OBJECT' AND n.parent = l.id AND (l.pair_no, l.part, l.id) NOT IN (SELECT pair_no, part, id FROM named))
  UNION ALL SELECT t.pair_no, t.part, t.id, t.path, NULL, t.id, 0, t.id, false FROM tree t JOIN named USING (pair_no, part, id)),
kept AS (SELECT e.* FROM entries e WHERE EXISTS (SELECT 1 FROM tree c WHERE c.pair_no = e.pair_no AND c.part = e.part AND c.parent = e.id)),
inside AS (SELECT e.pair_no, e.part, e.id AS entry, x.key, json_extract_string(x.atom, '$') AS value, x.id
           FROM kept e JOIN tree x ON x.pair_no = e.pair_no AND x.part = e.part AND starts_with(x.path, e.path || '.') WHERE x.type NOT IN ('OBJECT', 'ARRAY')),
beside AS (SELECT l.pair_no, l.part, l.id AS list, arg_min(json_extract_string(s.atom, '$'), s.id) AS trans_ident
           FROM lists l JOIN tree o USING (pair_no, part, id) JOIN tree s ON s.pair_no = l.pair_no AND s.part = l.part AND s.parent = o.parent WHERE s.key = 'trans_ident' AND s.type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL),
raw AS (SELECT e.pair_no, row_number() OVER (PARTITION BY e.pair_no ORDER BY CASE WHEN e.part > 0 THEN e.part ELSE e.place END, e.place, e.rank, e.id)::INTEGER AS leg_no, any_value(e.keyed) AS keyed, any_value(e.key) AS number,
          any_value(b.trans_ident) AS above, """ + ", ".join(f"arg_min(x.value, x.id) FILTER (x.key = '{f}') AS {f}" for f in _LEG) + """
        FROM kept e LEFT JOIN inside x ON x.pair_no = e.pair_no AND x.part = e.part AND x.entry = e.id LEFT JOIN beside b ON b.pair_no = e.pair_no AND b.part = e.part AND b.list = e.list
        GROUP BY e.pair_no, e.part, e.place, e.rank, e.id),
typed AS (SELECT pair_no, unnest(cifp.legs) AS l, generate_subscripts(cifp.legs, 1) AS i FROM pairs_100 WHERE body IS NULL AND cifp IS NOT NULL),
legs AS (SELECT pair_no, leg_no, """ + ", ".join(f"coalesce({f}, above) AS {f}" if f=="trans_ident" else f for f in _LEG) + """, CASE WHEN keyed THEN number END AS number FROM raw
  UNION ALL SELECT pair_no, row_number() OVER (PARTITION BY pair_no ORDER BY i)::INTEGER, """ + ", ".join(f"l.{f}" for f in _LEG) + """, NULL FROM typed WHERE l IS NOT NULL AND coalesce(""" + ", ".join(f"l.{f}" for f in _LEG) + """) IS NOT NULL)
"""
_TRIM = "coalesce(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"
_PAIRS = """
value AS (SELECT pair_no, arg_min(json_extract_string(atom, '$'), id) FILTER (key = 'airport') AS airport, arg_min(json_extract_string(atom, '$'), id) FILTER (key = 'proc_ident') AS proc_ident
          FROM outer_ WHERE type NOT IN ('OBJECT', 'ARRAY') GROUP BY pair_no),
pairs AS (SELECT p.pair_no, p.chart_no, p.id, coalesce(v.airport, p.cifp.airport) AS airport, coalesce(v.proc_ident, p.cifp.proc_ident) AS proc_ident,
            CASE WHEN p.body IS NULL THEN p.cifp IS NOT NULL ELSE json_valid(p.body) END AS well_formed FROM pairs_100 p LEFT JOIN value v USING (pair_no)),
placed AS (SELECT pair_no, leg_no - 1 AS p, trans_ident, coalesce(seq_no, number) AS seq_no, rt_type, wpt_ident, altitude1, alt_desc FROM legs WHERE pair_no NOT IN (SELECT pair_no FROM typed)
           UNION ALL SELECT pair_no, i - 1, """ + ", ".join(f"l.{f}" for f in _LEG) + """ FROM typed WHERE l IS NOT NULL)
"""

_LEGS = f"""
WITH {_TREE}, {_PAIRS},
own_legs AS (SELECT pair_no, list({{
           'trans': coalesce({_strip('trans_ident')}, ''), 'seq': coalesce({_strip('seq_no')}, ''), 'rt': coalesce({_strip('rt_type')}, ''),
           'wpt': coalesce({_strip('wpt_ident')}, ''), 'sign': coalesce({_strip('alt_desc')}, ''),
           'alt': CASE WHEN regexp_matches({_strip('altitude1')}, '^[+-]?[0-9]+$') THEN try_cast({_strip('altitude1')} AS INTEGER) END}} ORDER BY p) AS legs FROM placed GROUP BY pair_no),
base AS (SELECT pair_no, chart_no, id, {_strip('airport')} AS airport, {_strip('proc_ident')} AS proc_ident, well_formed, coalesce(legs, []) AS legs FROM pairs LEFT JOIN own_legs USING (pair_no)),
t AS (SELECT *, coalesce(list_filter(legs, lambda x: starts_with(x.wpt, 'RW'))[1].trans,
        CASE WHEN list_contains(list_transform(legs, lambda x: x.trans), 'R') THEN 'R' WHEN list_contains(list_transform(legs, lambda x: x.trans), 'I') THEN 'I' END) AS transition FROM base),
own AS (SELECT *, list_filter(legs, lambda x: x.trans = coalesce(transition, '') AND coalesce(transition, '') <> '') AS main FROM t),
m AS (SELECT *, coalesce(list_position(list_transform(main, lambda x: starts_with(x.wpt, 'RW')), true), 0) AS rw FROM own),
missed AS (SELECT *, CASE WHEN rw > 0 THEN main[rw + 1:] ELSE main[1:0] END AS ma FROM m),
ca AS (SELECT *, coalesce(list_position(list_transform(ma, lambda x: x.rt = 'CA'), true), 0) AS ca_at FROM missed),
a AS (SELECT *, list_filter(CASE WHEN ca_at > 0 THEN ma[ca_at + 1:] ELSE ma[1:0] END, lambda x: x.rt <> 'CA') AS aft,
        list_filter(ma, lambda x: x.rt IN ('HM', 'HF', 'HA')) AS held, list_filter(ma, lambda x: x.rt = 'DF') AS df FROM ca)
"""

_LINES = f"""
lines AS (
  SELECT pair_no, p::INTEGER AS p, pair_no * 1000 + p AS line_no, {_strip('left(' + _strip('coalesce(airport, $$$$)') + ', 4)')} AS airport, {_strip('left(' + _strip('coalesce(proc_ident, $$$$)') + ', 5)')} AS proc_ident,
         {_strip('left(' + _strip('coalesce(trans_ident, $$$$)') + ', 6)')} AS trans_ident, {_strip('left(' + _strip('coalesce(seq_no, $$$$)') + ', 3)')} AS seq_no,
         CASE (pair_no + p) % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE '' END AS turn_dir, {_strip('left(' + _strip('coalesce(rt_type, $$$$)') + ', 3)')} AS rt_type
  FROM placed JOIN pairs USING (pair_no))
"""
_FIXED = f"WITH {_TREE}, {_PAIRS}, {_LINES}"
_RECORD = f"""SELECT pair_no, chart_no, id, airport, proc_ident, transition, df[1].seq AS direct_seq,
CASE WHEN len(ma) > 0 THEN array_to_string(list_transform(ma, lambda x: x.rt || CASE WHEN x.wpt <> '' THEN ' ' || x.wpt ELSE '' END
  || CASE WHEN x.alt IS NOT NULL THEN ' ' || x.alt || CASE WHEN x.sign IN ('+', '-') THEN x.sign ELSE '' END || 'ft' ELSE '' END), ' -> ') ELSE 'unknown' END AS raw_instruction,
coalesce(list_filter(list_transform(aft, lambda x: x.alt), lambda v: v IS NOT NULL)[1], list_max(list_transform(ma, lambda x: x.alt))) AS climb_altitude,
array_to_string(_ORDERED_, ' ') AS waypoints,
len(held) > 0 AS holding_required, CASE WHEN len(held) > 0 THEN coalesce(nullif(held[1].wpt, ''), 'unknown') END AS holding_fix,
list_filter(list_transform(df, lambda x: coalesce(nullif(x.wpt, ''), cast(x.alt AS VARCHAR))), lambda v: v IS NOT NULL)[1] AS turn_trigger"""
_TURN_OF = _LEGS.rstrip() + f", {_LINES.strip()}, " + """idx AS (SELECT airport, proc_ident, trans_ident, seq_no, arg_min(turn_dir, line_no) AS turn_dir FROM lines GROUP BY ALL)
SELECT a.pair_no, CASE coalesce(idx.turn_dir, '') WHEN 'L' THEN 'LEFT' WHEN 'R' THEN 'RIGHT' ELSE 'NONE' END AS turn_direction
FROM a LEFT JOIN idx ON a.airport = idx.airport AND a.proc_ident = idx.proc_ident AND a.transition = idx.trans_ident AND a.df[1].seq = idx.seq_no"""

_NO_FIX = ", ".join(f"'{w}'" for w in X.NO_FIX)
_RULE_WPS = f"list_filter(regexp_extract_all(upper(t), '{X.NAMED_FIX}', 1) || regexp_extract_all(upper(t), '{X.FIX}', 1), lambda w: len(w) = 5 AND w NOT IN ({_NO_FIX}))"
_HOLD_FIXES = ", ".join(f"CASE WHEN regexp_extract(upper(t), '{p}', 1) NOT IN ('', {_NO_FIX}) THEN regexp_extract(upper(t), '{p}', 1) END" for p in X.HOLD_FIXES)
#: Distinct entries in the order of their first place.
_ORDERED = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"
_RECORD_SQL = _RECORD.replace("_ORDERED_", _ORDERED.format("list_filter(list_transform(aft, lambda x: x.wpt), lambda v: v <> '')"))
_WHITE = r"[\s\x0B\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]".replace("{{", "{").replace("}}", "}")

_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$'"
_FORM = lambda x: f"lower({_strip(x)})"
_NUMBER_FORM = f"CASE WHEN regexp_matches({_FORM('climb_altitude')}, {_NUMBER}) THEN '#' || cast(cast({_FORM('climb_altitude')} AS DECIMAL(30, 8)) AS VARCHAR) ELSE {_FORM('climb_altitude')} END"


def _copy(table: str) -> str:
    return f"SELECT chart_no, {_NUMBER_FORM} AS f1, {_FORM('turn_direction')} AS f2, {_FORM('holding_fix')} AS f3, list_transform(waypoints, lambda w: {_FORM('w')}) AS f4 FROM {_latest(table)}"


_OTHER = f"(t = '' OR (regexp_matches(upper(t), '{X.FREQUENCY}') AND NOT regexp_matches(upper(t), '{X.ACTION}')) OR " + " OR ".join(f"contains(upper(t), '{m}')" for m in X.OTHER_LINES) + ")"
_PAGE = f"""
WITH l AS (SELECT rec_id, list_transform(string_split_regex(coalesce(raw_instruction, ''), '\\r?\\n'), lambda x: regexp_replace(regexp_replace(translate(x, '°Å', '  '), '{_WHITE}+', ' ', 'g'), '^ | $', '', 'g')) AS ls
           FROM path_a),
n AS (SELECT rec_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM l),
h AS (SELECT rec_id, i AS anchor FROM n WHERE regexp_matches(t, '{X.HEADING}')),
a AS (SELECT * FROM h UNION ALL SELECT rec_id, min(i) FROM n WHERE regexp_matches(t, '{X.BROAD}') AND rec_id NOT IN (SELECT rec_id FROM h) GROUP BY rec_id),
own AS (SELECT a.rec_id, a.anchor, n.i, n.t FROM a JOIN n ON n.rec_id = a.rec_id AND n.i BETWEEN a.anchor - 2 AND a.anchor + 9
        WHERE NOT {_OTHER} AND (n.i = a.anchor OR regexp_matches(upper(t), '{X.HEADING}') OR regexp_matches(upper(t), '{X.ACTION}') OR (n.i > a.anchor AND regexp_matches(upper(t), '{X.FIX}')))),
c AS (SELECT a.rec_id, a.anchor, {_strip(f"string_split_regex(coalesce(string_agg(own.t, ' ' ORDER BY own.i), ''), '{X.CUT}')[1]")} AS text
      FROM a LEFT JOIN own USING (rec_id, anchor) GROUP BY a.rec_id, a.anchor),
best AS (SELECT rec_id, text FROM c QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY
      (CASE WHEN regexp_matches(text, '{X.HEADING}') THEN 3 ELSE 0 END) + len(regexp_extract_all(text, '{X.ACTION}')) + 2 * len(regexp_extract_all(text, '{X.FIX}')) DESC, anchor) = 1)
SELECT l.rec_id, coalesce(best.text, '') AS instruction FROM l LEFT JOIN best USING (rec_id)"""

_EVENTS = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn"

SQL: dict[str, str] = {
    "p1_found": f"""
WITH a AS ({_copy('path_o')}), b AS ({_copy('path_o_mirror')}),
j AS (SELECT a.chart_no AS ka, b.chart_no AS kb, coalesce(a.chart_no, b.chart_no) AS chart_no, a.f1 IS DISTINCT FROM b.f1 AS d1, a.f2 IS DISTINCT FROM b.f2 AS d2, a.f3 IS DISTINCT FROM b.f3 AS d3, a.f4 IS DISTINCT FROM b.f4 AS d4 FROM a FULL JOIN b ON a.chart_no = b.chart_no)
SELECT chart_no, u.field FROM j, LATERAL (VALUES ('row_missing_in_path_o', ka IS NULL), ('row_missing_in_path_o_mirror', kb IS NULL),
  ('climb_altitude', ka = kb AND d1), ('turn_direction', ka = kb AND d2), ('holding_fix', ka = kb AND d3), ('waypoints', ka = kb AND d4)) u(field, here) WHERE here""",
    "q_scalar_confusion": _SCORES + f"SELECT *, {_prf()} FROM (SELECT path, field, {_CELL.format('')} FROM c GROUP BY ALL)",
    "q_summary": _SCORES
    + f"""SELECT *, {_prf('scalar_')}, {_prf('wp_')} FROM (SELECT path, {_CELL.format('scalar_')} FROM c GROUP BY path)
JOIN (SELECT path, count(*) AS n, round(avg(has_output::INT), 6) AS coverage, sum(tp)::BIGINT AS wp_tp, sum(fp)::BIGINT AS wp_fp, sum(fn)::BIGINT AS wp_fn,
        round(avg(jaccard), 6) AS mean_jaccard, round(avg(exact::INT), 6) AS exact_rate FROM ws GROUP BY path) USING (path)""",
    "q_per_sample": _SCORES
    + """SELECT path, chart_no, any_value(c.has_output) AS has_output, round(sum((app AND said AND hit)::INT)::DOUBLE / nullif(sum(app::INT), 0), 6) AS scalar_exact_rate,
any_value(ws.exact) AS wp_exact, round(any_value(ws.jaccard), 6) AS wp_jaccard FROM c JOIN ws USING (path, chart_no) GROUP BY path, chart_no""",
    "q_label_counts": _SCORES + "SELECT path, label, count(*) AS n FROM lab GROUP BY ALL",
    "q_top_labels": _SCORES + "SELECT path, label, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, label)::INTEGER AS rank FROM (SELECT path, label, count(*) AS n FROM lab GROUP BY ALL) QUALIFY rank <= 12",
    "q_topk_per_field": _SCORES
    + "SELECT path, field, label, n, row_number() OVER (PARTITION BY path, field ORDER BY n DESC, label)::INTEGER AS rank FROM (SELECT path, field, label, count(*) AS n FROM lab GROUP BY ALL) QUALIFY rank <= 5",
    "q_signatures": _SCORES
    + """, s AS (SELECT path, chart_no, string_agg(label, ' | ' ORDER BY label) AS signature FROM lab GROUP BY ALL)
SELECT path, signature, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, signature)::INTEGER AS rank FROM (SELECT path, signature, count(*) AS n FROM s GROUP BY ALL) QUALIFY rank <= 8""",
    "q_label_examples": _SCORES + "SELECT path, label, row_number() OVER (PARTITION BY path, label ORDER BY pos, chart_no)::INTEGER AS rank, chart_no FROM lab QUALIFY rank <= 10",
    "q_normalized": f"""SELECT path_code, rec_id, {_ALT} AS climb_altitude, {_TURN} AS turn_direction, {_HOLD} AS holding_required, {_FIX} AS holding_fix,
array_to_string(list_sort({_WPS}), ' ') AS waypoints FROM (SELECT * FROM path_a UNION ALL SELECT * FROM path_c)""",
    "p5_found": f"WITH {_TREE} SELECT pair_no, leg_no, {_TRIM.format('rt_type')} AS rt_type, {_TRIM.format('wpt_ident')} AS wpt_ident FROM legs",
    "p5_legs": f"WITH {_TREE} SELECT pair_no, leg_no, " + ", ".join(f"{_TRIM.format(f)} AS {f}" for f in _LEG) + " FROM legs",
    "p5_pairs": f"WITH {_TREE}, {_PAIRS}, n AS (SELECT pair_no, count(*)::INTEGER AS n FROM legs GROUP BY pair_no) SELECT pair_no, chart_no, id, {_TRIM.format('airport')} AS airport, "
    + f"{_TRIM.format('proc_ident')} AS proc_ident, well_formed, coalesce(n, 0) AS n_legs FROM pairs LEFT JOIN n USING (pair_no)",
    "p5_records": _LEGS + _RECORD_SQL + ", well_formed FROM a",
    "p5_lines": _FIXED + "SELECT pair_no, p, airport, proc_ident, trans_ident, seq_no, turn_dir, rt_type FROM lines",
    "p5_turns": _TURN_OF,
    "q_procedure_record": _LEGS + _RECORD_SQL + " FROM a",
    "q_fixed_width": _FIXED + "SELECT pair_no, p, airport, proc_ident, trans_ident, seq_no, turn_dir, rt_type FROM lines",
    "q_turn_lookup": _TURN_OF,
    "q_rules": f"""SELECT rec_id, list_max(list_filter(list_transform(regexp_extract_all(t, '\\b(\\d{{3,5}})\\b', 1), lambda n: n::INTEGER), lambda n: n BETWEEN 500 AND 99000)) AS climb_altitude,
array_to_string({_ORDERED.format(_RULE_WPS)}, ' ') AS waypoints, CASE WHEN regexp_matches(t, '{X.LEFT}') THEN 'LEFT' WHEN regexp_matches(t, '{X.RIGHT}') THEN 'RIGHT' ELSE 'NONE' END AS turn_direction,
regexp_matches(t, '{X.HOLD}') AS holding_required, CASE WHEN regexp_matches(t, '{X.HOLD}') THEN coalesce({_HOLD_FIXES}, ({_RULE_WPS})[1]) END AS holding_fix
FROM (SELECT rec_id, coalesce(raw_instruction, '') AS t FROM path_a)""",
    "q_page_instruction": _PAGE,
    "q_clean_line": f"SELECT rec_id, regexp_replace(regexp_replace(translate(raw_instruction, '°Å', '  '), '{_WHITE}+', ' ', 'g'), '^ | $', '', 'g') AS line FROM path_c",
    "q_json_response": """SELECT raw_no, coalesce(json_valid(payload), false) AS parsed, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.turn_trigger') END AS turn_trigger FROM path_b""",
    "q_questionnaire": "SELECT raw_no, "
    + ", ".join(f"coalesce(nullif(lower(regexp_extract(payload, '(?i)Q{q}:\\s*(yes|no|uncertain)', 1)), ''), 'not_found') AS q{q}" for q in range(1, 7))
    + " FROM path_e",
    "q_answers": f"""SELECT rec_id, try_cast(nullif(regexp_extract(replace(coalesce(climb_altitude, ''), ',', ''), '\\d{{3,5}}'), '') AS INTEGER) AS climb_altitude,
CASE WHEN upper({_strip('turn_direction')}) IN ('LEFT', 'RIGHT', 'NONE', 'UNKNOWN') THEN upper({_strip('turn_direction')}) ELSE 'unknown' END AS turn_direction, h AS holding_required,
CASE WHEN h IS NOT DISTINCT FROM false THEN NULL WHEN lower(f) = 'null' THEN NULL WHEN lower(f) IN ('unknown', '') THEN 'unknown'
  ELSE coalesce(nullif(regexp_extract(upper(f), '\\b([A-Z]{{3,6}})\\b', 1), ''), 'unknown') END AS holding_fix,
array_to_string(list_filter(list_transform(coalesce(waypoints, []), lambda w: upper({_strip('coalesce(w, $$None$$)')})), lambda w: w <> ''), ' ') AS waypoints
FROM (SELECT *, {_strip("coalesce(holding_fix, 'null')")} AS f, CASE lower({_strip('holding_required')}) WHEN 'true' THEN true WHEN 'false' THEN false END AS h FROM path_c)""",
    "q_strat_sample": f"""
WITH m AS (SELECT chart_no, airport, left({_strip('proc_ident')}, 1) AS kind, md5('2604:' || chart_no) AS o FROM manifest),
k AS (SELECT * FROM m WHERE kind IN ('R', 'L', 'I') QUALIFY row_number() OVER (PARTITION BY airport ORDER BY o, chart_no) <= 2)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY o, chart_no)::INTEGER AS rank, chart_no, airport FROM k QUALIFY rank <= CASE kind WHEN 'R' THEN 60 WHEN 'L' THEN 25 ELSE 15 END""",
    "q_missing_keys": """SELECT chart_no, 'left' AS only_in FROM (SELECT chart_no FROM manifest EXCEPT SELECT chart_no FROM path_a)
UNION ALL SELECT chart_no, 'right' FROM (SELECT chart_no FROM path_a EXCEPT SELECT chart_no FROM manifest)""",
    "q_first_missing": """SELECT * FROM (SELECT chart_no, 'left' AS only_in FROM (SELECT chart_no FROM manifest EXCEPT SELECT chart_no FROM path_b)
UNION ALL SELECT chart_no, 'right' FROM (SELECT chart_no FROM path_b EXCEPT SELECT chart_no FROM manifest)) ORDER BY chart_no, only_in LIMIT 10""",
    "q_airport_procedures": f"""SELECT doc_id, airport, coalesce(p, '') AS procedures FROM documents LEFT JOIN
(SELECT airport, string_agg(DISTINCT {_strip('proc_ident')}, ' ' ORDER BY {_strip('proc_ident')}) AS p FROM manifest GROUP BY airport) USING (airport)""",
    "q_strict_join": "SELECT chart_no, rec_id, pos, id FROM path_c JOIN manifest USING (chart_no)",
    "q_expected_rows": "SELECT item_id, suite FROM eval_items",
    "q_point_lookup": "SELECT chart_no, pos, id FROM manifest WHERE pos = 7",
    "q_filled": "SELECT chart_no, 'Chart ' || id || ' of ' || coalesce(airport, '?') || ': ' || id AS prompt FROM manifest",
    "q_instruction": f"""SELECT rec_id, CASE WHEN b = '' OR lower(b) = 'unknown' THEN 'unknown' ELSE replace(replace(replace(b, '掳', '°'), '\\u00b0', '°'), 'Å', ' ') END AS instruction
FROM (SELECT rec_id, regexp_replace(coalesce(raw_instruction, ''), '^' || '{_WHITE}' || '+|' || '{_WHITE}' || '+$', '', 'g') AS b FROM path_c)""",
    "q_record_types": """WITH v AS (SELECT raw_no, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS j FROM path_b),
k AS (SELECT raw_no, json_type(j, '$.climb_altitude') AS alt_type, trim(json_extract_string(j, '$.climb_altitude')) AS a, json_type(j, '$.holding_required') AS ht, lower(trim(json_extract_string(j, '$.holding_required'))) AS h FROM v)
SELECT raw_no, CASE WHEN alt_type = 'BOOLEAN' THEN (a = 'true')::INTEGER WHEN alt_type IN ('UBIGINT', 'BIGINT', 'VARCHAR') AND regexp_full_match(a, '[+-]?[0-9]+') THEN try_cast(a AS INTEGER) END AS climb_altitude,
CASE WHEN ht IN ('BOOLEAN', 'VARCHAR') THEN CASE WHEN h IN ('true', 'yes', '1') THEN true WHEN h IN ('false', 'no', '0') THEN false END END AS holding_required FROM k""",
    "q_written_records": "SELECT rec_id, path_code, climb_altitude, array_to_string(waypoints, ' ') AS waypoints FROM path_a",
    "q_trace": """SELECT rec_id, to_json([{'question': 'turn_direction', 'answer': coalesce(turn_direction, '')}, {'question': 'holding_fix', 'answer': coalesce(holding_fix, '')}]) AS trace FROM path_c""",
    "q_written_manifest": f"""WITH m AS (SELECT chart_no, pos, id, airport, left({_strip('proc_ident')}, 1) AS kind, md5('2604:' || chart_no) AS o FROM manifest),
k AS (SELECT * FROM m WHERE kind IN ('R', 'L') QUALIFY row_number() OVER (PARTITION BY airport ORDER BY o, chart_no) <= 2),
c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY o, chart_no) <= CASE kind WHEN 'R' THEN 20 ELSE 10 END)
SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, chart_no, id, airport FROM c""",
    "q_not_done": "SELECT chart_no, id FROM manifest ANTI JOIN path_c USING (chart_no)",
    "q_manifest_pairs": """SELECT chart_no, id, pair_no, pair_no IS NOT NULL AS has_pair FROM manifest LEFT JOIN
(SELECT chart_no, pair_no FROM pairs_100 QUALIFY row_number() OVER (PARTITION BY chart_no ORDER BY loaded_at DESC, pair_no DESC) = 1) USING (chart_no)""",
    "q_holding_legs": f"""SELECT chart_no, len(list_filter(legs, lambda x: x.rt IN ('HF', 'HA'))) > 0 AS explicit_hold,
array_to_string(list_transform(list_filter(legs, lambda x: x.rt IN ('HF', 'HA') OR starts_with(x.wpt, 'M')), lambda x: concat_ws(' ', x.rt, x.wpt)), ', ') AS kept
FROM (SELECT chart_no, list_transform(coalesce(ma_holding_legs, []), lambda x: {{'rt': {_strip('x.rt_type')}, 'wpt': {_strip('x.wpt_ident')}}}) AS legs FROM manifest)""",
    "q_count_if": "SELECT airac, count(*) AS n, count(*) FILTER (holding_required) AS holds, count(*) FILTER (total_legs IS NULL) AS no_legs FROM manifest GROUP BY airac",
    "q_procedures_by_airport": f"SELECT airport, count(*) AS n, string_agg(DISTINCT {_strip('proc_ident')}, ' ' ORDER BY {_strip('proc_ident')}) AS procedures FROM manifest GROUP BY airport",
    "q_largest": "SELECT source, arg_min(doc_id, {'a': -n_chars, 'b': doc_id}) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source",
    "q_heads": """(SELECT chart_no, pos, holding_required FROM manifest WHERE holding_required ORDER BY pos LIMIT 6)
UNION ALL (SELECT chart_no, pos, holding_required FROM manifest WHERE NOT holding_required ORDER BY pos LIMIT 4)""",
    "q_paths_of_images": r"""SELECT pair_no, regexp_replace(replace(image_path, '\', '/'), '^data/', '') AS path, upper(regexp_extract(image_path, '([^/\\]+)_p0\.[^.]+$', 1)) || '.PDF' AS document
FROM pairs_100 WHERE regexp_matches(image_path, '_p0\.[A-Za-z]+$')""",
    "q_after_anchor": f"""WITH e AS (SELECT *, {_EVENTS} FROM events), f AS (SELECT user_id, min(rn) AS first FROM e WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, event_type, count(*) AS n FROM e JOIN f USING (user_id) WHERE rn > first GROUP BY ALL""",
    "q_after_flag": f"""WITH e AS (SELECT *, {_EVENTS} FROM events), f AS (SELECT user_id, min(rn) AS first FROM e WHERE event_type = 'error' GROUP BY user_id),
g AS (SELECT user_id, event_type, min(rn) AS place FROM e JOIN f USING (user_id) WHERE rn > first AND event_type <> 'error' GROUP BY ALL)
SELECT user_id, string_agg(event_type, ' ' ORDER BY place) AS types FROM g GROUP BY user_id""",
    "q_first_match": "SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "q_context_window": """WITH e AS (SELECT *, sum((event_type = 'click')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 9 FOLLOWING)::BIGINT AS score FROM events)
SELECT user_id, event_id, score FROM e WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts, event_id) = 1""",
}
