"""SQL counterparts of the registered queries, for DuckDB on the same tables.

They are written from the definitions, with plain windows and joins, to check the Spark jobs.
"""

from __future__ import annotations

from ..operators.dataset import ASK_CAUSE, FIXED_QUESTION, FOLLOW_UP, OPENINGS, SEPARATED_BY
from ..operators.graph import IRRELEVANT, NOT_A_SHAPE
from ..operators.inject import SWEEP
from ..operators.models import BPMN2, END_CATEGORIES, START_CATEGORIES, TASK_CATEGORIES
from . import catalog as c

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(q(v) for v in values)


def h(*keys: str) -> str:
    return f"md5(concat_ws('|', '7', {', '.join(keys)}))"


def d(*keys: str) -> str:
    return f"('0x' || substr({h(*keys)}, 1, 8))::BIGINT"


def below(n: str, *keys: str) -> str:
    return f"({d(*keys)} % greatest(({n})::BIGINT, 1))"


def sql(*ctes: str, select: str) -> str:
    return ("WITH RECURSIVE " + ",\n".join(x.strip() for x in ctes) + "\n" if ctes else "") + select


# --- logs ----------------------------------------------------------------------------------

LOG = """
ev0 AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pu FROM events),
ev1 AS (SELECT *, max(CASE WHEN pu IS NULL OR us - pu > 43200000000 THEN us END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS st FROM ev0),
log AS (SELECT user_id || '-' || (st // 1000000) AS case_id, event_type AS activity, ts, user_id, value,
        props->>'$.k' AS k, row_number() OVER (PARTITION BY user_id, st ORDER BY ts, event_id) AS pos FROM ev1),
cs AS (SELECT case_id, min(user_id) AS user_id, list(activity ORDER BY pos) AS t, count(*) AS n FROM log GROUP BY case_id)
"""

ORDERS = """
ol AS (SELECT l_orderkey::VARCHAR AS case_id, l_returnflag || l_linestatus AS activity, l_partkey AS part,
       l_linestatus AS lane, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS pos,
       count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
"""

DIALOGUES = """
dl AS (SELECT conv_id::VARCHAR AS case_id, role AS activity,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
"""

VOC = "voc AS (SELECT list(activity ORDER BY activity) AS names FROM (SELECT DISTINCT activity FROM log))"


def put(name: str, *ctes: str, select: str) -> None:
    ORACLE[f"q_{name}"] = sql(*ctes, select=select)


def text(col: str, sep: str = ",") -> str:
    return f"array_to_string({col}, '{sep}')"


put("traces", LOG, select=f"SELECT case_id, {text('t')} AS trace FROM cs")
put("case_lens", LOG, select="SELECT case_id, n AS num_events FROM cs")
put("order_lens", ORDERS, select="SELECT case_id, count(*) AS num_events FROM ol GROUP BY case_id")
put(
    "log_summary", LOG, ORDERS, DIALOGUES,
    """u AS (SELECT 'sessions' AS log, case_id, activity FROM log UNION ALL SELECT 'orders', case_id, activity FROM ol
       UNION ALL SELECT 'dialogues', case_id, activity FROM dl)""",
    """m AS (SELECT log, max(n) AS max_case_len FROM (SELECT log, count(*) AS n FROM u GROUP BY log, case_id) GROUP BY log)""",
    select="""SELECT log, count(DISTINCT case_id) AS num_cases, count(*) AS num_events, max(max_case_len) AS max_case_len,
        count(DISTINCT activity) AS num_activities FROM u JOIN m USING (log) GROUP BY log""",
)
put(
    "activities",
    select="""SELECT event_type AS activity FROM events UNION SELECT l_returnflag || l_linestatus FROM lineitem
        UNION SELECT role FROM conversations""",
)
ATTR_VALUES = """
av AS (SELECT 'k' AS attr, props->>'$.k' AS val FROM events UNION SELECT 'value', value::VARCHAR FROM events),
dom AS (SELECT attr, val, row_number() OVER (PARTITION BY attr ORDER BY val) - 1 AS idx FROM av WHERE val IS NOT NULL)
"""
put("attr_values", ATTR_VALUES, select="SELECT attr, val, idx FROM dom")
put("attr_keys", "ak AS (SELECT DISTINCT unnest(map_keys(MAP {'k': props->>'$.k', 'value': value::VARCHAR})) AS attr FROM events)",
    select="SELECT 0::BIGINT AS idx, 'name' AS attr UNION ALL SELECT row_number() OVER (ORDER BY attr), attr FROM ak WHERE NOT starts_with(attr, '_')")
put("variants", LOG, select=f"SELECT {text('t')} AS trace, count(*) AS num_cases, min(case_id) AS first_case FROM cs GROUP BY t")
put("order_variants", ORDERS,
    "oc AS (SELECT case_id, list(activity ORDER BY pos) AS t FROM ol GROUP BY case_id)",
    select=f"SELECT {text('t')} AS trace, count(*) AS num_cases FROM oc GROUP BY t")
put("prefix_tree", LOG,
    """pn AS (SELECT t[:k] AS p, k, count(*) AS cases, sum(CASE WHEN k = n THEN 1 ELSE 0 END)::BIGINT AS ends
        FROM (SELECT t, len(t) AS n, unnest(range(1, len(t) + 1)) AS k FROM cs) GROUP BY ALL),
    pc AS (SELECT p[:k - 1] AS p, count(*) AS children FROM pn GROUP BY ALL)""",
    select="""SELECT pn.k AS depth, pn.p[pn.k] AS activity, pn.cases, pn.ends, coalesce(pc.children, 0) AS children, up.cases AS parent_cases
    FROM pn LEFT JOIN pc ON pc.p = pn.p LEFT JOIN pn up ON up.p = pn.p[:pn.k - 1]""")
put("variant_prob", LOG, select=f"""SELECT {text('t')} AS trace, count(*) AS num_cases,
    round(count(*)::DOUBLE / (SELECT count(*) FROM cs), 12) AS probability FROM cs GROUP BY t""")
put("matrix", LOG, select="""SELECT case_id, pos AS event_position, activity AS name,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, k, value::VARCHAR AS value FROM log
    UNION ALL SELECT case_id, 0, '▶', NULL, '▶', '▶' FROM cs UNION ALL SELECT case_id, n + 1, '■', NULL, '■', '■' FROM cs""")
put(
    "filter_variants", LOG,
    "many AS (SELECT DISTINCT case_id FROM (SELECT case_id, activity FROM log GROUP BY ALL HAVING count(*) > 2))",
    "kept AS (SELECT t, min(case_id) AS first_case FROM cs WHERE n > 1 AND case_id NOT IN (SELECT case_id FROM many) GROUP BY t)",
    select=f"SELECT 'c' || row_number() OVER (ORDER BY first_case) AS case_id, {text('t')} AS trace FROM kept",
)
put("variant_text", LOG, select=f"""SELECT DISTINCT '[' || {text('t')} || ']' AS trace
    FROM (SELECT t FROM cs ORDER BY case_id LIMIT {c.FIRST_CASES})""")
put("append_case", LOG, select=f"""SELECT case_id, n, {text('t')} AS trace, nullif(list_position(t, 'purchase'), 0) - 1 AS first_purchase FROM cs
    UNION ALL SELECT 'copy-' || case_id, n + 1, {text("t || ['closed']")}, nullif(list_position(t || ['closed'], 'purchase'), 0) - 1 FROM cs""")

# --- sources and sinks ---------------------------------------------------------------------

put("timed_csv", select="""SELECT (user_id % 50)::VARCHAR AS case_id, event_type AS activity,
    row_number() OVER (PARTITION BY user_id % 50 ORDER BY date_trunc('second', ts), event_id) AS pos,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS end_time,
    user_id::VARCHAR AS user FROM events""")
put("json_log", LOG, select="SELECT case_id, pos, activity, k, user_id::VARCHAR AS user FROM log")
put("xes_log", LOG, select="SELECT case_id, pos, activity, k FROM log")
put("xes_nested", LOG, select="""
    SELECT 'event' AS scope, case_id, pos, path, type, value FROM (SELECT case_id, pos, unnest([
        {'path': 'concept:name', 'type': 'string', 'value': activity}, {'path': 'time:timestamp', 'type': 'date', 'value': strftime(ts, '%Y-%m-%d %H:%M:%S')},
        {'path': 'props', 'type': 'container', 'value': NULL}, {'path': 'props/k', 'type': 'string', 'value': k},
        {'path': 'props/k/value', 'type': 'float', 'value': value::VARCHAR}], recursive := true) FROM log)
    UNION ALL SELECT 'trace', case_id, NULL, path, type, value FROM (SELECT case_id, unnest([
        {'path': 'concept:name', 'type': 'string', 'value': case_id}, {'path': 'users', 'type': 'list', 'value': NULL},
        {'path': 'users/user', 'type': 'string', 'value': user_id::VARCHAR}, {'path': 'users/user', 'type': 'int', 'value': n::VARCHAR}], recursive := true) FROM cs)
    UNION ALL SELECT 'log', NULL, NULL, path, type, value FROM (VALUES ('origin', 'string', 'sessions'), ('origin/format', 'int', '1'),
        ('origin/format/nested', 'boolean', 'true')) l(path, type, value)""")
put("sql_log", select="""SELECT 'u' || user_id AS case_id, event_type AS activity,
    row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('minute', ts), event_id, event_type) AS pos,
    strftime(date_trunc('minute', ts), '"%Y-%m-%d %H:%M:%S"') AS ts, props->>'$.k' AS resource FROM events""")
put("json_sink", LOG, select=f"SELECT case_id, {text('list(activity ORDER BY pos)')} AS names, {text('list(k ORDER BY pos)')} AS ks FROM log GROUP BY case_id")
put("read_log", LOG, select="SELECT format, case_id, pos, activity FROM log, (VALUES ('json'), ('xes'), ('csv')) f(format)")
put("json_lines", LOG, DIALOGUES, select="SELECT case_id, pos, activity FROM log UNION ALL SELECT case_id, pos, activity FROM dl")

# --- injection -----------------------------------------------------------------------------

WHO = ["case_id", "kind", "round"]


def pick(limit: str, part: str) -> str:
    return below(limit, *WHO, q(part))


def places(count: str, candidates: str, part: str) -> str:
    keyed = f"[{{'h': {h(*WHO, q(part), 'p')}, 'p': p}} for p in {candidates}]"
    return f"list_sort([e.p for e in (list_sort({keyed}))[1:{count}]])"


def inject(source: str, filler: bool = False, out: str = "inj") -> str:
    """CTEs from ``source`` (case_id, t, n, kind, round, ...) to ``out`` with the new t, n and the label."""
    name = "'Random activity ' || (1 + x % greatest(len(names) - 1, 1))" if filler else "names[x % len(names) + 1]"
    return f"""
i1 AS (SELECT *, CASE WHEN kind IN ('SkipSequence', 'Early', 'Late', 'Replace', 'SkipAndInsert') THEN n >= 3
       WHEN kind IN ('Rework', 'Insert') THEN n >= 2 WHEN kind = 'Skip' THEN n >= 5 ELSE false END AS live FROM {source}),
i2 AS (SELECT *, CASE WHEN NOT live THEN NULL
       WHEN kind = 'SkipSequence' THEN 1 + {pick('least(n - 1, 3)', 'size')}
       WHEN kind = 'Rework' THEN 2 + {pick('least(n, 3) - 1', 'size')}
       WHEN kind IN ('Early', 'Late') THEN 1 + {pick('least(n - 1, 4) - 1', 'size')} END AS sz,
       CASE WHEN NOT live THEN NULL
       WHEN kind = 'Insert' THEN 1 + {pick('least(n // 2, 3)', 'count')}
       WHEN kind = 'Replace' THEN 1 + {pick('least(n // 3, 3)', 'count')}
       WHEN kind = 'Skip' THEN 2 + {pick('least(n // 2, 3) - 1', 'count')}
       WHEN kind = 'SkipAndInsert' THEN 1 + {pick('least(n // 2, 3)', 'count')} END AS cnt FROM i1),
i3 AS (SELECT *, CASE WHEN kind = 'Rework' THEN {pick('n - sz + 1', 'start')} END AS src FROM i2),
i4 AS (SELECT *, CASE WHEN kind = 'Rework' THEN {pick('least(n - sz - src, 5) + 1', 'distance')}
       WHEN kind IN ('Early', 'Late') THEN 1 + {pick('least(n - sz, 6) - 1', 'distance')} END AS dist FROM i3),
i5 AS (SELECT *, CASE WHEN kind = 'SkipSequence' THEN {pick('n - sz', 'start')} WHEN kind = 'Rework' THEN src
       WHEN kind = 'Early' THEN dist + {pick('n - sz - dist', 'start')}
       WHEN kind = 'Late' THEN {pick('n - sz - dist', 'start')} END AS s,
       CASE WHEN cnt IS NOT NULL THEN {places('cnt', "range(0, n - 1, CASE WHEN kind = 'Replace' THEN 2 ELSE 1 END)", 'place')} END AS pl,
       CASE WHEN kind = 'SkipAndInsert' THEN 1 + {pick('least((n - cnt) // 2, 3)', 'more')} END AS more FROM i4),
i6 AS (SELECT *, CASE WHEN kind = 'SkipAndInsert' AND live THEN {places('more', 'range(0, n - cnt - 1)', 'place2')} END AS pl2,
       [{name.replace('x', d(*WHO, q('name'), 'j'))} for j in
        range(1, 1 + CASE WHEN kind IN ('Insert', 'Replace') THEN cnt WHEN kind = 'SkipAndInsert' THEN more ELSE 0 END)] AS nm
       FROM i5, voc),
i7 AS (SELECT *, list_transform(t, lambda x, i: CASE WHEN list_contains(pl, i - 1) THEN [] ELSE [x] END) AS gone FROM i6),
i8 AS (SELECT *, flatten(gone) AS rest, [p - (list_position(pl, p) - 1) for p in pl] AS closed FROM i7),
{out} AS (SELECT * EXCLUDE (t, n), t AS t0, n AS n0, CASE WHEN live THEN kind ELSE 'normal' END AS anomaly,
    CASE WHEN NOT live THEN t
    WHEN kind = 'SkipSequence' THEN t[:s] || t[s + sz + 1:]
    WHEN kind = 'Rework' THEN t[:s + sz + dist] || t[s + 1:s + sz] || t[s + sz + dist + 1:]
    WHEN kind = 'Early' THEN t[:s - dist] || t[s + 1:s + sz] || t[s - dist + 1:s] || t[s + sz + 1:]
    WHEN kind = 'Late' THEN t[:s] || t[s + sz + 1:s + sz + dist] || t[s + 1:s + sz] || t[s + sz + dist + 1:]
    WHEN kind = 'Insert' THEN flatten(list_transform(t, lambda x, i: CASE WHEN list_contains(pl, i - 1) THEN [nm[list_position(pl, i - 1)], x] ELSE [x] END))
    WHEN kind = 'Replace' THEN list_transform(t, lambda x, i: CASE WHEN list_contains(pl, i - 1) THEN nm[list_position(pl, i - 1)] ELSE x END)
    WHEN kind = 'Skip' THEN rest
    WHEN kind = 'SkipAndInsert' THEN flatten(list_transform(rest, lambda x, i: CASE WHEN list_contains(pl2, i - 1) THEN [nm[list_position(pl2, i - 1)], x] ELSE [x] END))
    END AS t,
    CASE WHEN NOT live THEN NULL WHEN kind = 'SkipSequence' THEN s WHEN kind = 'Rework' THEN s + sz + dist END AS start,
    CASE WHEN NOT live THEN NULL WHEN kind = 'Early' THEN s + sz WHEN kind = 'Late' THEN s END AS shift_from,
    CASE WHEN NOT live THEN NULL WHEN kind = 'Early' THEN s - dist WHEN kind = 'Late' THEN s + dist END AS shift_to,
    CASE WHEN NOT live THEN NULL WHEN kind = 'Insert' THEN [p + list_position(pl, p) - 1 for p in pl] WHEN kind = 'Replace' THEN pl
    WHEN kind = 'Skip' THEN list_sort(list_distinct(closed)) END AS indices,
    CASE WHEN live AND kind = 'SkipAndInsert' THEN [p + list_position(pl2, p) - 1 for p in pl2] END AS inserts,
    CASE WHEN live AND kind = 'SkipAndInsert' THEN list_sort(list_distinct([p + len([r for r in pl2 if r < p]) for p in closed])) END AS skips,
    CASE WHEN NOT live THEN NULL WHEN kind IN ('SkipSequence', 'Rework') THEN t[s + 1:s + sz]
    WHEN kind IN ('Replace', 'Skip', 'SkipAndInsert') THEN [t[p + 1] for p in pl] END AS acts
    FROM i8)
"""


LABELS = """case_id, kind, round, array_to_string(t, ',') AS trace, anomaly, sz AS size, start, shift_from, shift_to,
    array_to_string(indices::VARCHAR[], ',') AS indices, array_to_string(inserts::VARCHAR[], ',') AS inserts,
    array_to_string(skips::VARCHAR[], ',') AS skips, array_to_string(acts, ',') AS acts"""

for name, kind in [
    ("skipseq", "SkipSequence"), ("rework", "Rework"), ("early", "Early"), ("late", "Late"), ("insert", "Insert"),
    ("replace", "Replace"), ("skip", "Skip"), ("skipinsert", "SkipAndInsert"),
]:
    put(f"inj_{name}", LOG, VOC, f"src0 AS (SELECT *, '{kind}' AS kind, 1 AS round FROM cs)", inject("src0"), select=f"SELECT {LABELS} FROM inj")
put("inj_filler", LOG, VOC, "src0 AS (SELECT *, 'Insert' AS kind, 1 AS round FROM cs)", inject("src0", filler=True), select=f"SELECT {LABELS} FROM inj")


def grid(kinds, times: int) -> str:
    rows = ["('Normal', 0)"] + [f"('{k}', {r})" for r in range(1, times + 1) for k in kinds]
    return f"grid(kind, round) AS (VALUES {', '.join(rows)}), src0 AS (SELECT * FROM cs, grid)"


SWEPT = [LOG, VOC, grid(SWEEP, 2), inject("src0")]
ALL_KINDS = [LOG, VOC, grid([*c.inj.SWEEP, *c.inj.FURTHER], 1), inject("src0")]

TARGETS = """
cells AS (SELECT case_id, kind, round, anomaly, sz, start, shift_from, shift_to, indices, inserts, skips,
          unnest(range(0, len(t) + 2)) AS event_position FROM inj),
cell AS (SELECT *, event_position - 1 AS i FROM cells)
"""
put("targets", *ALL_KINDS, TARGETS, select="""SELECT case_id, kind, round, event_position,
    CASE WHEN anomaly = 'SkipSequence' AND i = start THEN 3
    WHEN anomaly = 'Rework' AND i BETWEEN start AND start + sz - 1 THEN 4
    WHEN anomaly = 'Early' AND i BETWEEN shift_to AND shift_to + sz - 1 THEN 5
    WHEN anomaly = 'Late' AND i BETWEEN shift_to AND shift_to + sz - 1 THEN 6
    WHEN anomaly IN ('Early', 'Late') AND i = shift_from THEN 7
    WHEN anomaly = 'Insert' AND list_contains(indices, i) THEN 2
    WHEN anomaly = 'Replace' AND list_contains(indices, i) THEN 8
    WHEN anomaly = 'Skip' AND list_contains(indices, i) THEN 3
    WHEN anomaly = 'SkipAndInsert' AND list_contains(skips, i) THEN 3
    WHEN anomaly = 'SkipAndInsert' AND list_contains(inserts, i) THEN 2 ELSE 0 END AS code,
    CASE WHEN anomaly IN ('Insert', 'Replace') AND list_contains(indices, i) THEN 9
    WHEN anomaly = 'SkipAndInsert' AND list_contains(inserts, i) THEN 9 ELSE 0 END AS attr_code FROM cell""")


def plus_one(col: str) -> str:
    return f"array_to_string([(x + 1)::VARCHAR for x in {col}], ', ')"


put("descriptors", *ALL_KINDS, select="SELECT kind, count(*) AS num_cases, 5 AS distance, kind AS named FROM inj WHERE anomaly <> 'normal' GROUP BY kind")
put("label_text", *ALL_KINDS, select=f"""SELECT case_id, kind, CASE
    WHEN anomaly IN ('SkipSequence', 'Rework') THEN anomaly || ' ' || {text('acts', ', ')} || ' at ' || (start + 1)
    WHEN anomaly IN ('Early', 'Late') THEN anomaly || ' ' || sz || ' from ' || (shift_from + 1) || ' to ' || (shift_to + 1)
    WHEN anomaly IN ('Replace', 'Skip') THEN anomaly || ' ' || {text('acts', ', ')} || ' at ' || {plus_one('indices')}
    WHEN anomaly = 'Insert' THEN 'Insert at ' || {plus_one('indices')}
    WHEN anomaly = 'SkipAndInsert' THEN 'SkipAndInsert skip ' || {text('acts', ', ')} || ' at ' || {plus_one('skips')} || ' and insert at ' || {plus_one('inserts')}
    ELSE 'Normal' END AS label_text FROM inj""")

CAUSE = """
ca AS (SELECT *, CASE WHEN anomaly IN ('SkipSequence', 'Rework') THEN acts
       WHEN anomaly IN ('Early', 'Late') THEN t[shift_to + 1:shift_to + sz] WHEN anomaly = 'Insert' THEN [t[p + 1] for p in indices] END AS ac,
       CASE anomaly WHEN 'SkipSequence' THEN t[start + 1] WHEN 'Rework' THEN t[start] WHEN 'Early' THEN t[shift_from]
       WHEN 'Late' THEN t[shift_from + 1] END AS nb FROM inj),
cb AS (SELECT *, len(ac) AS m, CASE WHEN len(ac) = 1 THEN 'activity ''' || ac[1] || ''''
       ELSE 'activities ''' || array_to_string(ac[:len(ac) - 1], ''',''') || ''' and ''' || ac[len(ac)] || '''' END AS who,
       CASE WHEN len(ac) = 1 THEN 'is' ELSE 'are' END AS verb, CASE WHEN len(ac) = 1 THEN 'it' ELSE 'they' END AS pron FROM ca),
said AS (SELECT *, CASE anomaly
       WHEN 'SkipSequence' THEN 'The ' || who || ' ' || verb || ' skipped before ''' || nb || '''.'
       WHEN 'Rework' THEN 'The ' || who || ' ' || verb || ' reworked after ''' || nb || '''.'
       WHEN 'Early' THEN 'The ' || who || ' ' || verb || ' executed too early, ' || pron || ' should be executed after ''' || nb || '''.'
       WHEN 'Late' THEN 'The ' || who || ' ' || verb || ' executed too late, ' || pron || ' should be executed before ''' || nb || '''.'
       WHEN 'Insert' THEN 'The ' || who || ' should not be executed.' END AS cause FROM cb)
"""
put("cause", *SWEPT, CAUSE, select="SELECT case_id, kind, round, cause FROM said WHERE anomaly <> 'normal'")

# Registered types: neighbours that change places, and drawn names behind the end.
OWN = [LOG, VOC, grid(["Insert"], 2), inject("src0"), f"""
own0 AS (SELECT case_id, t, n, kind, round, {pick('n - 1', 'at')} AS spot, 1 + {pick('2', 'count')} AS m
    FROM cs, (VALUES ('Swap', 1), ('Append', 1), ('Swap', 2), ('Append', 2)) o(kind, round)),
own1 AS (SELECT *, [names[x % len(names) + 1] for x in [{d(*WHO, q('name'), 'j')} for j in range(1, m + 1)]] AS nm FROM own0, voc),
own2 AS (SELECT case_id, kind, round, CASE WHEN kind = 'Append' THEN t || nm WHEN n < 2 THEN t
        ELSE t[:spot] || [t[spot + 2], t[spot + 1]] || t[spot + 3:] END AS t,
    CASE WHEN kind = 'Append' THEN 'Append' WHEN n < 2 THEN 'normal' ELSE 'Swap' END AS anomaly,
    CASE WHEN kind = 'Append' THEN m WHEN n >= 2 THEN 2 END AS size, CASE WHEN kind = 'Swap' AND n >= 2 THEN spot END AS start,
    CASE WHEN kind = 'Append' THEN range(n, n + m) END AS indices,
    CASE WHEN kind = 'Append' THEN nm WHEN n >= 2 THEN t[spot + 1:spot + 2] END AS acts FROM own1),
every AS (SELECT case_id, kind, round, t, anomaly, sz AS size, start, indices, acts FROM inj UNION ALL SELECT * FROM own2)
"""]
put("own_kinds", *OWN, select=f"""SELECT case_id, kind, round, {text('t')} AS trace, anomaly, size, start,
    array_to_string(indices::VARCHAR[], ',') AS indices, array_to_string(acts, ',') AS acts,
    CASE anomaly WHEN 'Swap' THEN 'Swap ' || {text('acts', ', ')} || ' at ' || (start + 1) WHEN 'Append' THEN 'Append'
    WHEN 'Insert' THEN 'Insert at ' || {plus_one('indices')} ELSE 'Normal' END AS label_text,
    CASE WHEN anomaly = 'Swap' THEN 'The activities ''' || acts[1] || ''' and ''' || acts[2] || ''' are swapped.'
    WHEN anomaly = 'Insert' AND len(indices) = 1 THEN 'The activity ''' || t[indices[1] + 1] || ''' should not be executed.'
    WHEN anomaly = 'Insert' THEN 'The activities ''' || array_to_string([t[p + 1] for p in indices[:len(indices) - 1]], ''',''')
        || ''' and ''' || t[indices[len(indices)] + 1] || ''' should not be executed.' END AS cause FROM every""")
put("own_targets", *OWN, "cell AS (SELECT *, event_position - 1 AS i FROM (SELECT *, unnest(range(0, len(t) + 2)) AS event_position FROM every))",
    select="""SELECT case_id, kind, round, event_position,
    CASE WHEN anomaly = 'Swap' AND i BETWEEN start AND start + 1 THEN 7 WHEN anomaly IN ('Insert', 'Append') AND list_contains(indices, i) THEN 2 ELSE 0 END AS code,
    CASE WHEN anomaly IN ('Insert', 'Append') AND list_contains(indices, i) THEN 9 ELSE 0 END AS attr_code FROM cell""")

# Attribute cells.
CELLS = f"""
at0 AS (SELECT case_id, n, 1 + {below('least(n, 2)', 'case_id', q('cells'))} AS m FROM cs),
at1 AS (SELECT case_id, unnest([e.p for e in (list_sort([{{'h': {h('case_id', q('cell'), 'p')}, 'p': p}} for p in range(1, n + 1)]))[1:m]]) AS pos FROM at0),
at2 AS (SELECT case_id, pos, CASE WHEN {h('case_id', 'pos', q('attr'), '1')} < {h('case_id', 'pos', q('attr'), '2')} THEN 'k' ELSE 'value' END AS attr FROM at1),
at3 AS (SELECT a.case_id, a.pos, a.attr, CASE a.attr WHEN 'k' THEN l.k ELSE l.value::VARCHAR END AS original FROM at2 a JOIN log l USING (case_id, pos)),
dn AS (SELECT attr, count(*) AS m FROM dom GROUP BY attr),
cells AS (SELECT x.case_id, x.pos, x.attr, x.original, nw.val FROM at3 x JOIN dn USING (attr)
    JOIN dom od ON od.attr = x.attr AND od.val = x.original
    JOIN dom nw ON nw.attr = x.attr AND nw.idx = (od.idx + 1 + {d('x.case_id', 'x.pos', 'x.attr')} % (dn.m - 1)) % dn.m)
"""
put("inj_attribute", LOG, ATTR_VALUES, CELLS, select="SELECT case_id, pos, attr, original, val FROM cells")
put("attribute_targets", LOG, ATTR_VALUES, CELLS, select="""SELECT case_id, pos AS event_position, CASE attr WHEN 'k' THEN 1 ELSE 2 END AS "column", 9 AS code FROM cells""")
put("attribute_label_text", LOG, ATTR_VALUES, CELLS, select="""SELECT case_id, 'Attribute [''' || array_to_string(list(attr ORDER BY pos), ''', ''') || '''] at ['
    || array_to_string(list(pos::VARCHAR ORDER BY pos), ', ') || '] was [''' || array_to_string(list(original ORDER BY pos), ''', ''') || ''']' AS label_text
    FROM cells GROUP BY case_id""")

put("attribute_log", LOG, ATTR_VALUES, CELLS,
    """lb AS (SELECT case_id, list(c ORDER BY c.pos, c.attr) AS cs FROM (SELECT case_id, {'pos': pos, 'attr': attr, 'original': original} AS c FROM cells) GROUP BY case_id)""",
    select="""SELECT log.case_id, log.pos, activity, coalesce(ck.val, k) AS k, coalesce(cv.val, value::VARCHAR) AS value,
    CASE WHEN cs IS NULL THEN 'normal' ELSE 'Attribute' END AS anomaly, coalesce(array_to_string([(c.pos - 1)::VARCHAR for c in cs], ','), '') AS index,
    coalesce(array_to_string([CASE c.attr WHEN 'k' THEN '0' ELSE '1' END for c in cs], ','), '') AS attribute_index,
    coalesce(array_to_string([c.attr for c in cs], ','), '') AS attribute, coalesce(array_to_string([c.original for c in cs], ','), '') AS original
    FROM log LEFT JOIN lb ON lb.case_id = log.case_id
    LEFT JOIN cells ck ON ck.case_id = log.case_id AND ck.pos = log.pos AND ck.attr = 'k'
    LEFT JOIN cells cv ON cv.case_id = log.case_id AND cv.pos = log.pos AND cv.attr = 'value'""")

# Exclusive branches.
BRANCHES = f"""
br0 AS (SELECT DISTINCT user_id AS model_id, 'x1' AS xor_id, event_type AS activity FROM events),
br1 AS (SELECT *, {below('3', q('side'), 'model_id', 'activity')} AS branch_id FROM br0),
br AS (SELECT * FROM br1 WHERE model_id IN (SELECT model_id FROM br1 GROUP BY model_id HAVING count(DISTINCT branch_id) >= 2))
"""
put("branches", BRANCHES, select="SELECT model_id, xor_id, branch_id, activity FROM br")

def sized(col: str) -> str:
    """A list as one text that no other list gives."""
    return f"array_to_string([length(x) || ':' || x for x in {col}], '')"


def exclusive(trace: str) -> str:
    """CTEs to ``xw``: two runs per choice that mix its branches, and their causes, from the traces of the models' cases."""
    return f"""
    mt AS (SELECT DISTINCT user_id AS model_id, {trace} AS t FROM cs),
    hit AS (SELECT m.model_id, b.xor_id, m.t FROM mt m JOIN br b ON b.model_id = m.model_id AND list_contains(m.t, b.activity)
        GROUP BY ALL HAVING count(DISTINCT b.branch_id) > 1),
    ch AS (SELECT *, row_number() OVER (PARTITION BY model_id, xor_id ORDER BY {h(q('exclusive'), 'model_id', 'xor_id', sized('t'))}) AS i,
        count(*) OVER (PARTITION BY model_id, xor_id) AS c FROM hit),
    ow AS (SELECT model_id, xor_id, branch_id AS own, row_number() OVER (PARTITION BY model_id, xor_id
        ORDER BY {h(q('branch'), 'model_id', 'xor_id', 'branch_id')}) AS i FROM (SELECT DISTINCT model_id, xor_id, branch_id FROM br)),
    pa AS (SELECT ch.model_id, ch.xor_id, ch.i, ch.t,
        coalesce(list(DISTINCT b.activity ORDER BY b.activity) FILTER (b.branch_id = own), []) AS p1,
        coalesce(list(DISTINCT b.activity ORDER BY b.activity) FILTER (b.branch_id <> own), []) AS p2
        FROM ch JOIN ow USING (model_id, xor_id, i) JOIN br b ON b.model_id = ch.model_id AND b.xor_id = ch.xor_id AND list_contains(ch.t, b.activity)
        WHERE ch.i <= 2 AND ch.c >= 2 GROUP BY ALL),
    pb AS (SELECT *, CASE len(p1) WHEN 0 THEN '[Unknown]' WHEN 1 THEN p1[1] ELSE array_to_string(p1[:len(p1) - 1], ''',''') || ''' and ''' || p1[len(p1)] END AS w1,
        CASE len(p2) WHEN 0 THEN '[Unknown]' WHEN 1 THEN p2[1] ELSE array_to_string(p2[:len(p2) - 1], ''',''') || ''' and ''' || p2[len(p2)] END AS w2 FROM pa),
    xw AS (SELECT *, 'The ' || CASE WHEN len(p1) > 1 THEN 'activities' ELSE 'activity' END || ' ''' || w1 || ''' ' || CASE WHEN len(p1) > 1 THEN 'are' ELSE 'is' END
        || ' mutually exclusive with the ' || CASE WHEN len(p2) > 1 THEN 'activities' ELSE 'activity' END || ' ''' || w2
        || ''', meaning they should not be executed within the same process instance.' AS cause,
        'exclusive-' || model_id || '-' || xor_id || '-' || i AS case_id FROM pb)"""


put("exclusive", LOG, BRANCHES, exclusive("t"),
    select=f"SELECT model_id, xor_id, i, {text('t')} AS trace, {text('p1')} AS part1, {text('p2')} AS part2, cause FROM xw")
MIXED = [BRANCHES, exclusive("list_reverse(t)")]
put("inject_all", *SWEPT, *MIXED, select=f"""SELECT {LABELS} FROM inj UNION ALL
    SELECT case_id, 'Exclusive', i, {text('t')}, 'Exclusive', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM xw""")

# --- split, prefixes, detection ------------------------------------------------------------

LABELLED = [
    LOG, VOC,
    f"""src0 AS (SELECT *, CASE {below('10', q('mix'), 'case_id')} WHEN 0 THEN 'SkipSequence' WHEN 1 THEN 'Insert' ELSE 'Normal' END AS kind,
        1 AS round FROM cs)""",
    inject("src0"),
    "lab AS (SELECT case_id, t, len(t) AS n, CASE WHEN anomaly <> 'normal' THEN 1 ELSE 0 END AS flag, anomaly FROM inj)",
]
put("csv_log", *LABELLED, select="""SELECT case_id, pos, t[pos] AS activity, flag AS is_anomaly, anomaly
    FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM lab)""")
put("train_test_csv", *LABELLED, "fl AS (SELECT case_id, flag, unnest(t) AS name FROM lab)", select="""
    SELECT 'train' AS part, case_id, name FROM fl WHERE flag = 0 UNION ALL SELECT 'test', case_id, name FROM fl""")
put("prefixes", *LABELLED, select=f"""SELECT case_id, prefix_len, {text('t[:prefix_len]')} AS prefix, flag AS label
    FROM (SELECT *, unnest(range(1, n + 1)) AS prefix_len FROM lab)""")

SPLIT = [
    *LABELLED,
    f"nr AS (SELECT case_id, row_number() OVER (ORDER BY {h(q('split'), '1', 'case_id')}) AS rn, count(*) OVER () AS c FROM lab WHERE flag = 0)",
    "trn AS (SELECT lab.* FROM lab JOIN nr USING (case_id) WHERE rn <= floor(0.8::DOUBLE * c))",
    "tst AS (SELECT * FROM lab WHERE case_id NOT IN (SELECT case_id FROM trn))",
]
put("split", *SPLIT, select="SELECT case_id, n, 'train' AS part FROM trn UNION ALL SELECT case_id, n, 'test' FROM tst")
TRAIN_VOC = "tv AS (SELECT DISTINCT unnest(t) AS activity FROM trn)"
put("vocab", *SPLIT, TRAIN_VOC, select="SELECT row_number() OVER (ORDER BY activity) - 1 AS idx, activity FROM tv")
put("prefix_dims", *SPLIT, TRAIN_VOC, select="""SELECT prefix_len, count(*) AS num_samples, min(dim) AS min_dim, max(dim) AS max_dim, avg(dim) AS avg_dim
    FROM (SELECT unnest(range(1, n + 1)) AS prefix_len, (SELECT count(*) FROM tv) * unnest(range(1, n + 1)) AS dim FROM trn) GROUP BY prefix_len""")
put("onehot", DIALOGUES, "dv AS (SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS idx FROM (SELECT DISTINCT activity FROM dl WHERE activity <> 'assistant'))",
    select="SELECT case_id, pos, activity, idx FROM dl LEFT JOIN dv USING (activity)")
put("pad", *SPLIT, select="""SELECT case_id, (SELECT max(n) FROM trn) AS dim, list_sum([length(a)::DOUBLE for a in t]) AS total FROM trn""")
VECTORS = [
    *SPLIT, TRAIN_VOC,
    f"""ps AS (SELECT t, unnest(range(1, n + 1)) AS p FROM trn),
    nb AS (SELECT t[p] AS activity, t[x] AS near FROM (SELECT t, p, unnest(range(greatest(1, p - 5), least(len(t), p + 5) + 1)) AS x FROM ps) WHERE x <> p),
    en AS (SELECT activity, {below('32', q('entry'), 'near')} AS entry, sum(1 - 2 * {below('2', q('sign'), 'near')}) AS c FROM nb GROUP BY ALL),
    nm AS (SELECT activity, sqrt(greatest(sum(c * c), 1)::DOUBLE) AS norm FROM en GROUP BY activity),
    vec AS (SELECT tv.activity, e.entry, round(coalesce(en.c, 0)::DOUBLE / coalesce(norm, 1), 9) AS value FROM tv CROSS JOIN range(32) e(entry)
        LEFT JOIN en ON en.activity = tv.activity AND en.entry = e.entry LEFT JOIN nm ON nm.activity = tv.activity)""",
]
put("w2v_vocab", *VECTORS, select="SELECT activity, entry, value FROM vec")
put("w2v_encode", *VECTORS, """sv AS (SELECT activity, sum(value) AS value FROM vec GROUP BY activity),
    te AS (SELECT case_id, n, unnest(t) AS activity FROM tst WHERE n > 0)""",
    select="SELECT case_id, any_value(32 * n) AS dim, round(coalesce(sum(value), 0), 6) AS total FROM te LEFT JOIN sv ON sv.activity = te.activity GROUP BY case_id")
PMI = """nc AS (SELECT activity, near, count(*) AS c FROM nb WHERE activity IS NOT NULL AND near IS NOT NULL GROUP BY ALL),
    ns AS (SELECT activity, sum(c) AS s FROM nc GROUP BY activity),
    pmi AS (SELECT nc.activity, near, ln(c::DOUBLE * (SELECT sum(c) FROM nc)::DOUBLE / (a.s::DOUBLE * b.s::DOUBLE)) AS value
        FROM nc JOIN ns a ON a.activity = nc.activity JOIN ns b ON b.activity = nc.near)"""
put("pmi", *VECTORS, PMI, select="SELECT activity, near, round(value, 9) AS value FROM pmi WHERE value > 0")
# With no more activities than directions the factors give the table back.
put("pmi_factors", *VECTORS, PMI, select="SELECT activity, near, round(value, 6) AS value FROM pmi WHERE value > 0")
put("noise", LOG, select="SELECT DISTINCT n AS prefix_len, round(least(0.3::DOUBLE, 0.3::DOUBLE / greatest(1.0, n / 3.0::DOUBLE)), 12) AS noise FROM cs")

MODEL = [
    *SPLIT, TRAIN_VOC,
    f"""sm0 AS (SELECT *, {h(q('sample'), 'case_id')} AS hh, unnest(range(1, n + 1)) AS k FROM trn),
    sm1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hh) AS rn, count(*) OVER (PARTITION BY k) AS m FROM sm0),
    sm2 AS (SELECT *, m - greatest(1, floor(m::DOUBLE * 0.1::DOUBLE))::BIGINT AS nf FROM sm1),
    smp AS (SELECT case_id, t, n, flag, k, nf, CASE WHEN rn > nf THEN 1 ELSE 0 END AS tail FROM sm2 WHERE nf >= 1),
    cnt AS (SELECT k, pos, t[pos] AS activity, count(*) AS c FROM (SELECT k, t, unnest(range(1, k + 1)) AS pos FROM smp WHERE tail = 0) GROUP BY ALL),
    nrm AS (SELECT k, any_value(nf) AS nf, any_value(sq) AS sq FROM smp JOIN (SELECT k, sum(c::HUGEINT * c) AS sq FROM cnt GROUP BY k) USING (k) GROUP BY k)""",
]


def scored(source: str, out: str) -> str:
    return f"""
{out}0 AS (SELECT x.case_id, x.k, count(tv.activity) AS known, sum(coalesce(cnt.c, 0)) AS hits
    FROM (SELECT case_id, t, k, unnest(range(1, k + 1)) AS pos FROM {source}) x LEFT JOIN tv ON tv.activity = x.t[x.pos]
    LEFT JOIN cnt ON cnt.k = x.k AND cnt.pos = x.pos AND cnt.activity = x.t[x.pos] GROUP BY x.case_id, x.k),
{out} AS (SELECT case_id, k, round((known::DOUBLE + sq::DOUBLE / (nf::DOUBLE * nf::DOUBLE) - 2.0::DOUBLE * hits::DOUBLE / nf::DOUBLE)
    / ((SELECT count(*) FROM tv) * k)::DOUBLE, 9) AS score FROM {out}0 JOIN nrm USING (k))
"""


ERRORS = [*MODEL, scored("smp", "ts"), "er AS (SELECT k, score, tail, flag AS label, count(*) AS w FROM smp JOIN ts USING (case_id, k) GROUP BY ALL)"]
PS = ", ".join(f"({p})" for p in range(80, 100))
THRESHOLDS = [
    *ERRORS,
    f"pc(p) AS (VALUES {PS})",
    """fe AS (SELECT k, score FROM smp JOIN ts USING (case_id, k) WHERE tail = 0),
    fr AS (SELECT k, score, row_number() OVER (PARTITION BY k ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY k) AS m FROM fe),
    th AS (SELECT fr.k, pc.p, any_value(m) AS m, max(CASE WHEN r = (m - 1) * p // 100 THEN score END) AS lo,
        max(CASE WHEN r = least((m - 1) * p // 100 + 1, m - 1) THEN score END) AS hi FROM fr, pc GROUP BY fr.k, pc.p),
    cand AS (SELECT k AS prefix_len, p, round(lo + (hi - lo) * ((((m - 1) * p) % 100) / 100.0::DOUBLE), 12) AS threshold FROM th)""",
]
BEST = [
    *THRESHOLDS,
    """jd AS (SELECT prefix_len, p, threshold, sum(CASE WHEN score > threshold AND label = 1 THEN w ELSE 0 END) AS tp,
        sum(CASE WHEN score > threshold AND label = 0 THEN w ELSE 0 END) AS fp, sum(CASE WHEN score <= threshold AND label = 1 THEN w ELSE 0 END) AS fn
        FROM cand JOIN er ON er.k = cand.prefix_len WHERE tail = 1 GROUP BY ALL),
    jf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1 FROM jd),
    best AS (SELECT prefix_len, p, threshold, f1 FROM jf QUALIFY row_number() OVER (PARTITION BY prefix_len ORDER BY f1 DESC, p) = 1)""",
]
FOUND = [
    *BEST,
    "tp0 AS (SELECT case_id, t, n, flag, anomaly, unnest(range(1, n + 1)) AS k FROM tst)",
    scored("tp0", "tx"),
    """det AS (SELECT tp0.case_id, tp0.k AS prefix_len, array_to_string(t[:tp0.k], ', ') AS trace, tx.score, flag AS true_label,
        CASE WHEN tx.score > threshold THEN 1 ELSE 0 END AS predicted
        FROM tp0 JOIN tx ON tx.case_id = tp0.case_id AND tx.k = tp0.k JOIN best ON best.prefix_len = tp0.k),
    vd AS (SELECT tst.case_id, any_value(n) AS n, any_value(flag) AS true_label, coalesce(max(predicted), 0) AS predicted, max(score) AS score,
        min(CASE WHEN predicted = 1 THEN prefix_len END) AS first_flag, any_value(anomaly) AS anomaly
        FROM tst LEFT JOIN det USING (case_id) GROUP BY tst.case_id)""",
]
put("model_freq", *MODEL, select="SELECT cnt.k AS prefix_len, pos, activity, c, round(c::DOUBLE / nf::DOUBLE, 9) AS share FROM cnt JOIN nrm USING (k)")
put("model_linear", *MODEL, """cl AS (SELECT sum(pow(1 - coalesce(c, 0)::DOUBLE / (coalesce(c, 0) + nf * 0.3::DOUBLE * 0.3::DOUBLE), 2)) AS tr
    FROM tv CROSS JOIN (SELECT nf FROM nrm WHERE k = 1) LEFT JOIN cnt ON cnt.k = 1 AND cnt.activity = tv.activity),
    sz AS (SELECT count(*) AS v FROM tv)""",
    select="""SELECT k AS prefix_len, least(k * v, 1024) AS dim, 0.0::DOUBLE AS residual, CASE WHEN k = 1 THEN round(tr, 6) END AS trace, least(k * v, 1024) AS num_rows
    FROM nrm, sz, cl""")
# The moments of single events are diagonal: directions are activities, the three most frequent and those as frequent as the third.
put("model_bottleneck", *MODEL, """ac AS (SELECT coalesce(c, 0) AS c, nf FROM tv CROSS JOIN (SELECT nf FROM nrm WHERE k = 1) LEFT JOIN cnt ON cnt.k = 1 AND cnt.activity = tv.activity),
    rk AS (SELECT *, rank() OVER (ORDER BY c DESC) AS r FROM ac),
    cl AS (SELECT sum(pow(1 - CASE WHEN r <= 3 THEN c::DOUBLE / (c + nf * 0.3::DOUBLE * 0.3::DOUBLE) ELSE 0 END, 2)) AS tr FROM rk),
    sz AS (SELECT count(*) AS v FROM tv)""",
    select="""SELECT k AS prefix_len, least(k * v, 1024) AS dim, 0.0::DOUBLE AS residual, CASE WHEN k = 1 THEN round(tr, 6) END AS trace, least(k * v, 1024) AS num_rows
    FROM nrm, sz, cl""")
put("val_tail", *MODEL, select="SELECT case_id, k AS prefix_len, tail AS in_tail FROM smp")
put("scores_freq", *ERRORS, select="SELECT k AS prefix_len, score, tail AS in_tail, label, w FROM er")
put("thresholds", *THRESHOLDS, select="SELECT prefix_len, p, threshold FROM cand")
put("best_threshold", *BEST, select="SELECT prefix_len, p, threshold, f1 FROM best")
put("detect", *FOUND, select="SELECT case_id, prefix_len, trace, score, true_label, predicted FROM det")
put("case_verdict", *FOUND, select="SELECT case_id, n, true_label, predicted, score FROM vd")
put("earliness", *FOUND, select="SELECT case_id, first_flag, n, round(first_flag::DOUBLE / n, 12) AS share FROM vd WHERE first_flag IS NOT NULL")
ORACLE["q_stream_earliness"] = ORACLE["q_earliness"]
put("prefix_counts", *FOUND, select="""SELECT prefix_len, count(*) FILTER (true_label = 0) AS normal_count,
    count(*) FILTER (true_label = 1) AS anomaly_count FROM det GROUP BY prefix_len""")


def weighted(source: str, key: str) -> str:
    return f"""
wa AS (SELECT {key} AS key, count(*) FILTER (true_label = 1 AND predicted = 1)::DOUBLE AS a, count(*) FILTER (true_label = 0 AND predicted = 1)::DOUBLE AS b,
    count(*) FILTER (true_label = 1 AND predicted = 0)::DOUBLE AS c, count(*) FILTER (true_label = 0 AND predicted = 0)::DOUBLE AS d FROM {source} GROUP BY {key}),
wm AS (SELECT key,
    ((a + c) * coalesce(a / nullif(a + b, 0), 0) + (b + d) * coalesce(d / nullif(d + c, 0), 0)) / (a + b + c + d) AS precision,
    ((a + c) * coalesce(a / nullif(a + c, 0), 0) + (b + d) * coalesce(d / nullif(b + d, 0), 0)) / (a + b + c + d) AS recall,
    ((a + c) * coalesce(2 * a / nullif(2 * a + b + c, 0), 0) + (b + d) * coalesce(2 * d / nullif(2 * d + b + c, 0), 0)) / (a + b + c + d) AS f1 FROM wa)
"""


def auc(source: str, key: str) -> str:
    return f"""
ra AS (SELECT {key} AS key, true_label, rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0::DOUBLE AS r
    FROM {source} WHERE score IS NOT NULL),
rb AS (SELECT key, sum(r) FILTER (true_label = 1) AS s1, count(*) FILTER (true_label = 1) AS n1, count(*) FILTER (true_label = 0) AS n0 FROM ra GROUP BY key),
rc AS (SELECT key, CASE WHEN n1 > 0 AND n0 > 0 THEN (s1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1::DOUBLE * n0) END AS auc, n1, n0 FROM rb),
ru AS (SELECT {key} AS key, count(*) FILTER (score IS NULL) AS unscored FROM {source} GROUP BY {key})
"""


WM = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1_score"
put("weighted_metrics", *FOUND, weighted("vd", "n % 3"), select=f"SELECT key AS dataset, {WM} FROM wm")
put("roc_auc", *FOUND, auc("vd", "n % 3"), select="SELECT key AS dataset, round(auc, 9) AS roc_auc, n1, n0, unscored FROM rc JOIN ru USING (key)")
put("f1_prefix", *FOUND, weighted("det", "prefix_len"), select="SELECT key AS prefix_len, round(f1, 9) AS f1_score FROM wm")
put("f1_type", *FOUND, "vt AS (SELECT * REPLACE (lower(trim(anomaly)) AS anomaly) FROM vd WHERE lower(trim(anomaly)) <> 'normal')",
    weighted("vt", "anomaly"), select="SELECT key AS anomaly, round(f1, 9) AS f1_score FROM wm")
put("metrics_long", *FOUND, weighted("vd", "1"), auc("vd", "1"), "mx AS (SELECT * FROM wm JOIN rc USING (key))", select="""
    SELECT 'sessions' AS dataset, 'onehot' AS encoding, 'precision' AS metric, round(precision, 9) AS value FROM mx
    UNION ALL SELECT 'sessions', 'onehot', 'recall', round(recall, 9) FROM mx UNION ALL SELECT 'sessions', 'onehot', 'f1_score', round(f1, 9) FROM mx
    UNION ALL SELECT 'sessions', 'onehot', 'roc_auc', round(auc, 9) FROM mx""")

put("result_csv", *FOUND, select="""SELECT prefix_len, count(*) FILTER (true_label = 0) AS normal_count, count(*) FILTER (true_label = 1) AS anomaly_count,
    'sessions' AS dataset, 'onehot' AS encoding, 1 AS run FROM det GROUP BY prefix_len""")


def swept(run: int, log: int | None = None) -> str:
    """Metrics of one run: the same definitions over another split, and over one of three logs if asked for."""
    mine = [x.replace(h(q("split"), "1", "case_id"), h(q("split"), str(run), "case_id")) for x in FOUND]
    if log is not None:
        at = next(k for k, x in enumerate(mine) if x.startswith("lab AS"))
        mine[at : at + 1] = [mine[at].replace("lab AS", "whole AS", 1), f"lab AS (SELECT * FROM whole WHERE {below('3', q('log'), 'case_id')} = {log})"]
        return sql(*mine, weighted("vd", "1"), auc("vd", "1"), select=f"""SELECT 'log{log}' AS dataset, {run} AS run,
            {WM}, round(auc, 9) AS roc_auc FROM wm JOIN rc USING (key)""")
    return sql(*mine, weighted("vd", "1"), auc("vd", "1"), select=f"""SELECT 'sessions' AS dataset, 'onehot' AS encoding, {run} AS run,
        {WM}, round(auc, 9) AS roc_auc FROM wm JOIN rc USING (key)""")


ORACLE["q_run_sweep_logs"] = " UNION ALL ".join(f"SELECT * FROM ({swept(run, log)})" for log in range(3) for run in (1, 2))
ORACLE["q_run_sweep"] = f"SELECT * FROM ({swept(1)}) UNION ALL SELECT * FROM ({swept(2)})"

# --- datasets and responses ----------------------------------------------------------------

SIDES = f"""
md AS (SELECT model_id, row_number() OVER (ORDER BY {h(q('model'), 'model_id')}) AS rn, count(*) OVER () AS c
    FROM (SELECT DISTINCT user_id AS model_id FROM cs)),
sides AS (SELECT model_id, CASE WHEN rn <= c - {c.TEST_MODELS} THEN 'train' ELSE 'test' END AS part FROM md)
"""
put("model_split", LOG, SIDES, select="SELECT model_id, case_id, part FROM cs JOIN sides ON sides.model_id = cs.user_id")
SET = [
    *SWEPT, CAUSE, SIDES, *MIXED,
    f"""sv AS (SELECT case_id, kind, round, user_id AS model_id, t, anomaly, cause FROM said
        UNION ALL SELECT case_id, 'Exclusive', i, model_id, t, 'Exclusive', cause FROM xw),
    sw AS (SELECT s.*, part, '[' || {text('t')} || ']' AS trace FROM sv s JOIN sides ON sides.model_id = s.model_id),
    nt AS (SELECT DISTINCT part, model_id, trace, t FROM sw WHERE anomaly = 'normal'),
    anm AS (SELECT * FROM sw WHERE anomaly <> 'normal' AND NOT EXISTS (SELECT 1 FROM nt WHERE nt.model_id = sw.model_id AND nt.trace = sw.trace))""",
]
put("train_set", *SET, select="""SELECT model_id, trace, 'normal' AS label, '' AS cause FROM nt, range(10) WHERE part = 'train'
    UNION ALL SELECT model_id, trace, 'anomalous', cause FROM anm WHERE part = 'train' UNION ALL SELECT model_id, trace, 'anomalous', '' FROM anm WHERE part = 'train'""")
TEST = [
    *SET,
    f"""te AS (SELECT model_id, concat_ws('/', model_id, 'normal', {h(q('trace'), sized('t'))}) AS row_id, trace, 'normal' AS label, '' AS raw_cause, '' AS cause FROM nt WHERE part = 'test'
    UNION ALL SELECT model_id, concat_ws('/', case_id, kind, round), trace, 'anomalous', anomaly, cause FROM anm
        WHERE part = 'test' AND {below('10', *WHO, q('test'))} = 0)""",
]
put("test_set", *TEST, select="SELECT model_id, trace, label, raw_cause, '' AS cause FROM te")
put("test_cause", *TEST, select="SELECT model_id, trace, label, raw_cause, cause FROM te WHERE label = 'anomalous'")


def phrase(values, part: str) -> str:
    return f"([{words(values)}])[1 + {below(str(len(values)), 'row_id', q(part))}]"


PROMPT = f"""
pr AS (SELECT *, {phrase(OPENINGS, 'opening')} || {phrase(SEPARATED_BY, 'separated')} || ' ' || trace || '. Is this trace normal or anomalous?' AS qn,
    ' \\n The trace is ' || label || '.' AS an, ' \\n ' || {phrase(ASK_CAUSE, 'ask')} AS ak FROM te)
"""
put("prompts", *TEST, PROMPT, select="""SELECT row_id, CASE WHEN cause <> '' THEN qn || an || ak ELSE qn END AS prompt,
    CASE WHEN cause <> '' THEN qn || an || ak || ' \\n ' || cause || '</s>' ELSE qn || an || '</s>' END AS prompt_all FROM pr""")
put("shuffle", *TEST, select=f"SELECT row_id, row_number() OVER (ORDER BY {h(q('shuffle'), 'row_id')}) AS rank FROM te")
put("first_rows", *TEST, select=f"SELECT row_id, trace, label FROM te ORDER BY row_id LIMIT {c.FIRST_ROWS}")
ANSWERS = [
    *TEST,
    f"""rs0 AS (SELECT *, {below('20', 'row_id', q('response'))} AS dr, string_split(cause, ' ') AS ws FROM te),
    rs AS (SELECT *, CASE WHEN dr = 4 THEN ' \\n No answer.' ELSE ' \\n The trace is ' || CASE WHEN dr < 3 THEN
        CASE WHEN label = 'normal' THEN 'anomalous' ELSE 'normal' END WHEN dr = 3 THEN 'strange' ELSE label END || '.</s>' END AS response,
        CASE WHEN dr = 4 THEN 'no answer' ELSE ' \\n ' || array_to_string(CASE WHEN dr < 8 THEN
        list_filter(ws, lambda w, i: {d('row_id', q('word'), '(i - 1)')} % 5 > 0) ELSE ws END, ' ') || '</s>' END AS cause_response FROM rs0),
    pv AS (SELECT *, regexp_extract(response, 'The trace is (.*?)\\.</s>', 1) AS said, regexp_extract(cause_response, '\\\\n (.*?)</s>', 1) AS stated FROM rs),
    pw AS (SELECT *, CASE WHEN said IN ('normal', 'anomalous') THEN said ELSE 'normal' END AS verdict FROM pv)""",
]
put("parse_verdict", *ANSWERS, select="SELECT row_id, said, verdict FROM pw")
put("parse_cause", *ANSWERS, select="SELECT row_id, stated FROM pw WHERE label = 'anomalous'")
put("followup", *ANSWERS, select=f"""SELECT row_id, 'first' AS turn, replace({q(FIXED_QUESTION)}, '%s', trace) AS prompt FROM pw
    UNION ALL SELECT row_id, 'second', replace({q(FOLLOW_UP)}, '%s', trace) FROM pw WHERE said = 'anomalous'""")
put("binary_metrics", *ANSWERS, """bm AS (SELECT count(*) FILTER (label = 'anomalous' AND verdict = 'anomalous') AS tp,
    count(*) FILTER (label <> 'anomalous' AND verdict = 'anomalous') AS fp, count(*) FILTER (label = 'anomalous' AND verdict <> 'anomalous') AS fn,
    count(*) FILTER (label <> 'anomalous' AND verdict <> 'anomalous') AS tn FROM pw)""", select="""SELECT
    round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
    round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS accuracy,
    tp + fn AS num_anomalous, fp + tn AS num_normal, tp + fp AS det_anomalous, fn + tn AS det_normal FROM bm""")
ROUGE = [
    *ANSWERS,
    """rw AS (SELECT row_id, list_filter(regexp_split_to_array(trim(stated), '\\s+'), lambda w: w <> '') AS hw,
        list_filter(regexp_split_to_array(trim(cause), '\\s+'), lambda w: w <> '') AS fw FROM pw WHERE label = 'anomalous')""",
]
MEANS = """SELECT round(avg(p), 6) AS {0}_p, round(avg(r), 6) AS {0}_r, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS {0}_f FROM sc"""
put("rouge2", *ROUGE, """rg AS (SELECT row_id, list_distinct([hw[i] || ' ' || hw[i + 1] for i in range(1, len(hw))]) AS hb,
    list_distinct([fw[i] || ' ' || fw[i + 1] for i in range(1, len(fw))]) AS fb FROM rw),
    sc AS (SELECT coalesce(len(list_intersect(hb, fb))::DOUBLE / nullif(len(hb), 0), 0) AS p, coalesce(len(list_intersect(hb, fb))::DOUBLE / nullif(len(fb), 0), 0) AS r FROM rg)""",
    select=MEANS.format("rouge2"))
put(
    "rougeL", *ROUGE,
    # One step per word of the hypothesis; row holds the lengths for the first j words of the reference.
    """lc AS (SELECT row_id, hw, fw, 0 AS i, list_transform(range(0, len(fw) + 1), lambda x: 0::BIGINT) AS row FROM rw
    UNION ALL SELECT row_id, hw, fw, i + 1, list_reduce(list_prepend([0::BIGINT], [[CASE WHEN fw[j] = hw[i + 1] THEN row[j] + 1 ELSE row[j + 1] END] for j in range(1, len(fw) + 1)]),
        lambda done, cell: done || [greatest(done[-1], cell[1])]) FROM lc WHERE i < len(hw)),
    ll AS (SELECT row_id, hw, fw, row[-1] AS l FROM lc WHERE i = len(hw)),
    sc AS (SELECT coalesce(l::DOUBLE / nullif(len(hw), 0), 0) AS p, coalesce(l::DOUBLE / nullif(len(fw), 0), 0) AS r FROM ll)""",
    select=MEANS.format("rougeL"),
)
CURVE = """
lb AS (SELECT lang, n_chars AS score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg
    FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS fl, sum(pos) OVER (PARTITION BY lang) AS n1 FROM lb WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
pr AS (SELECT *, tp::DOUBLE / fl AS p, coalesce(tp::DOUBLE / nullif(n1, 0), 0) AS r FROM cv),
pf AS (SELECT *, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 12) ELSE 0 END AS f1 FROM pr)
"""
put("best_prf", CURVE, select="""SELECT lang, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, score FROM pf
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score) = 1""")
put("aupr", CURVE, select="SELECT lang, round(sum(p * coalesce(pos::DOUBLE / nullif(n1, 0), 0)), 9) AS aupr FROM pf GROUP BY lang")

# --- process models ------------------------------------------------------------------------

DOCS = f"""
dm AS (SELECT case_id AS model_id, pos, n, part, activity AS act, lane, case_id::BIGINT AS key,
    CASE WHEN pos % 4 = 0 THEN '' ELSE 'Handle' || chr(10) || 'Part' || activity || ' ' || part END AS label,
    CASE activity WHEN 'RF' THEN 'Exclusive_Databased_Gateway' WHEN 'RO' THEN 'IntermediateTimerEvent' ELSE 'Task' END AS stencil FROM ol)
"""
put("model_csv", ORDERS, DOCS, select=f"""SELECT model_id, 'order ' || model_id AS name, 'Model' AS type,
    CASE WHEN key % 10 = 0 THEN 'http://b3mn.org/stencilset/epc#' ELSE {q(BPMN2)} END AS namespace, count(DISTINCT lane) + any_value(n) - 1 AS num_children FROM dm GROUP BY model_id, key""")
put("model_dir", ORDERS, DOCS, select="SELECT DISTINCT model_id, 'bpmn20' AS modeling_language, 'root' || model_id AS root FROM dm WHERE key % 4 <> 0 AND key % 3 <> 0")
put("elements", ORDERS, DOCS, select="""
    SELECT model_id, 'order ' || model_id AS name, 'n' || pos AS element_id, stencil AS category, label,
        CASE WHEN pos % 3 = 0 THEN part::VARCHAR END AS glossary_link_id, 'lane' || lane AS parent, CASE WHEN pos < n THEN 'f' || pos ELSE '' END AS outgoing FROM dm WHERE key % 10 <> 0
    UNION ALL SELECT model_id, 'order ' || model_id, 'f' || pos, 'SequenceFlow', '', NULL, 'root' || model_id, 'n' || (pos + 1) FROM dm WHERE key % 10 <> 0 AND pos < n
    UNION ALL SELECT DISTINCT model_id, 'order ' || model_id, 'lane' || lane, 'Lane', lane, NULL, 'root' || model_id, '' FROM dm WHERE key % 10 <> 0""")
put("edges", ORDERS, DOCS, select="""SELECT model_id, 'n' || pos AS src, 'f' || pos AS dst FROM dm WHERE pos < n
    UNION ALL SELECT model_id, 'f' || pos, 'n' || (pos + 1) FROM dm WHERE pos < n""")
# Task labels: the number goes, a second blank comes in before the capital P and one before the flags.
put("nodes", ORDERS, DOCS, select="""SELECT model_id, 'n' || pos AS id, stencil,
        CASE WHEN label = '' THEN stencil WHEN stencil = 'Task' THEN 'handle  part ' || lower(act)
        ELSE stencil || ' (' || replace(label, chr(10), ' ') || ')' END AS label, CASE WHEN stencil = 'Task' AND label <> '' THEN 1 ELSE 0 END AS is_task FROM dm
    UNION ALL SELECT model_id, 'f' || pos, 'SequenceFlow', 'SequenceFlow', 0 FROM dm WHERE pos < n
    UNION ALL SELECT DISTINCT model_id, 'lane' || lane, 'Lane', 'Lane (' || lane || ')', 0 FROM dm""")

ELEMENTS = """
el AS (SELECT case_id AS model_id, 'e' || pos AS element_id, p_type AS name, CASE activity WHEN 'AF' THEN 'StartNoneEvent' WHEN 'AO' THEN 'StartMessageEvent'
    WHEN 'RF' THEN 'Task' WHEN 'RO' THEN 'Subprocess' WHEN 'NF' THEN 'EndNoneEvent' ELSE 'Exclusive_Databased_Gateway' END AS category,
    CASE WHEN pos % 5 = 0 THEN NULL WHEN pos % 4 = 0 THEN 'A' ELSE p_name END AS label FROM ol JOIN part ON p_partkey = ol.part)
"""
EXAMPLES = words(c.EXAMPLE_TYPES)
put("drop_examples", ORDERS, ELEMENTS, select=f"""SELECT model_id, element_id, name FROM el
    WHERE model_id IN (SELECT model_id FROM el GROUP BY model_id HAVING bool_or(name NOT IN ({EXAMPLES})))""")
put("drop_example_rows", ORDERS, ELEMENTS, select=f"SELECT name, count(*) AS num_rows FROM el WHERE name NOT IN ({EXAMPLES}) GROUP BY name")
NOTATIONS = "nn AS (SELECT CASE WHEN p_brand = 'Brand#1' THEN 'Other' ELSE p_brand END AS notation, count(*) AS frequency FROM part GROUP BY 1)"
put("topn_notation", NOTATIONS, select=f"SELECT notation, frequency FROM nn WHERE notation <> 'Other' ORDER BY frequency DESC, notation LIMIT {c.TOP_NOTATIONS}")
put("fold_other", NOTATIONS, select=f"SELECT CASE WHEN frequency < {c.RARE_BELOW} THEN 'Other' ELSE notation END AS notation, sum(frequency)::BIGINT AS frequency FROM nn GROUP BY 1")
put("filter_models", ORDERS, ELEMENTS, select=f"""SELECT model_id, element_id, category FROM el WHERE model_id IN (SELECT model_id FROM el GROUP BY model_id HAVING count(*) >= 4
    AND bool_or(category IN ({words(START_CATEGORIES)})) AND bool_or(category IN ({words(TASK_CATEGORIES)})) AND bool_or(category IN ({words(END_CATEGORIES)})))""")
put("model_text", ORDERS, ELEMENTS, select="""SELECT model_id, name, trim(array_to_string(list(label ORDER BY label), ' ')) AS label
    FROM (SELECT DISTINCT model_id, name, coalesce(label, '') AS label FROM el) GROUP BY model_id, name""")
put("meaningful", ORDERS, ELEMENTS, select="SELECT model_id, round(avg(length(label)), 9) AS mean_length FROM el GROUP BY model_id HAVING avg(length(label)) > 5")
CAMEL = "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], '')"
PARTS = f"""
pl AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN {CAMEL} || '(s) #' || p_size || chr(10) || ' x ' || lower(p_type) WHEN 2 THEN p_size::VARCHAR
    WHEN 3 THEN 'Task' WHEN 4 THEN 'Exclusive Gateway ' || p_brand WHEN 5 THEN '' WHEN 6 THEN 'Subprocess ' || p_name END AS label FROM part)
"""
put(
    "labels_norm", PARTS,
    "l1 AS (SELECT regexp_replace(replace(replace(label, chr(10), ' '), '(s)', 's'), '[^a-zA-Z]', ' ', 'g') AS x FROM pl WHERE label IS NOT NULL)",
    "l2 AS (SELECT array_to_string(list_filter(string_split(x, ' '), lambda w: length(w) > 1), ' ') AS x FROM l1)",
    "l3 AS (SELECT lower(regexp_replace(regexp_replace(x, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS norm FROM l2)",
    select="SELECT norm, count(*) AS num FROM l3 GROUP BY norm",
)
put("label_words", select="""SELECT regexp_replace(w, 'ise$', 'ize') AS word, count(*) AS num
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]')) AS w FROM documents) GROUP BY 1""")
put("relevant", PARTS, select="""SELECT p_partkey, CASE WHEN label IS NULL THEN 1 WHEN label = '' OR regexp_matches(label, '^[0-9]+$') OR lower(label) IN ('message', 'task')
    OR contains(label, 'Gateway') OR starts_with(label, 'EventSubprocess') OR starts_with(label, 'Subprocess') THEN 0 ELSE 1 END AS relevant,
    trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label FROM pl""")

# --- graphs --------------------------------------------------------------------------------

GRAPH = """
gl AS (SELECT case_id AS model_id, pos AS p, n, activity AS act, part FROM ol),
ga AS (SELECT model_id, p, 'f' || p AS id, 'SequenceFlow' AS label, 'n' || (p + 1) AS dst FROM gl WHERE p < n AND p % 5 <> 0
    UNION ALL SELECT model_id, p, 's' || p, 'SequenceFlow', 'n' || (p + 2) FROM gl WHERE p % 3 = 1 AND p + 2 <= n
    UNION ALL SELECT model_id, p, 'm' || p, 'MessageFlow', 'n' || (p + 3) FROM gl WHERE p % 4 = 2 AND p + 3 <= n
    UNION ALL SELECT model_id, p, 'b' || p, 'SequenceFlow', 'n' || (p - 1) FROM gl WHERE p % 6 = 0),
ge AS (SELECT model_id, 'n' || p AS src, id AS dst FROM ga UNION ALL SELECT model_id, id, dst FROM ga
    UNION ALL SELECT model_id, 'n' || p, 'n' || (p + 1) FROM gl WHERE p < n AND p % 5 = 0),
gn AS (SELECT model_id, 'n' || p AS id, CASE WHEN p = 1 THEN 'StartNoneEvent' WHEN p = n THEN 'EndNoneEvent'
    WHEN act IN ('AF', 'AO', 'NO') THEN 'handle ' || lower(act) || ' ' || (part % 7) WHEN act = 'RF' THEN 'Exclusive_Databased_Gateway'
    WHEN act = 'RO' THEN 'ParallelGateway' ELSE 'IntermediateTimerEvent' END AS label,
    CASE WHEN p > 1 AND p < n AND act IN ('AF', 'AO', 'NO') THEN 1 ELSE 0 END AS is_task FROM gl
    UNION ALL SELECT model_id, id, label, 0 FROM ga UNION ALL SELECT model_id, 'd0', 'DataObject', 0 FROM gl WHERE p = 1),
gx AS (SELECT ge.*, a.label AS sl, b.label AS dl FROM ge JOIN gn a ON a.model_id = ge.model_id AND a.id = ge.src JOIN gn b ON b.model_id = ge.model_id AND b.id = ge.dst),
su AS (SELECT model_id, src, dst FROM gx WHERE NOT starts_with(dl, 'SequenceFlow') AND NOT starts_with(dl, 'MessageFlow')
    UNION SELECT x.model_id, x.src, y.dst FROM gx x JOIN gx y ON y.model_id = x.model_id AND y.src = x.dst WHERE starts_with(x.dl, 'SequenceFlow')),
pe AS (SELECT model_id, dst, src FROM gx WHERE NOT starts_with(sl, 'SequenceFlow') AND NOT starts_with(sl, 'MessageFlow') AND src <> dst
    UNION SELECT y.model_id, y.dst, x.src FROM gx x JOIN gx y ON y.model_id = x.model_id AND y.src = x.dst WHERE starts_with(y.sl, 'SequenceFlow') AND x.src <> x.dst)
"""
SHAPES = " AND ".join(f"NOT starts_with(label, '{w}')" for w in NOT_A_SHAPE)
ENDS = f"""
so AS (SELECT model_id, id FROM gn WHERE {SHAPES} AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.model_id = gn.model_id AND pe.dst = gn.id)),
si AS (SELECT model_id, id FROM gn WHERE {SHAPES} AND NOT EXISTS (SELECT 1 FROM su WHERE su.model_id = gn.model_id AND su.src = gn.id))
"""
put("succ", ORDERS, GRAPH, select="SELECT model_id, src, dst FROM su")
put("pred", ORDERS, GRAPH, select="SELECT model_id, dst, src FROM pe")
put("sources_sinks", ORDERS, GRAPH, ENDS, select="SELECT model_id, id, 'source' AS side FROM so UNION ALL SELECT model_id, id, 'sink' FROM si")
put("reach", ORDERS, GRAPH,
    "re AS (SELECT model_id, src, dst FROM su UNION SELECT re.model_id, re.src, su.dst FROM re JOIN su ON su.model_id = re.model_id AND su.src = re.dst)",
    select="SELECT model_id, src, dst FROM re")
PATHS = """
wk AS (SELECT model_id, [id] AS path, id AS last FROM so
    UNION ALL SELECT wk.model_id, list_append(path, su.dst), su.dst FROM wk JOIN su ON su.model_id = wk.model_id AND su.src = wk.last AND NOT list_contains(path, su.dst)),
wp AS (SELECT model_id, path, last FROM wk WHERE len(path) > 1 AND EXISTS (SELECT 1 FROM si WHERE si.model_id = wk.model_id AND si.id = wk.last)),
pp AS (SELECT model_id, path FROM wp WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.model_id = wp.model_id AND su.dst = wp.last AND list_contains(wp.path[:len(wp.path) - 2], su.src)))
"""
put("paths", ORDERS, GRAPH, ENDS, PATHS, select=f"SELECT model_id, {text('path', '>')} AS path FROM pp")
put("task_paths", ORDERS, GRAPH, ENDS, PATHS,
    "ps AS (SELECT model_id, path, unnest(path) AS id, unnest(range(1, len(path) + 1)) AS i FROM pp)",
    "pt AS (SELECT ps.model_id, path, list(label ORDER BY i) AS tasks FROM ps JOIN gn ON gn.model_id = ps.model_id AND gn.id = ps.id AND is_task = 1 GROUP BY ps.model_id, path)",
    select=f"SELECT DISTINCT model_id, {text('tasks', '>')} AS tasks FROM pt")
KIND = f"""
gk AS (SELECT *, string_split(label, ' ')[1] AS w FROM gn),
kd AS (SELECT *, CASE WHEN regexp_matches(w, '(Event|EventCatching|EventThrowing)$') THEN 'Event' WHEN w LIKE '%Gateway' THEN 'Gateway'
    WHEN w NOT IN ({words(IRRELEVANT)}) THEN 'Task' ELSE w END AS kind, CASE WHEN w IN ({words(IRRELEVANT)}) THEN 0 ELSE 1 END AS relevant FROM gk)
"""
put("node_kind", ORDERS, GRAPH, KIND, select="""SELECT model_id, id, kind, CASE WHEN regexp_matches(label, '^(Exclusive|Inclusive|Eventbased)') THEN 1 ELSE 0 END AS choice,
    relevant FROM kd""")
put("implicit_joins", ORDERS, GRAPH, KIND, select="""SELECT t.model_id, t.id, count(*) AS num_pred FROM kd t JOIN pe ON pe.model_id = t.model_id AND pe.dst = t.id
    JOIN kd s ON s.model_id = pe.model_id AND s.id = pe.src WHERE t.kind = 'Task' AND s.relevant = 1 GROUP BY t.model_id, t.id HAVING count(*) > 1""")
put("branches_graph", ORDERS, GRAPH, """
sp AS (SELECT model_id, id AS s FROM gn WHERE regexp_matches(label, '^(Exclusive|Inclusive|Eventbased)')
    AND (SELECT count(*) FROM su WHERE su.model_id = gn.model_id AND su.src = gn.id) > 1),
rc AS (SELECT model_id, s, s AS v FROM sp UNION SELECT rc.model_id, rc.s, su.dst FROM rc JOIN su ON su.model_id = rc.model_id AND su.src = rc.v),
en AS (SELECT * FROM rc WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.model_id = rc.model_id AND su.src = rc.v)),
av AS (SELECT model_id, s, v AS d, s AS v FROM rc WHERE v <> s
    UNION SELECT av.model_id, av.s, av.d, su.dst FROM av JOIN su ON su.model_id = av.model_id AND su.src = av.v AND su.dst <> av.d),
pd AS (SELECT DISTINCT av.model_id, av.s, av.d FROM av JOIN en USING (model_id, s)
    EXCEPT SELECT av.model_id, av.s, av.d FROM av JOIN en ON en.model_id = av.model_id AND en.s = av.s AND en.v = av.v),
jn AS (SELECT * FROM pd EXCEPT SELECT av.model_id, av.s, av.d FROM av JOIN pd o ON o.model_id = av.model_id AND o.s = av.s AND o.d = av.v),
wy AS (SELECT sp.model_id, sp.s, row_number() OVER (PARTITION BY sp.model_id, sp.s ORDER BY dst) - 1 AS b, dst AS way, d AS j
    FROM sp JOIN su ON su.model_id = sp.model_id AND su.src = sp.s LEFT JOIN jn ON jn.model_id = sp.model_id AND jn.s = sp.s),
br AS (SELECT model_id, s, j, b, way AS v FROM wy WHERE way <> s AND way IS DISTINCT FROM j
    UNION SELECT br.model_id, s, j, b, su.dst FROM br JOIN su ON su.model_id = br.model_id AND su.src = br.v AND su.dst <> s AND su.dst IS DISTINCT FROM j)""",
    select="""SELECT DISTINCT br.model_id, s AS xor_id, b::INT AS branch_id, label AS activity FROM br
    JOIN gn ON gn.model_id = br.model_id AND gn.id = br.v WHERE is_task = 1""")
