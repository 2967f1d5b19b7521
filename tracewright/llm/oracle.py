"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing
from .divergence import MIN_DOCS, TOP
from .ngram_join import WORDS as WIDTH
from .quality_rules import MIN_ROWS, MOST, QUANTILES, SPREAD, UNITS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
}
_ratio = {k: f"case when {b} > 0 then {a} * 1000 // {b} else 0 end" for k, (a, b) in RATIOS.items()}


def _quantiles(name: str, keys: str) -> str:
    """Quantiles from bucket counts summed by ``keys`` and rule."""
    by = f"{keys}, rule" if keys else "rule"
    at = ", ".join(f"min(case when upto * 20 >= n * {q} then top end) {name}" for name, q in QUANTILES.items())
    return f"""
{name}_merged as (select {by}, b, sum(c) c from sketch group by {by}, b),
{name}_upto as (
  select *, sum(c) over (partition by {by} order by b) upto, sum(c) over (partition by {by}) n,
    case when b < 16 then b else ((b % 16 + 17) << (b // 16 - 1)::int) - 1 end top
  from {name}_merged),
{name} as (select {by}, max(n) n, {at} from {name}_upto group by {by})"""


def _merged(q: str) -> str:
    return f"case when l.n >= {MIN_ROWS} then l.{q} else e.{q} end"


QUALITY = f"""
with split as (
  select doc_id, lang, source, coalesce(text, '') t, {WORDS} ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls
  from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from split),
windows as (select doc_id, i, count(*) over (partition by doc_id, list_slice(ws, i, i + 2)) n from places),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from windows where n > 1) group by doc_id),
counts as (
  select s.doc_id, lang, source, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines
  from split s left join covered c on s.doc_id = c.doc_id),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from counts),
long as (
  {" union all ".join(f"select lang, source, '{k}' rule, {v} x from based where not base_failed" for k, v in _ratio.items())}),
sketch as (
  select lang, source, rule, case when x < 16 then x else (length(bin(x)) - 5) * 16 + (x >> (length(bin(x)) - 5)::int) end b, count(*) c
  from long group by all),{_quantiles("own", "lang, source")},{_quantiles("langs", "lang")},{_quantiles("everything", "")},
picked as (
  select o.lang, o.source, o.rule, least_unit, most_unit, most, {_merged("q95")} - {_merged("q50")} above, {_merged("q50")} - {_merged("q05")} below,
    {", ".join(f"case when o.n >= {MIN_ROWS} then o.{q} else {_merged(q)} end {q}" for q in ("q25", "q50", "q75"))}
  from own o join langs l on o.lang is not distinct from l.lang and o.rule = l.rule join everything e on o.rule = e.rule
  join (values {", ".join(f"('{k}', {a}, {b}, {MOST.get(k, 'null')})" for k, (a, b) in UNITS.items())}) v(rule, least_unit, most_unit, most) on o.rule = v.rule),
bounds as (
  select lang, source, rule,
    case when rule = 'word_length' then q50 - {SPREAD} * greatest(least(q75 - q50, q50 - q25), least(greatest(below, least_unit), most_unit)) else 0 end low,
    least(q50 + {SPREAD} * greatest(least(q75 - q50, q50 - q25), least(greatest(above, least_unit), most_unit)), most) high
  from picked),
failures as (
  select distinct d.doc_id from (
    {" union all ".join(f"select doc_id, lang, source, '{k}' rule, {v} x from based" for k, v in _ratio.items())}) d
  join bounds b on d.lang is not distinct from b.lang and d.source is not distinct from b.source and d.rule = b.rule
  where x not between low and high)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from failures) kept
from based"""

MIX = f"""
with rows as (select doc_id, source, len({WORDS})::bigint size, md5(doc_id::varchar) h from documents),
sizes as (select source, sum(size)::bigint source_size from rows group by source),
weighed as (
  select *, ({list(map(float, mixing.WEIGHTS))})[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int]::double w,
    {float(mixing.MOST)}::double * source_size cap, row_number() over (order by source nulls last) no, sum(source_size) over ()::double * {mixing.TIMES}::double total
  from sizes),
levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / w, no rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, no rows between current row and unbounded following) level
  from weighed),
line as (select arg_min(level, [cap / w, no]) line from levels where level * w <= cap),
goals as (select source, source_size, least(cap, coalesce(line * w, cap)) target from levels, line),
placed as (
  select r.*, source_size, target, round(target)::bigint goal,
    sum(size) over (partition by r.source order by h, doc_id, size rows unbounded preceding)::bigint e
  from rows r join goals g on r.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (greatest(least(e, goal) - (e - size), 0) + greatest(least(source_size + e, goal) - (source_size + e - size), 0))::bigint taken
from placed"""

JOIN = f"""
with recursive worded as (select doc_id, array_to_string({WORDS}, ' ') t, {WORDS} ws from documents),
classes as (select min(doc_id) id, count(*) size, t, any_value(ws) ws from worded where len(ws) > 0 group by t),
grams as (
  select distinct id, g from (
    select id, unnest(case when len(ws) < {WIDTH} then [t]
      else list_transform(range(1, len(ws) - {WIDTH} + 2), lambda i: array_to_string(list_slice(ws, i, i + {WIDTH} - 1), ' ')) end) g
    from classes)),
sizes as (select id, count(*) n from grams group by id),
shared as (select a.id x, b.id y, count(*) c from grams a join grams b on a.g = b.g and a.id <> b.id group by a.id, b.id),
links as (select x, y from shared join sizes p on p.id = x join sizes q on q.id = y where 5 * c >= 4 * (p.n + q.n - c)),
reach(id, root) as (select id, id from classes union select links.x, root from reach join links on links.y = reach.id),
roots as (select id, min(root) class_id from reach group by id),
others as (select x id, sum(size) n from links join classes on classes.id = y group by x)
select w.doc_id, coalesce(class_id, w.doc_id) class_id, (coalesce(c.size - 1, 0) + coalesce(o.n, 0))::bigint n_links, coalesce(c.id, w.doc_id) copy_id
from worded w left join classes c on w.t = c.t and len(w.ws) > 0 left join roots on roots.id = c.id left join others o on o.id = c.id"""

DIVERGENCE = rf"""
with docs as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents),
terms as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
kept as (select lang, term, count(*) lang_occurs from terms group by all having count(distinct r) >= {MIN_DOCS}),
counts as (select lang, source, term, count(*) occurs from terms group by all),
sizes as (select lang, count(*) v, sum(lang_occurs) lang_n from kept group by lang),
groups as (
  select g.lang, g.source, coalesce(any_value(v), 0) v, coalesce(any_value(lang_n), 0) lang_n, coalesce(sum(occurs) filter (k.term is not null), 0) n
  from (select distinct lang, source from docs) g left join sizes s on s.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source left join kept k on k.lang = c.lang and k.term = c.term
  group by g.lang, g.source),
grid as (
  select g.lang, g.source, k.term, coalesce(c.occurs, 0) occurs, 1 + (1000000000::hugeint * (coalesce(c.occurs, 0) + 2)) // (n + 2 * v)::hugeint p,
    1 + (1000000000::hugeint * (lang_occurs + 2)) // (lang_n + 2 * v)::hugeint q
  from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint value
  from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
told as (
  select g.lang, g.source, 'pair' part, o.source item, coalesce(value, 0) value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join pairs p on p.lang = g.lang and p.source = g.source and p.item = o.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from grid where occurs > 0 and p > q)
select * from (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from told)
where part = 'pair' or rank <= {TOP}"""

ORACLE = {"op5_mixing": MIX, "op7_ngram_join": JOIN, "op8_quality_rules": QUALITY, "op12_divergence": DIVERGENCE}
