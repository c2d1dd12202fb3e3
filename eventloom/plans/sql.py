"""SQL for the named queries, for an independent engine over the same tables."""

from __future__ import annotations

from eventloom.model import LOG_FEATURES, EventLogSpec

_TYPES = ("click", "error", "purchase", "signup", "view")


def _events(spec: EventLogSpec, table: str, by: str = "0") -> str:
    order = ", ".join(f"{c} as o{i}" for i, c in enumerate(spec.order))
    return f"select {by} as id, {spec.case} as c, {spec.activity} as a, {spec.timestamp or 'null::timestamp'} as t, {order} from {table}"


def _orders(spec: EventLogSpec) -> str:
    return ", ".join(f"o{i}" for i in range(len(spec.order)))


def _features(spec: EventLogSpec, source: str, by_time: bool = True) -> str:
    """CTE bodies f_case, f_all, f_edge and f: the features per log ``id`` of the events in ``source``."""
    o = _orders(spec)
    order = f"t nulls last, {o}" if by_time else o
    return f"""
    f_case as (select id, c, count(*) n, list(a order by {order}) tr, count(distinct (a, 1)) d from {source} where c is not null group by id, c),
    f_all as (select id, count(distinct a) acts, count(*) total from {source} group by id),
    f_edge as (select id, count(distinct (a, nx)) edges from (
        select id, a, lead(a) over w nx, lead(1) over w more from {source} where c is not null window w as (partition by id, c order by t nulls last, {o})
      ) where more is not null group by id),
    f as (select k.id, count(*) unique_case_count, any_value(acts) unique_activity_count, avg(n) avg_events_per_case,
            count(distinct tr) variant_count, avg(d) avg_unique_acts_per_trace,
            any_value(coalesce(edges, 0)) / (any_value(acts) * any_value(acts)) dfg_density, any_value(total) total_event_count
          from f_case k join f_all using (id) left join f_edge using (id) group by k.id)"""


def _rounded_features(prefix: str = "") -> str:
    whole = {"unique_case_count", "unique_activity_count", "variant_count"}
    return ", ".join(f"{prefix}{c}" if c in whole else f"round({prefix}{c}, 6) as {c}" for c in LOG_FEATURES)


def _statistics(spec: EventLogSpec, table: str) -> str:
    density = "round((select dfg_density from f), 6)" if spec.timestamp else "null::double"
    return f"""with e as ({_events(spec, table)}), {_features(spec, "e", by_time=False)}
    select unique_case_count as num_cases, unique_activity_count as num_activities, variant_count as num_variants,
      round(avg_events_per_case, 6) as avg_trace_length, round(variant_count / unique_case_count, 6) as variant_ratio,
      round(avg_events_per_case / unique_activity_count, 6) as avg_events_per_case_ratio, {density} as dfg_density,
      round(unique_activity_count / total_event_count, 6) as uniqueness from f"""


def _validated(spec: EventLogSpec, table: str) -> str:
    o = _orders(spec)
    return f"""with e as ({_events(spec, table)}),
    s as (select c, count(*) n, count(distinct (a, 1)) d from e where c is not null group by c),
    dd as (select * from e qualify row_number() over (partition by c, t order by {o}) = 1),
    v as (select dd.* from dd semi join (select c from s where n > 1 and d > 1) g on dd.c = g.c),
    {_features(spec, "v")}
    select {_rounded_features()}, (select round(avg((n > 1 and d > 1)::int), 6) from s) as valid_share from f"""


def _wide() -> str:
    return "wide as (select user_id, " + ", ".join(f"min(ts) filter (where event_type = '{t}') as {t}" for t in _TYPES) + " from events group by user_id)"


def _cells(source: str, columns: list[str], cast: str = "::varchar") -> str:
    return " union all ".join(f"select '{c}' as col, {c}{cast} as v from {source}" for c in columns)


def _profile(cells: str) -> str:
    """CTE bodies cells, vc and p: the profile of each column."""
    return f"""cells as ({cells}),
    sz as (select col, count(*) n_rows, count(v) non_null from cells group by col),
    vc as (select col, v, count(*) n from cells where v is not null group by col, v),
    p as (select col, any_value(n_rows) n_rows, any_value(non_null) non_null, count(*) n_unique, max(n) / any_value(n_rows) max_freq,
        -sum(n / non_null * log2(n / non_null + 1e-9)) entropy, max(length(v)) max_length,
        sqrt(greatest(sum(n * length(v) * length(v)) / any_value(non_null) - power(sum(n * length(v)) / any_value(non_null), 2), 0)) std_length,
        coalesce(sum(n) filter (where len(list_filter(string_split_regex(trim(v), '\\s+'), lambda x: x <> '')) > 6), 0) / any_value(n_rows) long_share,
        count(*) / any_value(n_rows) n_unique_ratio
      from vc join sz using (col) group by col)"""


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]

_TEXTS = """texts as (select event_id, event_type as kind, strftime(ts, '%Y-%m-%d %H:%M:%S') as changed, strftime(ts, '%-d/%-m/%Y') as day_first,
  epoch(ts)::bigint::varchar as unix_time, epoch(ts)::bigint::varchar as phone, event_id || ' days 02:03:04' as duration,
  strftime(ts, '%A') as weekday, case when event_id % 2 = 0 then '1' else '1.5' end as amount,
  case when event_id % 5 <> 0 then event_type end as sparse,
  case when event_id between 30 and 49 then event_id || ' days 02:03:04' else event_type || (event_id % 3) end as late, 'r' || (event_id % 9) as remark_code from events)"""
_TEXT_COLUMNS = ["kind", "changed", "day_first", "unix_time", "phone", "duration", "weekday", "amount", "sparse", "late", "remark_code"]
_TICKETS = """tickets as (select event_id, 'c' || (user_id % 60) as customer, event_type as status, strftime(ts, '%Y-%m-%d %H:%M:%S') as changed,
  event_id % 7 as seventh, event_id % 5 as remark_code from events)"""
_TICKET_COLUMNS = ["customer", "status", "changed", "seventh", "remark_code"]
_IS_TIME = """(case when regexp_full_match(v, '[0-9]{10}') then regexp_matches(col, 'unix|time|timestamp|epoch') and year(to_timestamp(try_cast(v as bigint))) between 2000 and 2050
  else length(v) >= 6 and coalesce(try_strptime(v, ['%Y-%m-%d %H:%M:%S', '%d/%m/%Y', '%m/%d/%Y']) is not null, false) end)"""

_RECOGNISED = f"""with {_TEXTS},
  cells as ({" union all ".join(f"select event_id, '{c}' as col, {c} as v from texts" for c in _TEXT_COLUMNS)}),
  s as (select *, row_number() over (partition by col order by event_id) r from cells where v is not null qualify r <= 50),
  k as (select *, case when try_cast(v as double) is null then 'str' when try_cast(v as double) = floor(try_cast(v as double)) then 'int' else 'float' end kind_of,
      (regexp_matches(v, '^-?[0-9]+\\s+days?\\s+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') or regexp_matches(lower(v), 'day|hour|minute|second|week|month|timedelta'))::int dur,
      {_IS_TIME}::int dt from s)
  select col as "column", count(distinct kind_of) as kinds, round(avg(dur), 6) as duration_share, round(avg(dt) filter (where r <= 30), 6) as datetime_share,
    max(length(v)) filter (where r = 1) as first_length, count(*) filter (where r <= 30 and contains(v, '-')) as dashes,
    count(*) filter (where r <= 30 and contains(v, ' ')) as spaces from k group by col"""



def _screening(table: str, columns: list[str]) -> str:
    """CTE bodies up to ``final``: which columns of ``table`` (in order of event_id) are timestamps (``ts``), and which may be a role (``kept``)."""
    cells = " union all ".join(f"select event_id, {i} as ord, '{c}' as col, {c}::varchar as v from {table}" for i, c in enumerate(columns))
    return f"""scells as ({cells}),
  s as (select *, row_number() over (partition by col order by event_id) r from scells where v is not null qualify r <= 50),
  k as (select col, count(distinct case when try_cast(v as double) is null then 'str' when try_cast(v as double) = floor(try_cast(v as double)) then 'int' else 'float' end) kinds,
      avg((regexp_matches(v, '^-?[0-9]+\\s+days?\\s+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') or regexp_matches(lower(v), 'day|hour|minute|second|week|month|timedelta'))::int) filter (where r <= 30) dur,
      avg({_IS_TIME}::int) filter (where r <= 30) dt, count(*) filter (where r <= 20) n_20, count(*) filter (where r <= 20 and {_IS_TIME}) dt_20,
      max(length(v)) filter (where r = 1) || '/' || count(*) filter (where r <= 30 and contains(v, '-')) || '/' || count(*) filter (where r <= 30 and contains(v, ' ')) sig from s group by col),
  whole as (select col, min(ord) ord, count(*) n, count(v) filled, count(distinct v) uniq, max(length(v)) longest, list(v order by event_id) vals,
      avg((len(list_filter(string_split_regex(trim(v), '\\s+'), lambda x: x <> '')) > 6)::int) wordy from scells group by col),
  raw as (select whole.*, k.* exclude (col), dur <= 0.3 and dt >= 0.6 as timelike from whole join k using (col)),
  grouped as (select *, count(*) filter (where timelike) over (partition by sig) as alike, min(ord) filter (where timelike) over (partition by sig) as seen,
      count(*) filter (where timelike) over () as times from raw),
  best as (select sig as best_sig from grouped where timelike order by alike desc, seen limit 1),
  told as (select *, timelike and (times < 3 or sig = (select best_sig from best)) as ts from grouped),
  final as (select f.*, not ts and dur <= 0.3 and filled >= 0.8 * n and uniq >= 3 and kinds <= 1 and longest < 100 and wordy < 0.1
      and not regexp_matches(lower(col), 'comment|note|description|remark|frequency')
      and not exists (select 1 from told g where g.ord < f.ord and g.vals = f.vals) as kept from told f)"""


_SCREENED = f"""with {_TEXTS}, {_screening("texts", _TEXT_COLUMNS)} select col as "column", ts as is_timestamp, kept from final"""

#: Formats of the patterns in which times are written, and how finely.
_WRITTEN = {
    "yyyy-MM-dd": ("%Y-%m-%d", "day"), "yyyy/MM/dd": ("%Y/%m/%d", "day"), "yyyy.MM.dd": ("%Y.%m.%d", "day"), "yyyyMMdd": ("%Y%m%d", "day"), "dd/MM/yyyy": ("%d/%m/%Y", "day"),
    "dd-MM-yyyy": ("%d-%m-%Y", "day"), "dd.MM.yyyy": ("%d.%m.%Y", "day"), "MMM d, yyyy": ("%b %-d, %Y", "day"), "d MMM yyyy": ("%-d %b %Y", "day"), "MMMM d, yyyy": ("%B %-d, %Y", "day"),
    "d MMMM yyyy": ("%-d %B %Y", "day"), "yyyy-MM-dd''T''HH:mm:ss": ("%Y-%m-%dT%H:%M:%S", "second"), "yyyy/MM/dd HH:mm:ss": ("%Y/%m/%d %H:%M:%S", "second"),
    "yyyy-MM-dd HH:mm": ("%Y-%m-%d %H:%M", "minute"), "yyyy/MM/dd HH:mm": ("%Y/%m/%d %H:%M", "minute"), "dd/MM/yyyy HH:mm": ("%d/%m/%Y %H:%M", "minute"),
    "dd/MM/yyyy HH:mm:ss": ("%d/%m/%Y %H:%M:%S", "second"), "dd.MM.yyyy HH:mm:ss": ("%d.%m.%Y %H:%M:%S", "second"), "yyyy-MM-dd''T''HH:mm:ss.SSSSSS": ("%Y-%m-%dT%H:%M:%S.%f", "microsecond"),
    "yyyy-MM-dd HH:mm:ss.SSSSSS": ("%Y-%m-%d %H:%M:%S.%f", "microsecond"), "yyyy-MM-dd''T''HH:mm:ssXXX": ("%Y-%m-%dT%H:%M:%SZ", "second"), "yyyy-MM-dd HH:mm:ssXXX": ("%Y-%m-%d %H:%M:%SZ", "second"),
}
_PARSED = " union all ".join(
    f"select '{p}' as pattern, count(try_strptime(strftime(ts, '{f}'), '{f}')) as recognised, sum(epoch_us(date_trunc('{unit}', ts)))::varchar as micros from events" for p, (f, unit) in _WRITTEN.items()
)

_RATIO = """(select list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j:
  {{k: list_max(list_filter(range(0, least({ahi} - i, {bhi} - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))), i: -i, j: -j}})))))"""


def _similarity(cells: str) -> str:
    """CTE bodies up to ``sims(col, sim)``: the mean ratio of matching blocks over pairs of the distinct values of ``cells(col, v)``.

    The longest common block, the first of equals, and then the same to its left and right.  Needs ``with recursive``.
    """
    first = _RATIO.format(alo="0", ahi="length(a)", blo="0", bhi="length(b)")
    inner = _RATIO.format(alo="nx.alo", ahi="nx.ahi", blo="nx.blo", bhi="nx.bhi")
    return f"""strs as (select distinct col, v as s from {cells} where v is not null),
    pr as (select x.col, x.s a, y.s b from strs x join strs y on x.col = y.col and x.s < y.s),
    seg as (select col, a, b, 0::bigint alo, length(a)::bigint ahi, 0::bigint blo, length(b)::bigint bhi, {first} m from pr
      union all
      select col, a, b, nx.alo, nx.ahi, nx.blo, nx.bhi, {inner} m from (
        select col, a, b, unnest([{{alo: alo, ahi: -m.i, blo: blo, bhi: -m.j}}, {{alo: m.k - m.i, ahi: ahi, blo: m.k - m.j, bhi: bhi}}]) nx from seg where m.k > 0
      ) where nx.ahi > nx.alo and nx.bhi > nx.blo),
    ratios as (select col, a, b, 2 * sum(m.k) / (any_value(length(a)) + any_value(length(b))) ratio from seg group by col, a, b),
    sims as (select col, coalesce(avg(ratio), 1) sim from (select distinct col from {cells}) left join ratios using (col) group by col)"""


def _scores(scale) -> str:
    """CTE body ``sc``: the scores of the columns profiled in ``pp`` (with ``sim``)."""
    return f"""sc as (select col, ord, 0.4 * u - 0.2 * (1 - f) + 0.2 * e - 0.2 * (1 - s) case_score, 0.3 * (1 - abs(u - 0.1)) + 0.2 * f - 0.2 * (1 - e) + 0.3 * s act_score
      from (select col, ord, {scale("n_unique_ratio")} u, {scale("max_freq")} f, {scale("entropy")} e, {scale("sim")} s from pp)),
    top as (select 'case' as role, row_number() over (order by round(case_score, 9) desc, ord) - 1 as place, col from sc
      union all select 'activity', row_number() over (order by round(act_score, 9) desc, ord) - 1, col from sc),
    pairs as (select c.col c, a.col a from top c join top a on c.col <> a.col where c.role = 'case' and a.role = 'activity' and c.place < 2 and a.place < 2)"""


def _novelty(events: EventLogSpec, orders: EventLogSpec) -> str:
    """CTEs up to ``d``: distances of new logs to known ones and ``dk`` among known ones, on z-scores."""
    stats = ", ".join(f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(LOG_FEATURES))
    scaled = ", ".join(f"({c} - m{i}) / case when s{i} = 0 then 1 else s{i} end as x{i}" for i, c in enumerate(LOG_FEATURES))
    apart = "sqrt(" + " + ".join(f"power(p.x{i} - q.x{i}, 2)" for i in range(len(LOG_FEATURES))) + ")"
    new = _features(events, "en")
    for name in ("f_case", "f_all", "f_edge"):
        new = new.replace(name, "n" + name)
    new = new.replace("    f as (select", "    fnew as (select")
    return f"""e as ({_events(orders, "orders", "o_custkey % 10")}), {_features(orders, "e")},
    en as ({_events(events, "events", "user_id % 3")}), {new},
    st as (select {stats} from f),
    known as (select id, {scaled} from f, st), points as (select id, {scaled} from fnew, st),
    d as (select p.id, q.id as other, {apart} as d from points p, known q),
    dk as (select p.id, q.id as other, {apart} as d from known p, known q where p.id <> q.id)"""


_LOF = """, ki as (select * from dk qualify row_number() over (partition by id order by d, other) <= 4),
    kd as (select id, max(d) kd from ki group by id),
    lrd as (select ki.id, 1 / (avg(greatest(ki.d, kd.kd)) + 1e-10) lrd from ki join kd on ki.other = kd.id group by ki.id),
    kn as (select * from d qualify row_number() over (partition by id order by d, other) <= 4),
    own as (select kn.id, 1 / (avg(greatest(kn.d, kd.kd)) + 1e-10) lrd from kn join kd on kn.other = kd.id group by kn.id),
    lof as (select kn.id, avg(lrd.lrd) / any_value(own.lrd) score from kn join lrd on kn.other = lrd.id join own on own.id = kn.id group by kn.id)"""


def oracles(events: EventLogSpec, orders: EventLogSpec, lineitem: EventLogSpec, conversations: EventLogSpec) -> dict[str, str]:
    e, o, li = _events(events, "events"), _events(orders, "orders"), _events(lineitem, "lineitem")
    pick = lambda body: f"with {_wide()} {body}"
    melted = " union all ".join(f"select user_id as \"case\", '{t}' as activity, epoch_us({t}) as micros from wide where {t} is not null" for t in _TYPES)
    profiled = f"with {_profile(_cells('orders', _PROFILED))}"
    named = "(values ('case:concept:name', 'case'), ('concept:name', 'activity'), ('seventh', 'irrelevant'), ('third', 'irrelevant')) c(col, label)"
    columns = [("user_id % 60", "case:concept:name", "case"), ("event_type", "concept:name", "activity"), ("event_id % 7", "seventh", "irrelevant"), ("event_id % 3", "third", "irrelevant")]
    labelled = lambda half, parts=2: " union all ".join(f"select '{label}/{name}{half}' as col, ({c})::varchar as v from events" + (f" where event_id % {parts} = {half}" if half else "") for c, name, label in columns)
    features = ", ".join(f"round({c}, 6) as {c}" for c in ("n_unique_ratio", "max_freq", "entropy", "sim", "std_length"))
    ranked = ["customer", "status", "seventh", "remark_code"]
    scale = lambda c: f"case when max({c}) over () = min({c}) over () then 0 else ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) end"
    novel = f"with {_novelty(events, orders)}"
    place = lambda names, c="col": f"list_position({names}, {c}) - 1"
    scored = f"with recursive {_TICKETS}, {_profile(_cells('tickets', ranked))}, {_similarity('cells')}, pp as (select p.*, sim, {place(ranked)} ord from p join sims using (col)), {_scores(scale)}"
    # of the first thousand tickets: screened columns that are no times, their scores, pairs with the timestamp
    head = f"head as (select * from tickets order by event_id limit 1000), {_screening('head', _TICKET_COLUMNS)}"
    able = "select col from final where kept and not (col in ('customer', 'status', 'changed') and dt_20 = n_20)"
    suggested = (
        f"with recursive {_TICKETS}, {head}, {_profile(_cells('head', _TICKET_COLUMNS))}, fcells as (select * from cells where col in ({able})), {_similarity('fcells')}, "
        f"pp as (select p.*, sim, {place(_TICKET_COLUMNS)} ord from p join sims using (col)), {_scores(scale)}, "
        "best as (select col as t from final where ts order by n - filled, ord limit 1), suggestions as (select t, c, a from pairs, best where t not in (c, a))"
    ).replace("best as (select sig as best_sig from grouped where timelike order by alike desc, seen limit 1)", "bsig as (select sig as best_sig from grouped where timelike order by alike desc, seen limit 1)").replace("select best_sig from best", "select best_sig from bsig")
    roles = ("customer", "status", "seventh")
    shares = " union all ".join(
        f"select '{c}' c, '{a}' a, avg((n > 1 and d > 1)::int) share, max(n) longest, max(d) most from (select {c}, count(*) n, count(distinct ({a}, 1)) d from tickets where {c} is not null group by {c})"
        for c in roles for a in roles if c != a
    )
    wide_times = ", ".join(f"('{t}', {i})" for i, t in enumerate(_TYPES))
    wide_cells = " union all ".join(f"select user_id, {i} as ord, '{t}' as col, {t} as v from wide" for i, t in enumerate(_TYPES))
    wide_primary = f"wc as ({wide_cells}), wp as (select col, min(ord) ord, count(distinct v) - 0.5 * (count(*) - count(v)) as score, count(*) - count(v) as nulls from wc group by col)"
    return {
        "log_statistics_events": _statistics(events, "events"),
        "log_statistics_orders": _statistics(orders, "orders"),
        "log_statistics_lineitem": _statistics(lineitem, "lineitem"),
        "log_statistics_conversations": _statistics(conversations, "conversations"),
        "ca_features_orders": _validated(orders, "orders"),
        "ca_features_lineitem": _validated(lineitem, "lineitem"),
        "variants_topk": f"""with e as ({li}), k as (select c, count(*) n, list(a order by {_orders(lineitem)}) tr from e where c is not null group by c)
            select min(c) as example, count(*) as cases, any_value(n) as length from k group by tr order by cases desc, example limit 10""",
        "trace_lengths": f"""with e as ({li}), k as (select c, count(*) n, count(distinct (a, 1)) d from e where c is not null group by c)
            select n as length, d as activities, count(*) as cases from k group by n, d""",
        "trace_per_case": f"""with e as ({o}) select c as "case", string_agg(a, '>' order by {_orders(orders)}) as trace from e where c is not null group by c""",
        "dfg_edges": f"""with e as ({e}) select a as act, nx as next_act, count(*) as n from (
            select a, lead(a) over w nx, lead(1) over w more from e where c is not null window w as (partition by c order by t nulls last, o0)) where more is not null group by a, nx""",
        "valid_trace_events": f"""with e as ({li}), g as (select c from e where c is not null group by c having count(*) > 1 and count(distinct (a, 1)) > 1)
            select a as act, count(*) as events, count(distinct c) as cases from e semi join g on e.c = g.c group by a""",
        "dedup_case_ts": f"""with e as ({o}) select c as "case", a as act, epoch_us(t) as micros from e qualify row_number() over (partition by c, t order by o0) = 1""",
        "standard_log": 'select o_custkey as "case:concept:name", o_orderstatus as "concept:name", epoch_us(o_orderdate) as "time:timestamp" from orders',
        "sorted_log": "select event_id, user_id, event_type, epoch_us(date_trunc('second', ts)) as micros from events where event_id % 10 <> 3",
        "wide_to_long": pick(melted),
        "ensure_long": pick(melted),
        "case_level_melt": pick(melted.replace("select user_id as", "select user_id * 10 + 7 as")),
        "interval_gate": pick(
            f""", l as (select user_id, list_sort(list_filter([{", ".join(f"epoch_us({t})" for t in _TYPES)}], lambda x: x is not null)) ts from wide where user_id in (select user_id from wide order by user_id limit 500)),
            g as (select user_id, ts, [(ts[i + 1] - ts[i]) / 1e6 for i in range(1, len(ts))] gaps from l)
            select coalesce(sum(len(gaps)), 0)::bigint as gaps, coalesce(sum(len(list_filter(gaps, lambda x: x < 120))), 0)::bigint as short,
              count(*) filter (where len(ts) > 1 and ts[1] = ts[-1]) as identical, count(*) as rows from g"""
        ),
        "table_type_fill_rates": pick(" union all ".join(f"select '{t}' as \"column\", round(count({t}) / count(*), 6) as filled from wide" for t in _TYPES)),
        # columns of type timestamp by the catalogue, texts by their first values; a wide table has a column that is unique in each row
        "table_types": pick(
            f""", shape as (
              select 'events' as t, count(*) filter (where data_type like 'TIMESTAMP%') times, false as uniq from (describe select * from events) d(column_name, data_type, n, k, df, e)
              union all select 'nation', count(*) filter (where data_type like 'TIMESTAMP%'), false from (describe select * from nation) d(column_name, data_type, n, k, df, e)
              union all select 'wide', {len(_TYPES)}, (select count(*) = count(distinct user_id) from wide))
            select t as "table", case when times = 0 then 'No' when times < 3 then 'long' when uniq then 'wide' else 'long' end as kind from shape"""
        ),
        "primary_timestamp": pick(f', {wide_primary} select col as "column", score::double as score from wp order by score desc, ord limit 1'),
        "least_null_timestamp": pick(
            f""", {wide_primary}, asked as (select unnest(['{",".join(_TYPES)}', 'signup,error', 'error,signup', 'view']) q),
            each as (select q, unnest(string_split(q, ',')) as col, unnest(range(len(string_split(q, ',')))) as pl, len(string_split(q, ',')) as n from asked)
            select q as asked, arg_min(col, case when n >= 3 then pl else nulls * 10 + pl end) as "column" from each join wp using (col) group by q"""
        ),
        "column_profile": profiled
        + f""" select (list_position({_PROFILED}, col) - 1)::int as ordinal, col as "column", n_rows, non_null, n_unique, round(max_freq, 6) as max_freq, round(entropy, 6) as entropy,
            round(std_length, 6) as std_length, max_length, round(long_share, 6) as long_share, round(n_unique_ratio, 6) as n_unique_ratio from p""",
        "minmax_norm": profiled + f' select col as "column", round({scale("entropy")}, 6) as entropy_scaled, round({scale("max_freq")}, 6) as max_freq_scaled from p',
        "heuristic_scores": scored + ' select col as "column", round(case_score, 6) as case_score, round(act_score, 6) as act_score from sc',
        "top_columns": scored + ' select role, place::int as place, col as "column" from top where place < 2',
        "similarity": f"""with recursive cells as ({" union all ".join(f"select '{c}' as col, {c}::varchar as v from nation" for c in ("n_nationkey", "n_name", "n_regionkey"))}), {_similarity("cells")}
            select col as "column", round(sim, 6) as sim from sims""",
        "parsed_patterns": _PARSED,
        "datetime_filter": f"""with {_TEXTS}, {_screening("texts", _TEXT_COLUMNS)} select col as "column" from final where lower(col) not in ('kind') and (n_20 = 0 or dt_20 < n_20)""",
        "suggested_columns": suggested + ' select t as "timestamp", c as "case", a as activity from suggestions',
        "validated_log": suggested + f', shares as ({shares}) select t as "timestamp", c as "case", a as activity from suggestions join shares using (c, a) where share >= 0.3 and longest > 1 and most > 1',
        "evaluated_combinations": f"with {_TICKETS} "
        + " union all ".join(
            f"""select 'changed' as "timestamp", '{c}' as "case", '{a}' as activity, valid_share, valid_share >= 0.3 as passed, {", ".join(f"{x}::double as {x}" for x in LOG_FEATURES)}
            from ({_validated(EventLogSpec(c, a, "changed", ("event_id",)), "tickets")})"""
            for c, a in (("customer", "status"), ("customer", "seventh"), ("seventh", "status"))
        ),
        "candidate_tables": f"""with {_wide()}, {_TICKETS}, {_screening("tickets", _TICKET_COLUMNS)}, {wide_primary},
            l as (select user_id, list_sort(list_filter([{", ".join(f"epoch_us({t})" for t in _TYPES)}], lambda x: x is not null)) ts from wide where user_id in (select user_id from wide order by user_id limit 500)),
            g as (select ts, [(ts[i + 1] - ts[i]) / 1e6 for i in range(1, len(ts))] gaps from l),
            gate as (select sum(len(list_filter(gaps, lambda x: x < 120))) / sum(len(gaps)) <= 0.8 and count(*) filter (where len(ts) > 1 and ts[1] = ts[-1]) / count(*) <= 0.85 as passed from g)
            select 'tickets' as "table", case when count(*) < 3 then 'event-level' else 'event-level-multi' end as path, max(col) as "timestamp" from final where ts
            union all select 'wide', 'event-level-multi', (select col from wp order by score desc, ord limit 1)
            union all select 'wide', 'case-level-melt', 'timestamp' from gate where passed""",
        "csv_scan": 'select o_custkey as "case", o_orderstatus as act, epoch_us(date_trunc(\'millisecond\', o_orderdate)) as micros from orders',
        "folder_features": f"""with e as ({_events(EventLogSpec("o_custkey", "o_orderstatus", "o_orderdate", ("o_orderkey",)), "orders", "o_custkey % 4")}),
            s as (select id, c, count(*) n, count(distinct (a, 1)) d from e where c is not null group by id, c),
            v as (select e.* from e semi join (select id, c from s where n > 1 and d > 1) g on e.id = g.id and e.c = g.c), {_features(orders, "v", by_time=False)}
            select id as part, {_rounded_features()}, total_event_count, round(share, 6) as valid_trace_percentage
            from f join (select id, avg((n > 1 and d > 1)::int) share from s group by id) using (id)""",
        "matrix_read": f"with e as ({_events(orders, 'orders', 'o_custkey % 10')}), {_features(orders, 'e')} select {', '.join(f'round({c}::double, 6) as {c}' for c in LOG_FEATURES)} from f",
        "zenodo_search": """select 'zenodo__' || n_nationkey as ref, 'zenodo__' || n_nationkey || '/part0.CSV' as csv_path, n_name as title
            from nation where n_regionkey % 3 = 1 and n_nationkey % 4 <> 3 order by n_nationkey limit 5""",
        "kaggle_search": """select 'owner/' || n_nationkey as ref, 'owner__' || n_nationkey || '/part0.CSV' as csv_path, n_name as title
            from nation where n_regionkey % 3 = 1 and n_nationkey % 4 <> 3 order by n_nationkey limit 4""",
        "column_training_set": f"""with recursive {_profile(labelled("0") + " union all " + labelled("1"))}, {_similarity("cells")}
            select regexp_replace(split_part(col, '/', 2), '[01]$', '') as "column", split_part(col, '/', 1) as label, {features} from p join sims using (col)""",
        "recognisers": _RECOGNISED,
        "unix_ts_detect": f"""with {_TEXTS}, two as (select 'unix_time' as col, unix_time as v from texts union all select 'phone', phone from texts)
            select col as "column", count(*) filter (where regexp_matches(col, 'unix|time|timestamp|epoch') and year(to_timestamp(v::bigint)) between 2000 and 2050) as datetimes from two group by col""",
        "field_screening": _SCREENED,
        "duplicate_columns": """with t as (select n_nationkey, n_name, n_regionkey, n_nationkey as copy_of_key, n_regionkey + 1 as other from nation),
            u as (unpivot (select n_nationkey as k, n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey, copy_of_key::varchar as copy_of_key, other::varchar as other from t)
              on n_nationkey, n_name, n_regionkey, copy_of_key, other into name col value v),
            w as (select col, list(coalesce(v, '-9999') order by k) vals, list_position(['n_nationkey', 'n_name', 'n_regionkey', 'copy_of_key', 'other'], col) ord from u group by col)
            select b.col as "column", arg_min(a.col, a.ord) as same_as from w a join w b on a.vals = b.vals and a.ord < b.ord group by b.col""",
        "ca_combinations": scored + ' select c as "case", a as activity from pairs',
        "offline_features": f"""with e as ({_events(orders, "orders", "o_custkey % 10")}),
            s as (select id, c, count(*) n, count(distinct (a, 1)) d from e where c is not null group by id, c),
            v as (select e.* from e semi join (select id, c from s where n > 1 and d > 1) g on e.id = g.id and e.c = g.c), {_features(orders, "v", by_time=False)}
            select id as file, {_rounded_features()}, total_event_count, round(share, 6) as valid_trace_percentage, round(variant_count / unique_case_count, 6) as variant_ratio,
              round(avg_events_per_case / unique_activity_count, 6) as avg_events_per_case_ratio
            from f join (select id, avg((n > 1 and d > 1)::int) share from s group by id) using (id)""",
        "knn1_distance": novel + " select id, round(min(d), 6) as score, min(d) > 0.6 as outlier from d group by id",
        "lof_score": novel + _LOF + " select id, round(score, 6) as score, score > 1.5 as outlier from lof",
        "novelty_vote": novel
        + _LOF
        + """, r as (select id, score > 1.5 as outlier from lof union all select id, min(d) > 0.6 from d group by id)
            select id, count(*) filter (where outlier) >= count(*) // 2 + 1 as anomaly from r group by id""",
        "classified_columns": f"select m as method, col as \"column\", label as said from (values ('logistic'), ('tree'), ('rf'), ('gb'), ('svm')) x(m), {named}",
        "saved_classifiers": f"select m as method, col as \"column\", true as same from (values ('logistic'), ('tree'), ('svm')) x(m), {named}",
        "oversampled_columns": f"""with recursive {_profile(" union all ".join(labelled(str(i), 4) for i in range(4)))}, {_similarity("cells")},
            r as (select (split_part(col, '/', 1) = 'activity')::int as target, n_unique_ratio, max_freq, entropy, sim, std_length from p join sims using (col)),
            k as (select max(n) n from (select count(*) n from r group by target))
            select target, any_value(k.n) as n, {", ".join(f"round(min({c}), 6) as least_{c}, round(max({c}), 6) as most_{c}" for c in ("n_unique_ratio", "max_freq", "entropy", "sim", "std_length"))} from r, k group by target""",
        "feature_means_by_label": f"""with recursive {_profile(labelled(""))}, {_similarity("cells")}
            select split_part(col, '/', 1) as label, {", ".join(f"round(avg({c}), 6) as {c}" for c in ("n_unique_ratio", "max_freq", "entropy", "sim", "std_length"))} from p join sims using (col) group by label""",
    }
