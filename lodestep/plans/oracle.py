"""DuckDB SQL that says independently what the decision-log queries must return."""

from __future__ import annotations

M = "18446744073709551616::UHUGEINT"
FNV = f"list_reduce(list_concat([14695981039346656037::UHUGEINT], {{bytes}}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {M})"
#: Offers: number, then the right-hand tokens in order with their weights.
RIGHT = {0: [("", 1), ("a|cost", 2), ("a|fresh", 1), ("i|north", 1)], 1: [("", 1), ("i|east", 1)], 2: [("", 1), ("a|cost", 5), ("i|south", 1)]}


def _chars(text: str) -> str:
    """Bytes of an ASCII text; an empty text splits into one empty character, whose code 0 goes."""
    return f"list_filter(list_transform(string_split({text}, ''), lambda c: ascii(c)::UHUGEINT), lambda z: z <> 0)"


def fnv(bytes_: str) -> str:
    return FNV.format(bytes=bytes_)


def mixed(source: str, column: str, keep: str, out: str = "m") -> str:
    """Subquery with ``out`` = the 64-bit finaliser of ``column``."""
    return f"""(select {keep}, xor(m4, m4 >> 31) as {out} from (select *, ((xor(m2, m2 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {M})::UBIGINT as m4 from
        (select *, ((xor({column}, {column} >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {M})::UBIGINT as m2 from {source})))"""


def key(name: str, salt: str = "ev") -> str:
    return key_of(name, repr(salt))


def key_of(name: str, salt: str) -> str:
    """Key of a decision's draws, of two text expressions."""
    return fnv(f"list_concat([strlen({name})::UHUGEINT, 0, 0, 0, 0, 0, 0, 0], {_chars(name)}, {_chars(salt)})")


def units(n: int) -> str:
    """CTEs with u0.. of each event."""
    first = f"keyed as (select event_id, 'ev:' || event_id as name, {key(chr(39) + 'ev:' + chr(39) + ' || event_id')}::UBIGINT as key from events)"
    steps = [first]
    for i in range(n):
        counted = f"(select *, ((key::UHUGEINT + {i}::UHUGEINT * 11400714819323198485::UHUGEINT) % {M})::UBIGINT as c from keyed)"
        steps.append(f"d{i} as (select event_id, (m >> 11)::DOUBLE * 1.1102230246251565e-16::DOUBLE as u{i} from {mixed(counted, 'c', 'event_id')})")
    return ", ".join(steps)


def log(by: str = "", clean: bool = False) -> str:
    """CTEs dec, res, pair and line: the log with n, the effective resolutions (of the same ``by``) before each row. ``clean`` leaves out resolutions of one segment."""
    of = f"partition by {by} " if by else ""
    left = " where decision_id not in (select decision_id from dec where seg = 'error')" if clean else ""
    return f"""with {units(1)},
third as (select 1::DOUBLE / 3::DOUBLE as p),
dec as (select e.event_id, e.user_id, 'ev:' || e.event_id as decision_id, epoch_us(e.ts)::DOUBLE / 1000000::DOUBLE as t, e.event_type as seg, hour(e.ts)::DOUBLE as hour,
    case when u0 < p then 0 when u0 < p + p then 1 else 2 end as chosen, p as propensity from events e join d0 using (event_id), third),
one as (select event_id, user_id, decision_id, 0 as report, t + (event_id * 37 % 5000) as t, t as t0, ((event_id * 7 + chosen * 3) % 4)::DOUBLE / 4::DOUBLE as reward from dec where event_id % 13 <> 0),
told as (select *, case when t0 + 3600::DOUBLE <= t then 'expired' else 'rewarded' end as kind from
    (select * from one union all select event_id, user_id, decision_id, 1, t + 60::DOUBLE, t0, 1::DOUBLE - reward from one where event_id % 17 = 0)),
res as (select event_id, user_id, decision_id, report, t, kind, case when kind = 'expired' then 0::DOUBLE else reward end as reward from told),
log as (select t, 0 as ko, event_id, -1 as report, 'decision' as event, decision_id, user_id, seg, hour, chosen, propensity, null::varchar as kind, null::double as reward from dec
    union all select t, 1, event_id, report, 'resolution', decision_id, user_id, null, null, null, null, kind, reward from res{left}),
pair as (select *, event = 'resolution' and coalesce(lag(event) over w, '') = 'decision' as effective, event = 'decision' and lead(event) over w is null as open,
    lag(event_id) over w as d_event_id, lag(seg) over w as d_seg, lag(hour) over w as d_hour, lag(chosen) over w as d_chosen, lag(propensity) over w as d_propensity
    from log window w as (partition by decision_id order by t, ko, event_id, report)),
line as (select *, coalesce(sum(effective::int) over ({of}order by t, ko, event_id, report rows between unbounded preceding and 1 preceding), 0) as n from pair)"""


LOG = log()


def features(bits: int, name: str = "feat", hours: bool = True) -> str:
    """CTE with the features (seg, hour, cand, slot, v) of every distinct context."""
    right = ", ".join(f"({cand}, {j}, '{token}', {w}::DOUBLE)" for cand, tokens in RIGHT.items() for j, (token, w) in enumerate(tokens))
    hashed = mixed(f"(select distinct lt, rt, {fnv(f'list_concat({_chars(chr(108) + chr(116))}, [31::UHUGEINT], {_chars(chr(114) + chr(116))})')}::UBIGINT as f from {name}_p)", "f", "lt, rt")
    hour = f"union all select seg, hour, 1, 'c|hour', hour from {name}_c " if hours else ""
    return f"""{name}_c as (select distinct seg, hour from dec), {name}_r(cand, j, rt, rw) as (values {right}),
{name}_l as (select seg, hour, 0 as i, '' as lt, 1::DOUBLE as lw from {name}_c {hour}union all select seg, hour, 2, 'c|seg=' || seg, 1::DOUBLE from {name}_c),
{name}_p as (select seg, hour, cand, i * 1000 + j as ord, lt, rt, lw * rw as w from {name}_l, {name}_r),
{name}_h as (select * from {hashed}),
{name} as (select seg, hour, cand, slot, v from (select seg, hour, cand, (m % {1 << bits})::INT as slot, list_reduce(list_concat([0::DOUBLE], list(case when m >= 9223372036854775808 then -w else w end order by ord)), lambda a, b: a + b) as v
    from {name}_p join {name}_h using (lt, rt) group by seg, hour, cand, (m % {1 << bits})::INT) where v <> 0)"""


def _decayed(f: float, exponent: str) -> str:
    return f"pow({f}::DOUBLE, {exponent})"


def updates(name: str, feats: str, f: float = 1.0, by: str = "") -> str:
    """CTE of what each effective resolution adds to each slot, in units of the sums before anything was forgotten."""
    return f"""{name} as (select {by and by + ", "}slot, n as u, v * v * {_decayed(f, "-(n + 1)")} as dxx, reward * v * {_decayed(f, "-(n + 1)")} as dxy
    from line join {feats} f on f.seg = d_seg and f.hour = d_hour and f.cand = d_chosen where effective)"""


def evaluated(bits: int, epsilons: list[float], digits: int, name: str, f: float = 1.0, by: str = "", hours: bool = True) -> str:
    """CTEs that end with the report ``name`` of one number of bits and forgetting, for each ``by`` if given."""
    grid = ", ".join(f"({e}::DOUBLE)" for e in epsilons)
    of, using = (by + ", ", f"{by}, ") if by else ("", "")
    same = f"c.{by} is not distinct from s.{by} and " if by else ""
    counts = f"select {of}count(*) filter (event = 'decision') as decisions, count(*) filter (open) as unresolved from line {'group by ' + by if by else ''}"
    shown = lambda x: f"round({x}, {digits})"
    return f"""{features(bits, name + '_f', hours)},
{updates(name + '_up', name + '_f', f, by)},
{name}_ask as (select {of}event_id, n, cand, slot, v from line join {name}_f f using (seg, hour) where event = 'decision'),
{name}_st as (select {of}slot, ord // 2 as n, xx * {_decayed(f, "ord // 2")} as xx, xy * {_decayed(f, "ord // 2")} as xy from (select *, sum(dxx) over w as xx, sum(dxy) over w as xy from
    (select {of}slot, 2 * u + 1 as ord, dxx, dxy from {name}_up union all select distinct {of}slot, 2 * n, 0::DOUBLE, 0::DOUBLE from {name}_ask) window w as (partition by {of}slot order by ord rows between unbounded preceding and current row)) where ord % 2 = 0),
{name}_e as (select event_id, cand, list_reduce(list_concat([0::DOUBLE], list(v * (xy * (1::DOUBLE / (xx + 1::DOUBLE))) order by slot)), lambda a, b: a + b) as e from {name}_ask join {name}_st using ({using}slot, n) group by event_id, cand),
{name}_b as (select event_id, count(*) as k, max(e) as best from {name}_e group by event_id),
{name}_k as (select event_id, any_value(k) as k, any_value(best) as best, count(*) filter (e = best) as ties from {name}_e join {name}_b using (event_id) group by event_id),
{name}_w as (select {of}g.eps, d_event_id, (case when x.e = best then g.eps / k + (1::DOUBLE - g.eps) / ties else g.eps / k end) / d_propensity as w, reward as r
    from line l join {name}_k kk on kk.event_id = l.d_event_id join {name}_e x on x.event_id = l.d_event_id and x.cand = l.d_chosen, (values {grid}) g(eps) where effective),
{name}_s as (select {of}eps, count(*) as n, sum(r) as r, sum(w) as s, sum(w * r) as sr, sum(w * w) as ss, max(w) as top from {name}_w group by {of}eps),
{name} as (select {'c.' + of if by else ''}{bits}::INT as bits, g.eps as epsilon, {f}::DOUBLE as forgetfulness, c.decisions, coalesce(n, 0) as resolved, c.unresolved,
    {shown('r / n')} as logged_mean, {shown('sr / n')} as ips, {shown('sr / s')} as snips, {shown('s * s / ss')} as ess, {shown('top')} as max_weight
    from ({counts}) c cross join (values {grid}) g(eps) left join {name}_s s on {same}s.eps = g.eps)"""


def replayed(bits: int, f: float, by: str = "", clean: bool = False, digits: int | None = None) -> str:
    """CTEs that end with ``r``: the true sums of each slot after the whole log."""
    of, using = (by + ", ", f" using ({by})") if by else ("", "")
    total = f"(select {of}count(*) as m from line where effective {'group by ' + by if by else ''})"
    shown = lambda x: x if digits is None else f"round({x}, {digits})"
    sums = ", ".join(shown(f"sum({d}) * {_decayed(f, 'any_value(m)')}") + f" as {d[1:]}" for d in ("dxx", "dxy"))
    return f"{log(by, clean)}, {features(bits)}, {updates('up', 'feat', f, by)}, r as (select {of}slot, {sums} from up {'join' if by else 'cross join'} {total} t{using} group by {of}slot)"


#: What damage a decision's or a resolution's remainder stands for, and the finding that it brings.
DECISION_FINDINGS = {
    0: "': decision ' || id || ': bits must be between 1 and 24'", 1: "': decision ' || id || ': chosen index out of range'", 2: "': decision ' || id || ': propensity must be in (0, 1]'",
    3: "': decision ' || id || ': candidates do not match the logged candidate_hash'", 4: "': decision ' || id || ': chosen features do not match the logged candidates'",
    5: "': decision ' || id || ': candidates failed to encode'", 6: "': not valid JSON'", 7: "': malformed decision event'",
    8: "case when t - 86400::DOUBLE < latest then ': decision ' || id || ': t decreases within salt ''ev''' end", 9: "case when copy = 1 then ': duplicate decision id ''' || id || '''' end",
}
RESOLUTION_FINDINGS = {12: "': not valid JSON'", 13: "': each event must be a JSON object with an ''event'' kind'", 14: "': unknown event kind'", 15: "': malformed resolution event'"}


def findings() -> str:
    """CTEs that end with ``found`` (line, at, problem) of the damaged log."""
    case = lambda of: " ".join(f"when {k} then {v}" for k, v in of.items())
    return f"""{LOG}, both_ as (select t, ko, event_id, report, event, decision_id as id, kind, 0 as copy from log union all select t, ko, event_id, report, event, decision_id, kind, 1 from log where event = 'decision' and event_id % 211 = 9),
numbered as (select *, event_id % 211 as d, row_number() over (order by t, ko, event_id, report, copy) as line from both_),
seen as (select *, max(t - case when d = 8 then 86400::DOUBLE else 0::DOUBLE end) filter (event = 'decision' and d not in (0, 1, 5, 6, 7)) over (order by line rows between unbounded preceding and 1 preceding) as latest from numbered),
told_ as (select line, case
    when event = 'decision' then case d {case(DECISION_FINDINGS)} end
    when d in (12, 13, 14, 15) then case d {case(RESOLUTION_FINDINGS)} end
    when d in (6, 7) then ': resolution for unknown decision ''' || id || ''''
    when report = 1 then ': second resolution for decision ''' || id || ''''
    when d = 10 then ': resolution for ' || id || ': unknown kind ''lost'''
    when d = 11 then ': resolution for ' || id || ': reward must be a finite number' end as what from seen),
found as (select line, 0::INT as at, 'line ' || line || what as problem from told_ where what is not null)"""


#: CTEs that end with ``rounds`` (user_id, t, best, regret, normalizer, squared) of the logged policy.
ROUNDS = f"""{LOG}, offered as (select event_id, user_id, t, chosen, [(event_id * 7 % 4)::DOUBLE / 4::DOUBLE, ((event_id * 7 + 3) % 4)::DOUBLE / 4::DOUBLE, ((event_id * 7 + 6) % 4)::DOUBLE / 4::DOUBLE] as r from dec),
rounds as (select user_id, row_number() over (partition by user_id order by t, event_id) - 1 as t, list_max(r) as best, list_max(r) - r[chosen + 1] as regret, list_max(r) - list_sum(r) / 3 as normalizer, pow(r[chosen + 1] - 0.375::DOUBLE, 2) as squared from offered)"""
_NORMALIZED = "case when sum(normalizer) = 0 then 0::DOUBLE else sum(regret) / sum(normalizer) end"


def exactly(x: str) -> str:
    """The sum as a whole number of 2^-80ths, rounded once."""
    return f"(sum(({x} * pow(2::DOUBLE, 60))::HUGEINT)::DOUBLE / pow(2::DOUBLE, 60))"


def bootstrapped(replicates: int, salt: str = "bootstrap") -> str:
    """CTEs that end with ``boot`` (replicate, n, ips, snips) over the weights a_w: each decision a Poisson number of times."""
    from ..operators.fold import POISSON

    drawn = mixed(f"(select event_id, b, ((key::UHUGEINT + b::UHUGEINT * 11400714819323198485::UHUGEINT) % {M})::UBIGINT as c from bkey, range({replicates}) q(b))", "c", "event_id, b")
    return f"""bkey as (select event_id, {key(chr(39) + 'ev:' + chr(39) + ' || event_id', salt)}::UBIGINT as key from events),
bunit as (select event_id, b, (m >> 11)::DOUBLE * 1.1102230246251565e-16::DOUBLE as u from {drawn}),
times as (select event_id, b, {' + '.join(f'(u >= {p!r}::DOUBLE)::INT' for p in POISSON)} as k from bunit),
boot as (select b::INT as replicate, sum(k)::BIGINT as n, round(sum(k * w * r) / sum(k), 9) as ips, round(sum(k * w * r) / sum(k * w), 9) as snips from a_w join times on event_id = d_event_id group by b)"""


def _slates(click: str, epsilon: float = 0.05) -> str:
    """The top two of three offers, drawn one after the other without the first winner, by each user's own state."""
    def drawn(step: int) -> str:
        name = f"user_id::varchar || ':' || (seq + {step})"
        return f"(select user_id, (m >> 11)::DOUBLE * 1.1102230246251565e-16::DOUBLE as u{step} from {mixed(f'(select user_id, {key_of(name, 'user_id::varchar')}::UBIGINT as c from heads)', 'c', 'user_id')})"

    shares = lambda es: f"list_transform({es}, lambda x: case when x = list_max({es}) then {epsilon}::DOUBLE / len({es}) + (1::DOUBLE - {epsilon}::DOUBLE) / len(list_filter({es}, lambda y: y = list_max({es}))) else {epsilon}::DOUBLE / len({es}) end)"
    return f"""heads as (select user_id, max(event_id) + 1 as seq from dec group by user_id),
e as (select u.user_id, c.cand, list_reduce(list_concat([0::DOUBLE], list(v * (coalesce(xy, 0) * (1::DOUBLE / (coalesce(xx, 0) + 1::DOUBLE))) order by c.slot)), lambda a, b: a + b) as e from heads u cross join {click} c left join r on r.user_id = u.user_id and r.slot = c.slot group by u.user_id, c.cand),
offered as (select user_id, list(e order by cand) as es, ['north', 'east', 'south'] as arms from e group by user_id),
taken1 as (select *, {shares('es')} as ps from offered join {drawn(0)} using (user_id)),
first_ as (select *, case when u0 < ps[1] then 1 when u0 < ps[1] + ps[2] then 2 else 3 end as won from taken1),
rest_ as (select user_id, won, ps, arms, list_concat(es[1:won - 1], es[won + 1:3]) as es, list_concat(arms[1:won - 1], arms[won + 1:3]) as others from first_),
two as (select *, {shares('es')} as qs from rest_ join {drawn(1)} using (user_id))
select user_id, 0::INT as place, arms[won] as arm, ps[won] as propensity from two union all select user_id, 1, others[case when u1 < qs[1] then 1 else 2 end], qs[case when u1 < qs[1] then 1 else 2 end] from two"""


def sql(bits: int, epsilon: float, f: float) -> dict[str, str]:
    hexed = lambda c: f"printf('%016X', {c})"
    sweep = [(b, x, f"s{i}") for i, (b, x) in enumerate((b, x) for b in (4, 8) for x in (1.0, f))]
    rule = "regexp_replace(regexp_replace(problem, '^line [0-9]+: ', ''), 'ev:[0-9]+', 'ID', 'g')"
    click = "(select distinct cand, slot, v from feat where seg = 'click' and hour = 12)"
    return {
        "hash_ids": f"select a.event_id, {hexed(fnv(_chars('name')) + '::UBIGINT')} as fnv, {hexed('m')} as mixed, {hexed(key('name') + '::UBIGINT')} as key from (select event_id, 'ev:' || event_id as name from events) a join {mixed('(select event_id, event_id::UBIGINT as x from events)', 'x', 'event_id')} b using (event_id)",
        "rng_units": f"with {units(3)} select event_id, u0, u1, u2 from d0 join d1 using (event_id) join d2 using (event_id)",
        "logged_choices": f"{LOG} select decision_id, seg, hour, chosen, propensity from dec",
        "encode_events": f"{LOG}, {features(bits)} select event_id, cand, slot, v from dec join feat using (seg, hour)",
        "effective_resolutions": f"{LOG} select decision_id, report, kind, reward, d_chosen as chosen from pair where effective",
        "horizon_classes": f"{LOG} select kind, report, count(*) as n, sum(reward) as reward from res group by kind, report",
        "log_counts": f"{LOG} select event, count(*) as n from log group by event",
        "evaluate_lattice": f"{LOG}, {evaluated(bits, [epsilon], 6, 'a')} select * from a",
        "evaluate_forget": f"{LOG}, {evaluated(bits, [epsilon], 6, 'a', f)} select * from a",
        "ablation": f"{LOG}, {evaluated(bits, [epsilon], 6, 'a', hours=False)} select * from a",
        "sweep_lattice": f"{LOG}, {', '.join(evaluated(b, [0.05, 0.2, 1.0], 4, name, x) for b, x, name in sweep)} {' union all '.join(f'select * from {name}' for *_, name in sweep)}",
        "per_user_evaluate": f"{log('user_id')}, {evaluated(bits, [epsilon], 9, 'a', f, 'user_id')} select * from a",
        "replay_slots": f"{replayed(bits, 1.0)} select * from r",
        "replay_forget": f"{replayed(bits, f, digits=6)} select slot, xx, xy, (select max(event_id) + 1 from dec) as next_seq, (select count(*) from line where effective) as model_version from r",
        "replay_states": f"{replayed(bits, f, 'user_id', digits=6)} select * from r",
        "merged_logs_replay": f"{replayed(bits, 1.0, clean=True)} select * from r",
        "preview_states": f"""{replayed(bits, f, 'user_id')}, e as (select u.user_id, c.cand, sum(v * (coalesce(xy, 0) * (1::DOUBLE / (coalesce(xx, 0) + 1::DOUBLE)))) as e
            from (select distinct user_id from dec) u cross join {click} c left join r on r.user_id = u.user_id and r.slot = c.slot group by u.user_id, c.cand)
            select user_id, case cand when 0 then 'north' when 1 then 'east' else 'south' end as arm, round(e, 6) as estimate,
            round(case when e = max(e) over (partition by user_id) then 0.05::DOUBLE / 3 + 0.95::DOUBLE else 0.05::DOUBLE / 3 end, 6) as probability from e""",
        "per_user_heads": f"{log('user_id')} select user_id, (select max(event_id) + 1 from dec d where d.user_id = l.user_id) as next_seq, count(*) filter (effective) as model_version from line l group by user_id",
        "slate_topk": f"""{replayed(bits, f, 'user_id')}, {_slates(click)}""",
        "lateral_states": f"{replayed(bits, f, 'user_id', digits=6)} select * from r",
        "rolling_log": f"{LOG} select event_id, report, round(avg(reward) over (order by t, ko, event_id, report rows between 1999 preceding and current row), 9) as mean from pair where effective",
        "bootstrap_estimates": f"""{LOG}, {evaluated(bits, [epsilon], 6, 'a')}, {bootstrapped(3)} select * from boot""",
        "interval_join": f"""{LOG}, near as (select decision_id, report, case when kind = 'rewarded' then reward end as reward from res where kind = 'rewarded')
            select decision_id, report, 'rewarded' as kind, reward from near union all select decision_id, -1, 'expired', 0::DOUBLE from dec where decision_id not in (select decision_id from near)""",
        "states_as_of": f"""{LOG}, {features(bits)}, placed as (select *, row_number() over (order by t, ko, event_id, report) as line from pair), asked as (select line from placed where line % 1000 = 0)
            select a.line, slot, sum(v * v) as xx, sum(reward * v) as xy from asked a join placed p on p.line < a.line and effective join feat f on f.seg = d_seg and f.hour = d_hour and f.cand = d_chosen group by a.line, slot""",
        "decide_batch": f"""{LOG}, {replayed(bits, 1.0)[len(LOG) + 2:]}, est as (select seg, hour, cand, list_reduce(list_concat([0::DOUBLE], list(v * (coalesce(xy, 0::DOUBLE) * (1::DOUBLE / (coalesce(xx, 0::DOUBLE) + 1::DOUBLE))) order by slot)), lambda a, b: a + b) as e from feat left join r using (slot) group by seg, hour, cand),
            pp as (select *, {epsilon}::DOUBLE / 3 + case when e = max(e) over w then (1::DOUBLE - {epsilon}::DOUBLE) / count(*) filter (e = top) over w else 0::DOUBLE end as p from (select *, max(e) over (partition by seg, hour) as top from est) window w as (partition by seg, hour)),
            rows_ as (select seg, hour, list(e order by cand) as es, list(p order by cand) as ps from pp group by seg, hour),
            took as (select event_id, es, ps, case when u0 < ps[1] then 0 when u0 < ps[1] + ps[2] then 1 else 2 end as chosen from dec join d0 using (event_id) join rows_ using (seg, hour))
            select event_id, chosen::INT as chosen, ['north', 'east', 'south'][chosen + 1] as arm, ps[chosen + 1] as propensity, es[chosen + 1] as estimate, (list_position(es, list_max(es)) - 1)::INT as best from took""",
        "exact_sums": f"{LOG} select seg, chosen, {exactly('t')} as t, {exactly('value')} as value, {exactly('value * (1::DOUBLE / (chosen + 2))')} as shared, {exactly('value * value')} as squares from dec join (select event_id, value from events) using (event_id) group by seg, chosen",
        "regret_by_user": f"""{ROUNDS}, lined as (select *, count(*) over (partition by user_id) as n, avg(best - regret) over w as earned, avg(best) over w as most, count(*) over w as ahead from rounds window w as (partition by user_id order by t rows between current row and 9 following))
            select user_id, round({_NORMALIZED}, 9) as regret, round(case when sum(normalizer) filter (last_) = 0 then 0::DOUBLE else sum(regret) filter (last_) / sum(normalizer) filter (last_) end, 9) as late_regret, round(sqrt(avg(squared)), 9) as rmse,
            (min(t) filter (ahead = 10 and t >= 20 and earned >= 0.5::DOUBLE * most) - 20)::BIGINT as recovered from (select *, t >= n - greatest(1, floor(n * 0.1::DOUBLE)) as last_ from lined) group by user_id""",
        "regret_quartiles": f"{ROUNDS}, per as (select user_id, {_NORMALIZED} as x from rounds group by user_id) select user_id % 10 as grp, round(quantile_cont(x, 0.5), 9) as median, round(quantile_cont(x, 0.25), 9) as low, round(quantile_cont(x, 0.75), 9) as high from per group by user_id % 10",
        "verify_log": f"{findings()} select * from found",
        "verify_findings": f"{findings()} select {rule} as problem, count(*) as n, min(line) as first_line from found group by {rule}",
        "debiased_rates": f"{LOG} select d_seg as seg, d_chosen as chosen, count(*) as exposure, round(sum(reward * (1::DOUBLE / d_propensity)) / sum(1::DOUBLE / d_propensity), 9) as rate from pair where effective group by d_seg, d_chosen",
        "expiry_rate": f"{LOG} select floor(t / 86400)::BIGINT as day, count(*) as n, round(avg((kind = 'expired')::INT::DOUBLE), 9) as expired from pair where effective group by floor(t / 86400)::BIGINT",
        "rolling_reward": f"{LOG} select event_id, user_id, report, round(avg(reward) over (partition by user_id order by t, ko, event_id, report rows between 99 preceding and current row), 9) as mean from pair where effective",
    }
