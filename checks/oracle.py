"""Independent recomputation of every query in ANSI-style SQL (run by DuckDB).

The SQL follows the plain definition of each operator, pair by pair and row by
row, not the plan the Spark side chooses.
"""

from __future__ import annotations

from turnout.functions.keys import DOMAIN_TYPOS, KNOWN_DOMAINS, NAME_PARTICLES
from turnout.sources.adapter import AS_OF, sql_texts

P = 2147483647
SEED = 20260801
TS = f"timestamp '{AS_OF}'"


# ------------------------------------------------------------------ expressions
def lst(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def h31(*cols):
    parts = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"(cast('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) as bigint) % {P})"


def uni(*cols):
    return f"(({h31(*cols)} + 0.5::double) / {P}.0::double)"


def poly(prefix, h):
    x = f"{prefix}3"
    for i in (2, 1, 0):
        x = f"(({x} * {h} + {prefix}{i}) % {P})"
    return f"(({x} + 0.5::double) / {P}.0::double)"


def normal(a, b, h):
    return f"(sqrt(-2.0::double * ln({poly(a, h)})) * cos(6.283185307179586::double * {poly(b, h)}))"


def logit(p):
    q = f"least(0.999999::double, greatest(0.000001::double, {p}))"
    return f"ln({q} / (1.0::double - {q}))"


def sigmoid(z):
    return f"(1.0::double / (1.0::double + exp(-least(30.0::double, greatest(-30.0::double, {z})))))"


def _climb(u, k, mass, width, ratio):
    """Least number from k on up to which masses sum to u; `ratio` gives the next mass from a.k."""
    none = "{'m': 0.0::double, 'c': 0.0::double, 'k': cast(j as bigint)}"
    first = f"{{'m': {mass}, 'c': {mass}, 'k': cast({k} as bigint)}}"
    step = f"{{'m': a.m * {ratio}, 'c': a.c + a.m * {ratio}, 'k': a.k + 1}}"
    return (
        f"list_reduce(list_prepend({first}, list_transform(range(0, cast({width} as bigint)), lambda j: {none})), "
        f"lambda a, b: case when a.c >= {u} then a else {step} end).k"
    )


def binomial(u, n, p, k, sd):
    """Least k with P(X <= k) >= u; the columns k and sd are where to begin, and the deviation."""
    mass = f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"
    return _climb(u, k, mass, f"least({n} - {k}, 17 * {sd} + 40)", f"(({n} - a.k) / (a.k + 1.0::double) * ({p} / (1 - {p})))")


def hypergeometric(u, total, good, taken):
    low = f"greatest(0, {taken} + {good} - {total})"
    top = f"least({good}, {taken})"
    choose = lambda n, m: f"lgamma({n} + 1) - lgamma({m} + 1) - lgamma({n} - ({m}) + 1)"
    mass = f"exp({choose(good, low)} + {choose(f'({total} - {good})', f'({taken} - {low})')} - ({choose(total, taken)}))"
    ratio = f"(({good} - a.k) * ({taken} - a.k) / ((a.k + 1.0::double) * ({total} - {good} - {taken} + a.k + 1)))"
    return _climb(u, low, mass, f"{top} - {low}", ratio)


def text_of(c):
    return f"lower(regexp_replace(strip_accents(coalesce({c}, '')), '^\\s+|\\s+$', '', 'g'))"


def local_of(t):
    return f"case when contains({t}, '@') then split_part(regexp_extract({t}, '^(.*)@[^@]*$', 1), '+', 1) else {t} end"


def fix_dom(d):
    typo = " ".join(f"when {d} = '{k}' then '{v}'" for k, v in DOMAIN_TYPOS.items())
    near = " ".join(f"when levenshtein({d}, '{k}') <= 1 then '{k}'" for k in KNOWN_DOMAINS)
    return f"case {typo} when {d} in {lst(KNOWN_DOMAINS)} then {d} {near} else {d} end"


def core_of(l):
    return f"regexp_replace(regexp_replace({l}, '[._\\-]', '', 'g'), '[0-9]+$', '')"


def phone_of(c):
    d = f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
    n = f"case when length({d}) > 10 and {d} like '57%' then substr({d}, 3) else {d} end"
    return f"case when length({n}) >= 10 then right({n}, 10) else '' end"


def tokens_of(c):
    return (
        f"list_filter(string_split_regex(regexp_replace(lower(strip_accents({c})), '[^a-z\\s]', ' ', 'g'), '\\s+'), "
        f"lambda t: t <> '' and t not in {lst(NAME_PARTICLES)})"
    )


def dels(s):
    return f"list_distinct(list_transform(range(1, length({s}) + 1), lambda i: substr({s}, 1, i - 1) || substr({s}, i + 1)))"


def swaps(s):
    return (
        f"list_distinct(list_filter(list_transform(range(1, length({s})), lambda i: substr({s}, 1, i - 1) || "
        f"substr({s}, i + 1, 1) || substr({s}, i, 1) || substr({s}, i + 2)), lambda t: t <> {s}))"
    )


# ------------------------------------------------------------------ shared tables
def _ctes():
    t = dict(sql_texts())
    c = {k: v for k, v in t.items()}
    c["tb"] = f"""
      select t.ticket_id, t.sale_id, t.event_id, e.artist_id, e.artist_name, e.month, t.ticket_type,
             t.ticket_type = 'Cortesía' as is_courtesy, coalesce(t.price, 0.0) as price, s.channel, s.qty,
             case when s.purchased_at is not null then greatest(0.0::double,
               (epoch_us(e.starts_at) - epoch_us(s.purchased_at)) / 1e6::double / 86400.0::double) end as lead_days,
             least(e.starts_at, {TS}) as cut, e.starts_at, e.capacity, e.venue, e.city, e.is_residency, e.is_paid,
             e.weekday, weekofyear(e.starts_at) as iso_week, t.checked_in as y, t.checked_in is not null as labelled,
             cast(t.checked_in as int) as yn
      from tickets t join shows e on e.event_id = t.event_id join sales s on s.sale_id = t.sale_id"""
    c["lab"] = "select * from tb where labelled"
    c["fut"] = "select * from tb where not labelled"
    c["parts"] = """select *, case when iso_week in (1, 2) then 'train' when iso_week = 3 then 'val'
        when iso_week = 4 then 'test' end as split from lab"""
    c["nst"] = f"""select sale_id, {text_of('buyer_email')} as txt, {phone_of('buyer_phone')} as phone,
        list_sort(list_distinct({tokens_of("coalesce(buyer_name, '')")})) as names from sales"""
    c["nsl"] = f"select *, {local_of('txt')} as local, case when contains(txt, '@') then regexp_extract(txt, '@([^@]*)$', 1) end as rawdom from nst"
    c["ns"] = f"""select sale_id, phone, names, local, case when contains(txt, '@') then local || '@' || dom else txt end as email,
        dom, {core_of('local')} as core from (select *, case when rawdom is not null then {fix_dom('rawdom')} else '' end as dom from nsl)"""
    c["nut"] = f"""select user_id, {text_of('email')} as txt, {phone_of('phone')} as phone,
        list_sort(list_distinct({tokens_of("first_name || ' ' || last_name")})) as names from users"""
    c["nul"] = f"select *, {local_of('txt')} as local, case when contains(txt, '@') then regexp_extract(txt, '@([^@]*)$', 1) end as rawdom from nut"
    c["nu"] = f"""select user_id, phone, names, local, case when contains(txt, '@') then local || '@' || dom else txt end as email,
        dom, {core_of('local')} as core, count(*) over (partition by local) = 1 as alone
        from (select *, case when rawdom is not null then {fix_dom('rawdom')} else '' end as dom from nul)"""
    c["skeys"] = f"select sale_id, unnest(list_distinct(list_concat([core], {dels('core')}))) as k from ns where core <> ''"
    c["ukeys"] = f"select user_id, unnest(list_distinct(list_concat([core], {dels('core')}))) as k from nu where core <> ''"
    c["cand"] = f"""
      select s.sale_id, u.user_id from ns s join nu u on s.email = u.email where s.email <> ''
      union select s.sale_id, u.user_id from ns s join nu u on s.local = u.local where s.local <> ''
      union select s.sale_id, u.user_id from skeys s join ukeys u on s.k = u.k
      union select s.sale_id, u.user_id from
        (select sale_id, unnest(list_concat([phone], {swaps('phone')})) as k from ns where phone <> '') s
        join nu u on u.phone = s.k"""
    typo = "(length(ts) > 3 and levenshtein(ts, tu) <= 1)"
    has_typo = f"len(list_filter(sx, lambda ts: {typo})) > 0"
    has_init = "len(list_filter(sx, lambda ts: length(ts) = 1 and starts_with(tu, ts))) > 0"
    c["evid"] = f"""
      select sale_id, user_id, e, p, n, least(0.44::double * e + 0.36::double * p + 0.20::double * n, 1.0::double) as score from (
        select sale_id, user_id, e, p,
          case when len(sn) = 0 or len(un) = 0 then 0.0::double when sn = un then 1.0::double else
            greatest(0.0::double, least(1.0::double,
              (len(un) - len(ux) + 0.9::double * n_typo + 0.5::double * n_init) / len(un)
              - 0.15::double * greatest(0, len(sn) - len(un) - 1))) end as n
        from (
          select *, len(list_filter(ux, lambda tu: {has_typo})) as n_typo,
                 len(list_filter(ux, lambda tu: not ({has_typo}) and {has_init})) as n_init
          from (
            select c.sale_id, c.user_id, s.names as sn, u.names as un,
              list_filter(u.names, lambda x: not list_contains(s.names, x)) as ux,
              list_filter(s.names, lambda x: not list_contains(u.names, x)) as sx,
              case when s.email <> '' and s.email = u.email then 1.0::double
                   when s.local <> '' and s.local = u.local then
                     case when regexp_matches(s.local, '[0-9]') or u.alone then 0.85::double else 0.45::double end
                   when s.local <> '' and u.local <> '' and levenshtein(s.local, u.local) <= 1 then
                     case when s.dom <> '' and s.dom = u.dom then 0.85::double else 0.65::double end
                   when s.core <> '' and s.core = u.core then 0.25::double else 0.0::double end as e,
              case when s.phone = '' or u.phone = '' then 0.0::double when s.phone = u.phone then 1.0::double
                   when list_contains({swaps('u.phone')}, s.phone) then 0.75::double else 0.0::double end as p
            from cand c join ns s on s.sale_id = c.sale_id join nu u on u.user_id = c.user_id)))"""
    c["ranked"] = """select *, row_number() over (partition by sale_id order by score desc, user_id desc) as rn,
        coalesce(lead(score) over (partition by sale_id order by score desc, user_id desc), 0.0::double) as second from evid"""
    c["direct"] = """select s.sale_id, s.email, case when r.score >= 0.52 and r.score - r.second >= 0.06 then r.user_id end as user_id,
        case when r.score >= 0.52 and r.score - r.second >= 0.06 then round_even(r.score, 4) else 0.0 end as confidence,
        coalesce(round_even(r.e, 2), 0.0) as ev_email, coalesce(round_even(r.p, 2), 0.0) as ev_phone,
        coalesce(round_even(r.n, 2), 0.0) as ev_name
        from ns s left join ranked r on r.sale_id = s.sale_id and r.rn = 1"""
    c["firm"] = """select * from (select email, user_id as hu, confidence as hc, row_number() over (partition by email
        order by confidence desc, sale_id) as k from direct where user_id is not null and email <> '') where k = 1 and hc >= 0.70"""
    c["links"] = """select d.sale_id, coalesce(d.user_id, f.hu) as user_id,
        case when d.user_id is null and f.hu is not null then round_even(f.hc * 0.85, 4) else d.confidence end as confidence,
        ev_email, ev_phone, ev_name, case when d.user_id is not null then 'directo' when f.hu is not null then 'propagado' else '' end as via
        from direct d left join firm f on f.email = d.email"""
    hist_aggs = ", ".join(
        f"count(*) filter (type = '{v}' and created_at <= cut) as n_{k}, "
        f"count(*) filter (type = '{v}' and used and date_used <= cut) as x_{k}"
        for k, v in (("minimum", "consumo_minimo"), ("membership", "membresia"))
    )

    def rated(src):
        return f"""select *, case when n_minimum > 0 then u_minimum::double / n_minimum end as rate_minimum,
          case when n_membership > 0 then u_membership::double / n_membership end as rate_membership,
          n_minimum + n_membership as n_history,
          case when n_minimum + n_membership > 0 then (u_minimum + u_membership)::double / (n_minimum + n_membership) end as rate_history
          from (select *, least(x_minimum, n_minimum) as u_minimum, least(x_membership, n_membership) as u_membership from ({src}))"""

    c["linked"] = "select t.*, l.user_id, l.confidence from tb t left join (select * from links where user_id is not null) l on l.sale_id = t.sale_id"
    c["hist_then"] = rated(f"""select q.user_id, q.cut, {hist_aggs} from (select distinct user_id, cut from linked where user_id is not null) q
        left join history h on h.user_id = q.user_id group by q.user_id, q.cut""")
    c["today"] = rated(f"""select user_id, cut, {hist_aggs} from (select *, {TS} as cut from history) group by user_id, cut
        having n_minimum + x_minimum + n_membership + x_membership > 0""")
    c["feat"] = """select k.* exclude (user_id, confidence), k.user_id is not null as linked, k.user_id, coalesce(k.confidence, 0.0) as confidence,
        coalesce(a.n_history, 0) as n_history, a.rate_history, coalesce(a.n_minimum, 0) as n_minimum, a.rate_minimum,
        coalesce(a.n_membership, 0) as n_membership, a.rate_membership, coalesce(u.has_membership, false) as has_membership,
        coalesce(u.city = k.city, false) as same_city
        from linked k left join hist_then a on a.user_id = k.user_id and a.cut = k.cut left join users u on u.user_id = k.user_id"""
    # rates fitted on the development part (train + val), on all labelled rows, and per fold
    c["dev"] = "select * from parts where split in ('train', 'val')"
    c["dev_type"] = "select ticket_type, avg(yn) as r from dev group by 1"
    c["dev_art"] = "select artist_id, (sum(yn) + 60.0) / (sum(r) + 60.0) as f from dev join dev_type using (ticket_type) group by 1"
    clip = "least(0.999999::double, greatest(0.000001::double, {}))"
    b3 = clip.format("coalesce(r, (select avg(yn) from dev)) * coalesce(f, 1.0)")
    c["test3"] = f"select x.*, {b3} as p from parts x left join dev_type using (ticket_type) left join dev_art using (artist_id) where split = 'test'"
    c["test2"] = "select x.*, coalesce(r, (select avg(yn) from dev)) as p from parts x left join dev_type using (ticket_type) where split = 'test'"
    c["all_type"] = "select ticket_type, avg(yn) as r from lab group by 1"
    c["all_art"] = "select artist_id, (sum(yn) + 60.0) / (sum(r) + 60.0) as f from lab join all_type using (ticket_type) group by 1"
    b3a = clip.format("coalesce(r, (select avg(yn) from lab)) * coalesce(f, 1.0)")
    # without the show's own tickets: totals less its own cells
    c["own_cell"] = "select event_id, artist_id, ticket_type, count(*) as n, sum(yn) as o from lab group by 1, 2, 3"
    c["loo_type"] = """select e.event_id, e.artist_id, a.ticket_type, a.n - coalesce(o.n, 0) as left_n, a.o - coalesce(o.o, 0) as left_o,
        coalesce((t.o - coalesce(o.o, 0)) / nullif(t.n - coalesce(o.n, 0), 0)::double,
          ((select sum(yn) from lab) - e.o) / ((select count(*) from lab) - e.n)::double) as r
        from (select event_id, artist_id, sum(n) as n, sum(o) as o from own_cell group by 1, 2) e
        join (select artist_id, ticket_type, sum(n) as n, sum(o) as o from own_cell group by 1, 2) a on a.artist_id = e.artist_id
        join (select ticket_type, sum(n) as n, sum(o) as o from own_cell group by 1) t on t.ticket_type = a.ticket_type
        left join own_cell o on o.event_id = e.event_id and o.artist_id = e.artist_id and o.ticket_type = a.ticket_type"""
    c["loo_art"] = "select event_id, artist_id, (sum(left_o) + 60.0) / (sum(left_n * r) + 60.0) as f from loo_type group by 1, 2"
    c["past3"] = f"""select x.*, {clip.format("r * f")} as p from lab x join loo_type using (event_id, artist_id, ticket_type) join loo_art using (event_id, artist_id)"""
    c["fut3"] = f"select x.*, {b3a} as p from fut x left join all_type using (ticket_type) left join all_art using (artist_id)"
    c["fut2"] = "select x.*, coalesce(r, (select avg(yn) from lab)) as p from fut x left join all_type using (ticket_type)"
    c["ev3"] = """select event_id, count(*) as n, sum(yn) as obs, sum(p) as pred, sum(p * (1 - p)) as var_sum,
        avg(cast(is_courtesy as int)) as courtesy_share from past3 group by 1"""
    c["res3"] = """select *, ln(a / (1 - a)) - ln(b / (1 - b)) as resid, (var_sum / (n * n)) / (b * (1 - b) * b * (1 - b)) as door_var
        from (select *, least(0.999::double, greatest(0.001::double, obs / n)) as a, least(0.999::double, greatest(0.001::double, pred / n)) as b from ev3)"""
    c["shock"] = """select coalesce(regr_intercept(excess, courtesy_share), avg(excess) / (1 + avg(courtesy_share) * avg(courtesy_share))) as intercept,
        coalesce(regr_slope(excess, courtesy_share), avg(courtesy_share) * avg(excess) / (1 + avg(courtesy_share) * avg(courtesy_share))) as slope,
        greatest(quantile_cont(greatest(excess, 0.0), 0.1), 1e-4) as floor,
        sqrt(greatest(var_samp(resid) - avg(door_var), 1e-4)) as sigma_single, count(*) as n_events
        from (select *, resid * resid - door_var as excess from res3)"""
    c["sig_fut"] = """select event_id, avg(cast(is_courtesy as int)) as courtesy_share,
        sqrt(greatest((select intercept from shock) + (select slope from shock) * avg(cast(is_courtesy as int)), (select floor from shock))) as sigma
        from fut3 group by 1"""
    c["sig_past"] = c["sig_fut"].replace("fut3", "past3")
    c["fc3"] = """select event_id, cast(round_even(sum(p), 0) as int) as expected_attendance, min(artist_name) as artist_name,
        count(*) as n_tickets, count(*) filter (is_courtesy) as n_courtesy, round_even(avg(cast(is_courtesy as int)), 4) as courtesy_share,
        0 as n_linked, round_even(avg(p), 4) as expected_rate, sum(p) as expected from fut3 group by 1"""
    c["seats"] = """select f.event_id, f.artist_name, expected_attendance, coalesce(capacity, 0) as capacity,
        greatest(0, coalesce(capacity, 0) - expected_attendance) as free, city, starts_at from fc3 f join shows s on s.event_id = f.event_id"""
    c["curve"] = """select minute, n, n / sum(n) over () as fraction from (
        select cast(floor(((epoch_us(checked_in_at) - epoch_us(starts_at)) / 1e6::double / 60.0::double) / 15) * 15 as int) as minute, count(*) as n
        from tickets t join shows s on s.event_id = t.event_id where checked_in and checked_in_at is not null group by 1)"""
    c["prof"] = """select event_id, minute, case when minute = 0 then 'hora de inicio' else format('{:+d} min', minute) end as label,
        fraction, expected_attendance * fraction as people, sum(expected_attendance * fraction) over (partition by event_id order by minute) as running
        from fc3 cross join curve"""
    c["peak"] = """select event_id, people as peak, label as peak_label, minute as peak_minute,
        greatest(1, cast(ceil(people * 0.25::double / (15 * 0.7::double)) as int)) as staff
        from (select *, row_number() over (partition by event_id order by people desc, minute) as k from prof) where k = 1"""
    c["obs_rates"] = """select channel as rate_key, avg(yn) as rate from lab where is_courtesy group by 1
        union all select case when is_courtesy then 'cortesia' else 'pagada' end, avg(yn) from lab group by is_courtesy"""
    c["l_channel"] = """select s.event_id, 'canal' as lever, 'débil' as strength, coalesce(w.impact, 0.0) as impact, coalesce(w.reach, 0) as reach
        from seats s left join (select event_id, count(*) as reach, count(*) * (select rate from obs_rates where rate_key = 'BOX_OFFICE')
          - sum(coalesce(rate, (select rate from obs_rates where rate_key = 'WEB'))) as impact
          from fut f left join obs_rates o on o.rate_key = f.channel where is_courtesy and channel in ('RRPP', 'ADMIN') group by 1) w on w.event_id = s.event_id"""
    c["l_convert"] = """select s.event_id, 'convertir' as lever, 'medio' as strength,
        coalesce(c.reach, 0) * ((select rate from obs_rates where rate_key = 'pagada') - (select rate from obs_rates where rate_key = 'cortesia')) * 0.7 as impact,
        coalesce(c.reach, 0) as reach from seats s left join (select event_id, least(count(*), 100) as reach from fut where is_courtesy group by 1) c on c.event_id = s.event_id"""
    c["invited"] = f"""select * from (
        select *, sum(p) over (partition by event_id order by p desc, user_id) as cum,
               row_number() over (partition by event_id order by p desc, user_id) as place from (
          select s.event_id, u.user_id, s.free, {clip.format("(select r from all_type where ticket_type = 'Cortesía') * coalesce(f, 1.0)")} as p
          from seats s join shows e on e.event_id = s.event_id join users u on u.city = s.city
          join today h on h.user_id = u.user_id and h.n_minimum >= 2
          left join all_art a on a.artist_id = e.artist_id
          where s.free > 0 and not exists (select 1 from linked k where not k.labelled and k.event_id = s.event_id and k.user_id = u.user_id))
        where p >= 0.40) where cum - p < free"""
    c["l_invite"] = f"""select s.event_id, 'invitar' as lever, 'fuerte' as strength, least(coalesce(sum(p), 0.0), s.free) as impact,
        count(i.user_id) as reach, coalesce(avg(p), 0.0) as mean_p,
        round_even(greatest(0.0, (epoch_us(s.starts_at) - epoch_us({TS})) / 86400e6::double), 1) as days_margin
        from seats s left join invited i on i.event_id = s.event_id group by s.event_id, s.free, s.starts_at"""
    c["acts"] = """select s.event_id, s.artist_name, s.expected_attendance, s.capacity, s.free,
        row_number() over (partition by s.event_id order by l.impact desc, l.ord) as place, l.lever, l.strength, round_even(l.impact, 1) as impact, l.reach
        from seats s join (select event_id, lever, strength, impact, reach, 1 as ord from l_invite union all
          select event_id, lever, strength, impact, reach, 2 from l_channel union all select event_id, lever, strength, impact, reach, 3 from l_convert) l
        on l.event_id = s.event_id"""
    return c


CTES = _ctes()
HEAVY = {"tb", "cand", "evid", "links", "linked", "hist_then", "feat", "past3", "fut3", "ns", "nu", "shock", "invited"}


def q(body: str, **extra: str) -> str:
    """`body` preceded by the shared tables it needs, in dependency order."""
    import re

    known = {**CTES, **extra}
    order: list[str] = []

    def visit(sql: str):
        for word in re.findall(r"\b[a-z_0-9]+\b", sql):
            if word in known and word not in order and word not in visiting:
                visiting.add(word)
                visit(known[word])
                order.append(word)

    visiting: set[str] = set()
    visit(body)
    parts = [f"{n} as {'materialized ' if n in HEAVY or n in extra else ''}({known[n]})" for n in order]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def sims(n: int, streams: str = "tsvgw") -> str:
    cols = ", ".join(f"{h31(SEED, repr(s), 'sim', repr(f'c{i}'))} as {s}{i}" for s in streams for i in range(4))
    return f"select sim, {cols} from range({n}) r(sim)"
