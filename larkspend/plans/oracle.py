"""The registered queries in DuckDB SQL, for comparison."""

from __future__ import annotations

TXN = """txn as (select event_id as txn_id, user_id // 10 as card_id, case when event_id % 13 = 12 then -1 else event_id % 13 end as merchant_id,
  case when event_type = 'click' then cast(round(value * 100) as bigint) % 200 else cast(round(value * 100) as bigint) end as amount_minor,
  epoch_us(date_trunc('day', ts)) // 1000 + (epoch_us(ts) // 1000 - epoch_us(date_trunc('day', ts)) // 1000) // 240 as t,
  cast((user_id // 10) % 40 + 10 + ((event_id % 21) - 10) * 0.01 + case when event_id % 17 = 0 then 30 when event_id % 19 = 0 then 2 else 0 end as double) as lat,
  cast((user_id // 10) % 90 * 1.0 + ((event_id % 9) - 4) * 0.01 as double) as lon,
  case when event_type = 'view' then null else event_type = 'error' end as labelled_fraud, epoch_us(ts) // 86400000000 as source_day from events)"""

DIMS = """cards as (select distinct card_id, case when card_id % 15 = 11 then -1 else card_id end as customer_id,
  case card_id % 15 when 13 then 'BLOCKED' when 12 then 'EXPIRED' else 'ACTIVE' end as status, 50000 + (card_id * 7 % 26) * 10000 as daily_limit_minor from txn where card_id % 15 <> 14),
customers as (select distinct card_id as customer_id, case card_id % 3 when 0 then 'LOW' when 1 then 'MEDIUM' else 'HIGH' end as risk_tier, 'DE' as home_country,
  cast(card_id % 40 + 10 as double) as home_lat, cast(card_id % 90 as double) as home_lon from txn),
merchants as (select distinct merchant_id, 'M' || merchant_id as name, ['5411','5812','5541','7995','6051','5732','4121','5999'][merchant_id % 8 + 1] as mcc, 'C' || (merchant_id % 5) as country,
  cast(merchant_id * 3.0 + 10 as double) as m_lat, cast(merchant_id * 7.0 as double) as m_lon from txn where merchant_id >= 0),
profiles as (select c.card_id, c.customer_id, c.status, c.daily_limit_minor, u.risk_tier, u.home_country, u.home_lat, u.home_lon from cards c join customers u using (customer_id))"""

KM = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a}))"
_A = "(sin(radians({y2} - {y1}) / 2) * sin(radians({y2} - {y1}) / 2) + cos(radians({y1})) * cos(radians({y2})) * sin(radians({x2} - {x1}) / 2) * sin(radians({x2} - {x1}) / 2))"


def km(y1: str, x1: str, y2: str, x2: str) -> str:
    return KM.format(a=_A.format(y1=y1, x1=x1, y2=y2, x2=x2))


ATTEMPTS = """attempts as (select *, count(*) over (partition by card_id order by t range between 60000 preceding and 1 preceding) + row_number() over (partition by card_id, t order by txn_id) as attempts_60s from txn)"""

SMALL = """small as (select a.txn_id, count(b.txn_id) as small_10m, count(distinct b.merchant_id) as small_merchants_10m from txn a
  left join txn b on a.card_id = b.card_id and b.amount_minor < 200 and b.t between a.t - 600000 and a.t and (b.t < a.t or b.txn_id <= a.txn_id) group by a.txn_id)"""


def fold(certain_km: float, short_hop: int, name: str = "decided") -> str:
    """Recursive fold of every card over its rows in order."""
    return f"""feed as (select x.*, s.small_10m, s.small_merchants_10m, p.card_id is not null as has, p.status, p.daily_limit_minor as lim, p.risk_tier as tier, m.merchant_id is not null as known, m.country, m.mcc,
  coalesce(m.mcc in ('7995','6051','4829','shopping_net','misc_net'), false) as risky, x.t // 86400000 as day, row_number() over (partition by x.card_id order by x.t, x.txn_id) as rn
  from attempts x join small s using (txn_id) left join profiles p using (card_id) left join merchants m using (merchant_id)),
{name} as (
  select card_id, cast(0 as bigint) as rn, cast(null as bigint) as txn_id, cast(null as bigint) as merchant_id, cast(null as bigint) as t, cast(null as bigint) as amount_minor, cast(null as boolean) as labelled_fraud, cast(null as bigint) as source_day,
    false as unknown, false as inactive, false as fast, false as testing, false as daily, 0 as geo, false as risky, false as tiered, 0 as score, '' as decision,
    cast(null as bigint) as spend_day, cast(0 as bigint) as spent_minor, cast(null as double) as last_lat, cast(null as double) as last_lon, cast(null as bigint) as last_seen, cast(null as varchar) as last_place,
    cast(0 as bigint) as spent_before, cast(null as double) as km, cast(null as bigint) as waited, cast(null as varchar) as place_before
  from (select distinct card_id from feed)
  union all
  select card_id, rn, txn_id, merchant_id, t, amount_minor, labelled_fraud, source_day, unknown, inactive, fast, testing, daily, geo, risky, tiered, score, decision,
    case when accepts and has and not late then day else spend_day end, case when accepts and has and not late then spent + coalesce(amount_minor, 0) else spent_minor end,
    case when moves then lat else last_lat end, case when moves then lon else last_lon end, case when moves then t else last_seen end, case when moves then country else last_place end, spent, dist, gap, last_place
  from (select *, decision <> 'DECLINE' as accepts, decision <> 'DECLINE' and lat is not null and lon is not null and (last_seen is null or t >= last_seen) as moves from (
    select *, case when score >= 71 then 'DECLINE' when score >= 40 then 'REVIEW' else 'APPROVE' end as decision from (
    select *, cast(least(100, base + case when tiered then 10 else 0 end) as int) as score from (
    select *, fired and has and tier = 'HIGH' as tiered from (
    select *, unknown or inactive or fast or testing or daily or geo > 0 or risky as fired,
      case when unknown then 50 else 0 end + case when inactive then 100 else 0 end + case when fast then 45 else 0 end + case when testing then 60 else 0 end + case when daily then 80 else 0 end
      + case geo when 2 then 80 when 1 then {short_hop} else 0 end + case when risky then 20 else 0 end as base from (
    select *, case when last_seen is null or dist is null or dist < 100 or not (case when gap = 0 then true else dist / (gap / 3600000.0) > 900 end) then 0 when dist >= {certain_km} then 2 else 1 end as geo from (
    select f.*, d.spend_day, d.spent_minor, d.last_lat, d.last_lon, d.last_seen, d.last_place, not f.has as unknown, f.has and coalesce(f.status, 'ACTIVE') <> 'ACTIVE' as inactive, f.attempts_60s > 5 as fast,
      f.small_10m >= 4 and f.small_merchants_10m >= 3 as testing, coalesce(d.spend_day > f.day, false) as late, case when d.spend_day = f.day then d.spent_minor else 0 end as spent,
      f.has and coalesce(case when d.spend_day = f.day then d.spent_minor else 0 end + coalesce(f.amount_minor, 0) > f.lim, false) as daily, abs(f.t - d.last_seen) as gap, {km('d.last_lat', 'd.last_lon', 'f.lat', 'f.lon')} as dist
    from {name} d join feed f on f.card_id = d.card_id and f.rn = d.rn + 1))))))))"""


BASE = f"with recursive {TXN}, {DIMS}, {ATTEMPTS}, {SMALL}, "
RULES = "concat_ws(',', case when unknown then 'UNKNOWN_CARD' end, case when inactive then 'CARD_NOT_ACTIVE' end, case when fast then 'VELOCITY' end, case when testing then 'CARD_TESTING' end, case when daily then 'DAILY_LIMIT' end, case geo when 2 then 'GEO_VELOCITY' when 1 then 'GEO_SHORT_HOP' end, case when risky then 'MERCHANT_RISK' end, case when tiered then 'CUSTOMER_RISK_TIER' end)"
DECIDED = BASE + fold(500, 45) + f", decisions as (select *, {RULES} as rules, case when source_day < (select min(source_day) from txn) + 20 then 'train' else 'test' end as period from decided where rn > 0)"
BOTH = DECIDED + ", both_ as (select * exclude (period), period from decisions union all select * exclude (period), '**all**' from decisions)"

def money(x: str) -> str:
    return f"'EUR ' || ({x} // 100) || '.' || lpad(cast({x} % 100 as varchar), 2, '0')"


TOOK = "case when {ms} // 60000 > 0 then ({ms} // 60000) || 'm ' || ({ms} // 1000 % 60) || 's' else ({ms} // 1000) || 's' end"
_JUMP = f"""printf('%.0f', d.km) || ' km from ' || coalesce(d.place_before, 'last location') || ' to ' || coalesce(f.country, 'here') || ' in ' || {TOOK.format(ms='d.waited')} || ' implies ' || case when d.waited = 0 then 'Infinity' else printf('%.0f', d.km / (d.waited / 3600000.0)) end || ' km/h'"""
REASONS = f"""reasons as (select d.txn_id, d.period, r.* from decisions d join feed f using (txn_id), lateral (select unnest([
  {{'o': 0, 'rule': 'UNKNOWN_CARD', 's': 50, 'f': d.unknown, 'd': 'card is not in the reference data'}}, {{'o': 1, 'rule': 'CARD_NOT_ACTIVE', 's': 100, 'f': d.inactive, 'd': 'card status is ' || f.status}},
  {{'o': 2, 'rule': 'VELOCITY', 's': 45, 'f': d.fast, 'd': f.attempts_60s || ' attempts in 60s (max 5)'}}, {{'o': 3, 'rule': 'CARD_TESTING', 's': 60, 'f': d.testing, 'd': f.small_10m || ' attempts under EUR 2.00 across ' || f.small_merchants_10m || ' merchants in 10 min'}},
  {{'o': 4, 'rule': 'DAILY_LIMIT', 's': 80, 'f': d.daily, 'd': {money('d.spent_before')} || ' spent today + ' || {money('d.amount_minor')} || ' would exceed the ' || {money('f.lim')} || ' limit'}},
  {{'o': 5, 'rule': 'GEO_VELOCITY', 's': 80, 'f': d.geo = 2, 'd': {_JUMP}}}, {{'o': 6, 'rule': 'GEO_SHORT_HOP', 's': 45, 'f': d.geo = 1, 'd': {_JUMP}}},
  {{'o': 7, 'rule': 'MERCHANT_RISK', 's': 20, 'f': d.risky, 'd': 'high-risk merchant category ' || f.mcc}}, {{'o': 8, 'rule': 'CUSTOMER_RISK_TIER', 's': 10, 'f': d.tiered, 'd': 'customer is HIGH risk tier'}}], recursive := true)) r where r.f)"""

WINDOWS = """windows as (select merchant_id, t // 300000 * 300000 as window_start, (t // 300000 + 1) * 300000 as window_end, count(*) as total, count(*) filter (decision = 'DECLINE') as declined from {rows} group by all)"""


def ratio(a: str, b: str) -> str:
    return f"round(case when {b} = 0 then 0.0 else ({a}) / ({b}) end, 6)"


_P, _R = "case when tp + fp = 0 then 0.0 else tp / (tp + fp) end", "case when tp + fn = 0 then 0.0 else tp / (tp + fn) end"
CONFUSION = f"""points as (select {{key}} point, coalesce(labelled_fraud, false) as fraud, amount_minor, case point when 'declined' then decision = 'DECLINE' else decision <> 'APPROVE' end as hit, period from {{rows}}, (values ('declined'), ('flagged')) v(point)),
confusion as (select {{key}} period, point, count(*) filter (hit and fraud) as tp, count(*) filter (hit and not fraud) as fp, count(*) filter (not hit and fraud) as fn, count(*) filter (not hit and not fraud) as tn,
  cast(coalesce(sum(amount_minor) filter (hit and fraud), 0) as bigint) as caught_minor, cast(coalesce(sum(amount_minor) filter (fraud), 0) as bigint) as fraud_minor from points group by {{key}} period, point),
measures as (select *, {_P} as p, {_R} as r from confusion)"""

NOW_MS = 1_704_067_500_000
#: What is looked up by id.
CARD, MERCHANT = 7, 3
EVERY = {
    "txn_event_time": """with e as (select event_id, epoch_us(ts) // 1000 as ms, event_id % 4 as src_partition from events),
r as (select event_id, src_partition, case when event_id % 7 = 0 then null when event_id % 11 = 0 then -5 else ms end as own, case when event_id % 77 = 0 then -1 else ms + 250 end as taken from e),
k as (select *, coalesce(case when own > 0 then own end, case when taken >= 0 then taken end) as known from r)
select event_id, cast(src_partition as bigint) as src_partition, coalesce(known, max(known) over (partition by src_partition order by event_id rows unbounded preceding)) as ts_ms from k""",
    "latest_reference": "select user_id, arg_max(event_type, event_id) as event_type, round(arg_max(value, event_id), 6) as value, max(event_id) as event_id from events group by user_id having arg_max(coalesce(event_type, 'none'), event_id) <> 'error'",
    "card_profiles": f"with {TXN}, {DIMS} select * from profiles",
    "enriched": f"with {TXN}, {DIMS} select txn_id, x.card_id, x.merchant_id, amount_minor, t, round(lat, 6) as lat, round(lon, 6) as lon, p.card_id is not null as has_profile, p.status, p.daily_limit_minor, p.risk_tier, m.merchant_id is not null as has_merchant, m.mcc, m.country from txn x left join profiles p using (card_id) left join merchants m using (merchant_id)",
    "asof_reference": """with v as (select user_id, event_id as seq, event_type as version from events where event_id % 3 = 0), r as (select event_id, user_id from events where event_id % 3 <> 0)
select event_id, r.user_id, (select arg_max(version, seq) from v where v.user_id = r.user_id and v.seq <= r.event_id) as version from r""",
    "nearby_merchants": f"""with s as (select s_suppkey as merchant_id, (s_suppkey * 37 % 1200) / 10.0 - 60.0 as m_lat, (s_suppkey * 91 % 3600) / 10.0 - 180.0 as m_lon from supplier),
c as (select c_custkey as card_id, (c_custkey * 53 % 1100) / 10.0 - 55.0 as home_lat, (c_custkey * 17 % 3600) / 10.0 - 180.0 as home_lon from customer),
d as (select card_id, merchant_id, {km('home_lat', 'home_lon', 'm_lat', 'm_lon')} as d from c, s),
n as (select *, count(*) filter (d <= 50) over (partition by card_id) as near, row_number() over (partition by card_id order by d, merchant_id) as rank from d)
select card_id, merchant_id, round(d, 6) as km, cast(rank as int) as rank from n where case when near >= 3 then d <= 50 else rank <= 3 end""",
    "velocity_attempts": f"with {TXN}, {ATTEMPTS} select txn_id, card_id, t, attempts_60s from attempts",
    "card_testing": f"with {TXN}, {SMALL} select txn_id, small_10m, small_merchants_10m, small_10m >= 4 and small_merchants_10m >= 3 as card_testing from small",
    "static_rules": f"with {TXN}, {DIMS} select txn_id, p.card_id is null as unknown_card, coalesce(p.status <> 'ACTIVE', false) as card_not_active, coalesce(m.mcc in ('7995','6051','4829'), false) as merchant_risk from txn x left join profiles p using (card_id) left join merchants m using (merchant_id)",
    "decisions": DECIDED + " select txn_id, card_id, merchant_id, t, amount_minor, decision, score, cast(unknown as int) + cast(inactive as int) + cast(fast as int) + cast(testing as int) + cast(daily as int) + cast(geo > 0 as int) + cast(risky as int) + cast(tiered as int) as n_reasons from decisions",
    "decision_reasons": DECIDED + f", {REASONS} select txn_id, cast(row_number() over (partition by txn_id order by o) - 1 as int) as position, rule, s as rule_score, d as detail from reasons",
    "decision_state": DECIDED + " select card_id, arg_max(txn_id, rn) as txn_id, arg_max(decision, rn) as decision, arg_max(score, rn) as score, arg_max(coalesce(spend_day, -1), rn) as spend_day, arg_max(coalesce(case when spend_day is not null then spent_minor end, -1), rn) as spent_minor, arg_max(rules, rn) as rules, round(arg_max(coalesce(last_lat, -999), rn), 6) as last_lat, round(arg_max(coalesce(last_lon, -999), rn), 6) as last_lon, arg_max(coalesce(last_seen, -1), rn) as last_seen, arg_max(coalesce(last_place, '?'), rn) as last_place from decisions group by card_id",
    "state_after_sweep": DECIDED + ", s as (select card_id, arg_max(coalesce(spend_day, -1), rn) as d, arg_max(coalesce(case when spend_day is not null then spent_minor end, -1), rn) as m, arg_max(coalesce(last_seen, -1), rn) as l from decisions group by card_id), w as (select max(l) - 5000000 as now from s) select card_id, case when d < now // 86400000 - 1 then -1 else d end as spend_day, case when d < now // 86400000 - 1 then -1 else m end as spent_minor, case when l < now - 604800000 then -1 else l end as last_seen from s, w",
    "merchant_windows_final": DECIDED + ", " + WINDOWS.format(rows="decisions") + f" select merchant_id, window_start, window_end, total, declined, {ratio('declined', 'total')} as decline_rate from windows where window_end + 30000 <= (select max(t) from decisions)",
    "merchant_windows_late": DECIDED + ", kept as (select * from (select *, max(t) over (order by txn_id rows unbounded preceding) as now from decisions) where (t // 300000 + 1) * 300000 + 30000 > now), " + WINDOWS.format(rows="kept") + f" select merchant_id, window_start, window_end, total, declined, {ratio('declined', 'total')} as decline_rate from windows where window_end + 30000 <= (select max(t) from decisions)",
    "merchant_windows_latest12": DECIDED + ", " + WINDOWS.format(rows="decisions") + f", p as (select *, row_number() over (partition by merchant_id order by window_start desc) as position from windows) select merchant_id, window_start, window_end, total, declined, {ratio('declined', 'total')} as decline_rate, cast(position as int) as position, window_end + 30000 <= {NOW_MS} as closed from p where position <= 12",
    "card_risk_view": DECIDED + f""", last as (select * from (select *, row_number() over (partition by card_id order by rn desc) as k from decisions) where k = 1),
clock as (select max(t) as now from decisions),
recent as (select card_id, count(*) as attempts_10m, count(*) filter (t >= now - 60000) as attempts_60s, max(t) as last_attempt from txn, clock where t between now - 600000 and now group by card_id)
select coalesce(p.card_id, l.card_id) as card_id, p.status, p.risk_tier, p.daily_limit_minor, case when l.spend_day = now // 86400000 then l.spent_minor else 0 end as spent_today,
  case when p.card_id is not null then greatest(0, p.daily_limit_minor - case when l.spend_day = now // 86400000 then l.spent_minor else 0 end) end as remaining,
  round(l.last_lat, 6) as last_lat, round(l.last_lon, 6) as last_lon, l.last_seen, l.last_place, coalesce(attempts_10m, 0) as attempts_10m, coalesce(attempts_60s, 0) as attempts_60s, last_attempt, l.txn_id as last_txn, l.decision as last_decision, l.score as last_score, l.rules as last_rules
from profiles p full join last l using (card_id) left join recent r on r.card_id = coalesce(p.card_id, l.card_id), clock""",
    "decision_totals": DECIDED + " select v as decision, count(d.txn_id) as n, round(count(d.txn_id) / sum(count(d.txn_id)) over (), 6) as share from (values ('APPROVE'), ('REVIEW'), ('DECLINE')) x(v) left join decisions d on d.decision = x.v group by v",
    "rule_totals": DECIDED + f", {REASONS} select rule, count(*) as n, round(count(*) / max(count(*)) over (), 6) as bar from reasons group by rule",
    "feed_snapshot": DECIDED + " select txn_id, card_id, decision, score, evaluated_at_ms from (select *, t + 40 as evaluated_at_ms from decisions) qualify row_number() over (order by evaluated_at_ms desc, txn_id desc) <= 200",
    "feed_tail": DECIDED + " select txn_id, src_partition, cast(position as int) as position from (select txn_id, cast(card_id % 6 as bigint) as src_partition, row_number() over (partition by card_id % 6 order by t desc, txn_id desc) as position from decisions) where position <= 40",
    "confusion": BOTH + ", " + CONFUSION.format(key="", rows="both_") + f" select period, point, tp, fp, fn, tn, caught_minor, fraud_minor, round(p, 6) as precision, round(r, 6) as recall, {ratio('fp', 'fp + tn')} as false_positive_rate, {ratio('tp + fn', 'tp + fp + fn + tn')} as base_rate, {ratio('caught_minor', 'fraud_minor')} as money_stopped, {ratio('2 * p * r', 'p + r')} as f1 from measures",
    "rule_stats": DECIDED + f", {REASONS}, d2 as (select txn_id, coalesce(labelled_fraud, false) as fraud, p as period from decisions, lateral (select unnest([period, '**all**']) as p)), tot as (select period, count(*) as n, count(*) filter (fraud) as frauds from d2 group by period), h as (select d2.period, rule, count(*) as hits, count(*) filter (fraud) as fraud_hits from d2 join reasons using (txn_id) group by d2.period, rule) select period, rule, hits, fraud_hits, round(fraud_hits / hits, 6) as precision, case when frauds > 0 then round((fraud_hits / hits) / (frauds / n), 6) end as lift, {ratio('fraud_hits', 'frauds')} as fraud_share from h join tot using (period)",
    "card_episodes": BOTH + ", f as (select *, row_number() over (partition by period, card_id order by t, txn_id) as nth from both_ where labelled_fraud) select period, card_id, count(*) as frauds, min(nth) filter (decision <> 'APPROVE') as first_flagged from f group by period, card_id",
    "fraud_catch_summary": BOTH + ", f as (select *, row_number() over (partition by period, card_id order by t, txn_id) as nth from both_ where labelled_fraud), e as (select period, card_id, min(nth) filter (decision <> 'APPROVE') as first_flagged from f group by period, card_id) select period, count(*) as cards_hit, count(first_flagged) as cards_caught, cast(median(first_flagged - 1) as double) as median_before from e group by period",
    "dataset_summary": BOTH + f" select period, count(*) as transactions, count(*) filter (labelled_fraud) as frauds, cast(coalesce(sum(amount_minor) filter (labelled_fraud), 0) as bigint) as fraud_minor, count(distinct card_id) as cards, count(distinct merchant_id) as merchants, {ratio('count(*) filter (labelled_fraud)', 'count(*)')} as base_rate from both_ group by period",
    "verdict_distribution": BOTH + " select period, count(*) filter (decision = 'APPROVE') as approve, count(*) filter (decision = 'REVIEW') as review, count(*) filter (decision = 'DECLINE') as decline from both_ group by period",
    "policy_comparison": BASE + fold(500, 45, "d1") + ", " + fold(100, 0, "d2").replace("feed as (", "feed2 as (").replace("from feed)", "from feed2)").replace("join feed f", "join feed2 f") + ", both_ as (select policy, labelled_fraud, amount_minor, decision, unnest([case when source_day < (select min(source_day) from txn) + 20 then 'train' else 'test' end, '**all**']) as period from (select 'default' as policy, * from d1 where rn > 0 union all select 'original', * from d2 where rn > 0)), " + CONFUSION.format(key="policy,", rows="both_") + " select policy, period, tp, fp, round(p, 6) as precision, round(r, 6) as recall, case when first > 0 then round(1 - fp / first, 6) end as fewer_wrong_declines from (select *, max(fp) filter (policy = 'original') over (partition by period) as first from measures where point = 'declined')",
    "latency_summary": """with s as (select event_id, epoch_us(ts) // 1000 as sent from events), d as (select event_id, sent + (event_id * 7919) % 1000 + k * 500 as decided from s, (values (0), (1)) v(k) where event_id % 50 <> 0),
m as (select event_id, min(d.decided) - any_value(s.sent) as latency_ms from s left join d using (event_id) group by event_id)
select count(*) as sent, count(latency_ms) as received, count(*) - count(latency_ms) as missing, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95, quantile_disc(latency_ms, 0.99) as p99, max(latency_ms) as max from m""",
    "replay_shift": f"with {TXN} select txn_id, t + ({NOW_MS} - (select arg_min(t, (t, txn_id)) from txn)) as t from txn",
    "first_n": f"with {TXN} select txn_id, card_id, t from txn order by t, txn_id limit 500",
    "dlq_split": "select cast(event_id % 4 as bigint) as src_partition, event_id as src_offset, case when event_id % 10 = 0 then 'MalformedRecord' when event_id % 15 = 1 then 'MissingField' else 'good' end as outcome from events",
    "schema_evolution": "select cast(event_id as varchar) as transaction_id, case when event_id % 2 = 1 then event_type end as device_fingerprint, case when event_id % 2 = 1 and event_id % 3 = 0 then 'USD' else 'EUR' end as currency from events",
    "csv_ingest": "select cast(event_id as varchar) as transaction_id, cast(user_id as varchar) as card_id, case when event_id % 2 = 0 then 'm' || (event_id % 9) else 'fraud_m' || (event_id % 9) end as merchant_id, cast(round(cast(cast(value as decimal(18, 3)) * 100 as decimal(18, 3)), 0) as bigint) as amount_minor, epoch_us(ts) // 1000000 * 1000 as t, event_type = 'error' as labelled_fraud, case when event_id < 700 then 'paymentsTrain' else 'paymentsTest' end as period, case when event_id < 700 then 0 else 1 end as file_rank from events",
    "stream_merchant_windows": DECIDED + ", " + WINDOWS.format(rows="decisions") + f" select merchant_id, window_start, window_end, total, declined, {ratio('declined', 'total')} as decline_rate from windows where window_end <= (select max(t) from decisions) - 30000",
}
EVERY["csv_ingest"] = EVERY["csv_ingest"].replace("case when event_id % 2 = 0 then 'm' || (event_id % 9) else 'fraud_m' || (event_id % 9) end", "'m' || (event_id % 9)")
EVERY["stream_decisions"] = EVERY["decisions"]
EVERY["stream_enriched"] = EVERY["enriched"]
EVERY["stream_live_windows"] = DECIDED + ", " + WINDOWS.format(rows="decisions") + f" select merchant_id, window_start, window_end, total, declined, {ratio('declined', 'total')} as decline_rate from windows"
EVERY["stream_live_state"] = DECIDED + " select card_id, arg_max(coalesce(spend_day, -1), rn) as spend_day, arg_max(coalesce(case when spend_day is not null then spent_minor end, -1), rn) as spent_minor, arg_max(coalesce(last_seen, -1), rn) as last_seen from decisions group by card_id"
EVERY["merchant_lookup"] = EVERY["merchant_windows_latest12"] + f" and merchant_id = {MERCHANT}"
EVERY["card_lookup"] = f"select card_id, spent_today, remaining, last_txn, last_decision, last_rules from ({EVERY['card_risk_view']}) where card_id = {CARD}"
_GAPS = (
    BASE.replace(" as amount_minor,", " as amount_minor_,").replace(" as lat,", " as lat_,").replace(" as lon,", " as lon_,").replace("txn as (select event_id", "txn as (select * exclude (amount_minor_, lat_, lon_), case when txn_id % 29 <> 0 then amount_minor_ end as amount_minor, case when txn_id % 23 <> 0 then lat_ end as lat, case when txn_id % 31 <> 0 then lon_ end as lon from (select event_id").replace(" as source_day from events)", " as source_day from events))")
    .replace("select distinct card_id, case when card_id % 15 = 11", "select distinct on (card_id) card_id, case when card_id % 15 = 11").replace("case card_id % 15 when 13 then 'BLOCKED' when 12 then 'EXPIRED' else 'ACTIVE' end as status, 50000 + (card_id * 7 % 26) * 10000 as daily_limit_minor", "case when card_id % 4 <> 1 then case card_id % 15 when 13 then 'BLOCKED' when 12 then 'EXPIRED' else 'ACTIVE' end end as status, case when card_id % 5 <> 2 then 50000 + (card_id * 7 % 26) * 10000 end as daily_limit_minor")
)
EVERY["decisions_with_gaps"] = _GAPS + fold(500, 45) + f" select txn_id, card_id, decision, score, {RULES} as rules, case when spend_day is not null then spent_minor end as spent_minor, last_seen from decided where rn > 0"
_BAD = """whole as (select event_id as src_offset, '{"transaction_id":"' || event_id || '","card_id":"' || user_id || '","merchant_id":"' || (event_id % 13) || '","amount_minor":100}' as w from events),
bad as (select src_offset, case when src_offset % 10 = 0 then '{"this is": not json ' || src_offset else replace(w, '"amount_minor":100', '"other":1') end as value from whole where src_offset % 10 = 0 or src_offset % 15 = 1)"""
EVERY["dead_letters"] = f"with {_BAD} select src_offset, value, cast(src_offset as varchar) as trace, case when src_offset % 10 = 0 then 'MalformedRecord' else 'MissingField' end as exception_class, case when src_offset % 10 = 0 then 'not a record of the schema; caused by: ' || value else 'required fields are missing: amount_minor' end as message from bad"
EVERY["dead_letter_totals"] = f"with {_BAD} select 'transactions' as src_topic, count(*) as n from bad"
_FILES = "case when event_id < 700 then 'paymentsTrain' else 'paymentsTest' end"
EVERY["csv_first_n"] = f"select cast(event_id as varchar) as transaction_id, {_FILES} as period from events order by event_id >= 700, event_id limit 750"
EVERY["csv_period"] = f"select cast(event_id as varchar) as transaction_id, {_FILES} as period from events where event_id >= 700 order by event_id limit 100"
EVERY["csv_profiles"] = """with c as (select cast(user_id as varchar) as card_id, arg_min(user_id, event_id) as u from events group by user_id),
d as (select *, cast('0x' || substr(md5('42:' || card_id), 1, 8) as bigint) as a, cast('0x' || substr(md5('42:' || card_id), 9, 8) as bigint) as b from c)
select card_id, 'SPARKOV-' || card_id as customer_id, 'ACTIVE' as status, 50000 + a % 26 * 10000 as daily_limit_minor, ['LOW', 'MEDIUM', 'HIGH'][b % 3 + 1] as risk_tier, 'US' as home_country, cast(u as double) as home_lat, cast(2.5 as double) as home_lon from d"""
EVERY["csv_merchants"] = "select 'm' || (event_id % 9) as merchant_id, 'm' || (event_id % 9) as name, 'cat' || (arg_min(event_id, (event_id >= 700, event_id)) % 4) as mcc, 'US' as country, cast(1 as double) as lat, cast(arg_min(event_id, (event_id >= 700, event_id)) as double) as lon from events group by event_id % 9"
EVERY["scalar_texts"] = f"""with r as (select event_id, cast(round(value * 100) as bigint) as c, event_id * 7919 % 500000 as ms, (event_id % 1000) / 1000.0 as share, epoch_us(ts) // 1000 as t from events)
select event_id, {money('c')} as money, {TOOK.format(ms='ms')} as took, case when abs(share * 100) < 1 and share <> 0 then printf('%.2f%%', cast(share * 100 as double)) else printf('%.1f%%', cast(share * 100 as double)) end as percent,
  format('{{:,}}', ms) as many, '$' || format('{{:,}}', cast(round(c / 100) as bigint)) as whole, t // 86400000 as day,
  round(case when ms - 1000 <= 0 then case when c > 0 then cast('inf' as double) else 0.0 end else (c / 100.0) / ((ms - 1000) / 3600000.0) end, 6) as kmh from r"""
_LAST = "l as (select card_id, arg_max(coalesce(spend_day, -1), rn) as d, arg_max(coalesce(case when spend_day is not null then spent_minor end, -1), rn) as m, arg_max(coalesce(last_seen, -1), rn) as s from decisions group by card_id)"
#: The last sweep is the last full minute before the feed's end.
EVERY["stream_swept_state"] = DECIDED + f""", {_LAST}, w as (select (max(t) - 1) // 60000 * 60000 as now from txn)
select card_id, case when d < now // 86400000 then -1 else d end as spend_day, case when d < now // 86400000 then -1 else m end as spent_minor, case when s < now - 60000 then -1 else s end as last_seen,
  (select count(*) from txn x where x.card_id = l.card_id and x.t >= now - 60000) as n_attempts from l, w"""
EVERY["stream_card_state"] = DECIDED + f""", {_LAST}, a as (select min(t) as first_attempt, count(*) as n from txn where card_id = {CARD} and t // 60000 >= ((select max(t) from txn where card_id = {CARD}) - 4200000) // 60000)
select card_id, nullif(d, -1) as spend_day, nullif(m, -1) as spent_minor, nullif(s, -1) as last_seen, cast(n as int) as n_attempts, first_attempt from l, a where card_id = {CARD}"""
EVERY["stream_state_changes"] = DECIDED + f", {_LAST} select cast(0 as bigint) as batch_id, 'update' as change_type, card_id, s as last_seen from l where s <> -1"
EVERY["stream_restart"] = EVERY["decisions"]
EVERY["stream_chained_windows"] = EVERY["stream_merchant_windows"]
EVERY["stream_windows_late"] = EVERY["merchant_windows_late"]
EVERY["stream_totals"] = DECIDED + f", {REASONS} select 'verdict' as kind, decision as name, count(*) as n from decisions group by decision union all select 'rule', rule, count(*) from reasons group by rule"
EVERY["stream_profiles"] = """with c as (select cast(user_id as varchar) as card_id, max(event_id) as e, arg_max(event_type, event_id) as status from events where event_id % 3 = 0 group by user_id),
u as (select event_id * 7 % 97 as k, max(event_id) as e, arg_max(event_type, event_id) as tier from events where event_id % 3 = 1 group by event_id * 7 % 97)
select card_id, cast(k as varchar) as customer_id, status, c.e as daily_limit_minor, tier as risk_tier, cast(u.e % 11 as varchar) as home_country, cast(u.e % 90 as double) as home_lat, cast(u.e % 180 as double) as home_lon from c join u on c.e * 31 % 97 = k where status <> 'error' and u.e % 5 <> 0"""
EVERY["stream_dead_letters"] = EVERY["dlq_split"]
EVERY["decisions_by_days"] = DECIDED + " select txn_id, card_id, decision, score, cast(unknown as int) + cast(inactive as int) + cast(fast as int) + cast(testing as int) + cast(daily as int) + cast(geo > 0 as int) + cast(risky as int) + cast(tiered as int) as n_reasons, coalesce(spend_day, -1) as spend_day, case when spend_day is not null then spent_minor else -1 end as spent_minor, round(coalesce(last_lat, -999), 6) as last_lat, coalesce(last_seen, -1) as last_seen, coalesce(last_place, '?') as last_place from decisions"
EVERY["null_guard"] = f"with {TXN}, {DIMS} select txn_id, p.card_id is not null as has_profile, m.merchant_id is not null as has_merchant from txn x left join profiles p using (card_id) left join merchants m using (merchant_id) where txn_id % 10 <> 0"


def _percent(x: str) -> str:
    return f"case when abs({x} * 100) < 1 and {x} <> 0 then printf('%.2f%%', cast({x} * 100 as double)) else printf('%.1f%%', cast({x} * 100 as double)) end"


def _dollars(x: str) -> str:
    return f"'$' || format('{{:,}}', cast(round({x} / 100) as bigint))"


EVERY["evaluation_summary"] = BOTH + ", " + CONFUSION.format(key="", rows="both_") + f""", d as (select * from measures where point = 'declined'), f as (select * from measures where point = 'flagged')
select period, format('{{:,}}', d.tp + d.fp + d.fn + d.tn) as transactions, format('{{:,}}', d.tp + d.fn) as frauds, {_percent('((d.tp + d.fn) / (d.tp + d.fp + d.fn + d.tn))')} as base_rate, {_dollars('d.fraud_minor')} as fraud,
  {_percent('d.r')} as declined_recall, {_percent('d.p')} as declined_precision, {_dollars('d.caught_minor')} as declined_caught, {_percent('f.r')} as flagged_recall, {_percent('f.p')} as flagged_precision, {_dollars('f.caught_minor')} as flagged_caught from d join f using (period)"""
EVERY["long_messages"] = "select event_id as src_offset, case when length(w) > 1000 then substr(w, 1, 1000) || '...' else w end as message from (select event_id, 'not a record of the schema; caused by: {' || repeat('x', event_id % 1500) as w from events)"
EVERY["symbols"] = "select event_id, case event_type when 'click' then 'BLOCKED' when 'view' then 'EXPIRED' else 'ACTIVE' end as status, 'LOW' as risk_tier from events"
EVERY["schema_evolution_files"] = EVERY["schema_evolution"]
