"""The checking SQL of each registered query, written independently of the Spark plans."""

from __future__ import annotations


from ..sources.projection import ALERTS_SQL, EVENTS_SQL

ORACLE: dict[str, str] = {}

# Named sub-selects; a query lists the ones it needs, in dependency order.
CTES: dict[str, str] = {"ev": EVENTS_SQL, "al": ALERTS_SQL}


def add(name: str, uses: str, body: str, recursive: bool = False) -> None:
    parts = ", ".join(f"{u} as ({CTES[u]})" for u in uses.split())
    word = "with recursive" if recursive else "with"
    ORACLE[name] = f"{word} {parts} {body}" if parts else body


def floor_to(minutes: int, ts: str = "ts") -> str:
    return (
        f"(date_trunc('minute', {ts}) - to_minutes(cast(minute({ts}) % {minutes} as integer)))"
    )


FEATURES = [
    "auth_failures", "auth_successes", "distinct_users_in_window", "distinct_dst_ips",
    "distinct_dst_ports", "deny_rate", "bytes_sum", "process_exec_count", "rare_command_count",
    "max_rare_command_score", "login_hour_deviation_z", "event_sequence_len", "sources_count",
]

CTES["freq"] = """select command, count(*) as freq from ev
 where source = 'process' and command <> '' group by command"""
CTES["profile"] = """select user_name, count(*) as logins, avg(hour(ts)) as mean_hour,
 stddev_pop(hour(ts)) + 1e-6 as std_hour from ev
 where source = 'auth' and event_type = 'login_success' and user_name <> ''
 group by user_name having count(*) >= 5"""
CTES["feat"] = f"""select e.user_name, e.ip, {floor_to(5, 'e.ts')} as start_ts,
 {floor_to(5, 'e.ts')} + interval 5 minute as end_ts,
 count(*) filter (source = 'auth' and event_type = 'login_failure') as auth_failures,
 count(*) filter (source = 'auth' and event_type = 'login_success') as auth_successes,
 count(distinct nullif(e.user_name, '')) as distinct_users_in_window,
 count(distinct nullif(dst_ip, '')) filter (source = 'network') as distinct_dst_ips,
 count(distinct nullif(dst_port, 0)) filter (source = 'network') as distinct_dst_ports,
 coalesce(count(*) filter (source = 'network' and action = 'deny')
  / nullif(cast(count(*) filter (source = 'network') as double), 0), 0) as deny_rate,
 cast(coalesce(sum(bytes) filter (source = 'network'), 0) as bigint) as bytes_sum,
 count(*) filter (source = 'process') as process_exec_count,
 count(*) filter (source = 'process' and freq <= 3) as rare_command_count,
 coalesce(max(1.0 / cast(freq as double)) filter (source = 'process' and freq <= 3), 0)
  as max_rare_command_score,
 coalesce(max(abs(hour(ts) - mean_hour) / std_hour)
  filter (source = 'auth' and event_type = 'login_success'), 0) as login_hour_deviation_z,
 count(*) as event_sequence_len, count(distinct source) as sources_count
 from ev e left join freq f on e.command = f.command
 left join profile p on e.user_name = p.user_name
 group by 1, 2, 3, 4"""
FLAGS_SQL = """
 bool_or(coalesce(user_name like 'svc\\_%' escape '\\' or user_name like 'service\\_%' escape '\\'
  or user_name ilike '%backup%' or user_name ilike '%deploy%', false)) as service_account,
 bool_or(source = 'network' and coalesce(dst_port in (22,3389,5985,5986,445,135), false))
  as admin_port,
 bool_or(source = 'network' and coalesce(dst_ip <> '' and not (dst_ip like '10.%'
  or dst_ip like '192.168.%' or dst_ip like '172.%'), false)) as external_dst,
 bool_or(source = 'network') as has_network, bool_or(source = 'auth') as has_auth,
 bool_or(source = 'process') as has_process,
 count(*) filter (source = 'auth' and event_type in ('login_success','login_failure'))
  as login_events,
 bool_or(coalesce(source = 'process' and (command like '%useradd%' or command like '%chpasswd%'),
  false)) as makes_accounts,
 bool_or(coalesce(source = 'process' and (command like 'ssh %' or command like '%ssh -o%'),
  false)) as runs_ssh,
 bool_or(coalesce(source = 'process' and (command like '%curl %' or command like '%wget %'),
  false)) as downloads,
 count(distinct nullif(host, '')) as n_hosts"""
CTES["flags"] = f"select user_name, ip, {floor_to(5)} as start_ts, {FLAGS_SQL} from ev group by 1, 2, 3"

ROUNDED_FEATURES = ", ".join(
    f"round({f}, 6) as {f}"
    if f in ("deny_rate", "max_rare_command_score", "login_hour_deviation_z")
    else f
    for f in FEATURES
)

add("window_features", "ev freq profile feat",
    f"select user_name, ip, start_ts, end_ts, {ROUNDED_FEATURES} from feat")
add("stream_features", "ev freq profile feat",
    f"select user_name, ip, start_ts, end_ts, {ROUNDED_FEATURES} from feat")
add("stream_windows", "ev freq profile feat", """select user_name, ip, start_ts, end_ts, auth_failures,
 auth_successes, distinct_dst_ips, distinct_dst_ports, round(deny_rate, 6) as deny_rate, bytes_sum,
 process_exec_count, event_sequence_len, distinct_users_in_window, sources_count from feat""")
add("window_bounds", "ev",
    f"select event_id, {floor_to(5)} as start_ts, {floor_to(5)} + interval 5 minute as end_ts from ev")
add("command_frequency", "ev freq", "select * from freq")
add("rare_commands", "ev freq",
    "select event_id, command, freq from ev join freq using (command) where freq <= 3")
add("user_hour_profile", "ev profile",
    "select user_name, logins, round(mean_hour, 6) as mean_hour, round(std_hour, 6) as std_hour "
    "from profile")
add("login_deviation", "ev profile",
    "select event_id, ts, user_name, ip, round(abs(hour(ts) - mean_hour) / std_hour, 6) as hour_z "
    "from ev join profile using (user_name) where source = 'auth' and event_type = 'login_success'")
add("entity_flags", "ev flags", "select * from flags")

CTES["melt"] = " union all ".join(
    f"select '{f}' as feature, {i} as pos, cast({f} as double) as x, user_name, ip, start_ts from feat"
    for i, f in enumerate(FEATURES)
)
CTES["stats"] = """select feature, pos, count(*) as n, avg(x) as mean, stddev_pop(x) + 1e-6 as std,
 quantile_cont(x, 0.05) as p5, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50,
 quantile_cont(x, 0.75) as p75, quantile_cont(x, 0.95) as p95, quantile_cont(x, 0.99) as p99
 from melt group by 1, 2"""
add("feature_stats", "ev freq profile feat melt stats",
    "select feature, n, " + ", ".join(f"round({c}, 6) as {c}" for c in
    ("mean", "std", "p5", "p25", "p50", "p75", "p95", "p99")) + " from stats")


def sid(*parts: str) -> str:
    text = " || ".join(f"coalesce(cast({p} as varchar), '-') || '|'" for p in parts)
    return f"substr(sha256({text}), 1, 16)"


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({ts}) % 1000000 = 0 then '' "
        f"else strftime({ts}, '.%f') end || 'Z'"
    )


FAIL = "source = 'auth' and event_type in ('login_failure', 'authentication_failure') and ip <> ''"
SUCC = (
    "source = 'auth' and event_type in ('login_success', 'authentication_success') "
    "and ip <> '' and user_name <> ''"
)


def rule_cols(name: str, confidence: str, text: str) -> str:
    return (
        f"{sid(chr(39) + name + chr(39), 'user_name', 'ip', iso('start_ts'), iso('end_ts'))} as rule_id, "
        f"'{name}' as rule_name, round(least(1.0, {confidence}), 6) as confidence, {text} as description, "
        "user_name, ip, start_ts, end_ts, n_events"
    )


BRUTE_TEXT = "'Brute force detected: ' || n_events || ' failed logins from ' || ip || ' in 5 minutes'"
CTES["brute_frame"] = f"""select ip, ts, event_id, count(*) over (partition by ip order by ts
 range between unbounded preceding and interval 5 minutes following) as n from ev where {FAIL}"""
CTES["brute_hit"] = """select ip, min_by(ts, (ts, event_id)) as fire_ts, min_by(n, (ts, event_id)) as n_events
 from brute_frame where n >= 5 group by ip"""
CTES["brute_base"] = """select h.ip, cast(null as varchar) as user_name, n_events,
 (select min(ts) from brute_frame f where f.ip = h.ip) as start_ts,
 (select max(ts) from brute_frame f where f.ip = h.ip and f.ts <= h.fire_ts + interval 5 minutes) as end_ts
 from brute_hit h"""
CTES["brute"] = f"select {rule_cols('brute_force', 'n_events / 10.0', BRUTE_TEXT)} from brute_base"
CTES["slide_frame"] = f"""select ip, ts, event_id, count(*) over w as n, max(ts) over w as end_ts from ev where {FAIL}
 window w as (partition by ip order by ts range between current row and interval 5 minutes following)"""
CTES["slide_base"] = """select ip, cast(null as varchar) as user_name, ts as start_ts, end_ts, n as n_events
 from slide_frame where n >= 5 qualify row_number() over (partition by ip order by ts, event_id) = 1"""
CTES["slide"] = f"select {rule_cols('brute_force', 'n_events / 10.0', BRUTE_TEXT)} from slide_base"
CTES["logins"] = f"""select user_name as who, ip as ip_to, ts as end_ts, event_id as event_to,
 lag(ip) over w as ip_from, lag(ts) over w as start_ts, lag(event_id) over w as event_from from ev
 where {SUCC} window w as (partition by user_name order by ts, event_id)"""
CTES["travel_base"] = """select *, who as user_name, cast(null as varchar) as ip, 2 as n_events,
 (epoch_us(end_ts) - epoch_us(start_ts)) / 3600000000.0 as hours from logins
 where ip_from <> ip_to and end_ts > start_ts"""
TRAVEL_TEXT = (
    "'Impossible travel: ' || user_name || ' logged in from ' || ip_from || ' then ' || ip_to || "
    "' within ' || printf('%.2f', hours) || ' hours (required speed: ' || printf('%.0f', 100.0 / hours) || ' km/h)'"
)
CTES["travel"] = f"""select {rule_cols('impossible_travel', '100.0 / hours / 1800.0', TRAVEL_TEXT)},
 ip_from, ip_to, event_from, event_to from travel_base where 100.0 / hours > 900.0"""
CTES["moves_base"] = f"""select ip, {floor_to(1)} as bucket_ts, cast(null as varchar) as user_name,
 count(distinct host) as n_hosts, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_events
 from ev where source in ('network','auth') and ip <> '' and host <> '' group by 1, 2
 having count(distinct host) >= 3"""
MOVE_TEXT = (
    "'Lateral movement detected: ' || ip || ' accessed ' || n_hosts || ' distinct hosts in 10 minutes'"
)
CTES["moves"] = f"""select {rule_cols('lateral_movement', 'n_hosts / 6.0', MOVE_TEXT)}, n_hosts, bucket_ts
 from moves_base"""
RULE = "rule_id, rule_name, confidence, description, user_name, ip, start_ts, end_ts, n_events"
CTES["rules"] = " union all ".join(f"select {RULE} from {t}" for t in ("brute", "travel", "moves"))
BRUTE = "ev brute_frame brute_hit brute_base brute"
TRAVEL = "logins travel_base travel"
MOVES = "moves_base moves"
RULES = f"{BRUTE} {TRAVEL} {MOVES} rules"
CTES["rule_all"] = f"""select b.rule_id, f.event_id, row_number() over (partition by b.rule_id
   order by f.ts, f.event_id) as rn from brute_frame f join brute b on f.ip = b.ip and f.ts <= b.end_ts
 union all select rule_id, event_from, 1 from travel union all select rule_id, event_to, 1 from travel
 union all select m.rule_id, e.event_id, row_number() over
  (partition by m.rule_id order by e.ts, e.event_id) as rn from ev e join moves m on e.ip = m.ip
  and {floor_to(1, 'e.ts')} = m.bucket_ts where source in ('network','auth') and host <> ''"""
CTES["rule_ev"] = "select rule_id, event_id from rule_all where rn <= 20"

add("rule_brute_force", BRUTE, "select * from brute")
add("rule_brute_force_sliding", "ev slide_frame slide_base slide", "select * from slide")
add("rule_impossible_travel", f"ev {TRAVEL}", "select * from travel")
add("rule_lateral_movement", f"ev {MOVES}", "select * from moves")
add("all_rules", RULES, "select * from rules")
add("stream_rules", RULES, "select * from rules")
add("rule_evidence", f"{RULES} rule_all rule_ev", "select * from rule_ev")
add("rule_evidence_all", f"{RULES} rule_all", "select rule_id, event_id from rule_all")
add("lateral_hosts", f"ev {MOVES}", f"""select distinct rule_id, host from ev e join moves m
 on e.ip = m.ip and {floor_to(1, 'e.ts')} = m.bucket_ts where source in ('network','auth') and host <> ''""")

SESS_ID = "'sess_' || " + sid("user_name", "ip", iso("session_start"))
CTES["gaps"] = """select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minutes
 then 1 else 0 end as opens from ev window w as (partition by user_name, ip order by ts, event_id)"""
CTES["numbered"] = """select *, sum(opens) over (partition by user_name, ip order by ts, event_id
 rows unbounded preceding) as session_no from gaps"""
CTES["started"] = """select *, min(ts) over (partition by user_name, ip, session_no) as session_start
 from numbered"""
CTES["sev"] = f"select *, {SESS_ID} as session_id from started"
SESS = "ev gaps numbered started sev"
CTES["sess"] = """select session_id, user_name, ip, session_start as start_ts, max(ts) as end_ts,
 count(*) as n_events from sev group by 1, 2, 3, 4"""
add("sessions", f"{SESS} sess", "select * from sess")
add("session_events", SESS, "select session_id, event_id from sev")
add("sessions_by_key", f"{SESS} sess",
    "select user_name, ip, cast(row_number() over (partition by user_name, ip order by start_ts, session_id) "
    "as integer) as position, session_id from sess")
add("stream_sessions", f"{SESS} sess", "select user_name, ip, start_ts, end_ts, n_events from sess")

TOKEN = """case when source = 'process' and (command like '%curl %' or command like '%wget %') then 'process:download'
 when source = 'process' and (command like '%useradd%' or command like '%chpasswd%') then 'process:account_create'
 when source = 'process' and command like '%ssh %' then 'process:ssh'
 when source = 'network' and dst_port in (4444, 8081, 1337, 9001) then 'network:rare_port'
 else source || ':' || event_type end"""
CTES["vocab"] = f"""select token, n, cast(row_number() over (order by n desc, token) + 1 as integer) as token_id
 from (select {TOKEN} as token, count(*) as n from ev group by 1 having count(*) >= 2)"""
CTES["tok"] = f"select *, {TOKEN} as token from sev"
CTES["tail"] = """select session_id, user_name, ip, ts, event_id, coalesce(token_id, 1) as token_id
 from (select * from tok qualify row_number() over (partition by session_id order by ts desc, event_id desc) <= 64)
 left join vocab using (token)"""
TAIL = f"{SESS} vocab tok tail"
add("token_vocab", "ev vocab", "select * from vocab")
add("token_sequences", TAIL, """select session_id, cast(count(*) as integer) as length,
 string_agg(cast(token_id as varchar), ' ' order by ts, event_id) as ids from tail group by 1""")
CTES["bigram"] = """select *, coalesce(lag(token_id) over (partition by session_id order by ts, event_id), 0)
 as prev_id from tail"""
CTES["pairn"] = "select prev_id, token_id, count(*) as n_pair from bigram group by 1, 2"
CTES["ctxn"] = "select prev_id, count(*) as n_context from bigram group by 1"
CTES["surp"] = """select session_id, count(*) as length,
 avg(-ln((n_pair + 1.0) / (n_context + (select count(*) + 1 from vocab)))) as raw_score
 from bigram join pairn using (prev_id, token_id) join ctxn using (prev_id) group by 1"""
SURP = f"{TAIL} bigram pairn ctxn surp"
add("sequence_surprisal", SURP,
    "select session_id, length, round(raw_score, 6) as raw_score from surp")

FEAT = "ev freq profile feat"
STATS = f"{FEAT} melt stats"
CTES["zs"] = """select m.*, abs(x - mean) / std as z, case when x <= p5 then 5.0 when x <= p25 then 15.0
 when x <= p50 then 37.5 when x <= p75 then 62.5 when x <= p95 then 85.0 when x <= p99 then 97.0
 else 99.5 end as percentile from melt m join stats s using (feature)"""
CTES["wraw"] = "select user_name, ip, start_ts, max(z) as raw_score from zs group by 1, 2, 3"


def scaled(x: str, table: str) -> str:
    lo, hi = (f"(select quantile_cont({x}, {q}) from {table})" for q in (0.1, 0.9))
    return f"greatest(0.0, least(1.0, (({x}) - {lo}) / greatest(1e-6, {hi} - {lo})))"


CTES["wscore"] = f"select *, {scaled('raw_score', 'wraw')} as window_score from wraw"
WSCORE = f"{STATS} zs wraw wscore"
add("baseline_window_score", WSCORE, """select user_name, ip, start_ts, round(raw_score, 6) as raw_score,
 round(window_score, 6) as window_score from wscore""")
add("quantile_scale", FEAT, f"""select user_name, ip, start_ts, bytes_sum,
 round({scaled('bytes_sum', 'feat')}, 6) as bytes_scaled from feat""")
CTES["ztop"] = """select *, row_number() over (partition by user_name, ip, start_ts order by z desc, pos) as rank
 from zs"""
add("explain_features", f"{STATS} zs ztop", """select user_name, ip, start_ts, cast(rank as integer) as rank, feature,
 round(x, 6) as value, round(z, 2) as z_score, cast(percentile as double) as percentile,
 printf('%.1fth percentile', cast(percentile as double)) as percentile_text,
 round(z, 2) as attribution from ztop where rank <= 5""")
CTES["zin"] = """select *, abs(x - avg(x) over w) / (stddev_pop(x) over w + 1e-6) as z from melt
 window w as (partition by user_name, ip, start_ts)"""
CTES["zintop"] = """select *, row_number() over (partition by user_name, ip, start_ts order by z desc, pos) as rank
 from zin"""
add("explain_features_within", f"{FEAT} melt zin zintop", """select user_name, ip, start_ts,
 cast(rank as integer) as rank, feature, round(x, 6) as value, round(z, 2) as z_score,
 50.0::double as percentile, round(z, 2) as attribution from zintop where rank <= 3""")


# ---------------------------------------------------------------- signals and correlation

FLAG_NAMES = (
    "service_account admin_port external_dst has_network has_auth has_process login_events "
    "makes_accounts runs_ssh downloads n_hosts"
).split()


def detection_case(prefix: str = "") -> str:
    f = {k: f"coalesce({prefix}{k}, 0)" for k in FEATURES}
    return f"""case when {f['auth_failures']} >= 15 then 'credential_stuffing'
 when {f['auth_failures']} >= 10 or ({f['auth_failures']} >= 5 and {f['auth_successes']} >= 1) then 'brute_force_login'
 when {f['distinct_dst_ports']} >= 5 and {f['bytes_sum']} < 1000000 then 'port_scan'
 when {f['distinct_dst_ips']} >= 3 and admin_port then 'lateral_movement_attempt'
 when {f['bytes_sum']} > 10000000 or ({f['bytes_sum']} > 5000000 and external_dst) then 'exfil_spike'
 when service_account and ({f['rare_command_count']} > 0 or {f['process_exec_count']} > 10) then 'service_acct_abuse'
 when not (window_score > 0.7 or sequence_score > 0.7) then 'unknown'
 when has_auth and login_events >= 5 and n_ips <= 2 then 'bruteforce'
 when n_hosts >= 3 or ({f['distinct_dst_ips']} >= 3 and admin_port) then 'lateral_movement'
 when {f['bytes_sum']} > 5000000 then 'exfil_spike'
 when service_account and has_process then 'abnormal_service_usage'
 when has_network and {f['distinct_dst_ports']} >= 3 and {f['bytes_sum']} < 500000 then 'port_scan'
 else 'anomalous_behavior' end"""


CATEGORY = """case when detection_type in ('credential_stuffing','brute_force_login','bruteforce') then 'authentication'
 when detection_type = 'port_scan' then 'network_recon'
 when detection_type in ('lateral_movement_attempt','lateral_movement') then 'lateral_movement'
 when detection_type = 'exfil_spike' then 'exfiltration'
 when detection_type in ('service_acct_abuse','abnormal_service_usage') then 'privilege_misuse'
 when detection_type = 'anomalous_behavior' then 'suspicious_activity' else 'unknown' end"""
CLASS_KEYS = """case when detection_type in ('credential_stuffing','bruteforce') then ['bruteforce']
 when detection_type = 'brute_force_login' then case when coalesce(auth_successes, 0) >= 1 then ['bruteforce','valid_accounts'] else ['bruteforce'] end
 when detection_type = 'port_scan' then ['port_scan']
 when detection_type in ('lateral_movement_attempt','lateral_movement') then ['remote_services']
 when detection_type = 'exfil_spike' then ['ingress_tool_transfer']
 when detection_type = 'service_acct_abuse' then ['valid_accounts','account_manipulation']
 when detection_type in ('abnormal_service_usage','anomalous_behavior') then ['valid_accounts']
 else cast([] as varchar[]) end"""
WINDOW_KEYS = """(case when auth_failures >= 15 and auth_successes >= 1 then ['bruteforce','valid_accounts']
 when auth_failures >= 20 then ['bruteforce'] else cast([] as varchar[]) end
 || case when rare_command_count >= 1 then ['ingress_tool_transfer'] else cast([] as varchar[]) end
 || case when distinct_dst_ports >= 3 and bytes_sum > 250000 then ['command_and_control'] else cast([] as varchar[]) end)"""
EVIDENCE_KEYS = """(case when makes_accounts then ['account_manipulation'] else cast([] as varchar[]) end
 || case when runs_ssh then ['remote_services'] else cast([] as varchar[]) end
 || case when downloads then ['ingress_tool_transfer'] else cast([] as varchar[]) end)"""


def sorted_keys(*lists: str) -> str:
    return f"list_sort(list_distinct({' || '.join(lists)}))"


CTES["wfull"] = f"""select f.*, {', '.join('g.' + n for n in FLAG_NAMES)}, s.window_score, 0.0::double as sequence_score,
 case when f.ip <> '' then 1 else 0 end as n_ips from feat f
 join flags g on f.user_name is not distinct from g.user_name and f.ip is not distinct from g.ip and f.start_ts = g.start_ts
 join wscore s on f.user_name is not distinct from s.user_name and f.ip is not distinct from s.ip and f.start_ts = s.start_ts"""
CTES["wclass0"] = f"select *, {detection_case()} as detection_type from wfull"
CTES["wclass"] = f"""select *, {CATEGORY} as category, {sorted_keys(WINDOW_KEYS, EVIDENCE_KEYS, CLASS_KEYS)} as mitre_keys
 from wclass0"""
WCLASS = f"{WSCORE} flags wfull wclass0 wclass"
FEATURE_LIST = ", ".join(f"cast({f} as double) as {f}" for f in FEATURES)
NO_FEATURES = ", ".join(f"cast(null as double) as {f}" for f in FEATURES)
FLAG_LIST = ", ".join(n for n in FLAG_NAMES if n != "n_hosts")
CTES["sigw"] = f"""select 'win_' || {sid('user_name', 'ip', iso('start_ts'))} as signal_id, 'window_anomaly' as kind,
 start_ts, end_ts, user_name, ip, window_score as score, window_score, sequence_score, 0.0::double as final_risk,
 detection_type, category, mitre_keys, {FLAG_LIST}, {FEATURE_LIST} from wclass where window_score >= 0.25"""
CTES["sflags"] = f"select session_id, {FLAGS_SQL} from sev group by 1"
CTES["sscore"] = f"select session_id, {scaled('raw_score', 'surp')} as sequence_score from surp"
CTES["sfull"] = f"""select s.*, {', '.join('g.' + n for n in FLAG_NAMES)}, q.sequence_score, 0.0::double as window_score,
 case when s.ip <> '' then 1 else 0 end as n_ips, {NO_FEATURES} from sess s join sflags g using (session_id)
 join sscore q using (session_id)"""
CTES["sclass0"] = f"select *, {detection_case()} as detection_type from sfull"
CTES["sigs"] = f"""select session_id as signal_id, 'sequence_anomaly' as kind, start_ts, end_ts, user_name, ip,
 sequence_score as score, window_score, sequence_score, 0.0::double as final_risk, detection_type, {CATEGORY} as category,
 {sorted_keys("case when len(" + EVIDENCE_KEYS + ") > 0 then " + EVIDENCE_KEYS + " else ['valid_accounts'] end", CLASS_KEYS)} as mitre_keys,
 {FLAG_LIST}, {', '.join(FEATURES)} from sclass0 where sequence_score >= 0.25"""
CTES["sigm"] = "select * from sigw union all select * from sigs"
CTES["fused"] = """select r.*, m.model_score, case when m.model_score > 0 then 0.7 * confidence_raw + 0.3 * m.model_score
  else confidence_raw end as final_score
 from (select *, case rule_name when 'brute_force' then least(1.0, n_events / 10.0)
  when 'impossible_travel' then least(1.0, 100.0 / ((epoch_us(end_ts) - epoch_us(start_ts)) / 3600000000.0) / 1800.0)
  else confidence end as confidence_raw from rules) r
 join lateral (select coalesce(max(score), 0) as model_score from sigm s
  where s.ip = r.ip or s.user_name = r.user_name) m on true"""
CTES["rflags"] = f"""select rule_id, {FLAGS_SQL} from rule_all join ev using (event_id) group by 1"""
CTES["sigr"] = f"""select rule_id as signal_id, 'rule_' || rule_name as kind, start_ts, end_ts, user_name, ip,
 final_score as score, model_score as window_score, 0.0::double as sequence_score, final_score as final_risk,
 rule_name as detection_type, 'rule_based' as category, [rule_name] as mitre_keys, {FLAG_LIST}, {NO_FEATURES}
 from fused join rflags using (rule_id)"""
CTES["sig"] = "select * from sigm union all select * from sigr"
SIGM = f"{WCLASS} gaps numbered started sev sess vocab tok tail bigram pairn ctxn surp sigw sflags sscore sfull sclass0 sigs sigm"
SIG = f"{SIGM} {RULES[3:]} rule_all fused rflags sigr sig"


def flat_signal(table: str, where: str = "") -> str:
    return f"""select signal_id, kind, start_ts, end_ts, user_name, ip, round(score, 6) as score,
 round(window_score, 6) as window_score, round(sequence_score, 6) as sequence_score, round(final_risk, 6) as final_risk,
 detection_type, category, array_to_string(mitre_keys, ',') as mitre_keys from {table} {where}"""


add("classify_windows", WCLASS, """select user_name, ip, start_ts, round(window_score, 6) as window_score, detection_type,
 category, array_to_string(mitre_keys, ',') as mitre_keys from wclass""")
add("signal_filter", WSCORE,
    "select user_name, ip, start_ts, round(window_score, 6) as window_score from wscore where window_score >= 0.25")
add("signals_window", f"{WCLASS} sigw", flat_signal("sigw"))
add("signals_sequence", SIGM, flat_signal("sigs"))
add("rule_fusion", f"{SIGM} {RULES[3:]} fused", """select rule_id, rule_name, confidence, round(model_score, 6) as model_score,
 round(final_score, 6) as final_score from fused""")
add("signals", SIG, flat_signal("sig"))
CTES["mitre"] = """select * from (values ('bruteforce','Credential Access','Brute Force','T1110'),
 ('valid_accounts','Defense Evasion','Valid Accounts','T1078'),
 ('command_and_control','Command and Control','Application Layer Protocol','T1071'),
 ('ingress_tool_transfer','Command and Control','Ingress Tool Transfer','T1105'),
 ('account_manipulation','Persistence','Account Manipulation','T1098'),
 ('remote_services','Lateral Movement','Remote Services','T1021'),
 ('port_scan','Discovery','Network Service Scanning','T1046'),
 ('brute_force','Credential Access','Brute Force','T1110'),
 ('impossible_travel','Defense Evasion','Valid Accounts','T1078'),
 ('lateral_movement','Lateral Movement','Remote Services','T1021'))
 as t(mitre_key, tactic, technique, technique_id)"""
add("mitre_map", f"{SIG} mitre", """select distinct signal_id, technique_id, technique, tactic
 from (select signal_id, unnest(mitre_keys) as k from sig) join mitre on k = mitre_key""")

CTES["ent"] = """select *, case when user_name <> '' then 'user:' || user_name when ip <> '' then 'ip:' || ip end as entity
 from sig where user_name <> '' or ip <> ''"""
CTES["ent1"] = """select *, case when start_ts <= max(end_ts) over (partition by entity order by start_ts, signal_id
 rows between unbounded preceding and 1 preceding) + interval 20 minute then 0 else 1 end as opens from ent"""
CTES["ent2"] = """select *, sum(opens) over (partition by entity order by start_ts, signal_id rows unbounded preceding)
 as no from ent1"""
CTES["ent3"] = """select *, min(start_ts) over (partition by entity, no) as cluster_start,
 count(*) over (partition by entity, no) as size, max(no) over (partition by entity) as last_no from ent2"""
CTES["ent4"] = f"select *, {sid('entity', iso('cluster_start'))} as cluster_id from ent3"
CTES["clus"] = "select * from ent4 where size >= 2"
CLUS = f"{SIG} ent ent1 ent2 ent3 ent4 clus"
add("correlate_clusters", CLUS, "select signal_id, entity, cluster_start, cluster_id from clus")
add("correlate_latest", CLUS,
    "select signal_id, entity, cluster_start, cluster_id from clus where no = last_no")
CTES["sighost"] = f"""select 'win_' || {sid('user_name', 'ip', iso(floor_to(5)))} as signal_id, host from ev where host <> ''
 union select session_id, host from sev where host <> ''
 union select rule_id, host from rule_all join ev using (event_id) where host <> ''"""
CTES["sigip"] = """select signal_id, ip from sig where ip <> ''
 union select rule_id, ip from rule_all join ev using (event_id) where ip <> ''"""
CTES["chost"] = "select cluster_id, count(distinct host) as n_hosts from clus join sighost using (signal_id) group by 1"
CTES["cip"] = "select cluster_id, count(distinct i.ip) as n_ips from clus join sigip i using (signal_id) group by 1"
CORDER = "(start_ts, case kind when 'window_anomaly' then 0 when 'sequence_anomaly' then 1 else 2 end, signal_id)"
CTES["csum0"] = f"""select cluster_id, entity, count(*) as n_signals, min(start_ts) as start_ts, max(end_ts) as end_ts,
 avg(window_score) filter (window_score > 0) as aw, avg(sequence_score) filter (sequence_score > 0) as asq,
 max(greatest(0, least(1, score))) as mx, avg(greatest(0, least(1, score))) as av,
 nullif(first(user_name order by {CORDER}), '') as primary_user, nullif(first(ip order by {CORDER}), '') as primary_ip,
 list_sort(list_distinct(list(kind))) as kinds, list_sort(list_distinct(flatten(list(mitre_keys)))) as signal_keys,
 {', '.join(('cast(sum(login_events) as bigint)' if n == 'login_events' else f'bool_or({n})') + f' as {n}' for n in FLAG_NAMES if n != 'n_hosts')},
 {', '.join(f"first({f} order by {CORDER}) filter (auth_failures is not null) as {f}" for f in FEATURES)}
 from clus group by 1, 2"""
CTES["csum1"] = """select c.* exclude (aw, asq, mx, av), coalesce(aw, 0) as window_score, coalesce(asq, 0) as sequence_score,
 case when aw is not null or asq is not null then 0.6 * coalesce(aw, 0) + 0.4 * coalesce(asq, 0)
 else 0.5 * mx + 0.5 * av end as raw_risk, coalesce(n_hosts, 0) as n_hosts, coalesce(n_ips, 0) as n_ips
 from csum0 c left join chost using (cluster_id) left join cip using (cluster_id)"""
CTES["csum2"] = f"select *, {detection_case()} as detection_type from csum1"
CTES["csum"] = f"""select *, {CATEGORY} as category, {sorted_keys('signal_keys', CLASS_KEYS)} as mitre_keys,
 'inc_' || substr(cluster_id, 1, 12) as incident_id, 'al_' || substr(cluster_id, 1, 12) as alert_id from csum2"""
CSUM = f"{CLUS} sighost sigip chost cip csum0 csum1 csum2 csum"
add("incident_summary", CSUM, """select cluster_id, entity, n_signals, start_ts, end_ts, primary_user, primary_ip,
 round(window_score, 6) as window_score, round(sequence_score, 6) as sequence_score, round(raw_risk, 6) as raw_risk,
 array_to_string(kinds, ',') as kinds, service_account, admin_port, external_dst, login_events, n_hosts, n_ips,
 detection_type, category, array_to_string(mitre_keys, ',') as mitre_keys from csum""")

CTES["cmelt"] = " union all ".join(
    f"select cluster_id, signal_id, start_ts, kind, '{f}' as feature, {i} as pos, {f} as x from clus where auth_failures is not null"
    for i, f in enumerate(FEATURES)
)
CTES["cz"] = """select c.*, abs(x - mean) / std as z, case when x <= p5 then 5.0 when x <= p25 then 15.0 when x <= p50 then 37.5
 when x <= p75 then 62.5 when x <= p95 then 85.0 when x <= p99 then 97.0 else 99.5 end as percentile
 from cmelt c join stats s using (feature)"""
CTES["ctop3"] = """select *, round(z, 2) as z2, row_number() over (partition by cluster_id, signal_id order by z desc, pos) as i
 from cz qualify i <= 3"""
CTES["cbest"] = f"""select * from ctop3 qualify row_number() over (partition by cluster_id, feature
 order by z2 desc, start_ts, {CORDER}[2], signal_id, i) = 1"""
CTES["ctop"] = f"""select *, row_number() over (partition by cluster_id order by z2 desc, start_ts, {CORDER}[2], signal_id, i) as rank
 from cbest qualify rank <= 5"""
CTOP = "cmelt cz ctop3 cbest ctop"
add("incident_top_features", f"{CLUS} {CTOP}", """select cluster_id, cast(rank as integer) as rank, feature, round(x, 6) as value,
 z2 as z_score, cast(percentile as double) as percentile from ctop""")


def logistic(x: str) -> str:
    return f"(0.4 + 0.55 / (1.0 + exp(-4.0 * (({x}) - 0.5))))"


def normalized(x: str, table: str) -> str:
    p5, p95 = (f"(select quantile_cont({x}, {q}) from {table})" for q in (0.05, 0.95))
    top = f"(select max({x}) from {table})"
    scaled_x = (
        f"case when {p95} > {p5} then greatest(0.0, least(1.0, ({x} - {p5}) / ({p95} - {p5}))) "
        f"when {top} > 0 then {x} / ({top} + 1e-6) else {x} end"
    )
    return (
        f"case when (select count(*) from {table}) >= 3 then {logistic(scaled_x)} "
        f"else least(0.95, {logistic(x)}) end"
    )


def by_quantile(x: str, table: str) -> str:
    cut = {
        q: f"(case when (select count(*) from {table}) < 3 then {fixed} else (select quantile_cont({x}, {q}) from {table}) end)"
        for q, fixed in ((0.9, 0.75), (0.6, 0.45))
    }
    return f"case when {x} >= {cut[0.9]} then 'high' when {x} >= {cut[0.6]} then 'medium' else 'low' end"


CTES["risk"] = f"select *, {normalized('raw_risk', 'csum')} as final_risk from csum"
CTES["rated"] = f"select *, {by_quantile('final_risk', 'risk')} as severity from risk"
CTES["ctech"] = """select cluster_id, list(t order by k) as mitre from (
 select cluster_id, min(k) as k, {'id': technique_id, 'technique': technique, 'tactic': tactic} as t
 from (select cluster_id, unnest(mitre_keys) as k from csum) join mitre on k = mitre_key
 group by cluster_id, technique_id, technique, tactic) group by 1"""
CTES["ccat"] = """select cluster_id, string_agg(category || '=' || n, ',' order by category) as categories
 from (select cluster_id, category, count(*) as n from clus group by 1, 2) group by 1"""
CTES["inc"] = """select incident_id, start_ts, end_ts, primary_ip, primary_user, n_signals as total_alerts,
 severity as max_severity, categories, array_to_string(list_transform(string_split(detection_type, '_'),
  lambda w: upper(w[1]) || w[2:]), ' ') || ' incident affecting ' || coalesce(primary_ip, primary_user, 'unknown entity')
  as summary, 'open' as status, '' as analyst_notes, '' as resolution_reason, cluster_id
 from rated join ccat using (cluster_id)"""
RATED = f"{CSUM} risk rated"
INC = f"{RATED} ccat inc"
add("incidents", INC, "select * exclude (cluster_id) from inc")
add("incident_entities", INC, """select distinct incident_id, t as entity_type, e as entity from (
 select incident_id, 'ip' as t, ip as e from clus join inc using (cluster_id) where ip <> '' union all
 select incident_id, 'user', user_name from clus join inc using (cluster_id) where user_name <> '')""")


def closure(table: str) -> dict[str, str]:
    """Components of the naive pair condition, by recursion."""
    return {
        "pairs": f"""select a.incident_id as u, b.incident_id as v from {table} a join {table} b
 on (a.start_ts, a.incident_id) < (b.start_ts, b.incident_id)
 and (a.primary_ip = b.primary_ip or a.primary_user = b.primary_user)
 and abs(epoch_us(b.start_ts) - epoch_us(a.end_ts)) < 1200000000""",
        "sym": "select u, v from pairs union select v, u from pairs",
        "reach": f"""select incident_id as x, incident_id as y from {table}
 union select x, v from reach join sym on y = u""",
        "comp": "select x as incident_id, min(y) as component from reach group by 1",
    }


CTES.update(closure("inc"))


def near(key: str) -> str:
    """Points in time of one key fall into groups at gaps of 20 minutes."""
    w = f"(partition by {key} order by start_ts, incident_id)"
    return f"""select incident_id, '{key}:' || {key} || '#' || sum(opens) over {w} as g from (
 select *, case when epoch_us(start_ts) - epoch_us(lag(start_ts) over {w}) < 1200000000 then 0 else 1 end as opens
 from each where {key} is not null)"""


# Single alerts are points in time, so pairs come down to groups, of which there are few.
CTES["groupsa"] = f"{near('primary_ip')} union all {near('primary_user')}"
CTES["syma"] = "select distinct a.g as u, b.g as v from groupsa a join groupsa b using (incident_id)"
CTES["reacha"] = """select distinct g as x, g as y from groupsa
 union select x, v from reacha join syma on y = u"""
CTES["compa"] = """select distinct incident_id, component from groupsa
 join (select x as g, min(y) as component from reacha group by 1) using (g)"""
CTES["each"] = """select alert_id as incident_id, start_ts, start_ts as end_ts, ip as primary_ip,
 user_name as primary_user from al"""
CTES["heads"] = """select component, first(incident_id order by start_ts, incident_id) as merged_id from inc
 join comp using (incident_id) group by 1"""
CTES["headsa"] = """select component, first(incident_id order by start_ts, incident_id) as merged_id from each
 join compa using (incident_id) group by 1"""
add("merge_alert_groups", "al each groupsa syma reacha compa headsa",
    "select incident_id, merged_id from compa join headsa using (component)", recursive=True)
add("merge_alert_batches", "al each groupsa syma reacha compa headsa",
    "select incident_id, merged_id from compa join headsa using (component)", recursive=True)
CTES["mcat"] = """select component, string_agg(category || '=' || n, ',' order by category) as categories from (
 select component, category, count(*) as n from clus join inc using (cluster_id) join comp using (incident_id)
 group by 1, 2) group by 1"""
CTES["minc0"] = """select component, count(*) as members, min(start_ts) as start_ts, max(end_ts) as end_ts,
 cast(sum(total_alerts) as bigint) as total_alerts,
 max(case max_severity when 'high' then 3 when 'medium' then 2 else 1 end) as r,
 first(primary_ip order by start_ts, incident_id) as primary_ip, first(primary_user order by start_ts, incident_id) as primary_user,
 first(summary order by start_ts, incident_id) as text from inc join comp using (incident_id) group by 1"""
CTES["minc"] = """select merged_id as incident_id, start_ts, end_ts, primary_ip, primary_user, total_alerts,
 case r when 3 then 'high' when 2 then 'medium' else 'low' end as max_severity, categories,
 case when members = 1 then text else 'Merged ' || members || ' incidents, first: ' || text end as summary,
 'open' as status, '' as analyst_notes, '' as resolution_reason
 from minc0 join heads using (component) join mcat using (component)"""
MERGE = f"{INC} pairs sym reach comp heads"
add("merge_incidents", f"{MERGE} mcat minc0 minc", "select * from minc", recursive=True)
add("merge_members", MERGE, "select incident_id, merged_id, summary from inc join comp using (incident_id) join heads using (component)", recursive=True)
add("incidents_json", MERGE, """select merged_id as incident_id, '{' || string_agg('"' || category || '":' || n, ','
 order by category) || '}' as categories from (select component, category, count(*) as n from clus
 join inc using (cluster_id) join comp using (incident_id) group by 1, 2) join heads using (component)
 group by 1""", recursive=True)
add("alerts", f"{MERGE} mitre ctech {CTOP}", """select alert_id, (select max(ts) from ev) as created_ts, r.start_ts, r.end_ts,
 primary_user as user_name, primary_ip as ip, severity, round(raw_risk, 6) as score, round(window_score, 6) as window_score,
 round(sequence_score, 6) as sequence_score, round(final_risk, 6) as final_risk, detection_type, category,
 coalesce(array_to_string(list_transform(mitre, lambda m: m.id), ','), '') as mitre,
 mitre[1].id as mitre_technique_id, mitre[1].tactic as mitre_tactic,
 upper(severity) || ' ' || case detection_type when 'bruteforce' then 'Brute Force Attack Detected'
  when 'port_scan' then 'Port Scanning Activity' when 'lateral_movement' then 'Lateral Movement Attempt'
  when 'exfil_spike' then 'Data Exfiltration Spike' when 'service_acct_abuse' then 'Service Account Abuse'
  when 'anomalous_behavior' then 'Anomalous Behavior Detected' else 'Security Alert' end
  || ' - ' || coalesce(primary_user, primary_ip, 'unknown entity') as title,
 'Correlated ' || n_signals || ' anomalous signals into a ' || upper(severity) || ' incident (score='
  || printf('%.2f', final_risk) || E').\\nTop contributing signals:\\n- ' || array_to_string(kinds[1:3], ', ')
  || E'\\nMapped to MITRE ATT&CK:\\n' || coalesce(array_to_string(list_transform(mitre[1:3],
   lambda m: '- ' || m.id || ' ' || m.technique || ' (' || m.tactic || ')'), E'\\n'), '') as explanation,
 coalesce((select string_agg(feature, ',' order by rank) from ctop t where t.cluster_id = r.cluster_id), '') as top_features,
 merged_id as incident_id
 from rated r left join ctech using (cluster_id) join comp using (incident_id) join heads using (component)""",
    recursive=True)

CTES["araw"] = "select alert_id, final_risk as raw_risk from al"
add("risk_normalize", "al araw", f"""select alert_id, round(raw_risk, 6) as raw_risk,
 round({normalized('raw_risk', 'araw')}, 6) as final_risk from araw""")
add("severity_quantile", "al", f"""select alert_id, round(final_risk, 6) as final_risk,
 {by_quantile('final_risk', 'al')} as severity from al""")
add("incident_severity", "al", """select incident_id, case max(case severity when 'high' then 3 when 'medium' then 2 else 1 end)
 when 3 then 'high' when 2 then 'medium' else 'low' end as max_severity from al where incident_id is not null group by 1""")


# ---------------------------------------------------------------- reports and evaluation

CTES["ainc"] = """select incident_id, min(start_ts) as start_ts, max(start_ts) as end_ts, count(*) as total_alerts,
 'open' as status, '' as analyst_notes, '' as resolution_reason from al where incident_id is not null group by 1"""
add("alerts_list", "al ainc", """select a.*, a.final_risk as score, i.incident_id as incident_id_str from
 (select * from al where severity in ('medium', 'high') order by created_ts desc, alert_id limit 200) a
 left join ainc i using (incident_id)""")
add("alerts_min_severity", "al", "select alert_id, severity from al where severity <> 'low'")
add("alerts_by_entity", "al", "select alert_id, user_name, ip from al where user_name ilike 'user3' and ip = '10.0.1.2'")
add("incidents_list", "al ainc", "select * from ainc order by end_ts desc, incident_id limit 50")
add("incident_detail", "al ainc", """select i.incident_id, i.start_ts as incident_start_ts, i.end_ts as incident_end_ts,
 i.total_alerts as incident_total_alerts, i.status as incident_status, i.analyst_notes as incident_analyst_notes,
 i.resolution_reason as incident_resolution_reason, alert_id, created_ts, severity, final_risk, detection_type, category
 from ainc i left join al using (incident_id)""")
for _name, _key in (("top_risk_users", "user_name"), ("top_risk_ips", "ip")):
    add(_name, "al", f"""select {_key}, round(greatest(0, max(final_risk)) * 0.4 + least(count(incident_id) / 10.0, 1.0) * 0.3
 + least(sum(case severity when 'high' then 3.0 when 'medium' then 2.0 else 1.0 end)::double / 30.0, 1.0) * 0.2
 + greatest(0.5, 1.0 - (epoch_us((select max(created_ts) from al)) - epoch_us(max(created_ts))) / 3600000000.0 / 168.0) * 0.1, 3)
 ::double as risk, count(*) as alerts, count(incident_id) as incidents from al where {_key} <> '' group by 1
 order by 2 desc, 1 limit 10""")
add("health_counts", "ev al", "select (select count(*) from ev) as events, (select count(*) from al) as alerts")
add("severity_distribution", "al", "select severity, count(*) as n from al group by 1")
add("category_distribution", "al", "select coalesce(category, 'unknown') as category, count(*) as n from al group by 1")
add("alerts_per_minute", "al", """select minute, n, round(avg(n) over (order by minute rows between 4 preceding and current row), 6)
 as rolling_avg from (select date_trunc('minute', start_ts) as minute, count(*) as n from al group by 1)""")
add("alerts_per_hour", "al", """select h as hour, count(alert_id) as n from
 (select unnest(generate_series((select min(date_trunc('hour', created_ts)) from al),
  (select max(date_trunc('hour', created_ts)) from al), interval 1 hour)) as h)
 left join al on date_trunc('hour', created_ts) = h group by 1""")
add("alert_timeline", "al", "select start_ts, alert_id, severity, final_risk, detection_type, user_name, ip from al")
add("latest_alerts", "al", "select created_ts, alert_id, severity, final_risk, detection_type, user_name, ip from al")
add("related_alerts", "al", """select a.alert_id, r.alert_id as related_id from al a join (select *, row_number() over
 (partition by ip order by created_ts desc, alert_id) as rn from al where ip <> '') r on a.ip = r.ip and rn <= 20
 where a.alert_id <> r.alert_id union
 select a.alert_id, r.alert_id from al a join (select *, row_number() over
 (partition by user_name order by created_ts desc, alert_id) as rn from al where user_name <> '') r
 on a.user_name = r.user_name and rn <= 20 where a.alert_id <> r.alert_id""")
add("evidence_timeline", f"{RULES} rule_all rule_ev", """select * from (select rule_id, cast(row_number() over (partition by rule_id
 order by ts, event_id) as integer) as pos, event_id, ts, source, event_type, user_name, ip
 from rule_ev join ev using (event_id)) where pos <= 10""")


def title_words(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
    )


add("model_agreement", "al", f"""select alert_id, case when final_risk > 0.8 then 'high' when final_risk > 0.5 then 'elevated'
 else 'guarded' end as risk_band, round(abs(window_score - sequence_score), 6) as difference,
 case when abs(window_score - sequence_score) < 0.2 then 'High' when abs(window_score - sequence_score) < 0.4 then 'Medium'
 else 'Low' end as agreement, {title_words('detection_type')} as detection,
 {title_words("coalesce(category, 'unknown')")} as category from al""")
add("eval_metrics", "al", """select round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,
 round(2 * tp / (2 * tp + fp + fn), 6) as f1, cast(tp + fn as bigint) as support from (select
 cast(count(*) filter (final_risk >= 0.5 and is_attack) as double) as tp,
 cast(count(*) filter (final_risk >= 0.5 and not is_attack) as double) as fp,
 cast(count(*) filter (final_risk < 0.5 and is_attack) as double) as fn from al)""")
CTES["per"] = """select final_risk, count(*) filter (is_attack) as tp, count(*) filter (not is_attack) as fp
 from al group by 1"""
CTES["cum"] = """select *, sum(tp) over w as ctp, sum(fp) over w as cfp, lead(tp) over w as ntp, lead(fp) over w as nfp
 from per window w as (order by final_risk desc)"""
add("eval_roc", "al per cum", """select round(cast(cfp as double) / (select sum(fp) from per), 6) as fpr,
 round(cast(ctp as double) / (select sum(tp) from per), 6) as tpr, round(final_risk, 6) as threshold from cum
 where ntp is null or ntp <> tp or nfp <> fp union all select 0.0::double, 0.0::double, cast(null as double)""")
add("eval_auc", "al", """select round((select sum(case when a.final_risk > b.final_risk then 1.0::double
  when a.final_risk = b.final_risk then 0.5::double else 0 end) from al a, al b where a.is_attack and not b.is_attack)
 / ((select count(*) from al where is_attack) * (select count(*) from al where not is_attack)), 6) as auc""")
add("synthetic_labels", "al", """select alert_id, coalesce(final_risk > 0.7 or detection_type in ('brute_force_login',
 'credential_stuffing', 'lateral_movement_attempt', 'exfil_spike', 'bruteforce', 'impossible_travel', 'lateral_movement')
 or severity = 'high', false) as is_attack from al""")
add("recent_events", "ev", "select event_id, ts from ev where ts >= (select max(ts) from ev) - interval 360 minute")
add("retain_latest", "ev", "select event_id, ts from ev order by ts desc, event_id desc limit 5000")
add("upsert_new_alerts", "al", "select alert_id, severity from al where severity <> 'high'")
add("incident_updates", "al ainc", """select * replace (case when total_alerts > 170 then 'investigating' else status end as status,
 case when total_alerts > 170 or total_alerts <= 160 then 'seen ' || total_alerts else analyst_notes end as analyst_notes)
 from ainc""")
add("validate_events", "ev", """select event_id, case when host = 'host3' then 'dns' else source end as source,
 case when host = 'host3' then 'unsupported source' when action = 'deny' then 'missing ts' end as reject_reason from ev""")


# ---------------------------------------------------------------- readers

CTES["evn"] = "select *, cast(event_id as bigint) as no from ev"
GOOD_TS = "no % 50 <> 7"
CANON = "event_id, ts, source, event_type, user_name, ip, host, app, dst_ip, dst_port, bytes, action, command"
CTES["nauth"] = f"""select {sid("'auth'", iso('ts'), 'event_type', 'user_name', 'ip', 'host', "'vpn'")} as event_id, ts,
 source, event_type, user_name, ip, host, 'vpn' as app, dst_ip, dst_port, bytes, action, command from evn
 where source = 'auth' and {GOOD_TS}"""
CTES["nnet"] = f"""select {sid("'network'", iso('ts'), 'event_type', 'ip', 'dst_ip', 'dst_port', "'tcp'")} as event_id, ts,
 source, event_type, user_name, ip, host, cast(null as varchar) as app, dst_ip, dst_port,
 case when no % 4 = 1 then 0 else bytes end as bytes, action, command from evn
 where source = 'network' and {GOOD_TS} and no % 40 <> 3"""
CTES["nproc"] = f"""select {sid("'process'", iso('ts'), 'event_type', 'user_name', 'ip', 'host', 'command')} as event_id, ts,
 source, event_type, user_name, ip, host, cast(null as varchar) as app, dst_ip, dst_port, bytes, action, command from evn
 where source = 'process' and {GOOD_TS}"""
add("normalize_auth", "ev evn nauth", "select * from nauth")
add("normalize_network", "ev evn nnet", "select * from nnet")
add("normalize_process", "ev evn nproc", "select * from nproc")
add("load_events", "ev evn nauth nnet nproc",
    "select * from nauth union all select * from nnet union all select * from nproc")
RAW_TS = f"""case when no % 50 = 7 then 'not a time' when no % 3 = 0 then {iso('ts')}
 when no % 3 = 1 then replace({iso('(ts + interval 2 hour)')}, 'Z', '+02:00') else replace({iso('ts')}, 'Z', '') end"""
CTES["rej"] = f"""select source, {RAW_TS} as raw_ts, event_type, case when no % 50 = 7 then 'bad ts'
 when source = 'network' and no % 40 = 3 then 'bad dst_port' end as reject_reason from evn"""
add("rejects", "ev evn rej", "select * from rej where reject_reason is not null")
add("ingest_summary", "ev evn rej", """select source, count(*) filter (reject_reason is null) as ingested,
 count(*) filter (reject_reason is not null) as rejected from rej group by 1""")
add("src_ndjson", "ev evn", f"""select {RAW_TS} as ts, event_type as event,
 case when source <> 'network' then '  ' || upper(user_name) || chr(9) end as "user",
 case when source <> 'network' then ' ' || ip end as ip, case when source = 'network' then ' ' || ip end as src_ip,
 case when source = 'network' then case when no % 40 = 3 then 'http' else cast(dst_port as varchar) end end as dst_port,
 case when source = 'network' and no % 4 <> 1 then cast(bytes as varchar) end as bytes,
 case when source <> 'network' then host end as host, command from evn""")
EPOCH = """regexp_replace(regexp_replace(cast(epoch_us(ts) // 1000000 as varchar) || '.' ||
 lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0'), '0+$', ''), '\\.$', '.0')"""
add("src_zeek_tsv", "ev evn", f"""select 'zeek_' || {EPOCH} || '_' || ip || '_' || dst_ip as event_id, ts,
 'connection' as event_type, ip, dst_ip, dst_port, 'tcp' as proto, bytes + 100 as bytes from evn
 where source = 'network' and no % 10 <> 0""")
add("src_zeek_json", "ev evn", f"""select 'zeek_' || {EPOCH} || '_' || ip || '_' || dst_ip as event_id, ts,
 case when no % 3 = 0 then 'dns' else 'connection' end as event_type, ip, dst_ip, dst_port, 'udp' as proto,
 'C' || no as uid from evn where source = 'network' and no % 20 <> 1""")
add("src_windows_csv", "ev evn", f"""select 'win_' || case when no % 7 = 0 then '4672' when event_type = 'login_success' then '4624'
  else '4625' end || '_' || {iso('ts')} || '_' || case when no % 2 = 1 then user_name else upper(user_name) end as event_id, ts,
 case when no % 7 = 0 then 'event_4672' else event_type end as event_type, user_name,
 case when no % 2 = 1 or no % 4 = 0 then ip end as ip, host, '3' as logon_type from evn
 where source = 'auth' and no % 30 <> 0""")
add("src_ssh_auth", "ev evn", """select 'ssh_' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '_' || coalesce(user_name, 'None') || '_'
 || coalesce(ip, 'None') as event_id, t as ts, event_type, user_name, ip, host, 'sshd[77]' as process from (
 select date_trunc('second', ts) as t, host, case when no % 11 = 0 then 'authentication' else event_type end as event_type,
 case when no % 11 = 0 then null else user_name end as user_name, case when no % 11 = 0 then null else ip end as ip
 from evn where source = 'auth')""")
add("detect_format", "ev", """select '/logs/' || n as file, f as format from (values ('zeek_a.log', 'zeek_json'), ('conn.log', 'zeek_tsv'),
 ('windows.csv', 'windows_event'), ('export.csv', 'unknown'), ('auth.log', 'ssh_auth'), ('app.txt', 'unknown')) as t(n, f)
 where exists (select 1 from ev)""")

add("alert_evidence", CLUS, f"""select 'al_' || substr(cluster_id, 1, 12) as alert_id, signal_id, kind, event_id from clus join (
 select 'win_' || {sid('user_name', 'ip', iso(floor_to(5)))} as signal_id, event_id from ev union all
 select session_id, event_id from sev union all select rule_id, event_id from rule_all) using (signal_id)""")


def _forest_sql(trees: int = 300, sample: int = 256, seed: int = 7, levels: int = 8) -> str:
    """The forest of operators/iforest.py: samples, one aggregate for each level, walks."""
    def number(*parts: str) -> str:
        text = "concat_ws('|', " + ", ".join(f"{p}::varchar" for p in parts) + ")"
        return f"cast('0x' || substr(md5({text}), 1, 13) as bigint)"

    unit = lambda *parts: f"({number(*parts)} / {float(1 << 52)!r}::double)"
    path = "case when {n} <= 1 then 0.0::double when {n} = 2 then 1.0::double else " \
        "2.0::double * (ln(({n} - 1)::double) + 0.5772156649015329::double)" \
        " - 2.0::double * ({n} - 1) / {n} end"  # fmt: skip
    last = len(FEATURES)
    values = ", ".join(f"{f}::double" for f in FEATURES)
    CTES["fkeys"] = f"""select user_name, ip, start_ts, concat_ws('|', coalesce(user_name, ''),
     coalesce(ip, ''), epoch_us(start_ts)::varchar) as key, [{values}] as x,
     {1.5 * trees * sample!r}::double / count(*) over () as rate from feat"""
    CTES["fdrawn"] = f"""select distinct key, x, unnest(case when rate >= {trees} then range({trees})
     else list_transform(range(1, 1 + (floor(rate) + case when {unit('key', str(seed))}
      < rate - floor(rate) then 1 else 0 end)::bigint), lambda j:
      {number('key', 'j', str(seed + 1))} % {trees}) end) as tree from fkeys"""
    CTES["fs0"] = f"""select tree, 0 as node, x from fdrawn qualify row_number() over
     (partition by tree order by {number('key', 'tree', str(seed + 2))}, key) <= {sample}"""
    CTES["fsize"] = "select tree, count(*) as size from fs0 group by tree"
    names = ["feat fkeys fdrawn fs0 fsize"]
    for d in range(levels + 1):
        lows, highs = (", ".join(f"{f}(x[{i}])" for i in range(1, last + 1)) for f in ("min", "max"))
        CTES[f"fg{d}"] = f"""select tree, node, count(*) as n, [{lows}] as low, [{highs}] as high,
         any_value(size) as size from fs{d} join fsize using (tree) group by tree, node"""
        CTES[f"fo{d}"] = f"""select *, list_filter(range(1, {last + 1}), lambda f: high[f] > low[f])
         as op from fg{d}"""
        CTES[f"fp{d}"] = f"""select tree, node, size, n, case when n > 1 and len(op) > 0
          and {d} < ceil(log2(greatest(size, 2))) then
          op[1 + {number('tree', 'node', str(seed + 3))} % len(op)] end as f, low, high from fo{d}"""
        CTES[f"ft{d}"] = f"""select tree, node, f, low[f] + (high[f] - low[f])
          * {unit('tree', 'node', str(seed + 4))} as cut,
          {d} + {path.format(n='n')} as path from fp{d}"""
        CTES[f"fs{d + 1}"] = f"""select tree, 2 * node + case when x[f] <= cut then 1 else 2 end as node, x
          from fs{d} join ft{d} using (tree, node) where f is not null"""
        names.append(f"fg{d} fo{d} fp{d} ft{d} fs{d + 1}")
    CTES["fw0"] = """select key, x, tree, 0 as node, null::double as path from fkeys, fsize"""
    for d in range(levels + 1):
        CTES[f"fw{d + 1}"] = f"""select key, x, tree, case when f is not null then 2 * node
          + case when x[f] <= cut then 1 else 2 end end as node,
          case when f is null then coalesce(w.path, t.path) end as path
          from fw{d} w left join ft{d} t using (tree, node)"""
        names.append(f"fw{d}")
    names.append(f"fw{levels + 1}")
    expected = path.format(n="max(size)")
    CTES["fexpected"] = f"select greatest({expected}, 1e-9) as expected from fsize"
    CTES["fmean"] = f"select key, avg(path) as mean_path from fw{levels + 1} group by key"
    CTES["fraw"] = """select user_name, ip, start_ts, pow(2.0::double, -mean_path / expected)
      as forest_raw from fkeys join fmean using (key), fexpected"""
    add("isolation_forest", " ".join(["ev freq profile", *names, "fexpected fmean fraw"]),
        "select user_name, ip, start_ts, round(forest_raw, 6) as forest_raw from fraw")
    return " ".join([*names, "fexpected fmean fraw"])


FOREST = _forest_sql()


def _reconstruction_sql(components: int = 4, squarings: int = 45) -> str:
    """Projections on the main components without eigenvectors: a matrix squared again and again,
    over its trace, becomes the projection on the greatest one, which is then taken off."""
    d = len(FEATURES)
    each = "list_transform(range(1, {n}), lambda {v}: {x})"
    cells = lambda x: each.format(
        n=d + 1, v="i", x=each.format(n=d + 1, v="j", x=x))
    trace = lambda a: f"list_sum({each.format(n=d + 1, v='t', x=f'{a}[t][t]')})"
    dot = lambda x: f"list_sum({each.format(n=d + 1, v='q', x=x)})"
    rows = ["[" + ", ".join(f"covar_samp({f}::double, {g}::double)" for g in FEATURES) + "]"
            for f in FEATURES]
    means = ", ".join(f"avg({f}::double)" for f in FEATURES)
    CTES["rstat"] = f"select [{means}] as mu, [{', '.join(rows)}] as cov from feat"
    CTES["rsd"] = f"""select mu, cov, {each.format(n=d + 1, v="i", x=
      "case when cov[i][i] > 0 then sqrt(cov[i][i]) else 1 end")} as sd from rstat"""
    CTES["rm1"] = f"select mu, sd, {cells('cov[i][j] / (sd[i] * sd[j])')} as m from rsd"
    names = ["rstat", "rsd", "rm1"]
    for c in range(1, components + 1):
        CTES[f"rq{c}"] = f"""select 0 as step, m as a from rm{c} union all select step + 1,
          {cells(dot('a[i][q] * a[q][j] / pow(' + trace('a') + ', 2)'))} from rq{c}
          where step < {squarings}"""
        CTES[f"rp{c}"] = f"""select {cells(f"a[i][j] / {trace('a')}")} as p from rq{c}
          where step = {squarings}"""
        CTES[f"rl{c}"] = f"""select mu, sd, m, p, {trace('m').replace('m[t][t]',
          dot('m[t][q] * p[q][t]'))} as l from rm{c}, rp{c}"""
        CTES[f"rm{c + 1}"] = f"select mu, sd, {cells('m[i][j] - l * p[i][j]')} as m from rl{c}"
        names += [f"rq{c}", f"rp{c}", f"rl{c}", f"rm{c + 1}"]
    values = ", ".join(f"({f}::double - mu[{i}]) / sd[{i}]" for i, f in enumerate(FEATURES, 1))
    CTES["rz"] = f"select user_name, ip, start_ts, [{values}] as z from feat, rm1"
    parts = " + ".join(f"rp{c}.p[i][q]" for c in range(1, components + 1))
    inner = each.format(n=d + 1, v="i", x=f"z[i] * (z[i] - {dot(f'({parts}) * z[q]')})")
    CTES["rraw"] = f"""select user_name, ip, start_ts, greatest(0, list_sum({inner}) / {d})
      as reconstruction_raw from rz, {", ".join(f"rp{c}" for c in range(1, components + 1))}"""
    add("reconstruction_error", " ".join(["ev freq profile feat", *names, "rz rraw"]),
        "select user_name, ip, start_ts, round(reconstruction_raw, 6) as reconstruction_raw from rraw",
        recursive=True)
    return " ".join([*names, "rz rraw"])


RECONSTRUCTION = _reconstruction_sql()


def _models_sql() -> None:
    """The whole detection with the window score of both models in place of the baseline's."""
    baseline = CTES["wscore"]
    CTES["wboth"] = """select w.*, forest_raw, reconstruction_raw from wraw w
      join fraw f on f.user_name is not distinct from w.user_name and f.ip is not distinct from w.ip
       and f.start_ts = w.start_ts
      join rraw r on r.user_name is not distinct from w.user_name and r.ip is not distinct from w.ip
       and r.start_ts = w.start_ts"""
    CTES["wscore"] = f"""select * exclude (forest_raw, reconstruction_raw),
      1 - (1 - {scaled('forest_raw', 'wboth')}) * (1 - {scaled('reconstruction_raw', 'wboth')})
      as window_score from wboth"""
    uses = MERGE.replace(
        " wscore ", f" {FOREST} {RECONSTRUCTION} wboth wscore ")
    add("detect_with_models", " ".join(dict.fromkeys(uses.split())),
        """select alert_id, r.start_ts, r.end_ts, severity, round(final_risk, 6) as final_risk,
         round(window_score, 6) as window_score, round(sequence_score, 6) as sequence_score,
         detection_type from rated r join comp using (incident_id)""", recursive=True)
    CTES["wscore"] = baseline


_models_sql()


# ---------------------------------------------------------------- live path and stored artifacts

add("sink_ndjson", "ev evn nauth nnet nproc",
    "select * from nauth union all select * from nnet union all select * from nproc")
add("events_by_time", "ev evn nauth nnet nproc", """select event_id, ts from nauth union all
 select event_id, ts from nnet union all select event_id, ts from nproc""")
add("noisy_or", "al", """select alert_id, round(window_score + sequence_score
 - window_score * sequence_score, 6) as joint_score from al""")
add("stored_models", f"{TAIL} bigram pairn", """select coalesce(token, case prev_id when 0 then '<start>'
 else '<unknown>' end) as token, n_pairs from (select prev_id, sum(n_pair)::bigint as n_pairs
 from pairn group by 1) left join vocab on prev_id = token_id""")

_PARSED = """select event_id, ts, '{source}' as source, event_type, {who} as user_name, ip, {host} as host,
 {dst}, {bytes} as bytes from ({sql})"""
_login = {"source": "auth", "who": "user_name", "host": "host", "bytes": "cast(null as bigint)",
          "dst": "cast(null as varchar) as dst_ip, cast(null as integer) as dst_port"}
_flow = {"source": "network", "who": "cast(null as varchar)", "host": "cast(null as varchar)",
         "bytes": "cast(null as bigint)", "dst": "dst_ip, dst_port"}
ORACLE["stream_ingest"] = " union all ".join([
    _PARSED.format(**_login, sql=ORACLE["src_windows_csv"]),
    _PARSED.format(**_login, sql=ORACLE["src_ssh_auth"]),
    _PARSED.format(**_flow, sql=ORACLE["src_zeek_json"]),
])


def _rolling_sql() -> str:
    """Detection over the last six hours of the first batch, then over those of all events; an
    alert that is stored stays as it is."""
    first = f"""select * from ({EVENTS_SQL}) where ts <= (select max(ts) - interval 180 minute
     from ({EVENTS_SQL}))"""
    runs = []
    for held in (first, EVENTS_SQL):
        recent = f"""select * from ({held}) where ts >= (select max(ts) - interval 360 minute
         from ({held}))"""
        runs.append(ORACLE["alerts"].replace(f"ev as ({EVENTS_SQL})", f"ev as ({recent})", 1))
    return f"""with run1 as ({runs[0]}), run2 as ({runs[1]}) select * from run1 union all
     select * from run2 where alert_id not in (select alert_id from run1)"""


ORACLE["stream_alerts"] = _rolling_sql()
