"""SQL for DuckDB with the same results as the registered queries.

Only the fixture adapter is shared with the Spark side; every rule is written down again here.
"""

from __future__ import annotations

from footfall.sources import fixtures as fx

T0 = fx.HOT_TENANT
T2 = "00000000-0000-4000-8000-000000000002"
OWNER = "20000000-0000-4000-8000-000000000003"
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
MAX_EVENTS, WINDOW_MS = 10, 6 * 3600 * 1000

WEB = fx.duckdb_text(fx.WEB_EVENTS)
PLAIN = fx.duckdb_text(fx.PLAIN_EVENTS)
ARRIVALS = fx.duckdb_text(fx.ARRIVALS)
RAW = fx.duckdb_text(fx.raw_posts(fx.DUCKDB))
JOBS = fx.duckdb_text(fx.queued_jobs(fx.DUCKDB))
TENANTS = fx.duckdb_text(fx.tenants(fx.DUCKDB))
LOG = fx.duckdb_text(fx.tenant_log(fx.DUCKDB))
SETUP = fx.duckdb_text(fx.setup_requests(fx.DUCKDB))
DOMAINS = fx.duckdb_text(fx.domain_requests(fx.DUCKDB))
FUNNELS = fx.duckdb_text(fx.funnel_requests(fx.DUCKDB))
SUBSCRIPTIONS = fx.duckdb_text(fx.SUBSCRIPTIONS)
VERSIONS = fx.duckdb_text(fx.tenant_versions(fx.DUCKDB))
VISITS = fx.duckdb_text(fx.room_visits(fx.DUCKDB))
CLICKED = fx.duckdb_text(fx.CLICKED)
GONE = fx.duckdb_text(fx.GONE)

AGENT_NO = "list_position([{}], {{0}})".format(", ".join(f"'{a}'" for a in fx.AGENTS if a))


def _class(agent: str, names: list[str], none: str) -> str:
    """The class of an agent by its place in the fixture's list."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"coalesce([{listed}][{AGENT_NO.format(agent)}], {none})"


def _device(agent: str) -> str:
    return _class(agent, ["desktop", "desktop", "desktop", "mobile", "mobile"], "'desktop'")


def _os(agent: str) -> str:
    return _class(agent, ["Windows", "Mac OS", "Linux", "iOS", "Android"], "NULL")


def _browser(agent: str) -> str:
    return _class(agent, ["Chrome", "Safari", "Firefox", "Mobile Safari", "Chrome"], "NULL")


STORED = f"""
SELECT event_id, time, tenant_id, event_name, properties, session_id, url, referrer,
  cast(NULL AS varchar) AS country, {_device('user_agent')} AS device, {_os('user_agent')} AS os,
  {_browser('user_agent')} AS browser, cast(NULL AS varchar) AS ip_hash
FROM ({WEB})"""


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _host(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#:]+)', 1)), '')"


def _wl_host(entry: str) -> str:
    text = f"lower({_trim(entry)})"
    return (
        f"nullif(CASE WHEN contains({text}, '://') THEN {_host(text)} "
        f"ELSE regexp_extract({text}, '^([^/:]*)', 1) END, '')"
    )


def _truncated(ip: str) -> str:
    plain = f"regexp_replace({ip}, '^::ffff:', '')"
    return (
        f"CASE WHEN contains({plain}, '.') THEN regexp_replace({plain}, '\\.[^.]*$', '.0') "
        f"ELSE concat(array_to_string(string_split({plain}, ':')[1:len(string_split({plain}, ':')) - 2], ':'), '::') END"
    )


def _ip_hash(ip: str) -> str:
    return f"CASE WHEN {ip} IS NOT NULL AND {ip} <> '' THEN sha256({_truncated(ip)}) END"


def _client_ip(forwarded: str, remote: str) -> str:
    first = f"trim(split_part({forwarded}, ',', 1))"
    return f"nullif(CASE WHEN coalesce({forwarded}, '') <> '' THEN {first} ELSE {remote} END, '')"


def _broken(rules: dict[str, str]) -> str:
    return "concat_ws('|', {})".format(
        ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in rules.items())
    )


def _iso_ok(text: str) -> str:
    return f"regexp_matches({text}, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:?\\d\\d)$')"


URL_OK = "regexp_matches({0}, '^[a-z]+://[^/]')"

_FIELDS = {
    "token": "token", "event_name": "eventName", "session_id": "sessionId", "url": "url",
    "referrer": "referrer", "occurred_at": "occurredAt", "user_agent": "userAgent",
}
_EXTRACTED = ", ".join(
    f"json_extract_string(good, '$.{field}') AS {name}" for name, field in _FIELDS.items()
)
_PAYLOAD_RULES = {
    "token": f"regexp_matches(token, '{UUID}')",
    "eventName": "regexp_matches(event_name, '^[a-zA-Z0-9_.-]{1,100}$')",
    "properties": "starts_with(properties, chr(123)) AND length(properties) <= 10240",
    "sessionId": f"regexp_matches(session_id, '{UUID}')",
    "url": URL_OK.format("url"),
    "referrer": f"referrer IS NULL OR {URL_OK.format('referrer')}",
    "occurredAt": f"occurred_at IS NULL OR {_iso_ok('occurred_at')}",
    "userAgent": "user_agent IS NULL OR length(user_agent) <= 1024",
    "keys": "len(list_filter(json_keys(good), lambda k: k NOT IN ({}))) = 0".format(
        ", ".join(f"'{k}'" for k in ["properties", *_FIELDS.values()])
    ),
}

# Shared steps of the admission queries.
PARSED = f"""
parsed AS (
  SELECT *, good IS NOT NULL AS readable, {_EXTRACTED},
    cast(json_extract(good, '$.properties') AS varchar) AS properties
  FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS good FROM ({RAW}))
),
checked AS (
  SELECT *, CASE WHEN readable THEN {_broken(_PAYLOAD_RULES)} END AS violations FROM parsed
)"""

RESOLVED = f"""{PARSED},
tenant AS (
  SELECT id, token, len(domain_whitelist) AS entries, list_filter(hosts, lambda h: h IS NOT NULL) AS hosts
  FROM (SELECT *, list_transform(domain_whitelist, lambda entry: {_wl_host('entry')}) AS hosts FROM ({TENANTS}))
),
resolved AS (
  SELECT c.*, t.id AS tenant_id,
    CASE WHEN NOT c.readable THEN 500 WHEN c.violations <> '' THEN 400 WHEN t.id IS NULL THEN 401
      WHEN t.entries > 0 AND NOT coalesce(list_bool_or(list_transform(t.hosts, lambda h:
        {_host('c.url')} = h OR ends_with({_host('c.url')}, concat('.', h)))), false) THEN 403 END AS status
  FROM checked c LEFT JOIN tenant t ON t.token = c.token AND c.violations = ''
)"""


def _limiter(source: str) -> str:
    """Greedy admission, one step per event of a token, carrying the admitted times."""
    return f"""
queue AS (
  SELECT event_id, token, epoch_us(arrived_at) // 1000 AS ms,
    row_number() OVER (PARTITION BY token ORDER BY epoch_us(arrived_at) // 1000, event_id) AS place
  FROM {source}
),
walk AS (
  SELECT event_id, token, ms, place, true AS allowed, [ms] AS admitted FROM queue WHERE place = 1
  UNION ALL
  SELECT event_id, token, ms, place, len(live) < {MAX_EVENTS},
    CASE WHEN len(live) < {MAX_EVENTS} THEN list_append(live, ms) ELSE live END
  FROM (
    SELECT q.event_id, q.token, q.ms, q.place,
      list_filter(w.admitted, lambda t: t > q.ms - {WINDOW_MS}) AS live
    FROM walk w JOIN queue q ON q.token = w.token AND q.place = w.place + 1
  )
),
verdict AS (
  SELECT event_id, token, allowed,
    CASE WHEN allowed THEN {MAX_EVENTS} - len(admitted) ELSE 0 END AS remaining,
    make_timestamp((ms + {WINDOW_MS}) * 1000) AS reset_at
  FROM walk
)"""


ADMITTED = f"""{RESOLVED},
waiting AS (SELECT * FROM resolved WHERE status IS NULL),
{_limiter('waiting')},
outcomes AS (
  SELECT r.* EXCLUDE (status), coalesce(r.status, CASE WHEN v.allowed THEN 200 ELSE 429 END) AS status
  FROM resolved r LEFT JOIN verdict v ON v.event_id = r.event_id
)"""

REASON = (
    "CASE status WHEN 200 THEN 'accepted' WHEN 500 THEN 'unreadable_body' WHEN 400 THEN 'malformed_payload' "
    "WHEN 401 THEN 'invalid_token' WHEN 403 THEN 'domain_not_allowed' WHEN 429 THEN 'rate_limited' END"
)

ACCEPTED = f"""
SELECT event_id, arrived_at, tenant_id, event_name, properties, session_id, url, referrer,
  coalesce(occurred_at, concat(strftime(arrived_at, '%Y-%m-%dT%H:%M:%S.%g'), 'Z')) AS occurred_at,
  coalesce(user_agent, header_user_agent) AS user_agent,
  {_client_ip('forwarded_for', 'remote_ip')} AS ip_address
FROM outcomes WHERE status = 200"""


BATCH_SIZE, BATCH_WAIT_MS, TTL_MS = 50, 4 * 3600 * 1000, 6 * 3600 * 1000


def _batches(queue: str) -> str:
    """Batches one after another: the next one begins where the one before it ends."""
    return f"""
WITH RECURSIVE placed AS (
  SELECT queue, event_id, ms, row_number() OVER (PARTITION BY queue ORDER BY ms, event_id) AS place,
    count(*) OVER (PARTITION BY queue ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND {BATCH_WAIT_MS} FOLLOWING) AS last
  FROM (SELECT {queue} AS queue, event_id, epoch_us(arrived_at) // 1000 AS ms FROM ({ARRIVALS}))
),
bounded AS (SELECT *, least(place + {BATCH_SIZE}, last + 1) AS following FROM placed),
batch AS (
  SELECT *, cast(0 AS bigint) AS number FROM bounded WHERE place = 1
  UNION ALL
  SELECT r.*, b.number + 1 FROM batch b JOIN bounded r ON r.queue = b.queue AND r.place = b.following
)
SELECT queue, number, event_id AS first_event, make_timestamp(ms * 1000) AS first_time, following - place AS size FROM batch"""


RESOLVE_AS_OF = f"""
WITH RECURSIVE versions AS (
  SELECT token, id, epoch_us(changed_at) // 1000 AS ms, max(version) AS version FROM ({VERSIONS}) GROUP BY ALL
),
arrived AS (SELECT event_id, token, epoch_us(arrived_at) // 1000 AS ms FROM ({ARRIVALS})),
moment AS (
  SELECT DISTINCT a.token, a.ms FROM arrived a JOIN (SELECT token, min(ms) AS since FROM versions GROUP BY 1) s ON s.token = a.token
  WHERE a.ms >= s.since
),
later AS (
  SELECT token, ms, min(ms) OVER (PARTITION BY token ORDER BY ms RANGE BETWEEN {TTL_MS} FOLLOWING AND UNBOUNDED FOLLOWING) AS following
  FROM moment
),
loaded AS (
  SELECT token, min(ms) AS ms FROM moment GROUP BY 1
  UNION ALL
  SELECT l.token, n.following FROM loaded l JOIN later n ON n.token = l.token AND n.ms = l.ms
),
seen AS (
  SELECT l.token, l.ms, v.id, v.version FROM loaded l ASOF JOIN versions v ON v.token = l.token AND l.ms >= v.ms
)
SELECT a.event_id, a.token, s.id AS tenant_id, s.version, make_timestamp(s.ms * 1000) AS loaded_at
FROM arrived a ASOF LEFT JOIN seen s ON s.token = a.token AND a.ms >= s.ms"""

# Five-minute slots, of which a window has six.
ACTIVITY = f"""
SELECT tenant_id, make_timestamp(until * 300000000) AS until, count(*) AS events, count(DISTINCT session_id) AS sessions
FROM (SELECT *, epoch_us(time) // 300000000 + unnest(range(1, 7)) AS until FROM ({PLAIN})) GROUP BY 1, 2"""

RETRIED = f"""
SELECT event_id, CASE WHEN NOT one THEN 1 WHEN NOT two THEN 2 ELSE 3 END AS attempts,
  CASE WHEN one AND two AND three THEN 'dead' ELSE 'done' END AS status,
  arrived_at + to_seconds(CASE WHEN NOT one THEN 0 WHEN NOT two THEN 1 ELSE 3 END) AS finished_at
FROM (
  SELECT event_id, date_trunc('millisecond', arrived_at) AS arrived_at, {{}} FROM ({ARRIVALS})
)""".format(", ".join(f"{fx.JOB_FAILS.replace('attempt', str(n))} AS {name}" for n, name in ((1, "one"), (2, "two"), (3, "three"))))


def _range(days: int) -> str:
    return f"tenant_id = '{T0}' AND time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {days} DAY"


def _top(column: str, days: int) -> str:
    return f"""
SELECT {column} AS value, count(*) AS count FROM ({WEB}) WHERE {_range(days)} AND {column} IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


def _series(unit: str, days: int, more: str = "") -> str:
    return f"""
SELECT cast(date_trunc('{unit}', time) AS timestamp) AS bucket, count(*) AS count
FROM ({PLAIN}) WHERE {_range(days)} {more} GROUP BY 1 ORDER BY 1"""


HOURS = f"""
SELECT tenant_id, cast(date_trunc('hour', time) AS timestamp) AS hour, event_name, count(*) AS count
FROM ({PLAIN}) GROUP BY ALL"""


def _by_gap(columns: str) -> str:
    return f"""
SELECT tenant_id, user_id, min(time) AS started_at, max(time){columns} AS ended_at, count(*) AS events,
  count(*) FILTER (WHERE event_name = 'pageview') AS page_count
FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR time - before >= INTERVAL 12 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY tenant_id, user_id ORDER BY time, event_id) AS part
  FROM (SELECT *, lag(time) OVER (PARTITION BY tenant_id, user_id ORDER BY time, event_id) AS before FROM ({PLAIN}))
) GROUP BY tenant_id, user_id, part"""


def _funnel(steps: list[str], where: str = "true") -> str:
    """Earliest match of each step in turn, found by a join on the position within the session."""
    parts = [
        f"""placed AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY time, event_id) AS place
  FROM ({PLAIN}) WHERE {where}
)"""
    ]
    for no, step in enumerate(steps, 1):
        before = (
            "" if no == 1 else
            f"JOIN step{no - 1} s ON s.tenant_id = p.tenant_id AND s.session_id = p.session_id AND p.place > s.at"
        )
        parts.append(
            f"step{no} AS (SELECT p.tenant_id, p.session_id, min(p.place) AS at FROM placed p {before} "
            f"WHERE p.event_name = '{step}' GROUP BY 1, 2)"
        )
    rows = " UNION ALL ".join(
        f"SELECT {no} AS step_no, '{step}' AS event, count(*) AS reached FROM step{no}" for no, step in enumerate(steps, 1)
    )
    return f"""
WITH {', '.join(parts)}, counted AS ({rows})
SELECT step_no, event, reached,
  reached / nullif(first_value(reached) OVER o, 0) AS conversion_from_start,
  reached / nullif(coalesce(lag(reached) OVER o, reached), 0) AS conversion_from_prev
FROM counted WINDOW o AS (ORDER BY step_no)"""


_WHITELIST = "array_to_string(domain_whitelist, '|') AS domain_whitelist"
_NAME_OK = "length({0}) BETWEEN 1 AND {1}"


def _funnel_rows() -> str:
    return f"""
SELECT concat('50000000-0000-4000-8000-', lpad(concat('', request_id), 12, '0')) AS id, tenant_id,
  {_trim('name')} AS name,
  concat('[', array_to_string(list_transform(steps, lambda s: concat(chr(123), '"event":"', {_trim('s')}, '"', chr(125))), ','), ']') AS steps,
  created_at
FROM ({FUNNELS})
WHERE {_trim('name')} <> '' AND len(list_filter(steps, lambda s: {_trim('s')} = '')) = 0"""


_JOB_RULES = {
    "tenantId": f"regexp_matches(tenant_id, '{UUID}')",
    "eventName": f"length({_trim('event_name')}) BETWEEN 1 AND 128",
    "properties": "starts_with(properties, chr(123))",
    "sessionId": f"regexp_matches(session_id, '{UUID}')",
    "url": URL_OK.format("url"),
    "referrer": f"referrer IS NULL OR {URL_OK.format('referrer')}",
    "occurredAt": _iso_ok("occurred_at"),
    "userAgent": "user_agent IS NULL OR length(user_agent) <= 1024",
}

ENRICHED_COLUMNS = f"""
  tenant_id, {_trim('event_name')} AS event_name, properties, session_id, url, referrer,
  cast(NULL AS varchar) AS country, {_device('user_agent')} AS device, {_os('user_agent')} AS os,
  {_browser('user_agent')} AS browser, {_ip_hash('ip_address')} AS ip_hash"""

ISO = "concat(strftime({0}, '%Y-%m-%dT%H:%M:%S.%g'), 'Z')"


def oracle_sql() -> dict[str, str]:
    relay = f"""
SELECT event_id, concat('tenant:', tenant_id) AS room, {ISO.format('time')} AS time, tenant_id, event_name, url,
  referrer, session_id, device, os, browser, properties FROM ({STORED})"""
    gap = _by_gap("")
    latest = f"""
SELECT * EXCLUDE (newest) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS newest FROM ({LOG})
) WHERE newest = 1"""
    limited = f"WITH RECURSIVE {_limiter(f'({ARRIVALS})')} SELECT a.event_id, a.token{{0}}, v.allowed, v.remaining, v.reset_at FROM verdict v JOIN ({ARRIVALS}) a ON a.event_id = v.event_id"
    feed = f"""
SELECT tenant_id, event_id, time, event_name, session_id, place FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY time DESC, event_id DESC) AS place FROM ({PLAIN})
) WHERE place <= 10"""
    sql = {
        "ingest_parse": f"""WITH {PARSED}
SELECT event_id, readable, token, event_name, properties, session_id, url, referrer, occurred_at, user_agent FROM parsed""",
        "ingest_validation": f"WITH {PARSED} SELECT event_id, readable, violations FROM checked",
        "job_validation": f"SELECT event_id, {_broken(_JOB_RULES)} AS violations FROM ({JOBS})",
        "tenant_resolve": f"WITH {RESOLVED} SELECT event_id, tenant_id, status FROM resolved",
        "unknown_tokens": f"SELECT * FROM ({ARRIVALS}) WHERE token NOT IN (SELECT token FROM ({TENANTS}))",
        "whitelist_normalise": f"""
SELECT id, version, place - 1 AS place, {_wl_host('domain_whitelist[place]')} AS host
FROM (SELECT *, unnest(range(1, len(domain_whitelist) + 1)) AS place FROM ({LOG}))""",
        "ua_classes": "SELECT event_id, user_agent, {} FROM ({})".format(
            ", ".join(
                f"{fx._by_rest('event_id', [row[k] for row in fx.AGENT_CLASSES])} AS {name}" for k, name in ((1, "device"), (2, "os"), (3, "browser"))
            ), fx.duckdb_text(fx.CLASSED_AGENTS),
        ),
        "url_host_shapes": f"SELECT page_id, url, {fx._by_rest('page_id', [host for _, host in fx.HOST_SHAPES])} AS host FROM ({fx.duckdb_text(fx.SHAPED_URLS)})",
        "url_host": f"SELECT page_id, {_host('url')} AS host, {URL_OK.format('url')} AS is_url FROM pages",
        "domain_admission": f"""
SELECT e.event_id, {_host('e.url')} AS host,
  len(t.domain_whitelist) = 0 OR len(list_filter(t.domain_whitelist, lambda d:
    {_host('e.url')} = {_wl_host('d')} OR ends_with({_host('e.url')}, concat('.', {_wl_host('d')})))) > 0 AS allowed
FROM ({WEB}) e JOIN ({TENANTS}) t ON t.id = e.tenant_id""",
        "client_ip": f"SELECT event_id, {_client_ip('forwarded_for', 'remote_ip')} AS client_ip FROM ({RAW})",
        "ip_anonymise": f"""
SELECT event_id, CASE WHEN remote_ip IS NOT NULL THEN {_truncated('remote_ip')} END AS truncated,
  {_ip_hash('remote_ip')} AS ip_hash FROM ({RAW})""",
        "ua_enrich": f"""
SELECT event_id, {_device('user_agent')} AS device, {_os('user_agent')} AS os, {_browser('user_agent')} AS browser FROM ({PLAIN})""",
        "arrival_rate": f"""
SELECT token, ms, count(*) AS arrivals, cast(any_value(n) AS bigint) AS in_window FROM (
  SELECT token, ms, count(*) OVER (PARTITION BY token ORDER BY ms RANGE BETWEEN {WINDOW_MS - 1} PRECEDING AND CURRENT ROW) AS n
  FROM (SELECT token, epoch_us(arrived_at) // 1000 AS ms FROM ({ARRIVALS}))
) GROUP BY token, ms""",
        "rate_limit": limited.format(", a.arrived_at"),
        "admission_outcomes": f"""WITH RECURSIVE {ADMITTED}
SELECT cast(status AS integer) AS status, {REASON} AS reason, count(*) AS events FROM outcomes GROUP BY 1, 2""",
        "accepted_events": f"WITH RECURSIVE {ADMITTED} {ACCEPTED}",
        "quarantine": f"""WITH RECURSIVE {ADMITTED}
SELECT event_id, arrived_at, body, cast(status AS integer) AS status, {REASON} AS reason, violations
FROM outcomes WHERE status <> 200""",
        "enriched_events": f"""
SELECT event_id, date_trunc('millisecond', arrived_at) - INTERVAL 2 HOUR AS time, {ENRICHED_COLUMNS}
FROM ({JOBS}) WHERE {_broken(_JOB_RULES)} = ''""",
        "overview_summary": f"""
SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions FROM ({PLAIN}) WHERE {_range(7)}""",
        "top_pages": _top("url", 7),
        "top_referrers": _top("referrer", 30),
        "overview": f"""
SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions,
  (SELECT string_agg(concat(value, '=', count), '|' ORDER BY count DESC, value) FROM ({_top('url', 30)})) AS top_pages,
  (SELECT string_agg(concat(value, '=', count), '|' ORDER BY count DESC, value) FROM ({_top('referrer', 30)})) AS top_referrers
FROM ({PLAIN}) WHERE {_range(30)}""",
        "timeseries_hour": _series("hour", 1),
        "timeseries_day": _series("day", 30),
        "timeseries_day_event": _series("day", 7, "AND event_name = 'pageview'"),
        "series_scaled": f"""
SELECT bucket, count, (row_number() OVER (ORDER BY bucket) - 1) / greatest(count(*) OVER () - 1, 1) AS x,
  (count - min(count) OVER ()) / coalesce(nullif(max(count) OVER () - min(count) OVER (), 0), 1) AS y
FROM ({_series('day', 30)})""",
        "realtime": f"""
SELECT count(*) AS events_last_30_minutes,
  count(DISTINCT session_id) FILTER (WHERE time >= TIMESTAMP '2024-01-30 23:55:00') AS active_users
FROM ({PLAIN}) WHERE tenant_id = '{T0}' AND time >= TIMESTAMP '2024-01-30 23:30:00'""",
        "event_log": f"""
SELECT event_id, time, event_name, properties, session_id, url, referrer, country, device, os, browser
FROM ({STORED}) WHERE tenant_id = '{T0}' ORDER BY time DESC, event_id DESC LIMIT 50 OFFSET 25""",
        "event_log_display": f"""
SELECT event_id, strftime(time, '%b %-d, %I:%M %p') AS shown_time, event_name, coalesce(url, '-') AS shown_url,
  left(session_id, 8) AS shown_session, concat_ws(' / ', device, browser) AS agent
FROM ({STORED}) WHERE tenant_id = '{T2}' ORDER BY time DESC, event_id DESC LIMIT 200""",
        "property_breakdown": f"""
SELECT event_name, json_extract_string(properties, '$.k') AS value, count(*) AS count
FROM ({PLAIN}) WHERE tenant_id = '{T0}' GROUP BY 1, 2""",
        "synthetic_posts": f"""
SELECT moment AS arrived_at, true AS readable, token, name AS event_name, properties,
  regexp_replace(md5(concat('session', token)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS session_id,
  'https://example.com/try' AS url, 'https://example.com/' AS referrer, concat(strftime(moment, '%Y-%m-%dT%H:%M:%S.%g'), 'Z') AS occurred_at
FROM (SELECT token, max(arrived_at) AS moment FROM ({ARRIVALS}) GROUP BY 1), (VALUES
  ('pageview', '{{"section":"catalogue"}}'), ('click', '{{"tag":"a","text":"Order now"}}'), ('signup', '{{"channel":"newsletter"}}')
) AS post(name, properties)""",
        "click_properties": f"""
SELECT event_id, lower(tag) AS tag, nullif(element_id, '') AS id,
  nullif(left(regexp_replace({_trim('text')}, '{SPACE}+', ' ', 'g'), 120), '') AS text, href FROM ({CLICKED})""",
        "tenant_isolation": f"""
SELECT count(*) FILTER (WHERE tenant_id = '{T0}') AS visible, 'hot' AS scope FROM ({PLAIN})
UNION ALL SELECT count(*) FILTER (WHERE tenant_id = '{T2}'), 'other' FROM ({PLAIN})
UNION ALL SELECT 0, 'unset' UNION ALL SELECT 0, 'empty'
UNION ALL SELECT count(*) FILTER (WHERE tenant_id <> '{T0}'), 'foreign to hot' FROM ({PLAIN})""",
        "tenant_visibility": f"SELECT id, owner_user_id FROM ({TENANTS}) WHERE id = '{T2}' OR owner_user_id = '{OWNER}'",
        "batch_by_tenant": f"""
SELECT tenant_id, count(*) AS events, min(time) AS first_time, max(time) AS last_time,
  format('{{:,}}', count(*)) AS shown_events FROM ({PLAIN}) GROUP BY 1""",
        "hourly_stats": HOURS,
        "sessions": f"""
SELECT tenant_id, session_id AS id, min(time) AS started_at, max(time) AS ended_at,
  count(*) FILTER (WHERE event_name = 'pageview') AS page_count, cast(NULL AS varchar) AS country,
  first(device ORDER BY time, event_id) AS device
FROM ({STORED}) GROUP BY 1, 2""",
        "sessions_by_gap": gap,
        "timeseries_from_rollup": _series("day", 30, "AND event_name = 'pageview'"),
        "rollup_reconcile": f"""
SELECT tenant_id, hour, event_name, count + CASE WHEN cast(hour AS date) IN (
  SELECT cast(time AS date) FROM ({PLAIN}) WHERE event_name = 'error' AND extract(day FROM time) % 3 = 0
) THEN 0 ELSE 1000 END AS count FROM ({HOURS})""",
        "funnel_conversion": _funnel(fx.FUNNEL_STEPS[0], f"tenant_id = '{T0}'"),
        "funnel_conversion_range": _funnel(fx.FUNNEL_STEPS[0], _range(7)),
        "funnel_conversion_all_tenants": _funnel(fx.FUNNEL_STEPS[0]),
        "funnel_conversion_two_steps": _funnel(fx.FUNNEL_STEPS[1]),
        "funnel_conversion_repeated_step": _funnel(fx.FUNNEL_STEPS[2]),
        "live_feed": feed,
        "live_relay": relay,
        "live_fanout": f"""
SELECT s.subscriber_id, s.tenant_id, f.event_id, f.time, f.event_name
FROM ({SUBSCRIPTIONS}) s JOIN ({feed}) f ON f.tenant_id = s.tenant_id""",
        "live_delivered": f"""
SELECT s.subscriber_id, s.tenant_id, count(*) AS messages, max(e.time) AS last_time
FROM ({SUBSCRIPTIONS}) s JOIN ({PLAIN}) e ON e.tenant_id = s.tenant_id GROUP BY 1, 2""",
        "tenant_list": f"SELECT id, name, token, {_WHITELIST} FROM ({TENANTS})",
        "tenant_by_token": f"""
SELECT id, token, {_WHITELIST}, plan FROM ({TENANTS}) WHERE token = '{T0.replace('0', '1', 1)}'""",
        "tenant_for_owner": f"""
SELECT u.owner_user_id, t.id, t.name, t.token, array_to_string(t.domain_whitelist, '|') AS domain_whitelist, t.plan
FROM (SELECT DISTINCT owner_user_id FROM ({SETUP})) u LEFT JOIN ({TENANTS}) t ON t.owner_user_id = u.owner_user_id""",
        "tenant_latest": f"SELECT id, name, {_WHITELIST}, version FROM ({latest})",
        "tenant_setup": f"""
SELECT concat('30000000-0000-4000-8000-', lpad(concat('', request_id), 12, '0')) AS id, {_trim('name')} AS name,
  concat('40000000-0000-4000-8000-', lpad(concat('', request_id), 12, '0')) AS token, '' AS domain_whitelist,
  'free' AS plan, requested_at AS created_at, owner_user_id
FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY requested_at, request_id) AS first
  FROM ({SETUP}) WHERE {_trim('name')} <> ''
) WHERE first = 1 AND owner_user_id NOT IN (SELECT owner_user_id FROM ({TENANTS}) WHERE owner_user_id IS NOT NULL)""",
        "domain_update": f"""
SELECT l.id, l.name, array_to_string(list_transform(d.domains, lambda x: {_trim('x')}), '|') AS domain_whitelist, d.version
FROM ({latest}) l JOIN (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS newest FROM ({DOMAINS})
  WHERE len(list_filter(domains, lambda x: {_trim('x')} = '')) = 0
) d ON d.id = l.id AND d.newest = 1""",
        "funnel_create": _funnel_rows(),
        "funnel_list": f"""
SELECT r.id, r.name, array_to_string(list_transform(q.steps, lambda s: {_trim('s')}), ' -> ') AS shown_steps, r.created_at
FROM ({_funnel_rows()}) r JOIN ({FUNNELS}) q
  ON r.id = concat('50000000-0000-4000-8000-', lpad(concat('', q.request_id), 12, '0'))
WHERE r.tenant_id = '{T2}'""",
        "definition_validation": f"""
SELECT 'tenant' AS kind, request_id, {_NAME_OK.format(_trim('name'), 120)} AS sound FROM ({SETUP})
UNION ALL SELECT 'domains', version, len(list_filter(domains, lambda x: {_trim('x')} = '')) = 0 FROM ({DOMAINS})
UNION ALL SELECT 'funnel', request_id, {_NAME_OK.format(_trim('name'), 120)}
  AND len(list_filter(steps, lambda s: {_trim('s')} = '')) = 0 FROM ({FUNNELS})""",
        "parse_list": f"""
SELECT doc_id, len(items) AS items, md5(array_to_string(items, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n|,'), lambda x: {_trim('x')}), lambda x: x <> '') AS items
  FROM documents)""",
        "tenant_purge": f"SELECT event_id, tenant_id FROM ({PLAIN}) WHERE tenant_id NOT IN ({GONE})",
        "tenant_purge_cascade": f"""
SELECT * FROM (
  SELECT 'events' AS kind, tenant_id, count(*) AS rows FROM ({PLAIN}) GROUP BY 2
  UNION ALL SELECT 'hours', tenant_id, count(*) FROM ({HOURS}) GROUP BY 2
  UNION ALL SELECT 'sessions', tenant_id, count(DISTINCT session_id) FROM ({PLAIN}) GROUP BY 2
  UNION ALL SELECT 'funnels', tenant_id, count(*) FROM ({_funnel_rows()}) GROUP BY 2
) WHERE tenant_id NOT IN ({GONE})""",
        "events_append_writers": STORED,
        "null_audit": f"""
SELECT column_name, null_count FROM (
  UNPIVOT (SELECT {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in _EVENT_COLUMNS)} FROM ({STORED}))
  ON {', '.join(_EVENT_COLUMNS)} INTO NAME column_name VALUE null_count)""",
        "unique_audit": " UNION ALL ".join(
            [
                f"SELECT '{key}' AS rule, {key} AS value, count(*) AS copies FROM ({latest}) WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"
                for key in ("id", "token", "owner_user_id")
            ]
            + [f"SELECT 'requested owner', owner_user_id, count(*) FROM ({SETUP}) GROUP BY 2 HAVING count(*) > 1"]
            + [f"SELECT 'hour', tenant_id, count(*) FROM ({HOURS}) GROUP BY tenant_id, hour, event_name HAVING count(*) > 1"]
        ),
        "orphan_audit": f"SELECT tenant_id, count(*) AS rows FROM ({PLAIN}) WHERE tenant_id IN ({GONE}) GROUP BY 1",
        "events_append": f"SELECT *, cast(time AS date) AS event_date FROM ({STORED})",
        "stream_ingest": f"""WITH RECURSIVE {ADMITTED}, accepted AS ({ACCEPTED})
SELECT event_id, date_trunc('millisecond', arrived_at) AS time, {ENRICHED_COLUMNS}, cast(arrived_at AS date) AS event_date
FROM accepted""",
        "stream_rate_limit": limited.format(""),
        "stream_dedupe": f"SELECT event_id, tenant_id, time, event_name FROM ({PLAIN})",
        "stream_hourly": HOURS,
        "stream_sessions": gap,
        "stream_live_feed": feed,
        "ingest_batches": f"SELECT number, first_event, first_time, size FROM ({_batches("''")})",
        "ingest_batches_by_worker": _batches("cast(CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 3 + 1 END AS varchar)"),
        "tenant_resolve_asof": RESOLVE_AS_OF,
        "stream_activity": ACTIVITY,
        "stream_fanout": f"""
SELECT s.subscriber_id, e.tenant_id, e.event_id, e.time, e.event_name
FROM ({PLAIN}) e JOIN ({VISITS}) s ON s.tenant_id = e.tenant_id AND e.time >= s.joined_at AND e.time < s.left_at""",
        "retry_outcomes": RETRIED,
    }
    sql["property_breakdown_stored"] = sql["property_breakdown"]
    sql["stream_batches"] = sql["ingest_batches"]
    sql["overview_from_rollup"] = sql["overview_summary"]
    sql["stream_realtime"] = sql["realtime"]
    return sql


_EVENT_COLUMNS = [
    "event_id", "time", "tenant_id", "event_name", "properties", "session_id", "url", "referrer",
    "country", "device", "os", "browser", "ip_hash",
]
