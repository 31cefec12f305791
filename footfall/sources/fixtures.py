"""Web events, raw posts and tenants derived from the test tables.

The SQL here is shared by Spark and DuckDB, so both start from the same rows. A third of the users
belongs to tenant 0, which makes it a hot key. ``FIXTURES.md`` describes the columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.functions import useragent

AS_OF = datetime(2024, 1, 31)
HOT_TENANT = "00000000-0000-4000-8000-000000000000"

# Expressions the two engines spell differently.
SPARK = {
    "iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")",
    "days_after": "(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({0} as int)))",
    "array": "array({0})",
    "strings": "cast(array() as array<string>)",
    "at_second": "timestampadd(SECOND, cast({0} as int), timestamp_ntz'2024-01-01 00:00:00')",
}
DUCKDB = {
    "iso": "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g')",
    "days_after": "(timestamp '2024-01-01 00:00:00' + to_days(cast({0} as integer)))",
    "array": "[{0}]",
    "strings": "cast([] as varchar[])",
    "at_second": "(timestamp '2024-01-01 00:00:00' + to_seconds({0}))",
}

# Six kinds of agent, and the class each belongs to.
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 13; Pixel 7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
    None,
]

_K = "AppleWebKit/537.36 (KHTML, like Gecko)"
_IOS = "AppleWebKit/605.1.15 (KHTML, like Gecko)"
# Agents of many kinds, and the device, system and browser of each.
AGENT_CLASSES = [
    (f"Mozilla/5.0 (Windows NT 10.0; Win64; x64) {_K} Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91", "desktop", "Windows", "Edge"),
    (f"Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) {_K} Chrome/119.0.0.0 Safari/537.36 OPR/105.0.0.0", "desktop", "Mac OS", "Opera"),
    (f"Mozilla/5.0 (Linux; Android 13; SAMSUNG SM-S918B) {_K} SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36", "mobile", "Android", "Samsung Internet"),
    (f"Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) {_IOS} Version/16.6 Mobile/15E148 Safari/604.1", "tablet", "iOS", "Mobile Safari"),
    (f"Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) {_IOS} CriOS/120.0.6099.50 Mobile/15E148 Safari/604.1", "mobile", "iOS", "Chrome"),
    ("Mozilla/5.0 (Android 13; Mobile; rv:121.0) Gecko/121.0 Firefox/121.0", "mobile", "Android", "Firefox"),
    (f"Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) {_IOS} FxiOS/120.0 Mobile/15E148 Safari/605.1.15", "mobile", "iOS", "Firefox"),
    (f"Mozilla/5.0 (Linux; Android 12; SM-X906C) {_K} Chrome/119.0.0.0 Safari/537.36", "tablet", "Android", "Chrome"),
    ("Mozilla/5.0 (Windows NT 10.0; WOW64; Trident/7.0; rv:11.0) like Gecko", "desktop", "Windows", "IE"),
    ("Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 6.1)", "desktop", "Windows", "IE"),
    (f"Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) {_K} Chrome/119.0.0.0 Safari/537.36", "desktop", "Chromium OS", "Chrome"),
    ("Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0", "desktop", "Ubuntu", "Firefox"),
    ("Mozilla/5.0 (X11; Fedora; Linux x86_64; rv:118.0) Gecko/20100101 Firefox/118.0", "desktop", "Fedora", "Firefox"),
    ("Mozilla/5.0 (X11; FreeBSD amd64; rv:115.0) Gecko/20100101 Firefox/115.0", "desktop", "FreeBSD", "Firefox"),
    (f"Mozilla/5.0 (X11; Linux x86_64) {_K} Ubuntu Chromium/80.0.3987.87 Chrome/80.0.3987.87 Safari/537.36", "desktop", "Ubuntu", "Chromium"),
    (f"Mozilla/5.0 (PlayStation; PlayStation 5/4.03) {_IOS} Version/13.0 Safari/605.1.15", "console", "PlayStation", "Safari"),
    (f"Mozilla/5.0 (Windows NT 10.0; Win64; x64; Xbox; Xbox One) {_K} Chrome/48.0.2564.82 Safari/537.36 Edge/20.02", "console", "Xbox", "Edge"),
    (f"Mozilla/5.0 (Web0S; Linux/SmartTV) {_K} Chrome/79.0.3945.79 Safari/537.36", "smarttv", "webOS", "Chrome"),
    (f"Mozilla/5.0 (SMART-TV; Linux; Tizen 6.0) {_K} SamsungBrowser/2.2 Chrome/63.0.3239.84 TV Safari/537.36", "smarttv", "Tizen", "Samsung Internet"),
    (f"Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) {_IOS} Mobile/15E148 [FBAN/FBIOS;FBAV/440.0.0.0]", "mobile", "iOS", "Facebook"),
    (f"Mozilla/5.0 (Linux; Android 13; Pixel 7; wv) {_K} Version/4.0 Chrome/119.0 Mobile Safari/537.36 Instagram 300.0", "mobile", "Android", "Instagram"),
    (f"Mozilla/5.0 (Linux; Android 12; M2101; wv) {_K} Version/4.0 Chrome/107.0 Mobile Safari/537.36 MicroMessenger/8.0", "mobile", "Android", "WeChat"),
    (f"Mozilla/5.0 (Linux; Android 13; Pixel 7; wv) {_K} Version/4.0 Chrome/119.0 Mobile Safari/537.36", "mobile", "Android", "Chrome WebView"),
    (f"Mozilla/5.0 (Linux; Android 9; KFMAWI) {_K} Silk/108.4.6 like Chrome/108.0 Safari/537.36", "tablet", "Android", "Silk"),
    (f"Mozilla/5.0 (X11; Linux x86_64) {_K} HeadlessChrome/119.0 Safari/537.36", "desktop", "Linux", "Chrome Headless"),
    (f"Mozilla/5.0 (Windows NT 10.0; Win64; x64) {_K} Chrome/118.0.0.0 Safari/537.36 Vivaldi/6.4", "desktop", "Windows", "Vivaldi"),
    (f"Mozilla/5.0 (Windows NT 10.0; Win64; x64) {_K} Chrome/118.0.0.0 YaBrowser/23.11 Safari/537.36", "desktop", "Windows", "Yandex"),
    (f"Mozilla/5.0 (Linux; U; Android 11; en-US; RMX2001) {_K} Version/4.0 Chrome/100.0 UCBrowser/13.5 Mobile Safari/537.36", "mobile", "Android", "UCBrowser"),
    (f"Mozilla/5.0 (Linux; Android 13; Pixel 6) {_K} Version/4.0 Chrome/118.0 Mobile DuckDuckGo/5 Safari/537.36", "mobile", "Android", "DuckDuckGo"),
    (f"Mozilla/5.0 (Linux; Android 10; HarmonyOS; ELS-AN00) {_K} Chrome/99.0 HuaweiBrowser/13.0 Mobile Safari/537.36", "mobile", "HarmonyOS", "Huawei Browser"),
    (f"Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) {_IOS} GSA/290.0 Mobile/15E148 Safari/604.1", "mobile", "iOS", "GSA"),
    (f"Mozilla/5.0 (Linux; U; Android 4.0.3; de-de; GT-I9100) {_K} Version/4.0 Mobile Safari/534.30", "mobile", "Android", "Android Browser"),
    ("curl/8.4.0", "desktop", None, None),
]


def _uuid(prefix: str, number: str) -> str:
    return f"concat('{prefix}-0000-4000-8000-', lpad(concat('', {number}), 12, '0'))"


def _by_rest(number: str, values: list[str | None]) -> str:
    cases = " ".join(
        f"WHEN {rest} THEN '{value}'" for rest, value in enumerate(values) if value is not None
    )
    return f"CASE {number} % {len(values)} {cases} END"


TENANTS_COUNT = "{tenants_count}"
PAGES_COUNT = "{pages_count}"
TENANT_NO = f"CASE WHEN e.user_id % 3 = 0 THEN 0 ELSE 1 + e.user_id % ({TENANTS_COUNT} - 1) END"
AGENT = _by_rest("e.event_id", AGENTS)
SESSION = (
    "concat('00000000-0000-4000-8', lpad(concat('', extract(day FROM e.ts)), 3, '0'), '-', "
    "lpad(concat('', e.user_id), 12, '0'))"
)
EVENT_NAME = "CASE WHEN e.event_type = 'view' THEN 'pageview' ELSE e.event_type END"
REMOTE_IP = (
    "CASE WHEN e.event_id % 13 = 0 THEN NULL "
    "WHEN e.event_id % 5 = 0 THEN concat('2001:db8:', e.user_id % 97, '::', e.event_id % 89) "
    "WHEN e.event_id % 11 = 0 THEN concat('::ffff:203.0.', e.user_id % 200, '.', e.event_id % 250) "
    "ELSE concat('203.0.', e.user_id % 200, '.', e.event_id % 250) END"
)
FORWARDED = (
    "CASE WHEN e.event_id % 4 = 0 THEN concat(' 198.51.', e.user_id % 100, '.', e.event_id % 200, ' , 10.0.0.1') "
    "WHEN e.event_id % 4 = 1 THEN '' WHEN e.event_id % 16 = 2 THEN ' ,10.0.0.1' END"
)

# One of 13 users has a token that no tenant owns.
TOKEN = (
    f"CASE WHEN e.user_id % 13 = 5 THEN {_uuid('19999999', 'e.user_id')} "
    f"ELSE {_uuid('10000000', TENANT_NO)} END"
)

WITH_PAGES = f"""
FROM (
  SELECT x.*, ((x.event_id % {PAGES_COUNT}) * (x.event_id % {PAGES_COUNT})) % {PAGES_COUNT} AS page_no,
    CASE WHEN x.event_id % 3 = 0 THEN (x.event_id * 7) % {PAGES_COUNT} END AS referrer_no
  FROM {{events}} x) e
JOIN {{pages}} p ON p.page_id = e.page_no
LEFT JOIN {{pages}} r ON r.page_id = e.referrer_no
"""

_WEB_COLUMNS = f"""
e.event_id, e.ts AS time, {_uuid('00000000', TENANT_NO)} AS tenant_id, {EVENT_NAME} AS event_name,
e.props AS properties, {SESSION} AS session_id, {AGENT} AS user_agent, e.user_id
"""

# Events without the two page joins, for the reports that do not read a URL.
PLAIN_EVENTS = f"SELECT {_WEB_COLUMNS} FROM {{events}} e"
WEB_EVENTS = f"SELECT {_WEB_COLUMNS}, p.url AS url, r.url AS referrer {WITH_PAGES}"

ARRIVALS = f"SELECT e.event_id, {TOKEN} AS token, e.ts AS arrived_at FROM {{events}} e"


def raw_posts(dialect: dict[str, str]) -> str:
    """Posts as the collector gets them, some of them broken in a known way."""
    field = lambda name, value: f"'\"{name}\":\"', {value}, '\"'"
    body = ", ".join(
        [
            "chr(123)",
            field("token", TOKEN),
            "','",
            field("eventName", f"CASE WHEN e.event_id % 89 = 0 THEN 'two words' ELSE {EVENT_NAME} END"),
            "',\"properties\":', e.props, ','",
            field("sessionId", f"CASE WHEN e.event_id % 97 = 0 THEN 'not-a-uuid' ELSE {SESSION} END"),
            "','",
            field("url", "CASE WHEN e.event_id % 79 = 0 THEN 'not a url' ELSE p.url END"),
            "CASE WHEN r.url IS NULL THEN '' ELSE concat(',\"referrer\":\"', r.url, '\"') END",
            "CASE WHEN e.event_id % 61 = 0 THEN '' ELSE concat(',\"occurredAt\":\"', "
            + dialect["iso"].format("e.ts")
            + ", CASE WHEN e.event_id % 73 = 0 THEN '' WHEN e.event_id % 2 = 0 THEN 'Z' ELSE '+00:00' END, '\"') END",
            "CASE WHEN e.event_id % 83 = 0 THEN ',\"extra\":1' ELSE '' END",
            "CASE WHEN e.event_id % 71 = 0 THEN '' ELSE chr(125) END",
        ]
    )
    return (
        f"SELECT e.event_id, e.ts AS arrived_at, concat({body}) AS body, {AGENT} AS header_user_agent, "
        f"{FORWARDED} AS forwarded_for, {REMOTE_IP} AS remote_ip {WITH_PAGES}"
    )


def tenants(dialect: dict[str, str]) -> str:
    """One tenant per supplier; whitelists by the supplier's nation."""
    lists = dialect["array"].format
    return f"""
    SELECT {_uuid('00000000', 's.s_suppkey')} AS id, s.s_name AS name,
      {_uuid('10000000', 's.s_suppkey')} AS token,
      CASE s.s_nationkey % 4
        WHEN 0 THEN {dialect['strings']}
        WHEN 1 THEN {lists("'example.com', ' Example.org '")}
        WHEN 2 THEN {lists("'https://m.example.net/x', '  ', 'example.com:3000/a'")}
        ELSE {lists("'example.net'")} END AS domain_whitelist,
      CASE WHEN s.s_acctbal > 5000 THEN 'pro' ELSE 'free' END AS plan,
      {dialect['days_after'].format('s.s_suppkey % 30')} AS created_at,
      CASE WHEN s.s_suppkey % 7 = 6 THEN NULL ELSE {_uuid('20000000', 's.s_suppkey')} END AS owner_user_id
    FROM {{supplier}} s"""


def tenant_log(dialect: dict[str, str]) -> str:
    """Whitelist changes: version 0 of each tenant, then one version per order."""
    lists = dialect["array"].format
    return f"""
    SELECT t.id, t.name, t.token, t.domain_whitelist, t.plan, t.created_at, t.owner_user_id,
      cast(0 AS bigint) AS version FROM ({tenants(dialect)}) t
    UNION ALL
    SELECT t.id, t.name, t.token, {lists("concat(' D', o.o_orderkey % 1000, '.Example.com:8080/x '), 'https://Shop.example.org/a'")},
      t.plan, t.created_at, t.owner_user_id, o.o_orderkey + 1 AS version
    FROM {{orders}} o JOIN ({tenants(dialect)}) t ON t.id = {_uuid('00000000', f'o.o_custkey % {TENANTS_COUNT}')}"""


def setup_requests(dialect: dict[str, str]) -> str:
    """Two customers ask for each owner; some owners have a tenant already, some names are blank."""
    return f"""
    SELECT c.c_custkey AS request_id, {_uuid('20000000', 'cast(floor(c.c_custkey / 2) AS bigint)')} AS owner_user_id,
      CASE WHEN c.c_custkey % 10 = 3 THEN '  ' ELSE concat(' ', c.c_name, ' ') END AS name,
      {dialect['days_after'].format('c.c_custkey % 5')} AS requested_at
    FROM {{customer}} c"""


def domain_requests(dialect: dict[str, str]) -> str:
    """Whitelist replacements by customers; some hold a blank entry and are refused."""
    lists = dialect["array"].format
    return f"""
    SELECT {_uuid('00000000', f'c.c_custkey % ({TENANTS_COUNT} + 5)')} AS id,
      CASE WHEN c.c_custkey % 9 = 4 THEN {lists("'a.example.com', ' '")}
        ELSE {lists("concat(' n', c.c_nationkey, '.example.com'), lower(c.c_mktsegment)")} END AS domains,
      100000000 + c.c_custkey AS version
    FROM {{customer}} c"""


def queued_jobs(dialect: dict[str, str]) -> str:
    """Jobs as the enrichment reads them, some of them broken in a known way."""
    return f"""
    SELECT e.event_id, e.ts AS arrived_at,
      CASE WHEN e.event_id % 53 = 0 THEN 'nobody' ELSE {_uuid('00000000', TENANT_NO)} END AS tenant_id,
      CASE WHEN e.event_id % 59 = 0 THEN repeat('x', 129) WHEN e.event_id % 67 = 0 THEN ' two words '
        ELSE {EVENT_NAME} END AS event_name,
      CASE WHEN e.event_id % 43 = 0 THEN '[1]' ELSE e.props END AS properties,
      {SESSION} AS session_id,
      CASE WHEN e.event_id % 79 = 0 THEN 'http:///' ELSE p.url END AS url,
      CASE WHEN e.event_id % 47 = 0 THEN '/relative' ELSE r.url END AS referrer,
      concat({dialect['iso'].format('e.ts')}, CASE WHEN e.event_id % 73 = 0 THEN '' ELSE '+02:00' END) AS occurred_at,
      {AGENT} AS user_agent, {REMOTE_IP} AS ip_address
    {WITH_PAGES}"""


# Clicks on elements whose text is a whole document.
CLICKED = f"""
SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN 'A' ELSE 'BUTTON' END AS tag,
  CASE WHEN e.event_id % 3 = 0 THEN '' ELSE concat('element-', e.user_id) END AS element_id,
  concat(' ', d.text, ' ') AS text,
  CASE WHEN e.event_id % 2 = 0 THEN concat('https://example.com/', e.event_type) END AS href
FROM {{events}} e JOIN {{documents}} d ON d.doc_id = e.event_id % {{documents_count}}
WHERE e.event_type = 'click'"""

# Tenants to remove.
GONE = f"SELECT {_uuid('00000000', 's.s_suppkey')} AS tenant_id FROM {{supplier}} s WHERE s.s_acctbal < 2000"

FUNNEL_STEPS = [["pageview", "click", "purchase"], ["pageview", "signup"], ["click", "click"]]


def funnel_requests(dialect: dict[str, str]) -> str:
    """One definition per customer for the tenant of the customer's number."""
    lists = dialect["array"].format
    steps = [lists(", ".join(f"'{s}'" for s in names)) for names in FUNNEL_STEPS]
    return f"""
    SELECT c.c_custkey AS request_id, {_uuid('00000000', f'c.c_custkey % {TENANTS_COUNT}')} AS tenant_id,
      concat(' ', c.c_mktsegment, ' ') AS name,
      CASE c.c_custkey % 5 WHEN 0 THEN {steps[0]} WHEN 1 THEN {steps[1]} WHEN 2 THEN {steps[2]}
        WHEN 3 THEN {lists("' pageview ', 'purchase'")} ELSE {lists("'pageview', ' '")} END AS steps,
      {dialect['days_after'].format('c.c_custkey % 28')} AS created_at
    FROM {{customer}} c"""


SUBSCRIPTIONS = f"""
SELECT c.c_custkey AS subscriber_id, {_uuid('00000000', f'c.c_custkey % {TENANTS_COUNT}')} AS tenant_id
FROM {{customer}} c"""

CLASSED_AGENTS = "SELECT e.event_id, {} AS user_agent FROM {{events}} e".format(_by_rest("e.event_id", [row[0] for row in AGENT_CLASSES]))

# Jobs of the enrichment; three of ten attempts fail.
JOB_FAILS = "(event_id * 7919 + attempt * 104729) % 10 < 3"


# Ways to write a host, and the host that a browser takes each for.
HOST_SHAPES = [
    ("http://Plain.example.com", "plain.example.com"), ("http://ex%61mple.com", "example.com"), ("https://caf%C3%A9.example", "xn--caf-dma.example"),
    ("http://127.1", "127.0.0.1"), ("http://0x7F000001", "127.0.0.1"), ("http://0300.0250.1", "192.168.0.1"), ("http://256.1.1.1", None),
    ("https://bücher.example", "xn--bcher-kva.example"), ("http://例え.テスト", "xn--r8jz45g.xn--zckzah"), ("http://a%2Fb.example", None),
    ("http://user@1.2.3.4:8080", "1.2.3.4"),
]
SHAPED_URLS = "SELECT p.page_id, concat({}, '/', p.page_id) AS url FROM {{pages}} p".format(
    _by_rest("p.page_id", [url for url, _ in HOST_SHAPES])
)


def tenant_versions(dialect: dict[str, str]) -> str:
    """The tenant log with the time of each version: version 0 as the tenant was made, others all over the month."""
    return f"""
    SELECT v.id, v.token, v.version,
      CASE WHEN v.version = 0 THEN v.created_at ELSE {dialect['at_second'].format('(v.version * 7919) % 2592000')} END AS changed_at
    FROM ({tenant_log(dialect)}) v"""


def room_visits(dialect: dict[str, str]) -> str:
    """When customers watch their tenant: one visit each, of up to 20 hours."""
    joined = "(c.c_custkey * 7001) % 2500000"
    return f"""
    SELECT c.c_custkey AS subscriber_id, {_uuid('00000000', f'c.c_custkey % {TENANTS_COUNT}')} AS tenant_id,
      {dialect['at_second'].format(joined)} AS joined_at,
      {dialect['at_second'].format(f'{joined} + (c.c_custkey % 20) * 3600 + c.c_custkey % 61')} AS left_at
    FROM {{customer}} c"""


TABLES = ("events", "pages", "supplier", "customer", "orders", "documents")


COUNTS = {"tenants_count": "supplier", "pages_count": "pages", "documents_count": "documents"}

_counted: dict[tuple[str, str], int] = {}


class Fixtures:
    """The fixture tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _count(self, name: str) -> int:
        """Row count, from the file's footer."""
        key = (self.folder, name)
        if key not in _counted:
            _counted[key] = self.table(name).count()
        return _counted[key]

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        tables = {name: self.table(name) for name in TABLES if f"{{{name}}}" in text} | given
        counts = {name: self._count(table) for name, table in COUNTS.items() if f"{{{name}}}" in text}
        return self.spark.sql(text, **tables, **counts)

    def _spread_events(self) -> DataFrame:
        """The event file is a single split; posts and jobs come in many files."""
        return self.table("events").repartition(self.spark.sparkContext.defaultParallelism)

    def plain_events(self) -> DataFrame:
        return self.sql(PLAIN_EVENTS)

    def web_events(self) -> DataFrame:
        return self.sql(WEB_EVENTS)

    def arrivals(self) -> DataFrame:
        return self.sql(ARRIVALS)

    def raw_posts(self) -> DataFrame:
        return self.sql(raw_posts(SPARK), events=self._spread_events())

    def tenants(self) -> DataFrame:
        return self.sql(tenants(SPARK))

    def tenant_log(self) -> DataFrame:
        return self.sql(tenant_log(SPARK))

    def tenant_versions(self) -> DataFrame:
        return self.sql(tenant_versions(SPARK))

    def room_visits(self) -> DataFrame:
        return self.sql(room_visits(SPARK))

    def setup_requests(self) -> DataFrame:
        return self.sql(setup_requests(SPARK))

    def domain_requests(self) -> DataFrame:
        return self.sql(domain_requests(SPARK))

    def funnel_requests(self) -> DataFrame:
        return self.sql(funnel_requests(SPARK))

    def queued_jobs(self) -> DataFrame:
        return self.sql(queued_jobs(SPARK), events=self._spread_events())

    def stored_events(self) -> DataFrame:
        """Web events in the shape of the event table."""
        agent = F.col("user_agent")
        return self.web_events().select(
            "event_id", "time", "tenant_id", "event_name", "properties", "session_id", "url", "referrer",
            F.lit(None).cast("string").alias("country"),
            useragent.device(agent).alias("device"),
            useragent.operating_system(agent).alias("os"),
            useragent.browser(agent).alias("browser"),
            F.lit(None).cast("string").alias("ip_hash"),
        )

    def subscriptions(self) -> DataFrame:
        return self.sql(SUBSCRIPTIONS)


def duckdb_text(text: str) -> str:
    """The same SQL over the plain table names."""
    counts = {name: f"(SELECT count(*) FROM {table})" for name, table in COUNTS.items()}
    return text.format(**{name: name for name in TABLES}, **counts)
