"""URLs, host names, whitelists and IP addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.text import trimmed

# The schemes whose URLs always carry a host, the characters no host may contain, and
# the ports there are.
HOST_SCHEMES = r"(?i:https?|wss?|ftp):"
ANY_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
HOST = r"\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#/<>?@\[\\\]^|%\x7F:]+"
PORT = r"0*(?:[0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"

_EDGE = r"[\x00-\x20]*"
_AUTHORITY = rf"(?:[^/\\?#@]*@)*({HOST})(?::{PORT})?(?:[/\\?#]|{_EDGE}$)"
_WITH_HOST = rf"^{_EDGE}(?:{HOST_SCHEMES}[/\\]*|{ANY_SCHEME}//){_AUTHORITY}"
_URL = rf"^{_EDGE}(?:{HOST_SCHEMES}[/\\]*{_AUTHORITY}|(?!{HOST_SCHEMES}){ANY_SCHEME})"


def _one_line(url: Column) -> Column:
    """Tabs and line ends anywhere in a URL do not count."""
    breaks = r"[\t\r\n]"
    return F.when(url.rlike(breaks), F.regexp_replace(url, breaks, "")).otherwise(url)


def url_host(url: Column) -> Column:
    """Lower-case host name, NULL for text that is not a URL with a host."""
    return F.nullif(F.lower(F.regexp_extract(_one_line(url), _WITH_HOST, 1)), F.lit(""))


def is_url(url: Column) -> Column:
    """Any scheme will do; schemes that need a host must have one."""
    return _one_line(url).rlike(_URL)


def whitelist_host(entry: Column) -> Column:
    """The host a whitelist entry stands for; NULL for entries that stand for none."""
    text = F.lower(trimmed(entry))
    bare = F.split_part(F.split_part(text, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.nullif(F.when(text.contains("://"), url_host(text)).otherwise(bare), F.lit(""))


def dotted(host: Column) -> Column:
    """With a dot in front, a host equals or lies under another exactly if it ends with it."""
    return F.concat(F.lit("."), host)


def whitelist_endings(whitelist: Column) -> Column:
    """The dotted hosts of a whitelist, NULL for an empty one, which allows all."""
    endings = F.transform(whitelist, lambda entry: dotted(whitelist_host(entry)))
    return F.when(F.size(whitelist) > 0, F.array_compact(endings))


def domain_allowed(dotted_host: Column, endings: Column) -> Column:
    """Whether a host is whitelisted; NULL ``endings`` allow all."""
    listed = F.exists(endings, dotted_host.endswith)
    return endings.isNull() | F.coalesce(listed, F.lit(False))


def truncated_ip(ip: Column) -> Column:
    """IPv4 without its last octet, IPv6 without its last two groups, other text unchanged."""
    plain = trimmed(F.regexp_replace(ip, "^::ffff:", ""))
    octets = F.split(plain, r"\.")
    groups = F.split(plain, ":")
    kept = F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 2, F.lit(1)))
    return (
        F.when(
            plain.contains(".") & (F.size(octets) == 4),
            F.concat(F.array_join(F.slice(octets, 1, 3), "."), F.lit(".0")),
        )
        .when(plain.contains(":"), F.concat(F.array_join(kept, ":"), F.lit("::")))
        .otherwise(plain)
    )


def ip_hash(ip: Column) -> Column:
    return F.sha2(F.nullif(truncated_ip(F.nullif(ip, F.lit(""))), F.lit("")), 256)


def client_ip(forwarded_for: Column, remote_ip: Column) -> Column:
    """First forwarded entry if the header is there, else the socket's address."""
    first = trimmed(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    has_header = F.coalesce(forwarded_for != "", F.lit(False))
    return F.nullif(F.when(has_header, first).otherwise(remote_ip), F.lit(""))
