"""URL filters: one trie over reversed host labels, then path segments, broadcast to the tasks.

A rule ``(host, path, verdict)`` fits its host and all subdomains if the URL's path starts with the
rule's path. Of the rules that fit, the longest (host and path together) wins, then the longer host,
then ``block``. Rules are read up to ``MAX_RULES`` and the trie is broadcast; more rules are refused
with an error rather than cut.

Defined cases: a null URL or one without ``://`` has empty host and path; without a fitting rule the
verdict is ``default``; repeated rules count once; an empty table gives no rows; all columns of the
input are kept, and the new ones are named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MAX_RULES = 1_000_000
RULE, HERE = "rule", "paths"
VERDICT = "rule string, verdict string"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Labels from the right, then path segments; what follows the last ``/`` is kept as a start."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault((HERE,), {})
        *segments, tail = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        tails = node.setdefault((RULE,), {})
        if tails.get(tail, ("", ""))[1] != "block":
            tails[tail] = (host + path, verdict)
    return root


def _in_path(node: dict, path: str, best: tuple, depth: int) -> tuple:
    segments = path.split("/")
    for i, segment in enumerate(segments):
        for tail, (rule, verdict) in node.get((RULE,), {}).items():
            # The start may cover the rest of this segment only; later ones have nodes of their own.
            if segment.startswith(tail):
                best = max(best, (len(rule), depth, rule, verdict))
        if i == len(segments) - 1 or segment not in node:
            return best
        node = node[segment]
    return best


def judge(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits and its verdict."""
    best: tuple = (-1, -1, None, None)
    node, depth = trie, 0
    if (HERE,) in node:
        best = _in_path(node[(HERE,)], path, best, depth)
    for label in reversed(host.split(".")):
        if label not in node:
            break
        node, depth = node[label], depth + 1
        if (HERE,) in node:
            best = _in_path(node[(HERE,)], path, best, depth)
    return best[2], best[3]


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``url_host``, ``url_path``, ``url_rule`` and ``url_verdict``.

    ``rules`` has the columns host, path and verdict (``allow`` or ``block``).
    """
    spark = pages.sparkSession
    known = rules.select("host", "path", "verdict").distinct().limit(MAX_RULES + 1).collect()
    if len(known) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules do not fit the broadcast; split them by top-level label")
    trie = spark.sparkContext.broadcast(build_trie(sorted((r.host, r.path, r.verdict) for r in known)))

    @F.pandas_udf(VERDICT)
    def verdicts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [judge(trie.value, h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    url = F.col(url_col)
    return (
        pages.withColumns({"url_host": host_of(url), "url_path": path_of(url)})
        .withColumn("_found", verdicts("url_host", "url_path"))
        .withColumn("url_rule", F.col("_found.rule"))
        .withColumn("url_verdict", F.coalesce("_found.verdict", F.lit(default)))
        .drop("_found")
    )
