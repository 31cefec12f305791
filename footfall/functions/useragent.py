"""User-agent classes from the marks an agent text contains. The first rule that fits wins.

Marks are plain substrings: some fifty patterns per row would make this the dearest step of the
pipeline, while substring tests are cheap enough to need no table of distinct agents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values: (class, marks of which one must occur, of which one must occur as well, that must
# not occur).
BROWSERS = [
    ("Facebook", ["FBAN/", "FBAV/"], [], []),
    ("Instagram", ["Instagram"], [], []),
    ("WeChat", ["MicroMessenger"], [], []),
    ("Edge", ["Edg/", "EdgA/", "EdgiOS/", "Edge/"], [], []),
    ("Opera", ["OPR/", "Opera"], [], []),
    ("Vivaldi", ["Vivaldi/"], [], []),
    ("Yandex", ["YaBrowser/"], [], []),
    ("Samsung Internet", ["SamsungBrowser/"], [], []),
    ("UCBrowser", ["UCBrowser/"], [], []),
    ("DuckDuckGo", ["DuckDuckGo/"], [], []),
    ("Huawei Browser", ["HuaweiBrowser/"], [], []),
    ("Silk", ["Silk/"], [], []),
    ("GSA", ["GSA/"], [], []),
    ("IE", ["MSIE ", "Trident/"], [], []),
    ("Chrome Headless", ["HeadlessChrome"], [], []),
    ("Chrome WebView", ["; wv)"], ["Chrome/"], []),
    ("Firefox", ["FxiOS/", "Firefox/"], [], []),
    ("Chromium", ["Chromium/"], [], []),
    ("Chrome", ["CriOS/", "Chrome/"], [], []),
    ("Android Browser", ["Android"], ["Safari/"], []),
    ("Mobile Safari", ["Version/"], ["Mobile/", "Mobile Safari/"], []),
    ("Safari", ["Version/"], ["Safari/"], []),
]
SYSTEMS = [
    ("Windows Phone", ["Windows Phone"], [], []),
    ("Xbox", ["Xbox"], [], []),
    ("PlayStation", ["PlayStation", "PLAYSTATION"], [], []),
    ("Nintendo", ["Nintendo"], [], []),
    ("Windows", ["Windows"], [], []),
    ("iOS", ["iPhone", "iPad", "iPod"], [], []),
    ("Tizen", ["Tizen"], [], []),
    ("webOS", ["Web0S", "webOS", "WebOS"], [], []),
    ("HarmonyOS", ["HarmonyOS"], [], []),
    ("KAIOS", ["KAIOS"], [], []),
    ("Android", ["Android"], [], []),
    ("Chromium OS", ["CrOS"], [], []),
    ("Mac OS", ["Macintosh", "Mac OS X"], [], []),
    ("Ubuntu", ["Ubuntu"], [], []),
    ("Debian", ["Debian"], [], []),
    ("Fedora", ["Fedora"], [], []),
    ("FreeBSD", ["FreeBSD"], [], []),
    ("BlackBerry", ["BlackBerry", "BB10"], [], []),
    ("Linux", ["Linux"], [], []),
]
DEVICES = [
    ("console", ["PlayStation", "PLAYSTATION", "Xbox", "Nintendo"], [], []),
    ("smarttv", ["SmartTV", "SMART-TV", "Smart-TV", "AppleTV", "BRAVIA", "GoogleTV", "HbbTV", "CrKey", "Roku", "AFT", "Web0S"], [], []),
    ("wearable", ["Watch", "Glass "], [], []),
    ("tablet", ["iPad", "Tablet", "Kindle"], [], []),
    ("tablet", ["Android", "Silk/"], [], ["Mobile"]),
    ("mobile", ["iPhone", "iPod", "Mobile", "Windows Phone", "BlackBerry", "BB10", "KAIOS"], [], []),
    ("embedded", ["Tesla/", "QtCarBrowser"], [], []),
]


def _any(agent: Column, marks: list[str]) -> Column:
    return reduce(Column.__or__, [agent.contains(mark) for mark in marks])


def _class(agent: Column, rules: list[tuple[str, list[str], list[str], list[str]]]) -> Column:
    result = F
    for name, marks, others, absent in rules:
        fits = _any(agent, marks)
        if others:
            fits = fits & _any(agent, others)
        if absent:
            fits = fits & ~_any(agent, absent)
        result = result.when(fits, name)
    return result


def browser(agent: Column) -> Column:
    return _class(agent, BROWSERS)


def operating_system(agent: Column) -> Column:
    return _class(agent, SYSTEMS)


def device(agent: Column) -> Column:
    return F.coalesce(_class(agent, DEVICES), F.lit("desktop"))
