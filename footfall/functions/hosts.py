"""Host names as a browser reads them: percent signs decoded, IPv4 in any of its spellings, international names in Punycode.

Plain names, which are nearly all, are only cut out and put in lower case; the rest is work that ``CASE`` leaves undone for them.
Hosts of schemes that are not for the web are left as they stand. Letters are put in lower case and the three other full stops count as dots;
further mappings of compatible characters are not made.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.net import ANY_SCHEME, HOST_SCHEMES, PORT, _EDGE, _one_line

# What may stand for a host before it is decoded, and what may not be in it afterwards.
_WRITTEN = r"\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#/<>?@\[\\\]^|\x7F:]+"
_FORBIDDEN = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F�]"
_WEB = rf"^{_EDGE}{HOST_SCHEMES}[/\\]*(?:[^/\\?#@]*@)*({_WRITTEN})(?::{PORT})?(?:[/\\?#]|{_EDGE}$)"
_OTHER = rf"^{_EDGE}(?!{HOST_SCHEMES}){ANY_SCHEME}//(?:[^/\\?#@]*@)*({_WRITTEN})(?::{PORT})?(?:[/\\?#]|{_EDGE}$)"
#: A name of ASCII letters, digits and such whose last label is no number, or an address in brackets.
_PLAIN = r"^(?:\[.*|(?:[^%\x80-\x{10FFFF}]*\.)?(?!0[xX][0-9A-Fa-f]*\.?$)[^%.\x80-\x{10FFFF}]*[^%.0-9\x80-\x{10FFFF}][^%.\x80-\x{10FFFF}]*\.?)$"
_NUMBER = r"^(?:0x[0-9a-f]*|[0-9]+)$"
_DOTS = "[。．｡]"
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _ipv4_number(part: Column) -> Column:
    """The number a part stands for (0x: base 16, leading 0: base 8); NULL if it is none or far too large."""
    hexadecimal, octal = part.rlike("^0x[0-9a-f]*$"), part.rlike("^0[0-7]+$")
    digits = F.regexp_replace(F.when(hexadecimal, F.substring(part, 3, 1000)).otherwise(part), "^0+", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    number = (
        F.when(hexadecimal, F.conv(digits, 16, 10)).when(octal, F.conv(digits, 8, 10)).when(part.rlike("^(?:0|[1-9][0-9]*)$"), digits)
    )
    return F.when(F.length(digits) <= 11, number).cast("long")


def ipv4(host: Column) -> Column:
    """Dotted decimal for one to four numbers, of which the last fills the bytes that are left; NULL if they are none."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    numbers = F.transform(parts, _ipv4_number)
    n = F.size(parts)
    last = F.element_at(numbers, -1)
    head = F.slice(numbers, F.lit(1), F.greatest(n - 1, F.lit(0)))
    room = F.pow(F.lit(256.0), 5 - n).cast("long")
    sound = (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < room)
    whole = last + F.aggregate(
        F.transform(head, lambda x, i: x * F.pow(F.lit(256.0), 3 - i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    octets = F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda by: F.call_function("shiftright", whole, by).bitwiseAND(F.lit(255)))
    return F.when(sound, F.array_join(octets, "."))


def _threshold(k: Column, bias: Column) -> Column:
    return F.least(F.greatest(k - bias, F.lit(1).cast("long")), F.lit(26).cast("long"))


def _variable_length(delta: Column, bias: Column) -> Column:
    """A number as base-36 digits of falling weight, the last of which is below its threshold."""
    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    positions = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda n: (n * 36).cast("long"))

    def step(state: Column, k: Column) -> Column:
        q, t = state["q"], _threshold(k, bias)
        ends = q < t
        digit = F.when(ends, q).otherwise(t + (q - t) % (36 - t)).cast("int")
        out = F.concat(state["out"], F.substring(F.lit(_DIGITS), digit + 1, F.lit(1)))
        return F.struct(
            F.when(state["done"] | ends, q).otherwise(F.floor((q - t) / (36 - t)).cast("long")).alias("q"),
            F.when(state["done"], state["out"]).otherwise(out).alias("out"), (state["done"] | ends).alias("done"),
        )

    return F.aggregate(positions, start, step, lambda state: state["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias for the next number, after one that was ``delta``."""
    halved = F.floor(delta / F.when(first, 700).otherwise(2)).cast("long")
    begun = F.struct((halved + F.floor(halved / points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    large = lambda s: s["d"] > 455

    def scale(s: Column, _: Column) -> Column:
        return F.struct(
            F.when(large(s), F.floor(s["d"] / 35)).otherwise(s["d"]).cast("long").alias("d"),
            F.when(large(s), s["k"] + 36).otherwise(s["k"]).alias("k"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), begun, scale, lambda s: (s["k"] + F.floor(36 * s["d"] / (s["d"] + 38))).cast("long")
    )


def punycode(label: Column) -> Column:
    """A label with letters beyond ASCII by ASCII letters and digits, as RFC 3492 has it, without the prefix."""
    points = F.transform(F.array_remove(F.split(label, ""), ""), lambda c: F.ascii(c).cast("long"))
    basic = F.array_join(F.transform(F.filter(points, lambda c: c < 128), lambda c: F.call_function("char", c)), "")
    beyond = F.sort_array(F.array_distinct(F.filter(points, lambda c: c >= 128)))
    n_basic = F.size(F.filter(points, lambda c: c < 128)).cast("long")
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        long(128).alias("n"), long(0).alias("delta"), long(72).alias("bias"), n_basic.alias("handled"),
        F.when(n_basic > 0, F.concat(basic, F.lit("-"))).otherwise("").alias("out"),
    )

    def one(state: Column, point: Column, c: Column) -> Column:
        here = c == point
        delta = F.when(c < point, state["delta"] + 1).otherwise(state["delta"])
        return F.struct(
            state["n"].alias("n"), F.when(here, 0).otherwise(delta).cast("long").alias("delta"),
            F.when(here, _adapted(delta, state["handled"] + 1, state["handled"] == n_basic)).otherwise(state["bias"]).alias("bias"),
            F.when(here, state["handled"] + 1).otherwise(state["handled"]).alias("handled"),
            F.when(here, F.concat(state["out"], _variable_length(delta, state["bias"]))).otherwise(state["out"]).alias("out"),
        )

    def all_of(state: Column, point: Column) -> Column:
        delta = state["delta"] + (point - state["n"]) * (state["handled"] + 1)
        begun = F.struct(point.alias("n"), delta.alias("delta"), state["bias"].alias("bias"), state["handled"].alias("handled"), state["out"].alias("out"))
        return F.aggregate(points, begun, lambda s, c: one(s, point, c), lambda s: F.struct(
            (point + 1).alias("n"), (s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["handled"].alias("handled"), s["out"].alias("out")
        ))

    return F.aggregate(beyond, start, all_of, lambda state: state["out"])


def _web_host(written: Column) -> Column:
    """The host that a web URL's text stands for; NULL if a browser would refuse it."""
    # A plus sign is one; only percent signs are decoded.
    decoded = F.when(written.contains("%"), F.try_url_decode(F.replace(written, F.lit("+"), F.lit("%2B")))).otherwise(written)
    dotted = F.regexp_replace(F.lower(decoded), _DOTS, ".")
    ascii_labels = F.transform(
        F.split(dotted, r"\."), lambda label: F.when(F.octet_length(label) == F.length(label), label).otherwise(F.concat(F.lit("xn--"), punycode(label)))
    )
    named = F.array_join(ascii_labels, ".")
    last = F.regexp_extract(dotted, r"([^.]*)\.?$", 1)
    return F.when((dotted == "") | dotted.rlike(_FORBIDDEN), None).when(last.rlike(_NUMBER), ipv4(dotted)).otherwise(named)


def browser_host(url: Column) -> Column:
    """Host name of a URL, NULL for text that is not a URL with a host."""
    text = _one_line(url)
    written = F.regexp_extract(text, _WEB, 1)
    return (
        F.when(written == "", F.nullif(F.lower(F.regexp_extract(text, _OTHER, 1)), F.lit("")))
        .when(written.rlike(_PLAIN), F.lower(written))
        .otherwise(_web_host(written))
    )
