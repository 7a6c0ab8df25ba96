"""Web addresses in the form browsers write them, by column functions alone.

`parse` follows the URL Standard for absolute http and https addresses: controls and blanks around the text and tabs and line
ends inside it go, backslashes are slashes, the scheme and host become lower case, hosts are percent-decoded, non-ASCII ones
written in Punycode, numbers in any of the IPv4 notations become four bytes and IPv6 addresses their shortest form, a default
port goes, dot segments are resolved, and what may not stand in a path, query or fragment is percent-encoded in UTF-8.

Known difference: hosts in other scripts become lower case, and their full-width letters and stops plain ones, but no other
compatibility or composed form is mapped before Punycode. Other schemes, which the archive never shows, give NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Printable ASCII that is percent-encoded all the same. Fixed values of the URL Standard.
IN_PATH = "\"#<>?^`{}"
IN_QUERY = "\"#<>'"
IN_FRAGMENT = "\"<>`"
#: What a host may not hold once it is decoded, besides controls. A fixed value of the URL Standard.
NOT_IN_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"

#: Addresses that are in normal form as they stand: plain host, and no dot segment, escape or port.
_PLAIN = r"^https?://(?:[a-z0-9_-]+\.)*[a-z_][a-z0-9_-]*/[A-Za-z0-9._~!$&()*+,;=:@/-]*(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?$"

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTHORITY = r"(?s)^(?:(.*)@)?(\[[^\[\]]*\]|[^:\[\]@]*)(:[0-9]*)?$"
_DOT = r"(?i)^(?:[.]|%2e)$"
_DOTS = r"(?i)^(?:[.]|%2e){2}$"
_NUMBER = r"(?i)^(?:[0-9]+|0x[0-9a-f]*)$"
DEFAULT_PORTS = {"http": 80, "https": 443}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def percent_encoded(text: Column, also: str) -> Column:
    """`text` with all but printable ASCII, and the signs in `also`, as percent-encoded UTF-8; escapes stay as they are."""
    kept = "".join(rf"\x{code:02x}" for code in range(0x21, 0x7F) if chr(code) not in also)
    runs = F.regexp_extract_all(text, F.lit(f"[{kept}]+|[^{kept}]+"), F.lit(0))
    written = F.transform(runs, lambda run: F.when(run.rlike(f"^[{kept}]"), run).otherwise(F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))))
    return F.when(text.rlike(f"[^{kept}]"), F.array_join(written, "")).otherwise(text)


def _resolved(path: Column) -> Column:
    """A path without dot segments; it begins with a slash."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "^/", ""), "/", -1)
    numbered = lambda all_parts: F.transform(all_parts, lambda part, i: F.struct(part.alias("part"), (i == F.size(all_parts) - 1).alias("last")))
    none = F.array().cast("array<string>")

    def step(done: Column, at: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        kept = F.when(at["part"].rlike(_DOTS), up).when(at["part"].rlike(_DOT), done)
        return F.when(kept.isNull(), F.concat(done, F.array(at["part"]))).when(at["last"], F.concat(kept, F.array(F.lit("")))).otherwise(kept)

    return F.concat(F.lit("/"), F.array_join(let(parts, lambda p: F.aggregate(numbered(p), none, step)), "/"))


def _number(text: Column) -> Column:
    """A part of an IPv4 address: decimal, octal behind 0, hexadecimal behind 0x; NULL if it is none or beyond 32 bits."""
    lower = F.lower(text)
    digits = F.when(lower.rlike("^0x"), F.regexp_replace(lower, "^0x0*", "")).when(lower.rlike("^0"), F.regexp_replace(lower, "^0+", "")).otherwise(lower)
    base = F.when(lower.rlike("^0x"), 16).when(lower.rlike("^0[0-9]"), 8).otherwise(10)

    def value(d: Column) -> Column:
        octal = lower.rlike("^0[0-9]")
        fine = lower.rlike("^0x[0-9a-f]*$") | (octal & d.rlike("^[0-7]*$")) | (~octal & lower.rlike("^[0-9]+$"))
        short = F.length(d) <= 11
        whole = F.when(base == 16, F.conv(d, 16, 10)).when(base == 8, F.conv(d, 8, 10)).otherwise(F.conv(d, 10, 10))
        return F.when(fine & short, F.when(d == "", F.lit(0)).otherwise(whole.cast("bigint")))

    return let(digits, value)


def _ipv4(host: Column) -> Column:
    """Dotted bytes of a host that ends in a number; NULL if it is no address."""
    parts = let(F.split(host, "[.]", -1), lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), F.slice(p, 1, F.size(p) - 1)).otherwise(p))

    def written(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        ahead = F.slice(numbers, 1, n - 1)
        room = F.element_at(F.array(*[F.lit(256 ** (5 - k)) for k in range(1, 5)]), n)
        fine = (n <= 4) & ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(ahead, lambda x: x > 255)
        power = F.array(*[F.lit(256 ** (3 - k)).cast("bigint") for k in range(4)])
        total = F.aggregate(F.transform(ahead, lambda x, i: x * power[i]), last, lambda a, x: a + x)
        dotted = let(total, lambda t: F.array_join(F.transform(power, lambda p: ((t / p).cast("bigint") % 256).cast("string")), "."))
        return F.when((n <= 4) & fine, F.when(last < room, dotted))

    return let(parts, lambda p: F.when(F.size(p) <= 4, let(F.transform(p, _number), written)))


def _ipv6(host: Column) -> Column:
    """A bracketed address in its shortest form; NULL if it is none."""
    inner = F.lower(F.substring(host, 2, 64))
    inner = F.regexp_replace(inner, r"\]$", "")
    # Four bytes at the end are two groups.
    quad = F.regexp_extract(inner, r"^(.*:)((?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.](?!$)|$)){4})$", 2)
    byte = lambda i: F.lpad(F.lower(F.hex(F.split(quad, "[.]")[i].cast("int"))), 2, "0")
    whole = F.when(quad != "", F.concat(F.regexp_extract(inner, r"^(.*:)[0-9.]+$", 1), byte(0), byte(1), F.lit(":"), byte(2), byte(3))).otherwise(inner)

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def filled(text: Column) -> Column:
        sides = F.split(text, "::", -1)
        left, right = groups(sides[0]), groups(F.element_at(sides, -1))
        gap = 8 - F.size(left) - F.size(right)
        padded = F.when((F.size(sides) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), gap), right)).when((F.size(sides) == 1) & (F.size(left) == 8), left)
        return F.when(~text.rlike(":::"), padded)

    def shortest(all_groups: Column) -> Column:
        fine = ~F.exists(all_groups, lambda g: ~g.rlike("^[0-9a-f]{1,4}$"))
        plain = F.transform(all_groups, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
        line = F.array_join(plain, ":")
        out = line
        for k in range(2, 9):  # the longest run of zeros, the first of equals, is left out
            run = ":".join(["0"] * k)
            out = F.when(line.rlike(f"(?:^|:){run}(?::|$)"), F.regexp_replace(line, f"^(.*?)(?:^|:)?\\b{run}(?::|$)", "$1::")).otherwise(out)
        return F.when(fine, F.concat(F.lit("["), F.regexp_replace(out, ":::+", "::"), F.lit("]")))

    return let(let(whole, filled), lambda g: F.when(g.isNotNull(), shortest(g)))


#: Full-width ASCII and the ideographic stops, by the rule of their code points, and what hosts write for them.
_WIDE = "".join(chr(code) for code in range(0xFF01, 0xFF5F)) + "\u3002\uff61"
_NARROW = "".join(chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)) + ".."

#: Fixed values of Punycode (RFC 3492).
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _punycode(label: Column) -> Column:
    """A host label in ASCII: itself, or its Punycode behind xn--."""

    def variable(delta: Column, bias: Column) -> Column:
        """`delta` as a number of variable length."""

        def digit(state: Column, k: Column) -> Column:
            t = F.greatest(F.lit(_T_MIN), F.least(F.lit(_T_MAX), k * _BASE - bias))
            rest = state["rest"] - t
            more = F.struct(
                F.floor(rest / (_BASE - t)).cast("bigint").alias("rest"), F.concat(state["out"], F.substring(F.lit(_DIGITS), (t + rest % (_BASE - t) + 1).cast("int"), 1)).alias("out"),
                F.lit(True).alias("open"),
            )
            last = F.struct(state["rest"].alias("rest"), F.concat(state["out"], F.substring(F.lit(_DIGITS), (state["rest"] + 1).cast("int"), 1)).alias("out"), F.lit(False).alias("open"))
            return F.when(state["open"], F.when(state["rest"] >= t, more).otherwise(last)).otherwise(state)

        start = F.struct(delta.cast("bigint").alias("rest"), F.lit("").alias("out"), F.lit(True).alias("open"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, digit, lambda state: state["out"])

    def adapted(delta: Column, points: Column, first: Column) -> Column:
        damped = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))

        def shrink(state: Column, _: Column) -> Column:
            over = state["delta"] > (_BASE - _T_MIN) * _T_MAX // 2
            return F.struct(
                F.when(over, F.floor(state["delta"] / (_BASE - _T_MIN)).cast("bigint")).otherwise(state["delta"]).alias("delta"),
                F.when(over, state["k"] + _BASE).otherwise(state["k"]).alias("k"),
            )

        start = lambda d: F.struct((d + F.floor(d / points)).cast("bigint").alias("delta"), F.lit(0).alias("k"))
        end = lambda s: (s["k"] + F.floor((_BASE - _T_MIN + 1) * s["delta"] / (s["delta"] + _SKEW))).cast("bigint")
        return let(damped, lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(8)), start(d), shrink, end))

    def encoded(points: Column) -> Column:
        basic = F.filter(points, lambda c: c < _FIRST)
        above = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= _FIRST)))
        ahead = F.concat(F.array_join(F.transform(basic, lambda c: F.chr(c)), ""), F.when(F.size(basic) > 0, F.lit("-")).otherwise(F.lit("")))
        # Each code point in turn goes through the label from its start.
        steps = F.flatten(F.transform(above, lambda m: F.transform(points, lambda c, i: F.struct(m.alias("m"), c.alias("c"), (i == 0).alias("anew")))))
        start = F.struct(
            F.lit(_FIRST - 1).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("delta"), F.lit(_BIAS).cast("bigint").alias("bias"),
            F.size(basic).cast("bigint").alias("h"), ahead.alias("out"),
        )

        def step(state: Column, at: Column) -> Column:
            jump = F.when(at["anew"], (at["m"] - state["n"] - 1) * (state["h"] + 1) + 1).otherwise(0)
            delta = state["delta"] + jump + F.when(at["c"] < at["m"], 1).otherwise(0)
            kept = lambda d: F.struct(at["m"].alias("n"), d.alias("delta"), state["bias"].alias("bias"), state["h"].alias("h"), state["out"].alias("out"))
            put = lambda d: F.struct(
                at["m"].alias("n"), F.lit(0).cast("bigint").alias("delta"), adapted(d, state["h"] + 1, state["h"] == F.size(basic)).alias("bias"),
                (state["h"] + 1).alias("h"), F.concat(state["out"], variable(d, state["bias"])).alias("out"),
            )
            return let(delta.cast("bigint"), lambda d: F.when(at["c"] == at["m"], put(d)).otherwise(kept(d)))

        return F.concat(F.lit("xn--"), F.aggregate(steps, start, step, lambda state: state["out"]))

    points = F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("bigint"))
    return F.when(label.rlike("[^\\x00-\\x7F]"), let(points, encoded)).otherwise(label)


def _ascii(name: Column) -> Column:
    """A host name in lower case and ASCII."""
    plain_signs = F.lower(F.translate(name, _WIDE, _NARROW))
    return F.when(name.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(plain_signs, "[.]", -1), _punycode), ".")).otherwise(F.lower(name))


def _host(text: Column) -> Column:
    """A host as it is written in normal form; NULL if it is none."""
    decoded = F.when(text.contains("%"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)

    def named(name: Column) -> Column:
        def checked(host: Column) -> Column:
            labels = F.split(host, "[.]", -1)
            last = F.when((F.element_at(labels, -1) == "") & (F.size(labels) > 1), F.element_at(labels, -2)).otherwise(F.element_at(labels, -1))
            fine = (host != "") & ~host.rlike(NOT_IN_HOST)
            return F.when(fine, F.when(last.rlike(_NUMBER), _ipv4(host)).otherwise(host))

        return let(_ascii(name), checked)

    return F.when(text.startswith("["), _ipv6(text)).otherwise(let(decoded, named))


def parse(col: Column) -> Column:
    """struct(scheme, credentials, host, port, path, query, fragment) of an http or https address; NULL if it is none.

    host, path, query (with its question mark) and fragment (with its hash) are in normal form; port is NULL if it is the
    scheme's own; credentials tells whether a user or a password is given.
    """
    text = F.regexp_replace(F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def parts(t: Column) -> Column:
        found = [F.regexp_extract(t, _PARTS, i) for i in range(1, 6)]
        authority = found[1]
        names = [F.regexp_extract(authority, _AUTHORITY, i) for i in range(1, 4)]
        raw = F.struct(
            F.lower(found[0]).alias("scheme"), names[0].alias("user"), names[1].alias("host"), names[2].alias("port"), authority.rlike(_AUTHORITY).alias("fine"),
            found[2].alias("path"), found[3].alias("query"), found[4].alias("fragment"),
        )
        return let(raw, read)

    def read(raw: Column) -> Column:
        web = F.coalesce(raw["scheme"].isin(*DEFAULT_PORTS) & raw["fine"] & (raw["host"] != "") & (F.length(raw["port"]) <= 20), F.lit(False))
        # A colon is part of the user only if a password follows it.
        digits = F.regexp_replace(raw["port"], "^:0*(?=[0-9])|^:", "")
        port = F.when((digits != "") & (F.length(digits) <= 5), digits.cast("int"))
        own = F.element_at(F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair]), raw["scheme"])
        good_port = (digits == "") | F.coalesce(port <= 65535, F.lit(False))
        whole = F.struct(
            raw["scheme"].alias("scheme"), (~raw["user"].isin("", ":")).alias("credentials"), _host(raw["host"]).alias("host"),
            F.when(port != own, port).alias("port"), percent_encoded(_resolved(raw["path"]), IN_PATH).alias("path"),
            percent_encoded(raw["query"], IN_QUERY).alias("query"),
            F.when(raw["fragment"] != "", F.concat(F.lit("#"), percent_encoded(F.substring(raw["fragment"], 2, 1 << 30), IN_FRAGMENT))).otherwise("").alias("fragment"),
        )
        return F.when(web & good_port, whole)

    return let(let(text, parts), lambda p: F.when(p["host"].isNotNull(), p))


def written(parts: Column, host: Column | None = None, fragment: bool = True) -> Column:
    """The address that `parse` has taken apart, without its credentials; on another host, or without its fragment."""
    port = F.when(parts["port"].isNotNull(), F.concat(F.lit(":"), parts["port"].cast("string"))).otherwise("")
    pieces = [parts["scheme"], F.lit("://"), parts["host"] if host is None else host, port, parts["path"], parts["query"]]
    return F.concat(*pieces, *([parts["fragment"]] if fragment else []))


def plain(col: Column) -> Column:
    """Whether an address is seen at once to be in normal form, without credentials."""
    return col.rlike(_PLAIN) & ~col.contains("/.")
