"""The scripting language's library as column expressions: strings, arrays, numbers.

Strings count characters and not octets. A pattern is translated to a regular expression:
classes ``%a`` to ``%z`` and their complements, sets, the repetitions ``* + - ?``, anchors,
captures and ``%1`` to ``%9``; balanced matches ``%b`` and frontiers ``%f`` are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the language
CLASSES = {"a": "A-Za-z", "c": r"\x00-\x1F\x7F", "d": "0-9", "l": "a-z", "p": r"!-/:-@\[-`{-~", "s": r"\x20\x09-\x0D", "u": "A-Z", "w": "A-Za-z0-9", "x": "A-Fa-f0-9", "z": r"\x00"}


def pattern(p: str) -> str:
    """The regular expression of a pattern."""
    # item: whether what stands before is one character's pattern, which alone can be repeated
    out, i, inside, item = [], 0, False, False
    while i < len(p):
        c = p[i]
        if c == "%":
            i += 1
            if i == len(p) or p[i] in "bf":
                raise ValueError(f"not supported in a pattern: {p[i - 1 : i + 1]}")
            k = p[i]
            if k.isdigit():
                out.append("\\" + k)
            elif k.lower() not in CLASSES:
                out.append(re.escape(k))
            elif k.islower():
                out.append(CLASSES[k] if inside else f"[{CLASSES[k]}]")
            else:
                out.append(f"[^{CLASSES[k.lower()]}]")
            item = True
        elif inside:
            inside, item = c != "]", True
            out.append(c if c in "]-^" else re.escape(c))
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "*+?-" and item:
            out.append("*?" if c == "-" else c)
            item = False
        elif c in "()" or (c == "^" and i == 0) or (c == "$" and i == len(p) - 1):
            out.append(c)
            item = False
        else:
            out.append(c if c == "." else re.escape(c))
            item = True
        i += 1
    return "(?s)" + "".join(out)


def sub(s: Column, i: int, j: int = -1) -> Column:
    """Characters i to j; negative places count from the end."""
    n = F.length(s)
    first = F.greatest(F.lit(1), F.lit(i) if i >= 0 else n + 1 + i)
    last = F.least(n, F.lit(j) if j >= 0 else n + 1 + j)
    return F.substr(s, first, F.greatest(last - first + 1, F.lit(0)))


def byte(s: Column, i: int = 1) -> Column:
    c = sub(s, i, i)
    return F.when(c != "", F.ascii(c).cast("long"))


def char(*codes: int) -> Column:
    return F.concat(*[F.char(F.lit(c)) for c in codes])


def find(s: Column, p: str, plain: bool = False) -> Column:
    """Where a pattern first occurs; null if it does not."""
    at = F.instr(s, p) if plain else F.regexp_instr(s, F.lit(pattern(p)))
    return F.when(at > 0, at.cast("long"))


def match(s: Column, p: str) -> Column:
    """The first capture, or the whole match if there is none; null without a match."""
    r = pattern(p)
    return F.when(s.rlike(r), F.regexp_extract(s, r, int(re.compile(r).groups > 0)))


def gmatch(s: Column, p: str) -> Column:
    r = pattern(p)
    return F.regexp_extract_all(s, F.lit(r), F.lit(int(re.compile(r).groups > 0)))


def gsub(s: Column, p: str, by: str) -> Column:
    """All matches replaced; ``%0`` and ``%1`` to ``%9`` stand for the match and its captures."""
    by = by.replace("\\", "\\\\").replace("$", "\\$")
    by = re.sub(r"%(.)", lambda m: "$" + m[1] if m[1].isdigit() else m[1], by)
    return F.regexp_replace(s, pattern(p), by)


def modf(x: Column) -> Column:
    """struct<whole, rest>, both of x's sign."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
    return F.struct(whole.alias("whole"), (x - whole).alias("rest"))


def frexp(x: Column) -> Column:
    """struct<m, e>: x = m * 2^e with m in [0.5, 1); zeros for 0."""
    e = F.when(x == 0, 0).otherwise(F.floor(F.log2(F.abs(x))) + 1).cast("int")
    m = x / F.pow(F.lit(2.0), e)
    # the logarithm can round across a power of two
    fixed = F.when(F.abs(m) >= 1, F.struct((m / 2).alias("m"), (e + 1).alias("e"))).when((m != 0) & (F.abs(m) < 0.5), F.struct((m * 2).alias("m"), (e - 1).alias("e")))
    return fixed.otherwise(F.struct(m.alias("m"), e.alias("e")))


def ldexp(m: Column, e: Column) -> Column:
    return m * F.pow(F.lit(2.0), e)


def tonumber(s: Column, base: int = 10) -> Column:
    """A number, or null where the text is none; other bases than ten are whole."""
    t = F.trim(s)
    if base == 10:
        return F.when(F.lower(t).rlike(r"^0x[0-9a-f]{1,15}$"), F.conv(F.substr(t, F.lit(3)), 16, 10).cast("double")).when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), t.try_cast("double"))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    return F.when(F.lower(t).rlike(f"^[{digits}]{{1,11}}$"), F.conv(t, base, 10).cast("double"))


def insert(values: Column, at: int, value: Column) -> Column:
    return F.array_insert(values, at, value)


def remove(values: Column, at: int) -> Column:
    return F.filter(values, lambda x, i: i != at - 1)


def format_(spec: str, *values: Column) -> Column:
    """The language's format: d i u c x X o e E f g G s and q; widths and precisions are Java's."""
    return F.format_string(spec.replace("%i", "%d").replace("%u", "%d").replace("%q", '"%s"'), *values)


def concat(values: Column, sep: str = "", i: int = 1, j: int | None = None) -> Column:
    """The elements i to j of an array joined."""
    last = F.size(values) if j is None else F.lit(j)
    return F.array_join(F.slice(values, F.lit(i), F.greatest(last - i + 1, F.lit(0))), sep)


def getn(values: Column) -> Column:
    return F.size(values).cast("long")


def maxn(values: Column) -> Column:
    """The largest index with a value."""
    at = F.transform(values, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(at), F.lit(0)).cast("long")


def sort(values: Column, before=None) -> Column:
    """An array in order; before(a, b) tells whether a comes first."""
    if before is None:
        return F.array_sort(values)
    return F.array_sort(values, lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0))


def foreach(values: Column, f) -> Column:
    return F.transform(values, f)


def foreachi(values: Column, f) -> Column:
    """f(index from 1, value)."""
    return F.transform(values, lambda x, i: f(i + 1, x))


def fmod(a: Column, b: Column) -> Column:
    """The remainder with the sign of a."""
    return a - F.when(a / b < 0, F.ceil(a / b)).otherwise(F.floor(a / b)) * b


def select(n: int, *values: Column) -> Column:
    """The values from the nth on, as an array; a negative n counts from the end."""
    return F.array(*(values[n - 1 :] if n > 0 else values[n:]))


def difftime(later: Column, earlier: Column) -> Column:
    """Seconds between two times without a zone."""
    return F.timestamp_diff("SECOND", earlier, later).cast("double")


#: The numeric library by name; floor, mod and the like are above.
MATH = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "atan2": F.atan2, "ceil": F.ceil, "cos": F.cos, "cosh": F.cosh, "deg": F.degrees,
    "exp": F.exp, "floor": F.floor, "fmod": fmod, "frexp": frexp, "ldexp": ldexp, "log": F.ln, "log10": F.log10, "max": F.greatest, "min": F.least,
    "modf": modf, "pow": F.pow, "rad": F.radians, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}


def random(seed: Column, low: int = 0, high: int | None = None) -> Column:
    """A number of [0, 1), or a whole one from low to high, that the seed decides: a rerun gives the same."""
    u = F.pmod(F.xxhash64(F.lit("random"), seed), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return u if high is None else F.floor(F.lit(low) + u * (high - low + 1)).cast("long")
