"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CIPHERS = ("aes", "blowfish", "serpent", "twofish")


def base_name(path: Column) -> Column:
    """What follows the last of ``:``, ``/`` and backslash."""
    return F.regexp_extract(path, r"[^:/\\]*$", 0)


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^.:/\\]*)$", 1)


def mask_pattern(mask: str) -> str:
    """A whole-name pattern of a mask with ``*`` and ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in mask) + "$"


def matches(name: Column, masks: list[str]) -> Column:
    out = F.lit(False)
    for m in masks:
        out = out | name.rlike(mask_pattern(m))
    return out


def parse_int(text: Column) -> Column:
    """Digits with an optional ``=`` before them; null for anything else."""
    return F.when(text.rlike(r"^=?[0-9]{1,18}$"), F.regexp_replace(text, "^=", "").cast("long"))


def parse_mem(text: Column) -> Column:
    """Octets: digits with b, k, m or g; ``^`` or no letter is a power of two; null for anything else."""
    digits = F.regexp_extract(text, r"^=?([0-9]{1,9})([bkmg^]?)", 1)
    unit = F.regexp_extract(text, r"^=?([0-9]{1,9})([bkmg^]?)", 2)
    n = F.when(digits != "", digits).cast("long")
    power = F.when(n < 63, F.pow(F.lit(2.0), n).cast("long"))
    return (
        F.when(unit == "b", n).when(unit == "k", n * 1024).when(unit == "m", n * 1048576).when(unit == "g", n * 1073741824)
        .when(text.rlike(r"^=?[0-9]{1,9}(\^|$)"), power)
    )


def show_mem(n: Column) -> Column:
    """The largest unit that divides exactly; 0 is ``0gb``."""
    out = F.concat(n.cast("string"), F.lit("b"))
    for size, unit in ((1024, "kb"), (1048576, "mb"), (1073741824, "gb")):
        out = F.when(n % size == 0, F.concat(F.floor(n / size).cast("string"), F.lit(unit))).otherwise(out)
    return out


def methods(chain: Column) -> Column:
    """A chain ``name:param:param+name`` as array<struct<name, params>>."""
    return F.transform(F.split(chain, r"\+"), lambda m: F.struct(F.split_part(m, F.lit(":"), F.lit(1)).alias("name"), F.filter(F.split(m, ":"), lambda x, i: i > 0).alias("params")))


def is_encrypted(chain: Column) -> Column:
    """Whether any method of the chain is a cipher."""
    return F.exists(F.split(chain, r"\+"), lambda m: m.rlike("^(" + "|".join(CIPHERS) + ")([-:]|$)"))


def encrypted_by_substring(chain: Column) -> Column:
    """The quick test, which misses a chain that starts with its cipher."""
    return chain.rlike(r"\+(" + "|".join(CIPHERS) + ")-")


def floored_mod(a: Column, b: Column) -> Column:
    return a - F.floor(a / b) * b


def chain_memory(chain: Column) -> Column:
    """The sum over a chain's methods of their first parameter as memory; methods without one take 0."""
    return F.aggregate(methods(chain), F.lit(0).cast("long"), lambda a, m: a + F.coalesce(parse_mem(F.get(m["params"], F.lit(0))), F.lit(0).cast("long")))


def method_memory(name: Column, m: Column, hash_bits: Column) -> tuple[Column, Column]:
    """Octets that a method with a dictionary or block of m takes to pack and to unpack; unknown ones take none."""
    table, none = F.pow(F.lit(2.0), hash_bits).cast("long"), F.lit(0).cast("long")
    lzp = 2 * m + 8 * table
    pack = F.when(name == "lzma", m * 9 + 1048576).when(name == "rep", m + 4 * table).when(name == "lzp", lzp).when(name == "ppmd", m).otherwise(none)
    return pack, F.when(name == "lzma", m + 1048576).when(name == "lzp", lzp).when(name.isin("rep", "ppmd"), m).otherwise(none)


def compress_memory(chain: Column) -> Column:
    """Octets to pack with a chain: nine dictionaries for ``lzma``, two blocks for ``lzp``, else as to unpack."""
    times = lambda m: F.when(m["name"] == "lzma", 9).when(m["name"] == "lzp", 2).otherwise(1)
    return F.aggregate(methods(chain), F.lit(0).cast("long"), lambda a, m: a + times(m) * F.coalesce(parse_mem(F.get(m["params"], F.lit(0))), F.lit(0).cast("long")))


def limit_memory(chain: Column, cap: int) -> Column:
    """The chain with no method's first parameter above ``cap`` octets; what is lower stays as written."""

    def one(m: Column) -> Column:
        first = F.get(m["params"], F.lit(0))
        mem = parse_mem(first)
        lower = F.when(mem > cap, show_mem(F.lit(cap).cast("long"))).otherwise(first)
        return F.concat_ws(":", m["name"], lower, F.array_join(F.slice(m["params"], 2, 100), ":"))

    return F.array_join(F.transform(methods(chain), lambda m: F.regexp_replace(one(m), ":+$", "")), "+")


def recovery_size(setting: Column, size: Column) -> Column:
    """Octets of recovery data: a percentage of the archive, rounded up, or an amount of memory."""
    percent = F.regexp_extract(setting, r"^([0-9]+(\.[0-9]+)?)%$", 1)
    return F.when(percent != "", F.ceil(size * percent.try_cast("decimal(9,3)") / 100).cast("long")).otherwise(parse_mem(setting))


def to_stream(method: Column, payload: Column) -> Column:
    """A self-describing stream: the method's name, a zero octet, the payload."""
    return F.concat(F.encode(method, "UTF-8"), F.lit(b"\0"), payload)


def stream_method(stream: Column) -> Column:
    return F.decode(F.unhex(F.regexp_extract(F.hex(stream), "^((?:..)*?)00", 1)), "UTF-8")


def stream_payload(stream: Column) -> Column:
    return F.unhex(F.regexp_replace(F.hex(stream), "^(?:..)*?00", ""))


def replace_nth(text: Column, what: str, by: str, n: int) -> Column:
    """The nth occurrence (from 1) replaced; text with fewer is as it was."""
    parts = F.split(text, "\\Q" + what + "\\E", -1)
    done = F.concat_ws(by, F.array_join(F.slice(parts, 1, n), what), F.array_join(F.slice(parts, n + 1, 1 << 30), what))
    return F.when(F.size(parts) > n, done).otherwise(text)


def starts(text: Column, prefix: str) -> Column:
    """Whatever the case."""
    return F.lower(text).startswith(prefix.lower())


def ends(text: Column, suffix: str) -> Column:
    return F.lower(text).endswith(suffix.lower())


def little_endian(data: Column, octets: int) -> Column:
    """The unsigned number in the first octets of a binary, low ones first; null where there are fewer."""
    h = F.hex(F.substring(data, 1, octets))
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(octets))])
    return F.when(F.length(h) == 2 * octets, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def round_up(n: Column, step: int) -> Column:
    return (F.ceil(n / F.lit(step)) * step).cast("long")


def log_floor(n: Column) -> Column:
    """The place of the highest one bit; null below 1."""
    return F.when(n > 0, F.length(F.bin(n)) - 1).cast("long")


def bounded_copy(data: Column, room: int) -> Column:
    """struct<data, code>: the data with code 0, or code -5 where they exceed the room."""
    fits = F.octet_length(data) <= room
    return F.struct(F.when(fits, data).alias("data"), F.when(fits, 0).otherwise(-5).cast("long").alias("code"))


def signature_at(data: Column, signature: str, window: int) -> Column:
    """Where a signature stands in the first characters of a text, from 0; null if it does not."""
    at = F.instr(F.left(data, F.lit(window)), signature)
    return F.when(at > 0, (at - 1).cast("long"))


def recovery_setting(share: Column) -> Column:
    """Small shares of recovery data are so many sectors: a tenth of a percent of 4 kB, a hundredth of 64 kB."""
    return F.when(share == "0.1%", "0*4kb").when(share == "0.01%", "0*64kb").otherwise(share)


def hmac(text: Column, key: bytes, bits: int) -> Column:
    """HMAC with SHA-256 or SHA-512, in hex."""
    import hashlib

    block = 64 if bits == 256 else 128
    key = (hashlib.new(f"sha{bits}", key).digest() if len(key) > block else key).ljust(block, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(k ^ 0x36 for k in key)), text.cast("binary")), bits)
    return F.sha2(F.concat(F.lit(bytes(k ^ 0x5C for k in key)), F.unhex(inner)), bits)


def normal_path(path: Column) -> Column:
    """One kind of separator, none twice and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), "(?<=.)/$", "")


# fixed values: octets of the ciphers' keys without a number of their own, and of their blocks
KEY_OCTETS = {"aes": 32, "blowfish": 56, "serpent": 32, "twofish": 32}
BLOCK_OCTETS = {"aes": 16, "blowfish": 8, "serpent": 16, "twofish": 16}
ITERATIONS = 1000


def service(method: Column, what: str) -> Column:
    """What a method answers to ``encryption?``, ``keySize``, ``ivSize``, ``numIterations`` or ``VeryFast?``; 0 where it has no answer."""
    name = F.regexp_extract(method, "^([a-z]+)", 1)
    cipher = name.isin(*CIPHERS)

    def by(values: dict[str, int]) -> Column:
        return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in values.items()])

    bits, rounds = F.regexp_extract(method, "^[a-z]+-([0-9]{1,4})", 1), F.regexp_extract(method, ":n([0-9]{1,9})", 1)
    answers = {
        "encryption?": cipher.cast("int"),
        "keySize": F.when(bits != "", F.floor(F.when(bits != "", bits).cast("int") / 8)).otherwise(by(KEY_OCTETS)),
        "ivSize": by(BLOCK_OCTETS),
        "numIterations": F.when(rounds != "", F.when(rounds != "", rounds).cast("long")).otherwise(F.when(cipher, ITERATIONS)),
        "VeryFast?": (name.isin("storing", "lzp", "rep", "delta") | method.rlike("^tor:[1-4]($|:)")).cast("int"),
    }
    if what not in answers:
        raise ValueError(f"no service {what}")
    only = {"keySize", "ivSize", "numIterations"}
    return F.coalesce(F.when(cipher, answers[what]) if what in only else answers[what], F.lit(0)).cast("long")
