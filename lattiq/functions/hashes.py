"""Stable hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a of 64 bits: offset basis and prime 2**40 + 0x1b3 (fixed values).
BASIS, PRIME_LOW = 0xCBF29CE484222325, 0x1B3
MASK = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes as 16 lower-case hex digits.

    The state is two halves of 32 bits, so no product leaves the range of a long
    and the expression works under ANSI arithmetic.
    """
    # the text is an argument of the array and not of its lambdas, and both halves are read in one end, so it is computed once
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    codes = F.transform(F.coalesce(pairs, F.array().cast("array<string>")), lambda x: F.conv(x, 16, 10).cast("long"))
    state = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & MASK).cast("long").alias("lo"))

    def step(s: Column, byte: Column) -> Column:
        low = s["lo"].bitwiseXOR(byte)
        product = low * F.lit(PRIME_LOW)
        high = s["hi"] * F.lit(PRIME_LOW) + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), product.bitwiseAND(F.lit(MASK)).alias("lo"))

    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(codes, state, step, lambda s: F.concat(half(s["hi"]), half(s["lo"])))


def fnv1a_text(text: str) -> str:
    """The same for one text on the driver."""
    h = BASIS
    for b in text.encode():
        h = (h ^ b) * ((1 << 40) + PRIME_LOW) % (1 << 64)
    return f"{h:016x}"


def identity(rule: Column, path: Column, target: Column, file: Column) -> Column:
    """Canonical text of a diagnostic: rule, source and target (or the file where there is no source)."""
    source = F.coalesce(F.get(path, F.lit(0)), file)
    to = F.coalesce(target, F.get(path, F.lit(1)))
    part = lambda name, x: F.coalesce(F.concat(F.lit(f"|{name}="), F.translate(x, "\\", "/")), F.lit(""))
    return F.concat(rule, part("source", source), part("target", to))


def legacy_identities(rule: Column, path: Column, file: Column, metadata: Column) -> Column:
    """The two texts that older fingerprints were made of, with and without related rules."""
    head = F.concat(rule, F.when(F.size(path) == 0, F.coalesce(F.concat(F.lit("|"), F.translate(file, "\\", "/")), F.lit(""))).otherwise(F.array_join(F.transform(path, lambda p: F.concat(F.lit("|"), F.translate(p, "\\", "/"))), "")))
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), e["value"])), "")
    return F.array(F.concat(head, pairs(metadata)), F.concat(head, pairs(F.map_filter(metadata, lambda k, _: k != "related_rules"))))
