"""Hashes and byte functions as Spark expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 64-bit FNV offset basis and prime.
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211
SHARDS = 128


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as DECIMAL(20,0): the product is reduced in decimals, as a BIGINT would overflow.

    The prime is 2^40 + 435, so h * prime mod 2^64 is (h mod 2^24) * 2^40 + h * 435, reduced: all parts fit.
    """
    big = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    low = F.lit(1 << 24).cast("decimal(20,0)")
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.greatest((F.length(digits) / 2).cast("int"), F.lit(1))), lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        tail = (h % 256).cast("int")
        x = (h - tail + tail.bitwiseXOR(b)).cast("decimal(20,0)")
        wide = (x % low).cast("decimal(8,0)") * F.lit(1 << 40).cast("decimal(13,0)") + x * F.lit(435).cast("decimal(3,0)")
        return (wide % big).cast("decimal(20,0)")

    return F.when(F.length(digits) > 0, F.aggregate(octets, F.lit(Decimal(FNV_BASIS)).cast("decimal(20,0)"), step)).when(text.isNotNull(), F.lit(Decimal(FNV_BASIS)).cast("decimal(20,0)"))


def shard_id(key: Column, shards: int = SHARDS) -> Column:
    """fnv1a64(key) modulo the number of shards."""
    return (fnv1a64(key) % shards).cast("int")


def be_u32(data: Column, at: int) -> Column:
    """The unsigned big-endian 32-bit number at byte `at` (from 0), as BIGINT."""
    return F.conv(F.hex(F.substring(data, at + 1, 4)), 16, 10).cast("long")


def be_u64(data: Column, at: int) -> Column:
    """The unsigned big-endian 64-bit number at byte `at` (from 0), as DECIMAL(20,0)."""
    return F.conv(F.hex(F.substring(data, at + 1, 8)), 16, 10).cast("decimal(20,0)")


def run_name(gen: Column, seq: Column) -> Column:
    return F.format_string("sst-%d-%d.sst", gen, seq)


def log_name(seq: Column) -> Column:
    return F.format_string("wal-%d.log", seq)


def parse_run_name(name: Column) -> Column:
    """struct(gen, seq) of a run's file name; null for other names."""
    part = lambda i: F.regexp_extract(name, r"^sst-(\d+)-(\d+)\.sst$", i)
    return F.when(part(1) != "", F.struct(F.try_to_number(part(1), F.lit("9999999999")).cast("int").alias("gen"), F.try_to_number(part(2), F.lit("9999999999999999999")).cast("long").alias("seq")))


def tokens(line: Column) -> Column:
    """The words of a line, split at white space."""
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def quoted(text: Column) -> Column:
    """Text in double quotes, with backslash escapes for quotes, backslashes, tabs and line ends."""
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return F.concat(F.lit('"'), text, F.lit('"'))


def be_bytes(n: Column, width: int = 8) -> Column:
    """The last `width` bytes of a BIGINT, most significant first."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * width)))


def uvarint(n: Column) -> Column:
    """A BIGINT of 0 or more as a base-128 number, low group first, each but the last with its top bit set."""
    n = n.cast("long")
    last = F.floor((F.greatest(F.length(F.bin(n)), F.lit(1)) - 1) / 7).cast("int")
    bits = F.lpad(F.bin(n), 70, "0")
    seven = lambda i: F.conv(F.substr(bits, 64 - 7 * i, F.lit(7)), 2, 10).cast("int")
    group = lambda i: F.lpad(F.hex(seven(i) + F.when(i < last, 128).otherwise(0)), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), group), ""))
