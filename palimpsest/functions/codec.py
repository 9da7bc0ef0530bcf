"""Byte codecs as column expressions: internal keys, hashes, Bloom positions, log and wire frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
GET_REQUEST, PUT_REQUEST, DELETE_REQUEST = 1, 2, 3
MASK32 = 4294967295
BLOOM_BITS, BLOOM_HASHES, GOLDEN = 4096 * 8, 3, 0x9E3779B9
ENTRY_OVERHEAD, KEY_SUFFIX = 130, 9
MAX_PAYLOAD = 10 * 1024 * 1024


def big_endian(value: Column, n_bytes: int) -> Column:
    """The last ``n_bytes`` bytes of a number, most significant first."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n_bytes)))


def little_endian(value: Column, n_bytes: int) -> Column:
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n_bytes))
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n_bytes)))))


def number(raw: Column) -> Column:
    """A big-endian unsigned number below 2**63."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def reversed_bytes(raw: Column, n_bytes: int) -> Column:
    return F.concat(*(F.substring(raw, i, 1) for i in range(n_bytes, 0, -1)))


def encode_key(key: Column, seq: Column, op: Column) -> Column:
    return F.concat(key.cast("binary"), big_endian(seq, 8), big_endian(op, 1))


def parse_key(raw: Column) -> Column:
    """struct(key, seq, op); null where there are fewer bytes than the suffix has."""
    n = F.octet_length(raw)
    cut = F.struct(
        F.substring(raw, F.lit(1), n - KEY_SUFFIX).alias("key"),
        number(F.substring(raw, n - KEY_SUFFIX + 1, F.lit(8))).alias("seq"),
        number(F.substring(raw, n, F.lit(1))).cast("int").alias("op"),
    )
    return F.when(n >= KEY_SUFFIX, cut)


def internal_order(key: str = "key", seq: str = "seq", op: str = "op") -> list[Column]:
    """Keys ascending, of a key the newest first, and a put before a delete of the same number."""
    return [F.col(key).asc(), F.col(seq).desc(), F.col(op).desc()]


def bytes_of(value: Column) -> Column:
    """The bytes of a text or binary value as numbers."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: number(F.substring(raw, i, F.lit(1)))))


def fnv1a(value: Column) -> Column:
    return F.aggregate(bytes_of(value), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(MASK32)))


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("binary"))


def bloom_positions(value: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    h = fnv1a(value)
    return F.array(*(((h + i * GOLDEN).bitwiseAND(F.lit(MASK32))) % bits for i in range(hashes)))


def entry_size(key: Column, value: Column, op: Column) -> Column:
    """Bytes that an entry counts for in memory; a delete has no value."""
    payload = F.when(op == PUT, F.coalesce(F.octet_length(value.cast("binary")), F.lit(0))).otherwise(0)
    return (F.octet_length(key.cast("binary")) + payload + KEY_SUFFIX + ENTRY_OVERHEAD).cast("long")


def record(key: Column, value: Column) -> Column:
    """Length and bytes of an internal key and of a value."""
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.expr("X''"))
    return F.concat(little_endian(F.octet_length(key), 4), key, little_endian(F.octet_length(value), 4), value)


def log_frame(key: Column, value: Column) -> Column:
    """A record after its checksum."""
    payload = record(key, value)
    return F.concat(little_endian(F.crc32(payload), 4), payload)


def encode_request(op: Column, key: Column, value: Column) -> Column:
    """Null for keys too long for their 16-bit length, and for payloads above the cap."""
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.expr("X''"))
    n = F.octet_length(key) + F.octet_length(value) + 2
    return F.when((F.octet_length(key) <= 65533) & (n <= MAX_PAYLOAD), F.concat(big_endian(n, 4), big_endian(op, 1), big_endian(F.octet_length(key), 2), key, value))


def decode_request(raw: Column) -> Column:
    """struct(status, op, key, value); status is ok, short, too_large or bad_key_length, and the rest null unless ok."""
    n, key_n = number(F.substring(raw, 1, 4)), number(F.substring(raw, 6, 2))
    status = (
        F.when(F.octet_length(raw) < 7, "short")
        .when(n > MAX_PAYLOAD, "too_large")
        .when((n < 2) | (F.octet_length(raw) < n + 5), "short")
        .when(key_n + 2 > n, "bad_key_length")
        .otherwise("ok")
    )
    ok = status == "ok"
    return F.struct(
        status.alias("status"),
        F.when(ok, number(F.substring(raw, 5, 1)).cast("int")).alias("op"),
        F.when(ok, F.substring(raw, F.lit(8), key_n.cast("int"))).alias("key"),
        F.when(ok, F.substring(raw, (key_n + 8).cast("int"), (n - 2 - key_n).cast("int"))).alias("value"),
    )


def encode_response(status: Column, value: Column) -> Column:
    value = F.coalesce(value.cast("binary"), F.expr("X''"))
    return F.concat(big_endian(F.octet_length(value) + 1, 4), big_endian(status, 1), value)
