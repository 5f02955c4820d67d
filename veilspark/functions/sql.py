"""SQL functions ``luhn``, ``entropy``, ``value_hash`` and ``token``, defined in SQL, so that queries can use them.

They live in the session. ``token`` holds the pads of its keys in its definition, as an expression built by ``hashing``
does; whoever may describe functions of the session may read them, so register it where the key material may be.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .hashing import BASE32, HASH_PREFIX, KeyMaterial, check_token_bits, hmac_pads, token_prefix
from .validators import FULL_WIDTH_DIGITS

DIGITS = f"regexp_replace(translate(value, '{FULL_WIDTH_DIGITS}', '0123456789'), '[^0-9]', '')"
KINDS = ("email", "phone", "name")


def hmac_sql(inner: str, outer: str) -> str:
    return f"sha2(concat({outer}, unhex(sha2(concat({inner}, CAST(value AS BINARY)), 256))), 256)"


def padded(mask: int) -> str:
    """The key block of a rule id, each byte with the mask."""
    key = "CASE WHEN octet_length(rule_id) > 64 THEN unhex(sha2(rule_id, 256)) ELSE CAST(rule_id AS BINARY) END"
    block = f"rpad(hex({key}), 128, '0')"
    masked = f"lpad(hex(CAST(conv(substring({block}, i, 2), 16, 10) AS INT) ^ {mask}), 2, '0')"
    return f"unhex(array_join(transform(sequence(1, 127, 2), i -> {masked}), ''))"


def base32_sql(digest: str, bits: int) -> str:
    """The first bits of a hex digest; ten hex digits make eight of base 32."""
    parts = []
    for at in range(0, bits // 4, 10):
        digits = min(10, bits // 4 - at)
        packed = f"lpad(conv(rpad(substring({digest}, {at + 1}, {digits}), 10, '0'), 16, 32), 8, '0')"
        parts.append(f"substring({packed}, 1, {-(-digits * 4 // 5)})")
    return f"translate(concat({', '.join(parts)}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{BASE32}')"


def definitions(material: KeyMaterial | None = None, kinds: tuple[str, ...] = KINDS, bits: int = 64) -> dict[str, str]:
    """Statement of each function; ``token`` only where there is key material."""
    share = "(length(value) - length(replace(value, c, ''))) / CAST(length(value) AS DOUBLE)"
    out = {
        "luhn": f"(value STRING) RETURNS BOOLEAN RETURN length({DIGITS}) BETWEEN 13 AND 19 AND luhn_check({DIGITS})",
        "entropy": "(value STRING) RETURNS DOUBLE RETURN aggregate(array_distinct(filter(split(value, ''), c -> c != '')), 0.0D, "
                   f"(total, c) -> total - {share} * log2({share}))",
        "value_hash": f"(rule_id STRING, value STRING) RETURNS STRING RETURN concat('{HASH_PREFIX}', {hmac_sql(padded(0x36), padded(0x5C))})",
    }
    if material:
        check_token_bits(bits)
        pads = {kind: hmac_pads(material.kind_key(kind)) for kind in kinds}
        blocks = [" ".join(f"WHEN '{kind}' THEN X'{pads[kind][n].hex()}'" for kind in kinds) for n in (0, 1)]
        prefix = " ".join(f"WHEN '{kind}' THEN '{token_prefix(kind)}_'" for kind in kinds)
        digest = hmac_sql(*(f"CASE kind {b} END" for b in blocks))
        text = f"transform(array({digest}), d -> {base32_sql('d', bits)})[0]"
        out["token"] = f"(kind STRING, value STRING) RETURNS STRING RETURN concat(CASE kind {prefix} END, {text})"
    return {name: f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}" for name, body in out.items()}


def register(spark: SparkSession, material: KeyMaterial | None = None, kinds: tuple[str, ...] = KINDS, bits: int = 64) -> list[str]:
    """Define the functions in the session and return their names. Null values, and kinds that are not listed, give null."""
    made = definitions(material, kinds, bits)
    for statement in made.values():
        spark.sql(statement)
    return list(made)
