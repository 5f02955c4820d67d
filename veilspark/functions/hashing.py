"""Keyed hashes and tokens as Spark SQL expressions.

HMAC-SHA256 with a known key is two nested ``sha2`` calls once the padded key
blocks are prepared on the driver.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

HASH_PREFIX = "sha256-hmac:"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
_HEX_BITS = {f"{i:x}": f"{i:04b}" for i in range(16)}


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer key blocks of HMAC-SHA256."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_hex(inner: Column, outer: Column, value: Column) -> Column:
    digest = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def value_hash(rule_id: str, value: Column) -> Column:
    """Hash used in reports and allowlists: keyed by the rule id."""
    inner, outer = hmac_pads(rule_id.encode())
    return F.concat(F.lit(HASH_PREFIX), hmac_hex(F.lit(inner), F.lit(outer), value))


def value_hash_py(rule_id: str, value: str) -> str:
    return HASH_PREFIX + _hmac.new(rule_id.encode(), value.encode(), hashlib.sha256).hexdigest()


def check_token_bits(bits: int) -> None:
    if bits % 8 or not 64 <= bits <= 128:
        raise ValueError("token_bits must be a multiple of 8 between 64 and 128")


def base32_of_hex(hex_text: Column, bits: int) -> Column:
    """Lower-case base32 without padding of the first ``bits`` bits of a hex string.

    Ten hex digits are forty bits, which are eight base32 digits, so ``conv``
    never sees more than a long holds.
    """
    out = []
    for at in range(0, bits // 4, 10):
        digits = min(10, bits // 4 - at)
        chars = -(-digits * 4 // 5)
        part = F.rpad(F.substring(hex_text, at + 1, digits), 10, "0")
        packed = F.lpad(F.conv(part, 16, 32), 8, "0")
        out.append(F.substring(packed, 1, chars))
    numerals = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    return F.translate(F.concat(*out), numerals, BASE32)


@dataclass(frozen=True)
class KeyMaterial:
    """Master key and salt of one project; token keys are derived per kind.

    ``info_prefix`` is the context string put before the kind when a key is
    derived. Set it to the string an existing deployment used to keep its
    tokens.
    """

    master: bytes
    salt: bytes
    info_prefix: str = "pseudonymize/v1/"

    def __post_init__(self) -> None:
        if len(self.master) != 32 or len(self.salt) != 32:
            raise ValueError("master and salt must be 32 bytes each")

    def __repr__(self) -> str:
        return f"KeyMaterial(fingerprint={self.fingerprint()})"

    @classmethod
    def parse(cls, stored: str, **kwargs) -> KeyMaterial:
        """Read the ``v1:<master hex>:<salt hex>`` form."""
        parts = stored.split(":")
        if len(parts) != 3 or parts[0] != "v1":
            raise ValueError("unrecognized key material format")
        try:
            return cls(bytes.fromhex(parts[1]), bytes.fromhex(parts[2]), **kwargs)
        except ValueError as err:
            raise ValueError("invalid hex key material") from err

    def kind_key(self, kind: str) -> bytes:
        """HKDF-SHA256, one output block, bound to the kind."""
        extracted = _hmac.new(self.salt, self.master, hashlib.sha256).digest()
        info = (self.info_prefix + kind).encode()
        return _hmac.new(extracted, info + b"\x01", hashlib.sha256).digest()

    def fingerprint(self) -> str:
        return hashlib.sha256(self.master + self.salt).hexdigest()[:16]


def fingerprint(stored: Column) -> Column:
    """Fingerprint of key material in its stored form; null for any other text."""
    shape = r"\Av1:([0-9A-Fa-f]{64}):([0-9A-Fa-f]{64})\z"
    both = F.unhex(F.concat(F.regexp_extract(stored, shape, 1), F.regexp_extract(stored, shape, 2)))
    return F.when(stored.rlike(shape), F.left(F.sha2(both, 256), F.lit(16)))


def token_prefix(kind: str) -> str:
    return kind.split(":", 1)[1] if kind.startswith("custom:") else kind


def token(material: KeyMaterial, kind: str, normalized: Column, bits: int = 64) -> Column:
    """Deterministic token of a normalized value."""
    check_token_bits(bits)
    inner, outer = hmac_pads(material.kind_key(kind))
    digest = hmac_hex(F.lit(inner), F.lit(outer), normalized)
    # bound once: the base32 form reads the digest several times
    return F.concat(F.lit(token_prefix(kind) + "_"), let(digest, lambda d: base32_of_hex(d, bits)))
