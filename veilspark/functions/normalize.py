"""Canonical forms of values, so that equal people get equal tokens."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .validators import SPACE

# --- fixed values ------------------------------------------------------------
MISSING = ("", "NULL", "null", "N/A", "#N/A", "-", "—")
EMAIL_LOCAL = r"[A-Za-z0-9.!#$%&'*+\-/=?^_`{|}~]"
TEN_DIGITS = ("0120", "0170", "0180", "0570", "0990")
EMAIL_HEADERS = (
    "email e-mail e_mail mail mailaddress emailaddress email_address メール メールアドレス メアド"
).split()
PHONE_HEADERS = (
    "phone tel telephone mobile cellphone cell phonenumber phone_number tel_no 電話 電話番号 携帯 携帯電話 携帯番号"
).split()


NORMALIZER = "com.ibm.icu.text.Normalizer"


def nfkc(text: Column) -> Column:
    """Unicode normalization form KC, by the library that Spark's collations use; ASCII values are left as they are.

    It runs in the JVM, so it can stand in a lambda over an array as well.
    """
    wide = F.octet_length(text) != F.length(text)
    return F.when(wide, F.reflect(F.lit(NORMALIZER), F.lit("compose"), text, F.lit(True))).otherwise(text)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), r"\A | \z", "")


def normalize_common(text: Column) -> Column:
    """NFKC, white space collapsed and trimmed."""
    return collapse(nfkc(text))


def is_missing(common: Column) -> Column:
    return common.isin(*MISSING)


def normalize_email(value: Column, strip_subaddress: bool = False) -> Column:
    """Lower-case address, or null when it is not one."""
    lower = F.lower(value)
    local, domain = F.substring_index(lower, "@", 1), F.regexp_replace(lower, r"\A[^@]*@", "")
    label = r"(?!-)[a-z0-9-]{1,63}(?<!-)"
    ok = (
        F.contains(value, F.lit("@"))
        & local.rlike(rf"\A{EMAIL_LOCAL}{{1,64}}\z") & ~local.rlike(r"\A\.|\.\z|\.\.")
        & domain.rlike(rf"\A(?:{label}\.)+[a-z]{{2,63}}\z") & (F.octet_length(domain) <= 253)
    )
    kept = F.substring_index(local, "+", 1) if strip_subaddress else local
    return F.when(ok & (kept != ""), F.concat(kept, F.lit("@"), domain))


def _jp_domestic(digits: Column) -> Column:
    n = F.length(digits)
    zero = lambda k: F.substring(digits, k + 1, 20).rlike(r"\A0+\z")
    return digits.startswith("0") & (
        F.when(digits.rlike(rf"\A(?:{'|'.join(TEN_DIGITS)})"), (n == 10) & ~zero(4))
        .when(digits.startswith("0800"), (n == 11) & ~zero(4))
        .when(digits.startswith("0200"), (n == 14) & ~zero(4))
        .when(digits.startswith("0204"), (n == 11) & ~zero(4))
        .when(digits.startswith("020"), (n == 11) & ~zero(3))
        .otherwise(n.isin(10, 11) & ~zero(1))
    )


def normalize_phone(value: Column) -> Column:
    """E.164 form of a Japanese domestic or an international number, else null."""
    shaped = value.rlike(r"\A[+0-9\s()\-][0-9\s()\-]*\z")

    def plus(digits: Column) -> Column:
        rest = F.substring(digits, 3, 20)
        home = F.when(rest.startswith("0"), rest).otherwise(F.concat(F.lit("0"), rest))
        japan = let(home, lambda h: F.when(_jp_domestic(h), F.concat(F.lit("+81"), F.substring(h, 2, 20))))
        generic = F.when(digits.rlike(r"\A[1-9][0-9]{7,14}\z"), F.concat(F.lit("+"), digits))
        return F.when(digits.startswith("81"), japan).otherwise(generic)

    def convert(digits: Column) -> Column:
        domestic = F.when(_jp_domestic(digits), F.concat(F.lit("+81"), F.substring(digits, 2, 20)))
        return F.when(value.startswith("+"), plus(digits)).otherwise(domestic)

    return F.when(shaped, let(F.regexp_replace(value, "[^0-9]", ""), convert))


def normalize_kind(kind: str, common: Column, strip_subaddress: bool = False) -> Column:
    """Normalized value of a cell that is not missing; null when it cannot be read."""
    if kind == "email":
        return normalize_email(common, strip_subaddress)
    if kind == "phone":
        return normalize_phone(common)
    return common


def number_shaped(cell: Column) -> Column:
    return cell.rlike(r"\A[0-9 +\-().,/:]*\z") & cell.rlike("[0-9]")


def header_key(name: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in name.strip())


def header_kind(name: str) -> str | None:
    key = header_key(name)
    if key in EMAIL_HEADERS:
        return "email"
    return "phone" if key in PHONE_HEADERS else None


def header_kind_of(name: Column) -> Column:
    """The same for a column of header names."""
    key = F.translate(F.regexp_replace(name, rf"\A{SPACE}+|{SPACE}+\z", ""), ascii_uppercase, ascii_lowercase)
    return F.when(key.isin(*EMAIL_HEADERS), "email").when(key.isin(*PHONE_HEADERS), "phone")


def merged_row(field: Column, delimiter: str, column_count: int, field_count: Column | int) -> Column:
    """A field with line breaks that looks like rows swallowed by a stray quote."""
    count = lambda c: F.length(field) - F.length(F.replace(field, F.lit(c), F.lit("")))
    field_count = F.lit(field_count) if isinstance(field_count, int) else field_count
    return field.rlike(r"[\n\r]") & (
        (field_count != column_count) | (count(delimiter) >= max(column_count - 1, 1)) | (count('"') % 2 == 1)
    )
