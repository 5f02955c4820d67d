"""Checks applied to the text a rule matched.

Each function takes columns and returns a boolean column, and works on plain
columns as well as on lambda variables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

SPACE = r"[\s\x{85}\p{Z}]"

# --- fixed values ------------------------------------------------------------
IMAGE_AND_MEDIA = (
    "png jpg jpeg gif webp svg ico avif bmp tif tiff heic heif mp4 mov webm mkv avi ogv mp3 wav flac aac ogg opus "
    "woff ttf otf eot pdf"
).split()
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "change_me", "change-me", "your_", "your-")
PUBLIC_PREFIXES = (
    "NEXT_PUBLIC_", "VITE_", "REACT_APP_", "EXPO_PUBLIC_", "GATSBY_", "NUXT_PUBLIC_", "VUE_APP_", "PUBLIC_",
)
LOCATION_SUFFIXES = ("_PATH", "_FILE", "_DIR")
SECRET_WORDS = ("SECRET", "PASSWORD", "PASSWD", "PRIVATE")
METADATA_SUFFIXES = (
    "_EXPIRY", "_EXPIRES", "_EXPIRATION", "_TTL", "_PORT", "_TIMEOUT", "_TIMESTAMP", "_VERSION",
)
NON_SECRETS = ("true", "false", "null", "none", "undefined", "disabled", "enabled")
ADDRESS_NUMERALS = "0-9０-９一二三四五六七八九十"
ADDRESS_PARTICLES = "ではにをとやもへ第"
ADDRESS_HYPHENS = "-‐－−"
TEN_DIGIT_SERVICES = ("0120", "0170", "0180", "0570", "0990")
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def trim(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, r"""\A["']+|["']+\z""", "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, FULL_WIDTH_DIGITS, "0123456789"), "[^0-9]", "")


def distinct_chars(text: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over code points."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    size = F.length(text).cast("double")

    def bits(c: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
        return -share * F.log2(share)

    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + bits(c))


def luhn(text: Column) -> Column:
    return let(
        digits_of(text),
        lambda digits: F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
    )


def email_ok(text: Column) -> Column:
    """Rejects names such as ``logo@2x.png``."""
    return ~text.rlike(rf"@[23]x\.(?i:{'|'.join(IMAGE_AND_MEDIA)})\z")


def openai_ok(text: Column) -> Column:
    return F.lower(F.substring(text, 1, 7)) != "sk-ant-"


def value_after_assign(text: Column) -> Column:
    return unquote(trim(F.regexp_replace(text, r"\A(?s:.*)[=:]", "")))


def token_value_ok(value: Column) -> Column:
    marker = F.lower(value).rlike("|".join(PLACEHOLDERS))
    return ~marker & (distinct_chars(value) >= 8)


def labelled_token_ok(text: Column) -> Column:
    return token_value_ok(value_after_assign(text))


def char_classes(value: Column) -> Column:
    return sum(
        (value.rlike(c).cast("int") for c in ("[A-Z]", "[0-9]", "[_-]")),
        value.rlike("[a-z]").cast("int"),
    )


def hex_like(value: Column) -> Column:
    return value.rlike(r"\A[0-9A-Fa-f]*\z")


def _runs(length: int) -> str:
    """Every ascending and descending run of ``length`` letters or digits."""
    out = []
    for alphabet in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"):
        for a in (alphabet, alphabet[::-1]):
            out += [a[i:i + length] for i in range(len(a) - length + 1)]
    return "|".join(out)


def ascii_sequence(value: Column, length: int = 8) -> Column:
    """A run such as ``abcdefgh`` or ``87654321``, other characters left out."""
    return F.regexp_replace(value, "[^0-9A-Za-z]", "").rlike(_runs(length))


def generic_key_ok(text: Column) -> Column:
    def check(value: Column) -> Column:
        is_hex = hex_like(value)
        plain = (char_classes(value) <= 1) & (~is_hex | (F.octet_length(value) < 32))
        return token_value_ok(value) & ~plain & (is_hex | ~ascii_sequence(value))

    return let(value_after_assign(text), check)


def env_key_public(key: Column) -> Column:
    upper = F.upper(key)
    location = upper.rlike(rf"(?:{'|'.join(LOCATION_SUFFIXES)})\z")
    bundled = upper.rlike(rf"\A(?:{'|'.join(PUBLIC_PREFIXES)})")
    return location | (bundled & ~upper.rlike("|".join(SECRET_WORDS)))


def env_numeric_meta(key: Column) -> Column:
    return F.upper(key).rlike(rf"(?:{'|'.join(METADATA_SUFFIXES)})\z")


def identifier_prefix(before: Column) -> Column:
    """Identifier characters that end ``before``, the text in front of a match."""
    return F.reverse(F.regexp_extract(F.reverse(before), r"\A[0-9A-Za-z_]*", 0))


def generic_key_public(before: Column, text: Column) -> Column:
    name = F.concat(identifier_prefix(before), F.regexp_extract(text, r"\A[0-9A-Za-z_]*", 0))
    return env_key_public(name)


def env_assign_ok(text: Column) -> Column:
    key = F.regexp_extract(F.substring_index(text, "=", 1), rf"([^\s\x{{85}}\p{{Z}}]+){SPACE}*\z", 1)

    def value_ok(value: Column) -> Column:
        lower = F.lower(value)
        template = (
            (F.octet_length(value) < 8)
            | value.rlike(r"\A(?:encrypted:|\$|<|%\(|\{\{)")
            | F.contains(lower, F.lit("xxxx"))
            | lower.isin(*NON_SECRETS)
        )
        number = value.rlike(r"\A[0-9]*\z") & let(key, env_numeric_meta)
        return ~template & ~number & token_value_ok(value)

    value = unquote(trim(F.regexp_replace(text, r"\A[^=]*=", "")))
    return F.contains(text, F.lit("=")) & ~let(key, env_key_public) & let(value, value_ok)


def ja_phone_ok(text: Column) -> Column:
    """Length, grouping and service-range rules of the Japanese numbering plan."""
    sizes = F.concat_ws("-", F.transform(F.split(text, "-"), lambda p: F.length(digits_of(p)).cast("string")))

    def check(digits: Column, sizes: Column) -> Column:
        grouping = (
            F.when(digits.rlike(rf"\A(?:{'|'.join(TEN_DIGIT_SERVICES)})"), sizes.isin("4-3-3", "4-2-4"))
            .when(digits.startswith("0800"), sizes == "4-3-4")
            .when(digits.startswith("0200"), sizes == "3-6-5")
            .when(digits.startswith("0204"), sizes == "4-3-4")
            .when(digits.startswith("020"), sizes == "3-3-5")
            .otherwise(sizes.rlike(r"\A\d+-\d+-\d+\z"))
        )
        return F.length(digits).isin(10, 11, 14) & grouping & ~text.rlike(r"\A[^-]*-0*-0*\z")

    return let(digits_of(text), lambda digits: let(sizes, lambda s: check(digits, s)))


def ja_phone_embedded(left: Column, right: Column) -> Column:
    """The match continues into a longer chain of digits on either side."""
    return left.rlike(r"\p{N}-?\z") | right.rlike(r"\A-?\p{N}")


def ja_postal_ok(text: Column) -> Column:
    return text.rlike("[1-9]")


def ja_address_ok(text: Column) -> Column:
    n = ADDRESS_NUMERALS
    return (
        text.rlike(rf"\A[^{n}]+[{n}]")
        & ~text.rlike(rf"\A[^{n}]*[{ADDRESS_PARTICLES}][{n}]")
        & ~text.rlike(rf"\A[^{n}]*[0-9]{{4}}[{ADDRESS_HYPHENS}]")
    )
