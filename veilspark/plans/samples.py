"""Planted example lines for the detection queries.

The provided tables hold few secrets, so a query appends one line to every
document: text of the shape a rule looks for, filled with hex digits of the
document's id. ``sample`` derives that shape from the rule's own pattern and
returns SQL that Spark and the oracle both understand.
"""

from __future__ import annotations

import re
import string
from re import _constants as c
from re import _parser as parser

HEX = "0123456789abcdef"
PRINTABLE = string.ascii_lowercase + string.digits + string.ascii_uppercase + string.punctuation + " \n"


def quote(text: str) -> str:
    """A string literal without escapes, valid in both SQL dialects."""
    parts, run = [], ""
    for ch in text:
        if ch in "'\\" or ord(ch) < 32:
            if run:
                parts.append(f"'{run}'")
            parts.append(f"chr({ord(ch)})")
            run = ""
        else:
            run += ch
    if run or not parts:
        parts.append(f"'{run}'")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


class Pool:
    """Hex digits derived from a key column; every call takes fresh ones."""

    def __init__(self, key: str, salt: str = "s") -> None:
        self.key, self.salt, self.used = key, salt, 0

    def take(self, n: int) -> str:
        parts = []
        while n > 0:
            k = min(n, 32)
            self.used += 1
            parts.append(f"substr(md5(concat('{self.salt}{self.used}', cast({self.key} as string))), 1, {k})")
            n -= k
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    def digits(self, n: int) -> str:
        return f"translate({self.take(n)}, 'abcdef', '012345')"

    def from_set(self, allowed: str, n: int) -> str:
        """``n`` characters of ``allowed``; long runs use two letter ranges."""
        if n >= 24 and len(allowed) >= 40:
            half = n // 2
            return f"concat({self._mapped(allowed, half, False)}, {self._mapped(allowed, n - half, True)})"
        return self._mapped(allowed, n, False)

    def _mapped(self, allowed: str, n: int, far: bool) -> str:
        order = [x for x in allowed if x.isalnum()] or list(allowed)
        out = []
        for i, h in enumerate(HEX):
            if not far and h in allowed:
                out.append(h)
            elif not far and h.upper() in allowed:
                out.append(h.upper())
            else:
                out.append(order[-1 - (i % len(order))])
        mapped = "".join(out)
        return self.take(n) if mapped == HEX else f"translate({self.take(n)}, '{HEX}', {quote(mapped)})"


def _charset(items, ignore_case: bool) -> str:
    negate, chars = False, set()
    for op, arg in items:
        if op is c.NEGATE:
            negate = True
        elif op is c.LITERAL:
            chars.add(chr(arg))
        elif op is c.RANGE:
            chars.update(ch for ch in PRINTABLE if arg[0] <= ord(ch) <= arg[1])
        elif op is c.CATEGORY:
            test = {c.CATEGORY_DIGIT: str.isdigit, c.CATEGORY_SPACE: str.isspace,
                    c.CATEGORY_WORD: lambda x: x.isalnum() or x == "_",
                    c.CATEGORY_NOT_SPACE: lambda x: not x.isspace()}[arg]
            chars.update(ch for ch in PRINTABLE if test(ch))
    allowed = [ch for ch in PRINTABLE if (ch in chars) != negate]
    return "".join(allowed)


def _emit(tree, pool: Pool, out: list[str], literal: list[str]) -> None:
    def flush() -> None:
        if literal:
            out.append(quote("".join(literal)))
            literal.clear()

    for op, arg in tree:
        if op is c.LITERAL:
            literal.append(chr(arg))
        elif op is c.NOT_LITERAL:
            literal.append("x")
        elif op is c.ANY:
            literal.append("x")
        elif op is c.IN:
            allowed = _charset(arg, False)
            literal.append(next((x for x in allowed if x.isalnum()), allowed[0]))
        elif op is c.SUBPATTERN:
            _emit(arg[3], pool, out, literal)
        elif op is c.BRANCH:
            _emit(arg[1][0], pool, out, literal)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, _high, body = arg
            if low == 0:
                continue
            if len(body) == 1 and body[0][0] is c.IN:
                flush()
                out.append(pool.from_set(_charset(body[0][1], False), low))
            elif len(body) == 1 and body[0][0] is c.ANY:
                flush()
                out.append(pool.take(low))
            else:
                for _ in range(low):
                    _emit(body, pool, out, literal)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            continue
        else:
            raise ValueError(f"cannot make a sample for {op}")


def sample(pattern: str, key: str, salt: str = "s") -> str:
    """SQL text that matches ``pattern`` (boundary-mark notation)."""
    plain = re.sub(r"[⌊⌋¦⟨⟩]", "", pattern)
    plain = plain.replace(r"\x{80}-\x{10FFFF}", "").replace(r"\z", r"\Z")
    plain = re.sub(r"\(\?i\)", "", plain).replace("(?i:", "(?:").replace("(?-i:", "(?:").replace("(?m)", "")
    out: list[str] = []
    literal: list[str] = []
    _emit(parser.parse(plain), Pool(key, salt), out, literal)
    if literal:
        out.append(quote("".join(literal)))
    return f"concat({', '.join(out)}, '')"


def tuned_samples(key: str = "doc_id") -> dict[str, str]:
    """Planted lines for rules whose pattern alone does not give a valid value."""
    p = Pool(key, "t")
    d, h = p.digits, p.take

    def line(*parts: str) -> str:
        return f"concat({', '.join(parts)})"

    return {
        "pii.email": line("'mail user'", d(5), "'@mail.example.test, logo@2x.png'"),
        "pii.plaintext_map": line("'email_'", f"translate({h(13)}, '0189', 'wxyz')", "' = u'", d(3), "'@example.test'"),
        "pii.credit_card": line("'card 4'", d(3), "'-'", d(4), "'-'", d(4), "'-'", d(4), "' end'"),
        "pii.ipv4": line("'ip 10.'", d(2), "'.'", d(1), "'.7 and 999.1.1.1'"),
        "pii.ipv6": line("'addr '", h(4), "':'", h(3), "':'", h(2), "':1 '"),
        "pii.en.phone": line("'call +1 '", d(3), "'-555-'", d(4)),
        "pii.en.ein": line("'EIN: '", d(2), "'-'", d(7)),
        "pii.en.postal_code": line("'zip: '", d(5), "'-'", d(4)),
        "pii.en.passport": line("'Passport No: '", d(9)),
        "pii.en.name": line("'Name: Ada '", f"concat('L', translate({h(6)}, '0123456789', 'ghijklmnop'))"),
        "pii.en.address": line("'address: '", d(3), "' Main Street'"),
        "pii.en.ssn": line("'SSN '", d(3), "'-'", d(2), "'-'", d(4)),
        "pii.ja.phone": line("'tel 090-'", d(4), "'-'", d(4), "' or 0120-'", d(3), "'-'", d(4), "' id 1-03-'", d(4),
                             "'-'", d(4)),
        "pii.ja.postal_code": line("'〒'", d(3), "'-'", d(4), "' 郵便番号: 000-0000'"),
        "pii.ja.passport": line("'旅券番号: AB'", d(7)),
        "pii.ja.my_number": line("'個人番号: '", d(12)),
        "pii.ja.corporate_number": line("'法人番号: '", d(13)),
        "pii.ja.drivers_license": line("'免許証番号: '", d(12)),
        "pii.ja.bank_account": line("'銀行: 本店 口座番号: '", d(7)),
        "pii.ja.health_insurance": line("'健康保険証: 記号 AB12 番号 '", d(6)),
        "pii.ja.name": line("'氏名: 山田太郎 '", d(2)),
        "pii.ja.address": line("'東京都千代田区丸の内'", d(1), "'-'", d(1), "'-'", d(1), "' 愛知県名古屋市中区で3番'"),
        "secret.openai_api_key": line("'sk-proj-'", h(32), "' sk-ant-'", h(24)),
        "secret.database_url": line("'postgres://u'", h(4), "':'", h(8), "'@db.example.test/app'"),
        "secret.twilio_auth_token": line("'twilio_auth_token='", h(32)),
        "secret.vercel_token": line("'VERCEL_TOKEN='", h(24), "' vercel_token=your-'", h(24)),
        "secret.cloudflare_api_token": line("'cloudflare_api_token: '", h(32)),
        "secret.notion_integration_token": line("'notion_token=secret_'", h(43)),
        "secret.generic_api_key": line("'api_key = '", quote('"'), h(32), quote('"'), "' NEXT_PUBLIC_API_KEY='",
                                       h(20), "' secret_key=abcdefghijkl'", d(6)),
        "secret.dotenvx_private_key": line("'DOTENV_PRIVATE_KEY_PROD='", quote('"'), h(40), quote('"')),
        "secret.bearer_token": line("'Authorization: Bearer '", h(30)),
        "secret.private_key_block": line("'-----BEGIN RSA PRIVATE KEY-----'", "chr(10)", h(64)),
        "env.sensitive_assignment": line("'export DB_PASSWORD='", h(12), "chr(10)", "'TOKEN_TTL=12345678'", "chr(10)",
                                         "'API_TOKEN=changeme-please'"),
    }


# planted characters for the rules about text that misleads an AI reader
AI_SAMPLES = {
    "ai_unicode_tag_chars": "\U000e0041x\U000e007f",
    "ai_bidi_control": "a‮b⁦c",
    "ai_embedded_bom": "x﻿y",
    "ai_invisible_format": "in​vis­ible⁠",
    "ai_variation_selector": "v\U000e0100w",
    "ai_unsafe_uri": "href=javascript:alert(1) data:text/html,x",
    "ai_svg_data_uri": "src=data:image/svg+xml;base64,AA",
}
