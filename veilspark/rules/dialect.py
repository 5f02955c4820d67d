"""One pattern notation, two regex engines.

Patterns are written once and translated to the Java engine (Spark) and to RE2
(the SQL oracle). The notation is ordinary regex syntax plus boundary marks:

``⌊`` ``⌋``  ASCII word boundary before / after an ASCII word character
``¦``        ASCII word boundary next to anything
``⟨`` ``⟩``  boundary before / after a decimal digit of any script

``\\d`` and ``\\s`` follow Unicode and ``(?i)`` folds Unicode case; ``.`` stops
only at a line feed. RE2 has the ASCII meaning of these, which is why the oracle
is compared on ASCII input.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

ASCII_WORD = "0-9A-Za-z_"
_WORD = f"[{ASCII_WORD}]"
_OTHER_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\x{{200C}}\x{{200D}}&&[^{ASCII_WORD}]]"
_SPACE = r"\s\x{85}\p{Z}"

_JAVA_MARKS = {
    "⌊": f"(?<!{_WORD})",
    "⌋": f"(?!{_WORD})",
    "¦": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "⟨": rf"(?=\p{{Nd}})(?:(?=[0-9])(?<!{_WORD})|(?![0-9])(?<!{_OTHER_WORD}))",
    "⟩": rf"(?:(?<=[0-9])(?!{_WORD})|(?<![0-9])(?!{_OTHER_WORD}))",
}
_MARKS = "⌊⌋¦⟨⟩"


def _walk(pattern: str):
    """Yield (token, inside_class) with escapes kept whole."""
    inside = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            j = i + 2
            if pattern[i + 1] in "xpP" and i + 2 < len(pattern) and pattern[i + 2] == "{":
                j = pattern.index("}", i) + 1
            elif pattern[i + 1] == "x":
                j = i + 4
            yield pattern[i:j], inside
            i = j
            continue
        if not inside and ch == "[":
            inside = True
        elif inside and ch == "]":
            inside = False
        yield ch, inside
        i += 1


def _first(tree, ignore_case: bool) -> set[str] | None:
    """Characters a parsed pattern can start with; None when that is not a short list."""
    for op, arg in tree:
        if op is c.LITERAL:
            return {chr(arg)}
        if op is c.IN:
            out = set()
            for kind, value in arg:
                if kind is c.LITERAL:
                    out.add(chr(value))
                elif kind is c.RANGE and value[1] - value[0] < 64:
                    out.update(map(chr, range(value[0], value[1] + 1)))
                else:
                    return None
            return out
        if op is c.SUBPATTERN:
            return None if arg[1] or arg[2] else _first(arg[3], ignore_case)
        if op is c.BRANCH:
            parts = [_first(branch, ignore_case) for branch in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
            return _first(arg[2], ignore_case)
        return None
    return None


def first_class(pattern: str) -> str:
    """Look-ahead for the first character of a pattern that starts with a boundary.

    Checked before the boundary it rules out nearly every position cheaply.
    """
    body = re.sub(r"\A(?:\(\?m?i?m?\))*", "", pattern)
    if not body.startswith("⌊") or re.search(r"\(\?-?i", body) and not re.match(r"⌊[0-9A-Za-z]", body):
        return ""
    ignore_case = pattern.startswith("(?i)")
    plain = re.sub(r"[⌊⌋¦⟨⟩]", "", body).replace(r"\x{80}-\x{10FFFF}", "").replace(r"\z", r"\Z")
    plain = re.sub(r"\(\?i\)", "", plain)
    try:
        chars = _first(parser.parse(plain), ignore_case)
    except re.error:
        return ""
    if not chars or len(chars) > 40 or not all(x.isascii() and x.isalnum() for x in chars):
        return ""
    if ignore_case:
        # the enclosing (?iu) folds the class as well
        chars = {x.lower() for x in chars}
    return "(?=[" + "".join(sorted(chars)) + "])"


def to_java(pattern: str) -> str:
    out = []
    ahead = first_class(pattern)
    for tok, inside in _walk(pattern):
        if tok in _JAVA_MARKS:
            out.append((ahead if tok == "⌊" else "") + _JAVA_MARKS[tok])
            ahead = "" if tok == "⌊" else ahead
        elif tok == r"\d":
            out.append(r"\p{Nd}")
        elif tok == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif tok == r"\S":
            out.append(f"[^{_SPACE}]")
        elif tok == r"\w":
            word = r"\p{L}\p{M}\p{Nd}\p{Pc}"
            out.append(word if inside else f"[{word}]")
        elif tok in (r"\p{Han}", r"\p{Hiragana}", r"\p{Katakana}"):
            out.append(r"\p{Is" + tok[3:])
        else:
            out.append(tok)
    java = "".join(out)
    java = re.sub(r"\(\?(m?)i(m?)([):])", r"(?\1i\2u\3", java)
    return "(?d)" + java


def to_re2(pattern: str) -> str:
    return "".join(r"\b" if tok in _MARKS else tok for tok, _ in _walk(pattern))


def line_superset(pattern: str) -> str:
    """A Java pattern that finds a match wherever a line on its own has one.

    Used to skip documents before line-by-line work: text anchors may also
    hold at line ends, everything else is unchanged because a line feed is
    never a word character.
    """
    widened = pattern.replace(r"\A", r"(?:\A|(?<=\n))").replace(r"\z", r"(?=\r?\n|\z)")
    return to_java(widened)


def _stays(tree) -> bool:
    for op, arg in tree:
        if op is c.LITERAL:
            ok = arg != 10
        elif op is c.IN:
            ok = all(
                (kind is c.LITERAL and value != 10) or (kind is c.RANGE and not value[0] <= 10 <= value[1])
                or (kind is c.CATEGORY and value in (c.CATEGORY_DIGIT, c.CATEGORY_WORD))
                for kind, value in arg
            )
        elif op is c.SUBPATTERN:
            ok = _stays(arg[3])
        elif op is c.BRANCH:
            ok = all(_stays(branch) for branch in arg[1])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            ok = _stays(arg[2])
        else:
            ok = op is c.AT and arg is c.AT_BOUNDARY
        if not ok:
            return False
    return True


def one_line(pattern: str) -> bool:
    """No match of an RE2 pattern holds a line feed, nor does one depend on more than its line."""
    try:
        return _stays(parser.parse(pattern))
    except re.error:
        return False


def from_run_start(java: str, run: str) -> str:
    """Let a match begin only where a run of a class begins, or right behind the match before.

    ``run`` is a class with ``+`` that starts an alternative and is followed by a character outside the class. A try from
    inside such a run takes the same rest as one from its beginning, so the leftmost match stays what it is, while a
    backtracking engine no longer tries every position of a long run.
    """
    at = java.rfind(run)
    if at < 0:
        raise ValueError(f"{run} is not in the pattern")
    return f"{java[:at]}(?:\\G|(?<!{run[:-1]})){run}+{java[at + len(run):]}"


BLANK_LINES = r"(?m)^\s*"


def after_blank_lines(java: str) -> str:
    """For a pattern that starts with BLANK_LINES: no match begins at a line behind a blank one.

    The line before would begin the same match earlier. Blank lines of more than 64 blanks are still tried.
    """
    head = to_java(BLANK_LINES)
    if not java.startswith(head):
        raise ValueError("the pattern does not start with blank lines")
    return to_java("(?m)^") + r"(?<!\A[ \t\r]{0,64}\n)(?<!\n[ \t\r]{0,64}\n)" + java[len(to_java("(?m)^")):]
