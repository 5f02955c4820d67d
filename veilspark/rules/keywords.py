"""One pass over a text that tells which rule keywords occur in it.

The keywords are folded into one prefix-sharing pattern inside a look-ahead, so
every position is tried and keywords may overlap. At one position the longest
keyword is reported; ``words_implying`` lists the longer ones that a rule has to
accept as well.
"""

from __future__ import annotations

import re

# too short to be worth reporting one by one
DIRECT = ("s.", "sk", "ey")

# Document tests made once for many rules. A rule behind a gate cannot match a
# text that fails it; the tests of this repository derive that from the patterns.
#
# run    a stretch without blanks, as long as the shortest self-describing token
# label  an assignment operator with a value right behind it
# cjk    the code range of Japanese labels (kana, Han, the postal mark)
GATES = {
    "run": r"[0-9A-Za-z_\-.+/=~%\\:|@?\x{80}-\x{10FFFF}]{18}",
    "label": r"[=>:|,][\x60'\"\s\x{85}\p{Z}=]{0,5}[0-9A-Za-z_\-.+/=%:\x{80}-\x{10FFFF}]{14}",
    "cjk": r"[\x{3000}-\x{9FFF}]",
}


def in_pass(word: str, gate: str | None) -> bool:
    return gate in ("run", "label") and word not in DIRECT


def _node(words: list[str]) -> str:
    """Pattern for the given suffixes, longest alternative first."""
    ends = "" in words
    by_char: dict[str, list[str]] = {}
    for word in words:
        if word:
            by_char.setdefault(word[0], []).append(word[1:])
    branches = []
    for char, rest in sorted(by_char.items()):
        literal = re.escape(char)
        while len(set(rest)) == 1 and rest[0]:
            literal += re.escape(rest[0][0])
            rest = [r[1:] for r in rest]
        branches.append(literal + _node(rest) if any(rest) else literal)
    if not branches:
        return ""
    body = "(?:" + "|".join(branches) + ")" if len(branches) > 1 or ends else branches[0]
    return body + ("?" if ends else "")


def _escape_class(char: str) -> str:
    return "\\" + char if char in "[]\\^-&" else char


def pass_pattern(words) -> str:
    """Look-ahead pattern whose group 1 is the keyword at a position.

    First characters are grouped so that a position is ruled out by a few class
    tests instead of one test per keyword.
    """
    words = sorted(set(words))
    firsts = sorted({w[0] for w in words})
    size = 6
    groups = []
    for at in range(0, len(firsts), size):
        chunk = firsts[at:at + size]
        inner = _node([w for w in words if w[0] in chunk])
        groups.append(f"(?=[{''.join(map(_escape_class, chunk))}]){inner}")
    return "(?=(" + "|".join(groups) + "))"


def words_implying(keyword: str, words) -> list[str]:
    """Reported words that prove ``keyword`` occurs: itself and its extensions."""
    return sorted({w for w in words if w.startswith(keyword)} | {keyword})
