"""Paths: globs, file classes and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
CODE_NAMES = "dockerfile gnumakefile justfile makefile rakefile gemfile vagrantfile procfile".split()
CODE_EXTENSIONS = "c cc cpp cs css go h hpp java js jsx kt mjs py rb rs sh swift ts tsx vue".split()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def is_code_path(path: Column) -> Column:
    name = F.lower(base_name(path))
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    return (
        name.isin(*CODE_NAMES)
        | name.startswith("dockerfile.")
        | name.startswith("makefile.")
        | extension.isin(*CODE_EXTENSIONS)
    )


def is_env_path(path: Column) -> Column:
    """Dotenv-style names, templates left out."""
    name = base_name(path)
    return (
        (name.startswith(".env") | name.endswith(".env"))
        & ~name.endswith(".env.example")
        & ~name.endswith(".env.sample")
    )


def glob_to_regex(glob: str) -> str:
    """Translate a path glob; ``*`` also crosses ``/``."""
    out = []
    i = 0
    depth = 0
    while i < len(glob):
        ch = glob[i]
        at_part = i == 0 or glob[i - 1] == "/"
        if glob.startswith("**/", i) and at_part:
            out.append("(?:.*/)?")
            i += 3
            continue
        if ch == "/" and glob[i:] == "/**":
            out.append("/.*")
            break
        if glob.startswith("/**/", i):
            out.append("/(?:.*/)?")
            i += 4
            continue
        if ch == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append(".*")
            continue
        if ch == "?":
            out.append(".")
        elif ch == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed character class in glob {glob!r}")
            body = glob[i + 1:end]
            negate = body[0] in "!^"
            body = (body[1:] if negate else body).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(("[^" if negate else "[") + body + "]")
            i = end
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {glob!r}")
    return r"\A(?s:" + "".join(out) + r")\z"


def any_glob(path: Column, globs) -> Column:
    """One regex test for a whole list of globs; an empty list matches nothing."""
    globs = list(globs)
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(glob_to_regex(g) for g in globs))


def path_allowed(path: Column, include, exclude) -> Column:
    """Exclude first, then include; a plain ``**/*`` include means no limit."""
    keep = F.lit(True) if "**/*" in include else any_glob(path, include)
    return ~any_glob(path, exclude) & keep


def glob_escape(path: Column) -> Column:
    """Wrap glob metacharacters so the pattern matches the path literally."""
    return F.regexp_replace(path, r"([*?\[{}])", "[$1]")


# --- fixed values: characters that hide, reorder or break up text -------------
HIDDEN = (
    r"[\p{Cc}\x{AD}\x{61C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}"
    r"\x{E0000}-\x{E007F}]"
)


def safe_label(text: Column) -> Column:
    """Replace control and invisible formatting characters in names shown to people."""
    return F.regexp_replace(text, HIDDEN, "?")


def escape_control(text: Column) -> Column:
    """Write control characters as ``\\u{hex}``; other text stays as it is."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    spelled = F.transform(
        chars,
        lambda c: F.when(c.rlike(r"\p{Cc}"), F.concat(F.lit("\\u{"), F.lower(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 16)), F.lit("}"))).otherwise(c),
    )
    return F.when(text.rlike(r"\p{Cc}"), F.array_join(spelled, "")).otherwise(text)
