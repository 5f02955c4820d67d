"""Risk classification of tool calls: commands and paths in a table of events.

A payload is JSON. Command strings are cut into segments, each segment is
classified, and the first hit of an event decides. All of it happens in the
event's row.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..policy import Policy
from .patterns import any_regex, few, matches, star_anchor

# --- fixed values: where payloads keep commands and paths ---------------------------
COMMAND_KEYS = ("command", "shell_command", "cmd", "CommandLine", "command_line")
GENERIC_KEYS = ("args", "input")
PATH_KEYS = (
    "file_path", "filePath", "target_file", "targetPath", "TargetFile", "AbsolutePath", "path", "uri", "fileName",
    "filename", "notebook_path", "paths", "SearchPath",
)
TEXT_KEYS = ("prompt", "text", "content", "command", "stdin", "args", "url")
GLOB_KEYS = ("glob", "include")
WRITE_WORDS = ("write", "edit", "create", "update", "delete")

# --- fixed values: paths ----------------------------------------------------------------
SECRET_PATHS = (
    ".env", "./.env", ".env.*", "./.env.*", "tokens/*.json", "./tokens/*.json", "**/*token*", "**/*key*",
    "**/*secret*", "**/*password*", "**/*credential*",
)
DOTENV_PATHS = (".env", "./.env", ".env.*", "./.env.*")
HISTORY_PATHS = (
    ".zsh_history", "**/.zsh_history", ".bash_history", "**/.bash_history", ".sh_history", "**/.sh_history",
    ".history", "**/.history", ".local/share/fish/fish_history", "**/.local/share/fish/fish_history",
    "consolehost_history.txt", "visual studio code host_history.txt", "**/powershell/psreadline/*_history.txt",
)
TEMPLATES = (".env.example", ".env.sample", ".env.template", ".env.dist")
DATA_EXTENSIONS = "json yaml yml toml ini cfg conf txt csv xml pem key p12 pfx jks keystore kdbx properties".split()
MARKERS = ("token", "key", "secret", "password", "credential")

# --- fixed values: commands ---------------------------------------------------------------
READERS = (
    "cat tac nl diff xxd od base64 bat head tail less more source sed awk grep egrep fgrep rg strings cut sort uniq wc "
    "dd cp jq yq python python3 node ruby perl get-content gc type powershell pwsh ."
).split()
DOTENV_SAFE = (
    "ls stat test [ [[ touch rm mkdir rmdir chmod cd pushd echo printf which basename dirname realpath readlink true : "
    "du file md5sum sha256sum shasum"
).split()
GIT_SAFE = "add rm status check-ignore ls-files restore checkout reset clean update-index".split()
TRANSFER = "curl wget nc netcat ssh scp rsync ftp sftp".split()
PRIVILEGE = "sudo su chown chgrp mount umount systemctl service".split()
DECRYPTERS = {"dotenvx": ("get", "decrypt", "keypair")}
PACKAGE_MANAGERS = "apt yum dnf pacman brew".split()
DB_CLIENTS = "psql mysql mongosh mongo redis-cli sqlite3 sqlite".split()
DB_WORDS = (
    "drop delete update insert truncate alter create replace merge grant revoke flushall flushdb set del hset hmset "
    "lpush rpush sadd zadd"
).split()
ENV_READS = {
    "python": ("-c", ("os.environ", "os.getenv", "import environ", "print(environ", "environ[", "environ.get")),
    "node": ("-e", ("process.env",)),
    "ruby": ("-e", ("puts env", "p env", "env[", "env.fetch", "env.each", "env.to_h")),
    "perl": ("-e", ("%env", "$env{")),
}

SECRET_FILE, SECRET_DUMP, ENV_DUMP = "secret_file_access", "secret_dump_command", "environment_dump"
DESTRUCTIVE, DB_MUTATION, PRIVILEGED = "destructive_filesystem", "direct_db_mutation", "privilege_system_change"
TRANSFERS, INSTALL, OPAQUE, CUSTOM = "external_transfer", "system_install", "opaque_execution", "custom_policy"
ORDER = (SECRET_DUMP, ENV_DUMP, DESTRUCTIVE, PRIVILEGED, TRANSFERS, INSTALL, OPAQUE, DB_MUTATION)
PROFILES = {
    "minimal": (SECRET_FILE, SECRET_DUMP, ENV_DUMP, DESTRUCTIVE, DB_MUTATION),
    "recommended": tuple(c for c in (SECRET_FILE, *ORDER) if c != OPAQUE),
    "strict": (SECRET_FILE, *ORDER),
}


def wildcard_regex(pattern: str) -> str:
    """``*`` patterns of action rules as a regex."""
    return r"\A(?s:" + ".*".join(re.escape(p) for p in pattern.split("*")) + r")\z"


def wildcard_match(pattern: str, text: Column) -> Column:
    return text.rlike(wildcard_regex(pattern)) if "*" in pattern else text == pattern


def _any_wildcard(text: Column, patterns) -> Column:
    return text.rlike("|".join(wildcard_regex(p) for p in patterns)) if patterns else F.lit(False)


# -- extraction ---------------------------------------------------------------------------


ENVELOPES = ("tool_input", "toolArgs", "toolInput")


def _canonical(payload: Column) -> Column:
    """JSON of a payload, in which top-level envelopes that hold an encoded object or array are decoded."""
    def decoded(key: Column, value: Column) -> Column:
        inner = F.try_parse_json(F.try_variant_get(value, "$", "string"))
        wanted = key.isin(*ENVELOPES) & F.to_json(value).startswith('"') & F.to_json(inner).rlike(r"\A[\[{]")
        return F.when(wanted, inner).otherwise(value)

    text = F.to_json(payload)
    fields = F.try_variant_get(payload, "$", "map<string,variant>")
    encoded = text.rlike(rf'\A\{{.*"(?:{"|".join(ENVELOPES)})":"')
    return F.when(encoded, F.coalesce(F.to_json(F.transform_values(fields, decoded)), text)).otherwise(text)


def _strings(payload: Column, *groups, joined: bool = True) -> Column:
    """For each group of keys, the strings under them at any depth of the payload, in the order of its canonical JSON.

    All strings below an array or object count, of an array also, when ``joined``, those among its items as one
    command line. Spark parses the payload, decodes envelopes and writes the canonical JSON; the walk over that is
    in Python, in proportion to its length. Payloads that name no key don't go there.
    """
    wanted = [frozenset(g) for g in groups]

    def strings_of(value, keys, joined: bool) -> list[str]:
        """Strings under the keys in a parsed payload, in its order; with ``joined`` also an array's own strings as one line.

        A walk with a stack of its own, so that depth is no limit. An item is the value and whether it counts, that is,
        whether a listed key is right before it or above it.
        """
        out: list[str] = []
        stack: list[tuple] = [(value, False)]
        while stack:
            x, counts = stack.pop()
            if isinstance(x, str):
                if counts:
                    out.append(x)
            elif isinstance(x, list):
                own = [i for i in x if isinstance(i, str)] if joined and counts else None
                if own:
                    stack.append((" ".join(own), True))  # where the array ends
                stack.extend((i, counts) for i in reversed(x))
            elif isinstance(x, dict):
                stack.extend((v, counts or k in keys) for k, v in reversed(x.items()))
        return out

    @F.arrow_udf("array<array<string>>")
    def walked(texts: pa.Array) -> pa.Array:
        rows = (None if t is None else json.loads(t) for t in texts.to_pylist())
        return pa.array([None if v is None else [strings_of(v, k, joined) for k in wanted] for v in rows], pa.list_(pa.list_(pa.string())))

    names = "|".join(f'"{re.escape(k)}":' for k in dict.fromkeys(k for g in groups for k in g))
    return walked(let(_canonical(payload), lambda t: F.when(t.rlike(names), t)))


def extract(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``commands``, ``paths`` and ``access`` to events; bad JSON gives none."""
    parsed = events.select("*", F.try_parse_json(F.col(payload)).alias("__v"))
    parsed = parsed.withColumn("__s", _strings(F.col("__v"), (*COMMAND_KEYS, *GENERIC_KEYS), GLOB_KEYS, PATH_KEYS))
    under = lambda k: F.coalesce(F.get("__s", F.lit(k)), F.array().cast("array<string>"))
    commands = F.array_sort(F.array_distinct(under(0)))
    globs = F.filter(under(1), is_dotenv_path)  # a search that selects dotenv files reads them
    paths = F.array_sort(F.array_distinct(F.concat(under(2), globs)))
    write = F.lower(F.col(payload)).rlike("|".join(WRITE_WORDS))
    return parsed.select(
        *events.columns, commands.alias("commands"), paths.alias("paths"),
        F.when(write, "write").otherwise("read").alias("access"),
    )


def payload_text(payload: Column, keys=TEXT_KEYS, separator: str = "\n") -> Column:
    """Scannable strings of a payload, joined."""
    found = F.get(_strings(F.try_parse_json(payload), keys, joined=False), F.lit(0))
    return F.coalesce(F.array_join(F.array_distinct(found), separator), F.lit(""))


# -- shell text -----------------------------------------------------------------------------

SEGMENT = r"""((?:[^\\"';|&()\n]++|\\(?s:.)|"(?:[^"\\]++|\\(?s:.))*+"|'[^']*+')++)"""


def segments(command: Column) -> Column:
    """Parts of a command line between unquoted separators."""
    parts = F.regexp_extract_all(command, F.lit(SEGMENT), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\A\s+|\s+\z", ""))), lambda p: p != "")


def normalized(segment: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(segment, r"\A\s+|\s+\z", ""), r"\A(?:Bash\()+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\)+\z", ""), r"(?::\*)+\z", ""))


def words(command: Column) -> Column:
    return F.filter(F.split(command, r"""[\s"'`;|&(),=]"""), lambda w: w != "")


def base_command(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"\A.*[/\\]", ""), r"\.exe\z", "")


# -- paths -------------------------------------------------------------------------------------


def _clean_path(raw: Column) -> Column:
    bare = F.regexp_replace(raw, r"""\A["'`:;]+|["'`:;]+\z""", "")
    return F.replace(F.lower(F.regexp_replace(bare, r"\A(?:file://)+", "")), F.lit("\\"), F.lit("/"))


def is_dotenv_path(raw: Column) -> Column:
    """A dotenv file other than a template, or a path through a directory named like one."""
    def check(p: Column) -> Column:
        name = F.substring_index(p, "/", -1)
        folder = p.rlike(r"(?:\A|/)\.env(?:\.[^/]*)?/")
        return folder | (name.rlike(r"\A\.env(?:\.|\z)") & ~name.isin(*TEMPLATES))

    return let(F.regexp_replace(F.regexp_replace(_clean_path(raw), r"\A.*:", ""), r"\A\./", ""), check)


def is_always_secret_path(raw: Column) -> Column:
    def check(p: Column) -> Column:
        tokens = F.contains(p, F.lit("/tokens/")) & p.endswith(".json")
        return tokens | _any_wildcard(p, ("tokens/*.json", "./tokens/*.json", *HISTORY_PATHS))

    return is_dotenv_path(raw) | let(_clean_path(raw), check)


def is_secret_path(raw: Column) -> Column:
    """Secret by kind or by a word in the name."""
    def check(p: Column) -> Column:
        template = F.substring_index(p, "/", -1).isin(*TEMPLATES) & ~p.rlike(r"(?:\A|/)\.env(?:\.[^/]*)?/")
        dotenv = p.endswith("/.env") | F.contains(p, F.lit("/.env.")) | _any_wildcard(p, DOTENV_PATHS)
        tokens = p.endswith("/tokens") | (F.contains(p, F.lit("/tokens/")) & p.endswith(".json"))
        data_file = p.rlike(
            rf"\A(?:[^/]*(?:{'|'.join(MARKERS)})[^/]*\.(?:{'|'.join(DATA_EXTENSIONS)})|[^/]*\.(?:{'|'.join(MARKERS)}))\z"
        ) & F.substring_index(p, ".", -1).isin(*DATA_EXTENSIONS)
        named = _any_wildcard(p, [x for x in SECRET_PATHS if x not in DOTENV_PATHS] + list(HISTORY_PATHS))
        return (~template & dotenv) | tokens | data_file | named

    return let(_clean_path(raw), check)


# -- segment checks: ``c`` is the normalized segment, ``w`` its words, ``cmd`` the first word's name ------


def secret_dump(c: Column, w: Column, cmd: Column) -> Column:
    rest = F.slice(w, F.lit(2), F.size(w))
    secret = F.exists(rest, is_secret_path)
    dotenv = F.exists(rest, is_dotenv_path)
    safe = cmd.isin(*DOTENV_SAFE) | ((cmd == "git") & F.coalesce(F.get(w, F.lit(1)), F.lit("")).isin(*GIT_SAFE))
    redirected = F.exists(F.regexp_extract_all(c, F.lit(r"<\s*([^\s<>|;&]+)"), F.lit(1)), is_secret_path)
    first = F.coalesce(F.get(F.filter(rest, lambda x: ~x.startswith("-")), F.lit(0)), F.lit(""))
    reveals = F.lit(False)
    for name, verbs in DECRYPTERS.items():
        reveals = reveals | ((cmd == name) & first.isin(*verbs))
    return (cmd.isin(*READERS) & secret) | (~cmd.isin(*READERS) & ~safe & dotenv) | redirected | reveals


def env_dump(c: Column, w: Column, cmd: Column) -> Column:
    tail = F.regexp_replace(c, r"\A\S+", "")
    ends = F.regexp_replace(tail, r"\A\s+", "").rlike(r"\A(?:[|>;&]|\z)")
    args = F.regexp_replace(
        tail, r"\A(?:\s+(?:(?:-u|--unset|-c|--chdir)\s+\S+|-\S*|[a-z_][a-z0-9_]*=\S*))*\s*", "")
    rest = F.slice(w, F.lit(2), F.size(w))
    flags = F.forall(rest, lambda x: x.rlike(r"\A-.*[px]"))
    out = (
        F.when(cmd == "printenv", True)
        .when(cmd == "env", args.rlike(r"\A(?:[|>;&]|\z)") | base_command(F.regexp_extract(args, r"\A(\S+)", 1)).isin("env", "printenv"))
        .when(cmd == "export", ends | F.regexp_replace(tail, r"\A\s+", "").startswith("-p"))
        .when(cmd == "set", ends)
        .when(cmd.isin("declare", "typeset"), flags)
        .when(cmd == "compgen", F.arrays_overlap(rest, F.array(F.lit("-e"), F.lit("-v"))))
        .when(cmd.isin("bash", "sh", "zsh") & F.array_contains(w, "-c"),
              F.contains(c, F.lit("/proc/self/environ")) | c.rlike(r"""-c\s+["']?\s*(?:printenv\b|env\s*["']?\s*\z|export\s+-p|set\s*["']?\s*\z)"""))
    )
    for name, (flag, patterns) in ENV_READS.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(c, F.lit(p))
        flagged = F.array_contains(w, flag) | (F.array_contains(w, "--eval") if name == "node" else F.lit(False))
        out = out.when(cmd.startswith(name) if name == "python" else cmd == name, flagged & hit)
    return out.otherwise(F.contains(c, F.lit("/proc/self/environ")))


def destructive_rm(w: Column, cmd: Column) -> Column:
    rest = F.slice(w, F.lit(2), F.size(w))
    short = lambda letter: F.exists(rest, lambda x: x.rlike(rf"\A-(?!-).*{letter}"))
    recursive = short("r") | F.array_contains(rest, "--recursive")
    force = short("f") | F.array_contains(rest, "--force")

    def dangerous(t: Column) -> Column:
        home = F.regexp_replace(t, r"\A\$(?:\{home\}|home)(?=/|\z)", "~")
        parts = F.array_join(F.filter(F.split(home, "/"), lambda p: (p != "") & (p != ".")), "/")
        absolute = home.startswith("/")
        return parts.isin("", "*") | (~absolute & parts.rlike(r"\A(?:~|~/\*|(?:\.\./)*(?:\.\.|\*))\z"))

    targets = F.filter(rest, lambda x: ~x.startswith("-"))
    return (cmd == "rm") & recursive & force & F.exists(targets, dangerous)


def privilege(c: Column, w: Column, cmd: Column) -> Column:
    modes = F.flatten(F.transform(let(F.split(c, r"\s+"), lambda ws: F.slice(ws, F.lit(2), F.size(ws))), lambda x: F.split(x, ",")))
    everyone = F.exists(modes, lambda m: m.rlike(
        r"\A[0-7]*777\z|\A(?:a|(?=[ago]*u)(?=[auo]*g|[augo]*g)(?=[aug]*o|[augo]*o)[augo]+)[+=](?=[rwxst]*r)(?=[rwxst]*w)(?=[rwxst]*x)[rwxst]+\z"))
    return ((cmd == "chmod") & (F.array_contains(w, "777") | everyone)) | cmd.isin(*PRIVILEGE)


def db_mutation(w: Column, cmd: Column, strict: bool) -> Column:
    mutates = F.arrays_overlap(w, F.array(*(F.lit(x) for x in DB_WORDS)))
    return cmd.isin(*DB_CLIENTS) & (F.lit(True) if strict else mutates)


def opaque(w: Column, cmd: Column) -> Column:
    flag = F.coalesce(F.get(w, F.lit(1)), F.lit(""))
    return (
        (cmd.isin("bash", "sh", "zsh", "python", "python3") & (flag == "-c"))
        | ((cmd == "node") & flag.isin("-e", "--eval")) | (cmd.isin("ruby", "perl") & (flag == "-e"))
    )


def category(segment: Column, profile: str = "recommended") -> Column:
    """First matching category of a command segment, null when it is harmless."""
    active = PROFILES[profile]

    def of_words(c: Column, w: Column, cmd: Column) -> Column:
        tests = {
            SECRET_DUMP: lambda: secret_dump(c, w, cmd), ENV_DUMP: lambda: env_dump(c, w, cmd),
            DESTRUCTIVE: lambda: destructive_rm(w, cmd), PRIVILEGED: lambda: privilege(c, w, cmd),
            TRANSFERS: lambda: cmd.isin(*TRANSFER), INSTALL: lambda: cmd.isin(*PACKAGE_MANAGERS),
            OPAQUE: lambda: opaque(w, cmd), DB_MUTATION: lambda: db_mutation(w, cmd, profile == "strict"),
        }
        out = F.when(F.size(w) == 0, F.lit(None).cast("string"))
        for name in ORDER:
            if name in active:
                out = out.when(tests[name](), name)
        return out

    return let(normalized(segment), lambda c: let(words(c), lambda w: let(
        base_command(F.coalesce(F.get(w, F.lit(0)), F.lit(""))), lambda cmd: of_words(c, w, cmd))))


# -- policy and verdict --------------------------------------------------------------------------


def action_pattern(raw: str) -> str:
    text = raw.strip()
    while text.endswith(":*"):
        text = text[:-2]
    text = text.replace(":*)", "*)").replace("(./", "(").replace("(file://", "(").lower()
    return text.replace("\\", "/") if text.startswith(("read(", "write(")) else text


def action_text(action: Column) -> Column:
    """Actions in the form patterns are compared with."""
    text = F.regexp_replace(F.regexp_replace(action, r"\A\s+|\s+\z", ""), r"(?::\*)+\z", "")
    for old, new in ((":*)", "*)"), ("(./", "("), ("(file://", "(")):
        text = F.replace(text, F.lit(old), F.lit(new))
    lower = F.lower(text)
    return F.when(lower.rlike(r"\A(?:read|write)\("), F.replace(lower, F.lit("\\"), F.lit("/"))).otherwise(lower)


def listed(action: Column, patterns) -> Column:
    """Whether any allow or deny pattern covers an action (in ``action_text`` form), as one regex test."""
    return _any_wildcard(action, [action_pattern(p) for p in patterns])


def join_policy(actions: DataFrame, patterns: DataFrame, *, action: str = "action", kept: bool = True) -> DataFrame:
    """Actions that a table of patterns covers, or does not; both may be of any length."""
    form = patterns.select(action_text(F.col("pattern")).alias("form"))
    regex = F.concat(F.lit(r"\A(?s:\Q"), F.replace(F.col("form"), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E)\z"))
    table = form.select(regex.alias("re"), star_anchor(F.col("form")).alias("anchor"))
    formed = actions.withColumn("__text", action_text(F.col(action)))
    short = few(table.select("re").distinct())
    if short is not None:
        covered = any_regex(F.col("__text"), [r["re"] for r in short])
        return formed.where(covered if kept else ~covered).drop("__text")
    covered = matches(formed.select(F.col("__text").alias("text")), table, pattern="re", anchor="anchor")
    hit = covered.select(F.col("text").alias("__text")).distinct()
    return formed.join(hit, "__text", "left_semi" if kept else "left_anti").drop("__text")


def verdicts(events: DataFrame, policy: Policy = Policy(), payload: str = "payload") -> DataFrame:
    """Add the deciding ``category`` and ``action`` of each event; null when it may run.

    Paths come before commands, and an allow pattern wins over deny patterns and
    built-in checks.
    """
    profile = policy.guard_profile if policy.guard_profile in PROFILES else "recommended"
    rows = extract(events, payload)
    verb = F.when(F.col("access") == "write", "Write").otherwise("Read")
    named = policy.guard_allow or policy.guard_deny

    def verdict(action: Column, builtin: Column) -> Column:
        def decide(text: Column) -> Column:
            return F.when(listed(text, policy.guard_allow), None).when(listed(text, policy.guard_deny), CUSTOM).otherwise(
                builtin)

        decided = let(action_text(action), decide) if named else builtin
        return F.struct(decided.alias("category"), action.alias("action"))

    def of_path(p: Column) -> Column:
        action = F.concat(verb, F.lit("("), p, F.lit(")"))
        builtin = F.when(is_always_secret_path(p) | ((F.col("access") == "read") & is_secret_path(p)), SECRET_FILE)
        return verdict(action, builtin)

    def of_segment(s: Column) -> Column:
        return verdict(F.concat(F.lit("Bash("), s, F.lit(")")), category(s, profile))

    every = F.flatten(F.transform(F.col("commands"), segments))
    judged = F.concat(F.transform(F.col("paths"), of_path), F.transform(every, of_segment))
    # the outer explode keeps a later filter from being copied below the classification
    first = F.slice(F.filter(judged, lambda v: v["category"].isNotNull()), 1, 1)
    return rows.select(*events.columns, F.explode_outer(first).alias("__v")).select(
        *events.columns, F.col("__v.category").alias("category"), F.col("__v.action").alias("action"))
