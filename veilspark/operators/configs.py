"""Audits over tables of configuration files: agent servers, workflows, dotenv, ignores, packages."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..policy import Policy
from ..rules.table import rules_for
from . import detect

MAX_CONFIG_BYTES = 1 << 20
MAX_SERVERS = 1000
# -- agent server configurations -----------------------------------------------------------


def strip_jsonc(text: Column) -> Column:
    """Remove comments and trailing commas outside strings."""
    string = r'("(?:[^"\\]++|\\.)*+")'
    plain = F.regexp_replace(text, string + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1")
    return F.regexp_replace(plain, string + r"|,(?=\s*[}\]])", "$1")


def _toml_to_json():
    """Server tables of a TOML text as the JSON form; nothing in Spark reads TOML."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import json
        import tomllib

        def one(text):
            try:
                return json.dumps({"mcpServers": tomllib.loads(text).get("mcp_servers", {})}, default=str)
            except (tomllib.TOMLDecodeError, TypeError):
                return None

        return texts.map(one, na_action="ignore")

    return convert


def _text(server: Column, *names: str) -> Column:
    """The first of the fields that holds a string."""
    return F.coalesce(*[
        F.when(F.schema_of_variant(F.try_variant_get(server, f"$.{n}", "variant")) == "STRING", F.try_variant_get(server, f"$.{n}", "string"))
        for n in names
    ])


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _texts(server: Column, name: str) -> Column:
    """The strings of an array field; members of other types are skipped one by one."""
    members = F.filter(F.try_variant_get(server, f"$.{name}", "array<variant>"), _is_text)
    return F.transform(members, lambda v: F.try_variant_get(v, "$", "string"))


def _text_map(server: Column, *names: str) -> Column:
    """The string members of the first of the fields that holds an object."""
    found = F.coalesce(*[F.try_variant_get(server, f"$.{n}", "map<string,variant>") for n in names])
    return F.transform_values(F.map_filter(found, lambda _k, v: _is_text(v)), lambda _k, v: F.try_variant_get(v, "$", "string"))


def servers(configs: DataFrame, *, key: str = "mcpServers", toml: bool = False) -> DataFrame:
    """Configuration files to server rows: ``client, file, server, transport`` and its fields.

    Entries are read one by one: one that is no object is a server of unknown transport, and a field of a wrong
    type counts as absent, neither hides the rest of its file. Over-long, unreadable and over-full files give no
    rows; ``unreadable`` reports them.
    """
    entry = F.col("e.value")
    url = _text(entry, "url", "serverUrl")
    rows = _parsed(configs, key, toml).where(F.col("problem").isNull()).select(
        "client", "file", F.explode(F.map_entries("servers")).alias("e")
    )
    return rows.select(
        "client", "file", F.col("e.key").alias("server"),
        F.when(_text(entry, "command").isNotNull(), "stdio").when(url.isNotNull(), "http").otherwise("unknown").alias("transport"),
        _text(entry, "command").alias("command"), F.coalesce(_texts(entry, "args"), F.array().cast("array<string>")).alias("args"),
        _text_map(entry, "env").alias("env"), url.alias("url"), _text_map(entry, "headers", "http_headers").alias("headers"),
    )


def _parsed(configs: DataFrame, key: str, toml: bool) -> DataFrame:
    text = F.when(F.octet_length("text") <= MAX_CONFIG_BYTES, F.col("text"))
    body = _toml_to_json()(text) if toml else strip_jsonc(text)
    staged = configs.select("client", "file", F.octet_length("text").alias("bytes"), body.alias("json"))
    field = F.try_variant_get(F.try_parse_json("json"), f"$.{key}", "map<string,variant>")
    staged = staged.select("client", "file", "bytes", F.try_parse_json("json").isNotNull().alias("valid"), field.alias("servers"))
    problem = (
        F.when(F.col("bytes") > MAX_CONFIG_BYTES, "too_large").when(~F.col("valid"), "unparsable")
        .when(F.size("servers") > MAX_SERVERS, "too_many_servers")
    )
    return staged.select("client", "file", problem.alias("problem"), "servers")


def unreadable(configs: DataFrame, *, key: str = "mcpServers", toml: bool = False) -> DataFrame:
    return _parsed(configs, key, toml).where(F.col("problem").isNotNull()).select("client", "file", "problem")


def executable_name(command: Column) -> Column:
    base = F.lower(F.regexp_replace(F.trim(command), r"\A.*[/\\]", ""))
    return F.regexp_replace(base, r"\A(.+)\.(?:cmd|exe|bat|ps1)\z", "$1")


def _after(args: Column, test) -> Column:
    """Arguments behind the first one that passes a test, null when none does."""
    at = F.array_position(F.transform(args, test), True)
    return F.when(at > 0, F.slice(args, (at + 1).cast("int"), F.size(args)))


def _unwrap(name: Column, args: Column) -> Column:
    """Arguments a launcher starts, null when ``name`` is none."""
    ci = lambda *flags: lambda a: F.lower(a).isin(*flags)
    env_skip = F.aggregate(
        args, F.struct(F.lit(0).alias("n"), F.lit(False).alias("value"), F.lit(False).alias("done")),
        lambda acc, a: F.when(acc["done"], acc).otherwise(F.struct(
            (acc["n"] + F.when(acc["value"] | a.startswith("-") | F.contains(a, F.lit("=")), 1).otherwise(0)).alias("n"),
            (~acc["value"] & a.isin("-u", "--unset", "-C", "--chdir")).alias("value"),
            (~acc["value"] & ((a == "--") | ~(a.startswith("-") | F.contains(a, F.lit("="))))).alias("done"),
        )), lambda acc: acc["n"])
    line = (
        F.when(name == "cmd", _after(args, ci("/c", "/k")))
        .when(name.isin("sh", "bash", "zsh", "dash"), _after(args, lambda a: a == "-c"))
        .when(name.isin("powershell", "pwsh"), _after(args, ci("-c", "-command")))
    )
    words = let(line, lambda x: F.when(
        (F.size(x) == 1) & F.get(x, F.lit(0)).rlike(r"\s"),
        F.filter(F.split(F.get(x, F.lit(0)), r"\s+"), lambda w: w != "")).otherwise(x))
    return F.when(name == "env", F.slice(args, env_skip + 1, F.size(args))).otherwise(words)


def effective_invocation(command: Column, args: Column) -> Column:
    """The program really started once launchers are peeled off."""
    def step(acc: Column, _i: Column) -> Column:
        return let(_unwrap(acc["name"], acc["args"]), lambda inner: F.when(
            F.size(inner) > 0,
            F.struct(executable_name(F.get(inner, F.lit(0))).alias("name"),
                     F.slice(inner, F.lit(2), F.size(inner)).alias("args"))).otherwise(acc))

    start = F.struct(executable_name(command).alias("name"), args.alias("args"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step)


# --- fixed values: package runners: subcommand, package options, options with a value -----------
_NPX = ("-c --call -w --workspace --registry --cache --userconfig --globalconfig --prefix --loglevel --node-options "
        "--script-shell").split()
_BUN = "--cwd --config -c --registry".split()
_PNPM = "-C --dir --registry --filter --loglevel --reporter --store-dir --config".split()
_UV = (
    "-w --with --with-editable --with-requirements -c --constraints -b --build-constraints --overrides -p --python "
    "--python-platform --python-preference -i --index-url --extra-index-url --index --default-index -f --find-links "
    "--index-strategy --keyring-provider --resolution --prerelease --fork-strategy --exclude-newer -P "
    "--upgrade-package --refresh-package --reinstall-package --no-binary-package --no-build-package -C "
    "--config-setting --link-mode --env-file --cache-dir --config-file --directory --project --color "
    "--allow-insecure-host"
).split()
_PIPX = "--python --pip-args -i --index-url --backend --path".split()
RUNNERS = {
    "npx": ((), ("-p", "--package"), _NPX), "npm": (("exec", "x"), ("-p", "--package"), _NPX),
    "bunx": ((), ("-p", "--package"), _BUN), "bun": (("x",), ("-p", "--package"), _BUN),
    "pnpx": ((), ("--package",), _PNPM), "pnpm": (("dlx",), ("--package",), _PNPM),
    "yarn": (("dlx",), ("-p", "--package"), ["--cwd"]),
    "uvx": ((), ("--from",), _UV), "uv": (("tool run",), ("--from",), _UV), "pipx": (("run",), ("--spec",), _PIPX),
}


def _subcommand(args: Column, names) -> Column:
    out = None
    for name in names:
        parts = name.split()
        found = _after(args, lambda a: a == parts[0])
        if len(parts) > 1:
            found = F.when(F.get(found, F.lit(0)) == parts[1], F.slice(found, F.lit(2), F.size(found)))
        out = found if out is None else F.coalesce(out, found)
    return args if out is None else out


def _package(args: Column, package_options, value_options) -> Column:
    """The package a runner downloads: named by an option, else its first plain argument."""
    start = F.struct(F.lit("look").alias("state"), F.lit(None).cast("string").alias("package"))

    def step(acc: Column, a: Column) -> Column:
        state = lambda s, p=F.lit(None).cast("string"): F.struct(F.lit(s).alias("state"), p.alias("package"))
        out = F.when(acc["state"] == "done", acc).when(acc["state"] == "take", state("done", a)).when(
            acc["state"] == "skip", state("look"))
        out = out.when(a.isin(*package_options) | (a == "--"), state("take"))
        for option in package_options:
            out = out.when(a.startswith(option + "="), state("done", F.substring(a, len(option) + 2, 10**6)))
        if value_options:
            out = out.when(a.isin(*value_options), state("skip"))
        return out.when(a.startswith("-"), acc).otherwise(state("done", a))

    return F.aggregate(args, start, step, lambda acc: acc["package"])


def package_invocation(name: Column, args: Column) -> Column:
    out = None
    for runner, (subcommands, package_options, value_options) in RUNNERS.items():
        found = _package(_subcommand(args, subcommands), package_options, value_options)
        out = F.when(name == runner, found) if out is None else out.when(name == runner, found)
    return out


def exact_version(version: Column) -> Column:
    ident = r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
    return version.rlike(rf"\A[0-9]+\.[0-9]+\.[0-9]+(?:-{ident})?(?:\+{ident})?\z")


def is_pinned(package: Column) -> Column:
    version = F.when(F.contains(package, F.lit("==")), F.substring_index(package, "==", -1)).when(
        F.contains(package, F.lit("@")), F.substring_index(package, "@", -1))
    return F.coalesce(exact_version(version), F.lit(False))


def is_reference(value: Column) -> Column:
    v = F.trim(value)
    return v.rlike(
        r"\A(?:\$\{(?:env:)?[A-Za-z_][0-9A-Za-z_]*\}|\$\{input:[0-9A-Za-z_][0-9A-Za-z_.-]*\}|\$[A-Za-z_][0-9A-Za-z_]*)\z")


def insecure_http(url: Column) -> Column:
    authority = F.regexp_extract(url, r"(?i)\Ahttp://([^/?#]*)", 1)
    host_port = F.substring_index(authority, "@", -1)
    host = F.when(host_port.startswith("["), F.regexp_extract(host_port, r"\A\[([^\]]*)", 1)).otherwise(
        F.substring_index(host_port, ":", 1))
    host = F.lower(F.regexp_replace(host, r"\.+\z", ""))
    return url.rlike(r"(?i)\Ahttp://") & ~host.isin("localhost", "127.0.0.1", "::1")


# --- fixed values --------------------------------------------------------------------------------
URL_KEYS = "access_token api-key api_key apikey auth authorization key password secret token".split()
SYSTEM_FOLDERS = ("/bin", "/usr/bin", "/usr/local/bin", "/opt/homebrew/bin")
SHELLS = ("sh", "bash", "zsh", "cmd", "powershell", "pwsh")


def sensitive_url_key(url: Column) -> Column:
    query = F.regexp_extract(url, r"\A[^?]*\?([^#]*)", 1)
    decoded = lambda k: F.coalesce(F.call_function("try_url_decode", F.replace(k, F.lit("+"), F.lit("%2B"))), k)
    keys = F.transform(F.split(query, "&"), lambda p: F.lower(
        F.regexp_replace(decoded(F.substring_index(p, "=", 1)), r"(?:\[\])+\z", "")))
    return F.contains(url, F.lit("?")) & F.exists(keys, lambda k: k.isin(*URL_KEYS))


def within(path: Column, folder: str) -> Column:
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def local_executable(command: Column, root: str = "/workspace") -> Column:
    system = within(command, root)
    for folder in SYSTEM_FOLDERS:
        system = system | within(command, folder)
    return F.when(command.startswith("/"), ~system).otherwise(command.rlike(r"[/\\]"))


def filesystem_server(server: Column, command: Column, args: Column) -> Column:
    named = lambda v: (F.lower(v) == "filesystem") | F.lower(v).rlike("server-filesystem|filesystem-server")
    return F.exists(F.concat(F.array(server, command), args), named)


def exposes_home(value: Column, home: str | None = None) -> Column:
    out = F.trim(value).rlike(r"\A(?:~|\$HOME|\$\{HOME\})(?:/|\z)")
    return out | within(F.trim(value), home) if home else out


def server_findings(rows: DataFrame, *, root: str = "/workspace", home: str | None = None) -> DataFrame:
    """Findings about server rows: launch, scope and transport checks."""
    stdio, http = F.col("transport") == "stdio", F.col("transport") == "http"
    runner, args = F.col("__run.name"), F.col("__run.args")
    npx_args = F.when(runner == "npx", args).when(runner == "npm", _subcommand(args, ("exec", "x")))
    before_dashes = F.when(
        F.array_position(npx_args, "--") > 0, F.slice(npx_args, F.lit(1), (F.array_position(npx_args, "--") - 1).cast("int"))
    ).otherwise(npx_args)
    auto = F.coalesce(F.exists(before_dashes, lambda a: a.isin("-y", "--yes")), F.lit(False))
    package = F.col("__package")
    shell = executable_name(F.col("command")).isin(*SHELLS) & F.exists("args", lambda a: F.lower(a).isin("/c") | (a == "-c"))
    fs = filesystem_server(F.col("server"), F.col("command"), F.col("args"))
    whole = F.exists("args", lambda a: F.trim(a) == "/")
    homes = F.exists("args", lambda a: exposes_home(a, home))
    checks = (
        ("mcp.npx_auto_install", "medium", 0.95, stdio & auto),
        ("mcp.unpinned_package", "medium", 0.9, stdio & package.isNotNull() & ~is_pinned(package)),
        ("mcp.shell_wrapper", "medium", 0.9, stdio & shell),
        ("mcp.local_unpinned_executable", "low", 0.75, stdio & local_executable(F.col("command"), root)),
        ("mcp.broad_filesystem_scope", "high", 1.0, stdio & fs & whole),
        ("mcp.broad_filesystem_scope", "medium", 0.95, stdio & fs & ~whole & homes),
        ("mcp.http_no_tls", "high", 1.0, http & insecure_http(F.col("url"))),
        ("mcp.secret_in_url", "high", 0.9, http & sensitive_url_key(F.col("url"))),
        ("mcp.unknown_transport", "info", 0.8, F.col("transport") == "unknown"),
    )
    staged = rows.withColumn("__run", effective_invocation(F.col("command"), F.col("args")))
    staged = staged.withColumn("__package", package_invocation(runner, args))
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
        for rule, severity, confidence, test in checks)))
    return staged.select("client", "file", "server", F.explode(found).alias("f")).select(
        "client", "file", "server", "f.rule_id", "f.severity", "f.confidence")


def literals(rows: DataFrame) -> DataFrame:
    """Literal values of a server that are not references, joined per field."""
    values = lambda m: F.coalesce(F.map_values(m), F.array().cast("array<string>"))
    fields = F.array(*(F.struct(F.lit(name).alias("field"), v.alias("values")) for name, v in (
        ("env", values("env")), ("args", F.col("args")),
        ("url", F.when(F.col("url").isNotNull(), F.array("url")).otherwise(F.array().cast("array<string>"))),
        ("headers", values("headers")))))
    each = rows.select("client", "file", "server", F.explode(fields).alias("x"))
    plain = F.filter("x.values", lambda v: v.isNotNull() & ~is_reference(v))
    return each.select("client", "file", "server", "x.field", F.array_join(plain, "\n\n").alias("text")).where("text <> ''")


def secret_literals(rows: DataFrame, policy: Policy = Policy(), rules=None) -> DataFrame:
    """Plaintext secrets in server definitions."""
    rules = [r for r in (rules or rules_for(policy)) if r.kind == "secret"]
    found = detect.hits(literals(rows), policy, path=F.col("file"), carry=["client", "server", "field"], rules=rules)
    return found.select("client", F.col("file"), "server", "field", "rule_id", F.explode_outer("matches").alias("m")).where(
        "m IS NOT NULL").select("client", "file", "server", "field", "rule_id").distinct()


# -- workflows ---------------------------------------------------------------------------------


def step_blocks(files: DataFrame, by: str = "file", text: str = "text") -> DataFrame:
    """Lines of YAML files with the number of the list item they belong to, 0 outside.

    An item lasts until a line at or left of its dash; nested items are part of
    it. The fold runs over the lines of one file inside its row.
    """
    def step(acc: Column, line: Column) -> Column:
        indent = F.length(F.regexp_extract(line, r"\A *", 0))
        item = line.rlike(r"\A *-(?: |\z)")
        inside = line.rlike(r"\A\s*(?:#.*)?\z") | ((acc["open"] >= 0) & (indent > acc["open"]))
        opened = F.when(inside, acc["open"]).when(item, indent).otherwise(F.lit(-1))
        number = F.when(~inside & item, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(
            opened.alias("open"), number.alias("n"),
            F.concat(acc["out"], F.array(F.when(opened >= 0, number).otherwise(F.lit(0)))).alias("out"),
        )

    start = F.struct(F.lit(-1).alias("open"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    lines = F.split(F.col(text), r"\r?\n", -1)
    numbered = let(lines, lambda ls: let(
        F.aggregate(ls, start, step, lambda acc: acc["out"]),
        lambda ns: F.transform(ls, lambda x, i: F.struct(x.alias("text"), F.get(ns, i).alias("step")))))
    return files.select(by, F.posexplode(numbered).alias("pos", "z")).select(
        by, (F.col("pos") + 1).alias("line"), "z.text", "z.step")


def _scalar(text: Column, key: str) -> Column:
    """Value of ``key:`` on a step line, comment and quotes removed; null when the line is another."""
    raw = F.regexp_extract(text, rf"\A\s*(?:-\s+)?{key}:(.*)\z", 1)
    bare = F.regexp_replace(F.regexp_replace(raw, r"\s#.*\z", ""), r"\A\s+|\s+\z", "")
    value = F.regexp_replace(bare, r"""\A["']+|["']+\z""", "")
    return F.when(text.rlike(rf"\A\s*(?:-\s+)?{key}:"), value)


def checkout_steps(files: DataFrame, by: str = "file", text: str = "text") -> DataFrame:
    """Checkout steps and whether they keep credentials: ``missing``, ``enabled`` or ``disabled``."""
    rows = step_blocks(files, by, text).where("step > 0")
    text, order = "text", "line"
    uses = F.lower(_scalar(F.col(text), "uses"))
    checkout = (uses == "actions/checkout") | uses.startswith("actions/checkout@")
    plain = F.when(F.col(text).rlike(r"\A\s*persist-credentials:"), _scalar(F.col(text), "persist-credentials"))
    flow = F.regexp_extract(text, r"""\A\s*(?:-\s+)?with:\s*\{.*?["']?persist-credentials["']?\s*:\s*["']?([^,}"'\s]+)""", 1)
    state = F.coalesce(plain, F.when(flow != "", flow))
    steps = rows.groupBy(by, "step").agg(
        F.min(F.when(checkout, F.col(order))).alias("line"),
        F.min_by(state, F.when(state.isNotNull(), F.col(order))).alias("value"),
    ).where(F.col("line").isNotNull())
    return steps.select(by, "line", F.when(F.col("value").isNull(), "missing").when(F.col("value") == "false", "disabled")
                        .otherwise("enabled").alias("state"))


# -- dotenv ---------------------------------------------------------------------------------------

# --- fixed values --------------------------------------------------------------------------------
PUBLIC_KEY, PRIVATE_KEY, ENCRYPTED = "DOTENV_PUBLIC_KEY", "DOTENV_PRIVATE_KEY", "encrypted:"


def dotenv_line(raw: Column) -> Column:
    """Struct of a dotenv line: ``what`` (skip, malformed, entry) and, for entries, key and flags."""
    line = F.regexp_replace(F.regexp_replace(raw, r"\A\s+|\s+\z", ""), r"\Aexport \s*", "")
    key = F.trim(F.substring_index(line, "=", 1))
    value = F.regexp_replace(F.regexp_replace(line, r"\A[^=]*=", ""), r"\A\s+|\s+\z", "")
    named = lambda p: key.rlike(rf"\A{p}(?:_[A-Z0-9_]+)?\z")
    quoted = value.rlike(r"""\A["']""")
    good = value.rlike(r"""\A(?:"[^"]*"|'[^']*')\s*(?:#.*)?\z""")
    inner = F.when(quoted, F.regexp_extract(value, r"""\A["']([^"']*)""", 1)).otherwise(F.substring_index(value, " #", 1))
    what = (
        F.when(line.rlike(r"\A(?:#|\z)"), "skip").when(~F.contains(line, F.lit("=")) | (key == ""), "malformed")
        .when(named(PUBLIC_KEY), "skip").otherwise("entry")
    )
    return F.struct(
        what.alias("what"), key.alias("key"), (quoted & ~good).alias("bad_quotes"), named(PRIVATE_KEY).alias("private"),
        (~(quoted & ~good) & inner.startswith(ENCRYPTED)).alias("encrypted"),
    )


def env_file_state(lines: DataFrame, by: str = "file", order: str = "line", text: str = "text") -> DataFrame:
    """Per dotenv file: encrypted, mixed or plaintext, and the names of plaintext keys."""
    rows = lines.select(by, order, dotenv_line(F.col(text)).alias("d")).select(by, order, "d.*")
    entry = F.col("what") == "entry"
    hidden = entry & F.col("encrypted") & ~F.col("private")
    broken = (F.col("what") == "malformed") | (entry & (F.col("private") | F.col("bad_quotes")))
    per = rows.groupBy(by).agg(
        F.bool_or(broken).alias("broken"), F.bool_or(entry & F.col("encrypted")).alias("some"),
        F.bool_or(entry & ~F.col("encrypted")).alias("open"), F.count_if(hidden).alias("encrypted_keys"),
        F.transform(F.array_sort(F.collect_list(F.when(entry & ~hidden, F.struct(order, "key")))), lambda x: x["key"])
        .alias("plaintext_keys"),
    )
    state = F.when(F.col("broken") | ~F.col("some"), "plaintext").when(F.col("open"), "mixed").otherwise("encrypted")
    return per.select(by, state.alias("state"), "plaintext_keys", "encrypted_keys")


# -- ignore files ---------------------------------------------------------------------------------


def missing_patterns(required: DataFrame, lines: DataFrame, by: str = "project") -> DataFrame:
    """Required ignore patterns that no line of a project's ignore files covers.

    Each present line is spelled as the keys it covers, so coverage is an
    equality join instead of a comparison of all pairs.
    """
    bare = F.regexp_replace(F.trim("text"), r"/+\z", "")
    present = lines.where(~F.trim("text").rlike(r"\A(?:#|\z)")).select(by, F.explode(F.array_compact(F.array(
        bare, F.concat(bare, F.lit("/**")),
        F.when(F.trim("text") == ".env*", F.lit(".env")), F.when(F.trim("text") == ".env*", F.lit(".env.*")),
    ))).alias("covers")).distinct()
    want = required.withColumn("covers", F.regexp_replace(F.trim("pattern"), r"/+\z", ""))
    return want.join(present, [by, "covers"], "left_anti").select(by, "pattern")


# -- package manager settings -----------------------------------------------------------------------

# --- fixed values: names and units of package-age settings -------------------------------
MIN_AGE_DAYS = 7
UNIT_SECONDS = {
    86400.0: ("", "d", "day", "days"), 0.001: ("ms", "msec", "msecs", "millisecond", "milliseconds"),
    1.0: ("s", "sec", "secs", "second", "seconds"), 60.0: ("m", "min", "mins", "minute", "minutes"),
    3600.0: ("h", "hr", "hrs", "hour", "hours"), 604800.0: ("w", "wk", "wks", "week", "weeks"),
    2592000.0: ("mo", "month", "months"), 31536000.0: ("y", "yr", "yrs", "year", "years"),
}
# qualified setting name and its unit in days, per file type
AGE_SETTINGS = {
    "npmrc": ("min-release-age", 1.0), "pnpm": ("minimumReleaseAge", 1 / 1440), "yarn": ("npmMinimalAgeGate", 1 / 1440),
    "bun": ("install.minimumReleaseAge", 1 / 86400),
}
YAML_KINDS, TOML_KINDS = ("pnpm", "yarn"), ("bun",)


def duration_days(value: Column) -> Column:
    """Whole days of ``2 weeks``, ``36 hours`` or ``7``; null for other text."""
    bare = F.trim(F.regexp_replace(F.trim(value), r"""\A["']+|["']+\z""", ""))
    number = F.expr("CAST(NULL AS DOUBLE)")
    digits = F.regexp_extract(bare, r"\A([0-9.]*)", 1)
    unit = F.lower(F.trim(F.regexp_replace(bare, r"\A[0-9.]*", "")))
    number = F.when(digits.rlike(r"\A(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), digits.cast("double"))
    out = None
    for seconds, names in UNIT_SECONDS.items():
        days = F.floor(number * seconds / 86400.0).cast("long")
        out = F.when(unit.isin(*names), days) if out is None else out.when(unit.isin(*names), days)
    return out


def last_settings(lines: DataFrame, by: list[str], order: str = "line", text: str = "text", separator: str = "=") -> DataFrame:
    """Settings of key/value files; the last assignment of a key wins."""
    line = F.trim(text)
    rows = lines.where(~line.rlike(r"\A(?:[#;]|\z)") & F.contains(line, F.lit(separator))).select(
        *by, order, F.trim(F.substring_index(line, separator, 1)).alias("key"),
        F.trim(F.substring_index(F.substring(line, F.instr(line, separator) + len(separator), F.length(line)), "#", 1)).alias("value"))
    return rows.groupBy(*by, "key").agg(F.max_by("value", order).alias("value"))


def qualified_settings(lines: DataFrame, by: list[str], kind: str = "kind", order: str = "line", text: str = "text") -> DataFrame:
    """Settings of package-manager files in their own syntax, ``by``, kind, key and value; the last of a key wins.

    ``npmrc`` has keys alone. In YAML a key below another is written behind the top-level key that it is under, with two
    dots, as what lies between is not asked for; in TOML a key is behind its table, with one. Values lose comments and quotes.
    """
    yaml, toml = F.col(kind).isin(*YAML_KINDS), F.col(kind).isin(*TOML_KINDS)
    line = F.trim(text)
    before = Window.partitionBy(*by, kind).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    table = F.when(toml & line.rlike(r"\A\[[^\[\]]+\]\s*(?:#.*)?\z"), F.trim(F.regexp_extract(line, r"\A\[([^\[\]]+)\]", 1)))
    head = F.when(yaml, F.substring_index(line, ":", 1)).otherwise(F.substring_index(line, "=", 1))
    shaped = ~line.rlike(r"\A(?:[#;\[]|\z)") & (F.length(head) < F.length(line))
    bare = F.regexp_replace(F.trim(head), r"""\A["']|["']\z""", "")
    rest = F.trim(F.substring_index(F.substring(line, F.length(head) + 2, F.length(line)), "#", 1))
    indented = F.col(text).rlike(r"\A[ \t]")
    top = F.when(yaml & shaped & ~indented, bare)
    rows = lines.select(
        *by, kind, order, shaped.alias("shaped"), bare.alias("bare"), F.regexp_replace(rest, r"""\A["']|["']\z""", "").alias("value"),
        F.when(yaml & indented, F.concat(F.last(top, ignorenulls=True).over(before), F.lit(".."))).when(
            toml, F.concat(F.last(table, ignorenulls=True).over(before), F.lit("."))).alias("under"),
    ).where("shaped")
    return rows.groupBy(*by, kind, F.concat(F.coalesce("under", F.lit("")), "bare").alias("key")).agg(F.max_by("value", order).alias("value"))


def age_gate(settings: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    """Whether packages must reach a minimum age before they are installed, and scripts are off."""
    number = F.when(F.col("value").rlike(r"\A[0-9]+\z"), F.col("value").cast("double"))
    days = None
    for name, (key, unit) in AGE_SETTINGS.items():
        test = (F.col(kind) == name) & (F.col("key") == key)
        days = F.when(test, number * unit) if days is None else days.when(test, number * unit)
    rows = settings.groupBy(*by).agg(
        F.max(days).alias("age_days"),
        F.coalesce(F.bool_or((F.col("key") == "ignore-scripts") & (F.col("value") == "true")), F.lit(False)).alias("ignore_scripts_ok"),
    )
    return rows.select(*by, "age_days", F.coalesce(F.col("age_days") >= MIN_AGE_DAYS, F.lit(False)).alias("age_ok"), "ignore_scripts_ok")


# --- fixed values: keys of a dependency bot's cooldown ------------------------------------
COOLDOWN_KEYS = ("default-days", "semver-major-days", "semver-minor-days", "semver-patch-days")


def cooldown(lines: DataFrame, by: str = "file", order: str = "line", text: str = "text") -> DataFrame:
    """Cooldown days of a dependency bot's npm blocks: the smallest over blocks and keys."""
    line = F.trim(text)
    eco = F.regexp_extract(line, r"""\A(?:- )*\s*package-ecosystem\s*:\s*["']?([^"'#\s]*)""", 1)
    w = Window.partitionBy(by).orderBy(order)
    rows = lines.withColumn("__eco", F.when(eco != "", eco))
    rows = rows.withColumn("block", F.sum(F.when(F.col("__eco").isNotNull(), 1).otherwise(0)).over(w))
    rows = rows.withColumn("__kind", F.first("__eco", True).over(Window.partitionBy(by, "block").orderBy(order)))
    value = F.regexp_extract(line, rf"""\A({'|'.join(COOLDOWN_KEYS)})\s*:\s*["']?([0-9]+)""", 2)
    blocks = rows.where(F.col("__kind") == "npm").groupBy(by, "block").agg(
        F.bool_or(line == "cooldown:").alias("has"), F.min(F.when(value != "", value.cast("long"))).alias("days"))
    return blocks.groupBy(by).agg(F.min(F.when(F.col("has"), F.col("days"))).alias("days")).select(
        by, F.lit(True).alias("configured"), "days", F.coalesce(F.col("days") >= MIN_AGE_DAYS, F.lit(False)).alias("cooldown_ok"))


def config_paths(paths: DataFrame) -> DataFrame:
    """Candidate configuration files, each once, in order."""
    return paths.distinct().orderBy("file")


