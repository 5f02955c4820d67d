"""Queries for the command guard over tool events derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guard
from ..policy import Policy
from .kit import REGISTRY, derived, for_oracle
from .samples import quote

# command lines and, for each, the category a person would expect (recommended profile)
COMMANDS = [
    ("ls -la src", None), ("cat .env", "secret_dump_command"), ("head -n 3 config/.env.production", "secret_dump_command"),
    ("cat .env.example", None), ("cat ./api-token.txt", "secret_dump_command"), ("rm -rf /", "destructive_filesystem"),
    ("rm -r -f ~/", "destructive_filesystem"), ("rm -rf build", None), ("rm -rf ../..", "destructive_filesystem"),
    ("printenv", "environment_dump"), ("env | sort", "environment_dump"), ("env FOO=1 make", None),
    ("export -p", "environment_dump"), ("sudo reboot", "privilege_system_change"), ("chmod 777 run.sh", "privilege_system_change"),
    ("chmod a+rwx x", "privilege_system_change"), ("chmod 644 x", None), ("curl https://x.test", "external_transfer"),
    ("brew install jq", "system_install"), ("/usr/bin/psql -c drop", "direct_db_mutation"), ("psql -c select", None),
    ("python3 -c 'print os.environ'", "environment_dump"), ("git add .env", None), ("git show HEAD:.env", "secret_dump_command"),
    ("paste .env.local", "secret_dump_command"), ("grep x < secrets/key.pem", "secret_dump_command"),
    ("tail ~/.zsh_history", "secret_dump_command"), ("node -e 1", None), ("declare -x", "environment_dump"), ("echo done", None),
    ("dotenvx get API_KEY", "secret_dump_command"), ("dotenvx run -- make", None),
]
N = len(COMMANDS)


def _pick(i: str, values) -> str:
    return "CASE " + i + " " + " ".join(
        f"WHEN {k} THEN {quote(v) if v is not None else 'NULL'}" for k, v in enumerate(values)) + " END"


CMD = _pick(f"o_orderkey % {N}", [c for c, _ in COMMANDS])
EVENTS = f"SELECT o_orderkey AS event_id, o_orderpriority AS tool, {CMD} AS command FROM {{orders}}"
EXPECTED = _pick(f"o_orderkey % {N}", [x for _, x in COMMANDS])

PAYLOADS = f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{{"tool_input":{{"command":"', command, ' && echo ', cast(event_id as string), '"}}}}')
WHEN 1 THEN concat('{{"a":{{"b":[{{"c":{{"command":"', command, '"}}}}]}},"args":["x","y"]}}') WHEN 2 THEN concat('{{"tool_name":"Read","tool_input":{{"edits":[{{"n":1}},{{"file_path":"src/u', cast(event_id as string), '/',
CASE event_id % 3 WHEN 0 THEN '.env' WHEN 1 THEN 'main.py' ELSE 'tokens/a.json' END, '"}}]}}}}') ELSE 'not json' END AS payload
FROM ({EVENTS})"""


def events(spark, sf_dir):
    return derived(spark, sf_dir, EVENTS)


def _one(key: str, categories, profile: str = "recommended") -> None:
    wanted = ", ".join(f"'{c}'" for c in categories)

    def run(spark, sf_dir):
        found = events(spark, sf_dir).select("event_id", guard.category(F.col("command"), profile).alias("category"))
        return found.where(F.col("category").isin(*categories))

    REGISTRY.put(key, run, f"SELECT event_id, category FROM (SELECT o_orderkey AS event_id, {EXPECTED} AS category FROM orders) WHERE category IN ({wanted})")


_one("grd_secret_dump", ["secret_dump_command"])
_one("grd_env_dump", ["environment_dump"])
_one("grd_destructive_rm", ["destructive_filesystem"])
_one("grd_privilege", ["privilege_system_change"])
_one("grd_transfer", ["external_transfer"])
_one("grd_install", ["system_install"])
_one("grd_db_mutation", ["direct_db_mutation"])


@REGISTRY.add("grd_opaque", f"SELECT o_orderkey AS event_id, 'opaque_execution' AS category FROM orders WHERE o_orderkey % {N} = 27")
def grd_opaque(spark, sf_dir):
    found = events(spark, sf_dir).select("event_id", guard.category(F.col("command"), "strict").alias("category"))
    return found.where(F.col("category") == "opaque_execution")


@REGISTRY.add("grd_profile", f"""WITH e AS (SELECT {EXPECTED} AS category FROM orders)
SELECT 'minimal' AS profile, category, count(*) AS n FROM e WHERE category IN ('secret_dump_command', 'environment_dump', 'destructive_filesystem', 'direct_db_mutation') GROUP BY category
UNION ALL SELECT 'recommended', category, count(*) FROM e WHERE category IS NOT NULL GROUP BY category""")
def grd_profile(spark, sf_dir):
    def count(profile):
        found = events(spark, sf_dir).select(guard.category(F.col("command"), profile).alias("category"))
        counts = found.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        return counts.select(F.lit(profile).alias("profile"), "category", "n")

    return count("minimal").unionByName(count("recommended"))


@REGISTRY.add("grd_extract", f"""WITH p AS ({for_oracle(PAYLOADS)}) SELECT event_id,
CASE event_id % 4 WHEN 0 THEN json_extract_string(payload, '$.tool_input.command') WHEN 1 THEN array_to_string(list_sort([json_extract_string(payload, '$.a.b[0].c.command'), 'x y', 'x', 'y']), '|') ELSE '' END AS commands,
CASE event_id % 4 WHEN 2 THEN json_extract_string(payload, '$.tool_input.edits[1].file_path') ELSE '' END AS paths
FROM p WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, '', '' FROM p WHERE event_id % 4 = 3""")
def grd_extract(spark, sf_dir):
    rows = guard.extract(derived(spark, sf_dir, PAYLOADS))
    return rows.select("event_id", F.array_join("commands", "|").alias("commands"), F.array_join("paths", "|").alias("paths"))


_LINES = f"SELECT event_id, concat(command, ' && a -b; c | d', chr(10), '(e)') AS line FROM ({EVENTS})"


@REGISTRY.add("grd_segments", f"""SELECT event_id, unnest(list_filter([trim(s) for s in string_split_regex(line, '[;|&()' || chr(10) || ']')], lambda x: x <> '')) AS segment
FROM ({for_oracle(_LINES)})""")
def grd_segments(spark, sf_dir):
    return derived(spark, sf_dir, _LINES).select("event_id", F.explode(guard.segments(F.col("line"))).alias("segment"))


@REGISTRY.add("grd_words", f"""WITH e AS (SELECT event_id, list_filter(string_split_regex(lower(command), '[[:space:]{chr(34)}''`;|&(),=]'), lambda x: x <> '') AS w FROM ({for_oracle(EVENTS)}))
SELECT event_id, array_to_string(w, '|') AS words, split_part(w[1], '/', -1) AS base FROM e""")
def grd_words(spark, sf_dir):
    w = guard.words(guard.normalized(F.col("command")))
    return events(spark, sf_dir).select(
        "event_id", F.array_join(w, "|").alias("words"), guard.base_command(F.get(w, F.lit(0))).alias("base"))


PATHS = [
    (".env", 1), ("./.env.local", 1), (".env.example", 0), ("a/.env.sample", 0), ("src/main.rs", 0), ("config/api_key.txt", 1),
    ("credentials.json", 1), ("token_parser.rs", 0), ("x/tokens/a.json", 1), ("~/.bash_history", 1), ("docs/readme.md", 0),
    ("file://x/secret/y", 1), (".env.d/.env.example", 1), ("server.key", 1), ("keyboard.rs", 0),
]
_PATH = _pick(f"p_partkey % {len(PATHS)}", [p for p, _ in PATHS])


@REGISTRY.add("grd_secret_path", f"SELECT p_partkey AS id, {_PATH} AS path, " + _pick(f"p_partkey % {len(PATHS)}", [str(x) for _, x in PATHS]) + " = '1' AS secret FROM part")
def grd_secret_path(spark, sf_dir):
    rows = derived(spark, sf_dir, f"SELECT p_partkey AS id, {_PATH} AS path FROM {{part}}")
    return rows.select("id", "path", guard.is_secret_path(F.col("path")).alias("secret"))


@REGISTRY.add("fn_wildcard_match", "SELECT p_partkey AS id, p_name LIKE 'red%' AS prefix, p_name LIKE '%r%ng%' AS parts, p_name = 'red widget' AS exact FROM part")
def fn_wildcard_match(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT p_partkey AS id, p_name FROM {part}")
    match = lambda p: guard.wildcard_match(p, F.col("p_name"))
    return rows.select("id", match("red*").alias("prefix"), match("*r*ng*").alias("parts"), match("red widget").alias("exact"))


ALLOW, DENY = ("Bash(curl https://x.test*)", "Bash(sudo:*)"), ("Bash(ls *)", "Bash(curl*)")
POLICY = Policy(guard_allow=ALLOW, guard_deny=DENY)
_COMMAND_PAYLOAD = f"""SELECT event_id, command, concat('{{"command":"', command, '"}}') AS payload FROM ({EVENTS})"""


@REGISTRY.add("grd_policy", f"""SELECT event_id, category FROM (SELECT o_orderkey AS event_id, CASE WHEN {CMD} IN ('curl https://x.test', 'sudo reboot') THEN NULL
WHEN {CMD} LIKE 'ls %' THEN 'custom_policy' ELSE {EXPECTED} END AS category FROM orders) WHERE category IS NOT NULL""")
def grd_policy(spark, sf_dir):
    found = guard.verdicts(derived(spark, sf_dir, _COMMAND_PAYLOAD), POLICY)
    return found.where("category IS NOT NULL").select("event_id", "category")


@REGISTRY.add("join_guard_policy", f"SELECT event_id FROM ({for_oracle(EVENTS)}) WHERE command LIKE 'ls %' OR command LIKE 'curl%'")
def join_guard_policy(spark, sf_dir):
    actions = events(spark, sf_dir).select("event_id", F.concat(F.lit("Bash("), "command", F.lit(")")).alias("action"))
    patterns = spark.createDataFrame([(p,) for p in DENY], "pattern string")
    return guard.join_policy(actions, patterns).select("event_id")


@REGISTRY.add("grd_first_category", f"""WITH p AS (SELECT o_orderkey AS event_id, {EXPECTED} AS category FROM orders)
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN category WHEN event_id % 3 <> 1 THEN 'secret_file_access' END AS category FROM p WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, NULL FROM p WHERE event_id % 4 = 3""")
def grd_first_category(spark, sf_dir):
    return guard.verdicts(derived(spark, sf_dir, PAYLOADS)).select("event_id", "category")


_TOOL = """SELECT event_id, concat('{"tool":"', event_type, '","prompt":"ask ', cast(user_id as string), '","tool_input":{"content":"body ', cast(event_id as string), '","other":"no"},"args":["a","b"]}') AS payload FROM {events}"""


@REGISTRY.add("src_tool_payloads", f"""SELECT event_id, concat('a', chr(10), 'b', chr(10), json_extract_string(payload, '$.prompt'), chr(10), json_extract_string(payload, '$.tool_input.content')) AS text FROM ({for_oracle(_TOOL)})""")
def src_tool_payloads(spark, sf_dir):
    return derived(spark, sf_dir, _TOOL).select("event_id", guard.payload_text(F.col("payload")).alias("text"))
