"""Path and command rules over page addresses and a command list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logferry.functions import commands as C
from logferry.functions import paths as P
from logferry.functions import text as T
from logferry.functions import values as V
from logferry.operators import bundles, files

from . import sqltext as X
from .lifts import COMMANDS, LIFTED_PATHS, SUFFIX, URL_PATH
from .registry import Tables, query

HOME, ROOT = "/en", "/en"


def lifted(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.expr(f"{URL_PATH} || {SUFFIX}").alias("path"))


# --- SQL spellings ---------------------------------------------------------------------------

q, one_of = X.quote, X.one_of


def sql_normalise(p: str) -> str:
    """Resolve . and .. : drop '.', then fold with a list that loses its last item at '..'."""
    parts = f"list_filter(string_split({p}, '/'), lambda x: x NOT IN ('', '.'))"
    fold = (
        f"list_reduce(list_transform({parts}, lambda x: [x]), lambda a, x: "
        "CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, x) END, CAST([] AS VARCHAR[]))"
    )
    return f"(CASE WHEN starts_with({p}, '/') THEN '/' ELSE '' END || coalesce(array_to_string({fold}, '/'), ''))"


def sql_parts(p: str) -> str:
    return f"list_filter(string_split(lower({p}), '/'), lambda x: x NOT IN ('', '.'))"


def sql_under(p: str, d: str) -> str:
    key = lambda x: rf"replace(lower({x}), '\', '/')"
    return f"({key(p)} = {key(d)} OR starts_with({key(p)}, rtrim({key(d)}, '/') || '/'))"


def sql_credential(p: str) -> str:
    parts = sql_parts(p)
    name = f"coalesce({parts}[-1], '')"
    ext = f"CASE WHEN contains({name}, '.') THEN string_split({name}, '.')[-1] ELSE '' END"
    return (
        f"CASE WHEN len(list_intersect({parts}, [{', '.join(map(q, V.DENIED_DIRS))}])) > 0 THEN 'credential directory' "
        f"WHEN {ext} = 'env' OR (starts_with({name}, '.env') AND {ext} NOT IN {one_of(V.EXAMPLE_EXTENSIONS)}) THEN 'environment file' "
        f"WHEN regexp_matches({name}, '^{X.alternatives(V.SSH_KEY_NAMES)}') THEN 'SSH key' "
        f"WHEN ends_with({name}, '_history') OR ends_with({name}, '.tfstate.backup') THEN 'history or state file' "
        f"WHEN {name} IN {one_of(V.DENIED_NAMES)} OR {ext} IN {one_of(V.DENIED_EXTENSIONS)} THEN 'key, credential or database file' END"
    )


def sql_config(p: str) -> str:
    ps = sql_parts(p)
    one = (
        f"CASE WHEN {ps}[i] = '.claude' AND coalesce({ps}[i + 1], '') <> 'skills' THEN 'agent settings (hooks, permissions)' "
        f"WHEN {ps}[i] = '.git' THEN 'git internals (hooks run code)' "
        f"WHEN {ps}[i] = {q(V.RECORDS_DIR)} THEN {q(V.TOOL + chr(39) + 's own records')} "
        f"WHEN {ps}[i] IN {one_of(V.EDITOR_DIRS)} THEN 'editor or git-hook config that runs code' "
        f"WHEN {ps}[i] IN {one_of(V.AGENT_DIRS)} OR starts_with({ps}[i], '.aider.') THEN 'agent settings (tools, permissions)' END"
    )
    hits = f"list_filter(list_transform(range(1, len({ps}) + 1), lambda i: {one}), lambda r: r IS NOT NULL)"
    last = f"CASE WHEN {ps}[-1] IN {one_of(V.EXECUTABLE_CONFIG)} THEN 'config that runs code on open' END"
    return f"coalesce({hits}[1], {last})"


def sql_personal(p: str, home: str) -> str:
    inside = f"CASE WHEN starts_with({p}, {home} || '/') THEN substr({p}, length({home}) + 2) END"
    return f"CASE WHEN {sql_parts(inside)}[1] IN {one_of(V.PERSONAL_FOLDERS)} THEN 'personal folder in the home directory' END"


def sql_off_limits(p: str, root: str, home: str) -> str:
    return (
        f"coalesce('sensitive: ' || coalesce({sql_personal(p, home)}, {sql_config(p)}, {sql_credential(p)}), "
        f"CASE WHEN NOT {sql_under(p, root)} THEN 'outside the project' END)"
    )


# --- queries ------------------------------------------------------------------------------------


@query(f"WITH src AS ({LIFTED_PATHS}) SELECT page_id, path, {sql_normalise('path')} AS normal FROM src")
def path_normalise(t: Tables) -> DataFrame:
    return lifted(t).select("page_id", "path", P.normalize(F.col("path")).alias("normal"))


@query(
    f"WITH src AS ({LIFTED_PATHS}), n AS (SELECT *, {sql_normalise('path')} AS p FROM src)\n"
    f"SELECT page_id, {sql_credential('p')} AS credential, {sql_config('p')} AS config, {sql_personal('p', q('/en'))} AS personal, "
    f"{sql_under('p', q(ROOT))} AS in_root, {sql_off_limits('p', q(ROOT), q(HOME))} AS off_limits, "
    "replace(replace(replace(url_encode(path), '%2F', '/'), '%3A', ':'), '+', '%20') AS as_url, "
    "regexp_replace(path, '[^A-Za-z0-9]', '-', 'g') AS folder FROM n"
)
def url_path_class(t: Tables) -> DataFrame:
    home, root = F.lit(HOME), F.lit(ROOT)
    off = F.array().cast("array<string>")
    p = F.col("p")
    return lifted(t).withColumn("p", P.normalize(F.col("path"))).select(
        "page_id",
        P.credential_path(p).alias("credential"),
        P.agent_config(p).alias("config"),
        P.personal_folder(p, home).alias("personal"),
        P.under(p, root).alias("in_root"),
        P.off_limits(p, root, home, off).alias("off_limits"),
        P.url_path(F.col("path")).alias("as_url"),
        P.encoded_folder(F.col("path")).alias("folder"),
    )


ADDRESS = "'file://' || replace(url, ' ', '%20') || '%20x%2Fy%zz+' || CAST(page_id AS STRING)"


@query(
    f"SELECT page_id, replace(replace(substr({ADDRESS}, 8), '%20', ' '), '%2F', '/') AS path FROM pages"
)
def path_of_address(t: Tables) -> DataFrame:
    return t.pages.select("page_id", P.path_of_url(F.expr(ADDRESS)).alias("path"))


TEXT = "'cat ' || html || ' ~/notes ../up . C:/win a:b --flag=' || url || ' end.'"
SEPARATORS = r"[\s|;&<>()''\x22`=,\[\]{}:]"
SQL_WORDS = (
    rf"list_transform(list_filter(string_split_regex(regexp_replace(text, '(^|{SEPARATORS})([A-Za-z]):([\\/])', '\1\2§\3', 'g'), "
    rf"'{SEPARATORS}'), lambda w: w <> '' AND strlen(w) < 1024 AND NOT starts_with(w, '-')), lambda w: replace(w, '§', ':'))"
).replace(r"[\\/]", r"[\\/]")


@query(
    f"WITH src AS (SELECT page_id, {TEXT} AS text FROM pages), w AS (SELECT page_id, unnest({SQL_WORDS}) AS w FROM src),\n"
    r"s AS (SELECT page_id, CASE WHEN ends_with(w, '..') OR w = '.' THEN w ELSE regexp_replace(w, '[.\\]+$', '') END AS w FROM w),"
    "\nj AS (SELECT page_id, CASE WHEN w = '~' THEN '/home/me' WHEN starts_with(w, '~/') THEN '/home/me/' || substr(w, 3) "
    "WHEN starts_with(w, '/') THEN w ELSE '/work/app/' || w END AS p FROM s)\n"
    f"SELECT path, CAST(count(*) AS BIGINT) AS n FROM (SELECT {sql_normalise('p')} AS path FROM j) GROUP BY 1"
)
def path_words(t: Tables) -> DataFrame:
    paths = P.paths_in(F.expr(TEXT), F.lit("/work/app"), F.lit("/home/me"))
    return t.pages.select(F.explode(paths).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


COMMAND_ROWS = "(VALUES " + ", ".join(f"({i}, {q(c)})" for i, c in enumerate(COMMANDS)) + ") AS c(cmd_no, cmd)"
# Every event runs a command with its own tail, so the work grows with the table.
COMMAND_TEXT = "cmd || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' && cd ..' WHEN 2 THEN '; cd src' WHEN 3 THEN ' | env' ELSE ' # ' || event_type END"


def sql_sensitive(c: str) -> str:
    return f"regexp_matches({c}, {q(V.SENSITIVE_COMMAND.replace('END', '$'))})"


def sql_opaque(c: str) -> str:
    quoted = r"""'[^']*'|"(?:[^"\\]|\\.)*\""""
    blank = f"regexp_replace({c}, {q(quoted)}, '''''', 'g')"
    before = f"string_split({c}, '<<')"
    segment = f"regexp_extract(array_to_string({before}[1:i], '<<'), '[^|;&\\n]*$')"
    heredoc = f"len(list_filter(range(1, len({before})), lambda i: NOT regexp_matches(ltrim({segment}), '^(?:cat|tee)'))) > 0"
    return f"({heredoc} OR regexp_matches({c}, {q(V.GLUED_QUOTES)}) OR regexp_matches({blank}, {q(V.OPAQUE_COMMAND)}))"


@query(
    f"WITH src AS (SELECT event_id, {COMMAND_TEXT} AS cmd FROM events JOIN {COMMAND_ROWS} ON event_id % {len(COMMANDS)} = cmd_no),\n"
    f"k AS (SELECT *, regexp_extract_all(cmd, {q(V.CHANGE_DIR.replace('END', '$'))}, 1) AS dirs FROM src)\n"
    f"SELECT event_id, {sql_sensitive('cmd')} AS sensitive, {sql_opaque('cmd')} AS opaque, "
    "len(list_filter(dirs, lambda d: d IN ('', '..', '~', '-'))) > 0 AS leaves, "
    rf"regexp_replace(regexp_replace(cmd, '^\s*cd\s+\S+\s*(?:&&|;)\s*', ''), '^\s+|\s+$', '', 'g') AS label FROM k"
)
def command_checks(t: Tables) -> DataFrame:
    cmds = "element_at(array(" + ", ".join(q(c).replace("\\", "\\\\").replace("''", "\\'") for c in COMMANDS) + f"), 1 + CAST(event_id % {len(COMMANDS)} AS INT))"
    src = t.events.select("event_id", F.expr(COMMAND_TEXT.replace("cmd ||", f"{cmds} ||", 1)).alias("cmd"))
    cmd, cwd = F.col("cmd"), F.lit("/work/app")
    return src.select(
        "event_id",
        C.sensitive_command(cmd).alias("sensitive"),
        C.opaque_command(cmd).alias("opaque"),
        C.leaves_project(cmd, cwd, F.lit("/home/me"), cwd).alias("leaves"),
        T.without_cd(cmd).alias("label"),
    )


# Files: one per page, under a project named after the language. Every seventh page's folder is a repository.
FILE_PATH = f"'/w' || {URL_PATH} || CASE page_id % 4 WHEN 0 THEN '/.env' WHEN 1 THEN '/Makefile' WHEN 2 THEN '/a.rs' ELSE '/build/out.txt' END"
FOLDER = f"'/w' || {URL_PATH}"
FILES = (
    f"SELECT DISTINCT 'p' AS project_id, replace({FILE_PATH}, '//', '/') AS path, CAST(length(html) AS BIGINT) * (CASE WHEN page_id % 9 = 0 THEN 100000 ELSE 1 END) AS size FROM pages"
)
REPOS = f"SELECT DISTINCT 'p' AS project_id, rtrim({FOLDER}, '/') AS repo, page_id % 14 <> 0 AS listing_ok FROM pages WHERE page_id % 7 = 0"


def lifted_files(t: Tables) -> DataFrame:
    return t.pages.select(
        F.lit("p").alias("project_id"),
        F.expr(f"replace({FILE_PATH}, '//', '/')").alias("path"),
        F.expr("CAST(length(html) AS BIGINT) * (CASE WHEN page_id % 9 = 0 THEN 100000 ELSE 1 END)").cast("bigint").alias("size"),
    ).distinct()


def lifted_repos(t: Tables) -> DataFrame:
    own = t.pages.where("page_id % 7 = 0").select(
        F.lit("p").alias("project_id"), F.expr(f"rtrim('/', {FOLDER})").alias("repo"), F.expr("page_id % 14 <> 0").alias("listing_ok")
    )
    return own.groupBy("project_id", "repo").agg(F.min("listing_ok").alias("listing_ok")).unionByName(
        t.spark.range(1).select(F.lit("p").alias("project_id"), F.lit("/w").alias("repo"), F.lit(True).alias("listing_ok"))
    )


IGNORED_SQL = (
    "SELECT project_id, repo, unnest(['build/', '.env', 'en/']) AS entry FROM repos"
)


@query(
    f"WITH files AS ({FILES}), own AS (SELECT project_id, repo, min(listing_ok) AS listing_ok FROM ({REPOS}) GROUP BY ALL),\n"
    "repos AS (SELECT * FROM own UNION ALL SELECT 'p', '/w', true),\n"
    f"entries AS ({IGNORED_SQL}),\n"
    "near AS (SELECT f.path, arg_max(r.repo, length(r.repo)) AS repo, arg_max(r.listing_ok, length(r.repo)) AS ok "
    "FROM files f JOIN repos r ON starts_with(f.path, r.repo || '/') GROUP BY 1)\n"
    "SELECT DISTINCT near.path FROM near LEFT JOIN entries e ON near.repo = e.repo "
    "WHERE NOT ok OR substr(near.path, length(near.repo) + 2) = e.entry "
    "OR (ends_with(e.entry, '/') AND starts_with(substr(near.path, length(near.repo) + 2), e.entry))"
)
def ignored_files(t: Tables) -> DataFrame:
    repos = lifted_repos(t)
    entries = repos.select(
        "project_id", "repo", F.explode(F.array(F.lit("build/"), F.lit(".env"), F.lit("en/"))).alias("entry")
    )
    at = lifted_files(t).withColumn("real_path", F.col("path"))
    return files.ignored_files(at, repos, entries).select("path")


NAMED = f"SELECT page_id, {sql_normalise('path')} AS path FROM (SELECT page_id, replace({FILE_PATH}, '//', '/') || CASE WHEN page_id % 11 = 0 THEN '/../gone.rs' ELSE '' END AS path FROM pages)"


@query(
    f"WITH files AS ({FILES}), named AS ({NAMED}), own AS (SELECT project_id, repo, min(listing_ok) AS listing_ok FROM ({REPOS}) GROUP BY ALL),\n"
    "repos AS (SELECT * FROM own UNION ALL SELECT 'p', '/w', true),\n"
    f"entries AS ({IGNORED_SQL}),\n"
    "near AS (SELECT f.path, arg_max(r.repo, length(r.repo)) AS repo, arg_max(r.listing_ok, length(r.repo)) AS ok "
    "FROM files f JOIN repos r ON starts_with(f.path, r.repo || '/') GROUP BY 1),\n"
    "ign AS (SELECT DISTINCT near.path FROM near LEFT JOIN entries e ON near.repo = e.repo "
    "WHERE NOT ok OR substr(near.path, length(near.repo) + 2) = e.entry "
    "OR (ends_with(e.entry, '/') AND starts_with(substr(near.path, length(near.repo) + 2), e.entry))),\n"
    "big AS (SELECT path, max(size) AS size FROM files GROUP BY 1),\n"
    f"v AS (SELECT page_id, n.path, {sql_off_limits('n.path', q('/w/en'), q('/w'))} AS lim, big.size AS size, ign.path IS NOT NULL AS ignored "
    "FROM named n LEFT JOIN big ON big.path = n.path LEFT JOIN ign ON ign.path = n.path)\n"
    "SELECT page_id, path, CASE WHEN starts_with(lim, 'sensitive') THEN lim "
    f"WHEN size IS NULL THEN CASE WHEN {sql_under('path', q('/w/en'))} THEN 'no longer exists' ELSE 'outside the project' END "
    "WHEN lim IS NOT NULL THEN lim WHEN page_id % 13 = 0 THEN 'left out by you' WHEN ignored THEN 'gitignored' "
    "WHEN size > 1073741824 THEN 'over 10 MB' WHEN size > 10485760 THEN 'over 10 MB' END AS skip FROM v"
)
def file_verdicts(t: Tables) -> DataFrame:
    at = (
        lifted_files(t)
        .groupBy("project_id", "path")
        .agg(F.max("size").alias("size"))
        .select("project_id", "path", F.col("path").alias("real_path"), F.lit(True).alias("is_file"), "size")
    )
    repos = lifted_repos(t)
    entries = repos.select(
        "project_id", "repo", F.explode(F.array(F.lit("build/"), F.lit(".env"), F.lit("en/"))).alias("entry")
    )
    no_rules = at.select("project_id", "path").withColumn("key_rule", F.lit(None).cast("string")).withColumn(
        "utf16_rule", F.lit(None).cast("string")
    ).withColumn("redactions", F.lit(0))
    facts = files.file_facts(at, repos, entries, no_rules)
    named = t.pages.select(
        "page_id",
        F.lit("p").alias("project_id"),
        F.lit("/w/en").alias("root"),
        F.lit("/w").alias("home"),
        F.array().cast("array<string>").alias("off"),
        P.normalize(
            F.expr(f"replace({FILE_PATH}, '//', '/') || CASE WHEN page_id % 11 = 0 THEN '/../gone.rs' ELSE '' END")
        ).alias("path"),
    )
    rows = files.with_file_facts(named, facts, None).withColumn("excluded", F.col("page_id") % 13 == 0)
    return files.with_limits(rows).select("page_id", "path", files.skip_reason().alias("skip"))


@query(
    "WITH e AS (SELECT page_id % 60 AS bundle_id, CASE page_id % 12 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'transcript.jsonl' "
    f"WHEN 2 THEN 'conversation.jsonl' ELSE 'files' || regexp_replace({URL_PATH}, '/+$', '') || CASE WHEN page_id % 61 = 0 THEN '/../x' WHEN page_id % 67 = 0 THEN '/.git/config' ELSE '/a.rs' END END AS path, "
    "CASE WHEN page_id % 71 = 0 THEN 'link' ELSE 'file' END AS entry_type, length(html) * CASE WHEN page_id % 73 = 0 THEN 1000000 ELSE 1 END AS size FROM pages),\n"
    "all_e AS (SELECT * FROM e UNION ALL SELECT DISTINCT page_id % 60, 'manifest.json', 'file', 10 FROM pages WHERE page_id % 60 % 5 <> 0 "
    "UNION ALL SELECT DISTINCT page_id % 60, 'transcript.jsonl', 'file', 10 FROM pages WHERE page_id % 60 % 7 <> 0),\n"
    "p AS (SELECT *, CASE WHEN entry_type <> 'file' THEN 'a link or special file' WHEN starts_with(path, 'files/') AND size > 1073741824 THEN 'an oversized file' "
    "WHEN path IN ('manifest.json', 'transcript.jsonl', 'conversation.jsonl') THEN NULL WHEN contains(path, '/../') THEN 'unsafe path' "
    "WHEN contains(path, '/.git/') THEN 'carries git internals (hooks run code)' END AS problem FROM all_e),\n"
    "b AS (SELECT bundle_id, count(*) AS entries, sum(size) AS bytes, count(problem) AS bad_entries, arg_min(problem, path) FILTER (problem IS NOT NULL) AS first_problem, "
    "bool_or(path = 'manifest.json') AS m, bool_or(path = 'transcript.jsonl') AS tr FROM p GROUP BY 1)\n"
    "SELECT bundle_id, CAST(entries AS BIGINT) AS entries, CAST(bytes AS BIGINT) AS bytes, CAST(bad_entries AS BIGINT) AS bad_entries, "
    "CASE WHEN bytes > 2147483648 THEN 'unpacks to more than the limit' WHEN first_problem IS NOT NULL THEN first_problem "
    "WHEN NOT m THEN 'no manifest' WHEN NOT tr THEN 'no transcript' END AS problem FROM b"
)
def bundle_audit(t: Tables) -> DataFrame:
    size = F.expr("length(html) * CASE WHEN page_id % 73 = 0 THEN 1000000L ELSE 1L END")
    path = F.expr(
        "CASE page_id % 12 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'transcript.jsonl' WHEN 2 THEN 'conversation.jsonl' "
        f"ELSE 'files' || regexp_replace({URL_PATH}, '/+$', '') || CASE WHEN page_id % 61 = 0 THEN '/../x' WHEN page_id % 67 = 0 THEN '/.git/config' ELSE '/a.rs' END END"
    )
    bundle = (F.col("page_id") % 60).alias("bundle_id")
    kind = F.expr("CASE WHEN page_id % 71 = 0 THEN 'link' ELSE 'file' END")
    entries = t.pages.select(bundle, path.alias("path"), kind.alias("entry_type"), size.alias("size"))
    for name, k in [("manifest.json", 5), ("transcript.jsonl", 7)]:
        extra = t.pages.where(F.col("page_id") % 60 % k != 0).select(
            bundle, F.lit(name).alias("path"), F.lit("file").alias("entry_type"), F.lit(10).cast("bigint").alias("size")
        )
        entries = entries.unionByName(extra.distinct())
    return bundles.audit_bundles(entries).drop("accepted")


@query(
    f"WITH s AS (SELECT DISTINCT substr(replace({FILE_PATH}, '//', '/'), 2) AS rel FROM pages WHERE page_id % 4 = 2),\n"
    "parts AS (SELECT rel, string_split(rel, '/') AS ps FROM s),\n"
    "dirs AS (SELECT DISTINCT unnest(list_transform(range(0, len(ps)), lambda n: array_to_string(ps[1:n], '/'))) AS dir FROM parts),\n"
    f"files AS ({FILES})\n"
    "SELECT DISTINCT files.path FROM dirs JOIN files ON files.path = '/' || CASE WHEN dir = '' THEN '' ELSE dir || '/' END || 'Makefile'"
)
def build_manifests(t: Tables) -> DataFrame:
    shared = lifted_files(t).where(F.endswith("path", F.lit("/a.rs"))).select(F.substr(F.col("path"), F.lit(2)).alias("rel"))
    at = lifted_files(t).select("path").distinct()
    dirs = shared.select(F.explode(P.ancestors(F.col("rel"))).alias("dir")).distinct()
    names = F.array(*[F.lit(m) for m in V.MANIFESTS])
    wanted = dirs.select(
        F.explode(F.transform(names, lambda m: P.join(F.concat(F.lit("/"), F.col("dir")), m))).alias("path")
    )
    return at.join(wanted, "path", "left_semi")


@query(
    "SELECT p_partkey, p_name, CASE WHEN regexp_matches(n, '[\\x00-\\x1f\\x7f/]') OR n IN ('', '.', '..') THEN 'pod' ELSE n END AS folder_name "
    "FROM (SELECT p_partkey, p_name, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN '..' WHEN 2 THEN p_name || chr(27) "
    "WHEN 3 THEN '' ELSE p_name END AS n FROM part)"
)
def received_names(t: Tables) -> DataFrame:
    n = F.expr(
        "CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN '..' WHEN 2 THEN p_name || chr(27) WHEN 3 THEN '' ELSE p_name END"
    )
    return bundles.folder_names(t.part.select("p_partkey", "p_name", n.alias("name"))).drop("name")
