from pyspark.sql import functions as F

from logferry.functions import commands as C
from logferry.functions import paths as P
from logferry.functions import text as T

HOME, ROOT = "/Users/me", "/Users/me/proj"


def test_normalise(column):
    got = column(["/p/../../h/.ssh/x", "a/./b//c/", "../x", "/", "/p/q/.."], P.normalize)
    assert got == ["/h/.ssh/x", "a/b/c", "x", "/", "/p"]


def test_words_and_paths(column):
    text = "cd .. and ../x, see a.rs. C:/win d:x '~/notes' --flag ~"
    (got,) = column([text], lambda c: P.paths_in(c, F.lit("/p/q"), F.lit("/h")))
    assert {"/p", "/p/x", "/p/q/a.rs", "/h/notes", "/h", "/p/q/C:/win"} <= set(got)
    assert not any("--flag" in p for p in got)


def test_denied_paths(column):
    denied = lambda c: F.coalesce(P.credential_path(c), P.agent_config(c))
    yes = [
        ".env", "app/.env.local", ".env-prod", "prod.env", "certs/server.pem", ".claude/settings.json", ".Claude/x",
        ".envrc", "a/.git/config", "id_ed25519", ".zsh_history", "key.ppk",
    ]
    no = [".env.example", "src/main.rs", ".claude/skills/x/SKILL.md", "CLAUDE.md", "keys.rs", "environment.rs"]
    assert all(column(yes, denied))
    assert column(no, denied) == [None] * len(no)


def test_personal_folders(column):
    yes = ["/Users/me/Library/Messages/a.jpg", "/Users/me/.codex/auth.json", "/Users/me/AppData/Roaming/x"]
    no = ["/Users/me/Desktop/proj/a.rs", "/tmp/x"]
    fn = lambda c: P.personal_folder(c, F.lit(HOME))
    assert all(column(yes, fn)) and column(no, fn) == [None, None]


def test_under_and_shown(column):
    assert column(["/users/ME/proj/x", "\\Users\\me\\proj", "/Users/me/project"], lambda c: P.under(c, F.lit(ROOT))) == [
        True, True, False,
    ]
    got = column([ROOT + "/a", HOME + "/b", "/etc/x"], lambda c: P.shown(c, F.lit(ROOT), F.lit(HOME)))
    assert got == ["a", "~/b", "/etc/x"]


def test_urls(column):
    assert column(["/new place/é+*~", "C:\\x"], P.url_path) == ["/new%20place/%C3%A9%2B%2A~", "/C:/x"]
    got = column(["file:///p%20q", "file:///C:/x", "/a%zz+b", "/a%2"], P.path_of_url)
    assert got == ["/p q", "C:/x", "/a%zz+b", "/a%2"]


OPAQUE = [
    "cat .en''v.production", 'cat ".e""nv"', "cat .en?", "cat .[e]nv", r"cat .e\nv", "cat $(ls -a | grep nv)",
    "python3 -c \"open('.'+'env')\"", "python3 - <<'EOF'\nprint(1)\nEOF", "ls -a | xargs cat",
    "find . -name '*nv' -exec cat {} +", "tar cf - . | tar xOf -", "grep -rh '' .",
    'powershell -Command "Get-Content x"', "iex (Get-Content run.ps1 -Raw)", "cmd /c type x",
]
CLEAR = [
    "cargo test", "ls -la src", 'grep -n "foo[0-9]?" src/*.rs', "git commit -m 'a b'", r"cat My\ Notes.txt",
    "cat <<'EOF' > src/new.rs\nfn a() {}\nEOF", "grep -rn TODO src",
]
SENSITIVE = [
    "cat .env.p*", "git show HEAD:.env.production", 'cat "$HOME/.ssh/config"', "env", "ls | env", "printenv",
    "echo $API_KEY", "Get-ChildItem Env:", "echo $env:OPENAI_API_KEY", "type %USERPROFILE%\\secrets.txt", "Get-Content .env",
]
HARMLESS = [
    "cargo test", "ls -la src", "grep -n environment src/main.rs", "npm run dev", "grep -rn secret src/",
    "cargo test credential",
]


def test_commands(column):
    assert column(OPAQUE, C.opaque_command) == [True] * len(OPAQUE)
    assert column(CLEAR, C.opaque_command) == [False] * len(CLEAR)
    assert column(SENSITIVE, C.sensitive_command) == [True] * len(SENSITIVE)
    assert column(HARMLESS, C.sensitive_command) == [False] * len(HARMLESS)
    cds = ["cd", "cd ~ && ls", "cd ../..", "cd src && ls", "echo cd", "pushd /tmp; ls", "(cd -)"]
    leaves = lambda c: C.leaves_project(c, F.lit(ROOT), F.lit(HOME), F.lit(ROOT))
    assert column(cds, leaves) == [True, True, True, False, False, True, True]


def test_scripts(column):
    script = 'tools.apply_patch("*** Begin Patch\\n*** Update File: /p/a.js \\n+x\\n*** End Patch"); tools.exec_command({})'
    assert column([script], C.patched_files) == [["/p/a.js"]]
    assert column([script, "tools.web.run()"], C.unknown_script_tool) == [False, True]
    assert "+x" not in "".join(column([script], C.without_patches)[0])


def test_wording(column):
    assert column([42_300, 1_234, 850, 1_250_000], T.short_count, "x bigint") == ["42k", "1.2k", "850", "1.2M"]
    assert column([10, 2048, 3 << 20], T.size_words, "x bigint") == ["10 B", "2 KB", "3.0 MB"]
    assert column([1, 2], lambda c: T.counted(c, "file"), "x bigint") == ["1 file", "2 files"]
    assert column(["a\x1bb\u202ec"], T.plain) == ["a?b?c"]
    assert column([" a \n b  c"], lambda c: T.short_line(c, 3)) == ["a b…"]
    assert column(["cd src && cargo test"], T.without_cd) == ["cargo test"]
    intro = "[This conversation started in X. appear as text lines followed by what they returned.]\n\nfix it"
    assert column([intro, "plain"], T.strip_intro) == ["fix it", "plain"]
    times = column([1_790_000_000_123, 951_782_400_000], lambda c: T.utc_time(F.timestamp_millis(c)), "x bigint")
    assert times == ["2026-09-21T14:13:20.123Z", "2000-02-29T00:00:00.000Z"]
    uuid = "56b3cd4f-0000-4000-8000-00000000abcd"
    assert column([f"rollout-2026-01-01T00-00-00-{uuid}", "abc"], T.session_id_of) == [uuid, "abc"]
    whys = ["sensitive: personal folder in the home directory", "sensitive: SSH key", "left out by you", "over 10 MB"]
    assert column(whys, T.brief_reason) == ["personal", "secrets", "left out by you", "over 10 MB"]


def test_paths_with_nothing_to_resolve_stay_as_they_are(column):
    from itertools import product

    from logferry.functions import paths

    cases = ["".join(x) for n in range(6) for x in product(["/", ".", "a"], repeat=n)] + [None, "/a/.../b", "a\n/../b", "/ä/.x/..y"]
    assert column(cases, paths.normalize) == column(cases, paths._resolved)
    expression = paths.normalize(__import__("pyspark").sql.functions.col("x"))._jc.toString()
    assert "RLIKE" in expression.upper()
