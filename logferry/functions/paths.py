"""Path expressions: words, normalising, containment and the path classifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .let import any_of, empty_strings, first_of, let

DRIVE = "\ufdd0"  # stands in for a drive's colon while words are split
SEPARATORS = r"\s|;&<>()'\x22`=,\[\]{}:"


# A path with an empty, ``.`` or ``..`` part (but the empty one before a first slash).
UNRESOLVED = r"/\.{0,2}(?:/|\z)|\A\.{1,2}(?:/|\z)"


def normalize(path: Column) -> Column:
    """Resolve ``.`` and ``..`` by text alone, never climbing above the root. Most paths have nothing to resolve."""
    return let(path, lambda p: F.when(F.rlike(p, F.lit(UNRESOLVED)), _resolved(p)).otherwise(p))


def _resolved(path: Column) -> Column:
    parts = F.aggregate(
        F.split(path, "/"),
        empty_strings(),
        lambda acc, p: first_of(
            (p.isin("", "."), acc),
            (p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def join(base: Column, path: Column) -> Column:
    """``base/path``, or ``path`` itself when absolute."""
    return (
        F.when(F.startswith(path, F.lit("/")), path)
        .when(F.endswith(base, F.lit("/")), F.concat(base, path))
        .otherwise(F.concat(base, F.lit("/"), path))
    )


def words(text: Column) -> Column:
    """Words of ``text`` split at white space and shell punctuation, and at colons that are not a drive's."""
    marked = F.regexp_replace(text, rf"(?U)(^|[{SEPARATORS}])([A-Za-z]):([\\/])", "$1$2" + DRIVE + "$3")
    pieces = F.split(marked, rf"(?U)[{SEPARATORS}]", -1)
    return F.transform(
        F.filter(
            pieces, lambda w: (w != "") & (F.octet_length(w) < 1024) & ~F.startswith(w, F.lit("-"))
        ),
        lambda w: F.replace(w, F.lit(DRIVE), F.lit(":")),
    )


def resolve_word(word: Column, cwd: Column, home: Column) -> Column:
    """A path-like word as a normalised path."""
    t = F.when(F.endswith(word, F.lit("..")) | (word == "."), word).otherwise(
        F.regexp_replace(word, r"[.\\]+\z", "")
    )
    return let(
        t,
        lambda w: normalize(
            first_of(
                (w == "~", home),
                (F.rlike(w, F.lit(r"^~[/\\]")), join(home, F.substr(w, F.lit(3)))),
            ).otherwise(join(cwd, w))
        ),
    )


def paths_in(text: Column, cwd: Column, home: Column) -> Column:
    """Every path-like word of ``text``, resolved against ``cwd``, in order."""
    return F.transform(words(text), lambda w: resolve_word(w, cwd, home))


def _key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def under(path: Column, folder: Column) -> Column:
    """Whether ``path`` is ``folder`` or inside it, ignoring case and slash direction."""
    p, d = _key(path), _key(folder)
    return (p == d) | F.startswith(p, F.concat(F.rtrim(d, F.lit("/")), F.lit("/")))


def inside(path: Column, folder: Column) -> Column:
    """``path`` relative to ``folder`` when it is strictly or equally inside (exact case), else null."""
    return first_of(
        (path == folder, F.lit("")),
        (folder == "/", F.substr(path, F.lit(2))),
        (
            F.startswith(path, F.concat(folder, F.lit("/"))),
            F.substr(path, F.length(folder) + 2),
        ),
    )


def components(path: Column) -> Column:
    """Lower-cased components, without empty and ``.`` ones."""
    return F.filter(F.split(F.lower(path), "/"), lambda p: ~p.isin("", "."))


def ancestors(path: Column) -> Column:
    """Every folder above ``path`` (nearest last), the root included as ``/`` or the empty path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    top = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    return let(
        parts,
        lambda ps: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(ps) - 1, F.lit(0))),
            lambda n: F.concat(top, F.array_join(F.slice(ps, F.lit(1), n), "/")),
        ),
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder holding ``path`` (``/`` at the top of an absolute path)."""
    head = F.regexp_replace(path, r"/?[^/]*\z", "")
    return F.when((head == "") & F.startswith(path, F.lit("/")), "/").otherwise(head)


# --- classifiers ---------------------------------------------------------------------


def agent_config(path: Column) -> Column:
    """Why a file would configure or run code in the receiver's agent, or null."""

    def part_reason(parts: Column, p: Column, i: Column) -> Column:
        following = F.get(parts, i + 1)
        return first_of(
            ((p == ".claude") & ~following.eqNullSafe(F.lit("skills")), F.lit("agent settings (hooks, permissions)")),
            (p == ".git", F.lit("git internals (hooks run code)")),
            (p == V.RECORDS_DIR, F.lit(f"{V.TOOL}'s own records")),
            (p.isin(*V.EDITOR_DIRS), F.lit("editor or git-hook config that runs code")),
            (
                p.isin(*V.AGENT_DIRS) | F.startswith(p, F.lit(".aider.")),
                F.lit("agent settings (tools, permissions)"),
            ),
        )

    def reason(parts: Column) -> Column:
        by_part = F.filter(F.transform(parts, lambda p, i: part_reason(parts, p, i)), lambda r: r.isNotNull())
        last = F.element_at(F.concat(F.array(F.lit("")), parts), -1)
        return F.coalesce(
            F.get(by_part, F.lit(0)), F.when(last.isin(*V.EXECUTABLE_CONFIG), "config that runs code on open")
        )

    return let(components(path), reason)


def credential_path(path: Column) -> Column:
    """Why a file looks like a credential, key, history or data store by its path alone, or null."""

    def reason(parts: Column) -> Column:
        denied = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in V.DENIED_DIRS]))
        return F.when(denied, F.lit("credential directory")).otherwise(
            let(F.element_at(F.concat(F.array(F.lit("")), parts), -1), _file_reason)
        )

    return let(components(path), reason)


def _file_reason(name: Column) -> Column:
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")
    return first_of(
        (
            (ext == "env") | (F.startswith(name, F.lit(".env")) & ~ext.isin(*V.EXAMPLE_EXTENSIONS)),
            F.lit("environment file"),
        ),
        (any_of(*[F.startswith(name, F.lit(k)) for k in V.SSH_KEY_NAMES]), F.lit("SSH key")),
        (
            F.endswith(name, F.lit("_history")) | F.endswith(name, F.lit(".tfstate.backup")),
            F.lit("history or state file"),
        ),
        (
            name.isin(*V.DENIED_NAMES) | ext.isin(*V.DENIED_EXTENSIONS),
            F.lit("key, credential or database file"),
        ),
    )


def personal_folder(path: Column, home: Column, agent_dirs: Column | None = None) -> Column:
    """Why a path is in a personal folder of ``home`` (or a relocated agent folder), or null."""
    first = F.get(components(inside(path, home)), F.lit(0))
    hit = first.isin(*V.PERSONAL_FOLDERS)
    if agent_dirs is not None:
        hit = F.exists(agent_dirs, lambda d: inside(path, d).isNotNull()) | F.coalesce(hit, F.lit(False))
    return F.when(hit, F.lit("personal folder in the home directory"))


def system_path(path: Column) -> Column:
    return any_of(*[under(path, F.lit(d)) for d in V.SYSTEM_PREFIXES])


def filter_on(off: Column, name: str) -> Column:
    """Whether a safety filter is on, given the list of those switched off."""
    assert name in V.FILTERS
    return ~F.array_contains(off, name)


def filters_off(off: Column) -> Column:
    """The switched-off filters in display order."""
    return F.filter(F.array(*[F.lit(f) for f in V.FILTERS]), lambda f: F.array_contains(off, f))


def sensitive_place(path: Column, home: Column, off: Column, config: bool, agent_dirs: Column | None = None) -> Column:
    """The first of personal folder, agent config (never switched off) and credential file that applies."""
    personal = F.when(filter_on(off, "personal-folders"), personal_folder(path, home, agent_dirs))
    credential = F.when(filter_on(off, "credential-files"), credential_path(path))
    return F.coalesce(personal, agent_config(path), credential) if config else F.coalesce(personal, credential)


def off_limits(path: Column, root: Column, home: Column, off: Column, agent_dirs: Column | None = None) -> Column:
    """``sensitive: …`` or ``outside the project`` for a path a shared session must not reach, else null."""
    return F.coalesce(
        F.concat(F.lit("sensitive: "), sensitive_place(path, home, off, True, agent_dirs)),
        F.when(~under(path, root), F.lit("outside the project")),
    )


def distinctive(word: Column) -> Column:
    """Long, unusual names are safe to replace anywhere."""
    return (F.length(word) >= 5) & ~F.lower(word).isin(*V.COMMON_WORDS)


def root_problem(root: Column, home: Column) -> Column:
    """Why a project root cannot be shared, or null."""
    return first_of(
        (inside(home, root).isNotNull(), F.lit("home folder or above it")),
        ((parent(root) == home) & file_name(root).isin(*V.PERSONAL_ROOTS), F.lit("personal folder")),
    )


def safe_name(name: Column) -> Column:
    """Whether a received project name is one plain folder name."""
    return (
        ~F.rlike(name, F.lit("[\\p{Cc}\u202a-\u202e\u2066-\u2069/]")) & ~name.isin("", ".", "..")
    )


# --- spellings ------------------------------------------------------------------------


def url_path(path: Column) -> Column:
    """A path as it appears in a ``file://`` URL."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.when(F.substring(p, 2, 1) == ":", F.concat(F.lit("/"), p)).otherwise(p)
    coded = F.url_encode(p)
    for find, put in [("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("*", "%2A"), ("%7E", "~")]:
        coded = F.replace(coded, F.lit(find), F.lit(put))
    return coded


def path_of_url(text: Column) -> Column:
    """A ``file://`` URL or plain path as a path; a malformed escape stays as it is."""
    bare = F.regexp_replace(F.regexp_replace(text, "^file://", ""), "^/([A-Za-z]:)", "$1")
    # Only well-formed escapes are handed to the decoder, so a lone % survives.
    guarded = F.replace(F.regexp_replace(bare, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(bare, F.lit("%")), F.coalesce(F.try_url_decode(guarded), bare)).otherwise(bare)


def encoded_folder(path: Column) -> Column:
    """The folder name agent A gives a working directory."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def portable(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def shown(path: Column, root: Column, home: Column) -> Column:
    """A path for people: relative to the project, to home, or as it is."""
    return F.coalesce(inside(path, root), F.concat(F.lit("~/"), inside(path, home)), path)


def skill_folder(path: Column) -> Column:
    """The folder a path names as ``…/skills/<name>`` (or its SKILL.md), before checking that it exists."""
    name = F.lower(file_name(path))
    folder = F.when(name == "skill.md", parent(path)).otherwise(path)
    return let(folder, lambda d: F.when(file_name(parent(d)) == "skills", d))
