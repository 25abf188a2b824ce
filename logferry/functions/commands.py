"""Shell-command tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .paths import resolve_word, under, words
from .text import trimmed


def _java(pattern: str) -> Column:
    return F.lit("(?dU)" + pattern.replace("END", r"\z"))


def sensitive_command(cmd: Column) -> Column:
    """Whether a command looks like it reads credentials, history or the environment."""
    return F.rlike(cmd, _java(V.SENSITIVE_COMMAND))


def unquoted(cmd: Column) -> Column:
    """The command with every quoted string blanked."""
    return F.regexp_replace(cmd, r"""(?s)'[^']*+'|"(?:[^"\\]++|\\.)*+\"""", "''")


def script_heredoc(cmd: Column) -> Column:
    """A here-document that feeds anything but ``cat`` or ``tee``."""
    before = F.slice(F.split(cmd, "<<", -1), 1, F.size(F.split(cmd, "<<", -1)) - 1)
    # The segment in front of each << starts after the last separator of all text before it.
    fed = F.transform(
        before,
        lambda part, i: F.regexp_extract(
            F.array_join(F.slice(before, F.lit(1), i + 1), "<<"), r"(?s)([^|;&\n]*)\z", 1
        ),
    )
    return F.exists(fed, lambda s: ~F.rlike(trimmed(s), F.lit("^(?:cat|tee)")))


def opaque_command(cmd: Column) -> Column:
    """Whether a command's reads cannot be read off its text."""
    return (
        (F.contains(cmd, F.lit("<<")) & script_heredoc(cmd))
        | F.rlike(cmd, _java(V.GLUED_QUOTES))
        | F.rlike(unquoted(cmd), _java(V.OPAQUE_COMMAND))
    )


def leaves_project(cmd: Column, cwd: Column, home: Column, root: Column) -> Column:
    """Whether a ``cd`` or ``pushd`` in the command goes home, back, or out of the project."""
    targets = F.regexp_extract_all(cmd, _java(V.CHANGE_DIR), F.lit(1))
    return F.exists(
        targets,
        lambda d: d.isin("", "~", "-")
        | F.exists(F.transform(words(d), lambda w: resolve_word(w, cwd, home)), lambda p: ~under(p, root)),
    )


def unknown_script_tool(script: Column) -> Column:
    """Whether text after some ``tools.`` does not start with a known script tool."""
    after = F.split(script, r"tools\.", -1)
    return F.exists(
        F.slice(after, F.lit(2), F.size(after)),
        lambda t: ~F.rlike(t, F.lit("^(?:" + "|".join(V.B_SCRIPT_TOOLS) + ")")),
    )


def patched_files(script: Column) -> Column:
    """Files that patch headers in a script add, update or delete."""
    pieces = F.split(script, r'\n|"|\\n', -1)
    header = r"(?s)^\*\*\* (?:Update|Add|Delete) File: (.*)\z"
    named = F.transform(pieces, lambda l: trimmed(F.regexp_extract(trimmed(l), header, 1)))
    return F.filter(named, lambda f: f != "")


def without_patches(text: Column) -> Column:
    """The pieces of a text around patch bodies."""
    return F.split(text, r"(?s)\*\*\* Begin Patch.*?(?:\*\*\* End Patch|\z)", -1)
