"""Runs apart from the caller: a detached process, and the shell commands that call for a run."""

from __future__ import annotations

import re
import subprocess
import sys

#: Commands of version control after which files differ from what was written here (fixed list).
CHANGING = ("pull", "fetch", "merge", "rebase", "checkout", "switch", "commit", "reset", "clone", "stash", "cherry-pick", "am", "revert")
_PARTS = re.compile(r"&&|\|\||;|\|")


def changes_files(command: str) -> bool:
    """Whether a shell line runs a git command that changes files; of ``stash`` only ``pop`` and ``apply`` do."""
    for part in _PARTS.split(command):
        words = iter(part.split())
        if "git" not in words:  # leaves the words behind it
            continue
        rest = list(words)
        while rest and rest[0].startswith("-"):
            rest = rest[2 if rest[0] in ("-C", "-c") else 1 :]
        if rest and rest[0] in CHANGING and (rest[0] != "stash" or rest[1:2] in (["pop"], ["apply"])):
            return True
    return False


def detached(arguments: list[str]) -> int:
    """Starts ``python -m loamdex`` with some arguments in a session of its own; gives its process id."""
    p = subprocess.Popen([sys.executable, "-m", "loamdex", *arguments], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    return p.pid
