"""What the user is told beside results."""

from __future__ import annotations

import shlex

WARNINGS = {
    "Empty": "nothing is embedded yet: only keywords are searched",
    "ModelMismatch": "the index was made with another model: embed again",
    "LegacyChunking": "the index was cut in another way: embed again",
    "Stale": "documents were synced after the last embedding: new text is found by keywords only",
}


def freshness_warning(state: str) -> str | None:
    return WARNINGS.get(state)


def command_line(command: str, query: str, **options) -> str:
    """The command that would do this; options at their defaults are left out by the caller as None."""
    words = [command, query]
    for name, value in options.items():
        if value is True:
            words.append(f"--{name.replace('_', '-')}")
        elif value not in (None, False):
            words += [f"--{name.replace('_', '-')}", str(value)]
    return shlex.join(words)


def grep_hint(query: str, keyword_total: int, shown: int, **options) -> str | None:
    """Where the other keyword matches are, if there are more than were shown."""
    return f"{keyword_total} meetings hold these words: {command_line('grep', query, **options)}" if keyword_total > shown else None


def ambiguous_speaker(pattern: str, names: list[str]) -> str | None:
    return f"{pattern!r} stands for {', '.join(names)}" if len(names) > 1 else None
