"""URL filters: a bit-parallel automaton that runs all wildcard rules at once.

Rules are globs over the canonical form (lower-cased host, then path): ``*`` stands for any run of
characters without ``/``, ``**`` for any run. All rules are laid side by side in the bits of a few 64-bit
words; a Shift-And step for one character moves every state of every rule at once, over all urls of a
batch that are still that long.

Null urls and urls without ``://`` have an empty host and path and match nothing. Longer rules win;
of equally long ones the first. Equal rows give equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import pieces

#: Hosts and paths that the operator blocks by itself.
DEFAULT_BLOCK = ("**spam**", "**pills**", "**casino**", "**porn**")


class Automaton:
    """Shift-And with wildcards over byte strings; rule r's states are bits of one vector of words."""

    def __init__(self, globs: list[str]):
        parts = []
        for glob in globs:
            states, raw, i = [], glob.encode(), 0
            loops = {0: None}
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[len(states)] = "any"
                    i += 2
                elif raw[i : i + 1] == b"*":
                    loops[len(states)] = loops.get(len(states)) or "label"
                    i += 1
                else:
                    states.append(raw[i])
                    i += 1
            parts.append((states, loops))
        # state k of a rule: k characters of it are matched
        n = sum(len(states) + 1 for states, _ in parts)
        self.width = max(1, -(-n // 64))
        self.step = np.zeros((256, self.width), dtype=np.uint64)  # states that a character may lead to
        self.loop = np.zeros((256, self.width), dtype=np.uint64)  # states in which a character may stay
        self.start = np.zeros(self.width, dtype=np.uint64)
        self.finals = []
        bit = 0

        def put(row: np.ndarray, b: int) -> None:
            row[..., b // 64] |= np.uint64(1) << np.uint64(b % 64)

        for states, loops in parts:
            put(self.start, bit)
            for k in range(len(states) + 1):
                if k:
                    put(self.step[states[k - 1]], bit + k)
                if loops.get(k):
                    put(self.loop, bit + k)
                    if loops[k] == "label":
                        self.loop[ord("/"), (bit + k) // 64] &= ~(np.uint64(1) << np.uint64((bit + k) % 64))
            self.finals.append(bit + len(states))
            bit += len(states) + 1

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """matches[url, rule]"""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        long_first = length[order]
        state = np.tile(self.start, (len(length), 1))
        for i in range(int(long_first[0]) if len(length) else 0):
            live = int(np.searchsorted(-long_first, -i, side="left"))
            at = data[offsets[order[:live]] + i]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[at]) | (now & self.loop[at])
        out = np.zeros((len(length), len(self.finals)), dtype=bool)
        for r, b in enumerate(self.finals):
            out[order, r] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def globs_of(rule: str) -> list[str]:
    """A rule like ``example.net/en/`` fits its host and all hosts below it, under its path."""
    return [f"{rule}**", f"*.{rule}**"]


def judge(pages: DataFrame, rules: list[tuple[str, str]], block_globs: tuple[str, ...] = DEFAULT_BLOCK, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row. rules: (verdict, rule); others get block_globs' or the default."""
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    globs = [g for k in ranked for g in globs_of(rules[k][1])] + list(block_globs)
    names, verdicts, n = [rules[k][1] for k in ranked], [rules[k][0] for k in ranked], len(rules)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            which = np.full(batch.num_rows, n + 1, dtype=np.int64)
            for lo, hi, data, offsets in pieces(batch.column("canonical"), 1 << 22):
                hit = automaton.run(data, offsets)
                by_rule = hit[:, : 2 * n].reshape(hi - lo, n, 2).any(axis=2)
                own = hit[:, 2 * n :].any(axis=1)
                all_of = np.concatenate([by_rule, own[:, None], np.ones((hi - lo, 1), dtype=bool)], axis=1)
                which[lo:hi] = all_of.argmax(axis=1)
            rule = pa.array([*names, None, None], pa.string()).take(pa.array(which))
            verdict = pa.array([*verdicts, "block", default], pa.string()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    return parts.select("*", F.concat("host", "path").alias("canonical")).mapInArrow(match, f"page_id {kind}, host string, path string, rule string, verdict string")
