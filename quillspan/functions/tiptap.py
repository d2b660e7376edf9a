"""Rich-text trees (JSON) as Markdown: the tree is laid flat into blocks, and a table says how each kind looks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Block:
    """One block: its kind, its own attributes, its words with their marks, how deep it lies, and what its line begins with."""

    def __init__(self, kind: str, node: dict, depth: int, lead: str = ""):
        self.kind, self.depth, self.lead = kind, depth, lead
        self.attrs = node["attrs"] if isinstance(node.get("attrs"), dict) else {}
        self.words = "".join(map(_marked, _leaves(node)))

    def whole(self, name: str, least: int) -> int:
        found = self.attrs.get(name)
        return found if isinstance(found, int) and found >= least else 1


#: Fixed formats.
LOOKS: dict[str, Callable[[Block], str]] = {
    "heading": lambda b: f"{'#' * min(b.whole('level', 0), 6)} {b.words}\n\n",
    "paragraph": lambda b: f"{'  ' * b.depth}{b.words}\n\n",
    "horizontalRule": lambda b: "---\n\n",
    "line": lambda b: f"{b.lead}{b.words}\n",
    "gap": lambda b: "\n",
    "listItem": lambda b: b.words,
    "text": lambda b: b.words,
}
MARKERS: dict[str, Callable[[int], str]] = {"bulletList": lambda n: "- ", "orderedList": lambda n: f"{n}. "}


def _below(node: dict) -> list[dict]:
    found = node.get("content")
    return [c for c in found if isinstance(c, dict)] if isinstance(found, list) else []


def _leaves(node: dict) -> Iterator[dict]:
    """Nodes that hold words, in reading order."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.get("type") != "text" and isinstance(n.get("content"), list):
            todo += _below(n)[::-1]
        elif isinstance(n.get("text"), str):
            yield n


def _marked(leaf: dict) -> str:
    marks = {m.get("type"): m.get("attrs") for m in leaf.get("marks") or [] if isinstance(m, dict)}
    words = f"**{leaf['text']}**" if "bold" in marks else leaf["text"]
    target = marks["link"].get("href") if isinstance(marks.get("link"), dict) else None
    return f"[{words}]({target})" if isinstance(target, str) else words


def flat(tree: dict) -> Iterator[Block]:
    """The blocks of a tree in reading order; a node of an unknown kind is what it holds."""
    todo: list[Block | tuple[dict, int]] = [(c, 0) for c in _below(tree)[::-1]]
    while todo:
        now = todo.pop()
        if isinstance(now, Block):
            yield now
            continue
        node, depth = now
        kind = node.get("type")
        if kind in MARKERS:
            todo += _listed(node, depth)[::-1]
        elif kind in LOOKS or not isinstance(node.get("content"), list):
            yield Block(kind if kind in LOOKS else "text", node, depth)
        else:
            todo += [(c, depth) for c in _below(node)[::-1]]


def _listed(node: dict, depth: int) -> list[Block | tuple[dict, int]]:
    """A list's lines and the lists inside its items; a gap ends the outermost."""
    first = node["attrs"].get("start") if isinstance(node.get("attrs"), dict) else None
    out: list[Block | tuple[dict, int]] = []
    for n, item in enumerate(_below(node), first if isinstance(first, int) else 1):
        marker = MARKERS[node["type"]](n)
        for k, part in enumerate(_below(item)):
            lead = marker if k == 0 else " " * len(marker) if part.get("type") == "paragraph" else None
            out.append((part, depth + 1) if part.get("type") in MARKERS else Block("line", part, depth, "" if lead is None else "  " * depth + lead))
    return out + ([] if depth else [Block("gap", {}, 0)])


def to_markdown(tree: str | None) -> str | None:
    """Markdown of a document tree; null of what isn't one."""
    try:
        doc = json.loads(tree) if tree else None
    except ValueError:
        return None
    return "".join(LOOKS[b.kind](b) for b in flat(doc)).rstrip() if isinstance(doc, dict) else None


@F.pandas_udf(StringType())
def tiptap_markdown(trees: pd.Series) -> pd.Series:
    return trees.map(to_markdown)
