"""Many words at the cost of one: hashed look-up tables as literals, tries as regular expressions, and phrases by a walk.

A table is one literal, whatever its size: entries lie in slots by the CRC-32 of their key, and a look-up reads one slot. A
pattern of many words shares what they begin with, so that a place in a text is left at the first letter that fits none.
Phrases are a trie of words in such a table; it is walked from the tokens that begin one, as far as they go.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


class Table:
    """Values by string key. ``fields``: names and types of a value, as in a schema."""

    def __init__(self, entries: dict[str, tuple], fields: str):
        names = [f.split()[0] for f in fields.split(", ")]
        self.size = max(1, len(entries))
        slots: list[list[dict]] = [[] for _ in range(self.size)]
        for key, values in entries.items():
            slots[zlib.crc32(key.encode()) % self.size].append({"key": key, **dict(zip(names, values, strict=True))})
        schema = ", ".join(f.replace(" ", ":", 1) for f in fields.split(", "))
        self.column = F.from_json(F.lit(json.dumps(slots)), f"array<array<struct<key:string,{schema}>>>")

    def get(self, key: Column) -> Column:
        """The entry of a key, or null."""
        return F.get(F.filter(F.get(self.column, (F.crc32(key) % self.size).cast("int")), lambda x: x["key"] == key), 0)


def _escaped(char: str) -> str:
    return "\\" + char if not char.isalnum() and not char.isspace() and char.isascii() else f"[{char}]" if char.isspace() else char


def pattern(words: list[str], letter=_escaped) -> str:
    """A regular expression of any of the ``words``, the longest where one begins another. ``letter`` writes one character."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        chain = ""
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            chain += letter(c)
        rest = [letter(c) + written(x) for c, x in sorted(node.items()) if c]
        if not rest:
            return chain
        return f"{chain}(?:{'|'.join(rest)})" + ("?" if "" in node else "")

    return written(root)


class Phrases:
    """Phrases of normalised words, each shown in its own way; of equal ones the first holds. Any number, of any length."""

    def __init__(self, phrases: list[tuple[str, list[str]]]):
        nodes: dict[tuple[str, ...], int] = {(): 0}
        shown: dict[tuple[str, ...], str] = {}
        for display, words in phrases:
            shown.setdefault(tuple(words), display)
            for k in range(1, len(words) + 1):
                nodes.setdefault(tuple(words[:k]), len(nodes))
        entries = {f"{nodes[p[:-1]]} {p[-1]}": (n, shown.get(p)) for p, n in nodes.items() if p}
        self.table, self.longest = Table(entries, "node int, display string"), max(map(len, shown), default=0)
        self.firsts = sorted({w[0] for w in shown})

    def ends(self, segments: Column, i: Column) -> Column:
        """``array<struct<display, last>>`` of the phrases that begin with the ``i``-th of alternating words and gaps: where their last words are.

        Only white space may stand between the words.
        """
        none = F.array().cast("array<struct<display:string,last:int>>")
        start = F.struct(F.lit(0).alias("node"), none.alias("out"))

        def step(s: Column, k: Column) -> Column:
            at = i + 2 * k
            close = (k == 0) | F.coalesce(F.get(segments, at - 1).rlike(r"^\s*$"), F.lit(False))
            found = F.when(close & s["node"].isNotNull(), self.table.get(F.concat_ws(" ", s["node"], T.normalize_token(F.get(segments, at)))))
            grown = lambda e: F.when(e["display"].isNotNull(), F.array_append(s["out"], F.struct(e["display"].alias("display"), at.cast("int").alias("last")))).otherwise(s["out"])
            return F.when(s["node"].isNull(), s).otherwise(T.let(found, lambda e: F.struct(e["node"].alias("node"), grown(e).alias("out"))))

        return F.aggregate(F.sequence(F.lit(0), F.lit(max(0, self.longest - 1))), start, step)["out"]


def word_runs(words: str) -> list[str]:
    return re.findall(r"\w+", words.lower())
