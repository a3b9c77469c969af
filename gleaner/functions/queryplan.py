"""What a search text asks for: its language, what it excludes, known phrases, intent and prompts. Driver-side: one short text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

NEGATION = r"\b(?:without|excluding|except|but not|no)\b|不要|没有|除了"


class QueryPlan(NamedTuple):
    """``text`` to find, ``negative`` to avoid, ``language``, known phrases with their slots in order, ``intent``."""

    text: str
    negative: str
    language: str
    slots: list[tuple[str, str]]
    intent: str

    def prompts(self) -> list[tuple[str, str, float]]:
        """(prompt, evidence group, weight): the whole text, then each slot's phrases; several phrases of one slot are one group."""
        out = [(self.text, "whole-query", 1.0)]
        out += [(phrase, slot, 0.7) for phrase, slot in self.slots if phrase != self.text]
        return out


def language(text: str) -> str:
    if re.search(r"[぀-ヿ]", text):
        return "ja"
    return "zh" if re.search(r"[一-鿿]", text) else "en"


def parse(query: str, dictionary: Mapping[str, str]) -> QueryPlan:
    """Plan a query by a dictionary of phrases and their slots (``object``, ``scene``, ``colour``, ...); longer phrases win.

    One object alone is an object search, a scene alone a scene search, several slots a composed one, none an unknown one.
    """
    parts = re.split(NEGATION, query, maxsplit=1, flags=re.I)
    text, negative = parts[0].strip(), parts[1].strip() if len(parts) > 1 else ""
    low, found, taken = text.lower(), [], set()
    for phrase in sorted(dictionary, key=lambda p: (-len(p), p)):
        edge = r"\b" if phrase.isascii() else ""
        for m in re.finditer(f"{edge}{re.escape(phrase.lower())}{edge}", low):
            if not taken & set(range(*m.span())):
                taken |= set(range(*m.span()))
                found.append((m.start(), phrase, dictionary[phrase]))
    slots = [(p, s) for _, p, s in sorted(found)]
    kinds = {s for _, s in slots}
    intent = "unknown" if not kinds else "composed" if len(kinds) > 1 else next(iter(kinds)) if kinds <= {"object", "scene"} else "unknown"
    return QueryPlan(text, negative, language(query), slots, intent)
