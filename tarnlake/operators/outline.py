"""Sections of Markdown texts as (breadcrumb, text, first line, last line) parts.

Blocks are told apart as the Markdown specification does, one kind after the other over all lines: front matter, fenced
code, headings with number signs, headings with an underline. Decisions where dialects differ:

- A fence is three or more of one character, backticks or tildes, indented by anything; it is closed by at least as many
  of the same character. A fence that is never closed runs to the end.
- An underline has three characters or more. It makes a title of the line above it, if that is a line of text that
  doesn't begin with a number sign; any other such line is a rule and no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Characters of a section's text.
MOST = 800

_TICKS = re.compile(r"\s*(?P<run>(?P<tick>[`~])(?P=tick){2,})")
_SIGNS = re.compile(r" {0,3}(?P<signs>#{1,6})(?:\s+(?P<title>.*?))?(?:\s+#+)?\s*")
_RULE = re.compile(r"\s{0,3}(?P<run>[=-]{3,})\s*")


class Heading(NamedTuple):
    """Level 0 is the preamble; `body` is the line behind the title. Lines count from 1."""

    line: int
    level: int
    title: str
    body: int


def _one_line(lines: list[str]) -> str:
    return " ".join(filter(None, map(str.strip, lines)))


def _behind_front_matter(lines: list[str]) -> int:
    """The first line (from 1) that isn't part of a block between --- and --- or ... at the start."""
    if lines[:1] and lines[0].strip() == "---":
        return next((k + 1 for k, x in enumerate(lines[1:], 2) if x.strip() in ("---", "...")), 1)
    return 1


def _outside_code(lines: list[str], first: int) -> Iterator[tuple[int, str]]:
    """Numbered lines that are neither fences nor between them."""
    runs = {k: m["run"] for k, x in enumerate(lines[first - 1 :], first) if (m := _TICKS.match(x))}
    closing, code = None, set()
    for k, run in runs.items():
        if closing is None:
            closing, start = run, k
        elif run.startswith(closing):
            code.update(range(start, k + 1))
            closing = None
    if closing is not None:
        code.update(range(start, len(lines) + 1))
    return ((k, lines[k - 1]) for k in range(first, len(lines) + 1) if k not in code)


def headings(lines: list[str], first: int) -> list[Heading]:
    """All headings from line `first` on, in order."""
    plain = dict(_outside_code(lines, first))
    signs = {k: m for k, x in plain.items() if (m := _SIGNS.fullmatch(x)) and m["title"] is not None}
    rules = {k: m["run"] for k, x in plain.items() if k not in signs and (m := _RULE.fullmatch(x))}
    found = [Heading(k, len(m["signs"]), m["title"].strip(), k + 1) for k, m in signs.items() if m["title"].strip()]
    for k, run in rules.items():
        title = plain.get(k - 1, "").strip()
        if title and not title.startswith("#") and k - 1 not in rules:
            found.append(Heading(k - 1, 1 if run.startswith("=") else 2, title, k + 1))
    return sorted(found)


def outline_chunks(path: str, source: str, most: int = MOST) -> list[tuple[str, str, int, int]]:
    """One part for each heading, up to the next of its level or above, under the titles that lead to it; what stands
    before the first heading is the preamble. Texts without headings have no parts."""
    lines = source.replace("\r\n", "\n").splitlines()
    first = _behind_front_matter(lines)
    found = headings(lines, first)
    if found and _one_line(lines[first - 1 : found[0].line - 1]):
        found.insert(0, Heading(first, 0, "preamble", first))
    around: list[int] = []  # places of the headings that the one at hand stands under
    crumbs, last = [], [len(lines)] * len(found)
    for i, h in enumerate(found):
        while around and (found[around[-1]].level >= h.level or not found[around[-1]].level):
            last[around.pop()] = h.line - 1
        around.append(i)
        crumbs.append(" > ".join(found[j].title for j in around))
    texts = [_one_line(lines[h.body - 1 : max(end, h.body)]) for h, end in zip(found, last, strict=True)]
    return [(crumb, text[:most].rstrip() if most > 0 else text, h.line, end) for crumb, text, h, end in zip(crumbs, texts, found, last, strict=True)]
