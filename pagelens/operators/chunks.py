"""Heading-aware chunks of Markdown."""

from __future__ import annotations

import re

FRONT = re.compile(r"\A---\n.*?\n---\n+", re.S)
HEADING = re.compile(r"(#{1,6}) +(.+?) *\Z")


def blocks(markdown: str):
    """(kind, value): headings as (level, title); code, table and text blocks as strings."""
    lines = FRONT.sub("", markdown).split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        start = i
        if line.startswith("```"):
            i += 1
            while i < len(lines) and not lines[i].startswith("```"):
                i += 1
            i = min(len(lines), i + 1)
            yield "code", "\n".join(lines[start:i])
        elif line.startswith(("|", "[Table:")):
            while i < len(lines) and lines[i].startswith(("|", "[Table:", "Row ")):
                i += 1
            yield "table", "\n".join(lines[start:i])
        elif m := HEADING.match(line):
            i += 1
            yield "heading", (len(m[1]), m[2])
        elif line.strip():
            while i < len(lines) and lines[i].strip() and not lines[i].startswith(("```", "|", "[Table:")) and not (i > start and HEADING.match(lines[i])):
                i += 1
            yield "text", "\n".join(lines[start:i])
        else:
            i += 1


def chunk(markdown: str, title: str = "", most: int = 180, least: int = 50) -> list[dict]:
    """Sections in parts of up to `most` words; code and tables whole; short parts join a neighbour of their section. No word is lost."""
    path: list[tuple[int, str]] = []
    parts: list[tuple[str, tuple]] = []
    held: list[str] = []

    def flush():
        if text := "\n".join(held).strip():
            parts.append((text, tuple(path)))
        held.clear()

    for kind, value in blocks(markdown):
        if kind == "heading":
            flush()
            while path and path[-1][0] >= value[0]:
                path.pop()
            path.append(value)
            continue
        if held and sum(len(h.split()) for h in held) + len(value.split()) > most:
            flush()
        held.append(value)
    flush()
    if parts and sum(len(t.split()) for t, _ in parts) < least:
        parts = [("\n\n".join(t for t, _ in parts), ())]
    else:
        parts = _joined(parts, least)
    out = []
    for text, stack in parts:
        names = [t for t in (title, *(h for _, h in stack)) if t]
        names = [t for k, t in enumerate(names) if k == 0 or t != names[k - 1]]
        out.append({"text": text, "embed_text": "\n".join(x for x in (" > ".join(names), text) if x), "heading_path": names, "depth": len(stack), "words": len(text.split()), "index": len(out)})
    return out


def _joined(parts: list[tuple[str, tuple]], least: int) -> list[tuple[str, tuple]]:
    """A short part goes back to the part before it in its section, else into the next one under its parent, until none can move."""
    before = None
    while parts != before:
        before, out, i = parts, [], 0
        while i < len(parts):
            text, stack = parts[i]
            if len(text.split()) >= least:
                out.append(parts[i])
            elif out and out[-1][1] == stack:
                out[-1] = (out[-1][0] + "\n\n" + text, stack)
            elif i + 1 < len(parts) and parts[i + 1][1][: len(stack[:-1])] == stack[:-1]:
                parts = [*parts[: i + 1], (text + "\n\n" + parts[i + 1][0], parts[i + 1][1]), *parts[i + 2 :]]
            else:
                out.append(parts[i])
            i += 1
        parts = out
    return parts


def packed(text: str, size: int = 200) -> list[str]:
    """Paragraphs put together up to `size` ASCII words and numbers, for retrieval; a longer paragraph is cut between words. No word is lost."""
    count = lambda t: len(re.findall("[a-z0-9]+", t.lower()))
    out: list[str] = []
    held: list[str] = []
    room = size
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            continue
        n = count(line)
        if n > room and held:
            out.append("\n".join(held))
            held, room = [], size
        if n <= size:
            held.append(line)
            room -= n
            continue
        part: list[str] = []
        used = 0
        for w in line.split():
            k = count(w)
            if part and used + k > size:
                out.append(" ".join(part))
                part, used = [], 0
            part.append(w)
            used += k
        held, room = [" ".join(part)], size - used
    return [*out, "\n".join(held)] if held else out
