"""A tolerant reading of HTML as lines of text, each with the container it stands in."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TOKEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<!?(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"(\w+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
#: Elements that end a line; what stands in other elements belongs to the line around it.
BLOCK = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr table tbody thead section article main aside nav header footer font center br dd dt dl form fieldset blockquote pre body html head title td th option".split())
CONTAINER = frozenset("div ul ol table section article main aside nav header footer font center form td dl fieldset blockquote body".split())
VOID = frozenset("br hr img input meta link col area base".split())


class Line(NamedTuple):
    text: str
    tag: str
    block: int
    links: int
    tags: int


class Page(NamedTuple):
    title: str
    lines: list[Line]
    #: For each block the number of its parent block and the signatures from the outermost to itself.
    parents: list[int]
    paths: list[str]


def squeeze(text: str) -> str:
    return " ".join(text.split())


def read(source: str) -> Page:
    """The title, the lines, and the tree of containers of one page. Unclosed elements end with their container."""
    lines: list[Line] = []
    parents, paths = [-1], [""]
    stack: list[tuple[str, int]] = []  # open elements with the block they open, or -1
    title, text, links, tags, tag = "", [], 0, 0, ""
    in_title = in_row = in_link = False
    block = 0

    def end() -> None:
        nonlocal text, links, tags, tag
        if text:
            line = "".join(text)
            line = "\t".join(squeeze(c) for c in line.split("\x00") if c.strip()) if "\x00" in line else squeeze(line)
            if line.strip():
                lines.append(Line(line, tag, block, min(links, len(line)), max(tags, 1)))
        text, links, tags, tag = [], 0, 0, ""

    for m in TOKEN.finditer(source):
        close, name, attributes, chars = m.group(2), m.group(3), m.group(4), m.group(5)
        if chars is not None:
            chars = html.unescape(chars)
            if in_title:
                title += chars
            elif chars.strip() or text:
                text.append(chars)
                if in_link:
                    links += len(chars.strip())
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "title":
            in_title = not close
            continue
        if name == "a":
            in_link = not close
        tags += 1
        if name in ("td", "th") and in_row:
            if close:
                text.append("\x00")
            elif len(stack) > 1:
                text.append("")
            if attributes and "=" in attributes or not in_row:
                pass
        if name not in BLOCK:
            continue
        if name == "tr":
            in_row = not close
        if not (name in ("td", "th") and in_row):
            if close or text:
                end()
        if not close and name not in CONTAINER:
            tag = name
        if name in CONTAINER and name != "body":
            if close:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == name:
                        block = parents[stack[at][1]]
                        del stack[at:]
                        break
            else:
                own = "".join(f".{k}={v.strip(chr(34) + chr(39))}" for k, v in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
                parents.append(block)
                paths.append(f"{paths[block]}/{name}{own}")
                block = len(parents) - 1
                stack.append((name, block))
    end()
    return Page(squeeze(title), lines, parents, paths)
