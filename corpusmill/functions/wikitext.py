"""Reading wiki markup: spans of nested constructs, sections, templates, links and plain text.

One pass over the tokens of a text matches openers and closers with a stack, so nesting of any depth takes linear time. Openers
without a closer stay ordinary text. Everything here is a pure function of a string; null and empty strings give nothing.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(nowiki|pre|syntaxhighlight|source|math)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|\{\{\{|\}\}\}|\{\{|\}\}|\[\[|\]\]|(?:^|(?<=\n))[ \t:]*\{\||(?:^|(?<=\n))[ \t]*\|\}", re.S | re.I)
_closer = {"}}}": "{{{", "}}": "{{", "]]": "[["}
_heading = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*(?:<!--.*?-->[ \t]*)?$", re.M)
_ref = re.compile(r"<ref\b([^>]*?)(?:/>|>(.*?)</ref\s*>)", re.S | re.I)
_external = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]]*))?\]", re.I)
_tag = re.compile(r"</?[a-zA-Z][^<>]*>")
_ticks = re.compile(r"'{2,5}")
_behavior = re.compile(r"__[A-Z]{3,}__")


class Span(NamedTuple):
    start: int
    end: int
    kind: str  # template, argument, link, table, comment, or the name of a raw tag
    depth: int


def spans(text: str) -> list[Span]:
    """All matched constructs in order of their start; depth counts the constructs around each."""
    open_: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {"{{": [], "[[": [], "{|": []}  # of each kind's openers in open_; "{{" has both sorts of braces
    found: list[tuple[int, int, str]] = []
    names = {"{{": "template", "{{{": "argument", "[[": "link", "{|": "table"}
    from_ = 0
    while m := _token.search(text, from_):
        t, from_ = m.group(), m.end()
        if t.startswith("<!--"):
            found.append((m.start(), m.end(), "comment"))
        elif m.group(1):
            found.append((m.start(), m.end(), m.group(1).lower()))
        elif t in ("{{", "{{{", "[["):
            places[t[:2]].append(len(open_))
            open_.append((t, m.start()))
        elif t.endswith("{|"):
            places["{|"].append(len(open_))
            open_.append(("{|", m.end() - 2))
        else:
            want = "{|" if t.endswith("|}") else _closer[t]
            if not (own := places[want[:2]]):
                continue
            back, end = own[-1], m.end()
            have, at = open_[back]
            if have == "{{" and want == "{{{":  # "}}}" closes a template and leaves a brace, which can close another
                end = from_ = end - 1
            for k, _ in open_[back:]:
                places[k[:2]].pop()
            del open_[back:]
            found.append((at, end, names[have]))
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[Span] = []
    around: list[int] = []
    for a, b, kind in found:
        while around and around[-1] <= a:
            around.pop()
        out.append(Span(a, b, kind, len(around)))
        around.append(b)
    return out


def split_top(body: str, sep: str = "|") -> list[str]:
    """Split at separators that are not inside a nested construct."""
    if sep not in body:
        return [body]
    covered = [(s.start, s.end) for s in spans(body) if s.depth == 0]
    parts, last, k = [], 0, 0
    for m in re.finditer(re.escape(sep), body):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start():
            continue
        parts.append(body[last : m.start()])
        last = m.end()
    return [*parts, body[last:]]


def normal_name(name: str) -> str:
    """Template and title names compare without regard to case, underscores and runs of white space."""
    return " ".join(name.replace("_", " ").split()).casefold()


class Template(NamedTuple):
    name: str
    params: list[tuple[str | None, str]]  # positional parameters have no name
    raw: str
    depth: int
    start: int
    end: int

    def get(self, *names: str) -> str | None:
        """The first present of several parameters; "1" and so on are positions."""
        positional = [v for k, v in self.params if k is None]
        for n in names:
            for k, v in self.params:
                if k == n:
                    return v
            if n.isdigit() and int(n) <= len(positional):
                return positional[int(n) - 1]
        return None


def template_at(text: str, span: Span) -> Template:
    head, *rest = split_top(text[span.start + 2 : span.end - 2])
    params: list[tuple[str | None, str]] = []
    for p in rest:
        name, eq, value = p.partition("=")
        named = eq and not re.search(r"[\[{<]", name)
        params.append((name.strip(), value.strip()) if named else (None, p.strip()))
    return Template(re.sub(r"<!--.*?-->", "", head, flags=re.S).strip(), params, text[span.start : span.end], span.depth, span.start, span.end)


def templates(text: str | None) -> list[Template]:
    """All templates, nested ones included, in order of their start."""
    return [template_at(text, s) for s in spans(text) if s.kind == "template"] if text else []


def links(text: str | None) -> list[tuple[str, str]]:
    """(target, display) of the internal links in document order; the display of an unpiped link is its target."""
    out = []
    for s in spans(text or ""):
        if s.kind == "link":
            target, *display = split_top(text[s.start + 2 : s.end - 2])
            out.append((target.strip(), display[-1].strip() if display else target.strip()))
    return out


def references(text: str | None) -> list[tuple[str, str | None]]:
    """(attributes, body) of the reference tags; a self-closing one has no body."""
    return [(m.group(1).strip(), m.group(2)) for m in _ref.finditer(text or "")]


def headings(text: str) -> list[re.Match]:
    """Heading lines outside of comments, templates, tables and raw tags."""
    covered = [(s.start, s.end) for s in spans(text) if s.depth == 0 and s.kind != "link"]
    out, k = [], 0
    for m in _heading.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if not (k < len(covered) and covered[k][0] <= m.start()):
            out.append(m)
    return out


class Section(NamedTuple):
    seq: int
    path: str
    level: int
    body: str


def sections(text: str | None, levels: tuple[int, ...] = (2, 3)) -> list[Section]:
    """The lede with path "" and a section for each heading of the given levels; a deeper one has the path "A > B"."""
    if text is None:
        return []
    marks = [m for m in headings(text) if len(m.group(1)) in levels]
    out = [Section(0, "", 0, text[: marks[0].start()] if marks else text)]
    trail: dict[int, str] = {}
    for i, m in enumerate(marks):
        level = len(m.group(1))
        trail = {k: v for k, v in trail.items() if k < level} | {level: plain(m.group(2))}
        body = text[m.end() : marks[i + 1].start() if i + 1 < len(marks) else len(text)]
        out.append(Section(i + 1, " > ".join(v for _, v in sorted(trail.items())), level, body))
    return out


def is_infobox(t: Template) -> bool:
    """Structural test: a top-level template all of whose parameters are named."""
    return t.depth == 0 and bool(t.params) and all(k for k, _ in t.params)


_DROPPED = ("category:", "file:", "image:")


def plain(text: str | None) -> str:
    """Text without markup: links become their displays, templates, references and comments go, table cells are kept apart."""
    if not text:
        return ""
    text = _ref.sub("", text)
    while all_spans := spans(text):  # links and tables from the inside out, until none is left; each round shortens the text
        out, last = [], 0
        for i, s in enumerate(all_spans):
            if s.start < last:
                continue
            if s.kind not in ("template", "argument", "comment") and i + 1 < len(all_spans) and all_spans[i + 1].start < s.end:
                continue
            out.append(text[last : s.start])
            body = text[s.start : s.end]
            if s.kind == "link":
                target, _, display = body[2:-2].partition("|")
                if not target.strip().lower().startswith(_DROPPED):
                    out.append(display.rpartition("|")[2] if display else target.lstrip(":"))
            elif s.kind == "table":
                out.append("\n".join(table_rows(body)))
            elif s.kind in ("nowiki", "pre", "syntaxhighlight", "source", "math"):
                out.append(re.sub(r"^<[^>]*>|</[^>]*>$", "", body))
            last = s.end
        out.append(text[last:])
        text = "".join(out)
    text = _external.sub(lambda m: m.group(1) or "", text)
    text = _behavior.sub("", _ticks.sub("", _tag.sub("", text)))
    text = _heading.sub(r"\2", text)
    return html.unescape(text).strip()


def _cells(line: str) -> list[str]:
    """The cells of a table line behind its first mark. Two bars or exclamation marks part them; of a cell with attributes the part behind its bar counts."""
    cells, start, at = [], 0, 0
    while at < len(line):
        if line[at : at + 2] in ("||", "!!"):
            cells.append(line[start:at])
            start = at = at + 2
        else:
            at += 1
    cells.append(line[start:])
    out = []
    for cell in cells:
        attributes, bar, content = cell.rpartition("|")
        cell = (content if bar and "=" in attributes else cell).strip()
        name, is_, value = cell.partition("=")
        alone = bool(is_) and not any(c.isspace() for c in value) and all(c.isalnum() or c in "_- " for c in name) and name != ""
        if cell and not alone:
            out.append(cell)
    return out


def table_rows(raw: str) -> list[str]:
    """Lines of the cells of a wiki table, and its caption; layout marks and attributes are dropped."""
    rows = []
    for line in map(str.strip, raw.split("\n")):
        mark = line[:2]
        if mark == "|+":
            rows.append(line[2:].strip())
        elif mark in ("{|", "|}", "|-"):
            continue
        else:
            rows.append("; ".join(_cells(line[1:])) if line[:1] in ("|", "!") else line)
    return [r for r in rows if r]


def clean_residue(text: str) -> str:
    """Plain text without what can be left of broken tables; runs of blanks become one, and runs of empty lines one."""
    out: list[str] = []
    inside = False
    for line in text.split("\n"):
        mark = line.strip()[:2]
        inside = (inside or mark == "{|") and mark != "|}"
        lines = table_rows(line) if inside or mark[:1] == "|" or mark == "{|" else [" ".join(w for w in line.replace("\t", " ").split(" ") if w)]
        out += [x for k, x in enumerate(lines) if x or (out and out[-1])]
    return "\n".join(out).strip()
