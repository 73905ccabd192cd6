"""Files cut into chunks by the rules of their language.

Every chunker takes the path and text of one file and gives its chunks. register_chunker adds one for other endings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from corvane.chunking.languages import LANGUAGES, Language, language_of
from corvane.chunking.lexer import Function, Scanned, Type, with_newlines

#: Files of fewer lines aren't cut; members of fewer lines are no chunks of their own where that is the rule.
SMALL_FILE = 150
LEAST_MEMBER = 3
LARGE_ASSET = 500
MOST_OBJECTS = 200
MINIFIED = 200

# Names of constructors, elements that divide a page, and languages whose short functions are left out.
CONSTRUCTORS = ("__init__", "__new__", "constructor", "ctor", "new")
LANDMARKS = ("header", "nav", "main", "section", "article", "aside", "footer")
_PROPERTY = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|new)[ \t]+)+[\w<>\[\],.?]+[ \t]+(\w+)\s*(\{|=>)")
_ASSET_HEADER = re.compile(r"(?m)^--- !u!(\d+) &(-?\d+)([^\n]*)$")


@dataclass
class Chunk:
    class_name: str
    method_name: str | None
    chunk_type: str
    start_line: int
    end_line: int
    source: str
    namespace: str = ""
    doc_comment: str = ""
    base_types: list[str] = field(default_factory=list)


def stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.replace("\\", "/").rsplit("/", 1)[-1])


def n_lines(text: str) -> int:
    return text.count("\n") + 1


def _whole(path: str, text: str, name: str | None = None, doc: str = "") -> Chunk:
    return Chunk(name or stem(path), None, "whole_class", 1, n_lines(text), text, doc_comment=doc)


class _Source:
    """A scanned file with what its chunks have in common."""

    def __init__(self, path: str, text: str, language: Language):
        self.path, self.language, self.code = path, language, Scanned(text, language)
        self.types, self.functions = self.code.types(), self.code.functions()
        found = self.code.language.namespace != "(?!)" and re.compile(language.namespace, re.M).search(self.code.masked)
        self.namespace = found["name"] if found else self._of_path()
        self.comments = {c.last: c for c in self.code.comments}

    def _of_path(self) -> str:
        parts = [p for p in re.sub(r"\.[^./]*$", "", self.path.replace("\\", "/")).split("/") if p and p != "."]
        if self.language.name == "python":
            return ".".join(p for p in parts if p != "__init__")
        if self.language.name == "rust":
            return "::".join(p for p in (parts[1:] if parts[:1] == ["src"] else parts) if p != "mod")
        return ""

    def doc(self, line: int, head_end: int) -> tuple[str, int]:
        """The documentation of a declaration, and the line where it or the first attribute begins."""
        attribute, first = re.compile(self.language.attribute), line
        while first and attribute.match(self.code.lines[first - 1]):
            first -= 1
        above = self.comments.get(first - 1)
        if above is not None and not above.is_string:
            return above.text, above.first
        inside = next((c for c in self.code.comments if c.is_string and c.first == head_end + 1), None)
        return (inside.text if inside else ""), first

    def chunk(self, kind: str, owner: str, name: str | None, part: Type | Function, bases: list[str] = ()) -> Chunk:
        head_end = part.head_end if isinstance(part, Function) else self.code.line_of(part.body)
        doc, first = self.doc(part.line, head_end)
        last = self.code.line_of(max(part.end - 1, part.start))
        return Chunk(owner, name, kind, first + 1, last + 1, "\n".join(self.code.lines[first : last + 1]), self.namespace, doc, list(bases))

    def head(self, part: Type | Function) -> str:
        """A declaration up to its body, in one line."""
        stop = part.body if isinstance(part, Type) else max(self.code.starts[part.head_end] + len(self.code.lines[part.head_end]), part.start)
        return " ".join(re.split(r"\{|=>", self.code.text[part.start : max(stop, part.start + 1)])[0].split())


def _names_of_types(types: list[Type]) -> list[tuple[Type, str]]:
    """Types with their names, Outer.Inner for those one level deep; deeper ones are part of their outer type."""
    out: list[tuple[Type, str]] = []
    around: list[Type] = []
    for t in types:
        while around and around[-1].end <= t.start:
            around.pop()
        if len(around) < 2:
            out.append((t, ".".join(x.name for x in [*around, t])))
        around.append(t)
    return out


def code_chunks(path: str, text: str) -> list[Chunk]:
    """Chunks of a file in one of the eight languages.

    Types of small files, interfaces and enums are whole; of others a summary and the members are given, the inner types
    on their own. Functions outside types are chunks, too. A file with neither is one chunk; a minified script none.
    """
    language = language_of(path)
    if language is None:
        return []
    text = with_newlines(text)
    if language.name in ("javascript", "typescript") and len(text.encode("utf-8", "replace")) / n_lines(text) > MINIFIED:
        return []
    file = _Source(path, text, language)
    small = n_lines(text) < SMALL_FILE
    named = _names_of_types(file.types)
    out: list[Chunk] = []
    for t, name in named:
        whole = small or t.kind in ("enum", "interface", "type") or t.kind.startswith("enum ")
        inner = "." in name
        if t.kind == "type":
            if file.code.line_of(t.end) - t.line + 1 >= LEAST_MEMBER:
                out.append(file.chunk("function", file_owner(file), t.name, t))
        elif whole and not (small and inner):
            out.append(file.chunk("whole_class", name, None, t, t.bases))
        elif not whole:
            out.append(_summary(file, t, name))
    inside = -1  # where the outermost function before this one ends
    for f in file.functions:
        nested = f.start < inside and f.end <= inside
        inside = max(inside, f.end)
        around = [(t, name) for t, name in named if t.body <= f.start < t.end]
        owner = around[-1][1] if around else f.owner
        if around and (small or around[-1][0].kind in ("enum", "interface")):
            continue
        if nested and language.nesting != "words":
            continue  # a function inside another one
        out += _function(file, f, owner, bool(around))
    if not small:
        out += _properties(file, named)
        out += _summaries_of_owners(file, named)
    if not out:
        out = [_whole(path, text)]
        out[0].namespace = file.namespace
    return sorted(out, key=lambda c: (c.start_line, -c.end_line, c.chunk_type))


def file_owner(file: _Source) -> str:
    return stem(file.path)


def _summary(file: _Source, t: Type, name: str) -> Chunk:
    made = file.chunk("class_summary", name, None, t, t.bases)
    members = [file.head(f) + ";" for f in file.functions if t.body <= f.start < t.end]
    made.source = "\n".join([file.head(t), *("    " + m for m in members)])
    return made


def _function(file: _Source, f: Function, owner: str, inside: bool) -> list[Chunk]:
    name, language = f.name, file.language.name
    made = file.chunk("method", owner or file_owner(file), name, f)
    if made.end_line - (f.line + 1) + 1 < LEAST_MEMBER and language in ("python", "cpp"):
        return []
    if owner and (name == owner.rsplit(".", 1)[-1] or name in CONSTRUCTORS):
        made.chunk_type = "constructor"
    elif not owner and language != "cpp":
        made.chunk_type = "function"
        body = made.source
        if language in ("javascript", "typescript") and name[:1].isupper() and re.search(r"<[A-Za-z][\w.]*[\s/>]", body) and "</" in body + "/>".replace("/>", "</"):
            made.chunk_type = "component" if re.search(r"return\s*\(?\s*<", body) else "function"
    return [made]


def _properties(file: _Source, named: list[tuple[Type, str]]) -> list[Chunk]:
    if file.language.name != "csharp":
        return []
    out = []
    for m in _PROPERTY.finditer(file.code.masked):
        around = [(t, name) for t, name in named if t.body < m.start() < t.end]
        if not around or any(f.start <= m.start(1) < f.end for f in file.functions) or m[1] in [t.name for t, _ in named]:
            continue
        end = file.code._pairs(re.compile(r"[{}]"), frozenset("{")).get(m.start(2), len(file.code.text)) if m[2] == "{" else file.code.masked.find(";", m.start()) + 1
        part = Function(m[1], "", file.code.line_of(m.start(1)), file.code.line_of(m.start(2)), m.start(), end)
        made = file.chunk("property", around[-1][1], m[1], part)
        if made.end_line - part.line >= LEAST_MEMBER:
            out.append(made)
    return out


def _summaries_of_owners(file: _Source, named: list[tuple[Type, str]]) -> list[Chunk]:
    """Summaries of what two methods at least name as their owner (tables of Lua, receivers of Go), where no type does."""
    known, owners = {name for t, name in named if t.body < t.end}, {}
    for f in file.functions:
        if f.owner and f.owner not in known:
            owners.setdefault(f.owner, []).append(f)
    out = []
    for owner, functions in owners.items():
        if len(functions) >= 2:
            first, last = min(f.line for f in functions), max(file.code.line_of(max(f.end - 1, f.start)) for f in functions)
            out.append(Chunk(owner, None, "class_summary", first + 1, last + 1, "\n".join(file.head(f) for f in functions), file.namespace))
    return out


def _sections(path: str, text: str, at: list[int], kind: str, names: list[str], tail: Callable[[str], bool]) -> list[Chunk]:
    """Chunks from each of the lines to the one before the next, without lines at the end that say nothing."""
    lines, out = text.split("\n"), []
    for first, after, name in zip(at, [*at[1:], len(lines)], names):
        while after > first + 1 and tail(lines[after - 1]):
            after -= 1
        out.append(Chunk(name, None, kind, first + 1, after, "\n".join(lines[first:after])))
    return out


def markdown_chunks(path: str, text: str) -> list[Chunk]:
    """Sections at headings of level 2, else 1, if there are two at least and the file isn't small; the first tells the title."""
    text = with_newlines(text)
    lines = text.split("\n")
    for mark in ("## ", "# "):
        at = [i for i, x in enumerate(lines) if x.startswith(mark)]
        if n_lines(text) >= SMALL_FILE and len(at) >= 2:
            return _sections(path, text, at, "md_section", [lines[i][len(mark) :].strip() for i in at], lambda x: not x.strip())
    return [_whole(path, text)]


def json_chunks(path: str, text: str) -> list[Chunk]:
    """One chunk for each key of the outermost object of a large file, by the indent of the first key."""
    text = with_newlines(text)
    lines = text.split("\n")
    keys = [(i, m) for i, x in enumerate(lines) if (m := re.match(r'^([ \t]+)"((?:[^"\\]|\\.)*)"\s*:', x))]
    at = [(i, m[2]) for i, m in keys if m[1] == keys[0][1][1]]
    if n_lines(text) < SMALL_FILE or len(at) < 2 or not text.lstrip().startswith("{"):
        return [_whole(path, text)]
    return _sections(path, text, [i for i, _ in at], "json_key", [k for _, k in at], lambda x: x.strip() in ("", "}", "},"))


def yaml_chunks(path: str, text: str) -> list[Chunk]:
    """One chunk for each key in the first column of a large file."""
    text = with_newlines(text)
    at = [(i, m[1]) for i, x in enumerate(text.split("\n")) if (m := re.match(r"^([A-Za-z_][\w.-]*)\s*:", x))]
    if n_lines(text) < SMALL_FILE or len(at) < 2:
        return [_whole(path, text)]
    return _sections(path, text, [i for i, _ in at], "yaml_key", [k for _, k in at], lambda x: not x.strip())


def css_chunks(path: str, text: str) -> list[Chunk]:
    """One chunk for each outermost rule of a large file; selectors are cut to 100 characters."""
    text = with_newlines(text)
    if n_lines(text) < SMALL_FILE:
        return [_whole(path, text)]
    code = Scanned(text, LANGUAGES["javascript"])  # the same comments and strings
    ends, out, at = code._pairs(re.compile(r"[{}]"), frozenset("{")), [], 0
    for opening in sorted(ends):
        if opening < at:
            continue
        selector = " ".join(code.masked[at:opening].split(";")[-1].split())
        first = code.line_of(opening - len(code.masked[at:opening].split(";")[-1].lstrip()))
        at = ends[opening]
        last = code.line_of(at - 1)
        doc = next((c.text for c in code.comments if c.last == first - 1), "")
        name = selector[:100] + "..." if len(selector) > 100 else selector
        out.append(Chunk(name, None, "css_rule", first + 1, last + 1, "\n".join(code.lines[first : last + 1]), doc_comment=doc))
    return out or [_whole(path, text)]


class _Page(HTMLParser):
    """Title, scripts and landmarks with an id of a page, with their lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self._open, self._in_title = "", [], [], False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._in_title = tag == "title"
        if tag in LANDMARKS or tag in ("script", "template"):
            self._open.append((tag, dict(attrs).get("id"), self.getpos(), self.get_starttag_text() or ""))

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data

    def handle_endtag(self, tag: str) -> None:
        self._in_title = False
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                name, ident, start, head = self._open.pop(at)
                self.parts.append((name, ident, start, head, self.getpos(), len(self._open)))
                return


def html_chunks(path: str, text: str) -> list[Chunk]:
    """The page under its title, or if it is large its landmarks with an id, and its scripts as scripts."""
    text = with_newlines(text)
    page = _Page()
    page.feed(text)
    name, lines = page.title.strip() or stem(path), text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    offset = lambda pos: starts[pos[0] - 1] + pos[1]
    out, scripts = [], []
    component = path.lower().endswith(".vue")
    marks = [p for p in page.parts if (p[0] == "template" if component else p[0] in LANDMARKS and p[1])]
    if component or n_lines(text) >= SMALL_FILE and len(marks) >= 2:
        for tag, ident, start, _, end, depth in marks:
            if not depth:
                out.append(Chunk(name if component else f"{name}#{ident}", None, "template", start[0], end[0], "\n".join(lines[start[0] - 1 : end[0]])))
    for tag, _, start, head, end, _ in page.parts:
        begin = offset(start) + len(head)
        body = text[begin : offset(end)]
        if tag == "script" and len(body.strip()) >= 10:
            shift = text.count("\n", 0, begin)
            for c in code_chunks(stem(path) + ".js", body):
                c.start_line, c.end_line = c.start_line + shift, c.end_line + shift
                scripts.append(c)
    return [*(out or [Chunk(name, None, "template", 1, n_lines(text), text)]), *scripts]


def asset_chunks(path: str, text: str) -> list[Chunk]:
    """A summary of an asset's objects, each below its parent with its components, and of large assets chunks of the objects.

    An asset without objects is one chunk, a scriptable_object if it has a component. Links are by the ids in the text;
    each object is listed once, even where they lead around.
    """
    text = with_newlines(text)
    heads = list(_ASSET_HEADER.finditer(text))
    if not heads:
        return yaml_chunks(path, text)
    objects, children, parent_of, components = {}, {}, {}, {}
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        body = text[m.end() : after]
        get = lambda pattern: (re.search(pattern, body) or [None, ""])[1]  # noqa: B023, E731
        kind, owner = int(m[1]), get(r"(?m)^  m_GameObject: \{fileID: (-?\d+)")
        if kind == 1:
            if "stripped" not in m[3] or get(r"(?m)^  m_Name: *(\S[^\n]*)"):
                objects[m[2]] = (get(r"(?m)^  m_Name: *([^\n]*)").strip() or m[2], m.start(), after)
        elif kind in (4, 224):
            parent_of[m[2]] = (owner, get(r"(?m)^  m_Father: \{fileID: (-?\d+)"))
        else:
            guid = get(r"m_Script: *\{[^}]*guid: *([0-9a-fA-F]{32})")
            components.setdefault(owner, []).append(f"[{guid[:8]}...]" if guid else get(r"(?m)^(\w+):[ \t]*$") or f"Component_{kind}")
    for owner, father in parent_of.values():
        children.setdefault(parent_of[father][0] if father in parent_of else "", []).append(owner)
    if not objects:
        kind = "scriptable_object" if any(components.values()) else "whole_class"
        return [Chunk(stem(path), None, kind, 1, n_lines(text), text)]
    below = {owner for owner, father in parent_of.values() if father in parent_of}
    shown, seen = [], set()
    stack = [(o, 0) for o in reversed([o for o in objects if o not in below] or list(objects)[:1])]
    while stack:
        at, depth = stack.pop()
        if at in seen or at not in objects:
            continue
        seen.add(at)
        held = components.get(at, [])
        shown.append("  " * (depth + 1) + objects[at][0] + (f" [{', '.join(held)}]" if held else ""))
        stack += [(o, depth + 1) for o in reversed(children.get(at, []))]
    bases = list(dict.fromkeys(c for held in components.values() for c in held))[:20]
    out = [Chunk(stem(path), None, "prefab_summary", 1, n_lines(text), "\n".join([f"// Asset: {stem(path)}", *shown]), base_types=bases)]
    if n_lines(text) > LARGE_ASSET and any(components.values()):
        for key, (name, start, after) in list(objects.items())[:MOST_OBJECTS]:
            first, last = text.count("\n", 0, start) + 1, text.count("\n", 0, after - 1) + 1
            out.append(Chunk(stem(path), name, "gameobject", first, last, text[start:after].rstrip("\n"), base_types=components.get(key, [])[:20]))
    return out


Chunker = Callable[[str, str], list[Chunk]]
CHUNKERS: dict[str, Chunker] = {
    **{e: code_chunks for language in LANGUAGES.values() for e in language.extensions},
    **dict.fromkeys((".md", ".markdown"), markdown_chunks),
    ".json": json_chunks,
    **dict.fromkeys((".yaml", ".yml"), yaml_chunks),
    **dict.fromkeys((".css", ".scss", ".less"), css_chunks),
    **dict.fromkeys((".html", ".htm", ".vue"), html_chunks),
    **dict.fromkeys((".prefab", ".unity", ".asset"), asset_chunks),
}


def register_chunker(ending: str, chunker: Chunker) -> None:
    """Use chunker for files with that ending (with its dot); it is shipped to the workers with each operator that uses it."""
    CHUNKERS[ending.lower()] = chunker


def chunk_file(path: str | None, text: str | None, chunkers: dict[str, Chunker] = CHUNKERS) -> Iterator[Chunk]:
    """The chunks of one file; none for null texts, blank ones and endings without a chunker."""
    ending = re.search(r"\.[^./\\]+$", path or "")
    made = chunkers.get(ending.group().lower()) if ending else None
    if made is not None and text and text.strip():
        yield from made(path.replace("\\", "/"), text)
