"""Comments, strings and function heads of a source text."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from corvane.chunking.languages import NOT_CALLED, Language, patterns

_NOT_NEWLINE = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()]")
_CALL = re.compile(r"(?<![\w$.:~])(#?[A-Za-z_$~][\w$]*(?:(?:::|\.|:)~?[A-Za-z_$][\w$]*)*)?(?:<[^<>()\n]*>)?[ \t]*\(")
_DELIMITER = re.compile(r"[;{}\n]")
_BRACES = re.compile(r"[{}]")
_WORDS = re.compile(r"\b(?:function|if|do|repeat|end|until)\b")
_BLANKS = re.compile(r"\s*")
_LINE_END = re.compile(r"\r\n?")


def with_newlines(text: str) -> str:
    """text with \\n as its only line end."""
    return _LINE_END.sub("\n", text) if "\r" in text else text


@dataclass
class Comment:
    """A comment block that stands alone on its lines: neighbouring line comments are one."""

    first: int
    last: int
    text: str
    is_string: bool = False


@dataclass
class Function:
    name: str
    args: str
    #: The line of the head's first character and of the end of the head.
    line: int
    head_end: int
    start: int
    #: Where its body ends; the head's end if it has none.
    end: int = 0
    #: What stands before the name in the head, and the qualifier before it in Lua and C++ (or Go's receiver).
    lead: str = ""
    owner: str = ""


@dataclass
class Type:
    """A declared type; bases are the names after its colon or keyword, as they stand."""

    name: str
    kind: str
    bases: list[str]
    line: int
    start: int
    #: Where its body begins and ends; both are the end of the head if it has none.
    body: int
    end: int


class Scanned:
    """A text with line ends made uniform, comments and strings blanked out, and where they were."""

    def __init__(self, text: str, language: Language):
        self.text = text = with_newlines(text)
        self.language = language
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        masked, at, self.comments = [], 0, []
        for m in patterns(language)["tokens"].finditer(text):
            start, end = m.span()
            kind = m.lastgroup
            masked.append(text[at:start])
            if m.group("line") is not None or m.group("block") is not None:
                masked.append(_NOT_NEWLINE.sub(" ", text[start:end]))
                self._add(start, end, m.group("line") is not None)
            elif end - start >= 2 or kind:
                masked.append(text[start] + _NOT_NEWLINE.sub(" ", text[start + 1 : end - 1]) + text[end - 1])
            else:
                masked.append(text[start:end])
            at = end
        masked.append(text[at:])
        self.masked = "".join(masked)

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def _add(self, start: int, end: int, is_line: bool) -> None:
        first, last = self.line_of(start), self.line_of(max(start, end - 1))
        if self.text[self.starts[first] : start].strip():
            return  # it follows code on its line
        after = self.text[end : self.starts[last + 1] - 1]
        if after.strip():
            return
        is_string = self.language.nesting == "indent" and not is_line
        body = self.text[start:end]
        if is_line and self.comments and self.comments[-1].last == first - 1 and not self.comments[-1].is_string:
            self.comments[-1].text += "\n" + body
            self.comments[-1].last = last
        else:
            self.comments.append(Comment(first, last, body, is_string))

    def _pairs(self, tokens: re.Pattern, openers: frozenset[str]) -> dict[int, int]:
        """Where the partner of each opening token ends, in one pass; openers without one have none."""
        closes, stack = {}, []
        for m in tokens.finditer(self.masked):
            if m.group() in openers:
                stack.append(m.start())
            elif stack:
                closes[stack.pop()] = m.end()
        return closes

    def _dedents(self) -> list[int]:
        """For each line the end of the last solid line below it that is indented further, or of itself."""
        ends, stack, last = [0] * len(self.lines), [], 0
        for number, line in enumerate(self.masked.split("\n")):
            solid = line.strip()
            if not solid:
                continue
            indent = len(line) - len(line.lstrip())
            while stack and stack[-1][1] >= indent:
                ends[stack.pop()[0]] = last
            stack.append((number, indent))
            last = self.starts[number] + len(self.lines[number])
        for number, _ in stack:
            ends[number] = last
        return ends

    def _body_end(self, function: Function, close: int, bodies: dict[int, int] | list[int]) -> int:
        """Where the body that follows the closing bracket of a head's parameters ends."""
        text = self.masked
        if self.language.nesting == "indent":
            return max(bodies[self.line_of(close)], bodies[function.line], self.starts[function.head_end] + len(self.lines[function.head_end]))
        if self.language.nesting == "words":
            at = text.rfind("function", function.start, close)
            return bodies.get(at, len(text))
        opening, stop, arrow = text.find("{", close), text.find(";", close), text.find("=>", close)
        line_end = self.starts[self.line_of(close) + 1] - 1
        if arrow >= 0 and (opening < 0 or arrow < opening) and (stop < 0 or arrow < stop) and text[arrow + 2 :arrow + 200].lstrip()[:1] != "{":
            return stop + 1 if stop >= 0 and (stop < line_end or self.language.name == "csharp") else line_end
        if opening < 0 or 0 <= stop < opening:
            return stop + 1 if stop >= 0 else line_end
        return bodies.get(opening, len(text))

    def _bodies(self) -> dict[int, int] | list[int]:
        if self.language.nesting == "indent":
            return self._dedents()
        return self._pairs(_BRACES, frozenset("{")) if self.language.nesting == "braces" else self._pairs(_WORDS, frozenset(("function", "if", "do", "repeat")))

    def types(self) -> list[Type]:
        """Declared types outside comments and strings, in order. Rust's impl blocks are types of kind impl; a Lua class has
        no body of its own."""
        out, text, bodies = [], self.masked, self._bodies()
        for m in patterns(self.language)["type"].finditer(text):
            found = m.groupdict()
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            line = self.line_of(start)
            if self.language.nesting == "indent":
                body, end = m.end(), max(bodies[line], bodies[self.line_of(m.end() - 1)], m.end())
            elif self.language.nesting == "words":
                body = end = m.end()
            else:
                opening = m.end() - 1 if text[m.end() - 1] in "{;" else min((x for x in (text.find("{", m.end()), text.find(";", m.end())) if x >= 0), default=-1)
                body, end = (opening, bodies.get(opening, len(text))) if opening >= 0 and text[opening] == "{" else (m.end(), max(opening + 1, m.end()))
            bases = [b.strip() for b in re.split(r",(?![^<(]*[>)])|\bimplements\b|\bextends\b", found.get("bases") or "")]
            if self.language.name == "cpp":
                bases = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)*", "", b) for b in bases]
            out.append(Type(found["name"], " ".join(found["kind"].split()), [b for b in bases if b and "=" not in b], line, start, body, end))
        return out

    def functions(self) -> list[Function]:
        """Heads of functions outside comments and strings, in order; time is linear in the text."""
        before, after = patterns(self.language)["before"], patterns(self.language)["after"]
        joined = self.language.name in ("lua", "cpp")  # names there may have owners
        out, closes, text, inside = [], self._pairs(_BRACKET, frozenset("(")), self.masked, -1
        delimiters = [m.end() for m in _DELIMITER.finditer(text)]
        bodies = self._bodies()
        for m in _CALL.finditer(text):
            called, opening = m.group(1) or "", m.end() - 1
            close = closes.get(opening, 0) - 1
            if close < 0 or opening < inside or called in NOT_CALLED or (not joined and re.search("[.:]", called)):
                continue
            name_at = m.start(1) if called else opening
            line = self.line_of(name_at)
            at = bisect_right(delimiters, name_at)
            start = delimiters[at - 1] if at else 0
            if called in ("function", "func"):
                name_at, called = opening, ""
            fits = before.fullmatch(text, min(_BLANKS.match(text, start).end(), name_at), name_at)
            if fits is None or NOT_CALLED.intersection(text[start:name_at].split()) or not after.match(text, close + 1):
                continue
            name = called or fits.groupdict().get("var")
            if not name or (self.language.name == "lua" and called and "function" not in text[start:name_at]):
                continue
            if self.language.name == "rust" or after.pattern in ("", r"[^\n]*"):
                end = close
            else:
                end = after.match(text, close + 1).end() - 1
            parts, lead = re.split(r"[.:]+", name), text[start:name_at].strip()
            receiver = re.search(r"\(\s*(?:\w+\s+)?\*?(\w+)", lead) if self.language.name == "go" else None
            made = Function(parts[-1], self.text[opening + 1 : close], line, self.line_of(end), start, lead=lead, owner=receiver[1] if receiver else ".".join(parts[:-1]))
            made.end = self._body_end(made, close, bodies)
            out.append(made)
            inside = close
        return out

    def first_line_of_head(self, function: Function) -> int:
        """The line of the function's first attribute, or of its head."""
        attribute, line = patterns(self.language)["attribute"], function.line
        while line and attribute.match(self.lines[line - 1]):
            line -= 1
        return line
