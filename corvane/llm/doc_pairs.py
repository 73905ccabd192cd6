"""Functions paired with their documentation.

The comments of a text that stand alone on their lines, and its docstrings, are candidates; functions are found by their
heads. A candidate may belong to a function whose head (with its attributes) follows it, or whose body it opens. The
pairs are weighted by distance, by the parameters their tags name and by the function's name, and a heaviest assignment
gives each function and each comment one partner at most. Pairs whose text says nothing, and those further apart whose
tags name no parameter, are rejected before that. All of it needs one chunk only, so the corpus isn't shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.chunking.languages import LANGUAGES, language_of
from corvane.chunking.lexer import Comment, Function, Scanned
from corvane.functions.keys import normal_label, normal_path

# What documentation that says nothing looks like.
OWN_TYPES = ("method", "function", "constructor")
WHOLE_TYPE = "whole_class"
_CONSTRUCTORS = ("constructor", "ctor", "__init__", "new")
_FILLERS = frozenset(
    "a an the this that it its of to for and or is in on with method function func procedure routine constructor ctor destructor"
    " calls call called invokes invoke runs run does do performs perform executes execute handles handle implements implementation"
    " creates create creating new instance object class gets get sets set returns return param params parameter parameters args"
    " arg argument arguments void none null any int string bool value values type self cls summary remarks brief".split()
)
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|hack|tbd|tbc|wip)\b.{0,40}|n\s*/?\s*a|none|placeholder|description|documentation|undocumented|no (?:docs?|documentation|description|comment)|(?:to be|not yet) (?:documented|described|written|done|defined)"
    r"|(?:missing|add|write|fill in|insert) (?:docs?|documentation|description|comment)s?(?: here)?|lorem ipsum.*"
    r"|see (?:the )?(?:also )?(?:base|interface|parent|super|above|below|overrid\w+|declaration|definition|header|docs?|documentation|implementation|remarks|cref)(?: (?:class|method|type|for details|file))?"
    r"|(?:same as|as|like|copied from|inherited from) (?:the )?(?:base|above|below|parent|interface|super)(?: class| method)?|[{<@\\]?\s*inherit-?doc.*|inherited|override[sn]?|<see\s*(?:also)?[^>]*>)\W*$",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\W*(?:re-?sharper\b|eslint\b|eslint-|tslint\b|jshint\b|jslint\b|prettier-ignore|pylint\b|noqa\b|type:\s*ignore|mypy:|pyright:|flake8\b|pragma\b|nolint\b|lint:|golint|go:[a-z]+|luacheck\b|clang-format|clang-tidy|cppcheck|nosonar\b|nosec\b|istanbul\b|c8 ignore|v8 ignore|ts-(?:ignore|nocheck|expect-error|check)|@ts-\w+|stylelint|rubocop|coverage:|fmt:\s*(?:on|off|skip)|isort:|yapf:|black:|rustfmt\b|clippy::|allow\(|deny\(|cspell|spell-?checker|codeql|sonar|stylecop|suppressmessage|region\b|endregion\b|#region|#endregion|line\s+\d+\s+\"|jscpd|biome-ignore|deno-lint|swiftlint|ktlint|checkstyle|@formatter|luacov|selene:|stylua:|diagnostic\b)",
    re.I,
)
_LICENCE = re.compile(
    r"copyright\b|\(c\)\s|©|spdx-|licen[sc]e[ds]?\b|all rights reserved|permission is hereby granted|without warrant|redistribution and use|part of [\w .-]+\. see |\blicen[sc]e\b",
    re.I,
)
_TAG_LINE = re.compile(r"^[@\\](?P<tag>[A-Za-z]+)\b:?\s*(?P<rest>.*)$", re.S)
_PARAM_TAGS = frozenset("param arg argument parameter tparam typeparam field property prop".split())
_RETURN_TAGS = frozenset("return returns retval result throws exception raises type rtype".split())
_XML = re.compile(r"</?(?:summary|remarks|para|returns|value|example|c|code|b|i|p|br|em|strong|list|item|term|description|typeparam|exception|paramref|see|seealso|inheritdoc)\b[^>]*>", re.I)
_XML_PARAM = re.compile(r"<(?:param|typeparam)\s+name\s*=\s*[\"'](?P<name>[^\"']*)[\"']\s*>(?P<rest>.*?)(?:</(?:param|typeparam)>|$)", re.I | re.S)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")
_MARKS = re.compile(r"^\s*(?:///?!?|//!|/\*+!?|\*+/|\*(?!\*)|#+!?|--+\[=*\[|---?|\]=*\])\s?")
_CODE_END = re.compile(r"[;{}]\s*$|^\s*[)}\]]+[;,]?\s*$|^\s*end\s*$")
_CODE = re.compile(r"^\s*(?:(?:var|let|const|local|auto|int|bool|float|string|std::\w+|return|if|for|while|foreach|else|elif|def|func|fn|function|import|from|using|await|self|this|print|delete|throw|raise|yield)\b.*[=(;{:]|[\w.:\[\]\"']+\s*(?:[-+*/|&]?=|:=|\+=)\s*\S|[\w.:>-]+\([^)]*\)\s*;?\s*$)")


#: So many blank lines may stand between a comment and its function.
MAX_GAP = 2


def name_words(name: str | None) -> list[str]:
    """The words of an identifier, in lower case."""
    return [w.lower() for w in _CAMEL.findall(name or "")]


def doc_lines(raw: str) -> list[str]:
    """The lines of a comment or docstring without its marks."""
    text = raw.replace("\r\n", "\n").replace("\r", "\n").strip()
    m = re.match(r"^[rRuUbBfF]{0,2}(\"\"\"|''')", text)
    if m:
        text = text[m.end() :].removesuffix(m.group(1))
    lines = []
    for line in text.split("\n"):
        line = _MARKS.sub("", line, count=1)
        line = re.sub(r"\s*\*+/\s*$|\s*\]=*\]\s*$", "", line)
        lines.append(line.rstrip())
    return lines


def parameter_names(args: str) -> list[str]:
    """The names of parameters in the text between the brackets of a head."""
    names, depth, part = [], 0, []
    for char in args + ",":
        if char == "," and depth <= 0:
            piece = re.split(r"=(?!>)", "".join(part))[0]
            left, colon, _ = piece.partition(":") if "::" not in piece else (piece, "", "")
            words = re.findall(r"[^\W\d]\w*", left)
            if words:
                go_like = not colon and len(words) == 2 and words[1] in ("int", "string", "error", "bool", "float64", "any")
                names.append(words[0] if go_like else words[-1])
            part = []
        else:
            depth += (char in "([{<") - (char in ")]}>")
            part.append(char)
    return names


def says_something(raw: str | None, name: str | None, args: str = "", owner: str | None = None) -> bool:
    """Whether documentation says more than the function's name and parameters.

    Marks and tags aside, each line is left out that is a placeholder, pointer, tool directive, divider, licence notice
    or code; what is left must hold a word beyond the name, the parameters and words that carry nothing. A constructor's
    name is that of its class, the owner, too.
    """
    if not raw or not raw.strip():
        return False
    known = set(_FILLERS)
    own = name_words(name)
    known.update(own)
    known.add("".join(own))
    for p in parameter_names(args):
        known.update(name_words(p))
        known.add(p.lower())
    if owner and name and (name in _CONSTRUCTORS or name.removeprefix("New") == owner):
        known.update(name_words(owner))
        known.add("".join(name_words(owner)))
    lines, licence = [], False
    for line in doc_lines(raw):
        bare = line.strip()
        if not bare:
            licence = False
            continue
        if _LICENCE.search(bare) and (licence or len(bare) < 200):
            licence = True
            continue
        lines.append(line)
    code = sum(bool(_CODE_END.search(x) or _CODE.match(x)) for x in lines if x.strip())
    if lines and code * 2 >= len(lines) and _is_code(lines):
        return False
    for line in lines:
        bare = line.strip()
        if _DIRECTIVE.match(bare) or _PLACEHOLDER.match(_XML.sub(" ", bare).strip() or "none") or _PLACEHOLDER.match(bare):
            continue
        for text in _told(bare, known):
            if _PLACEHOLDER.match(text.strip()) or _DIRECTIVE.match(text.strip()):
                continue
            if any(not _is_known(w, known) for w in _WORD.findall(text)):
                return True
    return False


def _is_code(lines: list[str]) -> bool:
    """Lines that are statements, with no sentence among them."""
    for line in lines:
        if line.strip() and not (_CODE_END.search(line) or _CODE.match(line)):
            words = re.findall(r"[^\W\d_]{2,}", line)
            if len(words) >= 4 and not re.search(r"[(){};=\[\]]", line):
                return False
    return True


def _is_known(word: str, known: set[str]) -> bool:
    low = word.lower()
    return low in known or low.isdigit() or all(part in known for part in name_words(word)) or (len(low) > 3 and low.endswith("s") and low[:-1] in known)


def _told(line: str, known: set[str]) -> Iterator[str]:
    """The parts of a line that describe something, without tags and the names they carry."""
    for m in _XML_PARAM.finditer(line):
        known.update(name_words(m["name"]))
        yield _XML.sub(" ", m["rest"])
    line = _XML.sub(" ", _XML_PARAM.sub(" ", line)).strip()
    line = re.sub(r"^\{?@(?:inherit\w*|see|link)\b[^}]*\}?", " ", line, flags=re.I).strip()
    m = _TAG_LINE.match(line)
    if not m:
        yield line
        return
    tag, rest = m["tag"].lower(), m["rest"]
    if tag in ("see", "inheritdoc", "override", "author", "version", "since", "date", "copyright", "license", "todo", "file", "module", "namespace", "class", "method", "function", "name", "ignore", "private", "public", "internal", "static", "deprecated", "noinspection", "suppress", "ts", "formatter"):
        return
    rest = re.sub(r"^\[[a-z, ]*\]|\{[^}]*\}", " ", rest).strip()
    if tag in _PARAM_TAGS:
        words = rest.split(None, 1)
        if words:
            known.update(name_words(words[0]))
        rest = words[1] if len(words) > 1 else ""
        rest = re.sub(r"^(?:any|number|string|boolean|table|integer|function|nil|int|bool)\b(?:\[\])?\??\s*", "", rest)
    yield rest


def _tags(raw: str) -> set[str]:
    """The parameters that a comment's tags name."""
    found = re.findall(r"[@\\]param(?:\[[a-z, ]*\])?\s+(?:\{[^}]*\}\s*)?\[?([^\W\d]\w*)", raw)
    return {*found, *re.findall(r"<param\s+name\s*=\s*[\"'](\w+)", raw), *re.findall(r":param\s+(?:\w+\s+)?(\w+)\s*:", raw)}


def _weight(comment: Comment, function: Function, head: int, scanned: Scanned) -> int:
    """How well a comment fits a function; 0 is implausible.

    A docstring is the first thing below the head. A comment above may be MAX_GAP blank lines away, if its tags then
    name a parameter; no code may stand between, nor before the head on its line.
    """
    gap = 0
    if comment.is_string:
        below = function.head_end + 1
        while below < comment.first and not scanned.lines[below].strip():
            below += 1
        if comment.first != below:
            return 0
    elif not function.line > comment.last >= head:
        gap = head - 1 - comment.last
        between = scanned.text[scanned.starts[function.line] : function.start]
        if not 0 <= gap <= MAX_GAP or between.strip() or any(line.strip() for line in scanned.lines[comment.last + 1 : head]):
            return 0
    names, tags = set(parameter_names(function.args)), _tags(comment.text)
    if gap and not tags & names:
        return 0
    return 8 - 2 * gap + 2 * len(tags & names) - len(tags - names) + (function.name in comment.text)


def assign(weights: dict[tuple[int, int], int]) -> dict[int, int]:
    """A heaviest assignment of functions (first numbers) to comments (second), as function to comment.

    Functions come in one by one; each takes the way of exchanges that gains most, to a free comment or to a function
    that goes without. What was heaviest before is so again after each, so the last is heaviest of all. Weights that
    aren't above 0 are never taken.
    """
    options: dict[int, dict[int, int]] = {}
    for (f, c), w in sorted(weights.items()):
        if w > 0:
            options.setdefault(f, {})[c] = w
    of: dict[int, int] = {}  # comment to function
    for f in options:
        gain, came = dict(options[f]), dict.fromkeys(options[f], -1)
        waiting = list(gain)
        while waiting:
            c = waiting.pop(0)
            if c in of:
                holder = options[of[c]]
                for other, w in holder.items():
                    better = gain[c] - holder[c] + w
                    if other != c and better > gain.get(other, 0):
                        gain[other], came[other] = better, c
                        waiting.append(other)
        ends = [(gain[c] - (options[of[c]][c] if c in of else 0), c) for c in gain]
        best, c = max(ends, key=lambda x: (x[0], -x[1]))
        if best > 0:
            while c != -1:
                before = came[c]
                of[c] = of[before] if before != -1 else f
                c = before
    return {f: c for c, f in of.items()}


def _partners(scanned: Scanned, owner: str | None) -> tuple[list[Function], dict[int, int]]:
    """The functions of a text and their comments, by number."""
    functions = scanned.functions()
    weights: dict[tuple[int, int], int] = {}
    near: dict[int, list[int]] = {}
    for c, comment in enumerate(scanned.comments):
        for line in range(comment.first - 3, comment.first + 1) if comment.is_string else range(comment.last + 1, comment.last + 2 + MAX_GAP):
            near.setdefault(line, []).append(c)
    for f, function in enumerate(functions):
        head = scanned.first_line_of_head(function)
        lines = {head, function.head_end, *range(head + 1, function.line + 1)}
        for c in {c for line in lines for c in near.get(line, ())}:
            w = _weight(scanned.comments[c], function, head, scanned)
            if w > 0 and says_something(scanned.comments[c].text, function.name, function.args, owner):
                weights[f, c] = w
    return functions, assign(weights)


def _told_by(comment: Comment) -> str:
    return "\n".join(doc_lines(comment.text)).strip()


def documented_functions(text: str, path: str | None, owner: str | None = None) -> list[tuple[str, str, str]]:
    """name, documentation and code (the head to the end of its body) of each function with telling documentation."""
    language = language_of(path)
    if language is None or not text:
        return []
    scanned = Scanned(text, language)
    functions, chosen = _partners(scanned, owner)
    code = lambda f: scanned.text[f.start : max(f.end, f.start)].strip("\n")
    return [(functions[f].name, _told_by(scanned.comments[chosen[f]]), code(functions[f])) for f in sorted(chosen)]


def own_documentation(text: str, path: str | None, name: str | None, doc: str | None, owner: str | None = None) -> str | None:
    """The telling documentation of a chunk that is a function: doc_comment, or if that is blank what its source holds.

    The function is the first of that name in the source, else the first of all; where none is found, the comment that
    begins the source stands for it.
    """
    language = language_of(path) or LANGUAGES["csharp"]
    if doc and doc.strip():
        m = re.search(r"\b" + re.escape(name) + r"\s*(?:<[^>\n]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)", text) if name else None
        return "\n".join(doc_lines(doc)).strip() if says_something(doc, name, m.group(1) if m else "", owner) else None
    scanned = Scanned(text, language)
    functions = scanned.functions()
    if not functions:
        lead = [c for c in scanned.comments if not any(line.strip() for line in scanned.lines[: c.first])]
        return _told_by(lead[0]) if lead and says_something(lead[0].text, name, "", owner) else None
    own = next((f for f, function in enumerate(functions) if function.name == name), 0)
    chosen = _partners(scanned, owner)[1]
    return _told_by(scanned.comments[chosen[own]]) if own in chosen else None


def function_doc_pairs(chunks: DataFrame, key: str = "chunk_no") -> DataFrame:
    """key, method_name, description, code: each function of chunks with documentation that says something.

    chunks has chunk_type, file_path, class_name, method_name, source and doc_comment. A chunk of type method, function or
    constructor is a function; one of type whole_class gives each function in its source under its bare name. Types
    compare without case and surrounding blanks; other types and null types or sources give nothing. A row that occurs
    twice gives its pairs twice; an empty table gives none; other columns are ignored.
    """
    kind = normal_label(F.col("chunk_type"))
    slim = chunks.select(
        F.col(key).alias("__key"), kind.alias("__kind"), normal_path(F.col("file_path")).alias("__path"), F.col("method_name").alias("__name"), F.col("source").alias("__text"), F.col("doc_comment").alias("__doc"), F.col("class_name").alias("__owner")
    ).where(F.col("__kind").isin(*OWN_TYPES, WHOLE_TYPE) & F.col("__text").isNotNull())
    schema = f"`{key}` {chunks.schema[key].dataType.simpleString()}, method_name string, description string, code string"

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, kind, path, name, text, doc, owner in zip(*(batch[c] for c in ("__key", "__kind", "__path", "__name", "__text", "__doc", "__owner"))):
                if kind == WHOLE_TYPE:
                    out += [(k, *found) for found in documented_functions(text, path, owner)]
                else:
                    told = own_documentation(text, path, name, doc, owner)
                    if told is not None:
                        out.append((k, name, told, text))
            yield pd.DataFrame(out, columns=[key, "method_name", "description", "code"])

    return slim.mapInPandas(pair, schema)
