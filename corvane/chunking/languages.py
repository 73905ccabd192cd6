"""What the lexer has to know about each language; all fixed values."""

from __future__ import annotations

import re
from dataclasses import dataclass

_DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_CHAR = r"'(?:\\[^\n][^'\n]{0,8}|[^'\\\n])'"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_SLASHES = r"//[^\n]*"
_NAME = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    #: Comments and strings; comments are the named groups line and block.
    tokens: str
    #: What stands on the line before the name of a function in its head; group var if the name stands there.
    before: str
    #: Lines that may stand between a comment and its function.
    attribute: str = r"(?!)"
    #: The head of a type: groups kind, name and bases.
    type_head: str = r"(?!)"
    #: How nesting is written: braces, indent or words.
    nesting: str = "braces"
    namespace: str = r"(?!)"
    #: The comment that documents a declaration above it.
    doc_line: str = r"//+!?"
    #: What follows the closing bracket of a function's parameters.
    after: str = ""


#: Words before a bracket, or before a name, that make it no head of a function.
NOT_CALLED = frozenset(
    "if for foreach while switch catch using lock fixed return new else await throw yield do try delete typeof sizeof match super elseif until with and or"
    " not in case goto co_await co_return static_assert assert print".split()
)

CSHARP = Language(
    "csharp",
    (".cs",),
    rf'(?P<line>{_SLASHES})|(?P<block>{_BLOCK})|\$?@\$?"(?:[^"]|"")*"?|\$?{_DOUBLE}|{_CHAR}',
    r"\s*(?:\[[^\]\n]*\]\s*)*(?:[\w<>\[\],.?*]+[ \t]+)*",
    r"^[ \t]*\[",
    rf"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|unsafe|new)[ \t]+)*(?P<kind>class|struct|interface|enum|record(?:[ \t]+(?:class|struct))?)[ \t]+(?P<name>{_NAME})(?:<[^>\n{{]*>)?(?:[ \t]*\([^)]*\))?\s*(?::\s*(?P<bases>[^{{;]*?))?(?:\s*where\b[^{{;]*)?\s*[{{;]",
    namespace=r"^[ \t]*namespace[ \t]+(?P<name>[\w.]+)",
    after=r"\s*(?::\s*(?:base|this)\s*\([^{};]*)?(?:where\b[^{};]*)?\s*(?:\{|=>)",
)
CPP = Language(
    "cpp",
    (".cpp", ".cc", ".h", ".hpp", ".cxx"),
    rf'(?P<line>{_SLASHES})|(?P<block>{_BLOCK})|R"(?P<raw>[^()\s\\]{{0,16}})\([\s\S]*?\)(?P=raw)"|{_DOUBLE}|{_CHAR}',
    r"\s*(?:template\s*<[^\n]*>\s*)?(?:[\w:<>,\[\]]+[ \t*&]+)*",
    r"^[ \t]*(?:\[\[|template\b)",
    rf"^[ \t]*(?:template[ \t]*<[^\n]*>[ \t]*)?(?P<kind>class|struct|enum(?:[ \t]+(?:class|struct))?|union)[ \t]+(?:\w+[ \t]+)?(?P<name>{_NAME})(?:[ \t]+final)?\s*(?::\s*(?P<bases>[^{{;]*?))?\s*\{{",
    namespace=r"^[ \t]*namespace[ \t]+(?P<name>[\w:]+)\s*\{",
    after=r"(?:\s*(?:const|noexcept|override|final)\b)*\s*(?:->[^{;\n]*)?\s*(?:\{|:\s*\w)",
)
PYTHON = Language(
    "python",
    (".py",),
    r'(?P<line>\#[^\n]*)|(?P<block>(?<![\w)\]"\'])[rRuUbBfF]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)))|' + f"{_DOUBLE}|{_SINGLE}",
    r"\s*(?:async[ \t]+)?def[ \t]+",
    r"^[ \t]*@",
    r"^[ \t]*(?P<kind>class)[ \t]+(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]*(?:\((?P<bases>[^()]*(?:\([^()]*\)[^()]*)*)\))?[ \t]*:",
    nesting="indent",
    doc_line=r"#+",
    after=r"\s*(?:->[^\n]*)?:",
)
_SCRIPT_TOKENS = rf"(?P<line>{_SLASHES})|(?P<block>{_BLOCK})|{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*`?"
_SCRIPT_BEFORE = r"\s*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set|declare)[ \t]+)*\*?[ \t]*(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*|(?:const|let|var)[ \t]+(?P<var>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function[ \t]*)?)?"
_SCRIPT_AFTER = r"\s*(?::[^=;{\n]*)?\s*(?:=>|\{)"
JAVASCRIPT = Language(
    "javascript",
    (".js", ".jsx", ".mjs", ".cjs"),
    _SCRIPT_TOKENS,
    _SCRIPT_BEFORE,
    r"^[ \t]*@\w",
    rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?P<kind>class)[ \t]+(?P<name>{_NAME})(?:[ \t]+extends[ \t]+(?P<bases>[^{{]+?))?\s*\{{",
    after=_SCRIPT_AFTER,
)
TYPESCRIPT = Language(
    "typescript",
    (".ts", ".tsx"),
    _SCRIPT_TOKENS,
    _SCRIPT_BEFORE,
    r"^[ \t]*@\w",
    rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:const[ \t]+)?(?P<kind>class|interface|enum|type)[ \t]+(?P<name>{_NAME})(?:<[^>\n{{]*>)?(?P<bases>[ \t]+(?:extends|implements)[ \t]+[^{{]+?)?\s*[{{=]",
    after=_SCRIPT_AFTER,
)
LUA = Language(
    "lua",
    (".lua",),
    rf"(?P<block>--\[(?P<eq>=*)\[[\s\S]*?(?:\](?P=eq)\]|\Z))|(?P<line>--[^\n]*)|\[(?P<eq2>=*)\[[\s\S]*?(?:\](?P=eq2)\]|\Z)|{_DOUBLE}|{_SINGLE}",
    r"\s*(?:local[ \t]+)?(?:function[ \t]+|(?P<var>[\w.]+)[ \t]*=[ \t]*)",
    type_head=rf"^[ \t]*(?:local[ \t]+)?(?P<name>{_NAME}(?:\.{_NAME})*)[ \t]*=[ \t]*(?P<kind>class|Class|(?:\w+[.:])?extend)[ \t]*\((?P<bases>[^)]*)\)",
    nesting="words",
    doc_line=r"---?",
    after=r"",
)
RUST = Language(
    "rust",
    (".rs",),
    rf'(?P<line>{_SLASHES})|(?P<block>{_BLOCK})|r(?P<sharp>\#*)"[\s\S]*?"(?P=sharp)|"(?:\\[\s\S]|[^"\\])*"?|{_CHAR}',
    r"\s*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+",
    r"^[ \t]*#!?\[",
    r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?P<kind>struct|enum|trait|union|impl)\b(?:<[^>\n]*>)?[ \t]+(?:(?P<bases>[\w:<>, ]+?)[ \t]+for[ \t]+)?(?P<name>\w+)",
    after=r"[^{;]*[{;]",
)
GO = Language(
    "go",
    (".go",),
    rf"(?P<line>{_SLASHES})|(?P<block>{_BLOCK})|{_DOUBLE}|`[^`]*`?|{_CHAR}",
    r"func[ \t]*(?:\([^()\n]*\)[ \t]*)?",
    type_head=r"^[ \t]*type[ \t]+(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]+(?P<kind>struct|interface)\b",
    namespace=r"^package[ \t]+(?P<name>\w+)",
    after=r"[^\n]*",
)

LANGUAGES = {x.name: x for x in (CSHARP, CPP, PYTHON, JAVASCRIPT, TYPESCRIPT, LUA, RUST, GO)}
BY_EXTENSION = {e: x for x in LANGUAGES.values() for e in x.extensions}

_COMPILED: dict[str, dict[str, re.Pattern]] = {}


def patterns(language: Language) -> dict[str, re.Pattern]:
    """Compiled once in each process."""
    made = _COMPILED.get(language.name)
    if made is None:
        made = _COMPILED[language.name] = {
            "tokens": re.compile(language.tokens),
            "before": re.compile(language.before),
            "after": re.compile(language.after),
            "attribute": re.compile(language.attribute),
            "type": re.compile(language.type_head, re.M),
            "namespace": re.compile(language.namespace, re.M),
        }
    return made


def language_of(path: str | None) -> Language | None:
    dot = path.rfind(".") if path else -1
    return BY_EXTENSION.get(path[dot:].lower()) if dot >= 0 else None
