"""Texts that lost their end at a field limit or in transfer.

A stack automaton reads each whole text, once, and tells what is still open at its end: brackets, quotes, code spans,
fences, markup, block comments and strings. In prose, what a paragraph or list item leaves open ends with it; in code,
the layout tells which openers are strays: a bracket isn't open at a line that stands further left than its own. Broken
multibyte sequences, escapes and marks of a cut end a text as well. Whether a missing terminator means anything is a
matter of the source, over all its distinct texts: lengths at which they pile up are its limits, and a sentence without
its terminator was cut only where the source ends most of them. Where nothing else decides, a last word is a broken one
if it is no word that texts hold inside but the beginning of one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.skew import salted_join
from corvane.session import cut_lineage

# Terminators of sentences and what may follow them; marks that a cut leaves; beginnings of entities.
TERMINATORS = ".!?。！？।؟"
_CLOSERS = "\"'»”’)]}`*_>」』】"
_MARK = re.compile(r"(?:\[(?:cut|truncated|snip(?:ped)?|clipped)\]|<(?:cut|truncated|snip)>|\(truncated\))\s*$", re.I)
_DOTS = re.compile(r"(?:\.\.\.|…)\s*$")
_ENTITIES = ("amp;", "quot;", "apos;", "nbsp;")
_ESCAPE_START = re.compile(r"(?<![\\:])\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?|)$")
_ENTITY_START = re.compile(r"&(?:([a-z]{2,5})|#x?[0-9a-fA-F]*)$")
_PERCENT_START = re.compile(r"%[0-9a-fA-F]{2}\S*%[0-9a-fA-F]?$")
_INVISIBLE = dict.fromkeys([0x200B, 0x2060, 0x00AD, 0xFEFF])

# What a line of code looks like, and lines of prose that need no terminator (by their form, not their words).
_CODE_HINT = re.compile(r"[;{}]\s*$|^\s*(?:def|class|function|local|return|import|from|using|namespace|package|func|fn|pub|public|private|protected|export|const|let|var|if|for|while|end|else|elif|try|except|type|struct|impl|#include|self\.|this\.|@|//|#|--)\b|^\s*[\w.:\[\]\"']+\s*(?::=|=)\s|^\s*[\w.:]+\(.*\)\s*;?$")
_COMMENT_LINE = re.compile(r"^\s*(?://|#|--|\*|/\*)")
_PYTHON_END = re.compile(r"^\s*(?:return\b|raise\b|pass\b|yield\b|break\b|continue\b|[\w.\[\]\"']+\s*(?:[-+*/|&]?=)\s*\S|[\w.]+\(.*\)|\"\"\"|''')")
_PYTHON_BLOCK = re.compile(r"(?m)^\s*(?:def |class |async def )[^\n]*:\s*$|\ndef ")
_COMPLETE_LINE = re.compile(r"^\s*(?:\|.*\||-{3,}|={3,}|\*{3,}|<\|\w+\|>|https?://\S+|[-*+] .*|\w[\w .-]{0,20}:\s*\S*|\[\w+\]:?.*)\s*$")
_TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
_LONG_ITEM = re.compile(r"^\s*(?:[-*+]|\d+\.)\s+(?:\S+\s+){4,}\S*$")
_NAMED_ITEM = re.compile(r"^\s*[-*+] `[^`]*`:")
_FIELD = re.compile(r"^\s+[\w$]+:\s+\S+$|^\s*[\w$]+:\s*\S*$")
_TAIL_WORD = re.compile(r"[^\W\d_]+\Z")

_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)((?:\s[^<>]*|/)?)(?:(>)|\Z)")
_CLOSED_TAGS = frozenset("a b i u em strong code pre div span ul ol table tr td th h1 h2 h3 h4 h5 h6 summary remarks details section article body html head".split())
_BLOCKS = frozenset(f"<{x}" for x in "pre div ul ol table tr summary remarks details section article body html".split()) | {"```", "<!--"}
_PROSE_TOKEN = re.compile(r"(?m)(?P<fence>^[ \t>]*(?:`{3,4}|~{3,4})(?![`~]))|(?P<gap>\n[ \t\r>]*\n|\n[ \t>]*(?:[-*+]|\d+[.)]|#{1,6})[ \t])|(?P<note><!--)|(?P<tag></?[a-zA-Z])|[(\[{«“)\]}»”`\"]")
_FENCE_END = re.compile(r"(?m)^[ \t>]*(?:`{3,4}|~{3,4})(?![`~])")
_CODE_TOKEN = re.compile(r"\"\"\"|'''|[\"'`()\[\]{}]|/\*|(?<!\S)--\[=*\[|(?<!:)//|(?<!\S)--(?=[\s-]|\Z)|(?<!\S)#")
_NEWLINE, _LEAD = re.compile("\n"), re.compile(r"[ \t\r\f\v]*")
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*("?)')
_SINGLE = re.compile(r"'(?:\\.|[^'\\\n])*('?)")

#: A length is a limit of a source if this many of its distinct texts have it, beyond EXPECTED times those of a usual length nearby.
LEAST_AT_LIMIT = 5
EXPECTED = 8
NEARBY = 32

#: A last word is whole if so many distinct texts hold it inside for each that ends with it.
KNOWN_WORD = 3

#: A missing terminator tells of a cut in sources where at most this share of the texts off their limits lacks it.
USUAL_UNENDED = 0.5

#: The last word of a text, also before the marks and broken characters of a cut (in Java's syntax, in linear time).
_LAST_WORD = (
    r"(?<!\p{L})(\p{L}++)(?:\s*+(?:\.\.\.|…|(?i:\[(?:cut|truncated|snip(?:ped)?|clipped)\]|<(?:cut|truncated|snip)>|\(truncated\))|�|\\u[0-9a-fA-F]{0,3}"
    r"|\\x[0-9a-fA-F]?|\\|&(?:[a-zA-Z]{1,6}|#x?[0-9a-fA-F]{0,6})|%[0-9a-fA-F]?|\x{200D}))*+\s*+\z"
)


class _Stack(list):
    """What is open, as (opener, offset, indent); counts tell at once that an opener isn't there."""

    def __init__(self) -> None:
        super().__init__()
        self.counts: Counter[str] = Counter()

    def push(self, opener: str, at: int, indent: int = 0) -> None:
        self.append((opener, at, indent))
        self.counts[opener] += 1

    def keep(self, kept: frozenset[str]) -> None:
        """Takes all but the kept openers off."""
        if len(self) and any(n and o not in kept for o, n in self.counts.items()):
            self[:] = [x for x in self if x[0] in kept]
            self.counts = Counter(x[0] for x in self)

    def close(self, opener: str, indent: int | None = None) -> None:
        """Takes the last such opener, or the last at that indent, and all inside it off, if there is one."""
        if not self.counts[opener]:
            return
        at = len(self) - 1
        if indent is not None:
            while at >= 0 and not (self[at][0] == opener and self[at][2] == indent):
                at -= 1
        if indent is None or at < 0:
            at = len(self) - 1
            while self[at][0] != opener:
                at -= 1
        for x in self[at:]:
            self.counts[x[0]] -= 1
        del self[at:]


class _Lines:
    """How far the line of an offset is indented, and whether the offset is its first solid character."""

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}
        self.starts = [0, *(m.end() for m in _NEWLINE.finditer(text))]

    def indent(self, at: int) -> tuple[int, bool]:
        n = bisect_right(self.starts, at) - 1
        if n not in self.known:
            lead = _LEAD.match(self.text, self.starts[n])
            self.known[n] = (len(lead.group().expandtabs(4)), lead.end())
        width, solid = self.known[n]
        return width, solid == at


def open_in_code(text: str) -> list[tuple[str, int, int]]:
    """The automaton's stack at the end of code: what is open, at which offset, and the indent of that line.

    Strings end with their line, but for those of three quotes and backticks; comments hold no brackets. A closer at the
    beginning of a line closes the opener of the same indent, if there is one, and all inside it.
    """
    stack, lines = _Stack(), _Lines(text)
    at, n = 0, len(text)
    while m := _CODE_TOKEN.search(text, at):
        token, i, at = m.group(), m.start(), m.end()
        if token in ('"""', "'''", "`", "/*") or token[:3] == "--[":
            end = text.find({"/*": "*/"}.get(token, token) if token[:3] != "--[" else token[2:].replace("[", "]"), at)
            if end < 0:
                return [*stack, (token, i, 0)]
            at = end + len(token) - (2 if token[:3] == "--[" else 0)
        elif token in "\"'":
            found = (_STRING if token == '"' else _SINGLE).match(text, i)
            if found.group(1):
                at = found.end()
            elif found.end() == n and (token == '"' or text[i - 1 : i] in (" ", "(", ",", "=", "[", "{", ":")):
                return [*stack, (token, i, 0)]
        elif token in "([{":
            stack.push(token, i, lines.indent(i)[0])
        elif token in ")]}":
            indent, first = lines.indent(i)
            stack.close(_PAIRS[token], indent if first else None)
        else:
            at = text.find("\n", at)
            if at < 0:
                break
    if not stack:
        return stack
    end = text.rstrip().rfind("\n") + 1
    indent = lines.indent(end)[0]
    closes = text[end:].lstrip()[:1] in tuple(")]}") or text[end:].strip() == "end"
    within = lambda what, level: indent > level or indent == level and what == "{" and not closes
    return [x for x in stack if x[1] >= end or within(x[0], x[2])]


def open_in_prose(text: str) -> list[tuple[str, int, int]]:
    """The automaton's stack at the end of prose, as open_in_code gives it.

    Apostrophes are letters. Blank lines, list items and headings end what is open inside a paragraph, but for blocks.
    A fence is skipped to its end; without one, all that follows is inside it.
    """
    stack = _Stack()
    at = 0
    while m := _PROSE_TOKEN.search(text, at):
        token, i, at, kind = m.group(), m.start(), m.end(), m.lastgroup
        if kind == "fence":
            line = text.find("\n", at)
            found = _FENCE_END.search(text, line) if line >= 0 else None
            if found is None:
                return [*stack, ("```", i, 0)]
            line = text.find("\n", found.end())
            at = len(text) if line < 0 else line
        elif kind == "gap":
            stack.keep(_BLOCKS)
            at -= token.count("\n") > 1  # the line end may also begin the next token
        elif kind == "note":
            end = text.find("-->", at)
            if end < 0:
                return [*stack, ("<!--", i, 0)]
            at = end + 3
        elif kind == "tag":
            tag = _TAG.match(text, i)
            if tag is None:
                continue
            name = f"<{tag[2].lower()}"
            if tag[4] is None:
                return [*stack, (name, i, 0)]
            if tag[1]:
                stack.close(name)
            elif not tag[3].endswith("/") and tag[2].lower() in _CLOSED_TAGS:
                stack.push(name, i)
            at = tag.end()
        elif token in "`\"":
            if stack.counts[token]:
                stack.close(token)
            elif token == "`" or (not text[i - 1 : i].strip() or text[i - 1] in "([{") and text[at : at + 1].strip():
                stack.push(token, i)
        elif token in "([{«“":
            stack.push(token, i)
        else:
            stack.close(_PAIRS[token])
    return stack


def is_code(lines: list[str]) -> bool:
    """Whether more than half of the lines that aren't blank look like code."""
    solid = [x for x in lines if x.strip()]
    return bool(solid) and sum(bool(_CODE_HINT.search(x)) for x in solid) * 2 > len(solid)


def _broken(text: str) -> bool:
    """Whether a text ends inside a multibyte sequence, an escape or an entity.

    A lone backslash counts only if its word holds no other (a path does), an entity only if it begins like one of the
    common ones, a per cent sign only after another coded byte of its word.
    """
    end = text.rstrip()
    if not end:
        return False
    if end[-1] in "\ufffd\u200d" or "\ud800" <= end[-1] <= "\udbff":
        return True
    word = re.split(r"\s", end[-80:])[-1]
    if (m := _ESCAPE_START.search(word)) and "\\" not in word[: m.start()]:
        return True
    if m := _ENTITY_START.search(word):
        return m[1] is None or any(e.startswith(m[1]) for e in _ENTITIES)
    return bool(_PERCENT_START.search(word))


def _last_word(text: str) -> str:
    """The letters at the end of a text in lower case, from the last capital after a small letter on."""
    found = _TAIL_WORD.search(text[-200:])
    word = found.group() if found else ""
    at = next((i for i in range(len(word) - 1, 0, -1) if word[i].isupper() and word[i - 1].islower()), 0)
    return word[at:].lower()


def ending(raw: str) -> tuple[str, str]:
    """How a text ends, and its last word if that word's wholeness may tell more.

    The first is `broken` (inside a character or escape), `mark` (a mark of a cut), `open` (something is open), `dots`,
    `whole`, `unended` (a sentence or statement without its terminator) or `bare` (a line that needs no terminator).
    """
    text = unicodedata.normalize("NFKC", raw.translate(_INVISIBLE)) if not raw.isascii() else raw
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _broken(raw):
        return "broken", ""
    marked = _MARK.search(text)
    dots = _DOTS.search(text)
    bare = text[: (marked or dots).start()].rstrip() if marked or dots else text.rstrip()
    lines = bare.split("\n")
    last, code = lines[-1], is_code(lines)
    left = open_in_code(bare) if code else open_in_prose(bare)
    closed = bare[-1:] != "" and bare.rstrip(_CLOSERS)[-1:] in tuple(TERMINATORS) and not dots
    tail = _last_word(bare if dots else text)
    if marked:
        return "mark", ""
    if left and code and closed and bare[-1] in TERMINATORS and not _COMMENT_LINE.match(last) and all(x[0] in "([{" for x in left):
        return "bare", ""  # an excerpt of code that was closed with a full stop
    if left and not code and (closed or _TABLE_ROW.match(last)):
        left = [x for x in left if x[0][0] == "<" or x[0] == "```"]  # a sentence was closed around a stray opener
    if left and (not dots or bare):
        return "open", ""
    if len(bare) < 2:
        return "whole", ""
    if dots:
        return "dots", tail
    if len(lines) > 1 and lines[-2].strip() == "--":
        return "bare", ""
    if closed and (not code or bare[-1] in TERMINATORS):
        return "whole", ""
    if code:
        if bare[-1] in "};)]" or last.strip() == "end" or _TABLE_ROW.match(last):
            return "whole", ""
        if _COMMENT_LINE.match(last) or len(last.split()) <= 3 and len(lines) > 1 and not lines[-2].strip():
            return "bare", tail
        if _COMPLETE_LINE.match(last) and len(lines) > 1 and not lines[-2].strip():
            return "bare", tail
        if _PYTHON_BLOCK.search(bare):
            return ("bare", tail) if _PYTHON_END.match(last) else ("unended", tail)
        if bare[-1] in ",=+-*/&|<([{.:" or text[-1] != "\n":
            return "unended", tail
        return "bare", tail
    if bare[-1] in "|}>" or re.match(r"^\s*(?:```|~~~)", last):
        return "whole", ""
    if text[-1] != "\n" and (re.match(r"^\s*#+\s", last) or _NAMED_ITEM.match(last)):
        return "unended", tail
    if _COMPLETE_LINE.match(last):
        return ("unended", tail) if _LONG_ITEM.match(last) and not _NAMED_ITEM.match(last) else ("bare", tail)
    if re.match(r"^\s*#+\s", last) or len(last.split()) <= 3 and not re.search(r"[^\x00-ɏ]", last) or _FIELD.match(last):
        return "bare", tail
    return "unended", tail


def endings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """__id, __source, __hash (of the text), __chars, __bytes, __end, __tail of every row with a text that isn't empty."""
    slim = documents.where(F.length(text) > 0).select(
        F.col(doc_id).alias("__id"), F.col(source).alias("__source"), F.sha2(F.col(text), 256).alias("__hash"), F.length(text).alias("__chars"), F.octet_length(text).alias("__bytes"), F.col(text).alias("__text")
    )
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("__id", "__source", "__hash", "__chars", "__bytes")) + ", __end string, __tail string"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [ending(t) for t in batch["__text"]]
            out = batch.drop(columns="__text")
            out["__end"], out["__tail"] = [m[0] for m in made], [m[1] for m in made]
            yield out

    return slim.mapInPandas(judge, schema)


def source_limits(ends: DataFrame) -> DataFrame:
    """source, unit (chars or bytes), length, n: the lengths at which a source's texts pile up; copies of a text count once."""
    sizes = ends.select("__source", "__hash", "__chars", "__bytes").distinct().select("__source", F.explode(F.create_map(F.lit("chars"), F.col("__chars"), F.lit("bytes"), F.col("__bytes"))).alias("unit", "length"))
    counts = sizes.groupBy("__source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    near = W.partitionBy("__source", "unit").orderBy("length").rangeBetween(-NEARBY, NEARBY)
    usual = (F.sum("n").over(near) - F.col("n")) / (2 * NEARBY)
    return (
        counts.withColumn("__usual", usual)
        .where((F.col("n") >= LEAST_AT_LIMIT + EXPECTED * F.col("__usual")))
        .select(F.col("__source").alias("source"), "unit", "length", "n")
    )


def source_baseline(ends: DataFrame) -> DataFrame:
    """source, n_ended, n_unended, usual: of the distinct texts of a source off its limits, how many end and how many lack
    their terminator, and whether lacking it is usual there."""
    once = ends.where("not __limit and __end in ('whole', 'unended')").select("__source", "__hash", "__end").distinct()
    counts = once.groupBy(F.col("__source").alias("source")).agg(F.count_if(F.col("__end") == "whole").alias("n_ended"), F.count_if(F.col("__end") == "unended").alias("n_unended"))
    return counts.withColumn("usual", F.col("n_unended") > USUAL_UNENDED * (F.col("n_ended") + F.col("n_unended")))


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """__word, __inside, __at_end: in how many distinct texts each word stands inside and at the end, also before the marks
    of a cut. Words are counted where they are read, so only the vocabulary is shuffled, besides the texts once."""
    once = documents.where(F.length(text) > 0).select(F.xxhash64(text).alias("__key"), F.col(text).alias("__text")).dropDuplicates(["__key"])
    spaced = F.regexp_replace("__text", r"(\p{Ll})(\p{Lu})", "$1 $2")
    inside = F.array_distinct(F.split(F.lower(F.regexp_replace(spaced, _LAST_WORD, "")), r"[^\p{L}]+"))
    last = F.array(F.lower(F.regexp_extract(spaced, _LAST_WORD, 1)))
    tagged = lambda words, at_end: F.transform(words, lambda w: F.struct(w.alias("__word"), F.lit(at_end).alias("__last")))
    words = once.select(F.explode(F.concat(tagged(inside, False), tagged(last, True))).alias("__w")).select("__w.*").where("__word <> ''")
    return words.groupBy("__word").agg(F.count_if(~F.col("__last")).alias("__inside"), F.count_if("__last").alias("__at_end"))


def known_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """__word: the words that stand inside texts at least KNOWN_WORD times as often as at the end."""
    return word_counts(documents, text).where(F.col("__inside") >= KNOWN_WORD * F.greatest("__at_end", F.lit(1))).select("__word")


def broken_tails(documents: DataFrame, ends: DataFrame, text: str = "text") -> DataFrame:
    """__tail: the last words of ends that are no known words but the beginnings of some."""
    asked = cut_lineage(ends.where("__tail <> ''").select("__tail").distinct())
    longest = asked.agg(F.coalesce(F.max(F.length("__tail")), F.lit(0))).first()[0]
    known = cut_lineage(known_words(documents, text))
    upto = F.least(F.length("__word") - 1, F.lit(int(longest)))
    starts = known.where(F.length("__word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), upto), lambda n: F.substr("__word", F.lit(1), n))).alias("__tail"))
    return asked.join(known.withColumnRenamed("__word", "__tail"), "__tail", "left_anti").join(starts, "__tail", "left_semi")


def _keyed(df: DataFrame, source: str) -> DataFrame:
    """df with __key: the source, with a key of its own for null."""
    return df.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")))


def truncated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, why: the documents whose text lost its end.

    why is `broken`, `mark` or `open` (see ending), `limit` (no terminator at a length where the source cuts, or a copy
    of such a text), `sentence` (a sentence or statement without its end, where its source ends them) or `word` (the last
    word is no whole word). Null and empty texts have lost nothing; a null source is a source of its own; rows that occur
    twice come out twice; an empty table gives no rows; other columns are ignored.
    """
    ends = cut_lineage(_keyed(endings(documents, doc_id, text, source), "__source"))  # without the texts
    limits = _keyed(source_limits(ends), "source")
    unsure = ends.where("__end in ('dots', 'unended', 'bare')")
    sizes = unsure.select("__hash", "__key", F.explode(F.create_map(F.lit("chars"), F.col("__chars"), F.lit("bytes"), F.col("__bytes"))).alias("unit", "length"))
    at_limit = salted_join(sizes, limits.select("__key", "unit", "length"), ["__key", "unit", "length"], F.col("__hash"), "left_semi")
    limited = cut_lineage(salted_join(ends, at_limit.select("__hash").distinct().withColumn("__limit", F.lit(True)), ["__hash"], F.col("__id"), "left").withColumn("__limit", F.coalesce("__limit", F.lit(False))))
    usual = _keyed(source_baseline(limited), "source").where("usual").select("__key", "usual")
    based = salted_join(limited.where("__end in ('dots', 'unended', 'bare')"), usual, ["__key"], F.col("__id"), "left")
    why = F.when(F.col("__limit"), "limit").when((F.col("__end") == "unended") & F.col("usual").isNull(), "sentence")
    judged = cut_lineage(based.select("__id", "__source", "__tail", why.alias("why")))
    doubtful = judged.where("why is null and __tail <> ''")
    words = salted_join(doubtful, broken_tails(documents, doubtful, text), ["__tail"], F.col("__id"), "left_semi").select("__id", "__source", F.lit("word").alias("why"))
    sure = ends.where("__end in ('broken', 'mark', 'open')").select("__id", "__source", F.col("__end").alias("why"))
    found = sure.unionByName(judged.where("why is not null").select("__id", "__source", "why")).unionByName(words)
    return found.select(F.col("__id").alias(doc_id), F.col("__source").alias(source), "why")


WHYS = ("broken", "mark", "open", "limit", "sentence", "word")


def truncation_report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """source, n_docs, n_truncated, share and n_ of each reason: how often each source cuts, over all documents with a text
    that isn't empty."""
    n = documents.where(F.length(text) > 0).groupBy(source).agg(F.count(F.lit(1)).alias("n_docs")).select(F.col(source).alias("__s"), "n_docs")
    cut = truncated(documents, doc_id, text, source).groupBy(source).agg(F.count(F.lit(1)).alias("__cut"), *(F.count_if(F.col("why") == w).alias(f"__{w}") for w in WHYS))
    both = n.join(cut, n["__s"].eqNullSafe(cut[source]), "left")
    found = F.coalesce("__cut", F.lit(0)).cast("bigint")
    return both.select(F.col("__s").alias(source), "n_docs", found.alias("n_truncated"), (found / F.col("n_docs")).alias("share"), *(F.coalesce(f"__{w}", F.lit(0)).cast("bigint").alias(f"n_{w}") for w in WHYS))
