"""Passages of held-out items inside a corpus.

All items of a block go into one generalised suffix automaton over words. A document's words stream through it once;
the automaton always knows the longest run of words that ends here and stands in some item, so each passage of the
required length is seen wherever it starts, and the items that hold it are read off the state. The corpus is neither
shuffled nor compared pairwise: its rows meet the stated set of items, block after block. The driver passes on the texts
of a block; each worker makes the automaton from them once.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that make a passage; a shorter item must stand in the document as a whole.
PASSAGE_WORDS = 12

#: Items are broadcast in blocks of about so many characters; up to that, one pass over the corpus does, and each further
#: block is one more. The automaton of a block takes some 200 MB in a worker.
BLOCK_CHARS = 1_000_000

#: Characters taken out before words are read (zero-width space, word joiner, soft hyphen, byte order mark).
IGNORED = dict.fromkeys([0x200B, 0x2060, 0x00AD, 0xFEFF])

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and lower case; null has none."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(IGNORED)).lower())


class ItemAutomaton:
    """Generalised suffix automaton of items; states are numbered and 0 is the start."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int = PASSAGE_WORDS):
        self.passage = passage
        self.step: list[dict[str, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.sizes: dict[int, int] = {}
        held: list[set[int]] = [set()]
        ends: dict[int, list[int]] = {}
        for number, (item, words) in enumerate(items):
            if not words:
                continue
            self.sizes[number] = len(words)
            at = 0
            for word in words:
                at = self._extend(at, word)
                while len(held) < len(self.step):
                    held.append(set())
                held[at].add(number)
            if len(words) < passage:
                ends.setdefault(at, []).append(number)
        self.items = [item for item, _ in items]
        by_length = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for state in reversed(by_length):
            held[self.link[state]] |= held[state]
        #: Items with the passage that ends here, once the match is long enough; short items that end here, with their lengths.
        self.long: list[frozenset[int]] = [frozenset()] * len(self.step)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        #: The least match length at which a state reports anything.
        self.need = [1 << 30] * len(self.step)
        for state in by_length:
            above = self.link[state]
            if self.length[state] >= passage:
                self.long[state] = self.long[above] if self.length[above] >= passage else frozenset(held[state])
                self.need[state] = passage
            whole = [(self.sizes[n], n) for n in ends.get(state, ())]
            self.short[state] = self.short[above] + tuple(whole)
            if self.short[state]:
                self.need[state] = min(self.need[state], *(size for size, _ in self.short[state]))

    def _extend(self, last: int, word: str) -> int:
        step, link, length = self.step, self.link, self.length
        there = step[last].get(word)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while last != -1 and word not in step[last]:
            step[last][word] = new
            last = link[last]
        if last != -1:
            there = step[last][word]
            link[new] = there if length[there] == length[last] + 1 else self._split(last, word, there)
        return new

    def _split(self, last: int, word: str, there: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[there]))
        link.append(link[there])
        length.append(length[last] + 1)
        link[there] = copy
        while last != -1 and step[last].get(word) == there:
            step[last][word] = copy
            last = link[last]
        return copy

    def spans(self, words: list[str]) -> dict[int, list[list[int]]]:
        """Item number to its spans [first, end) of words, merged where they touch or overlap."""
        step, link, length, need, passage = self.step, self.link, self.length, self.need, self.passage
        state = run = 0
        found: dict[int, list[list[int]]] = {}
        for at, word in enumerate(words):
            there = step[state].get(word)
            while there is None and state:
                state = link[state]
                run = length[state]
                there = step[state].get(word)
            if there is None:
                continue
            state, run = there, run + 1
            if run < need[state]:
                continue
            hits = [(n, passage) for n in self.long[state]] if run >= passage else []
            hits += [(n, size) for size, n in self.short[state] if size <= run]
            for n, size in hits:
                first, known = at + 1 - size, found.setdefault(n, [])
                if known and first <= known[-1][1]:
                    known[-1][1] = at + 1
                else:
                    known.append([first, at + 1])
        return found


#: The automaton that this worker made last, under the name of its block; only one is kept.
_MADE: dict[str, ItemAutomaton] = {}


def _automaton(name: str, items: list[tuple[int, str]], passage: int) -> ItemAutomaton:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = ItemAutomaton([(item, words_of(text)) for item, text in items], passage)
    return _MADE[name]


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    rows = items.where(F.col(item_id).isNotNull() & (F.length(text) > 0)).select(F.col(item_id).alias("__id"), F.col(text).alias("__text"))
    total = rows.agg(F.sum(F.length("__text").cast("bigint")).alias("n")).first()["n"] or 0
    n_blocks = -(-total // block_chars)
    for block in range(n_blocks):
        part = rows.where(F.pmod(F.xxhash64("__id"), F.lit(n_blocks)) == block)
        yield [(r["__id"], r["__text"]) for r in part.toLocalIterator()]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    passage: int = PASSAGE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """item_id, doc_id, text_hash, first_word, n_words: the spans of each document that hold passages of each item.

    A span is made of runs of `passage` consecutive words of the item, or is the whole of an item that has fewer words;
    spans of the same item that touch are one. Null, empty and wordless texts hold and leak nothing; rows with the same
    id are judged each on their own, told apart by text_hash (xxhash64); either table may be empty.
    """
    id_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{item_id}` {item_type}, `{doc_id}` {id_type}, text_hash bigint, first_word int, n_words int"
    spark, texts = documents.sparkSession, documents.where(F.length(text) > 0).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))

    def against(block):
        name = uuid.uuid4().hex

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(name, block.value, passage)
            names = automaton.items
            for batch in batches:
                out = [
                    (names[n], doc, key, first, end - first)
                    for doc, body, key in zip(batch["__id"], batch["__text"], batch["__hash"])
                    for n, spans in automaton.spans(words_of(body)).items()
                    for first, end in spans
                ]
                yield pd.DataFrame(out, columns=[item_id, doc_id, "text_hash", "first_word", "n_words"])

        return texts.mapInPandas(stream, schema)

    found = [against(spark.sparkContext.broadcast(block)) for block in _blocks(items, item_id, item_text, block_chars)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def leaks(passages: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, doc_id, n_spans, n_words, longest: one row for each leak."""
    return passages.groupBy(item_id, doc_id).agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum("n_words").alias("n_words"), F.max("n_words").alias("longest")
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the given word spans, which are counted as words_of counts them."""
    offsets = []
    for token in _WORD.finditer(text):
        n = len(words_of(token.group()))
        offsets += [token.span()] * n
    if len(offsets) != len(words_of(text)):  # normal forms moved a word's border: cut by single characters
        offsets, run = [], None
        for i, char in enumerate(text):
            if words_of(char):
                run = (run[0] if run else i, i + 1)
            elif run and not (ord(char) in IGNORED or unicodedata.combining(char)):
                offsets.append(run)
                run = None
        offsets += [run] if run else []
    kept, at = [], 0
    for first, n in sorted(spans):
        if first >= len(offsets):
            continue
        start, end = offsets[first][0], offsets[min(first + n, len(offsets)) - 1][1]
        if start > at:
            kept.append(text[at:start])
        at = max(at, end)
    return "".join([*kept, text[at:]])


def remove_leaks(
    documents: DataFrame, passages: DataFrame, coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, text, removed_words: the leaking documents without their spans, those of short items included.

    A document of which the spans cover more than `coverage` of the words keeps nothing (text is empty). Documents
    without passages are left out: they stay as they are. passages are those of leaked_passages.
    """
    spans = passages.groupBy(doc_id, "text_hash").agg(F.collect_set(F.struct("first_word", "n_words")).alias("__spans"))
    joined = documents.select(F.col(doc_id), F.col(text), F.xxhash64(text).alias("text_hash")).join(spans, [doc_id, "text_hash"])
    schema = f"`{doc_id}` {documents.schema[doc_id].dataType.simpleString()}, `{text}` string, removed_words int"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, body, found in zip(batch[doc_id], batch[text], batch["__spans"]):
                spans = [(s["first_word"], s["n_words"]) for s in found]
                covered = len({w for first, n in spans for w in range(first, first + n)})
                total = len(words_of(body))
                out.append((doc, "" if covered > coverage * total else _without(body, spans), covered))
            yield pd.DataFrame(out, columns=[doc_id, text, "removed_words"])

    return joined.mapInPandas(cut, schema)
