"""Encoding texts with the ids of a public byte-level BPE vocabulary.

For every prefix of a piece of text there is exactly one token that can end its encoding. The tokens that end at a
prefix are the matches of an automaton over the whole vocabulary; the one that is right is the token that is compatible
with the last token of the prefix before it. Compatible means that encoding the two tokens' bytes gives the two tokens
back, which is tested by undoing merges on both sides of the border. Back-pointers then give the ids, as merging in the
order of the ranks would, in time linear in the text.

The vocabulary has a fixed size (some 50,000 tokens), so its tables are broadcast; texts stay in their partitions and
nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabularies lie and the rule that cuts a text into pieces before merging.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A worker keeps the ids of so many different pieces; beyond that it forgets all and goes on, so memory is bounded.
CACHE = 200_000

#: A broadcast vocabulary may have so many tokens at most.
MOST_TOKENS = 1_000_000


class Vocabulary:
    """Ranks of byte tokens with the merge that makes each token."""

    def __init__(self, tokens: list[bytes]):
        """tokens in the order of their ranks, which are their ids; all 256 bytes must be among them."""
        if len(tokens) > MOST_TOKENS:
            raise ValueError(f"a vocabulary of {len(tokens)} tokens is beyond {MOST_TOKENS}")
        self._encoder: Encoder | None = None
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.parts: list[tuple[int, int]] = []  # a single byte is its own two parts
        self.merges: dict[tuple[int, int], int] = {}
        for i, token in enumerate(tokens):
            pair = self._made_of(i, token)
            self.parts.append(pair or (i, i))
            if pair:
                self.merges[pair] = i

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranked = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
        ranked.sort()
        if [rank for rank, _ in ranked] != list(range(len(ranked))):
            raise ValueError(f"the ranks in {path} have gaps")
        return cls([token for _, token in ranked])

    def encoder(self) -> Encoder:
        """Made once in each worker, which keeps a broadcast value over its tasks."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def _made_of(self, i: int, token: bytes) -> tuple[int, int] | None:
        for cut in range(1, len(token)):
            left, right = self.ids.get(token[:cut], i), self.ids.get(token[cut:], i)
            if left < i and right < i and self.compatible(left, right):
                return left, right
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of left and right, encoded together, come out as left and right.

        Undo the later of the two tokens' merges; whenever the inner parts could have merged with each other before
        that merge, the encoding would have crossed the border.
        """
        merges, parts, bound = self.merges, self.parts, len(self.tokens)
        while True:
            across = merges.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                inner = parts[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                inner = parts[right][0]
                if inner == right:
                    return True
                bound, right = right + 1, inner
            else:
                inner = parts[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                inner = parts[left][1]
                if inner == left:
                    return True
                bound, left = left, inner


class Encoder:
    """A vocabulary with its automaton, ready to encode."""

    def __init__(self, vocabulary: Vocabulary, pieces: str = PIECES):
        import ahocorasick
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(pieces).findall
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(vocabulary.tokens):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ids.get(raw)
        if whole is not None:
            return (whole,)
        last = [-1] * (len(raw) + 1)  # the token that ends the prefix of each length
        pairs, compatible, lengths = self.pairs, self.vocabulary.compatible, self.vocabulary.tokens
        for at, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            before = end - size
            if not before:
                last[end] = token
            elif last[before] >= 0:
                pair = (last[before], token)
                good = pairs.get(pair)
                if good is None:
                    if len(pairs) >= CACHE:
                        pairs.clear()
                    good = pairs[pair] = compatible(*pair)
                if good:
                    last[end] = token
        ids, end = [], len(raw)
        while end:
            ids.append(last[end])
            end -= len(lengths[last[end]])
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        kept, out = self.kept, []
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(kept) >= CACHE:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


def encoder_udf(spark: SparkSession, path: str = f"{TOKENIZERS}/{VOCABULARY}"):
    """A Column function: text to array<int>; null and empty texts give an empty array."""
    tables = spark.sparkContext.broadcast(Vocabulary.read(path))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tables.value.encoder()
        for texts in batches:
            yield pd.Series([encoder.encode(t) if t else [] for t in texts], dtype=object)

    return encode


def encode_corpus(
    documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}", doc_id: str = "doc_id", text: str = "text", ids: str = "ids"
) -> DataFrame:
    """doc_id and ids (array<int>, without special tokens) of every row of documents.

    Strings that look like special tokens are plain text; empty and null texts give an empty array; rows with equal
    doc_id stay as they are; an empty table gives no rows. Other columns are ignored.
    """
    encode = encoder_udf(documents.sparkSession, path)
    return documents.select(F.col(doc_id), encode(F.col(text)).alias(ids))

