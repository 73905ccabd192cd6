"""Splitting items that are longer than a limit at natural boundaries.

The ends of a text's tokens are the prefix sums of their lengths; those where a paragraph, line, sentence or word ends
make sorted arrays of boundaries. The end of a piece is found by binary search for the last boundary under the limit,
the strongest kind first; the next piece starts at the first boundary that leaves no more than the overlap. Where there is no
boundary, the cut is made at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.keys import normal_label

#: The type in the table of limits that stands for any other.
ANY = "*"

#: Kinds of boundaries, the strongest first; "hard" is none.
KINDS = ("paragraph", "line", "sentence", "word", "hard")

#: A stronger boundary is taken before a weaker one if the piece is at least this full.
LEAST_FULL = 0.5


def boundaries(text: str) -> list[np.ndarray]:
    """For each kind but the last, the sorted offsets at which a piece may start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line_end = codes == 10
    line_end |= (codes == 13) & ~np.append(line_end[1:], False)
    blank = line_end | (codes == 32) | (codes == 9) | (codes == 13)
    # A token is a run of blanks or of other characters; its end is the sum of the lengths up to it.
    token_ends = np.flatnonzero(blank[:-1] != blank[1:]) + 1
    word = token_ends[~blank[token_ends]] if len(token_ends) else token_ends
    lines = np.flatnonzero(line_end) + 1
    lines = lines[lines < len(codes)]
    empty = np.zeros(len(lines), dtype=bool)
    if len(lines):
        starts = np.append(0, lines[:-1])
        solid = np.cumsum(np.append(0, ~blank))
        empty = solid[lines] == solid[starts]  # the line that ends here holds nothing
    paragraph = lines[empty & ~np.append(empty[1:], False)]
    before = codes[np.maximum(word - 2, 0)]
    sentence = word[np.isin(before, [ord(c) for c in ".!?;:}"])]
    wide = np.flatnonzero(np.isin(codes, [0x3002, 0xFF01, 0xFF1F])) + 1  # ideographic ends need no blank
    sentence = np.union1d(sentence, wide[wide < len(codes)])
    return [paragraph, lines, sentence, word]


def _last(offsets: np.ndarray, low: int, high: int) -> int | None:
    """The last offset in (low, high]."""
    at = int(np.searchsorted(offsets, high, side="right")) - 1
    return int(offsets[at]) if at >= 0 and offsets[at] > low else None


def _first(offsets: np.ndarray, low: int, high: int) -> int | None:
    """The first offset in [low, high]."""
    at = int(np.searchsorted(offsets, low, side="left"))
    return int(offsets[at]) if at < len(offsets) and offsets[at] <= high else None


def split_offsets(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """start, end and kind of start of each piece of text; a text within the limit is one piece.

    Every piece has at most `most` characters; each but the first starts at most `overlap` characters before the end of
    the one before, at the first boundary of any kind from there on (the strongest kind of those at one offset), or
    exactly there if none follows within half of the overlap. So it repeats the overlap but for the rest of one token and
    blanks, and never less than half. An overlap that leaves no room for new text is an error.
    """
    if not 0 <= overlap < most:
        raise ValueError(f"pieces of {most} characters can't repeat {overlap}")
    n = len(text)
    if n <= most:
        return [(0, n, KINDS[0])]
    kinds = boundaries(text)
    pieces, start, kind = [], 0, KINDS[0]
    while True:
        high = start + most
        if high >= n:
            pieces.append((start, n, kind))
            return pieces
        low = start + max(overlap, int(most * LEAST_FULL))
        end = next((e for e in (_last(k, low, high) for k in kinds) if e is not None), None)
        if end is None:
            end = next((e for e in (_last(k, start + overlap, high) for k in kinds) if e is not None), high)
            if end == high and text[end - 1 : end + 1] == "\r\n" and end - 1 > start + overlap:
                end -= 1
        pieces.append((start, end, kind))
        back = end - overlap
        if not overlap:
            kind = next((name for name, k in zip(KINDS, kinds) if _first(k, end, end) is not None), KINDS[-1])
            start = end
            continue
        near = [(s, i) for i, k in enumerate(kinds) if (s := _first(k, back, end - overlap // 2)) is not None]
        start, i = min(near, default=(back, len(kinds)))
        kind = KINDS[i]


def with_limits(chunks: DataFrame, limits: DataFrame, chunk_type: str = "chunk_type") -> DataFrame:
    """chunks with __most and __overlap of their type, of `*` for null and unlisted types; null where `*` isn't listed.

    Types compare without case and surrounding blanks; of several rows for a type the one of least max_chars counts. Rows
    without max_chars are no limits; a null overlap is none.
    The limits are a small table keyed by type; Spark broadcasts them if they are under its own size limit.
    """
    one = limits.where("max_chars is not null").groupBy(normal_label(F.col("chunk_type")).alias("__type")).agg(
        F.min(F.struct("max_chars", "overlap_chars")).alias("__limit")
    )
    star = one.where(F.col("__type") == ANY).agg(F.first("__limit").alias("__limit")).scalar()
    return (
        chunks.withColumn("__type", normal_label(F.col(chunk_type)))
        .join(one, "__type", "left")
        .withColumn("__limit", F.coalesce("__limit", star))
        .withColumn("__most", F.col("__limit.max_chars"))
        .withColumn("__overlap", F.coalesce("__limit.overlap_chars", F.lit(0)))
        .drop("__type", "__limit")
    )


def split_oversized(
    chunks: DataFrame, limits: DataFrame, key: str = "chunk_no", text: str = "source", chunk_type: str = "chunk_type", keep_limit: bool = False
) -> DataFrame:
    """key, piece_no, start_at, end_at, start_kind, piece (and __most, if keep_limit): the pieces of every row whose text is over its limit.

    Offsets count code points from 0. Rows within their limit, with null text or without a limit give nothing; a row
    that occurs twice gives its pieces twice; an empty table gives none. piece_no counts from 0 within a row. A limit
    with an overlap that isn't below it fails the query, if a text is over that limit.
    """
    kind = chunks.schema[key].dataType.simpleString()
    slim = chunks.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(chunk_type).alias("__chunk_type"))
    over = with_limits(slim, limits, "__chunk_type").where(F.length("__text") > F.col("__most")).select("__key", "__text", "__most", "__overlap")
    schema = f"`{key}` {kind}, piece_no int, start_at int, end_at int, start_kind string, piece string" + (", __most int" if keep_limit else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body, most, overlap in zip(batch["__key"], batch["__text"], batch["__most"], batch["__overlap"]):
                made = split_offsets(body, int(most), int(overlap))
                starts, ends, kinds = zip(*made)
                pieces = pd.DataFrame(
                    {key: pd.Series([name] * len(made), dtype=batch["__key"].dtype), "piece_no": range(len(made)), "start_at": starts, "end_at": ends, "start_kind": kinds, "piece": [body[s:e] for s, e, _ in made]}
                )
                yield pieces.assign(__most=int(most)) if keep_limit else pieces

    return over.mapInPandas(cut, schema)


def rebuilt(pieces: DataFrame, limits_kept: str = "__most", key: str = "chunk_no") -> DataFrame:
    """key, n_pieces, n_chars, text_hash (md5), fits: the texts put together again from their pieces, without the overlaps.

    pieces are those of split_oversized with the limit of each row; fits tells whether no piece is over it. Rows that
    occur twice count once. A text's pieces hold little more than the text, so no group is larger than a row of the source.
    """
    once = pieces.distinct()
    after = F.lag("end_at", default=0).over(W.partitionBy(key).orderBy("piece_no"))
    new = once.withColumn("__new", F.substr("piece", after - F.col("start_at") + 1))
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "__new")))
    return new.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pieces"), F.max("end_at").cast("bigint").alias("n_chars"), F.md5(F.concat_ws("", F.transform(parts, lambda x: x["__new"]))).alias("text_hash"), F.bool_and(F.length("piece") <= F.col(limits_kept)).alias("fits")
    )
