"""Files to chunks, and definitions in source, as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.chunking.chunks import CHUNKERS, chunk_file
from corvane.chunking.languages import language_of
from corvane.chunking.lexer import Scanned
from corvane.operators.corpus import latest_chunks

_COLUMNS = "class_name string, method_name string, namespace string, start_line int, end_line int, source string, chunk_type string, module string, doc_comment string, base_types array<string>"


def file_chunks(files: DataFrame, repo: str = "repo", path: str = "file_path", text: str = "source", module: str | None = None) -> DataFrame:
    """repo, file_path, class_name, method_name, namespace, start_line, end_line, source, chunk_type, module, doc_comment,
    base_types: the chunks of each file, a row of files.

    Files of unknown endings, null and blank texts give nothing; rows that occur twice give their chunks twice. One file
    is cut within one task, as everywhere in this library; nothing is shuffled.
    """
    held = F.lit("") if module is None else F.coalesce(F.col(module), F.lit(""))
    slim = files.select(F.col(repo).alias("__repo"), F.col(path).alias("__path"), F.col(text).alias("__text"), held.alias("__module")).where(F.col("__text").isNotNull())
    chunkers = dict(CHUNKERS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (r, p, c.class_name, c.method_name, c.namespace, c.start_line, c.end_line, c.source, c.chunk_type, m, c.doc_comment, c.base_types)
                for r, p, t, m in zip(batch["__repo"], batch["__path"], batch["__text"], batch["__module"])
                for c in chunk_file(p, t, chunkers)
            ]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in f"repo string, file_path string, {_COLUMNS}".split(", ")])

    return slim.mapInPandas(cut, f"repo string, file_path string, {_COLUMNS}")


def definitions(chunks: DataFrame) -> DataFrame:
    """repo, file_path, line_no, name, kind (function or that of a type): what the source of the latest chunks defines.

    Comments and strings define nothing. Chunks without a start line or in other languages give nothing.
    """
    rows = latest_chunks(chunks).where("source is not null and start_line is not null").select("repo", "file_path", "start_line", "source")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, path, first, text in zip(batch["repo"], batch["file_path"], batch["start_line"], batch["source"]):
                language = language_of(path)
                if language is not None:
                    code = Scanned(text, language)
                    out += [(repo, path, first + f.line, f.name, "function") for f in code.functions()]
                    out += [(repo, path, first + t.line, t.name, t.kind) for t in code.types()]
            yield pd.DataFrame(out, columns=["repo", "file_path", "line_no", "name", "kind"])

    return rows.mapInPandas(heads, "repo string, file_path string, line_no int, name string, kind string").distinct()
