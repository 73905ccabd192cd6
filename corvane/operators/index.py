"""An index of chunks that is kept up to date: runs over changed files only, contributions of files, derived relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import corpus, dependencies
from corvane.operators.parsing import file_chunks
from corvane.operators.snapshots import manifest_diff, replace_keys

FILE_KEY = ["repo", "file_path"]


@dataclass
class Index:
    """The tables of an index: chunks, the manifest (repo, file_path, modified_at, n_chunks) and the contributions of each
    file to the dependency graph; all else is derived from them."""

    chunks: DataFrame
    manifest: DataFrame
    contributions: DataFrame

    def hierarchy(self) -> DataFrame:
        """Which classes name a type as their base, from the current chunks."""
        return corpus.implementations(self.chunks)

    def nodes(self) -> DataFrame:
        return dependencies.nodes(self.contributions)


def _contributions(chunks: DataFrame) -> DataFrame:
    return dependencies.references_of_files(chunks)


def _numbered(chunks: DataFrame) -> DataFrame:
    """chunks with a number made of their place, and without a time; the same file gives the same numbers."""
    number = F.xxhash64("repo", "file_path", "class_name", "method_name", "start_line", "end_line", "chunk_type")
    return chunks.withColumns({"chunk_no": number, "indexed_at": F.lit(None).cast("timestamp_ntz")})


def full_index(files: DataFrame) -> Index:
    """The index of files (repo, file_path, source, modified_at), made anew."""
    chunks = _numbered(file_chunks(files))
    return Index(chunks, _manifest(files, chunks), _contributions(chunks))


def _manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("n_chunks"))
    return files.select(*FILE_KEY, "modified_at").join(counts, FILE_KEY, "left").select(*FILE_KEY, "modified_at", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


def file_status(index: Index, files: DataFrame) -> DataFrame:
    """repo, file_path, status (new, changed, unchanged, removed) of files against the index, by their times exactly."""
    key = F.concat_ws("\x00", "repo", "file_path")
    old, new = (x.withColumn("__key", key) for x in (index.manifest, files))
    made = manifest_diff(old.select("__key", "modified_at"), new.select("__key", "modified_at"), "__key", "modified_at")
    return made.select(F.split("__key", "\x00")[0].alias("repo"), F.split("__key", "\x00")[1].alias("file_path"), "status")


def update_index(index: Index, files: DataFrame) -> Index:
    """The index after files: only new and changed files are cut, rows of removed and changed ones go, all others stay.

    The result is the same as full_index(files), and running it again changes nothing.
    """
    status = file_status(index, files)
    gone = status.where("status in ('changed', 'removed')").select(*FILE_KEY)
    fresh = files.join(status.where("status in ('new', 'changed')").select(*FILE_KEY), FILE_KEY, "left_semi")
    made = full_index(fresh)
    keep = lambda old, new: old.join(gone, FILE_KEY, "left_anti").unionByName(new)
    return Index(keep(index.chunks, made.chunks), keep(index.manifest, made.manifest), keep(index.contributions, made.contributions))


def update_files(index: Index, files: DataFrame) -> Index:
    """The index with the rows of just these files replaced; a file with a null source is removed. Others aren't touched."""
    made = full_index(files.where("source is not null"))
    keys = files.select(*FILE_KEY).distinct()
    put = lambda old, new: old.join(keys, FILE_KEY, "left_anti").unionByName(new)
    return Index(put(index.chunks, made.chunks), put(index.manifest, made.manifest), put(index.contributions, made.contributions))


def rebuild_contributions(index: Index, kept_endings: tuple[str, ...] = ()) -> Index:
    """The index with contributions made anew from its chunks; those of files with a kept ending stay as they are."""
    kept = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).isin(*kept_endings) if kept_endings else F.lit(False)
    fresh = _contributions(index.chunks.where(~kept))
    return Index(index.chunks, index.manifest, index.contributions.where(kept).unionByName(fresh))


def run_counts(index: Index, files: DataFrame) -> DataFrame:
    """repo, n_scanned, n_new, n_changed, n_unchanged, n_removed of a run over files."""
    of = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return file_status(index, files).groupBy("repo").agg(F.count_if(F.col("status") != "removed").alias("n_scanned"), of("new"), of("changed"), of("unchanged"), of("removed"))


def upsert_contributions(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """Contributions with those of the changed files replaced."""
    return replace_keys(existing, changed, FILE_KEY)
