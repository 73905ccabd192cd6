"""Files that nobody in the project wrote by hand: generated, minified, vendored, or data stored as code.

An inverted index of line hashes finds the copies, edited ones too, without any sign of their own. Files with the same
lines are one content and count once. The index keeps of each line how many contents hold it and the ends of the ranges
of repositories and of declared foreign contents that do; no list of holders is ever made, so a line that very many
files hold costs no more than any other. The containment of a file is the exact share of its lines that stand in another
repository, or in another file whose folder says that it came from elsewhere. Rare lines count alike; where
a group of copies is so large that its lines are rare no more, all lines count by their rarity, the logarithm of the
share of contents that hold them.
What remains is judged by its composition, from sums over lines that Spark makes before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.keys import normal_path
from corvane.operators.skew import join_around, salts_of
from corvane.session import cut_lineage

# Endings of code files, folders and names of generated and vendored files, and what headers of generated ones say.
ENDINGS = ("cs", "py", "js", "ts", "lua", "go", "rs", "cpp", "cc", "css")
VENDOR_FOLDERS = r"(?i)(?:^|/)(?:third[-_]?party|vendor(?:ed)?|node_modules|bower_components|external|extern|deps/[^/]+|assets/plugins|packages/[^/]+/runtime)/"
GENERATED_FOLDERS = r"(?i)(?:^|/)(?:obj|gen|generated|__generated__|autogen|codegen[-_]out|build/temp)/"
GENERATED_NAMES = r"(?i)(?:\.(?:designer|generated|gen|g|g\.i|pb|bundle)\.[a-z]+|_gen\.[a-z]+|_moc\.cpp|_pb2(?:_grpc)?\.py|\.pb\.go|_string\.go)$"
MINIFIED_NAMES = r"(?i)[.-]min\.[a-z]+$"
_COMMENT = r"^(?://+|#+|--+|/?\*+!?|;+)\s*"
GENERATED_LINES = (
    rf"(?i)(?:{_COMMENT}(?:@generated\b|<auto-?generated|generated-source:|autogenerated from |(?:this file (?:was|is) |code )?(?:auto(?:matically)?[- ]?)?generated (?:by|from)\b"
    r"|.*\bautomatisch (?:erzeugt|generiert)\b|this file is machine (?:written|generated)|produced by \S+ on build|.*\bdo not edit\b.*\bgenerated\b|\[GeneratedCode\()|^\[(?:assembly:\s*)?GeneratedCode\()"
)
#: A line counts in the index if it is this long without surrounding blanks and holds a word; it is rare if at most
#: this share of all distinct contents of files holds it. A share, so that the same lines are rare at every size.
LEAST_LINE = 16
RARE_SHARE = 0.02
#: With few contents a share means nothing: a line in so many at most is rare as well.
RARE_FILES = 20

#: A file is a copy if at least this share of its lines stands elsewhere, and so many of them; fewer lines tell nothing.
CONTAINMENT = 0.5
LEAST_SHARED = 4

#: Composition: share of characters in data rows; of one-letter names among names; of blanks inside lines.
DATA_SHARE = 0.8
LEAST_DATA_CHARS = 200
SHORT_NAMES = 0.4
BLANK_SHARE = 0.06
LEAST_PACKED_LINE = 120

_DATA_ROW = r"""^(?:return\s+)?[\[{(]*\s*(?:(?:-?(?:0x)?[0-9a-fA-F]+(?:\.\d+)?[fFlLuU]*|b?"[^"]*"(?:\s*\+)?|'[^']*'|\[?"?\w+"?\]?\s*[:=]\s*(?:-?[\d.]+|"[^"]*"))\s*[,;]?\s*[\[\](){}]*\s*[,;]?\s*)+$"""


def _marked(pattern: str) -> Column:
    """Whether a line has the mark; only lines that begin like a comment or an attribute are matched."""
    first = F.substring("__line", 1, 1).isin(*"/#-*;[")
    return F.max(F.when(first, F.col("__line").rlike(pattern)).otherwise(False))


def _files_and_lines(chunks: DataFrame) -> DataFrame:
    """repo, file_path, __line: the lines of code files without surrounding blanks, empty ones left out."""
    path = normal_path(F.col("file_path"))
    slim = chunks.select("repo", path.alias("file_path"), "source").where(path.rlike(rf"\.(?:{'|'.join(ENDINGS)})$"))
    line = F.explode_outer(F.split("source", r"\r\n|\r|\n"))
    return slim.select("repo", "file_path", line.alias("__line")).withColumn("__line", F.coalesce(F.trim(F.regexp_replace("__line", r"\s+", " ")), F.lit("")))


def composition(lines: DataFrame) -> DataFrame:
    """One row for each (repo, file_path): markers and sums over its lines, pre-aggregated before the shuffle."""
    line, size = F.col("__line"), F.length("__line")
    names = F.regexp_count(line, F.lit(r"[A-Za-z_]\w*"))
    short = F.regexp_count(line, F.lit(r"\b[A-Za-z]\b"))
    blanks = size - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return lines.groupBy("repo", "file_path").agg(
        _marked(GENERATED_LINES).alias("__generated"),
        F.sum(size).alias("__chars"),
        F.sum(F.when(line.rlike(_DATA_ROW), size).otherwise(0)).alias("__data_chars"),
        F.sum(F.when(size >= LEAST_PACKED_LINE, size).otherwise(0)).alias("__long_chars"),
        F.sum(names).alias("__names"),
        F.sum(short).alias("__short_names"),
        F.sum(blanks).alias("__blanks"),
    )


def own_evidence(files: DataFrame) -> DataFrame:
    """files of composition() with reason: what a file's folder, name, header or composition says, else null."""
    path = F.col("file_path")
    chars, names = F.greatest("__chars", F.lit(1)), F.greatest("__names", F.lit(1))
    packed = (F.col("__long_chars") / chars >= 0.5) & (
        (F.col("__short_names") / names >= SHORT_NAMES) | (F.col("__blanks") / chars < BLANK_SHARE)
    )
    reason = (
        F.when(path.rlike(VENDOR_FOLDERS), "vendored")
        .when(path.rlike(GENERATED_FOLDERS) | path.rlike(GENERATED_NAMES) | F.col("__generated"), "generated")
        .when((F.col("__data_chars") / chars >= DATA_SHARE) & (F.col("__data_chars") >= LEAST_DATA_CHARS), "data")
        .when(path.rlike(MINIFIED_NAMES) | packed, "minified")
    )
    return files.withColumn("reason", reason)


def contained_files(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """repo, file_path, containment of the files whose lines stand in other repositories or in vendored files.

    judged has the reason of each file, null where it has no sign of its own. Files with the same set of lines are one
    content, however often it was copied; a content that several repositories hold stands in another one as a whole.
    """
    files = (
        lines.where((F.length("__line") >= LEAST_LINE) & F.col("__line").rlike("[A-Za-z_]{3}"))
        .groupBy("repo", "file_path")
        .agg(F.sort_array(F.collect_set(F.xxhash64("__line"))).alias("__lines"))
    )
    seeds = judged.where("reason = 'vendored'").select("repo", "file_path", F.lit(True).alias("__seed"))
    members = cut_lineage(
        files.join(seeds, [files.repo.eqNullSafe(seeds.repo), files.file_path == seeds.file_path], "left").select(
            files.repo, files.file_path, "__seed", F.xxhash64("__lines").alias("__content"), "__lines"
        )
    )
    repo = F.coalesce(F.concat(F.lit("r"), "repo"), F.lit(""))  # a null repo is one of its own
    contents = members.groupBy("__content").agg(
        F.min(repo).alias("__low"), F.max(repo).alias("__high"), F.max("__seed").alias("__seed"), F.count(F.lit(1)).alias("__files"), F.first("__lines").alias("__lines")
    )
    posted = contents.select("__content", "__low", "__high", "__seed", "__files", F.explode("__lines").alias("__hash"))
    sizes = contents.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__lines")), F.lit(0))).first()
    n_contents, n_posted = int(sizes[0]), int(sizes[1])
    seed = F.when(F.col("__seed"), F.col("__content"))
    index = cut_lineage(
        posted.groupBy("__hash").agg(
            F.count(F.lit(1)).alias("__n"), F.min("__low").alias("__from"), F.max("__high").alias("__to"), F.min(seed).alias("__seed_from"), F.max(seed).alias("__seed_to")
        )
    )
    hot = salts_of(index, ["__hash"], n_posted)
    met = join_around(hot, posted, index, ["__hash"], F.col("__content"))
    elsewhere = (F.col("__from") < F.col("__low")) | (F.col("__to") > F.col("__low")) | (F.col("__seed_from") != F.col("__content")) | (F.col("__seed_to") != F.col("__content"))
    elsewhere = F.coalesce(elsewhere, F.lit(False)) | (F.coalesce("__seed", F.lit(False)) & (F.col("__files") > 1))
    rare = F.col("__n") <= max(-(-n_contents * RARE_SHARE // 1), RARE_FILES)
    weight = F.log(F.lit(1.0 + n_contents) / F.col("__n"))
    sums = met.groupBy("__content").agg(
        F.count_if(elsewhere).alias("__shared"),
        F.count_if(rare & elsewhere).alias("__rare_shared"),
        F.count_if(rare).alias("__rare"),
        F.sum(F.when(elsewhere, weight).otherwise(0.0)).alias("__weight_shared"),
        F.sum(weight).alias("__weight"),
    )
    of_rare = F.when(F.col("__rare_shared") >= LEAST_SHARED, F.col("__rare_shared") / F.col("__rare"))
    of_all = F.when(F.col("__shared") >= LEAST_SHARED, F.col("__weight_shared") / F.col("__weight"))
    found = sums.select("__content", F.greatest(of_rare, of_all).alias("containment")).where(F.col("containment") >= CONTAINMENT)
    return members.join(found, "__content").select("repo", "file_path", "containment")


def foreign_files(chunks: DataFrame) -> DataFrame:
    """repo, file_path, reason, containment: the code files that nobody in the project wrote by hand, once each.

    reason is vendored, generated, minified, data, or copy (no sign of its own, but `containment` of its lines stands in
    other repositories or vendored files). Paths have `/` and no leading `./`; repeated chunks change nothing; null and empty
    sources leave the path to decide; a null path or one with another ending is no code file; a null repo is a repo of
    its own; an empty table gives no rows; other columns are ignored.
    """
    lines = _files_and_lines(chunks)
    judged = cut_lineage(own_evidence(composition(lines)))  # one row for each file, wanted twice below
    copies = contained_files(lines, judged).select(F.col("repo").alias("__repo"), F.col("file_path").alias("__path"), "containment")
    both = judged.join(copies, [judged.repo.eqNullSafe(copies["__repo"]), judged.file_path == copies["__path"]], "left")
    reason = F.coalesce("reason", F.when(F.col("containment").isNotNull(), "copy"))
    return both.select("repo", "file_path", reason.alias("reason"), "containment").where("reason is not null")
