"""Which files count, what language they are in, and which of them declare infrastructure.

Works on any DataFrame with ``rel`` (path below its root), ``name``, ``path`` and ``length``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import dims
from .languages import builtin_languages


def prune_dirs(files: DataFrame) -> DataFrame:
    """Drop files below an ignored or hidden directory. The root itself and hidden files stay."""
    return files.filter(~F.exists(directories(F.col("rel")), is_pruned_dir))


def directories(rel: Column) -> Column:
    parts = F.split(rel, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_pruned_dir(name: Column) -> Column:
    return name.isin(dims.IGNORED_DIRS) | name.startswith(".")


def filter_size(files: DataFrame) -> DataFrame:
    """Keep files of 1 byte to 1 MiB."""
    return files.filter((F.col("length") > 0) & (F.col("length") <= dims.MAX_FILE_BYTES))


def extension(name: Column) -> Column:
    """The last dot and what follows it; empty without a dot."""
    return F.regexp_extract(name, r"(\.[^.]*)\z", 1)


def filter_names(files: DataFrame) -> DataFrame:
    """Drop data and generated formats, lock files and minified files, ignoring case."""
    name = F.lower("name")
    return files.filter(~(extension(name).isin(dims.SKIPPED_EXTENSIONS) | name.isin(dims.LOCKFILES)
                          | name.contains(".min.")))


def detect_language(files: DataFrame, languages: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add ``language`` by exact file name, else by extension; null if unknown."""
    rows = builtin_languages() if languages is None else languages
    by_name = dims.lookup([r for r in rows if not r[0].startswith(".")], F.col("name"))
    by_extension = dims.lookup([r for r in rows if r[0].startswith(".")], F.lower(extension(F.col("name"))))
    return files.withColumn("language", F.coalesce(by_name, by_extension))


def route_infra(files: DataFrame) -> DataFrame:
    """Add ``is_infra``: Terraform, Compose, serverless and chart files, and YAML whose path (as
    walked, root included) speaks of deployment."""
    name, path = F.lower("name"), F.lower("path")
    ext = extension(name)
    named = name.isin(dims.INFRA_NAMES)
    for start in dims.INFRA_NAME_STARTS:
        named = named | name.startswith(start)
    deployed = F.lit(False)
    for word in dims.DEPLOY_WORDS:
        deployed = deployed | path.contains(word)
    return files.withColumn("is_infra", (
        ext.isin(dims.INFRA_EXTENSIONS) | named | F.coalesce(F.col("language").isin(dims.INFRA_LANGUAGES), F.lit(False))
        | (ext.isin(dims.YAML_EXTENSIONS) & deployed)))


def scan_stats(files: DataFrame) -> DataFrame:
    """One row from routed files: files, parsed, infra, languages (map of counts over parsed files).

    ``readable`` is optional; an unreadable file only counts as a file.
    """
    readable = F.col("readable") if "readable" in files.columns else F.lit(True)
    lang = F.when(readable & ~F.col("is_infra"), F.col("language"))
    # first per language, which is a handful of rows whatever the number of files
    per_language = files.groupBy(lang.alias("language")).agg(
        F.count("*").alias("files"), F.count_if(readable & F.col("is_infra")).alias("infra"))
    known = F.col("language").isNotNull()
    return per_language.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.when(known, F.col("files"))), F.lit(0)).alias("parsed"),
        F.coalesce(F.sum("infra"), F.lit(0)).alias("infra"),
        F.map_from_entries(F.sort_array(F.collect_list(
            F.when(known, F.struct("language", "files"))))).alias("languages"))


class ObservedStats:
    """The numbers of ``scan_stats`` as metrics of a pass that runs anyway: pass ``watched`` on in place of the files; when it has been read once, ``frame`` has the row.
    Languages are counted by name, ``languages`` being all that files can have."""

    def __init__(self, files: DataFrame, languages: list[str] | None = None):
        self._names = sorted(set(languages if languages is not None else (lang for _, lang in builtin_languages())))
        self._seen, self._spark = Observation(), files.sparkSession
        readable = F.col("readable") if "readable" in files.columns else F.lit(True)
        code = readable & ~F.col("is_infra")
        per_language = [F.count_if(code & (F.col("language") == name)).alias(f"l{k}") for k, name in enumerate(self._names)]
        self.watched = files.observe(self._seen, F.count("*").alias("files"), F.count_if(readable & F.col("is_infra")).alias("infra"), *per_language)

    def frame(self) -> DataFrame:
        """One row as ``scan_stats`` gives it; waits until the pass has ended."""
        seen = self._seen.get
        counts = {name: seen[f"l{k}"] for k, name in enumerate(self._names) if seen.get(f"l{k}")}
        row = (seen.get("files", 0), sum(counts.values()), seen.get("infra", 0), counts)
        return self._spark.createDataFrame([row], "files bigint, parsed bigint, infra bigint, languages map<string,bigint>")
