"""Infrastructure files: which concrete store do they declare?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BUILTIN, Dictionaries, dim_infra


def infra_words(src: Column) -> Column:
    """Words of a lower-cased infrastructure file, in order."""
    return F.regexp_extract_all(F.lower(src), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))


def infra_tokens(infra_files: DataFrame, d: Dictionaries = BUILTIN) -> DataFrame:
    """Every dictionary token found in ``infra_files(root_idx, walk_key, src)`` with its position and
    the store node and label it stands for."""
    words = infra_files.select("root_idx", "walk_key", F.posexplode(infra_words(F.col("src"))).alias("pos", "token"))
    return words.join(dim_infra(infra_files.sparkSession, d), "token")


def store_relabels(infra_files: DataFrame, d: Dictionaries = BUILTIN) -> DataFrame:
    """``(id, label)`` per store node: the label of the last token in root, walk and text order."""
    order = F.struct("root_idx", "walk_key", "pos")
    return (infra_tokens(infra_files, d).groupBy(F.col("enrich_id").alias("id"))
            .agg(F.max_by("label", order).alias("label")))
