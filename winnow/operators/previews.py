"""What a file or directory shows of itself in a navigation request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import bytes as B
from winnow.functions import paths as P
from winnow.limits import LIMITS, Limits


def directory_entries(entries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """parent, name, kind of the entries that a directory's preview holds.

    Entries go in by path until there are ``directory_entries`` or their JSON would pass
    ``directory_bytes``. Sizes are positive, so stopping at the first overflow is a filter on the
    running sum.
    """
    name = P.basename(F.col("path"))
    rows = entries.select("parent", name.alias("name"), "kind", "path")
    by_path = Window.partitionBy("parent").orderBy("path")
    # the first entries alone, which each task finds among its own before a directory's rows meet
    first = rows.withColumn("n", F.row_number().over(by_path)).where(F.col("n") <= limits.directory_entries)
    size = F.octet_length(F.to_json(F.struct("name", "kind")))
    used = first.withColumn("used", F.sum(size).over(by_path.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where(F.col("used") <= limits.directory_bytes).select("parent", "name", "kind", F.col("n").cast("long").alias("n"))


def directory_previews(entries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """path, preview (JSON) of each directory that has entries: what stands in it, and whether there is more."""
    shown = directory_entries(entries, limits)
    kinds = lambda k: F.sum((F.col("kind") == k).cast("long"))
    per = shown.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("name", "kind"))).alias("entries"), kinds("file").alias("sampledFiles"), kinds("directory").alias("sampledDirectories"), F.count(F.lit(1)).alias("shown"))
    ext = extension_histogram(shown).groupBy("parent").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("extension", "n")))).alias("sampledExtensions"))
    whole = entries.groupBy("parent").agg(F.count(F.lit(1)).alias("all"))
    out = per.join(whole, "parent").join(ext, "parent", "left").withColumn("truncated", F.col("shown") < F.col("all"))
    none = F.create_map().cast("map<string,bigint>")
    return out.select(F.col("parent").alias("path"), F.to_json(F.struct("entries", "truncated", "sampledFiles", "sampledDirectories", F.coalesce("sampledExtensions", none).alias("sampledExtensions"))).alias("preview"))


def directory_samples(entries: DataFrame, files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """path, samples: opening, middle and end of the files that a directory's preview names.

    files: path, text, bytes. Samples are cut before they meet, so a directory holds a bounded text.
    """
    shown = directory_entries(entries, limits).where("kind = 'file'")
    count = shown.groupBy("parent").agg(F.greatest(F.floor(F.lit(limits.sample_bytes) / F.count(F.lit(1))), F.lit(limits.sample_chars)).cast("int").alias("per"))
    path = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat("parent", F.lit("/"), "name"))
    named = shown.join(count, "parent").withColumn("path", path).join(files.where(F.col("bytes") <= limits.inspected_bytes).select("path", "text"), "path")
    each = F.struct("name", (F.length("text") > F.col("per")).alias("truncated"), three_part_sample(F.col("text"), F.col("per")).alias("source"))
    return named.groupBy("parent").agg(F.sort_array(F.collect_list(each)).alias("samples")).withColumnRenamed("parent", "path")


def extension_histogram(shown: DataFrame) -> DataFrame:
    ext = P.extension(F.col("name"))
    return shown.where("kind = 'file'").groupBy("parent", F.when(ext == "", "[no extension]").otherwise(ext).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def file_preview(text: Column, limits: Limits = LIMITS) -> Column:
    """The file's beginning; while its JSON is too long, three quarters of it are kept."""
    # JSON of 16,384 bytes has at most six times as many: six steps are enough
    size = lambda h: F.octet_length(F.to_json(F.struct(h.alias("s")))) - 6
    cut = lambda h, _: F.when(size(h) > limits.preview_json, F.left(h, F.floor(F.length(h) * 3 / 4).cast("int"))).otherwise(h)
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), B.clip_head(text, limits.preview_bytes), cut)


def three_part_sample(text: Column, per_file: Column) -> Column:
    """The whole text if it has at most per_file characters, else its opening, middle and end."""
    n, part = F.length(text), F.floor(per_file / 3).cast("int")
    middle = F.greatest(F.floor(n / 2) - F.floor(part / 2), F.lit(0)).cast("int")
    piece = lambda at: F.concat(F.lit("[character offset "), at.cast("string"), F.lit("]\n"), F.substr(text, at + 1, part))
    parts = F.concat_ws("\n...\n", piece(F.lit(0)), piece(middle), piece(F.greatest(n - part, F.lit(0))))
    return F.when(n <= per_file, text).otherwise(parts)
