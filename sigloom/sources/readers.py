"""Readers of catalogues, version lists, per-version class files and name mappings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import codes, names

SIGS_FORMAT = 1
SEED = Path(__file__).with_name("seed_catalogue.txt")


def text_lines(files: DataFrame) -> DataFrame:
    """(path, lineno, line) of files (path, value); numbers from 1."""
    lines = F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("k", "line")
    return files.select("path", lines).select("path", (F.col("k") + 1).alias("lineno"), "line")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """(coord, repo, pos) of lines (lineno, line): two fields, ``#`` begins a comment.
    Repeated coordinates stay. Any other line is an error that names its number."""
    bare = lines.withColumn("bare", F.trim(F.regexp_replace(F.regexp_replace("line", "#.*", ""), r"\s+", " "))).where("bare != ''")
    parts = F.split("bare", " ")
    good = (F.size(parts) == 2) & F.contains(F.get(parts, F.lit(0)), F.lit(":"))
    problem = F.raise_error(F.concat(F.lit("catalogue line "), F.col("lineno").cast("string"), F.lit(": expected 'group:artifact repo'")))
    return bare.select(F.when(good, F.get(parts, F.lit(0))).otherwise(problem).alias("coord"), F.get(parts, F.lit(1)).alias("repo"), F.col("lineno").alias("pos"))


def parse_catalogue_json(files: DataFrame) -> DataFrame:
    """(coord, repo, pos) of files (value) with a list of objects; the first entry of a
    coordinate counts, other keys are ignored, a missing key is an error."""
    items = F.posexplode(F.from_json("value", "array<struct<coordinate:string,repository:string>>")).alias("pos", "x")
    rows = files.select(items).select("pos", "x.coordinate", "x.repository")
    whole = F.when(F.col("coordinate").isNotNull() & F.col("repository").isNotNull(), F.col("coordinate")).otherwise(F.raise_error(F.lit("a catalogue entry lacks coordinate or repository")))
    first = rows.withColumn("coord", whole).groupBy("coord").agg(F.min(F.struct("pos", F.col("repository").alias("repo"))).alias("f"))
    return first.select("coord", "f.repo", "f.pos")


def load_catalogue(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The built-in seed, a JSON list, or text, by the name of the file."""
    if path is None:
        rows = [(k + 1, line) for k, line in enumerate(SEED.read_text().splitlines())]
        return parse_catalogue(spark.createDataFrame(rows, "lineno int, line string"))
    if path.endswith(".json"):
        return parse_catalogue_json(whole_files(spark, path))
    return parse_catalogue(text_lines(whole_files(spark, path)))


def list_versions(files: DataFrame) -> DataFrame:
    """(coord, version, pos) of metadata files (coord, value), in document order; empty
    ones are dropped. Files come from a local mirror: there is no network here."""
    found = F.posexplode(F.xpath("value", F.lit("//versions/version/text()"))).alias("pos", "version")
    return files.select("coord", found).where(F.trim("version") != "")


#: A lone half of a surrogate pair in JSON: kept as its six literal characters, which
#: Spark's strings can hold.
_LONE_HIGH = r"(?i)(?<!\\)((?:\\\\)*)\\(ud[89ab][0-9a-f]{2})(?!\\ud[c-f][0-9a-f]{2})"
_LONE_LOW = r"(?i)(?<!\\ud[89ab][0-9a-f]{2})(?<!\\)((?:\\\\)*)\\(ud[c-f][0-9a-f]{2})"


def load_sigs(spark: SparkSession, path: str) -> DataFrame:
    """Class observations of cached files: path, coord, version, repo, packaging, digest,
    sig_stamp, fqcn, hi, lo, strings, instructions, seq. A file that is not JSON, lacks a
    key, has another format or one malformed class is dropped whole; ``seq`` orders by
    path, then by place in the file. A file may hold several objects, each begun on a line
    of its own (see ``save_sigs``); these stand and fall apart."""
    schema = "format int, coord string, version string, repo string, packaging string, digest string, sig_stamp string, classes array<array<string>>"
    escaped = F.regexp_replace(F.regexp_replace("value", _LONE_HIGH, r"$1\\\\$2"), _LONE_LOW, r"$1\\\\$2")
    # Text without such an escape, which is nearly all, is spared two patterns at every place.
    safe = F.when(F.contains("value", F.lit(r"\ud")) | F.contains("value", F.lit(r"\uD")) | F.contains("value", F.lit(r"\U")), escaped).otherwise(F.col("value"))
    objects = whole_files(spark, path).select("path", F.posexplode(F.split("value", r"\n(?=\{)")).alias("nth", "value"))
    files = objects.select("path", "nth", F.from_json(safe, schema).alias("d")).select("path", "nth", "d.*")
    well = F.forall("classes", lambda c: (F.size(c) == 4) & F.rlike(F.get(c, F.lit(1)), F.lit(r"\A[0-9a-fA-F]{1,32}\z")) & F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(3)).try_cast("int").isNotNull())
    good = files.where((F.col("format") == SIGS_FORMAT) & F.col("coord").isNotNull() & F.col("version").isNotNull() & F.col("sig_stamp").isNotNull() & F.col("classes").isNotNull() & well)
    rows = good.select("path", "nth", "coord", "version", "repo", "packaging", "digest", "sig_stamp", F.posexplode_outer("classes").alias("at", "c"))
    hi, lo = codes.lanes_of_hex(F.get("c", F.lit(1)))
    seq = F.struct("path", "nth", "at")
    return rows.select("path", "coord", "version", "repo", "packaging", "digest", "sig_stamp", F.get("c", F.lit(0)).alias("fqcn"), hi.alias("hi"), lo.alias("lo"), F.from_json(F.get("c", F.lit(2)), "array<string>").alias("strings"), F.get("c", F.lit(3)).cast("int").alias("instructions"), seq.alias("seq"))


def iter_cached_sigs(spark: SparkSession, cache: str) -> DataFrame:
    return load_sigs(spark, f"{cache.rstrip('/')}/*/*.sigs.json")


def save_sigs(obs: DataFrame, cache: str) -> None:
    """Observations as one JSON row for each (coord, version), in a folder of its own that
    is replaced as a whole; readable by ``load_sigs`` as ``cache/*/*.json``."""
    classes = F.transform(F.array_sort(F.collect_list(F.struct("seq", "fqcn", "hi", "lo", "strings", "instructions"))), lambda x: F.array(x["fqcn"], codes.hex_of_lanes(x["hi"], x["lo"]), F.to_json(x["strings"]), x["instructions"].cast("string")))
    rows = obs.groupBy("coord", "version", "repo", "packaging", "digest", "sig_stamp").agg(classes.alias("classes")).withColumn("format", F.lit(SIGS_FORMAT))
    rows.withColumn("dir", names.coord_dir(F.col("coord"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dir").json(cache)


def parse_class_mapping(lines: DataFrame) -> DataFrame:
    """(original, obfuscated) of lines (lineno, line): unindented ``a -> b:`` only; the
    last line of an original counts."""
    return mapping_in_order(lines).drop("pos")


def mapping_in_order(lines: DataFrame) -> DataFrame:
    """The same with ``pos``, the line that names the original first."""
    kept = lines.where(~F.rlike("line", F.lit(r"^(\s|#|$)")) & F.rlike("line", F.lit(r":\s*$")) & F.contains("line", F.lit(" -> ")))
    bare = F.regexp_replace(F.rtrim("line"), r":$", "")
    at = F.locate(" -> ", bare)
    pairs = kept.select("lineno", F.trim(F.substring(bare, F.lit(1), at - 1)).alias("original"), F.trim(F.substring(bare, at + 4, F.length(bare))).alias("obfuscated"))
    return pairs.groupBy("original").agg(F.max_by("obfuscated", "lineno").alias("obfuscated"), F.min("lineno").alias("pos"))


def invert(mapping: DataFrame) -> DataFrame:
    """(obfuscated, original) of a mapping with ``pos``; of several originals the one that
    came last."""
    return mapping.groupBy("obfuscated").agg(F.max_by("original", "pos").alias("original"))


def load_build(spark: SparkSession, spec: str) -> tuple[DataFrame, DataFrame]:
    """Class rows (Parquet) and class mapping of a build, named as ``rows:mapping``. The
    last colon splits, so paths may have a scheme before the first one's."""
    rows, _, mapping = spec.rpartition(":")
    if not rows or not mapping:
        raise ValueError(f"{spec!r} is not rows:mapping")
    return spark.read.parquet(rows), mapping_in_order(text_lines(whole_files(spark, mapping)))
