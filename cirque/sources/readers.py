"""Sources: catalogs, FASTA, GFF, tabular hits, taxonomy dumps, checksum manifests and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirque.operators.catalog import last_of

#: Places of the catalog's columns, and the columns of a hit file.
CATALOG = {"assembly_accession": 0, "biosample_accession": 2, "ref_seq_cat": 4, "tax_id": 5, "species_tax_id": 6, "organism_name": 7, "infraspecific_name": 8, "assembly_level": 11, "assembly_name": 15, "ftp_location": 19, "ref_seq_status": 20}
HITS = "replicon string, sstart long, send long, match_length long, sframe int, pident double, evalue double, qseqid string, qstart long, qend long"


def file_order() -> Column:
    """A key in which lines of several files sort by file, then by place: files are split and packed into tasks in another order.

    Lines of one split are read one after the other, so their numbers rise; splits are ordered by where they begin.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def read_assembly_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each subdir_name, in the order of ``file_order``. The first line of a file goes whatever it holds, further ones that begin with #, and empty ones."""
    raw = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("escape", "").csv(path)
    lines = raw.withColumn("ord", file_order()).where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t", -1)
    x = lines.select("ord", *(parts[i].alias(c) for c, i in CATALOG.items()))
    name = F.translate(F.replace("assembly_name", F.lit("  "), F.lit(" ")), " #/()", "_____")
    x = x.withColumn("assembly_level", F.lower("assembly_level")).withColumn("assembly_name", name).withColumn("subdir_name", F.concat_ws("_", "assembly_accession", "assembly_name"))
    return last_of(x, "subdir_name", "ord").drop("ord")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """assembly (the file's folder), replicon, len and seq of each record."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("assembly", F.element_at(F.split("_metadata.file_path", "/"), -2))
    x = raw.withColumn("value", F.regexp_replace("value", "^>", "")).where(F.length("value") > 0)
    seq = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"[\r\n]", ""))
    return x.select("assembly", F.regexp_extract("value", r"^[^ \r\n]*", 0).alias("replicon"), F.length(seq).cast("long").alias("len"), seq.alias("seq"))


def read_replicons(spark: SparkSession, path: str) -> DataFrame:
    """assembly, replicon, len and seq of files that hold one sequence each and have its accession as their name, in a folder for each assembly."""
    raw = spark.read.option("wholetext", True).text(path).withColumns({"assembly": F.element_at(F.split("_metadata.file_path", "/"), -2), "replicon": F.col("_metadata.file_name")})
    seq = F.upper(F.regexp_replace("value", r"\s", ""))
    return raw.select("assembly", "replicon", F.length(seq).cast("long").alias("len"), seq.alias("seq")).where("len > 0")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).withColumn("ord", file_order()).withColumn("assembly", F.element_at(F.split("_metadata.file_path", "/"), -2))
    # a projection for each step: written as one, a line would be split again for each key that its attributes are looked up by
    x = raw.where((F.length("value") > 0) & ~F.col("value").startswith("#")).select("assembly", "ord", F.split("value", "\t", -1).alias("p"))
    p = F.col("p")
    strand = F.when(p[6] == "+", "Forward").when(p[6] == "-", "Reverse").otherwise("Other")
    plain = [p[0].alias("replicon"), p[1].alias("source"), p[2].alias("feature_type"), (p[3].cast("long") - 1).alias("start_bound"), p[4].cast("long").alias("end_bound"), strand.alias("strand")]
    x = x.select("assembly", *plain, F.transform(F.filter(F.split(p[8], ";"), lambda s: F.length(s) > 0), lambda s: F.split(s, "=")).alias("pairs"), "ord")
    x = x.withColumn("names", F.transform("pairs", lambda a: a[0])).withColumn("keys", F.array_distinct("names"))
    # the last of equal keys wins, whatever the session's rule for duplicate map keys is
    last = F.transform("keys", lambda k: F.element_at(F.filter("pairs", lambda a: a[0] == k), -1))
    every = F.when(F.size("keys") == F.size("names"), F.col("pairs")).otherwise(last)
    attributes = F.map_from_arrays("keys", F.transform(every, lambda a: F.coalesce(F.get(a, F.lit(1)), F.lit(""))))
    return x.withColumn("attributes", attributes).select("assembly", "replicon", "source", "feature_type", "start_bound", "end_bound", "strand", "attributes", "ord")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("_metadata.file_name", "[.]"), 1)
    ok = F.when(name.isin("CopA", "CupA", "CopY", "CopZ"), name).otherwise(F.raise_error(F.concat(F.lit("unknown hit type: "), name)))
    return spark.read.schema(HITS).option("sep", "\t").option("comment", "#").csv(path).withColumn("assoc_type", ok)


def _dump(spark: SparkSession, path: str):
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t", -1).alias("p"))


def read_tax_names(spark: SparkSession, path: str) -> DataFrame:
    return _dump(spark, path).where(F.lower(F.col("p")[3]) == "scientific name").select(F.col("p")[0].cast("long").alias("tax_id"), F.col("p")[1].alias("name"))


def read_tax_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _dump(spark, path).select(F.col("p")[0].cast("long").alias("tax_id"), F.col("p")[1].cast("long").alias("parent_id"), F.col("p")[2].alias("rank"))


def read_tax_species(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t", -1)
    return spark.read.text(path).select(p[2].cast("long").alias("tax_id"), p[1].cast("long").alias("species_id"))


def read_md5_manifest(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "  ", 2)
    return spark.read.text(path).where(F.length("value") > 0).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("assembly"), F.regexp_replace(p[1], r"^\./", "").alias("file_name"), p[0].alias("expected_md5"))


#: What files of an assembly are by the end of their names.
KINDS = {".fna": "sequence", ".gff": "annotation", "_feature_table.txt": "feature_table", "md5checksums.txt": "manifest"}


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def _described(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.regexp_replace(name, r"[.]gz$", "")
    kind = F
    for end, is_ in KINDS.items():
        kind = kind.when(plain.endswith(end), is_)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("assembly"), name.alias("file_name"), kind.otherwise("other").alias("kind"), name.endswith(".gz").alias("compressed"), *files.columns)


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """assembly (the folder), file_name, kind, compressed, length and path of every file below ``root``; no content is read."""
    return _described(_binary(spark, root, glob).select("path", "length"))


def checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``inventory`` with md5, computed where the files are read. A file of 2 GB or more is an error of the reader."""
    return _described(_binary(spark, root, glob).select("path", "length", F.md5("content").alias("md5")))


def list_assembly_files(spark: SparkSession, root: str) -> DataFrame:
    """The sequences and annotations that can be read as they are, without those packed in .gz files."""
    return inventory(spark, root).where(F.col("kind").isin("sequence", "annotation") & ~F.col("compressed")).drop("compressed")
