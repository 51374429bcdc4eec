"""Sources and sinks over the given tables: rows are written as the lines of a format and read back by its reader."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirque.functions.frames import shared_folder
from cirque.operators import catalog as A
from cirque.sources import readers as R
from cirque.sources import sinks as K

from .adapters import view, with_views
from .queries import _features, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex[:16]}"


def _lines(df: DataFrame, line: Column, folder: str, by: str | None = None) -> str:
    out = df.select(line.alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).text(folder)
    return folder


def _renamed(spark: SparkSession, pattern: str, name: Callable[[int], str]) -> None:
    """Gives files that Spark has written the names that a format asks for."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, f in enumerate(fs.globStatus(path(pattern)) or []):
        target = path(name(k))
        fs.mkdirs(target.getParent())
        fs.rename(f.getPath(), target)


def _tabs(*columns) -> Column:
    return F.concat_ws("\t", *columns)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


@query(f"{with_views('ad_assemblies')} SELECT assembly_accession || '_a_b_c' AS subdir_name, assembly_accession, species_tax_id, tax_id, organism_name, infraspecific_name, 'complete genome' AS assembly_level FROM ad_assemblies")
def s1_catalog_round_trip(spark, d):
    blank = F.lit("")
    rows = view(spark, d, "ad_assemblies")
    line = _tabs("assembly_accession", blank, blank, blank, blank, "tax_id", "species_tax_id", "organism_name", "infraspecific_name", blank, blank, F.lit("Complete Genome"), blank, blank, blank, F.lit("a  b/c"), blank, blank, blank, F.lit("na"), blank)
    folder = _folder(spark, "catalog")  # a header comes before the rows of each file
    rows.select(line.alias("the first line of a file")).write.option("header", True).option("sep", "\x01").option("quote", "").option("escapeQuotes", False).csv(folder)
    return R.read_assembly_catalog(spark, folder).select("subdir_name", "assembly_accession", "species_tax_id", "tax_id", "organism_name", "infraspecific_name", "assembly_level")


@query(f"{with_views('ad_sequences')} SELECT 'd' || CAST(doc_id AS VARCHAR) AS replicon, CAST(length(seq) AS BIGINT) AS len, md5(seq) AS seq_md5 FROM ad_sequences")
def s2_fasta_round_trip(spark, d):
    folder = _folder(spark, "fasta")
    K.write_fasta(view(spark, d, "ad_sequences").select(F.concat(F.lit("d"), _text("doc_id")).alias("replicon"), "seq"), folder)
    return R.read_fasta(spark, folder).select("replicon", "len", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(f"{with_views('ad_features')} SELECT assembly, replicon, strand, start_bound, end_bound, feature_type, 'f' || CAST(ord AS VARCHAR) AS id, 'b' AS name FROM ad_features")
def s3_gff_round_trip(spark, d):
    rows = _features(spark, d)
    sign = F.when(F.col("strand") == "Forward", "+").otherwise("-")
    line = _tabs("replicon", F.lit("src"), "feature_type", (F.col("start_bound") + 1).cast("string"), _text("end_bound"), F.lit("."), sign, F.lit("0"), F.concat(F.lit("ID=x;Name=b=c;ID=f"), _text("ord")))
    got = R.read_gff(spark, _lines(rows, line, _folder(spark, "gff"), "assembly") + "/*")
    a = F.col("attributes")
    return got.select(F.regexp_replace("assembly", "^assembly=", "").alias("assembly"), "replicon", "strand", "start_bound", "end_bound", "feature_type", a["ID"].alias("id"), a["Name"].alias("name"))


@query(f"{with_views('ad_hits')} SELECT replicon, sstart, send, match_length, CAST(sframe AS INT) AS sframe, pident, round(evalue * 1e13, 6) AS evalue_e13, qseqid, CAST(hit_id % 50 + 1 AS BIGINT) AS qstart, CAST(hit_id % 50 + match_length AS BIGINT) AS qend, assoc_type FROM ad_hits")
def s4_hits_round_trip(spark, d):
    folder = _folder(spark, "hits")
    at = F.col("hit_id") % 50
    line = _tabs("replicon", *(_text(c) for c in ("sstart", "send", "match_length", "sframe", "pident", "evalue")), "qseqid", (at + 1).cast("string"), (at + F.col("match_length")).cast("string"))
    files = _lines(view(spark, d, "ad_hits"), line, f"{folder}/parts", "assoc_type")
    for kind in ("CopA", "CupA", "CopY", "CopZ"):  # a hit file is named by its type
        _renamed(spark, f"{files}/assoc_type={kind}/part-*", lambda k, kind=kind: f"{folder}/named/{kind}.{k}")
    got = R.read_hits(spark, f"{folder}/named")
    return got.select("replicon", "sstart", "send", "match_length", "sframe", "pident", F.round(F.col("evalue") * 1e13, 6).alias("evalue_e13"), "qseqid", "qstart", "qend", "assoc_type")


@query(f"{with_views('ad_tax_nodes', 'ad_tax_species')} SELECT n.tax_id, n.parent_id, n.name, 'rank ' || CAST(n.parent_id % 7 AS VARCHAR) AS rank, s.species_id FROM ad_tax_nodes n LEFT JOIN ad_tax_species s USING (tax_id)")
def s5_taxonomy_round_trip(spark, d):
    nodes, bar = view(spark, d, "ad_tax_nodes"), "\t|\t"
    dump = lambda *c: F.concat(F.concat_ws(bar, *c), F.lit("\t|"))
    names = _lines(nodes.withColumn("kind", F.explode(F.array(F.lit("scientific name"), F.lit("synonym")))), dump(_text("tax_id"), F.when(F.col("kind") == "synonym", "another").otherwise(F.col("name")), F.lit(""), "kind"), _folder(spark, "names"))
    tree = _lines(nodes, dump(_text("tax_id"), _text("parent_id"), F.concat(F.lit("rank "), (F.col("parent_id") % 7).cast("string"))), _folder(spark, "nodes"))
    cats = _lines(view(spark, d, "ad_tax_species"), _tabs(F.lit("B"), _text("species_id"), _text("tax_id")), _folder(spark, "categories"))
    got = R.read_tax_nodes(spark, tree).join(R.read_tax_names(spark, names), "tax_id").join(R.read_tax_species(spark, cats), "tax_id", "left")
    return got.select("tax_id", "parent_id", "name", "rank", "species_id")


@query(f"{with_views('ad_manifest')} SELECT assembly, file_name, expected_md5 FROM ad_manifest")
def s6_manifest_round_trip(spark, d):
    rows = view(spark, d, "ad_manifest")
    got = R.read_md5_manifest(spark, _lines(rows, F.concat("expected_md5", F.lit("  ./"), "file_name"), _folder(spark, "md5"), "assembly") + "/*")
    return got.withColumn("assembly", F.regexp_replace("assembly", "^assembly=", ""))


@query("SELECT 'k=' || CAST(k AS VARCHAR) AS assembly, 'sequence' AS kind, CAST(sum(n) AS BIGINT) AS total_bytes FROM (SELECT doc_id % 7 AS k, octet_length(encode(CAST(doc_id AS VARCHAR))) + 1 AS n FROM documents) GROUP BY 1")
def s7_listed_files(spark, d):
    folder = _folder(spark, "files")
    docs = spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 7).alias("k"), _text("doc_id").alias("value"))
    docs.write.partitionBy("k").text(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(hadoop.Path(f"{folder}/k=*/part-*")):
        fs.rename(f.getPath(), hadoop.Path(f.getPath().toString().removesuffix(".txt") + ".fna"))
    return R.list_assembly_files(spark, folder).groupBy("assembly", "kind").agg(F.sum("length").alias("total_bytes"))


@query(f"{with_views('ad_replicons')} SELECT assembly, replicon, len FROM ad_replicons")
def k1_summary_round_trip(spark, d):
    folder = _folder(spark, "summary")
    K.write_summary(view(spark, d, "ad_replicons"), folder, ("assembly", "replicon"))
    return spark.read.schema("assembly string, replicon string, len long").option("sep", "\t").csv(folder)


@query(f"{with_views('ad_catalog')} SELECT DISTINCT dir_name FROM ad_catalog")
def k2_id_list_round_trip(spark, d):
    folder = _folder(spark, "ids")
    K.write_id_list(view(spark, d, "ad_catalog").select("dir_name").distinct(), folder)
    return spark.read.text(folder).withColumnRenamed("value", "dir_name")


@query(f"{with_views('ad_catalog')} SELECT dir_name, assembly_level, ord FROM ad_catalog")
def k3_catalog_csv_round_trip(spark, d):
    folder = _folder(spark, "csv")
    K.write_catalog_csv(view(spark, d, "ad_catalog").select("dir_name", "assembly_level", "ord"), folder)
    return spark.read.option("header", True).schema("dir_name string, assembly_level string, ord long").csv(folder)


_DIR = "'GC' || CASE WHEN k % 2 = 0 THEN 'F' ELSE 'A' END || '_' || CAST(k AS VARCHAR)"


@query(f"""WITH f AS (SELECT doc_id % 24 AS k, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY 1), d AS (SELECT k, {_DIR} AS assembly, octet_length(encode(body)) AS size FROM f)
 SELECT assembly, k % 3 <> 0 AS annotated, k % 5 = 0 AS feature_table, CAST(CASE WHEN k % 7 = 3 THEN 0 WHEN k % 3 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS n_files, k % 7 <> 3 AND k % 4 <> 1 AS good, CAST(size AS BIGINT) AS sequence_bytes FROM d""")
def a11_inventory_round_trip(spark, d):
    """Folders of sequences, annotations, feature tables and manifests; some manifests are wrong, and some folders have none."""
    folder = _folder(spark, "db")
    docs = spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 24).alias("k"), "doc_id", "text")
    kind = F.when(F.col("k") % 2 == 0, "F").otherwise("A")
    name = F.concat(F.lit("GC"), kind, F.lit("_"), F.col("k").cast("string"))
    docs.repartitionById(24, F.pmod("k", F.lit(24)).cast("int")).sortWithinPartitions("k", "doc_id").select(name.alias("assembly"), "text").write.partitionBy("assembly").text(f"{folder}/parts")
    every = [f"GC{'FA'[k % 2]}_{k}" for k in range(24)]
    for k, x in enumerate(every):
        _renamed(spark, f"{folder}/parts/assembly={x}/part-*", lambda _, x=x: f"{folder}/db/{x}/{x}_genomic.fna.gz")
        for end in ["_genomic.gff.gz"] * (k % 3 != 0) + ["_feature_table.txt.gz"] * (k % 5 == 0):
            _lines(spark.range(0, 1, 1, 1), F.lit(x + end), f"{folder}/more/{x}{end}")
            _renamed(spark, f"{folder}/more/{x}{end}/part-*", lambda _, x=x, end=end: f"{folder}/db/{x}/{x}{end}")
    sums = R.checksums(spark, f"{folder}/db").where("kind <> 'feature_table'").withColumn("k", F.element_at(F.split("assembly", "_"), 2).cast("int")).where("k % 7 <> 3")
    line = F.concat(F.when((F.col("k") % 4 == 1) & (F.col("kind") == "sequence"), F.lit("0" * 32)).otherwise(F.col("md5")), F.lit("  ./"), "file_name")
    _lines(sums.repartition("assembly"), line, f"{folder}/sums", "assembly")  # a file each, and contents are hashed before rows meet
    for x in every:
        _renamed(spark, f"{folder}/sums/assembly={x}/part-*", lambda _, x=x: f"{folder}/db/{x}/md5checksums.txt")
    files = R.inventory(spark, f"{folder}/db")
    checked = A.verify_md5(R.read_md5_manifest(spark, f"{folder}/db/*/md5checksums.txt"), R.checksums(spark, f"{folder}/db"), files)
    size = files.where("kind = 'sequence'").select("assembly", F.col("length").alias("sequence_bytes"))
    return A.annotated_assemblies(files).join(checked, "assembly").join(size, "assembly")


@query(f"{with_views('ad_sequences')} SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(octet_length(encode('>d' || CAST(doc_id AS VARCHAR) || chr(10) || seq)) + 1) AS BIGINT) AS bytes, CAST(sum(length(seq)) AS BIGINT) AS letters FROM ad_sequences")
def k4_merged_corpus(spark, d):
    """Annotated and other sequences as one corpus: records and bytes as counted while it was written, letters as read back."""
    folder = _folder(spark, "corpus")
    rows = view(spark, d, "ad_sequences").select(F.concat(F.lit("d"), _text("doc_id")).alias("replicon"), "seq", "doc_id")
    records, size = K.write_corpus([rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0")], folder)
    return R.read_fasta(spark, folder).agg(F.lit(records).cast("long").alias("records"), F.lit(size).cast("long").alias("bytes"), F.sum("len").alias("letters"))


@query(f"{with_views('ad_hits')} SELECT assoc_type, TRUE AS within FROM ad_hits GROUP BY 1")
def a2_replicon_sketches(spark, d):
    """Whether sketches of two halves of the hits, merged, come within 5 % of the number of different replicons."""
    hits = view(spark, d, "ad_hits")
    halves = A.replicon_sketches(hits.where("hit_id % 2 = 0")).unionByName(A.replicon_sketches(hits.where("hit_id % 2 = 1")))
    both = A.merged_sketches(halves).drop("sketch").withColumnRenamed("n_replicons", "about").join(A.distinct_replicons(hits), "assoc_type")
    return both.select("assoc_type", (F.abs(F.col("about") - F.col("n_replicons")) <= F.col("n_replicons") * 0.05).alias("within"))
