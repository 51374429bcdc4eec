"""Assembly catalogs, presence on disk, checksums, hits and taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirque.functions.frames import dealt_join, held

#: Levels that count as complete, sources by prefix, e-value cuts by hit type.
COMPLETE = ("complete genome", "chromosome")
SOURCES = {"GCA_": "GenBank", "GCF_": "RefSeq"}
EVALUES = {"CopA": 1e-12, "CupA": 1e-12, "CopY": 1e-12, "CopZ": 1e-9}


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")


def union_catalogs(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Both; on an equal key the second's row wins, then the later one."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("_s").desc(), F.col(order).desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_s")


def complete_assemblies(df: DataFrame, need_link: bool = True) -> DataFrame:
    out = df.where(F.lower("assembly_level").isin(*COMPLETE))
    return out.where(F.col("ftp_location") != "na") if need_link else out


def ftp_dir_name(link: Column) -> Column:
    return F.element_at(F.split(link, "/"), -1)


def rsync_url(link: Column) -> Column:
    return F.regexp_replace(link, "^https", "rsync")


def split_assembly_prefix(name: Column) -> tuple[Column, Column]:
    """Source and core name; another prefix is an error."""
    p = F.substring(name, 1, 4)
    source = F.raise_error(F.concat(F.lit("unknown source: "), name))
    out = F
    for k, v in SOURCES.items():
        out = F.when(p == k, v) if out is F else out.when(p == k, v)
    return out.otherwise(source), name.substr(F.lit(5), F.length(name))


def source_comparison(df: DataFrame) -> DataFrame:
    """Twelve counts and three totals for ``df`` (dir_name, annotated)."""
    source, core = split_assembly_prefix(F.col("dir_name"))
    x = df.select(source.alias("s"), core.alias("core"), "annotated").groupBy("core").agg(*(F.max((F.col("s") == s) & a).alias(f"{t}{u}") for s, t in (("RefSeq", "r"), ("GenBank", "g")) for u, a in (("", F.lit(True)), ("a", F.col("annotated")), ("u", ~F.col("annotated")))))
    n = lambda c, name: F.count_if(c).alias(name)
    r, ra, ru, g, ga, gu = (F.col(c) for c in ("r", "ra", "ru", "g", "ga", "gu"))
    return x.agg(
        n(r, "refseq"), n(g, "genbank"), n(r & ~g, "refseq_only"), n(g & ~r, "genbank_only"), n(ra, "refseq_annotated"), n(ga, "genbank_annotated"), n(ra & ~ga, "refseq_annotated_only"), n(ga & ~ra, "genbank_annotated_only"),
        n(ru, "refseq_unannotated"), n(gu, "genbank_unannotated"), n(ru & ~g, "refseq_unannotated_only"), n(gu & ~r, "genbank_unannotated_only"), n(r | g, "all_total"), n(ra | ga, "annotated_total"), n(ru | gu, "unannotated_total"),
    )


def unique_assemblies(df: DataFrame) -> DataFrame:
    """Annotated RefSeq, annotated GenBank that RefSeq has not annotated, and unannotated GenBank that RefSeq has not at all."""
    source, core = split_assembly_prefix(F.col("dir_name"))
    x = df.select(source.alias("s"), core.alias("core"), "annotated").distinct()
    ra = x.where("s = 'RefSeq' and annotated").select("core")
    ga = x.where("s = 'GenBank' and annotated").select("core").join(ra, "core", "left_anti")
    gu = x.where("s = 'GenBank' and not annotated").select("core").join(x.where("s = 'RefSeq'").select("core"), "core", "left_anti")
    return ra.select(F.concat(F.lit("GCF_"), "core").alias("dir_name")).unionByName(ga.select(F.concat(F.lit("GCA_"), "core").alias("dir_name"))).unionByName(gu.select(F.concat(F.lit("GCA_"), "core").alias("dir_name"))).distinct()


def assembly_path(root: str, name: Column) -> Column:
    """root/source/name; a name without a known prefix is an error."""
    return F.concat_ws("/", F.lit(root), split_assembly_prefix(name)[0], name)


def source_differences(df: DataFrame) -> DataFrame:
    """(kind, only_in, core): core names that one source has and the other lacks, for all, annotated and unannotated assemblies.

    Unannotated names are compared with all names of the other source.
    """
    source, core = split_assembly_prefix(F.col("dir_name"))
    has = lambda s, a: F.bool_or((F.col("s") == s) & a)
    all_, yes = F.lit(True), F.col("annotated")
    x = df.select(source.alias("s"), core.alias("core"), "annotated").groupBy("core").agg(*(has(s, a).alias(f"{k}{t}") for s, k in (("RefSeq", "r"), ("GenBank", "g")) for t, a in (("", all_), ("a", yes), ("u", ~yes))))
    row = lambda kind, only, mine, other: F.when(F.col(mine) & ~F.col(other), F.struct(F.lit(kind).alias("kind"), F.lit(only).alias("only_in")))
    rows = [row("all", "RefSeq", "r", "g"), row("all", "GenBank", "g", "r"), row("annotated", "RefSeq", "ra", "ga"), row("annotated", "GenBank", "ga", "ra"), row("unannotated", "RefSeq", "ru", "g"), row("unannotated", "GenBank", "gu", "r")]
    return x.select("core", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.kind", "x.only_in", "core")


def missing_assemblies(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of ``listed`` whose dir_name is not ``present``."""
    return listed.join(present.select("dir_name"), "dir_name", "left_anti")


def unmatched_assemblies(genomes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Names of ``genomes`` (dir_name) that the catalog does not list, each once."""
    return genomes.select("dir_name").join(catalog.select("dir_name"), "dir_name", "left_anti").distinct()


def attach_metadata(genomes: DataFrame, assemblies: DataFrame, columns: list[str]) -> DataFrame:
    """``genomes`` (assembly) with ``columns`` of their catalog entry (subdir_name); a genome that the catalog lacks is an error."""
    entry = assemblies.select(F.col("subdir_name").alias("assembly"), F.lit(True).alias("_listed"), *columns)
    listed = F.when(F.col("_listed").isNull(), F.raise_error(F.concat(F.lit("not in the catalog: "), F.coalesce("assembly", F.lit("null"))))).otherwise(F.col("assembly"))
    return genomes.join(entry, "assembly", "left").withColumn("assembly", listed).drop("_listed")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """listed, links, downloaded and missing entries of ``catalog`` (ftp_location, present)."""
    return catalog.agg(F.count("*").alias("listed"), F.count_distinct("ftp_location").alias("links"), F.count_if("present").alias("downloaded"), F.count_if(~F.col("present")).alias("missing"))


def first_assemblies(catalog: DataFrame, n: int = 314, order: str = "ord") -> DataFrame:
    """The first ``n`` entries in file order."""
    return catalog.orderBy(order).limit(n)


def annotated_assemblies(files: DataFrame) -> DataFrame:
    """(assembly, annotated, feature_table): whether a directory holds both annotation and sequence, and the feature table, by their names."""
    named = lambda suffix: F.bool_or(F.col("file_name") == F.concat(F.col("assembly"), F.lit(suffix)))
    return files.groupBy("assembly").agg((named("_genomic.gff.gz") & named("_genomic.fna.gz")).alias("annotated"), named("_feature_table.txt.gz").alias("feature_table"))


def with_annotation(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """``catalog`` (dir_name) with has_annotation, yes or no, by the feature table in its directory."""
    found = annotated_assemblies(files).select(F.col("assembly").alias("dir_name"), "feature_table")
    return catalog.join(found, "dir_name", "left").withColumn("has_annotation", F.when(F.coalesce("feature_table", F.lit(False)), "yes").otherwise("no")).drop("feature_table")


def corpus_bytes(files: DataFrame) -> DataFrame:
    """Bytes and number of ``files`` (length)."""
    return files.agg(F.sum("length").alias("total_bytes"), F.count("*").alias("n"))


def verify_md5(manifest: DataFrame, files: DataFrame, assemblies: DataFrame | None = None) -> DataFrame:
    """assembly, n_files and good: every listed file that is present has the listed checksum. ``files`` has file_name and md5, or content.

    With ``assemblies`` each of them has a row: without a manifest it is bad, with one and no listed file present it is
    good. Otherwise only assemblies with a listed file that is present have one.
    """
    sums = F.col("md5") if "md5" in files.columns else F.md5("content").alias("md5")
    got = manifest.join(files.select("assembly", "file_name", sums), ["assembly", "file_name"])
    got = got.groupBy("assembly").agg(F.count("*").alias("n_files"), F.bool_and(F.col("md5") == F.col("expected_md5")).alias("good"))
    if assemblies is None:
        return got
    has = manifest.select("assembly", F.lit(True).alias("has")).distinct()
    x = assemblies.select("assembly").distinct().join(has, "assembly", "left").join(got, "assembly", "left")
    return x.select("assembly", F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.coalesce("has", F.lit(False)) & F.coalesce("good", F.lit(True))).alias("good"))


def md5_report(verified: DataFrame) -> DataFrame:
    """(good, assembly, n_assemblies): each bad assembly by name, and one row without name for each of good and bad with their numbers."""
    counts = verified.groupBy("good").agg(F.count("*").alias("n_assemblies")).select("good", F.lit(None).cast("string").alias("assembly"), "n_assemblies")
    return counts.unionByName(verified.where("not good").select("good", "assembly", F.lit(1).cast("long").alias("n_assemblies")))


def hits_by_replicon(hits: DataFrame) -> DataFrame:
    """Hits and different queries for each replicon and hit type."""
    return hits.groupBy("replicon", "assoc_type").agg(F.count("*").alias("n_hits"), F.count_distinct("qseqid").alias("n_queries"))


def distinct_replicons(hits: DataFrame) -> DataFrame:
    """Different replicons for each hit type."""
    return hits.groupBy("assoc_type").agg(F.count_distinct("replicon").alias("n_replicons"))


def filter_hits(hits: DataFrame, evalues: dict[str, float] = EVALUES) -> DataFrame:
    cut = F
    for k, v in evalues.items():
        cut = F.when(F.col("assoc_type") == k, v) if cut is F else cut.when(F.col("assoc_type") == k, v)
    return hits.where(F.col("evalue") <= cut)


def top_targets_per_query(hits: DataFrame, k: int = 25_000, parts: int = 512, merge: int = 8) -> DataFrame:
    """Hits of the ``k`` best targets of each query, by least e-value, then name.

    Targets of a query are dealt into ``parts``, each of which keeps its ``k`` best; then ``merge`` parts at a time become
    one that keeps its ``k`` best, until one is left. So no task ranks more than ``merge`` times ``k`` targets of a query, or its part.
    """
    best = hits.groupBy("qseqid", "replicon").agg(F.min("evalue").alias("best")).withColumn("part", F.pmod(F.xxhash64("replicon"), F.lit(parts)).cast("int"))
    w = Window.partitionBy("qseqid", "part").orderBy("best", "replicon")
    while True:
        best = best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
        if parts == 1:
            break
        parts = -(-parts // merge)
        best = best.withColumn("part", F.floor(F.col("part") / merge).cast("int"))
    return hits.join(best.select("qseqid", "replicon"), ["qseqid", "replicon"], "left_semi")


def replicon_sketches(hits: DataFrame, lg_size: int = 14) -> DataFrame:
    """assoc_type and sketch, a HyperLogLog sketch of its replicons, made once a hit file; 2^14 registers err by 0.8 % as a standard deviation."""
    return hits.groupBy("assoc_type").agg(F.hll_sketch_agg("replicon", F.lit(lg_size)).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """assoc_type, sketch and n_replicons, the estimated number of different replicons, of sketches made apart, without the hits."""
    one = sketches.groupBy("assoc_type").agg(F.hll_union_agg("sketch").alias("sketch"))
    return one.withColumn("n_replicons", F.hll_sketch_estimate("sketch"))


def lineage(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tax_id, node, up): each id with itself and its ancestors, by pointer doubling.

    Round i knows for each node the ancestor 2^i steps up and gives every id the ancestors from 2^i to 2^(i+1)-1 steps
    up, so a tree of depth d takes log2(d)+1 rounds. A root is its own parent, or has none, or one without an entry that
    goes further up. Nodes from which ancestors go on for more steps than there are nodes lie above a cycle, which is an
    error. Ids and nodes that occur repeatedly count once, null ids and ids without an entry have only themselves.
    """
    jump = held(nodes.where("parent_id <> tax_id").groupBy(F.col("tax_id").alias("node")).agg(F.max("parent_id").alias("far")))
    total = nodes.count()
    out = ids.select("tax_id").distinct().select("tax_id", F.col("tax_id").alias("node"), F.lit(0).alias("up"))
    span = 1
    while jump.limit(1).count():
        if span > total:
            raise ValueError("the taxonomy has a cycle")
        both = F.array_compact(F.array(F.struct("node", "up"), F.when(F.col("far").isNotNull(), F.struct(F.col("far").alias("node"), (F.col("up") + span).alias("up")))))
        out = held(dealt_join(out, jump, "node", "tax_id", "left").select("tax_id", F.explode(both).alias("x")).select("tax_id", "x.node", "x.up"))
        again = jump.select(F.col("node").alias("far"), F.col("far").alias("further"))
        jump = held(dealt_join(jump, again, "far", "node").select("node", F.col("further").alias("far")))
        span *= 2
    return out


def species_of(ids: DataFrame, species: DataFrame) -> DataFrame:
    """``ids`` (tax_id) with species_id; an id without an entry has none."""
    return ids.join(species.select("tax_id", "species_id"), "tax_id", "left")


def lineage_name(ids: DataFrame, nodes: DataFrame, skip: int = 2) -> DataFrame:
    """tax_id and lineage: names from the root down, joined by ' / ', without the first ``skip``."""
    named = nodes.groupBy(F.col("tax_id").alias("node")).agg(F.max("name").alias("name"))
    x = dealt_join(lineage(ids, nodes), named, "node", "tax_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "name"))), lambda s: s["name"])
    x = x.groupBy("tax_id").agg(names.alias("n"))
    return x.select("tax_id", F.array_join(F.slice("n", skip + 1, F.greatest(F.size("n"), F.lit(1))), " / ").alias("lineage"))
