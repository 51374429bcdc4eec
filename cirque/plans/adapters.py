"""The given tables seen as replicons, features, sites, hits, catalog, taxonomy and manifest; the SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "orders", "lineitem", "events", "documents")

VIEWS = {
    "ad_base": """
SELECT l_suppkey AS supp, CAST(l_quantity AS BIGINT)*20+31 AS flen, (l_partkey*7+l_linenumber*13)%140-20 AS gap,
 l_returnflag AS rf, l_linestatus AS ls, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) AS BIGINT) AS rn FROM lineitem
""",
    "ad_tiles": """
SELECT supp, rn, flen, rf, ls, CASE WHEN CAST(floor(rn/6.0) AS BIGINT)%3=0 THEN 'Reverse' ELSE 'Forward' END AS strand,
 CAST(sum(flen+gap) OVER (PARTITION BY supp ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-(flen+gap) AS BIGINT) AS start_bound FROM ad_base
""",
    "ad_replicons": """
SELECT 'g'||CAST(s.s_nationkey AS VARCHAR(9)) AS assembly, 's'||CAST(t.supp AS VARCHAR(9)) AS replicon, CAST(max(t.start_bound+t.flen)+50 AS BIGINT) AS len
 FROM ad_tiles t JOIN supplier s ON s.s_suppkey=t.supp GROUP BY s.s_nationkey, t.supp
""",
    "ad_features": """
SELECT r.assembly, r.replicon, r.len, x.strand, x.start_bound, x.end_bound, x.feature_type, x.ord FROM (
 SELECT supp, strand, start_bound, start_bound+flen AS end_bound, CASE WHEN rf='R' AND ls='O' THEN 'Pseudogene' WHEN rf='R' THEN 'tRNA' ELSE 'CDS' END AS feature_type, rn*2+1 AS ord FROM ad_tiles
 UNION ALL SELECT supp, strand, start_bound, start_bound+flen, 'Gene', rn*2 FROM ad_tiles) x JOIN ad_replicons r ON r.replicon='s'||CAST(x.supp AS VARCHAR(9))
 UNION ALL SELECT assembly, replicon, len, 'Forward', CAST(0 AS BIGINT), len, 'Region', CAST(0 AS BIGINT) FROM ad_replicons
""",
    "ad_sites": """
SELECT e.event_id AS site_id, r.assembly, r.replicon, r.len, CASE WHEN e.event_id%2=0 THEN 'Forward' ELSE 'Reverse' END AS strand,
 (e.event_id*7919)%r.len AS start_bound, (e.event_id*7919)%r.len+16 AS end_bound FROM events e CROSS JOIN (SELECT count(*) AS k FROM supplier) c
 JOIN ad_replicons r ON r.replicon='s'||CAST(e.user_id%c.k AS VARCHAR(9))
""",
    "ad_hits": """
SELECT event_id AS hit_id, replicon, CASE WHEN fwd THEN lo ELSE hi END AS sstart, CASE WHEN fwd THEN hi ELSE lo END AS send, mlen AS match_length,
 CASE WHEN fwd THEN f ELSE -f END AS sframe, pident, evalue, qseqid, assoc_type FROM (
 SELECT e.event_id, r.replicon, e.event_id%2=0 AS fwd, e.event_id%3+1 AS f, 100+e.event_id%300 AS mlen, (e.event_id*104729)%r.len+1 AS lo,
 (e.event_id*104729)%r.len+3*(100+e.event_id%300) AS hi, CAST(20+e.event_id%80 AS DOUBLE) AS pident, e.value*1e-13 AS evalue, 'q'||CAST(e.user_id%7 AS VARCHAR(9)) AS qseqid,
 CASE e.event_type WHEN 'click' THEN 'CopA' WHEN 'purchase' THEN 'CupA' WHEN 'view' THEN 'CopY' ELSE 'CopZ' END AS assoc_type
 FROM events e CROSS JOIN (SELECT count(*) AS k FROM supplier) c JOIN ad_replicons r ON r.replicon='s'||CAST((e.user_id*3+1)%c.k AS VARCHAR(9))) h
""",
    "ad_catalog": """
SELECT CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'C'||CAST(o_custkey AS VARCHAR(9)) AS dir_name,
 CASE o_orderstatus WHEN 'F' THEN 'Complete Genome' WHEN 'O' THEN 'Chromosome' ELSE 'Scaffold' END AS assembly_level,
 CASE WHEN o_orderkey%50=0 THEN 'na' ELSE 'https://x/'||CAST(o_orderkey AS VARCHAR(9)) END AS ftp_location, o_orderkey%7<>0 AS present, substr(o_orderpriority,1,1) IN ('1','2') AS annotated, o_orderkey AS ord FROM orders
""",
    "ad_tax_nodes": """
SELECT CAST(1 AS BIGINT) AS tax_id, CAST(1 AS BIGINT) AS parent_id, 'root' AS name UNION ALL SELECT 2,1,'cellular organisms'
 UNION ALL SELECT 10+CAST(r_regionkey AS BIGINT),2,r_name FROM region UNION ALL SELECT 100+CAST(n_nationkey AS BIGINT),10+CAST(n_regionkey AS BIGINT),n_name FROM nation
 UNION ALL SELECT 1000+s_suppkey,100+CAST(s_nationkey AS BIGINT),s_name FROM supplier
""",
    "ad_assemblies": """
SELECT 'g'||CAST(n_nationkey AS VARCHAR(9)) AS subdir_name, 'GCA_'||CAST(n_nationkey AS VARCHAR(9)) AS assembly_accession, CAST(10+n_regionkey AS VARCHAR(9)) AS species_tax_id, CAST(100+n_nationkey AS VARCHAR(9)) AS tax_id,
 n_name AS organism_name, 'strain='||CAST(n_regionkey AS VARCHAR(9)) AS infraspecific_name FROM nation
""",
    "ad_files": """
SELECT assembly, file_name, length FROM (
 SELECT CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'D'||CAST(o_orderkey AS VARCHAR(9)) AS assembly, CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'D'||CAST(o_orderkey AS VARCHAR(9))||'_genomic.fna.gz' AS file_name, CAST(o_totalprice AS BIGINT) AS length FROM orders WHERE o_orderkey%3<>0
 UNION ALL SELECT CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'D'||CAST(o_orderkey AS VARCHAR(9)), CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'D'||CAST(o_orderkey AS VARCHAR(9))||'_genomic.gff.gz', CAST(o_custkey AS BIGINT) FROM orders WHERE substr(o_orderpriority,1,1) IN ('1','2')
 UNION ALL SELECT CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'D'||CAST(o_orderkey AS VARCHAR(9)), CASE WHEN o_orderkey%2=0 THEN 'GCF_' ELSE 'GCA_' END||'D'||CAST(o_orderkey AS VARCHAR(9))||'_feature_table.txt.gz', CAST(1 AS BIGINT) FROM orders WHERE o_orderkey%5=0) f
""",
    "ad_tax_species": """
SELECT CAST(1000+s_suppkey AS BIGINT) AS tax_id, CAST(100+s_nationkey AS BIGINT) AS species_id FROM supplier
""",
    "ad_manifest": """
SELECT 'a'||CAST(doc_id%40 AS VARCHAR(9)) AS assembly, 'doc_'||CAST(doc_id AS VARCHAR(9)) AS file_name, CASE WHEN doc_id%113=0 THEN md5(text||'x') ELSE md5(text) END AS expected_md5 FROM documents
""",
}

NEEDS = {
    "ad_base": (), "ad_tiles": ("ad_base",), "ad_replicons": ("ad_tiles",), "ad_features": ("ad_tiles", "ad_replicons"), "ad_sites": ("ad_replicons",),
    "ad_hits": ("ad_replicons",), "ad_catalog": (), "ad_tax_nodes": (), "ad_manifest": (), "ad_sequences": (),
    "ad_assemblies": (), "ad_files": (), "ad_tax_species": (),
}

#: What Spark plans better another way, with the same rows. All of lineitem is ordered once: number, start and the replicon's length come from
#: windows over one order, and features and replicons are read from these tiles.
SPARK_VIEWS = {
    "ad_placed": """
SELECT 'g'||CAST(s.s_nationkey AS VARCHAR(9)) AS assembly, 's'||CAST(t.supp AS VARCHAR(9)) AS replicon, t.len, t.rn, t.start_bound, t.start_bound+t.flen AS end_bound, t.rf, t.ls,
 CASE WHEN CAST(floor(t.rn/6.0) AS BIGINT)%3=0 THEN 'Reverse' ELSE 'Forward' END AS strand FROM (
 SELECT *, CAST(max(start_bound+flen) OVER (PARTITION BY supp)+50 AS BIGINT) AS len FROM (
 SELECT supp, flen, rf, ls, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(sum(flen+gap) OVER w-(flen+gap) AS BIGINT) AS start_bound FROM (
 SELECT *, l_suppkey AS supp, CAST(l_quantity AS BIGINT)*20+31 AS flen, (l_partkey*7+l_linenumber*13)%140-20 AS gap, l_returnflag AS rf, l_linestatus AS ls FROM lineitem)
 WINDOW w AS (PARTITION BY supp ORDER BY l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) t
 JOIN (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) s ON s.s_suppkey=t.supp
""",
    "ad_replicons": "SELECT assembly, replicon, len FROM ad_placed WHERE rn=1",
    "ad_features": """
SELECT assembly, replicon, len, strand, start_bound, end_bound, CASE WHEN rf='R' AND ls='O' THEN 'Pseudogene' WHEN rf='R' THEN 'tRNA' ELSE 'CDS' END AS feature_type, rn*2+1 AS ord FROM ad_placed
 UNION ALL SELECT assembly, replicon, len, strand, start_bound, end_bound, 'Gene', rn*2 FROM ad_placed
 UNION ALL SELECT assembly, replicon, len, 'Forward', CAST(0 AS BIGINT), len, 'Region', CAST(0 AS BIGINT) FROM ad_replicons
""",
}
SPARK_NEEDS = {"ad_placed": (), "ad_replicons": ("ad_placed",), "ad_features": ("ad_placed", "ad_replicons")}

LETTERS = "translate({}, 'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC')"
SEQUENCES = {
    "spark": "SELECT doc_id, " + LETTERS.format("regexp_replace(lower(text),'[^a-z]','')") + " AS seq FROM documents",
    "duckdb": "SELECT doc_id, " + LETTERS.format("regexp_replace(lower(text),'[^a-z]','','g')") + " AS seq FROM documents",
}

#: Events look for their replicon by a key that the count of suppliers is in. Spark may put the cross join with that count after the join
#: with replicons, which is then one of every event with every replicon; in its dialect the key is a column before replicons are joined.
KEYED = re.compile(r"FROM (events e CROSS JOIN .*? c)\s+JOIN ad_replicons r ON r\.replicon=('s'\|\|CAST\(.*?%c\.k AS VARCHAR\(9\)\))")


def keyed(sql: str) -> str:
    return KEYED.sub(r"FROM (SELECT e.*, \2 AS home FROM \1) e JOIN ad_replicons r ON r.replicon=e.home", sql)


def defined(name: str, dialect: str) -> str:
    """The SQL of a view."""
    if dialect == "spark":
        return SPARK_VIEWS.get(name) or (SEQUENCES["spark"] if name == "ad_sequences" else keyed(VIEWS[name]))
    return SEQUENCES[dialect] if name == "ad_sequences" else VIEWS[name]


def needed(*names: str, dialect: str = "duckdb", known: tuple[str, ...] = ()) -> list[str]:
    """The views that ``names`` rest on and themselves, each after what it needs; those ``known`` need nothing."""
    needs = NEEDS | SPARK_NEEDS if dialect == "spark" else NEEDS
    out: list[str] = []
    for name in names:
        out += [x for x in [*(() if name in known else needed(*needs[name], dialect=dialect, known=known)), name] if x not in out]
    return out


def with_views(*names: str, dialect: str = "duckdb", known: tuple[str, ...] = ()) -> str:
    """A WITH clause that defines ``names``; a view in ``known`` is read from the table known_<name>."""
    return "WITH " + ",\n".join(f"{n} AS ({f'SELECT * FROM known_{n}' if n in known else defined(n, dialect).strip()})" for n in needed(*names, dialect=dialect, known=known))


def view(spark: SparkSession, sf_dir: str, name: str, replicons: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """A view over the tables; ``replicons`` is ad_replicons and ``placed`` is ad_placed where a query has them, so that not each of its views orders all of lineitem for it."""
    known = {n: df for n, df in (("ad_replicons", replicons), ("ad_placed", placed)) if df is not None}
    for n, df in known.items():
        df.createOrReplaceTempView(f"known_{n}")
    query = with_views(name, dialect="spark", known=tuple(known))
    for t in TABLES:
        if t in query:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{query} SELECT * FROM {name}")
