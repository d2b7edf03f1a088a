"""Catalogs and lookups over parts, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecheck.operators import catalog, verdicts


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a design: its file counts and flags come from its key and size."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    reason = catalog.skip_reason((k % 7 != 0).cast("int") + (k % 11 == 0).cast("int"), (k % 13 == 0).cast("int"), k % 5 != 0, F.col("p_size") > 40)
    name = catalog.slug(F.col("p_name"))
    return p.select(F.concat_ws("/", F.lit("designs"), catalog.slug(F.col("p_brand")), name).alias("key"), name.alias("name"), "p_brand", (k % 3).alias("mutants"), reason.alias("skip_reason"), "p_partkey")


def catalog_skip_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs(spark, sf_dir).select("p_partkey", "skip_reason")


def catalog_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir)
    return catalog.select(d, ["part_1", "part_10", "brand_1/part_17", "designs/brand_2/part_8"]).select("p_partkey", "key")


def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(designs(spark, sf_dir), ["p_brand"])


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", catalog.slug(F.col("url")).alias("slug"))


def coi_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a nation's signals (its customers' segments), those that its suppliers' names mention, by made-up lists."""
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("design"))
    s = _t(spark, sf_dir, "supplier")
    seg = F.element_at(F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE", "OTHER")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    b = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_set(seg).alias("block"))
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"))
    empty = F.array().cast("array<string>")
    j = n.join(c, "nation", "left").join(b, "nation", "left").select("nation", F.coalesce("design", empty).alias("d"), F.coalesce("block", empty).alias("b"))
    overlap, share = verdicts.cone_overlap(F.col("d"), F.col("b"))
    return j.select("nation", F.array_join(overlap, ",").alias("overlap"), F.round(share, 6).alias("coverage"))


def left_default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of each part: the supplier of half its number, where there is one."""
    s = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("operator"))
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return catalog.with_defaults(p, s, ["k"], {"operator": "shipped"})


def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line refers to, when a line refers to its part's number rounded down to a multiple of 3."""
    lines = _t(spark, sf_dir, "lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 3).alias("l_partkey"))
    return catalog.orphans(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", lines, "l_partkey")


def drop_duplicates_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations but for those whose names another block has (one for each region), and for those that refer to a dropped one."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("NATION_"), (F.col("n_nationkey") % 7).cast("string")).alias("ref"))
    kept = _t(spark, sf_dir, "region").select(F.concat(F.lit("nation_"), F.col("r_regionkey").cast("string")).alias("n_name"))
    return catalog.drop_duplicates_against(n, kept, "n_name", "ref").select("n_nationkey")


def undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that have twice a customer's number: a semi join of identifiers."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = _t(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("s_suppkey"))
    return s.join(c, "s_suppkey", "left_semi")


def clock_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region the market segment with most customers, the earliest by name of equals."""
    c = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n")).withColumn("o", F.ascii("c_mktsegment"))
    return catalog.vote(counts, ["n_regionkey"], "c_mktsegment", "n", "o")


def first_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest part of each brand, by price then key."""
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return catalog.first_by(p, ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")])


QUERIES = {
    f.__name__: f
    for f in (catalog_skip_ladder, catalog_select, catalog_totals, slug, coi_overlap, left_default_lookup, anti_orphans, drop_duplicates_by_name, undeclared, clock_vote, first_per_name)
}

_SLUG = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_')"
_D = f"""WITH f AS (SELECT *, (p_partkey % 7 <> 0)::INT + (p_partkey % 11 = 0)::INT AS h, (p_partkey % 13 = 0)::INT AS v FROM part),
d AS (SELECT p_partkey, p_brand, p_partkey % 3 AS mutants, {_SLUG.format(c="p_name")} AS name, 'designs/' || {_SLUG.format(c="p_brand")} || '/' || {_SLUG.format(c="p_name")} AS key,
  CASE WHEN h + v = 0 THEN 'no HDL' WHEN h + v > 1 THEN 'multiple HDL files' WHEN v > 0 THEN 'VHDL' WHEN p_partkey % 5 = 0 THEN 'missing spec' WHEN p_size > 40 THEN 'both clock edges' END AS skip_reason FROM f)"""

ORACLES = {
    "catalog_skip_ladder": f"{_D} SELECT p_partkey, skip_reason FROM d",
    "catalog_select": f"{_D} SELECT p_partkey, key FROM d WHERE skip_reason IS NULL AND (name IN ('part_1', 'part_10') OR key LIKE '%/brand\\_1/part\\_17' ESCAPE '\\' OR key = 'designs/brand_2/part_8')",
    "catalog_totals": f"{_D} SELECT p_brand, count(*) AS designs, count(*) FILTER (skip_reason IS NULL) AS open_ok, count(*) FILTER (mutants > 0) AS with_mutants FROM d GROUP BY p_brand",
    "slug": f"SELECT page_id, {_SLUG.format(c='url')} AS slug FROM pages",
    "coi_overlap": """WITH d AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS s FROM customer),
      b AS (SELECT DISTINCT s_nationkey AS nation, ['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE', 'OTHER'][(s_suppkey % 6 + 1)::INT] AS s FROM supplier)
      SELECT n_nationkey AS nation, coalesce(string_agg(b.s, ',' ORDER BY b.s), '') AS overlap, CASE WHEN count(d.s) = 0 THEN 1.0 ELSE round(count(b.s)::DOUBLE / count(d.s), 6) END AS coverage
      FROM nation LEFT JOIN d ON d.nation = n_nationkey LEFT JOIN b ON b.nation = n_nationkey AND b.s = d.s GROUP BY n_nationkey""",
    "left_default_lookup": "SELECT p_partkey AS k, p_name, coalesce(s_name, 'shipped') AS operator FROM part LEFT JOIN supplier ON s_suppkey * 2 = p_partkey",
    "anti_orphans": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey - l_partkey % 3 FROM lineitem)",
    "drop_duplicates_by_name": "WITH k AS (SELECT 'nation_' || r_regionkey AS n FROM region), g AS (SELECT n_name FROM nation WHERE lower(n_name) IN (SELECT n FROM k)) SELECT n_nationkey FROM nation WHERE lower(n_name) NOT IN (SELECT n FROM k) AND 'NATION_' || (n_nationkey % 7) NOT IN (SELECT n_name FROM g)",
    "undeclared": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT c_custkey * 2 FROM customer)",
    "clock_vote": "SELECT n_regionkey, c_mktsegment FROM (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, ascii(c_mktsegment)) = 1",
    "first_per_name": "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1",
}
