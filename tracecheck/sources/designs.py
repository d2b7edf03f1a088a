"""A tree of designs (category/design/...) as a catalog table.

Files are listed and read by Spark's binary reader. Small sidecar files are parsed with from_json; a malformed one
counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracecheck.operators import catalog, source

# Extensions of sources, and how a log names a mutant's operator.
VERILOG = ("v", "sv")
VHDL = ("vhd", "vhdl")
_OPERATOR = r"applied\.\s+([A-Za-z0-9_()><-]+)"
SUMMARY = "struct<mutants: array<struct<mutant_id: string, log: string>>>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(category, design, rest, name, ext, text) of each file two folders or more below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").replace("file://", "")
    path = F.regexp_replace("path", "^file:/+", "/")
    parts = F.split(F.substring(path, F.lit(len(base) + 2), F.length(path)), "/")
    named = raw.select(parts.alias("p"), F.expr("decode(content, 'UTF-8')").alias("text")).where(F.size("p") >= 3)
    rest = F.slice("p", 3, F.size("p"))
    name = F.element_at("p", -1)
    return named.select(F.col("p")[0].alias("category"), F.col("p")[1].alias("design"), rest.alias("rest"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "text")


def top_of(text: Column, stem: Column) -> Column:
    """The module that a file is about: the one named like it, else its first, else its name."""
    names = source.module_names(F.coalesce(text, F.lit("")))
    return F.when(F.array_contains(names, stem) | (F.size(names) == 0), stem).otherwise(F.try_element_at(names, F.lit(1)))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(key, category, name, top, language, mutants, extras, skip_reason) of each design."""
    f = files(spark, root)
    by = ["category", "design"]
    hdl = F.col("ext").isin(*VERILOG, *VHDL)
    top_level, sub = F.size("rest") == 1, F.col("rest")[0]
    per = f.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(top_level & hdl, F.struct("name", "ext", "text")))).alias("rtl"),
        F.array_sort(F.collect_list(F.when((sub == "include") & hdl & ~top_level, F.struct(F.concat_ws("/", "rest").alias("path"), "text")))).alias("inc"),
        F.max(F.when(top_level & (F.col("name") == "spec.md"), True)).alias("spec"),
    )
    m = mutants(f).groupBy(*by).agg(F.count("*").alias("mutants"))
    joined = catalog.with_defaults(per, m, by, {"mutants": 0})
    one = F.try_element_at("rtl", F.lit(1))
    vhdl = F.size(F.filter("rtl", lambda x: x["ext"].isin(*VHDL)))
    texts = F.array_join(F.concat(F.transform("rtl", lambda x: x["text"]), F.transform("inc", lambda x: x["text"])), "\n")
    open_ = (F.size("rtl") == 1) & (F.size(source.dual_edge_clocks(texts)) > 0)
    reason = catalog.skip_reason(F.size("rtl") - vhdl, vhdl, F.coalesce("spec", F.lit(False)), open_)
    stem = F.regexp_replace(one["name"], r"\.[^.]+$", "")
    return joined.select(
        F.concat_ws("/", F.lit("designs"), catalog.slug(F.col("category")), catalog.slug(F.col("design"))).alias("key"),
        "category",
        F.col("design").alias("name"),
        F.when(F.size("rtl") != 1, F.col("design")).when(one["ext"].isin(*VHDL), stem).otherwise(top_of(one["text"], stem)).alias("top"),
        F.when(F.size("rtl") != 1, "unknown").when(one["ext"].isin(*VHDL), "vhdl").otherwise("verilog").alias("language"),
        "mutants",
        F.transform("inc", lambda x: x["path"]).alias("extras"),
        reason.alias("skip_reason"),
    )


def mutants(f: DataFrame) -> DataFrame:
    """(category, design, mutant_id, operator, description, text) of mutants that come with designs.

    The file named like the design's own is taken, else the first; a mutant without a file is dropped. What the
    sidecar doesn't say gets defaults.
    """
    hdl = F.col("ext").isin(*VERILOG, *VHDL)
    top = f.where((F.size("rest") == 1) & hdl).groupBy("category", "design").agg(F.min("name").alias("top_name"))
    own = f.where((F.size("rest") == 4) & (F.col("rest")[0] == "mutations") & (F.col("rest")[1] == "mutants") & hdl).withColumn("mutant_id", F.col("rest")[2])
    picked = catalog.first_by(own.join(top, ["category", "design"], "left"), ["category", "design", "mutant_id"], [(~F.col("name").eqNullSafe(F.col("top_name"))).cast("int"), F.col("name")])
    side = f.where((F.size("rest") == 2) & (F.col("rest")[0] == "mutations") & (F.col("name") == "mutation_summary.json"))
    listed = side.select("category", "design", F.explode(F.from_json("text", SUMMARY)["mutants"]).alias("m")).select("category", "design", F.btrim("m.mutant_id").alias("mutant_id"), F.btrim(F.coalesce("m.log", F.lit(""))).alias("log"))
    said = listed.where("mutant_id <> ''").groupBy("category", "design", "mutant_id").agg(F.max("log").alias("log"))
    both = picked.join(said, ["category", "design", "mutant_id"], "left")
    operator = F.regexp_extract(F.coalesce("log", F.lit("")), _OPERATOR, 1)
    return both.select(
        "category",
        "design",
        "mutant_id",
        F.when(operator == "", "shipped").otherwise(operator).alias("operator"),
        F.when(F.coalesce("log", F.lit("")) == "", F.concat(F.lit("shipped mutant "), "mutant_id")).otherwise(F.col("log")).alias("description"),
        "text",
    )


def load_mutants(found: DataFrame, most: int = 20) -> DataFrame:
    """At most `most` mutants of each design, by id."""
    place = F.row_number().over(Window.partitionBy("category", "design").orderBy("mutant_id"))
    return found.withColumn("__place", place).where(F.col("__place") <= max(0, most)).drop("__place")


def golden_blocks(f: DataFrame) -> DataFrame:
    """(category, design) of folders that hold a file named like them."""
    return f.where((F.size("rest") == 1) & (F.col("name") == F.concat("design", F.lit(".sv")))).select("category", "design").distinct()


def index(designs: DataFrame) -> DataFrame:
    """A JSON line for the totals, and one for each design: (ord, line)."""
    totals = catalog.totals(designs).select(F.lit(0).alias("ord"), F.to_json(F.struct("designs", "open_ok", "with_mutants")).alias("line"))
    each = designs.select(F.lit(1).alias("ord"), F.to_json(F.struct(*designs.columns), {"ignoreNullFields": "false"}).alias("line"))
    return totals.unionAll(each)
