"""Size spectra of text tables: how many texts of what size each group holds, with ranks, medians and slopes.

    python -m jobs.text_spectra --tables DIR --out DIR [--config FILE]

The analysis of a structure catalog, with texts as structures: sizes are code points and words, groups are given by a
column or an SQL expression of each catalog. What is written, partitioned by ``catalog`` and ``measure``:

* ``OUT/spectra``: per group and power-of-two bin, the count ``n``, ``spectrum`` (mid * n / ln 2), ``n_ge`` (texts of at
  least the bin's lower edge), ``product`` (edge * n_ge) and ``cdf`` (n_ge as a share of all texts that have a size);
* ``OUT/groups``: per group, ``texts``, ``empty`` ones, the sum, the exact median and the greatest of the sizes, and the
  least-squares ``slope`` of log n by log size over the bins from ``fit_from`` on (null under ``fit_least`` bins).

Every run replaces both outputs by what the tables hold now, so a repeated run gives the same, and one that failed is
mended by the next. Texts are measured once, where they are read; no text is shuffled.

Cases: a null or blank text has size 0, is counted in ``empty`` and has no bin; a null group is ``(none)``; an empty table
adds no rows; repeated rows count again; other columns are not read.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobs.common import command_line_session, fresh_folder, settings
from voxelweave.operators import spectra as S
from voxelweave.scratch import Scratch

log = logging.getLogger("jobs.text_spectra")
KEY = ["catalog", "measure", "grp"]
CATALOGS = (
    {"name": "documents", "table": "documents", "text": "text", "group": "source"},
    {"name": "languages", "table": "documents", "text": "text", "group": "lang"},
    {"name": "pages", "table": "pages", "text": "html", "group": "regexp_extract(url, '://([^/:?#]+)', 1)"},
    {"name": "conversations", "table": "conversations", "text": "text", "group": "role"},
)


@dataclass(frozen=True)
class Settings:
    """``top_bit``: sizes are binned below 2**top_bit. ``fit_from``, ``fit_least``: least size and number of bins of a fit."""

    catalogs: tuple[dict, ...] | list[dict] = field(default=CATALOGS)
    top_bit: int = 40
    fit_from: int = 64
    fit_least: int = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks (space, tab to carriage return) of a text, without cutting the words out: every
    run of blanks becomes one mark, spelt with two blanks that the text no longer has, and the marks are counted."""
    blank = reduce(lambda c, sep: F.replace(c, F.lit(sep), F.lit(" ")), "\t\n\x0b\x0c\r", F.concat(F.lit(" "), text, F.lit(" ")))
    marked = F.replace(F.replace(blank, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"))
    return F.length(marked) - F.length(F.replace(marked, F.lit("\t"))) - 1


def measured(spark: SparkSession, tables: str, s: Settings, scratch: Scratch) -> DataFrame:
    """``catalog, grp, measure, size``: two rows a text and catalog. Catalogs of one table are measured in one scan.

    What is written is one row a text; the rows of its catalogs and measures come after, so that a text is measured once.
    """
    by_table: dict[tuple[str, str], list[dict]] = {}
    for c in s.catalogs:
        by_table.setdefault((c["table"], c["text"]), []).append(c)
    out = []
    for (table, text), catalogs in by_table.items():
        named = [F.struct(F.lit(c["name"]).alias("catalog"), F.coalesce(F.expr(c["group"]).cast("string"), F.lit("(none)")).alias("grp")) for c in catalogs]
        body = F.coalesce(F.col(text), F.lit(""))
        out.append(spark.read.parquet(f"{tables}/{table}.parquet").select(F.array(*named).alias("c"), word_count(body).alias("words"), F.length(body).alias("chars")))
    rows = scratch.keep(reduce(DataFrame.unionByName, out), "texts")
    pair = F.array(*(F.struct(F.lit(n).alias("measure"), F.when(F.col("words") == 0, 0).otherwise(F.col(n)).cast("bigint").alias("size")) for n in ("words", "chars")))
    return rows.select(F.explode("c").alias("c"), pair.alias("m")).select("c.*", F.explode("m").alias("m")).select("catalog", "grp", "m.*")


def spectra_of(sizes: DataFrame, s: Settings) -> DataFrame:
    """The first output of ``sizes`` (``catalog, grp, measure, size``)."""
    edges = [float(1 << b) for b in range(s.top_bit + 1)]
    bins = S.size_spectrum(sizes.where("size > 0"), "size", edges, by=tuple(KEY))
    above = W.partitionBy(*KEY).orderBy(F.desc("bin"))  # a group has some 40 bins at most
    n_ge = F.sum("n").over(above)
    return bins.select(*KEY, "bin", "lo", "hi", "mid", "n", "spectrum", n_ge.alias("n_ge"), (F.col("lo") * n_ge).alias("product"), (n_ge / F.sum("n").over(W.partitionBy(*KEY))).alias("cdf"))


def groups_of(sizes: DataFrame, spectra: DataFrame, s: Settings) -> DataFrame:
    """The second output."""
    total = sizes.groupBy(*KEY).agg(F.count("*").alias("texts"), F.count_if(F.col("size") == 0).alias("empty"), F.sum("size").alias("total"), F.max("size").alias("largest"))
    median = S.exact_median(sizes.where("size > 0"), KEY, "size").drop("n")
    fit = S.powerlaw_fit(spectra.where(F.col("lo") >= s.fit_from), "mid", "n", by=tuple(KEY)).where(F.col("n") >= s.fit_least).select(*KEY, "slope")
    return total.join(median, KEY, "left").join(fit, KEY, "left")


def run(spark: SparkSession, tables: str, out: str, s: Settings | None = None) -> None:
    """Measure the tables under ``tables`` and replace both outputs under ``out``."""
    s = s or Settings()
    scratch = Scratch(spark, "text_spectra")
    sizes = measured(spark, tables, s, scratch)
    read = {r["catalog"]: r["n"] for r in sizes.where("measure = 'chars'").groupBy("catalog").agg(F.count("*").alias("n")).collect()}
    for c in s.catalogs:
        log.info("catalog %s: read %d texts of %s/%s", c["name"], read.get(c["name"], 0), tables, c["table"])
    spectra_of(sizes, s).repartitionByRange("catalog", "measure", "grp", "bin").write.mode("overwrite").partitionBy("catalog", "measure").parquet(f"{out}/spectra")
    wrote = read_output(spark, out, "spectra", SPECTRA)
    groups_of(sizes, wrote, s).repartitionByRange("catalog", "measure", "grp").write.mode("overwrite").partitionBy("catalog", "measure").parquet(f"{out}/groups")
    log.info("wrote %d rows to %s/spectra and %d to %s/groups", wrote.count(), out, read_output(spark, out, "groups", GROUPS).count(), out)
    scratch.drop()


SPECTRA = "grp string, bin int, lo double, hi double, mid double, n bigint, spectrum double, n_ge bigint, product double, cdf double, catalog string, measure string"
GROUPS = "grp string, texts bigint, empty bigint, total bigint, largest bigint, median double, slope double, catalog string, measure string"


def read_output(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/{name}")


def job2_text_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: two runs over the whole tables into one new folder, and both outputs after the second."""
    where = fresh_folder(spark, "text_spectra")
    for _ in range(2):
        run(spark, sf_dir, where)
    both = read_output(spark, where, "groups", GROUPS).join(read_output(spark, where, "spectra", SPECTRA), KEY, "left")
    return both.select(*KEY, "texts", "empty", "total", "largest", "median", F.round("slope", 6).alias("slope"), "bin", "lo", "hi", "n", F.round("spectrum", 4).alias("spectrum"), "n_ge", "product", F.round("cdf", 8).alias("cdf"))


_ROWS = " UNION ALL ".join(f"SELECT '{c['name']}' AS catalog, coalesce({c['group']}, '(none)') AS grp, coalesce({c['text']}, '') AS t FROM {c['table']}" for c in CATALOGS)
SQL = rf"""
    WITH t AS ({_ROWS}),
         w AS (SELECT catalog, grp, length(t) AS chars, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM t),
         m AS (SELECT catalog, grp, 'chars' AS measure, CAST(CASE WHEN words = 0 THEN 0 ELSE chars END AS BIGINT) AS size FROM w UNION ALL SELECT catalog, grp, 'words', CAST(words AS BIGINT) FROM w),
         e AS (SELECT CAST(b AS INTEGER) AS bin, CAST(1::BIGINT << b AS DOUBLE) AS lo, CAST(2::BIGINT << b AS DOUBLE) AS hi FROM range(40) x(b)),
         h AS (SELECT catalog, measure, grp, bin, lo, hi, sqrt(lo * hi) AS mid, count(*) AS n FROM m JOIN e ON size >= lo AND size < hi GROUP BY ALL),
         s AS (SELECT *, mid * n / ln(2) AS spectrum, CAST(sum(n) OVER (PARTITION BY catalog, measure, grp ORDER BY bin DESC) AS BIGINT) AS n_ge, sum(n) OVER (PARTITION BY catalog, measure, grp) AS all_n FROM h),
         g AS (SELECT catalog, measure, grp, count(*) AS texts, count(*) FILTER (size = 0) AS empty, CAST(sum(size) AS BIGINT) AS total, max(size) AS largest, median(size) FILTER (size > 0) AS median FROM m GROUP BY ALL),
         f AS (SELECT catalog, measure, grp, regr_slope(log10(n), log10(mid)) AS slope FROM h WHERE lo >= 64 GROUP BY ALL HAVING count(*) >= 3)
    SELECT g.catalog, g.measure, g.grp, texts, empty, total, largest, median, round(slope, 6) AS slope, bin, lo, hi, n, round(spectrum, 4) AS spectrum, n_ge, lo * n_ge AS product, round(n_ge / all_n, 8) AS cdf
    FROM g LEFT JOIN f USING (catalog, measure, grp) LEFT JOIN s USING (catalog, measure, grp)"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--tables", required=True, help="folder with the text tables (NAME.parquet)")
    p.add_argument("--out", required=True)
    p.add_argument("--config", help="settings (JSON)")
    a = p.parse_args()
    spark = command_line_session("text_spectra")
    try:
        run(spark, a.tables, a.out, settings(spark, Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
