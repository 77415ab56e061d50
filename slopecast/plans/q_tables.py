"""Aggregation, profiling, catalogue, gazetteer and housekeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import places as P
from ..operators import profile as Q
from ..operators import scenes as Sc
from ..operators import tables as Tb
from ..operators.ranking import percentiles
from . import q_hazard  # noqa: F401  (registers shared SQL)
from .fixtures import Tables
from .q_rain import r6, txt
from .registry import query
from .twins import register_cte, twin

# --- aggregations -------------------------------------------------------------------


@query("value_counts", "I1 J7", "SELECT coalesce(CAST(nullif(l_linenumber, 3) AS VARCHAR), 'unknown') AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def value_counts(spark, sf):
    li = Tables(spark, sf).raw("lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(3)).alias("v"))
    return A.value_counts(li, "v", 5)


@query("fixed_histogram", "I2", """SELECT CAST(b AS INT) AS bin, count(v) AS n FROM (SELECT unnest(range(28)) AS b) LEFT JOIN (SELECT l_quantity AS v, least(floor((l_quantity - 10.0e0) / ((40.0e0 - 10.0e0) / 28)), 27) AS k FROM lineitem WHERE l_quantity BETWEEN 10 AND 40) ON k = b GROUP BY 1""")
def fixed_histogram(spark, sf):
    return A.histogram(Tables(spark, sf).raw("lineitem"), F.col("l_quantity"), 10.0, 40.0, 28)


@query("clipped_histogram", "I2 Q1", """WITH e AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
 SELECT CAST(least(floor((least(greatest(l_extendedprice, lo), hi) - lo) / ((hi - lo) / 28)), 27) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def clipped_histogram(spark, sf):
    return A.clipped_histogram(Tables(spark, sf).raw("lineitem"), "l_extendedprice", 28).select("bin", "n")


@query("exact_percentiles", "I3", "SELECT n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{i}" for i, p in enumerate([0, .01, .25, .5, .75, .9, .99, .995, .999, 1])) + " FROM lineitem, (SELECT count(*) AS n FROM lineitem) GROUP BY n")
def exact_percentiles(spark, sf):
    p = percentiles(Tables(spark, sf).raw("lineitem"), "l_extendedprice", [0, .01, .25, .5, .75, .9, .99, .995, .999, 1])
    return p.select("n", *[r6(f"p{i}") for i in range(10)])


@query("describe_layer", "I4", "SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem")
def describe_layer(spark, sf):
    d = A.describe(Tables(spark, sf).raw("lineitem"), "l_extendedprice")
    return d.select("min", "max", r6("mean"), r6("std"), "n", r6("median"))


@query("share_over", "I5", twin("SELECT round(avg((slope > 15)::INT), 6) AS over_15, round(avg((slope > 25)::INT), 6) AS over_25, round(avg((slope > 35)::INT), 6) AS over_35 FROM cells", "cells"))
def share_over(spark, sf):
    s = A.share_over(Tables(spark, sf).cells(), "slope", [15, 25, 35])
    return s.select(r6("over_15"), r6("over_25"), r6("over_35"))


@query("class_share", "I6", twin("SELECT CASE WHEN n / t >= 0.04e0 THEN lc END AS lc, CAST(sum(n) AS BIGINT) AS count, round(sum(n) / any_value(t), 6) AS share FROM (SELECT lc, count(*) AS n, sum(count(*)) OVER () AS t FROM cells GROUP BY 1) GROUP BY 1", "cells"))
def class_share(spark, sf):
    return A.class_share(Tables(spark, sf).cells(), "lc", 0.04).select("lc", "count", r6("share"))


@query("threshold_table", "I7", "SELECT t AS threshold, count(*) FILTER (WHERE l_quantity > t) AS n, round(count(*) FILTER (WHERE l_quantity > t) / CAST(count(*) AS DOUBLE), 6) AS share, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity > t), 0), 2) AS length FROM lineitem, (SELECT unnest([10.0e0, 25.0e0, 40.0e0, 60.0e0]) AS t) GROUP BY 1")
def threshold_table(spark, sf):
    t = A.threshold_table(Tables(spark, sf).raw("lineitem"), "l_quantity", "l_extendedprice", [10, 25, 40, 60])
    return t.select("threshold", "n", r6("share"), r6("length", n=2))


@query("missing_report", "I8", twin("""SELECT 'elev' AS "column", round(avg((elev IS NULL)::INT), 6) AS missing, 0 AS flagged FROM c UNION ALL SELECT 'slope', round(avg((slope IS NULL)::INT), 6), 1 FROM c UNION ALL SELECT 'lc', round(avg((lc = 0)::INT), 6), 1 FROM c""", "cells",
 extra={"c": "SELECT elev, CASE WHEN slope > 20 THEN slope END AS slope, CASE WHEN lc = 30 THEN 0 ELSE lc END AS lc FROM cells"}))
def missing_report(spark, sf):
    c = Tables(spark, sf).cells().select("elev", F.when(F.col("slope") > 20, F.col("slope")).alias("slope"), F.when(F.col("lc") == 30, 0).otherwise(F.col("lc")).alias("lc"))
    return A.missing_report(c, ["elev", "slope"], ["lc"]).select("column", r6("missing"), "flagged")


@query("layer_coverage", "I9", twin("SELECT 'slope' AS layer, round(avg((slope > 20)::INT), 6) AS coverage FROM cells UNION ALL SELECT 'elev', 1.0e0", "cells"))
def layer_coverage(spark, sf):
    c = Tables(spark, sf).cells().withColumn("slope", F.when(F.col("slope") > 20, F.col("slope")))
    return A.coverage(c, ["slope", "elev"]).select("layer", r6("coverage"))


@query("basin_means", "I10", twin("SELECT b.basin, round(avg(elev), 6) AS mean_elev, round(avg(row), 6) AS mid_row, round(avg(col), 6) AS mid_col FROM basins b LEFT JOIN (SELECT *, (partkey * 2) % (SELECT count(*) FROM customer) AS basin FROM cells) c USING (basin) GROUP BY 1", "basins", "cells"))
def basin_means(spark, sf):
    t = Tables(spark, sf)
    n = t.raw("customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    c = t.cells().withColumn("_n", n).withColumn("basin", F.pmod(F.col("partkey") * 2, F.col("_n")))
    z = A.zonal_mean(t.basins().select("basin"), c, "basin", {"mean_elev": F.avg("elev"), "mid_row": F.avg("row"), "mid_col": F.avg("col")})
    return z.select("basin", r6("mean_elev"), r6("mid_row"), r6("mid_col"))


@query("basin_has_floodplain", "I11", twin("SELECT basin, bool_or(idx > 0)::INT AS has_floodplain FROM fcells GROUP BY 1", "fcells"))
def basin_has_floodplain(spark, sf):
    from .q_hazard import Outlook
    return Outlook(spark, sf).fcells().groupBy("basin").agg(F.bool_or(F.col("idx") > 0).cast("int").alias("has_floodplain"))


@query("weighted_share", "I12", twin("SELECT cls, sum(km) AS total, round(sum(km) / sum(sum(km)) OVER (), 6) AS share FROM pieces WHERE cls > 0 GROUP BY 1", "pieces"))
def weighted_share(spark, sf):
    return A.weighted_share(Tables(spark, sf).pieces(), "cls", "km").select("cls", "total", r6("share"))


@query("distinct_days", "I13", twin("SELECT site, count(DISTINCT day) AS n_days FROM scenes GROUP BY 1", "scenes"))
def distinct_days(spark, sf):
    return A.distinct_days(Tables(spark, sf).scenes(), "site", "day")


@query("by_decade", "I14", twin("SELECT CAST(floor(year(day) / 10) * 10 AS INT) AS decade, count(*) AS n FROM ev GROUP BY 1", "ev"))
def by_decade(spark, sf):
    return A.by_decade(Tables(spark, sf).events(), "day")


@query("area_by_unit", "I15", "SELECT p_type AS lith, CAST(sum(p_size) AS BIGINT) AS area, count(*) AS n FROM part GROUP BY 1")
def area_by_unit(spark, sf):
    p = Tables(spark, sf).raw("part")
    return p.groupBy(F.col("p_type").alias("lith")).agg(F.sum("p_size").alias("area"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("area"), "lith")


@query("population_stats", "I16", twin("SELECT round(sum(v), 4) AS total, round(avg((v > 0)::INT), 6) AS populated, round(avg(v) FILTER (WHERE v > 0), 6) AS mean_populated, round(max(v), 6) AS max FROM (SELECT greatest(elev - 1400, 0.0e0) AS v FROM cells SEMI JOIN inpoly USING (cell_id))", "cells", "inpoly"))
def population_stats(spark, sf):
    from ..operators.spatial import fill_polygons
    t = Tables(spark, sf)
    inside = t.cells().join(fill_polygons(t.verts()).select("row", "col").distinct(), ["row", "col"], "left_semi")
    v = inside.select(F.greatest(F.col("elev") - 1400, F.lit(0.0)).alias("v"))
    return v.agg(r6(F.sum("v"), "total", 4), r6(F.avg((F.col("v") > 0).cast("double")), "populated"), r6(F.avg(F.when(F.col("v") > 0, F.col("v"))), "mean_populated"), r6(F.max("v"), "max"))


@query("density_ratios", "I17", twin("SELECT lith, round(CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / (count(*) * 0.01e0), 6) AS per_km2 FROM labelled GROUP BY 1", "labelled"))
def density_ratios(spark, sf):
    c = Tables(spark, sf).labelled()
    return c.groupBy("lith").agg(r6(F.sum("label") / (F.count(F.lit(1)) * 0.01), "per_km2"))


@query("catalogue_rollup", "I18 I24", "SELECT coalesce(p_type, 'TOTAL') AS p_type, count(DISTINCT p_brand) AS sources, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY ROLLUP (p_type)")
def catalogue_rollup(spark, sf):
    p = Tables(spark, sf).raw("part")
    return A.rollup_counts(p, "p_type", {"sources": F.countDistinct("p_brand"), "files": F.count(F.lit(1)), "bytes": F.sum("p_size")})


@query("season_contrast", "I19", twin("""SELECT accuracy, season, count(*) AS n, round(quantile_cont(amount, 0.5), 6) AS median, round(avg((amount < 100000)::INT), 6) AS share_below FROM (SELECT *, CASE WHEN month(day) BETWEEN 5 AND 9 THEN 'monsoon' WHEN month(day) >= 11 OR month(day) <= 3 THEN 'dry' END AS season FROM ev) WHERE season IS NOT NULL GROUP BY 1, 2""", "ev"))
def season_contrast(spark, sf):
    s = A.season_contrast(Tables(spark, sf).events(), ["accuracy"], "amount", 100000)
    return s.select("accuracy", "season", "n", r6("median"), r6("share_below"))


@query("elevation_band_bias", "I25", twin("""SELECT band, round(n / sum(n) OVER (), 6) AS domain_share, round(p / sum(p) OVER (), 6) AS predicted_share, round(a / sum(a) OVER (), 6) AS actual_share FROM
 (SELECT floor(elev / 200.0e0) * 200.0e0 AS band, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE cls >= 4) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS a FROM cells JOIN classed USING (cell_id) GROUP BY 1)""", "cells", "classed"))
def elevation_band_bias(spark, sf):
    from .q_evaluate import susceptible
    b = A.band_table(susceptible(Tables(spark, sf)), "elev", 200.0, F.col("cls") >= 4, F.col("label") == 1)
    return b.select(F.col("band").cast("double"), r6("domain_share"), r6("predicted_share"), r6("actual_share"))


@query("populated_attributes", "I26", "SELECT 'source' AS attribute, count(source) AS n FROM documents UNION ALL SELECT 'lang', count(nullif(lang, 'en')) FROM documents")
def populated_attributes(spark, sf):
    d = Tables(spark, sf).raw("documents").select("source", F.nullif(F.col("lang"), F.lit("en")).alias("lang"))
    return A.populated(d, ["source", "lang"])


# --- joins, sets, scalars -----------------------------------------------------------


@query("one_to_one_join", "H1", "SELECT s_suppkey, s_name, s_acctbal AS balance FROM supplier")
def one_to_one_join(spark, sf):
    s = Tables(spark, sf).raw("supplier")
    return Tb.join_one_to_one(s.select("s_suppkey", "s_name"), s.select("s_suppkey", F.col("s_acctbal").alias("balance")), "s_suppkey")


@query("coalesced_columns", "H10 K3 K12", """SELECT 'a' AS src, p_type AS district, p_retailprice AS area, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1, 2, 3 UNION ALL SELECT 'b', p_brand, p_size * 1.0e0, count(*) FROM part WHERE p_size <= 25 GROUP BY 1, 2, 3""")
def coalesced_columns(spark, sf):
    p = Tables(spark, sf).raw("part")
    a = p.where("p_size > 25").select(F.lit("a").alias("src"), F.col("p_type").alias("DISTRICT"), F.col("p_retailprice").cast("string").alias("Area_sq_m"))
    b = p.where("p_size <= 25").select(F.lit("b").alias("src"), F.col("p_brand").alias("District_"), F.col("p_size").cast("string").alias("Area_sqm"))
    u = Tb.coalesce_columns(Tb.union_sources(a, b), {"district": ["DISTRICT", "District_"], "area_txt": ["Area_sq_m", "Area_sqm"]})
    return u.withColumn("area", X.to_positive_number(F.col("area_txt"))).groupBy("src", "district", "area").agg(F.count(F.lit(1)).alias("n"))


@query("semi_and_anti", "H9 K4 K5", "SELECT (SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) AS semi, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) AS anti, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)) AS both")
def semi_and_anti(spark, sf):
    t = Tables(spark, sf)
    hit = t.raw("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    p = t.raw("part").select("p_partkey")
    both = t.raw("supplier").select("s_nationkey").intersect(t.raw("customer").select("c_nationkey"))
    one = p.join(hit, "p_partkey", "left_semi").agg(F.count(F.lit(1)).alias("semi"))
    return one.withColumn("anti", p.join(hit, "p_partkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("both", both.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("first_wins_extremes", "K2 J7", "SELECT l_suppkey, arg_min(l_partkey, struct_pack(q := -l_quantity, o := l_orderkey, l := l_linenumber, p := l_partkey)) AS top_part, max(l_quantity) AS top FROM lineitem GROUP BY 1")
def first_wins_extremes(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    order = F.struct((-F.col("l_quantity")).alias("q"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    return li.groupBy("l_suppkey").agg(F.min_by("l_partkey", order).alias("top_part"), F.max("l_quantity").alias("top"))


@query("top_n_sorted", "K1", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 900")
def top_n_sorted(spark, sf):
    return Tables(spark, sf).raw("orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(900).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("union_distinct", "K3", "SELECT DISTINCT k FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer)")
def union_distinct(spark, sf):
    t = Tables(spark, sf)
    return Tb.union_sources(t.raw("supplier").select(F.col("s_nationkey").alias("k")), t.raw("customer").select(F.col("c_nationkey").alias("k"))).distinct()


@query("clean_text", "K6", """SELECT doc_id, md5(lower(trim(source))) AS category, length(CASE WHEN length(text) > 160 THEN substr(text, 1, 159) || '…' ELSE text END) AS short_len, upper(lang) AS lang,
 starts_with(source, 'src1')::INT AS is_first, contains(text, ' ')::INT AS has_space, split_part(source, 'c', 2) AS part FROM documents""")
def clean_text(spark, sf):
    d = Tables(spark, sf).raw("documents")
    return d.select("doc_id", F.md5(X.clean_category(F.col("source"))).alias("category"), F.length(X.shorten(F.col("text"))).cast("long").alias("short_len"), F.upper("lang").alias("lang"),
                    F.col("source").startswith("src1").cast("int").alias("is_first"), F.col("text").contains(" ").cast("int").alias("has_space"), F.split_part("source", F.lit("c"), F.lit(2)).alias("part"))


@query("clean_titles", "K6", """SELECT p_partkey, list_aggregate(list_transform(string_split(trim(regexp_replace(replace(p_name || '-' || p_type, '-', ' '), '\\s+', ' ', 'g')), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS title FROM part""")
def clean_titles(spark, sf):
    return Tables(spark, sf).raw("part").select("p_partkey", X.clean_title(F.concat_ws("-", "p_name", "p_type")).alias("title"))


@query("category_codes", "K7", twin("SELECT cell_id, CAST(dense_rank() OVER (ORDER BY lith) AS INT) AS code FROM cells", "cells"))
def category_codes(spark, sf):
    return Tb.category_codes(Tables(spark, sf).cells().select("cell_id", "lith"), "lith", "code").select("cell_id", "code")


@query("date_functions", "K8", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE)::VARCHAR AS week_later, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since,
 CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(CAST(make_timestamp_ms(o_orderkey * 86400000 - 500000000000) AS DATE) AS VARCHAR) AS from_ms FROM orders""")
def date_functions(spark, sf):
    o = Tables(spark, sf).raw("orders")
    d = F.to_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd")
    from_ms = F.date_trunc("day", F.timestamp_millis(F.col("o_orderkey") * 86400000 - 500000000000)).cast("date").cast("string")
    return o.select("o_orderkey", d.cast("string").alias("day"), F.date_add(d, 7).cast("string").alias("week_later"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("since"),
                    F.year(d).alias("y"), F.month(d).alias("m"), F.ltrim(from_ms, F.lit("+")).alias("from_ms"))  # Spark writes years of five digits as +10000


@query("math_functions", "K9", """SELECT p_partkey, round(log10(p_retailprice), 9) AS l10, round(ln(p_retailprice), 9) AS ln, round(exp(p_size / 10.0e0), 6) AS ex, round(sqrt(p_size), 9) AS sq, round(sqrt(p_size * p_size + 16.0e0), 9) AS hy,
 round(atan2(p_size, 7.0e0), 9) AS at, least(30, greatest(10, p_size)) AS clipped, round_even(p_size / 2.0e0, 0) AS even FROM part""")
def math_functions(spark, sf):
    s = F.col("p_size")
    return Tables(spark, sf).raw("part").select("p_partkey", r6(F.log10("p_retailprice"), "l10", 9), r6(F.ln("p_retailprice"), "ln", 9), r6(F.exp(s / 10.0), "ex"), r6(F.sqrt(s.cast("double")), "sq", 9),
        r6(F.hypot(s.cast("double"), F.lit(4.0)), "hy", 9), r6(F.atan2(s.cast("double"), F.lit(7.0)), "at", 9), F.least(F.lit(30), F.greatest(F.lit(10), s)).alias("clipped"), F.bround(s / 2.0).alias("even"))


@query("arrays_maps_json", "K10 K11 A14", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, CAST(user_id AS VARCHAR) AS site, len(list_filter([1, 2, 3, 4], lambda x: x <= user_id % 5)) AS below FROM events""")
def arrays_maps_json(spark, sf):
    from ..sources.ingest import attrs_to_map
    e = Tables(spark, sf).raw("events")
    pairs = F.array(F.struct(F.lit("kind").alias("Name"), F.col("event_type").alias("Value")), F.struct(F.lit("site").alias("Name"), F.col("user_id").cast("string").alias("Value")))
    m = attrs_to_map(e.withColumn("attrs", pairs), "attrs")
    below = F.size(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), lambda x: x <= F.pmod(F.col("user_id"), F.lit(5))))
    return m.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.element_at("attrs", "kind").alias("kind"), F.element_at("attrs", "site").alias("site"), below.cast("long").alias("below"))


@query("membership_hash", "K13", twin("""SELECT substr(sha256(string_agg(b || ':' || d, chr(10) ORDER BY b || ':' || d)), 1, 16) AS sha16 FROM (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM (SELECT sha256(cell_id || ',' || lith) AS h FROM cells) GROUP BY 1)""", "cells"))
def membership_hash(spark, sf):
    return Tb.membership_hash(Tables(spark, sf).cells(), ["cell_id", "lith"])


# --- profiling ----------------------------------------------------------------------

PROF = {"l": "SELECT 'elev' AS layer, elev AS v FROM cells UNION ALL SELECT 'slope', slope FROM cells WHERE slope > 5 UNION ALL SELECT 'slope', NULL FROM cells WHERE slope <= 5",
        "e": "SELECT layer, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM l GROUP BY 1",
        "h": "SELECT layer, lo, hi, CAST(least(floor((least(greatest(v, lo), hi) - lo) / ((hi - lo) / 28)), 27) AS INT) AS bin, count(*) AS n FROM l JOIN e USING (layer) WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4"}


def prof_cells(t: Tables):
    return t.cells().select("elev", F.when(F.col("slope") > 5, F.col("slope")).alias("slope"))


@query("layer_profile", "Q1", twin("SELECT layer, round(avg((v IS NOT NULL)::INT), 6) AS coverage, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max FROM l GROUP BY 1", "cells", extra={"l": PROF["l"]}))
def layer_profile(spark, sf):
    p = Q.numeric_profile(prof_cells(Tables(spark, sf)), ["elev", "slope"])
    return p.select("layer", *[r6(c) for c in ("coverage", "mean", "min", "p01", "p50", "p99", "max")])


@query("layer_histograms", "Q1", twin("SELECT layer, bin, n FROM h", "cells", extra=PROF))
def layer_histograms(spark, sf):
    return Q.numeric_histograms(prof_cells(Tables(spark, sf)), ["elev", "slope"]).select("layer", "bin", "n")


@query("top_class_profile", "Q1", twin("SELECT lc, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cells GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", "cells"))
def top_class_profile(spark, sf):
    return Q.top_classes(Tables(spark, sf).cells(), "lc").select("lc", "count", r6("share"))


def u(layer: str, kind: str) -> str:
    return f"CAST('0x' || substr(md5(id || '|{layer}-{kind}-4'), 1, 8) AS BIGINT) / 4294967296.0e0"


def drawn(layer: str) -> str:
    return f"""(SELECT k.id, k.lo + (c.bin + {u(layer, 'in')}) * (k.hi - k.lo) / 28 AS v FROM (SELECT id, lo, hi, {u(layer, 'bin')} * t AS u FROM (SELECT partkey AS id FROM cells), (SELECT any_value(lo) AS lo, any_value(hi) AS hi, sum(n) AS t FROM h WHERE layer = '{layer}')) k
   ASOF JOIN (SELECT bin, sum(n) OVER (ORDER BY bin) - n AS c0 FROM h WHERE layer = '{layer}') c ON k.u >= c.c0)"""


SYN = dict(PROF, s=f"SELECT a.id, a.v AS elev, b.v AS slope FROM {drawn('elev')} a JOIN {drawn('slope')} b USING (id)")


@query("synthetic_rows", "Q2", twin("SELECT id, round(elev, 6) AS elev, round(slope, 6) AS slope FROM s", "cells", extra=SYN))
def synthetic_rows(spark, sf):
    t = Tables(spark, sf)
    h = Q.numeric_histograms(prof_cells(t), ["elev", "slope"])
    return Q.synth_rows(h, ["elev", "slope"], t.cells().select(F.col("partkey").alias("id")), 4).select("id", r6("elev"), r6("slope"))


@query("privacy_evidence", "Q3", twin("SELECT (SELECT round(corr(elev, CASE WHEN slope > 5 THEN slope END), 9) FROM cells) AS real_corr, round(corr(elev, slope), 9) AS synth_corr FROM s", "cells", extra=SYN))
def privacy_evidence(spark, sf):
    t = Tables(spark, sf)
    real = prof_cells(t)
    h = Q.numeric_histograms(real, ["elev", "slope"])
    s = Q.synth_rows(h, ["elev", "slope"], t.cells().select(F.col("partkey").alias("id")), 4)
    return Q.privacy_evidence(real, s, "elev", "slope").select(r6("real_corr", n=9), r6("synth_corr", n=9))


@query("publication_coarseness", "Q4", twin("SELECT layer, round(any_value(hi - lo) / 56, 6) AS half_bin, 25.0e0 AS reduction, 0.5e0 AS km_per_pixel FROM h GROUP BY 1", "cells", extra=PROF))
def publication_coarseness(spark, sf):
    h = Q.numeric_histograms(prof_cells(Tables(spark, sf)), ["elev", "slope"])
    return Q.coarseness(h, F.lit(2500.0), F.lit(100.0), 0.1).select("layer", r6("half_bin"), "reduction", "km_per_pixel")


@query("file_facts", "Q5", "SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS folder, coalesce(regexp_extract(url, '\\.([a-z]+)$', 1), '') AS suffix, min(url) AS representative, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1, 2")
def file_facts(spark, sf):
    p = Tables(spark, sf).raw("pages").withColumn("size", F.length("html"))
    return Q.inspect_files(p, F.regexp_extract("url", r"^https?://([^/]+)/", 1), F.regexp_extract("url", r"\.([a-z]+)$", 1), "url", "size")


@query("label_quality", "Q6", twin("SELECT count(*) AS n, round(avg((d IS NULL)::INT), 6) AS missing_dates, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, round(avg((accuracy IN ('exact', '1km'))::INT), 6) AS precise_share FROM (SELECT CASE WHEN size <> 3 THEN day END AS d, accuracy FROM ev)", "ev"))
def label_quality(spark, sf):
    e = Tables(spark, sf).events().withColumn("d", F.when(F.col("size") != 3, F.col("day")))
    q = Q.label_quality(e, "d", "accuracy")
    return q.select("n", r6("missing_dates"), txt("first_day"), txt("last_day"), r6("precise_share"))


@query("staleness_checks", "Q7", twin("SELECT 'duplicate cells' AS check, 0 AS offending, 1 AS ok UNION ALL SELECT 'duplicate order lines', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 0 UNION ALL SELECT 'stale prices', (SELECT count(*) FROM part WHERE p_size > 49), 0"))
def staleness_checks(spark, sf):
    t = Tables(spark, sf)
    p = t.raw("part")
    return Tb.checks({
        "duplicate cells": Tb.duplicate_keys(t.cells(), ["cell_id"]),
        "duplicate order lines": Tb.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"]),
        "stale prices": Tb.stale_rows(p, F.col("p_size"), F.least("p_size", F.lit(49))),
    })


@query("coverage_verdict", "Q8", twin("SELECT round(avg((slope > 15)::INT), 6) AS share, CASE WHEN avg((slope > 15)::INT) > 0.7 THEN 'usable' WHEN avg((slope > 15)::INT) > 0.25 THEN 'partial' ELSE 'unusable' END AS verdict FROM cells WHERE row % 3 = 0 AND col % 3 = 0", "cells"))
def coverage_verdict(spark, sf):
    from ..operators.lattice import decimate
    c = decimate(Tables(spark, sf).cells(), 3).withColumn("v", F.when(F.col("slope") > 15, F.col("slope")))
    return Q.coverage_verdict(c, "v").select(r6("share"), "verdict")


@query("centre_window", "Q9", twin("SELECT count(*) AS n, min(elev) AS min, max(elev) AS max FROM cells, (SELECT (min(row) + max(row)) // 2 AS r, (min(col) + max(col)) // 2 AS c FROM cells) WHERE row BETWEEN r - 3 AND r + 3 AND col BETWEEN c - 3 AND c + 3", "cells"))
def centre_window(spark, sf):
    return Q.centre_window(Tables(spark, sf).cells(), "elev", 3)


# --- catalogues of scenes -----------------------------------------------------------

register_cte("ev2", (), "SELECT event_id, user_id AS site, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'")
register_cte("best", ("scenes",), "SELECT site, day AS scene_day, min(cloud) AS cloud FROM scenes GROUP BY 1, 2")
register_cte("brk", ("ev2", "best"), """SELECT e.site, e.day, count(scene_day) AS n_scenes, l AS level, CAST(date_diff('day', max(scene_day) FILTER (WHERE scene_day <= e.day AND cloud <= l), e.day) AS INT) AS gap_before,
  CAST(date_diff('day', e.day, min(scene_day) FILTER (WHERE scene_day > e.day AND cloud <= l)) AS INT) AS gap_after FROM (SELECT DISTINCT site, day FROM ev2) e LEFT JOIN best b ON b.site = e.site AND abs(date_diff('day', e.day, scene_day)) <= 120, (SELECT unnest([20, 40, 60, 80]) AS l) GROUP BY 1, 2, 4""")


def dated(t: Tables):
    return t.raw("events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("site"), F.to_date("ts").alias("day"))


@query("bracket_asof", "H6 H7 I20", twin("SELECT site, CAST(day AS VARCHAR) AS day, n_scenes, level, gap_before, gap_after, gap_before + gap_after AS window FROM brk", "brk"))
def bracket_asof(spark, sf):
    t = Tables(spark, sf)
    b = Sc.bracket_asof(dated(t), t.scenes())
    return b.select("site", txt("day"), "n_scenes", "level", "gap_before", "gap_after", "window")


@query("best_per_day", "I20", twin("SELECT site, CAST(scene_day AS VARCHAR) AS day, cloud FROM best", "best"))
def best_per_day(spark, sf):
    return Sc.best_per_day(Tables(spark, sf).scenes()).select("site", txt("day"), "cloud")


@query("revisit_gaps", "J4", twin("SELECT site, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(quantile_cont(gap, 0.9), 6) AS p90_gap, max(gap) AS max_gap FROM (SELECT site, CAST(date_diff('day', lag(day) OVER (PARTITION BY site ORDER BY day), day) AS INT) AS gap FROM (SELECT DISTINCT site, day FROM scenes)) WHERE gap IS NOT NULL GROUP BY 1", "scenes"))
def revisit_gaps(spark, sf):
    return Sc.revisit_gaps(Tables(spark, sf).scenes(), ["site"]).select("site", r6("median_gap"), r6("p90_gap"), "max_gap")


@query("scene_mix", "S1", twin("SELECT 'mode' AS attribute, mode AS value, count(*) AS n FROM scenes GROUP BY 2 UNION ALL SELECT 'orbit', orbit, count(*) FROM scenes GROUP BY 2", "scenes"))
def scene_mix(spark, sf):
    return Sc.scene_mix(Tables(spark, sf).scenes(), ["mode", "orbit"])


@query("cloud_summary", "S2", twin("SELECT count(*) AS n, min(cloud) AS min, max(cloud) AS max, round(avg((cloud < 10)::INT), 6) AS below_10, round(avg((cloud < 20)::INT), 6) AS below_20, round(avg((cloud < 50)::INT), 6) AS below_50, quantile_cont(cloud, 0.5) AS median FROM scenes", "scenes"))
def cloud_summary(spark, sf):
    c = Sc.cloud_summary(Tables(spark, sf).scenes())
    return c.select("n", "min", "max", r6("below_10"), r6("below_20"), r6("below_50"), "median")


@query("date_window_summary", "S3 M23", twin("SELECT level, count(*) AS n_events, count(w) AS n_both, round(avg((w <= 7)::INT), 6) AS within_7, round(avg((w <= 14)::INT), 6) AS within_14, quantile_cont(w, 0.5) AS median_window, CASE WHEN avg((w <= 14)::INT) >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT level, gap_before + gap_after AS w FROM brk) GROUP BY 1", "brk"))
def date_window_summary(spark, sf):
    from ..functions.classify import verdict
    t = Tables(spark, sf)
    w = Sc.window_summary(Sc.bracket_asof(dated(t), t.scenes()))
    return w.select("level", "n_events", "n_both", r6("within_7"), r6("within_14"), "median_window", verdict(F.col("within_14") >= 0.30).alias("verdict"))


ACQ = {"g": "SELECT period, site, quantile_cont(gap, 0.5) AS m, quantile_cont(gap, 0.9) AS p FROM (SELECT period, site, date_diff('day', lag(day) OVER (PARTITION BY period, site ORDER BY day), day) AS gap FROM (SELECT DISTINCT mode AS period, site, day FROM scenes)) WHERE gap IS NOT NULL GROUP BY 1, 2"}


@query("acquisition_summary", "S4 J4", twin("SELECT s.period, n, \"asc\", \"desc\", median_gap, n_sites, round(p90_gap, 6) AS p90_gap FROM (SELECT mode AS period, count(*) AS n, count(*) FILTER (WHERE orbit = 'asc') AS \"asc\", count(*) FILTER (WHERE orbit = 'desc') AS \"desc\" FROM scenes GROUP BY 1) s LEFT JOIN (SELECT period, quantile_cont(m, 0.5) AS median_gap, quantile_cont(p, 0.5) AS p90_gap, count(*) AS n_sites FROM g GROUP BY 1) q USING (period)", "scenes", extra=ACQ))
def acquisition_summary(spark, sf):
    s = Sc.acquisition_summary(Tables(spark, sf).scenes().withColumnRenamed("mode", "period"), "site", "period")
    return s.select("period", "n", "asc", "desc", "median_gap", "n_sites", r6("p90_gap"))


# --- gazetteer ----------------------------------------------------------------------

DEG = "format('{{:.2f}}', round({0}, 2))"
register_cte("lab", ("places",), f"""SELECT place_id, name, lat, lon, kind, CASE WHEN k > 1 THEN b || ' #' || k ELSE b END AS label FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY place_id) AS k FROM (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '  (' || {DEG.format('lat')} || '°N ' || {DEG.format('lon')} || '°E)' ELSE name END AS b FROM places))""")


@query("place_labels", "P1", twin("SELECT place_id, label FROM lab", "lab"))
def place_labels(spark, sf):
    return P.label_places(Tables(spark, sf).places()).select("place_id", "label")


ANCH = {"anch": "SELECT name, min(lat) + 0.05e0 AS lat, min(lon) + 0.05e0 AS lon FROM places GROUP BY 1"}


@query("merged_anchors", "P2", twin("SELECT name, CASE WHEN name IN (SELECT label FROM lab) THEN name || ' (town)' ELSE name END AS label FROM anch a WHERE NOT EXISTS (SELECT 1 FROM places t WHERE t.name = a.name AND sqrt(pow((a.lat - t.lat) * 110.6e0, 2) + pow((a.lon - t.lon) * 98.9e0, 2)) <= 12)", "lab", extra=ANCH))
def merged_anchors(spark, sf):
    t = Tables(spark, sf).places()
    anchors = t.groupBy("name").agg((F.min("lat") + 0.05).alias("lat"), (F.min("lon") + 0.05).alias("lon"))
    return P.merge_anchors(anchors, t, P.label_places(t)).select("name", "label")


register_cte("typed", ("cells",), """SELECT partkey AS qid, CASE partkey % 5 WHEN 0 THEN '27.' || row || ', 92.' || col WHEN 1 THEN ' 27.' || row || 'S 92.' || col || 'w ' WHEN 2 THEN pname WHEN 3 THEN '92.' || col || ';27.' || row ELSE 'lat: 27.' || row || ' lon 192.' || col END AS text FROM cells""")
PARSED = {
 "tk": r"""SELECT qid, text, list_transform(regexp_extract_all(lower(replace(text, '°', ' ')), '[-+]?[0-9]+(?:[.][0-9]+)?|[a-z]+(?:\s*[.:=])*|\S'), lambda t: regexp_replace(t, '([a-z])[\s.:=]*$', '\1')) AS tk FROM typed""",
 "kd": """SELECT qid, text, tk, list_filter(tk, lambda t: regexp_matches(t, '[0-9]')) AS nums, array_to_string(list_transform(tk, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '#' WHEN t = 'lat' THEN 'A'
   WHEN t IN ('lon', 'lng', 'long') THEN 'O' WHEN t IN ('n', 's') THEN 'v' WHEN t IN ('e', 'w') THEN 'h' WHEN t IN (',', ';', '/') THEN ',' ELSE '?' END), '') AS kinds FROM tk""",
 "sg": """SELECT qid, text, len(nums) = 2 AND replace(replace(replace(replace(replace(replace(kinds, 'A#', '#'), '#v', '#'), '#h', '#'), ',', ''), 'O', ''), '##', 'ok') = 'ok' AS hit,
   CASE WHEN list_contains(tk, 's') THEN -abs(TRY_CAST(nums[1] AS DOUBLE)) ELSE TRY_CAST(nums[1] AS DOUBLE) END AS la, CASE WHEN list_contains(tk, 'w') THEN -abs(TRY_CAST(nums[2] AS DOUBLE)) ELSE TRY_CAST(nums[2] AS DOUBLE) END AS lo FROM kd""",
 "sw": "SELECT qid, text, hit, CASE WHEN abs(la) > 90 AND abs(lo) <= 90 THEN lo ELSE la END AS la, CASE WHEN abs(la) > 90 AND abs(lo) <= 90 THEN la ELSE lo END AS lo FROM sg",
 "parsed": "SELECT qid, text, CASE WHEN hit AND abs(la) <= 90 AND abs(lo) <= 180 THEN la END AS lat, CASE WHEN hit AND abs(la) <= 90 AND abs(lo) <= 180 THEN lo END AS lon FROM sw"}


def typed(t: Tables):
    k = F.pmod(F.col("partkey"), F.lit(5))
    r, c = F.col("row").cast("string"), F.col("col").cast("string")
    text = (F.when(k == 0, F.concat(F.lit("27."), r, F.lit(", 92."), c)).when(k == 1, F.concat(F.lit(" 27."), r, F.lit("S 92."), c, F.lit("w ")))
            .when(k == 2, F.col("pname")).when(k == 3, F.concat(F.lit("92."), c, F.lit(";27."), r)).otherwise(F.concat(F.lit("lat: 27."), r, F.lit(" lon 192."), c)))
    return t.cells().select(F.col("partkey").alias("qid"), text.alias("text"))


@query("parsed_coordinates", "P3", twin("SELECT qid, lat, lon FROM parsed", "typed", extra=PARSED))
def parsed_coordinates(spark, sf):
    la, lo = X.parse_coords(F.col("text"))
    return typed(Tables(spark, sf)).select("qid", la.alias("lat"), lo.alias("lon"))


@query("urls_are_not_coordinates", "P3", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(url, '^\\s*[-+]?\\d{1,3}(\\.\\d+)?\\s*[,;/ ]')) AS parsed FROM pages")
def urls_are_not_coordinates(spark, sf):
    la, _ = X.parse_coords(F.col("url"))
    return Tables(spark, sf).raw("pages").agg(F.count(F.lit(1)).alias("n"), F.count(la).alias("parsed"))


@query("resolved_queries", "P4", twin("SELECT q.qid, round(coalesce(q.lat, l.lat), 6) AS lat, round(coalesce(q.lon, l.lon), 6) AS lon, CASE WHEN q.lat IS NOT NULL THEN 'coords' ELSE l.kind END AS kind FROM (SELECT qid, CASE WHEN lat IS NULL THEN coalesce((SELECT label FROM lab WHERE place_id = qid AND qid % 2 = 0), text) ELSE text END AS text, lat, lon FROM parsed) q LEFT JOIN lab l ON l.label = q.text", "typed", "lab", extra=PARSED))
def resolved_queries(spark, sf):
    t = Tables(spark, sf)
    labels = P.label_places(t.places())
    own = labels.select(F.col("place_id").alias("qid"), "label")
    la, _ = X.parse_coords(F.col("text"))
    q = typed(t).join(own, "qid").withColumn("text", F.when(la.isNull() & (F.pmod(F.col("qid"), F.lit(2)) == 0), F.col("label")).otherwise(F.col("text"))).select("qid", "text")
    return P.resolve(q, "text", labels).select("qid", r6("lat"), r6("lon"), "kind")
