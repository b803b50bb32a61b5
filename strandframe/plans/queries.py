"""Queries over the stand-ins, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import aggregate as ag
from ..operators import collinear as co
from ..operators import curate as cu
from ..operators import filters as fl
from ..operators import joins as jn
from ..operators import learning as le
from ..operators import spatial as sp
from ..operators import stats as st
from ..operators import undersample as us
from ..operators import windows as wi
from ..sources import tables as tb
from . import plots as pl
from . import standins as si
from .standins import A, E, M, R, S, V

KEY = ["Uniprot_Entry", "Resid"]
FEATURES = ["propka", "sasa", "depth", "seqcharge"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *ctes: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return put


def on_measures(name: str, sql: str, make: Callable[[DataFrame], DataFrame], *ctes: str) -> None:
    query(name, sql, M, *ctes)(lambda s, d: make(si.measures(s, d)))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "row_id"], F.col("row_id.l_orderkey").alias("k1"), F.col("row_id.l_linenumber").alias("k2"), F.col("row_id.l_partkey").alias("k3"))


SHORT = "Uniprot_Entry, PDB_Code, Chain, Resid, sasa"
short = lambda df: df.select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa")

# selections
on_measures("p01_residue_rows", f"SELECT {SHORT} FROM measures WHERE Uniprot_Entry = 'P3' AND Resid = 2", lambda m: short(fl.residue_rows(m, "P3", 2)))
on_measures("p02_predicted", f"SELECT {SHORT} FROM measures WHERE Method = 'Predicted'", lambda m: short(fl.predicted_only(m)))
on_measures("p03_extreme_values", f"SELECT {SHORT}, propka FROM measures WHERE propka < 3 OR propka > 44", lambda m: fl.extreme_values(m, "propka", 3, 44).select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa", "propka"))
on_measures("p04_by_technique", f"SELECT {SHORT} FROM measures WHERE Method IN ('NMR', 'X-ray')", lambda m: short(fl.by_technique(m, ["NMR", "X-ray"])))
on_measures("p05_subset", f"SELECT {SHORT} FROM measures WHERE Uniprot_Entry IN ('P1', 'P2') AND Resid IN (1, 2)", lambda m: short(fl.subset(m, proteins=("P1", "P2"), residues=(1, 2))))
on_measures("p06_box", f"SELECT {SHORT} FROM measures WHERE sasa BETWEEN 1000 AND 20000 AND propka BETWEEN 5 AND 10", lambda m: short(m.filter(fl.in_box({"sasa": (1000, 20000), "propka": (5, 10)}))))
on_measures("p06_box_exclusive", f"SELECT {SHORT} FROM measures WHERE propka > 5 AND propka < 10", lambda m: short(m.filter(fl.in_box({"propka": (5, 10)}, inclusive=False))))
on_measures("p08_choose_features", "SELECT Uniprot_Entry, Resid, propka, sasa FROM measures WHERE propka IS NOT NULL AND sasa IS NOT NULL", lambda m: fl.choose_features(m, ["propka", "sasa"], FEATURES).select(*KEY, "propka", "sasa"))
on_measures("p09_pool_relaxed", f"SELECT {SHORT} FROM measures WHERE Source = 'relaxed'", lambda m: short(fl.pool_sources(m, "relaxed")[0]))
on_measures("p09_pool_separate", "SELECT Uniprot_Entry, Resid, Source, avg(sasa) AS sasa_avg FROM measures GROUP BY ALL", lambda m: m.groupBy(*KEY, "Source").agg(ag.statistic("sasa", "avg")))
on_measures("p12_drop_sparse", "SELECT Uniprot_Entry, Resid, sasa FROM measures", lambda m: (lambda left: left[0].select(*KEY, *left[1]))(fl.drop_sparse(m, ["propka", "sasa"], 0.05)))
on_measures("p10_prune_features", "SELECT Uniprot_Entry, Resid, PDB_Code, class, Method, sasa FROM measures", lambda m: fl.prune_features(m, ["sasa", "frustration"], KEY)[0])
on_measures("o05_first_rows", "SELECT Uniprot_Entry, Resid, PDB_Code, sasa FROM measures QUALIFY row_number() OVER (PARTITION BY Uniprot_Entry, Resid ORDER BY row_id) BETWEEN 3 AND 7", lambda m: fl.first_rows(m, KEY, ["row_id"], 5, skip=2).select(*KEY, "PDB_Code", "sasa"))
on_measures("p13_drop_missing", f"SELECT {SHORT} FROM measures WHERE propka IS NOT NULL", lambda m: short(fl.drop_missing(m, ["propka", "sasa"])))
on_measures("k04_rows_with_missing", f"SELECT {SHORT} FROM measures WHERE propka IS NULL", lambda m: short(fl.rows_with_missing(m, FEATURES)))
on_measures("p14_bounds", f"SELECT {SHORT}, depth FROM measures WHERE depth BETWEEN 0 AND 20", lambda m: fl.within_bounds(m).select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa", "depth"))
on_measures("p18_drop_class", f"SELECT {SHORT}, class FROM measures WHERE class IS DISTINCT FROM 'A'", lambda m: fl.drop_class(m, "A").select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa", "class"))
on_measures("p19_rename_class", "SELECT CASE WHEN class = 'N' THEN 'none' ELSE class END AS class, count(*) AS n FROM measures GROUP BY 1", lambda m: fl.rename_class(m, "N", "none").groupBy("class").agg(F.count("*").alias("n")))
on_measures("p22_prefer_relaxed", "SELECT c AS PDB_Code, count(*) AS n FROM (SELECT DISTINCT CASE WHEN Source = 'relaxed' THEN PDB_Code || '_relaxed' ELSE PDB_Code END AS c FROM measures) WHERE c LIKE '%_relaxed' OR c || '_relaxed' NOT IN (SELECT PDB_Code || '_relaxed' FROM measures WHERE Source = 'relaxed') GROUP BY 1", lambda m: fl.prefer_relaxed(m.select(F.when(F.col("Source") == "relaxed", F.concat("PDB_Code", F.lit("_relaxed"))).otherwise(F.col("PDB_Code")).alias("PDB_Code")).distinct()).groupBy("PDB_Code").agg(F.count("*").alias("n")))
on_measures("p23_source_of", "SELECT CASE WHEN p LIKE '%!_relaxed' ESCAPE '!' THEN 'relaxed' ELSE 'unrelaxed' END AS source, count(*) AS n FROM (SELECT PDB_Code || CASE WHEN Chain = 'F' THEN '_relaxed' ELSE '' END AS p FROM measures) GROUP BY 1", lambda m: m.select(fl.source_of(F.concat("PDB_Code", F.when(F.col("Chain") == "F", "_relaxed").otherwise(""))).alias("source")).groupBy("source").agg(F.count("*").alias("n")))
on_measures("g06_missing_profile", "SELECT 'propka' AS feature, count(*) FILTER (propka IS NULL) AS missing FROM measures UNION ALL SELECT 'sasa', count(*) FILTER (sasa IS NULL) FROM measures", lambda m: fl.missing_profile(m, ["propka", "sasa"]))
on_measures("o04_worst_features", "SELECT 'propka' AS feature, count(*) FILTER (propka IS NULL) AS missing FROM measures", lambda m: fl.missing_profile(m, FEATURES).orderBy(F.desc("missing"), "feature").limit(1))

# residue statistics
STAT_SQL = ", ".join(f"min({f}) AS {f}_min, max({f}) AS {f}_max, median({f}) AS {f}_med, avg({f}) AS {f}_avg, stddev_pop({f}) AS {f}_sd, max({f}) - min({f}) AS {f}_range" for f in FEATURES)
CLASS_SQL = "CASE WHEN min(class) = max(class) THEN min(class) ELSE '-1' END AS class, count(DISTINCT PDB_Code) AS num_structures"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _stats_sql(columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT Uniprot_Entry, Resid, {STAT_SQL}, {CLASS_SQL} FROM measures GROUP BY 1, 2)"


def _select(how: str, picks=None):
    return lambda m: _rounded(ag.select_statistics(ag.residue_statistics(m, KEY, FEATURES, row_id=None), KEY, FEATURES, how, picks))


ALL = ["Uniprot_Entry", "Resid", "class", "num_structures"]
_r6 = lambda names: ", ".join([*ALL, *[f"round({n}, 6) AS {n}" for n in names]])
on_measures("g01_residue_statistics", _stats_sql(_r6([f"{f}_{s}" for f in FEATURES for s in ag.STATS])), lambda m: _rounded(ag.residue_statistics(m, KEY, FEATURES, row_id=None).select(*ALL, *[f"{f}_{s}" for f in FEATURES for s in ag.STATS])))
HOT_SQL = f"SELECT {_r6([f'{f}_med' for f in FEATURES])} FROM (SELECT Uniprot_Entry, Resid, {STAT_SQL}, {CLASS_SQL} FROM (SELECT * REPLACE (CASE WHEN Resid <= 3 THEN 'hot' ELSE Uniprot_Entry END AS Uniprot_Entry, CASE WHEN Resid <= 3 THEN 0 ELSE Resid END AS Resid) FROM measures) GROUP BY 1, 2)"
on_measures("g01_hot_residue", HOT_SQL, lambda m: _rounded(ag.residue_statistics(m.withColumns({"Uniprot_Entry": F.when(F.col("Resid") <= 3, "hot").otherwise(F.col("Uniprot_Entry")), "Resid": F.when(F.col("Resid") <= 3, 0).otherwise(F.col("Resid"))}), KEY, FEATURES, row_id=None, by_ranks=True).select(*ALL, *[f"{f}_med" for f in FEATURES])))
on_measures("p15_minmax", _stats_sql(_r6([f"{f}_{s}" for f in FEATURES for s in ("min", "max")])), _select("minmax"))
on_measures("p15_median", _stats_sql(_r6([f"{f}_med" for f in FEATURES])), _select("median"))
on_measures("p15_minmaxavg", _stats_sql(_r6([f"{f}_{s}" for f in FEATURES for s in ("min", "max", "avg")])), _select("minmaxavg"))
on_measures("p16_mixmatch", _stats_sql(_r6(["propka_min", "sasa_max", "depth_min", "seqcharge_max"])), _select("mixmatch"))
on_measures("p17_choose", _stats_sql("Uniprot_Entry, Resid, class, round(propka_min, 6) AS propka_min, round(sasa_avg, 6) AS sasa_avg, round(sasa_sd, 6) AS sasa_sd"), _select("choose", {"propka": ["min"], "sasa": ["avg", "sd"]}))
on_measures("g05_class_consensus", "SELECT PDB_Code, CASE WHEN count(DISTINCT class) = 1 THEN min(class) ELSE '-1' END AS class FROM measures GROUP BY 1", lambda m: m.groupBy("PDB_Code").agg(ag.consensus_class()))
on_measures("g07_largest_entry", "SELECT substr(PDB_Code, 1, 3) AS entry, max(sasa) AS sasa FROM measures GROUP BY 1", lambda m: ag.largest_entry(m.withColumn("f", F.concat(F.substring("PDB_Code", 1, 3), F.lit("-alt-1_relaxed.pdb"))), "f", "sasa"))
on_measures("g12_distinct_proteins", "SELECT count(DISTINCT Uniprot_Entry) AS n, count(DISTINCT CASE WHEN propka > 44 THEN Uniprot_Entry END) AS selected FROM measures", lambda m: m.agg(F.countDistinct("Uniprot_Entry").alias("n"), F.countDistinct(F.when(F.col("propka") > 44, F.col("Uniprot_Entry"))).alias("selected")))
on_measures("g13_axis_limits", "SELECT round(min(sasa), 1) AS low, round(max(sasa), 1) AS high FROM measures", lambda m: pl.axis_limits(m, "sasa"))
on_measures("g14_repeated_keys", "SELECT Uniprot_Entry, Resid, Source, count(*) AS n FROM measures GROUP BY ALL HAVING count(*) > 1", lambda m: m.groupBy(*KEY, "Source").agg(F.count("*").alias("n")).filter("n > 1"))
on_measures("g15_distinct_rows", "SELECT DISTINCT Uniprot_Entry, Resid, Chain, Method, class FROM measures", lambda m: m.select("Uniprot_Entry", "Resid", "Chain", "Method", "class").dropDuplicates())


@query("g02_random_representative", None)
def g02(s, d):
    return ag.residue_statistics(si.measures(s, d), KEY, FEATURES, stats=("min", "max")).select(*KEY, *[f"{f}_{x}" for f in FEATURES for x in ("min", "max", "rand")])


NORM = "round(sqrt(list_sum(list_transform(aev, lambda x: x * x))), 9)"


@query("g03_vector_extremes", f"SELECT Resid, arg_min(vec_id, row({NORM}, vec_id)) AS nearest_id, arg_max(vec_id, row({NORM}, -vec_id)) AS furthest_id, round(arg_min(aev[1], row({NORM}, vec_id)), 6) AS first_nearest FROM vectors GROUP BY 1", V)
def g03(s, d):
    return ag.vector_extremes(si.vectors(s, d), ["Resid"], "aev", "vec_id").select("Resid", "nearest_id", "furthest_id", F.round(F.col("aev_nearest")[0], 6).alias("first_nearest"))


@query("g04_representative_vector", "SELECT Resid, arg_min(vec_id, row(CASE WHEN Method = 'Predicted' THEN 0 ELSE 1 END, vec_id)) AS from_id, round(arg_min(aev[3], row(CASE WHEN Method = 'Predicted' THEN 0 ELSE 1 END, vec_id)), 6) AS third FROM vectors GROUP BY 1", V)
def g04(s, d):
    return ag.representative_vector(si.vectors(s, d), ["Resid"], "aev", "vec_id").select("Resid", "from_id", F.round(F.col("aev")[2], 6).alias("third"))


@query("o03_widest_columns", "SELECT i - 1 AS pos, round(stddev_pop(x), 6) AS sd FROM (SELECT unnest(aev) AS x, generate_subscripts(aev, 1) AS i FROM vectors) GROUP BY 1 ORDER BY round(stddev_pop(x), 12) DESC, 1 LIMIT 10", V)
def o03(s, d):
    return ag.widest_columns(si.vectors(s, d), "aev", 10).select(F.col("pos").cast("long").alias("pos"), F.round("sd", 6).alias("sd"))


@query("m08_vector_magnitudes", "SELECT i - 1 AS pos, round(max(abs(x)), 6) AS top FROM (SELECT unnest(aev) AS x, generate_subscripts(aev, 1) AS i FROM vectors) GROUP BY 1 HAVING max(abs(x)) > 0", V)
def m08(s, d):
    return ag.vector_spread(si.vectors(s, d), "aev").filter("top > 0").select(F.col("pos").cast("long").alias("pos"), F.round("top", 6).alias("top"))


@query("g09_flexibility", """SELECT structure, chain, resid, CASE WHEN sd > 0 THEN round(avg((b - mean) / sd), 6) END AS flexibility FROM
 (SELECT *, avg(b) OVER w AS mean, stddev_samp(b) OVER w AS sd FROM (SELECT *, CASE WHEN occupancy > 0 THEN beta END AS b FROM atoms) WINDOW w AS (PARTITION BY structure)) GROUP BY structure, chain, resid, sd""", A)
def g09(s, d):
    return ag.flexibility(si.atoms(s, d)).select("structure", "chain", "resid", F.round("flexibility", 6).alias("flexibility"))


@query("g16_altloc_occupancy", "SELECT structure, model, chain, resid, altloc, round(avg(occupancy), 6) AS occupancy FROM atoms WHERE altloc <> '' GROUP BY ALL", A)
def g16(s, d):
    return cu.altloc_occupancy(si.atoms(s, d)).withColumn("occupancy", F.round("occupancy", 6))


query("g17_status_tally", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: si.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")))


@query("g11_ensemble_signature", "SELECT count(*) AS pairs FROM (SELECT a.resid FROM sig a JOIN sig b USING (sig))".replace("FROM sig a", "FROM (SELECT l_suppkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS sig, 1 AS resid FROM lineitem GROUP BY 1) a").replace("JOIN sig b", "JOIN (SELECT l_suppkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS sig FROM lineitem GROUP BY 1) b"))
def g11(s, d):
    ca = si.table(s, d, "lineitem").select(F.lit("P").alias("protein"), F.col("l_suppkey").alias("structure"), F.lit("LYS").alias("resname"), F.lit("A").alias("chain"), F.col("l_linenumber").alias("resid")).distinct()
    sizes = jn.ensemble_members(ca).groupBy("protein", "signature").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("pairs"))


# joins
def _feature_frames(m: DataFrame) -> list[DataFrame]:
    one = lambda f, how: m.groupBy("PDB_Code", "Chain", "Resid").agg(how(f).alias(f))
    return [one("propka", F.min).dropna(), one("sasa", F.max), one("depth", F.avg).filter("depth > 5").withColumn("depth", F.round("depth", 6))]


J01 = "(SELECT PDB_Code, Chain, Resid, min(propka) AS propka, max(sasa) AS sasa, round(avg(depth), 6) AS depth, avg(depth) AS raw FROM measures GROUP BY ALL)"
on_measures("j01_combine_features", f"SELECT PDB_Code, Chain, Resid, propka, sasa, depth FROM {J01} WHERE propka IS NOT NULL AND raw > 5", lambda m: jn.combine_features(_feature_frames(m), ["PDB_Code", "Chain", "Resid"]))
on_measures("j02_late_features", f"SELECT PDB_Code, Chain, Resid, propka, CASE WHEN raw > 5 THEN depth END AS depth FROM {J01} WHERE propka IS NOT NULL", lambda m: jn.join_late_features(_feature_frames(m)[0], _feature_frames(m)[2], ["PDB_Code", "Chain", "Resid"]))


@query("j03_confidence", f"SELECT {SHORT}, PLDDT FROM measures LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS PDB_Code, l_linestatus AS Chain, CAST(l_linenumber AS INT) AS Resid, l_quantity * 2 AS PLDDT FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) USING (PDB_Code, Chain, Resid)", M)
def j03(s, d):
    log = si.table(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").cast("string").alias("PDB_Code"), F.col("l_linestatus").alias("Chain"), F.col("l_linenumber").cast("int").alias("Resid"), (F.col("l_quantity") * 2).alias("PLDDT"), "l_partkey", "l_suppkey", "l_extendedprice")
    return jn.join_confidence(si.measures(s, d).withColumn("PDB_Code", F.concat("PDB_Code", F.lit("_relaxed"))), log, ["l_partkey", "l_suppkey", "l_extendedprice"]).select("Uniprot_Entry", fn.stem(F.col("PDB_Code")).alias("PDB_Code"), "Chain", "Resid", "sasa", "PLDDT")


def _log(s, d, where: str) -> DataFrame:
    e = si.table(s, d, "events").filter(where).select(F.col("user_id").cast("string").alias("structure"), F.col("event_type").alias("status"), F.round("value", 4).alias("energy"), "event_id")
    return jn.keep_last(e, ["structure"], ["event_id"]).drop("event_id")


LOG = "SELECT CAST(user_id AS VARCHAR) AS structure, event_type AS status, round(value, 4) AS energy FROM events WHERE {w} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("s04_last_log_record", "SELECT structure, status AS minimisation_status, energy AS minimisation_energy FROM (" + LOG.format(w="true") + ")")
def s04(s, d):
    e = si.table(s, d, "events").select(F.col("user_id").cast("string").alias("structure"), F.col("event_type").alias("status"), F.round("value", 4).alias("energy"), "event_id")
    return tb.last_per_structure(e, "minimisation", "event_id")


@query("j04_collate_logs", "SELECT g.structure, g.status AS geometry_status, g.energy AS geometry_energy, m.status AS minimisation_status, m.energy AS minimisation_energy FROM (" + LOG.format(w="event_type <> 'view'") + ") g LEFT JOIN (" + LOG.format(w="event_type <> 'click'") + ") m USING (structure)")
def j04(s, d):
    return jn.collate_logs({"geometry": _log(s, d, "event_type <> 'view'"), "minimisation": _log(s, d, "event_type <> 'click'")})


@query("j05_add_logs", f"SELECT {SHORT}, g.status AS geometry_status, m.energy AS minimisation_energy FROM measures x LEFT JOIN (" + LOG.format(w="event_type <> 'view'") + ") g ON x.PDB_Code = g.structure LEFT JOIN (" + LOG.format(w="event_type <> 'click'") + ") m ON x.PDB_Code = m.structure", M)
def j05(s, d):
    return jn.add_logs(si.measures(s, d), {"geometry": _log(s, d, "event_type <> 'view'"), "minimisation": _log(s, d, "event_type <> 'click'")}).select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa", "geometry_status", "minimisation_energy")


EXTRA = "(SELECT CAST(l_orderkey AS VARCHAR) AS PDB_Code, l_linestatus AS Chain, CAST(l_linenumber AS INT) AS Resid, max(l_tax) AS das, min(l_extendedprice) AS sasa FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)"


@query("j06_extra_measures", f"SELECT Uniprot_Entry, PDB_Code, Chain, Resid, x.sasa AS sasa, e.das FROM measures x LEFT JOIN {EXTRA} e USING (PDB_Code, Chain, Resid)", M)
def j06(s, d):
    extra = si.table(s, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").cast("string").alias("PDB_Code"), F.col("l_linestatus").alias("Chain"), F.col("l_linenumber").cast("int").alias("Resid")).agg(F.max("l_tax").alias("das"), F.min("l_extendedprice").alias("sasa"))
    return jn.add_measures(si.measures(s, d), extra).select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa", "das")


query("j07_required_residues", f"SELECT DISTINCT {SHORT}, propka, depth FROM measures WHERE (Uniprot_Entry, Resid) IN (SELECT Uniprot_Entry, Resid FROM sites)", M, S)(lambda s, d: jn.required_residues(si.measures(s, d).select("Uniprot_Entry", "PDB_Code", "Chain", "Resid", "sasa", "propka", "depth"), si.sites(s, d)))
query("j08_class_labels", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN s.Resid IS NOT NULL THEN 'site' ELSE coalesce(class, '-1') END AS class FROM measures m LEFT JOIN (SELECT DISTINCT * FROM sites) s USING (Uniprot_Entry, Resid)) GROUP BY 1", M, S)(lambda s, d: jn.add_labels(si.measures(s, d), si.sites(s, d), "site").groupBy("class").agg(F.count("*").alias("n")))
query("j09_match_files", "SELECT o_orderkey, PDB_Code FROM (SELECT DISTINCT PDB_Code FROM measures) JOIN orders ON PDB_Code = CAST(o_orderkey AS VARCHAR)", M)(lambda s, d: jn.match_files(si.measures(s, d).select("PDB_Code").distinct(), si.table(s, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("-alt-1_relaxed")).alias("file"))).select("o_orderkey", "PDB_Code"))
query("j10_with_term", f"SELECT {SHORT} FROM measures WHERE Uniprot_Entry IN (SELECT uniprot FROM edges WHERE go_id = 'Brand#11')", M, E)(lambda s, d: short(jn.with_term(si.measures(s, d), si.edges(s, d), "Brand#11")))
@query("j10_with_term_name", f"SELECT {SHORT} FROM measures WHERE Uniprot_Entry IN (SELECT uniprot FROM edges WHERE go_id = (SELECT min(go_id) FROM terms WHERE name = (SELECT name FROM terms WHERE go_id = 'Brand#12')))", M, E)
def j10_name(s, d):
    terms = si.terms(s, d)
    name = terms.filter("go_id = 'Brand#12'").first()["name"]
    return short(jn.with_term(si.measures(s, d), si.edges(s, d), name=name, terms=terms))


query("j11_terms_of", "SELECT DISTINCT uniprot, go_id, name FROM edges JOIN terms USING (go_id)", E)(lambda s, d: jn.terms_of(si.edges(s, d), si.terms(s, d)))
query("j19_renumber", "SELECT structure, chain, CAST(CASE WHEN min(ok) OVER (PARTITION BY structure, chain) THEN n ELSE resid END AS INT) AS resid, serial, CASE WHEN min(ok) OVER (PARTITION BY structure) THEN 'uniprot' WHEN max(chain_ok) OVER (PARTITION BY structure) THEN 'mixed' ELSE 'author' END AS numbering FROM (SELECT *, min(ok) OVER (PARTITION BY structure, chain) AS chain_ok FROM (SELECT structure, chain, resid, serial, CASE WHEN resid % 23 <> 0 THEN resid + 1000 ELSE resid END AS n, (record <> 'ATOM' OR resid % 23 <> 0) AS ok FROM atoms))", A)(lambda s, d: cu.renumber(si.atoms(s, d), si.atoms(s, d).select("structure", "chain", "resid").distinct().filter("resid % 23 <> 0").withColumn("new", F.col("resid") + 1000)).select("structure", "chain", "resid", "serial", "numbering"))
query("j18_rename_chains", "SELECT CASE WHEN chain = '3' THEN 'C' ELSE chain END AS chain, count(*) AS n FROM atoms GROUP BY 1", A)(lambda s, d: cu.rename_chains(si.atoms(s, d), si.atoms(s, d).filter("chain = '3'").select("structure", "chain").distinct().withColumn("new", F.lit("C"))).groupBy("chain").agg(F.count("*").alias("n")))
query("j20_fill_values", "SELECT k, coalesce(a, b) AS v FROM (SELECT l_suppkey AS k, min(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 GROUP BY 1) FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier) USING (k)")(lambda s, d: jn.fill_from(si.table(s, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity = 50").groupBy(F.col("l_suppkey").alias("k")).agg(F.min("l_quantity").alias("v")), si.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"], "v"))
query("j21_not_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")(
    lambda s, d: jn.not_done(si.table(s, d, "customer").select("c_custkey"), si.table(s, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
)
query("j22_restart", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey <> (SELECT arg_max(o_custkey, o_orderkey) FROM orders))")(lambda s, d: jn.not_done_but_last(si.table(s, d, "customer").select("c_custkey"), si.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", ["o_orderkey"]))

# distances
P = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"
AKEY = ["structure", "serial"]
anchors = lambda s, d: si.atoms(s, d).filter("name = 'NZ'")
_near = lambda df: df.withColumn("distance", F.round("distance", 6))
query("j12_other_chain_distance", f"SELECT p.structure, p.serial, round(min({P}), 6) AS distance FROM atoms p LEFT JOIN atoms q ON p.structure = q.structure AND p.chain <> q.chain AND q.resname IN {sp.PROTEIN} AND coalesce(q.element, '') NOT IN ('H', 'D') WHERE p.name = 'NZ' GROUP BY ALL", A)(lambda s, d: _near(sp.other_chain_distance(anchors(s, d), si.atoms(s, d), AKEY, start=1.0)))
query("j13_terminus_distance", f"SELECT p.structure, p.serial, round(min({P}), 6) AS distance FROM atoms p JOIN (SELECT a.* FROM atoms a JOIN (SELECT structure, chain, arg_min(resid, serial) AS r1, arg_max(resid, serial) AS r2 FROM atoms GROUP BY ALL) USING (structure, chain) WHERE resid IN (r1, r2)) q USING (structure) WHERE p.name = 'NZ' GROUP BY p.structure, p.serial", A)(lambda s, d: _near(sp.terminus_distance(anchors(s, d), si.atoms(s, d), AKEY)))
query("j14_modelled_distance", f"SELECT p.structure, p.serial, round(min({P}), 6) AS distance, min(m.b) AS in_modelled_region FROM atoms p JOIN atoms q ON p.structure = q.structure AND q.occupancy = 0 JOIN (SELECT structure, chain, resid, max(occupancy = 0) AS b FROM atoms GROUP BY ALL) m ON m.structure = p.structure AND m.chain = p.chain AND m.resid = p.resid WHERE p.name = 'NZ' GROUP BY p.structure, p.serial", A)(lambda s, d: _near(sp.modelled_distance(anchors(s, d), si.atoms(s, d), AKEY, start=1.0)).select("structure", "serial", "distance", "in_modelled_region"))
query("j16_neighbours", f"SELECT p.structure, p.serial, count(q.serial) AS n_neighbours FROM atoms p LEFT JOIN atoms q ON p.structure = q.structure AND {P} <= 3 WHERE p.name = 'NZ' GROUP BY ALL", A)(lambda s, d: sp.neighbours(anchors(s, d), si.atoms(s, d), AKEY, 3.0))
ORD = "(SELECT *, dense_rank() OVER (PARTITION BY structure, chain ORDER BY f) AS o FROM (SELECT *, min(serial) OVER (PARTITION BY structure, chain, resid) AS f FROM atoms))"
CLASHES = f"""(SELECT p.structure, {P} AS distance, p.serial AS p_serial, q.serial AS q_serial, p.chain AS p_chain, q.chain AS q_chain, p.record AS p_record, q.record AS q_record, p.occupancy AS p_occupancy, q.occupancy AS q_occupancy, p.resname AS p_resname, q.resname AS q_resname,
  p.chain || '/' || p.resname || p.resid || ':' || p.name || ' <-> ' || q.chain || '/' || q.resname || q.resid || ':' || q.name AS pair
 FROM {ORD} p JOIN {ORD} q ON p.structure = q.structure AND p.serial < q.serial AND {P} <= 4.0
 WHERE NOT (p.chain = q.chain AND p.resid = q.resid) AND NOT (p.chain = q.chain AND abs(p.o - q.o) = 1 AND p.name IN ('N','CA','C','O') AND q.name IN ('N','CA','C','O')) AND NOT (p.name = 'SG' AND q.name = 'SG')
 AND NOT (p.altloc <> '' AND q.altloc <> '' AND p.altloc <> q.altloc) AND p.resname NOT IN {sp.IONS} AND q.resname NOT IN {sp.IONS} AND p.element NOT IN {sp.METALS} AND q.element NOT IN {sp.METALS} AND p.element NOT IN ('H', 'D') AND q.element NOT IN ('H', 'D'))"""
query("j15_clashes", f"SELECT p_serial, q_serial, round(distance, 6) AS distance FROM {CLASHES} WHERE distance < 2.0", A)(lambda s, d: sp.clashes(si.atoms(s, d), wi.residue_ordinals(si.atoms(s, d))).select("p_serial", "q_serial", F.round("distance", 6).alias("distance")))
query("g10_geometry_summary", f"""SELECT structure, n_atoms, coalesce(n_clashes, 0) AS n_clashes, round(min_contact, 6) AS min_contact, worst, coalesce(inter_chain, false) AS inter_chain, coalesce(involves_hetatm, false) AS involves_hetatm, coalesce(involves_modelled, false) AS involves_modelled, coalesce(involves_water, false) AS involves_water
 FROM (SELECT structure, count(*) AS n_atoms FROM atoms GROUP BY 1) LEFT JOIN (SELECT structure, count(*) FILTER (distance < 2) AS n_clashes, min(distance) AS min_contact, arg_min(pair, row(distance, p_serial, q_serial)) FILTER (distance < 2) AS worst, bool_or(distance < 2 AND p_chain <> q_chain) AS inter_chain, bool_or(distance < 2 AND 'HETATM' IN (p_record, q_record)) AS involves_hetatm,
 bool_or(distance < 2 AND (p_occupancy = 0 OR q_occupancy = 0)) AS involves_modelled, bool_or(distance < 2 AND (p_resname IN {sp.WATERS} OR q_resname IN {sp.WATERS})) AS involves_water FROM {CLASHES} WHERE distance < 4 GROUP BY 1) USING (structure)""", A)(lambda s, d: sp.geometry_summary(si.atoms(s, d), wi.residue_ordinals(si.atoms(s, d))).withColumn("min_contact", F.round("min_contact", 6)))

# windows
on_measures("w01_row_position", "SELECT PDB_Code, CAST(max(position) AS INT) AS last FROM (SELECT PDB_Code, row_number() OVER (PARTITION BY Uniprot_Entry, Resid ORDER BY row_id) AS position FROM measures) GROUP BY 1", lambda m: wi.row_position(m, KEY, "row_id").groupBy("PDB_Code").agg(F.max("position").alias("last")))
query("w02_residue_ordinals", "SELECT structure, chain, resid, min(serial) AS first_serial, CAST(dense_rank() OVER (PARTITION BY structure, chain ORDER BY min(serial)) AS INT) AS ordinal FROM atoms GROUP BY structure, chain, resid", A)(lambda s, d: wi.residue_ordinals(si.atoms(s, d)))
query("w03_keep_last", LOG.format(w="true"))(lambda s, d: _log(s, d, "true"))
Z = "CASE WHEN stddev_pop({x}) OVER w > 1e-12 THEN ({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w ELSE 0 END"
on_measures("w04_relative_best", f"SELECT Uniprot_Entry, Resid, PDB_Code, sasa, propka, score FROM (SELECT *, round(0.3 * {Z.format(x='inv')} + 0.7 * {Z.format(x='sasa')}, 9) AS score FROM (SELECT *, max(propka) OVER (PARTITION BY Uniprot_Entry, Resid) - propka AS inv FROM measures WHERE propka IS NOT NULL) WINDOW w AS (PARTITION BY Uniprot_Entry, Resid)) QUALIFY row_number() OVER (PARTITION BY Uniprot_Entry, Resid ORDER BY score DESC, row_id DESC) = 1", lambda m: wi.relative_best(m, KEY, 0.3, {"propka": None, "sasa": None}, "row_id").select(*KEY, "PDB_Code", "sasa", "propka", "score"))
query("w05_sliding_charge", "SELECT event_id, CAST(sum(charge) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS BIGINT) AS seqcharge FROM residues", R)(lambda s, d: wi.sliding_sum(si.residues(s, d), ["user_id"], ["ts", "event_id"], "charge").select("event_id", "seqcharge"))
query("w06_chain_termini", "SELECT structure, chain, arg_min(resid, serial) AS first_resid, arg_max(resid, serial) AS last_resid FROM atoms GROUP BY ALL", A)(lambda s, d: wi.chain_termini(si.atoms(s, d)))
query("w07_gap_profile", "SELECT l_suppkey, count(*) FILTER (g > 0) AS n_gaps, CAST(coalesce(sum(g), 0) AS BIGINT) AS missing, CAST(coalesce(max(g), 0) AS BIGINT) AS largest_gap FROM (SELECT l_suppkey, r - lag(r) OVER (PARTITION BY l_suppkey ORDER BY r) - 1 AS g FROM (SELECT DISTINCT l_suppkey, l_orderkey % 1000 AS r FROM lineitem)) GROUP BY 1")(lambda s, d: wi.gap_profile(si.table(s, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 1000).alias("r")), ["l_suppkey"], "r"))
query("w08_islands", "SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT user_id, charge, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM residues) WHERE charge = 0) GROUP BY user_id, run", R)(lambda s, d: wi.islands(wi.row_position(si.residues(s, d).withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o").withColumn("position", F.col("position").cast("long")), ["user_id"], "position", F.col("charge") == 0))
# aligned strings: what the target lacks, and what the template lacks
PAIRS = """cols AS (SELECT p_partkey AS id, substr(translate(p_type, 'O', '-'), i, 1) AS t, substr(translate(p_type, 'AEIU', '----'), i, 1) AS s, i FROM (SELECT p_partkey, p_type, unnest(generate_series(1, length(p_type))) AS i FROM part)),
placed AS (SELECT id, s, sum(CASE WHEN t <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS pos FROM cols QUALIFY t <> '-'),
runs AS (SELECT id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM placed WHERE s = '-') GROUP BY id, run),
inner_runs AS (SELECT r.* FROM runs r JOIN (SELECT id, min(pos) AS a, max(pos) AS b FROM placed WHERE s <> '-' GROUP BY id) USING (id) WHERE first > a AND last < b)"""


def _aligned(s, d):
    return si.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.translate("p_type", "O", "-").alias("target"), F.translate("p_type", "AEIU", "----").alias("template"))


query("w08_alignment_gaps", "SELECT id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, n FROM inner_runs", PAIRS)(lambda s, d: wi.alignment_gaps(_aligned(s, d)).select("id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n"))
query("w08_untrimmed_gaps", "SELECT id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, n FROM runs", PAIRS)(lambda s, d: wi.alignment_gaps(_aligned(s, d), trim=False).select("id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n"))
query("w08_gaps_over_cutoff", "SELECT id, max(n) AS largest_gap FROM inner_runs GROUP BY id HAVING max(n) > 1", PAIRS)(lambda s, d: wi.gaps_over(_aligned(s, d), 1))
query("w09_local_sequence", "SELECT event_id, lpad(coalesce(string_agg(letter, '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ''), 4, 'X') || letter || rpad(coalesce(string_agg(letter, '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), ''), 4, 'X') AS local FROM residues", R)(lambda s, d: wi.local_sequence(si.residues(s, d), ["user_id"], ["ts", "event_id"], "letter", 4).select("event_id", "local"))
query("w10_fdr", "SELECT s_suppkey, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM (SELECT s_suppkey, p, row_number() OVER (ORDER BY p, s_suppkey) AS i, count(*) OVER () AS m FROM (SELECT s_suppkey, abs(s_acctbal) / 100000 AS p FROM supplier))")(lambda s, d: wi.step_up_fdr(si.table(s, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 100000).alias("p")), "p", "s_suppkey").select("s_suppkey", F.round("fdr", 9).alias("fdr")))


def _turn_sql(*p: str) -> str:
    """Degrees of the dihedral angle of four points, each a list of three coordinates."""
    minus = lambda a, b: [f"({a}[{i}] - {b}[{i}])" for i in (1, 2, 3)]
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    dot = lambda a, b: f"({a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]})"
    u, v, w = minus(p[1], p[0]), minus(p[2], p[1]), minus(p[3], p[2])
    return f"round(degrees(atan2({dot(u, cross(v, w))} * sqrt({dot(v, v)}), {dot(cross(u, v), cross(v, w))})), 6)"


BLOCKS = "blocks AS (SELECT structure, CAST(serial // 10 AS BIGINT) AS ordinal, " + ", ".join(f"arg_min([x, y, z], serial) FILTER (name = '{n.upper()}') AS {n}" for n in ("n", "ca", "c")) + " FROM atoms GROUP BY ALL)"


@query("w11_dihedrals", f"SELECT structure, ordinal, {_turn_sql('c0', 'n', 'ca', 'c')} AS phi, {_turn_sql('n', 'ca', 'c', 'n1')} AS psi FROM (SELECT *, lag(c) OVER w AS c0, lead(n) OVER w AS n1 FROM blocks WINDOW w AS (PARTITION BY structure ORDER BY ordinal))", A, BLOCKS)
def w11(s, d):
    xyz = F.array("x", "y", "z")
    each = lambda n: F.first(F.when(F.col("name") == n, xyz), ignorenulls=True)
    bb = si.atoms(s, d).withColumn("block", F.floor(F.col("serial") / 10)).groupBy("structure", "block").agg(each("N").alias("n"), each("CA").alias("ca"), each("C").alias("c")).select("structure", F.lit("A").alias("chain"), F.col("block").alias("ordinal"), "n", "ca", "c")
    return wi.dihedrals(bb).select("structure", "ordinal", F.round("phi", 6).alias("phi"), F.round("psi", 6).alias("psi"))


# curation
query("p20_anchor_atoms", "SELECT structure, chain, resid, serial, resname = 'MSE' AS \"Modified\" FROM atoms WHERE resname IN ('LYS', 'MSE') AND name IN ('NZ', 'CE') QUALIFY row_number() OVER (PARTITION BY structure, chain, resid ORDER BY serial) = 1", A)(lambda s, d: cu.anchor_atoms(si.atoms(s, d), ("LYS",), ("NZ", "CE"), ("MSE",)).select("structure", "chain", "resid", "serial", "Modified"))
query("p24_keep_hetero", "SELECT serial FROM atoms WHERE record <> 'HETATM' OR resname <> 'HOH'", A)(lambda s, d: si.atoms(s, d).filter(cu.keep_hetero()).select("serial"))
query("p25_clean", "SELECT serial, CASE WHEN resname = 'MSE' THEN 'MET' WHEN resname = 'HIS' THEN 'ALA' ELSE resname END AS resname FROM atoms WHERE NOT (resname = 'HIS' AND name NOT IN ('N', 'CA', 'C', 'O'))", A)(lambda s, d: cu.clean(si.atoms(s, d), si.atoms(s, d).filter("resname = 'HIS'").select("structure", "resname").distinct().withColumn("parent", F.lit("ALA"))).select("serial", "resname"))
query("p26_without_insertions", "SELECT serial FROM atoms WHERE structure NOT IN (SELECT structure FROM atoms WHERE icode <> '' AND structure <> 'S1') OR false", A)(lambda s, d: cu.without_insertions(si.atoms(s, d).withColumn("icode", F.when(F.col("structure") == "S1", "").otherwise(F.col("icode")))).select("serial"))
ROT = "(SELECT structure, model, chain, resid, altloc, row_number() OVER (PARTITION BY structure, model, chain, resid ORDER BY {o}) AS n FROM (SELECT structure, model, chain, resid, altloc, round(avg(occupancy), 9) AS occ FROM atoms WHERE altloc <> '' GROUP BY ALL))"
for _how, _order in (("first", "altloc"), ("highest_occupancy", "occ DESC, altloc")):
    query(f"p28_rotamers_{_how}", f"SELECT serial FROM atoms a LEFT JOIN {ROT.format(o=_order)} b ON a.structure = b.structure AND a.model = b.model AND a.chain = b.chain AND a.resid = b.resid AND b.n = 1 WHERE a.altloc = '' OR a.altloc = b.altloc", A)(lambda s, d, how=_how: cu.pick_rotamers(si.atoms(s, d), how).select("serial"))
# a letter on hetero atoms only, and a structure without letters on its ATOM records
LETTERS = f"{A}, lettered AS (SELECT structure, serial, record, CASE WHEN structure = 'S1' AND record = 'ATOM' THEN '' WHEN record = 'HETATM' AND altloc = 'A' THEN 'C' ELSE altloc END AS altloc FROM atoms)"


def _lettered(s, d):
    letter = F.when((F.col("structure") == "S1") & (F.col("record") == "ATOM"), "").when((F.col("record") == "HETATM") & (F.col("altloc") == "A"), "C")
    return si.atoms(s, d).withColumn("altloc", letter.otherwise(F.col("altloc")))


@query("p28_rotamers_all", """SELECT serial, l AS conformer, CASE WHEN altloc = l THEN '' ELSE altloc END AS altloc
FROM lettered LEFT JOIN (SELECT DISTINCT structure, altloc AS l FROM lettered WHERE record = 'ATOM' AND altloc <> '') x USING (structure)
WHERE l IS NOT NULL AND (altloc = '' OR altloc = l OR altloc NOT IN (SELECT altloc FROM lettered y WHERE y.structure = lettered.structure AND y.record = 'ATOM'))
UNION ALL SELECT serial, '', altloc FROM lettered WHERE structure NOT IN (SELECT structure FROM lettered WHERE record = 'ATOM' AND altloc <> '')""", LETTERS)
def p28_all(s, d):
    return cu.pick_rotamers(_lettered(s, d), "all").select("serial", "conformer", "altloc")


# residues that the presets name, with modified forms of their own anchors
FORMS = f"""{A}, forms AS (SELECT structure, chain, resid, serial, CASE WHEN resname = 'LYS' AND resid % 3 = 0 THEN 'KCX' WHEN resname = 'GLU' AND resid % 2 = 1 THEN 'CGU' WHEN resname = 'ASP' AND resid % 3 = 1 THEN 'ASH' ELSE resname END AS resname,
  CASE WHEN resname = 'MSE' AND name = 'CE' THEN 'SE' WHEN resname = 'GLU' AND name = 'CE' THEN 'CD1' ELSE name END AS name FROM atoms)"""
PRESET_SQL = {
    "LYS": ("'LYS', 'LYSN', 'LYN'", "'LYE', 'KCX', 'MLY', 'MLZ', 'M3L', 'ALY', 'LYR'", "'NZ'", "'NZ', 'N07'"),
    "GLU": ("'GLU', 'GLH'", "'CGU'", "'CD'", "'CD', 'CD1'"),
    "MET": ("'MET'", "'MSE', 'OMT', 'MHO'", "'SD'", "'SD', 'SE'"),
    "ASP": ("'ASP', 'ASH'", "''", "'CG'", "'CG'"),
}


@query("p20_presets", " UNION ALL ".join(f"(SELECT '{r}' AS residue, structure, chain, resid, serial, name, resname IN ({m}) AS \"Modified\" FROM forms WHERE (resname IN ({c}) AND name IN ({n})) OR (resname IN ({m}) AND name IN ({k})) QUALIFY row_number() OVER (PARTITION BY structure, chain, resid ORDER BY serial) = 1)" for r, (c, m, n, k) in PRESET_SQL.items()), FORMS)
def p20_presets(s, d):
    code = F.when((F.col("resname") == "LYS") & (F.col("resid") % 3 == 0), "KCX").when((F.col("resname") == "GLU") & (F.col("resid") % 2 == 1), "CGU").when((F.col("resname") == "ASP") & (F.col("resid") % 3 == 1), "ASH")
    name = F.when((F.col("resname") == "MSE") & (F.col("name") == "CE"), "SE").when((F.col("resname") == "GLU") & (F.col("name") == "CE"), "CD1")
    forms = si.atoms(s, d).withColumns({"resname": code.otherwise(F.col("resname")), "name": name.otherwise(F.col("name"))})
    found = [cu.preset_anchors(forms, r).select(F.lit(r).alias("residue"), "structure", "chain", "resid", "serial", "name", "Modified") for r in PRESET_SQL]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


query("p31_chain_limits", "SELECT structure, 'too many chains' AS reason FROM atoms GROUP BY 1 HAVING count(DISTINCT chain) > 9", A)(lambda s, d: cu.fits_limits(si.atoms(s, d), 9)[1])
query("p32_small_gaps", "SELECT structure, count(*) AS n FROM atoms WHERE structure NOT IN (SELECT structure FROM (SELECT structure, resid - lag(resid) OVER (PARTITION BY structure, chain ORDER BY resid) - 1 AS g FROM (SELECT DISTINCT structure, chain, resid FROM atoms WHERE name = 'CA')) GROUP BY 1 HAVING max(g) > 15) GROUP BY 1", A)(lambda s, d: cu.small_gaps(si.atoms(s, d), 15).groupBy("structure").agg(F.count("*").alias("n")))
query("p33_incomplete_residues", "SELECT structure, chain, resid, resname, string_agg(n, ',' ORDER BY n) AS missing FROM (SELECT DISTINCT structure, chain, resid, resname FROM atoms WHERE record = 'ATOM' AND resname IN ('LYS', 'CYS')) r, (SELECT unnest(['CA', 'NZ', 'SG']) AS n) e WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.structure = r.structure AND a.chain = r.chain AND a.resid = r.resid AND a.name = e.n) GROUP BY ALL", A)(lambda s, d: cu.incomplete_residues(si.atoms(s, d), si.atoms(s, d).filter("resname in ('LYS', 'CYS')").select("resname").distinct().withColumn("name", F.explode(F.array(F.lit("CA"), F.lit("NZ"), F.lit("SG"))))).withColumn("missing", F.array_join("missing", ",")))
query("u04_merge_hetero", "SELECT serial, 'target' AS side FROM atoms WHERE record <> 'HETATM' UNION ALL SELECT serial, 'source' FROM atoms WHERE record = 'HETATM'", A)(lambda s, d: cu.merge_hetero(si.atoms(s, d).withColumn("side", F.lit("target")), si.atoms(s, d).withColumn("side", F.lit("source"))).select("serial", "side"))

# sets and sources
query("u01_union_by_name", "SELECT n_nationkey AS k, n_name AS name, NULL AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")(lambda s, d: si.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(si.table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region")), allowMissingColumns=True))
query("u03_set_difference", "SELECT uniprot FROM edges WHERE go_id = 'Brand#11' EXCEPT SELECT 'P' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 3000", E)(
    lambda s, d: si.edges(s, d).filter("go_id = 'Brand#11'").select("uniprot").exceptAll(si.table(s, d, "supplier").filter("s_acctbal > 3000").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))))
)
query("u05_structure_names", "SELECT CAST(user_id AS VARCHAR) AS structure FROM events UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem")(lambda s, d: si.table(s, d, "events").select(F.col("user_id").cast("string").alias("structure")).union(si.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string"))).distinct())
query("s03_resolve_input", """SELECT DISTINCT Uniprot_Entry, PDB_Code, Method FROM (SELECT k.* FROM (SELECT CAST(o_custkey AS VARCHAR) AS Uniprot_Entry, CAST(o_orderkey AS VARCHAR) AS PDB_Code, o_orderpriority AS Method FROM orders) k JOIN customer ON Uniprot_Entry = CAST(c_custkey AS VARCHAR) WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'AF-' || CAST(c_custkey AS VARCHAR) || '-F1-model_v6', 'Predicted' FROM customer WHERE c_mktsegment = 'BUILDING')""")(lambda s, d: tb.resolve_input(si.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("Uniprot_Entry"), F.when(F.col("c_mktsegment") == "BUILDING", "AF").alias("PDB_Code")), si.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("Uniprot_Entry"), F.col("o_orderkey").cast("string").alias("PDB_Code"), F.col("o_orderpriority").alias("Method"))))
query("s07_json_maps", "SELECT event_id, unnest(json_keys(props)) AS k, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS DOUBLE) AS v FROM events")(lambda s, d: si.table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v")).withColumn("v", F.col("v").try_cast("double")))
query("s07_confidence_rows", "SELECT CAST(event_id AS VARCHAR) AS PDB_Code, 'A' AS Chain, CAST(user_id AS INT) AS Resid, round(value, 4) AS PLDDT FROM events")(lambda s, d: tb.confidence_rows(si.table(s, d, "events").select(F.to_json(F.create_map(F.col("event_id").cast("string"), F.create_map(F.concat(F.lit("A_"), F.col("user_id").cast("string")), F.round("value", 4).cast("string")))).alias("json"))))
query("s08_ontology_edges", "SELECT DISTINCT e.go_id, name, uniprot FROM edges e JOIN terms USING (go_id)", E)(lambda s, d: tb.ontology_edges(tb.ontology_json(jn.terms_of(si.edges(s, d), si.terms(s, d))).select(F.col("value").alias("json"))))
query("s12_proteome", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")(lambda s, d: tb.proteome(si.table(s, d, "customer").withColumns({"proteome": F.col("c_nationkey").cast("string"), "reviewed": F.col("c_acctbal") > 0}), "3", True).select("c_custkey"))
query("f04_regex_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INT) AS n FROM documents")(lambda s, d: si.table(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias("n")))
query("f05_fixed_width", "SELECT doc_id, i - 1 AS line, trim(substr(t, 13, 4)) AS name, try_cast(trim(substr(t, 31, 8)) AS DOUBLE) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")(lambda s, d: si.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", F.col("line").cast("long").alias("line"), fn.trimmed(F.substring("t", 13, 4)).alias("name"), fn.decimal_number(fn.trimmed(F.substring("t", 31, 8))).alias("x")))
LETTERS = "CASE letter " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(fn.STRUCTURE_LETTERS)) + " END"
query("f09_structure_number", f"SELECT event_id, {LETTERS} AS code FROM residues", R)(lambda s, d: si.residues(s, d).select("event_id", fn.structure_number(F.col("letter")).alias("code")))
query("k06_error_records", f"SELECT '{tb.ERROR_LINE}' || chr(10) || event_type || ' calc error' || chr(10) || CAST(user_id AS VARCHAR) || chr(10) || coalesce(props, '') AS value FROM events WHERE event_type = 'error'")(lambda s, d: tb.error_lines(si.table(s, d, "events").filter("event_type = 'error'").select(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("error"))))
query("f06_parse_vector", "SELECT vec_id, round(aev[2], 6) AS second, len(aev) AS width FROM vectors", V)(lambda s, d: si.vectors(s, d).withColumn("aev", fn.parse_vector(F.to_json("aev"))).select("vec_id", F.round(F.col("aev")[1], 6).alias("second"), F.size("aev").cast("long").alias("width")))
query("f10_vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(aev, lambda x: x * x))), 6) AS norm FROM vectors", V)(lambda s, d: si.vectors(s, d).select("vec_id", F.round(fn.norm(F.col("aev")), 6).alias("norm")))
query("f13_vector_columns", "SELECT vec_id, i - 1 AS pos, round(x, 6) AS x FROM (SELECT vec_id, unnest(aev) AS x, generate_subscripts(aev, 1) AS i FROM vectors)", V)(lambda s, d: si.vectors(s, d).select("vec_id", F.posexplode("aev").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")))
query("f14_confidence_band", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN v >= 0 AND v <= 100 THEN CAST(CAST(greatest(ceil(v / 5), 1) - 1 AS INT) * 5 AS VARCHAR) || '-' || CAST(CAST(greatest(ceil(v / 5), 1) AS INT) * 5 AS VARCHAR) ELSE 'nan' END AS band FROM (SELECT CAST(l_quantity * 2.5 AS DOUBLE) AS v FROM lineitem)) GROUP BY 1")(lambda s, d: si.table(s, d, "lineitem").select(fn.confidence_band(F.col("l_quantity").cast("double") * 2.5).alias("band")).groupBy("band").agg(F.count("*").alias("n")))

# names, letters and coordinates
query("f01_entry_names", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS entry FROM orders")(lambda s, d: si.table(s, d, "orders").select("o_orderkey", fn.entry_of(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "_relaxed").when(F.col("o_orderstatus") == "O", "-alt2B_relaxed.pdb").otherwise(".pdb"))).alias("entry")))
query("f03_split_lists", "SELECT p_partkey, x, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_type || ' ', ' ')) AS x FROM part) WHERE x <> '' GROUP BY ALL")(lambda s, d: si.table(s, d, "part").select("p_partkey", F.explode(fn.split_list(F.concat("p_type", F.lit(" ")), " ")).alias("x")).groupBy("p_partkey", "x").agg(F.count("*").alias("n")))
ONE = "CASE resname " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.ONE_LETTER.items()) + " ELSE 'X' END"
query("f07_one_letter", f"SELECT structure, serial, {ONE} AS letter, CASE WHEN {ONE} IN ('K', 'H', 'R') THEN 1 WHEN {ONE} IN ('D', 'E') THEN -1 ELSE 0 END AS charge FROM atoms", A)(lambda s, d: si.atoms(s, d).select("structure", "serial", fn.one_letter(F.col("resname")).alias("letter")).withColumn("charge", fn.charge(F.col("letter"))))
query("f11_affine", "SELECT structure, serial, round(1 - y, 6) AS x, round(x + 2, 6) AS y, round(z + 3, 6) AS z FROM atoms", A)(lambda s, d: si.atoms(s, d).select("structure", "serial", *[F.round(c, 6).alias(n) for c, n in zip(fn.affine(F.array(*[F.lit(float(x)) for x in (0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3)]), [F.col("x"), F.col("y"), F.col("z")]), "xyz", strict=True)]))
query("f12_minimum_without_nan", "SELECT l_suppkey, min(CASE WHEN l_tax > 0.02 THEN l_tax END) AS low FROM lineitem GROUP BY 1")(lambda s, d: fn.nan_to_null(si.table(s, d, "lineitem").select("l_suppkey", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).otherwise(float("nan")).alias("x"))).groupBy("l_suppkey").agg(F.min("x").alias("low")))
on_measures("f15_chain_residue", "SELECT Chain || '_' || CAST(Resid AS VARCHAR) AS colour, count(*) AS n FROM measures GROUP BY 1", lambda m: m.select(fn.chain_residue(F.col("Chain"), F.col("Resid")).alias("colour")).groupBy("colour").agg(F.count("*").alias("n")))
query("f19_clash_text", "SELECT p.serial, p.chain || '/' || p.resname || p.resid || ':' || p.name || ' <-> ' || q.chain || '/' || q.resname || q.resid || ':' || q.name AS pair FROM atoms p JOIN atoms q ON q.serial = p.serial + 1", A)(lambda s, d: (lambda a: a.select(*[F.col(c).alias(f"p_{c}") for c in a.columns]).join(a.select(*[F.col(c).alias(f"q_{c}") for c in a.columns]), F.col("q_serial") == F.col("p_serial") + 1).select(F.col("p_serial").alias("serial"), fn.clash_text("p_", "q_").alias("pair")))(si.atoms(s, d).select("serial", "chain", "resname", "resid", "name")))
on_measures("p11_drop_absent", "SELECT Uniprot_Entry, Resid, propka, sasa FROM measures", lambda m: (lambda left: left[0].select(*KEY, *left[1]))(fl.drop_sparse(m.withColumn("frustration", F.lit(None).cast("double")), ["propka", "sasa", "frustration"], 1.0)))
on_measures("p21_measured_chains", "SELECT PDB_Code, Chain, Resid, sasa FROM measures LEFT JOIN orders ON PDB_Code = CAST(o_orderkey AS VARCHAR) WHERE o_orderkey IS NULL OR o_orderstatus = 'P' OR Chain = o_orderstatus", lambda m: m)
QUERIES["p21_measured_chains"] = lambda s, d: cu.measured_chains(si.measures(s, d).withColumn("Chains", F.lit("F/O")), si.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("structure"), F.when(F.col("o_orderstatus") == "P", "O/F").otherwise(F.col("o_orderstatus")).alias("measured_chains"))).select("PDB_Code", "Chain", "Resid", "sasa")
query("p27_models", "SELECT structure, serial FROM atoms WHERE floor(serial / 3) % 4 < 2", A)(lambda s, d: cu.pick_models(si.atoms(s, d).withColumn("model", (F.floor(F.col("serial") / 3) % 4 + 1).cast("int")), "all", most=2).select("structure", "serial"))
query("p29_scalars_only", "SELECT vec_id, Uniprot_Entry, Resid FROM vectors", V)(lambda s, d: fl.drop_vectors(si.vectors(s, d)).select("vec_id", "Uniprot_Entry", "Resid"))
query("j17_restore_columns", "SELECT serial, name, round(beta, 6) AS beta FROM atoms", A)(lambda s, d: jn.restore_columns(si.atoms(s, d), si.atoms(s, d).select("serial", "beta"), ["serial"], ["beta"]).select("serial", "name", F.round("beta", 6).alias("beta")))

# statistics
SELECTED = "(SELECT Uniprot_Entry AS uniprot, coalesce(max(CASE WHEN sasa > 50000 AND propka BETWEEN 40 AND 45 THEN 1 ELSE 0 END), 0) AS s FROM measures GROUP BY 1)"
G08 = f"SELECT go_id, CAST(sum(s) AS BIGINT) AS a, CAST(count(*) - sum(s) AS BIGINT) AS b, CAST(any_value(ns) - sum(s) AS BIGINT) AS c, CAST(any_value(n) - any_value(ns) - count(*) + sum(s) AS BIGINT) AS d FROM edges JOIN (SELECT *, sum(s) OVER () AS ns, count(*) OVER () AS n FROM {SELECTED}) f USING (uniprot) GROUP BY 1"
LCH = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
TAIL = "least(1, list_sum(list_transform(generate_series(a, least(a + b, a + c)), lambda x: exp(" + LCH.format(n="(a + b)", k="x") + " + " + LCH.format(n="(c + d)", k="(a + c - x)") + " - (" + LCH.format(n="(a + b + c + d)", k="(a + c)") + ")))))"


def _box():
    return (F.col("sasa") > 50000) & F.col("propka").between(40, 45)


def _flags(s, d):
    return si.measures(s, d).groupBy(F.col("Uniprot_Entry").alias("uniprot")).agg(F.coalesce(F.max(_box()), F.lit(False)).alias("selected"))


query("g08_contingency", G08, M, E)(lambda s, d: st.contingency(si.edges(s, d), _flags(s, d)))
query("m01_fisher", f"SELECT go_id, round({TAIL}, 6) AS p FROM ({G08})", M, E)(lambda s, d: st.fisher_greater(st.contingency(si.edges(s, d), _flags(s, d))).select("go_id", F.round("p", 6).alias("p")))
query("m02_enrichment", f"SELECT go_id, name, round(p, 6) AS p, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS fdr, a || '/' || (a + c) AS in_region, b || '/' || (b + d) AS in_background FROM (SELECT *, row_number() OVER (ORDER BY p, go_id) AS i, count(*) OVER () AS m FROM (SELECT *, {TAIL} AS p FROM ({G08}) WHERE a + b >= 1)) LEFT JOIN terms USING (go_id)", M, E)(lambda s, d: st.enrichment(si.measures(s, d), si.edges(s, d), si.terms(s, d), _box()))
on_measures("m03_outliers", f"SELECT {SHORT} FROM measures JOIN (SELECT Uniprot_Entry, Resid, quantile_cont(sasa, 0.25) AS a, quantile_cont(sasa, 0.75) AS b FROM measures GROUP BY ALL) USING (Uniprot_Entry, Resid) WHERE sasa < a - 0.6 * (b - a) OR sasa > b + 0.6 * (b - a)", lambda m: short(st.outliers(m, KEY, "sasa", 0.6)))
HOT = "(SELECT PDB_Code, Chain, Resid, sasa, CASE WHEN Resid <= 3 THEN 'hot' ELSE Uniprot_Entry END AS g FROM measures)"
on_measures("m03_outliers_by_ranks", f"SELECT g, PDB_Code, Chain, Resid, sasa FROM {HOT} JOIN (SELECT g, quantile_cont(sasa, 0.25) AS a, quantile_cont(sasa, 0.75) AS b FROM {HOT} GROUP BY g) USING (g) WHERE sasa < a - 0.6 * (b - a) OR sasa > b + 0.6 * (b - a)", lambda m: st.outliers(m.withColumn("g", F.when(F.col("Resid") <= 3, "hot").otherwise(F.col("Uniprot_Entry"))), ["g"], "sasa", 0.6, by_ranks=True).select("g", "PDB_Code", "Chain", "Resid", "sasa"))
on_measures("m04_clean", "SELECT propka, seqcharge, count(*) AS n FROM (SELECT DISTINCT propka, seqcharge FROM measures WHERE propka IS NOT NULL) GROUP BY ALL", lambda m: st.clean(m, ["propka", "seqcharge"]).groupBy("propka", "seqcharge").agg(F.count("*").alias("n")))
on_measures("m05_normalise", "SELECT PDB_Code, Resid, round((sasa - avg(sasa) OVER ()) / stddev_pop(sasa) OVER (), 6) AS sasa FROM measures", lambda m: st.normalise(m, ["sasa"]).select("PDB_Code", "Resid", F.round("sasa", 6).alias("sasa")))


@query("m06_pca", None)
def m06(s, d):
    v = si.vectors(s, d)
    return st.apply_pca(v, "aev", st.fit_pca(v, "aev", 5)).select("vec_id", F.transform("pc", lambda x: F.round(F.abs(x), 6)).alias("pc"))


@query("m07_vif", None)
def m07(s, d):
    m = si.measures(s, d).withColumn("copy", F.col("sasa") * 2 + F.col("seqcharge"))
    kept = co.drop_collinear(m.dropna(subset=FEATURES), [*FEATURES, "copy"])
    return m.dropna(subset=FEATURES).agg(*[F.round(F.avg(f), 4).alias(f) for f in kept])


@query("m07_vif_vectors", None)
def m07_vectors(s, d):
    """All components of the vectors, and three columns made of them: a sum, a near copy and one of zeros."""
    v = si.vectors(s, d)
    more = {"both": F.col("aev")[0] + F.col("aev")[1], "near": F.col("aev")[2] + F.col("aev")[3] / 20, "none": F.lit(0.0)}
    return co.inflation_table(v.withColumns(more), ["aev", *more])


@query("m09_undersample", None)
def m09(s, d):
    got = us.undersample(si.vectors(s, d), ["aev"], "vec_id", k=8)
    return got["common_kept"].withColumn("kind", F.lit("common")).unionByName(got["outliers_kept"].withColumn("kind", F.lit("outlier"))).select("vec_id", "kind")


@query("m10_learning_table", "SELECT Uniprot_Entry, Resid, round(avg(sasa), 6) AS sasa_avg, round(max(propka), 6) AS propka_max, CAST(CASE min(class) WHEN 'A' THEN 3 WHEN 'N' THEN 4 ELSE 5 END AS TINYINT) AS y FROM measures GROUP BY 1, 2", M)
def m10(s, d):
    t = si.measures(s, d).groupBy(*KEY).agg(F.round(F.avg("sasa"), 6).alias("sasa_avg"), F.round(F.max("propka"), 6).alias("propka_max"), F.max("depth").alias("depth_max"), F.min("class").alias("class"))
    return le.learning_table(t, ["sasa", "propka"])[0]


@query("f18_class_codes", "SELECT c AS class, CAST(CASE WHEN c IS NULL THEN 9 WHEN c = 'N' THEN 8 ELSE CAST(c AS INT) END AS TINYINT) AS y, count(*) AS n FROM (SELECT CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN NULL WHEN l_returnflag = 'N' THEN 'N' ELSE CAST(l_linenumber AS VARCHAR) END AS c FROM lineitem) GROUP BY 1, 2")
def f18(s, d):
    label = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), None).when(F.col("l_returnflag") == "N", "N").otherwise(F.col("l_linenumber").cast("string"))
    t = si.table(s, d, "lineitem").select(label.alias("class"))
    return t.withColumn("y", le.class_number(le.class_codes(t))).groupBy("class", "y").agg(F.count("*").alias("n"))


@query("m12_rmsf", None)
def m12(s, d):
    a = si.atoms(s, d).withColumn("ensemble", F.lit("E")).withColumn("resid", F.col("resid") % 25).withColumn("chain", F.lit("A"))
    return st.rmsf(a.filter("name in ('N', 'CA', 'C', 'O')"), a.filter("name = 'NZ'")).withColumn("rmsf", F.round("rmsf", 6))


@query("m12_rmsf_ensembles", None)
def m12_ensembles(s, d):
    """Ensembles found by their CA atoms; whole structures laid on the first, and each residue by itself."""
    a = si.atoms(s, d).withColumns({"protein": F.lit("P"), "resid": F.col("resid") % 25, "chain": F.lit("A")})
    modes = [st.ensemble_rmsf(a, "NZ", align).withColumn("align", F.lit(align)) for align in ("backbone", "local")]
    return modes[0].unionByName(modes[1]).withColumn("rmsf", F.round("rmsf", 6))


REACH = "reach AS (SELECT *, 1.4 + CASE element WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'S' THEN 1.8 ELSE 1.7 END AS r FROM atoms)"
POINTS = "points AS (SELECT cos(t * i) * sqrt(1 - h * h) AS px, sin(t * i) * sqrt(1 - h * h) AS py, h AS pz FROM (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / 960 AS h, pi() * (3 - sqrt(5)) AS t FROM range(960) n(i)))"


FREE = """(SELECT a.structure, a.chain, a.resid, a.r, sum(CASE WHEN EXISTS (SELECT 1 FROM reach b WHERE b.structure = a.structure AND b.serial <> a.serial {b}
 AND (a.x + p.px * a.r - b.x) ** 2 + (a.y + p.py * a.r - b.y) ** 2 + (a.z + p.pz * a.r - b.z) ** 2 < b.r * b.r) THEN 0 ELSE 1 END) AS free
 FROM reach a, points p WHERE a.resname IN ({names}) AND a.name NOT IN ('N', 'CA', 'C', 'O') {a} GROUP BY a.structure, a.serial, a.chain, a.resid, a.r)"""
AREA = "round(sum(CASE WHEN free >= {t} * 960 THEN 4 * pi() * r * r * free / 960 ELSE 0 END), 4) AS sasa"


@query("m14_accessible_area", f"SELECT structure, chain, resid, {AREA.format(t=0)} FROM {FREE.format(a='', b='', names=chr(39) + 'LYS' + chr(39))} GROUP BY ALL", A, REACH, POINTS)
def m14(s, d):
    a = si.atoms(s, d)
    return st.accessible_area(a.filter("resname = 'LYS' and name not in ('N', 'CA', 'C', 'O')"), a).withColumn("sasa", F.round("sasa", 4))


@query("m14_exposed_area", f"SELECT structure, chain, resid, {AREA.format(t=0.9)} FROM {FREE.format(a='AND a.name <> ' + chr(39) + 'CE' + chr(39), b='AND b.name <> ' + chr(39) + 'CE' + chr(39), names=chr(39) + 'LYS' + chr(39) + ', ' + chr(39) + 'GLU' + chr(39))} GROUP BY ALL", A, REACH, POINTS)
def m14_exposed(s, d):
    """Only atoms of which nine tenths are exposed; atoms of one name stand for those that occlude nothing."""
    a = si.atoms(s, d)
    side = a.filter("resname in ('LYS', 'GLU') and name not in ('N', 'CA', 'C', 'O')")
    return st.accessible_area(side, a, threshold=0.9, ignore=("CE",)).withColumn("sasa", F.round("sasa", 4))


# plot tables
on_measures("v01_histogram", "SELECT CAST(b AS BIGINT) AS bin, round(lo + b * 5.0, 6) AS left_edge, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 5.0), 9) AS density FROM (SELECT lo, bins, CASE WHEN propka = lo + bins * 5.0 THEN bins - 1 ELSE floor((propka - lo) / 5.0) END AS b FROM measures, (SELECT min(propka) AS lo, ceil((max(propka) - min(propka)) / 5.0 - 1e-12) - 1 AS bins FROM measures) WHERE propka IS NOT NULL) WHERE b >= 0 AND b < bins GROUP BY b, lo", lambda m: pl.histogram(m, "propka", 5.0).select("bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 9).alias("density")))
on_measures("v04_count_histogram", "SELECT Chain AS colour, CAST(b AS BIGINT) AS bin, count(*) AS n FROM (SELECT Chain, bins, CASE WHEN propka = lo + bins * 5.0 THEN bins - 1 ELSE floor((propka - lo) / 5.0) END AS b FROM measures, (SELECT min(propka) AS lo, ceil((max(propka) - min(propka)) / 5.0 - 1e-12) - 1 AS bins FROM measures) WHERE propka IS NOT NULL) WHERE b < bins GROUP BY ALL", lambda m: pl.histogram(m, "propka", 5.0, pl.colours("chain")).select("colour", "bin", "n"))
on_measures("v02_density", "SELECT i AS point, round(sum(exp(-(((lo + (hi - lo) * i / 49 - propka) / 2.0) ** 2) / 2)) / (any_value(n) * 2.0 * 2.5066282746310002), 9) AS density FROM measures, (SELECT min(propka) AS lo, max(propka) AS hi, count(propka) AS n FROM measures), (SELECT unnest(generate_series(0, 49)) AS i) WHERE propka IS NOT NULL GROUP BY 1", lambda m: pl.density(m, "propka", 2.0, 50, cells=4096).select(F.round((F.col("at") - 1) / (44 / 49)).cast("long").alias("point"), F.round("density", 9).alias("density")))
on_measures("v02_density_by_rule", "SELECT i AS point, round(sum(exp(-(((lo + (hi - lo) * i / 49 - propka) / h) ** 2) / 2)) / (any_value(n) * any_value(h) * 2.5066282746310002), 6) AS density FROM measures, (SELECT min(propka) AS lo, max(propka) AS hi, count(propka) AS n, stddev_samp(propka) * count(propka) ** -0.2 AS h FROM measures), (SELECT unnest(generate_series(0, 49)) AS i) WHERE propka IS NOT NULL GROUP BY 1", lambda m: pl.density(m, "propka", None, 50, cells=4096).select(F.round((F.col("at") - 1) / (44 / 49)).cast("long").alias("point"), F.round("density", 6).alias("density")))
on_measures("v03_violins", "SELECT f AS feature, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS high FROM (SELECT 'sasa' AS f, sasa AS v FROM measures UNION ALL SELECT 'depth', depth FROM measures) GROUP BY 1", lambda m: _rounded(pl.violins(m, ["sasa", "depth"])))
on_measures("v05_scatter", "SELECT Uniprot_Entry, Resid, sasa, propka FROM measures WHERE propka BETWEEN 1 AND 30 AND sasa BETWEEN 0 AND 40000", lambda m: pl.scatter(m, KEY, ["sasa", "propka"], {"propka": (1, 30), "sasa": (0, 40000)}))
on_measures("v06_pick_list", "SELECT 'All' AS value UNION ALL SELECT DISTINCT CAST(Resid AS VARCHAR) FROM measures WHERE Uniprot_Entry = 'P2'", lambda m: pl.pick_list(fl.subset(m, proteins=("P2",)), "Resid"))


# the reference's whole reduction: filters, bounds, one aggregation
@query("aggregation_pipeline", f"SELECT {_r6(['propka_min', 'propka_max', 'sasa_min', 'sasa_max', 'depth_min', 'depth_max', 'seqcharge_min', 'seqcharge_max'])} FROM (SELECT Uniprot_Entry, Resid, {STAT_SQL}, {CLASS_SQL} FROM (SELECT * FROM measures WHERE propka IS NOT NULL AND depth BETWEEN 0 AND 20) GROUP BY 1, 2)", M)
def aggregation_pipeline(s, d):
    m = fl.drop_missing(si.measures(s, d), FEATURES)
    return _select("minmax")(fl.within_bounds(m))
