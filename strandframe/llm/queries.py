"""One query for each operator: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .ann import nearest
from .balance import mix
from .bytenet import held_out, score_quality
from .collocations import collocations
from .common import table
from .debruijn import dedup_spans
from .decontaminate import decontaminate
from .langid import identify
from .lines import drop_boilerplate
from .minhash import label_components
from .ring import assign
from .secrets import KINDS, scan_secrets
from .suffix import dedup_substrings

SHARDS = 24
SITES = 8


def hex_sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), hex_sha256(F.array_join("items", ",").cast("binary")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    clean = drop_boilerplate(docs, "source", sites=SITES)
    return clean.select("doc_id", "n_lines", "n_removed", hex_sha256(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS[:3]), hex_sha256(listed(base).cast("binary")).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assign(docs, F.col("doc_id"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held & F.col("doc_id").isNotNull(), ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), F.col("lang"), least=10, share=50, most=2000)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_near_dedup,
        op3_substring_dedup,
        op4_line_dedup,
        op5_secret_scan,
        op6_nearest,
        op7_sharding,
        op8_mixing,
        op9_quality,
        op10_span_dedup,
        op11_language_id,
        op12_collocations,
        op13_token_alignment,
    )
}

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op2_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, {_WORDS}), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    "op10_span_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM x JOIN f USING (k) WHERE doc_id > first),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT p.doc_id, count(*) AS n_words, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (g.j IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase, least(10, len(w)) AS n
      FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, array_to_string(w[i : i + n - 1], ' ') AS phrase, n, i
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, phrase FROM x WHERE phrase IN (SELECT phrase FROM p)),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h JOIN p USING (phrase, n) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}),
k AS (SELECT doc_id, i, line, trim(line, ' ') IN (SELECT line FROM b) AS gone FROM l)
SELECT doc_id, count(i) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
    "op12_collocations": rf"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]') AS pieces, row_number() OVER () AS d FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
x AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM x, (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
u AS (SELECT c.*, unnest(generate_series(1, k - 1)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.k, cut, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * u.a * u.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1 : cut], ' ') AND l.k = cut JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ') AND r.k = u.k - cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, a FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
}
