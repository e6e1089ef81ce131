"""The registered queries, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import codes, names
from sigloom.operators import anchors, cluster, dedup, detect, generate, hamming, sampling, study
from sigloom.operators.storage import shared_dir
from sigloom.plans.projections import DOC_SQL, OBS_SQL, app, doc_codes, doc_strings, documents, library, observations
from sigloom.sources import pack, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_D = "(bit_count(xor(a.hi, l.hi))::INT + bit_count(xor(a.lo, l.lo))::INT)"


def _near(radius: int) -> str:
    return f"near AS (SELECT a.qid, l.pid, {_D} AS distance FROM app a, lib l WHERE {_D} <= {radius})"


# -- Hamming joins ----------------------------------------------------------------------


@register("hamming_brute_r12", f"{DOC_SQL}, {_near(12)} SELECT qid, pid, distance FROM near")
def hamming_brute_r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.brute_join(app(spark, sf_dir), library(spark, sf_dir), 12)


@register("hamming_mih_r4", f"{DOC_SQL}, {_near(4)} SELECT qid, pid, distance FROM near")
def hamming_mih_r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.hamming_join(app(spark, sf_dir), library(spark, sf_dir), 4)


@register("hamming_mih_r12", f"{DOC_SQL}, {_near(12)} SELECT qid, pid, distance FROM near")
def hamming_mih_r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.hamming_join(app(spark, sf_dir), library(spark, sf_dir), 12)


@register("hamming_exact", f"{DOC_SQL}, {_near(0)} SELECT qid, pid, distance FROM near")
def hamming_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.hamming_join(app(spark, sf_dir), library(spark, sf_dir), 0)


@register("mih_ids_only", f"{DOC_SQL}, {_near(8)} SELECT qid, pid FROM near")
def mih_ids_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.hamming_join(app(spark, sf_dir), library(spark, sf_dir), 8).select("qid", "pid")


_BEST = "SELECT qid, pid, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS n FROM near) WHERE n = 1"


@register("best_match", f"{DOC_SQL}, {_near(12)} {_BEST}")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.best_join(app(spark, sf_dir), library(spark, sf_dir), 12)


@register("index_cardinality", f"{DOC_SQL} SELECT count(*) AS entries, count(DISTINCT (hi, lo)) AS codes FROM lib")
def index_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).agg(F.count("*").alias("entries"), F.count_distinct("hi", "lo").alias("codes"))


@register("band_layouts", "SELECT m::INT AS m, k::INT AS band, (k * (128 // m) + least(k, 128 % m))::INT AS shift, (128 // m + (k < 128 % m)::INT)::INT AS width FROM range(1, 17) t(m), range(0, 17) s(k) WHERE k < m")
def band_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(m, k, shift, width) for m in range(1, 17) for k, (shift, width) in enumerate(codes.bands(m))]
    return spark.createDataFrame(rows, "m int, band int, shift int, width int")


@register("suggested_bands", "SELECT n, CASE WHEN n < 2 THEN 6 ELSE least(16, greatest(6, 128 // greatest(1, ceil(log2(n))::INT))) END::INT AS m FROM (VALUES (0::BIGINT), (1), (2), (1000), (1000000), (50000000)) t(n)")
def suggested_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, codes.suggest_m(n)) for n in (0, 1, 2, 1000, 1_000_000, 50_000_000)], "n long, m int")


_TABLES, _PREFIX, _SEED = 6, 18, 0xA9C1D


def _prefix_sql(order: list[int]) -> str:
    bit = lambda b: f"(({'hi' if b >= 64 else 'lo'} >> {b % 64}) & 1)"
    return " + ".join(f"{bit(order[codes.BITS - _PREFIX + k])} * {1 << k}" for k in range(_PREFIX))


_ORDERS = codes.permutations(_TABLES, _SEED)
_PREFIXES = ", ".join(f"{{'t': {k}, 'p': {_prefix_sql(order)}}}" for k, order in enumerate(_ORDERS))
_MASKS = ", ".join(map(str, codes.flips(_PREFIX, 1)))
_BANDS_SQL = f"""{DOC_SQL}, lp AS MATERIALIZED (SELECT pid, hi, lo, b.t AS t, b.p AS p FROM (SELECT pid, hi, lo, unnest([{_PREFIXES}]) AS b FROM lib)),
ap AS MATERIALIZED (SELECT qid, hi, lo, b.t AS t, b.p AS p FROM (SELECT qid, hi, lo, unnest([{_PREFIXES}]) AS b FROM app))"""
_FOUND = f"SELECT a.qid, l.pid, min({_D}) AS distance FROM ap a JOIN lp l ON a.t = l.t AND a.p = l.p WHERE {_D} <= 8 GROUP BY a.qid, l.pid"


def _store(spark: SparkSession, sf_dir: str) -> hamming.BandStore:
    return hamming.BandStore(library(spark, sf_dir).select("pid", "hi", "lo"), _TABLES, _PREFIX, _SEED)


@register("lsh_band_query", f"{_BANDS_SQL} SELECT qid, pid FROM ({_FOUND})")
def lsh_band_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).query(app(spark, sf_dir), 8)


@register("lsh_query_best", f"{_BANDS_SQL} {_FOUND}")
def lsh_query_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).query_best(app(spark, sf_dir), 8)


@register("lsh_probe1", f"{_BANDS_SQL}, aq AS (SELECT qid, hi, lo, t, xor(p, m) AS p FROM ap, (SELECT unnest([{_MASKS}]) AS m)) {_FOUND.replace('FROM ap a', 'FROM aq a')}")
def lsh_probe1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).query_best(app(spark, sf_dir), 8, probe=1)


@register("prefix_directory", f'{_BANDS_SQL} SELECT t AS "table", p AS prefix, count(*) AS entries, coalesce(sum(count(*)) OVER (PARTITION BY t ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM lp GROUP BY t, p')
def prefix_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).directory()


@register("code_hex", f"{DOC_SQL} SELECT doc_id, lower(to_hex(hi::HUGEINT + (CASE WHEN hi < 0 THEN 18446744073709551616 ELSE 0 END)::HUGEINT)) AS hi_hex FROM doc")
def code_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = doc_codes(spark, sf_dir).withColumn("h", codes.hex_of_lanes(F.col("hi"), F.col("lo")))
    hi, _ = codes.lanes_of_hex(F.col("h"))
    return there.select("doc_id", F.lower(F.hex(hi)).alias("hi_hex"))


# -- Building a library -----------------------------------------------------------------

_KEPT = "kept AS (SELECT * FROM obs WHERE sig_stamp = 'now' AND instructions >= 20)"
_ENTRIES = "entries AS (SELECT coord, hi, lo, arg_min(fqcn, (seq, fqcn, instructions)) AS fqcn, arg_min(instructions, (seq, fqcn, instructions)) AS instructions, min(seq) AS seq, list_sort(list(DISTINCT version)) AS versions FROM kept GROUP BY coord, hi, lo)"
_ORDER = "vers AS (SELECT coord, version, row_number() OVER (PARTITION BY coord ORDER BY version::BIGINT) - 1 AS pos FROM (SELECT DISTINCT coord, version FROM obs WHERE sig_stamp = 'now'))"
_RANGES = """hits AS (SELECT e.coord, e.hi, e.lo, e.v AS version, pos FROM (SELECT coord, hi, lo, unnest(versions) AS v FROM entries) e JOIN vers ON vers.coord = e.coord AND vers.version = e.v),
islands AS (SELECT coord, hi, lo, pos - row_number() OVER (PARTITION BY coord, hi, lo ORDER BY pos) AS island, pos, version FROM hits),
runs AS (SELECT coord, hi, lo, island, min(pos) AS low, CASE WHEN min(pos) = max(pos) THEN min_by(version, pos) ELSE min_by(version, pos) || '..' || max_by(version, pos) END AS text FROM islands GROUP BY coord, hi, lo, island),
ranges AS (SELECT coord, hi, lo, string_agg(text, ',' ORDER BY low) AS ranges FROM runs GROUP BY coord, hi, lo)"""
_BUILD = f"{OBS_SQL}, {_KEPT}, {_ENTRIES}, {_ORDER}, {_RANGES}"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.large_enough(dedup.current(observations(spark, sf_dir), "now"))


@register("dedup_by_signature", f"{OBS_SQL}, {_KEPT}, {_ENTRIES} SELECT coord, hi || lo AS sig, fqcn, instructions, array_to_string(versions, ',') AS versions FROM entries")
def dedup_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.dedup_by_signature(_kept(spark, sf_dir))
    return out.select("coord", codes.hex_of_lanes(F.col("hi"), F.col("lo")).alias("sig"), "fqcn", "instructions", F.array_join("versions", ",").alias("versions"))


@register("version_order", f"{OBS_SQL}, {_ORDER} SELECT coord, version, pos::INT AS pos FROM vers")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.version_order(dedup.current(observations(spark, sf_dir), "now"))


@register("version_ranges", f"{_BUILD} SELECT coord, hi || lo AS sig, ranges FROM ranges")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.build(observations(spark, sf_dir), "now")
    return out.select("coord", codes.hex_of_lanes(F.col("hi"), F.col("lo")).alias("sig"), F.array_join("ranges", ",").alias("ranges"))


@register("payload_ids", f"{_BUILD} SELECT row_number() OVER (ORDER BY seq, coord, (hi >= '8')::INT DESC, hi, (lo >= '8')::INT DESC, lo) - 1 AS payload_id, coord, hi || lo AS sig, fqcn FROM entries")
def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.build(observations(spark, sf_dir), "now").select("payload_id", "coord", codes.hex_of_lanes(F.col("hi"), F.col("lo")).alias("sig"), "fqcn")


@register("build_counters", f"{OBS_SQL}, cur AS (SELECT * FROM obs WHERE sig_stamp = 'now'), {_KEPT} SELECT count(*) AS classes_seen, count(*) FILTER (instructions < 20) AS below_min, count(*) FILTER (instructions >= 20) AS kept, (SELECT count(DISTINCT (coord, hi, lo)) FROM kept) AS entries, round(count(*) FILTER (instructions >= 20) / (SELECT count(DISTINCT (coord, hi, lo)) FROM kept), 9) AS dedup_factor FROM cur")
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.counters(dedup.current(observations(spark, sf_dir), "now"))
    return out.withColumn("dedup_factor", F.round("dedup_factor", 9))


@register("stale_counters", f"{OBS_SQL} SELECT count(*) FILTER (sig_stamp <> 'now') AS n_stale, count(*) FILTER (sig_stamp = 'now') AS n_current, list_sort(list(DISTINCT coord))[1] AS first_coord, count(DISTINCT coord) AS coords FROM obs")
def stale_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = F.array_sort(F.collect_set("coord"))
    return observations(spark, sf_dir).agg(F.count_if(F.col("sig_stamp") != "now").alias("n_stale"), F.count_if(F.col("sig_stamp") == "now").alias("n_current"), F.get(coords, F.lit(0)).alias("first_coord"), F.size(coords).cast("long").alias("coords"))


@register("pack_roundtrip", f"{_BUILD} SELECT count(*) AS n_entries, count(DISTINCT coord) AS coords, sum(len(string_split(ranges, ',')))::BIGINT AS n_ranges FROM ranges")
def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "pack")
    built = dedup.build(observations(spark, sf_dir), "now").persist()
    pack.write_pack(path, built.select("payload_id", "hi", "lo", "strings"), built.select("payload_id", "coord", "ranges", "fqcn"), "now")
    entries, payloads, _ = pack.read_pack(spark, path, "now")
    built.unpersist()
    return entries.join(payloads, "payload_id").agg(F.count("*").alias("n_entries"), F.count_distinct("coord").alias("coords"), F.sum(F.size("ranges")).alias("n_ranges"))


# -- Strings ------------------------------------------------------------------------------

_USEFUL = "use AS (SELECT doc_id, coord, list_filter(strings, lambda w: NOT regexp_full_match(w, '[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]+')) AS strings FROM dw)"
_ANCHORS = f"""{_USEFUL}, lw AS (SELECT doc_id AS pid, unnest(strings) AS string FROM use WHERE doc_id % 2 = 0),
total AS (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 0),
rare AS (SELECT string, count(*) AS df, ln((n + 1)::DOUBLE / count(*)) / ln((n + 1)::DOUBLE) AS idf FROM lw, total GROUP BY string, n HAVING count(*) <= 8),
shared AS (SELECT q.doc_id AS qid, lw.pid, sum(idf) AS score FROM (SELECT doc_id, unnest(strings) AS string FROM use WHERE doc_id % 2 = 1) q JOIN lw ON lw.string = q.string JOIN rare ON rare.string = q.string GROUP BY q.doc_id, lw.pid),
hits AS (SELECT qid, pid, score FROM shared WHERE round(score, 12) >= 1.0),
besthit AS (SELECT qid, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, pid) AS n FROM hits) WHERE n = 1)"""


def _index(spark: SparkSession, sf_dir: str) -> anchors.AnchorIndex:
    return anchors.AnchorIndex(doc_strings(spark, sf_dir).where("doc_id % 2 = 0").withColumnRenamed("doc_id", "pid"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_strings(spark, sf_dir).where("doc_id % 2 = 1").withColumnRenamed("doc_id", "qid")


@register("useful_strings", f"{DOC_SQL}, {_USEFUL} SELECT doc_id, len(strings)::INT AS n, md5(array_to_string(list_sort(strings), ' ')) AS digest FROM use")
def useful_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = anchors.useful_strings(F.col("strings"))
    return doc_strings(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(F.array_sort(s), " ").cast("binary")).alias("digest"))


@register("anchor_index", f"{DOC_SQL}, {_ANCHORS} SELECT string, df, round(idf, 9) AS idf FROM rare")
def anchor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).strings.select("string", "df", F.round("idf", 9).alias("idf"))


@register("anchor_query", f"{DOC_SQL}, {_ANCHORS} SELECT qid, pid, round(score, 9) AS score FROM hits")
def anchor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).query(_probes(spark, sf_dir)).select("qid", "pid", F.round("score", 9).alias("score"))


@register("anchor_best", f"{DOC_SQL}, {_ANCHORS} SELECT qid, pid, round(score, 9) AS score FROM besthit")
def anchor_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).best(_probes(spark, sf_dir)).select("qid", "pid", F.round("score", 9).alias("score"))


# -- Labels -------------------------------------------------------------------------------

_CASCADE = f"""{DOC_SQL}, {_near(4)}, bestcode AS ({_BEST}), {_ANCHORS},
found AS (SELECT qid, pid AS payload_id, CASE WHEN distance = 0 THEN 1 ELSE 2 END AS tier, distance, 1.0::DOUBLE AS score FROM bestcode
  UNION ALL SELECT qid, pid, 3, -1, score FROM besthit WHERE qid IN (SELECT qid FROM app) AND qid NOT IN (SELECT qid FROM bestcode)),
detected AS (SELECT app.qid, payload_id, tier, distance, score FROM app LEFT JOIN found ON found.qid = app.qid),
payloads AS (SELECT pid, coord, CASE WHEN pid % 3 = 0 THEN []::VARCHAR[] ELSE ['v' || (n_words % 7)::VARCHAR, 'w'] END AS ranges FROM lib)"""


def _detector(spark: SparkSession, sf_dir: str, radius: int = 4) -> detect.Detector:
    lib = library(spark, sf_dir)
    ranges = F.when(F.col("pid") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("v"), (F.col("n_words") % 7).cast("string")), F.lit("w")))
    payloads = lib.select(F.col("pid").alias("payload_id"), "coord", ranges.alias("ranges"), F.concat(F.lit("C"), F.col("pid").cast("string")).alias("fqcn"))
    # The text index counts all library documents, also those without a code.
    strings = doc_strings(spark, sf_dir).where("doc_id % 2 = 0").withColumnRenamed("doc_id", "payload_id")
    return detect.Detector(lib.select(F.col("pid").alias("payload_id"), "hi", "lo"), payloads, radius, strings)


def _detected(spark: SparkSession, sf_dir: str, d: detect.Detector) -> DataFrame:
    return d.detect(app(spark, sf_dir).select("qid", "hi", "lo"), _probes(spark, sf_dir))


@register("detect_cascade", f"{_CASCADE} SELECT qid, payload_id, tier, distance, round(score, 9) AS score FROM detected")
def detect_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, _detector(spark, sf_dir)).withColumn("score", F.round("score", 9))


@register("detect_labels", f"{_CASCADE} SELECT qid, 'library:' || coord || '@' || CASE WHEN len(ranges) = 0 THEN '?' ELSE array_to_string(ranges, ',') END AS label FROM detected LEFT JOIN payloads ON pid = payload_id")
def detect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detector(spark, sf_dir)
    return d.label(_detected(spark, sf_dir, d)).select("qid", "label")


@register("library_report", f"{_CASCADE} SELECT coord, count(*) AS classes, count(*) FILTER (tier = 1) AS exact, count(*) FILTER (tier = 2) AS near, count(*) FILTER (tier = 3) AS by_string FROM detected JOIN payloads ON pid = payload_id GROUP BY coord HAVING count(*) >= 5")
def library_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detector(spark, sf_dir)
    return detect.library_report(d.resolve(_detected(spark, sf_dir, d)))


@register("probe_filter", f"{DOC_SQL} SELECT qid FROM app WHERE hi IS NOT NULL AND n_words >= 20")
def probe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.probes(app(spark, sf_dir).withColumn("instructions", F.col("n_words"))).select("qid")


# -- Clusters -----------------------------------------------------------------------------


def _cluster_sql(radius: int) -> str:
    edge = _D.replace("l.", "b.")
    return f"""{DOC_SQL}, edges AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM doc a JOIN doc b ON a.doc_id <> b.doc_id WHERE {edge} <= {radius}),
reach AS (SELECT doc_id AS idx, doc_id AS stop FROM doc UNION SELECT r.idx, e.v FROM reach r JOIN edges e ON e.u = r.stop)
SELECT idx, min(stop) AS component FROM reach GROUP BY idx"""


@register("cluster_radius4", _cluster_sql(4))
def cluster_radius4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_by_radius(doc_codes(spark, sf_dir).withColumnRenamed("doc_id", "idx"), 4)


@register("cluster_exact", f"{DOC_SQL} SELECT doc_id AS idx, min(doc_id) OVER (PARTITION BY hi, lo) AS component FROM doc")
def cluster_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_by_radius(doc_codes(spark, sf_dir).withColumnRenamed("doc_id", "idx"), 0)


@register("cluster_groups", f"SELECT component, count(*)::INT AS n, array_to_string(list_sort(list(idx)), ',') AS members FROM ({_cluster_sql(12)}) GROUP BY component")
def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.groups(cluster.cluster_by_radius(doc_codes(spark, sf_dir).withColumnRenamed("doc_id", "idx"), 12))
    return out.select("component", F.size("members").alias("n"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


# -- Versions -----------------------------------------------------------------------------

_NAMES_SQL = """SELECT p_brand AS coord, 'v' AS _v, (p_size % 5)::VARCHAR || '.' || (p_partkey % 13)::VARCHAR || CASE p_partkey % 7 WHEN 0 THEN '-alpha1' WHEN 1 THEN '-RC' WHEN 2 THEN '' WHEN 3 THEN '.' || (p_partkey % 11)::VARCHAR WHEN 4 THEN '-m2' WHEN 5 THEN '.10' ELSE '-x' END AS version, min(p_partkey) AS pos FROM part GROUP BY ALL"""
_KEYED = f"""WITH named AS ({_NAMES_SQL}), keyed AS (SELECT coord, version, pos, list_transform(string_split(regexp_extract(version, '^\\d+(\\.\\d+)*'), '.'), lambda x: x::BIGINT) AS key FROM named)"""
_SAMPLE = f"""{_KEYED}, stable AS (SELECT * FROM keyed WHERE NOT regexp_matches(version, '(?i)(alpha|beta|rc|snapshot|dev|preview|-m\\d|eap)')),
latest AS (SELECT coord, version, key FROM (SELECT *, row_number() OVER (PARTITION BY coord, key[1], coalesce(key[2], 0) ORDER BY key DESC, pos) AS n FROM stable) WHERE n = 1),
ranked AS (SELECT coord, version, row_number() OVER (PARTITION BY coord ORDER BY key, key[1:2]) - 1 AS rank, count(*) OVER (PARTITION BY coord) AS n FROM latest)
SELECT coord, version, rank::INT AS rank FROM ranked WHERE n <= 8 OR rank IN (SELECT round_even(i * (n - 1) / 7.0, 0)::BIGINT FROM range(0, 8) t(i))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    tail = F.when(key % 7 == 0, F.lit("-alpha1")).when(key % 7 == 1, F.lit("-RC")).when(key % 7 == 2, F.lit("")).when(key % 7 == 3, F.concat(F.lit("."), (key % 11).cast("string"))).when(key % 7 == 4, F.lit("-m2")).when(key % 7 == 5, F.lit(".10")).otherwise(F.lit("-x"))
    version = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (key % 13).cast("string"), tail)
    return part.groupBy(F.col("p_brand").alias("coord"), version.alias("version")).agg(F.min("p_partkey").alias("pos"))


@register("ver_key_sort", f"{_KEYED} SELECT coord, version, array_to_string(key, '.') AS key, row_number() OVER (PARTITION BY coord ORDER BY key, version)::INT AS rank FROM keyed")
def ver_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = dedup.version_order(_versions(spark, sf_dir))
    return order.select("coord", "version", F.array_join(names.ver_key(F.col("version")).cast("array<string>"), ".").alias("key"), (F.col("pos") + 1).alias("rank"))


@register("prerelease_filter", f"{_KEYED} SELECT coord, version FROM keyed WHERE NOT regexp_matches(version, '(?i)(alpha|beta|rc|snapshot|dev|preview|-m\\d|eap)')")
def prerelease_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).where(~names.is_prerelease(F.col("version"))).select("coord", "version")


@register("sample_versions", _SAMPLE)
def sample_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_versions(_versions(spark, sf_dir))


@register("cache_anti_join", f"{OBS_SQL}, want AS (SELECT DISTINCT coord, version FROM obs), have AS (SELECT DISTINCT coord, version FROM obs WHERE sig_stamp = 'now' AND instructions > 49) SELECT coord, version FROM want ANTI JOIN have USING (coord, version)")
def cache_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    cached = obs.where("instructions > 49").select("coord", "version", "sig_stamp", F.lit(None).cast("string").alias("digest"))
    return sampling.to_fetch(obs.select("coord", "version").distinct(), cached, "now")


_AVAILABLE = "avail AS (SELECT coord || CASE v % 3 WHEN 0 THEN '' WHEN 1 THEN '-jvm' ELSE '-android' END AS coord, version, CASE v % 2 WHEN 0 THEN 'jar' ELSE 'aar' END AS packaging FROM (SELECT *, version::BIGINT AS v FROM vers) WHERE v % 5 <> 0)"


@register("fallback_artifact", f"""{OBS_SQL}, {_ORDER}, {_AVAILABLE}, tries AS (SELECT v.coord, v.version, s.k * 2 + p.k AS rank, v.coord || s.x AS artifact, p.x AS packaging FROM vers v, (VALUES (0, ''), (1, '-jvm'), (2, '-android')) s(k, x), (VALUES (0, 'aar'), (1, 'jar')) p(k, x)),
got AS (SELECT t.coord, t.version, arg_min(t.artifact, t.rank) AS artifact, arg_min(t.packaging, t.rank) AS packaging FROM tries t JOIN avail a ON a.coord = t.artifact AND a.version = t.version AND a.packaging = t.packaging GROUP BY t.coord, t.version)
SELECT v.coord, v.version, artifact, packaging, CASE WHEN artifact IS NULL THEN 'not found' ELSE '' END AS error FROM vers v LEFT JOIN got USING (coord, version)""")
def fallback_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = dedup.version_order(dedup.current(observations(spark, sf_dir), "now")).select("coord", "version")
    v = F.col("version").cast("long")
    tail = F.when(v % 3 == 0, F.lit("")).when(v % 3 == 1, F.lit("-jvm")).otherwise(F.lit("-android"))
    there = want.where(v % 5 != 0).select(F.concat("coord", tail).alias("coord"), "version", F.when(v % 2 == 0, F.lit("jar")).otherwise(F.lit("aar")).alias("packaging"))
    return sampling.first_available(want, there)


# -- Sources and scalars ------------------------------------------------------------------


@register("json_scan", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@register("coord_path", "SELECT p_partkey, replace(split_part(c, ':', 1), '.', '/') || '/' || split_part(c, ':', 2) AS path, replace(replace(split_part(c, ':', 1), '.', '/') || '/' || split_part(c, ':', 2), '/', '__') AS dir FROM (SELECT p_partkey, 'com.' || replace(p_brand, '#', '.') || ':' || replace(p_name, ' ', '-') AS c FROM part)")
def coord_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    coord = F.concat(F.lit("com."), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", names.coord_path(coord).alias("path"), names.coord_dir(coord).alias("dir"))


@register("sha256_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))


@register("catalogue_parse", "SELECT p_partkey::INT AS pos, 'g' || p_size || ':' || replace(p_name, ' ', '-') AS coord, 'maven-central' AS repo FROM part WHERE p_partkey > 0")
def catalogue_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  g"), F.col("p_size").cast("string"), F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("\t maven-central  # note: x"))
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("lineno"), F.when(F.col("p_partkey") == 0, F.lit(" # only a comment")).otherwise(line).alias("line"))
    return readers.parse_catalogue(lines)


_SEED_ROWS = [(k, line.split("#")[0].split()) for k, line in enumerate(readers.SEED.read_text().splitlines(), 1)]


@register("catalogue_seed", "SELECT * FROM (VALUES " + ", ".join(f"('{f[0]}', '{f[1]}', {k})" for k, f in _SEED_ROWS if f) + ") t(coord, repo, pos)")
def catalogue_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load_catalogue(spark)


@register("mapping_parse", "SELECT 'com.x.C' || p_partkey % 500 AS original, arg_max('a.' || p_partkey, p_partkey) AS obfuscated FROM part WHERE p_partkey % 3 = 0 GROUP BY 1")
def mapping_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    line = F.concat(F.lit("com.x.C"), (key % 500).cast("string"), F.lit(" -> a."), key.cast("string"), F.lit(":"))
    line = F.when(key % 3 == 0, line).when(key % 3 == 1, F.concat(F.lit("    int f -> "), key.cast("string"))).otherwise(F.lit("# comment -> x:"))
    return readers.parse_class_mapping(spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("lineno"), line.alias("line")))


@register("mapping_invert", "WITH pairs AS (SELECT 'com.x.C' || p_partkey % 500 AS original, 'a.' || p_partkey % 90 AS obfuscated, p_partkey AS pos FROM part), last AS (SELECT original, arg_max(obfuscated, pos) AS obfuscated, min(pos) AS pos FROM pairs GROUP BY 1) SELECT obfuscated, arg_max(original, pos) AS original FROM last GROUP BY 1")
def mapping_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    line = F.concat(F.lit("com.x.C"), (key % 500).cast("string"), F.lit(" -> a."), (key % 90).cast("string"), F.lit(":"))
    return readers.invert(readers.mapping_in_order(spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("lineno"), line.alias("line"))))


_COORD_SQL = "p_brand || ':' || p_size"


@register("metadata_versions", f"SELECT {_COORD_SQL} AS coord, p_name AS version, (row_number() OVER (PARTITION BY {_COORD_SQL} ORDER BY p_partkey) - 1)::INT AS pos FROM part")
def metadata_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(F.lit("<version>"), x["p_name"], F.lit("</version>")))
    coord = F.concat(F.col("p_brand"), F.lit(":"), F.col("p_size").cast("string"))
    files = part.groupBy(coord.alias("coord")).agg(F.concat(F.lit("<metadata><versioning><versions>"), F.array_join(listed, ""), F.lit("</versions></versioning></metadata>")).alias("value"))
    return readers.list_versions(files)


@register("catalogue_json", "WITH items AS (SELECT p_size || ':' || p_brand AS coord, 'r' || p_partkey % 3 AS repo, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS pos FROM part) SELECT coord, arg_min(repo, pos) AS repo, min(pos)::INT AS pos FROM items GROUP BY coord")
def catalogue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(":"), F.col("p_brand")).alias("coordinate"), F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("repository"))
    files = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_size").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value"))
    return readers.parse_catalogue_json(files)


@register("names_and_times", "SELECT p_partkey, split_part(p_name, ' ', 1) || '-' || p_size || '.sigs.json' AS file, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type || '.' || p_brand END AS fqcn, strftime(make_timestamp(p_partkey::BIGINT * 86461000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM part")
def names_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    coord = F.concat(F.lit("g:"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
    package = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_type"))
    return part.select("p_partkey", names.sigs_file(coord, F.col("p_size").cast("string")).alias("file"), names.fqcn(package, F.col("p_brand")).alias("fqcn"), names.iso_utc(F.timestamp_micros(F.col("p_partkey").cast("long") * 86461000000)).alias("at"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("sigs_roundtrip", f"{OBS_SQL} SELECT coord, count(*) AS classes, count(DISTINCT version) AS versions, count(DISTINCT (hi, lo)) AS codes, sum(instructions)::BIGINT AS instructions, string_agg(DISTINCT sig_stamp, ',' ORDER BY sig_stamp) AS stamps FROM obs GROUP BY coord")
def sigs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as cached files and read again."""
    path, none = _fresh(spark, "sigs"), F.lit(None).cast("string")
    obs = observations(spark, sf_dir).withColumns({"repo": F.lit("r"), "packaging": F.lit("jar"), "digest": none})
    readers.save_sigs(obs, path)
    out = readers.load_sigs(spark, f"{path}/*/*.json")
    return out.groupBy("coord").agg(F.count("*").alias("classes"), F.count_distinct("version").alias("versions"), F.count_distinct("hi", "lo").alias("codes"), F.sum("instructions").alias("instructions"), F.array_join(F.array_sort(F.collect_set("sig_stamp")), ",").alias("stamps"))


@register("pack_facts", f"{_BUILD} SELECT count(*) AS n_entries, count(DISTINCT coord)::INT AS coords, 7::BIGINT AS versions, 'meta' AS built_from, true AS refused, true AS other_payloads_refused FROM ranges")
def pack_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pack says of itself, and whether other stamps are refused."""
    path, other = _fresh(spark, "pack"), _fresh(spark, "pack")
    built = dedup.build(observations(spark, sf_dir), "now").persist()
    entries, payloads = built.select("payload_id", "hi", "lo", "strings"), built.select("payload_id", "coord", "ranges", "fqcn")
    coords = [r.coord for r in built.select("coord").distinct().orderBy("coord").collect()]
    pack.write_pack(path, entries, payloads, "now", {"coords": coords, "versions": 7})
    pack.write_pack(other, entries, payloads, "old")
    payloads_of_other = spark.read.parquet(f"{other}/payloads")
    refused = []
    for replaced in (False, True):
        if replaced:
            payloads_of_other.write.mode("overwrite").parquet(f"{path}/payloads")
        try:
            pack.read_pack(spark, path, "now" if replaced else "old")
            refused.append(False)
        except ValueError:
            refused.append(True)
    built.unpersist()
    about = pack.describe_pack(spark, path)
    return spark.createDataFrame([(about["n_entries"], about["coords"], about["versions"], about["built_from"], *refused)], "n_entries long, coords int, versions long, built_from string, refused boolean, other_payloads_refused boolean")


@register("lsh_reopened", f"{_BANDS_SQL} {_FOUND}")
def lsh_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band store written, opened again and asked."""
    path = _fresh(spark, "bands")
    hamming.BandStore(library(spark, sf_dir).select("pid", "hi", "lo"), _TABLES, _PREFIX, _SEED, "now").write(path)
    return hamming.BandStore.open(spark, path, "now").query_best(app(spark, sf_dir), 8)


@register("mih_reopened", f"{DOC_SQL}, {_near(12)} SELECT qid, pid, distance FROM near")
def mih_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact index written, opened again and asked."""
    path = _fresh(spark, "mih")
    hamming.MihIndex.build(library(spark, sf_dir), stamp="now").write(path)
    return hamming.MihIndex.open(spark, path, "now").query(app(spark, sf_dir), 12)


_PLAN_SQL = f"""WITH wanted AS ({_SAMPLE.replace("SELECT coord, version, rank::INT AS rank FROM ranked", "SELECT coord, version FROM ranked")}),
left_ AS (SELECT * FROM wanted WHERE NOT (length(version) % 3 = 0 AND coord <> 'Brand#11')),
avail AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-jvm' END AS coord, (p_size % 5)::VARCHAR || '.' AS lead, CASE WHEN p_size % 3 = 0 THEN 'aar' ELSE 'jar' END AS packaging FROM part WHERE p_size % 7 <> 0),
tries AS (SELECT l.coord, l.version, s.k * 2 + p.k AS rank, l.coord || s.x AS artifact, p.x AS packaging FROM left_ l, (VALUES (0, ''), (1, '-jvm'), (2, '-android')) s(k, x), (VALUES (0, 'aar'), (1, 'jar')) p(k, x)),
got AS (SELECT t.coord, t.version, arg_min(t.artifact, t.rank) AS artifact, arg_min(t.packaging, t.rank) AS packaging FROM tries t JOIN avail a ON a.coord = t.artifact AND a.packaging = t.packaging AND starts_with(t.version, a.lead) GROUP BY t.coord, t.version),
plan AS (SELECT coord, version, artifact, packaging, CASE WHEN artifact IS NULL THEN 'not found' ELSE '' END AS error, CASE WHEN artifact IS NULL THEN 'failed' ELSE 'fetch' END AS status FROM left_ LEFT JOIN got USING (coord, version)
UNION ALL SELECT coord, version, NULL, NULL, '', 'cached' FROM wanted ANTI JOIN left_ USING (coord, version))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    cached = versions.where((F.length("version") % 3 == 0) & (F.col("coord") != "Brand#11")).select("coord", "version", F.lit("now").alias("sig_stamp"), F.lit(None).cast("string").alias("digest"))
    size = F.col("p_size")
    there = spark.read.parquet(f"{sf_dir}/part.parquet").where(size % 7 != 0).select(F.col("p_brand").alias("b"), F.concat("p_brand", F.when(size % 2 == 0, F.lit("")).otherwise(F.lit("-jvm"))).alias("coord"), F.concat((size % 5).cast("string"), F.lit(".")).alias("lead"), F.when(size % 3 == 0, F.lit("aar")).otherwise(F.lit("jar")).alias("packaging")).distinct()
    available = there.join(versions.select(F.col("coord").alias("b"), "version"), "b").where(F.startswith("version", F.col("lead"))).select("coord", "version", "packaging").distinct()
    return sampling.scrape_plan(versions, cached, available, "now")


@register("scrape_plan", f"{_PLAN_SQL} SELECT coord, version, artifact, packaging, error, status FROM plan")
def scrape_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@register("fetch_counters", f"{_PLAN_SQL} SELECT count(*) FILTER (error = '') AS ok, count(*) FILTER (error <> '') AS failed FROM plan")
def fetch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fetch_counters(_plan(spark, sf_dir))


@register("ranges_with_strays", f"""{OBS_SQL}, {_KEPT}, {_ENTRIES}, {_ORDER.replace("sig_stamp = 'now')", "sig_stamp = 'now' AND version::BIGINT % 5 <> 0)")}, {_RANGES.replace(' JOIN vers ON', ' LEFT JOIN vers ON').replace('FROM hits)', 'FROM hits WHERE pos IS NOT NULL)').rsplit(',' + chr(10) + 'ranges', 1)[0]},
parts AS (SELECT coord, hi, lo, 0 AS stray, low, text FROM runs UNION ALL SELECT coord, hi, lo, 1, 0, version FROM hits WHERE pos IS NULL)
SELECT coord, hi || lo AS sig, string_agg(text, ',' ORDER BY stray, low, text) AS ranges FROM parts GROUP BY coord, hi, lo""")
def ranges_with_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that the order does not know come last, by text."""
    entries = dedup.dedup_by_signature(_kept(spark, sf_dir)).withColumn("sig", codes.hex_of_lanes(F.col("hi"), F.col("lo")))
    order = dedup.version_order(dedup.current(observations(spark, sf_dir), "now").where(F.col("version").cast("long") % 5 != 0))
    hits = entries.select(F.struct("coord", "sig").alias("entry"), "coord", F.explode("versions").alias("version"))
    return dedup.compact_ranges(hits, order).select("entry.coord", "entry.sig", F.array_join("ranges", ",").alias("ranges"))


_MD5 = "md5(concat_ws(':', {}))"


def _lane_sql(*parts: str) -> str:
    return f"('0x' || substr({_MD5.format(', '.join(parts))}, 1, 16))::UBIGINT"


def _below_sql(n: int, *parts: str) -> str:
    return f"(('0x' || substr({_MD5.format(', '.join(parts))}, 1, 7))::BIGINT % {n})::INT"


def _flips_sql(lane: str, most: int) -> str:
    """The lane with the first n drawn bits flipped."""
    side = ">= 64" if lane.endswith("hi") else "< 64"
    for k in range(most):
        bit = _below_sql(128, "qid", f"'{k}'")
        here = f"{bit} {side}"
        lane = f"xor({lane}, CASE WHEN n > {k} AND {here} THEN 1::UBIGINT << ({bit} % 64) ELSE 0::UBIGINT END)"
    return lane


_GENERATED = f"""WITH lib AS MATERIALIZED (SELECT range AS pid, {_lane_sql("range", "1", "0")} AS hi, {_lane_sql("range", "1", "1")} AS lo FROM range(0, 20000)),
drawn AS (SELECT range AS qid, {_below_sql(20000, "range", "1", "'of'")}::BIGINT AS pid, {_below_sql(100, "range", "1", "'kind'")} < 30 AS near, {_below_sql(13, "range", "'n'")} AS n FROM range(0, 2000)),
app AS MATERIALIZED (SELECT qid, CASE WHEN near THEN {_flips_sql("l.hi", 12)} ELSE {_lane_sql("qid", "1", "'miss0'")} END AS hi, CASE WHEN near THEN {_flips_sql("l.lo", 12)} ELSE {_lane_sql("qid", "1", "'miss1'")} END AS lo FROM drawn JOIN lib l USING (pid)),
{_near(12)} {_BEST}"""


@register("generated_probes", _GENERATED)
def generated_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = generate.uniform_codes(spark, 20_000)
    return hamming.best_join(generate.probe_mix(lib, 20_000, 2_000, 12), lib, 12, m=8)


# -- Drift and evaluation -----------------------------------------------------------------

_ORIGINAL = "CASE (doc_id // 2) % 3 WHEN 0 THEN 'com.google.P' WHEN 1 THEN 'okhttp3.P' ELSE 'my.app.P' END || (doc_id // 2) || CASE WHEN doc_id // 2 % 50 = 7 THEN '$$Lambda$' ELSE '' END"
_DRIFT = f"""{DOC_SQL}, pairs AS (SELECT x.original, x.hi AS x_hi, x.lo AS x_lo, y.hi AS y_hi, y.lo AS y_lo FROM (SELECT *, {_ORIGINAL} AS original FROM lib) x JOIN (SELECT *, {_ORIGINAL} AS original FROM app) y USING (original) WHERE NOT contains(original, '$$Lambda$')),
drifted AS (SELECT original, bit_count(xor(x_hi, y_hi))::INT + bit_count(xor(x_lo, y_lo))::INT AS distance, original NOT LIKE 'my.app.%' AS library FROM pairs)"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.floor(F.col("doc_id") / 2).cast("long")
    lead = F.when(pair % 3 == 0, F.lit("com.google.P")).when(pair % 3 == 1, F.lit("okhttp3.P")).otherwise(F.lit("my.app.P"))
    original = F.concat(lead, pair.cast("string"), F.when(pair % 50 == 7, F.lit("$$Lambda$")).otherwise(F.lit("")))
    sides = []
    for side in (library(spark, sf_dir), app(spark, sf_dir)):
        named = side.select(original.alias("original"), F.concat(F.lit("a.C"), F.col("doc_id").cast("string")).alias("fqcn"), "hi", "lo")
        sides += [named.select("original", F.col("fqcn").alias("obfuscated")), named.select("fqcn", "hi", "lo")]
    return study.drift(study.load_pairs(*sides))


@register("drift_pairs", f"{_DRIFT} SELECT original, distance, library FROM drifted")
def drift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)


_HIST = "hist AS (SELECT distance, count(*) AS n_all, count(*) FILTER (library) AS n_library, count(*) FILTER (NOT library) AS n_app FROM drifted GROUP BY distance)"


@register("drift_histogram", f"{_DRIFT}, {_HIST} SELECT *, sum(n_all) OVER (ORDER BY distance) / sum(n_all) OVER () AS share, repeat('#', least(40, 40 * n_all // max(n_all) OVER ())::INT) AS bar FROM hist")
def drift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.cumulative(study.histogram(_drift(spark, sf_dir)))


@register("drift_grand", f"{_DRIFT}, two AS (SELECT CASE WHEN length(original) % 2 = 0 THEN 'even' ELSE 'odd' END AS pair, distance FROM drifted) SELECT pair, distance, count(*) AS n FROM two GROUP BY GROUPING SETS ((pair, distance), (distance))")
def drift_grand(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.when(F.length("original") % 2 == 0, "even").otherwise("odd")
    return study.grand_histogram(_drift(spark, sf_dir).withColumn("pair", pair))


@register("drift_percentiles", f"{_DRIFT} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, quantile_disc(distance, {p}) AS distance FROM drifted" for p in (0.5, 0.9, 0.95, 0.99)))
def drift_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.percentiles(_drift(spark, sf_dir), [0.5, 0.9, 0.95, 0.99])


@register("drift_regime", f"{_DRIFT} SELECT library, CASE WHEN r <= 6 THEN 'tight' WHEN r <= 14 THEN 'moderate' ELSE 'wide' END AS regime FROM (SELECT library, quantile_disc(distance, 0.95) AS r FROM drifted GROUP BY library)")
def drift_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _drift(spark, sf_dir).groupBy("library").agg(F.expr("percentile_disc(0.95D) within group (order by distance)").alias("r"))
    return r.select("library", study.regime(F.col("r")).alias("regime"))


@register("cosine_radius", "SELECT r::INT AS radius, round(cos(pi() * r / 128), 12) AS cosine FROM range(0, 129) t(r)")
def cosine_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(129).select(F.col("id").cast("int").alias("radius"), F.round(codes.cosine_of_radius(F.col("id")), 12).alias("cosine"))


_EVAL = f"""{_CASCADE}, called AS (SELECT pid, 'lib.' || coord || '.x.C' || pid AS name FROM lib),
begins AS (SELECT doc_id, substr(text, 1, 40) AS lead FROM documents WHERE length(text) >= 40),
truth AS (SELECT a.qid, 'lib.' || min_by(l.coord, l.pid) || '.x.C' || min(l.pid) AS original FROM app a JOIN begins b ON b.doc_id = a.qid JOIN begins c ON c.lead = b.lead JOIN lib l ON l.pid = c.doc_id GROUP BY a.qid),
judged AS (SELECT d.qid, d.tier, c.name AS found, t.original FROM detected d LEFT JOIN called c ON c.pid = d.payload_id LEFT JOIN truth t ON t.qid = d.qid),
counts AS (SELECT count(*) FILTER (original IS NOT NULL) AS tested, count(*) FILTER (found = original) AS tp, count(*) FILTER (found IS NOT NULL AND found IS DISTINCT FROM original) AS fp, count(*) FILTER (found IS NULL AND original IS NOT NULL) AS fn, count(*) FILTER (found = original AND tier = 1) AS tier1, count(*) FILTER (found = original AND tier = 2) AS tier2, count(*) FILTER (found = original AND tier = 3) AS tier3 FROM judged),
shares AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM counts)"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, lib = _detector(spark, sf_dir), library(spark, sf_dir)
    name = F.concat(F.lit("lib."), F.col("coord"), F.lit(".x.C"), F.col("pid").cast("string"))
    called = lib.select(F.col("pid").alias("payload_id"), name.alias("found"))
    found = _detected(spark, sf_dir, d).join(called, "payload_id", "left").select("qid", "found", "tier")
    # The truth, which neither code nor rare strings decide: the first library class whose
    # text begins with the same 40 characters.
    begins = documents(spark, sf_dir).where("length(text) >= 40").select("doc_id", F.substring("text", 1, 40).alias("lead"))
    mine = app(spark, sf_dir).select("doc_id", "qid").join(begins, "doc_id").select("qid", "lead")
    # The first of each beginning, before the join: many begin alike, on both sides.
    leads = lib.select("doc_id", "pid", "coord").join(begins, "doc_id").groupBy("lead").agg(F.min(F.struct("pid", "coord")).alias("f"))
    first = mine.join(leads, "lead").groupBy("qid").agg(F.min("f").alias("f"))
    truth = first.select("qid", "f.pid", "f.coord").select("qid", name.alias("original"))
    return found, truth


@register("eval_detection", f"{_EVAL} SELECT tested, tp, fp, fn, tier1, tier2, tier3, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM shares")
def eval_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.evaluate(*_judged(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@register("eval_by_root", f"{_EVAL} SELECT array_to_string(string_split(original, '.')[1:3], '.') AS root, count(*) FILTER (found = original) AS detected, count(*) AS present FROM judged WHERE original IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (found = original) > 0 ORDER BY detected DESC, root LIMIT 12")
def eval_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.by_root(*_judged(spark, sf_dir))


@register("eval_recovered", f"{_EVAL} SELECT qid, found, tier, original FROM judged WHERE found = original AND tier IN (2, 3) ORDER BY qid LIMIT 8")
def eval_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.recovered(*_judged(spark, sf_dir))
