"""Cases of the signature engine, and differential tests of the Hamming join."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.functions import codes, names
from sigloom.operators import anchors, cluster, dedup, detect, generate, hamming, sampling, storage, study
from sigloom.sources import pack, readers

# Inputs whose expected results are given with them.
OKHTTP = "com.squareup.okhttp3:okhttp"
ORDER = ["3.12.0", "3.14.9", "4.0.1", "4.9.3", "4.12.0"]


def S(k):
    return k * 0x9E3779B97F4A7C15 % (1 << 128)


def codes_df(spark, rows, key):
    return spark.createDataFrame([(k, *codes.lanes_of_int(c)) for k, c in rows], f"{key} long, hi long, lo long")


def test_hex_and_lanes(spark):
    values = [0, 1, S(3), (1 << 128) - 1, 1 << 127, 1 << 63, 1 << 64]
    df = spark.createDataFrame([(f"{v:x}", k) for k, v in enumerate(values)], "h string, k int")
    hi, lo = codes.lanes_of_hex(F.col("h"))
    rows = df.select("k", hi.alias("hi"), lo.alias("lo")).withColumn("back", codes.hex_of_lanes(F.col("hi"), F.col("lo"))).orderBy("k").collect()
    for v, r in zip(values, rows, strict=True):
        assert (r.hi, r.lo) == codes.lanes_of_int(v) and int(r.back, 16) == v and len(r.back) == 32


@pytest.mark.parametrize(("radius", "m"), [(0, None), (4, 5), (4, 6), (4, 9), (12, 7), (12, 8), (12, 10), (20, 13)])
def test_banded_join_is_exact(spark, radius, m):
    r = random.Random(42)
    lib = [(k, r.getrandbits(128)) for k in range(300)] + [(900, 5), (901, 5)]
    app = [(0, 5)]
    for q in range(1, 60):
        c = r.choice(lib)[1]
        for _ in range(r.randint(0, radius + 2)):
            c ^= 1 << r.randrange(128)
        app.append((q, c if q % 2 else r.getrandbits(128)))
    want = sorted((q, p, (a ^ b).bit_count()) for q, a in app for p, b in lib if (a ^ b).bit_count() <= radius)
    a, b = codes_df(spark, app, "qid"), codes_df(spark, lib, "pid")
    assert sorted(map(tuple, hamming.hamming_join(a, b, radius, m).collect())) == want
    assert sorted(map(tuple, hamming.brute_join(a, b, radius).collect())) == want


def test_band_layouts():
    for m in range(1, 129):
        layout = codes.bands(m)
        assert layout[0][0] == 0 and sum(w for _, w in layout) == 128
        assert all(a + w == b for (a, w), (b, _) in zip(layout, layout[1:], strict=False))
    assert [codes.suggest_m(n) for n in (0, 1, 2, 1000, 10**6, 5 * 10**7)] == [6, 6, 16, 12, 6, 6]
    assert len(codes.flips(16, 1)) == 17 and codes.flips(4, 9)[-1] == 15
    with pytest.raises(ValueError):
        codes.permutations(0, 1)


def test_thresholds_leave_nothing_out():
    for radius in range(0, 25):
        for m in range(1, 17):
            t = codes.thresholds(radius, m)
            # The least number of bits that passes every band's threshold.
            assert len(t) == m and sum(x + 1 for x in t) == radius + 1 and max(t) == radius // m


def test_best_match_prefers_near_then_first(spark):
    lib = codes_df(spark, [(1, 7), (2, 6), (3, 7)], "pid")
    hits = hamming.hamming_join(codes_df(spark, [(9, 7), (8, 4)], "qid"), lib, 8)
    assert {r.qid: (r.pid, r.distance) for r in hamming.best_match(hits).collect()} == {9: (1, 0), 8: (2, 1)}


def test_band_store_recall_and_precision(spark):
    lib = generate.uniform_codes(spark, 3000, 5)
    store = hamming.BandStore(lib, tables=8, prefix_bits=10)
    hi, lo = generate.flipped(F.col("hi"), F.col("lo"), F.col("pid"), 4)
    probes = lib.where("pid % 10 = 0").select(F.col("pid").alias("qid"), hi.alias("hi"), lo.alias("lo"))
    n = probes.count()
    found = [store.query_best(probes, 4, p).where("qid = pid").count() for p in (0, 1)]
    assert found[0] >= 0.9 * n and found[1] >= found[0]
    assert store.query_best(probes, 4).where("distance > 4").isEmpty()


def test_stores_open_again(spark, tmp_path):
    lib = generate.uniform_codes(spark, 2000, 5).persist()
    hi, lo = generate.flipped_apart(F.col("hi"), F.col("lo"), F.col("pid"), 7)
    probes = lib.where("pid % 20 = 0").select(F.col("pid").alias("qid"), hi.alias("hi"), lo.alias("lo"))
    store, path = hamming.BandStore(lib, tables=8, prefix_bits=10, stamp="s"), str(tmp_path / "bands")
    store.write(path)
    again = hamming.BandStore.open(spark, path, "s")
    assert sorted(again.query_best(probes, 7).collect()) == sorted(store.query_best(probes, 7).collect())
    assert sorted(again.directory().collect()) == sorted(store.directory().collect())
    with pytest.raises(storage.StaleStoreError):
        hamming.BandStore.open(spark, path, "t")
    spark.read.parquet(f"{path}/bands").where("table > 0").write.parquet(str(tmp_path / "cut" / "bands"))
    spark.read.text(f"{path}/meta").write.text(str(tmp_path / "cut" / "meta"))
    with pytest.raises(ValueError, match="not whole"):
        hamming.BandStore.open(spark, str(tmp_path / "cut"))
    hamming.MihIndex.build(lib, stamp="s").write(str(tmp_path / "mih"))
    index = hamming.MihIndex.open(spark, str(tmp_path / "mih"), "s")
    for radius in (0, 7, 12):
        assert sorted(index.query(probes, radius).collect()) == sorted(hamming.brute_join(probes, lib, radius).collect())
    with pytest.raises(ValueError, match="format"):
        hamming.MihIndex.open(spark, path)
    found = {r.qid: r.distance for r in hamming.by_distance(index.query(probes, 7)).collect() if r.qid == r.pid}
    assert len(found) == 100 and set(found.values()) == {7}


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_planned_join_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(hamming, "BROADCAST_KEYS", most)
    lib = generate.uniform_codes(spark, 400).persist()
    probes = generate.probe_mix(lib, 400, 60, 12).persist()
    assert hamming.plan(4, 60, 400)[1] == bool(most)
    for radius in (4, 12):
        assert sorted(hamming.hamming_join(probes, lib, radius).collect()) == sorted(hamming.brute_join(probes, lib, radius).collect())


@pytest.mark.parametrize("way", ["join", "index"])
def test_exploded_keys_are_not_broadcast(spark, monkeypatch, tmp_path, way):
    """Spark takes exploded keys for as small as the codes they are made of."""
    monkeypatch.setattr(hamming, "BROADCAST_KEYS", 0)
    lib = generate.uniform_codes(spark, 400).persist()
    probes = lib.where("pid % 4 = 0").withColumnRenamed("pid", "qid")
    assert lib.count() == 400
    if way == "join":
        pairs = hamming.code_pairs(probes, lib, 12)
    else:
        hamming.MihIndex.build(lib, stamp="s").write(str(tmp_path / "mih"))
        index = hamming.MihIndex.open(spark, str(tmp_path / "mih"))
        pairs = hamming.met(hamming.probe_keys(hamming._sides(probes, lib)[0], index.m, 12), index.keys, 12)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_all_pairs_are_dealt_out_as_blocks(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(hamming, "BLOCK", 100)
    lib = [(k, r.getrandbits(128)) for k in range(400)] + [(900, 5), (901, 5)]
    app = [(q, r.choice(lib)[1] ^ 1 << q % 128) for q in range(700)]
    a, b = codes_df(spark, app, "qid"), codes_df(spark, lib, "pid")
    for radius in (0, 12, 60):
        out = hamming.brute_join(a, b, radius)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # One row a block on either side, so that no task holds more, and no side is broadcast.
        assert "MapInArrow compare" in plan and plan.count("LogicalRDD") >= 2
        want = sorted((q, p, (x ^ y).bit_count()) for q, x in app for p, y in lib if (x ^ y).bit_count() <= radius)
        assert sorted(map(tuple, out.collect())) == want
    assert hamming.brute_join(a, b.where("pid < 0"), 12).count() == 0
    assert [hamming.block_count(n) for n in (0, 1, 700, 4096, 100_000)] == [1, 1, 7, 41, 1000]


def test_best_join_meets_no_pairs_of_copies(spark):
    lib = codes_df(spark, [(k, 7) for k in range(400)] + [(900, 6), (901, 6)], "pid")
    probes = codes_df(spark, [(k, 7) for k in range(400)] + [(1000, 4), (1001, S(5)), (1001, 6)], "qid")
    for radius in (0, 4, 12):
        hits = hamming.hamming_join(probes, lib, radius)
        assert sorted(hamming.best_join(probes, lib, radius).collect()) == sorted(hamming.best_match(hits).collect())
    best = hamming.best_join(probes, lib, 4, 6).persist()
    assert best.count() == 402
    assert {r.qid: (r.pid, r.distance) for r in best.where("qid >= 1000").collect()} == {1000: (900, 1), 1001: (900, 0)}


def test_truth_meets_no_pairs_of_documents_that_begin_alike(spark, tmp_path):
    """the first library document of a beginning is found before the join."""
    from sigloom.plans import catalog, projections

    rows = [(k, ("same beginning of " * 3 if k % 4 < 3 else f"document {k} begins as no other one does ") + f"word{k:05d}", f"s{k % 2}{k % 3}") for k in range(4, 204)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    _, truth = catalog._judged(spark, str(tmp_path))
    assert {tuple(r) for r in truth.collect()} == {(k, "lib.s01.x.C4") for k in range(4, 204) if k % 4 == 1}
    assert "Aggregate [lead" in truth._jdf.queryExecution().optimizedPlan().toString()
    projections.release()


def test_sigs_cost_no_patterns_and_no_sums_a_line(spark, tmp_path):
    """codes are made of parts, and only text with an escape goes through patterns."""
    from sigloom.plans import projections

    plan = projections.observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("md5")
    for k, text in enumerate((r"\ud83d", r"\uDC00", r"\Ud83d", r"plain", r"\\ud83d")):
        (tmp_path / f"{k}.json").write_text('{"format":1,"coord":"a:b","version":"1","sig_stamp":"s","classes":[["x%s","%x","[]","5"]]}' % (text, k + 1))
    out = readers.load_sigs(spark, str(tmp_path / "*.json"))
    assert "Contains" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.lo: r.fqcn for r in out.collect()} == {1: r"x\ud83d", 2: r"x\uDC00", 3: r"x\Ud83d", 4: "xplain", 5: r"x\ud83d"}


def obs(spark, rows):
    out = [(c, v, *codes.lanes_of_int(s), f, list(t), i, k) for k, (c, v, s, f, t, i) in enumerate(rows)]
    return spark.createDataFrame(out, "coord string, version string, hi long, lo long, fqcn string, strings array<string>, instructions int, seq long")


def test_dedup_keeps_first_observation(spark):
    rows = [(OKHTTP, v, S(1), f"c{v}", ["x" + v], 30 + k) for k, v in enumerate(ORDER[:3])] + [(OKHTTP, "4.12.0", S(2), "d", [], 5), ("a:a", "1", S(3), "e", [], 9), ("b:b", "1", S(3), "e", [], 9)]
    out = {(r.coord, r.lo): r for r in dedup.dedup_by_signature(obs(spark, rows)).collect()}
    assert len(out) == 4
    first = out[OKHTTP, codes.lanes_of_int(S(1))[1]]
    assert (first.fqcn, first.strings, first.instructions, first.versions) == ("c3.12.0", ["x3.12.0"], 30, ORDER[:3])


@pytest.mark.parametrize(
    ("versions", "ranges"),
    [(ORDER[:3], ["3.12.0..4.0.1"]), (["3.12.0", "4.0.1", "4.9.3"], ["3.12.0", "4.0.1..4.9.3"]), (["4.9.3"], ["4.9.3"]), (ORDER, ["3.12.0..4.12.0"]), (["3.12.0", "9.9.9", "1x"], ["3.12.0", "1x", "9.9.9"])],
)
def test_ranges(spark, versions, ranges):
    order = spark.createDataFrame([(OKHTTP, v, k) for k, v in enumerate(ORDER)], "coord string, version string, pos int")
    hits = spark.createDataFrame([(0, OKHTTP, v) for v in versions], "entry long, coord string, version string")
    assert dedup.compact_ranges(hits, order).first().ranges == ranges


def test_order_counts_filtered_versions(spark):
    """A version whose classes are all too small still stands between two others."""
    rows = [(OKHTTP, "1.0", S(1), "a", [], 50), (OKHTTP, "1.1", S(9), "b", [], 1), (OKHTTP, "1.2", S(1), "a", [], 50)]
    built = dedup.build(obs(spark, rows).withColumn("sig_stamp", F.lit("s")), "s").collect()
    assert [(r.payload_id, r.ranges) for r in built] == [(0, ["1.0", "1.2"])]


def pack_at(spark, path, **meta):
    rows = [(0, *codes.lanes_of_int(S(1)), ["http/1.1", "OkHttp"]), (1, *codes.lanes_of_int(S(2)), ["Cache-Control"])]
    entries = spark.createDataFrame(rows, "payload_id long, hi long, lo long, strings array<string>")
    payloads = spark.createDataFrame([(0, OKHTTP, ["3.12.0..3.14.9"], "okhttp3.Call"), (1, OKHTTP, ["4.12.0"], "okhttp3.Cache")], "payload_id long, coord string, ranges array<string>, fqcn string")
    pack.write_pack(path, entries, payloads, "stamp-a", meta)
    return entries


def test_pack_guards_and_description(spark, tmp_path):
    path = str(tmp_path / "p")
    entries = pack_at(spark, path, coords=[OKHTTP], versions=3, built="2026-01-01T00:00:00Z")
    assert pack.read_pack(spark, path, "stamp-a")[0].count() == 2
    with pytest.raises(pack.StaleStoreError):
        pack.read_pack(spark, path, "stamp-b")
    about = pack.describe_pack(spark, path)
    assert (about["n_entries"], about["coords"], about["classes_seen"], about["built_from"]) == (2, 1, None, "meta") and len(about) == 10
    with pytest.raises(ValueError):
        pack.write_pack(str(tmp_path / "q"), entries.where("payload_id = 1"), None, "s")
    assert pack.read_meta(spark, str(tmp_path / "none")) == {}
    with pytest.raises(FileNotFoundError):
        pack.describe_pack(spark, str(tmp_path / "none"))
    pack_at(spark, str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other" / "payloads")).withColumn("sig_stamp", F.lit("stamp-b")).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(ValueError, match="payloads"):  # as many, of another stamp
        pack.read_pack(spark, path)
    entries.where("payload_id = 0").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(ValueError):
        pack.read_pack(spark, path)


def test_cascade(spark, tmp_path):
    path = str(tmp_path / "p")
    pack_at(spark, path)
    d = detect.Detector.from_pack(spark, path, expect_stamp="stamp-a")
    rows = [(1, *codes.lanes_of_int(S(1)), []), (2, *codes.lanes_of_int(S(2) ^ 7), []), (3, *codes.lanes_of_int(S(999)), ["Cache-Control", "zzz"]), (4, *codes.lanes_of_int(S(999)), ["zzz"])]
    app = spark.createDataFrame(rows, "qid long, hi long, lo long, strings array<string>")
    out = {r.qid: r for r in d.label(d.detect(app)).collect()}
    assert [(out[k].tier, out[k].distance, out[k].label) for k in (1, 2, 3, 4)] == [(1, 0, f"library:{OKHTTP}@3.12.0..3.14.9"), (2, 3, f"library:{OKHTTP}@4.12.0"), (3, -1, f"library:{OKHTTP}@4.12.0"), (None, None, None)]
    bare = detect.Detector.build(d.entries)
    assert bare.label(bare.detect(app)).where("qid = 1").first().label == "library:payload/0"


def test_anchors(spark):
    def useful(x):
        return spark.createDataFrame([(x,)], "s array<string>").select(anchors.useful_strings(F.col("s")).alias("u")).first().u

    assert useful(["ok", "1234", "RoomDatabase", "a.b.c.Widget", "²²²²", "٣٣٣٣", "ok12"]) == ["RoomDatabase", "a.b.c.Widget", "ok12"]
    entries = [(10, ["shared-const", "only-ten"]), (11, ["shared-const", "only-eleven"]), (12, ["other"])] + [(20 + k, ["UTF-8"]) for k in range(11)]
    index = anchors.AnchorIndex(spark.createDataFrame(entries, "pid long, strings array<string>"))
    probes = spark.createDataFrame([(1, ["only-ten", "shared-const"]), (2, ["shared-const"]), (3, ["UTF-8"]), (4, ["only-eleven"])], "qid long, strings array<string>")
    assert {r.qid: r.pid for r in index.best(probes).collect()} == {1: 10, 4: 11}
    low = {(r.qid, r.pid) for r in index.query(probes, 0.0).collect()}
    assert (2, 10) in low and (2, 11) in low and index.size() == 4


def test_clusters(spark):
    def run(values, radius):
        df = codes_df(spark, list(enumerate(values)), "idx")
        return sorted(r.members for r in cluster.groups(cluster.cluster_by_radius(df, radius)).collect())

    assert run([S(1), S(1), S(2)], 0) == [[0, 1], [2]]
    assert run([S(1), S(1) ^ 3, S(1) ^ 0x7F0], 4) == [[0, 1], [2]]
    assert run([S(1), S(1) ^ 0xF, S(1) ^ 0xFF], 4) == [[0, 1, 2]]
    assert run([S(5) ^ ((1 << 2 * k) - 1) for k in range(20)], 2) == [list(range(20))]
    assert run([], 4) == []


def test_sampler(spark):
    listed = ["1.0", "1.0.3", "1.1", "1.2-alpha", "1.3", "2.0-x", "2.0", "v3", "1.5", "1.4rc1"]
    df = spark.createDataFrame([("c", v, k) for k, v in enumerate(listed)], "coord string, version string, pos int")

    def picked(n, pre=False):
        return [r.version for r in sampling.sample_versions(df, n, pre).orderBy("rank").collect()]

    assert picked(8) == ["v3", "1.0.3", "1.1", "1.3", "1.5", "2.0-x"]
    assert picked(3) == ["v3", "1.1", "2.0-x"]  # round(2.5) is 2
    assert picked(1) == ["v3"] and picked(0) == []
    key = spark.createDataFrame([("v1",), ("1.10-x",), ("",)], "v string").select(names.ver_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in key] == [[0], [1, 10], [0]]


def test_cache_reuse(spark):
    want = spark.createDataFrame([("a:a", "1", None), ("a:a", "2", "d2"), ("a:a", "3", "d3")], "coord string, version string, digest string")
    have = spark.createDataFrame([("a:a", "1", "s", "x"), ("a:a", "2", "s", "other"), ("a:a", "3", "old", "d3")], "coord string, version string, sig_stamp string, digest string")
    assert sorted(r.version for r in sampling.to_fetch(want, have, "s").collect()) == ["2", "3"]


def test_catalogues(spark, tmp_path):
    assert readers.load_catalogue(spark).count() == 27
    f = tmp_path / "c.txt"
    f.write_text("# note\n\na:b  central # x\na:b google\n")
    assert [(r.coord, r.repo) for r in readers.load_catalogue(spark, str(f)).orderBy("pos").collect()] == [("a:b", "central"), ("a:b", "google")]
    f.write_text("a:b central\nnonsense\n")
    with pytest.raises(Exception, match="line 2"):
        readers.load_catalogue(spark, str(f)).collect()
    j = tmp_path / "c.json"
    j.write_text('[{"coordinate": "a:b", "repository": "r1", "z": 1}, {"coordinate": "a:b", "repository": "r2"}]')
    assert [(r.coord, r.repo) for r in readers.load_catalogue(spark, str(j)).collect()] == [("a:b", "r1")]


def test_cached_files(spark, tmp_path):
    (tmp_path / "a__b").mkdir()
    head = '{"format": 1, "coord": "a:b", "version": "1", "repo": "r", "packaging": "aar", "digest": "d", "sig_stamp": "s", "classes": '
    (tmp_path / "a__b" / "b-1.sigs.json").write_text(head + '[["x.Y", "ff", ["pre-\\ud800-post", "ok \\ud83d\\ude00"], 21], ["x.Z", "0", [], 3]]}')
    (tmp_path / "a__b" / "b-2.sigs.json").write_text(head + '[["x.Y", "ff", [], 21], ["bad", "zz", [], 3]]}')
    (tmp_path / "a__b" / "b-3.sigs.json").write_text("{nope")
    (tmp_path / "a__b" / "b-4.sigs.json").write_text(head.replace('"format": 1', '"format": 9') + "[]}")
    rows = readers.iter_cached_sigs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.fqcn, r.hi, r.lo, r.instructions) for r in rows] == [("x.Y", 0, 255, 21), ("x.Z", 0, 0, 3)]
    assert rows[0].strings == ["pre-\\ud800-post", "ok \U0001f600"]
    (tmp_path / "a__b" / "b-5.sigs.json").write_text(head.replace('"1"', '"5"') + '[\n ["x.W", "1", [], 3]\n]\n}\n')
    readers.save_sigs(readers.iter_cached_sigs(spark, str(tmp_path)), str(tmp_path / "out"))
    again = readers.load_sigs(spark, str(tmp_path / "out" / "*" / "*.json"))
    assert sorted(again.select("version", "fqcn", "lo").collect()) == [("1", "x.Y", 255), ("1", "x.Z", 0), ("5", "x.W", 1)]


def test_mapping_and_metadata(spark):
    text = "# c\na.B -> x.y:\n    int f -> g\nq.R -> s:\n    void m() -> n\na.B -> z.z:\n"
    files = spark.createDataFrame([("p", text)], "path string, value string")
    assert sorted(map(tuple, readers.parse_class_mapping(readers.text_lines(files)).collect())) == [("a.B", "z.z"), ("q.R", "s")]
    xml = spark.createDataFrame([("a:b", "<m><versioning><versions><version>1</version><version></version><version>2</version></versions></versioning></m>")], "coord string, value string")
    assert [r.version for r in readers.list_versions(xml).orderBy("pos").collect()] == ["1", "2"]


def test_builds_and_inversion(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a.A -> o:"), (2, "b.B -> o:"), (3, "a.A -> p:"), (4, "z.Z -> q:"), (5, "c.C -> q:")], "lineno int, line string")
    assert sorted(map(tuple, readers.invert(readers.mapping_in_order(lines)).collect())) == [("o", "b.B"), ("p", "a.A"), ("q", "c.C")]
    spark.createDataFrame([("o", 1, 2)], "fqcn string, hi long, lo long").write.parquet(str(tmp_path / "rows"))
    (tmp_path / "map.txt").write_text("a.A -> o:\n")
    rows, mapping = readers.load_build(spark, f"file:{tmp_path}/rows:{tmp_path}/map.txt")
    assert rows.count() == 1 and mapping.first().obfuscated == "o"
    with pytest.raises(ValueError):
        readers.load_build(spark, "rows")


def test_scrape_plan(spark):
    versions = spark.createDataFrame([("a:a", "1.0", 0), ("a:a", "2.0", 1), ("b:b", "1.0", 0)], "coord string, version string, pos int")
    cached = spark.createDataFrame([("a:a", "1.0", "s", None)], "coord string, version string, sig_stamp string, digest string")
    there = spark.createDataFrame([("a:a-jvm", "2.0", "jar")], "coord string, version string, packaging string")
    plan = sampling.scrape_plan(versions, cached, there, "s")
    assert {(r.coord, r.version): (r.status, r.artifact) for r in plan.collect()} == {("a:a", "1.0"): ("cached", None), ("a:a", "2.0"): ("fetch", "a:a-jvm"), ("b:b", "1.0"): ("failed", None)}
    assert tuple(sampling.fetch_counters(plan).first()) == (2, 1)


def test_held_tables_follow_the_data(spark, tmp_path):
    from sigloom.plans import projections

    one = spark.createDataFrame([(1, "some words of text", "s")], "doc_id long, text string, source string")
    one.write.parquet(str(tmp_path / "documents.parquet"))
    assert projections.doc_codes(spark, str(tmp_path)).count() == 1
    one.union(one.withColumn("doc_id", F.lit(2))).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert projections.doc_codes(spark, str(tmp_path)).count() == 2
    projections.release()


def test_codes_are_counted_within_documents(spark, tmp_path):
    """no row a word reaches the sums of a document's bits."""
    import hashlib
    import re
    from collections import defaultdict

    from sigloom.plans import projections

    r = random.Random(10)
    many = " ".join(f"wörd{r.randrange(2000)}" for _ in range(3000))
    rows = [(1, many, "a"), (1, many, "b"), (1, "same\tid\r\nand  source", "a"), (2, None, "a"), (3, "", "a"), (4, "abc de\x0bf𝒳𝒳 \u00a0four", None), (None, "words without an id", "a")]
    rows += [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(k)), "c") for k in (5, 254, 255, 256, 511)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = projections.doc_codes(spark, str(tmp_path))
    got = {(x.doc_id, x.coord): (x.n_words, x.hi, x.lo) for x in found.collect()}
    words = defaultdict(list)
    for doc, text, coord in rows:
        words[doc, coord] += {w for w in re.split("[ \t\r\n]+", text or "") if len(w) >= 4}
    want = {}
    for key, all_ in words.items():
        sums = [int(hashlib.md5(w.encode()).hexdigest(), 16) for w in all_]
        if all_:
            want[key] = (len(all_), *codes.lanes_of_int(sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in sums) > len(all_))))
    assert got == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    projections.release()


def test_strings_are_split_before_any_join(spark, tmp_path):
    """arrays of strings are never shuffled, and ids may repeat."""
    duckdb = pytest.importorskip("duckdb")
    from sigloom.plans import catalog, projections

    r = random.Random(9)
    words = [f"word{k}" for k in range(60)] + ["1234", "٣٣٣٣", "of", "²²²²"]
    texts = [" ".join([r.choice(words) for _ in range(30)] + [f"rare{k // 5}", f"rare{k // 5}", f"rarer{k // 3}"]) for k in range(150)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)] + [(7, texts[20], "s9"), (8, texts[21], "s9"), (151, None, "s0"), (152, "a b", "s0"), (153, texts[30], None), (155, texts[30], "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    d = catalog._detector(spark, str(tmp_path))
    lines = catalog._detected(spark, str(tmp_path), d)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    exploded = [k for k, x in enumerate(lines) if "Generate explode" in x]
    assert len(exploded) == 2
    for k in exploded:
        below = next((n for n in range(k + 1, len(lines)) if depth[n] <= depth[k]), len(lines))
        assert not any("Join" in x or "lambda" in x for x in lines[k:below])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("detect_cascade", "detect_labels", "library_report", "anchor_query"):
        out = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert out and sorted(map(str, (tuple(x) for x in out))) == sorted(map(str, con.execute(catalog.ORACLES[name]).fetchall()))
    projections.release()


def test_study(spark):
    rows = [("okio.A", 0, 0, 0, 0), ("okio.B", 0, 0, 0, 1), ("app.C", 0, 7, 0, 0)]
    drifted = study.drift(spark.createDataFrame(rows, "original string, x_hi long, x_lo long, y_hi long, y_lo long"))
    hist = {r.distance: (r.n_all, r.n_library, r.n_app) for r in study.histogram(drifted).collect()}
    assert hist == {0: (1, 1, 0), 1: (1, 1, 0), 3: (1, 0, 1)}
    assert [r.distance for r in study.percentiles(drifted, [0, 0.5, 1.0], F.col("library")).collect()] == [0, 0, 1]
    assert study.percentiles(drifted.where("false"), [0.5]).first().distance is None
    found = spark.createDataFrame([(1, "x.y.z.A", 1), (2, "x.y.z.B", 2), (3, None, None), (4, "q", 3)], "qid long, found string, tier int")
    truth = spark.createDataFrame([(1, "x.y.z.A"), (2, "x.y.z.A"), (3, "x.y.z.C")], "qid long, original string")
    r = study.evaluate(found, truth).first()
    assert (r.tested, r.tp, r.fp, r.fn, r.precision, r.recall) == (3, 1, 2, 1, 1 / 3, 0.5)
    assert [tuple(x) for x in study.by_root(found, truth).collect()] == [("x.y.z", 1, 3)]


def test_stream_labels_new_files(spark, tmp_path):
    from sigloom.streaming.incremental import label_stream

    entries = spark.createDataFrame([(0, *codes.lanes_of_int(S(1)), ["tag-one"])], "payload_id long, hi long, lo long, strings array<string>")
    d = detect.Detector.build(entries)
    schema = "qid long, hi long, lo long, strings array<string>"
    for k in range(2):
        spark.createDataFrame([(k, *codes.lanes_of_int(S(1) ^ k), [])], schema).write.mode("append").json(str(tmp_path / "in"))
        q = label_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), d, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.qid, r.tier) for r in out.collect()) == [(0, 1), (1, 2)]


def test_stream_of_new_files(spark, tmp_path):
    from sigloom.streaming.incremental import new_observations

    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"coord": "a:a", "version": "{k}"}}\n')
        new_observations(spark, str(tmp_path / "in"), "coord string, version string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.version for r in out) == ["0", "1"] and len({r.path for r in out}) == 2


def test_commands(spark, tmp_path, capsys):
    from sigloom import cli

    rows = [(OKHTTP, v, S(k), f"c.{k}", [f"tag-{k}"], 30) for k in range(6) for v in ORDER[:2]] + [(OKHTTP, "3.12.0", S(9), "c.9", [], 3)]
    obs(spark, rows).withColumn("sig_stamp", F.lit("s")).write.parquet(str(tmp_path / "obs"))
    codes_df(spark, [(k, S(k) ^ (k == 3)) for k in range(6)], "qid").selectExpr("*", "array() as strings", "50 as instructions").withColumn("strings", F.array().cast("array<string>")).write.parquet(str(tmp_path / "app"))
    path, out = str(tmp_path / "pack"), str(tmp_path / "out")
    cli.main(["build", str(tmp_path / "obs"), path, "--stamp", "s"], spark)
    cli.main(["info", path], spark)
    said = capsys.readouterr().out
    assert "classes_seen" in said and "n_entries" in said
    cli.main(["--out", out, "detect", path, str(tmp_path / "app"), "--stamp", "s"], spark)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(OKHTTP, 6, 5, 1, 0)]
    cli.main(["--out", out, "query", path, f"{S(2) ^ 5:x}"], spark)
    assert [(r.payload_id, r.distance, r.label) for r in spark.read.parquet(out).collect()] == [(2, 2, f"library:{OKHTTP}@3.12.0..3.14.9")]
    with pytest.raises(storage.StaleStoreError):
        cli.main(["query", path, "0", "--stamp", "other"], spark)
    names_ = {"versions": ("coord string, version string, pos int", [("a:a", "1.0", 0)]), "cached": ("coord string, version string, sig_stamp string, digest string", []), "there": ("coord string, version string, packaging string", [("a:a", "1.0", "aar")])}
    for k, (schema, data) in names_.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / k))
    cli.main(["scrape", *[str(tmp_path / k) for k in names_], "--stamp", "s"], spark)
    assert "ok 1, failed 0" in capsys.readouterr().out
