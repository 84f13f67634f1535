"""Names, readers, window filling, populations and classifier rows on small hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import names
from strandlake.operators import classifier, kmers, population, windows
from strandlake.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_names(spark):
    d = spark.createDataFrame([("/a/pair_1/pair_1_orig_DR.tsv",), ("x/p_syn.gff",), ("p_Syn_gq.txt",), ("notes.md",)], "p string")
    got = [(r.m, r.s) for r in d.select(names.motif_in("p").alias("m"), names.side_in("p").alias("s")).collect()]
    assert got == [("DR", "orig"), ("UNK", "syn"), ("GQ", "syn"), ("UNK", "unk")]
    d = spark.createDataFrame([("a/GCF_1.2.fna.gz", "x/pairs.Homo_sapiens.csv", "euk_nev12"), ("b.fasta", "other.CSV", "phage_1")], "f string, m string, r string")
    got = d.select(names.genome_id("f"), names.dataset_label("m"), names.eval_chunks("r"), names.run_domain("r", {"euk": "Eukaryota"})).collect()
    assert [tuple(r) for r in got] == [("GCF_1.2", "Homo_sapiens", 12, "Eukaryota"), ("b", "other", None, "phage")]
    d = spark.createDataFrame([("a.b.k7.bin03_L10_to_20.support_stats.csv",), ("a.k7.bin03x.support_stats.csv",), ("a.k7.x.support_stats.csv",), ("plain.csv",)], "p string")
    got = [tuple(r.x) for r in d.select(names.support_parts("p").alias("x")).collect()]
    assert got == [("a.b", 7, 3, 10, 20), ("a", 7, 3, None, None), ("a", 7, None, None, None), ("plain", None, None, None, None)]


def test_number_format(spark):
    rng = random.Random(1)
    values = [rng.uniform(-10, 10) * 10 ** rng.randint(-9, 9) for _ in range(300)] + [0.0, 1.0, 100000.0, 999999.5, 1e6, 0.0001, 0.00001, 0.1, math.inf, -math.inf, math.nan]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (6, 8):
        assert [r[0] for r in files.formatted_numbers(d, digits).collect()] == [f"%.{digits}g" % v for v in values]
    assert files.formatted_numbers(spark.createDataFrame([(None, 1)], "v double, n int")).collect() == [("nan", 1)]


def test_sniffed_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seqID,start,end\nc,1,9\n")
    (tmp_path / "b.tsv").write_text("seqID\tstart\tend\tscore\nc 1\t5\t25\t1.5\nc 2\tx\t3\t1\n")
    (tmp_path / "e.txt").write_text("")
    assert [files.delimiter(spark, str(tmp_path / n)) for n in ("a.csv", "b.tsv", "e.txt")] == [",", "\t", "\t"]
    assert rows(files.g4hunter(spark, str(tmp_path / "b.tsv")), "contig", "class", "start", "end", "strand", "score", "length") == [("c 1", "pG4", 5, 25, ".", 1.5, 20)]
    with pytest.raises(ValueError, match="lacks"):
        files.headed(spark, str(tmp_path / "a.csv"), ("seqID", "score"))
    hits = spark.createDataFrame([("r/pair_1/x_orig_DR.tsv", 1, 9), ("r/pair_1/x_orig_DR.tsv", 9, 4), ("r/pair_1/x_orig_DR.gff", 1, 9), ("r/pair_1/readme.txt", 1, 2)], "path string, start long, end long")
    cols = ("pair_id", "which", "motif", "n_hits", "bp_covered")
    assert rows(files.hits_per_file(hits), *cols) == [("pair_1", "orig", "DR", 1, 8), ("pair_1", "orig", "DR", 2, 8)]
    assert rows(files.hits_per_file(hits, one_format=True), *cols) == [("pair_1", "orig", "DR", 2, 8)]


def test_support_and_pair_tables(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "t.k5.bin01_L1_to_9.support_stats.csv").write_text("abundance,nat_cdf_mean,syn_cdf_mean,delta_cdf_mean\n1,0.5,0.75,0.25\n")
    (tmp_path / "t.k6.all.support_stats.csv").write_text("abundance,nat_cdf_mean,syn_cdf_mean,delta_cdf_mean\n2,0.5,0.25,-0.25\n")
    cols = ("tag", "k", "bin", "lo", "hi", "x", "delta")
    assert rows(files.support_tables(spark, str(tmp_path), "t", 5), *cols) == [("t", 5, 1, 1, 9, 1, 0.25)]
    both = files.support_tables(spark, str(tmp_path))
    assert [r.k for r in files.summary_order(both).collect()] == [5, 6]
    spark.range(3).write.parquet(str(tmp_path / "p" / "a"))
    (tmp_path / "p" / "a" / "bad.parquet").write_bytes(b"no table")
    assert files.pair_tables(spark, str(tmp_path / "p" / "a")).count() == 3


def test_filled_windows(spark):
    text = "".join(random.Random(3).choices("ACGT", k=5000))
    c = spark.createDataFrame([("a", text, 10), ("b", "N" * 400 + text[:200], 2), ("c", "ACG", 3), ("d", text, 0), ("e", None, 1), ("f", text[:250], 5)], "name string, seq string, n_windows int")
    got = windows.filled(c, 200, 20, 0.1, 7).withColumn("header", windows.window_header()).collect()
    whole = {r.name: r.seq for r in c.collect()}
    starts = {}
    for r in got:
        assert r.window == whole[r.name][r.start : r.start + r.length] and r.header == f"{r.name}:{r.start + 1}-{r.start + r.length}"
        assert r.relaxed or r.window.count("N") <= 20
        starts.setdefault(r.name, []).append(r.start)
    assert {n: len(s) for n, s in starts.items()} == {"a": 10, "b": 2, "c": 1, "f": 1}
    assert any(r.relaxed for r in got if r.name == "b")
    for own in starts.values():
        own.sort()
        assert all(y > x + 199 + 20 for x, y in zip(own, own[1:]))
    assert sorted(got) == sorted(windows.filled(c.repartition(3), 200, 20, 0.1, 7).withColumn("header", windows.window_header()).collect())


def test_weights_balance(spark):
    e = spark.createDataFrame([(0, "natural", i) for i in range(7)] + [(0, "synthetic", i) for i in range(10, 13)], "bin int, grp string, g int")
    for balance, want in ((None, {"natural": 7, "synthetic": 3}), (("bin",), {"natural": 3, "synthetic": 3})):
        w = population.weights(e, "g", 5, 1, "bin", "grp", balance=balance, seed_by="bin")
        assert {(r.grp, r.rep): r.s for r in w.groupBy("grp", "rep").agg(F.sum("w").alias("s")).collect()} == {(g, i): n for g, n in want.items() for i in range(5)}
        assert w.where(F.col("drawn") != F.when(F.col("grp") == "natural", want["natural"]).otherwise(want["synthetic"])).isEmpty()


def test_small_bins_give_nothing(spark):
    e = spark.createDataFrame([(0, "natural", 1), (0, "synthetic", 2), (1, "natural", 3)], "bin int, grp string, g int")
    s = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.25), (2, 3, 0.5)], "g int, x long, pmf double")
    assert population.spectra_bins(e, s, "g", 4, 1).isEmpty()
    got = population.spectra_bins(e, s, "g", 4, 1, least=1)
    assert rows(got, "bin", "x", "nat_mean", "syn_mean", "delta_lo", "pmf_nat", "pmf_syn") == [(0, 1, 0.5, 0.25, -0.25, 0.5, 0.25), (0, 3, 0.5, 0.75, 0.25, 0.0, 0.5)]
    cells = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 2), (2, 0, 1, 4)], "g int, x long, y long, n long")
    assert rows(population.matrix_bins(e, cells, "g", 4, 1), "bin", "l1", "l1_lo", "l1_hi") == [(0, 1.0, 1.0, 1.0)]


def test_own_k_and_status(spark):
    d = spark.createDataFrame([("p", "orig", "ACGTTGCA" * 9), ("p", "syn", "ACGTAGCA" * 9000), ("q", "orig", "ACGT"), ("r", "orig", ""), ("r", "syn", "")], "pair_id string, which string, seq string")
    got = {r.pair_id: r for r in kmers.pair_metrics_own_k(d).collect()}
    assert (got["p"].k_used, got["p"].status, got["q"].status, got["q"].ks_stat) == (5, "ok", "missing_fasta", None)
    assert (got["r"].k_used, got["r"].status, got["r"].ks_stat) == (5, "ok", None)
    same = kmers.pair_metrics(d.where("pair_id = 'p'"), 5).first()
    assert got["p"].jsd_bits == pytest.approx(same.jsd_bits) and got["p"].L_syn_ACGT == 72000


def test_classifier_rows(spark):
    d = spark.createDataFrame([("acGN",), ("",)], "chunk string")
    assert [r.m for r in d.select(classifier.one_hot().alias("m")).collect()] == [[[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]], [[], [], [], []]]
    p = spark.createDataFrame([("x", "o.fa", "s.fa")], "id string, orig string, syn string")
    assert rows(classifier.labelled(p, "id"), "id", "which", "label", "file") == [("x", "orig", 0, "o.fa"), ("x", "syn", 1, "s.fa")]
    s = spark.createDataFrame([("a", 0, 1, 0.9), ("a", 0, 0, 0.1), ("a", 64, 1, 0.5), ("b", 0, 0, 0.5)], "tag string, distance_bp int, label int, score double")
    got = rows(classifier.distance_rows(s, [0, 64], 0.5), "holdout_tag", "distance_bp", "n_used", "thr", "auc", "acc")
    assert got == [("a", 0, 2, 0.5, 1.0, 1.0), ("a", 64, 1, 0.5, None, None), ("b", 0, 1, 0.5, None, None), ("b", 64, 0, 0.5, None, None)]
    m = classifier.merged({"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([(2, 3)], "a int, b int")})
    assert rows(m.fillna(0), "domain", "a", "b") == [("x", 1, 0), ("y", 2, 3)]


def test_window_query(spark, sf):
    from strandlake.plans import evaluation, genomes

    text = {str(r.doc_id): r.seq for r in genomes.text_dna(spark, sf).collect()}
    got = evaluation.window_sample(spark, sf).collect()
    want = {r.name: r.n_windows for r in windows.allocation(genomes.text_dna(spark, sf).select(F.col("doc_id").cast("string").alias("name"), F.length("seq").alias("length")), 300).collect()}
    n = {}
    for r in got:
        n[r.name] = n.get(r.name, 0) + 1
        assert r.window == text[r.name][r.start : r.start + r.length]
    assert all(k <= want[name] for name, k in n.items()) and sum(n.values()) > 250
