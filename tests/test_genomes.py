"""Golden vectors and DuckDB comparisons of the genome operators."""

import gzip
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import dna, stats
from strandlake.operators import binning, classifier, fcgr, kmers, nonb, nullomers, tfbs, windows
from strandlake.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_kmers_skip_other_letters(spark):
    d = spark.createDataFrame([("a", "ACGTNACG")], "id string, seq string")
    c = kmers.counts(d, 2, "id")
    assert rows(c, "kmer", "n") == [("AC", 2), ("CG", 2), ("GT", 1)]
    assert rows(kmers.pmf(kmers.spectrum(c, "id"), 2), "x", "pmf") == [(1, 1 / 16), (2, 2 / 16)]
    assert rows(kmers.counts(spark.createDataFrame([("a", "ACGT")], "id string, seq string"), 2, canonical=True), "kmer", "n") == [("AC", 2), ("CG", 1)]


def test_kmers_across_pieces_and_short(spark):
    text = "ACGTTGCA" * 60
    d = spark.createDataFrame([("a", text), ("b", "AC"), ("c", ""), ("d", None)], "id string, seq string")
    want = {}
    for i in range(len(text) - 4):
        want[text[i : i + 5]] = want.get(text[i : i + 5], 0) + 1
    assert rows(kmers.counts(d, 5), "kmer", "n") == sorted(want.items())


def test_fcgr_cell(spark):
    d = spark.createDataFrame([("p", "orig", "GATTACAC"), ("p", "syn", "GATTACAC")], "pair_id string, which string, seq string")
    c = fcgr.cells(d, 8, "pair_id", "which")
    assert rows(c, "x", "y") == [(176, 53)] * 2
    assert fcgr.l1(c).first().l1_fcgr == 0


def test_auto_k_and_masks(spark):
    d = spark.createDataFrame([(300000, "ACgt", "chr7 x"), (0, "", "")], "n int, s string, h string")
    got = d.select(dna.auto_k("n").alias("k"), dna.clean("s", True).alias("m"), dna.n_ratio("s").alias("r"), dna.record_id("h").alias("id")).collect()
    assert [tuple(r) for r in got] == [(7, "ACNN", 0.0, "chr7"), (5, "", 1.0, "NA")]


def test_bh_and_fisher(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2), (5, None)], "i int, p double")
    q = {r.i: r.q for r in stats.bh(d, "p", tie=("i",)).collect()}
    assert [q[i] and round(q[i], 4) for i in range(1, 6)] == [0.04, 0.0533, 0.0533, 0.2, None]
    f = spark.createDataFrame([(8, 2, 1, 5), (3, 7, 7, 3)], "a int, b int, c int, d int").select(stats.fisher_two_sided("a", "b", "c", "d").alias("p"))
    assert [round(r.p, 7) for r in f.collect()] == [0.034965, 0.1788954]
    s = spark.createDataFrame([(5, 5, 0.5)], "k int, n int, p double").select(stats.binomial_sf("k", "n", "p").alias("p"))
    assert math.isclose(s.first().p, 1 / 32)


def test_nullomers(spark):
    d = spark.createDataFrame([("p", "orig", k) for k in ("AA", "AC", "CC")] + [("p", "syn", k) for k in ("AC", "CC", "GG")], "pair_id string, which string, seq string")
    r = nullomers.pair_metrics(nullomers.presence(d, 2, canonical=False)).first()
    assert (r.shared_unique, r.missing_in_syn, r.novel_in_syn, r.jaccard) == (2, 1, 1, 0.5)
    assert nullomers.absent(nullomers.presence(d, 2, canonical=False), 2).count() == 12


def test_classifier_metrics(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert classifier.auroc(d).first().auc == 0.875
    t = classifier.best_threshold(d).first()
    assert (t.threshold, round(t.best_f1, 3)) == (0.5, 0.8)
    assert classifier.at_threshold(d, 0.5).first().f1 == pytest.approx(0.8)


def test_callers():
    assert nonb.g4hunter_regions("A" * 30) == [] and nonb.g4hunter_regions("GG") == []
    (region,) = nonb.g4hunter_regions("A" * 20 + "GGGGTTGGGGTTGGGGTTGGGGTT" + "A" * 30)
    assert region[:2] == (20, 42) and region[2] == 64 / 22  # from the first to the last run of G
    assert nonb.zdna_regions("AAAA" + "GC" * 10 + "AAAA")[0][:2] == (4, 25)  # the step from C to the first A counts too
    both = nonb.zdna_regions("GC" * 15 + "A" * 9 + "GC" * 8 + "A" * 40)
    assert [r[2] for r in both] == [204.25, 106.25]


def test_repeats_by_brute_force():
    import random

    rng = random.Random(4)
    comp = str.maketrans("ACGT", "TGCA")
    for _ in range(8):
        s = "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(60))
        s = s[:40] + s[10:24] + "AC" * 7 + s[:12][::-1] + s[20:33][::-1].translate(comp)
        found = nonb.repeat_regions(s)
        for c, a, b, arm in found:
            left, right = s[a : a + arm], s[b - arm : b]
            assert "N" not in left
            assert {"DR": left == right, "IR": left == right[::-1].translate(comp), "MR": left == right[::-1], "STR": all(s[i] == s[i + arm] for i in range(a, b - arm))}[c]
        spans = {(c, a, b) for c, a, b, _ in found}
        for name, least, turn in (("IR", 6, lambda x: x[::-1].translate(comp)), ("MR", 10, lambda x: x[::-1])):
            for i in range(len(s) - least + 1):
                for j in range(i + least, min(i + least + 101, len(s) - least + 1)):
                    if "N" not in s[i : i + least] and s[j : j + least] == turn(s[i : i + least]):
                        assert any(c == name and a <= i and j + least <= b and a + b == i + j + least for c, a, b in spans)


def test_repeat_hits(spark):
    d = spark.createDataFrame([("a", "ACACACACACACGT"), ("b", None)], "id string, seq string")
    assert rows(nonb.call(d, "repeats", "id").where("class = 'STR'"), "id", "start", "end", "score") == [("a", 0, 12, 2.0)]


def test_windows_keep_their_distance(spark):
    d = spark.createDataFrame([("c", i, s) for i, s in enumerate((0, 5, 130, 300))], "name string, try int, start int")
    assert rows(windows.spaced(d, 100, 20), "start") == [(0,), (130,), (300,)]


def test_cut_bins(spark):
    d = spark.createDataFrame([(x,) for x in range(1, 11)], "len int")
    assert {(r.bin, r.L_lo, r.L_hi) for r in binning.cut(d, "len", 2).collect()} == {(0, 1, 5), (1, 5, 11)}
    same = spark.createDataFrame([(7,)] * 4, "len int")
    assert {(r.bin, r.L_lo, r.L_hi) for r in binning.cut(same, "len", 2).collect()} == {(0, 7, 8)}


def test_p_values(spark):
    d = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("b", 0.0)] * 3 + [("c", x) for x in (-1.0, 2.0, 3.0)] + [("d", 1.0)] * 60, "g string, d double")
    two = {r.g: r.p for r in stats.wilcoxon_p(d, "d", "g").collect()}
    assert two["a"] == 2 / 32 and two["b"] == 1.0 and two["c"] == 0.5 and two["d"] < 1e-10
    one = {r.g: (r.p, r.test) for r in stats.location_p(d, "d", 0.0, "g").collect()}
    assert one["a"] == (1 / 32, "wilcoxon") and one["b"][0] == 1.0
    assert {r.g: (r.n, r.k) for r in stats.sign_test(d, "d", "g").collect()}["c"] == (3, 2)
    m = spark.createDataFrame([("a", v, v > 3) for v in range(1, 7)] + [("b", 1, True)] + [("c", 1, k > 1) for k in range(4)], "g string, v int, f boolean")
    p = {r.g: (r.u, r.p) for r in stats.mann_whitney_p(m, "v", F.col("f"), "g").collect()}
    assert p["a"] == (9.0, pytest.approx(0.1)) and p["b"] == (None, None) and p["c"][1] == 1.0
    z = spark.createDataFrame([(0.0,), (1.959964,), (-1.0,), (8.0,)], "z double").select("z", stats.normal_sf("z").alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(r.z / math.sqrt(2)) / 2, rel_tol=2e-7) for r in z)


def test_exact_nulls_by_enumeration():
    from itertools import combinations, product

    for n in (1, 4, 6):
        sums = [sum(k + 1 for k in range(n) if b[k]) for b in product((0, 1), repeat=n)]
        assert all(math.isclose(stats._subset_sums(n)[w], sum(s >= w for s in sums) / 2**n) for w in range(n * (n + 1) // 2 + 1))
    for a, b in ((1, 3), (3, 4), (5, 2)):
        us = [sum(c) - a * (a + 1) // 2 for c in combinations(range(1, a + b + 1), a)]
        assert all(math.isclose(stats._rank_sums(a, b)[u], sum(x >= u for x in us) / len(us)) for u in range(a * b + 1))


def test_motif_p_values_by_enumeration(spark):
    from itertools import product

    x = [[1.5, -2.0, 0.25, -1.0], [0.0, 0.5, -0.75, 1.0], [-1.0, 1.25, 0.5, -2.0]]
    base = (0.3, 0.2, 0.1, 0.4)
    least, tail = tfbs.score_tail(x, base)
    words = [(sum(x[j][c] for j, c in enumerate(w)), math.prod(base[c] for c in w)) for w in product(range(4), repeat=3)]
    assert all(math.isclose(tail[round(s * tfbs.GRAIN) - least], sum(p for t, p in words if t >= s - 1e-9)) for s, _ in words)
    m = spark.createDataFrame([("M", "M", 3, x, 1.0)], "motif_id string, motif_alt_id string, w int, scores array<array<double>>, threshold double")
    d = spark.createDataFrame([("a", "ATCATCNATC"), ("b", "GAT"), ("c", None), ("d", "AT")], "id string, seq string")
    hits = tfbs.scan(d, m, "id", base=base)
    want = []
    for i, seq in (("a", "ATCATCNATC"), ("b", "GAT")):
        for k in range(len(seq) - 2):
            for strand, w in (("+", seq[k : k + 3]), ("-", seq[k : k + 3][::-1].translate(str.maketrans("ACGT", "TGCA")))):
                if "N" not in w and (score := sum(x[j]["ACGT".index(c)] for j, c in enumerate(w))) >= 1:
                    want.append((i, strand, k, score, round(sum(p for t, p in words if t >= score - 1e-9), 9)))
    assert sorted((r.id, r.strand, r.start, r.score, round(r.p_value, 9)) for r in hits.collect()) == sorted(want)


def test_contiguous_bins(spark):
    d = spark.createDataFrame([(x,) for x in (1, 1, 1, 1, 5, 9, 20)], "len int")
    r = rows(binning.contiguous(d, "len", 3), "lo", "hi")
    assert all(b[0] == a[1] + 1 and b[1] >= b[0] for a, b in zip(r, r[1:])) and r[0][0] == 1


def test_fasta_and_motif_files(spark, tmp_path):
    body = ">r1 first\r\nACgt\r\nNN\r\n>r2\n>r3|x y\nAAAA\nCC"
    (tmp_path / "a.fa").write_text(body)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(body)
    got = files.fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")])
    assert rows(got, "record_ix", "record_id", "seq", "eff_len") == sorted([(0, "r1", "ACGTNN", 4), (1, "r2", "", 0), (2, "r3|x", "AAAACC", 6)] * 2)
    assert {r.seq for r in files.joined_records(got).collect()} == {"ACGTNNAAAACC"}
    (tmp_path / "m.meme").write_text("MEME version 4\n\nMOTIF M1 NAME\nletter-probability matrix: alength= 4 w= 2\n 1.0 0.0 0.0 0.0\n 0.0 0.0 0.5 0.5\n")
    m = files.meme(spark, str(tmp_path / "m.meme"))
    assert (m.first().motif_id, m.first().motif_alt_id, m.first().w) == ("M1", "NAME", 2)
    d = spark.createDataFrame([("s", "CCAGCC")], "id string, seq string")
    hits = tfbs.scan(d, files.log_odds(m).withColumn("threshold", F.lit(2.0)), "id")
    assert rows(hits, "strand", "start", "end") == [("+", 2, 4)]


def test_manifest(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,orig,syn\n,a,b\nx,c,d\n")
    m = files.manifest(spark, str(tmp_path / "p.csv"))
    assert rows(m, "row_ix", "id", "orig") == [(1, "pair_001", "a"), (2, "x", "c")]
    assert rows(files.selected_pairs(m, ["1"]), "id") == [("pair_001",)]


def test_intervals(spark, tmp_path):
    (tmp_path / "a.gff").write_text("#c\nchr1\tx\ty\t5\t9\nchr1\tx\ty\tbad\t9\n")
    assert rows(files.intervals(spark, str(tmp_path / "a.gff"), "gff"), "start", "end") == [(5, 9)]


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "if" else str(v)


def test_queries_match_sql(spark, sf, duck):
    from strandlake.plans import evaluation, scale

    queries = evaluation.QUERIES | scale.QUERIES
    for name, sql in (evaluation.ORACLE_SQL | scale.ORACLE_SQL).items():
        a, b = queries[name](spark, sf).toPandas(), duck.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        table = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))  # noqa: B023,E731
        assert table(a) == table(b), name


def test_rows_only_queries(spark, sf):
    """Those without SQL: the repeat finder is tested against brute force in test_scale."""
    from strandlake.plans import genomes

    want = {}
    for r in genomes.md5_dna(spark, sf).collect():
        want |= {(r.pair_id, r.which, c): [0, 0] for c in ("DR", "IR", "MR", "STR")}
        for c, a, b, _ in nonb.repeat_regions(r.seq):
            want[r.pair_id, r.which, c][0] += 1
            want[r.pair_id, r.which, c][1] += b - a
    assert rows(genomes.repeat_metrics(spark, sf), "pair_id", "which", "motif", "n_hits", "bp_covered") == sorted((*k, *v) for k, v in want.items())
    volcano = genomes.motif_enrichment(spark, sf).collect()
    hits = genomes.motif_scan(spark, sf)
    assert sum(r.hits_orig + r.hits_syn for r in volcano) == hits.count()


def test_entry_without_llm(tmp_path):
    """The rest imports and registers its queries once both folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "strandlake"), tmp_path / "strandlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert len(q) > 60 and set(e.oracle_sql()) <= q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_streaming_counts(spark, sf, tmp_path):
    from strandlake.streaming import hits

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = hits.windowed_counts(s, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hits").agg(F.sum("n")).first()[0] == e.count()
