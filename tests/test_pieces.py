"""Steps that hold a piece of a table at a time, and what they have to agree with."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.operators import kmers, superkmers, tfbs
from strandlake.plans import evaluation, genomes
from strandlake.sources import files


def test_pieces_are_bounded():
    rng = np.random.default_rng(1)
    rows = ["", None, "AC", *("".join(rng.choice(list("ACGTN"), n)) for n in (5, 100, 101, 350, 99, 1)), ""]
    seen = Counter()
    for row, start, own, base, first in kmers.pieces(pa.array(rows), 3, 100):
        assert len(base) <= 103 and first[-1] == len(base)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            text = (rows[row + i] or "")[start : start + b - a]
            assert "".join("ACGTN"[x] for x in base[a:b]) == text
            seen.update((row + i, start + j) for j in range(b - a - 3))
    assert seen == Counter((i, j) for i, t in enumerate(rows) for j in range(len(t or "") - 3))
    own = [(start, own) for _, start, own, *_ in kmers.pieces(pa.array(["A" * 250]), 3, 100)]
    assert own == [(0, 100), (100, 100), (200, 50)]


def test_long_sequences_are_counted_and_scanned_in_pieces(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("ACGT", k=2 * kmers.PIECE_LETTERS + 77))
    cut = kmers.PIECE_LETTERS
    long = long[: cut - 3] + "GGGGGGA" + long[cut + 4 :]
    rows = [("a", "x", long), ("a", "y", "ACGTNACG"), ("b", "x", long[:50]), (None, "y", "ACGTT"), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, h string, seq string")
    for k, by in ((5, ("g",)), (5, ("g", "h")), (31, ("g",)), (4, ())):
        want = Counter()
        for g, h, s in rows:
            key = tuple({"g": g, "h": h}[c] for c in by)
            want.update((*key, s[i : i + k]) for i in range(len(s or "") - k + 1) if "N" not in s[i : i + k])
        assert {tuple(r)[:-1]: r.n for r in kmers.counts(df, k, *by).collect()} == want
        if k == 5:
            assert {tuple(r)[:-1]: r.n for r in superkmers.counts(df, k, *by).withColumn("kmer", kmers.kmer_of(F.col("code"), k)).select(*by, "kmer", "n").collect()} == want
    motif = lambda w, t: ("M", "M", len(w), [[1.0 if c == b else -1.0 for b in "ACGT"] for c in w], float(t))
    motifs = spark.createDataFrame([motif("GGGGGGA", 7), ("S", "S", 2, motif("GA", 2)[3], 2.0)], "motif_id string, motif_alt_id string, w int, scores array<array<double>>, threshold double")
    hits = tfbs.scan(df.where("h = 'x' AND g = 'a'"), motifs, "g").where("strand = '+'").groupBy("motif_id").agg(F.count("*").alias("n"), F.count_distinct("start").alias("m"), F.min("start").alias("a")).collect()
    want = {"M": long.count("GGGGGGA"), "S": long.count("GA")}
    assert {r.motif_id: (r.n, r.m) for r in hits} == {k: (n, n) for k, n in want.items()}
    assert {r.motif_id: r.a for r in hits} == {"M": long.index("GGGGGGA"), "S": long.index("GA")}


def test_support_stats_meet_no_grid_of_pairs(spark):
    rng = random.Random(3)
    for pairs in (1, 2, 7, 41):
        spec = {p: {x: (rng.randint(0, 9) / 64, rng.randint(0, 9) / 64) for x in rng.sample([1, 2, 3, 5, 8, 400], rng.randint(1, 5))} for p in range(pairs)}
        rows = []
        for p, values in spec.items():
            cp = cq = 0.0
            for x in sorted(values):
                cp, cq = cp + values[x][0], cq + values[x][1]
                rows.append((f"p{p}", x, *values[x], cp, cq))
        support = spark.createDataFrame(rows, "pair_id string, x long, p double, q double, cp double, cq double")
        got = kmers.support_stats(support)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "Join Cross" not in plan
        got, means = {r.x: r for r in got.collect()}, {r.x: r for r in kmers.support_means(support).collect()}
        xs = sorted({x for values in spec.values() for x in values})
        assert sorted(got) == sorted(means) == xs
        for x in xs:
            full = {c: [] for c in kmers.MEASURES}
            for values in spec.values():
                p, q = values.get(x, (0.0, 0.0))
                cp, cq = (sum(v[i] for y, v in values.items() if y <= x) for i in (0, 1))
                for c, v in zip(kmers.MEASURES, (p, q, cp, cq, cq - cp), strict=True):
                    full[c].append(v)
            for c, v in full.items():
                assert math.isclose(means[x][f"{c}_mean"], np.mean(v), abs_tol=1e-12)
                for end, want in (("mean", np.mean(v)), ("lo", np.quantile(v, 0.025)), ("hi", np.quantile(v, 0.975))):
                    assert math.isclose(got[x][f"{c}_{end}"], want, abs_tol=1e-12)


def test_general_format_rounds_exact_values(spark):
    values = [n / 1e10 for n in range(10_000_005, 10_004_000, 10)] + [1.234565, 0.5, 2.5e-7, 1234565.0, 1e16, -0.0, -1.234575e-5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", files.general_format(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: "%.6g" % (v + 0.0) for v in values}


def test_enrichment_beyond_doubles(spark):
    counts = spark.createDataFrame([("a", 49177, 18721), ("b", 49252, 53658)], "motif_key string, hits_orig long, hits_syn long")
    assert {(r.p, r.neglog10_p) for r in tfbs.enrichment(counts, least_p=0.0).collect()} == {(0.0, math.inf)}
    assert {r.p for r in tfbs.enrichment(counts).collect()} == {1e-300}


def test_counting_steps_make_letters_of_texts_themselves(spark, tmp_path):
    """One Python worker a task, in slices, with the rows of sequences made beforehand."""
    rng = random.Random(5)
    letter = lambda n: "".join(rng.choices("abcdefgh xyzéİKAG", k=n))
    rows = [(i, "en" if i % 3 else None, "web", n, letter(n)) for i, n in enumerate((0, 3, 5, 40, 700, 90, 2000, 11))] + [(8, "en", "web", 0, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    args = spark, str(tmp_path)
    workers = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    for query, most in ((genomes.kmer_counts, 1), (genomes.kmers_absent, 1), (genomes.tail_masses, 1), (genomes.spectrum_quantiles, 1), (evaluation.spectra_bin_summary, 2), (evaluation.spectra_significance, 6), (genomes.fcgr_pair_l1, 4)):
        assert workers(query(*args)) <= most, query.__name__
    raw, made = genomes.texts(*args), genomes.text_dna(*args)
    sorted_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert sorted_rows(kmers.code_counts(raw, 4, "doc_id", lettered=genomes.lettered)) == sorted_rows(kmers.code_counts(made, 4, "doc_id"))
    for f in (superkmers.counts, superkmers.spectra):
        for part in (100, superkmers.PART_LETTERS):
            assert sorted_rows(f(raw, 4, "grp", part_letters=part, lettered=genomes.lettered)) == sorted_rows(f(made, 4, "grp"))
    assert sorted_rows(superkmers.joint_spectrum(raw, 4, lettered=genomes.lettered)) == sorted_rows(superkmers.joint_spectrum(made, 4))


def test_batches_come_in_few_bytes():
    rows = ["", None, "abc", "x" * 50, "y" * 9, "z" * 8, "é" * 3, ""]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(rows))), "t": pa.array(rows)})
    upper = lambda a: pa.array([None if t is None else t.upper() for t in a.to_pylist()], a.type)
    got = list(kmers.few([batch.slice(1), batch], "t", upper, 20))
    assert [r for b in got for r in b.to_pylist()] == [{"i": i, "t": t and t.upper()} for i, t in [*enumerate(rows)][1:] + [*enumerate(rows)]]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("t").to_pylist()) <= 20 for b in got)


def test_scans_make_sequences_of_digests_themselves(spark, tmp_path):
    """No sequence reaches a scanning worker: it gets ids and sizes, and makes sequences a few at a time."""
    rows = [(0, 0), (1, 31), (2, 32), (3, 3000), (1234567, 95), (-5, 64), (-6, 7), (8, 2_000_000), (9, 5), (10, None)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    args = spark, str(tmp_path)
    made = genomes.md5_dna(*args)
    for query in (genomes.motif_hits, genomes.motif_scan):
        assert "md5(" not in query(*args)._jdf.queryExecution().optimizedPlan().toString(), query.__name__
    want = {r.doc_id: r.seq for r in made.collect()}
    batch = pa.RecordBatch.from_pylist([{"i": i, "s": {"doc_id": i, "n_chars": n}} for i, n in rows])
    got = [b for part in (batch.slice(3), batch.slice(0, 3)) for b in genomes.digested([part], "s")]
    assert [b.column("i").to_pylist() for b in got] == [[3, 1234567, -5, -6], [8], [9, 10], [0, 1, 2]]
    assert {r["i"]: r["s"] for b in got for r in b.to_pylist()} == want
    sorted_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for keep in (("doc_id",), ("pair_id", "which")):
        scans = [tfbs.scan(d, genomes._scanned(spark), *keep, site_p=genomes.SITE_P, **how) for d, how in ((made, {}), (genomes.md5_ids(*args), {"made": genomes.digested}))]
        assert sorted_rows(scans[0]) == sorted_rows(scans[1])


def test_spectra_significance_counts_letters_once(spark, sf):
    """Its tests read one number a pair three times, and don't count letters again for each."""
    assert "MapInArrow" not in evaluation.spectra_significance(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
