"""Registered queries over populations, distances and classifier runs, on the same derived sequences and scores as the genome queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, stats
from ..functions.shared import settled
from ..operators import binning, classifier, fcgr, kmers, nonb, nullomers, population, windows
from ..sources import files
from .genomes import BIN_SQL, ORACLE_SQL, QUERIES, CELL_SQL, GQ, KM_SQL, MD5_SQL, RC, SCORE_SQL, SPEC_SQL, TEXT_SQL, THR_SQL, K, _binned, _nonb, _spectra, _tests, joint, lettered, md5_dna, query, rounded, scores, sf_sql, stats_sql, text_dna, texts

__all__ = ["ORACLE_SQL", "QUERIES"]  # those of the genome queries and of these

REPS, SEED = 20, 11
#: Added before rounding: means of whole numbers over powers of two would end on a half.
OFF = 3e-12


def draw_sql(*key: str) -> str:
    parts = ", ':', ".join(f"({k})::varchar" for k in key)
    return f"('0x'||substr(md5(concat({parts})),1,8))::BIGINT"


def location_sql(table: str, value: str, delta: float) -> str:
    """The table lp with mean, median, n and the one-sided signed-rank p (normal curve) of a table's column."""
    z = "CASE WHEN z>=0 THEN {} ELSE 1-{} END".format(sf_sql("abs(z)"), sf_sql("abs(z)"))
    return f"""lz AS (SELECT {value}-{delta}::DOUBLE AS d FROM {table} WHERE {value} IS NOT NULL), lr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d))-1)/2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM lz WHERE d<>0),
lw AS (SELECT count(*) AS m, (coalesce(sum(r) FILTER (d>0),0)-count(*)*(count(*)+1)/4)/sqrt(count(*)*(count(*)+1)*(2*count(*)+1)/24-sum(t*t-1)/48) AS z FROM lr),
lp AS (SELECT (SELECT count(*) FROM lz) AS n, (SELECT avg({value}) FROM {table}) AS mean, (SELECT median({value}) FROM {table}) AS median, CASE WHEN m=0 THEN 1.0 WHEN z=0 THEN 0.5 ELSE {z} END AS p, 'wilcoxon' AS test FROM lw)"""


OWN_SQL = f"""{TEXT_SQL}, le AS (SELECT pair_id, sum(length(replace(seq,'N',''))) FILTER (which='orig') AS lo, sum(length(replace(seq,'N',''))) FILTER (which='syn') AS ls FROM g GROUP BY pair_id),
kk AS (SELECT *, CASE WHEN lo IS NULL OR ls IS NULL THEN NULL WHEN least(lo,ls)>0 THEN greatest(5, least(15, ceil(0.7*ln(least(lo,ls))/ln(4.0)))) ELSE 5 END::INT AS k FROM le),
pc AS (SELECT pair_id, which, k, substr(seq, (j*128+1)::INT, 127+k) AS pc FROM (SELECT * FROM g JOIN kk USING (pair_id) WHERE k IS NOT NULL), unnest(range(0, (length(seq)+127)//128)) t(j)),
km AS (SELECT * FROM (SELECT pair_id, which, k, substr(pc, i::INT, k) AS kmer FROM pc, unnest(range(1, length(pc)-k+2)) t(i)) WHERE NOT contains(kmer,'N')),
c AS (SELECT pair_id, which, k, kmer, count(*) AS n FROM km GROUP BY ALL), sp AS (SELECT pair_id, which, n AS x, count(*)/pow(4.0::DOUBLE, k) AS pmf FROM c GROUP BY pair_id, which, k, n)"""


@query(f"""WITH {OWN_SQL}, su AS (SELECT pair_id, x, coalesce(sum(pmf) FILTER (which='orig'),0) AS p, coalesce(sum(pmf) FILTER (which='syn'),0) AS q FROM sp GROUP BY ALL),
s2 AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM su WINDOW w AS (PARTITION BY pair_id ORDER BY x ROWS UNBOUNDED PRECEDING)),
cl AS (SELECT *, least(1.0, greatest(1e-12, p)) / sum(least(1.0, greatest(1e-12, p))) OVER w AS a, least(1.0, greatest(1e-12, q)) / sum(least(1.0, greatest(1e-12, q))) OVER w AS b FROM s2 WINDOW w AS (PARTITION BY pair_id)),
ds AS (SELECT pair_id, max(abs(cp-cq)) AS ks, (sum(a*log2(a/((a+b)/2))) + sum(b*log2(b/((a+b)/2))))/2 AS js, sum(abs(cp-cq)) AS em FROM cl GROUP BY pair_id)
SELECT pair_id, k AS k_used, lo::BIGINT AS "L_orig_ACGT", ls::BIGINT AS "L_syn_ACGT", CASE WHEN k IS NULL THEN 'missing_fasta' ELSE 'ok' END AS status, round(ks,6) AS ks_stat, round(js,6) AS jsd_bits, round(em,6) AS emd_l1cdf FROM kk LEFT JOIN ds USING (pair_id)""")
def pair_metrics_own_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kmers.pair_metrics_own_k(text_dna(spark, sf)))


#: Genomes of each bin with their places, and the draws of each replicate.
DRAWN_SQL = f"""ok AS (SELECT bin, count(*) FILTER (grp='natural') AS n_natural, count(*) FILTER (grp='synthetic') AS n_synthetic FROM b GROUP BY bin HAVING n_natural>=5 AND n_synthetic>=5),
ent AS (SELECT doc_id, bin, grp, n_natural, n_synthetic, row_number() OVER (PARTITION BY bin, grp ORDER BY doc_id)-1 AS i, CASE grp WHEN 'natural' THEN n_natural ELSE n_synthetic END AS n FROM b JOIN ok USING (bin)),
rp AS (SELECT bin, grp, rep, i AS place, n, n_natural, n_synthetic, {draw_sql(f"{SEED}+bin", "rep", "i")} % n AS i FROM ent CROSS JOIN range(0,{REPS}) t(rep))"""


@query(f"""WITH {TEXT_SQL}, {KM_SQL}, {BIN_SQL}, {DRAWN_SQL}, c AS (SELECT doc_id, kmer, count(*) AS n FROM km GROUP BY ALL), sp AS (SELECT doc_id, n AS x, count(*) / {float(4**K)} AS pmf FROM c WHERE n<=500 GROUP BY ALL),
m AS (SELECT rp.bin, rp.grp, rep, x, sum(pmf)/any_value(least(rp.n_natural, rp.n_synthetic)) AS m FROM rp JOIN ent e ON rp.bin=e.bin AND rp.grp=e.grp AND rp.i=e.i JOIN sp ON sp.doc_id=e.doc_id WHERE place<least(rp.n_natural, rp.n_synthetic) GROUP BY rp.bin, rp.grp, rep, x),
pt AS (SELECT bin, x, any_value(n_natural) AS n_natural, any_value(n_synthetic) AS n_synthetic, coalesce(sum(pmf) FILTER (grp='natural'),0)/any_value(n_natural) AS pn, coalesce(sum(pmf) FILTER (grp='synthetic'),0)/any_value(n_synthetic) AS ps FROM ent JOIN sp USING (doc_id) GROUP BY bin, x),
gr AS (SELECT pt.bin, pt.x, t.rep, coalesce(a.m,0) AS a, coalesce(s.m,0) AS s FROM pt CROSS JOIN range(0,{REPS}) t(rep) LEFT JOIN m a ON a.grp='natural' AND a.bin=pt.bin AND a.x=pt.x AND a.rep=t.rep LEFT JOIN m s ON s.grp='synthetic' AND s.bin=pt.bin AND s.x=pt.x AND s.rep=t.rep),
cd AS (SELECT bin, x, sum(a) OVER w AS nat, sum(s) OVER w AS syn FROM gr WINDOW w AS (PARTITION BY bin, rep ORDER BY x ROWS UNBOUNDED PRECEDING)), c3 AS (SELECT *, syn-nat AS delta FROM cd),
ci AS (SELECT bin, x, {", ".join(f"avg({v}) AS {v}_mean, quantile_cont({v},0.025) AS {v}_lo, quantile_cont({v},0.975) AS {v}_hi" for v in ("nat", "syn", "delta"))} FROM c3 GROUP BY ALL)
SELECT bin, x, n_natural, n_synthetic, {", ".join(f"round({v}_{s}+{OFF}::DOUBLE,9) AS {v}_{s}" for v in ("nat", "syn", "delta") for s in ("mean", "lo", "hi"))}, round(pn+{OFF}::DOUBLE,9) AS pmf_nat, round(ps+{OFF}::DOUBLE,9) AS pmf_syn FROM ci JOIN pt USING (bin, x)""")
def spectra_bins(spark: SparkSession, sf: str) -> DataFrame:
    s = population.spectra_bins(_binned(spark, sf), _spectra(spark, sf, "doc_id"), "doc_id", REPS, SEED)
    return s.select(*(F.round(F.col(c) + OFF, 9).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


@query(f"""WITH {TEXT_SQL}, {KM_SQL}, {BIN_SQL}, {DRAWN_SQL}, c AS (SELECT doc_id, kmer, count(*) AS n FROM km GROUP BY ALL), pr AS (SELECT doc_id, kmer, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c),
d AS (SELECT bin, kmer, abs(coalesce(sum(p) FILTER (grp='natural'),0)/any_value(n_natural)-coalesce(sum(p) FILTER (grp='synthetic'),0)/any_value(n_synthetic)) AS d FROM ent JOIN pr USING (doc_id) GROUP BY ALL),
w AS (SELECT rp.bin, rp.grp, rep, e.doc_id, any_value(e.n_natural) AS n_natural, any_value(e.n_synthetic) AS n_synthetic, count(*) AS w FROM rp JOIN ent e ON rp.bin=e.bin AND rp.grp=e.grp AND rp.i=e.i GROUP BY rp.bin, rp.grp, rep, e.doc_id),
r AS (SELECT bin, rep, kmer, abs(coalesce(sum(p*w) FILTER (grp='natural'),0)/any_value(n_natural)-coalesce(sum(p*w) FILTER (grp='synthetic'),0)/any_value(n_synthetic)) AS d FROM w JOIN pr USING (doc_id) GROUP BY ALL),
r2 AS (SELECT bin, rep, sum(d) AS d FROM r GROUP BY ALL) SELECT bin, n_natural, n_synthetic, round(l1,6) AS l1, round(lo_,6) AS l1_lo, round(hi_,6) AS l1_hi FROM ok JOIN (SELECT bin, sum(d) AS l1 FROM d GROUP BY bin) USING (bin) JOIN (SELECT bin, quantile_cont(d,0.025) AS lo_, quantile_cont(d,0.975) AS hi_ FROM r2 GROUP BY bin) USING (bin)""")
def matrix_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(population.matrix_bins(_binned(spark, sf), fcgr.cells(text_dna(spark, sf), K, "doc_id"), "doc_id", REPS, SEED, least=5))


@query(f"""WITH {TEXT_SQL}, {KM_SQL}, {CELL_SQL}, dd AS (SELECT pair_id, x, y, sum(CASE WHEN which='orig' THEN p ELSE -p END) AS d FROM pr GROUP BY ALL), v AS (SELECT pair_id, round(sum(abs(d)),9) AS v, row_number() OVER (ORDER BY pair_id)-1 AS i, count(*) OVER () AS n FROM dd GROUP BY pair_id), {location_sql("v", "v", 1.8)},
md AS (SELECT rep, median(o.v) AS m FROM (SELECT rep, {draw_sql(str(SEED), "rep", "i")} % n AS i FROM v CROSS JOIN range(0,{REPS}) t(rep)) d JOIN v o ON o.i=d.i GROUP BY rep),
fl AS (SELECT rep, avg(CASE WHEN {draw_sql(str(SEED), "rep", "i")} % 2 = 0 THEN v ELSE -v END) AS m FROM v CROSS JOIN range(0,50) t(rep) GROUP BY rep)
SELECT n, round(mean,6) AS mean, round(median,6) AS median, round(p,9) AS p, test, (SELECT round(quantile_cont(m,0.025),6) FROM md) AS median_lo, (SELECT round(quantile_cont(m,0.975),6) FROM md) AS median_hi, round(((SELECT count(*) FROM fl WHERE abs(m)>=abs(mean)-1e-12)+1)/51,6) AS p_signflip FROM lp""")
def fcgr_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = rounded(fcgr.joint_l1(joint(spark, sf)), 9)
    return _tests(population.dataset_summary(d, "l1_fcgr", "pair_id", REPS, 50, SEED, 1.8))


@query(f"""WITH {TEXT_SQL}, {KM_SQL}, {SPEC_SQL}, ks AS (SELECT pair_id, round(max(abs(cp-cq)),9) AS ks FROM s2 GROUP BY pair_id), {location_sql("ks", "ks", 0.05)}
SELECT n, round(mean,6) AS mean, round(median,6) AS median, round(p,9) AS p, test FROM lp""")
def spectra_significance(spark: SparkSession, sf: str) -> DataFrame:
    d = kmers.distances(kmers.paired_support(_spectra(spark, sf, "pair_id", "which")))
    d = settled(d.select(F.round("ks_stat", 9).alias("ks_stat")))  # one number a pair; the tests read it three times
    return _tests(stats.location_p(d, "ks_stat", 0.05))


@query(f"""WITH {TEXT_SQL}, {KM_SQL}, {SPEC_SQL}, d AS (SELECT pair_id, x, round(cq-cp,9) AS d FROM s2),
a AS (SELECT pair_id, arg_max(d, x) AS dc, avg(d) FILTER (x<=3) AS em, avg((d>0)::INT) FILTER (x<=3) AS ep, avg(d) AS md FROM d GROUP BY pair_id)
SELECT pair_id, dc AS delta_coverage, round(em,6) AS early_mean, round(ep,6) AS early_positive, (SELECT x FROM d WHERE d.pair_id=a.pair_id ORDER BY d DESC, x LIMIT 1) AS x_max, (SELECT x FROM d WHERE d.pair_id=a.pair_id ORDER BY d, x LIMIT 1) AS x_min, round(md,6) AS mean_delta, em>0 AND dc<0 AS crosses, CASE WHEN ep>=0.7 THEN 'mostly positive' WHEN ep<=0.3 THEN 'mostly negative' ELSE 'mixed' END AS verdict FROM a""")
def spectra_bin_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = kmers.paired_support(_spectra(spark, sf, "pair_id", "which")).withColumn("delta", F.round(F.col("cq") - F.col("cp"), 9))
    r = kmers.bin_summary(s, 3, "pair_id").withColumn("verdict", kmers.verdict(F.col("early_positive")))
    return r.select("pair_id", "delta_coverage", *(F.round(c, 6).alias(c) for c in ("early_mean", "early_positive")), "x_max", "x_min", F.round("mean_delta", 6).alias("mean_delta"), "crosses", "verdict")


NULLOMER_BINS = f"""nu AS (SELECT b.doc_id, b.grp, b.bin, ({4**K}-count(DISTINCT least(kmer,{RC})))/{float(4**K)} AS value FROM b LEFT JOIN km ON km.doc_id=b.doc_id GROUP BY b.doc_id, b.grp, b.bin),
gt AS (SELECT bin, min(n) AS m FROM (SELECT bin, grp, count(*) AS n FROM nu GROUP BY ALL) GROUP BY bin HAVING count(*)=2 AND min(n)>=10),
ev AS (SELECT * FROM (SELECT nu.*, gt.m, row_number() OVER (PARTITION BY nu.bin, grp ORDER BY md5(concat('{SEED}:', doc_id::varchar)), doc_id) AS rn FROM nu JOIN gt ON nu.bin=gt.bin) WHERE rn<=m)"""


@query(f"WITH {TEXT_SQL}, {KM_SQL}, {BIN_SQL}, {NULLOMER_BINS}, {stats_sql('bin')}")
def nullomer_bin_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = nullomers.fractions(texts(spark, sf), [K], "doc_id", lettered=lettered).select("doc_id", F.col("nullomer_fraction").alias("value"))
    return _tests(binning.bin_stats(_binned(spark, sf).select("doc_id", "grp", "bin").join(n, "doc_id"), "value", "doc_id", REPS, SEED, "bin"))


@query(f"""WITH {MD5_SQL}, h AS (SELECT which, 'GQ' AS motif, len({GQ}) AS v FROM m UNION ALL SELECT which, 'STR', len(regexp_extract_all(seq,'((?:AC){{3,}})',1)) FROM m)
SELECT which, motif, count(*) AS n, min(v)::DOUBLE AS low, quantile_cont(v,0.25)::DOUBLE AS q1, quantile_cont(v,0.5)::DOUBLE AS middle, quantile_cont(v,0.75)::DOUBLE AS q3, max(v)::DOUBLE AS high FROM h GROUP BY ALL""")
def nonb_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return nonb.quartiles(_nonb(spark, sf), "n_hits", "which", "motif")


@query(f"WITH {TEXT_SQL}, c AS (SELECT doc_id, substr(seq,1,64) AS chunk FROM g WHERE length(seq)>=64) SELECT doc_id, {', '.join(f'''translate(chunk,'ACGTN','{''.join('1' if i == j else '0' for j in range(5))}') AS {b}''' for i, b in enumerate('acgt'))} FROM c")
def one_hot_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = classifier.fixed_chunks(text_dna(spark, sf), 64, [0], "doc_id").withColumn("_m", classifier.one_hot())
    return c.select("doc_id", *(F.array_join(F.get("_m", F.lit(i)).cast("array<string>"), "").alias(b) for i, b in enumerate("acgt")))


@query(f"""WITH {SCORE_SQL}, t AS (SELECT tag, (n_chars%7*256)::INT AS distance_bp, label, score FROM s), gr AS (SELECT tag, d::INT AS distance_bp FROM (SELECT DISTINCT tag FROM t) CROSS JOIN (VALUES (0),(256),(512),(4096)) v(d)),
r AS (SELECT *, rank() OVER (PARTITION BY tag, distance_bp ORDER BY score)+(count(*) OVER (PARTITION BY tag, distance_bp, score)-1)/2 AS r FROM t),
a AS (SELECT tag, distance_bp, count(*) FILTER (label=1) AS np, count(*) FILTER (label=0) AS nn, sum(r) FILTER (label=1) AS sr, count(*) FILTER (score>=0.5 AND label=1) AS tp, count(*) FILTER (score>=0.5 AND label=0) AS fp, count(*) FILTER (score<0.5 AND label=1) AS fn, count(*) FILTER (score<0.5 AND label=0) AS tn FROM r GROUP BY ALL),
k AS (SELECT *, np>0 AND nn>0 AS two FROM a)
SELECT gr.tag AS holdout_tag, gr.distance_bp, round(CASE WHEN two THEN (sr-np*(np+1)/2)/(np*nn) END,6) AS auc, round(CASE WHEN two THEN (tp+tn)/(np+nn) END,6) AS acc, round(CASE WHEN two THEN CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END END,6) AS f1,
round(CASE WHEN two THEN CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END END,6) AS precision, round(CASE WHEN two THEN CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END END,6) AS recall, 0.5::DOUBLE AS thr, coalesce(np+nn,0) AS n_used FROM gr LEFT JOIN k ON gr.tag=k.tag AND gr.distance_bp=k.distance_bp""")
def distance_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf).withColumn("distance_bp", F.col("n_chars") % 7 * 256)
    return rounded(classifier.distance_rows(s, [0, 256, 512, 4096], 0.5))


ALLOW = [("src0", "en"), ("src0", "de"), ("src1", "fr")]


@query("SELECT doc_id, source AS domain, lang AS tag FROM documents WHERE (source='src0' AND lang IN ('en','de')) OR (source='src1' AND lang='fr') OR source NOT IN ('src0','src1')")
def allowed_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("domain"), F.col("lang").alias("tag"))
    return classifier.allowed(d, spark.createDataFrame(ALLOW, "domain string, tag string"))


@query(f"""WITH {SCORE_SQL}, r AS (SELECT CASE WHEN item_id%2=0 THEN 'Eukaryota' ELSE 'phage' END AS domain, (n_chars%4+1)::INT AS n_eval_chunks, tag AS holdout_tag, score FROM s WHERE n_chars%5>0)
SELECT domain, n_eval_chunks, round(avg(score),6) AS mean_metric, round(stddev_samp(score),6) AS std_metric, count(DISTINCT holdout_tag) AS n_tags FROM r GROUP BY ALL""")
def eval_chunk_curve(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("n_chars") % 5 > 0, F.concat(F.lit("_nev"), (F.col("n_chars") % 4 + 1).cast("string"))).otherwise("")
    runs = scores(spark, sf).select(F.concat(F.when(F.col("item_id") % 2 == 0, "euk").otherwise("phage"), F.lit("_run"), n).alias("run_id"), F.col("tag").alias("holdout_tag"), "score")
    named = runs.select(names.run_domain("run_id", {"euk": "Eukaryota"}).alias("domain"), names.eval_chunks("run_id").alias("n_eval_chunks"), "holdout_tag", "score")
    return rounded(classifier.by_chunk_count(named, "score"))


@query(f"""WITH {SCORE_SQL}, {THR_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY tag ORDER BY score)+(count(*) OVER (PARTITION BY tag, score)-1)/2 AS r FROM s),
a AS (SELECT tag, round((sum(r) FILTER (label=1)-count(*) FILTER (label=1)*(count(*) FILTER (label=1)+1)/2)/nullif(count(*) FILTER (label=1)*count(*) FILTER (label=0),0),9) AS auc FROM r GROUP BY tag), f AS (SELECT tag, auc, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1, (tp+tn)/(tp+fp+fn+tn) AS acc FROM a JOIN c USING (tag))
SELECT round(avg(auc),6) AS mean_auc, round(avg(f1),6) AS mean_f1, round(avg(acc),6) AS mean_acc, round(min(auc),6) AS min_auc, (SELECT tag FROM f WHERE auc IS NOT NULL ORDER BY auc, tag LIMIT 1) AS worst_tag, count(DISTINCT tag) AS n_tags FROM f""")
def loto_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    a = classifier.auroc(s, "tag").select("tag", F.round("auc", 9).alias("auc"))
    return rounded(classifier.fold_summary(a.join(classifier.at_threshold(s, 0.5, "tag"), "tag").withColumnRenamed("tag", "holdout_tag")))


@query(f"""WITH {SCORE_SQL}, a AS (SELECT item_id, tag, row_number() OVER (PARTITION BY tag ORDER BY item_id) AS r FROM s), b AS (SELECT tag, label, row_number() OVER (PARTITION BY tag ORDER BY md5(concat('5:', item_id::varchar)), item_id) AS r FROM s)
SELECT item_id, a.tag, label FROM a JOIN b ON a.tag=b.tag AND a.r=b.r""")
def shuffled_labels(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.shuffled_labels(scores(spark, sf).select("item_id", "tag", "label"), 5)


@query(f"""WITH {TEXT_SQL}, l AS (SELECT doc_id, length(seq) AS n FROM g WHERE length(seq)>0), p AS (SELECT doc_id, n, repeat(seq, CASE WHEN length(seq)<100 THEN ceil(100.0/length(seq))::INT ELSE 1 END) AS q FROM g JOIN l USING (doc_id)),
z AS (SELECT doc_id, CASE WHEN n<100 THEN substr(q,1,100) ELSE q END AS q, j AS chunk_ix FROM p CROSS JOIN range(0,3) t(j)), a AS (SELECT doc_id, chunk_ix, q, ({draw_sql("9", "doc_id", "chunk_ix")} % (length(q)-99))::INT AS start FROM z)
SELECT doc_id, chunk_ix::INT AS chunk_ix, start, substr(q, start+1, 100) AS chunk FROM a""")
def sampled_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.sampled_chunks(text_dna(spark, sf), 100, 3, 9, "doc_id")


@query(f"WITH {TEXT_SQL}, {KM_SQL}, {CELL_SQL}, d AS (SELECT pair_id, x, y, sum(CASE WHEN which='orig' THEN p ELSE -p END) AS d FROM pr GROUP BY ALL), l AS (SELECT pair_id, round(sum(abs(d)),9)/1000 AS v FROM d GROUP BY pair_id) SELECT pair_id, printf('%.6g', v) AS l1 FROM l")
def formatted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = rounded(fcgr.joint_l1(joint(spark, sf)), 9)
    return files.formatted_numbers(d.select("pair_id", (F.col("l1_fcgr") / 1000).alias("l1")))


@query()
def window_sample(spark: SparkSession, sf: str) -> DataFrame:
    """300 windows over all contigs: their shares by length, filled at places drawn from the seed."""
    c = text_dna(spark, sf).select(F.col("doc_id").cast("string").alias("name"), "seq")
    n = windows.allocation(c.select("name", F.length("seq").alias("length")), 300).select("name", "n_windows")
    w = windows.filled(c.join(F.broadcast(n.where("n_windows > 0")), "name"), 200, 20, 0.25, 5)  # 300 contigs at most
    return w.select(windows.window_header().alias("header"), "name", "start", "length", "relaxed", "window")
