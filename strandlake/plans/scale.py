"""Registered queries over the operators made for large genomes: super-k-mers, stored sets, tiles, distributed ranks, resumed runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import permutation
from ..functions.shared import checkpoint_dir
from ..operators import classifier, fcgr, kmer_sets, kmers, nonb, nullomers, tfbs, tiled
from ..sources import resume, tiles
from .evaluation import draw_sql, spectra_bin_summary
from .genomes import G4_SQL, K, LETTER_SQL, NONB_SQL, RC, SCAN_SQL, TEXT_SQL, TILE, Z_SQL, _nonb, digested, joint, lettered, md5_dna, md5_ids, rounded, text_dna, texts
from .genomes import ORACLE_SQL as GENOME_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The k-mer lengths of the population's nullomers.
KS = (7, 8, 9)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def kmers_sql(ks: tuple[int, ...]) -> str:
    """km: (doc_id, which, pair_id, k, kmer) of table g for every k."""
    most = max(ks)
    pieces = f"pc AS (SELECT doc_id, which, pair_id, length(seq) - j * 128 AS rest, substr(seq, (j*128+1)::INT, {127 + most}) AS pc FROM g, unnest(range(0, (length(seq)+127)//128)) t(j))"
    cut = " UNION ALL ".join(f"SELECT doc_id, which, pair_id, {k} AS k, substr(pc, i::INT, {k}) AS kmer FROM pc, unnest(range(1, least(128, length(pc) - {k - 1}) + 1)) t(i)" for k in ks)
    return f"{pieces}, km AS (SELECT * FROM ({cut}) WHERE NOT contains(kmer, 'N'))"


def _pair_rates(*by: str) -> str:
    share = lambda a, b, n: f"round(CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END, 6) AS {n}"
    return f"{share('sh', 'o + s - sh', 'jaccard')}, {share('mi', 'o', 'missing_rate')}, {share('nv', 's', 'novel_rate')}"


_PRESENT = f"""pr AS (SELECT pair_id, k, least(kmer, {RC}) AS c, bool_or(which='orig') AS o, bool_or(which='syn') AS s FROM km GROUP BY ALL),
ct AS (SELECT pair_id, k, count(*) FILTER (o) AS o, count(*) FILTER (s) AS s, count(*) FILTER (o AND s) AS sh, count(*) FILTER (o AND NOT s) AS mi, count(*) FILTER (s AND NOT o) AS nv FROM pr GROUP BY ALL)"""
_NAMED = "o AS orig_unique, s AS syn_unique, sh AS shared_unique, mi AS missing_in_syn, nv AS novel_in_syn"


@query(f"WITH {TEXT_SQL}, {kmers_sql(KS)}, {_PRESENT} SELECT pair_id, k::INT AS k, {_NAMED}, {_pair_rates()} FROM ct")
def nullomer_set_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs at every k, by merging stored sets."""
    sets = kmer_sets.write(text_dna(spark, sf).select("pair_id", "which", "seq"), list(KS), f"strandlake_sets_{uuid.uuid4().hex}", "pair_id", "which")
    return rounded(kmer_sets.pair_metrics(sets))


@query(f"""WITH {TEXT_SQL}, {kmers_sql(KS)}, n AS (SELECT doc_id, k, count(DISTINCT least(kmer, {RC})) AS n FROM km GROUP BY ALL), gr AS (SELECT doc_id, k FROM g, unnest([{", ".join(map(str, KS))}]) t(k))
SELECT doc_id, k::INT AS k, coalesce(n, 0)::BIGINT AS observed_distinct_kmers, pow(4, k)::BIGINT AS kmer_space, (pow(4, k) - coalesce(n, 0))::BIGINT AS nullomer_count, round((pow(4, k) - coalesce(n, 0)) / pow(4, k), 6) AS nullomer_fraction FROM gr LEFT JOIN n USING (doc_id, k)""")
def nullomer_genomes(spark: SparkSession, sf: str) -> DataFrame:
    """All genomes by all k, from stored sets."""
    g = text_dna(spark, sf).select("doc_id", "seq")
    ks = kmer_sets.k_list(None, KS[0], KS[-1])
    return rounded(kmer_sets.fractions(kmer_sets.write(g, ks, f"strandlake_sets_{uuid.uuid4().hex}", "doc_id"), g, ks, "doc_id"))


@query(f"""WITH {TEXT_SQL}, {kmers_sql((K,))}, {_PRESENT}, sd AS (SELECT pair_id, count(*) FILTER (which='orig') AS no, count(*) FILTER (which='syn') AS ns FROM g GROUP BY 1),
st AS (SELECT *, CASE WHEN no = 0 OR ns = 0 THEN 'missing_fasta' WHEN coalesce(o, 0) = 0 OR coalesce(s, 0) = 0 THEN 'empty_kmc_db' ELSE 'ok' END AS status FROM sd LEFT JOIN ct USING (pair_id)),
z AS (SELECT pair_id, status, {", ".join(f"CASE WHEN status = 'ok' THEN {c} ELSE 0 END AS {c}" for c in ("o", "s", "sh", "mi", "nv"))} FROM st)
SELECT pair_id, {K} AS k, {_NAMED}, {_pair_rates()}, status FROM z""")
def nullomer_pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nullomers.pair_rows(text_dna(spark, sf), K))


@query(f"""WITH {TEXT_SQL}, {kmers_sql((K,))}, c AS (SELECT pair_id, kmer, count(*) FILTER (which='orig') AS a, count(*) FILTER (which='syn') AS b FROM km GROUP BY ALL), t AS (SELECT pair_id, sum(a) AS ta, sum(b) AS tb FROM c GROUP BY 1),
l AS (SELECT pair_id, any_value(ta) AS ta, any_value(tb) AS tb, sum(abs(CASE WHEN ta > 0 THEN a / ta ELSE 0 END - CASE WHEN tb > 0 THEN b / tb ELSE 0 END)) AS l1 FROM c JOIN t USING (pair_id) GROUP BY 1),
n AS (SELECT pair_id, sum(length(seq)) FILTER (which='orig') AS lo, sum(length(seq)) FILTER (which='syn') AS ls FROM g GROUP BY 1)
SELECT pair_id, CASE WHEN lo IS NULL OR ls IS NULL THEN 'missing_fasta' ELSE 'ok' END AS status, lo::BIGINT AS orig_len, ls::BIGINT AS syn_len, CASE WHEN lo + ls IS NOT NULL THEN coalesce(ta, 0)::BIGINT END AS orig_total_kmers,
 CASE WHEN lo + ls IS NOT NULL THEN coalesce(tb, 0)::BIGINT END AS syn_total_kmers, CASE WHEN lo + ls IS NOT NULL THEN round(coalesce(l1, 0), 6) END AS l1_fcgr FROM n LEFT JOIN l USING (pair_id)""")
def fcgr_pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fcgr.pair_rows(text_dna(spark, sf), K, joint=joint(spark, sf)))


REPS, SEED = 20, 17
_LC = lambda a, b: f"(lgamma({a}+1)-lgamma({b}+1)-lgamma({a}-{b}+1))"


@query(f"""WITH RECURSIVE {NONB_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY x) - 1 AS i FROM (SELECT motif, n_hits AS x, count(*) AS n, count(*) FILTER (which='orig') AS f FROM h GROUP BY ALL)),
t AS MATERIALIZED (SELECT motif, sum(n)::BIGINT AS n, sum(f)::BIGINT AS f, sum(x*f)::DOUBLE AS s1, sum(x*(n-f))::DOUBLE AS s2 FROM v GROUP BY 1),
r AS (SELECT motif, rep, 0::BIGINT AS i, n AS rest, f AS first, 0.0::DOUBLE AS s FROM t, range(0, {REPS}) z(rep)
 UNION ALL SELECT motif, rep, i + 1, rest - n, first - k, s + x * k FROM (SELECT *, least(hi, lo + len(list_filter(list_transform(range(lo, hi + 1), lambda a: list_sum(list_transform(range(lo, a + 1), lambda b: exp({_LC("n", "b")}+{_LC("(rest-n)", "(first-b)")}-{_LC("rest", "first")})))), lambda c: c < u))) AS k
 FROM (SELECT r.motif, r.rep, r.i, r.rest, r.first, r.s, v.n, v.x, greatest(0, first - (rest - v.n))::BIGINT AS lo, least(v.n, first)::BIGINT AS hi, (('0x'||substr(md5(concat('{SEED}:', rep::VARCHAR, ':0:', r.i::VARCHAR)),1,8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM r JOIN v ON v.motif = r.motif AND v.i = r.i))),
e AS (SELECT r.motif, count(*) FILTER (abs((s1+s2-s)/(n-f) - s/f) >= abs(s2/(n-f) - s1/f) - 1e-12) AS hits FROM r JOIN t USING (motif) WHERE rest = 0 GROUP BY 1)
SELECT motif, f AS n1, n - f AS n2, round(s2/(n-f) - s1/f, 6) AS delta, hits, round((hits + 1) / {REPS + 1}.0, 6) AS p FROM t JOIN e USING (motif)""")
def label_shuffle_p(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(permutation.label_shuffles(_nonb(spark, sf), "n_hits", F.col("which") == "orig", REPS, SEED, "motif"))


BINS = 5
_BIN = f"least({BINS - 1}, length(seq) // 1000)::INT"


def _tiled_metrics(cut: DataFrame, caller: str) -> DataFrame:
    return nonb.metrics(tiled.call(cut, caller, "pair_id", "which"), "pair_id", "which")


def _both_callers(m: DataFrame, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    cut = tiles.tiled(m, "pair_id", "which", size=size)
    return _tiled_metrics(cut, "g4hunter"), _tiled_metrics(cut, "zdna")


@query()
def nonb_tidy(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of all three callers, over tiles, as one table."""
    cut = tiles.tiled(md5_dna(spark, sf), "pair_id", "which", left=tiled.HALO, right=tiled.HALO)
    return nonb.tidy_tallies(tiled.tallied(cut, "pair_id", "which"))


_CALLS = f"{G4_SQL}, {Z_SQL.removeprefix('RECURSIVE ' + LETTER_SQL + ', ')}"
_AC = "regexp_extract_all(seq,'((?:AC){3,})',1)"


@query(f"""WITH RECURSIVE {_CALLS}, td AS (SELECT pair_id, which, 'GQ' AS motif, count(*) AS n_hits, sum("end" - start) AS bp_covered FROM hg GROUP BY ALL UNION ALL SELECT pair_id, which, 'Z-DNA', count(*), sum("end" - start) FROM hz GROUP BY ALL
 UNION ALL SELECT pair_id, which, 'STR', len({_AC}), length(array_to_string({_AC}, '')) FROM m),
lg AS (SELECT 'n_hits' AS measure, motif, {_BIN} AS bin, grp, n_hits::DOUBLE AS v FROM td JOIN m USING (pair_id, which) UNION ALL SELECT 'bp_covered', motif, {_BIN}, grp, bp_covered::DOUBLE FROM td JOIN m USING (pair_id, which)),
ce AS (SELECT measure, motif, bin, count(*) FILTER (grp='natural') AS nn, count(*) FILTER (grp='synthetic') AS ns, avg(v) FILTER (grp='natural') AS mn, avg(v) FILTER (grp='synthetic') AS ms FROM (SELECT * FROM lg UNION ALL SELECT measure, motif, NULL, grp, v FROM lg) GROUP BY ALL),
gr AS (SELECT measure, motif, bin FROM unnest(['bp_covered','n_hits']) a(measure), unnest([{", ".join(f"'{x}'" for x in nonb.MOTIF_ORDER)}]) b(motif), unnest([{", ".join(map(str, range(BINS)))}, NULL]::INT[]) c(bin))
SELECT gr.measure, gr.motif, coalesce(gr.bin::VARCHAR, 'all') AS bin, coalesce(nn, 0) AS n_natural, coalesce(ns, 0) AS n_synthetic, round(mn, 6) AS mean_natural, round(ms, 6) AS mean_synthetic, round(ms - mn, 6) AS delta FROM gr LEFT JOIN ce ON gr.measure = ce.measure AND gr.motif = ce.motif AND gr.bin IS NOT DISTINCT FROM ce.bin""")
def nonb_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Both callers and one tandem repeat on the full grid of measures, motifs and bins; motifs without rows are empty cells."""
    m = md5_dna(spark, sf)
    finder = nonb.repeat_counts(m, "AC", 3, "pair_id", "which").withColumn("motif", F.lit("STR"))
    group = m.select("pair_id", F.col("which").alias("which"), "grp", F.least(F.lit(BINS - 1), F.floor(F.length("seq") / 1000)).cast("int").alias("bin"))
    cells = nonb.grid(nonb.tidy(*_both_callers(m), finder).join(group, ["pair_id", "which"]), list(range(BINS)))
    return rounded(cells.withColumn("bin", F.coalesce(F.col("bin").cast("string"), F.lit("all"))))


CHUNK = 12


@query(f"""WITH {TEXT_SQL}, p AS (SELECT doc_id, CASE WHEN coalesce(seq, '') = '' THEN repeat('N', {CHUNK}) WHEN length(seq) < {CHUNK} THEN substr(repeat(seq, {CHUNK}), 1, {CHUNK}) ELSE seq END AS q FROM g),
w AS (SELECT doc_id, j * 128 AS o, substr(q, (j*128+1)::INT, {127 + CHUNK}) AS pc FROM p, unnest(range(0, (length(q)+127)//128)) t(j)),
f AS (SELECT doc_id, list(o + i - 1 ORDER BY o + i) AS fit FROM (SELECT doc_id, o, i, substr(pc, i::INT, {CHUNK}) AS c FROM w, unnest(range(1, length(pc) - {CHUNK - 2})) t(i)) WHERE NOT contains(c, 'N') GROUP BY 1),
a AS (SELECT doc_id, ix, q, fit, {draw_sql("31", "doc_id", "ix")} AS u FROM p LEFT JOIN f USING (doc_id), range(0, 3) t(ix)),
b AS (SELECT *, CASE WHEN fit IS NULL THEN u % (length(q) - {CHUNK - 1}) ELSE fit[(u % len(fit) + 1)::INT] END AS start FROM a)
SELECT doc_id, ix::INT AS chunk_ix, start::BIGINT AS start, fit IS NULL AS redrawn, array_to_string(list_transform(range(0, {CHUNK}), lambda j: CASE WHEN substr(q, (start + j + 1)::INT, 1) = 'N' THEN substr('ACGT', ({draw_sql("31", "doc_id", "ix", "j")} % 4 + 1)::INT, 1) ELSE substr(q, (start + j + 1)::INT, 1) END), '') AS chunk FROM b""")
def base_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of bases only, of sequences that are rich in N."""
    return classifier.base_chunks(text_dna(spark, sf), CHUNK, 3, 31, "doc_id")


#: Motifs of six letters as shares of A, C, G and T.
MATRICES = {"O1": [[0.7, 0.1, 0.1, 0.1], [0.05, 0.8, 0.05, 0.1], [0.1, 0.2, 0.6, 0.1], [0.9, 0.0, 0.05, 0.05], [0.1, 0.1, 0.1, 0.7], [0.4, 0.3, 0.2, 0.1]], "O2": [[0.0, 0.0, 1.0, 0.0]] * 4 + [[0.25, 0.25, 0.25, 0.25], [0.6, 0.1, 0.1, 0.2]]}
_CELLS = " UNION ALL ".join(f"SELECT '{name}' AS motif_id, {j} AS j, '{b}' AS c, {v}::DOUBLE AS p" for name, rows in MATRICES.items() for j, row in enumerate(rows) for b, v in zip("ACGT", row, strict=True))
_OWN_P = 2e-3


@query(f"""WITH {SCAN_SQL}, bn AS (SELECT grp, c, greatest(1, round(100 * n / sum(n) OVER (PARTITION BY grp))) AS k FROM (SELECT grp, c, sum(length(seq) - length(replace(seq, c, ''))) AS n FROM m, unnest(['A','C','G','T']) t(c) GROUP BY ALL)),
bs AS (SELECT grp, c, k / sum(k) OVER (PARTITION BY grp) AS b FROM bn), ce AS ({_CELLS}), sc AS (SELECT grp, motif_id, j, c, b, round(log2((p + 0.1::DOUBLE * b) / 1.1::DOUBLE / b) * 1000) AS s FROM ce JOIN bs USING (c)),
ow AS (SELECT a.grp, a.motif_id, a.c || d.c || e.c || f.c || h.c || i.c AS word, a.s + d.s + e.s + f.s + h.s + i.s AS s, a.b * d.b * e.b * f.b * h.b * i.b AS w FROM sc a JOIN sc d ON d.grp = a.grp AND d.motif_id = a.motif_id AND d.j = 1 JOIN sc e ON e.grp = a.grp AND e.motif_id = a.motif_id AND e.j = 2
 JOIN sc f ON f.grp = a.grp AND f.motif_id = a.motif_id AND f.j = 3 JOIN sc h ON h.grp = a.grp AND h.motif_id = a.motif_id AND h.j = 4 JOIN sc i ON i.grp = a.grp AND i.motif_id = a.motif_id AND i.j = 5 WHERE a.j = 0),
op AS (SELECT grp, motif_id, word, s / 1000 AS score, sum(w) OVER (PARTITION BY grp, motif_id ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS p FROM ow)
SELECT pair_id, which, doc_id, motif_id, strand, CASE strand WHEN '+' THEN pos ELSE n-6-pos END AS start, round(score, 6) AS score, round(p, 9) AS p_value FROM hw JOIN op USING (grp, word) WHERE p < {_OWN_P}""")
def motif_scan_own(spark: SparkSession, sf: str) -> DataFrame:
    """Each side scanned against its own background."""
    own = tfbs.background(md5_dna(spark, sf), "seq", "grp").select("grp", F.array("A", "C", "G", "T").alias("base"))
    motifs = spark.createDataFrame([(name, name, x) for name, x in MATRICES.items()], "motif_id string, motif_alt_id string, matrix array<array<double>>")
    hits = tfbs.scan_own(md5_ids(spark, sf).join(F.broadcast(own), "grp"), motifs, "pair_id", "which", "doc_id", site_p=_OWN_P, made=digested)  # two rows
    return hits.select("pair_id", "which", "doc_id", "motif_id", "strand", "start", F.round("score", 6).alias("score"), F.round("p_value", 9).alias("p_value"))


@query(f"""WITH b AS ({GENOME_SQL["spectra_bin_summary"]}), g AS (SELECT count(*) AS n_bins, count(delta_coverage) AS n_coverage, count(*) FILTER (delta_coverage < 0) AS coverage_negative, count(*) FILTER (delta_coverage > 0) AS coverage_positive,
 count(early_mean) AS n_early, count(*) FILTER (early_mean > 0) AS early_positive, count(*) FILTER (early_mean < 0) AS early_negative, count(*) FILTER (crosses) AS n_split FROM b)
SELECT *, CASE WHEN n_coverage > 0 THEN CASE WHEN coverage_negative / n_coverage >= 0.7 THEN 'lower' WHEN coverage_negative / n_coverage <= 0.3 THEN 'higher' ELSE 'mixed' END END AS coverage,
 CASE WHEN n_early > 0 THEN CASE WHEN early_positive / n_early >= 0.7 THEN 'positive' WHEN early_positive / n_early <= 0.3 THEN 'negative' ELSE 'mixed' END END AS early FROM g""")
def spectra_general_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.general_pattern(spectra_bin_summary(spark, sf))


@query(f"""WITH {TEXT_SQL}, {kmers_sql((K,))}, n AS (SELECT doc_id, count(DISTINCT least(kmer, {RC})) AS n FROM km GROUP BY ALL)
SELECT tag, doc_id, {K} AS k, coalesce(n, 0)::BIGINT AS observed_distinct_kmers, {4**K}::BIGINT AS kmer_space, ({4**K} - coalesce(n, 0))::BIGINT AS nullomer_count, round(({4**K} - coalesce(n, 0)) / {4**K}, 6) AS nullomer_fraction FROM g LEFT JOIN n USING (doc_id) WHERE tag IS NOT NULL""")
def resumed_nullomers(spark: SparkSession, sf: str) -> DataFrame:
    """Nullomers of every genome, tag after tag: a run that stops after some of the tags, and one that goes on."""
    g = texts(spark, sf).where("tag IS NOT NULL").select("tag", "doc_id", "seq")
    path = f"{checkpoint_dir(spark)}/strandlake-run-{uuid.uuid4().hex}"
    work = lambda jobs: rounded(nullomers.fractions(jobs, [K], "tag", "doc_id", lettered=lettered))
    resume.run(g.where(F.pmod(F.hash("tag"), F.lit(2)) == 0), "tag", work, path)
    return resume.run(g, "tag", work, path, slices=2)
