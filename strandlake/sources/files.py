"""Readers and writers of the sequence, manifest, motif and interval files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna, names


def fasta(spark: SparkSession, paths: str | list[str], softmask_to_n: bool = False, headless: bool = True) -> DataFrame:
    """Records of plain or gzipped FASTA files: path, record_ix, record_id, header, seq, length, eff_len.

    Text before the first header is a record without one, or left out if not
    ``headless``; empty records are kept.  A record is one row: for long ones
    there is ``tiles.fasta_tiles``.
    """
    text = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_i"), "value")
    first = F.row_number().over(W.partitionBy("path").orderBy("_i")) == 1
    body = F.when(first, F.col("value")).otherwise(F.concat(F.lit(">"), F.col("value")))
    r = text.select("path", "_i", body.alias("b")).where(F.trim("b") != "")
    r = r if headless else r.where(F.col("b").startswith(">"))
    header = F.when(F.col("b").startswith(">"), F.regexp_extract("b", r"^>([^\r\n]*)", 1))
    seq = F.regexp_replace(F.when(F.col("b").startswith(">"), F.regexp_replace("b", r"^>[^\n]*\n?", "")).otherwise(F.col("b")), r"\s", "")
    r = r.select("path", (F.row_number().over(W.partitionBy("path").orderBy("_i")) - 1).alias("record_ix"), header.alias("header"), dna.clean(seq, softmask_to_n).alias("seq"))
    return r.select("path", "record_ix", dna.record_id("header").alias("record_id"), "header", "seq", F.length("seq").alias("length"), dna.effective_length("seq").alias("eff_len"))


def joined_records(records: DataFrame) -> DataFrame:
    """One sequence per file, its records joined in order."""
    return records.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_ix", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Pairs (row_ix, id, orig, syn and any further columns); a missing id becomes pair_001 and so on."""
    m = spark.read.option("header", True).csv(path).coalesce(1)
    if strict and (missing := {"orig", "syn"} - set(m.columns)):
        raise ValueError(f"manifest lacks {sorted(missing)}")
    m = m.withColumn("row_ix", (F.monotonically_increasing_id() + 1).cast("int"))
    own = F.nullif(F.trim("id"), F.lit("")) if "id" in m.columns else F.lit(None).cast("string")
    rest = [c for c in m.columns if c not in ("row_ix", "id")]
    return m.select("row_ix", F.coalesce(own, F.format_string("pair_%03d", "row_ix")).alias("id"), *rest)


def selected_pairs(pairs: DataFrame, tokens: list[str]) -> DataFrame:
    """Pairs by row number (digits) or by id."""
    return pairs.where(F.col("row_ix").isin([int(t) for t in tokens if t.isdigit()]) | F.col("id").isin([t for t in tokens if not t.isdigit()]))


def first_of(rows: DataFrame, n: int | None, index: str = "row_ix", *by: str) -> DataFrame:
    """The first ``n`` rows in the order of the file, of each ``by`` if named; all without a limit.  The index counts from any number, without gaps or with."""
    if n is None:
        return rows
    if not by:
        last = rows.select(index).orderBy(index).limit(n).agg(F.max(index).alias("_last"))
        return rows.crossJoin(F.broadcast(last)).where(F.col(index) <= F.col("_last")).drop("_last")  # one row
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(index))).where(F.col("_r") <= n).drop("_r")


def motif_folders(spark: SparkSession, orig: str, syn: str, site_p: float = 1e-4, site_q: float = 1.0) -> DataFrame:
    """Surviving hits of both sides for each motif folder of the orig side: motif, hits_orig, hits_syn.

    Folders hold fimo.tsv or fimo.tsv.gz.  The orig side decides which motifs there are; a missing file has no hits.
    """

    def hits(folder: str, name: str) -> DataFrame:
        t = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "fimo.tsv*").option("ignoreMissingFiles", True)
        t = t.schema("motif_id string, motif_alt_id string, sequence_name string, start string, stop string, strand string, score string, `p-value` string, `q-value` string, matched_sequence string").csv(folder)
        good = (_number("p-value") < site_p) & (_number("q-value") < site_q)
        return t.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("motif"), good.alias("_g")).groupBy("motif").agg(F.count_if("_g").alias(name))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "fimo.tsv*").load(orig).select(F.element_at(F.split("path", "/"), -2).alias("motif")).distinct()
    both = files.join(hits(orig, "hits_orig"), "motif", "left").join(hits(syn, "hits_syn"), "motif", "left")
    return both.select("motif", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hits_orig", "hits_syn")))


def background_lines(shares: DataFrame) -> DataFrame:
    """The lines of a background file (letter, share) of one row with the shares A, C, G and T."""
    letter = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.col(b).alias("p")) for b in "ACGT"))).alias("x")
    return shares.select(letter).select(F.concat(F.col("x.b"), F.lit(" "), F.format_string("%.6f", "x.p")).alias("value"))


def with_files(pairs: DataFrame, records: DataFrame, policy: str = "status") -> DataFrame:
    """Pairs in long form (id, which, path) with their sequences; a missing file gets a status, is skipped, or fails."""
    long = pairs.select("id", F.explode(F.array(F.struct(F.lit("orig").alias("which"), F.col("orig").alias("file")), F.struct(F.lit("syn").alias("which"), F.col("syn").alias("file")))).alias("x")).select("id", "x.*")
    found = records.select(F.col("path").alias("file"), "seq")
    if policy == "skip":
        return long.join(found, "file").withColumn("status", F.lit("ok"))
    out = long.join(found, "file", "left").withColumn("status", F.when(F.col("seq").isNull(), "missing_fasta").otherwise("ok"))
    if policy == "fail":
        out = out.withColumn("seq", F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("missing file "), "file"))).otherwise(F.col("seq")))
    return out


def meme(spark: SparkSession, path: str) -> DataFrame:
    """Motifs of MEME files: motif_id, motif_alt_id, w, matrix (rows of A, C, G, T)."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", r"(?m)^MOTIF\s+"), 2, 1_000_000)).alias("m"))
    head = F.split(F.regexp_extract("m", r"^([^\r\n]*)", 1), r"\s+")
    rows = F.regexp_extract_all("m", F.lit(r"(?m)^\s*([0-9.eE+-]+\s+[0-9.eE+-]+\s+[0-9.eE+-]+\s+[0-9.eE+-]+)\s*$"), 1)
    matrix = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), r"\s+"), lambda x: x.cast("double")))
    return t.select(F.get(head, 0).alias("motif_id"), F.coalesce(F.nullif(F.get(head, 1), F.lit("")), F.get(head, 0)).alias("motif_alt_id"), F.size(matrix).alias("w"), matrix.alias("matrix"))


def log_odds(motifs: DataFrame, pseudocount: float = 0.1, background: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """Motifs with ``scores``, the log2 odds of each cell against the shares of A, C, G and T."""
    base = F.array(*map(F.lit, background))
    cell = lambda p, b: F.log2((p + pseudocount * b) / (1 + pseudocount) / b)
    return motifs.withColumn("scores", F.transform("matrix", lambda r: F.zip_with(r, base, cell)))


def _number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS double)")


def intervals(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """contig, start, end of GFF (columns 1, 4, 5), BED, or a headed TSV or CSV under its usual column names; unreadable rows are left out."""
    if kind in ("gff", "bed"):
        at = (0, 3, 4) if kind == "gff" else (0, 1, 2)
        t = spark.read.option("sep", "\t").option("comment", "#").csv(path)
        t = t.select(*(F.col(t.columns[i]).alias(n) for i, n in zip(at, ("contig", "start", "end"), strict=True)))
    else:
        t = spark.read.option("sep", "," if kind == "csv" else "\t").option("header", True).csv(path)
        names = {c.lower(): c for c in t.columns}
        usual = (("chrom", "chr", "chromosome", "contig", "seqid", "sequence"), ("start", "begin"), ("end", "stop"))
        t = t.select(*(F.col(f"`{next(names[u] for u in us if u in names)}`").alias(n) for us, n in zip(usual, ("contig", "start", "end"), strict=True)))
    return t.select("contig", _number("start").cast("long").alias("start"), _number("end").cast("long").alias("end")).na.drop(subset=["start", "end"])


def fimo(spark: SparkSession, path: str) -> DataFrame:
    """Motif hits of a FIMO table; the columns that counting needs."""
    t = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    return t.select("motif_id", "motif_alt_id", _number("p-value").alias("p_value"), _number("q-value").alias("q_value")).na.drop(subset=["p_value", "q_value"])


def delimiter(spark: SparkSession, path: str) -> str:
    """A comma if the first line has more commas than tabs, else a tab; an empty file gives a tab."""
    first = spark.read.text(path).head()
    line = first[0] if first else ""
    return "," if line.count(",") > line.count("\t") else "\t"


def headed(spark: SparkSession, path: str, required: tuple[str, ...] = (), sep: str | None = None) -> DataFrame:
    """A headed table whose delimiter is told by its first line, with columns that it must have."""
    t = spark.read.option("sep", sep or delimiter(spark, path)).option("header", True).csv(path)
    if missing := set(required) - set(t.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return t


def g4hunter(spark: SparkSession, path: str) -> DataFrame:
    """Quadruplex calls in the tidy form of all callers; rows without a place are left out, a missing length is end minus start."""
    t = headed(spark, path, ("seqID", "start", "end"), "\t")
    has = lambda c, otherwise: F.col(c) if c in t.columns else otherwise
    start, end = (_number(c).cast("long") for c in ("start", "end"))
    length = _number("length").cast("long") if "length" in t.columns else end - start
    score = _number("score") if "score" in t.columns else F.lit(None).cast("double")
    out = t.select(
        F.lit("g4hunter").alias("source"), has("type", F.lit("pG4")).alias("class"), F.col("seqID").alias("contig"), start.alias("start"), end.alias("end"),
        has("strand", F.lit(".")).alias("strand"), score.alias("score"), length.alias("length"),
    )
    return out.na.drop(subset=["start", "end"])


def hits_per_file(hits: DataFrame, path: str = "path", one_format: bool = False) -> DataFrame:
    """Hits and covered bases of each (pair_id, which, motif) file from (path, start, end); the directory is the pair, the name tells the rest.

    Files whose side or motif is not told are left out.  With ``one_format`` a
    caller's second file of the same hits (.gff beside .tsv) doesn't count.
    """
    named = hits.select(
        F.col(path).alias("_p"), F.element_at(F.split(path, "/"), -2).alias("pair_id"), names.side_in(path).alias("which"), names.motif_in(path).alias("motif"),
        F.greatest(F.lit(0), F.col("end") - F.col("start")).alias("_bp"),
    ).where("which <> 'unk' AND motif <> 'UNK'")
    files = named.groupBy("pair_id", "which", "motif", "_p").agg(F.count("*").alias("n_hits"), F.sum("_bp").alias("bp_covered"))
    if one_format:
        files = files.groupBy("pair_id", "which", "motif").agg(F.max_by(F.struct("n_hits", "bp_covered"), "_p").alias("_x")).select("pair_id", "which", "motif", "_x.*")
    return files.drop("_p")


def pair_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files that match; unreadable ones are skipped, columns are merged by name."""
    return spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(pattern)


def support_tables(spark: SparkSession, folder: str, tag: str | None = None, k: int | None = None) -> DataFrame:
    """All ``*.support_stats.csv`` below a folder: tag, k, bin, lo, hi from the name, x and the mean cdfs; of a tag and a k if given."""
    t = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.support_stats.csv").csv(folder)
    if missing := {"abundance", "nat_cdf_mean", "syn_cdf_mean", "delta_cdf_mean"} - set(t.columns):
        raise ValueError(f"support tables lack {sorted(missing)}")
    name = F.col("_metadata.file_name")
    t = t.where(names.has_prefix(name, tag, k)).select(names.support_parts(name).alias("_n"), "*")
    numbers = (("abundance", "x", "long"), ("nat_cdf_mean", "nat", "double"), ("syn_cdf_mean", "syn", "double"), ("delta_cdf_mean", "delta", "double"))
    return t.select("_n.*", *(_number(c).cast(kind).alias(to) for c, to, kind in numbers))


def summary_order(summaries: DataFrame) -> DataFrame:
    """By tag, k (unknown first) and bin (unknown last)."""
    return summaries.orderBy("tag", F.coalesce("k", F.lit(-1)), F.coalesce("bin", F.lit(1_000_000_000)))


def general_format(x: Column, digits: int = 6) -> Column:
    """A number as the general format (%g) of so many digits writes it, rounded by its exact value: Java's formatter rounds its shortest decimals, and half-way ones up."""

    @F.pandas_udf("string")
    def shown(v: pd.Series) -> pd.Series:
        return pd.Series([f"{n + 0.0:.{digits}g}" for n in v], index=v.index, dtype=object)  # no minus before zero

    return F.when(x.isNotNull(), shown(x.cast("double")))


def formatted_numbers(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double as text of so many digits, null as nan: what a metrics CSV holds."""
    return df.select(*(F.coalesce(general_format(F.col(f"`{c}`"), digits), F.lit("nan")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """Text files of record_id and seq, wrapped."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    records.select(F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), body).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", *by: str) -> None:
    """Parquet, CSV, TSV or JSON, partitioned by columns if named."""
    w = df.write.partitionBy(*by)
    if kind in ("csv", "tsv"):
        w.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        w.format(kind).save(path)


def redacted(settings: DataFrame) -> DataFrame:
    """(key, value) with the values of secret-looking keys replaced."""
    return settings.withColumn("value", F.when(F.upper("key").rlike("TOKEN|PASSWORD|SECRET|KEY"), "***REDACTED***").otherwise(F.col("value")))


def not_done(jobs: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Jobs without a finished result: what a resumed run has to do."""
    return jobs.join(done.select(*key), [*key], "left_anti")
