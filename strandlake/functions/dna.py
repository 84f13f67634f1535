"""Column functions over DNA strings; all stay inside Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(s: Column | str) -> Column:
    """Reverse complement; letters other than A, C, G, T stay."""
    return F.reverse(F.translate(col(s), "ACGT", "TGCA"))


def canonical(s: Column | str) -> Column:
    return F.least(col(s), revcomp(s))


def clean(s: Column | str, softmask_to_n: bool = False) -> Column:
    """Upper case; soft-masked (lower-case) bases become N if asked."""
    s = col(s)
    return F.upper(F.regexp_replace(s, "[acgt]", "N")) if softmask_to_n else F.upper(s)


def dna_only(s: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(s), "[^ACGTacgt]", ""))


def effective_length(s: Column | str) -> Column:
    """The number of A, C, G and T."""
    return F.length(F.regexp_replace(col(s), "[^ACGT]", ""))


def n_ratio(s: Column | str) -> Column:
    """The share of N; 1 for an empty sequence."""
    s = col(s)
    return F.when(F.length(s) > 0, (F.length(s) - F.length(F.translate(s, "Nn", ""))) / F.length(s)).otherwise(F.lit(1.0))


def auto_k(length: Column | str) -> Column:
    """ceil(0.7 log4 length) within 5..15; 5 for an empty sequence."""
    n = col(length)
    return F.when(n > 0, F.greatest(F.lit(5), F.least(F.lit(15), F.ceil(0.7 * F.ln(n) / F.ln(F.lit(4.0)))))).otherwise(F.lit(5)).cast("int")


def record_id(header: Column | str) -> Column:
    """The first token of a header with unusual characters replaced; NA if nothing is left."""
    token = F.regexp_replace(F.regexp_extract(col(header), r"^(\S*)", 1), r"[^\p{Alnum}._\-|]", "_")
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("NA"))


def is_primary_contig(name: Column | str) -> Column:
    return col(name).rlike(r"(?i)^(NC_|chr(\d+|X|Y|M|MT)$)")


def pad_to(s: Column | str, length: int) -> Column:
    """Cut or N-padded to a length."""
    return F.rpad(F.substring(col(s), 1, length), length, "N")


def overlaps_within(a: Column, b: Column, start: Column, end: Column, min_gap: int) -> Column:
    """Whether [a, b) comes nearer than min_gap to [start, end)."""
    return ~((end + min_gap < a) | (b + min_gap < start))


def label_of(c: Column | str) -> Column:
    """orig or syn, by the beginning of a label."""
    return F.when(F.lower(col(c)).startswith("syn"), "syn").otherwise("orig")


def per_kb(x: Column | str, length: Column | str) -> Column:
    return F.when(col(length) > 0, 1000.0 * col(x) / col(length)).otherwise(F.lit(0.0))


def g_quadruplexes(s: Column | str) -> Column:
    """All non-overlapping G-quadruplex motifs."""
    return F.regexp_extract_all(col(s), F.lit("(G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,})"), 1)
