"""Header and sequence columns, all built-in expressions (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 255
UNDATED = -1


def clean_header(raw: Column) -> Column:
    """Header text without trailing line ends."""
    return F.regexp_replace(raw, r"[\r\n]+$", "")


def clean_sequence(raw: Column, strip_blanks: bool = False) -> Column:
    """Joined, uppercased sequence lines.

    Line ends and carriage returns before them go; with ``strip_blanks`` so does other
    white space at line ends.
    """
    pattern = r"[ \t\f\x0B\r]*(\n|$)" if strip_blanks else r"\r*(\n|$)"
    return F.upper(F.regexp_replace(raw, pattern, ""))


def seq_length(seq: Column) -> Column:
    return F.octet_length(seq).cast("bigint")


def acgt_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^ACGT]", "")).cast("bigint")


def n_fraction(seq: Column) -> Column:
    """Share of characters other than A, C, G, T; 1 for an empty sequence."""
    n = seq_length(seq)
    return F.when(n == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - acgt_count(seq).cast("double") / F.nullif(n, F.lit(0)).cast("double")
    )


def month_bucket(header: Column) -> Column:
    """``year * 12 + month - 1`` of the date in the second ``|`` field, else -1."""
    pattern = r"^[^|]*\|([0-9]{4})-([0-9]{2})"
    year = F.regexp_extract(header, pattern, 1)
    month = F.regexp_extract(header, pattern, 2)
    y = F.when(year != "", year.cast("int"))
    m = F.when(month != "", month.cast("int"))
    return F.when(m.between(1, 12), y * 12 + m - 1).otherwise(F.lit(UNDATED)).cast("int")


def header_key(header: Column) -> Column:
    """The first 255 bytes of a header, the identity used across shards."""
    return F.substring(F.encode(header, "UTF-8"), 1, HEADER_BYTES)


def truncated_header(header: Column) -> Column:
    # A cut may end inside a character; a cast keeps such bytes where decoding would fail.
    return header_key(header).cast("string")


def acgt_runs(seq: Column, k: int) -> Column:
    """Maximal runs of valid bases that hold at least one k-mer."""
    return F.filter(F.split(seq, "[^ACGT]+"), lambda run: F.length(run) >= k)


def reverse_complement(dna: Column) -> Column:
    return F.translate(F.reverse(dna), "ACGT", "TGCA")


def canonical(dna: Column) -> Column:
    """Lexicographic minimum of a k-mer and its reverse complement."""
    return F.least(dna, reverse_complement(dna))


def kmer_text(code: Column, k: int) -> Column:
    """Letters of a 2-bit k-mer code (k up to 31)."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def kmer_code(dna: Column) -> Column:
    """2-bit code of k-mer letters (k up to 31)."""
    return F.conv(F.translate(dna, "ACGT", "0123"), 4, 10).cast("bigint")
