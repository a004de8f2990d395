"""IUPAC codes as sets of bases: A 1, T 2, C 4, G 8 and their unions; 16 is a gap or anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter of each set of bases, in the order of its number from 1.
LETTERS = "ATWCMYHGRKDSVBN"
GAP = 16


def encoded(letter: Column, u_is_t: bool = True) -> Column:
    """Code of a letter in either case; U counts as T in FASTA input."""
    letter = F.upper(letter)
    at = F.instr(F.lit(LETTERS), letter)
    if u_is_t:
        at = F.when(letter == "U", 2).otherwise(at)
    return F.when((F.length(letter) == 1) & (at > 0), at).otherwise(GAP).cast("int")


def encoded_text(text: Column) -> Column:
    """array<int> of the codes of a sequence."""
    return F.transform(F.split(text, ""), lambda c: encoded(c))


def decoded(code: Column) -> Column:
    """Letter of a code; gaps are '-'."""
    return F.when(code.between(1, 15), F.substring(F.lit(LETTERS), code.cast("int"), F.lit(1))).otherwise("-")


def resolved(code: Column, draw: Column) -> Column:
    """One base of an ambiguous code, the ``draw``-th (modulo their number) in the order A, T, C, G."""
    bases = F.filter(F.array(*[F.lit(b) for b in (1, 2, 4, 8)]), lambda b: code.bitwiseAND(b) != 0)
    return F.when(code.between(1, 15), F.get(bases, (draw % F.greatest(F.size(bases), F.lit(1))).cast("int"))).otherwise(code).cast("int")


def base_count(text: Column, base: str) -> Column:
    """How often a base occurs, in either case."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{base.upper()}{base.lower()}]", ""))


def valid_bases(text: Column) -> Column:
    """Characters other than '-', '.' and N."""
    return F.length(F.regexp_replace(text, "[-.Nn]", ""))
