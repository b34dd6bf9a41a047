"""Bases, k-mers and their 2-bit codes as Columns.

A k-mer (k up to 31) has a code of 2k bits, A=0, C=1, G=2, T=3, first base most significant; it fits a long. A k-mer with
any other letter has no code: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_K = 31
#: Each second bit of a long.
LOW_BITS = 0x5555555555555555
#: For each byte (four bases) its reverse complement.
BYTE_REVCOM = [sum((3 - (b >> (2 * i) & 3)) << (2 * (3 - i)) for i in range(4)) for b in range(256)]


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k is {k}; it can be 1 to {MAX_K}")


def normalise(seq: Column) -> Column:
    return F.upper(seq)


def encode(kmer: Column) -> Column:
    """The code, or null where a letter is none of A, C, G, T."""
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def encode_clean(kmer: Column) -> Column:
    """The code of a k-mer that is known to hold A, C, G and T only."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, k: int | Column) -> Column:
    size = F.lit(k) if isinstance(k, int) else k
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), size, F.lit("0")), "0123", "ACGT")


def revcom(seq: Column) -> Column:
    """Reverse complement; N stays N."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def mask_of(k: int) -> int:
    return (1 << (2 * k)) - 1


def revcom_code(code: Column, k: int) -> Column:
    """Byte by byte from a table, the bytes in reverse order; then the bases beyond the kth are shifted out. The code is
    named eight times only, which keeps generated code small where this is nested in other expressions."""
    table = F.lit(BYTE_REVCOM).cast("array<bigint>")
    out = None
    for i in range(8):
        byte = F.shiftrightunsigned(code, 8 * i).bitwiseAND(F.lit(255)).cast("int")
        part = F.shiftleft(F.get(table, byte), 56 - 8 * i)
        out = part if out is None else out.bitwiseOR(part)
    return F.shiftrightunsigned(out, 64 - 2 * k)


def revcom_of(code: int, k: int) -> int:
    """The same for a number on the driver."""
    out = 0
    for _ in range(k):
        out, code = (out << 2) | (3 - (code & 3)), code >> 2
    return out


def checked(bases: str, what: str = "sequence") -> str:
    """A user's k-mer, unit or consensus in upper case; anything but A, C, G and T raises."""
    found = (bases or "").strip().upper()
    if not found or set(found) - set("ACGT"):
        raise ValueError(f"{what} {bases!r} must be letters A, C, G, T")
    return found


def code_of(kmer: str) -> int:
    """The code of a k-mer on the driver."""
    out, kmer = 0, checked(kmer, "k-mer")
    for base in kmer:
        out = out * 4 + "ACGT".index(base)
    return out


def kmer_of(code: int, k: int) -> str:
    return "".join("ACGT"[(code >> (2 * (k - 1 - i))) & 3] for i in range(k))


def hamming(a: Column, b: Column) -> Column:
    """Differing bases of two codes."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS))).cast("int")


def canonical(code: Column, k: int, keep_lower: bool = True) -> Column:
    """One code for both strands: the lower (or higher) of a k-mer and its reverse complement."""
    return (F.least if keep_lower else F.greatest)(code, revcom_code(code, k))


def is_palindrome(kmer: Column) -> Column:
    return kmer == revcom(kmer)


def mutation_limit(k: int, n: int = 2) -> int:
    """At most a quarter of the bases may differ."""
    return n if 4 * n <= k else k // 4


def relative_position(pos: Column, length: Column, k: int | Column) -> Column:
    """Place on [0, 1]; a sequence of just one k-mer has 0."""
    room = length - (F.lit(k) if isinstance(k, int) else k)
    return F.when(room > 0, pos.cast("double") / room.cast("double")).otherwise(F.lit(0.0))


def trend(frequency: Column) -> Column:
    """Log odds, kept finite."""
    return F.log10((frequency + F.lit(1e-9)) / (F.lit(1.0) - frequency + F.lit(1e-9)))
