"""Column functions of alignment records: flags, aligned blocks, fragments."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of the SAM flag.
FLAGS = {
    "PAIRED": 0x1, "PROPER_PAIR": 0x2, "UNMAP": 0x4, "MUNMAP": 0x8, "REVERSE": 0x10, "MREVERSE": 0x20,
    "READ1": 0x40, "READ2": 0x80, "SECONDARY": 0x100, "QCFAIL": 0x200, "DUP": 0x400, "SUPPLEMENTARY": 0x800,
}
BLOCK = "array<struct<s:bigint,e:bigint>>"


def flag_bits(term: str) -> int:
    """Bits of one flag: a name in any case, or a number of 16 bits, decimal or with 0x in front."""
    name = term.upper()
    if name in FLAGS:
        return FLAGS[name]
    base, digits = (16, name[2:]) if name.startswith("0X") else (10, name)
    allowed = "0123456789ABCDEF"[:base]
    if not digits or digits.strip(allowed):
        raise ValueError(f"no such flag: {term!r}")
    if int(digits, base) >> 16:
        raise ValueError(f"a flag has 16 bits, which {term} exceeds")
    return int(digits, base)


def flag_pattern(text: str) -> tuple[int, int]:
    """(bits that must be set, bits that must be unset) of a list such as 'PAIRED,^0x10': a caret asks for unset bits."""
    terms = [term.strip() for term in text.split(",")]
    unset = reduce(or_, (flag_bits(term.removeprefix("^").strip()) for term in terms if term.startswith("^")), 0)
    given = reduce(or_, (flag_bits(term) for term in terms if not term.startswith("^")), 0)
    if given & unset:
        raise ValueError(f"{text!r} wants a bit set and unset at once")
    return given, unset


def flag_mask(text: str) -> int:
    """All bits of a list of flags without carets."""
    return reduce(or_, (flag_bits(term.strip()) for term in text.split(",")))


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def included(flag: Column, patterns: list[tuple[int, int]]) -> Column:
    """Whether a flag matches any of the patterns; all flags do if there is none."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for must, must_not in patterns:
        out = out | ((flag.bitwiseAND(F.lit(must)) == must) & ~has(flag, must_not))
    return out


def cigar_array(text: Column) -> Column:
    """array<struct<op,len>> of a CIGAR string; empty for '*'."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.expr("0").alias("z"), F.regexp_extract(p, r"\d+", 0).cast("int").alias("len")).dropFields("z"))


def _walk(pos: Column, cigar: Column, emit) -> Column:
    """Fold a CIGAR into blocks. The state holds the place, the open block's start (-1: none) and what has been emitted."""
    start = F.struct(pos.cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("open"), F.array().cast(BLOCK).alias("out"))
    return F.aggregate(cigar, start, emit)


def _state(at: Column, opened: Column, out: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), opened.cast("bigint").alias("open"), out.alias("out"))


def _block(s: Column, e: Column) -> Column:
    return F.array(F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e")))


def blocks(pos: Column, cigar: Column) -> Column:
    """Aligned blocks: M, = and X extend a block, D and N close it, all else takes no reference bases."""

    def step(a: Column, c: Column) -> Column:
        match, gap = c["op"].isin("M", "=", "X"), c["op"].isin("D", "N")
        opened = F.when(match, F.when(a["open"] >= 0, a["open"]).otherwise(a["at"])).when(gap, F.lit(-1)).otherwise(a["open"])
        closes = gap & (a["open"] >= 0) & (a["at"] > a["open"])
        return _state(a["at"] + F.when(match | gap, c["len"]).otherwise(0), opened, F.when(closes, F.concat(a["out"], _block(a["open"], a["at"]))).otherwise(a["out"]))

    walked = _walk(pos, cigar, step)
    return F.transform(F.array(walked), lambda a: F.when((a["open"] >= 0) & (a["at"] > a["open"]), F.concat(a["out"], _block(a["open"], a["at"]))).otherwise(a["out"]))[0]


def introns(pos: Column, cigar: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        skip, moves = c["op"] == "N", c["op"].isin("M", "=", "X", "D", "N")
        return _state(a["at"] + F.when(moves, c["len"]).otherwise(0), a["open"], F.when(skip, F.concat(a["out"], _block(a["at"], a["at"] + c["len"]))).otherwise(a["out"]))

    return _walk(pos, cigar, step)["out"]


def _length(cigar: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(cigar, F.lit(0).cast("bigint"), lambda a, c: a + F.when(c["op"].isin(*ops), c["len"]).otherwise(0))


def aligned_end(pos: Column, cigar: Column) -> Column:
    """End of the alignment; a record that takes no reference base is one base long."""
    n = _length(cigar, ("M", "D", "N", "=", "X"))
    return pos + F.when(n > 0, n).otherwise(1)


def query_length(cigar: Column) -> Column:
    return _length(cigar, ("M", "I", "S", "=", "X"))


def fragment_length(tlen: Column, cigar: Column) -> Column:
    """|TLEN|, or the reference bases without introns where it is 0."""
    return F.when(tlen != 0, F.abs(tlen.cast("bigint"))).otherwise(_length(cigar, ("M", "D", "=", "X")))


def _templated(r: dict[str, Column]) -> Column:
    flag = r["flag"]
    bits = FLAGS["PAIRED"] | FLAGS["PROPER_PAIR"]
    opposite = has(flag, FLAGS["REVERSE"]) != has(flag, FLAGS["MREVERSE"])
    return (flag.bitwiseAND(F.lit(bits)) == bits) & ~has(flag, FLAGS["MUNMAP"]) & F.coalesce(r["mchrom"] == r["chrom"], F.lit(False)) & (r["mpos"] >= 0) & (r["tlen"] != 0) & opposite


def is_proper(r: dict[str, Column]) -> Column:
    """An inward-facing pair by flags, mate and places; the aligner's own bit alone is not trusted."""
    return _templated(r) & F.when(has(r["flag"], FLAGS["REVERSE"]), r["pos"] >= r["mpos"]).otherwise(r["pos"] <= r["mpos"])


def is_dovetail(r: dict[str, Column]) -> Column:
    """A pair whose reverse mate starts left of its forward mate and overlaps it."""
    return _templated(r) & F.when(has(r["flag"], FLAGS["REVERSE"]), (r["pos"] < r["mpos"]) & (r["end"] > r["mpos"])).otherwise(r["pos"] > r["mpos"])


def transcript_strand(flag: Column, library: str) -> Column:
    """+1 or -1: the transcript's strand, by which read of a pair is sense in the library."""
    read = F.when(has(flag, FLAGS["REVERSE"]), -1).otherwise(1)
    second = (flag.bitwiseAND(F.lit(FLAGS["PAIRED"] | FLAGS["READ2"])) == (FLAGS["PAIRED"] | FLAGS["READ2"]))
    flip = second if library == "forward" else ~second
    return F.when(flip, -read).otherwise(read)
