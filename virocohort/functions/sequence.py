"""Sequence projections (SQ01-SQ17): column in, column out; codons are read by whole Arrow batches."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from virocohort.operators.ordering import running_total
from virocohort.rules import genetics as g

CHUNK = 600


def normalise(seq: Column) -> Column:
    """SQ01: upper-case, no white space, anything but ACGTN becomes N."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, r"\s+", "")), "[^ACGTN]", "N")


def normalisation_audit(df: DataFrame, seq: str) -> DataFrame:
    """SQ01: what normalisation changed; ``usable`` is false for records that must be rejected."""
    compact = F.upper(F.regexp_replace(F.col(seq), r"\s+", ""))
    odd = F.regexp_replace(compact, "[ACGTN]", "")
    symbols = F.array_sort(F.array_distinct(F.split(odd, "")))
    counts = F.transform(F.filter(symbols, lambda c: c != ""),
                         lambda c: F.concat(c, F.lit(":"), F.length(odd) - F.length(F.replace(odd, c, F.lit("")))))
    return df.select(
        "*",
        F.length(compact).alias("original_length"),
        F.length(odd).alias("replacement_count"),
        F.array_join(counts, ";").alias("replaced_symbols"),
        (F.length(odd) > 0).alias("changed"),
        F.sha2(compact, 256).alias("original_sha256"),
        F.sha2(normalise(F.col(seq)), 256).alias("normalised_sha256"),
        compact.rlike(f"[{g.ALPHABET}]").alias("usable"),
    )


def reverse_complement(seq: Column) -> Column:
    """SQ02."""
    return F.translate(F.reverse(seq), g.COMPLEMENT_FROM, g.COMPLEMENT_TO)


def cds_of(genome: Column, start: Column, end: Column, strand: Column) -> Column:
    """SQ03: coding-strand bases of a 1-based inclusive interval."""
    piece = F.substring(genome, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(strand == "-", reverse_complement(piece)).otherwise(piece)


def residue(codon: Column) -> Column:
    """Residue of one codon, ``X`` when its expansions disagree or a symbol is unknown."""
    bases = [F.substring(codon, i, 1) for i in (1, 2, 3)]
    a, b, c = (F.instr(F.lit(g.BASES), x) for x in bases)
    plain = F.substring(F.lit(g.RESIDUES), 16 * a + 4 * b + c - 20, F.lit(1))
    x, y, z = (F.instr(F.lit(g.ALPHABET), v) for v in bases)
    rare = F.substring(F.lit(g.CODON_STRING), 225 * x + 15 * y + z - 240, F.lit(1))
    return (F.when((a > 0) & (b > 0) & (c > 0), plain)
            .when((x > 0) & (y > 0) & (z > 0), rare).otherwise("X"))


def _codon_table() -> np.ndarray:
    """Residues of all codons over 16 symbols: the bases and codes of the alphabet in either case, then any other one."""
    held = np.full((16, 16, 16), ord("X"), np.uint8)
    held[:15, :15, :15] = np.frombuffer(g.CODON_STRING.encode(), np.uint8).reshape(15, 15, 15)
    at = [g.ALPHABET.index(x) for x in g.BASES]
    held[np.ix_(at, at, at)] = np.frombuffer(g.RESIDUES.encode(), np.uint8).reshape(4, 4, 4)
    return held.ravel()


SYMBOL = np.full(256, 15, np.uint8)
for _i, _x in enumerate(g.ALPHABET):
    SYMBOL[[ord(_x), ord(_x.lower())]] = _i
CODONS = _codon_table()
ODD = np.zeros(256, bool)  # bytes of rows that are read as text
ODD[[10, 13]] = ODD[128:] = True


def _residues_of(text: str) -> bytes:
    """Residues of one text with line ends or other scripts: three characters of one line are a codon."""
    codons = "".join(re.findall("[^\n\r\u0085\u2028\u2029]{3}", text.upper()))
    of = SYMBOL[[ord(x) if ord(x) < 128 else 255 for x in codons]].astype(np.int64)
    return CODONS[256 * of[::3] + 16 * of[1::3] + of[2::3]].tobytes()


def _read_codons(texts: pa.Array, final_stop: bool) -> pa.Array:
    """Residues of a batch at once."""
    texts = texts.cast(pa.large_string())
    null = texts.is_null().to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    codons = np.where(null, 0, np.diff(offsets) // 3)
    ends = np.cumsum(codons)
    first = np.repeat(offsets[:-1] - offsets[:1] - 3 * (ends - codons), codons) + 3 * np.arange(ends[-1] if len(ends) else 0)
    of = SYMBOL[data].astype(np.int16)
    out = CODONS[256 * of[first] + 16 * of[first + 1] + of[first + 2]]
    if ODD[data].any():
        parts = np.split(out, ends[:-1])
        row = np.searchsorted(offsets[1:] - offsets[0], np.flatnonzero(ODD[data]), side="right")
        for at in np.unique(row):
            parts[at] = np.frombuffer(_residues_of(texts[int(at)].as_py()), np.uint8)
        out, codons = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(codons)
    if not final_stop:
        last = ends[codons > 0] - 1
        last = last[out[last] == ord("*")]
        codons[np.searchsorted(ends, last, side="right")] -= 1
        out = np.delete(out, last)
    places = np.r_[0, np.cumsum(codons)].astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(places.tobytes()), pa.py_buffer(out.tobytes()), pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()))


@F.arrow_udf(T.StringType())
def _all_residues(cds: pa.Array) -> pa.Array:
    return _read_codons(cds, True)


@F.arrow_udf(T.StringType())
def _protein(cds: pa.Array) -> pa.Array:
    return _read_codons(cds, False)


def residues(cds: Column) -> Column:
    """Residues of all whole codons, stops included."""
    return _all_residues(cds)


def translate(cds: Column) -> Column:
    """SQ04: residues of whole codons without one final stop."""
    return _protein(cds)


def translate_strict(cds: Column) -> Column:
    """SQ04: as ``translate``, any table-11 start read as methionine."""
    body = translate(cds)
    starts = F.substring(cds, 1, 3).isin(*g.STARTS) & (F.length(body) > 0)
    return F.when(starts, F.concat(F.lit("M"), F.substring(body, 2, 1_000_000_000))).otherwise(body)


def count_of(seq: Column, symbols: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, symbols, ""))


def gc_fraction(seq: Column) -> Column:
    """SQ05: G+C over A+C+G+T, 0 for a sequence without any of them."""
    return count_of(seq, "GC") / F.greatest(F.lit(1), count_of(seq, "ACGT"))


def content_id(prefix: str, *parts: Column, width: int = 16) -> Column:
    """SQ06: stable id from the content it names."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, width))


def oriented(start: Column, end: Column, strand: Column, genome_length: Column) -> tuple[Column, Column]:
    """SQ07: genomic interval -> 0-based half-open bounds on the coding strand."""
    plus = strand == "+"
    return (F.when(plus, start - 1).otherwise(genome_length - end),
            F.when(plus, end).otherwise(genome_length - start + 1))


def genomic(left: Column, right: Column, strand: Column, genome_length: Column) -> tuple[Column, Column]:
    """SQ07: inverse of ``oriented``."""
    plus = strand == "+"
    return (F.when(plus, left + 1).otherwise(genome_length - right + 1),
            F.when(plus, right).otherwise(genome_length - left))


def oriented_sequence(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


class StrandView(NamedTuple):
    """A contig read along one strand; slices are cut first and reversed after, never the whole contig."""

    seq: Column
    genome_length: Column
    strand: Column

    def slice(self, lo: Column, hi: Column) -> Column:
        """Bases [lo, hi) in 0-based strand coordinates, cut at the contig ends."""
        lo, hi = F.greatest(F.lit(0), lo), F.least(self.genome_length, hi)
        width = F.greatest(F.lit(0), hi - lo).cast("int")
        first = F.when(self.strand == "-", self.genome_length - hi).otherwise(lo)
        piece = F.substring(self.seq, (first + 1).cast("int"), width)
        return F.when(self.strand == "-", reverse_complement(piece)).otherwise(piece)


def rotate(seq: Column, origin: Column) -> Column:
    """SQ08: the circular sequence read from a 1-based origin."""
    return F.concat(F.substring(seq, origin, F.length(seq)), F.substring(seq, F.lit(1), origin - 1))


def transform_view(df: DataFrame, kind: str, rationale: Column, origin: Column | None = None) -> DataFrame:
    """SQ08: analysis views with their history; rows that break a rule carry a ``reject_reason``.

    Columns: genome_id, seq, topology, history (array of struct<op, parameter, rationale>).
    """
    no_reason = F.coalesce(F.trim(rationale), F.lit("")) == ""
    if kind == "reverse_complement":
        bad = F.when(no_reason, "RATIONALE_REQUIRED")
        seq, suffix, parameter = reverse_complement(F.col("seq")), F.lit("__rc"), F.lit(None).cast("string")
    else:
        bad = (
            F.when(F.col("topology") != "CIRCULAR", "TOPOLOGY_NOT_CIRCULAR")
            .when(~origin.between(1, F.length("seq")), "ORIGIN_OUT_OF_RANGE")
            .when(no_reason, "RATIONALE_REQUIRED")
        )
        seq, suffix, parameter = rotate(F.col("seq"), origin), F.concat(F.lit("__rot"), origin), origin.cast("string")
    event = F.struct(F.lit(kind).alias("op"), parameter.alias("parameter"), rationale.alias("rationale"))
    return df.withColumn("reject_reason", bad).select(
        *[c for c in df.columns if c not in ("seq", "history", "analysis_id")],
        F.concat(F.col("genome_id"), suffix).alias("analysis_id"),
        F.when(bad.isNull(), seq).alias("seq"),
        F.array_append("history", event).alias("history"),
        "reject_reason",
    )


def equivalence(query: Column, reference: Column) -> Column:
    """SQ09: how two sequences are the same molecule, strongest statement first."""
    rc = reverse_complement(reference)
    same_length = F.length(query) == F.length(reference)
    return (
        F.when(~same_length | (F.length(query) == 0), "NOT_IDENTICAL_LENGTH_OR_SEQUENCE")
        .when(query == reference, "CONFIRMED_IDENTICAL_SEQUENCE")
        .when(query == rc, "CONFIRMED_REVERSE_COMPLEMENT_SEQUENCE")
        .when(F.concat(reference, reference).contains(query), "CONFIRMED_ROTATION_EQUIVALENT_SEQUENCE")
        .when(F.concat(rc, rc).contains(query), "CONFIRMED_REVERSE_COMPLEMENT_ROTATION_EQUIVALENT")
        .otherwise("NOT_IDENTICAL_LENGTH_OR_SEQUENCE")
    )


def sd_motifs(upstream: Column) -> Column:
    """SQ10: literal motifs 3-15 bases before the start, as ``motif:spacer`` joined by ``;``."""
    def found(motif: str) -> Column:
        width = len(motif)
        places = F.transform(F.sequence(F.lit(1), F.length(upstream)),
                             lambda i: F.struct(i.alias("i"), (F.length(upstream) - i - (width - 1)).alias("gap")))
        hits = F.filter(places, lambda p: p["gap"].between(3, 15) & (F.substring(upstream, p["i"], F.lit(width)) == motif))
        named = F.transform(hits, lambda p: F.concat(F.lit(motif + ":"), p["gap"]))
        return F.when(upstream.contains(motif), named).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(*[found(m) for m in g.SD_MOTIFS]), ";")


def upstream_of(view: StrandView, left: Column, span: int) -> Column:
    """Bases before a 0-based left bound, at most ``span`` of them."""
    return view.slice(F.greatest(F.lit(0), left - span), left)


def rbs_window(view: StrandView, left: Column) -> Column:
    """The stretch 20 to 4 bases before a start in which a ribosome site may lie."""
    return view.slice(F.greatest(F.lit(0), left - 20), left - 4)


def rbs(window: Column) -> Column:
    """SQ11: best ribosome-site struct<score, motif, spacer, matches> of one window.

    Exact pieces of the consensus score twice their width; a six-base word one substitution away
    scores 6 (the consensus is all purines, so such a word has the five required).  A spacer outside
    5-12 weakens either.  Ties keep the narrower, then the more distant word.
    """
    n = F.length(window)
    shape = "array<struct<score:double,w:int,j:int,motif:string,spacer:int,matches:int>>"

    def pieces(width: int, words: list[str], points: float, matches: int) -> Column:
        def at(j: Column) -> Column:
            word = F.substring(window, j, F.lit(width))
            gap = n - j - (width - 1) + 4
            score = F.when(word.isin(*words), points * F.when(gap.between(5, 12), 1.0).otherwise(0.6))
            return F.struct(score.alias("score"), F.lit(-width).alias("w"), (-j).alias("j"), word.alias("motif"),
                            gap.alias("spacer"), F.lit(matches).alias("matches"))

        hits = F.filter(F.transform(F.sequence(F.lit(1), n - (width - 1)), at), lambda c: c["score"].isNotNull())
        return F.when(window.rlike("|".join(words)), hits).otherwise(F.array().cast(shape))

    consensus = g.SD_CONSENSUS
    exact = [(w, sorted({consensus[i:i + w] for i in range(7 - w)})) for w in (4, 5, 6)]
    near = sorted(consensus[:k] + b + consensus[k + 1:] for k in range(6) for b in "ACGT" if b != consensus[k])
    best = F.array_max(F.concat(*[pieces(w, words, 2.0 * w, w) for w, words in exact], pieces(6, near, 6.0, 5)))
    return F.struct(
        F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.coalesce(best["motif"], F.lit("")).alias("motif"),
        best["spacer"].alias("spacer"), F.coalesce(best["matches"], F.lit(0)).alias("matches"))


def coupling_score(view: StrandView, left: Column, gap: Column) -> Column:
    """SQ12: stop and start that share bases, read from the sequence itself."""
    around = view.slice(F.greatest(F.lit(0), left - 2), left + 3)
    ahead = view.slice(left, left + 4)
    return (
        F.when((gap == -1) & around.isin("TAATG", "TGATG", "TAGTG", "TATTG"), 4.0)
        .when((gap == -4) & ahead.isin("ATGA", "GTGA", "TTGA"), 4.0)
        .otherwise(0.0)
    )


def attenuate(score: Column, motif: Column, gc: Column) -> Column:
    """SQ13: short motifs count a quarter in GC-rich genomes."""
    return F.when((gc > 0.58) & (F.length(motif) < 5), score * 0.25).otherwise(score)


def lipobox(protein: Column) -> tuple[Column, Column]:
    """SQ14: first lipobox in the first 30 residues and its 1-based position (0 if none)."""
    head = F.upper(F.substring(protein, 1, 30))
    return F.regexp_extract(head, f"({g.LIPOBOX})", 1), F.regexp_instr(head, F.lit(g.LIPOBOX))


def upstream_region(view: StrandView, left: Column) -> Column:
    """SQ15: up to 100 upstream bases followed by the start codon."""
    return view.slice(F.greatest(F.lit(0), left - 100), left + 3)


def explode_words(df: DataFrame, seq: str, width: int, name: str = "word", chunk: int = CHUNK) -> DataFrame:
    """Every word of ``width`` bases with its 0-based position ``pos``.

    Sequences are cut into overlapping chunks first: a substring deep inside a long string costs
    its depth, so reading words from short chunks keeps the work linear in sequence length.
    """
    pieces = df.where(F.length(seq) >= width).select(
        *[c for c in df.columns if c != seq],
        F.explode(F.sequence(F.lit(0), F.floor((F.length(seq) - width) / chunk).cast("int"))).alias("__c"),
        F.col(seq).alias("__s"),
    ).withColumn("__s", F.substring("__s", F.col("__c") * chunk + 1, F.lit(chunk + width - 1)))
    words = pieces.withColumn("__i", F.explode(F.sequence(F.lit(1), F.length("__s") - (width - 1))))
    return words.withColumn(name, F.substring("__s", F.col("__i"), F.lit(width))).withColumn(
        "pos", F.col("__c") * chunk + F.col("__i") - 1).drop("__c", "__s", "__i")


def sequence_runs(contigs: DataFrame, min_homopolymer: int = 10) -> DataFrame:
    """SQ16: runs of non-ACGT symbols and homopolymers of at least ``min_homopolymer``.

    Only positions that start or end a run are kept before anything is ordered, so the rows that
    move are few even for a long contig.
    """
    padded = contigs.select("genome_id", F.concat(F.lit("#"), F.upper("seq"), F.lit("#")).alias("seq"))
    ambiguous = padded.select("genome_id", F.regexp_replace("seq", "[^ACGT#]", "N").alias("seq"), F.lit("AMBIGUOUS_BASES").alias("code"))
    plain = padded.select("genome_id", "seq", F.lit("HOMOPOLYMER").alias("code"))
    words = explode_words(ambiguous.unionByName(plain), "seq", 3)
    symbol = F.substring("word", 2, 1)
    wanted = F.when(F.col("code") == "HOMOPOLYMER", symbol.isin("A", "C", "G", "T")).otherwise(symbol == "N")
    words = words.withColumn("symbol", symbol).where(wanted)
    first = F.substring("word", 1, 1) != F.col("symbol")
    last = F.substring("word", 3, 1) != F.col("symbol")
    marks = words.where(first | last).select(
        "genome_id", "code", "symbol", (F.col("pos") + 1).cast("bigint").alias("p"), first.alias("is_first"), last.alias("is_last"))
    keyed = running_total(marks, ["genome_id", "code"], "p", ["p"], F.col("is_first").cast("int"), "run")
    runs = keyed.groupBy("genome_id", "code", "symbol", "run").agg(F.min("p").alias("s"), F.max("p").alias("e"))
    keep = (F.col("code") == "AMBIGUOUS_BASES") | (F.col("e") - F.col("s") + 1 >= min_homopolymer)
    return runs.where(keep).select("genome_id", "code", "symbol", "s", "e")


def _shared_prefix(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Length of the common ACGT prefix of two columns: first differing block, then base."""
    same = lambda x, y: (x == y) & x.rlike("^[ACGT]+$")
    cut = lambda c, size: F.regexp_extract_all(F.col(c), F.lit("(.{1,%d})" % size))
    df = df.withColumn("__eq", F.zip_with(cut(a, 64), cut(b, 64), same))
    df = df.withColumn("__k", F.array_position("__eq", F.lit(False)).cast("int"))
    df = df.withColumn("__x", F.substring(a, (F.col("__k") - 1) * 64 + 1, F.lit(64)))
    df = df.withColumn("__y", F.substring(b, (F.col("__k") - 1) * 64 + 1, F.lit(64)))
    df = df.withColumn("__j", F.array_position(F.zip_with(cut("__x", 1), cut("__y", 1), same), F.lit(False)).cast("int"))
    whole = F.least(F.length(a), F.length(b))
    part = (F.col("__k") - 1) * 64 + F.when(F.col("__j") > 0, F.col("__j") - 1).otherwise(F.least(F.length("__x"), F.length("__y")))
    return df.withColumn(name, F.when(F.col("__k") == 0, whole).otherwise(part)).drop("__eq", "__k", "__x", "__y", "__j")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _places(seq: pa.Array, word: pa.Array) -> pa.Array:
    """All 0-based places of each row's word, overlapping ones too."""
    out = []
    for s, w in zip(seq.to_pylist(), word.to_pylist(), strict=True):
        at, found = s.find(w), []
        while at >= 0:
            found.append(at)
            at = s.find(w, at + 1)
        out.append(found)
    return pa.array(out, pa.list_(pa.int32()))


def terminal_repeats(contigs: DataFrame, minimum: int = 20, maximum: int = 10_000) -> DataFrame:
    """SQ17: longest exact direct (DTR) and inverted (ITR) end repeat of each contig.

    A direct repeat of length n shows the first ``minimum`` bases n before the end, so only the
    places of that anchor are tested; an inverted repeat is the common prefix with the reversed
    contig.  ``internal_copies`` lists 1-based places of the repeat between the ends.
    """
    half = F.least(F.lit(maximum), F.floor(F.length("seq") / 2).cast("int"))
    base = contigs.select("genome_id", F.upper("seq").alias("seq")).withColumn("half", half).where(F.col("half") >= minimum)
    base = base.withColumn("anchor", F.substring("seq", 1, minimum)).where(F.col("anchor").rlike("^[ACGT]+$"))
    base = base.withColumn("places", _places("seq", "anchor"))
    size = lambda p: F.length("seq") - p
    head = lambda p: F.substring("seq", F.lit(1), size(p))
    ends = F.filter("places", lambda p: (size(p) <= F.col("half")) & (head(p) == F.substring("seq", p + 1, size(p))) & head(p).rlike("^[ACGT]+$"))
    base = base.withColumn("dtr", (F.length("seq") - F.array_min(ends)).cast("int"))
    base = base.withColumn("a", F.expr("left(seq, half)")).withColumn("b", reverse_complement(F.expr("right(seq, half)")))
    base = _shared_prefix(base, "a", "b", "itr")
    found = F.array(F.struct(F.lit("DTR_CANDIDATE").alias("code"), F.col("dtr").cast("int").alias("n")),
                    F.struct(F.lit("ITR_CANDIDATE").alias("code"), F.when(F.col("itr") >= minimum, F.col("itr")).cast("int").alias("n")))
    repeats = base.select("genome_id", "seq", "places", F.explode(found).alias("f")).select("genome_id", "seq", "places", "f.code", F.col("f.n").alias("length_nt")).where("length_nt is not null")
    n = F.col("length_nt")
    copies = F.filter("places", lambda p: (p >= n) & (p + n <= F.length("seq") - n) & (F.substring("seq", p + 1, n) == F.substring("seq", F.lit(1), n)))
    return repeats.select("genome_id", "code", "length_nt", F.array_join(F.transform(copies, lambda p: (p + 1).cast("string")), ";").alias("internal_copies"))
