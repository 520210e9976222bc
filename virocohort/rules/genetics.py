"""Genetic code and sequence alphabets (fixed values of translation table 11 and IUPAC)."""

BASES = "TCAG"
# residues of table 11 for codons in TCAG order, first base slowest
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG", "CTG", "ATT", "ATC", "ATA")
CANONICAL_STARTS = ("ATG", "GTG", "TTG")
RARE_STARTS = ("CTG", "ATT", "ATC", "ATA")
STOPS = ("TAA", "TAG", "TGA")
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
# residue symbols standing for a pair of residues
PAIR_SYMBOLS = {frozenset("ND"): "B", frozenset("QE"): "Z", frozenset("IL"): "J"}
SD_MOTIFS = ("AGGAGG", "GGAGG", "AGGAG", "GGAG", "GAGG", "AGGA")
SD_CONSENSUS = "AGGAGG"
LIPOBOX = "[LVI][ASTVI][GAS]C"


def codon_string() -> str:
    """Residues of every codon over the IUPAC alphabet, indexed base-15 in dictionary order."""
    plain = {a + b + c: RESIDUES[16 * i + 4 * j + k]
             for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    out = []
    for a in IUPAC.values():
        for b in IUPAC.values():
            for c in IUPAC.values():
                seen = {plain[x + y + z] for x in a for y in b for z in c}
                out.append(seen.pop() if len(seen) == 1 else PAIR_SYMBOLS.get(frozenset(seen), "X"))
    return "".join(out)


ALPHABET = "".join(IUPAC)
CODON_STRING = codon_string()
