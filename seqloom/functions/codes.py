"""Letters, degenerate bases and genetic codes."""

from __future__ import annotations

from itertools import product

#: IUPAC degenerate bases.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT",
}
#: Complements, DNA and RNA.
DNA_FROM, DNA_TO = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
RNA_FROM, RNA_TO = "ACGUTMRWSYKVHDBNacgutmrwsykvhdbn", "UGCAAKYWSRMBDHVNugcaakywsrmbdhvn"

LETTERS = {
    "dna": "ACGTRYMKSWHBVDNacgtrymkswhbvdn",
    "rna": "ACGURYMKSWHBVDNacgurymkswhbvdn",
    "protein": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz*_",
}
GAPS = " .-\t"

#: NCBI genetic codes, bases in the order TCAG. Each code is the standard one with the changes named, and its start codons.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODES: dict[int, tuple[str, str, str]] = {
    1: ("The Standard Code", "", "TTG CTG ATG"),
    2: ("The Vertebrate Mitochondrial Code", "AGA* AGG* ATAM TGAW", "ATT ATC ATA ATG GTG"),
    3: ("The Yeast Mitochondrial Code", "ATAM CTTT CTCT CTAT CTGT TGAW", "ATA ATG GTG"),
    4: ("The Mold, Protozoan, and Coelenterate Mitochondrial Code and the Mycoplasma/Spiroplasma Code", "TGAW", "TTA TTG CTG ATT ATC ATA ATG GTG"),
    5: ("The Invertebrate Mitochondrial Code", "AGAS AGGS ATAM TGAW", "TTG ATT ATC ATA ATG GTG"),
    6: ("The Ciliate, Dasycladacean and Hexamita Nuclear Code", "TAAQ TAGQ", "ATG"),
    9: ("The Echinoderm and Flatworm Mitochondrial Code", "AAAN AGAS AGGS TGAW", "ATG GTG"),
    10: ("The Euplotid Nuclear Code", "TGAC", "ATG"),
    11: ("The Bacterial, Archaeal and Plant Plastid Code", "", "TTG CTG ATT ATC ATA ATG GTG"),
    12: ("The Alternative Yeast Nuclear Code", "CTGS", "CTG ATG"),
    13: ("The Ascidian Mitochondrial Code", "AGAG AGGG ATAM TGAW", "TTG ATA ATG GTG"),
    14: ("The Alternative Flatworm Mitochondrial Code", "AAAN AGAS AGGS TAAY TGAW", "ATG"),
    16: ("Chlorophycean Mitochondrial Code", "TAGL", "ATG"),
    21: ("Trematode Mitochondrial Code", "TGAW ATAM AGAS AGGS AAAN", "ATG GTG"),
    22: ("Scenedesmus obliquus Mitochondrial Code", "TCA* TAGL", "ATG"),
    23: ("Thraustochytrium Mitochondrial Code", "TTA*", "ATT ATG GTG"),
    24: ("Pterobranchia Mitochondrial Code", "AGAS AGGK TGAW", "TTG CTG ATG GTG"),
    25: ("Candidate Division SR1 and Gracilibacteria Code", "TGAG", "TTG ATG GTG"),
    26: ("Pachysolen tannophilus Nuclear Code", "CTGA", "CTG ATG"),
    27: ("Karyorelict Nuclear", "TAGQ TAAQ TGAW", "ATG"),
    28: ("Condylostoma Nuclear", "TAAQ TAGQ TGAW", "ATG"),
    29: ("Mesodinium Nuclear", "TAAY TAGY", "ATG"),
    30: ("Peritrich Nuclear", "TAAE TAGE", "ATG"),
    31: ("Blastocrithidia Nuclear", "TGAW TAGE TAAE", "ATG"),
}


def codons(table: int) -> dict[str, str]:
    """The 64 plain codons of a code."""
    if table not in CODES:
        raise ValueError(f"unknown genetic code {table}; known: {sorted(CODES)}")
    out = {"".join(c): aa for c, aa in zip(product("TCAG", repeat=3), STANDARD)}
    return out | {change[:3]: change[3] for change in CODES[table][1].split()}


def degenerate_codons(table: int) -> dict[str, str]:
    """Plain codons, and those with degenerate bases whose readings all give the same amino acid."""
    plain = codons(table)
    out = {}
    for codon in product("ACGTRYMKSWHBVDN", repeat=3):
        found = {plain["".join(c)] for c in product(*(IUPAC[b] for b in codon))}
        if len(found) == 1:
            out["".join(codon)] = found.pop()
    return out


def starts(table: int) -> list[str]:
    return CODES[table][2].split()


def degenerate_to_regex(pattern: str) -> str:
    """A DNA pattern with degenerate bases as a regular expression, in the case given."""
    out = []
    for c in pattern:
        bases = IUPAC.get(c.upper())
        if bases is None:
            raise ValueError(f"{c!r} is not a degenerate base")
        bases = bases if c.isupper() else bases.lower()
        out.append(bases if len(bases) == 1 else f"[{bases}]")
    return "".join(out)
