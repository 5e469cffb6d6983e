"""Straightforward single-machine versions of what the library computes, for comparison in tests."""


def left_align(genome: str, start: int, ref: str, alt: str) -> tuple[int, str, str]:
    """Step-by-step normalisation: extend left while the alleles end alike, then trim the left."""
    if ref == alt:
        return start, ref, alt
    while True:
        if ref and alt and ref[-1] == alt[-1]:
            if start == 0 and (len(ref) == 1 or len(alt) == 1):
                break
            ref, alt = ref[:-1], alt[:-1]
        elif (not ref or not alt) and start > 0:
            start -= 1
            ref, alt = genome[start] + ref, genome[start] + alt
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, start = ref[1:], alt[1:], start + 1
    return start, ref, alt


def overlaps(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two half-open intervals share a position; an empty one counts as its one position."""
    a_end, b_end = max(a[1], a[0] + 1), max(b[1], b[0] + 1)
    return a[0] < b_end and b[0] < a_end


def chunked(genome: dict[str, str], chunk: int, overlap: int) -> list[tuple[str, int, int, str]]:
    rows = []
    for contig, bases in genome.items():
        for i in range((len(bases) + chunk - 1) // chunk):
            low = max(0, i * chunk - overlap)
            rows.append((contig, i, low, bases[low : (i + 1) * chunk]))
    return rows
