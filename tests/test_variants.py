import random

import pytest
from pyspark.sql import functions as F

from varlake.operators.variants import normalize_variants, split_and_normalize, split_multiallelics
from varlake.sources.fasta import index_fasta, read_reference_bases
from varlake.sources.vcf import VcfHeader, parse_vcf_lines

from brute import chunked, left_align

SITE = "contigName string, start long, end long, names array<string>, referenceAllele string, alternateAlleles array<string>"
BASES = "contigName string, chunk_id long, chunk_start long, bases string"


def _genome(rng, n, alphabet="ACGT"):
    """Random sequence with repeats of short units in it."""
    out = ""
    while len(out) < n:
        if rng.random() < 0.5:
            unit = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
            out += unit * rng.randint(2, 12)
        else:
            out += "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 10)))
    return out[:n]


def _variants(rng, genome, n, alphabet="ACGT"):
    rows = set()
    while len(rows) < n:
        contig = rng.choice(list(genome))
        bases = genome[contig]
        start = rng.choice([0, rng.randint(0, 5), rng.randint(0, len(bases) - 2)])
        ref = bases[start : start + rng.randint(1, 8)]
        kind = rng.random()
        if kind < 0.35:
            alt = ref[0] + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) + ref[1:]
        elif kind < 0.6:
            alt = ref + ref[-rng.randint(1, len(ref)) :]
        elif kind < 0.85:
            cut = rng.randint(1, len(ref))
            alt = ref[:cut]
        else:
            alt = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8)))
        rows.add((contig, start, start + len(ref), "v", ref, alt))
    return [(c, s, e, [v], r, [a]) for c, s, e, v, r, a in rows]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (16, 0), (1024, 128)])
def test_normalize_equals_stepwise(spark, chunk, overlap):
    rng = random.Random(chunk)
    genome = {"1": _genome(rng, 900), "2": _genome(rng, 700, "AC"), "3": "A" * 300 + "C" + "AT" * 200}
    rows = _variants(rng, genome, 1500, "AC")
    df = spark.createDataFrame(rows, SITE).repartition(4)
    ref = spark.createDataFrame(chunked(genome, chunk, overlap), BASES)
    got = normalize_variants(df.withColumn("k", F.concat_ws("|", "contigName", "start", "referenceAllele", F.get("alternateAlleles", F.lit(0)))), ref, chunk=chunk)
    got = {r.k: (r.start, r.end, r.referenceAllele, r.alternateAlleles[0], r.normalized) for r in got.collect()}
    assert len(got) == len(rows)
    for contig, start, _, _, r, (a,) in rows:
        s, nr, na = left_align(genome[contig], start, r, a)
        assert got[f"{contig}|{start}|{r}|{a}"] == (s, s + len(nr), nr, na, (s, nr, na) != (start, r, a)), (contig, start, r, a)


def test_long_repeats_are_followed_and_lazy_mode_flags_them(spark):
    genome = {"1": "G" + "CA" * 5000 + "T"}
    ref = spark.createDataFrame(chunked(genome, 64, 16), BASES)
    df = spark.createDataFrame([("1", 9998, 10001, ["d"], "ACA", ["A"]), ("1", 5, 6, ["s"], "C", ["T"])], SITE)
    full = {r.names[0]: r for r in normalize_variants(df, ref, chunk=64).collect()}
    assert (full["d"].start, full["d"].referenceAllele, full["d"].alternateAlleles) == (0, "GCA", ["G"])
    assert full["s"].normalized is False
    lazy = {r.names[0]: r for r in normalize_variants(df, ref, chunk=64, follow_long_repeats=False).collect()}
    assert lazy["d"].normalized is None and lazy["d"].start == 9998


def test_rows_that_cannot_be_normalised_are_kept(spark):
    ref = spark.createDataFrame(chunked({"1": "ACGTACGT"}, 64, 16), BASES)
    rows = [
        ("1", 1, 2, ["sym"], "C", ["<DEL>"]),
        ("1", 1, 2, ["multi"], "C", ["A", "T"]),
        ("1", 1, 2, ["none"], "C", []),
        ("9", 3, 5, ["nocontig"], "AA", ["A"]),
        ("1", 1, 3, ["same"], "CG", ["CG"]),
    ]
    got = {r.names[0]: r for r in normalize_variants(spark.createDataFrame(rows, SITE), ref).collect()}
    assert len(got) == 5
    for row in rows:
        g = got[row[3][0]]
        assert (g.start, g.end, g.referenceAllele, g.alternateAlleles) == (row[1], row[2], row[4], row[5])
    assert got["same"].normalized is False
    assert all(got[k].normalized is None for k in ("sym", "multi", "none", "nocontig"))


def test_what_the_reference_does_not_hold_gives_null_near_or_far(spark):
    genome = "G" + "CA" * 500 + "T" + "C" * 20
    chunks = [c for c in chunked({"1": genome}, 64, 16) if c[1] != 10]
    rows = [
        ("1", 998, 1001, ["far"], "ACA", ["A"]),
        ("1", 700, 703, ["near"], "ACA", ["A"]),
        ("1", 660, 663, ["nearest"], "ACA", ["A"]),
        ("1", 1010, 1012, ["beside"], "CC", ["C"]),
        ("1", 300, 303, ["before"], "ACA", ["A"]),
    ]
    df = spark.createDataFrame(rows, SITE)
    got = {r.names[0]: r for r in normalize_variants(df, spark.createDataFrame(chunks, BASES), chunk=64).collect()}
    assert [got[k].normalized for k in ("far", "near", "nearest")] == [None] * 3
    assert (got["beside"].start, got["before"].start) == (1001, 0)
    assert all((got[r[3][0]].start, got[r[3][0]].referenceAllele) == (r[1], r[4]) for r in rows[:3])


@pytest.mark.parametrize("seed", range(3))
def test_by_index_as_step_by_step(spark, tmp_path, seed):
    rng = random.Random(seed)
    genome = {"1": _genome(rng, 900), "2": "G" + "CA" * 60_000 + "T" + "ACGTTGCA" * 4_000 + "C"}
    path = tmp_path / "g.fa"
    path.write_text("".join(f">{n}\n" + "\n".join(b[i : i + 61] for i in range(0, len(b), 61)) + "\n" for n, b in genome.items()))
    index_fasta(spark, str(path))
    rows = []
    for i in range(150):
        contig = rng.choice("12")
        start = rng.randrange(len(genome[contig]) - 20)
        ref = genome[contig][start : start + rng.randrange(1, 18)]
        alt = rng.choice([ref[0], ref + ref, ref[: rng.randrange(1, len(ref) + 1)], ref[0] + ref, rng.choice("ACGT")])
        rows.append((contig, start, start + len(ref), [str(i)], ref, [alt]))
    rows.append(("2", 120_000 - 1, 120_002, ["end"], "ACA"[:3], ["A"]))
    rows.append(("9", 5, 7, ["nowhere"], "AA", ["A"]))
    df = spark.createDataFrame(rows, SITE)
    lazy = normalize_variants(df, str(path))
    got = {r.names[0]: r for r in lazy.collect()}
    for contig, start, _, (name,), ref, (alt,) in rows:
        if contig == "9":
            assert got[name].normalized is None and got[name].start == 5
            continue
        s, r, a = left_align(genome[contig], start, ref, alt)
        one = got[name]
        assert (one.start, one.referenceAllele, one.alternateAlleles, one.normalized) == (s, r, [a], (s, r, a) != (start, ref, alt))
    plan = lazy._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_genotype_lists_are_cut_by_their_number(spark):
    lines = [
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="">',
        '##FORMAT=<ID=GP,Number=G,Type=Float,Description="">',
        '##FORMAT=<ID=EC,Number=A,Type=Integer,Description="">',
        '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="">',
        '##FORMAT=<ID=XX,Number=R,Type=Integer,Description="">',
        '##FORMAT=<ID=YY,Number=.,Type=Integer,Description="">',
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts",
        "1\t5\t.\tA\tC,G\t.\t.\t.\tGT:GP:EC:AD:XX:YY\t1/2:1,2,3,4,5,6:7,8:1,2,3:4,5,6:1,2,3",
        "1\t6\t.\tA\tC,G\t.\t.\t.\tGT:GP:EC:AD:XX:YY\t0/1:1,2:7,8,9:1,2:4,5:1,2",
    ]
    table = parse_vcf_lines(spark.createDataFrame([(x,) for x in lines], "value string"), VcfHeader.parse(lines))
    got = {(r.start, r.alternateAlleles[0]): r.genotypes[0] for r in split_multiallelics(table).collect()}
    g = got[4, "G"]
    assert (g.posteriorProbabilities, g.expectedAlleleCounts, g.alleleDepths, g.XX, g.YY) == ([1.0, 4.0, 6.0], [8], [1, 3], [4, 6], [1, 2, 3])
    bad = got[5, "C"]
    assert (bad.posteriorProbabilities, bad.expectedAlleleCounts, bad.alleleDepths, bad.XX, bad.YY) == (None, None, None, None, [1, 2])


def test_split(spark):
    df = spark.createDataFrame(
        [
            (["G", "T"], [3, 4], [9, 9, 9], 7, [("s", [1, 2], [5, 6, 7], [0, 1, 2, 3, 4, 5]), ("t", [0, -1], None, None)]),
            (["C"], [1], [2], 8, [("s", [0, 1], [1, 2], [3, 4, 5])]),
            ([], None, None, 9, []),
        ],
        "alternateAlleles array<string>, INFO_AC array<int>, INFO_X array<int>, INFO_DP int,"
        "genotypes array<struct<sampleId:string,calls:array<int>,alleleDepths:array<int>,phredLikelihoods:array<int>>>",
    )
    rows = {tuple(r.alternateAlleles): r for r in split_multiallelics(df).collect()}
    assert set(rows) == {("G",), ("T",), ("C",), ()}
    g, t = rows["G",], rows["T",]
    assert (g.INFO_AC, g.INFO_X, g.INFO_DP, g.splitFromMultiAllelic) == ([3], [9, 9, 9], 7, True)
    assert t.INFO_AC == [4]
    assert [x.calls for x in g.genotypes] == [[1, -1], [0, -1]] and [x.calls for x in t.genotypes] == [[-1, 1], [0, -1]]
    assert g.genotypes[0].alleleDepths == [5, 6] and t.genotypes[0].alleleDepths == [5, 7]
    assert g.genotypes[0].phredLikelihoods == [0, 1, 2] and t.genotypes[0].phredLikelihoods == [0, 3, 5]
    assert rows["C",].genotypes[0].calls == [0, 1] and not rows["C",].splitFromMultiAllelic
    assert rows[()].INFO_AC is None


def test_split_and_normalize(spark):
    genome = {"1": "GATTTTTC"}
    ref = spark.createDataFrame(chunked(genome, 64, 16), BASES)
    df = spark.createDataFrame([("1", 5, 7, ["m"], "TT", ["T", "GT"])], SITE)
    got = sorted((r.start, r.referenceAllele, r.alternateAlleles[0]) for r in split_and_normalize(df, ref).collect())
    assert got == [(1, "AT", "A"), (5, "T", "G")]


@pytest.mark.parametrize("width,max_bytes", [(7, None), (60, 4096), (13, 1000)])
def test_read_fasta(spark, tmp_path, width, max_bytes):
    rng = random.Random(width)
    genome = {"chr1": _genome(rng, 5000), "chr2": _genome(rng, 64), "chr3": _genome(rng, 2048)}
    path = tmp_path / "g.fa"
    text = "".join(
        f">{name} some text\n" + "\n".join(b[i : i + width].lower() for i in range(0, len(b), width)) + "\n"
        for name, b in genome.items()
    )
    path.write_text(text)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        if max_bytes:
            spark.conf.set(key, max_bytes)
        got = read_reference_bases(spark, str(path), chunk=64, overlap=16).collect()
    finally:
        spark.conf.set(key, old)
    assert sorted(map(tuple, got)) == sorted(chunked(genome, 64, 16))


def test_fasta_lines_find_their_places_without_windows(spark, tmp_path):
    rng = random.Random(5)
    genome = {f"c{i}": _genome(rng, 1 + i * 7) for i in range(60)} | {"long": _genome(rng, 9_000)}
    lines = [line for name, bases in genome.items() for line in [f">{name} x", *[bases[i : i + 50] for i in range(0, len(bases), 50)], ""]]
    (tmp_path / "a.fa").write_text("\n".join(lines[: len(lines) - 120]) + "\n  \n")
    (tmp_path / "b.fa").write_text(">d\nACGTACGTAC\nAC\n>d\nTTTTT\nGGGGGGGG\n>e\n>f\nacg")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    whole = read_reference_bases(spark, str(tmp_path / "a.fa"), 64, 16)
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    # The only windows are those over one row per file block.
    assert all("value" not in line for line in text.splitlines() if "Window" in line) and text.count("collect_list") == 1
    want = sorted(map(tuple, whole.collect()))
    try:
        for size in (100, 700):
            spark.conf.set(key, size)
            assert sorted(map(tuple, read_reference_bases(spark, str(tmp_path / "a.fa"), 64, 16).collect())) == want
    finally:
        spark.conf.set(key, old)
    assert {r[0] for r in want} <= set(genome) and all(
        genome[name][start : start + len(bases)] == bases for name, _, start, bases in want
    )
    # Contigs of one name overlie each other line by line.
    twice = sorted(map(tuple, read_reference_bases(spark, str(tmp_path / "b.fa"), 64, 16).collect()))
    assert twice == [("d", 0, 0, "ACGTACGTACTTTTTGGGGGGGGAC"), ("f", 0, 0, "ACG")]


def test_by_a_large_index_as_by_a_small_one(spark, tmp_path, monkeypatch):
    genome = {f"c{i}": "G" + "CA" * (20 + i) + "TTTT" for i in range(40)}
    for k in range(2):
        (tmp_path / f"{k}.fa").write_text("".join(f">{n}\n" + "\n".join(b[i : i + 30] for i in range(0, len(b), 30)) + "\n" for n, b in list(genome.items())[k::2]))
    index_fasta(spark, str(tmp_path))
    rows = [(name, len(b) - 7, len(b) - 4, [name], "ACA"[: 3 if i % 2 else 1], ["A" if i % 2 else "ACA"]) for i, (name, b) in enumerate(genome.items())]
    rows += [("nowhere", 5, 7, ["n"], "AA", ["A"]), (None, 5, 7, ["null"], "AA", ["A"]), ("c1", 10**6, 10**6 + 2, ["far"], "AA", ["A"]), rows[3], ("c1", 2, 3, ["one"], "C", ["T"])]
    df = spark.createDataFrame(rows, SITE)
    want = sorted(map(str, normalize_variants(df, str(tmp_path)).collect()))
    assert sum("normalized=True" in row for row in want) == 41
    monkeypatch.setattr("varlake.operators.variants.SMALL_INDEX", 0)
    monkeypatch.setattr("varlake.sources.fasta.IndexedReference.of", None)
    assert sorted(map(str, normalize_variants(df, str(tmp_path)).collect())) == want
    (tmp_path / "2.fa").write_text(">c3\nAC\n")
    index_fasta(spark, str(tmp_path))
    with pytest.raises(ValueError, match="c3 is in more than one place"):
        normalize_variants(df, str(tmp_path))


def test_rows_meet_the_bases_of_chunks_without_their_other_columns(spark):
    genome = {"1": "G" + "CA" * 400 + "T", "2": "TTTTG" + "CTA" * 300}
    ref = spark.createDataFrame(chunked(genome, 64, 16), BASES)
    rows = [("1", 798, 801, ["a"], "ACA", ["A"]), ("1", 798, 801, ["b"], "ACA", ["A"]), ("2", 901, 902, ["c"], "A", ["ACTA"]), ("1", 2, 5, ["d"], "ACA", ["A"]), (None, 3, 6, ["e"], "ACA", ["A"])]
    done = normalize_variants(spark.createDataFrame(rows, SITE), ref, chunk=64)
    assert "bases" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = {r.names[0]: (r.start, r.referenceAllele, r.alternateAlleles[0], r.normalized) for r in done.collect()}
    assert got == {"a": (0, "GCA", "G", True), "b": (0, "GCA", "G", True), "c": (4, "G", "GCTA", True), "d": (0, "GCA", "G", True), "e": (3, "ACA", "A", None)}
