import gzip

import golden_ids
import pytest
from pyspark.sql import functions as F

import varlake as v

# Keys, numbers and types of the declarations, and the first site, are those of a published sample.
HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=LowQual,Description="little to go by">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths, ref and alt">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="how sure the call is">
##FORMAT=<ID=GT,Number=1,Type=String,Description="the call">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Likelihoods">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count, Number=9">
##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=DS,Number=0,Type=Flag,Description="Downsampled?">
##INFO=<ID=END,Number=1,Type=Integer,Description="End">
"""
COLUMNS = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT NA1 NA2".replace(" ", "\t") + "\n"
LINES = [
    "20 10009875 asdf A G,AGGGAGG 2369.73 . AC=1,1;AF=0.500,0.500;DP=57;XDS=3 GT:AD:DP:GQ:PL 1/2:2,15,13:30:99:2407,645,533,697,0,574 0|1:.:.:7:.",
    "20 10009879 . A G . PASS AC=2;AF=.;DS GT:DP ./.:4 1/1",
    "20 10010393 a;b T . 14 q10;s50 DP=.;END=10010400 GT 0/1 .",
    "20 10010394 . T <DEL> 99 PASS .",
]
TEXT = HEADER + COLUMNS + "".join(line.replace(" ", "\t") + "\n" for line in LINES)


@pytest.fixture
def vcf(tmp_path):
    path = tmp_path / "x.vcf.gz"
    with gzip.open(path, "wt") as f:
        f.write(TEXT)
    return str(path)


def test_read_vcf(spark, vcf):
    rows = v.read_vcf(spark, vcf).collect()
    assert [(r.start, r.end) for r in rows] == [(10009874, 10009875), (10009878, 10009879), (10010392, 10010400), (10010393, 10010394)]
    a, b, c, d = rows
    assert a.names == ["asdf"] and b.names == [] and c.names == ["a", "b"]
    assert a.alternateAlleles == ["G", "AGGGAGG"] and c.alternateAlleles == []
    assert (a.qual, b.qual) == (2369.73, None) and (a.filters, c.filters) == ([], ["q10", "s50"])
    assert (a.INFO_AC, a.INFO_AF, a.INFO_DP, a.INFO_DS) == ([1, 1], [0.5, 0.5], 57, False)
    assert b.INFO_DS is True and b.INFO_AF is None and c.INFO_DP is None and d.INFO_AC is None
    g1, g2 = a.genotypes
    assert (g1.sampleId, g1.phased, g1.calls, g1.alleleDepths, g1.depth, g1.conditionalQuality) == ("NA1", False, [1, 2], [2, 15, 13], 30, 99)
    assert g1.phredLikelihoods == [2407, 645, 533, 697, 0, 574]
    assert (g2.sampleId, g2.phased, g2.calls, g2.alleleDepths, g2.depth, g2.conditionalQuality) == ("NA2", True, [0, 1], None, None, 7)
    assert b.genotypes[0].calls == [-1, -1] and b.genotypes[0].depth == 4 and b.genotypes[1].depth is None
    assert c.genotypes[1].calls == [-1] and d.genotypes == []


def test_read_options(spark, vcf):
    assert "sampleId" not in v.read_vcf(spark, vcf, include_sample_ids=False).schema["genotypes"].dataType.elementType.fieldNames()
    assert v.read_vcf(spark, vcf, split_to_biallelic=True).count() == 5


def test_identifiers(spark, vcf):
    df = v.read_vcf(spark, vcf)
    multi = [r[0] for r in df.select(v.variant_spdi(alt="alternateAlleles", join_alternate_alleles=True)).collect()]
    assert multi[:2] == ["20:10009874:A:G,AGGGAGG", "20:10009878:A:G"]
    split = v.split_multiallelics(df)
    ids = [r[0] for r in split.select(v.variant_spdi(alt=F.get("alternateAlleles", F.lit(0)))).collect()]
    assert ids[:3] == ["20:10009874:A:G", "20:10009874:A:AGGGAGG", "20:10009878:A:G"]


def test_other_sample_columns_fail(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(TEXT)
    (tmp_path / "b.vcf").write_text(TEXT.replace("NA2", "NB2"))
    with pytest.raises(Exception, match="sample columns differ"):
        v.read_vcf(spark, str(tmp_path)).collect()


def test_long_header_is_read_to_its_end(spark, tmp_path):
    more = "".join(f"##contig=<ID=c{i}>\n" for i in range(3000))
    (tmp_path / "a.vcf").write_text(HEADER + more + COLUMNS + LINES[0].replace(" ", "\t") + "\n")
    row = v.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert [g.sampleId for g in row.genotypes] == ["NA1", "NA2"]


def test_headers_of_all_files_are_merged(spark, tmp_path):
    line = "1 5 . A G . PASS DP=7\n".replace(" ", "\t")
    declared = "##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer>\n"
    other = '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n'
    columns = "#CHROM POS ID REF ALT QUAL FILTER INFO\n".replace(" ", "\t")
    for name, header in (("a", declared), ("b", other)):
        (tmp_path / f"{name}.vcf").write_text(header + columns + line)
    rows = v.read_vcf(spark, str(tmp_path)).collect()
    assert [(r.INFO_DP, r.INFO_AF) for r in rows] == [(7, None), (7, None)]
    (tmp_path / "c.vcf").write_text(declared.replace("Integer", "Float") + columns + line)
    with pytest.raises(ValueError, match="DP is declared in different ways"):
        v.read_vcf(spark, str(tmp_path))


def test_info_is_parsed_as_written(spark, tmp_path):
    header = "".join(f"##INFO=<ID={k},Number=1,Type=String>\n" for k in ("A", "A.b", "Q", "E")) + "##INFO=<ID=F,Number=0,Type=Flag>\n"
    lines = ['A=1;A.b=x=y;Q=a"b\\c;F', "E=;F=1;A=.", ".", "AA=3;BF;Q={}"]
    text = "".join(f"1\t{i + 1}\t.\tA\tG\t.\t.\t{info}\n" for i, info in enumerate(lines))
    (tmp_path / "x.vcf").write_text(header + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + text)
    rows = v.read_vcf(spark, str(tmp_path)).orderBy("start").collect()
    got = [(r.INFO_A, r["INFO_A.b"], r.INFO_Q, r.INFO_E, r.INFO_F) for r in rows]
    assert got == [("1", "x=y", 'a"b\\c', None, True), (None, None, None, None, True), (None,) * 4 + (False,), (None, None, "{}", None, False)]


def test_genotypes_stay_with_their_samples(spark):
    kind = "contigName string, start long, referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId: string, calls: array<int>>>"
    rows = [
        ("1", 1, "A", ["G"], []),
        ("1", 2, "A", ["G"], [("s1", [0, 0]), ("s2", [1, 1])]),
        ("1", 3, "A", ["G"], [("s2", [1, 1]), ("s1", [0, 0])]),
        ("1", 4, "A", ["G"], [("s2", [0, 1])]),
    ]
    df = spark.createDataFrame(rows, kind)
    back = v.pipe_lines(df, ["cat"], output_format="vcf").orderBy("start").collect()
    calls = [{g.sampleId: g.calls for g in r.genotypes} for r in back]
    assert calls[1] == calls[2] == {"s1": [0, 0], "s2": [1, 1]}
    assert calls[0] == {"s1": [-1], "s2": [-1]} and calls[3] == {"s1": [-1], "s2": [0, 1]}
    with pytest.raises(Exception, match="samples not in the header"):
        v.format_vcf_lines(df, ["s1"]).collect()


def test_header_of_a_command_counts(spark, vcf):
    program = '/^#CHROM/ { print "##INFO=<ID=CSQ,Number=1,Type=String>" } /^#/ { print; next } { $8 = $8 ";CSQ=zz"; print }'
    got = v.pipe_lines(v.read_vcf(spark, vcf).repartition(2), ["awk", "-F", "\t", "-v", "OFS=\t", program], output_format="vcf")
    assert {r.INFO_CSQ for r in got.collect()} == {"zz"}


def test_write_and_read_again(spark, vcf, tmp_path):
    df = v.read_vcf(spark, vcf)
    v.write_vcf(df.repartition(3), str(tmp_path / "out"))
    key = lambda d: sorted(str(r) for r in d.select("contigName", "start", "names", "alternateAlleles", "qual", "filters", "INFO_AC", "INFO_DS", "genotypes.calls", "genotypes.alleleDepths").collect())
    here = "start < 10010392"
    assert key(v.read_vcf(spark, str(tmp_path / "out")).filter(here)) == key(df.filter(here))
    parts = sorted(str(p) for p in (tmp_path / "out").glob("part-*"))
    assert sum(v.read_vcf(spark, p).count() for p in parts) == 4


def test_gtf(spark, tmp_path):
    (tmp_path / "x.gtf").write_text(
        '#!genome\n1\thavana\ttranscript\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "a b";\n'
        '1\thavana\texon\t101\t150\t0.5\t-\t2\tgene_id "G1"; exon_number 7; exon_id "E1"\n'
    )
    a, b = v.read_gtf(spark, str(tmp_path / "x.gtf")).collect()
    assert (a.Chromosome, a.Feature, a.Start, a.End, a.Score, a.Strand, a.Frame) == ("1", "transcript", 100, 200, None, "+", None)
    assert (a.gene_id, a.transcript_id, a.gene_name, a.exon_id) == ("G1", "T1", "a b", None)
    assert (b.exon_number, b.exon_id, b.Frame, b.Score) == ("7", "E1", 2, 0.5)


def test_pipe_keeps_rows_and_formats(spark, vcf):
    df = v.read_vcf(spark, vcf).repartition(3)
    text = v.pipe_lines(df, ["cat"])
    assert text.filter("not text like '#%'").count() == 4
    assert v.pipe_lines(df, ["cat"], output_format="vcf").count() == 4
    raw = spark.createDataFrame([("a b",), ("ü",)], "value string")
    assert sorted(r.text for r in v.pipe_lines(raw, ["cat"], input_format="text").collect()) == ["a b", "ü"]


def test_pipe_large_and_failing(spark):
    many = spark.range(200_000).selectExpr("cast(id as string) as value").repartition(2)
    assert v.pipe_lines(many, ["cat"], input_format="text").distinct().count() == 200_000
    assert v.pipe_lines(many, ["head", "-n", "1"], input_format="text").count() == 2
    with pytest.raises(Exception, match="exit code 3"):
        v.pipe_lines(many, ["sh", "-c", "cat > /dev/null; exit 3"], input_format="text").collect()


def test_annotate_default_ids_and_scalar_alt(spark):
    df = spark.createDataFrame([("1", 9, 10, "A", "T")], "contigName string, start long, end long, referenceAllele string, alt string")
    program = '!/^#/ { printf "{\\"seq_region_name\\":\\"%s\\",\\"start\\":%d,\\"id\\":\\"%s\\",\\"input\\":\\"q\\"}\\n", $1, $2, $3 }'
    got = v.annotate(df, ["awk", "-F", "\t", program], alt="alt", alt_is_array=False)
    assert "input" not in got.columns
    assert got.select("seq_region_name", "start", "id").collect() == [("1", 10, "1:9:A:T")]
    named = v.annotate(df, ["awk", "-F", "\t", program], alt="alt", alt_is_array=False, id="concat('x', start)", id_is_array=False)
    assert named.first().id == "x9"


def test_tables(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "concat('chr', id % 2) as contigName")
    preview = v.write_and_check(df, str(tmp_path / "t"), partition_by=["contigName"])
    assert len(preview) == 5 and v.read_table(spark, str(tmp_path / "t")).count() == 10
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        v.write_table(df, str(tmp_path / "t"))


def test_identifiers_of_a_whole_sample(spark, tmp_path):
    sites = [line.split() for line in golden_ids.SITES.split("\n") if line]
    path = tmp_path / "sample.vcf.gz"
    with gzip.open(path, "wt") as f:
        f.write(HEADER + COLUMNS.replace("\tNA2", ""))
        f.writelines(f"20\t{pos}\t.\t{ref}\t{alt}\t1\t.\t.\tGT\t0/1\n" for pos, ref, alt in sites)
    df = v.read_vcf(spark, str(path))
    whole = df.select(v.variant_spdi(alt="alternateAlleles", join_alternate_alleles=True)).collect()
    split = v.split_multiallelics(df).select(v.variant_spdi(alt=F.get("alternateAlleles", F.lit(0)))).collect()
    assert [r[0] for r in whole] == golden_ids.WHOLE.split() and len(whole) == 50
    assert sorted(r[0] for r in split) == sorted(golden_ids.SPLIT.split()) and len(split) == 51


def test_keys_that_differ_in_case(spark, tmp_path):
    lines = [
        '##INFO=<ID=AC,Number=A,Type=Integer,Description="">',
        '##INFO=<ID=ac,Number=1,Type=String,Description="">',
        '##INFO=<ID=Ac,Number=0,Type=Flag,Description="">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="">',
        '##FORMAT=<ID=XY,Number=1,Type=Integer,Description="">',
        '##FORMAT=<ID=xy,Number=1,Type=String,Description="">',
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts",
        "1\t5\t.\tA\tC\t.\t.\tAC=3;ac=low;Ac\tGT:XY:xy\t0/1:1:two",
        "1\t6\t.\tA\tC\t.\t.\tac=x\tGT:xy\t0/0:only",
    ]
    header = v.VcfHeader.parse(lines)
    table = v.parse_vcf_lines(spark.createDataFrame([(x,) for x in lines], "value string"), header)
    first, second = sorted(table.collect(), key=lambda r: r.start)
    assert (first.INFO_AC, first.INFO_ac_2, first.INFO_Ac_3) == ([3], "low", True)
    assert (second.INFO_AC, second.INFO_ac_2, second.INFO_Ac_3) == (None, "x", False)
    assert (first.genotypes[0].XY, first.genotypes[0].xy_2, second.genotypes[0].XY, second.genotypes[0].xy_2) == (1, "two", None, "only")
    v.write_vcf(table, str(tmp_path / "cases"))
    again = sorted(v.read_vcf(spark, str(tmp_path / "cases")).collect(), key=lambda r: r.start)
    assert [r.asDict(True) for r in again] == [first.asDict(True), second.asDict(True)]


def test_plans_of_many_samples_are_built_at_once(spark):
    import time

    names = [f"sample{i * 7919 % 100_003}" for i in range(100_000)]
    header = v.VcfHeader.parse(['##FORMAT=<ID=GT,Number=1,Type=String,Description="">', "\t".join(["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT", *names])])
    line = "\t".join(["1\t5\t.\tA\tC\t.\t.\t.\tGT", *(["0/1", "0/0"] * 50_000)])
    lines = spark.createDataFrame([(line,)], "value string")
    began = time.time()
    table = v.parse_vcf_lines(lines, header)
    written = v.format_vcf_lines(table.withColumn("genotypes", F.reverse("genotypes")), names)
    table.schema, written.schema
    assert time.time() - began < 1
    back = written.first()[0].split("\t")
    assert back[9:] == ["0/1", "0/0"] * 50_000
    assert [g.sampleId for g in table.select("genotypes").first()[0]] == names


def test_samples_that_a_row_lacks_or_has_besides(spark):
    kind = "contigName string, start long, referenceAllele string, alternateAlleles array<string>, genotypes array<struct<calls:array<int>,sampleId:string>>"
    rows = [("1", 1, "A", ["C"], [([0, 1], "b"), ([1, 1], "d")]), ("1", 2, "A", ["C"], [])]
    got = [r[0].split("\t")[9:] for r in v.format_vcf_lines(spark.createDataFrame(rows, kind), ["d", "a", "b"]).collect()]
    assert got == [["1/1", ".", "0/1"], [".", ".", "."]]
    for bad in ([([0, 1], "z")], [([0, 1], "b"), ([0, 1], "b")], [([0, 1], None)]):
        with pytest.raises(Exception, match="not in the header"):
            v.format_vcf_lines(spark.createDataFrame([("1", 1, "A", ["C"], bad)], kind), ["d", "a", "b"]).collect()
