import gzip
import io
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from varlake.plans import catalog
from varlake.sources import bgzip, blocks
from varlake.sources.fasta import index_fasta, read_indexed_bases, read_reference_bases
from varlake.sources.vcf import read_vcf, write_vcf


def packed(text, cut=None, monkeypatch=None):
    """Text in blocks of at most ``cut`` bytes."""
    sink = io.BytesIO()
    writer = blocks.BlockWriter(sink)
    for at in range(0, len(text), cut or len(text) or 1):
        writer.write(text[at : at + (cut or len(text))])
        if cut:
            writer._flush()
    writer.close()
    return sink.getvalue()


def some_lines(seed, n):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"abcXYZ\x1f\x8b\x08\x04") for _ in range(rng.choice([0, 1, 30, 200, 3_000]))).replace(b"\n", b"") for _ in range(n)]


@pytest.mark.parametrize("cut", [7, 100, 5_000, None])
@pytest.mark.parametrize("last", [b"\n", b""])
def test_each_line_has_one_owner_however_a_file_is_cut(cut, last):
    lines = some_lines(cut or 0, 60)
    lines[-1] = lines[-1] or b"end"
    data = packed(b"\n".join(lines) + last, cut)
    assert gzip.decompress(data) == b"\n".join(lines) + last
    for step in (11, 60, 1_000, 70_000, len(data)):
        found = []
        for start in range(0, len(data), step):
            found += blocks.lines_of_bytes(io.BytesIO(data), start, min(start + step, len(data)), len(data))
        assert [line for _, line in found] == lines
        offsets = [offset for offset, _ in found]
        assert offsets == sorted(set(offsets))
    # A range of virtual offsets, both starts of lines, gives the lines between them.
    for a, b in ((0, 10), (7, 8), (20, len(lines))):
        stop = offsets[b] if b < len(lines) else 1 << 62
        assert [line for _, line in blocks.lines_of_offsets(io.BytesIO(data), offsets[a], stop)] == lines[a:b]


def test_damage_is_an_error():
    data = packed(b"some text\n" * 500)
    with pytest.raises((ValueError, zlib.error)):
        list(blocks.lines_of_bytes(io.BytesIO(data[:30] + b"!" + data[31:]), 0, len(data), len(data)))
    with pytest.raises(ValueError):
        list(blocks.lines_of_bytes(io.BytesIO(data[:40]), 0, 40, 40))


def test_index_finds_all_records_of_a_region(tmp_path):
    rng = random.Random(3)
    records, index, offset = [], blocks.Tabix(), 1 << 16
    for contig in ("1", "2"):
        start = 0
        for _ in range(800):
            start += rng.choice([0, 1, 50, 4_000, 40_000])
            end = start + rng.choice([1, 1, 5, 90_000])
            after = offset + rng.choice([10, 90, 1 << 16])
            index.add(contig, start, end, offset, after)
            records.append((contig, start, end, offset))
            offset = after
    path = tmp_path / "x.tbi"
    path.write_bytes(index.to_bytes())
    again = blocks.Tabix.read(str(path))
    assert again == index
    most = max(end for *_, end, _ in records)
    for _ in range(300):
        low = rng.randrange(most + 10)
        high = low + rng.choice([1, 100, 100_000, most])
        ranges = again.ranges("2", low, high)
        assert all(a < b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        for contig, start, end, at in records:
            if contig == "2" and start < high and end > low:
                assert any(a <= at < b for a, b in ranges)
    whole = again.ranges("1")
    assert again.ranges("3") == [] and sum((b >> 16) - (a >> 16) for a, b in again.ranges("1", 0, 50_000)) < sum((b >> 16) - (a >> 16) for a, b in whole) / 4
    (first, after), *_ = whole
    parts = again.cut("1", first, after, 20)
    assert len(parts) > 3 and parts[0][0] == first and parts[-1][1] == after and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def numbered(start, end, depth):
    """The bin that the format's description gives for [start, end)."""
    shift, first = 14, ((1 << depth * 3) - 1) // 7
    for level in range(depth, 0, -1):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
        shift, first = shift + 3, first - (1 << (level - 1) * 3)
    return 0


@pytest.mark.parametrize("most, depth", [(1 << 29, 5), ((1 << 29) + 1, 6), (1 << 32, 6), ((1 << 32) + 1, 7), (1 << 36, 8)])
def test_index_of_any_positions(tmp_path, most, depth):
    rng = random.Random(depth)
    index, offset, records = blocks.Tabix(), 1 << 16, []
    spans = [(start, min(most, start + rng.choice([1, 5, 40_000, 1 << 28]))) for start in sorted(rng.randrange(most - 1) for _ in range(600))]
    for contig, start, end in [("chr1", 10, 20), *(("chr2", *span) for span in [*spans, (most - 1, most)])]:
        after = offset + rng.choice([10, 90, 1 << 16])
        index.add(contig, start, end, offset, after)
        records.append((contig, start, end, offset))
        offset = after
    assert index.depth == depth and index.suffix == (".tbi" if depth == 5 else ".csi")
    path = tmp_path / f"x.vcf.gz{index.suffix}"
    path.write_bytes(index.to_bytes())
    again = blocks.Tabix.of(str(tmp_path / "x.vcf.gz"))
    assert {c: one.bins for c, one in again.contigs.items()} == {c: one.bins for c, one in index.contigs.items()}
    for low, high in [(0, 1), (most - 1, most), (0, most)] + [(low, low + rng.choice([1, 1 << 20])) for low in (rng.randrange(most) for _ in range(200))]:
        ranges = again.ranges("chr2", low, high)
        for contig, start, end, at in records:
            if contig == "chr2" and start < high and end > low:
                assert any(a <= at < b for a, b in ranges)
    assert len(again.ranges("chr2", most - 1, most)[0]) == 2 and again.ranges("chr2", most + (1 << 40)) == []
    data = gzip.decompress(path.read_bytes())
    if depth == 5:
        return
    # Byte by byte as the format's description says: head, names, then bins with their least offsets.
    assert data[:4] == b"CSI\x01" and struct.unpack_from("<3i", data, 4) == (14, depth, 38)
    assert struct.unpack_from("<7i", data, 16) == (2, 1, 2, 0, 35, 0, 10) and data[44:54] == b"chr1\0chr2\0"
    place, found = 58, []
    for contig in ("chr1", "chr2"):
        (n_bins,) = struct.unpack_from("<i", data, place)
        place += 4
        for _ in range(n_bins):
            number, least, n_chunks = struct.unpack_from("<IQi", data, place)
            chunks = struct.unpack_from(f"<{2 * n_chunks}Q", data, place + 16)
            found.append((contig, number, least, list(zip(chunks[::2], chunks[1::2]))))
            place += 16 + 16 * n_chunks
    assert place == len(data)
    of = {(contig, number): (least, chunks) for contig, number, least, chunks in found}
    for contig, start, end, at in records:
        least, chunks = of[contig, numbered(start, end, depth)]
        assert least <= at and any(a <= at < b for a, b in chunks)
    with pytest.raises(ValueError, match="positions beyond"):
        index.add("chr2", 0, 1 << 45, offset, offset + 1)


def table(spark, n=3_000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        start = rng.randrange(3_000_000)
        ref = rng.choice(["A", "C", "ACGT", "G" * 40])
        rows.append((rng.choice(["chr1", "chr2", "chrX"]), start, start + len(ref), [f"r{i}"], ref, ["T"], float(rng.randrange(200)), ["PASS"], i))
    kind = "contigName string, start long, end long, names array<string>, referenceAllele string, alternateAlleles array<string>, qual double, filters array<string>, INFO_AC int"
    return spark.createDataFrame(rows, kind).repartition(4)


def rows_of(df):
    return sorted(str(row.asDict()) for row in df.collect())


def test_sink_scan_and_regions(spark, tmp_path):
    df, path = table(spark), str(tmp_path / "out")
    bgzip.write_vcf_blocks(df, path, partitions=3)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["_SUCCESS", *sorted(f"part-0000{i}.vcf.bgz{end}" for i in range(3) for end in ("", ".tbi"))]
    back = bgzip.read_vcf_blocks(spark, path, part_bytes=5_000)
    columns = df.columns
    assert rows_of(back.select(*columns)) == rows_of(df.select(*columns))
    assert back.rdd.getNumPartitions() > 6
    # Files are sorted, and other readers take them for gzip.
    for i in range(3):
        lines = gzip.decompress((tmp_path / "out" / f"part-0000{i}.vcf.bgz").read_bytes()).decode().splitlines()
        sites = [(a, int(b)) for a, b, *_ in (line.split("\t") for line in lines if not line.startswith("#"))]
        assert sites == sorted(sites) and lines[0].startswith("##fileformat")
    where = "contigName = 'chr2' and start >= 1000000 and start < 1200000 and qual > 50"
    part = bgzip.read_vcf_blocks(spark, path, where=where)
    assert rows_of(part.select(*columns)) == rows_of(df.where(where).select(*columns)) != []
    parsed = bgzip.scan_blocks(spark, path).where("contigName in ('chr1', 'chrX') and end <= 400")
    assert parsed.count() == df.where("contigName in ('chr1', 'chrX') and end <= 400").count()
    with pytest.raises(FileExistsError):
        bgzip.write_vcf_blocks(df, path)


def test_positions_that_a_tabix_index_cannot_hold(spark, tmp_path):
    far = (1 << 31) - 1_500_000
    df = table(spark).withColumns({name: F.when(F.col("contigName") == "chr1", F.col(name)).otherwise(F.col(name) + far) for name in ("start", "end")})
    path = str(tmp_path / "out")
    bgzip.write_vcf_blocks(df, path, partitions=3)
    names = sorted(p.name for p in (tmp_path / "out").glob("*.[tc][bs]i"))
    assert names[1:] == ["part-00001.vcf.bgz.csi", "part-00002.vcf.bgz.csi"]
    back = bgzip.read_vcf_blocks(spark, path, part_bytes=5_000)
    assert rows_of(back.select(*df.columns)) == rows_of(df)
    for low in (1_000_000, far + 1_000_000, (1 << 31) - 100_000):
        where = f"contigName in ('chr1', 'chr2') and start >= {low} and start < {low + 200_000} and qual > 50"
        part = bgzip.read_vcf_blocks(spark, path, where=where)
        assert rows_of(part.select(*df.columns)) == rows_of(df.where(where)) != []
    wanted = bgzip.Wanted(contigs=frozenset(["chr2"]), start=(far + 1_000_000, far + 1_010_000))
    some, whole = (sum(part.compressed() for part in bgzip.planned([path], one, 1 << 30)) for one in (wanted, bgzip.Wanted(contigs=frozenset(["chr1", "chr2", "chrX"]))))
    assert 0 < some < whole


def test_a_table_whose_positions_pass_the_tabix_limit(spark, tmp_path):
    keys = [*range(53_687_080, 53_687_100), 7, 7, 250_000_000]
    orders = [(k, k % 11, "FOP"[k % 3], float(i)) for i, k in enumerate(keys)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalog.vcf_block_round_trip(spark, str(tmp_path)).collect()
    assert sorted(r["start"] for r in rows) == sorted(10 * k for k in keys)
    assert all(r["samples"] == ",".join(catalog.SAMPLES) for r in rows)


def test_bytes_read_fall_with_the_region(spark, tmp_path):
    df, path = table(spark, 120_000), str(tmp_path / "out")
    bgzip.write_vcf_blocks(df, path, partitions=1)

    def read(**bounds):
        return sum(part.compressed() for part in bgzip.planned([path], bgzip.Wanted(**bounds), 1 << 30))

    whole = read()
    contig = read(contigs=frozenset(["chr1"]))
    window = read(contigs=frozenset(["chr1"]), start=(1_000_000, 1_010_000))
    assert window < contig / 2 < whole / 4 and read(contigs=frozenset(["none"])) == 0


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "out")
    df = table(spark, 20_000)
    bgzip.write_vcf_blocks(df, path, partitions=3)
    where = "contigName = 'chr2' and start > 500000 and start <= 900000 and qual >= 10"
    parts = bgzip.scan_blocks(spark, path, part_bytes=20_000).where(where)
    every = bgzip.scan_blocks(spark, path, part_bytes=20_000, pushdown=False).where(where)
    assert parts.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 2
    assert parts.count() == every.count() == df.where(where).count()


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    bgzip.write_vcf_blocks(table(spark, 5).where("start < 0"), path)
    back = bgzip.read_vcf_blocks(spark, path)
    assert back.count() == 0 and "INFO_AC" in back.columns


def test_failed_jobs_leave_nothing(spark, tmp_path):
    path = tmp_path / "failed"
    bad = table(spark, 50).withColumn("names", F.when(F.col("INFO_AC") == 7, F.raise_error(F.lit("no")).cast("array<string>")).otherwise(F.col("names")))
    with pytest.raises(Exception, match="no"):
        bgzip.write_vcf_blocks(bad, str(path), partitions=2)
    assert not path.exists() or not list(path.iterdir())


def test_a_file_that_others_packed(spark, tmp_path):
    write_vcf(table(spark, 400).coalesce(1), str(tmp_path / "plain"))
    (one,) = (tmp_path / "plain").glob("part-*")
    (tmp_path / "x.vcf.gz").write_bytes(packed(one.read_bytes(), 300))
    assert blocks.is_bgzf(str(tmp_path / "x.vcf.gz")) and not blocks.is_bgzf(str(one))
    got = bgzip.read_vcf_blocks(spark, str(tmp_path / "x.vcf.gz"), part_bytes=2_000)
    assert got.rdd.getNumPartitions() > 5
    assert rows_of(got) == rows_of(read_vcf(spark, str(tmp_path / "plain")))


@pytest.mark.parametrize("width", [7, 60])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_indexed_bases_are_those_of_the_scan(spark, tmp_path, width, end):
    rng = random.Random(width)
    genome = {name: "".join(rng.choice("acgtN") for _ in range(n)) for name, n in (("chr1", 3_001), ("chr2", 700), ("e", 1), ("chr3", 2_048))}
    text = "".join(f">{name} text{end}" + "".join(bases[at : at + width] + end for at in range(0, len(bases), width)) for name, bases in genome.items())
    plain, bgz = tmp_path / "g.fa", tmp_path / "g.fa.gz"
    plain.write_bytes(text.encode())
    index_fasta(spark, str(plain))
    want = rows_of(read_reference_bases(spark, str(plain), 100, 30))
    assert rows_of(read_indexed_bases(spark, str(plain), chunk=100, overlap=30, partitions=5)) == want
    # The same from blocks, by an index of theirs.
    data = packed(text.encode(), 333)
    bgz.write_bytes(data)
    (tmp_path / "g.fa.gz.fai").write_bytes((tmp_path / "g.fa.fai").read_bytes())
    places, at = [], 0
    for place, part in blocks.blocks_from(io.BytesIO(data), 0):
        places.append((place, at))
        at += len(part)
    flat = [number for place in places[1:] for number in place]
    (tmp_path / "g.fa.gz.gzi").write_bytes(len(places[1:]).to_bytes(8, "little") + b"".join(n.to_bytes(8, "little") for n in flat))
    assert rows_of(read_indexed_bases(spark, str(bgz), chunk=100, overlap=30, partitions=3)) == want
    some = [("chr1", 3), ("chr1", 3), ("chr2", 6), ("chr2", 7), ("e", 0), ("nowhere", 0), ("chr1", -1), ("chr1", None)]
    wanted = spark.createDataFrame(some, "contigName string, chunk_id long")
    kept = [(r["contigName"], r["chunk_id"]) for r in read_indexed_bases(spark, str(bgz), wanted, 100, 30).collect()]
    assert sorted(kept) == [("chr1", 3), ("chr2", 6), ("e", 0)]


def test_readers_take_block_compressed_files_by_themselves(spark, tmp_path):
    import varlake as v

    df = table(spark, 2_000)
    v.write_vcf_blocks(df, str(tmp_path / "out"), partitions=2)
    for path in (str(tmp_path / "out"), str(tmp_path / "out" / "part-*.bgz")):
        read = v.read_vcf(spark, path)
        assert rows_of(read.select(*df.columns)) == rows_of(df)
        assert "BatchScan vcf_blocks" in read._jdf.queryExecution().executedPlan().toString()
    gtf = "".join(f"chr1\tm\ttranscript\t{i}\t{i + 5}\t.\t+\t.\tgene_id \"g{i}\";\n" for i in range(1, 3_000)).encode()
    (tmp_path / "g.gtf.gz").write_bytes(packed(gtf, 5_000))
    (tmp_path / "g.gtf").write_bytes(gtf)
    assert rows_of(v.read_gtf(spark, str(tmp_path / "g.gtf.gz"))) == rows_of(v.read_gtf(spark, str(tmp_path / "g.gtf")))
    with gzip.open(tmp_path / "plain.gtf.gz", "wb") as f:
        f.write(gtf)
    assert v.read_gtf(spark, str(tmp_path / "plain.gtf.gz")).count() == 2_999
