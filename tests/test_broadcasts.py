"""Tables that grow by rows of their own are not broadcast, however small Spark takes them for."""

import pytest

import varlake as v
from varlake.plans import workflows
from varlake.sources.fasta import IndexedReference, index_fasta
from test_burden import RECORDS, TERMS, VARIANTS
from test_plans import plan

SITE = "contigName string, start long, end long"


def merged(df):
    text = plan(df)
    return "SortMergeJoin" in text and "BroadcastHashJoin" not in text and "BroadcastExchange" not in text


def test_overlaps_are_not_broadcast(spark):
    sites = spark.createDataFrame([("1", 10, 20), ("1", 50, 51), ("1", 50, 51), ("2", 5, 6)], SITE)
    features = spark.createDataFrame([("1", 15, 900, "a", 3), ("1", 0, 11, "b", None)], f"{SITE}, name string, size int")
    pairs = v.overlap_pairs(sites, features)
    assert merged(pairs)
    assert sorted((r.start, r.name) for r in pairs.collect()) == [(10, "a"), (10, "b"), (50, "a"), (50, "a")]
    flat = v.annotate_overlap(sites, features, "hit", ["size"], nested=False)
    assert plan(flat).count("SortMergeJoin") >= 2
    found = sorted((r.contigName, r.start, r.hit and r.hit.name) for r in flat.collect())
    assert found == [("1", 10, "a"), ("1", 10, "b"), ("1", 50, "a"), ("1", 50, "a"), ("2", 5, None)]


def test_genotypes_and_consequences_are_not_broadcast(spark):
    left = spark.createDataFrame([("1", 10, 12, "r", 1), ("1", 10, 12, "r", 2), ("2", 7, 9, "s", 3)], f"{SITE}, id string, g int")
    right = spark.createDataFrame([("1", 11, 12, "r", 5), ("1", 11, 12, "r", 6), (None, 8, 9, "t", 7)], "seq_region_name string, start long, end long, id string, c int")
    for on_id in (False, True):
        joined = v.join_consequences(left, right, on_id=on_id)
        assert merged(joined)
        assert sorted((r.g, r.c) for r in joined.collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]


def test_scores_are_not_broadcast(spark):
    change = "transcript_id string, protein_start long, amino_acids string"
    consequences = spark.createDataFrame([("T", 1, "A/B"), ("T", 2, "A/B"), (None, 1, "A/B")], change)
    scores = spark.createDataFrame([("T", 1, "A/B", "bad", 0.5)], f"{change}, prediction string, score double")
    scored = v.annotate_transcript_scores(consequences, scores, "sift")
    assert merged(scored)
    assert sorted((r.transcript_id or "", r.protein_start, r.sift_score) for r in scored.collect() if r.sift_score) == [("T", 1, 0.5)]
    assert scored.count() == 3


def test_indexes_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    contigs = [f"c{i}" for i in range(30)]
    for k in range(2):
        text = "".join(f">{name} x\nACGTA\nCGT\n" for name in contigs[k::2])
        (tmp_path / f"{k}.fa").write_text(text)
    index_fasta(spark, str(tmp_path))
    assert (tmp_path / "0.fa.fai").read_text().splitlines()[:2] == ["c0\t8\t6\t5\t6", "c2\t8\t22\t5\t6"]
    monkeypatch.setattr(IndexedReference, "of", None)
    rows = v.read_indexed_bases(spark, str(tmp_path), chunk=6, overlap=2).collect()
    assert sorted(map(tuple, rows)) == sorted(row for c in contigs for row in [(c, 0, 0, "ACGTAC"), (c, 1, 4, "ACGT")])
    wanted = spark.createDataFrame([("c3", 1), ("c3", 1), ("c3", 2), ("c3", -1), ("c3", 2**62), ("c9", 0), ("d", 0), (None, 0), ("c4", None)], "contigName string, chunk_id long")
    found = v.read_indexed_bases(spark, str(tmp_path), wanted, 6, 2)
    assert "BroadcastExchange" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("c3", 1, 4, "ACGT"), ("c9", 0, 0, "ACGTAC")]
    (tmp_path / "2.fa").write_text(">c3\nAC\n")
    with pytest.raises(FileNotFoundError):
        v.read_indexed_bases(spark, str(tmp_path))
    index_fasta(spark, str(tmp_path))
    with pytest.raises(ValueError, match="c3 is in more than one place"):
        v.read_indexed_bases(spark, str(tmp_path))
    (tmp_path / "3.fa").write_text(">u\nACG\nA\nACG\n")
    with pytest.raises(Exception, match="lines of u differ"):
        index_fasta(spark, str(tmp_path / "3.fa"))
    assert not list(tmp_path.glob("3.fa.*"))


def test_genotypes_are_spread_after_the_join(spark):
    variants, records = spark.createDataFrame([], VARIANTS), spark.createDataFrame([], RECORDS)
    joined = workflows.joined_genotypes(variants, records, TERMS)
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Join") :]
    assert "Generate" in text[: text.index("Join")] and "num_alt_alleles" in below and "genotype#" not in below
    burden = workflows.burden_table(variants, records, "count", TERMS)
    assert "SortMergeJoin" in plan(burden)
