"""Per-variant summaries of the nested genotype list.

All of them are higher-order functions over one row's array: no shuffle and no Python worker. They take the needed
field of all genotypes first (``genotypes.calls``), which lets Parquet leave the other fields on disk; a field access
inside a lambda would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varlake.functions._columns import as_column, bind

#: Genotype state of a sample with at least one missing call.
NOT_MEASURED = -1


def genotype_states(genotypes: str | Column = "genotypes") -> Column:
    """Number of alternate alleles per sample; -1 where a call is missing or there are no calls."""

    def state(calls: Column) -> Column:
        unknown = calls.isNull() | (F.size(calls) == 0) | F.exists(calls, lambda c: c.isNull() | (c < 0))
        return F.when(unknown, F.lit(NOT_MEASURED)).otherwise(
            F.aggregate(calls, F.lit(0), lambda total, call: total + call)
        )

    return F.transform(as_column(genotypes).getField("calls"), state)


def _count(array: Column, predicate) -> Column:
    return F.size(F.filter(array, predicate))


def zygosity_summary(states: str | Column = "num_alt_alleles") -> Column:
    """Struct of sample counts per genotype state; every field is null for a null array."""
    array = as_column(states)
    known = (NOT_MEASURED, 0, 1, 2)

    def counted(count: Column) -> Column:
        # Without ANSI mode the size of null is -1.
        return F.when(array.isNotNull(), count)

    return F.struct(
        counted(F.size(array)).alias("n_samples"),
        counted(_count(array, lambda x: x == 2)).alias("n_homo"),
        counted(_count(array, lambda x: x == 1)).alias("n_hetero"),
        counted(_count(array, lambda x: x == 0)).alias("n_ref"),
        counted(_count(array, lambda x: x == NOT_MEASURED)).alias("n_not_measured"),
        F.array_distinct(F.filter(array, lambda x: ~x.isin(*known))).alias("other"),
    )


def call_summary_stats(
    genotypes: str | Column = "genotypes", alternate_alleles: str | Column = "alternateAlleles"
) -> Column:
    """Call rate and allele statistics of one variant.

    ``alleleCounts`` and ``alleleFrequencies`` list the reference allele first. Frequencies are relative to the
    called alleles and null when nothing was called.
    """
    none = F.array().cast("array<int>")
    array = as_column(genotypes).getField("calls")
    alleles = F.sequence(F.lit(0), F.size(as_column(alternate_alleles)))
    calls = F.flatten(F.transform(array, lambda sample: F.coalesce(sample, none)))

    def from_called(called: Column) -> Column:
        counts = F.transform(alleles, lambda allele: _count(called, lambda c: c == allele))
        return F.struct(F.size(called).alias("n"), counts.alias("counts"))

    def summary(x: Column) -> Column:
        n_called, n, counts = x["n_called"], x["called"]["n"], x["called"]["counts"]
        return F.struct(
            (n_called / F.nullif(F.size(array), F.lit(0))).alias("callRate"),
            n_called.alias("nCalled"),
            (F.size(array) - n_called).alias("nUncalled"),
            _count(array, _heterozygous).alias("nHet"),
            F.transform(alleles, lambda allele: _count(array, lambda sample: _homozygous(sample, allele))).alias("nHomozygous"),
            _count(calls, lambda c: c > 0).alias("nNonRef"),
            n.alias("nAllelesCalled"),
            counts.alias("alleleCounts"),
            F.transform(counts, lambda count: count / F.nullif(n, F.lit(0))).alias("alleleFrequencies"),
        )

    parts = F.struct(
        _count(genotype_states(genotypes), lambda state: state >= 0).alias("n_called"),
        bind(F.filter(calls, lambda c: c >= 0), from_called).alias("called"),
    )
    return bind(parts, summary)


def _complete(calls: Column) -> Column:
    return (F.size(calls) > 0) & ~F.exists(calls, lambda c: c < 0)


def _heterozygous(calls: Column) -> Column:
    return _complete(calls) & (F.size(F.array_distinct(calls)) > 1)


def _homozygous(calls: Column, allele: Column) -> Column:
    return _complete(calls) & F.forall(calls, lambda c: c == allele)


def _moments(values: Column) -> Column:
    """mean, sample standard deviation, min and max of the non-null elements of an array, in one pass over it."""
    start = F.struct(
        F.lit(0).alias("n"),
        F.lit(0.0).alias("mean"),
        F.lit(0.0).alias("m2"),
        F.lit(None).cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"),
    )

    def step(acc: Column, value: Column) -> Column:
        n = acc["n"] + 1
        delta = value - acc["mean"]
        mean = acc["mean"] + delta / n
        seen = F.struct(
            n.alias("n"),
            mean.alias("mean"),
            (acc["m2"] + delta * (value - mean)).alias("m2"),
            F.least(acc["min"], value).alias("min"),
            F.greatest(acc["max"], value).alias("max"),
        )
        return F.when(value.isNull(), acc).otherwise(seen)

    def finish(acc: Column) -> Column:
        return F.struct(
            F.when(acc["n"] > 0, acc["mean"]).alias("mean"),
            F.when(acc["n"] > 1, F.sqrt(acc["m2"] / (acc["n"] - 1))).alias("stdDev"),
            acc["min"].alias("min"),
            acc["max"].alias("max"),
        )

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), start, step, finish)


def depth_summary_stats(genotypes: str | Column = "genotypes") -> Column:
    """mean / stdDev / min / max of the samples' read depth."""
    return _moments(as_column(genotypes).getField("depth"))


def quality_summary_stats(genotypes: str | Column = "genotypes") -> Column:
    """mean / stdDev / min / max of the samples' conditional genotype quality."""
    return _moments(as_column(genotypes).getField("conditionalQuality"))
