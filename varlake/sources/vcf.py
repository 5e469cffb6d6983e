"""Variant call files (VCF text, plain or gzip/bgzip)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.functions._columns import bind, quoted, with_computed

# Column names of the format.
FIXED_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")

# Genotype fields with an established name, and their keys in the file.
GENOTYPE_FIELDS = {
    "AD": "alleleDepths",
    "DP": "depth",
    "GQ": "conditionalQuality",
    "PL": "phredLikelihoods",
    "GL": "genotypeLikelihoods",
    "GP": "posteriorProbabilities",
    "FT": "filters",
    "HQ": "haplotypeQualities",
    "EC": "expectedAlleleCounts",
    "MQ": "mappingQuality",
}

# Value types of the format.
_TYPES = {"Integer": "int", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}


@dataclass(frozen=True)
class Declaration:
    """One ``##INFO`` or ``##FORMAT`` line."""

    key: str
    number: str
    type: str

    @property
    def spark_type(self) -> str:
        base = _TYPES.get(self.type, "string")
        if self.number == "0":
            return "boolean"
        return base if self.number == "1" else f"array<{base}>"


@dataclass(frozen=True)
class VcfHeader:
    """What the header says about columns."""

    info: tuple[Declaration, ...] = ()
    formats: tuple[Declaration, ...] = ()
    sample_ids: tuple[str, ...] = ()
    column_line: str | None = field(default=None, compare=False)

    @staticmethod
    def parse(lines: Iterable[str]) -> VcfHeader:
        found: dict[str, dict[str, Declaration]] = {"INFO": {}, "FORMAT": {}}
        samples: tuple[str, ...] = ()
        column_line = None
        for line in lines:
            declared = re.match(r"##(INFO|FORMAT)=<(.*)>\s*$", line)
            if declared:
                # The free-text description comes last and is of no interest.
                parts = dict(re.findall(r"(ID|Number|Type)=([^,]*)", declared[2].split("Description=")[0]))
                if "ID" in parts:
                    entry = Declaration(parts["ID"], parts.get("Number", "."), parts.get("Type", "String"))
                    found[declared[1]].setdefault(entry.key, entry)
            elif line.startswith("#CHROM"):
                column_line = line.rstrip("\r\n")
                samples = tuple(column_line.split("\t")[len(FIXED_COLUMNS) + 1 :])
        return VcfHeader(tuple(found["INFO"].values()), tuple(found["FORMAT"].values()), samples, column_line)


def merge_headers(headers: Iterable[VcfHeader]) -> VcfHeader:
    """One header for several files: every declared key, in order of first mention.

    Declarations of one key that differ in number or type, and different sample columns, are errors.
    """
    found: dict[str, dict[str, Declaration]] = {"info": {}, "formats": {}}
    column_line = None
    samples: tuple[str, ...] = ()
    for header in headers:
        for kind, known in found.items():
            for declared in getattr(header, kind):
                if known.setdefault(declared.key, declared) != declared:
                    raise ValueError(f"{declared.key} is declared in different ways: {known[declared.key]}, {declared}")
        if header.column_line is not None:
            if column_line not in (None, header.column_line):
                raise ValueError("sample columns differ between files")
            column_line, samples = header.column_line, header.sample_ids
    return VcfHeader(tuple(found["info"].values()), tuple(found["formats"].values()), samples, column_line)


def header_of_lines(lines: DataFrame) -> VcfHeader:
    """The merged header of all header lines among ``lines`` (column ``value``).

    One distributed pass; only different declarations and column lines reach the driver.
    """
    value = F.rtrim(F.col("value"))
    wanted = value.startswith("##INFO=") | value.startswith("##FORMAT=") | value.startswith("#CHROM")
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.filter(F.col("value").startswith("#")).filter(wanted).select(value.alias("value"), place.alias("place"))
    first = rows.groupBy("value").agg(F.min("place").alias("place")).orderBy("place")
    return merge_headers(VcfHeader.parse([row.value]) for row in first.collect())


def _present(value: Column) -> Column:
    return F.nullif(F.nullif(value, F.lit(".")), F.lit(""))


def _typed(text: Column, declaration: Declaration) -> Column:
    """A value of the file as its declared type; missing or unreadable values are null."""
    base = _TYPES.get(declaration.type, "string")
    if declaration.number == "1":
        return _present(text).try_cast(base)
    return F.transform(F.split(_present(text), ","), lambda v: _present(v).try_cast(base))


def _column_names(declarations: Sequence[Declaration], known: Mapping[str, str] | None = None) -> list[str]:
    """Names of the columns or fields of keys; keys that differ in case only are numbered from the second on, ``AC``, ``ac_2``."""
    seen: Counter[str] = Counter()
    names = []
    for declaration in declarations:
        name = (known or {}).get(declaration.key, declaration.key)
        seen[name.lower()] += 1
        names.append(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}")
    return names


def _info_fields(info: Column, declarations: Sequence[Declaration]) -> Column:
    """The declared entries of an INFO text as a struct of strings k0, k1, ..., in one parse however many there are.

    The text is rewritten as a JSON object. A flag's value is "", an absent key's null; of a repeated key the last counts.
    """
    escaped = F.regexp_replace(info, r'([\\"])', r"\\$1")
    members = F.regexp_replace(escaped, "([^;=]+)(?:=([^;]*))?(?:;|$)", '"$1":"$2",')
    schema = T.StructType([T.StructField(d.key, T.StringType()) for d in declarations])
    parsed = F.from_json(F.concat(F.lit("{"), members, F.lit('"":""}')), schema, {"allowUnquotedControlChars": "true"})
    # Numbered, because keys may differ in case only.
    return parsed.cast(T.StructType([T.StructField(f"k{at}", T.StringType()) for at in range(len(declarations))]))


def _info_column(at: int, declaration: Declaration) -> Column:
    value = F.col("__info").getField(f"k{at}")
    return value.isNotNull() if declaration.number == "0" else _typed(value, declaration)


def _genotype(values: Column, sample_id: Column | None, formats: Sequence[Declaration]) -> Column:
    fields = [] if sample_id is None else [sample_id.alias("sampleId")]
    for at, (name, declaration) in enumerate(zip(_column_names(formats, GENOTYPE_FIELDS), formats)):
        raw = F.get(values, F.col(f"__at_{at}"))
        if declaration.key == "GT":
            # One separator of one character is found without a pattern, which would be compiled for every sample.
            calls = F.split(F.replace(raw, F.lit("|"), F.lit("/")), "/")
            fields.append(F.coalesce(F.contains(raw, F.lit("|")), F.lit(False)).alias("phased"))
            fields.append(
                # A failed cast throws inside, which costs more than all else; missing calls are common.
                F.transform(calls, lambda c: F.coalesce(F.when(c != ".", c.try_cast("int")), F.lit(-1))).alias("calls")
            )
        else:
            fields.append(_typed(raw, declaration).alias(name))
    return F.struct(*fields)


def _strings(values: Sequence[str]) -> Column:
    """An array literal of strings without tabs, as one expression however many there are."""
    return F.split(F.lit("\t".join(values)), "\t") if values else F.array().cast("array<string>")


def parse_vcf_lines(
    lines: DataFrame, header: VcfHeader, include_sample_ids: bool = True, split_to_biallelic: bool = False
) -> DataFrame:
    """VCF text lines (column ``value``) → variant table.

    ``start`` is 0-based, ``end`` the last reference base plus one or the declared ``END``. INFO columns are named
    ``INFO_<key>`` (of keys that differ in case only, the second ``INFO_<key>_2``; the key itself is in the metadata),
    genotypes are one array of structs in header order. Row-local, so it also parses a stream. Files
    whose sample columns differ from the header's fail instead of being misread.
    """
    value = F.col("value")
    data = ~value.startswith("#") & (F.length(value) > 0)
    if header.column_line is not None:
        other = value.startswith("#CHROM") & (F.rtrim(value) != F.lit(header.column_line))
        message = F.lit("sample columns differ between files")
        data = F.when(other, F.raise_error(message).cast("boolean")).otherwise(data)
    body = lines.filter(data)
    fields = F.split(F.rtrim(value), "\t")
    rows = with_computed(body, "__f", fields)
    rows = rows.select(
        *[F.get("__f", F.lit(i)).alias(name) for i, name in enumerate(FIXED_COLUMNS)],
        F.split(F.get("__f", F.lit(len(FIXED_COLUMNS))), ":").alias("FORMAT"),
        F.slice("__f", len(FIXED_COLUMNS) + 2, F.greatest(F.size("__f") - len(FIXED_COLUMNS) - 1, F.lit(0))).alias(
            "__samples"
        ),
    )
    if header.info:
        rows = with_computed(rows, "__info", _info_fields(F.col("INFO"), header.info))
    start = F.col("POS").try_cast("long") - 1
    end = start + F.length("REF")
    for at, declared in enumerate(header.info):
        if declared == Declaration("END", "1", "Integer"):
            end = F.coalesce(F.col("__info").getField(f"k{at}").try_cast("long"), end)

    def listed(column: str, separator: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.coalesce(F.split(_present(F.col(column)), separator), empty)

    columns = [
        F.col("CHROM").alias("contigName"),
        start.alias("start"),
        end.alias("end"),
        listed("ID", ";").alias("names"),
        F.col("REF").alias("referenceAllele"),
        listed("ALT", ",").alias("alternateAlleles"),
        _present(F.col("QUAL")).try_cast("double").alias("qual"),
        listed("FILTER", ";").alias("filters"),
        *[
            _info_column(at, d).alias(f"INFO_{name}", metadata={"number": d.number, "key": d.key})
            for at, (name, d) in enumerate(zip(_column_names(header.info), header.info))
        ],
    ]
    if header.formats:
        # Where each field sits in this row's samples is looked up once per row, not once per sample.
        rows = rows.withColumns(
            {
                f"__at_{at}": F.coalesce(
                    F.nullif(F.array_position("FORMAT", d.key), F.lit(0)) - 1, F.lit(-1)
                ).cast("int")
                for at, d in enumerate(header.formats)
            }
        )
        split = F.transform("__samples", lambda sample: F.split(sample, ":"))
        if include_sample_ids:
            ids = _strings(header.sample_ids)
            genotypes = F.transform(split, lambda values, i: _genotype(values, F.get(ids, i), header.formats))
        else:
            genotypes = F.transform(split, lambda values: _genotype(values, None, header.formats))
        named = dict(zip(_column_names(header.formats, GENOTYPE_FIELDS), header.formats))
        numbers = {"numbers": {name: d.number for name, d in named.items()}, "keys": {name: d.key for name, d in named.items()}}
        columns.append(genotypes.alias("genotypes", metadata=numbers))
    parsed = rows.select(*columns)
    if split_to_biallelic:
        from varlake.operators.variants import split_multiallelics

        parsed = split_multiallelics(parsed)
    return parsed


def read_vcf(
    spark: SparkSession,
    path: str | list[str],
    include_sample_ids: bool = True,
    split_to_biallelic: bool = False,
    header: VcfHeader | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Read VCF files as one table; unless a header is given, the headers of all files are read and merged.

    A key that only some files declare is a column of all rows, null where absent. See ``merge_headers`` for what fails.
    Block-compressed files are read by many tasks each, see ``read_vcf_blocks``. Any other compressed file is one split, so
    its lines are dealt out again by ``partitions`` before they are parsed, if given.
    """
    from varlake.sources.bgzip import header_of_blocks, in_blocks, text_lines

    lines = text_lines(spark, path)
    header = header or (header_of_blocks(spark, path) if in_blocks(path) else header_of_lines(lines))
    lines = lines.repartition(partitions) if partitions else lines
    return parse_vcf_lines(lines, header, include_sample_ids, split_to_biallelic)


# --- writing -------------------------------------------------------------------------------------------------------


def _text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        parts = F.transform(value, lambda v: F.coalesce(v.cast("string"), F.lit(".")))
        return F.when(F.size(value) > 0, F.array_join(parts, ","))
    return value.cast("string")


def _declaration(kind: str, key: str, dtype: T.DataType) -> str:
    number = "." if isinstance(dtype, T.ArrayType) else "1"
    base = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    if isinstance(base, T.BooleanType):
        number, name = "0", "Flag"
    elif isinstance(base, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        name = "Integer"
    elif isinstance(base, (T.FloatType, T.DoubleType)):
        name = "Float"
    else:
        name = "String"
    return f'##{kind}=<ID={key},Number={number},Type={name},Description="">'


def _genotype_keys(genotypes: T.StructField) -> list[tuple[str, T.StructField]]:
    names = {name: key for key, name in GENOTYPE_FIELDS.items()} | genotypes.metadata.get("keys", {})
    own = ("sampleId", "phased", "calls")
    return [(names.get(f.name, f.name), f) for f in genotypes.dataType.elementType.fields if f.name not in own]


def _info_key(field: T.StructField) -> str:
    return field.metadata.get("key", field.name.removeprefix("INFO_"))


def infer_vcf_header(schema: T.StructType, sample_ids: Sequence[str] = ()) -> list[str]:
    """Header lines that describe a variant table's columns."""
    lines = ["##fileformat=VCFv4.2"]
    for f in schema.fields:
        if f.name.startswith("INFO_"):
            lines.append(_declaration("INFO", _info_key(f), f.dataType))
    columns = list(FIXED_COLUMNS)
    if "genotypes" in schema.fieldNames():
        lines.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="">')
        lines += [_declaration("FORMAT", key, f.dataType) for key, f in _genotype_keys(schema["genotypes"])]
        columns += ["FORMAT", *sample_ids]
    return [*lines, "#" + "\t".join(columns)]


def _in_order(genotypes: Column, sample_ids: Sequence[str]) -> Column:
    """A row's genotypes in the order of ``sample_ids``; null for samples it lacks, an error for any it has besides.

    Both are sorted by name: a row's n-th name then belongs where the list's n-th does. Nothing is searched for each sample.
    """
    wanted = _strings(sample_ids)
    place = {sample: at for at, sample in enumerate(sorted(sample_ids))}
    ranks = _strings([str(place[sample]) for sample in sample_ids]).cast("array<int>")

    def aligned(listed: Column) -> Column:
        own = listed.getField("sampleId")
        absent = F.array_except(wanted, own)
        names = F.array_sort(
            F.concat(
                F.transform(own, lambda name, at: F.struct(name.alias("name"), at.alias("at"))),
                F.transform(absent, lambda name: F.struct(name.alias("name"), F.lit(-1).alias("at"))),
            )
        )
        known = (F.size(names) == len(sample_ids)) & (F.size(F.array_except(own, wanted)) == 0)
        found = bind(names, lambda sorted_: F.transform(ranks, lambda at: F.get(listed, F.get(sorted_, at)["at"])))
        error = F.raise_error(F.concat(F.lit("samples not in the header, or repeated: "), F.array_join(own, ",")))
        return F.when(own == wanted, listed).when(F.coalesce(known, F.lit(False)), found).otherwise(error)

    return bind(genotypes, aligned)


def format_vcf_lines(df: DataFrame, sample_ids: Sequence[str] | None = None) -> DataFrame:
    """Variant rows → VCF data lines in the column ``value``; absent columns are written as missing.

    The matching header is ``infer_vcf_header(df.schema, sample_ids)``. With ``sample_ids`` each row's genotypes are written
    in that order, whatever order the row lists them in; a sample that a row lacks is missing, one that is not in
    ``sample_ids`` fails. Without, a row's own order is written, which only suits rows that all list the same samples.
    """
    names = df.columns
    missing = F.lit(".")

    def optional(name: str, text: Column) -> Column:
        return F.coalesce(text, missing) if name in names else missing

    def joined(name: str, separator: str) -> Column:
        array = quoted(name)
        return F.when(F.size(array) > 0, F.array_join(array, separator))

    info = []
    for f in df.schema.fields:
        if not f.name.startswith("INFO_"):
            continue
        key = _info_key(f)
        if isinstance(f.dataType, T.BooleanType):
            info.append(F.when(quoted(f.name), F.lit(key)))
        else:
            info.append(F.concat(F.lit(f"{key}="), _text(quoted(f.name), f.dataType)))
    info_text = F.nullif(F.concat_ws(";", *info), F.lit("")) if info else F.lit(None).cast("string")

    columns = [
        F.col("contigName"),
        (F.col("start") + 1).cast("string"),
        optional("names", joined("names", ";")) if "names" in names else missing,
        F.col("referenceAllele"),
        F.coalesce(joined("alternateAlleles", ","), missing),
        optional("qual", F.col("qual").cast("string")) if "qual" in names else missing,
        optional("filters", joined("filters", ";")) if "filters" in names else missing,
        F.coalesce(info_text, missing),
    ]
    if "genotypes" in names:
        element = df.schema["genotypes"].dataType.elementType
        keys = _genotype_keys(df.schema["genotypes"])
        columns.append(F.lit(":".join(["GT", *[key for key, _ in keys]])))

        def sample(g: Column) -> Column:
            phased = g.getField("phased") if "phased" in element.fieldNames() else F.lit(False)
            calls = F.transform(
                g.getField("calls"), lambda c: F.when(c >= 0, c.cast("string")).otherwise(missing)
            )
            gt = F.when(phased, F.array_join(calls, "|")).otherwise(F.array_join(calls, "/"))
            # Without calls the text is empty; to compare the text itself would make it twice.
            values = [F.when(F.size(g.getField("calls")) > 0, gt), *[_text(g.getField(f.name), f.dataType) for _, f in keys]]
            return F.concat_ws(":", *[F.coalesce(v, missing) for v in values])

        named = sample_ids is not None and "sampleId" in element.fieldNames()
        genotypes = _in_order(F.col("genotypes"), sample_ids) if named else F.col("genotypes")
        columns.append(F.array_join(F.transform(genotypes, sample), "\t"))
    return with_computed(df, "value", F.concat_ws("\t", *columns)).select("value")


def sample_ids_of(df: DataFrame) -> list[str]:
    """All sample names of a table, by their first place in a row's list.

    The distinct lists are found first, which usually are one.
    """
    element = df.schema["genotypes"].dataType.elementType
    if "sampleId" in element.fieldNames():
        lists = df.select(F.col("genotypes.sampleId").alias("ids")).distinct()
        places = lists.select(F.posexplode("ids").alias("place", "id")).groupBy("id").agg(F.min("place").alias("place"))
        return [row.id for row in places.orderBy("place", "id").collect()]
    most = df.agg(F.max(F.size("genotypes"))).first()[0] or 0
    return [f"sample_{i + 1}" for i in range(most)]


def write_vcf(df: DataFrame, path: str, sample_ids: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Write a folder of VCF files, each with the header; ``read_vcf`` reads the folder or any of its files."""
    if sample_ids is None:
        sample_ids = sample_ids_of(df) if "genotypes" in df.columns else ()
    header = infer_vcf_header(df.schema, sample_ids)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(header, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    format_vcf_lines(df, sample_ids).mapInArrow(with_header, "value string").write.mode(mode).text(path)
