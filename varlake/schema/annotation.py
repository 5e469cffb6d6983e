"""The nested annotation record: an extensible schema and its JSON parser."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.schema._build import struct_of

# Fields of an annotation record of format version 99.
_INTERGENIC = """
    allele_num integer, consequence_terms strings, impact string, minimised integer, variant_allele string
"""
_MOTIF = """
    allele_num integer, consequence_terms strings, high_inf_pos string, impact string, minimised integer,
    motif_feature_id string, motif_name string, motif_pos long, motif_score_change float, strand integer,
    variant_allele string
"""
_REGULATORY = """
    allele_num integer, biotype string, consequence_terms strings, impact string, minimised integer,
    regulatory_feature_id string, variant_allele string
"""
_TRANSCRIPT = """
    allele_num integer, amino_acids string, appris string, biotype string, canonical integer, ccds string,
    cdna_start long, cdna_end long, cds_end long, cds_start long, codons string, consequence_terms strings,
    distance long, domains nested, exon string, gene_id string, gene_pheno integer, gene_symbol string,
    gene_symbol_source string, hgnc_id string, hgvsc string, hgvsp string, hgvs_offset integer, impact string,
    intron string, lof string, lof_flags string, lof_filter string, lof_info string, minimised integer,
    protein_end long, protein_start long, protein_id string, refseq_transcript_ids strings, source string,
    strand integer, swissprot string, transcript_id string, trembl string, tsl integer, uniparc string,
    used_ref string, variant_allele string
"""
_RECORD = """
    seq_region_name string, start long, end long, id string, strand integer, assembly_name string,
    allele_string string, ancestral string, variant_class string, context string, input string,
    intergenic_consequences nested, most_severe_consequence string, motif_feature_consequences nested,
    regulatory_feature_consequences nested, transcript_consequences nested
"""
_NOT_NULL = ("seq_region_name", "start")


def _record_99() -> T.StructType:
    record = struct_of(
        _RECORD,
        intergenic_consequences=T.ArrayType(struct_of(_INTERGENIC)),
        motif_feature_consequences=T.ArrayType(struct_of(_MOTIF)),
        regulatory_feature_consequences=T.ArrayType(struct_of(_REGULATORY)),
        transcript_consequences=T.ArrayType(
            struct_of(_TRANSCRIPT, domains=T.ArrayType(struct_of("db string, name string")))
        ),
    )
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in _NOT_NULL) for f in record.fields])


_RECORDS = {"version_99": _record_99}

# Allele-frequency fields of predefined annotation sets, all of type float.
_CUSTOM_FIELDS = {
    "GnomADg_v3": """
        AF AF_asj_female AF_eas_female AF_afr_male AF_female AF_fin_male AF_oth_female AF_ami AF_oth AF_male
        AF_ami_female AF_afr AF_eas_male AF_sas AF_nfe_female AF_asj_male AF_raw AF_oth_male AF_nfe_male AF_asj
        AF_amr_male AF_amr_female AF_sas_female AF_fin AF_afr_female AF_sas_male AF_amr AF_nfe AF_eas AF_ami_male
        AF_fin_female
    """
}

# Fields of a co-located known variant.
_COLOCATED = "seq_region_name string, strand integer, start long, end long, id string, allele_string string"


def preset(uri: str) -> dict:
    """Packaged schemas: record schemas by version, or field types of predefined annotation sets."""
    if uri == "vep/basic_schema":
        return {version: record().jsonValue() for version, record in _RECORDS.items()}
    if uri == "vep/predefined_custom_annot":
        return {name: dict.fromkeys(fields.split(), "float") for name, fields in _CUSTOM_FIELDS.items()}
    raise ValueError(f"no preset is called {uri!r}")


def _put(struct: T.StructType, field: T.StructField) -> T.StructType:
    """Append a field, or replace the one of that name in its place."""
    if field.name in struct.fieldNames():
        return T.StructType([field if f.name == field.name else f for f in struct.fields])
    return T.StructType([*struct.fields, field])


def _update(dtype: T.DataType, path: Sequence[str], fields: Sequence[T.StructField]) -> T.DataType:
    """Put fields into the struct at a path; arrays are entered, missing structs are made."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_update(dtype.elementType, path, fields), dtype.containsNull)
    if not isinstance(dtype, T.StructType):
        raise ValueError(f"cannot add fields to a {dtype.simpleString()}")
    if not path:
        for field in fields:
            dtype = _put(dtype, field)
        return dtype
    name, rest = path[0], path[1:]
    old = dtype[name] if name in dtype.fieldNames() else T.StructField(name, T.StructType())
    return _put(dtype, T.StructField(name, _update(old.dataType, rest, fields), old.nullable, old.metadata))


@dataclass(frozen=True)
class AnnotationSchema:
    """Schema of an annotation record. Every ``with_…`` returns a new schema; applying one twice changes nothing."""

    version: str = "version_99"
    struct: T.StructType | None = None

    def __post_init__(self) -> None:
        if self.struct is None:
            if self.version not in _RECORDS:
                raise ValueError(f"no annotation schema for {self.version!r}")
            object.__setattr__(self, "struct", _RECORDS[self.version]())

    def _with(self, path: Sequence[str], fields: str) -> AnnotationSchema:
        return AnnotationSchema(self.version, _update(self.struct, path, struct_of(fields).fields))

    def field(self, path: str | Sequence[str] = (), create_if_missing: T.StructField | None = None) -> T.DataType:
        """The type at a path of field names; arrays on the way, and at its end, are entered.

        An absent field is an error unless ``create_if_missing`` gives what would stand there; use ``with_field`` to
        have it in the schema.
        """
        names = [path] if isinstance(path, str) else list(path)
        dtype: T.DataType = self.struct
        for name in names:
            if not isinstance(dtype, T.StructType) or name not in dtype.fieldNames():
                if create_if_missing is None:
                    raise ValueError(f"the schema has no field {'.'.join(names)!r}")
                dtype = create_if_missing.dataType
            else:
                dtype = dtype[name].dataType
            while isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
                dtype = dtype.elementType
        return dtype

    def with_field(self, path: str | Sequence[str], field: T.StructField) -> AnnotationSchema:
        """Add a field inside the struct at a path."""
        names = [path] if isinstance(path, str) else list(path)
        return AnnotationSchema(self.version, _update(self.struct, names, [field]))

    def with_sift(self) -> AnnotationSchema:
        return self._with(["transcript_consequences"], "sift_prediction string, sift_score float")

    def with_polyphen(self) -> AnnotationSchema:
        return self._with(["transcript_consequences"], "polyphen_prediction string, polyphen_score float")

    def with_cadd(self) -> AnnotationSchema:
        return self._with(["transcript_consequences"], "cadd_phred float, cadd_raw float")

    def with_colocated(self) -> AnnotationSchema:
        return self.with_field((), T.StructField("colocated_variants", T.ArrayType(struct_of(_COLOCATED))))

    def with_custom(self, short_name: str, fields: Sequence[tuple[str, T.DataType | str]]) -> AnnotationSchema:
        """Add ``custom_annotations.<short_name>``, a list of named features with the given fields."""
        typed = T.StructType()
        for name, dtype in fields:
            typed = typed.add(name, dtype)
        entry = T.StructType().add("name", "string").add("allele", "string").add("fields", typed)
        return self.with_field("custom_annotations", T.StructField(short_name, T.ArrayType(entry)))

    def with_predefined(self, dataset: str = "GnomADg_v3") -> AnnotationSchema:
        """Add a predefined annotation set under its own name."""
        known = preset("vep/predefined_custom_annot")
        if dataset not in known:
            raise ValueError(f"no predefined annotation set is called {dataset!r}")
        return self.with_custom(dataset, list(known[dataset].items()))


def parse_annotations(
    text_df: DataFrame,
    schema: AnnotationSchema | T.StructType,
    text: str = "text",
    corrupt_record: str | None = None,
) -> DataFrame:
    """One JSON record per row → record columns, without ``input``.

    Unreadable or null text keeps its row, with all columns null; ``corrupt_record`` names a column that then holds
    the text. Row-local.
    """
    struct = schema.struct if isinstance(schema, AnnotationSchema) else schema
    options = {"mode": "PERMISSIVE"}
    if corrupt_record:
        struct = T.StructType([*struct.fields, T.StructField(corrupt_record, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt_record
    parsed = text_df.select(F.from_json(text, struct, options).alias("data"))
    return parsed.select("data.*").drop("input")


def infer_schema(spark: SparkSession, record: str | dict) -> T.StructType:
    """The schema of one sample record."""
    sample = record if isinstance(record, str) else json.dumps(record)
    ddl = spark.range(1).select(F.schema_of_json(F.lit(sample))).first()[0]
    return T.StructType.fromDDL(ddl)


def infer_schema_of_all(df: DataFrame, text: str = "text") -> tuple[T.StructType, list[str]]:
    """The schema of all records of a JSON column, and the paths at which records disagree; one pass, merged map-side.

    Whole numbers are longs, others doubles. Where records disagree, and where all are null, the type is string. Text that is
    no JSON object is passed over; without any record the schema is empty.
    """
    record = F.try_parse_json(text)
    objects = F.when(F.schema_of_variant(record).startswith("OBJECT"), record)
    merged = df.agg(F.schema_of_variant_agg(objects)).first()[0]
    if merged is None or not merged.startswith("OBJECT<") or merged == "OBJECT<>":
        return T.StructType(), []
    ddl = re.sub(r"DECIMAL[(][0-9]+,[0-9]+[)]", "DOUBLE", merged.replace("OBJECT<", "STRUCT<"))
    conflicts: list[str] = []

    def settled(dtype: T.DataType, path: str) -> T.DataType:
        if isinstance(dtype, T.StructType):
            return T.StructType([T.StructField(f.name, settled(f.dataType, f"{path}.{f.name}".lstrip("."))) for f in dtype.fields])
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(settled(dtype.elementType, f"{path}[]"))
        if isinstance(dtype, T.VariantType):
            conflicts.append(path)
        return T.StringType() if isinstance(dtype, (T.VariantType, T.NullType)) else dtype

    return settled(T.DataType.fromDDL(ddl), ""), conflicts
