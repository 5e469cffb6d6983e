"""Schemas of variant tables and annotation records."""

from varlake.schema.annotation import AnnotationSchema, infer_schema, infer_schema_of_all, parse_annotations, preset
from varlake.schema.variants import GENOTYPE_SCHEMA, VARIANT_SCHEMA

__all__ = ["GENOTYPE_SCHEMA", "VARIANT_SCHEMA", "AnnotationSchema", "infer_schema", "infer_schema_of_all", "parse_annotations", "preset"]
