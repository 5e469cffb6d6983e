"""Readers, writers and the external pipe."""

from varlake.sources.bgzip import read_vcf_blocks, scan_blocks, write_vcf_blocks
from varlake.sources.fasta import index_fasta, read_indexed_bases, read_reference_bases
from varlake.sources.gtf import parse_gtf_lines, read_gtf
from varlake.sources.pipe import annotate, pipe_lines, pipe_report, pipe_resumable
from varlake.sources.tables import read_table, select_site_columns, write_and_check, write_site_table, write_table
from varlake.sources.vcf import VcfHeader, format_vcf_lines, parse_vcf_lines, read_vcf, write_vcf

__all__ = [
    "VcfHeader",
    "annotate",
    "format_vcf_lines",
    "index_fasta",
    "parse_gtf_lines",
    "parse_vcf_lines",
    "pipe_lines",
    "pipe_report",
    "pipe_resumable",
    "read_gtf",
    "read_indexed_bases",
    "read_reference_bases",
    "read_table",
    "read_vcf",
    "read_vcf_blocks",
    "scan_blocks",
    "select_site_columns",
    "write_and_check",
    "write_site_table",
    "write_table",
    "write_vcf",
    "write_vcf_blocks",
]
