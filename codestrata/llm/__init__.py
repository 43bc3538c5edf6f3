"""Operators for preparing large text corpora: token counts, de-duplication,
secret scans, archives, packing, token files, scoring, decontamination and
quality rules. Nothing outside this subpackage imports it."""
