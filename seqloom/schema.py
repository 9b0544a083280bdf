"""Schemas. A record has qual null in FASTA; ordinal is its place in the input, from 0."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("descr", T.StringType(), False),
    T.StructField("seq", T.StringType(), False),
    T.StructField("qual", T.StringType()),
])
LOCATION = "seq_id string, pattern_name string, pattern string, strand string, start long, end long, matched string"
FEATURE = "chr string, s long, e long, feat string, strand string, type string, attributes map<string,string>"
INDEX = "name string, length long, offset long, line_bases long, line_width long, qual_offset long"
