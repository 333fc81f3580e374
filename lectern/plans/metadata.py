"""Query: title, authors, year and identifier of fronts that are derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import metadata
from lectern.plans.registry import query, table

# A front for each document, in SQL that Spark and the oracle read alike; the oracle says what it was made of.
NL = "chr(10)"
FRONT = f"""CASE doc_id % 8
WHEN 0 THEN '<!-- page:1 -->' || {NL} || '# - The first **title** of number ' || doc_id || {NL} || {NL} || 'A. Bell, C. Dorn[1] and E. Frey' || {NL} || 'Accepted: 14 December ' || (1949 + doc_id % 70) || {NL} || 'Published online: 10 June ' || (1950 + doc_id % 70) || {NL} || 'https://doi.org/10.1234/x.' || doc_id || ').' || {NL} || '## Abstract' || {NL} || 'Long after (1901).'
WHEN 1 THEN '## OPEN ACCESS' || {NL} || 'VOL. 51, NO. 7, JULY ' || (1990 + doc_id % 30) || {NL} || '**Bold lines may be titles ' || doc_id || '**' || {NL} || 'University of Here, There' || {NL} || '## **Jo Ren** and **Lek Lim**' || {NL} || 'Received 1 May 1980' || {NL} || '**Introduction**' || {NL} || 'In 1905 it began.'
WHEN 2 THEN 'CITATION' || {NL} || 'Pedr A and Falq B (2012) A title that is ' || doc_id || ' read back? _Front. Things_ 18:1. doi: 10.3389/fnana.2024.' || doc_id % 900
WHEN 3 THEN '## 1. Introduction to it all' || {NL} || '### Journal of That (1952) 117, 500' || {NL} || '### By the way of ' || doc_id || {NL} || 'By Anna Smith' || {NL} || 'text of 1999'
WHEN 4 THEN '# A title with a loose year below ' || doc_id || {NL} || 'However, nobody, and none' || {NL} || 'contact@here.org, Me' || {NL} || 'in 2012'
WHEN 5 THEN '# Copyright the owners of this' || {NL} || '# What comes after number ' || doc_id || {NL} || '0018/04$20.00 © 1998 All' || {NL} || 'K. Lund'
WHEN 6 THEN coalesce(source, '') || {NL} || 'no front (1977) at all'
ELSE NULL END"""
FILENAME = "CASE doc_id % 8 WHEN 3 THEN '1707.01836v1.pdf' WHEN 4 THEN 'dpr_name_2020-' || (2001 + doc_id % 19) || '.pdf' WHEN 5 THEN 'x_2001.md' WHEN 7 THEN 'scan ' || (1960 + doc_id % 60) || '.txt' END"


@query("""SELECT doc_id AS doc,
  CASE doc_id % 8 WHEN 0 THEN 'The first title of number ' || doc_id WHEN 1 THEN 'Bold lines may be titles ' || doc_id WHEN 2 THEN 'A title that is ' || doc_id || ' read back?' WHEN 3 THEN 'By the way of ' || doc_id WHEN 4 THEN 'A title with a loose year below ' || doc_id WHEN 5 THEN 'What comes after number ' || doc_id END AS title,
  CASE doc_id % 8 WHEN 0 THEN 'A. Bell, C. Dorn and E. Frey' WHEN 1 THEN 'Jo Ren and Lek Lim' WHEN 3 THEN 'Anna Smith' WHEN 5 THEN 'K. Lund' END AS authors,
  CAST(CASE doc_id % 8 WHEN 0 THEN 1950 + doc_id % 70 WHEN 1 THEN 1990 + doc_id % 30 WHEN 2 THEN 2024 WHEN 3 THEN 2017 WHEN 4 THEN greatest(2020, 2001 + doc_id % 19) WHEN 5 THEN 1998 WHEN 6 THEN 1977 ELSE 1960 + doc_id % 60 END AS INT) AS year,
  CASE doc_id % 8 WHEN 0 THEN '10.1234/x.' || doc_id WHEN 2 THEN '10.3389/fnana.2024.' || doc_id % 900 END AS doi,
  CAST(CASE doc_id % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 3 THEN 0.75 WHEN 4 THEN 0.5 WHEN 5 THEN 0.75 ELSE 0.15 END AS DOUBLE) AS confidence FROM documents""")
def front_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(FRONT).alias("text"), F.expr(FILENAME).alias("filename"))
    return metadata.extract(docs)
