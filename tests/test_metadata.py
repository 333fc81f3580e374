"""Fields of front matter: order of trust, what is no title and no author line, odd rows."""

from __future__ import annotations

from lectern.operators import metadata

SCHEMA = "doc_id long, text string, filename string, head string, year string"


def fields(spark, *rows):
    table = spark.createDataFrame([(k, *r, "h", "y") for k, r in enumerate(rows)], SCHEMA)
    return {r.doc: (r.title, r.authors, r.year, r.doi, r.confidence) for r in metadata.extract(table).collect()}


def test_years_by_trust(spark):
    texts = [
        ("Accepted: 14 December 2020\nPublished online: 10 June 2021", None, 2021),
        ("Published in final edited form as:\nCurr Opin. 2012 February", None, 2012),
        ("arXiv 9912.01234 and (1980)", None, 1999),
        ("IEEE, JULY 2004\nreceived May 2003", None, 2004),
        ("2009 September, submitted 2008", None, 2009),
        ("submitted in 2008, vol (1999)", None, 2008),
        ("x (1999) and 1950\n## Abstract\n(2011)", None, 1999),
        ("nothing\n## Introduction\n1987 (1999)", None, None),
        ("in 2012 loose", "dpr_karpukhin_2020.pdf", 2020),
        ("received 2012", "dpr_karpukhin_2020.pdf", 2012),
        ("published 2012", "1904.01169v3.pdf", 2019),
        ("", "41304_2021_2022.pdf", 2022),
        (None, "PIIS0002929724003008.pdf", None),
    ]
    got = fields(spark, *((t, f) for t, f, _ in texts))
    assert [got[k][2] for k in range(len(texts))] == [y for *_, y in texts]


def test_titles_and_authors(spark):
    got = fields(
        spark,
        ("# Abstract\n# Short\n## J. Physiol. (1952) 117, 500-544\n### A title that is long enough to \\mark_ [1] it\n\nby A. B. Carr & D. Edge\n", None),
        ("**A bold line as title**\n# **Lena Ros** and **Ola Var**", None),
        ("plain line\n" + "filler, and\n" * 3 + "# Under exclusive licence to nobody", None),
        ("# The one true title here\nDepartment of All, Here\nWe, and others\n" + "x\n" * 13 + "Ann Too, Late", None),
        ("# The one true title here\n1 of 9\n-----\nAnn Not, Late\n", None),
    )
    assert got[0][:2] == ("A title that is long enough to mark it", "A. B. Carr & D. Edge")
    assert got[1][:2] == ("A bold line as title", "Lena Ros and Ola Var")
    assert got[2][:2] == (None, None)
    assert got[3][:2] == ("The one true title here", None) and got[4][1] == "Ann Not, Late"


def test_identifiers_confidence_and_odd_rows(spark):
    got = fields(spark, ("see https://doi.org/10.1000/abc.1). and 10.3000/x", None), ("10.3000/X;", None), (None, None), ("", None), ("# " + "t" * 9 + "\n" + "y" * 100_000 + "10.1/x", None))
    assert [got[k][3] for k in range(5)] == ["10.1000/abc.1", "10.3000/X", None, None, None]
    assert got[0][4] == 0.25 and got[2] == (None, None, None, None, 0.0) and got[4][0] is None
    assert metadata.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_statements_end_at_headings_and_years_are_whole_numbers(spark):
    got = fields(spark, ("# Copyright the owners of this\n# What comes after number 2005\n© 1998 All", None), ("Copyright 320051, 1998", None), ("Received by\nthe journal 2003", None), ("accepted 120041 of 2011", None))
    assert [got[k][2] for k in range(4)] == [1998, 1998, 2003, 2011]


def test_titles_may_end_in_long_numbers(spark):
    got = fields(spark, ("# What comes after number 31525", None), ("# Journal of That (1952) 117, 500", None), ("# Journal of That 1952: 117", None))
    assert [got[k][0] for k in range(3)] == ["What comes after number 31525", None, None]
