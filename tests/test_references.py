"""Fields of references, names, and titles that are alike, against plain versions."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lectern.functions import references as R
from lectern.operators import fuzzy, references


def test_entries_of_each_layout(spark):
    block = "\n".join(
        [
            "- Bell, A. and Dorn, C. (1999) The first title here. _Journal of Things_ 3, 1-9. doi 10.1000/xyz.1).",
            "- Frey E. A second title without end. *Venue*, pp. 1-20, in the long year of 2004.",
            "- Some text that has neither year nor number but is long enough to be kept? It is not (see the bound).",
            "- No year here. But an identifier 10.1234/ab.9 stands at its end.",
            "- Short one 1999",
            "- Hall, G. Short. X, 12-30, and a rest that is rather long before 2010",
        ]
    )
    docs = spark.createDataFrame([(1, f"text\n## References\n{block}\n## Appendix\n- not this one, 1999, at all"), (2, None), (3, ""), (4, "no list (1999)")], "doc_id long, text string")
    got = {r.place: (r.authors, r.title, r.year, r.doi, r.confidence) for r in references.extract(docs).collect()}
    assert got[0] == ("Bell, A. and Dorn, C", "The first title here", 1999, "10.1000/xyz.1", 1.0)
    assert got[1] == ("Frey E", "A second title without end", 2004, None, 0.8)
    assert got[2][:3] == ("Some text that has neither year nor number but is long enough to be kept?", None, None)
    assert got[3] == ("No year here", None, None, "10.1234/ab.9", 0.45)
    assert 4 not in got and got[5] == ("Hall, G", "Short. X, 12-30, and a rest that is rather long before", 2010, None, 0.8)


def test_lists_are_cut_at_the_marks_they_have(spark):
    cases = {
        "\n- one\n- two\n  more\n- three\n": ["- one", "- two\n  more", "- three"],
        "lead\n[1] one\n[2] two\n[3] three": ["[1] one", "[2] two", "[3] three"],
        "\n1. Aa 2. Bb 3. Cc": ["1. Aa", "2. Bb", "3. Cc"],
        "Head 1. Aa 2. Bb": ["Head", "1. Aa", "2. Bb"],
        "\n1. Aa 2. Bb": ["1. Aa 2. Bb"],
        "p one\n\n  \n\np two\n\n": ["p one", "p two"],
        "": [],
    }
    rows = spark.createDataFrame(list(cases.items()), "block string, want array<string>")
    assert all(list(r.got) == list(r.want) for r in rows.select("want", R.split_references(F.col("block")).alias("got")).collect())


def test_surnames(spark):
    cases = {"Li, Q.": "li", "de Vries, J., Bo, K.": "vries", "Anna Maria Sotomayor & B. Roe": "sotomayor", "Doe J": "doe", "LE, Q. V.": "le", "A. B. C.": None, "": None, "van der Berg": "berg", "Ng A, Jordan M": None, "Smith, John Edward, Roe, P.": "smith"}
    rows = spark.createDataFrame(list(cases.items()), "authors string, want string")
    assert {r.authors: r.got for r in rows.select("authors", R.first_surname(F.col("authors")).alias("got")).collect()} == cases


def titles(rng, n):
    words = ["on", "the", "theory", "of", "graphs", "and", "sets", "deep", "networks", "a", "study", "in", "learning", "models", "zebra", "quartz"]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(n)]
    for t in list(out):
        chars = list(t)
        for _ in range(rng.randrange(0, 1 + len(chars) // 6)):
            chars[rng.randrange(len(chars))] = rng.choice("abcz ")
        out.append("".join(chars))
    return out + ["x", "xy", "aaaaaaaaaaaa", "aaaaaaaaaaaaaa", "long " * 50, "long " * 49 + "lung"]


def test_alike_equals_all_pairs(spark):
    rng = random.Random(3)
    a, b = titles(rng, 60), titles(rng, 60)
    got = {(r.a, r.b): r.ratio for r in fuzzy.alike(*(spark.createDataFrame([(t,) for t in [*x, None, ""]], "title string") for x in (a, b))).collect()}
    want = {(x, y): r for x in set(a) for y in set(b) if (r := SequenceMatcher(None, x, y).ratio()) >= fuzzy.RATIO}
    assert got == want and len(want) > 20


def test_resolution_with_alike_titles_and_hot_keys(spark):
    library = [(7, None, None, None, "The theory of deep networks"), (5, None, None, None, "The theory of deep networks"), (9, "10.1/A", "Bell, A.", 1999, "Another work"), (8, None, "Bell, A.", 1999, None)]
    refs = [(1, k, None, None, None, "The theories of deep network") for k in range(300)] + [(2, 0, " 10.1/a ", None, None, None), (2, 1, None, "Bell, A., Roe", 1999, None), (2, 2, None, None, None, None), (2, 3, None, "Bell, A.", None, "Too far from all of them"), (2, 4, None, None, None, "the theory of deep networks!")]
    lib = spark.createDataFrame(library, "doc_id long, doi string, authors string, year int, title string")
    table = spark.createDataFrame(refs, "doc long, place int, doi string, authors string, year int, title string")
    got = {(r.doc, r.place): (r.target, r.how) for r in references.resolve(table, lib, fuzzy.RATIO).collect()}
    assert got == {**{(1, k): (5, "title") for k in range(300)}, (2, 0): (9, "doi"), (2, 1): (8, "author_year"), (2, 2): (None, None), (2, 3): (None, None), (2, 4): (5, "title")}
    exact = {(r.doc, r.place): r.target for r in references.resolve(table, lib).collect()}
    assert exact[2, 4] == 5 and exact[1, 0] is None
