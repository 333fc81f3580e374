"""Language identification against plain compression, and its odd cases."""

from __future__ import annotations

import zstandard

from lectern.llm import language_id

SCHEMA = "doc_id long, text string, lang string, h long"


def rows():
    prose = {"en": "the house is on the hill and the road goes down to the river ", "de": "das haus steht auf dem berg und die strasse führt hinab zum fluss "}
    out = [(k, (prose[lang] + f"{lang}{k} ") * (1 + k % 4), lang, 7) for lang in prose for k in range(12)]
    return [*out, (None, prose["en"], "en", 1), (3, out[3][1], "en", 1), (50, "", "en", 1), (51, None, "de", 1), (52, prose["de"] * 5000, None, 1)]


def test_equals_plain_compression(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    learned = language_id.train_dictionaries(docs.filter("doc_id IS NULL OR doc_id < 50"), docs_per_language=5)
    assert list(learned) == ["en", "de"] and all(len(v.split(b"\n")) == 5 for v in learned.values())

    def size(raw, lang):
        content = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        make = zstandard.ZstdCompressor(level=6, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(make.compress(raw[k : k + language_id.SEGMENT])) for k in range(0, len(raw), language_id.SEGMENT))

    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9), r.rejected) for r in language_id.identify(docs, learned).collect())
    want = []
    for i, text, *_ in rows():
        if not text:
            want.append((str(i), "und", 0.0, True))
            continue
        sizes = {lang: size(text.lower().encode(), lang) for lang in learned}
        best = min(sizes, key=sizes.get)
        margin = 1 - sizes[best] / max(sizes.values())
        want.append((str(i), best, round(margin, 9), margin < 0.002))
    assert got == sorted(want)


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ① Ⅷ 12", "en", 1), (2, "ß", "de", 1)], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, {"en": b"the house", "de": "straße".encode()}).collect()}
    assert got[1] == "und" and got[2] in ("en", "de")


def test_a_margin_does_not_shrink_with_length(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    learned = language_id.train_dictionaries(docs, docs_per_language=5)
    judge = language_id.Compressors(learned, 6).judge
    import random

    words = "das haus steht auf dem berg und die strasse führt hinab zum fluss".split()
    text = " ".join(random.Random(1).choices(words, k=300_000))
    assert judge(text)[0] == "de" and judge(text)[1] > 0.2 * judge(text[: language_id.SEGMENT])[1]
