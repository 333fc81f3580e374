"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of training texts. A text is compressed
with each dictionary; the language whose frame is smallest wins. Where the runner-up is nearly as
small the margin is narrow and the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import filtered, prepare, tidy

UNKNOWN = "und"
#: Longer texts are compressed in segments of so many bytes, each with a fresh dictionary, so a margin means the same at any length.
SEGMENT = 1 << 16


def train_dictionaries(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 100,
) -> dict[str, bytes]:
    """Language -> dictionary content, from a bounded sample of labelled rows.

    The sample is the ``docs_per_language`` rows of each language that have the smallest hash of
    their identifier, ties by text; their whole texts are the dictionary. Rows without text or
    language teach nothing; repeated rows are rows of their own. Languages come in the order of their
    number of rows, so that a tie goes to the most frequent one.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # hashes are uniform, so four times the wanted share of them holds the smallest ones; where identifiers
    # repeat too much for that, more of the range is taken
    ranked, share = [], 4.0
    while counts:
        limits = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share * docs_per_language / n))))
        place = F.col("h").cast("double") / 2.0**64 + 0.5
        near = rows.filter(place <= F.try_element_at(limits, F.col("lang")))
        ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= docs_per_language).collect()
        if all(sum(r["lang"] == lang for r in ranked) >= min(n, docs_per_language) for lang, n in counts.items()):
            break
        share *= 16
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        texts = [r["text"].lower() for r in sorted(ranked, key=lambda r: r["k"]) if r["lang"] == lang]
        out[lang] = "\n".join(texts).encode(errors="replace")
    return out


class Compressors:
    """One compressor for each language, its dictionary digested once for each worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int) -> None:
        self.langs = list(dictionaries)
        self.plain = []
        for lang in self.langs:
            content = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.plain.append(zstd.ZstdCompressor(dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the margin is the share by which the runner-up's frame is larger."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = text.lower().encode(errors="replace")
        segments = [raw] if len(raw) <= SEGMENT else [raw[at : at + SEGMENT] for at in range(0, len(raw), SEGMENT)]
        sizes = [sum(len(c.compress(s)) for s in segments) for c in self.plain]
        if not sizes:
            return UNKNOWN, 0.0
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        return self.langs[best], 1.0 - sizes[best] / rest


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 6,
    min_margin: float = 0.002,
) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row.

    ``score`` is the margin, 0 to 1. A text that is null or has no letter is ``und`` with score 0
    and is rejected, as is one whose margin is under ``min_margin``. Equal sizes go to the language
    first in ``dictionaries``. Without any dictionary all is ``und``. Whole texts are compressed, long
    ones in segments; a null identifier is carried along;
    other columns are not read; repeated rows each get a row.
    """
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries, level)
        for batch in it:
            got = [compressors.judge(t) for t in batch.column(1).to_pylist()]
            langs, scores = [g[0] for g in got], [g[1] for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < min_margin or x == UNKNOWN for x, s in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = 6, min_margin: float = 0.002) -> DataFrame:
    """The rows of ``docs`` whose language is told with some margin, with all their columns; each row is judged by itself."""
    prepare(docs.sparkSession)

    def keep():  # noqa: ANN202
        judge = Compressors(dictionaries, level).judge
        return lambda texts: [lang != UNKNOWN and score >= min_margin for lang, score in map(judge, texts.cast(pa.string()).to_pylist())]

    return filtered(docs, text_col, keep)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of the identifier modulo 4 is not 2."""
    return docs.filter(~held_out())


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
