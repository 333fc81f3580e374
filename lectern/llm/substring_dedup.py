"""Suffix-array dedup: bytes of strings that occur twice anywhere in the corpus are removed.

Two lengths are looked at together: strings of ``length`` bytes are removed, and strings of ``passage``
bytes, fewer, tell whether a text holds a passage that it shares. All strings of ``passage`` bytes that
can be equal share an anchor (see ``anchors``), so only strings with equal anchors must be sorted
against each other:

1. Fingerprints of anchors are counted; those of a single anchor need no more work.
2. For each other anchor its context is cut out: the bytes of all strings assigned to it, and on to
   ``length`` bytes as far as the text goes. Equal contexts are one class with a number of members.
3. Contexts are dealt to blocks by fingerprint. A block is a text of at most BLOCK_BYTES; its
   suffixes are sorted in two stages, and neighbours with a common prefix of either length are repeats.
4. Repeats go back to the members of the classes, and a document's spans are merged.

A fingerprint with more context than a block holds (one passage with very many different
surroundings) is dealt anew by the digests of the strings themselves, so no task gets all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.anchors import anchors_of_long
from lectern.llm.common import blobs, join_sized, materialize, prepare, tidy, tidy_group
from lectern.llm.two_stage import common_prefixes, sort_suffixes

LENGTH, PASSAGE = 400, 300
#: A run of repeated bytes with more words than this is a passage.
PASSAGE_WORDS = 50
#: Context bytes of a block of suffixes at most; a fingerprint with more is dealt by string.
BLOCK_BYTES = 1 << 20
#: The bitmap of repeated fingerprints has 16 bits for each, and this many at most (32 MB).
BITMAP_BITS = 1 << 28
#: Documents with spans that are broadcast to the texts; more are joined by shuffle.
BROADCAST_DOCS = 200_000
#: Classes that a task remembers, so as to send the bytes of each once.
REMEMBERED = 200_000

#: ``strings`` of an anchor have ``passage`` bytes; the first ``full`` of them have ``length`` bytes too.
CONTEXT = "k0 long, k1 long, start int, strings int, full int, print long, c0 long, c1 long, context binary"
RUNS = "c0 long, c1 long, runs binary, full_runs binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k0, k1: identifier and hash of the text. Rows equal in both have equal spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    identifier = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return docs.select(identifier.alias("k0"), F.xxhash64(text).alias("k1"), text.alias("text"))


def fingerprints(keys: DataFrame, passage: int) -> DataFrame:
    """print, n: the fingerprints of anchors that occur more than once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [anchors_of_long(np.frombuffer(t, np.uint8), passage)[0] for t in blobs(batch.column(0)) if len(t) >= passage]
            prints, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(n)], names=["print", "n"])

    counted = keys.select("text").mapInArrow(tidy(run), "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    return counted.filter("n > 1")


def bitmap(prints: DataFrame) -> np.ndarray:
    """Bits set for the fingerprints, of a size bounded by BITMAP_BITS; a false hit only costs work."""
    n = 1 << 12
    while n < min(BITMAP_BITS, 16 * prints.count()):
        n <<= 1
    bit = F.pmod(F.col("print"), F.lit(n))
    words = prints.select((bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(print, {n}L) % 64 AS INT))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out


def contexts(keys: DataFrame, marked: np.ndarray, length: int, passage: int) -> DataFrame:
    """The context of each anchor whose fingerprint is marked; a task sends the bytes of a class once."""
    shared = keys.sparkSession.sparkContext.broadcast(marked)
    schema = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("start", pa.int32()), ("strings", pa.int32()), ("full", pa.int32()), ("print", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("context", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bits = shared.value
        for batch in it:
            out: list[tuple] = []
            for k0, k1, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
                if len(raw) < passage:
                    continue
                prints, _, first, last = anchors_of_long(np.frombuffer(raw, np.uint8), passage)
                bit = prints % (len(bits) * 64)
                hit = np.flatnonzero((bits[bit >> 6] >> (bit & 63)) & 1)
                for p, a, b in zip(prints[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                    context = raw[a : b + length]
                    digest = hashlib.blake2b(context, digest_size=16).digest()
                    fresh = digest not in seen
                    if fresh:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                    full = max(0, min(b - a + 1, len(raw) - length + 1 - a))
                    out.append((k0, k1, a, b - a + 1, full, p, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), context if fresh else None))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return keys.mapInArrow(tidy(run), CONTEXT)


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Pairs (first, last) of the runs of true values, flat."""
    padded = np.concatenate([[False], flags, [False]])
    first, after = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    return np.stack([first, after - 1], axis=1).reshape(-1).astype(np.int32)


def runs_by_text(flags: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """``runs_of`` for each of the texts that begin at ``begins``, counted from there; no run reaches into the next text."""
    runs = runs_of(flags).reshape(-1, 2)
    cuts = np.searchsorted(runs[:, 0], begins)
    runs = runs - np.repeat(begins, np.diff(np.append(cuts, len(runs))))[:, None].astype(np.int32)
    return [r.reshape(-1) for r in np.split(runs, cuts[1:])]


def repeated_strings(texts: list[bytes], strings: list[int], full: list[int], length: int, passage: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, runs of the strings (by start) of ``passage`` and of ``length`` bytes that occur at another place of these texts."""
    raw = b"".join(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + np.array(strings), -1)
    order = sort_suffixes(raw, np.cumsum(edge)[:-1] > 0, length)
    common = common_prefixes(raw, order, length)
    short, long = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    short[order[1:][common >= passage]] = True
    short[order[:-1][common >= passage]] = True
    # of the strings that agree in ``length`` bytes, only those with as many in their own text count
    whole = np.zeros(len(raw), bool)
    for b, n in zip(begins.tolist(), full, strict=True):
        whole[b : b + n] = True
    group = np.concatenate([[0], np.cumsum(common < length)])[: len(order)]
    there = whole[order]
    long[order] = there & (np.bincount(group[there], minlength=int(group[-1]) + 1 if len(group) else 1)[group] > 1)
    # the last bytes of a text begin no string, so runs of neighbours stay apart
    return list(zip(runs_by_text(short, begins), runs_by_text(long, begins), strict=True))


def sorter(length: int, passage: int) -> Callable[[pa.Table], pa.Table]:
    """Sorts the suffixes of one block and gives the repeats of each class of contexts."""

    def run(table: pa.Table) -> pa.Table:
        classes: dict[tuple[int, int], tuple[int, bytes, int, int]] = {}
        columns = (table.column(c).to_pylist() for c in ("c0", "c1", "print", "context", "strings", "full"))
        for c0, c1, *rest in zip(*columns, strict=True):
            classes.setdefault((c0, c1), tuple(rest))
        ordered = sorted(classes.items(), key=lambda x: x[1][0])
        keys, found = [], []
        part: list = []
        size = 0
        for k, item in enumerate(ordered):  # fingerprints stay together, parts stay near BLOCK_BYTES
            part.append(item)
            size += len(item[1][1])
            ends = k + 1 == len(ordered) or ordered[k + 1][1][0] != item[1][0]
            if ends and (size >= BLOCK_BYTES or k + 1 == len(ordered)):
                got = repeated_strings(*([x[1][k] for x in part] for k in (1, 2, 3)), length, passage)
                for (key, _), (runs, full_runs) in zip(part, got, strict=True):
                    if len(runs):
                        keys.append(key)
                        found.append((runs.tobytes(), full_runs.tobytes()))
                part, size = [], 0
        return pa.table([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], names=["c0", "c1", "runs", "full_runs"])

    return run


def repeats_by_string(hot: DataFrame, length: int, passage: int) -> DataFrame:
    """The same for fingerprints too large for a block: the digests of their strings are counted.

    A task sends each digest, with the class and place that it saw first, once for each class.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for c0, c1, n, full, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for size, many in ((passage, n), (length, full)):
                    for at in range(many):
                        digest = hashlib.blake2b(raw[at : at + size], digest_size=16).digest()
                        rows.append((c0, c1, 2 * at + (size == length), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["c0", "c1", "at", "d0", "d1"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["c0", "c1", "at", "d0", "d1"])

    strings = materialize(hot.dropDuplicates(["c0", "c1"]).select("c0", "c1", "strings", "full", "context").mapInArrow(tidy(run), "c0 long, c1 long, at long, d0 long, d1 long"), "strings")
    repeated = materialize(strings.groupBy("d0", "d1").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    places = join_sized(strings, repeated, ["d0", "d1"], "n").groupBy("c0", "c1").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for at in batch.column(2).to_pylist():
                flags = np.zeros(at[-1] + 2, bool)
                flags[at] = True
                out.append((runs_of(flags[0::2]).tobytes(), runs_of(flags[1::2]).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], names=["c0", "c1", "runs", "full_runs"])

    return places.mapInArrow(gather, RUNS)


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flat pairs of the maximal runs that the spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return np.stack([starts[fresh], np.append(reach[fresh[1:] - 1], reach[-1])], axis=1).reshape(-1).astype(np.int64)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """k0, k1, spans, removed: for each document with repeats, flat pairs (start, end) of bytes, merged, that
    repeated strings of ``passage`` and of ``length`` bytes cover."""
    prepare(docs.sparkSession)
    keys = keyed(docs, id_col, text_col)
    prints = materialize(fingerprints(keys, passage), "fingerprints")
    found = materialize(contexts(keys, bitmap(prints), length, passage), "contexts")
    sent = found.filter(F.col("context").isNotNull())
    sizes = sent.groupBy("print").agg(F.sum(F.octet_length("context")).alias("bytes"))
    hot = materialize(sizes.filter(F.col("bytes") > 2 * BLOCK_BYTES).select("print"), "hot")
    total = sent.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    blocks = max(1, total // BLOCK_BYTES)
    is_hot = sent.join(hot, "print", "left_semi")
    normal = sent.join(hot, "print", "left_anti").withColumn("block", F.pmod(F.xxhash64("print"), F.lit(blocks)))
    repeats = normal.groupBy("block").applyInArrow(tidy_group(sorter(length, passage)), RUNS)
    if not hot.isEmpty():
        repeats = repeats.unionByName(repeats_by_string(is_hot, length, passage))
    members = found.groupBy("c0", "c1").agg(F.count("*").alias("n"))
    classes = materialize(members.join(repeats, ["c0", "c1"], "left").filter("n > 1 OR runs IS NOT NULL"), "classes")
    placed = join_sized(found.select("k0", "k1", "start", "strings", "full", "c0", "c1"), classes, ["c0", "c1"], "n")
    own = [F.when(F.col("n") > 1, F.lit(None).cast("binary")).otherwise(F.col(c)).alias(c) for c in ("runs", "full_runs")]
    by_doc = placed.select("k0", "k1", F.struct("start", "strings", "full", *own).alias("part")).groupBy("k0", "k1").agg(F.collect_list("part").alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for parts in batch.column(2).to_pylist():
                both = []
                for size, many, which in ((passage, "strings", "runs"), (length, "full", "full_runs")):
                    starts, ends = [], []
                    for p in parts:
                        runs = [0, p[many] - 1] * (p[many] > 0) if p[which] is None else np.frombuffer(p[which], np.int32).tolist()
                        starts += [p["start"] + a for a in runs[0::2]]
                        ends += [p["start"] + b + size for b in runs[1::2]]
                    both.append(merged(np.array(starts), np.array(ends)).tobytes() if starts else b"")
                out.append(both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], names=["k0", "k1", "spans", "removed"])

    return by_doc.mapInArrow(tidy(run), "k0 long, k1 long, spans binary, removed binary")


def passages(raw: bytes, spans: list[int], words: int) -> int:
    """How many of the spans (flat pairs of bytes) have more than ``words`` words beginning in them."""

    def begin(a: int, b: int) -> int:
        within = a > 0 and len(raw[a - 1 : a + 1].split()) == 1 and not raw[a - 1 : a + 1][:1].isspace() and not raw[a : a + 1].isspace()
        return len(raw[a:b].split()) - within

    return sum(begin(a, b) > words for a, b in zip(spans[0::2], spans[1::2], strict=True))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages (and kept, the bytes themselves) for every row.

    ``n_passages`` counts the runs of bytes that strings of ``passage`` bytes cover which also start
    elsewhere, and that have more than ``words`` words; it is a report and removes nothing. A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the
    same or another document; strings are judged on the input and never cross documents. Every
    occurrence is removed, the first too. A null text is an empty one; texts under ``length`` bytes
    and empty tables lose nothing; ``passage`` is at most ``length``. Repeated rows count as occurrences and each get a row. Other
    columns are not read. Texts of any length are read whole, in bounded segments.
    """
    spans = materialize(repeated_spans(docs, id_col, text_col, length, passage), "spans")
    if spans.count() <= BROADCAST_DOCS:
        spans = F.broadcast(spans)
    joined = keyed(docs, id_col, text_col).withColumn("doc_id", F.when(F.col("k0") != -(1 << 63), F.col("k0"))).join(spans, ["k0", "k1"], "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for raw, flat, shared in zip(blobs(batch.column(1)), batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = np.frombuffer(flat or b"", np.int64).tolist()
                bounds = [0, *cut, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(bounds[0::2], bounds[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest(), passages(raw, np.frombuffer(shared or b"", np.int64).tolist(), words), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())[: 5 + with_kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols[: len(kinds)], kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", *["kept"] * with_kept])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_kept
    return joined.select("doc_id", "text", "spans", "removed").mapInArrow(tidy(run), schema)
