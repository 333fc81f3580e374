"""N-gram Jaccard self-join by T-occurrence search, and the groups that its links form.

1. A document is the set of 64-bit hashes of its word n-grams. Equal sets are one class.
2. All grams have a fixed order: rare before frequent. Two sets that link share a gram among the
   first n - ceil(0.75 n) + 1 of each, so only these prefixes are indexed; their inverted lists with
   two classes or more say which sets may link.
3. A block of sets is searched with DivideSkip: the few longest lists of a query are set aside, the
   others are merged, and documents found often enough there are probed for in the long lists.
4. First each class is searched for within one list only, its largest; that joins groups of near
   copies. Then every list that still holds classes of different groups is searched in full, its
   members of different groups against each other. So no link between different groups is lost, while
   members of one group are not compared again.

A list too large for one block is split into chunks; within its group a chunk is searched by itself,
and different groups' chunks are paired where their sizes allow a link. The list of a gram known to
be frequent is gathered in parts, so no task gets it whole.

A list keeps only members that may link through it: if its gram is the first that two sets share,
they share no more than what follows it in either. Small blocks are searched by the dozen in one task.

Sets are long, so a block first meets as bitmaps of two to four bits a gram. A bit that only one of
two sets has stands for a gram that only this one has, which bounds their intersection from above.
Only sets that may still link with another of their block are then sent there in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, ROW_KEY, forget, is_small, join_sized, materialize, only_ids, prepare, release, row_keys, tidy, tidy_group, utf8, without_rows
from lectern.llm.graph import components

#: Two sets link when DEN * |intersection| >= NUM * |union|.
NUM, DEN = 3, 4
N_WORDS = 5
#: Grams of a block of sets, and postings of an index bucket, at about the most.
BLOCK_GRAMS, BUCKET_POSTINGS = 400_000, 300_000
#: A task counts this many grams at a time and reports those that it meets LOCAL_COUNT times or more;
#: the HEAVY_GRAMS most frequent ones stand last in the order. Any order gives the same links.
COUNTED, LOCAL_COUNT, HEAVY_GRAMS = 1_000_000, 6, 1 << 17
#: Sets that a task remembers, so as to index the copies of each once.
REMEMBERED = 50_000
#: Stands for a null identifier where the text of a set is looked up.
NO_ID = -(1 << 63)
#: The members of lists of at most so many sets are held against each other pair by pair, those of longer ones by sorting.
PAIRED = 256
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: DivideSkip: how much cheaper merging an entry is than probing for it.
MU = 0.0085

_A, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_WORD = bytes(c not in b" \t\n\r\v\f" for c in range(256))
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, A-Z lower-cased, one text after the other; the first word of each text, and their number)."""
    raw, at = utf8(texts)
    lowered = raw.tobytes().lower() + bytes(8)
    inside = np.frombuffer(lowered.translate(_WORD), bool)[: len(raw)]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]  # words end where texts do
    opens[at[:-1][full]] = inside[at[:-1][full]]
    closes[at[1:][full] - 1] = inside[at[1:][full] - 1]
    begin = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - begin
    eight = np.ndarray((len(lowered) - 7,), "<u8", lowered, 0, (1,))  # the eight bytes from each place on
    out = mixed((size.astype(np.uint64) * _A) ^ (eight[begin] & _HEAD[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for done in range(8, LONG_WORD, 8):
        live = live[size[live] > done]
        out[live] = mixed(out[live] ^ (eight[begin[live] + done] & _HEAD[np.minimum(size[live] - done, 8)]))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(lowered[begin[k] : begin[k] + size[k]])
    return out, np.searchsorted(begin, at)


def shingled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each place on."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : n + j]) * _A
        out ^= out >> np.uint64(31)
    out *= _M
    return out ^ (out >> np.uint64(29))


def gram_sets(texts: pa.Array, n_words: int = N_WORDS) -> list[np.ndarray]:
    """Of each text the ascending distinct hashes of the n-grams; of all words together where there are fewer."""
    hashes, at = word_hashes(texts)
    grams = shingled(hashes, n_words)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a < n_words:
            out.append(shingled(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
            continue
        own = np.sort(grams[a : b - n_words + 1])
        fresh = own[1:] != own[:-1]
        out.append(own if fresh.all() else own[np.concatenate([[True], fresh])])
    return out


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "big", signed=True)


def prefix_length(n: int) -> int:
    """Grams to index: a linked set shares at least NUM / DEN of them, rounded up."""
    return n - -(-NUM * n // DEN) + 1


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Bits for the grams, as words; the width is a power of two from 2n to 4n bits, 64 at least."""
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(grams & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def signatures(texts: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n, class, bits for each row of doc_id, text; other rows have gram, often: those met often by a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def count() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL_COUNT
            nothing = [pa.nulls(int(often.sum()), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(grams[often].view(np.int64)), pa.array(n[often])], names=names)

        names = ["doc_id", "n", "class", "bits", "gram", "often"]
        for batch in it:
            sets = gram_sets(batch.column(1), n_words)
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())], names=names)
            for grams in sets:
                held.append(grams)
                size += len(grams)
                if size >= COUNTED:
                    yield count()
                    held, size = [], 0
        if held:
            yield count()

    return texts.mapInArrow(tidy(run), "doc_id long, n long, class long, bits binary, gram long, often long")


def heavy_grams(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(grams ascending, counts) of the most frequent grams of rows (gram, often), at most HEAVY_GRAMS of them."""
    got = counted.groupBy("gram").agg(F.sum("often").alias("n")).orderBy(F.desc("n"), "gram").limit(HEAVY_GRAMS).toArrow()
    grams, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix(grams: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first grams of a set in the order of all: by known frequency, then by hash."""
    need = prefix_length(len(grams))
    known, counts = heavy
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        frequency = np.where(known[at] == grams, counts[at], 0)
        rare = grams[frequency == 0]
        if len(rare) >= need:
            return rare[:need]
        often = np.flatnonzero(frequency)
        grams = np.concatenate([rare, grams[often[np.argsort(frequency[often], kind="stable")]]])
    return grams[:need]


def postings(texts: DataFrame, heavy: tuple[np.ndarray, np.ndarray], split: tuple[np.ndarray, np.ndarray], buckets: int, n_words: int) -> DataFrame:
    """bucket, and packed (gram, class, n + place << 32) of the prefixes of all sets, dealt by gram."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            grams = np.concatenate([h[0] for h in held])
            lengths = [len(h[0]) for h in held]
            place = np.concatenate([np.arange(k) for k in lengths])
            rows = np.stack([grams.view(np.int64), np.repeat(np.array([h[1] for h in held], np.int64), lengths), np.repeat(np.array([h[2] for h in held], np.int64), lengths) + (place << 32)])
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            bucket = (bucket + salt_of(grams, rows[1], split)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, cuts)
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([rows[:, p].tobytes() for p in parts], pa.binary())], names=["bucket", "rows"])

        for batch in it:
            for grams in gram_sets(batch.column(0), n_words):
                if not len(grams) or (c := class_of(grams)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                held.append((prefix(grams, shared.value), c, len(grams)))
                size += len(held[-1][0])
                if size >= BUCKET_POSTINGS:
                    yield packed()
                    held, size = [], 0
                    release()
        if held:
            yield packed()

    return texts.select("text").mapInArrow(tidy(run), "bucket long, rows binary")


def split_grams(heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The grams known to fill half a bucket or more, whose lists are gathered in parts, and their counts."""
    known, counts = heavy
    return known[2 * counts >= BUCKET_POSTINGS], counts[2 * counts >= BUCKET_POSTINGS]


def parts_of(grams: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many parts the list of each gram is gathered: one, but for those to split."""
    known, counts = split
    if not len(known):
        return np.ones(len(grams), np.int64)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, 1 + 2 * counts[at] // BUCKET_POSTINGS, 1)


def salt_of(grams: np.ndarray, classes: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which part of its gram's list a class is in; 0 for lists of one part."""
    if not len(split[0]):
        return np.zeros(len(grams), np.int64)
    return (classes.view(np.uint64) % parts_of(grams, split).astype(np.uint64)).astype(np.int64)


LISTS = "list long, part long, size long, grams long, classes array<long>, sizes array<long>"
LIST_COLUMNS = ["list", "part", "size", "grams", "classes", "sizes"]


def partnered(rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which postings (gram, class, n + place << 32), sorted by gram, may link with another of their list.

    The gram of a list is the first that two sets share, or they also meet in the list of that one; if
    it is, they share at most what each has from it on. ``whole`` lists, and those of over PAIRED sets,
    are kept.
    """
    gram, n = rows[0], rows[2] & 0xFFFFFFFF
    rest = n - (rows[2] >> 32)
    keep = whole.copy()
    left = np.flatnonzero(~whole)
    for lag in range(1, PAIRED + 1):
        left = left[left + lag < len(gram)]
        left = left[gram[left] == gram[left + lag]]
        if not len(left):
            return keep
        right = left + lag
        near = (NUM + DEN) * np.minimum(rest[left], rest[right]) >= NUM * (n[left] + n[right])
        keep[left[near]] = keep[right[near]] = True
    # what is left has more than PAIRED sets after it
    long = np.flatnonzero(np.isin(gram, gram[left]) & ~whole)
    keep[long] = paired_by_order(gram[long], n[long], rest[long])
    return keep


def paired_by_order(gram: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which members of lists, sorted by gram, may link with another of their list.

    A set may link with others of up to ``reach`` grams, if its own grams are no more than their reach.
    So it is held against the two largest reaches among the sets that it reaches; one may be its own.
    """
    reach = np.maximum(0, ((NUM + DEN) * rest - NUM * n) // NUM)
    base = np.cumsum(np.append(0, gram[1:] != gram[:-1])) * (max(int(n.max()), int(reach.max())) + 1)
    order = np.lexsort((n, base))
    size, far = (base + n)[order], (base + reach)[order]
    first = np.maximum.accumulate(far)
    second = np.maximum.accumulate(np.append(-1, np.minimum(far[1:], first[:-1])))
    end = np.searchsorted(size, far, side="right") - 1
    out = np.empty(len(gram), bool)
    out[order] = (end >= 0) & (np.where(far >= size, second[end], first[end]) >= size)
    return out


def inverted_lists(table: pa.Table, split: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """The distinct lists of two classes or more of one bucket, named by their members' digest.

    Parts of a list gathered in several are named by their gram, and stay even with one class.
    """
    rows = np.concatenate([np.frombuffer(r, np.int64).reshape(3, -1) for r in table.column("rows").to_pylist()], axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    fresh = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    rows = rows[:, fresh]
    rows = rows[:, partnered(rows, parts_of(rows[0].view(np.uint64), split) > 1)]
    rows[2] &= 0xFFFFFFFF
    if not rows.shape[1]:
        return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2)], names=LIST_COLUMNS)
    first = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
    after = np.append(first[1:], rows.shape[1])
    parts = parts_of(rows[0, first].view(np.uint64), split)
    several = np.flatnonzero((after - first > 1) | (parts > 1))  # most grams are in one set alone
    out: dict[tuple[int, int], np.ndarray] = {}
    for a, b, n_parts in zip(first[several].tolist(), after[several].tolist(), parts[several].tolist(), strict=True):
        if n_parts > 1:  # two parts of a list may have met in one bucket
            own = rows[1, a:b].view(np.uint64) % np.uint64(n_parts)
            for salt in np.unique(own).tolist():
                at = a + np.flatnonzero(own == salt)
                out[int(rows[0, a]), 1 + salt] = at
        else:
            out.setdefault((class_of(rows[1, a:b]), 0), np.arange(a, b))
    spans = list(out.values())
    return pa.table(
        [
            pa.array([k[0] for k in out], pa.int64()),
            pa.array([k[1] for k in out], pa.int64()),
            pa.array([len(at) for at in spans], pa.int64()),
            pa.array([int(rows[2, at].sum()) for at in spans], pa.int64()),
            pa.array([rows[1, at] for at in spans], pa.list_(pa.int64())),
            pa.array([rows[2, at] for at in spans], pa.list_(pa.int64())),
        ],
        names=LIST_COLUMNS,
    )


def divide_skip(sets: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, int]:
    """(groups after joining linked sets, links found) of sets that are sorted by size, ascending.

    ``groups`` numbers the groups known before; sets of one group are not compared.
    """
    n_sets = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n_sets), sizes)
    grams, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.lexsort((owner, gram))
    entries = owner[order]  # of all lists, one after the other
    begin = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(grams)))])
    keys = gram[order] * n_sets + entries  # ascending: binary search finds a document in a list
    mine = np.concatenate([[0], np.cumsum(sizes)])
    group, links = groups.copy(), 0
    for x in range(n_sets):
        lists = gram[mine[x] : mine[x + 1]]
        length = begin[lists + 1] - begin[lists]
        lists, length = lists[length > 1], length[length > 1]
        least = -(-2 * NUM * int(sizes[x]) // (NUM + DEN))  # any partner is as large, or larger
        if len(lists) < least:
            continue
        lists = lists[np.argsort(length, kind="stable")]
        n_long = min(least - 1, int(least / (MU * np.log2(max(2, int(length.max()))) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.concatenate([entries[begin[k] : begin[k + 1]] for k in short.tolist()])
        count = np.bincount(merged, minlength=n_sets)
        need = -(-NUM * (int(sizes[x]) + sizes) // (NUM + DEN))
        near = np.flatnonzero((count + n_long >= need) & (np.arange(n_sets) > x) & (DEN * int(sizes[x]) >= NUM * sizes) & (group != group[x]))
        while len(near):
            block, near = near[: max(1, 1_000_000 // max(1, n_long))], near[max(1, 1_000_000 // max(1, n_long)) :]
            if n_long:
                probe = long[:, None] * n_sets + block[None, :]
                at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                total = count[block] + (keys[at] == probe).sum(axis=0)
            else:
                total = count[block]
            for y in block[total >= need[block]].tolist():
                links += 1
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
            near = near[group[near] != group[x]]
    return group, links


#: Words of bitmaps that are compared at a time.
STRIP = 1 << 17
BLOCK_COLUMNS = ["block", "class", "root", "n"]


def may_link(sizes: np.ndarray, groups: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Which sets may link with one of another group, by their bitmaps; sets are sorted by size, ascending.

    Sets that link differ in size by a third at most, so in width by one doubling at most; the wider
    bitmap is folded to the width of the other.
    """
    out = np.zeros(len(sizes), bool)
    words = np.array([len(b) for b in bits])
    for width in np.unique(words).tolist():
        own, wider = np.flatnonzero(words == width), np.flatnonzero(words == 2 * width)
        wider = wider[NUM * sizes[wider] <= DEN * int(sizes[own[-1]])]
        rows = np.concatenate([own, wider])
        grid = np.array([bits[k] if words[k] == width else bits[k][:width] | bits[k][width:] for k in rows.tolist()])
        n, group = sizes[rows], groups[rows]
        last = np.searchsorted(NUM * n, DEN * n[: len(own)], side="right")
        ones = np.bitwise_count(grid).sum(axis=1, dtype=np.int64)
        rows_at_once = max(1, STRIP // (width * len(rows)))
        columns_at_once = max(1, STRIP // width)
        for k in range(0, len(own), rows_at_once):
            mine = np.arange(k, min(k + rows_at_once, len(own)))
            for at in range(k + 1, int(last[mine].max()), columns_at_once):
                near = np.arange(at, min(at + columns_at_once, int(last[mine].max())))
                pair = (near > mine[:, None]) & (near < last[mine][:, None]) & (group[near] != group[mine][:, None])
                if not pair.any():
                    continue
                both = np.bitwise_count(grid[mine][:, None] & grid[near]).sum(axis=2, dtype=np.int64)
                most = both + np.minimum((n - ones)[mine][:, None], (n - ones)[near])
                pair &= (NUM + DEN) * most >= NUM * (n[mine][:, None] + n[near])
                out[rows[mine[pair.any(axis=1)]]] = True
                out[rows[near[pair.any(axis=0)]]] = True
    return out


def of_blocks(table: pa.Table) -> Iterator[pa.Table]:
    """The blocks of a group, each with its classes once, ascending by n."""
    block, own = table.column("block").to_numpy(), table.column("class").to_numpy()
    order = np.lexsort((own, table.column("n").to_numpy(), block))
    block, own = block[order], own[order]
    other = np.concatenate([[True], block[1:] != block[:-1]])
    fresh = np.flatnonzero(other | np.concatenate([[True], own[1:] != own[:-1]]))
    table = table.take(pa.array(order[fresh])).combine_chunks()
    first = np.flatnonzero(other[fresh])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(fresh)], strict=True):
        yield table.slice(a, b - a)


def sift(table: pa.Table) -> pa.Table:
    """block, class, root, n of the sets of each block of a group that may link with one of another root."""
    kept = []
    for one in of_blocks(table):
        raw, at = utf8(one.column("bits"))
        bits = [raw[a:b].view(np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        keep = may_link(one.column("n").to_numpy(), one.column("root").to_numpy(), bits)
        if keep.any():
            kept.append(one.select(BLOCK_COLUMNS).filter(pa.array(keep)))
    return pa.concat_tables(kept) if kept else table.select(BLOCK_COLUMNS).slice(0, 0)


def search_block(table: pa.Table) -> pa.Table:
    """a, b: for each set of a block that joined another, the two classes."""
    edges = []
    for one in of_blocks(table):
        before = np.unique(one.column("root").to_numpy(), return_inverse=True)[1]
        after, _ = divide_skip([np.frombuffer(raw, np.uint64) for raw in one.column("set").to_pylist()], before)
        first: dict[int, int] = {}
        for c, g in zip(one.column("class").to_pylist(), after.tolist(), strict=True):
            if first.setdefault(g, c) != c:
                edges.append((first[g], c))
    return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def search(blocks: DataFrame, texts: DataFrame, classes: DataFrame, n_words: int) -> DataFrame:
    """Edges between classes of the same block with different roots; ``blocks``, a materialized table, has block, class, root, n.

    A class is in one block of the first rounds, and later in as many as it has open lists or chunks
    to meet, so no class is a hot key. Blocks meet as bitmaps, then with the sets of what is left.
    """
    few, group = grouped(blocks)
    near = classes.select("class", "n", "bits").join(few.drop("n"), "class").groupBy(group).applyInArrow(tidy_group(sift), "block long, class long, root long, n long")
    near = materialize(merge_blocks(materialize(near, "near")), "near")
    speakers = materialize(classes.join(near.select("class").distinct(), "class", "left_semi").select(F.col("speaker").alias("key")).distinct(), "speakers")
    sets = class_sets(only_ids(texts, speakers, "key"), n_words)
    few, group = grouped(near)
    return sets.join(few.drop("n"), "class").groupBy(group).applyInArrow(tidy_group(search_block), "a long, b long")


def grouped(blocks: DataFrame) -> tuple[DataFrame, Column]:
    """``blocks``, broadcast if it is short, and a column that deals them to groups of about BLOCK_GRAMS grams, or of one block."""
    rows, grams = blocks.agg(F.count("*"), F.sum("n")).first()
    groups = max(1, -(-(grams or 0) // BLOCK_GRAMS))
    return F.broadcast(blocks) if rows <= BROADCAST_ROWS else blocks, F.pmod("block", F.lit(groups))


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the same smallest class become one where that is no larger than a block may be.

    Documents that share a passage share many lists, and so each set goes to fewer blocks.
    """
    led = blocks.join(blocks.groupBy("block").agg(F.min("class").alias("lead")), "block")
    union = materialize(led.select("lead", "class", "root", "n").distinct(), "merged")
    fits = materialize(union.groupBy("lead").agg(F.sum("n").alias("grams")).filter(F.col("grams") <= BLOCK_GRAMS).select("lead"), "fits")
    columns = ["block", "class", "root", "n"]
    whole = union.join(fits, "lead").withColumn("block", F.xxhash64("lead", F.lit("lead"))).select(*columns)
    return whole.unionByName(led.join(fits, "lead", "left_anti").select(*columns))


def chunk(salt: int) -> Column:
    """Which part of a list a class falls in; lists of at most BLOCK_GRAMS have one."""
    parts = F.ceil(F.col("grams") / BLOCK_GRAMS).cast("long")
    return F.pmod(F.xxhash64("class", F.lit(salt)), parts)


def link_classes(texts: DataFrame, classes: DataFrame, heavy: tuple[np.ndarray, np.ndarray], n_words: int, first_rounds: int = 2) -> DataFrame:
    """class, root: the groups that links form, for all classes that link with another."""
    need = F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("long") + 1
    total = classes.agg(F.sum(need * F.col("k"))).first()[0] or 0
    split = split_grams(heavy)
    dealt = postings(texts, heavy, split, max(1, -(-total // BUCKET_POSTINGS)), n_words)
    lists = materialize(dealt.groupBy("bucket").applyInArrow(tidy_group(lambda t: inverted_lists(t, split)), LISTS), "lists")
    forget(texts.sparkSession)
    # of lists with equal members one is enough; the parts of one list are all needed, and together have its size
    whole = lists.filter("part = 0").dropDuplicates(["list"]).drop("part")
    split = lists.filter("part > 0")
    sums = split.groupBy("list").agg(F.sum("size").alias("size"), F.sum("grams").alias("grams")).filter("size > 1")  # at most HEAVY_GRAMS rows
    lists = materialize(whole.unionByName(split.drop("size", "grams").join(F.broadcast(sums), "list").select(*whole.columns)), "lists")
    member = lists.select("list", "size", "grams", F.explode(F.arrays_zip("classes", "sizes")).alias("m")).select("list", "size", "grams", F.col("m.classes").alias("class"), F.col("m.sizes").alias("n"))
    edges: DataFrame | None = None
    several = member.filter(F.col("grams") > BLOCK_GRAMS)
    for salt in range(first_rounds):
        # a list of one chunk has met in the first round, and would in the same way
        if salt and several.isEmpty():
            break
        rest = still_open(several, components(edges)) if salt else materialize(member.withColumn("root", F.col("class")), "members")
        if rest.isEmpty():
            break
        home = rest.groupBy("class").agg(F.max(F.struct("size", "list", "grams")).alias("h"), F.first("n").alias("n"), F.first("root").alias("root")).select("class", "n", "root", F.col("h.list").alias("list"), F.col("h.grams").alias("grams"))
        blocks = home.select(F.xxhash64("list", chunk(salt)).alias("block"), "class", "root", "n")
        crowded = blocks.groupBy("block").agg(F.count("*").alias("k")).filter("k > 1").select("block")
        found = search(materialize(blocks.join(crowded, "block", "left_semi"), "blocks"), texts, classes, n_words)
        edges = materialize(found if edges is None else edges.unionByName(found), "links")
        forget(texts.sparkSession)
    if edges is None:
        return classes.sparkSession.createDataFrame([], "class long, root long")
    # members of all lists meet the groups once, when the first rounds are over
    open_lists = still_open(member, components(edges))
    if not open_lists.isEmpty():
        blocks = merge_blocks(materialize(pair_chunks(open_lists), "blocks"))
        found = search(materialize(blocks, "blocks"), texts, classes, n_words)
        edges = materialize(edges.unionByName(found), "links")
        forget(texts.sparkSession)
    return components(edges).withColumnRenamed("node", "class")


def still_open(member: DataFrame, groups: DataFrame) -> DataFrame:
    """Members, with their group, of the lists that hold more than one group."""
    sized = materialize(member.groupBy("class").agg(F.count("*").alias("k")).join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")
    rooted = materialize(join_sized(member, sized, ["class"], "k").drop("k"), "rooted")
    mixed = materialize(rooted.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k")).filter("low <> high").select("list", "k"), "mixed")
    return materialize(join_sized(rooted, mixed, ["list"], "k").drop("k"), "members")


def pair_chunks(members: DataFrame) -> DataFrame:
    """block, class, root, n: so that any two members of a list with different groups meet in a block.

    A list of one chunk is one block. In a larger one, the members are split into bands of their
    size, and large bands by hash; the largest group meets the others, and the others each other, only where one range can
    link with the other (neither more than DEN / NUM times as large).
    """
    small = members.filter(F.col("grams") <= BLOCK_GRAMS).select(F.xxhash64("list").alias("block"), "class", "root", "n")
    large = members.filter(F.col("grams") > BLOCK_GRAMS)
    counted = large.groupBy("list", "root").agg(F.count("*").alias("k"))
    top = counted.groupBy("list").agg(F.max(F.struct("k", "root")).alias("t"), F.sum("k").alias("k")).select("list", F.col("t.root").alias("top"), "k")
    # chunks of about half a block's grams: bands of size, and within a band parts by hash
    cut = join_sized(large, materialize(top, "tops"), ["list"], "k").withColumn("is_top", F.col("root") == F.col("top"))
    cut = materialize(cut.withColumn("band", F.floor(F.log(DEN / NUM, F.col("n")))).select("list", "class", "root", "n", "is_top", "band"), "chunks")
    bands = cut.groupBy("list", "is_top", "band").agg(F.ceil(F.sum("n") / (BLOCK_GRAMS // 2)).alias("parts"), F.count("*").alias("k"))
    cut = join_sized(cut, materialize(bands, "bands"), ["list", "is_top", "band"], "k")
    cut = materialize(cut.withColumn("chunk", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("class"), F.col("parts"))).select("list", "class", "root", "n", "is_top", "chunk"), "chunks")
    ranges = materialize(cut.groupBy("list", "is_top", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high")), "ranges")
    left = ranges.filter("NOT is_top").select("list", *(F.col(c).alias(f"l_{c}") for c in ("is_top", "chunk", "low", "high")))
    pairs = left.join(ranges, "list").filter((F.col("is_top") | (F.col("l_chunk") <= F.col("chunk"))) & (DEN * F.col("high") >= NUM * F.col("l_low")) & (DEN * F.col("l_high") >= NUM * F.col("low")))
    block = F.xxhash64("list", "l_chunk", "is_top", "chunk")
    sides = pairs.select("list", F.explode(F.array(F.struct(F.lit(False).alias("is_top"), F.col("l_chunk").alias("chunk")), F.struct("is_top", "chunk"))).alias("s"), block.alias("block"))
    sides = sides.select("list", "s.is_top", "s.chunk", "block").distinct()
    return small.unionByName(sides.join(cut, ["list", "is_top", "chunk"]).select("block", "class", "root", "n"))


def class_sets(texts: DataFrame, n_words: int) -> DataFrame:
    """class, n, set: the packed grams of each text; a class may come twice where identifiers repeat."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = gram_sets(batch.column(1), n_words)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "set"])

    return texts.select("key", "text").mapInArrow(tidy(run), "class long, n long, set binary")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, class for every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Documents link when
    4 * |intersection| >= 3 * |union|; ``component_id`` is the smallest identifier reachable by links.
    A text without words, or null, is linked with nothing and its component is its own identifier.
    Rows that repeat an identifier are compared each; rows whose identifier is null take part in
    linking but never name a component. Other columns are not read. Whole texts are compared.
    """
    prepare(docs.sparkSession)
    identifier = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    met = materialize(signatures(docs.select(identifier.alias("doc_id"), text), n_words), "signatures")
    signed = met.filter("gram IS NULL").drop("gram", "often")
    heavy = heavy_grams(met.filter("gram IS NOT NULL").select("gram", "often"))
    key = F.coalesce("doc_id", F.lit(NO_ID))
    one = (F.min("doc_id").alias("low"), F.max(key).alias("speaker"), F.count("*").alias("k"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(signed.filter("n > 0").groupBy("class").agg(*one), "classes")
    groups = materialize(link_classes(docs.select(F.coalesce(identifier, F.lit(NO_ID)).alias("key"), text), classes, heavy, n_words), "groups")
    rooted = materialize(classes.select("class", "low", "k").join(groups, "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m"))
    named = materialize(join_sized(rooted, materialize(lowest, "lowest"), ["root"], "m").select("class", "k", "component_id"), "named")
    full = join_sized(signed.filter("n > 0"), named, ["class"], "k")
    empty = signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "class")
    return full.select("doc_id", "n", "component_id", "class").unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group the row with the smallest identifier, null ones last."""
    unnamed, text = ROW_KEY[1], ROW_KEY[2]
    rows = row_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    # texts are told apart by their hash; equal ones are of one group
    groups = jaccard_groups(rows.select(text, "text"), text, "text").select(F.col("doc_id").alias(text), "component_id").distinct()
    members = materialize(rows.groupBy(*ROW_KEY).agg(F.count("*").alias("k")), "keys")
    sized = materialize(groups.join(members.groupBy(text).agg(F.count("*").alias("n")), text), "groups")
    found = materialize(join_sized(members, sized, [text], "n"), "members")
    own = F.struct(unnamed, *(c for c in ROW_KEY if c != unnamed))
    stay = found.groupBy("component_id").agg(F.min(own).alias("own"), F.count("*").alias("m"), F.min_by("k", own).alias("k"))
    # a text without words is linked with nothing, so its rows all stay
    bare = signatures_of_nothing(rows.select(text, "text"), text)
    stay = materialize(stay.join(bare, F.col("component_id") == F.col(text), "left_anti").select("component_id", "own.*", "m", "k"), "stay")
    several = stay.filter("m > 1").select("component_id", F.col("m").alias("size"))
    gone = join_sized(found.select(*ROW_KEY, "component_id"), materialize(several, "several"), ["component_id"], "size").select(*ROW_KEY).join(stay, ROW_KEY, "left_anti")
    return without_rows(docs, gone, stay.filter("k > 1"), id_col, text_col)


def signatures_of_nothing(texts: DataFrame, key: str) -> DataFrame:
    """The keys of texts without any word."""
    return texts.filter(~F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]")).select(key).distinct()
