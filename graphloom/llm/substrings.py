"""Removal of word windows that also start in a document with a smaller id.

Each map task cuts whole texts into words and settles the windows that repeat
within its own chunk of texts: of equal windows only those of the smallest
document go on, so a passage that many documents hold is gathered before it is
shuffled. The others travel as super-k-mers: consecutive windows of a document
that share a minimiser (the least hash of their words, words of up to SHORT
bytes last because these are the frequent ones) are one packed string, sent to the minimiser's bucket with the number of its first word.
Equal windows have equal minimisers, so they meet in one bucket, where sorting
their hashes brings them together and comparing their bytes makes it exact.
A first pass counts all windows by the hash of their minimiser, CELLS numbers;
minimisers with far more than their share are split by the hash of the window,
so that equal windows still meet and no bucket is much larger than the others.
A bucket is read block by block; what is settled is let go, so memory follows
its distinct windows and not the copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import PIECES, buckets_for, chunks, lean, short_batches, vector_pieces, vector_sum
from graphloom.llm.wordarrays import Words, mixed, rolled, rolled_min, same_bytes, text_buffer
from graphloom.plans.scratch import n_partitions

WINDOW, SHORT = 13, 4
CHUNK = 1 << 20
#: Bytes of (compressed) input for each bucket.
BUCKET_BYTES = 1 << 20
#: Bytes of packed strings that a bucket task settles at once, at least.
SETTLE = 4 << 20
#: Numbers in which windows are counted by minimiser; times its fair share from which a cell of minimisers is split.
CELLS, HEAVY = 1 << 16, 4.0
MARKS = "_id long, _key long, s int, e int"


def settle(words: Words, ids: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, removed): numbers of the first words of all windows, and whether a smaller id holds the same window.

    ids[d] is the document of text d; texts of one document don't count against each other.
    """
    size = np.diff(words.first)
    n_win = np.maximum(size - width + 1, 0)
    total = int(n_win.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    win = np.arange(total) + np.repeat(words.first[:-1] - (np.cumsum(n_win) - n_win), n_win)
    hashed = rolled(words.hashes(), width)[win]
    removed = np.zeros(total, bool)
    order = np.argsort(hashed)
    h = hashed[order]
    twin = h[1:] == h[:-1]
    if not twin.any():
        return win, removed
    near = np.zeros(total, bool)
    near[1:] |= twin
    near[:-1] |= twin
    order, h = order[near], h[near]
    new = np.append(True, h[1:] != h[:-1])
    owner = ids[np.repeat(np.arange(len(ids)), n_win)[order]]
    at = words.start[win[order]]
    length = words.start[win[order] + width] - at
    head = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first of each group
    odd = (length != length[head]) | ~same_bytes(words.buf, at, at[head], np.minimum(length, length[head]))
    if odd.any():  # different windows with one hash: tell them apart by their bytes
        group = np.cumsum(new) - 1
        mixed_up = np.isin(group, group[odd])
        least: dict[bytes, int] = {}
        texts = [words.buf[a : a + n].tobytes() for a, n in zip(at[mixed_up], length[mixed_up])]
        for t, d in zip(texts, owner[mixed_up].tolist()):
            least[t] = min(d, least.get(t, d))
        removed[order[mixed_up]] = [d > least[t] for t, d in zip(texts, owner[mixed_up].tolist())]
        order, owner, new, h = order[~mixed_up], owner[~mixed_up], new[~mixed_up], h[~mixed_up]
        if not len(order):
            return win, removed
        new = np.append(True, h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    least_id = np.minimum.reduceat(owner, starts)
    removed[order] = owner > np.repeat(least_id, np.diff(np.append(starts, len(order))))
    return win, removed


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of runs of true flags; breaks[i]: a run can't go on from i-1 to i."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | breaks[1:]
    end = flags.copy()
    end[:-1] &= ~flags[1:] | breaks[1:]
    return np.flatnonzero(begin), np.flatnonzero(end)


def _marks(ids, keys, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["_id", "_key", "s", "e"])


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unsqueeze(part: bytes) -> bytes:
    return pa.decompress(part[8:], decompressed_size=int.from_bytes(part[:8], "little"), codec="zstd", asbytes=True)


def _pack(*arrays: np.ndarray) -> bytes:
    return squeeze(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(part: bytes, kinds) -> list[np.ndarray]:
    raw = unsqueeze(part)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


_SEG = (np.int64, np.int64, np.int32, np.int32, np.uint8)  # document, key, first word, bytes, packed strings
_MARK = (np.int64, np.int64, np.int32, np.int32)


def minimisers(words: Words, win: np.ndarray) -> np.ndarray:
    """The least rank of the words of each window."""
    rank = (words.hashes() >> np.uint64(1)) | ((np.diff(words.start) <= SHORT + 1).astype(np.uint64) << np.uint64(63))
    return rolled_min(rank, WINDOW)[win]


def cell_of(least: np.ndarray) -> np.ndarray:
    return (mixed(least) % np.uint64(CELLS)).astype(np.int64)


def window_counts(texts: DataFrame) -> np.ndarray:
    """Windows of texts(text) by the cell of their minimiser; CELLS numbers a task are summed over the cluster."""

    def task(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in chunks(batches, 0, CHUNK):
            words = Words.of(*text_buffer(batch.column(0)))
            n_win = np.maximum(np.diff(words.first) - WINDOW + 1, 0)
            win = np.arange(int(n_win.sum())) + np.repeat(words.first[:-1] - (np.cumsum(n_win) - n_win), n_win)
            if len(win):
                total += np.bincount(cell_of(minimisers(words, win)), minlength=CELLS)
        yield vector_pieces(total)

    return vector_sum(texts.mapInArrow(lean(task), PIECES), CELLS, np.int64)


def splits(counts: np.ndarray, n_buckets: int) -> np.ndarray:
    """Parts into which each cell is split: 1 unless it has more than HEAVY times the share of a bucket or cell."""
    fair = max(1.0, counts.sum() / min(n_buckets, CELLS))
    return np.where(counts > HEAVY * fair, np.ceil(counts / fair), 1).astype(np.int64)


def _send(n_buckets: int, parts: np.ndarray):
    """Map side: rows (bucket, kind, part); kind 0: super-k-mers, kind 1: words already known to go."""
    heavy = parts.max(initial=1) > 1

    def task(batches):
        for batch in chunks(batches, 2, CHUNK):
            ids, keys = (np.asarray(batch.column(i)) for i in (0, 1))
            words = Words.of(*text_buffer(batch.column(2)))
            win, removed = settle(words, ids)
            if not len(win):
                continue
            text = words.text_of_word()[win]
            breaks = np.append(True, (text[1:] != text[:-1]) | (np.diff(win) != 1))
            rows = []
            a, b = runs(removed, breaks)
            if len(a):
                t = text[a]
                base = words.first[t]
                rows.append((int(ids[t[0]] % n_buckets), 1, _pack(ids[t], keys[t], (win[a] - base).astype(np.int32), (win[b] - base + WINDOW).astype(np.int32))))
            least = minimisers(words, win)
            if heavy:  # windows of a heavy minimiser part by their own hash
                many = parts[cell_of(least)].astype(np.uint64)
                least = np.where(many > 1, mixed(least + np.uint64(1) + rolled(words.hashes(), WINDOW)[win] % many), least)
            a, b = runs(~removed, breaks | np.append(True, least[1:] != least[:-1]))
            if len(a):
                bucket = (mixed(least[a]) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                a, b, bucket = a[order], b[order], bucket[order]
                t = text[a]
                lo, hi = words.start[win[a]], words.start[win[b] + WINDOW]
                raw = words.buf.tobytes()
                strings = [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
                first, size = (win[a] - words.first[t]).astype(np.int32), (hi - lo).astype(np.int32)
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                for i, j in zip(cuts[:-1], cuts[1:]):
                    own = t[i:j]
                    rows.append((int(bucket[i]), 0, _pack(ids[own], keys[own], first[i:j], size[i:j], np.frombuffer(b"".join(strings[i:j]), np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "part"])

    return task


def _judge(batches):
    """Bucket side: rows (_id, _key, s, e), words s to e-1 of a document go."""
    held: list[list[np.ndarray]] = []
    size, limit = 0, SETTLE

    def work():
        nonlocal held, size, limit
        ids, keys, first, length, buf = (np.concatenate(x) for x in zip(*held))
        words = Words.packed(buf, np.cumsum(length))
        win, removed = settle(words, ids)
        text = words.text_of_word()[win]
        breaks = np.append(True, text[1:] != text[:-1])
        a, b = runs(removed, breaks)
        t = text[a]
        s = first[t] + (win[a] - words.first[t])
        out = _marks(ids[t], keys[t], s.astype(np.int32), (s + (win[b] - win[a]) + WINDOW).astype(np.int32))
        a, b = runs(~removed, breaks)
        t = text[a]
        lo, hi = words.start[win[a]], words.start[win[b] + WINDOW]
        raw = buf.tobytes()
        left = np.frombuffer(b"".join([raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())]), np.uint8)
        held = [[ids[t], keys[t], (first[t] + (win[a] - words.first[t])).astype(np.int32), (hi - lo).astype(np.int32), left]]
        size = len(left)
        limit = max(SETTLE, 2 * size)
        return out

    for batch in batches:
        for kind, part in zip(batch.column(1).to_pylist(), batch.column(2)):
            part = part.as_py()
            if kind:
                yield _marks(*_unpack(part, _MARK))
                continue
            held.append(_unpack(part, _SEG))
            size += len(held[-1][-1])
            if size >= limit:
                yield work()
    if len(held) > 1 or held and limit == SETTLE:
        yield work()


def _squeezed(batches):
    """(text, ...) with the text compressed for its way to the marks; null stays null."""
    for batch in batches:
        text = [None if t is None else squeeze(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), *batch.columns[1:]], names=["_z", *batch.schema.names[1:]])


def _cut(whole_text: bool):
    """(compressed text, marks, ...) to (..., [text,] n_words, n_removed, kept_text)."""

    def task(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                marks = batch.column(1)
                s, e = (np.asarray(x) for x in marks.flatten().flatten())
                ends = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(marks), 0))))
                rows = []
                for i, z in enumerate(batch.column(0).to_pylist()):
                    text = None if z is None else unsqueeze(z)
                    words = (text or b"").split()  # for bytes, white space is \x20 and \x09-\x0D
                    n, a, b = len(words), ends[i], ends[i + 1]
                    if b > a:
                        change = np.bincount(s[a:b], minlength=n + 1) - np.bincount(e[a:b], minlength=n + 1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:n] == 0)]
                    rows.append((text, n, n - len(words), b" ".join(words)))
                string = lambda k: pa.array([r[k] for r in rows], pa.binary()).cast(pa.string())
                out = [*batch.columns[2:], *([string(0)] if whole_text else []), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), string(3)]
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[2:], *(["_text"] if whole_text else []), "n_words", "n_removed", "kept_text"])

    return task


def super_kmers(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, kind, part) of rows(_id, _key, _text)."""
    parts = splits(window_counts(rows.select("_text")), n_buckets)  # CELLS numbers, whatever the input
    return rows.mapInArrow(lean(_send(n_buckets, parts)), "bucket int, kind int, part binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_text) for every row of docs; with keep, (id, keep..., text, n_words, ...).

    Every word is removed that a window of 13 words covers whose words also
    start in a document with a smaller id; windows are judged on the input.
    Null texts have no words; a null id is greater than any other. Ids are whole
    numbers; text that isn't one raises. Rows with one id don't count against
    each other, and repeated rows get equal results. Other columns of docs are
    ignored; an empty table gives none. ``buckets`` is the number of buckets; by
    default it follows the bytes that Spark expects of docs, BUCKET_BYTES each.
    """
    spark = docs.sparkSession
    short_batches(docs.sparkSession)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.col(id_col).alias("_row"), order.alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    n = buckets or buckets_for(docs.select(id_col, text_col), BUCKET_BYTES, n_partitions(spark))
    marks = super_kmers(rows.select("_id", "_key", "_text"), n).repartition(n, "bucket").mapInArrow(lean(_judge), MARKS)
    marks = marks.groupBy("_id", "_key").agg(F.collect_set(F.struct("s", "e")).alias("_marks"))  # repeated rows send the same marks
    passed = docs.select(F.col(text_col).alias("_text"), order.alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(id_col).alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = dict(passed.dtypes)
    own = passed.columns[3:]
    texts = passed.mapInArrow(lean(_squeezed), ", ".join(["_z binary", *(f"{c} {kinds[c]}" for c in passed.columns[1:])]))
    joined = texts.join(marks, ["_id", "_key"], "left").select("_z", "_marks", *own)
    out = joined.mapInArrow(lean(_cut(bool(keep))), ", ".join([*(f"{c} {kinds[c]}" for c in own), *(["_text string"] if keep else []), "n_words long", "n_removed long", "kept_text string"]))
    return out.toDF(id_col, *keep, *([text_col] if keep else []), "n_words", "n_removed", "kept_text")


def oracle() -> str:
    """The removal in DuckDB SQL over `documents`."""
    k = WINDOW
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {k - 1}], ' ') win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k} + 2)) i FROM w WHERE len(ws) >= {k})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) least FROM g) WHERE doc_id > least),
x AS (SELECT DISTINCT doc_id, i + j p FROM r, (SELECT unnest(range(0, {k})) j)),
y AS (SELECT doc_id, list(p) gone FROM x GROUP BY doc_id),
z AS (SELECT w.doc_id, len(ws) n, coalesce(len(gone), 0) m, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda v, p: NOT list_contains(gone, p)) END kept FROM w LEFT JOIN y ON w.doc_id = y.doc_id)
SELECT doc_id, CAST(n AS BIGINT) n_words, CAST(m AS BIGINT) n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 FROM z"""
