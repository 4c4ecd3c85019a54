"""Exact n-gram Jaccard self-join by prefix trees, down to linked components.

1. Every whole text becomes its set of 5-word shingles, as 64-bit hashes; equal
   sets share a 128-bit digest and form one class from then on. Shingles are
   dealt to buckets by hash, each once a chunk of texts, and each bucket says
   which were seen twice. A set can link to another, or equal one, only if at
   least 3/4 of its own shingles were: the rest of the corpus leaves here,
   having moved some five bytes a shingle. A bucket is settled block by block
   and keeps its different shingles, not the chunks that hold them.
2. The remaining sets, in global (hash) order, are joined by prefix trees: sets
   of a block form a trie, a set walks the trie of those before it, overlap is
   counted once for each shared path, and subtrees whose remaining lengths
   can't reach the required overlap are cut, as are those already connected.
   Two rounds of bounded blocks, keyed by two different minimum hashes, connect
   nearly all that is alike.
3. An exact pass ends it. A set can still link to another component only if
   3/4 of its shingles are held by other components, so the counting of step 1
   is repeated, two shingles of one component counting as one, until nothing
   leaves. By the
   prefix filter two linked sets of two components share one of their rarest
   shingles: of the k that other components hold, one of the first
   k - ceil(0.75 n) + 1, rare ones first. Sets that share one form a block. A
   block beyond the bound is split into pairs of parts, so that no pair of sets
   is left out and none is emitted unless it links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import buckets_for, chunks, lean, short_batches
from graphloom.llm.substrings import _pack, _unpack
from graphloom.llm.wordarrays import Words, mixed, rolled, text_buffer
from graphloom.operators.components import star_components
from graphloom.plans.scratch import Scratch, n_partitions

SHINGLE = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
CHUNK = 1 << 20
#: Bytes of input for each bucket of shingles.
BUCKET_BYTES = 4 << 20
#: Shingles that a bucket task settles at once, at least.
SETTLE = 1 << 19
#: Sets of one block.
BLOCK = 400


def required(n):
    """The least number of its own shingles that a set of n must share."""
    return -(-NUM * n // DEN)


# --- sets ---------------------------------------------------------------------------------------------------------


def shingle_sets(words: Words) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a shorter text has one, of all its words; one without words none."""
    h = words.hashes()
    five = rolled(h, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if n >= SHINGLE:
            s = np.sort(five[a : b - SHINGLE + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            out.append(mixed(rolled(h[a:b], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sets, as rows of two 64-bit numbers."""
    out = np.empty((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[i, k] = mixed(np.array([mixed(s ^ np.uint64(salt)).sum() + np.uint64(len(s))], np.uint64))[0]
    return out


def _binary(d: np.ndarray) -> pa.Array:
    """Digests as an Arrow column of 16 bytes each."""
    raw = np.ascontiguousarray(d).tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def _numbers(col: pa.Array) -> np.ndarray:
    """Digests back from an Arrow column."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, 2)


class Chunks:
    """Names of a task's chunks: its number and the chunk's place, mixed one to one. No two share a name, and a task run again repeats its own."""

    def __init__(self):
        self.at = TaskContext.get().partitionId() << 32

    def next(self) -> int:
        self.at += 1
        return int(mixed(np.array([self.at], np.uint64)).view(np.int64)[0])


def _planes(tok: np.ndarray) -> np.ndarray:
    """Sorted 32-bit numbers as differences, byte by byte, which compresses well."""
    return np.ascontiguousarray(np.diff(tok, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def _from_planes(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


_DOCS = (np.int64, np.int64, np.uint64, np.int64, np.int64, np.int64)  # ids, hashes of texts, digests, sizes, shingles known to be shared, own set
_ASK = (np.uint8, np.uint32, np.uint8)  # shingles with an asker, their askers, shingles held twice here


def _rows(rows, names=("chunk", "kind", "part"), kinds=(pa.int64(), pa.int32(), pa.binary())):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))


def _dealt_rows(rows):
    return _rows(rows, ("chunk", "bucket", "kind", "part"), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))


DEALT = "chunk long, bucket int, kind int, part binary"


def _slices(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal entries."""
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
    return list(zip(cuts[:-1], cuts[1:]))


def _deal(n_buckets: int):
    """Rows (chunk, bucket, kind, part). kind 0: the documents of a chunk; kind 1: shingles asked about.

    A chunk says each of its shingles once: with the set that asks, or, where
    two of its sets hold it, only so that other chunks learn it.
    """

    def task(batches):
        names = Chunks()
        for batch in chunks(batches, 1, CHUNK):
            ids = np.asarray(batch.column(0))
            sets = shingle_sets(Words.of(*text_buffer(batch.column(1)), lower=True))
            size = np.array([len(s) for s in sets], np.int64)
            d = digests(sets)
            chunk = names.next()
            _, first, cls = np.unique(d.view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True, return_inverse=True)
            own = [sets[i] for i in first]
            tok = np.concatenate(own) if own else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(own)), [len(s) for s in own])
            order = np.argsort(tok)
            t = tok[order]
            new = np.append(True, t[1:] != t[:-1])[: len(t)]
            twice = np.append(~new[1:], False)[: len(t)] | ~new
            known = np.bincount(of[order[twice]], minlength=len(own))
            ask, told = t[new], twice[new]
            asker = of[order[new]].astype(np.uint32)
            bucket, low = ((ask >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), ask.astype(np.uint32)
            by = np.lexsort((low, bucket))
            bucket, low, told, asker = bucket[by], low[by], told[by], asker[by]
            rows = [(chunk, chunk % n_buckets, 0, _pack(ids, np.asarray(batch.column(2)), d.ravel(), size, known[cls].astype(np.int64), cls.astype(np.int64)))]
            for i, j in _slices(bucket):
                held = told[i:j]
                rows.append((chunk, int(bucket[i]), 1, _pack(_planes(low[i:j][~held]), asker[i:j][~held], _planes(low[i:j][held]))))
            yield _dealt_rows(rows)

    return task


NOBODY = np.uint32(0xFFFFFFFF)


class Asked:
    """Shingles asked about in the buckets of a task, settled block by block.

    A shingle is (bucket, 32 bits): with the bucket these tell most shingles
    apart; where they don't, a set only seems to share more. What is known to
    be shared is kept once and without askers, so memory follows the different
    shingles of the buckets and not the chunks that hold them.
    """

    def __init__(self):
        self.parts, self.size, self.limit = [], 0, SETTLE

    def add(self, key, chunk, local, label=None) -> bool:
        """Whether it is time to settle. label: pairs of numbers; askers of one label don't count against each other."""
        label = np.zeros((len(key), 0), np.uint64) if label is None else label
        self.parts.append((key, np.full(len(key), chunk, np.int64), local, label))
        self.size += len(key)
        return self.size >= self.limit

    def settle(self, labels: bool = False):
        """Rows (chunk, 1, part): how many shingles of each asker are shared, of those that weren't known to be before."""
        if not self.parts:
            return []
        key, chunk, local, label = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key, chunk, local, label = key[order], chunk[order], local[order], label[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(starts, len(key)))
        shared = np.logical_or.reduceat(local == NOBODY, starts)
        if labels:
            for k in range(label.shape[1]):
                shared |= np.minimum.reduceat(label[:, k], starts) != np.maximum.reduceat(label[:, k], starts)
        else:
            shared |= n > 1
        each = np.repeat(shared, n)
        told = np.flatnonzero(each & (local != NOBODY))
        out = []
        if len(told):
            told = told[np.lexsort((local[told], chunk[told]))]
            c, who = chunk[told], local[told]
            new = np.append(True, (c[1:] != c[:-1]) | (who[1:] != who[:-1]))
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(c))).astype(np.uint32)
            c, who = c[at], who[at]
            out = [(int(c[i]), 1, _pack(who[i:j], count[i:j])) for i, j in _slices(c)]
        head = starts[shared]
        left = ~each
        marks = len(head)
        self.parts = [(np.append(key[left], key[head]), np.append(chunk[left], chunk[head]), np.append(local[left], np.full(marks, NOBODY)), np.append(label[left], label[head], axis=0))]
        self.size = len(self.parts[0][0])
        self.limit = max(SETTLE, 2 * self.size)
        return out


def _answer(batches):
    """Rows (chunk, kind, part): documents as they came; for each asking chunk its sets and their numbers of shared shingles."""
    asked = Asked()
    for batch in batches:
        out = []
        for chunk, bucket, kind, part in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if not kind:
                out.append((chunk, 0, part))
                continue
            low, local, held = _unpack(part, _ASK)
            low, held = _from_planes(low), _from_planes(held)
            key = np.append(low, held).astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
            if asked.add(key, chunk, np.append(local, np.full(len(held), NOBODY))):
                out += asked.settle()
        yield _rows(out)
    yield _rows(asked.settle())


def _counts(parts, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for local, k in parts:
        out[local] += k
    return out


def _sum_up(batches):
    """Rows (_id, _key, sid, n, may): may is whether a document's set shares enough shingles to link. All rows of a chunk are here."""
    docs, counts = {}, {}
    for batch in batches:
        for chunk, kind, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if kind:
                counts.setdefault(chunk, []).append(_unpack(part, (np.uint32, np.uint32)))
            else:
                docs[chunk] = part
    for chunk, part in docs.items():
        ids, keys, d, size, known, cls = _unpack(part, _DOCS)
        got = _counts(counts.get(chunk, ()), int(cls.max(initial=-1)) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), _binary(d), pa.array(size), pa.array((size > 0) & (known + got[cls] >= required(size)))], names=["_id", "_key", "sid", "n", "may"])


def _whole(batches):
    """(text) to (sid, n, tokens, k0, k1): sorted shingles and two minimum hashes; one row for equal sets of a task."""
    seen = set()
    for batch in chunks(batches, 0, CHUNK):
        sets = shingle_sets(Words.of(*text_buffer(batch.column(0)), lower=True))
        rows = []
        for s, d in zip(sets, _binary(digests(sets)).to_pylist()):
            if len(s) and d not in seen:
                seen.add(d)
                rows.append((d, len(s), s.tobytes(), int(s[0] >> np.uint64(1)), int(mixed(s).min() >> np.uint64(1))))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["sid", "n", "tokens", "k0", "k1"])


# --- the prefix tree ----------------------------------------------------------------------------------------------


class Trie:
    """A path-compressed trie of ordered sets. Node: (tokens from, to, leaves from, to, children, least n, largest n)."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common[i] = int(differ.argmax()) if differ.any() else m
        self.nodes: list[tuple] = []
        if not sets:
            return
        todo = [(0, len(sets), 0, None)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = len(self.sets[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
            me = len(self.nodes)
            self.nodes.append((depth, end, lo, hi, [], int(self.size[lo:hi].min()), int(self.size[lo:hi].max())))
            if parent is not None:
                self.nodes[parent][4].append(me)
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
                todo += [(a, b, end, me) for a, b in zip(cuts[:-1], cuts[1:])]

    def links(self, labels: list, parts: list | None = None) -> list[tuple[int, int]]:
        """Pairs of set numbers that link and, with those before them, connect different labels. With parts, only pairs of different parts count."""
        if not self.sets:
            return []
        _, comp = np.unique([labels[i] for i in self.order], return_inverse=True)
        comp = comp.copy()
        part = np.array([parts[i] for i in self.order]) if parts else None
        found = []
        for i in range(1, len(self.sets)):
            x = self.sets[i]
            n = len(x)
            fits = (DEN * np.minimum(self.size[:i], n) >= NUM * np.maximum(self.size[:i], n)) & (comp[:i] != comp[i])
            if part is not None:
                fits &= part[:i] != part[i]
            if not fits.any():
                continue
            open_ = np.append(0, np.cumsum(fits))
            todo = [(0, 0)]
            while todo:
                node, overlap = todo.pop()
                begin, end, lo, hi, children, least, most = self.nodes[node]
                hi = min(hi, i)
                if lo >= hi or open_[hi] == open_[lo]:
                    continue
                seg = self.sets[lo][begin:end]
                rest = n
                if len(seg):
                    at = np.searchsorted(x, seg)
                    same = x[np.minimum(at, n - 1)] == seg
                    overlap += int(np.count_nonzero(same))
                    rest = n - int(at[-1]) - int(same[-1])
                elif end:
                    rest = n - int(np.searchsorted(x, self.sets[lo][end - 1], side="right"))
                # a union of n and m shingles holds at least NUM / (NUM + DEN) of n + m in common
                if (NUM + DEN) * (overlap + min(rest, most - end)) < NUM * (n + least):
                    continue
                if children:
                    todo += [(c, overlap) for c in children[::-1]]  # the nearest in order is walked first
                    continue
                if DEN * overlap >= NUM * (n + int(self.size[lo]) - overlap):
                    found.append((self.order[lo], self.order[i]))
                    comp[comp == comp[lo]] = comp[i]
                    fits &= comp[:i] != comp[i]
                    open_ = np.append(0, np.cumsum(fits))
        return found


def _join_block(group: pa.Table) -> pa.Table:
    """Links inside a block of sets, as stars: each linked set with the least of those it is connected to here.

    A set that comes twice counts once. Blocks (i, j) of two parts compare one
    with the other.
    """
    sid = group.column("sid").to_pylist()
    once = {s: i for i, s in enumerate(sid)}
    at = sorted(once.values())
    tokens, label, own = (group.column(c).to_pylist() for c in ("tokens", "label", "own"))
    sets = [np.frombuffer(tokens[i], np.uint64) for i in at]
    parts = [own[i] for i in at] if group.column("i")[0].as_py() != group.column("j")[0].as_py() else None
    pairs = Trie(sets).links([label[i] for i in at], parts)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        u, v = find(sid[at[a]]), find(sid[at[b]])
        root[max(u, v)] = min(u, v)
    stars = [(x, find(x)) for x in sorted(root)]
    stars = [(x, r) for x, r in stars if x != r]
    return pa.table({"u": pa.array([x for x, _ in stars], pa.binary()), "v": pa.array([r for _, r in stars], pa.binary())})


_BLOCK_ROW = ("key", "i", "j", "own", "sid", "label", "tokens")


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select(*_BLOCK_ROW).groupBy("key", "i", "j").applyInArrow(_join_block, "u binary, v binary")


def _set_part(local: np.ndarray, label: np.ndarray, tok: np.ndarray) -> bytes:
    """Shingles with their askers; the label of an asker goes once."""
    _, first = np.unique(local, return_index=True)
    return _pack(local, label[first].ravel(), tok)


def _from_set_part(part: bytes):
    local, label, tok = _unpack(part, (np.uint32, np.uint64, np.uint64))
    return local, label.reshape(-1, 2)[np.unique(local, return_inverse=True)[1]], tok


def _deal_sets(n_buckets: int, settled: bool):
    """(sid, label, n, tokens) to rows (chunk, bucket, kind, part): kind 0 holds the sets of a chunk, kind 1 shingles of a bucket with the sets and labels that ask.

    If settled, a shingle that two labels of a chunk hold is said once without
    askers, and its sets count it here.
    """

    def task(batches):
        names = Chunks()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                label = _numbers(some.column(1))
                sets = [np.frombuffer(t, np.uint64) for t in some.column(3).to_pylist()]
                tok, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(t) for t in sets])
                bucket = ((tok >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                by = np.lexsort((tok, bucket))
                tok, of, bucket = tok[by], of[by], bucket[by]
                own = label[of]
                known = np.zeros(len(sets), np.int64)
                if settled:
                    starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
                    here = np.zeros(len(starts), bool)
                    for h in range(2):
                        here |= np.minimum.reduceat(own[:, h], starts) != np.maximum.reduceat(own[:, h], starts)
                    each = np.repeat(here, np.diff(np.append(starts, len(tok))))
                    known = np.bincount(of[each], minlength=len(sets))
                    ask = ~each
                    ask[starts[here]] = True
                    of = np.where(each, NOBODY, of).astype(np.uint32)[ask]
                    tok, bucket, own = tok[ask], bucket[ask], own[ask]
                chunk = names.next()
                rows = [(chunk, chunk % n_buckets, 0, _pack(_numbers(some.column(0)).ravel(), label.ravel(), np.asarray(some.column(2)), known.astype(np.int64)))]
                rows += [(chunk, int(bucket[i]), 1, _set_part(of[i:j], own[i:j], tok[i:j])) for i, j in _slices(bucket)]
                yield _dealt_rows(rows)

    return task


_SETS = (np.uint64, np.uint64, np.int64, np.int64)  # sets, labels, sizes, shingles known to be shared


def _answer_sets(batches):
    """Rows (chunk, kind, part): sets as they came; for each asking chunk how many shingles of its sets other labels hold too."""
    asked = Asked()
    for batch in batches:
        out = []
        for chunk, _, kind, part in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if not kind:
                out.append((chunk, 0, part))
                continue
            local, label, tok = _from_set_part(part)
            if asked.add(tok, chunk, local, label):
                out += asked.settle(labels=True)
        yield _rows(out)
    yield _rows(asked.settle(labels=True))


def _sum_sets(batches):
    """Rows (sid, k): the shingles of a set that other labels hold. All rows of a chunk are here."""
    sets, counts = {}, {}
    for batch in batches:
        for chunk, kind, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if kind:
                counts.setdefault(chunk, []).append(_unpack(part, (np.uint32, np.uint32)))
            else:
                sets[chunk] = part
    for chunk, part in sets.items():
        sid, _, _, known = _unpack(part, _SETS)
        yield pa.RecordBatch.from_arrays([_binary(sid), pa.array(known + _counts(counts.get(chunk, ()), len(known)))], names=["sid", "k"])


def still_open(labelled: DataFrame, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """The sets of labelled(sid, n, label, tokens) that may link to another label."""
    n = buckets_for(labelled, BUCKET_BYTES, n_partitions(labelled.sparkSession))
    before = labelled.count()
    for _ in range(rounds):
        dealt = labelled.select("sid", "label", "n", "tokens").mapInArrow(lean(_deal_sets(n, True)), DEALT)
        answers = dealt.repartition(n, "bucket").mapInArrow(lean(_answer_sets), "chunk long, kind int, part binary")
        shared = answers.repartition(n, "chunk").mapInArrow(lean(_sum_sets), "sid binary, k long").filter("k > 0").groupBy("sid").agg(F.max("k").alias("k"))
        new = scratch.save(labelled.join(shared, "sid").filter(F.col("k") * DEN >= NUM * F.col("n")).drop("k"))
        after = new.count()
        scratch.drop(labelled)
        labelled = new
        if after == before or not after:
            break
        before = after
    return labelled


#: Sets from which on a shingle counts as frequent: frequent ones are not told apart by their frequency.
FREQUENT = 1000


class Counted(Asked):
    """Shingles asked about by sets, answered with the number of sets that hold them, FREQUENT at most.

    A shingle is answered as soon as it is known to be frequent and kept without askers from then on.
    """

    def settle(self, last: bool = False):
        """Rows (chunk, 1, part): askers, their shingles that several labels hold, and the numbers of sets."""
        if not self.parts:
            return []
        key, chunk, local, label = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key, chunk, local, label = key[order], chunk[order], local[order], label[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(starts, len(key)))
        told = np.logical_or.reduceat(local == NOBODY, starts)
        several = told.copy()
        for k in range(2):
            several |= np.minimum.reduceat(label[:, k], starts) != np.maximum.reduceat(label[:, k], starts)
        held = np.where(told, FREQUENT, np.minimum(n, FREQUENT))
        ready = several if last else several & (held == FREQUENT)
        each = np.repeat(ready, n)
        say = np.flatnonzero(each & (local != NOBODY))
        say = say[np.argsort(chunk[say], kind="stable")]
        sets = np.repeat(held, n).astype(np.uint32)
        out = [(int(chunk[say[i]]), 1, _pack(local[say[i:j]], key[say[i:j]], sets[say[i:j]])) for i, j in _slices(chunk[say])]
        head, left = starts[ready], ~each
        self.parts = [(np.append(key[left], key[head]), np.append(chunk[left], chunk[head]), np.append(local[left], np.full(len(head), NOBODY)), np.append(label[left], label[head], axis=0))]
        self.size = len(self.parts[0][0])
        self.limit = max(SETTLE, 2 * self.size)
        return out


def _count_sets(batches):
    """Rows (chunk, kind, part): sets as they came; for each asking chunk its shingles of several labels with their numbers of sets."""
    counted = Counted()
    for batch in batches:
        out = []
        for chunk, _, kind, part in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if not kind:
                out.append((chunk, 0, part))
                continue
            local, label, tok = _from_set_part(part)
            if counted.add(tok, chunk, local, label):
                out += counted.settle()
        yield _rows(out)
    yield _rows(counted.settle(last=True))


def _prefixes(batches):
    """Rows (token, sid, label): the rarest shingles of a set, so many that two sets that link have one in common.

    Only shingles that several labels hold can be common to sets of two labels.
    Of k such shingles a link needs required(n), so it has one among the first
    k - required(n) + 1, in an order that is the same for all sets.
    """
    sets, answers = {}, {}
    for batch in batches:
        for chunk, kind, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if kind:
                answers.setdefault(chunk, []).append(_unpack(part, (np.uint32, np.uint64, np.uint32)))
            else:
                sets[chunk] = part
    for chunk, part in sets.items():
        sid, label, size, _ = _unpack(part, _SETS)
        if chunk not in answers:
            continue
        local, tok, m = (np.concatenate(x) for x in zip(*answers.pop(chunk)))
        by = np.lexsort((tok, m, local))
        local, tok = local[by], tok[by]
        k = np.bincount(local, minlength=len(size))
        take = np.maximum(k - required(size) + 1, 0)
        place = np.arange(len(local)) - (np.cumsum(k) - k)[local]
        kept = place < take[local]
        of = local[kept]
        yield pa.RecordBatch.from_arrays([pa.array(tok[kept].view(np.int64)), _binary(sid.reshape(-1, 2)[of]), _binary(label.reshape(-1, 2)[of])], names=["token", "sid", "label"])


def prefixes(labelled: DataFrame) -> DataFrame:
    """(token, sid, label) of the prefixes of labelled(sid, n, label, tokens)."""
    n = buckets_for(labelled, BUCKET_BYTES, n_partitions(labelled.sparkSession))
    dealt = labelled.select("sid", "label", "n", "tokens").mapInArrow(lean(_deal_sets(n, False)), DEALT)
    answers = dealt.repartition(n, "bucket").mapInArrow(lean(_count_sets), "chunk long, kind int, part binary")
    return answers.repartition(n, "chunk").mapInArrow(lean(_prefixes), "token long, sid binary, label binary")


# --- the join -----------------------------------------------------------------------------------------------------


def _with_labels(sets: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    labels = star_components(links, scratch).select(F.col("id").alias("sid"), F.col("component").alias("label"))
    return sets.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _parted(members: DataFrame) -> DataFrame:
    """members(key, parts, sid, ...) with own, i, j: parts i <= j of a key meet in block (i, j)."""
    out = members.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def link_sets(sets: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all sets that similarity connects. sets(sid, n, tokens, k0, k1); equal rows count once."""
    links = []
    zero = F.lit(0).cast("long")
    for key in ("k0", "k1"):
        many = scratch.save(sets.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("m")).filter("m > 1"))
        dealt = sets.select(F.col(key).alias("key"), "sid", F.col("sid").alias("label"), "tokens").join(many, "key")
        dealt = dealt.withColumns({"i": F.pmod(F.xxhash64("sid", F.lit(key)), F.ceil(F.col("m") / block)), "own": zero})
        links.append(scratch.save(_joined(dealt.withColumn("j", F.col("i")))))
    links = links[0].union(links[1])

    labelled = scratch.save(_with_labels(sets, links, scratch).select("sid", "n", "label", "tokens"))
    scratch.drop(sets)
    labelled = still_open(labelled, scratch)
    posts = scratch.save(prefixes(labelled))
    # sums of both halves of a hash, which a set that comes twice doesn't cancel
    held = [F.sum(part(F.xxhash64("sid"))).alias(c) for c, part in (("x", lambda h: F.shiftright(h, 32)), ("y", lambda h: h.bitwiseAND(F.lit(2**32 - 1))))]
    shared = posts.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m"), *held, F.min("sid").alias("p"), F.max("sid").alias("q"))
    # shingles in the prefixes of the same sets need one block
    tokens = scratch.save(shared.filter("a <> b").groupBy("m", "x", "y", "p", "q").agg(F.min("token").alias("token")).select("token", "p", "m", F.ceil(F.col("m") / block).alias("parts")))
    near = scratch.save(posts.join(tokens, "token").select("token", "parts", "sid", "p"))
    families = scratch.save(star_components(near.select(F.col("sid").alias("u"), F.col("p").alias("v")), scratch))
    of = families.select(F.col("id").alias("sid"), F.col("component").alias("fam")).union(families.select("component", "component").distinct())
    # sets connected by such shingles can be one block as well; the way that ships fewer sets is taken, family by family
    whole = of.groupBy("fam").agg(F.count("*").alias("m")).select("fam", F.ceil(F.col("m") / block).alias("fam_parts"), (F.col("m") * F.ceil(F.col("m") / block)).alias("cost"))
    apart = tokens.join(of, tokens["p"] == of["sid"]).groupBy("fam").agg(F.sum(F.col("m") * F.col("parts")).alias("token_cost"))
    way = scratch.save(whole.join(apart, "fam").select("fam", "fam_parts", (F.col("cost") <= F.col("token_cost")).alias("as_one")))
    of = scratch.save(of.join(way, "fam"))
    by_family = of.filter("as_one").select(F.col("fam").alias("key"), F.col("fam_parts").alias("parts"), "sid")
    by_token = near.join(of.filter("not as_one").select("sid"), "sid", "left_semi").select(F.col("token").alias("key"), "parts", "sid")
    rest = [scratch.save(_joined(_parted(m).join(labelled, "sid"))) for m in (by_family, by_token)]
    return links.union(rest[0]).union(rest[1])


def components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, groups: bool = False) -> DataFrame:
    """Rows (id, n_shingles, component_id) for every row of docs.

    Texts are lower-cased (A-Z) and cut into words. Two rows link when their
    shingle sets have a Jaccard similarity of 0.75 or more; component_id is the
    smallest id that links reach. Null texts and texts without words have empty
    sets and link with nothing. Rows of one id with equal sets are one class; a
    null id counts as the greatest and comes back as null. Other columns of
    docs are ignored; an empty table gives none. Ids are whole numbers; text that
    isn't one raises. With ``groups`` the rows are (_id, _key, n, group) instead:
    the id with null as 2^63 - 1, xxhash64 of the text, the size of its set and a
    name of its component, null without words; components of texts of one id stay
    apart.

    Shingles are told apart by 64-bit hashes, sets by 128-bit digests. ``buckets``
    is the number of buckets of shingles; by default it follows the bytes that
    Spark expects of docs, BUCKET_BYTES each.
    """
    spark = docs.sparkSession
    short_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(key.alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    n = buckets or buckets_for(docs.select(id_col, text_col), BUCKET_BYTES, n_partitions(spark))
    dealt = rows.mapInArrow(lean(_deal(n)), DEALT)
    answers = dealt.repartition(n, "bucket").mapInArrow(lean(_answer), "chunk long, kind int, part binary")
    per_doc = scratch.save(answers.repartition(n, "chunk").mapInArrow(lean(_sum_up), "_id long, _key long, sid binary, n long, may boolean"))

    classes = per_doc.filter("n > 0").groupBy("sid").agg(F.min("_id").alias("rep"), F.count("*").alias("m"), F.max("may").alias("may"))
    classes = scratch.save(classes.filter("m > 1 or may"))
    # few texts are wanted: Spark broadcasts their ids or filters by them where that is small, else it sorts
    wanted = classes.filter("may").select(F.col("rep").alias("_id")).distinct()
    texts = rows.join(wanted, "_id", "left_semi").select("_text")
    sets = scratch.save(texts.mapInArrow(lean(_whole), "sid binary, n long, tokens binary, k0 long, k1 long"))
    found = star_components(link_sets(sets, scratch), scratch).select(F.col("id").alias("sid"), F.col("component").alias("label"))
    reps = scratch.save(classes.select("sid", "rep", "m").join(found, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    # documents without words, and those that link with nothing, need no class
    of_class = reps.join(least, "label").filter("m > 1 or rep <> component_id").select("sid", "component_id")
    if groups:
        label = reps.select("sid", F.col("label").alias("_label"))
        return per_doc.join(label, "sid", "left").select("_id", "_key", "n", F.when(F.col("n") > 0, F.coalesce("_label", "sid")).alias("group"))
    worded = per_doc.filter("n > 0").join(of_class, "sid", "left").select("_id", "n", "component_id")
    out = worded.union(per_doc.filter("n = 0").select("_id", "n", F.lit(None).cast("long")))
    null = F.lit(2**63 - 1)
    real = lambda c: F.when(c != null, c)
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "_id")).otherwise(F.col("_id"))
    return out.select(real(F.col("_id")).cast(dict(docs.dtypes)[id_col]).alias(id_col), F.col("n").alias("n_shingles"), real(component).alias("component_id"))


def oracle() -> str:
    """The components in DuckDB SQL over `documents`."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE {DEN} * c >= {NUM} * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, m.c component_id FROM w JOIN m ON m.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""
