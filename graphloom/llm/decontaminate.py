"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to DIM numbers; their document frequencies count the passages
of the whole corpus. A word of every passage still weighs 1, so that an item
of frequent words, or one held by much of the corpus, is searched for like any
other. The latent space of a block of benchmark items is spanned by the leading
right singular vectors of TF-IDF passages: those of the items, and a bounded
sample of the corpus's, which moves words that go together closer to each
other. Distributed randomised subspace iteration (each step sums A'(AQ) over
tasks) finds RANK directions at most, of which as few are kept as hold KEEP of
the energy of every item's passage; an item that RANK directions can't hold is
searched for by its plain TF-IDF vector. Every passage of every whole document
is projected there and compared with all items by cosine (taken against the
passage's full length, so that words outside the space count against it, and in
proportion to what the space holds of the item). Candidates are verified by the
longest common subsequence of words, and, where that alone is not enough, by
finding the item's answer (its last words) next to it.

The benchmark is a stated query set, taken in blocks of about ITEMS; as many
blocks as fit into PASS_BYTES are broadcast together and searched in one pass
over the corpus, which is never joined with itself and never leaves the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import PIECES, chunks, lean, short_batches, vector_pieces, vector_sum
from graphloom.llm.wordarrays import PARTS, Words, text_buffer
from graphloom.plans.scratch import Scratch

DIM = 1 << 16
RANK, POWER_STEPS = 192, 2
#: Share of an item's energy that the latent space holds; distinct corpus passages that are fitted with the items, and their share of the energy.
KEEP, SAMPLE, CORPUS_SHARE = 0.6, 4096, 0.25
#: Words of a step of the passage window, and of a passage for counting and fitting.
STEP, PASSAGE = 16, 48
#: Items of one block of the query set.
ITEMS = 256
#: Bytes of items in latent space that one pass over the corpus broadcasts.
PASS_BYTES = 64 << 20
#: Cosine from which a passage is verified.
COSINE = 0.2
#: Share of an item's words, in order, that is a leak; with the answer nearby; words of the answer.
LEAK, LEAK_WITH_ANSWER, ANSWER = 0.7, 0.5, 6
#: An item of fewer words must be found word by word.
SHORT = 8
CHUNK = 1 << 20
SLAB = 1 << 14


def cut(col: pa.Array) -> tuple[Words, np.ndarray]:
    """Lower-cased words of texts without punctuation, and their hashed numbers."""
    words = Words.of(*text_buffer(col), lower=True, white=PARTS)
    return words, words.hashes()


def numbers(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def passage_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(passages with each number, passages) over all of texts(text)."""

    def task(batches):
        total = np.zeros(DIM + 1, np.int64)
        for batch in chunks(batches, 0, CHUNK):
            words, h = cut(batch.column(0))
            if not words.n:
                continue
            text = words.text_of_word()
            within = np.arange(words.n) - words.first[text]
            new = within % PASSAGE == 0
            key = np.sort((np.cumsum(new) - 1) * DIM + numbers(h))
            key = key[np.append(True, key[1:] != key[:-1])]
            total[:DIM] += np.bincount(key % DIM, minlength=DIM)
            total[DIM] += int(new.sum())
        yield vector_pieces(total)

    out = vector_sum(texts.mapInArrow(lean(task), PIECES), DIM + 1, np.int64)
    return out[:DIM], int(out[DIM])


def passages_of(texts: DataFrame) -> DataFrame:
    """Rows (words): the numbers of the words of each passage."""

    def task(batches):
        for batch in chunks(batches, 0, CHUNK):
            words, h = cut(batch.column(0))
            n = numbers(h).astype(np.uint16)
            rows = [n[i : min(i + PASSAGE, b)].tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()) for i in range(a, b, PASSAGE)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["words"])

    return texts.mapInArrow(task, "words binary")


def sample_of(texts: DataFrame, n: int, scratch: Scratch, size: int = SAMPLE) -> DataFrame:
    """About ``size`` different passages (words) of texts, of n in all, by a hash of their words."""
    draw = F.pmod(F.xxhash64("words", F.lit("latent")), F.lit(1 << 30))
    return scratch.save(passages_of(texts).filter(draw < min(1 << 30, int((1 << 30) * size / max(1, n)) + 1)).distinct())


def _vector(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique(n.astype(np.int64), return_counts=True)
    x = tf * idf[at]
    norm = np.sqrt(x @ x)
    return at, (x / norm if norm else x).astype(np.float32)


def singular_directions(passages: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int = RANK, seed: int = 17) -> np.ndarray:
    """len(vocabulary) x rank leading right singular vectors of passages(words, weight), the greatest first, by randomised subspace iteration over the tasks.

    Words outside the vocabulary are left out of the passages, which keep their length.
    """
    sc = passages.sparkSession.sparkContext
    place = np.full(DIM, -1, np.int64)
    place[vocabulary] = np.arange(len(vocabulary))
    size = len(vocabulary)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0].astype(np.float32)
    for _ in range(POWER_STEPS + 1):
        shared = sc.broadcast((q, idf, place))  # DIM x rank numbers at most, whatever the input

        def task(batches):
            basis, idfs, row = shared.value
            z = np.zeros((size, rank), np.float32)
            for batch in batches:
                for words, weight in zip(batch.column(0), batch.column(1).to_pylist()):
                    at, x = _vector(np.frombuffer(words.as_buffer(), np.uint16), idfs)
                    r = row[at]
                    x, r = x[r >= 0] * np.float32(weight), r[r >= 0]
                    z[r] += x[:, None] * (x @ basis[r])
            yield vector_pieces(z.ravel())

        z = vector_sum(passages.mapInArrow(task, PIECES), size * rank, np.float32).reshape(size, rank)
        last, q = q, np.linalg.qr(z)[0].astype(np.float32)
        shared.unpersist()
    # A'A within the last space, turned so that its directions are sorted
    value, turn = np.linalg.eigh(last.T @ z)
    return last @ turn[:, np.argsort(-value, kind="stable")].astype(np.float32)


def lcs(item: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence; item maps a word to the bits of its places among n."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Item:
    def __init__(self, ident: int, words: list[int]):
        self.id, self.words, self.n = ident, words, len(words)
        self.places: dict[int, int] = {}
        for i, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << i
        self.answer = words[-ANSWER:]

    def found(self, region: list[int]) -> tuple[int, bool, bool]:
        """(common words in order, answer found, leak) in a stretch of a document."""
        k = lcs(self.places, self.n, region)
        if self.n < SHORT:
            return k, k == self.n, k == self.n and holds(region, self.words)
        if k < LEAK_WITH_ANSWER * self.n:
            return k, False, False
        answer = holds(region, self.answer)
        return k, answer, k >= LEAK * self.n or answer


def holds(words: list[int], part: list[int]) -> bool:
    m = len(part)
    return any(words[i] == part[0] and words[i : i + m] == part for i in range(len(words) - m + 1))


def item_passages(n: int) -> list[tuple[int, int]]:
    """Stretches of an item of n words that are compared; the whole item if it is short."""
    if n <= PASSAGE + STEP:
        return [(0, n)]
    return [(a, min(n, a + PASSAGE)) for a in range(0, n - STEP, STEP * 2)]


class Index:
    """The items of a block in latent space, as each word's share in each of their cosines."""

    def __init__(self, items: list[Item], idf: np.ndarray, vocabulary: np.ndarray, basis: np.ndarray, latent: bool = True, keep: float = KEEP):
        place = np.zeros(DIM, np.int64)
        place[vocabulary] = np.arange(len(vocabulary))
        rows = [(k, a, b) for k, item in enumerate(items) for a, b in item_passages(item.n)]
        plain = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (k, a, b) in enumerate(rows):
            at, x = _vector(numbers(np.array(items[k].words[a:b], np.uint64)), idf)
            plain[i, place[at]] = x
        vectors = plain @ basis
        held = np.cumsum(vectors * vectors, axis=1)
        # the fewest directions that hold enough of every passage that all of them can hold
        can = held[:, -1] >= keep if len(rows) else np.zeros(0, bool)
        self.rank = int((held[can] < keep).sum(1).max(initial=0)) + 1
        basis, vectors = basis[:, : self.rank], vectors[:, : self.rank]
        length = np.sqrt((vectors * vectors).sum(1))
        here = can & latent & (length > 0)
        self.items, self.owner, self.latent, self.square = items, np.array([k for k, _, _ in rows], np.int64), here, (idf * idf).astype(np.float64)
        # (words x rank) (rank x passages): the same product, folded once, over the length that the space holds of each
        turned = (vectors / np.where(here, length * length, 1)[:, None]) @ basis.T
        self.share = (np.where(here[:, None], turned, plain) * idf[vocabulary]).T.astype(np.float32)
        self.row = np.full(DIM, -1, np.int32)
        self.row[vocabulary] = np.where(idf[vocabulary] > 0, np.arange(len(vocabulary)), -1)

    def bytes(self) -> int:
        return self.share.nbytes + 12 * DIM + sum(64 * x.n for x in self.items)


def near_windows(words: Words, h: np.ndarray, ix: Index, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all steps, step, item) of the windows of one to three steps that are candidates."""
    text = words.text_of_word()
    begins = (np.arange(words.n) - words.first[text]) % STEP == 0
    steps = np.flatnonzero(begins)
    # each word once a step
    key = np.sort((np.cumsum(begins) - 1) * DIM + numbers(h))
    key = key[np.append(True, key[1:] != key[:-1])]
    step, num = key // DIM, key % DIM
    n = len(steps)
    energy = np.bincount(step, weights=ix.square[num], minlength=n + 2)
    row = ix.row[num]
    step, row = step[row >= 0], row[row >= 0]
    doc = np.append(text[steps], [-1, -1])
    two, three = doc[1:-1] == doc[:-2], doc[2:] == doc[:-2]
    e2 = energy[:n] + two * energy[1 : n + 1]
    e3 = e2 + three * energy[2 : n + 2]
    scale = [cosine * np.sqrt(np.maximum(e, 1e-9)).astype(np.float32)[:, None] for e in (energy[:n], e2, e3)]
    found = []
    slab = max(64, SLAB // STEP)
    for i in range(0, n, slab):
        j = min(n, i + slab)
        lo, hi = np.searchsorted(step, [i, j + 2])
        if lo == hi:
            continue
        sums = np.zeros((j - i + 2, ix.share.shape[1]), np.float32)
        own = step[lo:hi]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sums[own[head] - i] = np.add.reduceat(ix.share[row[lo:hi]], head, axis=0)
        w = sums[: j - i]
        near = w >= scale[0][i:j]
        w = w + two[i:j, None] * sums[1:-1]
        near |= w >= scale[1][i:j]
        w += three[i:j, None] * sums[2:]
        near |= w >= scale[2][i:j]
        at, q = np.nonzero(near)
        found.append((at + i, ix.owner[q]))
    at, k = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return steps, at, k


def verified(words: Words, h: np.ndarray, ix: Index, cosine: float) -> list[tuple]:
    """(text, item, common words, answer found) of the candidates that are leaks."""
    steps, at, which = near_windows(words, h, ix, cosine)
    doc = words.text_of_word()[steps[at]]
    pairs: dict[tuple[int, int], list[int]] = {}
    for d, k, a in zip(doc.tolist(), which.tolist(), at.tolist()):
        pairs.setdefault((d, k), []).append(a)
    found = []
    for (d, k), places in pairs.items():
        item = ix.items[k]
        begin, end = int(words.first[d]), int(words.first[d + 1])
        reach = item.n + STEP
        stretch = None
        for a in [*sorted(set(places)), None]:  # near windows are looked at as one stretch
            lo, hi = (max(begin, int(steps[a]) - reach), min(end, int(steps[a]) + PASSAGE + reach)) if a is not None else (0, 0)
            if stretch and a is not None and lo <= stretch[1] and hi - stretch[0] <= 8 * (PASSAGE + reach):
                stretch = (stretch[0], hi)
                continue
            if stretch:
                common, answer, leak = item.found(h[stretch[0] : stretch[1]].tolist())
                if leak:
                    found.append((d, item, common, answer))
            stretch = (lo, hi)
    return found


def search(docs: DataFrame, indexes: list[Index], id_type, cosine: float = COSINE) -> DataFrame:
    """Rows (id, item_id, n_item_words, lcs, answer) of leaks of items in docs(id, text), possibly several a pair."""
    shared = docs.sparkSession.sparkContext.broadcast(indexes)  # PASS_BYTES, or one block
    kind = to_arrow_type(id_type)

    def task(batches):
        for batch in chunks(batches, 1, CHUNK):
            words, h = cut(batch.column(1))
            found = []
            if words.n:
                for ix in shared.value:
                    if len(ix.owner):
                        found += verified(words, h, ix, cosine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1].id for f in found], kind), pa.array([f[1].n for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.bool_())],
                names=["_id", "item_id", "n_item_words", "lcs", "answer"],
            )

    return docs.mapInArrow(lean(task), f"_id {docs.dtypes[0][1]}, item_id {id_type.simpleString()}, n_item_words long, lcs long, answer boolean")


def block_index(some: DataFrame, sample: DataFrame, idf: np.ndarray, scratch: Scratch) -> Index | None:
    """The index of a block of items some(item_id, text); None if none has a word."""
    items = []
    for r in some.collect():  # a block of the query set
        words, h = cut(pa.array([r["text"]]))
        if words.n:
            items.append(Item(r["item_id"], h.tolist()))
    if not items:
        return None
    items.sort(key=lambda x: (x.id is None, str(x.id), x.words))
    vocabulary = np.unique(numbers(np.array([w for x in items for w in x.words], np.uint64)))
    own, far = passages_of(some.select("text")).withColumn("weight", F.lit(1.0)), sample.count()
    # the corpus's passages together weigh CORPUS_SHARE of the items'
    weight = float(np.sqrt(CORPUS_SHARE * sum(-(-x.n // PASSAGE) for x in items) / max(1, far)))
    fit = scratch.save(own.union(sample.withColumn("weight", F.lit(weight))))
    return Index(items, idf, vocabulary, singular_directions(fit, idf, vocabulary, min(RANK, len(vocabulary))))


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, item_id, n_item_words, lcs, answer), one for each document and benchmark item that it holds.

    Null and empty texts hold nothing; items without words are found nowhere;
    long texts count whole. Repeated rows give one row for each pair of ids; a
    null id counts as one, of a document as of an item. Item ids keep their
    type. Of several ways to hold an item the one with most common words is
    told. Items of one id are looked for one by one. Empty tables give no rows;
    other columns are ignored.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    df, n = passage_frequency(rows.select("_text"))
    idf = (1 + np.log((1 + n) / (1 + df))).astype(np.float32)
    sample = sample_of(rows.select("_text"), n, scratch)
    texts = scratch.save(benchmark.select("item_id", "text").filter("text is not null").distinct())
    blocks = max(1, -(-texts.count() // ITEMS))
    found, some, size = None, [], 0
    for b in range(blocks):
        block = block_index(texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), sample, idf, scratch)
        if block:
            some.append(block)
            size += block.bytes()
        if size >= PASS_BYTES or b == blocks - 1:
            got = search(rows, some, benchmark.schema["item_id"].dataType)
            found, some, size = got if found is None else found.union(got), [], 0
    best = found.groupBy("_id", "item_id").agg(F.max(F.struct("lcs", "answer", "n_item_words")).alias("x"))
    return best.select(F.col("_id").alias(id_col), "item_id", "x.n_item_words", "x.lcs", "x.answer")
