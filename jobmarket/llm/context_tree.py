"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased (A-Z) words, each closed by a space, and one end mark. A byte is eight binary decisions;
each decision has its own tree of contexts. The context of a byte is the DEPTH bytes before it in this stream, across words
and spaces; before the text all bytes are zero. Every node holds zero and one counts of the training texts, its Krichevsky-Trofimov
estimate, and the weighted probability of its subtree (half its own estimate, half the product of its children). A decision's
probability mixes the estimates of all depths with the weights the tree gives them, down to the
deepest context that training has met; the code length of a text is the sum over its bytes.

All of it is counted in Spark over the whole corpus. Consecutive documents of a task form chunks of CHUNK_BYTES; a chunk counts its
distinct words and (context, byte) keys and deals them, as packed sorted runs, into buckets: words by a hash, keys by a hash of the three
nearest bytes of context, so a bucket holds whole subtrees from depth three on. A bucket adds up its keys and its subtrees' weighted
probabilities; nodes of depth two and above (one for each of at most 65,536 byte pairs and 255 decisions) are summed over all buckets and
reach the driver and every task. Then each bucket answers every chunk in the order of its run, and a chunk scores its texts. Nothing that
grows with the vocabulary is broadcast or collected.

A chunk deals to MOST_BUCKETS at most. Where more buckets are needed, the runs that as many chunks dealt to one of them are merged, and the merged run is dealt on, level
by level; answers come back the same way. So each level has a number of runs in proportion to the chunks, and the levels are the logarithm of the chunks to the
base of the buckets. Every answer bears a checksum of what was asked.

Null texts are empty: one end mark. Null ids count as the empty text in the training split. Repeated rows
score alike and train twice; without training texts every decision has probability one half. An empty table gives no rows.
Other columns of the documents are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import written

DEPTH = 6  # bytes of context
CHUNK_BYTES = 16 << 20  # of texts; a chunk ends after the document that fills it
BYTES_AT_ONCE = 1 << 20  # of texts, turned into keys together
HELD_KEYS = 1 << 22  # of a chunk or bucket, before equal ones are added up
MOST_BUCKETS = 256  # that a chunk, or a group of chunks, deals to
END = b"\n"  # no word holds it
LOG10 = float(np.log(10))


# --- the stream of a text, its keys and its words ----------------------------------------------------

def _words(text: str | bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z and the six white-space bytes."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()


def _stream(text: bytes | None) -> bytes:
    return b" ".join([*_words(text), END])


class Block:
    """Streams of some texts one after the other, DEPTH zero bytes before each."""

    def __init__(self, texts: list[bytes | None]):
        streams = [_stream(t) for t in texts]
        lengths = np.array([len(s) for s in streams], np.int64)
        self.data = b"\0" + b"".join([b"\0" * DEPTH + s for s in streams])
        #: where each text's bytes start among the keys, and the end
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.ends = np.cumsum(lengths + DEPTH)  # in data, after the byte that it begins with

    def keys(self) -> np.ndarray:
        """For every byte of the texts: context and byte as one 64-bit key, the byte lowest, the nearest byte of context highest."""
        n = len(self.data) - DEPTH - 1
        eight = np.ndarray((max(n, 0),), "<u8", self.data, 0, (1,))
        keys = (eight & np.uint64(0x00FFFFFFFFFFFF00)) | (eight >> np.uint64(56))
        text = np.ones(len(keys), bool)
        text[(self.ends[:-1, None] + np.arange(-DEPTH, 0)).ravel()] = False
        return keys[text].view(np.int64)

    def words(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every word: two 64-bit hashes, where it starts and ends in data; and where each text's words start (and the end)."""
        data = np.frombuffer(self.data, np.uint8)
        stops = np.flatnonzero((data == 32) | (data == END[0]))
        starts = np.concatenate([[0], stops[:-1]]) + 1
        closed = data[stops] == 32
        first = np.concatenate([[True], ~closed[:-1]])[: len(stops)]
        starts = (starts + DEPTH * first)[closed]
        stops = stops[closed]
        texts = np.concatenate([[0], np.searchsorted(stops, self.ends)])
        if not len(stops):
            return np.empty(0, np.int64), np.empty(0, np.int64), starts, stops, texts
        place = np.arange(len(data), dtype=np.int64)[starts[0]:]
        at = place - np.repeat(starts, np.diff(np.append(starts, len(data))))
        rng = np.random.default_rng([17, seed])
        tables, longest = rng.integers(0, 2**63, (2, 256), np.uint64), int((stops - starts).max())
        out = []
        for table, base in zip(tables * np.uint64(2) + np.uint64(1), (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
            power = np.multiply.accumulate(np.full(longest + 1, np.uint64(base)))
            each = table[data[starts[0]:]] * power[np.minimum(at, longest)]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(each)])
            h = (sums[stops - starts[0]] - sums[starts - starts[0]]) ^ (stops - starts).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((h ^ (h >> np.uint64(29))).view(np.int64))
        return out[0], out[1], starts, stops, texts


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[int, Block]]:
    """Where a block of texts starts, and the block; it ends after BYTES_AT_ONCE bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"") + DEPTH
        if size >= BYTES_AT_ONCE or i == len(texts) - 1:
            yield first, Block(texts[first:i + 1])
            first, size = i + 1, 0


def _counted(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each; parts are best given sorted."""
    k, c = (np.concatenate(x) if len(x) > 1 else x[0] for x in (keys, n))
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Counts:
    """Keys met so far, distinct and in order, with their counts; new ones are held until there are HELD_KEYS."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= HELD_KEYS:
            self.settle()

    def settle(self) -> None:
        if self.held:
            k = np.concatenate(self.held)
            self.held, self.size = [], 0
            k.sort()
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
            self.keys, self.n = _counted([self.keys, k[first]], [self.n, np.diff(np.append(first, len(k)))])


def _first_of(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places of one word of each hash, in the order of the hashes; None if two words share a hash."""
    order = np.argsort(h, kind="stable")
    h, other = h[order], other[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    return None if (~new[1:] & (other[1:] != other[:-1])).any() else order[new]


def _word_numbers(blocks: list[Block]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    """Of each block its words' hashes; the distinct hashes in order, each one's hash of seed 0, and its bytes.

    Two hashes make 128 bits that are compared; if two words of the chunk share the first 64, another seed is taken.
    """
    for seed in range(100):
        found = [b.words(seed) for b in blocks]
        own = []
        for b, (h, other, starts, stops, _) in zip(blocks, found):
            at = _first_of(h, other)
            if at is None:
                break
            own.append((h[at], other[at], [b.data[s:e] for s, e in zip(starts[at].tolist(), stops[at].tolist())]))
        else:
            h, other = (np.concatenate([o[i] for o in own] or [np.empty(0, np.int64)]) for i in (0, 1))
            at = _first_of(h, other)
            if at is not None:
                words = [w for o in own for w in o[2]]
                plain = h if not seed else np.concatenate([b.words()[0][_first_of(f[0], f[1])] for b, f in zip(blocks, found)])
                return [f[0] for f in found], h[at], plain[at], [words[i] for i in at.tolist()]
    raise RuntimeError("no seed tells the words apart")


def _pack(numbers: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers as bytes, of a rising run the differences; equal bytes of all numbers lie together."""
    steps = np.diff(numbers, prepend=0) if rising else numbers
    return zstandard.compress(np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes, rising: bool = False) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(steps) if rising else steps


def _deal(numbers: np.ndarray, buckets: int, over: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts the numbers' buckets one after the other, and where each bucket starts in it (and the end). over: the buckets of all levels before."""
    bucket = ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) // over % buckets
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _chunk_numbers(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Each batch with its rows' chunk numbers: the task's partition, and how many chunks its earlier documents have filled.

    A row's chunk depends on the rows before it in its split of the files, so a second scan gives the same one.
    """
    pid, size = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()) if batch.num_rows else None
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]) + DEPTH if batch.num_rows else np.empty(0, np.int64)
        ends = size + np.cumsum(lengths)
        yield (pid << 24) + (ends - lengths) // chunk_bytes, batch
        size = int(ends[-1]) if len(ends) else size


# --- the trees ---------------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments up by eight."""
    small = x < 8
    y = np.where(small, x + 8, x)
    shift = np.ones_like(x)
    for i in range(8):
        shift = np.where(small, shift * (x + i), shift)
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return s - np.log(shift)


_SMALL = 1 << 15
_HALF, _WHOLE = _log_gamma(np.arange(_SMALL) + 0.5), _log_gamma(np.arange(_SMALL) + 1.0)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of some zeros and ones."""
    total = zeros + ones
    low = np.minimum(total, _SMALL - 1)
    out = _HALF[np.minimum(zeros, low)] + _HALF[np.minimum(ones, low)] - _WHOLE[low] - np.log(np.pi)
    large = np.flatnonzero(total >= _SMALL)
    if len(large):
        z, o = zeros[large].astype(np.float64), ones[large].astype(np.float64)
        out[large] = _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - _log_gamma(z + o + 1.0) - np.log(np.pi)
    return out


def _join(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight of their own estimates."""
    weighted = np.log(0.5) + np.logaddexp(kt, children)
    return weighted, np.exp(np.log(0.5) + kt - weighted)


class Subtrees:
    """Nodes of depths DEPTH to 3 over distinct keys in order; all keys of a three-byte context must be here.

    At each depth the distinct (context, byte) pairs are elements; a decision's nodes are runs of them.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.elements, self.n, self.above = {DEPTH: keys}, {DEPTH: n}, {}
        for d in range(DEPTH, 3, -1):
            e = self.elements[d]
            self.elements[d - 1], self.above[d] = np.unique((e >> 16 << 8) | (e & 255), return_inverse=True)
            self.n[d - 1] = np.bincount(self.above[d], weights=self.n[d], minlength=len(self.elements[d - 1])).astype(np.int64)

    def decision(self, i: int) -> dict[int, tuple]:
        """For the i-th bit, by depth: first element and place of each element's node, counts, weighted probability, own weight."""
        out, child = {}, None
        for d in range(DEPTH, 2, -1):
            e = self.elements[d]
            prefix = e >> (8 - i)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first, where = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.add.reduceat(self.n[d], first)
            ones = np.add.reduceat(self.n[d] * (e >> (7 - i) & 1), first)
            weighted = kt = _log_kt(total - ones, ones)
            own = None
            if child is not None:
                below = np.bincount(where[self.above[d + 1][child[0]]], weights=child[4], minlength=len(first))
                weighted, own = _join(kt, below)
            child = out[d] = (first, where, total, ones, weighted, own)
        return out

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Depth-two nodes (two bytes of context, tree number), and what the subtrees here add to them: weighted, zeros, ones."""
        found = []
        for i in range(8):
            first, _, total, ones, weighted, _ = self.decision(i)[3]
            e = self.elements[3][first]
            found.append((e >> 16 << 8 | 1 << i | (e & 255) >> (8 - i), weighted, total - ones, ones))
        node, weighted, zeros, ones = map(np.concatenate, zip(*found))
        nodes, at = np.unique(node, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(nodes))
        return nodes, add(weighted), add(zeros).astype(np.int64), add(ones).astype(np.int64)

    def log10_probabilities(self, top: Top) -> np.ndarray:
        """Of every key, its byte after its context."""
        out = np.zeros(len(self.elements[DEPTH]))
        for i in range(8):
            levels = self.decision(i)
            e = self.elements[3]
            p, rest, kt = top.mix(e >> 16, 1 << i | (e & 255) >> (8 - i), e >> (7 - i) & 1)
            for d in range(3, DEPTH + 1):
                _, where, total, ones, _, own = levels[d]
                bit = self.elements[d] >> (7 - i) & 1
                if d > 3:
                    p, rest, kt = p[self.above[d]], rest[self.above[d]], kt[self.above[d]]
                p, rest, kt = _step(p, rest, kt, bit, (total - ones)[where], ones[where], 1.0 if own is None else own[where])
            out += np.log(p + rest * kt)
        return out / LOG10


def _step(p: np.ndarray, rest: np.ndarray, kt: np.ndarray, bit: np.ndarray, zeros: np.ndarray, ones: np.ndarray, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One depth down: probability so far, weight that is left, and the estimate that gets it if nothing deeper was met."""
    total = zeros + ones
    mine = (np.where(bit == 1, ones, zeros) + 0.5) / (total + 1.0)
    seen = total > 0
    return p + rest * np.where(seen, own * mine, kt), np.where(seen, rest * (1 - own), 0.0), np.where(seen, mine, kt)


class Top:
    """Nodes of depths two, one and zero, from the sums of all buckets."""

    def __init__(self, node: np.ndarray, weighted: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        order = np.argsort(node)
        self.node, self.zeros, self.ones = node[order], zeros[order], ones[order]
        w, self.own = _join(_log_kt(self.zeros, self.ones), weighted[order])
        last, tree = self.node >> 16, self.node & 255
        self.one = [np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)]
        below = np.zeros((256, 256))
        np.add.at(self.one[0], (last, tree), self.zeros)
        np.add.at(self.one[1], (last, tree), self.ones)
        np.add.at(below, (last, tree), w)
        w, own = _join(_log_kt(self.one[0].ravel(), self.one[1].ravel()), below.ravel())
        self.one.append(own.reshape(256, 256))
        self.zero = [self.one[0].sum(axis=0), self.one[1].sum(axis=0)]
        self.zero.append(_join(_log_kt(*self.zero), w.reshape(256, 256).sum(axis=0))[1])

    def mix(self, pair: np.ndarray, tree: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixture down to depth two; pair: the two nearest bytes of context."""
        near = pair >> 8
        zeros, ones, own = (x[tree] for x in self.zero)
        kt = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        state = own * kt, 1 - own, kt
        state = _step(*state, bit, *(x[near, tree] for x in self.one))
        at = np.searchsorted(self.node, pair << 8 | tree)
        return _step(*state, bit, self.zeros[at], self.ones[at], self.own[at])


def log10_probabilities(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of the model at once over distinct keys in order and their training counts."""
    trees = Subtrees(keys, n)
    return trees.log10_probabilities(Top(*trees.roots()))


# --- the jobs ----------------------------------------------------------------------------------------

def _counts_of_chunks(rows: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """chunk, bucket, keys, n, words, n_words, uses: what each chunk asks each bucket, and its training counts."""
    names = ["chunk", "bucket", "keys", "n", "words", "n_words", "uses"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def deal(chunk: int, texts: dict[bool, list[bytes | None]]) -> pa.RecordBatch:
        counts, blocks, learn = {}, [], []
        for train in (True, False):
            counts[train] = Counts()
            for _, block in _blocks(texts[train]):
                counts[train].add(block.keys())
                blocks.append(block)
                learn.append(train)
            counts[train].settle()
        keys, n = _counted([counts[True].keys, counts[False].keys], [counts[True].n, np.zeros(len(counts[False].keys), np.int64)])
        hashes, h, plain, words = _word_numbers(blocks)
        uses = np.zeros(len(h), np.int64)
        for train, each in zip(learn, hashes):
            if train and len(each):
                u, c = np.unique(each, return_counts=True)
                uses[np.searchsorted(h, u)] += c
        (key_order, key_at), (word_order, word_at) = _deal(keys >> 32, buckets), _deal(plain, buckets)
        out = []
        for b in range(buckets):
            k, w = key_order[key_at[b]:key_at[b + 1]], word_order[word_at[b]:word_at[b + 1]]
            if len(k) or len(w):
                out.append((chunk, b, _pack(keys[k], True), _pack(n[k]), zstandard.compress(b" ".join([words[i] for i in w]), 1), len(w), _pack(uses[w])))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts = None, {True: [], False: []}
        for numbers, batch in _chunk_numbers(batches, chunk_bytes):
            whole, train = batch.column("text").cast(pa.binary()), batch.column("train").to_pylist()
            for c in np.unique(numbers):
                if chunk is not None and c != chunk:
                    yield deal(chunk, texts)
                    texts = {True: [], False: []}
                chunk = int(c)
                for i in np.flatnonzero(numbers == c).tolist():
                    texts[train[i]].append(whole[i].as_py())
        if chunk is not None:
            yield deal(chunk, texts)

    return rows.mapInArrow(count, "chunk long, bucket long, keys binary, n binary, words binary, n_words long, uses binary")


RUN = "chunk long, bucket long, keys binary, n binary, words binary, n_words long, uses binary"
ANSWER = "chunk long, bucket long, logp binary, uses binary, total long, distinct long, check long"


def _levels(chunks: int) -> tuple[int, int]:
    """Buckets that each level deals to, and levels, for some two buckets a chunk."""
    wanted, levels = max(61, 2 * chunks + 1), 1
    while MOST_BUCKETS**levels < wanted:
        levels += 1
    fan = round(wanted ** (1 / levels))
    return fan + (fan**levels < wanted), levels


def _checked(keys: np.ndarray, n_words: int) -> int:
    return zlib.crc32(b"%d" % n_words, zlib.crc32(np.ascontiguousarray(keys)))


def _split_words(words: bytes, n: int) -> list[bytes]:
    return zstandard.decompress(words).split(b" ") if n else []


class Merged:
    """Runs of several chunks as one: distinct keys in order, words in order, their counts, and how they are dealt on."""

    def __init__(self, runs: pd.DataFrame, fan: int, over: int):
        self.keys, self.n, held, more = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for k, c in zip(runs["keys"], runs["n"]):
            held.append((_unpack(k, True), _unpack(c)))
            more += len(held[-1][0])
            if more > HELD_KEYS:
                self._add(held)
                held, more = [], 0
        self._add(held)
        uses: Counter = Counter()
        for words, size, n in zip(runs["words"], runs["n_words"], runs["uses"]):
            uses.update(dict(zip(_split_words(words, size), _unpack(n).tolist())))
        self.words = sorted(uses)
        self.uses = np.array([uses[w] for w in self.words], np.int64)
        self.key_order, self.key_at = _deal(self.keys >> 32, fan, over)
        self.word_order, self.word_at = _deal(np.array([xxhash.xxh64_intdigest(w) >> 1 for w in self.words], np.int64), fan)

    def _add(self, held: list) -> None:
        self.keys, self.n = _counted([self.keys, *[k for k, _ in held]], [self.n, *[c for _, c in held]])

    def part(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys and words that go to bucket b."""
        return self.key_order[self.key_at[b]:self.key_at[b + 1]], self.word_order[self.word_at[b]:self.word_at[b + 1]]


def _dealt_on(asked: DataFrame, groups: int, fan: int, level: int) -> DataFrame:
    """Runs of the next level: those of some chunks to one bucket are merged and dealt on to `fan` buckets."""

    def merge(runs: pd.DataFrame) -> pd.DataFrame:
        m, out = Merged(runs, fan, fan**level), []
        for b in range(fan):
            k, w = m.part(b)
            if len(k) or len(w):
                out.append((runs["up"].iloc[0], runs["bucket"].iloc[0] * fan + b, _pack(m.keys[k], True), _pack(m.n[k]), zstandard.compress(b" ".join([m.words[i] for i in w]), 1), len(w), _pack(m.uses[w])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")])

    return written(asked.withColumn("up", _group(groups)).groupBy("up", "bucket").applyInPandas(merge, RUN), "asked")


def _group(groups: int) -> F.Column:
    return F.pmod(F.xxhash64("chunk"), F.lit(groups))


def _answered(asked: DataFrame, answers: DataFrame, groups: int, fan: int, level: int) -> DataFrame:
    """Answers to the runs of a level, from those to the merged runs of the next one."""

    def split(runs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        m, by = Merged(runs, fan, fan**level), {int(b) % fan: i for i, b in enumerate(found["bucket"])}
        logp, uses = np.empty(len(m.keys), np.float32), np.empty(len(m.words), np.int64)
        for b in range(fan):
            k, w = m.part(b)
            if len(k) or len(w):
                row = found.iloc[by[b]]
                if row["check"] != _checked(m.keys[k], len(w)):
                    raise RuntimeError("an answer belongs to another run")
                logp[k], uses[w] = np.frombuffer(row["logp"], np.float32), _unpack(row["uses"])
        number, out = {w: i for i, w in enumerate(m.words)}, []
        for chunk, bucket, keys, words, size in zip(runs["chunk"], runs["bucket"], runs["keys"], runs["words"], runs["n_words"]):
            k, w = _unpack(keys, True), _split_words(words, size)
            mine = uses[np.array([number[x] for x in w], np.int64)]
            out.append((chunk, bucket, logp[np.searchsorted(m.keys, k)].tobytes(), _pack(mine), 0, 0, _checked(k, size)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    left = asked.withColumn("up", _group(groups)).groupBy("up", "bucket")
    right = answers.withColumns({"up": F.col("chunk"), "parent": F.floor(F.col("bucket") / fan)}).groupBy("up", "parent")
    return written(left.cogroup(right).applyInPandas(split, ANSWER), "answers")


def stream_scores(docs: DataFrame, train: F.Column, plain_scan: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs: doc_id, text; train: which rows the counts are taken from.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (unigram), score (context trees).
    plain_scan: docs is read from files without a shuffle, so that a row is in the same chunk whenever it is read; other
    inputs are written first. (A row that had moved would miss a key in its chunk and fail the job.)
    Key probabilities travel as 32-bit floats.
    """
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    if not plain_scan:
        rows = written(rows, "lm-documents")
    size, learnt = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    buckets, levels = _levels(size // chunk_bytes)
    groups = [max(1, -(-(size // chunk_bytes + 1) // buckets ** (k + 1))) for k in range(levels - 1)]
    dealt = [written(_counts_of_chunks(rows, buckets, chunk_bytes), "asked")]
    for k, n in enumerate(groups):
        dealt.append(_dealt_on(dealt[-1], n, buckets, k + 1))
    asked = dealt[-1]

    def add(found: pd.DataFrame) -> pd.DataFrame:
        keys, n, held, more = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for k, c in zip(found["keys"], found["n"]):
            held.append((_unpack(k, True), _unpack(c)))
            more += len(held[-1][0])
            if more > HELD_KEYS:
                keys, n = _counted([keys, *[k for k, _ in held]], [n, *[c for _, c in held]])
                held, more = [], 0
        keys, n = _counted([keys, *[k for k, _ in held]], [n, *[c for _, c in held]])
        parts = Subtrees(keys, n).roots() if len(keys) else [np.empty(0)] * 4
        return pd.DataFrame([(found["bucket"].iloc[0], _pack(keys, True), _pack(n), *[p.tobytes() for p in parts])], columns=["bucket", "keys", "n", "node", "weighted", "zeros", "ones"])

    summed = asked.select("bucket", "keys", "n").groupBy("bucket").applyInPandas(add, "bucket long, keys binary, n binary, node binary, weighted binary, zeros binary, ones binary")
    summed = written(summed, "subtrees")

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({c: np.frombuffer(getattr(row, c), np.float64 if c == "weighted" else np.int64) for c in ("node", "weighted", "zeros", "ones")})

    high = summed.select("node", "weighted", "zeros", "ones").mapInPandas(nodes, "node long, weighted double, zeros long, ones long")
    high = high.groupBy("node").agg(F.sum("weighted").alias("weighted"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    high = high.toPandas()  # at most one row for each pair of bytes and decision
    top = docs.sparkSession.sparkContext.broadcast(Top(*(high[c].to_numpy(np.float64 if c == "weighted" else np.int64) for c in ("node", "weighted", "zeros", "ones"))))

    def answer(found: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        known, logp = np.empty(0, np.int64), np.empty(0, np.float32)
        if len(sums) and len(n := _unpack(sums["n"].iloc[0])):
            known = _unpack(sums["keys"].iloc[0], True)
            logp = Subtrees(known, n).log10_probabilities(top.value).astype(np.float32)
        uses: Counter = Counter()
        for words, size, n in zip(found["words"], found["n_words"], found["uses"]):
            if size:
                for w, c in zip(zstandard.decompress(words).split(b" "), _unpack(n).tolist()):
                    uses[w] += c
        total, distinct = sum(uses.values()), sum(c > 0 for c in uses.values())
        out = []
        for chunk, bucket, keys, words, size in zip(found["chunk"], found["bucket"], found["keys"], found["words"], found["n_words"]):
            k = _unpack(keys, True)
            at = np.searchsorted(known, k)
            if len(k) and (known[at] != k).any():
                raise RuntimeError("a bucket misses a key of its own runs")
            each = list(map(uses.__getitem__, _split_words(words, size)))
            out.append((chunk, bucket, logp[at].tobytes(), _pack(np.array(each, np.int64)), total, distinct, _checked(k, size)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    packed = asked.select("chunk", "bucket", "keys", "words", "n_words", "uses").groupBy("bucket").cogroup(summed.select("bucket", "keys", "n").groupBy("bucket"))
    answers = written(packed.applyInPandas(answer, ANSWER), "answers")
    each = answers.groupBy("bucket").agg(F.max("total").alias("t"), F.max("distinct").alias("d"))
    total, distinct = each.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0))).first()
    total, distinct = total + learnt, distinct + (learnt > 0)  # the end marks
    for k in reversed(range(levels - 1)):
        answers = _answered(dealt[k], answers, groups[k], buckets, k + 1)
    log_base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, batch in _chunk_numbers(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["doc_id", "text", "train", "chunk"])

    def score(part: pa.Table, table: pa.Table) -> pa.Table:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        counts, blocks = Counts(), list(_blocks(texts))
        for _, block in blocks:
            counts.add(block.keys())
        counts.settle()
        order = np.argsort(table.column("bucket").to_numpy())
        column = lambda c: [table.column(c)[int(i)].as_py() for i in order]
        hashes, names, plain, _ = _word_numbers([b for _, b in blocks])
        (key_order, key_at), (word_order, word_at) = _deal(counts.keys >> 32, buckets), _deal(plain, buckets)
        for b, check in zip(column("bucket"), column("check")):
            if check != _checked(counts.keys[key_order[key_at[b]:key_at[b + 1]]], word_at[b + 1] - word_at[b]):
                raise RuntimeError("an answer belongs to another run")
        logp, c = np.empty(len(counts.keys)), np.empty(len(names), np.int64)
        logp[key_order] = np.frombuffer(b"".join(column("logp")), np.float32)
        c[word_order] = np.concatenate([np.empty(0, np.int64), *map(_unpack, column("uses"))])
        base, keys, words = log_base(c), pd.Index(counts.keys), pd.Index(names)
        out: list[list] = [[], [], [], []]
        for (_, block), h in zip(blocks, hashes):
            at, w = block.starts, block.words()[4]
            sums = np.concatenate([[0.0], np.cumsum(logp[keys.get_indexer(block.keys())])])
            word = words.get_indexer(h)
            known, bases = (np.concatenate([[0], np.cumsum(x)]) for x in (c[word] > 0, base[word]))
            out[0].append(np.diff(w) + 1)
            out[1].append(np.diff(known[w]) + (learnt > 0))
            out[2].append(np.diff(bases[w]) + log_base(learnt))
            out[3].append(np.diff(sums[at]))
        columns = [np.concatenate(o) for o in out]
        columns.insert(2, np.full(len(texts), total, np.int64))
        return pa.table([part.column("doc_id"), part.column("train"), *columns], ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(number, "doc_id long, text string, train boolean, chunk long")
    answers = answers.select("chunk", "bucket", "logp", "uses", "check")
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
