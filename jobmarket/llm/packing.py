"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenised once; only those longer than a sequence are cut, into full pieces with the
shorter remainder first. Full pieces are sequences of their own. The others are dealt by hash into
blocks of some thousand pieces. Several islands evolve each block: a chromosome is a list of bins,
crossover injects whole well-filled bins of one parent into the other, removes the bins that would
hold a piece twice, and best-fits the displaced pieces. Between rounds every island hands its elite to
the next island of its block. The bins that stay badly filled are pooled over neighbouring blocks and
evolved again, so the loss does not grow with the number of blocks.

Only piece numbers and lengths travel; token ids never leave the task that made them.
Null texts are empty documents: one end token. Nothing is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import file_rows, free_name, written

END_ID = 2
#: Unicode White_Space, as the tokenizer's own pattern counts it.
WS = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
UNIT = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
EDGE = re.compile(f"[{WS}]")
CACHE_LIMIT = 600_000  # entries of a task's cache (about 120 MB); it is emptied when full

#: Punctuation that may follow a word (no apostrophe): a piece of its own for the tokenizer, whatever comes next.
AFTER = '.,;:!?)]}"#$%&*+-/<=>@^_|~([{'


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes take the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class Joined(Exception):
    """A part that may belong to a longer run of white space."""


class Parts(dict):
    """Ids of what stands between two spaces, with the space before it; an unseen part is encoded when it is asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHE_LIMIT:
            self.clear()
        self[part] = ids = self.encode(part)
        return ids


class UnitEncoder:
    """Token ids of whole texts, one tokenizer call per unseen word.

    The tokenizer never merges across a unit (an optional single space and what follows it up to
    the next white space, or a run of white space), so the ids of a text are those of its units in
    order. Inside a unit a word of letters and the punctuation after it are separate pieces too: the
    tokenizer's merges are asked for the word alone. Added tokens of the vocabulary (an end mark, say) that a text
    spells out are found first, as the tokenizer does, and cut the text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.spaced = Parts(self._between)
        self.units: dict[str, bytes] = {}  # anything else, as it is
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def forget(self) -> None:
        self.spaced.clear()
        self.units.clear()

    def _word(self, word: str) -> bytes:
        """Ids of letters alone, perhaps after one space."""
        piece = word.encode("utf-8").decode("latin-1").translate(self.letters) if not word.isascii() or word[0] == " " else word
        return array("I", [t.id for t in self.merges.tokenize(piece)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            if len(self.units) > CACHE_LIMIT // 8:
                self.units.clear()
            word = unit.rstrip(AFTER)
            if word.isalpha():
                ids = self._word(word) + (self._unit(unit[len(word):]) if len(word) < len(unit) else b"")
            else:
                ids = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
            self.units[unit] = ids
        return ids

    def _between(self, part: str) -> bytes:
        if part.isalpha():
            if part.isascii():
                return array("I", [t.id for t in self.merges.tokenize(self.space + part)]).tobytes()
            return self._word(" " + part)
        word = part.rstrip(AFTER)
        if word.isalpha():
            return self.spaced[word] + self._unit(part[len(word):])
        if not part or EDGE.match(part[0]) or EDGE.match(part[-1]):
            raise Joined
        if EDGE.search(part):  # a newline, say: rarely met again
            first, *rest = UNIT.findall(" " + part)
            return self.spaced[first[1:]] + b"".join(map(self._unit, rest))
        return self._unit(" " + part)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added is None:
            return self._plain(text)
        out, at = [], 0
        for found in self.added.finditer(text):
            if found.start() > at:
                out.append(self._plain(text[at:found.start()]))
            out.append(array("I", [self.tokenizer.token_to_id(found[0])]).tobytes())
            at = found.end()
        if at < len(text) or not out:
            out.append(self._plain(text[at:]))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        head, *parts = text.split(" ")  # no space stands before the head
        try:
            if not head or EDGE.match(head[-1]):
                raise Joined
            return b"".join([*map(self._unit, UNIT.findall(head)), *map(self.spaced.__getitem__, parts)])
        except Joined:
            return b"".join(map(self._unit, UNIT.findall(text)))


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 1024) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 for every piece of every document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        encoder.forget()  # what an earlier task left
        end = np.array([END_ID], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids = (encoder.encode(text) if text else b"") + end
                n = len(ids) // 4
                first = n % length or length
                start = 0
                for piece, stop in enumerate(range(first, n + 1, length)):
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start = stop
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        encoder.forget()

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_ENCODERS: dict[str, UnitEncoder] = {}


def _encoder(path: str) -> UnitEncoder:
    """One tokenizer per Python worker; its caches last for a task."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


# --- the grouping genetic algorithm over one block ------------------------------------------------

Bins = list[list[int]]  # piece numbers of each bin


def best_fit(bins: Bins, load: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Put each item, longest first, into the fullest bin that still holds it."""
    room = sorted((capacity - l, b) for b, l in enumerate(load))
    for i in sorted(items, key=lambda i: (-size[i], i)):
        at = bisect.bisect_left(room, (size[i], -1))
        if at == len(room):
            b = len(bins)
            bins.append([])
            load.append(0)
        else:
            b = room.pop(at)[1]
        bins[b].append(i)
        load[b] += size[i]
        bisect.insort(room, (capacity - load[b], b))


def fitness(bins: Bins, size: list[int], capacity: int) -> float:
    """Fewer bins first, then unevenly filled ones (sum of squared fill)."""
    return -len(bins) + sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / (len(bins) + 1)


def dominate(bins: Bins, load: list[int], loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Exchange one or two pieces of a bin for one larger loose piece that still fits; returns what is loose then.

    The bin gets fuller and what it gives up is smaller, hence easier to place.
    """
    order = sorted((size[i], i) for i in loose)
    for b, group in enumerate(bins):
        room = capacity - load[b]
        if not room or not order:
            continue
        out = [(size[i], (i,)) for i in group] + [(size[group[x]] + size[group[y]], (group[x], group[y])) for x in range(min(4, len(group))) for y in range(x)]
        best = None
        for given, items in out:
            at = bisect.bisect_right(order, (given + room, 1 << 62)) - 1
            if at >= 0 and order[at][0] > given and (best is None or order[at][0] - given > best[0]):
                best = order[at][0] - given, at, items
        if best:
            gain, at, items = best
            group.append(order.pop(at)[1])
            load[b] += gain
            for i in items:
                group.remove(i)
                bisect.insort(order, (size[i], i))
    return [i for _, i in order]


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of b into a; drop bins of a that share a piece; best-fit what they lose."""
    ranked = sorted(b, key=lambda g: -sum(size[i] for i in g))
    gift = [g for g in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    taken = {i for g in gift for i in g}
    kept, displaced = [], []
    for g in a:
        if taken.isdisjoint(g):
            kept.append(g)
        else:
            displaced += [i for i in g if i not in taken]
    bins = [list(g) for g in gift] + [list(g) for g in kept]
    load = [sum(size[i] for i in g) for g in bins]
    best_fit(bins, load, displaced, size, capacity)
    return bins


def mutate(bins: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Open the emptiest bins and a few others, exchange their pieces for smaller ones of bins with room, and best-fit the rest."""
    bins = sorted(([*g] for g in bins), key=lambda g: -sum(size[i] for i in g))
    cut = max(2, len(bins) // 20)
    loose = [i for g in bins[-cut:] for i in g]
    bins = bins[:-cut]
    for _ in range(min(len(bins), 1 + cut // 2)):
        loose += bins.pop(rng.randrange(len(bins)))
    load = [sum(size[i] for i in g) for g in bins]
    for _ in range(3):
        loose = dominate(bins, load, loose, size, capacity)
    best_fit(bins, load, loose, size, capacity)
    return bins


def evolve(population: list[Bins], size: list[int], capacity: int, generations: int, rng: random.Random) -> list[Bins]:
    """A few steady-state generations; the population comes back best first. Stops at the lower bound."""
    bound = -(-sum(size) // capacity)
    ranked = sorted(((fitness(p, size, capacity), n, p) for n, p in enumerate(population)), key=lambda r: (-r[0], r[1]))
    for n in range(generations):
        if len(ranked[0][2]) <= bound:
            break
        one, two = sorted(rng.sample(range(len(ranked)), 2)) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[one][2], ranked[two][2], size, capacity, rng) if n % 2 else ranked[0][2]
        child = mutate(child, size, capacity, rng)
        ranked.append((fitness(child, size, capacity), n + len(population), child))
        ranked.sort(key=lambda r: (-r[0], r[1]))
        ranked.pop()
    return [r[2] for r in ranked]


def _first(size: list[int], capacity: int, rng: random.Random, jitter: float) -> Bins:
    """A best-fit start whose order is decreasing, slightly shaken for variety."""
    noisy = [s * (1 + jitter * rng.random()) for s in size]
    bins: Bins = []
    load: list[int] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(size)), key=lambda i: -noisy[i]):
        at = bisect.bisect_left(room, (size[i], -1))
        b = room.pop(at)[1] if at < len(room) else len(bins)
        if b == len(bins):
            bins.append([])
            load.append(0)
        bins[b].append(i)
        load[b] += size[i]
        bisect.insort(room, (capacity - load[b], b))
    return bins


def _starts(size: list[int], capacity: int, island: int, population: int, rng: random.Random) -> list[Bins]:
    """An island's population; a start that meets the lower bound needs no others."""
    bound, found = -(-sum(size) // capacity), []
    for p in range(population):
        found.append(_first(size, capacity, rng, 0.0 if p == 0 else 0.02 * p * (1 + island)))
        if len(found[-1]) <= bound:
            return found[-1:]
    return found


SOLUTION = "block long, island int, uid long, length long, bin long"


def _islands(items: DataFrame, capacity: int, islands: int, generations: int, population: int, seed: int) -> DataFrame:
    """Round one: each (block, island) evolves its own start; its elite is the result."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values("uid")
        size = pdf["length"].tolist()
        rng = random.Random(f"{seed}/{block}/{island}")
        start = _starts(size, capacity, island, population, rng)
        return _rows(pdf, evolve(start, size, capacity, generations, rng)[0], block, island)

    return items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).groupBy("block", "island").applyInPandas(run, SOLUTION)


def _rows(pdf: pd.DataFrame, bins: Bins, block: int, island: int) -> pd.DataFrame:
    where = np.empty(len(pdf), dtype=np.int64)
    for b, group in enumerate(bins):
        where[group] = b
    return pd.DataFrame({"block": block, "island": island, "uid": pdf["uid"].to_numpy(), "length": pdf["length"].to_numpy(), "bin": where})


def _migrate(elites: DataFrame, capacity: int, islands: int, generations: int, seed: int) -> DataFrame:
    """Round two: every island gets its neighbour's elite and evolves both; the block's best is kept."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        parts = [g.sort_values("uid") for _, g in pdf.groupby("island")]
        size = parts[0]["length"].tolist()
        elite = []
        for g in parts:
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(g["bin"]):
                bins.setdefault(b, []).append(i)
            elite.append(list(bins.values()))
        best: list[Bins] = []
        for i in range(len(elite)):
            rng = random.Random(f"{seed}/{block}/{i}/2")
            best += evolve([elite[i], elite[(i + 1) % len(elite)]], size, capacity, generations, rng)[:1]
        return _rows(parts[0], max(best, key=lambda p: fitness(p, size, capacity)), block, 0)

    return elites.groupBy("block").applyInPandas(run, SOLUTION)


def _solve(items: DataFrame, capacity: int, islands: int, generations: int, population: int, seed: int) -> DataFrame:
    return _migrate(_islands(items, capacity, islands, generations, population, seed), capacity, islands, generations, seed)


def pack(cut: DataFrame, capacity: int = 1024, block_items: int = 4000, islands: int = 2, generations: int = 12, population: int = 3, seed: int = 17) -> DataFrame:
    """Add sequence_id and offset to rows that have length and any other columns (see `pieces`); columns of those two names are replaced.

    A block holds about `block_items` pieces however many there are, so a task's memory is fixed.
    """
    name = free_name(cut, "_uid", "sequence_id", "offset")
    cut = file_rows(written(cut.drop("sequence_id", "offset"), "pieces"), name)
    sizes = cut.select(F.col(name).alias("uid"), F.col("length").cast("long").alias("length"))
    small = sizes.where(F.col("length") < capacity)
    blocks = max(1, round(small.count() / block_items))
    dealt = small.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    first = written(_solve(dealt, capacity, islands, generations, population, seed), "packed")
    # Badly filled bins of all blocks are opened and packed again in pools of the same size.
    fill = first.groupBy("block", "bin").agg(F.sum("length").alias("fill")).withColumn("open", F.col("fill") < int(0.98 * capacity))
    marked = first.join(fill, ["block", "bin"])
    loose = marked.where("open")
    pools = max(1, round(loose.count() / block_items))
    again = _solve(loose.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(pools)).alias("block")), capacity, islands, generations, population, seed + 1)
    # A sequence's number: kind, block and bin in one long.
    number = lambda kind: F.shiftleft(F.col("block"), 24) + F.col("bin") + F.lit(kind << 60)
    placed = marked.where("not open").select("uid", "length", number(0).alias("sequence_id")).unionByName(again.select("uid", "length", number(1).alias("sequence_id")))
    w = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("uid").alias(name), "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))
    whole = cut.where(F.col("length") >= capacity).withColumn("sequence_id", F.col(name) + F.lit(2 << 60)).withColumn("offset", F.lit(0).cast("long"))
    return cut.where(F.col("length") < capacity).join(placed, name).unionByName(whole).drop(name)
