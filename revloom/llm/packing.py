"""Best-fit packing of token sequences by large-item matching.

How pieces share sequences depends only on their lengths, so the packing is planned on
the histogram of lengths, at most ``capacity`` numbers, however many pieces there are.
Pieces above one third of the capacity are matched, at most two to a sequence: longest
first, each with the longest that still fits.  Shorter pieces then go to the tightest gap.
The plan says which ranks of each length go where; every piece finds its place from its
rank among the pieces of its length, which is counted in salted groups.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import materialize, quoted, text_or_empty
from revloom.llm.shingles import batches_of, piece_hashes, slices

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Different units whose ids a Python worker keeps; beyond that it starts anew.  Bytes of
#: text looked at at a time.
CACHED_UNITS, CHUNK = 1_000_000, 1 << 18

#: Classes of bytes: white space, letters (bytes above 127 count as letters until their
#: characters are looked at), digits, marks, and what can change how its neighbours split.
SPACE, LETTER, DIGIT, MARK, JOINING = range(5)
#: A letter and marks around a character, to see whether it splits from them.
AROUND = ("a", ".a,")


class Grown:
    """An array that is appended to; room is doubled when it is used up."""

    def __init__(self, first: np.ndarray):
        self.room, self.size = first.copy(), len(first)

    def append(self, more: np.ndarray) -> None:
        if (size := self.size + len(more)) > len(self.room):
            room = np.zeros(max(2 * len(self.room), size, 1024), dtype=self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : size] = more
        self.size = size

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Known:
    """Places of hashes; new ones are sorted in among the last ones, and these now and then among all."""

    def __init__(self):
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, -1 if it isn't known."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for known, places in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, places[at], out)
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        def sorted_in(a, b):
            keys, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            order = np.argsort(keys)
            return keys[order], values[order]

        old, new = self.levels[0], sorted_in(self.levels[1], (hashes, places))
        if len(new[0]) > 20_000 + len(old[0]) // 8:
            old, new = sorted_in(old, new), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.levels = [old, new]


class UnitTokenizer:
    """Ids of whole texts, from the ids of the units that the tokenizer splits them into.

    The tokenizer splits at white space and between letters, digits and other characters,
    and lowers case.  Runs of one such class are units; each different one is encoded once
    per worker.  Where that splitting could be wrong, the unit is the whole word: at
    apostrophes, controls, the first characters of added tokens, and characters above 127
    that aren't letters or don't stay letters when normalised.  Units are told apart by
    64-bit hashes of their bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        kinds = np.full(256, JOINING, dtype=np.uint8)
        kinds[[9, 10, 11, 12, 13, 32]] = SPACE
        for c in range(33, 127):
            kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK
        kinds[128:] = LETTER
        kinds[[ord("'"), 0xC2, 0xE2]] = JOINING  # these two bytes begin punctuation mostly
        for token in self.tokenizer.get_added_tokens_decoder().values():
            kinds[token.content.encode()[0]] = JOINING
        self.kinds, self.lower = kinds, np.arange(256, dtype=np.uint8)
        if self.encoded("PROBE aBc") == self.encoded("probe abc"):
            self.lower[65:91] += 32
        marks = "".join(chr(c) for c in range(33, 127) if kinds[c] == MARK)
        parts = ["ab", marks, "12", "cd", "345", marks]
        if self.encoded("".join(parts)) != sum(map(self.encoded, parts), []):
            self.kinds = np.where(kinds == SPACE, kinds, JOINING)  # every unit is a word
        self.by_line = self.together(["plain", "words", "x"]) == [self.encoded(x) for x in ("plain", "words", "x")]
        self.letters: dict[str, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Known units: their places by hash; by place, ids and whether safe."""
        self.known = Known()
        self.flat, self.ends, self.safe = Grown(np.zeros(0, np.uint32)), Grown(np.zeros(1, np.int64)), Grown(np.zeros(0, bool))

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def stays(self, c: str) -> bool:
        """Whether a character is a letter that splits from what isn't, once normalised."""
        if (found := self.letters.get(c)) is None:
            before, after = AROUND
            split = self.encoded(before + c) + sum(map(self.encoded, after), [])
            found = self.letters[c] = c.isalpha() and self.encoded(before + c + after) == split and self.encoded(c + after[0]) == self.encoded(c) + self.encoded(after[0])
        return found

    def together(self, words: list[str]) -> list[list[int]] | None:
        """Ids of words of letters, encoded as one line; None if one isn't a single run."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(words):
            return None
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, hashes: np.ndarray, units: list[bytes], runs: np.ndarray) -> None:
        """Encode units met for the first time; ``runs``: those of letters, not whole words."""
        texts = [u.decode("utf-8", "replace") for u in units]
        safe = np.array([not r or t.isascii() or all(map(self.stays, t)) for t, r in zip(texts, runs, strict=True)], dtype=bool)
        ids: list[list[int]] = [[] for _ in texts]
        plain = np.flatnonzero(safe & runs & self.by_line)
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500].tolist()
            for i, found in zip(some, self.together([texts[i] for i in some]) or [self.encoded(texts[i]) for i in some], strict=True):
                ids[i] = found
        for i in np.flatnonzero(safe & ~(runs & self.by_line)).tolist():
            ids[i] = self.encoded(texts[i])
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        self.known.add(hashes, self.safe.size + np.arange(len(units)))
        self.flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())))
        self.ends.append(self.ends.all[-1] + np.cumsum(sizes))
        self.safe.append(safe)

    def units(self, raw: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the units, their places among the known ones).

        ``whole``: where words start that must be one unit, besides those with joining bytes.
        """
        kinds = self.kinds[raw]
        at = np.flatnonzero((kinds != SPACE) & (np.concatenate([[SPACE], kinds[:-1]]) == SPACE))
        if not len(at):
            return at, at
        words = np.maximum.reduceat(kinds, at) == JOINING
        if whole is not None:
            words |= np.isin(at, whole)
        if words.any():
            sizes = np.diff(at, append=len(raw))
            inside = np.zeros(len(raw), dtype=bool)
            inside[at[0] :] = np.repeat(words, sizes)
            kinds = np.where(inside & (kinds != SPACE), JOINING, kinds)
        starts = np.flatnonzero((kinds != SPACE) & (np.concatenate([[SPACE], kinds[:-1]]) != kinds))
        kind = kinds[starts]
        low = self.lower[raw]
        hashes = piece_hashes(low, starts) + kind  # the same bytes as a run and as a word differ
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = self.known.find(different)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            ends = np.append(starts[1:], len(raw))[first[fresh]]
            source = kind[first[fresh]] == LETTER
            blob, plain = raw.tobytes(), low.tobytes()
            units = [(plain if r else blob)[a:b].rstrip(b" \t\n\r\x0b\x0c") for a, b, r in zip(starts[first[fresh]].tolist(), ends.tolist(), source.tolist(), strict=True)]
            self.learn(different[fresh], units, source)
            found = self.known.find(different)
        places = found[which]
        unsafe = ~self.safe.all[places]
        if unsafe.any():
            again = at[np.searchsorted(at, starts[unsafe], side="right") - 1]
            return self.units(raw, again if whole is None else np.union1d(whole, again))
        return starts, places

    def ids(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text, with ``end_id`` behind them if given."""
        if self.safe.size > CACHED_UNITS:
            self.clear()
        parts = [x.encode("utf-8", "replace") for x in texts]
        ends = np.cumsum([len(x) + 1 for x in parts])
        raw = b"\n".join(parts)
        starts, chunks = [np.zeros(0, np.int64)], []
        for at, end in slices(raw, CHUNK):
            some, places = self.units(np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at))
            starts.append(some + at)
            firsts, sizes = self.ends.all[places], self.ends.all[places + 1] - self.ends.all[places]
            upto = np.cumsum(sizes)
            total = int(upto[-1]) if len(upto) else 0
            chunks.append((sizes, self.flat.all[np.repeat(firsts - upto + sizes, sizes) + np.arange(total)]))
        sizes = np.concatenate([[0], *[c[0] for c in chunks]])
        flat = np.concatenate([np.zeros(0, np.uint32), *[c[1] for c in chunks]])
        cuts = np.cumsum(sizes)[np.searchsorted(np.concatenate(starts), ends)]
        if end_id is not None:
            flat = np.insert(flat, cuts, np.uint32(end_id))
            cuts = cuts + np.arange(1, len(cuts) + 1)
        return np.split(flat, cuts[:-1])


TOKENIZERS: dict[str, UnitTokenizer] = {}


def piece_maker(path: str, capacity: int, end_id: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = TOKENIZERS.get(path) or TOKENIZERS.setdefault(path, UnitTokenizer(path))
        for pdf in batches:
            out = []
            ids_of_rows, texts = pdf["doc_id"], pdf["text"].tolist()
            for at, some in batches_of(texts):
                for i, ids in enumerate(tokenizer.ids(some, end_id), at):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((i, k, start, len(part), zlib.crc32(part.astype("<u4", copy=False))))
            made = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            made.insert(0, "doc_id", ids_of_rows.take(made["row"]).to_numpy())
            yield made.drop(columns="row")

    return pieces


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids, cut at ``capacity``."""
    rows = docs.select(quoted(id_col).cast("string").alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))
    # ids travel as strings: pandas has no whole numbers beside nulls
    return rows.mapInPandas(piece_maker(tokenizer_path, capacity, end_id), "doc_id string, piece int, start long, length long, ids_crc32 long")


@dataclass
class Slots:
    """Where the pieces of one length go: from rank ``rank`` on, ``per`` to a sequence."""

    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, Slots], int]:
    """Slots by length, and the number of sequences.

    Sequences with the same gap are handled as one group (first, count), so the work
    depends on the number of different lengths only.
    """
    slots: dict[int, Slots] = defaultdict(Slots)
    placed: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    sequences = 0

    def put(length: int, first: int, offset: int, per: int, count: int) -> None:
        s = slots[length]
        s.rank.append(placed[length])
        s.sequence.append(first)
        s.offset.append(offset)
        s.per.append(per)
        placed[length] += per * count

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, count))

    def take(gap: int) -> tuple[int, int]:
        got = gaps[gap].pop()
        if not gaps[gap]:
            open_gaps.pop(bisect_left(open_gaps, gap))
        return got

    left = {k: n for k, n in histogram.items() if n > 0}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        one = large[-1]
        at = bisect_left(large, capacity - one + 1) - 1  # the longest that fits beside it
        other = large[at] if at >= 0 else None
        if other is None:
            count = left[one]
            put(one, sequences, 0, 1, count)
            leave(capacity - one, sequences, count)
            left[one] = 0
        elif other != one:
            count = min(left[one], left[other])
            put(one, sequences, 0, 1, count)
            put(other, sequences, one, 1, count)
            leave(capacity - one - other, sequences, count)
            left[one] -= count
            left[other] -= count
            if not left[other]:
                large.pop(at)
        elif left[one] > 1:
            count = left[one] // 2
            put(one, sequences, 0, 2, count)
            leave(capacity - 2 * one, sequences, count)
            left[one] -= 2 * count
        else:
            at = bisect_left(large, one) - 1
            count = 1
            put(one, sequences, 0, 1, 1)
            if at >= 0:
                put(large[at], sequences, one, 1, 1)
                left[large[at]] -= 1
            leave(capacity - one - (large[at] if at >= 0 else 0), sequences, 1)
            left[one] = 0
            if at >= 0 and not left[large[at]]:
                large.pop(at)
        if not left[one]:
            large.remove(one)
        sequences += count
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        need = left[length]
        while need:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, count = take(gap)
            else:
                gap, first, count = capacity, sequences, -(-need // (capacity // length))
                sequences += count
            per = gap // length
            full = min(count, need // per)
            if full:
                put(length, first, capacity - gap, per, full)
                leave(gap - per * length, first, full)
            need -= per * full
            rest = count - full
            if rest and need:  # fewer than fill a sequence
                put(length, first + full, capacity - gap, need, 1)
                leave(gap - need * length, first + full, 1)
                full, rest, need = full + 1, rest - 1, 0
            leave(gap, first + full, rest)
    return dict(slots), sequences


def placer(table: dict[int, tuple[np.ndarray, ...]]):
    """Sequence and offset from length and rank, by a search in the plan."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for some in np.split(order, cuts) if len(order) else []:
                length = int(lengths[some[0]])
                rank, first, at, per = table[length]
                k = np.searchsorted(rank, ranks[some], side="right") - 1
                inside = ranks[some] - rank[k]
                sequence[some] = first[k] + inside // per[k]
                offset[some] = at[k] + inside % per[k] * length
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32).

    Equal lengths are told apart by a rank: within salted groups by a window, and between
    a length's groups by the groups' counts; salts grow with the root of the pieces, as do
    groups then.  The histogram that comes to the driver has a row for each length, at most
    ``capacity``.
    """
    drawn = materialize(pieces.withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32")))
    salted = drawn.withColumn("salt", F.pmod("draw", F.lit(salts or max(256, math.isqrt(drawn.count())))).cast("int")).drop("draw")
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = materialize(groups.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    table = {k: tuple(np.array(x, dtype=np.int64) for x in (s.rank, s.sequence, s.offset, s.per)) for k, s in slots.items()}
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(groups.drop("n"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(placer(table), "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: where its ids lie in which sequence.

    A null or empty text is the end id alone; longer texts than the capacity are cut;
    repeated rows and ids are packed as often as they come; no rows give none.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    packed = pack(tokenized_pieces(docs, tokenizer_path, capacity, end_id), capacity)
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
