"""Removal of repeated passages with prefix-partitioned suffix trees.

Every word position of the corpus starts a suffix.  Two suffixes share their first
``window`` words exactly if they lie below one internal node at that depth, so the trees
are cut there: a leaf's path is named by fingerprints of its words, and its deep internal
node is the interval of leaves, in the order of their paths, that agree in all of it.

Vertical partitioning keeps each subtree in memory.  Suffixes go to a group by their first
word; the classes of first words are counted over the whole corpus, and one too large for a group
is split by the first eight words, or by the whole window where these are frequent too.
Documents travel in blocks, and a block sends a group the sorted leaves of its own suffixes
there, each once, with a mark if it has the suffix twice.  A passage that stands in a third
of all documents thus reaches its group once per block.  The group answers each block with one
bit per leaf: whether it lies below a node with another leaf.  Maximal repeats are the runs
of positions below such nodes.  Groups and blocks grow with the root of the corpus, so that
a message carries many suffixes at any size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import quoted, text_or_empty
from revloom.llm.shingles import batches_of, mix, run_hashes, texts_hashes, words_of

WINDOW = 35
#: Words of the longer prefix that splits a large class.
LONG_PREFIX = 8
#: First words, and longer prefixes, fall into so many classes.
PREFIX_CLASSES, LONG_CLASSES = 4096, 1 << 16
#: Suffixes meant for one group, characters of text meant for one block of documents, and
#: suffixes meant for one message: the first two grow where messages would be smaller.
GROUP_SUFFIXES, BLOCK_CHARS, MESSAGE_SUFFIXES = 2_000_000, 6_000_000, 32


def prefix_class(hashes: np.ndarray, classes: int = PREFIX_CLASSES) -> np.ndarray:
    return (hashes >> np.uint64(65 - classes.bit_length())).astype(np.int64)


def hashed_batches(texts: list[str]) -> Iterator[list[np.ndarray]]:
    for _, some in batches_of(texts):
        yield texts_hashes(some)


def class_counter(window: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Suffixes per class of their first word and of their longer prefix, and characters,
        of a task's documents."""
        counts, longer, chars = np.zeros(PREFIX_CLASSES, dtype=np.int64), np.zeros(LONG_CLASSES, dtype=np.int64), 0
        for pdf in batches:
            chars += int(pdf["text"].str.len().sum())
            for some in hashed_batches(pdf["text"].tolist()):
                some = [h for h in some if len(h) >= window]
                if some:
                    counts += np.bincount(prefix_class(np.concatenate([h[: len(h) - window + 1] for h in some])), minlength=PREFIX_CLASSES)
                    runs = np.concatenate([run_hashes(h, min(LONG_PREFIX, window))[: len(h) - window + 1] for h in some])
                    longer += np.bincount(prefix_class(runs, LONG_CLASSES), minlength=LONG_CLASSES)
        n = np.concatenate([counts, longer, [chars]])
        yield pd.DataFrame({"class": np.arange(len(n)), "n": n})[n > 0]

    return count


def partition_table(counts: np.ndarray, group_suffixes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each class its first group and how many groups it has; and the groups in all.

    Small classes share a group; a class above the limit gets groups of its own, among
    which a longer prefix decides.
    """
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    group, filled = 0, 0
    for c in np.argsort(counts, kind="stable"):
        n = int(counts[c])
        if n > group_suffixes:
            group += filled > 0
            first[c], parts[c], filled = group, math.ceil(n / group_suffixes), 0
            group += int(parts[c])
        else:
            if filled + n > group_suffixes and filled:
                group, filled = group + 1, 0
            first[c] = group
            filled += n
    return first, parts, group + (filled > 0 or group == 0)


class Suffixes:
    """Leaves of a block's suffixes, by group; the same on each call."""

    def __init__(self, texts: list[str], first: np.ndarray, parts: np.ndarray, hot: np.ndarray, width: int, window: int):
        lows, highs, groups = [], [], []
        for hashes in chain.from_iterable(hashed_batches(texts)):
            if len(hashes) < window:
                continue
            low = run_hashes(hashes, window)
            group = first[c := prefix_class(hashes[: len(low)])].copy()
            if (many := parts[c] > 1).any():
                longer = run_hashes(hashes, min(LONG_PREFIX, window))[: len(low)]
                longer = np.where(hot[prefix_class(longer, LONG_CLASSES)], low, longer)[many]
                group[many] += (longer % parts[c][many].astype(np.uint64)).astype(np.int64)
            lows.append(low)
            groups.append(group)
            if width > 8:
                highs.append(run_hashes(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), window))
        self.low = np.concatenate(lows) if lows else np.zeros(0, np.uint64)
        self.group = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        if width > 8:
            high = np.concatenate(highs) if highs else np.zeros(0, np.uint64)
            self.high = high & np.uint64((1 << (8 * (width - 8))) - 1)
        else:
            self.high = np.zeros(len(self.low), np.uint64)
        self.order = np.lexsort((self.high, self.low, self.group)) if width > 8 else np.lexsort((self.low, self.group))
        g, lo, hi = self.group[self.order], self.low[self.order], self.high[self.order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        self.leaf = np.cumsum(new) - 1  # of each sorted suffix
        at = np.flatnonzero(new)
        self.leaf_group, self.leaf_low, self.leaf_high = g[at], lo[at], hi[at]
        self.leaf_size = np.diff(np.append(at, len(g)))

    def by_group(self) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.leaf_group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(self.leaf_group)], strict=True):
            if hi > lo:
                yield int(self.leaf_group[lo]), slice(int(lo), int(hi))

    def flags(self, repeated_leaves: np.ndarray) -> np.ndarray:
        """Whether each suffix, in document order, starts a repeat."""
        out = np.zeros(len(self.low), dtype=bool)
        out[self.order] = repeated_leaves[self.leaf]
        return out


def packed(low: np.ndarray, high: np.ndarray, width: int) -> bytes:
    """Sorted fingerprints as bytes: differences of the low words, byte planes, deflated."""
    steps = np.diff(low, prepend=np.uint64(0))
    planes = [steps.view(np.uint8).reshape(-1, 8).T.copy().tobytes()]
    if width > 8:
        planes.append(high.view(np.uint8).reshape(-1, 8)[:, : width - 8].tobytes())
    return zlib.compress(b"".join(planes), 1)


def unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    n = len(raw) // width
    low = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    high = np.zeros((n, 8), dtype=np.uint8)
    if width > 8:
        high[:, : width - 8] = raw[8 * n :].reshape(n, width - 8)
    return low, high.view(np.uint64).ravel()


def sender(first, parts, hot, width: int, window: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].iloc[0]
        suffixes = Suffixes(ordered(pdf)["text"].tolist(), first, parts, hot, width, window)
        out = []
        for group, part in suffixes.by_group():
            twice = np.packbits(suffixes.leaf_size[part] > 1)
            out.append((block, group, packed(suffixes.leaf_low[part], suffixes.leaf_high[part], width), twice.tobytes()))
        return pd.DataFrame(out, columns=["block", "group", "prints", "twice"])

    return send


def subtree(width: int):
    """One group's subtree: its leaves in the order of their paths, and the internal nodes at
    the window's depth as intervals of leaves."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        lows, highs = zip(*[unpacked(x, width) for x in pdf["prints"]], strict=True)
        low, high = np.concatenate(lows), np.concatenate(highs)
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)) for t, x in zip(pdf["twice"], lows, strict=True)]).astype(bool)
        order = np.lexsort((high, low)) if width > 8 else np.argsort(low, kind="stable")
        lo, hi = low[order], high[order]
        # neighbours whose common prefix is shorter than the window bound the nodes
        apart = np.flatnonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        node = np.concatenate([[0], apart])
        leaves = np.diff(node, append=len(lo)) + np.maximum.reduceat(twice[order], node)
        repeated = np.empty(len(lo), dtype=bool)
        repeated[order] = np.repeat(leaves > 1, np.diff(node, append=len(lo)))
        ends = np.cumsum([len(x) for x in lows])
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, ends[:-1])]
        answer = pd.DataFrame({"block": pdf["block"], "group": pdf["group"], "n": [len(x) for x in lows], "repeated": bits})
        return answer[[bool(r.any()) for r in np.split(repeated, ends[:-1])]]

    return build


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "text"], kind="stable", ignore_index=True)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words under a window that starts at one of the flagged positions."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges[:-1]) > 0


def remover(first, parts, hot, width: int, window: int, keep_text: bool):
    def remove(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"] + ["kept_text"] * keep_text
        if not len(docs):
            return pd.DataFrame(columns=columns)
        docs = ordered(docs)
        if len(answers):
            suffixes = Suffixes(docs["text"].tolist(), first, parts, hot, width, window)
            leaves = np.zeros(len(suffixes.leaf_low), dtype=bool)
            told = {g: (n, r) for g, n, r in zip(answers["group"], answers["n"], answers["repeated"], strict=True)}
            for group, part in suffixes.by_group():
                if group in told:
                    n, bits = told[group]
                    if n != part.stop - part.start:
                        raise ValueError("a block changed between its two passes")
                    leaves[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
            flags = suffixes.flags(leaves)
        else:
            flags = None
        out, at = [], 0
        for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
            words = words_of(text)
            n = max(0, len(words) - window + 1)
            repeats = n and flags is not None and flags[at : at + n].any()
            gone = covered(flags[at : at + n], len(words), window) if repeats else np.zeros(len(words), dtype=bool)
            at += n
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words)
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans = ",".join(f"{a}:{b}" for a, b in turns.reshape(-1, 2))
            out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans) + ((kept.decode("utf-8", "surrogatepass"),) if keep_text else ()))
        return pd.DataFrame(out, columns=columns)

    return remove


def fingerprint_bytes(n_suffixes: int) -> int:
    """Bytes that make a chance agreement anywhere in the corpus unlikely (under 1 in 1000)."""
    return min(16, max(8, math.ceil((2 * math.log2(max(n_suffixes, 2)) + 10) / 8)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, group_suffixes: int = GROUP_SUFFIXES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word spans a:b) and, if asked for,
    kept_text, a row per row of ``docs``.

    A word goes if a window over it starts, with the same words, anywhere else, in the
    same document or another; all windows are judged on the input, so every copy of a
    repeat goes.  Null text has no words; a text under a window's length loses none;
    repeated rows and ids are documents of their own; an empty table gives no rows.
    """
    # ids travel as strings: pandas has no whole numbers beside nulls
    rows = docs.select(quoted(id_col).cast("string").alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))
    counted = rows.select("text").mapInPandas(class_counter(window), "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(PREFIX_CLASSES + LONG_CLASSES + 1, dtype=np.int64)
    for r in counted:  # a row per class
        n[r["class"]] = r["n"]
    counts, longer, chars = n[:PREFIX_CLASSES], n[PREFIX_CLASSES:-1], int(n[-1])
    suffixes = int(counts.sum())
    least = math.isqrt(MESSAGE_SUFFIXES * suffixes)
    group_suffixes = max(group_suffixes, least)
    block_chars = max(block_chars, least * chars // max(suffixes, 1))
    first, parts, _ = partition_table(counts, group_suffixes)
    hot = longer > suffixes // LONG_CLASSES * 4 + group_suffixes // 4
    width = fingerprint_bytes(suffixes)
    blocks = max(1, math.ceil(chars / block_chars))
    # a hash of the row and its place, so that copies of a text, and of a row, are dealt over
    # all blocks; a row whose place differs between the passes is found out by the second one
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(blocks)))
    sent = dealt.groupBy("block").applyInPandas(sender(first, parts, hot, width, window), "block long, group long, prints binary, twice binary")
    answers = sent.groupBy("group").applyInPandas(subtree(width), "block long, group long, n long, repeated binary")
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string, removed string" + ", kept_text string" * keep_text
    cut = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(remover(first, parts, hot, width, window, keep_text), schema)
    return cut.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def substring_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
