"""Token counts from the pieces of distinct pre-tokens.

A tokenizer that never merges across white space, nor across the borders that its
pre-tokenizer cuts, gives a text as many tokens as its pre-tokens have pieces.  So pieces
are counted once per distinct pre-token of the corpus, in a table that a shuffle builds;
documents carry how often each word of theirs stands in them, and sums of products follow.
No ids of a document are ever made.

The frequencies meet the counts in two ways.  The most frequent pre-tokens, a bounded
number with bounded names, are broadcast, and a document's occurrences of them are summed
where its text is read.  The others, none of which is frequent, are joined by a shuffle.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import filterfalse, repeat
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import quoted, text_or_empty, written

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: A pre-token with over one in so many of all occurrences is frequent, so there are fewer
#: than that; names have up to LONG bytes, longer pre-tokens go by a digest.  Distinct words
#: that a task gathers before it hands them on.
FREQUENT, LONG, GATHERED = 500_000, 64, 500_000
#: Words that a worker remembers; pre-tokens encoded in one call, and on one line.
REMEMBERED, CALL, LINE = 500_000, 2000, 500
#: Letters that normalising changes nothing about but their case, to another one of them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Words of these, digits and marks but the apostrophe; their pre-tokens.
PLAIN = re.compile(rf"[!-&(-~{LETTERS}]+")
PIECES = re.compile(rf"[{LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+")


class PreTokens:
    """The cuts of a tokenizer: words at the six ASCII white-space characters, and inside
    plain words runs of letters, single digits and runs of marks.

    Any other word, and one that holds an added token's string, stays whole.  Whether the
    tokenizer cuts like this is tried out first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        if self.single(["plain  words\n", "plain", "words", " plain"]) != [2, 1, 1, 1]:
            raise ValueError("this tokenizer doesn't drop white space: its words can't be counted apart")
        letters = re.findall(f"[{LETTERS}]", "".join(map(chr, range(0x180))))
        probe = "".join(f"{c}-{c}1{c}a,.{c}?2" for c in letters) + "".join(f"{chr(c)}x{chr(c)}1" for c in range(33, 127) if chr(c) != "'")
        self.cuts = sum(self.single(PIECES.findall(probe.lower()))) == self.single([probe])[0]

    def single(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(texts), CALL):
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]
        return out

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of each; those of letters only are encoded many to a line."""
        out = np.zeros(len(pre_tokens), dtype=np.int64)
        letters = [i for i, p in enumerate(pre_tokens) if p.isalpha()]
        others = [i for i, p in enumerate(pre_tokens) if not p.isalpha()]
        for at in range(0, len(letters), LINE):
            some = letters[at : at + LINE]
            line = " ".join([pre_tokens[i] for i in some])
            ends = np.flatnonzero(self.ends_word[self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids])
            if len(ends) == len(some):
                out[some] = np.diff(ends, prepend=-1)
            else:  # one isn't a single run for this tokenizer
                others += some
        out[others] = self.single([pre_tokens[i] for i in others])
        return out.tolist()

    def of(self, word: bytes) -> list[str]:
        """The pre-tokens of a word, a repeated one as often as it stands there."""
        if self.cuts and word.isalpha():
            return [word.lower().decode()]
        text = word.decode("utf-8", "replace")
        if self.cuts and PLAIN.fullmatch(text) and not self.added.search(text):
            return PIECES.findall(text.lower())
        return [text]


CUTS: dict[str, PreTokens] = {}


def cuts(path: str) -> PreTokens:
    return CUTS.get(path) or CUTS.setdefault(path, PreTokens(path))


def name_of(pre_token: str) -> str:
    """What a pre-token is joined by: itself, or a digest if it is long."""
    if len(pre_token) <= LONG // 4 or len(raw := pre_token.encode("utf-8", "surrogatepass")) <= LONG:
        return pre_token
    return " " + sha256(raw).hexdigest()


def words_of(text: pa.StringScalar) -> list[bytes]:
    """Words in UTF-8; bytes split at the six ASCII white-space characters only."""
    return text.as_buffer().to_pybytes().split()


def gatherer(path: str):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, words = cuts(path), Counter()

        def flushed() -> pa.RecordBatch:
            found: dict[str, int] = {}
            for w, n in words.items():
                for p in cut.of(w):
                    found[p] = found.get(p, 0) + n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pre_token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                words.update(words_of(text))
                if len(words) > GATHERED:
                    yield flushed()
        yield flushed()

    return gather


def piece_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cuts(path)
        for batch in batches:
            names = batch.column("pre_token").to_pylist()
            columns = [pa.array([name_of(p) for p in names], pa.string()), batch.column("n"), pa.array(cut.pieces(names), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "n", "pieces"])

    return count


def pre_token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """name, n, pieces: each distinct pre-token of ``docs`` (with a column text), how often it
    stands there, and its number of pieces, counted once."""
    found = docs.select("text").mapInArrow(gatherer(tokenizer_path), "pre_token string, n long")
    distinct = found.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(piece_counter(tokenizer_path), "name string, n long, pieces long")


def summer(path: str, frequent):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = cuts(path), frequent.value
        known: dict[bytes, int] = {}  # pieces of a word so far
        rarer: dict[bytes, list[str]] = {}  # its pre-tokens that aren't frequent

        def learn(words) -> None:
            for word in words:
                names = cut.of(word)
                if len(word) > LONG // 4:
                    names = [name_of(p) for p in names]
                if len(names) == 1:
                    rare = names if (n := pieces.get(names[0])) is None else None
                else:
                    n, rare = sum(map(pieces.get, names, repeat(0))), [p for p in names if p not in pieces]
                known[word] = n or 0
                if rare:
                    rarer[word] = rare

        for batch in batches:
            totals, names, times, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = Counter(words_of(text))
                if len(known) > REMEMBERED:
                    known.clear()
                    rarer.clear()
                learn(filterfalse(known.__contains__, words))
                totals.append(sum(map(mul, map(known.__getitem__, words), words.values())))
                rare: dict[str, int] = {}
                for word in filter(rarer.__contains__, words):
                    for p in rarer[word]:
                        rare[p] = rare.get(p, 0) + words[word]
                names += rare.keys()
                times += rare.values()
                ends.append(len(names))
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64())], ["name", "times"])
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*kept.schema.names, "total", "rare"])

    return add


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens): a row per row of ``docs``.

    Tokens are what the library gives without special tokens added, nothing cut or padded;
    special strings inside a text count as its default has them.  A null text counts as
    empty, with no tokens; texts of any length are read whole; repeated rows are
    counted each, null ids too; an empty table gives none.  Only the id and text columns
    are read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))
    known = written(pre_token_table(rows, tokenizer_path))
    total = known.agg(F.sum("n")).first()[0] or 0
    # under FREQUENT names of up to LONG bytes, however large the table is
    top = {r["name"]: r["pieces"] for r in known.filter(F.col("n") * frequent > total).select("name", "pieces").collect()}
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    summed = numbered.mapInArrow(summer(tokenizer_path, spark.sparkContext.broadcast(top)), f"doc_id {kind}, row long, n_bytes long, total long, rare array<struct<name:string,times:bigint>>")
    summed = written(summed)
    done = summed.filter(F.size("rare") == 0).select("doc_id", "n_bytes", F.col("total").alias("n_tokens"))
    asked = summed.filter(F.size("rare") > 0)
    more = asked.select("row", F.inline("rare")).join(known.select("name", "pieces"), "name").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    both = done.unionByName(asked.drop("rare").join(more, "row").select("doc_id", "n_bytes", (F.col("total") + F.col("more")).alias("n_tokens")))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
