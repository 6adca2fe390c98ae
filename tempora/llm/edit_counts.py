"""Edit-aware token counts.

A document is a segment tree whose leaves are its pre-tokens and whose nodes hold the characters
and tokens below them.  An edit (at, remove, insert) finds its first leaf by descending by
characters, and re-encodes from a leaf that starts at least four characters before the edit (no
decision of the pre-token pattern looks further ahead) up to the first boundary after the edit at
which old and new pre-tokens meet again, as matching has no memory.  The new pre-tokens go into the
first touched leaf, the other touched leaves become empty, and only the sums on their paths change.

Edits apply in order, each to the text that the one before left; positions beyond the text and
negative numbers are clamped, a null list or a null entry changes nothing, null fields are 0 or
empty.  Null texts count as empty; null ids and repeated rows are returned as they are; an empty
table gives an empty result; further columns are not looked at.  Special tokens' literals count as
ordinary text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.session import prepare

from .encoder import encoder

CONTEXT = 4


class PreTokens(dict):
    """Numbers of tokens of pre-tokens, kept for those seen lately."""

    def __init__(self, tokenizer: str, pattern: str, keep: int = 300_000) -> None:
        self.letters, self.keep, self.find = encoder(tokenizer).letters, keep, regex.compile(pattern).findall

    def __missing__(self, token: str) -> int:
        if len(self) > self.keep:
            self.clear()
        n = self[token] = len(self.letters(token)) // 4
        return n


@functools.lru_cache(maxsize=2)
def pre_tokens(tokenizer: str, pattern: str) -> PreTokens:
    return PreTokens(tokenizer, pattern)


class CountTree:
    """The segment tree of one text."""

    def __init__(self, text: str, counter: PreTokens) -> None:
        self.counter = counter
        self.leaves: list[list[str]] = [[t] for t in counter.find(text)]
        n = max(1, len(self.leaves))
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(self.leaves)] = [len(x[0]) for x in self.leaves]
        self.tokens[self.size : self.size + len(self.leaves)] = [counter[x[0]] for x in self.leaves]
        self.leaves += [[] for _ in range(self.size - len(self.leaves))]
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2
        self.encoded = 0

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it starts."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += int(self.chars[k])
                k += 1
        return k - self.size, start

    def put(self, i: int, tokens: list[str]) -> None:
        self.leaves[i] = tokens
        k = i + self.size
        self.chars[k], self.tokens[k] = sum(map(len, tokens)), sum(self.counter[t] for t in tokens)
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, at: int, remove: int, insert: str) -> None:
        total = int(self.chars[1])
        at = min(max(at, 0), total)
        end = min(at + max(remove, 0), total)
        first, start = self.leaf(max(0, at - CONTEXT))
        reach = 2 * CONTEXT
        while True:
            # old text from the first leaf to some leaves behind the edit
            last, ends, pieces, upto = first, [], [], start
            while last < self.size and (upto < end + reach or not pieces):
                for t in self.leaves[last]:
                    pieces.append(t)
                    upto += len(t)
                    ends.append(upto)
                last += 1
            old = "".join(pieces)
            new = self.counter.find(old[: at - start] + insert + old[end - start :])
            self.encoded += len(new)
            whole = upto == total
            # behind the edit, a boundary of the new pre-tokens that is one of the old ones too
            shift = len(insert) - (end - at)
            leaf_ends, k = {}, start
            for i in range(first, last):
                k += sum(map(len, self.leaves[i]))
                leaf_ends[k + shift] = i
            here = start
            for n, t in enumerate(new):
                here += len(t)
                if here >= at + len(insert) and here in leaf_ends and here - shift >= end and (whole or here <= upto + shift - CONTEXT):
                    self.put(first, new[: n + 1])
                    for i in range(first + 1, leaf_ends[here] + 1):
                        if self.leaves[i]:
                            self.put(i, [])
                    return
            if whole:
                self.put(first, new)
                for i in range(first + 1, last):
                    if self.leaves[i]:
                        self.put(i, [])
                return
            reach *= 2

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)


def edited_counts(docs: DataFrame, tokenizer: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts before and after the edits (an array of structs at, remove, insert) of each row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pre_tokens(tokenizer, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out: list[list[int]] = [[], [], [], [], []]
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = CountTree(text or "", counter)
                    before, leaves = int(tree.tokens[1]), sum(map(bool, tree.leaves))
                    edits = [e for e in edits or [] if e]
                    for e in edits:
                        tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                    for column, v in zip(out, (before, int(tree.tokens[1]), len(edits), leaves, tree.encoded), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_pre_tokens", "n_encoded_again"])

    return docs.mapInArrow(count, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_pre_tokens long, n_encoded_again long")


INSERTS = ("", " some new words", "\n\n", "'re", "x", " 12.5 %")


def with_edits(docs: DataFrame, n_edits: int = 4) -> DataFrame:
    """Every document with edits that its id gives, anywhere in its text."""
    size = F.length(F.coalesce(F.col("text"), F.lit("")))

    def number(k: int, what: str, most):
        return F.pmod(F.xxhash64("doc_id", F.lit(f"{what}{k}")), most).cast("long")

    inserts = F.array(*map(F.lit, INSERTS))
    edits = [F.struct(number(k, "at", size + 1).alias("at"), number(k, "remove", F.lit(12)).alias("remove"), F.element_at(inserts, (number(k, "insert", F.lit(len(INSERTS))) + 1).cast("int")).alias("insert")) for k in range(n_edits)]
    return docs.select("doc_id", "text", F.array(*edits).alias("edits"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return edited_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
