"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text's pre-tokens, SLOT after SLOT, are the leaves of a binary tree whose nodes hold the characters and tokens below
them. An edit is located by descending the tree; only the leaves it touches, with one that ends two characters earlier
or more and as many after it as it takes until a pre-token ends where a leaf ends, are split and counted again, and the
sums above them are updated. No leaf ever holds more than SLOT pre-tokens. A pre-token depends on no more than the two characters after it, so the counts are those of
the whole edited text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import map_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLOT = 64
EDITS = "array<struct<start:long,length:long,insert:string>>"


class Counts(dict):
    """Tokens of a pre-token, remembered; started anew beyond `most` entries."""

    def __init__(self, ranks: bytes, most: int = 300_000) -> None:
        super().__init__()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding, self.most = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), most
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = len(self.encoding._encode_single_piece(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Tree:
    """Sums of characters and tokens: two arrays in heap order, node 1 the root, leaves from half on."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = chars, tokens
        self.leaves = len(chars) // 2

    @classmethod
    def of(cls, text: str, counts: Counts) -> Tree:
        pieces = counts.pattern.findall(text)
        starts = np.arange(0, len(pieces), SLOT)
        sums = np.zeros((2, len(starts)), np.int64)
        if pieces:
            for row, values in zip(sums, (map(len, pieces), map(counts.__getitem__, pieces)), strict=True):
                row[:] = np.add.reduceat(np.fromiter(values, np.int64, len(pieces)), starts)
        return cls.over(*sums)

    @classmethod
    def over(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        """The tree over given leaves, filled up to a power of two with empty ones."""
        leaves = 1 << max(0, len(chars) - 1).bit_length()
        sums = np.zeros((2, 2 * leaves), np.int64)
        sums[0, leaves : leaves + len(chars)], sums[1, leaves : leaves + len(chars)] = chars, tokens
        at = leaves
        while at > 1:
            sums[:, at // 2 : at] = sums[:, at : 2 * at].reshape(2, -1, 2).sum(axis=2)
            at //= 2
        return cls(*sums)

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at offset (the last with any where it is the end), and where it starts."""
        node, start = 1, 0
        offset = min(offset, int(self.chars[1]) - 1)
        while node < self.leaves:
            node *= 2
            if offset >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        more = chars - int(self.chars[leaf]), tokens - int(self.tokens[leaf])
        while leaf:
            self.chars[leaf] += more[0]
            self.tokens[leaf] += more[1]
            leaf //= 2

    def edit(self, text: str, start: int, length: int, insert: str, counts: Counts) -> tuple[str, int]:
        """The edited text, and how many pre-tokens were counted again. The tree follows.

        What was counted again goes to the touched leaves and empty ones behind them, SLOT pre-tokens each; where they are too few, the
        sums are built anew over more leaves, without counting anything else again.
        """
        new = text[:start] + insert + text[start + length :]
        if not text or not new:
            fresh = Tree.of(new, counts)
            self.chars, self.tokens, self.leaves = fresh.chars, fresh.tokens, fresh.leaves
            return new, len(counts.pattern.findall(new))
        first, begin = self.leaf_at(max(0, start - 2))
        last, at = self.leaf_at(start + length)
        moved, end = len(new) - len(text), at + int(self.chars[last])  # where the leaf ends in the old text
        reached, found = begin, []
        for piece in counts.pattern.finditer(new, begin):
            reached = piece.end()
            found.append((reached - piece.start(), counts[piece[0]]))
            while end + moved < reached:
                last += 1
                end += int(self.chars[last])
            if reached == end + moved and reached >= start + len(insert):
                break
        slots = [tuple(map(sum, zip(*found[i : i + SLOT], strict=True))) for i in range(0, len(found), SLOT)]
        while len(slots) > last - first + 1 and last + 1 < 2 * self.leaves and not self.chars[last + 1]:
            last += 1
        if len(slots) <= last - first + 1:
            for leaf in range(first, last + 1):
                chars, tokens = slots[leaf - first] if leaf - first < len(slots) else (0, 0)
                if chars or self.chars[leaf]:
                    self.put(leaf, chars, tokens)
        else:
            parts = np.array([*zip(self.chars[self.leaves : first], self.tokens[self.leaves : first], strict=True), *slots, *zip(self.chars[last + 1 :], self.tokens[last + 1 :], strict=True)], np.int64)
            fresh = Tree.over(*parts[parts[:, 0] > 0].T)
            self.chars, self.tokens, self.leaves = fresh.chars, fresh.tokens, fresh.leaves
        return new, len(found)


def clamped(edit: dict, n: int) -> tuple[int, int, str]:
    start = min(max(0, edit["start"] or 0), n)
    return start, min(max(0, edit["length"] or 0), n - start), edit["insert"] or ""


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def trees(docs: DataFrame, ranks: bytes, keep: Iterable[str] = (), rows: int = 128) -> DataFrame:
    """doc_id, text, the columns `keep`, n_tokens and the tree (chars, tokens) of every row's text; null texts are empty.

    A row per row: repeated rows give repeated trees, an empty table an empty one. Columns not in `keep` are left out, and so
    is a column of `keep` that is named like one of those made here.
    """
    sent, keep = docs.sparkSession.sparkContext.broadcast(ranks), [c for c in keep if c not in ("doc_id", "text", "n_tokens", "chars", "tokens")]
    rows_of = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[docs[f"`{c.replace('`', '``')}`"] for c in keep])
    kept = "".join(f", `{c.replace('`', '``')}` {rows_of.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        counts = Counts(sent.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [Tree.of(t, counts) for t in batch.column(1).to_pylist()]
            total = pa.array([int(t.tokens[1]) for t in made], pa.int64())
            own = [pa.array([x for x in column], pa.list_(pa.int64())) for column in ([t.chars for t in made], [t.tokens for t in made])]
            return pa.RecordBatch.from_arrays([*batch.columns, total, *own], names=["doc_id", "text", *keep, "n_tokens", "chars", "tokens"])

        return apply

    return map_batches(rows_of, start, f"doc_id long, text string{kept}, n_tokens long, chars array<long>, tokens array<long>", rows)


def follow(kept: DataFrame, ranks: bytes, rows: int = 128) -> DataFrame:
    """Applies the column edits (EDITS, in order, each to the text the one before left) to the rows of trees().

    doc_id, n_tokens (before), n_edited_tokens, n_recounted (pre-tokens split and counted again), edited (the text). Starts
    and lengths beyond the text are cut to it; null edits, starts, lengths and inserts change nothing, are 0 or empty. A row
    per row: repeated rows give repeated results, other columns are left out, an empty table stays empty.
    """
    sent = kept.sparkSession.sparkContext.broadcast(ranks)

    def start():
        counts = Counts(sent.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[], [], []]
            for text, edits, chars, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), batch.column(5), strict=True):
                tree = Tree(*(np.array(x.values.to_numpy(), np.int64) for x in (chars, tokens)))
                again = 0
                for edit in edits or ():
                    if edit:
                        text, n = tree.edit(text, *clamped(edit, len(text)), counts)
                        again += n
                for column, value in zip(out, (int(tree.tokens[1]), again, text), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "n_edited_tokens", "n_recounted", "edited"])

        return apply

    return map_batches(kept.select("doc_id", "text", "edits", "n_tokens", "chars", "tokens"), start, "doc_id long, n_tokens long, n_edited_tokens long, n_recounted long, edited string", rows)


def standard_edits(text: Column) -> Column:
    """Three edits of a text: the tenth after its middle put in upper case, a note put in at a quarter, its last five
    characters cut off. An upper case of more characters (ß) makes the text longer; the last edit cuts five all the same."""
    n = F.length(text).cast("long")
    tenth = F.floor(n / 10).cast("long")
    half, note = F.floor(n / 2).cast("long"), " (see note 12)"
    upper = F.upper(F.substring(text, (half + 1).cast("int"), tenth.cast("int")))
    longer = F.length(upper).cast("long") - tenth
    edit = lambda a, b, c: F.struct(a.alias("start"), b.alias("length"), c.alias("insert"))
    return F.array(
        edit(half, tenth, upper),
        edit(F.floor(n / 4).cast("long"), F.lit(0).cast("long"), F.lit(note)),
        edit(F.greatest(F.lit(0).cast("long"), n + longer + len(note) - 5), F.lit(5).cast("long"), F.lit("")),
    )
