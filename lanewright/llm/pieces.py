"""SentencePiece encoding by a streaming Viterbi, and decoding, with a given model's pieces and scores.

The best segmentation is the one with the largest sum of piece scores. Reading a text from left to right, only states
within the longest piece of the reading position can still be extended; whenever the back-pointers of all of them run
through one boundary, the ids up to it are final and are committed, and everything before it is forgotten.

Where no piece of the model reaches over a boundary, the window is empty there: one state is left, and what follows
depends on the text only. So the ids of short stretches between two such boundaries are remembered and not made again.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # stands for a blank in pieces
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"  # ASCII signs but for _
NEVER = -float("inf")
UNKNOWN_PENALTY = 10.0  # below the least score of the model


@dataclass(frozen=True)
class PieceModel:
    """Text pieces with ids and scores, the ids of the 256 bytes, the id of unknown text, and whether a blank is put first."""

    pieces: dict[str, tuple[int, float]]
    bytes_: tuple[int, ...]
    unknown: int
    prefix: bool = True

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def load(path: str = MODEL) -> PieceModel:
    """Reads a model file on the driver. Control pieces are left out: no text yields them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    bytes_ = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return PieceModel(pieces, bytes_ if all(map(sp.is_byte, bytes_)) else (), sp.unk_id(), sp.encode_as_pieces("a")[0].startswith(SPACE))


class Encoder:
    """Encodes with one model; ids of short stretches between sure boundaries are remembered, `remember` of them at most."""

    def __init__(self, model: PieceModel, remember: int = 300_000) -> None:
        self.model, self.remember, self.known, self.older = model, remember // 2, {}, {}
        self.longest = model.longest
        self.trie: dict[str, tuple] = {}  # by next sign: what may follow, score and ids of the piece that ends with it
        for piece, (i, score) in sorted(model.pieces.items()):
            node = self.trie
            for sign in piece[:-1]:
                node = node.setdefault(sign, ({}, NEVER, b""))[0]
            node[piece[-1]] = ({}, score, array("i", [i]).tobytes())  # sorted: what begins with it comes later
        self.floor = min((s for _, s in model.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.stretches = re.compile(self.sure_boundaries()).findall

    def sure_boundaries(self) -> str:
        """A pattern of stretches that no piece reaches beyond, so that every path has a boundary at their ends.

        That is so before blanks, about line feeds, and between letters or digits and ASCII signs, if the model's pieces
        never join them; signs of letters that one does join are left out.
        """
        pieces = [p.lstrip(SPACE) for p in self.model.pieces]
        if any(SPACE in p or ("\n" in p and len(p) > 1) for p in pieces):
            return "(?s:.+)"
        joined = {c for p in pieces for a, b in zip(p, p[1:], strict=False) if (a in SIGNS) + (b in SIGNS) == 1 for c in (a, b) if c.isalnum()}
        letters, signs, gap = rf"[^\W_{re.escape(''.join(sorted(joined)))}]", f"[{re.escape(SIGNS)}]", f"[{SPACE}\\n]|\\Z"
        return rf"\n|{SPACE}*{letters}++(?={signs}|{gap})|{SPACE}*{signs}++(?={letters}|{gap})|{SPACE}*[^{SPACE}\n]+|{SPACE}+"

    def unknown(self, sign: str) -> list[int]:
        return [self.model.bytes_[b] for b in sign.encode("utf-8")] if self.model.bytes_ else [self.model.unknown]

    def stream(self, text: str):
        """Yields the ids of each committed stretch of text. Blanks are already SPACE.

        A stretch is committed as soon as one state is left, else at the last boundary common to all paths, looked for
        whenever `longest` more characters have been read. States before the committed boundary are forgotten, so the window
        grows beyond twice the longest piece only while paths differ for longer.
        """
        n, longest, floor, trie = len(text), self.longest, self.floor, self.trie
        start, i, far, room = 0, 0, 0, min(len(text), 2 * longest)  # the window starts at a boundary where all paths meet
        score, back, taken = [0.0] + [NEVER] * room, [0] * (room + 1), [b""] * (room + 1)
        while start + i < n:
            if i + longest > room and start + room < n:
                common = self.converged(back, [x for x in range(i, far + 1) if score[x] != NEVER])
                if common:
                    yield self.ids(back, taken, common)
                    score, back, taken = [x - score[common] for x in score[common:]], [x - common for x in back[common:]], taken[common:]
                    start, i, far, room = start + common, i - common, far - common, room - common
                more = min(n - start, i + 2 * longest) - room
                score, back, taken, room = score + [NEVER] * more, back + [0] * more, taken + [b""] * more, room + more
            here, node, j = score[i], trie, i
            for sign in text[start + i : start + i + longest]:
                found = node.get(sign)
                if found is None:
                    break
                j += 1
                node, more, ids = found
                more += here
                if more > score[j]:
                    score[j], back[j], taken[j] = more, i, ids
                    if j > far:
                        far = j
            i += 1
            if here + floor > score[i]:
                score[i], back[i], taken[i] = here + floor, i - 1, array("i", self.unknown(text[start + i - 1])).tobytes()
                far = max(far, i)
            if far == i:
                yield self.ids(back, taken, i)
                start, i, far, room = start + i, 0, 0, min(n - start - i, 2 * longest)
                score, back, taken = [0.0] + [NEVER] * room, [0] * (room + 1), [b""] * (room + 1)

    @staticmethod
    def converged(back: list[int], open_: list[int]) -> int:
        """The last boundary that the paths of all open states run through; 0 where it is the one the window starts at."""
        ends = set(open_)
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(back[last])
        return ends.pop()

    @staticmethod
    def ids(back: list[int], taken: list[bytes], end: int) -> bytes:
        out = []
        while end:
            out.append(taken[end])
            end = back[end]
        return b"".join(out[::-1])

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch, remembered for a while where it is short: the older half is forgotten when both are full."""
        ids = self.older.get(text)
        if ids is None:
            ids = b"".join(self.stream(text))
        if len(text) <= 64:
            if len(self.known) >= self.remember:
                self.known, self.older = {}, self.known
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null and empty ones. A SPACE sign of the text itself goes as bytes, not as a blank."""
        out = []
        for n, part in enumerate((text or "").split(SPACE)):
            if n:
                out.append(array("i", self.unknown(SPACE)).tobytes())
            part = part.replace(" ", SPACE)
            if not n and text and self.model.prefix:
                part = SPACE + part
            out += [self.known.get(x) or self.stretch(x) for x in self.stretches(part)]
        return np.frombuffer(b"".join(out), "<i4")


class Decoder:
    def __init__(self, model: PieceModel) -> None:
        self.prefix = model.prefix
        self.of = {i: p.replace(SPACE, " ").encode("utf-8") for p, (i, _) in model.pieces.items()}
        self.of |= {i: bytes([b]) for b, i in enumerate(model.bytes_)} | {model.unknown: " ⁇ ".encode()}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that the model lacks or that are control pieces say nothing."""
        raw = b"".join([self.of.get(i, b"") for i in ids])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model: PieceModel, rows: int = 128) -> DataFrame:
    """doc_id, ids: a row per row, in no order. Null and empty texts have no ids; texts are read whole, in a window.

    Of equally good segmentations the one found first stays, with the longer piece at the later boundary, so equal texts and
    repeated rows give equal ids. Columns other than doc_id and text are left out; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        encoder = Encoder(sent.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *ids]), pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

        return apply

    return map_batches(docs.select("doc_id", "text"), start, "doc_id long, ids array<int>", rows)


def decode(encoded: DataFrame, model: PieceModel, rows: int = 128) -> DataFrame:
    """doc_id, ids, text: the text that the ids stand for; empty for none and for null.

    A row per row; repeated rows give repeated results, other columns are left out, an empty table stays empty.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def start():
        decoder = Decoder(sent.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [decoder.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

        return apply

    return map_batches(encoded.select("doc_id", "ids"), start, "doc_id long, ids array<int>, text string", rows)


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.lower(F.hex(F.xxhash64("ids"))).alias("ids_hash"),
        F.length("text").cast("long").alias("n_decoded"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
