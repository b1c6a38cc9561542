"""Packing tokenised documents into training sequences: vector bin packing.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens (all but
the first of a piece, which nothing predicts, and those of a prompt). A task fills one sequence after another from a window of
waiting documents. Each step takes the document with the largest dot product of its demand and
what is left, both as shares of the limits, among those that fit whole; equal demands are looked at
once. When nothing fits whole, the longest one is cut to fill the
rest. What is left at a task's end is written as sequences whose lengths are powers of two, which need no padding.

Tokenising is per word, remembered per worker: the tokenizer drops white space and no token crosses the
end of a word. Ids, lengths and pieces come from whole texts. A task holds a window of
``WINDOW`` ids and one document's ids at a time.

Defined results: null text is empty; every document ends with the end id, so has a piece; equal rows
are packed each; documents without doc_id are packed with a null one. No rows in, no rows out.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_tasks

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
END = 2
MAX_TOKENS = 4096
MAX_SEGMENTS = 1024
MAX_LOSS = 4095
#: Ids that wait in a task's window before sequences are filled from it.
WINDOW = 64 * MAX_TOKENS
#: Words whose ids a worker remembers; when they are more it starts anew.
MEMO = 150_000
BLANKS = re.compile("[ \n\t\r]+")
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _tokenizers[path] = (Tokenizer.from_file(path), {})
    return _tokenizers[path]


#: Text of ASCII and common Latin letters, without added tokens: lower case and classes of characters make its words.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
# Fixed value: the vocabulary's word pattern, over those characters.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_characters() -> list[str]:
    """The characters that byte-level vocabularies use for bytes: printable ones are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTES = _byte_characters()


def _is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


def _words(text: str, tokenizer, memo: dict[str, bytes]) -> list[bytes]:
    """The ids of a plain text's words, in order."""
    words = WORDS.findall(text.lower())
    new = set(words).difference(memo)
    for w in new:
        mapped = w if w.isascii() else "".join(_BYTES[b] for b in w.encode())
        memo[w] = array("I", [t.id for t in tokenizer.model.tokenize(mapped)]).tobytes()
    return list(map(memo.__getitem__, words))


def encode(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text and the end id. Words of plain texts go to the vocabulary's model once per worker; of other
    texts the runs between blanks are taken apart, and those that are not plain go to the whole tokenizer."""
    tokenizer, memo = _tokenizer(path)
    end = np.array([END], "<u4").tobytes()
    for text in texts:
        if len(memo) > MEMO:
            memo.clear()
        if _is_plain(text):
            parts = _words(text, tokenizer, memo)
        else:
            parts = []
            for run in BLANKS.split(text):
                parts += _words(run, tokenizer, memo) if _is_plain(run) else [
                    np.array(tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()]
        yield np.frombuffer(b"".join(parts) + end, "<u4")


def loss_of(length: int, start: int, prompt: int) -> int:
    """Loss-bearing ids of a piece: not its first one, and not the document's first ``prompt`` ones."""
    return length - min(length, max(1, prompt - start))


class Packer:
    """Fills the sequences of one task. What waits is kept by its demand: rests of documents with equal (tokens, loss) are alike."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int):
        self.next_id, self.limits = first_id, (tokens, segments, loss)
        self.slot: dict[tuple[int, int], int] = {}
        self.queues: list[deque] = []  # by slot: (doc_id, ids, prompt, start)
        self.tokens, self.loss, self.many = (np.zeros(1024, np.int64) for _ in range(3))  # by slot
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, prompt: int = 1, start: int = 0) -> None:
        n = len(ids) - start
        demand = (n, loss_of(n, start, prompt))
        k = self.slot.get(demand)
        if k is None:
            if len(self.queues) == len(self.tokens):
                self._make_room()
            k = self.slot[demand] = len(self.queues)
            self.queues.append(deque())
            self.tokens[k], self.loss[k] = demand
        self.queues[k].append((doc_id, ids, prompt, start))
        self.many[k] += 1
        self.waiting += n

    def _make_room(self) -> None:
        """Drop slots in which nothing waits; if most are in use, double the tables."""
        used = np.flatnonzero(self.many[:len(self.queues)])
        size = 2 * len(self.tokens) if 2 * len(used) > len(self.tokens) else len(self.tokens)
        self.queues = [self.queues[k] for k in used]
        for name in ("tokens", "loss", "many"):
            grown = np.zeros(size, np.int64)
            grown[:len(used)] = getattr(self, name)[used]
            setattr(self, name, grown)
        self.slot = {(int(n), int(x)): k for k, (n, x) in enumerate(zip(self.tokens[:len(used)], self.loss[:len(used)]))}

    def _take(self, k: int):
        doc = self.queues[k].popleft()
        self.many[k] -= 1
        self.waiting -= int(self.tokens[k])
        return doc

    def fill(self, size: int) -> None:
        """One sequence of ``size`` ids."""
        max_tokens, max_segments, max_loss = self.limits
        left, segments, loss, offset = size, max_segments, min(max_loss, size), 0
        while left and self.waiting and segments:
            m = len(self.queues)
            tokens, losses = self.tokens[:m], self.loss[:m]
            fits = (self.many[:m] > 0) & (tokens <= left) & (losses <= loss)
            if segments > 1 and fits.any():
                # demand times what is left, each as a share of its limit; one segment is every demand's
                dot = tokens * (left / max_tokens ** 2) + losses * (loss / max_loss ** 2) + segments / max_segments ** 2
                k = int(np.where(fits, dot, -1).argmax())
            else:  # the longest one is cut to fill the rest
                k = int(np.where(self.many[:m] > 0, tokens, -1).argmax())
            doc_id, ids, prompt, start = self._take(k)
            length = min(len(ids) - start, left, loss + max(1, prompt - start))
            if start + length < len(ids):
                self.add(doc_id, ids, prompt, start + length)
            used = loss_of(length, start, prompt)
            self.out.append((doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids), self.next_id, offset, used))
            left, segments, loss, offset = left - length, segments - 1, loss - used, offset + length
        self.next_id += 1

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
         max_loss: int = MAX_LOSS, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence. ``max_tokens`` is a power of two.
    ``prompt`` names a column with how many of a document's first ids bear no loss (instruction data). Sequence ids are unique: the
    task's number and a number within it."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, max_tokens, max_segments, max_loss)

        def rows():
            values = list(zip(*packer.drain())) or [()] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=list(COLUMNS))

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            keys, prompts = batch.column("doc_id").to_pylist(), batch.column("prompt").to_pylist()
            for key, first, ids in zip(keys, prompts, encode(texts, tokenizer_path)):
                packer.add(key, ids, min(max(first or 1, 1), len(ids)))
                while packer.waiting >= WINDOW:
                    packer.fill(max_tokens)
            if packer.out:
                yield rows()
        while packer.waiting >= max_tokens:
            packer.fill(max_tokens)
        while packer.waiting:
            packer.fill(1 << (packer.waiting.bit_length() - 1))
        yield rows()

    first = F.col(prompt).cast("long") if prompt else F.lit(1).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), first.alias("prompt")).mapInArrow(
        run, ", ".join(f"{c} long" for c in COLUMNS))
