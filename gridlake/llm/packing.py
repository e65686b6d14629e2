"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

A document's ids (and one closing id) are cut into full pieces of `size` and one rest. The histogram of piece lengths
has at most `size` bins, so it is small whatever the input; on it, lengths are placed longest first, each time into the
pack with the most room left (the shortest pack), which only changes counts of packing patterns. Each pattern then
stands for a run of sequences, and a piece finds its sequence and offset from the rank it has among pieces of its length.

Ranks are counted without a sort of equal lengths: a piece keeps its index within its writing task, and tasks' counts
are added up by length, so a length that a third of the pieces share is no hot group.

Defined results: null or empty text is one piece with the closing id alone; repeated rows are packed each; an empty table
gives no rows; very long texts are cut into as many pieces as they need; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import keep, slices, stored

SIZE = 2048
END_ID = 1
CACHE_CHUNKS = 200_000
LONG_CHUNK = 1000  # bytes; the plain merge is quadratic in a word, the tokenizer's own is not
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of chunks between ASCII white space, as little-endian bytes; the same ids as the tokenizer file gives.

    No token of this tokenizer crosses white space, so a chunk's ids stand by themselves and are remembered. The word end
    is a byte that UTF-8 lacks, which makes the vocabulary one of plain byte merges."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type") != "BPE" or spec["model"].get("end_of_word_suffix") != "</w>" or '"Lowercase"' not in json.dumps(spec["normalizer"]) or '"NFC"' not in json.dumps(spec["normalizer"]):
            raise ValueError(f"{path} is no lower-casing NFC word BPE, which is what these rules are for")
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = _byte_alphabet()
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith("</w>") and token != "</w>"
                body = token[:-4] if ends else token
                ranks[bytes(byte_of[c] for c in body) + b"\xff" * ends] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = regex.compile(WORDS).findall
        self.marks = [s.encode() for s in special]

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        text = chunk.decode()
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        if len(chunk) > LONG_CHUNK:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = []
        for word in self.words(text):
            ids += self.merge(word.encode() + b"\xff")
        got = self[chunk] = np.array(ids, "<u4").tobytes()
        return got

    def ids(self, text: bytes) -> bytes:
        if any(m in text for m in self.marks):
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_ids(path: str) -> WordIds:
    return keep(("words", path), lambda: WordIds(path))


def _pieces_task(path: str | None, size: int):
    def run(batches):
        encode = word_ids(path or default_tokenizer()).ids
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen = [0] * (size + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            out = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                ids = encode(text or b"") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    for name, value in (("doc_id", doc), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(ids[4 * start : 4 * (start + length)])), ("doc_tokens", total), ("task", task), ("nth", seen[length])):
                        out[name].append(value)
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that hold every piece of the histogram; lengths of a pattern add up to size at most."""
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left:
            while room >= length and not packs.get(room):
                room -= 1
            if room < length:
                each = size // length  # a new pack is the shortest one until no piece of this length fits
                full, rest = divmod(left, each)
                packs[size - each * length] += [(full, (length,) * each)] * (full > 0)
                packs[size - rest * length] += [(1, (length,) * rest)] * (rest > 0)
                break
            count, pattern = packs[room].pop()
            used = min(count, left)
            if count > used:
                packs[room].append((count - used, pattern))
            packs[room - length].append((used, (*pattern, length)))
            left -= used
            # what was just filled stays behind: its room is smaller than the room being looked at
    return [p for room in sorted(packs) for p in packs[room]]


def _runs(patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: upper rank, sequence less rank, and offset of each run of slots."""
    found, upto, base = defaultdict(list), defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            found[length].append((upto[length] + count, base - upto[length], offset))
            upto[length] += count
            offset += length
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long)."""
    fields = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth")
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_pieces_task(tokenizer, size), ", ".join(f"{f} long" for f in fields)), "packing-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = docs.sparkSession.sparkContext.broadcast(_runs(shortest_pack_first(histogram, size)))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine = length == one
                upto, shift, at = runs.value[int(one)]
                run = np.searchsorted(upto, rank[mine], "right")
                sequence[mine], offset[mine] = shift[run] + rank[mine], at[run]
            kept = [batch.column(f) for f in fields[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*fields[:5], "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["length", "task"]).select(*fields[:5], (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{f} long" for f in (*fields[:5], "sequence_id", "offset")))


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
