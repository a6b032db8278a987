"""Packing documents into sequences, balanced by attention cost.

A task tokenizes its share of the documents and packs it group by group, a group holding a bounded number
of tokens: nothing is shuffled, and no group grows with the data. A piece of n tokens costs
linear * n + quadratic * n * n. Descending, each document goes to the sequence of the lowest cost that has
room; where none has room for the whole, it is cut and fills the cheapest ones.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

#: Words whose ids a worker remembers; it then starts anew. Bytes of text that it works on at a time. Several workers share
#: an executor's memory with a JVM that earlier work has grown, so both are small: a word takes some 150 bytes, a byte of text 20.
REMEMBERED, SLICE = 200_000, 4 << 20

#: The normaliser and pre-tokenizer under which a text's ids are those of its parts between white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


class WordIds:
    """Ids of texts by a tokenizer file, word by word where the file allows it, else text by text.

    The tokenizer of the contract drops white space, its normaliser never works across it, so the ids of
    a text are those of its parts between ASCII white space. Each distinct part of a batch is encoded once.
    It lower-cases and starts a new part where a letter ends, too, so ASCII is lower-cased here and a space
    put between a letter and a full stop, comma or sign: that makes far fewer distinct parts. Texts with
    the beginning of a special token's string are left as they are. Any file with another normaliser,
    pre-tokenizer or kind of special token gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_word = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and not file["model"].get("dropout") and all(t["content"].startswith("<|") for t in file["added_tokens"])

    def of_words(self, unique: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [w for w in unique if w not in known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, e in zip(part, self.encode(part, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()
        return [known[w] for w in unique]

    def of_texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, each with ``end`` behind it; and where each text ends."""
        texts = texts.fill_null("")
        if not self.by_word:
            each = [np.array([*e.ids, end], np.uint32) for e in self.encode(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(each) if each else np.zeros(0, np.uint32), np.cumsum([len(x) for x in each])
        folded = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z\u00df-\u00f6\u00f8-\u00ff])([.,#$%&*])", r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, folded))
        flat = lists.flatten().dictionary_encode()
        ids = self.of_words(flat.dictionary.to_pylist())
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else np.zeros(0, np.int64)
        words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each = sizes[words]
        total = np.concatenate([[0], np.cumsum(each)])
        tokens = table[np.repeat(starts[words] - total[:-1], each) + np.arange(total[-1])]
        ends = total[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))] if len(lists) else np.zeros(0, np.int64)
        return np.insert(tokens, ends, end).astype(np.uint32), ends + 1 + np.arange(len(ends))


def sequence_sizes(total: int, most: int) -> list[int]:
    """Full sequences, and for the rest powers of two, which need no padding."""
    rest = total % most
    return [most] * (total // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], most: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int, float]]:
    """Pieces (document, start, length, sequence, offset, cost) of one group.

    Whole stretches of ``most`` tokens are sequences of their own. The room of all sequences is the number
    of all tokens, so every sequence ends full and each token lies in one piece. Ties: the earlier
    document, the earlier sequence.
    """
    sizes = np.array(sequence_sizes(sum(lengths), most), np.int64)
    room, cost, out = sizes.copy(), np.zeros(len(sizes)), []
    price = lambda n: linear * n + quadratic * n * n

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(sizes[seq] - room[seq]), price(n)))
        room[seq] -= n
        cost[seq] += price(n)

    taken, rest = 0, []
    for doc, n in enumerate(lengths):
        for k in range(n // most):
            put(doc, k * most, most, taken)
            taken += 1
        if n % most:
            rest.append((-(n % most), doc, n - n % most))
    for minus, doc, start in sorted(rest):
        n = -minus
        while n:
            fits = np.flatnonzero(room[taken:] >= n)
            able = fits if len(fits) else np.flatnonzero(room[taken:])
            seq = taken + int(able[np.argmin(cost[taken:][able])])
            part = min(n, int(room[seq]))
            put(doc, start, part, seq)
            start, n = start + part, n - part
    return out


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", most: int = 4096, end: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096, group_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece: PIECES, where ids holds the piece's ids as little-endian unsigned 32-bit numbers.

    ``tokenizer``: the path of a tokenizers file that every executor has. sequence_id is unique; within a
    sequence the offsets are gapless from 0. Defined results: a null text is an empty one, whose only id is
    ``end``; rows that share a key are packed each on its own; a null key stays null; an empty table gives
    no piece. A group is closed after ``group_tokens`` tokens (a longer document is a group of its own).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base = WordIds(tokenizer), TaskContext.get().partitionId() << 33
        keys, tokens, held, sequence = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal sequence
            got = assign([len(x) for x in tokens], most, linear, quadratic)
            columns = [[keys[d] for d, *_ in got], [s for _, s, *_ in got], [n for _, _, n, *_ in got], [tokens[d][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in got], [len(tokens[d]) for d, *_ in got], [base + sequence + q for _, _, _, q, *_ in got], [o for *_, o, _ in got], [c for *_, c in got]]
            sequence += len(sequence_sizes(held, most))
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.float64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part in slices(batches, 1, SLICE):
            flat, ends = ids.of_texts(part.column(1), end)
            for k, own in zip(part.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                keys.append(k)
                tokens.append(own)
                held += len(own)
                if held >= group_tokens:
                    yield closed()
                    keys, tokens, held = [], [], 0
            release()
        if keys:
            yield closed()

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)
