"""Operator 8, packing: minimum bin slack with a bitset subset-sum dynamic program."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from irloom.llm.common import by_bytes, documents, id_and_text

#: A sequence holds at most so many tokens.
CAPACITY = 2048
#: A window of remainders is packed when it holds POOL of them, until HALF are left; at most POOL * CAPACITY ids wait.
POOL, HALF = 512, 256
#: A task forgets the words it has met when they are more than this.
WORDS = 400_000
#: New words are encoded so many at a time.
TOGETHER = 64
#: Texts are encoded in batches of about so many bytes, or one text.
BATCH_BYTES = 4 << 20
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: Counter, room: int) -> Counter:
    """The multiset of lengths within counts whose sum comes closest to room from below.

    Bit s of a step's bitset says that s can be made of the lengths so far; each length enters in
    binary shares of its count, so a step is one shift.  Walking back through the steps gives the
    counts.
    """
    steps, reach, mask = [], 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, share = counts[length], 1
        while left > 0 and length * min(share, left) <= room:
            n = min(share, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, share = left - n, share * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] += n
            at -= length * n
    return used


#: What lower-casing and normalising leave as letters, one by one, with at most one stop behind them.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


class WordIds:
    """Ids of texts word by word: this tokenizer's pieces never cross a space or line feed.

    A batch's words are numbered by a dictionary of its distinct words; new ones are encoded together
    and remembered, and the ids of all words are gathered at once.  Words of Latin letters, with or
    without a stop, are lower-cased here and skip the tokenizer's own normalising and splitting,
    which would change nothing; a piece's last token tells where it ends.  All others, such as words
    with marks or letters that lower-casing makes longer, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.ends = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain_ids(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words that match PLAIN, and how many each has."""
        pieces = pc.replace_substring_regex(pc.utf8_lower(words), r"([.,])$", r" \1")
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), TOGETHER), len(pieces)], pa.int32()), pieces)
        texts = pc.binary_join(groups, " ").to_pylist()
        parts = [x for t in texts for x in self.encode(self.ascii if t.isascii() else self.letters, [t])]
        ends = np.flatnonzero(self.is_end[np.concatenate(parts)]) + 1
        lasts = np.cumsum(1 + pc.match_substring(pieces, " ").to_numpy(zero_copy_only=False)) - 1
        if len(ends) != lasts[-1] + 1:
            raise ValueError("the tokenizer does not mark the ends of its words with </w>")
        return parts, np.diff(ends[lasts], prepend=0)

    def learn(self, new: pa.Array) -> None:
        """Numbers new words and keeps their ids."""
        plain = pc.match_substring_regex(new, PLAIN)
        letters, rest = new.filter(plain), new.filter(pc.invert(plain))
        parts, sizes = self.plain_ids(letters) if len(letters) else ([], np.zeros(0, np.int64))
        others = self.encode(self.tokenizer, [w.decode("utf-8", "replace") for w in rest.cast(pa.binary()).to_pylist()])
        for words in (letters, rest):
            first = len(self.number)
            self.number.update(zip(as_bytes(words), range(first, first + len(words)), strict=True))
        sizes = np.concatenate([sizes, np.array([len(x) for x in others], np.int64)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, *parts, *others])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), one text behind the other, and where each text's ids end."""
        if len(self.number) > WORDS:
            self.forget()
        special = pc.match_substring(texts, "<|")  # may hold the tokenizer's special tokens, whose case counts
        folded = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        split = pc.split_pattern(pc.replace_substring(folded, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        distinct = as_bytes(words.dictionary)
        number = list(map(self.number.get, distinct))
        if missing := [i for i, n in enumerate(number) if n is None]:
            self.learn(words.dictionary.take(pa.array(missing)))
            for i in missing:
                number[i] = self.number[distinct[i]]
        of_word = np.array(number, np.int64)[words.indices.to_numpy()]
        start = self.ends[of_word]
        size = self.ends[of_word + 1] - start
        behind = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - behind[:-1], size) + np.arange(behind[-1])
        return self.ids[at], behind[np.cumsum(pc.list_value_length(split).to_numpy())]


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Packer:
    """Packs the documents of one task; emits pieces column by column."""

    def __init__(self, first_sequence: int):
        self.next, self.rows, self.pool, self.size = first_sequence, [], defaultdict(list), 0

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, data, total in pieces:
            n = len(data) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(data), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, data: bytes) -> None:
        n = len(data) // 4
        whole = n - n % CAPACITY
        for start in range(0, whole, CAPACITY):
            self.emit([(doc_id, start, data[4 * start : 4 * (start + CAPACITY)], n)])
        if n > whole:
            self.pool[n - whole].append((doc_id, whole, data[4 * whole :], n))
            self.size += 1
        if self.size >= POOL:
            while self.size > HALF:
                self.window()

    def take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.size -= 1
        return piece

    def window(self) -> None:
        """One sequence: the longest remainder, and those that leave the least slack beside it; slack is then cut from another."""
        longest = max(self.pool)
        pieces, room = [self.take(longest)], CAPACITY - longest
        for length, n in fill(Counter({k: len(v) for k, v in self.pool.items()}), room).items():
            for _ in range(n):
                pieces.append(self.take(length))
                room -= length
        if room and self.pool:
            doc_id, start, data, total = self.take(max(self.pool))
            pieces.append((doc_id, start, data[: 4 * room], total))
            self.pool[len(data) // 4 - room].append((doc_id, start + room, data[4 * room :], total))
            self.size += 1
        elif room:
            return self.tail(pieces)
        self.emit(pieces)

    def tail(self, pieces: list[tuple]) -> None:
        """The task's last tokens go to sequences whose lengths are powers of two, which need no padding."""
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            want, now = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                doc_id, start, data, total = pieces.pop()
                n = min(want, len(data) // 4)
                now.append((doc_id, start, data[: 4 * n], total))
                if len(data) > 4 * n:
                    pieces.append((doc_id, start + n, data[4 * n :], total))
                want -= n
            self.emit(now)

    def taken(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the tokenizer's ids of its text (null: empty) and END.  Each task packs the rows
    it reads, in windows, so nothing is shuffled and at most POOL remainders wait; a document of
    more than CAPACITY ids fills sequences of its own and leaves one remainder.  sequence_id holds
    the task's number and a count, the same when a task runs again.  Repeated rows are packed
    again, null ids stay null, empty tables give no rows, other columns are not read.
    tokenizer_path: the vocabulary file, by default that of the installed public tokenizers.
    """

    def run(batches):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode = WordIds(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        packer = Packer(TaskContext.get().partitionId() << 33)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in by_bytes(batch, BATCH_BYTES):
                ids, ends = encode(part.column(1))
                for doc_id, a, z in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    packer.add(doc_id, ids[a:z].tobytes() + end)
            batch = part = ids = None  # let go of it before the next one arrives
            yield packer.taken()
        while packer.size:
            packer.window()
        yield packer.taken()

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def op8_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


SQL = None
