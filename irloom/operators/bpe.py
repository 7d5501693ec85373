"""Byte-pair merges learned on the table of distinct words, and encoding by distinct word."""

from __future__ import annotations

import heapq
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.functions.text import PRETOKEN, pretokens
from irloom.operators.tables import pair_counts, top_pairs, word_counts
from irloom.plans.session import ensure_checkpoint_dir

# Special tokens, which take the first ids.
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>", "<mask>", "<func>", "</func>", "<bb>", "<HEX_CONST>")
# Tokens that are matched whole before words are split, and those that a vocabulary should have.
ATOMIC = ("<func>", "<bb>", "<var>", "<const>", "<MED_INT>", "<LARGE_INT>", "<HUGE_INT>", "<HEX_CONST>", "<FLOAT_CONST>", "<STRING_CONST>")
EXPECTED = ("<pad>", "<unk>", "<bos>", "<eos>", "<mask>", *ATOMIC)


#: PRETOKEN with the white space of Spark's patterns, which is that of ASCII, so that words are encoded as they are counted.
WORD = PRETOKEN.replace(r"\s", r" \t\n\x0b\f\r")
#: So many rounds of merges are made anew from the last stored words.
STORED = 8


def apply_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's symbols after all merges, the lowest rank first, each from the left.

    Neighbours wait in a heap by rank and place, and merging two looks at their neighbours only, so
    a word of n symbols takes n log n steps.
    """
    parts: list[str | None] = list(symbols)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (rank := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (rank, a, parts[a], parts[b]))
    return [p for p in parts if p is not None]


def merged(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """A table of distinct words with its column symbols merged; the merges, fewer than a vocabulary, go to every task."""
    names, ranks = words.columns, {m: i for i, m in enumerate(merges)}
    at = names.index("symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = pa.array([apply_merges(s, ranks) for s in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([symbols if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return words.mapInArrow(run, words.schema)


def independent(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of pairs, in order, those that share no symbol with one taken before, so that merging one changes no other's count."""
    used: set[str] = set()
    out = []
    for left, right in pairs:
        if not used & {left, right}:
            out.append((left, right))
            used |= {left, right}
    return out


#: Up to so many characters of distinct words, merges are learned in one task that keeps an index of their pairs.
INDEXED = 1 << 28
#: Characters that are indexed at once.
CHUNK = 1 << 22


def joined(symbols: list[str], left: str, right: str) -> list[str]:
    """Symbols with each pair of left and right, taken from the left, made one."""
    out: list[str] = []
    i, n = 0, len(symbols)
    while i < n:
        if symbols[i] == left and i + 1 < n and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def learn_merges(words: list[list[str]], counts: list[int], n_merges: int, least: int) -> list[tuple[str, str]]:
    """The merges of distinct words (lists of symbols) in order, the most frequent pair first, ties by its text.

    An index tells which words hold a pair; a merge counts anew the pairs of those words alone, and
    a heap holds each pair's latest count.
    """
    total: Counter = Counter()
    holds: defaultdict = defaultdict(set)

    for w, symbols in enumerate(words):
        for p in zip(symbols, symbols[1:], strict=False):
            total[p] += counts[w]
            holds[p].add(w)
    heap = [(-n, *p) for p, n in total.items() if n >= least]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    while heap and len(out) < n_merges:
        n, left, right = heapq.heappop(heap)
        pair = (left, right)
        if total[pair] != -n:
            continue  # an older count
        out.append(pair)
        changed: set[tuple[str, str]] = set()
        for w in holds.pop(pair):
            old, new = words[w], joined(words[w], left, right)
            before, after = list(zip(old, old[1:], strict=False)), list(zip(new, new[1:], strict=False))
            for p in before:
                total[p] -= counts[w]
            for p in after:
                total[p] += counts[w]
            had, has = set(before), set(after)
            for p in had - has:
                if p != pair:
                    holds[p].discard(w)
            for p in has - had:
                holds[p].add(w)
            words[w] = new
            changed |= had | has
        for p in changed:
            if total[p] >= least:
                heapq.heappush(heap, (-total[p], *p))
            elif not total[p]:
                del total[p]
                holds.pop(p, None)
    return out


def distinct(places: list[np.ndarray]) -> np.ndarray:
    """The places of some lists in order, each once; lists in order themselves are merged."""
    x = np.sort(np.concatenate(places), kind="stable")
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class WordIndex:
    """Distinct words as one array of symbols, and where each pair of neighbours begins.

    A symbol's number stands at its first and at its last place, 0 within it and between words; so
    its neighbours are found by lengths.  A merge looks at the places of its pair only, all at once;
    places that a pair has lost stay in its list and are passed over.
    """

    def __init__(self, batches: Iterator[tuple[list[str], np.ndarray]]):
        flat, counts, sizes = [], [], []
        for words, n in batches:
            if len(words):
                flat.append(np.frombuffer(("\n" + "\n".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32))
                sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
                counts.append(n)
        empty = np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else empty
        self.counts, self.starts = np.concatenate(counts) if counts else empty, np.cumsum(size + 1) - size - 1
        chars = np.unique(np.concatenate([np.unique(f) for f in flat] + [np.array([10], np.uint32)]))
        chars = np.concatenate([[10], chars[chars != 10]]).astype(np.uint32)  # what stands between words is symbol 0
        self.texts = ["", *(chr(c) for c in chars[1:].tolist())]
        self.numbers = {t: i for i, t in enumerate(self.texts)}
        self.lengths = np.ones(1024 + len(chars), np.int64)
        order = np.argsort(chars)
        self.symbols = np.zeros(sum(map(len, flat)) + 1, np.int32)
        at = 0
        for k, f in enumerate(flat):
            self.symbols[at : at + len(f)] = order[np.searchsorted(chars[order], f)]
            at += len(f)
            flat[k] = empty
        self.total: defaultdict = defaultdict(int)
        self.places: defaultdict = defaultdict(list)
        for at in range(0, len(self.symbols), CHUNK):
            self.add(np.arange(at, min(at + CHUNK, len(self.symbols) - 1)))

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of symbols those with a neighbour behind them, and their pairs."""
        left = self.symbols[at]
        right = self.symbols[at + self.lengths[left]]
        there = (left > 0) & (right > 0)
        return at[there], (left[there].astype(np.int64) << 32) | right[there]

    def grouped(self, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Each pair at these places, in how many words of the text it is there, and where."""
        at, keys = self.pairs(at)
        if not len(at):
            return
        weights = self.counts[np.searchsorted(self.starts, at, "right") - 1]  # while places are in order
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(weights[order], first)
        ends = [*first[1:].tolist(), len(at)]
        at = at.astype(np.int32)
        for key, n, a, z in zip(keys[first].tolist(), sums.tolist(), first.tolist(), ends, strict=True):
            yield key, n, at[a:z]

    def add(self, at: np.ndarray) -> list[int]:
        changed = []
        for key, n, where in self.grouped(at):
            self.total[key] += n
            self.places[key].append(where.copy())
            changed.append(key)
        return changed

    def merge(self, key: int) -> list[int]:
        """Makes a pair one symbol wherever it is, from the left; the pairs whose counts have changed."""
        a, b = key >> 32, key & 0xFFFFFFFF
        text = self.texts[a] + self.texts[b]
        c = self.numbers.setdefault(text, len(self.texts))
        if c == len(self.texts):
            self.texts.append(text)
            if c >= len(self.lengths):
                self.lengths = np.concatenate([self.lengths, np.ones(len(self.lengths), np.int64)])
            self.lengths[c] = len(text)
        n_a, n_b = self.lengths[a], self.lengths[b]
        found = self.places.pop(key)
        i = distinct(found).astype(np.int64)
        i = i[self.symbols[i] == a]
        i = i[self.symbols[i + n_a] == b]
        if a == b and len(i):  # of a run every other one
            no = np.arange(len(i))
            begins = np.concatenate([[True], i[1:] != i[:-1] + n_a])
            i = i[(no - np.maximum.accumulate(np.where(begins, no, 0))) % 2 == 0]
        j = i + n_a
        before = i - self.lengths[self.symbols[i - 1]]
        before = before[self.symbols[i - 1] > 0]
        changed = []
        for pair, n, _ in self.grouped(distinct([before, i, j])):
            self.total[pair] -= n
            changed.append(pair)
        self.symbols[j - 1] = 0
        self.symbols[j] = 0
        self.symbols[i] = c
        self.symbols[j + n_b - 1] = c
        before = i - self.lengths[self.symbols[i - 1]]
        before = before[self.symbols[i - 1] > 0]
        return changed + self.add(distinct([before, i]))


def learn_by_index(batches: Iterator[tuple[list[str], np.ndarray]], n_merges: int, least: int) -> list[tuple[str, str]]:
    """learn_merges of batches of distinct words and their counts, by arrays: all places of a pair are merged at once."""
    index = WordIndex(batches)
    entry = lambda key: (-index.total[key], index.texts[key >> 32], index.texts[key & 0xFFFFFFFF], key)
    heap = [entry(key) for key, n in index.total.items() if n >= least]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    while heap and len(out) < n_merges:
        n, left, right, key = heapq.heappop(heap)
        if index.total.get(key) != -n:
            continue  # an older count
        out.append((left, right))
        changed = index.merge(key)
        for k in dict.fromkeys(changed):
            if index.total[k] >= least:
                heapq.heappush(heap, entry(k))
            elif not index.total[k]:
                del index.total[k]
                index.places.pop(k, None)
    return out


def train_merges(docs: DataFrame, n_merges: int, least: int = 2, text: str = "text", together: int = 1) -> list[tuple[str, str]]:
    """The merges in order, by their exact counts; at most n_merges of them reach the driver.

    Words are counted once, in a shuffle.  Up to INDEXED characters of distinct words then stream to
    one task, which learns all merges with an index of pairs (learn_by_index).  Beyond that each
    merge is a round over the partitioned words: it counts pairs over distinct words and takes the
    most frequent one (ties: by its text); every STORED rounds the words are stored as merged so
    far.  With `together` above 1 a round takes up to so many pairs that share no symbol: fewer
    rounds, but a pair may be taken before one that shares a symbol with it or becomes more frequent
    in the round, so the merges are no longer the exact ones.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    parts = docs.sparkSession.sparkContext.defaultParallelism
    words = word_counts(docs, text).select("word", "n").checkpoint()
    if together == 1 and (words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) <= INDEXED:

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges = learn_by_index(((b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.int64)) for b in batches), n_merges, least)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(merges)), pa.int32()), pa.array([m[0] for m in merges], pa.string()), pa.array([m[1] for m in merges], pa.string())], names=["rank", "left", "right"])

        rows = words.coalesce(1).mapInArrow(learn, "rank int, left string, right string")  # of a checked size
        return [(r["left"], r["right"]) for r in sorted(rows.collect())]
    words = words.repartition(parts, "word").select("n", F.split("word", "").alias("symbols")).checkpoint()
    done: list[tuple[str, str]] = []
    new: list[tuple[str, str]] = []
    for number in itertools.count(1):
        now = merged(words, new) if new else words
        best = [(r["left"], r["right"]) for r in top_pairs(pair_counts(now), together, least).collect()]
        new = new + independent(best)[: n_merges - len(done) - len(new)]
        if not best or len(done) + len(new) == n_merges:
            return done + new
        if number % STORED == 0:
            words, done, new = merged(words, new).checkpoint(), done + new, []


def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters of a task's texts but white space, which are those of its words."""
    seen: set[str] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(text or "")
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen - set(" \t\n\x0b\f\r")), pa.string())], names=["token"])


def vocabulary(docs: DataFrame, merges: list[tuple[str, str]], text: str = "text", atomic: tuple[str, ...] = ()) -> DataFrame:
    """token, id: special tokens, then characters by code point, then merged symbols in order.

    Tokens named in atomic are matched whole; those that occur come among the characters.
    """
    spark = docs.sparkSession
    if atomic:
        words = docs.select(F.explode(pretokens(F.col(text), atomic)).alias("word")).distinct()
        chars = words.select(F.explode(F.when(F.col("word").isin(*atomic), F.array("word")).otherwise(F.split("word", ""))).alias("token")).distinct().where("token <> ''").select(F.lit(1).alias("kind"), F.lit(0).alias("at"), "token")
    else:
        chars = docs.select(text).mapInArrow(characters, "token string").distinct().select(F.lit(1).alias("kind"), F.lit(0).alias("at"), "token")
    fixed = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIALS)] + [(2, i, a + b) for i, (a, b) in enumerate(merges)], "kind int, at int, token string")
    firsts = fixed.unionByName(chars).groupBy("token").agg(F.min(F.struct("kind", "at")).alias("k"))
    return firsts.select("token", (F.row_number().over(W.orderBy("k.kind", "k.at", "token")) - 1).alias("id"))  # as many rows as the vocabulary


def single_template(ids: Column, bos: int = 0, eos: int = 2) -> Column:
    """<s> ids </s>."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def pair_template(a: Column, b: Column, bos: int = 0, eos: int = 2) -> Column:
    """input_ids of two texts, each between <s> and </s>, and segment_ids, 0 for the first and 1 for the second."""
    return F.struct(F.concat(single_template(a, bos, eos), single_template(b, bos, eos)).alias("input_ids"), F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 2)).alias("segment_ids"))


def plain_vocabulary(characters: str, merges: list[tuple[str, str]]) -> dict[str, int]:
    """Ids as vocabulary gives them, for given characters in place of those of a corpus."""
    return {t: i for i, t in enumerate(dict.fromkeys([*SPECIALS, *sorted(set(characters)), *(a + b for a, b in merges)]))}


class Encoder:
    """Merges and ids as plain tables, which are no larger than a vocabulary, to encode texts within tasks.

    Atomic tokens that the vocabulary lacks take the ids behind it, in their order, or without
    extend are <unk>.
    """

    #: Words whose tokens a task remembers; characters of texts whose ids it remembers, and the longest of them.
    REMEMBERED, TEXTS, LONGEST = 200_000, 4_000_000, 20_000

    def __init__(self, merges: list[tuple[str, str]], vocab: DataFrame | dict[str, int], atomic: tuple[str, ...] = ATOMIC, extend: bool = True):
        self.ids = dict(vocab) if isinstance(vocab, dict) else {r["token"]: r["id"] for r in vocab.collect()}  # one row for each token of the vocabulary
        self.ranks, self.atomic = {m: i for i, m in enumerate(merges)}, atomic
        for t in atomic if extend else ():
            self.ids.setdefault(t, max(self.ids.values(), default=-1) + 1)
        self.known: dict[str, tuple[list[int], list[int]]] = {}
        self.texts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = 0

    def tokens_of(self, word: str) -> tuple[list[int], list[int]]:
        """Ids and lengths of a word's tokens."""
        if word not in self.known:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            parts = [word] if word in self.atomic else apply_merges(list(word), self.ranks)
            self.known[word] = [self.ids.get(p, SPECIALS.index("<unk>")) for p in parts], [len(p) for p in parts]
        return self.known[word]

    def encode_ids(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """The ids of encode, without places; null counts as empty."""
        import regex

        words = regex.compile(WORD)
        whole = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.atomic, key=len, reverse=True)) + ")") if self.atomic else None
        known = self.known
        for text in texts:
            ids = [SPECIALS.index("<s>")]
            for i, part in enumerate(whole.split(text or "") if whole else [text or ""]):
                for word in [part] if i % 2 else words.findall(part):  # every other part is an atomic token
                    ids += (known.get(word) or self.tokens_of(word))[0]
            yield np.array([*ids, SPECIALS.index("</s>")], np.int32)

    def encode_again(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode, remembered for texts that come again, as normalised functions do."""
        found = self.texts.get(text)
        if found is None:
            found = self.encode(text)
            if len(text) <= self.LONGEST:
                if self.held + len(text) > self.TEXTS:
                    self.texts.clear()
                    self.held = 0
                self.texts[text] = found
                self.held += len(text)
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids between <s> and </s>, and each token's first place and the place behind its last one, in code points; (0, 0) for these two."""
        import regex

        ids, sizes, starts, counts = [], [], [], []
        words = regex.compile(WORD)
        whole = regex.compile("|".join(regex.escape(t) for t in sorted(self.atomic, key=len, reverse=True)) or r"(?!)")
        done = 0
        for atomic in [*whole.finditer(text), None]:  # atomic tokens first, words in what lies between
            upto = atomic.start() if atomic else len(text)
            for m in [*words.finditer(text, done, upto), *([atomic] if atomic else [])]:
                word_ids, lengths = self.tokens_of(m[0])
                ids += word_ids
                sizes += lengths
                starts.append(m.start())
                counts.append(len(lengths))
            done = atomic.end() if atomic else upto
        size, count = np.array(sizes, np.int64), np.array(counts, np.int64)
        ends = np.cumsum(size)
        gap = np.array(starts, np.int64) - (ends - size)[np.cumsum(count) - count] if starts else count  # white space in front of each word
        ends = ends + np.repeat(gap, count)
        edge = np.zeros(1, np.int64)
        return np.array([SPECIALS.index("<s>"), *ids, SPECIALS.index("</s>")]), np.concatenate([edge, ends - size, edge]), np.concatenate([edge, ends, edge])


def encode_with_offsets(df: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds input_ids, token_starts and token_ends of a text column (null: null)."""
    names = [*df.columns, "input_ids", "token_starts", "token_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encoder.encode_again(t) if t is not None else (None, None, None) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3))], names=names)

    made = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in names[-3:]]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *made]))


#: Rows whose ids a task holds at once.
ROWS_AT_ONCE = 256


def encode(docs: DataFrame, merges: list[tuple[str, str]], vocab: DataFrame, key: str = "doc_id", text: str = "text", atomic: tuple[str, ...] = ()) -> DataFrame:
    """key, input_ids with <s> and </s> for each row (null text: these two), without a shuffle.

    The vocabulary, one row for each character, special token and merge, goes to every task, which
    encodes each distinct word once as long as it remembers it.  Tokens named in atomic are matched
    whole before words are split.
    """
    encoder = Encoder(merges, vocab, atomic, extend=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = pa.array(list(encoder.encode_ids(part.column(1).to_pylist())), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "input_ids"])

    x = docs.select(key, text)
    return x.mapInArrow(run, T.StructType([x.schema[key], T.StructField("input_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, decoded: the tokens of the ids, special ones and unknown ids left out, without a shuffle; the vocabulary goes to every task."""
    token = {r["id"]: r["token"] for r in vocab.where(~F.col("token").isin(*SPECIALS)).collect()}  # one row for each token of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = ["".join([token.get(i, "") for i in ids or ()]) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    x = encoded.select(key, "input_ids")
    return x.mapInArrow(run, T.StructType([x.schema[key], T.StructField("decoded", T.StringType())]))


def missing_special_tokens(vocab: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """token: the expected tokens that a vocabulary lacks, which would become <unk>."""
    return vocab.sparkSession.createDataFrame([(t,) for t in expected], "token string").join(vocab, "token", "left_anti")


def vocab_stats(vocab: DataFrame, sample: int = 20) -> DataFrame:
    """vocab_size, n_special and the first tokens by id, in one row."""
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("id") < sample, F.struct("id", "token")))), lambda x: x["token"]), " ")
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"), F.count_if(F.col("token").isin(*SPECIALS)).alias("n_special"), first.alias("sample_tokens"))


def save_vocab(vocab: DataFrame, merges: list[tuple[str, str]], path: str) -> None:
    """Tables vocab (token, id), merges (rank, left, right) and config below path."""
    spark = vocab.sparkSession
    vocab.write.parquet(f"{path}/vocab")
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string").coalesce(1).write.parquet(f"{path}/merges")
    config = spark.createDataFrame([("bpe", len(merges), list(SPECIALS))], "model_type string, n_merges int, special_tokens array<string>")
    config.coalesce(1).write.json(f"{path}/config")


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The vocabulary and the merges that save_vocab has stored."""
    merges = [(r["left"], r["right"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]  # fewer than the vocabulary
    return spark.read.parquet(f"{path}/vocab"), merges
