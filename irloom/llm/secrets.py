"""Operator 9, secret scans: base patterns, and dictionary-primed zstandard novelty for other strings."""

from __future__ import annotations

import bisect
import builtins
import functools
import hashlib
import itertools
import keyword
import random
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from irloom.llm.common import arrow_map, documents, id_and_text

# The base patterns and the least length of what they match.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: What may be a secret, and the words that make the text before it sensitive.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api.?key|credential|private.?key|access.?key|auth|bearer|signature", re.A | re.I)
#: Others are of letters or of digits alone and are measured by the frequencies of characters too (see letter_compressor).
MIXED = re.compile(r"[A-Za-z][^A-Za-z0-9]*[0-9]|[0-9][^A-Za-z0-9]*[A-Za-z]")
#: Code points before a candidate that are its context, those that are its surroundings on either side, and those of it that are measured at a time.
CONTEXT, AROUND, MEASURED = 48, 512, 1024
#: Length and distance of the windows that longer candidates are searched with where MEASURED code points at a time compress.
WINDOW, STEP = 32, 8
#: Measures of a text that are remembered, for passages that repeat.
REMEMBERED = 20_000
#: A candidate is reported if it adds at least so many compressed bits per character to its surroundings.
NOVEL_BITS = 5.0
#: Identifiers that a candidate is likely to be made of: Python's keywords and built-in names, and fixed words of configuration files.
IDENTIFIERS = " ".join([*keyword.kwlist, *(x for x in dir(builtins)), *"config settings default example placeholder username password secret token api_key client_id localhost production development value string number".split()])


def added_bits(before: str, part: str, after: str, compressor) -> float:
    """Compressed bits per character that a part adds to what surrounds it."""
    base = f"{after}\n{before}".encode("utf-8", "replace")
    return 8 * (len(compressor.compress(base + part.encode())) - len(compressor.compress(base))) / len(part)


def surroundings(text: str, start: int, end: int, last: int | None = None) -> tuple[str, str, str]:
    """What text[start:end] is measured by: before, all of it, and after it or, of a part, after its candidate, which ends at last.

    So what stands twice in a candidate is new where it stands first.
    """
    last = last or end
    return text[max(0, start - AROUND) : start], text[start:end], text[last : last + AROUND]


def marginal_bits(text: str, start: int, end: int, compressor) -> float:
    return added_bits(*surroundings(text, start, end), compressor)


def new_compressor():
    """A compressor primed with the identifiers."""
    import zstandard

    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


@functools.cache
def letter_dictionary() -> bytes:
    """A dictionary trained on the identifiers, which holds the frequencies of their characters."""
    import zstandard

    rng, words = random.Random(0), IDENTIFIERS.split()
    return zstandard.train_dictionary(4096, [" ".join(rng.choices(words, k=24)).encode() for _ in range(400)]).as_bytes()


def letter_compressor():
    """A compressor that knows how frequent characters are: without, each letter of a rare word in a short text costs 8 bits, as in a random string."""
    import zstandard

    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(letter_dictionary()), write_content_size=False, write_checksum=False, write_dict_id=False)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end (exclusive) and kind of what the base patterns find, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def union(base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Sorted spans as disjoint ones."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in base:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), kind)
        else:
            out.append((a, b, kind))
    return out


def outside(start: int, end: int, base: list[tuple[int, int, str]], first: int = 0) -> list[tuple[int, int]]:
    """The parts of start:end outside the base spans (from the one numbered first) that are long enough for a candidate."""
    out = []
    for k in range(first, len(base)):
        a, b, _ = base[k]
        if a >= end:
            break
        if b > start:
            out.append((start, a))
            start = b
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= LEAST]


def novel_parts(start: int, end: int, is_novel: Callable[[int, int, int], bool]) -> list[tuple[int, int, str]]:
    """The parts of a candidate of more than MEASURED characters that do not compress after what stands before them, joined where they meet.

    Every character is measured: MEASURED at a time and, where those compress, by overlapping
    windows, so that a short secret counts wherever it stands and is not outweighed by what is dull.
    """
    found: list[tuple[int, int, str]] = []
    for size, step in ((MEASURED, MEASURED), (WINDOW, STEP)):
        wide, k = found, 0
        found = list(wide)
        for a in itertools.chain(range(start, end - size, step), [end - size]):
            while k < len(wide) and wide[k][1] < a + size:
                k += 1
            if (k == len(wide) or a < wide[k][0]) and is_novel(a, a + size, end):
                found.append((a, a + size, "novel"))
        found = union(sorted(found))
    return found


def novel_spans(text: str, base: list[tuple[int, int, str]], compressor, letters) -> list[tuple[int, int, str]]:
    """Candidates that start in a sensitive context, or their parts outside the base spans, that do not compress.

    Of more than MEASURED characters those parts are reported that do not compress (novel_parts).
    The end of a run of candidate characters is looked for once, however many sensitive words stand
    in it, base spans are found by their ends, a long part is searched from its first start only,
    and others are bounded; so the time grows with the text.
    """
    out: list[tuple[int, int, str]] = []
    parts: list[tuple[int, int, str]] = []
    base, run_end, known, searched = union(base), 0, {}, set()
    ends = [b for _, b, _ in base]

    def is_novel(start: int, end: int, last: int) -> bool:
        question = surroundings(text, start, end, last)
        if question not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[question] = added_bits(*question, compressor if MIXED.search(question[1]) else letters) >= NOVEL_BITS
        return known[question]

    for word in SENSITIVE.finditer(text):
        at = word.end()
        # the last start in the context has LEAST characters before limit
        limit = min(len(text), at + CONTEXT + LEAST - 1)
        for m in CANDIDATE.finditer(text, at, limit):
            whole = m.end()
            if whole == limit:
                run_end = run_end if whole <= run_end else CANDIDATE.match(text, m.start()).end()
                whole = run_end
            for start, end in outside(m.start(), whole, base, bisect.bisect_right(ends, m.start())):
                if end - start > MEASURED:
                    if end not in searched:
                        searched.add(end)
                        parts += novel_parts(start, end, is_novel)
                elif (not out or start >= out[-1][1]) and is_novel(start, end, end):
                    out.append((start, end, "novel"))
    return union(sorted(out + parts))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind in the order of
    KINDS.  Texts are scanned whole; null counts as empty and has no spans.  Repeated rows repeat,
    empty tables give no rows, other columns are not read.  Nothing is shuffled.
    """

    def run(doc_id: list, text: list) -> dict:
        compressor, letters = new_compressor(), letter_compressor()
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
        for t in text:
            base = base_spans(t)
            more = novel_spans(t, base, compressor, letters)
            show = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base) + sum(s[2] == k for s in more))
            out["base_sha256"].append(hashlib.sha256(show(base).encode()).hexdigest())
            out["spans"].append(show(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
        return {"doc_id": doc_id} | out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return arrow_map(id_and_text(docs), run, schema, [x.split()[0] for x in schema.split(", ")])


def op9_secret_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir))


SQL = None
