"""Token counts of whole texts through compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

*Splitter.* Reads character classes with a short look-ahead and marks where a pre-token starts. A text
is cut into fixed chunks; every chunk gives a map from the state before it to the state after it, the
maps are composed with a parallel prefix scan, and each chunk is then replayed from its true state.

*Counter.* Reads the bytes of a pre-token; each transition carries the number of tokens by which the
count of the encoding changes. A state keeps, for every suffix that a longer token may still begin
with, the last token before it and its count; the encoding of a prefix ends in the one token that is
compatible with the encoding before it, so no merge has to be replayed. States are made when first
reached, shared by all words that reach them, and dropped together when a worker holds too many.

Defined results: null counts as empty and has 0 tokens; repeated rows are counted each; very long
texts are scanned in one pass with memory linear in one text; special strings inside a text are one
token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

# Splitter states: between pre-tokens, in letters, in digits, in other signs, in white space, after a
# leading space, and one or two characters before the end of a contraction.
FREE, LETTERS, DIGITS, SIGNS, SPACES, LEAD, ONE_LEFT, TWO_LEFT = range(8)
# Splitter symbols: character classes, with what the look-ahead found.
S_LETTER, S_DIGIT, S_SIGN, S_SPACE, S_LEAD, S_LAST, S_CONTRACTION2, S_CONTRACTION3, S_PAD = range(9)
_RESET = 16  # added to the symbol of the first character of a text
_CHUNK = 512

# Endings that stand as a pre-token of their own after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a pre-token) by symbol and state."""
    state = np.zeros((32, 8), np.int8)
    start = np.zeros((32, 8), bool)
    run = {S_LETTER: LETTERS, S_DIGIT: DIGITS, S_SIGN: SIGNS}
    for symbol in range(9):
        for before in range(8):
            if symbol == S_PAD:
                after, begins = before, False
            elif before in (ONE_LEFT, TWO_LEFT):
                after, begins = (FREE if before == ONE_LEFT else ONE_LEFT), False
            elif symbol in run:
                after, begins = run[symbol], before not in (run[symbol], LEAD)
            elif symbol in (S_CONTRACTION2, S_CONTRACTION3):
                inside = before in (SIGNS, LEAD)
                after = SIGNS if inside else (ONE_LEFT if symbol == S_CONTRACTION2 else TWO_LEFT)
                begins = not inside
            elif symbol == S_SPACE:
                after, begins = SPACES, before != SPACES
            else:
                after, begins = (LEAD if symbol == S_LEAD else FREE), True
            state[symbol, before], start[symbol, before] = after, begins
        state[symbol + _RESET], start[symbol + _RESET] = state[symbol, FREE], start[symbol, FREE]
    return state, start


_NEXT, _STARTS = splitter_tables()


def character_classes() -> np.ndarray:
    """Letter 0, digit 1, other sign 2, white space 3 for each code point."""
    classes = np.full(0x110000, 2, np.uint8)
    everything = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for pattern, value in ((r"\p{L}+", 0), (r"\p{N}+", 1), (r"\s+", 3)):
        for found in regex.finditer(pattern, everything):
            first, last = ord(found[0][0]), ord(found[0][-1])
            classes[first : last + 1] = value
    return classes


def symbols(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The splitter's symbol of each character; ``ends``: where texts end, all texts non-empty."""
    kind = classes[codes]
    out = kind.copy()  # letter, digit and sign are their own symbols
    closes = np.zeros(len(codes), bool)
    closes[ends - 1] = True
    space = kind == 3
    before_solid = np.zeros(len(codes), bool)
    before_solid[:-1] = space[:-1] & ~space[1:] & ~closes[:-1]
    out[space] = S_SPACE
    out[before_solid] = np.where(codes[before_solid] == 32, S_LEAD, S_LAST)
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        room = ends[np.searchsorted(ends, marks, "right")] - marks - 1
        padded = np.concatenate([codes, [0, 0]])
        one, two = padded[marks + 1], padded[marks + 2]
        for ending in CONTRACTIONS:
            fits = (room >= len(ending)) & (one == ord(ending[0]))
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            out[marks[fits]] = S_CONTRACTION2 if len(ending) == 1 else S_CONTRACTION3
    out[0] += _RESET
    out[ends[:-1]] += _RESET
    return out


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row i becomes map 0, then map 1, ... then map i."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def pretoken_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start."""
    chunks = -(-len(symbol) // _CHUNK)
    grid = np.full(chunks * _CHUNK, S_PAD, np.uint8)
    grid[: len(symbol)] = symbol
    grid = np.ascontiguousarray(grid.reshape(chunks, _CHUNK).T)
    flat_next, flat_starts = _NEXT.ravel(), _STARTS.ravel()
    rows = grid.astype(np.intp) * 8
    maps = np.tile(np.arange(8, dtype=np.int8), (chunks, 1))
    for column in rows:
        maps = flat_next[column[:, None] + maps]
    after = compose_prefixes(maps)[:, FREE]
    state = np.concatenate([[FREE], after[:-1]]).astype(np.int8)
    begins = np.empty((_CHUNK, chunks), bool)
    for i, column in enumerate(rows):
        at = column + state
        begins[i] = flat_starts[at]
        state = flat_next[at]
    return np.flatnonzero(begins.T.ravel()[: len(symbol)])


class Counter:
    """The transducer that counts the tokens of one pre-token."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], most: int = 200_000):
        self.vocabulary, self.merges, self.most = vocabulary, merges, most
        self.bytes_of = {v: k for k, v in vocabulary.items()}
        self.prefixes = {t[:k] for t in vocabulary for k in range(len(t))}  # of longer tokens
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((0, -1, 0),))
        self.number, self.states = {start: 0}, [start]
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the pair of lowest rank, leftmost first."""
        parts = [self.vocabulary[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.merges[pair][0], i) if (pair := (parts[i], parts[i + 1])) in self.merges else (1 << 30, i)
                for i in range(len(parts) - 1)
            )
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        pair = (left, right)
        if pair not in self.fits:
            if len(self.fits) > 4 * self.most:
                self.fits.clear()
            self.fits[pair] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.fits[pair]

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Make the transition from ``state`` on ``byte``: (next state, change of the count)."""
        suffix, open_ends = self.states[state]
        suffix += bytes((byte,))
        size = len(suffix)
        for length, last, count in open_ends:  # longest first
            token = self.vocabulary.get(suffix[size - length - 1 :])
            if token is not None and (last < 0 or self.compatible(last, token)):
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        change = count + 1
        kept = [
            (length + 1, last, count - change)
            for length, last, count in open_ends
            if suffix[size - length - 1 :] in self.prefixes
        ]
        kept.append((0, token, 0))
        key = (suffix[size - kept[0][0] :], tuple(kept))
        after = self.number.get(key)
        if after is None:
            after = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = made = (after, change)
        return made

    def count(self, word: bytes) -> int:
        found = self.words.get(word)
        if found is None:
            state = found = 0
            moves = self.moves
            for byte in word:
                step = moves.get(state << 8 | byte)
                state, change = step if step is not None else self.move(state, byte)
                found += change
            if len(self.states) > self.most:
                self.clear()
            if len(self.words) > self.most:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = found
        return found

    def counts(self, words: pa.Array) -> np.ndarray:
        words = words.to_pylist()
        known = list(map(self.words.get, words))
        return np.array([self.count(w) if k is None else k for w, k in zip(words, known)], np.int64)


def load_byte_bpe(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Vocabulary, merges as (left, right) -> (rank, merged), and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    names = {name: bytes(shown[c] for c in name) for name in spec["model"]["vocab"] if all(c in shown for c in name)}
    special = [t["content"] for t in spec["added_tokens"]]
    vocabulary = {names[name]: i for name, i in spec["model"]["vocab"].items() if name in names and name not in special}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = (names[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
        merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
    return vocabulary, merges, special


def count_tokens(column: pa.Array, counter: Counter, classes: np.ndarray, special: list[str]) -> np.ndarray:
    """Tokens of each text of an Arrow column."""
    total = np.zeros(len(column), np.int64)
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    owners, coded, dictionaries, size = [], [], [], 0
    for row, _, data, ends in text_slices(column):
        owner = np.arange(row, row + len(ends))
        text = data.tobytes().decode("utf-8", "replace")
        if marks is not None and marks.search(text):
            raw = data.tobytes()
            pieces, owner = [], []
            for i, end in enumerate(ends):
                own = raw[ends[i - 1] if i else 0 : end].decode("utf-8", "replace")
                total[row + i] += len(marks.findall(own))
                pieces += (parts := marks.split(own))
                owner += [row + i] * len(parts)
            text, owner = "".join(pieces), np.array(owner)
            ends = np.cumsum([len(p.encode()) for p in pieces])
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        widths = np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
        full = np.diff(ends, prepend=0) > 0
        owner, ends = owner[full], ends[full]
        char_ends = np.searchsorted(widths, ends) + 1
        starts = pretoken_starts(symbols(codes, char_ends, classes))
        offsets = np.concatenate([widths[starts] - (widths[starts] - np.where(starts > 0, widths[starts - 1], 0)), widths[-1:]])
        encoded = text.encode("utf-8")
        tokens = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(encoded)]
        ).dictionary_encode()
        owners.append(owner[np.searchsorted(char_ends, starts, "right")].astype(np.int32))
        coded.append(tokens.indices.to_numpy() + size)
        dictionaries.append(tokens.dictionary)
        size += len(tokens.dictionary)
    if dictionaries:  # each different pre-token of the column is counted once
        merged = pa.concat_arrays(dictionaries).dictionary_encode()
        each = counter.counts(merged.dictionary)[merged.indices.to_numpy()]
        for owner, codes in zip(owners, coded):
            total += np.bincount(owner, each[codes], len(total)).astype(np.int64)
    return total


def token_counts(
    df: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row; ``tokenizer``: path on the driver."""
    spark = df.sparkSession
    # Bounded by the vocabulary, which does not grow with the data.
    compiled = spark.sparkContext.broadcast((*load_byte_bpe(tokenizer), character_classes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, merges, special, classes = compiled.value
        counter = Counter(vocabulary, merges)
        for batch in batches:
            column = batch.column(1)
            tokens = count_tokens(column, counter, classes, special)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    body = F.coalesce(df[text].cast("string"), F.lit(""))
    fields = [
        T.StructField("doc_id", df.schema[doc_id].dataType),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    columns = df.select(df[doc_id].alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    return columns.mapInArrow(count, T.StructType(fields))
