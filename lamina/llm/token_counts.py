"""Token counts by a compiled finite-state tokenizer (operator 1).

Two deterministic transducers do what a byte-level BPE tokenizer does, without making any token:

* The *lexer* reads character classes and emits where a pre-token begins. A chunk of text is a map
  from each of its 13 states to a state. All chunks of a batch are mapped at once, the maps are
  composed by a parallel prefix scan, and a second pass from the now known states emits the cuts.
  A text of any length is many chunks, so long texts cost no more per byte than short ones.
* The *merge transducer* reads the bytes of a pre-token (a long one by chunks, whose maps are composed). Every transition is annotated with the
  tokens it emits: the change in the number of tokens of the prefix read so far (it may be
  negative, when a longer token replaces several). The sum along a path is the token count.
  It is determinised on demand, as the states of all possible texts are too many to list.

Why this is finite-state: the last token of the encoding of a prefix is the one token t that is a
suffix of the prefix and that forms, with the last token before it, a pair that the merges leave
alone. So the future depends on the longest suffix that some token begins with, and on the last
tokens (and relative counts) at the places in that suffix where a token may still begin.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import flat_text, slices
from lamina.llm.pieces import segments

# Input symbols of the lexer. A is s, t, m or d: with an apostrophe before it, a contraction.
SEP, LETTER, A, R, V, ELL, E, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK = range(12)
# Its states: which kind of token is open. One/many count the white space read; Q is an apostrophe
# that began a token, Q_R, Q_V, Q_LL the same with one letter more, DONE a finished contraction.
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK, Q, Q_R, Q_V, Q_LL, DONE = range(13)
STATES, SYMBOLS = 13, 12
HERE, BACK = 1, 2  # a token begins at this character; at the one before it
CHUNK = 128
LONG, WARM = 16 * CHUNK, 48  # bytes of a pre-token that is walked by chunks; bytes that lead to a guess
NO_TOKEN = -1


def lexer_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) at state * SYMBOLS + symbol, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks before no text|blanks."""
    step = np.zeros(STATES * SYMBOLS, np.uint8)
    emit = np.zeros(STATES * SYMBOLS, np.uint8)
    opens = {s: WORD for s in (LETTER, A, R, V, ELL, E)} | {NUMBER: DIGITS, OTHER: SIGNS, APOSTROPHE: Q, SPACE: ONE_SPACE, BLANK: ONE_BLANK}
    goes_on = {WORD: (LETTER, A, R, V, ELL, E), DIGITS: (NUMBER,), SIGNS: (OTHER, APOSTROPHE)}

    def rule(state: int, symbol: int) -> tuple[int, int]:
        if state in (Q_R, Q_V, Q_LL):
            if symbol == (ELL if state == Q_LL else E):
                return DONE, 0
            after, emitted = rule(WORD, symbol)  # no contraction: the letter before began a word
            return after, emitted | BACK
        if symbol == SEP:
            return START, HERE
        if symbol in goes_on.get(state, ()):
            return state, 0
        if state == Q:
            if symbol in (A, R, V, ELL):
                return {A: DONE, R: Q_R, V: Q_V, ELL: Q_LL}[symbol], 0
            if symbol in (OTHER, APOSTROPHE):
                return SIGNS, 0
        if state in (ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK):
            if symbol in (SPACE, BLANK):
                return (MANY_SPACE if symbol == SPACE else MANY_BLANK), 0
            many = BACK if state in (MANY_SPACE, MANY_BLANK) else 0
            if state in (ONE_SPACE, MANY_SPACE):  # the last space belongs to what follows
                return (SIGNS if symbol == APOSTROPHE else opens[symbol]), many
            return opens[symbol], many | HERE
        return opens[symbol], HERE

    for state in range(STATES):
        for symbol in range(SYMBOLS):
            step[state * SYMBOLS + symbol], emit[state * SYMBOLS + symbol] = rule(state, symbol)
    return step, emit


STEP, EMIT = lexer_tables()


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """symbols: (chunk length, chunks). Row s of the result: where each chunk leads from state s."""
    states = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], symbols.shape[1], axis=1)
    for row in symbols:
        states = STEP[states * np.uint8(SYMBOLS) + row]
    return states


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of maps (states, chunks) under composition, by doubling distances."""
    maps, distance = maps.copy(), 1
    while distance < maps.shape[1]:
        maps[:, distance:] = np.take_along_axis(maps[:, distance:], maps[:, :-distance], axis=0)
        distance *= 2
    return maps


def token_starts(symbols: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token (or a separator) begins."""
    n = len(symbols)
    columns = -(-n // CHUNK)
    padded = np.full(columns * CHUNK, SEP, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(columns, CHUNK).T)
    ends = prefix_scan(chunk_maps(grid))[START]
    states = np.concatenate([np.array([START], np.uint8), ends[:-1]])
    emitted = np.empty_like(grid)
    for k, row in enumerate(grid):
        at = states * np.uint8(SYMBOLS) + row
        emitted[k], states = EMIT[at], STEP[at]
    emitted = emitted.T.ravel()
    starts = (emitted & HERE).astype(bool)
    starts[:-1] |= (emitted[1:] & BACK).astype(bool)
    return np.flatnonzero(starts[:n])


def class_ranges(tokenizer_path: str) -> tuple[list[int], list[int]]:
    """(first code points, symbols) of runs of characters of one class, asked of the library itself:
    its Unicode tables need not be of the version that Python has."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokenizer_path).pre_tokenizer.pre_tokenize_str
    apart = lambda before, c: len(split(before + c)) > 1
    kind = lambda c: LETTER if not apart("a", c) else NUMBER if not apart("1", c) else OTHER if not apart("!", c) else BLANK
    firsts, kinds = list(range(128)), [kind(chr(c)) for c in range(128)]
    for c, symbol in {"s": A, "t": A, "m": A, "d": A, "r": R, "v": V, "l": ELL, "e": E, "'": APOSTROPHE, " ": SPACE}.items():
        kinds[ord(c)] = symbol
    for low, high in ((0x80, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for _, (start, _) in split(every):
            firsts.append(low + start)
            kinds.append(kind(every[start]))
    return firsts, kinds


class MergeTransducer:
    """Counts tokens of pre-tokens by walking bytes; see the module's docstring.

    Transitions are kept in an open-addressing hash table from state * 256 + byte. forget() drops
    all of them once there are more than `most`; that bounds memory and never changes a count.
    """

    def __init__(self, tokens: dict[bytes, int], encode: Callable[[bytes], list[int]], most: int = 1_000_000):
        """encode: merges a byte string of two tokens at most; all else is derived from it."""
        self.tokens, self.encode, self.most = tokens, encode, most
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.begins = {t[:k] for t in tokens for k in range(len(t))}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [(b"", ((NO_TOKEN, 0),))]
        self.number = {self.states[0]: 0}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.used = 0
        self._room(1 << 17)

    def _room(self, slots: int) -> None:
        self.mask = slots - 1
        self.keys, self.next, self.gain = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)

    def stays(self, left: int, right: int) -> bool:
        """Do the merges leave this pair of tokens as it is?"""
        if (known := self.pairs.get((left, right))) is None:
            if left == NO_TOKEN:
                known = self.encode(self.bytes_of[right]) == [right]
            else:
                known = self.encode(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def follow(self, state: int, byte: int) -> tuple[int, int]:
        """Determinises one transition: (next state, tokens emitted)."""
        suffix, lasts = self.states[state]
        suffix += bytes((byte,))
        for k, last in enumerate(lasts):
            token = self.tokens.get(suffix[k:]) if last else None
            if token is not None and self.stays(last[0], token):
                gain = last[1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        places = [(last[0], last[1] - gain) if last else None for last in lasts] + [(token, 0)]
        first = next(k for k in range(len(suffix) + 1) if suffix[k:] in self.begins)
        kept = tuple(places[k] if suffix[k:] in self.begins else None for k in range(first, len(suffix) + 1))
        key = (suffix[first:], kept)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to, gain

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is or, if it is missing, the free slot at which its search ended."""
        at = ((keys * 0x9E3779B97F4A7C1) >> 20) & self.mask
        found = self.keys[at]
        lost = np.flatnonzero((found != keys) & (found != -1))
        while len(lost):
            at[lost] = (at[lost] + 1) & self.mask
            found = self.keys[at[lost]]
            lost = lost[(found != keys[lost]) & (found != -1)]
        return at

    def _add(self, keys: np.ndarray, to: np.ndarray, gain: np.ndarray) -> None:
        if (self.used + len(keys)) * 2 > self.mask + 1:
            full = self.keys >= 0
            old = self.keys[full], self.next[full], self.gain[full]
            self._room(1 << int(2 * (self.used + len(keys)) + 1).bit_length())
            self._put(*old)
        self._put(keys, to, gain)
        self.used += len(keys)

    def _put(self, keys: np.ndarray, to: np.ndarray, gain: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            at = self._slots(keys[left])
            _, first = np.unique(at, return_index=True)  # of keys that meet at a slot, one goes in
            at, own = at[first], left[first]
            self.keys[at], self.next[at], self.gain[at] = keys[own], to[own], gain[own]
            left = np.delete(left, first)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, tokens emitted) of each state on its byte."""
        keys = state << 8 | byte
        at = self._slots(keys)
        missing = self.keys[at] != keys
        if missing.any():
            new = np.unique(keys[missing])
            made = [self.follow(int(key) >> 8, int(key) & 255) for key in new]
            self._add(new, np.array([x[0] for x in made], np.int32), np.array([x[1] for x in made], np.int16))
            at = self._slots(keys)
        return self.next[at].astype(np.int64), self.gain[at]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each data[starts[k]:ends[k]]: all walk together, longest first; those that are many
        chunks long are walked chunk by chunk."""
        if self.used > self.most:
            self.forget()
        lengths = ends - starts
        out = np.zeros(len(lengths), np.int64)
        long = lengths >= LONG
        for k in np.flatnonzero(long).tolist():
            out[k] = self.count_chunks(data[starts[k] : ends[k]])
        own = np.flatnonzero(~long)
        order = own[np.argsort(-lengths[own], kind="stable")]
        begin, descending = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        alive = len(order)
        for k in range(int(descending[0]) if len(order) else 0):
            alive = int(np.searchsorted(-descending[:alive], -k, side="left"))
            state[:alive], gain = self._step(state[:alive], data[begin[:alive] + k])
            total[:alive] += gain
        out[order] = total
        return out

    def walk(self, state: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens emitted) of each chunk (a row of bytes) from its state."""
        total = np.zeros(len(state), np.int64)
        for column in chunks.T:
            state, gain = self._step(state, column)
            total += gain
        return state, total

    def count_chunks(self, text: np.ndarray, block: int = 2048) -> int:
        """Tokens of one long pre-token, in blocks of chunks; what is known may be forgotten in between."""
        state, total = 0, 0
        n = len(text) // CHUNK
        chunks = np.ascontiguousarray(text[: n * CHUNK]).reshape(n, CHUNK)
        for at in range(0, n, block):
            if self.used > self.most:
                key = self.states[state]
                self.forget()
                state = self.number.setdefault(key, len(self.states))
                if state == len(self.states):
                    self.states.append(key)
            state, gain = self._compose(state, chunks[at : at + block])
            total += gain
        return total + int(self.walk(np.array([state]), text[None, n * CHUNK :])[1][0])

    def _compose(self, state: int, chunks: np.ndarray) -> tuple[int, int]:
        """(state after, tokens emitted) of chunks end to end. A chunk is a map from states to states and
        counts, of which only the pairs that occur are made. All chunks are mapped at once from the state
        that the bytes before each lead to from the start (nearly always the right one, as states remember
        little), then again from the states that those maps gave; composing the maps finds what is still
        missing, which is walked. Chunks of equal bytes share a map, so a run that repeats costs a
        look-up for each chunk."""
        _, first, kind = np.unique(chunks.view(f"V{CHUNK}").ravel(), return_index=True, return_inverse=True)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def learn(states: np.ndarray) -> None:
            pairs = set(zip(kind.tolist(), states.tolist(), strict=True)) - known.keys()
            if pairs:
                kinds, from_ = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
                to, gain = self.walk(from_, chunks[first[kinds]])
                known.update(zip(zip(kinds.tolist(), from_.tolist(), strict=True), zip(to.tolist(), gain.tolist(), strict=True), strict=True))

        guess = np.full(len(chunks), state, np.int64)
        guess[1:], _ = self.walk(np.zeros(len(chunks) - 1, np.int64), chunks[:-1, -WARM:])
        for _ in range(2):
            learn(guess)
            guess[1:] = [known[pair][0] for pair in zip(kind[:-1].tolist(), guess[:-1].tolist(), strict=True)]
        total = 0
        for k in kind.tolist():
            if (k, state) not in known:
                to, gain = self.walk(np.array([state]), chunks[first[k] : first[k] + 1])
                known[k, state] = int(to[0]), int(gain[0])
            state, gain = known[k, state]
            total += gain
        return state, total


class CompiledTokenizer:
    """A byte-level BPE tokenizer file compiled to the two transducers."""

    def __init__(self, tokenizer_path: str, ranges: tuple[list[int], list[int]]):
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        from_char = {c: b for b, c in byte_characters().items()}
        raw = lambda token: bytes(from_char[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        model, to_char = Tokenizer.from_file(tokenizer_path).model, byte_characters()
        self.special = [t.encode() for t in sorted(special, key=len, reverse=True)]
        tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.merges = MergeTransducer(tokens, lambda text: [t.id for t in model.tokenize("".join(to_char[b] for b in text))])
        self.class_of = np.zeros(0x110000, np.uint8)
        bounds = [*ranges[0], 0x110000]
        for k, symbol in enumerate(ranges[1]):
            self.class_of[bounds[k] : bounds[k + 1]] = symbol

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text data[offsets[k]:offsets[k + 1]] (UTF-8)."""
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return out
        whole = data.tobytes()
        places = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        symbols = self.class_of[places]
        # A separator before each text (and in place of special tokens) keeps texts apart.
        specials = self._specials(whole, offsets)
        first = np.searchsorted(at_byte, offsets[:-1][np.diff(offsets) > 0])
        for start, stop in specials:
            symbols[np.searchsorted(at_byte, start) : np.searchsorted(at_byte, stop)] = SEP
        spread = np.insert(symbols, first, SEP)
        starts = token_starts(spread)
        shift = np.repeat(np.arange(1, len(first) + 1), np.diff(np.append(first, len(symbols))))
        source = np.full(len(spread), -1, np.int64)
        source[np.arange(len(symbols)) + shift] = np.arange(len(symbols))
        real = spread[starts] != SEP
        limits = np.append(starts[1:], len(spread))
        begin = at_byte[source[starts[real]]]
        last = source[limits[real] - 1]
        end = np.append(at_byte, len(data))[last + 1]
        text = np.searchsorted(offsets, begin, side="right") - 1
        np.add.at(out, text, self.merges.counts(data, begin, end))
        for start, _ in specials:
            out[np.searchsorted(offsets, start, side="right") - 1] += 1
        return out

    def count_long(self, text: str, most: int) -> int:
        """Tokens of one text, counted in parts."""
        parts = (np.frombuffer(part.encode(), np.uint8) for part in segments(text, most))
        return sum(int(self.count(data, np.array([0, len(data)]))[0]) for data in parts)

    def _specials(self, whole: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for token in self.special:
            at = whole.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                inside = at + len(token) <= offsets[text + 1] and not any(a < at + len(token) and at < b for a, b in found)
                if inside:
                    found.append((at, at + len(token)))
                at = whole.find(token, at + (len(token) if inside else 1))
        return found


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is
    printable Latin-1, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(0x100 + k)
    return out


class_ranges_of = functools.lru_cache(class_ranges)


@functools.lru_cache(maxsize=2)
def _compiled(tokenizer_path: str, ranges: tuple) -> CompiledTokenizer:
    return CompiledTokenizer(tokenizer_path, ranges)


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, one row out for each row in.

    A null or empty text has 0 bytes and 0 tokens; ids may be null or repeat and are passed on;
    an empty table gives an empty result; columns other than the two named are not looked at.
    """
    ranges = tuple(map(tuple, class_ranges_of(tokenizer_path)))
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _compiled(tokenizer_path, ranges)
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                data, offsets = flat_text(batch.column(1))
                one = batch.num_rows == 1 and len(data) > slice_bytes
                n = np.array([tokenizer.count_long(data.tobytes().decode(), slice_bytes // 2)]) if one else tokenizer.count(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [id_column, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean")
