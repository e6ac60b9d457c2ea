"""Encoding by the tokenizers library, once for each distinct piece of text.

A piece is a Latin word with the space before it, another run of characters without white space with
the space before it, or a run of white space. The split of byte-level tokenizers cuts wherever a
piece ends, and looks beyond no piece: so the ids of a text are the ids of its pieces end to end, and
words that return cost one look-up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import Any

#: Unicode's white space, as the tokenizers' patterns take it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Letters in every version of Unicode; what follows a piece of them must be no letter or apostrophe.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ǿ"
WORD = rf" ?[{LATIN}]++"
PIECE = re.compile(rf"{WORD}(?=[.,;:!?{WHITE}]|\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PLAIN = re.compile(WORD)
#: A place that no pre-token crosses: before white space that follows something else, between a Latin
#: letter and a digit, between an ideograph or kana and the punctuation after it.
CUT = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a])")


def segments(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about `most` characters whose pre-tokens are the text's; so a text of any
    length takes the memory of a part. A part is longer only within a run of letters alone (or of
    digits, or of signs), which is one pre-token however long it is."""
    start = 0
    while len(text) - start > most and (cut := CUT.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class PieceMemo(dict):
    """piece -> what `encode` makes of it, for the pieces met last: of two generations the older one
    goes when the younger has `most` pieces, and pieces of over `long` characters are not kept. That
    bounds memory and changes no result."""

    def __init__(self, encode: Callable[[str], Any], most: int = 400_000, long: int = 200):
        super().__init__()
        self.encode, self.most, self.long, self.older = encode, most, long, {}

    def __missing__(self, piece: str) -> Any:
        if (value := self.older.get(piece)) is None:
            value = self.encode(piece)
        if len(piece) > self.long:
            return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value

    def of(self, text: str) -> list:
        return list(map(self.__getitem__, PIECE.findall(text)))


def piece_encoder(tokenizer) -> Callable[[str], list[int]]:
    """The ids of one piece by a tokenizers.Tokenizer without a normaliser."""
    from lamina.llm.token_counts import byte_characters

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    split, merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    to_char = byte_characters()
    space, by_latin = to_char[ord(" ")], str.maketrans({chr(b): c for b, c in to_char.items()})

    def encode(piece: str) -> list[int]:
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalpha():
            return [t.id for t in merge(piece.replace(" ", space))]
        if PLAIN.fullmatch(piece):
            return [t.id for t in merge(piece.encode().decode("latin-1").translate(by_latin))]
        return [t.id for name, _ in split(piece) for t in merge(name)]

    return encode
