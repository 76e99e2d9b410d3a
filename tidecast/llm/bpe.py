"""Byte-level BPE ids from the ``tokenizers`` library, asked once per new piece.

A byte-level BPE never merges across the pieces of its own pre-tokenizer, so the
ids of a text are the ids of its pieces one after the other. Texts of the plain
Latin range are cut into pieces here, many texts in one pass of array operations; the ids
of the distinct pieces come from a bounded cache, those of new pieces from the library, many
in one call. Every other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np

#: The character classes of the pre-tokenizer within the plain range.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
PLAIN = r"\n\t -~¡-ɏ"
END, LETTER, NUMBER, SPACE, WHITE, OTHER, UNUSUAL = range(7)
JOINT = re.compile(r"(?<=\S) (?=\S)")


def _class_of(char: str) -> int:
    if char == "\0":
        return END
    if not re.fullmatch(f"[{PLAIN}]", char):
        return UNUSUAL
    for kind, chars in ((SPACE, " "), (WHITE, r"\s"), (LETTER, LETTERS), (NUMBER, NUMBERS)):
        if re.fullmatch(f"[{chars}]", char):
            return kind
    return OTHER


_CLASS = np.array([_class_of(chr(c)) for c in range(0x250)] + [UNUSUAL], np.uint8)
_IN_WORD = np.isin(np.arange(7), (LETTER, NUMBER, OTHER))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def plain(text: str) -> bool:
    """Whether a text can be cut into pieces here."""
    kinds = _CLASS[np.minimum(codes_of(text), 0x250)]
    return "<|" not in text and not ((kinds == UNUSUAL) | (kinds == END)).any()


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where pieces begin in plain texts that each end with a zero (a piece of its own)."""
    kind = _CLASS[codes]
    before, here, after = kind[:-1], kind[1:], np.append(kind[2:], END)
    white = (kind == SPACE) | (kind == WHITE)
    joined = np.zeros(len(codes), bool)
    joined[1:] = (
        (before == here) & _IN_WORD[here]
        | (before == SPACE) & _IN_WORD[here]
        # the last character of white space before a word stays apart from the rest
        | white[:-1] & white[1:] & ~_IN_WORD[after]
    )
    # contractions, where an apostrophe begins a piece
    at = np.flatnonzero(codes == ord("'"))
    at = at[np.isin(np.where(at > 0, kind[at - 1], END), (LETTER, NUMBER, WHITE, END))]
    first, second = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    short = np.isin(first, [ord(c) for c in "stmd"])
    long = np.isin(first, [ord("r"), ord("v")]) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    joined[at[short | long] + 1] = True
    joined[at[short] + 2] = False
    joined[at[long] + 2], joined[at[long] + 3] = True, False
    return np.flatnonzero(~joined)


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` of the given first places and sizes, one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(first - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


class Table:
    """Ids of pieces of up to 16 narrow characters (two integers, told apart by their mixture), sorted by mixture."""

    def __init__(self) -> None:
        self.keys = [np.zeros(0, np.uint64) for _ in range(3)]  # mixture, low, high
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.first)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The place of each piece here, or -1."""
        if not len(self):
            return np.full(len(keys[0]), -1)
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), len(self) - 1)
        return np.where(np.logical_and.reduce([mine[at] == k for mine, k in zip(self.keys, keys)]), at, -1)

    def add(self, keys: list[np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keys in ascending order; one whose mixture is here already just stands beside it."""
        at = np.searchsorted(self.keys[0], keys[0])
        self.keys = [np.insert(mine, at, k) for mine, k in zip(self.keys, keys)]
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, ids])


class Recent:
    """Tables of two generations, each of about ``most`` pieces.

    When the young one is full it becomes the old one; what was not met since is
    then forgotten, so frequent pieces are never learned twice.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, Table(), Table()

    def ids_of(self, keys: list[np.ndarray], learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in ascending order, one after the other, and the number of each piece's.

        ``learn`` gives both for the pieces at the places it is asked for.
        """
        if len(self.young) > self.most:
            self.old, self.young = self.young, Table()
        young, old = self.young.find(keys), self.old.find(keys)
        sizes, first = np.zeros(len(young), np.int64), np.zeros(len(young), np.int64)
        here = np.flatnonzero(young >= 0)
        back = np.flatnonzero((young < 0) & (old >= 0))
        new = np.flatnonzero((young < 0) & (old < 0))
        sizes[here] = self.young.sizes[young[here]]
        sizes[back] = self.old.sizes[old[back]]
        learned, sizes[new] = learn(new)
        known = len(self.young.ids)
        first[here] = self.young.first[young[here]]
        again = gather(self.old.ids, self.old.first[old[back]], sizes[back])
        first[back] = known + np.cumsum(sizes[back]) - sizes[back]
        first[new] = known + len(again) + np.cumsum(sizes[new]) - sizes[new]
        for at, ids in ((back, again), (new, learned)):
            self.young.add([k[at] for k in keys], ids, sizes[at])
        return gather(self.young.ids, first, sizes), sizes


class Encoder:
    """Texts -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, cache_chars: int = 6_000_000, chars_at_once: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.chars_at_once = chars_at_once
        ids = self.library.get_vocab(with_added_tokens=True)
        #: the ids whose bytes begin with a space, and the one of a line feed, as byte-level vocabularies write them
        self.spaced, self.feeds = np.zeros((2, max(ids.values()) + 1), bool)
        self.spaced[[i for token, i in ids.items() if token[0] == "Ġ"]] = True
        self.feeds[ids["Ċ"]] = True
        self.pieces = Recent(cache_chars // 20)  # about as many pieces

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, narrow: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of narrow characters, from the library, and how many each has.

        Pieces of word characters go there many at a time, as it cuts them apart again: before each space with which
        they begin, or at line feeds put between them.
        """
        head, second = _CLASS[narrow[starts]], _CLASS[narrow[starts + 1]]
        out = [b""] * len(starts)
        spaced, worded = (head == SPACE) & (lengths > 1) & _IN_WORD[second], _IN_WORD[head]
        alone = np.flatnonzero(~spaced & ~worded & (head != END)).tolist()
        for joined, fed, marks in ((spaced, 0, self.spaced), (worded, 1, self.feeds)):
            members = np.flatnonzero(joined)
            for group in (members[at : at + 4096] for at in range(0, len(members), 4096)):
                n = lengths[group] + fed
                letters = gather(narrow, starts[group] - fed, n)
                if fed:
                    letters[np.cumsum(n) - n] = ord("\n")
                text = letters.tobytes().decode("latin-1")
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                at = np.flatnonzero(marks[ids])
                if len(at) != len(group):
                    alone += group.tolist()
                    continue
                packed = ids.tobytes()
                for i, a, b in zip(group.tolist(), (4 * (at + fed)).tolist(), [*(4 * at[1:]).tolist(), len(packed)]):
                    out[i] = packed[a:b]
        for i in alone:
            out[i] = self.whole(narrow[starts[i] : starts[i] + lengths[i]].tobytes().decode("latin-1"))
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts, by the distinct pieces of all of them.

        Pieces of up to 16 characters below 255 are told apart as two integers; the others, which are few, as strings.
        """
        text = "\0".join(texts) + "\0"
        codes = codes_of(text)
        starts, n = piece_starts(codes), len(codes)
        lengths = np.diff(np.append(starts, n))
        narrow = np.zeros(n + 16, np.uint8)
        narrow[:n] = np.minimum(codes, 255)
        words = np.ndarray((n + 8,), "<u8", narrow, strides=(1,))
        low = words[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]
        high = words[np.minimum(starts + 8, n)] & _FIRST_BYTES[np.clip(lengths - 8, 0, 8)]
        wide = np.cumsum(codes > 254)
        odd = (lengths > 16) | (wide[starts + lengths - 1] > wide[starts] - (codes[starts] > 254))
        mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        common, number = np.flatnonzero(~odd), np.zeros(len(starts), np.int64)
        keys, first, of = np.unique(mixed[common], return_index=True, return_inverse=True)
        first, number[common] = common[first], of
        odd[common] = (low[common] != low[first][of]) | (high[common] != high[first][of])  # two pieces of one mixture
        ids, sizes = self.pieces.ids_of([keys, low[first], high[first]], lambda at: self._learn(narrow, starts[first[at]], lengths[first[at]]))
        others = np.flatnonzero(odd)
        strings = [text[a : a + b] for a, b in zip(starts[others].tolist(), lengths[others].tolist())]
        of_string = {s: self.whole(s) for s in set(strings)}
        number[others] = len(first) + np.arange(len(others))
        ids = np.concatenate([ids, np.frombuffer(b"".join([of_string[s] for s in strings]), "<u4")])
        sizes = np.concatenate([sizes, np.array([len(of_string[s]) // 4 for s in strings], np.int64)])
        each = sizes[number]
        out = gather(ids, (np.cumsum(sizes) - sizes)[number], each).tobytes()
        cuts = (4 * np.cumsum(each)[codes[starts] == 0]).tolist()
        return [out[a:b] for a, b in zip([0, *cuts], cuts)]

    def segments(self, text: str) -> Iterator[str]:
        """The text, if long cut before spaces that begin a piece."""
        at = 0
        while len(text) - at > self.chars_at_once and (joint := JOINT.search(text, at + self.chars_at_once)):
            yield text[at : joint.start()]
            at = joint.start()
        yield text[at:]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, str]] = []
        chars = 0

        def settle() -> None:
            nonlocal chars
            for (i, _), ids in zip(held, self._encode_plain([s for _, s in held])):
                out[i] += ids
            held.clear()
            chars = 0

        for i, text in enumerate(texts):
            if not plain(text):
                out[i] = self.whole(text)
                continue
            for segment in self.segments(text):
                held.append((i, segment))
                chars += len(segment)
                if chars >= self.chars_at_once:
                    settle()
        if held:
            settle()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
