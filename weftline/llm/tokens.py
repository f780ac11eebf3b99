"""Exact, cached encoding with the `tokenizers` library.

The public tokenizers cut a text into pre-tokens before they merge bytes, and no pre-token crosses
a space that a non-space follows. So the ids of a text are the ids of its space-separated pieces,
one after another. Prose repeats its words: the library encodes each distinct piece once for a
worker, and a text's ids are looked up and joined. Where white space follows a space, the argument
does not hold for the byte-level tokenizer, and the library encodes the whole text; so it does with
texts that hold a special token's string. A piece of plain Latin letters and closing ASCII
punctuation is two pre-tokens at most, and goes straight to the library's model.
``tests/llm`` holds all this against the library's encoding of whole texts, and a worker does so with some texts of each lot that it encodes: where
they differ, as another tokenizer file might make them, it encodes whole texts from then on.
"""

from __future__ import annotations

import os
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces in each of the two generations that a worker remembers; those not met again go (results don't change).
#: A query that does nothing but encode may remember more.
CACHE_PIECES, MORE_PIECES = 150_000, 300_000
#: Texts that the library encodes whole too, of each lot of texts, and tokens of such a text at most.
CHECKED, CHECKED_TOKENS = 2, 4096
#: ASCII punctuation: after a plain word it is one pre-token.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A space before white space or at the end: there the byte-level tokenizer may join spaces.
LOOSE_SPACE = r" ([\s\p{Z}\x{0b}\x{85}]|$)|[\x{1c}-\x{1f}]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def _plain(word: str) -> bool:
    """Letters of ASCII and Latin-1 only (no ª, µ, º), not too many."""
    if not word.isalpha() or len(word) > 100:
        return False
    return word.isascii() or (max(word) <= "ÿ" and not any(c in word for c in "ªµº"))


class _Cache(dict):
    """What is known of each piece; a missing one comes from the last generation, or is learnt."""

    def __init__(self, learn, old: dict):
        super().__init__()
        self.learn, self.old = learn, old

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.learn(piece)
        self[piece] = found
        return found


class PieceEncoder:
    """Encodes texts with one tokenizer file. Ids are little-endian unsigned 32-bit bytes.

    ``offsets``: also keep the character spans of the tokens.
    """

    def __init__(self, path: str, offsets: bool = False, pieces: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        # Does white space leave no trace (word-end BPE), or does it belong to the next piece?
        self.drops_space = self._ids("a b") == self._ids("a") + self._ids("b")
        self.lead = "" if self.drops_space else " "
        self.lead_letter = self.lead and chr(BYTE_LETTERS[ord(" ")])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.offsets, self.pieces = offsets, pieces or CACHE_PIECES
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size(with_added_tokens=True) + 1)]
        self.direct = self.by_pieces = True
        self.direct = all(self._word(p)[0] == self._library(self.lead + p)[0] for p in ("Hello", "thntther", "été", "Straße", "A"))
        self.tails: dict[str, tuple[bytes, bytes]] = {}
        self.cache = _Cache(self._learn, {})

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _library(self, text: str) -> tuple[bytes, bytes]:
        e = self.tok.encode(text, add_special_tokens=False)
        return b"".join([self.id_bytes[i] for i in e.ids]), np.array(e.offsets, "<i4").tobytes() if self.offsets else b""

    def _word(self, word: str, lead: bool = True) -> tuple[bytes, bytes]:
        """Ids and spans of a plain word, after a space if ``lead``, by the library's model alone."""
        text = word.lower() if self.drops_space else word
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
        lead = lead and not self.drops_space
        found = self.model.tokenize(self.lead_letter + text if lead else text)
        ids = b"".join([self.id_bytes[t.id] for t in found])
        if not self.offsets:
            return ids, b""
        if self.drops_space and not word.isascii():
            return ids, self._library(word)[1]
        ends = list(accumulate([len(t.value.removesuffix("</w>") if self.drops_space else t.value) for t in found]))
        first, last = [0, *ends[:-1]], ends
        if not word.isascii():  # from bytes to the characters that hold them
            of = [i for i, c in enumerate((" " if lead else "") + word) for _ in range(1 + (c > "\x7f"))]
            first, last = [of[x] for x in first], [of[x - 1] + 1 for x in last]
        spans = [x - lead for pair in zip(first, last, strict=True) for x in pair]
        return ids, struct.pack(f"<{len(spans)}i", *spans)

    def _tail(self, tail: str) -> tuple[bytes, bytes]:
        if (found := self.tails.get(tail)) is None:
            found = self.tails[tail] = self._library(tail)
        return found

    def _join(self, *parts: tuple[tuple[bytes, bytes], int]):
        """Encodings one after another, each moved by so many characters, in the cache's form."""
        ids = b"".join([p[0] for p, _ in parts])
        if not self.offsets:
            return ids
        return ids, b"".join([(np.frombuffer(p[1], "<i4") + by).astype("<i4").tobytes() if by else p[1] for p, by in parts])

    def _known(self, piece: str) -> tuple[bytes, bytes]:
        found = self.cache[piece]
        return found if self.offsets else (found, b"")

    def _learn(self, piece: str):
        if self.direct:
            word = piece.rstrip(MARKS)
            if _plain(word):
                if len(word) == len(piece):
                    return self._join((self._word(word), 0))
                return self._join((self._known(word), 0), (self._tail(piece[len(word) :]), len(word)))
            if "\n" in piece and not self.drops_space:
                before, _, after = piece.partition("\n")
                if not before:  # a line break and a word that has no space before it
                    word = after.rstrip(MARKS)
                    if _plain(word):
                        tail = after[len(word) :]
                        parts = [(self._tail("\n"), 0), (self._word(word, False), 1)]
                        return self._join(*parts, (self._tail(tail), 1 + len(word))) if tail else self._join(*parts)
                elif not before[-1].isspace() and _plain(after.rstrip(MARKS)):
                    return self._join((self._known(before), 0), (self._known("\n" + after), len(before)))
        ids, spans = self._library(self.lead + piece)
        return self._join(((ids, (np.frombuffer(spans, "<i4") - len(self.lead)).astype("<i4").tobytes() if self.offsets else b""), 0))

    def _renew(self) -> None:
        if len(self.cache) > self.pieces:
            self.cache.old = {}
            self.cache = _Cache(self._learn, dict(self.cache))
        if len(self.tails) > self.pieces:
            self.tails = {}

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts only the library can cut."""
        if not self.by_pieces:
            return np.ones(len(texts), bool)
        out = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s))
        if not self.drops_space:
            out = pc.or_(out, pc.match_substring_regex(texts, LOOSE_SPACE))
        return out.to_numpy(zero_copy_only=False)

    def _lookup(self, texts: pa.Array):
        """The pieces of all texts: their number among the distinct ones, what is known of
        those, their lengths, and where each text's pieces begin. First pieces have no space before them: they are left out."""
        self._renew()
        if self.drops_space:  # white space goes and ASCII case too, so fewer pieces are distinct
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        cut = pc.split_pattern(texts, " ")
        begin = cut.offsets.to_numpy()
        flat = cut.values.slice(begin[0], begin[-1] - begin[0])
        begin = begin - begin[0]
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        known = list(map(self.cache.__getitem__, words.to_pylist()))
        lens = pc.utf8_length(words).to_numpy().astype(np.int64)
        nothing = (b"", b"") if self.offsets else b""
        if not self.drops_space:
            which[begin[:-1][begin[:-1] < begin[1:]]] = len(known)
        return which, [*known, nothing], lens, begin, coded.indices.to_numpy()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        texts = _as_texts(texts)
        whole = self._whole(texts)
        which, known, _, begin, _ = self._lookup(texts)
        if self.offsets:
            known = [k[0] for k in known]
        ids = pa.array(known, pa.binary()).take(pa.array(which))
        at = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1][begin] if len(ids) else np.zeros(len(texts) + 1, np.int32)
        data = memoryview(ids.buffers()[2] or b"")
        out = []
        for i, text in enumerate(texts.to_pylist()):
            if whole[i]:
                out.append(self._library(text)[0])
            else:
                out.append(self._head(text)[0] + bytes(data[at[i] : at[i + 1]]))
        if not self._agrees(texts, whole, out):
            return self.encode(texts)
        return out

    def _agrees(self, texts: pa.Array, whole: np.ndarray, ids: list[bytes]) -> bool:
        """Do some of the texts give what the library gives for them whole? If not, pieces are given up for good, by this worker."""
        some = [i for i in np.flatnonzero(~whole)[:: max(1, len(whole) // CHECKED)] if len(ids[i]) <= 4 * CHECKED_TOKENS][:CHECKED]
        if all(self._library(texts[i].as_py())[0] == ids[i] for i in some):
            return True
        self.by_pieces = False
        return False

    def _head(self, text: str) -> tuple[bytes, bytes]:
        if self.drops_space:
            return b"", b""
        head = text.partition(" ")[0]
        return self._library(head) if head else (b"", b"")

    def encode_spans(self, texts: list[str] | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, and the character spans of its tokens (n x 2)."""
        texts = _as_texts(texts)
        whole = self._whole(texts)
        which, known, lens, begin, number = self._lookup(texts)
        ids = pa.array([k[0] for k in known], pa.binary()).take(pa.array(which))
        spans = pa.array([k[1] for k in known], pa.binary()).take(pa.array(which))
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 4 if len(ids) else np.zeros(1, np.int32)
        flat_ids = np.frombuffer(ids.buffers()[2] or b"", "<u4")
        flat = np.frombuffer(spans.buffers()[2] or b"", "<i4").reshape(-1, 2)
        size = lens[number] + 1 if len(number) else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        place = start - np.repeat(start[np.minimum(begin[:-1], max(len(start) - 1, 0))] if len(start) else np.zeros(0, np.int64), np.diff(begin))
        moved = flat + np.repeat(place, np.diff(ends))[:, None] if len(flat) else np.zeros((0, 2), np.int64)
        at, out = ends[begin], []
        for i, text in enumerate(texts.to_pylist()):
            head = self._library(text) if whole[i] else self._head(text)
            more = slice(0, 0) if whole[i] else slice(at[i], at[i + 1])
            head_ids, head_spans = np.frombuffer(head[0], "<u4"), np.frombuffer(head[1], "<i4").reshape(-1, 2)
            out.append((np.concatenate([head_ids, flat_ids[more]]), np.concatenate([head_spans, moved[more]]).astype(np.int64)))
        if not self._agrees(texts, whole, [x.astype("<u4").tobytes() for x, _ in out]):
            return self.encode_spans(texts)
        return out


def _as_texts(texts: list[str] | pa.Array) -> pa.Array:
    """Texts as an Arrow column without nulls."""
    if not isinstance(texts, (pa.Array, pa.ChunkedArray)):
        texts = pa.array(texts, pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, offsets: bool = False, pieces: int | None = None) -> PieceEncoder:
    """The worker's own encoder for a tokenizer file; it lasts as long as the worker."""
    if (path, offsets) not in _ENCODERS:
        _ENCODERS[path, offsets] = PieceEncoder(path, offsets, pieces)
    return _ENCODERS[path, offsets]
