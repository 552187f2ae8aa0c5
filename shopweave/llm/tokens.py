"""Byte-level BPE ids of whole texts, from the tokenizers library, each different piece of many texts encoded once.

A byte-level pre-tokenizer cuts a text into pieces and the BPE model encodes each piece by itself, so a piece has the
same ids wherever it stands. `Encoder` cuts texts before single spaces and line breaks, which are always cuts
between pieces unless white space meets white space, numbers the different units and their pieces with Arrow, asks the model
once for each different piece, and lets Arrow gather the ids of units and texts. Pieces go to the model many at a time, those
without a space marked by a line break, which is as good as one by one where no token of the vocabulary has a space or a line
break beside another usual character, but for one space in front. Texts where that reasoning might not hold (white
space in a row or at an end, unusual characters, special-token strings, another kind of tokenizer) go to
`Tokenizer.encode` as a whole; results are the library's in either case. Nothing is kept from one lot of texts to the next.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: A piece of a unit, where white space stands alone in front.
PIECE = rf"('(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+)"
#: Characters whose classes are the same in any Unicode version.
USUAL = r"^[\n -~¡-ɏ]*$"
BLANKS = ("  ", " \n", "\n ", "\n\n", "\0")
#: Characters of the texts, and pieces, that are looked at together.
TOGETHER, RUN = 16_000_000, 100


#: The letters for a space and a line break.
SPACE, LINE = "Ġ", "Ċ"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


def worker_memory() -> types.ModuleType:
    """Kept by the Python worker from task to task."""
    return sys.modules.setdefault("shopweave_worker_memory", types.ModuleType("shopweave_worker_memory"))


def encoder(path: str) -> Encoder:
    memory = worker_memory()
    if getattr(memory, "encoder_path", None) != path:
        memory.encoder, memory.encoder_path = Encoder(path), path
    return memory.encoder


def content(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without nulls, and where each begins, with the end."""
    _, offsets, raw = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(raw, np.uint8)[: at[-1]] if raw else np.zeros(0, np.uint8), at


def strings(kind: pa.DataType, at: np.ndarray, raw: np.ndarray | bytes) -> pa.Array:
    """Large strings or binaries of these bytes."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(raw)])


class Encoder:
    """encode and encode_all give ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.plain = (
            self.tokenizer.normalizer is None
            and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
            and not self.tokenizer.pre_tokenizer.add_prefix_space
            and self.tokenizer.pre_tokenizer.use_regex
            and type(self.model).__name__ == "BPE"
            and self.model.continuing_subword_prefix is None
        )
        vocabulary = self.tokenizer.get_vocab() if self.plain else {}
        # Bytes as letters in UTF-16. A token over two pieces would have a mark beside another character, but for a space in front.
        # Those with the no-break space or control characters cannot arise from USUAL.
        self.utf16 = np.array([ord(self.letters[b]) for b in range(256)], "<u2")
        no_break = "\xa0".encode().decode("latin-1").translate(self.letters)
        control = {self.letters[b] for b in range(32) if b != 10}
        over = (t for t in vocabulary if (SPACE in t[1:] or (LINE in t and t != LINE)) and t.strip(SPACE + LINE))
        self.in_runs = LINE in vocabulary and all(no_break in t or control & set(t) for t in over)
        self.line = vocabulary.get(LINE)
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token[:1] in (SPACE, LINE)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def runs(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that begin with a space or a line break, without the latter, one behind the other, and how many each has."""
        raw, at = content(pieces)
        letters = self.utf16[raw].tobytes().decode("utf-16-le")
        found: list[int] = []
        for k in range(0, len(pieces), RUN):
            found += [t.id for t in self.model.tokenize(letters[at[k] : at[min(k + RUN, len(pieces))]])]
        ids = np.array(found, "<u4")
        leads = np.flatnonzero(self.leads[ids])
        if len(leads) != len(pieces):
            raise ValueError("a token goes over the border of two pieces")
        return ids[ids != self.line], np.diff(leads, append=len(ids)) - (ids[leads] == self.line)

    def pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of these pieces, in bytes."""
        alone = pc.match_substring_regex(pieces, r"^ ?$|\n").to_numpy(zero_copy_only=False) | (not self.in_runs)
        many = pieces.filter(pa.array(~alone))
        spaced = pc.starts_with(many, " ")
        line, nothing = (pa.scalar(c, pa.large_string()) for c in ("\n", ""))
        ids, lengths = self.runs(pc.if_else(spaced, many, pc.binary_join_element_wise(line, many, nothing)))
        rest = list(map(self.piece, pieces.filter(pa.array(alone)).to_pylist()))
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])] = np.arange(len(pieces))
        lengths = np.concatenate([4 * lengths, np.array(list(map(len, rest)), np.int64)])
        return strings(pa.large_binary(), np.append(0, np.cumsum(lengths)), ids.tobytes() + b"".join(rest)).take(pa.array(place))

    def cuttable(self, text: str) -> bool:
        """Whether the text may be encoded in units."""
        return (
            self.plain
            and text != ""
            and text[0] not in " \n"
            and text[-1] not in " \n"
            and not any(b in text for b in BLANKS)
            and not any(s in text for s in self.special)
        )

    def coded(self, units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids in bytes, in another order than the units; the place of each unit there, and whether its characters are usual.

        Units with others have no ids.
        """
        usual = pc.match_substring_regex(units, USUAL).to_numpy(zero_copy_only=False)
        word = pc.match_substring_regex(units, f"^ [{LETTERS}]+$").to_numpy(zero_copy_only=False) & usual
        order = [np.flatnonzero(word), np.flatnonzero(usual & ~word), np.flatnonzero(~usual)]
        words, marked = (units.take(pa.array(k)) for k in order[:2])
        # Behind each piece a NUL, so that the last piece of each is empty.
        cut = pc.split_pattern(pc.replace_substring_regex(marked, PIECE, r"\1" + "\0"), "\0")
        found = pa.concat_arrays([words, cut.flatten()]).dictionary_encode()
        raw, ends = content(self.pieces(found.dictionary).take(found.indices))
        bounds = np.concatenate([np.arange(len(words)), len(words) + cut.offsets.to_numpy()])
        place = np.empty(len(units), np.int64)
        place[np.concatenate(order)] = np.arange(len(units))
        return strings(pa.large_binary(), np.concatenate([ends[bounds], np.full(len(order[2]), ends[-1])]), raw), place, usual

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units one behind the other; of each unit where they start, how many they are, and whether its characters are usual."""
        coded, place, usual = self.coded(units)
        raw, at = content(coded)
        return raw.view("<u4"), at[place] // 4, np.diff(at)[place] // 4, usual

    def in_units(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of cuttable texts."""
        if not texts:
            return
        raw, bounds = content(pa.array(texts, pa.large_string()))
        cut = (raw == ord(" ")) | (raw == ord("\n"))
        cut[bounds[:-1]] = True
        cuts = np.append(np.flatnonzero(cut), len(raw))
        of_text = np.searchsorted(cuts, bounds)
        units = strings(pa.large_string(), cuts, raw).dictionary_encode()
        coded, place, usual = self.coded(units.dictionary)
        at = units.indices.to_numpy()
        ids, ends = content(coded.take(pa.array(place[at])))
        bounds = ends[of_text].tolist()
        strange = np.add.reduceat(~usual[at], of_text[:-1], dtype=np.int64).tolist()
        for k, text in enumerate(texts):
            yield self.whole(text) if strange[k] else ids[bounds[k] : bounds[k + 1]].tobytes()

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self.together(held)
                held, size = [], 0
        yield from self.together(held)

    def together(self, texts: list[str]) -> Iterator[bytes]:
        fine = list(map(self.cuttable, texts))
        ready = self.in_units([t for t, f in zip(texts, fine, strict=True) if f])
        for text, f in zip(texts, fine, strict=True):
            yield next(ready) if f else self.whole(text)

    def encode(self, text: str) -> bytes:
        return next(self.together([text]))
