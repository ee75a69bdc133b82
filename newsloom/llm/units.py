"""Texts as units: a space, a word, and the white space and words that no cut may part.

The vocabularies used here begin a token at a single space between two other
characters.  Cut there, a text has the tokens of its units, one after the other.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single space between two other characters begins a unit.
UNIT_START = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")
#: White space of the line above, for the regular expressions of Arrow.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]"
MIXED_SPACE = f"^ | $|{BLANK} | {BLANK}"


def list_of(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def units_of(texts: pa.Array) -> pa.ListArray:
    """The units of each text without their first space; none for an empty text."""
    mixed = pc.match_substring_regex(texts, MIXED_SPACE)
    plain = pc.split_pattern(pc.if_else(mixed, "", texts), " ")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    odd = mixed.to_numpy(zero_copy_only=False)
    if not (empty | odd).any():
        return plain
    sizes = pc.list_value_length(plain).to_numpy().astype(np.int64)
    split = [[u[1:] for u in UNIT_START.split(" " + t)] for t in texts.filter(mixed).to_pylist()]
    # Rows without their units: those of odd texts follow at the end and are gathered in.
    keep = np.repeat(~(empty | odd), sizes)
    values = pc.list_flatten(plain).filter(pa.array(keep))
    found = pa.array(list(chain.from_iterable(split)), pa.string())
    sizes[empty | odd] = 0
    start = np.cumsum(sizes) - sizes
    late = np.fromiter(map(len, split), np.int64, len(split))
    start[odd] = len(values) + np.cumsum(late) - late
    sizes[odd] = late
    before = np.cumsum(sizes) - sizes
    index = np.arange(int(sizes.sum())) + np.repeat(start - before, sizes)
    return list_of(sizes, pc.take(pa.concat_arrays([values, found]), pa.array(index)))


def runs(lengths: np.ndarray, chars: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``chars`` characters, from the length of each."""
    low, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > low and held + n > chars:
            yield low, i
            low, held = i, 0
        held += n
    if len(lengths):
        yield low, len(lengths)


#: Units encoded by one call, as one text.
TOGETHER = 2_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones
    for themselves, all others for the next characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(model) -> pa.Array:
    """The bytes of each token of a byte-level vocabulary."""
    alphabet = byte_alphabet()
    tokens = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    return pa.array([bytes(alphabet.get(c, 63) for c in t) for t in tokens], pa.binary())


def apart(key: str) -> bool:
    """Whether units may stand on both sides: no white space at either end."""
    return not (key[0].isspace() or key[-1].isspace() or key[0] == "᠎" or key[-1] == "᠎")


class UnitEncoder:
    """Ids of units under a byte-level vocabulary, many units in one text.

    Token lengths tell where a unit ends.  A unit with white space at its ends, which
    would join its neighbours, is encoded alone, and so is each unit of a text whose
    tokens do not end where its units do.
    """

    def __init__(self, model):
        self.many = getattr(model, "encode_batch_fast", model.encode_batch)
        self.bytes = token_bytes(model)
        self.size = pc.binary_length(self.bytes).to_numpy().astype(np.int64)

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts and their numbers."""
        ids = [e.ids for i in range(0, len(texts), TOGETHER)
               for e in self.many(texts[i:i + TOGETHER], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each key, one after the other, and how many each has."""
        free = [i for i, k in enumerate(keys) if apart(k)]
        sizes, found = np.zeros(len(keys), np.int64), []
        late = np.ones(len(keys), bool)
        for i in range(0, len(free), TOGETHER):
            at = np.array(free[i:i + TOGETHER])
            part = [keys[j] for j in at]
            ids = np.array(self.many([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            end = np.cumsum(self.size[ids])
            wanted = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy().astype(np.int64) + 1)
            cut = np.searchsorted(end, wanted)
            if len(end) and end[-1] == wanted[-1] and (end[cut] == wanted).all():
                late[at] = False
                sizes[at] = np.diff(np.append(-1, cut))
                found.append((at, ids))
        rest = np.flatnonzero(late)
        if len(rest):
            ids, n = self.alone([" " + keys[j] for j in rest])
            sizes[rest] = n
            found.append((rest, ids))
        out, start = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for at, ids in found:
            n = sizes[at]
            out[np.arange(len(ids)) + np.repeat(start[at] - (np.cumsum(n) - n), n)] = ids
        return out, sizes


#: Pieces of a unit: the vocabularies' own expression parts letters, digits and the rest.
OTHER, LETTER, DIGIT, BREAK, ODD = range(5)
#: Pieces encoded by one call, as one text.
PIECES = 256
#: Strings looked at together.
SLICE = 1 << 15


def string_data(strings: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where strings begin and end in their bytes, and these."""
    _, offsets, data = strings.buffers()
    edges = np.frombuffer(offsets, np.int32)[strings.offset:strings.offset + len(strings) + 1]
    return edges - edges[0], bytes(memoryview(data)[edges[0]:edges[-1]])


@cache
def character_kinds() -> np.ndarray:
    """Kind of each of the first 65,536 characters; the last entry is for all others.

    Only what has been a letter, a number or a sign since Unicode 3.2 is told apart, so
    that no version of a tokenizer sees it otherwise.  An apostrophe may begin a
    contraction, so it is odd, as is white space other than a line break.
    """
    kinds = np.full((1 << 16) + 1, ODD, np.uint8)
    of = {"L": LETTER, "N": DIGIT, "P": OTHER, "S": OTHER, "M": OTHER}
    for i in range(1 << 16):
        now = unicodedata.category(chr(i))[0]
        if now in of and now == unicodedata.ucd_3_2_0.category(chr(i))[0]:
            kinds[i] = of[now]
    kinds[ord("\n")], kinds[ord("'")] = BREAK, ODD
    return kinds


def pieces_of(bodies: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of pieces of each unit, all pieces in order, and whether each is plain.

    A piece is a run of one kind or a single line break.  A unit with an odd character,
    with a line break at an end or with two in a row is one piece, which is not plain;
    neither is a line break.  No unit may be empty.
    """
    found = [_pieces(bodies.slice(i, SLICE), kinds) for i in range(0, len(bodies), SLICE)]
    if not found:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, bool)
    counts, pieces, plain = zip(*found)
    return np.concatenate(counts), pa.concat_arrays(pieces), np.concatenate(plain)


def _pieces(bodies: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    _, raw = string_data(bodies)
    chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    n = pc.utf8_length(bodies).to_numpy().astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    kind = kinds[np.minimum(chars, len(kinds) - 1)]
    broken = kind == BREAK
    bad = kind == ODD
    bad[1:] |= broken[1:] & broken[:-1]
    bad[start] |= broken[start]
    bad[end - 1] |= broken[end - 1]
    odd = np.add.reduceat(bad, start, dtype=np.int64) > 0
    cut = np.append(True, kind[1:] != kind[:-1])
    cut[np.repeat(odd, n)] = False
    cut[start] = True
    at = np.flatnonzero(cut)
    width = 1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800) + (chars >= 0x10000)
    place = np.append((np.cumsum(width, dtype=np.int32) - width)[at], np.int32(len(raw)))
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(place), pa.py_buffer(raw))
    counts = np.add.reduceat(cut, start, dtype=np.int64)
    return counts, pieces, ~np.repeat(odd, counts) & (kind[at] != BREAK)


class PieceEncoder:
    """Ids of pieces under a byte-level vocabulary; plain ones go straight to its model.

    Many pieces are one text, a line each, in the characters that stand for their bytes.
    All others, and lines whose tokens do not have their bytes, are encoded as units.
    A vocabulary that does not part words by the expression of GPT-2 has no plain pieces.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.units = UnitEncoder(tokenizer)
        lines = Tokenizer(tokenizer.model)
        lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.lines = getattr(lines, "encode_batch_fast", lines.encode_batch)
        self.alphabet = {b: c for c, b in byte_alphabet().items() if b != ord("\n")}
        model, parts = tokenizer.model, tokenizer.pre_tokenizer
        said = json.loads(parts.__getstate__()) if parts else {}
        known = (said.get("type"), said.get("add_prefix_space"), said.get("use_regex", True)) == (
            "ByteLevel", False, True) and tokenizer.normalizer is None and type(model).__name__ == "BPE"
        known = known and not (model.dropout or model.unk_token or model.continuing_subword_prefix
                               or model.end_of_word_suffix)
        self.kinds = character_kinds().copy()
        # Added tokens are found before words are parted.
        for token in tokenizer.get_added_tokens_decoder().values():
            self.kinds[min(ord(token.content[0]), 1 << 16)] = ODD
        if not known:
            self.kinds[:] = ODD

    def encode(self, pieces: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, each after a space if ``spaced``, and how many each has."""
        counts, _, plain = pieces_of(pieces, self.kinds)
        direct = counts == 1
        direct[direct] = plain[(np.cumsum(counts) - counts)[direct]]
        sizes, found = np.zeros(len(pieces), np.int64), []
        late = ~direct
        at = np.flatnonzero(direct)
        wide = pc.binary_length(pieces).to_numpy().astype(np.int64)[at] + spaced
        groups = np.append(np.arange(0, len(at), PIECES), len(at))
        texts = pc.binary_join(pa.ListArray.from_arrays(
            pa.array(groups.astype(np.int32)), pieces.filter(pa.array(direct))), "\n").to_pylist()
        lead = chr(288) if spaced else ""  # what stands for a space
        for i, j, text in zip(groups[:-1], groups[1:], texts):
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.alphabet)
            text = lead + text.replace("\n", "\n" + lead)
            ids = np.array(self.lines([text], add_special_tokens=False)[0].ids, np.int32)
            end, wanted = np.cumsum(self.units.size[ids]), np.cumsum(wide[i:j])
            cut = np.searchsorted(end, wanted)
            if len(end) and end[-1] == wanted[-1] and (end[cut] == wanted).all():
                sizes[at[i:j]] = np.diff(np.append(-1, cut))
                found.append((at[i:j], ids))
            else:
                late[at[i:j]] = True
        rest = np.flatnonzero(late)
        if len(rest):
            units = pieces.filter(pa.array(late)).to_pylist()
            ids, n = self.units.encode(units) if spaced else self.units.alone(units)
            sizes[rest] = n
            found.append((rest, ids))
        out, start = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for at, ids in found:
            n = sizes[at]
            out[np.arange(len(ids)) + np.repeat(start[at] - (np.cumsum(n) - n), n)] = ids
        return out, sizes
