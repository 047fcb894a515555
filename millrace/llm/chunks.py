"""Token ids of many texts at once: each different stretch of a batch is encoded once.

A text is cut before single spaces between two characters that are no white
space. No token of the vocabularies here lies across such a cut (checked for
each when it is loaded), so a text's ids are its stretches' ids in order. The
stretches of an Arrow batch are numbered by Arrow's dictionary encoding, the
different ones are encoded, and numpy lays their ids out. Those of characters
whose kinds no version of Unicode changes go through tiktoken with the
vocabulary's ranks, all others through the vocabulary's own library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a stretch may begin and end with: kinds of characters that no version of Unicode counts as white space.
SOLID = r"[!-~\p{L}\p{N}\p{M}\p{P}\p{S}]"
#: Byte-level vocabularies' usual way to cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer stretches go through the vocabulary's own library.
SHORT = 200
#: Latin, Greek, Cyrillic and Armenian stretches.
PLAIN = "^[!-~\u00a1-\u058f]([\t\n -~\u00a1-\u058f]{0,%d}[!-~\u00a1-\u058f])?$" % SHORT
#: Words of Latin letters that lower-case one to one and that no normal form changes.
LATIN = "^[!-~\u00a1-\u012f\u0131-\u017f]{1,%d}$" % SHORT


@dataclass
class Stretches:
    """Texts: their stretches' numbers one after another, where each text begins (and the last ends), and the different stretches less a leading space."""

    codes: np.ndarray
    starts: np.ndarray
    different: pa.Array


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    return column


def _mask(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def stretches(texts: pa.Array) -> Stretches:
    """Of texts without nulls."""
    listed = pc.split_pattern(texts.cast(pa.string()), " ")
    starts = listed.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    coded = flat(listed.flatten()).dictionary_encode()
    codes, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    begins, ends = (_mask(pc.match_substring_regex(different, p)) for p in (f"^{SOLID}", f"{SOLID}$"))
    cut = np.ones(len(codes), bool)
    cut[1:] = ends[codes[:-1]] & begins[codes[1:]]
    cut[starts[:-1]] = True
    if not cut.all():
        # parts between which no cut is sure are one stretch
        first = np.flatnonzero(cut)
        size = np.diff(np.r_[first, len(codes)])
        many = np.flatnonzero(size > 1)
        parts = different.take(pa.array(codes[spread(first[many], size[many])]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[many])], pa.int32()), parts), " ").dictionary_encode()
        starts = np.searchsorted(first, starts)
        codes = codes[first]
        codes[many] = joined.indices.to_numpy() + len(different)
        different = pa.concat_arrays([different, joined.dictionary])
    return Stretches(codes, starts, different)


def words(texts: pa.Array) -> Stretches:
    """Texts without nulls cut at ASCII white space, which is dropped."""
    listed = pc.ascii_split_whitespace(texts.cast(pa.string()))
    starts = listed.offsets.to_numpy().astype(np.int64)
    coded = flat(listed.flatten()).dictionary_encode()
    return Stretches(coded.indices.to_numpy().astype(np.int64), starts - starts[0], coded.dictionary)


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many bytes in all; a longer text is a run of its own."""
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each slice, one after another."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return out + np.arange(len(out))


@dataclass
class Encoded:
    """Ids of numbered strings, one after another; how many each has."""

    ids: np.ndarray
    sizes: np.ndarray

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these strings in order, and how many each has."""
        sizes = self.sizes[codes]
        return self.ids[spread((np.cumsum(self.sizes) - self.sizes)[codes], sizes)], sizes

    def texts(self, found: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last's end)."""
        ids, sizes = self.take(found.codes)
        return ids, np.r_[0, np.cumsum(sizes)][found.starts]


def _by_kind(names: pa.Array, plain: np.ndarray, fast, slow) -> Encoded:
    """Encode the plain ones by fast, the others by slow; each gives (ids, sizes)."""
    sizes = np.zeros(len(names), np.int64)
    ids, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mask, encode, step in ((plain, fast, 1 << 16), (~plain, slow, 1 << 12)):
        own = np.flatnonzero(mask)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            got, sizes[part] = encode(names.take(pa.array(part)))
            ids.append(got)
            which.append(part)
    by = np.concatenate(which)
    out = np.zeros(int(sizes.sum()), np.int64)
    out[spread((np.cumsum(sizes) - sizes)[by], sizes[by])] = np.concatenate(ids)
    return Encoded(out, sizes)


def _plain(names: pa.Array, pattern: str, special: list[str]) -> np.ndarray:
    plain = _mask(pc.match_substring_regex(names, pattern))
    for s in special:
        plain &= ~_mask(pc.match_substring(names, s))
    return plain


def _joined(names: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), by)[0].as_py()


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies' characters for bytes: printable Latin-1 stands for itself, the rest from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


def merges_agree(ranks: dict[bytes, int], pairs: list[tuple[bytes, bytes]]) -> bool:
    """Whether merging the neighbours whose join has the least rank, on each merge's own bytes, ends with that merge's pair.

    If so, merging by the tokens' ranks alone gives what merging by the list of pairs gives.
    """
    for left, right in pairs:
        whole = left + right
        rank, part = ranks[whole], [whole[k : k + 1] for k in range(len(whole))]
        while len(part) > 2:
            best = min((ranks.get(part[k] + part[k + 1], rank), k) for k in range(len(part) - 1))
            if best[0] >= rank:
                return False
            k = best[1]
            part[k : k + 2] = [part[k] + part[k + 1]]
        if part != [left, right]:
            return False
    return True


def _library(path: str, plain_specials: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = plain_specials
    return model, json.loads(model.to_str())


def _merges(told: dict, code) -> list[tuple[bytes, bytes]]:
    return [tuple(code(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in told["model"]["merges"]]


def _listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, on stretches with their leading space.

    plain_specials: special tokens' strings in a text are plain text.
    """

    def __init__(self, path: str, plain_specials: bool) -> None:
        self.model, told = _library(path, plain_specials)
        before, model, byte = told["pre_tokenizer"] or {}, told["model"], byte_of()
        usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and told["normalizer"] is None
        if not usual or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path} is not a byte-level vocabulary that cuts before spaces")
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if all(c in byte for c in t)}
        self.bytes |= {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        self.special = [] if plain_specials else [t["content"] for t in told["added_tokens"]]
        pairs = _merges(told, lambda t: bytes(byte[c] for c in t))
        ranks = {self.bytes[i]: i for i in sorted(self.bytes) if i < 256 + len(pairs)}
        ordered = all(ranks.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)) and sorted(ranks[bytes([b])] for b in range(256)) == list(range(256))
        self.fast = None
        if ordered and merges_agree(ranks, pairs):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.length[i] = len(b)

    def _together(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self.fast.encode_to_numpy(" " + _joined(names, " "), disallowed_special=()).astype(np.int64)
        # stretches are cut where their bytes end
        ends = np.cumsum(pc.binary_length(names).to_numpy() + 1)
        return ids, np.diff(np.r_[0, np.searchsorted(np.cumsum(self.length[ids]), ends, "right")])

    def _single(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _listed([e.ids for e in self.model.encode_batch_fast([" " + n for n in names.to_pylist()], add_special_tokens=False)])

    def __call__(self, names: pa.Array) -> Encoded:
        plain = _plain(names, PLAIN, self.special) if self.fast else np.zeros(len(names), bool)
        return _by_kind(names, plain, self._together, self._single)


class Pieces:
    """A sentencepiece vocabulary that adds a leading space, on stretches without theirs."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^\u2581]\u2581", p) for p in named):
            raise ValueError(f"{path} has pieces that go on after a space")
        self.bytes = dict(enumerate(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(named)))
        self.length = np.fromiter((len(self.bytes[i]) for i in range(len(named))), np.int64, len(named))

    def __call__(self, names: pa.Array) -> Encoded:
        encode = lambda some: _listed(self.model.encode(some.to_pylist(), num_threads=1))
        return _by_kind(names, np.zeros(len(names), bool), encode, encode)


#: The mark after each word of a vocabulary with word ends; words hold no space.
END = b" "
#: Word parts of lower-case text of LATIN's characters.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordEnds:
    """A vocabulary of the tokenizers library that lower-cases, drops white space and marks the ends of words."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        self.model, told = _library(path, plain_specials)
        model, byte = told["model"], byte_of()
        mark = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not mark or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix")):
            raise ValueError(f"{path} is not a vocabulary that marks the ends of words")
        code = lambda t: bytes(byte[c] for c in t.removesuffix(mark)) + (END if t.endswith(mark) else b"")
        self.special = [] if plain_specials else [t["content"] for t in told["added_tokens"]]
        ids = {code(t): i for t, i in model["vocab"].items() if all(c in byte for c in t.removesuffix(mark))}
        pairs = _merges(told, code)
        # a last byte with its mark comes before all merges, as it is one symbol from the start
        start = [(bytes([b]), END) for b in range(256)]
        ranks = {bytes([b]): ids[bytes([b])] for b in range(256)} | {a + b: ids[a + b] for a, b in start} | {a + b: ids[a + b] for a, b in pairs}
        ordered = all(ranks[a + b] == 512 + k for k, (a, b) in enumerate(pairs)) and sorted(ranks[a] for a, _ in start) == list(range(256)) and sorted(ranks[a + b] for a, b in start) == list(range(256, 512))
        self.fast = None
        if ordered and merges_agree(ranks, pairs):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            self.stop = ranks[b"\n" + END]

    def _together(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(pc.utf8_lower(names), WORDS, "\\0 ")
        ids = self.fast.encode_to_numpy(_joined(marked, "\n ") + "\n ", disallowed_special=()).astype(np.int64)
        stop = ids == self.stop
        return ids[~stop], np.diff(np.r_[-1, np.flatnonzero(stop)]) - 1

    def _single(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _listed([e.ids for e in self.model.encode_batch_fast(names.to_pylist(), add_special_tokens=False)])

    def __call__(self, names: pa.Array) -> Encoded:
        plain = _plain(names, LATIN, self.special) if self.fast else np.zeros(len(names), bool)
        return _by_kind(names, plain, self._together, self._single)
