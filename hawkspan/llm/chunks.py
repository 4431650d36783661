"""Byte-level pre-tokens of whole texts, a batch at a time, with a bounded memory of what was encoded before.

Texts are cut at single spaces between two visible characters. The public pattern always ends a match there and begins the next one
with that space, so each chunk (with its leading space) encodes by itself. A batch is cut and numbered by Arrow; only chunks that the
memory does not have are looked at one by one, cut by one search over all of them and encoded; numpy puts the ids of all texts
together. A text where white space meets a space, or begins or ends the text, is cut as a whole.

In the memory a chunk goes by what follows its space; the one that begins a text, which has no such space, goes by itself after a space.
"""

from __future__ import annotations

import struct
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LONG = 100  # code points beyond which a chunk is not kept
SLICE_BYTES = 8_000_000
WHITE = r"\t-\r\x20\x85\xA0  -     　"  # fixed value: Unicode white space
#: The same and four controls that some take for white space, without the space, as Arrow's patterns spell it.
OTHER_WHITE = r"\t-\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNCUT = f"^$|  |^ | $|[{OTHER_WHITE}] | [{OTHER_WHITE}]|[{OTHER_WHITE}]$"


def kept_in_worker(name: str, make: Callable):
    """What ``make`` gives. A Python worker keeps the last one for its later tasks; a new worker makes its own, so nothing depends on it.

    Functions reach the workers by value, without a module to keep things in: hence one made here.
    """
    place = sys.modules.setdefault("hawkspan_worker_memory", types.ModuleType("hawkspan_worker_memory"))
    if getattr(place, "name", None) != name:
        place.value = None
        place.value, place.name = make(), name
    return place.value


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


class Encoded:
    """Strings with the ids each stands for, as Arrow and numpy arrays; forgets all when full."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.names, self.ids, self.starts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Entry number of each string, -1 where there is none."""
        return pc.fill_null(pc.index_in(wanted, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def forget_long(self) -> None:
        """Keeps the memory to strings that may come again: long ones go."""
        long = pc.greater(pc.utf8_length(self.names), LONG)
        if pc.any(long).as_py():
            keep = np.flatnonzero(~long.to_numpy(zero_copy_only=False))
            names, (ids, sizes) = self.names.take(pa.array(keep)), self.gather(keep)
            self.forget()
            self.add(names, sizes, ids)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after the other, and how many each has."""
        begin = self.starts[entries]
        sizes = self.starts[entries + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)], sizes


class ChunkMemory:
    """Encodes texts chunk by chunk. ``encode`` maps a list of pre-tokens to their lists of ids; ``limit``: entries kept of either kind."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]], limit: int = 400_000):
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.cut, self.encode = regex.compile(white).findall, encode
        self.chunks, self.tokens = Encoded(limit), Encoded(limit)

    def encoded(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        return [ids.tobytes() for ids in self.encoded_array(pa.array(list(texts), pa.string()))]

    def encoded_array(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (none is null)."""
        uncut = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for chosen, encode in ((np.flatnonzero(uncut), self._whole), (np.flatnonzero(~uncut), self._by_chunks)):
            if len(chosen):
                for i, ids in zip(chosen.tolist(), encode(texts.take(pa.array(chosen))), strict=True):
                    out[i] = ids
        return out

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        pieces = [self.cut(text) for text in texts.to_pylist()]
        ids, sizes = self._token_ids([token for tokens in pieces for token in tokens])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cuts = ends[np.cumsum([0, *map(len, pieces)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _by_chunks(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        flat = words.flatten()
        heads = np.zeros(len(flat), bool)
        heads[offsets[:-1]] = True
        named = pc.replace_with_mask(flat, pa.array(heads), pc.binary_join_element_wise(pa.scalar(""), flat.filter(pa.array(heads)), " "))
        numbered = named.dictionary_encode()
        entries = self._entries(numbered.dictionary)
        ids, sizes = self.chunks.gather(entries[numbered.indices.to_numpy(zero_copy_only=False)])
        cuts = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        self.chunks.forget_long()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _entries(self, names: pa.Array) -> np.ndarray:
        """The entry numbers of chunks by name; those that the memory does not have are encoded first."""
        places = self.chunks.places(names)
        if len(self.chunks.names) + np.count_nonzero(places < 0) > self.chunks.limit:
            self.chunks.forget()
            places[:] = -1
        missing = np.flatnonzero(places < 0)
        if len(missing):
            places[missing] = np.arange(len(missing)) + len(self.chunks.names)
            self._learn(names.take(pa.array(missing)))
        return places

    def _learn(self, names: pa.Array) -> None:
        """Inner chunks stand in one line, each with its space, and are cut together: a token that begins with a space begins a chunk."""
        begins = pc.starts_with(names, " ").to_numpy(zero_copy_only=False)
        inner, heads = names.filter(pa.array(~begins)), names.filter(pa.array(begins)).to_pylist()
        tokens = self.cut(f" {' '.join(inner.to_pylist())}") if len(inner) else []
        first = np.flatnonzero(pc.starts_with(pa.array(tokens, pa.string()), " ").to_numpy(zero_copy_only=False))
        per_chunk = np.zeros(len(names), np.int64)
        per_chunk[~begins] = np.diff(np.append(first, len(tokens)))
        head_tokens = [self.cut(name[1:]) for name in heads]
        per_chunk[begins] = [len(x) for x in head_tokens]
        # The line's order is inner chunks first; ids are put back into the order of the names.
        ids, sizes = self._token_ids([*tokens, *(token for x in head_tokens for token in x)])
        order = np.argsort(begins, kind="stable")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(per_chunk[order])])
        chunk_sizes, begin = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        chunk_sizes[order], begin[order] = np.diff(ends[bounds]), ends[bounds[:-1]]
        stops = np.cumsum(chunk_sizes)
        moved = ids[np.repeat(begin - (stops - chunk_sizes), chunk_sizes) + np.arange(int(stops[-1]))]
        self.chunks.add(names, chunk_sizes, moved)

    def _token_ids(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and how many each has."""
        if not tokens:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        numbered = pa.array(tokens, pa.string()).dictionary_encode()
        places = self.tokens.places(numbered.dictionary)
        if len(self.tokens.names) + np.count_nonzero(places < 0) > self.tokens.limit:
            self.tokens.forget()
            places[:] = -1
        missing = np.flatnonzero(places < 0)
        if len(missing):
            names = numbered.dictionary.take(pa.array(missing))
            found = self.encode(names.to_pylist())
            places[missing] = np.arange(len(missing)) + len(self.tokens.names)
            self.tokens.add(names, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((i for ids in found for i in ids), np.uint32))
        result = self.tokens.gather(places[numbered.indices.to_numpy(zero_copy_only=False)])
        self.tokens.forget_long()
        return result


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)
