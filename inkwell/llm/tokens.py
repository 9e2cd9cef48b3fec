"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

The pre-tokenizer of such a BPE cuts a text before a space, or around a line
break, that has no white space beside it, and between an ASCII letter or digit
and a mark. No token crosses such a cut, so the ids of a text are those of
its chunks, and a chunk that was seen before needs no second run. ``tests/llm`` holds this
against the library's ids of uncut texts.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides the space and the line feed.
_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE = re.compile("[\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Classes of bytes: 1 white space, 2 ASCII letters and digits, 3 ASCII marks but the apostrophe, which begins contractions.
_CLASS = np.zeros(256, "u1")
_CLASS[[32, 10]] = 1
_CLASS[[i for i in range(128) if chr(i).isalnum()]] = 2
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = 3
_BLOCK = 1 << 22


class Encoder:
    """Encodes texts to the little-endian 32-bit ids, an end id appended.

    Chunks are kept, and forgotten together once there are more than ``cache``
    of them or their text passes a bound.
    """

    def __init__(self, path: str, end_id: int, cache: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end = array("I", [end_id]).tobytes()
        self.cache = cache
        self._forget()
        # A character of a byte-level token stands for a byte.
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab().items()}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], "i8")

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.large_string())
        self.ids, self.first, self.size = np.zeros(0, "<u4"), np.zeros(0, "i8"), np.zeros(0, "i4")

    def _whole(self, chunk: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Encodes and keeps chunks that are not known; gives their places
        among those.

        Those that begin with a space are encoded by way of their joined text,
        which is cut again where they were cut: the tokens' bytes tell which
        belong to which. Others are encoded one by one.
        """
        texts = new.to_pylist()
        joins = np.array([len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace() for c in texts], bool)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        new = new.take(pa.array(order))
        offsets = np.frombuffer(new.buffers()[1], "i8")[new.offset : new.offset + len(new) + 1]
        n, ids, sizes = int(joins.sum()), [], []
        for i in range(0, n, 400):
            k = min(i + 400, n)
            some = self._whole("".join([texts[j] for j in order[i:k]]))
            ends = np.cumsum(self.sizes[some])
            wanted = offsets[i + 1 : k + 1] - offsets[i]
            at = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[at], wanted):
                raise ValueError("a token crosses chunks; is this vocabulary a byte-level BPE?")
            ids.append(some)
            sizes.append(np.diff(at + 1, prepend=0))
        if n < len(texts):
            found = self.tokenizer.encode_batch_fast([texts[j] for j in order[n:]], add_special_tokens=False)
            ids += [np.array(e.ids, "<u4") for e in found]
            sizes.append(np.array([len(x) for x in ids[-len(found) :]], "i8"))
        sizes = np.concatenate(sizes)
        first = np.cumsum(sizes) - sizes + len(self.ids)
        self.chunks = pa.concat_arrays([self.chunks, new])
        self.ids = np.concatenate([self.ids, *ids])
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, sizes.astype("i4")])
        return np.argsort(order)

    @staticmethod
    def _pieces(block: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The chunks of texts whose white space is spaces and line feeds, the
        number of chunks up to the end of each text, and which texts have two
        of these in a row, so that the cuts may be wrong."""
        parts = [t.encode() for t in block]
        raw = b"".join(parts)
        data = np.frombuffer(raw, "u1")
        stops = np.cumsum([len(x) for x in parts])
        kind = _CLASS[data]
        feed = data == 10
        cut = data == 32
        cut |= feed
        cut[1:] |= feed[:-1]
        cut[1:] |= (kind[1:] == 3) & (kind[:-1] == 2)
        cut[np.concatenate([[0], stops])[:-1][stops > np.concatenate([[0], stops[:-1]])]] = True
        starts = np.flatnonzero(cut)
        ends = np.searchsorted(starts, stops)
        pair = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 1))
        # A pair may belong to two texts.
        text = np.searchsorted(stops, pair, "right")
        odd = np.unique(text[pair + 1 < stops[text]])
        offsets = np.append(starts, len(data)).astype("i8")
        flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return ends, flat, odd

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in blocks of about four million characters."""
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= _BLOCK:
                yield from self._encode(block)
                block, size = [], 0
        yield from self._encode(block)

    def _encode(self, block: list[str]) -> list[bytes]:
        if not any(block):
            return [self.end for _ in block]
        joined = "".join(block)
        plain = not any(c in joined for c in _OTHER) and (joined.isascii() or not _WIDE.search(joined))
        if plain:
            ends, flat, odd = self._pieces(block)
            if not len(odd):
                return self._coded(ends, flat)
            odd = set(odd.tolist())
        else:
            odd = {i for i, t in enumerate(block) if any(c in t for c in _OTHER) or not t.isascii() and _WIDE.search(t)}
            even = [i for i in range(len(block)) if i not in odd and block[i]]
            if even:
                odd |= {even[k] for k in self._pieces([block[i] for i in even])[2].tolist()}
        out: list[bytes] = [self.end] * len(block)
        even = [i for i in range(len(block)) if i not in odd and block[i]]
        if even:
            ends, flat, _ = self._pieces([block[i] for i in even])
            for i, ids in zip(even, self._coded(ends, flat)):
                out[i] = ids
        # Here only a space between two characters that are no white space is cut at.
        cut = [(i, _CUT.split(block[i])) for i in sorted(odd) if block[i]]
        flat = pa.array([x for _, c in cut for x in c], pa.large_string())
        for (i, _), ids in zip(cut, self._coded(np.cumsum([len(c) for _, c in cut]), flat) if cut else []):
            out[i] = ids
        return out

    def _coded(self, ends: np.ndarray, flat: pa.Array) -> list[bytes]:
        coded = flat.dictionary_encode()
        if len(self.chunks) > self.cache or self.chunks.nbytes > 64 * self.cache:
            self._forget()
        slots = pc.index_in(coded.dictionary, value_set=self.chunks)
        place = slots.fill_null(-1).to_numpy()
        if slots.null_count:
            place, kept = place.copy(), len(self.chunks)
            place[place < 0] = kept + self._learn(coded.dictionary.filter(slots.is_null()))
        slot = place[coded.indices.to_numpy()]
        first, size = self.first[slot], self.size[slot]
        total = np.cumsum(size, dtype="i8")
        at = np.repeat(first - (total - size), size)
        at += np.arange(len(at))
        raw = self.ids[at].tobytes()
        stops = np.concatenate([[0], np.concatenate([[0], total])[ends]]) * 4
        return [raw[a:b] + self.end for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker, so that it keeps what it knows."""
    return Encoder(path, end_id)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies; asked on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)
