"""Token ids of whole texts with a tokenizers file, each distinct unit of text being encoded once in a worker.

Where a tokenizer's pre-tokenizer never joins text across white space, a text's ids are those of its words one after
another. Words met before come from a dictionary of id bytes; new ones are encoded many at a time in one text, where
the first or the last token of a word shows its ends. A text with unusual white space, or any text of another kind of
tokenizer, is encoded whole, so the ids are always those of the whole text.
"""

from __future__ import annotations

import gc
import json
import os
from itertools import islice

import numpy as np

#: Words of one worker's dictionary, some 170 bytes each; when full it is cut to half.
MOST_WORDS = 700_000
#: Bytes of text that are encoded together: fewer different words in all, and so fewer lookups.
TOGETHER = 6 << 20
STOPS = ".,;:!?"


class Encoder:
    """spec: the JSON text of a tokenizers file. kind "spaced": byte-level, a word has the space before it; "words": white space is dropped."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 50, 100)  # the dictionary has no cycles to look for
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.width = self.dtype.itemsize
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words whose text has to be encoded whole
        d = json.loads(spec)
        pre, normal = d.get("pre_tokenizer") or {}, d.get("normalizer")
        parts = pre.get("pretokenizers") or [{}]
        self.kind, edge = "whole", np.zeros(max(vocab.values()) + 1, bool)
        if pre.get("type") == "ByteLevel" and normal is None and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.kind, mark = "spaced", lambda t: t.startswith("Ġ")  # a space in the byte-level alphabet
        elif parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and d["model"].get("end_of_word_suffix"):
            self.kind, mark = "words", lambda t: t.endswith(d["model"]["end_of_word_suffix"])
        if self.kind != "whole":
            for token, i in vocab.items():
                edge[i] = mark(token)
        self.edge, self.newline, self.bar = edge, self._ids("\n"), self._ids("~")
        self.stops = {x: self._bytes(self._ids(x)) for x in STOPS}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        """Notes the words' ids; gives the words back if their number and that of the stretches differ."""
        if len(starts) != len(words):
            return words
        raw = ids.tobytes()
        self.known.update(zip(words, [raw[a:b] for a, b in zip((starts * self.width).tolist(), (ends * self.width).tolist(), strict=True)], strict=True))
        return []

    def _learn(self, new: set[str]) -> None:
        spaced = self.kind == "spaced"
        stopped = [w for w in new if w[-1:] in STOPS and w[-2:-1].isalpha()]
        new = (new - set(stopped)) | {c for c in [w[:-1] for w in stopped] if c not in self.known}
        plain, other, alone = [], [], []
        for w in new:
            if w.isalpha():
                plain.append(w)
            elif spaced:
                inner = w[1:] if w[:1] == "\n" else w
                if not inner or inner[0].isspace() or inner[-1].isspace():
                    self.known[w] = b""
                    self.odd.add(w)
                elif len(inner.split()) > 1:
                    alone.append(w)
                else:
                    (other if inner is not w else plain).append(w)
            else:
                (alone if "~" in w else other).append(w)
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            ids = np.array(self._ids(" " * spaced + " ".join(part)), self.dtype)
            at = np.flatnonzero(self.edge[ids])
            edges = np.concatenate((at, [len(ids)]) if spaced else ([0], at + 1))
            alone += self._keep(part, ids, edges[:-1], edges[1:])
        mark = self.newline if spaced else self.bar
        for i in range(0, len(other), 4000):
            part = other[i : i + 4000]
            ids = np.array(self._ids("".join(part) if spaced else " ~ ".join([*part, ""])), self.dtype)
            at = np.flatnonzero(ids == mark[0])
            starts, ends = (at, np.concatenate((at[1:], [len(ids)]))) if spaced else (np.concatenate(([0], at[:-1] + 1)), at)
            alone += self._keep(part, ids, starts, ends) if len(mark) == 1 else part
        texts = [" " + w if spaced and w[0] != "\n" else w for w in alone]
        for i in range(0, len(alone), 1000):
            self.known.update(zip(alone[i : i + 1000], self._whole(texts[i : i + 1000]), strict=True))
        for w in stopped:
            self.known[w] = self.known[w[:-1]] + self.stops[w[-1]]
            if w[:-1] in self.odd:
                self.odd.add(w)

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow column of texts, null as empty: all ids in a row, and the number of each text's.

        Texts are split and their words numbered by Arrow; only a batch's different words become Python strings.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        texts = pc.fill_null(column.cast(pa.string()), "")
        n = len(texts)
        if self.kind == "whole" or not n:
            return self._together(self._whole(texts.to_pylist()))
        if len(self.known) > MOST_WORDS:  # the first half was met first, so has the words met most
            self.known = dict(islice(self.known.items(), MOST_WORDS // 2))
            self.odd &= self.known.keys()
        spaced = self.kind == "spaced"
        if spaced:  # each text gets a line feed before it, whose ids are dropped again, and each line feed a space
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
        del lists  # a worker's memory is short, and this is as large as the texts
        offsets = offsets - offsets[0]
        kinds, index = coded.dictionary, coded.indices.to_numpy()
        whole = pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), kinds)
        words = pc.binary_join(whole, " ")[0].as_py().split(" ") if len(kinds) else []  # no word has a space; faster than one by one
        self.known[""] = b""
        raw = list(map(self.known.get, words))
        new = {w for w, x in zip(words, raw, strict=True) if x is None}
        if new:
            self._learn(new)
            raw = list(map(self.known.__getitem__, words))
        bad, empty = np.zeros(len(words), bool), np.fromiter((not w for w in words), bool, len(words))
        if self.odd:
            bad[:] = np.fromiter((w in self.odd for w in words), bool, len(words))
        del coded, kinds, whole, words
        size = np.fromiter(map(len, raw), np.int32, len(raw)) // np.int32(self.width)
        ids, start = np.frombuffer(b"".join(raw), self.dtype), np.cumsum(size, dtype=np.int64) - size
        take, from_ = size[index], start[index]
        odd = np.zeros(n, bool)
        if spaced:
            wrong = np.concatenate(([0], np.cumsum(bad[index] + empty[index].astype(np.int64))))
            odd = wrong[offsets[1:]] - wrong[offsets[:-1]] != 1  # the piece before the first space is empty, and no other
            first = offsets[:-1] + 1
            dropped = np.minimum(take[first], len(self.newline))
            take[first] -= dropped
            from_[first] += dropped
        place = np.concatenate(([0], np.cumsum(take, dtype=np.int64)))
        kind = np.int32 if max(place[-1], len(ids)) < 1 << 30 else np.int64
        at = np.repeat((from_ - place[:-1]).astype(kind), take)
        at += np.arange(place[-1], dtype=kind)
        out = ids[at]
        del at, raw
        counts = place[offsets[1:]] - place[offsets[:-1]]
        if not odd.any():
            return out, counts
        parts = np.split(out, np.cumsum(counts)[:-1])
        at = np.flatnonzero(odd).tolist()
        for i, whole in zip(at, self._whole(texts.take(pa.array(at)).to_pylist()), strict=True):
            parts[i] = np.frombuffer(whole, self.dtype)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _together(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(found), self.dtype), np.array([len(x) // self.width for x in found], np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, in dtype; null as empty."""
        import pyarrow as pa

        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [p.tobytes() for p in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []

    def with_end(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_column with end_id after each text."""
        ids, counts = self.encode_column(column)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """This worker's encoder for the file's text."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
