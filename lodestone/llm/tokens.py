"""Ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once.

Neither vocabulary merges across the places where a text is cut into pieces here, so the ids
of a text are those of its pieces in turn. Arrow cuts a batch of texts and numbers the distinct
pieces; new ones go to the library, some hundreds to a string; numpy lays out the ids. Up to
``KEEP`` pieces are kept in the worker, the most frequent of the first slices. A text that can't be cut safely, or
that may hold a special token's string, is encoded whole. The ids are those of the library's plain call,
``encode(text, add_special_tokens=False)``: a special token's string in a text gives that token;
``special_text=True`` reads such strings as ordinary text.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps, at most (memory, not results).
KEEP = 350_000
#: Bytes of text that are handled at a time (memory, not results); a longer text goes alone.
SLICE = 8 << 20
#: Marks that can follow a word and are never merged with it.
MARKS = ".,;:!?"


def closed(char: str) -> bool:
    """Whether a mark after ``char`` begins a piece of its own: it must still be one letter or digit
    when it is lowered and normalised (a combining mark would join the mark behind it)."""
    low = unicodedata.normalize("NFC", char.lower())
    return char.isalnum() and len(low) == 1 and low.isalnum()


class Encoder:
    """``encode_all(texts)`` gives each text's little-endian ids of ``dtype``.

    spaced: the vocabulary has the blank at the front of a word (byte-level BPE); else white
    space is dropped. Spaced pieces are cut before a blank between two other characters, and
    around a line end between two others; such a blank begins a piece of the vocabulary's own
    splitting rule, such a line end is one. A piece is named as it stands after a blank; a
    leading line end means a line's first word, "\\0" a text's first.
    """

    def __init__(self, path: str, spaced: bool, special_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        special = [] if special_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = sorted({t[:2] for t in special})
        self.spaced = spaced
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.known: dict[str, bytes] = {} if spaced else {"": b""}
        self.marks = {m: self._whole(m) for m in MARKS}
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _many(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of clean pieces, each with ``lead`` before it, some hundreds to a string."""
        joined = "".join(pieces)
        sign = "\n" if self.spaced else next((c for c in "~^`|\\" if c not in joined), None)
        mark = self._whole(sign) if sign else b""
        if len(mark) != self.width:
            return [self._whole(lead + p) for p in pieces]
        between = sign if self.spaced else f" {sign} "
        out: list[bytes] = []
        for at in range(0, len(pieces), 256):
            group = pieces[at : at + 256]
            found = self.tokenizer.encode_batch_fast([lead + (between + lead).join(group)], add_special_tokens=False)
            ids = np.asarray(found[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == np.frombuffer(mark, self.dtype)[0]) * self.width
            if len(cuts) != len(group) - 1:
                out += [self._whole(lead + p) for p in group]
                continue
            data, begin = ids.tobytes(), 0
            for end in cuts.tolist():
                out.append(data[begin:end])
                begin = end + self.width
            out.append(data[begin:])
        return out

    def _stem(self, key: str) -> tuple[str, str]:
        """(a piece to encode in its stead, the mark that follows), or ("", "") if its edges aren't clean."""
        word = key[1:] if self.spaced and key[:1] in "\n\0" else key
        if self.spaced and (not word or word[0].isspace() or word[-1].isspace() or "\n" in word):
            return "", ""
        mark = word[-1] if word[-1] in MARKS and len(word) > 1 and closed(word[-2]) else ""
        stem = key[:-1] if mark else key
        # Small letters are this vocabulary's own; only ASCII is lowered here.
        return (stem if self.spaced or not stem.isascii() else stem.lower()), mark

    def _learned(self, pieces: list[str], times: np.ndarray) -> list[bytes | None]:
        """Ids of distinct pieces; None for those with white space at an edge."""
        known = self.known
        got = list(map(known.get, pieces))
        gaps = [i for i, g in enumerate(got) if g is None]
        stems = [self._stem(pieces[i]) for i in gaps]
        new = list({stem for stem, _ in stems if stem and stem not in known})
        bare = [p for p in new if p[0] in "\n\0"] if self.spaced else []
        after = [p for p in new if p[0] not in "\n\0"] if bare else new
        fresh = dict(zip(after, self._many(after, " " if self.spaced else ""))) if after else {}
        if bare:
            fresh.update(zip(bare, (self.line_end + g if p[0] == "\n" else g for p, g in zip(bare, self._many([p[1:] for p in bare], "")))))
        marks = self.marks
        for i, (stem, mark) in zip(gaps, stems):
            if stem:
                ids = fresh[stem] if stem in fresh else known[stem]
                got[i] = ids + marks[mark] if mark else ids
        room = KEEP - len(known)
        if room > 0:  # the most frequent of this slice
            for k in np.argsort(-times[gaps], kind="stable")[:room].tolist():
                if got[gaps[k]] is not None:
                    known[pieces[gaps[k]]] = got[gaps[k]]
        return got

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array; null is empty."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out, begin = [], 0
        while begin < len(sizes):
            end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), SLICE, "right")))
            out += self._encoded(pc.fill_null(texts.slice(begin, end - begin), ""), sizes[begin:end])
            begin = end
        return out

    def _encoded(self, texts: pa.Array, sizes: np.ndarray) -> list[bytes]:
        if self.spaced:
            whole = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False).copy()
            cut = pc.replace_substring(pc.binary_join_element_wise("\0", texts, ""), "\n", " \n")
        else:
            whole = np.zeros(len(texts), bool)
            cut = pc.replace_substring(texts, "\n", " ")
        for opening in self.special:
            whole |= pc.match_substring(texts, opening, ignore_case=True).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(cut, " ")
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        pieces = coded.dictionary.to_pylist()
        ids = self._learned(pieces, np.bincount(which, minlength=len(pieces)))
        bad = np.array([g is None for g in ids], bool)
        whole[np.repeat(np.arange(len(texts)), np.diff(bounds))[bad[which]]] = True
        # All distinct pieces' ids in a row, then each piece of the texts copied from there.
        ids = [g or b"" for g in ids]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.dtype)
        starts, n = np.cumsum(lengths) - lengths, lengths[which]
        ends = np.cumsum(n)
        small = np.int32 if len(n) and ends[-1] < 1 << 31 else np.int64
        take = np.repeat((starts[which] - (ends - n)).astype(small), n)
        take += np.arange(len(take), dtype=small)
        data = flat[take].tobytes()
        places = np.concatenate([[0], ends])[bounds] * self.width
        out = [data[i:j] for i, j in zip(places[:-1].tolist(), places[1:].tolist())]
        for i in np.flatnonzero(whole | (sizes == 0)).tolist():
            out[i] = self._whole(texts[i].as_py()) if sizes[i] else b""
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    return Encoder(path, spaced)
