"""Token ids of whole texts with the tokenizers library, at the speed of a dictionary of words seen before.

Both kinds of vocabulary file used here split a text into words, numbers and signs before any merge. So a text's ids are the ids of its
pieces one after another, and a piece's ids are asked of the library once and then kept (KEEP pieces at most, then the
memory starts afresh). Texts in which a piece could depend on what stands around it go to the library as a whole.

`many` takes many texts: plain ones are split together as bytes, and the library's model gets all pieces that are not known in
one line, already in the signs that stand for bytes, so that a piece costs its merges and no call.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import text_buffer

#: Pieces whose ids a worker keeps.
KEEP = 500_000
#: Pieces that go to the model in one line.
TOGETHER = 4096
_LEADING = re.compile(r"[ \t\n\r\f\v]?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])")
_SPACED = re.compile(r"[^ \t\n\r\f\v]+")
#: White space beyond ASCII, next to which the rule above could split a run of white space otherwise than the library.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Characters of which the classes are plain: ASCII and Latin letters (of U+0080-U+00BF some are letters, some numbers; the
#: dotted capital I becomes two characters). Texts of these alone are split just as the vocabulary's own pattern does.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_UNPLAIN = re.compile("[^\x00-\x7f\u00c0-\u012f\u0131-\u024f]")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
_LEADING_PLAIN = re.compile(rf"{_SUFFIX}| ?[{_L}]+| ?[0-9]+| ?[^ \t\n\r\f\v{_L}0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]")
_SPACED_PLAIN = re.compile(rf"{_SUFFIX}|[{_L}]+|[0-9]|[^ \t\n\r\f\v{_L}0-9]+")


#: Kinds of bytes in plain texts: white space, digits, other signs, letters (with all bytes of those beyond ASCII).
_WHITE, _DIGIT, _OTHER, _LETTER = range(4)
_KIND = np.array([_WHITE if chr(b) in " \t\n\r\f\v" else _DIGIT if 48 <= b < 58 else _LETTER if b > 127 or chr(b).isalpha() else _OTHER for b in range(256)], np.uint8)


def plain_pieces(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of _LEADING_PLAIN begin in the UTF-8 bytes of plain texts, which stand one after another from begins on."""
    n, kind = len(data), _KIND[data]
    sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # times and division are no letters
    kind[sign] = kind[sign + 1] = _OTHER
    top = np.ones(n + 3, bool)
    top[:n] = False
    top[begins] = True
    start = top.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # The last white space before something else stands apart, a space with what follows.
    last = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~top[1:n])
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    # An apostrophe that begins a piece takes one of its endings with it.
    quote = np.flatnonzero(data == 39)
    quote = quote[start[quote]]
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    a = np.where(top[quote + 1], 0, padded[quote + 1])
    b = np.where(top[quote + 1] | top[quote + 2], 0, padded[quote + 2])
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = start[quote[two] + 3] = True
    return np.flatnonzero(start[:n])


class _Pieces(dict):
    """Ids of pieces (their UTF-8 bytes) from a byte-level model of merges, asked for many at once."""

    def __init__(self, tokenizer, spec: dict):
        from tokenizers import Tokenizer, pre_tokenizers

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = sorted({*range(256)} - {*plain})
        self.signs = dict(zip(plain + rest, plain + [256 + k for k in range(len(rest))]))
        vocabulary = spec["model"].get("vocab", {})
        self.fits = spec["model"]["type"] == "BPE" and all(chr(x) in vocabulary for x in self.signs.values()) and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        if self.fits:
            self.signs[255] = 32  # no byte of UTF-8, and no sign is white space: it parts the pieces
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for sign, number in vocabulary.items():
                self.bytes[number] = len(sign)
            self.model = Tokenizer(tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.before: dict[bytes, bytes] = {}

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces. Half of KEEP stay known, and as many that were known before, so that frequent ones are kept."""
        if len(self) >= KEEP // 2:
            self.before = dict(self)
            self.clear()
        out, new = list(map(self.get, pieces)), []
        for k in [k for k, x in enumerate(out) if x is None]:
            found = self.before.get(pieces[k])
            if found is None:
                new.append(k)
            else:
                out[k] = self[pieces[k]] = found
        for i in range(0, len(new), TOGETHER):
            own = [pieces[k] for k in new[i : i + TOGETHER]]
            line = b"\xff".join(own).decode("latin-1").translate(self.signs)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            # Ids stand for all bytes in order, so a piece ends where as many bytes are passed.
            ends, passed = np.cumsum([len(x) for x in own]), np.cumsum(self.bytes[ids])
            last = np.searchsorted(passed, ends)
            if passed[-1] != ends[-1] or (passed[last] != ends).any():
                raise ValueError("the ids do not stand for the bytes of the pieces")
            at, data = [0, *(4 * last + 4).tolist()], ids.tobytes()
            for k, piece, a, b in zip(new[i : i + TOGETHER], own, at, at[1:]):
                out[k] = self[piece] = data[a:b]
        return out

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts."""
        joined = b"".join(texts)
        ends = np.cumsum([len(x) for x in texts])
        if not joined:
            return [b""] * len(texts)
        data, begins = np.frombuffer(joined, np.uint8), np.concatenate(([0], ends[:-1]))
        at = plain_pieces(data, begins[begins < ends])
        offsets = np.append(at, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        different, edges = text_buffer(coded.dictionary)
        different, edges = different.tobytes(), edges.tolist()
        which, own = coded.indices.to_numpy(), self.ids([different[a:b] for a, b in zip(edges, edges[1:])])
        size = np.array([len(x) // 4 for x in own], np.int64)
        first, n = np.cumsum(size) - size, size[which]
        passed = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(own), "<u4")[np.repeat(first[which] - passed[:-1], n) + np.arange(passed[-1])].tobytes()
        cut = (4 * passed[np.searchsorted(at, np.append(begins, len(data)))]).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


class _Known(dict):
    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, piece):
        if len(self) >= KEEP:
            self.clear()
        ids = self[piece] = self.ask(piece)
        return ids


class Encoder:
    """ids(text): a text's ids as little-endian unsigned 32-bit integers, without special ones added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import array

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size()
        pre, encode = spec["pre_tokenizer"] or {}, self.tokenizer.encode
        self.whole = lambda text: array.array("I", encode(text, add_special_tokens=False).ids).tobytes()
        split = (pre.get("pretokenizers") or [{}])[0]
        if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.known, self.ids = _Known(self.whole), self._leading
            self.pieces = _Pieces(self.tokenizer, spec)
        elif split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
            self.known, self.ids = _Known(self.whole), self._spaced
        else:
            self.ids = self.whole

    def many(self, texts: list[str]) -> list[bytes]:
        """ids(text) of every text."""
        if self.ids != self._leading or not self.pieces.fits:
            return [self.ids(text) for text in texts]
        plain = [not (_UNPLAIN.search(text) or any(s in text for s in self.special)) for text in texts]
        found = iter(self.pieces.plain([text.encode() for text, p in zip(texts, plain) if p]))
        return [next(found) if p else self.ids(text) for text, p in zip(texts, plain)]

    def _leading(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if not _UNPLAIN.search(text):
            return b"".join(map(self.known.__getitem__, _LEADING_PLAIN.findall(text)))
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, _LEADING.findall(text)))

    def _spaced(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if not _UNPLAIN.search(text):
            return b"".join(map(self.known.__getitem__, _SPACED_PLAIN.findall(text.lower())))
        return b"".join(map(self.known.__getitem__, _SPACED.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
