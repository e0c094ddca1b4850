"""Encoding with the tokenizers library, one call for each distinct unit.

Texts repeat their words; a chunk (what stands between blanks) is therefore encoded once per worker and looked up afterwards. A
chunk of plain words and marks is put together from units (a word, a run of marks, a line end), which repeat more often still. Cuts
are made only where no token can cross, so the ids equal those of the whole text. Caches are bounded: when one is full, further
entries are encoded for the batch at hand and forgotten.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np

#: A blank before white space or at the end: there a run of blanks is divided by look-ahead, and a text is encoded whole.
UNSAFE = re.compile(r" (?:\s|\Z)")
CACHE_ENTRIES, UNIT_ENTRIES = 1_000_000, 600_000
LONGEST_CACHED = 64
#: Letters that lower-casing and composition turn into one letter, and marks that neither touches.
_WORD, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", "[.,;:!?%$&*#]"
UNIT = re.compile(f" ?{_WORD}|{_MARKS}+|\n")
PLAIN = re.compile(f"{_WORD}{_MARKS}*(?:\n{_WORD}{_MARKS}*)*")
#: A text of all kinds of units: the cut into units is used where it gives the whole text's ids.
PROBE = " Abc. D\u00c9f\u00ff,;:\nthe%$&*#!? x\ny.\nZ"
#: How the byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on.
_OTHERS = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LEVEL = {b: chr(0x100 + i) for i, b in enumerate(_OTHERS)}


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    `encode` maps strings to such bytes, `encode_units` units; without it chunks are not cut further. `spaced`: a blank belongs to the
    word behind it. `fold`: the model does not tell capitals from small letters. Texts with one of `specials` are encoded whole.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spaced: bool, entries: int = CACHE_ENTRIES, encode_units: Callable[[list[str]], list[bytes]] | None = None, fold: bool = False, specials: Iterable[str] = ()):
        self.encode, self.spaced, self.entries, self.fold = encode, spaced, entries, fold
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.cache: dict[str, bytes] = {"": b""} if not spaced else {}
        self.units: dict[str, bytes] = {}
        cut = UNIT.findall(PROBE.lower() if fold else PROBE) if spaced else [u.strip(" ") for u in UNIT.findall(PROBE.lower() if fold else PROBE)]
        self.encode_units = encode_units if encode_units and b"".join(encode_units(cut)) == encode([PROBE])[0] else None

    def batch(self, texts: list[str]) -> list[bytes]:
        cache, whole, heads, parts = self.cache, {}, {}, []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if (self.spaced and UNSAFE.search(text)) or (self.special and self.special.search(text)):
                whole[i] = b""
                parts.append([])
                continue
            pieces = text.split(" ")
            if self.spaced:
                heads[i] = pieces[0]
                del pieces[0]
            parts.append(pieces)
            missing.update(filterfalse(cache.__contains__, pieces))
        plain = self.put_together(missing)
        new = [p for p in missing if p not in plain]
        own = [*whole, *heads]
        got = self.encode([(" " + p if self.spaced else p) for p in new] + [texts[i] for i in whole] + list(heads.values()))
        cache.update(zip(new, got[: len(new)]))
        cache.update(plain)
        alone = dict(zip(own, got[len(new) :]))
        out = [alone.get(i, b"") + b"".join(map(cache.__getitem__, p)) for i, p in enumerate(parts)]
        full = len(cache) > self.entries
        for p in missing:
            if full or len(p) > LONGEST_CACHED or "\n" in p:
                del cache[p]
        return out

    def put_together(self, missing: Iterable[str]) -> dict[str, bytes]:
        """The plain ones of some chunks with their ids, made of their units'."""
        if self.encode_units is None:
            return {}
        units, fits, cut = self.units, PLAIN.fullmatch, UNIT.findall
        before = " " if self.spaced else ""
        split = {p: cut(before + (p.lower() if self.fold else p)) for p in missing if fits(p)}
        fresh = [u for u in {u for us in split.values() for u in us} if u not in units]
        units.update(zip(fresh, self.encode_units(fresh)))
        out = {p: units[us[0]] if len(us) == 1 else b"".join(map(units.__getitem__, us)) for p, us in split.items()}
        full = len(units) > UNIT_ENTRIES
        for u in fresh:
            if full or len(u) > LONGEST_CACHED:
                del units[u]
        return out


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """The tokenizers library's model at `path`, as a plain call without added special tokens: one written in a text is its own id. One per worker process."""
    if (path, spaced) not in _ENCODERS:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        tokenize, white = model.model.tokenize, "" if not spaced else None

        def encode(strings: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(strings, add_special_tokens=False)] if strings else []

        def encode_units(units: list[str]) -> list[bytes]:
            """A unit is one word to the model: neither normaliser nor pattern has anything left to do."""
            flat, ends = [], [0]
            for u in units:
                if not u.isascii() or u[0] <= " ":
                    u = white if u == "\n" and white is not None else u.encode().decode("latin-1").translate(BYTE_LEVEL)
                if u:
                    flat += [t.id for t in tokenize(u)]
                ends.append(4 * len(flat))
            raw = np.array(flat, "<u4").tobytes()
            return [raw[a:b] for a, b in zip(ends, ends[1:])]

        fold = model.normalizer is not None and model.normalizer.normalize_str("Aa") == "aa"
        specials = [t.content for t in model.get_added_tokens_decoder().values()]
        _ENCODERS[path, spaced] = ChunkEncoder(encode, spaced, encode_units=encode_units, fold=fold, specials=specials)
    return _ENCODERS[path, spaced]


def slices(batches: Iterable, chars: int = 400_000, column: str = "text") -> Iterator:
    """Arrow batches cut into slices of about `chars` characters of text (one row at least)."""
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64) if b.num_rows else np.zeros(0)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chars, "right")))
            yield b.slice(at, to - at)
            at = to
