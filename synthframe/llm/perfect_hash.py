"""A minimal perfect hash over byte strings that keeps its keys, in numpy.

Keys are thrown into a bit field of twice their number; those alone at their place stay there, the others go on to
the next, smaller field. A key's slot is the number of set bits before its place, so slots are dense. The keys
are stored by slot and compared on every lookup: what is no key finds no slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import mixed, span_hashes

#: Fields after which the keys left (equal 64-bit hashes) are searched by value.
MOST_FIELDS = 40


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each key of a binary array without nulls."""
    _, offsets, data = keys.buffers()
    bounds = np.frombuffer(offsets, np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64) if len(keys) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return span_hashes(whole, bounds[:-1] - bounds[0], bounds[1:] - bounds[0])


def _place(hashes: np.ndarray, field: int, size: int) -> np.ndarray:
    return (mixed(hashes + np.uint64((field * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    fields: list[np.ndarray]  # bit fields as booleans
    before: list[np.ndarray]  # set bits before each place, those of earlier fields included
    keys: pa.Array  # by slot; the last ones may stand in no field
    placed: int

    @classmethod
    def build(cls, keys: pa.Array) -> PerfectHash:
        """``keys``: distinct values of a binary array."""
        hashes, left, fields, order = key_hashes(keys), np.arange(len(keys)), [], []
        while len(left) and len(fields) < MOST_FIELDS:
            size = 2 * len(left) + 1
            place = _place(hashes[left], len(fields), size)
            alone = np.bincount(place, minlength=size) == 1
            kept = left[alone[place]]
            order.append(kept[np.argsort(place[alone[place]], kind="stable")])
            fields.append(alone)
            left = left[~alone[place]]
        placed = len(keys) - len(left)
        slots = np.concatenate([*order, left]) if len(keys) else np.zeros(0, np.int64)
        return cls._ranked(fields, keys.take(pa.array(slots)), placed)

    @classmethod
    def _ranked(cls, fields: list[np.ndarray], keys: pa.Array, placed: int) -> PerfectHash:
        before, held = [], 0
        for bits in fields:
            running = np.cumsum(bits, dtype=np.int64)
            before.append(held + running - bits)
            held += int(running[-1])
        return cls(fields, before, keys, placed)

    def __len__(self) -> int:
        return len(self.keys)

    def lookup(self, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for what is no key."""
        slot, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for number, (bits, before) in enumerate(zip(self.fields, self.before)):
            if not len(left):
                break
            place = _place(hashes[left], number, len(bits))
            hit = bits[place]
            slot[left[hit]] = before[place[hit]]
            left = left[~hit]
        known = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[known])), keys.take(pa.array(known))).to_numpy(zero_copy_only=False)
        slot[known[~same]] = -1
        if self.placed < len(self.keys) and len(left):
            found = pc.fill_null(pc.index_in(keys.take(pa.array(left)), self.keys[self.placed :]), -1).to_numpy().astype(np.int64)
            slot[left] = np.where(found < 0, -1, found + self.placed)
        return slot

    def packed(self) -> dict[str, bytes | list]:
        """Columns of one row: sizes and bits of the fields, keys by slot, and how many stand in fields."""
        return {"sizes": [len(f) for f in self.fields], "bits": b"".join(np.packbits(f).tobytes() for f in self.fields), "keys": self.keys, "placed": self.placed}

    @classmethod
    def unpacked(cls, sizes: list[int], bits: bytes, keys: pa.Array, placed: int) -> PerfectHash:
        fields, at = [], 0
        for size in sizes:
            width = -(-size // 8)
            fields.append(np.unpackbits(np.frombuffer(bits[at : at + width], np.uint8), count=size).astype(bool))
            at += width
        return cls._ranked(fields, keys, placed)
