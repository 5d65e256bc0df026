"""Which suffixes share a prefix: difference-cover suffix sorting up to a fixed depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 8


def ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Names in sorted order: equal rows of the keys get equal ranks, from 0 without gaps."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    bits = [max(1, int(k.max()).bit_length()) for k in keys]
    if sum(bits) <= 64:
        joined = keys[0].astype(np.uint64)
        for key, width in zip(keys[1:], bits[1:], strict=True):
            joined = (joined << np.uint64(width)) | key.astype(np.uint64)
        order = np.argsort(joined)
        new = joined[order][1:] != joined[order][:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), np.int32)
    out[order] = np.concatenate([np.zeros(1, np.int32), np.cumsum(new, dtype=np.int32)])
    return out


def with_equal(rank: np.ndarray) -> np.ndarray:
    """Which rows have a neighbour of equal rank in the sorted order."""
    return np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)


def leading_words(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as a number in the order of the bytes."""
    every = np.ndarray((len(text) - WORD + 1,), dtype=">u8", buffer=text, strides=(1,))
    return every[places].astype(np.uint64)


def by_leading_words(text: np.ndarray, starts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the starts in parts of about ``most``, cut between different leading bytes.

    Two bytes decide; only a part that they leave much too large is sorted by
    its leading words. So the whole needs two bytes of memory for each start.
    """
    if len(starts) <= most:
        yield np.arange(len(starts))
        return
    lead = (text[starts].astype(np.uint16) << np.uint16(8)) | text[starts + 1]
    below = np.concatenate([[0], np.cumsum(np.bincount(lead, minlength=1 << 16))])
    key = 0
    while key < 1 << 16:
        end = max(key + 1, int(np.searchsorted(below, below[key] + most, side="right")) - 1)
        part = np.flatnonzero((lead >= key) & (lead < end)) if below[end] > below[key] else np.zeros(0, np.int64)
        if len(part) <= 2 * most:
            yield part
        else:
            words = leading_words(text, starts[part])
            part = part[np.argsort(words, kind="stable")]
            words.sort()
            yield from np.split(part, np.unique(np.searchsorted(words, words[np.arange(most, len(words), most)])))
        key = end


def repeated_prefixes(data: np.ndarray, starts: np.ndarray, depth: int, most: int = 400_000) -> np.ndarray:
    """For each start, whether the ``depth`` bytes from it also stand at another one.

    Suffixes at places that are 1 or 2 modulo 3 are the sample. Their triples,
    of 8-byte words, are sorted and named; triples of names are sorted and named
    in turn, until a name stands for all but the last bytes of the depth. Each
    other suffix is the bytes up to the next sampled one and that one's name.
    Then two suffixes are compared at a shift that brings both onto the sample:
    0 within it, 1 or 2 between the others and each of its halves; equal
    prefixes stand side by side. Spans of ``depth`` bytes must lie in ``data``.
    More than ``most`` suffixes are dealt by their leading words and sorted part
    by part.
    """
    if depth < 3 * WORD + 2:
        raise ValueError(f"depth must be at least {3 * WORD + 2}")
    flags = np.zeros(len(starts), bool)
    text = np.concatenate([data, np.zeros(depth + WORD, np.uint8)])
    for part in by_leading_words(text, starts, most):
        if len(part) > 1:
            part.sort()
            flags[part] = repeated_in_part(text, starts[part], depth)
    return flags


def repeated_in_part(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    base = int(starts.min())
    text, starts = text[base - base % 3 : int(starts.max()) + depth + 3 * WORD], starts - (base - base % 3)
    size = len(text)
    reach = (depth - 2) - (depth - 2) % 3
    widths = [3 * WORD]
    while widths[-1] < reach:
        widths.append(min(3 * widths[-1], reach))
    offsets = [(0, WORD, 2 * WORD)]
    for small, large in zip(widths, widths[1:], strict=False):
        offsets.append((0, min(small, large - small), large - small))
    side = starts % 3
    wanted = np.zeros(size, bool)
    wanted[starts[side != 0]] = True
    wanted[starts[side != 2] + 1] = True
    wanted[starts[side != 1] + 2] = True
    needs = [wanted]
    for shifts in offsets[::-1]:
        below = needs[-1].copy()
        for s in shifts[1:]:
            below[s:] |= needs[-1][:-s]
        needs.append(below)
    name = np.zeros(size, np.int32)
    places = np.flatnonzero(needs.pop())
    name[places] = ranked([leading_words(text, places)])
    for shifts in offsets:
        places = np.flatnonzero(needs.pop())
        named = ranked([name[places + s] for s in shifts])
        name[places] = named
    flags, rest = np.zeros(len(starts), bool), depth - reach

    def bytes_at(places: np.ndarray, after: int, count: int) -> list[np.ndarray]:
        return [text[places + after + k] for k in range(count)]

    for of, shift in ((side != 0, 0), (side != 2, 1), (side != 1, 2)):
        own = starts[of]
        flags[of] |= with_equal(ranked([*bytes_at(own, 0, shift), name[own + shift], *bytes_at(own, shift + reach, rest - shift)]))
    return flags
