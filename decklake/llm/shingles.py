"""Words and shingles as 64-bit hashes, many texts at a time (numpy)."""

from __future__ import annotations

import hashlib

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


#: Bytes that separate words: \x20 and \x09-\x0D.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that a list of texts has at most unless it is a single one; only a matter of memory.
CHUNK = 2 << 20


def scrambled(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers in which each bit depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Bytes of a word that are hashed in eights side by side with other words; longer words are hashed one by one.
LONG = 256
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def keyed_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed 64-bit hashes of the byte runs [begin, end): eight bytes at a time through scrambled(), so that runs which differ by a
    pattern do not meet, and runs that meet by one seed do not by another."""
    n = (end - begin).astype(np.int64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    out = [scrambled(np.uint64(seed) ^ (n.astype(np.uint64) * _MIX)) for seed in seeds]
    long = np.flatnonzero(n > LONG)
    left = np.flatnonzero((n > 0) & (n <= LONG))
    for k in range(0, LONG, 8):
        if not len(left):
            break
        word = eights[begin[left] + k] & _LOW[np.minimum(n[left] - k, 8)]
        for h in out:
            h[left] = scrambled(h[left] ^ word)
        left = left[n[left] > k + 8]
    for i in long.tolist():
        raw = data[begin[i] : end[i]].tobytes()
        for h in out:
            h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=int(h[i]).to_bytes(8, "little")).digest(), "little")
    return out


def hashes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    return keyed_hashes(data, begin, end, (seed,))[0]


#: Seeds of the words' hashes, and of a second, independent one.
SEED, SECOND = 0x243F6A8885A308D3, 0x13198A2E03707344


def word_runs(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each of their words begins, where it ends, where each text's words begin, with the end of the last)."""
    data = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    texts = np.cumsum([1, *(len(r) + 1 for r in raws)])
    return data, begin, end, np.searchsorted(begin, texts)


def word_hashes(raws: list[bytes], seeds: tuple[int, ...] = (SEED,)) -> tuple[np.ndarray, ...]:
    """Hashes of all words of texts, by each seed, and where each text's begin (with the end of the last)."""
    data, begin, end, starts = word_runs(raws)
    return (*keyed_hashes(data, begin, end, seeds), starts)


def same_runs(data: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the byte runs [begin, end) of a and b are equal, pair by pair."""
    n = a[1] - a[0]
    same = n == b[1] - b[0]
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = np.flatnonzero(same & (n > 0) & (a[0] != b[0]))
    for k in range(0, LONG, 8):
        if not len(left):
            return same
        differ = (eights[a[0][left] + k] ^ eights[b[0][left] + k]) & _LOW[np.minimum(n[left] - k, 8)] != 0
        same[left[differ]] = False
        left = left[~differ & (n[left] > k + 8)]
    for i in left.tolist():
        same[i] = data[a[0][i] : a[1][i]].tobytes() == data[b[0][i] : b[1][i]].tobytes()
    return same


def lists(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """(from, to) of texts of these sizes in lists of up to `most`, and of up to CHUNK bytes unless of one text."""
    out, a, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > a and (k - a == most or held + n > CHUNK):
            out.append((a, k))
            a, held = k, 0
        held += n
    return [*out, (a, len(sizes))] if sizes else []


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k hashes in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _MUL + hashes[j : n + j]
    return mixed(out)


def shingle_sets(hashes: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; with fewer words the whole as one; none without words."""
    all_, out = windows(hashes, k), []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(hashes[:0])
    return out
