"""Deterministic 64-bit hashes, weights, probes and seeds."""

from __future__ import annotations

import hashlib
import json

import numpy as np

# fixed values: FNV-1a, the mixing constants of index weights, the linear congruence of probes
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
WEIGHT_ADD, WEIGHT_MULTIPLY = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
PROBE_SEED, PROBE_MULTIPLY, PROBE_ADD = 0x243F6A8885A308D3, 6364136223846793005, 1442695040888963407
WEIGHT_BITS = (1 << 21) - 1
_MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    """FNV-1a of bytes. Each step needs the one before: keep it to what one task holds."""
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def index_weights(index: np.ndarray) -> np.ndarray:
    """A weight in 0 to 1 for each index, so that sums notice swapped values."""
    x = np.asarray(index).astype(np.uint64) + np.uint64(WEIGHT_ADD)
    mixed = (x ^ (x >> np.uint64(30))) * np.uint64(WEIGHT_MULTIPLY)
    return ((mixed >> np.uint64(11)) & np.uint64(WEIGHT_BITS)).astype(float) / WEIGHT_BITS


def probe_indices(count: int, ends: int = 32, drawn: int = 64) -> list[int]:
    """Indices at which two vectors are compared value by value: the first and last ends, and drawn others by a seeded congruence."""
    if count == 0:
        return []
    chosen, state = {*range(min(count, ends)), *range(max(0, count - ends) if count > ends else count, count)}, PROBE_SEED ^ count
    for _ in range(drawn):
        state = (state * PROBE_MULTIPLY + PROBE_ADD) & _MASK
        chosen.add(state % count)
    return sorted(chosen)


def child_seed(seed: int, *parts) -> int:
    """A seed that depends on seed and parts alone."""
    text = json.dumps({"base_seed": seed, "parts": parts}, sort_keys=True)
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
