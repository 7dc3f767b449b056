"""Statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .wordhash import SLAB, Chunk, chunks, repeated, shingles

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for was on are with as by this be at from or an have not",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "de la le et les des en un du une que est pour qui dans par sur pas au avec ce il",
    "de la que el en y a los del se las por un para con no una su al lo como más",
)
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "exclaim", "other", "accented", "wide")


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.int8)
    for name, members in {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "newline": (10,),
        "stop": b".,;:", "quote": b"'\"()-", "symbol": SYMBOLS, "exclaim": b"!?", "accented": range(0xC2, 0xC4), "wide": range(0xC4, 0xF8),
    }.items():
        out[list(members)] = CLASSES.index(name)
    return out


CLASS = _class_table()
SYMBOL = CLASS == CLASSES.index("symbol")


def common_words(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The hashes of distinct words, rising, and the words in that order."""
    words = sorted(set(words))
    (chunk,) = chunks(pa.array([" ".join(words)]))
    value = chunk.words()[3]
    order = np.argsort(value)
    return value[order], [words[i] for i in order]


COMMON, COMMON_NAMES = common_words([w for line in COMMON_WORDS for w in line.split()])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_chars")


def chunk_stats(c: Chunk, listed: np.ndarray = COMMON) -> dict[str, np.ndarray]:
    """COUNTS as arrays with a value for each text; classes and common as histograms with a row for each text.

    listed: rising hashes of the words that common counts one by one; its last column is all other words.
    """
    text, _, _, value = c.words()
    n = c.n
    begins = (c.data & 0xC0) != 0x80
    out = {"n_words": np.bincount(text, minlength=n), "word_chars": c.total(begins & ~c.space), "n_chars": c.total(begins), "n_symbols": c.total(SYMBOL[c.data])}
    line_text, start, end, full = c.lines()
    line_text, line = line_text[full], c.spans(start[full], end[full])
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[repeated(line_text, line)[1]], minlength=n)
    at, shingle = shingles(text, value)
    twice = at[repeated(text[at], shingle)[0]]
    cover = np.zeros(len(value) + 6, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(cover)[: len(value)] > 0], minlength=n)
    out["n_distinct_words"] = out["n_words"] - np.bincount(text[repeated(text, value)[1]], minlength=n)
    k = len(CLASSES)
    classes = np.zeros(n * k, np.int64)
    for slab in c.slabs():
        places = np.flatnonzero(begins[slab])
        classes += np.bincount(c.text_of(places + slab.start) * k + CLASS[c.data[slab][places]], minlength=n * k)
    out["classes"] = classes.reshape(n, k)
    k = len(listed) + 1
    common = np.zeros(n * k, np.int64)
    for i in range(0, len(value), SLAB):
        own = value[i : i + SLAB]
        found = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        found[listed[found] != own] = len(listed)
        common += np.bincount(text[i : i + SLAB] * k + found, minlength=n * k)
    out["common"] = common.reshape(n, k)
    return out


def stats(column: pa.Array, listed: np.ndarray = COMMON) -> dict[str, np.ndarray]:
    """chunk_stats of a whole column."""
    parts = [chunk_stats(c, listed) for c in chunks(column)]
    if not parts:
        return {k: np.zeros(0, np.int64) for k in COUNTS} | {"classes": np.zeros((0, len(CLASSES)), np.int64), "common": np.zeros((0, len(listed) + 1), np.int64)}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
