"""Counts over whole texts, for all texts of a chunk at once."""

from __future__ import annotations

import numpy as np

from sectorlake.llm.textcore import U64, Spans, line_spans, mix, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_HIGH = _BYTE >= 0xC0  # the lead byte of a character beyond ASCII
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_PUNCT = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs twice or more; the first occurrence included."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.empty(len(k) + 1, bool)
    same[[0, -1]] = False
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[:-1] | same[1:]
    return out


def again(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(k), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out


def stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that the rules need."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    spans = Spans(data)
    out = {"n_words": np.bincount(rows, minlength=n)}
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[ends] - lead[starts]
    out["n_chars"] = np.diff(lead[offsets])
    out["word_chars"] = np.bincount(rows, chars, minlength=n).astype(np.int64)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_high", _HIGH), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[name] = _per_row(table[data], offsets)
    # lines
    a, b, line_rows = line_spans(data, offsets)
    word_at = np.zeros(len(data) + 1, np.int64)
    flag = np.zeros(len(data), np.int8)
    flag[starts] = 1
    np.cumsum(flag, out=word_at[1:])
    full = word_at[b] > word_at[a]
    a, b, line_rows = a[full], b[full], line_rows[full]
    out["n_lines"] = np.bincount(line_rows, minlength=n)
    out["n_dup_lines"] = np.bincount(line_rows[again(spans.groups(a, b)[1] * n + line_rows)], minlength=n)
    out["n_ended_lines"] = np.bincount(line_rows[_END[data[b - 1]]], minlength=n) if len(b) else np.zeros(n, np.int64)
    # words
    out["n_bang_words"] = np.bincount(rows[data[ends - 1] == 33], minlength=n) if len(ends) else np.zeros(n, np.int64)
    words = spans.groups(starts, ends)[1]
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        at = np.flatnonzero(rows[2:] == rows[:-2])
        like = words.astype(U64)
        tri = (like[at] * U64(0x9FB21C651E98DF25) + like[at + 1]) * U64(0xC2B2AE3D27D4EB4F) + like[at + 2]
        at = at[repeated(mix(tri ^ (rows[at].astype(U64) * U64(0xD6E8FEB86659FD93))))]  # few are left; these are named exactly
        pair = np.unique(words[at] * len(words) + words[at + 1], return_inverse=True)[1]
        triple = np.unique(pair * len(words) + words[at + 2], return_inverse=True)[1]
        at = at[repeated(triple * n + rows[at])]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    out["n_distinct_words"] = out["n_words"] - np.bincount(rows[again(words * n + rows)], minlength=n)
    return out
