"""Quality rules: base measures of a text, and how much of it is repetition, from a suffix array."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
#: Repeated substrings of fewer words are ordinary phrases and do not count.
MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_LONGEST = 0.2
#: Words that share a suffix sort; texts are not split, so a longer one is sorted alone.
SORTED_AT_ONCE = 400_000


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest substring that starts there and occurs elsewhere in the same text.

    words: a number for each word; text: a nondecreasing number of its text. Suffixes are sorted by prefix doubling: the
    rank of 2^k words from each position is kept for each k, and only positions whose ranks are not yet their own are
    sorted on. The longest common prefix of neighbours in the suffix array comes from the kept ranks, from large to small
    k. A position's value is the larger of its two, which is the length of the widest interval of common prefixes
    that holds it: the longest maximal repeated substring that begins there.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((words, text))
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (text[order][1:] != text[order][:-1]) | (words[order][1:] != words[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    end = np.searchsorted(text, text, side="right")
    levels, step = [rank.copy()], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_at = np.flatnonzero(size[rank] > 1)
        if not len(open_at):
            break
        after = open_at + step
        inside = after < end[open_at]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        # suffixes that end sooner come first and, having different lengths, are told apart by them
        second = np.where(inside, second + n, end[open_at] - open_at)
        by = np.lexsort((second, rank[open_at]))
        at, first, second = open_at[by], rank[open_at][by], second[by]
        head = np.empty(len(at), bool)
        head[0] = True
        head[1:] = first[1:] != first[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        place = np.arange(len(at))
        inner = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        rank = rank.copy()
        rank[at] = first + inner
        levels.append(rank)
        step *= 2
    suffixes = np.argsort(rank, kind="stable")
    a, b = suffixes[:-1], suffixes[1:]
    same = text[a] == text[b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x + (1 << k) <= end[a]) & (y + (1 << k) <= end[b])
        level = levels[k]
        common += np.where(fits & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)]), 1 << k, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def union_length(longest: np.ndarray, weight: np.ndarray, at_least: int) -> np.ndarray:
    """Which positions lie in a repeated substring of at_least words; weight is not summed here."""
    n = len(longest)
    ends = np.where(longest >= at_least, np.arange(n) + longest, 0)
    return np.maximum.accumulate(ends) > np.arange(n) if n else np.zeros(0, bool)


def measures(texts: list[str | None]) -> pd.DataFrame:
    """A row for each text: the base measures, the covered fraction of its word characters, and its longest repeat in words."""
    rows, ids, sizes = [], [], []
    known: dict[str, int] = {}
    for t in texts:
        t = t or ""
        words = _WORD.findall(t)
        own = [known.setdefault(w, len(known)) for w in words]
        ids.append(own)
        sizes.append(list(map(len, words)))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line in seen:
                dup += 1
            elif _WORD.search(line):
                seen.add(line)
        rows.append((len(words), sum(sizes[-1]), len(_SYMBOL.findall(t)), dup))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines"])
    counts = out["n_words"].to_numpy()
    text = np.repeat(np.arange(len(texts)), counts)
    flat = np.array([i for own in ids for i in own], np.int64)
    chars = np.array([c for own in sizes for c in own], np.int64)
    longest = longest_repeats(flat, text)
    total = lambda x: np.bincount(text, x, minlength=len(texts)).astype(np.int64)
    # a word is in a repeated 3-word window if one starts at it or up to two words before, in the same text
    out["n_repeat_words"] = total(union_length(np.where(longest >= 3, 3, 0), chars, 3))
    covered = total(np.where(union_length(longest, chars, MIN_REPEAT), chars, 0))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, text, longest)
    out["covered_fraction"] = covered / np.maximum(out["word_chars"], 1)
    out["longest_repeat"] = np.where(most >= MIN_REPEAT, most, 0)
    return out


def rules_column(text: Column, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_fraction, longest_repeat, base_failed, kept>.

    kept: not base_failed, at most max_covered of the word characters in repeated substrings, and no repeated substring of
    more than max_longest of the words. Null and empty texts have no words and fail.
    """

    @F.pandas_udf(
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_fraction double, longest_repeat long, base_failed boolean, kept boolean"
    )
    def ruled(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, made, at = list(part), [], 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") < 6 * SORTED_AT_ONCE):
                    chars += len(texts[to] or "")
                    to += 1
                made.append(measures(texts[at:to]))
                at = to
            out = pd.concat(made, ignore_index=True)
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            out["kept"] = ~out["base_failed"] & (out["covered_fraction"] <= max_covered) & (out["longest_repeat"] <= max_longest * out["n_words"])
            yield out

    return ruled(text)


def rule_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and the columns of rules_column. An empty table gives an empty result; repeated rows repeat."""
    return docs.select("doc_id", rules_column(F.col("text")).alias("__r")).select("doc_id", "__r.*")
