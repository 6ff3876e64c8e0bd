"""Quality rules as a short-circuit cascade.

Each rule has a measure over a block of texts and a verdict on it. Before the run, every rule is timed on a bounded
sample (`sample_rows` texts of up to `sample_bytes`, from as few partitions as hold them) and its rejections counted;
rules then run in falling order of rejections per second. Texts that a rule rejects are cut from the block before the
next one runs; measures of texts and words that have been made go with those that are left. The order changes cost alone: a text is kept if no rule rejects it, so the verdict doesn't
depend on the order, ties between rules (declared order), the sample or the machine.

All measures are exact counts over whole texts, taken on flat byte arrays for a block of texts at once.

Edge cases: a null text is an empty one (no words, fails the base rules); rows without id and repeated rows are judged
like any other; a very long text is measured whole, in memory proportional to its length; only id and text are read, so
other columns can't clash; an empty table gives an empty result and the rules keep their declared order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, per_text, slices, text_column, word_bounds, word_keys

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True


#: Measures with one number a text.
MEASURES = frozenset({"n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_lower", "n_lines", "n_dup_lines", "n_stutters", "n_repeat_words"})


class Block:
    """Some texts as flat bytes, with measures that are computed when first asked for."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, rows: np.ndarray) -> "Block":
        """Some of the texts, with the measures of texts and words that have been made."""
        size = np.diff(self.off)[rows]
        off = np.concatenate(([0], np.cumsum(size)))
        cut = Block(np.concatenate([self.data[self.off[i] : self.off[i + 1]] for i in rows]) if len(rows) else self.data[:0], off)
        cut.__dict__ |= {k: v[rows] for k, v in self.__dict__.items() if k in MEASURES}
        if "words" in self.__dict__:
            first, n = self.first_word, self.n_words[rows]
            kept = np.repeat(first[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            by = np.repeat(off[:-1] - self.off[rows], n)
            cut.__dict__["words"] = tuple(x[kept] + by for x in self.words)
            if "word_hash" in self.__dict__:
                cut.__dict__["word_hash"] = self.word_hash[kept]
        return cut

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return word_bounds(self.data, self.off)

    @cached_property
    def first_word(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.words[0], self.off, "left")

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def word_chars(self) -> np.ndarray:
        solid = LEAD[self.data]
        solid &= ~np.isin(self.data, np.array([0x20, 9, 10, 11, 12, 13], np.uint8))
        return per_text(solid, self.off)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return per_text(SYMBOL[self.data], self.off)

    @cached_property
    def n_marks(self) -> np.ndarray:
        return per_text(MARK[self.data], self.off)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return per_text(UPPER[self.data], self.off)

    @cached_property
    def n_lower(self) -> np.ndarray:
        return per_text(LOWER[self.data], self.off)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the lines that hold a word."""
        feed = np.flatnonzero(self.data == 10)
        start = np.unique(np.concatenate((self.off[:-1], feed + 1)))
        start = start[start < len(self.data)]
        end = np.minimum(np.append(feed, len(self.data))[np.searchsorted(feed, start)], self.off[np.searchsorted(self.off, start, "right")])
        full = np.searchsorted(self.words[0], end) > np.searchsorted(self.words[0], start)
        start, end = start[full], end[full]
        return np.searchsorted(self.off, start, "right") - 1, start, end

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        text, start, end = self.lines
        key = word_keys(self.data, start, end) ^ mix64(text.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(key, return_index=True)
        return self.n_lines - np.bincount(text[first], minlength=len(self))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return word_keys(self.data, *self.words)

    @cached_property
    def word_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.n_words)

    @cached_property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        h, owner = self.word_hash, self.word_text
        again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        return np.bincount(owner[1:][again], minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        h, owner = self.word_hash, self.word_text
        if len(h) < 8:
            return np.zeros(len(self), np.int64)
        n = len(h) - 7
        window = np.zeros(n, np.uint64)
        for j in range(8):
            window = window * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        window = mix64(window) ^ mix64(owner[:n].astype(np.uint64) + np.uint64(1))
        inside = np.flatnonzero(owner[:n] == owner[7:])
        window = window[inside]
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, inside[twice], 1)
        np.add.at(edge, inside[twice] + 8, -1)
        covered = np.cumsum(edge[:-1]) > 0
        return np.bincount(owner[covered], minlength=len(self))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Block], np.ndarray]


def _few_words(b: Block) -> np.ndarray:
    return b.n_words < 20


def _repeats(b: Block) -> np.ndarray:
    return 100 * b.n_repeat_words > 30 * b.n_words


def _symbols(b: Block) -> np.ndarray:
    return 10 * b.n_symbols > b.n_words


def _dup_lines(b: Block) -> np.ndarray:
    """More than half the lines: a title said twice in a short text is no reason."""
    return (2 * b.n_dup_lines > b.n_lines) & (b.n_lines >= 4)


def _stutters(b: Block) -> np.ndarray:
    return 5 * b.n_stutters > b.n_words


def _shouting(b: Block) -> np.ndarray:
    return b.n_upper > b.n_lower


def _marks(b: Block) -> np.ndarray:
    return 2 * b.n_marks > b.n_words


def _word_length(b: Block) -> np.ndarray:
    return (b.word_chars < 2 * b.n_words) | (b.word_chars > 20 * b.n_words)


BASE = (Rule("few_words", _few_words), Rule("repeats", _repeats))
RULES = (
    *BASE, Rule("symbols", _symbols), Rule("dup_lines", _dup_lines), Rule("stutters", _stutters), Rule("shouting", _shouting), Rule("marks", _marks), Rule("word_length", _word_length),
)


def cascade(block: Block, rules: list[Rule], left: np.ndarray | None = None) -> np.ndarray:
    """Which texts (of those left, if given) pass all rules."""
    rows, view = np.arange(len(block)), block
    alive = np.ones(len(block), bool) if left is None else left.copy()
    for rule in rules:
        if not alive.any():
            break
        if not alive.all():
            keep = np.flatnonzero(alive)
            rows, view, alive = rows[keep], view.take(keep), np.ones(len(keep), bool)
        alive &= ~rule.rejects(view)
    out = np.zeros(len(block), bool)
    out[rows[alive]] = True
    return out


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = 512, sample_bytes: int = 1 << 20, share: float = 0.05, seed: int = 11) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) for each rule over at most sample_rows texts. Rows are taken partition by
    partition until there are enough, so the table isn't read a second time and nothing is shuffled. Longer texts than
    sample_bytes are left out of this sample, which decides cost alone."""
    small = docs.select(F.col(f"`{text}`").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    data, off = text_column(pa.array([r["text"] for r in small.sample(False, share, seed).take(sample_rows)], pa.string()))
    out, n = [], max(1, len(off) - 1)
    for rule in rules:
        block = Block(data, off)
        began = time.thread_time()
        bad = rule.rejects(block)
        out.append((rule.name, (time.thread_time() - began) / n, float(bad.sum()) / n))
    return out


def plan(estimates: list[tuple[str, float, float]], rules: tuple[Rule, ...]) -> list[Rule]:
    """Rules in falling order of rejection per cost; unsampled ones keep their place at the end."""
    rate = {n: share / max(cost, 1e-9) for n, cost, share in estimates}
    return sorted(rules, key=lambda r: -rate.get(r.name, 0.0))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """key and kept for every row; with counts also the base measures, which are then made for all texts."""
    order = plan(estimate(docs, rules, text), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            block = Block(*text_column(b.column(1)))
            if not counts:
                yield pa.record_batch([b.column(0), pa.array(cascade(block, order))], names=[key, "kept"])
                continue
            made = [block.n_words, block.word_chars, block.n_symbols, block.n_dup_lines, block.n_repeat_words]
            failed = _few_words(block) | _repeats(block)
            kept = cascade(block, [r for r in order if r not in BASE], ~failed)
            yield pa.record_batch([b.column(0), *(pa.array(x.astype(np.int64)) for x in made), pa.array(failed), pa.array(kept)], names=[key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    base = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " if counts else ""
    return rows.mapInArrow(run, f"{key} long, {base}kept boolean")
