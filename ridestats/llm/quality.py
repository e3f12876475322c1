"""Quality rules that look at lines first.

Every line with a word is judged by itself; failing lines are taken out, and a document
is rejected when it loses too much of its text with them or too little is left. Lines fail
for punctuation (symbols or exclamation marks on most words, capitals throughout),
navigation (separators between the words, or a few words without an end), or boilerplate
(stock phrases in a short line, a word said over and over).

On top stand base rules of the whole text: fewer than 20 words, or more than 30 in 100
words in 8-word windows that occur twice in the text.

Batches of rows are worked on as arrays, in parts of bounded size; nothing is shuffled,
and every result depends on its own row only. Null and blank texts have no words and are
rejected. Ids are passed on as they are, null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ridestats.llm.blocks import slices
from ridestats.llm.packing import _SPACE, _strings, give_back, joined, mix, split_words, text_bytes

PART_BYTES = 2 << 20

# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "click here",
    "share on facebook", "share on twitter", "skip to content", "skip to main content", "back to top",
    "log in to comment", "lorem ipsum",
)
SEPARATORS = ("|", ">", "/", "»", "·", "•", "›", "→")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules (shares of a line's words) and of what a text may lose."""

    symbols: float = 0.25  # symbols #*$%&|<> per word
    shouts: float = 0.5  # exclamation marks per word
    capitals: float = 0.8  # capitals among ASCII letters, in lines of 5 words or more
    separators: float = 0.2
    echoes: float = 0.3  # words equal to the word before, in lines of 5 words or more
    short_line: int = 4  # fewer words without an end mark are navigation
    boilerplate_words: int = 20  # stock phrases count in lines of at most so many words
    lost: float = 0.3  # share of the words that may go with failing lines
    left: int = 20  # words that must be left


_SYMBOL, _END = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END[list(b".!?:;\"')]}")] = True
_END[0x80:0xC0] = True  # last byte of a character outside ASCII: closing quotes, full stops of other scripts


class _Part:
    """Counts per document and per line of some texts."""

    def __init__(self, texts: pa.Array, rules: Rules):
        self.data, self.ends = text_bytes(texts)
        self.n = len(self.ends) - 1
        data, ends = self.data, self.ends
        words, self.words = split_words(data, ends, lower=False)
        solid = ~_SPACE[data]
        self.n_symbols = self._sums(_SYMBOL[data], ends)
        self.word_chars = self._sums(solid & ((data & 0xC0) != 0x80), ends)
        self.codes = np.asarray(words.dictionary_encode().indices) if len(words) else np.empty(0, np.int32)
        self._lines(words, solid, rules)
        self.repeated = self._repeated(8)

    @staticmethod
    def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])

    def _lines(self, words: pa.Array, solid: np.ndarray, rules: Rules) -> None:
        data, ends = self.data, self.ends
        breaks = np.flatnonzero(data == 0x0A)
        # Lines of a text start at its first byte and after each line break inside it.
        starts = np.sort(np.concatenate([ends[:-1], breaks + 1]), kind="stable")
        starts = starts[starts < len(data)] if len(data) else starts[:0]
        starts = np.unique(starts)
        stops = np.append(starts[1:], len(data))
        doc = np.searchsorted(ends, starts, side="right") - 1
        stops = stops - ((stops > starts) & (data[np.maximum(stops, 1) - 1] == 0x0A) if len(data) else 0)
        edges = np.append(starts, len(data))
        n_words = self._sums(self._word_starts(solid), edges)
        keep = n_words > 0
        self.starts, self.stops, self.doc, self.line_words = starts[keep], stops[keep], doc[keep], n_words[keep]
        n = self.line_words
        per = lambda hit: self._sums(hit, edges)[keep]
        first = np.concatenate([[0], np.cumsum(n)])
        echo = np.zeros(len(self.codes), bool)
        echo[1:] = self.codes[1:] == self.codes[:-1]
        echo[first[:-1]] = False
        word_ends = np.frombuffer(words.buffers()[1], np.int64)[1 : len(words) + 1] if len(words) else np.empty(0, np.int64)
        body = data[solid]
        lines = self.strings(self.starts, self.stops)
        per_word = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[first])
        separator = np.asarray(pc.is_in(words, pa.array([s.encode() for s in SEPARATORS], pa.large_binary()))) if len(words) else echo
        upper, lower = per((data >= 0x41) & (data <= 0x5A)), per((data >= 0x61) & (data <= 0x7A))
        last = body[word_ends[first[1:] - 1] - 1] if len(n) else np.empty(0, np.uint8)
        fails = per(_SYMBOL[data]) >= rules.symbols * n
        fails |= per(data == 0x21) >= rules.shouts * n + 1
        fails |= (n >= 5) & (upper > rules.capitals * np.maximum(upper + lower, 1))
        fails |= per_word(separator) >= rules.separators * n + 1
        fails |= (n < rules.short_line) & ~_END[last]
        fails |= (n >= 5) & (per_word(echo) >= rules.echoes * n)
        brief = np.flatnonzero((n <= rules.boilerplate_words) & ~fails)
        if len(brief):
            plain = pc.ascii_lower(lines.take(pa.array(brief)).cast(pa.large_string()))
            for phrase in BOILERPLATE:
                fails[brief[np.asarray(pc.match_substring(plain, phrase))]] = True
        self.fails = fails
        self.lost = np.bincount(self.doc, n * fails, self.n).astype(np.int64)
        # Lines that equal an earlier one of the text.
        codes = np.asarray(lines.dictionary_encode().indices) if len(lines) else np.empty(0, np.int64)
        distinct = np.unique(self.doc * (len(lines) + 1) + codes) // (len(lines) + 1)
        self.dup_lines = np.bincount(self.doc, minlength=self.n) - np.bincount(distinct, minlength=self.n)

    def _word_starts(self, solid: np.ndarray) -> np.ndarray:
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        first = self.ends[:-1][self.ends[:-1] < self.ends[1:]]
        start[first] = solid[first]
        return start

    def strings(self, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
        """Stretches of the data (one after the other, not overlapping) as strings."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[starts] += 1
        np.add.at(inside, stops, -1)
        body = self.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        return _strings(body, np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64))

    def _repeated(self, size: int) -> np.ndarray:
        """Words of each text in windows of ``size`` words that occur twice or more in it."""
        doc = np.repeat(np.arange(self.n), self.words)
        n = len(doc)
        if n < size:
            return np.zeros(self.n, np.int64)
        run = mix(self.codes.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32)))
        width = 1
        while width < size:
            run = joined(run[: len(run) - width], run[width:])
            width *= 2
        starts = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        run = run[starts]
        order = np.argsort(run)
        same = run[order[1:]] == run[order[:-1]]
        twice = np.zeros(len(run), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, starts[twice], 1)
        np.add.at(marks, starts[twice] + size, -1)
        return np.bincount(doc, np.cumsum(marks[:n]) > 0, self.n).astype(np.int64)

    def verdicts(self, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
        n = self.words
        failed = (n < 20) | (100 * self.repeated > 30 * n)
        return failed, ~failed & (self.lost <= rules.lost * n) & (n - self.lost >= rules.left)

    def cleaned(self) -> pa.Array:
        """The texts without failing lines; texts without such lines are as they were."""
        touched = np.bincount(self.doc[self.fails], minlength=self.n) > 0
        good = ~self.fails & touched[self.doc]
        starts = np.concatenate([self.starts[good], self.ends[:-1][~touched]])
        stops = np.concatenate([self.stops[good], self.ends[1:][~touched]])
        owner = np.concatenate([self.doc[good], np.flatnonzero(~touched)])
        order = np.argsort(starts, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        raw, out, at = self.data.tobytes(), [], 0
        bounds = np.searchsorted(owner[order], np.arange(self.n + 1))
        starts, stops = starts[order].tolist(), stops[order].tolist()
        for i in range(self.n):
            out.append(b"\n".join(raw[starts[j] : stops[j]] for j in range(bounds[i], bounds[i + 1])))
        return pa.array(out, pa.binary()).cast(pa.string())


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One verdict per row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines (with a word), lost_lines, lost_words.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", PART_BYTES):
                part = _Part(rows["text"], rules)
                failed, kept = part.verdicts(rules)
                counts = (part.words, part.word_chars, part.n_symbols, part.dup_lines, part.repeated)
                lines = (np.bincount(part.doc, minlength=part.n), np.bincount(part.doc[part.fails], minlength=part.n), part.lost)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept),
                     *(pa.array(c.astype(np.int64)) for c in lines)],
                    names=["doc_id", *names, "base_failed", "kept", "n_lines", "lost_lines", "lost_words"])
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean, n_lines long, lost_lines long, lost_words long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns and without failing lines in the text."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col, PART_BYTES):
                part = _Part(rows[text_col], rules)
                arrays = [part.cleaned().cast(rows[c].type) if c == text_col else rows[c] for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, schema=rows.schema).filter(pa.array(part.verdicts(rules)[1]))
            give_back()

    return docs.mapInArrow(run, docs.schema)
