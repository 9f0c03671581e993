"""Substring dedup by suffix automata of reference shards.

A suffix automaton of a set of reference texts gives, while another text streams through it,
the length of the longest match that ends at each word. Where this reaches the window's
length, the words of the window are removed.

The references of a whole corpus do not fit one automaton, and sending every shard's automaton
to every document would read the corpus once per shard. So references are sharded by content:
texts are cut into anchored pieces (see ``anchors``), all pieces that can share a window lie in
one shard, and instead of the automata going to all documents, the few pieces of a document go
to the shards that hold their anchors. Within a shard, pieces stream in the order of their
documents through the automaton of the earlier ones and then join it. An automaton holds at
most ``SHARD_WORDS`` words; pieces of an anchor that come to more are cut again by longer runs,
so that no task ever holds more of one anchor.

Defined cases: a null text has no words; texts shorter than the window lose nothing; windows
repeated inside one document only are kept; repeated rows (equal id and text) are one document
answered twice; of different texts that share an id the one with the smaller hash counts as
earlier, and null ids come after all others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm.anchors import (
    Rule,
    numbered,
    repeated_spans,
    whole_groups,
    window_runs,
    without_spans,
)
from quarrylens.llm.common import table

WINDOW = 50
GRAM = 16
SHARD_WORDS = 200_000


def word_tokens(text: str | None):
    """A number per word (its hash), also as bytes of eight per word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").split()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return ids, ids.tobytes(), 8


def piece_tokens(content: bytes):
    return np.frombuffer(content, np.uint64), content, 8


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.words = 0

    def _state(self, length: int, link: int, steps: dict) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, token, target: int) -> int:
        """The part of ``target`` that holds strings of length(state) + 1 and less."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def add(self, sequence) -> None:
        last = 0
        for token in sequence:
            target = self.next[last].get(token)
            if target is not None:
                exact = self.length[target] == self.length[last] + 1
                last = target if exact else self._split(last, token, target)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            state = last
            while state >= 0 and token not in self.next[state]:
                self.next[state][token] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][token]
                exact = self.length[target] == self.length[state] + 1
                self.link[new] = target if exact else self._split(state, token, target)
            last = new
        self.words += len(sequence)

    def matches(self, sequence, least: int) -> list[int]:
        """Starts of the windows of ``least`` tokens of ``sequence`` that are substrings."""
        step, link, length = self.next, self.link, self.length
        state = matched = 0
        found = []
        for i, token in enumerate(sequence):
            while state and token not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(token, 0)
            matched = matched + 1 if state else 0
            if matched >= least:
                found.append(i - least + 1)
        return found


def matched_spans(
    rows: list[tuple], window: int, shard_words: int = SHARD_WORDS
) -> Iterator[tuple[int, int, int]]:
    """(doc, a, b) spans of the pieces of one anchor, sorted by document, that occur in pieces
    of documents with smaller numbers."""
    pieces = [(doc, start, np.frombuffer(c, np.uint64).tolist()) for _, doc, start, c in rows]
    at = 0
    while at < len(pieces):
        automaton = SuffixAutomaton()
        waiting: list = []
        for i in range(at, len(pieces)):
            doc, start, sequence = pieces[i]
            if waiting and waiting[0][0] != doc and automaton.words < shard_words:
                for piece in waiting:
                    automaton.add(piece[2])
                waiting, at = [], i
            for a, b in window_runs(np.array(automaton.matches(sequence, window)), window):
                yield doc, start + a, start + b
            if automaton.words < shard_words:
                waiting.append(pieces[i])
        if automaton.words < shard_words:
            return


def automaton_engine(window: int, shard_words: int = SHARD_WORDS):
    def run(batches: Iterator):
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), pa.int32()]
        spans: list[tuple] = []

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "a", "b"]
            )

        for rows in whole_groups(batches, 1):
            spans += matched_spans(rows, window, shard_words)
            if len(spans) > 20_000:
                yield batch_of(spans)
                spans = []
        yield batch_of(spans)

    return run


def repeated_word_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = SHARD_WORDS
) -> DataFrame:
    """Spans of words (doc, a, b) of ``docs`` (doc, doc_id, text) whose windows occur earlier."""
    rule = Rule(word_tokens, piece_tokens, window, gram, inside=False, most=most)
    return repeated_spans(docs, rule, automaton_engine(window))


def kept_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    at, kept = 0, []
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    removed = sum(b - a for a, b in spans)
    return len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents"))
    spans = repeated_word_spans(docs)
    return without_spans(docs, spans, kept_words, "n_words long, n_removed long, kept_sha256 string")
