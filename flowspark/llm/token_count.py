"""Token counts under a unigram vocabulary: the number of pieces of the best segmentation.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position; dynamic programming
carries, for each position, the best score and the number of pieces that reach it.  No piece is ever
written out.  The rules for ties are those of the Unigram model in ``tokenizers``: starts are visited
from left to right and a later path replaces an earlier one only if its score is strictly higher, so
at equal scores the longest last piece wins.  A character without a piece of its own costs
``least score - 10`` and counts as its UTF-8 bytes (byte fallback).

The vocabulary is a file given as a parameter: its pieces and scores as they stand.  A space is
written as U+2581, and one is put before a text.  If no piece has U+2581 after another character and
all scores are whole numbers, cutting a text before each such mark changes neither the best score nor
a tie, so chunks are counted one by one and common chunks only once in a task.

Defined results: a null or empty text has 0 tokens; repeated rows give repeated results; an empty
table gives an empty result.  Memory of a task is the automaton, the cache of ``CACHE`` chunks and
three numbers for each character of the longest chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_bytes, pick, words_by_space

#: Chunks whose counts a task keeps, and the longest of them.
CACHE, CACHED_CHARS = 1_000_000, 48
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def load_vocabulary(model_file: str) -> dict[str, float]:
    """Piece to score of a sentencepiece file: its normal pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))}


def counter(vocabulary: dict[str, float]):
    """The function from an Arrow array of texts to their numbers of tokens."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in vocabulary.items():
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
    alone = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in vocabulary) and all(float(s).is_integer() for s in vocabulary.values())
    cache: dict[str, int] = {}

    def viterbi(chunk: str) -> int:
        n = len(chunk)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        at = 0  # positions up to here are settled

        def settle(end: int, found: list[tuple[int, float]]) -> None:
            """The best way to ``end``; pieces that end there come longest first."""
            score, count = None, 0
            for length, own in found:
                if score is None or best[end - length] + own > score:
                    score, count = best[end - length] + own, pieces[end - length] + 1
            if (not found or found[-1][0] != 1) and (score is None or best[end - 1] + unknown > score):
                score, count = best[end - 1] + unknown, pieces[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))
            best[end], pieces[end] = score, count

        found: list[tuple[int, float]] = []
        here = 0
        for last, match in automaton.iter(chunk):
            if last + 1 != here:
                if here:
                    settle(here, found)
                    at = here
                for end in range(at + 1, last + 1):
                    settle(end, [])
                at = last
                here, found = last + 1, []
            found.append(match)
        if here:
            settle(here, found)
            at = here
        for end in range(at + 1, n + 1):
            settle(end, [])
        return pieces[n]

    def of_chunk(chunk: str) -> int:
        found = cache.get(chunk)
        if found is None:
            found = viterbi(chunk)
            if len(chunk) <= CACHED_CHARS:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[chunk] = found
        return found

    def count(text: str) -> int:
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(of_chunk, re.findall(f"{SPACE}+[^{SPACE}]*", marked))) if alone else viterbi(marked)

    def counts(texts: pa.Array) -> np.ndarray:
        """Tokens of each text.  Where chunks are words after one space, each different one of the
        texts is counted once."""
        texts = pc.fill_null(texts, "")
        # Runs of marks are pieces of their own; one is put before a text.
        whole = pc.match_substring_regex(texts, f"^ |  |{SPACE}") if alone else pc.greater(pc.binary_length(texts), 0)
        words, numbers, offsets = words_by_space(pc.if_else(whole, "", texts))
        each = np.fromiter((of_chunk(SPACE + w) for w in words.to_pylist()), np.int64, len(words))
        sums = np.diff(np.concatenate([[0], np.cumsum(each[numbers])])[offsets])
        sums[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
        for row in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            sums[row] = count(texts[row].as_py())
        return sums

    return counts


def count_tokens(docs: DataFrame, vocabulary: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row; one pass, no shuffle.

    The vocabulary travels with the tasks; its size is that of the tokenizer, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            for some in by_bytes(batch, "text", 16 << 20):
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(counts(some.column("text")))], names=["doc_id", "n_tokens"])

    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, n_tokens long")
