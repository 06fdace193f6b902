"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces in a text; dynamic programming carries,
for each position, the best score of a segmentation and how many pieces it has. Pieces that end at
one position are tried longest first and a later one must score strictly more, which is the rule by
which unigram tokenizers break ties. A character that no single-character piece covers scores
10 below the worst piece and counts as many tokens as it has UTF-8 bytes (byte fallback), or one.

As sentencepiece does, a text gets a leading space and spaces become U+2581. No piece has that mark
after another character, so a text is the concatenation of chunks (spaces, then other characters)
that are segmented one by one; scores are integers or sums of few, in double precision, so the
chunks' counts add up to the text's. Each distinct chunk of a block is counted once.

Defined cases: a null or empty text has 0 tokens; a chunk longer than ``LONG`` characters (which a
text without spaces can be) goes through the same recurrence, which needs memory for the longest
piece only. Rows repeat in the result as in the input; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import blocks, bounded_batches, numbered

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker remembers, of up to LONG characters.
MEMO, LONG = 400_000, 200


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their scores; byte_fallback: an unknown character becomes its bytes."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True

    def __post_init__(self):
        if any(MARK in p.lstrip(MARK) for p, _ in self.pieces):
            raise ValueError("a piece has a space after another character; chunks cannot be counted one by one")


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file, with the file's scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    return Vocabulary(tuple((model.id_to_piece(i), model.get_score(i)) for i in range(n) if not special[i]), any(model.is_byte(i) for i in range(n)))


class Counter:
    """Counts pieces of chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary.pieces), default=1)
        self.singles = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = vocabulary.byte_fallback

    def unknown_tokens(self, char: str) -> int:
        return len(char.encode("utf-8", "replace")) if self.byte_fallback else 1

    def __call__(self, text: str) -> int:
        """Pieces of the best segmentation of one chunk."""
        n, singles = len(text), self.singles
        width = min(self.longest, n) + 1  # scores and counts of the last positions, in a ring
        best, count = [None] * width, [0] * width
        best[0] = 0.0
        done = 0  # positions up to here are final

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:  # no piece ends at done + 1, or its pieces are in; the unknown character is tried last
                done += 1
                if text[done - 1] not in singles:
                    here, before = done % width, (done - 1) % width
                    score = best[before] + self.unknown
                    if best[here] is None or score > best[here]:
                        best[here], count[here] = score, count[before] + self.unknown_tokens(text[done - 1])
                nxt = (done + 1) % width
                best[nxt] = None

        if width > 1:
            best[1] = None
        for end, (length, score) in self.auto.iter(text):
            end += 1
            if end > done + 1:
                close(end - 1)
            here, before = end % width, (end - length) % width
            score += best[before]
            if best[here] is None or score > best[here]:
                best[here], count[here] = score, count[before] + 1
        close(n)
        return count[n % width]


CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def chunks(text: str) -> list[str]:
    """Spaces as marks, with the leading one, cut where a mark follows another character."""
    if not text:
        return []
    marked = " " + text
    if "  " not in marked and MARK not in marked and marked[-1] != " ":
        return marked[1:].split(" ")  # the usual case: each chunk has one mark in front, left out here
    return [c[1:] if len(c) > 1 and c[1] != MARK else c for c in CHUNK.findall(marked.replace(" ", MARK))]


def whole(chunk: str) -> str:
    """A chunk that does not begin with a mark had one."""
    return chunk if chunk[0] == MARK else MARK + chunk


def count_tokens(texts: list[str], counter: Counter, memo: dict[str, int]) -> np.ndarray:
    ids, starts, seen = numbered(chunks(t) for t in texts)
    each = np.empty(len(seen), np.int64)
    for i, chunk in enumerate(seen):
        n = memo.get(chunk)
        if n is None:
            n = counter(whole(chunk))
            if len(chunk) <= LONG:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[chunk] = n
        each[i] = n
    total = np.concatenate([[0], np.cumsum(each[ids])])
    return total[starts[1:]] - total[starts[:-1]]


_WORKER: dict = {}


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens for each row. The path must exist on every worker; each reads it once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _WORKER:
            _WORKER[vocabulary_path] = Counter(sentencepiece_vocabulary(vocabulary_path)), {}
        counter, memo = _WORKER[vocabulary_path]
        for block in blocks(batches, "t"):
            texts = [t or "" for t in block.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(count_tokens(texts, counter, memo))], ["id", "n_tokens"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
