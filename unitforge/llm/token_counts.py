"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; a Viterbi pass carries the best score and its number of pieces
to each position. Ties go as in the tokenizers library's Unigram model: of equal scores the one with the earliest start (the longest
piece) stays, an unknown character is tried last, and unknown characters fuse or fall back to bytes. Counts of words are kept by a
worker, so a word is worked out once however many documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Fixed value of the library: what an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


#: Longer words stay out of the caches, which so are bounded in bytes too.
LONG_WORD = 64


class Counter:
    """Counts pieces of words; pieces: vocabulary with scores."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, words: int = 600_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{i:02X}>" in self.known for i in range(256))
        self.limit, self.young, self.old = words, {}, {}

    def pieces_of(self, word: str) -> int:
        """Best path's number of pieces for one word (that begins with the space mark)."""
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        count, fused = [0] * (n + 1), [False] * (n + 1)
        single = [False] * n

        def unknown(end: int) -> None:
            """Step over the character before end as an unknown one, after all pieces that end there."""
            at = end - 1
            if not single[at]:
                value = self.unknown + score[at]
                if score[end] is None or value > score[end]:
                    score[end], fused[end] = value, True
                    count[end] = count[at] + (len(word[at].encode("utf-8", "surrogatepass")) if self.bytes else not fused[at])

        done = 0
        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:
                done += 1
                unknown(done)
            if done == end - 1 and score[done] is None:
                unknown(done)
            start = end - length
            value = score[start] + own
            if score[end] is None or value > score[end]:
                score[end], count[end], fused[end] = value, count[start] + 1, False
            if length == 1:
                single[start] = True
        while done < n:
            done += 1
            unknown(done)
        return count[n]

    def _word(self, word: str) -> int:
        value = self.old.get(word)
        if value is None:
            value = self.pieces_of(SPACE + word)
        if len(word) > LONG_WORD:
            return value
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[word] = value
        return value

    def count(self, text: str) -> int:
        """Tokens of a whole text: blanks become space marks, one is put in front, and each mark begins a word."""
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        if not words[0] and len(words) > 1:
            del words[0]  # the text begins with a mark of its own
        try:
            return sum(map(self.young.__getitem__, words))
        except KeyError:
            young = self.young
            return sum([young[w] if w in young else self._word(w) for w in words])


_COUNTERS: dict[tuple, Counter] = {}


def count_column(df: DataFrame, path: str, column: str = "text", byte_fallback: bool = True) -> DataFrame:
    """Append n_tokens and n_words (space-separated) to df; columns of these names are replaced, others stay.

    A null or empty text has none of either. Whole texts are counted whatever their length, rows are independent of each other.
    """
    new = ("n_tokens", "n_words")
    df = df.select([F.col(f"`{c}`") for c in df.columns if c == column or c.lower() not in new])
    kept = [f.name for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in kept), *(T.StructField(n, T.LongType()) for n in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, byte_fallback) not in _COUNTERS:
            _COUNTERS[path, byte_fallback] = Counter(load_pieces(path), byte_fallback)
        counter = _COUNTERS[path, byte_fallback]
        for batch in batches:
            texts = batch.column(column).to_pylist()
            tokens = [counter.count(t or "") for t in texts]
            words = [sum(map(bool, t.split(" "))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=[*kept, *new])

    return df.mapInArrow(run, schema)
