"""Token counts by a count-only Viterbi pass.

Counts the pieces of the best unigram segmentation without making the pieces.  An Aho-Corasick automaton
of the vocabulary lists, at every end, the pieces that match there (longest first); dynamic programming carries
the best score and its number of pieces.  Tie rules are those of the ``tokenizers`` library's Unigram model: a later
candidate must be strictly better, and for one end the longer piece comes first; a position where no
single character matches may be crossed by an unknown character, scored 10 below the lowest piece; a run of unknown
characters is one piece, or its bytes where every byte has a piece.

The model has the pieces and scores of a public vocabulary file (sentencepiece format; BPE scores are the negative ranks).
Text is parted at white space, and each word starts with the word mark.

Contract of ``count``: one row per input row.  Null and empty texts have no tokens.  Repeated rows give repeated results;
whole texts of any length are read; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import memory
from tidewatch.llm.common import load, ship
from tidewatch.llm.textvec import pieces

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers; then it forgets those met in one batch only (all, if that isn't enough).
MEMORY_WORDS = 300_000


def unigram_vocabulary(path: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """(pieces with scores in order of id, id of the unknown piece) of a sentencepiece model file."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class ViterbiCounter:
    def __init__(self, vocab: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown_score = min(s for _, s in vocab) - UNKNOWN_PENALTY
        names = {p for p, _ in vocab}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.words: dict[str, int] = {}
        self.once: set[str] = set()

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of one word, its mark included."""
        n = len(word)
        best, start = [0.0] * (n + 1), [-1] * (n + 1)
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        matches: dict[int, list[tuple[int, float]]] = {}
        for last, (size, score) in self.auto.iter(word):
            matches.setdefault(last + 1, []).append((size, score))
        single = {end for end, m in matches.items() if m[-1][0] == 1 or any(size == 1 for size, _ in m)}
        for end in range(1, n + 1):
            for size, score in sorted(matches.get(end, ()), reverse=True):
                at = end - size
                if start[end] < 0 or best[at] + score > best[end]:
                    best[end], start[end], pieces[end], unknown[end] = best[at] + score, at, pieces[at] + 1, False
            if end not in single and (start[end] < 0 or best[end - 1] + self.unknown_score > best[end]):
                best[end], start[end], unknown[end] = best[end - 1] + self.unknown_score, end - 1, True
                if self.bytes:
                    pieces[end] = pieces[end - 1] + len(word[end - 1].encode())
                else:
                    pieces[end] = pieces[end - 1] + (not unknown[end - 1])
        return pieces[n]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        cut = [(t or "").split() for t in texts]
        met: set[str] = set()
        for ws in cut:
            met.update(ws)
        self.once -= met
        known = self.words
        todo = [w for w in met if w not in known]
        if len(known) + len(todo) > MEMORY_WORDS:
            for w in self.once:
                del known[w]
            if len(known) > MEMORY_WORDS // 2:
                known.clear()
                todo = list(met)
            self.once = set()
        for w in todo:
            known[w] = self.count(MARK + w)
        self.once.update(todo)
        out = [sum([known[w] for w in ws]) for ws in cut]
        for w in [w for w in todo if len(w) > 64]:
            del known[w]
            self.once.discard(w)
        return out


_counter: list[ViterbiCounter] = []
memory.keeps("tokencount", _counter.clear)


def count(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""
    ship(docs.sparkSession)

    @memory.task("tokencount")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _counter:
            _counter.append(ViterbiCounter(*unigram_vocabulary()))
        for part in pieces(batches, "text"):
            texts = part.column("text").to_pylist()
            n = _counter[0].count_batch(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len((t or "").split()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: unigram token counts of every document."""
    return count(load(spark, sf_dir, "documents").select("doc_id", "text"))
