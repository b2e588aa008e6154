"""Token counts of a unigram tokenizer without making its tokens.

A text is cut at spaces, each part led by the mark U+2581 (the Metaspace split of unigram tokenizers). For each part an
Aho-Corasick automaton over the vocabulary lists every piece that ends at each place; dynamic programming keeps the best
score and its number of pieces there. Ties go to the piece that starts earlier, a character that is no piece of its own
costs `lowest score - 10` and counts as its UTF-8 bytes where the vocabulary has byte pieces, else a run of such
characters counts as one unknown piece: the rules of the tokenizers library. Parts repeat, so each worker keeps the
counts of parts it has met.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from loomtext.llm.batches import map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_PARTS = 400_000


class UnigramCounter:
    """Counts of the best segmentation by a vocabulary of (piece, score); byte_fallback as said above."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.first: dict[str, tuple[int, float]] = {}
        for piece, score in vocab:
            self.first[piece] = (len(piece), score)
        for piece, value in self.first.items():
            if piece:
                self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.singles = {p for p in self.first if len(p) == 1}
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.seen: dict[str, tuple[int, int]] = {}

    def part(self, part: str) -> tuple[int, int]:
        """(pieces, characters that are no piece) of one part."""
        n = len(part)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        odd = [0] * (n + 1)
        run = [False] * (n + 1)  # whether an unknown character ends here
        singles, unknown = self.singles, self.unknown
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, value in self.automaton.iter(part):
            matches[end].append(value)
        for end in range(n):
            top = None
            for length, score in sorted(matches[end], reverse=True):
                at = end + 1 - length
                total = best[at] + score
                if top is None or total > top:
                    top, start, known = total, at, True
            if part[end] not in singles and (top is None or best[end] + unknown > top):
                top, start, known = best[end] + unknown, end, False
            best[end + 1] = top
            if known:
                count[end + 1], odd[end + 1] = count[start] + 1, odd[start]
            else:
                more = len(part[end].encode("utf-8", "surrogatepass")) if self.bytes else int(not run[end])
                count[end + 1], odd[end + 1], run[end + 1] = count[end] + more, odd[end] + 1, True
        return count[n], odd[n]

    def text(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        seen, pieces, odd = self.seen, 0, 0
        marked = text.replace(" ", MARK)
        for part in marked.split(MARK)[marked[0] == MARK :]:
            found = seen.get(part)
            if found is None:
                found = self.part(MARK + part)
                if len(part) <= 64:
                    if len(seen) >= KEPT_PARTS:
                        seen.clear()
                    seen[part] = found
            pieces += found[0]
            odd += found[1]
        return pieces, odd


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every entry of a local piece model, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def _counter(vocab: tuple[tuple[str, float], ...], byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(list(vocab), byte_fallback)


def count_tokens(docs: DataFrame, vocab: list[tuple[str, float]], byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces in the best segmentation of each whole text.

    Returns one row per input row: id_col, n_tokens and n_unknown (characters that are no piece), both long. A null or
    empty text has none; a space makes a part of its own where it ends the text or repeats, and a leading one stands for the
    mark; the mark itself in a text is as a space; repeated rows each get a row; an
    empty table gives none; other input columns are ignored. The vocabulary travels with the tasks; its size is fixed.
    """
    entries = tuple(vocab)

    def make(texts):
        counter = _counter(entries, byte_fallback)
        found = [counter.text(t) for t in texts]
        return [n for n, _ in found], [u for _, u in found]

    return map_texts(docs, {id_col: F.col(id_col)}, F.col(text_col).cast("string"), {"n_tokens": "long", "n_unknown": "long"}, make)
