"""Token counts of a unigram tokenizer without building its tokens.

The vocabulary is a public one with its scores; text is cut into words as a metaspace pre-tokenizer
cuts it (every space becomes U+2581, which begins a word; other white space stays inside words). For a
word, an Aho-Corasick automaton enumerates all vocabulary matches and dynamic programming keeps, for
each end, the best score and the piece count of the path that has it. No path is traced back.

Ties follow the tokenizer: a later candidate replaces the best only if its score is strictly greater,
and candidates for one end come in the order of their starts, so the longest piece wins. A character
that is no piece is an unknown of the least score less 10, tried after all matches; its bytes are
byte pieces, so it counts as many tokens as it has UTF-8 bytes. Scores add up in the tokenizer's order,
in double precision.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each; other columns are
ignored; empty input gives no rows. Texts of any length are cut into words first; one endless word
takes time and memory in proportion to its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from corvia.llm.arrow import map_rows

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task remembers; more begin a new memory.
MEMORY = 400_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in id order, without control pieces.

    The unknown and byte pieces are in, as a tokenizer's vocabulary has them: a text that spells one matches it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not model.is_control(i)
    ]


def word_counter(vocabulary: list[tuple[str, float]]) -> Callable[[str], tuple[int, int]]:
    """A function from a word to its piece count and the number of its characters that are unknown."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in vocabulary:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def count(word: str) -> tuple[int, int]:
        n = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in automaton.iter(word):
            matches[end].append(match)
        score, pieces, strange = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best, single = None, False
            for length, gain in sorted(matches[end], reverse=True):
                start = end + 1 - length
                single |= length == 1
                if best is None or gain + score[start] > best:
                    best, pieces[end + 1], strange[end + 1] = gain + score[start], pieces[start] + 1, strange[start]
            if not single and (best is None or unknown + score[end] > best):
                best, strange[end + 1] = unknown + score[end], strange[end] + 1
                pieces[end + 1] = pieces[end] + len(word[end].encode())
            score[end + 1] = best
        return pieces[n], strange[n]

    return count


def words_of(text: str) -> list[str]:
    """The words of a text as the pre-tokenizer cuts them."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if parts[0] == "":
        parts = parts[1:]
    return [SPACE + x for x in parts]


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_tokens, n_unknown: of each row's whole text."""

    def make():
        count = word_counter(unigram_vocabulary(vocabulary_path))
        memory: dict[str, tuple[int, int]] = {}

        def work(keys, texts):
            out: dict[str, list] = {key: keys, "n_words": [], "n_tokens": [], "n_unknown": []}
            for x in texts:
                words = words_of(x or "")
                tokens = strange = 0
                for word, n in Counter(words).items():
                    found = memory.get(word)
                    if found is None:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        found = count(word)
                        if len(word) <= 64:
                            memory[word] = found
                    tokens += n * found[0]
                    strange += n * found[1]
                out["n_words"].append(len(words))
                out["n_tokens"].append(tokens)
                out["n_unknown"].append(strange)
            yield out

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), f"`{key}` {kind}, n_words long, n_tokens long, n_unknown long", make)
