"""A unigram piece vocabulary read from a SentencePiece model file, and the exact best segmentation of short strings.

Tie rules are those of the SentencePiece unigram encoder: a later candidate for the same end replaces an earlier one
only with a strictly better score, and candidates come by rising start, so the longest piece wins a tie. A character
that no one-character piece covers can be an unknown of one character, 10 below the least score, spelt in byte pieces.
Scores are summed exactly (float64), never rounded over a long text.

The model's pieces and scores are taken as a unigram vocabulary even if the file was made for BPE: best-path search is
defined by pieces and scores alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in ordinary}
        self.id = {self.pieces[i]: i for i in ordinary}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i in range(n) if sp.is_unknown(i)), 0)
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.id))
        #: what each id decodes to
        self.spelt = [b""] * n
        for i in ordinary:
            self.spelt[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.spelt[i] = bytes([b])
        self.spelt[self.unknown_id] = " ⁇ ".encode()
        # no piece goes on past a space that follows another character, nor joins a line end with anything
        by_space = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        by_line = not any("\n" in p and len(p) > 1 for p in self.id)
        self.cuts = by_space
        self.segment = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if by_space and by_line else f"[^{SPACE}]+|{SPACE}+[^{SPACE}]*" if by_space else "(?s:.+)")
        self.root: dict = {}
        for piece, i in self.id.items():
            node = self.root
            for c in piece[:-1]:
                node = node.setdefault(c, [None, 0.0, {}])[2]
            last = node.setdefault(piece[-1], [None, 0.0, {}])
            last[0], last[1] = i, self.score[piece]

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def forward(self, s: str, best: list[float], back: list, begin: int = 0, stop: int | None = None) -> None:
        """Fill best (score of the best way to each place; -inf: none) and back ((start, id) of the piece that ends there) from the
        pieces that start in [begin, stop). Places that are set beforehand stand for ways that came from before begin."""
        root, unknown = self.root, self.unknown
        n, none = len(s), float("-inf")
        for i in range(begin, n if stop is None else stop):
            here = best[i]
            if here == none:
                continue
            node, single = root, False
            for j in range(i, n):
                found = node.get(s[j])
                if found is None:
                    break
                if found[0] is not None:
                    if j == i:
                        single = True
                    if here + found[1] > best[j + 1]:
                        best[j + 1] = here + found[1]
                        back[j + 1] = (i, found[0])
                node = found[2]
            if not single and here + unknown > best[i + 1]:
                best[i + 1] = here + unknown
                back[i + 1] = (i, -1)

    def ids_back(self, s: str, back: list, end: int, begin: int = 0) -> tuple[list[int], int]:
        """The ids of the pieces that lead to place end, in order, and the place at or after begin where they start."""
        out: list[int] = []
        while end > begin and back[end] is not None:
            start, i = back[end]
            out += [i] if i >= 0 else [self.bytes.get(b, self.unknown_id) for b in reversed(s[start].encode())] if self.bytes else [self.unknown_id]
            end = start
        return out[::-1], end

    def encode_segment(self, s: str) -> bytes:
        best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
        self.forward(s, best, back)
        return np.array(self.ids_back(s, back, len(s))[0], dtype="<i4").tobytes()


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def default_model() -> str:
    """The public SentencePiece file of this box; operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
