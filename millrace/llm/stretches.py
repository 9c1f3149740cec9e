"""Best segmentations of many short strings at once: the same max-plus steps as `Vocabulary.forward`, each over all strings.

Pieces are found by walking the vocabulary's trie from every place of every string, one depth at a time, over the places that
are still inside the trie. Scores are then carried from place to place in the order that the tie rule asks for: for each end the
starts by rising place, replaced only by a strictly better score.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.unigram import Vocabulary

#: Widths of the tables that strings are worked in, by length; longer strings are segmented one by one.
WIDTHS = (4, 8, 12, 16, 24, 48)
ROWS = 4096
NONE = float("-inf")


class Trie:
    """The vocabulary as arrays: edges sorted by node and character, and for each node the piece that ends there."""

    def __init__(self, v: Vocabulary):
        first = np.zeros(0x110000, dtype=np.int32)
        keys, nexts, ids, scores = [], [], [-1], [NONE]
        stack = [(v.root, 0)]
        while stack:
            edges, node = stack.pop()
            for c, (i, score, below) in edges.items():
                to = len(ids)
                ids.append(-1 if i is None else i)
                scores.append(NONE if i is None else score)
                if node == 0:
                    first[ord(c)] = to
                else:
                    keys.append(node << 21 | ord(c))
                    nexts.append(to)
                stack.append((below, to))
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.nexts = np.array(keys + [1 << 62], dtype=np.int64)[np.append(by, len(keys))], np.array(nexts + [0], dtype=np.int32)[np.append(by, len(keys))]
        self.first, self.ids, self.scores = first, np.array(ids, dtype=np.int32), np.array(scores)
        self.v = v

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node below each node by a character; 0: none."""
        keys = nodes.astype(np.int64) << 21 | chars
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.nexts[at], 0)


def _table(trie: Trie, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings as columns of characters (0 past the end): ids in the rows from the last piece to the first, their number, and
    which strings need a character that no piece covers."""
    width, n = chars.shape
    score = np.full((min(trie.v.longest, width), width, n), NONE)
    piece = np.full(score.shape, -1, dtype=np.int32)
    nodes = trie.first[chars].ravel()
    place = np.flatnonzero(nodes)
    nodes = nodes[place]
    for depth in range(len(score)):
        score[depth].ravel()[place] = trie.scores[nodes]
        piece[depth].ravel()[place] = trie.ids[nodes]
        place, nodes = place[place < (width - depth - 1) * n], nodes[place < (width - depth - 1) * n]
        nodes = trie.step(nodes, chars.ravel()[place + (depth + 1) * n])
        place, nodes = place[nodes > 0], nodes[nodes > 0]
        if not len(place):
            score, piece = score[: depth + 1], piece[: depth + 1]
            break
    score[0] = np.where(piece[0] < 0, trie.v.unknown, score[0])
    best, start, ends_with = np.full((width + 1, n), NONE), np.zeros((width + 1, n), dtype=np.int32), np.full((width + 1, n), -1, dtype=np.int32)
    best[0] = 0.0
    for end in range(1, width + 1):
        for begin in range(max(0, end - len(score)), end):
            way = best[begin] + score[end - begin - 1, begin]
            better = way > best[end]
            best[end][better], start[end][better], ends_with[end][better] = way[better], begin, piece[end - begin - 1, begin][better]
    out, count = np.zeros((width, n), dtype=np.int32), np.zeros(n, dtype=np.int32)
    unknown, at, rows = np.zeros(n, dtype=bool), lengths.astype(np.int32), np.arange(n)
    while len(rows):
        ids = ends_with[at, rows]
        out[count[rows], rows] = ids
        unknown[rows[ids < 0]] = True
        count[rows] += 1
        at = start[at, rows]
        rows, at = rows[at > 0], at[at > 0]
    return out, count, unknown


def segmented(trie: Trie, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all strings, one after the other, and where each string's begin (one place more than strings)."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # strings' numbers, numbers of ids, ids
    alone = np.flatnonzero(lengths > WIDTHS[-1]).tolist()
    least = 0
    for width in WIDTHS:
        of_width = np.flatnonzero((lengths > least) & (lengths <= width))
        least = width
        for at in range(0, len(of_width), ROWS):
            numbers = of_width[at : at + ROWS]
            chars = np.array([strings[i] for i in numbers.tolist()], dtype=f"<U{width}").view("<u4").reshape(-1, width)
            out, count, unknown = _table(trie, np.ascontiguousarray(chars.T).astype(np.int64), lengths[numbers])
            alone += numbers[unknown].tolist()
            count[unknown] = 0
            width_of = count.max(initial=0)
            back = count[:, None] - 1 - np.arange(width_of)[None, :]
            ids = out[np.maximum(back, 0), np.arange(len(count))[:, None]][back >= 0]
            parts.append((numbers[~unknown], count[~unknown], ids))
    for i in alone:
        ids = np.frombuffer(trie.v.encode_segment(strings[i]), dtype="<i4")
        parts.append((np.array([i]), np.array([len(ids)], dtype=np.int32), ids))
    counts = np.zeros(len(strings), dtype=np.int64)
    for numbers, count, _ in parts:
        counts[numbers] = count
    begins = np.concatenate(([0], np.cumsum(counts)))
    all_ids = np.zeros(int(begins[-1]), dtype=np.int32)
    for numbers, count, ids in parts:
        ahead = np.repeat(begins[numbers] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        all_ids[ahead + np.arange(len(ids))] = ids
    return all_ids, begins


def take_ranges(values: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges `which` of values (range i is [begins[i], begins[i + 1])), one after the other, and their lengths."""
    count = (begins[1:] - begins[:-1])[which]
    ahead = np.repeat(begins[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return values[ahead + np.arange(int(count.sum()))], count
