"""Small array helper used inside tasks: all piece matches of a batch of words.

Spark distributes the words; this only walks one batch of them at a time, for
all words at once, position by position.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Generator, Iterator, Sequence

import numpy as np

_CHAR_BITS = 21  # a Unicode code point fits


def code_points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)


class PieceIndex:
    """Prefix table of the pieces: (state, character) leads to a state."""

    def __init__(self, pieces: Sequence[str]):
        chars = code_points(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.longest = int(lengths.max(initial=1))
        first = np.cumsum(lengths) - lengths
        state = np.zeros(len(pieces), dtype=np.int64)
        states, keys = 1, []
        for depth in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > depth)
            level, place = np.unique(
                (state[live] << _CHAR_BITS) | chars[first[live] + depth], return_inverse=True
            )
            state[live] = states + place
            states += len(level)
            keys.append(level)
        # deeper levels start from later states, so the levels are in key order
        # and the state a key leads to is its place in the table plus one
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        self.piece_at = np.full(states, -1, dtype=np.int64)
        self.piece_at[state] = np.arange(len(pieces))
        # the first character is looked up directly; the last slot means none
        roots = keys[0] if keys else self.keys
        self.root = np.zeros(int(roots.max(initial=0)) + 2, dtype=np.int64)
        self.root[roots] = np.arange(len(roots)) + 1

    def matches(self, chars: np.ndarray, ends: np.ndarray):
        """(start, length, piece) of every piece found; ``ends`` bounds each start."""
        state = self.root[np.minimum(chars, len(self.root) - 1)]
        at = np.flatnonzero(state)
        state, depth, found = state[at], 1, []
        while len(at):
            piece = self.piece_at[state]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), depth), piece[whole]))
            more = at + depth < ends[at]
            at, state = at[more], state[more]
            wanted = (state << _CHAR_BITS) | chars[at + depth]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[place] == wanted
            at, state, depth = at[hit], place[hit] + 1, depth + 1
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(part) for part in zip(*found))


def best_sums(options: Sequence[list[float]], k: int) -> tuple[list[float], list[list[int]]]:
    """The ``k`` best sums of one score from each list, and the places taken in the lists.

    Lists are in descending order and are put together from left to right; of
    equal sums the one with the better left side comes first.
    """
    losses = [(scores[0] - scores[1], -number) for number, scores in enumerate(options) if len(scores) > 1]
    open_ = sorted(-minus for _, minus in heapq.nsmallest(k - 1, losses))
    firsts = np.fromiter((scores[0] for scores in options), dtype=np.float64, count=len(options))
    totals, changes = _open_sums(firsts, [(number, options[number]) for number in open_], k)
    picks = []
    for some in changes:
        taken = [0] * len(options)
        for number, place in some:
            taken[number] = place
        picks.append(taken)
    return totals, picks


def _open_sums(
    firsts: np.ndarray, options: list[tuple[int, list[float]]], k: int
) -> tuple[list[float], list[list[tuple[int, int]]]]:
    """:func:`best_sums` from the first scores of all lists and, in ``options``, all scores
    of those that may take another place; the sums, and where they do so.

    At most ``k - 1`` lists have to be there: those that lose least by their second
    score and, of equal ones, the last.  A sum with another list's second score comes
    behind the best one and those with one of these second scores each.
    """
    totals, steps, at = [0.0], [], 0
    for number, scores in options:
        totals = _added(totals, firsts[at:number])
        found = [(-(t + s), i, j) for i, t in enumerate(totals) for j, s in enumerate(scores[: k // (i + 1)])]
        found.sort()
        del found[k:]
        totals = [-minus for minus, _, _ in found]
        steps.append((number, found))
        at = number + 1
    totals = _added(totals, firsts[at:])
    changes = []
    for way in range(len(totals)):
        taken = []
        for number, found in reversed(steps):
            _, way, place = found[way]
            if place:
                taken.append((number, place))
        changes.append(taken[::-1])
    return totals, changes


def _added(totals: list[float], scores: np.ndarray) -> list[float]:
    """Each total with the scores added to it, one after the other."""
    if len(scores) < 8:
        for s in scores.tolist():
            totals = [t + s for t in totals]
        return totals
    return [float(np.cumsum(np.append(t, scores))[-1]) for t in totals]


def leftmost_longest(index: PieceIndex, texts: Sequence[str], window: int = 1 << 20) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces found in each text, from left to right without
    overlap; of those that start at the same place the longest.  The texts are
    walked in windows of so many characters."""
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    begins, whole, free = np.append(0, ends).tolist(), "".join(texts), 0
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for base in range(0, len(whole), window):
        chars = code_points([whole[base : base + window + index.longest]])
        own = np.searchsorted(ends, np.arange(base, base + len(chars)), side="right")
        start, length, _ = index.matches(chars, np.minimum(ends[own] - base, len(chars)))
        inside = start < window
        start, length = start[inside], length[inside]
        order = np.lexsort((-length, start))
        start, length = start[order], length[order]
        for which, at, size in zip(own[start].tolist(), (start + base).tolist(), length.tolist()):
            if at >= free:
                found[which].append((at - begins[which], at - begins[which] + size))
                free = at + size
    return found


class Lattice:
    """All segmentations of a batch of non-empty words.

    Node ``i`` of a word lies before its ``i``-th character.  An edge is a piece
    or, where no one-character piece fits, an unknown character (piece -1).
    Every segmentation passes the nodes that no edge jumps over.  They part a
    word into spans that are solved on their own, all at the same time, so the
    number of steps is the length of the longest span and not of the text.
    """

    def __init__(self, index: PieceIndex, words: Sequence[str], skip_whole: bool = False):
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        offset = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        chars = code_points(words)
        start, length, piece = index.matches(chars, (offset + lengths)[word])
        if skip_whole:
            part = length < lengths[word[start]]
            start, length, piece = start[part], length[part], piece[part]
        single = np.zeros(len(word), dtype=bool)
        single[start[length == 1]] = True
        unknown = np.flatnonzero(~single)
        start = np.concatenate([start, unknown])
        length = np.concatenate([length, np.ones(len(unknown), dtype=np.int64)])
        piece = np.concatenate([piece, np.full(len(unknown), -1)])
        source = start + word[start]
        target = source + length

        self._chars, self._skip_whole = chars, skip_whole
        self.words, self.nodes = len(words), len(word) + len(words)
        begun = np.bincount(source + 1, minlength=self.nodes)
        ended = np.bincount(target, minlength=self.nodes)
        fixed = np.flatnonzero(np.cumsum(begun - ended) == 0)
        ends_word = np.zeros(self.nodes, dtype=bool)
        ends_word[offset + lengths + np.arange(len(words))] = True
        opens = ~ends_word[fixed]
        self.first = fixed[opens]  # first and last node of each span
        self.last = fixed[np.flatnonzero(opens) + 1]
        self.steps = int((self.last - self.first).max(initial=0))
        self.span_word = np.cumsum(ends_word)[self.first]

        begins = np.zeros(self.nodes, dtype=np.int64)
        begins[self.first] = 1
        span = np.cumsum(begins)[source] - 1
        local = source - self.first[span]
        # longest piece first among the edges into a node: it wins equal scores
        widest = int(length.max(initial=0)) + 1
        order = np.argsort(((local + length) * self.nodes + target) * widest - length)
        self.span, self.word = span[order], self.span_word[span[order]]
        self.source, self.target, self.piece = source[order], target[order], piece[order]
        self._local_source, self._local_target = local[order], (local + length)[order]

    def weights(self, scores: np.ndarray, unknown: float) -> np.ndarray:
        return np.append(scores, unknown)[self.piece]  # piece -1 is the last entry

    def best(self, weight: np.ndarray):
        """Best segmentation: (word, piece, start node) in text order, and scores."""
        score = np.full(self.nodes, -np.inf)
        back = np.zeros(self.nodes, dtype=np.int64)
        for low, high, group, node in _stages(self._local_target, self.target, self.steps):
            value = weight[low:high] + np.where(
                self._local_source[low:high] == 0, 0.0, score[self.source[low:high]]
            )
            top = np.maximum.reduceat(value, group)
            owner = np.repeat(np.arange(len(group)), np.diff(np.append(group, high - low)))
            winner = np.flatnonzero(value == top[owner])
            owner = owner[winner]
            score[node] = top
            back[node] = low + winner[np.append(True, owner[1:] != owner[:-1])]
        taken, spans, node = [], np.arange(len(self.first)), self.last
        while len(spans):
            edge = back[node]
            taken.append(edge)
            node = self.source[edge]
            open_ = node != self.first[spans]
            spans, node = spans[open_], node[open_]
        edges = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
        edges = edges[np.argsort(self.source[edges])]
        totals = np.bincount(self.span_word, weights=score[self.last], minlength=self.words)
        return self.word[edges], self.piece[edges], self.source[edges], totals

    def _forward(self, weight: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all ways from a span's first node to each node."""
        forward = np.full(self.nodes, -np.inf)
        for low, high, group, node in _stages(self._local_target, self.target, self.steps):
            before = np.where(
                self._local_source[low:high] == 0, 0.0, forward[self.source[low:high]]
            )
            forward[node] = _log_sums(before + weight[low:high], group)
        return forward

    def sample(self, weight: np.ndarray, chance: np.ndarray):
        """One segmentation of each word, by its probability: (word, piece) in text order.

        ``chance`` has a uniform number for each node.  Spans are walked from
        their last node back; an edge into a node is taken by its share of the
        ways that lead there.
        """
        forward = self._forward(weight)
        before = np.where(self._local_source == 0, 0.0, forward[self.source])
        share = np.exp(before + weight - forward[self.target])
        # edges into a node lie together; sums of their shares, one node after the other
        first = np.append(True, self.target[1:] != self.target[:-1]) if len(share) else np.zeros(0, dtype=bool)
        number = np.cumsum(first) - 1
        sums = np.cumsum(share)
        inside = sums - (sums - share)[first][number]
        last = np.append(np.flatnonzero(first)[1:], len(share)) - 1 if len(share) else first
        rank = np.zeros(self.nodes, dtype=np.int64)
        rank[self.target] = number
        ladder = number + np.minimum(inside / np.maximum(inside[last][number], 1e-300), 1.0)
        taken, spans, node = [], np.arange(len(self.first)), self.last
        while len(spans):
            edge = np.searchsorted(ladder, rank[node] + chance[node], side="right")
            edge = np.minimum(edge, last[rank[node]])
            taken.append(edge)
            node = self.source[edge]
            open_ = node != self.first[spans]
            spans, node = spans[open_], node[open_]
        edges = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
        edges = edges[np.argsort(self.source[edges])]
        return self.word[edges], self.piece[edges]

    def nbest(self, weight: np.ndarray, k: int) -> list[list[tuple[float, list[int]]]]:
        """The ``k`` best segmentations of each word, as (score, pieces), best first.

        Of equal scores the one with the longer last piece comes first.
        """
        scores, pieces, bounds = self.nbest_paths(weight, k)
        paths = iter([part.tolist() for part in np.split(pieces, bounds[1:-1])])
        return [[(score, next(paths)) for score in own] for own in scores]

    def nbest_paths(self, weight: np.ndarray, k: int) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
        """:meth:`nbest` as the scores of each word, the pieces of all ways one after
        the other, and where the ways begin and end.

        Spans of the same text have the same ways, so each text is solved once.  The
        best ways of a word take the best way through all but a few of its spans: only
        those that lose least by their second way are tried with others.  ``weight``
        depends on the piece alone, as :meth:`weights` gives it.
        """
        # the ways through the spans: of one edge, as they are, and of more, once for each text
        single = self.last - self.first == 1
        own = self.last[self.span] == self.first[self.span] + 1
        of_single = np.zeros(len(self.first), dtype=np.int64)
        of_single[self.span[own]] = np.flatnonzero(own)
        of_single = of_single[single]
        longer = np.flatnonzero(~single)
        solved, number = self._distinct(longer)
        ends, size, table = self._span_ways(solved, weight, k)
        begin = np.cumsum(size) - size
        second = ends[:, 1] if k > 1 else np.full(len(ends), -np.inf)

        entry = np.zeros(len(self.first), dtype=np.int64)
        entry[single], entry[longer] = np.arange(len(of_single)) + len(table), begin[number * k]
        sizes = np.ones(len(self.first), dtype=np.int64)
        sizes[longer] = size[number * k]
        firsts = np.zeros(len(self.first))
        firsts[single], firsts[longer] = weight[of_single], ends[number, 0]
        code = np.full(len(self.first), -1)
        code[longer] = number
        table = np.append(table, self.piece[of_single])
        after = np.append(0, np.cumsum(sizes))
        best = table[np.repeat(entry - after[:-1], sizes) + np.arange(after[-1])]

        # the spans of each word that may take another way, see _open_sums
        choice = longer[second[number] > -np.inf]
        loss = ends[code[choice], 0] - second[code[choice]]
        order = np.lexsort((-choice, loss, self.span_word[choice]))
        choice = choice[order]
        owner = self.span_word[choice]
        choice = np.sort(choice[np.arange(len(choice)) - np.searchsorted(owner, owner) < k - 1])
        # spans of a word lie together
        words = np.arange(self.words + 1)
        cuts, opens = np.searchsorted(self.span_word, words).tolist(), np.searchsorted(self.span_word[choice], words).tolist()
        choice, ways = choice.tolist(), [[x for x in row if x > -np.inf] for row in ends.tolist()]
        begin, size, code, after = begin.tolist(), size.tolist(), code.tolist(), after.tolist()
        scores, parts, lengths = [], [], []
        for low, high, one, two in zip(cuts, cuts[1:], opens, opens[1:]):
            options = [(span - low, ways[code[span]]) for span in choice[one:two]]
            totals, changes = _open_sums(firsts[low:high], options, k)
            scores.append(totals)
            for some in changes:
                at, length = after[low], 0
                for place, way in some:
                    name = code[low + place] * k + way
                    parts += [best[at : after[low + place]], table[begin[name] : begin[name] + size[name]]]
                    length += after[low + place] - at + size[name]
                    at = after[low + place + 1]
                parts.append(best[at : after[high]])
                lengths.append(length + after[high] - at)
        pieces = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return scores, pieces, np.append(0, np.cumsum(np.array(lengths, dtype=np.int64)))

    def _distinct(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of the spans for each of their texts, and for each span the number of its text."""
        if self._skip_whole:  # a span that is a word has fewer edges than its text elsewhere
            return spans, np.arange(len(spans))
        start, stop = self.first[spans] - self.span_word[spans], self.last[spans] - self.span_word[spans]
        # up to three characters make one number
        short = stop - start <= 3
        key = np.zeros(int(short.sum()), dtype=np.int64)
        for at in range(3):
            place = start[short] + at
            inside = place < stop[short]
            key[inside] = (key[inside] << _CHAR_BITS) | (self._chars[place[inside]] + 1)
        found, first, place = np.unique(key, return_index=True, return_inverse=True)
        number = np.zeros(len(spans), dtype=np.int64)
        number[short] = place
        texts: dict[bytes, int] = {}
        long = np.flatnonzero(~short)
        for i, a, b in zip(long.tolist(), start[long].tolist(), stop[long].tolist()):
            number[i] = len(found) + texts.setdefault(self._chars[a:b].tobytes(), len(texts))
        solved = np.zeros(len(found) + len(texts), dtype=np.int64)
        solved[: len(found)] = spans[short][first]
        solved[number[long][::-1]] = spans[long][::-1]
        return solved, number

    def _span_ways(self, spans: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of the ``k`` best ways through each of the spans, the number of pieces of
        each way, and these pieces one way after the other.

        Every node keeps the ``k`` best ways to it as steps back, all spans at the
        same time.
        """
        number = np.full(len(self.first), -1)
        number[spans] = np.arange(len(spans))
        edges = np.flatnonzero(number[self.span] >= 0)
        span, weight = number[self.span[edges]], weight[edges]
        # nodes behind the first one of a span, one span after the other
        shift = np.append(0, np.cumsum(self.last[spans] - self.first[spans]))
        local, source = self._local_source[edges], shift[span] + self._local_source[edges] - 1
        score = np.full((int(shift[-1]), k), -np.inf)
        back = np.zeros((int(shift[-1]), k), dtype=np.int64)  # edge * k + way to its source
        target = shift[span] + self._local_target[edges] - 1
        for low, high, group, node in _stages(self._local_target[edges], target, self.steps):
            before = np.where((local[low:high] == 0)[:, None], -np.inf, score[source[low:high]])
            before[local[low:high] == 0, 0] = 0.0
            value = (before + weight[low:high, None]).ravel()
            owner = np.repeat(np.repeat(np.arange(len(group)), np.diff(np.append(group, high - low))), k)
            real = np.flatnonzero(value > -np.inf)
            order = real[np.lexsort((-value[real], owner[real]))]
            mine = owner[order]
            place = np.arange(len(order)) - np.searchsorted(mine, mine)
            kept = place < k
            order, mine, place = order[kept], node[mine[kept]], place[kept]
            score[mine, place] = value[order]
            back[mine, place] = low * k + order
        # the edges of every way through every span, from its last node back
        ends = score[shift[1:] - 1]
        own, way = np.nonzero(ends > -np.inf)
        name, node, taken = own * k + way, shift[own + 1] - 1, []
        while len(name):
            step = back[node, way]
            edge, way = step // k, step % k
            taken.append((name, edge))
            node, open_ = source[edge], local[edge] > 0
            name, node, way = name[open_], node[open_], way[open_]
        names, used = [np.concatenate(part) if taken else np.zeros(0, dtype=np.int64) for part in (list(zip(*taken)) or [(), ()])]
        order = np.lexsort((source[used], names))
        return ends, np.bincount(names, minlength=len(spans) * k), self.piece[edges[used[order]]]

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """Probability of each edge over all segmentations of its word."""
        forward = self._forward(weight)
        total = forward[self.last][self.span]

        order = np.argsort(self._local_source * self.nodes + self.source)
        source, target, heavy = self.source[order], self.target[order], weight[order]
        closing = target == self.last[self.span[order]]
        backward = np.full(self.nodes, -np.inf)
        stages = list(_stages(self._local_source[order], source, self.steps))
        for low, high, group, node in reversed(stages):
            after = np.where(closing[low:high], 0.0, backward[target[low:high]])
            backward[node] = _log_sums(after + heavy[low:high], group)
        before = np.where(self._local_source == 0, 0.0, forward[self.source])
        after = np.where(self.target == self.last[self.span], 0.0, backward[self.target])
        return np.exp(before + weight + after - total)


def best_of_long(
    index: PieceIndex, word: str, scores: np.ndarray, unknown: float, window: int
) -> Iterator[np.ndarray]:
    """The pieces of the best segmentation of one endless word, a run at a time.

    The same pieces as :meth:`Lattice.best` gives.  A window is solved up to its
    last node that no edge jumps over.  Where a window has no such node, scores
    of the last nodes are carried into the next one, and what lies before the
    node that all open paths share is given out; a stretch without such a node
    is remembered by two bytes a character.
    """
    weight = np.append(scores, unknown)
    at = 0
    while at < len(word):
        _, _, _, fixed = _edges(index, word, at, min(len(word), at + window))
        if len(fixed):
            lattice = Lattice(index, [word[at : at + int(fixed[-1])]])
            yield lattice.best(lattice.weights(scores, unknown))[1]
            at += int(fixed[-1])
        else:
            at = yield from _carried(index, word, at, weight, window)


def _edges(index: PieceIndex, word: str, at: int, stop: int):
    """(start, length, piece) of the edges that start from ``at`` to before ``stop``, by
    start, and the nodes behind ``at`` up to ``stop`` that no edge jumps over."""
    chars = code_points([word[at : stop + index.longest]])
    start, length, piece = index.matches(chars, np.full(len(chars), len(chars)))
    own = start < stop - at
    start, length, piece = start[own], length[own], piece[own]
    single = np.zeros(stop - at, dtype=bool)
    single[start[length == 1]] = True
    unknown = np.flatnonzero(~single)
    start = np.concatenate([start, unknown])
    length = np.concatenate([length, np.ones(len(unknown), dtype=np.int64)])
    piece = np.concatenate([piece, np.full(len(unknown), -1)])
    size = stop - at + index.longest + 1
    over = np.cumsum(np.bincount(start + 1, minlength=size) - np.bincount(start + length, minlength=size))
    order = np.argsort(start, kind="stable")
    return start[order], length[order], piece[order], np.flatnonzero(over[1 : stop - at + 1] == 0) + 1


def _carried(
    index: PieceIndex, word: str, base: int, weight: np.ndarray, window: int
) -> Generator[np.ndarray, None, int]:
    """Pieces from ``base`` to the next node that no edge jumps over, which is returned."""
    back = array("H" if index.longest < 1 << 16 else "L")  # length of the best edge into each node behind base
    at, open_score, open_step = base, [0.0], [0]
    patience = window  # characters that are undecided before the way back is walked again
    while True:
        stop = min(len(word), at + window)
        start, length, piece, fixed = _edges(index, word, at, stop)
        end = int(fixed[0]) if len(fixed) else stop - at
        room = stop - at + index.longest + 1
        score = open_score + [-np.inf] * (room - len(open_score))
        step = open_step + [0] * (room - len(open_step))
        # edges come by start, so of equal scores the longest piece is there first
        for s, n, w in zip(start.tolist(), length.tolist(), weight[piece].tolist()):
            value = score[s] + w
            if value > score[s + n]:
                score[s + n], step[s + n] = value, n
        back.extend(step[1 : end + 1])
        at += end
        if len(fixed):
            yield from _path(index, word, base, at, back, window)
            return at
        open_score, open_step = score[end : end + index.longest + 1], step[end : end + index.longest + 1]
        if at - base < patience:
            continue
        # a path goes on from one of the last nodes; back to where they all meet
        nodes = set(range(max(base, at - index.longest + 1), at + 1))
        last = max(nodes)
        while len(nodes) > 1 and last > base:
            if last in nodes:
                nodes.remove(last)
                nodes.add(last - back[last - base - 1])
            last -= 1
        if len(nodes) == 1 and (shared := nodes.pop()) > base:
            yield from _path(index, word, base, shared, back, window)
            del back[: shared - base]
            base = shared
        patience = max(window, 2 * (at - base))


def _path(index: PieceIndex, word: str, base: int, end: int, back: array, window: int) -> Iterator[np.ndarray]:
    """The pieces on the best path from ``base`` to ``end``."""
    taken, node = array("q"), end
    while node > base:
        node -= back[node - base - 1]
        taken.append(node)
    starts = np.frombuffer(taken, dtype=np.int64)[::-1]
    lengths = np.diff(np.append(starts, end))
    for low in range(0, len(starts), window):
        some, sizes = starts[low : low + window], lengths[low : low + window]
        for first in range(int(some[0]), int(some[-1]) + 1, window):
            inside = (some >= first) & (some < first + window)
            start, length, piece, _ = _edges(index, word, first, min(len(word), first + window))
            width = index.longest + 1
            keys = start * width + length
            order = np.argsort(keys)
            wanted = (some[inside] - first) * width + sizes[inside]
            yield piece[order][np.searchsorted(keys[order], wanted)]


def _stages(local: np.ndarray, node: np.ndarray, steps: int):
    """Edge ranges by position in the word, each with its groups of equal node."""
    cuts = np.searchsorted(local, np.arange(steps + 2))
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            part = node[low:high]
            group = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            yield low, high, group, part[group]


def _log_sums(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(value, group)
    spread = np.repeat(top, np.diff(np.append(group, len(value))))
    return top + np.log(np.add.reduceat(np.exp(value - spread), group))
