"""SentencePiece encoding with the N best segmentations, and decoding.

Every text is a lattice of pieces. Forward Viterbi scores say how well any
position can be reached; searching backwards from the end with them as
heuristic (they are exact) is an A* search that completes segmentations in
order of score, best first.

No piece has a space behind another character, so every path passes the start
of every word: the lattice of a text is a chain of word lattices. New words are
searched side by side in arrays and remembered, in bounded bytes; the N best of a text are combined from its
words: only the N - 1 words whose second choice costs least can differ from
the best segmentation, so only those get their own list by A*. The result is
that of the search over the whole lattice (``nbest`` does that, and tests
compare the two).

As in SentencePiece, text gets a space in front, and a character that no piece
covers becomes bytes. Spaces are kept as they are, so decoding gives every
text back exactly.

The vocabulary is a parameter. One of merges has ranks and no probabilities;
``zipf`` scores make log-probabilities of them by Zipf's law. ``model`` scores
take the file's own, for vocabularies that have them.

Defined cases: null text gives null ids and no pieces, an empty text no
pieces. Repeated rows are encoded each for itself. Other columns of any name
stay or are not read.
"""

import heapq
import math
import re
import sys
from dataclasses import dataclass
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import array_function, parts, utf8

#: Segmentations for each text.
N_BEST = 4
#: Bytes of the words that a task remembers, and of their N best; beyond either, those are forgotten.
_HELD_BYTES, _LIST_BYTES = 48_000_000, 8_000_000
#: Characters of texts that are encoded together, and bytes of texts whose results are Python objects at a time.
_GROUP, _SLICE = 1_000_000, 4_000_000
#: Words that are searched together, and the longest of them; longer ones are searched alone.
_TOGETHER, _SHORT = 16_384, 64
_SPACE = "▁"


@dataclass(frozen=True)
class Pieces:
    """``tree`` has the pieces by character, from the last to the first: each node is its own branches, the
    score and id of the piece that begins there, and id -1 if none does."""

    tree: dict[str, tuple]
    byte_ids: tuple[int, ...]
    unknown: float
    texts: tuple[bytes, ...]


def _zipf(rank: int, size: int) -> float:
    return -math.log(rank + 2.7) - math.log(math.log(size + 2.7))


def load_pieces(path: str, scores: str = "zipf") -> Pieces:
    """Read a SentencePiece model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [0] * 256
    texts, found = [], {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            text = piece.replace(_SPACE, " ")
            if re.search(r"[^ ] ", text):
                raise ValueError(f"piece {i} goes on behind a word")
            texts.append(text.encode())
            found[text] = (i, model.get_score(i))
    if len(set(byte_ids)) < 256:
        raise ValueError("the vocabulary needs a piece for every byte")
    order = sorted(found, key=lambda text: (-found[text][1], found[text][0]))
    value = {t: _zipf(rank, size) for rank, t in enumerate(order)} if scores == "zipf" else {t: found[t][1] for t in found}
    tree = piece_tree({t: (value[t], i) for t, (i, _) in found.items()})
    return Pieces(tree, tuple(byte_ids), min(value.values()) - 10.0, tuple(texts))


def piece_tree(pieces: dict[str, tuple[float, int]]) -> dict[str, tuple]:
    """The tree of pieces given by text, with score and id."""
    top: dict[str, tuple] = {}
    for text in sorted(pieces, key=len):  # a piece comes before those that it ends
        branches = top
        for character in text[:0:-1]:
            branches = branches.setdefault(character, ({}, 0.0, -1))[0]
        branches[text[0]] = ({}, *pieces[text])
    return top


# --- one lattice ---------------------------------------------------------------


def lattice(pieces: Pieces, text: str) -> tuple[list[list[tuple[int, int, float, int]]], list[float]]:
    """Edges ``(start, end, score, id)`` by their end, and the forward Viterbi score of every position."""
    ending: list[list[tuple[int, int, float, int]]] = [[]]
    best = [0.0]
    for j in range(1, len(text) + 1):
        edges, branches = [], pieces.tree
        for i in range(j - 1, -1, -1):
            node = branches.get(text[i])
            if node is None:
                break
            branches, score, number = node
            if number >= 0:
                edges.append((i, j, score, number))
        if not edges or edges[0][0] < j - 1:  # the character's bytes, as one edge
            edges.append((j - 1, j, pieces.unknown, -1))
        ending.append(edges)
        best.append(max(best[i] + score for i, _, score, _ in edges))
    return ending, best


def _ids(pieces: Pieces, text: str, path: list[tuple[int, int, float, int]]) -> list[int]:
    made: list[int] = []
    for start, end, _, number in path:
        if number >= 0:
            made.append(number)
        else:
            made += _bytes(pieces, text[start:end])
    return made


def _bytes(pieces: Pieces, character: str) -> list[int]:
    return [pieces.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]


def nbest(pieces: Pieces, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations by backward A* search, best first; fewer if there are fewer."""
    if not text:
        return [(0.0, [])]
    ending, best = lattice(pieces, text)
    tie = count()
    # (-score of the best completion, tie, position, score from there to the end, edges from there on)
    heap = [(-best[-1], next(tie), len(text), 0.0, None)]
    found = []
    while heap and len(found) < n:
        cost, _, at, behind, path = heapq.heappop(heap)
        if at == 0:
            edges_on = []
            while path is not None:
                edge, path = path
                edges_on.append(edge)
            found.append((-cost, _ids(pieces, text, edges_on)))
            continue
        for edge in ending[at]:
            score = behind + edge[2]
            heapq.heappush(heap, (-(score + best[edge[0]]), next(tie), edge[0], score, (edge, path)))
    return found


def first_choices(pieces: Pieces, words: list[str]):
    """For each of the sorted words: score and ids of the best segmentation, and how much the second best costs more.

    One forward pass keeps the two best scores of every position and the best one's last edge. What a
    word has in common with the one before it is not done again.
    """
    tree, unknown, before = pieces.tree, pieces.unknown, ""
    best, second, origin, last = [0.0], [-math.inf], [0], [-1]
    for word in words:
        n, k = len(word), 0
        for a, b in zip(before, word):
            if a != b:
                break
            k += 1
        del best[k + 1 :], second[k + 1 :], origin[k + 1 :], last[k + 1 :]
        for j in range(k + 1, n + 1):
            top, after, start, chosen, branches = -math.inf, -math.inf, j - 1, -1, tree
            single = False
            for i in range(j - 1, -1, -1):
                node = branches.get(word[i])
                if node is None:
                    break
                branches, score, number = node
                if number >= 0:
                    single = single or i == j - 1
                    score += best[i]
                    if score > top:
                        other = score - best[i] + second[i]
                        after = top if top > other else other
                        top, start, chosen = score, i, number
                    elif score > after:
                        after = score
            if not single:
                score = best[j - 1] + unknown
                if score > top:
                    after = max(top, second[j - 1] + unknown)
                    top, start, chosen = score, j - 1, -1
                elif score > after:
                    after = score
            best.append(top)
            second.append(after)
            origin.append(start)
            last.append(chosen)
        before, ids, at = word, [], n
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids += _bytes(pieces, word[origin[at] : at])[::-1]
            at = origin[at]
        ids.reverse()
        yield best[n], best[n] - second[n], ids


class Nodes:
    """The tree of pieces as arrays, to walk it for many words at once."""

    def __init__(self, pieces: Pieces):
        keys, child, score, number = [], [], [0.0], [-1]
        todo = [(0, pieces.tree)]
        while todo:
            parent, branches = todo.pop()
            for character, (below, value, piece) in branches.items():
                keys.append(parent << 21 | ord(character))
                child.append(len(score))
                todo.append((len(score), below))
                score.append(value)
                number.append(piece)
        order = np.argsort(keys)
        self.keys, self.child = np.array(keys, np.int64)[order], np.array(child, np.int64)[order]
        self.score, self.number = np.array(score), np.array(number, np.int64)
        self.unknown, self.byte_ids = pieces.unknown, np.array(pieces.byte_ids, np.int32)

    def below(self, node: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The branches of ``node`` by character, and where there is one."""
        wanted = node << 21 | codes
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.child[at], self.keys[at] == wanted


def _character_bytes(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of characters, each row filled up with -1 in front."""
    made = np.full((len(codes), 4), -1, np.int64)
    made[:, 3] = np.where(codes < 0x80, codes, 0x80 | codes & 0x3F)
    for size, first, place in ((2, 0xC0, 2), (3, 0xE0, 1), (4, 0xF0, 0)):
        least = (0x80, 0x800, 0x10000)[size - 2]
        here = codes >= least
        made[here, place] = 0x80 | codes[here] >> 6 * (3 - place) & 0x3F
        last = here & (codes < (0x800, 0x10000, 0x110000)[size - 2])
        made[last, place] = first | codes[last] >> 6 * (3 - place)
    return made


def many_first_choices(nodes: Nodes, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first_choices`` of words of at most ``_SHORT`` characters, side by side: scores, extra costs, numbers of ids, all ids."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")  # at any position, the words that reach it come first
    size = lengths[order]
    n, width = len(words), int(size[0])
    codes = np.zeros((n, width), np.int64)
    text = "".join(words[i] for i in order)
    codes[np.arange(width) < size[:, None]] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.ascontiguousarray(codes.T)
    best, second = np.zeros((width + 1, n)), np.full((width + 1, n), -np.inf)
    origin, last = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
    for j in range(1, width + 1):
        m = int(np.searchsorted(-size, -j, side="right"))
        top, after, start, chosen = best[j], second[j], origin[j], last[j]
        top[:m], start[:m] = -np.inf, j - 1
        single = np.zeros(m, bool)
        word, node = np.arange(m), np.zeros(m, np.int64)
        for i in range(j - 1, -1, -1):
            found, there = nodes.below(node, codes[i, word])
            word, node = word[there], found[there]
            if not len(word):
                break
            piece = nodes.number[node]
            ends = piece >= 0
            w, piece = word[ends], piece[ends]
            if i == j - 1:
                single[w] = True
            score = nodes.score[node[ends]] + best[i, w]
            higher = score > top[w]
            a = w[higher]
            after[a] = np.maximum(top[a], score[higher] - best[i, a] + second[i, a])
            top[a], start[a], chosen[a] = score[higher], i, piece[higher]
            b = w[~higher]
            after[b] = np.maximum(after[b], score[~higher])
        alone = np.flatnonzero(~single)
        score = best[j - 1, alone] + nodes.unknown
        higher = score > top[alone]
        a = alone[higher]
        after[a] = np.maximum(top[a], second[j - 1, a] + nodes.unknown)
        top[a], start[a], chosen[a] = score[higher], j - 1, -1
        b = alone[~higher]
        after[b] = np.maximum(after[b], score[~higher])
    # from the end of each word to its start; characters without a piece give up to four ids
    word, at, step = np.arange(n), size.copy(), 0
    owner, place, ids = [], [], []
    while len(word):
        piece, before = last[at, word], origin[at, word]
        known = piece >= 0
        owner.append(word[known])
        place.append(np.full(int(known.sum()), -4 * step))
        ids.append(piece[known])
        if not known.all():
            data = _character_bytes(codes[at[~known] - 1, word[~known]])
            row, column = np.nonzero(data >= 0)
            owner.append(word[~known][row])
            place.append(column - 3 - 4 * step)
            ids.append(nodes.byte_ids[data[row, column]])
        on = before > 0
        word, at, step = word[on], before[on], step + 1
    owner, place, ids = (np.concatenate(x) for x in (owner, place, ids))
    ids = ids[np.lexsort((place, order[owner]))].astype(np.int32)
    scores, extra = np.empty(n), np.empty(n)
    columns = np.arange(n)
    scores[order], extra[order] = best[size, columns], best[size, columns] - second[size, columns]
    return scores, extra, np.bincount(order[owner], minlength=n), ids


# --- whole texts -----------------------------------------------------------------

_WORD = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def _stands_alone(tree: dict[str, tuple], character: str) -> bool:
    """Whether no longer piece has the character."""
    if tree.get(character, ({},))[0]:
        return False
    todo = [node[0] for node in tree.values()]
    while todo:
        branches = todo.pop()
        if character in branches:
            return False
        todo += [node[0] for node in branches.values()]
    return True


class Encoder:
    """Encodes texts, remembering words. ``words`` splits only where no piece goes across."""

    def __init__(self, pieces: Pieces, n: int = N_BEST):
        self.pieces, self.n, self.nodes = pieces, n, Nodes(pieces)
        self.words = _WORD if _stands_alone(pieces.tree, "\n") else re.compile(r" +[^ ]*|[^ ]+")
        self.forget()
        self.forget_lists()

    def forget(self) -> None:
        """Words have numbers; what is known of them stands in arrays that grow."""
        self.number: dict[str, int] = {}
        # of each word: score, what the second choice costs more
        self.facts = np.zeros((2, 1024))
        # where each word's ids begin among all, and how many there are
        self.places = np.zeros((2, 1024), np.int64)
        self.ids, self.n_ids, self.held = np.zeros(4096, np.int32), 0, 0

    def forget_lists(self) -> None:
        self.lists: dict[str, list] = {}
        self.held_lists = 0

    def learn(self, words: set[str]) -> None:
        short = sorted((w for w in words if len(w) <= _SHORT), key=len)
        for start in range(0, len(short), _TOGETHER):
            part = short[start : start + _TOGETHER]
            self._add(part, *many_first_choices(self.nodes, part))
        long = sorted(w for w in words if len(w) > _SHORT)
        if long:
            score, extra, ids = zip(*first_choices(self.pieces, long))
            self._add(long, np.array(score), np.array(extra), np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], np.int32))

    def _add(self, words: list[str], score: np.ndarray, extra: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        before, after = len(self.number), len(self.number) + len(words)
        while after > self.facts.shape[1]:
            self.facts, self.places = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.facts, self.places))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(self.n_ids + 2 * len(ids), np.int32)])
        self.facts[:, before:after] = score, extra
        self.places[:, before:after] = self.n_ids + np.cumsum(counts) - counts, counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        self.number.update(zip(words, range(before, after)))
        # an entry of the table of words and its number take some 130 bytes, the arrays twice what they hold
        self.held += sum(map(sys.getsizeof, words)) + 200 * len(words) + 8 * len(ids)

    def encode_all(self, texts: list[str | None]):
        """``encode`` for every text, in order; the new words of texts that follow each other are learned together."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < _GROUP):
                text = texts[at]
                group.append(self.words.findall(" " + text) if text else None if text is None else [])
                size += len(text or "")
                at += 1
            if self.held >= _HELD_BYTES:
                self.forget()
            if self.held_lists >= _LIST_BYTES:
                self.forget_lists()
            self.learn(set().union(*(words for words in group if words)).difference(self.number))
            for words in group:
                yield (b"", []) if words is None else self._encoded(words)

    def encode(self, text: str) -> tuple[bytes, list[dict]]:
        """The best ids as 32-bit numbers, and the N best as edits of them."""
        return next(iter(self.encode_all([text])))

    def _encoded(self, words: list[str]) -> tuple[bytes, list[dict]]:
        if not words:
            return b"", [{"score": 0.0, "edits": []}]
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        score, extra = self.facts[:, number]
        start, length = self.places[:, number]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(start - ends + length, length) + np.arange(ends[-1])].tobytes()
        chosen = self._cheapest(extra)
        total = float(score.sum())
        made = []
        for cost, choices in self._combined([words[p] for p in chosen]):
            edits = []
            for place, choice in zip(chosen, choices):
                if choice:
                    edits.append({"at": int(length[:place].sum()), "removed": int(length[place]),
                                  "ids": self.lists[words[place]][choice][1]})
            made.append({"score": total - cost, "edits": edits})
        return ids, made

    def _cheapest(self, extra: np.ndarray) -> list[int]:
        """The N - 1 places whose second choice costs least, in order of place; places without one left out."""
        least = min(self.n - 1, len(extra))
        if not least:
            return []
        bound = np.partition(extra, least - 1)[least - 1]
        below = np.flatnonzero(extra < bound)
        order = np.concatenate([below, np.flatnonzero(extra == bound)[: least - len(below)]])
        return sorted(int(i) for i in order if extra[i] < math.inf)

    def _combined(self, words: list[str]):
        """The N cheapest ``(extra cost, choice for each word)``, cheapest first."""
        for word in words:
            if word not in self.lists:
                start, length = self.places[:, self.number[word]]
                chosen = self.ids[start : start + length].tolist()
                found = nbest(self.pieces, word, self.n)
                # of equal scores, the one that was chosen comes first
                self.lists[word] = [(found[0][0], chosen), *(f for f in found if f[1] != chosen)][: self.n]
                self.held_lists += sys.getsizeof(word) + 200 + sum(200 + 40 * len(f[1]) for f in found)
        costs = [[self.lists[w][0][0] - score for score, _ in self.lists[w]] for w in words]
        start = (0,) * len(words)
        heap, seen, found = [(0.0, start)], {start}, []
        while heap and len(found) < self.n:
            cost, choices = heapq.heappop(heap)
            found.append((cost, choices))
            for k, choice in enumerate(choices):
                after = (*choices[:k], choice + 1, *choices[k + 1 :])
                if choice + 1 < len(costs[k]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (cost + costs[k][choice + 1] - costs[k][choice], after))
        return found


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The text that ``ids`` stand for."""
    return b"".join(map(pieces.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def apply_edits(ids: list[int], edits: list[dict]) -> list[int]:
    """Another of the N best, from the best and its edits."""
    made = list(ids)
    for edit in sorted(edits, key=lambda e: -e["at"]):
        made[edit["at"] : edit["at"] + edit["removed"]] = edit["ids"]
    return made


_ENCODED = ("struct<ids: array<int>, nbest: array<struct<score: double, edits: array<struct<at: int, removed: int, "
            "ids: array<int>>>>>>")
_EDITS = pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", _EDITS)]))


def _encode(lattice, pieces, n: int):
    """Encodes; with ``pieces`` also decodes and compares, in the same worker, so that ids need not travel."""

    def make():
        encoder = Encoder(Pieces(*lattice.value), n)
        decoded = _decoder(pieces.value) if pieces is not None else None

        def encoded(texts: pa.Array) -> pa.StructArray:
            ids, choices = [], []
            for made, best in encoder.encode_all([data if data is None else data.decode() for data in texts.to_pylist()]):
                ids.append(made)
                choices.append(best)
            # texts that are null get a null list
            ends = [0, *accumulate(len(x) // 4 for x in ids)]
            here = [*texts.is_valid().to_pylist(), True]
            offsets = pa.array([end if valid else None for end, valid in zip(ends, here)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
            columns = {"ids": lists, "nbest": pa.array(choices, _NBEST)}
            if decoded is not None:
                back = decoded(lists).cast(pa.binary())
                columns["decodes"] = pc.if_else(texts.is_valid(), pc.fill_null(pc.equal(back, texts.cast(pa.binary())), False), back.is_null())
            return pa.StructArray.from_arrays(list(columns.values()), list(columns))

        def work(texts: pa.Array) -> pa.Array:
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            made, at = [], 0
            while at < len(texts) or not made:
                held = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, held + _SLICE, side="right")))
                made.append(encoded(texts.slice(at, end - at)))
                at = end
            return pa.concat_arrays(made)

        return work

    return array_function(make, _ENCODED if pieces is None else _ENCODED[:-1] + ", decodes: boolean>")


def _decoder(pieces: list[bytes]):
    table = pa.array(pieces, pa.large_binary())

    def decoded(lists: pa.Array) -> pa.Array:
        # all ids of the batch become bytes at once; a text's are those between its first and last piece
        flat = lists.flatten()
        data = table.take(flat)
        ends = np.frombuffer(data.buffers()[1], np.int64, len(flat) + 1, 8 * data.offset) if len(flat) else np.zeros(1, np.int64)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        places = ends[np.concatenate([[0], np.cumsum(lengths)])]
        held = np.frombuffer(data.buffers()[2] or b"", np.uint8)[: places[-1]]
        # without the space that encoding puts in front
        fronts = places[:-1][np.diff(places) > 0]
        places = places - np.concatenate([[0], np.cumsum(np.diff(places) > 0)])
        buffers = [None, pa.py_buffer(np.ascontiguousarray(places)), pa.py_buffer(np.delete(held, fronts))]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), buffers)
        texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.large_binary()))
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # ids that were no text before
            return pa.array([x if x is None else x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())

    return decoded


def _decode(pieces):
    return array_function(lambda: _decoder(pieces.value), "string")


@dataclass(frozen=True)
class SharedPieces:
    """The vocabulary as broadcasts, some MB, bounded by the file: the lattice for encoding, the pieces' bytes for decoding."""

    lattice: object
    texts: object


def shared_pieces(spark: SparkSession, path: str, scores: str = "zipf") -> SharedPieces:
    pieces = load_pieces(path, scores)
    context = spark.sparkContext
    return SharedPieces(context.broadcast(parts(pieces)), context.broadcast(list(pieces.texts)))


def encode(docs: DataFrame, shared: SharedPieces, n: int = N_BEST, name: str = "encoded", checked: bool = False) -> DataFrame:
    """``docs`` with the struct ``name``: the best ``ids``, and ``nbest`` as scores and edits of them; no shuffle.

    ``checked`` adds ``decodes`` to the struct: whether decoding the ids gives the text back.
    """
    return docs.withColumn(name, _encode(shared.lattice, shared.texts if checked else None, n)(utf8("text")))


def decode(rows: DataFrame, shared: SharedPieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids`` stand for; a null list gives null."""
    return rows.withColumn(text, _decode(shared.texts)(F.col(ids)))
