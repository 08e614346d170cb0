"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the piece lattice.

The vocabulary is read from a SentencePiece model file. A text's lattice holds every way to cut it into pieces; a piece's
weight is ``-theta * log(rank + SHIFT)``, its rank being the model's merge order, and characters outside the vocabulary
are spelled with byte pieces. A segmentation's probability is its weight over that of all segmentations of the text.

``k`` segmentations are drawn without replacement by top-down A* search with Gumbel noise: the root's perturbed
log-probability is a Gumbel variate, the children of a node get variates that are conditioned on their maximum being the
node's own, and nodes are expanded best first. The complete segmentations come out in the order of their perturbed
log-probabilities, which is a sample without replacement. A child is settled by its path's continuation, so expanding a
node walks one full path and settles its side branches: those of the first ``NEAR`` steps one by one, all later ones by
the variate of their maximum, which is split up over them only if it can still win. The inclusion score is log(1 - exp(-exp(log p - kappa))), kappa being the perturbed
log-probability of the best segmentation that was not drawn (0 if all were drawn).

All random numbers are hashes of the row key, the draw and the place in the text: the same row gives the same samples
anywhere. As in the model, a text gets a leading mark and spaces become marks. Words are cut before each run of marks and
around line breaks, where no piece of the vocabulary runs over (one that does raises an error), so a text's lattice is the
product of its words' lattices, and equal words share one. A word's lattice goes over its whole length, however long.

A null text gives no segmentation, an empty text one of no pieces; a text with fewer than k segmentations gives all of
them. Equal keys and texts give equal samples; a null key counts as a key of its own.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, table
from intel_spark.llm.shingles import mix

MODEL = "piece_bpe_32k.model"
K = 2
THETA = 1.0
SHIFT = 10.0
BLOCK = 200_000  # code points taken together
CACHED = 1_200_000  # edges of the lattices that a task keeps from one block to the next
CHUNK = 1 << 15  # code points of new words worked on at once
NEAR = 48
MARK = 0x2581
_HASH = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _SPREAD))


def model_path(name: str = MODEL) -> str:
    """Where a vocabulary file lies: a path as it is, a bare name in the installed collection."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces of a model as code points, their weights, and what they decode to.

    The table holds every beginning of a piece, so that a search along a text ends where no piece goes on; beginnings that
    are no piece have weight -inf.
    """

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        begins, whole, ids, weights, decoded = array("Q"), array("Q"), array("i"), array("d"), []
        self.byte_ids = np.zeros(256, np.int32)
        self.longest = 1
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                decoded.append(b"")
            else:
                decoded.append(piece.replace("▁", " ").encode())
                if "▁" in piece.lstrip("▁") or (len(piece) > 1 and "\n" in piece):
                    raise ValueError(f"the piece {piece!r} runs over the border of a word")
                self.longest = max(self.longest, len(piece))
                hashes = prefix_hashes(piece)
                begins.extend(hashes)
                whole.append(hashes[-1])
                ids.append(i)
                weights.append(-theta * np.log(max(0.0, -model.get_score(i)) + SHIFT))
        self.keys = np.unique(np.frombuffer(begins, np.uint64))
        self.ids = np.full(len(self.keys), -1, np.int32)
        self.weights = np.full(len(self.keys), -np.inf)
        at = np.searchsorted(self.keys, np.frombuffer(whole, np.uint64))
        self.ids[at], self.weights[at] = np.frombuffer(ids, np.int32), np.frombuffer(weights, np.float64)
        self.byte_weight = -theta * np.log(n + SHIFT)
        bucket = (self.keys >> np.uint64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)  # a bucket's only key, -1 for none, -2 for several
        self.slot[bucket] = np.arange(len(bucket))
        self.slot[bucket[1:][bucket[1:] == bucket[:-1]]] = -2
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(d) for d in decoded])])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the table, and their slots."""
        slot = self.slot[(keys >> np.uint64(44)).astype(np.int64)]
        hit = np.flatnonzero(slot != -1)
        slot, own = slot[hit], keys[hit]
        several = np.flatnonzero(slot == -2)
        slot[several] = np.minimum(np.searchsorted(self.keys, own[several]), len(self.keys) - 1)
        same = self.keys[slot] == own
        return hit[same], slot[same]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a run of pieces, without the leading mark's space."""
        size = (self.bounds[1:] - self.bounds[:-1])[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return b""
        places = np.repeat(self.bounds[:-1][ids] - (ends - size), size) + np.arange(ends[-1])
        out = self.bytes[places].tobytes()
        return out[1:] if out[:1] == b" " else out


def prefix_hashes(piece: str) -> list[int]:
    """Hashes of a piece's beginnings, the whole of it last."""
    value, out, mask = 0, [], (1 << 64) - 1
    for c in piece:
        value = (value * int(_SPREAD) + ord(c) + 1) & mask
        out.append(value * int(_HASH) & mask)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Vocabulary:
    return Vocabulary(path, theta)


class Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.room, self.size = np.empty(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            room = np.empty(max(need, len(self.room) * 5 // 4), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : need] = values
        self.size = need


class Lattices:
    """Lattices of the different words met: nodes in text order, each with its edges' conditional probabilities.

    A node's edges run from the longest piece to the shortest; ``share`` is the cumulative probability up to an edge.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._first, self._edges_at = Grown(np.int32), Grown(np.int32)  # first node of a word, first edge of a node
        self._final = Grown(bool)
        self._share, self._log_p = Grown(np.float64), Grown(np.float64)
        self._source, self._target, self._piece = Grown(np.int32), Grown(np.int32), Grown(np.int32)  # piece id, or -1 - code point
        self.clear()

    def clear(self) -> None:
        """Forget all words; the arrays' room is used again."""
        self.known: dict[int, int] = {}
        for grown in (self._first, self._edges_at, self._final, self._share, self._log_p, self._source, self._target, self._piece):
            grown.size = 0
        self._edges_at.add(np.zeros(1, np.int32))
        self._views()

    def _views(self) -> None:
        self.first, self.edges_at, self.final = self._first.room, self._edges_at.room, self._final.room
        self.share, self.log_p = self._share.room, self._log_p.room
        self.source, self.target, self.piece = self._source.room, self._target.room, self._piece.room

    def words(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Word numbers of different words given as slices of ``points``; unknown ones are added."""
        if self._share.size > CACHED:
            self.clear()
        numbers = np.array([self.known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            new = new[np.argsort(ends[new] - starts[new], kind="stable")]  # short words together
            numbers[new] = self._first.size + np.arange(len(new))
            self.known.update(zip(keys[new].tolist(), numbers[new].tolist()))
            chunk = np.cumsum(ends[new] - starts[new]) // CHUNK
            for own in np.split(new, np.flatnonzero(np.diff(chunk)) + 1):
                self._add(points, starts[own], ends[own])
            self._views()
        return numbers

    def _add(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        length = ends - starts
        word = np.repeat(np.arange(len(starts)), length)
        begin = np.cumsum(length) - length
        place = np.arange(len(word)) - begin[word]
        left = length[word] - place
        node = np.arange(len(word)) + word  # a word of n characters has n + 1 nodes
        text = points[starts[word] + place].astype(np.uint64) if len(starts) > 1 else points[starts[0] : ends[0]].astype(np.uint64)
        # log-sum of the completions of every node, from the words' ends backwards
        beta = np.zeros(len(text) + len(starts))
        parts = []
        for hi in range(len(text), 0, -CHUNK):  # more than one stretch only in a word that is longer than that
            lo = max(0, hi - CHUNK)
            weight, slots = self._weights(text[lo : hi + self.vocab.longest], left[lo:hi])
            self._completions(beta, weight, left[lo:hi], node[lo:hi])
            at, row = np.nonzero(weight > -np.inf)
            source = node[lo:hi][at]
            parts.append((source, source + weight.shape[1] - row, weight[at, row], slots[at, row]))
        source, target, weight, piece = (np.concatenate(x[::-1]) for x in zip(*parts))
        log_p = weight + beta[target] - beta[source]
        counts = np.bincount(source, minlength=len(beta))
        ends_at = np.cumsum(counts)
        running = np.cumsum(np.exp(log_p))
        before = ends_at - counts
        share = running - np.where(before > 0, running[before - 1], 0.0)[source]
        share[ends_at[counts > 0] - 1] = 1.0
        nodes, edges = self._final.size, self._share.size
        final = np.zeros(len(beta), bool)
        final[begin + length + np.arange(len(starts))] = True
        self._first.add(begin + np.arange(len(starts)) + nodes)
        self._edges_at.add(ends_at + edges)
        self._final.add(final)
        self._share.add(share)
        self._log_p.add(log_p)
        self._source.add(source + nodes)
        self._target.add(target + nodes)
        self._piece.add(piece)

    def _weights(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and ids of the pieces that begin at the places of ``left``, by piece length, the longest first."""
        vocab, found, rows = self.vocab, [], 1
        at, value = np.arange(len(left)), np.zeros(len(left), np.uint64)
        for n in range(1, int(min(vocab.longest, left.max())) + 1):
            if n > 1:
                keep = np.flatnonzero(left[at] >= n)
                at, value = at[keep], value[keep]
            value = value * _SPREAD + text[at + (n - 1)] + np.uint64(1)
            hit, slot = vocab.find(value * _HASH)
            at, value = at[hit], value[hit]
            whole = np.flatnonzero(vocab.ids[slot] >= 0)
            if len(whole):
                found.append((n, at[whole], slot[whole]))
                rows = n
            if not len(at):
                break
        weight = np.full((len(left), rows), -np.inf)
        slots = np.zeros((len(left), rows), np.int32)
        for n, where, slot in found:
            weight[where, rows - n] = vocab.weights[slot]
            slots[where, rows - n] = vocab.ids[slot]
        by_bytes = np.flatnonzero(np.isinf(weight[:, -1]))
        code = text[by_bytes].astype(np.int64)
        weight[by_bytes, -1] = vocab.byte_weight * utf8_size(code)
        slots[by_bytes, -1] = -1 - code
        return weight, slots

    @staticmethod
    def _completions(beta: np.ndarray, weight: np.ndarray, left: np.ndarray, node: np.ndarray) -> None:
        """Fill ``beta`` at ``node``, nearest to the words' ends first."""
        rows = weight.shape[1]
        order = np.argsort(left, kind="stable")
        bounds = np.flatnonzero(np.diff(left[order], prepend=-1, append=-1))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = order[lo:hi]
            reach = int(min(rows, left[own[0]]))
            score = weight[own, rows - reach :] + beta[node[own][:, None] + np.arange(reach, 0, -1)]
            top = score.max(axis=1)
            beta[node[own]] = top + np.log(np.exp(score - top[:, None]).sum(axis=1))


def utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def uniform(*parts: int) -> float:
    """A number in (0, 1) from integers, the same everywhere."""
    value, mask = 0, (1 << 64) - 1
    for part in parts:
        value = ((value ^ part) + int(_HASH)) & mask
        value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & mask
        value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & mask
        value ^= value >> 31
    return ((value >> 11) + 0.5) * 2.0**-53


def cut_words(points: np.ndarray) -> np.ndarray:
    """Starts of the words of a marked text."""
    marks, breaks = points == MARK, points == 0x0A
    first = marks | breaks
    first[1:] &= ~(marks[:-1] & marks[1:])
    first[1:] |= breaks[:-1]
    first[:1] = True
    return np.flatnonzero(first)


class Sampler:
    """Draws the segmentations of texts, a block of texts at a time."""

    def __init__(self, path: str, k: int, theta: float):
        self.vocab = vocabulary(path, theta)
        self.lattices = Lattices(self.vocab)
        self.k = k

    def paths(self, words: np.ndarray, keys: np.ndarray, places: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """One random path through each word's lattice: all edges in text order, and each word's first edge."""
        net = self.lattices
        seed = mix(keys ^ mix(np.full(1, draw + 1, np.uint64) * _HASH)) + places.astype(np.uint64) * _SPREAD
        node, active = net.first[words].astype(np.int64), np.arange(len(words))
        steps, counts = [], np.zeros(len(words), np.int64)
        while len(active):
            value = mix(seed + np.full(1, (len(steps) + 1) * int(_HASH) & ((1 << 64) - 1), np.uint64))
            u = ((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            edge = net.edges_at[node].astype(np.int64)
            more = np.flatnonzero(u > net.share[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > net.share[edge[more]]]
            steps.append((active, edge))
            counts[active] += 1
            node = net.target[edge]
            open_ = np.flatnonzero(~net.final[node])
            active, seed, node = active[open_], seed[open_], node[open_]
        first = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        taken = np.zeros(first[-1], np.int64)
        for i, (active, edge) in enumerate(steps):
            taken[first[active] + i] = edge
        return taken, first

    def branches(self, own: np.ndarray, at: int, log_at: np.ndarray, top: float, seed: np.ndarray, cap: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(perturbed value, step, edge) of the side branches of the steps ``own``.

        ``at`` is the first step's place in its path, ``log_at`` the log-probability of the path before each step, ``top``
        the path's own value, and ``cap`` the branches' maximum if it has been drawn.
        """
        net = self.lattices
        source = net.source[own]
        first = net.edges_at[source]
        count = net.edges_at[source + 1] - first
        step = np.repeat(np.arange(len(own)), count)
        edge = np.arange(len(step)) + np.repeat(first - np.cumsum(count) + count, count)
        other = np.flatnonzero(edge != own[step])
        step, edge = step[other], edge[other]
        phi = log_at[step] + net.log_p[edge]
        value = mix(seed ^ ((step + at).astype(np.uint64) << np.uint64(8)) ^ (edge - first[step]).astype(np.uint64))
        noise = -np.log(((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        if cap is None:  # Gumbel variates at phi, below top
            return phi - np.log(np.exp(np.minimum(phi - top, 700.0)) + noise), step + at, edge
        free = phi - np.log(noise)
        with np.errstate(over="ignore", divide="ignore"):
            tied = -np.log(np.maximum(np.exp(-cap) - np.exp(-free.max()) + np.exp(-free), 0.0)) if len(free) else free
        if len(free):
            tied = np.minimum(tied, cap)
            tied[np.argmax(free)] = cap
        return tied, step + at, edge

    def finish(self, node: int, key: int, draw: int, step: int) -> list[int]:
        """The rest of a word's path from a node."""
        net, out = self.lattices, []
        while not net.final[node]:
            u = uniform(key, 0xF1A1 + draw, step + len(out))
            edge = int(net.edges_at[node])
            while u > net.share[edge]:
                edge += 1
            out.append(edge)
            node = int(net.target[edge])
        return out

    def draws(self, words: np.ndarray, doc_at: np.ndarray, keys: np.ndarray) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text its (edges, log p, perturbed value) in order, and last (None, 0, kappa)."""
        counts = np.diff(doc_at)
        owner_key = np.repeat(keys, counts)
        places = np.arange(len(words)) - np.repeat(doc_at[:-1], counts)
        fresh = []
        for draw in range(self.k):
            fresh.append(self.paths(words, owner_key, places, draw))
        return [self._search(d, doc_at, int(keys[d]), fresh) for d in range(len(keys))]

    def _search(self, d: int, doc_at: np.ndarray, key: int, fresh) -> list[tuple[np.ndarray | None, float, float]]:
        net, out, heap = self.lattices, [], []
        lo, hi = int(doc_at[d]), int(doc_at[d + 1])
        top = float(-np.log(-np.log(uniform(key, 0x6007))))
        paths = []  # (edges, first edge of each word)
        entry = (top, None, 0, 0)
        for draw in range(self.k):
            top, origin, step, edge = entry
            edges, first = fresh[draw]
            own, heads = edges[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]
            if origin is not None:
                old, old_heads = paths[origin]
                word = int(np.searchsorted(old_heads, step, "right")) - 1
                head = np.concatenate([old[:step], [edge], self.finish(int(net.target[edge]), key, draw, step)]).astype(np.int64)
                shift = len(head) - int(heads[word + 1])
                own = np.concatenate([head, own[heads[word + 1] :]])
                heads = np.concatenate([old_heads[: word + 1], heads[word + 1 :] + shift])
            paths.append((own, heads))
            total = np.concatenate([[0.0], np.cumsum(net.log_p[own])])
            out.append((own, float(total[-1]), top))
            wanted = self.k - draw  # as many branches as can still be drawn, and one for kappa
            heap = heapq.nsmallest(wanted, heap)
            seed = mix(np.array([key], np.uint64) + np.array([draw + 1], np.uint64) * _SPREAD)
            at = step + 1 if origin is not None else 0
            heap = self._kept(heap, wanted, draw, self.branches(own[at : at + NEAR], at, total[at:], top, seed, None))
            at += NEAR
            if at < len(own) and total[-1] < total[at]:  # the maximum of all later branches
                mass = float(total[at] + np.log(-np.expm1(total[-1] - total[at])))
                noise = -float(np.log(uniform(key, 0x4E57 + draw)))
                cap = mass - float(np.log(np.exp(min(mass - top, 700.0)) + noise))
                if len(heap) < wanted or cap > -heap[-1][0]:
                    heap = self._kept(heap, wanted, draw, self.branches(own[at:], at, total[at:], top, seed, cap))
            if not heap:
                return out + [(None, 0.0, -np.inf)]
            value, origin, step, edge = heap.pop(0)
            entry = (-value, origin, step, edge)
        return out + [(None, 0.0, entry[0])]

    @staticmethod
    def _kept(heap: list, wanted: int, draw: int, found) -> list:
        """The best entries of a list and of newly found branches, in order."""
        value, place, branch = found
        best = np.argsort(-value)[:wanted] if len(value) > wanted else range(len(value))
        return heapq.nsmallest(wanted, heap + [(-float(value[i]), draw, int(place[i]), int(branch[i])) for i in best])

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; spelled characters become byte pieces."""
        piece = self.lattices.piece[edges].astype(np.int32)
        spelled = np.flatnonzero(piece < 0)
        if not len(spelled):
            return piece
        code = -1 - piece[spelled].astype(np.int64)
        bytes_ = utf8_size(code)
        size = np.ones(len(piece), np.int64)
        size[spelled] = bytes_
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        out[at] = piece
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):  # the bytes of UTF-8
            own = np.flatnonzero(bytes_ == n)
            for j in range(n if len(own) else 0):
                byte = (code[own] >> (6 * (n - 1 - j))) & 0x3F | 0x80 if j else code[own] >> (6 * (n - 1)) | lead
                out[at[spelled[own]] + j] = self.vocab.byte_ids[byte]
        return out

    def encode(self, texts: list[str], keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
        """(text number, sample number, ids, log p, inclusion score) of a block of texts."""
        points, doc_words, starts, ends = [], [0], [], []
        offset = 0
        for text in texts:
            own = np.frombuffer(("▁" + text.replace(" ", "▁") if text else "").encode("utf-32-le", "surrogatepass"), np.uint32)
            cut = cut_words(own)
            points.append(own)
            starts.append(cut + offset)
            ends.append(np.concatenate([cut[1:], [len(own)]])[: len(cut)] + offset)
            offset += len(own)
            doc_words.append(doc_words[-1] + len(cut))
        points = np.concatenate(points) if points else np.zeros(0, np.uint32)
        starts, ends = np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)
        if len(starts):
            sizes = ends - starts
            powers = _powers(1 << int(sizes.max()).bit_length())
            terms = mix(points.astype(np.uint64) + _HASH) * powers[np.arange(len(points)) - np.repeat(starts, sizes)]
            keys_of = mix(np.add.reduceat(terms, starts) ^ sizes.astype(np.uint64))
            different, first, which = np.unique(keys_of, return_index=True, return_inverse=True)
            words = self.lattices.words(different, points, starts[first], ends[first])[which]
        else:
            words = np.zeros(0, np.int64)
        for number, samples in enumerate(self.draws(words, np.array(doc_words), keys)):
            kappa = samples[-1][2]
            for rank, (edges, log_p, _) in enumerate(samples[:-1]):
                x = log_p - kappa
                score = 0.0 if np.isinf(kappa) else float(np.log(-np.expm1(-np.exp(min(x, 50.0))))) if x > -30 else x
                yield number, rank, self.ids(edges), log_p, score


def row_keys(key: pa.Array, seed: int) -> np.ndarray:
    """Random keys of the rows: the hash of a row's key and the seed."""
    values = np.array([0x0D15EA5E if v is None else int(v) & ((1 << 64) - 1) for v in key.to_pylist()], np.uint64)
    return mix(values ^ mix(np.array([seed], np.uint64))[0])


def sample_encode(docs: DataFrame, key: str = "doc_id", k: int = K, seed: int = 7, theta: float = THETA, model: str = MODEL) -> DataFrame:
    """(key, sample, ids, log_prob, inclusion, intact) for up to ``k`` distinct segmentations of every text.

    ``key`` names an integer column; ``intact`` tells whether the ids decode to the text, byte for byte.
    """
    path = model_path(model)

    def run(batches):
        sampler = Sampler(path, k, theta)
        for batch in batches:
            texts, row = batch.column("text"), 0
            keys = row_keys(batch.column("key"), seed)
            lengths = [0 if x is None else x for x in pc.utf8_length(texts).to_pylist()]
            while row < len(texts):
                end, total = row + 1, lengths[row]
                while end < len(texts) and total + lengths[end] <= BLOCK:
                    total += lengths[end]
                    end += 1
                rows = [i for i in range(row, end) if texts[i].is_valid]
                own = [texts[i].as_py() for i in rows]
                found = list(sampler.encode(own, keys[rows])) if rows else []
                if found:
                    intact = [sampler.vocab.decode(ids) == own[n].encode("utf-8", "surrogatepass") for n, _, ids, _, _ in found]
                    flat = np.concatenate([f[2] for f in found])
                    bounds = np.concatenate([[0], np.cumsum([len(f[2]) for f in found])]).astype(np.int32)
                    yield pa.record_batch([
                        batch.column("key").take(pa.array([rows[f[0]] for f in found])), pa.array([f[1] for f in found], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32())),
                        pa.array([f[3] for f in found]), pa.array([f[4] for f in found]), pa.array(intact),
                    ], ["key", "sample", "ids", "log_prob", "inclusion", "intact"])
                row = end

    source = docs.select(F.col(key).cast("long").alias("key"), "text")
    return source.mapInArrow(run, "key long, sample int, ids array<int>, log_prob double, inclusion double, intact boolean").withColumnRenamed("key", key)


def decode_pieces(encoded: DataFrame, column: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its piece ids; null ids give null, and bytes that are no UTF-8 become U+FFFD."""
    path = model_path(model)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        vocab = vocabulary(path, THETA)
        return pa.array([None if not v.is_valid else vocab.decode(np.asarray(v.values, np.int64)).decode("utf-8", "replace") for v in ids], pa.string())

    return encoded.withColumn(name, text(F.col(column)))


def piece_digests(docs: DataFrame) -> DataFrame:
    """One row per sampled segmentation, its ids as their number and a hash."""
    out = sample_encode(docs.select("doc_id", "text"))
    return out.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", "intact")


@query("op2_sentencepiece_sampling")
def op2(spark, sf_dir):
    return piece_digests(table(spark, sf_dir, "documents"))
