"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is a lattice: positions between bytes, and an edge for every piece of the vocabulary that stands
there; characters without a piece of their own are spelled by byte pieces. A word starts at the first of a
run of blanks. No piece has a blank behind another character, so none reaches over the start of a word (a
vocabulary with such a piece is refused), the lattice of a text is a chain of word lattices, and a task
keeps those of the words that it has met, up to a limit; then words met in one slice of text only go first. The vocabulary is a merge list, so an edge weighs a power of its rank, ``(rank + 2) **
-POWER``, and a segmentation the product of its edges.

Sums over all ways to the end of a word give each edge its probability. Sampling is a search for the
largest Gumbel-perturbed log-probabilities, from the top: the best leaf of a set of segmentations is drawn
first; what is left of the set falls into parts (equal up to one edge, another edge there, free beyond),
each with the perturbed score of its best leaf, drawn below that of the set. The part with the highest
score is opened next, so segmentations come out distinct and in the order of their scores. The score of the
part that would follow is the threshold that gives inclusion probabilities.

Random numbers depend on the seed and the row key only, never on the partitioning. Null and empty texts
have one segmentation without pieces. A text with fewer than k segmentations gives them all, with
inclusion probability 1. Repeated rows give equal samples. An empty table gives an empty result; extra
columns are left out. The sign that the vocabulary writes for a blank counts as a blank.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.grams import Words, _byte_codes, _powers, mix
from utterlake.llm.packing import _slices
from utterlake.llm.tables import lean, read

K = 2
POWER = 1.0
SEED = 20
BLANK = "▁"
SLICE_CHARS = 200_000
#: Ids that are decoded at once.
DECODED_IDS = 300_000
#: Bytes of distinct words whose lattices a task keeps.
KEPT_BYTES = 400_000
KEPT_FREE = 30_000_000


class Pieces:
    """Pieces of a model as bytes, blanks written as blanks; hashes of pieces and of their beginnings by length."""

    def __init__(self, path: str, power: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        texts, ids = [], []
        for n in range(size):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                value = int(piece[3:-1], 16)
                self.bytes[n], self.byte_id[value] = bytes([value]), n
            elif not (model.is_control(n) or model.is_unknown(n)):
                self.bytes[n] = piece.replace(BLANK, " ").encode()
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {n} has a blank behind another character: {piece!r}")
                texts.append(self.bytes[n])
                ids.append(n)
        rank = np.array([max(0.0, -model.get_score(n)) for n in range(size)])
        self.weight = -power * np.log(rank + 2)
        self.weight[self.byte_id] = -power * np.log(size + 2)
        longest = max(map(len, texts))
        self.codes = _byte_codes(False)
        self.codes[[9, 10, 11, 12, 13, 32]] = mix(np.arange(301, 307, dtype=np.uint64)) | np.uint64(1)
        self.powers = _powers(0x2545F4914F6CDD1D, longest + 1)
        #: For each length the hashes of pieces' beginnings, and the piece that has just this length or -1.
        self.begin: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint64), np.full(1, -1))]
        hashes = [np.cumsum(self.codes[np.frombuffer(t, np.uint8)] * self.powers[: len(t)], dtype=np.uint64) for t in texts]
        for length in range(1, longest + 1):
            found = np.unique(np.array([h[length - 1] for h in hashes if len(h) >= length], np.uint64))
            whole = np.full(len(found), -1)
            own = [(h[-1], n) for h, n in zip(hashes, ids, strict=True) if len(h) == length]
            whole[np.searchsorted(found, np.array([h for h, _ in own], np.uint64))] = [n for _, n in own]
            self.begin.append((found, whole))
        #: For each length where a hash's first bits point to: its place in ``begin``, -1 without one, -2 with several.
        self.slots: list[tuple[np.uint64, np.ndarray]] = []
        for found, _ in self.begin:
            bits = (8 * len(found)).bit_length()
            slot = (found >> np.uint64(64 - bits)).astype(np.int64)
            places = np.full(1 << bits, -1, np.int32)
            places[slot] = np.arange(len(found))
            places[np.flatnonzero(np.bincount(slot, minlength=1 << bits) > 1)] = -2
            self.slots.append((np.uint64(64 - bits), places))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])]).astype(np.int64)


    def places(self, length: int, hashed: np.ndarray) -> np.ndarray:
        """Where the hashes of beginnings of this length stand in ``begin``; any place for those that do not."""
        shift, slots = self.slots[length]
        where = slots[(hashed >> shift).astype(np.int64)]
        several = np.flatnonzero(where == -2)
        if len(several):
            where[several] = np.searchsorted(self.begin[length][0], hashed[several])
        return np.clip(where, 0, len(self.begin[length][0]) - 1)


@lru_cache(maxsize=2)
def load_pieces(path: str, power: float = POWER) -> Pieces:
    return Pieces(path, power)


class Lattice:
    """Lattices of distinct words, one after the other in ``data``; word i is bytes ``at[i]`` to ``at[i + 1]``.

    Node ``at[i] + j + i`` lies before byte j of word i, so that each word has a node at its end. Edges are
    sorted by their node, whose first one is ``first[node]``: ``to``, ``piece``, ``log`` (of the probability among the edges of a node), ``rest``
    (the probability of the node's other edges), ``key`` (node plus the probability up to and with the edge, without a bound for a node's last edge).
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, at: np.ndarray) -> None:
        size = np.diff(at)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data))
        left = at[1:][word] - place
        letter = (data & 0xC0) != 0x80
        src, length, piece = [], [], []
        alive, hashed = np.flatnonzero(letter), np.zeros(int(letter.sum()), np.uint64)
        heads = np.append(np.flatnonzero(letter), len(data))
        chars = np.zeros(len(data), np.int64)
        chars[heads[:-1]] = np.diff(heads)
        single = np.zeros(len(data), bool)
        ends = np.append(letter, True)
        for n in range(1, len(pieces.begin)):
            ok = left[alive] >= n
            alive, hashed = alive[ok], hashed[ok]
            if not len(alive):
                break
            hashed = hashed + pieces.codes[data[alive + n - 1]] * pieces.powers[n - 1]
            table, ids = pieces.begin[n]
            where = pieces.places(n, hashed)
            known = table[where] == hashed
            hit = known & (ids[where] >= 0) & ends[alive + n]
            src.append(alive[hit])
            length.append(np.full(int(hit.sum()), n))
            piece.append(ids[where[hit]])
            if n <= 4:
                one = alive[hit]
                single[one[chars[one] == n]] = True
            alive, hashed = alive[known], hashed[known]
        # Characters without a piece of their own: one edge for each of their bytes.
        head = np.maximum.accumulate(np.where(letter, place, 0)) if len(data) else place
        spelled = np.flatnonzero(~single[head]) if len(data) else place
        src.append(spelled)
        length.append(np.ones(len(spelled), np.int64))
        piece.append(pieces.byte_id[data[spelled]])
        # Each group holds a place once, so edges go straight to their place's stretch.
        held = np.zeros(len(data) + 1, np.int64)
        for group in src:
            held[group + 1] += 1
        free = np.cumsum(held)[:-1]
        first = free.copy()
        s, n, p = (np.empty(int(held.sum()), np.int64) for _ in range(3))
        for group, size_, names in zip(src, length, piece, strict=True):
            where = free[group]
            s[where], n[where], p[where] = group, size_, names
            free[group] += 1
        self.base = at[:-1] + np.arange(len(size))
        self.end = at[1:] + np.arange(len(size))
        node, self.to, self.piece = s + word[s], s + word[s] + n, p
        weight = pieces.weight[p]
        total = np.full(len(data) + len(size), -np.inf)
        total[self.end] = 0.0
        far = left[s]
        # Short numbers are sorted by counting.
        turn = np.argsort(far.astype(np.uint16) if size.max(initial=0) < 1 << 16 else far, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=1))])
        turn_node, turn_to, turn_weight = node[turn], self.to[turn], weight[turn]
        heads = np.flatnonzero(np.append(True, turn_node[1:] != turn_node[:-1])) if len(turn) else turn
        head_node, head_cuts = turn_node[heads], np.searchsorted(heads, cuts).tolist()
        cuts = cuts.tolist()
        for low, high, i, j in zip(cuts, cuts[1:], head_cuts, head_cuts[1:], strict=False):
            if low < high:
                total[head_node[i:j]] = np.logaddexp.reduceat(turn_weight[low:high] + total[turn_to[low:high]], heads[i:j] - low)
        # Nodes inside a character that is a piece lead nowhere and are never reached.
        with np.errstate(invalid="ignore"):
            self.log = np.minimum(weight + total[self.to] - total[node], 0.0)
        self.log[~np.isfinite(self.log)] = -np.inf
        share = np.exp(self.log)
        sums = np.cumsum(share)
        sums -= share
        held = held[1:]
        heads = first[held > 0]
        many = held[held > 0]
        low = sums - np.repeat(sums[heads], many)
        # What the other edges of the node have, added up where one minus the largest would lose small ones.
        self.rest = 1.0 - share
        if len(heads):
            large = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, heads), many))
            most = large[np.append(True, node[large][1:] != node[large][:-1])]
            others = share.copy()
            others[most] = 0.0
            self.rest[most] = np.add.reduceat(others, heads)
        self.key = node + low + share
        self.key[heads + many - 1] = np.inf
        self.nodes = len(total)
        count = np.zeros(self.nodes + 1, np.int64)
        count[place + word + 1] = held
        self.first = np.cumsum(count)
        self.room: dict[str, np.ndarray] = {}

    def extend(self, other: Lattice) -> None:
        """Puts the words of another lattice behind the own ones."""
        nodes, edges, self.first = self.nodes, len(self.piece), self.first[:-1]
        for name in ("base", "end", "to", "key"):
            self._put(name, getattr(other, name), nodes)
        for name in ("piece", "log", "rest"):
            self._put(name, getattr(other, name), 0)
        self._put("first", other.first, edges)
        self.nodes += other.nodes

    def _put(self, name: str, more: np.ndarray, shift: int) -> None:
        """Puts ``more + shift`` behind an array, which has some room to grow."""
        own = getattr(self, name)
        n = len(own) + len(more)
        if len(self.room.get(name, ())) < n:
            self.room[name] = np.empty(n + n // 2, own.dtype)
            self.room[name][: len(own)] = own
        np.add(more, shift, out=self.room[name][len(own) : n])
        setattr(self, name, self.room[name][:n])

    def keep(self, words: np.ndarray) -> None:
        """Keeps these words only, in this order."""
        size = self.end[words] - self.base[words] + 1
        base = np.cumsum(size) - size
        nodes = np.arange(int(size.sum())) + np.repeat(self.base[words] - base, size)
        held = self.first[nodes + 1] - self.first[nodes]
        first = np.concatenate([[0], np.cumsum(held)])
        edges = np.arange(int(first[-1])) + np.repeat(self.first[nodes] - first[:-1], held)
        moved = np.repeat(nodes - np.arange(len(nodes)), held)
        kept = {"first": first, "base": base, "end": base + size - 1}
        kept |= {name: getattr(self, name)[edges] - moved for name in ("to", "key")}
        kept |= {name: getattr(self, name)[edges] for name in ("piece", "log", "rest")}
        self.nodes = len(nodes)
        for name, own in kept.items():
            if name in self.room:  # touched memory is used again
                self.room[name][: len(own)] = own
                own = self.room[name][: len(own)]
            setattr(self, name, own)

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        value, edge = nodes + u * (1 - 1e-12), self.first[nodes]
        live = np.flatnonzero(self.key[edge] <= value)
        wanted, ahead = value[live], edge[live]
        while len(live):
            ahead += 1
            edge[live] = ahead
            on = self.key[ahead] <= wanted
            live, wanted, ahead = live[on], wanted[on], ahead[on]
        return edge

    def walk(self, nodes: np.ndarray, ends: np.ndarray, uniform) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its word's end, in order, and how many of each; ``uniform(which, step)`` gives the random numbers."""
        steps, owners = [], []
        live = np.flatnonzero(nodes < ends)
        nodes = nodes.copy()
        while len(live):
            edge = self.draw(nodes[live], uniform(live, len(steps)))
            steps.append(edge)
            owners.append(live)
            nodes[live] = self.to[edge]
            live = live[nodes[live] < ends[live]]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(nodes), np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(steps)[order], np.bincount(owner, minlength=len(nodes))


def _below(location, bound: float, rng) -> np.ndarray:
    """Gumbel draws at ``location``, given that they lie below ``bound``."""
    location = np.atleast_1d(np.asarray(location, float))
    below = np.minimum(location - bound, 700)
    np.exp(below, out=below)
    noise = rng.random(len(location))
    noise += 1e-300
    below -= np.log(noise, out=noise)
    # What has no probability stays at minus infinity.
    return location - np.log(below, out=below)


def keyed_uniform(keys: np.ndarray, counts: np.ndarray):
    """Random numbers for walks over so many words each, from the walk's key, the word's place and the step alone."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    word = mix(np.repeat(mix(keys), counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def uniform(which: np.ndarray, step: int) -> np.ndarray:
        move = np.uint64(step * 0xD1342543DE82EF95 % (1 << 64))
        return (mix(word[which] + move) >> np.uint64(11)) * 2.0**-53

    return uniform


def search(lattice: Lattice, words: np.ndarray, k: int, rng):
    """Finds up to k distinct segmentations of a chain of words: returns ``(score, log-probability, edges)`` by falling score, and the next score.

    A generator: it asks for walks by yielding nodes and ends, and is sent the edges and their counts.
    """
    # A part: (-score, number, path, counts, place of the branch, its barred edges).
    start = float(-np.log(-np.log(rng.random() + 1e-300)))
    heap = [(-start, 0, None, None, 0, ())]
    out, made = [], 1
    base, ends = lattice.base[words], lattice.end[words]
    while heap and len(out) < k:
        score, _, path, counts, branch, barred = heapq.heappop(heap)
        score = -score
        if path is None:
            path, counts = yield base, ends
            first = 0
        else:
            node = int(np.searchsorted(lattice.first, path[branch], "right")) - 1
            edges = np.array([e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in barred])
            share = np.cumsum(np.exp(lattice.log[edges]))
            edge = edges[min(int(np.searchsorted(share, rng.random() * share[-1], "right")), len(edges) - 1)]
            word = int(np.searchsorted(np.cumsum(counts), branch, "right"))
            nodes = np.concatenate([[lattice.to[edge]], base[word + 1 :]])
            rest, rest_counts = yield nodes, ends[word:]
            before = int(counts[:word].sum())
            counts = np.concatenate([counts[:word], [branch - before + 1 + rest_counts[0]], rest_counts[1:]])
            path = np.concatenate([path[:branch], [edge], rest])
            first = branch
        logs = lattice.log[path]
        out.append((score, float(logs.sum()), path))
        # The parts that are left: another edge at the branch, or at any later place.
        prefix = np.concatenate([[0.0], np.cumsum(logs)])
        mass = lattice.rest[path[first:]]
        np.log(mass, out=mass)
        mass += prefix[first:-1]
        if barred and len(path):
            mass[0] = prefix[first] + np.log(np.exp(lattice.log[edges[edges != path[first]]]).sum())
        scores = _below(mass, score, rng) if len(mass) else mass
        # Only the best parts can be opened or give the threshold.
        wanted = k + 1 - len(out)
        if wanted == 1 and len(scores):
            best = [int(scores.argmax())]
        else:
            best = np.argpartition(scores, -wanted)[-wanted:].tolist() if len(scores) > wanted else range(len(scores))
        for n in best:
            if np.isfinite(scores[n]):
                bars = (*(barred if n == 0 else ()), int(path[first + n]))
                heapq.heappush(heap, (-float(scores[n]), made, path, counts, first + n, bars))
                made += 1
    return out, -heap[0][0] if heap else -np.inf


def top_k(lattice: Lattice, chains: list[np.ndarray], k: int, seed: int, keys: list[int]) -> list:
    """The result of ``search`` for each chain of words; walks that the searches ask for are made together."""
    numbers = np.array([key % (1 << 64) for key in keys], np.uint64) ^ mix(np.full(len(keys), seed, np.uint64))
    rngs = [np.random.Generator(np.random.Philox(key=[seed, key % (1 << 64)])) for key in keys]
    searches = [search(lattice, words, k, rng) for words, rng in zip(chains, rngs, strict=True)]
    found: list = [None] * len(keys)
    asked = [(n, next(one)) for n, one in enumerate(searches)]
    turn = 0
    with np.errstate(divide="ignore", over="ignore"):
        while asked:
            which = np.array([n for n, _ in asked])
            sizes = np.array([len(nodes) for _, (nodes, _) in asked])
            # Each walk of a row has random numbers of its own.
            uniform = keyed_uniform(mix(numbers[which]) + np.uint64(turn), sizes)
            path, counts = lattice.walk(np.concatenate([nodes for _, (nodes, _) in asked]), np.concatenate([ends for _, (_, ends) in asked]), uniform)
            word_at = np.concatenate([[0], np.cumsum(sizes)])
            edge_at = np.concatenate([[0], np.cumsum(counts)])[word_at]
            more = []
            for place, (n, _) in enumerate(asked):
                walked = path[edge_at[place] : edge_at[place + 1]], counts[word_at[place] : word_at[place + 1]]
                try:
                    more.append((n, searches[n].send(walked)))
                except StopIteration as end:
                    found[n] = end.value
            asked, turn = more, turn + 1
    return found


class KnownWords:
    """Lattices of the words that a task has met."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.words = pa.array([], pa.large_binary())
        #: In how many slices each word was met, less at each clearing; words of one slice only go then.
        self.met = np.zeros(0, np.int64)
        self.size = 0
        self.lattice: Lattice | None = None

    def find(self, names) -> np.ndarray:
        """The number of each of these distinct words in ``lattice``; new ones are built, and those met least are forgotten when they have become too many."""
        if self.size > KEPT_BYTES:
            self._clear()
        place = pc.index_in(names, value_set=self.words)
        new = names.filter(place.is_null())
        found = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new) or self.lattice is None:
            _, offsets, data = new.buffers()
            at = np.frombuffer(offsets, np.int64)[new.offset : new.offset + len(new) + 1] if len(new) else np.zeros(1, np.int64)
            data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
            built = Lattice(self.pieces, data, at - at[0])
            if self.lattice is None:
                self.lattice = built
            else:
                self.lattice.extend(built)
            found[place.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            self.size += len(data)
        self.met[found] += 1
        return found

    def _clear(self) -> None:
        """Keeps the words met most, two times at least and of half the limit at most."""
        size, often = self.lattice.end - self.lattice.base, np.flatnonzero(self.met > 1)
        order = often[np.argsort(-self.met[often], kind="stable")]
        kept = np.sort(order[np.cumsum(size[order]) <= KEPT_BYTES // 2])
        self.lattice.keep(kept)
        self.words = self.words.take(pa.array(kept))
        self.met, self.size = (self.met[kept] + 1) // 2, int(size[kept].sum())


def sample_rows(pieces: Pieces, k: int, seed: int):
    def run(batches):
        # Once a block of this size was freed, the C library keeps the memory of smaller arrays and does not ask for it again for each.
        np.empty(KEPT_FREE, np.uint8)
        known = KnownWords(pieces)
        blank = np.zeros(256, bool)
        for batch in batches:
            for begin, stop in _slices(batch, SLICE_CHARS):
                part = batch.slice(begin, stop - begin)
                texts = pc.replace_substring(pc.fill_null(part.column("text"), ""), BLANK, " ")
                # A run of blanks starts a word, and so does each text: it gets the blank that the model puts before it.
                whole = Words(pc.binary_join_element_wise(" ", texts, ""), blank)
                data, at = whole.data, whole.at
                first_blank = data == 32
                first_blank[1:] &= data[:-1] != 32
                first_blank[at[:-1]] = True
                starts = np.flatnonzero(first_blank)
                lengths = np.diff(np.append(starts, len(data)))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                coded = strings.dictionary_encode()
                number = known.find(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
                lattice = known.lattice
                first = np.searchsorted(starts, at).tolist()
                # The blank before a text without characters is no word.
                chains = [number[i:j] if full else number[:0] for i, j, full in zip(first, first[1:], (np.diff(at) > 1).tolist(), strict=False)]
                names = part.column("doc_id").to_pylist()
                rows: dict[str, list] = {n: [] for n in ("doc_id", "sample", "ids", "score", "log_probability", "log_inclusion")}
                for key, (found, threshold) in zip(names, top_k(lattice, chains, k, seed, [key or 0 for key in names]), strict=True):
                    for n, (score, log, path) in enumerate(found):
                        reach = log - threshold
                        rows["doc_id"].append(key)
                        rows["sample"].append(n)
                        rows["ids"].append(lattice.piece[path].astype(np.int32))
                        rows["score"].append(score)
                        rows["log_probability"].append(log)
                        rows["log_inclusion"].append(float(np.log(-np.expm1(-np.exp(reach))) if -30 < reach < 700 else min(reach, 0.0)))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows["ids"]])])
                ids = np.concatenate([*rows["ids"], np.zeros(0, np.int32)])
                rows["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["sample"], pa.int32()), rows["ids"]]
                arrays += [pa.array(rows[n], pa.float64()) for n in ("score", "log_probability", "log_inclusion")]
                yield pa.RecordBatch.from_arrays(arrays, names=list(rows))

    return run


def sample_encodings(docs: DataFrame, path: str, k: int = K, power: float = POWER, seed: int = SEED) -> DataFrame:
    """``doc_id, sample, ids, score, log_probability, log_inclusion``: up to k distinct segmentations of each text."""
    schema = "doc_id long, sample int, ids array<int>, score double, log_probability double, log_inclusion double"
    return lean(docs).mapInArrow(sample_rows(load_pieces(path, power), k, seed), schema)


def decode_lists(pieces: Pieces, lists) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each list of ids without the blank put before a text, as one array with offsets."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(pieces.at)[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = pieces.flat[np.arange(int(ends[-1])) - np.repeat(ends[:-1], size) + np.repeat(pieces.at[ids], size)]
    at = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])]
    lead = at[:-1][(np.diff(at) > 0)]
    lead = lead[data[lead] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], at - np.searchsorted(lead, at)


def decode_rows(pieces: Pieces, names: list[str]):
    def run(batches):
        for whole in batches:
            size = np.cumsum(whole.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(size // DECODED_IDS)) + 1).tolist(), whole.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                batch = whole.slice(low, high - low)
                data, at = decode_lists(pieces, batch.column("ids"))
                text = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(text, pa.string())], names=[*names, "text"])

    return run


def decode(rows: DataFrame, path: str, power: float = POWER) -> DataFrame:
    """The columns of ``rows`` without ``ids``, and the ``text`` that they spell; broken bytes become U+FFFD."""
    names = [n for n in rows.columns if n not in ("ids", "text")]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in names)
    return rows.select(*names, "ids").mapInArrow(decode_rows(load_pieces(path, power), names), f"{kept}text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    found = sample_encodings(read(spark, sf_dir, "documents"), path)
    sums = F.array_join("ids", ",")
    marked = found.select("*", F.size("ids").cast("bigint").alias("n_ids"), F.sha2(sums, 256).alias("ids_sha256"))
    spelled = decode(marked, path)
    names = ["doc_id", "sample", "n_ids", "ids_sha256", "score", "log_probability", "log_inclusion"]
    return spelled.select(*names, F.sha2("text", 256).alias("decoded_sha256"))
