"""Best-fit packing of token sequences by bin completion.

Texts are tokenised in Arrow batches, each distinct word once (no token spans white space). Pieces, without their tokens, are dealt out evenly to tasks of bounded size, and
each task packs its own: the largest piece left opens a sequence, undominated fillings for it are
enumerated, and branch and bound over those choices drops what wastes more than the incumbent; the
incumbents are best-fit solutions. A group packed into its lower bound of sequences is done at once. A group too
large for the search to get to a packing is packed by a dive, which takes the fullest filling met each time, and the
search improves batches of its worst-filled sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import text_slices

CAPACITY = 4096
END_TOKEN = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces that one task packs.
GROUP = 20_000
#: Nodes of one search, and fillings tried for one sequence.
NODES, FILLINGS = 2_000, 8
#: Pieces that one search takes on (it needs a node for each sequence to get to a packing), and searches in a row without gain that end it.
BATCH, TRIES = 300, 6
#: Steps towards the fullest filling of a sequence in a dive.
STEPS = 400
#: Words, and units of words, whose tokens a worker remembers; beyond it, words that no later texts had are forgotten, and all units.
REMEMBERED, UNITS = 100_000, 300_000

#: Texts outside this range, or with a marker of a special token, are encoded whole by the tokenizer.
_PLAIN = re.compile(r"[^\x1c-\x1f\x80-\x9f\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]*\Z")
#: The vocabulary's own division of plain words; no token spans two of these units.
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class _Numbers(dict):
    """Word to number; a word not met before gets the next number and is noted in ``fresh``."""

    def __init__(self, words=()):
        super().__init__((w, i) for i, w in enumerate(words))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, those numbered ``at``, end to end."""
    size = sizes[at]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokens:
    """Token ids of whole texts through a memory of words; equals encoding the text at once.

    The vocabulary drops white space and no token spans it, so a plain text's tokens are those of its words, end to end, and a
    word's those of its units. Words are remembered to be found at once, units because fewer of them are new.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        self.forget_units()

    def forget_units(self) -> None:
        self.units = _Numbers()
        self.unit_sizes, self.unit_flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def forget(self) -> None:
        self.known = _Numbers()
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def forget_rare(self) -> None:
        """Keep the words met again since they were learned or last kept; none, if those fill half the memory."""
        keep = np.flatnonzero(self.again)
        if 2 * len(keep) > REMEMBERED:
            self.forget()
            return
        names = list(self.known)
        self.known = _Numbers(names[k] for k in keep.tolist())
        self.flat, self.sizes = self.tokens_of(keep), self.sizes[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.again = np.zeros(len(keep), bool)

    def tokens_of(self, at: np.ndarray) -> np.ndarray:
        return _gather(self.flat, self.starts, self.sizes, at)

    def learn_units(self) -> None:
        """Encode the units numbered since the last call."""
        new, self.units.fresh = self.units.fresh, []
        sizes, flat = [self.unit_sizes], [self.unit_flat]
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(counts) != len(part):
                raise ValueError("a unit is more than one word of the vocabulary")
            sizes.append(counts)
            flat.append(np.array(e.ids, np.uint32))
        self.unit_sizes, self.unit_flat = np.concatenate(sizes), np.concatenate(flat)

    def learn(self) -> None:
        """Put together the tokens of the words numbered since the last call."""
        new, self.known.fresh = self.known.fresh, []
        if not new:
            return
        if len(self.units) > UNITS:
            self.forget_units()
        units: list[str] = []
        ends = []
        for word in new:
            units += _UNIT.findall(word)
            ends.append(len(units))
        at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        self.learn_units()
        upto = np.concatenate(([0], np.cumsum(self.unit_sizes[at])))[ends]
        self.sizes = np.concatenate((self.sizes, np.diff(upto, prepend=0)))
        self.flat = np.concatenate((self.flat, _gather(self.unit_flat, np.cumsum(self.unit_sizes) - self.unit_sizes, self.unit_sizes, at)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.again = np.concatenate((self.again, np.zeros(len(new), bool)))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        before = len(self.known)
        words: list[str] = []
        ends = [0]
        plain = []
        for t in texts:
            plain.append(_PLAIN.match(t) is not None and "<|" not in t)
            if plain[-1]:
                words += t.lower().split()
            ends.append(len(words))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.learn()
        self.again[at[at < before]] = True
        ids = self.tokens_of(at)
        cuts = np.concatenate(([0], np.cumsum(self.sizes[at])))[ends]
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return [ids[a:b] if p else whole(t) for t, p, a, b in zip(texts, plain, cuts[:-1], cuts[1:])]


_tokens: dict[str, WordTokens] = {}


def tokens_for(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's token sequence, cut where over ``capacity``."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = tokens_for(vocabulary_path(vocabulary))
        end = np.array([END_TOKEN], np.uint32)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            encoded = (ids for texts in text_slices(batch.column(1)) for ids in words.encode_many(texts))
            for i, ids in enumerate(encoded):
                ids = np.concatenate((ids, end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(i)
                    for c, v in zip(cols, (k, at, len(part), zlib.crc32(part.tobytes()))):
                        c.append(v)
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` by sequence, the longest placed first, each where it leaves least room."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms: list[int] = []  # ascending
    owners: list[int] = []
    out: list[list[int]] = []
    for i in order:
        n = lengths[i]
        at = bisect_right(rooms, n - 1)
        if at == len(rooms):
            out.append([i])
            room, owner = capacity - n, len(out) - 1
        else:
            room, owner = rooms.pop(at) - n, owners.pop(at)
            out[owner].append(i)
        at = bisect_right(rooms, room)
        rooms.insert(at, room)
        owners.insert(at, owner)
    return out


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int) -> list[tuple[int, ...]]:
    """Up to ``most`` maximal fillings of ``room`` from the multiset, fullest first.

    Depth first from the largest size down; a filling to which a left-out piece could be added, or in which a
    piece could be swapped for a larger left-out one that still fits, is dominated and dropped.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = [64 * most]

    def extend(at: int, left: int, chosen: tuple[int, ...]) -> None:
        if steps[0] <= 0 or len(found) >= 4 * most:
            return
        steps[0] -= 1
        grew = False
        for k in range(at, len(sizes)):
            s = sizes[k]
            if s <= left and counts[s] > chosen.count(s):
                grew = True
                extend(k, left - s, (*chosen, s))
                if left == s:
                    return
                if steps[0] <= 0:
                    break
        if not grew:
            found.append((left, chosen))

    extend(0, room, ())
    keep = []
    for left, chosen in sorted(set(found)):
        if len(keep) == most:
            break
        spare = {s for s in sizes if counts[s] > chosen.count(s)}
        if not any(s <= left for s in spare) and not any(c < s <= c + left for c in set(chosen) for s in spare):
            keep.append(chosen)
    return keep or ([min(found)[1]] if found else [()])


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs: what exceeds half a sequence stands apart, the rest fills up what it leaves.

    The largest of the bounds over all k by which pieces under k are left out and those over capacity - k stand alone.
    """
    if not lengths:
        return 0
    n = np.sort(np.array(lengths, np.int64))
    sums = np.concatenate(([0], np.cumsum(n)))
    half = np.searchsorted(n, capacity // 2, "right")
    k = np.concatenate(([0], np.unique(n[:half])))
    low, alone = np.searchsorted(n, k, "left"), np.searchsorted(n, capacity - k, "right")
    room = (alone - half) * capacity - (sums[alone] - sums[half])
    return int((len(n) - half + np.maximum(0, -((room - (sums[half] - sums[low])) // capacity))).max())


def positions(packing: list[tuple[int, ...]], lengths: list[int]) -> list[list[int]]:
    places: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        places.setdefault(n, []).append(i)
    return [[places[s].pop() for s in f] for f in packing]


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """The filling of ``room`` that leaves least of those met in STEPS steps, large pieces first; ``sizes`` ascend."""
    best: tuple[int, ...] = ()
    least, steps = room, STEPS

    def extend(top: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal best, least, steps
        for k in range(bisect_right(sizes, left, 0, top) - 1, -1, -1):
            if not least or steps <= 0:
                return
            steps -= 1
            s = sizes[k]
            if counts[s] > chosen.count(s):
                if left - s < least:
                    best, least = (*chosen, s), left - s
                if left - s >= sizes[0]:
                    extend(k + 1, left - s, (*chosen, s))

    extend(len(sizes), room, ())
    return best


def dive(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions by sequence; each opens with the largest piece left and takes the fullest filling for it."""
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    sizes, out = sorted(counts), []

    def take(s: int) -> None:
        counts[s] -= 1
        if not counts[s]:
            del sizes[bisect_right(sizes, s) - 1]

    while sizes:
        filling = (sizes[-1],)
        take(sizes[-1])
        while sizes and (f := fullest(sizes, counts, capacity - sum(filling))):
            filling += f
            for s in f:
                take(s)
        out.append(filling)
    return positions(out, lengths)


def bin_completion(lengths: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Positions by sequence, as few sequences as the search finds; never more than best fit.

    A group of up to BATCH pieces is searched whole. A larger one is packed by a dive as well, and the better
    packing's worst-filled sequences are searched in batches, with ``nodes`` each, until TRIES in a row gain nothing.
    """
    incumbent = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(incumbent) <= bound or nodes <= 0:
        return incumbent
    if len(lengths) <= BATCH:
        return search(lengths, capacity, incumbent, bound, nodes)
    incumbent = min(incumbent, dive(lengths, capacity), key=len)
    failed = 0
    while len(incumbent) > bound and failed < TRIES:
        incumbent.sort(key=lambda members: sum(lengths[i] for i in members))
        # the worst filled always, then others of the batch from further up at each failure
        size = at = 0
        taken: list[int] = []
        while at < len(incumbent) and size + len(incumbent[at]) <= BATCH:
            size += len(incumbent[at])
            taken.append(at)
            at += 1 if size < BATCH // 2 else 1 + failed
        members = [i for k in taken for i in incumbent[k]]
        part = [lengths[i] for i in members]
        fewest = lower_bound(part, capacity)
        better = search(part, capacity, [()] * len(taken), fewest, nodes) if fewest < len(taken) else [()] * len(taken)
        if len(better) < len(taken):
            gone = set(taken)
            incumbent = [m for k, m in enumerate(incumbent) if k not in gone] + [[members[i] for i in f] for f in better]
            failed = 0
        else:
            failed += 1
    return incumbent


def search(lengths: list[int], capacity: int, incumbent: list, bound: int, nodes: int) -> list[list[int]]:
    """Branch and bound for fewer sequences than ``incumbent``, which is returned if ``nodes`` nodes find none."""
    total = sum(lengths)
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    best: list[tuple[int, ...]] | None = None
    limit = len(incumbent) - 1  # sequences that an improvement may use
    chosen: list[tuple[int, ...]] = []
    stack: list[tuple[list[tuple[int, ...]], int]] = []
    waste, spent = 0, 0

    def options() -> list[tuple[int, ...]]:
        sizes = sorted((s for s, c in counts.items() if c), reverse=True)
        first = sizes[0]
        counts[first] -= 1
        out = [(first, *f) for f in fillings([s for s in sizes if counts[s]], counts, capacity - first, FILLINGS)]
        counts[first] += 1
        return out

    def put(f: tuple[int, ...], sign: int) -> None:
        for s in f:
            counts[s] -= sign

    stack.append((options(), 0))
    while stack and spent < nodes:
        todo, at = stack[-1]
        if at == len(todo):
            stack.pop()
            if chosen and len(stack) == len(chosen):
                put(last := chosen.pop(), -1)
                waste -= capacity - sum(last)
            continue
        stack[-1] = (todo, at + 1)
        f = todo[at]
        lost = capacity - sum(f)
        if waste + lost > limit * capacity - total:  # wastes more than any better packing can
            continue
        spent += 1
        put(f, 1)
        chosen.append(f)
        waste += lost
        if not any(counts.values()):
            best = list(chosen)
            limit = len(best) - 1
            if limit < bound:
                break
            put(last := chosen.pop(), -1)
            waste -= capacity - sum(last)
            continue
        stack.append((options(), 0))
    return incumbent if best is None else positions(best, lengths)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to materialised pieces. Pieces of full length stand alone."""
    n = max(1, -(-cut_pieces.count() // group))

    def run(batches):
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        number = TaskContext.get().partitionId() << 40
        lengths = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        whole = np.flatnonzero(lengths >= capacity)
        sequence[whole] = number + np.arange(len(whole))
        part = np.flatnonzero(lengths < capacity)
        for k, members in enumerate(bin_completion(lengths[part].tolist(), capacity)):
            at = part[members]
            sequence[at] = number + len(whole) + k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return cut_pieces.repartition(n).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of ``docs``.

    Null and empty texts are one piece of the end token alone; a repeated row is packed again, under the
    same doc_id; no rows give no pieces.
    """
    return pack(cut(pieces(docs, capacity)), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
