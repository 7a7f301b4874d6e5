"""Benchmark decontamination by canonical templates.

Texts become templates: tokens are runs of letters, digits and bytes above
127, lower-cased; a token that begins with a digit becomes <number>, a
capitalised token inside a sentence <name>, and a unit after a number <unit>.
A second template masks every capitalised token, so names that open a sentence
match too. Besides, windows of equal lower-cased tokens match as they stand, in
whatever case and however few plain tokens they have.
Windows of ``window`` tokens of the benchmark's templates are hash-joined with
the windows of every document. A match counts only if its slots are
consistent: inside one item, a benchmark name always stands for the same
name of the document and the other way round, and the number or unit at a
place of the item always for the same one (a re-parameterised question renames
its values, it does not mix them). Every aligned occurrence of an item in a text
(windows at one distance of place and item position, from each conflict on anew)
is a binding of its own, to which the other windows that fit it are added; the
best binding counts. A document is contaminated if enough windows of one item
match, or enough of those that have ``min_literals`` plain tokens; the latter are
the number reported, if there are any. Windows that more than ``COMMON`` items
share (a preamble, an instruction) count for no item that has others.

The benchmark is the query set: all of it passes the driver and is broadcast, in
blocks of at most ``BLOCK_TOKENS`` tokens, so what is sent grows with the benchmark
(not with the documents), and each batch of documents is held against every
block. Documents are not shuffled.

Defined results: null or empty documents match nothing; an item without
``min_literals`` plain tokens in any window matches only as it stands; an item shorter
than a window is one window of its own length. Rows are judged one by one, so
repeated rows agree. Empty tables: empty result, or nothing contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import chunks as C
from churnlens.llm import textops as T

WINDOW = 8
MIN_LITERALS = 4
#: Matched windows of an item (or all that it has) that make a document contaminated.
MIN_WINDOWS = 5
#: A window that more items have than that (items of equal text are one) tells none of them from the others.
COMMON = 10
BLOCK_TOKENS = 1 << 20

#: Units of measure, currencies and times that follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
    "week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees mph kmh"
).split()

NUMBER, NAME, UNIT = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)  # 0 separator, 1 letter or byte above 127, 2 digit
_CLASS[128:] = 1
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_CLASS[ord("0"): ord("9") + 1] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n:"]] = True
#: Kinds of windows: names inside a sentence masked, every capitalised token masked, tokens as they stand.
INSIDE, CAPITALS, EXACT = 0, 1, 2
_SLOT_HASH = np.array([0, 0x9AE16A3B2F90404F, 0xB492B66FBE98F273, 0xC3A5C85C97CB3127], np.uint64)


def _hash_words(words: list[str]) -> np.ndarray:
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(T.span_hashes(buf, ends - [len(w) for w in words], ends))


_UNIT_HASHES = _hash_words(UNITS)


def templates(buf: np.ndarray, offsets: np.ndarray):
    """Value hashes of all tokens, their slot kinds (names inside a sentence; all capitalised tokens), and tokens per text."""
    n_docs = len(offsets) - 1
    if not len(buf):
        none = np.zeros(0, np.uint64)
        return none, [np.zeros(0, np.uint8)] * 2, np.zeros(n_docs, np.int64)
    kind = _CLASS[buf]
    # a point or comma between digits belongs to the number
    joint = ((buf == ord(".")) | (buf == ord(",")))
    joint[1:] &= kind[:-1] == 2
    joint[:-1] &= kind[1:] == 2
    joint[0] = joint[-1] = False
    solid = (kind > 0) | joint
    start, last = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    start[heads], last[tails] = solid[heads], solid[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(s, offsets))
    value = T.span_hashes(_LOWER[buf], s, e)
    slot = np.zeros(len(s), np.uint8)
    slot[kind[s] == 2] = NUMBER
    stops = np.concatenate([[0], np.cumsum(_STOP[buf] & ~joint)])
    opens = np.ones(len(s), bool)
    if len(s) > 1:
        opens[1:] = stops[s[1:]] > stops[e[:-1]]
    first = (np.cumsum(counts) - counts)[counts > 0]
    opens[first] = True
    capital = (buf[s] >= ord("A")) & (buf[s] <= ord("Z"))
    slot[capital & ~opens] = NAME
    after_number = np.zeros(len(s), bool)
    after_number[1:] = slot[:-1] == NUMBER
    after_number[first] = False
    slot[after_number & _member(value)] = UNIT
    return value, [slot, np.where(capital & (slot == 0), NAME, slot).astype(np.uint8)], counts


def masked(value: np.ndarray, slots: list[np.ndarray], way: int) -> np.ndarray:
    """The token hashes of a kind of windows."""
    return value if way == EXACT else np.where(slots[way] > 0, _SLOT_HASH[slots[way]], value)


def _member(value: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    return _UNIT_HASHES[at] == value


class Block:
    """The template windows of some benchmark texts (with the ids of the items that are that text), in sorted hash order."""

    def __init__(self, items: list[tuple[list[int], bytes]], window: int, min_literals: int):
        buf = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        self.value, self.slots, counts = templates(buf, offsets)
        begins = np.cumsum(counts) - counts
        hashes, item, at, size, way = [], [], [], [], []
        plain = np.zeros(len(self.value), bool)
        #: Windows of every item with enough plain tokens, and all its windows.
        self.total, self.all = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for kind in (INSIDE, CAPITALS, EXACT):
            tokens = masked(self.value, self.slots, kind)
            for width in sorted({min(window, int(c)) for c in counts if c}):
                h = T.sequence_hashes(tokens, width)
                if kind == EXACT:
                    use = np.ones(len(h), bool)
                else:
                    use = np.convolve(self.slots[kind] == 0, np.ones(width, int), "valid") >= min(min_literals, width)
                if kind == CAPITALS:  # without a capitalised token it is the window of the other template
                    use &= np.convolve(self.slots[kind] == NAME, np.ones(width, int), "valid") > 0
                for i, (b, c) in enumerate(zip(begins, counts)):
                    if c and min(window, c) == width:
                        places = np.arange(b, b + c - width + 1)
                        self.all[i] = len(places)
                        places = places[use[places]]
                        if kind == INSIDE:
                            self.total[i] = len(places)
                            plain[places] = True
                        hashes.append(h[places])
                        at.append(places)
                        item.append(np.full(len(places), i))
                        size.append(np.full(len(places), width))
                        way.append(np.full(len(places), kind))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        order = np.argsort(join(hashes, np.uint64), kind="stable")
        self.hash = join(hashes, np.uint64)[order]
        self.item, self.at, self.size, self.way = (join(x, np.int64)[order] for x in (item, at, size, way))
        self.plain = plain[self.at]
        self.ids = [i for i, _ in items]
        self.widths = sorted(set(self.size.tolist()))

    def windows(self) -> np.ndarray:
        """Every window once per text that has it."""
        mixed = T.mix(self.hash ^ T.mix((self.size * 4 + self.way).astype(np.uint64)))
        order = np.lexsort((mixed, self.item))
        mixed, item = mixed[order], self.item[order]
        return mixed[np.concatenate([[True], (mixed[1:] != mixed[:-1]) | (item[1:] != item[:-1])])] if len(mixed) else mixed

    def keep_distinctive(self, common: np.ndarray) -> None:
        """Leaves out windows that very many texts have, but for a text that has no other: so a place of a document
        meets a bounded number of texts, and what all of them begin with is evidence for none."""
        mixed = T.mix(self.hash ^ T.mix((self.size * 4 + self.way).astype(np.uint64)))
        shared = C.member(common, mixed)
        only = np.ones(len(self.ids), bool)
        only[self.item[~shared]] = False
        keep = ~shared | only[self.item]
        self.hash, self.item, self.at, self.size, self.way, self.plain = (x[keep] for x in (self.hash, self.item, self.at, self.size, self.way, self.plain))
        for of, rows in ((self.all, np.ones(len(self.at), bool)), (self.total, self.way == INSIDE)):
            places = np.unique(self.at[rows])                      # a place belongs to one text
            owner = np.zeros(len(self.value), np.int64)
            owner[self.at[rows]] = self.item[rows]
            of[:] = np.bincount(owner[places], minlength=len(self.ids))
        self.widths = sorted(set(self.size.tolist()))

    def matches(self, value, slots, counts) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, matched windows of the item with consistent slots, those of them with enough plain tokens)."""
        text_of = np.repeat(np.arange(len(counts)), counts)
        found = []
        ways = [(kind, masked(value, slots, kind)) for kind in (INSIDE, CAPITALS, EXACT)]
        for width in self.widths:
            places = T.starts_within(counts, width)
            for kind, tokens in ways:
                rows = np.flatnonzero((self.size == width) & (self.way == kind))
                hashes = self.hash[rows]
                got = T.sequence_hashes(tokens, width)[places] if len(places) else np.zeros(0, np.uint64)
                lo, hi = np.searchsorted(hashes, got, "left"), np.searchsorted(hashes, got, "right")
                hit = np.flatnonzero(hi > lo)
                n = (hi - lo)[hit]
                found.append(np.stack([np.repeat(places[hit], n), rows[T.ragged(lo[hit], n)]], axis=1))
        if not found or not sum(map(len, found)):
            return
        pair = np.concatenate(found)
        text, item = text_of[pair[:, 0]], self.item[pair[:, 1]]
        order = np.lexsort((self.at[pair[:, 1]], pair[:, 0], item, text))
        pair, text, item = pair[order], text[order], item[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(new, [*new[1:], len(pair)]):
            mine, i = pair[a:b], int(item[a])
            n = self._consistent(mine, value)
            if self.total[i] < self.all[i]:
                yield int(text[a]), i, n, self._consistent(mine[self.plain[mine[:, 1]]], value)
            else:
                yield int(text[a]), i, n, n

    def _consistent(self, pairs: np.ndarray, value: np.ndarray) -> int:
        """Most distinct windows of the item whose slot values fit one binding."""
        if not len(pairs):
            return 0
        # per match: the window's place in the item, its distance, and what its slots bind
        seen: dict[tuple, None] = {}
        for place, row in pairs.tolist():
            at, width = int(self.at[row]), int(self.size[row])
            binds, slot = [], self.slots[self.way[row] % EXACT]
            for j in np.flatnonzero(slot[at: at + width]).tolist():
                kind, ours, theirs = int(slot[at + j]), int(self.value[at + j]), int(value[place + j])
                binds.append(((kind, ours if kind == NAME else at + j), theirs))
            seen[place - at, at, tuple(binds)] = None
        matches = list(seen)
        every = len({at for _, at, _ in matches})
        lines: dict[int, list] = {}
        for distance, at, binds in matches:
            lines.setdefault(distance, []).append((at, binds))
        seeds: dict[tuple, None] = {}
        for line in lines.values():
            binding = _Binding()
            group: list = []
            for at, binds in line:
                if not binding.add(at, binds):
                    seeds[tuple(group)] = None
                    binding, group = _Binding(), []
                    if not binding.add(at, binds):
                        continue
                group.append((at, binds))
            seeds[tuple(group)] = None
        distinct = list(dict.fromkeys((at, binds) for _, at, binds in matches))
        best = 0
        for group in sorted(seeds, key=len, reverse=True):
            binding = _Binding()
            for at, binds in [*group, *distinct]:
                if at not in binding.good:
                    binding.add(at, binds)
            best = max(best, len(binding.good))
            if best == every:
                break
        return best


class _Binding:
    """Which value of the document stands for which slot of the item. Names are bound one to one."""

    def __init__(self):
        self.there: dict[tuple, int] = {}
        self.back: dict[int, tuple] = {}
        self.good: set[int] = set()

    def add(self, at: int, binds: tuple) -> bool:
        """Adds the window at a place of the item if its slots fit those of the windows before, and each other."""
        fresh: dict[tuple, int] = {}
        named: dict[int, tuple] = {}
        for ours, theirs in binds:
            if self.there.get(ours, theirs) != theirs or fresh.get(ours, theirs) != theirs:
                return False
            if ours[0] == NAME and (self.back.get(theirs, ours) != ours or named.setdefault(theirs, ours) != ours):
                return False
            fresh[ours] = theirs
        self.there |= fresh
        self.back |= named
        self.good.add(at)
        return True


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, min_literals: int) -> list[Block]:
    """The benchmark in blocks of bounded size; all of it passes the driver and is held there."""
    out, items, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for r in rows.distinct().orderBy("t", "i").toLocalIterator():
        if items and items[-1][1] == r["t"]:
            items[-1][0].append(r["i"])
            continue
        if size >= BLOCK_TOKENS:
            out.append(Block(items, window, min_literals))
            items, size = [], 0
        items.append(([r["i"]], bytes(r["t"])))
        size += len(r["t"]) // 2 + 1
    out += [Block(items, window, min_literals)] if items else []
    seen, n = np.unique(np.concatenate([b.windows() for b in out]) if out else np.zeros(0, np.uint64), return_counts=True)
    for b in out:
        b.keep_distinctive(seen[n > COMMON])
    return out


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id",
           window: int = WINDOW, min_literals: int = MIN_LITERALS, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """The columns ``keep`` as given, with _b_items (contaminating items, ascending), _b_windows and _b_contaminated."""
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark, item_col, "text", window, min_literals)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["_b_items array<long>", "_b_windows long", "_b_contaminated boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.as_bytes(batch.column("_b_text"))
            items: list[set] = [set() for _ in range(batch.num_rows)]
            most = np.zeros(batch.num_rows, np.int64)
            for lo, hi in T.blocks(offsets, T.BLOCK):
                made = templates(buf[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                for b in blocks:
                    for text, item, n, n_plain in b.value.matches(*made):
                        most[lo + text] = max(most[lo + text], n_plain or n)
                        if n >= min(min_windows, b.value.all[item]) or n_plain and n_plain >= min(min_windows, b.value.total[item]):
                            items[lo + text].update(b.value.ids[item])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(most), pa.array([bool(x) for x in items], pa.bool_())],
                names=[*keep, "_b_items", "_b_windows", "_b_contaminated"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_b_text")).mapInArrow(run, ddl)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, items, n_windows (most windows of one item that match)."""
    out = marked(docs, benchmark, [id_col], text_col)
    return out.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("_b_contaminated").alias("contaminated"), F.col("_b_items").alias("items"), F.col("_b_windows").alias("n_windows"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns that they had."""
    plain, name = C.plain_names(docs)
    return C.named_again(marked(plain, benchmark, plain.columns, name[text_col]).filter(~F.col("_b_contaminated")), docs)
