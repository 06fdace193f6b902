"""Byte-level BPE by a rank file, and its inverse.

A text is cut into words by the pattern, and every distinct word of the corpus is encoded once. A word
that is in the rank file is its own piece. For the others Spark's higher-order functions fold over the
array of the word's bytes, merging in each step the adjacent pieces whose concatenation has the lowest
rank (the leftmost on a tie), until no pair has a rank. Pieces are numbers, their ranks, and the rank
of a pair's concatenation comes from a literal: all pairs of pieces that make a piece, in a two-choice
hash table of numbers, so that a lookup is at most two probes. The words' ids go to sorted hash arrays
in the shared folder, which workers map to put the texts' ids together. Decoding joins the pieces of a
text's ids, without its words; each word is compared with what its ids decode to.

Folding a pair at a time is quadratic in a word's length, so words beyond ``LONG`` bytes (unbroken runs of
one kind of character) take in one step all pairs of the lowest rank, the leftmost first, unless a merge
among them makes a pair of a lower rank; then only the leftmost.

Defined cases: a null or empty text has no ids and decodes to nothing; invalid surrogates cannot
occur in a Spark string; rows repeat in the result as in the input; other columns are ignored. An id
outside the rank file makes decoding fail, as does a rank file without all single bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Ids, blocks, bounded_batches, fresh_path, give_back, numbered, sums, tidy, written
from larkspur.llm.hashstore import Store, by_shard, put

#: Bytes of a word beyond which all pairs of a rank are merged at once.
LONG = 1024
#: Text that a worker looks through for words at once, and that it encodes at once.
BLOCK, BLOCK_ENCODED = 3 << 20, 2 << 20
#: Distinct parts of texts that a worker remembers, in the same two passes; the second keeps their ids as well.
MEMO, MEMO_ENCODED = 300_000, 100_000
#: Words of a shard of the dictionary, about.
SHARD_WORDS = 65_536
#: Their ids, about, where words are long.
SHARD_IDS = 16 * SHARD_WORDS
SEED = 42
#: Texts whose ids return to the JVM together.
ROWS_OUT = 512
#: The rank of a pair that is no piece.
NONE = 2**31 - 1

# The characters with the Unicode property White_Space, which \s stands for in rank files' patterns.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def compiled(pattern: str):
    """The pattern, with white space as Unicode has it."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(WHITE_SPACE if inside else f"[{WHITE_SPACE}]")
        elif two == r"\S":
            if inside:
                raise ValueError(r"\S in a class")
            out.append(f"[^{WHITE_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return regex.compile("".join(out), regex.V0)


#: The pattern for which the short way of ``cut`` is right.
SHORT_FOR = compiled(public_tokenizers.PATTERN).pattern


#: White space but the space: where it touches a space, words of a text are not those of its parts between spaces.
OTHER_SPACES = regex.findall(f"[{WHITE_SPACE}]", "".join(map(chr, range(0x3001)))[0x9:].replace(" ", ""))


#: What keeps a text from being cut at its spaces.
TOGETHER = "  | [{0}]|[{0}] ".format("".join(f"\\x{{{ord(c):x}}}" for c in OTHER_SPACES))


def parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct strings that the pattern can cut one by one, the number in them of each of all texts' strings, and where texts start.

    They are what stands between spaces, to be cut with a space in front, and, marked by a space, what begins a text or has to stay whole."""
    whole = pc.match_substring_regex(texts, TOGETHER).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    marked = pc.binary_join_element_wise("", pa.concat_arrays([texts.filter(pa.array(whole)), flat.take(pa.array(offsets[:-1]))]), " ")
    every = pa.concat_arrays([flat, marked]).dictionary_encode()
    own = every.indices.to_numpy().astype(np.int64)
    n, first = len(flat), int(whole.sum())
    own[offsets[:-1]] = own[n + first :]
    sizes = np.ones(len(texts), np.int64)
    sizes[~whole] = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.empty(starts[-1], np.int64)
    at = starts[:-1][whole]
    ids[at] = own[n : n + first]
    rest = np.ones(len(ids), bool)
    rest[at] = False
    ids[rest] = own[:n]
    return every.dictionary, ids, starts


def cut(part: str, pattern) -> list[str]:
    """pattern.findall, with a short way for the commonest parts: letters after a space, with or without a full stop or comma."""
    if part[:1] == " ":
        return pattern.findall(part[1:])
    if pattern.pattern == SHORT_FOR:
        if part.isalpha():
            return [" " + part]
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            return [" " + part[:-1], part[-1]]
    return pattern.findall(" " + part)


def strings(values: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in values.cast(pa.binary()).to_pylist()]


class Speller:
    """Numbers the words of texts; each distinct part is cut once."""

    def __init__(self, pattern):
        self.pattern, self.parts, self.words = pattern, Ids(), Ids()
        self.own, self.offsets = np.empty(0, np.int64), np.zeros(1, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts, and where texts start."""
        known = len(self.parts)
        distinct, ids, starts = parts(texts)
        number = np.fromiter(map(self.parts.__getitem__, strings(distinct)), np.int64, len(distinct))
        own, offsets, _ = numbered((cut(p, self.pattern) for p in islice(self.parts, known, None)), self.words)
        self.own, self.offsets = np.concatenate([self.own, own]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        return gathered(number[ids] if len(ids) else ids, starts, self.own, self.offsets)


def texts_of(block: pa.Table) -> pa.Array:
    """The texts of a block; a null is empty."""
    return pc.fill_null(block.column("t").combine_chunks(), "")


def gathered(ids: np.ndarray, starts: np.ndarray, own: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id i replaced by own[offsets[i]:offsets[i + 1]], and where texts then start."""
    n = np.diff(offsets)[ids]
    ends = np.cumsum(n)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return own[np.repeat(offsets[:-1][ids], n) + within], np.concatenate([[0], ends])[starts]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: pairs in a heap, by rank and position."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece, right, left = [word[i : i + 1] for i in range(n)], [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i]
        if not piece[i] or j >= n or ranks.get(piece[i] + piece[j]) != r:
            continue
        piece[i], piece[j], right[i] = piece[i] + piece[j], b"", right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a))
    return [ranks[p] for p in piece if p]


def pairs(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """(left, right, rank) for each way in which a piece is two pieces."""
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                yield left, right, rank


class RankLiteral:
    """The rank file as a literal: an array of maps. The map at (left ^ right << turn), cut to as many bits as ids have, gives the rank of left and right by right; place and right together tell what left is."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the rank file lacks a byte")
        self.bits = max(ranks.values()).bit_length()
        self.mask = (1 << self.bits) - 1
        left, right, rank = np.array(list(pairs(ranks)), np.int64).reshape(-1, 3).T
        places = {turn: (left ^ right << turn) & self.mask for turn in range(1, self.bits)}
        self.turn = min(places, key=lambda turn: (np.bincount(places[turn]) ** 2).sum())  # short maps
        maps: list[list[str]] = [[] for _ in range(1 << self.bits)]
        for at, r, to in zip(places[self.turn].tolist(), right.tolist(), rank.tolist(), strict=True):
            maps[at].append(f'"{r}":{to}')
        table = F.from_json(F.lit("[" + ",".join(f"{{{','.join(m)}}}" for m in maps) + "]"), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
        single = F.split(F.lit(",".join(str(ranks[bytes([i])]) for i in range(256))), ",").cast("array<bigint>")
        self.table = F.array(F.struct(table.alias("maps"), single.alias("single")))

    def bound(self, body) -> Column:
        """body of the table, which thus stands in the plan only once."""
        return F.get(F.transform(self.table, body), F.lit(0))

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        """Null for a pair that is no piece, or null."""
        return table["maps"][left.bitwiseXOR(F.shiftleft(right, self.turn)).bitwiseAND(F.lit(self.mask).cast("long"))][right]


def folded(word: Column, ranks: RankLiteral) -> Column:
    """Ids of a binary word, as an array of int."""

    def body(table: Column) -> Column:
        own = _bytes(word, table["single"]), lambda a, b: ranks.rank(table, a, b), ranks.bits
        return F.when(F.length(word) <= LONG, _folded(word, *own)).otherwise(_waved(word, *own)).cast("array<int>")

    return ranks.bound(body)


def _bytes(word: Column, single: Column) -> Column:
    """The id of each byte."""
    return F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c)))


def _of(state: Column, f) -> Column:
    """f of a column that is computed once."""
    return F.get(F.transform(F.array(state), f), F.lit(0))


def _state(a: Column) -> Column:
    return F.struct(a.alias("a"), F.array_min(a).alias("least"))


def _folded(word: Column, pieces: Column, rank, bits: int) -> Column:
    """The state holds a number for each piece: the rank of it with the next, its first byte's place and its id; so the least number is the merge that is due."""
    shift = bits + LONG.bit_length()
    place_and_id, id_only = F.lit((1 << shift) - 1).cast("long"), F.lit((1 << bits) - 1).cast("long")
    place, none = F.lit((1 << shift) - (1 << bits)).cast("long"), F.lit(NONE).cast("long")

    def item(rank: Column, rest: Column) -> Column:
        return F.shiftleft(rank, shift).bitwiseOR(rest)

    def start(p: Column) -> Column:
        return F.transform(p, lambda x, i: item(F.coalesce(rank(x, F.get(p, i + 1)), none), F.shiftleft(i.cast("long"), bits).bitwiseOR(x)))

    def step(s: Column, _: Column) -> Column:
        a, least = s["a"], s["least"]
        new = F.shiftright(least, shift)

        def merged_at(k: Column) -> Column:
            """k: where the piece is that takes in the next."""
            here = item(F.coalesce(rank(new, F.get(a, k + 2).bitwiseAND(id_only)), none), least.bitwiseAND(place).bitwiseOR(new))
            def before(x: Column) -> Column:
                return item(F.coalesce(rank(x.bitwiseAND(id_only), new), none), x.bitwiseAND(place_and_id))

            rest = F.array_remove(a, F.get(a, k + 1))
            return _of(F.transform(rest, lambda x, j: F.when(j == k, here).when(j + 1 == k, before(x)).otherwise(x)), _state)

        return F.when(new == none, s).otherwise(_of(F.array_position(a, least).cast("int") - 1, merged_at))

    out = F.aggregate(F.sequence(F.lit(2), F.length(word)), _of(_of(pieces, start), _state), step, lambda s: F.transform(s["a"], lambda x: x.bitwiseAND(id_only)))
    return F.when(F.length(word) > 1, out).otherwise(F.slice(pieces, F.lit(1), F.length(word)))


def _waved(word: Column, pieces: Column, rank, bits: int) -> Column:
    """The same of a word of two bytes or more, by as many steps as ranks are merged. The state holds for each piece the rank of it with the next, and its id.

    A merge makes pairs of the new piece alone; while none of them has a lower rank, all pairs of the rank are merged from left to right before any other.
    Aggregate copies the state in each step, so steps are taken in turns, and a turn is left out once no pair has a rank."""
    id_only, none = F.lit((1 << bits) - 1).cast("long"), F.lit(NONE).cast("long")

    def item(left: Column, right: Column) -> Column:
        return F.shiftleft(F.coalesce(rank(left, right), none), bits).bitwiseOR(left)

    def start(p: Column) -> Column:
        return F.transform(p, lambda x, i: item(x, F.get(p, i + 1)))

    def step(s: Column, _: Column) -> Column:
        a, new = s["a"], F.shiftright(s["least"], bits)

        def merged_at(marks: Column) -> Column:
            """marks: 1 where a piece is that takes in the next."""

            def marked(m: Column, i: Column) -> Column:
                return F.get(m, i) == "1"

            def here(m: Column, i: Column) -> Column:
                """A pair with the next piece may be there only until that is merged; if it comes first, it is what the item tells."""
                between = item(new, F.get(a, i + 2).bitwiseAND(id_only))
                return F.when(marked(m, i + 2) & (between > s["least"]), item(new, new)).otherwise(between)

            def each(m: Column) -> Column:
                return F.transform(
                    a,
                    lambda x, i: F.when(marked(m, i), here(m, i)).when(marked(m, i - 1), F.lit(None)).when(marked(m, i + 1), item(x.bitwiseAND(id_only), new)).otherwise(x),
                )

            return _of(F.array_compact(_of(F.split(marks, ""), each)), _state)

        due = F.array_join(F.transform(a, lambda x: F.when(F.shiftright(x, bits) == new, "1").otherwise("0")), "")

        def wave(marks: Column) -> Column:
            first = F.lpad(F.lit("1"), F.instr(marks, "1"), "0")
            return _of(merged_at(marks), lambda t: F.when(F.shiftright(t["least"], bits) < new, merged_at(first)).otherwise(t))

        return F.when(new == none, s).otherwise(_of(F.replace(due, F.lit("11"), F.lit("10")), wave))

    turns = F.sequence(F.lit(1), F.ceil(F.sqrt(F.length(word))).cast("int"))

    def turn(s: Column, _: Column) -> Column:
        return F.when(F.shiftright(s["least"], bits) == none, s).otherwise(F.aggregate(turns, s, step))

    return F.aggregate(turns, _of(_of(pieces, start), _state), turn, lambda s: F.transform(s["a"], lambda x: x.bitwiseAND(id_only)))


def dictionary(docs: DataFrame, text_col: str, rank_path: str, pattern: str) -> tuple[str, int]:
    """The store of the ids of all distinct words that are no pieces themselves, and its number of shards."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_pattern, ranks = compiled(pattern), load_ranks(rank_path)
        seen: set = set()
        emitted: set[str] = set()
        for block in blocks(batches, "t", BLOCK):
            new = set(strings(parts(texts_of(block))[0])) - seen
            words = {w for p in new for w in cut(p, own_pattern)} - emitted
            if len(seen) > MEMO:
                seen, emitted = set(), set()
            seen |= new
            emitted |= words
            own = [w for w in map(str.encode, words) if w not in ranks]
            for at in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 50_000], pa.binary())], ["word"])

    words = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(tidy(distinct), "word binary").distinct()
    coded = written(words.select("word", folded(F.col("word"), RankLiteral(load_ranks(rank_path))).alias("ids")), "bpe-words")
    n, ids = coded.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    uri, shards = fresh_path(spark, "bpe"), max(1, n // SHARD_WORDS, ids // SHARD_IDS)

    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        hashes = table.column("h").to_numpy().view(np.uint64)
        ids = table.column("ids").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
        offsets, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
        order = np.argsort(hashes, kind="stable")
        own, first = gathered(order, np.arange(len(order) + 1), flat, offsets)
        put(uri, "hash", shard, hashes[order])
        put(uri, "first", shard, first.astype(np.int64))
        put(uri, "ids", shard, own.astype(np.int32))
        return pa.table({"n": pa.array([len(order)], pa.int64())})

    hashed = coded.select(F.xxhash64("word").alias("h"), "ids").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    hashed.groupBy("shard").applyInArrow(keep, "n long").count()
    return uri, shards


class Pieces:
    """The bytes of ids, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece
        self.pieces, self.size = pa.array(by_id, pa.large_binary()), np.array([len(p) for p in by_id], np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.empty(0, np.uint8)
        if int(ids.max()) >= len(self.size) or not self.size[ids].all():
            raise ValueError("an id that the rank file lacks")
        return np.frombuffer(self.pieces.take(pa.array(ids)).buffers()[2], np.uint8)


def misread(words: list[bytes], ids: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Positions of words that their ids, those from ends[i] to ends[i + 1], do not decode to."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    got = sums(pieces.size[ids], ends)
    same = size == got
    own = np.frombuffer(b"".join(words), np.uint8)[np.repeat(same, size)]
    other = pieces(ids)[np.repeat(same, got)]
    bad = np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(own != other), "right")]
    return np.union1d(np.flatnonzero(~same), bad)


def looked_up(words: list[bytes], store: Store, shards: int, ranks: dict[bytes, int], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and where each word's begin. A word that is no piece and that the dictionary lacks, or whose ids there decode to another, is encoded here."""
    whole = np.fromiter(map(ranks.get, words, repeat(-1)), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    rest = np.flatnonzero(whole < 0)
    n = (whole >= 0).astype(np.int64)
    start = np.cumsum(n) - n
    pools, size = [whole[whole >= 0].astype(np.int32)], int(n.sum())
    for shard, own in by_shard(hashes[rest].view(np.int64) % shards):
        own = rest[own]
        known, first, ids = store.get("hash", shard, np.uint64), store.get("first", shard, np.int64), store.get("ids", shard, np.int32)
        at = np.searchsorted(known, hashes[own])
        hit = at < len(known)
        hit[hit] = known[at[hit]] == hashes[own][hit]
        at, own = at[hit], own[hit]
        n[own] = first[at + 1] - first[at]
        got, _ = gathered(at, np.arange(len(at) + 1), ids, first) if len(at) else (ids[:0], None)
        start[own] = size + np.cumsum(n[own]) - n[own]
        pools.append(got)
        size += len(got)

    def laid_out() -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(n)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        return np.concatenate(pools)[np.repeat(start, n) + within], np.concatenate([[0], ends])

    flat, ends = laid_out()
    wrong = misread(words, flat, ends, pieces)
    for i in wrong.tolist():  # not in the dictionary, or two words with one hash
        got = np.array(merged(words[i], ranks), np.int32)
        start[i], n[i] = size, len(got)
        pools.append(got)
        size += len(got)
    return laid_out() if len(wrong) else (flat, ends)


def binaries(data: bytes, starts: np.ndarray) -> pa.Array:
    """Slices of data."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


def encoded(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (what the ids decode to). The path must exist on every worker."""
    spark = docs.sparkSession
    uri, shards = dictionary(docs, text_col, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, store = load_ranks(rank_path), Store(uri)
        pieces, speller = Pieces(ranks), None
        for block in blocks(batches, "t", BLOCK_ENCODED):
            id_array = block.column("id").combine_chunks()
            if speller is None or len(speller.parts) > MEMO_ENCODED:
                speller = words = first = ids = ends = None
                speller, flat, offsets, known = Speller(compiled(pattern)), np.empty(0, np.int32), np.zeros(1, np.int64), 0
                store.close()
                give_back()
            words, first = speller(texts_of(block))
            ids, ends = looked_up([w.encode() for w in islice(speller.words, known, None)], store, shards, ranks, pieces)
            flat, offsets, known = np.concatenate([flat, ids]), np.concatenate([offsets, offsets[-1] + ends[1:]]), len(speller.words)
            for at in range(0, len(id_array), ROWS_OUT):
                edges = first[at : at + ROWS_OUT + 1]
                own, starts = gathered(words[edges[0] : edges[-1]], edges - edges[0], flat, offsets)
                back = binaries(pieces(own), np.concatenate([[0], np.cumsum(pieces.size[own])])[starts])
                yield pa.RecordBatch.from_arrays([id_array.slice(at, ROWS_OUT), pa.array(np.diff(starts)), binaries(own.astype("<u4"), 4 * starts), back], ["id", "n_tokens", "ids", "decoded"])

    bounded_batches(spark)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(run), "id long, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the UTF-8 text of ids as ``encoded`` returns them; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(load_ranks(rank_path))
        for b in batches:
            back = [pieces(np.frombuffer(x or b"", "<u4")).tobytes().decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string())], ["id", "text"])

    bounded_batches(rows.sparkSession)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
