"""Byte-level BPE by a minimal acyclic transducer of frequent words, with exact merges for all other words.

Frequent words of the whole corpus are compiled into the minimal acyclic automaton of their bytes. Each arc carries
the number of words that are skipped by taking it, so the sum along a word's path is the word's place in sorted order:
an additive output, which leaves all suffixes shareable. The place leads to the word's ids. The tables are broadcast
as one image, which every Python worker writes to a file of its own, maps into memory and unlinks. Whether a word is in
the lexicon changes the speed alone: ids of other words come from the merges, many words at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import text_groups

#: The published pattern that byte-level BPE splits text by.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Where a single space isn't the start of a word, so that splitting at spaces would change the words.
INNER_SPACE = re.compile(r"\s (?=\s|\Z)")
#: Words in the lexicon; words a task counts at most before it drops the rarest, and those it hands on.
LEXICON, COUNTED, HANDED = 1 << 16, 1 << 18, 1 << 15
#: Chunks of text whose ids a worker remembers, and characters of these: a chunk may be as long as a text.
REMEMBERED, REMEMBERED_CHARACTERS = 800_000, 1 << 24
MARKS = tuple(".,:;!?")
#: Longer words are merged by a heap; shorter ones side by side.
WIDE = 48
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and pieces of a tokenizer file; only byte-level BPE without normalisation is taken."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain BPE without a normalizer is supported")
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only the byte-level pre-tokenizer without a prefix space is supported")
        byte = {letter: b for b, letter in byte_letters().items()}
        ids = model["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(byte[c] for c in piece) for piece, i in ids.items()}
        self.byte_id = np.array([ids[byte_letters()[b]] for b in range(256)], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.uint64)
        right = np.array([ids[b] for _, b in pairs], np.uint64)
        keys, first = np.unique(left << np.uint64(32) | right, return_index=True)
        self.pair_key, self.pair_rank = keys, first.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.special: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("only added tokens that match as they are written are supported")
            self.special[token["content"]] = token["id"]
            self.pieces[token["id"]] = token["content"].encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge that joins each pair, or NONE."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word, in n log n: the lowest merge first, the leftmost of equal ones."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Words of like length are merged together, one merge of each word at a time."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted((len(w), k) for k, w in enumerate(words) if len(w) <= WIDE)
        for k, w in enumerate(words):
            if len(w) > WIDE:
                out[k] = self.merge_one(w)
        for at in range(0, len(order), 4096):
            rows = [k for _, k in order[at : at + 4096]]
            for k, ids in zip(rows, self._side_by_side([words[k] for k in rows]), strict=True):
                out[k] = ids
        return out

    def _side_by_side(self, words: list[bytes]) -> list[list[int]]:
        width = max(map(len, words)) + 1
        grid = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        length = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(width)
        ids = np.where(place < length[:, None], self.byte_id[grid], -1)
        rank = np.full(ids.shape, NONE)
        y, x = np.nonzero(place[1:] < length[:, None])
        rank[y, x] = self.rank(ids[y, x], ids[y, x + 1])
        todo = np.arange(len(words))
        while len(todo):
            part = rank[todo]
            best = part.argmin(axis=1)
            low = part[np.arange(len(todo)), best]
            go = low != NONE
            todo, best, low = todo[go], best[go], low[go]
            if not len(todo):
                break
            old_ids, old_rank = ids[todo], rank[todo]
            new_ids, new_rank = old_ids.copy(), old_rank.copy()
            later = place[:-1] > best[:, None]
            new_ids[:, :-1] = np.where(later, old_ids[:, 1:], old_ids[:, :-1])
            new_rank[:, :-1] = np.where(later, old_rank[:, 1:], old_rank[:, :-1])
            new_ids[:, -1], new_rank[:, -1] = -1, NONE
            n = np.arange(len(todo))
            new_ids[n, best] = self.merged[low]
            for left in (best - 1, best):
                ok = left >= 0
                a = new_ids[n, np.maximum(left, 0)]
                b = new_ids[n, np.minimum(left + 1, width - 1)]
                ok &= (b >= 0) & (left + 1 < width)
                found = np.full(len(n), NONE)
                found[ok] = self.rank(a[ok], b[ok])
                new_rank[n[left >= 0], left[left >= 0]] = found[left >= 0]
            ids[todo], rank[todo] = new_ids, new_rank
        return [row[:n] for row, n in zip(ids.tolist(), (ids >= 0).sum(axis=1).tolist(), strict=True)]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The image of the minimal transducer of sorted distinct non-empty words and their ids.

    Words are added in order; a state is closed when no later word can pass it, and replaced by an equal closed one
    (the incremental construction for sorted input), so there are never more open states than a word has bytes.
    """
    # A state: (is it final, arcs); an arc: (byte, closed state). Closed states are numbered by content.
    known: dict[tuple, int] = {}
    closed: list[tuple] = []
    count: list[int] = []

    def close(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        at = known.get(key)
        if at is None:
            at = known[key] = len(closed)
            closed.append(key)
            count.append(final + sum(count[s] for _, s in arcs))
        return at

    path: list[list] = [[False, []]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], close(final, arcs)))

    for word in words:
        same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        fold(same)
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    fold(0)
    start = close(*path[0])
    key, target, skip = [], [], []
    for state, (final, arcs) in enumerate(closed):
        passed = int(final)
        for byte, to in arcs:
            key.append(state * 256 + byte)
            target.append(to)
            skip.append(passed)
            passed += count[to]
    final = np.array([f for f, _ in closed], np.int32)
    offset = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.array([x for row in ids for x in row], np.int32)
    parts = [np.array(key, np.int32), np.array(target, np.int32), np.array(skip, np.int32), final, offset, flat]
    head = np.array([start, *map(len, parts)], np.int32)
    return b"".join(x.tobytes() for x in [head, *parts])


class Lexicon:
    """A compiled lexicon, mapped into memory from a file that is gone once it is mapped."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int32, 7)
        self.start, at, parts = int(head[0]), 7, []
        for n in head[1:].tolist():
            parts.append(np.frombuffer(self.map, np.int32, n, at * 4))
            at += n
        self.key, self.target, self.skip, self.final, self.offset, self.ids = parts

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word that is in the lexicon; all words take their steps together."""
        if not len(self.key) or not words:
            return [None] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state = np.full(len(words), self.start, np.int32)
        place = np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        step = 0
        while len(live := live[length[live] > step]):
            want = state[live] * 256 + flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            place[live] += self.skip[at]
            step += 1
        known = (state >= 0) & (self.final[state] == 1) & (length > 0)
        first, end = self.offset[np.where(known, place, 0)], self.offset[np.where(known, place, 0) + 1]
        return [self.ids[s:e].tolist() if k else None for k, s, e in zip(known.tolist(), first.tolist(), end.tolist(), strict=True)]


def words_of_chunk(chunk: str) -> list[str] | tuple[str, ...]:
    """What the pattern finds in a chunk; letters after a space, and one mark after them, need no search."""
    body = chunk[1:]
    if chunk[:1] == " ":
        if body.isalpha():
            return (chunk,)
        if body[-1:] in MARKS and body[:-1].isalpha():
            return chunk[:-1], body[-1]
    return PATTERN.findall(chunk)


class Encoder:
    """Encodes texts; remembers the ids of chunks it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, special: bool = True):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = vocabulary.special if special else {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.characters = 0
        self.decimal = {i: str(i).encode() for i in vocabulary.pieces}.__getitem__
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def chunks(self, text: str) -> list[str]:
        """Parts of a text, without special tokens, that can be encoded one by one."""
        if INNER_SPACE.search(text):
            return PATTERN.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def learn(self, chunks: set[str]) -> None:
        todo = chunks.difference(self.known)
        if not todo:
            return
        if len(self.known) + len(todo) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.known, self.characters = {}, 0
            todo = chunks
        self.characters += sum(map(len, todo))
        known, words_of = self.known, {}
        fresh: set[str] = set()
        for chunk in todo:
            words = words_of[chunk] = words_of_chunk(chunk)
            fresh.update(words)
        words = [w for w in fresh if w not in known]
        coded = [w.encode() for w in words]
        ids = self.lexicon.find(coded) if self.lexicon else [None] * len(words)
        rest = [k for k, row in enumerate(ids) if row is None]
        for k, row in zip(rest, self.vocabulary.merge([coded[k] for k in rest]), strict=True):
            ids[k] = row
        decimal, piece = self.decimal, self.vocabulary.pieces.__getitem__
        for word, row in zip(words, ids, strict=True):
            known[word] = (b",".join(map(decimal, row)), b"".join(map(piece, row)))
        for chunk, parts in words_of.items():
            if len(parts) != 1:
                found = [known[w] for w in parts]
                known[chunk] = (b",".join([x for x, _ in found]), b"".join([x for _, x in found]))

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """(decimal ids joined by commas, decoded bytes) of each text; null is empty."""
        plans: list[list[list[str] | int]] = []
        fresh: set[str] = set()
        for text in texts:
            plan: list[list[str] | int] = []
            for part in self.split.split(text or "") if self.split else [text or ""]:
                if part in self.special:
                    plan.append(self.special[part])
                elif part:
                    plan.append(found := self.chunks(part))
                    fresh.update(found)
            plans.append(plan)
        self.learn(fresh)
        get = self.known.__getitem__
        for plan in plans:
            ids, decoded = [], []
            for part in plan:
                if isinstance(part, int):
                    ids.append(str(part).encode())
                    decoded.append(self.vocabulary.pieces[part])
                else:
                    found = list(map(get, part))
                    ids.append(b",".join(filter(None, map(itemgetter(0), found))))
                    decoded.append(b"".join(map(itemgetter(1), found)))
            yield b",".join(ids), b"".join(decoded)


def frequent_words(docs: DataFrame, text_col: str, n: int = LEXICON) -> list[str]:
    """About the n most frequent space-separated words of all texts.

    A task counts in bounded memory: when it holds more than COUNTED words it drops those met once, then twice, and
    so on. So rare words may be undercounted; none of this changes an encoding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        low = 1
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    seen.update(x.as_py().split())
                while len(seen) > COUNTED:
                    seen = Counter({w: k for w, k in seen.items() if k > low})
                    low += len(seen) > COUNTED // 2
        top = [(w, k) for w, k in seen.most_common(HANDED) if k > 1 and len(w) <= WIDE]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], names=["word", "k"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, k long")
    total = counted.groupBy("word").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "word").limit(n)
    return [r["word"] for r in total.collect()]


def build_lexicon(vocabulary: Vocabulary, frequent: list[str]) -> bytes:
    words = sorted({w.encode() for f in frequent for w in PATTERN.findall(" " + f)})
    return compile_lexicon(words, vocabulary.merge(words))


def id_lists(decimal: list[bytes], sizes: np.ndarray) -> pa.Array:
    joined = pa.array([b",".join(filter(None, decimal)).decode()])
    values = pc.split_pattern(joined, ",").values.cast(pa.int32()) if joined[0].as_py() else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and with ids=True ids array<int>) of each row.

    A null text is an empty one: no tokens, the digests of nothing. Repeated rows give repeated rows, an empty table
    none; very long texts are encoded whole; other columns are not read. Decoding joins the pieces of the ids; bytes that aren't UTF-8 become U+FFFD.
    """
    spark: SparkSession = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path)
    image = spark.sparkContext.broadcast((vocabulary, build_lexicon(vocabulary, frequent_words(docs, text_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lexicon = image.value
        encoder = Encoder(vocabulary, Lexicon(lexicon))
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1)):
                rows = list(encoder.encode_batch(group))
                decoded = [d.decode("utf-8", "replace").encode() for _, d in rows]
                columns = [
                    batch.column(0).slice(at, len(group)),
                    pa.array([i.count(b",") + 1 if i else 0 for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                ]
                if ids:
                    columns.append(id_lists([i for i, _ in rows], columns[1].to_numpy()))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
