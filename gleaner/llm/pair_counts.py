"""Cross-tokenizer alignment with corpus counts of linked ids, held by minimal perfect hashing.

**Alignment.** Both tokenizers write the same bytes, a space and the text. A token
of A and one of B are linked where their bytes overlap; where both end, a group
ends. Neither tokenizer joins a space and letter to what stands before them
(checked when a tokenizer is opened), so texts are cut there into words, each
distinct word of a part (a few MB of texts of one task) is encoded once by the
libraries and aligned once, in flat numpy arrays over all words' bytes, and a
text's groups are those of its words.

**Counts.** Each part combines its links to distinct pairs. Pairs are dealt to
``SHARDS`` shards by their B id, which bounds a shard by the vocabularies, whatever
the corpus. The distinct pairs of a shard get a minimal perfect hash (levels of
bit arrays; a key rests at the first level where it has a bit alone, and its index
is the number of bits before that). The parts' counts become dense vectors by that
index, summed up a tree ``FAN`` wide, so no task reads the pairs of all parts. The
pairs themselves stand in the order of their indexes: a lookup verifies its key.

**Second pass.** Each part's pairs are looked up (shard by shard, up the same
tree), its words are aligned again, and every document sums over its words. Between
the passes a part is its distinct words and, for each text, their numbers (the
most frequent first, so that they pack well); texts are not shuffled.

Defined cases: NULL and empty texts, and texts whose tokens' bytes differ from
the text's (such as those with U+2581), have no tokens: zeros and an empty string.
Repeated rows give repeated results and count each; rows need no id; an empty
table gives an empty result; only the id and text columns are read, so others
cannot clash. Texts are read whole: a part is as large as its longest text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import whole_groups
from gleaner.llm.flat import byte_table, flat_utf8, slices
from gleaner.llm.lineage import cut

PART_BYTES = 4 << 20
SHARDS = 128
#: Parts summed by one task at each level of the tree.
FAN = 1024
#: Words encoded as one text, and such texts at once.
JOINED, TEXTS = 64, 256
#: Bits a remaining key at each level of a hash.
ROOM = 2

SPACE = "▁"
#: Words of ASCII and Latin letters.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ɏ]+")
LETTERS = byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])


# Words and their alignment --------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _fast(path: str):
    """An encoder of the same vocabulary for ``PLAIN`` words, several times as fast.

    Ranks are the file's merges in order, so it must list each merge's token as the next id. Both libraries cut such
    words alike by the byte-level pattern; other characters may differ by their Unicode versions and are left to the
    file's own.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    first = len(model["vocab"]) - len(merges)
    if any(model["vocab"][x + y] != first + k for k, (x, y) in enumerate(merges)):
        raise ValueError("the merges are not in the order of the ids")
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Words:
    """Tokens, groups and links of a list of words; words whose bytes a tokenizer changes (not ``good``) have none."""

    good: np.ndarray
    a: np.ndarray  # ids one word after another
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.Array  # a semicolon behind each
    word: np.ndarray  # of each link
    pair: np.ndarray


class Aligner:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.fast_a = _fast(path_a)
        letters = _byte_letters()
        words = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        bytes_a = [bytes(letters[c] for c in words[i]) if i in words and all(c in letters for c in words[i])
                   else special.get(i, "").encode() for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                bytes_b.append(bytes([int(piece[3:-1], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                bytes_b.append(b"")
            else:
                bytes_b.append(piece.replace(SPACE, " ").encode())
        if self.b.normalize("Ａ  ﬁ ") != f"{SPACE}Ａ{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        if any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size())):
            raise ValueError("a piece crosses a space")
        probe = ["x", "1", ".", "\n", "\t", "'", "é", "漢", " "]
        for before in probe:  # a space and letter begin a token whatever stands before them
            tokens = [bytes_a[i] for i in self.a.encode(f"a{before} b", add_special_tokens=False).ids]
            if tokens[-1] != b" b":
                raise ValueError("a token crosses a space")
        self.n_b = len(bytes_b)
        self.pool_a, self.pool_b = _Pool(bytes_a), _Pool(bytes_b)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts (each a space and more) and the n + 1 bounds of the texts; NULL and empty have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        buf, at = flat_utf8(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(
            _text(""), texts, _text(" "))))
        starts = np.zeros(len(buf) + 1, dtype=bool)
        starts[at] = True
        if len(buf) > 2:
            middle = buf[1:-1]
            # Not behind a space, nor behind what may be the mark that stands for one.
            starts[1:-2] |= (middle == 0x20) & LETTERS[buf[2:]] & (buf[:-2] != 0x20) & (buf[:-2] != 0x81)
        starts[len(buf)] = False
        first = np.flatnonzero(starts)
        bounds = np.append(first, len(buf)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf)))
        return words, np.searchsorted(first, at)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids of all words by A and by B, one after another, and how many each word has."""
        listed, (buf, at) = words.to_pylist(), flat_utf8(words)
        size = np.diff(at)
        plain = np.array([w.isascii() or PLAIN.fullmatch(w) is not None for w in listed], dtype=bool)
        # No token of B joins a space behind a word to the next word's; words with such an end, and those with the
        # mark that stands for a space, are encoded by themselves.
        alone = np.array([w.endswith(" ") or SPACE in w for w in listed], dtype=bool)
        out = []
        for pool, ways in ((self.pool_a, ((plain, self._plain_a, JOINED), (~plain, self._any_a, JOINED))),
                           (self.pool_b, ((~alone, self._any_b, JOINED), (alone, self._any_b, 1)))):
            n, parts = np.zeros(len(listed), dtype=np.int64), []
            for chosen, encode, joined in ways:
                which = np.flatnonzero(chosen)
                parts.append(self._encoded(listed, size, which, encode, joined, pool))
                n[which] = parts[-1][1]
            ids = np.empty(n.sum(), dtype=np.int32)
            for (chosen, *_), (flat, _) in zip(ways, parts):
                ids[np.repeat(chosen, n)] = flat
            out += [ids, n]
        return tuple(out)

    def _plain_a(self, texts: list[str]) -> list[list[int]]:
        return self.fast_a.encode_ordinary_batch(texts, num_threads=1)

    def _any_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _any_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode([t[1:] for t in texts], num_threads=1)  # it puts the space before a text itself

    @staticmethod
    def _encoded(words: list[str], size: np.ndarray, which: np.ndarray, encode, joined: int, pool: _Pool) -> tuple:
        """Ids of the words of numbers ``which`` one after another, and how many each has: encoded ``joined`` words to a
        text, told apart by the bytes of their tokens."""
        held, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(which), JOINED * TEXTS):
            some = which[a:a + JOINED * TEXTS]
            texts = ["".join([words[k] for k in some[b:b + joined].tolist()]) for b in range(0, len(some), joined)]
            single = [np.array(x, dtype=np.int32) for x in encode(texts)]
            ids = np.concatenate(single)
            if joined == 1:
                held.append(ids)
                counts.append(np.array([len(x) for x in single], dtype=np.int64))
                continue
            ends, last = np.cumsum(pool.size[ids]), np.cumsum(size[some])
            upto = np.searchsorted(ends, last, side="right")
            if len(ids) != upto[-1] or not (ends[upto - 1] == last).all():  # a word whose tokens have other bytes
                single = [np.array(x, dtype=np.int32) for x in encode([words[k] for k in some.tolist()])]
                ids, upto = np.concatenate(single), np.cumsum([len(x) for x in single])
            held.append(ids)
            counts.append(np.diff(upto, prepend=0))
        return np.concatenate(held), np.concatenate(counts)

    def links(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where tokens of words with equal bytes end (A, B and both), and word and pair of each link."""
        word = np.repeat(np.arange(len(n_a)), n_a)
        end_a, end_b = np.cumsum(self.pool_a.size[a]), np.cumsum(self.pool_b.size[b])
        # A link ends where either token does; both lists ascend.
        both = end_a[_within(end_a, end_b)]
        each = np.sort(np.concatenate([end_a, end_b[~_within(end_b, end_a)]]), kind="stable")
        of_a, of_b = np.searchsorted(end_a, each), np.searchsorted(end_b, each)
        return end_a, end_b, both, word[of_a], a[of_a].astype(np.int64) * self.n_b + b[of_b]

    def aligned(self, words: pa.Array) -> Words:
        """Tokens, groups and links of distinct words."""
        a, n_a, b, n_b = self.ids(words)
        n = len(words)
        buf, at = flat_utf8(words)
        size = np.diff(at)
        good = np.ones(n, dtype=bool)
        for pool, ids, count in ((self.pool_a, a, n_a), (self.pool_b, b, n_b)):
            good &= _sums(pool.size[ids], np.append(0, np.cumsum(count))) == size
        for pool, ids, count in ((self.pool_a, a, n_a), (self.pool_b, b, n_b)):
            same = pool.take(ids[np.repeat(good, count)]) == (buf if good.all() else buf[np.repeat(good, size)])
            if not same.all():
                good[np.repeat(np.flatnonzero(good), size[good])[~same]] = False
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
        end_a, end_b, both, word, pair = self.links(a, n_a, b, n_b)
        parts = [pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, np.searchsorted(end, both, side="right")),
                                                              pool.names.take(pa.array(ids))), _text(","))
                 for pool, ids, end in ((self.pool_a, a, end_a), (self.pool_b, b, end_b))]
        joined = pc.binary_join_element_wise(*parts, _text("|"))
        n_groups = np.bincount(np.repeat(np.arange(n), n_a)[np.searchsorted(end_a, both)], minlength=n)
        groups = pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n_groups)), joined), _text(";"))
        groups = pc.binary_join_element_wise(groups, _text(""), _text(";"))  # a word's end is a group's
        return Words(good, a, n_a, b, n_b, n_groups, groups, word, pair)


def _within(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the ascending numbers ``some`` are among ``others``, ascending too."""
    if not len(others):
        return np.zeros(len(some), dtype=bool)
    return others[np.minimum(np.searchsorted(others, some), len(others) - 1)] == some


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


class _Pool:
    """Bytes of a vocabulary's entries one after another, and their ids in decimal."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.names = pa.array([str(i) for i in range(len(entries))], pa.large_string())

    def take(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the entries, one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(path_a, path_b)


# Minimal perfect hash -------------------------------------------------------------------------


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Indexes 0 to n - 1 of n distinct keys: the rank of the bit that a key has alone at its level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(bits.sum()) for bits in levels]
        self.base = np.cumsum([0, *counts])
        self.rank = [np.cumsum(bits) - bits for bits in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            place = _spread(keys, len(levels)) % np.uint64(ROOM * len(keys))
            alone = np.bincount(place.astype(np.int64), minlength=ROOM * len(keys)) == 1
            levels.append(alone)
            keys = keys[~alone[place.astype(np.int64)]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys that are not of the set, any index for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            place = (_spread(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[place]
            out[left[here]] = self.base[k] + self.rank[k][place[here]]
            left = left[~here]
        return out

    def dumps(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype="<i8").tobytes()
        return sizes + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        levels, at = [], 8 * (n + 1)
        for size in sizes.tolist():
            held = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, held, at), count=size).astype(bool))
            at += held
        return cls(levels)


# Passes ---------------------------------------------------------------------------------------

FIRST = ("part long, kind int, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "words binary, lengths binary, codes binary, sizes binary, pairs binary, counts binary")


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 on, byte by byte of all of them, compressed."""
    wide = np.ascontiguousarray(values, dtype="<i8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T[:width])
    return np.array([len(wide), width], dtype="<i8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<i8", 2).tolist()
    planes = np.frombuffer(pa.decompress(data[16:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((8, n), dtype=np.uint8)
    out[:width] = planes
    return np.ascontiguousarray(out.T).view("<i8").reshape(n)


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of words, and their lengths, compressed."""
    buf, at = flat_utf8(words)
    return (np.array([len(buf)], dtype="<i8").tobytes() + pa.compress(buf.tobytes(), "zstd", asbytes=True),
            pack(np.diff(at)))


def unpack_words(data: bytes, lengths: bytes) -> pa.Array:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    bounds = np.append(0, np.cumsum(unpack(lengths)))
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds),
                                            pa.decompress(data[8:], n, "zstd"))


def first_pass(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (kind 2, numbered by ``place`` in their part) and, for each part, one of its words, the texts'
    numbers of words and the distinct pairs with counts (kind 0)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(path_a, path_b)
        schema = None
        for k, batch in enumerate(_parts(batches, "text", PART_BYTES)):
            part = (TaskContext.get().partitionId() << 32) + k
            words, at = tools.cut(batch.column("text"))
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy()
            found = tools.aligned(coded.dictionary)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            bad = np.zeros(len(at) - 1, dtype=bool)
            bad[doc[~found.good[code]]] = True
            code = code[~bad[doc]]
            at = np.append(0, np.cumsum(np.where(bad, 0, np.diff(at))))
            links = np.bincount(found.word, minlength=len(found.good))
            sha = group_digests(found.groups, code, at)
            times = np.bincount(code, minlength=len(found.good))
            pair, inverse = np.unique(found.pair, return_inverse=True)
            count = np.bincount(inverse, times[found.word], len(pair)).astype(np.int64)
            pair, count = pair[count > 0], count[count > 0]
            n = batch.num_rows
            own = {"id": batch.column("id"), "part": pa.array(np.full(n, part)), "kind": pa.array(np.full(n, 2, np.int32)),
                   "place": pa.array(np.arange(n, dtype=np.int32)), "groups_sha256": pa.array(sha, pa.string())}
            for name, values in (("n_a", found.n_a), ("n_b", found.n_b), ("n_groups", found.n_groups), ("n_links", links)):
                own[name] = pa.array(_sums(values[code], at))
            used = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]  # the most frequent first
            rank = np.zeros(len(times), dtype=np.int64)
            rank[used] = np.arange(len(used))
            blob, lengths = pack_words(coded.dictionary.take(pa.array(used)))
            packed = {"words": blob, "lengths": lengths, "codes": pack(rank[code]), "sizes": pack(np.diff(at)),
                      "pairs": pack(np.diff(pair, prepend=0)), "counts": pack(count)}
            head = {"part": pa.array([part]), "kind": pa.array([0], pa.int32())} | {
                c: pa.array([v], pa.binary()) for c, v in packed.items()}
            schema = schema or pa.schema([batch.schema.field("id"), ("part", pa.int64()), ("kind", pa.int32()),
                                          ("place", pa.int32()),
                                          *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                                          ("groups_sha256", pa.string()), *((c, pa.binary()) for c in packed)])
            for made, size in ((own, n), (head, 1)):
                yield pa.RecordBatch.from_arrays(
                    [made[f.name] if f.name in made else pa.nulls(size, f.type) for f in schema], schema=schema)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {FIRST}")


def group_digests(groups: pa.Array, code: np.ndarray, at: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups, a few texts' strings at a time; an empty string for a text without tokens."""
    out, step = [], 64
    for k in range(0, len(at) - 1, step):
        bounds = at[k:k + step + 1]
        text, ends = flat_utf8(groups.take(pa.array(code[bounds[0]:bounds[-1]])))
        ends = ends[bounds - bounds[0]].tolist()
        out += [hashlib.sha256(text[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:])]
    return out


def _ints(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(kind.to_pandas_dtype())))


def _one(flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all of ``flat``."""
    return _ints(flat, np.array([0, len(flat)]), kind)


def _parts(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of ``column``: small ones put together, large ones cut."""
    held, size = [], 0
    for batch in slices(batches, column, limit):
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def _shard_of(pairs: np.ndarray, n_b: int) -> np.ndarray:
    return (_spread(pairs % n_b, 99) % np.uint64(SHARDS)).astype(np.int64)


def by_shard(aligned: DataFrame, n_b: int) -> DataFrame:
    """(part, shard, pairs, counts): each part's pairs, one row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pair, count = (unpack(batch.column(c)[row].as_py()) for c in ("pairs", "counts"))
                pair = np.cumsum(pair)
                shard = _shard_of(pair, n_b)
                order = np.argsort(shard, kind="stable")
                held, first = np.unique(shard[order], return_index=True)
                at = np.append(first, len(pair))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(held), batch.column("part")[row].as_py())),
                    "shard": pa.array(held.astype(np.int32)), "pairs": _ints(pair[order], at, pa.int64()),
                    "counts": _ints(count[order], at, pa.int64())})

    return aligned.where("kind = 0").select("part", "pairs", "counts").mapInArrow(
        run, "part long, shard int, pairs array<long>, counts array<long>")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    for table, bounds in whole_groups(batches, keys):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield table.slice(a, b - a).combine_chunks()


def hashes(pairs: DataFrame) -> DataFrame:
    """(shard, hash, pairs): the minimal perfect hash of each shard's distinct pairs, and these by their indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["shard"]):
            keys = group.column("pair").to_numpy()
            made = PerfectHash.of(keys)
            ordered = np.empty_like(keys)
            ordered[made.index(keys)] = keys
            yield pa.RecordBatch.from_pydict({
                "shard": group.column("shard")[:1].combine_chunks(), "hash": pa.array([made.dumps()], pa.binary()),
                "pairs": _one(ordered, pa.int64())})

    distinct = pairs.select("shard", F.explode("pairs").alias("pair")).distinct()
    return distinct.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "shard int, hash binary, pairs array<long>")


def _with_heads(rows: DataFrame, heads: DataFrame, nodes: int) -> DataFrame:
    """Rows (shard, node, ...) by shard and node, and before each node's the shard's row of ``heads`` (kind 0)."""
    spread = heads.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)))).withColumn("kind", F.lit(0))
    return (rows.withColumn("kind", F.lit(1)).unionByName(spread, allowMissingColumns=True)
            .repartition("shard", "node").sortWithinPartitions("shard", "node", "kind"))


def _streams(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The rows one after another, each as a batch, and whether a new group begins with it."""
    last = None
    for batch in batches:
        for k in range(batch.num_rows):
            now = tuple(batch.column(c)[k].as_py() for c in keys)
            yield now != last, batch.slice(k, 1)
            last = now


def _array(row: pa.RecordBatch, name: str) -> np.ndarray:
    return row.column(name)[0].values.to_numpy()


def vectors(pairs: DataFrame, heads: DataFrame, nodes: int) -> DataFrame:
    """(shard, node, vector): the counts of a node's parts, dense by the shard's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, total = None, None, None
        for new, row in _streams(batches, ["shard", "node"]):
            if new:
                if key is not None:
                    yield _vector(key, total)
                key = (row.column("shard")[0].as_py(), row.column("node")[0].as_py())
                own = PerfectHash.loads(row.column("hash")[0].as_py())
                total = np.zeros(own.base[-1], dtype=np.int64)
            else:
                total[own.index(_array(row, "pairs"))] += _array(row, "counts")  # a part has each pair once
        if key is not None:
            yield _vector(key, total)

    return _with_heads(pairs, heads.select("shard", "hash"), nodes).mapInArrow(run, "shard int, node int, vector array<long>")


def _vector(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([key[0]], pa.int32()), "node": pa.array([key[1]], pa.int32()),
                                       "vector": _one(total, pa.int64())})


def summed(partial: DataFrame) -> DataFrame:
    """One level up the tree: the sums of up to ``FAN`` nodes' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for new, row in _streams(batches, ["shard", "up"]):
            if new:
                if key is not None:
                    yield _vector(key, total)
                key, total = (row.column("shard")[0].as_py(), row.column("up")[0].as_py()), 0
            total = total + _array(row, "vector")
        if key is not None:
            yield _vector(key, total)

    rows = partial.select("shard", F.expr(f"node div {FAN}").cast("int").alias("up"), "vector")
    return rows.repartition("shard", "up").sortWithinPartitions("shard", "up").mapInArrow(
        run, "shard int, node int, vector array<long>")


def looked_up(pairs: DataFrame, counted: DataFrame, nodes: int, n_b: int) -> DataFrame:
    """(part, pairs, counts, best): the corpus's count of each of a part's pairs, and whether its B id has none higher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new, row in _streams(batches, ["shard", "node"]):
            if new:
                own = PerfectHash.loads(row.column("hash")[0].as_py())
                held, vector = _array(row, "held"), _array(row, "vector")
                b = held % n_b
                order = np.argsort(b, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(b[order]) != 0))
                high = np.empty_like(vector)
                high[order] = np.repeat(np.maximum.reduceat(vector[order], first), np.diff(np.append(first, len(b))))
                continue
            pair = _array(row, "pairs")
            at = own.index(pair)
            if not (held[at] == pair).all():
                raise RuntimeError("a pair is not in its shard's hash")
            yield pa.RecordBatch.from_pydict({
                "part": row.column("part"), "pairs": row.column("pairs"), "counts": _one(vector[at], pa.int64()),
                "best": _one(vector[at] == high[at], pa.int8())})

    return _with_heads(pairs.drop("counts"), counted, nodes).mapInArrow(
        run, "part long, pairs array<long>, counts array<long>, best array<tinyint>")


def second_pass(aligned: DataFrame, found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with the sums over their links, from their part's words aligned again and its pairs' counts."""
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = aligned.drop("pairs", "counts")
    rows = out.unionByName(found.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(path_a, path_b)
        for group in _grouped(batches, ["part"]):
            kind = group.column("kind").to_numpy()
            here = group.filter(pa.array(kind == 1))
            pair, count, best = (here.column(c).combine_chunks().values.to_numpy() if here.num_rows else
                                 np.zeros(0, np.int64) for c in ("pairs", "counts", "best"))
            order = np.argsort(pair)
            packed = {c: group.column(c)[0].as_py() for c in ("words", "lengths", "codes", "sizes")}
            code, bounds = unpack(packed["codes"]), np.append(0, np.cumsum(unpack(packed["sizes"])))
            ids = tools.ids(unpack_words(packed["words"], packed["lengths"]))
            *_, word, linked = tools.links(*ids)
            at = order[np.searchsorted(pair[order], linked)]
            of_word = np.append(0, np.cumsum(np.bincount(word, minlength=len(ids[1]))))
            times = [_sums(x[at].astype(np.int64), of_word) for x in (best, count)]
            docs = group.filter(pa.array(kind == 2)).combine_chunks()
            docs = docs.take(pc.sort_indices(docs.column("place")))
            sums = {"n_best": pa.array(_sums(times[0][code], bounds)), "count_sum": pa.array(_sums(times[1][code], bounds))}
            yield from pa.table([sums[c] if c in sums else docs.column(c) for c in kept], names=kept) \
                .combine_chunks().to_batches()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(
        run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
             "groups_sha256 string")


def pair_table(aligned: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame, int]:
    """The parts' pairs by shard and tree node, each shard's hash, pairs and counts, and how many nodes there are."""
    parts = aligned.where("kind = 0").count()
    nodes = max(1, -(-parts // FAN))
    pairs = cut(by_shard(aligned, n_b).withColumn("node", F.pmod(F.xxhash64("part"), F.lit(nodes)).cast("int")), "pairs")
    heads = cut(hashes(pairs), "hashes")
    sums, left = cut(vectors(pairs, heads, nodes), "vectors"), nodes
    while left > 1:
        sums, left = cut(summed(sums), "vectors"), -(-left // FAN)
    counted = cut(heads.withColumnRenamed("pairs", "held").join(sums.select("shard", "vector"), "shard"), "counted")
    return pairs, counted, nodes


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    n_b = aligner(path_a, path_b).n_b
    aligned = cut(first_pass(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs, counted, nodes = pair_table(aligned, n_b)
    found = looked_up(pairs, counted, nodes, n_b)
    return second_pass(aligned, found, path_a, path_b).withColumnRenamed("id", id_col)
