"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets the dummy prefix and ``U+2581`` for each space. No piece of the
model continues from another character into ``U+2581``, nor from a letter into
another kind of character (both are checked when a model is opened), so the text
falls into words (a run of ``U+2581`` and the letters, or the other characters,
that follow it) that never merge with each other. Each distinct word of a batch
is encoded once: all their symbols lie in one flat numpy array; every round finds
the best pair of each word (segmented minimum of the pairs' ranks), merges its
leftmost non-overlapping places in all words at once, compacts the array and
ranks the pairs that changed; words without a pair leave. Rounds go on until
none is left.

The library merges one place at a time, so merging several places of a word in
one round is only right while no merge makes a pair that ranks better than the
one being merged. Each round checks that for every merged place, and in words
where it fails merges the leftmost place alone; so results equal the library's.

Characters that are no piece become their UTF-8 byte pieces. Decoding gathers
the bytes of all pieces of a batch from one pool.

Defined cases: NULL and empty texts have no ids and decode to the empty string;
repeated rows give repeated results; an empty table gives an empty result; only
the id and text columns are read, so other columns cannot clash. Texts are
encoded whole whatever their length; memory is bounded by a few MB of texts and
the longest text of a task, plus a cache of ``CACHE_WORDS`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.flat import slices

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
NO_PAIR = np.int64(1) << 40
CACHE_WORDS = 200_000


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("Ａ ﬁ") != f"{SPACE}Ａ{SPACE}ﬁ":
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        n = sp.get_piece_size()
        surface = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(SPACE in surface[i].lstrip(SPACE) or
               (surface[i].startswith(SPACE * 2) and surface[i].strip(SPACE)) for i in normal):
            raise ValueError("a piece crosses a word boundary")
        # Letters that some piece joins to a character of another kind count as that kind.
        inside = [surface[i].lstrip(SPACE) for i in normal]
        odd = {c for p in inside for a, b in zip(p, p[1:])
               if bool(LETTER.match(a)) != bool(LETTER.match(b)) for c in (a, b) if LETTER.match(c)}
        odd_class = "".join(map(re.escape, sorted(odd)))
        letters, others = f"[^\\W\\d_{odd_class}]", f"(?!{SPACE})[\\W\\d_{odd_class}]"
        if any(re.match(f"{letters}+{others}|(?:{others})+{letters}", p) for p in inside):
            raise ValueError("a piece joins letters and other characters")
        self.words = re.compile(f"{SPACE}*(?:{letters}+|(?:{others})+)|{SPACE}+")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)

        ids = {surface[i]: i for i in normal}
        # Characters that only occur inside longer pieces get numbers above the vocabulary.
        inner = sorted({c for p in ids for c in p} - set(ids))
        symbols = ids | {c: n + k for k, c in enumerate(inner)}
        self.vocab = n
        self.n_symbols = n + len(inner)
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        better = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        pairs = sorted((symbols[p[:k]] * self.n_symbols + symbols[p[k:]], i, better[sp.get_score(i)])
                       for p, i in ids.items() for k in range(1, len(p))
                       if p[:k] in symbols and p[k:] in symbols)
        self.keys = np.array([x[0] for x in pairs], dtype=np.int64)
        self.made = np.array([x[1] for x in pairs], dtype=np.int32)
        self.rank = np.array([x[2] for x in pairs], dtype=np.int64)

        out = [b""] * n
        for i in normal:
            out[i] = surface[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        out[sp.unk_id()] = " ⁇ ".encode()
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.opens = np.array([p.startswith(SPACE) for p in surface])
        self.piece_len = np.array([len(x) for x in out], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.pool = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.cache: dict[str, bytes] = {}

    # encoding ---------------------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_PAIR if it makes no piece) and the piece it makes."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NO_PAIR), self.made[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as the bytes of 32-bit integers."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32)
        seg = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.char_id[chars].astype(np.int64)
        sym = np.where(sym < 0, -1 - chars.astype(np.int64), sym)  # below 0: no piece
        rank, made = self._pairs(sym, np.append(sym[1:], -1))
        rank[:-1][seg[:-1] != seg[1:]] = NO_PAIR
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, size)
            over = best == NO_PAIR
            if over.any():  # words without a pair leave
                done.append((seg[over], sym[over]))
                stay = ~over
                sym, seg, rank, made, best = sym[stay], seg[stay], rank[stay], made[stay], best[stay]
                if not len(sym):
                    break
            at = self._places(sym, seg, rank, made, best)
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            now = at - np.searchsorted(at, at)  # places after compaction: one symbol less for each merge before
            sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
            touched = np.concatenate([now, now[now > 0] - 1])
            right = np.minimum(touched + 1, len(sym) - 1)
            rank[touched], made[touched] = self._pairs(sym[touched], sym[right])
            rank[touched[(touched + 1 >= len(sym)) | (seg[touched] != seg[right])]] = NO_PAIR
        seg, sym = (np.concatenate([x[k] for x in done]) for k in (0, 1)) if done else (seg, sym)
        order = np.argsort(seg, kind="stable")
        seg, sym = self._with_bytes(seg[order], sym[order])
        cuts = 4 * np.searchsorted(seg, np.arange(len(words) + 1))
        data = sym.astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _places(self, sym, seg, rank, made, best) -> np.ndarray:
        """Left positions to merge in this round: per word the leftmost non-overlapping places of its best pair."""
        at = np.flatnonzero((rank == best) & (rank != NO_PAIR))
        new_run = np.append(True, (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]]))
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        word_first = np.append(True, seg[at[1:]] != seg[at[:-1]])
        if word_first.all():
            return at
        merged = np.zeros(len(sym) + 1, dtype=bool)
        merged[at] = True
        made_at = made[at]
        # What stands to the left once all merges left of it are made; to the right: as it is now.
        before = np.maximum(at - 1, 0)
        second = np.maximum(at - 2, 0)
        joined = (at >= 2) & merged[second] & (seg[second] == seg[at])
        left = np.where(joined, made[second], sym[before])
        has_left = (at >= 1) & (seg[before] == seg[at])
        after = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (seg[after] == seg[at])
        limit = best[at]
        bad = (has_left & (self._pairs(left, made_at)[0] <= limit)) | \
              (has_right & (self._pairs(made_at, sym[after])[0] <= limit))
        if not bad.any():
            return at
        return at[word_first | ~np.isin(seg[at], seg[at[bad]])]

    def _with_bytes(self, seg: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their UTF-8 bytes."""
        none = np.flatnonzero((sym < 0) | (sym >= self.vocab))
        if not len(none):
            return seg, sym
        inner = {i: c for c, i in enumerate(self.char_id.tolist()) if i >= self.vocab} \
            if (sym >= self.vocab).any() else {}
        utf8 = [chr(-1 - s if s < 0 else inner[s]).encode("utf-8", "replace") for s in sym[none].tolist()]
        times = np.ones(len(sym), dtype=np.int64)
        times[none] = [len(x) for x in utf8]
        seg, sym, spread = np.repeat(seg, times), np.repeat(sym, times), np.zeros(len(sym), dtype=bool)
        spread[none] = True
        sym[np.repeat(spread, times)] = self.byte_ids[np.frombuffer(b"".join(utf8), dtype=np.uint8)]
        return seg, sym

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        find = self.words.findall
        split = [find(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list({w for words in split for w in words})
        if new:
            cache.update(zip(new, self.encode_words(new)))
        return [np.frombuffer(b"".join([cache[w] for w in words]), dtype=np.int32) for words in split]

    # decoding ---------------------------------------------------------------------------

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The text of each row of ids."""
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        ids = np.concatenate([*rows, np.zeros(0, dtype=np.int32)])
        lens = self.piece_len[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.piece_at[ids] - (ends - lens), lens) + np.arange(total)
        data = self.pool[place].tobytes()
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        out, at = [], 0
        for row, n, a, b in zip(rows, counts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            skip = 1 if n and self.opens[row[0]] else 0  # the dummy prefix
            try:
                out.append(data[a + skip:b].decode())
            except UnicodeDecodeError:  # only of ids that no encoder made
                out.append(self._decode_loose(row, skip))
            at += n
        return out

    def _decode_loose(self, row: np.ndarray, skip: int) -> str:
        """Bytes that are no UTF-8 become U+FFFD one by one, as the library does."""
        out, run = [], bytearray()

        def flush():
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                del run[:k]

        for i in row.tolist():
            piece = self.pool[self.piece_at[i]:self.piece_at[i] + self.piece_len[i]].tobytes()
            if self.is_byte[i]:
                run.extend(piece)
            else:
                flush()
                out.append(piece.decode())
        flush()
        return "".join(out)[skip:]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in slices(batches, "text"):
            rows = m.encode(batch.column("text").to_pylist())
            offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets),
                                           pa.array(np.concatenate(rows).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(m.decode(rows), pa.string())],
                                             names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and digests of the ids and the decoded text."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
