"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces of a model file are put into a double-array trie of UTF-8 bytes (``base``, ``check``, ``value``). A text gets a
whitespace marker in front and for each blank; the best path maximises the sum of log scores, the longer piece first on ties;
a character that no single-character piece covers costs the least score less UNKNOWN_COST and falls back to byte pieces.
Scores: those of the file if it is a unigram model; a BPE file has ranks instead, which become log probabilities by Zipf's
law. Decoding joins the pieces' bytes, turns markers into blanks and drops the first one.

No piece has a marker behind another character (checked on loading; else a text is one segment), so a text falls apart into
segments of markers and what follows, and also at characters that stand in no piece. Viterbi runs over all segments of a
batch that are new to the task at once, position by position in numpy; short segments met before (CACHED_BYTES at most) are looked up.
This changes nothing in the result: a path over the text is the paths over its segments.

Defined cases: null and empty texts have no ids; markers in the text itself decode as blanks (``round_trip`` is false then);
repeated rows give repeated rows; an empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK, UNKNOWN_COST, BATCH_CHARS, WIDE, STRIDE = "▁", 10.0, 3_000_000, 64, 1 << 15
#: Bytes of segments kept by a task, with OVERHEAD for the objects of each; a segment is at most WIDE bytes.
CACHED_BYTES, OVERHEAD = 96 << 20, 180
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_WIDTH = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int64)  # of a character, by its first byte


class DoubleArray:
    """Trie in two arrays: node ``t = base[s] + byte + 1`` is a child of s if ``check[t] == s``. value: a key's number or -1."""

    def __init__(self, keys: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in keys.items():
            at = 0
            for byte in key:
                if byte not in trie[at]:
                    trie[at][byte] = len(trie)
                    trie.append({})
                at = trie[at][byte]
            ends[at] = number
        size, window = 2 * len(trie) + 8192, 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], low, queue = -2, {True: 1, False: 1}, [(0, 0)]
        for node, slot in queue:
            value[slot] = ends.get(node, -1)
            codes = np.array(sorted(trie[node]), np.int64) + 1
            if not len(codes):
                continue
            several = len(codes) > 1
            while True:
                b = max(0, low[several] - int(codes[0]))
                if b + window + 512 > len(check):
                    base, check, value = (np.append(x, np.full(len(x), fill, np.int32)) for x, fill in ((base, 0), (check, -1), (value, -1)))
                fits = check[b + codes[0] : b + codes[0] + window] == -1
                for c in codes[1:]:
                    fits &= check[b + c : b + c + window] == -1
                if fits.any():
                    break
                low[several] += window // 2  # nodes like this one found hardly a place here; later ones don't look again
            b += int(np.argmax(fits))
            base[slot], check[b + codes] = b, slot
            queue += [(trie[node][int(c) - 1], b + int(c)) for c in codes]
        pad = np.full(257, -1, np.int32)
        self.base, self.check, self.value = np.append(base, np.zeros(257, np.int32)), np.append(check, pad), np.append(value, pad)
        self.longest = max(map(len, keys), default=0)

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, number) of the keys that begin at ``start``, short ones first."""
        s = 0
        for p in range(start, len(data)):
            t = int(self.base[s]) + data[p] + 1
            if self.check[t] != s:
                return
            s = t
            if self.value[s] >= 0:
                yield p + 1, int(self.value[s])


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) in order of the ids; whether the scores are a unigram model's."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == 1


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log probabilities from ranks: a normal piece of rank r has 1/r of the first one's share."""
    order = sorted((-score, k) for k, (_, score, kind) in enumerate(pieces) if kind in (_NORMAL, _USER))
    total = math.log(sum(1 / r for r in range(1, len(order) + 1)) or 1)
    scores = [0.0] * len(pieces)
    for rank, (_, k) in enumerate(order, 1):
        scores[k] = -math.log(rank) - total
    return scores


class Pieces:
    """A vocabulary of (piece, type) with log scores."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: list[float]):
        used = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _USER) and p}
        self.trie = DoubleArray({p.encode(): k for p, k in used.items()})
        self.score = np.array(scores, np.float64)
        self.unknown = next((k for k, x in enumerate(pieces) if x[2] == _UNKNOWN), 0)
        self.unknown_score = min((scores[k] for k in used.values()), default=0.0) - UNKNOWN_COST
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.fallback = len(self.byte_ids) == 256
        self.is_byte = np.array([kind == _BYTE for _, _, kind in pieces], bool)
        self.plain = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() if kind in (_NORMAL, _USER) else b" \xe2\x81\x87 " if kind == _UNKNOWN else b"" for p, _, kind in pieces]
        self.kind = "<u2" if len(pieces) <= 1 << 16 else "<u4"
        self.splits = not any(MARK in p.lstrip(MARK) for p in used)
        self.lines = self.splits and not any("\n" in p for p in used)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return [MARK + text.replace(" ", MARK)]
        if not self.lines or "  " in text or " \n" in text or MARK in text or text[-1] == " " or text[0] == " ":
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK))
        parts = text.replace(" ", " " + MARK).replace("\n", " \n ").split(" ")
        parts[0] = MARK + parts[0]
        return parts

    def viterbi(self, data: bytes) -> list[int]:
        """The ids of one segment, step by step."""
        n = len(data)
        best, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
        s = 0
        while s < n:
            width, alone = int(_WIDTH[data[s]]), False
            for end, k in self.trie.prefixes(data, s):
                alone |= end - s == width
                if best[s] + self.score[k] > best[end]:
                    best[end], back[end] = best[s] + self.score[k], (s, k)
            end = min(n, s + width)
            if not alone and best[s] + self.unknown_score > best[end]:
                best[end], back[end] = best[s] + self.unknown_score, (s, -1)
            s = end
        ids: list[int] = []
        while n:
            s, k = back[n]
            ids += [k] if k >= 0 else [self.byte_ids[x] for x in reversed(data[s:n])] if self.fallback else [self.unknown]
            n = s
        return ids[::-1]

    def viterbi_many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many segments, all positions of one number at a time."""
        n, lens = len(words), np.array([len(w) for w in words])
        size = int(lens.max())
        text = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size).T.astype(np.int64)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        start, piece = np.zeros((size + 1, n), np.int16), np.full((size + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(size):
            here = np.flatnonzero((best[s] > -np.inf) & (lens > s))
            if not len(here):
                continue
            width = _WIDTH[text[s, here]]
            alone = np.zeros(len(here), bool)
            at, node = np.arange(len(here)), np.zeros(len(here), np.int64)
            for p in range(s, min(size, s + self.trie.longest)):
                t = base[node] + text[p, here[at]] + 1
                ok = (check[t] == node) & (lens[here[at]] > p)
                at, node = at[ok], t[ok]
                if not len(at):
                    break
                has = value[node] >= 0
                if has.any():
                    a, k = at[has], value[node[has]]
                    alone[a[width[a] == p + 1 - s]] = True
                    w = here[a]
                    total = best[s, w] + self.score[k]
                    up = total > best[p + 1, w]
                    w = w[up]
                    best[p + 1, w], start[p + 1, w], piece[p + 1, w] = total[up], s, k[up]
            w = here[~alone]
            if len(w):
                end = np.minimum(lens[w], s + width[~alone])
                total = best[s, w] + self.unknown_score
                up = total > best[end, w]
                w, end = w[up], end[up]
                best[end, w], start[end, w], piece[end, w] = total[up], s, -1
        columns, rounds, at = np.arange(n), [], lens.copy()
        while at.any():
            rounds.append((np.where(at > 0, piece[at, columns], -2), start[at, columns], at))
            at = np.where(at > 0, start[at, columns], 0)
        found = np.stack([r[0] for r in rounds[::-1]]).T
        out = []
        lost = (found == -1).any(axis=1)
        for j, row in enumerate(found):
            if lost[j]:
                out.append(self.viterbi(words[j]))
            else:
                out.append(row[row >= 0])
        return out

    def viterbi_long(self, data: bytes) -> np.ndarray:
        """The ids of a long segment: the trie is walked from STRIDE positions at once, then their pieces are tried in order."""
        n = len(data)
        text = np.append(np.frombuffer(data, np.uint8).astype(np.int64), np.full(self.trie.longest + 1, -1))
        from_, piece = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        ahead = STRIDE + max(4, self.trie.longest) + 1
        best = [0.0] + [-math.inf] * ahead
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for low in range(0, n, STRIDE):
            here = np.arange(low, min(n, low + STRIDE))
            here = here[(text[here] & 0xC0) != 0x80] if low else here[((text[here] & 0xC0) != 0x80) | (here == 0)]
            width = _WIDTH[text[here]]
            alone, at, node = np.zeros(len(here), bool), np.arange(len(here)), np.zeros(len(here), np.int64)
            starts, ends, ids = [], [], []
            for p in range(self.trie.longest):
                byte = text[here[at] + p]
                t = base[node] + byte + 1
                ok = (byte >= 0) & (check[t] == node)
                at, node = at[ok], t[ok]
                if not len(at):
                    break
                has = value[node] >= 0
                starts.append(here[at[has]])
                ends.append(starts[-1] + p + 1)
                ids.append(value[node[has]])
                alone[at[has][width[at[has]] == p + 1]] = True
            lone = here[~alone]
            starts, ends, ids = np.concatenate([*starts, lone]), np.concatenate([*ends, np.minimum(n, lone + width[~alone])]), np.concatenate([*ids, np.full(len(lone), -1)])
            order = np.argsort(starts, kind="stable")
            starts, ends, ids = starts[order], ends[order], ids[order]
            gains = np.where(ids >= 0, score[ids], self.unknown_score)
            came = {}
            for k, (s, e, g) in enumerate(zip((starts - low).tolist(), (ends - low).tolist(), gains.tolist(), strict=True)):
                total = best[s] + g
                if total > best[e]:
                    best[e], came[e] = total, k
            if came:
                to, how = np.fromiter(came, np.int64, len(came)), np.fromiter(came.values(), np.int64, len(came))
                from_[to + low], piece[to + low] = starts[how], ids[how]
            best = best[STRIDE:] + [-math.inf] * STRIDE
        out: list[int] = []
        while n:
            s, k = int(from_[n]), int(piece[n])
            out += [k] if k >= 0 else [self.byte_ids[x] for x in reversed(data[s:n])] if self.fallback else [self.unknown]
            n = s
        return np.array(out[::-1], self.kind)

    def learn(self, segments: set[str]) -> list[str]:
        """Sees to the ids of all segments in ``known``; the long ones among them, which are not to be kept."""
        if self.held > CACHED_BYTES:
            self.known.clear()
            self.held = 0
        new = [(s, s.encode("utf-8", "surrogatepass")) for s in segments if s not in self.known]
        for low, high in ((0, 12), (12, 24), (24, WIDE)):
            some = [x for x in new if low < len(x[1]) <= high]
            for k in range(0, len(some), 1 << 15):
                part = some[k : k + (1 << 15)]
                for (s, b), ids in zip(part, self.viterbi_many([b for _, b in part]), strict=True):
                    self.known[s] = x = np.asarray(ids, self.kind).tobytes()
                    self.held += len(b) + len(x) + OVERHEAD
        long = [(s, b) for s, b in new if not b or len(b) > WIDE]
        for s, b in long:
            self.known[s] = self.viterbi_long(b).tobytes()
        return [s for s, _ in long]

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; about BATCH_CHARS characters are worked on at a time."""
        k = 0
        while k < len(texts):
            cut, held, new, chars = [], [], set(), 0
            while k < len(texts) and (not held or chars < BATCH_CHARS):
                cut = self.segments(texts[k] or "")
                held.append(cut)
                new.update(cut)
                chars += len(texts[k] or "")
                k += 1
            long, known = self.learn(new), self.known
            found = [b"".join([known[s] for s in cut]) for cut in held]
            for s in long:
                del known[s]
            for x in found:
                yield np.frombuffer(x, self.kind).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        plain = self.plain
        text = b"".join([plain[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[tuple[str, bool], Pieces] = {}


def load(path: str) -> Pieces:
    """The vocabulary of a model file; a worker keeps it, and the segments it has met, from task to task."""
    if path not in _LOADED:
        pieces, unigram = read_model(path)
        _LOADED[path] = Pieces(pieces, [score for _, score, _ in pieces] if unigram else zipf_scores(pieces))
    return _LOADED[path]


SCHEMA = "doc_id long, ids array<int>, n_ids long, n_byte_ids long, decoded_sha256 string, round_trip boolean"


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each whole text, and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = batch.column(1).to_pylist()
                ids, hashes, same, spelled = [], [], [], []
                for text, x in zip(texts, model.encode_batch(texts), strict=True):
                    back = model.decode(x)
                    ids.append(x)
                    hashes.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(back == (text or ""))
                    spelled.append(int(model.is_byte[x].sum()))
                sizes = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int64()), pa.array(spelled, pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
