"""Byte-level BPE by merge replay: each slice of the corpus applies all merges in rank order over an inverted index of pairs."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, gathered, released, slices

#: Texts of about so many bytes share one index; it bounds a task's memory, and a longer text has an index of its own.
REPLAY_BYTES = 2 << 20
NO_RANK = np.int64(1) << 40


@dataclass
class Vocabulary:
    """Token bytes by id, the id of each byte, and all mergeable pairs (left id << 32 | right id, ascending) with their ranks."""

    tokens: list[bytes]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pattern: str


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a file of base64 tokens and ranks. The vocabulary has a fixed size, so it is sent to all executors."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for token, rank in ranks.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    return Vocabulary(tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int64), keys, np.array([pairs[int(k)] for k in keys], np.int64), pattern)


def _ranks_of(voc: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left << 32 | right
    at = np.minimum(np.searchsorted(voc.pair_keys, key), len(voc.pair_keys) - 1)
    return np.where(voc.pair_keys[at] == key, voc.pair_ranks[at], NO_RANK)


def replay(words: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and each word's number of tokens.

    The index maps a pair's rank to the positions where that pair stands. Ranks are taken from a heap in ascending order; each
    step merges the leftmost such pair of every word at once and enters the pairs that its neighbours now form. A pair of lower
    rank formed that way comes next, as in encoding word by word.
    """
    size = np.array([len(w) for w in words], np.int64)
    n = int(size.sum())
    if not n:
        return np.zeros(0, np.int64), size
    symbol = voc.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[end[size > 0] - 1] = -1
    before[(end - size)[size > 0]] = -1
    alive = np.ones(n, bool)
    left = np.flatnonzero(after >= 0)
    rank = _ranks_of(voc, symbol[left], symbol[left + 1])
    pair_rank = np.full(n, NO_RANK)  # of the pair that starts at a position
    pair_rank[left] = rank
    keep = rank < NO_RANK
    left, rank = left[keep], rank[keep]
    order = np.argsort(rank, kind="stable")
    left, rank = left[order], rank[order]
    first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
    index: dict[int, list[np.ndarray]] = {int(rank[a]): [left[a:b]] for a, b in zip(first, np.r_[first[1:], len(rank)], strict=True)}
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r, None)
        if found is None:
            continue
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[alive[at] & (pair_rank[at] == r)]
        if not len(at):
            continue
        w = word[at]
        lead = np.r_[True, w[1:] != w[:-1]]
        if not lead.all():
            index[r] = [at[~lead]]
            heapq.heappush(heap, r)
            at = at[lead]
        gone = after[at]
        then = after[gone]
        symbol[at] = r
        after[at] = then
        alive[gone] = False
        pair_rank[gone] = NO_RANK
        has = then >= 0
        before[then[has]] = at[has]
        new = np.full(len(at), NO_RANK)
        new[has] = _ranks_of(voc, symbol[at[has]], symbol[then[has]])
        pair_rank[at] = new
        prior = before[at]
        back = prior >= 0
        prior = prior[back]
        made = _ranks_of(voc, symbol[prior], symbol[at[back]])
        pair_rank[prior] = made
        spot, new = np.concatenate([at, prior]), np.concatenate([new, made])
        some = new < NO_RANK
        if some.any():
            spot, new = spot[some], new[some]
            order = np.argsort(new, kind="stable")
            spot, new = spot[order], new[order]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            for part, k in zip(np.split(spot, cuts), new[np.r_[0, cuts]].tolist(), strict=True):
                part.sort()
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(heap, k)
    return symbol[alive], np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Encodes slices of texts; split pieces that are tokens themselves are not merged."""

    def __init__(self, voc: Vocabulary):
        import regex

        self.voc, self.split = voc, regex.compile(voc.pattern)
        self.known = {t: i for i, t in enumerate(voc.tokens) if t}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        seen: dict[str, int] = {}
        rows = []
        for t in texts:
            pieces = self.split.findall(t)
            for p in pieces:
                if p not in seen:
                    seen[p] = len(seen)
            rows.append(np.fromiter(map(seen.__getitem__, pieces), np.int64, len(pieces)))
        raw = [p.encode() for p in seen]
        whole = np.fromiter((self.known.get(p, -1) for p in raw), np.int64, len(raw))
        rest = np.flatnonzero(whole < 0)
        ids, counts = replay([raw[i] for i in rest.tolist()], self.voc)
        size = np.ones(len(raw), np.int64)
        size[rest] = counts
        start = np.cumsum(size) - size
        pool = np.empty(int(size.sum()), np.uint32)
        single = np.flatnonzero(whole >= 0)
        pool[start[single]] = whole[single]
        pool[np.repeat(start[rest] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        out = []
        for r in rows:
            n = size[r]
            total = int(n.sum())
            out.append(pool[np.repeat(start[r] - (np.cumsum(n) - n), n) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.voc.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, voc: Vocabulary, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text.

    No shuffle: each task replays the merges over its own slices of the corpus. Null and empty texts have no tokens; repeated
    rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in gathered(batches, "_text", REPLAY_BYTES):
            for part in slices(batch, "_text", 2 * REPLAY_BYTES):
                rows = encoder.encode([t or "" for t in part.column("_text").to_pylist()])
                decoded = [encoder.decode(r) for r in rows]
                cols = [
                    part.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                if with_ids:
                    cols += [pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return bounded_batches(docs).select(F.col(key), F.col(text).alias("_text")).mapInArrow(released(run), schema)


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes of every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary(), with_ids=False)
