"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one for each character; an agenda of adjacent pairs,
ordered by the score of the piece that a pair would make and then from the left,
says which two to merge next. Characters outside the vocabulary end as bytes. Many short
texts are merged side by side: their agendas are the rows of one array of ranks.

No piece of such a vocabulary holds a word start after another character (this is
looked up, not assumed), so no merge crosses a word's start and each stretch
from one word start to the next is encoded once and remembered for a while.

The work is in Arrow batches; every stretch that a batch brings anew is encoded
by the library too. Where the two differ, the library's ids are taken and the stretch is
counted in the document's ``n_disagreed``. A worker remembers each stretch as one string,
its ids in decimal joined by commas (a leading "!" marks a disagreement): one object per
stretch, which is what the ids digest needs anyway; ids are read back from it per document.
"""

from __future__ import annotations

import heapq
import re
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from auditlake.llm.common import arrow_map

SPACE = "▁"
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")
REMEMBERED = 600_000  # stretches kept by a worker before it starts afresh
KEPT_LENGTH = 64  # longer stretches aren't kept
SHORT = 48  # symbols up to which scanning beats a heap
MANY = 64  # stretches from which merging them side by side beats one after the other
NONE = 1 << 30  # the rank of a pair that no piece joins


# What a worker process has encoded before, by model file; it outlives a task.
_KNOWN: dict[str, tuple[MergeCodec, dict[str, str]]] = {}


class MergeCodec:
    """Vocabulary of one model file; ``encode`` and ``decode`` follow the library."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        special = {i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        names = sp.id_to_piece(list(range(size)))
        self.ids = {names[i]: i for i in range(size) if i not in special}
        order = sorted((-sp.get_score(i), piece) for piece, i in self.ids.items())
        ranks, last, rank = {}, None, -1
        for score, piece in order:  # pieces of one score share a rank, and the leftmost goes first
            rank += score != last
            last = score
            ranks[piece] = rank
        self.rank = ranks.get
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text_of = {i: piece.replace(SPACE, " ") for piece, i in self.ids.items()}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.decimal = [str(i) for i in range(size)]
        self._pairs(size)
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)

    def _pairs(self, size: int) -> None:
        """Sorted pairs of ids whose texts join to a piece, with its rank and id; ids of characters."""
        ids = self.ids
        joins = sorted(
            (ids[p[:k]] * size + ids[p[k:]], self.rank(p), i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        )
        self.size = size
        # One pair past all others, so that a search always finds a place.
        self.pair, ranks, joined = np.array([*joins, (size * size, NONE, 0)], np.int64).T.copy()
        self.pair_rank, self.pair_id = ranks.astype(np.int32), joined.astype(np.int32)
        self.id_of_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.id_of_char[ord(p)] = i

    def merged(self, symbols: list[str]) -> list[str]:
        return self._scanned(symbols) if len(symbols) <= SHORT else self._queued(symbols)

    def _scanned(self, symbols: list[str]) -> list[str]:
        """A short agenda is a list of ranks beside the symbols."""
        rank, none = self.rank, NONE
        agenda = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], none)
        return symbols

    def _queued(self, symbols: list[str]) -> list[str]:
        """A long one is a heap over linked symbols; entries gone stale are passed over."""
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [
            (r, i, a + b)
            for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            if (r := rank(a + b)) is not None
        ]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    pair = symbols[left] + symbols[right]
                    if (r := rank(pair)) is not None:
                        heapq.heappush(agenda, (r, left, pair))
        return [s for s in symbols if s is not None]

    def stretch_ids(self, stretch: str) -> list[int]:
        ids = []
        for piece in self.merged(list(stretch)):
            known = self.ids.get(piece)
            if known is None:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            else:
                ids.append(known)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair of ids makes, ``NONE`` where it makes none."""
        wanted = left.astype(np.int64) * self.size + right
        at = self.pair.searchsorted(wanted)
        return np.where(self.pair[at] == wanted, self.pair_rank[at], np.int32(NONE))

    def all_ids(self, stretches: list[str]) -> list[list[int]]:
        """``stretch_ids`` of each. Short ones whose characters are all pieces are merged side by
        side: rows of equally many symbols stand in one array beside the ranks of their pairs,
        each row merges its best pair, the leftmost of equals, and joins the rows one shorter."""
        out: list = [None] * len(stretches)
        n = np.fromiter(map(len, stretches), np.int64, len(stretches))
        first = self.id_of_char[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
        start = np.cumsum(n) - n
        unknown = np.concatenate([[0], np.cumsum(first < 0)])
        fit = (n > 0) & (n <= SHORT) & (unknown[start + n] == unknown[start])
        for r in np.flatnonzero(~fit).tolist():
            out[r] = self.stretch_ids(stretches[r])
        row, symbols, rank = np.zeros(0, np.int64), None, None
        for width in range(int(n[fit].max(initial=0)), 0, -1):
            new = np.flatnonzero(fit & (n == width))
            if len(new):
                own = first[start[new][:, None] + np.arange(width)]
                ranks = self._ranks(own[:, :-1], own[:, 1:])
                if len(row):
                    new, own, ranks = (np.concatenate(two) for two in ((row, new), (symbols, own), (rank, ranks)))
                row, symbols, rank = new, own, ranks
            if not len(row):
                continue
            here = np.arange(len(row))
            best = rank.argmin(axis=1) if width > 1 else here * 0
            done = rank[here, best] == NONE if width > 1 else here == here
            if done.any():
                for r, ids in zip(row[done].tolist(), symbols[done].tolist()):
                    out[r] = ids
                row, symbols, rank, best = (x[~done] for x in (row, symbols, rank, best))
                here = np.arange(len(row))
            if not len(row):
                continue
            merged = symbols[here, best].astype(np.int64) * self.size + symbols[here, best + 1]
            symbols[here, best] = self.pair_id[self.pair.searchsorted(merged)]
            symbols = symbols[np.arange(width) != best[:, None] + 1].reshape(len(row), width - 1)
            rank = rank[np.arange(width - 1) != best[:, None]].reshape(len(row), width - 2)
            for at in (best - 1, best):  # the pairs that the new symbol is in
                r = np.flatnonzero((at >= 0) & (at < width - 2))
                c = at[r]
                rank[r, c] = self._ranks(symbols[r, c], symbols[r, c + 1])
        return out

    def stretches(self, text: str) -> list[str]:
        """Cut before each word start; the text starts with one that isn't written."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return STRETCH.findall(marked) if self.splits else [marked]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.stretch_ids, self.stretches(text))))

    def decode(self, ids: list[int]) -> str:
        parts, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(self.text_of.get(i, ""))
        parts.append(run.decode("utf-8", "replace"))
        return "".join(parts).removeprefix(" ")

    def checked(self, stretches: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of new stretches by the agenda, each with whether the library's differ; where
        they differ, the library's ids are given."""
        own = self.all_ids(stretches) if len(stretches) >= MANY else list(map(self.stretch_ids, stretches))
        # The library puts the first word start before the text itself, but before no text none.
        texts = [s[1:].replace(SPACE, " ") for s in stretches]
        theirs = self.library.encode(texts, num_threads=1)
        lone = self.library.piece_to_id(SPACE)
        out = []
        for mine, their, text in zip(own, theirs, texts, strict=True):
            their = their if text else [lone]
            out.append((mine, False) if mine == their else (their, True))
        return out


def encode_documents(docs: DataFrame, model_file: str, digests: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Takes ``doc_id`` and ``text``; other columns are ignored whatever their names.
    Returns doc_id, n_tokens, and with ``digests`` the hashes of the ids and of the
    decoded text, else ``ids`` and ``decoded`` themselves; n_disagreed counts the text's
    stretches on which the agenda and the library differed (the library's ids stand). A null
    or empty text has no ids and decodes to an empty text; repeated rows give repeated
    results. Very long texts are whole: they are encoded stretch by stretch. An empty table
    gives an empty result.
    ``model_file`` is a path at which each worker finds the vocabulary.
    """

    def run(batches):
        if model_file not in _KNOWN:
            _KNOWN[model_file] = MergeCodec(model_file), {}
        codec, known = _KNOWN[model_file]
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_tokens": [], "n_disagreed": [], "first": [], "second": []}
            rows = batch["text"]
            for at in range(0, len(rows), 256):
                texts = [codec.stretches(t or "") for t in rows[at : at + 256].to_pylist()]
                fresh = list({s for t in texts for s in t if s not in known})
                if len(known) + len(fresh) > REMEMBERED:
                    known.clear()
                    fresh = list({s for t in texts for s in t})
                for s, (ids, differs) in zip(fresh, codec.checked(fresh), strict=True):
                    known[s] = ("!" if differs else "") + ",".join([codec.decimal[i] for i in ids])
                for stretches in texts:
                    joined = ",".join([known[s] for s in stretches])
                    wrong = joined.count("!")
                    if wrong:
                        joined = joined.replace("!", "")
                    ids = list(map(int, joined.split(","))) if joined else []
                    out["n_tokens"].append(len(ids))
                    out["n_disagreed"].append(wrong)
                    decoded = codec.library.decode(ids) if ids else ""
                    if digests:
                        out["first"].append(sha256(joined.encode()).hexdigest())
                        out["second"].append(sha256(decoded.encode()).hexdigest())
                    else:
                        out["first"].append(ids)
                        out["second"].append(decoded)
                for s in fresh:
                    if len(s) > KEPT_LENGTH:
                        del known[s]
            first, second = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
            out[first], out[second] = out["first"], out["second"]
            yield out

    kinds = (
        "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    )
    return arrow_map(
        docs.select("doc_id", "text"), run, f"doc_id long, n_tokens long, {kinds}, n_disagreed long"
    )
