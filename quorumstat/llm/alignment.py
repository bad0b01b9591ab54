"""Cross-tokenizer alignment: which token ids of two vocabularies end together, per document and over the corpus.

Both tokenizers see the same bytes.  Running lengths of their tokens give two dictionaries
from end to index; the keys they share, sorted, cut both id lists into groups, and the
tokens of a group that end with it are linked.  No token of either vocabulary reaches across
the place before a space that follows another character, so a text is aligned in segments
cut there, and a task aligns each different segment once.

How often a pair of ids is linked over the whole corpus is summed from counts of blocks of
documents.  A document's links are kept as places in its block's list of distinct pairs, so
that the corpus' counts come back once for each block and pair, not for each link.

Edge cases: a null or empty text, one that is not UTF-8, and one whose tokens do not spell
it (a tokenizer that rewrites characters) have no tokens; rows without id or with repeated
ids stay rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

#: Folder of the public vocabularies; it is read where the tasks run.
FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that share one list of pairs; a longer document is a block of its own.
BLOCK = 8 << 20
#: Bytes of text taken at once, and what a task remembers: so many segments of at most so many characters.
SLICE, KNOWN, LONGEST = 1 << 20, 300_000, 200
#: Segments encoded as one text.
LOT = 64
_DOC = "struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,places:array<int>,times:array<int>>"


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for c, b in [*zip(shown, shown, strict=True), *((0x100 + i, b) for i, b in enumerate(hidden))]}


_CUT = re.compile(r"(?s)(?<=\S)(?= .)")
_SPACED = re.compile(r"\A(?: |\Z)|\s(?: |\Z)")


def segments(text: str) -> list[str]:
    """A space and the text in parts that begin with a space between two other characters, or before more spaces; each is given without its first
    space."""
    return [f[1:] for f in _CUT.split(" " + text)] if _SPACED.search(text) else text.split(" ")


class ByteLevel:
    """Ids of a space and the text by a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(map(alphabet.get, token)) if all(c in alphabet for c in token) else token.encode()
        self.sizes = np.array(list(map(len, self.bytes)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids of a space and the text by a vocabulary of pieces, whose model puts the space before a text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        if any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(self.model.vocab_size())):
            raise ValueError("texts are cut before spaces, but a piece goes on with a space after another character")
        for number in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(number)
            coded = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if self.model.is_byte(number) else None
            self.bytes.append(bytes([int(coded[1], 16)]) if coded else piece.replace("▁", " ").encode())
        self.sizes = np.array(list(map(len, self.bytes)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def align(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Ends (exclusive places in a and b) of each group, and the linked ids: one list for each side."""
    a_ends, b_ends = list(accumulate([len(a_bytes[i]) for i in a])), list(accumulate([len(b_bytes[i]) for i in b]))
    a_at, b_at = dict(zip(a_ends, range(1, len(a) + 1), strict=True)), dict(zip(b_ends, range(1, len(b) + 1), strict=True))
    groups = [(a_at[e], b_at[e]) for e in sorted(a_at.keys() & b_at.keys())]
    if len(a_at) == len(a) and len(b_at) == len(b):
        return groups, [a[i - 1] for i, _ in groups], [b[j - 1] for _, j in groups]
    left, right, i, j = [], [], 0, 0
    for x, y in groups:  # tokens without bytes end where the one before them does
        ending = [t for t, e in zip(b[j:y], b_ends[j:y], strict=True) if e == b_ends[y - 1]]
        for s, e in zip(a[i:x], a_ends[i:x], strict=True):
            if e == a_ends[x - 1]:
                left += [s] * len(ending)
                right += ending
        i, j = x, y
    return groups, left, right


def spell(groups: list[tuple[int, int]], a: list[int], b: list[int]) -> list[str]:
    """`a1,a2|b1`, `a3|b2,b3`: the ids of each group."""
    x, y, i, j, out = list(map(str, a)), list(map(str, b)), 0, 0, []
    for p, q in groups:
        out.append(f"{x[i]}|{y[j]}" if p == i + 1 and q == j + 1 else f"{','.join(x[i:p])}|{','.join(y[j:q])}")
        i, j = p, q
    return out


class Segments:
    """Alignments of the segments met so far: numbers of tokens, groups and links, the groups' text, and linked pairs."""

    def __init__(self, first: ByteLevel, second: Pieces) -> None:
        self.first, self.second = first, second
        #: Each id followed by a comma, a bar, a semicolon.
        self.ids = [f"{i}{c}" for i in range(max(len(first.bytes), len(second.bytes))) for c in (",", "|", ";", "")]
        self.widths = np.array(list(map(len, self.ids)))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.length = 0
        #: Tokens of both sides, groups, and whether the tokens spell the segment; links, and where they begin in `codes`.
        self.counts, self.size, self.start, self.codes = np.empty((0, 4), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Aligns segments as one text after another: the groups of a run of segments are those of each."""
        whole = [" " + f for f in fresh]
        coded = [w.encode() for w in whole]
        firsts, seconds = self._encoded(whole, coded, self.first), self._encoded(whole, coded, self.second)
        good = self._spells(coded, firsts, self.first) & self._spells(coded, seconds, self.second)
        text, counts, size, codes = [""] * len(fresh), np.zeros((len(fresh), 4), np.int64), np.zeros(len(fresh), np.int64), np.empty(0, np.int64)
        run = np.flatnonzero(good)
        n_a, n_b = (np.array([len(ids[k]) for k in run], np.int64) for ids in (firsts, seconds))
        a, b = (np.array([i for k in run for i in ids[k]], np.int64) for ids in (firsts, seconds))
        if (self.first.sizes[a] > 0).all() and (self.second.sizes[b] > 0).all():
            a_ends, b_ends = self.first.sizes[a].cumsum(), self.second.sizes[b].cumsum()
            both, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
            last = np.searchsorted(i, np.cumsum(n_a) - 1) + 1  # groups up to the end of each segment
            groups = np.diff(last, prepend=0)
            codes, size[run] = a[i] << 32 | b[j], groups
            for k, t in zip(run.tolist(), self._spelled(a, b, i, j, last), strict=True):
                text[k] = t
        else:  # tokens without bytes end with those before them, in another segment too
            links, groups = [codes], []
            for k in run.tolist():
                ends, x, y = align(firsts[k], seconds[k], self.first.bytes, self.second.bytes)
                text[k], size[k] = "".join([g + ";" for g in spell(ends, firsts[k], seconds[k])]), len(x)
                links.append(np.array(x, np.int64) << 32 | np.array(y, np.int64)), groups.append(len(ends))
            codes = np.concatenate(links)
        counts[run] = np.stack((n_a, n_b, np.array(groups, np.int64), np.ones(len(run), np.int64)), 1)
        self.place |= dict(zip(fresh, range(len(self.text), len(self.text) + len(fresh)), strict=True))
        self.text += text
        self.length += sum(map(len, fresh))
        self.start = np.concatenate((self.start, len(self.codes) + np.cumsum(size) - size))
        self.size, self.counts, self.codes = np.concatenate((self.size, size)), np.concatenate((self.counts, counts)), np.concatenate((self.codes, codes))

    def _spelled(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, last: np.ndarray) -> list[str]:
        """What `spell` gives, each group with a semicolon behind, of segments that end with group `last` - 1; groups end with
        the tokens a[i] and b[j]."""
        before_a, before_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        at_a = np.arange(len(a)) + np.repeat(np.cumsum(before_b) - before_b, before_a)
        at_b = np.arange(len(b)) + np.repeat(np.cumsum(before_a), before_b)
        token = np.empty(len(a) + len(b), np.int64)
        token[at_a], token[at_b] = 4 * a, 4 * b
        token[at_a[i]] += 1
        token[at_b[j]] += 2
        text = "".join(map(self.ids.__getitem__, token.tolist()))
        ends = np.concatenate(([0], np.cumsum(self.widths[token])))[np.concatenate(([0], at_b[j][last - 1] + 1)).astype(np.int64)].tolist()
        return [text[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]

    @staticmethod
    def _encoded(whole: list[str], coded: list[bytes], model: ByteLevel | Pieces) -> list[list[int]]:
        """Ids of each segment.  Those that a text would be cut into again are encoded LOT at a time, and alone if their
        ends are not ends of tokens."""
        found: list[list[int] | None] = [None] * len(whole)
        plain = [k for k, w in enumerate(whole) if len(w) > 1 and not w[1].isspace() and not w[-1].isspace()]
        lots = [plain[lo : lo + LOT] for lo in range(0, len(plain), LOT)]
        for lot, ids in zip(lots, model.encode(["".join([whole[k] for k in lot]) for lot in lots]) if lots else [], strict=True):
            size, want = model.sizes[ids], np.cumsum([len(coded[k]) for k in lot])
            ends = size.cumsum()
            at = np.searchsorted(ends, want) + 1
            if len(ends) == at[-1] and (ends[at - 1] == want).all() and size.all():
                for k, lo, hi in zip(lot, [0, *at[:-1].tolist()], at.tolist(), strict=True):
                    found[k] = ids[lo:hi]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, model.encode([whole[k] for k in rest]) if rest else [], strict=True):
            found[k] = ids
        return found

    @staticmethod
    def _spells(coded: list[bytes], ids: list[list[int]], model: ByteLevel | Pieces) -> np.ndarray:
        """Whether each segment is what its tokens spell."""
        if not coded:
            return np.ones(0, bool)
        flat, n = model.sizes[[i for each in ids for i in each]], np.array(list(map(len, ids)))
        upto = np.concatenate(([0], np.cumsum(flat)))[np.concatenate(([0], np.cumsum(n)))]
        if b"".join([model.bytes[i] for each in ids for i in each]) == b"".join(coded) and (np.diff(upto) == list(map(len, coded))).all():
            return np.ones(len(coded), bool)
        return np.array([b"".join([model.bytes[i] for i in each]) == c for each, c in zip(ids, coded, strict=True)])

    def documents(self, texts: list[bytes | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, sha, codes of links) of each text."""
        if len(self.text) > KNOWN or self.length > KNOWN * LONGEST:
            self.forget()
        parts = []
        for t in texts:
            try:
                parts.append(segments(t.decode()) if t else [])
            except UnicodeDecodeError:
                parts.append([])
        fresh = set().union(*parts) - self.place.keys()
        self.learn(sorted(fresh))
        for p in parts:
            at = list(map(self.place.__getitem__, p))
            place = np.array(at, np.int64)
            own = self.counts[place]
            if not len(p) or not own[:, 3].all():
                yield 0, 0, 0, "", np.empty(0, np.int64)
                continue
            n_a, n_b, n_groups, _ = own.sum(0).tolist()
            length = self.size[place]
            codes = self.codes[np.repeat(self.start[place] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
            yield n_a, n_b, n_groups, hashlib.sha256("".join(map(self.text.__getitem__, at))[:-1].encode()).hexdigest(), codes
        for f in fresh:
            if len(f) > LONGEST:
                del self.place[f]
                self.length -= len(f)


def blocks(docs: DataFrame, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, pair, n, docs): a row for each block of documents, with the distinct pairs linked in it (a << 32 | b), how
    often each is, and for each document its counts and its links as places in `pair` with their times."""
    schema = f"block long, pair array<long>, n array<long>, docs array<{_DOC}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(ByteLevel(os.path.join(folder, first)), Pieces(os.path.join(folder, second)))
        task, rows, codes, size, done = TaskContext.get().partitionId(), [], [], 0, 0

        def block() -> pa.RecordBatch:
            pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
            where = np.cumsum([0, *map(len, codes)])
            out = []
            for row, lo, hi in zip(rows, where[:-1], where[1:], strict=True):
                places, times = np.unique(place[lo:hi], return_counts=True)
                out.append({**row, "places": places.astype(np.int32), "times": times.astype(np.int32)})
            kinds = pa.struct([(f, pa.string() if f == "groups_sha256" else pa.int64()) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")] + [(f, pa.list_(pa.int32())) for f in ("places", "times")])
            cols = [[(task << 32) | done], [pairs], [np.bincount(place, minlength=len(pairs))], [out]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "pair", "n", "docs"])

        def taken(ids: list, texts: list) -> None:
            for number, (n_a, n_b, n_groups, sha, links) in zip(ids, known.documents(texts), strict=True):
                rows.append({"doc_id": number, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": len(links), "groups_sha256": sha})
                codes.append(links)

        for batch in batches:
            lo, ids = 0, batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            lengths = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]))
            while lo < len(ids):
                before = lengths[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(lengths, before + SLICE, "right")))
                taken(ids[lo:hi], texts[lo:hi].to_pylist())
                size, lo = size + int(lengths[hi - 1] - before), hi
                if size >= BLOCK:
                    yield block()
                    rows, codes, size, done = [], [], 0, done + 1
        if rows:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair of ids over all blocks, and whether no other pair of its second id has more."""
    from pyspark.sql import Window

    each = found.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).select("p.pair", "p.n")
    counts = each.groupBy("pair").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from rows (docs, known): known has the place, count and best of each pair of the block."""
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for b in batches:
        for k in range(b.num_rows):
            known, docs = b.column(1)[k].values, b.column(0)[k].values
            n = len(known) if known is not None else 0
            count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if n:
                at = known.field("place").to_numpy(zero_copy_only=False)
                count[at] = known.field("count").to_numpy(zero_copy_only=False)
                best[at] = known.field("best").to_numpy(zero_copy_only=False)
            places, times = docs.field("places"), docs.field("times")
            flat, often = places.flatten().to_numpy(), times.flatten().to_numpy()
            upto = np.concatenate(([0], np.cumsum(np.diff(places.offsets.to_numpy()))))
            sums = []
            for value in (best, count):
                run = np.concatenate((np.zeros(1, np.int64), np.cumsum(value[flat] * often)))
                sums.append(run[upto[1:]] - run[upto[:-1]])
            cols = {c: docs.field(c) for c in names if c not in ("n_best", "count_sum")} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=list(names))


def alignments(docs: DataFrame, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    found = stored(blocks(docs, folder, first, second, id_col, text_col))
    counts = cut(pair_counts(found))
    each = found.select("block", F.posexplode("pair").alias("place", "pair")).join(counts, "pair")
    known = each.groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.select("block", "docs").join(known, "block", "left").select("docs", "known").mapInArrow(_sums, schema)


def linked_pairs(docs: DataFrame, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, count, best): every pair of ids linked in the corpus."""
    counts = pair_counts(stored(blocks(docs, folder, first, second, id_col, text_col)))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count", "best")
