"""SentencePiece encoding and decoding by a merge-type prefix table.

A byte-pair vocabulary has at most one last token for each prefix of a text: the token t that ends there and
is compatible with the last token of the prefix before t. An automaton over all reachable pieces proposes the
tokens ending at each place, compatibility of two neighbours is tested once and kept, and the ids are read
backwards from the end. The work is linear in the text, whatever the length of its words.

No piece of the vocabulary joins a visible character to a following space mark (checked when the model is
read), so a text falls apart into chunks, each a run of space marks with the characters up to the next, and
equal chunks have equal ids. Each worker keeps a bounded table of chunks it has met.

Null and empty texts: no ids, empty decoded text. Very long texts are encoded whole. Repeated rows and ids: one
result for each row. Empty tables: empty results. Extra columns are ignored. Characters outside the vocabulary become the byte tokens of their UTF-8 form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.common import bound_batches, spread, table

SPACE = "▁"
#: Chunks that a task keeps in each of two generations, and tested pairs of neighbours; workers outlive tasks, so a task drops them at its end.
KEPT, TESTED = 80_000, 150_000


class PrefixTable:
    """Encoder and decoder for one sentencepiece model of type BPE with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("needs a BPE model with byte fallback, identity normalisation and a leading space mark")
        kinds = pb.ModelProto.SentencePiece
        self.piece = [p.piece for p in model.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or len(self.byte) != 256:
            raise ValueError("a piece joins a character to a following space mark, or byte tokens are missing")
        self.chunks = re.compile(chunk_pattern(self.ids))
        self.fits: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merged(p, self.halves) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: Whether each piece ranks behind the pieces it is made of; the quick test of neighbours needs it.
        self.ordered = all(self.rank[p] > max(self.rank.get(h, (float("-inf"), 0)) for h in hs if len(h) > 1) for p, hs in self.halves.items() if len(p) > 2)
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merged(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The definition: join the neighbours whose piece ranks first, leftmost among equals, until none joins. halves: gets the last join that made the whole text."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            if halves is not None and len(parts) == 2:
                halves[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edge(self, piece: str, side: int) -> list[tuple[str, tuple[float, int]]]:
        """The pieces that stand at one end (0: first, 1: last) of piece while it is put together, each with the rank that absorbs it."""
        if (found := self.edges[side].get(piece)) is None:
            found, whole, after = [], piece, (float("inf"), 0)
            while True:
                found.append((whole, after))
                if len(whole) == 1:
                    break
                after, whole = self.rank[whole], self.halves[whole][side]
            found.reverse()
            self.edges[side][piece] = found
        return found

    def stays(self, left: str, right: str) -> bool:
        """Plays the joins on both sides of the boundary in order of rank and looks for one across it that comes first."""
        ls, rs, i, j, rank = self.edge(left, 1), self.edge(right, 0), 0, 0, self.rank
        while True:
            (a, after_a), (b, after_b) = ls[i], rs[j]
            across = rank.get(a + b)
            if across is not None and across < after_a and across <= after_b:
                return False
            if i == len(ls) - 1 and j == len(rs) - 1:
                return True
            if after_a <= after_b:
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right stay as they are when they stand side by side."""
        pair = (left, right)
        if (found := self.fits.get(pair)) is None:
            if len(self.fits) > TESTED:
                self.fits.clear()
            found = self.fits[pair] = self.stays(left, right) if self.ordered else self.merged(left + right) == [left, right]
        return found

    def tokens(self, chunk: str) -> list[str]:
        """Last token of every prefix by one pass of the automaton, then back from the end. Characters outside the vocabulary stand alone."""
        last: list[str | None] = [None] * len(chunk)
        fits, compatible = self.fits, self.compatible
        for end, piece in self.automaton.iter(chunk):
            if last[end] is None:
                before = end - len(piece)
                left = last[before] if before >= 0 else None
                if left is None or (compatible(left, piece) if (found := fits.get((left, piece))) is None else found):  # None: the start, or a character that no piece holds
                    last[end] = piece
        out, at = [], len(chunk) - 1
        while at >= 0:
            piece = last[at] or chunk[at]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for piece in self.tokens(chunk):
            i = self.ids.get(piece)
            ids.extend((i,) if i is not None else (self.byte[b] for b in piece.encode()))
        return ids

    def forget(self) -> None:
        self.known, self.older = {}, {}
        self.fits.clear()

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.split(text) for i in self.chunk_ids(chunk)]

    def decode_raw(self, ids: list[int]) -> str:
        """The text of ids, with the leading space mark."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(valid(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == 0 else self.piece[i].replace(SPACE, " "))
        if run:
            out.append(valid(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if ids and self.piece[ids[0]].startswith(SPACE) else text

    def facts(self, chunk: str) -> tuple[int, str, str]:
        pieces, known = self.tokens(chunk), self.ids
        try:
            ids = [known[p] for p in pieces]
        except KeyError:
            ids = self.chunk_ids(chunk)
            return len(ids), ",".join(map(str, ids)), self.decode_raw(ids)
        return len(ids), ",".join(map(str, ids)), "".join([self.piece[i] for i in ids]).replace(SPACE, " ")

    def document(self, text: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids joined by commas, decoded text."""
        chunks = self.split(text)
        if not chunks:
            return 0, "", ""
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for chunk in set(chunks).difference(known):
            known[chunk] = older.get(chunk) or self.facts(chunk)
        facts = list(map(known.__getitem__, chunks))
        return sum([f[0] for f in facts]), ",".join([f[1] for f in facts]), "".join([f[2] for f in facts])[1:]


def chunk_pattern(pieces: Iterable[str]) -> str:
    """Where a text may be cut because no piece reaches across: before a space mark that follows another character,
    around line ends, and between a letter or digit and a sign that no piece holds behind a letter or digit."""
    before: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in zip(p, p[1:], strict=False):
            before.setdefault(b, set()).add(a)
    if "\n" in before or any("\n" in x for x in before.values()):
        raise ValueError("a piece holds a line end")
    signs = {c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(a.isalpha() for a in before.get(c, ()))}
    glue = set().union(*(before.get(c, set()) for c in signs)) - signs - {SPACE}
    sign, other = ("".join(map(re.escape, sorted(x))) for x in (signs, glue))
    tail = f"(?:[{other}][{sign}{other}]*)?" if glue else ""
    lead = f"[{sign}{other}]*" if signs or glue else ""
    return f"\n|(?=[^\n]){SPACE}*{lead}(?:[^{SPACE}\n{sign}{other}]+{tail})*"


def valid(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is part of no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@lru_cache(maxsize=2)
def prefix_table(model_file: str) -> PrefixTable:
    return PrefixTable(model_file)


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; with_ids adds ids (array<int>), with_text decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = prefix_table(model_file)
        try:
            for batch in batches:
                yield coded(coder, batch)
        finally:
            coder.forget()

    def coded(coder: PrefixTable, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [coder.document(t or "") for t in batch.column(1).to_pylist()]
        cols = [batch.column(0).cast(pa.int64()), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sha(i) for _, i, _ in rows], pa.string()), pa.array([sha(t) for _, _, t in rows], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array([np.fromstring(i, np.int32, sep=",") if i else np.empty(0, np.int32) for _, i, _ in rows], pa.list_(pa.int32())))
            names.append("ids")
        if with_text:
            cols.append(pa.array([t for _, _, t in rows], pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(cols, names=names)

    bound_batches(docs.sparkSession)
    return spread(docs, "doc_id", "text").mapInArrow(run, schema)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_model())
